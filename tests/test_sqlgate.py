import pytest

from gritsieve.sqlgate import NotReadOnly, guard, preview_sql, run_sql

WRITING = [
    "CREATE TABLE kept AS SELECT * FROM data", "ALTER VIEW data AS SELECT 2", "TRUNCATE TABLE data", "CACHE TABLE data",
    "WITH t AS (SELECT 1 AS a) FROM t INSERT OVERWRITE DIRECTORY '{0}' USING csv SELECT a",
    "FROM data INSERT INTO other SELECT k", "WITH t AS (SELECT k FROM data) INSERT INTO other SELECT k FROM t",
    "INSERT OVERWRITE LOCAL DIRECTORY '{0}' SELECT 1", "SET spark.sql.ansi.enabled=false", "ADD JAR '/x.jar'", "SHOW TABLES",
    "EXPLAIN SELECT 1", "USE elsewhere", "MERGE INTO data USING o ON data.k = o.k WHEN MATCHED THEN DELETE",
]
ELSEWHERE = [
    "SELECT * FROM hidden", "SELECT * FROM data JOIN hidden USING (k)", "SELECT (SELECT max(k) FROM hidden) FROM data",
    "SELECT * FROM data WHERE EXISTS (SELECT 1 FROM hidden h WHERE h.k = data.k)", "SELECT * FROM text.`{0}`", "SELECT * FROM `text`.`{0}`",
    "SELECT * FROM data WHERE k IN (SELECT k FROM hidden)", "SELECT java_method('java.lang.Math', 'abs', 1)",
    "SELECT k FROM data ORDER BY reflect('java.lang.Runtime', 'getRuntime')", "SELECT input_file_name() FROM data",
    "SELECT TRANSFORM(k) USING 'cat' AS (x) FROM data", "WITH t AS (SELECT * FROM hidden) SELECT * FROM t", "SELECT * FROM default.data",
    "SELECT own_udf(k) FROM data",
]
IDENTIFIERS = [
    "SELECT IDENTIFIER('reflect')('java.lang.System', 'getProperty', 'user.home') FROM data", "SELECT * FROM IDENTIFIER('hidden')",
    "SELECT * FROM IDENTIFIER('parquet.`{0}`')", "SELECT * FROM IDENTIFIER('global_temp.shared')", "SELECT IDENTIFIER('own_udf')(k) FROM data",
    "SELECT * FROM IDENTIFIER('hid' || 'den')", "SELECT IDENTIFIER(reflect('java.lang.System', 'getProperty', 'user.home')) FROM data",
    "WITH t AS (SELECT * FROM IDENTIFIER('hidden')) SELECT * FROM t", "SELECT (SELECT max(id) FROM IDENTIFIER('global_temp.shared')) FROM data",
]
OTHER_WAYS = [
    "EXECUTE IMMEDIATE 'SELECT * FROM data'", "EXECUTE IMMEDIATE 'CREATE VIEW v AS SELECT 1'", "DECLARE VARIABLE x INT", "SET VAR own_var = 2",
    "SELECT own_var FROM data", "SELECT session.own_var FROM data", "SELECT system.session.own_var FROM data",
    "BEGIN SELECT 1; END", "SELECT * FROM saved", "SELECT * FROM IDENTIFIER('saved')", "FROM data |> WHERE reflect('java.lang.Math', 'random') > 0",
    "FROM data |> JOIN hidden USING (k)", "SELECT transform(array(k), x -> own_udf(x)) FROM data", "SELECT input_file_name()",
    "WITH RECURSIVE t(n) AS (SELECT 1 UNION ALL SELECT k FROM hidden, t) SELECT * FROM t",
    "SELECT from_protobuf(cast(`set` AS BINARY), 'M', '{0}') FROM data", "SELECT nothing FROM data",
]
BROKEN = ["", "  \n", "SELECT 1; SELECT 2", "SELEC 1", "/* nothing */"]
READING = [
    "SELECT max(k) AS m FROM data", "FROM data SELECT k WHERE k > 3", "VALUES (1), (2)", "SELECT 1 AS a;",
    "WITH t AS (SELECT k % 2 AS odd FROM data), u AS (SELECT odd, count(*) AS n FROM t GROUP BY odd) SELECT * FROM u ORDER BY n",
    "SELECT k, row_number() OVER (ORDER BY k) AS r FROM data", "SELECT * FROM data LATERAL VIEW explode(array(1, 2)) x AS e",
    "SELECT `set`, 'INSERT INTO x; -- DROP' AS s FROM data", "SELECT k FROM data UNION SELECT 5 EXCEPT SELECT 6",
    "FROM data |> WHERE k > 3 |> AGGREGATE count(*) AS n GROUP BY `set` |> ORDER BY n", "FROM data |> SELECT k |> EXTEND k + 1 AS j |> LIMIT 3",
    "WITH RECURSIVE t(n) AS (SELECT 1 UNION ALL SELECT n + 1 FROM t JOIN data ON k = n WHERE n < 5) SELECT * FROM t",
    "SELECT IDENTIFIER('k') FROM IDENTIFIER('data')", "SELECT IDENTIFIER('abs')(k) FROM data", "SELECT `set`, grouping(`set`), count(*) FROM data GROUP BY CUBE (`set`)",
    "SELECT transform(collect_list(k), x -> x + 1), percentile_cont(0.5) WITHIN GROUP (ORDER BY k), mode(k) FROM data",
    "SELECT lpad(`set`, 3, 'x'), date_add(date'2020-01-01', k), k BETWEEN 1 AND 2, k IN (1, 2), `set` LIKE 'a%', named_struct('a', k).a FROM data",
    "SELECT * FROM (SELECT k, `set` FROM data) PIVOT (sum(k) FOR `set` IN ('a', '--'))", "SELECT hour(current_timestamp()), k::string || 'x' FROM data",
    "SELECT sum(k) OVER (PARTITION BY `set` ORDER BY k ROWS BETWEEN 1 PRECEDING AND CURRENT ROW), lag(k) OVER (ORDER BY k) FROM data",
    "SELECT get_json_object(to_json(struct(k)), '$.k'), parse_json('{{}}'), CASE WHEN k > 1 THEN 'a' ELSE NULL END FROM data TABLESAMPLE (100 PERCENT)",
    "SELECT data.k, x.s FROM data, LATERAL (SELECT data.k + 1 AS s) x", "SELECT * FROM data DISTRIBUTE BY k SORT BY k",
    "SELECT a.k FROM data a JOIN data b ON a.k = b.k WHERE a.k IN (SELECT max(k) FROM data)", "SELECT * FROM range(3)",
]


@pytest.fixture(scope="module")
def data(spark):
    spark.range(3).withColumnRenamed("id", "k").createOrReplaceTempView("hidden")
    spark.udf.register("own_udf", lambda k: k)
    spark.range(3).createOrReplaceGlobalTempView("shared")
    spark.sql("DECLARE OR REPLACE VARIABLE own_var INT DEFAULT 1")
    spark.sql("CREATE TABLE IF NOT EXISTS saved USING parquet AS SELECT 1 AS k")
    yield spark.range(6000).selectExpr("cast(id as int) as k", "if(id % 2 = 0, 'a', '--') as `set`")
    spark.sql("DROP TABLE IF EXISTS saved")
    spark.catalog.dropGlobalTempView("shared")


@pytest.mark.parametrize("sql", WRITING + ELSEWHERE + IDENTIFIERS + OTHER_WAYS + BROKEN)
def test_refused(data, tmp_path, sql):
    with pytest.raises(NotReadOnly):
        run_sql(data, sql.format(tmp_path / "out"))
    assert not (tmp_path / "out").exists()


@pytest.mark.parametrize("sql", READING)
def test_read(spark, data, sql):
    sql = sql.replace("{{}}", "{}")
    assert guard(spark, sql) == sql
    assert run_sql(data, sql).count() > 0


def test_whole_result_and_literals(data):
    assert run_sql(data, "SELECT * FROM data").count() == 6000
    assert preview_sql(data, "SELECT * FROM data", 7).count() == 7
    assert run_sql(data, "SELECT k FROM data WHERE `set` = '--'").count() == 3000
    row = run_sql(data, "SELECT '/*' AS a, k, '*/' AS b FROM data WHERE k = 4").first()
    assert tuple(row) == ("/*", 4, "*/")


def test_views_of_the_caller_stay(spark, data):
    spark.range(2).createOrReplaceTempView("data")
    assert run_sql(data, "SELECT count(*) AS n FROM data").first()["n"] == 6000
    assert spark.table("data").count() == 2
    assert run_sql(data, "SELECT 1 AS x FROM data").union(spark.range(1)).count() == 6001
    spark.catalog.dropTempView("data")
    assert run_sql(data, "SELECT 1 AS x FROM data").count() == 6000
    assert not spark.catalog.tableExists("data")
