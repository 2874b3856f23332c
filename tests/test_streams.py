import datetime as dt

import pytest
from pyspark.sql import functions as F

from gritsieve.functions.cells import ROW_ID
from gritsieve.plans.plan import Step
from gritsieve.plans.recipe import Recipe
from gritsieve.streaming.clean import clean_stream, distinct_stream, scan_batches, write_stream
from gritsieve.operators.detectors import scan
from gritsieve.streaming.counters import quality_counters
from gritsieve.streaming.so_far import SoFar, scan_so_far

SCHEMA = f"{ROW_ID} bigint, ts timestamp_ntz, age string, state string, rate double"


@pytest.fixture(scope="module")
def source(spark, tmp_path_factory):
    """Three files of readings, with repeated ones among them."""
    path = str(tmp_path_factory.mktemp("stream") / "in")
    for part in range(3):
        data = [
            (i, dt.datetime(2026, 1, 1) + dt.timedelta(minutes=7 * i), "999" if i % 10 == 0 else str(20 + i % 50),
             [" Lagos", "lagos", "Kano"][i % 3], None if i % 9 == 0 else float(i % 130))
            for i in range(part * 90, part * 90 + 100)
        ]
        spark.createDataFrame(data, SCHEMA).coalesce(1).write.mode("append").parquet(path)
    return path


def stream_of(spark, source, files=1):
    return spark.readStream.schema(SCHEMA).option("maxFilesPerTrigger", files).parquet(source)


def test_row_local_steps_give_the_batch_result(spark, source, tmp_path):
    batch = spark.read.schema(SCHEMA).parquet(source)
    recipe = Recipe.learn(batch, [
        Step("recode_sentinel_missing", {"column": "age", "values": ["999"]}), Step("coerce_numeric", {"column": "age"}),
        Step("strip_whitespace", {"column": "state"}), Step("map_categories", {"column": "state", "mapping": {"lagos": "Lagos"}}),
        Step("drop_duplicates"), Step("fill_missing", {"column": "rate", "method": "median"}),
        Step("clip_outliers", {"column": "rate", "lower": 0, "upper": 100}),
        Step("flag_out_of_range", {"column": "age", "lower": 25, "upper": 60}), Step("deidentify", {"column": "state"}),
    ])
    out = clean_stream(stream_of(spark, source), recipe)
    write_stream(out, str(tmp_path / "out"), str(tmp_path / "cp")).awaitTermination()
    streamed = spark.read.parquet(str(tmp_path / "out"))
    want = recipe.row_local().apply(batch)
    assert sorted(map(str, streamed.select(want.columns).collect())) == sorted(map(str, want.collect()))
    # Duplicates are settled by the batch that follows.
    assert streamed.dropDuplicates().count() == recipe.apply(batch).count() == 280


def test_distinct_within_watermark(spark, source, tmp_path):
    out = distinct_stream(stream_of(spark, source), "ts", "30 days", ["ts", "age", "state", "rate"])
    write_stream(out, str(tmp_path / "out"), str(tmp_path / "cp")).awaitTermination()
    assert spark.read.parquet(str(tmp_path / "out")).count() == 280


def test_counters_on_stream_and_table(spark, source, tmp_path):
    batch = quality_counters(spark.read.schema(SCHEMA).parquet(source), "ts", "6 hours")
    stream = quality_counters(stream_of(spark, source), "ts", "6 hours", delay="1 day")
    query = stream.writeStream.outputMode("complete").format("memory").queryName("counters").trigger(availableNow=True)
    query.option("checkpointLocation", str(tmp_path / "cp")).start().awaitTermination()
    assert sorted(map(tuple, spark.table("counters").collect())) == sorted(map(tuple, batch.collect()))
    got = batch.groupBy("column").agg(F.sum("n_blank"), F.sum("n_codes"), F.sum("n_beyond"))
    by_column = {r[0]: tuple(r)[1:] for r in got.collect()}
    assert by_column["rate"][0] > 0 and by_column["rate"][2] > 0 and by_column["age"][1] > 0


def test_scan_of_batches(spark, source, tmp_path):
    scan_batches(stream_of(spark, source), str(tmp_path / "found"), str(tmp_path / "cp")).awaitTermination()
    found = spark.read.parquet(str(tmp_path / "found"))
    assert found.select("batch_id").distinct().count() == 3
    assert {r["kind"] for r in found.collect()} >= {"sentinel_missing", "case_variants", "numeric_like"}


def test_findings_so_far_are_those_of_all_rows(spark, source, tmp_path):
    scan_so_far(stream_of(spark, source), str(tmp_path / "found"), str(tmp_path / "state"), str(tmp_path / "cp")).awaitTermination()
    found = spark.read.parquet(str(tmp_path / "found"))
    assert sorted(r[0] for r in found.select("batch_id").distinct().collect()) == [0, 1, 2]
    whole = scan(spark.read.schema(SCHEMA).parquet(source))
    last = found.where("batch_id = 2").drop("batch_id")
    assert sorted(map(str, last.select(whole.columns).collect())) == sorted(map(str, whole.collect()))
    assert {r["kind"] for r in whole.collect()} >= {"duplicate_rows", "sentinel_missing", "case_variants"}


def test_a_batch_run_again_and_columns_that_grow(spark, tmp_path):
    """The second part has many values in a column of few, codes in it, repeated rows, and the earlier part's rows again."""
    schema = f"{ROW_ID} bigint, a string, b string, q string"
    one = [(i, ["yes", "Yes", "no"][i % 3], ["10", "20", "999"][i % 3], "x") for i in range(60)]
    two = [(60 + i, "no" if i % 2 else " NO", str(1000 + i) if i % 4 else "999", "x") for i in range(400)]
    three = [(460 + i, *r[1:]) for i, r in enumerate(one[:20])]
    parts = [spark.createDataFrame(rows, schema) for rows in (one, two, three)]
    state = SoFar(spark, str(tmp_path / "state"))
    for batch, part in ((0, parts[0]), (1, parts[1]), (1, parts[1]), (2, parts[2]), (2, parts[2])):
        got = state.findings(part, batch)
    want = scan(spark.createDataFrame(one + two + three, schema))
    assert sorted(map(str, got.collect())) == sorted(map(str, want.collect()))
    assert {"duplicate_rows", "constant_columns", "sentinel_missing", "case_variants"} <= {r["kind"] for r in want.collect()}


def test_question_text_in_the_first_row_of_a_stream(spark, tmp_path):
    schema = f"{ROW_ID} bigint, a string, b string"
    head = "How would you rate the quality of the service you were given?"
    parts = [[(0, head, head), (1, "3", "x")], [(2, "4", "y"), (3, "5", "z")]]
    state = SoFar(spark, str(tmp_path / "state"))
    got = [state.findings(spark.createDataFrame(p, schema), i).collect() for i, p in enumerate(parts)][-1]
    assert got == scan(spark.createDataFrame(parts[0] + parts[1], schema)).collect()
    assert [r["kind"] for r in got] == ["two_row_header"]


def test_a_batch_of_one_file_is_spread_over_the_cores(spark, tmp_path, monkeypatch):
    schema = f"{ROW_ID} bigint, a string"
    spark.createDataFrame([(i, "x") for i in range(100)], schema).coalesce(1).write.parquet(str(tmp_path / "rows"))
    parts, findings = [], SoFar.findings
    monkeypatch.setattr(SoFar, "findings", lambda so_far, rows, batch: parts.append(rows.rdd.getNumPartitions()) or findings(so_far, rows, batch))
    stream = spark.readStream.schema(schema).parquet(str(tmp_path / "rows"))
    scan_so_far(stream, str(tmp_path / "found"), str(tmp_path / "state"), str(tmp_path / "cp")).awaitTermination()
    assert parts and min(parts) >= spark.sparkContext.defaultParallelism
