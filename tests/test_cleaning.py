"""One case per operator on a small literal table, then the same operators through script, recipe and stream."""

import datetime as dt
import hashlib
import subprocess
import sys

import pytest
from pyspark.sql import functions as F

from frames import rows
from gritsieve.functions.cells import ROW_ID
from gritsieve.operators import cleaning as ops
from gritsieve.operators.registry import OPERATIONS
from gritsieve.plans.plan import Step
from gritsieve.plans.recipe import Recipe, ledger_table, run_step
from gritsieve.plans.script import to_script

N = None
PARCELS = {
    "qty": ("bigint", [12, 9999, 7, 30, 9999, 5]),
    "price": ("double", [8.5, -999.0, 4.0, N, 19.5, 2.0]),
    "colour": ("string", ["Red", " green ", "RED", "Green", "red", N]),
    "depot": ("string", ["North", "north", " North", "South", "SOUTH", "East"]),
    "grade": ("string", ["Good", "Excellent", "Fair", "Poor", "Good", N]),
    "sent": ("string", ["2025-07-04", "04/07/2025", "2025-08-21", "21-08-2025", "2025-10-01", "2025-10-09"]),
    "got": ("string", ["2025-07-05", "05/07/2025", "2025-08-20", "22-08-2025", "2025-10-04", "2025-10-08"]),
    "clerk": ("string", ["M. Reyes", "J. Novak", "L. Haas", "P. Quinn", "M. Reyes", "S. Ito"]),
    "unit": ("string", ["box"] * 6),
    "extra_gift": ("string", ["gift", N, "gift", N, "gift", N]),
    "extra_rush": ("string", [N, "rush", "rush", N, N, "rush"]),
    "extra_sign": ("string", ["sign", "sign", N, N, "sign", N]),
}
GRADES = ["Poor", "Fair", "Good", "Excellent"]
MEMBERS = ["extra_gift", "extra_rush", "extra_sign"]
DATED = [Step("coerce_datetime", {"column": "sent"}), Step("coerce_datetime", {"column": "got"})]

# operator -> (parameters, steps before it)
CASES = {
    "promote_header_row": ({"drop_rows": 1}, []),
    "drop_repeated_header_rows": ({}, []),
    "drop_duplicates": ({}, []),
    "drop_empty_rows": ({}, []),
    "drop_column": ({"column": "unit"}, []),
    "drop_constant_columns": ({"columns": ["unit"]}, []),
    "rename_column": ({"column": "qty", "new_name": "pieces"}, []),
    "recode_sentinel_missing": ({"column": "qty", "values": [9999]}, []),
    "order_likert": ({"column": "grade", "order": GRADES}, []),
    "collapse_multiselect": ({"stem": "extra", "members": MEMBERS}, []),
    "deidentify": ({"column": "clerk", "method": "hash"}, []),
    "coerce_numeric": ({"column": "depot"}, []),
    "coerce_datetime": ({"column": "sent", "dayfirst": True}, []),
    "strip_whitespace": ({"column": "colour"}, []),
    "map_categories": ({"column": "depot", "mapping": {"north": "North", " North": "North"}}, []),
    "fill_missing": ({"column": "price", "method": "median"}, []),
    "clip_outliers": ({"column": "qty", "lower": 0, "upper": 100}, []),
    "flag_out_of_range": ({"column": "qty", "lower": 6, "upper": 50}, []),
    "flag_date_order": ({"start_column": "sent", "end_column": "got"}, DATED),
}


@pytest.fixture(scope="module")
def survey(frame):
    return frame(PARCELS)


def test_every_operator_has_a_case():
    assert set(CASES) == set(OPERATIONS)
    assert all(1 <= op.stage <= 9 for op in OPERATIONS.values())


def test_promote_header_row(survey):
    assert rows(ops.promote_header_row(survey, 2), "qty") == [7, 30, 9999, 5]


def test_drop_repeated_header_rows(spark, survey):
    head = survey.limit(1).select(F.lit(99).cast("bigint").alias(ROW_ID), *[
        F.lit(f" {c.upper()} ").try_cast(survey.schema[c].dataType).alias(c) for c in survey.columns if c != ROW_ID
    ])
    assert ops.drop_repeated_header_rows(survey.union(head)).count() == 6


def test_drop_empty_rows(survey):
    blank = survey.limit(1).select(F.lit(99).cast("bigint").alias(ROW_ID), *[
        F.lit(float("nan") if c == "price" else None).cast(survey.schema[c].dataType).alias(c)
        for c in survey.columns if c != ROW_ID
    ])
    assert ops.drop_empty_rows(survey.union(blank)).count() == 6


def test_structure(survey):
    assert "unit" not in ops.drop_column(survey, "unit").columns
    with pytest.raises(KeyError):
        ops.drop_column(survey, "nowhere")
    assert ops.rename_column(survey, "qty", "pieces").columns[1] == "pieces"
    assert "unit" not in ops.drop_constant_columns(survey, ["unit", "nowhere"]).columns


def test_collapse_multiselect(survey):
    got = rows(ops.collapse_multiselect(survey, "extra", MEMBERS), "extra_count", "extra_selected")
    assert got == [(2, "gift, sign"), (2, "rush, sign"), (2, "gift, rush"), (0, ""), (2, "gift, sign"), (1, "rush")]


def test_recode_keeps_numbers_and_restores_them(survey, frame):
    assert rows(ops.recode_sentinel_missing(survey, "qty", ["9999"]), "qty") == [12, N, 7, 30, N, 5]
    assert rows(ops.recode_sentinel_missing(survey, "price", ["-999.0"]), "price")[1] is None
    text = frame({"qty": ("string", ["61", "9999", "refused", "8"])})
    recipe = Recipe.learn(text, [Step("recode_sentinel_missing", {"column": "qty", "values": ["9999", "refused"]})])
    assert recipe.steps[0].params["to_number"] is True
    assert rows(recipe.apply(text), "qty") == [61.0, N, N, 8.0]
    partly = Recipe.learn(text, [Step("recode_sentinel_missing", {"column": "qty", "values": ["9999"]})])
    assert rows(partly.apply(text), "qty") == ["61", N, "refused", "8"]
    lowest = frame({"v": ("bigint", [1, -9223372036854775808])})
    assert rows(ops.recode_sentinel_missing(lowest, "v", ["-9223372036854775808"]), "v") == [1, N]


def test_order_likert(survey):
    out = ops.order_likert(survey, "grade", GRADES)
    assert rows(out, "grade", "grade__ord") == [
        ("Good", 3), ("Excellent", 4), ("Fair", 2), ("Poor", 1), ("Good", 3), (N, N)
    ]
    assert out.schema["grade"].metadata["levels"][0] == "Poor"


def test_types(survey):
    assert rows(ops.coerce_numeric(survey, "depot"), "depot") == [N] * 6
    got = rows(ops.coerce_datetime(survey, "sent", dayfirst=True), "sent")
    assert got[:2] == [dt.datetime(2025, 7, 4), dt.datetime(2025, 7, 4)] and N not in got


def test_spellings(survey, spark):
    assert rows(ops.strip_whitespace(survey, "colour"), "colour") == ["Red", "green", "RED", "Green", "red", N]
    mapping = {"north": "North", " North": "North", "North": "Hub"}
    want = ["Hub", "North", "North", "South", "SOUTH", "East"]
    assert rows(ops.map_categories(survey, "depot", mapping), "depot") == want
    long = mapping | {f"x{i}": "y" for i in range(ops.INLINE_KEYS)}
    assert rows(ops.map_categories(survey, "depot", long), "depot") == want


def test_drop_duplicates_keeps_the_first(survey, spark):
    again = survey.filter(f"{ROW_ID} < 2").withColumn(ROW_ID, F.col(ROW_ID) + 10)
    got = ops.drop_duplicates(again.union(survey).repartition(4))
    assert sorted(r[ROW_ID] for r in got.collect()) == [0, 1, 2, 3, 4, 5]
    nested = spark.sql("SELECT explode(sequence(1, 4)) AS _row_id, map('a', 1) AS m, array(1, 2) AS l")
    assert [tuple(r) for r in ops.drop_duplicates(nested).collect()] == [(1, {"a": 1}, [1, 2])]


@pytest.mark.parametrize("method, filler", [("median", 4.0), ("mean", -193.0), ("mode", -999.0)])
def test_fill_missing(survey, method, filler):
    recipe = Recipe.learn(survey, [Step("fill_missing", {"column": "price", "method": method})])
    assert recipe.steps[0].params["value"] == pytest.approx(filler)
    assert rows(recipe.apply(survey), "price")[3] == pytest.approx(filler)
    assert rows(ops.fill_missing(survey, "colour", "constant", "?"), "colour")[5] == "?"
    with pytest.raises(ValueError):
        ops.fill_missing(survey, "colour", "magic")


def test_ranges_and_flags(survey, frame):
    assert rows(ops.clip_outliers(survey, "qty", 10.0, 100.0), "qty") == [12, 100, 10, 30, 100, 10]
    assert rows(ops.clip_outliers(survey, "price", 0, 9), "price") == [8.5, 0, 4, N, 9, 2]
    assert rows(ops.flag_out_of_range(survey, "qty", 6, 50), "qty_out_of_range") == [False, True, False, False, True, True]
    nan = frame({"v": ("double", [float("nan"), 5.0, N])})
    assert rows(ops.flag_out_of_range(nan, "v", 0, 1), "v_out_of_range") == [False, True, False]
    dated = Recipe("x", DATED).apply(survey)
    assert rows(ops.flag_date_order(dated, "sent", "got"), "got_before_sent") == [False, False, True, False, False, True]


def test_deidentify(survey):
    assert rows(ops.deidentify(survey, "clerk"), "clerk")[0] == hashlib.sha256(b"M. Reyes").hexdigest()[:12]
    assert "clerk" not in ops.deidentify(survey, "clerk", "drop").columns


def test_one_partition_or_many(survey):
    steps = [Step(op, params) for op, (params, before) in CASES.items() if not before and op not in ("drop_column", "rename_column")]
    recipe = Recipe.learn(survey, steps)
    one, many = recipe.apply(survey.coalesce(1)), recipe.apply(survey.repartition(8))
    assert sorted(map(str, one.collect())) == sorted(map(str, many.collect()))


def test_exported_script_does_what_the_recipe_did(survey, tmp_path):
    """All operators in one script, run by another process that sees only pyspark."""
    raw = tmp_path / "raw.parquet"
    survey.write.parquet(str(raw))
    calls, outputs = [], {}
    for op, (params, before) in CASES.items():
        recipe = Recipe.learn(survey, [*before, Step(op, params, f"because of {op}")], source=str(raw))
        outputs[op] = recipe.apply(survey)
        script = to_script(recipe, f"spark.read.parquet({str(raw)!r})", f"df.write.parquet({str(tmp_path / op)!r})")
        assert "gritsieve" not in script
        calls.append(script.replace("SparkSession.builder.getOrCreate()", "SparkSession.builder.config('spark.ui.enabled', 'false').getOrCreate()"))
    path = tmp_path / "clean.py"
    # Later sections repeat the helper definitions, so one process can run every exported script.
    path.write_text("\n\n".join(calls))
    done = subprocess.run([sys.executable, str(path)], cwd=tmp_path, capture_output=True, text=True, timeout=300)
    assert done.returncode == 0, done.stderr[-3000:]
    for op, want in outputs.items():
        got = survey.sparkSession.read.parquet(str(tmp_path / op))
        assert got.columns == want.columns, op
        assert sorted(map(str, got.collect())) == sorted(map(str, want.collect())), op


def test_ledger_counts(survey):
    twice = survey.union(survey.filter(f"{ROW_ID} < 2").withColumn(ROW_ID, F.col(ROW_ID) + 10))
    recipe = Recipe.learn(twice, [
        Step("recode_sentinel_missing", {"column": "qty", "values": [9999]}, "codes"),
        Step("strip_whitespace", {"column": "colour"}),
        Step("order_likert", {"column": "grade", "order": ["poor", "good"]}),
        Step("drop_duplicates", {}),
        Step("coerce_datetime", {"column": "sent"}),
        Step("fill_missing", {"column": "price", "method": "median"}),
        Step("deidentify", {"column": "clerk", "method": "drop"}),
    ])
    ledger = recipe.ledger(twice)
    got = {r["seq"]: r for r in ledger.collect()}
    assert [got[i]["rows_affected"] for i in range(1, 8)] == [3, 2, 4, 2, 6, 1, 6]
    assert [got[i]["rows_before"] for i in range(1, 8)] == [8, 8, 8, 8, 6, 6, 6]
    assert got[4]["rows_after"] == 6 and got[7]["cols_after"] == got[7]["cols_before"] - 1
    assert '"became_blank": 3' in got[3]["stats"]
    assert ledger_table(ledger).filter("seq = 1").first()["why"] == "codes"
    assert '"source": "raw"' in recipe.to_json(ledger)


def test_unknown_operators_and_undo(survey):
    with pytest.raises(KeyError):
        run_step(survey, Step("no_such_step", {"x": 1}))
    with pytest.raises(KeyError):
        Recipe.learn(survey, [Step("no_such_step")])
    recipe = Recipe("raw").with_step(survey, Step("promote_header_row", {"drop_rows": 2}))
    assert recipe.apply(survey).count() == 4
    assert recipe.undo().apply(survey).count() == 6 and not recipe.undo().steps


def test_one_equality_for_counting_and_dropping(frame):
    from gritsieve.operators.evidence import duplicate_rows

    df = frame({"v": ("double", [float("nan"), N, 0.0, -0.0, 1.0]), "w": ("string", ["a"] * 5)})
    assert duplicate_rows(df).first()["n_duplicates"] == 2
    got = rows(ops.drop_duplicates(df), ROW_ID, "v")
    assert [i for i, _ in got] == [0, 2, 4] and got[0][1] is None


def test_loaded_files_are_deduplicated_by_hash(spark, tmp_path):
    from gritsieve.sources.readers import load

    (tmp_path / "t.csv").write_text("a,b\n1,x\n1,x\n2,y\n")
    out = ops.drop_duplicates(load(spark, str(tmp_path / "t.csv")).df)
    assert out.count() == 2
    assert "SortAggregate" not in out._jdf.queryExecution().executedPlan().toString()


def test_header_rows_of_a_very_wide_table(spark):
    from gritsieve.operators.evidence import Evidence

    wide = spark.range(3).select(F.col("id").alias(ROW_ID), *[
        F.when(F.col("id") == 1, F.lit(f"c{i}")).otherwise(F.col("id").cast("string")).alias(f"c{i}") for i in range(1000)
    ])
    assert ops.drop_repeated_header_rows(wide).count() == 2
    assert Evidence(wide).header_rows == 1
