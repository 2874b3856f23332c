import datetime as dt
import random

from pyspark.sql import functions as F

from gritsieve.operators import profile as module
from gritsieve.operators.evidence import distinct_whole_numbers, exact_distinct
from gritsieve.operators.profile import distinct_and_first, profile


def test_bitmaps_count_whole_numbers(spark):
    rng = random.Random(2)
    rows = [(
        rng.choice([None, -1, 0, 5, -(1 << 63), (1 << 63) - 1, rng.randint(-100, 100)]), rng.choice([1, 2, 3]),
        dt.date(1960, 1, 1) + dt.timedelta(days=rng.randint(0, 40_000)), rng.choice([True, None]),
        dt.datetime(2020, 1, 1) + dt.timedelta(microseconds=rng.randint(0, 300)), None,
    ) for _ in range(5000)]
    df = spark.createDataFrame(rows, "a bigint, b tinyint, c date, d boolean, e timestamp, f int").repartition(5)
    want = {c: len({r[i] for r in rows} - {None}) for i, c in enumerate("abcde")}
    assert {r["column"]: r["n_unique"] for r in distinct_whole_numbers(df, list("abcdef")).collect()} == want


def test_cells_of_whole_numbers_are_not_shuffled(spark):
    df = spark.range(100_000).select("id", (F.col("id") % 1000).cast("int").alias("k"), F.col("id").cast("string").alias("t"))
    out = exact_distinct(df, ["id", "k", "t"])
    assert {r["column"]: r["n_unique"] for r in out.collect()} == {"id": 100_000, "k": 1000, "t": 100_000}
    words = distinct_whole_numbers(df, ["id", "k"])
    plan = words._jdf.queryExecution().executedPlan().toString()
    assert "bit_or" in plan and "string" not in plan.lower().split("exchange")[-1]


def test_first_values_beyond_the_top_rows(spark, frame, monkeypatch):
    monkeypatch.setattr(module, "LOOK", 10)
    df = frame({
        "run": ("int", [1] * 50 + [None] * 20 + [2] * 20 + [3] * 10), "id": ("bigint", list(range(100))),
        "late": ("string", [None] * 90 + ["b", "a", "b", "x" * 100, "a", None, "c", "d", "e", "f"]), "none": ("int", [None] * 100),
        "two": ("double", [0.5, 1.5] * 50),
    }, partitions=7)
    got = {r["column"]: (r["n_unique"], r["sample"]) for r in distinct_and_first(df, ["run", "id", "late", "none", "two"], 5).collect()}
    assert got == {
        "run": (3, ["1", "2", "3"]), "id": (100, ["0", "1", "2", "3", "4"]), "late": (7, ["b", "a", "x" * 100, "c", "d"]),
        "two": (2, ["0.5", "1.5"]),
    }
    assert {r["column"]: len(r["sample"]) for r in profile(df).collect()}["none"] == 0


def test_schema_summary_says_what_it_leaves_out(frame):
    df = frame({"few": ("string", ["a", "b"] * 50), "many": ("string", [f"v{i}" for i in range(100)]), "n": ("int", list(range(100)))})
    got = {r["column"]: (r["levels"], r["more_values"]) for r in module.schema_summary(df).collect()}
    assert got == {"few": (["a", "b"], False), "many": (None, True), "n": (None, False)}
