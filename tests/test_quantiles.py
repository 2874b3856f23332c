import numpy as np
import pytest
from pyspark.sql import functions as F

from gritsieve.operators import quantiles
from gritsieve.operators.quantiles import exact_quantiles, most_frequent

PROBS = [0.0, 0.25, 0.5, 0.75, 0.9, 1.0]


def check(spark, values):
    df = spark.createDataFrame([(g, float(v)) for g, vs in values.items() for v in vs], "g string, v double").repartition(6)
    got = {r["g"]: r for r in exact_quantiles(df, F.col("v"), PROBS, by=["g"]).collect()}
    assert set(got) == set(values)
    for g, vs in values.items():
        assert got[g]["n"] == len(vs)
        assert got[g]["q"] == pytest.approx(list(np.quantile(vs, PROBS)), rel=1e-12, abs=1e-12)
        assert got[g]["mean"] == pytest.approx(float(np.mean(vs)), rel=1e-6, abs=1e-6)


def groups(rng):
    return {
        "one": [7.0], "two": [1.0, 2.0], "same": [3.0] * 500, "ten": list(rng.normal(size=10)),
        "hot": list(rng.lognormal(sigma=3, size=20_000)), "codes": list(rng.integers(0, 5, size=4_000)),
        "outlier": [*rng.normal(size=3_000), 1e9, -1e9],
    }


def test_against_numpy(spark):
    check(spark, groups(np.random.default_rng(1)))


def test_narrowing_against_numpy(spark, monkeypatch):
    """Few digits and few values to a bracket, so that even these small groups are narrowed again and again."""
    monkeypatch.setattr(quantiles, "FEW", 20)
    monkeypatch.setattr(quantiles, "DIGITS", 3)
    check(spark, groups(np.random.default_rng(2)))


def test_no_group_is_hot(spark, monkeypatch):
    monkeypatch.setattr(quantiles, "SHARES", 0)
    check(spark, groups(np.random.default_rng(3)))


def test_infinities_and_tiny_numbers(spark):
    values = [float("inf"), float("-inf"), 5e-324, -5e-324, 0.0, -0.0, 1e308, -1e308, 1.0]
    df = spark.createDataFrame([(v,) for v in values], "v double")
    got = exact_quantiles(df, F.col("v"), [i / 8 for i in range(9)]).first()["q"]
    assert got == sorted(values)


def test_very_many_groups_and_a_hot_one(spark):
    df = spark.range(400_000).select(
        F.when(F.col("id") % 2 == 0, -1).otherwise(F.col("id") % 200_000).alias("g"), (F.col("id") * 7919 % 100_003).alias("v"))
    out = exact_quantiles(df, F.col("v"), [0.25, 0.5], by=["g"])
    want = df.groupBy("g").agg(F.count("v").alias("m"), F.percentile("v", F.array(F.lit(0.25), F.lit(0.5))).alias("p"))
    joined = out.join(want, "g")
    assert joined.count() == 100_001
    assert joined.where("n <> m or abs(q[0] - p[0]) > 1e-9 or abs(q[1] - p[1]) > 1e-9").count() == 0


def test_rows_are_not_shuffled_to_a_join_or_repeated(spark):
    df = spark.range(300_000).select((F.col("id") % 3).alias("g"), F.sqrt("id").alias("v"))
    out = exact_quantiles(df, F.col("v"), [0.25, 0.5, 0.75], by=["g"])
    plan = out._jdf.queryExecution().optimizedPlan().toString()
    assert "Generate" not in plan and "explode" not in plan
    scans = [line for line in out._jdf.queryExecution().executedPlan().toString().splitlines() if "SortMergeJoin" in line and "_g0" in line]
    assert scans == []


def test_blank_groups_and_values(spark):
    df = spark.createDataFrame([(None, 1.0), (None, 3.0), ("a", None), ("b", float("nan")), ("b", 2.0)], "g string, v double")
    got = {r["g"]: r["q"] for r in exact_quantiles(df, F.col("v"), [0.5], by=["g"]).collect()}
    assert got == {None: [2.0], "b": [2.0]}
    assert exact_quantiles(df.filter("v is null"), F.col("v"), [0.5]).collect() == []
    assert exact_quantiles(df, F.col("v"), [0.5], interpolate=False).first()["q"] == [2.0]


def test_most_frequent(spark):
    df = spark.createDataFrame([(v,) for v in [2, 2, 1, 1, 3, None, None, None]], "v int")
    assert tuple(most_frequent(df, F.col("v")).first()) == (1, 2)
