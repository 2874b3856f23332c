import itertools
import random

from pyspark.sql import functions as F

from gritsieve.operators.ranks import lookup, placed


def test_places_and_sums_of_a_hot_key(spark):
    rng = random.Random(3)
    data = [(1 if rng.random() < 0.6 else rng.choice([None, 2, 3, 4]), rng.randint(0, 50), i) for i in range(5000)]
    df = spark.createDataFrame(data, "k long, v long, i long").repartition(7)
    got = placed(df, ["k"], [F.col("v"), F.col("i")], rank="n", sums={"s": F.col("v")}).collect()
    want = set()
    for k, group in itertools.groupby(sorted(data, key=lambda r: (-1 if r[0] is None else r[0], r[1], r[2])), key=lambda r: r[0]):
        total = 0
        for n, (_, v, i) in enumerate(group, 1):
            total += v
            want.add((k, v, i, n, total))
    assert {tuple(r) for r in got} == want


def test_places_over_everything_need_no_single_task(spark):
    df = spark.range(20_000).select(F.xxhash64("id").alias("v"), F.col("id").alias("_at"))
    out = placed(df, [], [F.col("v").desc()], rank="place")
    assert [r.place for r in out.orderBy(F.col("v").desc()).collect()] == list(range(1, 20_001))
    assert out.columns == ["v", "_at", "place"]


def test_coarse_ranges_and_dropped_columns(spark):
    df = spark.createDataFrame([(i % 3, "x" * (i % 5) + str(i)) for i in range(300)], "k long, text string")
    out = placed(df, ["k"], [F.col("text")], rank="n", deal=[F.substring("text", 1, 2)], drop=["text"])
    assert out.columns == ["k", "n"]
    assert sorted(map(tuple, out.collect())) == sorted((k, n) for k in range(3) for n in range(1, 101))


def test_empty(spark):
    df = spark.createDataFrame([], "k long, v long")
    assert placed(df, ["k"], [F.col("v")], rank="n", sums={"s": F.col("v")}).collect() == []


def test_lookup_sends_hot_keys_by_broadcast(spark):
    rows = spark.range(9000).select("id", F.when(F.col("id") % 3 == 0, 7).otherwise(F.col("id")).alias("k"))
    table = spark.range(0, 9000, 7).select(F.col("id").alias("k"), (F.col("id") * 2).alias("v"))
    for how in ("left", "inner"):
        got = lookup(rows, table, ["k"], how, shares=10)
        want = rows.join(table, "k", how)
        assert sorted(map(str, got.select("id", "k", "v").collect())) == sorted(map(str, want.select("id", "k", "v").collect()))
    assert "BroadcastHashJoin" in got._jdf.queryExecution().executedPlan().toString()
