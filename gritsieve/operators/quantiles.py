"""Exact order statistics by radix selection, without gathering a group in one task.

Values are counted by a coarse monotone digit, their order of magnitude; the digits that hold a wanted rank are split into
finer ones, and so on, until few values are left to count one by one. Every count is a map-side aggregate: a group with a
third of all rows, or the whole table, shuffles some thousand counts a task. Groups that are no such share of the table are
counted value by value in one shuffle.
"""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import Column, DataFrame, Row, Window as W, functions as F

from gritsieve.functions.cells import named
from gritsieve.operators.ranks import SHARES
from gritsieve.relations import local_relation
from gritsieve.sources.scratch import write_once

#: Digits a bracket is split into in one pass, and the number of values from which one is split.
DIGITS = 4096
FEW = 100_000

_BRACKET = "hid int, below bigint, n bigint, low double, high double"


def _magnitude(v: Column) -> Column:
    """A whole number that never falls as `v` rises: sign and binary order of magnitude."""
    size = F.when(F.abs(v) == float("inf"), 2000).otherwise(F.floor(F.log2(F.abs(v))))
    return F.when(v == 0, 0).otherwise((F.signum(v) * (size + 1200)).cast("int")).cast("int")


def _same(keys: Sequence[str], other: str) -> Column:
    out = F.lit(True)
    for k in keys:
        out = out & F.col(k).eqNullSafe(F.col(other + k))
    return out


def _ranks(n: Column, probs: list[float]) -> list[Column]:
    """The rank from 0, with its fraction, of each probability among n values."""
    return [F.lit(p) * (n - 1) for p in probs]


def _holds(probs: list[float]) -> Column:
    """Whether one of the wanted ranks of a group of `size` values lies in [from, upto)."""
    whole = [r for rank in _ranks(F.col("size"), probs) for r in (F.floor(rank), F.ceil(rank))]
    return F.exists(F.array(*whole), lambda r: (r >= F.col("from")) & (r < F.col("upto")))


def _with_bounds(counts: DataFrame, part: Sequence[str], order: str, below: Column) -> DataFrame:
    upto = F.sum("n").over(W.partitionBy(*part).orderBy(order).rowsBetween(W.unboundedPreceding, W.currentRow))
    return counts.withColumn("upto", below + upto).withColumn("from", F.col("upto") - F.col("n"))


def _read_off(ranked: DataFrame, keys: Sequence[str], size: Column, probs: list[float], interpolate: bool) -> DataFrame:
    """(keys, q) from (keys, v, from, upto) and the sizes of the groups."""
    at = lambda r: F.max(F.when((F.col("from") <= r) & (r < F.col("upto")), F.col("v")))
    ends = [c for i, r in enumerate(_ranks(size, probs)) for c in (at(F.floor(r)).alias(f"lo{i}"), at(F.ceil(r)).alias(f"hi{i}"))]
    got = ranked.groupBy(*keys, size.alias("n")).agg(*ends)
    share = [r - F.floor(r) for r in _ranks(F.col("n"), probs)]
    # No neighbour is a step away from itself; infinities have no distance.
    between = lambda i: F.when(F.col(f"lo{i}") == F.col(f"hi{i}"), F.col(f"lo{i}")).otherwise(
        F.col(f"lo{i}") + (F.col(f"hi{i}") - F.col(f"lo{i}")) * share[i])
    q = [between(i) if interpolate else F.col(f"lo{i}") for i in range(len(probs))]
    return got.select(*keys, "n", F.array(*q).alias("q"))


def _narrowed(cells: DataFrame, hot: DataFrame, keys: list[str], first: DataFrame, probs: list[float]) -> DataFrame:
    """(hid, v, start, n): the values in the brackets that hold the wanted ranks of the hot groups, with their counts, and how
    many values of the group lie below the bracket.

    Fewer than SHARES groups are hot, so a pass has at most 2 * SHARES * len(probs) brackets.
    """
    spark = cells.sparkSession
    done: list[Row] = []
    waiting = first.collect()

    def in_brackets(brackets: list[Row]) -> DataFrame:
        """(hid, b, v): the rows of the table that lie in one of these; brackets do not overlap."""
        side = local_relation(spark, [r.asDict() for r in brackets], _BRACKET).groupBy("hid").agg(
            F.collect_list(F.struct("below", "low", "high")).alias("bs"))
        side = side.join(hot, "hid").select("hid", "bs", *(F.col(k).alias("_s" + k) for k in keys))
        rows = cells.join(F.broadcast(side), _same(keys, "_s"))
        inside = F.get(F.filter("bs", lambda b: F.col("_v").between(b.low, b.high)), F.lit(0))
        return rows.select("hid", inside.alias("b"), F.col("_v").alias("v")).where("b is not null")

    while True:
        done += [b for b in waiting if b["n"] <= FEW or b["low"] == b["high"]]
        waiting = [b for b in waiting if b["n"] > FEW and b["low"] < b["high"]]
        if not waiting:
            break
        digit = F.least(F.floor((F.col("v") - F.col("b.low")) / (F.col("b.high") - F.col("b.low")) * DIGITS), F.lit(DIGITS - 1))
        counts = in_brackets(waiting).groupBy("hid", F.col("b.below").alias("start"), digit.alias("digit")).agg(
            F.count(F.lit(1)).alias("n"), F.min("v").alias("low"), F.max("v").alias("high"))
        bounded = _with_bounds(counts, ["hid", "start"], "digit", F.col("start")).join(hot.select("hid", "size"), "hid")
        waiting = bounded.where(_holds(probs)).select("hid", F.col("from").alias("below"), "n", "low", "high").collect()
    single = [b for b in done if b["low"] == b["high"]]
    several = [b for b in done if b["low"] < b["high"]]
    known = local_relation(spark, [r.asDict() for r in single], _BRACKET).select("hid", F.col("low").alias("v"), F.col("below").alias("start"), "n")
    if several:
        counted = in_brackets(several).groupBy("hid", F.col("b.below").alias("start"), "v").agg(F.count(F.lit(1)).alias("n"))
        known = known.unionByName(counted.select("hid", "v", "start", "n"))
    return known


def exact_quantiles(
    df: DataFrame, value: Column, probs: list[float], by: Sequence[str] = (), interpolate: bool = True
) -> DataFrame:
    """One row per group: the group columns, `n` and `mean` of the values, and `q`, one entry per probability.

    `interpolate=True` is the linear rule between neighbours; False takes the lower of the two. Blanks and NaN are no
    values; rows with a blank group are a group. The table is scanned some two to five times, and no row of it is joined
    by a shuffle or repeated.
    """
    groups = list(by)
    keys = [f"_g{i}" for i in range(max(1, len(groups)))]
    cells = df.select(
        *([named(g).alias(k) for g, k in zip(groups, keys)] or [F.lit(0).alias("_g0")]), value.cast("double").alias("_v")
    ).filter(F.col("_v").isNotNull() & ~F.isnan("_v"))
    bins = write_once(cells.groupBy(*keys, _magnitude(F.col("_v")).alias("digit")).agg(
        F.count(F.lit(1)).alias("n"), F.sum("_v").alias("sum"), F.min("_v").alias("low"), F.max("_v").alias("high")), "magnitudes")
    sizes = write_once(bins.groupBy(*keys).agg(F.sum("n").alias("size"), (F.sum("sum") / F.sum("n")).alias("mean")), "sizes")
    total = sizes.agg(F.sum("size")).first()[0] or 0
    # Fewer than SHARES rows, whatever the table.
    hot = sizes.where(F.col("size") * SHARES > total)
    hot = write_once(hot.withColumn("hid", F.row_number().over(W.orderBy("size", *keys))), "hot")
    held = hot.agg(F.sum("size")).first()[0] or 0

    parts = []
    if held:
        tagged = bins.join(F.broadcast(hot.select("hid", "size", *(F.col(k).alias("_s" + k) for k in keys))), _same(keys, "_s"))
        first = _with_bounds(tagged, ["hid"], "digit", F.lit(0)).where(_holds(probs)).select("hid", F.col("from").alias("below"), "n", "low", "high")
        known = _narrowed(cells, hot, keys, first, probs)
        ranked = _with_bounds(known, ["hid", "start"], "v", F.col("start")).join(hot.select("hid", "size"), "hid")
        parts.append(hot.join(_read_off(ranked, ["hid"], F.col("size"), probs, interpolate), "hid").select(*keys, "n", "mean", "q"))
    if held < total or not parts:
        rest = cells.join(F.broadcast(hot.select(*(F.col(k).alias("_s" + k) for k in keys))), _same(keys, "_s"), "left_anti")
        counts = rest.groupBy(*keys, F.col("_v").alias("v")).agg(F.count(F.lit(1)).alias("n"), F.sum("_v").alias("sum"))
        ranked = _with_bounds(counts, keys, "v", F.lit(0)).withColumn("size", F.sum("n").over(W.partitionBy(*keys)))
        ranked = ranked.withColumn("mean", F.sum("sum").over(W.partitionBy(*keys)) / F.col("size"))
        parts.append(_read_off(ranked, [*keys, "mean"], F.col("size"), probs, interpolate).select(*keys, "n", "mean", "q"))
    out = parts[0] if len(parts) == 1 else parts[0].unionByName(parts[1])
    return out.select(*(F.col(k).alias(g) for k, g in zip(keys, groups)), "n", "mean", "q")


def most_frequent(df: DataFrame, value: Column) -> DataFrame:
    """The value with the highest count, the smallest of them on a tie; zero or one row."""
    return (
        df.select(value.alias("value")).filter(F.col("value").isNotNull())
        .groupBy("value").agg(F.count(F.lit(1)).alias("n"))
        .orderBy(F.desc("n"), "value").limit(1)
    )
