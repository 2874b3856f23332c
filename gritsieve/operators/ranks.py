"""Ranks, running sums and lookups over whole tables in which one key may hold a large share of the rows."""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import Column, DataFrame, Window as W, functions as F

from gritsieve.sources.scratch import write_once

#: A key with more than one in SHARES of the rows is hot; there are fewer than SHARES such keys, whatever the table.
SHARES = 1000
#: `monotonically_increasing_id` keeps the partition above this bit and the place below it.
_PLACE_BITS = 33


def placed(
    df: DataFrame,
    keys: Sequence[str],
    order: Sequence[Column],
    rank: str | None = None,
    sums: dict[str, Column] | None = None,
    deal: Sequence[Column] | None = None,
    drop: Sequence[str] = (),
) -> DataFrame:
    """`df` with the place of each row within its keys (from 1) and running sums up to and with it, in the given order.

    Rows are dealt in ranges of keys and order, sorted, numbered and written; every range counts what it holds of a key,
    and the counts of the ranges before it are added. So a key with most of the rows, or no key at all, is worked on by
    as many tasks as any other. `deal` may name coarser expressions in the same order as `order`, for ranges only (order
    columns may be long texts); columns in `drop` serve the order and are left out. Sums must be of whole numbers.
    """
    sums = sums or {}
    taken = {c.lower() for c in df.columns}
    at, part, start, ahead = (_free(taken, n) for n in ("_at", "_part", "_start", "_ahead"))
    by = [F.col(f"`{k}`") for k in keys]
    own = {name: _free(taken, f"_own_{i}") for i, name in enumerate(sums)}
    before = {name: _free(taken, f"_before_{i}") for i, name in enumerate(sums)}
    rows = df.withColumns({own[n]: c for n, c in sums.items()}) if sums else df
    ranges = rows.repartitionByRange(*by, *(order if deal is None else deal)).sortWithinPartitions(*by, *order)
    numbered = write_once(ranges.drop(*drop).withColumn(at, F.monotonically_increasing_id()), "placed")
    numbered = numbered.withColumn(part, F.shiftright(at, _PLACE_BITS))
    spans = numbered.groupBy(*by, part).agg(
        F.min(at).alias(start), F.count(F.lit(1)).alias(ahead), *(F.sum(own[n]).alias(before[n]) for n in sums)
    )
    earlier = W.partitionBy(*by).orderBy(part).rowsBetween(W.unboundedPreceding, -1)
    spans = spans.withColumns({c: F.coalesce(F.sum(c).over(earlier), F.lit(0)) for c in (ahead, *before.values())})
    right = spans.select(*(F.col(f"`{k}`").alias(f"_k{i}") for i, k in enumerate(keys)), F.col(part).alias("_p"), start, ahead, *before.values())
    out = numbered
    if sums:
        within = W.partitionBy(*by, part).orderBy(at).rowsBetween(W.unboundedPreceding, W.currentRow)
        out = out.withColumns({own[n]: F.sum(own[n]).over(within) for n in sums})
    same = F.col(part) == F.col("_p")
    for i, k in enumerate(keys):
        same = same & F.col(f"`{k}`").eqNullSafe(F.col(f"_k{i}"))
    out = out.join(right, same)
    added = [(F.col(ahead) + F.col(at) - F.col(start) + 1).alias(rank)] if rank else []
    added += [(F.col(own[n]) + F.col(before[n])).alias(n) for n in sums]
    return out.select(*(f"`{c}`" for c in df.columns if c not in drop), *added)


def _free(taken: set[str], name: str) -> str:
    while name.lower() in taken:
        name += "_"
    taken.add(name.lower())
    return name


def lookup(
    rows: DataFrame, table: DataFrame, keys: Sequence[str], how: str = "left", shares: int = SHARES, times: str | None = None
) -> DataFrame:
    """`rows` joined with a table that has each key once. `rows` is read twice and should be stored; keys are not null.

    Keys with more than one in `shares` of the rows, of which there are fewer than `shares`, meet their entry by
    broadcast where they lie; the others are shuffled, and no task gets more than such a share of one key. `times` names a
    column of `table` that tells how many of the rows have the key, if it is known; else they are counted.
    """
    total = rows.count()
    if times:
        hot = write_once(table.where(F.col(times) * shares > total).select(*keys), "hot-keys")
    else:
        counts = rows.groupBy(*keys).agg(F.count(F.lit(1)).alias("_times"))
        hot = write_once(counts.where(F.col("_times") * shares > total).select(*keys), "hot-keys")
    found = write_once(hot.join(table, list(keys)), "hot-rows")
    left = rows.join(F.broadcast(hot), list(keys), "left_anti")
    at_once = rows.join(F.broadcast(hot), list(keys), "left_semi").join(F.broadcast(found), list(keys), how)
    return at_once.unionByName(left.join(table, list(keys), how))
