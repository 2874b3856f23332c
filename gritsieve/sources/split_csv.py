"""Delimited files whose cells may hold line breaks, read in splits: each split reports where it leaves quotes open."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, SparkSession, Window as W, functions as F

#: Whether a place in a line is outside a quoted cell, inside one, or behind a quote that may have closed it.
OUT, IN, CLOSED = 0, 1, 2

_SPLIT = ["_file", "_start"]


def physical_lines(spark: SparkSession, path: str) -> DataFrame:
    """(_file, _start, _n, _line): every line with its file, the byte at which its split begins, and its place there."""
    nth = F.monotonically_increasing_id().bitwiseAND(F.lit((1 << 33) - 1))
    lines = spark.read.option("lineSep", "\n").text(path).select(
        F.col("_metadata.file_path").alias("_file"), F.col("_metadata.file_block_start").alias("_start"), nth.alias("_n"), "value"
    )
    first = (F.col("_start") == 0) & (F.col("_n") == 0)
    return lines.select(*_SPLIT, "_n", F.when(first, F.ltrim(F.col("value"), F.lit("﻿"))).otherwise(F.col("value")).alias("_line"))


def left_open(line: Column, sep: str, start: int) -> Column:
    """Whether a line that starts outside (OUT) or inside (IN) a quoted cell ends inside one: 1 or 0.

    A quote opens a cell only where the cell begins; two in a row inside one stand for a quote; what follows a closed
    quote up to the separator is taken as it is.
    """
    parts = F.split(line, '"', -1)
    # What lies before each quote; an empty beginning of the line is the beginning of a cell.
    before = F.transform(
        F.slice(parts, F.lit(1), F.size(parts) - 1), lambda p, i: F.when((i == 0) & (p == ""), F.lit(sep)).otherwise(p)
    )

    def step(state: Column, p: Column) -> Column:
        opens = p.endswith(sep)
        return (
            F.when(state == IN, CLOSED)
            .when((state == CLOSED) & (p == ""), IN)
            .when(opens, IN)
            .otherwise(OUT)
        )

    ends = F.aggregate(before, F.lit(start), step) == IN
    return F.when(line.contains('"'), ends.cast("int")).otherwise(start)


def _before(order, value: Column) -> Column:
    """The state before each row: the last fixed one, turned over by every swap since; from outside without any."""
    earlier = order.rowsBetween(W.unboundedPreceding, -1)
    upto = order.rowsBetween(W.unboundedPreceding, W.currentRow)
    swaps = F.sum(F.col("_swap"))
    fixed = F.last(F.when(F.col("_fixed"), F.struct(F.col("_from_out").alias("v"), F.col("_sum").alias("s"))), ignorenulls=True)
    return value.withColumn("_sum", swaps.over(upto)).withColumn("_last", fixed.over(earlier)).withColumn(
        "_swaps", F.coalesce(swaps.over(earlier), F.lit(0)))


def _steps(df: DataFrame) -> DataFrame:
    """What a line or a split does to the state: fixes it, whatever it was, or swaps it."""
    return df.withColumn("_fixed", F.col("_from_out") == F.col("_from_in")).withColumn(
        "_swap", ((F.col("_from_out") == 1) & (F.col("_from_in") == 0)).cast("long"))


def _state(start: Column) -> Column:
    """From the columns of `_before`: the state, if what comes first starts in `start`."""
    turned = lambda v, n: F.pmod(v + n, F.lit(2)).cast("int")
    return F.when(F.col("_last").isNotNull(), turned(F.col("_last.v"), F.col("_swaps") - F.col("_last.s"))).otherwise(
        turned(start, F.col("_swaps")))


def split_states(lines: DataFrame) -> DataFrame:
    """(_file, _start, _state, _open): for every split whether it begins inside a quoted cell, and then the place
    (split, line) of the line that opened it.

    `lines` has what each line makes of either start. Only lines that change the state are ordered, split by split; then
    one row per split is, file by file.
    """
    splits = lines.groupBy(*_SPLIT).agg(F.max(F.col("_from_out") != 0).alias("_any"), F.max(F.col("_from_in") != 1).alias("_any_in"))
    changing = _steps(lines.where("_from_out <> 0 or _from_in <> 1").select(*_SPLIT, "_n", "_from_out", "_from_in"))
    in_split = W.partitionBy(*_SPLIT).orderBy("_n")
    changing = _before(in_split, changing)
    after = lambda s: F.when(s == 0, F.col("_from_out")).otherwise(F.col("_from_in"))
    ends = changing.select(*_SPLIT, "_n", *(after(_state(F.lit(s))).alias(f"_end_{s}") for s in (0, 1)))
    of_split = ends.groupBy(*_SPLIT).agg(*(F.max_by(f"_end_{s}", "_n").alias(n) for s, n in enumerate(("_from_out", "_from_in"))))
    whole = splits.select(*_SPLIT).join(of_split, _SPLIT, "left").select(
        *_SPLIT, F.coalesce("_from_out", F.lit(0)).alias("_from_out"), F.coalesce("_from_in", F.lit(1)).alias("_from_in"))
    in_file = W.partitionBy("_file").orderBy("_start")
    known = _before(in_file, _steps(whole)).select(*_SPLIT, _state(F.lit(0)).alias("_state"))
    opening = changing.join(known, _SPLIT).where((_state(F.col("_state")) == 0) & (F.col("_from_out") == 1))
    last = opening.groupBy(*_SPLIT).agg(F.max("_n").alias("_n")).select(*_SPLIT, F.struct("_start", "_n").alias("_opener"))
    earlier = in_file.rowsBetween(W.unboundedPreceding, -1)
    return known.join(last, _SPLIT, "left").withColumn("_open", F.last("_opener", ignorenulls=True).over(earlier)).drop("_opener")


def records(lines: DataFrame, states: DataFrame) -> DataFrame:
    """(_file, _start, _n, _record): the text of every record with the place of its first line.

    One shuffle by split gives each line its state. Records of one line, nearly all as a rule, are done then; the lines
    of the others meet by the place of the line that opened them, and no task gets more than a record of them at a time.
    """
    order = W.partitionBy(*_SPLIT).orderBy("_n")
    known = _before(order, _steps(lines.join(states, _SPLIT)))
    known = known.withColumn("_here", _state(F.col("_state")))
    after = F.when(F.col("_here") == 0, F.col("_from_out")).otherwise(F.col("_from_in"))
    known = known.withColumn("_then", after)
    opens = (F.col("_here") == 0) & (F.col("_then") == 1)
    opener = F.last(F.when(opens, F.struct("_start", "_n")), ignorenulls=True).over(order.rowsBetween(W.unboundedPreceding, W.currentRow))
    known = known.select(*_SPLIT, "_n", "_line", "_here", "_then", F.coalesce(opener, "_open").alias("_opener"))
    single = known.where("_here = 0 and _then = 0").select(*_SPLIT, "_n", F.col("_line").alias("_record"))
    parts = known.where("_here = 1 or _then = 1").groupBy("_file", "_opener").agg(
        F.array_sort(F.collect_list(F.struct("_start", "_n", "_line"))).alias("_parts"))
    text = F.array_join(F.transform("_parts", lambda p: p["_line"]), "\n")
    several = parts.select("_file", "_opener._start", "_opener._n", text.alias("_record"))
    bare = F.rtrim(F.col("_record"), F.lit("\r"))
    return single.unionByName(several).withColumn("_record", bare).where(F.col("_record") != "")


def line_effects(spark: SparkSession, path: str, sep: str) -> DataFrame:
    """`physical_lines` with `_from_out` and `_from_in`: whether the line ends inside quotes, from either start."""
    lines = physical_lines(spark, path)
    return lines.select("*", left_open(F.col("_line"), sep, OUT).alias("_from_out"), left_open(F.col("_line"), sep, IN).alias("_from_in"))
