"""Chart data as aggregates, and suggestions of what to chart."""

from __future__ import annotations

import json

from pyspark.sql import DataFrame, Window as W, functions as F

from gritsieve.constants import MIN_CHART_ROWS
from gritsieve.describe.roles import Roles, collapsed_members
from gritsieve.describe.rules import Rule, suggested
from gritsieve.functions.cells import ORDINAL, named
from gritsieve.operators.cleaning import how_many
from gritsieve.operators.evidence import Evidence, with_evidence
from gritsieve.operators.profile import missing_counts
from gritsieve.operators.quantiles import exact_quantiles
from gritsieve.operators.ranks import lookup, placed
from gritsieve.relations import as_text, cell, data_columns, local_relation
from gritsieve.sources.scratch import write_once


def value_counts(df: DataFrame, column: str) -> DataFrame:
    """(value, n) of the non-blank cells."""
    return (
        df.select(as_text(df, column).alias("value")).filter(F.col("value").isNotNull())
        .groupBy("value").agg(F.count(F.lit(1)).alias("n"))
    )


def histogram(df: DataFrame, column: str) -> DataFrame:
    """Equal-width bins over the whole finite range: as many as different values, between 5 and 20.

    Infinite values have rows of their own, bin -1 and the one after the last, if there are any.
    """
    value = cell(df, column).cast("double")
    every = df.select(value.alias("v")).filter(F.col("v").isNotNull())
    infinite = F.col("v").isin(float("inf"), float("-inf"))
    cells = every.filter(~infinite)
    span = every.agg(
        F.min(F.when(~infinite, F.col("v"))).alias("low"), F.max(F.when(~infinite, F.col("v"))).alias("high"),
        F.count_if(F.col("v") == float("inf")).alias("above"), F.count_if(F.col("v") == float("-inf")).alias("below"),
    ).first()
    frame = []
    if span["low"] is not None:
        # Whether there are 20 different values is known as soon as 20 are found.
        bins = max(5, cells.distinct().limit(20).count())
        low, high = (span["low"], span["high"]) if span["low"] < span["high"] else (span["low"] - 0.5, span["high"] + 0.5)
        width = (high - low) / bins
        edges = [low + i * width for i in range(bins)] + [high]
        frame = [{"bin": i, "low": edges[i], "high": edges[i + 1], "known": None} for i in range(bins)]
        at = how_many([F.col("v") >= F.lit(e) for e in edges[1:-1]])
    else:
        at = F.lit(0)
    for bin_, n, value_ in ((-1, span["below"], float("-inf")), (len(frame), span["above"], float("inf"))):
        if n:
            frame.append({"bin": bin_, "low": value_, "high": value_, "known": n})
    counts = cells.groupBy(at.alias("bin")).agg(F.count(F.lit(1)).alias("n"))
    bounds = local_relation(df.sparkSession, frame, "bin int, low double, high double, known bigint")
    return bounds.join(counts, "bin", "left").select("bin", "low", "high", F.coalesce("known", "n", F.lit(0)).alias("n"))


def likert_bar(df: DataFrame, column: str) -> DataFrame:
    """Counts in scale order, levels without answers included when the column still knows its levels."""
    levels = df.schema[column].metadata.get("levels", [])
    counts = (
        df.filter(named(column).isNotNull())
        .groupBy(named(column + ORDINAL).alias("place"), named(column).alias("label"))
        .agg(F.count(F.lit(1)).alias("n"))
    )
    if not levels:
        return counts
    frame = local_relation(
        df.sparkSession, [{"place": i, "label": level} for i, level in enumerate(levels, 1)], "place int, label string"
    )
    return frame.join(counts.drop("label"), "place", "left").select("place", "label", F.coalesce("n", F.lit(0)).alias("n"))


def category_bar(df: DataFrame, column: str) -> DataFrame:
    """Every category with its count and its place by count; a chart shows as many places as it has room for."""
    return placed(value_counts(df, column), [], [F.desc("n"), F.col("value")], rank="place")


def timeseries(df: DataFrame, column: str) -> DataFrame:
    """Rows per calendar day; days without rows between the first and the last count zero."""
    day = named(column).cast("date")
    counts = df.select(day.alias("day")).filter("day is not null").groupBy("day").agg(F.count(F.lit(1)).alias("n"))
    # Counts are one row a day, so the calendar comes from them and not from another look at the table.
    ahead = F.coalesce(F.lead("day").over(W.orderBy("day")), F.date_add("day", 1))
    return (
        counts.withColumn("until", F.date_sub(ahead, 1))
        .select(F.explode(F.sequence("day", "until")).alias("d"), "day", "n")
        .select(F.col("d").alias("day"), F.when(F.col("d") == F.col("day"), F.col("n")).otherwise(F.lit(0)).alias("n"))
    )


def grouped_bar(df: DataFrame, group: str, scale: str) -> DataFrame:
    """Row percentages of a cross table in long form: the pairs that occur, none made up for those that do not."""
    counts = (
        df.select(as_text(df, group).alias("group"), as_text(df, scale).alias("level")).dropna()
        .groupBy("group", "level").agg(F.count(F.lit(1)).alias("n"))
    )
    return counts.withColumn("pct", F.col("n") / F.sum("n").over(W.partitionBy("group")) * 100)


def box_by_group(df: DataFrame, group: str, value: str) -> DataFrame:
    """Quartiles, whiskers at the last value within 1.5 IQR, and the number of points beyond."""
    known = df.filter(named(group).isNotNull())
    number_ = cell(df, value).cast("double")
    quartiles = write_once(exact_quantiles(known, number_, [0.25, 0.5, 0.75], by=[group]).select(
        as_text(df, group).alias("group"), "n",
        F.col("q")[0].alias("q1"), F.col("q")[1].alias("median"), F.col("q")[2].alias("q3"),
    ), "quartiles")
    reach = 1.5 * (F.col("q3") - F.col("q1"))
    inside = F.col("v").between(F.col("q1") - reach, F.col("q3") + reach)
    cells = known.select(as_text(df, group).alias("group"), number_.alias("v")).filter("v is not null")
    spread = lookup(cells, quartiles.select("group", "q1", "q3"), ["group"], "inner").groupBy("group").agg(
        F.min(F.when(inside, F.col("v"))).alias("low"), F.max(F.when(inside, F.col("v"))).alias("high"),
        F.count_if(~inside).alias("n_beyond"),
    )
    return quartiles.join(spread, "group").select(
        "group", "n", "q1", "median", "q3",
        F.least("low", "q1").alias("whisker_low"), F.greatest("high", "q3").alias("whisker_high"), "n_beyond",
    )


def scatter(df: DataFrame, x: str, y: str) -> DataFrame:
    """Every pair with both values."""
    return df.select(cell(df, x).alias("x"), cell(df, y).alias("y")).dropna()


def missingness(df: DataFrame, columns: list[str] | None = None) -> DataFrame:
    """Per cent blank per column; the 20 to 60 band is where a decision is needed."""
    members = collapsed_members(data_columns(df))
    columns = columns or [c for c in data_columns(df) if c not in members]
    rows, missing = missing_counts(df.select(*[named(c) for c in columns]))
    shares = [{"column": c, "pct": missing[c] / rows * 100 if rows else 0.0} for c in columns]
    return local_relation(df.sparkSession, shares, "column string, pct double").select(
        "column", "pct", F.col("pct").between(20, 60).alias("to_decide")
    )


RENDERERS = {
    "histogram": histogram, "likert_bar": likert_bar, "category_bar": category_bar, "timeseries": timeseries,
    "grouped_bar": grouped_bar, "box_by_group": box_by_group, "scatter": scatter,
}


def chart_data(df: DataFrame, kind: str, columns: list[str]) -> DataFrame:
    """The data behind one suggested chart; raises when the table cannot support it."""
    if kind == "missingness":
        return missingness(df, columns)
    if kind not in RENDERERS:
        raise ValueError(f"unknown chart kind: {kind}")
    gone = [c for c in columns if c not in df.columns]
    if gone:
        raise ValueError(f"columns are gone from the table: {gone}")
    data = RENDERERS[kind](df, *columns)
    if data.isEmpty():
        raise ValueError(f"{columns} have no values left to plot")
    return data


#: What each chart is for. Scores are fixed values.
CHARTS = [
    Rule("likert_bar", 0.95, "ordered", "{1}, level by level", "The levels have an order that other charts would lose."),
    Rule("grouped_bar", 0.92, "grouping", "Levels of {2} within each {1}", "Per cent of the group, so large and small groups compare.", two="ordered"),
    Rule("category_bar", 0.80, "categorical", "How often each {1} occurs", "Shows which categories are too small to compare."),
    Rule("histogram", 0.78, "numeric", "How {1} is spread", "Shows limits, heaps and values apart from the rest."),
    Rule("box_by_group", 0.74, "grouping", "Spread of {2} in each {1}", "Medians and quartiles stay put when single values are extreme.", two="numeric"),
    Rule("timeseries", 0.70, "datetime", "Rows per day of {1}", "Days without rows and sudden peaks stand out."),
    Rule("scatter", 0.66, "numeric", "{1} against {2}", "Every pair of values, for a relation of any shape.", two="numeric"),
]
BLANKS = Rule("missingness", 0.62, "table", "Blank cells of every column", "Between a fifth and three fifths blank, someone has to decide.")
GROUPING_LEVELS = 8


@with_evidence
def suggest_charts(df: DataFrame, ev: Evidence | None = None) -> DataFrame:
    """All charts the columns' roles allow, best first: place, kind, title, columns (a JSON list), score, rationale."""
    roles, spark = Roles(df, ev), df.sparkSession
    slots: dict[str, list[str]] = {}
    if ev.n_rows >= MIN_CHART_ROWS:
        filled = [r["column"] for r in ev.rows if r["present"]]
        slots = {role: [c for c in roles.of(role) if c in filled] for role in ("ordered", "numeric", "categorical", "datetime")}
        slots["grouping"] = roles.few(slots["categorical"], 0, GROUPING_LEVELS)
        if any(r["present"] < r["n_rows"] for r in ev.rows):
            slots["table"] = [""]
    gone = collapsed_members(ev.columns)
    shown = F.lit(json.dumps([c for c in ev.columns if c not in gone], ensure_ascii=False))
    found = suggested(spark, [*CHARTS, BLANKS], slots)
    return found.select(
        "place", "kind", F.col("text").alias("title"),
        F.when(F.col("kind") == BLANKS.kind, shown).otherwise(F.col("columns")).alias("columns"), "score",
        F.col("why").alias("rationale"),
    )
