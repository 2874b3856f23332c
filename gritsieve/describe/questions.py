"""Questions the cleaned table can answer, each with the aggregate that answers it."""

from __future__ import annotations

from pyspark.sql import DataFrame, functions as F

from gritsieve import constants as K
from gritsieve.describe.charts import grouped_bar
from gritsieve.describe.findings import as_number
from gritsieve.describe.roles import Roles, pick
from gritsieve.describe.rules import Rule, suggested
from gritsieve.functions.cells import ORDINAL, named
from gritsieve.operators.evidence import Evidence, with_evidence
from gritsieve.operators.quantiles import exact_quantiles
from gritsieve.relations import as_text


# The answers


def shares_by_group(df: DataFrame, group: str, outcome: str) -> DataFrame:
    return grouped_bar(df, group, outcome)


def records_by_value(df: DataFrame, column: str) -> DataFrame:
    """Records per value, blanks included as NULL."""
    return df.groupBy(as_text(df, column).alias("value")).agg(F.count(F.lit(1)).alias("records"))


def known_records_by_value(df: DataFrame, column: str) -> DataFrame:
    return records_by_value(df, column).filter("value is not null")


def mean_median_by_group(df: DataFrame, value: str, group: str) -> DataFrame:
    known = df.filter(named(group).isNotNull())
    return exact_quantiles(known, as_number(df, value), [0.5], by=[group]).select(
        as_text(df, group).alias("group"), "n", "mean", F.col("q")[0].alias("median")
    )


def median_by_group(df: DataFrame, value: str, group: str) -> DataFrame:
    return mean_median_by_group(df, value, group).drop("mean")


def median_level(df: DataFrame, scale: str, group: str | None = None) -> DataFrame:
    """Median answer on an ordered scale, overall (group NULL) and per group: the lower middle level.

    Counts per level come first, so the medians are read from a few rows per group.
    """
    keys = [named(group).alias("group")] if group else [F.lit(None).cast("string").alias("group")]
    counts = (
        df.filter(named(scale).isNotNull())
        .groupBy(*keys, named(scale + ORDINAL).alias("place"), named(scale).alias("label"))
        .agg(F.count(F.lit(1)).alias("n"))
    )
    per_group = counts.groupBy("group").agg(F.array_sort(F.collect_list(F.struct("place", "label", "n"))).alias("levels"))
    if group:
        per_group = per_group.filter("`group` is not null").withColumn("overall", F.lit(False))
        whole = counts.groupBy("place", "label").agg(F.sum("n").alias("n")).agg(
            F.array_sort(F.collect_list(F.struct("place", "label", "n"))).alias("levels")
        ).select(F.lit(None).cast("string").alias("group"), "levels", F.lit(True).alias("overall"))
        per_group = per_group.unionByName(whole)
    else:
        per_group = per_group.withColumn("overall", F.lit(True))
    total = F.aggregate("levels", F.lit(0).cast("bigint"), lambda acc, l: acc + l["n"])
    upto = lambda place: F.aggregate(
        F.filter("levels", lambda l: l["place"] <= place), F.lit(0).cast("bigint"), lambda acc, l: acc + l["n"]
    )
    middle = F.filter("levels", lambda l: upto(l["place"]) * 2 >= F.col("total"))[0]
    return per_group.withColumn("total", total).withColumn("middle", middle).select(
        "overall", "group", F.col("total").alias("n"), F.col("middle.place").alias("place"), F.col("middle.label").alias("label")
    )


def spread(df: DataFrame, value: str) -> DataFrame:
    """Minimum, quartiles and maximum."""
    q = exact_quantiles(df, as_number(df, value), [0.0, 0.25, 0.5, 0.75, 1.0])
    names = ["minimum", "q1", "median", "q3", "maximum"]
    return q.select("n", *[F.col("q")[i].alias(name) for i, name in enumerate(names)])


def records_by_month(df: DataFrame, moment: str, group: str) -> DataFrame:
    month = F.trunc(named(moment).cast("date"), "month")
    return (
        df.filter(named(moment).isNotNull() & named(group).isNotNull())
        .groupBy(month.alias("month"), as_text(df, group).alias("group")).agg(F.count(F.lit(1)).alias("records"))
    )


ANSWERS = {
    "shares_by_group": shares_by_group, "records_by_value": records_by_value,
    "known_records_by_value": known_records_by_value, "median_by_group": median_by_group,
    "median_level": median_level, "mean_median_by_group": mean_median_by_group, "spread": spread,
    "records_by_month": records_by_month,
}


def answer(df: DataFrame, template: str, columns: list[str]) -> DataFrame:
    """Run the aggregate behind a suggested question."""
    return ANSWERS[template](df, *columns)


# The questions. Scores are fixed values.
ASKED = [
    Rule("shares_by_group", 1.0, "exposure", "How does {2} differ between the groups of {1}?",
         "This comparison is what such a table is collected for.", two="outcome", category="headline"),
    Rule("records_by_value", 0.95, "outcome", "How often does each {1} occur, and how often is it blank?",
         "Where many are blank, the known ones may not stand for the rest.", category="sanity"),
    Rule("shares_by_group", 0.9, "background", "Does {2} go with {1}?",
         "A difference here may explain one elsewhere.", two="outcome", category="comparison"),
    Rule("median_by_group", 0.85, "cost", "What is the middle {1} for each {2}?",
         "A few very large amounts would carry a mean away.", two="split", category="headline"),
    Rule("median_level", 0.8, "ordered", "Which level of {1} is the middle one, overall and for each {2}?",
         "Levels can be ranked, but not added up.", two="few", category="comparison"),
    Rule("mean_median_by_group", 0.75, "measure", "How far apart are mean and median of {1} for each {2}?",
         "If they differ much, the median is the one to report.", two="few", category="comparison"),
    Rule("spread", 0.7, "measure", "Between which limits does {1} lie, and where are its quartiles?",
         "Limits that cannot be real point to codes that were left in.", category="sanity"),
    Rule("records_by_month", 0.7, "datetime", "How many rows has each month, for each {2}?",
         "Months that are missing or crowded change what other results mean.", two="few", category="sanity"),
    Rule("known_records_by_value", 0.6, "few", "How many rows has each {1}?",
         "Small categories are not worth comparing.", category="explore"),
]


@with_evidence
def suggest_questions(df: DataFrame, ev: Evidence | None = None) -> DataFrame:
    """All questions the roles allow, best first; nothing below ten rows. `template` names the aggregate that answers."""
    roles, spark = Roles(df, ev), df.sparkSession
    slots: dict[str, list[str]] = {}
    if ev.n_rows >= K.MIN_QUESTION_ROWS:
        few, numeric = roles.few(roles.of("categorical"), 2, 12), roles.of("numeric")
        outcome, cost = pick(few, K.QUESTION_OUTCOME_WORDS), pick(numeric, K.COST_WORDS)
        exposure = pick([c for c in few if c != outcome], K.EXPOSURE_WORDS)
        slots = {
            "few": few, "ordered": roles.of("ordered"), "datetime": roles.of("datetime"),
            "outcome": [outcome] if outcome else [], "exposure": [exposure] if exposure else [],
            "background": [c for c in few if c not in (outcome, exposure)], "cost": [cost] if cost else [],
            "split": [exposure] if exposure else few, "measure": [c for c in numeric if c != cost],
        }
    return suggested(spark, ASKED, slots).select(
        "place", F.col("text").alias("question"), F.col("kind").alias("template"), "columns", "score", "category", "why"
    )
