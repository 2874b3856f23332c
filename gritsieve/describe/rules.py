"""Suggestions as relations: a table of rules joined with a table that says which columns can fill which place."""

from __future__ import annotations

from collections.abc import Iterable
from dataclasses import dataclass

from pyspark.sql import DataFrame, SparkSession, functions as F

from gritsieve.operators.ranks import placed
from gritsieve.relations import local_relation

MEMBERS = "slot string, column string, pos int"
RULES = (
    "rule int, kind string, score double, one string, two string, distinct_pair boolean, ordered_pair boolean, text string, "
    "category string, why string"
)


@dataclass(frozen=True)
class Rule:
    """What to suggest (`kind`) for each column in slot `one`, or each pair with one in slot `two`.

    `text` names the columns as {1} and {2}. A pair never holds one column twice; with the same slot twice it comes once.
    """

    kind: str
    score: float
    one: str
    text: str
    why: str
    two: str | None = None
    category: str = ""


def members(spark: SparkSession, slots: dict[str, Iterable[str]]) -> DataFrame:
    """(slot, column, pos): the columns that can stand in each slot, in table order."""
    return local_relation(
        spark, [{"slot": s, "column": c, "pos": i} for s, names in slots.items() for i, c in enumerate(names)], MEMBERS
    )


def suggested(spark: SparkSession, rules: list[Rule], slots: dict[str, Iterable[str]]) -> DataFrame:
    """Every match of every rule, best first: place, kind, text, columns (a JSON list), score, category, why."""
    table = local_relation(spark, [
        {
            "rule": i, "kind": r.kind, "score": r.score, "one": r.one, "two": r.two, "distinct_pair": r.two is not None,
            "ordered_pair": r.one == r.two, "text": r.text, "category": r.category, "why": r.why,
        }
        for i, r in enumerate(rules)
    ], RULES)
    known = members(spark, slots)
    first = known.select(F.col("slot").alias("one"), F.col("column").alias("c1"), F.col("pos").alias("p1"))
    second = known.select(F.col("slot").alias("two"), F.col("column").alias("c2"), F.col("pos").alias("p2"))
    pairs = table.where("two is not null").join(first, "one").join(second, "two").where(
        "c1 <> c2 and (not ordered_pair or p1 < p2)")
    singles = table.where("two is null").join(first, "one").withColumns(
        {"c2": F.lit(None).cast("string"), "p2": F.lit(None).cast("int")})
    found = singles.unionByName(pairs)
    text = F.replace(F.replace("text", F.lit("{1}"), F.col("c1")), F.lit("{2}"), F.coalesce("c2", F.lit("")))
    order = ["rule", "p1", "p2"]
    shown = found.select(
        "kind", text.alias("text"), F.to_json(F.filter(F.array("c1", "c2"), lambda c: c.isNotNull())).alias("columns"),
        "score", "category", "why", *order,
    )
    # A table of many columns has very many pairs of them.
    ranked = placed(shown, [], [F.desc("score"), F.col("rule"), F.col("p1"), F.col("p2").asc_nulls_first()], rank="place", drop=order)
    return ranked.select(F.col("place").cast("int").alias("place"), "kind", "text", "columns", "score", "category", "why")
