"""Connected components by alternating stars, as Spark jobs only."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from gritsieve.llm.shared import discard, stored

#: The stars halve the depth of every tree in a round; a chain of 2**40 nodes ends before this.
MOST_ROUNDS = 80


def _canonical(edges: DataFrame) -> DataFrame:
    return edges.where("a <> b").select(F.greatest("a", "b").alias("a"), F.least("a", "b").alias("b")).distinct()


def _settled(edges: DataFrame) -> bool:
    """Whether every larger end points at one node only, and that node at none: then all components are stars."""
    ends = edges.select(F.explode(F.array(
        F.struct(F.col("a").alias("node"), F.col("b").alias("to")), F.struct(F.col("b").alias("node"), F.lit(None).cast("long").alias("to")),
    )).alias("e")).select("e.*")
    nodes = ends.groupBy("node").agg(
        F.min("to").alias("low"), F.max("to").alias("high"), F.max(F.col("to").isNull()).alias("target"))
    return nodes.where("low is not null and (target or low <> high)").limit(1).count() == 0


def components(edges: DataFrame) -> DataFrame:
    """(node, component) for every node of an edge of the table (a long, b long): the smallest node it is linked to.

    Each round points every larger neighbour at the smallest neighbour (large star), then does so with the smaller
    ones (small star). Minima are aggregated map-side, written, and joined back: as no aggregate shares the join's stage,
    adaptive execution splits a node with very many edges. Self-links, repeated and reversed
    edges are allowed; an empty table gives an empty one.
    """
    current = stored(_canonical(edges), "edges")
    for _ in range(MOST_ROUNDS):
        if _settled(current):
            break
        both = current.unionByName(current.select(F.col("b").alias("a"), F.col("a").alias("b")))
        low = stored(both.groupBy("a").agg(F.least("a", F.min("b")).alias("m")), "lows")
        large = both.where("b > a").join(low, "a").select(F.col("b").alias("a"), F.col("m").alias("b"))
        large = stored(large.where("a <> b"), "edges")
        lower = stored(large.groupBy("a").agg(F.min("b").alias("m")), "lows")
        moved = large.join(lower, "a").select(F.explode(F.array(
            F.struct(F.col("a"), F.col("m").alias("b")), F.struct(F.col("b").alias("a"), F.col("m").alias("b")),
        )).alias("e")).select("e.a", "e.b")
        after = stored(_canonical(moved), "edges")
        for done in (large, current, low, lower):
            discard(done)
        current = after
    else:
        raise RuntimeError("components did not settle")
    return current.select(F.col("a").alias("node"), F.col("b").alias("component")).unionByName(
        current.select(F.col("b").alias("node"), F.col("b").alias("component")).distinct()
    )
