"""Column profile, quality score and scorecard."""

from __future__ import annotations

from pyspark.sql import DataFrame, Window as W, functions as F, types as T

from gritsieve.functions.cells import ROW_ID, named
from gritsieve.operators.detectors import constant_names, sentinel_missing
from gritsieve.operators.evidence import Evidence, duplicate_rows, exact_distinct, keyed, with_evidence
from gritsieve.relations import as_text, cell, data_columns, is_text, local_relation, long_cells

SAMPLE = 5
#: Rows from the top in which first values are looked for before whole columns are.
LOOK = 1000


def missing_counts(df: DataFrame) -> tuple[int, dict[str, int]]:
    """Row count and blanks per column, in one aggregate."""
    names = data_columns(df)
    got = df.agg(
        F.count(F.lit(1)).alias("rows"), *[F.count(cell(df, c)).alias(f"c{i}") for i, c in enumerate(names)]
    ).first()
    return got["rows"], {c: got["rows"] - got[f"c{i}"] for i, c in enumerate(names)}


def _first_seen(cells: DataFrame, k: int) -> list:
    """Of (column, value, row): each column's first `k` different values by the row they are first in."""
    firsts = cells.groupBy("column", keyed(F.col("value")).alias("key")).agg(F.min("row").alias("row"))
    # Spark limits each partition to k rows a column before this window's shuffle.
    place = F.row_number().over(W.partitionBy("column").orderBy("row"))
    return firsts.select("column", "key", "row", place.alias("place")).filter(F.col("place") <= k).collect()


def first_values(df: DataFrame, unique: dict[str, int], k: int = SAMPLE) -> DataFrame:
    """(column, sample): each column's first `k` different values in row order, without a shuffle of its cells.

    The first LOOK rows show them for nearly every column. What a column still lacks of its `unique` values is found by one
    aggregate a value over the columns concerned: the first row with none of the values found so far.
    """
    spark = df.sparkSession
    head = df.orderBy(ROW_ID).limit(LOOK)
    found: dict[str, list] = {c: [] for c in unique}
    for r in sorted(_first_seen(long_cells(head, list(unique), row=named(ROW_ID)), k), key=lambda r: r["place"]):
        found[r["column"]].append((r["key"], r["row"]))
    while lacking := [c for c, n in unique.items() if len(found[c]) < min(k, n)]:
        fresh = [
            F.min(F.when(cell(df, c).isNotNull() & ~keyed(as_text(df, c)).isin([key for key, _ in found[c]]),
                         F.struct(named(ROW_ID).alias("row"), keyed(as_text(df, c)).alias("key")))).alias(f"c{i}")
            for i, c in enumerate(lacking)
        ]
        got = df.agg(*fresh).first()
        for i, c in enumerate(lacking):
            found[c].append((got[f"c{i}"]["key"], got[f"c{i}"]["row"]))
    # At most k rows per column, so this side is bounded by the schema.
    picked = local_relation(
        spark, [{"column": c, "place": i, ROW_ID: row} for c, seen in found.items() for i, (_, row) in enumerate(seen)],
        T.StructType([T.StructField("column", T.StringType()), T.StructField("place", T.IntegerType()), T.StructField(ROW_ID, df.schema[ROW_ID].dataType)]),
    )
    value = F.coalesce(*[F.when(F.col("column") == c, as_text(df, c)) for c in unique])
    return (
        df.join(F.broadcast(picked), ROW_ID).select("column", "place", value.alias("value")).groupBy("column")
        .agg(F.transform(F.array_sort(F.collect_list(F.struct("place", "value"))), lambda s: s["value"]).alias("sample"))
    )


def distinct_and_first(df: DataFrame, names: list[str], k: int = SAMPLE) -> DataFrame:
    """(column, n_unique, sample): exact distinct counts and the first `k` different values in row order.

    Without row ids the first values are the smallest.
    """
    counts = exact_distinct(df, names).collect()  # one row per column
    unique = local_relation(df.sparkSession, [r.asDict() for r in counts], "column string, n_unique bigint")
    if not counts:
        return unique.withColumn("sample", F.array().cast("array<string>"))
    if ROW_ID in df.columns:
        samples = first_values(df, {r["column"]: r["n_unique"] for r in counts}, k)
    else:
        place = W.partitionBy("column").orderBy("value")
        smallest = long_cells(df, names).distinct().withColumn("place", F.row_number().over(place)).filter(F.col("place") <= k)
        samples = smallest.groupBy("column").agg(F.array_sort(F.collect_list("value")).alias("sample"))
    return unique.join(samples, "column", "left")


def profile(df: DataFrame, samples: int = SAMPLE) -> DataFrame:
    """One row per column: type, blanks, exact distinct counts, flags and the first `samples` values (none for 0)."""
    names = data_columns(df)
    rows, missing = missing_counts(df)
    base = local_relation(
        df.sparkSession,
        [
            {
                "pos": i, "column": c, "type": df.schema[c].dataType.simpleString(), "n_rows": rows,
                "n_missing": missing[c], "pct_missing": missing[c] / rows if rows else 0.0,
                "is_text": is_text(df.schema[c]),
            }
            for i, c in enumerate(names)
        ],
        "pos int, column string, type string, n_rows bigint, n_missing bigint, pct_missing double, is_text boolean",
    )
    unique = F.coalesce(F.col("n_unique"), F.lit(0))
    with_blank = unique + (F.col("n_missing") > 0).cast("bigint")
    seen = distinct_and_first(df, names, samples) if samples else exact_distinct(df, names)
    out = base.join(seen, "column", "left")
    kept = ["pos", "column", "type", "n_rows", "n_missing", "pct_missing"]
    return out.select(
        *kept, unique.alias("n_unique"), with_blank.alias("n_unique_with_na"),
        (with_blank <= 1).alias("is_constant"), (F.col("is_text") & (unique > 50)).alias("is_free_text"),
        *([F.coalesce("sample", F.array().cast("array<string>")).alias("sample")] if samples else []),
    )


BREAKDOWN = (
    "n_rows bigint, n_cols bigint, missing_cells bigint, duplicate_rows bigint, "
    "constant_columns bigint, sentinel_columns bigint"
)


@with_evidence
def score_breakdown(df: DataFrame, ev: Evidence | None = None) -> DataFrame:
    """The score's inputs: blank cells, repeated rows, constant columns, columns with missing-data codes."""
    coded = sentinel_missing(ev).select("column").distinct().collect()
    return local_relation(df.sparkSession, [{
        "n_rows": ev.n_rows,
        "n_cols": len(ev.columns),
        "missing_cells": sum(r["n_rows"] - r["present"] for r in ev.rows),
        "duplicate_rows": duplicate_rows(df).first()["n_duplicates"],
        "constant_columns": len(constant_names(ev)) if ev.n_rows > 1 else len(ev.columns) if ev.n_rows else 0,
        "sentinel_columns": sum(1 for r in coded if ev.kinds[r["column"]] in ("text", "number")),
    }], BREAKDOWN)


def quality_score(df: DataFrame, ev: Evidence | None = None) -> DataFrame:
    """The inputs and the 0 to 100 score."""
    cells = F.col("n_rows") * F.col("n_cols")
    score = (
        100
        - F.col("missing_cells") / F.nullif(cells, F.lit(0)) * 40
        - F.col("duplicate_rows") / F.nullif(F.col("n_rows"), F.lit(0)) * 20
        - F.col("constant_columns") / F.nullif(F.col("n_cols"), F.lit(0)) * 15
        - F.least(F.col("sentinel_columns") * 3, F.lit(25))
    )
    rounded = F.greatest(F.lit(0), F.least(F.lit(100), F.bround(score, 0).cast("int")))
    return score_breakdown(df, ev).withColumn(
        "score", F.when(cells > 0, rounded).otherwise(F.lit(0)).cast("int")
    )


def scorecard(before: DataFrame, after: DataFrame) -> DataFrame:
    """Score, rows, columns and duplicates before and after cleaning, one row per measure."""
    sides = [
        quality_score(df).select(F.lit(when).alias("when"), "score", "n_rows", "n_cols", "duplicate_rows")
        for when, df in (("before", before), ("after", after))
    ]
    long = sides[0].union(sides[1]).unpivot(
        "when", [F.col(c).cast("bigint").alias(c) for c in ("score", "n_rows", "n_cols", "duplicate_rows")],
        "measure", "value",
    )
    wide = long.groupBy("measure").agg(
        F.max(F.when(F.col("when") == "before", F.col("value"))).alias("before"),
        F.max(F.when(F.col("when") == "after", F.col("value"))).alias("after"),
    )
    return wide.withColumn("change", F.col("after") - F.col("before"))


@with_evidence
def schema_summary(df: DataFrame, ev: Evidence | None = None) -> DataFrame:
    """Every column, its type and, for scales and text columns of up to 60 values (all that are counted), the levels.

    `more_values` says that a text column has more than could be listed.
    """
    names = data_columns(df)
    small = ev.distinct_at_most(60)
    texts = [c for c in names if ev.kinds[c] == "text" and c in small]
    values = (
        ev.counts.filter(F.col("column").isin(texts))
        .groupBy("column").agg(F.array_sort(F.collect_list("value")).alias("seen"))
    )
    base = local_relation(
        df.sparkSession,
        [
            {
                "pos": i, "column": c, "type": df.schema[c].dataType.simpleString(),
                "levels": list(df.schema[c].metadata.get("levels", [])) if ev.kinds[c] == "ordered" else None,
            }
            for i, c in enumerate(names)
        ],
        "pos int, column string, type string, levels array<string>",
    )
    values = local_relation(df.sparkSession, [r.asDict() for r in values.collect()], "column string, seen array<string>")
    return base.join(values, "column", "left").select(
        "pos", "column", "type", F.col("levels").isNotNull().alias("is_ordered"),
        F.coalesce("levels", "seen").alias("levels"), F.col("column").isin([c for c in names if ev.kinds[c] == "text" and c not in small]).alias("more_values"),
    )
