"""Schemas of the small result relations, and helpers shared by all operators."""

from __future__ import annotations

import pyarrow as pa
from pyspark.sql import Column, DataFrame, SparkSession, functions as F, types as T
from pyspark.sql.pandas.types import to_arrow_schema

from gritsieve.functions.cells import ORDINAL, ROW_ID, named, present

FINDINGS = (
    "kind string, column string, confidence double, n_affected bigint, detail string, op string, params string"
)
PLAN = (
    "step int, stage int, stage_label string, op string, target string, params string, "
    "confidence double, rationale string, blocked string"
)
LEDGER = (
    "seq int, op string, params string, rationale string, rows_before bigint, rows_after bigint, "
    "cols_before int, cols_after int, rows_affected bigint, stats string, recorded_at string"
)


def local_relation(spark: SparkSession, rows: list[dict], schema: str | T.StructType) -> DataFrame:
    """A relation about tables (never table data): at most a few rows per column."""
    if isinstance(schema, str):
        schema = T.StructType.fromDDL(schema)
    return spark.createDataFrame(pa.Table.from_pylist(rows, schema=to_arrow_schema(schema)), schema=schema)


def data_columns(df: DataFrame) -> list[str]:
    """The user's columns: no row id and no ordinal companions."""
    names = set(df.columns)
    return [
        c for c in df.columns
        if c != ROW_ID and not (c.endswith(ORDINAL) and c[: -len(ORDINAL)] in names)
    ]


def is_text(field: T.StructField) -> bool:
    return isinstance(field.dataType, (T.StringType, T.VarcharType, T.CharType))


def is_numeric(field: T.StructField) -> bool:
    return isinstance(field.dataType, T.NumericType)


def is_moment(field: T.StructField) -> bool:
    return isinstance(field.dataType, (T.TimestampType, T.TimestampNTZType, T.DateType))


def is_ordered(df: DataFrame, name: str) -> bool:
    return name + ORDINAL in df.columns


def cell(df: DataFrame, name: str) -> Column:
    """A column's cells with NULL as the only missing marker."""
    return present(named(name), df.schema[name].dataType)


def as_text(df: DataFrame, name: str) -> Column:
    """Cells as comparable text; maps go through sorted entries since they have no order of their own."""
    value = cell(df, name)
    if isinstance(df.schema[name].dataType, T.MapType):
        return F.array_sort(F.map_entries(value)).cast("string")
    return value.cast("string")


def first_row_order(df: DataFrame) -> Column:
    """What decides "seen first": the row id, or nothing at all when the table has none."""
    return named(ROW_ID) if ROW_ID in df.columns else F.lit(None).cast("bigint")


def long_cells(df: DataFrame, names: list[str], **extra: Column) -> DataFrame:
    """One row per non-blank cell of the named columns: (column, value, extras)."""
    cells = F.array(*[
        F.struct(F.lit(n).alias("column"), as_text(df, n).alias("value")) for n in names
    ])
    return (
        df.select(F.explode(cells).alias("_c"), *[e.alias(a) for a, e in extra.items()])
        .select("_c.column", "_c.value", *extra)
        .filter(F.col("value").isNotNull())
    )


def spread(df: DataFrame) -> DataFrame:
    """The same rows, dealt out anew if they come in fewer partitions than there are cores.

    A small file may hold rows enough for every core. For tables as they are read: the partitions of a plan with shuffles
    are only known by running it.
    """
    cores = df.sparkSession.sparkContext.defaultParallelism
    return df if df.rdd.getNumPartitions() >= cores else df.repartition(2 * cores)
