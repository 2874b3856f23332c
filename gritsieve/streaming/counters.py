"""Quality counters per event-time window, on a stream or a table alike."""

from __future__ import annotations

from pyspark.sql import DataFrame, functions as F

from gritsieve.functions.cells import named, norm, number
from gritsieve.operators.cleaning import header_copy
from gritsieve.operators.evidence import known_code, plausible_range
from gritsieve.relations import as_text, cell, data_columns, is_numeric
from gritsieve.streaming.clean import with_event_time


def quality_counters(
    df: DataFrame, event_time: str, window: str = "1 hour", delay: str | None = None,
    columns: list[str] | None = None,
) -> DataFrame:
    """(window_start, column, n_rows, n_blank, n_codes, n_beyond, n_header_rows).

    State holds one row per open window and column, whatever the volume of the stream.
    """
    timed = with_event_time(df, event_time)
    if delay:
        timed = timed.withWatermark(event_time, delay)
    names = columns or [c for c in data_columns(df) if c != event_time]

    def counted(name: str):
        bounds = plausible_range(name) if is_numeric(df.schema[name]) else None
        value = cell(df, name)
        return F.struct(
            F.lit(name).alias("column"), as_text(df, name).alias("text"),
            (F.coalesce((value < bounds[1]) | (value > bounds[2]), F.lit(False)) if bounds else F.lit(False)).alias("beyond"),
        )

    cells = timed.select(
        named(event_time).alias("_at"), header_copy(df).alias("header"),
        F.explode(F.array(*[counted(c) for c in names])).alias("c"),
    ).select("_at", "header", "c.*")
    text = F.col("text")
    return (
        cells.groupBy(F.window("_at", window).alias("w"), "column")
        .agg(
            F.count(F.lit(1)).alias("n_rows"),
            F.count_if(text.isNull()).alias("n_blank"),
            F.count_if(known_code(norm(text), number(text))).alias("n_codes"),
            F.count_if("beyond").alias("n_beyond"),
            F.count_if("header").alias("n_header_rows"),
        )
        .select(F.col("w.start").alias("window_start"), "column", "n_rows", "n_blank", "n_codes", "n_beyond", "n_header_rows")
    )
