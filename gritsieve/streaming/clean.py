"""The row-local part of the work on streams, exact duplicates within a watermark, scans per micro-batch."""

from __future__ import annotations

from pyspark.sql import DataFrame, functions as F
from pyspark.sql.streaming import StreamingQuery

from gritsieve.functions.cells import named
from gritsieve.operators.detectors import scan
from gritsieve.plans.recipe import Recipe
from gritsieve.relations import data_columns


def clean_stream(stream: DataFrame, recipe: Recipe) -> DataFrame:
    """Replay a recipe on a stream; steps that need other rows are left to the batch that follows."""
    return recipe.row_local().apply(stream)


def with_event_time(stream: DataFrame, column: str) -> DataFrame:
    """Watermarks need TIMESTAMP; Parquet often holds the zoneless kind."""
    return stream.withColumn(column, named(column).cast("timestamp"))


def distinct_stream(stream: DataFrame, event_time: str, delay: str, columns: list[str] | None = None) -> DataFrame:
    """Drop rows equal to one seen within the watermark; state is bounded by the delay."""
    keys = columns or data_columns(stream)
    return with_event_time(stream, event_time).withWatermark(event_time, delay).dropDuplicatesWithinWatermark(keys)


def scan_batches(stream: DataFrame, findings_path: str, checkpoint: str, **trigger) -> StreamingQuery:
    """Run the full scan on every micro-batch; findings are written under their batch id.

    A batch that is run again after a failure overwrites its own folder, so no finding is written twice.
    """

    def one(batch: DataFrame, batch_id: int) -> None:
        batch.persist()  # the scan looks at it several times
        try:
            if not batch.isEmpty():
                found = scan(batch).withColumn("batch_id", F.lit(batch_id).cast("bigint"))
                found.write.mode("overwrite").parquet(f"{findings_path}/batch_id={batch_id}")
        finally:
            batch.unpersist()

    return (
        stream.writeStream.foreachBatch(one).option("checkpointLocation", checkpoint)
        .trigger(**(trigger or {"availableNow": True})).start()
    )


def write_stream(stream: DataFrame, path: str, checkpoint: str, fmt: str = "parquet", **trigger) -> StreamingQuery:
    """Append a cleaned stream to files, exactly once through the checkpoint."""
    return (
        stream.writeStream.format(fmt).option("checkpointLocation", checkpoint).option("path", path)
        .outputMode("append").trigger(**(trigger or {"availableNow": True})).start()
    )
