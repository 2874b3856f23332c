"""The scan of everything a stream has brought so far, from evidence that is kept and added to, never from the rows again."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession, functions as F
from pyspark.sql.streaming import StreamingQuery

from gritsieve.functions.cells import ROW_ID, number
from gritsieve.operators.detectors import findings_of, question_text
from gritsieve.operators.evidence import COUNTED_DISTINCT, Evidence, count_values, known_code, row_digest
from gritsieve.relations import data_columns, is_text, spread

SUMS = ["present", "numbers", "shaped", "dated", "codes", "beyond"]
#: Cells, normalised texts and shapes of dates are counted by sketches that can be united.
SKETCHES = {"distinct_sketch": "key", "norm_sketch": "norm", "shapes": "dated"}


class SoFar:
    """Evidence about all batches up to one, in a folder of its own under `path`; a batch run again gives the same again.

    Kept for each batch: a row of sums and sketches per column; the counts of the values of columns with few; the first
    row. These are whole states, small and bounded by the schema, so older folders may be deleted. Digests of rows, 32 bytes
    each, are kept where they first came, as exact counts of repeated rows need them all.
    """

    def __init__(self, spark: SparkSession, path: str):
        self.spark, self.path = spark, path

    def _folder(self, part: str, batch: int) -> str:
        return f"{self.path}/{part}/batch_id={batch}"

    def _before(self, part: str, batch: int, like: DataFrame) -> DataFrame:
        """The state before a batch, empty before the first."""
        if not batch:
            return like.limit(0)
        return self.spark.read.schema(like.schema).parquet(self._folder(part, batch - 1))

    def _write(self, df: DataFrame, part: str, batch: int) -> DataFrame:
        df.write.mode("overwrite").parquet(self._folder(part, batch))
        return self.spark.read.schema(df.schema).parquet(self._folder(part, batch))

    def _measures(self, blank: Evidence, batch: int) -> dict[int, dict]:
        """Sums and sketches with this batch's, by position of the column."""
        cells = self._write(blank.read_cells().groupBy("pos").agg(
            *Evidence.sums(), F.hll_sketch_agg("key").alias("distinct_sketch")).coalesce(1), "cells", batch)
        sizes = cells.filter("pos >= 0").select("pos", F.hll_sketch_estimate("distinct_sketch").alias("d")).collect()
        repeated = blank.repeated({blank.columns[r["pos"]]: r["d"] for r in sizes})
        texts = blank.read_texts(count_values(blank.df, set(repeated), set()), repeated).groupBy("pos").agg(
            *Evidence.text_sums(), *(F.hll_sketch_agg(c).alias(s) for s, c in SKETCHES.items() if c != "key"))
        own = cells.withColumnRenamed("codes", "other_codes").join(F.broadcast(texts), "pos", "left").select(
            "pos", *(F.coalesce(c, F.lit(0)).alias(c) if c != "codes" else F.coalesce(c, "other_codes").alias(c) for c in SUMS),
            *SKETCHES)
        both = self._before("measures", batch, own).unionByName(own).groupBy("pos").agg(
            *(F.sum(c).alias(c) for c in SUMS), *(F.hll_union_agg(s).alias(s) for s in SKETCHES))
        kept = self._write(both.coalesce(1), "measures", batch)
        shown = kept.select("pos", *SUMS, *(F.hll_sketch_estimate(s).alias(s) for s in SKETCHES))
        return {r["pos"]: r.asDict() for r in shown.collect()}

    def _whole(self, ev: Evidence, batch: int) -> list[str]:
        """Columns with few values in every state so far; one that has had many is never counted again."""
        few = [
            r["column"] for r in ev.rows
            if min(r["distinct_sketch"], r["norm_sketch"] or r["distinct_sketch"]) <= COUNTED_DISTINCT
        ]
        now = self.spark.createDataFrame([(c,) for c in few], "column string")
        if batch:
            now = now.join(F.broadcast(self._before("whole", batch, now)), "column", "left_semi")
        return [r["column"] for r in self._write(now.coalesce(1), "whole", batch).collect()]

    def _counts(self, rows: DataFrame, ev: Evidence, whole: list[str], batch: int) -> DataFrame:
        coded = {r["column"] for r in ev.rows if r["codes"]}
        own = count_values(rows, set(whole), coded)
        earlier = self._before("values", batch, own)
        # Of a column that has many values by now, only the missing-data codes are still wanted.
        dropped = set(ev.columns) - set(whole)
        if dropped:
            codes = known_code(F.col("norm"), number(F.col("value")))
            earlier = earlier.filter(~F.col("column").isin(sorted(dropped)) | codes)
        both = earlier.unionByName(own).groupBy("column", "value", "norm").agg(F.sum("n").alias("n"), F.min("first_row").alias("first_row"))
        return self._write(both, "values", batch)

    def _duplicates(self, rows: DataFrame, batch: int) -> int:
        """Repeated rows so far: rows, less digests that were new in their batch."""
        own = rows.select(row_digest(rows).alias("digest")).groupBy("digest").agg(F.count(F.lit(1)).alias("n"))
        if batch:
            earlier = self.spark.read.schema("digest binary, batch_id int").parquet(f"{self.path}/digests").where(F.col("batch_id") < batch)
            fresh = own.join(earlier.select("digest"), "digest", "left_anti").select("digest")
        else:
            fresh = own.select("digest")
        new = self._write(fresh, "digests", batch).count()
        total = rows.count()
        tally = self.spark.createDataFrame([(total - new,)], "n bigint")
        earlier = self._before("duplicates", batch, tally)
        return self._write(earlier.unionByName(tally).agg(F.sum("n").alias("n")), "duplicates", batch).first()["n"]

    def _first(self, rows: DataFrame, batch: int) -> dict | None:
        if ROW_ID not in rows.columns:
            return None
        top = self._before("first", batch, rows).unionByName(rows).orderBy(ROW_ID).limit(1)
        got = self._write(top, "first", batch).first()
        return got.asDict() if got else None

    def findings(self, rows: DataFrame, batch: int) -> DataFrame:
        """Take a batch in, and scan all so far: the findings a scan of all rows together would have."""
        blank = Evidence.of_parts(rows, {}, None, [], 0)
        measures = self._measures(blank, batch)
        ev = Evidence.of_parts(rows, measures, None, [], 0)
        whole = self._whole(ev, batch)
        counts = self._counts(rows, ev, whole, batch)
        ev = Evidence.of_parts(rows, measures, counts, whole, self._duplicates(rows, batch))
        top = self._first(rows, batch)
        if top:
            texts = {c: ev.stat(c)["numbers"] for c in data_columns(rows) if is_text(rows.schema[c])}
            header = question_text(rows, top, ev.n_rows, texts)
            if not header.isEmpty():
                return header
        return findings_of(rows, ev=ev)


def scan_so_far(stream: DataFrame, findings_path: str, state_path: str, checkpoint: str, **trigger) -> StreamingQuery:
    """After every micro-batch, write the findings about all rows so far under its batch id.

    Batch ids count up by one, and every batch leaves the whole state; run again after a failure, a batch starts from the
    state before it and overwrites what it had written.
    """

    def one(batch: DataFrame, batch_id: int) -> None:
        batch = spread(batch).persist()  # looked at several times, and a batch of one file would be one task
        try:
            found = SoFar(batch.sparkSession, state_path).findings(batch, batch_id)
            found.withColumn("batch_id", F.lit(batch_id).cast("bigint")).write.mode("overwrite").parquet(f"{findings_path}/batch_id={batch_id}")
        finally:
            batch.unpersist()

    return (
        stream.writeStream.foreachBatch(one).option("checkpointLocation", checkpoint)
        .trigger(**(trigger or {"availableNow": True})).start()
    )
