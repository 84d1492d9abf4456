"""Deduplication of streams.

Exact: Spark's own state, bounded by a watermark if there is one.  Near: the rows of a micro
batch that are near what earlier batches left go, then the batch is deduplicated in itself;
so batches in order decide as one pass over all rows in order would.  Both use one signature
of each different text.  What survives is
appended: the state is two tables in shared storage, and a restarted query finds it there.
Each batch reads the band keys of earlier batches, with ``keep_batches`` of the last ones
only: older state is removed, so a batch costs the same however long the stream has run, and
copies that are further apart both stay.  Only texts that share a key are compared.
"""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql.streaming import StreamingQueryListener

from textloom.operators import dedup
from textloom.operators.storage import exists, remove, shared_dir, store, temporary


def exact_stream(stream: DataFrame, text_col: str = "text", algorithm: str = "md5", event_time: str | None = None, delay: str = "1 hour") -> DataFrame:
    hashed = stream.withColumn("content_hash", dedup.content_hash(F.col(text_col), algorithm))
    if event_time:
        return hashed.withWatermark(event_time, delay).dropDuplicatesWithinWatermark(["content_hash"])
    return hashed.dropDuplicates(["content_hash"])


class Progress(StreamingQueryListener):
    """Tells a function of (rows so far, rows a second) after each micro batch."""

    def __init__(self, tell: Callable[[int, float], None]) -> None:
        self.rows, self.tell = 0, tell

    def onQueryStarted(self, event) -> None:
        pass

    def onQueryProgress(self, event) -> None:
        self.rows += event.progress.numInputRows
        self.tell(self.rows, event.progress.processedRowsPerSecond)

    def onQueryTerminated(self, event) -> None:
        pass


def state_stats(spark: SparkSession, state: str) -> dict[str, int]:
    """Documents and band keys that a near-duplicate state holds."""
    if not exists(spark, f"{state}/texts"):
        return {"documents": 0, "bands": 0}
    return {"documents": spark.read.parquet(f"{state}/texts").count(), "bands": spark.read.parquet(f"{state}/bands").count()}


def clear_state(spark: SparkSession, state: str) -> None:
    remove(spark, state)


def near_stream_batch(state: str, sink: Callable[[DataFrame, int], None], cfg: dedup.DedupConfig = dedup.DedupConfig(), ord_col: str = "doc_id", text_col: str = "text", keep_batches: int | None = None) -> Callable[[DataFrame, int], None]:
    """A ``foreachBatch`` function: ``sink`` gets the rows that stay.

    ``state`` is a folder; rows of a batch that is run again replace their own.  A state that
    is there but cannot be read is an error, never an empty one.
    """

    def existing(spark: SparkSession, name: str, epoch: int) -> DataFrame | None:
        if not exists(spark, f"{state}/{name}"):
            return None
        first = 0 if keep_batches is None else max(0, epoch - keep_batches)
        return spark.read.parquet(f"{state}/{name}").where(F.col("epoch").between(first, epoch - 1))  # by folder: others are not read

    def expire(spark: SparkSession, epoch: int) -> None:
        for name in ("bands", "texts"):
            if exists(spark, f"{state}/{name}/epoch={epoch}"):
                remove(spark, f"{state}/{name}/epoch={epoch}")

    def run(batch: DataFrame, epoch: int) -> None:
        spark = batch.sparkSession
        with temporary(spark):
            path = shared_dir(spark)
            left = store(batch, f"{path}/batch")
            old_bands, old_texts = existing(spark, "bands", epoch), existing(spark, "texts", epoch)
            earlier = None if old_bands is None or old_texts is None else (old_bands, old_texts)
            stays, bands, texts = dedup.after_earlier(left, earlier, cfg, ord_col, text_col)
            fresh = store(left.join(stays.withColumnRenamed("ord", ord_col), ord_col, "left_semi"), f"{path}/fresh")
            for name, rows in (("bands", bands), ("texts", texts)):
                rows.write.mode("overwrite").parquet(f"{state}/{name}/epoch={epoch}")
            sink(fresh, epoch)
            if keep_batches is not None and epoch > keep_batches:
                expire(spark, epoch - keep_batches - 1)  # this batch, run again, would still find all it has read

    return run
