"""Durable intermediate tables in the folder that all executors share, and their removal.

A folder comes from ``shared_dir``; the session remembers it until it is removed.  A
result that is still to be read keeps its tables until ``release`` (called when the
program ends); what only an operator's own steps read goes when its block of
``temporary`` ends, also when a step fails.
"""

from __future__ import annotations

import atexit
import re
import tempfile
import uuid
from collections.abc import Iterator
from contextlib import contextmanager

from pyspark.sql import DataFrame, SparkSession

#: Folders this program has made and not removed, in order.
_made: list[str] = []


def shared_dir(spark: SparkSession) -> str:
    """A new folder under ``spark.checkpoint.dir``.

    Where that is not set, one process alone (master ``local[...]``) takes its temporary
    folder; on a cluster, where executors don't share it, this is an error.
    """
    base = spark.conf.get("spark.checkpoint.dir", None)
    if not base:
        master = spark.conf.get("spark.master", "")
        if not re.match(r"local(\[|$)", master):
            raise RuntimeError("set spark.checkpoint.dir to a folder that the driver and all executors share")
        base = f"file://{tempfile.gettempdir()}/checkpoints"
    if not _made:
        atexit.register(_at_exit, spark)
    _made.append(f"{base.rstrip('/')}/textloom-{uuid.uuid4().hex}")
    return _made[-1]


def store(df: DataFrame, path: str) -> DataFrame:
    """Write a table and read it back: cuts the lineage durably.

    Shuffle files of a query go when it has ended, not at some later garbage collection: a
    session setting that stays, and that changes no result.
    """
    schema = df.schema
    df.sparkSession.conf.set("spark.sql.classic.shuffleDependency.fileCleanup.enabled", "true")
    df.write.mode("overwrite").option("compression", "zstd").parquet(path)
    return df.sparkSession.read.schema(schema).parquet(path)


def remove(spark: SparkSession, path: str) -> None:
    """Delete a folder, through Spark's own file systems."""
    jvm = spark.sparkContext._jvm
    place = jvm.org.apache.hadoop.fs.Path(path)
    place.getFileSystem(spark.sparkContext._jsc.hadoopConfiguration()).delete(place, True)
    if path in _made:
        _made.remove(path)


def exists(spark: SparkSession, path: str) -> bool:
    place = spark.sparkContext._jvm.org.apache.hadoop.fs.Path(path)
    return place.getFileSystem(spark.sparkContext._jsc.hadoopConfiguration()).exists(place)


@contextmanager
def temporary(spark: SparkSession, *keep: str) -> Iterator[None]:
    """Folders made inside the block are removed when it ends or fails, but for ``keep``."""
    before = set(_made)
    try:
        yield
    finally:
        for path in [p for p in _made if p not in before and p not in keep]:
            remove(spark, path)


def release(spark: SparkSession) -> None:
    """Remove all folders; results that read them must have been used."""
    for path in list(_made):
        remove(spark, path)


def _at_exit(spark: SparkSession) -> None:
    try:
        release(spark)
    except Exception:  # the session has ended before: nothing can be removed any more
        _made.clear()


#: Rows and bytes of the Arrow batches that a worker gets: several copies of one are in its memory at once.
BATCH_ROWS, BATCH_BYTES = 512, 8 << 20


def small_batches(spark: SparkSession) -> None:
    """A session setting that stays, since plans are made when their action runs, and that changes no result."""
    spark.conf.set("spark.sql.execution.arrow.maxRecordsPerBatch", str(BATCH_ROWS))
    spark.conf.set("spark.sql.execution.arrow.maxBytesPerBatch", str(BATCH_BYTES))


#: Bytes of a file that one task reads, unless the session asks for something else than Spark's default.
SPLIT_BYTES, SPLIT_KEY = 16 << 20, "spark.sql.files.maxPartitionBytes"


def small_splits(spark: SparkSession) -> None:
    """Texts are costly to work on: 128 MB of packed ones keep a task for long.  A session setting that stays."""
    if spark.conf.get(SPLIT_KEY).lower() in ("134217728b", "134217728", "128mb", "128m"):
        spark.conf.set(SPLIT_KEY, str(SPLIT_BYTES))


#: Bytes of plan size below which a table is dealt out again before costly work on its texts.
SMALL_BYTES = 256 << 20


def plan_bytes(df: DataFrame) -> int | None:
    """The optimizer's estimate; None in a remote session, which has no plan to look at."""
    plan = getattr(df, "_jdf", None)
    return None if plan is None else int(str(plan.queryExecution().optimizedPlan().stats().sizeInBytes()))


def spread(df: DataFrame) -> DataFrame:
    """A small table over all cores; changes the layout, never a result.

    A small file is often one row group, which one task would read and then work on
    alone.  The optimizer's size estimate decides: a large table has splits enough and
    is left as it is, so this never shuffles much.
    """
    size = plan_bytes(df)
    if size is None or size >= SMALL_BYTES:
        return df
    return df.repartition(df.sparkSession.sparkContext.defaultParallelism * 2)


def write_text(spark: SparkSession, path: str, text: str) -> None:
    """One small file, through Spark's own file systems, so that any address Spark accepts will do."""
    place = spark.sparkContext._jvm.org.apache.hadoop.fs.Path(path)
    out = place.getFileSystem(spark.sparkContext._jsc.hadoopConfiguration()).create(place, True)
    try:
        out.write(bytearray(text.encode("utf-8", "surrogatepass")))
    finally:
        out.close()


def read_text(spark: SparkSession, path: str) -> str:
    return spark.read.text(path, wholetext=True).first()[0]
