"""Shared plumbing of the training-data operators: Arrow batches, hashing, storage.

Every operator streams Arrow record batches through Python workers.  Nothing here
keeps state that a lost executor would need: workers rebuild their caches lazily.
"""

from __future__ import annotations

import re
from collections.abc import Callable, Iterator
from contextlib import contextmanager

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from textloom.operators.storage import remove, shared_dir, store, temporary  # noqa: F401  for this package's operators

#: Rows in an Arrow batch.  Texts are long; a small batch bounds a worker's memory.
ARROW_ROWS = 512
#: Bytes of text handled at once inside a worker (a single longer text stands alone).
SLICE_BYTES = 4 << 20
#: Bits of the filter that picks rows by id before they are shuffled: 2 MB.
FILTER_BITS = 24

U64 = np.uint64
_WS_BYTES = np.zeros(256, bool)
_WS_BYTES[[0x20, *range(0x09, 0x0E)]] = True


def tune(spark: SparkSession) -> None:
    """Settings every operator of this package wants; none changes a result.

    They stay set in the session: plans are made lazily, when its action runs.
    """
    spark.conf.set("spark.sql.execution.arrow.maxRecordsPerBatch", str(ARROW_ROWS))
    # Long texts: a batch also ends at so many bytes, before it reaches a worker.
    spark.conf.set("spark.sql.execution.arrow.maxBytesPerBatch", str(2 * SLICE_BYTES))
    # Shuffle files go when the query that wrote them has ended, not at some later GC.
    spark.conf.set("spark.sql.classic.shuffleDependency.fileCleanup.enabled", "true")


@contextmanager
def few_files(spark: SparkSession) -> Iterator[None]:
    """Tables stored inside are split by size alone, not over all cores as well: small ones are one file."""
    key = "spark.sql.adaptive.coalescePartitions.parallelismFirst"
    before = spark.conf.get(key, None)
    spark.conf.set(key, "false")
    try:
        yield
    finally:
        if before is None:
            spark.conf.unset(key)
        else:
            spark.conf.set(key, before)


def table(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    return spark.read.parquet(f"{sf_dir}/{name}.parquet")


def id_text(df: DataFrame, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """Just (id, text): extra columns, whatever their names, never reach a worker."""
    return df.select(F.col(id_col).cast("long").alias("id"), F.col(text_col).cast("string").alias("text"))


def map_batches(df: DataFrame, fn: Callable[[pa.RecordBatch], pa.RecordBatch | None], schema: str) -> DataFrame:
    tune(df.sparkSession)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for part in slices(batch):
                out = fn(part)
                if out is not None and out.num_rows:
                    yield out

    return df.mapInArrow(run, schema)


def slices(batch: pa.RecordBatch) -> Iterator[pa.RecordBatch]:
    """Cut a batch so that a slice holds about SLICE_BYTES, or one longer row."""
    if batch.nbytes <= SLICE_BYTES or batch.num_rows <= 1:
        if batch.num_rows:
            yield batch
        return
    half = batch.num_rows // 2
    yield from slices(batch.slice(0, half))
    yield from slices(batch.slice(half))


def filter_cell(id_col: str) -> Column:
    return F.shiftrightunsigned(F.xxhash64(id_col), 64 - FILTER_BITS)


def id_filter(ids: DataFrame) -> np.ndarray:
    """A bit set of fixed size that holds (a hash of) every id."""
    return bit_set(ids.select(filter_cell("id").alias("cell")), FILTER_BITS)


def bit_set(cells: DataFrame, bits: int) -> np.ndarray:
    """2 ** ``bits`` bits, as bytes, in which those of the column ``cell`` are set; packed by Spark, 2048 parts."""

    def pack(table: pa.Table) -> pa.Table:
        out = np.zeros(1 << (bits - 11), bool)
        out[np.asarray(table["cell"]) & ((1 << (bits - 11)) - 1)] = True
        return pa.table({"part": table["part"][:1], "bits": pa.array([np.packbits(out).tobytes()], pa.binary())})

    distinct = cells.select("cell").distinct()
    parts = distinct.withColumn("part", F.shiftright("cell", bits - 11).cast("int")).groupBy("part").applyInArrow(pack, "part int, bits binary").collect()
    out = np.zeros((1 << 11, 1 << (bits - 11) >> 3), np.uint8)
    for row in parts:
        out[row["part"]] = np.frombuffer(row["bits"], np.uint8)
    return out.reshape(-1)


def in_filter(batch: pa.RecordBatch, bits: np.ndarray, cell_column: int) -> pa.RecordBatch:
    """The rows whose cell is in the bit set: all wanted ids and, by chance, few others."""
    cell = np.asarray(batch.column(cell_column))
    return batch.take(pa.array(np.flatnonzero(bits[cell >> 3] >> (7 - (cell & 7)).astype(np.uint8) & 1)))


def texts(column: pa.Array) -> list[str]:
    """The whole texts; null counts as empty."""
    return [t or "" for t in column.to_pylist()]


def mix64(h: np.ndarray) -> np.ndarray:
    """A bijective 64-bit finaliser (public splitmix64 constants)."""
    h = h ^ (h >> U64(30))
    h = h * U64(0xBF58476D1CE4E5B9)
    h = h ^ (h >> U64(27))
    h = h * U64(0x94D049BB133111EB)
    return h ^ (h >> U64(31))


LOWER = bytes(c + 32 if 65 <= c <= 90 else c for c in range(256))


def word_spans(raw: bytes) -> tuple[np.ndarray, np.ndarray]:
    """Byte starts and ends of the words ``[^\\x20\\x09-\\x0D]+`` of UTF-8 bytes."""
    if not raw:
        return np.empty(0, np.int64), np.empty(0, np.int64)
    solid = ~_WS_BYTES[np.frombuffer(raw, np.uint8)]
    edge = np.flatnonzero(np.diff(solid, prepend=False, append=False))
    return edge[0::2], edge[1::2]


def span_hashes(raw: bytes, starts: np.ndarray, ends: np.ndarray) -> np.ndarray:
    """64-bit hashes of byte spans, eight bytes a step over all spans at once."""
    if not len(starts):
        return np.empty(0, U64)
    padded = np.frombuffer(raw + b"\0" * 8, np.uint8)
    lanes = np.lib.stride_tricks.as_strided(padded[:8].view(U64), shape=(len(raw) + 1,), strides=(1,))
    length = (ends - starts).astype(np.int64)
    h = mix64(length.astype(U64) + U64(0x9E3779B97F4A7C15))
    masks = np.array([0xFFFFFFFFFFFFFFFF >> (64 - 8 * n) if n else 0 for n in range(9)], U64)
    rest = None
    at, left = starts, length
    while True:
        value = lanes[at] & masks[np.minimum(left, 8)]
        step = mix64((h if rest is None else h[rest]) ^ (value * U64(0x9E3779B97F4A7C15)))
        if rest is None:
            h = step
        else:
            h[rest] = step
        more = np.flatnonzero(left > 8)
        if not len(more):
            return h
        rest = more if rest is None else rest[more]
        at, left = at[more] + 8, left[more] - 8


def word_hashes(raw: bytes) -> np.ndarray:
    return span_hashes(raw, *word_spans(raw))


def window_hashes(words: np.ndarray, k: int) -> np.ndarray:
    """Hashes of all k-word windows, in order; of the whole where there are fewer words."""
    if not len(words):
        return words
    if len(words) < k:
        h = U64(len(words)) * np.ones(1, U64)
        for w in words:
            h = mix64(h * U64(0xD6E8FEB86659FD93) + w)
        return h
    n = len(words) - k + 1
    h = np.full(n, k, U64)
    for i in range(k):
        h = mix64(h * U64(0xD6E8FEB86659FD93) + words[i : i + n])
    return h


def rows(schema: dict[str, pa.DataType], **columns) -> pa.RecordBatch:
    return pa.RecordBatch.from_arrays([pa.array(columns[k], t) for k, t in schema.items()], names=list(schema))


SPACE_CLASS = "\t-\r \x85\xa0\u1680\u2000-\u200a\u2028\u2029\u202f\u205f\u3000"
#: Stretches at whose borders the byte-level pattern always has a border too.
PIECES = re.compile(f" ?[^{SPACE_CLASS}]+|[{SPACE_CLASS}]+(?![^{SPACE_CLASS}])|[{SPACE_CLASS}]+")
