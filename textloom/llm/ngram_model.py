"""Hashed word and character n-gram features, shared by the two quality models.

A feature is a bucket in a table of ``dims``.  Families (words, word pairs,
character n-grams of set lengths, and whether each three-word window comes again
in the text) each have a total weight of 1 in a text, so a linear model's margin
is the sum over families of a mean weight.
"""

from __future__ import annotations

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from textloom.llm import common

U64 = np.uint64


def families(text: str, dims: int, chars: tuple[int, ...], word_grams: tuple[int, ...]) -> list[np.ndarray]:
    """Bucket numbers of each family, in text order, repeats kept."""
    shift = U64(64 - (dims.bit_length() - 1))
    out = []
    raw = text.encode("utf-8", "surrogatepass")
    words = common.word_hashes(raw)
    for k in word_grams:
        out.append((common.window_hashes(words, k) * U64(0x9E3779B97F4A7C15) >> shift).astype(np.int64) if len(words) >= k else np.empty(0, np.int64))
    windows = common.window_hashes(words, 3)
    if len(words) > 3:
        _, back, count = np.unique(windows, return_inverse=True, return_counts=True)
        out.append((count[back] > 1).astype(np.int64))  # buckets 0 and 1
    codes = np.frombuffer(text.encode("utf-32-le", "surrogatepass"), "<u4").astype(U64)
    for k in chars:
        n = len(codes) - k + 1
        if n < 1:
            out.append(np.empty(0, np.int64))
            continue
        h = np.full(n, U64(k))
        for i in range(k):
            h = (h + codes[i : i + n]) * U64(0xFF51AFD7ED558CCD)
            h ^= h >> U64(32)
        out.append((h * U64(0x9E3779B97F4A7C15) >> shift).astype(np.int64))
    return out


def sparse(text: str, dims: int, chars: tuple[int, ...], word_grams: tuple[int, ...]) -> tuple[np.ndarray, np.ndarray]:
    """Distinct buckets and their weights; each non-empty family sums to 1."""
    parts = [f for f in families(text, dims, chars, word_grams) if len(f)]
    if not parts:
        return np.empty(0, np.int32), np.empty(0, np.float32)
    if dims <= 1 << 14:
        total = np.zeros(dims)
        for f in parts:
            total += np.bincount(f, minlength=dims) / len(f)
        distinct = np.flatnonzero(total)
        return distinct.astype(np.int32), total[distinct].astype(np.float32)
    at = np.concatenate(parts)
    weight = np.concatenate([np.full(len(f), 1 / len(f)) for f in parts])
    distinct, back = np.unique(at, return_inverse=True)
    return distinct.astype(np.int32), np.bincount(back, weight).astype(np.float32)


def labelled_sample(docs: DataFrame, labels: DataFrame, label_col: str, limit: int, id_col: str = "doc_id") -> DataFrame:
    """At most ``limit`` labelled (id, label), those with the smallest hash of the id.

    A document with several label rows takes their largest label; null labels don't count.
    """
    return (
        labels.select(F.col(id_col).cast("long").alias("id"), F.col(label_col).cast("int").alias("label"))
        .where("id is not null and label is not null")
        .groupBy("id")
        .agg(F.max("label").alias("label"))
        .orderBy(F.xxhash64("id"), "id")
        .limit(limit)
    )


def gather(docs: DataFrame, sample: DataFrame, dims: int, chars: tuple[int, ...], word_grams: tuple[int, ...], id_col: str = "doc_id", text_col: str = "text") -> list[tuple[int, int, np.ndarray, np.ndarray]]:
    """(id, label, buckets, weights) of the sample's documents, in id order.

    Features are made on the executors from whole texts; the driver gets at most
    ``limit`` sparse rows.  The broadcast sides hold at most ``limit`` pairs.  Of several
    texts of one id the one with the smallest hash counts.
    """
    schema = "id long, label int, at array<int>, weight array<float>"

    def run(batch: pa.RecordBatch) -> pa.RecordBatch:
        feats = [sparse(t, dims, chars, word_grams) for t in common.texts(batch.column(1))]
        return pa.RecordBatch.from_arrays([batch.column(0), batch.column(2), pa.array([a for a, _ in feats], pa.list_(pa.int32())), pa.array([w for _, w in feats], pa.list_(pa.float32()))], names=["id", "label", "at", "weight"])

    found = common.id_text(docs, id_col, text_col).join(F.broadcast(sample), "id").select("id", "text", "label", F.xxhash64("text").alias("hash"))
    first = found.groupBy("id").agg(F.min("hash").alias("hash"))
    got = common.map_batches(found.join(F.broadcast(first), ["id", "hash"]).select("id", "text", "label"), run, schema).dropDuplicates(["id"]).toArrow()
    rows = zip(got["id"].to_pylist(), got["label"].to_pylist(), got["at"], got["weight"], strict=True)
    return sorted(((i, y, np.asarray(a.values), np.asarray(w.values)) for i, y, a, w in rows), key=lambda r: (r[0], r[2].tobytes()[:64]))
