"""Quality by nearest neighbours: labelled latent-semantic vectors vote by similarity.

Texts become hashed n-gram vectors (square-root weights, inverse document
frequencies of the sample), projected by a truncated singular value decomposition
of the sample.  Every document is compared with every labelled vector, exactly, in
blocks; its K nearest vote with weights that grow with cosine similarity.

The sample is bounded (SAMPLE rows, the smallest id hashes among the rows learnt
from), and with it what is broadcast.  A text without features has no direction and
gets the sample's share of good labels; without labels every score is 0.5.  Null
counts as empty; an empty table gives an empty result; repeated rows give repeated
results; only the text enters a score.
"""

from __future__ import annotations

from dataclasses import dataclass

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from textloom.llm import common, ngram_model

SAMPLE = 2500
DIMS, CHARS, WORDS = 1 << 13, (1, 2, 3), (1,)
RANK, K, SHARPNESS, BLOCK = 48, 31, 12.0, 512
GOOD = 0.7


@dataclass
class Neighbours:
    projection: np.ndarray  # DIMS x RANK, idf folded in
    vectors: np.ndarray  # labelled rows x RANK, of length 1
    labels: np.ndarray
    prior: float

    def project(self, texts: list[str]) -> np.ndarray:
        out = np.zeros((len(texts), self.projection.shape[1]), np.float32)
        for i, t in enumerate(texts):
            at, weight = ngram_model.sparse(t, DIMS, CHARS, WORDS)
            if len(at):
                out[i] = np.sqrt(weight) @ self.projection[at]
        size = np.linalg.norm(out, axis=1, keepdims=True)
        return np.divide(out, size, out=np.zeros_like(out), where=size > 1e-12)

    def scores(self, texts: list[str]) -> list[float]:
        if not len(self.vectors):
            return [self.prior] * len(texts)
        v = self.project(texts)
        k = min(K, len(self.vectors))
        best = np.full((len(texts), 0), -2.0, np.float32)
        best_label = np.empty((len(texts), 0), np.float32)
        for a in range(0, len(self.vectors), BLOCK):  # the K best so far and this block's
            near = np.hstack([best, v @ self.vectors[a : a + BLOCK].T])
            label = np.hstack([best_label, np.broadcast_to(self.labels[a : a + BLOCK], (len(texts), len(self.labels[a : a + BLOCK])))])
            if near.shape[1] > k:
                top = np.argpartition(-near, k - 1, axis=1)[:, :k]
                near, label = np.take_along_axis(near, top, 1), np.take_along_axis(label, top, 1)
            best, best_label = near, label
        weight = np.exp(SHARPNESS * (best.astype(float) - 1))
        score = (weight * best_label).sum(axis=1) / weight.sum(axis=1)
        empty = ~v.any(axis=1)
        return np.where(empty, self.prior, score).clip(0, 1).tolist()


def fit(rows: list[tuple[int, int, np.ndarray, np.ndarray]]) -> Neighbours:
    none = Neighbours(np.zeros((DIMS, 1), np.float32), np.zeros((0, 1), np.float32), np.zeros(0, np.float32), 0.5)
    if not rows:
        return none
    y = np.array([r[1] for r in rows], np.float32)
    x = np.zeros((len(rows), DIMS), np.float32)
    for i, (_, _, at, weight) in enumerate(rows):
        x[i, at] = np.sqrt(weight)
    seen = (x > 0).sum(axis=0)
    idf = np.log((1 + len(rows)) / (1 + seen)).astype(np.float32) + 0.3
    x *= idf
    size = np.linalg.norm(x, axis=1, keepdims=True)
    x = np.divide(x, size, out=x, where=size > 0)
    # Randomised range finder with power iterations, then an exact small decomposition.
    rank = min(RANK, *x.shape)
    q = np.linalg.qr(x @ np.random.default_rng(5).standard_normal((DIMS, min(rank + 16, len(rows)))).astype(np.float32))[0]
    for _ in range(4):
        q = np.linalg.qr(x @ np.linalg.qr(x.T @ q)[0])[0]
    basis = np.linalg.svd(q.T @ x, full_matrices=False)[2][:rank].T
    model = Neighbours(np.ascontiguousarray(basis * idf[:, None]).astype(np.float32), np.zeros((0, rank), np.float32), y, float(y.mean()))
    vectors = x @ basis
    size = np.linalg.norm(vectors, axis=1, keepdims=True)
    model.vectors = np.divide(vectors, size, out=np.zeros_like(vectors), where=size > 1e-12).astype(np.float32)
    return model


def train(docs: DataFrame, labels: DataFrame, limit: int = SAMPLE, label_col: str = "quality", id_col: str = "doc_id", text_col: str = "text") -> Neighbours:
    common.tune(docs.sparkSession)
    sample = ngram_model.labelled_sample(docs, labels, label_col, limit, id_col)
    return fit(ngram_model.gather(docs, sample, DIMS, CHARS, WORDS, id_col, text_col))


def score(docs: DataFrame, model: Neighbours, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """(id, score) of every whole text."""
    shipped = docs.sparkSession.sparkContext.broadcast(model)

    def run(batch: pa.RecordBatch) -> pa.RecordBatch:
        return common.rows({"id": pa.int64(), "score": pa.float64()}, id=batch.column(0), score=shipped.value.scores(common.texts(batch.column(1))))

    return common.map_batches(common.id_text(docs, id_col, text_col), run, "id long, score double").withColumnRenamed("id", id_col)


def held_out(id_col: str = "doc_id"):
    return F.crc32(F.col(id_col).cast("string").cast("binary")) % 4 == 2


def op9_knn_quality(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs, labels = common.table(spark, sf_dir, "documents"), common.table(spark, sf_dir, "labels")
    model = train(docs, labels.where(~held_out()))
    return score(docs, model).select("doc_id", held_out().alias("held_out"), "score", (F.col("score") >= GOOD).cast("int").alias("predicted"))
