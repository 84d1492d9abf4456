"""Quality rules: counted base rules and a calibrated n-gram logistic regression.

The model is trained on a bounded sample of labelled rows (SAMPLE, the smallest id
hashes), by Adagrad over hashed word and character n-grams, then calibrated by
Platt's method on rows it was not trained on.  Scoring is a table look-up per
n-gram, in Arrow batches, against the fixed threshold KEEP.

Whole texts are read; null counts as empty: no words, so the base rules fail.
Without labels, or with one class only, the model keeps everything.  An empty table
gives an empty result; repeated rows give repeated results; further columns are
ignored.
"""

from __future__ import annotations

from dataclasses import dataclass

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from textloom.llm import common, ngram_model

#: Labelled rows the model is fitted on at most; their features are what the driver holds.
SAMPLE = 3000
DIMS, CHARS, WORDS = 1 << 18, (3, 4), (1, 2)
EPOCHS, RATE, DECAY = 6, 2.0, 1e-6
#: Documents whose calibrated probability of good quality is lower are rejected.
KEEP = 0.5
MIN_WORDS, MAX_REPEAT_PERCENT = 50, 50
SYMBOLS, SPACES = "#*$%&|<>", "\x20\t\n\x0b\x0c\r"


@dataclass
class Model:
    weights: np.ndarray
    bias: float
    slope: float
    offset: float

    def probability(self, text: str) -> float:
        if not self.slope:  # whatever the text: it need not be cut
            return float(sigmoid(self.offset))
        margin = self.bias
        for f in ngram_model.families(text, DIMS, CHARS, WORDS):
            if len(f):
                margin += float(self.weights[f].mean())
        return float(sigmoid(self.slope * margin + self.offset))


#: Keeps every text.
NEUTRAL = Model(np.zeros(DIMS, np.float32), 0.0, 0.0, 30.0)


def sigmoid(x):
    return 1 / (1 + np.exp(-np.clip(x, -40, 40)))


def fit(rows: list[tuple[int, int, np.ndarray, np.ndarray]]) -> Model:
    """Adagrad on four fifths of the rows, Platt's calibration on the others."""
    y = np.array([r[1] for r in rows], float)
    if len(set(y.tolist())) < 2:
        return NEUTRAL
    order = np.random.default_rng(7).permutation(len(rows))
    hold = order[::5] if len(rows) >= 50 else order
    train = np.setdiff1d(order, hold) if len(rows) >= 50 else order
    train = np.random.default_rng(8).permutation(train)
    weights, grads, bias, bias_grad = np.zeros(DIMS), np.full(DIMS, 1e-6), 0.0, 1e-6
    share = np.array([np.mean(y[train] == c) or 1.0 for c in (0, 1)])

    def margins(which) -> np.ndarray:
        return bias + np.array([weights[rows[i][2]] @ rows[i][3] if len(rows[i][2]) else 0.0 for i in which])

    for _ in range(EPOCHS):
        for k in range(0, len(train), 32):
            batch = train[k : k + 32]
            error = (sigmoid(margins(batch)) - y[batch]) / (2 * share[y[batch].astype(int)]) / len(batch)
            at = np.concatenate([rows[i][2] for i in batch])
            step = np.concatenate([rows[i][3] * e for i, e in zip(batch, error, strict=True)])
            distinct, back = np.unique(at, return_inverse=True)
            g = np.bincount(back, step, len(distinct)) + DECAY * weights[distinct]
            grads[distinct] += g * g
            weights[distinct] -= RATE * g / np.sqrt(grads[distinct])
            g = float(error.sum())
            bias_grad += g * g
            bias -= 0.1 * g / bias_grad**0.5
    m, target = margins(hold), y[hold]
    up, down = target.sum(), len(target) - target.sum()
    soft = np.where(target > 0, (up + 1) / (up + 2), 1 / (down + 2))
    slope, offset = 1.0, 0.0
    for _ in range(50):  # Newton's method on the two calibration parameters
        p = sigmoid(slope * m + offset)
        w = np.maximum(p * (1 - p), 1e-9)
        g = np.array([(p - soft) @ m, (p - soft).sum()]) + [1e-3 * (slope - 1), 0]
        h = np.array([[w @ (m * m) + 1e-3, w @ m], [w @ m, w.sum()]]) + 1e-9 * np.eye(2)
        d = np.linalg.solve(h, g)
        d *= min(1.0, 2 / max(np.abs(d).max(), 1e-12))
        slope, offset = slope - d[0], offset - d[1]
    return Model(weights.astype(np.float32), float(bias), float(slope), float(offset))


def train(docs: DataFrame, labels: DataFrame, limit: int = SAMPLE, label_col: str = "quality", id_col: str = "doc_id", text_col: str = "text") -> Model:
    common.tune(docs.sparkSession)
    sample = ngram_model.labelled_sample(docs, labels, label_col, limit, id_col)
    return fit(ngram_model.gather(docs, sample, DIMS, CHARS, WORDS, id_col, text_col))


def base_counts(text: str) -> tuple[int, int, int, int, int]:
    """n_words, word_chars, n_symbols, n_dup_lines, n_repeat_words of a whole text."""
    raw = text.encode("utf-8", "surrogatepass")
    words = common.word_hashes(raw)
    n = len(words)
    repeated = 0
    if n > 3:
        windows = common.window_hashes(words, 3)
        _, back, count = np.unique(windows, return_inverse=True, return_counts=True)
        at = np.flatnonzero(count[back] > 1)
        if len(at):
            cover = np.zeros(n, bool)
            for k in range(3):
                cover[at + k] = True
            repeated = int(cover.sum())
    lines = [x for x in text.split("\n") if x.strip(SPACES)]
    return n, len(text) - sum(map(text.count, SPACES)), sum(map(text.count, SYMBOLS)), len(lines) - len(set(lines)), repeated


def judge(docs: DataFrame, model: Model, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """(id, n_words, word_chars, n_symbols, n_dup_lines, n_repeat_words, base_failed, kept, quality)."""
    names = ["n_words", "word_chars", "n_symbols", "n_dup_lines", "n_repeat_words"]
    schema = {"id": pa.int64(), **{n: pa.int64() for n in names}, "base_failed": pa.bool_(), "kept": pa.bool_(), "quality": pa.float64()}
    shipped = docs.sparkSession.sparkContext.broadcast(model)  # a table of fixed size

    def run(batch: pa.RecordBatch) -> pa.RecordBatch:
        texts, m = common.texts(batch.column(1)), shipped.value
        counts = [base_counts(t) for t in texts]
        failed = [c[0] < MIN_WORDS or 100 * c[4] > MAX_REPEAT_PERCENT * c[0] for c in counts]
        p = [m.probability(t) for t in texts]
        columns = dict(zip(names, zip(*counts, strict=True), strict=True))
        return common.rows(schema, id=batch.column(0), **columns, base_failed=failed, kept=[not f and x >= KEEP for f, x in zip(failed, p, strict=True)], quality=p)

    ddl = "id long, " + ", ".join(f"{n} long" for n in names) + ", base_failed boolean, kept boolean, quality double"
    return common.map_batches(common.id_text(docs, id_col, text_col), run, ddl).withColumnRenamed("id", id_col)


def keep_good(docs: DataFrame, model: Model, text_col: str = "text") -> DataFrame:
    """All columns of the rows that pass both the base rules and the model."""
    common.tune(docs.sparkSession)
    shipped = docs.sparkSession.sparkContext.broadcast(model)

    @F.pandas_udf("boolean")
    def good(s):
        def one(t):
            n, *_, repeated = base_counts(t or "")
            return n >= MIN_WORDS and 100 * repeated <= MAX_REPEAT_PERCENT * n and shipped.value.probability(t or "") >= KEEP

        return s.map(one)

    return docs.where(good(F.col(text_col)))


def op8_quality_rules(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = common.table(spark, sf_dir, "documents")
    return judge(docs, train(docs, common.table(spark, sf_dir, "labels")))
