"""Subword tokenizers: training, Arrow-batched encoding, decoding.

Training counts the pieces of all texts by a distributed group-by and learns from that
table on the cluster (see ``vocabulary``); pieces are never dropped unless
``min_piece_count`` is given.  Encoding merges by a queue over a linked list, so that one
very long piece takes time that grows with its length and not with its square.
"""

from __future__ import annotations

import json
from collections.abc import Iterator
from dataclasses import dataclass, field

import numpy as np
import pandas as pd
import pyarrow as pa
import pyarrow.compute as pc
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from textloom.functions import text as T
from textloom.operators import vocabulary
from textloom.operators.storage import read_text, shared_dir, small_batches, store, temporary, write_text
from textloom.operators.vocabulary import best_split

SPECIALS = ["<pad>", "<unk>", "<bos>", "<eos>"]
ALGORITHMS = ("bpe", "wordpiece", "unigram")
UNK = "<unk>"
MAX_WORD = 100
UNKNOWN_PENALTY = 10.0
#: Pieces that are coded at once, and distinct pieces a worker remembers.
SLICE_PIECES, KNOWN_PIECES = 1 << 18, 100_000


def byte_alphabet() -> dict[int, str]:
    """Printable stand-ins for bytes: printable Latin-1 is itself, the others follow from 256."""
    own = [b for b in range(256) if 0x21 <= b <= 0x7E or 0xA1 <= b <= 0xFF and b != 0xAD]
    rest = [b for b in range(256) if b not in own]
    return {b: chr(b) for b in own} | {b: chr(256 + i) for i, b in enumerate(rest)}


_BYTES = byte_alphabet()
_CHARS = {c: b for b, c in _BYTES.items()}


def to_bytes_alphabet(piece: str) -> str:
    return "".join(_BYTES[b] for b in piece.encode("utf-8", "surrogatepass"))


def byte_pretokens(c: Column) -> Column:
    """Byte-level pre-tokens in the printable alphabet, in the JVM: each byte as a Latin-1 character, then translated."""
    moved = [b for b, x in _BYTES.items() if x != chr(b)]
    own, stand_in = "".join(map(chr, moved)), "".join(_BYTES[b] for b in moved)
    return F.transform(T.pretokens(c), lambda p: F.translate(F.decode(F.encode(p, "UTF-8"), "ISO-8859-1"), own, stand_in))


@dataclass
class Model:
    algorithm: str
    vocab: dict[str, int]
    merges: list[tuple[str, str]] = field(default_factory=list)
    scores: dict[str, float] = field(default_factory=dict)
    specials: list[str] = field(default_factory=lambda: list(SPECIALS))

    def __post_init__(self) -> None:
        self.ranks = {m: i for i, m in enumerate(self.merges)}
        self.unk = self.vocab.get(UNK, 0)
        self.worst = min(self.scores.values(), default=0.0) - UNKNOWN_PENALTY
        self._known: dict[str, list[int]] = {}
        self.tokens = {i: t for t, i in self.vocab.items()}

    def __getstate__(self):
        return {"algorithm": self.algorithm, "vocab": self.vocab, "merges": self.merges, "scores": self.scores, "specials": self.specials}

    def __setstate__(self, state):
        self.__dict__.update(state)
        self.__post_init__()

    def vocab_size(self) -> int:
        return len(self.vocab)

    def piece_ids(self, piece: str) -> list[int]:
        ids = self._known.get(piece)
        if ids is None:
            ids = {"bpe": self._bpe, "wordpiece": self._wordpiece, "unigram": self._unigram}[self.algorithm](piece)
            if len(self._known) < KNOWN_PIECES:
                self._known[piece] = ids
        return ids

    def _bpe(self, piece: str) -> list[int]:
        parts = vocabulary.queued_merges(list(to_bytes_alphabet(piece)), lambda a, b: self.ranks.get((a, b)), lambda _, a, b: a + b)
        return [self.vocab.get(p, self.unk) for p in parts]

    def _wordpiece(self, piece: str) -> list[int]:
        if len(piece) > MAX_WORD:
            return [self.unk]
        out, start = [], 0
        while start < len(piece):
            for end in range(len(piece), start, -1):
                token = self.vocab.get(("##" if start else "") + piece[start:end])
                if token is not None:
                    break
            else:
                return [self.unk]
            out.append(token)
            start = end
        return out

    def _unigram(self, piece: str) -> list[int]:
        return [self.vocab.get(t, self.unk) for t in best_split(piece, self.scores, self.worst)]

    def to_json(self) -> str:
        return json.dumps(self.__getstate__(), ensure_ascii=False)

    def save(self, path: str, spark: SparkSession | None = None) -> None:
        """To a local file, or with a session to any address Spark accepts."""
        if spark:
            return write_text(spark, path, self.to_json())
        with open(path, "w") as f:
            f.write(self.to_json())


def load(path: str, spark: SparkSession | None = None) -> Model:
    if spark:
        state = json.loads(read_text(spark, path))
    else:
        with open(path) as f:
            state = json.load(f)
    return Model(state["algorithm"], state["vocab"], [tuple(m) for m in state["merges"]], state["scores"], state["specials"])


# ---------------------------------------------------------------- training


def piece_pattern(algorithm: str) -> str:
    return T.GPT2 if algorithm == "bpe" else T.WORDPIECE


def piece_counts(df: DataFrame, algorithm: str, text_col: str = "text") -> DataFrame:
    """(piece, n) over all texts."""
    pieces = T.pretokens(F.coalesce(F.col(text_col), F.lit("")), piece_pattern(algorithm))
    return df.select(F.explode(pieces).alias("piece")).groupBy("piece").agg(F.count("*").alias("n"))


def spelled(piece: str, algorithm: str) -> list[str]:
    """The symbols that training begins with."""
    return list(to_bytes_alphabet(piece)) if algorithm == "bpe" else [*piece[:1], *("##" + c for c in piece[1:])]


def alphabet(counts: DataFrame, algorithm: str) -> list[str]:
    """The symbols of all pieces: as many as bytes, or as characters at most."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        seen: set[str] = set()
        for batch in batches:
            for piece in batch.column(0).to_pylist():
                seen.update(spelled(piece, algorithm))
        yield pa.RecordBatch.from_pydict({"symbol": pa.array(sorted(seen), pa.string())})

    found = {r["symbol"] for r in counts.select("piece").mapInArrow(run, "symbol string").distinct().collect()}
    return sorted(found, key=lambda t: (t.startswith("##"), t))


def as_symbols(counts: DataFrame, algorithm: str, vocab: dict[str, int]) -> DataFrame:
    """(symbols, n) of the pieces that have two symbols or more."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            ids = pa.array([[vocab[t] for t in spelled(p, algorithm)] for p in batch.column(0).to_pylist()], pa.list_(pa.int32()))
            yield pa.RecordBatch.from_arrays([ids, batch.column(1)], names=["symbols", "n"])

    return counts.select("piece", "n").mapInArrow(run, "symbols array<int>, n long").where(F.size("symbols") > 1)


def train(df: DataFrame, algorithm: str = "bpe", vocab_size: int = 32000, min_frequency: int = 2, specials: list[str] | None = None, text_col: str = "text", min_piece_count: int = 1) -> Model:
    """Train on a column of texts; pieces rarer than ``min_piece_count`` are left out (none by default).

    Null and empty texts have no pieces; an empty table gives a vocabulary of special tokens.
    """
    algorithm, specials = algorithm.lower(), specials or list(SPECIALS)
    if algorithm not in ALGORITHMS:
        raise ValueError(f"unknown algorithm {algorithm!r}")
    spark = df.sparkSession
    with temporary(spark):
        counts = store(piece_counts(df, algorithm, text_col).where(F.col("n") >= min_piece_count), shared_dir(spark))
        if algorithm == "unigram":
            scores = vocabulary.unigram_rounds(counts, vocab_size, specials)
            order = [*specials, *sorted((t for t in scores if t not in specials), key=lambda t: (-scores[t], t))]
            return Model("unigram", {t: i for i, t in enumerate(order)}, [], scores, specials)
        vocab = {t: i for i, t in enumerate(dict.fromkeys([*specials, *alphabet(counts, algorithm)]))}
        words = store(as_symbols(counts, algorithm, vocab), shared_dir(spark))
        merges = vocabulary.merge_rounds(words, vocab, vocab_size, min_frequency, (lambda a, b: a + b) if algorithm == "bpe" else (lambda a, b: a + b[2:]))
        return Model(algorithm, vocab, merges if algorithm == "bpe" else [], {}, specials)


def train_from_files(spark: SparkSession, paths: list[str], **options) -> Model:
    return train(spark.read.text(paths).withColumnRenamed("value", "text"), **options)


# ---------------------------------------------------------------- use


def encode(df: DataFrame, model: Model, text_col: str = "text", out: str = "tokens") -> DataFrame:
    """Add ``tokens: array<int>``: pieces are cut in the JVM, distinct ones coded once per worker.

    Pieces and ids stay in Arrow, some SLICE_PIECES of them at a time, so a worker's memory
    does not grow with its batch; only the distinct pieces of a slice become Python strings.
    """
    small_batches(df.sparkSession)
    shipped = df.sparkSession.sparkContext.broadcast(model)

    @F.arrow_udf("array<int>")
    def ids(pieces: pa.Array) -> pa.Array:
        m = shipped.value
        ends = np.append(0, np.cumsum(pc.fill_null(pc.list_value_length(pieces), 0).to_numpy(zero_copy_only=False)))
        done, at = [], 0
        while at < len(pieces):
            to = max(at + 1, int(np.searchsorted(ends, ends[at] + SLICE_PIECES, "right")) - 1)
            done.append(coded(m, pieces.slice(at, to - at)))
            at = to
        return pa.concat_arrays(done) if done else pa.array([], pa.list_(pa.int32()))

    return df.withColumn(out, ids(T.pretokens(F.coalesce(F.col(text_col), F.lit("")), piece_pattern(model.algorithm))))


def coded(model: Model, pieces: pa.ListArray) -> pa.ListArray:
    """The ids of each list of pieces; each distinct piece is looked up once."""
    counts = pc.fill_null(pc.list_value_length(pieces), 0).to_numpy(zero_copy_only=False)
    named = pieces.flatten().dictionary_encode()
    known = [model.piece_ids(p) for p in named.dictionary.to_pylist()]
    table = np.fromiter((i for ids in known for i in ids), np.int32)
    sizes = np.fromiter(map(len, known), np.int64, len(known))
    starts = np.cumsum(sizes) - sizes
    which = named.indices.to_numpy(zero_copy_only=False)
    n = sizes[which]
    ends = np.append(0, np.cumsum(n))
    values = table[np.arange(ends[-1]) + np.repeat(starts[which] - ends[:-1], n)] if len(table) else table
    return pa.ListArray.from_arrays(pa.array(ends[np.append(0, np.cumsum(counts))], pa.int32()), pa.array(values, pa.int32()))


def vocab_table(spark: SparkSession, model: Model) -> DataFrame:
    return spark.createDataFrame(sorted(model.vocab.items(), key=lambda x: x[1]), "token string, id int")


def decode_col(ids: Column, model: Model) -> Column:
    """Tokens joined by spaces, special and unknown ids left out; null stays null."""
    tokens = {i: t for i, t in model.tokens.items() if t not in model.specials}

    @F.pandas_udf("string")
    def run(s: pd.Series) -> pd.Series:
        return s.map(lambda x: None if x is None else " ".join(t for i in x if (t := tokens.get(int(i))) is not None))

    return run(ids)


def decode_text(ids: Column, model: Model) -> Column:
    """The text itself: bytes for BPE, words for the others."""
    specials, algorithm = set(model.specials), model.algorithm
    tokens = {i: bytes(_CHARS[c] for c in t) if algorithm == "bpe" else t for i, t in model.tokens.items() if t not in specials}

    @F.pandas_udf("string")
    def run(s: pd.Series) -> pd.Series:
        def one(x) -> str | None:
            if x is None:
                return None
            parts = [t for i in x.tolist() if (t := tokens.get(i)) is not None]
            if algorithm == "bpe":
                return b"".join(parts).decode("utf-8", "replace")
            if algorithm == "wordpiece":
                return " ".join(parts).replace(" ##", "")
            return "".join(parts)

        return s.map(one)

    return run(ids)


def token_stats(df: DataFrame, vocab_size: int, text_col: str = "text", tokens_col: str = "tokens") -> DataFrame:
    """One row: documents, tokens, characters, vocabulary, tokens per document, characters per token."""
    n, tokens, chars = F.count("*"), F.coalesce(F.sum(F.size(tokens_col)), F.lit(0)).cast("long"), F.coalesce(F.sum(F.length(text_col)), F.lit(0)).cast("long")
    return df.agg(
        n.alias("total_documents"),
        tokens.alias("total_tokens"),
        chars.alias("total_chars"),
        F.lit(vocab_size).alias("vocab_size"),
        F.coalesce(F.try_divide(tokens.cast("double"), n.cast("double")), F.lit(0.0)).alias("avg_tokens_per_doc"),
        F.coalesce(F.try_divide(chars.cast("double"), tokens.cast("double")), F.lit(0.0)).alias("compression_ratio"),
    )
