"""Spelling variant grouping by full neighbourhood generation.

Words are counted natively.  For each word of the vocabulary all distinct deletions,
replacements and insertions of one code point over the observed alphabet are generated,
and hash-joined to the vocabulary: what meets there is exactly one edit away, so no
distance is computed.

Generation.  A word's hash is a polynomial in its code points, so the hashes of its whole
neighbourhood follow from prefix and suffix sums, as whole arrays.  They are looked up in
a Bloom filter of the vocabulary (two bits a word, ``FILTER_BITS`` to a bound of
``FILTER_MOST`` bits); only neighbours that may exist become strings and are shuffled.
A filter that is fuller lets more of them pass to the join, which alone decides.

A word's form is its commonest near word, if that is ``RATIO`` times as common; its root
is where forms lead to.  Counts grow by RATIO with each step, so chains are short and
acyclic; they are followed by doubling, each round a stored table.

Null texts have no words; a null id counts as an empty string; repeated rows count as
often as they come; whole texts are read; an empty table gives an empty result; further
columns are ignored.  The vocabulary holds each word once, and a word has as many near
words as its length and the alphabet allow at most, so no key is hot.
"""

from __future__ import annotations

from functools import lru_cache

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from textloom.llm import common

#: Latin letters, as contiguous ranges; the observed alphabet is a part of it.
RUN = r"[A-Za-zÀ-ÿ]+"
UPPER, LOWER = "ABCDEFGHIJKLMNOPQRSTUVWXYZ", "abcdefghijklmnopqrstuvwxyz"
#: In one of SLIPS runs a letter is dropped (the slips of the pen that the query is to find).
SLIPS = 199
LEAST_CHARS, LEAST_COUNT, RATIO = 6, 5, 5
#: Bits of the filter for each word, as a power of two, and of the whole filter at most (32 MB).
FILTER_BITS, FILTER_MOST, FILTER_LEAST = 5, 28, 16
BASE, SPREAD = np.uint64(0x9E3779B97F4A7C15), np.uint64(0xD6E8FEB86659FD93)


def slipped(run: Column, id_text: Column, slips: int = SLIPS) -> Column:
    """The run, without the code point h % length where ``slips`` divides h, its hash with the id."""
    h = F.crc32(F.concat(F.coalesce(id_text, F.lit("")), F.lit(":"), run))
    place = (h % F.length(run)).cast("int")
    return F.when(h % slips == 0, F.concat(F.substring(run, F.lit(1), place), F.substring(run, place + 2, F.length(run)))).otherwise(run)


def word_counts(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text", slips: int | None = None, least_chars: int = LEAST_CHARS, least_count: int = LEAST_COUNT) -> DataFrame:
    """(word, n) of the words of all whole texts that are long and common enough."""
    runs = common.id_text(docs, id_col, text_col).select(F.col("id").cast("string").alias("id"), F.explode(F.regexp_extract_all("text", F.lit(RUN), 0)).alias("run"))
    run = F.translate("run", UPPER, LOWER)
    lowered = runs.select("id", run.alias("run")).where(F.length("run") >= least_chars)
    word = slipped(F.col("run"), F.col("id"), slips) if slips else F.col("run")
    words = lowered.select(word.alias("word")).where(F.length("word") >= least_chars)
    return words.groupBy("word").agg(F.count("*").alias("n")).where(F.col("n") >= least_count)


# ---------------------------------------------------------------- neighbourhoods


@lru_cache(maxsize=1)
def values() -> np.ndarray:
    """A 64-bit value for each code point of the basic plane."""
    return common.mix64(np.arange(1, 0x10001, dtype=np.uint64) * SPREAD)


def powers(n: int) -> np.ndarray:
    out = np.full(n, BASE)
    out[:1] = 1
    return np.multiply.accumulate(out)


def hashes(codes: np.ndarray) -> np.ndarray:
    """Hashes of words of one length, given as rows of code points."""
    return (values()[codes] * powers(codes.shape[1])).sum(axis=1, dtype=np.uint64)


def cells(h: np.ndarray, bits: int) -> tuple[np.ndarray, np.ndarray]:
    """The two cells of the filter that a hash sets."""
    return (h * SPREAD) >> np.uint64(64 - bits), (common.mix64(h) >> np.uint64(64 - bits))


def by_length(words: list[str]) -> dict[int, np.ndarray]:
    """Places of the words of each length."""
    size = np.array([len(w) for w in words], np.int64)
    return {int(n): np.flatnonzero(size == n) for n in np.unique(size)}


def code_points(words: list[str], length: int) -> np.ndarray:
    return np.frombuffer("".join(words).encode("utf-32-le", "surrogatepass"), "<u4").astype(np.int64).reshape(-1, length)


def possible(words: list[str], alphabet: str, filled: np.ndarray, bits: int) -> list[list[str]]:
    """Of each word's distinct deletions, replacements and insertions those that the filter doesn't rule out."""
    out: list[list[str]] = [[] for _ in words]
    letters = code_points([alphabet], len(alphabet))[0] if alphabet else np.empty(0, np.int64)
    value = values()[letters]
    for n, places in by_length(words).items():
        some = [words[i] for i in places]
        codes, power = code_points(some, n), powers(n + 1)
        terms = values()[codes] * power[:n]
        zero = np.zeros((len(some), 1), np.uint64)
        before = np.concatenate([zero, np.cumsum(terms, axis=1, dtype=np.uint64)], axis=1)  # of the characters up to place j
        total = before[:, -1:]
        left = values()[codes[:, 1:]] * power[: n - 1]  # each character one place to the left
        sunk = np.concatenate([zero, np.cumsum(left, axis=1, dtype=np.uint64)], axis=1)
        dropped = before[:, :n] + sunk[:, -1:] - sunk
        replaced = (total - terms)[:, :, None] + power[:n][None, :, None] * value
        inserted = (before + (total - before) * BASE)[:, :, None] + power[:, None] * value
        for kind, grid in ((0, dropped), (1, replaced), (2, inserted)):
            flat = grid.reshape(-1)
            first = (flat * SPREAD) >> np.uint64(64 - bits)
            hit = np.flatnonzero(filled[first >> np.uint64(3)] >> (np.uint64(7) - (first & np.uint64(7))).astype(np.uint8) & 1)
            second = cells(flat[hit], bits)[1]
            hit = hit[(filled[second >> np.uint64(3)] >> (np.uint64(7) - (second & np.uint64(7))).astype(np.uint8) & 1) > 0]
            for at in hit.tolist():
                if kind == 0:
                    word, place = divmod(at, n)
                    w = some[word]
                    near = w[:place] + w[place + 1 :]
                else:
                    rest, letter = divmod(at, len(alphabet))
                    word, place = divmod(rest, n + kind - 1)
                    w = some[word]
                    near = w[:place] + alphabet[letter] + w[place + 2 - kind :]
                if near != w:
                    out[places[word]].append(near)
    return [list(dict.fromkeys(x)) for x in out]


def filter_of(words: DataFrame, count: int) -> tuple[np.ndarray, int]:
    """(bits of the filter, how many as a power of two): its size follows the vocabulary up to a bound."""
    bits = min(FILTER_MOST, max(FILTER_LEAST, (count << FILTER_BITS).bit_length()))

    def run(batch: pa.RecordBatch) -> pa.RecordBatch:
        some = batch.column(0).to_pylist()
        h = np.concatenate([np.empty(0, np.uint64), *(hashes(code_points([some[i] for i in places], n)) for n, places in by_length(some).items() if n)])
        return common.rows({"cell": pa.int64()}, cell=np.concatenate(cells(h, bits)).astype(np.int64))

    return common.bit_set(common.map_batches(words.select("word"), run, "cell long"), bits), bits


def near_words(vocabulary: DataFrame) -> DataFrame:
    """(word, n, near, near_n): all pairs of words of (word, n) that are one edit apart, both ways round."""
    spark = vocabulary.sparkSession
    # Bounded by the letters that RUN allows.
    alphabet = "".join(sorted(r[0] for r in vocabulary.select(F.explode(F.split("word", "")).alias("c")).where("c != ''").distinct().collect()))
    filled, bits = filter_of(vocabulary, vocabulary.count())
    shipped = spark.sparkContext.broadcast(filled)

    def run(batch: pa.RecordBatch) -> pa.RecordBatch:
        some = batch.column(0).to_pylist()
        near = possible(some, alphabet, shipped.value, bits)
        ends = np.cumsum([0, *map(len, near)])
        place = np.repeat(np.arange(len(some)), np.diff(ends))
        found = pa.array([x for row in near for x in row], pa.string())
        return pa.RecordBatch.from_arrays([batch.column(0).take(pa.array(place)), batch.column(1).take(pa.array(place)), found], names=["word", "n", "near"])

    candidates = common.map_batches(vocabulary.select("word", "n"), run, "word string, n long, near string")
    return candidates.join(vocabulary.select(F.col("word").alias("near"), F.col("n").alias("near_n")), "near").select("word", "n", "near", "near_n")


# ---------------------------------------------------------------- forms and roots


def with_forms(vocabulary: DataFrame, ratio: int = RATIO) -> DataFrame:
    """(word, n, n_near, form, form_n) of every word; form is null where no near word is common enough."""
    best = F.min(F.when(F.col("near").isNotNull(), F.struct((-F.col("near_n")).alias("rest"), F.col("near").alias("form"))))
    alone = vocabulary.select("word", "n", F.lit(None).cast("string").alias("near"), F.lit(None).cast("long").alias("near_n"))
    each = near_words(vocabulary).unionByName(alone).groupBy("word", "n").agg(F.count("near").alias("n_near"), best.alias("best"))
    fits = -F.col("best.rest") >= ratio * F.col("n")
    return each.select("word", "n", "n_near", F.when(fits, F.col("best.form")).alias("form"), F.when(fits, -F.col("best.rest")).alias("form_n"))


def roots(forms: DataFrame) -> DataFrame:
    """(word, root) of the words that have a form, by doubling: each round twice as many steps."""
    spark = forms.sparkSession
    hop = common.store(forms.where("form is not null").select("word", F.col("form").alias("root")), common.shared_dir(spark))
    while True:
        beyond = hop.select(F.col("word").alias("root"), F.col("root").alias("beyond"))
        path = common.shared_dir(spark)
        moved = common.store(hop.join(beyond, "root", "left").select("word", F.coalesce("beyond", "root").alias("root"), F.col("beyond").isNotNull().alias("moved")), path)
        hop = moved.select("word", "root")
        if moved.where("moved").isEmpty():
            return hop


def group_variants(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text", slips: int | None = None, least_chars: int = LEAST_CHARS, least_count: int = LEAST_COUNT, ratio: int = RATIO) -> DataFrame:
    """(word, form, root, n, n_near, form_n) of every word; its stored tables stay until ``release``."""
    spark = docs.sparkSession
    common.tune(spark)
    with common.few_files(spark):
        vocabulary = common.store(word_counts(docs, id_col, text_col, slips, least_chars, least_count), common.shared_dir(spark))
        forms = common.store(with_forms(vocabulary, ratio), common.shared_dir(spark))
        found = forms.join(roots(forms), "word", "left")
    return found.select("word", "form", F.coalesce("root", "word").alias("root"), "n", "n_near", "form_n")


def op12_spelling_variants(spark: SparkSession, sf_dir: str) -> DataFrame:
    return group_variants(common.table(spark, sf_dir, "documents"), slips=SLIPS)
