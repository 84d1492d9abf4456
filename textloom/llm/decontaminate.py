"""Benchmark decontamination: every training passage queries a BM25 index of test items.

Index.  A term's score in an item is BM25 as a share of the item's score against
itself.  Posting lists are in item order; items stand in blocks, and every list knows
its greatest share overall and in each block.  Terms of low inverse document frequency
are in many items and worth little: their lists are not walked, but what they can add
at most is known for each block and item.  An item of which they make up more than LIFT
of THRESHOLD is walked by all its terms instead: lists of common terms hold such items
alone, so no item can loosen the bounds of the others.  Statistics (items, document frequencies,
mean and greatest length) are those of the whole benchmark, however it is divided.

Query.  A passage is two strides of words, overlapping the next by one.  Passages whose
block maxima stay below THRESHOLD in every block are done.  The others are taken by
block-max WAND: cursors stand in item order, the pivot is the first item that the
lists' maxima up to it can lift to THRESHOLD, a block whose maxima cannot is skipped as
a whole, and only in a block where both can are items scored.  Memory is a bounded number of
cells, plus a cursor for each term of a passage.

What is retrieved at or above THRESHOLD is verified: of the five-word shingles of both
the question and the answer part of the item, OVERLAP must stand in the passage.  Where
no question mark parts them, OVERLAP of the shingles of the whole item are enough.

The index's size is checked: INDEX_CHARS of item text at most are broadcast at once.  A
larger benchmark is taken in several passes by hash of id and text, one after another,
each with its result stored and its broadcast dropped before the next; none is left
out, and no score depends on the number of passes.

Null or wordless texts and items are never contaminated; whole texts are read;
repeated documents give repeated results, repeated items count once; empty tables give
empty results; further columns are ignored.
"""

from __future__ import annotations

import math
import re
from bisect import bisect_left
from collections.abc import Iterator
from dataclasses import dataclass
from functools import cached_property

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from textloom.llm import common

K1, B = 1.2, 0.75
THRESHOLD, OVERLAP, SHINGLE = 0.5, 0.8, 5
BLOCK_ITEMS = 4
#: Lists of terms of lower inverse document frequency are bounded, not walked, but for
#: items of which they can make up more than this part of THRESHOLD.
COMMON_IDF, LIFT = 2.0, 0.5
MIN_STRIDE = 32
INDEX_CHARS = 2_000_000
#: Sums by passage and block that are held at once.
CELLS = 1 << 17
#: What rounding may take from a bound.
SLACK = 1e-6
#: Bytes that part words: ASCII other than letters and digits.
_PART = bytes(0x20 if b < 0x80 and not chr(b).isalnum() else b for b in range(256))


def words_of(text: str) -> np.ndarray:
    """Hashes of the lower-cased words (letters, digits and all beyond ASCII)."""
    return common.word_hashes(text.lower().encode("utf-8", "surrogatepass").translate(_PART))


def asked(text: str) -> int:
    """Where a question ends that an answer follows; 0 if nowhere."""
    cut = text.rfind("?") + 1
    return cut if cut and words_of(text[:cut]).size and words_of(text[cut:]).size else 0


def parts_of(text: str) -> tuple[str, str]:
    """Question and answer: parted after the last question mark, else at two thirds of the words."""
    cut = asked(text)
    if cut:
        return text[:cut], text[cut:]
    ends = [m.end() for m in re.finditer(r"\S+", text)]
    cut = ends[max(0, 2 * len(ends) // 3 - 1)] if len(ends) > 1 else len(text)
    return text[:cut], text[cut:]


# ---------------------------------------------------------------- index


@dataclass
class Statistics:
    """Of the whole benchmark; ``terms`` (sorted) and ``seen`` need to hold the terms of the items at hand only."""

    items: int
    average: float
    longest: int
    terms: np.ndarray
    seen: np.ndarray

    def idf(self, terms: np.ndarray) -> np.ndarray:
        seen = self.seen[np.searchsorted(self.terms, terms)]
        return np.log(1 + (self.items - seen + 0.5) / (seen + 0.5))

    @property
    def rare_idf(self) -> float:
        """Terms from here on are walked: all, where even a term of one item is common."""
        return min(COMMON_IDF, math.log(1 + (self.items - 0.5) / 1.5))


def statistics(items: list[tuple[int, str | None]]) -> Statistics:
    words = [w for _, t in items if t and len(w := words_of(t))]
    every = np.concatenate([np.unique(w) for w in words]) if words else np.empty(0, np.uint64)
    terms, seen = np.unique(every, return_counts=True)
    return Statistics(len(words), sum(map(len, words)) / max(1, len(words)), max(map(len, words), default=0), terms, seen)


@dataclass
class Item:
    id: int
    terms: np.ndarray
    shares: np.ndarray
    question: np.ndarray
    answer: np.ndarray
    whole: np.ndarray | None  # shingles of an item that no question mark parts


@dataclass
class Index:
    items: list[Item]
    stride: int
    terms: np.ndarray  # sorted hashes of the terms whose lists are walked
    first: np.ndarray  # list of term k: places first[k] to first[k + 1] of item and share
    item: np.ndarray
    share: np.ndarray
    block_first: np.ndarray  # and of the block maxima
    block: np.ndarray
    block_best: np.ndarray
    common_item: np.ndarray  # the most that the other terms can add, per item
    common_block: np.ndarray  # and per block

    @cached_property
    def lists(self) -> tuple[list, list, list, list, dict, list, list]:
        """The same as plain lists, which cursors walk faster; made once in each worker."""
        blocks = len(self.common_block)
        term = np.repeat(np.arange(len(self.terms)), np.diff(self.block_first))
        maxima = dict(zip((term * blocks + self.block).tolist(), self.block_best.tolist(), strict=True))
        top = np.maximum.reduceat(self.share, self.first[:-1]).tolist() if len(self.terms) else []
        return self.first.tolist(), self.item.tolist(), self.share.tolist(), top, maxima, self.common_item.tolist(), self.common_block.tolist()

    def __getstate__(self):
        return {k: v for k, v in self.__dict__.items() if k != "lists"}


def build(items: list[tuple[int, str | None]], stats: Statistics | None = None) -> Index:
    stats = stats or statistics(items)
    out: list[Item] = []
    terms_of, item_of, share_of = [], [], []
    for i, text in items:
        words = words_of(text) if text else ()
        if not len(words):
            continue
        terms, count = np.unique(words, return_counts=True)
        share = stats.idf(terms) * count * (K1 + 1) / (count + K1 * (1 - B + B * len(words) / stats.average))
        share /= share.sum()
        shingles = [np.unique(common.window_hashes(words_of(p), SHINGLE)) for p in parts_of(text)]
        whole = None if asked(text) else np.unique(common.window_hashes(words, SHINGLE))
        terms_of.append(terms)
        item_of.append(np.full(len(terms), len(out)))
        share_of.append(share)
        out.append(Item(i, terms, share, *shingles, whole))
    n = len(out)
    term = np.concatenate(terms_of) if n else np.empty(0, np.uint64)
    item = np.concatenate(item_of) if n else np.empty(0, int)
    share = np.concatenate(share_of) if n else np.empty(0)
    rare = stats.idf(term) >= stats.rare_idf - 1e-12 if n else np.empty(0, bool)
    common_item = np.bincount(item[~rare], share[~rare], n).astype(float)
    lifted = common_item > LIFT * THRESHOLD
    common_item[lifted] = 0.0
    rare |= lifted[item]
    blocks = -(-n // BLOCK_ITEMS)
    common_block = np.maximum.reduceat(common_item, np.arange(0, n, BLOCK_ITEMS)) if n else np.empty(0)
    term, item, share = term[rare], item[rare], share[rare]
    order = np.lexsort((item, term))
    term, item, share = term[order], item[order], share[order]
    walked, first = np.unique(term, return_index=True)
    cell = np.searchsorted(walked, term) * max(1, blocks) + item // BLOCK_ITEMS
    cells, starts = np.unique(cell, return_index=True)
    best = np.maximum.reduceat(share, starts) if len(starts) else np.empty(0)
    block_first = np.searchsorted(cells, np.arange(len(walked) + 1) * max(1, blocks))
    return Index(out, max(MIN_STRIDE, stats.longest), walked, np.append(first, len(term)), item, share, block_first, cells % max(1, blocks), best, common_item, common_block)


# ---------------------------------------------------------------- query


def wand(index: Index, terms: list[int], least: float, live: list[int] | None = None) -> list[int]:
    """Items whose bound reaches ``least``, by block-max WAND over the lists of the given terms.

    ``live``: the blocks, in order, outside of which no item can (all if not given).
    """
    first, items, shares, top, maxima, common_item, common_block = index.lists
    blocks, most = len(common_block), max(common_block, default=0.0)
    live = list(range(blocks)) if live is None else live
    cursors, found = [], []
    for t in terms if live else ():
        at = bisect_left(items, live[0] * BLOCK_ITEMS, first[t], first[t + 1])
        if at < first[t + 1]:
            cursors.append([items[at], t, at])
    cursors.sort()

    def advance(to: int, upto: int) -> None:
        """Cursors up to ``upto`` move on to item ``to`` or beyond; those at their end go."""
        for c in cursors[:upto]:
            if c[0] < to:
                c[2] = bisect_left(items, to, c[2], first[c[1] + 1])
                c[0] = items[c[2]] if c[2] < first[c[1] + 1] else -1
        cursors[:] = sorted(c for c in cursors if c[0] >= 0)  # nearly in order already

    if most >= least:  # only below LIFT of THRESHOLD: the terms that are not walked could do it alone
        return [i for block in live for i in range(block * BLOCK_ITEMS, min(len(index.items), (block + 1) * BLOCK_ITEMS))]
    while cursors:
        total, pivot = most, 0
        for c in cursors:
            total += top[c[1]]
            pivot += 1
            if total >= least:
                break
        else:
            return found
        item = cursors[pivot - 1][0]
        while pivot < len(cursors) and cursors[pivot][0] == item:
            pivot += 1
        block = item // BLOCK_ITEMS
        k = bisect_left(live, block)
        if k == len(live):
            return found
        if live[k] > block:
            advance(live[k] * BLOCK_ITEMS, len(cursors))
            continue
        bound = common_block[block] + sum(maxima.get(c[1] * blocks + block, 0.0) for c in cursors[:pivot])
        if bound < least:
            beyond = (block + 1) * BLOCK_ITEMS
            advance(min(beyond, cursors[pivot][0]) if pivot < len(cursors) else beyond, pivot)
        else:
            # All of the block's items at once: every cursor before its end walks through it.
            begin, beyond, sums = block * BLOCK_ITEMS, (block + 1) * BLOCK_ITEMS, {}
            for c in cursors:
                if c[0] >= beyond:
                    break
                at, end = c[2], first[c[1] + 1]
                if c[0] < begin:
                    at = bisect_left(items, begin, at, end)
                while at < end and items[at] < beyond:
                    sums[items[at]] = sums.get(items[at], 0.0) + shares[at]
                    at += 1
                c[0], c[2] = items[at] if at < end else -1, at
            cursors = sorted(c for c in cursors if c[0] >= 0)
            found += sorted(i for i, total in sums.items() if common_item[i] + total >= least)
    return found


def held(values: np.ndarray, have: np.ndarray) -> np.ndarray:
    """Which values are in a sorted array."""
    if not len(have):
        return np.zeros(len(values), bool)
    return have[np.minimum(np.searchsorted(have, values), len(have) - 1)] == values


def passage_shingles(words: np.ndarray) -> np.ndarray:
    """Hashes of all runs of up to SHINGLE words: a part too short for a shingle is sought as a whole."""
    return np.unique(np.concatenate([common.window_hashes(words, k) for k in range(1, min(SHINGLE, len(words)) + 1)]))


def overlap(part: np.ndarray, have: np.ndarray) -> float:
    """Share of a part's shingles in a passage."""
    return float(held(part, have).mean()) if len(part) else 1.0


def score_of(item: Item, terms: np.ndarray) -> float:
    return float(item.shares[held(item.terms, terms)].sum())


def candidates(index: Index, words: np.ndarray) -> Iterator[tuple[int, np.ndarray, np.ndarray]]:
    """(passage number, walked terms, blocks) of the passages whose block maxima reach THRESHOLD in some blocks."""
    strides, blocks = -(-len(words) // index.stride), len(index.common_block)
    size = max(1, CELLS // blocks)
    for begin in range(0, strides, size):
        end = min(strides, begin + size)
        part = words[begin * index.stride : (end + 1) * index.stride]
        slot = np.searchsorted(index.terms, part)
        slot[slot == len(index.terms)] = 0
        at = np.flatnonzero(index.terms[slot] == part) if len(index.terms) else np.empty(0, int)
        # Each term counts once in a stride.
        segment, term = np.divmod(np.unique(at // index.stride * max(1, len(index.terms)) + slot[at]), max(1, len(index.terms)))
        length = index.block_first[term + 1] - index.block_first[term]
        place = np.repeat(index.block_first[term] - np.cumsum(length) + length, length) + np.arange(length.sum())
        rows = end - begin + 1
        half = np.bincount(np.repeat(segment, length) * blocks + index.block[place], index.block_best[place], rows * blocks).reshape(rows, blocks)
        reached = half[:-1] + half[1:] + index.common_block >= THRESHOLD - SLACK
        edge = np.searchsorted(segment, np.arange(rows + 2))
        for p in np.flatnonzero(reached.any(axis=1)).tolist():
            yield begin + p, np.unique(term[edge[p] : edge[p + 2]]), np.flatnonzero(reached[p])


def matches(index: Index, text: str) -> list[tuple[int, float, float, float]]:
    """Verified (item id, score, question overlap, answer overlap), the best passage of each item."""
    words = words_of(text) if index.items else ()
    if not len(words):
        return []
    best: dict[int, tuple[int, float, float, float]] = {}
    for p, walked, live in candidates(index, words):
        passage = words[p * index.stride : (p + 2) * index.stride]
        terms, have = None, None
        for k in wand(index, walked.tolist(), THRESHOLD - SLACK, live.tolist()):
            item = index.items[k]
            terms = np.unique(passage) if terms is None else terms
            score = score_of(item, terms)
            if score < THRESHOLD:
                continue
            have = passage_shingles(passage) if have is None else have
            q, a = overlap(item.question, have), overlap(item.answer, have)
            found = q >= OVERLAP and a >= OVERLAP or item.whole is not None and overlap(item.whole, have) >= OVERLAP
            if found and score > best.get(k, (0, -1.0))[1]:
                best[k] = (item.id, score, q, a)
    return [best[k] for k in sorted(best)]


# ---------------------------------------------------------------- passes


def passes(benchmark: DataFrame, id_col: str = "item_id", text_col: str = "text", limit: int = INDEX_CHARS) -> Iterator[Index]:
    """The indexes to query with, one after another, each of a checked size."""
    items = benchmark.select(F.col(id_col).cast("long").alias("id"), F.col(text_col).cast("string").alias("text")).where("text is not null").distinct()
    size = items.agg(F.sum(F.length("text"))).first()[0] or 0
    n = -(-size // limit) or 1
    if n == 1:
        yield build([(r["id"], r["text"]) for r in items.orderBy("id", "text").collect()])
        return
    spark = benchmark.sparkSession

    def count(batch: pa.RecordBatch) -> pa.RecordBatch:
        words = [words_of(t) for t in common.texts(batch.column(1))]
        return common.rows({"part": pa.int32(), "n": pa.int64(), "terms": pa.list_(pa.int64())}, part=batch.column(2), n=[len(w) for w in words], terms=[np.unique(w).view(np.int64) for w in words])

    path = common.shared_dir(spark)
    try:
        parted = items.withColumn("part", F.pmod(F.xxhash64("id", "text"), F.lit(n)).cast("int"))
        counted = common.store(common.map_batches(parted, count, "part int, n long, terms array<long>").where("n > 0"), path)
        whole = counted.agg(F.count("*").alias("items"), F.avg("n").alias("average"), F.max("n").alias("longest")).first()
        term = counted.select("part", F.explode("terms").alias("term"))
        seen = term.groupBy("term").agg(F.count("*").alias("seen"))
        for k in range(n):
            own = seen.join(term.where(F.col("part") == k).select("term").distinct(), "term").toPandas()  # of this pass's items only
            terms = own["term"].to_numpy(np.int64).view(np.uint64)
            order = np.argsort(terms)
            stats = Statistics(whole["items"] or 0, whole["average"] or 0.0, whole["longest"] or 0, terms[order], own["seen"].to_numpy(np.int64)[order])
            yield build([(r["id"], r["text"]) for r in parted.where(F.col("part") == k).orderBy("id", "text").collect()], stats)
    finally:
        common.remove(spark, path)


def find(docs: DataFrame, benchmark: DataFrame, id_col: str = "doc_id", text_col: str = "text", item_col: str = "item_id", limit: int = INDEX_CHARS) -> DataFrame:
    """(id, item, score, question_overlap, answer_overlap): one row for each document and item found in it."""
    schema = {"id": pa.int64(), "item": pa.int64(), "score": pa.float64(), "question_overlap": pa.float64(), "answer_overlap": pa.float64()}
    cut = common.id_text(docs, id_col, text_col)

    def query(shipped) -> DataFrame:
        def run(batch: pa.RecordBatch) -> pa.RecordBatch:
            rows = [(i, *m) for i, t in zip(batch.column(0).to_pylist(), common.texts(batch.column(1)), strict=True) for m in matches(shipped.value, t)]
            return common.rows(schema, **{k: [r[c] for r in rows] for c, k in enumerate(schema)})

        return common.map_batches(cut, run, "id long, item long, score double, question_overlap double, answer_overlap double")

    return _by_pass(docs.sparkSession, passes(benchmark, item_col, limit=limit), query, lambda out, got: out.unionByName(got) if out else got).withColumnsRenamed({"id": id_col, "item": item_col})


def drop_contaminated(docs: DataFrame, benchmark: DataFrame, text_col: str = "text", item_col: str = "item_id", limit: int = INDEX_CHARS) -> DataFrame:
    """All columns of the documents in which no item is found."""
    common.tune(docs.sparkSession)
    left = [docs]

    def query(shipped) -> DataFrame:
        @F.pandas_udf("boolean")
        def clean(s):
            return s.map(lambda t: not matches(shipped.value, t or ""))

        return left[-1].where(clean(F.col(text_col)))

    def narrow(_: DataFrame | None, got: DataFrame) -> DataFrame:
        left.append(got)
        return got

    return _by_pass(docs.sparkSession, passes(benchmark, item_col, limit=limit), query, narrow, whole=True)


def _by_pass(spark: SparkSession, indexes: Iterator[Index], query, join, whole: bool = False) -> DataFrame:
    """One pass stays lazy; of several, each one's result is stored and its broadcast dropped before the next.

    Where a result is ``whole``, the ones before it are removed.
    """
    out, before, index = None, None, next(indexes)
    while True:
        shipped = spark.sparkContext.broadcast(index)
        got = query(shipped)
        following = next(indexes, None)
        if following is None and out is None:
            return got
        index, path = following, common.shared_dir(spark)
        got = common.store(got, path)
        shipped.destroy()
        out = join(out, got)
        if whole and before:
            common.remove(spark, before)
        before = path
        if following is None:
            return out


def op6_decontaminate(spark: SparkSession, sf_dir: str) -> DataFrame:
    return find(common.table(spark, sf_dir, "documents"), common.table(spark, sf_dir, "benchmark"))
