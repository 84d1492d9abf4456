"""Token counts under edits: a segment tree of pre-tokens for each document.

Leaves of the tree are short runs of pre-tokens; every node keeps the characters,
tokens and pre-tokens below it.  An edit re-encodes only the pre-tokens it touches
and their boundary context: it starts at the last border at least two characters
before the edit (a pre-token depends on what follows it by one character beyond its
neighbour at most) and ends as soon as a new border meets an old one after the edit
(the pattern never looks back).  Then the sums above the changed leaves are updated.

Trees are kept: ``plant`` makes a table with the text, the leaves (a length and a token
count for each pre-token) and the sums of every document; edits are a table of (id,
start, end, replacement); ``recount`` takes both and gives the new counts, and the new
trees where asked, for the next edits.  Documents without edits answer from their kept
sums, and their texts are not shuffled.

Null texts count as empty.  Edits count code points of the unedited text; those outside are
clipped; of edits that overlap the first by start, end and replacement counts and the
others are left out (``n_left_out``); edits with a null id, start or end, or of an unknown
id, do nothing; a null replacement is empty.  Edits apply to all rows of their id, or, where
they carry a ``version`` (a hash of the text they were made for, as ``edit_table`` gives
it), to those rows of their id, null or not, that hold this text.  An edit given twice
counts once.  An empty table gives an empty result; repeated rows give repeated results;
whole texts are read, and many edits in a text are taken as few stretches, so that a text
that is all edits takes no longer; further columns are ignored.
"""

from __future__ import annotations

import re
from collections.abc import Callable
from functools import lru_cache

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from textloom.llm import common, secrets
from textloom.llm.tokens import byte_pieces

LEAF = 64
CACHE = 400_000


class Counter:
    """Tokens of a pre-token, remembered up to CACHE pre-tokens."""

    def __init__(self, ranks: str, pattern: str) -> None:
        import regex

        space = common.SPACE_CLASS
        self.pattern = regex.compile(pattern.replace(r"[^\s", f"[^{space}").replace(r"\s", f"[{space}]"))
        self.pieces = byte_pieces(ranks, pattern)
        self.known: dict[str, int] = {}

    def counts(self, tokens: list[str]) -> list[int]:
        known = self.known
        got = list(map(known.get, tokens))
        if None in got:
            missing = list({t for t, n in zip(tokens, got, strict=True) if n is None})
            ids = dict.fromkeys(missing, b"")
            self.pieces.library(ids)
            new = {t: len(x) // 4 for t, x in ids.items()}
            got = [new[t] if n is None else n for t, n in zip(tokens, got, strict=True)]
            if len(known) + len(new) > CACHE:
                known.clear()
            known.update((t, n) for t, n in new.items() if len(t) <= 40)
        return got


@lru_cache(maxsize=4)
def counter(ranks: str, pattern: str) -> Counter:
    return Counter(ranks, pattern)


class Tree:
    """Pre-token leaves under a binary tree of (characters, tokens, pre-tokens) sums."""

    def __init__(self, text: str, count: Counter, leaves: tuple[list[int], list[int]] | None = None) -> None:
        """A new tree, or one from its kept lengths and counts; then nothing is encoded."""
        self.text, self.count, self.reencoded = text, count, 0
        if leaves is None:
            tokens = count.pattern.findall(text)
            leaves = [len(t) for t in tokens], count.counts(tokens)
        self._plant(*leaves)

    def _plant(self, lengths: list[int], counts: list[int]) -> None:
        self.lengths = [lengths[i : i + LEAF] for i in range(0, len(lengths), LEAF)] or [[]]
        self.counts = [counts[i : i + LEAF] for i in range(0, len(counts), LEAF)] or [[]]
        self.base = 1 << (len(self.lengths) - 1).bit_length()
        self.sums = [(0, 0, 0)] * (2 * self.base)
        for i in range(len(self.lengths)):
            self.sums[self.base + i] = self._leaf(i)
        for node in range(self.base - 1, 0, -1):
            self._join(node)

    def _leaf(self, i: int) -> tuple[int, int, int]:
        return sum(self.lengths[i]), sum(self.counts[i]), len(self.lengths[i])

    def _join(self, node: int) -> None:
        a, b = self.sums[2 * node], self.sums[2 * node + 1]
        self.sums[node] = (a[0] + b[0], a[1] + b[1], a[2] + b[2])

    def _update(self, leaf: int) -> None:
        node = self.base + leaf
        self.sums[node] = self._leaf(leaf)
        while node > 1:
            node //= 2
            self._join(node)

    @property
    def tokens(self) -> int:
        return self.sums[1][1]

    @property
    def pretokens(self) -> int:
        return self.sums[1][2]

    def find(self, char: int) -> tuple[int, int]:
        """(leaf, its first character) of the leaf that holds a character, or of the last."""
        node, start = 1, 0
        while node < self.base:
            node *= 2
            if char >= start + self.sums[node][0] and self.sums[node + 1][2]:
                start += self.sums[node][0]
                node += 1
        return node - self.base, start

    def edit(self, start: int, end: int, replacement: str) -> None:
        start = max(0, min(start, len(self.text)))
        end = max(start, min(end, len(self.text)))
        text = self.text = self.text[:start] + replacement + self.text[end:]
        shift = len(replacement) - (end - start)
        # The last old border at start - 2 or before.
        leaf, at = self.find(max(0, start - 2))
        slot = 0
        while slot < len(self.lengths[leaf]) and at + self.lengths[leaf][slot] <= start - 2:
            at += self.lengths[leaf][slot]
            slot += 1
        first_leaf, first_slot, begin = leaf, slot, at
        fresh, new = [], begin
        old_leaf, old_slot, old = leaf, slot, at
        while True:
            # Let the old border catch up with the new one.
            while old + shift < new or old < end:
                while old_slot >= len(self.lengths[old_leaf]):
                    if old_leaf + 1 >= len(self.lengths):
                        break
                    old_leaf, old_slot = old_leaf + 1, 0
                if old_slot >= len(self.lengths[old_leaf]):
                    break
                old += self.lengths[old_leaf][old_slot]
                old_slot += 1
            if old >= end and old + shift == new or new >= len(text):
                break
            m = self.count.pattern.match(text, new)
            fresh.append(m[0])
            new = m.end()
        if new >= len(text):  # the rest is gone
            old_leaf, old_slot = len(self.lengths) - 1, len(self.lengths[-1])
        self.reencoded += len(fresh)
        self._splice(first_leaf, first_slot, old_leaf, old_slot, [len(t) for t in fresh], self.count.counts(fresh))

    def _splice(self, leaf: int, slot: int, last_leaf: int, last_slot: int, lengths: list[int], counts: list[int]) -> None:
        """Leaves' entries from (leaf, slot) up to (last_leaf, last_slot) become the given ones."""
        for store, new in ((self.lengths, lengths), (self.counts, counts)):
            tail = store[last_leaf][last_slot:]
            if leaf == last_leaf:
                store[leaf] = store[leaf][:slot] + new + tail
            else:
                store[leaf] = store[leaf][:slot] + new
                for i in range(leaf + 1, last_leaf):
                    store[i] = []
                store[last_leaf] = tail
        if len(self.lengths[leaf]) > 4 * LEAF:  # grown too large: plant anew from the kept counts
            self._plant([x for r in self.lengths for x in r], [x for r in self.counts for x in r])
        else:
            for i in range(leaf, last_leaf + 1):
                self._update(i)


#: What a mail address is before and after its mark.
MAIL_NAME, MAIL_HOST = frozenset("ABCDEFGHIJKLMNOPQRSTUVWXYZabcdefghijklmnopqrstuvwxyz0123456789._%+-"), re.compile(r"[A-Za-z0-9.-]+\.[A-Za-z]{2,}")
MASKS = [
    (re.compile(r"\+\d{1,3} \(\d{3}\) \d{3}-\d{4}"), "[phone]"),
    (re.compile(r"(?<!\d)\d{1,3}(?:\.\d{1,3}){3}(?!\d)"), "[address]"),
    (re.compile(r"(?<!\d)\d{13,19}(?!\d)"), "[number]"),
]


def mail_spans(text: str) -> list[tuple[int, int]]:
    """Mail addresses, found from their marks to both sides: no character is read twice."""
    out, done, mark = [], 0, text.find("@")
    while mark >= 0:
        start = mark
        while start > done and text[start - 1] in MAIL_NAME:
            start -= 1
        host = MAIL_HOST.match(text, mark + 1) if start < mark else None
        done = host.end() if host else mark + 1
        if host:
            out.append((start, done))
        mark = text.find("@", done)
    return out


def privacy_edits(text: str) -> list[tuple[int, int, str]]:
    """The query's edits: secrets and personal data are masked, and a line that only repeats
    the line before goes.  In order, without overlaps."""
    found = [(a, b, f"[{secrets.KINDS[k]}]") for a, b, k in secrets.scan(text)]
    found += [(a, b, "[mail]") for a, b in mail_spans(text)]
    for pattern, mask in MASKS:
        found += [(m.start(), m.end(), mask) for m in pattern.finditer(text)]
    at, before = 0, None
    for line in text.split("\n"):
        if line and line == before:
            found.append((at - 1, at + len(line), ""))
        before, at = line, at + len(line) + 1
    out, done = [], 0
    for a, b, new in sorted(found):
        if a >= done:
            out.append((a, b, new))
            done = b
    return out


def pack(values: list[int]) -> bytes:
    """Small integers in as many bytes each as the greatest needs; the first byte says how many."""
    size = next(n for n in (1, 2, 4) if max(values, default=0) < 1 << 8 * n)
    return bytes([size]) + np.array(values, f"<u{size}").tobytes()


def unpack(raw: bytes) -> list[int]:
    return np.frombuffer(raw, f"<u{raw[0]}", offset=1).tolist()


#: Stretches that a text's edits are taken as: those closer than its length by this many, or GAP_LEAST, go together.
STRETCHES, GAP_LEAST = 4096, 16
TREE = {"id": pa.int64(), "text": pa.string(), "lengths": pa.binary(), "counts": pa.binary(), "n_tokens": pa.int64(), "n_pretokens": pa.int64()}
TREE_DDL = "id long, text string, lengths binary, counts binary, n_tokens long, n_pretokens long"
CHANGED = ["n_tokens_before", "n_edits", "n_left_out", "n_reencoded"]


def kept(tree: Tree) -> dict:
    lengths, counts = [x for r in tree.lengths for x in r], [x for r in tree.counts for x in r]
    return {"text": tree.text, "lengths": pack(lengths), "counts": pack(counts), "n_tokens": tree.tokens, "n_pretokens": tree.pretokens}


def _tokenizer(ranks: str | None, pattern: str | None) -> tuple[str, str]:
    from textloom.llm.byte_bpe import vocabulary

    default = vocabulary()
    return ranks or default[0], pattern or default[1]


def plant(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text", ranks: str | None = None, pattern: str | None = None) -> DataFrame:
    """(id, text, lengths, counts, n_tokens, n_pretokens): a tree for every whole text; store it to keep it."""
    place = _tokenizer(ranks, pattern)

    def run(batch: pa.RecordBatch) -> pa.RecordBatch:
        count = counter(*place)
        trees = [kept(Tree(t, count)) for t in common.texts(batch.column(1))]
        return common.rows(TREE, id=batch.column(0), **{n: [t[n] for t in trees] for n in list(TREE)[1:]})

    return common.map_batches(common.id_text(docs, id_col, text_col), run, TREE_DDL)


def ordered(edits: list[tuple[int, int, str]], size: int) -> tuple[list[tuple[int, int, str]], int]:
    """Clipped edits in order, without overlaps, and how many were left out for that."""
    out: list[tuple[int, int, str]] = []
    for a, b, new in sorted((min(max(a, 0), size), min(max(a, b, 0), size), new) for a, b, new in edits):
        if not out or a >= out[-1][1] and (a, b) != out[-1][:2]:
            out.append((a, b, new))
    return out, len(edits) - len(out)


def stretches(edits: list[tuple[int, int, str]], text: str) -> list[tuple[int, int, str]]:
    """The same change by fewer edits: those close together become one."""
    gap, out = max(GAP_LEAST, len(text) // STRETCHES), []
    for a, b, new in edits:
        if out and a - out[-1][1] < gap:
            out[-1][1] = b
        else:
            out.append([a, b, []])
        parts = out[-1][2]
        if parts:
            parts.append(text[last:a])
        parts.append(new)
        last = b
    return [(a, b, "".join(parts)) for a, b, parts in out]


def recount(trees: DataFrame, edits: DataFrame, ranks: str | None = None, pattern: str | None = None, keep_trees: bool = False) -> DataFrame:
    """(id, n_tokens_before, n_edits, n_left_out, n_tokens, n_pretokens, n_reencoded[, text, lengths, counts]).

    ``trees`` as ``plant`` or this gives them; ``edits``: (id, start, end, replacement[, version]).
    """
    place = _tokenizer(ranks, pattern)
    own = ["version"] if "version" in edits.columns else []
    one = F.struct(F.col("start").cast("long").alias("start"), F.col("end").cast("long").alias("end"), F.coalesce("replacement", F.lit("")).alias("new"))
    valid = edits.where("start is not null and end is not null" + " and id is not null" * (not own))
    by_text = valid.groupBy(F.col("id").cast("long").alias("id"), *own).agg(F.collect_set(one).alias("edits"))  # those of one text
    by_text = by_text.select(F.xxhash64("id", *own).alias("of"), F.col("id").alias("of_id"), *(F.col(c).alias("of_version") for c in own), "edits")
    shipped = trees.sparkSession.sparkContext.broadcast(common.id_filter(by_text.select(F.col("of").alias("id"))))
    names = ["id", "text", "lengths", "counts", "n_tokens", "n_pretokens"]

    def near(batch: pa.RecordBatch) -> pa.RecordBatch:
        return common.in_filter(batch, shipped.value, batch.num_columns - 1).select([*names, *keys])

    def run(batch: pa.RecordBatch) -> pa.RecordBatch:
        count, out = counter(*place), []
        for text, lengths, counts, changes in zip(*(batch.column(n).to_pylist() for n in ("text", "lengths", "counts", "edits")), strict=True):
            tree = Tree(text, count, (unpack(lengths), unpack(counts)))
            before = tree.tokens
            changes, left_out = ordered([(c["start"], c["end"], c["new"]) for c in changes], len(text))
            for a, b, new in reversed(stretches(changes, text)):  # from the end, so that positions hold
                tree.edit(a, b, new)
            out.append(kept(tree) | dict(zip(CHANGED, (before, len(changes), left_out, tree.reencoded), strict=True)))
        return common.rows(TREE | dict.fromkeys(CHANGED, pa.int64()), id=batch.column(0), **{n: [t[n] for t in out] for n in [*names[1:], *CHANGED]})

    columns = ["id", "n_tokens_before", "n_edits", "n_left_out", "n_tokens", "n_pretokens", "n_reencoded", *["text", "lengths", "counts"] * keep_trees]
    keys = ["key", *own]
    keyed = trees.select(*names, *(F.xxhash64("text").alias(c) for c in own)).withColumn("key", F.xxhash64("id", *own)).select(*names, *keys)
    met = [F.col("key") == F.col("of"), F.col("id").eqNullSafe(F.col("of_id")), *(F.col(c) == F.col("of_version") for c in own)]
    some = common.map_batches(keyed.withColumn("cell", common.filter_cell("key")), near, TREE_DDL + "".join(f", {c} long" for c in keys))
    changed = common.map_batches(some.join(by_text, met).select(*names, "edits"), run, TREE_DDL + "".join(f", {n} long" for n in CHANGED))
    same = keyed.select(*(n for n in names if n in columns), *keys).join(by_text.drop("edits"), met, "left_anti")
    same = same.withColumn("n_tokens_before", F.col("n_tokens")).withColumns({n: F.lit(0).cast("long") for n in CHANGED[1:]})
    return changed.select(columns).union(same.select(columns))


def edit_table(docs: DataFrame, edits: Callable[[str], list[tuple[int, int, str]]] = privacy_edits, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """(id, version, start, end, replacement): the edits a function finds in each text; ``version`` says in which."""
    schema = {"id": pa.int64(), "version": pa.int64(), "start": pa.int64(), "end": pa.int64(), "replacement": pa.string()}

    def run(batch: pa.RecordBatch) -> pa.RecordBatch:
        found = zip(batch.column(0).to_pylist(), batch.column(2).to_pylist(), common.texts(batch.column(1)), strict=True)
        rows = [(i, v, *e) for i, v, t in found for e in edits(t)]
        return common.rows(schema, **{n: [r[k] for r in rows] for k, n in enumerate(schema)})

    texts = common.id_text(docs, id_col, text_col).withColumn("version", F.xxhash64(F.coalesce("text", F.lit(""))))
    return common.map_batches(texts, run, "id long, version long, start long, end long, replacement string")


def count_edited(docs: DataFrame, edits: Callable[[str], list[tuple[int, int, str]]] = privacy_edits, id_col: str = "doc_id", text_col: str = "text", ranks: str | None = None, pattern: str | None = None) -> DataFrame:
    """Trees of all texts, the table of their edits, and the counts after them: both tables are kept until ``release``."""
    path = common.shared_dir(docs.sparkSession)
    trees = common.store(plant(docs, id_col, text_col, ranks, pattern), f"{path}/trees")
    found = common.store(edit_table(docs, edits, id_col, text_col), f"{path}/edits")
    return recount(trees, found, ranks, pattern).withColumnRenamed("id", id_col)


def op7_edit_counts(spark: SparkSession, sf_dir: str) -> DataFrame:
    return count_edited(common.table(spark, sf_dir, "documents"))
