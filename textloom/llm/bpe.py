"""BPE encoding and decoding by merge ranks: a priority queue over a doubly linked symbol list.

The merges of the tokenizer's file run here: the ranks of all adjacent pairs go into a
queue, the lowest rank (then the leftmost place) comes out first, its two symbols become
one, and the pairs to both sides join the queue.  An entry whose place has changed since
is stale and skipped.  A piece of n symbols takes O(n log n) steps, however long it is.
The file's own normaliser and pre-token pattern part the texts (Arrow cuts them first, so
that Python sees each distinct word once a batch).

Ids decode by concatenating their vocabulary strings, with one space between two, as the
library does for a file without a decoder; ids that are in no vocabulary have no string.

Each text is handled whole; null counts as empty and gives no ids; repeated rows give
repeated results; an empty table gives an empty result; further columns are ignored.
"""

from __future__ import annotations

import hashlib
import heapq
import json
import re
from functools import lru_cache

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
from pyspark.sql import DataFrame, SparkSession

from textloom.llm import common
from textloom.llm.tokens import CACHE_CHARS, WordPieces

#: Distinct words a worker remembers.
CACHE_WORDS = 600_000
#: Bits for an id in the key of a pair, and for a place in an entry of the queue.
ID_BITS, PLACE_BITS = 24, 40


class QueuePieces(WordPieces):
    """Words by the merges of a file; only its normaliser and its pre-tokens come from the library."""

    def __init__(self, path: str) -> None:
        super().__init__(path)
        with open(path) as f:
            data = json.load(f)
        model = data["model"]
        self.vocab: dict[str, int] = model["vocab"]
        self.suffix: str = model.get("end_of_word_suffix") or ""
        self.ranks: dict[int, int] = {}
        self.joined: list[int] = []
        for rank, merge in enumerate(model["merges"]):
            left, right = merge.split(" ") if isinstance(merge, str) else merge
            self.ranks[self.vocab[left] << ID_BITS | self.vocab[right]] = rank
            self.joined.append(self.vocab[left + right])
        self.special: dict[str, int] = {t["content"]: t["id"] for t in data["added_tokens"]}
        self.parts = re.compile("(" + "|".join(map(re.escape, self.special)) + ")") if self.special else None
        spelling = {i: t for t, i in [*self.vocab.items(), *self.special.items()]}
        size = max(spelling, default=-1) + 1
        self.spelling = pa.array([spelling.get(i) for i in range(size)], pa.binary())
        self.decimal = pa.array([str(i) for i in range(size)], pa.binary())

    def merge(self, ids: list[int]) -> list[int]:
        """The symbols that are left when no pair of neighbours has a rank."""
        ranks, joined, n = self.ranks.get, self.joined, len(ids)
        mask = (1 << PLACE_BITS) - 1
        queue = []
        for place in range(n - 1):
            rank = ranks(ids[place] << ID_BITS | ids[place + 1])
            if rank is not None:
                queue.append(rank << PLACE_BITS | place)
        if not queue:
            return ids
        heapq.heapify(queue)
        pop, push = heapq.heappop, heapq.heappush
        after, before = list(range(1, n + 1)), list(range(-1, n - 1))
        while queue:
            entry = pop(queue)
            place = entry & mask
            right = after[place]
            # Stale: a symbol that is gone, or a pair that is another one by now.
            if ids[place] < 0 or right == n or ranks(ids[place] << ID_BITS | ids[right]) != entry >> PLACE_BITS:
                continue
            new = ids[place] = joined[entry >> PLACE_BITS]
            ids[right] = -1
            beyond = after[place] = after[right]
            if beyond < n:
                before[beyond] = place
                rank = ranks(new << ID_BITS | ids[beyond])
                if rank is not None:
                    push(queue, rank << PLACE_BITS | place)
            left = before[place]
            if left >= 0:
                rank = ranks(ids[left] << ID_BITS | new)
                if rank is not None:
                    push(queue, rank << PLACE_BITS | left)
        return [i for i in ids if i >= 0]

    def word(self, spelled: str) -> list[int]:
        """Ids of one pre-token, given in the byte alphabet."""
        vocab = self.vocab
        return self.merge([*map(vocab.__getitem__, spelled[:-1]), vocab[spelled[-1] + self.suffix]])

    def code(self, stem: str) -> bytes:
        """Ids of a piece of text: special tokens' strings are those tokens, the rest is normalised and parted."""
        ids: list[int] = []
        for part in self.parts.split(stem) if self.parts else (stem,):
            if part in self.special:
                ids.append(self.special[part])
            elif part:
                for spelled, _ in self.tokenizer.pre_tokenizer.pre_tokenize_str(self.tokenizer.normalizer.normalize_str(part)):
                    ids += self.word(spelled)
        return np.array(ids, "<u4").tobytes()

    def known_ids(self, stems: pa.Array) -> tuple[np.ndarray, np.ndarray]:
        """(all ids, number of ids of each) of distinct stems."""
        texts = stems.to_pylist()
        got = list(map(self.known.get, texts))
        if None in got:
            plain = pc.and_(pc.ascii_is_alpha(stems), pc.ascii_is_lower(stems)).to_pylist()
            new = {}
            for i, x in enumerate(got):
                if x is None:
                    t = texts[i]
                    got[i] = new[t] = np.array(self.word(t), "<u4").tobytes() if plain[i] else self.code(t)
            if len(self.known) + len(new) > CACHE_WORDS:
                self.known = {}
            self.known.update((t, x) for t, x in new.items() if len(t) <= CACHE_CHARS)
        return np.frombuffer(b"".join(got), "<u4"), np.fromiter(map(len, got), np.int64, len(got)) // 4

    def joined_strings(self, strings: pa.Array, ids: np.ndarray, ends: np.ndarray) -> list[bytes]:
        """Each text's ids as strings of a table, one space between two."""
        return pc.binary_join(pa.LargeListArray.from_arrays(pa.array(ends, pa.int64()), strings.take(pa.array(ids, pa.int64()))), b" ").to_pylist()


@lru_cache(maxsize=2)
def queue_pieces(path: str) -> QueuePieces:
    return QueuePieces(path)


def vocabulary() -> str:
    """Default tokenizer file; a parameter of every operator here."""
    import public_tokenizers as public

    return public.path("word_bpe_49k.json")


def _coded(path: str, column: pa.Array) -> tuple[QueuePieces, np.ndarray, np.ndarray]:
    """(tokenizer, ids of all texts, where each text's ids begin and end)."""
    pieces = queue_pieces(path)
    ids, each = pieces.encode_column(column)
    return pieces, ids, np.concatenate([[0], np.cumsum(each)]).astype(np.int64)


def encode(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text", tokenizer: str | None = None) -> DataFrame:
    """(id, ids array<int>) of every whole text."""
    path = tokenizer or vocabulary()

    def run(batch: pa.RecordBatch) -> pa.RecordBatch:
        _, ids, ends = _coded(path, batch.column(1))
        lists = pa.ListArray.from_arrays(pa.array(ends, pa.int32()), pa.array(ids.astype(np.int32)))
        return pa.RecordBatch.from_arrays([batch.column(0), lists], names=["id", "ids"])

    return common.map_batches(common.id_text(docs, id_col, text_col), run, "id long, ids array<int>").withColumnRenamed("id", id_col)


def decode(coded: DataFrame, id_col: str = "doc_id", ids_col: str = "ids", tokenizer: str | None = None) -> DataFrame:
    """(id, text): the ids' vocabulary strings; null ids give an empty text."""
    path = tokenizer or vocabulary()

    def run(batch: pa.RecordBatch) -> pa.RecordBatch:
        pieces, rows = queue_pieces(path), [x or [] for x in batch.column(1).to_pylist()]
        known = len(pieces.spelling)
        rows = [[i for i in x if i is not None and 0 <= i < known and pieces.spelling[i].is_valid] for x in rows]
        ends = np.cumsum([0, *map(len, rows)])
        texts = pieces.joined_strings(pieces.spelling, np.array([i for x in rows for i in x], np.int64), ends)
        return common.rows({"id": pa.int64(), "text": pa.string()}, id=batch.column(0), text=[t.decode() for t in texts])

    return common.map_batches(coded.select(coded[id_col].cast("long").alias("id"), coded[ids_col].cast("array<long>").alias("ids")), run, "id long, text string").withColumnRenamed("id", id_col)


def round_trip(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text", tokenizer: str | None = None) -> DataFrame:
    """Encode and decode in one pass: (id, n_tokens, ids_sha256 of the decimal ids joined by one space, decoded_sha256)."""
    path = tokenizer or vocabulary()
    schema = {"id": pa.int64(), "n_tokens": pa.int64(), "ids_sha256": pa.string(), "decoded_sha256": pa.string()}

    def run(batch: pa.RecordBatch) -> pa.RecordBatch:
        pieces, ids, ends = _coded(path, batch.column(1))
        digests = [[hashlib.sha256(t).hexdigest() for t in pieces.joined_strings(strings, ids, ends)] for strings in (pieces.decimal, pieces.spelling)]
        return common.rows(schema, id=batch.column(0), n_tokens=np.diff(ends), ids_sha256=digests[0], decoded_sha256=digests[1])

    return common.map_batches(common.id_text(docs, id_col, text_col), run, "id long, n_tokens long, ids_sha256 string, decoded_sha256 string").withColumnRenamed("id", id_col)


def op13_bpe(spark: SparkSession, sf_dir: str) -> DataFrame:
    return round_trip(common.table(spark, sf_dir, "documents"))
