import hashlib
import random
import time

import pyarrow as pa
import pytest
from pyspark.sql import functions as F

from textloom.llm import bpe

ODD = ["a", "B", "The", "<|endoftext|>", "<|startoftext|>", "<|ENDOFTEXT|>", "<|endof", "text|>", " ", "\n", "\t", "\xa0", " ", "é", "é", "İ", "ß", "ẞ", "ﬁ", "日本", "1", "٣", "½", "'s", "'LL", "’", "!", "..", "#$%", "\x00", "\x1c", "\x85", "\U0001f600", "‍", "ا", "́", "Σ", "K", "\U0001d400", "don't", "x" * 60]


@pytest.fixture(scope="module")
def library():
    from tokenizers import Tokenizer

    return Tokenizer.from_file(bpe.vocabulary())


@pytest.fixture(scope="module")
def odd():
    rng = random.Random(3)
    return ["".join(rng.choice(ODD) for _ in range(rng.randrange(15))) for _ in range(3000)]


def by_scanning(pieces, ids):
    """Merge the leftmost pair of lowest rank again and again."""
    while True:
        ranked = [(r, k) for k in range(len(ids) - 1) if (r := pieces.ranks.get(ids[k] << bpe.ID_BITS | ids[k + 1])) is not None]
        if not ranked:
            return ids
        rank, k = min(ranked)
        ids = [*ids[:k], pieces.joined[rank], *ids[k + 2 :]]


def test_merges_equal_scanning():
    pieces, rng = bpe.queue_pieces(bpe.vocabulary()), random.Random(8)
    for letters in ("ab", "the", "aeinrst", "abcdefghijklmnopqrstuvwxyz"):
        for _ in range(300):
            ids = [pieces.vocab[rng.choice(letters)] for _ in range(rng.randrange(1, 40))]
            assert pieces.merge(list(ids)) == by_scanning(pieces, ids)


def test_ids_and_texts_equal_the_library(spark, table, library, odd, edge_texts, by_id):
    texts = [*odd, *edge_texts]
    got = by_id(bpe.round_trip(table(texts)))
    coded = bpe.encode(table(texts))
    ids, back = by_id(coded), by_id(bpe.decode(coded))
    for i, t in enumerate(texts):
        want = library.encode(t or "", add_special_tokens=False).ids
        text = library.decode(want, skip_special_tokens=False)
        assert ids[i]["ids"] == want and back[i]["text"] == text
        assert got[i]["n_tokens"] == len(want)
        assert got[i]["ids_sha256"] == hashlib.sha256(" ".join(map(str, want)).encode()).hexdigest()
        assert got[i]["decoded_sha256"] == hashlib.sha256(text.encode()).hexdigest()


def test_a_forgetful_worker_gives_the_same_ids(monkeypatch, odd, library):
    monkeypatch.setattr(bpe, "CACHE_WORDS", 3)
    pieces = bpe.QueuePieces(bpe.vocabulary())
    for k in range(0, len(odd), 500):
        some = odd[k : k + 500]
        ids, each = pieces.encode_column(pa.array(some))
        assert ids.tolist() == [i for t in some for i in library.encode(t, add_special_tokens=False).ids]


def test_long_pieces_take_about_linear_time(library):
    pieces, rng = bpe.queue_pieces(bpe.vocabulary()), random.Random(1)
    for text in ("a" * 200_000, "".join(rng.choice("abcde") for _ in range(200_000)), "<" * 200_000, "7" * 50_000):
        began = time.time()
        ids, _ = pieces.encode_column(pa.array([text]))
        assert time.time() - began < 20
        assert ids.tolist() == library.encode(text, add_special_tokens=False).ids


def test_odd_ids_and_empty_tables(spark, table):
    odd = spark.createDataFrame([(1, None), (2, []), (3, [0, 1 << 30, -1, 1, None])], "doc_id long, ids array<long>")
    assert {r["doc_id"]: r["text"] for r in bpe.decode(odd).collect()} == {1: "", 2: "", 3: "! \""}
    empty = table(["x"]).where(F.lit(False))
    for made in (bpe.round_trip(empty), bpe.encode(empty), bpe.decode(bpe.encode(empty))):
        assert made.collect() == []


def test_repeated_rows_and_null_ids(spark):
    rows = spark.createDataFrame([(None, "one"), (None, "one"), (4, "one")], "doc_id long, text string")
    got = bpe.round_trip(rows).collect()
    assert len(got) == 3 and len({(r["n_tokens"], r["ids_sha256"]) for r in got}) == 1
