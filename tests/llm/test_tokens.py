import base64
import hashlib
import random
import re
import time
import zlib

import numpy as np
import pyarrow as pa
import public_tokenizers as public
import pytest
import tiktoken
from tokenizers import Tokenizer

from textloom.llm import byte_bpe, edit_counts, rans
from textloom.llm.tokens import byte_pieces, utf8_stream, word_pieces

ALPHABET = " \n\t\r\x0b\x85\xa0\x1c  a's'tllZÉéΣß日😀1٣.,#*!|<|endoftext|>\x00İ́"


@pytest.fixture(scope="module")
def odd():
    rng = random.Random(5)
    return ["".join(rng.choice(ALPHABET) for _ in range(rng.randint(0, 40))) for _ in range(3000)]


@pytest.fixture(scope="module")
def reference():
    with open(public.path("byte_bpe_50k.tiktoken"), "rb") as f:
        ranks = {base64.b64decode(a): int(b) for a, b in map(bytes.split, f)}
    return tiktoken.Encoding("own", pat_str=public.PATTERN, mergeable_ranks=ranks, special_tokens={})


@pytest.fixture(scope="module")
def words():
    t = Tokenizer.from_file(public.path("word_bpe_49k.json"))  # as it is: special tokens' strings are those tokens
    return lambda text: t.encode(text or "", add_special_tokens=False).ids


def test_byte_pieces_equal_the_other_library(odd, edge_texts, reference):
    pieces = byte_pieces(*byte_bpe.vocabulary())
    texts = [t or "" for t in odd + edge_texts]
    for text, ids in zip(texts, pieces.encode(texts), strict=True):
        ids = np.frombuffer(ids, "<u4")
        assert ids.tolist() == reference.encode_ordinary(text)
        assert pieces.decode(ids) == text.encode()


def test_offsets_cover_the_characters(reference):
    pieces = byte_pieces(*byte_bpe.vocabulary())
    text = "naïve 日本 😀 end"
    ids, spans = pieces.encode_offsets(text)
    assert ids == reference.encode_ordinary(text)
    for i, (a, b) in zip(ids, spans, strict=True):
        token = pieces.spell[i]
        assert token in text[a:b].encode() and len(text[a:b].encode()) - len(token) < 7
    assert spans[0][0] == 0 and spans[-1][1] == len(text)


def test_split_characters_wait_for_their_rest():
    raw = "a😀b".encode()
    assert "".join(utf8_stream([raw[:2], raw[2:4], raw[4:]])) == "a😀b"
    assert utf8_stream([raw[:3]]) == ["a�"]


def test_encode_and_decode_tables(table, by_id, edge_texts, reference):
    docs = table(edge_texts)
    got = by_id(byte_bpe.encode(docs))
    assert all(got[i]["ids"] == reference.encode_ordinary(t or "") for i, t in enumerate(edge_texts))
    back = by_id(byte_bpe.decode(byte_bpe.encode(docs)))
    assert all(back[i]["text"] == (t or "") for i, t in enumerate(edge_texts))
    spans = by_id(byte_bpe.encode(docs, offsets=True))
    assert len(spans[7]["spans"]) == len(spans[7]["ids"])
    assert all(r["decodes"] for r in by_id(byte_bpe.encode_checked(docs)).values())


def test_round_trip_digests(table, by_id, edge_texts, reference):
    got = by_id(byte_bpe.round_trip(table(edge_texts)))
    for i, t in enumerate(edge_texts):
        ids = np.array(reference.encode_ordinary(t or ""), "<u4")
        want = {"n_tokens": len(ids), "ids_sha256": hashlib.sha256(ids.tobytes()).hexdigest(), "decoded_sha256": hashlib.sha256((t or "").encode()).hexdigest()}
        assert want.items() <= got[i].items()
    assert byte_bpe.round_trip(table([])).count() == 0


def test_word_pieces_equal_the_library(odd, edge_texts, words):
    pieces = word_pieces(public.path("word_bpe_49k.json"))
    specials = ["<|endoftext|>", "a<|endoftext|>b", "x <|startoftext|>, y", "<|ENDOFTEXT|>", "<|endoftext|", "one<|endoftext|>.\u00e9 <|endoftext|><|endoftext|>!"]
    texts = odd + edge_texts + specials + [a + s + b for s in specials for a, b in zip(odd[:60], odd[60:120], strict=True)]
    assert 49407 in words(specials[0]) and 49407 not in words(specials[3] + specials[4])
    ids, counts = pieces.encode_column(pa.array(texts))
    ends = np.cumsum(counts)
    for text, a, b, other in zip(texts, ends - counts, ends, pieces.encode([t or "" for t in texts]), strict=True):
        assert ids[a:b].tolist() == words(text) == np.frombuffer(other, "<u4").tolist()


@pytest.mark.parametrize("n", [1, 5, 16, 17, 33, 1000, 5000, 70001])
def test_blocks_decode_whole_and_in_spans(n):
    ids = np.random.default_rng(n).zipf(1.3, n).clip(0, 49000).astype(np.uint32)
    symbols, f = rans.frequencies(ids)
    assert f.sum() == 1 << rans.SCALE and f.min() >= 1
    block = rans.encode_block(ids, symbols, f, lanes=64, step=8)
    decoder = rans.Decoder(*rans.unpack_table(rans.pack_table(symbols, f)))
    assert (decoder.block(block) == ids).all()
    lanes = max(1, min(64, n // 16))
    rows = -(-n // lanes)
    for a in range(0, rows, 7):
        b = min(rows, a + 5)
        assert (decoder.span(block, a, b) == ids[a * lanes : b * lanes]).all()


def test_broken_blocks_are_noticed():
    ids = np.arange(1000, dtype=np.uint32) % 37
    symbols, f = rans.frequencies(ids)
    block = bytearray(rans.encode_block(ids, symbols, f))
    block[-5] ^= 1
    with pytest.raises(ValueError):
        rans.Decoder(symbols, f).block(bytes(block))


def test_size_is_near_the_entropy():
    ids = np.random.default_rng(1).zipf(1.2, 1 << 19).clip(0, 49000).astype(np.uint32)
    p = np.bincount(ids) / len(ids)
    p = p[p > 0]
    size = sum(map(len, rans.pack_segment([1], np.array([len(ids)]), ids)["blocks"]))
    assert size < 1.12 * -(p * np.log2(p)).sum() / 8 * len(ids)


def test_token_file(spark, table, by_id, edge_texts, words, tmp_path, monkeypatch):
    texts = edge_texts + [f"document number {i} " * (i % 50) for i in range(300)]
    docs = table(texts).orderBy("n_tokens", "text")
    got = by_id(rans.read(rans.write(docs, f"file://{tmp_path}/t", part_chars=40000)))
    start = 0
    for i, t in enumerate(texts):
        ids = words(t) + [1]
        r = got[i]
        assert (r["start"], r["n_tokens"], r["ids_crc32"], r["ids"]) == (start, len(ids), zlib.crc32(np.array(ids, "<u4").tobytes()), ids)
        start += len(ids)
    assert spark.read.parquet(f"file://{tmp_path}/t").select("part").distinct().count() > 3
    assert rans.read(rans.write(table([]), f"file://{tmp_path}/e")).count() == 0


def test_ties_in_the_id_keep_all_rows(spark, tmp_path):
    docs = spark.createDataFrame([(1, "a"), (1, "a"), (None, "b"), (0, "c")], "doc_id long, text string")
    rows = sorted(rans.read(rans.write(docs, f"file://{tmp_path}/t")).collect(), key=lambda r: r["start"])
    assert [r["doc_id"] for r in rows] == [None, 0, 1, 1] and [r["start"] for r in rows] == [0, 2, 4, 6]


def test_edits_equal_counting_anew():
    rng, count = random.Random(1), edit_counts.counter(*byte_bpe.vocabulary())
    symbols = ["a", "b", " ", "  ", "\n", "'s", "é", "1", "22", "!", "?!", " the", "日", "\t"]
    text = lambda n: "".join(rng.choice(symbols) for _ in range(rng.randint(0, n)))
    for size in [60] * 1500 + [4000] * 20:
        tree = edit_counts.Tree(text(size), count)
        for _ in range(4):
            a = rng.randint(0, len(tree.text))
            tree.edit(a, rng.randint(a, min(len(tree.text), a + size // 5)), text(size // 10))
            anew = edit_counts.Tree(tree.text, count)
            assert (tree.tokens, tree.pretokens, tree.sums[1][0]) == (anew.tokens, anew.pretokens, len(tree.text))


def test_edits_touch_little():
    count = edit_counts.counter(*byte_bpe.vocabulary())
    tree = edit_counts.Tree("some words in a row " * 5000, count)
    tree.edit(50003, 50009, "others")
    assert tree.reencoded < 10


def test_counts_of_edited_documents(table, by_id, edge_texts, reference):
    texts = edge_texts + ["write to someone@mail.example.com or +1 (234) 555-1234 at 10.20.30.40 with 4111111111111111", "line one\nline one\nline two", "password=hunter2hunter2 x"]
    got = by_id(edit_counts.count_edited(table(texts)))
    for i, t in enumerate(texts):
        t = t or ""
        edits, new = edit_counts.privacy_edits(t), t
        for a, b, x in reversed(edits):
            new = new[:a] + x + new[b:]
        r = got[i]
        assert (r["n_tokens_before"], r["n_tokens"], r["n_edits"]) == (len(reference.encode_ordinary(t)), len(reference.encode_ordinary(new)), len(edits))
    assert got[len(edge_texts)]["n_edits"] == 4 and got[len(edge_texts) + 1]["n_edits"] == 1
    assert edit_counts.count_edited(table([])).count() == 0


def test_kept_trees_take_edits_again(spark, by_id, reference):
    """Trees from the first call serve the second, which encodes little and equals counting anew."""
    rng = random.Random(4)
    texts = {i: " ".join(rng.choice(["the", "caf\u00e9", "it's", "42", "\n", "word"]) for _ in range(rng.randint(0, 400))) for i in range(40)} | {40: "", 41: "a b " * 20000}
    docs = spark.createDataFrame([(i, t, 1, "x") for i, t in texts.items()], "doc_id long, text string, n_tokens int, lengths string")
    trees = edit_counts.plant(docs)
    assert {r["id"]: r["n_tokens"] for r in trees.collect()} == {i: len(reference.encode_ordinary(t)) for i, t in texts.items()}
    for _ in range(2):
        made = []
        for i in rng.sample(sorted(texts), 15):
            spots = sorted(rng.sample(range(len(texts[i]) + 1), min(len(texts[i]) + 1, 6)))
            made += [(i, a, b, rng.choice(["", " new", "xx", "\n\n", None])) for a, b in zip(spots[::2], spots[1::2])]
        got = by_id(edit_counts.recount(trees, spark.createDataFrame(made, "id long, start long, end long, replacement string"), keep_trees=True), "id")
        for i, a, b, new in sorted(made, key=lambda e: -e[1]):
            texts[i] = texts[i][:a] + (new or "") + texts[i][b:]
        assert {i: r["text"] for i, r in got.items()} == texts
        assert {i: r["n_tokens"] for i, r in got.items()} == {i: len(reference.encode_ordinary(t)) for i, t in texts.items()}
        assert all(r["n_reencoded"] <= 40 * r["n_edits"] for r in got.values())
        trees = spark.createDataFrame([tuple(got[i][c] for c in edit_counts.TREE) for i in got], edit_counts.TREE_DDL)


def test_odd_edits(spark, by_id, reference):
    docs = spark.createDataFrame([(1, "one two three"), (2, None), (3, "same"), (3, "same"), (None, "no id")], "doc_id long, text string")
    made = [(1, 4, 7, "2"), (1, 5, 9, "x"), (1, 4, 7, "9"), (1, -5, 0, ">"), (1, 13, 99, "!"), (1, None, 3, "q"), (2, 0, 9, "new"), (3, 9, 4, "s"), (9, 0, 1, "z"), (None, 0, 1, "z")]
    got = edit_counts.recount(edit_counts.plant(docs), spark.createDataFrame(made, "id long, start long, end long, replacement string"), keep_trees=True).collect()
    assert sorted((str(r["id"]), r["text"], r["n_edits"], r["n_left_out"]) for r in got) == [("1", ">one 2 three!", 3, 2), ("2", "new", 1, 0), ("3", "sames", 1, 0), ("3", "sames", 1, 0), ("None", "no id", 0, 0)]
    assert all(r["n_tokens"] == len(reference.encode_ordinary(r["text"])) for r in got)
    none = spark.createDataFrame([], "id long, start long, end long, replacement string")
    assert edit_counts.recount(edit_counts.plant(docs), none).count() == 5


def test_edits_found_in_a_text_stay_with_it(spark, reference):
    """Rows of one id, or of none, that hold different texts have each its own edits; repeated rows the same."""
    texts = ["mail a@bc.de now", "no mail here", "x@yz.org and q@yz.org", "", None]
    rows = [(i, t) for t in texts for i in (5, None)] + [(5, texts[0])]
    got = edit_counts.count_edited(spark.createDataFrame(rows, "doc_id long, text string")).collect()
    new = {t: (t or "").replace("a@bc.de", "[mail]").replace("x@yz.org", "[mail]").replace("q@yz.org", "[mail]") for t in texts}
    want = [(str(i), len(reference.encode_ordinary(t or "")), len(reference.encode_ordinary(new[t])), (t or "").count("@")) for i, t in rows]
    assert sorted((str(r["doc_id"]), r["n_tokens_before"], r["n_tokens"], r["n_edits"]) for r in got) == sorted(want)


def test_mail_addresses_equal_the_expression():
    rng, pattern = random.Random(6), re.compile(r"[A-Za-z0-9._%+-]+@[A-Za-z0-9.-]+\.[A-Za-z]{2,}")
    for _ in range(5000):
        text = "".join(rng.choice(["a", "b1", "@", "@", ".", ".de", ".c", "-", "%", " ", "é", "\n"]) for _ in range(rng.randrange(25)))
        assert edit_counts.mail_spans(text) == [m.span() for m in pattern.finditer(text)], text


def test_stretches_make_the_same_change():
    rng = random.Random(7)
    for _ in range(500):
        text = "".join(rng.choice("ab ") for _ in range(rng.randrange(400)))
        spots = sorted(rng.choices(range(len(text) + 1), k=2 * rng.randrange(12)))
        edits, _ = edit_counts.ordered([(a, b, rng.choice(["", "x", "yy "])) for a, b in zip(spots[::2], spots[1::2])], len(text))
        few, made = edit_counts.stretches(edits, text), []
        for some in (edits, few):
            new = text
            for a, b, x in reversed(some):
                new = new[:a] + x + new[b:]
            made.append(new)
        assert made[0] == made[1] and len(few) <= len(edits)


@pytest.mark.parametrize("part", ["eyJ", "a", " ", "7", "-----BEGIN ", "a@", "a@b.", "@a.bc ", "line\n", "password=x ", "eyJ.", "AKIA", "f", "+1 (", "1.1."])
def test_odd_long_texts_take_about_linear_time(part, reference):
    text = part * (1_000_000 // len(part))
    began = time.time()
    edits = edit_counts.privacy_edits(text)
    tree = edit_counts.Tree(text, edit_counts.counter(*byte_bpe.vocabulary()))
    changes, _ = edit_counts.ordered(edits, len(text))
    for a, b, new in reversed(edit_counts.stretches(changes, text)):
        tree.edit(a, b, new)
    assert time.time() - began < 20
    assert tree.pretokens == len(tree.count.pattern.findall(tree.text))


def test_the_number_of_parts_is_bounded(table, monkeypatch, tmp_path, by_id):
    monkeypatch.setattr(rans, "MAX_PARTS", 3)
    docs = table([f"text {i}" for i in range(50)])
    segments = rans.write(docs, f"file://{tmp_path}/t", part_chars=10)
    assert segments.select("part").distinct().count() <= 3
    starts = [r["start"] for _, r in sorted(by_id(rans.read(segments)).items())]
    assert starts == sorted(starts) and len(set(starts)) == 50
