import math
import random
import re
import zlib

import numpy as np
import pytest

from textloom.llm import knn_quality, ngram_model, quality_rules

WORD = re.compile(r"[^\x20\x09-\x0D]+")


def base(text):
    words = WORD.findall(text)
    windows = [tuple(words[i : i + 3]) for i in range(len(words) - 2)]
    covered = {i + k for i, w in enumerate(windows) if windows.count(w) > 1 for k in range(3)}
    lines = [x for x in text.split("\n") if WORD.search(x)]
    return len(words), sum(map(len, words)), sum(c in "#*$%&|<>" for c in text), sum(x in lines[:i] for i, x in enumerate(lines)), len(covered)


def test_base_counts():
    rng = random.Random(1)
    parts = ["a", "b", "c", " ", "\n", "  ", "#", "é\xa0", "\x1c", "\x85", "a b c ", "line\n", "\x0b"]
    for _ in range(1500):
        text = "".join(rng.choice(parts) for _ in range(rng.randint(0, 40)))
        assert quality_rules.base_counts(text) == base(text), text


@pytest.fixture(scope="module")
def corpus(spark):
    rng = random.Random(2)
    words = "the of and to a in river stone bridge house light water road garden winter summer walks stands falls over under".split()
    rows, labels = [], []
    for i in range(600):
        good = i % 5 > 0
        n = rng.randint(60, 120)
        text = " ".join(rng.choice(words) + ("" if good else rng.choice(["%%%", "***", "$$$", ""])) for _ in range(n))
        rows.append((i, text, "extra"))
        if i % 2:
            labels.append((i, int(good)))
    rows += [(1000, None, "x"), (1001, "", "x"), (1002, "few words", "x"), (1003, "one two three " * 60, "x")]
    labels += [(1, 1), (3, None), (None, 1), (5000, 1)]
    return spark.createDataFrame(rows, "doc_id long, text string, label string"), spark.createDataFrame(labels, "doc_id long, quality int")


def test_rules_and_model(spark, corpus, by_id):
    docs, labels = corpus
    model = quality_rules.train(docs, labels)
    got = by_id(quality_rules.judge(docs, model))
    assert np.mean([got[i]["kept"] == (i % 5 > 0) for i in range(600)]) > 0.99
    assert all(got[i]["base_failed"] and not got[i]["kept"] for i in (1000, 1001, 1002, 1003))
    kept = {r["doc_id"] for r in quality_rules.keep_good(docs, model).collect()}
    assert kept == {i for i, r in got.items() if r["kept"]}
    assert quality_rules.judge(docs.limit(0), model).count() == 0


M64 = (1 << 64) - 1


def mixed(h):
    h = (h ^ h >> 30) * 0xBF58476D1CE4E5B9 & M64
    h = (h ^ h >> 27) * 0x94D049BB133111EB & M64
    return h ^ h >> 31


def plain_probability(model, text):
    """One number at a time: hashed n-grams, the mean weight of each family, the calibrated sigmoid."""
    golden, shift = 0x9E3779B97F4A7C15, 64 - (quality_rules.DIMS.bit_length() - 1)
    words = []
    for w in WORD.findall(text):
        raw = w.encode()
        h = mixed(len(raw) + golden & M64)
        for i in range(0, len(raw), 8):
            h = mixed(h ^ int.from_bytes(raw[i : i + 8], "little") * golden & M64)
        words.append(h)

    def window(k, at):
        h = k
        for w in words[at : at + k]:
            h = mixed(h * 0xD6E8FEB86659FD93 + w & M64)
        return h

    found = [[(window(k, i) * golden & M64) >> shift for i in range(len(words) - k + 1)] for k in quality_rules.WORDS]
    if len(words) > 3:
        three = [window(3, i) for i in range(len(words) - 2)]
        found.append([int(three.count(x) > 1) for x in three])
    for k in quality_rules.CHARS:
        family = []
        for i in range(len(text) - k + 1):
            h = k
            for c in text[i : i + k]:
                h = (h + ord(c)) * 0xFF51AFD7ED558CCD & M64
                h ^= h >> 32
            family.append((h * golden & M64) >> shift)
        found.append(family)
    margin = model.bias + sum(sum(float(model.weights[b]) for b in f) / len(f) for f in found if f)
    return 1 / (1 + math.exp(-max(-40, min(40, model.slope * margin + model.offset))))


def test_verdicts_equal_plain_python(spark, corpus, by_id):
    docs, labels = corpus
    model = quality_rules.train(docs, labels)
    odd = spark.createDataFrame([(2000, "é 日本 " * 30, "x"), (2001, "a b c " * 16 + "%%% " * 9, "x"), (2002, "word " * 50, "x"), (2003, "\x1c\x85 x\ty " * 40, "x")], docs.schema)
    every = docs.where("doc_id % 7 = 0 or doc_id >= 1000").union(odd)
    got = by_id(quality_rules.judge(every, model))
    rows = {r["doc_id"]: r["text"] or "" for r in every.collect()}
    assert len(rows) > 90 and {True, False} <= {r["kept"] for r in got.values()}
    for i, t in rows.items():
        n, chars, symbols, lines, repeated = base(t)
        failed = n < 50 or 100 * repeated > 50 * n
        p = plain_probability(model, t)
        assert abs(got[i]["quality"] - p) < 1e-4
        assert got[i]["kept"] == (not failed and p >= quality_rules.KEEP) or abs(p - quality_rules.KEEP) < 1e-4


def test_model_without_labels_keeps_everything(corpus, by_id):
    docs, labels = corpus
    for few in (labels.limit(0), labels.where("quality = 1")):
        got = by_id(quality_rules.judge(docs, quality_rules.train(docs, few)))
        assert all(r["kept"] != r["base_failed"] for r in got.values())


def test_probabilities_are_calibrated():
    rng = random.Random(3)
    rows = []
    for i in range(1500):  # of texts with x, 70 in 100 are good; of the others, 20
        x = rng.random() < 0.5
        text = " ".join(rng.choice(["aa", "bb", "cc"]) for _ in range(40)) + (" xx" * 20 if x else " yy" * 20)
        rows.append((i, int(rng.random() < (0.7 if x else 0.2)), text))
    model = quality_rules.fit([(i, y, *ngram_model.sparse(t, quality_rules.DIMS, quality_rules.CHARS, quality_rules.WORDS)) for i, y, t in rows])
    p = lambda w: np.mean([model.probability(t) for _, _, t in rows if w in t])
    assert abs(p("xx") - 0.7) < 0.12 and abs(p("yy") - 0.2) < 0.12


def test_neighbours_on_held_out_rows(spark, corpus, by_id):
    docs, labels = corpus
    held = {i for i in range(600) if zlib.crc32(str(i).encode()) % 4 == 2}
    learnt = labels.where(~knn_quality.held_out())
    assert not {r["doc_id"] for r in learnt.collect()} & held
    got = by_id(knn_quality.score(docs, knn_quality.train(docs, learnt)))
    assert np.mean([(got[i]["score"] >= knn_quality.GOOD) == (i % 5 > 0) for i in held]) > 0.97
    assert all(0 <= r["score"] <= 1 for r in got.values()) and got[1000]["score"] == got[1001]["score"]
    assert by_id(knn_quality.score(docs, knn_quality.train(docs, labels.limit(0))))[5]["score"] == 0.5
    assert knn_quality.score(docs.limit(0), knn_quality.train(docs, learnt)).count() == 0


def test_blocked_products_equal_all_at_once():
    rng = np.random.default_rng(1)
    texts = [" ".join(f"w{k}" for k in rng.integers(0, 50, 30)) for _ in range(700)]
    rows = [(i, int(rng.integers(2)), *ngram_model.sparse(t, knn_quality.DIMS, knn_quality.CHARS, knn_quality.WORDS)) for i, t in enumerate(texts)]
    m = knn_quality.fit(rows)
    got = m.scores(texts[:50])
    cosine = m.project(texts[:50]) @ m.vectors.T
    for s, c in zip(got, cosine, strict=True):
        top = np.argsort(-c)[: knn_quality.K]
        w = np.exp(knn_quality.SHARPNESS * (c[top].astype(float) - 1))
        assert abs(s - (w * m.labels[top]).sum() / w.sum()) < 1e-3


def test_a_model_without_a_slope_does_not_cut_texts(monkeypatch):
    from textloom.llm import ngram_model, quality_rules

    want = quality_rules.NEUTRAL.probability("some text")
    monkeypatch.setattr(ngram_model, "families", None)
    assert quality_rules.NEUTRAL.probability("some text") == quality_rules.NEUTRAL.probability("") == want
