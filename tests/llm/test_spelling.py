import random
import re
import zlib
from collections import Counter

import numpy as np
import pytest
from pyspark.sql import functions as F

from textloom.llm import spelling


def distance_one(a, b):
    """Exactly one inserted, deleted or replaced code point, by alignment."""
    if abs(len(a) - len(b)) > 1 or a == b:
        return False
    k = next((i for i, (x, y) in enumerate(zip(a, b)) if x != y), min(len(a), len(b)))
    if len(a) == len(b):
        return a[k + 1 :] == b[k + 1 :]
    return a[k + 1 :] == b[k:] if len(a) > len(b) else a[k:] == b[k + 1 :]


def by_hand(docs, slips=None, chars=6, least=5, ratio=5):
    counts = Counter()
    for i, text in docs:
        for run in re.findall("[A-Za-zÀ-ÿ]+", text or ""):
            run = "".join(chr(ord(c) + 32) if "A" <= c <= "Z" else c for c in run)
            h = zlib.crc32(f"{'' if i is None else i}:{run}".encode())
            if slips and h % slips == 0:
                k = h % len(run)
                run = run[:k] + run[k + 1 :]
            counts[run] += 1
    counts = {w: n for w, n in counts.items() if len(w) >= chars and n >= least}
    near = {w: [x for x in counts if distance_one(w, x)] for w in counts}
    forms = {}
    for w, xs in near.items():
        best = min(xs, key=lambda x: (-counts[x], x), default=None)
        forms[w] = best if best and counts[best] >= ratio * counts[w] else None

    def root(w):
        while forms[w]:
            w = forms[w]
        return w

    return {w: (forms[w], root(w), n, len(near[w]), counts[forms[w]] if forms[w] else None) for w, n in counts.items()}


def group(spark, docs, **options):
    rows = spark.createDataFrame([(i, t, "x", 1, "y") for i, t in docs], "doc_id long, text string, word string, n int, form string")
    made = spelling.group_variants(rows, **options)
    assert made.columns == ["word", "form", "root", "n", "n_near", "form_n"]
    got = made.collect()
    out = {r["word"]: tuple(r)[1:] for r in got}
    assert len(out) == len(got)
    return out


def corpus():
    """A chain of variants, ties, letters beyond ASCII, double letters, and noise."""
    rng = random.Random(2)
    words = {"receive": 700, "recieve": 90, "receve": 120, "receeve": 26, "receevee": 5, "naïvely": 50, "naively": 300, "écoles": 60, "ecoles": 9, "balloon": 200, "baloon": 20, "balon": 90, "ballloon": 6, "colour": 30, "color": 500, "colours": 150, "Coulour": 6, "straßen": 31, "strassen": 30, "abcdef": 5, "abcdeg": 25, "abcdeh": 25, "×÷×÷×÷": 6, "Écoles": 7, "x" * 300: 5, "x" * 301: 25}
    every = [w for w, n in words.items() for _ in range(n)]
    every += ["".join(rng.choice("abe") for _ in range(rng.choice((5, 6, 7)))) for _ in range(4000)]
    rng.shuffle(every)
    seps = [" ", "\n", "1", "_", ", ", "Ā", "日"]
    texts = ["".join(w + rng.choice(seps) for w in every[k : k + 200]) for k in range(0, len(every), 200)]
    return [*enumerate(texts), (900, None), (901, ""), (902, "12 -"), (None, texts[0]), (5, texts[5]), (5, texts[5])]


def test_equals_plain_python(spark):
    docs = corpus()
    got = group(spark, docs)
    assert got == by_hand(docs)
    assert got["receevee"][:2] == ("receeve", "receive")


def test_of_equally_common_forms_the_first(spark):
    docs = [(1, "abcdef " * 5 + "abcdeh " * 25 + "abcdeg " * 25)]
    assert group(spark, docs) == by_hand(docs)
    assert group(spark, docs)["abcdef"] == ("abcdeg", "abcdeg", 5, 2, 25)


def test_slips_and_other_limits(spark):
    docs = corpus()
    assert group(spark, docs, slips=7) == by_hand(docs, 7)
    assert group(spark, docs, slips=199, least_chars=1, least_count=2, ratio=2) == by_hand(docs, 199, 1, 2, 2)


def test_a_crowded_filter_changes_nothing(spark, monkeypatch):
    docs = corpus()
    monkeypatch.setattr(spelling, "FILTER_MOST", 14)
    monkeypatch.setattr(spelling, "FILTER_LEAST", 14)
    assert group(spark, docs) == by_hand(docs)


def test_neighbourhood_is_whole_and_distinct():
    alphabet, bits = "abé", 12
    every = np.full(1 << bits >> 3, 255, np.uint8)
    words = ["aab", "bé", "a"]
    for w, got in zip(words, spelling.possible(words, alphabet, every, bits), strict=True):
        edits = {w[:i] + w[i + 1 :] for i in range(len(w))}
        edits |= {w[:i] + c + w[i + 1 :] for i in range(len(w)) for c in alphabet}
        edits |= {w[:i] + c + w[i:] for i in range(len(w) + 1) for c in alphabet}
        assert sorted(got) == sorted(edits - {w})


@pytest.mark.parametrize("docs", [[], [(1, None)], [(1, "short words 12")], [(None, "lonely " * 9)]])
def test_little_or_nothing(spark, docs):
    assert group(spark, docs) == by_hand(docs)


def test_long_chains_of_forms(spark):
    words = ["abcdefgh" + "x" * k for k in range(9)]
    forms = spark.createDataFrame([(w, f) for w, f in zip(words, [*words[1:], None])] + [("other1", None)], "word string, form string")
    assert {r["word"]: r["root"] for r in spelling.roots(forms).collect()} == dict.fromkeys(words[:-1], words[-1])
    assert spelling.roots(forms.where(F.lit(False))).collect() == []
