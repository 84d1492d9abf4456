import collections
import random
import re

import numpy as np
import pytest

from textloom.llm import jaccard_join

WORD = re.compile(r"[^\x20\x09-\x0D]+")
LOWER = str.maketrans({chr(c): chr(c + 32) for c in range(65, 91)})


def brute(rows, percent=90, k=3):
    sets, parent, inverted = {}, {}, collections.defaultdict(list)
    for i, t in rows:
        w = tuple(WORD.findall((t or "").translate(LOWER)))
        sets[i] = {w[j : j + k] for j in range(len(w) - k + 1)} if len(w) >= k else {w} if w else set()
        parent[i] = i
        for s in sets[i]:
            inverted[s].append(i)

    def root(x):
        while parent[x] != x:
            x = parent[x]
        return x

    for i, mine in sets.items():
        for j, both in collections.Counter(j for s in mine for j in inverted[s] if j < i).items():
            if 100 * both >= percent * (len(mine) + len(sets[j]) - both):
                a, b = root(i), root(j)
                parent[max(a, b)] = min(a, b)
    return {i: (len(s), root(i)) for i, s in sets.items()}


@pytest.mark.parametrize(("seed", "block"), [(4, 1024), (5, 3)])
def test_equals_all_pairs(spark, monkeypatch, seed, block):
    """Also with the classes of common shingles in many small blocks."""
    monkeypatch.setattr(jaccard_join, "BLOCK_CLASSES", block)
    rng = random.Random(seed)
    vocabulary = [f"w{i}" for i in range(400)]
    originals = [[rng.choice(vocabulary) for _ in range(rng.choice([1, 2, 3, 5, 12, 40, 60, 150]))] for _ in range(25)]
    passage = " ".join(rng.choice(vocabulary) for _ in range(60))

    def one():
        w = list(rng.choice(originals))
        for _ in range(rng.choice([0, 0, 1, 1, 2, 3, 5])):
            w[rng.randrange(len(w))] = rng.choice(vocabulary)
        if rng.random() < 0.2:
            w = w[rng.randint(0, 4) : len(w) - rng.randint(0, 4)]
        return " ".join(w) + (" " + passage if rng.random() < 0.3 else "")

    rows = [(i * 3, one()) for i in range(900)]
    rows += [(5000, None), (5001, ""), (5002, "  \n"), (5003, "a"), (5004, "A"), (5005, "a b"), (5006, "a b"), (5007, "x y z " * 3000), (5008, "É b c"), (5009, "é b c")]
    rng.shuffle(rows)
    docs = spark.createDataFrame([(i, t, 1, "c") for i, t in rows], "doc_id long, text string, n int, component string")
    got = {r["doc_id"]: (r["n_shingles"], r["component_id"]) for r in jaccard_join.link_classes(docs).collect()}
    want = brute(rows)
    assert got == want
    kept = jaccard_join.one_of_each(docs)
    assert kept.columns == docs.columns and {r["doc_id"] for r in kept.collect()} == {c for _, c in want.values()}


def test_empty_table(spark):
    assert jaccard_join.link_classes(spark.createDataFrame([], "doc_id long, text string")).count() == 0


def test_prefixes_keep_their_promise():
    rng = np.random.default_rng(3)
    estimate = rng.integers(1, 40, 5000)
    for _ in range(400):
        n = int(rng.integers(1, 80))
        x = rng.choice(5000, n, replace=False).astype(np.uint64)
        y = np.unique(np.where(rng.random(n) < 0.04, rng.choice(5000, n), x)).astype(np.uint64)
        x = np.unique(x)
        both = len(np.intersect1d(x, y))
        if 100 * both < 90 * (len(x) + len(y) - both):
            continue
        (px, mx), (py, my) = (jaccard_join.prefix_of(s, estimate[s.astype(int)], 20, 90) for s in (x, y))
        assert len(np.intersect1d(px, py)) >= min(mx, my) >= 1


def test_least_overlap():
    for n in range(1, 60):
        for m in range(1, 60):
            least = next((k for k in range(min(n, m) + 1) if 100 * k >= 90 * (n + m - k)), None)
            if least is not None:
                assert jaccard_join.least_overlap(n, m) == least


def test_rows_without_an_id_stay(spark):
    docs = spark.createDataFrame([(1, "a b c d"), (2, "a b c d"), (None, "a b c d"), (None, "e f g h")], "doc_id long, text string")
    kept = jaccard_join.one_of_each(docs)
    assert kept.columns == docs.columns
    assert sorted(map(tuple, kept.collect()), key=str) == [(1, "a b c d"), (None, "a b c d"), (None, "e f g h")]


def test_of_repeated_rows_one_stays(spark):
    """One row of an id and text; rows of one id with different texts stand or fall together."""
    rows = [(1, "a b c d"), (1, "a b c d"), (2, "a b c d"), (3, "e f g h"), (3, "e f g h"), (4, "p q r s"), (4, "t u v w"), (None, "a b c d")]
    kept = jaccard_join.one_of_each(spark.createDataFrame(rows, "doc_id long, text string"))
    assert sorted(map(tuple, kept.collect()), key=str) == sorted([(1, "a b c d"), (3, "e f g h"), (4, "p q r s"), (4, "t u v w"), (None, "a b c d")], key=str)


def test_bitmaps_bound_the_overlap():
    rng = np.random.default_rng(5)
    for n in (0, 1, 5, 60, 400, 3000):
        x = rng.integers(0, 1 << 63, n).astype(np.uint64)
        y = np.unique(np.concatenate([x[: n // 2], rng.integers(0, 1 << 63, n // 3).astype(np.uint64)]))
        x = np.unique(x)
        apart = sum(int(a ^ b).bit_count() for a, b in zip(jaccard_join.parity(x).view(np.uint64), jaccard_join.parity(y).view(np.uint64), strict=True))
        assert len(np.intersect1d(x, y)) <= (len(x) + len(y) - apart) / 2


def test_only_the_result_is_left_of_the_tables(spark):
    import os

    from textloom.operators import storage

    storage.release(spark)
    base = spark.conf.get("spark.checkpoint.dir").removeprefix("file://")
    own = lambda d: [x for x in os.listdir(d) if x.startswith("textloom-")]
    docs = spark.createDataFrame([(i, f"a b c d e f {i % 3} g h i") for i in range(30)], "doc_id long, text string")
    assert jaccard_join.link_classes(docs).count() == 30
    assert len(own(base)) == 1
    storage.release(spark)
    assert own(base) == []
