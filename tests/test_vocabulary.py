import math
import random
import time
from collections import Counter

import numpy as np
import pytest

from textloom.operators import tokenizer, vocabulary


def corpus(rng):
    """Words with counts: few letters make ties, runs of one letter and tokens that come about in two ways."""
    letters = rng.choice(["ab", "abc", "aabcdé", "abcdefgh"])
    return Counter({"".join(rng.choice(letters) for _ in range(rng.randint(1, 12))): rng.choice([1, 1, 2, 3, 50]) for _ in range(rng.randint(1, 60))})


def sequential(words, algorithm, size, least=1):
    spelled = [(tokenizer.spelled(w, algorithm), n) for w, n in sorted(words.items())]
    symbols = sorted({t for parts, _ in spelled for t in parts}, key=lambda t: (t.startswith("##"), t))
    vocab = {t: i for i, t in enumerate([*tokenizer.SPECIALS, *symbols])}
    merges = vocabulary.merge_loop(spelled, vocab, size, least, (lambda a, b: a + b) if algorithm == "bpe" else (lambda a, b: a + b[2:]))
    return vocab, merges


@pytest.mark.parametrize("seed", range(8))
def test_rounds_make_the_merges_of_the_sequential_loop(spark, monkeypatch, seed):
    rng = random.Random(seed)
    words, algorithm, size, least = corpus(rng), rng.choice(["bpe", "wordpiece"]), rng.choice([20, 60, 300]), rng.choice([1, 2, 5])
    monkeypatch.setattr(vocabulary, "SYMBOLS", rng.choice([8, 40, 120]))
    monkeypatch.setattr(vocabulary, "ACTIVE_FIRST", rng.choice([1, 4, 64]))
    monkeypatch.setattr(tokenizer, "piece_counts", lambda df, *_: df)
    got = tokenizer.train(spark.createDataFrame(list(words.items()), "piece string, n long").repartition(3), algorithm, size, least)
    vocab, merges = sequential(words, algorithm, size, least)
    assert got.vocab == vocab and got.merges == (merges if algorithm == "bpe" else [])


def test_a_round_ends_with_a_token_that_is_there_already():
    """ab + c and a + bc both make abc; what follows in the round is left to the next."""
    words = [(list("abc"), 9), (list("abc"), 9), (list("bc"), 30), (list("xab"), 12)]
    vocab = {t: i for i, t in enumerate("abcx")}
    vocab["abc"] = 4
    made = vocabulary.merge_loop([(list(p), n) for p, n in words], vocab, 99, 1, lambda a, b: a + b, (-1, 0, 0))
    assert made[-1] in (("a", "bc"), ("ab", "c")) and len(vocab) < 99


def test_whole_arrays_merge_as_the_queue_does():
    rng = random.Random(5)
    for _ in range(200):
        pairs = list(dict.fromkeys((rng.randrange(6), rng.randrange(6)) for _ in range(rng.randrange(1, 12))))
        new = [6 + k for k in range(len(pairs))]
        pairs += [(rng.randrange(6 + k), rng.randrange(6 + k)) for k in range(len(new))]
        pairs = list(dict.fromkeys(pairs))
        new = [6 + k for k in range(len(pairs))]
        ranks = {p: r for r, p in enumerate(pairs)}
        words = [[rng.randrange(6) for _ in range(rng.choice([0, 1, 2, 5, 20, 300]))] for _ in range(20)]
        want = [vocabulary.queued_merges(w, lambda a, b: ranks.get((a, b)), lambda r, a, b: new[r]) for w in words]
        for w, out in zip(words, want, strict=True):  # the queue against merging the lowest rank, leftmost, again and again
            while found := [(ranks[p], k) for k, p in enumerate(zip(w, w[1:])) if p in ranks]:
                k = min(found)[1]
                w[k : k + 2] = [new[min(found)[0]]]
            assert w == out
        words = [[rng.randrange(6) for _ in range(rng.choice([0, 1, 2, 5, 20, 300]))] for _ in range(20)]
        want = [vocabulary.queued_merges(w, lambda a, b: ranks.get((a, b)), lambda r, a, b: new[r]) for w in words]
        flat, word = np.array([x for w in words for x in w], np.int64), np.repeat(np.arange(len(words)), [len(w) for w in words])
        symbols, owner = vocabulary.merged(flat, word, vocabulary.Found(pairs, new))
        assert [symbols[owner == k].tolist() for k in range(len(words))] == want


def test_one_very_long_piece_is_encoded_in_time():
    rng = random.Random(1)
    words = Counter("".join(rng.choice("abcde") for _ in range(8)) for _ in range(3000))
    vocab, merges = sequential(words, "bpe", 1000)
    model = tokenizer.Model("bpe", vocab, merges)
    text = "".join(rng.choice("abcde") for _ in range(300_000))
    began = time.time()
    ids = model.piece_ids(text)
    assert time.time() - began < 30
    assert "".join(model.tokens[i] for i in ids) == text and len(ids) < len(text) / 2


def test_little_or_nothing(spark):
    for algorithm in tokenizer.ALGORITHMS:
        for texts in ([], [(None,), ("",)], [("a",)], [("aaaaaaaa",)]):
            m = tokenizer.train(spark.createDataFrame(texts, "text string"), algorithm, 50)
            assert list(m.vocab)[:4] == tokenizer.SPECIALS and len(m.vocab) == len(set(m.vocab.values()))
            if texts[:1] == [("a",)]:
                assert set(m.vocab) == {*tokenizer.SPECIALS, "a"}


# ---------------------------------------------------------------- unigram


def text_counts():
    rng = random.Random(9)
    stems, ends = ["token", "learn", "model", "train", "read", "count", "walk", "light"], ["", "s", "ing", "ed", "er", "ers", "able"]
    words = Counter({a + b: rng.randint(1, 80) for a in stems for b in ends})
    words.update({"".join(rng.choice("abcdelrst") for _ in range(rng.randint(2, 9))): rng.randint(1, 5) for _ in range(400)})
    return words


def log_likelihood(words, scores):
    norm = math.log(sum(math.exp(s) for s in scores.values()))
    scores = {t: s - norm for t, s in scores.items()}
    return sum(n * vocabulary.expected_counts(w, 0, scores, Counter()) for w, n in words.items())


def test_expected_counts_equal_all_segmentations():
    rng = random.Random(3)
    scores = {t: math.log(rng.random()) for t in ["a", "b", "ab", "ba", "aab", "bb", "abab"]}

    def every(w):
        return [[]] if not w else [[w[:k], *rest] for k in range(1, len(w) + 1) if w[:k] in scores for rest in every(w[k:])]

    for w in ("a", "ab", "abab", "aabba", "bbabab"):
        weights = [math.exp(sum(scores[t] for t in cut)) for cut in every(w)]
        want = Counter()
        for cut, x in zip(every(w), weights, strict=True):
            for t in cut:
                want[t] += 3 * x / sum(weights)
        got = Counter()
        assert vocabulary.expected_counts(w, 3, scores, got) == pytest.approx(math.log(sum(weights)))
        assert {t: pytest.approx(x) for t, x in want.items()} == dict(got)
        got = Counter()
        assert vocabulary.expected_in_short(w, 3, {t: math.exp(s) for t, s in scores.items()}, got) == pytest.approx(math.log(sum(weights)))
        assert {t: pytest.approx(x) for t, x in want.items()} == dict(got)
    assert vocabulary.expected_in_short("ac", 1, {"a": 0.5}, Counter()) is None and vocabulary.expected_counts("ac", 1, {"a": -1.0}, Counter()) == -math.inf


def test_expectation_and_seeds_on_the_cluster_equal_plain_python(spark):
    words = text_counts()
    table = spark.createDataFrame(list(words.items()), "piece string, n long").repartition(4)
    freq = Counter()
    for w, n in words.items():
        for i in range(len(w)):
            for j in range(i + 1, min(len(w), i + vocabulary.SEED_LENGTH) + 1):
                freq[w[i:j]] += n
    longer = sorted((t for t in freq if len(t) > 1 and freq[t] > 1), key=lambda t: (-freq[t] * len(t), t))[: vocabulary.SEED_LEAST]
    found = vocabulary.seeds(table, 100)
    assert found == {t: freq[t] for t in [*(t for t in freq if len(t) == 1), *longer]}
    scores = {t: math.log(n / sum(found.values())) for t, n in found.items()}
    want = Counter()
    like = sum(n * vocabulary.expected_counts(w, n, scores, want) for w, n in words.items())
    got, total = vocabulary.expectation(table, scores)
    assert total == pytest.approx(like) and got.keys() == want.keys() and all(got[t] == pytest.approx(want[t]) for t in got)


def test_a_removal_costs_what_it_says():
    """The loss is the change of likelihood when all occurrences of a token are split into the others."""
    scores = {t: math.log(p) for t, p in {"a": 0.2, "b": 0.2, "c": 0.1, "ab": 0.3, "abc": 0.2}.items()}
    losses = vocabulary.removal_losses(scores, {"a": 20.0, "b": 20.0, "c": 10.0, "ab": 30.0, "abc": 20.0})
    spread = math.log(100 + 20)
    assert losses["abc"] == pytest.approx(20 * (math.log(0.2) - (math.log(50) - spread) - (math.log(30) - spread)))
    assert vocabulary.removal_losses(scores, {"a": 1.0})["abc"] == -math.inf


def test_unigram_fits_as_well_as_the_public_trainer(spark):
    tokenizers = pytest.importorskip("tokenizers")
    words = text_counts()
    table = spark.createDataFrame(list(words.items()), "piece string, n long")
    for size in (60, 120):
        mine = vocabulary.unigram_rounds(table, size, [])
        theirs = tokenizers.Tokenizer(tokenizers.models.Unigram())
        theirs.pre_tokenizer = tokenizers.pre_tokenizers.WhitespaceSplit()
        trainer = tokenizers.trainers.UnigramTrainer(vocab_size=size, special_tokens=[], show_progress=False, n_sub_iterations=2, shrinking_factor=0.75)
        theirs.train_from_iterator([w for w, n in words.items() for _ in range(n)], trainer)
        import json

        public = dict(json.loads(theirs.to_str())["model"]["vocab"])
        assert len(mine) <= size
        assert log_likelihood(words, mine) >= 1.01 * log_likelihood(words, {t: s for t, s in public.items() if t})


def test_coded_slices_equal_piece_by_piece(spark, monkeypatch):
    import pyarrow as pa

    from textloom.operators import tokenizer

    d = spark.createDataFrame([(1, "low lower lowest"), (2, None), (3, ""), (4, "new low newer é"), (5, "low")], "doc_id long, text string")
    model = tokenizer.train(d, "bpe", 280)
    lists = [["low", " lower"], None, [], [" low", "low", "é"], ["unseen"]]
    assert [x or [] for x in tokenizer.coded(model, pa.array(lists, pa.list_(pa.string()))).to_pylist()] == [[i for p in x or [] for i in model.piece_ids(p)] for x in lists]
    coded = tokenizer.encode(d, model)
    assert int(spark.conf.get("spark.sql.execution.arrow.maxRecordsPerBatch")) <= 512
    assert [r[0] for r in coded.select(tokenizer.decode_text(coded["tokens"], model)).collect()] == ["low lower lowest", "", "", "new low newer é", "low"]
