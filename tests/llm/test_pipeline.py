import pytest

corpus_pipeline = pytest.importorskip("corpus_pipeline")

from textloom.llm import decontaminate, jaccard_join, quality_rules, secrets  # noqa: E402

SF = "/root/testdata/sf0.001"


def test_stages_by_hand(spark):
    """The run equals its stages applied one text at a time to collected rows."""
    docs = spark.read.parquet(f"{SF}/documents.parquet")
    model = quality_rules.train(docs, spark.read.parquet(f"{SF}/labels.parquet"))
    rows = sorted((r["doc_id"], r["text"]) for r in docs.collect())

    def good(t):
        n, *_, repeated = quality_rules.base_counts(t)
        return n >= 50 and 2 * repeated <= n and model.probability(t) >= quality_rules.KEEP

    rows = [(i, t) for i, t in rows if good(t)]
    from tests.llm.test_jaccard_join import brute

    first = {c for _, c in brute(rows, 80, k=5).values()}
    index = decontaminate.build([(r["item_id"], r["text"]) for r in spark.read.parquet(f"{SF}/benchmark.parquet").collect()])
    rows = [(i, secrets.masked(t)) for i, t in rows if i in first and not decontaminate.matches(index, t)]
    import numpy as np

    from textloom.llm.byte_bpe import vocabulary
    from textloom.llm.tokens import byte_pieces

    coded = byte_pieces(*vocabulary()).encode([t for _, t in rows])
    want = {i: np.frombuffer(c, "<u4").tolist() for (i, _), c in zip(rows, coded, strict=True)}
    got = corpus_pipeline.run(spark, SF).collect()
    assert {r["doc_id"]: r["ids"] for r in got} == want and all(r["decodes"] for r in got)
    assert 0 < len(want) < 200 and jaccard_join.PERCENT == 90


def test_stages_keep_the_columns(spark):
    docs = spark.read.parquet(f"{SF}/documents.parquet")
    for _, stage in corpus_pipeline.STAGES[:-1]:
        docs = stage(spark, docs, SF)
        assert docs.columns == corpus_pipeline.COLUMNS


def test_stages_on_no_rows(spark):
    none = spark.read.parquet(f"{SF}/documents.parquet").limit(0)
    for _, stage in corpus_pipeline.STAGES:
        assert stage(spark, none, SF).count() == 0


def test_near_copies_by_five_words(spark):
    """Copies with a five-word Jaccard similarity of 0.8, but under 0.9 by three words, are one group."""
    words = [f"w{i}" for i in range(204)]
    block = words[:190] + [f"x{i}" for i in range(14)]  # 186 of 214 five-word shingles are shared: 0.87
    edited = [f"y{i}" if i in (40, 80, 120, 160) else w for i, w in enumerate(words)]  # 180 of 220: 0.82
    far = [f"z{i}" if i in (30, 60, 90, 120, 150) else w for i, w in enumerate(words)]  # 175 of 225: 0.78
    texts = [words, block, edited, far]

    def jaccard(x, y, k):
        a, b = ({tuple(t[i : i + k]) for i in range(len(t) - k + 1)} for t in (x, y))
        return len(a & b) / len(a | b)

    assert jaccard(words, block, 5) >= 0.8 > jaccard(words, far, 5) and jaccard(words, edited, 5) >= 0.8
    assert jaccard(words, block, 3) < 0.9 and jaccard(words, edited, 3) < 0.9
    docs = spark.createDataFrame([(i, " ".join(t), "en", "s", 1) for i, t in enumerate(texts)], "doc_id long, text string, lang string, source string, n_chars long")
    assert {r["doc_id"] for r in corpus_pipeline.near_duplicates(spark, docs, SF).collect()} == {0, 3}


def test_a_run_leaves_only_its_result(spark):
    import os

    from textloom.operators import storage

    storage.release(spark)
    base = spark.conf.get("spark.checkpoint.dir").removeprefix("file://")
    own = lambda d: [x for x in os.listdir(d) if x.startswith("textloom-")]
    got = corpus_pipeline.run(spark, SF)
    assert got.count() > 0 and len(own(base)) == 1
    storage.release(spark)
    assert own(base) == []


@pytest.mark.parametrize("name", [n for n, _ in corpus_pipeline.STAGES])
def test_stages_on_odd_rows(spark, name):
    """Null ids and texts, empty and very long texts, repeated rows, ties and further columns."""
    clean = "the quick brown fox of the hill and the dog by the river " * 1
    long = " ".join(f"word{i} of the text" for i in range(8000))
    rows = [(1, None), (2, ""), (None, clean), (None, None), (3, long), (4, clean), (4, clean), (5, clean), (6, " \n\t ")]
    docs = spark.createDataFrame([(i, t, "en", None, None, 7, "c") for i, t in rows], "doc_id long, text string, lang string, source string, n_chars long, id int, component_id string")
    got = dict(corpus_pipeline.STAGES)[name](spark, docs, SF)
    ids = [r["doc_id"] for r in got.collect()]
    if name == "byte_bpe":
        assert len(ids) == len(rows)
        return
    assert got.columns == corpus_pipeline.COLUMNS
    if name == "quality_rules":
        assert 1 not in ids and 2 not in ids and 6 not in ids
    elif name == "jaccard_join":
        assert sorted(map(str, ids)) == sorted(["1", "2", "None", "None", "3", "4", "6"])
    else:
        assert len(ids) == len(rows)
