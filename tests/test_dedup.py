import random

import pytest
from pyspark.sql import functions as F

from textloom.operators import dedup
from textloom.streaming import dedup as streams


def docs(spark, *texts):
    return spark.createDataFrame(list(enumerate(texts)), "doc_id long, text string")


def sets(text, k=5):
    t = " ".join(text.lower().split()) if text.strip() == text else " ".join(text.lower().split(" "))
    return {t[i : i + k] for i in range(len(t) - k + 1)}


def test_exact_copies_and_short_texts(spark):
    d = docs(spark, "the same text here", "another text altogether", "The  same text HERE", "abc", "xyz", None)
    got = {r["ord"]: r["original"] for r in dedup.near_duplicates(d).collect()}
    assert got == {0: None, 1: None, 2: 0, 3: None, 4: 3, 5: 3}


def test_first_seen_stays_in_a_chain(spark):
    nodes = spark.createDataFrame([(i,) for i in range(6)], "ord long")
    edges = spark.createDataFrame([(0, 1), (1, 2), (3, 2), (3, 4)], "a long, b long")
    got = {r["ord"]: r["original"] for r in dedup.leaders(nodes, edges).collect()}
    # 0 stays, 1 goes, so 2 stays; 3 goes because of 2, so 4 stays.
    assert got == {0: None, 1: 0, 2: None, 3: 2, 4: None, 5: None}


@pytest.mark.parametrize("seed", [1, 2])
def test_leaders_equal_the_sequential_rule(spark, seed):
    rng = random.Random(seed)
    edges = {tuple(sorted(rng.sample(range(40), 2))) for _ in range(60)}
    kept, want = [], {}
    for i in range(40):
        near = [k for k in kept if (k, i) in edges]
        want[i] = min(near) if near else None
        if not near:
            kept.append(i)
    nodes = spark.createDataFrame([(i,) for i in range(40)], "ord long")
    got = {r["ord"]: r["original"] for r in dedup.leaders(nodes, spark.createDataFrame(sorted(edges), "a long, b long")).collect()}
    assert got == want


def test_near_copies_are_found_and_others_left(spark):
    words = "alpha beta gamma delta epsilon zeta eta theta iota kappa lambda mu nu xi omicron pi rho sigma tau upsilon phi chi psi omega".split()
    rng = random.Random(3)
    base = " ".join(rng.choice(words) for _ in range(300))
    d = docs(spark, base, base.replace("omega", "omegas", 1), " ".join(rng.choice(words) + str(i) for i in range(300)))
    assert sorted(r["doc_id"] for r in dedup.deduplicate(d).collect()) == [0, 2]
    assert dedup.result(dedup.near_duplicates(d)).first()["duplicate_documents"] == 1


def test_empty_input(spark):
    d = spark.createDataFrame([], "doc_id long, text string")
    assert dedup.deduplicate(d).count() == 0
    assert dedup.result(dedup.near_duplicates(d)).first()["dedup_rate"] == 0.0


@pytest.mark.parametrize("algorithm", dedup.EXACT_ALGORITHMS)
def test_exact_hash_ignores_case_and_outer_blanks(spark, algorithm):
    d = docs(spark, "Hello world", "Hello World ", "HELLO WORLD", "other")
    assert [r["is_duplicate"] for r in dedup.exact_duplicates(d, algorithm).orderBy("doc_id").collect()] == [False, True, True, False]


def test_unknown_hash(spark):
    with pytest.raises(ValueError):
        dedup.content_hash(F.col("text"), "crc")


def test_band_shapes():
    assert dedup.band_shape(0.8, 128) == (9, 13) and dedup.band_shape(0.5, 128) == (25, 5)


def test_streams_agree_with_batches(spark, tmp_path):
    texts = ["one text that is long enough to count", "another text that is rather different", "One text that is long enough to count", "yet one more line of some length here", "another text that is rather different"]
    for i, t in enumerate(texts):
        docs(spark, t).withColumn("doc_id", F.lit(i).cast("long")).coalesce(1).write.mode("append").parquet(str(tmp_path / "in"))
    schema = "doc_id long, text string"
    read = lambda: spark.readStream.schema(schema).option("maxFilesPerTrigger", 1).parquet(str(tmp_path / "in"))
    q = streams.exact_stream(read()).writeStream.format("parquet").option("path", str(tmp_path / "exact")).option("checkpointLocation", str(tmp_path / "c1")).trigger(availableNow=True).start()
    q.awaitTermination()
    assert spark.read.parquet(str(tmp_path / "exact")).count() == 3
    sink = lambda df, epoch: df.write.mode("overwrite").parquet(str(tmp_path / f"near/epoch={epoch}"))
    q = read().writeStream.foreachBatch(streams.near_stream_batch(str(tmp_path / "state"), sink)).option("checkpointLocation", str(tmp_path / "c2")).trigger(availableNow=True).start()
    q.awaitTermination()
    assert spark.read.parquet(str(tmp_path / "near")).count() == 3


def test_simhash_of_near_texts_differs_in_few_bits(spark):
    base = " ".join(f"word{i}" for i in range(200))
    rows = docs(spark, base, base + " extra", " ".join(f"other{i}" for i in range(200))).orderBy("doc_id").select(dedup.simhash(F.col("text"))).collect()
    a, b, c = (r[0] for r in rows)
    assert bin(a ^ b).count("1") < 12 < bin(a ^ c).count("1")


def sequential(edges, n):
    kept, want = [], {}
    for i in range(n):
        near = [k for k in kept if (k, i) in edges]
        want[i] = min(near) if near else None
        if not near:
            kept.append(i)
    return want


def test_large_components_are_solved_in_rounds(spark):
    rng = random.Random(4)
    edges = {tuple(sorted(rng.sample(range(30), 2))) for _ in range(50)}
    nodes = spark.createDataFrame([(i,) for i in range(30)], "ord long")
    got = dedup.leaders(nodes, spark.createDataFrame(sorted(edges), "a long, b long"), limit=5).collect()
    assert {r["ord"]: r["original"] for r in got} == sequential(edges, 30)


def test_a_long_chain_takes_few_rounds(spark, monkeypatch):
    written = []
    monkeypatch.setattr(dedup, "store", lambda df, path, f=dedup.store: written.append(path) or f(df, path))
    edges = [(i, i + 1) for i in range(999)]
    nodes = spark.createDataFrame([(i,) for i in range(1000)], "ord long")
    got = {r["ord"]: r["original"] for r in dedup.leaders(nodes, spark.createDataFrame(edges, "a long, b long")).collect()}
    assert got == {i: None if i % 2 == 0 else i - 1 for i in range(1000)} and len(written) <= 14


def test_near_duplicates_equal_the_sequential_rule(spark):
    """One large group of near copies, small groups, and short texts, against each text in turn."""
    rng = random.Random(6)
    words = [f"word{i}" for i in range(60)]
    bases = [[rng.choice(words) for _ in range(60)] for _ in range(6)]
    texts = []
    for i in range(150):
        t = list(bases[0] if i % 2 else rng.choice(bases))
        for _ in range(rng.choice([0, 1, 2, 4, 8])):
            t[rng.randrange(60)] = rng.choice(words)
        texts.append(" ".join(t))
    texts += ["ab", "", None, texts[3].upper()]
    cfg = dedup.DedupConfig(threshold=0.6, num_perm=64)
    d = docs(spark, *texts)
    pairs = dedup.candidate_pairs(dedup.bands(dedup.signatures(d, cfg), cfg)).collect()
    cut = [sets(t or "") for t in texts]
    alike = lambda x, y: 1.0 if not x and not y else len(x & y) / len(x | y)
    edges = {(r["a"], r["b"]) for r in pairs if alike(cut[r["a"]], cut[r["b"]]) >= 0.6}
    assert len(edges) > 500
    assert {r["ord"]: r["original"] for r in dedup.near_duplicates(d, cfg).collect()} == sequential(edges, len(texts))


def test_only_results_are_left(spark):
    import os

    from textloom.operators import storage

    storage.release(spark)
    base = spark.conf.get("spark.checkpoint.dir").removeprefix("file://")
    own = lambda: [x for x in os.listdir(base) if x.startswith("textloom-")]
    assert dedup.near_duplicates(docs(spark, "some text of a length", "some text of a length!", "other")).count() == 3
    assert len(own()) == 1
    with pytest.raises(Exception):
        with storage.temporary(spark):
            dedup.store(docs(spark, "x"), storage.shared_dir(spark))
            raise RuntimeError
    assert len(own()) == 1
    storage.release(spark)
    assert own() == []


def test_a_cluster_needs_a_shared_folder(spark):
    from textloom.operators import storage

    class Conf:
        def __init__(self, master):
            self.values = {"spark.master": master}

        def get(self, key, default=None):
            return self.values.get(key, default)

    for master in ("yarn", "local-cluster[3,2,1024]", "spark://host:7077"):
        with pytest.raises(RuntimeError):
            storage.shared_dir(type("S", (), {"conf": Conf(master)})())


def test_simhash_finds_near_texts(spark):
    base = " ".join(f"word{i}" for i in range(400))
    d = docs(spark, base, base + " extra", " ".join(f"other{i}" for i in range(400)), base, "")
    got = {r["ord"]: r["original"] for r in dedup.simhash_duplicates(d, 3).collect()}
    hashes = {r["doc_id"]: r["h"] for r in d.select("doc_id", dedup.simhash(F.col("text")).alias("h")).collect()}
    near = {(a, b) for a in hashes for b in hashes if a < b and (hashes[a] ^ hashes[b]).bit_count() <= 3}
    assert got == sequential(near, 5) and got[3] == 0 and got[1] == 0 and got[2] is None
    assert {r["doc_id"] for r in dedup.simhash_deduplicate(d).collect()} == {0, 2, 4}


def test_pairs_of_copies_are_made_at_the_end(spark, monkeypatch):
    monkeypatch.setattr(dedup, "TILE", 2)
    monkeypatch.setattr(dedup, "BLOCK", 2)
    rng = random.Random(5)
    base = " ".join(str(rng.randint(100, 999)) for _ in range(200))
    texts = [base] * 5 + [base + f" {i}" for i in range(7)] + [base + " 3"] * 2 + ["ab", "", None] + [" ".join(str(rng.randint(100, 999)) for _ in range(200))]
    compared, jaccard = [], dedup.jaccard
    monkeypatch.setattr(dedup, "jaccard", lambda pairs, *rest: (compared.append(pairs.count()), jaccard(pairs, *rest))[1])
    got = {(r["a"], r["b"]): r["jaccard"] for r in dedup.similar_pairs(docs(spark, *texts)).collect()}
    cut = [sets(t or "") for t in texts]
    alike = {(a, b): len(cut[a] & cut[b]) / len(cut[a] | cut[b]) if cut[a] | cut[b] else 1.0 for b in range(len(texts)) for a in range(b)}
    assert got == {p: pytest.approx(j) for p, j in alike.items() if j >= 0.8}
    assert compared == [8 * 7 // 2]  # of different texts only


def test_signatures_are_the_least_remainders(spark):
    text = "".join(chr(random.Random(i).randint(97, 2000)) for i in range(3000))
    h = dedup.shingle_hashes(text, 5).tolist()
    want = [min((a * x + b) % dedup.P for x in h) for a, b in dedup.coefficients(128)]
    d = docs(spark, text, "abc")
    got = [r["s"] for r in d.select(dedup.signature(F.col("text")).alias("s")).collect()]
    assert got == [want, [dedup.EMPTY] * 128]


def test_shingles_are_counted_exactly_over_any_alphabet(spark):
    rng = random.Random(8)
    wide = "".join(chr(rng.randint(0x4E00, 0x9FFF)) for _ in range(60_000))  # more kinds than five of them fit into a number
    texts = ["ab", "aaaaaaa", "abcdefg abcdefg", "😀😀😀😀😀😀a", wide + wide[:50], None]
    d = docs(spark, *texts)
    got = [r["n"] for r in d.select("doc_id", dedup.shingle_count(F.col("text")).alias("n")).orderBy("doc_id").collect()]
    assert got == [len({t[i : i + 5] for i in range(len(t) - 4)}) if t else 0 for t in texts]
