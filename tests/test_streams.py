import os
import time

from pyspark.sql import functions as F

from textloom.operators import clean, dedup, quality
from textloom.streaming import dedup as streams

SCHEMA = "doc_id long, text string"


def text(i, odd=""):
    return " ".join(f"word{(i * 37 + k) % 997}" for k in range(40)) + odd


def feed(spark, path, rows):
    spark.createDataFrame(rows, SCHEMA).coalesce(1).write.mode("append").parquet(path)


def near(spark, path, kept, **options):
    """All files so far through the query, which starts from its state."""
    sink = lambda df, epoch: kept.update({epoch: sorted(r["doc_id"] for r in df.collect())})
    stream = spark.readStream.schema(SCHEMA).parquet(f"{path}/in")
    q = stream.writeStream.foreachBatch(streams.near_stream_batch(f"{path}/state", sink, **options)).option("checkpointLocation", f"{path}/c").trigger(availableNow=True).start()
    q.awaitTermination()


def test_old_state_goes_and_near_copies_within_the_window_are_found(spark, tmp_path):
    kept = {}
    for n in range(4):
        feed(spark, f"{tmp_path}/in", [(n * 10, text(n)), (n * 10 + 1, text(0, " end")), (n * 10 + 2, text(n, " again"))])
        near(spark, str(tmp_path), kept, keep_batches=1)
    # The copy of text 0 is unknown again as soon as the batch that kept it is out of the window.
    assert kept == {0: [0], 1: [10], 2: [20, 21], 3: [30]}
    assert sorted(x for x in os.listdir(f"{tmp_path}/state/bands") if x.startswith("epoch=")) == ["epoch=2", "epoch=3"]


def test_batches_in_order_decide_as_one_pass(spark, tmp_path):
    rows = [(i, text(i % 7, " x" * (i % 3))) for i in range(30)] + [(30, None), (31, ""), (32, "ab")]
    kept = {}
    for k in range(0, len(rows), 11):
        feed(spark, f"{tmp_path}/in", rows[k : k + 11])
        near(spark, str(tmp_path), kept)
    once = dedup.deduplicate(spark.createDataFrame(rows, SCHEMA), ord_col="doc_id")
    assert sorted(x for ids in kept.values() for x in ids) == sorted(r["doc_id"] for r in once.collect())


def test_stages_without_state_do_on_a_stream_what_they_do_on_a_table(spark, tmp_path):
    rows = [(0, text(1) + " see https://x.example/a and u@mail.example.org [3]"), (1, None), (2, ""), (3, "short"), (4, "12 34 " * 60), (5, text(2) * 3), (5, text(2) * 3)]
    for k in range(0, len(rows), 3):
        feed(spark, f"{tmp_path}/in", rows[k : k + 3])

    def judged(df):
        cleaned = clean.survivors(clean.with_cleaned(df, cfg=clean.CleanConfig(min_length_chars=20)))
        return quality.with_quality(cleaned, "cleaned").select("doc_id", "cleaned", F.col("quality.reason").alias("reason"))

    stream = spark.readStream.schema(SCHEMA).option("maxFilesPerTrigger", 1).parquet(f"{tmp_path}/in")
    told = []
    listener = streams.Progress(lambda n, rate: told.append(n))
    spark.streams.addListener(listener)
    try:
        q = judged(stream).writeStream.format("parquet").option("path", f"{tmp_path}/out").option("checkpointLocation", f"{tmp_path}/c").trigger(availableNow=True).start()
        q.awaitTermination()
        for _ in range(100):
            if listener.rows >= len(rows):
                break
            time.sleep(0.1)
    finally:
        spark.streams.removeListener(listener)
    got = sorted(map(tuple, spark.read.parquet(f"{tmp_path}/out").collect()))
    assert got == sorted(map(tuple, judged(spark.createDataFrame(rows, SCHEMA)).collect())) and len(got) == 4
    assert listener.rows == len(rows) and told == sorted(told) and len(told) >= 3


def test_files_of_a_stream_are_of_a_bounded_size(spark, tmp_path, monkeypatch):
    from textloom.plans import token_queries as q

    spark.range(1000).selectExpr("id AS doc_id", "repeat(md5(string(id)), 20) AS text").write.parquet(str(tmp_path / "documents.parquet"))
    monkeypatch.setattr(q, "STREAM_FILE_BYTES", 5000)
    folder, n = q._folder(spark, str(tmp_path), f"file://{tmp_path}/stream")
    assert n > 4 and len(list((tmp_path / "stream/source").glob("*.parquet"))) == n
    assert q.stream_exact_dedup(spark, str(tmp_path)).first()["n"] == 1000


def test_large_tables_are_read_in_small_splits(spark, tmp_path):
    from textloom.operators import storage
    from textloom.plans.text_queries import docs

    spark.range(10).selectExpr("id AS doc_id", "'a' AS text").write.parquet(str(tmp_path / "documents.parquet"))
    for before, after in (("128MB", str(storage.SPLIT_BYTES)), ("1m", "1m")):
        spark.conf.set(storage.SPLIT_KEY, before)
        assert docs(spark, str(tmp_path)).count() == 10 and spark.conf.get(storage.SPLIT_KEY) in (after, "1048576b")
    spark.conf.unset(storage.SPLIT_KEY)


def test_a_batch_signs_each_text_once(spark, tmp_path, monkeypatch):
    signed = []
    sign = dedup.signature
    monkeypatch.setattr(dedup, "signature", lambda *args: signed.append(args) or sign(*args))
    kept = {}
    for k, rows in enumerate(([(i, text(i % 5, " x" * (i % 3))) for i in range(20)], [(20, text(1)), (21, text(1)), (22, text(9)), (23, text(9)), (24, text(9, " y"))])):
        feed(spark, f"{tmp_path}/in", rows)
        near(spark, str(tmp_path), kept)
        assert len(signed) == k + 1
    assert kept == {0: [0, 1, 2, 3, 4], 1: [22]}
    state = {n: sorted(r["ord"] for r in spark.read.parquet(f"{tmp_path}/state/{n}").select("ord").distinct().collect()) for n in ("bands", "texts")}
    assert state["bands"] == state["texts"] == [0, 1, 2, 3, 4, 22]


def test_the_halves_of_a_stream_are_dealt_into_files(spark, tmp_path, monkeypatch):
    from textloom.plans import token_queries as q

    rows = [(i, text(i)) for i in range(40)]
    spark.createDataFrame(rows, SCHEMA).coalesce(1).write.parquet(str(tmp_path / "documents.parquet"))
    monkeypatch.setattr(q, "STREAM_FILE_BYTES", 200)
    monkeypatch.setattr(q, "docs", lambda spark, sf_dir: spark.read.parquet(f"{sf_dir}/documents.parquet"))
    monkeypatch.setattr(q, "shared_dir", lambda spark: f"file://{tmp_path}/stream")
    assert q.stream_minhash_dedup(spark, str(tmp_path)).count() == dedup.deduplicate(spark.createDataFrame(rows, SCHEMA)).count()
    assert len(list((tmp_path / "stream/source").glob("*.parquet"))) >= 8


def test_the_demonstration_reads_pages_in_small_splits(spark, tmp_path, monkeypatch):
    from textloom.operators import storage
    from textloom.plans import token_queries as q

    spark.createDataFrame([(1, "u", "<p>a</p>")], "page_id long, url string, html string").write.parquet(str(tmp_path / "pages.parquet"))
    monkeypatch.setattr(q.Pipeline, "run", lambda self, articles: articles.selectExpr("id", "title", "array(1) AS tokens"))
    spark.conf.set(storage.SPLIT_KEY, "128MB")
    assert q.demo_corpus(spark, str(tmp_path)).count() == 1 and spark.conf.get(storage.SPLIT_KEY) == str(storage.SPLIT_BYTES)
    spark.conf.unset(storage.SPLIT_KEY)
