import bz2
import json

import pytest
from pyspark.sql import functions as F

from textloom import sinks
from textloom.config import Config
from textloom.metrics import Run, progress, read_metrics
from textloom.operators import explore, tokenizer
from textloom.pipeline import Pipeline
from textloom.sources import basic, wiki

TEXTS = ["The quick brown fox jumps over the lazy dog.", "Machine learning is a field of study.", "Natural language is how people talk, isn't it?"] * 20


def corpus(spark):
    return spark.createDataFrame([(i, t) for i, t in enumerate(TEXTS)], "doc_id long, text string")


def test_bpe_agrees_with_an_independent_implementation(spark):
    tokenizers = pytest.importorskip("tokenizers")
    mine = tokenizer.train(corpus(spark), "bpe", 200)
    theirs = tokenizers.Tokenizer(tokenizers.models.BPE(unk_token="<unk>"))
    theirs.pre_tokenizer = tokenizers.pre_tokenizers.ByteLevel(add_prefix_space=False)
    theirs.train_from_iterator(TEXTS, tokenizers.trainers.BpeTrainer(vocab_size=200, min_frequency=2, special_tokens=tokenizer.SPECIALS, show_progress=False))
    assert mine.vocab == theirs.get_vocab()
    got = tokenizer.encode(corpus(spark), mine).orderBy("doc_id").collect()
    assert [r["tokens"] for r in got] == [theirs.encode(t).ids for t in TEXTS]
    new = spark.createDataFrame([(0, "a new text, déjà vu")], "doc_id long, text string")
    assert tokenizer.encode(new, mine).first()["tokens"] == theirs.encode("a new text, déjà vu").ids


@pytest.mark.parametrize("algorithm", tokenizer.ALGORITHMS)
def test_training_and_use(spark, algorithm, tmp_path):
    m = tokenizer.train(corpus(spark), algorithm.upper(), 120)
    assert 0 < m.vocab_size() <= 140
    m.save(str(tmp_path / "t.json"))
    again = tokenizer.load(str(tmp_path / "t.json"))
    assert again.vocab == m.vocab
    df = spark.createDataFrame([(0, "The lazy fox"), (1, ""), (2, None), (3, "日本")], "doc_id long, text string")
    rows = tokenizer.encode(df, again).orderBy("doc_id").collect()
    assert rows[0]["tokens"] and rows[1]["tokens"] == [] and rows[2]["tokens"] == [] and set(rows[3]["tokens"]) == {m.unk}
    back = tokenizer.encode(df, m).where("doc_id = 0").select(tokenizer.decode_text(F.col("tokens"), m), tokenizer.decode_col(F.col("tokens"), m)).first()
    assert back[0].replace(" ", "") == "Thelazyfox" and back[1]
    assert tokenizer.vocab_table(spark, m).count() == m.vocab_size()


def test_unknown_algorithm(spark):
    with pytest.raises(ValueError):
        tokenizer.train(corpus(spark), "none")


def test_statistics(spark):
    df = spark.createDataFrame([("abcd", [1, 2]), ("ab", [3])], "text string, tokens array<int>")
    s = tokenizer.token_stats(df, 10).first()
    assert (s["total_tokens"], s["avg_tokens_per_doc"], s["compression_ratio"]) == (3, 1.5, 2.0)
    assert tokenizer.token_stats(df.limit(0), 10).first()["compression_ratio"] == 0.0


def test_training_from_files(spark, tmp_path):
    (tmp_path / "a.txt").write_text("\n".join(TEXTS))
    assert tokenizer.train_from_files(spark, [str(tmp_path / "a.txt")], vocab_size=100).vocab == tokenizer.train(corpus(spark), vocab_size=100).vocab


LONG = "An article about something, with enough words in it to be kept by the reader."


def dump(namespace):
    page = lambda title, ns, i, body, redirect="": f"<page><title>{title}</title><ns>{ns}</ns>{i}{redirect}{body}</page>"
    text = lambda t: f"<revision><id>9</id><text xml:space='preserve'>{t}</text></revision>"
    return f"<mediawiki{namespace}>" + "".join(
        [
            page("A", 0, "<id>1</id>", text(LONG + " &lt;b&gt;x&lt;/b&gt;")), page("Talk", 1, "<id>2</id>", text(LONG)), page("R", 0, "<id>3</id>", text(LONG), "<redirect title='A'/>"),
            page("S", 0, "<id>4</id>", text(LONG), "<redirect/>"), page("N", 0, "<id>5</id>", ""), page("E", 0, "<id>6</id>", "<revision><text/></revision>"), page("Short", 0, "<id>7</id>", text("x" * 49)),
            page("Just", 0, "<id>8</id>", text("x" * 50)), page("NoId", 0, "", text(LONG)), page("Two", 0, "<id>10</id>", text(LONG + " first") + text(LONG + " second")),
        ]
    ) + "</mediawiki>"


@pytest.mark.parametrize("namespace", ["", " xmlns='http://www.mediawiki.org/xml/export-0.10/'", " xmlns='http://www.mediawiki.org/xml/export-0.11/'"])
def test_dump(spark, tmp_path, namespace):
    (tmp_path / "d.xml.bz2").write_bytes(bz2.compress(dump(namespace).encode()))
    rows = wiki.read_wiki(spark, str(tmp_path / "d.xml.bz2")).orderBy("page_id").collect()
    assert [(r["page_id"], r["title"]) for r in rows] == [(0, "NoId"), (1, "A"), (4, "S"), (8, "Just"), (10, "Two")]
    assert rows[1]["text"] == LONG + " x" and rows[4]["text"].endswith("first")
    assert [r["page_id"] for r in wiki.read_wiki(spark, str(tmp_path / "d.xml.bz2"), max_articles=2).collect()] == [1, 4]
    assert wiki.decompress(str(tmp_path / "d.xml.bz2")).endswith("d.xml")


def test_sources_by_name():
    assert wiki.resolve_source("simplewiki").endswith(".bz2") and wiki.resolve_source("https://x.example/a") == "https://x.example/a"
    with pytest.raises(ValueError):
        wiki.resolve_source("custom")


def test_run_and_outputs(spark, tmp_path):
    articles = basic.sample_corpus(spark).withColumn("ord", F.col("id").cast("long"))
    articles = articles.union(articles.withColumn("ord", F.col("ord") + 100))
    run = Pipeline(spark, Config({"tokenization": {"vocab_size": 300}}))
    out = run.run(articles, str(tmp_path / "out"))
    assert out.count() == 5
    assert spark.read.parquet(str(tmp_path / "out/processed_data.parquet")).columns == ["id", "title", "text", "token_count"]
    saved = json.loads((tmp_path / "out/pipeline_metrics.json").read_text())
    assert saved["stages"]["deduplication"]["filtered_count"] == 5 and json.loads((tmp_path / "out/summary.json").read_text())["total_documents"] == 5
    assert "deduplication" in run.metrics.report()
    sinks.write_processed(out, str(tmp_path / "j"), "jsonl")
    assert set(spark.read.json(str(tmp_path / "j")).columns) == {"id", "title", "text", "tokens"}
    sinks.write_tokens(out, str(tmp_path / "t.json"), "json")
    assert len(json.loads((tmp_path / "t.json").read_text())["documents"]) == 5
    for f in (lambda: sinks.write_processed(out, "x", "csv"), lambda: sinks.write_tokens(out, "x", "arrow")):
        with pytest.raises(ValueError):
            f()


@pytest.mark.parametrize("algorithm", ["exact_hash", "simhash"])
def test_other_deduplication(spark, algorithm):
    articles = basic.sample_corpus(spark).withColumn("ord", F.col("id").cast("long"))
    cfg = Config({"deduplication": {"algorithm": algorithm}, "tokenization": {"enabled": False}})
    assert Pipeline(spark, cfg).run(articles.union(articles.withColumn("ord", F.col("ord") + 9))).count() == 5


def test_metrics_and_config(spark, tmp_path):
    run = Run()
    with run.stage("x") as watch:
        df = watch.observe(spark.range(10), rows_in=F.count(F.lit(1)), rows_out=F.count_if(F.col("id") > 1), most=F.max("id"))
        df.write.format("noop").mode("overwrite").save()
    assert run["x"].rows_out == 8 and run["x"].as_json()["filter_rate"] == 20.0 and run["x"].extra == {"most": 9}
    run.save(spark, f"file://{tmp_path}/m.json")
    row = read_metrics(spark, f"file://{tmp_path}/m.json").first()
    assert (row["stage"], row["input_count"], row["filtered_count"], row["filter_rate"]) == ("x", 10, 2, 20.0)
    assert progress(4)(2)["percent"] == 50.0
    (tmp_path / "c.json").write_text('{"quality": {"min_words": 7}}')
    c = Config.load(str(tmp_path / "c.json"))
    assert c.quality().min_words == 7 and c.quality().allowed_languages == ("en",) and c.get("a.b", 1) == 1
    c.set("a.b", 2)
    assert c.get("a.b") == 2 and c.path("raw_data").startswith(str(tmp_path))
    with pytest.raises(FileNotFoundError):
        Config.load("none.json")


def test_exploration(spark):
    df = explore.with_lengths(spark.createDataFrame([("a b", 1), ("abcdef", 2), ("", 3)], "text string, doc_id long"))
    h = explore.histogram(df, "text_length", 3).orderBy("bin").collect()
    assert [r["n"] for r in h] == [1, 1, 1]
    assert explore.describe(df, ["word_count"]).first()["p50"] == 1.0
    assert explore.sample(df, 2).count() == 2
    assert [r["doc_id"] for r in explore.sample(df.repartition(7), 2).collect()] == [r["doc_id"] for r in explore.sample(df, 2).collect()]
    assert explore.describe(df, ["word_count", "text_length"], accuracy=1000).count() == 2
    assert explore.describe(df.limit(0), ["word_count"]).first()["count"] == 0


@pytest.mark.parametrize("algorithm", tokenizer.ALGORITHMS)
def test_queries_train_on_pieces_met_once(spark, tmp_path, algorithm):
    from textloom.plans import token_queries

    spark.createDataFrame([(1, "same same words words Ω")], "doc_id long, text string").write.parquet(f"{tmp_path}/documents.parquet")
    vocab = token_queries.model(spark, str(tmp_path), algorithm).vocab
    assert set(tokenizer.to_bytes_alphabet("Ω") if algorithm == "bpe" else "Ω") <= set(vocab)


def test_nested_templates_go_at_any_depth(spark):
    import re

    from textloom.operators import wiki as markup

    def again(t):
        while t != (t := re.sub(r"\{\{[^{}]*\}\}", "", t)):
            pass
        return t

    deep = "a" + "{{t|" * 20 + "x" + "}}" * 20 + "b"
    texts = [deep, "a {{x {{y}} z}} b", "{{{p}}} {{open {{in}}", "no }} open", "{{a {b} c}}", None, "", "{{" * 50000 + "}}" * 50000]
    got = [r[0] for r in spark.createDataFrame(list(enumerate(texts)), "i int, t string").orderBy("i").select(markup.strip_nested_templates(F.col("t"))).collect()]
    assert got[0] == "ab" and got[-1] == "" and got[5] is None and got[6] == ""
    assert got[1:5] == [again(t) for t in texts[1:5]]


def test_wordpiece_agrees_with_an_independent_implementation(spark):
    tokenizers = pytest.importorskip("tokenizers")
    mine = tokenizer.train(corpus(spark), "wordpiece", 150)
    theirs = tokenizers.Tokenizer(tokenizers.models.WordPiece(mine.vocab, unk_token="<unk>"))
    theirs.pre_tokenizer = tokenizers.pre_tokenizers.Whitespace()
    texts = TEXTS + ["a new text, with words", "unseen 日本"]
    df = spark.createDataFrame(list(enumerate(texts)), "doc_id long, text string")
    assert [r["tokens"] for r in tokenizer.encode(df, mine).orderBy("doc_id").collect()] == [theirs.encode(t).ids for t in texts]


def test_unigram_agrees_with_an_independent_implementation(spark):
    tokenizers = pytest.importorskip("tokenizers")
    mine = tokenizer.train(corpus(spark), "unigram", 150)
    order = sorted(mine.vocab, key=mine.vocab.get)
    theirs = tokenizers.Tokenizer(tokenizers.models.Unigram([(t, mine.scores.get(t, -100.0)) for t in order], unk_id=mine.unk))
    theirs.pre_tokenizer = tokenizers.pre_tokenizers.Whitespace()
    score = lambda ids: sum(mine.scores[order[i]] for i in ids)
    df = spark.createDataFrame(list(enumerate(TEXTS[:3])), "doc_id long, text string")
    for t, r in zip(TEXTS[:3], tokenizer.encode(df, mine).orderBy("doc_id").collect(), strict=True):
        assert abs(score(r["tokens"]) - score(theirs.encode(t).ids)) < 1e-6  # ties may fall either way


def test_a_run_with_a_perplexity_filter(spark, tmp_path):
    """Against a saved model, or the corpus itself; what is too perplexing goes before tokens are counted."""
    from textloom.operators import perplexity

    plain = "the men of the sea went to the town and the women of the town went to the sea with the men " * 4
    odd = " ".join(f"word{i} thing{i * 7} other{i * 3}" for i in range(30)).replace("1", "a").replace("2", "b")
    articles = spark.createDataFrame([(i, str(i), "t", f"{plain} number {i}") for i in range(8)] + [(9, "9", "t", odd)], "ord long, id string, title string, text string")
    perplexity.train(articles.where("ord < 9")).save(f"file://{tmp_path}/model")
    for path in (f"file://{tmp_path}/model", None):
        quality = {"max_digit_ratio": 1.0, "min_alphabetic_ratio": 0.0, "language_filter": {"enabled": False}, "max_repetition_ratio": 1.0}
        quality["perplexity_filter"] = {"enabled": True, "model_path": path, "max_perplexity": 30 if path else 1e9}
        run = Pipeline(spark, Config({"deduplication": {"enabled": False}, "quality": quality, "tokenization": {"vocab_size": 100}}))
        assert (9 in {r["ord"] for r in run.run(articles).collect()}) == (path is None)
        assert run.metrics["perplexity"].rows_in == 9 and run.metrics["perplexity"].rows_out == (8 if path else 9)


def test_the_command_line(spark, tmp_path, monkeypatch, capsys):
    from textloom import cli

    (tmp_path / "d.xml").write_text(dump("").replace(LONG, (LONG + " ") * 6))
    (tmp_path / "c.json").write_text('{"tokenization": {"vocab_size": 300}, "quality": {"min_words": 5}}')
    assert cli.main(["--wiki-dump", str(tmp_path / "d.xml"), "--output-dir", str(tmp_path / "out"), "--config", str(tmp_path / "c.json")]) == 0
    assert "tokenization" in capsys.readouterr().out and (tmp_path / "out/summary.json").exists()
