"""Queries of the tokenizers, sources, streams and the whole run."""

from __future__ import annotations

from pyspark.sql import functions as F

from textloom.config import Config
from textloom.functions import text as T
from textloom.operators import dedup, quality, tokenizer
from textloom.operators import wiki as markup
from textloom.operators.storage import plan_bytes, shared_dir, small_splits
from textloom.pipeline import Pipeline
from textloom.plans.catalogue import register
from textloom.plans.dedup_queries import LEADER_SQL
from textloom.plans.text_queries import DOC_MEASURES, WS, docs, final_sql, markup_sql
from textloom.sources import wiki
from textloom.streaming import dedup as streams

#: Vocabulary of the whole run, as in the sample report.
VOCAB_SIZE = 32000
PIECES_SQL = f"regexp_extract_all(text, '[\\p{{L}}\\p{{M}}\\p{{N}}_]+|[^\\p{{L}}\\p{{M}}\\p{{N}}_{WS}]+')"


@register("pretokens", f"SELECT doc_id, len({PIECES_SQL})::BIGINT AS n, md5(array_to_string({PIECES_SQL}, '|')) AS pieces_md5 FROM documents")
def pretokens(spark, sf_dir):
    p = T.pretokens(F.col("text"), T.WORDPIECE)
    return docs(spark, sf_dir).select("doc_id", F.size(p).cast("long").alias("n"), F.md5(F.array_join(p, "|")).alias("pieces_md5"))


@register("pretoken_freq", f"SELECT piece, count(*) AS n FROM (SELECT unnest({PIECES_SQL}) AS piece FROM documents) GROUP BY piece")
def pretoken_freq(spark, sf_dir):
    return tokenizer.piece_counts(docs(spark, sf_dir), "wordpiece")


#: A mark before the last blank of a run that a word follows stands for the look-ahead, which the other engine lacks.
BYTE_PIECES_SQL = (
    f"regexp_extract_all(regexp_replace(text, '([{WS}]+)([{WS}][^{WS}])', '\\1' || chr(57344) || '\\2', 'g'),"
    f" '''s|''t|''re|''ve|''m|''ll|''d| ?\\p{{L}}+| ?\\p{{N}}+| ?[^{WS}\\p{{L}}\\p{{N}}\\x{{E000}}]+|[{WS}]+')"
)
BYTES_SQL = "[" + ", ".join("'" + c.replace("'", "''") + "'" for _, c in sorted(tokenizer.byte_alphabet().items())) + "]"
BYTE_SQL = f"""WITH p AS (SELECT doc_id, {BYTE_PIECES_SQL} AS ps FROM documents),
  m AS (SELECT doc_id, len(ps)::BIGINT AS n, list_transform(ps, lambda p: array_to_string(list_transform(regexp_extract_all(hex(encode(p)), '..'), lambda h: {BYTES_SQL}[('0x' || h)::INTEGER + 1]), '')) AS ms FROM p)
SELECT doc_id, n, md5(array_to_string(ms, '|')) AS pieces_md5 FROM m"""


@register("byte_pretokens", BYTE_SQL)
def byte_pretokens(spark, sf_dir):
    p = tokenizer.byte_pretokens(F.col("text"))
    return docs(spark, sf_dir).select("doc_id", F.size(p).cast("long").alias("n"), F.md5(F.array_join(p, "|")).alias("pieces_md5"))


@register("pretoken_stats", f"""SELECT count(*) AS total_documents, sum(len({PIECES_SQL}))::BIGINT AS total_tokens, sum(length(text))::BIGINT AS total_chars, 0 AS vocab_size,
    round(sum(len({PIECES_SQL}))::DOUBLE / count(*), 6) AS avg_tokens_per_doc, round(sum(length(text))::DOUBLE / sum(len({PIECES_SQL})), 6) AS compression_ratio FROM documents""")
def pretoken_stats(spark, sf_dir):
    stats = tokenizer.token_stats(docs(spark, sf_dir).withColumn("tokens", T.pretokens(F.col("text"), T.WORDPIECE)), 0)
    return stats.withColumns({c: F.round(c, 6) for c in ("avg_tokens_per_doc", "compression_ratio")})


def model(spark, sf_dir, algorithm, size=1000):
    """Trained on all pieces of all texts."""
    return tokenizer.train(docs(spark, sf_dir), algorithm, size)


@register("bpe_vocab")
def bpe_vocab(spark, sf_dir):
    return tokenizer.vocab_table(spark, model(spark, sf_dir, "bpe"))


def _encoded(algorithm):
    def query(spark, sf_dir):
        coded = tokenizer.encode(docs(spark, sf_dir), model(spark, sf_dir, algorithm))
        return coded.select("doc_id", F.size("tokens").cast("long").alias("n_tokens"), F.md5(F.array_join("tokens", ",")).alias("tokens_md5"))

    return query


for _algorithm in tokenizer.ALGORITHMS:
    register(f"{_algorithm}_encode")(_encoded(_algorithm))


@register("bpe_round_trip", "SELECT count(*) AS n, count(*) AS same FROM documents")
def bpe_round_trip(spark, sf_dir):
    m = model(spark, sf_dir, "bpe")
    coded = tokenizer.encode(docs(spark, sf_dir), m)
    return coded.agg(F.count("*").alias("n"), F.count_if(tokenizer.decode_text(F.col("tokens"), m) == F.col("text")).alias("same"))


@register("token_stats")
def token_stats(spark, sf_dir):
    m = model(spark, sf_dir, "bpe")
    return tokenizer.token_stats(tokenizer.encode(docs(spark, sf_dir), m), m.vocab_size())


def _xml(spark, sf_dir) -> str:
    """The corpus as a small dump: written by Spark, one page per document; every fifth page is not an article."""
    path = f"{shared_dir(spark)}/dump"
    d = docs(spark, sf_dir)
    page = d.select(
        F.concat(F.lit("Page "), "doc_id").alias("title"),
        F.when(F.col("doc_id") % 5 == 4, 1).otherwise(0).alias("ns"),
        F.col("doc_id").alias("id"),
        F.when(F.col("doc_id") % 7 == 6, F.struct(F.lit("Other").alias("_title"))).alias("redirect"),
        F.struct(F.concat("text", F.lit(" {{box}} '''end''' of [[Page|page]]")).alias("text")).alias("revision"),
    )
    page.write.format("xml").option("rowTag", "page").option("rootTag", "mediawiki").save(path)
    return path


PAGE_TEXT_SQL = final_sql(markup_sql("concat(text, ' {{box}} ''''''end'''''' of [[Page|page]]')"))


@register("wiki_xml_scan", f"SELECT page_id, 0 AS namespace, title, md5(t) AS text_md5 FROM (SELECT doc_id AS page_id, concat('Page ', doc_id) AS title, {PAGE_TEXT_SQL} AS t FROM documents WHERE doc_id % 5 <> 4 AND doc_id % 7 <> 6) WHERE length(t) >= 50")
def wiki_xml_scan(spark, sf_dir):
    return wiki.read_wiki(spark, _xml(spark, sf_dir)).select("page_id", "namespace", "title", F.md5("text").alias("text_md5"))


STREAM_SQL = f"SELECT count(DISTINCT md5(lower(regexp_replace(regexp_replace(text, '^[{WS}]+', ''), '[{WS}]+$', '')))) AS n FROM documents"


@register("stream_exact_dedup", STREAM_SQL)
def stream_exact_dedup(spark, sf_dir):
    source = docs(spark, sf_dir)
    path = shared_dir(spark)
    folder, _ = _folder(spark, sf_dir, path)
    stream = spark.readStream.schema(source.schema).option("pathGlobFilter", "*.parquet").parquet(folder)
    q = streams.exact_stream(stream).writeStream.format("parquet").option("path", f"{path}/out").option("checkpointLocation", f"{path}/state").trigger(availableNow=True).start()
    q.awaitTermination()
    return spark.read.parquet(f"{path}/out").agg(F.count("*").alias("n"))


#: Bytes of documents in a file of a stream, about.
STREAM_FILE_BYTES = 8 << 20


def _files(df):
    """Four, or more of a bounded size."""
    return max(4, (plan_bytes(df) or 0) // STREAM_FILE_BYTES)


def _folder(spark, sf_dir, path):
    """The documents as a folder of files, which a file stream needs, and how many."""
    d = docs(spark, sf_dir)
    n = _files(d)
    d.repartitionByRange(n, "doc_id").write.parquet(f"{path}/source")
    return f"{path}/source", n


@register("stream_minhash_dedup", f"{LEADER_SQL} SELECT ord AS doc_id FROM judged WHERE original IS NULL")
def stream_minhash_dedup(spark, sf_dir):
    """Two micro batches, in the order of ids; the query is stopped between them and starts again from its state."""
    source = docs(spark, sf_dir)
    path = shared_dir(spark)
    n = max(4, _files(source) // 2)
    middle = source.agg(F.percentile_approx("doc_id", 0.5)).first()[0]
    sink = lambda df, epoch: df.write.mode("overwrite").parquet(f"{path}/out/epoch={epoch}")
    for half in (F.col("doc_id") <= middle, F.col("doc_id") > middle):
        source.where(half).repartition(n).write.mode("append").parquet(f"{path}/source")
        stream = spark.readStream.schema(source.schema).parquet(f"{path}/source")
        q = stream.writeStream.foreachBatch(streams.near_stream_batch(f"{path}/index", sink)).option("checkpointLocation", f"{path}/state").trigger(availableNow=True).start()
        q.awaitTermination()
    return spark.read.parquet(f"{path}/out").select("doc_id")


@register("stream_quality", f"WITH {DOC_MEASURES} SELECT doc_id, word_count, reason FROM judged")
def stream_quality(spark, sf_dir):
    """The stages without state on a stream: each document is judged as it comes."""
    path = shared_dir(spark)
    folder, n = _folder(spark, sf_dir, path)
    stream = spark.readStream.schema(docs(spark, sf_dir).schema).option("maxFilesPerTrigger", (n + 1) // 2).parquet(folder)  # two micro batches
    judged = quality.with_quality(stream).select("doc_id", F.col("quality.reason").alias("reason"), quality.measures(F.col("text"))["word_count"].alias("word_count"))
    q = judged.writeStream.format("parquet").option("path", f"{path}/out").option("checkpointLocation", f"{path}/state").trigger(availableNow=True).start()
    q.awaitTermination()
    return spark.read.parquet(f"{path}/out").select("doc_id", "word_count", "reason")


@register("pipeline_end_to_end")
def pipeline_end_to_end(spark, sf_dir):
    cfg = Config({"quality": {"language_chars": None, "language_filter": {"allowed_languages": ["en", "de"]}}, "tokenization": {"vocab_size": VOCAB_SIZE}})
    d = docs(spark, sf_dir).select(F.col("doc_id").alias("ord"), F.col("doc_id").cast("string").alias("id"), F.col("source").alias("title"), "text")
    return Pipeline(spark, cfg).run(d).select("id", "title", F.size("tokens").cast("long").alias("token_count"))


@register("demo_corpus")
def demo_corpus(spark, sf_dir):
    """The demonstration's settings on another corpus: the text of web pages, one article each."""
    small_splits(spark)
    d = spark.read.parquet(f"{sf_dir}/pages.parquet").select(F.col("page_id").alias("ord"), F.col("page_id").cast("string").alias("id"), F.col("url").alias("title"), markup.strip_tags(F.col("html")).alias("text"))
    cfg = Config({"tokenization": {"vocab_size": 1000}, "quality": {"language_filter": {"allowed_languages": ["en"]}}})
    return Pipeline(spark, cfg).run(d).select("id", "title", F.size("tokens").cast("long").alias("token_count"))
