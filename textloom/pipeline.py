"""The end-to-end run: articles -> clean -> deduplicate -> filter -> tokenize -> write.

Each stage's result is written once to the shared folder; its counts are added up while it
is written.  When the run ends, only the last stage's table is left.
"""

from __future__ import annotations

import json

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from textloom import sinks
from textloom.config import Config
from textloom.metrics import Run
from textloom.operators import clean, dedup, perplexity, quality, tokenizer
from textloom.operators.storage import shared_dir, spread, store, temporary, write_text
from textloom.sources import wiki


class Pipeline:
    """One run on articles (ord, id, title, text); nothing is kept between runs."""

    def __init__(self, spark: SparkSession, config: Config | None = None) -> None:
        self.spark, self.config = spark, config or Config()
        self.metrics = Run()

    def ingest(self, path: str, max_articles: int | None = None) -> DataFrame:
        articles = wiki.read_wiki(self.spark, path, max_articles, self.config.get("cleaning.remove_wiki_markup", True))
        return articles.select(F.col("page_id").alias("ord"), F.col("page_id").cast("string").alias("id"), "title", "text")

    def run(self, articles: DataFrame, output: str | None = None) -> DataFrame:
        """(ord, id, title, text, tokens) of what is left."""
        fmt = self.config.get("output.format")
        if fmt not in sinks.FORMATS:
            raise ValueError(f"output format {fmt!r} is not one of {sinks.FORMATS}")
        self.metrics = Run()
        result = shared_dir(self.spark)
        with temporary(self.spark, result):
            return self._run(articles, output, fmt, result)

    def _stored(self, df: DataFrame) -> DataFrame:
        return store(df, shared_dir(self.spark))

    def _run(self, articles: DataFrame, output: str | None, fmt: str, result: str) -> DataFrame:
        cfg, m = self.config, self.metrics
        every = F.count(F.lit(1))
        with m.stage("cleaning") as watch:
            cleaned = clean.with_cleaned(spread(articles.select("ord", "id", "title", "text")), cfg=cfg.cleaning())
            left = F.count_if(F.coalesce(F.col("cleaned"), F.lit("")) != "")
            cleaned = watch.observe(cleaned, rows_in=every, rows_out=left, bytes_in=F.sum(F.octet_length("text")), chars_removed=F.sum("stats.chars_removed"))
            docs = self._stored(clean.survivors(cleaned).select("ord", "id", "title", F.col("cleaned").alias("text")))
        if cfg.get("deduplication.enabled"):
            with m.stage("deduplication") as watch:
                watch.found["rows_in"] = m["cleaning"].rows_out
                docs = self._stored(watch.observe(self._deduplicated(docs), rows_out=every))
        if cfg.get("quality.enabled"):
            with m.stage("quality") as watch:
                judged = quality.with_quality(spread(docs), cfg=cfg.quality())
                counts = {reason: F.count_if(F.col("quality.reason") == reason) for reason in quality.REASONS}
                judged = watch.observe(judged, rows_in=every, **counts)
                docs = self._stored(judged.where("quality.passed").drop("quality"))
                found = watch.measured()
                m.reasons |= {k: n for k in quality.REASONS if (n := found.pop(k)) and k != "passed"}
                found["rows_out"] = found["rows_in"] - sum(m.reasons.values())
        if cfg.get("quality.enabled") and cfg.get("quality.perplexity_filter.enabled"):
            with m.stage("perplexity") as watch:
                # Without a model of its own the corpus is held against itself.
                path = cfg.get("quality.perplexity_filter.model_path")
                language_model = perplexity.load(self.spark, path) if path else perplexity.train(docs)
                judged = perplexity.with_perplexity(docs, language_model)
                fits = F.coalesce(F.col("perplexity") <= float(cfg.get("quality.perplexity_filter.max_perplexity")), F.lit(False))
                judged = watch.observe(judged, rows_in=every, rows_out=F.count_if(fits))
                docs = self._stored(judged.where(fits).drop("perplexity"))
        if not cfg.get("tokenization.enabled"):
            return store(docs, result)
        with m.stage("tokenization") as watch:
            t = cfg.section("tokenization")
            model = tokenizer.train(docs, t["algorithm"], t["vocab_size"], t["min_frequency"], t.get("special_tokens"))
            coded = store(tokenizer.encode(spread(docs), model), result)
            stats = tokenizer.token_stats(coded, model.vocab_size()).first().asDict()
            watch.found |= {"rows_in": stats["total_documents"], "rows_out": stats["total_documents"], **stats}
        if output:
            write_text(self.spark, f"{output}/tokenizer.json", model.to_json())
            sinks.write_processed(coded, f"{output}/processed_data.{fmt}", fmt, cfg.get("output.compression"), cfg.get("output.max_file_size_mb"))
            sinks.write_tokens(coded, f"{output}/tokenized_data.jsonl")
            report = sinks.summary({k: stats[k] for k in ("total_documents", "total_tokens", "vocab_size", "avg_tokens_per_doc", "compression_ratio")})
            write_text(self.spark, f"{output}/summary.json", json.dumps(report, indent=2))
            m.save(self.spark, f"{output}/pipeline_metrics.json")
        return coded

    def _deduplicated(self, docs: DataFrame) -> DataFrame:
        kind = self.config.get("deduplication.algorithm")
        if kind == "minhash_lsh":
            return dedup.deduplicate(docs, self.config.dedup(), "ord")
        if kind == "exact_hash":
            return dedup.exact_duplicates(docs, ord_col="ord").where("not is_duplicate").drop("first_id", "is_duplicate")
        if kind == "simhash":
            return dedup.simhash_deduplicate(docs, ord_col="ord")
        raise ValueError(f"unknown deduplication algorithm {kind!r}")
