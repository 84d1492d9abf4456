"""One stage on a few rows of a table: ``python -m textloom.showcase cleaning --input docs.parquet``.

Without an input the sample corpus is taken.  The input is Parquet, JSON lines or text, with
the texts in the column ``text``, or for ``ingestion`` a dump.
"""

from __future__ import annotations

import argparse

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from textloom.operators import clean, dedup, quality, tokenizer
from textloom.operators.storage import release
from textloom.sources import basic, wiki


def cleaning(df: DataFrame) -> DataFrame:
    return clean.with_cleaned(df, cfg=clean.CleanConfig(min_length_chars=1)).select("text", "cleaned", "stats.*")


def deduplication(df: DataFrame) -> DataFrame:
    """Which row each one repeats, exactly and nearly."""
    exact = dedup.exact_duplicates(df, ord_col="row")
    near = dedup.near_duplicates(df, ord_col="row").withColumnRenamed("ord", "row").withColumnRenamed("original", "near_original")
    return exact.join(near, "row").orderBy("row").select("row", "is_duplicate", "first_id", "near_original", "text")


def filtering(df: DataFrame) -> DataFrame:
    return quality.with_quality(df).select("quality.passed", "quality.reason", "quality.scores", "text")


def tokenization(df: DataFrame) -> DataFrame:
    model = tokenizer.train(df, "bpe", 500)
    coded = tokenizer.encode(df, model)
    return coded.select("text", "tokens", F.size("tokens").alias("n_tokens"), tokenizer.decode_text(F.col("tokens"), model).alias("decoded"))


STAGES = {"cleaning": cleaning, "deduplication": deduplication, "quality": filtering, "tokenization": tokenization}


def read(spark: SparkSession, path: str | None) -> DataFrame:
    if not path:
        df = basic.sample_corpus(spark)
    elif path.endswith((".jsonl", ".json")):
        df = spark.read.json(path)
    elif path.endswith(".txt"):
        df = spark.read.text(path).withColumnRenamed("value", "text")
    else:
        df = spark.read.parquet(path)
    return df.select(F.monotonically_increasing_id().alias("row"), "text")


def show(spark: SparkSession, stage: str, path: str | None, rows: int, width: int = 60) -> DataFrame:
    """Print a stage's rows and give them back."""
    if stage == "ingestion":
        made = wiki.with_counts(wiki.read_wiki(spark, path, rows))
    else:
        made = STAGES[stage](read(spark, path).limit(rows))
    made.show(rows, truncate=width)
    return made


def main(argv: list[str] | None = None) -> int:
    p = argparse.ArgumentParser(description="Show what one stage does.")
    p.add_argument("stage", choices=["ingestion", *STAGES])
    p.add_argument("--input")
    p.add_argument("--rows", type=int, default=20)
    a = p.parse_args(argv)
    if a.stage == "ingestion" and not a.input:
        p.error("ingestion needs a dump")
    spark = SparkSession.builder.appName("textloom showcase").getOrCreate()
    show(spark, a.stage, a.input, a.rows)
    release(spark)
    return 0


if __name__ == "__main__":
    raise SystemExit(main())
