"""Parquet, JSON lines and text sources, and a small built-in corpus."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession


def read_parquet(spark: SparkSession, path: str) -> DataFrame:
    return spark.read.parquet(path)


def read_jsonl(spark: SparkSession, path: str, schema: str | None = None) -> DataFrame:
    return (spark.read.schema(schema) if schema else spark.read).json(path)


def read_text_files(spark: SparkSession, *paths: str) -> DataFrame:
    """(text): one row per line, as tokenizer training takes them."""
    return spark.read.text(list(paths)).withColumnRenamed("value", "text")


def sample_corpus(spark: SparkSession) -> DataFrame:
    """Five short articles (id, title, text) for demonstrations."""
    topics = {
        "Rivers": "A river carries water from high ground to the sea, and with it sand, leaves and small stones.",
        "Bridges": "A bridge is a structure that carries a road or a path over a river, a valley or another road.",
        "Bread": "Bread is made of flour, water and salt, and most kinds are raised with yeast before they are baked.",
        "Maps": "A map is a drawing of a place, made to scale, on which signs stand for roads, hills and houses.",
        "Clocks": "A clock shows the time of day, by hands that turn on a dial or by figures that change each minute.",
    }
    more = " People have known it for a very long time, and there are many forms of it in all parts of the world. What it looks like depends on where it is, what it is made of, and what it is used for. Some are small and plain, and others are large and famous, so that visitors travel far to see them."
    return spark.createDataFrame([(str(i), t, x + more) for i, (t, x) in enumerate(topics.items(), 1)], "id string, title string, text string")
