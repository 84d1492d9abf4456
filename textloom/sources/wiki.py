"""MediaWiki dumps as a DataFrame: Spark's XML source, plain or compressed."""

from __future__ import annotations

import os
import shutil
import urllib.request

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from textloom.functions import text as T
from textloom.operators import wiki
from textloom.operators.storage import small_batches
from textloom.sources import dump

PAGE_SCHEMA = "title STRING, ns INT, id BIGINT, redirect STRUCT<_title: STRING>, revision ARRAY<STRUCT<text: STRING>>"
MIN_CHARS = 50
#: Where the named dumps are published.
DUMPS = {
    "simplewiki": "https://dumps.wikimedia.org/simplewiki/latest/simplewiki-latest-pages-articles.xml.bz2",
    "enwiki": "https://dumps.wikimedia.org/enwiki/latest/enwiki-latest-pages-articles.xml.bz2",
}


def resolve_source(source: str) -> str:
    """The address of a named dump, or the address itself."""
    if source in DUMPS:
        return DUMPS[source]
    if source.startswith("http"):
        return source
    raise ValueError(f"unknown source {source!r}")


def download(source: str, folder: str, chunk: int = 1 << 20) -> str:
    """Fetch a dump, under a temporary name until it is whole; an existing file is kept."""
    url = resolve_source(source)
    path = os.path.join(folder, url.rsplit("/", 1)[-1])
    if os.path.exists(path):
        return path
    os.makedirs(folder, exist_ok=True)
    with urllib.request.urlopen(url) as got, open(path + ".part", "wb") as out:
        shutil.copyfileobj(got, out, chunk)
    os.replace(path + ".part", path)
    return path


def decompress(path: str, output: str | None = None) -> str:
    """Unpack a ``.bz2`` file; Spark reads it packed, so this is for other tools only."""
    import bz2

    output = output or path.replace(".bz2", "")
    if not os.path.exists(output):
        with bz2.open(path) as got, open(output + ".part", "wb") as out:
            shutil.copyfileobj(got, out, 1 << 16)
        os.replace(output + ".part", output)
    return output


def read_pages(spark: SparkSession, path: str) -> DataFrame:
    """Every page: (title, page_id, namespace, redirect, raw)."""
    got = spark.read.format("xml").option("rowTag", "page").option("ignoreSurroundingSpaces", "false").schema(PAGE_SCHEMA).load(path)
    return got.select(
        "title",
        F.coalesce("id", F.lit(0)).cast("long").alias("page_id"),
        F.coalesce("ns", F.lit(0)).cast("int").alias("namespace"),
        F.col("redirect._title").alias("redirect"),
        F.try_element_at("revision", F.lit(1))["text"].alias("raw"),
    )


def read_wiki(spark: SparkSession, path: str, max_articles: int | None = None, markup_removed: bool = True, namespaces: tuple[int, ...] = (0,)) -> DataFrame:
    """Articles: (page_id, namespace, title, redirect, text).

    Pages outside the namespaces, redirects with a target, pages without text and
    those with fewer than MIN_CHARS characters left are dropped.  ``max_articles``
    takes the first ones in the order of the file, after these filters; the file is then read
    by the source that knows this order (see ``dump``).
    """
    small_batches(spark)
    every = dump.read_dump(spark, path) if max_articles else read_pages(spark, path)
    kept = every.where(F.col("namespace").isin(*namespaces) & F.col("redirect").isNull() & (F.coalesce(F.length("raw"), F.lit(0)) > 0))
    text = wiki.remove_markup(F.col("raw")) if markup_removed else F.col("raw")
    out = kept.withColumn("text", text).where(F.length(T.strip(F.col("text"))) >= MIN_CHARS)
    if max_articles:
        out = out.orderBy("file", "stream", "seq").limit(max_articles)
    return out.select("page_id", "namespace", "title", "redirect", "text")


def with_counts(articles: DataFrame) -> DataFrame:
    return articles.select("*", F.col("redirect").isNotNull().alias("is_redirect"), T.word_count(F.col("text")).alias("word_count"), F.length("text").alias("char_count"))
