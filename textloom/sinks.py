"""Outputs: Parquet, JSON lines, Arrow, token files, summaries."""

from __future__ import annotations

import json
import time
from collections.abc import Callable, Iterator
from contextlib import contextmanager

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from textloom import shards

FORMATS = shards.FORMATS


def write_processed(df: DataFrame, path: str, fmt: str = "parquet", compression: str = "snappy", max_mb: float | None = None) -> None:
    """(id, title, text, tokens) as Parquet with token counts, or as JSON lines or Arrow files with tokens.

    With ``max_mb``, and for Arrow always, in files of a bounded size (see ``shards``).
    """
    if fmt not in FORMATS:
        raise ValueError(f"format {fmt!r} is not one of {FORMATS}")
    last = F.size("tokens").cast("long").alias("token_count") if fmt == "parquet" else F.col("tokens")
    rows = df.select("id", "title", "text", last)
    if max_mb or fmt == "arrow":
        shards.write_shards(rows, path, fmt, max_mb or shards.MAX_MB, compression)
    elif fmt == "parquet":
        rows.write.mode("overwrite").option("compression", compression).parquet(path)
    else:
        rows.write.mode("overwrite").option("ignoreNullFields", "false").json(path)


def write_tokens(df: DataFrame, path: str, fmt: str = "jsonl", id_col: str | None = "id") -> None:
    """Tokens by document: JSON lines written by the executors, or one JSON file streamed through the driver."""
    if fmt == "jsonl":
        df.select(*([id_col] if id_col else []), "tokens").write.mode("overwrite").option("ignoreNullFields", "false").json(path)
    elif fmt == "json":
        with _writer(df.sparkSession, path) as write:
            write('{"documents": [')
            for i, row in enumerate(df.select("tokens").toLocalIterator()):
                write(", " * bool(i) + json.dumps({"tokens": list(row["tokens"])}))
            write("]}")
    else:
        raise ValueError(f"format {fmt!r} is neither jsonl nor json")


def summary(stats: dict) -> dict:
    return {"timestamp": time.strftime("%Y-%m-%dT%H:%M:%S"), **stats}


@contextmanager
def _writer(spark: SparkSession, path: str) -> Iterator[Callable[[str], None]]:
    """Text piece by piece into one file of any file system that Spark knows."""
    place = spark.sparkContext._jvm.org.apache.hadoop.fs.Path(path)
    out = place.getFileSystem(spark.sparkContext._jsc.hadoopConfiguration()).create(place, True)
    try:
        yield lambda text: out.write(bytearray(text.encode()))
    finally:
        out.close()
