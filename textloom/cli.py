"""Command line: ``python -m textloom.cli --wiki-dump dump.xml.bz2 --output-dir out``."""

from __future__ import annotations

import argparse

from pyspark.sql import SparkSession

from textloom.config import Config
from textloom.pipeline import Pipeline
from textloom.sources import wiki


def main(argv: list[str] | None = None) -> int:
    p = argparse.ArgumentParser(description="Prepare a wiki dump for language-model training.")
    p.add_argument("--source", help="simplewiki, enwiki or an address to download")
    p.add_argument("--wiki-dump", help="a dump that is already there (.xml or .xml.bz2)")
    p.add_argument("--max-articles", type=int)
    p.add_argument("--output-dir", default="data/output")
    p.add_argument("--config")
    a = p.parse_args(argv)
    config = Config.load(a.config) if a.config else Config()
    dump = a.wiki_dump or wiki.download(a.source or config.get("ingestion.source"), config.path("raw_data"))
    spark = SparkSession.builder.appName("textloom").getOrCreate()
    run = Pipeline(spark, config)
    run.run(run.ingest(dump, a.max_articles or config.get("ingestion.max_articles")), a.output_dir)
    print(run.metrics.report())
    return 0


if __name__ == "__main__":
    raise SystemExit(main())
