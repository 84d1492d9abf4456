"""Times the headline queries at $BENCH_SF_DIR on local[$BENCH_CPUS]; prints one JSON line."""

import json
import os
import time

from pyspark.sql import SparkSession

from textloom.plans import catalogue

HEADLINE = ["quality_reasons", "quality_scores", "lang_detect", "clean_full_stats", "clean_nfkc", "exact_dedup_stats", "minhash_signatures", "dedup_result", "wiki_final_clean", "pretoken_freq", "bpe_encode", "describe_lengths", "pipeline_end_to_end"]


def main() -> None:
    sf_dir, cpus = os.environ.get("BENCH_SF_DIR", "/root/testdata/sf0.1"), os.environ.get("BENCH_CPUS", "8")
    builder = SparkSession.builder.master(f"local[{cpus}]").appName("bench")
    for k, v in {"spark.driver.memory": "12g", "spark.sql.shuffle.partitions": cpus, "spark.ui.enabled": "false", "spark.ui.showConsoleProgress": "false", "spark.sql.session.timeZone": "UTC", "spark.sql.files.maxPartitionBytes": "4m", "spark.log.level": "ERROR"}.items():
        builder = builder.config(k, v)
    spark = builder.getOrCreate()
    queries, took = catalogue.queries(), {}
    queries["doc_lengths"](spark, sf_dir).write.format("noop").mode("overwrite").save()  # the session's own start
    for name in HEADLINE:
        began = time.time()
        queries[name](spark, sf_dir).write.format("noop").mode("overwrite").save()
        took[name] = round(time.time() - began, 3)
    docs = spark.read.parquet(f"{sf_dir}/documents.parquet").count()
    print(json.dumps({"metric": "total_seconds", "value": round(sum(took.values()), 3), "unit": "sec", "queries": took, "sf": os.path.basename(sf_dir.rstrip("/")), "docs": docs, "pipeline_docs_per_s": round(docs / took["pipeline_end_to_end"], 1)}))


if __name__ == "__main__":
    main()
