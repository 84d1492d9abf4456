"""The training-data pipeline: five stages over ``documents``.

Each stage is ``function(spark, docs, sf_dir) -> DataFrame``; its result is written as
Parquet and read again as the next one's ``docs``.  All but the last return the columns
of ``documents``.

Common to all stages: columns beyond those of ``documents`` are left out, whatever their
names; an empty table gives an empty one; whole texts are read, however long; rows with a
null ``doc_id`` are documents like others.
"""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from textloom.llm import byte_bpe, common, decontaminate, jaccard_join, quality_rules, secrets

COLUMNS = ["doc_id", "text", "lang", "source", "n_chars"]


def quality(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Documents that the base rules or the trained model reject go.

    The model learns from the documents this stage is given.  Null, empty and blank texts
    have no words and go; repeated rows are judged alike, and what is exactly at a limit
    passes.
    """
    model = quality_rules.train(docs, common.table(spark, sf_dir, "labels"))
    return quality_rules.keep_good(docs, model).select(COLUMNS)


def near_duplicates(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Of each group of near copies (five-word shingles, Jaccard similarity 0.8), the document with the smallest id stays.

    Null, empty and blank texts are near nothing and stay, as do rows without an id.  Of
    repeated rows one stays; rows of one id with different texts stand or fall together.
    """
    return jaccard_join.one_of_each(docs, k=5, percent=80).select(COLUMNS)


def decontaminated(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Documents that hold a benchmark item go.

    Null and empty texts hold none and stay; repeated rows go or stay together; null and
    empty items are in no document.
    """
    return decontaminate.drop_contaminated(docs, common.table(spark, sf_dir, "benchmark")).select(COLUMNS)


def masked_secrets(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Secrets are masked in place; every document stays, and its length follows its text.

    A null text stays null with its length; repeated rows are masked alike.
    """
    masked = secrets.mask_secrets(docs)
    changed = F.length("text").cast("long")
    return masked.withColumn("n_chars", F.when(F.col("text").isNull(), F.col("n_chars")).otherwise(changed)).select(COLUMNS)


def encoded(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Token ids of every text that is left, and whether they decode to exactly its bytes.

    Null and empty texts have no ids; repeated rows give repeated results.
    """
    return byte_bpe.encode_checked(docs)


STAGES = [
    ("quality_rules", quality),
    ("jaccard_join", near_duplicates),
    ("decontaminate", decontaminated),
    ("secrets", masked_secrets),
    ("byte_bpe", encoded),
]

#: Not expressible in SQL: the model, the verification and the tokenizer are code.
ORACLE_SQL = None


def run(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The last stage's rows; what the stages and the steps between them have stored is removed."""
    docs, before = common.table(spark, sf_dir, "documents"), None
    for _, stage in STAGES:
        path = common.shared_dir(spark)
        with common.temporary(spark):
            docs = common.store(stage(spark, docs, sf_dir), path)
        if before:
            common.remove(spark, before)
        before = path
    return docs
