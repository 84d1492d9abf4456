"""Target-distribution importance resampling, in native Spark SQL.

Features are all runs of 1 to ``runs`` consecutive words.  They are exploded and counted
by the crc32 of their bytes modulo ``buckets``, once over all texts and once over all
texts of the target.  A bucket's gain is the rounded-down log ratio of its smoothed
shares; the gains are ``buckets`` rows at most, and so are broadcast to the exploded
features of all texts, whose mean by text is its weight.

Drawing without replacement by Gumbel keys: a hash of the id gives each text its noise,
weight plus noise is the score, and the highest scores are drawn.  Ranks come from a
distributed sort: places inside a partition, plus the sizes of the partitions before.

A text's row stays one row throughout, so repeated rows and rows that share an id are
weighed and drawn each for itself; ties go to the smaller id, a null id (hashed as an
empty string) after all others.  Null and empty texts have no features and weight 0;
whole texts are read; an empty target leaves gains from smoothing alone; an empty
table gives an empty result; further columns are ignored.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from textloom.llm import common

#: Words of the lower-cased text: digits, letters and everything beyond ASCII.
WORD = r"[^\x00-\x2F\x3A-\x60\x7B-\x7F]+"
UPPER, LOWER = "ABCDEFGHIJKLMNOPQRSTUVWXYZ", "abcdefghijklmnopqrstuvwxyz"
RUNS, BUCKETS, LEAST_WORDS, PERCENT, SEED = 2, 10_000, 20, 25, 7
#: Bits of ``monotonically_increasing_id`` that number the rows of a partition.
PLACE_BITS = 33


def features(words: Column, runs: int = RUNS) -> Column:
    """All runs of 1 to ``runs`` words; nulls stand where a run would go beyond the end."""
    whole = every = words
    for k in range(1, runs):
        whole = F.zip_with(whole, F.slice(words, k + 1, F.greatest(F.size(words), F.lit(1))), lambda a, b: F.concat(a, F.lit(" "), b))
        every = F.concat(every, whole)
    return every


def bucketed(texts: DataFrame, runs: int = RUNS, buckets: int = BUCKETS) -> DataFrame:
    """All columns but ``text``, and ``bucket``: a row for each feature, and some with a null bucket."""
    words = texts.withColumn("words", F.regexp_extract_all(F.translate(F.coalesce("text", F.lit("")), UPPER, LOWER), F.lit(WORD), 0))
    rest = [c for c in texts.columns if c != "text"]
    each = words.select(*rest, F.explode_outer(features(F.col("words"), runs)).alias("feature"))
    return each.select(*rest, (F.crc32("feature") % buckets).alias("bucket"))


def gain_table(texts: DataFrame, target: DataFrame, runs: int = RUNS, buckets: int = BUCKETS) -> DataFrame:
    """(bucket, gain) of every bucket.  Runs one job, which counts the features of both sides; the counts are stored."""
    spark = texts.sparkSession
    both = texts.select("text", F.lit(0).alias("side")).union(target.select("text", F.lit(1).alias("side")))
    side = lambda k: F.count_if(F.col("side") == k)
    counted = bucketed(both, runs, buckets).where("bucket is not null").groupBy("bucket").agg(side(0).alias("s"), side(1).alias("t"))
    counts = common.store(counted, common.shared_dir(spark))
    total = counts.agg(*(F.coalesce(F.sum(c), F.lit(0)).alias(c) for c in "st")).first()
    every = spark.range(buckets).withColumnRenamed("id", "bucket").join(F.broadcast(counts), "bucket", "left")
    s, t = (F.coalesce(F.col(c), F.lit(0)).cast("double") for c in "st")
    gain = F.floor(1000 * F.ln((t + 1) * F.lit(float(total["s"] + buckets)) / ((s + 1) * F.lit(float(total["t"] + buckets)))))
    return every.select("bucket", gain.alias("gain"))


def weigh(texts: DataFrame, gains: DataFrame, runs: int = RUNS, buckets: int = BUCKETS) -> DataFrame:
    """(id, n_features, weight) of each row of (id, text)."""
    rows = bucketed(texts.withColumn("row", F.monotonically_increasing_id()), runs, buckets)
    met = rows.join(F.broadcast(gains), "bucket", "left")
    sums = met.groupBy("row", "id").agg(F.count("bucket").alias("n_features"), F.coalesce(F.sum("gain"), F.lit(0)).alias("gain"))
    mean = F.when(F.col("n_features") > 0, F.floor(F.col("gain") / F.col("n_features"))).otherwise(F.lit(0))
    return sums.select("row", "id", "n_features", mean.cast("long").alias("weight"))


def noise(id_text: Column, seed: int = SEED) -> Column:
    """Gumbel noise in thousandths, from the first 32 bits of a hash of seed and id."""
    h = F.conv(F.substring(F.sha2(F.concat(F.lit(f"{seed}:"), F.coalesce(id_text, F.lit(""))), 256), 1, 8), 16, 10).cast("double")
    return F.floor(-1000 * F.ln(-F.ln((h + 0.5) / 4294967296.0)))


def ranked(rows: DataFrame, *order: Column) -> DataFrame:
    """All columns and ``rank`` (1, 2, 3, ... in the order given), without bringing the rows together.

    Rows are sorted by ranges and stored with their place in their partition; a table of
    one row for each partition says how many rows come before it.
    """
    spark = rows.sparkSession
    placed = common.store(rows.orderBy(*order).withColumn("place", F.monotonically_increasing_id()), common.shared_dir(spark))
    part = F.shiftright("place", PLACE_BITS)
    sizes = placed.groupBy(part.alias("part")).count()
    before = sizes.select("part", (F.sum("count").over(Window.orderBy("part")) - F.col("count")).alias("before"))
    within = F.col("place").bitwiseAND(F.lit((1 << PLACE_BITS) - 1))
    return placed.withColumn("part", part).join(F.broadcast(before), "part").withColumn("rank", F.col("before") + within + 1).drop("part", "before", "place")


def resample(docs: DataFrame, target: DataFrame, percent: int = PERCENT, seed: int = SEED, runs: int = RUNS, buckets: int = BUCKETS, least_words: int = LEAST_WORDS, id_col: str = "doc_id", text_col: str = "text", target_col: str = "text") -> DataFrame:
    """(id, n_features, weight, score, rank) of every row; rank is null for rows that are not drawn.

    Of the rows with ``least_words`` words or more, ``percent`` of a hundred (rounded down) are drawn.
    Its stored tables (counts, weights, sorted scores) stay until ``release``.
    """
    spark = docs.sparkSession
    common.tune(spark)
    texts = common.id_text(docs, id_col, text_col)
    gains = gain_table(texts, target.select(F.col(target_col).cast("string").alias("text")), runs, buckets)
    scored = weigh(texts, gains, runs, buckets).withColumn("score", F.col("weight") + noise(F.col("id").cast("string"), seed))
    scored = common.store(scored, common.shared_dir(spark))
    # A text of n words has n + (n - 1) + ... features, as many terms as its longest run allows.
    least = sum(max(0, least_words - k) for k in range(runs))
    able = F.col("n_features") >= least
    drawn = scored.where(able).count() * percent // 100
    sorted_rows = ranked(scored.where(able), F.desc("score"), F.asc_nulls_last("id"), F.asc("row"))
    rank = F.when(F.col("rank") <= drawn, F.col("rank"))
    names = ["id", "n_features", "weight", "score"]
    rest = scored.where(~able).select(*names, F.lit(None).cast("long").alias("rank"))
    return sorted_rows.select(*names, rank.cast("long").alias("rank")).union(rest).withColumnRenamed("id", id_col)


def op11_importance_resample(spark: SparkSession, sf_dir: str) -> DataFrame:
    return resample(common.table(spark, sf_dir, "documents"), common.table(spark, sf_dir, "benchmark"))
