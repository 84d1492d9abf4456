"""Exploration: lengths, histograms, summaries, samples.

Null texts have null lengths and are in no bin; an empty table gives empty bins and counts of
0; repeated rows count again; columns beyond those named are carried along.
"""

from __future__ import annotations

import math

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from textloom.functions import text as T
from textloom.operators.storage import remove, shared_dir, store


def with_lengths(df: DataFrame, text_col: str = "text") -> DataFrame:
    return df.withColumn("text_length", F.length(text_col).cast("long")).withColumn("word_count", T.word_count(F.col(text_col)))


def histogram(df: DataFrame, col: str, bins: int = 50) -> DataFrame:
    """(bin, low, high, n) of equal-width bins, the last one closed; empty bins have n = 0."""
    spark = df.sparkSession
    edges = df.agg(F.min(col).cast("double").alias("lo"), F.max(col).cast("double").alias("hi"))
    width = (F.col("hi") - F.col("lo")) / bins
    at = F.when(F.col("hi") == F.col("lo"), F.lit(0)).otherwise(F.least(F.floor((F.col(col) - F.col("lo")) / width), F.lit(bins - 1)))
    counts = df.where(F.col(col).isNotNull()).crossJoin(F.broadcast(edges)).groupBy(at.cast("long").alias("bin")).agg(F.count("*").alias("n"))
    every = spark.range(bins).withColumnRenamed("id", "bin").crossJoin(F.broadcast(edges))
    return every.join(counts, "bin", "left").select("bin", (F.col("lo") + F.col("bin") * width).alias("low"), (F.col("lo") + (F.col("bin") + 1) * width).alias("high"), F.coalesce("n", F.lit(0)).cast("long").alias("n"))


#: Bins of a round of ``quantiles``, for each interval that is still open.
BINS = 1024


def quantiles(df: DataFrame, wanted: dict[str, list[float]]) -> dict[str, list[float | None]]:
    """Exact interpolated quantiles of columns, as ``percentile`` gives them, without gathering their values.

    The ranks that are asked for stand in intervals of values.  A round counts the values of
    every open interval in BINS bins, with the least and greatest in each, and goes on with
    the bins that hold the ranks, until each holds one value only.  So no task sees more than
    counts of bins, and the driver BINS rows for each interval.
    """
    spark = df.sparkSession
    path = shared_dir(spark)
    values = store(df.select(*(F.col(c).cast("double").alias(c) for c in wanted)), path)
    ends = values.agg(*(f(c).alias(f"{name}_{c}") for c in wanted for name, f in (("n", F.count), ("lo", F.min), ("hi", F.max)))).first()
    found: dict[tuple[str, int], float] = {}
    open_ = []  # (column, low, high, values below, ranks)
    for c, ps in wanted.items():
        ranks = sorted({r for p in ps for r in (math.floor(p * (ends[f"n_{c}"] - 1)), math.ceil(p * (ends[f"n_{c}"] - 1)))}) if ends[f"n_{c}"] else []
        if ranks:
            open_.append((c, ends[f"lo_{c}"], ends[f"hi_{c}"], 0, ranks))
    while open_:
        closed = [x for x in open_ if x[1] == x[2]]
        found |= {(c, r): low for c, low, _, _, ranks in closed for r in ranks}
        open_ = [x for x in open_ if x[1] != x[2]]
        if not open_:
            break
        place = lambda k, c, low, high: F.when(F.col(c).between(low, high), F.struct(F.lit(k).alias("k"), F.least(F.floor((F.col(c) / 2 - low / 2) / (high / 2 - low / 2) * BINS), F.lit(BINS - 1)).cast("int").alias("bin"), F.col(c).alias("x")))
        each = values.select(F.explode(F.filter(F.array(*(place(k, *x[:3]) for k, x in enumerate(open_))), lambda s: s.isNotNull())).alias("at")).select("at.*")
        bins = each.groupBy("k", "bin").agg(F.count("*").alias("n"), F.min("x").alias("low"), F.max("x").alias("high")).orderBy("k", "bin").collect()
        narrower = []
        for k, (c, _, _, below, ranks) in enumerate(open_):
            for b in (b for b in bins if b["k"] == k):
                inside = [r for r in ranks if below <= r < below + b["n"]]
                if inside:
                    narrower.append((c, b["low"], b["high"], below, inside))
                below += b["n"]
        open_ = narrower
    remove(spark, path)

    def at(c: str, p: float) -> float | None:
        if not ends[f"n_{c}"]:
            return None
        where = p * (ends[f"n_{c}"] - 1)
        low, high = math.floor(where), math.ceil(where)
        return found[c, low] if found[c, low] == found[c, high] else (high - where) * found[c, low] + (where - low) * found[c, high]

    return {c: [at(c, p) for p in ps] for c, ps in wanted.items()}


def describe(df: DataFrame, cols: list[str], accuracy: int | None = None) -> DataFrame:
    """(metric, count, mean, std, min, p25, p50, p75, max), one row per column.

    Quartiles are exact and interpolated (see ``quantiles``); with ``accuracy`` they are
    approximate, from sketches of a bounded size.  Nulls don't count; without rows the count
    is 0 and the rest null.
    """
    exact = quantiles(df, {c: [0.25, 0.5, 0.75] for c in cols}) if accuracy is None else {}

    def of(c: str):
        x = F.col(c).cast("double")
        quartiles = [F.lit(q).cast("double") for q in exact[c]] if exact else [F.percentile_approx(x, p, accuracy) for p in (0.25, 0.5, 0.75)]
        return F.struct(
            F.lit(c).alias("metric"), F.count(x).alias("count"), F.avg(x).alias("mean"), F.stddev_samp(x).alias("std"), F.min(x).alias("min"),
            *(q.alias(name) for q, name in zip(quartiles, ("p25", "p50", "p75"), strict=True)), F.max(x).alias("max"),
        )

    return df.agg(F.array(*map(of, cols)).alias("them")).select(F.inline("them"))


def sample(df: DataFrame, n: int = 3, seed: int = 42, id_col: str = "doc_id") -> DataFrame:
    """The n rows whose ids have the smallest hash with the seed: the same on every machine and layout."""
    return df.orderBy(F.md5(F.concat_ws("-", F.lit(str(seed)), F.col(id_col).cast("string"))), id_col).limit(n)


def compression(df: DataFrame, length_col: str = "text_length", tokens_col: str = "token_count") -> DataFrame:
    return df.withColumn("compression_ratio", F.try_divide(F.col(length_col).cast("double"), F.col(tokens_col).cast("double")))
