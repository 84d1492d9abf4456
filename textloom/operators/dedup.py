"""Duplicates: exact by hash, near by MinHash bands, first seen stays.

Keeping the first seen document of a candidate graph is its lexicographically first
maximal independent set.  Texts that normalise to the same string act as one node.

Near duplicates.  For a few rounds, whoever is first in all its band buckets stays, and
only the pairs of those with the others in their buckets are compared: a group of m near
copies costs m pairs, not m squared.  Pairs are listed only among what is then undecided.

Leaders of a list of pairs.  Connected components are found by minimum labels that jump;
each component streams through one task in order, and only components of more than
COMPONENT_EDGES pairs are solved in rounds over all tasks.

Null and empty texts normalise to an empty string and are copies of one another; texts too
short for a shingle count as empty; rows of one id should be one row; an empty table gives
an empty result; further columns are carried along.

The portable hash is arithmetic on code points, so that SQL engines can compute the
same signatures: a shingle is a base-R number modulo a Mersenne prime, and
permutation i maps h to (a_i h + b_i) mod P.
"""

from __future__ import annotations

import hashlib
from collections import Counter
from collections.abc import Iterator
from dataclasses import dataclass
from functools import lru_cache, reduce
from itertools import combinations

import numpy as np
import pandas as pd
import pyarrow as pa
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from textloom.functions import text as T
from textloom.operators.storage import shared_dir, spread, store, temporary

P = (1 << 31) - 1
RADIX = 1_000_003
EMPTY = P  # of every permutation, for texts without a shingle
#: Rounds in which the first of a bucket is compared with the others before pairs are listed.
BUCKET_ROUNDS = 3
#: Texts of a group that are compared with as many others in one task, and rows of a text that are paired with as many.
TILE, BLOCK = 64, 1024
#: Pairs of a component that one task takes in order; larger ones are solved in rounds.
COMPONENT_EDGES = 1_000_000
#: SimHash: bits, blocks, and the greatest distance of near texts; blocks - distance blocks agree.
SIM_BITS, SIM_BLOCKS, SIM_DISTANCE = 60, 6, 3
EXACT_ALGORITHMS = ("md5", "sha1", "sha224", "sha256", "sha384", "sha512")


@dataclass(frozen=True)
class DedupConfig:
    threshold: float = 0.8
    num_perm: int = 128
    shingle_size: int = 5
    #: Check candidates by exact Jaccard similarity (False: a shared band is enough).
    verify: bool = True


def coefficients(num_perm: int) -> list[tuple[int, int]]:
    """Multipliers and offsets, from a linear congruential rule both engines can state."""
    out, x = [], 12345
    for _ in range(num_perm):
        x = (x * 1103515245 + 12345) % P
        a = x % (P - 1) + 1
        x = (x * 1103515245 + 12345) % P
        out.append((a, x))
    return out


@lru_cache(maxsize=8)
def band_shape(threshold: float, num_perm: int) -> tuple[int, int]:
    """(bands, rows) with the least sum of false positive and false negative probability."""
    x = (np.arange(1000) + 0.5) / 1000
    best = (float("inf"), 1, 1)
    for b in range(1, num_perm + 1):
        for r in range(1, num_perm // b + 1):
            p = 1 - (1 - x**r) ** b
            error = p[x < threshold].sum() + (1 - p[x >= threshold]).sum()
            best = min(best, (error, b, r))
    return best[1], best[2]


def normalised(c: Column) -> Column:
    return F.regexp_replace(F.lower(c), f"(?U)[{T.JAVA_WS}]+", " ")


def shingle_hashes(text: str, k: int) -> np.ndarray:
    """Distinct hashes of a normalised text's k-character windows."""
    codes = np.frombuffer(text.encode("utf-32-le", "surrogatepass"), "<u4").astype(np.int64)
    n = len(codes) - k + 1
    if n < 1:
        return np.empty(0, np.int64)
    h = np.zeros(n, np.int64)
    for i in range(k):
        h = (h * RADIX + codes[i : i + n]) % P
    return np.unique(h)


def shingle_count(c: Column, k: int = 5) -> Column:
    """Different k-character windows of a normalised text, exactly: windows are numbers, renumbered before they overflow."""

    @F.pandas_udf("long")
    def run(s: pd.Series) -> pd.Series:
        def one(t: str | None) -> int:
            codes = np.frombuffer((t or "").encode("utf-32-le", "surrogatepass"), "<u4")
            n = len(codes) - k + 1
            if n < 1:
                return 0
            found, code = np.unique(codes, return_inverse=True)
            window, kinds = code[:n].astype(np.int64), len(found)
            for i in range(1, k):
                if kinds * len(found) >= 1 << 62:
                    window = np.unique(window, return_inverse=True)[1]
                    kinds = int(window.max()) + 1
                window = window * len(found) + code[i : i + n]
                kinds *= len(found)
            return len(np.unique(window))

        return s.map(one)

    return run(c)


def signature(c: Column, cfg: DedupConfig = DedupConfig()) -> Column:
    """MinHash of a normalised text, as array<long>; blocks of shingles bound the memory."""
    a, b = np.array(coefficients(cfg.num_perm), np.uint64).T[:, :, None].copy()
    k, low, high = cfg.shingle_size, np.uint64(P), np.uint64(31)

    @F.pandas_udf("array<long>")
    def run(s: pd.Series) -> pd.Series:
        spaces = np.empty((2, len(a) * 1024), np.uint64)

        def one(t: str | None) -> np.ndarray:
            h, out = shingle_hashes(t or "", k).astype(np.uint64), np.full(len(a), EMPTY, np.uint64)
            for i in range(0, len(h), 1024):
                part = h[i : i + 1024]
                x, y = (space[: len(a) * len(part)].reshape(len(a), -1) for space in spaces)
                np.multiply(a, part, out=x)
                np.add(x, b, out=x)
                # The remainder by P, one less than a power of two: the low bits and the high ones, less P where that is not below 0.
                np.right_shift(x, high, out=y)
                np.bitwise_and(x, low, out=x)
                np.add(x, y, out=x)
                np.subtract(x, low, out=y)
                out = np.minimum(out, np.minimum(x, y, out=x).min(axis=1))
            return out.astype(np.int64)

        return s.map(one)

    return run(c)


def signatures(df: DataFrame, cfg: DedupConfig = DedupConfig(), ord_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    return df.select(F.col(ord_col).alias("ord"), signature(normalised(F.coalesce(F.col(text_col), F.lit(""))), cfg).alias("sig"))


def bands(signed: DataFrame, cfg: DedupConfig = DedupConfig()) -> DataFrame:
    """(ord, band, key): the key is the band's rows, joined by commas and hashed."""
    b, r = band_shape(cfg.threshold, cfg.num_perm)
    keys = F.array(*(F.md5(F.array_join(F.slice("sig", i * r + 1, r), ",")) for i in range(b)))
    return signed.select("ord", F.posexplode(keys).alias("band", "key"))


def candidate_pairs(banded: DataFrame) -> DataFrame:
    """Distinct (a, b), a < b, that share a band."""
    x = banded.select(F.col("ord").alias("a"), "band", "key")
    y = banded.select(F.col("ord").alias("b"), "band", "key")
    return x.join(y, ["band", "key"]).where("a < b").select("a", "b").distinct()


def shingle_set(text: str, k: int) -> np.ndarray:
    """Sorted distinct 64-bit hashes of a normalised text's k-character windows."""
    codes = np.frombuffer(text.encode("utf-32-le", "surrogatepass"), "<u4").astype(np.uint64)
    n = len(codes) - k + 1
    if n < 1:
        return np.empty(0, np.uint64)
    h = np.full(n, 0x243F6A8885A308D3, np.uint64)
    for i in range(k):
        h = (h ^ codes[i : i + n]) * np.uint64(0x9E3779B97F4A7C15)
        h ^= h >> np.uint64(29)
    return np.unique(h)


def jaccard(pairs: DataFrame, docs: DataFrame, k: int = 5) -> DataFrame:
    """(a, b, jaccard) by the sets of 64-bit hashes of all shingles; docs: (ord, text), texts normalised.

    What has the same least neighbour is dealt into tiles of some TILE texts, and the pairs of
    two tiles meet in one task: a text travels once for each pair of tiles it has pairs in, not
    for each pair, and as a text, which is an eighth of its set.
    """
    path = shared_dir(docs.sparkSession)
    kind = pairs.schema["a"].dataType.simpleString()
    pairs = store(pairs.select("a", "b"), f"{path}/pairs")
    least = F.least("a", "b").alias("label")
    labels = pairs.select(F.col("a").alias("ord"), least).union(pairs.select("b", least)).groupBy("ord").agg(F.min("label").alias("label"))
    labels = store(labels, f"{path}/labels")
    large = store(labels.groupBy("label").agg(F.ceil(F.count("*") / TILE).alias("tiles")).where("tiles > 1"), f"{path}/large")
    tile = F.xxhash64("label", F.pmod(F.xxhash64("ord"), F.coalesce("tiles", F.lit(1))))
    placed = store(labels.join(large, "label", "left").select("ord", tile.alias("tile")), f"{path}/placed")
    x, y = (placed.select(F.col("ord").alias(o), F.col("tile").alias(f"tile{o}")) for o in "ab")
    met = store(pairs.join(x, "a").join(y, "b").select(F.xxhash64("tilea", "tileb").alias("at"), "a", "b"), f"{path}/met")
    visits = met.select("at", F.col("a").alias("ord")).union(met.select("at", "b")).distinct()
    texts = visits.join(docs.select("ord", "text"), "ord").select("at", F.col("ord").alias("a"), F.lit(None).cast(kind).alias("b"), F.coalesce("text", F.lit("")).alias("text"))
    rows = texts.union(met.select("at", "a", "b", F.lit(None).cast("string")))

    def alike(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        """The texts of a place come first, then its pairs."""
        place, sets = None, {}
        for batch in batches:
            out: list[tuple] = []
            for at, a, b, text in zip(*(c.to_pylist() for c in batch.columns), strict=True):
                if at != place:
                    place, sets = at, {}
                if b is None:
                    sets[a] = shingle_set(text, k)
                elif a in sets and b in sets:
                    m, n = sets[a], sets[b]
                    both = len(np.intersect1d(m, n, assume_unique=True))
                    out.append((a, b, both / (len(m) + len(n) - both) if len(m) or len(n) else 1.0))
            types = batch.schema.field("a").type, batch.schema.field("a").type, pa.float64()
            yield pa.RecordBatch.from_arrays([pa.array([r[i] for r in out], t) for i, t in enumerate(types)], names=["a", "b", "jaccard"])

    # Nulls sort first: a place's texts before its pairs.
    return rows.repartition("at").sortWithinPartitions("at", "b").mapInArrow(alike, f"a {kind}, b {kind}, jaccard double")


def similar_pairs(df: DataFrame, cfg: DedupConfig = DedupConfig(), ord_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """(a, b, jaccard) of all rows that share a band and are as similar as the threshold, a < b.

    Texts that normalise alike are compared as one; their rows are paired at the end, in blocks
    of BLOCK rows, each two blocks in a task, so only the result grows with the square of the copies.
    """
    spark = df.sparkSession
    out = shared_dir(spark)
    with temporary(spark, out):
        path = shared_dir(spark)
        keyed, firsts, heads, banded = _heads(df, cfg, ord_col, text_col, path)
        found = jaccard(candidate_pairs(banded.select("ord", F.lit(0).alias("band"), F.col("bucket").alias("key"))), heads, cfg.shingle_size)
        found = store(found.where(F.col("jaccard") >= cfg.threshold), f"{path}/alike")
        rows = keyed.join(firsts, "h").select("head", "ord")
        many = store(firsts.where("n > 1").select("head", F.ceil(F.col("n") / BLOCK).alias("blocks")), f"{path}/many")
        block = F.pmod(F.xxhash64("ord"), F.coalesce("blocks", F.lit(1))).alias("block")
        members = store(rows.join(many, "head", "left").select("head", block, "ord").groupBy("head", "block").agg(F.collect_list("ord").alias("ords")), f"{out}/members")
        links = store(found.union(many.select("head", "head", F.lit(1.0))), f"{out}/links")
    x, y = (members.select(F.col("head").alias(o), F.col("block").alias(f"block{o}"), F.col("ords").alias(f"ords{o}")) for o in "ab")
    met = links.join(x, "a").join(y, "b").where("a <> b or blocka <= blockb")
    met = met.repartition(int(spark.conf.get("spark.sql.shuffle.partitions")), "a", "blocka", "b", "blockb")
    each = met.withColumn("one", F.explode("ordsa")).withColumn("other", F.explode("ordsb")).where("a <> b or blocka < blockb or one < other")
    return each.select(F.least("one", "other").alias("a"), F.greatest("one", "other").alias("b"), "jaccard")


def components(edges: DataFrame) -> DataFrame:
    """(ord, component) of every node of an edge: the smallest id it can reach.

    Labels are the least of the neighbours' labels, then jump to the label of their label
    twice a round, so the rounds grow with the logarithm of a chain's length.
    """
    path = shared_dir(edges.sparkSession)
    both = store(edges.select("a", "b").union(edges.select("b", "a")), f"{path}/both")
    labels = store(both.groupBy(F.col("a").alias("ord")).agg(F.min(F.least("a", "b")).alias("label")), f"{path}/0")
    n = 0
    while True:
        n += 1
        near = both.join(labels.select(F.col("ord").alias("b"), "label"), "b").groupBy(F.col("a").alias("ord")).agg(F.min("label").alias("near"))
        new = labels.withColumnRenamed("label", "was").join(near, "ord").select("ord", "was", F.least("was", "near").alias("label"))
        for _ in range(2):
            jump = labels.select(F.col("ord").alias("label"), F.col("label").alias("further"))
            new = new.join(jump, "label", "left").select("ord", "was", F.least("label", "further").alias("label"))
        new = store(new, f"{path}/{n}")
        labels = new.select("ord", "label")
        if not new.where("was <> label").limit(1).count():
            return labels.withColumnRenamed("label", "component")


def in_order(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """(ord, original) of what goes, from pairs (component, b, a) in this order, a < b.

    When b's pairs come, every a is decided: what has not gone stays.
    """
    component = node = None
    gone: set = set()
    found = False
    for batch in batches:
        out: list[tuple] = []
        for c, b, a in zip(*(batch.column(n).to_pylist() for n in ("component", "b", "a")), strict=True):
            if c != component:
                component, node, gone = c, None, set()
            if b != node:
                node, found = b, False
            if not found and a not in gone:
                found = True
                gone.add(b)
                out.append((b, a))
        yield pa.RecordBatch.from_arrays([pa.array([r[k] for r in out], batch.schema.field("a").type) for k in (0, 1)], names=["ord", "original"])


def leaders(nodes: DataFrame, edges: DataFrame, limit: int = COMPONENT_EDGES) -> DataFrame:
    """(ord, original): null for what stays, else the first kept earlier neighbour."""
    spark = nodes.sparkSession
    out = shared_dir(spark)
    with temporary(spark, out):
        edges = store(edges.select(F.least("a", "b").alias("a"), F.greatest("a", "b").alias("b")).where("a <> b").distinct(), shared_dir(spark))
        parted = store(edges.join(components(edges).withColumnRenamed("ord", "a"), "a").select("component", "b", "a"), shared_dir(spark))
        large = store(parted.groupBy("component").agg(F.count("*").alias("n")).where(F.col("n") > limit).select("component"), shared_dir(spark))
        small = parted.join(large, "component", "left_anti")
        kind = edges.schema["a"].dataType.simpleString()
        found = small.repartition("component").sortWithinPartitions("component", "b", "a").mapInArrow(in_order, f"ord {kind}, original {kind}")
        if large.limit(1).count():
            found = found.union(in_rounds(parted.join(large, "component", "left_semi").select("a", "b")))
        found = store(found, out)
    return nodes.select("ord").join(found, "ord", "left")


def in_rounds(edges: DataFrame) -> DataFrame:
    """(ord, original) of what goes, for components too large for a task: a round decides all whose earlier neighbours are decided."""
    path = shared_dir(edges.sparkSession)
    edges = store(edges, f"{path}/edges")
    kept = store(edges.select(F.col("a").alias("ord")).distinct().join(edges.select(F.col("b").alias("ord")), "ord", "left_anti"), f"{path}/kept0")
    dropped, left, n = None, edges, 0
    while True:
        n += 1
        # Later neighbours of what has been kept so far go.
        gone = store(left.join(kept.select(F.col("ord").alias("a")), "a", "left_semi").select(F.col("b").alias("ord")).distinct(), f"{path}/gone{n}")
        dropped = gone if dropped is None else dropped.union(gone)
        left = left.join(kept.select(F.col("ord").alias("a")), "a", "left_anti")
        for end in ("a", "b"):
            left = left.join(gone.select(F.col("ord").alias(end)), end, "left_anti")
        waiting = edges.join(gone.select(F.col("ord").alias("a")), "a", "left_semi").select(F.col("b").alias("ord")).distinct()
        left = store(left.select("a", "b"), f"{path}/left{n}")
        if not gone.limit(1).count():
            break
        # What waited only for dropped neighbours, and is not dropped itself, stays.
        free = waiting.join(dropped, "ord", "left_anti").join(left.select(F.col("b").alias("ord")), "ord", "left_anti").join(kept, "ord", "left_anti")
        kept = store(kept.union(store(free, f"{path}/free{n}")), f"{path}/kept{n}")
    first = edges.join(kept.select(F.col("ord").alias("a")), "a", "left_semi")
    return first.groupBy(F.col("b").alias("ord")).agg(F.min("a").alias("original"))


def near_duplicates(df: DataFrame, cfg: DedupConfig = DedupConfig(), ord_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """(ord, original) of every row, by MinHash; texts too short for a shingle are alike."""
    spark = df.sparkSession
    out = shared_dir(spark)
    with temporary(spark, out):
        return store(_near(df, cfg, ord_col, text_col), out)


def _texts(df: DataFrame, cfg: DedupConfig, ord_col: str, text_col: str, path: str) -> tuple[DataFrame, DataFrame, DataFrame]:
    """(ord, h), (h, head, n), (ord, text) of the first row of each text."""
    rows = df.select(F.col(ord_col).alias("ord"), normalised(F.coalesce(F.col(text_col), F.lit(""))).alias("text"))
    rows = rows.withColumn("text", F.when(F.length("text") < cfg.shingle_size, F.lit("")).otherwise(F.col("text"))).withColumn("h", F.md5("text"))
    # One row for each text: ids by hash first, so that a text's copies are never gathered.
    keyed = store(spread(rows).select("ord", "h"), f"{path}/keys")
    firsts = store(keyed.groupBy("h").agg(F.min("ord").alias("head"), F.count("*").alias("n")), f"{path}/firsts")
    heads = store(spread(rows.select("ord", "text")).join(firsts.select(F.col("head").alias("ord")), "ord", "left_semi").dropDuplicates(["ord"]), f"{path}/heads")
    return keyed, firsts, heads


def _banded(heads: DataFrame, cfg: DedupConfig) -> DataFrame:
    """(ord, band, key, bucket) of (ord, text)."""
    return bands(spread(heads).select("ord", signature(F.col("text"), cfg).alias("sig")), cfg).withColumn("bucket", bucket())


def bucket() -> Column:
    return F.xxhash64("band", "key")


def _crowded(buckets: DataFrame, path: str) -> DataFrame:
    """(ord, bucket) where others share it."""
    crowd = buckets.groupBy("bucket").agg(F.count("*").alias("n")).where("n > 1").select("bucket")
    return store(buckets.join(crowd, "bucket", "left_semi"), f"{path}/bands")


def _heads(df: DataFrame, cfg: DedupConfig, ord_col: str, text_col: str, path: str) -> tuple[DataFrame, DataFrame, DataFrame, DataFrame]:
    """(ord, h), (h, head, n), (ord, text) of the first row of each text, (ord, bucket) where others share it."""
    keyed, firsts, heads = _texts(df, cfg, ord_col, text_col, path)
    return keyed, firsts, heads, _crowded(store(_banded(heads, cfg).select("ord", "bucket"), f"{path}/every"), path)


def after_earlier(df: DataFrame, earlier: tuple[DataFrame, DataFrame] | None, cfg: DedupConfig = DedupConfig(), ord_col: str = "doc_id", text_col: str = "text") -> tuple[DataFrame, DataFrame, DataFrame]:
    """(ord), (ord, band, key), (ord, text) of the rows that stay when those of ``earlier`` came before and stay.

    ``earlier`` has the last two tables of what was there.  Each text is signed once, whether
    it is held against earlier texts, against its own table or kept for later ones.
    """
    path = shared_dir(df.sparkSession)
    keyed, firsts, heads = _texts(df, cfg, ord_col, text_col, path)
    every = store(_banded(heads, cfg), f"{path}/every")
    buckets = every.select("ord", "bucket")
    if earlier is not None:
        old, old_texts = earlier
        pairs = old.select(F.col("ord").alias("a"), bucket().alias("bucket")).join(buckets.withColumnRenamed("ord", "b"), "bucket").select("a", "b").distinct()
        if cfg.verify:
            pairs = jaccard(pairs, old_texts.select("ord", "text").union(heads.select("ord", "text")), cfg.shingle_size).where(F.col("jaccard") >= cfg.threshold)
        known = store(pairs.select(F.col("b").alias("ord")).distinct(), f"{path}/known")
        buckets = buckets.join(known, "ord", "left_anti")
        firsts = firsts.join(known.withColumnRenamed("ord", "head"), "head", "left_anti").select("h", "head", "n")  # copies of a known text go with it
    judged = _judged(keyed, firsts, heads, _crowded(buckets, path), cfg, path)
    stays = store(judged.where("original is null").select("ord").distinct(), f"{path}/stay")
    return stays, *(x.join(stays, "ord", "left_semi") for x in (every.select("ord", "band", "key"), heads.select("ord", "text")))


def _near(df: DataFrame, cfg: DedupConfig, ord_col: str, text_col: str) -> DataFrame:
    path = shared_dir(df.sparkSession)
    return _judged(*_heads(df, cfg, ord_col, text_col, path), cfg, path)


def _judged(keyed: DataFrame, firsts: DataFrame, heads: DataFrame, banded: DataFrame, cfg: DedupConfig, path: str) -> DataFrame:
    """(ord, original) of the rows whose text is in ``firsts``."""

    def near(pairs: DataFrame, name: str) -> DataFrame:
        """Those of the pairs that are near, stored."""
        pairs = pairs.select("a", "b").distinct()
        if cfg.verify:
            pairs = jaccard(pairs, heads, cfg.shingle_size).where(F.col("jaccard") >= cfg.threshold).select("a", "b")
        return store(pairs, f"{path}/near-{name}")

    # Rounds: the first of all its buckets stays, and takes the near ones of the others.
    left, gone, late = banded, None, None
    for n in range(BUCKET_ROUNDS):
        lead = left.groupBy("bucket").agg(F.min("ord").alias("a"))
        seen = store(left.join(lead, "bucket").select("bucket", F.col("ord").alias("b"), "a"), f"{path}/seen{n}")
        stays = store(seen.groupBy("b").agg(F.min("a").alias("a")).where("a = b").select("a"), f"{path}/stays{n}")
        found = near(seen.where("a <> b").join(stays, "a", "left_semi"), f"round{n}").groupBy(F.col("b").alias("ord")).agg(F.min("a").alias("original"))
        late = stays if late is None else late.union(stays)
        gone = found if gone is None else gone.union(found)
        decided = stays.withColumnRenamed("a", "ord").union(found.select("ord"))
        left = store(left.join(decided, "ord", "left_anti"), f"{path}/left{n}")
        if not left.limit(1).count():
            break
    kept = late.withColumnRenamed("a", "ord")
    if left.limit(1).count():  # pairs of what is undecided then
        led = leaders(left.select("ord").distinct(), near(candidate_pairs(left.select("ord", F.lit(0).alias("band"), F.col("bucket").alias("key"))), "rest"))
        led = store(led, f"{path}/led")
        gone = gone.union(led.where("original is not null"))
        kept = kept.union(led.where("original is null").select("ord"))
    gone = store(gone, f"{path}/gone")
    # Who went early may have an even earlier neighbour that was decided later.
    early = banded.join(kept, "ord", "left_semi").select(F.col("ord").alias("a"), "bucket").join(banded.join(gone, "ord").select(F.col("ord").alias("b"), "bucket", "original"), "bucket")
    early = store(early.where("a < original").select("a", "b").distinct(), f"{path}/early")
    final = gone.select(F.col("ord").alias("head"), "original")
    if early.limit(1).count():
        better = near(early, "earlier").groupBy(F.col("b").alias("head")).agg(F.min("a").alias("better"))
        final = final.join(better, "head", "left").select("head", F.coalesce("better", "original").alias("original"))
    named = firsts.select("h", "head").join(final, "head", "left")
    result = keyed.join(named, "h")
    return result.select("ord", F.when(F.col("ord") != F.col("head"), F.coalesce("original", "head")).otherwise(F.col("original")).alias("original"))


def deduplicate(df: DataFrame, cfg: DedupConfig = DedupConfig(), ord_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """All columns of the rows that stay."""
    stays = near_duplicates(df, cfg, ord_col, text_col).where("original is null").select(F.col("ord").alias(ord_col))
    return df.join(stays, ord_col, "left_semi")


def result(judged: DataFrame) -> DataFrame:
    """One row: totals, clusters (distinct originals) and the rate in percent."""
    total, dups = F.count("*"), F.count("original")
    rate = F.coalesce(F.try_divide(dups * 100.0, total.cast("double")), F.lit(0.0))
    return judged.agg(total.alias("total_documents"), (total - dups).alias("unique_documents"), dups.alias("duplicate_documents"), F.count_distinct("original").alias("duplicate_clusters"), rate.alias("dedup_rate"))


def content_hash(c: Column, algorithm: str = "md5") -> Column:
    """Hash of the stripped, lower-cased text."""
    c = F.lower(T.strip(F.coalesce(c, F.lit(""))))
    if algorithm == "md5":
        return F.md5(c)
    if algorithm == "sha1":
        return F.sha1(c)
    if algorithm in EXACT_ALGORITHMS:
        return F.sha2(c, int(algorithm[3:]))
    raise ValueError(f"hash algorithm {algorithm!r} is not one of {EXACT_ALGORITHMS}")


def exact_duplicates(df: DataFrame, algorithm: str = "md5", ord_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """Add ``first_id`` (the first row with the same content) and ``is_duplicate``.

    Only ids and hashes are grouped; texts are never shuffled by content, so that a large
    group of copies goes to no single task.  The table of later copies is stored first, so
    that Spark knows its size: a small one is broadcast, and texts are not shuffled at all.
    Rows of one id have one ``first_id``, the least.
    """
    keys = df.select(F.col(ord_col).alias("__ord"), content_hash(F.col(text_col), algorithm).alias("__h"))
    path = shared_dir(df.sparkSession)
    keys = store(keys, f"{path}/keys")
    first = keys.groupBy("__h").agg(F.min("__ord").alias("first_id"), F.count("*").alias("__n")).where("__n > 1")
    later = keys.join(first, "__h").where(F.col("__ord") != F.col("first_id")).groupBy("__ord").agg(F.min("first_id").alias("first_id"))
    later = store(later, f"{path}/later").withColumnRenamed("__ord", ord_col)
    named = df.join(later, ord_col, "left").select(*(df[c] for c in df.columns), later["first_id"])
    return named.withColumn("first_id", F.coalesce("first_id", F.col(ord_col))).withColumn("is_duplicate", F.col(ord_col) != F.col("first_id"))


def simhash(c: Column, bits: int = 60) -> Column:
    """SimHash of the words, each word one vote: similar texts differ in few bits.

    In Arrow batches: a fold per bit over an array would read every word once a bit.
    """

    @F.pandas_udf("long")
    def run(s: pd.Series) -> pd.Series:
        def one(t: str | None) -> int:
            words = Counter((t or "").lower().split())
            if not words:
                return 0
            raw = b"".join(hashlib.md5(w.encode("utf-8", "surrogatepass")).digest()[:8] for w in words)
            votes = 2 * np.unpackbits(np.frombuffer(raw, np.uint8).reshape(-1, 8), axis=1)[:, :bits].astype(np.int64) - 1
            total = votes.T @ np.fromiter(words.values(), np.int64, len(words))
            return int("".join("1" if v > 0 else "0" for v in total), 2)

        return s.map(one)

    return run(c)


def simhash_duplicates(df: DataFrame, distance: int = SIM_DISTANCE, ord_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """(ord, original) of every row, by SimHashes that differ in ``distance`` bits at most.

    Of SIM_BLOCKS blocks of a hash, as many as the distance may differ; the others agree, so
    near hashes share one of the keys made of them.  Rows with the same hash are one node.
    """
    spark = df.sparkSession
    out = shared_dir(spark)
    with temporary(spark, out):
        rows = store(df.select(F.col(ord_col).alias("ord"), simhash(F.col(text_col)).alias("h")), shared_dir(spark))
        heads = store(rows.groupBy("h").agg(F.min("ord").alias("ord")), shared_dir(spark))
        width = SIM_BITS // SIM_BLOCKS
        masks = [reduce(lambda m, k: m | ((1 << width) - 1) << k * width, c, 0) for c in combinations(range(SIM_BLOCKS), SIM_BLOCKS - distance)]
        keys = heads.select("ord", "h", F.posexplode(F.array(*(F.col("h").bitwiseAND(F.lit(m)) for m in masks))).alias("table", "key"))
        x, y = (keys.select("table", "key", F.col("ord").alias(o), F.col("h").alias(f"h{o}")) for o in "ab")
        pairs = x.join(y, ["table", "key"]).where((F.col("a") < F.col("b")) & (F.bit_count(F.col("ha").bitwiseXOR(F.col("hb"))) <= distance)).select("a", "b").distinct()
        named = heads.select("h", F.col("ord").alias("head")).join(leaders(heads, pairs).withColumnRenamed("ord", "head"), "head")
        original = F.when(F.col("ord") != F.col("head"), F.coalesce("original", "head")).otherwise(F.col("original")).alias("original")
        return store(rows.join(named, "h").select("ord", original), out)


def simhash_deduplicate(df: DataFrame, distance: int = SIM_DISTANCE, ord_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """All columns of the rows that stay."""
    stays = simhash_duplicates(df, distance, ord_col, text_col).where("original is null").select(F.col("ord").alias(ord_col))
    return df.join(stays, ord_col, "left_semi")
