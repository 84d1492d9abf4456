"""N-gram Jaccard join with adaptive multi-match prefixes (exact).

Two documents link when the Jaccard similarity of their sets of distinct three-word
shingles reaches PERCENT.  Exact copies of a set are one class from the start.

Order.  All shingles stand in one global order: by estimated frequency, then hash.
The estimate is a sketch of fixed size (a count per hash cell over all documents).
It only orders: any order gives the same links, a good one fewer candidates.

Prefixes.  In that order two linked sets share at least one shingle among the first
``n - ceil(p n) + 1`` of each, and at least m among the first ``n - ceil(p n) + m``.
A document whose prefix holds costly shingles lengthens it, up to MATCHES, and then
asks for as many shared ones: a pair must share the smaller of its two demands.

Candidates.  A prefix shingle that no other class has in its prefix is dead.  For a
shared shingle, what stood before it limits the overlap: at most the live ones
before it can be shared, so ``min(live before) + 1 + min(left after)`` must reach the
overlap that the two sizes demand.

Every set has a parity bitmap of BITMAP bits: two sets whose bitmaps differ in d bits
differ in d shingles or more, so they share ``(n + m - d) / 2`` at most.  Pairs for which
that is too few are never listed.

Links.  Each class first meets, through each of its prefix shingles, the class with
the fewest shingles before it there, and is verified against the best of them: this
ties large groups of near copies together without all their pairs.  Then every
candidate pair between different components is verified, and none inside one,
where a link could change nothing.  The classes of a common shingle are compared in
blocks, each two of them in another task.  Nothing is capped.

Rows with a null or wordless text link with nothing and are their own component;
rows with fewer words than a shingle have the whole sequence as their one shingle;
repeated rows are one class; whole texts are read; an empty table gives an empty
result; further columns are ignored.  ``link_classes`` wants ids that are not null and
answers each row; ``one_of_each`` says what it does with null and repeated ids.
"""

from __future__ import annotations

import zlib
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from textloom.llm import common

U64 = np.uint64
WORDS, PERCENT = 3, 90
#: Most shared prefix shingles a document may ask for.
MATCHES = 3
#: Cells of the frequency sketch: one for so many shingles, between these bounds.
CELL_LOAD, MIN_BITS, MAX_BITS = 64, 12, 22
#: A shingle is costly when its estimate is so many times the mean cell.
COSTLY = 4
#: Classes of a shingle that are compared in one place; those of a commoner one are dealt out in blocks of so many.
BLOCK_CLASSES = 1024
#: Bits of a set's parity bitmap, in 64-bit lanes.
BITMAP = 256
LANES = [f"w{i}" for i in range(BITMAP // 64)]


def shingles(text: str, k: int = WORDS) -> np.ndarray:
    """Sorted distinct hashes of a text's k-word shingles (ASCII letters in lower case)."""
    return np.unique(common.window_hashes(common.word_hashes(text.encode("utf-8", "surrogatepass").translate(common.LOWER)), k))


def least_overlap(n: int, m: int, percent: int = PERCENT) -> int:
    """The smallest overlap of sets of n and m that links them."""
    return -(-percent * (n + m) // (100 + percent))


def prefix_size(n: int, percent: int, matches: int) -> int:
    """Shingles two linked sets share ``matches`` of, at least, in the order's first ones."""
    least = -(-percent * n // 100)
    return min(n, n - least + matches)


def parity(h: np.ndarray) -> np.ndarray:
    """The set's bitmap as signed 64-bit lanes: bit b says whether an odd number of hashes end in b."""
    odd = (np.bincount((h & U64(BITMAP - 1)).astype(np.int64), minlength=BITMAP) & 1).astype(np.uint8)
    return np.packbits(odd).view(np.int64)


# ---------------------------------------------------------------- sketch


def sketch(cut: DataFrame, k: int) -> np.ndarray:
    """Counts of shingles by hash cell, over all documents; its size is bounded by MAX_BITS."""
    words = cut.agg(F.sum(F.length("text"))).first()[0] or 0
    bits = int(np.clip(np.ceil(np.log2(max(1, words / 6 / CELL_LOAD))), MIN_BITS, MAX_BITS))
    slice_bits = max(0, bits - 8)

    def count(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        cells, some = np.zeros(1 << bits, np.uint32), False
        for batch in batches:
            for piece in common.slices(batch):
                for t in common.texts(piece.column(0)):
                    h = shingles(t, k) >> U64(64 - bits)
                    np.add.at(cells, h.astype(np.int64), 1)
                    some = True
        if some:
            parts = cells.reshape(-1, 1 << slice_bits)
            yield pa.RecordBatch.from_arrays([pa.array(range(len(parts)), pa.int32()), pa.array([zlib.compress(p.tobytes(), 1) for p in parts], pa.binary())], names=["slice", "cells"])

    def add(table: pa.Table) -> pa.Table:
        total = sum(np.frombuffer(zlib.decompress(c.as_py()), np.uint32).astype(np.uint64) for c in table["cells"])
        return pa.table({"slice": table["slice"][:1], "cells": pa.array([zlib.compress(np.minimum(total, 0xFFFFFFFF).astype(np.uint32).tobytes(), 1)], pa.binary())})

    ddl = "slice int, cells binary"
    made = cut.select("text").mapInArrow(count, ddl)
    halfway = made.withColumn("salt", F.spark_partition_id() % 16).groupBy("slice", "salt").applyInArrow(lambda t: add(t.select(["slice", "cells"])), ddl)
    total = np.zeros((-(-(1 << bits) >> slice_bits), 1 << slice_bits), np.uint32)
    for row in halfway.groupBy("slice").applyInArrow(add, ddl).collect():  # at most 2^MAX_BITS counts
        total[row["slice"]] = np.frombuffer(zlib.decompress(row["cells"]), np.uint32)
    return total.reshape(-1)


# ---------------------------------------------------------------- prefixes


def prefix_of(h: np.ndarray, estimate: np.ndarray, costly: int, percent: int) -> tuple[np.ndarray, int]:
    """A set's prefix in the global order, and how many shared ones it asks for.

    The prefix grows while it holds costly shingles and the longer one, asking for
    one match more, costs no more per demanded match.
    """
    least = -(-percent * len(h) // 100)
    most = min(prefix_size(len(h), percent, MATCHES), len(h))
    order = np.lexsort((h, estimate))[:most]
    cost = np.cumsum(estimate[order].astype(np.int64))
    base = len(h) - least
    matches = 1
    while matches < MATCHES and base + matches < len(order) and estimate[order[base + matches - 1]] >= costly and cost[base + matches] * matches <= cost[base + matches - 1] * (matches + 1):
        matches += 1
    return h[order[: base + matches]], matches


def prefixes(cut: DataFrame, cells: np.ndarray, k: int, percent: int) -> DataFrame:
    """(id, n, d1, d2, matches, prefix, w0..): size, digest, prefix and bitmap of every document's set."""
    bits = len(cells).bit_length() - 1
    costly = max(2, COSTLY * int(np.ceil(cells.mean())))
    shipped = cut.sparkSession.sparkContext.broadcast(cells)

    def run(batch: pa.RecordBatch) -> pa.RecordBatch:
        cells, n, d1, d2, matches, prefix, bitmap = shipped.value, [], [], [], [], [], []
        for t in common.texts(batch.column(1)):
            h = shingles(t, k)
            n.append(len(h))
            # Digest: two mixed sums over the set, which do not depend on any order.
            d1.append(int(common.mix64(h ^ U64(0x243F6A8885A308D3)).sum(dtype=U64)) - (1 << 63))
            d2.append(int(common.mix64(h + U64(0x13198A2E03707344)).sum(dtype=U64)) - (1 << 63))
            p, m = prefix_of(h, cells[(h >> U64(64 - bits)).astype(np.int64)], costly, percent) if len(h) else (h, 0)
            matches.append(m)
            prefix.append(p.astype(np.int64))
            bitmap.append(parity(h))
        kinds = {"id": pa.int64(), "n": pa.int64(), "d1": pa.int64(), "d2": pa.int64(), "matches": pa.int32(), "prefix": pa.list_(pa.int64()), **dict.fromkeys(LANES, pa.int64())}
        return common.rows(kinds, id=batch.column(0), n=n, d1=d1, d2=d2, matches=matches, prefix=prefix, **dict(zip(LANES, np.array(bitmap).T, strict=True)))

    return common.map_batches(cut, run, "id long, n long, d1 long, d2 long, matches int, prefix array<long>, " + ", ".join(f"{w} long" for w in LANES))


# ---------------------------------------------------------------- verification


def sets_of(cut: DataFrame, ids: DataFrame, k: int) -> DataFrame:
    """(id, set): the whole sets of the given classes, from their texts.

    A bit set keeps all other texts from being hashed or shuffled.
    """
    shipped = cut.sparkSession.sparkContext.broadcast(common.id_filter(ids))

    def run(batch: pa.RecordBatch) -> pa.RecordBatch | None:
        batch = common.in_filter(batch, shipped.value, 2)
        return common.rows({"id": pa.int64(), "set": pa.binary()}, id=batch.column(0), set=[shingles(t, k).tobytes() for t in common.texts(batch.column(1))])

    return common.map_batches(cut.withColumn("cell", common.filter_cell("id")), run, "id long, set binary").join(ids, "id", "left_semi")


def verified(cut: DataFrame, pairs: DataFrame, k: int, percent: int, path: str) -> DataFrame:
    """Those (a, b) whose sets link."""
    ids = pairs.select(F.col("a").alias("id")).union(pairs.select("b")).distinct()
    sets = common.store(sets_of(cut, ids, k), path)

    def run(batch: pa.RecordBatch) -> pa.RecordBatch | None:
        keep = []
        for i, (x, y) in enumerate(zip(batch.column(2), batch.column(3), strict=True)):
            x, y = np.frombuffer(x.as_py(), U64), np.frombuffer(y.as_py(), U64)
            both = len(np.intersect1d(x, y, assume_unique=True))
            if 100 * both >= percent * (len(x) + len(y) - both):
                keep.append(i)
        return batch.select(["a", "b"]).take(pa.array(keep, pa.int64())) if keep else None

    left, right = (sets.select(F.col("id").alias(c), F.col("set").alias(f"set_{c}")) for c in "ab")
    both = pairs.select("a", "b").join(left, "a").join(right, "b").select("a", "b", "set_a", "set_b")
    return common.map_batches(both, run, "a long, b long")


# ---------------------------------------------------------------- components


def components(spark: SparkSession, edges: DataFrame, path: str) -> DataFrame:
    """(id, component) of every node of an edge: the smallest id it can reach.

    Minimum labels travel over edges, and labels of labels are taken (pointer
    jumping), until nothing changes.
    """
    both = common.store(edges.select("a", "b").union(edges.select("b", "a")).distinct(), f"{path}/edges")
    labels = common.store(both.groupBy(F.col("a").alias("id")).agg(F.least(F.col("a"), F.min("b")).alias("component")), f"{path}/labels0")
    step = 0
    while True:
        step += 1
        near = both.join(labels.select(F.col("id").alias("b"), "component"), "b").groupBy(F.col("a").alias("id")).agg(F.min("component").alias("near"))
        met = labels.join(near, "id").select("id", F.col("component").alias("was"), F.least("component", "near").alias("now"))
        jump = labels.select(F.col("id").alias("now"), F.col("component").alias("further"))
        new = common.store(met.join(jump, "now", "left").select("id", "was", F.least("now", "further").alias("component")), f"{path}/labels{step}")
        changed = new.where("was <> component").limit(1).count()
        labels = new.select("id", "component")
        if not changed:
            return labels


# ---------------------------------------------------------------- join


def _linked(docs: DataFrame, path: str, k: int, percent: int, id_col: str, text_col: str) -> DataFrame:
    spark = docs.sparkSession
    cut = common.id_text(docs, id_col, text_col)
    every = common.store(prefixes(cut, sketch(cut, k), k, percent), f"{path}/prefixes")
    some = every.where("n > 0")
    classes = common.store(
        some.groupBy("d1", "d2", "n").agg(F.min("id").alias("rep"), F.first("matches").alias("matches"), F.first("prefix").alias("prefix"), *(F.first(w).alias(w) for w in LANES)),
        f"{path}/classes",
    )

    # Live prefix shingles, with the class that has the fewest shingles before each.
    index = classes.select("rep", "n", "matches", F.posexplode("prefix").alias("pos", "token"))
    posts = index.groupBy("token").agg(F.count("*").alias("posts"), F.min(F.struct("pos", "n", "rep")).alias("lead")).where("posts > 1")
    posts = common.store(posts, f"{path}/posts")
    live = index.join(posts, "token")
    live = common.store(live.select("token", "rep", "n", "matches", "pos", "lead"), f"{path}/joined")
    ranks = live.groupBy("rep").agg(F.sort_array(F.collect_list("pos")).alias("alive"))  # as long as a prefix at most
    live = common.store(
        live.join(ranks, "rep").select("token", "rep", "n", "matches", "pos", "lead", (F.array_position("alive", F.col("pos")) - 1).cast("int").alias("before")),
        f"{path}/live",
    )
    common.remove(spark, f"{path}/joined")

    least = lambda n, m: F.ceil(percent * (n + m) / F.lit(100 + percent) - 1e-9)

    # Each class against the best of those that lead its shingles.
    met = live.where("rep <> lead.rep").select("rep", "n", "pos", F.col("lead.rep").alias("b"), F.col("lead.n").alias("m"), F.col("lead.pos").alias("pos_b"))
    met = met.where(F.least(F.col("n") - F.col("pos"), F.col("m") - F.col("pos_b")) + F.least("pos", "pos_b") >= least(F.col("n"), F.col("m")))
    best = met.groupBy("rep", "b").agg(F.count("*").alias("shared")).groupBy("rep").agg(F.max(F.struct("shared", (-F.col("b")).alias("b"))).alias("best"))
    tied = common.store(best.select(F.col("rep").alias("a"), (-F.col("best.b")).alias("b")), f"{path}/leads")
    links = common.store(verified(cut, tied, k, percent, f"{path}/sets"), f"{path}/links")
    tied = components(spark, links, f"{path}/tied")

    # All candidates between different components.
    live = live.join(tied.withColumnRenamed("id", "rep"), "rep", "left").withColumn("component", F.coalesce("component", "rep")).drop("lead")
    live = common.store(live, f"{path}/parts")
    common.remove(spark, f"{path}/live")
    split = live.groupBy("token").agg(F.min("component").alias("low"), F.max("component").alias("high"), F.count("*").alias("classes")).where("low <> high")
    split = split.select("token", F.ceil(F.col("classes") / BLOCK_CLASSES).cast("int").alias("blocks"))
    open_ = live.join(split, "token").join(classes.select("rep", *LANES), "rep").withColumn("block", F.pmod(F.xxhash64("rep"), F.col("blocks")).cast("int"))
    open_ = common.store(open_, f"{path}/open")
    # Blocks p and q of a shingle's classes meet in a task of their own, p <= q.
    x, y = (open_.select("token", *(F.col(c).alias(f"{side}_{c}") for c in ("rep", "n", "matches", "pos", "before", "component", *LANES)), *place)
            for side, place in (("x", [F.col("block").alias("p"), F.explode(F.sequence(F.col("block"), F.col("blocks") - 1)).alias("q")]),
                                ("y", [F.explode(F.sequence(F.lit(0), F.col("block"))).alias("p"), F.col("block").alias("q")])))
    apart = sum((F.bit_count(F.col(f"x_{w}").bitwiseXOR(F.col(f"y_{w}"))) for w in LANES), F.lit(0))
    reach = F.least("x_before", "y_before") + 1 + F.least(F.col("x_n") - F.col("x_pos"), F.col("y_n") - F.col("y_pos")) - 1
    wanted = least(F.col("x_n"), F.col("y_n"))
    once = (x.p < x.q) | (x.x_rep < y.y_rep)
    pairs = x.join(y, (x.token == y.token) & (x.p == y.p) & (x.q == y.q) & once & (x.x_component != y.y_component) & (reach >= wanted) & (F.col("x_n") + F.col("y_n") - apart >= 2 * wanted))
    pairs = pairs.groupBy(F.least("x_rep", "y_rep").alias("a"), F.greatest("x_rep", "y_rep").alias("b"))
    pairs = pairs.agg(F.count("*").alias("shared"), F.first(F.least("x_matches", "y_matches")).alias("asked")).where("shared >= asked")
    more = common.store(verified(cut, common.store(pairs.select("a", "b"), f"{path}/pairs"), k, percent, f"{path}/sets2"), f"{path}/more")
    final = components(spark, links.union(more), f"{path}/final")

    named = classes.select("d1", "d2", "n", "rep").join(final.withColumnRenamed("id", "rep"), "rep", "left")
    named = named.select("d1", "d2", "n", F.coalesce("component", "rep").alias("component"))
    filled = some.select("id", "n", "d1", "d2").join(named, ["d1", "d2", "n"]).select("id", "n", "component")
    alone = every.where("n = 0").select("id", "n", F.col("id").alias("component"))
    return filled.union(alone).select(F.col("id").alias(id_col), F.col("n").alias("n_shingles"), F.col("component").alias("component_id"))


def link_classes(docs: DataFrame, k: int = WORDS, percent: int = PERCENT, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """(id, n_shingles, component_id) of every document; all tables but this one are removed."""
    spark = docs.sparkSession
    common.tune(spark)
    path = common.shared_dir(spark)
    with common.temporary(spark, path), common.few_files(spark):
        return common.store(_linked(docs, common.shared_dir(spark), k, percent, id_col, text_col), path)


def one_of_each(docs: DataFrame, k: int = WORDS, percent: int = PERCENT) -> DataFrame:
    """All columns of the document with the smallest id of each component.

    Rows without an id stay.  Of rows with the same id and text one stays; rows with the
    same id and different texts are kept or dropped together.
    """
    spark, columns = docs.sparkSession, docs.columns
    path = common.shared_dir(spark)
    named = docs.where("doc_id is not null")
    with common.temporary(spark, path):
        kept = link_classes(named, k, percent).where("doc_id = component_id").groupBy("doc_id").agg(F.count("*").alias("rows"))
        kept = common.store(kept, path)
    once = named.join(kept, "doc_id", "left_semi").select(columns)
    repeated = kept.where("rows > 1")
    if repeated.limit(1).count():
        once = once.join(repeated, "doc_id", "left_anti").union(once.join(repeated, "doc_id", "left_semi").dropDuplicates(["doc_id", "text"])).select(columns)
    return once.union(docs.where("doc_id is null"))


def op5_jaccard_join(spark: SparkSession, sf_dir: str) -> DataFrame:
    return link_classes(common.table(spark, sf_dir, "documents"))
