"""Queries of the duplicate operators."""

from __future__ import annotations

from pyspark.sql import functions as F

from textloom.operators import dedup
from textloom.plans.catalogue import register
from textloom.plans.text_queries import WS, docs

CFG = dedup.DedupConfig()
BANDS, ROWS = dedup.band_shape(CFG.threshold, CFG.num_perm)
P, R = dedup.P, dedup.RADIX

HASH = "c[i]"
for _k in range(1, CFG.shingle_size):
    HASH = f"(({HASH}) * {R} + c[i + {_k}]) % {P}"
SHINGLE_SQL = f"""norm AS (SELECT doc_id AS ord, regexp_replace(lower(text), '[{WS}]+', ' ', 'g') AS t FROM documents),
  chars AS (SELECT ord, regexp_extract_all(t, '(?s).') AS s, list_transform(regexp_extract_all(t, '(?s).'), lambda x: unicode(x)::BIGINT) AS c FROM norm),
  shingles AS (SELECT DISTINCT ord, {" || ".join(f"s[i + {k}]" for k in range(CFG.shingle_size))} AS g, {HASH} AS h
    FROM (SELECT ord, s, c, unnest(range(1, len(c) - {CFG.shingle_size - 2})) AS i FROM chars WHERE len(c) >= {CFG.shingle_size}))"""
SIG_SQL = f"""{SHINGLE_SQL},
  mins AS (SELECT ord, [{", ".join(f"min((h * {a} + {b}) % {P})" for a, b in dedup.coefficients(CFG.num_perm))}] AS sig FROM shingles GROUP BY ord),
  sigs AS (SELECT norm.ord, coalesce(sig, list_transform(range({CFG.num_perm}), lambda x: {P}::BIGINT)) AS sig FROM norm LEFT JOIN mins USING (ord))"""
BAND_SQL = f"""{SIG_SQL},
  bands AS (SELECT ord, band, md5(array_to_string(sig[band * {ROWS} + 1 : (band + 1) * {ROWS}], ',')) AS key FROM (SELECT ord, sig, unnest(range({BANDS})) AS band FROM sigs))"""
PAIR_SQL = f"""{BAND_SQL},
  pairs AS (SELECT DISTINCT x.ord AS a, y.ord AS b FROM bands x JOIN bands y ON x.band = y.band AND x.key = y.key AND x.ord < y.ord),
  sizes AS (SELECT norm.ord, count(g) AS n FROM norm LEFT JOIN shingles USING (ord) GROUP BY norm.ord),
  common AS (SELECT a, b, count(*) AS k FROM pairs JOIN shingles x ON x.ord = a JOIN shingles y ON y.ord = b AND x.g = y.g GROUP BY a, b),
  scored AS (SELECT a, b, CASE WHEN x.n + y.n = 0 THEN 1.0::DOUBLE ELSE coalesce(k, 0)::DOUBLE / (x.n + y.n - coalesce(k, 0)) END AS jaccard
    FROM pairs LEFT JOIN common USING (a, b) JOIN sizes x ON x.ord = a JOIN sizes y ON y.ord = b)"""
LEADER_SQL = f"""WITH RECURSIVE {PAIR_SQL},
  edges AS (SELECT a, b FROM scored WHERE jaccard >= {CFG.threshold}::DOUBLE),
  nodes AS (SELECT ord, row_number() OVER (ORDER BY ord) AS rn, coalesce(ns, []::BIGINT[]) AS ns FROM (SELECT a AS ord FROM edges UNION SELECT b FROM edges) LEFT JOIN (SELECT b AS ord, list(a) AS ns FROM edges GROUP BY b) USING (ord)),
  walk(rn, kept) AS (SELECT 0::BIGINT, []::BIGINT[] UNION ALL
    SELECT w.rn + 1, CASE WHEN list_has_any(n.ns, w.kept) THEN w.kept ELSE list_append(w.kept, n.ord) END FROM walk w JOIN nodes n ON n.rn = w.rn + 1),
  stays AS (SELECT kept FROM walk ORDER BY rn DESC LIMIT 1),
  judged AS (SELECT norm.ord, CASE WHEN list_has_any(ns, kept) THEN list_min(list_intersect(ns, kept)) END AS original FROM norm CROSS JOIN stays LEFT JOIN nodes USING (ord))"""
EXACT_SQL = f"""WITH h AS (SELECT doc_id, md5(lower(regexp_replace(regexp_replace(text, '^[{WS}]+', ''), '[{WS}]+$', ''))) AS h FROM documents),
  f AS (SELECT doc_id, min(doc_id) OVER (PARTITION BY h) AS first_id FROM h)"""


@register("exact_dedup", f"{EXACT_SQL} SELECT doc_id, first_id, doc_id <> first_id AS is_duplicate FROM f")
def exact_dedup(spark, sf_dir):
    return dedup.exact_duplicates(docs(spark, sf_dir)).select("doc_id", "first_id", "is_duplicate")


@register("exact_dedup_stats", f"{EXACT_SQL} SELECT count(*) AS total, count(DISTINCT first_id) AS n_unique, count(*) FILTER (doc_id <> first_id) AS duplicates FROM f")
def exact_dedup_stats(spark, sf_dir):
    d = dedup.exact_duplicates(docs(spark, sf_dir), "sha256")
    return d.agg(F.count("*").alias("total"), F.count_distinct("first_id").alias("n_unique"), F.count_if("is_duplicate").alias("duplicates"))


@register("shingle_counts", f"WITH {SHINGLE_SQL} SELECT norm.ord AS doc_id, count(g) AS n_shingles FROM norm LEFT JOIN shingles USING (ord) GROUP BY norm.ord")
def shingle_counts(spark, sf_dir):
    return docs(spark, sf_dir).select("doc_id", dedup.shingle_count(dedup.normalised(F.col("text")), CFG.shingle_size).alias("n_shingles"))


@register("minhash_signatures", f"WITH {SIG_SQL} SELECT ord, md5(array_to_string(sig, ',')) AS sig_md5 FROM sigs")
def minhash_signatures(spark, sf_dir):
    return dedup.signatures(docs(spark, sf_dir), CFG).select("ord", F.md5(F.array_join("sig", ",")).alias("sig_md5"))


@register("lsh_bands", f"WITH {BAND_SQL} SELECT band, count(DISTINCT key) AS n_keys, count(*) AS n FROM bands GROUP BY band")
def lsh_bands(spark, sf_dir):
    return dedup.bands(dedup.signatures(docs(spark, sf_dir), CFG), CFG).groupBy(F.col("band").cast("long").alias("band")).agg(F.count_distinct("key").alias("n_keys"), F.count("*").alias("n"))


@register("lsh_pairs", f"WITH {PAIR_SQL} SELECT a, b FROM pairs")
def lsh_pairs(spark, sf_dir):
    return dedup.candidate_pairs(dedup.bands(dedup.signatures(docs(spark, sf_dir), CFG), CFG))


@register("jaccard_pairs", f"WITH {PAIR_SQL} SELECT a, b, round(jaccard, 9) AS jaccard FROM scored WHERE jaccard >= {CFG.threshold}::DOUBLE")
def jaccard_pairs(spark, sf_dir):
    return dedup.similar_pairs(docs(spark, sf_dir), CFG).select("a", "b", F.round("jaccard", 9).alias("jaccard"))


@register("dedup_leaders", f"{LEADER_SQL} SELECT ord AS doc_id FROM judged WHERE original IS NULL")
def dedup_leaders(spark, sf_dir):
    return dedup.deduplicate(docs(spark, sf_dir), CFG).select("doc_id")


@register("duplicate_of", f"{LEADER_SQL} SELECT ord, original FROM judged WHERE original IS NOT NULL")
def duplicate_of(spark, sf_dir):
    return dedup.near_duplicates(docs(spark, sf_dir), CFG).where("original is not null")


@register("dedup_result", f"{LEADER_SQL} SELECT count(*) AS total_documents, count(*) - count(original) AS unique_documents, count(original) AS duplicate_documents, count(DISTINCT original) AS duplicate_clusters, round(count(original) * 100.0::DOUBLE / count(*), 6) AS dedup_rate FROM judged")
def dedup_result(spark, sf_dir):
    return dedup.result(dedup.near_duplicates(docs(spark, sf_dir), CFG)).withColumn("dedup_rate", F.round("dedup_rate", 6))


SIMHASH_SQL = f"""WITH w AS (SELECT doc_id, unnest(regexp_extract_all(lower(text), '[^{WS}]+')) AS w FROM documents),
  c AS (SELECT doc_id, w, count(*) AS n FROM w GROUP BY ALL),
  h AS (SELECT doc_id, n, ('0x' || substr(md5(w), 1, 15))::BIGINT AS v FROM c),
  b AS (SELECT doc_id, k, sum(CASE WHEN (v >> (59 - k)) & 1 = 1 THEN n ELSE -n END) AS votes FROM h, range(60) t(k) GROUP BY ALL)
SELECT documents.doc_id, coalesce(sum(CASE WHEN votes > 0 THEN 1::BIGINT << (59 - k) ELSE 0 END), 0)::BIGINT AS simhash FROM documents LEFT JOIN b USING (doc_id) GROUP BY documents.doc_id"""


@register("simhash_values", SIMHASH_SQL)
def simhash_values(spark, sf_dir):
    return docs(spark, sf_dir).select("doc_id", dedup.simhash(F.col("text")).alias("simhash"))
