"""Queries of this package, one for each operator, parts of two that SQL can express, and the SQL."""

from __future__ import annotations

import importlib

from pyspark.sql import DataFrame, SparkSession

from textloom.llm import common, importance, quality_rules, secrets, spelling, url_filter

NAMES = {
    "op1_rans_tokens": "rans",
    "op2_byte_bpe": "byte_bpe",
    "op3_url_filter": "url_filter",
    "op4_secrets": "secrets",
    "op5_jaccard_join": "jaccard_join",
    "op6_decontaminate": "decontaminate",
    "op7_edit_counts": "edit_counts",
    "op8_quality_rules": "quality_rules",
    "op9_knn_quality": "knn_quality",
    "op10_html_text": "html_text",
    "op11_importance_resample": "importance",
    "op12_spelling_variants": "spelling",
    "op13_bpe": "bpe",
}


def secret_counts(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The base kinds of op4, counted."""
    return secrets.find_secrets(common.table(spark, sf_dir, "documents")).select("doc_id", "n_assign", "n_access", "n_hex")


def quality_counts(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The base rules of op8, without a model."""
    judged = quality_rules.judge(common.table(spark, sf_dir, "documents"), quality_rules.NEUTRAL)
    return judged.select("doc_id", "n_words", "word_chars", "n_symbols", "n_dup_lines", "n_repeat_words", "base_failed")


def queries() -> dict:
    found = {name: getattr(importlib.import_module(f"textloom.llm.{module}"), name) for name, module in NAMES.items()}
    return found | {"secret_counts": secret_counts, "quality_counts": quality_counts}


WORDS = r"'[^\x20\x09-\x0D]+'"
UPPER = "'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz'"


def url_sql() -> str:
    quoted = lambda t: "'" + t.replace("'", "''") + "'"
    like = lambda g: "'" + "".join({"*": "%", "?": "_", "%": r"\%", "_": r"\_", "\\": r"\\", "'": "''"}.get(c, c) for c in g) + "'"
    rules = sorted(url_filter.BASE_RULES, key=lambda r: -len(r[0] + r[1]))
    fits = [(f"ends_with('.' || host, {quoted('.' + h)}) AND starts_with(path, {quoted(p)})", h + p, v) for h, p, v in rules]
    globs = " + ".join(f"(url LIKE {like(g)} ESCAPE '\\')::INTEGER" for g in url_filter.default_globs())
    return f"""WITH rest AS (SELECT page_id, CASE WHEN position('://' IN url) > 0 THEN substr(url, position('://' IN url) + 3) ELSE '' END AS r FROM pages),
  cut AS (SELECT page_id, r, regexp_extract(r, '^[^/?#]*') AS h FROM rest),
  part AS (SELECT page_id, translate(h, {UPPER}) AS host, regexp_extract(substr(r, length(h) + 1), '^/[^?#]*') AS path FROM cut),
  whole AS (SELECT *, host || chr(10) || path AS url FROM part),
  hit AS (SELECT *, {globs} AS globs_hit FROM whole)
SELECT page_id, host, path, CASE {" ".join(f"WHEN {f} THEN {quoted(n)}" for f, n, _ in fits)} END AS rule,
  CASE {" ".join(f"WHEN {f} THEN {quoted(v)}" for f, _, v in fits)} WHEN globs_hit > 0 THEN 'block' ELSE 'allow' END AS verdict, globs_hit FROM hit"""


JOIN_SQL = f"""WITH RECURSIVE w AS (SELECT doc_id, regexp_extract_all(translate(coalesce(text, ''), {UPPER}), {WORDS}) AS ws FROM documents),
  s AS (SELECT DISTINCT doc_id, array_to_string(CASE WHEN len(ws) < 3 THEN ws ELSE ws[i : i + 2] END, ' ') AS g FROM (SELECT doc_id, ws, unnest(range(1, greatest(len(ws) - 1, 2))) AS i FROM w WHERE len(ws) > 0)),
  n AS (SELECT doc_id, count(*) AS n FROM s GROUP BY doc_id),
  met AS (SELECT x.doc_id AS a, y.doc_id AS b, count(*) AS k FROM s x JOIN s y ON x.g = y.g AND x.doc_id < y.doc_id GROUP BY 1, 2),
  link AS (SELECT a, b FROM met JOIN n p ON p.doc_id = a JOIN n q ON q.doc_id = b WHERE 100 * k >= 90 * (p.n + q.n - k)),
  edge AS (SELECT a, b FROM link UNION ALL SELECT b, a FROM link),
  reach(id, other) AS (SELECT a, b FROM edge UNION SELECT id, b FROM reach JOIN edge ON a = other)
SELECT w.doc_id, coalesce(n, 0)::BIGINT AS n_shingles, least(w.doc_id, coalesce(c, w.doc_id)) AS component_id
FROM w LEFT JOIN n USING (doc_id) LEFT JOIN (SELECT id AS doc_id, min(other) AS c FROM reach GROUP BY id) USING (doc_id)"""

ASSIGN = r"""((?:[pP][aA][sS][sS][wW][oO][rR][dD]|[pP][aA][sS][sS][wW][dD]|[sS][eE][cC][rR][eE][tT]|[tT][oO][kK][eE][nN]|[aA][pP][iI]_?[kK][eE][yY]))["'']?\x20*[:=]\x20*["'']?([A-Za-z0-9+/_.=-]+)"""
SECRET_SQL = f"""SELECT doc_id, len(list_filter(regexp_extract_all(text, '{ASSIGN}', 2), lambda x: length(x) >= 6))::BIGINT AS n_assign,
  len(list_filter(regexp_extract_all(text, 'AKIA[A-Z0-9]+'), lambda x: length(x) >= 20))::BIGINT AS n_access,
  len(list_filter(regexp_extract_all(text, '[0-9a-f]+'), lambda x: length(x) >= 24))::BIGINT AS n_hex FROM (SELECT doc_id, coalesce(text, '') AS text FROM documents)"""

QUALITY_SQL = rf"""WITH d AS (SELECT doc_id, coalesce(text, '') AS text, regexp_extract_all(coalesce(text, ''), {WORDS}) AS ws FROM documents),
  win AS (SELECT doc_id, i, count(*) OVER (PARTITION BY doc_id, ws[i], ws[i + 1], ws[i + 2]) AS c FROM (SELECT doc_id, ws, unnest(range(1, len(ws) - 1)) AS i FROM d)),
  rep AS (SELECT doc_id, count(DISTINCT i + k) AS n FROM win, range(3) t(k) WHERE c > 1 GROUP BY doc_id),
  lines AS (SELECT doc_id, list_filter(string_split(text, chr(10)), lambda x: regexp_matches(x, {WORDS})) AS ls FROM d)
SELECT d.doc_id, len(ws)::BIGINT AS n_words, length(array_to_string(ws, ''))::BIGINT AS word_chars,
  len(regexp_extract_all(text, '[#*$%&|<>]'))::BIGINT AS n_symbols, (len(ls) - len(list_distinct(ls)))::BIGINT AS n_dup_lines,
  coalesce(n, 0)::BIGINT AS n_repeat_words, len(ws) < 50 OR 100 * coalesce(n, 0) > 50 * len(ws) AS base_failed
FROM d JOIN lines USING (doc_id) LEFT JOIN rep USING (doc_id)"""


#: The crc32 of a text's UTF-8 bytes, which the other engine lacks: bit by bit.
CRC_SQL = """xor(4294967295, list_reduce(list_prepend(4294967295::BIGINT, list_transform(regexp_extract_all(hex(encode({0})), '..'), lambda h: ('0x' || h)::BIGINT)),
    lambda c, b: list_reduce(list_prepend(xor(c, b), range(8)), lambda x, k: xor(x >> 1, CASE WHEN x & 1 = 1 THEN 3988292384 ELSE 0 END))))"""

FEATURES_SQL = f"""unnest(list_concat(ws, list_transform(range(1, len(ws)), lambda i: ws[i] || ' ' || ws[i + 1]))) AS f FROM
    (SELECT *, regexp_extract_all(translate(coalesce(text, ''), {UPPER}), '{importance.WORD}') AS ws FROM"""
RESAMPLE_SQL = f"""WITH d AS (SELECT doc_id, text, row_number() OVER () AS r FROM documents),
  df AS (SELECT r, {FEATURES_SQL} d)),
  tf AS (SELECT {FEATURES_SQL} benchmark)),
  b AS (SELECT f, {CRC_SQL.format("f")} % 10000 AS b FROM (SELECT f FROM df UNION SELECT f FROM tf)),
  s AS (SELECT b, count(*) AS n FROM df JOIN b USING (f) GROUP BY b),
  t AS (SELECT b, count(*) AS n FROM tf JOIN b USING (f) GROUP BY b),
  whole AS (SELECT (SELECT coalesce(sum(n), 0) FROM s)::DOUBLE AS s, (SELECT coalesce(sum(n), 0) FROM t)::DOUBLE AS t),
  gain AS (SELECT k.b, floor(1000 * ln((coalesce(t.n, 0) + 1)::DOUBLE * (whole.s + 10000) / ((coalesce(s.n, 0) + 1)::DOUBLE * (whole.t + 10000)))) AS g
    FROM (SELECT unnest(range(10000)) AS b) k LEFT JOIN s USING (b) LEFT JOIN t USING (b), whole),
  w AS (SELECT r, count(*) AS n, floor(sum(g) / count(*))::BIGINT AS w FROM df JOIN b USING (f) JOIN gain USING (b) GROUP BY r),
  scored AS (SELECT doc_id, coalesce(n, 0)::BIGINT AS n_features, coalesce(w, 0)::BIGINT AS weight,
    coalesce(w, 0) + floor(-1000 * ln(-ln((('0x' || substr(sha256('7:' || doc_id), 1, 8))::BIGINT + 0.5::DOUBLE) / 4294967296::DOUBLE)))::BIGINT AS score FROM d LEFT JOIN w USING (r)),
  place AS (SELECT *, row_number() OVER (PARTITION BY n_features >= 39 ORDER BY score DESC, doc_id) AS p FROM scored)
SELECT doc_id, n_features, weight, score, CASE WHEN n_features >= 39 AND p <= (SELECT 25 * count(*) // 100 FROM scored WHERE n_features >= 39) THEN p END AS rank FROM place"""

VARIANTS_SQL = f"""WITH RECURSIVE run AS (SELECT doc_id, unnest(regexp_extract_all(translate(text, {UPPER}), '{spelling.RUN}')) AS r FROM documents),
  once AS (SELECT doc_id, r, count(*) AS k FROM run WHERE length(r) >= 6 GROUP BY ALL),
  hashed AS (SELECT r, k, {CRC_SQL.format("doc_id || ':' || r")} AS h FROM once),
  slip AS (SELECT k, CASE WHEN h % 199 = 0 THEN substr(r, 1, (h % length(r))::INTEGER) || substr(r, (h % length(r))::INTEGER + 2) ELSE r END AS word FROM hashed),
  v AS (SELECT word, sum(k)::BIGINT AS n FROM slip WHERE length(word) >= 6 GROUP BY word HAVING sum(k) >= 5),
  hole AS (SELECT word, n, i, substr(word, 1, i::INTEGER) || substr(word, i::INTEGER + 2) AS rest FROM (SELECT word, n, unnest(range(length(word))) AS i FROM v)),
  near AS (SELECT a.word, a.n, b.word AS near, b.n AS near_n FROM hole a JOIN hole b ON a.i = b.i AND a.rest = b.rest AND a.word <> b.word
    UNION SELECT a.word, a.n, b.word, b.n FROM hole a JOIN v b ON a.rest = b.word
    UNION SELECT b.word, b.n, a.word, a.n FROM hole a JOIN v b ON a.rest = b.word),
  best AS (SELECT word, count(*) AS n_near, first(near ORDER BY near_n DESC, encode(near)) AS near, max(near_n) AS near_n FROM near GROUP BY word),
  f AS (SELECT word, n, coalesce(n_near, 0)::BIGINT AS n_near, CASE WHEN near_n >= 5 * n THEN near END AS form, CASE WHEN near_n >= 5 * n THEN near_n END AS form_n FROM v LEFT JOIN best USING (word)),
  walk(word, top) AS (SELECT word, word FROM f UNION ALL SELECT walk.word, f.form FROM walk JOIN f ON f.word = walk.top WHERE f.form IS NOT NULL)
SELECT f.word, form, top AS root, n, n_near, form_n FROM f JOIN walk ON walk.word = f.word JOIN (SELECT word AS last FROM f WHERE form IS NULL) ON top = last"""


def oracle_sql() -> dict[str, str]:
    return {"op3_url_filter": url_sql(), "op5_jaccard_join": JOIN_SQL, "secret_counts": SECRET_SQL, "quality_counts": QUALITY_SQL, "op11_importance_resample": RESAMPLE_SQL, "op12_spelling_variants": VARIANTS_SQL}
