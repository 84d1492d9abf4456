"""Queries over ``documents`` and ``pages``: lengths, quality, language, cleaning, markup."""

from __future__ import annotations

from pyspark.sql import functions as F

from textloom.functions import text as T
from textloom.operators import clean, explore, language, quality, wiki
from textloom.operators.storage import small_splits, spread
from textloom.plans.catalogue import register

#: The same character classes in the oracle's dialect.
WS = T.WS
QUOTED = lambda values: ", ".join("'" + v + "'" for v in values)


def docs(spark, sf_dir):
    small_splits(spark)
    return spread(spark.read.parquet(f"{sf_dir}/documents.parquet"))


def pages(spark, sf_dir):
    small_splits(spark)
    return spread(spark.read.parquet(f"{sf_dir}/pages.parquet"))


@register("doc_lengths", "SELECT doc_id, length(text)::BIGINT AS text_length, strlen(text)::BIGINT AS text_bytes FROM documents")
def doc_lengths(spark, sf_dir):
    return docs(spark, sf_dir).select("doc_id", F.length("text").cast("long").alias("text_length"), F.octet_length("text").cast("long").alias("text_bytes"))


def sql_count(text: str, cls: str) -> str:
    return f"length(regexp_replace({text}, '[^{cls}]+', '', 'g'))"


def measured(source: str, text: str, keep: str) -> str:
    """SQL for all counts of a text expression."""
    lines = f"string_split({text}, chr(10))"
    return f"""
    counts AS (
      SELECT {keep}, {text} AS t,
        len(regexp_extract_all({text}, '[^{WS}]+'))::BIGINT AS word_count, length({text})::BIGINT AS n,
        {sql_count(text, WS)} AS n_space, {sql_count(text, r'\p{L}')} AS n_alpha, {sql_count(text, r'\p{Nd}')} AS n_digit,
        len({lines}) AS n_lines,
        list_transform({lines}, lambda x: regexp_replace(regexp_replace(x, '^[{WS}]+', ''), '[{WS}]+$', '')) AS ls,
        len(list_filter({lines}, lambda x: regexp_matches(x, '{quality.BULLET}'))) AS n_bullet,
        len(regexp_extract_all({text}, '{quality.BOILERPLATE.replace("(?iu)", "(?i)")}'))::BIGINT AS boilerplate_matches
      FROM {source}),
    rep AS (
      SELECT doc_id, max(c) AS top FROM (
        SELECT doc_id, line, count(*) AS c FROM (SELECT doc_id, unnest(ls) AS line FROM counts) WHERE line <> '' GROUP BY ALL) GROUP BY doc_id),
    measures AS (
      SELECT counts.*, (n - n_space) AS solid,
        (n - n_space)::DOUBLE / nullif(word_count, 0) AS avg_word_length,
        n_alpha::DOUBLE / nullif(n - n_space, 0) AS alpha_ratio, n_digit::DOUBLE / nullif(n - n_space, 0) AS digit_ratio,
        (n - n_space - n_alpha - n_digit)::DOUBLE / nullif(n - n_space, 0) AS symbol_ratio,
        CASE WHEN n_lines > 1 THEN top::DOUBLE / n_lines END AS repetition_ratio, n_bullet::DOUBLE / n_lines AS bullet_ratio
      FROM counts LEFT JOIN rep USING (doc_id)),
    judged AS (
      SELECT *, CASE
        WHEN word_count < 50 THEN 'too_short' WHEN word_count > 100000 THEN 'too_long'
        WHEN avg_word_length < 3.0::DOUBLE THEN 'short_avg_word_length' WHEN avg_word_length > 15.0::DOUBLE THEN 'long_avg_word_length'
        WHEN alpha_ratio < 0.7::DOUBLE THEN 'low_alpha_ratio' WHEN digit_ratio > 0.3::DOUBLE THEN 'high_digit_ratio' WHEN symbol_ratio > 0.2::DOUBLE THEN 'high_symbol_ratio'
        WHEN repetition_ratio > 0.3::DOUBLE THEN 'high_repetition' WHEN bullet_ratio > 0.5::DOUBLE THEN 'mostly_bullet_list'
        WHEN boilerplate_matches > 3 THEN 'boilerplate_content' ELSE 'passed' END AS reason
      FROM measures)"""


DOC_MEASURES = measured("documents", "text", "doc_id, lang, source")
#: Content that the corpus lacks, joined to every text.
BULLETS = "concat(text, repeat('\\n- item\\n* item', 40), '\\nCopyright 2024, All Rights Reserved. Privacy policy; terms of service')"
BULLETS_SQL = "concat(text, repeat(chr(10) || '- item' || chr(10) || '* item', 40), chr(10) || 'Copyright 2024, All Rights Reserved. Privacy policy; terms of service')"


@register("word_stats", f"WITH {DOC_MEASURES} SELECT doc_id, word_count, round(avg_word_length, 9) AS avg_word_length FROM measures")
def word_stats(spark, sf_dir):
    m = quality.measures(F.col("text"))
    return docs(spark, sf_dir).select("doc_id", m["word_count"].alias("word_count"), F.round(m["avg_word_length"], 9).alias("avg_word_length"))


@register("char_ratios", f"WITH {DOC_MEASURES} SELECT doc_id, round(alpha_ratio, 9) AS alpha_ratio, round(digit_ratio, 9) AS digit_ratio, round(symbol_ratio, 9) AS symbol_ratio FROM measures")
def char_ratios(spark, sf_dir):
    m = quality.measures(F.col("text"))
    return docs(spark, sf_dir).select("doc_id", *(F.round(m[k], 9).alias(k) for k in ("alpha_ratio", "digit_ratio", "symbol_ratio")))


@register("line_repetition", f"WITH {DOC_MEASURES} SELECT doc_id, round(repetition_ratio, 9) AS repetition_ratio FROM measures")
def line_repetition(spark, sf_dir):
    return docs(spark, sf_dir).select("doc_id", F.round(quality.measures(F.col("text"))["repetition_ratio"], 9).alias("repetition_ratio"))


@register("bullet_boilerplate", f"WITH {measured('documents', BULLETS_SQL, 'doc_id')} SELECT doc_id, round(bullet_ratio, 9) AS bullet_ratio, boilerplate_matches, reason FROM judged")
def bullet_boilerplate(spark, sf_dir):
    d = docs(spark, sf_dir).withColumn("text", F.expr(BULLETS))
    m = quality.measures(F.col("text"))
    judged = quality.with_quality(d)
    return judged.select("doc_id", F.round(m["bullet_ratio"], 9).alias("bullet_ratio"), m["boilerplate_matches"].alias("boilerplate_matches"), F.col("quality.reason").alias("reason"))


@register("quality_reasons", f"WITH {DOC_MEASURES} SELECT reason, count(*) AS n FROM judged GROUP BY reason")
def quality_reasons(spark, sf_dir):
    return quality.with_quality(docs(spark, sf_dir)).groupBy(F.col("quality.reason").alias("reason")).agg(F.count("*").alias("n"))


@register("quality_scores", f"""WITH {DOC_MEASURES}, k AS (SELECT *, list_position([{QUOTED(quality.REASONS)}], reason) - 1 AS k FROM judged)
    SELECT doc_id, reason, reason = 'passed' AS passed, word_count,
      CASE WHEN k >= 2 THEN round(avg_word_length, 9) END AS avg_word_length, CASE WHEN k >= 4 THEN round(alpha_ratio, 9) END AS alpha_ratio,
      CASE WHEN k >= 7 THEN round(repetition_ratio, 9) END AS repetition_ratio, CASE WHEN k >= 8 THEN round(bullet_ratio, 9) END AS bullet_ratio,
      CASE WHEN k >= 9 THEN boilerplate_matches END AS boilerplate_matches,
      CASE WHEN reason = 'passed' THEN 'PASSED' ELSE 'FILTERED: ' || reason END AS said FROM k""")
def quality_scores(spark, sf_dir):
    q = quality.with_quality(docs(spark, sf_dir))
    s = lambda k: F.round(f"quality.scores.{k}", 9).alias(k)
    return q.select(
        "doc_id", F.col("quality.reason").alias("reason"), F.col("quality.passed").alias("passed"), F.col("quality.scores.word_count").alias("word_count"), s("avg_word_length"), s("alpha_ratio"), s("repetition_ratio"), s("bullet_ratio"),
        F.col("quality.scores.boilerplate_matches").alias("boilerplate_matches"), quality.describe_result(F.col("quality")).alias("said"),
    )


@register("quality_filter_stats", f"WITH {DOC_MEASURES}, every AS (SELECT unnest([{QUOTED(quality.REASONS)}]) AS reason) SELECT every.reason, count(doc_id)::BIGINT AS n FROM every LEFT JOIN judged USING (reason) GROUP BY every.reason")
def quality_filter_stats(spark, sf_dir):
    return quality.quality_stats(quality.with_quality(docs(spark, sf_dir))).select("reason", "n")


@register("quality_passed_docs", f"WITH {DOC_MEASURES} SELECT doc_id, md5(t) AS text_md5 FROM judged WHERE reason = 'passed'")
def quality_passed_docs(spark, sf_dir):
    return quality.filter_quality(docs(spark, sf_dir)).select("doc_id", F.md5("text").alias("text_md5"))


@register("quality_vs_labels", f"WITH {DOC_MEASURES} SELECT reason, quality AS label, count(*) AS n FROM judged JOIN labels USING (doc_id) GROUP BY ALL")
def quality_vs_labels(spark, sf_dir):
    labels = spark.read.parquet(f"{sf_dir}/labels.parquet").select("doc_id", F.col("quality").alias("label"))
    return quality.with_quality(docs(spark, sf_dir)).join(labels, "doc_id").groupBy(F.col("quality.reason").alias("reason"), "label").agg(F.count("*").alias("n"))


def _hits(lang: str) -> str:
    return f"len(list_filter(w, lambda x: list_contains([{QUOTED(language.PROFILES[lang])}], x)))"


LANG_SQL = f"""WITH words AS (
    SELECT doc_id, lang, regexp_extract_all(regexp_replace(lower(text), '[\\p{{P}}\\p{{S}}]+', ' ', 'g'), '[^{WS}]+') AS w FROM documents),
  hits AS (SELECT doc_id, lang, {", ".join(f"{_hits(k)} AS {k}" for k in language.PROFILES)} FROM words),
  found AS (SELECT doc_id, lang, CASE greatest(de, en, es, fr) WHEN 0 THEN 'unknown' WHEN de THEN 'de' WHEN en THEN 'en' WHEN es THEN 'es' ELSE 'fr' END AS detected FROM hits)"""


@register("lang_detect", f"{LANG_SQL} SELECT doc_id, detected FROM found")
def lang_detect(spark, sf_dir):
    return docs(spark, sf_dir).select("doc_id", language.detect(F.col("text")).alias("detected"))


@register("lang_confusion", f"{LANG_SQL} SELECT lang, detected, count(*) AS n FROM found GROUP BY ALL")
def lang_confusion(spark, sf_dir):
    return docs(spark, sf_dir).groupBy("lang", language.detect(F.col("text")).alias("detected")).agg(F.count("*").alias("n"))


@register("quality_language_filter", f"""WITH {DOC_MEASURES}, {LANG_SQL[5:]}
    SELECT CASE WHEN reason = 'passed' AND detected NOT IN ('en', 'de', 'unknown') THEN 'wrong_language' ELSE reason END AS reason, count(*) AS n FROM judged JOIN found USING (doc_id) GROUP BY 1""")
def quality_language_filter(spark, sf_dir):
    cfg = quality.QualityConfig(allowed_languages=("en", "de"), language_chars=None)
    return quality.with_quality(docs(spark, sf_dir), cfg=cfg).groupBy(F.col("quality.reason").alias("reason")).agg(F.count("*").alias("n"))


#: Noise for the cleaning rules: address, mail, citations, control characters, blanks.
NOISY = "concat('  ', text, ' see https://x.example/a', doc_id, '?q=%41#z and mail u', doc_id, '@mail.example.org\\t\\t now [', doc_id % 9, '] [Citation Needed] [note 3]', chr(7), 'bell', chr(127), '\\n\\n\\n\\n end \\n ')"
NOISY_SQL = "concat('  ', text, ' see https://x.example/a', doc_id, '?q=%41#z and mail u', doc_id, '@mail.example.org' || chr(9) || chr(9) || ' now [', doc_id % 9, '] [Citation Needed] [note 3]', chr(7), 'bell', chr(127), repeat(chr(10), 4) || ' end ' || chr(10) || ' ')"
#: The URL rule on text whose addresses are ASCII, for an engine whose \\w is ASCII.
URL_SQL = r"https?://(?:[-\w.]|%[\da-fA-F]{2})[/\w\-.~:?#\[\]@!$&''()*+,;=%]*"
EMAIL_SQL = r"\b[A-Za-z0-9._%+-]+@[A-Za-z0-9.-]+\.[A-Z|a-z]{2,}\b"
CITATION_SQL = r"(?i)\[\d+\]|\[citation needed\]|\[note \d+\]"


def noisy(spark, sf_dir):
    return docs(spark, sf_dir).withColumn("text", F.expr(NOISY))


@register("clean_urls", f"WITH x AS (SELECT doc_id, {NOISY_SQL} AS t FROM documents) SELECT doc_id, len(regexp_extract_all(t, '{URL_SQL}'))::BIGINT AS n, md5(regexp_replace(t, '{URL_SQL}', ' ', 'g')) AS text_md5 FROM x")
def clean_urls(spark, sf_dir):
    return noisy(spark, sf_dir).select("doc_id", F.regexp_count("text", F.lit(T.URL)).cast("long").alias("n"), F.md5(clean.remove_urls(F.col("text"))).alias("text_md5"))


@register("clean_emails", f"WITH x AS (SELECT doc_id, {NOISY_SQL} AS t FROM documents) SELECT doc_id, len(regexp_extract_all(t, '{EMAIL_SQL}'))::BIGINT AS n, md5(regexp_replace(t, '{EMAIL_SQL}', ' ', 'g')) AS text_md5 FROM x")
def clean_emails(spark, sf_dir):
    return noisy(spark, sf_dir).select("doc_id", F.regexp_count("text", F.lit(T.EMAIL)).cast("long").alias("n"), F.md5(clean.remove_emails(F.col("text"))).alias("text_md5"))


@register("clean_citations", f"SELECT doc_id, md5(regexp_replace({NOISY_SQL}, '{CITATION_SQL}', '', 'g')) AS text_md5 FROM documents")
def clean_citations(spark, sf_dir):
    return noisy(spark, sf_dir).select("doc_id", F.md5(clean.remove_citations(F.col("text"))).alias("text_md5"))


@register("clean_ctrl", f"SELECT doc_id, md5(regexp_replace({NOISY_SQL}, '[\\x00-\\x08\\x0B-\\x1F\\x7F-\\x{{9F}}]', '', 'g')) AS text_md5 FROM documents")
def clean_ctrl(spark, sf_dir):
    return noisy(spark, sf_dir).select("doc_id", F.md5(clean.remove_control(F.col("text"))).alias("text_md5"))


def squeeze_sql(t: str) -> str:
    return f"regexp_replace(regexp_replace(regexp_replace(regexp_replace({t}, '[ \\t]+', ' ', 'g'), '\\n{{3,}}', chr(10) || chr(10), 'g'), '^[{WS}]+', ''), '[{WS}]+$', '')"


@register("clean_ws", f"SELECT doc_id, md5({squeeze_sql(NOISY_SQL)}) AS text_md5 FROM documents")
def clean_ws(spark, sf_dir):
    return noisy(spark, sf_dir).select("doc_id", F.md5(clean.squeeze(F.col("text"))).alias("text_md5"))


@register("clean_full_stats", f"""WITH a AS (SELECT doc_id, {NOISY_SQL} AS o FROM documents), b AS (SELECT *, regexp_replace(o, '{URL_SQL}', ' ', 'g') AS t1 FROM a), c AS (SELECT *, regexp_replace(t1, '{EMAIL_SQL}', ' ', 'g') AS t2 FROM b),
    d AS (SELECT *, {squeeze_sql(f"regexp_replace(regexp_replace(t2, '{CITATION_SQL}', '', 'g'), '[\\x00-\\x08\\x0B-\\x1F\\x7F-\\x{{9F}}]', '', 'g')")} AS t3 FROM c)
    SELECT doc_id, length(o)::BIGINT AS original_length, length(t3)::BIGINT AS cleaned_length, (length(o) - length(t3))::BIGINT AS chars_removed,
      len(regexp_extract_all(o, '{URL_SQL}'))::BIGINT AS urls_removed, len(regexp_extract_all(t1, '{EMAIL_SQL}'))::BIGINT AS emails_removed,
      CASE WHEN length(t3) >= 200 THEN md5(t3) END AS text_md5, round((length(o) - length(t3))::DOUBLE * 100 / length(o), 6) AS reduction_ratio FROM d""")
def clean_full_stats(spark, sf_dir):
    cfg = clean.CleanConfig(fix_encoding=False, normalize_unicode=False, min_length_chars=200)
    c = clean.with_cleaned(noisy(spark, sf_dir), cfg=cfg)
    names = ["original_length", "cleaned_length", "chars_removed", "urls_removed", "emails_removed"]
    return c.select("doc_id", *(F.col(f"stats.{n}").cast("long").alias(n) for n in names), F.md5("cleaned").alias("text_md5"), F.round(clean.reduction_ratio(F.col("stats")), 6).alias("reduction_ratio"))


def cleaned_sql(t: str, least: int = 100) -> str:
    """The cleaning chain after the two steps that need Unicode tables."""
    t = f"regexp_replace(regexp_replace({t}, '{URL_SQL}', ' ', 'g'), '{EMAIL_SQL}', ' ', 'g')"
    t = squeeze_sql(f"regexp_replace(regexp_replace({t}, '{CITATION_SQL}', '', 'g'), '[\\x00-\\x08\\x0B-\\x1F\\x7F-\\x{{9F}}]', '', 'g')")
    return f"CASE WHEN length({t}) >= {least} THEN md5({t}) END"


#: The corpus holds Latin letters only, for which composition is all that NFKC does; the appended ones are known.
@register("clean_nfkc", f"WITH x AS (SELECT doc_id, nfc_normalize(text) || ' fine 1 A' AS t FROM documents) SELECT doc_id, {cleaned_sql('t')} AS text_md5 FROM x")
def clean_nfkc(spark, sf_dir):
    d = docs(spark, sf_dir).withColumn("text", F.concat("text", F.lit(" ﬁne ① Ａ")))
    return clean.with_cleaned(d, cfg=clean.CleanConfig(fix_encoding=False)).select("doc_id", F.md5("cleaned").alias("text_md5"))


@register("fix_mojibake", f"SELECT doc_id, (strlen(text) > length(text))::INTEGER AS encoding_fixes, {cleaned_sql('nfc_normalize(text)')} AS text_md5 FROM documents")
def fix_mojibake(spark, sf_dir):
    d = docs(spark, sf_dir).withColumn("text", F.decode(F.encode("text", "UTF-8"), "ISO-8859-1"))
    return clean.with_cleaned(d).select("doc_id", F.col("stats.encoding_fixes").alias("encoding_fixes"), F.md5("cleaned").alias("text_md5"))


@register("strip_html_pages", "SELECT page_id, md5(regexp_replace(html, '<[^>]+>', '', 'g')) AS text_md5, length(regexp_replace(html, '<[^>]+>', '', 'g'))::BIGINT AS n_chars FROM pages")
def strip_html_pages(spark, sf_dir):
    t = wiki.strip_tags(F.col("html"))
    return pages(spark, sf_dir).select("page_id", F.md5(t).alias("text_md5"), F.length(t).cast("long").alias("n_chars"))


MARKED = "concat('== Head ', doc_id, ' ==\\n{{box|a=1}} \\'\\'\\'B\\'\\'\\' [[Target|label ', doc_id, ']] [[Plain]] [http://x.example gone] <ref name=a>cite</ref>x<ref name=b/> <b>bold</b> [[Category:Things]] ( ) end .\\n\\n\\n\\n', text)"
MARKED_SQL = "concat('== Head ', doc_id, ' ==' || chr(10) || '{{box|a=1}} ''''''B'''''' [[Target|label ', doc_id, ']] [[Plain]] [http://x.example gone] <ref name=a>cite</ref>x<ref name=b/> <b>bold</b> [[Category:Things]] ( ) end .' || repeat(chr(10), 4), text)"


def markup_sql(t: str) -> str:
    for pattern, replacement in wiki.MARKUP:
        pattern = pattern.replace("(?md)", "(?m)").replace("'", "''")
        t = f"regexp_replace({t}, '{pattern}', '{replacement.replace('$', chr(92))}', 'g')"
    return t


def final_sql(t: str) -> str:
    t = f"regexp_replace(regexp_replace({t}, '\\n{{3,}}', chr(10) || chr(10), 'g'), '[ \\t]+', ' ', 'g')"
    t = f"regexp_replace(regexp_replace({t}, '\\([{WS}]*\\)', '', 'g'), '[{WS}]+([.,;:!?])', '\\1', 'g')"
    return f"regexp_replace(regexp_replace({t}, '^[{WS}]+', ''), '[{WS}]+$', '')"


@register("wiki_regex_clean", f"SELECT doc_id, md5({markup_sql(MARKED_SQL)}) AS text_md5 FROM documents")
def wiki_regex_clean(spark, sf_dir):
    return docs(spark, sf_dir).select("doc_id", F.md5(wiki.regex_clean(F.expr(MARKED))).alias("text_md5"))


@register("wiki_final_clean", f"SELECT doc_id, md5({final_sql(markup_sql(MARKED_SQL))}) AS text_md5 FROM documents")
def wiki_final_clean(spark, sf_dir):
    return docs(spark, sf_dir).select("doc_id", F.md5(wiki.remove_markup(F.expr(MARKED), nested=False)).alias("text_md5"))


HIST_SQL = """WITH l AS (SELECT length(text)::DOUBLE AS x FROM documents), e AS (SELECT min(x) AS lo, max(x) AS hi FROM l),
    b AS (SELECT CASE WHEN hi = lo THEN 0 ELSE least(floor((x - lo) / ((hi - lo) / 50)), 49) END::BIGINT AS bin FROM l, e)
    SELECT r.range AS bin, round(lo + r.range * (hi - lo) / 50, 6) AS low, round(lo + (r.range + 1) * (hi - lo) / 50, 6) AS high, count(b.bin)::BIGINT AS n FROM range(50) r CROSS JOIN e LEFT JOIN b ON b.bin = r.range GROUP BY ALL"""


@register("length_histogram", HIST_SQL)
def length_histogram(spark, sf_dir):
    h = explore.histogram(explore.with_lengths(docs(spark, sf_dir)), "text_length")
    return h.select("bin", F.round("low", 6).alias("low"), F.round("high", 6).alias("high"), "n")


def _describe(metric: str, x: str) -> str:
    return f"SELECT '{metric}' AS metric, count({x}) AS count, round(avg({x}), 6) AS mean, round(stddev_samp({x}), 6) AS std, min({x})::DOUBLE AS min, quantile_cont({x}, 0.25)::DOUBLE AS p25, quantile_cont({x}, 0.5)::DOUBLE AS p50, quantile_cont({x}, 0.75)::DOUBLE AS p75, max({x})::DOUBLE AS max FROM l"


@register("describe_lengths", f"WITH l AS (SELECT length(text)::DOUBLE AS a, len(regexp_extract_all(text, '[^{WS}]+'))::DOUBLE AS b FROM documents) {_describe('text_length', 'a')} UNION ALL {_describe('word_count', 'b')}")
def describe_lengths(spark, sf_dir):
    d = explore.describe(explore.with_lengths(docs(spark, sf_dir)), ["text_length", "word_count"])
    return d.withColumn("mean", F.round("mean", 6)).withColumn("std", F.round("std", 6))


@register("compression_ratio", f"SELECT doc_id, round(length(text)::DOUBLE / nullif(len(regexp_extract_all(text, '[\\p{{L}}\\p{{N}}_]+|[^\\p{{L}}\\p{{N}}_{WS}]+')), 0), 9) AS compression_ratio FROM documents")
def compression_ratio(spark, sf_dir):
    d = explore.with_lengths(docs(spark, sf_dir)).withColumn("token_count", F.size(T.pretokens(F.col("text"), T.WORDPIECE)))
    return explore.compression(d).select("doc_id", F.round("compression_ratio", 9).alias("compression_ratio"))


@register("sample_docs", "SELECT doc_id, lang FROM documents ORDER BY md5('42-' || doc_id), doc_id LIMIT 3")
def sample_docs(spark, sf_dir):
    return explore.sample(docs(spark, sf_dir).select("doc_id", "lang"), 3)


TOKENS_SQL = f"len(regexp_extract_all(text, '[\\p{{L}}\\p{{M}}\\p{{N}}_]+|[^\\p{{L}}\\p{{M}}\\p{{N}}_{WS}]+'))"


def explored(spark, sf_dir):
    d = explore.with_lengths(docs(spark, sf_dir)).withColumn("token_count", F.size(T.pretokens(F.col("text"), T.WORDPIECE)).cast("long"))
    return explore.compression(d)


@register("describe_all", f"WITH l AS (SELECT length(text)::DOUBLE AS a, len(regexp_extract_all(text, '[^{WS}]+'))::DOUBLE AS b, {TOKENS_SQL}::DOUBLE AS c FROM documents) {_describe('text_length', 'a')} UNION ALL {_describe('word_count', 'b')} UNION ALL {_describe('token_count', 'c')}")
def describe_all(spark, sf_dir):
    """The three columns of the exploration."""
    d = explore.describe(explored(spark, sf_dir), ["text_length", "word_count", "token_count"])
    return d.withColumns({c: F.round(c, 6) for c in ("mean", "std")})


@register("ratio_histogram", HIST_SQL.replace("length(text)::DOUBLE AS x FROM documents", f"length(text)::DOUBLE / nullif({TOKENS_SQL}, 0) AS x FROM documents").replace("FROM l, e)", "FROM l, e WHERE x IS NOT NULL)"))
def ratio_histogram(spark, sf_dir):
    h = explore.histogram(explored(spark, sf_dir), "compression_ratio")
    return h.select("bin", F.round("low", 6).alias("low"), F.round("high", 6).alias("high"), "n")


@register("clean_column", f"SELECT doc_id, {cleaned_sql(NOISY_SQL)} AS text_md5 FROM documents")
def clean_column(spark, sf_dir):
    cfg = clean.CleanConfig(fix_encoding=False, normalize_unicode=False)
    return noisy(spark, sf_dir).select("doc_id", F.md5(clean.clean_col(F.col("text"), cfg)).alias("text_md5"))
