import re
import time
import unicodedata

import pytest
from hypothesis import HealthCheck, given, settings
from hypothesis import strategies as st
from pyspark.sql import functions as F

from textloom.functions import text as T
from textloom.operators import clean, language, quality, wiki


def texts(spark, *values):
    return spark.createDataFrame([(i, v) for i, v in enumerate(values)], "i int, text string")


def cleaned(spark, text, **options):
    row = clean.with_cleaned(texts(spark, text), cfg=clean.CleanConfig(**options)).first()
    return row["cleaned"], row["stats"]


def reason(spark, text, **options):
    return quality.with_quality(texts(spark, text), cfg=quality.QualityConfig(**options)).first()["quality"]


def test_blanks_are_squeezed(spark):
    assert cleaned(spark, "This  is   a    test\n\n\n\n with blanks ", min_length_chars=5)[0] == "This is a test\n\n with blanks"


def test_urls_and_mail_go_and_are_counted(spark):
    text, stats = cleaned(spark, "See https://example.com/a?b=%20c for more, or write to me@example.com today.", min_length_chars=5)
    assert "http" not in text and "@" not in text
    assert (stats["urls_removed"], stats["emails_removed"]) == (1, 1)


def test_what_is_not_there_is_not_sought(spark):
    """The expression for addresses tries every part of such a run up to its end."""
    run = "a." * 100_000
    cleaned(spark, "short enough")
    start = time.monotonic()
    text, stats = cleaned(spark, run, min_length_chars=1)
    assert time.monotonic() - start < 10 and text == run and stats["emails_removed"] == 0
    rows = clean.with_cleaned(texts(spark, None, "x@y", "me@example.com"), cfg=clean.CleanConfig(min_length_chars=1)).orderBy("i").collect()
    assert [(r["cleaned"], r["stats"]["urls_removed"], r["stats"]["emails_removed"]) for r in rows] == [(None, None, None), ("x@y", 0, 0), (None, 0, 1)]


def test_quotes_ligatures_and_tabs_are_replaced_alone_and_in_runs(spark):
    odd = "".join(map(chr, [*clean.QUOTES, *clean.LIGATURES]))
    assert clean.repair("\u00e9 " + odd) == "\u00e9 " + odd.translate(clean.LIGATURES).translate(clean.QUOTES)
    assert cleaned(spark, "a\tb \tc\t\td  e f", min_length_chars=1)[0] == "a b c d e f"


def test_a_very_long_url_is_no_trouble(spark):
    text, stats = cleaned(spark, "a http://" + "x" * 20000 + " b", min_length_chars=1)
    assert text == "a b" and stats["urls_removed"] == 1


def test_short_texts_are_null_with_stats(spark):
    text, stats = cleaned(spark, "Short text.")
    assert text is None and stats["original_length"] == 11


def test_control_characters_leave_no_space(spark):
    assert cleaned(spark, "a\x0bb\x85c\td", min_length_chars=1, fix_encoding=False, normalize_unicode=False)[0] == "abc d"


def test_mis_decoded_text_is_repaired(spark):
    bad = "It’s déjà vu".encode().decode("cp1252")
    text, stats = cleaned(spark, bad, min_length_chars=1)
    assert text == "It's déjà vu" and stats["encoding_fixes"] == 1


def test_null_text_gives_null(spark):
    assert cleaned(spark, None)[0] is None


def rule(text):
    """The cleaning rules once more, one text at a time."""
    ws = "".join(chr(c) for c in range(0x3001) if chr(c).isspace())
    text = re.sub(r"https?://(?:[-\w.]|%[\da-fA-F]{2})[/\w\-.~:?#\[\]@!$&'()*+,;=%]*", " ", text)
    text = re.sub(r"\b[A-Za-z0-9._%+-]+@[A-Za-z0-9.-]+\.[A-Z|a-z]{2,}\b", " ", text)
    text = re.sub(r"\[\d+\]|\[citation needed\]|\[note \d+\]", "", text, flags=re.I)
    text = "".join(c for c in text if unicodedata.category(c) != "Cc" or c in "\n\t")
    return re.sub(r"\n{3,}", "\n\n", re.sub(r"[ \t]+", " ", text)).strip(ws)


@settings(max_examples=6, deadline=None, suppress_health_check=[HealthCheck.function_scoped_fixture])
@given(st.lists(st.text(st.sampled_from("aé[]19 \n\t@.:/htps\x01\xa0x"), max_size=30), min_size=30, max_size=60))
def test_cleaning_equals_the_rule(spark, values):
    values += ["x http://a.b/c y", "[Note 3] a@b.cd", "a\n\n\n\nb"]
    cfg = clean.CleanConfig(fix_encoding=False, normalize_unicode=False, min_length_chars=0)
    got = {r["i"]: r["cleaned"] for r in clean.with_cleaned(texts(spark, *values), cfg=cfg).collect()}
    assert [got[i] for i in range(len(values))] == [rule(v) for v in values]


def test_reduction_ratio_of_an_empty_text_is_zero(spark):
    df = clean.with_cleaned(texts(spark, ""), cfg=clean.CleanConfig(min_length_chars=0))
    assert df.select(clean.reduction_ratio(F.col("stats"))).first()[0] == 0.0
    assert clean.survivors(df).count() == 0


GOOD = "The quick brown fox jumps over the lazy dog, and this is what it was for in the end of the story. " * 5


@pytest.mark.parametrize(
    "text, options, want",
    [
        ("too few words", {}, "too_short"),
        ("word " * 100, {"max_words": 50}, "too_long"),
        ("a b " * 50, {}, "short_avg_word_length"),
        ("abcdefghijklmnopqrstuv " * 60, {}, "long_avg_word_length"),
        ("12345 67890 " * 40, {}, "low_alpha_ratio"),
        ("12345 abcde " * 40, {"min_alpha_ratio": 0.1}, "high_digit_ratio"),
        ("##### abcde " * 40, {"min_alpha_ratio": 0.1}, "high_symbol_ratio"),
        ("This line is here again.\n" * 20, {}, "high_repetition"),
        ("\n".join(f"- item number {w} in a list of things" for w in ("one", "two", "three", "four", "five", "six", "seven", "eight", "nine")), {"min_words": 5}, "mostly_bullet_list"),
        (GOOD + "All rights reserved. Privacy policy. Cookie policy. Click here to go.", {}, "boilerplate_content"),
        (GOOD, {"allowed_languages": ("de",)}, "wrong_language"),
        (GOOD, {"allowed_languages": ("en",)}, "passed"),
        (None, {}, "too_short"),
        ("", {"min_words": 0}, "passed"),
    ],
)
def test_first_failing_rule_is_the_reason(spark, text, options, want):
    q = reason(spark, text, **options)
    assert q["reason"] == want and q["passed"] == (want == "passed")


def test_scores_after_the_failing_rule_are_null(spark):
    s = reason(spark, "12345 67890 " * 40)["scores"]
    assert s["word_count"] == 80 and s["alpha_ratio"] == 0.0 and s["repetition_ratio"] is None and s["boilerplate_matches"] is None


def test_stats_list_all_reasons(spark):
    got = {r["reason"]: r["n"] for r in quality.quality_stats(quality.with_quality(texts(spark, GOOD, "x"))).collect()}
    assert set(got) == set(quality.REASONS) and got["passed"] == 1 and got["too_short"] == 1 and sum(got.values()) == 2


def test_clean_then_filter(spark):
    df = clean.survivors(clean.with_cleaned(texts(spark, "Short", GOOD, GOOD + " https://example.com " * 3)))
    assert quality.filter_quality(df, "cleaned").count() == 2


def test_languages(spark):
    df = texts(spark, "the cat and the dog", "der Hund und die Katze", "le chien et les chats", "el perro y los gatos", "xyz", "")
    assert [r[0] for r in df.orderBy("i").select(language.detect(F.col("text"))).collect()] == ["en", "de", "fr", "es", "unknown", "unknown"]


@settings(max_examples=5, deadline=None, suppress_health_check=[HealthCheck.function_scoped_fixture])
@given(st.lists(st.text(st.sampled_from("ab1! \n\t\xa0 é\x1c"), max_size=20), min_size=30, max_size=50))
def test_counts_equal_python(spark, values):
    c = F.col("text")
    rows = texts(spark, *values).select("text", T.word_count(c), F.size(T.words(c)), T.spaces(c), T.letters(c), T.digits(c), T.strip(c)).collect()
    for t, n, n2, spaces, letters, digits, stripped in rows:
        assert (n, n2, stripped) == (len(t.split()), len(t.split()), t.strip())
        assert (spaces, letters, digits) == tuple(sum(map(f, t)) for f in (str.isspace, str.isalpha, str.isdigit))


def test_markup(spark):
    raw = "== Head ==\n{{a|{{b}}}}'''Bold''' [[X|label]] [[Y]] [http://z z] <ref name=q>gone</ref><b>t</b> ( ) end .\n\n\n\nlast"
    got = texts(spark, raw).select(wiki.remove_markup(F.col("text"))).first()[0]
    # A heading keeps the blank before its end, and blanks left by parentheses stay two.
    assert got == "Head \nBold label Y t  end.\n\nlast"


def test_quantiles_equal_the_gathered_ones(spark, monkeypatch):
    """Few bins make many rounds; ties, outliers, negative and huge values, nulls and empty columns."""
    import random

    from textloom.operators import explore

    rng = random.Random(4)
    cases = {
        "ties": [rng.randrange(5) for _ in range(400)], "wide": [rng.choice([-1e300, -3.5, 0.0, 7.25, 1e300, 1.7e308, -1.7e308]) for _ in range(400)],
        "skewed": [1.0] * 390 + [10.0**k for k in range(10)], "one": [4.5] + [None] * 399, "two": [1.0, 2.0] + [None] * 398, "none": [None] * 400, "normal": [rng.gauss(0, 1) for _ in range(400)],
    }
    df = spark.createDataFrame([tuple(None if v is None else float(v) for v in row) for row in zip(*cases.values())], ", ".join(f"{c} double" for c in cases)).repartition(3)
    ps = [0.0, 0.1, 0.25, 0.5, 0.75, 0.999, 1.0]
    want = df.agg(*(F.percentile(c, ps).alias(c) for c in cases)).first()
    for bins in (2, 7, 1024):
        monkeypatch.setattr(explore, "BINS", bins)
        got = explore.quantiles(df, {c: ps for c in cases})
        for c in cases:
            assert got[c] == ([None] * len(ps) if want[c] is None else [pytest.approx(x) for x in want[c]]), c
    empty = explore.describe(df.limit(0), ["ties"]).first()
    assert empty["count"] == 0 and empty["p50"] is None and empty["metric"] == "ties"
    assert explore.describe(df, ["ties"]).first()["p50"] == explore.describe(df, ["ties"], accuracy=10_000).first()["p50"]
