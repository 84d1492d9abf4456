"""Ordered quality rules: the first that fails names the reason.

Scores after the failing rule stay null, as a reader that stops there would leave
them.  All expressions are native; ``with_quality`` adds one struct column.

A null text counts as empty, and an empty one has no words and fails first; what is exactly at
a limit passes; repeated rows are judged alike; whole texts are read (but for the language,
where ``language_chars`` says so); an empty table gives an empty result; columns beyond those
named are carried along.
"""

from __future__ import annotations

import functools
import operator
from dataclasses import dataclass

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from textloom.functions import text as T
from textloom.operators.language import detect, let

#: Reasons in the order of the rules, and phrases of boilerplate.
REASONS = ["too_short", "too_long", "short_avg_word_length", "long_avg_word_length", "low_alpha_ratio", "high_digit_ratio", "high_symbol_ratio", "high_repetition", "mostly_bullet_list", "boilerplate_content", "wrong_language", "passed"]
PHRASES = ["copyright", "all rights reserved", "terms of service", "privacy policy", "cookie policy", "subscribe to our newsletter", "click here to", "share on facebook", "follow us on twitter"]
BOILERPLATE = "(?iu)" + "|".join(p + r" \p{Nd}{4}" * (p == "copyright") for p in PHRASES)
BULLET = rf"^[{T.WS}]*[-•*►▪▸][{T.WS}]"
#: The same within a whole text: no white space around the mark may leave its line.
IN_LINE = T.WS.replace(r"\t-\r", r"\t\x0b-\r")
BULLET_LINE = rf"(?:^|(?<=\n))[{IN_LINE}]*[-•*►▪▸][{IN_LINE}]"


@dataclass(frozen=True)
class QualityConfig:
    min_words: int = 50
    max_words: int = 100_000
    min_avg_word_length: float = 3.0
    max_avg_word_length: float = 15.0
    min_alpha_ratio: float = 0.7
    max_digit_ratio: float = 0.3
    max_symbol_ratio: float = 0.2
    max_repetition_ratio: float = 0.3
    max_bullet_ratio: float = 0.5
    max_boilerplate: int = 3
    check_boilerplate: bool = True
    allowed_languages: tuple[str, ...] | None = None
    #: Characters the language rule looks at (None: the whole text).
    language_chars: int | None = 1000


def repetition_count(c: Column) -> Column:
    """Occurrences of the commonest non-blank line, compared without outer white space.

    Sorted lines put equal ones side by side, so one fold finds the longest run.
    """
    kept = F.sort_array(F.filter(F.transform(T.lines(c), T.strip), lambda x: x != ""))
    start = F.struct(F.lit("").alias("last"), F.lit(0).alias("run"), F.lit(0).alias("best"))

    def step(acc, x):
        run = F.when(x == acc["last"], acc["run"] + 1).otherwise(F.lit(1))
        return F.struct(x.alias("last"), run.alias("run"), F.greatest(acc["best"], run).alias("best"))

    return F.aggregate(kept, start, step, lambda acc: acc["best"]).cast("long")


def boilerplate_count(c: Column) -> Column:
    """Matches of the phrases; the expression runs only where a phrase's text occurs."""
    there = let(F.replace(F.lower(c), F.lit("\u017f"), F.lit("s")), lambda t: functools.reduce(operator.or_, (F.contains(t, F.lit(p)) for p in PHRASES)))
    return F.when(there, F.regexp_count(c, F.lit(BOILERPLATE))).otherwise(F.lit(0)).cast("long")


def base_counts(c: Column) -> dict[str, Column]:
    """The passes over a text; everything else is arithmetic on these."""
    return {
        "words": T.word_count(c),
        "total": F.length(c).cast("long"),
        "space": T.spaces(c),
        "alpha": T.letters(c),
        "digit": T.digits(c),
        "lines": F.regexp_count(c, F.lit("\n")).cast("long") + 1,
        "repeats": F.when(F.instr(c, "\n") > 0, repetition_count(c)).otherwise(F.lit(0)).cast("long"),
        "bullets": F.regexp_count(c, F.lit(BULLET_LINE)).cast("long"),
        "phrases": boilerplate_count(c),
    }


def derived(b: dict[str, Column]) -> dict[str, Column]:
    solid = b["total"] - b["space"]
    return {
        "word_count": b["words"],
        "avg_word_length": T.ratio(solid, b["words"]),
        "alpha_ratio": T.ratio(b["alpha"], solid),
        "digit_ratio": T.ratio(b["digit"], solid),
        "symbol_ratio": T.ratio(solid - b["alpha"] - b["digit"], solid),
        "repetition_ratio": F.when((b["lines"] > 1) & (solid > 0), b["repeats"].cast("double") / b["lines"]),
        "bullet_ratio": b["bullets"].cast("double") / b["lines"],
        "boilerplate_matches": b["phrases"],
    }


def measures(c: Column) -> dict[str, Column]:
    """All counts and ratios of a text, each by itself."""
    return derived(base_counts(c))


def with_quality(df: DataFrame, text_col: str = "text", cfg: QualityConfig = QualityConfig(), out: str = "quality") -> DataFrame:
    """Add ``quality: struct<passed, reason, scores>``; a null text counts as empty."""
    c = F.coalesce(F.col(text_col), F.lit(""))
    base = base_counts(c)
    if cfg.allowed_languages:
        look = c if cfg.language_chars is None else F.substring(c, 1, cfg.language_chars)
        base["language"] = detect(look)
    # Flat columns that are used more than once stay a projection of their own, so each
    # pass over the text is made once.
    staged = df.select("*", *(x.alias(f"__{k}") for k, x in base.items()))
    m = derived({k: F.col(f"__{k}") for k in base})
    if cfg.allowed_languages:
        m["detected_language"] = F.col("__language")
    v = m.__getitem__
    no = F.lit(False)
    rules: list[tuple[str, Column, list[str]]] = [
        ("too_short", v("word_count") < cfg.min_words, ["word_count"]),
        ("too_long", v("word_count") > cfg.max_words, []),
        ("short_avg_word_length", v("avg_word_length") < cfg.min_avg_word_length, ["avg_word_length"]),
        ("long_avg_word_length", v("avg_word_length") > cfg.max_avg_word_length, []),
        ("low_alpha_ratio", v("alpha_ratio") < cfg.min_alpha_ratio, ["alpha_ratio", "digit_ratio", "symbol_ratio"]),
        ("high_digit_ratio", v("digit_ratio") > cfg.max_digit_ratio, []),
        ("high_symbol_ratio", v("symbol_ratio") > cfg.max_symbol_ratio, []),
        ("high_repetition", v("repetition_ratio") > cfg.max_repetition_ratio, ["repetition_ratio"]),
        ("mostly_bullet_list", v("bullet_ratio") > cfg.max_bullet_ratio, ["bullet_ratio"]),
        ("boilerplate_content", (v("boilerplate_matches") > cfg.max_boilerplate) if cfg.check_boilerplate else no, ["boilerplate_matches"] if cfg.check_boilerplate else []),
        ("wrong_language", ~v("detected_language").isin("unknown", *cfg.allowed_languages) if cfg.allowed_languages else no, ["detected_language"] if cfg.allowed_languages else []),
    ]
    failing, reached = None, {}
    for i, (name, failed, scores) in enumerate(rules):
        for s in scores:
            reached[s] = i
        failing = F.when(failed, F.lit(i)) if failing is None else failing.when(failed, F.lit(i))
    staged = staged.withColumn("__k", failing.otherwise(F.lit(len(rules))))
    every = ["word_count", "avg_word_length", "alpha_ratio", "digit_ratio", "symbol_ratio", "repetition_ratio", "bullet_ratio", "boilerplate_matches", "detected_language"]
    kinds = {"word_count": "long", "boilerplate_matches": "long", "detected_language": "string"}
    scores = [(F.when(F.col("__k") >= reached[s], v(s)) if s in reached else F.lit(None)).cast(kinds.get(s, "double")).alias(s) for s in every]
    reason = F.element_at(F.array(*map(F.lit, REASONS)), F.col("__k") + 1)
    struct = F.struct((F.col("__k") == len(rules)).alias("passed"), reason.alias("reason"), F.struct(*scores).alias("scores"))
    return staged.withColumn(out, struct).drop("__k", *(f"__{k}" for k in base))


def filter_quality(df: DataFrame, text_col: str = "text", cfg: QualityConfig = QualityConfig()) -> DataFrame:
    """The rows that pass every rule."""
    judged = with_quality(df, text_col, cfg, "__q")
    # A condition on the row position keeps the filter above the counts; pushed
    # below, it would make every pass over the text again for every rule.
    return judged.withColumn("__at", F.monotonically_increasing_id()).where("__q.passed and __at >= 0").drop("__q", "__at")


def quality_stats(judged: DataFrame, col: str = "quality") -> DataFrame:
    """(reason, n) for all reasons, those that never occurred too."""
    spark = judged.sparkSession
    every = spark.createDataFrame([(r, i) for i, r in enumerate(REASONS)], "reason string, rank int")
    counts = judged.groupBy(F.col(f"{col}.reason").alias("reason")).agg(F.count("*").alias("n"))
    return every.join(counts, "reason", "left").select("reason", "rank", F.coalesce("n", F.lit(0)).cast("long").alias("n"))


def describe_result(q: Column) -> Column:
    """``PASSED`` or ``FILTERED: <reason>``."""
    return F.when(q["passed"], F.lit("PASSED")).otherwise(F.concat(F.lit("FILTERED: "), q["reason"]))
