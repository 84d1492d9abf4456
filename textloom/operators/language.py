"""Language identification: by stop words, or by trained profiles of character n-grams.

By stop words: a text's language is the one of which most words are stop words; ties go to
the first in alphabetical order, and a text without any stop word is ``unknown``.

By profiles: letters in lower case, all else as one blank, give runs of 1 to 3 characters,
hashed to BUCKETS.  Their counts in labelled texts make smoothed log likelihoods for each
language, a table of fixed size.  A text's language is the likeliest; its confidence is the
posterior probability on the evidence of EVIDENCE n-grams at most, since neighbours are
not independent.  ``unknown`` are texts of fewer than LEAST_GRAMS n-grams, those below
the confidence asked for, and those that fit no language: their mean log likelihood falls
short of what training texts of that language have by MISFIT deviations and one unit.

Null and empty texts are ``unknown``; repeated rows count as often as they come; whole texts
are read unless a caller cuts them; an empty table gives an empty result, and no rows to
train on a profile under which every text is ``unknown``.
"""

from __future__ import annotations

import re
from collections.abc import Iterator
from dataclasses import dataclass

import numpy as np
import pandas as pd
import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from textloom.functions import text as T

#: Common words that the listed languages do not share.
PROFILES = {
    "de": ["der", "die", "und", "den", "von", "zu", "mit", "sich", "auf", "für", "ist", "im", "dem", "nicht", "ein", "eine", "als", "auch", "werden", "aus", "bei", "nach", "wird", "oder", "einer", "über", "einem", "nur", "wie", "das"],
    "en": ["the", "of", "and", "to", "is", "for", "was", "with", "his", "by", "this", "have", "from", "they", "which", "you", "were", "her", "she", "there", "their", "been", "has", "when", "who", "will", "that", "it", "be", "are"],
    "es": ["el", "los", "las", "del", "con", "una", "su", "lo", "como", "más", "pero", "sus", "este", "ya", "cuando", "muy", "sin", "sobre", "también", "hasta", "hay", "donde", "desde", "por", "para", "y", "al", "esta", "son", "fue"],
    "fr": ["le", "et", "des", "du", "est", "pour", "qui", "dans", "par", "plus", "pas", "au", "sur", "ne", "ce", "il", "sont", "avec", "mais", "elle", "nous", "leur", "aux", "ses", "cette", "ont", "été", "même", "être", "les"],
}
MARKS = r"[\p{P}\p{S}]+"


def let(value: Column, body) -> Column:
    """``body`` of a value that is computed once: a one-element array's element."""
    return F.element_at(F.transform(F.array(value), body), 1)


def stop_words(c: Column) -> Column:
    """The words of a text that are stop words of any language; marks count as blanks."""
    every = sorted({w for stop in PROFILES.values() for w in stop})
    return F.filter(T.words(F.regexp_replace(F.lower(c), MARKS, " ")), lambda w: w.isin(every))


def hits(found: Column) -> dict[str, Column]:
    """Stop words of each language among those found."""

    def among(stop: list[str]) -> Column:
        return F.size(F.filter(found, lambda w: w.isin(stop))).cast("long")

    return {lang: among(stop) for lang, stop in PROFILES.items()}


def detect(c: Column) -> Column:
    def choose(n: Column) -> Column:
        most = F.greatest(*(n[lang] for lang in PROFILES))
        out = F.when(most == 0, F.lit("unknown"))
        for lang in sorted(PROFILES):
            out = out.when(n[lang] == most, F.lit(lang))
        return out

    return let(stop_words(c), lambda found: let(F.struct(*(n.alias(lang) for lang, n in hits(found).items())), choose))


# ---------------------------------------------------------------- trained profiles

BUCKETS, ORDERS, SMOOTHING = 1 << 16, (1, 2, 3), 0.5
EVIDENCE, LEAST_GRAMS, MISFIT, MIN_CONFIDENCE = 32, 12, 6.0, 0.9
MAX_LANGUAGES = 256
OTHER = re.compile(r"[\W\d_]+")
_MIX = np.array([0x9E3779B1, 0x85EBCA77, 0xC2B2AE3D], np.uint64)


def grams(text: str | None) -> np.ndarray:
    """Buckets of all n-grams of a text."""
    letters = OTHER.sub(" ", f" {text or ''} ".lower())
    if not letters.strip():
        return np.empty(0, np.int64)
    codes = np.frombuffer(letters.encode("utf-32-le", "surrogatepass"), "<u4").astype(np.uint64)
    out = []
    for n in ORDERS:
        h = np.full(max(0, len(codes) - n + 1), n, np.uint64)
        for k in range(n):
            h = (h + codes[k : k + len(h)] * _MIX[k]) * np.uint64(0x9E3779B97F4A7C15)
            h ^= h >> np.uint64(29)
        out.append((h % np.uint64(BUCKETS)).astype(np.int64))
    return np.concatenate(out)


@dataclass
class Profiles:
    """Log likelihood of each bucket by language, and the usual mean and deviation of an n-gram's."""

    languages: list[str]
    weights: np.ndarray  # buckets x languages
    usual: np.ndarray  # languages
    spread: np.ndarray

    def judge(self, text: str | None, min_confidence: float = MIN_CONFIDENCE) -> tuple[str, float]:
        """(language or unknown, confidence)."""
        found = grams(text)
        if len(found) < LEAST_GRAMS or not self.languages:
            return "unknown", 0.0
        mean = self.weights[found].mean(axis=0)
        odds = np.exp((mean - mean.max()) * min(len(found), EVIDENCE))
        best = int(mean.argmax())
        confidence = float(odds[best] / odds.sum())
        short = self.usual[best] - mean[best]
        misfit = short > 1.0 and short > MISFIT * self.spread[best] / np.sqrt(len(found))
        return self.languages[best] if confidence >= min_confidence and not misfit else "unknown", confidence


def train_profiles(df: DataFrame, text_col: str = "text", lang_col: str = "lang") -> Profiles:
    """Learn from all labelled texts; only counts by bucket come to the driver."""
    labelled = df.select(F.col(lang_col).cast("string").alias("lang"), F.col(text_col).cast("string").alias("text")).where("lang is not null and text is not null")
    languages = sorted(r["lang"] for r in labelled.select("lang").distinct().limit(MAX_LANGUAGES + 1).collect())
    if len(languages) > MAX_LANGUAGES:
        raise ValueError(f"more than {MAX_LANGUAGES} languages")
    place = {lang: i for i, lang in enumerate(languages)}

    def count(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        found: dict[str, np.ndarray] = {}
        for batch in batches:
            for lang, text in zip(batch.column(0).to_pylist(), batch.column(1).to_pylist(), strict=True):
                into = found.setdefault(lang, np.zeros(BUCKETS, np.int64))
                into += np.bincount(grams(text), minlength=BUCKETS)
        for lang, n in found.items():
            some = np.flatnonzero(n)
            yield pa.RecordBatch.from_pydict({"lang": pa.array([lang] * len(some), pa.string()), "bucket": pa.array(some, pa.int32()), "n": pa.array(n[some], pa.int64())})

    table = labelled.mapInArrow(count, "lang string, bucket int, n long").groupBy("lang", "bucket").agg(F.sum("n").alias("n")).toArrow()
    counts = np.zeros((BUCKETS, len(languages)))
    counts[np.asarray(table["bucket"]), [place[x] for x in table["lang"].to_pylist()]] = np.asarray(table["n"])
    total = counts.sum(axis=0)
    # A bucket that no language has is no evidence; the same smoothing for all keeps it so.
    weights = np.log(counts + SMOOTHING) - np.log(total + SMOOTHING * BUCKETS)
    share = counts / np.maximum(total, 1)
    usual = (share * weights).sum(axis=0)
    spread = np.sqrt((share * (weights - usual) ** 2).sum(axis=0))
    return Profiles(languages, weights.astype(np.float32), usual, spread)


def identify(c: Column, profiles: Profiles, min_confidence: float = MIN_CONFIDENCE) -> Column:
    """struct<lang, confidence> of a text by trained profiles, which are shipped with the function (their size is fixed)."""

    @F.pandas_udf("lang string, confidence double")
    def run(s: pd.Series) -> pd.DataFrame:
        return pd.DataFrame([profiles.judge(t, min_confidence) for t in s], columns=["lang", "confidence"])

    return run(c)
