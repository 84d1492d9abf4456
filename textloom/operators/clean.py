"""Cleaning: an ordered chain of replacements with counts of what it removed.

Repairing encodings and NFKC need Python (one Arrow pass for both, texts in ASCII
returned as they are unless they hold entities or carriage returns); the rest is
native.

A null text stays null with null counts; an empty or blank one is too short and becomes null;
repeated rows are cleaned alike; whole texts are read, however long; an empty table gives an
empty result; columns beyond those named are carried along.
"""

from __future__ import annotations

import html
import re
import unicodedata
from dataclasses import dataclass
from functools import lru_cache

import pandas as pd
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from textloom.functions import text as T
from textloom.operators.language import let


@dataclass(frozen=True)
class CleanConfig:
    remove_urls: bool = True
    remove_emails: bool = True
    remove_citations: bool = True
    normalize_unicode: bool = True
    fix_encoding: bool = True
    normalize_whitespace: bool = True
    min_length_chars: int = 100


#: Replacements of the encoding repair beside mis-decoded UTF-8.
QUOTES = {0x2018: "'", 0x2019: "'", 0x201A: "'", 0x201B: "'", 0x201C: '"', 0x201D: '"', 0x201E: '"', 0x201F: '"', 0x02BC: "'"}
LIGATURES = {0xFB00: "ff", 0xFB01: "fi", 0xFB02: "fl", 0xFB03: "ffi", 0xFB04: "ffl", 0xFB05: "st", 0xFB06: "st", 0x0132: "IJ", 0x0133: "ij"}
#: One search for both: ``str.translate`` takes far longer where nothing is to be replaced.
REPLACED = {chr(c): t for table in (LIGATURES, QUOTES) for c, t in table.items()}
_REPLACED = re.compile(f"[{''.join(REPLACED)}]")
_MOJIBAKE = re.compile("[\xc2-\xf4][\x80-\xbf\u20ac\u201a\u0192\u201e\u2026\u2020\u2021\u02c6\u2030\u0160\u2039\u0152\u017d\u2018\u2019\u201c\u201d\u2022\u2013\u2014\u02dc\u2122\u0161\u203a\u0153\u017e\u0178]+")
_FOREIGN = re.compile("[^\x00-\x7f]+")
#: What capitals and marks that stand together by chance would be read as.
_PHONETIC = re.compile("[\u0250-\u02af]")
_BESIDE = re.compile("[\x00-\x7f]?[^\x00-\x7f]+[\x00-\x7f]?")
#: Encodings that UTF-8 is taken for, the commonest first, and how often one after another.
ENCODINGS = ("cp1252", "latin-1", "cp1251", "cp1250", "iso8859-2", "mac-roman", "cp437", "cp850", "koi8-r", "cp1253", "cp1254", "cp1257")
STEPS = 4
#: Characters beyond ASCII that must agree before one of the rarer encodings is believed, unless marks are among them.
LEAST_FOREIGN = 4


@lru_cache(maxsize=len(ENCODINGS))
def byte_of(encoding: str) -> dict[str, int]:
    """The byte of each character beyond ASCII; where the encoding has a hole, Latin-1 fills it."""
    out = {}
    for b in range(0x80, 0x100):
        try:
            out[bytes([b]).decode(encoding)] = b
        except UnicodeDecodeError:
            out.setdefault(chr(b), b)
    return out


def undone(run: str, encoding: str) -> str | None:
    """The text that was UTF-8 before it was read in an encoding; None if it was not, or is phonetic signs."""
    table = byte_of(encoding)
    try:
        back = bytes([table[c] for c in run]).decode("utf-8")
    except (KeyError, UnicodeDecodeError):
        return None
    return None if _PHONETIC.search(back) else back


def implausible(text: str) -> int:
    """Neighbours that seldom meet: a capital after a small letter, a symbol or control after a letter, letters of two alphabets, a combining mark on what it makes no letter with."""
    n = 0
    for m in _BESIDE.finditer(text):
        for a, b in zip(m[0], m[0][1:]):
            if "\u0300" <= b <= "\u036f":
                n += len(unicodedata.normalize("NFC", a + b)) > 1
            elif a.isalpha():
                kind = unicodedata.category(b)
                n += a.islower() and b.isupper() or kind in ("Sm", "Sk", "So", "Cc") or kind[0] == "L" and (a < "\u0370") != (b < "\u0370")
    return n


def misread(text: str) -> str | None:
    """The text before one misreading that explains every character beyond ASCII; None if none does.

    Of several the one whose text has the fewest implausible pairs, then the commonest.
    """
    runs = list(dict.fromkeys(_FOREIGN.findall(text)))
    found = []
    for encoding in ENCODINGS if runs else ():
        fixed = {}
        for run in runs:
            if (back := undone(run, encoding)) is None:
                break
            fixed[run] = back
        else:
            sure = encoding in ENCODINGS[:2] or sum(map(len, runs)) >= LEAST_FOREIGN or any(unicodedata.category(c)[0] not in "LM" for run in runs for c in run)
            if sure:
                found.append(_FOREIGN.sub(lambda m: fixed[m[0]], text))
    return min(found, key=implausible) if len(set(found)) > 1 else found[0] if found else None


def repair(text: str | None) -> str | None:
    """UTF-8 that was read in another encoding, entities, quotes, ligatures, widths, line ends, NFC.

    A chain of up to STEPS misreadings is undone step by step: one that explains the whole
    text, else those stretches that Windows-1252 or Latin-1 explain.
    """
    if text is None:
        return None
    if "&" in text and "<" not in text:
        text = html.unescape(text)
    for _ in range(0 if text.isascii() else STEPS):
        new = misread(text)
        if new is None:
            new = _MOJIBAKE.sub(lambda m: undone(m[0], "cp1252") or undone(m[0], "latin-1") or m[0], text)
        if new == text:
            break
        text = new
    if not text.isascii():
        text = "".join(bytes([ord(c)]).decode("cp1252", "ignore") or c if 0x80 <= ord(c) <= 0x9F and c != "\x85" else c for c in text) if re.search("[\x80-\x9f]", text) else text
        text = _REPLACED.sub(lambda m: REPLACED[m[0]], text)
        text = "".join(unicodedata.normalize("NFKC", c) if 0xFF01 <= ord(c) <= 0xFFEF or c == "\u3000" else c for c in text) if re.search("[\uff01-\uffef\u3000]", text) else text
        text = re.sub("[\ud800-\udfff]", "\ufffd", text)
    text = text.replace("\r\n", "\n").replace("\r", "\n")
    text = re.sub("[\u2028\u2029\x85]", "\n", text)
    return unicodedata.normalize("NFC", text)


def prepared(c: Column, cfg: CleanConfig) -> Column:
    """struct<text, fixed>: the text after the two Python steps, and whether the repair changed it."""
    fix, nfkc = cfg.fix_encoding, cfg.normalize_unicode

    @F.pandas_udf("text string, fixed int")
    def run(s: pd.Series) -> pd.DataFrame:
        repaired = s.map(repair) if fix else s
        fixed = [int(a is not None and a != b) for a, b in zip(s, repaired, strict=True)]
        done = repaired.map(lambda t: t if t is None or t.isascii() else unicodedata.normalize("NFKC", t)) if nfkc else repaired
        return pd.DataFrame({"text": done, "fixed": fixed})

    return run(c)


def remove_urls(c: Column) -> Column:
    return F.regexp_replace(c, T.URL, " ")


def remove_emails(c: Column) -> Column:
    return F.regexp_replace(c, T.EMAIL, " ")


def remove_citations(c: Column) -> Column:
    return F.regexp_replace(c, T.CITATION, "")


def remove_control(c: Column) -> Column:
    """Without control characters other than newline and tab; nothing takes their place."""
    return F.regexp_replace(c, T.CONTROL, "")


def squeeze(c: Column) -> Column:
    """Runs of blanks as one space, three newlines or more as two, no outer white space."""
    return T.strip(F.regexp_replace(F.regexp_replace(c, "[ \t]{2,}|\t", " "), "\n{3,}", "\n\n"))


def with_cleaned(df: DataFrame, text_col: str = "text", cfg: CleanConfig = CleanConfig(), out: str = "cleaned", stats: str = "stats") -> DataFrame:
    """Add the cleaned text (null where too short) and a struct of six counts.

    A null text stays null with null counts.
    """
    work = df.withColumn("__o", F.col(text_col))
    if cfg.fix_encoding or cfg.normalize_unicode:
        work = work.withColumn("__p", prepared(F.col(text_col), cfg)).withColumn("__t", F.col("__p.text")).withColumn("__f", F.col("__p.fixed")).drop("__p")
    else:
        work = work.withColumn("__t", F.col(text_col)).withColumn("__f", F.lit(0))
    zero = F.lit(0)
    work = work.withColumn("__u", F.regexp_count("__t", F.lit(T.URL)) if cfg.remove_urls else zero)
    if cfg.remove_urls:
        work = work.withColumn("__t", F.when(F.col("__u") > 0, remove_urls(F.col("__t"))).otherwise(F.col("__t")))
    # The expression tries every word; few texts have an address. A null text has a null count.
    work = work.withColumn("__e", F.when(~F.contains("__t", F.lit("@")), zero).otherwise(F.regexp_count("__t", F.lit(T.EMAIL))) if cfg.remove_emails else zero)
    t = F.col("__t")
    if cfg.remove_emails:
        t = F.when(F.col("__e") > 0, remove_emails(t)).otherwise(t)
    if cfg.remove_citations:
        t = remove_citations(t)
    t = remove_control(t)
    if cfg.normalize_whitespace:
        t = squeeze(t)
    work = work.withColumn("__t", t).withColumn("__n", F.length("__t"))
    counts = F.struct(
        F.length("__o").alias("original_length"),
        F.col("__n").alias("cleaned_length"),
        (F.length("__o") - F.col("__n")).alias("chars_removed"),
        F.col("__f").cast("int").alias("encoding_fixes"),
        F.col("__u").cast("int").alias("urls_removed"),
        F.col("__e").cast("int").alias("emails_removed"),
    )
    work = work.withColumn(stats, counts).withColumn(out, F.when(F.col("__n") >= cfg.min_length_chars, F.col("__t")))
    return work.drop("__o", "__t", "__f", "__u", "__e", "__n")


def clean_col(c: Column, cfg: CleanConfig = CleanConfig()) -> Column:
    """The cleaned text alone (null where too short), for one column and without counts."""
    t = prepared(c, cfg)["text"] if cfg.fix_encoding or cfg.normalize_unicode else c
    for wanted, rule in ((cfg.remove_urls, remove_urls), (cfg.remove_emails, remove_emails), (cfg.remove_citations, remove_citations), (True, remove_control), (cfg.normalize_whitespace, squeeze)):
        t = rule(t) if wanted else t
    return let(t, lambda x: F.when(F.length(x) >= cfg.min_length_chars, x))


def reduction_ratio(stats: Column) -> Column:
    """Removed characters in percent of the original; 0 for an empty original."""
    return F.coalesce(T.ratio(stats["chars_removed"] * 100, stats["original_length"]), F.lit(0.0))


def survivors(cleaned: DataFrame, out: str = "cleaned") -> DataFrame:
    return cleaned.where(F.col(out).isNotNull() & (F.col(out) != ""))
