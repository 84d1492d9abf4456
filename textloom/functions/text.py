"""Column expressions for text, with the same meaning on every engine.

Lengths count code points.  White space is the set that Python's ``str.isspace``
accepts, spelled out, because engines disagree on ``\\s``; letters are ``\\p{L}`` and
digits ``\\p{Nd}``.  Everything here stays in the JVM.
"""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F

#: White space, patterns for URLs, mail addresses, citations, control characters.
WS = r"\t-\r\x1c-\x1f \x85\x{A0}\x{1680}\x{2000}-\x{200A}\x{2028}\x{2029}\x{202F}\x{205F}\x{3000}"
#: The same set for Java alone, as two tests a character instead of a dozen.
JAVA_WS = r"\s\x1c-\x1f"
URL = r"(?U)https?://(?:[-\w.]|%[\da-fA-F]{2})[/\w\-.~:?#\[\]@!$&'()*+,;=%]*"
EMAIL = r"(?U)\b[A-Za-z0-9._%+-]+@[A-Za-z0-9.-]+\.[A-Z|a-z]{2,}\b"
CITATION = r"(?iuU)\[\d+\]|\[citation needed\]|\[note \d+\]"
CONTROL = r"[\x00-\x08\x0B-\x1F\x7F-\x9F]"
GPT2 = r"(?U)('s|'t|'re|'ve|'m|'ll|'d| ?\p{L}+| ?\p{N}+| ?[^\s\p{L}\p{N}]+|\s+(?!\S)|\s+)"
WORDPIECE = r"(?U)(\w+|[^\w\s]+)"


def strip(c: Column) -> Column:
    """Without white space at both ends (``trim`` knows spaces only)."""
    return F.regexp_replace(F.regexp_replace(c, f"(?U)^[{JAVA_WS}]+", ""), f"(?Ud)[{JAVA_WS}]+$", "")


def words(c: Column) -> Column:
    """White-space separated words; none for an empty or blank text."""
    return F.filter(F.split(c, f"(?U)[{JAVA_WS}]+"), lambda w: w != "")


def word_count(c: Column) -> Column:
    """Words, counted as stretches without white space: cheaper than splitting."""
    return F.regexp_count(c, F.lit(f"(?U)[^{JAVA_WS}]+")).cast("long")


def count_class(c: Column, cls: str) -> Column:
    """Characters of a class: what is lost when all others are removed."""
    return F.length(F.regexp_replace(c, f"[^{cls}]+", "")).cast("long")


def letters(c: Column) -> Column:
    return count_class(c, r"\p{L}")


def digits(c: Column) -> Column:
    return count_class(c, r"\p{Nd}")


def spaces(c: Column) -> Column:
    return F.length(F.regexp_replace(c, f"(?U)[^{JAVA_WS}]+", "")).cast("long")


def lines(c: Column) -> Column:
    return F.split(c, "\n", -1)


def ratio(a: Column, b: Column) -> Column:
    """a / b as a double; null where b is 0."""
    return F.when(b != 0, a.cast("double") / b.cast("double"))


def char_shingles(c: Column, k: int = 5) -> Column:
    """Distinct k-character windows of the lower-cased text with white space runs as one space."""
    normal = F.regexp_replace(F.lower(c), f"(?U)[{JAVA_WS}]+", " ")
    return F.array_distinct(F.regexp_extract_all(normal, F.lit(f"(?s)(?=(.{{{k}}}))"), 1))


def pretokens(c: Column, pattern: str = GPT2) -> Column:
    return F.regexp_extract_all(c, F.lit(pattern), 1)
