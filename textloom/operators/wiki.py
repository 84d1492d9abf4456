"""Wikitext to plain text: by one scan with a stack, or as fused native replacements.

``plain_text`` scans a text once over Arrow batches.  Templates, tables and references go
with all they hold, at any depth; comments and tags go; links leave their label, those to
files nothing; addresses in brackets, emphasis and the marks of headings go.  What is never
closed stays as it is written, a reference without its end but for its tag, and takes no
longer: every search that has failed once is not made again.

``regex_clean`` is the single-pass rule in the JVM.  Its patterns run in linear time on
real text, not on text that is nothing but opened markup.  Null stays null, and empty texts
stay empty.
"""

from __future__ import annotations

import re

import pandas as pd
from pyspark.sql import Column
from pyspark.sql import functions as F

from textloom.functions import text as T

#: Markup patterns in their order, with their replacements.
MARKUP = [
    (r"\{\{[^}]+\}\}", ""),
    (r"(?s)<ref[^>]*>.*?</ref>", ""),
    (r"<ref[^/>]*/>", ""),
    (r"<[^>]+>", ""),
    (r"\[\[(?:[^|\]]*\|)?([^\]]+)\]\]", "$1"),
    (r"\[https?://[^\]]+\]", ""),
    (r"\[\[Category:[^\]]+\]\]", ""),
    (r"'{2,5}", ""),
    (rf"(?md)^=+[{T.WS}]*([^=]+)[{T.WS}]*=+$", "$1"),
]
BRACES = re.compile(r"[{}]|[^{}]+")


def without_templates(text: str) -> str:
    """What is left when ``{{...}}`` without braces inside goes, again and again, until there is none."""
    if "{{" not in text:
        return text
    out: list[str] = []
    places: list[int] = []  # of the braces in out
    for part in BRACES.findall(text):
        out.append(part)
        if part == "{" or part == "}":
            places.append(len(out) - 1)
            if part == "}" and len(places) >= 4:
                a, b, c, d = places[-4:]
                if out[a] == out[b] == "{" and out[c] == "}" and b == a + 1 and d == c + 1:
                    del out[a:], places[-4:]
    return "".join(out)


#: What opens or closes something, and what a scan drops by itself.
MARKS = re.compile(r"\{\{|\}\}|^[ \t:]*\{\||\|\}(?!\})|\[\[|\]\]|\||<|\[(?=https?://[^\]])|'{2,5}", re.M)
#: Names of the name space of files in the languages of the corpus.
FILE_LINK = re.compile(r"\s*(?:file|image|media|datei|bild|fichier|archivo|imagen)\s*:", re.I)
CATEGORY_LINK = re.compile(r"Category:")
REFERENCE = re.compile(r"ref(?=[\s/>])", re.I)


class Finder:
    """``str.find`` for places that only move on: a needle that was not found is never sought again."""

    def __init__(self, text: str) -> None:
        self.text, self.none = text, set()

    def after(self, needle: str, at: int) -> int:
        """The place behind the next needle, or -1."""
        if needle in self.none:
            return -1
        found = self.text.find(needle, at)
        if found < 0:
            self.none.add(needle)
            return -1
        return found + len(needle)


def plain_text(text: str, drop_categories: bool = False) -> str:
    """A text without its markup, in linear time."""
    find = Finder(text)
    out: list = []  # strings, and lists of the same for labels, so that none is copied twice
    stack: list[list] = []  # [what is open, its place in out, place of a link's first bar]
    opened = {"{{": 0, "{|": 0, "[[": 0}

    def close(what: str) -> list | None:
        """Leave all that was opened within; the frame of what is closed, if anything is."""
        if not opened[what]:
            return None
        while True:
            frame = stack.pop()
            opened[frame[0]] -= 1
            if frame[0] == what:
                return frame

    at, end = 0, len(text)
    while at < end:
        m = MARKS.search(text, at)
        if not m:
            out.append(text[at:])
            break
        out.append(text[at : m.start()])
        mark, at = m[0], m.end()
        if mark == "<":
            skipped = find.after("-->", at) if text.startswith("!--", at) else -1
            if skipped < 0:
                skipped = find.after(">", at)
                if skipped >= 0 and REFERENCE.match(text, at) and text[skipped - 2] != "/":
                    skipped = max(skipped, find.after("</ref>", skipped))
            if skipped > at + 1:
                at = skipped
            else:
                out.append(mark)
        elif mark == "[":
            skipped = find.after("]", at)
            if skipped >= 0:
                at = skipped
            else:
                out.append(mark)
        elif mark[0] == "'":
            pass
        elif mark == "|":
            if stack and stack[-1][0] == "[[" and stack[-1][2] is None:
                stack[-1][2] = len(out)
            out.append(mark)
        elif mark in ("{{", "[[") or mark.endswith("{|"):
            what = mark[-2:]
            stack.append([what, len(out), None])
            opened[what] += 1
            out.append(mark)
        elif mark == "]]":
            frame = close("[[")
            if frame is None:
                out.append(mark)
                continue
            _, first, bar = frame
            target = next((x for x in out[first + 1 : first + 3] if isinstance(x, str) and x), "")
            label = out[bar + 1 :] if bar is not None and any(out[bar + 1 :]) else out[first + 1 :]
            if not any(label):
                out.append(mark)  # nothing between: no link
                continue
            del out[first:]
            if not FILE_LINK.match(target) and not (drop_categories and CATEGORY_LINK.match(target)):
                out.append(label)
        else:
            frame = close("{{" if mark == "}}" else "{|")
            if frame:
                del out[frame[1] :]
            else:
                out.append(mark)
    flat: list[str] = []
    rest = [iter(out)]
    while rest:
        for x in rest[-1]:
            if isinstance(x, list):
                rest.append(iter(x))
                break
            flat.append(x)
        else:
            rest.pop()
    text = "".join(flat)
    if "=" not in text:
        return text
    return "\n".join(_heading(line) if line[:1] == "=" == line[-1:] else line for line in text.split("\n"))


def _heading(line: str) -> str:
    inside = line.strip("=")
    return (inside.lstrip() or inside[-1:]) if inside and "=" not in inside else line


def scan_markup(c: Column, drop_categories: bool = False) -> Column:
    @F.pandas_udf("string")
    def run(s: pd.Series) -> pd.Series:
        return s.map(lambda t: None if t is None else plain_text(t, drop_categories))

    return run(c)


def strip_nested_templates(c: Column) -> Column:
    @F.pandas_udf("string")
    def run(s: pd.Series) -> pd.Series:
        return s.map(lambda t: None if t is None else without_templates(t))

    return run(c)


def regex_clean(c: Column, drop_categories: bool = False) -> Column:
    """Templates, references, tags, links, emphasis and headings, in this order.

    By default a category link becomes its text, since the link rule comes first;
    ``drop_categories`` removes it before.
    """
    if drop_categories:
        c = F.regexp_replace(c, r"\[\[Category:[^\]]+\]\]", "")
    for pattern, replacement in MARKUP:
        c = F.regexp_replace(c, pattern, replacement)
    return c


def final_clean(c: Column) -> Column:
    """Blank runs, empty parentheses, white space before punctuation, outer white space."""
    c = F.regexp_replace(c, "\n{3,}", "\n\n")
    c = F.regexp_replace(c, "[ \t]+", " ")
    c = F.regexp_replace(c, rf"\([{T.WS}]*\)", "")
    c = F.regexp_replace(c, rf"[{T.WS}]+([.,;:!?])", "$1")
    return T.strip(c)


def remove_markup(c: Column, nested: bool = True, drop_categories: bool = False) -> Column:
    """Plain text by the scan, or with ``nested=False`` by the single-pass rule; then blanks are tidied."""
    return final_clean(scan_markup(c, drop_categories) if nested else regex_clean(c, drop_categories))


def strip_tags(c: Column) -> Column:
    return F.regexp_replace(c, r"<[^>]+>", "")
