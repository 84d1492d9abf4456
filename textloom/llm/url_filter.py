"""URL filters: a bit-parallel wildcard automaton (multiword Shift-And).

Glob rules are packed into 64-bit words, one bit for each symbol a rule consumes.
All rules advance together over each canonical URL, and all URLs of an Arrow batch
advance together, one symbol a step.  ``*`` matches any run, ``?`` any one symbol.

A canonical URL is ``host <bar> path``: the bar is a symbol of its own (code BAR)
that no URL can contain, so a rule's host part never matches inside a path.  In a
rule the bar is written as ``\\n`` (in files ``|``), and ``*`` in a host rule stops there.

Nulls and URLs without ``://`` have an empty host and path and fit no rule of
length 1 or more; repeated rows give repeated results; an empty table gives an
empty result; further columns are ignored; very long URLs are simulated whole.
"""

from __future__ import annotations

from dataclasses import dataclass
from importlib import resources

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from textloom.llm import common

U64 = np.uint64
BAR = 0x110000  # beyond Unicode

#: Host and path rules of the query: (host, path, verdict); a rule fits its host and subdomains.
BASE_RULES = [("net", "/", "block"), ("example.net", "/en/", "allow"), ("example.com", "/de/", "block"), ("org", "/fr/", "allow")]
#: Symbols of all rules together, at most: a bound of the masks and of a batch's states.
MAX_SYMBOLS = 20_000


def parse_globs(lines: list[str | None]) -> list[str]:
    """Rules of a table or file: blank lines and comments (#) don't count; the bar is ``|`` there."""
    found = [x.strip() for x in lines if x and x.strip() and not x.lstrip().startswith("#")]
    if (size := sum(map(len, found))) > MAX_SYMBOLS:
        raise ValueError(f"{size} symbols of globs are more than {MAX_SYMBOLS}")
    return [x.replace("|", "\n") for x in found]


def default_globs() -> list[str]:
    """The package's own rules, which decide where no host rule fits."""
    return parse_globs(resources.files("textloom.llm").joinpath("url_globs.txt").read_text("utf-8").splitlines())


def read_globs(rules: DataFrame, column: str = "value") -> list[str]:
    """Rules from a table, such as a text file that Spark has read; more than MAX_SYMBOLS are an error."""
    return parse_globs([r[0] for r in rules.select(column).where(F.length(column) > 0).limit(MAX_SYMBOLS + 1).collect()])


def canonical(url: str | None) -> tuple[str, str]:
    """(host, path): ASCII letters of the host in lower case."""
    if url is None or (at := url.find("://")) < 0:
        return "", ""
    rest = url[at + 3 :]
    end = min((i for i in map(rest.find, "?#") if i >= 0), default=len(rest))
    slash = rest.find("/", 0, end)
    host, path = (rest[:end], "") if slash < 0 else (rest[:slash], rest[slash:end])
    return host.encode("utf-8", "surrogatepass").translate(common.LOWER).decode("utf-8", "surrogatepass"), path


@dataclass
class Automaton:
    """Masks over ``words`` 64-bit words; rule r ends at bit ``final[r]``."""

    words: int
    symbols: np.ndarray  # sorted symbol codes that rules name
    masks: np.ndarray  # (len(symbols) + 1, words): the last row is for any other symbol
    first_open: np.ndarray  # first bits that may start anywhere (a leading *)
    first_bound: np.ndarray  # first bits that start at the first symbol only
    firsts: np.ndarray
    hold: np.ndarray  # bits followed by *: once set, their successor may fire at any later step
    final: np.ndarray  # bit of each rule's last symbol, -1 for a rule of stars only
    open_end: np.ndarray  # whether a rule ends with *


def compile_globs(globs: list[str]) -> Automaton:
    """Literal text, ``?`` and ``*``; ``\\n`` is the bar.  Consecutive stars count once."""
    parsed = []
    for g in globs:
        codes, star, stars = [], False, []
        for c in g:
            if c == "*":
                star = True
                continue
            codes.append(-1 if c == "?" else BAR if c == "\n" else ord(c))
            stars.append(star)
            star = False
        parsed.append((codes, stars, star))
    total = sum(len(c) for c, _, _ in parsed)
    words = max(1, -(-total // 64))
    symbols = np.array(sorted({c for codes, _, _ in parsed for c in codes if c >= 0}), np.int64)
    masks = np.zeros((len(symbols) + 1, words), U64)
    zero = lambda: np.zeros(words, U64)
    first_open, first_bound, firsts, hold = zero(), zero(), zero(), zero()
    final, open_end, bit = [], [], 0
    for codes, stars, star in parsed:
        for i, (code, before) in enumerate(zip(codes, stars, strict=True)):
            w, b = divmod(bit, 64)
            one = U64(1) << U64(b)
            if code < 0:
                masks[:, w] |= one
            else:
                masks[np.searchsorted(symbols, code), w] |= one
            if i == 0:
                firsts[w] |= one
                (first_open if before else first_bound)[w] |= one
            elif before:
                pw, pb = divmod(bit - 1, 64)
                hold[pw] |= U64(1) << U64(pb)
            bit += 1
        final.append(bit - 1 if codes else -1)
        open_end.append(star)
    return Automaton(words, symbols, masks, first_open, first_bound, firsts, hold, np.array(final, np.int64), np.array(open_end, bool))


def simulate(auto: Automaton, urls: list[np.ndarray]) -> np.ndarray:
    """(len(urls), rules) booleans: which rules match which URLs, each an array of symbol codes."""
    n = len(urls)
    out = np.zeros((n, len(auto.final)), bool)
    if not n:
        return out
    length = np.array([len(u) for u in urls])
    order = np.argsort(-length, kind="stable")  # those still running are always a prefix
    length = length[order]
    flat = np.concatenate([urls[i] for i in order]) if length.sum() else np.empty(0, np.int64)
    starts = np.concatenate([[0], np.cumsum(length)[:-1]])
    slot = np.searchsorted(auto.symbols, flat)
    known = slot < len(auto.symbols)
    known[known] = auto.symbols[slot[known]] == flat[known]
    slot = np.where(known, slot, len(auto.symbols))
    state = np.zeros((n, auto.words), U64)
    held, seen = np.zeros_like(state), np.zeros_like(state)
    running = np.searchsorted(-length, -np.arange(1, (length[0] if n else 0) + 1), side="right")
    one, top = U64(1), U64(63)
    for step, live in enumerate(running):
        source = state[:live] | held[:live]
        moved = source << one
        if auto.words > 1:
            moved[:, 1:] |= source[:, :-1] >> top
        moved &= ~auto.firsts
        moved |= auto.first_open
        if step == 0:
            moved |= auto.first_bound
        now = moved & auto.masks[slot[starts[:live] + step]]
        state[:live] = now
        held[:live] |= now & auto.hold
        seen[:live] |= now
    for r, bit in enumerate(auto.final):
        if bit < 0:
            hit = np.full(n, True) if auto.open_end[r] else length == 0
        else:
            w, b = divmod(int(bit), 64)
            hit = (((seen if auto.open_end[r] else state)[:, w] >> U64(b)) & one).astype(bool)
        out[order, r] = hit
    return out


def symbols_of(host: str, path: str, dotted: bool) -> np.ndarray:
    code = lambda t: np.frombuffer(t.encode("utf-32-le", "surrogatepass"), "<u4").astype(np.int64)
    return np.concatenate([code("." + host if dotted else host), [BAR], code(path)])


def filter_urls(
    pages: DataFrame,
    id_col: str = "page_id",
    url_col: str = "url",
    rules: list[tuple[str, str, str]] = BASE_RULES,
    globs: list[str] | None = None,
) -> DataFrame:
    """(id, host, path, rule, verdict, globs_hit) of every URL.

    The longest fitting host rule decides (of equally long ones the first listed);
    without one, a URL that any glob matches is blocked and others are allowed.
    Host rules are part of the program; globs come from a file or table of checked size.
    """
    # A leading dot makes "*.net" fit both the host and its subdomains, at whole labels.
    host_auto = compile_globs([f"*.{h}\n{p}*" for h, p, _ in rules])
    glob_auto = compile_globs(default_globs() if globs is None else globs)
    size = np.array([len(h) + len(p) for h, p, _ in rules])
    names = [h + p for h, p, _ in rules]
    schema = {"id": pa.int64(), "host": pa.string(), "path": pa.string(), "rule": pa.string(), "verdict": pa.string(), "globs_hit": pa.int32()}

    def run(batch: pa.RecordBatch) -> pa.RecordBatch:
        parts = [canonical(u) for u in batch.column(1).to_pylist()]
        fits = simulate(host_auto, [symbols_of(h, p, True) for h, p in parts])
        hits = simulate(glob_auto, [symbols_of(h, p, False) for h, p in parts]).sum(axis=1)
        best = np.where(fits, size, -1).argmax(axis=1) if len(rules) else np.zeros(len(parts), int)
        some = fits.any(axis=1)
        rule = [names[b] if s else None for b, s in zip(best, some, strict=True)]
        verdict = [rules[b][2] if s else "block" if g else "allow" for b, s, g in zip(best, some, hits, strict=True)]
        return common.rows(schema, id=batch.column(0), host=[h for h, _ in parts], path=[p for _, p in parts], rule=rule, verdict=verdict, globs_hit=hits.astype(np.int32))

    return common.map_batches(common.id_text(pages, id_col, url_col), run, "id long, host string, path string, rule string, verdict string, globs_hit int").withColumnRenamed("id", id_col)


def op3_url_filter(spark: SparkSession, sf_dir: str) -> DataFrame:
    return filter_urls(common.table(spark, sf_dir, "pages"))
