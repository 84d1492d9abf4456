"""Vocabularies trained on the cluster: merges for BPE and WordPiece, a unigram model.

Pieces (distinct strings with counts) stay in a table.  What comes to the driver is bounded
by parameters, not by the pieces.

Merges.  Training takes the commonest pair of neighbours again and again, which is
sequential, but only its order matters, and a round proves a long stretch of that order.
It looks at the ``active`` commonest pairs of the table.  A merge among them touches only
the segments of a word in which all neighbours are active; equal segments add up, and their
distinct ones, SYMBOLS symbols at most, are all that the driver needs: inside them the
sequential loop counts every active pair exactly, and it goes on until the best pair comes
after the last active one (by count, then ids).  A pair that is not active comes later still:
its count only falls, a new pair is no commoner than the pair it grew from, and on equal
counts its new id comes last.  (Where a merge makes a token that is there already, an old
pair's count may rise; the round ends with it.)  Then the words take the round's merges and
the next round begins; if the segments are too many it takes fewer pairs.  When all words
together have SYMBOLS symbols at most, they are the last round.

Unigram.  Candidates are the substrings with the greatest frequency times length.  Each
round of expectation maximisation broadcasts their scores (a bounded table), adds up
expected counts piece by piece and by token, and drops the quarter of tokens whose
removal costs the least likelihood.

Null and empty pieces have no symbols; an empty table gives the special tokens alone.
"""

from __future__ import annotations

import heapq
import math
from collections import defaultdict
from collections.abc import Callable, Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from textloom.operators.storage import remove, shared_dir, store

#: Symbols of segments or words that the driver takes at once; pairs a round looks at, at first and at most.
SYMBOLS, ACTIVE_FIRST, ACTIVE_MOST = 1_000_000, 64, 65_536
#: Symbols of a word beyond which merges are queued instead of sought in whole arrays.
LONG_WORD = 256
#: Unigram training: longest token, and candidate tokens kept for each one of the vocabulary
#: (the likeliest by frequency times length; at least SEED_LEAST).  Parameters of the method.
SEED_LENGTH, SEEDS_PER_TOKEN, SEED_LEAST = 16, 4, 1000
#: Characters of a piece whose probability is surely within range.
SHORT_PIECE = 24
#: Part of the tokens that stay in a round, and passes of expectation maximisation in it.
SHRINK, PASSES = 0.75, 2

Pair = tuple[str, str]


# ---------------------------------------------------------------- merges on the driver


def merge_loop(words: list[tuple[list[str], int]], vocab: dict[str, int], size: int, least: int, join: Callable[[str, str], str], bound: tuple[int, int, int] | None = None) -> list[Pair]:
    """Merge the most frequent pair until the vocabulary is full or no pair is frequent enough.

    Ties go to the pair with the smaller ids.  Counts change only around a merge, and
    a heap with stale entries finds the next pair.  With a ``bound`` (minus count, ids) the
    loop ends before the first pair beyond it, and after a merge that makes a known token.
    """
    counts: dict[Pair, int] = defaultdict(int)
    where: dict[Pair, set[int]] = defaultdict(set)
    for i, (parts, n) in enumerate(words):
        for p in zip(parts, parts[1:]):
            counts[p] += n
            where[p].add(i)
    entry = lambda p: (-counts[p], vocab[p[0]], vocab[p[1]], p)
    heap = [entry(p) for p in counts]
    heapq.heapify(heap)
    merges = []
    while heap and len(vocab) < size:
        top = heapq.heappop(heap)
        pair = top[3]
        if -top[0] != counts[pair]:
            if counts[pair] > 0:
                heapq.heappush(heap, entry(pair))
            continue
        if counts[pair] < least or counts[pair] <= 0 or bound and top[:3] > bound:
            break
        new = join(*pair)
        known = new in vocab
        merges.append(pair)
        vocab.setdefault(new, len(vocab))
        left, right = pair
        touched = set()
        for i in where.pop(pair):  # some no longer hold the pair
            parts, n = words[i]
            out: list[str] = []
            k, last = 0, len(parts)
            while k < last:
                if parts[k] == left and k + 1 < last and parts[k + 1] == right:
                    if out:
                        counts[out[-1], left] -= n
                        p = (out[-1], new)
                        counts[p] += n
                        where[p].add(i)
                        touched.add(p)
                    if k + 2 < last:
                        counts[right, parts[k + 2]] -= n
                        p = (new, parts[k + 2])
                        counts[p] += n
                        where[p].add(i)
                        touched.add(p)
                    out.append(new)
                    k += 2
                else:
                    out.append(parts[k])
                    k += 1
            words[i] = (out, n)
        counts[pair] = 0
        for p in touched:
            if p != pair and counts[p] > 0:
                heapq.heappush(heap, entry(p))
        if known and bound:
            break
    return merges


# ---------------------------------------------------------------- merges on the cluster


def queued_merges(ids: list, rank_of: Callable, join: Callable) -> list:
    """Symbols after all merges in rank order: a queue of (rank, place) over a linked list.

    ``rank_of(left, right)`` is a rank or None; ``join(rank, left, right)`` the new symbol.
    """
    n = len(ids)
    queue = [(r, k) for k in range(n - 1) if (r := rank_of(ids[k], ids[k + 1])) is not None]
    heapq.heapify(queue)
    ids, after, before = list(ids), list(range(1, n + 1)), list(range(-1, n - 1))
    gone = [False] * n
    while queue:
        rank, k = heapq.heappop(queue)
        right = after[k]
        if gone[k] or right == n or rank_of(ids[k], ids[right]) != rank:
            continue  # stale: something around it has been merged since
        ids[k] = join(rank, ids[k], ids[right])
        gone[right] = True
        after[k] = after[right]
        if after[k] < n:
            before[after[k]] = k
        for a, b in ((k, after[k]), (before[k], k)):
            if a >= 0 and b < n and (r := rank_of(ids[a], ids[b])) is not None:
                heapq.heappush(queue, (r, a))
    return [x for x, dead in zip(ids, gone, strict=True) if not dead]


class Found:
    """A sorted table of pairs, looked up for whole arrays."""

    def __init__(self, pairs: list[tuple[int, int]], new: list[int] | None = None) -> None:
        keys = np.array([a << 32 | b for a, b in pairs], np.int64)
        order = np.argsort(keys, kind="stable")
        self.keys, self.rank = keys[order], order
        self.new = np.array(new if new is not None else [], np.int64)

    def at(self, left: np.ndarray, right: np.ndarray) -> np.ndarray:
        """The place of each pair in the list it was made from, or -1."""
        if not len(self.keys):
            return np.full(len(left), -1)
        key = left.astype(np.int64) << 32 | right
        place = np.minimum(np.searchsorted(self.keys, key), len(self.keys) - 1)
        return np.where(self.keys[place] == key, self.rank[place], -1)


def flat(batch: pa.RecordBatch) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """(all symbols, the word of each, the words' counts) of a batch of (symbols, n)."""
    lists = batch.column(0)
    size = np.diff(np.asarray(lists.offsets))
    return np.asarray(lists.flatten()).astype(np.int64), np.repeat(np.arange(len(size)), size), np.asarray(batch.column(1)).astype(np.int64)


def as_words(symbols: np.ndarray, word: np.ndarray, counts: np.ndarray) -> pa.RecordBatch:
    """A batch of those words that have two symbols or more."""
    size = np.bincount(word, minlength=len(counts))
    keep = size > 1
    ends = np.concatenate([[0], np.cumsum(size[keep])])
    lists = pa.ListArray.from_arrays(pa.array(ends, pa.int32()), pa.array(symbols[keep[word]], pa.int32()))
    return pa.RecordBatch.from_arrays([lists, pa.array(counts[keep], pa.int64())], names=["symbols", "n"])


def merged(symbols: np.ndarray, word: np.ndarray, found: Found) -> tuple[np.ndarray, np.ndarray]:
    """(symbols, word of each) after all merges: in each word its lowest rank first, again and again."""
    size = np.bincount(word, minlength=1)
    long = size[word] > LONG_WORD
    done: list[tuple[np.ndarray, np.ndarray]] = []
    if long.any():
        ranks = dict(zip(found.keys.tolist(), found.rank.tolist(), strict=True))
        for w in np.unique(word[long]).tolist():
            out = queued_merges(symbols[word == w].tolist(), lambda a, b: ranks.get(a << 32 | b), lambda r, a, b: int(found.new[r]))
            done.append((np.array(out, np.int64), np.full(len(out), w)))
        symbols, word = symbols[~long], word[~long]
    while len(symbols):
        rank = found.at(symbols[:-1], symbols[1:])
        rank[word[:-1] != word[1:]] = -1
        live = np.zeros(len(size), bool)
        live[word[:-1][rank >= 0]] = True
        rest = ~live[word]
        done.append((symbols[rest], word[rest]))  # words without a merge
        symbols, word, rank = symbols[~rest], word[~rest], np.append(rank, -1)[~rest][:-1]
        hit = rank >= 0
        best = np.full(len(size), len(found.keys))
        np.minimum.at(best, word[:-1][hit], rank[hit])
        place = np.flatnonzero(hit & (rank == best[word[:-1]]))
        # Of overlapping pairs (x x x) every other one, from the left.
        starts = np.diff(place, prepend=-2) > 1
        place = place[(place - place[starts][np.cumsum(starts) - 1]) % 2 == 0]
        symbols[place] = found.new[rank[place]]
        keep = np.ones(len(symbols), bool)
        keep[place + 1] = False
        symbols, word = symbols[keep], word[keep]
    if not done:
        return symbols, word
    every, words = np.concatenate([x for x, _ in done]), np.concatenate([x for _, x in done])
    order = np.argsort(words, kind="stable")
    return every[order], words[order]


def _batches(df: DataFrame, fn: Callable[[pa.RecordBatch], pa.RecordBatch], schema: str) -> DataFrame:
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            if batch.num_rows:
                yield fn(batch)

    return df.mapInArrow(run, schema)


def pair_counts(words: DataFrame) -> DataFrame:
    """(l, r, c): how often two symbols stand side by side."""

    def count(batch: pa.RecordBatch) -> pa.RecordBatch:
        symbols, word, n = flat(batch)
        same = word[:-1] == word[1:]
        key, back = np.unique((symbols[:-1] << 32 | symbols[1:])[same], return_inverse=True)
        total = np.zeros(len(key), np.int64)
        np.add.at(total, back, n[word[:-1][same]])
        return pa.RecordBatch.from_arrays([pa.array(key >> 32, pa.int32()), pa.array(key & 0xFFFFFFFF, pa.int32()), pa.array(total)], names=["l", "r", "c"])

    return _batches(words, count, "l int, r int, c long").groupBy("l", "r").agg(F.sum("c").alias("c"))


def segments(words: DataFrame, active: list[tuple[int, int]]) -> DataFrame:
    """(symbols, n): the distinct stretches in which all neighbours are active pairs."""
    found = Found(active)

    def cut(batch: pa.RecordBatch) -> pa.RecordBatch:
        symbols, word, n = flat(batch)
        tied = (found.at(symbols[:-1], symbols[1:]) >= 0) & (word[:-1] == word[1:])
        segment = np.concatenate([[0], np.cumsum(~tied)]) if len(symbols) else word
        first = np.concatenate([[0], np.flatnonzero(~tied) + 1]) if len(symbols) else word
        return as_words(symbols, segment, n[word[first]])

    return _batches(words, cut, "symbols array<int>, n long").groupBy("symbols").agg(F.sum("n").alias("n"))


def apply_merges(words: DataFrame, pairs: list[tuple[int, int]], new: list[int]) -> DataFrame:
    """The words after a list of merges, without those that are one symbol then."""
    found = Found(pairs, new)

    def run(batch: pa.RecordBatch) -> pa.RecordBatch:
        symbols, word, n = flat(batch)
        return as_words(*merged(symbols, word, found), n)

    return _batches(words, run, "symbols array<int>, n long")


def _size(words: DataFrame) -> int:
    return words.agg(F.sum(F.size("symbols"))).first()[0] or 0


def merge_rounds(words: DataFrame, vocab: dict[str, int], size: int, least: int, join: Callable[[str, str], str], symbols: int | None = None) -> list[Pair]:
    """The merges of ``merge_loop`` over all of (symbols, n), in the same order; adds their tokens to ``vocab``."""
    spark, limit = words.sparkSession, symbols or SYMBOLS
    tokens = list(vocab)
    merges: list[Pair] = []
    active, path = ACTIVE_FIRST, None
    while len(vocab) < size:
        bound, part = None, words
        if _size(words) > limit:
            pairs = pair_counts(words).where(F.col("c") >= max(1, least)).orderBy(F.desc("c"), "l", "r").limit(active).collect()
            while pairs:
                kept = shared_dir(spark)
                part = store(segments(words, [(p["l"], p["r"]) for p in pairs]), kept)
                found = _size(part)
                if found <= limit or len(pairs) == 1:
                    break
                remove(spark, kept)
                pairs = pairs[: max(1, min(len(pairs) // 2, len(pairs) * limit // found))]
            if not pairs:
                break
            bound = (-pairs[-1]["c"], pairs[-1]["l"], pairs[-1]["r"])
            active = min(ACTIVE_MOST, len(pairs) * (4 if found * 4 <= limit else 1 + (found * 2 <= limit)))
        table = part.toArrow()
        local = [([tokens[i] for i in x], n) for x, n in zip(table["symbols"].to_pylist(), table["n"].to_pylist(), strict=True)]
        # The order of words decides nothing, but a fixed one makes runs alike.
        made = merge_loop(local, vocab, size, least, join, bound)
        merges += made
        if bound is None or len(vocab) >= size:
            break
        remove(spark, kept)
        tokens = list(vocab)
        before, path = path, shared_dir(spark)
        words = store(apply_merges(words, [(vocab[a], vocab[b]) for a, b in made], [vocab[join(a, b)] for a, b in made]), path)
        if before:
            remove(spark, before)
    return merges


# ---------------------------------------------------------------- unigram


def best_split(piece: str, scores: dict[str, float], unknown: float, without: str | None = None) -> list[str]:
    """The likeliest segmentation; a character that no token covers stands alone."""
    best: list[tuple[float, int]] = [(0.0, 0)] + [(-math.inf, 0)] * len(piece)
    for end in range(1, len(piece) + 1):
        for start in range(max(0, end - SEED_LENGTH), end):
            token = piece[start:end]
            s = scores.get(token, unknown if end - start == 1 else -math.inf) if token != without else -math.inf
            if best[start][0] + s > best[end][0]:
                best[end] = (best[start][0] + s, start)
    out, end = [], len(piece)
    while end:
        start = best[end][1]
        out.append(piece[start:end])
        end = start
    return out[::-1]


def logadd(a: float, b: float) -> float:
    if a == -math.inf:
        return b
    if b == -math.inf:
        return a
    hi, lo = max(a, b), min(a, b)
    return hi + math.log1p(math.exp(lo - hi))


def expected_counts(piece: str, n: int, scores: dict[str, float], into: dict[str, float]) -> float:
    """Add what each token is expected to count in ``n`` times this piece; the log likelihood of one."""
    size = len(piece)
    ahead = [0.0] + [-math.inf] * size
    for end in range(1, size + 1):
        for start in range(max(0, end - SEED_LENGTH), end):
            s = scores.get(piece[start:end])
            if s is not None:
                ahead[end] = logadd(ahead[end], ahead[start] + s)
    if ahead[-1] == -math.inf:
        return -math.inf
    back = [-math.inf] * size + [0.0]
    for start in range(size - 1, -1, -1):
        for end in range(start + 1, min(size, start + SEED_LENGTH) + 1):
            s = scores.get(piece[start:end])
            if s is not None and back[end] > -math.inf:
                back[start] = logadd(back[start], s + back[end])
                if ahead[start] > -math.inf:
                    into[piece[start:end]] += n * math.exp(min(0.0, ahead[start] + s + back[end] - ahead[-1]))
    return ahead[-1]


def expected_in_short(piece: str, n: int, chances: dict[str, float], into: dict[str, float]) -> float | None:
    """The same by plain probabilities, for a piece too short for them to vanish; None if they do."""
    size = len(piece)
    ahead, spans = [1.0] + [0.0] * size, []
    for start in range(size):
        here = ahead[start]
        if here:
            for end in range(start + 1, min(size, start + SEED_LENGTH) + 1):
                token = piece[start:end]
                p = chances.get(token)
                if p is not None:
                    spans.append((token, start, end, p))
                    ahead[end] += here * p
    whole = ahead[size]
    if whole < 1e-290:
        return None
    back = [0.0] * size + [1.0]
    for token, start, end, p in reversed(spans):
        p *= back[end]
        if p:
            back[start] += p
            into[token] += n * (ahead[start] * p / whole)
    return math.log(whole)


def seeds(counts: DataFrame, room: int) -> dict[str, int]:
    """All characters and the likeliest longer substrings with how often they occur."""
    at = counts.where("piece != ''").select("piece", "n", F.explode(F.sequence(F.lit(1), F.length("piece"))).alias("at"))
    ends = F.explode(F.sequence(F.lit(1), F.least(F.lit(SEED_LENGTH), F.length("piece") - F.col("at") + 1)))
    every = at.select("piece", "n", "at", ends.alias("size")).select(F.substring("piece", F.col("at"), F.col("size")).alias("token"), "n")
    freq = every.groupBy("token").agg(F.sum("n").alias("n"))
    path = shared_dir(counts.sparkSession)
    freq = store(freq.where("n > 1 or length(token) = 1"), path)
    longer = freq.where("n > 1 and length(token) > 1").orderBy(F.desc(F.col("n") * F.length("token")), "token").limit(max(room * SEEDS_PER_TOKEN, SEED_LEAST))
    found = {r["token"]: r["n"] for part in (freq.where("length(token) = 1").orderBy("token"), longer) for r in part.collect()}
    remove(counts.sparkSession, path)
    return found


def expectation(counts: DataFrame, scores: dict[str, float]) -> tuple[dict[str, float], float]:
    """(expected count of each token, log likelihood) over all pieces; only tokens come to the driver."""
    shipped = counts.sparkSession.sparkContext.broadcast(scores)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        found: dict[str, float] = defaultdict(float)
        chances = {t: math.exp(s) for t, s in shipped.value.items()}
        for batch in batches:
            for piece, n in zip(batch.column(0).to_pylist(), batch.column(1).to_pylist(), strict=True):
                one = expected_in_short(piece, n, chances, found) if 0 < len(piece) <= SHORT_PIECE else None
                if one is None:
                    one = expected_counts(piece, n, shipped.value, found) if piece else 0.0
                if one > -math.inf:
                    found[""] += n * one  # no token is empty: the likelihood's place
        yield pa.RecordBatch.from_pydict({"token": pa.array(found.keys(), pa.string()), "n": pa.array(found.values(), pa.float64())})

    total = counts.select("piece", "n").mapInArrow(run, "token string, n double").groupBy("token").agg(F.sum("n").alias("n")).toArrow()
    shipped.destroy()
    out = dict(zip(total["token"].to_pylist(), total["n"].to_pylist(), strict=True))
    return out, out.pop("", 0.0)


def removal_losses(scores: dict[str, float], expected: dict[str, float]) -> dict[str, float]:
    """For each longer token, the likelihood that is lost if its occurrences are split into the others."""
    whole = sum(expected.values()) or 1.0
    out = {}
    for t in (t for t in scores if len(t) > 1):
        n = expected.get(t, 0.0)
        parts = best_split(t, scores, -1e9, without=t)
        if n <= 0 or sum(scores.get(p, -1e9) for p in parts) >= scores[t]:
            out[t] = -math.inf if n <= 0 else 0.0  # its parts do as well
            continue
        spread = math.log(whole + n * (len(parts) - 1))
        out[t] = n * (math.log(n / whole) - sum(math.log(expected.get(p, 0.0) + n) - spread for p in parts))
    return out


def unigram_rounds(counts: DataFrame, size: int, specials: list[str]) -> dict[str, float]:
    """Log probabilities of the tokens of (piece, n); ``size`` with the special tokens, all characters at least."""
    found = seeds(counts, max(1, size - len(specials)))
    chars = sorted(t for t in found if len(t) == 1)
    room = max(len(chars), size - len(specials))
    total = sum(found.values()) or 1
    scores = {t: math.log(n / total) for t, n in found.items()}
    while scores:
        for _ in range(PASSES):
            expected, _ = expectation(counts, scores)
            scores = {t: s for t, s in scores.items() if len(t) == 1 or expected.get(t, 0.0) > 0.5}
            whole = sum(expected.get(t, 0.0) for t in scores) or 1.0
            scores = {t: math.log(max(expected.get(t, 0.0), 1e-6) / whole) for t in scores}
        if len(scores) <= room:
            break
        losses = removal_losses(scores, expected)
        keep = max(room - len(chars), int(SHRINK * len(losses)))
        kept = sorted(losses, key=lambda t: (-losses[t], t))[:keep]
        scores = {t: scores[t] for t in [*chars, *kept]}
    return scores
