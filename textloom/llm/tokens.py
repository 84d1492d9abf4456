"""Exact, cached encoding with public tokenizers.

A text is cut where the tokenizer's own pattern is bound to cut, each distinct
piece goes through the ``tokenizers`` library once per worker, and the ids of a
text are the joined ids of its pieces.  Ids travel as little-endian unsigned
32-bit bytes, so a text's ids are one ``bytes.join``.
"""

from __future__ import annotations

import base64
import json
import os
import re
import unicodedata
from array import array
from functools import lru_cache

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc

os.environ.setdefault("TOKENIZERS_PARALLELISM", "false")
#: Distinct pieces a worker remembers, and the longest piece worth remembering.
CACHE_PIECES, CACHE_COLUMN = 400_000, 1_000_000
CACHE_CHARS = 40
#: Beyond the Latin blocks, engines may disagree on what newer Unicode calls a letter.
LATIN_END = "\u0250"
#: Marks that no pattern joins to a letter before them, and that patterns join to one another.
MARKS, LETTERS = ",.;:!?#*$%&|", frozenset("abcdefghijklmnopqrstuvwxyzABCDEFGHIJKLMNOPQRSTUVWXYZ")


def byte_characters() -> dict[int, str]:
    """The byte-level alphabet: printable Latin-1 bytes stand for themselves, the rest follow at 256."""
    plain = {*range(0x21, 0x7F), *range(0xA1, 0xAD), *range(0xAE, 0x100)}
    out, extra = {}, 256
    for b in range(256):
        if b in plain:
            out[b] = chr(b)
        else:
            out[b] = chr(extra)
            extra += 1
    return out


BYTE_TABLE = byte_characters()


def spelled(text: str) -> str:
    if text.isascii() and " " not in text and text.isprintable():
        return text
    return text.encode("utf-8", "surrogatepass").decode("latin-1").translate(BYTE_TABLE)


class Pieces:
    """Piece -> id bytes, with a bounded memory; subclasses say how texts are cut."""

    def __init__(self, tokenizer) -> None:
        self.tokenizer = tokenizer
        self.known: dict[str, bytes] = {}

    def split(self, text: str) -> list[str]:
        raise NotImplementedError

    def fold(self, stem: str) -> str:
        """A stem with the same ids, so that fewer distinct ones meet the library."""
        return stem

    def fresh(self, pieces: list[str]) -> dict[str, bytes]:
        """Ids of new pieces.  Marks at the end, after an ASCII letter, are a pre-token of their own."""
        known, out, cut, need = self.known, {}, [], {}
        for p in pieces:
            stem = p.rstrip(MARKS)
            if len(stem) != len(p) and stem[-1:] in LETTERS and stem:
                mark, stem = p[len(stem) :], self.fold(stem)
                cut.append((p, stem, mark))
                if mark not in known:
                    need[mark] = b""
            else:
                stem = self.fold(p)
                if stem != p:
                    cut.append((p, stem, ""))
            if stem not in known:
                need[stem] = b""
        self.library(need)
        out = need
        for p, stem, mark in cut:
            ids = need[stem] if stem in need else known[stem]
            if mark:
                ids += need[mark] if mark in need else known[mark]
            out[p] = ids
        return out

    def single(self, stem: str) -> str | None:
        """The byte alphabet's spelling of a stem that is one pre-token for certain, else None."""
        return None

    def library(self, need: dict[str, bytes]) -> None:
        """Fill in the ids of the keys: plain words go straight to the library's merges."""
        rest, tokenize, single = [], self.tokenizer.model.tokenize, self.single
        for x in need:
            plain = single(x)
            if plain is None:
                rest.append(x)
            else:
                need[x] = array("I", [t.id for t in tokenize(plain)]).tobytes()
        for x, e in zip(rest, self.tokenizer.encode_batch_fast(rest, add_special_tokens=False), strict=True):
            need[x] = id_bytes(e.ids)

    def encode(self, texts: list[str]) -> list[bytes]:
        """The ids of each text as little-endian unsigned 32-bit bytes."""
        cut: list[str] = []
        ends = []
        for t in texts:
            cut += self.split(t)
            ends.append(len(cut))
        got = list(map(self.known.get, cut))
        holes = [i for i, x in enumerate(got) if x is None]
        if holes:
            missing = list({cut[i] for i in holes})
            new = self.fresh(missing)
            for i in holes:
                got[i] = new[cut[i]]
            if len(self.known) + len(new) > CACHE_PIECES:
                # Start over from what this batch uses: common pieces come back at once.
                self.known = {p: x for p, x in zip(cut, got, strict=True) if len(p) <= CACHE_CHARS}
            else:
                self.known.update((p, x) for p, x in new.items() if len(p) <= CACHE_CHARS)
        return [b"".join(got[a:b]) for a, b in zip([0, *ends], ends)]


def id_bytes(ids: list[int]) -> bytes:
    return np.array(ids, "<u4").tobytes()


class WordPieces(Pieces):
    """For tokenizers that drop white space: pieces are what white space separates.

    A special token's string in a text is that token, as the library has it, or with
    ``special_text`` ordinary text.  Special tokens begin with ``<``.
    """

    def __init__(self, path: str, special_text: bool = False) -> None:
        from tokenizers import Tokenizer

        tokenizer = Tokenizer.from_file(path)
        tokenizer.encode_special_tokens = special_text
        super().__init__(tokenizer)

    def fold(self, stem: str) -> str:
        return stem.lower() if stem.isascii() and "<" not in stem else stem

    def single(self, stem: str) -> str | None:
        if stem.isalpha() and (stem.isascii() or max(stem) < LATIN_END and unicodedata.is_normalized("NFC", stem) and stem.islower() and stem.lower() == stem):
            return spelled(stem)
        return None

    def split(self, text: str) -> list[str]:
        # str.split also cuts at U+001C..1F, which the tokenizer keeps as characters.
        if any(c in text for c in "\x1c\x1d\x1e\x1f"):
            return text.replace("\n", " ").split(" ")
        return text.split()


    def known_ids(self, stems: pa.Array) -> tuple[np.ndarray, np.ndarray]:
        """(all ids, number of ids of each) of distinct stems; ASCII words go straight to the merges."""
        texts = stems.to_pylist()
        got = list(map(self.known.get, texts))
        if None in got:
            plain = pc.and_(pc.ascii_is_alpha(stems), pc.string_is_ascii(stems)).to_pylist()
            tokenize, new, rest = self.tokenizer.model.tokenize, {}, {}
            for i, x in enumerate(got):
                if x is None:
                    t = texts[i]
                    if plain[i]:
                        got[i] = new[t] = array("I", [y.id for y in tokenize(t)]).tobytes()
                    else:
                        rest[t] = b""
            if rest:
                self.library(rest)
                got = [rest[t] if x is None else x for t, x in zip(texts, got, strict=True)]
                new |= rest
            if len(self.known) + len(new) > CACHE_COLUMN:
                self.known = dict(zip(texts, got, strict=True))
            else:
                self.known |= new
            for t in [t for t in texts if len(t) > CACHE_CHARS]:
                self.known.pop(t, None)
        return np.frombuffer(b"".join(got), "<u4"), np.fromiter(map(len, got), np.int64, len(got)) // 4

    def encode_column(self, column: pa.Array) -> tuple[np.ndarray, np.ndarray]:
        """(ids of all texts, number of ids of each), for a whole Arrow column at once.

        Arrow cuts the texts, numbers the pieces, parts marks from words and folds case, so
        that Python sees each distinct stem once; cuts at ASCII blanks suffice, others stay
        inside a piece.
        """
        lists = pc.ascii_split_whitespace(column.fill_null(""))
        numbered = lists.flatten().dictionary_encode()
        pieces = numbered.dictionary
        marked = pc.match_substring_regex(pieces, f"[A-Za-z][{re.escape(MARKS)}]+$")
        stems = pc.if_else(marked, pc.utf8_rtrim(pieces, MARKS), pieces)
        marks = pc.replace_with_mask(pa.array([""] * len(pieces), pa.string()), marked, pc.replace_substring_regex(pieces.filter(marked), "(?s)^.*[A-Za-z]", ""))
        folded = pc.and_(pc.string_is_ascii(stems), pc.invert(pc.match_substring(stems, "<")))
        parts = [x.dictionary_encode() for x in (pc.if_else(folded, pc.ascii_lower(stems), stems), marks)]
        tables, sizes = zip(*(self.known_ids(x.dictionary) for x in parts), strict=True)
        # The ids of each distinct piece: those of its stem, then those of its marks.
        codes = [x.indices.to_numpy() for x in parts]
        first = np.stack([(np.cumsum(n) - n)[c] + shift for n, c, shift in zip(sizes, codes, (0, len(tables[0])), strict=True)], axis=1).reshape(-1)
        table = np.concatenate(tables)[spans(first, np.stack([n[c] for n, c in zip(sizes, codes, strict=True)], axis=1).reshape(-1))]
        size = sizes[0][codes[0]] + sizes[1][codes[1]]
        code = numbered.indices.to_numpy()
        each = size[code]
        ids = table[spans((np.cumsum(size) - size)[code], each)]
        edge = np.concatenate([[0], np.cumsum(each)])
        cuts = np.asarray(lists.offsets)
        return ids, np.diff(edge[cuts - cuts[0]])


def spans(first: np.ndarray, size: np.ndarray) -> np.ndarray:
    """Places of all the spans [first, first + size), one after another."""
    ends = np.cumsum(size)
    total = int(ends[-1]) if len(ends) else 0
    kind = np.int32 if total + int(first.max(initial=0)) < 1 << 31 else np.int64
    return np.repeat((first - (ends - size)).astype(kind), size) + np.arange(total, dtype=kind)


@lru_cache(maxsize=4)
def word_pieces(path: str, special_text: bool = False) -> WordPieces:
    return WordPieces(path, special_text)


def read_ranks(path: str) -> dict[bytes, int]:
    with open(path, "rb") as f:
        return {base64.b64decode(a): int(b) for a, b in (line.split() for line in f if line.strip())}


def merges_of(ranks: dict[bytes, int]) -> list[tuple[bytes, bytes]]:
    """The merge that makes each token: what is left after all merges of lower rank."""
    out = []
    for token, rank in sorted(ranks.items(), key=lambda x: x[1]):
        if len(token) == 1:
            continue
        parts = [token[i : i + 1] for i in range(len(token))]
        while len(parts) > 2:
            best, at = min((ranks.get(parts[i] + parts[i + 1], 1 << 60), i) for i in range(len(parts) - 1))
            if best >= rank:
                raise ValueError(f"rank {rank} has no pair of parts of lower rank")
            parts[at : at + 2] = [parts[at] + parts[at + 1]]
        out.append((parts[0], parts[1]))
    return out


class BytePieces(Pieces):
    """Byte-level BPE by a rank file, run by the ``tokenizers`` library over the byte alphabet."""

    def __init__(self, path: str, pattern: str) -> None:
        from tokenizers import Regex, Tokenizer, models, pre_tokenizers

        ranks = read_ranks(path)
        to_char = byte_characters()
        word = lambda token: "".join(to_char[b] for b in token)
        model = models.BPE(vocab={word(t): r for t, r in ranks.items()}, merges=[(word(a), word(b)) for a, b in merges_of(ranks)])
        tokenizer = Tokenizer(model)
        tokenizer.pre_tokenizer = pre_tokenizers.Sequence(
            [pre_tokenizers.Split(Regex(pattern), "isolated"), pre_tokenizers.ByteLevel(add_prefix_space=False, use_regex=False)]
        )
        super().__init__(tokenizer)
        self.from_char = {c: b for b, c in to_char.items()}
        #: id -> the bytes it stands for, by reversing the byte table.
        self.spell: list[bytes] = [b""] * (max(ranks.values()) + 1)
        for token, rank in ranks.items():
            self.spell[rank] = bytes(self.from_char[c] for c in word(token))

    def single(self, stem: str) -> str | None:
        word = stem[1:] if stem[:1] == " " else stem
        return spelled(stem) if word.isalpha() and (word.isascii() or max(word) < LATIN_END) else None

    def split(self, text: str) -> list[str]:
        from textloom.llm.common import PIECES

        return PIECES.findall(text)

    def encode_offsets(self, text: str) -> tuple[list[int], list[tuple[int, int]]]:
        """Ids and, for each, the span of characters it touches (end exclusive).

        A token may hold part of a character's bytes; then it and its neighbours
        all carry that character.
        """
        ids = self.tokenizer.encode(text, add_special_tokens=False).ids
        # Byte position -> character index, from the length of each character in UTF-8.
        size = [len(self.spell[i]) for i in ids]
        raw = text.encode("utf-8", "surrogatepass")
        lead = (np.frombuffer(raw, np.uint8) & 0xC0) != 0x80
        char = np.cumsum(lead) - 1
        ends = np.cumsum(size)
        return ids, [(int(char[e - n]), int(char[e - 1]) + 1) for e, n in zip(ends, size, strict=True)]

    def decode(self, ids: np.ndarray) -> bytes:
        """The exact bytes; a character split over tokens is whole again once they are joined."""
        spell = self.spell
        return b"".join([spell[i] for i in ids.tolist()])


@lru_cache(maxsize=4)
def byte_pieces(path: str, pattern: str) -> BytePieces:
    return BytePieces(path, pattern)


def utf8_stream(chunks: list[bytes]) -> list[str]:
    """Text of successive token groups; the bytes of a split character wait for the rest of it."""
    import codecs

    reader = codecs.getincrementaldecoder("utf-8")("replace")
    return [reader.decode(c, i == len(chunks) - 1) for i, c in enumerate(chunks)]


def vocabulary_size(path: str) -> int:
    with open(path) as f:
        data = json.load(f)
    return max([*data["model"]["vocab"].values(), *(t["id"] for t in data["added_tokens"])]) + 1
