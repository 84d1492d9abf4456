"""Secret scans: an Aho-Corasick keyword prefilter, anchored expressions, checksums.

One automaton pass over the lower-cased text finds keywords; an expression is tried
only where a keyword stands (``match`` at that position), and token formats that
embed a checksum or a self-describing structure must pass it.  Runs of hexadecimal
digits have no keyword: a run of k or more covers a multiple of k, so every k-th
character is the anchor there.

Kinds: assign, access, hex (the base); github and npm (tokens whose last six
characters are the base-62 CRC-32 of the rest), jwt (no checksum, but a header that decodes
to JSON with an algorithm), pem (a private key whose base64 body is one DER sequence of
exactly the stated length, or in the OpenSSH format with lengths that fit, or, where
headers say that it is encrypted, whole cipher blocks).

Whole texts are scanned, in time that grows with their length alone; null counts as empty; an empty table gives an empty
result; repeated rows give repeated results; further columns are ignored.
"""

from __future__ import annotations

import base64
import binascii
import hashlib
import json
import re
from functools import lru_cache

import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from textloom.llm import common

KINDS = ["assign", "access", "hex", "github", "npm", "jwt", "pem"]
BASE = 3
ASSIGN = re.compile(r"""(?:(?i:password|passwd|secret|token|api_?key))["']?\x20*[:=]\x20*["']?([A-Za-z0-9+/_.=-]+)""", re.ASCII)
ACCESS = re.compile(r"AKIA[A-Z0-9]+", re.ASCII)
HEX = re.compile(r"[0-9a-f]+", re.ASCII)
HEX_RUN, ACCESS_RUN, ASSIGN_RUN = 24, 20, 6
GITHUB = re.compile(r"gh[pousr]_([0-9A-Za-z]{36})(?![0-9A-Za-z])", re.ASCII)
NPM = re.compile(r"npm_([0-9A-Za-z]{36})(?![0-9A-Za-z])", re.ASCII)
#: A token begins where a run of its characters begins, so that no run is read from each of its hits.
JWT = re.compile(r"(?<![A-Za-z0-9_-])(eyJ[A-Za-z0-9_-]++)\.([A-Za-z0-9_-]++)\.([A-Za-z0-9_-]++)", re.ASCII)
#: Headers hold no row of dashes, so that none of them is read for a second hit.
PEM = re.compile(r"-----BEGIN ([A-Z ]*PRIVATE KEY)-----[ \t\r]*+\n?((?:[A-Za-z-]++:(?:[^\n-]++|-(?!----))*+\n)*+)([A-Za-z0-9+/=\s]++)-----END \1-----", re.ASCII)
OPENSSH = b"openssh-key-v1\0"
KEYWORDS = {"password": 0, "passwd": 0, "secret": 0, "token": 0, "apikey": 0, "api_key": 0, "akia": 1, "ghp_": 3, "gho_": 3, "ghu_": 3, "ghs_": 3, "ghr_": 3, "npm_": 4, "eyj": 5, "-----begin ": 6}
BASE62 = "0123456789ABCDEFGHIJKLMNOPQRSTUVWXYZabcdefghijklmnopqrstuvwxyz"


@lru_cache(maxsize=1)
def automaton():
    import ahocorasick

    auto = ahocorasick.Automaton()
    for word, kind in KEYWORDS.items():
        auto.add_word(word, (kind, len(word)))
    auto.make_automaton()
    return auto


def base62_crc(body: str) -> str:
    n, out = binascii.crc32(body.encode()), ""
    while n:
        n, d = divmod(n, 62)
        out = BASE62[d] + out
    return out.rjust(6, "0")


def checked_token(m: re.Match) -> bool:
    return base62_crc(m[1][:30]) == m[1][30:]


def checked_jwt(m: re.Match) -> bool:
    try:
        head = json.loads(base64.urlsafe_b64decode(m[1] + "=" * (-len(m[1]) % 4)))
    except (ValueError, binascii.Error, RecursionError):
        return False
    return isinstance(head, dict) and "alg" in head


def checked_pem(m: re.Match) -> bool:
    try:
        der = base64.b64decode("".join(m[3].split()), validate=True)
    except (ValueError, binascii.Error):
        return False
    if "ENCRYPTED" in m[2]:
        return len(der) > 0 and len(der) % 8 == 0
    if der.startswith(OPENSSH):
        return fits_openssh(der)
    if len(der) < 2 or der[0] != 0x30:
        return False
    if der[1] < 0x80:
        return len(der) == 2 + der[1]
    n = der[1] & 0x7F
    return 0 < n <= 4 and len(der) == 2 + n + int.from_bytes(der[2 : 2 + n], "big")


def fits_openssh(raw: bytes) -> bool:
    """Cipher, key derivation and its options, then as many public keys as stated and one private part."""
    at, fields = len(OPENSSH), 3
    while fields:
        if at + 4 > len(raw):
            return False
        at += 4 + int.from_bytes(raw[at : at + 4], "big")
        fields -= 1
    count = int.from_bytes(raw[at : at + 4], "big")
    at += 4
    if not 0 < count <= len(raw):
        return False
    for _ in range(count + 1):
        if at + 4 > len(raw):
            return False
        at += 4 + int.from_bytes(raw[at : at + 4], "big")
    return at == len(raw)


RULES = {3: (GITHUB, checked_token), 4: (NPM, checked_token), 5: (JWT, checked_jwt), 6: (PEM, checked_pem)}


def hex_runs(text: str) -> list[tuple[int, int]]:
    """All maximal runs of HEX_RUN or more digits, from every HEX_RUN-th character."""
    out, done = [], 0
    digits = "0123456789abcdef"
    for i, c in enumerate(text[HEX_RUN - 1 :: HEX_RUN]):
        if c not in digits:
            continue
        at = HEX_RUN - 1 + i * HEX_RUN
        if at < done:
            continue
        start = at
        while start > done and text[start - 1] in digits:
            start -= 1
        end = HEX.match(text, at).end()
        if end - start >= HEX_RUN:
            out.append((start, end))
        done = end
    return out


def scan(text: str) -> list[tuple[int, int, int]]:
    """(start, end, kind number) of all secrets, by start and then kind."""
    low = text.lower()
    if len(low) != len(text):  # a character grew: keep positions, fold ASCII only
        low = text.encode("utf-8", "surrogatepass").translate(common.LOWER).decode("utf-8", "surrogatepass")
    hits: dict[int, list[int]] = {}
    for last, (kind, size) in automaton().iter(low):
        hits.setdefault(kind, []).append(last - size + 1)
    found = []
    for kind, starts in hits.items():
        done = 0
        for start in sorted(starts):
            if start < done:
                continue
            if kind == 0:
                m = ASSIGN.match(text, start)
                keep = m and len(m[1]) >= ASSIGN_RUN
            elif kind == 1:
                m = ACCESS.match(text, start)
                keep = m and len(m[0]) >= ACCESS_RUN
            else:
                pattern, check = RULES[kind]
                m = pattern.match(text, start)
                keep = m and check(m)
            if m:
                done = m.end() if kind <= 1 or keep else start + 1
            if keep:
                found.append((start, m.end(), kind))
    found += [(a, b, 2) for a, b in hex_runs(text)]
    return sorted(found, key=lambda x: (x[0], x[2]))


def joined(spans: list[tuple[int, int, int]]) -> str:
    return ",".join(f"{KINDS[k]}:{a}:{b}" for a, b, k in spans)


def find_secrets(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """(id, n_assign, n_access, n_hex, base_sha256, spans): spans count code points, ends exclusive."""
    schema = {"id": pa.int64(), "n_assign": pa.int64(), "n_access": pa.int64(), "n_hex": pa.int64(), "base_sha256": pa.string(), "spans": pa.string()}

    def run(batch: pa.RecordBatch) -> pa.RecordBatch:
        spans = [scan(t) for t in common.texts(batch.column(1))]
        counts = [[sum(k == n for _, _, k in s) for s in spans] for n in range(BASE)]
        base = [hashlib.sha256(joined([x for x in s if x[2] < BASE]).encode()).hexdigest() for s in spans]
        return common.rows(schema, id=batch.column(0), n_assign=counts[0], n_access=counts[1], n_hex=counts[2], base_sha256=base, spans=[joined(s) for s in spans])

    return common.map_batches(common.id_text(docs, id_col, text_col), run, "id long, n_assign long, n_access long, n_hex long, base_sha256 string, spans string").withColumnRenamed("id", id_col)


def masked(text: str) -> str:
    """The text with each secret (overlapping spans as one) replaced by ``[kind]``."""
    out, done, merged = [], 0, []
    for a, b, k in scan(text):
        if merged and a < merged[-1][1]:
            merged[-1][1] = max(merged[-1][1], b)
        else:
            merged.append([a, b, k])
    for a, b, k in merged:
        out += [text[done:a], f"[{KINDS[k]}]"]
        done = b
    return "".join([*out, text[done:]]) if merged else text


def mask_secrets(docs: DataFrame, text_col: str = "text") -> DataFrame:
    """All rows and columns, secrets masked in ``text_col`` (null stays null)."""
    common.tune(docs.sparkSession)

    @F.pandas_udf("string")
    def mask(s):
        return s.map(lambda t: None if t is None else masked(t))

    return docs.withColumn(text_col, mask(F.col(text_col)))


def op4_secrets(spark: SparkSession, sf_dir: str) -> DataFrame:
    return find_secrets(common.table(spark, sf_dir, "documents"))
