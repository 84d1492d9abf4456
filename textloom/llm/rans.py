"""Token-ID output in a static range asymmetric numeral system (rANS) format.

The corpus is one sequence of token ids: documents in ascending id order, each
followed by the end id.  It is written as segments, each of whole documents.  A
segment holds one frequency table that all its blocks share; a block codes up to
BLOCK ids on interleaved lanes by itself, and has its own CRC-32 and checkpoints
(lane states and read position every CHECKPOINT rows), so blocks, and spans within a
block, decode in parallel.

Container: Parquet, one row per segment with (part, segment, n_docs, n_tokens, docs,
table, blocks).  Parts follow one another in id order.  Spark's committer makes a
lost executor harmless.

    docs    zlib: int64 differences of ids, then int32 counts of ids (with the end id)
    table   zlib: uint32 count, uint32 symbol differences, uint32 frequencies (sum 2^SCALE)
    block   uint32 ids, lanes, rows between checkpoints, checkpoints, words, CRC-32;
            uint64 lane states; per checkpoint uint32 word position and uint64 lane
            states; uint32 words

Null texts count as empty and give the end id alone; repeated rows are written again;
an empty table gives an empty result; whole texts are encoded; columns other than the
id and the text are ignored.  Rows with a null id come first; those with the same id are
in the order of their texts' hashes.  What a program has written under ``shared_dir`` goes
when it ends (``storage.release``); a file that is to last gets a path of its own.
"""

from __future__ import annotations

import struct
import zlib
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from textloom.llm import common
from textloom.llm.tokens import word_pieces

U64 = np.uint64
SCALE, LOW = 18, 1 << 31
LANES, BLOCK, CHECKPOINT = 1024, 1 << 18, 128
#: Bytes of text at which a segment is closed (one longer document stands alone).
SEGMENT = 6 << 20
#: Characters of text in a part (one task's share of the ordered output), at least, and the
#: most parts: beyond, parts grow with the input.  A part is sorted with spilling and leaves
#: by segments, so its size does not bound memory.
PART_CHARS, MAX_PARTS = 16_000_000, 20_000
END_ID = 1


def frequencies(ids: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """(symbols, frequencies): each at least 1, 2^SCALE in all."""
    every = np.bincount(ids)
    symbols = np.flatnonzero(every)
    counts = every[symbols]
    if len(symbols) > 1 << SCALE:
        raise ValueError("more distinct ids than the table has room for")
    total = 1 << SCALE
    f = np.maximum(1, counts.astype(np.int64) * total // max(1, counts.sum()))
    over = int(f.sum()) - total
    if over < 0:
        f[np.argmax(f)] -= over
    for k in np.argsort(-f, kind="stable") if over > 0 else ():
        take = min(over, int(f[k]) - 1)
        f[k] -= take
        over -= take
        if not over:
            break
    return symbols.astype(np.uint32), f


def pack_table(symbols: np.ndarray, f: np.ndarray) -> bytes:
    return zlib.compress(struct.pack("<I", len(symbols)) + np.diff(symbols.astype(np.int64), prepend=0).astype("<u4").tobytes() + f.astype("<u4").tobytes())


def unpack_table(raw: bytes) -> tuple[np.ndarray, np.ndarray]:
    raw = zlib.decompress(raw)
    n = struct.unpack_from("<I", raw)[0]
    return np.cumsum(np.frombuffer(raw, "<u4", n, 4)).astype(np.uint32), np.frombuffer(raw, "<u4", n, 4 + 4 * n).astype(np.int64)


def encode_block(ids: np.ndarray, symbols: np.ndarray, f: np.ndarray, lanes: int = LANES, step: int = CHECKPOINT) -> bytes:
    """One block; ids must be among the table's symbols."""
    n = len(ids)
    lanes = max(1, min(lanes, n // 16))
    place = np.zeros(int(symbols[-1]) + 1 if len(symbols) else 1, np.int64)
    place[symbols] = np.arange(len(symbols))
    slot = place[ids]
    freq, first = f.astype(U64)[slot], (np.cumsum(f) - f).astype(U64)[slot]
    limit = freq << U64(63 - SCALE)
    state = np.full(lanes, LOW, U64)
    rows = -(-n // lanes)
    words: list[np.ndarray] = []
    marks: list[tuple[int, np.ndarray]] = []
    word, scale = U64(32), U64(SCALE)
    for r in range(rows - 1, -1, -1):  # last in, first out
        a = r * lanes
        b = min(n, a + lanes)
        x = state[: b - a]
        full = np.flatnonzero(x >= limit[a:b])
        if len(full):
            words.append(x[full].astype(np.uint32))
            x[full] >>= word
        else:
            words.append(np.empty(0, np.uint32))
        q = x // freq[a:b]
        x[:] = (q << scale) + (x - q * freq[a:b]) + first[a:b]
        if r and r % step == 0:
            marks.append((r, state.copy()))
    words.reverse()
    sizes = np.cumsum([0, *map(len, words)])
    stream = np.concatenate(words) if words else np.empty(0, np.uint32)
    marks.reverse()
    head = struct.pack("<6I", n, lanes, step, len(marks), len(stream), zlib.crc32(np.ascontiguousarray(ids, "<u4").tobytes()))
    saved = b"".join(struct.pack("<I", sizes[r]) + s.astype("<u8").tobytes() for r, s in marks)
    return head + state.astype("<u8").tobytes() + saved + stream.astype("<u4").tobytes()


class Decoder:
    """Slot tables of one frequency table, and decoding of its blocks."""

    def __init__(self, symbols: np.ndarray, f: np.ndarray) -> None:
        first = np.cumsum(f) - f
        self.symbol = np.repeat(symbols, f)
        self.freq = np.repeat(f, f).astype(U64)
        self.rest = (np.arange(f.sum()) - np.repeat(first, f)).astype(U64)

    def block(self, raw: bytes, check: bool = True) -> np.ndarray:
        n, lanes, step, marks, _, crc = struct.unpack_from("<6I", raw)
        out = self.span(raw, 0, -(-n // lanes) if n else 0)
        if check and zlib.crc32(out.astype("<u4").tobytes()) != crc:
            raise ValueError("a block's checksum does not match")
        return out

    def span(self, raw: bytes, start: int, end: int) -> np.ndarray:
        """The ids of rows [start, end), from the nearest checkpoint at or before."""
        n, lanes, step, marks, size, _ = struct.unpack_from("<6I", raw)
        at = 24 + 8 * lanes
        state, position, row = np.frombuffer(raw, "<u8", lanes, 24).astype(U64), 0, 0
        if (k := min(marks, start // step)) > 0:
            here = at + (k - 1) * (4 + 8 * lanes)
            position, row = struct.unpack_from("<I", raw, here)[0], k * step
            state = np.frombuffer(raw, "<u8", lanes, here + 4).astype(U64)
        words = np.frombuffer(raw, "<u4", size, at + marks * (4 + 8 * lanes)).astype(U64)
        mask, scale, low, word = U64((1 << SCALE) - 1), U64(SCALE), U64(LOW), U64(32)
        out = np.empty(max(0, min(n, end * lanes) - row * lanes), np.uint32)
        for r in range(row, end):
            a = r * lanes
            b = min(n, a + lanes)
            x = state[: b - a]
            slot = (x & mask).astype(np.int64)
            out[a - row * lanes : b - row * lanes] = self.symbol[slot]
            x[:] = self.freq[slot] * (x >> scale) + self.rest[slot]
            low_ones = np.flatnonzero(x < low)
            if len(low_ones):
                x[low_ones] = (x[low_ones] << word) | words[position : position + len(low_ones)]
                position += len(low_ones)
        return out[(start - row) * lanes :]


SEGMENT_DDL = "part int, segment int, n_docs int, n_tokens long, docs binary, table binary, blocks array<binary>"


def pack_segment(doc_ids: list[int | None], sizes: np.ndarray, ids: np.ndarray) -> dict:
    symbols, f = frequencies(ids)
    known = np.array([-(1 << 63) if i is None else i for i in doc_ids], np.int64)
    docs = np.diff(known, prepend=0).astype("<i8").tobytes() + sizes.astype("<i4").tobytes()
    return {
        "n_docs": len(doc_ids),
        "n_tokens": len(ids),
        "docs": zlib.compress(docs),
        "table": pack_table(symbols, f),
        "blocks": [encode_block(ids[a : a + BLOCK], symbols, f) for a in range(0, len(ids), BLOCK)],
    }


def with_ends(ids: np.ndarray, counts: np.ndarray, end_id: int) -> tuple[np.ndarray, np.ndarray]:
    """Each document's ids followed by the end id, and the new counts."""
    counts = counts + 1
    out = np.empty(int(counts.sum()), "<u4")
    last = np.zeros(len(out), bool)
    last[np.cumsum(counts) - 1] = True
    out[last], out[~last] = end_id, ids
    return out, counts


def unpack_docs(raw: bytes, n: int) -> tuple[list[int | None], np.ndarray]:
    raw = zlib.decompress(raw)
    ids = np.cumsum(np.frombuffer(raw, "<i8", n)).tolist()
    return [None if i == -(1 << 63) else i for i in ids], np.frombuffer(raw, "<i4", n, 8 * n).astype(np.int64)


def vocabulary() -> str:
    import public_tokenizers as public

    return public.path("word_bpe_49k.json")


def write(docs: DataFrame, path: str, tokenizer: str | None = None, end_id: int = END_ID, id_col: str = "doc_id", text_col: str = "text", part_chars: int = PART_CHARS, special_text: bool = False) -> DataFrame:
    """Write the token file and return its segments.  The text is shuffled once, into id order."""
    spark = docs.sparkSession
    common.tune(spark)
    tokenizer = tokenizer or vocabulary()
    cut = common.id_text(docs, id_col, text_col)
    chars = cut.agg(F.sum(F.length("text"))).first()[0] or 0
    parts = min(MAX_PARTS, max(1, -(-chars // part_chars)))
    cut = cut.withColumn("tie", F.xxhash64("text"))  # rows of one id can go to several parts
    ordered = cut.repartitionByRange(parts, "id", "tie").sortWithinPartitions("id", "tie", "text").select("id", "text", F.spark_partition_id().alias("part"))

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        pieces, number = word_pieces(tokenizer, special_text), 0
        held: list[pa.RecordBatch] = []
        weight = 0

        def emit() -> pa.RecordBatch:
            rows = pa.Table.from_batches(held).combine_chunks()
            ids, counts = with_ends(*pieces.encode_column(rows.column("text").combine_chunks()), end_id)
            row = {"part": rows.column("part")[0].as_py(), "segment": number} | pack_segment(rows.column("id").to_pylist(), counts, ids)
            kinds = [pa.int32(), pa.int32(), pa.int32(), pa.int64(), pa.binary(), pa.binary(), pa.list_(pa.binary())]
            return pa.RecordBatch.from_arrays([pa.array([v], t) for v, t in zip(row.values(), kinds, strict=True)], names=list(row))

        for batch in batches:
            for piece in common.slices(batch):
                held.append(piece)
                weight += piece.nbytes
                if weight >= SEGMENT:
                    yield emit()
                    number += 1
                    held, weight = [], 0
        if held:
            yield emit()

    ordered.mapInArrow(run, SEGMENT_DDL).write.mode("overwrite").option("compression", "none").option("parquet.block.size", str(16 << 20)).parquet(path)
    return spark.read.schema(SEGMENT_DDL).parquet(path)


def starts(segments: DataFrame) -> DataFrame:
    """(part, segment, base): ids before each segment; sums by part first, so that no task sees more than MAX_PARTS rows or a part's segments."""
    sizes = segments.groupBy("part").agg(F.sum("n_tokens").alias("size"))
    before = sizes.select("part", (F.sum("size").over(Window.orderBy("part")) - F.col("size")).alias("before"))
    within = segments.select("part", "segment", (F.sum("n_tokens").over(Window.partitionBy("part").orderBy("segment")) - F.col("n_tokens")).alias("within"))
    return within.join(before, "part").select("part", "segment", (F.col("before") + F.col("within")).alias("base"))


def read(segments: DataFrame, with_ids: bool = True, id_col: str = "doc_id") -> DataFrame:
    """(id, start, n_tokens, ids_crc32[, ids array<int>]) of every document, from the file."""

    common.tune(segments.sparkSession)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for k in range(batch.num_rows):
                row = {n: batch.column(n)[k].as_py() for n in batch.schema.names}
                decoder = Decoder(*unpack_table(row["table"]))
                ids = np.concatenate([decoder.block(b) for b in row["blocks"]]).astype("<u4")
                doc_ids, sizes = unpack_docs(row["docs"], row["n_docs"])
                ends = np.cumsum(sizes)
                raw = memoryview(ids.tobytes())
                crc = [zlib.crc32(raw[4 * (e - s) : 4 * e]) for e, s in zip(ends.tolist(), sizes.tolist(), strict=True)]
                columns = [pa.array([row["part"]] * len(doc_ids), pa.int32()), pa.array([row["segment"]] * len(doc_ids), pa.int32()), pa.array(doc_ids, pa.int64()), pa.array(ends - sizes, pa.int64()), pa.array(sizes, pa.int64()), pa.array(crc, pa.int64())]
                names = ["part", "segment", "id", "offset", "n_tokens", "ids_crc32"]
                if with_ids:
                    columns.append(pa.ListArray.from_arrays(pa.array(np.concatenate([[0], ends]), pa.int32()), pa.array(ids.astype(np.int32))))
                    names.append("ids")
                yield pa.RecordBatch.from_arrays(columns, names=names)

    ddl = "part int, segment int, id long, offset long, n_tokens long, ids_crc32 long" + ", ids array<int>" * with_ids
    got = segments.select("part", "segment", "n_docs", "docs", "table", "blocks").mapInArrow(run, ddl)
    joined = got.join(starts(segments.select("part", "segment", "n_tokens")), ["part", "segment"])
    return joined.select(F.col("id").alias(id_col), (F.col("base") + F.col("offset")).alias("start"), "n_tokens", "ids_crc32", *["ids"] * with_ids)


def op1_rans_tokens(spark: SparkSession, sf_dir: str) -> DataFrame:
    segments = write(common.table(spark, sf_dir, "documents"), f"{common.shared_dir(spark)}/tokens")
    return read(segments, with_ids=False)
