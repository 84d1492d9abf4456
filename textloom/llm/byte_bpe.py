"""Byte-level BPE encoding and decoding over Arrow batches.

The ``tokenizers`` library runs the merges over the byte alphabet; ids decode by
reversing the byte table.  Each text is handled whole; null counts as empty and
gives no ids; repeated rows give repeated results; an empty table gives an empty
result; further columns are ignored.
"""

from __future__ import annotations

import hashlib

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession

from textloom.llm import common
from textloom.llm.tokens import byte_pieces


def vocabulary() -> tuple[str, str]:
    """Default rank file and pre-token pattern; both are parameters of every operator here."""
    import public_tokenizers as public

    return public.path("byte_bpe_50k.tiktoken"), public.PATTERN


def encode(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text", ranks: str | None = None, pattern: str | None = None, offsets: bool = False) -> DataFrame:
    """(id, ids array<int>[, spans array<struct<start,end>>]) of every whole text."""
    default = vocabulary()
    path, pattern = ranks or default[0], pattern or default[1]

    def run(batch: pa.RecordBatch) -> pa.RecordBatch:
        pieces, texts = byte_pieces(path, pattern), common.texts(batch.column(1))
        if not offsets:
            coded = pieces.encode(texts)
            ends = np.cumsum([0, *(len(c) // 4 for c in coded)]).astype(np.int32)
            flat = pa.array(np.frombuffer(b"".join(coded), "<u4").astype(np.int32))
            return pa.RecordBatch.from_arrays([batch.column(0), pa.ListArray.from_arrays(ends, flat)], names=["id", "ids"])
        both = [pieces.encode_offsets(t) for t in texts]
        kind = pa.list_(pa.struct([("start", pa.int32()), ("end", pa.int32())]))
        spans = pa.array([[{"start": a, "end": b} for a, b in s] for _, s in both], kind)
        return pa.RecordBatch.from_arrays([batch.column(0), pa.array([i for i, _ in both], pa.list_(pa.int32())), spans], names=["id", "ids", "spans"])

    schema = "id long, ids array<int>" + ", spans array<struct<start:int,end:int>>" * offsets
    return common.map_batches(common.id_text(docs, id_col, text_col), run, schema).withColumnRenamed("id", id_col)


def decode(coded: DataFrame, id_col: str = "doc_id", ids_col: str = "ids", ranks: str | None = None, pattern: str | None = None) -> DataFrame:
    """(id, bytes, text): exact bytes, and their text with U+FFFD for what is not UTF-8."""
    default = vocabulary()
    path, pattern = ranks or default[0], pattern or default[1]

    def run(batch: pa.RecordBatch) -> pa.RecordBatch:
        pieces = byte_pieces(path, pattern)
        raw = [pieces.decode(np.asarray(x if x is not None else [], np.int64)) for x in batch.column(1).to_pylist()]
        return common.rows({"id": pa.int64(), "bytes": pa.binary(), "text": pa.string()}, id=batch.column(0), bytes=raw, text=[r.decode("utf-8", "replace") for r in raw])

    return common.map_batches(coded.select(coded[id_col].cast("long").alias("id"), coded[ids_col].alias("ids")), run, "id long, bytes binary, text string").withColumnRenamed("id", id_col)


def round_trip(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text", ranks: str | None = None, pattern: str | None = None) -> DataFrame:
    """Encode and decode in one pass: (id, n_tokens, ids_sha256, decoded_sha256)."""
    default = vocabulary()
    path, pattern = ranks or default[0], pattern or default[1]
    schema = {"id": pa.int64(), "n_tokens": pa.int64(), "ids_sha256": pa.string(), "decoded_sha256": pa.string()}

    def run(batch: pa.RecordBatch) -> pa.RecordBatch:
        pieces = byte_pieces(path, pattern)
        coded = pieces.encode(common.texts(batch.column(1)))
        return common.rows(
            schema,
            id=batch.column(0),
            n_tokens=[len(c) // 4 for c in coded],
            ids_sha256=[hashlib.sha256(c).hexdigest() for c in coded],
            decoded_sha256=[hashlib.sha256(pieces.decode(np.frombuffer(c, "<u4"))).hexdigest() for c in coded],
        )

    return common.map_batches(common.id_text(docs, id_col, text_col), run, "id long, n_tokens long, ids_sha256 string, decoded_sha256 string").withColumnRenamed("id", id_col)


def encode_checked(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text", ranks: str | None = None, pattern: str | None = None) -> DataFrame:
    """(id, n_tokens, ids array<int>, decodes): ids, and whether they decode to exactly the text's bytes."""
    default = vocabulary()
    path, pattern = ranks or default[0], pattern or default[1]

    def run(batch: pa.RecordBatch) -> pa.RecordBatch:
        pieces, texts = byte_pieces(path, pattern), common.texts(batch.column(1))
        coded = pieces.encode(texts)
        ends = np.cumsum([0, *(len(c) // 4 for c in coded)])
        flat = np.frombuffer(b"".join(coded), "<u4")
        same = [pieces.decode(flat[a:b]) == t.encode() for a, b, t in zip(ends[:-1], ends[1:], texts, strict=True)]
        ids = pa.ListArray.from_arrays(pa.array(ends, pa.int32()), pa.array(flat.astype(np.int32)))
        return pa.RecordBatch.from_arrays([batch.column(0), pa.array(np.diff(ends), pa.int64()), ids, pa.array(same)], names=["id", "n_tokens", "ids", "decodes"])

    return common.map_batches(common.id_text(docs, id_col, text_col), run, "id long, n_tokens long, ids array<int>, decodes boolean").withColumnRenamed("id", id_col)


def op2_byte_bpe(spark: SparkSession, sf_dir: str) -> DataFrame:
    return round_trip(common.table(spark, sf_dir, "documents"))
