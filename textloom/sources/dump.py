"""MediaWiki dumps as a Spark data source that reads one file in many partitions, in file order.

A partition is a range of bytes.  In a dump packed as many bzip2 streams one after another
it takes the streams that begin in its range, found by their header; in a plain file the
range itself; a file of a single stream is one partition.  A page belongs to where its first
tag begins, and is read on beyond the end of a range until it is whole, so ranges and
streams may cut pages anywhere.  Every page knows its file, the place of its stream (or
range) and its number there: this is the order of the file.

    spark.dataSource.register(WikiDump)
    spark.read.format("wikidump").option("partitionBytes", 16 << 20).load(path)

``path`` is a file or a folder (its files by name; hidden ones and those that begin with
``_`` are left out), local or of any file system that Arrow knows.  A page that is not
well-formed is left out, as is one without its end; a file without pages gives none.
"""

from __future__ import annotations

import bz2
import re
from collections.abc import Iterator
from dataclasses import dataclass
from xml.etree import ElementTree

from pyspark.sql import SparkSession
from pyspark.sql.datasource import DataSource, DataSourceReader, InputPartition

SCHEMA = "title string, page_id long, namespace int, redirect string, raw string, file string, stream long, seq long"
#: The header of a bzip2 stream and of its first block.
STREAM = re.compile(rb"BZh[1-9]1AY&SY")
HEADER = 10
CHUNK, PARTITION_BYTES = 1 << 20, 32 << 20
FIRST, LAST = b"<page>", b"</page>"


def file_system(path: str):
    """(file system, path in it) of an address."""
    from pyarrow import fs

    if "://" not in path:
        return fs.LocalFileSystem(), path.removeprefix("file:")
    return fs.FileSystem.from_uri(path)


@dataclass
class Range(InputPartition):
    path: str
    start: int
    stop: int
    name: str


def first_stream(file, start: int, stop: int) -> int | None:
    """The first place from ``start`` and before ``stop`` where a stream begins."""
    at, tail = start, b""
    while at - len(tail) < stop:
        file.seek(at)
        got = file.read(CHUNK)
        if not got:
            return None
        m = STREAM.search(tail + got)
        if m:
            place = at - len(tail) + m.start()
            return place if place < stop else None
        tail = (tail + got)[-(HEADER - 1) :]
        at += len(got)
    return None


def unpacked(file, start: int, stop: int) -> Iterator[tuple[int, bytes, bool]]:
    """(place of its stream, bytes, whether the stream begins before ``stop``), from the first stream on to the end."""
    at = first_stream(file, start, stop)
    if at is None:
        return
    file.seek(at)
    packed = file.read(CHUNK)
    while packed:
        reader, read = bz2.BZ2Decompressor(), 0
        while not reader.eof and packed:
            yield at, reader.decompress(packed), at < stop
            read += len(packed) - len(reader.unused_data)
            packed = reader.unused_data if reader.eof else file.read(CHUNK)
        at += read
        packed = packed or file.read(CHUNK)
        if packed and len(packed) < HEADER:
            packed += file.read(CHUNK)
        if not STREAM.match(packed):  # the end, or an empty last stream
            return


def plain(file, start: int, stop: int) -> Iterator[tuple[int, bytes, bool]]:
    file.seek(start)
    at = start
    while got := file.read(min(CHUNK, stop - at) if at < stop else CHUNK):
        yield start, got, at < stop
        at += len(got)


def pages(chunks: Iterator[tuple[int, bytes, bool]]) -> Iterator[tuple[int, bytes]]:
    """(place of its stream, XML) of every page that begins in a chunk of this range's own."""
    held, inside, sought, place, tail = bytearray(), False, 0, 0, (0, 0)
    for at, chunk, own in chunks:
        if not own and not inside and not held:
            return
        tail = (len(held), place if held else at) if not inside else (0, at)
        held += chunk
        while True:
            if not inside:
                i = held.find(FIRST)
                if i < 0:
                    del held[: max(0, len(held) - len(FIRST) + 1)]
                    place = at
                    break
                if not own and i >= tail[0]:
                    return
                place = tail[1] if i < tail[0] else at
                del held[:i]
                inside, sought, tail = True, len(FIRST), (0, at)
            j = held.find(LAST, max(len(FIRST), sought - len(LAST)))
            if j < 0:
                sought = len(held)
                break
            yield place, bytes(held[: j + len(LAST)])
            del held[: j + len(LAST)]
            inside = False
        if not own and not inside:
            return


def page_row(xml: bytes) -> tuple | None:
    try:
        page = ElementTree.fromstring(xml)
    except ElementTree.ParseError:
        return None
    number = lambda name: int(t) if (t := (page.findtext(name) or "").strip()).lstrip("-").isdigit() else 0
    redirect, revision = page.find("redirect"), page.find("revision")
    return page.findtext("title"), number("id"), number("ns"), redirect.get("title") if redirect is not None else None, revision.findtext("text") if revision is not None else None


class DumpReader(DataSourceReader):
    def __init__(self, options: dict) -> None:
        self.path = options["path"]
        self.size = max(1, int(options.get("partitionbytes") or options.get("partitionBytes") or PARTITION_BYTES))

    def partitions(self) -> list[Range]:
        from pyarrow import fs

        system, path = file_system(self.path)
        info = system.get_file_info(path)
        if info.type == fs.FileType.NotFound:
            raise FileNotFoundError(self.path)
        files = [info] if info.type == fs.FileType.File else system.get_file_info(fs.FileSelector(path))
        files = sorted((f for f in files if f.type == fs.FileType.File and not f.base_name.startswith(("_", "."))), key=lambda f: f.path)
        return [Range(f.path, at, min(f.size, at + self.size), f.base_name) for f in files for at in range(0, f.size, self.size)] or [Range("", 0, 0, "")]

    def read(self, partition: Range) -> Iterator[tuple]:
        if not partition.path:
            return
        system, _ = file_system(self.path)
        with system.open_input_file(partition.path) as file:
            chunks = (unpacked if partition.name.endswith(".bz2") else plain)(file, partition.start, partition.stop)
            seq = 0
            for place, xml in pages(chunks):
                row = page_row(xml)
                if row:
                    yield (*row, partition.name, place, seq)
                seq += 1


class WikiDump(DataSource):
    @classmethod
    def name(cls) -> str:
        return "wikidump"

    def schema(self) -> str:
        return SCHEMA

    def reader(self, schema) -> DumpReader:
        return DumpReader(dict(self.options))


def read_dump(spark: SparkSession, path: str, partition_bytes: int = PARTITION_BYTES):
    """Every page with its place: (title, page_id, namespace, redirect, raw, file, stream, seq)."""
    spark.dataSource.register(WikiDump)
    return spark.read.format("wikidump").option("partitionBytes", partition_bytes).load(path)
