"""Outputs as files of a bounded size, in Arrow, Parquet or JSON lines: a Spark data source with a commit.

    spark.dataSource.register(Shards)
    df.write.format("shards").mode("overwrite").option("fileFormat", "arrow").option("maxFileMB", 500).save(path)
    spark.read.format("shards").schema(df.schema).load(path)  # Arrow files

A task writes its rows as they come and begins a new file when the one at hand has the size
asked for (a file may exceed it by one slice of rows).  Files are written to a folder of
their own under ``_temporary``; only when all tasks are done the driver moves those of the
attempts that counted into place, in the order of partitions, and then writes ``_SUCCESS``.
So a task that is lost, run twice or fails leaves nothing in the result, and a job that
fails leaves what was there before (and, where other tasks of it ended later, unread files
under ``_temporary``, which the next overwriting job removes).  An empty table gives ``_SUCCESS`` alone.

``path`` is local or of any file system that Arrow knows.
"""

from __future__ import annotations

import json
import uuid
from collections.abc import Iterator
from dataclasses import dataclass

import pyarrow as pa
import pyarrow.parquet as pq
from pyspark import TaskContext
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql.datasource import DataSource, DataSourceArrowWriter, DataSourceReader, InputPartition, WriterCommitMessage

from textloom.sources.dump import file_system

FORMATS = ("arrow", "parquet", "jsonl")
COMPRESSION = {"arrow": {"none": None, "lz4": "lz4", "zstd": "zstd", "snappy": "lz4"}, "parquet": {"none": "none", "snappy": "snappy", "gzip": "gzip", "zstd": "zstd"}, "jsonl": {"none": None, "snappy": None, "gzip": "gzip", "zstd": "zstd"}}
ENDING = {"gzip": ".gz", "zstd": ".zst"}
MAX_MB, SLICES = 500, 16


class Lines:
    """JSON lines with the few methods of an Arrow writer."""

    def __init__(self, sink) -> None:
        self.sink = sink

    def write_batch(self, batch: pa.RecordBatch) -> None:
        self.sink.write("".join(json.dumps(row, ensure_ascii=False, default=str) + "\n" for row in batch.to_pylist()).encode("utf-8", "surrogatepass"))

    def close(self) -> None:
        pass


class Counted:
    """A stream that knows how many bytes went through it before compression and file system."""

    def __init__(self, sink) -> None:
        self.sink, self.size, self.closed = sink, 0, False

    def write(self, data) -> int:
        self.size += len(data)
        return self.sink.write(data)

    def flush(self) -> None:
        self.sink.flush()

    def close(self) -> None:
        if not self.closed:
            self.closed = True
            self.sink.close()


@dataclass
class Written(WriterCommitMessage):
    partition: int
    files: list[str]


class ShardWriter(DataSourceArrowWriter):
    def __init__(self, options: dict, overwrite: bool) -> None:
        self.path, self.overwrite = options["path"], overwrite
        self.kind = options.get("fileformat", "arrow").lower()
        if self.kind not in FORMATS:
            raise ValueError(f"file format {self.kind!r} is not one of {FORMATS}")
        chosen = options.get("compression", "zstd" if self.kind == "arrow" else "snappy").lower()
        if chosen not in COMPRESSION[self.kind]:
            raise ValueError(f"compression {chosen!r} is not one of {tuple(COMPRESSION[self.kind])} for {self.kind}")
        self.compression = COMPRESSION[self.kind][chosen]
        self.most = max(1, int(float(options.get("maxfilemb", MAX_MB)) * 1e6))
        self.job = uuid.uuid4().hex

    def _open(self, system, name: str, schema: pa.Schema) -> tuple[Counted, object]:
        if self.kind == "jsonl":
            sink = Counted(system.open_output_stream(name, compression=self.compression))
            return sink, Lines(sink)
        sink = Counted(system.open_output_stream(name, compression=None))
        if self.kind == "arrow":
            return sink, pa.ipc.new_file(pa.PythonFile(sink, "w"), schema, options=pa.ipc.IpcWriteOptions(compression=self.compression))
        return sink, pq.ParquetWriter(pa.PythonFile(sink, "w"), schema, compression=self.compression)

    def write(self, iterator: Iterator[pa.RecordBatch]) -> Written:
        system, root = file_system(self.path)
        partition = TaskContext.get().partitionId()
        attempt = f"{root}/_temporary/{self.job}/{uuid.uuid4().hex}"
        files: list[str] = []
        sink = writer = None
        try:
            for batch in iterator:
                step = max(1, batch.num_rows * self.most // SLICES // max(1, batch.nbytes))
                for at in range(0, batch.num_rows, step):
                    if writer is None:
                        if not files:
                            system.create_dir(attempt, recursive=True)
                        files.append(f"{attempt}/{len(files):05d}.{self.kind}{ENDING.get(self.compression, '') if self.kind == 'jsonl' else ''}")
                        sink, writer = self._open(system, files[-1], batch.schema)
                    writer.write_batch(batch.slice(at, step))
                    if sink.size >= self.most:
                        writer.close()
                        sink.close()
                        sink = writer = None
            if writer is not None:
                writer.close()
                sink.close()
        except BaseException:
            if sink is not None:
                sink.close()
            if files:
                system.delete_dir(attempt)
            raise
        return Written(partition, files)

    def commit(self, messages: list[Written | None]) -> None:
        system, root = file_system(self.path)
        from pyarrow import fs

        system.create_dir(root, recursive=True)
        if self.overwrite:
            for old in system.get_file_info(fs.FileSelector(root)):
                if not old.path.endswith("/_temporary"):
                    (system.delete_dir if old.type == fs.FileType.Directory else system.delete_file)(old.path)
        for message in sorted((m for m in messages if m), key=lambda m: m.partition):
            for k, name in enumerate(message.files):
                system.move(name, f"{root}/part-{message.partition:05d}-{k:05d}-{self.job}.{name.rsplit('/', 1)[-1].split('.', 1)[1]}")
        system.open_output_stream(f"{root}/_SUCCESS").close()
        self._clear(system, root)
        if self.overwrite and system.get_file_info(f"{root}/_temporary").type == fs.FileType.Directory:
            system.delete_dir(f"{root}/_temporary")

    def abort(self, messages: list[Written | None]) -> None:
        self._clear(*file_system(self.path))

    def _clear(self, system, root: str) -> None:
        """What this job's attempts have left; other jobs may be writing beside it."""
        from pyarrow import fs

        for place in (f"{root}/_temporary/{self.job}", f"{root}/_temporary"):
            if system.get_file_info(place).type == fs.FileType.Directory and (place.endswith(self.job) or not system.get_file_info(fs.FileSelector(place))):
                system.delete_dir(place)


@dataclass
class File(InputPartition):
    path: str


class ShardReader(DataSourceReader):
    def __init__(self, options: dict, schema) -> None:
        self.path, self.names = options["path"], schema.fieldNames()

    def partitions(self) -> list[File]:
        from pyarrow import fs

        system, root = file_system(self.path)
        files = sorted(f.path for f in system.get_file_info(fs.FileSelector(root)) if f.type == fs.FileType.File and f.path.endswith(".arrow"))
        return [File(f) for f in files] or [File("")]

    def read(self, partition: File) -> Iterator[pa.RecordBatch]:
        if partition.path:
            system, _ = file_system(self.path)
            with pa.ipc.open_file(system.open_input_file(partition.path)) as file:
                for k in range(file.num_record_batches):
                    yield file.get_batch(k).select(self.names)


class Shards(DataSource):
    @classmethod
    def name(cls) -> str:
        return "shards"

    def _options(self) -> dict:
        return {k.lower(): v for k, v in self.options.items()}

    def reader(self, schema) -> ShardReader:
        return ShardReader(self._options(), schema)

    def writer(self, schema, overwrite: bool) -> ShardWriter:
        return ShardWriter(self._options(), overwrite)


def write_shards(df: DataFrame, path: str, fmt: str = "arrow", max_mb: float = MAX_MB, compression: str | None = None, mode: str = "overwrite") -> None:
    df.sparkSession.dataSource.register(Shards)
    out = df.write.format("shards").mode(mode).option("fileFormat", fmt).option("maxFileMB", max_mb)
    (out.option("compression", compression) if compression else out).save(path)


def read_arrow(spark: SparkSession, path: str, schema) -> DataFrame:
    """The rows of Arrow files that ``write_shards`` has written."""
    spark.dataSource.register(Shards)
    return spark.read.format("shards").schema(schema).load(path)
