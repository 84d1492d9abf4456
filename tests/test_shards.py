import gzip
import json
import os

import pyarrow as pa
import pytest
from pyspark.sql import functions as F

from textloom import shards

SCHEMA = "id long, text string, tokens array<int>, score double"


def rows(n):
    return [(i, None if i % 17 == 0 else f"text {i} é " + "x" * (i % 300), [i, i + 1] if i % 5 else [], float(i) / 3) for i in range(n)]


def names(path):
    return sorted(x for x in os.listdir(path) if not x.startswith("."))


def test_arrow_round_trip_in_files_of_a_bounded_size(spark, tmp_path):
    df = spark.createDataFrame(rows(4000), SCHEMA).repartition(3)
    shards.write_shards(df, str(tmp_path / "a"), "arrow", max_mb=0.05, compression="none")
    made = [x for x in names(tmp_path / "a") if x.endswith(".arrow")]
    assert len(made) > 6 and "_SUCCESS" in names(tmp_path / "a") and "_temporary" not in names(tmp_path / "a")
    assert all(os.path.getsize(tmp_path / "a" / x) < 2 * 50_000 for x in made)
    assert sorted(map(tuple, shards.read_arrow(spark, str(tmp_path / "a"), df.schema).collect()), key=str) == sorted(map(tuple, df.collect()), key=str)
    assert shards.read_arrow(spark, str(tmp_path / "a"), "score double, id long").agg(F.sum("id")).first()[0] == sum(range(4000))


@pytest.mark.parametrize("compression", ["none", "snappy", "gzip"])
def test_parquet_and_json_lines(spark, tmp_path, compression):
    df = spark.createDataFrame(rows(500), SCHEMA).repartition(2)
    shards.write_shards(df, str(tmp_path / "p"), "parquet", 0.02, compression)
    shards.write_shards(df, str(tmp_path / "j"), "jsonl", 0.02, compression)
    assert len(names(tmp_path / "p")) > 3 and len(names(tmp_path / "j")) > 3
    want = sorted(map(tuple, df.collect()), key=str)
    assert sorted(map(tuple, spark.read.parquet(str(tmp_path / "p")).collect()), key=str) == want
    lines = []
    for x in names(tmp_path / "j"):
        if x != "_SUCCESS":
            assert x.endswith(".jsonl.gz" if compression == "gzip" else ".jsonl")
            with (gzip.open if x.endswith(".gz") else open)(tmp_path / "j" / x, "rt") as f:
                lines += [json.loads(line) for line in f]
    assert sorted((tuple(x.values()) for x in lines), key=str) == [tuple(r[:2] + (r[2],) + r[3:]) for r in want]


def test_a_failed_task_leaves_what_was_there(spark, tmp_path):
    path = str(tmp_path / "a")
    shards.write_shards(spark.createDataFrame(rows(50), SCHEMA), path)
    before = names(path)

    @F.udf("double")
    def broken(i):
        if i == 1999:
            raise RuntimeError("lost")
        return float(i)

    df = spark.createDataFrame(rows(2000), SCHEMA).repartitionByRange(4, "id").withColumn("score", broken("id"))
    with pytest.raises(Exception, match="lost"):
        shards.write_shards(df, path, max_mb=0.01)
    assert [x for x in names(path) if x != "_temporary"] == before and shards.read_arrow(spark, path, SCHEMA).count() == 50
    shards.write_shards(df.drop("score").withColumn("score", F.lit(1.0)), path)
    assert "_temporary" not in names(path) and shards.read_arrow(spark, path, SCHEMA).count() == 2000


def test_attempts_that_do_not_count_leave_nothing(tmp_path, monkeypatch):
    """The same partition written twice, one attempt cut off in the middle: the commit takes the one it was told of."""
    monkeypatch.setattr(shards.TaskContext, "get", classmethod(lambda cls: type("C", (), {"partitionId": lambda self: 0})()))
    writer = shards.ShardWriter({"path": str(tmp_path / "a"), "maxfilemb": "0.001"}, False)
    batches = [pa.RecordBatch.from_pydict({"id": list(range(k, k + 300))}) for k in range(0, 1500, 300)]

    def cut():
        yield from batches[:3]
        raise OSError("executor lost")

    with pytest.raises(OSError):
        writer.write(cut())
    assert not os.path.exists(tmp_path / "a") or not any(files for _, _, files in os.walk(tmp_path / "a"))
    writer.write(iter(batches))
    message = writer.write(iter(batches))
    assert len(message.files) > 1 and [x for x in names(tmp_path / "a")] == ["_temporary"]
    writer.commit([message, None])
    got = [i for x in names(tmp_path / "a") if x.endswith(".arrow") for i in pa.ipc.open_file(str(tmp_path / "a" / x)).read_all()["id"].to_pylist()]
    assert got == list(range(1500)) and "_temporary" not in names(tmp_path / "a")


def test_modes_and_empty_tables(spark, tmp_path):
    path = str(tmp_path / "a")
    df = spark.createDataFrame(rows(20), SCHEMA)
    for mode, want in (("append", 20), ("append", 40), ("overwrite", 20)):
        shards.write_shards(df, path, mode=mode)
        assert shards.read_arrow(spark, path, SCHEMA).count() == want
    shards.write_shards(df.limit(0), path)
    assert names(path) == ["_SUCCESS"] and shards.read_arrow(spark, path, SCHEMA).collect() == []
    with pytest.raises(Exception, match="csv"):
        shards.write_shards(df, path, "csv")


def test_processed_documents_in_every_format(spark, tmp_path):
    from textloom import sinks

    df = spark.createDataFrame([(str(i), f"t{i}", "text " * 50, [1, 2, 3]) for i in range(300)], "id string, title string, text string, tokens array<int>").repartition(2)
    sinks.write_processed(df, str(tmp_path / "a"), "arrow")
    sinks.write_processed(df, str(tmp_path / "p"), "parquet", "gzip", max_mb=0.005)
    assert sorted(map(tuple, shards.read_arrow(spark, str(tmp_path / "a"), df.schema).collect())) == sorted(map(tuple, df.collect()))
    assert spark.read.parquet(str(tmp_path / "p")).agg(F.sum("token_count")).first()[0] == 900 and len(names(tmp_path / "p")) > 3
    with pytest.raises(ValueError):
        sinks.write_processed(df, str(tmp_path / "x"), "csv")
