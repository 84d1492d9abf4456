from textloom.sources import wiki


def test_pages_reach_workers_in_small_batches(spark, tmp_path):
    text = "word " * 20
    page = f"<page><title>A</title><ns>0</ns><id>1</id><revision><text>{text}</text></revision></page>"
    (tmp_path / "dump.xml").write_text(f"<mediawiki>{page}</mediawiki>")
    spark.conf.unset("spark.sql.execution.arrow.maxRecordsPerBatch")
    assert [r["title"] for r in wiki.read_wiki(spark, str(tmp_path / "dump.xml")).collect()] == ["A"]
    assert int(spark.conf.get("spark.sql.execution.arrow.maxRecordsPerBatch")) <= 512
