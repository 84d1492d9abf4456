import bz2
import io
import random

import pytest

from textloom.sources import dump, wiki


def page(i, rng):
    body = "".join(rng.choice(["word ", "é ", "&lt;page&gt; ", "日本 ", "\n", "x" * 50]) for _ in range(rng.randrange(60)))
    return f"  <page>\n    <title>T{i}</title>\n    <ns>{i % 3}</ns>\n    <id>{1000 - i}</id>\n" + ('    <redirect title="Else" />\n' if i % 7 == 0 else "") + f"    <revision><id>5</id><text xml:space=\"preserve\">{body}</text></revision>\n  </page>\n"


def streams(parts):
    return b"".join(bz2.compress(p.encode()) for p in parts)


@pytest.fixture(scope="module")
def dumps(tmp_path_factory):
    """The same pages: plain, in one stream, in streams of whole pages, and in streams cut anywhere."""
    rng, folder = random.Random(1), tmp_path_factory.mktemp("dumps")
    made = [page(i, rng) for i in range(120)]
    head, end = "<mediawiki xmlns='http://www.mediawiki.org/xml/export-0.11/'><siteinfo/>\n", "</mediawiki>\n"
    whole = head + "".join(made) + end
    raw, cuts = whole.encode(), sorted(rng.sample(range(len(whole.encode())), 60))
    files = {
        "plain.xml": raw,
        "one.xml.bz2": bz2.compress(raw),
        "many.xml.bz2": streams([head, *("".join(made[k : k + 5]) for k in range(0, 120, 5)), end]),
        "cut.xml.bz2": b"".join(bz2.compress(raw[a:b]) for a, b in zip([0, *cuts], [*cuts, len(raw)])),
    }
    for name, data in files.items():
        (folder / name).write_bytes(data)
    return folder


@pytest.mark.parametrize("name", ["plain.xml", "one.xml.bz2", "many.xml.bz2", "cut.xml.bz2"])
@pytest.mark.parametrize("size", [1 << 30, 3000, 517])
def test_any_ranges_hold_every_page_once_and_in_order(dumps, name, size):
    reader = dump.DumpReader({"path": str(dumps / name), "partitionBytes": size})
    rows = [r for p in reader.partitions() for r in reader.read(p)]
    assert [r[0] for r in rows] == [f"T{i}" for i in range(120)]
    assert [(r[5], r[6], r[7]) for r in rows] == sorted((r[5], r[6], r[7]) for r in rows)
    if size < 1000 and name != "one.xml.bz2":
        assert len({r[6] for r in rows}) > 15


def test_equal_to_the_plain_read(spark, dumps):
    names = ["title", "page_id", "namespace", "redirect", "raw"]
    for name in ("plain.xml", "many.xml.bz2"):
        want = sorted(map(str, wiki.read_pages(spark, str(dumps / name)).selectExpr("title", "page_id", "namespace", "redirect", "coalesce(raw, '')").collect()))
        got = dump.read_dump(spark, str(dumps / name), 2000)
        assert got.rdd.getNumPartitions() > 3
        assert sorted(map(str, got.selectExpr(*names[:4], "coalesce(raw, '') as `coalesce(raw, )`").collect())) == want


def test_articles_in_file_order(spark, dumps):
    """Page ids fall along these files, so the order of ids is the wrong one."""
    for path in (dumps / "many.xml.bz2", dumps / "cut.xml.bz2"):
        every = [r["page_id"] for r in dump.read_dump(spark, str(path), 1500).orderBy("file", "stream", "seq").collect()]
        assert every == sorted(every, reverse=True)
    first = [r["page_id"] for r in wiki.read_wiki(spark, str(dumps / "many.xml.bz2"), max_articles=5).collect()]
    rest = {r["page_id"] for r in wiki.read_wiki(spark, str(dumps / "many.xml.bz2")).collect()}
    assert first == sorted(rest, reverse=True)[:5]


def test_broken_and_empty_files(spark, tmp_path):
    (tmp_path / "a.xml").write_text("<mediawiki><page><title>A</title></page><page><title>B<title></page><page><title>C</title><id>x</id><ns/></page><page><title>cut")
    (tmp_path / "b.xml").write_text("")
    (tmp_path / "_SUCCESS").write_text("")
    (tmp_path / "c.xml.bz2").write_bytes(bz2.compress(b""))
    got = dump.read_dump(spark, str(tmp_path)).orderBy("seq").collect()
    assert [(r["title"], r["page_id"], r["namespace"], r["raw"]) for r in got] == [("A", 0, 0, None), ("C", 0, 0, None)]
    (tmp_path / "empty").mkdir()
    assert dump.read_dump(spark, str(tmp_path / "empty")).collect() == []
    with pytest.raises(Exception, match="nowhere"):
        dump.read_dump(spark, str(tmp_path / "nowhere")).collect()


def test_stream_headers_over_chunk_borders(monkeypatch):
    data = b"x" * 95 + bz2.compress(b"one") + bz2.compress(b"two" * 100)
    for chunk in (10, 11, 13, 64, 1000):
        monkeypatch.setattr(dump, "CHUNK", chunk)
        assert dump.first_stream(io.BytesIO(data), 3, 96) == 95 and dump.first_stream(io.BytesIO(data), 3, 95) is None
        assert dump.first_stream(io.BytesIO(data), 96, 999) == 95 + len(bz2.compress(b"one"))
        assert b"".join(x for _, x, _ in dump.unpacked(io.BytesIO(data), 0, 999)) == b"one" + b"two" * 100
