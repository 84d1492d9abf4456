import json

import pytest

from textloom import showcase


@pytest.mark.parametrize("stage", sorted(showcase.STAGES))
def test_stages_of_a_table(spark, tmp_path, capsys, stage):
    texts = ["See https://x.example/a and u@mail.example.org, it is here. " * 6] * 2 + ["Some other text about the sea and the men. " * 8, None, ""]
    (tmp_path / "d.jsonl").write_text("".join(json.dumps({"text": t}) + "\n" for t in texts))
    made = showcase.show(spark, stage, str(tmp_path / "d.jsonl"), 10)
    rows = made.collect()
    assert len(rows) == 5 and "|" in capsys.readouterr().out
    if stage == "cleaning":
        assert rows[0]["urls_removed"] == 6 and "@" not in rows[0]["cleaned"]
    if stage == "deduplication":
        assert sum(r["is_duplicate"] for r in rows) == 2 and sum(r["near_original"] is not None for r in rows) == 2
    if stage == "quality":
        assert [r["reason"] for r in rows].count("too_short") == 4
    if stage == "tokenization":
        assert all(r["decoded"] == (r["text"] or "") for r in rows)


def test_the_command_line(spark, tmp_path, capsys):
    assert showcase.main(["cleaning"]) == 0 and "cleaned" in capsys.readouterr().out
    (tmp_path / "d.xml").write_text("<mediawiki><page><title>A</title><ns>0</ns><id>3</id><revision><text>" + "Some '''words''' of text. " * 9 + "</text></revision></page></mediawiki>")
    assert showcase.main(["ingestion", "--input", str(tmp_path / "d.xml"), "--rows", "2"]) == 0 and "word_count" in capsys.readouterr().out
    with pytest.raises(SystemExit):
        showcase.main(["ingestion"])
