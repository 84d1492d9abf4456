import random
import re
import time

import pytest
from pyspark.sql import functions as F

from textloom.operators import wiki

CASES = {
    "a {{t|x={{u|{{v}}}}}} b": "a  b",
    "x {{open {{done}} y": "x {{open  y",
    "x }} y {{z}}": "x }} y ",
    "a<ref name=x>one {{t}} [[l]]</ref>b<ref name=x/>c<references/>d": "abcd",
    "a<ref>never closed, b": "anever closed, b",
    "a <!-- hidden > still --> b": "a  b",
    "{|\n! h\n|-\n| c || {{t}}\n{|\n| inner\n|}\n|}\nafter": "\nafter",
    "{|\n| never closed [[a|b]]": "{|\n| never closed b",
    "[[a]] [[b|c]] [[d|e|f]] [[g|]] [[]]": "a c e|f g| [[]]",
    "[[File:x.jpg|thumb|a [[b|c]] d]]e": "e",
    "[[Datei: y.png]]z [[file:q]]": "z ",
    "[[a|see [[b|c]] too]]": "see c too",
    "[[open [[b|c]]": "[[open c",
    "[http://x.example gone] [https://] [other]": " [https://] [other]",
    "'''bold''' ''it'' don't": "bold it don't",
    "== Head ==\ntext\n=a=\n==\n= b = c =\n===  x": "Head \ntext\na\n==\n= b = c =\n===  x",
    "1 < 2 > 0 <b>x</b> <> <": "1  0 x <> <",
    "[[Category:Things]] {{t|[[Category:In]]}}": "Category:Things ",
    "{{a|}} {{a|b|}}c": " c",
    "": "",
}


@pytest.mark.parametrize("raw", CASES)
def test_markup(raw):
    assert wiki.plain_text(raw) == CASES[raw]


def test_categories_can_go():
    assert wiki.plain_text("[[Category:Things]]a [[Category:X|y]]b [[c]]", drop_categories=True) == "a b c"


def test_flat_markup_gives_what_the_single_pass_rule_gives():
    parts = ["word", " ", "\n", "{{box|a=1}}", "x '''b''' y", "x ''i'' y", "[[Target|label]]", "[[Plain]]", "[http://x.example gone]", "<ref name=a>cite</ref>", "<b>bold</b>", "<br/>", "[[Category:T]]", "(x)", "\n== Head 1 ==\n", "|", "é", "1 = 2"]
    rng = random.Random(3)
    for _ in range(2000):
        raw = "".join(rng.choice(parts) for _ in range(rng.randrange(12)))
        want = raw
        for pattern, new in wiki.MARKUP:
            want = re.sub(re.sub(r"\\x\{([0-9A-F]+)\}", lambda m: chr(int(m[1], 16)), pattern).replace("(?md)", "(?m)"), new.replace("$", "\\"), want)
        assert wiki.plain_text(raw) == want, raw


@pytest.mark.parametrize("part", ["{{", "}}", "[[", "]]", "[[a|", "{|\n", "\n{|", "|}", "<", ">", "<ref>", "<ref name=", "<!--", "[http://x ", "'", "''", "=", "= \n", "=   ", "[[File:x|", "{{a|[[b|", "<ref>{{", "\n=a"])
def test_opened_markup_takes_linear_time(part):
    text = part * (1_000_000 // len(part))
    began = time.time()
    wiki.plain_text(text)
    wiki.plain_text(text + "x" + "]]" * 1000 + "}}" * 1000)
    assert time.time() - began < 10


def test_any_depth():
    deep = 100_000
    assert wiki.plain_text("a" + "{{x|" * deep + "}}" * deep + "b") == "ab"
    assert wiki.plain_text("[[x|" * deep + "core" + "]]" * deep) == "core"
    assert wiki.plain_text("\n{|" * 1000 + "\n|}" * 1000 + "b") == "\n" * 1 + "b"


def test_broken_markup_never_fails():
    rng = random.Random(5)
    parts = ["{{", "}}", "{|", "\n{|", "|}", "|", "[[", "]]", "<", ">", "<ref>", "</ref>", "<!--", "-->", "'''", "=", "\n", "[http://a", "]", "File:", "x", " "]
    for _ in range(5000):
        wiki.plain_text("".join(rng.choice(parts) for _ in range(30)))


def test_column(spark):
    rows = [(0, None), (1, ""), (2, "a {{t|{{u}}}} ( ) , [[b|c]] .\n\n\n\nd"), (3, "x " * 50_000)]
    got = {r[0]: r[1] for r in spark.createDataFrame(rows, "i int, text string").select("i", wiki.remove_markup(F.col("text"))).collect()}
    assert got == {0: None, 1: "", 2: "a, c.\n\nd", 3: ("x " * 50_000).strip()}
