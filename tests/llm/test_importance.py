import hashlib
import math
import random
import re
import zlib
from collections import Counter

from pyspark.sql import functions as F

from textloom.llm import importance


def lowered(text):
    return "".join(chr(ord(c) + 32) if "A" <= c <= "Z" else c for c in text or "")


def by_hand(docs, target, percent=25, seed=7, runs=2, buckets=10_000, least=20):
    """(n_features, weight, score) of each row, and the drawn rows in order."""
    words = lambda t: re.findall(r"[^\x00-\x2F\x3A-\x60\x7B-\x7F]+", lowered(t))
    grams = lambda ws: [" ".join(ws[i : i + k]) for k in range(1, runs + 1) for i in range(len(ws) - k + 1)]
    bucket = lambda f: zlib.crc32(f.encode()) % buckets
    s, t = (Counter(bucket(f) for x in texts for f in grams(words(x))) for texts in ([x for _, x in docs], target))
    total = [sum(c.values()) + buckets for c in (s, t)]
    gain = lambda b: math.floor(1000 * math.log((t[b] + 1) * total[0] / ((s[b] + 1) * total[1])))
    out = []
    for i, x in docs:
        fs = grams(words(x))
        weight = sum(gain(bucket(f)) for f in fs) // len(fs) if fs else 0
        h = int(hashlib.sha256(f"{seed}:{'' if i is None else i}".encode()).hexdigest()[:8], 16)
        out.append((len(fs), weight, weight + math.floor(-1000 * math.log(-math.log((h + 0.5) / 4294967296)))))
    able = [k for k, (_, x) in enumerate(docs) if len(words(x)) >= least]
    order = sorted(able, key=lambda k: (-out[k][2], docs[k][0] is None, docs[k][0] or 0))
    return out, order[: percent * len(able) // 100]


def corpus(n=150):
    rng = random.Random(4)
    vocabulary = ["data", "Model", "the", "of", "café", "日本", "x1", "42", "a"]
    some = [" ".join(rng.choice(vocabulary) for _ in range(rng.randrange(60))) for _ in range(n)]
    odd = [None, "", "...", "one", "two words", "tab\tline\nend \x00nul", "A" * 5000, "w, " * 20, "w, " * 19, some[3], some[3]]
    return list(enumerate([*some, *odd]))


def rows_of(spark, docs):
    return spark.createDataFrame([(i, t, 1, "x", 2.0, "y") for i, t in docs], "doc_id long, text string, rank int, bucket string, weight double, row string")


def check(spark, docs, target, **options):
    names = {"percent": "percent", "seed": "seed", "runs": "runs", "buckets": "buckets", "least": "least_words"}
    made = importance.resample(rows_of(spark, docs), spark.createDataFrame([(t,) for t in target], "text string"), **{names[k]: v for k, v in options.items()})
    assert made.columns == ["doc_id", "n_features", "weight", "score", "rank"]
    got = made.collect()
    values, drawn = by_hand(docs, target, **options)
    assert Counter((r["doc_id"], r["n_features"], r["weight"], r["score"]) for r in got) == Counter((i, *v) for (i, _), v in zip(docs, values, strict=True))
    ranked = sorted((r for r in got if r["rank"] is not None), key=lambda r: r["rank"])
    assert [r["rank"] for r in ranked] == list(range(1, len(drawn) + 1))
    assert [(r["doc_id"], r["score"]) for r in ranked] == [(docs[k][0], values[k][2]) for k in drawn]


def test_equals_plain_python(spark):
    check(spark, corpus(), ["the data model", "Café of data", None, "", "x1 42"])


def test_other_parameters(spark):
    check(spark, corpus(60), ["the data model of the data"], percent=60, seed=11, runs=3, buckets=50, least=5)
    check(spark, corpus(40), ["model"], runs=1, least=0, percent=100)


def test_repeated_rows_and_null_ids_are_each_drawn(spark):
    text = "the data of the model " * 8
    docs = [(7, text)] * 40 + [(None, text)] * 5 + [(8, text), (9, "short")]
    check(spark, docs, ["the data"], percent=90)


def test_empty_tables(spark):
    check(spark, corpus(30), [])
    check(spark, [], ["the data"])


def test_ranks_over_many_partitions(spark):
    rows = spark.range(0, 5000, 1, 13).select((F.col("id") * 7919 % 1000).alias("v"), "id")
    got = importance.ranked(rows, F.desc("v"), F.asc("id")).orderBy("rank").collect()
    assert [r["rank"] for r in got] == list(range(1, 5001))
    assert [(r["v"], r["id"]) for r in got] == sorted(((r["v"], r["id"]) for r in got), key=lambda x: (-x[0], x[1]))


def test_only_native_steps(spark):
    texts = spark.createDataFrame([(1, "a b")], "id long, text string")
    gains = spark.createDataFrame([(0, 1)], "bucket long, gain long")
    plan = importance.weigh(texts, gains)._jdf.queryExecution().toString()
    assert "BroadcastHashJoin" in plan and not re.search("Python|Arrow|Pandas", plan)
