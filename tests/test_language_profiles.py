import math
import random
from collections import Counter

import pytest
from pyspark.sql import functions as F

from textloom.operators import language

DATA = "/root/testdata/sf0.01/documents.parquet"


@pytest.fixture(scope="module")
def corpus(spark):
    return spark.read.parquet(DATA).withColumn("held_out", F.crc32(F.col("doc_id").cast("string")) % 4 == 2).cache()


@pytest.fixture(scope="module")
def profiles(corpus):
    return language.train_profiles(corpus.where("not held_out"))


def test_counts_equal_plain_python(spark):
    rows = [("en", "The sea, the sea!"), ("de", "Das Meer 12 ist groß"), ("en", "no"), (None, "x"), ("fr", None), ("en", "The sea, the sea!")]
    got = language.train_profiles(spark.createDataFrame(rows, "lang string, text string").repartition(3))
    assert got.languages == ["de", "en"]
    counts = {lang: Counter(b for x, t in rows if x == lang and t for b in language.grams(t).tolist()) for lang in got.languages}
    for k, lang in enumerate(got.languages):
        total = sum(counts[lang].values()) + language.SMOOTHING * language.BUCKETS
        for b in [*counts[lang], 5, 77]:
            assert got.weights[b, k] == pytest.approx(math.log((counts[lang][b] + language.SMOOTHING) / total), rel=1e-5)


def test_grams_are_runs_of_letters():
    assert len(language.grams("ab")) == 4 + 3 + 2  # " ab "
    assert language.grams("AB").tolist() == language.grams(" ab!").tolist() and len(language.grams("12 -")) == 0


def test_held_out_accuracy_is_above_the_word_lists(corpus, profiles):
    held = corpus.where("held_out")
    for words in (1_000_000, 12, 5):
        cut = held.select("lang", F.array_join(F.slice(F.split("text", r"\s+"), 1, words), " ").alias("text"))
        judged = cut.select("lang", language.detect(F.col("text")).alias("lists"), language.identify(F.col("text"), profiles, 0.0)["lang"].alias("trained"))
        right = judged.agg(F.avg((F.col("lists") == F.col("lang")).cast("double")).alias("lists"), F.avg((F.col("trained") == F.col("lang")).cast("double")).alias("trained")).first()
        assert right["trained"] >= right["lists"] and right["trained"] > 0.8


def test_unknown_is_calibrated(corpus, profiles):
    """Texts that are called a language with confidence c are so at least about as often; others are unknown."""
    held = corpus.where("held_out").select("lang", F.array_join(F.slice(F.split("text", r"\s+"), 1, 4), " ").alias("text"))
    rows = held.withColumn("x", language.identify(F.col("text"), profiles, 0.0)).select("lang", "x.*").where("x.lang <> 'unknown'").collect()
    sure = [r for r in rows if r[2] >= 0.9]
    assert len(sure) > 20 and sum(r[0] == r[1] for r in sure) / len(sure) >= 0.9
    rng = random.Random(1)
    odd = ["".join(chr(rng.randrange(0x4E00, 0x9000)) for _ in range(60)), "zqxj wvkq xzzq jqwx kkqz vvwx qqzj xwkv zzxq jjqw " * 5, "12345 67 !!", "a", "", None]
    assert [profiles.judge(t)[0] for t in odd] == ["unknown"] * len(odd)


def test_little_or_nothing(spark, profiles):
    none = language.train_profiles(spark.createDataFrame([], "lang string, text string"))
    assert none.judge("any text at all") == ("unknown", 0.0)
    empty = spark.createDataFrame([], "text string")
    assert empty.select(language.identify(F.col("text"), profiles)).collect() == []
    with pytest.MonkeyPatch.context() as m:
        m.setattr(language, "MAX_LANGUAGES", 2)
        with pytest.raises(ValueError):
            language.train_profiles(spark.createDataFrame([(str(i), "x") for i in range(5)], "lang string, text string"))
