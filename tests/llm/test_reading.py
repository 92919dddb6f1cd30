import random
import re
from collections import defaultdict

import numpy as np
import pytest
import regex
from pyspark.sql import functions as F

from lexispark.llm import reading

TEXTS = [
    "One two three. Four five! Six?",
    "No end",
    "A.b.c are words... Yes… 3.5 kg",
    "line one\nline two\r\n\r\nline three",
    "",
    "   ",
    "!!! ...",
    "中文。很好！",
    "Wait?! What. ",
    None,
    "wörter über straße",
    "a" * 100_000,
]


def model(text):
    words = regex.findall(r"\p{L}+", text)
    sentences = 0
    for line in re.split(r"\r\n|[\n\r\x0b\x0c\x1c-\x1e\x85  ]", text):
        for part in re.split(r"[.!?。！？…]+(?=\s|$)", line):
            sentences += bool(regex.search(r"\p{L}", part))
    return len(words), sum(len(w) > 6 for w in words), sentences


def test_surface(spark):
    df = spark.createDataFrame([(i, t, "x", 1.0) for i, t in enumerate(TEXTS)], "doc_id bigint, text string, words string, lix double")
    got = {r.doc_id: r for r in reading.surface(df).collect()}
    assert set(got) == {i for i, t in enumerate(TEXTS) if t is not None}
    for i, r in got.items():
        assert (r.n_words, r.n_long, r.n_sentences) == model(TEXTS[i])
        assert (r.lix is None) == (r.n_words == 0)


@pytest.fixture(scope="module")
def corpus(spark):
    """Easy texts of short words in short sentences, hard ones of long words in long sentences, and mixtures."""
    r = random.Random(4)
    easy = ["".join(r.choice("abcde") for _ in range(r.randrange(2, 5))) for _ in range(150)]
    hard = ["".join(r.choice("fghijklm") for _ in range(r.randrange(7, 13))) for _ in range(150)]
    rows = []
    for i in range(600):
        share = r.random()
        words = [r.choice(hard) if r.random() < share else r.choice(easy) for _ in range(60)]
        every = 4 + int(20 * share)
        rows.append((i, "".join(w + (". " if k % every == every - 1 else " ") for k, w in enumerate(words)), "en"))
    return spark.createDataFrame(rows, "doc_id bigint, text string, grade string").cache()


def test_level_of_unseen_texts(spark, corpus):
    """Words and weights come from all texts; a text whose sentence breaks are gone keeps its level, as its words do."""
    levels = reading.reading_levels(corpus).cache()
    assert levels.where("graded").agg(F.corr("level", "lix")).first()[0] > 0.9
    held = corpus.where("doc_id % 5 = 0").select((F.col("doc_id") + 10_000).alias("doc_id"), F.regexp_replace("text", r"\. .*$", "").alias("text"))
    both = corpus.where("doc_id % 5 <> 0").select("doc_id", "text").unionByName(held)
    got = reading.reading_levels(both).where("doc_id >= 10000 AND level IS NOT NULL")
    true = levels.select((F.col("doc_id") + 10_000).alias("doc_id"), F.col("lix").alias("true"))
    assert got.join(true, "doc_id").agg(F.corr("level", "true")).first()[0] > 0.6


def test_levels_come_from_the_other_half(spark, corpus):
    """A text's own measure moves neither its level nor its half's grades; the other half's does."""
    levels = {r.doc_id: r for r in reading.reading_levels(corpus).collect()}
    i = next(k for k, r in levels.items() if r.half == 0)
    other = corpus.withColumn("text", F.when(F.col("doc_id") == i, F.regexp_replace("text", r"\.", "")).otherwise(F.col("text")))
    again = {r.doc_id: r for r in reading.reading_levels(other).collect()}
    assert again[i].lix != levels[i].lix and again[i].half == 0
    grades = lambda d: {r.word: r.grade0 for r in reading.word_grades(reading.surface(d).withColumn("half", reading.half(F.col("doc_id"))).select(F.explode("words").alias("word"), "lix", "graded", "half")).collect()}
    assert grades(corpus) == grades(other)
    assert {r.half for r in levels.values()} == {0, 1}


def test_demanding(spark, corpus):
    levels = reading.reading_levels(corpus).cache()
    want = {r.doc_id for r in levels.where("graded AND lix >= 55").collect()}
    assert 20 < len(want) < 580 and {r.doc_id for r in reading.demanding(levels).collect()} == want
    bars = reading.proposal_bars(levels)
    rejected = [r for r in levels.where("graded").collect() if r.level < bars[r.half]]
    assert len(rejected) > 50  # by their words alone
    # The level decides: texts that it puts far below the bar are not found whatever their measure.
    low = levels.withColumn("level", F.when(F.col("doc_id") == min(want), F.lit(-1e9)).otherwise(F.col("level")))
    assert {r.doc_id for r in reading.demanding(low).collect()} == want - {min(want)}
    assert reading.proposal_bars(levels.limit(50)) == {0: float("-inf"), 1: float("-inf")}


def test_levels_against_a_plain_model(spark, corpus):
    """Grades, quantiles and least squares once more, by hand."""
    rows = {r.doc_id: r for r in reading.surface(corpus).withColumn("half", reading.half(F.col("doc_id"))).collect()}

    def quantile(values, share):
        values = sorted(values)
        return next(v for k, v in enumerate(values) if k + 1 >= len(values) * share)

    grade = {}
    for h in (0, 1):
        lists = defaultdict(list)
        for r in rows.values():
            if r.half != h and r.graded:
                for w in r.words:
                    lists[w].append(int(r.lix // reading.BAND))
        grade[h] = {w: quantile(v, reading.ACQUIRED) for w, v in lists.items() if len(v) >= reading.LEAST_TEXTS}
    features = {}
    for i, r in rows.items():
        own = [grade[r.half][w] for w in r.words if w in grade[r.half]]
        if own:
            features[i] = [1.0, *(quantile(own, q) for q in reading.QUANTILES)]
    weights = {}
    for h in (0, 1):
        x = np.array([features[i] for i, r in rows.items() if r.half == h and r.graded and i in features])
        y = np.array([r.lix for i, r in rows.items() if r.half == h and r.graded and i in features])
        weights[h] = np.linalg.lstsq(x.T @ x + np.eye(x.shape[1]) * 1e-6, x.T @ y, rcond=None)[0]
    for r in reading.reading_levels(corpus).collect():
        want = float(np.dot(features[r.doc_id], weights[1 - r.half])) if r.doc_id in features else None
        assert (r.level is None) == (want is None) and (want is None or r.level == pytest.approx(want, rel=1e-6, abs=1e-6))


def test_edges(spark):
    df = spark.createDataFrame([(i, t) for i, t in enumerate(TEXTS)] + [(None, "ab cd"), (3, "line one")], "doc_id bigint, text string")
    rows = reading.reading_levels(df).collect()
    assert len(rows) == len(TEXTS) - 1 + 2
    assert reading.demanding(reading.reading_levels(df)).count() == 0
    assert reading.reading_levels(df.limit(0)).count() == 0 and reading.demanding(reading.reading_levels(df.limit(0))).count() == 0
