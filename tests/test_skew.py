import random

import pytest
from pyspark.sql import functions as F

from lexispark.operators.postings import distinct_postings
from lexispark.operators.skew import heavy_keys, key_counts, skew_safe_join

SCHEMA = "seg_no int, field string, term string, doc_id bigint, frequency int, postings int, key_kind string"


def rows(n=3000, seed=1):
    r = random.Random(seed)
    out = [(1, "title", "hot" if r.random() < 0.4 else f"t{r.randrange(400)}", r.randrange(300) if r.random() < 0.7 else 7, r.randrange(1, 4), 0, "x") for _ in range(n)]
    out += r.sample(out, n // 5) + [(1, "title", None, 1, 1, 0, "x"), (1, None, "a", 1, 1, 0, "x"), (1, "title", "a", None, 1, 0, "x"), (1, "tags", "hot", 1, None, 0, "x"), (1, "title", "", 2, 1, 0, "x")]
    return out


def once(data):
    seen = {}
    for _, f, t, d, n, *_ in data:
        if None not in (f, t, d):
            seen[f, t, d] = max(seen.get((f, t, d), 0), n or 0)
    return seen


def test_counts_against_brute_force(spark):
    data = rows()
    want = once(data)
    df = spark.createDataFrame(data, SCHEMA).repartition(5)
    assert {(r.field, r.term, r.doc_id): r.frequency for r in distinct_postings(df).collect()} == want
    counts = {(r.key_kind, r.key_name): (r.postings, r.occurrences) for r in key_counts(df).collect()}
    expected = {("all", None): (len(want), sum(want.values()))}
    for (f, t, d), n in want.items():
        for k in (("term", f"{f}:{t}"), ("doc", str(d))):
            a, b = expected.get(k, (0, 0))
            expected[k] = a + 1, b + n
    assert counts == expected
    heavy = {(r.key_kind, r.key_name) for r in heavy_keys(df).collect()}
    assert heavy == {k for k, (n, _) in expected.items() if k[0] != "all" and n * 100 > len(want)} and ("term", "title:hot") in heavy


def test_empty(spark):
    df = spark.createDataFrame([], SCHEMA)
    assert key_counts(df).count() == 0 and heavy_keys(df).count() == 0


def test_join_with_a_hot_key(spark):
    facts = spark.createDataFrame([(i, "hot" if i % 3 else f"k{i}") for i in range(6000)] + [(9, None)], "id int, k string")
    stats = facts.where("k IS NOT NULL").groupBy("k").agg(F.count("*").alias("n"))
    got = skew_safe_join(facts, stats, ["k"], "n", 6000)
    assert got.count() == 6000 and got.where("k = 'hot'").agg(F.min("n")).first()[0] == 4000


@pytest.mark.parametrize("n", [1, 5])
def test_ties_at_the_bar_are_not_heavy(spark, n):
    df = spark.createDataFrame([(1, "f", f"t{i}", i, n, 0, "") for i in range(100)], SCHEMA)
    assert heavy_keys(df).count() == 0  # each holds exactly 1 %
