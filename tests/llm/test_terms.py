import math
import random
from collections import Counter, defaultdict

import pyarrow as pa
import pytest
from hypothesis import given, settings
from hypothesis import strategies as st

from pyspark.sql import functions as F

from lexispark.llm import distinct_weight, termcount

SCHEMA = "seg_no int, field string, term string, doc_id bigint, frequency int, n int, documents string, prefix string"


def data():
    r = random.Random(5)
    rows = []
    for _ in range(4000):
        term = "hot" if r.random() < 0.35 else r.choice("abcé中") * r.randrange(3) + f"{r.randrange(600)}"
        rows.append((1, r.choice(["title", "tags"]), term, r.randrange(200), r.randrange(1, 6), 0, "x", "y"))
    seen = {}
    rows = [x for x in rows if seen.setdefault(x[1:4], x) is x]
    rows += r.sample(rows, 500)
    return [*rows, (1, "title", None, 1, 1, 0, "", ""), (1, None, "q", 1, 1, 0, "", ""), (1, "title", "q", None, 1, 0, "", ""), (1, "title", "", 3, 2, 0, "", ""), (1, "title", "w" * 5000, 3, None, 0, "", "")]


def once(rows):
    out = {}
    for _, f, t, d, n, *_ in rows:
        if None not in (f, t, d):
            out[f, t, d] = max(out.get((f, t, d), 0), n or 0)
    return out


@pytest.fixture(params=["usual", "tiny"])
def limits(request, monkeypatch):
    """The same results when tries burst, spill and are routed at almost every term."""
    if request.param == "tiny":
        for name, value in (("BURST", 2), ("SPILL", 50), ("ROUTE_TERMS", 10), ("_BLOCK", 100)):
            monkeypatch.setattr(termcount, name, value)


def test_counts_against_brute_force(spark, limits):
    rows = data()
    postings = once(rows)
    want = defaultdict(lambda: [0, 0])
    fields = defaultdict(set)
    for (f, t, d), n in postings.items():
        want[f, t][0] += n
        want[f, t][1] += 1
        fields[f].add(d)
    df = spark.createDataFrame(rows, SCHEMA).repartition(4)
    got = termcount.marked_terms(df).collect()
    assert {(r.field, r.term): [r.occurrences, r.documents] for r in got} == dict(want) and len(got) == len(want)
    for r in got:
        common = r.documents * 100 > 20 * len(fields[r.field])
        assert r["mark"] == ("common" if common else "rare" if r.documents == 1 else None)


def test_no_postings(spark):
    df = spark.createDataFrame([], SCHEMA)
    assert termcount.marked_terms(df).count() == 0 and distinct_weight.log_entropy(df).count() == 0


@settings(max_examples=200, deadline=None)
@given(st.lists(st.tuples(st.text(alphabet="ab中", max_size=6), st.integers(1, 9)), max_size=60), st.integers(1, 5))
def test_trie(items, burst):
    before, termcount.BURST = termcount.BURST, burst
    try:
        trie = termcount.BurstTrie()
        want = defaultdict(lambda: [0, 0])
        for term, n in items:
            trie.add(term, n, 1)
            want[term][0] += n
            want[term][1] += 1
        got = {p + s: c for p, own in trie.containers() for s, c in own.items()}
        assert got == dict(want) and trie.size == len(want)
        prefixes = [p for p, _ in trie.containers()]
        assert prefixes == sorted(prefixes)
    finally:
        termcount.BURST = before


def test_many_terms_with_one_long_prefix(spark, monkeypatch):
    """No route is bound to a length of prefixes: terms that differ only after 40 characters spread over many tasks."""
    n = 200_000
    prefix = "http://www.example.org/products/category"
    df = spark.range(n).selectExpr("0 AS seg_no", "'tags' AS field", f"concat('{prefix}', id * 7919 % {n}) AS term", "id AS doc_id", "1 AS frequency").repartition(4)
    seen = []
    cuts = termcount._cuts
    monkeypatch.setattr(termcount, "_cuts", lambda t: seen.append(cuts(t)) or seen[-1])
    counted = termcount.term_counts(df)
    sizes = [r.n for r in counted.groupBy(F.spark_partition_id()).agg(F.count("*").alias("n")).collect()]
    assert sum(sizes) == n and len(sizes) >= 4 and max(sizes) < 2.5 * n / len(sizes)
    assert counted.agg(F.sum("occurrences"), F.sum("documents"), F.countDistinct("term")).first() == (n, n, n)
    assert len(seen[0]) + 1 >= 4 and all(len(t) > 40 for _, t in seen[0])


def test_merge_lets_go_of_what_is_complete(monkeypatch):
    monkeypatch.setattr(termcount, "SPILL", 50)
    held = []
    add = termcount.BurstTrie.add
    monkeypatch.setattr(termcount.BurstTrie, "add", lambda self, *x: (add(self, *x), held.append(self.size))[0])
    rows = [{"first": f"{i:05d}", "field": "f", "prefix": "0" if k else "", "suffixes": [f"{i + j:05d}"[1 if k else 0 :] for j in range(10)], "occurrences": [1] * 10, "documents": [1] * 10} for i in range(0, 4000, 10) for k in (0, 1)]
    out = [r for b in termcount._merge(iter([pa.RecordBatch.from_pylist(rows)])) for r in b.to_pylist()]
    assert [(r["term"], r["occurrences"]) for r in out] == [(f"{i:05d}", 2) for i in range(4000)] and max(held) < 200


@pytest.mark.parametrize("least", [1.1, 2.2, 3.0])
def test_marking_terms(spark, least):
    rows = data()
    title = {(t, d): n for (f, t, d), n in once(rows).items() if f == "title" and n > 0}
    docs, n = len({d for _, d in title}), Counter(t for t, _ in title)
    want = {(d, t) for (t, d), tf in title.items() if n[t] >= 2 and tf * (1 - math.log(n[t]) / math.log(docs)) >= least}
    got = [tuple(r) for r in distinct_weight.marking_terms(spark.createDataFrame(rows, SCHEMA), least=least).collect()]
    assert len(got) == len(set(got)) and set(got) == want and len(want) > 20
    assert distinct_weight.marking_terms(spark.createDataFrame(rows[:1], SCHEMA)).count() == distinct_weight.marking_terms(spark.createDataFrame([], SCHEMA)).count() == 0


@pytest.mark.parametrize("spread", ["frequency", "documents"])
@pytest.mark.parametrize("local", ["log", "raw"])
def test_weights_against_brute_force(spark, spread, local):
    rows = data()
    title = {(t, d): n for (f, t, d), n in once(rows).items() if f == "title" and n > 0}
    docs = len({d for _, d in title})
    by_term = defaultdict(list)
    for (t, _), n in title.items():
        by_term[t].append(n)

    def weight(ns):
        p = [n / sum(ns) for n in ns] if spread == "frequency" else [1 / len(ns)] * len(ns)
        return 1 + sum(x * math.log(x) for x in p) / math.log(docs)

    want = {(d, t): (math.log(1 + n) if local == "log" else n) * weight(by_term[t]) for (t, d), n in title.items()}
    df = spark.createDataFrame(rows, SCHEMA)
    got = {(r.doc_id, r.term): r.score for r in distinct_weight.log_entropy(df, local=local, spread=spread).collect()}
    assert set(got) == set(want)
    assert all(got[k] == pytest.approx(want[k], abs=1e-9) for k in want)
    some = distinct_weight.log_entropy(df, local=local, spread=spread, least=1.1, least_documents=2).collect()
    assert {(r.doc_id, r.term) for r in some} == {k for k, v in want.items() if v >= 1.1 and len(by_term[k[1]]) >= 2}


def test_one_document(spark):
    df = spark.createDataFrame([(1, "title", "a", 1, 2, 0, "", "")], SCHEMA)
    assert distinct_weight.log_entropy(df, local="raw").first().score == 2.0
    assert Counter(r["mark"] for r in termcount.marked_terms(df).collect()) == {"common": 1}
