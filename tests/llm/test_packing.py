import random
from collections import defaultdict

import numpy as np
import pytest
from hypothesis import given, settings
from hypothesis import strategies as st

from pyspark.sql import functions as F

from lexispark.llm import packing
from lexispark.llm.packing import Limits


@settings(max_examples=200, deadline=None)
@given(st.lists(st.integers(1, 64), min_size=1, max_size=120), st.sampled_from([Limits(), Limits(8), Limits(32, 4), Limits(8, 64, (0.1, 1.0, 1.0)), Limits(64, 5)]))
def test_constraints_hold(sizes, limits):
    sizes = np.sort(np.array(sizes))[::-1]
    place = packing.best_fit(sizes, 64, limits)
    for k in set(place.tolist()):
        own = sizes[place == k]
        assert own.sum() <= 64 and len(own) <= limits.documents(64) and limits.attention(own, 64).sum() <= limits.attention(64, 64)
    assert sorted(set(place.tolist())) == list(range(place.max() + 1))


def test_packs(spark):
    r = random.Random(2)
    sizes = [(i, r.choice([r.randrange(1, 40), r.randrange(1, 300)]), "x") for i in range(4000)]
    sizes += [(4000, 0, ""), (4001, None, ""), (4002, 128, ""), (4003, 5000, ""), (None, 7, ""), (5, 9, ""), (1 << 60, 3, "")]
    df = spark.createDataFrame(sizes, "doc_id bigint, tokens int, container_id string").repartition(3)
    capacities = [(1, 128), (2, 512), (3, None), (None, 9), (4, 0)]
    got = packing.pack(df, "doc_id", capacities, group=700).collect()
    for capacity_id, capacity in ((1, 128), (2, 512)):
        own = [x for x in got if x.capacity_id == capacity_id]
        boxes, docs = defaultdict(int), defaultdict(list)
        for x in own:
            docs[x.doc_id].append(x)
            if x.container_id is not None:
                boxes[x.container_id] += x.tokens
        assert max(boxes.values()) <= capacity
        assert sum(boxes.values()) == sum(n or 0 for _, n, _ in sizes)
        assert sum(boxes.values()) / (len(boxes) * capacity) > 0.97, capacity
        assert {x.container_id for x in docs[4000] + docs[4001]} == {None} and len(docs[None]) == 1
        assert len(docs[4002]) == 1 and len(docs[5]) >= 2 and docs[1 << 60][0].tokens == 3
        cut = sorted(docs[4003], key=lambda x: x.piece)
        assert [x.piece for x in cut] == list(range(-(-5000 // capacity))) and [x.start for x in cut] == [i * capacity for i in range(len(cut))]
        assert all(len(v) == 1 for k, v in docs.items() if k not in (5, 4003, None) and v[0].tokens <= capacity and dict((i, n) for i, n, _ in sizes)[k] and dict((i, n) for i, n, _ in sizes)[k] <= capacity)
    assert {x.capacity_id for x in got} == {1, 2}


def test_empty(spark):
    df = spark.createDataFrame([], "doc_id bigint, tokens int")
    assert packing.pack(df, "doc_id", [(1, 128)]).count() == 0
    assert packing.pack(df, "doc_id", []).count() == 0


def test_fill(spark):
    df = spark.createDataFrame([(i, 64) for i in range(10)], "doc_id bigint, tokens int")
    assert packing.fill(packing.pack(df, "doc_id", [(1, 128)]), [(1, 128)]).first().fill == pytest.approx(1.0)


def test_a_scalar_best_fit_breaks_the_other_limits():
    """By tokens alone both further limits are broken; the vector keeps them and needs few containers more."""
    r = np.random.default_rng(5)
    sizes = np.sort(np.concatenate([r.integers(1, 30, 3000), r.integers(30, 900, 300)]))[::-1]
    limits, scalar = Limits(), Limits(1, 4096)
    capacity = 1024

    def over(place):
        d, a = np.bincount(place), np.bincount(place, weights=limits.attention(sizes, capacity))
        return (d > limits.documents(capacity)).sum(), (a > limits.attention(capacity, capacity)).sum(), len(d)

    broken = over(packing.best_fit(sizes, capacity, scalar))
    kept = over(packing.best_fit(sizes, capacity, limits))
    assert broken[0] > 0 and broken[1] > 0 and kept[:2] == (0, 0) and kept[2] <= broken[2] * 1.1


def test_open_containers_are_closed_in_further_rounds(spark):
    r = random.Random(8)
    df = spark.createDataFrame([(i, r.randrange(1, 400)) for i in range(6000)], "doc_id bigint, tokens int").repartition(5)
    df.write.parquet(at := f"{spark.conf.get('spark.checkpoint.dir')}/pack-sizes")
    df = spark.read.parquet(at)
    capacities = [(1, 512), (2, 4096)]
    packed = packing.pack(df, "doc_id", capacities, group=100).cache()
    assert packed.count() == 12_000 and packing.violations(packed, df, "doc_id", capacities).count() == 0
    filled = {x.capacity_id: x for x in packing.fill(packed, capacities).collect()}
    assert all(x.containers >= x.least for x in filled.values())
    # 60 groups of 100 texts, some 5 containers of 4096 tokens each: left open one by one they would be four fifths full
    assert filled[1].fill > 0.97 and filled[2].fill > 0.96


def test_violations_are_found(spark):
    sizes = spark.createDataFrame([(1, 100), (2, 60), (3, 0), (4, 300), (5, 10)], "doc_id bigint, tokens int")
    bad = [(1, 7, 1, 0, 0, 100), (1, 7, 2, 0, 0, 60), (1, 8, 3, 0, 0, 0), (1, 9, 4, 0, 0, 128), (1, 10, 4, 1, 128, 128), (1, 11, 5, 0, 0, 5), (1, 12, 5, 1, 5, 5)]
    packed = spark.createDataFrame(bad, "capacity_id int, container_id bigint, doc_id bigint, piece int, start bigint, tokens bigint")
    got = {(r.rule, r.n) for r in packing.violations(packed, sizes, "doc_id", [(1, 128)]).collect()}
    assert got == {("tokens", 1), ("lost", 1), ("split", 2), ("empty", 1)}
    many = spark.createDataFrame([(1, 1, i, 0, 0, 1) for i in range(20)], packed.schema)
    assert [tuple(r) for r in packing.violations(many, spark.range(20).selectExpr("id AS doc_id", "1 AS tokens"), "doc_id", [(1, 128)]).collect()] == [("documents", 1, 1)]
    tiles = spark.createDataFrame([(2, 1, 0, 0, 0, 900), *((2, 1, i, 0, 0, 3) for i in range(1, 33))], packed.schema)
    sizes = tiles.select("doc_id", F.col("tokens").cast("int").alias("tokens"))
    assert [tuple(r) for r in packing.violations(tiles, sizes, "doc_id", [(2, 1024)]).collect()] == [("attention", 2, 1)]
