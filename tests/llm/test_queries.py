import os
import unicodedata
from collections import defaultdict

import pytest

import compare
from lexispark.llm import bpe
from lexispark.llm import queries as llm

DATA = "/root/testdata/sf0.001"
pytestmark = pytest.mark.skipif(not os.path.isdir(DATA), reason="no test tables")


@pytest.fixture(scope="module")
def db():
    return compare.views(DATA)


@pytest.fixture(scope="module")
def rows(spark):
    """The rows of the queries without SQL."""
    return {name: [tuple(r) for r in llm.QUERIES[name](spark, DATA).collect()] for name in sorted(set(llm.QUERIES) - set(llm.SQL))}


@pytest.mark.parametrize("name", sorted(llm.SQL))
def test_same_rows_as_sql(spark, db, name):
    got, want = llm.QUERIES[name](spark, DATA).toPandas(), db.execute(llm.SQL[name]).df()
    assert sorted(got.columns) == sorted(want.columns)
    assert compare.rows(got) == compare.rows(want)


def test_all_queries_have_sql_or_a_test(rows):
    assert set(rows) == {"p2_found", "p2_forms", "p2_links", "p3_found", "p3_links", "p7_ids", "p8_packed", "p8_fill", "p9_levels"}


def test_forms_and_pairs_of_titles(rows, db):
    title = dict(db.execute("SELECT unique_id, min(title) FROM goods_doc WHERE title IS NOT NULL GROUP BY unique_id").fetchall())
    form = {i: f for i, _, f in rows["p2_forms"]}
    assert set(form) == set(title) and all(" ".join(f.split(" ")) == f and unicodedata.normalize("NFC", f) == f for f in form.values())
    members = defaultdict(list)
    for i, f in form.items():
        members[f].append(i)
    assert {(i, c) for i, c, _ in rows["p2_forms"]} == {(i, min(members[f])) for i, f in form.items()}
    pairs = {(i, j) for own in members.values() for i in own for j in own if i < j and title[i] != title[j]}
    assert set(rows["p2_found"]) == pairs and len(rows["p2_found"]) == len(pairs)
    assert set(rows["p2_links"]) == {(i, min(members[f]), sum(title[j] != title[i] for j in members[f])) for i, f in form.items()}
    low = {i: f.lower() for i, f in form.items()}
    sets = {f: {f[k : k + 3] for k in range(len(f) - 2)} for f in low.values()}
    near = {(i, j) for i in low for j in low if i < j and low[i] != low[j] and sets[low[i]] | sets[low[j]] and len(sets[low[i]] & sets[low[j]]) * 100 >= 65 * len(sets[low[i]] | sets[low[j]])}
    assert set(rows["p3_found"]) == near and len(rows["p3_found"]) == len(near) > 0
    least = {}
    for i, f in low.items():
        least[f] = min(i, least.get(f, i))
    assert set(rows["p3_links"]) == {(i, least[f], sum(i in p for p in near)) for i, f in low.items()}


def test_ids_of_texts(rows, db):
    tiktoken = pytest.importorskip("tiktoken")
    from tiktoken.load import load_tiktoken_bpe

    encoding = tiktoken.Encoding("x", pat_str=bpe.PATTERN, mergeable_ranks=load_tiktoken_bpe(bpe.VOCABULARY), special_tokens={})
    texts = db.execute("SELECT doc_id, text FROM documents").fetchall()
    assert {i: list(ids) for i, ids in rows["p7_ids"]} == {i: encoding.encode(t or "", disallowed_special=()) for i, t in texts} and len(rows["p7_ids"]) == len(texts)


def test_packing_of_texts(rows):
    tokens = {i: len(ids) for i, ids in rows["p7_ids"]}
    room = {c: r for c, r in zip([r[0] for r in rows["p8_fill"]], [None] * 9)}
    for capacity_id, containers, total, least, fill in rows["p8_fill"]:
        own = [r for r in rows["p8_packed"] if r[0] == capacity_id]
        used = defaultdict(int)
        got = defaultdict(int)
        for _, box, i, _, _, n in own:
            got[i] += n
            if box is not None:
                used[box] += n
        assert got == tokens and len(used) == containers and sum(used.values()) == total == sum(tokens.values())
        assert containers >= least and max(used.values()) <= round(total / (containers * fill)) and fill > 0.75
    assert len(room) == 4


def test_levels_of_texts(rows, db):
    levels = {i: level for i, level, _, _ in rows["p9_levels"]}
    assert set(levels) == {r[0] for r in db.execute("SELECT doc_id FROM documents WHERE text IS NOT NULL").fetchall()}
    assert {h for *_, h in rows["p9_levels"]} == {0, 1} and sum(x is not None for x in levels.values()) > 40
