import unicodedata

import pytest
from hypothesis import given, settings
from hypothesis import strategies as st
from pyspark.sql import functions as F

from lexispark.functions import text as tx
from lexispark.functions.segment import fewest_word_paths, segment_terms
from lexispark.operators.index import Analyzer

GOLDEN = {
    "That it.": "that@0 it.@5",
    "iPhone 14 Pro-Max 3.5kg": "iphone@0 14@7 pro-max@10 3.5@18 kg@21",
    "Ａｂｃ　１２": "abc@0 12@4",
    "étion de": "é@0 tion@1 de@6",
    "-5 .net a-中b": "-@0 5@1 .@3 n@4 e@5 t@6 a-中@8 b@11",
    "Hello,  world!\nfoo": "hello@0 world@8 foo@15",
    "v2.0-beta1": "v@0 2.0-beta@1 1@9",
    "a__b": "a@0 b@3",
    "C++ 11": "c@0 11@4",
    "": "",
}


def model(value: str) -> list[tuple[str, int]]:
    """Tokens character by character: cut between categories, but not beside '-' or '.'."""
    kind = lambda c: 1 if unicodedata.category(c) == "Nd" else 2 if "a" <= c <= "z" else 0
    out, at = [], 0
    for run in value.split(" "):
        start = 0
        for i in range(1, len(run) + 1):
            if i == len(run) or (run[i] not in "-." and run[i - 1] not in "-." and kind(run[i]) != kind(run[i - 1])):
                out.append((run[start:i], at + start))
                start = i
        at += len(run) + 1
    return [t for t in out if t[0]]


@pytest.mark.parametrize("value", GOLDEN)
def test_golden_terms(value):
    assert " ".join(f"{t}@{p}" for t, p in Analyzer().terms_python(value)) == GOLDEN[value]


@settings(max_examples=300, deadline=None)
@given(st.text(alphabet="abz AB09-.é中文　Ａ１_,٣\n\U0001f600", max_size=30))
def test_tokens_match_character_model(value):
    normalized = tx.normalize_python(value)
    assert tx.tokens_python(normalized) == model(normalized)


def test_columns_match_python(spark):
    values = [*GOLDEN, None, "臺灣", "a\U0001f600b", "x" * 50_000, "中" * 40, "Straße ÄÖ", "a b", "..", "--a", "٣٤ab"]
    rows = spark.createDataFrame([(v,) for v in values], "v string").select("v", tx.normalize(F.col("v")).alias("n"), tx.tokens(tx.normalize(F.col("v"))).alias("t")).collect()
    assert len(rows) == len(values)
    for r in rows:
        assert r.n == tx.normalize_python(r.v)
        assert r.t == [t for t, _ in tx.tokens_python(r.n)]


def test_simplified_characters(spark):
    table = tx.simplified_characters()
    assert table["臺"] == "台" and table["灣"] == "湾"
    assert tx.normalize_python("臺灣", table) == "台湾"


def test_value_length_counts_utf16_units(spark):
    df = spark.createDataFrame([("ab",), ("a\U0001f600",), ("",), (None,)], "v string")
    assert [r[0] for r in df.select(tx.value_length(F.col("v"))).collect()] == [2, 3, 0, None]


def all_paths(text, words):
    if not text:
        return [[]]
    return [[text[:k], *rest] for k in range(1, len(text) + 1) if k == 1 or text[:k] in words for rest in all_paths(text[k:], words)]


@settings(max_examples=200, deadline=None)
@given(st.text(alphabet="abc", min_size=1, max_size=9), st.sets(st.text(alphabet="abc", min_size=2, max_size=4), max_size=8), st.integers(1, 4))
def test_paths_are_the_shortest(text, words, n):
    got = fewest_word_paths(text, n, frozenset(words))
    every = sorted(len(p) for p in all_paths(text, words))
    assert [len(p) for p in got] == every[:n]
    assert len({tuple(w for w, _ in p) for p in got}) == len(got)
    for p in got:
        assert "".join(w for w, _ in p) == text and all(text.startswith(w, at) for w, at in p)


def test_segment_terms():
    words = frozenset({"丰田", "凯美瑞", "适用", "适用于", "于丰"})
    assert segment_terms("丰田凯美瑞", 1, words) == [("丰田", 0), ("凯美瑞", 2)]
    assert [t for t, _ in segment_terms("适用于丰田", 2, words)] == ["适用", "适用于", "于", "丰田"]
    assert segment_terms("中", 1, words) == [("中", 0)] and segment_terms("", 1, words) == []
    assert len(segment_terms("中" * 25, 1, words)) == 20
    with pytest.raises(ValueError):
        segment_terms("中文", 0, words)


def test_analyzer_with_dictionary_matches_driver_side(spark):
    a = Analyzer(words=frozenset({"丰田", "凯美瑞", "研究", "研究生", "生命"}), paths=2)
    values = ["丰田凯美瑞 2020", "研究生命起源abc", None, "", "中"]
    got = a.terms(spark.createDataFrame([(i, v) for i, v in enumerate(values)], "id int, v string"), "v").collect()
    for i, v in enumerate(values):
        assert sorted(r.term for r in got if r.id == i) == sorted(t for t, _ in a.terms_python(v))
