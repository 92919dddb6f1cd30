import math
import os
import re

import numpy as np
import pytest
from hypothesis import given, settings
from hypothesis import strategies as st
import pyarrow as pa

from lexispark.queries import QUERIES
from lexispark.sources import records
from lexispark.sources.tsv import load_documents, load_titles, load_words, numbered_lines

CASES = {
    "1\tred\t5.3": ("1", "red", 5.3, None),
    "1\tred\t5.3\r": ("1", "red", 5.3, None),
    "\tred\t +5.50 ": ("", "red", 5.5, None),
    '1\t"a ""b""\tc"\t1e2': ("1", 'a "b"\tc', 100.0, None),
    '1\ta"b\t1': ("1", 'a"b', 1.0, None),
    '"x"\t"y"\t"2"': ("x", "y", 2.0, None),
    "﻿1\ta\t1": ("﻿1", "a", 1.0, None),
    "1\ta\\\t1": ("1", "a\\", 1.0, None),
    '1\t"abc\t1': (None, None, None, "quoting"),
    '1\t"abc"d\t1': (None, None, None, "quoting"),
    '"': (None, None, None, "quoting"),
    '1\ta\t1\t"x': (None, None, None, "quoting"),
    "": (None, None, None, "columns"),
    "1\ta": (None, None, None, "columns"),
    "1\ta\t1\t2": (None, None, None, "columns"),
    "1\t\t1": ("1", None, None, "title"),
    '1\t""\tx': ("1", None, None, "title"),
    "1\t 　  \t1": ("1", None, None, "title"),
    "1\ta�b\t1": ("1", None, None, "title"),
    "1\ta\x01b\t1": ("1", None, None, "title"),
    "1\ta\nb\t1": ("1", None, None, "title"),
    "1\ta\rb\t1": ("1", None, None, "title"),
    "1\ta\x00b\t1": ("1", None, None, "title"),
    "1\ta\t": ("1", "a", None, "price"),
    "1\ta\t1,5": ("1", "a", None, "price"),
    "1\ta\t.5": ("1", "a", None, "price"),
    "1\ta\t5.": ("1", "a", None, "price"),
    "1\ta\t1e999": ("1", "a", None, "price"),
    "1\ta\tNaN": ("1", "a", None, "price"),
    "1\ta\t٣": ("1", "a", None, "price"),
    "1\ta\t 5": ("1", "a", None, "price"),
    "1\ta\t-0": ("1", "a", -0.0, None),
    "1\t" + "x" * 200_000 + "\t1": ("1", "x" * 200_000, 1.0, None),
    None: (None, None, None, "missing"),
}


@pytest.mark.parametrize("line", CASES)
def test_strict_reading(line):
    assert records.diagnose(line) == CASES[line]


@pytest.mark.parametrize("good", [0, 3, 9000])
def test_blocks_agree_with_strict_reading(spark, good):
    lines = [*CASES, *CASES, *[f"{i}\ttitle {i}\t{i}.5" for i in range(good)]]
    df = spark.createDataFrame([(i, x, "r", 1.0) for i, x in enumerate(lines)], "id bigint, line string, reason string, price double").repartition(3)
    got = {r.record_id: (r.source_id, r.title, r.price, r.reason) for r in records.parse_records(df, "id", "line").collect()}
    assert got == {i: records.diagnose(x) for i, x in enumerate(lines)}


def test_empty_table(spark):
    assert records.parse_records(spark.createDataFrame([], "id bigint, line string"), "id", "line").count() == 0


@settings(max_examples=500, deadline=None)
@given(st.lists(st.text(alphabet='a"\t 1.e+-\r\n﻿中', max_size=14), min_size=1, max_size=5))
def test_bulk_never_takes_what_strict_refuses(lines):
    lines = [*lines, "1\tt\t2"]
    batches = list(records._parse(pa.array(range(len(lines))), pa.array(lines, pa.string())))
    got = {r["record_id"]: (r["source_id"], r["title"], r["price"], r["reason"]) for b in batches for r in b.to_pylist()}
    assert got == {i: records.diagnose(x) for i, x in enumerate(lines)}


def test_only_bad_records_are_read_strictly(monkeypatch):
    seen = []
    monkeypatch.setattr(records, "diagnose", lambda x, f=records.diagnose: (seen.append(x), f(x))[1])
    for bad in ("only one field", '5\t"x\t1', "5\t \t1", "5\ta\tfree", None):
        seen.clear()
        lines = [f'{i}\t"title ""{i}"""\t {i}.5' for i in range(7)]
        lines.insert(3, bad)
        got = [r for b in records._parse(pa.array(range(8)), pa.array(lines)) for r in b.to_pylist()]
        assert seen == [bad] and len(got) == 8 and sum(r["reason"] is None for r in got) == 7


def test_halving():
    assert records.isolate(0, lambda a, b: True) == ([], [])
    for bad in ({3}, {0, 7}, set(range(8)), set()):
        asked = []
        passing, failing = records.isolate(8, lambda a, b: (asked.append((a, b)), any(a <= x < b for x in bad))[1])
        assert failing == sorted(bad) and passing == [i for i in range(8) if i not in bad]
        assert len(asked) == (7 if len(bad) == 1 else 15 if len(bad) == 8 else 1 if not bad else 11)


def test_a_reader_that_refuses(monkeypatch):
    """If Arrow's reader takes lines otherwise than the checks, the failing ones are found by halving."""
    read = records.read_block
    monkeypatch.setattr(records, "read_block", lambda lines: None if any("odd" in x for x in lines.to_pylist()) else read(lines))
    lines = [f"{i}\t{'odd' if i in (2, 9) else 'fine'} title\t{i}" for i in range(12)]
    got = {r["record_id"]: r["title"] for b in records._parse(pa.array(range(12)), pa.array(lines)) for r in b.to_pylist()}
    assert got == {i: f"{'odd' if i in (2, 9) else 'fine'} title" for i in range(12)}


def test_files(spark, tmp_path):
    (tmp_path / "g.csv").write_text("".join(f"s{i}\ttitle {i}\t{i}.1\n" for i in range(500)))
    path = str(tmp_path / "g.csv")
    assert [tuple(r) for r in numbered_lines(spark, path).orderBy("line_no").limit(2).collect()] == [(0, "s0\ttitle 0\t0.1"), (1, "s1\ttitle 1\t1.1")]
    docs = load_documents(spark, path)
    assert docs.count() == 500 and docs.columns == ["uniqueID", "title", "price", "descript", "digt"]
    assert load_documents(spark, path, 7).agg({"uniqueID": "max"}).first()[0] == 6
    shifted = load_documents(spark, path, 3, float32=True, key_offset=200_000, whole_split=True).orderBy("uniqueID").collect()
    assert shifted[1].uniqueID == 200_001 and shifted[1].price == pytest.approx(1.1) and shifted[1].price != 1.1
    assert [r.title for r in load_titles(spark, path, 2).collect()] == ["title 0", "title 1"]
    words = spark.createDataFrame([(" a ",), ("a",), (None,), ("",), ("b",)], "word string")
    assert load_words(words) == {"a", "b"}
    with pytest.raises(ValueError):
        load_words(words, most=1)


JAVA_NUMBER = re.compile(r"[+-]?(?:NaN|Infinity|(?:(?:\d+\.?\d*|\.\d+)(?:[eE][+-]?\d+)?|0[xX](?:[0-9a-fA-F]+\.?[0-9a-fA-F]*|\.[0-9a-fA-F]+)[pP][+-]?\d+)[fFdD]?)", re.ASCII)


def goods_line(line):
    """Title and single-precision price of a line, the plain way."""
    fields = line.split("\t") if line is not None else []
    title, text = (fields[i] if len(fields) > i else None for i in (1, 2))
    text = (text or "").strip("".join(map(chr, range(33))))
    if not JAVA_NUMBER.fullmatch(text):
        return title, None
    if "x" in text.lower():
        value = float.fromhex(re.sub("[fFdD]$", "", text))
    else:
        value = float(re.sub("[fFdD]$", "", text))
    return title, float(np.float32(value))


def test_all_product_lines(spark, tmp_path):
    """Signs, exponents, blanks, quotes, further and missing fields: every line comes out once."""
    odd = ["+116.68", "1E2", " 86.60", "9.5\r", '"9.5"', "9.5\tmore\tfields", "9,5", "abc", "", "0x1p3", "32.28d", "1_23.36", "NaN", "-4", "1e999", ".5", "5.", "-inf", "Infinity", "nan"]
    lines = [f'a\tsome "quoted" title\t{x}' for x in odd] + ["no tab", "two\tfields", "", None, '"q\t"t\t1.5']
    for at, rows in (("odd", list(enumerate(lines))), ("table", None)):
        if rows is None:
            if not os.path.isdir("/root/testdata/sf0.01"):
                continue
            folder = "/root/testdata/sf0.01"
            rows = [(r.raw_id, r.raw_line) for r in spark.read.parquet(f"{folder}/goods_raw.parquet").collect()]
        else:
            folder = f"{tmp_path}/{at}"
            spark.createDataFrame(rows, "raw_id bigint, raw_line string").write.parquet(f"{folder}/goods_raw.parquet")
        got = sorted((r.uniqueID, r.title, repr(r.price)) for r in QUERIES["tsv_documents"](spark, folder).collect())
        assert got == sorted((i + 200_000, goods_line(x)[0], repr(goods_line(x)[1])) for i, x in rows)
