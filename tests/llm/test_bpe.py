import base64
import os
import random

import pytest
import tiktoken
from hypothesis import given, settings
from hypothesis import strategies as st
from tokenizers import Tokenizer

from lexispark.llm import bpe

pytestmark = pytest.mark.skipif(not os.path.exists(bpe.VOCABULARY), reason="no vocabulary files")


@pytest.fixture(scope="module")
def own():
    return bpe.transducer(bpe.read_vocabulary())


@pytest.fixture(scope="module")
def reference(own):
    return tiktoken.Encoding("own", pat_str=bpe.PATTERN, mergeable_ranks=own.ranks, special_tokens={})


@settings(max_examples=400, deadline=None)
@given(st.text(max_size=80))
def test_any_text(own, reference, text):
    assert own.encode(text) == reference.encode_ordinary(text)


def test_other_library(own):
    other = Tokenizer.from_file(os.path.join(os.path.dirname(bpe.VOCABULARY), "byte_bpe_50k.json"))
    other.encode_special_tokens = True
    texts = ["Hello  world", "don't I'LL", "<|endoftext|> a", "值得买。\r\n朋友", "\U0001f600" * 9, "  \n\t x ", "1234567", "naïve café", "a" * 3000]
    assert [own.encode(t) for t in texts] == [e.ids for e in other.encode_batch(texts, add_special_tokens=False)]


def test_long_runs_and_forgetting(own, reference, monkeypatch):
    r = random.Random(1)
    monkeypatch.setattr(bpe, "MOST_STATES", 50)
    monkeypatch.setattr(bpe, "MOST_WORDS", 20)
    fresh = bpe.Transducer(own.ranks)
    for text in ["ab" * 20_000, "".join(r.choice("abcdefgh") for _ in range(20_000)), "中文" * 5000, " " * 9000, "".join(chr(r.randrange(0x4E00, 0x9FFF)) for _ in range(3000))]:
        assert fresh.encode(text) == reference.encode_ordinary(text)
    assert len(fresh._states) < 20_000


@settings(max_examples=400, deadline=None)
@given(st.binary(max_size=24), st.integers(1, 5))
def test_streaming_decoder(data, size):
    stream = bpe.Utf8Decoder()
    assert "".join(stream.feed(data[i : i + size]) for i in range(0, len(data), size)) + stream.close() == data.decode("utf-8", "replace")


def test_tables(spark, reference):
    texts = ["some text", "", None, "值得买。", "some text", "x " * 50_000]
    df = spark.createDataFrame([(i, t, [1], 5) for i, t in enumerate(texts)], "doc_id bigint, text string, ids array<int>, tokens int")
    got = bpe.encode_texts(df, "doc_id", "text")
    assert got.columns == ["doc_id", "ids"]
    rows = {r.doc_id: r.ids for r in got.collect()}
    assert rows == {i: reference.encode_ordinary(t or "") for i, t in enumerate(texts)}
    assert {r.doc_id: r.text for r in bpe.decode_ids(got, "doc_id").collect()} == {i: t or "" for i, t in enumerate(texts)}
    counts = bpe.encode_texts(df, "doc_id", "text", counts_only=True).collect()
    assert {r.doc_id: r.tokens for r in counts} == {i: len(v) for i, v in rows.items()}
    assert bpe.encode_texts(df.limit(0), "doc_id", "text").count() == 0
    odd = spark.createDataFrame([(1, [99999999, 65]), (2, None), (3, [])], "doc_id bigint, ids array<int>")
    assert {r.doc_id: r.text for r in bpe.decode_ids(odd, "doc_id").collect()} == {1: "�b", 2: None, 3: ""}


def test_memory_is_bounded_within_a_long_word(monkeypatch):
    monkeypatch.setattr(bpe, "MOST_STATES", 40)
    monkeypatch.setattr(bpe, "MOST_PAIRS", 30)
    small, usual = (bpe.Transducer({base64.b64decode(a): int(b) for a, b in (x.split() for x in open(bpe.VOCABULARY, "rb").read().splitlines() if x)}) for _ in range(2))
    r = random.Random(1)
    word = "".join(r.choice("abcdefghijklmnopqrstuvwxyz") for _ in range(3000))
    got = small.encode(word)
    monkeypatch.undo()
    assert got == usual.encode(word) and len(small._states) <= 41 and len(small._follows) <= 30
