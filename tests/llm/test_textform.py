import random
import unicodedata

import pytest

from lexispark.llm import textform

SAME = [
    ("Ａｂｃ－１", "Abc-1"),
    ("café", "café"),
    ("lace", "lасе"),  # Cyrillic
    ("ΝΟΤΕ", "NOTE"),  # Greek
    ("oﬃce", "office"),
    ("a​b­c﻿", "abc"),
    ("a 　 b", "a b"),
    ("  a b ", "a b"),
    ("a‑b‐c", "a-b-c"),
    ("⽊", "木"),
    ("行", "行"),
    ("K", "K"),
    ("ⅿⅰⅼⅼ", "mill"),
    ("q̣̇", "q̣̇"),
    ("각", "각"),
    ("ẹ́", "ẹ́"),
    ("ｶﾞ", "ガ"),
    ("е́", "é"),  # Cyrillic base, then an accent
]
OTHER = [("a", "A"), ("cafe", "café"), ("m²", "m2"), ("①", "1"), ("l", "I"), ("0", "O"), ("a–b", "a-b"), ("ab", "a b"), ("ω", "w"), ("№7", "7")]


@pytest.fixture(scope="module")
def form(spark):
    texts = sorted({x for p in (*SAME, *OTHER) for x in p} | {"", "​", " \t\n", "x" * 30_000, "ab c " * 40_000 + "é", "ab c " * 40_000 + "d", "é" * 3000, "́a", "a" + "̣́" * 40})
    df = spark.createDataFrame([(t, "y", 1) for t in [*texts, *texts, None]], "title string, form string, text int")
    rows = textform.text_forms(df, "title").collect()
    assert sorted(r.text for r in rows) == texts
    return {r.text: r.form for r in rows}


@pytest.mark.parametrize("a, b", SAME)
def test_same(form, a, b):
    assert form[a] == form[b]


@pytest.mark.parametrize("a, b", OTHER)
def test_different(form, a, b):
    assert form[a] != form[b]


def test_edges(form, spark):
    assert form[""] == form["​"] == form[" \t\n"] == "" and form["x" * 30_000] == "x" * 30_000 and form["é" * 3000] == "é" * 3000
    assert form["a" + "̣́" * 40] == unicodedata.normalize("NFC", "a" + "̣́" * 40)
    assert all(f == unicodedata.normalize("NFC", f) for f in form.values())
    assert textform.text_forms(spark.createDataFrame([], "t string"), "t").count() == 0


def test_forms_are_stable(form, spark):
    again = textform.text_forms(spark.createDataFrame([(f,) for f in form.values()], "t string"), "t").collect()
    assert all(r.text == r.form for r in again)


def test_composition_agrees_with_unicode(spark):
    """Over letters without a look-alike, the form is plain canonical composition."""
    chars = [chr(c) for c in range(0xC0, 0x250) if len(unicodedata.normalize("NFD", chr(c))) > 1 and chr(c) not in "Ǯǯ"] + ["ো", "ୋ", "가", "각", "힣", "が"]
    texts = [unicodedata.normalize(n, c) + tail for c in chars for n in ("NFC", "NFD") for tail in ("", "̣", "̧́")]
    got = textform.text_forms(spark.createDataFrame([(t,) for t in texts], "t string"), "t").collect()
    assert all(r.form == unicodedata.normalize("NFC", r.text) for r in got)


def test_plain_characters_are_their_own_form(spark):
    """The short cut for plain characters and stretches changes nothing: every assigned code point, alone and in company, both ways."""
    points = [chr(c) for c in range(1, 0x20000) if not 0xD800 <= c < 0xE000 and unicodedata.category(chr(c)) not in ("Cn", "Co")]
    texts = [*points, *(f"a{c}b" for c in points), *(f"漢{c}\u0301" for c in points if ord(c) < 0x3000), *("".join(points[i : i + 50]) for i in range(0, len(points), 25))]
    df = spark.createDataFrame([(t,) for t in texts], "t string")
    quick, full = ({r.text: r.form for r in textform.text_forms(df, "t", plain).collect()} for plain in (True, False))
    assert len(quick) == len(set(texts)) and quick == full


def test_without_unicode_data_there_is_an_error():
    class Missing:
        class _jvm:
            class com:
                class ibm:
                    class icu:
                        class text:
                            class SpoofChecker:
                                Builder = None

    with pytest.raises(RuntimeError):
        textform._skeletons(Missing, ["a"])


def test_pairs_and_links_against_brute_force(spark):
    r = random.Random(6)
    alike = {"a": "aаａ", "o": "oоο", "e": "eе", " ": [" ", "  ", "\u3000"], "-": "-‐", "c": "cс"}
    rows = []
    for i in range(400):
        base = r.choice(["cocoa cake", "a-one cola", "eco lace", "Éclair oaco", "cocoa Cake"])
        rows.append((i, "".join(r.choice(alike[x]) if x in alike and r.random() < 0.1 else x for x in base)))
    goods = spark.createDataFrame(rows, "unique_id bigint, title string")
    back = {y: x for x, ys in alike.items() for y in ys}
    plain = {i: "".join(back.get(x, x) for x in t.replace("  ", " ")) for i, t in rows}
    title = dict(rows)
    pairs = {(i, j) for i in title for j in title if i < j and plain[i] == plain[j] and title[i] != title[j]}
    assert {tuple(x) for x in textform.document_pairs(goods).collect()} == pairs and len(pairs) > 1000
    links = {x.unique_id: (x.class_id, x.links) for x in textform.form_links(goods).collect()}
    assert links == {i: (min(j for j in title if plain[j] == plain[i]), sum(i in p for p in pairs)) for i in title}
    assert textform.form_links(goods.limit(0)).count() == 0


def test_pairs_and_classes(spark):
    rows = [(1, "Ａb"), (2, "Ab"), (3, "Ab"), (3, "Ab"), (4, "ab"), (5, None), (None, "Ab"), (6, "A​b"), (7, ""), (8, " ")]
    goods = spark.createDataFrame([(*r, "z", 9) for r in rows], "unique_id bigint, title string, form string, class_id int")
    docs = textform.title_documents(goods)
    got = sorted(tuple(r) for r in textform.same_look_pairs(textform.text_forms(docs, "title"), docs).collect())
    assert got == [(1, 2), (1, 3), (1, 6), (2, 6), (3, 6), (7, 8)]
    classes = {r.unique_id: r.class_id for r in textform.form_classes(goods).collect()}
    assert classes == {1: 1, 2: 1, 3: 1, 6: 1, 4: 4, 7: 7, 8: 7}
