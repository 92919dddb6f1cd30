import math
import random
import re
from decimal import Decimal

import pytest
from pyspark.sql import functions as F

from lexispark.functions import numeric
from lexispark.functions.segment import Dictionary, fewest_word_paths
from lexispark.operators import searcher, store as stores
from lexispark.operators.index import Analyzer, build_index
from lexispark.operators.searcher import Searcher
from lexispark.operators.store import Conflict, DuplicateKey, IndexStore, MissingTable
from lexispark.plans.query import MUST, SHOULD, BooleanQuery, NumericRangeQuery, StringQuery, TermQuery
from lexispark.sources.tsv import load_documents, load_punctuation, numbered_lines
from lexispark.streaming.ingest import ingest


def rows(df):
    return sorted(tuple(r) for r in df.collect())


def plan(df):
    return df.sparkSession._jvm.PythonSQLUtils.explainString(df._jdf.queryExecution(), "formatted")


def goods(spark, a, b):
    return spark.range(a, b).selectExpr("id", "concat(elt(id % 7 + 1, 'ant', 'bee', 'cat', 'dog', 'eel', 'fox', 'gnu'), ' common') AS title", "cast(id % 50 AS double) AS price")


def test_two_streams_lose_nothing(spark, tmp_path):
    goods(spark, 0, 50).coalesce(1).write.parquet(f"{tmp_path}/a")
    goods(spark, 50, 90).coalesce(1).write.parquet(f"{tmp_path}/b")
    store = IndexStore(spark, f"{tmp_path}/index")
    for name in ("a", "b", "b"):  # the last is the same stream again
        ingest(spark.readStream.schema(goods(spark, 0, 0).schema).parquet(f"{tmp_path}/{name}"), store, "id", f"{tmp_path}/cp-{name}").awaitTermination()
    assert store.open().stored.count() == 90 and len(store.manifest()["streams"]) == 2
    store.append(goods(spark, 100, 110), "id", stream="x", batch=3)
    store.append(goods(spark, 200, 210), "id", stream="x", batch=2)  # an earlier batch
    store.append(goods(spark, 300, 310), "id", stream="y", batch=0)
    assert store.open().stored.count() == 110


def test_crashes_and_broken_versions(spark, tmp_path, monkeypatch):
    store = IndexStore(spark, f"{tmp_path}/index")
    store.append(goods(spark, 0, 10), "id")

    def dies(*_):
        raise KeyboardInterrupt

    with monkeypatch.context() as m:
        m.setattr(IndexStore, "_publish", dies)
        with pytest.raises(KeyboardInterrupt):
            store.append(goods(spark, 10, 20), "id")
    assert store.open().stored.count() == 10 and [f.name for f in (tmp_path / "index/_manifest").iterdir() if f.name[0] != "."] == ["00000001.json"]
    for broken, text in ((2, ""), (3, '{"format_version": 1, "segm')):
        (tmp_path / f"index/_manifest/{broken:08d}.json").write_text(text)
        assert store.open().stored.count() == 10
    store.append(goods(spark, 10, 20), "id")
    assert store.open().stored.count() == 20 and store.manifest()["next"] == 5


def test_two_writers(spark, tmp_path):
    store = IndexStore(spark, f"{tmp_path}/index")
    store.append(goods(spark, 0, 10), "id")
    one, two = store.manifest(), store.manifest()
    one["streams"]["one"] = 1
    store._commit(one)
    with pytest.raises(Conflict):
        store._commit(two)
    assert store.manifest()["streams"] == {"one": 1}


def test_a_failed_append_leaves_nothing(spark, tmp_path):
    store = IndexStore(spark, f"{tmp_path}/index")
    store.append(goods(spark, 0, 10), "id")
    before = {p.name for p in (tmp_path / "index").iterdir()}
    for bad in (goods(spark, 5, 15), goods(spark, 20, 22).unionAll(goods(spark, 20, 22)), goods(spark, 30, 32).selectExpr("nullif(id, 30) AS id", "title", "price")):
        with pytest.raises(DuplicateKey):
            store.append(bad, "id")
    assert {p.name for p in (tmp_path / "index").iterdir()} == before
    store.append(goods(spark, 40, 40), "id")  # no rows
    assert store.open().stored.count() == 10 and len(store.manifest()["segments"]) == 2


def test_input_is_evaluated_once(spark, tmp_path):
    """Rows that differ from one evaluation to the next: what was checked is what is stored."""
    store = IndexStore(spark, f"{tmp_path}/index")
    store.append(spark.range(200).select("id", F.when(F.rand() < 0.5, "left").otherwise("right").alias("side"), F.rand().alias("price")), "id")
    index = store.open()
    stored = {r.doc_id: (r.side, r.price) for r in index.stored.collect()}
    assert {(r.doc_id, r.term) for r in index.postings.collect()} == {(k, v[0]) for k, v in stored.items()}
    assert {(r.doc_id, r.value) for r in index.points("price").collect()} == {(k, v[1]) for k, v in stored.items()}


def test_compaction_by_tiers(spark, tmp_path, monkeypatch):
    store = IndexStore(spark, f"{tmp_path}/index")
    written = []
    merge = IndexStore.merge
    monkeypatch.setattr(IndexStore, "merge", lambda self, names=None: (written.append(sum(s["docs"] for s in self.manifest()["segments"] if s["name"] in names)), merge(self, names)))
    for k in range(4):
        store.append(goods(spark, 3 * k, 3 * k + 3), "id")
        store.compact(2)
    assert [s["docs"] for s in store.manifest()["segments"]] == [12] and written == [6, 6, 12]
    assert rows(store.open().frequencies().groupBy("term").sum("df").where("term = 'common'")) == [("common", 12)]
    assert sorted(r.doc_id for r in Searcher(store.open()).search(NumericRangeQuery("price", 3, 5)).collect()) == [3, 4, 5]
    store.verify()
    manifest = store.manifest()
    store._remove(f"{manifest['segments'][0]['name']}/points-price")
    with pytest.raises(MissingTable):
        store.verify()


def test_stored_numbers_agree_with_counted_ones(spark, tmp_path):
    store = IndexStore(spark, f"{tmp_path}/index")
    for a, b in ((0, 40), (40, 100)):
        store.append(goods(spark, a, b), "id")
    assert store.delete([1, 2, 77]) == [True] * 3 and store.delete([2, 3, 500]) == [False, True, False]
    store.delete_all(spark.createDataFrame([(4,), (4,), (3,), (999,)], "doc_id bigint"))
    lazy = build_index(goods(spark, 0, 100), "id").with_deletes(spark.createDataFrame([(i,) for i in (1, 2, 3, 4, 77)], "doc_id bigint"))
    queries = [TermQuery("title", "dog"), BooleanQuery(SHOULD, BooleanQuery(MUST, StringQuery("title", "Common fox"), TermQuery("title", "fox")), NumericRangeQuery("price", 1, 2))]
    asked = spark.createDataFrame([(0, "title", "common"), (1, "title", "cat")], "qid int, field string, term string")
    want = [rows(Searcher(lazy).search(q)) for q in queries], rows(Searcher(lazy).search_many_terms(asked, 9))
    for index in (store.open(), (store.merge(), store.open())[1], store.open().with_deletes(spark.createDataFrame([(1,)], "doc_id bigint"))):
        assert index.num_docs().first()[0] == 95 and len(store.manifest()["deletes"]) in (1, 3)
        assert ([rows(Searcher(index).search(q)) for q in queries], rows(Searcher(index).search_many_terms(asked, 9))) == want


@pytest.fixture(scope="module")
def wide(spark, tmp_path_factory):
    store = IndexStore(spark, f"{tmp_path_factory.mktemp('wide')}/index")
    for a, b in ((0, 3000), (3000, 5000)):
        store.append(spark.range(a, b).selectExpr("id", "concat(elt(id % 7 + 1, 'ant', 'bee', 'cat', 'dog', 'eel', 'fox', 'gnu'), ' common') AS title", "cast((id * 7919) % 5000 AS double) / 10 AS price", "concat('other', id) AS note"), "id")
    return store


def test_plans_of_a_stored_index(spark, wide):
    search = Searcher(wide.open())
    for df in (search.search(TermQuery("title", "dog"), 5), search.search(StringQuery("title", "common dog"), 5)):
        text = plan(df)
        assert "/stored" not in text and not re.search("Cartesian|NestedLoop", text)
        assert re.search(r"PartitionFilters: \[isnotnull\(field#\d+L?\), \(field#\d+ = title\)\]", text)
        assert "EqualTo(term,dog)" in text or "In(term, [common,dog])" in text
    asked = spark.createDataFrame([(0, "title", "dog"), (1, "title", "common")], "qid int, field string, term string")
    text = plan(search.search_many_terms(asked, 5))
    assert "In(term, [" in text and "/stored" not in text and "SortMergeJoin" not in text
    assert "WindowGroupLimit" in text
    strings = spark.createDataFrame([(0, "title", "dog common")], "qid int, field string, text string")
    text = plan(search.search_many_strings(strings, 5))
    assert "In(term, [" in text and "/stored" not in text and "SortMergeJoin" not in text


def test_a_cached_index_can_be_closed(spark, wide):
    index = wide.open().cache()
    try:
        assert "InMemoryTableScan" in plan(Searcher(index).search(TermQuery("title", "dog"), 5))
    finally:
        index.close()
    found = Searcher(index).search(TermQuery("title", "dog"), 5)
    assert "InMemoryTableScan" not in plan(found) and found.count() == 5
    assert "GreaterThan(value,499.0)" in plan(Searcher(index).visit(NumericRangeQuery("price", 1, 600), F.col("value") > 499))


def test_large_batches_take_the_other_join(spark, wide, monkeypatch):
    search = Searcher(wide.open())
    asked = spark.createDataFrame([(i, "title", "ant bee cat dog eel fox gnu zzz yyy".split()[i % 9]) for i in range(40)], "qid int, field string, term string")
    texts = spark.createDataFrame([(i, "title", "common " + "ant bee cat dog eel fox gnu zzz yyy".split()[i % 9]) for i in range(30)], "qid int, field string, text string")
    few = rows(search.search_many_terms(asked, 4)), rows(search.search_many_strings(texts, 4))
    monkeypatch.setattr(searcher, "MOST_ASKED", 10)
    assert (rows(search.search_many_terms(asked, 4)), rows(search.search_many_strings(texts, 4))) == few and len(few[0]) > 100


def test_range_top_n_stops_early(spark, wide):
    index = wide.open()
    search = Searcher(index)
    assert index.least_bound("price", 100.0, 20) < 110 and index.least_bound("price", 490.0, 5000) is None
    for lower, upper, n in ((100, 400, 20), (-5, 1e9, 7), (499, 600, 50), (250, 250.5, 3), (3, 2, 5), (-math.inf, math.inf, 6000)):
        got = [r.doc_id for r in search.search(NumericRangeQuery("price", lower, upper), n).collect()]
        want = sorted((i * 7919 % 5000 / 10, i) for i in range(5000) if lower <= i * 7919 % 5000 / 10 <= upper)[:n]
        assert got == [i for _, i in want]
    assert "LessThanOrEqual(value,10" in plan(search.search(NumericRangeQuery("price", 100, 400), 20))


def test_wide_and_infinite_ranges(spark, wide, monkeypatch):
    r = random.Random(3)
    inf = math.inf
    ranges = [(0, -inf, inf), (1, 100.0, inf), (2, -inf, 3.0), (3, 0.0, 1e300), (4, 10.0, 10.0), (5, 1e17, 2e17)]
    ranges += [(10 + i, a, a + w) for i, (a, w) in enumerate((r.uniform(-10, 400), 10 ** r.uniform(-2, 5)) for _ in range(40))]
    got = Searcher(wide.open()).search_many_ranges(spark.createDataFrame(ranges, "qid int, lower double, upper double"), "price", 0.01, 30).collect()
    points = [(i * 7919 % 5000 / 10, i) for i in range(5000)]
    assert {(x.qid, x.doc_id, x["rank"]) for x in got} == {(q, i, k + 1) for q, a, b in ranges for k, (v, i) in enumerate(sorted(p for p in points if a <= p[0] <= b)[:30])}


def test_whole_and_decimal_numbers_are_not_rounded(spark, tmp_path):
    big = 1 << 53
    df = spark.createDataFrame([(i, big + i, Decimal(big * 1000 + i) / 1000) for i in range(4)], "id bigint, n bigint, d decimal(25,3)")
    store = IndexStore(spark, f"{tmp_path}/index")
    store.append(df, "id")
    for index in (build_index(df, "id"), store.open()):
        found = lambda f, a, b: [x[0] for x in rows(Searcher(index).search(NumericRangeQuery(f, a, b)))]
        assert found("n", big + 1, big + 1) == [1] and found("n", big + 1, math.inf) == [1, 2, 3] and found("n", -math.inf, big + 0.0) == [0]
        assert found("n", 0.5, 0.7) == [] and found("n", 1e300, 1e301) == [] and found("n", float("nan"), 1.0) == []
        assert found("d", Decimal(big * 1000 + 1) / 1000, Decimal(big * 1000 + 2) / 1000) == [1, 2] and found("d", -math.inf, math.inf) == [0, 1, 2, 3]


def test_columns_of_fetched_documents(spark, wide):
    found = Searcher(wide.open()).fetch(TermQuery("title", "dog"), 2, ["price"])
    assert found.columns == ["doc_id", "price", "score"] and found.count() == 2
    assert re.search(r"ReadSchema: struct<doc_id:bigint,price:double>", plan(found))


def test_lines_of_many_files_and_splits(spark, tmp_path):
    folder = tmp_path / "in"
    folder.mkdir()
    r = random.Random(1)
    sizes = {"a.tsv": 2000, "b.tsv": 10, "c.tsv": 700, "d.tsv": 0, "e.tsv": 1}
    want, at = [], 0
    for name in sorted(sizes):
        lines = [f"{name}-{i}\t{'x' * r.randrange(200)}\t{i}" for i in range(sizes[name])]
        (folder / name).write_text("".join(x + "\n" for x in lines))
        want += [(at + i, x) for i, x in enumerate(lines)]
        at += len(lines)
    before = spark.conf.get("spark.sql.files.maxPartitionBytes"), spark.conf.get("spark.sql.files.openCostInBytes")
    try:
        spark.conf.set("spark.sql.files.maxPartitionBytes", "20000")
        spark.conf.set("spark.sql.files.openCostInBytes", "10")
        found = numbered_lines(spark, str(folder))
        assert found.rdd.getNumPartitions() > 8 and rows(found) == want
        assert load_documents(spark, str(folder), 5).count() == 5
    finally:
        spark.conf.set("spark.sql.files.maxPartitionBytes", before[0])
        spark.conf.set("spark.sql.files.openCostInBytes", before[1])


def test_decoding(spark):
    ns = [0, 1, 127, 128, 300, (1 << 35) + 5, (1 << 56) - 1, (1 << 63) - 1]
    df = spark.createDataFrame([(n,) for n in ns], "n bigint").select(
        "n", numeric.from_variable_length(F.concat(numeric.variable_length(F.col("n")), F.unhex(F.lit("FF")))).alias("v"), numeric.from_seven_bit(numeric.seven_bit(F.col("n"))).alias("s"),
        numeric.from_big_endian(numeric.big_endian(F.col("n"))).alias("b"), numeric.from_big_endian(numeric.big_endian(-F.col("n"))).alias("m"), numeric.shifted_seven_bit(F.col("n"), 5).alias("x"),
    )
    for r in df.collect():
        assert (r.v, r.s, r.b, r.m) == (r.n, r.n, r.n, -r.n) and r.x[0] == 5 and len(r.x) == 11
    odd = spark.createDataFrame([(b"",), (b"\x80",), (b"\x80" * 12,), (None,)], "b binary")
    assert [tuple(r) for r in odd.select(numeric.from_variable_length(F.col("b")), numeric.from_seven_bit(F.col("b")), numeric.from_big_endian(F.col("b"))).collect()] == [(None, None, None)] * 4
    pairs = [(b"a", b"b", -1), (b"\xff", b"\x01", 1), (b"a", b"ab", 1), (b"ab", b"a", -1), (b"", b"", 0), (b"x", b"", -1), (b"same", b"same", 0)]
    got = spark.createDataFrame([p[:2] for p in pairs], "a binary, b binary").select(numeric.compare_bytes(F.col("a"), F.col("b"))).collect()
    assert [r[0] for r in got] == [p[2] for p in pairs]
    day = spark.createDataFrame([("2024-03-07",)], "d string").select(numeric.date_text(F.col("d").cast("date"))).first()[0]
    assert day == "20240307" and re.fullmatch(r"\d{8}", spark.range(1).select(numeric.date_text()).first()[0])


def test_paths_against_all_segmentations(spark):
    r = random.Random(2)
    words = {"".join(r.choice("ab") for _ in range(r.randrange(2, 5))) for _ in range(9)} | {"abba" * 3}
    for _ in range(60):
        text = "".join(r.choice("ab") for _ in range(r.randrange(0, 11)))

        def every(at):
            if at == len(text):
                return [[]]
            return [[(text[at:end], at), *rest] for end in range(at + 1, len(text) + 1) if end == at + 1 or text[at:end] in words for rest in every(end)]

        want = sorted(map(len, every(0)))[:3] if text else []
        got = fewest_word_paths(text, 3, Dictionary(frozenset(words)))
        assert [len(p) for p in got] == want and all(p in every(0) for p in got) and len({tuple(p) for p in got}) == len(got)


def test_a_new_dictionary_replaces_the_old_one(spark, tmp_path):
    df = spark.createDataFrame([(1, "研究生命")], "id bigint, t string")
    terms = lambda words: {r.term for r in build_index(df, "id", analyzer=Analyzer(words=frozenset(words))).postings.collect()}
    assert terms(["研究", "生命"]) == {"研究", "生命"} and terms(["研究生"]) == {"研究生", "命"}
    (tmp_path / "p.txt").write_text("、\n-\n\n.\n", encoding="utf-8")
    marks = load_punctuation(spark, str(tmp_path / "p.txt"))
    assert set(marks) == set("、-.")
    index = build_index(spark.createDataFrame([(1, "a-b 1.5、c")], "id bigint, t string"), "id", analyzer=Analyzer(punctuation=marks))
    assert {r.term for r in index.postings.collect()} == {"a", "b", "1", "5", "c"}
    long = "中" * 30
    index = lambda n: build_index(spark.createDataFrame([(1, long)], "id bigint, t string"), "id", analyzer=Analyzer(longest_run=n)).postings.first().tf
    assert (index(20), index(None)) == (20, 30)


def test_format_gate(spark, tmp_path):
    store = IndexStore(spark, f"{tmp_path}/index")
    store.append(goods(spark, 0, 3), "id")
    store._commit(store.manifest() | {"format_version": None})
    with pytest.raises(stores.FormatTooOld):
        store.open()
