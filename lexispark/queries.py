"""Queries of the core, by name, and the SQL that gives the same rows."""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from lexispark.fields import DOUBLE, KEY, STRING, FieldSpec
from lexispark.functions import numeric
from lexispark.functions import text as tx
from lexispark.functions.scoring import average_length
from lexispark.functions.segment import segment_paths, segment_runs
from lexispark.operators.index import Analyzer, Index, as_documents, build_index, duplicate_keys
from lexispark.operators.searcher import Searcher, top_n
from lexispark.operators.skew import heavy_keys, key_counts
from lexispark.operators.store import IndexStore, merge_indexes
from lexispark.plans.query import MUST, SHOULD, BooleanQuery, NumericRangeQuery, StringQuery, TermQuery
from lexispark.plans.workload import random_ranges
from lexispark.session import scratch, table
from lexispark.sources.records import parse_records
from lexispark.sources.tsv import load_documents, load_titles, load_words, parse_goods
from lexispark.streaming.ingest import ingest

Query = Callable[[SparkSession, str], DataFrame]
QUERIES: dict[str, Query] = {}
SQL: dict[str, str] = {}


def query(sql: str | None = None) -> Callable[[Query], Query]:
    def add(f: Query) -> Query:
        QUERIES[f.__name__] = f
        if sql:
            SQL[f.__name__] = sql
        return f

    return add


_FIELD = r'(?:"(?:[^"]|"")*"|[^"\t][^\t]*|)'
_RECORDS_SQL = rf"""
WITH body AS (SELECT raw_id, regexp_replace(raw_line, '\r\z', '') AS line FROM goods_raw WHERE raw_line IS NOT NULL),
split AS (
  SELECT raw_id, line,
    regexp_matches(line, '\A{_FIELD}(?:\t{_FIELD})*\z') AS quoted_well,
    regexp_matches(line, '\A{_FIELD}\t{_FIELD}\t{_FIELD}\z') AS three,
    regexp_extract(line, '\A({_FIELD})\t{_FIELD}\t{_FIELD}\z', 1) AS a,
    regexp_extract(line, '\A{_FIELD}\t({_FIELD})\t{_FIELD}\z', 1) AS b,
    regexp_extract(line, '\A{_FIELD}\t{_FIELD}\t({_FIELD})\z', 1) AS c FROM body),
plain AS (
  SELECT raw_id, quoted_well, three,
    CASE WHEN starts_with(a, '"') THEN replace(substr(a, 2, length(a) - 2), '""', '"') ELSE a END AS source_id,
    CASE WHEN starts_with(b, '"') THEN replace(substr(b, 2, length(b) - 2), '""', '"') ELSE b END AS title,
    trim(CASE WHEN starts_with(c, '"') THEN replace(substr(c, 2, length(c) - 2), '""', '"') ELSE c END, ' ') AS price FROM split),
judged AS (
  SELECT *, CASE WHEN NOT quoted_well THEN 'quoting' WHEN NOT three THEN 'columns'
    WHEN regexp_matches(title, '\A[\s\x{{85}}\p{{Z}}]*\z|[\x00-\x08\x0a-\x1f\x{{fffd}}]') THEN 'title'
    WHEN NOT regexp_matches(price, '\A[+-]?[0-9]+(?:\.[0-9]+)?(?:[eE][+-]?[0-9]+)?\z')
      OR NOT isfinite(coalesce(try_cast(price AS DOUBLE), 'inf'::DOUBLE)) THEN 'price' END AS reason FROM plain)
"""


@query(_RECORDS_SQL + "SELECT raw_id, reason FROM judged WHERE reason IS NOT NULL")
def p4_found(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Lines that do not load, with the first reason."""
    parsed = parse_records(table(spark, sf_dir, "goods_raw"), "raw_id", "raw_line")
    return parsed.where("reason IS NOT NULL AND reason <> 'missing'").select(F.col("record_id").alias("raw_id"), "reason")


@query(_RECORDS_SQL + "SELECT raw_id, source_id, title, try_cast(price AS DOUBLE) AS price FROM judged WHERE reason IS NULL")
def p4_loaded(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The rows that load."""
    parsed = parse_records(table(spark, sf_dir, "goods_raw"), "raw_id", "raw_line")
    return parsed.where("reason IS NULL").select(F.col("record_id").alias("raw_id"), "source_id", "title", "price")


_POSTINGS_SQL = """
WITH once AS (SELECT field, term, doc_id, coalesce(max(frequency), 0)::BIGINT AS frequency FROM postings
              WHERE term IS NOT NULL AND field IS NOT NULL AND doc_id IS NOT NULL GROUP BY ALL),
keys AS (
  SELECT 'term' AS key_kind, field || ':' || term AS key_name, count(*) AS postings, sum(frequency)::BIGINT AS occurrences FROM once GROUP BY field, term
  UNION ALL SELECT 'doc', doc_id::VARCHAR, count(*), sum(frequency)::BIGINT FROM once GROUP BY doc_id)
"""


@query(_POSTINGS_SQL + "SELECT key_kind, key_name FROM keys WHERE postings * 100 > (SELECT count(*) FROM once)")
def p6_found(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Terms and documents that alone hold more than 1 % of all postings."""
    return heavy_keys(table(spark, sf_dir, "postings")).select("key_kind", "key_name")


@query(_POSTINGS_SQL + "SELECT * FROM keys")
def p6_counts(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Postings and occurrences of every term and every document."""
    return key_counts(table(spark, sf_dir, "postings")).where("key_kind <> 'all'")


# --- Text ---------------------------------------------------------------------------------------------------

_WIDE_SQL, _HALF_SQL = tx.WIDE, tx.HALF.replace("'", "''")


def _normal_sql(value: str) -> str:
    half = f"translate(coalesce({value}, ''), '{_WIDE_SQL}', '{_HALF_SQL}')"
    return rf"regexp_replace(regexp_replace(lower({half}), '{tx.ASTRAL}', '  ', 'g'), '{tx.DROPPED}', ' ', 'g')"


def _postings_sql(source: str, key: str, value: str, field: str, longest: int | None = tx.LONGEST_RUN) -> str:
    """CTEs tokens, postings and field statistics of one text column, without a dictionary."""
    run = f"substr(token, 1, {longest})" if longest else "token"
    return rf"""
docs AS (SELECT {key} AS doc_id, {value} AS value FROM {source} WHERE {value} IS NOT NULL),
tokens AS (SELECT doc_id, value, unnest(regexp_extract_all({_normal_sql('value')}, '{tx.TOKEN}')) AS token FROM docs),
terms AS (SELECT doc_id, length(value) + length(regexp_replace(value, '[^\x{{10000}}-\x{{10FFFF}}]', '', 'g')) AS dl,
    unnest(CASE WHEN regexp_matches(token, '{tx.PLAIN}') THEN [token] ELSE string_split({run}, '') END) AS term FROM tokens),
postings AS (SELECT '{field}' AS field, term, doc_id, count(*)::INT AS tf, dl::INT AS dl FROM terms GROUP BY term, doc_id, dl),
stats AS (SELECT sum(length(value) + length(regexp_replace(value, '[^\x{{10000}}-\x{{10FFFF}}]', '', 'g')))::BIGINT AS len_sum, count(*) AS doc_count FROM docs)"""


def _scores_sql(dead: str = "SELECT NULL::BIGINT AS doc_id WHERE false", key: str = "p_partkey", source: str = "part") -> str:
    """CTE scored(term, doc_id, score) after the CTEs of ``_postings_sql``."""
    return f"""
dead AS ({dead}),
live AS (SELECT count(*) AS n FROM {source} WHERE {key} NOT IN (SELECT doc_id FROM dead)),
dfs AS (SELECT term, count(*) AS df FROM postings GROUP BY term),
inputs AS (SELECT term, doc_id, tf, dl, df, n, CAST(len_sum // doc_count AS FLOAT) AS avgdl FROM postings JOIN dfs USING (term), stats, live
  WHERE doc_id NOT IN (SELECT doc_id FROM dead)),
parts AS (SELECT *, CAST(ln(CAST(1 AS FLOAT) + CAST((CAST(n - df AS FLOAT) + CAST(0.5 AS FLOAT)) / (CAST(df AS FLOAT) + CAST(0.5 AS FLOAT)) AS FLOAT)) AS FLOAT) AS idf,
  CAST(tf AS FLOAT) + CAST(1.2 AS FLOAT) * (CAST(0.25 AS FLOAT) + CAST(0.75 AS FLOAT) * CAST(CAST(dl AS FLOAT) / avgdl AS FLOAT)) AS norm FROM inputs),
scored AS (SELECT term, doc_id, CASE WHEN avgdl = 0 THEN CAST(0 AS FLOAT) ELSE CAST(idf * CAST((CAST(tf AS FLOAT) * CAST(2.2 AS FLOAT)) / norm AS FLOAT) AS FLOAT) END AS score FROM parts)"""


def _documents(spark: SparkSession, sf_dir: str) -> DataFrame:
    return table(spark, sf_dir, "documents").select("doc_id", "text")


def _text_index(spark: SparkSession, sf_dir: str) -> Index:
    return build_index(_documents(spark, sf_dir), "doc_id")


def _part_index(spark: SparkSession, sf_dir: str) -> Index:
    """Part names and prices as the product corpus."""
    part = table(spark, sf_dir, "part")
    goods = part.select("p_partkey", F.col("p_name").alias("title"), F.col("p_retailprice").alias("price"), F.col("p_name").alias("descript"), F.col("p_retailprice").alias("digt"))
    specs = [FieldSpec("p_partkey", KEY, False), FieldSpec("title", STRING), FieldSpec("price", DOUBLE), FieldSpec("descript", STRING, False), FieldSpec("digt", DOUBLE, False)]
    return build_index(goods, "p_partkey", specs)


_TEXT = "WITH " + _postings_sql("documents", "doc_id", "text", "text")
_PART = "WITH " + _postings_sql("part", "p_partkey", "p_name", "title")
_ONE_TITLE = "(SELECT unique_id, min(title) AS title FROM goods_doc WHERE title IS NOT NULL GROUP BY unique_id)"
_TITLES = "WITH " + _postings_sql(_ONE_TITLE, "unique_id", "title", "title")


def _titles(spark: SparkSession, sf_dir: str) -> DataFrame:
    return table(spark, sf_dir, "goods_doc").where("title IS NOT NULL").groupBy("unique_id").agg(F.min("title").alias("title"))


@query(f"SELECT doc_id, {_normal_sql('text')} AS normalized FROM documents")
def normalize_text(spark: SparkSession, sf_dir: str) -> DataFrame:
    """F1-F6 over every text."""
    return _documents(spark, sf_dir).select("doc_id", tx.normalize(F.col("text")).alias("normalized"))


@query("SELECT * FROM (VALUES ('Ａｂｃ　１２', 'abc 12'), ('臺灣', '台湾'), ('Hello,  world!' || chr(10) || 'foo', 'hello   world  foo'), ('C++ 11', 'c   11'), ('a、b', 'a b'), ('', '')) AS t(value, normalized)")
def normalize_golden(spark: SparkSession, sf_dir: str) -> DataFrame:
    """F1-F6 with simplified characters and a punctuation list."""
    rows = [("Ａｂｃ　１２",), ("臺灣",), ("Hello,  world!\nfoo",), ("C++ 11",), ("a、b",), ("",)]
    return spark.createDataFrame(rows, "value string").select("value", tx.normalize(F.col("value"), tx.simplified_characters(), "、").alias("normalized"))


@query(f"SELECT doc_id, translate({_normal_sql('text')}, '-.', '  ') AS normalized FROM documents")
def normalize_punctuation(spark: SparkSession, sf_dir: str) -> DataFrame:
    """F5 over every text: listed characters become blanks."""
    return _documents(spark, sf_dir).select("doc_id", tx.normalize(F.col("text"), punctuation="-.").alias("normalized"))


@query(_TEXT + " SELECT doc_id, token, count(*) AS n FROM tokens GROUP BY doc_id, token")
def analyze_tokens(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Tokens of every text, with their number."""
    tokens = _documents(spark, sf_dir).select("doc_id", F.explode(tx.tokens(tx.normalize(F.col("text")))).alias("token"))
    return tokens.groupBy("doc_id", "token").agg(F.count("*").alias("n"))


@query(rf"""WITH parts AS (SELECT p_partkey AS doc_id, regexp_extract_all({_normal_sql('p_name')}, '{tx.TOKEN}| ') AS all_parts FROM part),
numbered AS (SELECT doc_id, unnest(all_parts) AS token, generate_subscripts(all_parts, 1) AS ord FROM parts),
placed AS (SELECT doc_id, token, coalesce(sum(length(token)) OVER (PARTITION BY doc_id ORDER BY ord ROWS BETWEEN UNBOUNDED PRECEDING AND 1 PRECEDING), 0)::BIGINT AS pos FROM numbered)
SELECT doc_id, token, pos FROM placed WHERE token <> ' '""")
def term_positions(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Tokens of every part name with their places."""
    parts = table(spark, sf_dir, "part").select(F.col("p_partkey").alias("doc_id"), F.posexplode(tx.tokens_with_gaps(tx.normalize(F.col("p_name")))).alias("at", "token"))
    before = Window.partitionBy("doc_id").orderBy("at").rowsBetween(Window.unboundedPreceding, -1)
    return parts.select("doc_id", "token", F.coalesce(F.sum(F.length("token")).over(before), F.lit(0)).alias("pos")).where("token <> ' '")


@query("SELECT * FROM (VALUES ('iPhone 14 Pro-Max 3.5kg', 'iphone@0 14@7 pro-max@10 3.5@18 kg@21'), ('étion de', 'é@0 tion@1 de@6'), ('-5 .net a-中b', '-@0 5@1 .@3 n@4 e@5 t@6 a-中@8 b@11'), ('v2.0-beta1', 'v@0 2.0-beta@1 1@9'), ('That it.', 'that@0 it.@5'), ('a__b', 'a@0 b@3')) AS t(value, terms)")
def analyze_golden(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Terms and places of query strings, as the driver analyses them."""
    texts = ["iPhone 14 Pro-Max 3.5kg", "étion de", "-5 .net a-中b", "v2.0-beta1", "That it.", "a__b"]
    return spark.createDataFrame([(t, " ".join(f"{x}@{p}" for x, p in Analyzer().terms_python(t))) for t in texts], "value string, terms string")


# --- Index --------------------------------------------------------------------------------------------------


@query(_TEXT + " SELECT field, term, doc_id, tf, dl FROM postings")
def postings_tf(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The inverted index of every text."""
    return _text_index(spark, sf_dir).postings


@query(_TITLES + " SELECT field, term, doc_id, tf, dl FROM postings")
def postings_titles(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The inverted index of every product title, Han characters one by one."""
    return build_index(_titles(spark, sf_dir), "unique_id").postings


@query("WITH " + _postings_sql(_ONE_TITLE, "unique_id", "title", "title", None) + " SELECT field, term, doc_id, tf, dl FROM postings")
def postings_whole_runs(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The same without the cut of long runs: every character of every title is in the index."""
    return build_index(_titles(spark, sf_dir), "unique_id", analyzer=Analyzer(longest_run=None)).postings


@query(_TEXT + " SELECT field, term, count(*) AS df, sum(tf)::BIGINT AS occurrences FROM postings GROUP BY field, term")
def term_df(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Document frequency of every term."""
    return _text_index(spark, sf_dir).postings.groupBy("field", "term").agg(F.count("*").alias("df"), F.sum("tf").alias("occurrences"))


@query("""SELECT 'text' AS field, 'string' AS type, sum(length(text) + length(regexp_replace(text, '[^\\x{10000}-\\x{10FFFF}]', '', 'g')))::BIGINT AS len_sum, count(text) AS doc_count FROM documents
UNION ALL SELECT 'doc_id', 'key', 8 * count(*)::BIGINT, count(*) FROM documents""")
def field_stats(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Length sums and document counts of all fields."""
    return _text_index(spark, sf_dir).stats


@query(_TEXT + " SELECT (len_sum // doc_count)::FLOAT AS avgdl, doc_count FROM stats")
def average_field_length(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Floored average length of the texts."""
    return _text_index(spark, sf_dir).stats.where("field = 'text'").select(average_length(F.col("len_sum"), F.col("doc_count")).alias("avgdl"), "doc_count")


# --- Search -------------------------------------------------------------------------------------------------


@query(_TEXT + "," + _scores_sql(key="doc_id", source="documents") + " SELECT doc_id, score FROM scored WHERE term = 'the'")
def term_query_scores(spark: SparkSession, sf_dir: str) -> DataFrame:
    return Searcher(_text_index(spark, sf_dir)).search(TermQuery("text", "the"))


@query(_TEXT + "," + _scores_sql(key="doc_id", source="documents") + " SELECT doc_id, score FROM scored WHERE term = 'the' ORDER BY score DESC, doc_id LIMIT 10")
def term_query_top10(spark: SparkSession, sf_dir: str) -> DataFrame:
    return Searcher(_text_index(spark, sf_dir)).search(TermQuery("text", "the"), 10)


@query("SELECT NULL::BIGINT AS doc_id, NULL::FLOAT AS score WHERE false")
def term_query_unknown(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Terms are not analysed, so a capital finds nothing; neither does an unknown field."""
    search = Searcher(_text_index(spark, sf_dir))
    return search.search(TermQuery("text", "The")).unionByName(search.search(TermQuery("nothing", "the")))


def _string_sql(weights: dict[str, int], complete: bool = True) -> str:
    names = ", ".join(f"('{t}', {w}, {i})" for i, (t, w) in enumerate(weights.items()))
    rest = f"""asked(term, times, ord) AS (VALUES {names}),
joined AS (SELECT doc_id, score, times, ord FROM scored JOIN asked USING (term)),
by_doc AS (SELECT doc_id, count(*) AS have, CAST(sum(CAST(score AS DOUBLE) * times) AS FLOAT) AS every, arg_min(score, ord) AS first FROM joined GROUP BY doc_id)"""
    return rest + (f" SELECT doc_id, every AS score FROM by_doc WHERE have = {len(weights)}" if complete else " SELECT doc_id, first AS score FROM by_doc")


_PART_SCORES = _PART + "," + _scores_sql()


@query(_PART_SCORES + "," + _string_sql({"red": 1, "widget": 1}))
def string_query_and(spark: SparkSession, sf_dir: str) -> DataFrame:
    return Searcher(_part_index(spark, sf_dir)).search(StringQuery("title", "Red widget"))


@query(_PART_SCORES + "," + _string_sql({"red": 1, "blue": 1}, complete=False))
def string_query_or_fallback(spark: SparkSession, sf_dir: str) -> DataFrame:
    """No part is red and blue."""
    return Searcher(_part_index(spark, sf_dir)).search(StringQuery("title", "red blue"))


@query(_PART_SCORES + "," + _string_sql({"red": 2}))
def string_query_repeated_term(spark: SparkSession, sf_dir: str) -> DataFrame:
    return Searcher(_part_index(spark, sf_dir)).search(StringQuery("title", "red red"))


_RED = "red AS (SELECT doc_id, score FROM scored WHERE term = 'red'), widget AS (SELECT doc_id, score FROM scored WHERE term = 'widget'), blue AS (SELECT doc_id, score FROM scored WHERE term = 'blue')"


@query(f"{_PART_SCORES}, {_RED} SELECT doc_id, CAST(r.score::DOUBLE + w.score::DOUBLE AS FLOAT) AS score FROM red r JOIN widget w USING (doc_id)")
def bool_must(spark: SparkSession, sf_dir: str) -> DataFrame:
    return Searcher(_part_index(spark, sf_dir)).search(BooleanQuery(MUST, TermQuery("title", "red"), TermQuery("title", "widget")))


@query(f"{_PART_SCORES}, {_RED} SELECT doc_id, coalesce(r.score, w.score) AS score FROM red r FULL JOIN widget w USING (doc_id)")
def bool_should_first_clause(spark: SparkSession, sf_dir: str) -> DataFrame:
    return Searcher(_part_index(spark, sf_dir)).search(BooleanQuery(SHOULD, TermQuery("title", "red"), TermQuery("title", "widget")))


@query(f"""{_PART_SCORES}, {_RED}, colour AS (SELECT doc_id, coalesce(r.score, b.score) AS score FROM red r FULL JOIN blue b USING (doc_id))
SELECT doc_id, CAST(c.score::DOUBLE + w.score::DOUBLE AS FLOAT) AS score FROM colour c JOIN widget w USING (doc_id)""")
def bool_nested(spark: SparkSession, sf_dir: str) -> DataFrame:
    colour = BooleanQuery(SHOULD, TermQuery("title", "red"), TermQuery("title", "blue"))
    return Searcher(_part_index(spark, sf_dir)).search(BooleanQuery(MUST, colour, TermQuery("title", "widget")))


@query(f"{_PART_SCORES}, {_RED} SELECT doc_id, score FROM widget JOIN part ON p_partkey = doc_id WHERE p_retailprice BETWEEN 905 AND 920")
def bool_term_and_range(spark: SparkSession, sf_dir: str) -> DataFrame:
    return Searcher(_part_index(spark, sf_dir)).search(BooleanQuery(MUST, TermQuery("title", "widget"), NumericRangeQuery("price", 905, 920)))


@query(_PART_SCORES + "," + _string_sql({"red": 1, "widget": 1}) + " AND doc_id IN (SELECT p_partkey FROM part WHERE p_retailprice BETWEEN 905 AND 1000)")
def bool_string_and_range(spark: SparkSession, sf_dir: str) -> DataFrame:
    """A string query as a clause."""
    return Searcher(_part_index(spark, sf_dir)).search(BooleanQuery(MUST, StringQuery("title", "Red widget"), NumericRangeQuery("price", 905, 1000)))


@query(f"{_PART_SCORES}, {_RED} SELECT doc_id, score FROM widget WHERE doc_id NOT IN (SELECT doc_id FROM red)")
def bool_must_not(spark: SparkSession, sf_dir: str) -> DataFrame:
    """An extension."""
    return Searcher(_part_index(spark, sf_dir)).search(BooleanQuery(MUST, TermQuery("title", "widget"), must_not=(TermQuery("title", "red"),)))


@query("SELECT p_partkey AS doc_id, 0::FLOAT AS score FROM part WHERE p_retailprice BETWEEN 910 AND 930")
def range_all(spark: SparkSession, sf_dir: str) -> DataFrame:
    return Searcher(_part_index(spark, sf_dir)).search(NumericRangeQuery("price", 910, 930))


@query("SELECT p_partkey AS doc_id, p_retailprice AS value FROM part WHERE p_retailprice BETWEEN 910 AND 1100 AND p_retailprice - floor(p_retailprice) < 0.5")
def range_visited(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The points of a range that a visitor takes."""
    return Searcher(_part_index(spark, sf_dir)).visit(NumericRangeQuery("price", 910, 1100), F.col("value") - F.floor("value") < 0.5)


@query("SELECT p_partkey AS doc_id, 0::FLOAT AS score FROM part WHERE p_retailprice BETWEEN 910 AND 930 ORDER BY p_retailprice, p_partkey LIMIT 25")
def range_smallest_n(spark: SparkSession, sf_dir: str) -> DataFrame:
    return Searcher(_part_index(spark, sf_dir)).search(NumericRangeQuery("price", 910, 930), 25)


@query("SELECT NULL::BIGINT AS doc_id, NULL::FLOAT AS score WHERE false")
def range_inverted_empty(spark: SparkSession, sf_dir: str) -> DataFrame:
    return Searcher(_part_index(spark, sf_dir)).search(NumericRangeQuery("price", 930, 910))


@query("SELECT c_custkey AS doc_id, 0::FLOAT AS score FROM customer WHERE c_acctbal BETWEEN -500 AND 500")
def range_mixed_sign(spark: SparkSession, sf_dir: str) -> DataFrame:
    customers = table(spark, sf_dir, "customer").select("c_custkey", "c_acctbal")
    return Searcher(build_index(customers, "c_custkey")).search(NumericRangeQuery("c_acctbal", -500, 500))


_RANGES = [(i, a, b) for i, (a, b) in enumerate(random_ranges(32))]
_RANGES_SQL = ", ".join(f"({q}, {a!r}::DOUBLE, {b!r}::DOUBLE)" for q, a, b in _RANGES)


@query(f"""WITH asked(qid, lower, upper) AS (VALUES {_RANGES_SQL}),
hits AS (SELECT qid, p_partkey AS doc_id, p_retailprice - 899 AS value FROM part JOIN asked ON p_retailprice - 899 BETWEEN lower AND upper),
ranked AS (SELECT *, row_number() OVER (PARTITION BY qid ORDER BY value, doc_id) AS rank FROM hits) SELECT qid, doc_id, value, rank::INT AS rank FROM ranked WHERE rank <= 500""")
def range_workload_32(spark: SparkSession, sf_dir: str) -> DataFrame:
    """32 ranges of width 20 in [1, 100], the 500 smallest of each, in one job."""
    part = table(spark, sf_dir, "part").select("p_partkey", (F.col("p_retailprice") - 899).alias("price"))
    ranges = spark.createDataFrame(_RANGES, "qid int, lower double, upper double")
    return Searcher(build_index(part, "p_partkey")).search_many_ranges(ranges, "price", 20.0, 500)


_WORDS = ["red", "blue", "green", "small", "large", "widget", "bolt", "ring", "gear", "plate", "valve", "nut", "steel", "brass", "tin", "copper"]
_MANY_SQL = ", ".join(f"({i}, '{w}')" for i, w in enumerate(_WORDS * 2))


@query(f"""{_PART_SCORES}, asked(qid, term) AS (VALUES {_MANY_SQL}),
ranked AS (SELECT qid, doc_id, score, row_number() OVER (PARTITION BY qid ORDER BY score DESC, doc_id) AS rank FROM scored JOIN asked USING (term))
SELECT qid, doc_id, score, rank::INT AS rank FROM ranked WHERE rank <= 500""")
def search_many_32(spark: SparkSession, sf_dir: str) -> DataFrame:
    """32 term queries, the 500 best of each, in one job."""
    asked = spark.createDataFrame([(i, "title", w) for i, w in enumerate(_WORDS * 2)], "qid int, field string, term string")
    return Searcher(_part_index(spark, sf_dir)).search_many_terms(asked, 500)


_PHRASES = [(i, f"{a} {b}") for i, (a, b) in enumerate((a, b) for a in _WORDS[:8] for b in _WORDS[5:9])]
_PHRASES_SQL = ", ".join(f"({i}, '{p}')" for i, p in _PHRASES)


@query(f"""{_PART_SCORES}, phrases(qid, text) AS (VALUES {_PHRASES_SQL}),
words AS (SELECT qid, unnest(string_split(text, ' ')) AS term, generate_subscripts(string_split(text, ' '), 1) AS ord FROM phrases),
asked AS (SELECT qid, term, count(*) AS times, min(ord) AS first FROM words GROUP BY qid, term),
sizes AS (SELECT qid, count(*) AS terms FROM asked GROUP BY qid),
by_doc AS (SELECT qid, doc_id, count(*) AS have, CAST(sum(CAST(score AS DOUBLE) * times) AS FLOAT) AS every, arg_min(score, first) AS firsthit FROM asked JOIN scored USING (term) GROUP BY qid, doc_id),
chosen AS (SELECT b.*, max(have) OVER (PARTITION BY qid) = terms AS complete, terms FROM by_doc b JOIN sizes USING (qid)),
hits AS (SELECT qid, doc_id, CASE WHEN complete THEN every ELSE firsthit END AS score FROM chosen WHERE NOT complete OR have = terms),
ranked AS (SELECT *, row_number() OVER (PARTITION BY qid ORDER BY score DESC, doc_id) AS rank FROM hits) SELECT qid, doc_id, score, rank::INT AS rank FROM ranked WHERE rank <= 500""")
def search_many_strings_32(spark: SparkSession, sf_dir: str) -> DataFrame:
    """32 analysed string queries with their fallback, the 500 best of each, in one job."""
    asked = spark.createDataFrame([(i, "title", p) for i, p in _PHRASES], "qid int, field string, text string")
    return Searcher(_part_index(spark, sf_dir)).search_many_strings(asked, 500)


_STORED = "p_name AS title, p_retailprice AS price, p_name AS descript, p_retailprice AS digt"


@query(f"{_PART_SCORES}, best AS (SELECT doc_id, score FROM scored WHERE term = 'widget' ORDER BY score DESC, doc_id LIMIT 10) SELECT doc_id, {_STORED}, score FROM best JOIN part ON p_partkey = doc_id")
def fetch_docs(spark: SparkSession, sf_dir: str) -> DataFrame:
    return Searcher(_part_index(spark, sf_dir)).fetch(TermQuery("title", "widget"), 10)


@query(f"SELECT p_partkey AS doc_id, {_STORED}, 0::FLOAT AS score FROM part WHERE p_retailprice BETWEEN 905.7 AND 918.56")
def stored_projection(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Documents of a range, to be sorted by price on the caller's side."""
    search = Searcher(_part_index(spark, sf_dir))
    return search.docs(search.search(NumericRangeQuery("price", 905.7, 918.56))).orderBy("price", "doc_id")


@query("SELECT p_partkey AS doc_id, '{\"title\":\"' || p_name || '\",\"kind\":\"' || p_type || '\",\"score\":0.0}' AS json FROM part WHERE p_retailprice <= 905")
def docs_as_json(spark: SparkSession, sf_dir: str) -> DataFrame:
    part = table(spark, sf_dir, "part").select("p_partkey", F.col("p_name").alias("title"), F.col("p_type").alias("kind"), F.col("p_retailprice").alias("price"))
    specs = [FieldSpec("p_partkey", KEY, False), FieldSpec("title", STRING), FieldSpec("kind", STRING, False), FieldSpec("price", DOUBLE, True, False)]
    search = Searcher(build_index(part, "p_partkey", specs))
    return search.json(search.docs(search.search(NumericRangeQuery("price", -1, 905))))


# --- Deletes, keys, segments --------------------------------------------------------------------------------

_DEAD = "SELECT o_custkey AS doc_id FROM orders WHERE o_custkey IN (SELECT p_partkey FROM part)"


def _with_deletes(spark: SparkSession, sf_dir: str) -> Index:
    """Every row of orders is a delete."""
    return _part_index(spark, sf_dir).with_deletes(table(spark, sf_dir, "orders").select(F.col("o_custkey").alias("doc_id")))


@query(f"{_PART},{_scores_sql(_DEAD)} SELECT doc_id, score FROM scored WHERE term = 'widget'")
def bm25_after_delete(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Live documents count in n, deleted postings still in df."""
    return Searcher(_with_deletes(spark, sf_dir)).search(TermQuery("title", "widget"))


@query(f"SELECT p_partkey AS doc_id, {_STORED}, 0::FLOAT AS score FROM part WHERE p_retailprice BETWEEN 910 AND 990 AND p_partkey NOT IN ({_DEAD})")
def delete_then_search(spark: SparkSession, sf_dir: str) -> DataFrame:
    search = Searcher(_with_deletes(spark, sf_dir))
    return search.docs(search.search(NumericRangeQuery("price", 910, 990)))


@query(f"SELECT count(*) AS num_docs, (SELECT max(p_partkey) FROM part) AS total_docs FROM part WHERE p_partkey NOT IN ({_DEAD})")
def num_docs(spark: SparkSession, sf_dir: str) -> DataFrame:
    index = _with_deletes(spark, sf_dir)
    return index.num_docs().withColumn("total_docs", index.total_docs().scalar())


@query("SELECT unique_id AS doc_id, count(*) AS n FROM goods_doc GROUP BY unique_id HAVING count(*) > 1")
def pk_duplicates(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Products delivered more than once."""
    return duplicate_keys(as_documents(table(spark, sf_dir, "goods_doc").select("unique_id"), "unique_id"))


@query(_PART_SCORES + " SELECT doc_id, score FROM scored WHERE term = 'widget'")
def append_then_merge(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The parts appended as two segments of a store and compacted: the same scores as one index."""
    part = table(spark, sf_dir, "part").select("p_partkey", F.col("p_name").alias("title"), F.col("p_retailprice").alias("price"))
    store = IndexStore(spark, scratch(spark, "index"))
    store.append(part.where("p_partkey % 2 = 0"), "p_partkey")
    store.append(part.where("p_partkey % 2 = 1"), "p_partkey")
    store.merge()
    return Searcher(store.open()).search(TermQuery("title", "widget"))


@query("SELECT p_partkey AS doc_id, p_name AS title, p_retailprice AS price, 0::FLOAT AS score FROM part WHERE p_retailprice >= 910 ORDER BY p_retailprice, p_partkey LIMIT 40")
def range_after_merge(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The smallest prices from 910 on, out of the sorted points of two merged segments, with the documents."""
    part = table(spark, sf_dir, "part").select("p_partkey", F.col("p_name").alias("title"), F.col("p_retailprice").alias("price"))
    store = IndexStore(spark, scratch(spark, "index"))
    for k in range(2):
        store.append(part.where(f"p_partkey % 2 = {k}"), "p_partkey")
    store.merge()
    return Searcher(store.open()).fetch(NumericRangeQuery("price", 910, float("inf")), 40)


@query("SELECT p_partkey AS doc_id, p_name AS title, p_retailprice AS price FROM part")
def stream_ingest_rows(spark: SparkSession, sf_dir: str) -> DataFrame:
    """All parts through two streams of files, each with its own batches from 0 on."""
    work = scratch(spark, "index")
    part = table(spark, sf_dir, "part").select("p_partkey", F.col("p_name").alias("title"), F.col("p_retailprice").alias("price"))
    store = IndexStore(spark, f"{work}/index")
    for k in range(2):
        part.where(f"p_partkey % 2 = {k}").repartition(2).write.parquet(f"{work}/in-{k}")
        stream = spark.readStream.schema(part.schema).option("maxFilesPerTrigger", 1).parquet(f"{work}/in-{k}")
        ingest(stream, store, "p_partkey", f"{work}/checkpoint-{k}").awaitTermination()
    return store.open().stored


@query("SELECT * FROM (VALUES (1, 'append', 'done'), (2, 'append again', 'DuplicateKey'), (3, 'append under a replayed batch', 'nothing'), (4, 'open an old format', 'FormatTooOld'), (5, 'open after wipe', 'FileNotFoundError')) AS t(step, call, outcome)")
def store_outcomes(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Keys taken, a batch that is in, an old format, a wiped folder."""
    nation = table(spark, sf_dir, "nation").select("n_nationkey", "n_name")
    store = IndexStore(spark, scratch(spark, "index"))

    def outcome(call: Callable[[], object]) -> str:
        before = store.manifest()["next"]
        try:
            call()
        except (ValueError, FileNotFoundError) as e:
            return type(e).__name__
        return "done" if store.manifest()["next"] > before else "nothing"

    calls = {
        "append": lambda: store.append(nation, "n_nationkey", stream="s", batch=0),
        "append again": lambda: store.append(nation, "n_nationkey"),
        "append under a replayed batch": lambda: store.append(nation, "n_nationkey", stream="s", batch=0),
    }
    rows = [(call, outcome(f)) for call, f in calls.items()]
    store._commit(store.manifest() | {"format_version": 0})
    try:
        store.open()
    except ValueError as e:
        rows.append(("open an old format", type(e).__name__))
    store.wipe()
    rows.append(("open after wipe", outcome(store.open)))
    return spark.createDataFrame([(i + 1, *r) for i, r in enumerate(rows)], "step int, call string, outcome string")


@query("""SELECT 'p_name' AS field, 'string' AS type, sum(length(p_name))::BIGINT AS len_sum, count(*) AS doc_count FROM part
UNION ALL SELECT 'p_partkey', 'key', 8 * count(*)::BIGINT, count(*) FROM part UNION ALL SELECT 'p_retailprice', 'double', count(*)::BIGINT, count(*) FROM part""")
def merged_field_stats(spark: SparkSession, sf_dir: str) -> DataFrame:
    part = table(spark, sf_dir, "part").select("p_partkey", "p_name", "p_retailprice")
    a, b = (build_index(part.where(f"p_partkey % 3 {c} 0"), "p_partkey") for c in ("=", "<>"))
    return merge_indexes(a, b).stats


# --- Numbers ------------------------------------------------------------------------------------------------

_BITS = "(c_acctbal::DOUBLE::BIT)::BIGINT"
_SORTABLE = f"CASE WHEN {_BITS} >= 0 THEN xor({_BITS}, (-9223372036854775808)::BIGINT) ELSE ~{_BITS} END"


@query(f"SELECT c_custkey, {_SORTABLE} AS sortable, c_acctbal AS again FROM customer")
def sortable_double(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Order-preserving bits of every balance, and back."""
    there = table(spark, sf_dir, "customer").select("c_custkey", numeric.sortable_long(F.col("c_acctbal").cast("double")).alias("sortable"))
    return there.withColumn("again", numeric.sortable_double(F.col("sortable")))


@query("SELECT o_orderkey, s AS shift, o_orderkey & CASE WHEN s = 3 THEN -1 ELSE ~((1::BIGINT << (48 - 16 * s)) - 1) END AS prefix FROM orders, range(4) AS r(s)")
def prefix_terms(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Legacy range terms of every order key."""
    terms = table(spark, sf_dir, "orders").select("o_orderkey", F.explode(numeric.prefix_terms(F.col("o_orderkey"), 16)).alias("t"))
    return terms.select("o_orderkey", F.col("t.shift").cast("bigint").alias("shift"), "t.prefix")


@query("""SELECT o_orderkey, list_aggregate([printf('%02X', (o_orderkey >> s) & 127) FOR s IN [57, 50, 43, 36, 29, 22, 15, 8, 1]], 'string_agg', '') || printf('%02X', o_orderkey & 1) AS packed,
list_aggregate([printf('%02X', ((o_orderkey >> (7 * i)) & 127) | CASE WHEN (o_orderkey >> (7 * i + 7)) > 0 THEN 128 ELSE 0 END) FOR i IN range(9) IF i = 0 OR (o_orderkey >> (7 * i)) > 0], 'string_agg', '') AS short,
o_orderkey AS unpacked, o_orderkey AS lengthened, -o_orderkey AS ordered FROM orders""")
def number_codecs(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Order keys packed by seven bits and as numbers of variable length, and read back; negative ones from eight bytes."""
    key = F.col("o_orderkey")
    coded = table(spark, sf_dir, "orders").select("o_orderkey", numeric.seven_bit(key).alias("p"), numeric.variable_length(key).alias("v"), numeric.big_endian(-key).alias("b"))
    return coded.select(
        "o_orderkey", F.hex("p").alias("packed"), F.hex("v").alias("short"), numeric.from_seven_bit(F.col("p")).alias("unpacked"),
        numeric.from_variable_length(F.col("v")).alias("lengthened"), numeric.from_big_endian(F.col("b")).alias("ordered"),
    )


@query("""WITH pairs AS (SELECT c_custkey, c_name AS a, substr(c_name, 1, CAST(c_custkey % 20 AS INT)) || CASE WHEN c_custkey % 3 = 0 THEN 'é' ELSE '' END AS b FROM customer)
SELECT c_custkey, CASE WHEN a = b THEN 0 WHEN starts_with(b, a) THEN 1 WHEN starts_with(a, b) THEN -1 WHEN encode(a) < encode(b) THEN -1 ELSE 1 END::INT AS sign FROM pairs""")
def byte_order(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The order of byte strings in which a beginning of another one is the greater."""
    a, b = F.col("c_name"), F.concat(F.expr("substr(c_name, 1, int(c_custkey % 20))"), F.when(F.col("c_custkey") % 3 == 0, "é").otherwise(""))
    return table(spark, sf_dir, "customer").select("c_custkey", numeric.compare_bytes(F.encode(a, "utf-8"), F.encode(b, "utf-8")).alias("sign"))


@query("SELECT strftime(l_shipdate, '%Y%m%d') AS day, count(*) AS n FROM lineitem GROUP BY ALL")
def date_texts(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Ship dates as eight figures."""
    return table(spark, sf_dir, "lineitem").groupBy(numeric.date_text(F.col("l_shipdate")).alias("day")).agg(F.count("*").alias("n"))


# --- Segmentation and sources -------------------------------------------------------------------------------

_DICTIONARY = frozenset("丰田 凯美瑞 仪表台 防晒 隔热 防晒隔热 适用 适用于 于丰 研究 研究生 生命 命起 起源 喜欢 中控".split())
_GOLDEN = [("丰田凯美瑞", 1, "丰田/凯美瑞"), ("丰田凯美瑞", 2, "丰/田/凯美瑞"), ("丰田凯美瑞", 3, "丰田/凯/美/瑞"), ("适用于丰田", 1, "适用于/丰田"), ("适用于丰田", 2, "适用/于/丰田"),
    ("适用于丰田", 3, "适用/于丰/田"), ("研究生命起源", 1, "研究/生命/起源"), ("研究生命起源", 2, "研究生/命/起源"), ("研究生命起源", 3, "研究生/命起/源"), ("防晒隔热垫", 1, "防晒隔热/垫"),
    ("防晒隔热垫", 2, "防晒/隔热/垫"), ("防晒隔热垫", 3, "防/晒/隔热/垫"), ("我喜欢你", 1, "我/喜欢/你"), ("我喜欢你", 2, "我/喜/欢/你")]
_GOLDEN_SQL = ", ".join(f"('{t}', {i}, '{w}')" for t, i, w in _GOLDEN)


@query(f"SELECT * FROM (VALUES {_GOLDEN_SQL}) AS t(text, path, words)")
def segment_paths_golden(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Up to three paths of fewest words."""
    texts = spark.createDataFrame([(t,) for t in sorted({t for t, *_ in _GOLDEN})], "text string")
    return segment_paths(texts, "text", 3, _DICTIONARY).select("text", "path", F.array_join("words", "/").alias("words"))


@query("SELECT * FROM (VALUES ('研究生命起源', '研/究/生命起源'), ('适用于丰田', '适/用于/丰/田')) AS t(text, words)")
def dictionary_replaced(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Another dictionary takes the place of the first."""
    texts = spark.createDataFrame([("研究生命起源",), ("适用于丰田",)], "text string")
    return segment_paths(texts, "text", 1, frozenset(["生命起源", "用于"])).select("text", F.array_join("words", "/").alias("words"))


def _paths_sql(runs: str, n: int) -> str:
    """CTEs dict and ways(run, best): the n paths of fewest words of each distinct run, place by place."""
    return f"""
dict AS (SELECT list(DISTINCT trim(word)) AS words, max(length(trim(word))) AS longest FROM word_list WHERE trim(word) <> ''),
runs AS ({runs}),
steps AS (
  SELECT run, 0 AS place, [[{{'cost': 0::BIGINT, 'start': 0::BIGINT, 'rank': 0::BIGINT, 'path': []::STRUCT(term VARCHAR, pos INT)[]}}]] AS ways FROM runs
  UNION ALL
  SELECT run, place + 1, list_append(ways, list_slice(list_sort(flatten(list_transform(range(greatest(0, place + 1 - longest), place + 1), lambda s:
    CASE WHEN s = place OR list_contains(words, substr(run, s + 1, place + 1 - s)) THEN list_transform(ways[s + 1], lambda w, i: {{'cost': w.cost + 1, 'start': s, 'rank': i::BIGINT,
      'path': list_append(w.path, {{'term': substr(run, s + 1, place + 1 - s), 'pos': s::INT}})}}) ELSE [] END))), 1, {n})) FROM steps, dict WHERE place < length(run)),
ways AS (SELECT run, ways[length(run) + 1] AS best FROM steps WHERE place = length(run))"""


_CUT = f"substr(token, 1, {tx.LONGEST_RUN})"


def _runs_sql(run: str) -> str:
    return f"SELECT DISTINCT {run} AS run FROM tokens WHERE NOT regexp_matches(token, '{tx.PLAIN}')"


@query(_TITLES.replace("WITH ", "WITH RECURSIVE ", 1) + "," + _paths_sql(_runs_sql(_CUT), 2) + f"""
, parts AS (SELECT run, unnest(list_distinct(flatten(list_transform(best, lambda w: w.path)))) AS p FROM ways),
cut AS (SELECT doc_id, dl_of(value) AS dl, token, {_CUT} AS run FROM tokens),
found AS (SELECT doc_id, dl, token AS term FROM cut WHERE regexp_matches(token, '{tx.PLAIN}') UNION ALL SELECT doc_id, dl, p.term FROM cut JOIN parts USING (run) WHERE NOT regexp_matches(token, '{tx.PLAIN}'))
SELECT 'title' AS field, term, doc_id, count(*)::INT AS tf, dl::INT AS dl FROM found GROUP BY term, doc_id, dl""".replace("dl_of(value)", "length(value) + length(regexp_replace(value, '[^\\x{10000}-\\x{10FFFF}]', '', 'g'))"))
def nshortest_path_titles(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The inverted index of all titles, runs segmented by the word list with two paths."""
    words = load_words(table(spark, sf_dir, "word_list"))
    return build_index(_titles(spark, sf_dir), "unique_id", analyzer=Analyzer(words=words, paths=2)).postings


@query(_TITLES.replace("WITH ", "WITH RECURSIVE ", 1) + "," + _paths_sql(_runs_sql("token"), 3) + """
, numbered AS (SELECT run, unnest(best) AS w, generate_subscripts(best, 1) AS path FROM ways)
SELECT run AS text, path::INT AS path, w.cost::INT AS cost, list_aggregate(list_transform(w.path, lambda p: p.term), 'string_agg', '/') AS words FROM numbered""")
def segment_paths_titles(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Up to three paths of every run of every title, whole runs of any length."""
    token = _titles(spark, sf_dir).select(F.explode(tx.tokens(tx.normalize(F.col("title")))).alias("token"))
    words = load_words(table(spark, sf_dir, "word_list"))
    return segment_paths(token.where(~tx.is_plain(F.col("token"))), "token", 3, words).select("text", "path", "cost", F.array_join("words", "/").alias("words"))


@query(r"""WITH fields AS (SELECT raw_id, string_split(raw_line, chr(9))[2] AS title, regexp_replace(string_split(raw_line, chr(9))[3], '^[\x00-\x20]+|[\x00-\x20]+$', '', 'g') AS price FROM goods_raw)
SELECT raw_id + 200000 AS "uniqueID", title, CASE WHEN regexp_matches(price, '^[+-]?(NaN|Infinity|([0-9]+[.]?[0-9]*|[.][0-9]+)([eE][+-]?[0-9]+)?[fFdD]?)$')
  THEN try_cast(try_cast(regexp_replace(regexp_replace(price, '[fFdD]$', ''), '^[+]', '') AS DOUBLE) AS FLOAT)::DOUBLE END AS price FROM fields""")
def tsv_documents(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Every product line as a document of a second batch: full split, quotes plain characters, single-precision prices,
    shifted keys. Prices are numbers as Java reads them, of which the SQL knows all but hexadecimal ones; any other is null."""
    lines = table(spark, sf_dir, "goods_raw").select(F.col("raw_id").alias("line_no"), F.col("raw_line").alias("line"))
    return parse_goods(lines, float32=True, key_offset=200_000, whole_split=True).select("uniqueID", "title", "price")


@query("SELECT * FROM (VALUES (0, 58.477530722596576::DOUBLE, 78.47753072259657::DOUBLE), (1, 54.97465426902779, 74.97465426902779), (2, 25.38883697128012, 45.38883697128012), (3, 22.889200715856795, 42.8892007158568)) AS t(qid, lower, upper)")
def workload_ranges(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The first ranges of the benchmark's seeded workload."""
    return spark.createDataFrame(_RANGES[:4], "qid int, lower double, upper double")


@query("SELECT trim(word) AS word, count(*) AS n FROM word_list WHERE trim(word) <> '' GROUP BY trim(word)")
def word_list_source(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The dictionary as it is loaded, with how often each word is listed."""
    listed = table(spark, sf_dir, "word_list")
    words = spark.createDataFrame([(w,) for w in sorted(load_words(listed))], "word string")
    return words.join(listed.select(F.trim("word").alias("word")), "word").groupBy("word").agg(F.count("*").alias("n"))


def _goods_file(spark: SparkSession, sf_dir: str) -> str:
    """Part names and prices written as a product file of one part, in order of the key."""
    path = scratch(spark, "goods")
    part = table(spark, sf_dir, "part").repartitionByRange(1, "p_partkey").sortWithinPartitions("p_partkey")
    part.select(F.concat_ws("\t", F.col("p_partkey").cast("string"), "p_name", F.col("p_retailprice").cast("string")).alias("value")).write.text(path)
    return path


@query("""SELECT row_number() OVER (ORDER BY p_partkey) - 1 AS "uniqueID", p_name AS title, p_retailprice AS price, p_name AS descript, p_retailprice AS digt FROM part""")
def tsv_corpus_scan(spark: SparkSession, sf_dir: str) -> DataFrame:
    """A product file as documents with the line number as key."""
    return load_documents(spark, _goods_file(spark, sf_dir))


@query("SELECT p_name AS title FROM part ORDER BY p_partkey LIMIT 100")
def tsv_title_sampler(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The first 100 titles of a product file."""
    return load_titles(spark, _goods_file(spark, sf_dir), 100)


@query(r"SELECT doc_id, length(text) AS characters, octet_length(encode(text)) AS utf8, length(text) + length(regexp_replace(text, '[^\x{10000}-\x{10FFFF}]', '', 'g')) AS utf16 FROM documents")
def value_lengths(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Lengths of texts in characters, in bytes, and as the index counts them."""
    return _documents(spark, sf_dir).select("doc_id", F.length("text").alias("characters"), F.octet_length("text").alias("utf8"), tx.value_length(F.col("text")).alias("utf16"))


@query(_TEXT + rf""" SELECT doc_id, CASE WHEN regexp_matches(token, '^\p{{Nd}}') THEN 'digits' WHEN regexp_matches(token, '^[a-z]') THEN 'latin' ELSE 'run' END AS bucket, count(*) AS n
FROM tokens GROUP BY ALL""")
def token_buckets(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Tokens of every text by what they start with: digits, Latin letters, or a run to be segmented."""
    tokens = _documents(spark, sf_dir).select("doc_id", F.explode(tx.tokens(tx.normalize(F.col("text")))).alias("token"))
    return tokens.groupBy("doc_id", tx.bucket(F.col("token")).alias("bucket")).agg(F.count("*").alias("n"))


@query(rf"""WITH parts AS (SELECT p_partkey AS doc_id, regexp_extract_all({_normal_sql('p_name')}, '{tx.TOKEN}| ') AS all_parts FROM part),
numbered AS (SELECT doc_id, unnest(all_parts) AS term, generate_subscripts(all_parts, 1) AS ord FROM parts),
placed AS (SELECT doc_id, term, coalesce(sum(length(term)) OVER (PARTITION BY doc_id ORDER BY ord ROWS BETWEEN UNBOUNDED PRECEDING AND 1 PRECEDING), 0)::INT AS pos FROM numbered)
SELECT doc_id, term, pos, pos - lag(pos, 1, -1) OVER (PARTITION BY doc_id ORDER BY pos, term) AS increment FROM placed WHERE term <> ' '""")
def token_stream(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Terms of every part name in order of place, each with its step from the one before (the first from -1)."""
    parts = table(spark, sf_dir, "part").select(F.col("p_partkey").alias("doc_id"), F.posexplode(tx.tokens_with_gaps(tx.normalize(F.col("p_name")))).alias("at", "term"))
    before = Window.partitionBy("doc_id").orderBy("at").rowsBetween(Window.unboundedPreceding, -1)
    placed = parts.withColumn("pos", F.coalesce(F.sum(F.length("term")).over(before), F.lit(0)).cast("int")).where("term <> ' '")
    return placed.select("doc_id", "term", "pos", (F.col("pos") - F.lag("pos", 1, -1).over(Window.partitionBy("doc_id").orderBy("pos", "term"))).alias("increment"))


@query("SELECT p_partkey AS doc_id, p_size::FLOAT AS score FROM part ORDER BY p_size DESC, p_partkey LIMIT 77")
def top_k_ties(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The best 77 of hits with many equal scores, ties by smaller id."""
    return top_n(table(spark, sf_dir, "part").select(F.col("p_partkey").alias("doc_id"), F.col("p_size").cast("float").alias("score")), 77)


@query("SELECT 1 AS step, 5::BIGINT AS id, true AS deleted UNION ALL SELECT 2, 5, false UNION ALL SELECT 3, -99, false UNION ALL SELECT 4, 5, false")
def delete_results(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Deleting a document, deleting it again, an unknown one, and whether it can still be fetched."""
    part = table(spark, sf_dir, "part").select("p_partkey", F.col("p_name").alias("title"))
    store = IndexStore(spark, scratch(spark, "index"))
    store.append(part, "p_partkey")
    steps = [(1, 5, store.delete([5])[0]), (2, 5, store.delete([5])[0]), (3, -99, store.delete([-99])[0])]
    there = Searcher(store.open()).docs(spark.createDataFrame([(5, 1.0)], "doc_id bigint, score float")).count() > 0
    return spark.createDataFrame([*steps, (4, 5, there)], "step int, id bigint, deleted boolean")


@query("SELECT 2 AS segments, max(p_partkey) AS pre_max_id, 1 AS format_version FROM part")
def segment_info(spark: SparkSession, sf_dir: str) -> DataFrame:
    """What a store of two segments says of itself."""
    part = table(spark, sf_dir, "part").select("p_partkey", F.col("p_name").alias("title"))
    store = IndexStore(spark, scratch(spark, "index"))
    for k in range(2):
        store.append(part.where(f"p_partkey % 2 = {k}"), "p_partkey")
    return store.segment_info().drop("created_ms")


@query("SELECT o_orderkey, lpad(printf('%X', o_orderkey), 16, '0') AS big_endian FROM orders")
def big_endian_bytes(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Order keys as eight bytes, in hexadecimal."""
    return table(spark, sf_dir, "orders").select("o_orderkey", F.hex(numeric.big_endian(F.col("o_orderkey"))).alias("big_endian"))


@query("SELECT s.format_version, count(DISTINCT p.seg_no) AS segments, count(*) AS postings FROM postings p JOIN segment_info s USING (seg_no) GROUP BY s.format_version")
def segment_formats(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Postings by the format version of their segment; versions below 1 are those that a reader refuses."""
    info = table(spark, sf_dir, "segment_info").select("seg_no", "format_version")
    # Combined by segment before the join, so the join sees a row for each segment.
    by_segment = table(spark, sf_dir, "postings").groupBy("seg_no").agg(F.count("*").alias("postings"))
    return by_segment.join(info, "seg_no").groupBy("format_version").agg(F.count("*").alias("segments"), F.sum("postings").alias("postings"))


_GONE = "SELECT DISTINCT unique_id FROM deleted_ids"


@query(f"SELECT unique_id AS doc_id, min(title) AS title, min(price) AS price FROM goods_doc WHERE unique_id NOT IN ({_GONE}) AND price BETWEEN -5 AND 20 GROUP BY unique_id")
def live_goods_in_range(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Products of a price range that are not deleted, each once."""
    goods = table(spark, sf_dir, "goods_doc").groupBy("unique_id").agg(F.min("title").alias("title"), F.min("price").alias("price"))
    index = build_index(goods, "unique_id").with_deletes(table(spark, sf_dir, "deleted_ids").select(F.col("unique_id").alias("doc_id")))
    search = Searcher(index)
    return search.docs(search.search(NumericRangeQuery("price", -5, 20))).drop("score")
