"""Queries of this subpackage, by name, and the SQL that gives the same rows where SQL can."""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from lexispark.llm import bpe, distinct_weight, neardup, packing, reading, termcount, textform
from lexispark.session import materialize, table

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


@query()
def p2_found(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Pairs of documents whose titles look the same but are stored with different characters."""
    return textform.document_pairs(table(spark, sf_dir, "goods_doc"))


@query()
def p2_links(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Every document with a title, its class, and how many documents look the same but are stored differently."""
    return textform.form_links(table(spark, sf_dir, "goods_doc"))


@query()
def p2_forms(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The consistent form of every title, with the class of documents that share it."""
    return textform.form_classes(table(spark, sf_dir, "goods_doc"))


@query()
def p3_found(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Pairs of documents whose titles differ by small edits: at least 65 % of their pieces in common."""
    return neardup.document_pairs(table(spark, sf_dir, "goods_doc"))


@query()
def p3_links(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Every document with a title, the class of its form, and how many documents of other forms are near it."""
    return neardup.document_links(table(spark, sf_dir, "goods_doc"))


_ONCE = """
WITH once AS (SELECT field, term, doc_id, coalesce(max(frequency), 0)::BIGINT AS frequency FROM postings
              WHERE term IS NOT NULL AND field IS NOT NULL AND doc_id IS NOT NULL GROUP BY ALL),
"""
_TERMS = _ONCE + """
docs AS (SELECT field, count(DISTINCT doc_id) AS n FROM once GROUP BY field),
counts AS (SELECT field, term, sum(frequency)::BIGINT AS occurrences, count(*) AS documents FROM once GROUP BY field, term),
marked AS (SELECT c.*, CASE WHEN documents * 100 > n * 20 THEN 'common' WHEN documents <= 1 THEN 'rare' END AS mark FROM counts c JOIN docs USING (field))
"""


@query(_TERMS + "SELECT field, term, mark FROM marked WHERE mark IS NOT NULL")
def p1_found(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Terms too common or too rare to help a search."""
    return termcount.marked_terms(table(spark, sf_dir, "postings")).where("mark IS NOT NULL").select("field", "term", "mark")


@query(_TERMS + "SELECT * FROM marked")
def p1_counts(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Occurrences and documents of every distinct term."""
    return termcount.marked_terms(table(spark, sf_dir, "postings"))


_TITLE = _ONCE + "title AS (SELECT * FROM once WHERE field = 'title' AND frequency > 0), docs AS (SELECT count(DISTINCT doc_id) AS docs FROM title), "


@query(
    _TITLE
    + """stats AS (SELECT term, count(*) AS n FROM title GROUP BY term)
SELECT doc_id, term FROM title JOIN stats USING (term), docs
WHERE n >= 2 AND frequency * (1.0::DOUBLE - ln(n::DOUBLE) / ln(docs::DOUBLE)) >= 2.2"""
)
def p5_found(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Title terms that mark their document: proposed by their log-entropy weight, decided by the formula."""
    return distinct_weight.marking_terms(table(spark, sf_dir, "postings"))


@query(
    _TITLE
    + """stats AS (SELECT term, sum(frequency)::DOUBLE AS gf, sum(frequency * ln(frequency::DOUBLE)) AS tlt FROM title GROUP BY term)
SELECT doc_id, term, round(ln(1 + frequency::DOUBLE) * (1 - greatest(0, ln(gf) - tlt / gf) / ln(docs::DOUBLE)), 6) AS score FROM title JOIN stats USING (term), docs"""
)
def p5_log_entropy(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Log-entropy weight of every title posting."""
    return distinct_weight.log_entropy(table(spark, sf_dir, "postings")).select("doc_id", "term", F.round("score", 6).alias("score"))


@query()
def p7_ids(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Token ids of every text."""
    return bpe.encode_texts(table(spark, sf_dir, "documents"), "doc_id", "text")


@query("SELECT doc_id, coalesce(text, '') AS text FROM documents")
def p7_decoded(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Every text, encoded and decoded again."""
    return bpe.decode_ids(bpe.encode_texts(table(spark, sf_dir, "documents"), "doc_id", "text"), "doc_id")


def _capacities(spark: SparkSession, sf_dir: str) -> list[tuple[int, int]]:
    return [(r.capacity_id, r.capacity_tokens) for r in table(spark, sf_dir, "pack_capacity").select("capacity_id", "capacity_tokens").collect()]


def _sizes(spark: SparkSession, sf_dir: str) -> DataFrame:
    return materialize(bpe.encode_texts(table(spark, sf_dir, "documents"), "doc_id", "text", counts_only=True), "sizes")


@query()
def p8_packed(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Every text assigned to containers, for each capacity."""
    return packing.pack(_sizes(spark, sf_dir), "doc_id", _capacities(spark, sf_dir))


@query("SELECT NULL::VARCHAR AS rule, NULL::INT AS capacity_id, NULL::BIGINT AS n WHERE false")
def p8_violations(spark: SparkSession, sf_dir: str) -> DataFrame:
    """What the packing breaks of its rules (capacities, lost or doubled tokens, needless splits): nothing."""
    sizes, capacities = _sizes(spark, sf_dir), _capacities(spark, sf_dir)
    return packing.violations(packing.pack(sizes, "doc_id", capacities), sizes, "doc_id", capacities)


@query()
def p8_fill(spark: SparkSession, sf_dir: str) -> DataFrame:
    """How full the containers of each capacity are, and the fewest that could hold the tokens."""
    return packing.fill(p8_packed(spark, sf_dir), _capacities(spark, sf_dir))


_LIX = rf"""
WITH parts AS (SELECT doc_id, text, regexp_extract_all(text, '\p{{L}}+') AS w,
    len(list_filter(regexp_split_to_array(text, '{reading.SENTENCE_END}'), lambda x: regexp_matches(x, '\p{{L}}'))) AS n_sentences FROM documents WHERE text IS NOT NULL),
lix AS (SELECT doc_id, n_sentences, len(w) AS n_words, len(w)::DOUBLE / n_sentences + len(regexp_extract_all(text, '\p{{L}}{{{reading.LONG + 1},}}')) * 100.0::DOUBLE / len(w) AS lix,
    NOT regexp_matches(text, '{reading.HAN}') AND len(w) >= {reading.LEAST_WORDS} AS graded FROM parts)
"""


@query(_LIX + "SELECT doc_id FROM lix WHERE graded AND lix >= 55")
def p9_found(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Demanding texts."""
    return reading.demanding(reading.reading_levels(table(spark, sf_dir, "documents")))


@query(
    _LIX
    + rf""", texts AS (SELECT d.doc_id, list_distinct(list_transform(regexp_extract_all(d.text, '\p{{L}}+'), lambda w: lower(w))) AS words, graded, lix,
    strpos('13579bdf', md5(d.doc_id::VARCHAR)[1]) > 0 AS odd FROM documents d JOIN lix USING (doc_id)),
pairs AS (SELECT unnest(words) AS word, odd, CASE WHEN graded THEN floor(lix / {reading.BAND})::INT END AS grade FROM texts),
rows_of AS (SELECT word, count(*) AS rows FROM pairs GROUP BY word),
ranked AS (SELECT word, odd, grade, row_number() OVER (PARTITION BY word, odd ORDER BY grade) AS k, count(*) OVER (PARTITION BY word, odd) AS n FROM pairs WHERE grade IS NOT NULL),
graded_words AS (SELECT word, odd, min(grade) AS grade FROM ranked WHERE n >= {reading.LEAST_TEXTS} AND k >= n * {reading.ACQUIRED}::DOUBLE GROUP BY word, odd)
SELECT word, max(grade) FILTER (odd) AS grade0, max(grade) FILTER (NOT odd) AS grade1, any_value(rows) AS rows FROM graded_words JOIN rows_of USING (word) GROUP BY word"""
)
def p9_grades(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The acquisition grade of every word, by each half of the texts."""
    texts = reading.surface(table(spark, sf_dir, "documents")).withColumn("half", reading.half(F.col("doc_id")))
    return reading.word_grades(texts.select(F.explode("words").alias("word"), "lix", "graded", "half"))


@query()
def p9_levels(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Predicted reading level of every text."""
    return reading.reading_levels(table(spark, sf_dir, "documents")).select("doc_id", F.round("level", 4).alias("level"), "graded", "half")
