"""From a query to a DataFrame of hits (doc_id, score)."""

from __future__ import annotations

import math
from collections import Counter
from decimal import Decimal
from functools import singledispatch

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from lexispark.fields import DOUBLE, STRING
from lexispark.functions.scoring import bm25
from lexispark.operators.index import Index
from lexispark.plans.query import MUST, BooleanQuery, NumericRangeQuery, Query, StringQuery, TermQuery

HITS = "doc_id bigint, score float"


def no_hits(index: Index) -> DataFrame:
    return index.stored.sparkSession.createDataFrame([], HITS)


def scored_postings(index: Index, field: str, terms: list[str]) -> DataFrame:
    """(term, doc_id, score) of live postings of ``terms`` in one field.

    df counts every posting, deleted documents included; n only live documents. What is one number for the whole query
    is kept with a stored index (n, the average length) or looked up by a scalar subquery (df of a single term), never joined.
    """
    wanted = (F.col("field") == field) & F.col("term").isin(terms)
    live = index.live(index.postings.where(wanted).select("term", "doc_id", "tf", "dl"))
    counts = index.frequencies().where(wanted)
    if len(terms) == 1:
        df = counts.agg(F.sum("df")).scalar()
    else:  # a row for each term of the query
        live = live.join(F.broadcast(counts.groupBy("term").agg(F.sum("df").alias("df"))), "term")
        df = F.col("df")
    return live.select("term", "doc_id", bm25(index.live_count(), df, F.col("tf"), F.col("dl"), index.average(field)).alias("score"))


@singledispatch
def compile_query(query: Query, index: Index) -> DataFrame:
    """Hits of ``query``; an unknown kind of query has none."""
    return no_hits(index)


@compile_query.register
def _(query: TermQuery, index: Index) -> DataFrame:
    spec = index.spec(query.field)
    if spec is None or spec.type != STRING:
        return no_hits(index)
    return scored_postings(index, query.field, [query.term]).select("doc_id", "score")


@compile_query.register
def _(query: NumericRangeQuery, index: Index) -> DataFrame:
    return range_points(query, index).select("doc_id", F.lit(0.0).cast("float").alias("score"))


def range_points(query: NumericRangeQuery, index: Index, most: float | None = None) -> DataFrame:
    """(doc_id, value) of live points between the bounds, and at most ``most``; the comparison reaches the scan.

    Bounds are compared in the type of the points, so whole numbers of any size are told apart.
    """
    spec = index.spec(query.field)
    if spec is None or spec.type != DOUBLE:
        return index.stored.sparkSession.createDataFrame([], "doc_id bigint, value double")
    points = index.points(query.field)
    kind = dict(points.dtypes)["value"]
    lower, upper = (F.lit(x).cast(kind) for x in whole_bounds(query.lower, query.upper)) if kind == "bigint" else (number(x, kind) for x in (query.lower, query.upper))
    inside = F.col("value").between(lower, upper)
    return index.live(points.where(inside if most is None else inside & (F.col("value") <= number(most, kind))))


def number(x: float | int | Decimal, kind: str) -> Column:
    """A bound for points of a type. Fractions beyond what a decimal column holds are kept, as the column is widened."""
    if kind == "double":
        return F.lit(float(x))
    if isinstance(x, float) and not math.isfinite(x):
        return F.lit(x)  # compared as doubles; every decimal is on the same side
    return F.lit(Decimal(repr(x) if isinstance(x, float) else x))


def whole_bounds(lower: float, upper: float) -> tuple[int, int]:
    """The least and the greatest bigint between two bounds; the first exceeds the second if there is none."""
    least, most = -(1 << 63), (1 << 63) - 1
    if lower != lower or upper != upper:
        return 1, 0
    low = least if lower <= least else most + 1 if lower > most else math.ceil(lower)
    high = most if upper >= most else least - 1 if upper < least else math.floor(upper)
    return (low, high) if low <= most and high >= least else (1, 0)


@compile_query.register
def _(query: StringQuery, index: Index) -> DataFrame:
    """All terms, scores summed with repeated terms as often as they occur; if no document has all, any term,
    scored by the first in the query. One scan of the postings and one aggregation give both."""
    spec = index.spec(query.field)
    terms = index.analyzer.terms_python(query.text)
    if spec is None or spec.type != STRING or not terms:
        return no_hits(index)
    times = Counter(t for t, _ in terms)
    first = {t: i for i, t in reversed(list(enumerate(t for t, _ in terms)))}
    scored = scored_postings(index, query.field, list(times))
    number = lambda table: F.create_map(*[F.lit(x) for t in table.items() for x in t])[F.col("term")]
    by_doc = scored.groupBy("doc_id").agg(
        F.count("*").alias("have"), F.sum(F.col("score") * number(times)).cast("float").alias("every"), F.min_by("score", number(first)).alias("any")
    )
    most = by_doc.agg(F.max("have")).scalar()
    complete = most == len(times)
    return by_doc.where(~complete | (F.col("have") == len(times))).select("doc_id", F.when(complete, F.col("every")).otherwise(F.col("any")).alias("score"))


@compile_query.register
def _(query: BooleanQuery, index: Index) -> DataFrame:
    """MUST: documents of all clauses, scores summed. SHOULD: of any clause, with the score of the first that has it."""
    if not query.queries:
        return no_hits(index)
    parts = [compile_query(q, index).withColumn("clause", F.lit(i)) for i, q in enumerate(query.queries)]
    hits = parts[0]
    for p in parts[1:]:
        hits = hits.unionByName(p)
    by_doc = hits.groupBy("doc_id")
    if query.occur == MUST:
        found = by_doc.agg(F.sum("score").cast("float").alias("score"), F.count("*").alias("n")).where(F.col("n") == len(parts)).drop("n")
    else:
        found = by_doc.agg(F.min_by("score", "clause").alias("score"))
    for q in query.must_not:
        found = found.join(compile_query(q, index).select("doc_id"), "doc_id", "left_anti")
    return found
