"""Search: the best hits of one query or of many in one job, and the documents behind them."""

from __future__ import annotations

import pyarrow as pa
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from lexispark.fields import KEY
from lexispark.functions import text as tx
from lexispark.functions.scoring import average_length, bm25
from lexispark.functions.segment import segment_runs
from lexispark.operators.index import Index
from lexispark.plans.compile import compile_query, no_hits, range_points
from lexispark.plans.query import NumericRangeQuery, Query

#: Hits up to this number are broadcast to fetch their documents.
FEW_HITS = 10_000
#: Rows of a batch of queries that are broadcast, with their terms as filters of the scan; larger batches are joined by keys.
MOST_ASKED = 10_000
#: Bins of one level that a range may touch, and the levels above the first.
WIDE, LEVELS = 64, 8


def top_n(hits: DataFrame, n: int) -> DataFrame:
    """The n best hits, ties by smaller id; none for n of 0, an error below."""
    if n < 0:
        raise ValueError("n must not be negative")
    return hits.orderBy(F.col("score").desc(), F.col("doc_id")).limit(n)


class Searcher:
    """Queries against one index."""

    def __init__(self, index: Index):
        self.index = index

    def search(self, query: Query, n: int | None = None) -> DataFrame:
        """(doc_id, score): the n best hits, all without n.

        All hits of a range score 0; its n best are the n smallest values, and n of 0 or less gives none.
        """
        if isinstance(query, NumericRangeQuery) and n is not None:
            if n <= 0:
                return no_hits(self.index)
            # Where the quantiles of the points show that enough of them lie below some number, the rest isn't read.
            most = self.index.least_bound(query.field, float(query.lower), n)
            least = range_points(query, self.index, most).orderBy("value", "doc_id").limit(n)
            return least.select("doc_id", F.lit(0.0).cast("float").alias("score"))
        hits = compile_query(query, self.index)
        return hits if n is None else top_n(hits, n)

    def visit(self, query: NumericRangeQuery, wanted: Column | None = None) -> DataFrame:
        """(doc_id, value) of every live point of a range for which a condition on these two columns holds; it reaches the scan."""
        points = range_points(query, self.index)
        return points if wanted is None else points.where(wanted)

    def docs(self, hits: DataFrame, columns: list[str] | None = None) -> DataFrame:
        """Stored columns (those named, or all) and score of every hit; nothing for a deleted or unknown document."""
        return self._docs(hits, columns)

    def _docs(self, some: DataFrame, columns: list[str] | None) -> DataFrame:
        kept = [s.name for s in self.index.specs if s.stored and s.type != KEY and (columns is None or s.name in columns)]
        found = self.index.stored.select("doc_id", *kept).join(some.select("doc_id", "score"), "doc_id")
        return self.index.live(found)

    def fetch(self, query: Query, n: int, columns: list[str] | None = None) -> DataFrame:
        """``docs`` of the n best hits. Up to FEW_HITS are broadcast, as the limit bounds them; more take Catalyst's choice of join."""
        hits = self.search(query, n).limit(n)
        return self._docs(F.broadcast(hits) if n <= FEW_HITS else hits, columns)

    def json(self, docs: DataFrame) -> DataFrame:
        """(doc_id, json) of fetched documents, the columns in their order, nulls left out."""
        return docs.select("doc_id", F.to_json(F.struct(*[c for c in docs.columns if c != "doc_id"])).alias("json"))

    def search_many_terms(self, queries: DataFrame, n: int) -> DataFrame:
        """(qid, doc_id, score, rank): the n best for each row (qid, field, term) of ``queries``, in one job."""
        asked, few = self._bounded(queries.select("qid", "field", "term"))
        return self._best(self._scored(asked, few).select("qid", "doc_id", "score"), n)

    def search_many_strings(self, queries: DataFrame, n: int) -> DataFrame:
        """The same for rows (qid, field, text), analysed as columns: all terms, for queries without such a document any."""
        normalized = self.index.analyzer.normalize(F.col("text"))
        token = queries.select("qid", "field", F.posexplode(tx.tokens(normalized)).alias("at", "token"))
        longest = self.index.analyzer.longest_run
        if self.index.analyzer.words:
            token = segment_runs(token, "token", self.index.analyzer.paths, self.index.analyzer.words, longest)
            own = F.when(tx.is_plain(F.col("token")), F.array("token")).otherwise(F.col("segments.term"))
        else:
            own = F.when(tx.is_plain(F.col("token")), F.array("token")).otherwise(tx.single_characters(F.col("token"), longest))
        token = token.select("qid", "field", "at", F.posexplode(own).alias("sub", "term"))
        asked = token.groupBy("qid", "field", "term").agg(F.count("*").alias("times"), F.min(F.struct("at", "sub")).alias("first"))
        asked = asked.withColumn("terms", F.count("*").over(Window.partitionBy("qid")))
        asked, few = self._bounded(asked)
        by_doc = self._scored(asked, few).groupBy("qid", "doc_id").agg(
            F.count("*").alias("have"), F.first("terms").alias("terms"), F.sum(F.col("score") * F.col("times")).cast("float").alias("every"), F.min_by("score", "first").alias("any")
        )
        most = by_doc.groupBy("qid").agg(F.max("have").alias("most"))  # a row for each query
        complete = F.col("most") == F.col("terms")
        chosen = by_doc.join(F.broadcast(most) if few is not None else most, "qid").where(~complete | (F.col("have") == F.col("terms")))
        return self._best(chosen.select("qid", "doc_id", F.when(complete, F.col("every")).otherwise(F.col("any")).alias("score")), n)

    def search_many_ranges(self, ranges: DataFrame, field: str, width: float, n: int | None = None) -> DataFrame:
        """(qid, doc_id, value, rank): the n smallest values (all without n) for each row (qid, lower, upper).

        Ranges and points meet in bins, so each point is compared only with ranges that touch its bin. A range is put on the
        level on which it touches at most WIDE + 1 bins; bins are ``width`` wide on the first level and WIDE times wider
        on each further one, and those that are infinite, or beyond all levels, share one bin. A point has a row for each level in use.
        """
        size = lambda level: F.lit(float(width)) * F.pow(F.lit(float(WIDE)), level)
        asked = ranges.where("lower <= upper").select("qid", F.col("lower").cast("double").alias("lower"), F.col("upper").cast("double").alias("upper"))
        spans = (F.col("upper") - F.col("lower")) / F.lit(float(width))
        level = F.when(spans <= WIDE, 0).otherwise(F.least(F.ceil(F.log(float(WIDE), spans)) - 1, F.lit(LEVELS + 1))).cast("int")
        near = F.greatest(F.abs("lower"), F.abs("upper")) / size(level) < float(1 << 52)  # beyond that bins have no exact number
        asked = asked.withColumn("level", F.when((level <= LEVELS) & near, level).otherwise(-1))
        bin_of = lambda c: F.when(F.col("level") < 0, F.lit(0)).otherwise(F.floor(c / size(F.col("level"))).cast("bigint"))
        asked = asked.withColumn("bin", F.explode(F.sequence(bin_of(F.col("lower")), bin_of(F.col("upper")))))
        asked, rows = self._bounded(asked)
        used = {r.level for r in asked.select("level").distinct().collect()} if rows is None else set(rows.column("level").to_pylist())  # LEVELS + 2 at most
        points = self.index.points(field).select("doc_id", F.col("value").cast("double").alias("value"))
        placed = points.withColumn("level", F.explode(F.array(*[F.lit(k) for k in sorted(used) or [0]]))).withColumn("bin", bin_of(F.col("value")))
        hits = self.index.live(placed.join(asked, ["level", "bin"]).where(F.col("value").between(F.col("lower"), F.col("upper")))).select("qid", "doc_id", "value")
        ranked = hits.withColumn("rank", F.row_number().over(Window.partitionBy("qid").orderBy("value", "doc_id")))
        return ranked if n is None else ranked.where(F.col("rank") <= n)

    def _bounded(self, asked: DataFrame) -> tuple[DataFrame, pa.Table | None]:
        """A batch of queries; if it has at most MOST_ASKED rows, as a local table, and those rows."""
        rows = asked.limit(MOST_ASKED + 1).toArrow()
        return (asked, None) if rows.num_rows > MOST_ASKED else (asked.sparkSession.createDataFrame(rows, asked.schema), rows)

    def _scored(self, asked: DataFrame, rows: pa.Table | None) -> DataFrame:
        """The columns of ``asked`` (field, term, ...) with (doc_id, score) of live postings.

        The terms of a small batch are filters of the scans of postings and frequencies and are broadcast: postings
        are not shuffled. A larger batch is joined by keys, hot terms cut by the adaptive skew join.
        """
        index = self.index
        postings, counts = index.postings, index.frequencies()
        few = rows is not None
        if few:
            fields, terms = (rows.column(c).drop_null().unique().to_pylist() for c in ("field", "term"))
            wanted = F.col("field").isin(fields) & F.col("term").isin(terms)
            postings, counts = postings.where(wanted), counts.where(wanted)
        pairs = asked.select("field", "term").distinct()
        counts = counts.join(F.broadcast(pairs) if few else pairs, ["field", "term"], "left_semi").groupBy("field", "term").agg(F.sum("df").alias("df"))
        asked = asked.join(counts, ["field", "term"])
        if index.known is None:
            stats = index.stats.select("field", average_length(F.col("len_sum"), F.col("doc_count")).alias("avgdl"))
            asked = asked.join(F.broadcast(stats), "field")  # a row for each field
        else:
            average = [x for f in index.known.fields for x in (F.lit(f), index.average(f))]
            asked = asked.withColumn("avgdl", F.try_element_at(F.create_map(*average), F.col("field")))
        met = index.live(postings.join(F.broadcast(asked) if few else asked, ["field", "term"]))
        score = bm25(index.live_count(), F.col("df"), F.col("tf"), F.col("dl"), F.col("avgdl"))
        return met.withColumn("score", score).drop("df", "tf", "dl", "avgdl")

    def _best(self, hits: DataFrame, n: int) -> DataFrame:
        # The rank filter is applied within each task before the shuffle, so a query with most documents stays small.
        order = Window.partitionBy("qid").orderBy(F.col("score").desc(), F.col("doc_id"))
        return hits.withColumn("rank", F.row_number().over(order)).where(F.col("rank") <= n)
