"""Keys that hold most of the rows: counting them, and joining on them, without a few overlong tasks."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from lexispark.operators.postings import distinct_postings

#: A key is hot if it alone holds more than one in so many rows; there can be no more hot keys than this.
HOT_ONE_IN = 1000


def key_counts(postings: DataFrame) -> DataFrame:
    """(key_kind, key_name, postings, occurrences) of every term and every document, and the total.

    ``key_kind`` is 'term' (``key_name`` is field, colon, term), 'doc' (the id as decimal text) or
    'all' (null ``key_name``; one row, absent for an empty table).

    Map-side combining: Spark's hash aggregate keeps a bounded hash table of mergeable states per task,
    spills it when memory ends, and shuffles partial counts only, so a key holding a third of all rows
    arrives as one row per task. One scan and one pass of the distinct postings serve all three counts.
    """
    once = distinct_postings(postings)
    keys = ["field", "term", "doc_id"]
    counted = once.groupingSets([["field", "term"], ["doc_id"], []], *keys).agg(
        F.grouping_id(*keys).alias("kind"), F.count("*").alias("postings"), F.sum("frequency").alias("occurrences")
    )
    kind = F.when(F.col("kind") == 1, "term").when(F.col("kind") == 6, "doc").otherwise("all")
    name = F.when(F.col("kind") == 1, F.concat_ws(":", "field", "term")).when(F.col("kind") == 6, F.col("doc_id").cast("string"))
    return counted.select(kind.alias("key_kind"), name.alias("key_name"), "postings", "occurrences").where(
        (F.col("key_kind") != "all") | (F.col("postings") > 0)
    )


def heavy_keys(postings: DataFrame, percent: float = 1.0) -> DataFrame:
    """(key_kind, key_name, postings) of terms and documents that alone hold more than ``percent`` % of all postings.

    An empty table has none. The bar is compared as ``100 * n > percent * total``, without rounding for whole percents.
    """
    counts = key_counts(postings)
    total = counts.where("key_kind = 'all'").agg(F.max("postings")).scalar()
    return counts.where((F.col("key_kind") != "all") & (F.col("postings") * 100 > total * percent)).select("key_kind", "key_name", "postings")


def skew_safe_join(facts: DataFrame, stats: DataFrame, keys: list[str], rows: str, total: int) -> DataFrame:
    """Inner join of many ``facts`` rows with one ``stats`` row per key, safe for keys with most of the facts.

    ``stats[rows]`` is the key's number of facts and ``total`` their sum. Keys above ``total / HOT_ONE_IN``
    number at most ``HOT_ONE_IN``; that bound allows their broadcast, and their facts are never shuffled.
    All other keys take a shuffle join in which none exceeds that share. Null keys match nothing.
    Columns of both sides other than the keys must differ in name.
    """
    hot = stats.where(F.col(rows) * HOT_ONE_IN > total)
    warm = stats.where(F.col(rows) * HOT_ONE_IN <= total)
    marks = F.broadcast(hot.select(*keys, F.lit(True).alias("_hot")))
    marked = facts.join(marks, keys, "left")
    return (
        marked.where(F.col("_hot")).drop("_hot").join(F.broadcast(hot), keys)
        .unionByName(marked.where(F.col("_hot").isNull()).drop("_hot").join(warm.hint("shuffle_merge"), keys))
    )
