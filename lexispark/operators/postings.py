"""The inverted index in long form, as other operators want it: each posting once."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F


def distinct_postings(postings: DataFrame, frequency: bool = True) -> DataFrame:
    """(field, term, doc_id[, frequency]), each posting once however often it was flushed.

    * Rows with a null ``term``, ``field`` or ``doc_id`` are no postings and are left out.
    * Flushes of one posting carry one frequency; if they ever differ, the largest holds. A null
      frequency counts as 0.
    * Other columns of the input, whatever their names, are not looked at.

    The key of the only shuffle is the whole posting, so a hot term or document is spread over all
    tasks, and repeated flushes within a task are combined before the shuffle.
    """
    keys = ["field", "term", "doc_id"]
    clean = postings.where(F.col("term").isNotNull() & F.col("field").isNotNull() & F.col("doc_id").isNotNull())
    if not frequency:
        return clean.select(*keys).distinct()
    return (
        clean.select(*keys, F.coalesce(F.col("frequency").cast("bigint"), F.lit(0)).alias("frequency"))
        .groupBy(*keys)
        .agg(F.max("frequency").alias("frequency"))
    )
