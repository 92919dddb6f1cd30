"""How distinctive a term is of a record: log-entropy weighting by two aggregations."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from lexispark.operators.postings import distinct_postings
from lexispark.operators.skew import skew_safe_join
from lexispark.session import materialize


def field_postings(postings: DataFrame, field: str) -> DataFrame:
    """(term, doc_id, frequency) of the distinct postings of one field with a positive frequency, written once for all that reads them."""
    once = distinct_postings(postings.where(F.col("field") == field)).where(F.col("frequency") > 0)
    return materialize(once.select("term", "doc_id", "frequency"), "postings")


def term_weights(once: DataFrame, spread: str = "frequency") -> tuple[DataFrame, int, int]:
    """((term, n, global_weight), number of documents, number of postings) of ``field_postings``.

    The global weight is one minus the entropy of the term's spread over its documents, divided by the
    logarithm of the number N of documents: 1 for a term of one document, 0 for one spread evenly over all.
    ``spread`` 'frequency' spreads by occurrences; 'documents' counts each document of the term alike, whose
    entropy is ln n, so that the weight is ln(N / n) / ln(N). With N of 1 the weight is 1. Only the first
    aggregation (per term) and the count of documents (the second) read the postings.
    """
    documents, rows = once.groupBy("doc_id").agg(F.count("*").alias("k")).agg(F.count("*"), F.coalesce(F.sum("k"), F.lit(0))).first()
    tf = F.col("frequency").cast("double")
    if spread == "frequency":
        stats = once.groupBy("term").agg(F.count("*").alias("n"), F.sum(tf).alias("gf"), F.sum(tf * F.ln(tf)).alias("tlt"))
        entropy = F.greatest(F.lit(0.0), F.ln("gf") - F.col("tlt") / F.col("gf"))
    else:
        stats = once.groupBy("term").agg(F.count("*").alias("n"))
        entropy = F.ln(F.col("n").cast("double"))
    norm = F.ln(F.lit(float(documents)))
    weight = F.lit(1.0) - entropy / norm if documents > 1 else F.lit(1.0)
    return stats.select("term", "n", weight.alias("global_weight")), documents, rows


def log_entropy(postings: DataFrame, field: str = "title", local: str = "log", spread: str = "frequency", least: float | None = None, least_documents: int = 1) -> DataFrame:
    """(doc_id, term, n, score): local times global weight of every posting of ``field``.

    ``local`` 'log' is ln(1 + frequency), 'raw' the frequency. ``least`` and ``least_documents`` keep only
    scores and terms of at least that much; as no global weight exceeds 1, postings whose local weight is below
    ``least`` are dropped before the join.

    A posting counts once however often flushed; rows with a null field, term or doc_id, or without a positive
    frequency, have no score. An empty table gives an empty result. Ties and repeated rows: one row for each posting.
    """
    once = field_postings(postings, field)
    stats, _, rows = term_weights(once, spread)
    tf = F.col("frequency").cast("double")
    weighted = once.select("doc_id", "term", (F.log1p(tf) if local == "log" else tf).alias("local"))
    if least is not None:
        weighted = weighted.where(F.col("local") >= least * (1 - 1e-12))
    joined = skew_safe_join(weighted, stats.where(F.col("n") >= least_documents), ["term"], "n", rows)
    scored = joined.select("doc_id", "term", "n", (F.col("local") * F.col("global_weight")).alias("score"))
    return scored if least is None else scored.where(F.col("score") >= least)


def marking_terms(postings: DataFrame, field: str = "title", least: float = 2.2, least_documents: int = 2) -> DataFrame:
    """(doc_id, term): postings of terms of at least ``least_documents`` documents with frequency times
    ln(N / n) / ln(N) of at least ``least``, found by their log-entropy weight.

    The entropy of a term's occurrences over n documents is at most ln n, so its global weight is at least
    ln(N / n) / ln(N), and a case has a log-entropy weight of at least ``least`` times ln(1 + frequency) / frequency.
    Postings below that are rejected by the weight alone; of the rest the formula decides. Nulls, repeated rows and empty
    tables as in ``log_entropy``; with N of 1 there is no case.
    """
    once = field_postings(postings, field)
    stats, documents, rows = term_weights(once)
    if documents < 2:
        return once.select("doc_id", "term").limit(0)
    tf = F.col("frequency").cast("double")
    nearly = least * (1 - 1e-9)  # the bound is met to the last digits where all documents have a term as often
    weighted = once.where(tf >= nearly).select("doc_id", "term", "frequency")  # no global weight exceeds 1
    joined = skew_safe_join(weighted, stats.where(F.col("n") >= least_documents), ["term"], "n", rows)
    scored = joined.withColumn("score", F.log1p(tf) * F.col("global_weight"))
    proposed = scored.where(F.col("score") >= F.log1p(tf) / tf * nearly)
    return proposed.where(tf * (F.lit(1.0) - F.ln(F.col("n").cast("double")) / F.ln(F.lit(float(documents)))) >= least).select("doc_id", "term")
