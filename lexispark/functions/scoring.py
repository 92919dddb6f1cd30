"""BM25 in single precision, each step rounded as a chain of float operations is."""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F


def _f(x: Column | float) -> Column:
    return (x if isinstance(x, Column) else F.lit(x)).cast("float")


def _divide(a: Column, b: Column) -> Column:
    """Float quotient; Spark's own division of floats is in doubles."""
    return (_f(a) / _f(b)).cast("float")


def bm25_idf(n: Column, df: Column) -> Column:
    half = _f(0.5)
    return F.ln(_f(1.0) + _divide((n - df).cast("float") + half, df.cast("float") + half)).cast("float")


def bm25(n: Column, df: Column, tf: Column, length: Column, average: Column) -> Column:
    """Score of a term in a document: k1 = 1.2, b = 0.75; 0 where the average length is 0.

    n live documents, df postings of the term, tf its frequency, ``length`` of the field's value and the
    floored average length over all documents.
    """
    tf = tf.cast("float")
    norm = tf + _f(1.2) * (_f(0.25) + _f(0.75) * _divide(length, F.when(average != 0, average)))
    return F.when(average == 0, _f(0.0)).otherwise(bm25_idf(n, df) * _divide(tf * _f(2.2), norm)).cast("float")


def average_length(length_sum: Column, count: Column) -> Column:
    """Whole average, as a float."""
    return F.floor(length_sum / F.when(count != 0, count)).cast("float")
