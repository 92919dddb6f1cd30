"""Reading level of each text, from the grades at which its words are acquired.

Texts long enough to be graded by their surface (words a sentence and long words, the LIX measure) are the
graded texts. A word's acquisition grade is a low quantile of the grades of the texts that use it: the grade by
which a reader has met it. A text's level is predicted from quantiles of the grades of its known words, with weights
calibrated by least squares.

Texts are halved by the hash of their id, and each half is predicted from the other: its words have the grades they have in
the texts of the other half, and the weights are fitted to the other half's measures. No level has seen its own text.
"""

from __future__ import annotations

import numpy as np
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from lexispark.operators.skew import skew_safe_join
from lexispark.session import materialize

#: Width of a grade band in LIX.
BAND = 4
#: Words of fewer graded texts are unknown.
LEAST_TEXTS = 3
#: The share of a word's graded texts at or below its acquisition grade.
ACQUIRED = 0.3
#: Quantiles of a text's word grades.
QUANTILES = (0.25, 0.5, 0.75, 0.9)
#: A half of fewer graded texts sets no bar for the other.
LEAST_CALIBRATION = 200
#: Where a sentence ends, and what counts as a letter, a long word and a Han character.
SENTENCE_END = r"[.!?。！？…]+(?:[\s\p{Z}\x0b\x1c-\x1f\x85]|\z)|[\n\r\x0b\x0c\x1c-\x1e\x85\x{2028}\x{2029}]"
HAN = r"[\x{3400}-\x{9fff}\x{f900}-\x{faff}]"
LONG, LEAST_WORDS = 6, 20


def surface(documents: DataFrame, id_column: str = "doc_id", column: str = "text") -> DataFrame:
    """(id, words, n_words, n_long, n_sentences, han, lix, graded) of every non-null text; ``words`` are distinct, lower-cased.

    ``lix`` is null without words. A sentence counts if it has a word.
    """
    text = F.col("text")
    words = F.regexp_extract_all(text, F.lit(r"(\p{L}+)"), F.lit(1))
    parts = F.filter(F.split(text, SENTENCE_END, -1), lambda s: s.rlike(r"\p{L}"))
    some = documents.select(id_column, F.col(column).cast("string").alias("text")).where(text.isNotNull()).select(id_column, "text", words.alias("all"))
    some = some.select(
        id_column, F.array_distinct(F.transform("all", F.lower)).alias("words"), F.size("all").alias("n_words"),
        F.size(F.filter("all", lambda w: F.length(w) > LONG)).alias("n_long"), F.size(parts).alias("n_sentences"), text.rlike(HAN).alias("han"),
    )
    n = F.col("n_words").cast("double")
    lix = F.when(F.col("n_words") > 0, n / F.col("n_sentences") + F.col("n_long") * F.lit(100.0) / n)
    return some.withColumn("lix", lix).withColumn("graded", ~F.col("han") & (F.col("n_words") >= LEAST_WORDS))


def _quantile(histogram: Column, share: float) -> Column:
    """The least grade of a sorted array of (grade, n) at or below which ``share`` of all n lies."""
    total = F.aggregate(histogram, F.lit(0).cast("bigint"), lambda s, x: s + x["n"])
    seen = F.aggregate(
        histogram,
        F.struct(F.lit(0).cast("bigint").alias("sum"), F.lit(None).cast("int").alias("at")),
        lambda s, x: F.struct((s["sum"] + x["n"]).alias("sum"), F.coalesce(s["at"], F.when(s["sum"] + x["n"] >= total * share, x["grade"])).alias("at")),
    )
    return seen["at"]


def half(c: Column) -> Column:
    """0 or 1 by the first figure of the hash of an id; a null id is of half 0."""
    return F.coalesce((F.conv(F.substring(F.md5(c.cast("string")), 1, 1), 16, 10).cast("int") % 2), F.lit(0))


def word_grades(pairs: DataFrame) -> DataFrame:
    """(word, grade0, grade1, rows) from (word, lix, graded, half), one row for each word of each text.

    ``grade0`` is the grade by the graded texts of half 1, for use on texts of half 0, and ``grade1`` the other way round;
    null where fewer than LEAST_TEXTS of them have the word. ``rows`` counts all texts with the word. Counts by band are combined
    before they are shuffled, so a word that every text has is a few rows.
    """
    band = F.when(F.col("graded"), F.floor(F.col("lix") / BAND).cast("int"))
    counted = pairs.groupBy("word", "half", band.alias("grade")).agg(F.count("*").alias("n"))
    own = lambda k: F.array_sort(F.collect_list(F.when(F.col("grade").isNotNull() & (F.col("half") == k), F.struct("grade", "n"))))
    by_word = counted.groupBy("word").agg(F.sum("n").alias("rows"), own(1).alias("h0"), own(0).alias("h1"))
    texts = lambda h: F.aggregate(h, F.lit(0).cast("bigint"), lambda s, x: s + x["n"])
    grade = lambda h: F.when(texts(h) >= LEAST_TEXTS, _quantile(F.col(h), ACQUIRED))
    return by_word.select("word", "rows", grade("h0").alias("grade0"), grade("h1").alias("grade1")).where("grade0 IS NOT NULL OR grade1 IS NOT NULL")


def _calibrate(features: DataFrame) -> dict[int, list[float]]:
    """Half -> weights [constant, quantiles...] by least squares on its graded texts, from two rows of sums."""
    names = [f"q{i}" for i in range(len(QUANTILES))]
    x = [F.lit(1.0), *(F.col(c).cast("double") for c in names)]
    known = features.where(F.col("graded") & F.col("q0").isNotNull())
    cells = [(i, j) for i in range(len(x)) for j in range(i, len(x))]
    out = {0: [0.0] * len(x), 1: [0.0] * len(x)}
    for row in known.groupBy("half").agg(*[F.sum(x[i] * x[j]) for i, j in cells], *[F.sum(x[i] * F.col("lix")) for i in range(len(x))]).collect():
        a = np.zeros((len(x), len(x)))
        for k, (i, j) in enumerate(cells):
            a[i, j] = a[j, i] = row[1 + k]
        out[row[0]] = np.linalg.lstsq(a + np.eye(len(x)) * 1e-6, np.array(row[1 + len(cells) :], float), rcond=None)[0].tolist()
    return out


def reading_levels(documents: DataFrame, id_column: str = "doc_id", column: str = "text") -> DataFrame:
    """(id, level, lix, n_words, n_sentences, graded, half) of every non-null text.

    ``level`` is the predicted difficulty on the scale of LIX; it is null for a text without known words (empty,
    of unknown words alone) and for a null id. Rows that repeat an id stay, with one level from the words of all of them. An
    empty table gives an empty result; other columns are ignored; a long text is as many distinct words as it has, no more.
    """
    texts = surface(documents, id_column, column).withColumn("half", half(F.col(id_column)))
    texts = materialize(texts, "surface")
    pairs = texts.select(id_column, F.explode("words").alias("word"), "lix", "graded", "half")
    grades = materialize(word_grades(pairs), "grades")
    total = grades.agg(F.coalesce(F.sum("rows"), F.lit(0))).first()[0]
    known = skew_safe_join(pairs.select(id_column, "word", "half"), grades, ["word"], "rows", total)
    known = known.select(id_column, F.when(F.col("half") == 0, F.col("grade0")).otherwise(F.col("grade1")).alias("grade")).where("grade IS NOT NULL")
    histogram = known.groupBy(id_column, "grade").agg(F.count("*").alias("n")).groupBy(id_column)
    histogram = histogram.agg(F.array_sort(F.collect_list(F.struct("grade", "n"))).alias("histogram"))
    quantiles = histogram.select(id_column, *[_quantile(F.col("histogram"), q).alias(f"q{i}") for i, q in enumerate(QUANTILES)])
    features = texts.drop("words").join(quantiles, id_column, "left")
    features = materialize(features, "levels")
    weights = _calibrate(features)

    def predicted(w: list[float]) -> Column:
        level = F.lit(w[0])
        for i, x in enumerate(w[1:]):
            level = level + F.col(f"q{i}") * F.lit(x)
        return level

    level = F.when(F.col("half") == 0, predicted(weights[1])).otherwise(predicted(weights[0]))
    return features.select(id_column, level.alias("level"), "lix", "n_words", "n_sentences", "graded", "half")


def proposal_bars(levels: DataFrame, least: float = 55.0) -> dict[int, float]:
    """Half -> the level from which its texts are proposed as demanding, set by the graded texts of the other half alone.

    The bar lies below the lowest level of any demanding text there by the root mean square of the errors there, and not above
    ``least`` less three times that; a half with fewer than LEAST_CALIBRATION graded texts rejects nothing of the other.
    """
    error = F.col("level") - F.col("lix")
    rows = levels.where("graded AND level IS NOT NULL").groupBy("half").agg(
        F.count("*").alias("n"), F.sqrt(F.avg(error * error)).alias("rms"), F.min(F.when(F.col("lix") >= least, F.col("level"))).alias("lowest")
    )
    bars = {0: float("-inf"), 1: float("-inf")}
    for r in rows.collect():
        if r.n >= LEAST_CALIBRATION:
            bars[1 - r.half] = min(least - 3 * r.rms, least if r.lowest is None else r.lowest - r.rms)
    return bars


def demanding(levels: DataFrame, least: float = 55.0, id_column: str = "doc_id") -> DataFrame:
    """(id) of texts with at least that LIX: proposed by their predicted level, confirmed by the exact measure.

    A text whose level is below the bar that the other half sets (``proposal_bars``) is rejected by its level, whatever its
    measure. A text without known words has no level and can't be rejected by it.
    """
    bars = proposal_bars(levels, least)
    bar = F.when(F.col("half") == 0, F.lit(bars[0])).otherwise(F.lit(bars[1]))
    proposed = levels.where(F.col("level").isNull() | (F.col("level") >= bar))
    return proposed.where(F.col("graded") & (F.col("lix") >= least)).select(id_column)
