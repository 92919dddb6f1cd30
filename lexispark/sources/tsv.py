"""Product files of tab-separated lines: documents with the line number as key; dictionaries of one word a line."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession, Window
from pyspark.sql import functions as F


def numbered_lines(spark: SparkSession, path: str) -> DataFrame:
    """(line_no, line) from 0 in the order of the files' names and, within a file, of its lines.

    Two passes: the lines of each split of a file are counted, and each split numbers its own from the sum of those before
    it. Spark orders splits by size, so a split is known by its file and its first byte, not by its place. What is
    broadcast is a row for each split (some millionth of the text).
    """
    lines = spark.read.text(path).select("value", F.col("_metadata.file_path").alias("_path"), F.col("_metadata.file_block_start").alias("_start"), F.monotonically_increasing_id().alias("_id"))
    splits = lines.groupBy("_path", "_start").agg(F.count("*").alias("n"), F.min("_id").alias("first"))
    earlier = Window.orderBy("_path", "_start").rowsBetween(Window.unboundedPreceding, -1)
    offsets = splits.select("_path", "_start", "first", F.coalesce(F.sum("n").over(earlier), F.lit(0)).alias("before"))
    return lines.join(F.broadcast(offsets), ["_path", "_start"]).select((F.col("before") + F.col("_id") - F.col("first")).alias("line_no"), F.col("value").alias("line"))


def parse_goods(lines: DataFrame, float32: bool = False, key_offset: int = 0, whole_split: bool = False) -> DataFrame:
    """(uniqueID, title, price, descript, digt) from (line_no, line): second field the title, third the price.

    ``whole_split`` ignores further fields; without it they belong to the third and spoil the price. ``float32`` rounds
    prices as a single-precision parse does; ``key_offset`` is added to the line number. A price that is no number is null.
    """
    parts = F.split("line", "\t", -1 if whole_split else 3)
    text = F.try_element_at(parts, F.lit(3))
    misspelt = text.rlike("(?i)inf|nan") & ~text.rlike("NaN|Infinity")  # a cast takes these in any case, and "inf"
    price = F.when(~misspelt, text.try_cast("double"))
    price = price.cast("float").cast("double") if float32 else price
    title = F.try_element_at(parts, F.lit(2))
    return lines.select((F.col("line_no") + key_offset).alias("uniqueID"), title.alias("title"), price.alias("price"), title.alias("descript"), price.alias("digt"))


def load_documents(spark: SparkSession, path: str, most: int = 0, **how) -> DataFrame:
    """Documents of a file; ``most`` > 0 keeps the first so many lines, 0 or less all."""
    lines = numbered_lines(spark, path)
    return parse_goods(lines.where(F.col("line_no") < most) if most > 0 else lines, **how)


def load_titles(spark: SparkSession, path: str, most: int) -> DataFrame:
    """(title) of the first ``most`` lines."""
    return load_documents(spark, path, most).select("title")


def load_words(words: DataFrame, column: str = "word", trim: bool = True, most: int = 5_000_000) -> frozenset[str]:
    """A dictionary for the driver and, by broadcast, all tasks: trimmed, without nulls, blanks and repeats.

    A dictionary is a resource of fixed size, not data; one of more than ``most`` entries is refused.
    """
    value = F.trim(column) if trim else F.col(column)
    rows = words.select(value.alias("w")).where("w IS NOT NULL AND w <> ''").distinct().limit(most + 1).collect()
    if len(rows) > most:
        raise ValueError(f"more than {most} dictionary entries")
    return frozenset(r.w for r in rows)


def load_punctuation(spark: SparkSession, path: str) -> str:
    """Characters of a punctuation file, one a line, not trimmed."""
    return "".join(sorted(load_words(spark.read.text(path), "value", trim=False)))
