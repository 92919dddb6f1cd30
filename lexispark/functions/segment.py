"""Segmentation of runs without blanks by the n paths of fewest words through a dictionary."""

from __future__ import annotations

from collections.abc import Iterator

import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

Words = frozenset[str]


class Dictionary:
    """Words with their beginnings, so that a walk along a text ends where no word goes on."""

    def __init__(self, words: Words):
        self.words = frozenset(w for w in words if len(w) > 1)
        self.beginnings = frozenset(w[:k] for w in self.words for k in range(2, len(w)))

    def ends(self, text: str, start: int) -> list[int]:
        """Where the words that start at a place of the text end; a single character is always one."""
        out, end = [start + 1], start + 2
        while end <= len(text):
            part = text[start:end]
            if part in self.words:
                out.append(end)
            if end - start > 1 and part not in self.beginnings:
                break
            end += 1
        return out


def fewest_word_paths(text: str, n: int, words: Words | Dictionary) -> list[list[tuple[str, int]]]:
    """At most n segmentations, each a list of (word, position), fewest words first.

    A word is one character or any dictionary entry. At every place the n best ways are kept; of ways with
    as many words the one whose last word is longest comes first. ``n`` must be at least 1.
    """
    if n < 1:
        raise ValueError("n must be at least 1")
    known = words if isinstance(words, Dictionary) else Dictionary(words)
    # Ways to each place, (words, (way before, (last word, its place))); they arrive in order of the last word's start.
    ways: list[list[tuple[int, tuple]]] = [[(0, ())], *([] for _ in text)]
    for start in range(len(text)):
        here = sorted(ways[start], key=lambda x: x[0])[:n]  # stable: earlier starts first among equals
        ways[start] = []
        for end in known.ends(text, start):
            last = (text[start:end], start)
            ways[end] += [(cost + 1, (way, last)) for cost, way in here]

    def unfold(way: tuple) -> list[tuple[str, int]]:
        out = []
        while way:
            way, last = way
            out.append(last)
        return out[::-1]

    return [unfold(way) for _, way in sorted(ways[-1], key=lambda x: x[0])[:n]] if text else []


def segment_terms(text: str, n: int, words: Words | Dictionary, longest: int | None = 20) -> list[tuple[str, int]]:
    """The distinct (term, position) of the n best paths through the first ``longest`` characters, in order."""
    return sorted({t for path in fewest_word_paths(text[:longest] if longest else text, n, words) for t in path}, key=lambda t: (t[1], t[0]))


def segment_runs(runs: DataFrame, column: str, n: int, words: Words, longest: int | None = 20) -> DataFrame:
    """Every column of ``runs`` and ``segments``, an array of (term, pos); Arrow batches, no shuffle.

    Null and empty runs have no terms. Repeated runs of a batch are segmented once.
    """
    place = runs.columns.index(column)
    shared = runs.sparkSession.sparkContext.broadcast(Dictionary(words))  # a resource of fixed size: see load_words
    kind = pa.list_(pa.struct([("term", pa.string()), ("pos", pa.int32())]))

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        known: dict[str, list] = {}
        for batch in batches:
            out = []
            for text in batch.column(place).to_pylist():
                if text and text not in known:
                    if len(known) > 100_000:
                        known.clear()
                    known[text] = [{"term": t, "pos": p} for t, p in segment_terms(text, n, shared.value, longest)]
                out.append(known[text] if text else [])
            yield pa.RecordBatch.from_arrays([*batch.columns, pa.array(out, kind)], names=[*batch.schema.names, "segments"])

    schema = runs.withColumn("segments", F.lit(None).cast("array<struct<term:string,pos:int>>")).schema
    return runs.mapInArrow(run, schema)


def segment_paths(texts: DataFrame, column: str, n: int, words: Words) -> DataFrame:
    """(text, path, cost, words) of up to n paths of each distinct text, without a limit of length; path counts from 1."""
    shared = texts.sparkSession.sparkContext.broadcast(Dictionary(words))

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            rows = [(t, i + 1, len(p), [w for w, _ in p]) for t in batch.column(0).to_pylist() for i, p in enumerate(fewest_word_paths(t, n, shared.value))]
            cols = list(zip(*rows)) or [[], [], [], []]
            kinds = (pa.string(), pa.int32(), pa.int32(), pa.list_(pa.string()))
            yield pa.RecordBatch.from_arrays([pa.array(list(c), k) for c, k in zip(cols, kinds)], names=["text", "path", "cost", "words"])

    once = texts.select(F.col(column).alias("text")).where(F.col("text").isNotNull()).distinct()
    return once.mapInArrow(run, "text string, path int, cost int, words array<string>")
