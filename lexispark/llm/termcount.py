"""Frequency of every distinct term: burst tries filled by each task, and their matching subtrees merged.

A burst trie branches by leading characters only where many terms share them; everything below a branch
lies in a small container of suffixes with their counters. Each task fills its own trie from columnar
batches and gives it off, container by container, whenever it holds ``SPILL`` terms, so its memory is
bounded whatever the table. Containers of all tasks are then cut into routes, ranges of terms with about as
many terms each, however long the prefixes that these share; the cuts come from a sample of the terms, of bounded
size. The subtrees of one route meet in one task in order of their first term, and what lies before the first term of the next
subtree is complete and leaves the trie, so a route may hold any number of terms.
"""

from __future__ import annotations

import bisect
from collections.abc import Iterator

import pyarrow as pa
from pyspark import Broadcast
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from lexispark.operators.postings import distinct_postings
from lexispark.session import materialize

#: A container bursts into one for each next character beyond so many suffixes.
BURST = 256
#: A task gives its trie off when it holds so many terms.
SPILL = 200_000
#: Most terms, as the tasks counted them, under one route.
ROUTE_TERMS = 50_000
#: Sampled terms for each route, and most terms and characters of the whole sample: what the driver holds.
SAMPLED, MOST_SAMPLED, MOST_CHARACTERS = 20, 1_000_000, 64_000_000
_BLOCK = 100_000
_SUBTREES = "field string, prefix string, suffixes array<string>, occurrences array<bigint>, documents array<bigint>"


class BurstTrie:
    """Terms of one field with mergeable counters [occurrences, documents]."""

    __slots__ = ("root", "size")

    def __init__(self) -> None:
        # A node is a dict: of next character -> node if it has burst (marked by None -> own counters), else suffix -> counters.
        self.root: list = [False, {}]
        self.size = 0

    def add(self, term: str, occurrences: int, documents: int) -> None:
        node, at = self.root, 0
        while node[0]:
            step = term[at : at + 1]
            below = node[1].get(step)
            if below is None:
                below = node[1][step] = [False, {}]
            if not step:
                break
            node, at = below, at + 1
        else:
            below = node
        own = below[1]
        suffix = term[at:]
        counters = own.get(suffix)
        if counters is None:
            own[suffix] = [occurrences, documents]
            self.size += 1
            if len(own) > BURST and suffix:
                self._burst(below)
        else:
            counters[0] += occurrences
            counters[1] += documents

    @staticmethod
    def _burst(node: list) -> None:
        parts: dict[str, list] = {}
        for suffix, counters in node[1].items():
            step = suffix[:1]
            parts.setdefault(step, [False, {}])[1][suffix[1:]] = counters
        node[0], node[1] = True, parts
        for step, below in parts.items():
            if step and len(below[1]) > BURST:
                BurstTrie._burst(below)

    def containers(self) -> Iterator[tuple[str, dict[str, list[int]]]]:
        """(prefix, {suffix: counters}) of every container, in the order of the prefixes."""
        todo = [("", self.root)]
        while todo:
            prefix, node = todo.pop()
            if node[0]:
                todo += [(prefix + step, below) for step, below in sorted(node[1].items(), reverse=True)]
            elif node[1]:
                yield prefix, node[1]

    def items(self) -> list[tuple[str, list[int]]]:
        """(term, counters) in order of the terms."""
        return [(prefix + suffix, own[suffix]) for prefix, own in self.containers() for suffix in sorted(own)]


def _give_off(tries: dict[str, BurstTrie]) -> Iterator[pa.RecordBatch]:
    rows = [(field, prefix, sorted(own), own) for field, trie in tries.items() for prefix, own in trie.containers()]
    for at in range(0, len(rows), 1000):
        part = rows[at : at + 1000]
        yield pa.record_batch(
            [
                pa.array([r[0] for r in part], pa.string()),
                pa.array([r[1] for r in part], pa.string()),
                pa.array([r[2] for r in part], pa.list_(pa.string())),
                *(pa.array([[r[3][s][k] for s in r[2]] for r in part], pa.list_(pa.int64())) for k in (0, 1)),
            ],
            names=["field", "prefix", "suffixes", "occurrences", "documents"],
        )


def _fill(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """(field, term, frequency) rows -> containers; equal terms of a block are combined by columns first."""
    tries: dict[str, BurstTrie] = {}
    block: list[pa.RecordBatch] = []

    def take() -> None:
        combined = pa.Table.from_batches(block).group_by(["field", "term"]).aggregate([("frequency", "sum"), ("frequency", "count")])
        columns = (combined.column(k).to_pylist() for k in ("field", "term", "frequency_sum", "frequency_count"))
        for field, term, occurrences, documents in zip(*columns):
            trie = tries.get(field)
            if trie is None:
                trie = tries[field] = BurstTrie()
            trie.add(term, occurrences, documents)
        block.clear()

    for batch in batches:
        block.append(batch)
        if sum(b.num_rows for b in block) >= _BLOCK:
            take()
            if sum(t.size for t in tries.values()) > SPILL:
                yield from _give_off(tries)
                tries.clear()
    if block:
        take()
    yield from _give_off(tries)


def _cut(sample: list[tuple[str, str]], routes: int) -> list[tuple[str, str]]:
    """(field, first term) of each route but the first, in order: the sample is parted evenly."""
    sample = sorted(sample)
    cuts = {sample[len(sample) * i // routes] for i in range(1, routes)} if sample else set()
    return sorted(cuts)


def _route(cuts: Broadcast):
    """Containers -> (route, first term, container) parts; a container above a cut is divided at it."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        kinds = (pa.int32(), pa.string(), pa.string(), pa.string(), pa.list_(pa.string()), pa.list_(pa.int64()), pa.list_(pa.int64()))
        names = ["route", "first", "field", "prefix", "suffixes", "occurrences", "documents"]
        for batch in batches:
            out: list[tuple] = []
            for row in batch.to_pylist():
                field, prefix, suffixes = row["field"], row["prefix"], row["suffixes"]
                a = 0
                while a < len(suffixes):  # suffixes are sorted, so each part is a slice
                    at = bisect.bisect_right(cuts.value, (field, prefix + suffixes[a]))
                    b = len(suffixes)
                    if at < len(cuts.value) and (field, prefix + suffixes[-1]) >= cuts.value[at]:
                        b = bisect.bisect_left(suffixes, cuts.value[at], a, key=lambda x: (field, prefix + x))
                    out.append((at, prefix + suffixes[a], field, prefix, suffixes[a:b], row["occurrences"][a:b], row["documents"][a:b]))
                    a = b
            yield pa.record_batch([pa.array([r[i] for r in out], kind) for i, kind in enumerate(kinds)], names=names)

    return run


def _terms(field: str, items: list[tuple[str, list[int]]]) -> Iterator[pa.RecordBatch]:
    for at in range(0, len(items), 10_000):
        part = items[at : at + 10_000]
        columns = [pa.array([field] * len(part), pa.string()), pa.array([t for t, _ in part], pa.string()), *(pa.array([c[k] for _, c in part], pa.int64()) for k in (0, 1))]
        yield pa.record_batch(columns, names=["field", "term", "occurrences", "documents"])


def _merge(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """Subtrees of one route, in order of field and first term -> terms with their counters.

    No subtree to come has a term before the first one of the next, so all before that leave the trie whenever it has grown.
    """
    field, trie, most = None, BurstTrie(), SPILL
    for batch in batches:
        for row in batch.to_pylist():
            if row["field"] != field:
                if field is not None:
                    yield from _terms(field, trie.items())
                field, trie, most = row["field"], BurstTrie(), SPILL
            elif trie.size > most:
                done, kept = [], BurstTrie()
                for term, (o, d) in trie.items():
                    if term < row["first"]:
                        done.append((term, [o, d]))
                    else:
                        kept.add(term, o, d)
                trie, most = kept, max(SPILL, 2 * kept.size)
                yield from _terms(field, done)
            for suffix, occurrences, documents in zip(row["suffixes"], row["occurrences"], row["documents"]):
                trie.add(row["prefix"] + suffix, occurrences, documents)
    if field is not None:
        yield from _terms(field, trie.items())


def term_counts(postings: DataFrame) -> DataFrame:
    """(field, term, occurrences, documents) of every distinct term of every field.

    A posting counts once however often it was flushed; rows with a null field, term or doc_id do not count;
    a null frequency is no occurrence. The empty term is a term. An empty table gives an empty result. Terms may be of
    any length; a term that all documents have is one entry of a trie in each task, never a group of rows.
    """
    once = distinct_postings(postings).select("field", "term", "frequency")
    subtrees = materialize(once.mapInArrow(_fill, _SUBTREES), "subtrees")
    cuts = _cuts(subtrees)
    shared = postings.sparkSession.sparkContext.broadcast(cuts)  # of at most MOST_CHARACTERS
    routed = subtrees.mapInArrow(_route(shared), "route int, first string, " + _SUBTREES)
    routed = routed.repartitionById(len(cuts) + 1, "route").drop("route").sortWithinPartitions("field", "first")
    return routed.mapInArrow(_merge, "field string, term string, occurrences bigint, documents bigint")


def _cuts(subtrees: DataFrame) -> list[tuple[str, str]]:
    """Where the routes begin, from a sample of the terms by their hash, bounded in number and in characters."""
    suffix = F.transform("suffixes", lambda s: F.length(s) + F.length("prefix"))
    total, size = subtrees.agg(F.coalesce(F.sum(F.size("suffixes")), F.lit(0)), F.coalesce(F.sum(F.aggregate(suffix, F.lit(0).cast("bigint"), lambda a, x: a + x)), F.lit(0))).first()
    routes = min(-(-total // ROUTE_TERMS), MOST_SAMPLED // SAMPLED)
    if routes < 2:
        return []
    one_in = max(1, total // (routes * SAMPLED), -(-size // MOST_CHARACTERS))
    terms = subtrees.select("field", F.explode(F.transform("suffixes", lambda s: F.concat("prefix", s))).alias("term"))
    return _cut([(r.field, r.term) for r in terms.where(F.pmod(F.xxhash64("field", "term"), F.lit(one_in)) == 0).collect()], routes)


def marked_terms(postings: DataFrame, common_percent: int = 20, rare_documents: int = 1) -> DataFrame:
    """``term_counts`` with ``mark``: 'common' for terms of more than ``common_percent`` % of the documents with any
    posting of the field, else 'rare' for terms of at most ``rare_documents`` documents, else null."""
    counts = term_counts(postings)
    posted = postings.where(F.col("term").isNotNull() & F.col("field").isNotNull() & F.col("doc_id").isNotNull())
    fields = posted.select("field", "doc_id").distinct().groupBy("field").agg(F.count("*").alias("n"))
    # A row for each field of the index: not more than the columns of a document.
    marked = counts.join(F.broadcast(fields), "field")
    mark = F.when(F.col("documents") * 100 > F.col("n") * common_percent, "common").when(F.col("documents") <= rare_documents, "rare")
    return marked.select("field", "term", "occurrences", "documents", mark.alias("mark"))
