"""Documents as an index: postings in long form, field statistics, points, stored columns and deletes."""

from __future__ import annotations

from dataclasses import dataclass, field, replace

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T

from lexispark.fields import DOUBLE, KEY, STRING, FieldSpec, infer
from lexispark.functions import text as tx
from lexispark.functions.scoring import average_length
from lexispark.functions.segment import Dictionary, Words, segment_runs, segment_terms


@dataclass(frozen=True)
class Analyzer:
    """How text becomes terms: dictionary and number of paths for runs without blanks, characters and punctuation to replace."""

    words: Words = frozenset()
    paths: int = 1
    variants: dict[str, str] = field(default_factory=dict)
    punctuation: str = ""
    longest_run: int | None = tx.LONGEST_RUN

    def normalize(self, c):
        return tx.normalize(c, self.variants, self.punctuation)

    def terms(self, texts: DataFrame, column: str) -> DataFrame:
        """The other columns of ``texts``, and ``term``, one row for each occurrence.

        Latin and digit terms never leave the JVM; without a dictionary neither does anything else.
        """
        rest = [c for c in texts.columns if c != column]
        token = texts.select(*rest, F.explode(tx.tokens(self.normalize(F.col(column)))).alias("token"))
        if not self.words:
            cut = tx.single_characters(F.col("token"), self.longest_run)
            return token.select(*rest, F.explode(F.when(tx.is_plain(F.col("token")), F.array("token")).otherwise(cut)).alias("term"))
        plain = token.where(tx.is_plain(F.col("token"))).withColumnRenamed("token", "term")
        runs = segment_runs(token.where(~tx.is_plain(F.col("token"))), "token", self.paths, self.words, self.longest_run)
        return plain.unionByName(runs.select(*rest, F.explode("segments.term").alias("term")))

    def terms_python(self, value: str | None) -> list[tuple[str, int]]:
        """(term, position) of a query string, in order of position."""
        out: list[tuple[str, int]] = []
        words = Dictionary(self.words)
        for token, at in tx.tokens_python(tx.normalize_python(value, self.variants, self.punctuation)):
            if tx.is_plain_python(token):
                out.append((token, at))
            elif self.words:
                out += [(t, at + p) for t, p in segment_terms(token, self.paths, words, self.longest_run)]
            else:
                out += [(c, at + i) for i, c in enumerate(token[: self.longest_run])]
        return out


@dataclass(frozen=True)
class Known:
    """Numbers kept with an index, so that no query needs to count: live documents, (len_sum, doc_count) of each field."""

    live: int | None
    fields: dict[str, tuple[int, int]]


@dataclass(frozen=True)
class Index:
    """Lazy tables of one index; ``doc_id`` is the primary key of the documents.

    stored(doc_id, columns...), postings(field, term, doc_id, tf, dl), stats(field, type, len_sum, doc_count),
    deletes(doc_id). A stored index also has terms(field, term, df), of which a term has a row for each segment,
    and ``known``; without them queries count.
    """

    stored: DataFrame
    postings: DataFrame
    stats: DataFrame
    deletes: DataFrame
    specs: tuple[FieldSpec, ...]
    analyzer: Analyzer = Analyzer()
    any_deletes: bool = True
    terms: DataFrame | None = None
    known: Known | None = None

    def spec(self, name: str) -> FieldSpec | None:
        return next((s for s in self.specs if s.name == name), None)

    def live(self, df: DataFrame) -> DataFrame:
        """Rows of documents that are not deleted; nothing is joined if there are no deletes."""
        return df.join(self.deletes, "doc_id", "left_anti") if self.any_deletes else df

    def points(self, name: str) -> DataFrame:
        """(doc_id, value) of a numeric field; whole and decimal numbers keep their type, as a double would round them."""
        kind = point_type(self.stored.schema[name].dataType)
        return self.stored.select("doc_id", F.col(name).cast(kind).alias("value")).where(F.col("value").isNotNull())

    def least_bound(self, name: str, lower: float, n: int) -> float | None:
        """A number at or below which at least ``n`` live points from ``lower`` on lie; None if none is known."""
        return None

    def live_count(self) -> Column:
        """The number of live documents."""
        return self.num_docs().scalar() if self.known is None or self.known.live is None else F.lit(self.known.live)

    def average(self, name: str) -> Column:
        """The floored average length of a field."""
        if self.known is not None:
            length, count = self.known.fields.get(name, (0, 0))
            return average_length(F.lit(length), F.lit(count))
        return self.stats.where(F.col("field") == name).agg(F.max(average_length(F.col("len_sum"), F.col("doc_count")))).scalar()

    def frequencies(self) -> DataFrame:
        """(field, term, df): rows to be summed by term; deleted documents count."""
        return self.postings.select("field", "term", F.lit(1).alias("df")) if self.terms is None else self.terms

    def cache(self) -> Index:
        """The index with its postings and frequencies kept by the executors as they are first read; ``close`` frees them."""
        return replace(self, postings=self.postings.persist(), terms=self.terms and self.terms.persist())

    def close(self) -> None:
        """Free what ``cache`` keeps; the index can still be read."""
        self.postings.unpersist()
        if self.terms is not None:
            self.terms.unpersist()

    def num_docs(self) -> DataFrame:
        """One row (num_docs): live documents."""
        return self.live(self.stored.select("doc_id")).agg(F.count("*").alias("num_docs"))

    def total_docs(self) -> DataFrame:
        """One row (total_docs): the highest id ever given, deleted or not."""
        return self.stored.agg(F.max("doc_id").alias("total_docs"))

    def with_deletes(self, ids: DataFrame) -> Index:
        """The index with more documents deleted; unknown ids and repeated deletes change nothing."""
        known = ids.select("doc_id").distinct().join(self.stored.select("doc_id"), "doc_id", "left_semi")
        return replace(self, deletes=self.deletes.unionByName(known).distinct(), any_deletes=True, known=self.known and replace(self.known, live=None))


def point_type(kind: T.DataType) -> str:
    """The SQL type in which numbers of a column are compared."""
    if isinstance(kind, T.DecimalType):
        return kind.simpleString()
    return "bigint" if isinstance(kind, (T.LongType, T.IntegerType, T.ShortType, T.ByteType)) else "double"


def build_postings(documents: DataFrame, specs: tuple[FieldSpec, ...], analyzer: Analyzer) -> DataFrame:
    """(field, term, doc_id, tf, dl) of every tokenized string field.

    dl is the length of the raw value in UTF-16 units. All terms of a value come from one row, so frequencies are
    complete before the shuffle, and the shuffle moves each posting once.
    """
    names = [s.name for s in specs if s.type == STRING and s.tokenized]
    parts = [documents.select(F.lit(n).alias("field"), "doc_id", tx.value_length(F.col(n)).alias("dl"), F.col(n).alias("_value")).where(F.col(n).isNotNull()) for n in names]
    if not parts:
        return documents.sparkSession.createDataFrame([], "field string, term string, doc_id bigint, tf int, dl int")
    values = parts[0]
    for p in parts[1:]:
        values = values.unionByName(p)
    terms = analyzer.terms(values, "_value")
    return terms.groupBy("field", "term", "doc_id", "dl").agg(F.count("*").cast("int").alias("tf")).select("field", "term", "doc_id", "tf", F.col("dl").cast("int").alias("dl"))


def build_stats(documents: DataFrame, specs: tuple[FieldSpec, ...]) -> DataFrame:
    """(field, type, len_sum, doc_count): strings by length, numbers 1 each, the key 8; one row for each field with values, one scan."""
    length = {STRING: lambda c: tx.value_length(c.cast("string")), DOUBLE: lambda c: F.lit(1), KEY: lambda c: F.lit(8)}
    used = [s for s in specs if s.stored or s.tokenized]
    sums = []
    for i, s in enumerate(used):
        column = F.col("doc_id" if s.type == KEY else s.name)
        sums += [F.sum(F.when(column.isNotNull(), length[s.type](column))).cast("bigint").alias(f"s{i}"), F.count(column).alias(f"n{i}")]
    rows = F.explode(F.array(*[F.struct(F.lit(s.name).alias("field"), F.lit(s.type).alias("type"), F.col(f"s{i}").alias("len_sum"), F.col(f"n{i}").alias("doc_count")) for i, s in enumerate(used)]))
    return documents.agg(*sums).select(rows.alias("r")).select("r.*").where("doc_count > 0")


def as_documents(df: DataFrame, key: str) -> DataFrame:
    """``df`` with its key as bigint ``doc_id``."""
    return df.select(F.col(key).cast("bigint").alias("doc_id"), *[c for c in df.columns if c != key])


def duplicate_keys(documents: DataFrame) -> DataFrame:
    """(doc_id, n) of keys that occur more than once, or are null."""
    return documents.groupBy("doc_id").agg(F.count("*").alias("n")).where("n > 1 OR doc_id IS NULL")


def build_index(df: DataFrame, key: str, specs: list[FieldSpec] | None = None, analyzer: Analyzer = Analyzer()) -> Index:
    """A lazy index over ``df``; keys must be unique and not null (see ``duplicate_keys``; a store enforces it)."""
    specs = tuple(specs if specs is not None else infer(df.schema, key))
    documents = as_documents(df, key)
    kept = [s.name for s in specs if s.type != KEY and (s.stored or s.type == DOUBLE)]
    none = df.sparkSession.createDataFrame([], "doc_id bigint")
    return Index(documents.select("doc_id", *kept), build_postings(documents, specs, analyzer), build_stats(documents, specs), none, specs, analyzer, False)
