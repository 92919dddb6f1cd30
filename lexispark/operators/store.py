"""An index as a folder of Parquet tables: segments appended, compacted, documents deleted softly.

    path/_manifest/00000001.json     what one version consists of; the highest readable number holds
    path/segment-ID/stored           sorted by doc_id
    path/segment-ID/postings/field=  sorted by term and doc_id
    path/segment-ID/terms/field=     (term, df), sorted by term
    path/segment-ID/points-FIELD     (value, doc_id), sorted by value
    path/deletes-ID                  (doc_id); no id is in two of them

Tables are written first and named by the next manifest. A manifest is written under a temporary name and then
linked to its number, which fails if another writer has it: an append, merge or delete holds as a whole or not at
all, a crash leaves nothing half written under a number, and open readers keep their version. This needs a file
system that can rename without overwriting (local, HDFS); on an object store that cannot, writers need a lock of their own.

The manifest also keeps the numbers that every query needs (documents, deletes, field statistics, quantiles of
points), so that searching reads the postings of its terms and nothing else.
"""

from __future__ import annotations

import json
import math
import os
import time
import uuid
from concurrent.futures import ThreadPoolExecutor
from dataclasses import asdict, dataclass, field, replace
from urllib.parse import unquote, urlparse

import pyarrow as pa
from pyspark import inheritable_thread_target
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from lexispark.fields import DOUBLE, KEY, FieldSpec, infer
from lexispark.operators.index import Analyzer, Index, Known, as_documents, build_postings, build_stats, point_type

FORMAT_VERSION = 1
POSTINGS = "field string, term string, doc_id bigint, tf int, dl int"
TERMS = "field string, term string, df bigint"
STATS = "field string, type string, len_sum bigint, doc_count bigint"
#: Quantiles of each table of points that the manifest keeps.
CUTS = 256
#: Segments of at most so many documents have one file of each table.
ONE_FILE = 1000
#: Ids of one call of ``delete`` up to this number become a filter of the scan.
FEW_IDS = 1000


class DuplicateKey(ValueError):
    """A key is null, repeated, or was ever in the index (deleted documents keep theirs)."""


class FormatTooOld(ValueError):
    """The index was written before format 1 and must be rebuilt."""


class MissingTable(RuntimeError):
    """The manifest names a table that isn't there, or that wasn't written to its end."""


class Conflict(RuntimeError):
    """Another writer made the next version; nothing of this call holds, and it may be tried again."""


@dataclass(frozen=True)
class _StoredIndex(Index):
    """An index whose points are read from their own tables, sorted by value, of which some quantiles are known."""

    point_tables: dict[str, DataFrame] = field(default_factory=dict)
    point_cuts: dict[str, list] = field(default_factory=dict)
    deleted: int = 0

    def points(self, name: str) -> DataFrame:
        return self.point_tables[name] if name in self.point_tables else super().points(name)

    def least_bound(self, name: str, lower: float, n: int) -> float | None:
        """A number at or below which at least ``n`` live points from ``lower`` on lie; None if none is known.

        Whole intervals between the quantiles of every segment are counted, less all deletes, so it is never too low.
        """
        if self.known is None or self.known.live is None:
            return None  # deletes that the index hasn't counted
        need = n + self.deleted
        for value, count in sorted((v, k) for cuts in self.point_cuts.get(name, []) for v, k, before in cuts if before is not None and before >= lower):
            need -= count
            if need <= 0:
                return value
        return None


class IndexStore:
    """Appending, deleting, compacting and opening one index folder."""

    def __init__(self, spark: SparkSession, path: str, analyzer: Analyzer = Analyzer()):
        self.spark, self.path, self.analyzer = spark, path.rstrip("/"), analyzer

    # The folder is reached through Hadoop's file systems, as the tables are.
    def _fs(self, at: str):
        p = self.spark._jvm.org.apache.hadoop.fs.Path(at)
        return p.getFileSystem(self.spark._jsc.hadoopConfiguration()), p

    def _exists(self, part: str) -> bool:
        fs, p = self._fs(f"{self.path}/{part}")
        return fs.exists(p)

    def _versions(self) -> list[int]:
        fs, p = self._fs(f"{self.path}/_manifest")
        names = [s.getPath().getName() for s in fs.listStatus(p)] if fs.exists(p) else []
        return sorted(int(n[:8]) for n in names if len(n) == 13 and n[:8].isdigit() and n.endswith(".json"))

    def manifest(self) -> dict:
        """The newest manifest that can be read; that of an empty index if there is none.

        ``next`` in it is the number that the version after it must take.
        """
        versions = self._versions()
        following = versions[-1] + 1 if versions else 1
        for v in reversed(versions):
            fs, p = self._fs(f"{self.path}/_manifest/{v:08d}.json")
            stream = fs.open(p)
            try:
                found = json.loads(self.spark._jvm.org.apache.commons.io.IOUtils.toString(stream, "UTF-8"))
            except ValueError:
                continue  # cut off by a crash of the file system itself: the version before it holds
            finally:
                stream.close()
            if (found.get("format_version") or 0) < 1:
                raise FormatTooOld("written before format 1: rebuild the index")
            return found | {"next": following}
        return {"format_version": FORMAT_VERSION, "created_ms": 0, "fields": [], "segments": [], "deletes": [], "streams": {}, "next": following}

    def _commit(self, manifest: dict) -> None:
        number = manifest["next"]
        text = json.dumps({k: v for k, v in manifest.items() if k != "next"} | {"created_ms": int(time.time() * 1000)})
        final, draft = f"{self.path}/_manifest/{number:08d}.json", f"{self.path}/_manifest/_draft-{uuid.uuid4().hex}"
        fs, p = self._fs(draft)
        out = fs.create(p, False)
        out.write(bytearray(text.encode()))
        out.close()
        try:
            self._publish(draft, final)
        finally:
            fs.delete(p, False)

    def _publish(self, draft: str, final: str) -> None:
        """Give a whole file its final name, unless that name is taken."""
        fs, p = self._fs(draft)
        if fs.getUri().getScheme() == "file":  # a rename would overwrite; a link doesn't
            local = lambda at: unquote(urlparse(at).path) if at.startswith("file:") else at
            try:
                os.link(local(draft), local(final))
            except FileExistsError:
                raise Conflict(final) from None
            return
        context = self.spark._jvm.org.apache.hadoop.fs.FileContext.getFileContext(fs.getUri(), self.spark._jsc.hadoopConfiguration())
        options = self.spark._sc._gateway.new_array(getattr(self.spark._jvm.org.apache.hadoop.fs, "Options$Rename"), 0)
        target = self._fs(final)[1]
        try:
            context.rename(p, target, options)
        except Exception:
            if fs.exists(target):
                raise Conflict(final) from None
            raise

    def _read(self, parts: list[str], schema: str | None) -> DataFrame:
        if not parts:
            return self.spark.createDataFrame([], schema)
        reader = self.spark.read if schema is None else self.spark.read.schema(schema)
        return reader.parquet(*[f"{self.path}/{p}" for p in parts])

    def append(self, df: DataFrame, key: str, specs: list[FieldSpec] | None = None, stream: str = "", batch: int | None = None) -> None:
        """Add documents as one segment. ``batch`` is a number within ``stream`` that never falls; a batch of that
        stream that is already in, or an earlier one, does nothing. Numbers of different streams have nothing to do with each other.

        ``df`` is evaluated once: what is checked is what is written.
        """
        manifest = self.manifest()
        if batch is not None and batch <= manifest["streams"].get(stream, -1):
            return
        specs = tuple(specs if specs is not None else infer(df.schema, key))
        name = f"segment-{uuid.uuid4().hex}"
        used = [s.name for s in specs if s.type != KEY]
        as_documents(df, key).select("doc_id", *used).write.parquet(f"{self.path}/{name}/documents")
        documents = self._read([f"{name}/documents"], None)
        try:
            ids = documents.groupBy("doc_id").agg(F.count("*").alias("n"))
            least, most, docs, bad = ids.agg(F.min("doc_id"), F.max("doc_id"), F.sum("n"), F.max_by(F.struct("doc_id", "n"), F.when(F.col("doc_id").isNull(), F.lit(1 << 62)).otherwise(F.col("n")))).first()
            if bad is not None and (bad.n > 1 or bad.doc_id is None):
                raise DuplicateKey(f"key {bad.doc_id} comes {bad.n} times")
            touched = [s["name"] for s in manifest["segments"] if docs and s["docs"] and s["least"] <= most and s["most"] >= least]
            if touched:
                taken = self._read([f"{s}/stored" for s in touched], "doc_id bigint").where(F.col("doc_id").between(least, most))
                if clash := documents.select("doc_id").join(taken, "doc_id", "left_semi").first():
                    raise DuplicateKey(f"key {clash.doc_id} is taken")
            kept = [s.name for s in specs if s.type != KEY and (s.stored or s.type == DOUBLE)]
            stats = {r.field: [r.type, r.len_sum, r.doc_count] for r in build_stats(documents, specs).collect()}  # a row for each field
            segment = self._write(name, docs or 0, documents.select("doc_id", *kept), build_postings(documents, specs, self.analyzer), stats, specs)
        except Exception:
            self._remove(name)
            raise
        self._remove(f"{name}/documents")
        known = {f["name"]: f for f in manifest["fields"]}  # the first writer of a field fixes its type
        manifest["fields"] = list(({s.name: asdict(s) for s in specs} | known).values())
        manifest["segments"].append(segment | {"least": least, "most": most})
        if batch is not None:
            manifest["streams"][stream] = batch
        self._commit(manifest)

    def _remove(self, part: str) -> None:
        fs, p = self._fs(f"{self.path}/{part}")
        fs.delete(p, True)

    def _write(self, segment: str, docs: int, stored: DataFrame, postings: DataFrame, stats: dict, specs: tuple[FieldSpec, ...]) -> dict:
        """The tables of one segment and, for the manifest, what they are."""
        base = f"{self.path}/{segment}"

        def sort(df: DataFrame, *keys: str) -> DataFrame:
            # A small segment is one file of each table, which needs no sample of its keys.
            return (df.repartition(1) if docs <= ONE_FILE else df.repartitionByRange(*keys)).sortWithinPartitions(*keys)

        def write_postings() -> None:
            # The range has doc_id in it, so the postings of a hot term are cut into several files.
            sort(postings, "field", "term", "doc_id").write.partitionBy("field").parquet(f"{base}/postings")
            counted = self._read([f"{segment}/postings"], POSTINGS).groupBy("field", "term").agg(F.count("*").alias("df"))
            sort(counted, "field", "term").write.partitionBy("field").parquet(f"{base}/terms")

        def write_points(name: str, kind: str) -> dict:
            rows = stored.select(F.col(name).cast(kind).alias("value"), "doc_id").where("value IS NOT NULL")
            sort(rows, "value", "doc_id").write.parquet(f"{base}/points-{name}")
            return {"type": kind, "cuts": self._cuts(f"{segment}/points-{name}", kind) if docs > ONE_FILE else []}

        numeric = {s.name: point_type(stored.schema[s.name].dataType) for s in specs if s.type == DOUBLE and s.tokenized}
        thread = inheritable_thread_target(self.spark)
        with ThreadPoolExecutor(4) as pool:  # tables that don't wait for one another
            jobs = [pool.submit(thread(lambda: sort(stored, "doc_id").write.parquet(f"{base}/stored"))), pool.submit(thread(write_postings))]
            point_jobs = {name: pool.submit(thread(write_points), name, kind) for name, kind in numeric.items()}
            for job in jobs:
                job.result()
            points = {name: job.result() for name, job in point_jobs.items()}
        return {"name": segment, "docs": docs, "stats": stats, "points": points}

    def _cuts(self, part: str, kind: str) -> list[tuple[float, int, float | None]]:
        """(value, points of the interval that ends there, where that interval begins) at the quantiles of a table of points.

        Numbers that a double doesn't hold exactly, and NaN, have none.
        """
        if kind != "double":
            return []
        rows = self._read([part], f"value {kind}, doc_id bigint").where(~F.isnan("value"))
        at = rows.agg(F.percentile_approx("value", F.lit([i / CUTS for i in range(1, CUTS + 1)]), F.lit(CUTS * 100))).first()[0]
        at = sorted({v for v in at or [] if math.isfinite(v)})
        if not at:
            return []
        place = F.size(F.filter(F.lit(at), lambda c: c < F.col("value")))
        counts = {r.k: r.n for r in rows.groupBy(place.alias("k")).agg(F.count("*").alias("n")).collect()}  # CUTS + 1 rows at most
        # The first interval has no known beginning, so no range can be sure to hold all of it.
        return [(v, counts.get(i, 0), at[i - 1] if i else None) for i, v in enumerate(at)]

    def open(self) -> Index:
        """The newest version of the index, every segment of it. Raises if there is none."""
        manifest = self.manifest()
        if not manifest["segments"]:
            raise FileNotFoundError(f"no index at {self.path}")
        return self._open(manifest)

    def _open(self, manifest: dict) -> Index:
        specs = tuple(FieldSpec(**f) for f in manifest["fields"])
        segments = manifest["segments"]
        names = [s["name"] for s in segments]
        stored = _union([self._read([f"{s}/stored"], None) for s in names])  # segments may differ in columns
        postings = _union([self._read([f"{s}/postings"], POSTINGS) for s in names])
        terms = _union([self._read([f"{s}/terms"], TERMS) for s in names])
        stats = _sum_stats([s["stats"] for s in segments], {s.name: s.type for s in specs})
        table = pa.table([list(c) for c in zip(*[(f, *v) for f, v in stats.items()])] or [[]] * 4, schema=pa.schema([("field", pa.string()), ("type", pa.string()), ("len_sum", pa.int64()), ("doc_count", pa.int64())]))
        deletes = self._read([d["name"] for d in manifest["deletes"]], "doc_id bigint")
        deleted = sum(d["docs"] for d in manifest["deletes"])
        known = Known(sum(s["docs"] for s in segments) - deleted, {f: (v[1], v[2]) for f, v in stats.items()})
        tables, cuts = {}, {}
        for s in specs:
            have = [(x["name"], x["points"][s.name]) for x in segments if s.name in x["points"]]
            if have:
                kinds = {p["type"] for _, p in have}
                parts = [self._read([f"{n}/points-{s.name}"], f"value {p['type']}, doc_id bigint") for n, p in have]
                if len(kinds) > 1:
                    parts = [p.select(F.col("value").cast("double").alias("value"), "doc_id") for p in parts]
                tables[s.name] = _union(parts).select("doc_id", "value")
                cuts[s.name] = [p["cuts"] for _, p in have]
        return _StoredIndex(stored, postings, self.spark.createDataFrame(table, STATS), deletes, specs, self.analyzer, bool(manifest["deletes"]), terms, known, tables, cuts, deleted)

    def verify(self, manifest: dict | None = None) -> None:
        """Raise ``MissingTable`` unless every table that the manifest names is there, written to its end."""
        manifest = manifest or self.manifest()
        parts = [f"{s['name']}/{t}" for s in manifest["segments"] for t in ("stored", "postings", "terms", *(f"points-{p}" for p in s["points"]))]
        for part in [*parts, *(d["name"] for d in manifest["deletes"])]:
            if not self._exists(f"{part}/_SUCCESS"):
                raise MissingTable(f"{self.path}/{part}")

    def delete(self, ids: list[int]) -> list[bool]:
        """Delete documents softly: for each id whether it was there and alive."""
        ids = [int(i) for i in ids]
        manifest = self.manifest()
        alive: set[int] = set()
        if manifest["segments"] and ids:
            index = self._open(manifest)
            stored = index.stored.select("doc_id")
            if len(ids) <= FEW_IDS:
                found = stored.where(F.col("doc_id").isin(*set(ids)))
            else:
                found = stored.join(self.spark.createDataFrame(pa.table({"doc_id": pa.array(set(ids), pa.int64())})), "doc_id", "left_semi")
            alive = {r.doc_id for r in index.live(found).collect()}  # not more than the caller's list
        if alive:
            self._add_deletes(self.spark.createDataFrame(pa.table({"doc_id": pa.array(sorted(alive), pa.int64())})), manifest)
        out = []
        for i in ids:
            out.append(i in alive)
            alive.discard(i)
        return out

    def delete_all(self, ids: DataFrame) -> None:
        """Delete many documents; unknown and deleted ones are left out."""
        manifest = self.manifest()
        index = self._open(manifest)
        self._add_deletes(index.live(index.stored.select("doc_id").join(ids.select("doc_id").distinct(), "doc_id", "left_semi")), manifest)

    def _add_deletes(self, alive: DataFrame, manifest: dict) -> None:
        name = f"deletes-{uuid.uuid4().hex}"
        alive.write.parquet(f"{self.path}/{name}")
        manifest["deletes"].append({"name": name, "docs": self._read([name], "doc_id bigint").count()})
        self._commit(manifest)

    def merge(self, names: list[str] | None = None) -> None:
        """Rewrite segments (all without ``names``) as one, and all deletes as one table.

        Deleted documents stay, as their keys and document frequencies count on. Every table must be there (``verify``).
        """
        manifest = self.manifest()
        self.verify(manifest)
        chosen = [s for s in manifest["segments"] if names is None or s["name"] in names]
        if len(chosen) < 2:
            return
        index = self._open(manifest | {"segments": chosen})
        stats = _sum_stats([s["stats"] for s in chosen], {s.name: s.type for s in index.specs})
        have = tuple(s for s in index.specs if s.name in index.stored.columns)
        segment = self._write(f"segment-{uuid.uuid4().hex}", sum(s["docs"] for s in chosen), index.stored, index.postings, stats, have)
        full = [s for s in chosen if s["docs"]]
        segment |= {"least": min((s["least"] for s in full), default=None), "most": max((s["most"] for s in full), default=None)}
        manifest["segments"] = [segment, *(s for s in manifest["segments"] if s not in chosen)]
        if len(manifest["deletes"]) > 1:
            self._read([d["name"] for d in manifest["deletes"]], "doc_id bigint").write.parquet(f"{self.path}/{(name := f'deletes-{uuid.uuid4().hex}')}")
            manifest["deletes"] = [{"name": name, "docs": sum(d["docs"] for d in manifest["deletes"])}]
        self._commit(manifest)

    def compact(self, fan: int = 8) -> None:
        """Merge segments of like size while there are ``fan`` of them.

        Sizes alike have the same whole logarithm to the base ``fan``, so a document is rewritten once for each
        power of ``fan`` that the index grows by, not at every merge.
        """
        while True:
            tiers: dict[int, list[str]] = {}
            for s in self.manifest()["segments"]:
                tiers.setdefault(math.floor(math.log(max(1, s["docs"]), fan) + 1e-9), []).append(s["name"])
            full = [tiers[t] for t in sorted(tiers) if len(tiers[t]) >= fan]
            if not full:
                return
            self.merge(full[0])

    def vacuum(self) -> None:
        """Remove what the newest version does not name; only when no reader or writer is at work."""
        manifest = self.manifest()
        keep = {*(s["name"] for s in manifest["segments"]), *(d["name"] for d in manifest["deletes"]), "_manifest"}
        fs, p = self._fs(self.path)
        for s in fs.listStatus(p):
            if s.getPath().getName() not in keep:
                fs.delete(s.getPath(), True)
        for v in self._versions():
            if v < manifest["next"] - 1:
                self._remove(f"_manifest/{v:08d}.json")

    def wipe(self) -> None:
        """Remove the whole folder."""
        fs, p = self._fs(self.path)
        fs.delete(p, True)

    def segment_info(self) -> DataFrame:
        """One row: created_ms, segments, pre_max_id (highest id), format_version."""
        manifest = self.manifest()
        most = max((s["most"] for s in manifest["segments"] if s["docs"]), default=None)
        return self.spark.range(1).select(
            F.lit(manifest["created_ms"]).alias("created_ms"), F.lit(len(manifest["segments"])).alias("segments"), F.lit(most).cast("bigint").alias("pre_max_id"), F.lit(manifest["format_version"]).alias("format_version")
        )


def _union(parts: list[DataFrame]) -> DataFrame:
    out = parts[0]
    for p in parts[1:]:
        out = out.unionByName(p, allowMissingColumns=True)
    return out


def _sum_stats(parts: list[dict], types: dict[str, str]) -> dict[str, list]:
    """Statistics of several segments by field: [type, len_sum, doc_count]."""
    out: dict[str, list] = {}
    for part in parts:
        for field, (kind, length, count) in part.items():
            have = out.setdefault(field, [types.get(field, kind), 0, 0])
            have[1] += length
            have[2] += count
    return out


def merge_stats(*parts: DataFrame) -> DataFrame:
    """Field statistics of several segments as one: sums by field, the type of the first."""
    tagged = _union([p.withColumn("_at", F.lit(i)) for i, p in enumerate(parts)])
    return tagged.groupBy("field").agg(F.min_by("type", "_at").alias("type"), F.sum("len_sum").alias("len_sum"), F.sum("doc_count").alias("doc_count"))


def merge_indexes(a: Index, b: Index) -> Index:
    """Two indexes as one, lazily: postings and stored rows side by side, statistics summed."""
    both = {s.name: s for s in (*b.specs, *a.specs)}
    return replace(
        a,
        stored=a.stored.unionByName(b.stored, allowMissingColumns=True),
        postings=a.postings.unionByName(b.postings),
        stats=merge_stats(a.stats, b.stats),
        deletes=a.deletes.unionByName(b.deletes),
        specs=tuple(both.values()),
        any_deletes=a.any_deletes or b.any_deletes,
        terms=None,
        known=None,
    )
