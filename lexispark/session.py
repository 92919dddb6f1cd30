"""What every operator needs of a session: tables by name, and a shared place to cut lineage."""

from __future__ import annotations

import uuid
from collections.abc import Callable, Iterator
from contextlib import contextmanager
from contextvars import ContextVar

from pyspark.sql import DataFrame, SparkSession


def table(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    """The Parquet table ``name`` of a data directory (one file or a folder of files)."""
    return spark.read.parquet(f"{sf_dir}/{name}.parquet")


def shared_dir(spark: SparkSession) -> str:
    """The folder named by ``spark.checkpoint.dir``, which every executor must reach.

    Only a session on one machine (master ``local``) may go without: its warehouse folder serves then.
    """
    named = spark.conf.get("spark.checkpoint.dir", None) or spark.sparkContext.getCheckpointDir()
    if not named:
        if not spark.sparkContext.master.startswith("local"):
            raise RuntimeError("set spark.checkpoint.dir to a folder that all executors share")
        named = f"{spark.conf.get('spark.sql.warehouse.dir').rstrip('/')}/lexispark"
    return named.rstrip("/")


def scratch(spark: SparkSession, tag: str) -> str:
    """A new path in the shared folder, under the folder of this application."""
    return f"{shared_dir(spark)}/lexispark-{spark.sparkContext.applicationId}/{tag}-{uuid.uuid4().hex}"


def materialize(df: DataFrame, tag: str) -> DataFrame:
    """Write ``df`` as a Parquet table in the shared folder and read it back.

    The result has no lineage beyond the files, which all executors can read, so that the loss of an
    executor never recomputes what lies before it.
    """
    path = scratch(df.sparkSession, tag)
    if (paths := _PATHS.get()) is None:
        df.write.parquet(path)
    else:
        paths.append(path)
        df.write.parquet(path, compression="zstd")
    out = df.sparkSession.read.schema(df.schema).parquet(path)
    out.scratch_path = path
    return out


def _delete(spark: SparkSession, path: str) -> None:
    at = spark._jvm.org.apache.hadoop.fs.Path(path)
    at.getFileSystem(spark._jsc.hadoopConfiguration()).delete(at, True)


def discard(table: DataFrame) -> None:
    """Remove the files of a table that ``materialize`` gave; nothing that reads it may be used after it."""
    _delete(table.sparkSession, table.scratch_path)


#: Paths of the tables that the innermost open ``temporary`` removes.
_PATHS: ContextVar[list[str] | None] = ContextVar("paths", default=None)
_CLEANUP = "spark.sql.classic.shuffleDependency.fileCleanup.enabled"


@contextmanager
def temporary(spark: SparkSession) -> Iterator[Callable[[DataFrame], DataFrame]]:
    """Within it, ``materialize`` writes tables that are removed at its end, but for those given to the function it yields; these
    pass to the ``temporary`` around it, if any. They are packed closer than others. Shuffle files are removed as soon as the query that wrote them ends, not when the
    driver happens to collect its garbage.
    """
    paths: list[str] = []
    token, before = _PATHS.set(paths), spark.conf.get(_CLEANUP, None)
    spark.conf.set(_CLEANUP, "true")

    def keep(table: DataFrame) -> DataFrame:
        paths.remove(table.scratch_path)
        if (outer := token.old_value) is not token.MISSING and outer is not None:
            outer.append(table.scratch_path)
        return table

    try:
        yield keep
    finally:
        _PATHS.reset(token)
        if before is None:
            spark.conf.unset(_CLEANUP)
        else:
            spark.conf.set(_CLEANUP, before)
        for path in paths:
            _delete(spark, path)


def remove_scratch(spark: SparkSession) -> None:
    """Remove everything that this application has put under ``scratch``; no result that reads it may be used after it."""
    _delete(spark, f"{shared_dir(spark)}/lexispark-{spark.sparkContext.applicationId}")
