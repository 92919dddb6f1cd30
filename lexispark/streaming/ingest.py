"""Continuous indexing: each micro-batch of a stream becomes a segment, once."""

from __future__ import annotations

import json

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql.streaming import StreamingQuery

from lexispark.operators.store import IndexStore


def stream_id(spark: SparkSession, checkpoint: str) -> str:
    """The id that Spark gave a stream when it made its checkpoint: the same after a restart, another with a new checkpoint."""
    at = spark._jvm.org.apache.hadoop.fs.Path(f"{checkpoint.rstrip('/')}/metadata")
    stream = at.getFileSystem(spark._jsc.hadoopConfiguration()).open(at)
    try:
        return json.loads(spark._jvm.org.apache.commons.io.IOUtils.toString(stream, "UTF-8"))["id"]
    finally:
        stream.close()


def ingest(stream: DataFrame, store: IndexStore, key: str, checkpoint: str, merge_after: int = 8, **trigger) -> StreamingQuery:
    """Append a streaming DataFrame to ``store``.

    A batch that is replayed after a failure is known by the stream's id and its number and not added again; batches of
    other streams, or of the same source with a new checkpoint, are new. ``merge_after`` segments of like size are
    compacted into one. ``trigger`` is passed to ``DataStreamWriter.trigger``.
    """

    def add(batch: DataFrame, number: int) -> None:
        if batch.isEmpty():
            return
        store.append(batch, key, stream=stream_id(store.spark, checkpoint), batch=number)
        store.compact(merge_after)

    return stream.writeStream.foreachBatch(add).option("checkpointLocation", checkpoint).trigger(**(trigger or {"availableNow": True})).start()
