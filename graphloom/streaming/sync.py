"""Structured Streaming variants: changed chunks flow into the vector store, changes into the incremental log."""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql.streaming import StreamingQuery

from graphloom.operators import incremental
from graphloom.sources.stores import VectorStore


def sync_vectors(chunks: DataFrame, store: VectorStore, embed: Callable[[DataFrame], DataFrame], checkpoint: str) -> StreamingQuery:
    """Each micro-batch of chunks (streaming) is embedded and upserted; running a batch again changes nothing."""

    def write(batch: DataFrame, _: int) -> None:
        if batch.limit(1).count():
            store.upsert(embed(batch))

    return chunks.writeStream.foreachBatch(write).option("checkpointLocation", checkpoint).trigger(availableNow=True).start()


def sync_changes(spark: SparkSession, path: str, schema: str, log: incremental.CommitLog, checkpoint: str) -> StreamingQuery:
    """Each micro-batch of new change files is one incremental run over its own rows; the commit log decides which of them are new."""
    stream = spark.readStream.schema(schema).parquet(path)

    def write(batch: DataFrame, _: int) -> None:
        if batch.limit(1).count():
            incremental.incremental_run(batch, log)

    return stream.writeStream.foreachBatch(write).option("checkpointLocation", checkpoint).trigger(availableNow=True).start()
