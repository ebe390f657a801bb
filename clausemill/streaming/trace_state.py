"""Trace updates as a stream: every micro-batch is appended once, and the view keeps the last value of each key."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql.streaming import StreamingQuery

from clausemill.operators import traces

UPDATES = "query_id string, seq long, node string, key string, value string"


def read_updates(spark: SparkSession, path: str) -> DataFrame:
    return spark.readStream.schema(UPDATES).json(path)


def persist(updates: DataFrame, log: str, checkpoint: str) -> StreamingQuery:
    """Append new updates to the log, one folder a batch: a batch that is run again after a failure overwrites its own folder."""

    def write(batch: DataFrame, number: int) -> None:
        batch.dropDuplicates(["query_id", "seq", "key"]).write.mode("overwrite").parquet(f"{log}/batch={number}")

    return updates.writeStream.foreachBatch(write).option("checkpointLocation", checkpoint).trigger(availableNow=True).start()


def view(spark: SparkSession, log: str) -> DataFrame:
    """The merged trace of each question, from the log."""
    return traces.merged(spark.read.parquet(log).drop("batch"))
