"""Continuous operation: the polling loop as a streaming query over arriving inventory snapshots."""
from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql.streaming import StreamingQuery

SNAPSHOT = "file_id string, raw_hash string, name string, path string, unit string, source_uri string, method string, text string"


def watch_documents(spark: SparkSession, folder: str, schema: str = SNAPSHOT) -> DataFrame:
    """Document snapshots dropped as Parquet files into a shared folder."""
    return spark.readStream.schema(schema).parquet(folder)


def run_continuously(snapshots: DataFrame, process: Callable[[DataFrame, int], None], checkpoint: str,
                     interval: str | None = "300 seconds") -> StreamingQuery:
    """Hand every arriving snapshot to one incremental pass.

    ``process`` is idempotent per content hash, so a batch replayed after a failure changes nothing.
    Without an interval the query drains what is there and stops.
    """
    writer = snapshots.writeStream.option("checkpointLocation", checkpoint).foreachBatch(process)
    writer = writer.trigger(processingTime=interval) if interval else writer.trigger(availableNow=True)
    return writer.start()
