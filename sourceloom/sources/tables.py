"""Columnar tables in and out."""
from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import types as T


def read_table(spark: SparkSession, path: str, key: str | None = None, schema: T.StructType | None = None) -> DataFrame:
    """Parquet table.  ``key`` spreads an input that has fewer splits than the cluster has cores.

    One small file with a single row group would otherwise keep all text work on one core.  Large
    inputs have more splits than cores and are never shuffled here.
    """
    reader = spark.read.schema(schema) if schema else spark.read
    df = reader.parquet(path)
    cores = spark.sparkContext.defaultParallelism
    if key and df.rdd.getNumPartitions() < cores:
        return df.repartition(cores, key)
    return df


def read_records(spark: SparkSession, path: str, schema: T.StructType) -> DataFrame:
    """JSON lines checked against a schema; a malformed record fails the read."""
    return spark.read.schema(schema).option("mode", "FAILFAST").json(path)
