"""Session defaults and the shared folder used to cut lineage.

Sizes are left to AQE: the shuffle starts wide and is coalesced at run time, so the same
settings serve a laptop and a large cluster.  Everything here can be overridden by the
cluster's own configuration because ``getOrCreate`` keeps values that are already set.
"""
from __future__ import annotations

import os
import tempfile
import uuid

from pyspark.sql import DataFrame, SparkSession

# Runtime settings that make the plans in this package correct or skew-safe.
RUNTIME_SETTINGS = {
    "spark.sql.session.timeZone": "UTC",
    "spark.sql.adaptive.enabled": "true",
    "spark.sql.adaptive.coalescePartitions.enabled": "true",
    # expressions are heavy per row: keep small shuffles spread over the cores
    "spark.sql.adaptive.coalescePartitions.minPartitionSize": "64k",
    "spark.sql.adaptive.skewJoin.enabled": "true",
    "spark.sql.adaptive.forceOptimizeSkewedJoin": "true",
    "spark.sql.execution.arrow.pyspark.enabled": "true",
    "spark.sql.maxPlanStringLength": "100000",
}


# Capturing a Python call site per column call makes large expressions slow to build.
QUIET = {"spark.python.sql.dataFrameDebugging.enabled": "false"}


def build_session(app_name: str = "sourceloom", master: str | None = None,
                  extra: dict[str, str] | None = None) -> SparkSession:
    builder = SparkSession.builder.appName(app_name)
    if master:
        builder = builder.master(master)
    for key, value in {**RUNTIME_SETTINGS, **QUIET, **(extra or {})}.items():
        builder = builder.config(key, value)
    return tune(builder.getOrCreate())


def tune(spark: SparkSession) -> SparkSession:
    """Apply the runtime settings to a session somebody else created."""
    for key, value in {**RUNTIME_SETTINGS, **QUIET}.items():
        try:
            spark.conf.set(key, value)
        except Exception:  # noqa: BLE001 - fixed when the session was created; a speed setting only
            if key not in QUIET:
                raise
    return spark


def shared_folder(spark: SparkSession, name: str) -> str:
    """A new folder below the one the cluster names in ``spark.checkpoint.dir``.

    Only when no folder is configured (unit tests on one machine) is one created here.
    """
    context = spark.sparkContext
    configured = context.getConf().get("spark.checkpoint.dir") or context.getCheckpointDir()
    if not configured:
        if not context.master.startswith("local"):
            raise RuntimeError("set spark.checkpoint.dir to a folder every executor can reach")
        context.setCheckpointDir(os.path.join(tempfile.mkdtemp(prefix="sourceloom-"), "checkpoints"))
    elif not context.getCheckpointDir():
        context.setCheckpointDir(configured)
    return f"{context.getCheckpointDir().rstrip('/')}/{name}-{uuid.uuid4().hex}"


def cut_lineage(df: DataFrame) -> DataFrame:
    """The rows, stored in a shared folder and read back."""
    # a written table runs the plan once (an eager checkpoint runs it twice) and is columnar
    path = shared_folder(df.sparkSession, "cut")
    df.write.parquet(path)
    return df.sparkSession.read.schema(df.schema).parquet(path)
