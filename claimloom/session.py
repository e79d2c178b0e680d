"""Session settings and the shared checkpoint folder."""

from __future__ import annotations

import gc
import tempfile
import uuid

from pyspark.sql import DataFrame, SparkSession

#: Share of its limit to which the driver's heap may grow before a step's garbage is collected.
SWEPT_SHARE = 0.35


def build(app: str = "claimloom", master: str | None = None, **conf: str) -> SparkSession:
    """A session with the settings every job here assumes."""
    builder = SparkSession.builder.appName(app)
    if master:
        builder = builder.master(master)
    settings = {
        "spark.sql.session.timeZone": "UTC",
        "spark.sql.adaptive.enabled": "true",
        "spark.sql.adaptive.skewJoin.enabled": "true",
        "spark.sql.adaptive.coalescePartitions.enabled": "true",
        "spark.cleaner.referenceTracking.cleanCheckpoints": "true",
        **conf,
    }
    for key, value in settings.items():
        builder = builder.config(key, value)
    return builder.getOrCreate()


def checkpoint_root(spark: SparkSession) -> str:
    """The cluster's shared checkpoint folder; a temporary one only in local mode and where none is named."""
    folder = spark.conf.get("spark.checkpoint.dir", None) or spark.sparkContext.getCheckpointDir()
    if not folder:
        if not spark.sparkContext.master.startswith(("local[", "local,")) and spark.sparkContext.master != "local":
            raise ValueError("name a folder that all executors share in spark.checkpoint.dir")
        folder = tempfile.mkdtemp(prefix="claimloom-")
    if spark.sparkContext.getCheckpointDir() is None:
        spark.sparkContext.setCheckpointDir(folder)
    return folder


def run_folder(spark: SparkSession, name: str) -> str:
    """A new path in the shared checkpoint folder."""
    return f"{checkpoint_root(spark).rstrip('/')}/{name}-{uuid.uuid4().hex}"


def cut_lineage(df: DataFrame) -> DataFrame:
    """Reliable checkpoint: a lost executor re-reads files instead of re-running the plan."""
    checkpoint_root(df.sparkSession)
    out = df.checkpoint(eager=True)
    swept(df.sparkSession)
    return out


def swept(spark: SparkSession) -> None:
    """Collect the driver's garbage where its heap has grown beyond SWEPT_SHARE of the most it may take.

    Jobs of many steps leave plans, task records and map statuses behind, several times what is in use;
    left alone, the heap grows to its limit, and shuffle files, broadcasts and checkpoints stay as long.
    """
    heap = spark.sparkContext._jvm.java.lang.Runtime.getRuntime()
    if heap.totalMemory() > SWEPT_SHARE * heap.maxMemory():
        gc.collect()  # frames in reference cycles hold plans
        spark.sparkContext._jvm.System.gc()
