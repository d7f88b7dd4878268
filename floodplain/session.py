"""Session settings in one place."""

from __future__ import annotations

import os
import tempfile

from pyspark.sql import SparkSession

ROCKSDB = "org.apache.spark.sql.execution.streaming.state.RocksDBStateStoreProvider"

# Runtime settings every job relies on. Shuffle partitions are left to the
# cluster: AQE coalesces them and splits skewed ones.
RUNTIME = {
    "spark.sql.session.timeZone": "UTC",
    "spark.sql.ansi.enabled": "true",
    "spark.sql.adaptive.enabled": "true",
    "spark.sql.adaptive.coalescePartitions.enabled": "true",
    "spark.sql.adaptive.skewJoin.enabled": "true",
    "spark.sql.execution.arrow.pyspark.enabled": "true",
    "spark.sql.streaming.stateStore.providerClass": ROCKSDB,
}


def configure(spark: SparkSession) -> SparkSession:
    """Apply the runtime settings to a session somebody else built."""
    for key, value in RUNTIME.items():
        spark.conf.set(key, value)
    return spark


def build(master: str | None = None, app: str = "floodplain", **extra: str) -> SparkSession:
    """A session for scripts and tests; on a cluster use ``configure``."""
    builder = SparkSession.builder.appName(app)
    if master:
        builder = builder.master(master)
    for key, value in {**RUNTIME, "spark.ui.enabled": "false", **extra}.items():
        builder = builder.config(key, value)
    return builder.getOrCreate()


def checkpoint_dir(spark: SparkSession) -> str:
    """The shared folder that ``spark.checkpoint.dir`` names; one of this machine only in local mode.

    A cluster without the setting is refused: its machines would not see each other's files.
    """
    configured = spark.conf.get("spark.checkpoint.dir", None)
    if configured:
        return configured
    if not spark.sparkContext.master.startswith("local[") and spark.sparkContext.master != "local":
        raise ValueError("spark.checkpoint.dir must name a folder that all machines share")
    spark.conf.set("spark.checkpoint.dir", tempfile.mkdtemp(prefix="floodplain-checkpoint-"))
    return spark.conf.get("spark.checkpoint.dir")


def cut_lineage(df):
    """Reliable checkpoint of ``df``, so that several readers share one computation."""
    spark = df.sparkSession
    context = spark.sparkContext
    if context.getCheckpointDir() is None:
        context.setCheckpointDir(checkpoint_dir(spark))
    return df.checkpoint(eager=True)


def shared_path(spark: SparkSession, name: str) -> str:
    return os.path.join(checkpoint_dir(spark), name)
