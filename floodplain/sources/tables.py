"""Stored tables: daily partitions, sorted inside, written once per batch."""

from __future__ import annotations

import os

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from ..operators.rollup import dimension_of


def _write(df: DataFrame, path: str, partitions: list[str], order: list[str], mode: str) -> None:
    """Rows gathered by partition; big partitions are split and small ones merged at run time."""
    arranged = df.hint("rebalance", *[F.col(c) for c in partitions]).sortWithinPartitions(*partitions, *order)
    arranged.write.mode(mode).option("partitionOverwriteMode", "dynamic").partitionBy(*partitions).parquet(path)


def with_day(df: DataFrame, time: str) -> DataFrame:
    return df.withColumn("date", F.to_date(time))


def write_rollup(rollup: DataFrame, path: str, dimension: str, mode: str = "append") -> None:
    """One dimension as its own table."""
    keys = [c for c in rollup.columns if c in ("family", "address", "prefix_len", "hostgroup", "asn", "exporter", "interface_index", "direction", "protocol")]
    _write(with_day(rollup, "window_start"), os.path.join(path, dimension), ["date"], ["window_start", *keys], mode)


def read_rollup(spark: SparkSession, path: str, dimension: str) -> DataFrame:
    return spark.read.parquet(os.path.join(path, dimension))


def write_rollups(wide: DataFrame, path: str, batch_id: int | None = None) -> None:
    """All dimensions of ``rollup_all`` in one job, one partition per dimension and day.

    With a batch id a repeated batch replaces its own rows.
    """
    df, partitions = with_day(wide, "window_start"), ["dimension", "date"]
    if batch_id is not None:
        df, partitions = df.withColumn("batch_id", F.lit(batch_id)), [*partitions, "batch_id"]
    _write(df, path, partitions, ["window_start", "family", "hi", "lo"], "append" if batch_id is None else "overwrite")


def read_rollups(spark: SparkSession, path: str, dimension: str) -> DataFrame:
    """One dimension of the combined table; other dimensions are not read."""
    return dimension_of(spark.read.parquet(path), dimension, keep=["date"])


def write_detection_events(flat: DataFrame, path: str, batch_id: int | None = None) -> None:
    """The flattened events, by day of observation."""
    df, partitions = with_day(flat, "timestamp"), ["date"]
    if batch_id is not None:
        df, partitions = df.withColumn("batch_id", F.lit(batch_id)), ["date", "batch_id"]
    _write(df, path, partitions, ["timestamp", "tenant", "policy_id", "detection_id"], "append" if batch_id is None else "overwrite")


def write_batch(df: DataFrame, path: str, batch_id: int) -> None:
    """Any stream's batch under its id, so that a repeated batch replaces itself."""
    df.withColumn("batch_id", F.lit(batch_id)).write.mode("overwrite").option("partitionOverwriteMode", "dynamic").partitionBy("batch_id").parquet(path)
