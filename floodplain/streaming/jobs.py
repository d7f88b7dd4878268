"""The streaming jobs: rollups, snapshots, detection, correlation, message limits.

Each job is one query with its own checkpoint; stored tables between jobs are the
restart boundaries. Every sink writes by batch id, so that a batch repeated after
a lost executor or driver replaces itself.
"""

from __future__ import annotations

import os

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql.streaming import StreamingQuery

from ..operators import classify, detect, incidents, normalize, notify, rollup, snapshots
from ..operators.case import CasePolicy
from ..operators.evaluate import evaluate
from ..operators.policy import select_policy
from ..sources import tables
from .state import BucketAdapter, CaseAdapter, DeliveryAdapter, DetectAdapter, RepeatAdapter, keyed_fold


def _start(df: DataFrame, write, checkpoint: str, mode: str = "append", available_now: bool = True) -> StreamingQuery:
    writer = df.writeStream.outputMode(mode).option("checkpointLocation", checkpoint).foreachBatch(write)
    return (writer.trigger(availableNow=True) if available_now else writer).start()


def classified_flows(flows: DataFrame, prefixes: DataFrame, exporter_rates: DataFrame | None = None, global_default: int | None = None) -> DataFrame:
    return classify.classify(normalize.normalize(flows, exporter_rates, global_default), prefixes)


def stream_rollups(classified: DataFrame, seconds: int, path: str, checkpoint: str, lengths4=(), lengths6=(), available_now: bool = True) -> StreamingQuery:
    """All rollup tables from one stream, one stateful aggregation."""
    wide = rollup.rollup_all(classified, seconds, lengths4, lengths6)
    return _start(wide, lambda df, n: tables.write_rollups(df, path, n), checkpoint, available_now=available_now)


def stream_snapshots(classified: DataFrame, window_ms: int, path: str, checkpoint: str, available_now: bool = True, exporters: str = "exact") -> StreamingQuery:
    """Finished detection windows. Exporters are counted exactly, by one more row of state for each exporter of
    a scope; ``exporters="sketch"`` keeps one row a scope and counts at most 64.
    """
    snaps = snapshots.snapshots(classified, window_ms, exporters=exporters)
    return _start(snaps, lambda df, n: tables.write_batch(df, path, n), checkpoint, available_now=available_now)


def detection_log(snaps: DataFrame, policies: DataFrame, stale_after_ms: int = detect.STALE_AFTER_MS, watermark: str = "1 minute",
                  resets: DataFrame | None = None) -> DataFrame:
    """The detection log of a stream of snapshots and, if given, one of commands as ``detect`` takes them.

    Both inputs are one stream of rows with one watermark: a row waits until the
    newest row of either is ``watermark`` further on, and is applied in the order of
    time. So ``watermark`` must cover how far one input may lag behind the other; what comes later
    than that is dropped.
    """
    rows = detect.fold_rows(evaluate(select_policy(snaps, policies), policies), keep=[F.col("window_end").alias("event_time")])
    if resets is not None:
        commands = detect.reset_rows(resets, keep=[F.col("at").cast("timestamp").alias("event_time")])
        rows = rows.unionByName(commands, allowMissingColumns=True)
    return keyed_fold(rows.withWatermark("event_time", watermark), ["scope_key"], DetectAdapter(stale_after_ms), f"scope_key STRING, {detect.LOG_COLUMNS}")


def stream_detection(snaps: DataFrame, policies: DataFrame, path: str, checkpoint: str, stale_after_ms: int = detect.STALE_AFTER_MS,
                     watermark: str = "1 minute", available_now: bool = True, resets: DataFrame | None = None) -> StreamingQuery:
    """Events under ``path/events`` and transitions under ``path/transitions``."""
    def write(df: DataFrame, n: int) -> None:
        df.persist()  # two sinks, one fold
        tables.write_batch(detect.detection_events(df), os.path.join(path, "events"), n)
        tables.write_batch(df.where("record <> 'event'").drop("payload", "peak"), os.path.join(path, "transitions"), n)
        df.unpersist()

    return _start(detection_log(snaps, policies, stale_after_ms, watermark, resets), write, checkpoint, available_now=available_now)


def correlation_log(events: DataFrame, policy: CasePolicy = CasePolicy(), watermark: str = "10 minutes", commands: DataFrame | None = None) -> DataFrame:
    """The incident log of a stream of detection events and, if given, one of operator commands.

    Each event key and each command is applied once. As in ``detection_log`` rows
    of both inputs are applied in the order of time behind one watermark.
    """
    forged = (F.col("schema_version") > detect.EVENT_SCHEMA_VERSION) | F.col("executed") | (F.col("action") == "observed")
    rows = incidents.case_rows(events.where(~forged).withColumn("gate", F.lit(None).cast("string")), keep=["dedup_key", F.col("observed_at").alias("event_time")])
    if commands is not None:
        rows = rows.unionByName(incidents.command_rows(commands, keep=[F.col("command_id").alias("dedup_key"), F.col("at").cast("timestamp").alias("event_time")]))
    once = rows.withWatermark("event_time", watermark).dropDuplicatesWithinWatermark(["tenant", "is_event", "dedup_key"])
    schema = "correlation_key STRING, record STRING, t BIGINT, n BIGINT, incident_id STRING, ref STRING, body STRING"
    return keyed_fold(once, ["correlation_key"], CaseAdapter(policy), schema)


def stopped_events(events: DataFrame) -> DataFrame:
    """Events of a stream that correlation leaves out, and why: ``(event_id, tenant, observed_at, gate)``."""
    quarantined = (F.col("schema_version") > detect.EVENT_SCHEMA_VERSION) | F.col("executed")
    gate = F.when(quarantined, "quarantined").when(F.col("action") == "observed", "observeOnly")
    return events.select("event_id", "tenant", "observed_at", gate.alias("gate")).where("gate IS NOT NULL")


def stream_correlation(events: DataFrame, path: str, checkpoint: str, policy: CasePolicy = CasePolicy(), watermark: str = "10 minutes",
                       available_now: bool = True, commands: DataFrame | None = None) -> StreamingQuery:
    """The incident log, by batch; ``current_incidents`` reads the newest versions."""
    return _start(correlation_log(events, policy, watermark, commands), lambda df, n: tables.write_batch(df, path, n), checkpoint, available_now=available_now)


def current_incidents(spark: SparkSession, path: str) -> DataFrame:
    """The latest version of each incident in a streamed log."""
    log = spark.read.parquet(path).where("record = 'incident'")
    newest = log.groupBy("correlation_key", "incident_id").agg(F.max_by("body", F.struct("t", "n")).alias("body"))
    return incidents.incidents_of(newest.withColumn("record", F.lit("incident")))


def message_rows(messages: DataFrame, watermark: str) -> DataFrame:
    return messages.withWatermark("at", watermark).select(
        "message_id", "channel", "incident_id", "event_type", F.unix_micros("at").alias("t"), "at")


def kept_messages(messages: DataFrame, window_seconds: int = notify.DEDUP_SECONDS, watermark: str = "1 minute") -> DataFrame:
    """``kept`` for a stream of messages: false for repeats within the window."""
    keys = ["channel", "incident_id", "event_type"]
    types = dict(messages.dtypes)
    schema = ", ".join(f"{c} {types[c]}" for c in keys) + f", t BIGINT, message_id {types['message_id']}, kept BOOLEAN"
    return keyed_fold(message_rows(messages, watermark), keys, RepeatAdapter(window_seconds * 1_000_000), schema)


def limited_messages(messages: DataFrame, per_minute: int = notify.PER_MINUTE, watermark: str = "1 minute") -> DataFrame:
    """``sent`` for a stream of messages: false where the channel's bucket was empty."""
    schema = f"channel STRING, t BIGINT, message_id {dict(messages.dtypes)['message_id']}, sent BOOLEAN"
    return keyed_fold(message_rows(messages, watermark), ["channel"], BucketAdapter(per_minute), schema)


def delivered_messages(messages: DataFrame, window_seconds: int = notify.DEDUP_SECONDS, per_minute: int = notify.PER_MINUTE, watermark: str = "1 minute") -> DataFrame:
    """``outcome`` for a stream of messages, both rules together as in ``deliverable``: what the limit drops blocks no repeat."""
    schema = f"channel STRING, t BIGINT, message_id {dict(messages.dtypes)['message_id']}, outcome STRING"
    return keyed_fold(message_rows(messages, watermark), ["channel"], DeliveryAdapter(window_seconds * 1_000_000, per_minute), schema)


def stream_table(df: DataFrame, path: str, checkpoint: str, available_now: bool = True) -> StreamingQuery:
    """Any of these streams into a table, by batch."""
    return _start(df, lambda batch, n: tables.write_batch(batch, path, n), checkpoint, available_now=available_now)
