"""Comparing snapshots with the winning policy: one row in, one row out."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from ..functions.rates import clear_threshold, ratio_percent
from ..functions.vocab import COMPLETENESS_FLAGS, METRIC_ORDER, METRICS
from .joins import is_small, lookup_join
from .slices import before, by_time

#: How much time of a scope one task looks at.
SLICE_MS = 3_600_000

SEEN = {"protocol": "protocol_seen", "tcpFlags": "tcp_flags_seen", "fragmentation": "fragmentation_seen",
        "forwardingStatus": "forwarding_status_seen"}

POLICY_FACTS = ["policy_name", "labels", "severity", "mode", "policy_window_ms", "trigger_for_ms", "clear_for_ms",
                "cooldown_ms", "hold_down_ms", "event_update_ms"]


def compiled(policies: DataFrame, also: tuple[str, ...] = ()) -> DataFrame:
    """Thresholds as an array in metric order, each with its clear level and needed flag.

    Done once per policy, so that rows only index arrays.
    """
    entries = [
        F.when(F.col("thresholds")[metric].isNotNull(), F.struct(
            F.lit(i).alias("at"), F.lit(metric).alias("metric"), F.col("thresholds")[metric].alias("threshold"),
            clear_threshold(F.col("thresholds")[metric], F.col("clear_percent")).alias("clear"),
            F.lit(COMPLETENESS_FLAGS.index(METRICS[metric][1]) if METRICS[metric][1] else -1).alias("needs")))
        for i, metric in enumerate(METRIC_ORDER)
    ]
    return policies.select(
        "policy_id", F.col("version").alias("policy_version"), F.col("name").alias("policy_name"), "labels", "severity", "mode",
        F.col("window_ms").alias("policy_window_ms"), "trigger_for_ms", "clear_for_ms", "cooldown_ms", "hold_down_ms",
        "event_update_ms", F.array_compact(F.array(*entries)).alias("_rules"), *also,
    )


def matched_reasons(usable: Column, observed) -> Column:
    crossed = F.filter(usable, lambda r: observed(r) >= r["threshold"])
    return F.transform(crossed, lambda r: F.struct(
        r["metric"].alias("metric"), observed(r).alias("observed"), r["threshold"].alias("threshold"),
        (observed(r) - r["threshold"]).alias("excess"), ratio_percent(observed(r), r["threshold"]).alias("ratio_percent")))


def evaluate(selected: DataFrame, policies: DataFrame, also: tuple[str, ...] = ()) -> DataFrame:
    """Add matched, skipped, all_below_clear and the policy's facts.

    ``selected`` is snapshots with the winner's id and version; rows without a
    winner drop out, and so do windows that are not the policy's. ``also`` names
    further columns that tell policies of one id and version apart.
    """
    table = compiled(policies, also)
    df = lookup_join(selected.where("policy_id IS NOT NULL"), table, ["policy_id", "policy_version", *also], "inner",
                     small=is_small(policies, 50_000))
    df = df.where(F.col("window_ms") == F.col("policy_window_ms"))
    df = df.withColumn("_rates", F.array(*METRIC_ORDER)).withColumn("_seen", F.array(*[F.col(SEEN[f]) for f in COMPLETENESS_FLAGS]))
    observed = lambda r: F.get("_rates", r["at"])
    known = lambda r: (r["needs"] < 0) | F.get("_seen", F.greatest(r["needs"], F.lit(0)))
    df = df.withColumn("_usable", F.filter("_rules", known)).withColumn("_unusable", F.filter("_rules", lambda r: ~known(r)))
    skipped = F.transform("_unusable", lambda r: F.struct(r["metric"].alias("metric"), F.lit("sourceFieldAbsent").alias("reason")))
    below = (F.size("_usable") > 0) & F.forall("_usable", lambda r: observed(r) <= r["clear"])
    df = df.withColumn("matched", matched_reasons(F.col("_usable"), observed)).withColumn("skipped", skipped)
    df = df.withColumn("evaluated", F.size("_usable")).withColumn("all_below_clear", below)
    return df.withColumn("over", F.size("matched") > 0).drop("_rates", "_seen", "_usable", "_unusable", "_rules")


def sustained_crossings(evaluated: DataFrame, scope: list[str], stale_after_ms: int = 180_000, slice_ms: int = SLICE_MS) -> DataFrame:
    """Runs of over-threshold windows at least ``triggerFor`` long.

    A run ends at a window that is not over, at another policy or version, or at a gap longer than
    ``stale_after_ms``. Rows here are one per scope and window. A scope is looked
    at in slices of time, so a long one is not ordered in one task; runs pass
    their borders.
    """
    t = F.unix_micros("window_end")
    marked = by_time(evaluated.select(*scope, "policy_id", "policy_version", "over", "window_end", "trigger_for_ms").withColumn("_t", t), F.col("_t"), slice_ms)
    was = F.struct("over", "_t", "policy_id", "policy_version")
    seen = before(marked, scope, ["_t"], {"_was": ("last", was)})
    last = F.col("_was")
    fresh = last.isNull() | ~last["over"] | (F.col("_t") - last["_t"] > stale_after_ms * 1000) | (
        last["policy_id"] != F.col("policy_id")) | (last["policy_version"] != F.col("policy_version"))
    # A run is known by the moment of its first window.
    seen = seen.withColumn("_fresh", F.when(fresh, F.col("_t"))).drop("_was")
    runs = before(seen, scope, ["_t"], {"_begun": ("last", F.col("_fresh"))}).withColumn("_run", F.coalesce("_fresh", "_begun"))
    grouped = runs.where("over").groupBy(*scope, "policy_id", "_run").agg(
        F.min("window_end").alias("first_crossing"), F.max("window_end").alias("last_crossing"), F.count(F.lit(1)).alias("windows"),
        F.max("trigger_for_ms").alias("trigger_for_ms"))
    length = F.unix_millis("last_crossing") - F.unix_millis("first_crossing")
    return grouped.where(length >= F.col("trigger_for_ms")).drop("_run", "trigger_for_ms")
