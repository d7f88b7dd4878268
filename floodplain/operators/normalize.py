"""Sampling correction, rejection of unusable flows, derived flags."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from ..functions import net
from ..functions.vocab import ICMP, ICMPV6, PROTOCOL_NAMES, TCP, TCP_SYN_BIT
from .joins import longest_prefix_match, lookup_join

# Tier names, highest priority first; the last one stands for "no usable rate".
SAMPLING_TIERS = ["record", "options", "exporter", "global", "unsampled"]


def admit_exporters(flows: DataFrame, networks: DataFrame) -> DataFrame:
    """Keep flows whose exporter lies in an allowed network; no networks allow all.

    Each flow's exporter is looked up in the broadcast networks: one scan of the
    flows and no shuffle. An exporter that is no address is not allowed.
    """
    if networks.limit(1).count() == 0:
        return flows
    parsed = flows.withColumn("_exporter", net.unmap(net.parse_address(F.col("exporter"))))
    for part in ("family", "hi", "lo"):
        parsed = parsed.withColumn(f"_exporter_{part}", F.col(f"_exporter.{part}"))
    matched = longest_prefix_match(parsed, networks, {"_allowed": ("_exporter_family", "_exporter_hi", "_exporter_lo")}, [])
    return matched.where("_allowed IS NOT NULL").select(*flows.columns)


def resolve_sampling(flows: DataFrame, exporter_rates: DataFrame | None = None,
                     global_default: int | None = None) -> DataFrame:
    """First usable rate of record, options, exporter, global; else 1.

    A declared zero is skipped, and flagged only when met before the winner.
    """
    if exporter_rates is not None:
        rates = exporter_rates.select("exporter", F.col("rate").alias("_exporter_rate"))
        df = lookup_join(flows, rates, ["exporter"], "left")
    else:
        df = flows.withColumn("_exporter_rate", F.lit(None).cast("int"))
    tiers = [
        F.col("sampling_record"), F.col("sampling_options"), F.col("_exporter_rate"),
        F.lit(global_default).cast("int"),
    ]
    usable = [F.when(t > 0, t) for t in tiers]
    rate = F.coalesce(*usable, F.lit(1)).cast("bigint")
    source = F.lit(SAMPLING_TIERS[-1])
    skipped = F.lit(False)
    for tier, name in reversed(list(zip(tiers, SAMPLING_TIERS))):
        source = F.when(tier > 0, F.lit(name)).otherwise(source)
        skipped = F.when(tier > 0, F.lit(False)).when(tier == 0, F.lit(True)).otherwise(skipped)
    return df.select(
        *flows.columns, rate.alias("sampling_rate"), source.alias("sampling_source"),
        skipped.alias("zero_rate_skipped"),
    )


def apply_sampling(flows: DataFrame) -> DataFrame:
    """Multiply the raw counters once; NULL stands for an overflow."""
    return flows.withColumn("bytes", F.try_multiply("raw_bytes", "sampling_rate")).withColumn(
        "packets", F.try_multiply("raw_packets", "sampling_rate")
    )


def reject_reason() -> Column:
    absent = F.col("src_lo").isNull() | F.col("dst_lo").isNull()
    empty = (F.coalesce("raw_bytes", F.lit(0)) == 0) & (F.coalesce("raw_packets", F.lit(0)) == 0)
    overflow = F.col("bytes").isNull() | F.col("packets").isNull()
    return (
        F.when(absent, F.lit("missing_addresses"))
        .when(empty, F.lit("empty"))
        .when(overflow, F.lit("sampling_overflow"))
    )


def with_reject_reason(flows: DataFrame) -> DataFrame:
    return flows.withColumn("reject_reason", reject_reason())


def normalize_all(flows: DataFrame, exporter_rates: DataFrame | None = None,
                  global_default: int | None = None) -> DataFrame:
    """Every flow, corrected, with ``reject_reason`` NULL on the good ones."""
    return with_reject_reason(apply_sampling(resolve_sampling(flows, exporter_rates, global_default)))


def normalize(flows: DataFrame, exporter_rates: DataFrame | None = None,
              global_default: int | None = None) -> DataFrame:
    """The usable flows."""
    df = normalize_all(flows, exporter_rates, global_default)
    return df.where(F.col("reject_reason").isNull()).drop("reject_reason")


def rejects(flows: DataFrame, exporter_rates: DataFrame | None = None,
            global_default: int | None = None) -> DataFrame:
    return normalize_all(flows, exporter_rates, global_default).where(F.col("reject_reason").isNotNull())


def decode_forwarding_status(flows: DataFrame, status: str = "forwarding_status") -> DataFrame:
    """Known when the field came; dropped when its two top bits say so."""
    value = F.col(status)
    return flows.withColumn("forwarding_status_known", value.isNotNull()).withColumn(
        "dropped", F.coalesce(F.shiftright(value.cast("int"), 6) == 2, F.lit(False))
    )


def is_tcp() -> Column:
    return F.coalesce(F.col("protocol") == TCP, F.lit(False))


def is_icmp() -> Column:
    return F.coalesce(F.col("protocol").isin(ICMP, ICMPV6), F.lit(False))


def is_tcp_syn() -> Column:
    flags = F.coalesce(F.col("tcp_flags"), F.lit(0))
    return is_tcp() & (flags.bitwiseAND(F.lit(TCP_SYN_BIT)) != 0)


def normalization_report(normalized_all: DataFrame) -> DataFrame:
    """One row of counts from ``normalize_all`` output."""
    good = F.col("reject_reason").isNull()
    unnamed = F.col("protocol").isNotNull() & ~F.col("protocol").isin(*PROTOCOL_NAMES)
    reason = lambda name: F.count_if(F.col("reject_reason") == name)
    return normalized_all.agg(
        F.count_if(good).alias("normalized"),
        F.count_if(good & (F.col("sampling_rate") > 1)).alias("corrected"),
        F.count_if(good & F.col("zero_rate_skipped")).alias("zero_rate_skipped"),
        F.count_if(good & unnamed).alias("unnamed_protocol"),
        reason("missing_addresses").alias("rejected_missing_addresses"),
        reason("empty").alias("rejected_empty"),
        reason("sampling_overflow").alias("rejected_sampling_overflow"),
    )


def exporter_restarts(flows: DataFrame, bucket_seconds: int = 60) -> DataFrame:
    """Sequence numbers that went down, per exporter and observation domain.

    An exporter may send a third of all flows, so the order is not taken over
    the whole exporter: each minute is ordered by itself, and the first number of
    a minute is compared with the last one before it through a small per-minute
    summary.
    """
    keys = ["exporter", "observation_domain_id"]
    order = F.struct("ts", "flow_id")
    seen = flows.where(F.col("sequence_number").isNotNull()).select(
        *keys, "ts", "flow_id", "sequence_number",
        F.floor(F.unix_timestamp(F.col("ts").cast("timestamp")) / bucket_seconds).cast("bigint").alias("_slot"),
    )
    within = Window.partitionBy(*keys, "_slot").orderBy("ts", "flow_id")
    inner = seen.withColumn("previous_sequence", F.lag("sequence_number").over(within))
    edges = seen.groupBy(*keys, "_slot").agg(
        F.max_by("sequence_number", order).alias("_last"),
        F.min(F.struct("ts", "flow_id", "sequence_number")).alias("_first"),
    )
    across = Window.partitionBy(*keys).orderBy("_slot")
    joints = edges.withColumn("previous_sequence", F.lag("_last").over(across)).select(
        *keys, F.col("_first.ts").alias("ts"), F.col("_first.flow_id").alias("flow_id"),
        F.col("_first.sequence_number").alias("sequence_number"), "previous_sequence",
    )
    both = inner.drop("_slot").where("previous_sequence IS NOT NULL").unionByName(
        joints.where("previous_sequence IS NOT NULL")
    )
    return both.where(F.col("sequence_number") < F.col("previous_sequence"))
