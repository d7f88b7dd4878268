"""Traffic queries over the rollup tables, never over raw flows.

A rollup has ``window_start`` and twelve counters; a stored one also has
``date``, and then a range filter prunes partitions.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from ..functions.rates import step_for
from ..operators.rollup import saturating_sum

MAX_RANGE_SECONDS = 30 * 24 * 3600
EXPORTER_RATE_SECONDS = 300
TRAFFIC_RETENTION_DAYS = 30
EVENT_RETENTION_DAYS = 365

TOP_KEYS = {
    "host": lambda: F.col("address"),
    "network": lambda: F.concat(F.col("address"), F.lit("/"), F.col("prefix_len").cast("string")),
    "slash24": lambda: F.col("address"),
    "hostgroup": lambda: F.col("hostgroup"),
    "asn": lambda: F.col("asn").cast("string"),
    "interface": lambda: F.concat_ws("/", "exporter", F.col("interface_index").cast("string"), "direction"),
    "exporter": lambda: F.col("exporter"),
}


def check_range(start: int, end: int) -> None:
    if start >= end or end - start > MAX_RANGE_SECONDS:
        raise ValueError("the start must be before the end, at most 30 days apart")
    if start < 0 or end > 2**32 - 1:
        raise ValueError("the range must fall between 1970 and 2106")


def in_range(rollup: DataFrame, start: int, end: int, column: str = "window_start") -> DataFrame:
    """Half-open time filter; on a stored table also the day filter that prunes."""
    when = F.col(column)
    df = rollup.where((when >= F.timestamp_seconds(F.lit(start))) & (when < F.timestamp_seconds(F.lit(end))))
    if "date" in rollup.columns:
        day = lambda s: F.to_date(F.timestamp_seconds(F.lit(s)))
        df = df.where((F.col("date") >= day(start)) & (F.col("date") <= day(end - 1)))
    return df


def bucket(seconds: int, column: str = "window_start") -> Column:
    """Start of the epoch-aligned interval, in epoch seconds."""
    epoch = F.unix_timestamp(F.col(column))
    return (epoch - epoch % seconds).cast("bigint")


def _total(column: Column | str) -> Column:
    """A sum that cannot overflow: stored counters stop at the largest BIGINT, so many of them may pass it."""
    return F.sum((F.col(column) if isinstance(column, str) else column).cast("decimal(38,0)"))


def _rate(column: Column, seconds: int, scale: int = 1) -> Column:
    return column.cast("double") * scale / F.lit(seconds)


def traffic_summary(by_family: DataFrame, start: int, end: int) -> DataFrame:
    """IPv4 and IPv6 rates per step. Steps in which nothing was seen have no row."""
    check_range(start, end)
    step = step_for(start, end)
    part = lambda c, family: _total(F.when(F.col("family") == family, F.col(c)).otherwise(F.lit(0)))
    return in_range(by_family, start, end).groupBy(bucket(step).alias("time")).agg(
        _rate(part("bytes", 4), step, 8).alias("ipv4_bps"), _rate(part("bytes", 6), step, 8).alias("ipv6_bps"),
        _rate(part("packets", 4), step).alias("ipv4_pps"), _rate(part("packets", 6), step).alias("ipv6_pps"),
    )


def top_talkers(rollup: DataFrame, dimension: str, start: int, end: int, limit: int = 10) -> DataFrame:
    """Largest keys of a dimension by bytes; the key breaks ties."""
    if limit < 1:
        raise ValueError("limit must be at least 1")
    check_range(start, end)
    summed = in_range(rollup, start, end).groupBy(TOP_KEYS[dimension]().alias("key")).agg(
        saturating_sum("bytes"), saturating_sum("packets"), saturating_sum("flows")
    )
    return summed.orderBy(F.desc("bytes"), "key").limit(limit)


def top_20(rollup: DataFrame, dimension: str, start: int, end: int) -> DataFrame:
    """The dashboard variant: same ranking, twenty rows."""
    return top_talkers(rollup, dimension, start, end, 20)


def exporters(by_exporter: DataFrame, asof: int, limit: int | None = None) -> DataFrame:
    """Exporters of the last day: last seen, silence, and their rate of five minutes; all, unless a limit is given."""
    seen = in_range(by_exporter, asof - 86_400, asof + 1)
    recent = F.col("window_start") >= F.timestamp_seconds(F.lit(asof - EXPORTER_RATE_SECONDS))
    late = lambda c: _total(F.when(recent, F.col(c)).otherwise(F.lit(0)))
    grouped = seen.groupBy("exporter").agg(
        F.unix_timestamp(F.max("window_start")).alias("last_seen"),
        _rate(late("bytes"), EXPORTER_RATE_SECONDS, 8).alias("bps"), _rate(late("packets"), EXPORTER_RATE_SECONDS).alias("pps"),
    )
    silent = F.greatest(F.lit(asof).cast("bigint") - F.col("last_seen"), F.lit(0).cast("bigint"))
    listed = grouped.select("exporter", "last_seen", silent.alias("silent_seconds"), "bps", "pps").orderBy("exporter")
    return listed if limit is None else listed.limit(limit)


def traffic_by_family(by_family: DataFrame, start: int, end: int, interval: int, measure: str = "bps") -> DataFrame:
    """Rates per interval and family, the two families stacked."""
    column, scale = {"bps": ("bytes", 8), "pps": ("packets", 1)}[measure]
    named = F.when(F.col("family") == 4, F.lit("IPv4")).otherwise(F.lit("IPv6"))
    return in_range(by_family, start, end).groupBy(bucket(interval).alias("time"), named.alias("family")).agg(
        _rate(_total(column), interval, scale).alias(measure)
    )


def protocol_mix(by_family: DataFrame, start: int, end: int, interval: int, family: int = 4) -> DataFrame:
    total = _total("bytes")
    parts = {name: _total(f"{name}_bytes") for name in ("tcp", "udp", "icmp")}
    return in_range(by_family.where(F.col("family") == family), start, end).groupBy(bucket(interval).alias("time")).agg(
        *[_rate(value, interval, 8).alias(name) for name, value in parts.items()],
        _rate(total - parts["tcp"] - parts["udp"] - parts["icmp"], interval, 8).alias("other"),
    )


def attack_indicators(by_family: DataFrame, start: int, end: int, interval: int, family: int = 4) -> DataFrame:
    return in_range(by_family.where(F.col("family") == family), start, end).groupBy(bucket(interval).alias("time")).agg(
        *[_rate(_total(f"{name}_packets"), interval).alias(name) for name in ("tcp_syn", "fragmented", "dropped")]
    )


def traffic_by_exporter(by_exporter: DataFrame, start: int, end: int, interval: int) -> DataFrame:
    return in_range(by_exporter, start, end).groupBy(bucket(interval).alias("time"), "exporter").agg(
        _rate(_total("bytes"), interval, 8).alias("bps")
    )


def events_by_severity(events: DataFrame, start: int, end: int, interval: int) -> DataFrame:
    return in_range(events, start, end, "timestamp").groupBy(bucket(interval, "timestamp").alias("time"), "severity").agg(
        F.count(F.lit(1)).alias("events")
    )


LATEST_COLUMNS = ["detected_at", "kind", "severity", "tenant", "policy_name", "scope_type", "target",
                  "direction", "state", "reason", "action"]


def latest_detection_events(events: DataFrame, start: int, end: int, limit: int = 100) -> DataFrame:
    """Newest first; the event id breaks ties."""
    rows = in_range(events, start, end, "timestamp").orderBy(F.desc("detected_at"), "event_id").limit(limit)
    return rows.select(*LATEST_COLUMNS)


def retention_filter(df: DataFrame, asof: int, days: int = TRAFFIC_RETENTION_DAYS, column: str = "window_start") -> DataFrame:
    """Rows young enough to keep; on a stored table old days are never read."""
    oldest = asof - days * 86_400
    kept = df.where(F.col(column) > F.timestamp_seconds(F.lit(oldest)))
    if "date" in df.columns:
        kept = kept.where(F.col("date") >= F.to_date(F.timestamp_seconds(F.lit(oldest))))
    return kept
