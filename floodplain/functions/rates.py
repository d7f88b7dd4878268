"""Integer rate arithmetic, shared by snapshots, policies and evaluation."""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F

from .text import saturate
from .vocab import INT64_MAX

WIDE = "decimal(38,0)"


def int_div(a: Column, b: Column) -> Column:
    return F.call_function("div", a, b)


def per_second(count: Column, window_ms: int) -> Column:
    """floor(count / window), on whole-second windows without widening."""
    if window_ms % 1000 == 0:
        return int_div(count, F.lit(window_ms // 1000).cast("bigint"))
    wide = int_div(count.cast("decimal(38,0)") * F.lit(1000), F.lit(window_ms))
    return saturate(wide.cast(WIDE))


def bits_per_second(octets: Column, window_ms: int) -> Column:
    """Bits first, then the division; widened only where eight-fold would overflow."""
    wide = saturate(
        F.floor(octets.cast(WIDE) * F.lit(8000).cast("decimal(10,0)") / F.lit(window_ms).cast("decimal(10,0)")).cast(WIDE)
    )
    if window_ms % 1000 == 0:
        narrow = int_div(octets * 8, F.lit(window_ms // 1000).cast("bigint"))
        return F.when(octets <= INT64_MAX // 8, narrow).otherwise(wide)
    return wide


def ratio_percent(observed: Column, threshold: Column) -> Column:
    small = observed <= INT64_MAX // 100
    fast = int_div(F.when(small, observed).otherwise(F.lit(0)) * 100, threshold)
    # Past that range the exact quotient still fits unless the threshold is below 100.
    slow = F.when(
        threshold > 100, saturate(F.floor(observed.cast("decimal(20,0)") * 100 / threshold.cast("decimal(20,0)")).cast(WIDE))
    ).otherwise(F.lit(INT64_MAX))
    return F.when(threshold == 0, F.lit(INT64_MAX)).when(small, fast).otherwise(slow)


def clear_threshold(trigger: Column, percent: Column) -> Column:
    """floor(trigger * percent / 100) without overflow: split off the hundreds."""
    percent = percent.cast("bigint")
    return int_div(trigger, F.lit(100)) * percent + int_div((trigger % 100) * percent, F.lit(100))


def step_seconds(start: Column, end: Column, max_points: int = 500, unit: int = 10) -> Column:
    """Bucket width that keeps a range within ``max_points``: a multiple of ``unit``."""
    raw = int_div(end - start + (max_points - 1), F.lit(max_points))
    return F.greatest(int_div(raw + (unit - 1), F.lit(unit)) * unit, F.lit(unit))


def step_for(start: int, end: int, max_points: int = 500, unit: int = 10) -> int:
    raw = -(-(end - start) // max_points)
    return max(-(-raw // unit) * unit, unit)
