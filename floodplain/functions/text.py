"""Durations and magnitudes as people write them in policy documents."""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F

from .vocab import INT64_MAX, by_case

DURATION_UNITS_MS = {"ms": 1, "s": 1_000, "m": 60_000, "h": 3_600_000, "d": 86_400_000}
MAGNITUDES = {"": 1, "k": 10**3, "K": 10**3, "M": 10**6, "G": 10**9, "T": 10**12}


def _scaled(text: Column, pattern: str, factors: dict) -> Column:
    trimmed = F.trim(text)
    # The digits are bounded before the cast so that it cannot overflow.
    digits = F.regexp_extract(trimmed, pattern, 1)
    number = F.when(F.length(F.ltrim(digits, F.lit("0"))) <= 19, digits.try_cast("bigint"))
    factor = by_case(F.regexp_extract(trimmed, pattern, 2), factors)
    return F.when(trimmed.rlike(pattern), F.try_multiply(number, factor.cast("bigint")))


def parse_duration_ms(text: Column) -> Column:
    """``250ms``, ``30s``, ``5m``, ``2h``, ``1d`` to milliseconds; a bare number is NULL."""
    return _scaled(text, "^([0-9]+)(ms|s|m|h|d)$", DURATION_UNITS_MS)


def parse_magnitude(text: Column) -> Column:
    """``10G``, ``500M``, ``1k``, ``250`` to a plain number, decimal; else NULL."""
    return _scaled(text, "^([0-9]+)([kKMGT]?)$", MAGNITUDES)


def render_duration(ms: Column) -> Column:
    """The shortest exact spelling of a duration."""
    rendered = F.concat(ms.cast("string"), F.lit("ms"))
    for unit in ("s", "m", "h", "d"):
        size = DURATION_UNITS_MS[unit]
        exact = (ms != 0) & (ms % size == 0)
        rendered = F.when(exact, F.concat((ms / size).cast("bigint").cast("string"), F.lit(unit))).otherwise(rendered)
    return rendered


def saturate(value: Column) -> Column:
    """A non-negative DECIMAL cut to the BIGINT range."""
    return F.least(value, F.lit(INT64_MAX).cast("decimal(38,0)")).cast("bigint")
