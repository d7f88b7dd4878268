"""Facts of earlier rows of a key, without ordering a whole key in one task.

Rows of a key are cut into slices, of time or by ranges. Within a slice an ordinary
window looks back; what earlier slices add comes from one summary row a slice, and
only the summaries of a key are ever ordered together.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from ..session import cut_lineage

SLICE = "_slice"


def by_time(df: DataFrame, micros: Column, slice_ms: int) -> DataFrame:
    """Slices of ``slice_ms``; the result is cut off, as it is read more than once."""
    return cut_lineage(df.withColumn(SLICE, F.floor(micros / F.lit(slice_ms * 1000)).cast("bigint")))


def by_range(df: DataFrame, keys: list[str], order: str) -> DataFrame:
    """Slices of about equal size along ``keys`` and ``order``, whatever the order is made of; rows that tie share one."""
    return cut_lineage(df.repartitionByRange(*keys, order).withColumn(SLICE, F.spark_partition_id().cast("bigint")))


def before(df: DataFrame, keys: list[str], order: list[str], facts: dict[str, tuple[str, Column]]) -> DataFrame:
    """Add what the rows before each one say: ``name: ("last", value)`` is the newest non-null value, ``("max", value)`` the greatest.

    ``df`` comes from ``by_time`` or ``by_range``. Rows that tie in ``order`` have no defined sequence among themselves.
    """
    place = F.struct(*order)
    back = Window.partitionBy(*keys, SLICE).orderBy(*order).rowsBetween(Window.unboundedPreceding, -1)
    earlier = Window.partitionBy(*keys).orderBy(SLICE).rowsBetween(Window.unboundedPreceding, -1)
    summary = {
        name: F.max(value) if how == "max" else F.max_by(value, F.when(value.isNotNull(), place)) for name, (how, value) in facts.items()
    }
    carry = {name: F.max(name).over(earlier) if how == "max" else F.last(name, True).over(earlier) for name, (how, _) in facts.items()}
    slices = df.groupBy(*keys, SLICE).agg(*(column.alias(name) for name, column in summary.items()))
    slices = slices.select(*(F.col(c).alias(f"_of_{c}") for c in [*keys, SLICE]), *(column.alias(f"_carry_{name}") for name, column in carry.items()))
    inside = df.select("*", *((F.max(value) if how == "max" else F.last(value, True)).over(back).alias(f"_in_{name}") for name, (how, value) in facts.items()))
    same = [F.col(c).eqNullSafe(F.col(f"_of_{c}")) for c in [*keys, SLICE]]
    # Values grow or follow one another along slices, so the slice's own comes first for "last".
    combined = [
        (F.greatest(f"_in_{name}", f"_carry_{name}") if how == "max" else F.coalesce(f"_in_{name}", f"_carry_{name}")).alias(name)
        for name, (how, _) in facts.items()
    ]
    return inside.join(slices, same).select(*df.columns, *combined)
