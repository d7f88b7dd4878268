"""Local prefix lists: ``network/length[@tenant[@hostgroup]]``, comma separated."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from ..functions import net

DEFAULT_TENANT = "default"


def parse_prefix_lists(lines: DataFrame, column: str = "value") -> DataFrame:
    """Entries of every line in order, one row each; ``valid`` is false on malformed ones.

    ``position`` numbers the entries over the whole list, all lines and files of it.
    """
    entries = numbered(lines.select(F.explode(F.split(column, ",")).alias("entry")))
    entries = entries.withColumn("entry", F.trim("entry")).where("entry <> ''")
    part = lambda i: F.try_element_at(F.split("entry", "@"), F.lit(i))
    cidr = F.inline_outer(F.array(net.parse_cidr(part(1))))
    parsed = entries.select(
        F.col("position").cast("bigint").alias("position"), "entry", F.coalesce(part(2), F.lit(DEFAULT_TENANT)).alias("tenant"),
        part(3).alias("hostgroup"), cidr.alias("family", "net_hi", "net_lo", "prefix_len"),
    )
    return with_masks(parsed).withColumn("valid", F.col("family").isNotNull())


def numbered(rows: DataFrame) -> DataFrame:
    """Add ``position``: 0, 1, … in the order of reading. Partitions are counted first, so no task sees all rows."""
    at = rows.withColumn("_at", F.monotonically_increasing_id())
    part = F.shiftright("_at", 33)
    counts = at.groupBy(part.alias("_part")).agg(F.count(F.lit(1)).alias("_n"))
    before = Window.orderBy("_part").rowsBetween(Window.unboundedPreceding, -1)
    offsets = counts.select("_part", F.coalesce(F.sum("_n").over(before), F.lit(0)).alias("_before"))
    return at.withColumn("_own", part).join(F.broadcast(offsets), F.col("_own") == F.col("_part")).select(
        (F.col("_before") + F.col("_at").bitwiseAND(F.lit((1 << 33) - 1))).cast("bigint").alias("position"), *rows.columns)


def with_masks(prefixes: DataFrame) -> DataFrame:
    family, length = F.col("family"), F.col("prefix_len")
    return prefixes.withColumn("mask_hi", net.mask_hi(family, length)).withColumn("mask_lo", net.mask_lo(family, length))


def read_prefixes(spark: SparkSession, path: str) -> DataFrame:
    """A text file of prefix lists; malformed entries are refused, all named at once."""
    parsed = parse_prefix_lists(spark.read.text(path))
    bad = parsed.where("NOT valid").orderBy("position").select("position", "entry").collect()
    if bad:
        raise ValueError("malformed prefix entries: " + ", ".join(f"{r['entry']!r} at {r['position']}" for r in bad))
    return parsed.drop("valid", "entry")


def prefix_text(prefixes: DataFrame) -> Column:
    return F.concat(net.address_text(F.col("family"), F.col("net_hi"), F.col("net_lo")), F.lit("/"), F.col("prefix_len"))
