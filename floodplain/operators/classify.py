"""Direction of a flow against the registered local prefixes."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from ..functions import net
from .joins import BROADCAST_ROWS, MAX_CHAINED_LENGTHS, lengths_of, longest_prefix_match, lookup_join, nested_pairs


def _families(flows: DataFrame) -> dict[str, tuple[str, str, str]]:
    """A flow may carry one family column, or one per side."""
    return {
        f"_{side}": (f"{side}_family" if f"{side}_family" in flows.columns else "family", f"{side}_hi", f"{side}_lo")
        for side in ("src", "dst")
    }


def classify(flows: DataFrame, prefixes: DataFrame, with_reason: bool = False,
             broadcast_rows: int = BROADCAST_ROWS, max_lengths: int = MAX_CHAINED_LENGTHS) -> DataFrame:
    """Add direction, and the tenant, hostgroup and matched length of both sides."""
    lengths = lengths_of(prefixes)
    if lengths:
        df = longest_prefix_match(
            flows, prefixes, _families(flows), ["tenant", "hostgroup"], broadcast_rows, max_lengths, lengths
        )
    else:
        empty = F.lit(None).cast("struct<tenant:string,hostgroup:string,prefix_len:int>")
        df = flows.withColumn("_src", empty).withColumn("_dst", empty)
    columns = [
        *flows.columns,
        direction(bool(lengths)).alias("direction"),
        *[
            F.col(f"_{side}.{field}").alias(f"{side}_{field}")
            for side in ("src", "dst") for field in ("tenant", "hostgroup", "prefix_len")
        ],
    ]
    if with_reason:
        columns.append(reason(bool(lengths)).alias("reason"))
    return df.select(*columns)


def direction(any_prefixes: bool = True) -> Column:
    if not any_prefixes:
        return F.lit("unknown")
    src, dst = F.col("_src").isNotNull(), F.col("_dst").isNotNull()
    return (
        F.when(~src & dst, F.lit("incoming"))
        .when(src & ~dst, F.lit("outgoing"))
        .when(src & dst, F.lit("internal"))
        .otherwise(F.lit("other"))
    )


def reason(any_prefixes: bool = True) -> Column:
    """Why a flow got its direction, naming both addresses and the matched lengths."""
    if not any_prefixes:
        return F.lit("no local prefixes are configured; direction cannot be determined")
    src, dst = F.col("_src"), F.col("_dst")
    a, b = F.col("src_addr"), F.col("dst_addr")
    a_len, b_len = src["prefix_len"].cast("string"), dst["prefix_len"].cast("string")
    say = lambda *parts: F.concat(*[F.lit(p) if isinstance(p, str) else p for p in parts])
    return (
        F.when(src.isNull() & dst.isNotNull(),
               say("source ", a, " matched no local prefix; destination ", b,
                   " matched a local prefix (/", b_len, ") — classified Incoming"))
        .when(src.isNotNull() & dst.isNull(),
              say("source ", a, " matched a local prefix (/", a_len, "); destination ", b,
                  " matched no local prefix — classified Outgoing"))
        .when(src.isNotNull() & dst.isNotNull(),
              say("source ", a, " (/", a_len, ") and destination ", b, " (/", b_len,
                  ") both matched local prefixes — classified Internal"))
        .otherwise(say("neither source ", a, " nor destination ", b,
                       " matched a local prefix — classified Other"))
    )


def flows_by_direction(classified: DataFrame) -> DataFrame:
    return classified.groupBy("direction").agg(
        F.count(F.lit(1)).alias("flows"),
        F.count_if(F.col("direction") == "unknown").alias("lookup_failures"),
    )


def validate_prefixes(prefixes: DataFrame) -> DataFrame:
    """All errors and overlap warnings of an ordered prefix list (``position``).

    Errors: a length past the family, an exact duplicate of an earlier entry.
    Warnings: the later of two nested entries reports, naming the other's length.
    """
    family, length = F.col("family"), F.col("prefix_len")
    hi, lo = net.masked(family, F.col("net_hi"), F.col("net_lo"), length)
    listed = prefixes.select(
        "position", "family", "prefix_len", hi.alias("hi"), lo.alias("lo"),
        (length > net.width(family)).alias("too_long"),
    )
    too_long = listed.where("too_long").select(
        "position", F.lit("error").alias("level"), F.lit("prefix_too_long").alias("code"),
        F.lit(None).cast("int").alias("other_len"),
    )
    legal = listed.where(~F.col("too_long"))
    firsts = legal.groupBy("family", "prefix_len", "hi", "lo").agg(F.min("position").alias("first"))
    numbered = lookup_join(legal, firsts, ["family", "prefix_len", "hi", "lo"], "left")
    duplicates = numbered.where("position > first").select(
        "position", F.lit("error").alias("level"), F.lit("duplicate").alias("code"),
        F.lit(None).cast("int").alias("other_len"),
    )
    accepted = numbered.where("position = first").withColumnsRenamed({"hi": "net_hi", "lo": "net_lo"})
    nested = nested_pairs(accepted, ["position"])
    inner_later = F.col("inner_position") > F.col("outer_position")
    warnings = nested.select(
        F.when(inner_later, F.col("inner_position")).otherwise(F.col("outer_position")).alias("position"),
        F.lit("warning").alias("level"),
        F.when(inner_later, F.lit("inside_broader")).otherwise(F.lit("contains_narrower")).alias("code"),
        F.when(inner_later, F.col("outer_len")).otherwise(F.col("inner_len")).alias("other_len"),
    )
    return too_long.unionByName(duplicates).unionByName(warnings)
