"""Detection snapshots: per scope and window, integer rates and completeness.

One-sided and directional, unlike the rollups: a flow counts for the local end
it touches. A victim that draws a third of all flows is reduced map-side, before
any shuffle, to one row per window and exporter.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from ..functions import net
from ..functions.rates import bits_per_second, per_second
from ..functions.vocab import METRIC_ORDER
from .rollup import COUNTERS, RAW, contributions, event_time, sums

SCOPE_TYPES = ["host", "prefix", "slash24", "hostgroupTotal"]
UNATTRIBUTED = "unattributed"
SCOPE = ["tenant", "scope_type", "family", "scope_hi", "scope_lo", "scope_len", "hostgroup", "direction"]

_SCOPE_TYPES = {
    "tenant": "string", "scope_type": "string", "family": "int", "scope_hi": "bigint", "scope_lo": "bigint",
    "scope_len": "int", "hostgroup": "string", "direction": "string",
}

# What one local end of a flow carries.
_SIDE = ["tenant", "family", "hi", "lo", "hostgroup", "prefix_len", "direction"]

# metric -> (counter, in bits); the three without a byte counter stay zero.
RATE_OF = {
    "bps": "bytes", "pps": "packets", "fps": "flows", "tcpBps": "tcp_bytes", "tcpPps": "tcp_packets",
    "udpBps": "udp_bytes", "udpPps": "udp_packets", "icmpBps": "icmp_bytes", "icmpPps": "icmp_packets",
    "tcpSynBps": None, "tcpSynPps": "tcp_syn_packets", "fragmentedBps": None, "fragmentedPps": "fragmented_packets",
    "droppedBps": None, "droppedPps": "dropped_packets",
}


def _side(side: str, direction: str) -> Column:
    return F.struct(
        F.coalesce(F.col(f"{side}_tenant"), F.lit(UNATTRIBUTED)).alias("tenant"), F.col("family").alias("family"),
        F.col(f"{side}_hi").alias("hi"), F.col(f"{side}_lo").alias("lo"), F.col(f"{side}_hostgroup").alias("hostgroup"),
        F.col(f"{side}_prefix_len").alias("prefix_len"), F.lit(direction).alias("direction"),
    )


def sides() -> Column:
    """The local ends a flow counts for: the array holds NULL for an end it does not.

    A plain array literal keeps the explode inside generated code; the NULLs are
    filtered after it.
    """
    direction = F.col("direction")
    return F.array(
        F.when(direction.isin("incoming", "internal"), _side("dst", "incoming")),
        F.when(direction.isin("outgoing", "internal"), _side("src", "outgoing")),
    )


def scope_sides(classified: DataFrame) -> DataFrame:
    """One row per local end; flows without one are left out."""
    exploded = classified.select(*[c for c in classified.columns if c != "direction"], F.explode(sides()).alias("side"))
    return exploded.where("side IS NOT NULL")


def _scopes(side: Column, wanted: list[str]) -> Column:
    family, hi, lo = side["family"], side["hi"], side["lo"]

    def scope(kind: str, test: Column, s_hi=None, s_lo=None, length=None, hostgroup=None) -> Column:
        given = {"tenant": side["tenant"], "scope_type": F.lit(kind), "family": family, "scope_hi": s_hi, "scope_lo": s_lo,
                 "scope_len": length, "hostgroup": hostgroup, "direction": side["direction"]}
        struct = F.struct(*[(F.lit(None) if given[n] is None else given[n]).cast(t).alias(n) for n, t in _SCOPE_TYPES.items()])
        return F.when(test, struct)

    p_hi, p_lo = net.masked(family, hi, lo, side["prefix_len"])
    all_scopes = {
        "host": scope("host", F.lit(True), hi, lo, net.width(family)),
        "prefix": scope("prefix", side["prefix_len"].isNotNull(), p_hi, p_lo, side["prefix_len"]),
        "slash24": scope("slash24", family == 4, F.lit(0), lo.bitwiseAND(F.lit(net.mask_halves(4, 24)[1])), F.lit(24)),
        "hostgroupTotal": scope("hostgroupTotal", side["hostgroup"].isNotNull(), hostgroup=side["hostgroup"]),
    }
    return F.array(*[all_scopes[kind] for kind in wanted])


def scope_display() -> Column:
    """Text of a scope: an address, ``address/length`` or a hostgroup name."""
    address = net.address_text(F.col("family"), F.col("scope_hi"), F.col("scope_lo"))
    return (
        F.when(F.col("scope_type") == "hostgroupTotal", F.col("hostgroup"))
        .when(F.col("scope_type") == "host", address)
        .otherwise(F.concat(address, F.lit("/"), F.col("scope_len").cast("string")))
    )


_FACTS = ["has_protocol", "has_tcp_flags", "is_fragmented", "has_forwarding", "sampled", "from_global", "sampling_rate", "exporter"]


_CARRIED = ["sampling_rate", "sampling_source", "exporter"]


def _ends(classified: DataFrame) -> DataFrame:
    """One row per flow and local end, with the columns counters and facts come from."""
    return classified.select("ts", F.explode(sides()).alias("_side"), *RAW, *_CARRIED).where("_side IS NOT NULL")


def _facts() -> list[Column]:
    return [
        F.col("protocol").isNotNull().alias("has_protocol"), F.col("tcp_flags").isNotNull().alias("has_tcp_flags"),
        F.coalesce(F.col("fragmented"), F.lit(False)).alias("is_fragmented"),
        F.coalesce(F.col("forwarding_status_known"), F.lit(False)).alias("has_forwarding"),
        (F.col("sampling_rate") > 1).alias("sampled"), (F.col("sampling_source") == "global").alias("from_global"),
        F.col("sampling_rate"), F.col("exporter"),
    ]


def expand_scopes(classified: DataFrame, scope_types: list[str] = tuple(SCOPE_TYPES)) -> DataFrame:
    """Every (flow, scope) pair with the flow's contributions and facts."""
    scoped = _scoped(_ends(classified), "ts", scope_types, [*RAW, *_CARRIED])
    return scoped.select("ts", *SCOPE, *contributions(), *_facts())


def _scoped(sided: DataFrame, time: str, scope_types, rest: list[str]) -> DataFrame:
    scoped = sided.select(time, F.explode(_scopes(F.col("_side"), list(scope_types))).alias("_scope"), *rest)
    scoped = scoped.where("_scope IS NOT NULL")
    return scoped.select(time, *[F.col(f"_scope.{c}").alias(c) for c in SCOPE], *rest)


def _merged() -> list[Column]:
    flags = ["has_protocol", "has_tcp_flags", "is_fragmented", "has_forwarding", "sampled", "from_global"]
    return [*sums(), *[F.bool_or(f).alias(f) for f in flags], F.max("sampling_rate").alias("sampling_rate")]


def sketch_exporters() -> Column:
    """A 64-bit bitmap of exporters: may count too few, never too many."""
    bit = F.pmod(F.xxhash64("exporter"), F.lit(64)).cast("int")
    return F.bit_count(F.bit_or(F.call_function("shiftleft", F.lit(1).cast("bigint"), bit)))


def snapshots(classified: DataFrame, window_ms: int, scope_types: list[str] = tuple(SCOPE_TYPES),
              exporters: str = "exact") -> DataFrame:
    """One row per scope and finished window; a scope without traffic has no row."""
    window = F.window(event_time(classified), f"{window_ms} milliseconds")
    count = sketch_exporters() if exporters == "sketch" else F.count_distinct("exporter")
    if classified.isStreaming:
        scoped = expand_scopes(classified, scope_types)
        if exporters == "exact":
            # A first aggregate by exporter closes with the window, and the second counts its rows.
            scoped = scoped.groupBy(window.alias("w"), *SCOPE, "exporter").agg(*_merged())
            window, count = F.col("w"), F.count("exporter")
    else:
        # Tenant, prefix and hostgroup follow from the address: sum per local end and
        # exporter first, then add the ends up into their scopes.
        ends = _ends(classified).select(window.alias("w"), *[F.col(f"_side.{c}").alias(c) for c in _SIDE], *contributions(), *_facts())
        fine = ends.groupBy("w", *_SIDE, "exporter").agg(*_merged())
        scoped = _scoped(fine.select("w", F.struct(*_SIDE).alias("_side"), *COUNTERS, *_FACTS), "w", scope_types, [*COUNTERS, *_FACTS])
        window = F.col("w")
    grouped = scoped.groupBy(window.alias("w"), *SCOPE).agg(*_merged(), count.cast("int").alias("exporters_observed"))
    rates = []
    for metric in METRIC_ORDER:
        counter = RATE_OF[metric]
        if counter is None:
            rate = F.lit(0).cast("bigint")
        elif metric.lower().endswith("bps"):
            rate = bits_per_second(F.col(counter), window_ms)
        else:
            rate = per_second(F.col(counter), window_ms)
        rates.append(rate.alias(metric))
    return grouped.select(
        F.col("w.start").alias("window_start"), F.col("w.end").alias("window_end"), F.lit(window_ms).cast("bigint").alias("window_ms"),
        *SCOPE, scope_display().alias("scope_display"), *rates, F.col("has_protocol").alias("protocol_seen"),
        F.col("has_tcp_flags").alias("tcp_flags_seen"), F.col("is_fragmented").alias("fragmentation_seen"),
        F.col("has_forwarding").alias("forwarding_status_seen"), F.col("sampled").alias("sampling_corrected"),
        F.col("from_global").alias("sampling_used_global_default"), F.col("sampling_rate").alias("sampling_max_rate"),
        F.col("flows").alias("flows_observed"), "exporters_observed",
    )


def window_stats(classified: DataFrame, window_ms: int) -> DataFrame:
    """Flows seen, flows no scope took, and snapshots made, in one pass.

    A flow is a row of its own beside its local ends. Rows are counted by window and
    local end before they are told apart by scope; a flow without a time is in no window.
    """
    at = F.unix_millis(event_time(classified))
    unscoped = ~F.coalesce(F.col("direction").isin("incoming", "outgoing", "internal"), F.lit(False))
    own = F.col("_end") == 0
    ends = classified.select((at - F.pmod(at, F.lit(window_ms))).alias("w"), unscoped.alias("unscoped"),
                             F.posexplode(F.array_insert(sides(), 1, F.lit(None))).alias("_end", "_side"))
    ends = ends.where(own | (F.col("_side").isNotNull() & F.col("w").isNotNull()))
    fine = ends.groupBy(F.when(~own, F.col("w")).alias("w"), "_side").agg(
        F.count_if(own).alias("flows"), F.count_if(own & F.col("unscoped")).alias("unscoped"))
    scopes = F.when(F.col("_side").isNotNull(), F.array_compact(_scopes(F.col("_side"), SCOPE_TYPES)))
    scoped = fine.select("w", "flows", "unscoped", F.explode_outer(scopes).alias("_scope"))
    made = scoped.groupBy("w", "_scope").agg(F.sum("flows").alias("flows"), F.sum("unscoped").alias("unscoped"))
    return made.agg(
        F.coalesce(F.sum("flows"), F.lit(0)).alias("flows_ingested"), F.coalesce(F.sum("unscoped"), F.lit(0)).alias("flows_unscoped"),
        F.count("_scope").alias("snapshots_emitted"))
