"""Traffic rollups: twelve counters per window and key.

Rows of a rollup are per-window deltas, so that summing rows is always right.
Every rollup is one partial + final hash aggregation over one scan; a hot host,
network or exporter collapses before the shuffle.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from ..functions import net
from ..functions.vocab import INT64_MAX, TCP, UDP
from .joins import first_rows
from .normalize import is_icmp, is_tcp_syn

COUNTERS = [
    "bytes", "packets", "flows", "tcp_bytes", "tcp_packets", "udp_bytes", "udp_packets",
    "icmp_bytes", "icmp_packets", "tcp_syn_packets", "fragmented_packets", "dropped_packets",
]

# Default bound per dimension, for ``cap_dimension``.
CAPS = {
    "host": 100_000, "network": 50_000, "slash24": 50_000, "hostgroup": 1_000, "asn": 10_000,
    "exporter": 1_000, "interface": 10_000, "protocol": 64,
}

KEYS = {
    "total": [],
    "family": ["family"],
    "host": ["family", "hi", "lo"],
    "slash24": ["lo"],
    "network": ["family", "hi", "lo", "prefix_len"],
    "hostgroup": ["hostgroup"],
    "asn": ["asn"],
    "exporter": ["exporter"],
    "interface": ["exporter", "interface_index", "direction"],
    "protocol": ["protocol"],
}


# The flow columns the counters come from. Explodes carry these few and the
# counters are worked out after them: fewer columns through the explode keep its
# generated code small enough for the JIT compiler.
RAW = ["bytes", "packets", "protocol", "tcp_flags", "fragmented", "forwarding_status_known", "dropped"]


def contributions() -> list[Column]:
    """What one flow adds to each counter."""
    protocol = F.coalesce(F.col("protocol"), F.lit(-1))
    part = lambda test, value: F.when(test, F.col(value)).otherwise(F.lit(0)).cast("bigint")
    dropped = F.col("forwarding_status_known") & F.col("dropped")
    return [
        F.col("bytes").cast("bigint").alias("bytes"),
        F.col("packets").cast("bigint").alias("packets"),
        F.lit(1).cast("bigint").alias("flows"),
        part(protocol == TCP, "bytes").alias("tcp_bytes"),
        part(protocol == TCP, "packets").alias("tcp_packets"),
        part(protocol == UDP, "bytes").alias("udp_bytes"),
        part(protocol == UDP, "packets").alias("udp_packets"),
        part(is_icmp(), "bytes").alias("icmp_bytes"),
        part(is_icmp(), "packets").alias("icmp_packets"),
        part(is_tcp_syn(), "packets").alias("tcp_syn_packets"),
        part(F.coalesce(F.col("fragmented"), F.lit(False)), "packets").alias("fragmented_packets"),
        part(F.coalesce(dropped, F.lit(False)), "packets").alias("dropped_packets"),
    ]


def saturating_sum(column: str) -> Column:
    """Sum of non-negative, non-NULL values, held at the BIGINT maximum."""
    return F.coalesce(F.try_sum(column), F.lit(INT64_MAX)).alias(column)


def sums() -> list[Column]:
    return [saturating_sum(c) for c in COUNTERS]


def event_time(df: DataFrame) -> Column:
    """``ts`` as an instant; left as it is where it already is one, to keep its watermark."""
    return F.col("ts") if dict(df.dtypes)["ts"] == "timestamp" else F.col("ts").cast("timestamp")


def window_key(df: DataFrame, seconds: int) -> Column:
    """Tumbling window aligned to the epoch, on arrival time, as ``_w``.

    A batch groups by the plain start; a stream needs the window itself, which
    carries the watermark.
    """
    window = F.window(event_time(df), f"{seconds} seconds")
    return (window if df.isStreaming else window["start"]).alias("_w")


def finish_window(grouped: DataFrame) -> DataFrame:
    start = F.col("_w.start") if grouped.isStreaming else F.col("_w")
    return grouped.select(start.alias("window_start"), *[c for c in grouped.columns if c != "_w"])


def _rollup(flows: DataFrame, seconds: int, keys: list[Column], names: list[str]) -> DataFrame:
    contributed = flows.select(window_key(flows, seconds), *keys, *contributions())
    return finish_window(contributed.groupBy("_w", *names).agg(*sums()))


def _two_sided(flows: DataFrame, seconds: int, keys: Column, names: list[str]) -> DataFrame:
    """One row per side; a flow whose sides share the key counts twice."""
    keyed = flows.select(window_key(flows, seconds), F.explode(keys).alias("_key"), *RAW).where("_key IS NOT NULL")
    sided = keyed.select("_w", *[F.col(f"_key.{n}").alias(n) for n in names], *contributions())
    return finish_window(sided.groupBy("_w", *names).agg(*sums()))


def _side_address(side: str) -> tuple[Column, Column, Column]:
    return F.col("family"), F.col(f"{side}_hi"), F.col(f"{side}_lo")


def _order(df: DataFrame, keys: list[str]) -> DataFrame:
    return df.select("window_start", *keys, *COUNTERS)


def rollup_total(flows: DataFrame, seconds: int) -> DataFrame:
    return _rollup(flows, seconds, [], [])


def rollup_family(flows: DataFrame, seconds: int) -> DataFrame:
    """IPv4 and IPv6, decided by the source address."""
    return _rollup(flows, seconds, [F.col("family")], ["family"])


def rollup_host(flows: DataFrame, seconds: int) -> DataFrame:
    host = lambda side: F.struct(*[c.alias(n) for c, n in zip(_side_address(side), KEYS["host"])])
    df = _two_sided(flows, seconds, F.array(host("src"), host("dst")), KEYS["host"])
    return _order(df.withColumn("address", net.address_text(F.col("family"), F.col("hi"), F.col("lo"))),
                  ["family", "hi", "lo", "address"])


def rollup_slash24(flows: DataFrame, seconds: int) -> DataFrame:
    block = lambda side: F.struct(F.col(f"{side}_lo").bitwiseAND(F.lit(net.mask_halves(4, 24)[1])).alias("lo"))
    df = _two_sided(flows.where("family = 4"), seconds, F.array(block("src"), block("dst")), ["lo"])
    return _order(df.withColumn("address", net.ipv4_text(F.col("lo"))), ["lo", "address"])


def _networks(lengths4: list[int], lengths6: list[int]) -> Column:
    def entry(side: str, family: int, length: int) -> Column:
        mask_hi, mask_lo = net.mask_halves(family, length)
        fam, hi, lo = _side_address(side)
        return F.when(fam == family, F.struct(
            fam.alias("family"), hi.bitwiseAND(F.lit(mask_hi)).alias("hi"),
            lo.bitwiseAND(F.lit(mask_lo)).alias("lo"), F.lit(length).alias("prefix_len"),
        ))

    wanted = [(4, n) for n in lengths4] + [(6, n) for n in lengths6]
    entries = [entry(side, family, n) for family, n in wanted for side in ("src", "dst")]
    return F.array(*entries)


def rollup_network(flows: DataFrame, seconds: int, lengths4: list[int], lengths6: list[int] = ()) -> DataFrame:
    """Configured extra prefix lengths; IPv6 only when asked for."""
    df = _two_sided(flows, seconds, _networks(list(lengths4), list(lengths6)), KEYS["network"])
    return _order(df.withColumn("address", net.address_text(F.col("family"), F.col("hi"), F.col("lo"))),
                  ["family", "hi", "lo", "prefix_len", "address"])


def _either_side(src: str, dst: str, name: str) -> Column:
    wrap = lambda c: F.when(F.col(c).isNotNull(), F.struct(F.col(c).alias(name)))
    return F.array(wrap(src), wrap(dst))


def rollup_hostgroup(classified: DataFrame, seconds: int) -> DataFrame:
    return _two_sided(classified, seconds, _either_side("src_hostgroup", "dst_hostgroup", "hostgroup"), ["hostgroup"])


def rollup_asn(flows: DataFrame, seconds: int) -> DataFrame:
    return _two_sided(flows, seconds, _either_side("src_asn", "dst_asn", "asn"), ["asn"])


def rollup_exporter(flows: DataFrame, seconds: int) -> DataFrame:
    return _rollup(flows, seconds, [F.col("exporter")], ["exporter"])


def rollup_interface(flows: DataFrame, seconds: int) -> DataFrame:
    """Keyed by exporter as well: index 3 of one router is not index 3 of another."""
    def entry(index: str, direction: str) -> Column:
        return F.when(F.col(index).isNotNull(), F.struct(
            F.col("exporter").alias("exporter"), F.col(index).cast("bigint").alias("interface_index"),
            F.lit(direction).alias("direction"),
        ))

    both = F.array(entry("input_interface", "input"), entry("output_interface", "output"))
    return _two_sided(flows, seconds, both, KEYS["interface"])


def rollup_protocol(flows: DataFrame, seconds: int) -> DataFrame:
    return _rollup(flows.where("protocol IS NOT NULL"), seconds, [F.col("protocol")], ["protocol"])


# One wide key for every dimension, so that a single scan and a single shuffle
# feed all tables.
_WIDE = {
    "dimension": "string", "family": "int", "hi": "bigint", "lo": "bigint", "prefix_len": "int",
    "number": "bigint", "label": "string", "direction": "string",
}


def _wide_key(dimension: str, **given: Column) -> Column:
    given["dimension"] = F.lit(dimension)
    return F.struct(*[given.get(n, F.lit(None)).cast(t).alias(n) for n, t in _WIDE.items()])


def _address_keys(fam: Column, hi: Column, lo: Column, hostgroup: Column, lengths4, lengths6) -> list[Column]:
    """The dimensions that follow from one address alone."""
    keys = [
        _wide_key("host", family=fam, hi=hi, lo=lo),
        F.when(fam == 4, _wide_key("slash24", family=fam, hi=F.lit(0), lo=lo.bitwiseAND(F.lit(net.mask_halves(4, 24)[1])))),
        F.when(hostgroup.isNotNull(), _wide_key("hostgroup", label=hostgroup)),
    ]
    for family, n in [(4, n) for n in lengths4] + [(6, n) for n in lengths6]:
        mask_hi, mask_lo = net.mask_halves(family, n)
        keys.append(F.when(fam == family, _wide_key(
            "network", family=fam, hi=hi.bitwiseAND(F.lit(mask_hi)), lo=lo.bitwiseAND(F.lit(mask_lo)), prefix_len=F.lit(n))))
    return keys


def _device_keys(fam: Column, exporter: Column, protocol: Column, incoming: Column, outgoing: Column) -> list[Column]:
    """The dimensions of where and how a flow was seen."""
    keys = [_wide_key("total"), _wide_key("family", family=fam), _wide_key("exporter", label=exporter),
            F.when(protocol.isNotNull(), _wide_key("protocol", number=protocol))]
    for index, name in ((incoming, "input"), (outgoing, "output")):
        keys.append(F.when(index.isNotNull(), _wide_key("interface", label=exporter, number=index, direction=F.lit(name))))
    return keys


def _asn_key(asn: Column) -> Column:
    return F.when(asn.isNotNull(), _wide_key("asn", number=asn))


def rollup_all(classified: DataFrame, seconds: int, lengths4: list[int] = (), lengths6: list[int] = ()) -> DataFrame:
    """All dimensions from one scan.

    A batch aggregates each flow at five fine keys first (two hosts, two ASNs, one
    device) and derives every other dimension from those sums: a /24, a network
    or a hostgroup is a sum over its hosts. A stream aggregates once, flow by flow.
    """
    if classified.isStreaming:
        return _all_at_once(classified, seconds, lengths4, lengths6)
    fine = _fine_sums(classified, seconds)
    col = F.col
    keys = {
        _HOST: _address_keys(col("family"), col("hi"), col("lo"), col("label"), lengths4, lengths6),
        _ASN: [_asn_key(col("number"))],
        _DEVICE: _device_keys(col("family"), col("label"), col("protocol"), col("number"), col("number2")),
    }
    derived = F.array(*[F.when(col("kind") == kind, key) for kind, listed in keys.items() for key in listed])
    return _sum_wide(fine.select("_w", derived.alias("_keys"), *COUNTERS), COUNTERS, COUNTERS)


_HOST, _ASN, _DEVICE = 0, 1, 2
_FINE = {"kind": "int", "family": "int", "hi": "bigint", "lo": "bigint", "label": "string", "number": "bigint", "number2": "bigint", "protocol": "int"}


def _fine_sums(classified: DataFrame, seconds: int) -> DataFrame:
    def key(kind: int, **given: Column) -> Column:
        given["kind"] = F.lit(kind)
        return F.struct(*[given.get(n, F.lit(None)).cast(t).alias(n) for n, t in _FINE.items()])

    col = F.col
    keys = [key(_DEVICE, family=col("family"), label=col("exporter"), number=col("input_interface"), number2=col("output_interface"), protocol=col("protocol"))]
    for side in ("src", "dst"):
        fam, hi, lo = _side_address(side)
        keys.append(key(_HOST, family=fam, hi=hi, lo=lo, label=col(f"{side}_hostgroup")))
        keys.append(F.when(col(f"{side}_asn").isNotNull(), key(_ASN, number=col(f"{side}_asn"))))
    exploded = classified.select(window_key(classified, seconds), F.explode(F.array(*keys)).alias("_key"), *RAW).where("_key IS NOT NULL")
    named = exploded.select("_w", *[F.col(f"_key.{n}").alias(n) for n in _FINE], *contributions())
    return named.groupBy("_w", *_FINE).agg(*sums())


def _sum_wide(keyed: DataFrame, carried: list, values: list) -> DataFrame:
    exploded = keyed.select("_w", F.explode("_keys").alias("_key"), *carried).where("_key IS NOT NULL")
    wide = exploded.select("_w", *[F.col(f"_key.{n}").alias(n) for n in _WIDE], *values)
    return finish_window(wide.groupBy("_w", *_WIDE).agg(*sums()))


def _all_at_once(classified: DataFrame, seconds: int, lengths4, lengths6) -> DataFrame:
    col = F.col
    keys = _device_keys(col("family"), col("exporter"), col("protocol"), col("input_interface"), col("output_interface"))
    for side in ("src", "dst"):
        keys += _address_keys(*_side_address(side), col(f"{side}_hostgroup"), lengths4, lengths6)
        keys.append(_asn_key(col(f"{side}_asn")))
    return _sum_wide(classified.select(window_key(classified, seconds), F.array(*keys).alias("_keys"), *RAW), RAW, contributions())


def dimension_of(wide: DataFrame, dimension: str, keep: list[str] = ()) -> DataFrame:
    """One dimension of ``rollup_all`` in the shape its own rollup has."""
    df = wide.where(F.col("dimension") == dimension)
    shapes = {
        "total": [], "family": ["family"], "protocol": [F.col("number").cast("int").alias("protocol")],
        "host": ["family", "hi", "lo", net.address_text(F.col("family"), F.col("hi"), F.col("lo")).alias("address")],
        "slash24": ["lo", net.ipv4_text(F.col("lo")).alias("address")],
        "network": ["family", "hi", "lo", "prefix_len",
                    net.address_text(F.col("family"), F.col("hi"), F.col("lo")).alias("address")],
        "hostgroup": [F.col("label").alias("hostgroup")], "asn": [F.col("number").alias("asn")],
        "exporter": [F.col("label").alias("exporter")],
        "interface": [F.col("label").alias("exporter"), F.col("number").alias("interface_index"), "direction"],
    }
    return df.select("window_start", *shapes[dimension], *COUNTERS, *keep)


def cap_dimension(flows: DataFrame, keys: list[str], max_entries: int, seconds: int) -> DataFrame:
    """The most recently updated keys of each window, at most ``max_entries``.

    This is the bound a resident process keeps for its memory. Spark spills, so
    rollups are uncapped unless a caller asks.
    """
    latest = finish_window(flows.groupBy(window_key(flows, seconds), *keys).agg(F.max("ts").alias("last_update")))
    return first_rows(latest, ["window_start"], [F.desc("last_update"), *keys], max_entries, "recency")


def active_entities(classified: DataFrame, asof: Column, ttl_seconds: int = 300,
                    lengths4: list[int] = (24,), lengths6: list[int] = ()) -> DataFrame:
    """Distinct hosts, networks, hostgroups and ASNs seen within the inactivity TTL."""
    oldest = asof - F.expr(f"INTERVAL {ttl_seconds} SECONDS")
    recent = classified.where((F.col("ts").cast("timestamp") >= oldest) & (F.col("ts").cast("timestamp") <= asof))
    entries = []
    for side in ("src", "dst"):
        fam, hi, lo = _side_address(side)
        keyed = lambda kind, *parts: F.struct(
            F.lit(kind).alias("entity"), *[p.cast("string").alias(f"k{i}") for i, p in enumerate(parts)])
        entries.append(keyed("host", fam, hi, lo, F.lit("")))
        for family, n in [(4, n) for n in lengths4] + [(6, n) for n in lengths6]:
            mask_hi, mask_lo = net.mask_halves(family, n)
            entries.append(F.when(fam == family, keyed(
                "network", fam, hi.bitwiseAND(F.lit(mask_hi)), lo.bitwiseAND(F.lit(mask_lo)), F.lit(n))))
        for kind, column in (("hostgroup", f"{side}_hostgroup"), ("asn", f"{side}_asn")):
            entries.append(F.when(F.col(column).isNotNull(),
                                  keyed(kind, F.col(column), F.lit(""), F.lit(""), F.lit(""))))
    keys = recent.select(F.explode(F.array(*entries)).alias("e")).where("e IS NOT NULL")
    distinct = keys.select("e.*").distinct()
    return distinct.groupBy("entity").agg(F.count(F.lit(1)).alias("active"))


# --- rate windows -----------------------------------------------------------

RATE_WINDOWS = [1, 5, 15, 60, 300]


def rate_windows(flows: DataFrame, durations: list[int] = tuple(RATE_WINDOWS), asof: Column | None = None,
                 spine_chunk: int = 3600) -> DataFrame:
    """Finished tumbling windows per duration, with zeros between traffic.

    Flows are read once into buckets of the durations' common divisor; the
    longer windows add buckets up. The spine of empty windows is made in chunks,
    so that no single row holds a whole range.
    """
    from math import gcd

    base = gcd(*durations)
    epoch = F.unix_timestamp(F.col("ts").cast("timestamp"))
    buckets = flows.select(
        (F.floor(epoch / base) * base).cast("bigint").alias("t"), F.col("ts").cast("timestamp").alias("ts"),
        F.col("bytes").cast("bigint").alias("bytes"), F.col("packets").cast("bigint").alias("packets"),
    ).groupBy("t").agg(
        saturating_sum("bytes"), saturating_sum("packets"), F.count(F.lit(1)).alias("flows"), F.max("ts").alias("newest"),
    )
    sized = buckets.withColumn("duration", F.explode(F.array(*[F.lit(d).cast("bigint") for d in durations])))
    sized = sized.withColumn("window_start", F.col("t") - F.col("t") % F.col("duration"))
    filled = sized.groupBy("duration", "window_start").agg(
        saturating_sum("bytes"), saturating_sum("packets"), saturating_sum("flows"), F.max("newest").alias("newest")
    )
    end = F.unix_timestamp(asof) if asof is not None else F.unix_timestamp(F.max("newest"))
    ranges = filled.groupBy("duration").agg(F.min("window_start").alias("low"), F.max("window_start").alias("high"),
                                            end.alias("now"))
    chunks = ranges.withColumn("chunk", F.explode(F.sequence(
        F.lit(0).cast("bigint"), F.floor((F.col("high") - F.col("low")) / (F.col("duration") * spine_chunk)).cast("bigint"))))
    start = F.col("low") + F.col("chunk") * F.col("duration") * spine_chunk
    stop = F.least(F.col("high"), start + F.col("duration") * (spine_chunk - 1))
    spine = chunks.select("duration", "now", start.alias("start"), stop.alias("stop"))
    spine = spine.repartition("duration", "start").select(
        "duration", "now", F.explode(F.sequence("start", "stop", "duration")).alias("window_start")
    )
    spine = spine.where(F.col("window_start") + F.col("duration") <= F.col("now")).drop("now")
    rate = lambda c, scale=1: F.coalesce(F.col(c), F.lit(0)).cast("double") * scale / F.col("duration")
    joined = spine.join(filled.drop("newest"), ["duration", "window_start"], "left")
    return joined.select(
        "duration", "window_start", rate("bytes", 8).alias("bps"), rate("packets").alias("pps"), rate("flows").alias("fps")
    )
