"""Fixed vocabularies: protocols, metrics, severities, states and legal edges."""

from __future__ import annotations

from itertools import chain

from pyspark.sql import Column
from pyspark.sql import functions as F

# --- fixed values -----------------------------------------------------------

ICMP, TCP, UDP, ICMPV6 = 1, 6, 17, 58
PROTOCOL_NAMES = {1: "ICMP", 6: "TCP", 17: "UDP", 58: "ICMPv6"}
TCP_SYN_BIT = 0x02

# metric -> (unit, completeness flag that must have been seen, or None)
METRICS = {
    "bps": ("bps", None),
    "pps": ("pps", None),
    "fps": ("fps", None),
    "tcpBps": ("bps", "protocol"),
    "tcpPps": ("pps", "protocol"),
    "udpBps": ("bps", "protocol"),
    "udpPps": ("pps", "protocol"),
    "icmpBps": ("bps", "protocol"),
    "icmpPps": ("pps", "protocol"),
    "tcpSynBps": ("bps", "tcpFlags"),
    "tcpSynPps": ("pps", "tcpFlags"),
    "fragmentedBps": ("bps", "fragmentation"),
    "fragmentedPps": ("pps", "fragmentation"),
    "droppedBps": ("bps", "forwardingStatus"),
    "droppedPps": ("pps", "forwardingStatus"),
}
METRIC_ORDER = list(METRICS)
COMPLETENESS_FLAGS = ["protocol", "tcpFlags", "fragmentation", "forwardingStatus"]

SEVERITIES = ["info", "minor", "major", "critical"]
PRIORITIES = {"critical": "P1", "major": "P2", "minor": "P3", "info": "P4"}
DIRECTIONS = ["incoming", "outgoing", "internal", "other", "unknown"]

SCOPE_SPECIFICITY = {"host": 40, "prefix": 30, "slash24": 20, "hostgroupTotal": 10}
ACTION_BY_MODE = {"observe": "observed", "alertOnly": "alerted", "dryRun": "dryRun"}

DETECTION_EDGES = [
    ("idle", "pendingTrigger"),
    ("idle", "active"),
    ("pendingTrigger", "active"),
    ("pendingTrigger", "idle"),
    ("active", "pendingClear"),
    ("active", "cooldown"),
    ("active", "idle"),
    ("pendingClear", "active"),
    ("pendingClear", "cooldown"),
    ("pendingClear", "idle"),
    ("cooldown", "idle"),
]

INCIDENT_ACTIVE = ["open", "acknowledged", "investigating", "monitoring"]
INCIDENT_STATES = INCIDENT_ACTIVE + ["recovering", "resolved", "closed"]
AUTOMATIC_EDGES = (
    [(s, "recovering") for s in INCIDENT_ACTIVE]
    + [("recovering", "resolved")]
    + [("recovering", s) for s in INCIDENT_ACTIVE]
    + [("resolved", "closed"), ("resolved", "open"), ("closed", "open")]
)
OPERATOR_EDGES = (
    [("open", "acknowledged")]
    + [(s, "investigating") for s in ("open", "acknowledged", "monitoring")]
    + [("acknowledged", "monitoring"), ("investigating", "monitoring")]
    + [(s, "resolved") for s in INCIDENT_ACTIVE + ["recovering"]]
    + [("resolved", "closed"), ("resolved", "open"), ("closed", "open")]
)

MITIGATION_WAITING = ["proposed", "requested"]
MITIGATION_LIVE = MITIGATION_WAITING + ["approved", "announcing", "active", "withdrawing"]
MITIGATION_ENDED = ["withdrawn", "rejected", "expired", "failed"]
MITIGATION_EDGES = [
    (waiting, ended) for waiting in MITIGATION_WAITING for ended in ("approved", "rejected", "expired")
] + [
    ("approved", "announcing"),
    ("approved", "withdrawn"),
    ("approved", "failed"),
    ("announcing", "active"),
    ("announcing", "failed"),
    ("announcing", "withdrawing"),
    ("active", "withdrawing"),
    ("withdrawing", "withdrawn"),
]

INT64_MAX = 2**63 - 1

# --- lookups as expressions -------------------------------------------------


def literal_map(values: dict) -> Column:
    return F.create_map(*[F.lit(x) for x in chain.from_iterable(values.items())])


def by_case(column: Column, values: dict, default=None) -> Column:
    """A dictionary lookup as one CASE, which stays inside generated code."""
    expression = F.lit(default)
    for key, value in reversed(list(values.items())):
        expression = F.when(column == F.lit(key), F.lit(value)).otherwise(expression)
    return expression


def protocol_name(column: Column) -> Column:
    return F.coalesce(by_case(column, PROTOCOL_NAMES), F.concat(F.lit("OTHER("), column, F.lit(")")))


def severity_rank(column: Column) -> Column:
    return by_case(column, {name: rank for rank, name in enumerate(SEVERITIES)})


def metric_ordinal(column: Column) -> Column:
    """1-based position in the metric order."""
    return by_case(column, {name: i + 1 for i, name in enumerate(METRIC_ORDER)})


def metric_unit(column: Column) -> Column:
    return by_case(column, {name: unit for name, (unit, _) in METRICS.items()})


def required_flag(column: Column) -> Column:
    """The completeness flag a metric needs, NULL when it needs none."""
    return by_case(column, {name: flag for name, (_, flag) in METRICS.items() if flag})


def default_priority(severity: Column) -> Column:
    return by_case(severity, PRIORITIES)

# Metrics that make a transport family, and categories in the order
# in which they are tried once fewer than two families take part.
CATEGORY_FAMILIES = [
    ["tcpBps", "tcpPps", "tcpSynBps", "tcpSynPps"],
    ["udpBps", "udpPps"],
    ["icmpBps", "icmpPps"],
]
MANY_FAMILIES, NO_CATEGORY = "multi_vector", "unclassified"
CATEGORY_LADDER = [
    ("tcp_syn_flood", ["tcpSynBps", "tcpSynPps"]),
    ("fragmentation_flood", ["fragmentedBps", "fragmentedPps"]),
    ("icmp_flood", ["icmpBps", "icmpPps"]),
    ("udp_flood", ["udpBps", "udpPps"]),
    ("tcp_flood", ["tcpBps", "tcpPps"]),
    ("packet_rate", ["pps", "fps"]),
    ("bandwidth", ["bps"]),
    ("drop_pressure", ["droppedBps", "droppedPps"]),
]
