"""Mitigation work-lists: what may be done, what is due, what is out of step.

Nothing here touches a device; the tables are for a person or another system.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from ..functions import net
from ..functions.vocab import INCIDENT_ACTIVE, MITIGATION_EDGES, MITIGATION_ENDED, MITIGATION_LIVE, MITIGATION_WAITING
from .joins import earliest_of_others, longest_prefix_match

FLOORS = {4: 16, 6: 32}
GUARD = {"kill_switch": False, "min_length_4": 24, "min_length_6": 48, "max_duration_seconds": 3600, "approval_window_seconds": 900}
DURATION_BOUNDS = (60, 7 * 86_400)
APPROVAL_BOUNDS = (60, 86_400)
MAX_RATE_BYTES = 12_500_000_000
PAGE = 500
# Columns that may hold a flow match; one that is absent counts as unset.
MATCH = ("match_protocol", "match_source", "match_source_port", "match_destination_port")


def guard_check(requests: DataFrame, allowlist: DataFrame, source_len: str | None = None, **config) -> DataFrame:
    """Add ``refusal``: the code of the first rule that says no, NULL when allowed.

    Requests: tenant, family, hi, lo, prefix_len, action, duration_seconds.
    The most specific entry covering the whole requested prefix decides.
    """
    config = {**GUARD, **config}
    matched = longest_prefix_match(requests, allowlist, {"_entry": ("family", "hi", "lo", "prefix_len")}, ["tenant", "actions"])
    entry = F.col("_entry")
    host = F.col("prefix_len") == net.width(F.col("family"))
    shortest = F.when(F.col("family") == 4, F.lit(config["min_length_4"])).otherwise(F.lit(config["min_length_6"]))
    wide = ~host & (F.col("prefix_len") < shortest)
    if source_len:
        wide = wide | F.coalesce(F.col(source_len) == 0, F.lit(False))
    refusal = (
        F.when(F.lit(config["kill_switch"]), "mitigation.kill_switch")
        .when(entry.isNull() | (entry["tenant"] != F.col("tenant")), "mitigation.not_allowlisted")
        .when(~F.array_contains(entry["actions"], F.col("action")), "mitigation.action_not_allowed")
        .when(wide, "mitigation.too_wide")
        .when(F.col("duration_seconds") > config["max_duration_seconds"], "mitigation.too_long")
    )
    return matched.select(*requests.columns, refusal.alias("refusal"))


def validate_guard_config(configs: DataFrame) -> DataFrame:
    """Add ``error_code`` to rows of min_length_4/6, max_duration_seconds, approval_window_seconds."""
    between = lambda c, low, high: F.col(c).between(low, high)
    code = (
        F.when(~between("min_length_4", FLOORS[4], 32) | ~between("min_length_6", FLOORS[6], 128), "min_length")
        .when(~between("max_duration_seconds", *DURATION_BOUNDS), "max_duration")
        .when(~between("approval_window_seconds", *APPROVAL_BOUNDS), "approval_window")
    )
    return configs.withColumn("error_code", code)


def validate_allowlist(entries: DataFrame) -> DataFrame:
    """Errors of an allowlist (``position`` orders it): too wide, empty, or overlapping another tenant's."""
    floor = F.when(F.col("family") == 4, F.lit(FLOORS[4])).otherwise(F.lit(FLOORS[6]))
    code = F.when(F.col("prefix_len") < floor, "entry_too_wide").when(
        (F.trim("tenant") == "") | (F.size("actions") <= 0), "entry_empty")
    own = entries.select("position", code.alias("error_code")).where("error_code IS NOT NULL")
    nested = earliest_of_others(entries, "position", "tenant").where("other < position")
    hi, lo = net.masked(F.col("family"), F.col("net_hi"), F.col("net_lo"), F.col("prefix_len"))
    same = entries.groupBy("family", "prefix_len", hi.alias("hi"), lo.alias("lo")).agg(
        F.count_distinct("tenant").alias("tenants"), F.max("position").alias("position")).where("tenants > 1")
    overlaps = nested.select("position").unionByName(same.select("position")).distinct().withColumn("error_code", F.lit("overlap"))
    return own.unionByName(overlaps)


def action_error() -> Column:
    """Structural error of (action, prefix, match, rate); NULL when sound."""
    action = F.col("action")
    host = F.col("prefix_len") == net.width(F.col("family"))
    flowspec = action.isin("flowspec_discard", "flowspec_rate_limit")
    has_match = F.coalesce("match_protocol", "match_source_port", "match_destination_port").isNotNull() | F.col("match_source_family").isNotNull()
    rate = F.col("bytes_per_second")
    ports = F.coalesce("match_source_port", "match_destination_port").isNotNull()
    return (
        F.when(~flowspec & (has_match | rate.isNotNull()), "not_flowspec")
        .when((action == "rtbh") & ~host, "rtbh_not_host")
        .when((action == "parent_prefix") & host, "parent_is_host")
        .when((action == "flowspec_discard") & rate.isNotNull(), "rate")
        .when((action == "flowspec_rate_limit") & ~F.coalesce(rate.between(1, MAX_RATE_BYTES), F.lit(False)), "rate")
        .when(ports & ~F.coalesce(F.col("match_protocol").isin(6, 17), F.lit(False)), "ports_without_transport")
        .when(F.col("match_source_family") != F.col("family"), "source_family")
    )


def validate_action(requests: DataFrame) -> DataFrame:
    return requests.withColumn("error_code", action_error())


def canonical_prefix_check(prefixes: DataFrame) -> DataFrame:
    """Prefixes with bits set below their length, and the prefix that was meant."""
    family, length = F.col("family"), F.col("prefix_len")
    hi, lo = net.masked(family, F.col("hi"), F.col("lo"), length)
    code = F.when(length > net.width(family), "length").when((hi != F.col("hi")) | (lo != F.col("lo")), "host_bits")
    meant = F.concat(net.address_text(family, hi, lo), F.lit("/"), length.cast("string"))
    return prefixes.withColumn("error_code", code).withColumn("intended", F.when(code == "host_bits", meant))


def canonical_match(protocol: Column, source: Column, source_port: Column, destination_port: Column) -> Column:
    """Stable text of a match: present parts only, in fixed order."""
    part = lambda name, value: F.coalesce(F.concat(F.lit(f"{name}="), value.cast("string"), F.lit(";")), F.lit(""))
    return F.concat(part("proto", protocol), part("src", source), part("sport", source_port), part("dport", destination_port))


def match_of(df: DataFrame) -> Column:
    """The canonical match of the columns of ``MATCH`` that ``df`` has."""
    return canonical_match(*(F.col(name) if name in df.columns else F.lit(None).cast("string") for name in MATCH))


def duplicate_key(match: Column | None = None) -> Column:
    """What a mitigation announces: its action, prefix and match, as text."""
    prefix = F.concat(net.address_text(F.col("family"), F.col("hi"), F.col("lo")), F.lit("/"), F.col("prefix_len").cast("string"))
    return F.concat_ws("|", "action", prefix, F.lit("") if match is None else match)


def with_duplicate_key(df: DataFrame) -> DataFrame:
    """Add ``duplicate_key``, the match included where the action is a flow rule."""
    match = F.when(F.col("action").isin("flowspec_discard", "flowspec_rate_limit"), match_of(df)).otherwise("")
    return df.withColumn("duplicate_key", duplicate_key(match))


def duplicate_mitigations(mitigations: DataFrame) -> DataFrame:
    live = with_duplicate_key(mitigations.where(F.col("state").isin(*MITIGATION_LIVE)))
    return live.groupBy("duplicate_key").agg(F.count(F.lit(1)).alias("live")).where("live > 1")


def proposal_candidates(incidents: DataFrame, mitigations: DataFrame, allowlist: DataFrame, asof: Column, severities: list[str],
                        within_seconds: int, duration_seconds: int, limit: int | None = None, **config) -> DataFrame:
    """Fresh, unmitigated incoming host incidents the guard lets a blackhole be proposed for.

    Hosts of either family, read from ``target_id``. A ``limit`` takes the oldest
    of those that the guard allows.
    """
    opened = F.col("opened_at").cast("timestamp")
    fresh = incidents.where(
        (F.col("target_type") == "host") & (F.col("direction") == "incoming") & F.col("state").isin(*INCIDENT_ACTIVE)
        & F.col("severity").isin(*severities) & (opened >= asof - F.expr(f"INTERVAL {within_seconds} SECONDS")))
    bare = fresh.join(mitigations.select("incident_id"), "incident_id", "left_anti").withColumn("_host", net.parse_address(F.col("target_id")))
    asked = bare.where("_host IS NOT NULL").select(
        "incident_id", F.col("tenant_id").alias("tenant"), "severity", "opened_at", "_host.family", "_host.hi", "_host.lo",
        net.width(F.col("_host.family")).cast("int").alias("prefix_len"), F.lit("rtbh").alias("action"), F.lit(duration_seconds).alias("duration_seconds"))
    allowed = guard_check(asked, allowlist, **config).where("refusal IS NULL").drop("refusal")
    return allowed if limit is None else allowed.orderBy("opened_at", "incident_id").limit(limit)


def due_work(mitigations: DataFrame, asof: Column, approval_window_s: int = GUARD["approval_window_seconds"], kill_switch: bool = False) -> DataFrame:
    """Live mitigations, which of their clocks ran out, and the next step of each."""
    state = F.col("state")
    waiting = state.isin(*MITIGATION_WAITING)
    approval = waiting & (F.col("created_at") + F.expr(f"INTERVAL {approval_window_s} SECONDS") <= asof)
    duration = (state == "active") & F.coalesce(F.col("expires_at") <= asof, F.lit(False))
    kill = F.lit(kill_switch)
    step = (
        F.when(approval, "expire").when((state == "approved") & kill, "withdraw").when(state == "approved", "announce")
        .when(state.isin("announcing", "active") & kill, "take_down").when(duration, "take_down")
        .when(state == "announcing", "finish_announcing").when(state == "withdrawing", "take_down").otherwise("none")
    )
    live = mitigations.where(state.isin(*MITIGATION_LIVE))
    return live.withColumn("approval_expired", approval).withColumn("duration_reached", duration).withColumn("next_action", step)


def reconcile(owned_routes: DataFrame, mitigations: DataFrame) -> DataFrame:
    """Routes nobody claims (withdraw) and active mitigations without their route (restore)."""
    sent = with_duplicate_key(mitigations.where(F.col("state").isin("announcing", "active") & ~F.col("dry_run")))
    stale = owned_routes.join(sent.select("duplicate_key"), "duplicate_key", "left_anti").select("duplicate_key", F.lit("withdraw").alias("step"))
    missing = sent.where("state = 'active'").join(owned_routes.select("duplicate_key"), "duplicate_key", "left_anti")
    return stale.unionByName(missing.select("duplicate_key", F.lit("restore").alias("step")))


def peer_events(before: DataFrame, now: DataFrame) -> DataFrame:
    """What changed between two peer snapshots; a peer seen first is no news."""
    current = now.select("neighbor_address", F.col("peer_asn").alias("_asn"), F.col("session_state").alias("_state"))
    both = before.join(current, "neighbor_address", "left").withColumn("_now", F.coalesce("_state", F.lit("gone")))
    was, up = F.col("session_state") == "established", F.col("_now") == "established"
    kind = F.when(was & ~up, "bgp.peer_down").when(~was & up, "bgp.peer_up")
    return both.select("neighbor_address", F.coalesce("_asn", "peer_asn").alias("peer_asn"), kind.alias("event_type"),
                       F.col("_now").alias("session_state"), F.col("session_state").alias("previous_state")).where("event_type IS NOT NULL")


def list_mitigations(mitigations: DataFrame, tenant: str, which: str = "all", limit: int = PAGE, after: tuple | None = None) -> DataFrame:
    """A page of a tenant's mitigations, newest first: all, live, or those with a route out.

    ``after`` is the (created_at, mitigation_id) of the last row of the page
    before; ``has_more`` says whether another one follows.
    """
    df = mitigations.where(F.col("tenant_id") == tenant)
    if which == "live":
        df = df.where(~F.col("state").isin(*MITIGATION_ENDED))
    elif which == "routed":
        df = df.where(F.col("state").isin("announcing", "active", "withdrawing") & ~F.col("dry_run") & F.col("route").isNotNull())
    if after is not None:
        created, number = F.lit(after[0]).cast("timestamp"), F.lit(after[1])
        df = df.where((F.col("created_at") < created) | ((F.col("created_at") == created) & (F.col("mitigation_id") < number)))
    page = df.orderBy(F.desc("created_at"), F.desc("mitigation_id")).limit(limit + 1)
    place = F.row_number().over(Window.orderBy(F.desc("created_at"), F.desc("mitigation_id")))
    return page.withColumn("_place", place).withColumn("has_more", F.max("_place").over(Window.partitionBy()) > limit).where(F.col("_place") <= limit).drop("_place")


def mitigation_history(history: DataFrame, mitigation_id, tenant: str) -> DataFrame:
    mine = history.where((F.col("mitigation_id") == mitigation_id) & (F.col("tenant_id") == tenant))
    return mine.orderBy("version")


def guard_transitions(moves: DataFrame) -> DataFrame:
    """Add ``legal``: whether (from_state, to_state) is one of the fourteen edges."""
    test = F.lit(False)
    for a, b in MITIGATION_EDGES:
        test = test | ((F.col("from_state") == a) & (F.col("to_state") == b))
    return moves.withColumn("legal", test)


def list_peers(peers: DataFrame) -> DataFrame:
    return peers.orderBy("neighbor_address")
