"""Detection: evaluated snapshots to transitions, events and open detections."""

from __future__ import annotations

import json

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from ..functions.vocab import ACTION_BY_MODE, METRIC_ORDER, by_case, metric_unit
from .folds import ordered_fold
from .joins import lookup_join
from .machine import Scope
from .slices import SLICE, before, by_range, by_time
from .snapshots import SCOPE

STALE_AFTER_MS = 180_000
#: How much time of a scope is summed up in one row before its history is cut.
SLOT_MS = 900_000
#: Reasons of commands that stand for a change of the policies.
POLICY_ENDS = ("policyChanged", "policyWithdrawn")
EVENT_SCHEMA_VERSION = 1
REASON = "ARRAY<STRUCT<metric: STRING, observed: BIGINT, threshold: BIGINT, excess: BIGINT, ratio_percent: BIGINT>>"

OBSERVATIONS = [*METRIC_ORDER, "protocol_seen", "tcp_flags_seen", "fragmentation_seen", "forwarding_status_seen",
                "sampling_corrected", "sampling_used_global_default", "sampling_max_rate", "flows_observed", "exporters_observed"]
PAYLOAD = [*SCOPE, "scope_display", "policy_name", "severity", "mode", "labels", "policy_window_ms", "matched", "skipped",
           *OBSERVATIONS]
TIMERS = ["trigger_for_ms", "clear_for_ms", "cooldown_ms", "hold_down_ms", "event_update_ms"]
FOLD_INPUT = ["t", "newest", "is_snapshot", "over", "below", "crossed", "policy_id", "policy_version", *TIMERS, "payload"]
LOG_COLUMNS = (
    "record STRING, t BIGINT, from_state STRING, to_state STRING, reason STRING, kind STRING, sequence BIGINT, "
    "started BIGINT, peak STRING, snapshots BIGINT, in_previous BIGINT, policy_id STRING, policy_version BIGINT, "
    "closing BOOLEAN, payload STRING"
)
SKIPPED = "ARRAY<STRUCT<metric: STRING, reason: STRING>>"
PAYLOAD_TYPES = {
    "tenant": "STRING", "scope_type": "STRING", "family": "INT", "scope_hi": "BIGINT", "scope_lo": "BIGINT", "scope_len": "INT",
    "hostgroup": "STRING", "direction": "STRING", "scope_display": "STRING", "policy_name": "STRING", "severity": "STRING",
    "mode": "STRING", "labels": "MAP<STRING, STRING>", "policy_window_ms": "BIGINT", "matched": REASON, "skipped": SKIPPED,
    **{metric: "BIGINT" for metric in METRIC_ORDER},
    "protocol_seen": "BOOLEAN", "tcp_flags_seen": "BOOLEAN", "fragmentation_seen": "BOOLEAN", "forwarding_status_seen": "BOOLEAN",
    "sampling_corrected": "BOOLEAN", "sampling_used_global_default": "BOOLEAN", "sampling_max_rate": "BIGINT",
    "flows_observed": "BIGINT", "exporters_observed": "INT",
}
PAYLOAD_SCHEMA = ", ".join(f"{name} {kind}" for name, kind in PAYLOAD_TYPES.items())


def scope_key() -> Column:
    """One unambiguous text per scope: the free text comes last, after a length."""
    return F.concat(F.col("family").cast("string"), F.lit("|"), F.col("direction"), F.lit("|"), F.col("scope_type"), F.lit("|"),
                    F.length("tenant").cast("string"), F.lit(":"), F.col("tenant"), F.lit("|"), F.col("scope_display"))


def screen_snapshots(selected: DataFrame, arrival: str | None, disabled: str = "disabled") -> DataFrame:
    """Why a snapshot would be ignored, in arrival order if one is given; NULL when it counts.

    ``selected`` has the winner's ``mode`` and ``policy_window_ms``.
    """
    up_front = F.when(F.col("mode") == disabled, F.lit("modeDisabled")).when(
        F.col("window_ms") != F.col("policy_window_ms"), F.lit("windowMismatch"))
    if arrival is None:
        return selected.withColumn("ignored", up_front)
    screened = by_range(selected.withColumn("_early", up_front), SCOPE, arrival)
    screened = before(screened, SCOPE, [arrival], {"_newest": ("max", F.when(F.col("_early").isNull(), F.col("window_end")))})
    late = F.when(F.col("window_end") < F.col("_newest"), F.lit("outOfOrder")).when(F.col("window_end") == F.col("_newest"), F.lit("duplicate"))
    return screened.withColumn("ignored", F.coalesce("_early", late)).drop("_early", "_newest", SLICE)


def fold_rows(evaluated: DataFrame, keep: list[str] = (), as_text: bool = True) -> DataFrame:
    """Evaluated snapshots in the form the state machine takes.

    The payload is text for the fold; a batch keeps it a struct until the rows
    that need no fold are gone.
    """
    payload = F.struct(*PAYLOAD)
    watched = evaluated.where(F.col("mode") != "disabled").withColumn("scope_key", scope_key())
    return watched.select(
        "scope_key", F.unix_micros("window_end").alias("t"), F.lit(True).alias("is_snapshot"), "over",
        F.col("all_below_clear").alias("below"), F.when(F.col("over"), F.to_json("matched")).alias("crossed"),
        "policy_id", F.col("policy_version").cast("bigint").alias("policy_version"), *TIMERS,
        (F.to_json(payload) if as_text else payload).alias("payload"), *keep,
    )


def reset_rows(resets: DataFrame, keep: list[str] = ()) -> DataFrame:
    """Commands in the form the state machine takes: a row carries its reason in place of a policy."""
    return resets.withColumn("scope_key", scope_key()).select(
        "scope_key", F.unix_micros(F.col("at").cast("timestamp")).alias("t"), F.lit(False).alias("is_snapshot"),
        F.col("reason").alias("policy_id"), *keep)


def episodes(rows: DataFrame, stale_after_ms: int = STALE_AFTER_MS, slot_ms: int = SLOT_MS) -> DataFrame:
    """Cut each scope's history where its state is certainly idle, and keep only
    the stretches from a first crossing on.

    History is cut between slots of ``slot_ms`` of time, each of which is first
    summed up in one row: its first and last snapshot, first crossing, whether all of it was
    quiet under one policy. Two cuts are exact: before a slot that begins more than
    ``stale_after_ms`` after the last snapshot, and after quiet slots of one policy that
    lasted so long that hold-down, clearing and cooldown must all have run out (each
    may wait for one more row, hence the slack). Only slot rows of a scope are
    ordered together, so a long history of one scope is cut, and then folds, in
    parallel. Scopes that never cross leave no rows.
    """
    stale = stale_after_ms * 1000
    rows = by_time(rows, F.col("t"), slot_ms)
    snap = F.col("is_snapshot")
    at_snap = lambda value: F.when(snap, value)
    policy = F.struct("policy_id", "policy_version")
    wait = (F.col("hold_down_ms") + F.col("clear_for_ms") + F.col("cooldown_ms")) * 1000 + 4 * stale
    slots = rows.groupBy("scope_key", SLICE).agg(
        F.min(at_snap(F.col("t"))).alias("first_t"), F.max(at_snap(F.col("t"))).alias("last_t"),
        F.min(F.when(snap & F.col("over"), F.col("t"))).alias("crossed_t"), F.bool_and(at_snap(F.col("below") & ~F.col("over"))).alias("quiet"),
        F.struct(F.min(at_snap(policy)).alias("low"), F.max(at_snap(policy)).alias("high")).alias("policies"), F.max(at_snap(wait)).alias("wait"))
    order = Window.partitionBy("scope_key").orderBy(SLICE)
    upto, earlier = order.rowsBetween(Window.unboundedPreceding, 0), order.rowsBetween(Window.unboundedPreceding, -1)
    known = F.col("first_t").isNotNull()
    slots = slots.withColumn("_prev_t", F.last("last_t", True).over(earlier)).withColumn("_prev_policies", F.last(F.when(known, F.col("policies")), True).over(earlier))
    slots = slots.withColumn("_gap", known & (F.col("_prev_t").isNull() | (F.col("first_t") - F.col("_prev_t") > stale)))
    calm = known & ~F.col("_gap") & F.col("quiet") & (F.col("policies.low") == F.col("policies.high")) & (F.col("policies") == F.col("_prev_policies"))
    slots = slots.withColumn("_calm", F.coalesce(calm, F.lit(False)))
    slots = slots.withColumn("_since", F.last(F.when(known & ~F.col("_calm"), F.col("last_t")), True).over(upto))
    rested = lambda t: F.col("_calm") & (F.col(t) - F.col("_since") > F.col("wait"))
    slots = slots.withColumn("_settled", F.coalesce(rested("first_t"), F.lit(False)))
    was_rested = F.coalesce(F.last(F.when(known, rested("last_t")), True).over(earlier), F.lit(False))
    slots = slots.withColumn("_starts", F.col("_gap") | (known & ~F.col("_settled") & was_rested))
    slots = slots.withColumn("episode", F.sum(F.col("_starts").cast("bigint")).over(upto))
    slots = slots.withColumn("_crossed", F.min("crossed_t").over(Window.partitionBy("scope_key", "episode")))
    # A command ahead of the first snapshot of a slot that starts an episode still meets the one before.
    slots = slots.withColumn("_crossed_before", F.when(F.col("_starts"), F.lag("_crossed").over(order)))
    # The scope's newest snapshot closes an episode that ends in a gap.
    slots = slots.withColumn("newest", F.max("last_t").over(Window.partitionBy("scope_key")))
    live = slots.where("NOT _settled AND (_crossed IS NOT NULL OR _crossed_before IS NOT NULL)").select(
        F.col("scope_key").alias("_key"), F.col(SLICE).alias("_slot"), "episode", "newest", "first_t", "_starts", "_crossed", "_crossed_before")
    joined = rows.join(live, (F.col("scope_key") == F.col("_key")) & (F.col(SLICE) == F.col("_slot")))
    early = F.coalesce(F.col("policy_id").isin(*POLICY_ENDS), F.lit(False))
    ahead = F.col("_starts") & ~snap & ((F.col("t") < F.col("first_t")) | (early & (F.col("t") == F.col("first_t"))))
    joined = joined.withColumn("_ahead", ahead)
    joined = joined.withColumn("episode", F.col("episode") - F.col("_ahead").cast("bigint"))
    return joined.where(F.col("t") >= F.when(F.col("_ahead"), F.col("_crossed_before")).otherwise(F.col("_crossed"))).select(
        *[c for c in rows.columns if c != SLICE], "episode", "newest")


def in_turn() -> Column:
    """What goes first at one instant: a change of policies, the snapshot, then a command."""
    return F.when(F.col("is_snapshot"), F.lit(1)).when(F.col("policy_id").isin(*POLICY_ENDS), F.lit(0)).otherwise(F.lit(2))


class _EpisodeFold:
    """Drives one scope's machine over one episode."""

    def __init__(self, stale_after, asof):
        self.scope, self.stale_after, self.asof, self.newest = Scope(), stale_after, asof, None

    def row(self, t, newest, is_snapshot, over, below, crossed, policy_id, version, trigger, clear, cooldown, hold, update, payload):
        t, self.newest = int(t), int(newest)
        self.scope.sweep(t, self.stale_after, inclusive=False)
        if is_snapshot:
            timers = [int(x) * 1000 for x in (trigger, clear, cooldown, hold, update)]
            self.scope.snapshot(t, over, below, json.loads(crossed) if crossed else [], (policy_id, int(version), *timers), payload)
        else:
            self.scope.end(t, policy_id)  # a command row carries its reason here
        return self.scope.drain()

    def finish(self):
        if self.newest is not None:
            self.scope.sweep(self.newest, self.stale_after, inclusive=False)
        if self.asof is not None:
            self.scope.sweep(self.asof, self.stale_after)
        self.scope.final()
        return self.scope.drain()


def detect(evaluated: DataFrame, asof: int | None = None, resets: DataFrame | None = None,
           stale_after_ms: int = STALE_AFTER_MS) -> DataFrame:
    """The detection log: transitions, events, suppressions and final states.

    ``asof`` (epoch seconds) is the clock that closes scopes gone quiet by then.
    ``resets`` are commands: the scope columns, ``scope_display``, ``at`` and
    ``reason`` (``manualReset`` of an operator; ``policyChanged`` or
    ``policyWithdrawn`` from ``timeline.policy_ends``, which go before a snapshot of the same instant).
    """
    rows = fold_rows(evaluated, as_text=False)
    if resets is not None:
        rows = rows.unionByName(reset_rows(resets), allowMissingColumns=True)
    stale, clock = stale_after_ms * 1000, None if asof is None else asof * 1_000_000
    schema = f"scope_key STRING, episode BIGINT, {LOG_COLUMNS}"
    cut = episodes(rows, stale_after_ms).withColumn("_turn", in_turn()).withColumn("payload", F.to_json("payload"))
    return ordered_fold(cut, ["scope_key", "episode"], ["t", "_turn"], FOLD_INPUT,
                        lambda *_: _EpisodeFold(stale, clock), schema)


# --- events -----------------------------------------------------------------


def worst(reasons: Column) -> Column:
    """The reason with the highest ratio; the later one on a tie; NULL on none."""
    ranked = F.transform(reasons, lambda r, i: F.struct(r["ratio_percent"].alias("ratio"), i.alias("i"), r.alias("r")))
    return F.array_max(ranked)["r"]


def _text(*parts) -> Column:
    return F.concat(*[F.lit(p) if isinstance(p, str) else p.cast("string") for p in parts])


def summary() -> Column:
    subject = _text(F.col("direction"), " ", F.col("scope_type"), " ", F.col("target"))
    seconds = F.floor(F.col("duration_ms") / 1000)
    policy = F.col("policy_id")
    now, peak = F.col("_worst_now"), F.col("_worst_peak")
    seen = lambda r: _text(r["observed"], " ", metric_unit(r["metric"]), " (", r["ratio_percent"], "% of the ",
                           r["metric"], " threshold)")
    best = F.coalesce(now, peak)
    opening = _text(F.col("severity"), " ", F.col("kind"), ": ", subject)
    ended = _text("ended: ", subject, " after ", seconds, "s")
    return (
        F.when(F.col("closing"), _text("ended (", F.col("reason"), "): ", subject, " after ", seconds, "s under policy ", policy))
        .when(F.col("kind") == "ended", F.when(peak.isNull(), _text(ended, " under policy ", policy))
              .otherwise(_text(ended, ", peaking at ", seen(peak), " under policy ", policy)))
        .otherwise(F.when(best.isNull(), _text(opening, " under policy ", policy))
                   .otherwise(_text(opening, " at ", seen(best), " under policy ", policy)))
    )


def detection_events(log: DataFrame) -> DataFrame:
    """Events of the log with deterministic ids: a rerun makes the same ones."""
    df = log.where("record = 'event'").withColumn("p", F.from_json("payload", PAYLOAD_SCHEMA))
    zeroed = {"BIGINT": F.lit(0).cast("bigint"), "BOOLEAN": F.lit(False), "INT": F.lit(0)}
    closed = F.col("closing")
    observed = [
        F.when(closed, zeroed[PAYLOAD_TYPES[c]]).otherwise(F.col(f"p.{c}")).alias(c) for c in OBSERVATIONS
    ]
    none = lambda c: F.when(closed, F.array().cast(PAYLOAD_TYPES[c])).otherwise(F.col(f"p.{c}")).alias(c)
    detection_id = F.substring(F.sha2(F.concat_ws("|", "scope_key", F.col("started").cast("string")), 256), 1, 32)
    df = df.select(
        F.lit(EVENT_SCHEMA_VERSION).alias("schema_version"), detection_id.alias("detection_id"), "sequence", "kind", "policy_id",
        F.col("p.policy_name").alias("policy_name"), "policy_version", F.col("p.severity").alias("severity"),
        F.col("p.mode").alias("execution_mode"), by_case(F.col("p.mode"), ACTION_BY_MODE).alias("action"), F.col("p.labels").alias("labels"),
        *[F.col(f"p.{c}").alias(c) for c in SCOPE], F.col("p.scope_display").alias("target"),
        F.col("from_state").alias("previous_state"), F.col("to_state").alias("state"), "reason",
        F.timestamp_micros("started").alias("detected_at"), F.timestamp_micros("t").alias("observed_at"),
        F.floor((F.col("t") - F.col("started")) / 1000).alias("duration_ms"), F.col("p.policy_window_ms").alias("window_ms"),
        none("matched"), F.from_json("peak", REASON).alias("peak"), none("skipped"), *observed,
        F.col("snapshots").alias("snapshots_in_detection"), F.lit(False).alias("executed"), "closing",
    )
    df = df.withColumn("dedup_key", _text(F.col("detection_id"), ":", F.col("kind"), ":", F.col("sequence")))
    df = df.withColumn("event_id", F.substring(F.sha2(F.concat(F.lit("event|"), F.col("dedup_key")), 256), 1, 32))
    df = df.withColumn("_worst_now", worst(F.col("matched"))).withColumn("_worst_peak", worst(F.col("peak")))
    df = df.withColumn("summary", summary())
    return df.drop("_worst_now", "_worst_peak", "closing")


def publishable(events: DataFrame) -> DataFrame:
    """Events that leave the engine: alert and dry-run modes only."""
    return events.where(F.col("execution_mode").isin("alertOnly", "dryRun"))


def flatten_events(events: DataFrame) -> DataFrame:
    """The 54-column stored form, with the worst crossing in ``top_*``."""
    top = worst(F.concat("peak", "matched"))
    df = events.withColumn("_top", top)
    stored_rates = {
        "bps": "bps", "pps": "pps", "fps": "fps", "tcp_bps": "tcpBps", "tcp_pps": "tcpPps", "udp_bps": "udpBps", "udp_pps": "udpPps",
        "icmp_bps": "icmpBps", "icmp_pps": "icmpPps", "tcp_syn_pps": "tcpSynPps", "fragmented_pps": "fragmentedPps",
        "dropped_pps": "droppedPps",
    }
    second = lambda c: F.date_trunc("second", F.col(c))
    return df.select(
        second("observed_at").alias("timestamp"), second("detected_at").alias("detected_at"), "schema_version", "event_id", "detection_id",
        "dedup_key", "sequence", "kind", "policy_id", "policy_name", "policy_version", "severity", "execution_mode", "action", "tenant",
        "scope_type", "target", "direction", "family", "previous_state", "state", "reason", "duration_ms", "window_ms",
        F.coalesce("_top.metric", F.lit("")).alias("top_metric"),
        *[F.coalesce(f"_top.{c}", F.lit(0).cast("bigint")).alias(f"top_{c}") for c in ("observed", "threshold", "ratio_percent")],
        F.to_json("matched").alias("matched_json"), F.to_json("peak").alias("peak_json"),
        *[F.col(source).alias(name) for name, source in stored_rates.items()],
        *[F.col(c).cast("int").alias(c) for c in ("protocol_seen", "tcp_flags_seen", "fragmentation_seen", "forwarding_status_seen",
                                                  "sampling_corrected", "sampling_used_global_default")],
        "sampling_max_rate", "flows_observed", "exporters_observed", "snapshots_in_detection", F.col("executed").cast("int").alias("executed"),
        "summary",
    )


def open_detections(log: DataFrame) -> DataFrame:
    """Scopes left active or clearing at the end of the log, in key order."""
    finals = log.where("record = 'final'").groupBy("scope_key").agg(F.max_by(
        F.struct("to_state", "policy_id", "policy_version", "started", "t"), "episode").alias("f"))
    return finals.where(F.col("f.to_state").isin("active", "pendingClear")).select(
        "scope_key", F.col("f.to_state").alias("state"), "f.policy_id", "f.policy_version",
        F.timestamp_micros("f.started").alias("active_since"), F.timestamp_micros("f.t").alias("last_snapshot_at"))


def ignored_snapshots(selected: DataFrame, policies: DataFrame, arrival: str | None = None) -> DataFrame:
    """Snapshots with a winner and why each would be ignored (NULL: it counts).

    Mode and window are the snapshot's own matter; lateness and repeats are
    judged only where ``arrival`` gives the order in which snapshots came.
    """
    facts = policies.select("policy_id", F.col("version").alias("policy_version"), "mode", F.col("window_ms").alias("policy_window_ms"))
    watched = lookup_join(selected.where("policy_id IS NOT NULL"), facts, ["policy_id", "policy_version"], "inner")
    return screen_snapshots(watched, arrival)


def detection_report(selected: DataFrame, evaluated: DataFrame, log: DataFrame, policies: DataFrame | None = None, arrival: str | None = None) -> DataFrame:
    """Counts an operator watches: (measure, key, n).

    Each input is turned into (measure, key) pairs and all are counted at once;
    hand in ``selected`` and ``log`` cut off (``session.cut_lineage``), so that the
    flows are read and the machine is run once. Scopes that never crossed count as
    idle. With ``policies`` ignored snapshots are counted too.
    """
    pair = lambda measure, key: F.struct(F.lit(measure).alias("measure"), key.cast("string").alias("key"))
    matched = F.when(F.col("policy_id").isNull(), F.lit("unmatched")).otherwise(F.lit("matched"))
    record = F.col("record")
    logged = (
        F.when(record == "transition", pair("transition", F.concat_ws(">", "from_state", "to_state")))
        .when(record.isin("suppressed", "ignored"), F.struct(record.alias("measure"), F.col("reason").alias("key")))
        .when(record == "event", pair("event", F.col("kind")))
    )
    finals = log.where("record = 'final'").groupBy("scope_key").agg(F.max_by("to_state", "episode").alias("state"))
    scopes = evaluated.where(F.col("mode") != "disabled").select(scope_key().alias("scope_key")).distinct()
    states = scopes.join(finals, "scope_key", "left").select(pair("scope_state", F.coalesce("state", F.lit("idle"))).alias("m"))
    parts = [
        selected.select(pair("snapshots", matched).alias("m")), log.select(logged.alias("m")).where("m IS NOT NULL"), states,
        evaluated.select(F.explode(F.transform("skipped", lambda s: pair("skipped", s["metric"]))).alias("m")),
    ]
    if policies is not None:
        ignored = ignored_snapshots(selected, policies, arrival).where("ignored IS NOT NULL")
        parts.append(ignored.select(pair("ignored", F.col("ignored")).alias("m")))
    pairs = parts[0]
    for part in parts[1:]:
        pairs = pairs.unionByName(part)
    return pairs.groupBy("m.measure", "m.key").agg(F.count(F.lit(1)).alias("n"))
