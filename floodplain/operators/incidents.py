"""Incident correlation and the column-wise rules around it."""

from __future__ import annotations

import json

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from ..functions.vocab import AUTOMATIC_EDGES, CATEGORY_FAMILIES, CATEGORY_LADDER, INCIDENT_ACTIVE, MANY_FAMILIES, NO_CATEGORY, OPERATOR_EDGES, default_priority, severity_rank
from .case import Case, CasePolicy
from .detect import EVENT_SCHEMA_VERSION
from .folds import ordered_fold
from .joins import lookup_join, mark_first

KEY = ["tenant_id", "target_type", "target_id", "direction", "family"]
SILENT_AFTER_S, RECOVERY_S, CLOSURE_S = 300, 300, 1800

# --- gates ------------------------------------------------------------------


def dedup_events(events: DataFrame, order: list[str] = ("observed_at", "sequence", "event_id")) -> DataFrame:
    """First delivery of each (tenant, dedup_key)."""
    first = F.min_by(F.struct(*events.columns), F.struct(*order)).alias("e")
    return events.groupBy(F.col("tenant").alias("_t"), F.col("dedup_key").alias("_d")).agg(first).select("e.*")


def gate_events(events: DataFrame, order: list[str] = ("observed_at", "sequence", "event_id")) -> DataFrame:
    """``gate``: quarantined, duplicate, observeOnly, or NULL for events to correlate.

    The order of the rules is the order here; an event a rule took is not
    remembered as delivered.
    """
    forged = (F.col("schema_version") > EVENT_SCHEMA_VERSION) | F.col("executed")
    observed = F.col("action") == "observed"
    marked = mark_first(events.withColumn("_stopped", forged | observed), ["tenant", "dedup_key", "_stopped"], list(order))
    gate = F.when(forged, F.lit("quarantined")).when(observed, F.lit("observeOnly")).when(~F.col("_first"), F.lit("duplicate"))
    return marked.withColumn("gate", gate).drop("_first", "_stopped")


def route_by_tenant(events: DataFrame, tenants: DataFrame) -> tuple[DataFrame, DataFrame]:
    """(events of known tenants, counts of refused ones by tenant)."""
    known = lookup_join(events, tenants.select("tenant").distinct(), ["tenant"], "left_semi")
    unknown = lookup_join(events, tenants.select("tenant").distinct(), ["tenant"], "left_anti")
    return known, unknown.groupBy("tenant").agg(F.count(F.lit(1)).alias("refused"))


# --- the fold ---------------------------------------------------------------


def correlation_key() -> Column:
    return F.concat(F.col("family").cast("string"), F.lit("|"), F.col("direction"), F.lit("|"), F.col("scope_type"), F.lit("|"),
                    F.length("tenant").cast("string"), F.lit(":"), F.col("tenant"), F.lit("|"), F.col("target"))


EVENT_FACTS = ["event_id", "dedup_key", "detection_id", "kind", "reason", "severity", "policy_id", "policy_version", "sequence",
               "metrics", "summary"]
COMMAND_FACTS = ["command_id", "verb", "args", "incident_id", "expected_version", "actor"]
FOLD_INPUT = ["t", "newest", "is_event", "repeat", "any_commands", "body"]
OUT_SCHEMA = ("correlation_key STRING, segment BIGINT, record STRING, t BIGINT, n BIGINT, incident_id STRING, ref STRING, body STRING")


def case_rows(gated: DataFrame, commands: DataFrame | None = None, keep: list[str] = ()) -> DataFrame:
    """Events that pass the gate, and commands, in the form the fold takes."""
    events = gated.where(F.col("gate").isNull() | (F.col("gate") == "duplicate")).withColumn("correlation_key", correlation_key())
    events = events.withColumn("metrics", F.transform("matched", lambda r: r["metric"]))
    rows = events.select(
        "correlation_key", "tenant", F.unix_micros("observed_at").alias("t"), F.lit(True).alias("is_event"),
        (F.coalesce("gate", F.lit("")) == "duplicate").alias("repeat"), F.col("sequence").cast("bigint").alias("at_sequence"),
        F.col("event_id").alias("at_id"), (F.col("kind") == "ended").alias("ended"), "detection_id",
        F.to_json(F.struct(*EVENT_FACTS)).alias("body"), *keep,
    )
    return rows if commands is None else rows.unionByName(command_rows(commands))


def command_rows(commands: DataFrame, keep: list[str] = ()) -> DataFrame:
    """Operator commands in the same form."""
    return commands.withColumn("correlation_key", correlation_key()).select(
        "correlation_key", "tenant", F.unix_micros(F.col("at").cast("timestamp")).alias("t"), F.lit(False).alias("is_event"),
        F.lit(False).alias("repeat"), F.lit(None).cast("bigint").alias("at_sequence"), F.col("command_id").alias("at_id"),
        F.lit(False).alias("ended"), F.lit(None).cast("string").alias("detection_id"), F.to_json(F.struct(*COMMAND_FACTS)).alias("body"), *keep)


ORDER = ["t", "at_sequence", "at_id"]
ROWS_A_TASK = 250_000


def segments(rows: DataFrame, policy: CasePolicy, tasks: int) -> DataFrame:
    """Cut a key's history where the next event must open a new incident.

    That is certain after a pause in which every earlier incident has been
    resolved and left the reopen window, if the event is no ending, no earlier
    detection reaches past it, and no operator has touched the key before. A hot
    key then folds in parallel; a key with commands stays whole from the first
    command on.

    Decided on summaries of slots as long as that pause: a cut can only fall on
    the first row of a slot, so no key is ever ordered row by row here.
    """
    settled = policy.settled_after()
    whole = Window.partitionBy("correlation_key")
    slot = F.lit(0).cast("bigint") if settled is None else F.floor(F.col("t") / settled).cast("bigint")
    # As many tasks as rows ask for: these rows are much smaller when shuffled than when sorted, so no size in bytes tells.
    df = rows.withColumn("_slot", slot).repartition(tasks, "correlation_key", "_slot")
    head = F.struct(*ORDER, "is_event", "ended", "repeat")
    slots = df.groupBy("correlation_key", "_slot").agg(
        F.min(head).alias("_head"), F.max("t").alias("_last"), F.max(~F.col("is_event")).alias("_commands"))
    slots = slots.repartition(tasks, "correlation_key").withColumn("newest", F.max("_last").over(whole)).withColumn("any_commands", F.max("_commands").over(whole))
    if settled is None:
        cut = slots.withColumn("segment", F.lit(0).cast("bigint"))
    else:
        spans = df.where("is_event").groupBy("correlation_key", "detection_id").agg(F.min("_slot").alias("_slot"), F.max("t").alias("_until"))
        reaches = spans.groupBy("correlation_key", "_slot").agg(F.max("_until").alias("_reach"))
        order = whole.orderBy("_slot")
        before = order.rowsBetween(Window.unboundedPreceding, -1)
        start = F.col("_head.t")
        fresh = (
            F.col("_head.is_event") & ~F.col("_head.ended") & ~F.col("_head.repeat") & (start - F.lag("_last").over(order) > settled)
            & F.coalesce(F.max("_reach").over(before) < start, F.lit(True)) & ~F.coalesce(F.max("_commands").over(before), F.lit(False))
        )
        joined = slots.join(reaches, ["correlation_key", "_slot"], "left").withColumn("_fresh", F.coalesce(fresh, F.lit(False)))
        cut = joined.withColumn("segment", F.sum(F.when(F.col("_fresh"), 1).otherwise(0)).over(order.rowsBetween(Window.unboundedPreceding, 0)))
    return df.join(cut.select("correlation_key", "_slot", "newest", "any_commands", "segment"), ["correlation_key", "_slot"]).drop("_slot")


class CaseFold:
    def __init__(self, key, policy, asof):
        self.case, self.asof, self.keep_all, self.newest = Case(key, policy), asof, False, None

    def row(self, t, newest, is_event, repeat, any_commands, body):
        self.keep_all, self.newest = bool(any_commands), int(newest)
        facts = json.loads(body)
        if is_event:
            facts["metrics"] = facts.get("metrics") or []
            self.case.event(int(t), facts, bool(repeat))
        else:
            self.case.command(int(t), {name: facts.get(name) for name in COMMAND_FACTS})
        self.case.forget(self.keep_all)
        return self.case.drain()

    def finish(self):
        # The key's newest row moves the clock of every segment before it, too.
        for clock in (self.newest, self.asof):
            if clock is not None:
                self.case.advance(clock)
        self.case.finish()
        return self.case.drain()


def correlate(events: DataFrame, commands: DataFrame | None = None, asof: int | None = None,
              policy: CasePolicy = CasePolicy(), gated: bool = False) -> DataFrame:
    """The incident log: outcomes, links, timeline, outbox, command results, incidents.

    ``asof`` (epoch seconds) is the clock up to which timers fire at the end.
    Readers of several record types should share one stored or checkpointed log.
    """
    rows = case_rows(events if gated else gate_events(events), commands)
    clock = None if asof is None else asof * 1_000_000
    count = events.count() + (0 if commands is None else commands.count())
    tasks = max(events.sparkSession.sparkContext.defaultParallelism, -(-count // ROWS_A_TASK))
    return ordered_fold(segments(rows, policy, tasks), ["correlation_key", "segment"], ORDER, FOLD_INPUT,
                        lambda key, _: CaseFold(key, policy, clock), OUT_SCHEMA, tasks)


INCIDENT_BODY = (
    "state STRING, version BIGINT, title STRING, description STRING, severity STRING, severity_source STRING, ever_critical BOOLEAN, "
    "maximum_detected_severity STRING, priority STRING, category STRING, metrics ARRAY<STRING>, created_by STRING, "
    "first_detected_at BIGINT, opened_at BIGINT, last_detected_at BIGINT, last_updated_at BIGINT, acknowledged_at BIGINT, "
    "recovering_since BIGINT, resolved_at BIGINT, closed_at BIGINT, reopened_at BIGINT, reopen_count INT, closure_reason STRING, "
    "state_before_recovering STRING, suppressed_until BIGINT, suppression_reason STRING, assignee STRING, evidence_observed BIGINT, "
    "evidence_retained BIGINT, policy_refs ARRAY<STRUCT<policy_id: STRING, policy_version: BIGINT, first_seen: BIGINT, last_seen: BIGINT>>, "
    "policy_refs_omitted BIGINT, notes ARRAY<STRUCT<note_index: INT, body: STRING, author: STRING, supersedes: INT, redacted: BOOLEAN>>, "
    "tags MAP<STRING, STRING>, timeline_entries BIGINT"
)
TIMES = ["first_detected_at", "opened_at", "last_detected_at", "last_updated_at", "acknowledged_at", "recovering_since", "resolved_at",
         "closed_at", "reopened_at", "suppressed_until"]


def _key_parts(df: DataFrame) -> DataFrame:
    """Tenant and target back out of the correlation key."""
    head = F.split("correlation_key", r"\|", 4)
    rest = F.get(head, F.lit(3))
    length = F.substring_index(rest, ":", 1).cast("int")
    start = F.length(F.substring_index(rest, ":", 1)) + 2
    tenant = F.substr(rest, start, length)
    return df.select(
        "*", F.get(head, F.lit(0)).cast("int").alias("family"), F.get(head, F.lit(1)).alias("direction"), F.get(head, F.lit(2)).alias("scope_type"),
        tenant.alias("tenant"), F.substr(rest, start + length + 1, F.length(rest)).alias("target"))


def incidents_of(log: DataFrame) -> DataFrame:
    df = log.where("record = 'incident'").withColumn("i", F.from_json("body", INCIDENT_BODY))
    df = _key_parts(df.select("correlation_key", "incident_id", "i.*"))
    df = df.withColumnsRenamed({"tenant": "tenant_id", "scope_type": "target_type", "target": "target_id"})
    for name in TIMES:
        df = df.withColumn(name, F.timestamp_micros(name))
    return df.withColumn("evidence_omitted", F.col("evidence_observed") - F.col("evidence_retained"))


def links_of(log: DataFrame) -> DataFrame:
    body = F.from_json("body", "link_type STRING, detection_id STRING, dedup_key STRING, metrics ARRAY<STRING>")
    return log.where("record = 'link'").select("incident_id", F.col("ref").alias("event_id"), F.timestamp_micros("t").alias("linked_at"), body.alias("b")).select(
        "incident_id", "event_id", "linked_at", "b.*")


def timeline_of(log: DataFrame) -> DataFrame:
    """Append-only entries; ``timeline_id`` grows within an incident."""
    return log.where("record = 'timeline'").select(
        "incident_id", F.concat(F.lpad(F.col("t").cast("string"), 20, "0"), F.lit("-"), F.lpad(F.col("n").cast("string"), 10, "0")).alias("timeline_id"),
        F.timestamp_micros("t").alias("occurred_at"), F.col("ref").alias("entry_type"), F.get_json_object("body", "$.actor").alias("actor"),
        F.get_json_object("body", "$.payload").alias("payload"))


def outbox_of(log: DataFrame) -> DataFrame:
    df = _key_parts(log.where("record = 'outbox'"))
    return df.select("tenant", "incident_id", F.col("ref").alias("event_type"), F.timestamp_micros("t").alias("created_at"), "n",
                     F.get_json_object("body", "$.version").cast("bigint").alias("version"), F.get_json_object("body", "$.severity").alias("severity"))


def outcomes_of(log: DataFrame) -> DataFrame:
    return log.where("record = 'outcome'").select(F.col("ref").alias("event_id"), "incident_id", F.get_json_object("body", "$.outcome").alias("outcome"))


def command_results_of(log: DataFrame) -> DataFrame:
    field = lambda name: F.get_json_object("body", f"$.{name}")
    return log.where("record = 'command'").select(F.col("ref").alias("command_id"), "incident_id", field("verb").alias("verb"),
                                                  field("result").alias("result"), field("version").cast("bigint").alias("version"))


def correlation_report(log: DataFrame, gated: DataFrame | None = None) -> DataFrame:
    """Counts per ingest outcome and per state change: one pass over the log, which is folded once."""
    field = lambda path: F.get_json_object("body", path)
    moved = (F.col("record") == "timeline") & (F.col("ref") == "state_changed")
    measure = F.when(F.col("record") == "outcome", "outcome").when(moved, "transition")
    key = F.when(F.col("record") == "outcome", field("$.outcome")).when(moved, field("$.payload.cause"))
    pairs = log.select(measure.alias("measure"), key.alias("key")).where("measure IS NOT NULL")
    if gated is not None:
        pairs = pairs.unionByName(gated.where("gate IN ('quarantined', 'observeOnly')").select(F.lit("gate").alias("measure"), F.col("gate").alias("key")))
    return pairs.groupBy("measure", "key").agg(F.count(F.lit(1)).alias("n"))


# --- numbers ----------------------------------------------------------------


def assign_numbers(incidents: DataFrame, prefix: str = "INC", start: DataFrame | None = None) -> DataFrame:
    """Gapless ``PREFIX-YYYY-NNNNNN`` per tenant in opening order, wider past six digits.

    A tenant may own a third of all incidents, so its rows are ranked per
    opening minute, after the counts of earlier minutes were summed up.
    ``start`` gives each tenant's last number of an earlier run.
    """
    tenant = "tenant_id"
    df = incidents.withColumn("_minute", F.date_trunc("minute", F.col("opened_at")))
    counts = df.groupBy(tenant, "_minute").agg(F.count(F.lit(1)).alias("_n"))
    earlier = Window.partitionBy(tenant).orderBy("_minute").rowsBetween(Window.unboundedPreceding, -1)
    offsets = counts.select(tenant, "_minute", F.coalesce(F.sum("_n").over(earlier), F.lit(0)).alias("_offset"))
    inside = Window.partitionBy(tenant, "_minute").orderBy("opened_at", "incident_id")
    joined = df.withColumn("_rank", F.row_number().over(inside)).join(offsets, [tenant, "_minute"], "left")
    number = F.col("_rank") + F.col("_offset")
    if start is not None:
        joined = lookup_join(joined, start.select(tenant, "last_number"), [tenant], "left")
        number = number + F.coalesce("last_number", F.lit(0))
    text = F.when(number <= 999_999, F.lpad(number.cast("string"), 6, "0")).otherwise(number.cast("string"))
    named = joined.withColumn("sequence_number", number.cast("bigint")).withColumn(
        "incident_number", F.concat_ws("-", F.lit(prefix), F.date_format("opened_at", "yyyy"), text))
    return named.select(*incidents.columns, "sequence_number", "incident_number")


# --- column rules -----------------------------------------------------------


def derive_category(metrics: Column) -> Column:
    """Category of a set of metric names."""
    has = lambda names: F.arrays_overlap(metrics, F.array(*[F.lit(n) for n in names]))
    families = sum((has(family).cast("int") for family in CATEGORY_FAMILIES[1:]), has(CATEGORY_FAMILIES[0]).cast("int"))
    out = F.when(families >= 2, MANY_FAMILIES)
    for name, members in CATEGORY_LADDER:
        out = out.when(has(members), name)
    return out.otherwise(NO_CATEGORY)


def link_bookkeeping(linked: DataFrame, keep: int | None = None) -> DataFrame:
    """Per incident, from its linked events: metric union, category, evidence counts.

    Built from aggregates only, as a check on the fold; ``keep`` bounds the links
    that count as retained.
    """
    counts = linked.groupBy("incident_id").agg(F.count(F.lit(1)).alias("evidence_observed"))
    each = linked.select("incident_id", F.explode(F.transform("matched", lambda r: r["metric"])).alias("metric"))
    metrics = each.groupBy("incident_id").agg(F.array_sort(F.collect_set("metric")).alias("metrics"))
    df = counts.join(metrics, "incident_id", "left").withColumn("metrics", F.coalesce("metrics", F.array().cast("array<string>")))
    omitted = F.lit(0) if keep is None else F.greatest(F.col("evidence_observed") - keep, F.lit(0))
    return df.withColumn("category", derive_category(F.col("metrics"))).withColumn("evidence_omitted", omitted.cast("bigint"))


def retained_evidence(links: DataFrame, keep: int | None = None, order: list[str] = ("linked_at", "event_id")) -> DataFrame:
    """The links of each incident in order, the first ``keep`` if given, and how many more there were.

    Rows before the cut are found per hour first, so that one incident with a
    great many links is not ranked in one task.
    """
    keep = 2**62 if keep is None else keep
    hour = F.date_trunc("hour", F.col(order[0]))
    df = links.withColumn("_hour", hour)
    counts = df.groupBy("incident_id", "_hour").agg(F.count(F.lit(1)).alias("_n"))
    before = Window.partitionBy("incident_id").orderBy("_hour").rowsBetween(Window.unboundedPreceding, -1)
    whole = Window.partitionBy("incident_id")
    offsets = counts.select("incident_id", "_hour", F.coalesce(F.sum("_n").over(before), F.lit(0)).alias("_before"),
                            F.greatest(F.sum("_n").over(whole) - keep, F.lit(0)).alias("evidence_omitted"))
    needed = df.join(offsets.where(F.col("_before") < keep), ["incident_id", "_hour"])
    rank = F.row_number().over(Window.partitionBy("incident_id", "_hour").orderBy(*order)) + F.col("_before")
    return needed.withColumn("position", rank.cast("bigint")).where(F.col("position") <= keep).drop("_hour", "_before")


def policy_refs(linked: DataFrame, keep: int | None = None) -> DataFrame:
    """Per incident and policy: first and last sequence, and the version of the last; the first ``keep`` policies if given."""
    refs = linked.groupBy("incident_id", "policy_id").agg(
        F.min("sequence").alias("first_seen_sequence"), F.max("sequence").alias("last_seen_sequence"),
        F.max(F.struct("sequence", "policy_version"))["policy_version"].alias("policy_version"), F.min("observed_at").alias("_since"))
    if keep is None:
        return refs.drop("_since")
    rank = F.row_number().over(Window.partitionBy("incident_id").orderBy("_since", "policy_id"))
    return refs.withColumn("_rank", rank).where(F.col("_rank") <= keep).drop("_rank", "_since")


def _older(column: str, asof: Column, seconds: int) -> Column:
    return F.col(column) <= asof - F.expr(f"INTERVAL {seconds} SECONDS")


def silent_incidents(incidents: DataFrame, asof: Column, after: int = SILENT_AFTER_S) -> DataFrame:
    """Active incidents no detection touched for long: due to recover."""
    return incidents.where(F.col("state").isin(*INCIDENT_ACTIVE) & _older("last_detected_at", asof, after))


def recovered_incidents(incidents: DataFrame, asof: Column, after: int = RECOVERY_S) -> DataFrame:
    return incidents.where((F.col("state") == "recovering") & _older("recovering_since", asof, after))


def closable_incidents(incidents: DataFrame, asof: Column, after: int = CLOSURE_S, allow_critical: bool = False) -> DataFrame:
    """Resolved long enough; never one that was critical at any time, unless allowed."""
    mild = F.lit(allow_critical) | (~F.col("ever_critical") & (F.col("severity") != "critical"))
    return incidents.where((F.col("state") == "resolved") & _older("resolved_at", asof, after) & mild)


def run_maintenance(incidents: DataFrame, asof: Column) -> DataFrame:
    """One pass of the three timers in state order: ``next_state`` and why."""
    active = F.col("state").isin(*INCIDENT_ACTIVE) & _older("last_detected_at", asof, SILENT_AFTER_S)
    recovered = (F.col("state") == "recovering") & _older("recovering_since", asof, RECOVERY_S)
    closing = (F.col("state") == "resolved") & _older("resolved_at", asof, CLOSURE_S) & ~F.col("ever_critical") & (F.col("severity") != "critical")
    to = F.when(active, "recovering").when(recovered, "resolved").when(closing, "closed")
    why = F.when(active, "detector_silent").when(recovered, "recovery_confirmed").when(closing, "automatic_closure")
    return incidents.withColumn("next_state", to).withColumn("cause", why).where("next_state IS NOT NULL")


def guard_transitions(moves: DataFrame, kind: str | None = None) -> DataFrame:
    """Add ``legal``: whether (from_state, to_state) is an edge for its actor.

    ``actor_kind`` is automatic or operator; ``kind`` fixes it for all rows.
    """
    def among(edges) -> Column:
        test = F.lit(False)
        for a, b in edges:
            test = test | ((F.col("from_state") == a) & (F.col("to_state") == b))
        return test

    actor = F.lit(kind) if kind else F.col("actor_kind")
    return moves.withColumn("legal", F.when(actor == "operator", among(OPERATOR_EDGES)).otherwise(among(AUTOMATIC_EDGES)))


def suppressed(asof: Column, until: str = "suppressed_until") -> Column:
    """Derived, not a state: strictly before the deadline."""
    return F.coalesce(asof < F.col(until), F.lit(False))


def duplicate_active(incidents: DataFrame, key: list[str]) -> DataFrame:
    """Keys with more than one incident neither resolved nor closed: none, or a fault."""
    active = incidents.where(~F.col("state").isin("resolved", "closed"))
    return active.groupBy(*key).agg(F.count(F.lit(1)).alias("active")).where("active > 1")


def with_priority(incidents: DataFrame) -> DataFrame:
    return incidents.withColumn("priority", default_priority(F.col("severity"))).withColumn("severity_rank", severity_rank(F.col("severity")))
