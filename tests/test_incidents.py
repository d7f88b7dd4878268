"""Incident correlation by scenario, and segments folded apart against one pass."""

import json
import random

import pytest
from hypothesis import given, settings
from hypothesis import strategies as st
from pyspark.sql import functions as F

from floodplain.operators import case
from floodplain.operators import incidents as inc
from floodplain.operators.case import MINUTE, Case, CasePolicy, category_of

KEY = "4|incoming|host|4:acme|203.0.113.7"


class World:
    def __init__(self, policy=CasePolicy()):
        self.case, self.n = Case(KEY, policy), 0

    def event(self, minute, kind="started", detection="d1", metrics=("bps",), severity="major", reason="thresholdCrossed", policy="p", sequence=0,
              version=1, repeat=False, dedup=None):
        self.n += 1
        self.case.event(int(minute * MINUTE), {
            "event_id": f"e{self.n}", "dedup_key": dedup or f"{detection}:{kind}:{self.n}", "detection_id": detection, "kind": kind,
            "reason": reason, "severity": severity, "policy_id": policy, "policy_version": version, "sequence": sequence,
            "metrics": list(metrics), "summary": "s" * 300}, repeat)
        return self.outcomes()[-1]

    def command(self, minute, verb, version=None, incident=None, **args):
        self.n += 1
        self.case.command(int(minute * MINUTE), {"command_id": f"c{self.n}", "verb": verb, "args": json.dumps(args), "incident_id": incident,
                                                 "expected_version": version, "actor": "noc"})
        return json.loads([r for r in self.case.out if r[0] == "command"][-1][5])["result"]

    def outcomes(self):
        return [json.loads(r[5])["outcome"] for r in self.case.out if r[0] == "outcome"]

    def at(self, minute):
        self.case.advance(int(minute * MINUTE))
        return self.case.incidents

    def causes(self):
        return [json.loads(r[5])["payload"]["cause"] for r in self.case.out if r[0] == "timeline" and r[4] == "state_changed"]


def test_create_then_link_then_recover():
    w = World(CasePolicy(title_max=200))
    assert w.event(0) == "created"
    one = w.case.active
    assert one["version"] == 1 and one["priority"] == "P2" and len(one["title"]) == 200 and one["category"] == "bandwidth"
    assert w.event(1, "updated", metrics=("udpBps",), sequence=1) == "updated"
    assert one["category"] == "udp_flood" and one["version"] == 2
    assert w.event(2, "ended", metrics=(), reason="clearSustained", sequence=2) == "updated"
    assert one["state"] == "recovering" and w.causes() == ["traffic_cleared"]
    w.at(7)
    assert one["state"] == "resolved" and one["resolved_at"] == 7 * MINUTE
    w.at(36.9)
    assert one["state"] == "resolved"
    w.at(37)
    assert one["state"] == "closed" and w.causes() == ["traffic_cleared", "recovery_confirmed", "automatic_closure"]


@pytest.mark.parametrize("reason, cause", [("stale", "detector_stale"), ("policyWithdrawn", "policy_withdrawn"),
                                           ("manualReset", "detector_reset"), ("clearSustained", "traffic_cleared")])
def test_why_an_incident_recovers(reason, cause):
    w = World()
    w.event(0)
    w.event(1, "ended", reason=reason)
    assert w.causes() == [cause]


def test_silence_recovers_resolves_and_closes():
    w = World()
    w.event(0)
    assert [i["state"] for i in w.at(4.99)] == ["open"]
    assert [i["state"] for i in w.at(5)] == ["recovering"]
    assert [i["state"] for i in w.at(10)] == ["resolved"]
    assert [i["state"] for i in w.at(40)] == ["closed"]


def test_critical_is_never_closed_by_itself():
    w = World()
    w.event(0, severity="critical")
    assert [i["state"] for i in w.at(10_000)] == ["resolved"]


def test_reopen_window_is_inclusive():
    w = World()
    w.event(0)
    assert w.event(10 + 15, detection="d2") == "reopened"
    assert w.case.active["reopen_count"] == 1 and w.case.active["resolved_at"] is None
    w = World()
    w.event(0, severity="critical")
    assert w.event(25.001, detection="d2") == "created"


def test_zero_window_never_reopens():
    w = World(CasePolicy(reopen_window=0))
    w.event(0)
    assert w.event(10, detection="d2") == "created"


def test_late_news_never_reopens():
    w = World()
    w.event(0)
    w.at(12)
    before = w.case.incidents[0]["last_detected_at"]
    assert w.event(12, "updated") == "linked_late"
    assert w.event(13, "ended", detection="other") == "linked_late"
    assert w.case.incidents[0]["state"] == "resolved" and w.case.incidents[0]["last_detected_at"] == before


def test_an_ending_with_nothing_to_attach_to_is_quarantined():
    w = World()
    assert w.event(0, "ended", dedup="k") == "quarantined"
    assert w.event(1) == "created"
    # Not remembered as delivered: the same ending now links.
    assert w.event(2, "ended", dedup="k", repeat=True) == "updated"


def test_a_repeat_changes_nothing():
    w = World()
    w.event(0, dedup="k")
    version = w.case.active["version"]
    assert w.event(1, dedup="k", repeat=True) == "duplicate" and w.case.active["version"] == version


def test_events_link_to_a_recovering_incident_without_aborting():
    w = World()
    w.event(0)
    w.event(1, "ended")
    w.event(2, detection="d2")
    assert w.case.active["state"] == "recovering"
    w = World(CasePolicy(abort_on_event=True))
    w.event(0)
    w.event(1, "ended")
    w.event(2, detection="d2")
    assert w.case.active["state"] == "open" and w.causes()[-1] == "recovery_aborted"


def test_bounds_are_off_unless_asked_for():
    """More links and policies than any bound: all are kept and the same late detection is linked, not reopened."""
    w = World()
    for i in range(10_050):
        w.event(0, "started" if i == 0 else "updated", detection=f"d{i}", policy=f"q{i % 70}", sequence=i)
    one = w.case.active
    assert len(one["title"]) == 300 and len(one["policy_refs"]) == 70 and one["evidence_retained"] == one["evidence_observed"] == 10_050
    w.event(1, "ended", detection="d0", metrics=(), reason="clearSustained")
    assert w.at(20)[0]["state"] in ("resolved", "closed")
    assert w.event(20, "updated", detection="d10049") == "linked_late" and w.event(20, "started", detection="new") == "reopened"


def test_policy_refs_widen_and_keep_the_newest_version():
    w = World(CasePolicy(policy_refs_max=64))
    w.event(0, sequence=3, version=2)
    w.event(1, "updated", sequence=1, version=1)
    assert w.case.active["policy_refs"] == [{"policy_id": "p", "policy_version": 2, "first_seen": 1, "last_seen": 3}]
    for i in range(70):
        w.event(1, "updated", policy=f"q{i}")
    assert len(w.case.active["policy_refs"]) == 64 and w.case.active["policy_refs_omitted"] == 7


def test_operator_commands():
    w = World()
    assert w.command(0, "acknowledge") == "not_found"
    w.event(0)
    assert w.command(1, "acknowledge", version=9) == "version_conflict"
    assert w.command(1, "acknowledge", version=1) == "applied"
    assert w.command(1, "acknowledge") == "state_unchanged"
    assert w.command(1, "begin_investigation") == "applied" and w.command(1, "mark_monitoring") == "applied"
    assert w.command(1, "close") == "invalid_transition"
    assert w.command(1, "change_severity", severity="info") == "validation_error"
    assert w.command(1, "change_severity", severity="info", reason="noise") == "applied"
    assert w.command(1, "suppress", reason="works", duration_s=60) == "applied"
    assert w.command(1, "add_note", body="first") == "applied" and w.command(1, "edit_note", note_index=0, body="second") == "applied"
    assert w.command(1, "edit_note", note_index=0, body="third") == "validation_error"
    assert w.command(1, "redact_note", note_index=1, reason="private") == "applied"
    assert w.command(1, "assign", assignee="ann") == "applied" and w.command(1, "unassign") == "applied"
    assert w.command(1, "add_tag", key="k", value="v") == "applied" and w.command(1, "remove_tag", key="k") == "applied"
    assert w.command(2, "resolve", note="done") == "applied"
    assert w.command(2, "close") == "applied" and w.command(3, "reopen", reason="again") == "applied"
    one = w.case.incidents[0]
    assert one["state"] == "open" and one["reopen_count"] == 1 and len(one["notes"]) == 3 and one["notes"][1]["body"] == ""


def test_manual_incidents_share_the_key():
    w = World()
    assert w.command(0, "open_manual", title="t", severity="minor") == "applied"
    assert w.command(0, "open_manual", title="t", severity="minor") == "duplicate_active_incident"
    assert w.event(1) == "updated" and len(w.case.incidents) == 1


def test_categories():
    assert category_of({"tcpBps", "udpPps"}) == "multi_vector" and category_of({"tcpSynPps"}) == "tcp_syn_flood"
    assert category_of({"droppedPps"}) == "drop_pressure" and category_of({"fps"}) == "packet_rate" and category_of(set()) == "unclassified"


# --- through Spark ----------------------------------------------------------


def random_events(seed, target):
    rng = random.Random(seed)
    t, out, detection, n = 0, [], 0, 0
    for _ in range(120):
        t += rng.choice([1, 2, 3, 4, 6, 12, 30, 56, 70, 200])
        detection += rng.random() < 0.5
        kind = rng.choice(["started", "updated", "ended"])
        name = f"{target}-d{max(0, detection - rng.choice([0, 0, 0, 1]))}"
        n += 1
        out.append((t * 60, f"{target}-e{n:04d}", f"{name}:{kind}:{rng.randint(0, 3)}", name, rng.randint(0, 3), kind, "acme", target,
                    rng.choice(["major", "critical"]), rng.choice(["bps", "udpBps", "tcpSynPps"])))
    return out


EVENT = "at long, event_id string, dedup_key string, detection_id string, sequence long, kind string, tenant string, target string, severity string, metric string"


def as_events(spark, rows):
    df = spark.createDataFrame(rows, EVENT)
    return df.select(
        "event_id", "dedup_key", "detection_id", "sequence", "kind", "tenant", "target", "severity", F.lit(1).alias("schema_version"),
        F.lit(False).alias("executed"), F.lit("alerted").alias("action"), F.lit("host").alias("scope_type"), F.lit("incoming").alias("direction"),
        F.lit(4).alias("family"), F.lit("x").alias("reason"), F.lit("p").alias("policy_id"), F.lit(1).cast("bigint").alias("policy_version"),
        F.array(F.struct(F.col("metric").alias("metric"))).alias("matched"), F.lit("summary").alias("summary"),
        F.timestamp_seconds("at").alias("observed_at"))


@pytest.mark.parametrize("with_commands, swept", [(False, True), (True, True), (False, False)])
def test_segments_change_nothing(spark, with_commands, swept):
    data = {f"10.0.0.{s}": random_events(s, f"10.0.0.{s}") for s in range(25)}
    asof = max(r[0] for rows in data.values() for r in rows) + 86_400 if swept else None
    events = as_events(spark, [r for rows in data.values() for r in rows])
    commands = None
    if with_commands:
        made = [(t, r[0] + 30, f"cmd-{t}-{i}", rng.choice(["acknowledge", "resolve", "close", "mark_monitoring", "reopen"]))
                for t, rows in data.items() for rng in [random.Random(t)] for i, r in enumerate(rows) if rng.random() < 0.05]
        commands = spark.createDataFrame(made, "target string, s long, command_id string, verb string").select(
            F.lit("acme").alias("tenant"), F.lit("host").alias("scope_type"), "target", F.lit("incoming").alias("direction"), F.lit(4).alias("family"),
            F.timestamp_seconds("s").alias("at"), "command_id", "verb", F.lit("{}").alias("args"), F.lit(None).cast("string").alias("incident_id"),
            F.lit(None).cast("bigint").alias("expected_version"), F.lit("noc").alias("actor"))
    policy = CasePolicy()
    rows = inc.case_rows(inc.gate_events(events), commands)
    got = inc.correlate(events, commands, asof, policy).collect()
    if not with_commands:
        assert len({(r["correlation_key"], r["segment"]) for r in got}) > 100
    kept = lambda record, body: body if record != "incident" else {k: v for k, v in json.loads(body).items()}
    ours = sorted((r["correlation_key"], r["record"], r["t"], r["incident_id"] or "", r["ref"] or "", str(kept(r["record"], r["body"]))) for r in got)
    plain = []
    by_key = {}
    for r in rows.withColumn("s", F.coalesce("at_sequence", F.lit(-1))).collect():
        by_key.setdefault(r["correlation_key"], []).append(r)
    for key, listed in by_key.items():
        fold = inc.CaseFold(key, policy, asof and asof * 1_000_000)
        newest = max(r["t"] for r in listed)
        for r in sorted(listed, key=lambda r: (r["t"], r["s"], r["at_id"])):
            plain += [(key, x) for x in fold.row(r["t"], newest, r["is_event"], r["repeat"], True, r["body"])]
        plain += [(key, x) for x in fold.finish()]
    theirs = sorted((k, x[0], x[1], x[3] or "", x[4] or "", str(kept(x[0], x[5]))) for k, x in plain)
    assert ours == theirs


def test_numbers_are_gapless_per_tenant(spark):
    df = spark.createDataFrame([(t, f"{t}{i}", i * 37 % 100) for t in ("a", "b") for i in range(100)], "tenant_id string, incident_id string, m long")
    df = df.withColumn("opened_at", F.timestamp_seconds(F.col("m") * 25))
    rows = inc.assign_numbers(df).collect()
    for tenant in "ab":
        own = sorted((r["opened_at"], r["incident_id"], r["sequence_number"], r["incident_number"]) for r in rows if r["tenant_id"] == tenant)
        assert [r[2] for r in own] == list(range(1, 101)) and own[0][3] == "INC-1970-000001"


def test_at_most_one_active_incident_per_key(spark):
    events = as_events(spark, [r for s in range(10) for r in random_events(100 + s, f"10.0.1.{s}")])
    incidents = inc.incidents_of(inc.correlate(events))
    assert inc.duplicate_active(incidents, inc.KEY).count() == 0
    assert incidents.where("tenant_id <> 'acme' OR target_id NOT LIKE '10.0.1.%' OR family <> 4").count() == 0


def test_a_key_delivered_very_often_passes_once(spark):
    copies = [(i, "same", "hot") for i in range(3000)] + [(i, f"e{i}", f"k{i}") for i in range(100)]
    df = spark.createDataFrame(copies, "i long, event_id string, dedup_key string").repartition(8).select(
        F.lit("acme").alias("tenant"), "event_id", "dedup_key", F.lit(1).alias("schema_version"), F.lit(False).alias("executed"),
        F.lit("alerted").alias("action"), F.timestamp_seconds(F.lit(0)).alias("observed_at"), F.lit(0).cast("bigint").alias("sequence"))
    counts = {r["gate"]: r["n"] for r in inc.gate_events(df).groupBy("gate").agg(F.count("*").alias("n")).collect()}
    assert counts == {None: 101, "duplicate": 2999}


TEXTS = st.one_of(st.none(), st.just("{"), st.just("[]"), st.just("7"), st.just('"x"'), st.dictionaries(
    st.sampled_from(["title", "severity", "priority", "reason", "duration_s", "assignee", "body", "note_index", "key", "value", "visibility", "note", "description", "more"]),
    st.one_of(st.none(), st.booleans(), st.integers(-3, 3), st.integers(), st.floats(allow_nan=False), st.text(max_size=3), st.sampled_from(["minor", "critical", "P1", "customer_visible", "an hour"]),
              st.lists(st.integers(), max_size=2), st.dictionaries(st.text(max_size=1), st.integers(), max_size=1))).map(json.dumps))


@settings(max_examples=150, deadline=None)
@given(st.lists(st.tuples(st.sampled_from([*case.ARGUMENTS, "dance", ""]), TEXTS), max_size=30))
def test_no_command_ends_the_fold(commands):
    """Whatever an operator sends, the result is one of the known ones, and a refusal changes nothing."""
    held = case.Case("4|incoming|host|4:acme|x", CasePolicy())
    held.command(0, {"command_id": "c", "verb": "open_manual", "args": '{"title": "t", "severity": "minor"}', "incident_id": None, "expected_version": None, "actor": None})
    for n, (verb, args) in enumerate(commands):
        held.advance(n)
        before = json.dumps(held.incidents)
        held.command(n, {"command_id": f"c{n}", "verb": verb, "args": args, "incident_id": None, "expected_version": None, "actor": None})
        result = json.loads(held.out[-1][5])["result"]
        assert result in ("applied", "validation_error", "not_found", "state_unchanged", "invalid_transition", "unknown_command", "duplicate_active_incident", "open_incident_already_exists")
        if result != "applied":
            assert json.dumps(held.incidents) == before
        for incident in held.incidents:
            assert incident["severity"] in case.SEVERITIES and incident["priority"] in case.PRIORITIES.values()
            assert incident["suppressed_until"] is None or isinstance(incident["suppressed_until"], int)


def test_small_bodies_are_written_as_json_dumps_writes_them():
    from floodplain.operators.case import _as_json

    for body in ({}, {"a": None, "b": True, "c": [1, "é\n\"", {"d": 1.5}], "e\\": {"f": False}, "n": -3}, {"metrics": []}):
        assert _as_json(body) == json.dumps(body)


def test_rows_of_a_correlation_are_dealt_by_their_number(spark, sf, monkeypatch):
    from checks.incident_checks import arrivals, scripted

    monkeypatch.setattr(inc, "ROWS_A_TASK", 100)
    count = arrivals(spark, sf).count() + scripted(spark, sf).count()
    log = inc.correlate(arrivals(spark, sf), scripted(spark, sf))
    plan = log._jdf.queryExecution().optimizedPlan().toString()
    assert "RepartitionByExpression [correlation_key#" in plan and plan.count(f", {-(-count // 100)}") >= 3
    assert scripted(spark, sf).rdd.getNumPartitions() == int(spark.conf.get("spark.sql.shuffle.partitions"))
