"""Mitigation commands against a plain store that applies them one after another."""

import random
from datetime import datetime, timedelta, timezone

import pytest

from floodplain.functions.vocab import MITIGATION_EDGES, MITIGATION_ENDED
from floodplain.operators import lifecycle, mitigation, notify
from pyspark.sql import functions as F

START = datetime(2024, 1, 1, tzinfo=timezone.utc)
SCHEMA = ("command_id BIGINT, mitigation_id STRING, tenant_id STRING, at TIMESTAMP, verb STRING, actor_type STRING, actor_id STRING, reason STRING, "
          "expected_version BIGINT, cause STRING, dry_run BOOLEAN, route STRING, kill_switch BOOLEAN, family INT, hi BIGINT, lo BIGINT, prefix_len INT, action STRING, duration_seconds INT")
NAMES = [part.split()[0] for part in SCHEMA.split(", ")]
NET = 10 * 2**24


@pytest.fixture(scope="module")
def allowlist(spark):
    rows = [("acme", 4, 22, 0, NET, ["rtbh"]), ("globex", 4, 24, 0, NET + 1024, ["rtbh"])]
    return spark.createDataFrame(rows, "tenant STRING, family INT, prefix_len INT, net_hi BIGINT, net_lo BIGINT, actions ARRAY<STRING>")


def command(i, seconds, verb, mitigation="m", tenant="acme", **more):
    row = dict.fromkeys(NAMES)
    row.update(command_id=i, mitigation_id=mitigation, tenant_id=tenant, at=START + timedelta(seconds=seconds), verb=verb, actor_type="operator", actor_id=f"op{i}", reason="why")
    if verb in lifecycle.CREATED_AS:
        row.update(family=4, hi=0, lo=NET + 7, prefix_len=32, action="rtbh", duration_seconds=600)
    row.update(more)
    return row


def frame(spark, rows):
    return spark.createDataFrame([tuple(row[name] for name in NAMES) for row in rows], SCHEMA)


def plain(rows, self_approval=False):
    """A store with one mutable record per mitigation."""
    owners = {"acme": (NET, NET + 1024), "globex": (NET + 1024, NET + 1280)}
    seen, first, store, out = set(), {}, {}, {}
    for row in sorted(rows, key=lambda r: (r["at"], str(r["command_id"]))):
        i, verb = row["command_id"], row["verb"]
        if i in seen:
            continue
        seen.add(i)
        if verb not in lifecycle.CREATED_AS and verb not in lifecycle.LEADS_TO:
            out[i] = ("mitigation.invalid", None)
            continue
        worded = bool((row["reason"] or "").strip())
        if verb in lifecycle.CREATED_AS:
            low, high = owners[row["tenant_id"]]
            guard = "mitigation.not_allowlisted" if not low <= row["lo"] < high else "mitigation.too_long" if row["duration_seconds"] > 3600 else None
            key = (row["lo"], row["action"])
            if row["mitigation_id"] in first:
                code = "mitigation.invalid"
            elif not worded or not 60 <= row["duration_seconds"] <= 604800:
                code = "mitigation.invalid"
            elif row["kill_switch"]:
                code = "mitigation.kill_switch"
            elif guard:
                code = guard
            elif any(m["key"] == key and m["state"] not in MITIGATION_ENDED for m in store.values()):
                code = "mitigation.duplicate"
            else:
                code = None
            first.setdefault(row["mitigation_id"], i)
            if code is None:
                store[row["mitigation_id"]] = {"state": lifecycle.CREATED_AS[verb], "version": 1, "owner": row["tenant_id"], "by": row["actor_id"], "key": key}
            out[i] = (code or "applied", None if code else 1)
            continue
        m = store.get(row["mitigation_id"])
        to = "withdrawn" if m and m["state"] == "approved" and verb in ("withdraw", "begin_withdrawal") else lifecycle.LEADS_TO[verb]
        if m is None or m["owner"] != row["tenant_id"]:
            code = "mitigation.not_found"
        elif row["expected_version"] not in (None, m["version"]):
            code = "mitigation.version_conflict"
        elif verb in ("reject", "withdraw") and not worded or verb == "begin_withdrawal" and row["cause"] not in lifecycle.CAUSES:
            code = "mitigation.invalid"
        elif (m["state"], to) not in MITIGATION_EDGES or verb == "finish_withdrawal" and m["state"] == "approved":
            code = "mitigation.illegal_transition"
        elif verb == "approve" and m["by"] == row["actor_id"] and not self_approval:
            code = "mitigation.self_approval"
        elif to in ("approved", "announcing") and row["kill_switch"]:
            code = "mitigation.kill_switch"
        else:
            code, m["state"], m["version"] = None, to, m["version"] + 1
        out[i] = (code or "applied", None if code else m["version"])
    return out


def outcomes(log):
    return {r.command_id: (r.outcome, r.version) for r in log.collect()}


def test_a_whole_life_and_its_tables(spark, allowlist):
    rows = [
        command(1, 0, "propose", incident_id=None), command(2, 1, "approve", actor_id="op1"), command(3, 2, "announce"), command(4, 3, "approve"),
        command(5, 4, "announce", dry_run=True, route="{}"), command(6, 5, "activate"), command(7, 6, "propose", "again"), command(8, 7, "begin_withdrawal", cause="kill_switch"),
        command(9, 8, "finish_withdrawal"), command(10, 9, "propose", "later"), command(11, 9, "reject", "later", tenant="globex"), command(12, 10, "expire", "later"), command(12, 11, "expire", "later"),
    ]
    log = lifecycle.mitigation_log(frame(spark, rows), allowlist)
    found = outcomes(log)
    assert found == plain(rows)
    assert found[2][0] == "mitigation.self_approval" and found[3][0] == "mitigation.illegal_transition" and found[7][0] == "mitigation.duplicate"
    now = {r.mitigation_id: r for r in lifecycle.current_mitigations(log).collect()}
    assert set(now) == {"m", "later"} and (now["m"].state, now["m"].version, now["m"].dry_run, now["m"].withdrawal_cause) == ("withdrawn", 6, True, "kill_switch")
    assert now["m"].approved_by.actor_id == "op4" and now["m"].requested_by.actor_id == "op1" and now["m"].route == "{}"
    assert (now["m"].expires_at - now["m"].active_since).total_seconds() == 600 and now["m"].ended_at == now["m"].updated_at
    history = mitigation.mitigation_history(lifecycle.history_rows(log), "m", "acme").collect()
    assert [r.to_state for r in history] == ["proposed", "approved", "announcing", "active", "withdrawing", "withdrawn"] and [r.version for r in history] == list(range(1, 7))
    assert history[0].from_state is None and history[2].detail == "dry_run" and history[4].detail == "kill_switch"
    routes = spark.createDataFrame([("acme", ["mitigation.withdrawn", "mitigation.expired"], "major", ["noc"])], "tenant STRING, events ARRAY<STRING>, min_severity STRING, channels ARRAY<STRING>")
    assert [r.outbox_id for r in notify.route_changes(lifecycle.outbox_rows(log), routes).collect()] == ["m:6"]  # the kill switch makes it major
    audit = {r.audit_id: r for r in lifecycle.audit_rows(log).collect()}
    assert len(audit) == 12 and audit[2].result == "denied" and audit[2].before == '{"state":"proposed"}' and audit[2].after is None
    assert audit[11].before is None and audit[12].after == '{"state":"expired","version":2}'


def test_random_commands_equal_the_plain_store(spark, allowlist):
    rng = random.Random(11)
    verbs = [*lifecycle.LEADS_TO, "approve", "announce", "activate", "dance"]
    rows = []
    for i in range(3000):
        # A third of all commands on one mitigation, a third of all requests on one address.
        name = f"m{i // 30}" if rng.random() < 0.67 else "m0"
        created = i % 30 == 0 or rng.random() < 0.1
        tenant = rng.choice(["acme"] * 9 + ["globex"])
        rows.append(command(
            i, rng.choice([i, i, i - 20, i + 3]), rng.choice(["propose", "request"]) if created else rng.choice(verbs), (f"m{i // 30}" if i % 30 == 0 else f"x{i // 2}") if created else name, tenant,
            actor_id=f"op{rng.randrange(4)}", reason=rng.choice(["why", "why", "", None]), expected_version=rng.choice([None, None, None, 1, 2]),
            cause=rng.choice(["kill_switch", "duration_reached", None, "mood"]), kill_switch=rng.random() < 0.05,
            **({"lo": NET + (7 if rng.random() < 0.4 else rng.randrange(1300)), "duration_seconds": rng.choice([30, 600, 600, 600, 7200])} if created else {})))
    found = outcomes(lifecycle.mitigation_log(frame(spark, rows), allowlist))
    assert found == plain(rows)
    codes = {code.removeprefix("mitigation.") for code, _ in found.values()}
    assert codes == {"applied", "invalid", "kill_switch", "not_allowlisted", "too_long", "duplicate", "not_found", "version_conflict", "illegal_transition", "self_approval"}


def test_odd_commands(spark, allowlist):
    empty = lifecycle.mitigation_log(frame(spark, []), allowlist)
    assert empty.count() == 0 and lifecycle.current_mitigations(empty).count() == 0
    rows = [command(1, 0, "propose", mitigation=None), command(2, 0, None), command(3, 0, "propose", tenant=None), command(None, 0, "propose"),
            command(5, 0, "propose", lo=None), command(6, 0, "propose", "n", reason="a\tb"), command(7, 1, "approve", "n")]
    found = outcomes(lifecycle.mitigation_log(frame(spark, rows), allowlist))
    assert {code for i, (code, _) in found.items() if i != 7} == {"mitigation.invalid"} and found[7][0] == "mitigation.not_found"
    bare = frame(spark, [command(1, 0, "approve")]).select("command_id", "mitigation_id", "tenant_id", "at", "verb", F.lit("x").alias("place"), F.lit("y").alias("t"))
    assert outcomes(lifecycle.mitigation_log(bare, allowlist)) == {1: ("mitigation.not_found", None)}


def test_no_window_orders_the_commands_of_a_mitigation(spark, allowlist):
    log = lifecycle.mitigation_log(frame(spark, [command(1, 0, "propose")]), allowlist)
    assert "Window" not in log._jdf.queryExecution().optimizedPlan().toString()
