"""Queries and SQL for the life of mitigations, from a log of commands made of the events."""

from __future__ import annotations

from pyspark.sql import functions as F

from floodplain.functions import vocab
from floodplain.operators import lifecycle

from .incident_checks import allowlist
from .traffic_checks import v4_text
from .views import table

VERBS = ["approve", "announce", "activate", "withdraw", "finish_withdrawal", "reject", "expire", "fail", "begin_withdrawal"]
NET = 167772160


def commands(spark, sf):
    """Twelve commands a mitigation, the first of which asks for it; the others in one order, or from another verb on."""
    n = F.col("event_id")
    m, i = F.floor(n / 12), n % 12
    shift = F.when(m % 4 == 3, m % 9).otherwise(0)
    verbs = F.array(*[F.lit(v) for v in VERBS])
    verb = F.when(i == 0, F.when(m % 2 == 0, "propose").otherwise("request")).otherwise(F.element_at(verbs, ((i - 1 + shift) % 9 + 1).cast("int")))
    owner = F.when(m % 6 == 4, "globex").otherwise("acme")
    return table(spark, sf, "events").select(
        n.alias("command_id"), m.alias("mitigation_id"), F.when(n % 29 == 0, "initech").otherwise(owner).alias("tenant_id"),
        F.timestamp_seconds(m * 50 + i * (20 + 40 * (m % 2))).alias("at"), verb.alias("verb"), F.lit("operator").alias("actor_type"),
        F.concat(F.lit("op"), (m + i) % 4).alias("actor_id"), F.when(n % 17 != 0, F.lit("r")).alias("reason"),
        F.when((m % 7 == 6) & verb.isin("approve", "reject", "withdraw"), 2).alias("expected_version"), F.when(m % 5 != 0, "duration_reached").alias("cause"),
        (m % 2 == 0).alias("dry_run"), (n % 23 == 0).alias("kill_switch"), F.lit(4).alias("family"), F.lit(0).cast("bigint").alias("hi"),
        (F.lit(NET) + m % 6 * 256 + F.floor(m / 60) % 200).alias("lo"), F.lit(32).alias("prefix_len"), F.lit("rtbh").alias("action"),
        F.when(m % 11 == 10, 4000).otherwise(600).alias("duration_seconds"))


def log(spark, sf):
    return lifecycle.mitigation_log(commands(spark, sf), allowlist(spark, sf))


ENDED = "('withdrawn', 'rejected', 'expired', 'failed')"
EDGES = "(" + ", ".join(f"'{a}>{b}'" for a, b in vocab.MITIGATION_EDGES) + ")"
TARGETS = " ".join(f"WHEN '{verb}' THEN '{state}'" for verb, state in lifecycle.LEADS_TO.items())
# One command after another per mitigation, then one mitigation after another per address.
LOG_SQL = f"""WITH RECURSIVE n AS (SELECT event_id AS id, event_id // 12 AS m, event_id % 12 AS i FROM events),
    c AS MATERIALIZED (SELECT *, CAST(id AS VARCHAR) AS c, m * 50 + i * (20 + 40 * (m % 2)) AS t, CASE WHEN m % 6 = 4 THEN 'globex' ELSE 'acme' END AS owner,
      CASE WHEN i = 0 THEN CASE WHEN m % 2 = 0 THEN 'propose' ELSE 'request' END ELSE {VERBS}[(i - 1 + CASE WHEN m % 4 = 3 THEN m % 9 ELSE 0 END) % 9 + 1] END AS verb,
      'op' || (m + i) % 4 AS actor, id % 17 <> 0 AS worded, m % 5 <> 0 AS caused, m % 2 = 0 AS dry, id % 23 = 0 AS kill, {NET} + m % 6 * 256 + m // 60 % 200 AS lo FROM n),
    r AS MATERIALIZED (SELECT *, CASE WHEN id % 29 = 0 THEN 'initech' ELSE owner END AS tenant, row_number() OVER (PARTITION BY m ORDER BY t, c) AS rn FROM c),
    born AS (SELECT *, CASE WHEN i <> 0 THEN 'mitigation.not_found' WHEN NOT worded THEN 'mitigation.invalid' WHEN kill THEN 'mitigation.kill_switch'
      WHEN m % 6 = 5 OR tenant = 'initech' THEN 'mitigation.not_allowlisted' WHEN m % 11 = 10 THEN 'mitigation.too_long' END AS code FROM r WHERE rn = 1),
    w AS (SELECT m, rn, id, t, c, verb, actor, code, CAST(NULL AS VARCHAR) AS was, CASE WHEN code IS NULL THEN CASE verb WHEN 'propose' THEN 'proposed' ELSE 'requested' END END AS state,
        CASE WHEN code IS NULL THEN CAST(1 AS BIGINT) END AS version, actor AS asker, tenant, tenant AS holder, lo,
        CASE WHEN code IS NULL THEN 'r' END AS detail, CAST(NULL AS BOOLEAN) AS dry_run, CAST(NULL AS VARCHAR) AS cause FROM born
      UNION ALL SELECT m, rn, id, t, c, verb, actor, code, CASE WHEN code IS NULL OR code <> 'mitigation.not_found' THEN state END, CASE WHEN code IS NULL THEN target ELSE state END,
        CASE WHEN code IS NULL THEN version + 1 ELSE version END, asker, tenant, holder, lo,
        CASE WHEN code IS NULL THEN CASE verb WHEN 'reject' THEN 'r' WHEN 'withdraw' THEN 'operator: r' WHEN 'begin_withdrawal' THEN 'duration_reached'
          WHEN 'announce' THEN CASE WHEN dry THEN 'dry_run' END WHEN 'fail' THEN CASE WHEN worded THEN 'r' ELSE '' END END END,
        CASE WHEN code IS NULL AND verb = 'announce' THEN dry ELSE dry_run END,
        CASE WHEN code IS NULL AND verb = 'withdraw' THEN 'operator' WHEN code IS NULL AND verb = 'begin_withdrawal' THEN 'duration_reached' ELSE cause END
      FROM (SELECT *, CASE WHEN state IS NULL OR tenant <> holder THEN 'mitigation.not_found' WHEN m % 7 = 6 AND verb IN ('approve', 'reject', 'withdraw') AND version <> 2 THEN 'mitigation.version_conflict'
          WHEN verb IN ('reject', 'withdraw') AND NOT worded OR verb = 'begin_withdrawal' AND NOT caused THEN 'mitigation.invalid'
          WHEN state || '>' || target NOT IN {EDGES} OR (verb = 'finish_withdrawal' AND state = 'approved') THEN 'mitigation.illegal_transition'
          WHEN verb = 'approve' AND actor = asker THEN 'mitigation.self_approval' WHEN target IN ('approved', 'announcing') AND kill THEN 'mitigation.kill_switch' END AS code
        FROM (SELECT r.m, r.rn, r.id, r.t, r.c, r.verb, r.actor, r.worded, r.caused, r.dry, r.kill, r.tenant, r.lo, w.state, w.version, w.asker, w.holder, w.dry_run, w.cause,
            CASE WHEN r.verb IN ('withdraw', 'begin_withdrawal') AND w.state = 'approved' THEN 'withdrawn' ELSE CASE r.verb {TARGETS} END END AS target
          FROM w JOIN r ON r.m = w.m AND r.rn = w.rn + 1))),
    l AS MATERIALIZED (SELECT m, lo, min((t, c)) AS began, min(CASE WHEN code IS NULL AND state IN {ENDED} THEN (t, c) END) AS ended,
        row_number() OVER (PARTITION BY lo ORDER BY min((t, c))) AS k FROM w WHERE state IS NOT NULL GROUP BY m, lo),
    g AS (SELECT m, lo, k, true AS free, coalesce(ended, (9223372036854775807, '')) AS until FROM l WHERE k = 1
      UNION ALL SELECT l.m, l.lo, l.k, g.until <= l.began, CASE WHEN g.until <= l.began THEN coalesce(l.ended, (9223372036854775807, '')) ELSE g.until END FROM g JOIN l ON l.lo = g.lo AND l.k = g.k + 1),
    o AS (SELECT w.*, CASE WHEN NOT coalesce(free, true) THEN CASE WHEN rn = 1 THEN 'mitigation.duplicate' ELSE 'mitigation.not_found' END ELSE coalesce(code, 'applied') END AS outcome FROM w LEFT JOIN g USING (m))"""
DONE = "outcome = 'applied'"


def queries():
    return {
        "mit12_command_outcomes": lambda s, d: log(s, d).select("command_id", "outcome", "version", "from_state", "to_state", "detail"),
        "mit12_current_mitigations": lambda s, d: lifecycle.current_mitigations(log(s, d)).select(
            "mitigation_id", "tenant_id", "state", "version", "dry_run", "withdrawal_cause", "last_error", F.col("requested_by.actor_id").alias("requested_by"),
            F.col("approved_by.actor_id").alias("approved_by"), *(F.unix_seconds(c).alias(c) for c in ("created_at", "updated_at", "approved_at", "active_since", "expires_at", "ended_at"))),
        "mit11_history_of_log": lambda s, d: lifecycle.history_rows(log(s, d)).select(
            "mitigation_id", "tenant_id", "version", F.unix_seconds("occurred_at").alias("occurred_at"), "from_state", "to_state", "actor_id", "detail"),
        "mit12_outbox": lambda s, d: lifecycle.outbox_rows(log(s, d)),
        "mit12_audit": lambda s, d: lifecycle.audit_rows(log(s, d)).select("audit_id", "tenant_id", "actor_id", "action", "resource_id", "result", "reason", "before", "after"),
    }


def oracle_sql():
    at = lambda state: f"max(CASE WHEN state = '{state}' AND {DONE} THEN t END)"
    json = lambda name, value: f"""CASE WHEN {value} IS NULL THEN '' ELSE ',"{name}":"' || {value} || '"' END"""
    return {
        "mit12_command_outcomes": f"""{LOG_SQL} SELECT id AS command_id, outcome, CASE WHEN {DONE} THEN version END AS version,
            CASE WHEN outcome <> 'mitigation.not_found' THEN was END AS from_state, CASE WHEN {DONE} THEN state END AS to_state, CASE WHEN {DONE} THEN detail END AS detail FROM o""",
        "mit12_current_mitigations": f"""{LOG_SQL} SELECT m AS mitigation_id, arg_max(holder, rn) AS tenant_id, arg_max(state, rn) AS state, max(version) AS version, bool_or(dry_run) AS dry_run,
            max(cause) AS withdrawal_cause, max(CASE WHEN state = 'failed' AND {DONE} THEN detail END) AS last_error, max(asker) AS requested_by,
            max(CASE WHEN state = 'approved' AND {DONE} THEN actor END) AS approved_by, min(CASE WHEN {DONE} THEN t END) AS created_at, max(CASE WHEN {DONE} THEN t END) AS updated_at,
            {at('approved')} AS approved_at, {at('active')} AS active_since, {at('active')} + 600 AS expires_at, max(CASE WHEN state IN {ENDED} AND {DONE} THEN t END) AS ended_at
            FROM o GROUP BY m HAVING bool_or({DONE})""",
        "mit11_history_of_log": f"""{LOG_SQL} SELECT m AS mitigation_id, tenant AS tenant_id, version, t AS occurred_at, was AS from_state, state AS to_state, actor AS actor_id, detail FROM o WHERE {DONE}""",
        "mit12_outbox": f"""{LOG_SQL} SELECT m || ':' || version AS outbox_id, tenant, 'mitigation.' || state AS event_type, '{{"mitigation_id":' || m || ',"tenant_id":"' || tenant || '","prefix":"' ||
            {v4_text('lo')} || '/32","action":"rtbh","state":"' || state || '"' || {json('previous_state', 'was')} || ',"version":' || version ||
            CASE WHEN dry_run IS NULL THEN '' ELSE ',"dry_run":' || dry_run END || {json('withdrawal_cause', 'cause')} || ',"reason":"r"' || {json('detail', 'detail')} || '}}' AS payload FROM o WHERE {DONE}""",
        "mit12_audit": f"""{LOG_SQL} SELECT id AS audit_id, tenant AS tenant_id, actor AS actor_id, 'mitigation.' || verb AS action, m AS resource_id, CASE WHEN {DONE} THEN 'allowed' ELSE 'denied' END AS result,
            CASE WHEN {DONE} THEN detail ELSE outcome END AS reason, CASE WHEN outcome <> 'mitigation.not_found' THEN '{{"state":"' || was || '"}}' END AS before,
            CASE WHEN {DONE} THEN '{{"state":"' || state || '","version":' || version || '}}' END AS after FROM o""",
    }
