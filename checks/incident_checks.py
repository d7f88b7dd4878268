"""Queries and SQL for incidents, their reads, mitigations and notifications."""

from __future__ import annotations

from pyspark.sql import functions as F

from floodplain.functions import vocab
from floodplain.operators import incidents as inc
from floodplain.operators import mitigation as mit
from floodplain.operators import notify as ntf
from floodplain.operators.case import SECOND, CasePolicy
from floodplain.plans import incident_queries as iq

from .traffic_checks import ASOF, DAY, FROM, TO, v4_text
from .views import ctes, spread, table, view

NOW = 996624000  # 2001-08-01, for incidents made from orders
STAMP = "TIMESTAMP '2001-08-01'"

# --- delivered detection events, from the event table -----------------------

ARRIVALS_SQL = """
arrivals AS (
  SELECT event_id, epoch_us(ts) AS t, CASE user_id % 3 WHEN 0 THEN 'acme' WHEN 1 THEN 'globex' ELSE 'initech' END AS tenant, 'u' || user_id AS target,
    CASE event_type WHEN 'purchase' THEN 'ended' WHEN 'view' THEN 'updated' WHEN 'error' THEN 'updated' ELSE 'started' END AS kind,
    CASE WHEN event_id % 89 = 0 THEN 2 ELSE 1 END AS schema_version, event_id % 97 = 0 AS executed, event_id % 50 = 7 AS observed,
    event_id % 5 AS sequence, 'p' || event_id % 3 AS policy_id, event_id % 7 + 1 AS policy_version,
    CASE event_id % 4 WHEN 0 THEN 'info' WHEN 1 THEN 'minor' WHEN 2 THEN 'major' ELSE 'critical' END AS severity,
    row_number() OVER (PARTITION BY user_id ORDER BY ts, event_id % 5, CAST(event_id AS VARCHAR)) AS seq_no
  FROM events
), good AS (SELECT * FROM arrivals WHERE schema_version = 1 AND NOT executed AND NOT observed)"""
ARRIVALS = "WITH " + ARRIVALS_SQL


def arrivals(spark, sf):
    n = F.col("event_id")
    pick = lambda values, by: F.element_at(F.array(*[F.lit(v) for v in values]), (by % len(values) + 1).cast("int"))
    kind = F.when(F.col("event_type") == "purchase", "ended").when(F.col("event_type").isin("view", "error"), "updated").otherwise("started")
    bits = F.array_compact(F.array(*[F.when(F.shiftright(n, i).bitwiseAND(F.lit(1)) == 1, F.struct(F.lit(m).alias("metric")))
                                     for i, m in enumerate(vocab.METRIC_ORDER)]))
    return table(spark, sf, "events").select(
        n.cast("string").alias("event_id"), n.alias("number"), F.concat(F.lit("k"), n).alias("dedup_key"), F.concat(F.lit("d"), n).alias("detection_id"),
        (n % 5).alias("sequence"), kind.alias("kind"), F.when(n % 89 == 0, 2).otherwise(1).alias("schema_version"), (n % 97 == 0).alias("executed"),
        F.when(n % 50 == 7, "observed").otherwise("alerted").alias("action"), pick(["acme", "globex", "initech"], F.col("user_id")).alias("tenant"),
        F.lit("host").alias("scope_type"), F.concat(F.lit("u"), F.col("user_id")).alias("target"), F.lit("incoming").alias("direction"),
        F.lit(4).alias("family"), F.lit("clearSustained").alias("reason"), pick(["info", "minor", "major", "critical"], n).alias("severity"),
        F.concat(F.lit("p"), n % 3).alias("policy_id"), (n % 7 + 1).alias("policy_version"), bits.alias("matched"),
        F.concat(F.lit("event "), n).alias("summary"), F.col("ts").cast("timestamp").alias("observed_at"))


NO_TIMERS = CasePolicy(silent_after=None, recovery_confirmation=None, closure_delay=None)
QUICK = {"silent_after": SECOND, "recovery_confirmation": SECOND, "closure_delay": SECOND, "close_critical": True}


def no_timer_log(spark, sf):
    return inc.correlate(arrivals(spark, sf), policy=NO_TIMERS)


def commands(spark, sf):
    """A resolve and a reopen per user, and a manual incident for a target nobody attacked."""
    users = table(spark, sf, "events").select("user_id").distinct()
    verbs = F.explode(F.array(*[F.struct(F.lit(v).alias("verb"), F.lit(at).cast("bigint").alias("s")) for v, at in (
        ("acknowledge", ASOF), ("resolve", ASOF + DAY), ("close", ASOF + 2 * DAY), ("reopen", ASOF + 3 * DAY))]))
    each = users.select("user_id", verbs.alias("v"))
    tenant = F.element_at(F.array(F.lit("acme"), F.lit("globex"), F.lit("initech")), (F.col("user_id") % 3 + 1).cast("int"))
    return each.select(
        tenant.alias("tenant"), F.lit("host").alias("scope_type"), F.concat(F.lit("u"), F.col("user_id")).alias("target"), F.lit("incoming").alias("direction"),
        F.lit(4).alias("family"), F.timestamp_seconds("v.s").alias("at"), F.concat_ws("-", F.col("v.verb"), "user_id").alias("command_id"),
        F.col("v.verb").alias("verb"), F.lit("{}").alias("args"), F.lit(None).cast("string").alias("incident_id"),
        F.lit(None).cast("bigint").alias("expected_version"), F.lit("noc").alias("actor"))


# What an operator does to one target, a second apart, and what comes of it: verb, arguments, result, version.
SCRIPT = [
    ("acknowledge", "{}", "not_found", None), ("open_manual", '{"title":"watch","severity":"minor"}', "applied", 1),
    ("open_manual", '{"title":"watch","severity":"minor"}', "duplicate_active_incident", None), ("open_manual", '{"severity":"minor"}', "validation_error", None),
    ("acknowledge", "{}", "applied", 2), ("acknowledge", "{}", "state_unchanged", 2), ("acknowledge", "[1]", "validation_error", None),
    ("begin_investigation", "{}", "applied", 3), ("mark_monitoring", "{}", "applied", 4), ("close", "{}", "invalid_transition", 4),
    ("change_severity", '{"severity":"major"}', "applied", 5), ("change_severity", '{"severity":"info"}', "validation_error", 5),
    ("change_severity", '{"severity":"info","reason":"noise"}', "applied", 6), ("change_priority", "{}", "validation_error", None),
    ("change_priority", '{"priority":"nonsense"}', "validation_error", None), ("change_priority", '{"priority":"P1"}', "applied", 7),
    ("suppress", '{"reason":"works","duration_s":"an hour"}', "validation_error", None), ("suppress", '{"reason":"works","duration_s":3600}', "applied", 8),
    ("unsuppress", "{}", "applied", 9), ("assign", "{}", "validation_error", None), ("assign", '{"assignee":"ann"}', "applied", 10), ("unassign", "{}", "applied", 11),
    ("add_note", '{"body":"first"}', "applied", 12), ("edit_note", '{"note_index":0,"body":"second"}', "applied", 13),
    ("edit_note", '{"note_index":0,"body":"third"}', "validation_error", 13), ("redact_note", '{"note_index":7}', "not_found", 13),
    ("redact_note", '{"note_index":1}', "applied", 14), ("add_tag", '{"key":"k"}', "validation_error", None), ("add_tag", '{"key":"k","value":"v"}', "applied", 15),
    ("remove_tag", "{}", "validation_error", None), ("remove_tag", '{"key":"k"}', "applied", 16), ("add_tag", "{", "validation_error", None),
    ("resolve", '{"note":"done"}', "applied", 17), ("close", "{}", "applied", 18), ("reopen", '{"reason":"again"}', "applied", 19), ("dance", "{}", "unknown_command", 19),
]


def scripted(spark, sf):
    """The script above for every customer, as a target that no detection names."""
    steps = F.posexplode(F.array(*[F.struct(F.lit(verb).alias("verb"), F.lit(args).alias("args")) for verb, args, _, _ in SCRIPT])).alias("step", "c")
    each = spread(table(spark, sf, "customer"), "c_custkey").select("c_custkey", steps)
    return each.select(
        F.lit("acme").alias("tenant"), F.lit("host").alias("scope_type"), F.concat(F.lit("c"), "c_custkey").alias("target"), F.lit("incoming").alias("direction"),
        F.lit(4).alias("family"), F.timestamp_seconds(F.lit(ASOF) + F.col("step")).alias("at"), F.concat_ws("-", F.lpad(F.col("step").cast("string"), 2, "0"), "c_custkey").alias("command_id"),
        "c.verb", "c.args", F.lit(None).cast("string").alias("incident_id"), F.lit(None).cast("bigint").alias("expected_version"), F.lit("noc").alias("actor"))


def scripted_log(spark, sf):
    return inc.correlate(arrivals(spark, sf), scripted(spark, sf))


def scripted_incidents(spark, sf):
    made = inc.incidents_of(scripted_log(spark, sf)).where("created_by = 'noc'")
    return made.select(
        "target_id", "tenant_id", "state", "version", "title", "severity", "severity_source", "ever_critical", "priority", "category", "reopen_count", "assignee",
        F.size("tags").alias("tags"), F.array_join(F.transform("notes", lambda n: n["body"]), "|").alias("notes"), "suppression_reason",
        (F.unix_micros("opened_at") / 1_000_000).cast("bigint").alias("opened"), "evidence_observed")


def category_sql(has) -> str:
    """The category CASE over a predicate per metric name."""
    either = lambda *names: "(" + " OR ".join(has(n + u) for n in names for u in ("Bps", "Pps")) + ")"
    tcp, udp, icmp = either("tcp", "tcpSyn"), either("udp"), either("icmp")
    return f"""CASE WHEN CAST({tcp} AS INT) + CAST({udp} AS INT) + CAST({icmp} AS INT) >= 2 THEN 'multi_vector' WHEN {either('tcpSyn')} THEN 'tcp_syn_flood'
      WHEN {either('fragmented')} THEN 'fragmentation_flood' WHEN {icmp} THEN 'icmp_flood' WHEN {udp} THEN 'udp_flood' WHEN {tcp} THEN 'tcp_flood'
      WHEN {has('pps')} OR {has('fps')} THEN 'packet_rate' WHEN {has('bps')} THEN 'bandwidth' WHEN {either('dropped')} THEN 'drop_pressure' ELSE 'unclassified' END"""


def bit_test(expression):
    return lambda m: f"(({expression}) & {1 << vocab.METRIC_ORDER.index(m)}) <> 0"


def orders(spark, sf):
    """Incidents made from orders, with the columns the reads use."""
    df = view(spark, sf, "incidents")
    stamp = lambda c: F.col(c).cast("timestamp")
    df = df.withColumn("opened_at", stamp("opened_at")).withColumn("last_detected_at", stamp("last_detected_at"))
    df = df.withColumn("resolved_at", F.when(F.col("state").isin("resolved", "closed"), F.col("opened_at"))).withColumn(
        "closed_at", F.when(F.col("state") == "closed", F.col("opened_at"))).withColumn("recovering_since", F.col("opened_at"))
    df = inc.with_priority(df).drop("severity_rank")
    return df.withColumn("incident_number", F.concat(F.lit("INC-"), "incident_id"))


ORDERS = "WITH " + ctes("incidents")


def mitigations(spark, sf):
    df = view(spark, sf, "mitigations")
    created = F.timestamp_seconds("created_epoch_s")
    return df.select(
        "mitigation_id", "incident_id", "tenant_id", F.lit(4).alias("family"), F.lit(0).cast("bigint").alias("hi"), F.col("prefix_lo").alias("lo"),
        "prefix_len", "action", "state", "dry_run", "duration_seconds", created.alias("created_at"), created.alias("updated_at"),
        F.timestamp_seconds(F.col("created_epoch_s") + F.col("duration_seconds")).alias("expires_at"),
        F.when(F.col("mitigation_id") % 4 != 1, F.lit("{}")).alias("route"),
        F.when(F.col("mitigation_id") % 2 == 0, F.lit(17)).alias("match_protocol"),
        F.when(F.col("mitigation_id") % 4 == 0, F.when(F.col("mitigation_id") % 8 == 0, F.lit(53)).otherwise(F.lit(123))).alias("match_source_port"))


def allowlist(spark, sf):
    return view(spark, sf, "allowlist").select(
        "tenant", "family", "prefix_len", F.lit(0).cast("bigint").alias("net_hi"), F.col("net_lo").cast("bigint").alias("net_lo"), F.split("actions", ",").alias("actions"))


MIT = "WITH " + ctes("mitigations", "allowlist")
LIVE = "('proposed', 'requested', 'approved', 'announcing', 'active', 'withdrawing')"
DUPLICATE_SQL = f"""action || '|' || {v4_text('prefix_lo')} || '/' || prefix_len || '|' || CASE WHEN action LIKE 'flowspec%' THEN
    CASE WHEN mitigation_id % 2 = 0 THEN 'proto=17;' ELSE '' END || CASE WHEN mitigation_id % 8 = 0 THEN 'sport=53;' WHEN mitigation_id % 4 = 0 THEN 'sport=123;' ELSE '' END ELSE '' END"""


def requests(spark, sf):
    """Mitigation requests with matches and rates, some broken, from customers."""
    n = F.col("mitigation_id")
    df = mitigations(spark, sf)
    return df.withColumn("bytes_per_second", F.when(n % 6 == 0, (n * 1_000_000_0).cast("bigint"))).withColumn(
        "match_protocol", F.when(n % 4 == 0, F.element_at(F.array(F.lit(6), F.lit(17), F.lit(1)), (n % 3 + 1).cast("int")))).withColumn(
        "match_source_port", F.when(n % 5 == 0, F.lit(53))).withColumn("match_destination_port", F.when(n % 9 == 0, F.lit(443))).withColumn(
        "match_source_family", F.when(n % 8 == 0, F.when(n % 16 == 0, F.lit(6)).otherwise(F.lit(4)))).withColumn(
        "action", F.when(n % 2 == 0, F.when(n % 12 < 6, F.lit("flowspec_rate_limit")).otherwise(F.lit("flowspec_discard"))).otherwise(F.col("action")))


def entries(spark, sf):
    """An allowlist with overlaps, one entry per supplier."""
    n = F.col("s_suppkey")
    tenant = F.when(n % 40 == 0, F.lit(" ")).otherwise(F.concat(F.lit("t"), n % 3))
    return table(spark, sf, "supplier").select(
        n.alias("position"), tenant.alias("tenant"), F.lit(4).alias("family"), (F.lit(14) + n % 12).cast("int").alias("prefix_len"), F.lit(0).cast("bigint").alias("net_hi"),
        (F.lit(167772160).cast("bigint") + (n % 50) * 4096).alias("net_lo"), F.when(n % 33 == 0, F.array().cast("array<string>")).otherwise(F.array(F.lit("rtbh"))).alias("actions"))


ENTRIES = """WITH raw AS (SELECT s_suppkey AS position, CASE WHEN s_suppkey % 40 = 0 THEN ' ' ELSE 't' || s_suppkey % 3 END AS tenant, 14 + s_suppkey % 12 AS n,
    167772160 + (s_suppkey % 50) * 4096 AS addr, s_suppkey % 33 = 0 AS bare FROM supplier), e AS (SELECT *, addr - addr % CAST(pow(2, 32 - n) AS BIGINT) AS lo FROM raw)"""


def timeline(spark, sf):
    return view(spark, sf, "timeline").withColumn("occurred_at", F.col("occurred_at").cast("timestamp"))


def detections(spark, sf):
    return view(spark, sf, "timeline").where("entry_type IN ('event_linked', 'late_event_linked')").select(
        "incident_id", F.col("timeline_id").cast("string").alias("event_id"), F.col("occurred_at").cast("timestamp").alias("detected_at"), "entry_type")


def notes(spark, sf):
    """Notes of each incident in event order; every third supersedes the one before."""
    from pyspark.sql import Window

    df = view(spark, sf, "timeline").where("entry_type = 'note_added'")
    index = (F.row_number().over(Window.partitionBy("incident_id").orderBy("timeline_id")) - 1).cast("int")
    df = df.select("incident_id", index.alias("note_index"), F.concat(F.lit("note "), "timeline_id").alias("body"), (F.col("timeline_id") % 7 == 0).alias("redacted"))
    return df.withColumn("supersedes", F.when((F.col("note_index") % 3 == 2), F.col("note_index") - 1))


NOTES = f"""WITH {ctes('timeline')}, n AS (SELECT incident_id, CAST(row_number() OVER (PARTITION BY incident_id ORDER BY timeline_id) - 1 AS INTEGER) AS note_index,
    'note ' || timeline_id AS body, timeline_id % 7 = 0 AS redacted FROM timeline WHERE entry_type = 'note_added'),
  notes AS (SELECT *, CASE WHEN note_index % 3 = 2 THEN note_index - 1 END AS supersedes FROM n)"""


def queue(spark, sf, shift=0):
    """A work queue from orders: a status per row and when it was done."""
    statuses = F.array(*[F.lit(s) for s in ("pending", "retrying", "published", "dead_letter")])
    return table(spark, sf, "orders").select(
        F.col("o_orderkey").alias("id"), F.element_at(statuses, ((F.col("o_orderkey") + shift) % 4 + 1).cast("int")).alias("status"),
        F.col("o_orderdate").cast("timestamp").alias("published_at"), F.when(F.col("o_orderkey") % 3 == 0, F.col("o_orderdate").cast("timestamp")).alias("reviewed_at"),
        F.col("o_orderdate").cast("timestamp").alias("first_seen_at"))


def peers(spark, sf, later=False):
    n = F.col("s_suppkey")
    states = ["established", "idle", "active", "established"] if later else ["established", "established", "idle", "active"]
    df = table(spark, sf, "supplier").where(n % 5 != 0 if later else n % 7 != 0)
    return df.select(F.concat(F.lit("192.0.2."), n).alias("neighbor_address"), (F.lit(64500).cast("bigint") + n).alias("peer_asn"),
                     F.element_at(F.array(*[F.lit(s) for s in states]), (n % 4 + 1).cast("int")).alias("session_state"))


def owned_routes(spark, sf):
    """Routes a speaker holds: those of two thirds of the mitigations."""
    return mitigations(spark, sf).where("mitigation_id % 3 <> 0").transform(mit.with_duplicate_key).select("duplicate_key").distinct()


def both_families(spark, sf):
    """Incidents of which every seventh is of an IPv6 host."""
    n = F.col("incident_id")
    return orders(spark, sf).withColumn("target_id", F.when((n % 7 == 0) & (F.col("target_type") == "host"), F.concat(F.lit("2001:db8::"), F.lower(F.hex(n % 4096 + 1)))).otherwise(F.col("target_id")))


def wider_allowlist(spark, sf):
    more = spark.createDataFrame([("acme", 6, 48, 2306139568115548160, 0, ["rtbh"]), ("globex", 6, 40, 2306139568115548160, 0, ["rtbh"])],
                                 "tenant STRING, family INT, prefix_len INT, net_hi BIGINT, net_lo BIGINT, actions ARRAY<STRING>")
    return allowlist(spark, sf).unionByName(more)


CANDIDATES = f"""WITH {ctes('incidents', 'mitigations', 'allowlist')}, c AS (SELECT *, CASE WHEN incident_id % 7 = 0 THEN 6 ELSE 4 END AS family FROM incidents i
      WHERE target_type = 'host' AND direction = 'incoming' AND state IN ('open', 'acknowledged', 'investigating', 'monitoring') AND severity IN ('critical', 'major')
      AND opened_at >= {STAMP} - INTERVAL {400 * DAY} SECONDS AND NOT EXISTS (SELECT 1 FROM mitigations m WHERE m.incident_id = i.incident_id)),
    g AS (SELECT c.*, CASE WHEN family = 6 THEN 'acme;rtbh' ELSE (SELECT a.tenant || ';' || a.actions FROM allowlist a WHERE (c.target_lo & a.mask_lo) = a.net_lo
      ORDER BY a.prefix_len DESC LIMIT 1) END AS e FROM c),
    allowed AS (SELECT incident_id, tenant_id AS tenant, severity, family, CASE family WHEN 6 THEN 128 ELSE 32 END AS prefix_len, opened_at
      FROM g WHERE split_part(e, ';', 1) = tenant_id AND list_contains(string_split(split_part(e, ';', 2), ','), 'rtbh'))"""


def outbox(spark, sf):
    kinds = F.array(*[F.lit(k) for k in ("incident.opened", "incident.updated", "incident.closed", "incident.recovering")])
    return table(spark, sf, "orders").select(
        F.col("o_orderkey").alias("outbox_id"), F.col("o_orderkey").alias("incident_id"),
        F.element_at(F.array(F.lit("acme"), F.lit("globex"), F.lit("initech")), (F.col("o_custkey") % 3 + 1).cast("int")).alias("tenant"),
        F.element_at(kinds, (F.col("o_orderkey") % 4 + 1).cast("int")).alias("event_type"))


CHANGES = ["mitigation.proposed", "mitigation.active", "mitigation.withdrawn", "mitigation.failed", "bgp.peer_down", "bgp.peer_up", "mitigation.kill_switch_engaged"]


def changes(spark, sf):
    """Changes of mitigations, the kill switch and peers, by order number."""
    n = F.col("o_orderkey")
    kinds = F.array(*[F.lit(k) for k in CHANGES])
    payload = F.when(n % 5 == 0, F.lit('{"withdrawal_cause":"kill_switch"}')).otherwise(F.concat(F.lit('{"incident_id":"i'), n, F.lit('"}')))
    return table(spark, sf, "orders").select(
        n.alias("outbox_id"), F.element_at(F.array(F.lit("acme"), F.lit("globex"), F.lit("initech")), (n % 3 + 1).cast("int")).alias("tenant"),
        F.element_at(kinds, (n % 7 + 1).cast("int")).alias("event_type"), payload.alias("payload"))


def change_routes(spark):
    return spark.createDataFrame([("acme", CHANGES, "major", ["noc"]), ("acme", ["bgp.peer_up", "mitigation.failed"], None, ["noc", "hook"]), ("globex", CHANGES, "critical", ["mail"])],
                                 "tenant STRING, events ARRAY<STRING>, min_severity STRING, channels ARRAY<STRING>")


CHANGES_SQL = f"""WITH c AS (SELECT o_orderkey AS outbox_id, o_orderkey % 3 AS t, o_orderkey % 5 = 0 AS killed, {CHANGES}[o_orderkey % 7 + 1] AS event_type FROM orders),
    s AS (SELECT *, CASE WHEN event_type IN ('mitigation.failed', 'bgp.peer_down', 'mitigation.kill_switch_engaged') THEN 'critical'
      WHEN event_type IN ('mitigation.proposed', 'mitigation.active') OR (event_type = 'mitigation.withdrawn' AND killed) THEN 'major' ELSE 'minor' END AS severity FROM c)
    SELECT DISTINCT outbox_id, severity, CASE WHEN NOT killed THEN 'i' || outbox_id END AS incident_id, channel FROM (
      SELECT *, 'noc' AS channel FROM s WHERE t = 0 AND severity <> 'minor' UNION ALL
      SELECT *, unnest(['noc', 'hook']) FROM s WHERE t = 0 AND event_type IN ('bgp.peer_up', 'mitigation.failed') UNION ALL
      SELECT *, 'mail' FROM s WHERE t = 1 AND severity = 'critical')"""


def routes(spark, sf):
    return view(spark, sf, "routes").select("tenant", F.split("events", ",").alias("events"), "min_severity", F.split("channels", ",").alias("channels"))


def messages(spark, sf):
    """Notification attempts from the event stream, a sixtieth of the time apart."""
    squeezed = F.timestamp_micros(F.lit(FROM * 1_000_000) + F.floor((F.unix_micros(F.col("ts").cast("timestamp")) - FROM * 1_000_000) / 600))
    return table(spark, sf, "events").select(
        F.col("event_id").alias("message_id"), F.concat(F.lit("c"), F.col("user_id") % 3).alias("channel"), (F.col("user_id") % 10).alias("incident_id"),
        "event_type", squeezed.alias("at"))


MESSAGES = f"""msg AS MATERIALIZED (SELECT event_id AS message_id, 'c' || user_id % 3 AS channel, user_id % 10 AS incident_id, event_type,
    {FROM * 1_000_000} + CAST(floor((epoch_us(ts) - {FROM * 1_000_000}) / 600) AS BIGINT) AS t FROM events)"""


def moves(spark, sf, states, column="c_custkey"):
    """Every kind of state change, by customer number."""
    n, size = F.col(column), len(states)
    at = lambda e: F.element_at(F.array(*[F.lit(s) for s in states]), (e % size + 1).cast("int"))
    return table(spark, sf, "customer").select(
        n.alias("id"), at(n).alias("from_state"), at(F.floor(n / size)).alias("to_state"),
        F.when(F.floor(n / (size * size)) % 2 == 0, "automatic").otherwise("operator").alias("actor_kind"))


def moves_sql(states):
    listed = "[" + ", ".join(f"'{s}'" for s in states) + "]"
    n = len(states)
    return f"""SELECT c_custkey AS id, {listed}[c_custkey % {n} + 1] AS from_state, {listed}[c_custkey // {n} % {n} + 1] AS to_state,
        CASE WHEN c_custkey // {n * n} % 2 = 0 THEN 'automatic' ELSE 'operator' END AS actor_kind FROM customer"""


def edges_sql(edges):
    return "(" + " OR ".join(f"(from_state = '{a}' AND to_state = '{b}')" for a, b in edges) + ")"


MIT_STATES = vocab.MITIGATION_LIVE + vocab.MITIGATION_ENDED
MIT_NOW = 20_000


def now():
    return F.timestamp_seconds(F.lit(NOW))


def queries():
    asof = lambda s: F.timestamp_seconds(F.lit(s))
    count = lambda df, *keys: df.groupBy(*keys).agg(F.count(F.lit(1)).alias("n"))
    fields = ["tenant_id", "target_id", "state", "severity", "ever_critical", "priority", "version", "title", "category", "evidence_observed"]
    return {
        "inc1_dedup": lambda s, d: inc.dedup_events(arrivals(s, d).withColumn("dedup_key", F.concat(F.lit("k"), F.col("number") % 4000))).select(
            "tenant", "dedup_key", F.col("number").alias("event_id")),
        "inc2_gate": lambda s, d: inc.gate_events(arrivals(s, d).withColumn("dedup_key", F.concat(F.lit("k"), F.col("number") % 4000))).select(
            F.col("number").alias("event_id"), "gate"),
        "inc3_outcomes": lambda s, d: count(inc.outcomes_of(inc.correlate(arrivals(s, d), asof=TO)), "outcome"),
        "inc3_outcomes_without_timers": lambda s, d: inc.outcomes_of(no_timer_log(s, d)).select("event_id", "outcome"),
        "inc4_created": lambda s, d: inc.incidents_of(no_timer_log(s, d)).select(
            *fields, F.unix_micros("opened_at").alias("opened_at"), F.unix_micros("last_detected_at").alias("last_detected_at")),
        "inc5_links": lambda s, d: inc.links_of(no_timer_log(s, d)).select("event_id", "link_type"),
        "inc5_bookkeeping": lambda s, d: inc.link_bookkeeping(linked(s, d), 40).select("incident_id", "evidence_observed", "category", "evidence_omitted"),
        "inc6_category": lambda s, d: arrivals(s, d).select(F.col("number").alias("event_id"),
                                                            inc.derive_category(F.transform("matched", lambda r: r["metric"])).alias("category")),
        "inc7_priority": lambda s, d: orders(s, d).select("incident_id", "priority"),
        "inc8_recovery_causes": lambda s, d: inc.correlation_report(inc.correlate(arrivals(s, d), asof=TO), inc.gate_events(arrivals(s, d))),
        "inc9_zero_reopen_window": lambda s, d: inc.outcomes_of(inc.correlate(arrivals(s, d), policy=CasePolicy(reopen_window=0, **QUICK))).select(
            "event_id", "outcome"),
        "inc9_long_reopen_window": lambda s, d: inc.outcomes_of(inc.correlate(
            arrivals(s, d), policy=CasePolicy(reopen_window=6 * 3600 * SECOND, **QUICK))).select("event_id", "outcome"),
        "inc10_retained_evidence": lambda s, d: inc.retained_evidence(linked(s, d), 7, ["observed_at", "event_id"]).select(
            "incident_id", "event_id", "position", "evidence_omitted"),
        "inc11_policy_refs": lambda s, d: inc.policy_refs(linked(s, d)).select(
            "incident_id", "policy_id", "first_seen_sequence", "last_seen_sequence", "policy_version"),
        "inc12_numbers": lambda s, d: inc.assign_numbers(orders(s, d).drop("incident_number")).select("incident_id", "incident_number"),
        "inc13_silent": lambda s, d: inc.silent_incidents(orders(s, d), now()).select("incident_id"),
        "inc14_recovered": lambda s, d: inc.recovered_incidents(orders(s, d), now()).select("incident_id"),
        "inc15_closable": lambda s, d: inc.closable_incidents(orders(s, d), now()).select("incident_id"),
        "inc15_maintenance": lambda s, d: count(inc.run_maintenance(orders(s, d), now()), "state", "next_state", "cause"),
        "inc16_lifecycle_guard": lambda s, d: inc.guard_transitions(moves(s, d, vocab.INCIDENT_STATES)),
        "inc17_commands": lambda s, d: count(inc.command_results_of(inc.correlate(arrivals(s, d), commands(s, d), TO)), "verb", "result"),
        "inc17_verbs": lambda s, d: inc.command_results_of(scripted_log(s, d)).select("command_id", "verb", "result", "version"),
        "inc21_manual_incidents": scripted_incidents,
        "inc18_suppressed": lambda s, d: orders(s, d).select("incident_id", inc.suppressed(
            now(), "opened_at").alias("suppressed")),
        "inc19_duplicate_active": lambda s, d: inc.duplicate_active(orders(s, d), ["tenant_id", "target_type", "target_id", "direction"]),
        "inc20_known_tenants": lambda s, d: count(inc.route_by_tenant(arrivals(s, d), acme_globex(s, d))[0], "tenant"),
        "inc20_refused_tenants": lambda s, d: inc.route_by_tenant(arrivals(s, d), acme_globex(s, d))[1],
        "inc22_report": lambda s, d: inc.correlation_report(no_timer_log(s, d), inc.gate_events(arrivals(s, d))),
        "d18_timeline": lambda s, d: count(inc.timeline_of(no_timer_log(s, d)), "entry_type"),
        "d19_outbox": lambda s, d: count(inc.outbox_of(no_timer_log(s, d)), "tenant", "event_type"),
        "iq1_list": lambda s, d: iq.list_incidents(orders(s, d), "acme", states=["open", "acknowledged"], severities=["critical", "major"], limit=50).select(
            "incident_id", "state", "has_more"),
        "iq1_second_page": lambda s, d: iq.list_incidents(
            orders(s, d), "globex", sort="last_detected_at", order="asc", after=(700_000_000_000_000, 500), direction="incoming", limit=200).select(
            "incident_id", "has_more"),
        "iq2_count": lambda s, d: iq.count_incidents(orders(s, d), "acme", target_type="host", opened_between=(NOW - 90 * DAY, NOW)),
        "iq3_timeline": lambda s, d: iq.incident_timeline(timeline(s, d), 7, 1000, 10).select("timeline_id", "entry_type", "has_more"),
        "iq4_audit": lambda s, d: iq.incident_audit(timeline(s, d).withColumnRenamed("timeline_id", "audit_id"), 9, 500, 5).select("audit_id", "has_more"),
        "iq5_detections": lambda s, d: iq.incident_detections(detections(s, d), 11, (FROM * 1_000_000 + 5 * DAY * 1_000_000, ""), 5).select("event_id", "has_more"),
        "iq6_notes": lambda s, d: iq.incident_notes(notes(s, d)).select("incident_id", "note_index", "body"),
        "iq6_notes_with_history": lambda s, d: iq.incident_notes(notes(s, d), True).select("incident_id", "note_index", "superseded_by"),
        "iq7_mitigation_status": lambda s, d: count(iq.mitigation_status(
            orders(s, d), mitigations(s, d).withColumn("incident_id", F.floor(F.col("mitigation_id") / 4) * 3)), "tenant_id", "mitigation_status"),
        "iq8_notification_status": lambda s, d: iq.notification_status(timeline(s, d)),
        "iq9_timeline_pressure": lambda s, d: iq.timeline_pressure(orders(s, d), timeline(s, d)),
        "iq10_queue_stats": lambda s, d: iq.queue_stats(queue(s, d), queue(s, d, 1), queue(s, d)),
        "iq11_purge_closed": lambda s, d: iq.keep_children(timeline(s, d), orders(s, d), iq.purge_closed(orders(s, d), now())).select("timeline_id"),
        "iq11_purge_outbox": lambda s, d: iq.purge_queue(queue(s, d), now(), "published", "published_at", 7).select("id"),
        "iq11_purge_dead_letters": lambda s, d: iq.purge_dead_letters(queue(s, d), now()).select("id"),
        "snk4_export": lambda s, d: iq.export_incidents(
            iq.filter_incidents(orders(s, d), "acme"), timeline(s, d), notes(s, d), detections(s, d), max_rows=10).select(
            "incident_id", F.get_json_object("document", "$.truncated.timeline").alias("cut"),
            F.get_json_object("document", "$.timeline[0].timeline_id").alias("first_entry"), F.get_json_object("document", "$.incident.state").alias("state")),
        "mit1_guard": lambda s, d: mit.guard_check(mitigations(s, d).withColumnRenamed("tenant_id", "tenant"), allowlist(s, d)).select("mitigation_id", "refusal"),
        "mit2_allowlist": lambda s, d: mit.validate_allowlist(entries(s, d)),
        "mit2_config": lambda s, d: mit.validate_guard_config(table(s, d, "customer").select(
            "c_custkey", (F.col("c_custkey") % 40).alias("min_length_4"), (F.col("c_custkey") % 131).alias("min_length_6"),
            (F.col("c_custkey") * 700).alias("max_duration_seconds"), (F.col("c_custkey") * 90).alias("approval_window_seconds"))).select("c_custkey", "error_code"),
        "mit3_action": lambda s, d: mit.validate_action(requests(s, d)).select("mitigation_id", "error_code"),
        "mit4_canonical": lambda s, d: mit.canonical_prefix_check(mitigations(s, d).withColumn(
            "prefix_len", F.when(F.col("mitigation_id") % 5 == 0, F.lit(24)).otherwise(F.col("prefix_len")))).select("mitigation_id", "error_code", "intended"),
        "mit5_duplicates": lambda s, d: mit.duplicate_mitigations(mitigations(s, d)),
        "mit6_candidates": lambda s, d: mit.proposal_candidates(
            both_families(s, d), mitigations(s, d), wider_allowlist(s, d), now(), ["critical", "major"], 400 * DAY, 600).select("incident_id", "tenant", "severity", "family", "prefix_len"),
        "mit6_first_candidates": lambda s, d: mit.proposal_candidates(
            both_families(s, d), mitigations(s, d), wider_allowlist(s, d), now(), ["critical", "major"], 400 * DAY, 600, limit=20).select("incident_id", "family"),
        "mit7_due_work": lambda s, d: mit.due_work(mitigations(s, d), asof(MIT_NOW)).select("mitigation_id", "approval_expired", "duration_reached", "next_action"),
        "mit7_due_work_killed": lambda s, d: count(mit.due_work(mitigations(s, d), asof(MIT_NOW), kill_switch=True), "state", "next_action"),
        "mit8_reconcile": lambda s, d: mit.reconcile(owned_routes(s, d), mitigations(s, d)),
        "mit9_peer_events": lambda s, d: mit.peer_events(peers(s, d), peers(s, d, True)),
        "mit10_list": lambda s, d: mit.list_mitigations(mitigations(s, d), "acme", "live", 100).select("mitigation_id", "state", "has_more"),
        "mit10_next_page": lambda s, d: mit.list_mitigations(mitigations(s, d), "acme", "all", 20, after=(asof(37 * 600), 600)).select("mitigation_id", "has_more"),
        "mit10_routed": lambda s, d: mit.list_mitigations(mitigations(s, d), "globex", "routed").select("mitigation_id", "state"),
        "mit11_history": lambda s, d: mit.mitigation_history(table(s, d, "events").select(
            (F.col("event_id") % 100).alias("mitigation_id"), F.lit("acme").alias("tenant_id"), F.floor(F.col("event_id") / 100).alias("version"), "event_type"), 42, "acme"),
        "mit12_lifecycle_guard": lambda s, d: mit.guard_transitions(moves(s, d, MIT_STATES)),
        "mit13_peers": lambda s, d: mit.list_peers(peers(s, d)),
        "fn10_duplicate_key": lambda s, d: requests(s, d).select("mitigation_id", mit.duplicate_key(mit.canonical_match(
            F.col("match_protocol"), F.lit(None), F.col("match_source_port"), F.col("match_destination_port"))).alias("duplicate_key")),
        "ntf1_route": lambda s, d: ntf.route_notifications(outbox(s, d), orders(s, d), routes(s, d)).select("outbox_id", "channel"),
        "ntf2_dedup": lambda s, d: ntf.dedup_notifications(messages(s, d)).select("message_id", "kept"),
        "ntf1_route_changes": lambda s, d: ntf.route_changes(changes(s, d), change_routes(s)).select("outbox_id", "severity", "incident_id", "channel"),
        "ntf2_ntf3_deliverable": lambda s, d: ntf.deliverable(messages(s, d), per_minute=2).select("message_id", "outcome"),
        "ntf3_rate_limit": lambda s, d: ntf.rate_limit(messages(s, d), 2).select("message_id", "sent"),
        "ntf4_notice": lambda s, d: ntf.render_notice(
            ntf.route_notifications(outbox(s, d), orders(s, d), routes(s, d)),
            orders(s, d).withColumn("title", F.lit("t")).withColumn("mitigation_status", F.lit(None).cast("string")), "https://ui.example/").select(
            "outbox_id", "channel", "link", "body"),
        "ntf5_results": lambda s, d: ntf.record_results(messages(s, d).withColumn(
            "event_type", F.when(F.col("message_id") % 10 == 0, F.lit("not plain")).otherwise(F.col("event_type"))).withColumn("outcome", F.lit("delivered"))).select(
            "incident_id", "entry_type", "payload"),
    }


def linked(spark, sf):
    """Detection events as linked to one incident per user."""
    return arrivals(spark, sf).withColumn("incident_id", F.col("target"))


def acme_globex(spark, sf):
    return table(spark, sf, "nation").select(F.when(F.col("n_nationkey") % 2 == 0, "acme").otherwise("globex").alias("tenant"))


def oracle_sql():
    first_start = f"{ARRIVALS}, o AS (SELECT *, min(CASE WHEN kind <> 'ended' THEN seq_no END) OVER (PARTITION BY target) AS opener FROM good)"
    bits = "CAST(event_id AS BIGINT) % 32768"
    prior = f"""{ARRIVALS}, o AS (SELECT *, max(CASE WHEN kind <> 'ended' THEN t END) OVER (PARTITION BY target ORDER BY seq_no
      ROWS BETWEEN UNBOUNDED PRECEDING AND 1 PRECEDING) AS before FROM good)"""
    covering = """(SELECT a.tenant || ';' || a.actions FROM allowlist a WHERE a.prefix_len <= m.prefix_len AND (m.prefix_lo & a.mask_lo) = a.net_lo
        ORDER BY a.prefix_len DESC LIMIT 1)"""
    statuses = "['pending', 'retrying', 'published', 'dead_letter']"
    peer = lambda states: "[" + ", ".join(f"'{s}'" for s in states) + "][s_suppkey % 4 + 1]"
    before_peers = f"SELECT '192.0.2.' || s_suppkey AS neighbor_address, 64500 + s_suppkey AS peer_asn, {peer(['established', 'established', 'idle', 'active'])} AS session_state FROM supplier WHERE s_suppkey % 7 <> 0"
    later_peers = f"SELECT '192.0.2.' || s_suppkey AS neighbor_address, 64500 + s_suppkey AS peer_asn, {peer(['established', 'idle', 'active', 'established'])} AS session_state FROM supplier WHERE s_suppkey % 5 <> 0"
    req = f"""WITH {ctes('mitigations')}, r AS (SELECT mitigation_id AS n, prefix_len, prefix_lo,
        CASE WHEN mitigation_id % 2 = 0 THEN CASE WHEN mitigation_id % 12 < 6 THEN 'flowspec_rate_limit' ELSE 'flowspec_discard' END ELSE action END AS action,
        CASE WHEN mitigation_id % 6 = 0 THEN mitigation_id * 10000000 END AS rate, CASE WHEN mitigation_id % 4 = 0 THEN [6, 17, 1][mitigation_id % 3 + 1] END AS proto,
        mitigation_id % 5 = 0 AS sport, mitigation_id % 9 = 0 AS dport, CASE WHEN mitigation_id % 8 = 0 THEN CASE WHEN mitigation_id % 16 = 0 THEN 6 ELSE 4 END END AS sf FROM mitigations)"""
    routed_sql = f"""WITH {ctes('incidents', 'routes')}, ob AS (SELECT o_orderkey AS outbox_id, ['acme', 'globex', 'initech'][o_custkey % 3 + 1] AS tenant,
        ['incident.opened', 'incident.updated', 'incident.closed', 'incident.recovering'][o_orderkey % 4 + 1] AS event_type FROM orders),
      rk AS (SELECT * FROM (VALUES ('info', 0), ('minor', 1), ('major', 2), ('critical', 3)) v(s, r)),
      told AS (SELECT DISTINCT ob.outbox_id, ob.event_type, ob.tenant, unnest(string_split(r.channels, ',')) AS channel FROM ob JOIN incidents i ON i.incident_id = ob.outbox_id
        JOIN rk a ON a.s = i.severity JOIN routes r ON r.tenant = ob.tenant AND list_contains(string_split(r.events, ','), ob.event_type)
        LEFT JOIN rk b ON b.s = r.min_severity WHERE r.min_severity IS NULL OR a.r >= b.r)"""
    return {
        "inc17_verbs": f"""SELECT lpad(CAST(step AS VARCHAR), 2, '0') || '-' || c_custkey AS command_id, verb, result, CAST(version AS BIGINT) AS version
            FROM customer, (VALUES {", ".join(f"({k}, '{verb}', '{result}', {version or 'NULL'})" for k, (verb, _, result, version) in enumerate(SCRIPT))}) AS v(step, verb, result, version)""",
        "inc21_manual_incidents": f"""SELECT 'c' || c_custkey AS target_id, 'acme' AS tenant_id, 'open' AS state, CAST(19 AS BIGINT) AS version, 'watch' AS title, 'info' AS severity,
            'operator' AS severity_source, false AS ever_critical, 'P1' AS priority, 'unclassified' AS category, 1 AS reopen_count, CAST(NULL AS VARCHAR) AS assignee, 0 AS tags,
            'first||done' AS notes, CAST(NULL AS VARCHAR) AS suppression_reason, CAST({ASOF + 1} AS BIGINT) AS opened, CAST(0 AS BIGINT) AS evidence_observed FROM customer""",
        "inc1_dedup": f"""{ARRIVALS} SELECT tenant, 'k' || event_id % 4000 AS dedup_key, arg_min(event_id, (t, sequence, CAST(event_id AS VARCHAR))) AS event_id
            FROM arrivals GROUP BY ALL""",
        "inc2_gate": f"""{ARRIVALS} SELECT event_id, CASE WHEN schema_version > 1 OR executed THEN 'quarantined' WHEN observed THEN 'observeOnly'
            WHEN row_number() OVER (PARTITION BY tenant, event_id % 4000, schema_version > 1 OR executed OR observed ORDER BY t, sequence, CAST(event_id AS VARCHAR)) > 1
            THEN 'duplicate' END AS gate FROM arrivals""",
        "inc3_outcomes_without_timers": f"""{first_start} SELECT CAST(event_id AS VARCHAR) AS event_id, CASE WHEN opener IS NULL OR seq_no < opener THEN 'quarantined'
            WHEN seq_no = opener THEN 'created' ELSE 'updated' END AS outcome FROM o""",
        "inc4_created": f"""{first_start}, i AS (SELECT target, tenant, opener, count(*) AS n, bit_or({bits}) AS m,
              min(CASE WHEN seq_no = opener THEN t END) AS opened_at, max(t) AS last_detected_at, max(CASE WHEN seq_no = opener THEN severity END) AS severity,
              max(CASE WHEN seq_no = opener THEN 'event ' || event_id END) AS title, bool_or(kind = 'ended' AND seq_no > opener) AS ended FROM o WHERE seq_no >= opener GROUP BY ALL)
            SELECT tenant AS tenant_id, target AS target_id, CASE WHEN ended THEN 'recovering' ELSE 'open' END AS state, severity, severity = 'critical' AS ever_critical,
              CASE severity WHEN 'critical' THEN 'P1' WHEN 'major' THEN 'P2' WHEN 'minor' THEN 'P3' ELSE 'P4' END AS priority,
              n + CASE WHEN ended THEN 1 ELSE 0 END AS version, title, {category_sql(bit_test('m'))} AS category, n AS evidence_observed, opened_at, last_detected_at FROM i""",
        "inc5_links": f"""{first_start} SELECT CAST(event_id AS VARCHAR) AS event_id, CASE WHEN seq_no = opener THEN 'opening' ELSE 'update' END AS link_type
            FROM o WHERE seq_no >= opener""",
        "inc5_bookkeeping": f"""{ARRIVALS} SELECT target AS incident_id, count(*) AS evidence_observed, {category_sql(bit_test(f'bit_or({bits})'))} AS category,
            greatest(count(*) - 40, 0) AS evidence_omitted FROM arrivals GROUP BY target""",
        "inc6_category": f"{ARRIVALS} SELECT event_id, {category_sql(bit_test(bits))} AS category FROM arrivals",
        "inc7_priority": f"""{ORDERS} SELECT incident_id, CASE severity WHEN 'critical' THEN 'P1' WHEN 'major' THEN 'P2' WHEN 'minor' THEN 'P3' ELSE 'P4' END AS priority FROM incidents""",
        "inc9_zero_reopen_window": f"""{prior} SELECT CAST(event_id AS VARCHAR) AS event_id, CASE
            WHEN before IS NOT NULL AND t < before + 2000000 THEN 'updated' WHEN kind <> 'ended' THEN 'created' WHEN before IS NULL THEN 'quarantined' ELSE 'linked_late' END AS outcome FROM o""",
        "inc9_long_reopen_window": f"""{prior} SELECT CAST(event_id AS VARCHAR) AS event_id, CASE
            WHEN before IS NOT NULL AND t < before + 2000000 THEN 'updated' WHEN kind = 'ended' THEN CASE WHEN before IS NULL THEN 'quarantined' ELSE 'linked_late' END
            WHEN before IS NULL OR t - (before + 3000000) > {6 * 3600 * 1_000_000} THEN 'created' ELSE 'reopened' END AS outcome FROM o""",
        "inc10_retained_evidence": f"""{ARRIVALS}, r AS (SELECT target AS incident_id, CAST(event_id AS VARCHAR) AS event_id,
              row_number() OVER (PARTITION BY target ORDER BY t, CAST(event_id AS VARCHAR)) AS position, greatest(count(*) OVER (PARTITION BY target) - 7, 0) AS evidence_omitted FROM arrivals)
            SELECT * FROM r WHERE position <= 7""",
        "inc11_policy_refs": f"""{ARRIVALS} SELECT target AS incident_id, policy_id, min(sequence) AS first_seen_sequence, max(sequence) AS last_seen_sequence,
            arg_max(policy_version, (sequence, policy_version)) AS policy_version FROM arrivals GROUP BY ALL""",
        "inc12_numbers": f"""{ORDERS} SELECT incident_id, 'INC-' || year(opened_at) || '-' || lpad(CAST(row_number() OVER (PARTITION BY tenant_id ORDER BY opened_at, incident_id) AS VARCHAR), 6, '0')
            AS incident_number FROM incidents""",
        "inc13_silent": f"""{ORDERS} SELECT incident_id FROM incidents WHERE state IN ('open', 'acknowledged', 'investigating', 'monitoring')
            AND last_detected_at <= {STAMP} - INTERVAL 300 SECONDS""",
        "inc14_recovered": f"{ORDERS} SELECT incident_id FROM incidents WHERE state = 'recovering' AND opened_at <= {STAMP} - INTERVAL 300 SECONDS",
        "inc15_closable": f"""{ORDERS} SELECT incident_id FROM incidents WHERE state = 'resolved' AND opened_at <= {STAMP} - INTERVAL 1800 SECONDS
            AND NOT ever_critical AND severity <> 'critical'""",
        "inc15_maintenance": f"""{ORDERS}, n AS (SELECT state, CASE WHEN state IN ('open', 'acknowledged', 'investigating', 'monitoring') AND opened_at <= {STAMP} - INTERVAL 300 SECONDS THEN 'recovering'
              WHEN state = 'recovering' AND opened_at <= {STAMP} - INTERVAL 300 SECONDS THEN 'resolved'
              WHEN state = 'resolved' AND opened_at <= {STAMP} - INTERVAL 1800 SECONDS AND NOT ever_critical AND severity <> 'critical' THEN 'closed' END AS next_state FROM incidents)
            SELECT state, next_state, CASE next_state WHEN 'recovering' THEN 'detector_silent' WHEN 'resolved' THEN 'recovery_confirmed' ELSE 'automatic_closure' END AS cause,
              count(*) AS n FROM n WHERE next_state IS NOT NULL GROUP BY ALL""",
        "inc16_lifecycle_guard": f"""WITH m AS ({moves_sql(vocab.INCIDENT_STATES)}) SELECT *, CASE actor_kind WHEN 'operator' THEN {edges_sql(vocab.OPERATOR_EDGES)}
            ELSE {edges_sql(vocab.AUTOMATIC_EDGES)} END AS legal FROM m""",
        "inc18_suppressed": f"{ORDERS} SELECT incident_id, {STAMP} < opened_at AS suppressed FROM incidents",
        "inc19_duplicate_active": f"""{ORDERS} SELECT tenant_id, target_type, target_id, direction, count(*) AS active FROM incidents
            WHERE state NOT IN ('resolved', 'closed') GROUP BY ALL HAVING count(*) > 1""",
        "inc20_known_tenants": f"{ARRIVALS} SELECT tenant, count(*) AS n FROM arrivals WHERE tenant <> 'initech' GROUP BY tenant",
        "inc20_refused_tenants": f"{ARRIVALS} SELECT tenant, count(*) AS refused FROM arrivals WHERE tenant = 'initech' GROUP BY tenant",
        "inc22_report": f"""{first_start}, c AS (SELECT CASE WHEN opener IS NULL OR seq_no < opener THEN 'quarantined' WHEN seq_no = opener THEN 'created' ELSE 'updated' END AS key FROM o)
            SELECT 'outcome' AS measure, key, count(*) AS n FROM c GROUP BY key
            UNION ALL SELECT 'gate', CASE WHEN schema_version > 1 OR executed THEN 'quarantined' ELSE 'observeOnly' END AS key, count(*) FROM arrivals
              WHERE schema_version > 1 OR executed OR observed GROUP BY 2
            UNION ALL SELECT 'transition', 'traffic_cleared', count(DISTINCT target) FROM o WHERE kind = 'ended' AND seq_no > opener""",
        "d18_timeline": f"""{first_start}, g AS (SELECT *, bit_or({bits}) OVER (PARTITION BY target ORDER BY seq_no) AS m FROM o WHERE seq_no >= opener),
            k AS (SELECT *, {category_sql(bit_test('m'))} AS category FROM g), l AS (SELECT *, lag(category) OVER (PARTITION BY target ORDER BY seq_no) AS was FROM k)
            SELECT 'opened' AS entry_type, count(DISTINCT target) AS n FROM l UNION ALL SELECT 'event_linked', count(*) FROM l
            UNION ALL SELECT 'category_changed', count(*) FROM l WHERE was <> category
            UNION ALL SELECT 'state_changed', count(DISTINCT target) FROM l WHERE kind = 'ended'""",
        "d19_outbox": f"""{first_start}, l AS (SELECT * FROM o WHERE seq_no >= opener)
            SELECT tenant, CASE WHEN seq_no = opener THEN 'incident.opened' ELSE 'incident.updated' END AS event_type, count(*) AS n FROM l GROUP BY ALL
            UNION ALL SELECT tenant, 'incident.recovering', count(DISTINCT target) FROM l WHERE kind = 'ended' GROUP BY tenant""",
        "iq1_list": f"""{ORDERS}, f AS (SELECT * FROM incidents WHERE tenant_id = 'acme' AND state IN ('open', 'acknowledged') AND severity IN ('critical', 'major'))
            SELECT incident_id, state, (SELECT count(*) FROM f) > 50 AS has_more FROM f ORDER BY opened_at DESC, incident_id DESC LIMIT 50""",
        "iq1_second_page": f"""{ORDERS}, f AS (SELECT * FROM incidents WHERE tenant_id = 'globex' AND direction = 'incoming'
              AND (epoch_us(last_detected_at), incident_id) > (700000000000000, 500))
            SELECT incident_id, (SELECT count(*) FROM f) > 200 AS has_more FROM f ORDER BY last_detected_at, incident_id LIMIT 200""",
        "iq2_count": f"""{ORDERS} SELECT count(*) AS incidents FROM incidents WHERE tenant_id = 'acme' AND target_type = 'host'
            AND epoch(opened_at) >= {NOW - 90 * DAY} AND epoch(opened_at) < {NOW}""",
        "iq3_timeline": f"""WITH {ctes('timeline')}, f AS (SELECT * FROM timeline WHERE incident_id = 7 AND timeline_id > 1000)
            SELECT timeline_id, entry_type, (SELECT count(*) FROM f) > 10 AS has_more FROM f ORDER BY timeline_id LIMIT 10""",
        "iq4_audit": f"""WITH {ctes('timeline')}, f AS (SELECT * FROM timeline WHERE incident_id = 9 AND timeline_id > 500)
            SELECT timeline_id AS audit_id, (SELECT count(*) FROM f) > 5 AS has_more FROM f ORDER BY timeline_id LIMIT 5""",
        "iq5_detections": f"""WITH {ctes('timeline')}, f AS (SELECT CAST(timeline_id AS VARCHAR) AS event_id, occurred_at FROM timeline WHERE incident_id = 11
              AND entry_type IN ('event_linked', 'late_event_linked') AND (epoch_us(occurred_at), CAST(timeline_id AS VARCHAR)) > ({(FROM + 5 * DAY) * 1_000_000}, ''))
            SELECT event_id, (SELECT count(*) FROM f) > 5 AS has_more FROM f ORDER BY occurred_at, event_id LIMIT 5""",
        "iq6_notes": f"""{NOTES} SELECT incident_id, note_index, CASE WHEN redacted THEN '' ELSE body END AS body FROM notes n
            WHERE NOT EXISTS (SELECT 1 FROM notes l WHERE l.incident_id = n.incident_id AND l.supersedes = n.note_index)""",
        "iq6_notes_with_history": f"""{NOTES} SELECT n.incident_id, n.note_index, l.note_index AS superseded_by FROM notes n
            LEFT JOIN notes l ON l.incident_id = n.incident_id AND l.supersedes = n.note_index""",
        "iq7_mitigation_status": f"""WITH {ctes('incidents', 'mitigations')}, b AS (SELECT tenant_id, mitigation_id // 4 * 3 AS incident_id,
              arg_max(struct_pack(s := state, d := dry_run), (state NOT IN ('withdrawn', 'rejected', 'expired', 'failed'), created_epoch_s, mitigation_id)) AS m FROM mitigations GROUP BY ALL)
            SELECT i.tenant_id, coalesce(CASE WHEN m.s IN ('proposed', 'requested') THEN 'pending_approval' WHEN m.s IN ('announcing', 'active') AND m.d THEN 'dry_run'
              WHEN m.s IN ('announcing', 'active') THEN 'active' ELSE m.s END, 'none') AS mitigation_status, count(*) AS n
            FROM incidents i LEFT JOIN b ON b.tenant_id = i.tenant_id AND b.incident_id = i.incident_id GROUP BY ALL""",
        "iq8_notification_status": f"""WITH {ctes('timeline')}, r AS (SELECT incident_id, payload->>'$.result.channel' AS c, arg_max(payload->>'$.result.outcome', timeline_id) AS o
              FROM timeline WHERE entry_type = 'notification_result' GROUP BY ALL), c AS (SELECT incident_id, count(*) AS n, count(*) FILTER (o = 'delivered') AS ok FROM r GROUP BY 1)
            SELECT DISTINCT t.incident_id, CASE WHEN n IS NULL THEN 'none' WHEN ok = 0 THEN 'failed' WHEN ok = n THEN 'delivered' ELSE 'partial' END AS notification_status
            FROM timeline t LEFT JOIN c USING (incident_id)""",
        "iq9_timeline_pressure": f"""WITH {ctes('incidents', 'timeline')} SELECT coalesce(max((SELECT count(*) FROM timeline t WHERE t.incident_id = i.incident_id)), 0) AS pressure
            FROM incidents i WHERE state NOT IN ('resolved', 'closed')""",
        "iq10_queue_stats": f"""WITH q AS (SELECT o_orderkey, {statuses}[o_orderkey % 4 + 1] AS a, {statuses}[(o_orderkey + 1) % 4 + 1] AS b FROM orders)
            SELECT 'outbox' AS queue, count(*) FILTER (a = 'pending') AS pending, count(*) FILTER (a = 'retrying') AS retrying, count(*) FILTER (a = 'dead_letter') AS dead_letter FROM q
            UNION ALL SELECT 'inbox', count(*) FILTER (b = 'pending'), count(*) FILTER (b = 'retrying'), count(*) FILTER (b = 'dead_letter') FROM q
            UNION ALL SELECT 'unreviewed', 0, 0, count(*) FILTER (o_orderkey % 3 <> 0) FROM q""",
        "iq11_purge_closed": f"""WITH {ctes('incidents', 'timeline')} SELECT timeline_id FROM timeline t WHERE NOT EXISTS (SELECT 1 FROM incidents i WHERE i.incident_id = t.incident_id
            AND state = 'closed' AND opened_at <= {STAMP} - INTERVAL 24 MONTHS)""",
        "iq11_purge_outbox": f"SELECT o_orderkey AS id FROM orders WHERE NOT (o_orderkey % 4 = 2 AND o_orderdate <= {STAMP} - INTERVAL 7 DAYS)",
        "iq11_purge_dead_letters": f"SELECT o_orderkey AS id FROM orders WHERE NOT (o_orderkey % 3 = 0 AND o_orderdate <= {STAMP} - INTERVAL 90 DAYS)",
        "snk4_export": f"""WITH {ctes('incidents', 'timeline')} SELECT i.incident_id, CASE WHEN count(t.timeline_id) > 10 THEN 'true' ELSE 'false' END AS cut,
            CAST(min(t.timeline_id) AS VARCHAR) AS first_entry, i.state FROM incidents i LEFT JOIN timeline t USING (incident_id)
            WHERE tenant_id = 'acme' GROUP BY i.incident_id, i.state""",
        "mit1_guard": f"""{MIT}, c AS (SELECT m.*, {covering} AS e FROM mitigations m) SELECT mitigation_id, CASE
            WHEN e IS NULL OR split_part(e, ';', 1) <> tenant_id THEN 'mitigation.not_allowlisted'
            WHEN NOT list_contains(string_split(split_part(e, ';', 2), ','), action) THEN 'mitigation.action_not_allowed'
            WHEN prefix_len <> 32 AND prefix_len < 24 THEN 'mitigation.too_wide' WHEN duration_seconds > 3600 THEN 'mitigation.too_long' END AS refusal FROM c""",
        "mit2_allowlist": f"""{ENTRIES} SELECT position, CASE WHEN n < 16 THEN 'entry_too_wide' ELSE 'entry_empty' END AS error_code FROM e WHERE n < 16 OR tenant = ' ' OR bare
            UNION ALL SELECT DISTINCT position, 'overlap' FROM (SELECT greatest(a.position, b.position) AS position FROM e a JOIN e b ON a.n < b.n
              AND b.lo - b.lo % CAST(pow(2, 32 - a.n) AS BIGINT) = a.lo AND a.tenant <> b.tenant
              UNION SELECT max(position) FROM e GROUP BY n, lo HAVING count(DISTINCT tenant) > 1)""",
        "mit2_config": """SELECT c_custkey, CASE WHEN c_custkey % 40 NOT BETWEEN 16 AND 32 OR c_custkey % 131 NOT BETWEEN 32 AND 128 THEN 'min_length'
            WHEN c_custkey * 700 NOT BETWEEN 60 AND 604800 THEN 'max_duration' WHEN c_custkey * 90 NOT BETWEEN 60 AND 86400 THEN 'approval_window' END AS error_code FROM customer""",
        "mit3_action": f"""{req} SELECT n AS mitigation_id, CASE
            WHEN action NOT LIKE 'flowspec%' AND (proto IS NOT NULL OR sport OR dport OR sf IS NOT NULL OR rate IS NOT NULL) THEN 'not_flowspec'
            WHEN action = 'rtbh' AND prefix_len <> 32 THEN 'rtbh_not_host' WHEN action = 'parent_prefix' AND prefix_len = 32 THEN 'parent_is_host'
            WHEN action = 'flowspec_discard' AND rate IS NOT NULL THEN 'rate' WHEN action = 'flowspec_rate_limit' AND (rate IS NULL OR rate < 1 OR rate > 12500000000) THEN 'rate'
            WHEN (sport OR dport) AND coalesce(proto NOT IN (6, 17), true) THEN 'ports_without_transport' WHEN sf <> 4 THEN 'source_family' END AS error_code FROM r""",
        "mit4_canonical": f"""{MIT}, r AS (SELECT mitigation_id, prefix_lo AS lo, CASE WHEN mitigation_id % 5 = 0 THEN 24 ELSE prefix_len END AS n FROM mitigations),
            k AS (SELECT *, lo - lo % CAST(pow(2, 32 - n) AS BIGINT) AS kept FROM r)
            SELECT mitigation_id, CASE WHEN kept <> lo THEN 'host_bits' END AS error_code, CASE WHEN kept <> lo THEN {v4_text('kept')} || '/' || n END AS intended FROM k""",
        "mit5_duplicates": f"""{MIT} SELECT {DUPLICATE_SQL} AS duplicate_key, count(*) AS live FROM mitigations WHERE state IN {LIVE} GROUP BY 1 HAVING count(*) > 1""",
        "mit6_candidates": f"{CANDIDATES} SELECT incident_id, tenant, severity, family, prefix_len FROM allowed",
        "mit6_first_candidates": f"{CANDIDATES} SELECT incident_id, family FROM allowed ORDER BY opened_at, incident_id LIMIT 20",
        "mit7_due_work": f"""{MIT}, w AS (SELECT *, state IN ('proposed', 'requested') AND created_epoch_s + 900 <= {MIT_NOW} AS approval_expired,
              state = 'active' AND created_epoch_s + duration_seconds <= {MIT_NOW} AS duration_reached FROM mitigations WHERE state IN {LIVE})
            SELECT mitigation_id, approval_expired, duration_reached, CASE WHEN approval_expired THEN 'expire' WHEN state = 'approved' THEN 'announce' WHEN duration_reached THEN 'take_down'
              WHEN state = 'announcing' THEN 'finish_announcing' WHEN state = 'withdrawing' THEN 'take_down' ELSE 'none' END AS next_action FROM w""",
        "mit7_due_work_killed": f"""{MIT} SELECT state, CASE WHEN state IN ('proposed', 'requested') AND created_epoch_s + 900 <= {MIT_NOW} THEN 'expire' WHEN state = 'approved' THEN 'withdraw'
            WHEN state IN ('announcing', 'active', 'withdrawing') THEN 'take_down' ELSE 'none' END AS next_action, count(*) AS n FROM mitigations WHERE state IN {LIVE} GROUP BY ALL""",
        "mit8_reconcile": f"""{MIT}, k AS (SELECT *, {DUPLICATE_SQL} AS duplicate_key FROM mitigations), owned AS (SELECT DISTINCT duplicate_key FROM k WHERE mitigation_id % 3 <> 0),
            sent AS (SELECT * FROM k WHERE state IN ('announcing', 'active') AND NOT dry_run)
            SELECT duplicate_key, 'withdraw' AS step FROM owned WHERE duplicate_key NOT IN (SELECT duplicate_key FROM sent)
            UNION ALL SELECT duplicate_key, 'restore' FROM sent WHERE state = 'active' AND duplicate_key NOT IN (SELECT duplicate_key FROM owned)""",
        "mit9_peer_events": f"""WITH b AS ({before_peers}), n AS ({later_peers}), j AS (SELECT b.neighbor_address, coalesce(n.peer_asn, b.peer_asn) AS peer_asn, b.session_state AS previous_state,
              coalesce(n.session_state, 'gone') AS session_state FROM b LEFT JOIN n ON n.neighbor_address = b.neighbor_address)
            SELECT neighbor_address, peer_asn, CASE WHEN previous_state = 'established' THEN 'bgp.peer_down' ELSE 'bgp.peer_up' END AS event_type, session_state, previous_state
            FROM j WHERE (previous_state = 'established') <> (session_state = 'established')""",
        "mit10_list": f"""{MIT}, k AS (SELECT * FROM mitigations WHERE tenant_id = 'acme' AND state IN {LIVE})
            SELECT mitigation_id, state, (SELECT count(*) FROM k) > 100 AS has_more FROM k ORDER BY created_epoch_s DESC, mitigation_id DESC LIMIT 100""",
        "mit10_next_page": f"""{MIT}, k AS (SELECT * FROM mitigations WHERE tenant_id = 'acme' AND mitigation_id < 600)
            SELECT mitigation_id, (SELECT count(*) FROM k) > 20 AS has_more FROM k ORDER BY mitigation_id DESC LIMIT 20""",
        "mit10_routed": f"""{MIT} SELECT mitigation_id, state FROM mitigations WHERE tenant_id = 'globex' AND state IN ('announcing', 'active', 'withdrawing') AND NOT dry_run
            AND mitigation_id % 4 <> 1 ORDER BY created_epoch_s DESC, mitigation_id DESC LIMIT 500""",
        "mit11_history": """SELECT event_id % 100 AS mitigation_id, 'acme' AS tenant_id, event_id // 100 AS version, event_type FROM events WHERE event_id % 100 = 42""",
        "mit12_lifecycle_guard": f"WITH m AS ({moves_sql(MIT_STATES)}) SELECT *, {edges_sql(vocab.MITIGATION_EDGES)} AS legal FROM m",
        "mit13_peers": before_peers,
        "fn10_duplicate_key": f"""{req} SELECT n AS mitigation_id, action || '|' || {v4_text('prefix_lo')} || '/' || prefix_len || '|' || coalesce('proto=' || proto || ';', '') ||
            CASE WHEN sport THEN 'sport=53;' ELSE '' END || CASE WHEN dport THEN 'dport=443;' ELSE '' END AS duplicate_key FROM r""",
        "ntf1_route": f"{routed_sql} SELECT outbox_id, channel FROM told",
        "ntf2_dedup": f"""WITH RECURSIVE {MESSAGES}, r AS MATERIALIZED (SELECT *, row_number() OVER (PARTITION BY channel, incident_id, event_type ORDER BY t, message_id) AS rn FROM msg),
            w AS (SELECT message_id, channel, incident_id, event_type, rn, t AS sent, true AS kept FROM r WHERE rn = 1
              UNION ALL SELECT r.message_id, r.channel, r.incident_id, r.event_type, r.rn, CASE WHEN r.t - w.sent >= 300000000 THEN r.t ELSE w.sent END, r.t - w.sent >= 300000000
              FROM w JOIN r ON r.channel = w.channel AND r.incident_id = w.incident_id AND r.event_type = w.event_type AND r.rn = w.rn + 1)
            SELECT message_id, kept FROM w""",
        "ntf1_route_changes": CHANGES_SQL,
        "ntf2_ntf3_deliverable": f"""WITH RECURSIVE {MESSAGES}, r AS MATERIALIZED (SELECT *, incident_id || '|' || event_type AS k, row_number() OVER (PARTITION BY channel ORDER BY t, message_id) AS rn FROM msg),
            w AS (SELECT message_id, channel, rn, t, 'sent' AS outcome, CAST(60000000 AS BIGINT) AS tokens, MAP {{k: t}} AS told FROM r WHERE rn = 1
              UNION ALL SELECT message_id, channel, rn, t, outcome, tokens - CASE outcome WHEN 'sent' THEN 60000000 ELSE 0 END,
                CASE outcome WHEN 'sent' THEN map_concat(told, MAP {{k: t}}) ELSE told END
              FROM (SELECT *, CASE WHEN t - told[k] < 300000000 THEN 'duplicate' WHEN tokens >= 60000000 THEN 'sent' ELSE 'rate_limited' END AS outcome
                FROM (SELECT r.message_id, r.channel, r.rn, r.t, r.k, w.told, least(120000000, w.tokens + (r.t - w.t) * 2) AS tokens FROM w JOIN r ON r.channel = w.channel AND r.rn = w.rn + 1)))
            SELECT message_id, outcome FROM w""",
        "ntf3_rate_limit": f"""WITH RECURSIVE {MESSAGES}, r AS MATERIALIZED (SELECT *, row_number() OVER (PARTITION BY channel ORDER BY t, message_id) AS rn FROM msg),
            w AS (SELECT message_id, channel, rn, t, CAST(60000000 AS BIGINT) AS tokens, true AS sent FROM r WHERE rn = 1
              UNION ALL SELECT r.message_id, r.channel, r.rn, r.t, least(120000000, w.tokens + (r.t - w.t) * 2) - CASE WHEN least(120000000, w.tokens + (r.t - w.t) * 2) >= 60000000 THEN 60000000 ELSE 0 END,
                least(120000000, w.tokens + (r.t - w.t) * 2) >= 60000000 FROM w JOIN r ON r.channel = w.channel AND r.rn = w.rn + 1)
            SELECT message_id, sent FROM w""",
        "ntf4_notice": f"""{routed_sql} SELECT t.outbox_id, t.channel, 'https://ui.example/incidents/' || t.outbox_id AS link,
            '{{"event_type":"' || t.event_type || '","tenant":"' || t.tenant || '","incident_id":' || t.outbox_id || ',"incident_number":"INC-' || t.outbox_id || '","title":"t","severity":"' || i.severity ||
            '","state":"' || i.state || '","priority":"' || CASE i.severity WHEN 'critical' THEN 'P1' WHEN 'major' THEN 'P2' WHEN 'minor' THEN 'P3' ELSE 'P4' END || '","target":"' || i.target_id ||
            '","direction":"' || i.direction || '","mitigation_status":"none","link":"https://ui.example/incidents/' || t.outbox_id || '"}}' AS body
            FROM told t JOIN incidents i ON i.incident_id = t.outbox_id""",
        "ntf5_results": """SELECT user_id % 10 AS incident_id, 'notification_result' AS entry_type, '{"result":{"channel":"c' || user_id % 3 || '","event_type":"' || event_type ||
            '","outcome":"delivered"}}' AS payload FROM events WHERE event_id % 10 <> 0""",
    }
