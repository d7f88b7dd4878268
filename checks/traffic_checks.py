"""Queries and SQL for normalisation, classification, rollups and traffic reads."""

from __future__ import annotations

from pyspark.sql import functions as F

from floodplain.functions import net
from floodplain.operators import classify as cls
from floodplain.operators import normalize as nrm
from floodplain.operators import rollup as agg
from floodplain.plans import traffic

from .views import ctes, view

HOUR = 3600
DAY = 86_400
FROM, TO = 1704067200, 1704067200 + 30 * DAY  # the whole range of the given events
ASOF = 1704067200 + 20 * DAY

# --- shared SQL -------------------------------------------------------------

NORMAL = """
tiers AS (
  SELECT f.*, x.rate AS exporter_rate FROM flows f LEFT JOIN exporter_rates x ON x.exporter = f.exporter
), corrected AS (
  SELECT *, CASE WHEN sampling_record > 0 THEN sampling_record WHEN sampling_options > 0 THEN sampling_options
      WHEN exporter_rate > 0 THEN exporter_rate ELSE 1 END::BIGINT AS sampling_rate,
    CASE WHEN sampling_record > 0 THEN 'record' WHEN sampling_options > 0 THEN 'options'
      WHEN exporter_rate > 0 THEN 'exporter' ELSE 'unsampled' END AS sampling_source,
    CASE WHEN sampling_record > 0 THEN false WHEN sampling_record = 0 THEN true
      WHEN sampling_options > 0 THEN false WHEN sampling_options = 0 THEN true
      WHEN exporter_rate > 0 THEN false WHEN exporter_rate = 0 THEN true ELSE false END AS zero_rate_skipped
  FROM tiers
), normal_all AS (
  SELECT *, raw_bytes * sampling_rate AS bytes, raw_packets * sampling_rate AS packets,
    CASE WHEN raw_bytes = 0 AND raw_packets = 0 THEN 'empty' END AS reject_reason
  FROM corrected
), normal AS (SELECT * FROM normal_all WHERE reject_reason IS NULL)"""

CLASSIFIED = """
src_lpm AS (
  SELECT flow_id, max_by(struct_pack(t := p.tenant, h := p.hostgroup, n := p.prefix_len), p.prefix_len) AS m
  FROM normal f JOIN prefixes p ON p.family = f.family AND (f.src_hi & p.mask_hi) = p.net_hi AND (f.src_lo & p.mask_lo) = p.net_lo
  GROUP BY flow_id
), dst_lpm AS (
  SELECT flow_id, max_by(struct_pack(t := p.tenant, h := p.hostgroup, n := p.prefix_len), p.prefix_len) AS m
  FROM normal f JOIN prefixes p ON p.family = f.family AND (f.dst_hi & p.mask_hi) = p.net_hi AND (f.dst_lo & p.mask_lo) = p.net_lo
  GROUP BY flow_id
), classified AS (
  SELECT f.*, CASE WHEN s.m IS NULL AND d.m IS NOT NULL THEN 'incoming' WHEN s.m IS NOT NULL AND d.m IS NULL THEN 'outgoing'
      WHEN s.m IS NOT NULL AND d.m IS NOT NULL THEN 'internal' ELSE 'other' END AS direction,
    s.m.t AS src_tenant, s.m.h AS src_hostgroup, s.m.n AS src_prefix_len,
    d.m.t AS dst_tenant, d.m.h AS dst_hostgroup, d.m.n AS dst_prefix_len
  FROM normal f LEFT JOIN src_lpm s USING (flow_id) LEFT JOIN dst_lpm d USING (flow_id)
)"""

CONTRIB = """
  bytes, packets, 1 AS flows,
  CASE WHEN protocol = 6 THEN bytes ELSE 0 END AS tcp_bytes, CASE WHEN protocol = 6 THEN packets ELSE 0 END AS tcp_packets,
  CASE WHEN protocol = 17 THEN bytes ELSE 0 END AS udp_bytes, CASE WHEN protocol = 17 THEN packets ELSE 0 END AS udp_packets,
  CASE WHEN protocol IN (1, 58) THEN bytes ELSE 0 END AS icmp_bytes,
  CASE WHEN protocol IN (1, 58) THEN packets ELSE 0 END AS icmp_packets,
  CASE WHEN protocol = 6 AND (coalesce(tcp_flags, 0) & 2) <> 0 THEN packets ELSE 0 END AS tcp_syn_packets,
  CASE WHEN fragmented THEN packets ELSE 0 END AS fragmented_packets,
  CASE WHEN forwarding_status_known AND dropped THEN packets ELSE 0 END AS dropped_packets"""

SUMS = ", ".join(f"CAST(sum({c}) AS BIGINT) AS {c}" for c in agg.COUNTERS)

BASE_CTES = "WITH " + ctes("flows", "prefixes", "exporter_rates") + "," + NORMAL
CLASSIFIED_CTES = BASE_CTES + "," + CLASSIFIED


def bucket_sql(seconds: int, column: str = "ts") -> str:
    return f"CAST(floor(epoch({column}) / {seconds}) AS BIGINT) * {seconds}"


def one_sided(seconds: int, keys: list[str], where: str = "true", source: str = "normal") -> str:
    names = "".join(f"{k}, " for k in keys)
    return (f"SELECT {bucket_sql(seconds)} AS window_start, {names}{CONTRIB} FROM {source} WHERE {where}")


def grouped(inner: str, keys: list[str]) -> str:
    names = "".join(f"{k}, " for k in keys)
    return f"SELECT window_start, {names}{SUMS} FROM ({inner}) GROUP BY ALL"


def sided(seconds: int, source: str, *sides: tuple[str, str]) -> str:
    """UNION ALL of the given (key list, where) sides."""
    return " UNION ALL ".join(
        f"SELECT {bucket_sql(seconds)} AS window_start, {keys}, {CONTRIB} FROM {source} WHERE {where}" for keys, where in sides
    )


# Stored-table shapes the traffic queries read, one hour per row.
V4_TEXT = ("CAST((x >> 24) & 255 AS VARCHAR) || '.' || CAST((x >> 16) & 255 AS VARCHAR) || '.' || "
           "CAST((x >> 8) & 255 AS VARCHAR) || '.' || CAST(x & 255 AS VARCHAR)")


def v4_text(expression: str) -> str:
    return V4_TEXT.replace("x", f"({expression})")


ROLLUP_SQL = {
    "total": grouped(one_sided(HOUR, []), []),
    "family": grouped(one_sided(HOUR, ["family"]), ["family"]),
    "exporter": grouped(one_sided(HOUR, ["exporter"]), ["exporter"]),
    "protocol": grouped(one_sided(HOUR, ["protocol"], "protocol IS NOT NULL"), ["protocol"]),
    "host": grouped(sided(HOUR, "normal", ("family, src_addr AS address", "true"), ("family, dst_addr AS address", "true")),
                    ["family", "address"]),
    "slash24": grouped(sided(
        HOUR, "normal", *[(f"{v4_text(f'{s}_lo & 4294967040')} AS address", "family = 4") for s in ("src", "dst")]), ["address"]),
    "network": grouped(sided(HOUR, "normal", *[
        (f"4 AS family, {n} AS prefix_len, {v4_text(f'{s}_lo & {net.mask_halves(4, n)[1]}')} AS address", "family = 4")
        for n in (8, 16) for s in ("src", "dst")], *[
        (f"6 AS family, 32 AS prefix_len, CASE WHEN ({s}_hi & -4294967296) = 2306139568115548160 THEN '2001:db8::' ELSE '?' END AS address",
         "family = 6") for s in ("src", "dst")]), ["family", "prefix_len", "address"]),
    "hostgroup": grouped(sided(HOUR, "classified", ("src_hostgroup AS hostgroup", "src_hostgroup IS NOT NULL"),
                               ("dst_hostgroup AS hostgroup", "dst_hostgroup IS NOT NULL")), ["hostgroup"]),
    "asn": grouped(sided(HOUR, "normal", ("src_asn AS asn", "src_asn IS NOT NULL"), ("dst_asn AS asn", "dst_asn IS NOT NULL")), ["asn"]),
    "interface": grouped(sided(
        HOUR, "normal",
        ("exporter, CAST(input_interface AS BIGINT) AS interface_index, 'input' AS direction", "input_interface IS NOT NULL"),
        ("exporter, CAST(output_interface AS BIGINT) AS interface_index, 'output' AS direction", "output_interface IS NOT NULL")),
        ["exporter", "interface_index", "direction"]),
}

LENGTHS = {"lengths4": [8, 16], "lengths6": [32]}

# --- Spark side -------------------------------------------------------------


def flows(spark, sf):
    return view(spark, sf, "flows")


def normal(spark, sf):
    return nrm.normalize(flows(spark, sf), view(spark, sf, "exporter_rates"))


def classified(spark, sf, **options):
    return cls.classify(normal(spark, sf), view(spark, sf, "prefixes"), **options)


def rollup(spark, sf, dimension):
    if dimension == "hostgroup":
        return agg.rollup_hostgroup(classified(spark, sf), HOUR)
    if dimension == "network":
        return agg.rollup_network(normal(spark, sf), HOUR, **LENGTHS)
    return getattr(agg, f"rollup_{dimension}")(normal(spark, sf), HOUR)


def epoch_window(df):
    """Window starts as epoch seconds; address halves dropped, the text stays."""
    return df.withColumn("window_start", F.unix_timestamp("window_start")).drop("hi", "lo")


def _rollup_query(dimension):
    return lambda spark, sf: epoch_window(rollup(spark, sf, dimension))


def _from_all(dimension):
    def run(spark, sf):
        wide = agg.rollup_all(classified(spark, sf), HOUR, **LENGTHS)
        return epoch_window(agg.dimension_of(wide, dimension))

    return run


TOP_SQL_KEY = {
    "host": "address", "network": "address || '/' || CAST(prefix_len AS VARCHAR)", "slash24": "address",
    "hostgroup": "hostgroup", "asn": "CAST(asn AS VARCHAR)",
    "interface": "exporter || '/' || CAST(interface_index AS VARCHAR) || '/' || direction", "exporter": "exporter",
}
RANGE_SQL = f"window_start >= {FROM} AND window_start < {TO}"


def _top_sql(dimension, limit):
    return (f"{CLASSIFIED_CTES}, r AS ({ROLLUP_SQL[dimension]}) SELECT {TOP_SQL_KEY[dimension]} AS key, "
            f"CAST(sum(bytes) AS BIGINT) AS bytes, CAST(sum(packets) AS BIGINT) AS packets, CAST(sum(flows) AS BIGINT) AS flows "
            f"FROM r WHERE {RANGE_SQL} GROUP BY 1 ORDER BY bytes DESC, key LIMIT {limit}")


def six(df, *columns):
    for c in columns:
        df = df.withColumn(c, F.round(c, 6))
    return df


def exporter_networks(spark):
    text = F.explode(F.array(F.lit("172.30.0.0/30"), F.lit("::ffff:172.30.0.6/128"), F.lit("172.30.0.8/32"))).alias("t")
    return spark.range(1).select(text).select(
        F.inline(F.array(net.parse_cidr(F.col("t")))).alias("family", "net_hi", "net_lo", "prefix_len"))


def sequenced(spark, sf):
    return flows(spark, sf).withColumn(
        "sequence_number", F.when(F.col("flow_id") % 11 != 0, (F.col("flow_id") * 7919) % 5000))


def listed_prefixes(spark, sf):
    """A prefix list with errors and nested entries, one entry per customer."""
    from .views import table

    number = F.col("c_custkey")
    length = F.when(number % 50 == 0, F.lit(33)).otherwise((F.lit(16) + number % 17).cast("int"))
    return table(spark, sf, "customer").select(
        F.lit(4).alias("family"), length.alias("prefix_len"), F.lit(0).cast("bigint").alias("net_hi"),
        (F.lit(167772160).cast("bigint") + (number % 700) * 97).alias("net_lo"), number.alias("position"))


LISTED_SQL = """listed AS (
  SELECT 4 AS family, CASE WHEN c_custkey % 50 = 0 THEN 33 ELSE 16 + c_custkey % 17 END AS n,
    167772160 + (c_custkey % 700) * 97 AS raw, c_custkey AS position FROM customer
), masked AS (
  SELECT *, CASE WHEN n > 32 THEN raw ELSE (raw // CAST(pow(2, 32 - n) AS BIGINT)) * CAST(pow(2, 32 - n) AS BIGINT) END AS lo FROM listed
), firsts AS (SELECT n, lo, min(position) AS position FROM masked WHERE n <= 32 GROUP BY n, lo)"""

HOST_CONTAINS = "(b.lo // CAST(pow(2, 32 - a.n) AS BIGINT)) * CAST(pow(2, 32 - a.n) AS BIGINT) = a.lo AND a.n < b.n"

def queries():
    q = {
        "nrm1_resolve_sampling": lambda s, d: nrm.resolve_sampling(flows(s, d), view(s, d, "exporter_rates")).select(
            "flow_id", "sampling_rate", "sampling_source", "zero_rate_skipped"),
        "nrm1_global_default": lambda s, d: nrm.resolve_sampling(flows(s, d), None, 20).groupBy(
            "sampling_source", "sampling_rate").agg(F.count(F.lit(1)).alias("n")),
        "nrm2_apply_sampling": lambda s, d: normal(s, d).select("flow_id", "bytes", "packets"),
        "nrm3_rejects": lambda s, d: nrm.rejects(flows(s, d), view(s, d, "exporter_rates")).select("flow_id", "reject_reason"),
        "nrm4_forwarding_status": lambda s, d: nrm.decode_forwarding_status(
            flows(s, d).drop("dropped", "forwarding_status_known").withColumn(
                "forwarding_status", F.when(F.col("flow_id") % 5 != 0, (F.col("flow_id") % 256).cast("int")))
        ).groupBy("forwarding_status_known", "dropped").agg(F.count(F.lit(1)).alias("n")),
        "nrm5_tcp_syn": lambda s, d: normal(s, d).where(nrm.is_tcp_syn()).select("flow_id", "packets"),
        "nrm6_report": lambda s, d: nrm.normalization_report(nrm.normalize_all(flows(s, d), view(s, d, "exporter_rates"))),
        "nrm7_exporter_restarts": lambda s, d: nrm.exporter_restarts(sequenced(s, d)).select(
            "exporter", "observation_domain_id", "flow_id", "sequence_number", "previous_sequence"),
        "src2_exporter_allowlist": lambda s, d: nrm.admit_exporters(flows(s, d), exporter_networks(s)).groupBy(
            "exporter").agg(F.count(F.lit(1)).alias("n")),
        "cls1_lpm_join": lambda s, d: classified(s, d).select(
            "flow_id", "src_tenant", "src_hostgroup", "src_prefix_len", "dst_tenant", "dst_hostgroup", "dst_prefix_len"),
        "cls1_lpm_large_registry": lambda s, d: classified(s, d, broadcast_rows=0).select(
            "flow_id", "src_tenant", "src_hostgroup", "src_prefix_len", "dst_tenant", "dst_hostgroup", "dst_prefix_len"),
        "cls1_lpm_blocks": lambda s, d: classified(s, d, max_lengths=0).select(
            "flow_id", "src_tenant", "src_hostgroup", "src_prefix_len", "dst_tenant", "dst_hostgroup", "dst_prefix_len"),
        "cls2_direction": lambda s, d: classified(s, d).select("flow_id", "direction"),
        "cls3_reason": lambda s, d: classified(s, d, with_reason=True).select("flow_id", "reason"),
        "cls4_validate_prefixes": lambda s, d: cls.validate_prefixes(listed_prefixes(s, d)),
        "cls5_flows_by_direction": lambda s, d: cls.flows_by_direction(classified(s, d)),
        "agg12_cap_hosts": lambda s, d: agg.cap_dimension(normal(s, d), ["src_addr"], 5, DAY).select(
            F.unix_timestamp("window_start").alias("window_start"), "src_addr", "recency"),
        "agg13_active_entities": lambda s, d: agg.active_entities(
            classified(s, d), F.timestamp_seconds(F.lit(ASOF)), 6 * HOUR),
        "rat1_rate_windows": lambda s, d: six(agg.rate_windows(normal(s, d), [3600, 7200, 86400]), "bps", "pps", "fps"),
        "qry1_traffic_summary": lambda s, d: six(
            traffic.traffic_summary(rollup(s, d, "family"), FROM, TO), "ipv4_bps", "ipv6_bps", "ipv4_pps", "ipv6_pps"),
        "qry3_exporters": lambda s, d: six(traffic.exporters(rollup(s, d, "exporter"), ASOF), "bps", "pps"),
        "qry4_family_bps": lambda s, d: six(traffic.traffic_by_family(rollup(s, d, "family"), FROM, TO, 4 * HOUR), "bps"),
        "qry4_family_pps": lambda s, d: six(traffic.traffic_by_family(rollup(s, d, "family"), FROM, TO, 4 * HOUR, "pps"), "pps"),
        "qry5_protocol_mix": lambda s, d: six(
            traffic.protocol_mix(rollup(s, d, "family"), FROM, TO, 4 * HOUR), "tcp", "udp", "icmp", "other"),
        "qry6_attack_indicators": lambda s, d: six(
            traffic.attack_indicators(rollup(s, d, "family"), FROM, TO, 4 * HOUR), "tcp_syn", "fragmented", "dropped"),
        "qry8_by_exporter": lambda s, d: six(traffic.traffic_by_exporter(rollup(s, d, "exporter"), FROM, TO, 4 * HOUR), "bps"),
        "qry11_retention": lambda s, d: epoch_window(traffic.retention_filter(rollup(s, d, "total"), ASOF, 10)),
    }
    for i, dimension in enumerate(["total", "family", "host", "slash24", "network", "hostgroup", "asn", "exporter",
                                   "interface", "protocol"], 1):
        q[f"agg{i}_{dimension}"] = _rollup_query(dimension)
        q[f"agg11_all_{dimension}"] = _from_all(dimension)
    for dimension in traffic.TOP_KEYS:
        q[f"qry2_top_{dimension}"] = lambda s, d, k=dimension: traffic.top_talkers(rollup(s, d, k), k, FROM, TO, 10)
        if dimension != "exporter":
            q[f"qry7_top20_{dimension}"] = lambda s, d, k=dimension: traffic.top_20(rollup(s, d, k), k, FROM, TO)
    return q


def _rated(column, seconds, scale=1):
    return f"round(CAST(sum({column}) AS DOUBLE) * {scale} / {seconds}, 6)"


def oracle_sql():
    step = 5190  # 30 days over 500 points, rounded up to tens
    side_columns = "flow_id, src_tenant, src_hostgroup, src_prefix_len, dst_tenant, dst_hostgroup, dst_prefix_len"
    sql = {
        "nrm1_resolve_sampling": f"{BASE_CTES} SELECT flow_id, sampling_rate, sampling_source, zero_rate_skipped FROM corrected",
        "nrm1_global_default": f"""WITH {ctes('flows')} SELECT
            CASE WHEN sampling_record > 0 THEN 'record' WHEN sampling_options > 0 THEN 'options' ELSE 'global' END AS sampling_source,
            CAST(CASE WHEN sampling_record > 0 THEN sampling_record WHEN sampling_options > 0 THEN sampling_options ELSE 20 END AS BIGINT) AS sampling_rate,
            count(*) AS n FROM flows GROUP BY ALL""",
        "nrm2_apply_sampling": f"{BASE_CTES} SELECT flow_id, bytes, packets FROM normal",
        "nrm3_rejects": f"{BASE_CTES} SELECT flow_id, reject_reason FROM normal_all WHERE reject_reason IS NOT NULL",
        "nrm4_forwarding_status": f"""WITH {ctes('flows')} SELECT flow_id % 5 <> 0 AS forwarding_status_known,
            flow_id % 5 <> 0 AND (flow_id % 256) // 64 = 2 AS dropped, count(*) AS n FROM flows GROUP BY ALL""",
        "nrm5_tcp_syn": f"{BASE_CTES} SELECT flow_id, packets FROM normal WHERE protocol = 6 AND (tcp_flags & 2) <> 0",
        "nrm6_report": f"""{BASE_CTES} SELECT count(*) FILTER (reject_reason IS NULL) AS normalized,
            count(*) FILTER (reject_reason IS NULL AND sampling_rate > 1) AS corrected,
            count(*) FILTER (reject_reason IS NULL AND zero_rate_skipped) AS zero_rate_skipped,
            count(*) FILTER (reject_reason IS NULL AND protocol NOT IN (1, 6, 17, 58)) AS unnamed_protocol,
            count(*) FILTER (reject_reason = 'missing_addresses') AS rejected_missing_addresses,
            count(*) FILTER (reject_reason = 'empty') AS rejected_empty,
            count(*) FILTER (reject_reason = 'sampling_overflow') AS rejected_sampling_overflow FROM normal_all""",
        "nrm7_exporter_restarts": f"""WITH {ctes('flows')}, s AS (SELECT exporter, observation_domain_id, flow_id, ts,
            (flow_id * 7919) % 5000 AS sequence_number FROM flows WHERE flow_id % 11 <> 0),
            l AS (SELECT *, lag(sequence_number) OVER (PARTITION BY exporter, observation_domain_id ORDER BY ts, flow_id) AS previous_sequence FROM s)
            SELECT exporter, observation_domain_id, flow_id, sequence_number, previous_sequence FROM l WHERE sequence_number < previous_sequence""",
        "src2_exporter_allowlist": f"""WITH {ctes('flows')} SELECT exporter, count(*) AS n FROM flows
            WHERE exporter IN ('172.30.0.1', '172.30.0.2', '172.30.0.3', '172.30.0.8') GROUP BY exporter""",
        "cls1_lpm_join": f"{CLASSIFIED_CTES} SELECT {side_columns} FROM classified",
        "cls1_lpm_large_registry": f"{CLASSIFIED_CTES} SELECT {side_columns} FROM classified",
        "cls1_lpm_blocks": f"{CLASSIFIED_CTES} SELECT {side_columns} FROM classified",
        "cls2_direction": f"{CLASSIFIED_CTES} SELECT flow_id, direction FROM classified",
        "cls3_reason": f"""{CLASSIFIED_CTES} SELECT flow_id, CASE direction
            WHEN 'incoming' THEN 'source ' || src_addr || ' matched no local prefix; destination ' || dst_addr ||
              ' matched a local prefix (/' || dst_prefix_len || ') — classified Incoming'
            WHEN 'outgoing' THEN 'source ' || src_addr || ' matched a local prefix (/' || src_prefix_len || '); destination ' ||
              dst_addr || ' matched no local prefix — classified Outgoing'
            WHEN 'internal' THEN 'source ' || src_addr || ' (/' || src_prefix_len || ') and destination ' || dst_addr || ' (/' ||
              dst_prefix_len || ') both matched local prefixes — classified Internal'
            ELSE 'neither source ' || src_addr || ' nor destination ' || dst_addr || ' matched a local prefix — classified Other' END AS reason
            FROM classified""",
        "cls4_validate_prefixes": f"""WITH {LISTED_SQL}
            SELECT position, 'error' AS level, 'prefix_too_long' AS code, CAST(NULL AS INTEGER) AS other_len FROM listed WHERE n > 32
            UNION ALL SELECT m.position, 'error', 'duplicate', NULL FROM masked m JOIN firsts f ON m.n = f.n AND m.lo = f.lo
              WHERE m.n <= 32 AND m.position > f.position
            UNION ALL SELECT greatest(a.position, b.position), 'warning',
              CASE WHEN b.position > a.position THEN 'inside_broader' ELSE 'contains_narrower' END,
              CAST(CASE WHEN b.position > a.position THEN a.n ELSE b.n END AS INTEGER)
              FROM firsts a JOIN firsts b ON {HOST_CONTAINS}""",
        "cls5_flows_by_direction": f"""{CLASSIFIED_CTES} SELECT direction, count(*) AS flows,
            count(*) FILTER (direction = 'unknown') AS lookup_failures FROM classified GROUP BY direction""",
        "agg12_cap_hosts": f"""{BASE_CTES}, u AS (SELECT {bucket_sql(DAY)} AS window_start, src_addr, max(ts) AS t FROM normal GROUP BY ALL),
            r AS (SELECT *, CAST(row_number() OVER (PARTITION BY window_start ORDER BY t DESC, src_addr) AS INTEGER) AS recency FROM u)
            SELECT window_start, src_addr, recency FROM r WHERE recency <= 5""",
        "agg13_active_entities": f"""{CLASSIFIED_CTES}, recent AS (SELECT * FROM classified
            WHERE epoch(ts) >= {ASOF - 6 * HOUR} AND epoch(ts) <= {ASOF}),
            k AS (SELECT 'host' AS entity, src_addr AS k FROM recent UNION SELECT 'host', dst_addr FROM recent
              UNION SELECT 'network', CAST(src_lo & 4294967040 AS VARCHAR) FROM recent WHERE family = 4
              UNION SELECT 'network', CAST(dst_lo & 4294967040 AS VARCHAR) FROM recent WHERE family = 4
              UNION SELECT 'hostgroup', src_hostgroup FROM recent WHERE src_hostgroup IS NOT NULL
              UNION SELECT 'hostgroup', dst_hostgroup FROM recent WHERE dst_hostgroup IS NOT NULL
              UNION SELECT 'asn', CAST(src_asn AS VARCHAR) FROM recent WHERE src_asn IS NOT NULL
              UNION SELECT 'asn', CAST(dst_asn AS VARCHAR) FROM recent WHERE dst_asn IS NOT NULL)
            SELECT entity, count(*) AS active FROM k GROUP BY entity""",
        "rat1_rate_windows": f"""{BASE_CTES}, d AS (SELECT unnest([3600, 7200, 86400]) AS duration),
            f AS (SELECT duration, CAST(floor(epoch(ts) / duration) AS BIGINT) * duration AS window_start, bytes, packets FROM normal, d),
            g AS (SELECT duration, window_start, sum(bytes) AS b, sum(packets) AS p, count(*) AS n FROM f GROUP BY ALL),
            s AS (SELECT duration, unnest(generate_series(lo, hi, duration)) AS window_start FROM
              (SELECT duration, min(window_start) AS lo, max(window_start) AS hi FROM g GROUP BY duration)),
            e AS (SELECT floor(epoch(max(ts))) AS now FROM normal)
            SELECT CAST(s.duration AS BIGINT) AS duration, CAST(s.window_start AS BIGINT) AS window_start,
              round(CAST(coalesce(b, 0) AS DOUBLE) * 8 / s.duration, 6) AS bps,
              round(CAST(coalesce(p, 0) AS DOUBLE) / s.duration, 6) AS pps, round(CAST(coalesce(n, 0) AS DOUBLE) / s.duration, 6) AS fps
            FROM s LEFT JOIN g ON g.duration = s.duration AND g.window_start = s.window_start, e
            WHERE s.window_start + s.duration <= now""",
        "qry1_traffic_summary": f"""{BASE_CTES}, r AS ({ROLLUP_SQL['family']}), b AS (SELECT window_start - window_start % {step} AS time, family,
              sum(bytes) AS bytes, sum(packets) AS packets FROM r WHERE {RANGE_SQL} GROUP BY ALL),
            v4 AS (SELECT * FROM b WHERE family = 4), v6 AS (SELECT * FROM b WHERE family = 6)
            SELECT coalesce(v4.time, v6.time) AS time,
              round(CAST(coalesce(v4.bytes, 0) AS DOUBLE) * 8 / {step}, 6) AS ipv4_bps, round(CAST(coalesce(v6.bytes, 0) AS DOUBLE) * 8 / {step}, 6) AS ipv6_bps,
              round(CAST(coalesce(v4.packets, 0) AS DOUBLE) / {step}, 6) AS ipv4_pps, round(CAST(coalesce(v6.packets, 0) AS DOUBLE) / {step}, 6) AS ipv6_pps
            FROM v4 FULL JOIN v6 ON v4.time = v6.time""",
        "qry3_exporters": f"""{BASE_CTES}, r AS ({ROLLUP_SQL['exporter']}) SELECT exporter, max(window_start) AS last_seen,
            greatest({ASOF} - max(window_start), 0) AS silent_seconds,
            round(CAST(coalesce(sum(bytes) FILTER (window_start >= {ASOF - 300}), 0) AS DOUBLE) * 8 / 300, 6) AS bps,
            round(CAST(coalesce(sum(packets) FILTER (window_start >= {ASOF - 300}), 0) AS DOUBLE) / 300, 6) AS pps
            FROM r WHERE window_start >= {ASOF - DAY} AND window_start < {ASOF + 1} GROUP BY exporter ORDER BY exporter LIMIT 1000""",
        "qry11_retention": f"{BASE_CTES}, r AS ({ROLLUP_SQL['total']}) SELECT * FROM r WHERE window_start > {ASOF - 10 * DAY}",
    }
    four = 4 * HOUR
    by_time = f"window_start - window_start % {four} AS time"
    for measure, column, scale in (("bps", "bytes", 8), ("pps", "packets", 1)):
        sql[f"qry4_family_{measure}"] = f"""{BASE_CTES}, r AS ({ROLLUP_SQL['family']}), u AS (
            SELECT {by_time}, 'IPv4' AS family, sum({column}) AS v FROM r WHERE family = 4 AND {RANGE_SQL} GROUP BY ALL
            UNION ALL SELECT {by_time}, 'IPv6', sum({column}) FROM r WHERE family = 6 AND {RANGE_SQL} GROUP BY ALL)
            SELECT time, family, {_rated('v', four, scale)} AS {measure} FROM u GROUP BY time, family"""
    v4 = f"FROM r WHERE family = 4 AND {RANGE_SQL} GROUP BY 1"
    other = f"round(CAST(sum(bytes) - sum(tcp_bytes) - sum(udp_bytes) - sum(icmp_bytes) AS DOUBLE) * 8 / {four}, 6)"
    sql["qry5_protocol_mix"] = (f"{BASE_CTES}, r AS ({ROLLUP_SQL['family']}) SELECT {by_time}, {_rated('tcp_bytes', four, 8)} AS tcp, "
                                f"{_rated('udp_bytes', four, 8)} AS udp, {_rated('icmp_bytes', four, 8)} AS icmp, {other} AS other {v4}")
    sql["qry6_attack_indicators"] = (
        f"{BASE_CTES}, r AS ({ROLLUP_SQL['family']}) SELECT {by_time}, {_rated('tcp_syn_packets', four)} AS tcp_syn, "
        f"{_rated('fragmented_packets', four)} AS fragmented, {_rated('dropped_packets', four)} AS dropped {v4}")
    sql["qry8_by_exporter"] = (f"{BASE_CTES}, r AS ({ROLLUP_SQL['exporter']}) SELECT {by_time}, exporter, "
                               f"{_rated('bytes', four, 8)} AS bps FROM r WHERE {RANGE_SQL} GROUP BY ALL")
    for i, dimension in enumerate(["total", "family", "host", "slash24", "network", "hostgroup", "asn", "exporter",
                                   "interface", "protocol"], 1):
        sql[f"agg{i}_{dimension}"] = sql[f"agg11_all_{dimension}"] = f"{CLASSIFIED_CTES} {ROLLUP_SQL[dimension]}"
    for dimension in traffic.TOP_KEYS:
        sql[f"qry2_top_{dimension}"] = _top_sql(dimension, 10)
        if dimension != "exporter":
            sql[f"qry7_top20_{dimension}"] = _top_sql(dimension, 20)
    return sql
