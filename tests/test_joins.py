"""Joins that must stay bounded: large registries, overlapping lists, ranked candidates, exporters of a stream."""

import ipaddress
import random

import pytest
from pyspark.sql import functions as F

from checks import detection_checks as dc
from checks.views import view
from floodplain.operators import joins, mitigation, policy, snapshots
from floodplain.streaming import jobs
from tests.test_streaming import run, split_by_time, stream

V6 = 0x20010DB8 << 96


def signed(v):
    return v - 2**64 if v >= 2**63 else v


def halves(net):
    a = int(net.network_address)
    return (4, 0, a) if net.version == 4 else (6, signed(a >> 64), signed(a & (2**64 - 1)))


def plan_of(df):
    return df._jdf.queryExecution().executedPlan().toString().partition("== Initial Plan ==")[0]


def test_half_a_million_entries_under_one_network(spark):
    """Single addresses of one /96 next to a few wide networks: flows stay where they are."""
    hi, base = V6 >> 64, 7 << 32
    many = spark.range(500_000).select(F.lit(6).alias("family"), F.lit(hi).cast("bigint").alias("net_hi"), (F.lit(base) + F.col("id") * 3).alias("net_lo"),
                                       F.lit(128).alias("prefix_len"), F.concat(F.lit("t"), F.col("id") % 7).alias("tenant"))
    wide = spark.createDataFrame([(6, hi, base, 96, "wide"), (6, hi, 0, 32, "far"), (6, hi, base + 30, 127, "pair")], "family INT, net_hi BIGINT, net_lo BIGINT, prefix_len INT, tenant STRING")
    df = spark.range(0, 2_000_000, 997).select("id", F.lit(6).alias("family"), F.lit(hi).cast("bigint").alias("hi"), (F.lit(base) + F.col("id")).alias("lo"))
    found = joins.longest_prefix_match(df, many.unionByName(wide), {"m": ("family", "hi", "lo")}, ["tenant"])
    plan = plan_of(found)
    assert plan.count("BroadcastHashJoin") == 3 and "SortMergeJoin" not in plan and "ShuffledHashJoin" not in plan
    want = F.when((F.col("id") % 3 == 0) & (F.col("id") < 1_500_000), F.concat(F.lit("t"), (F.col("id") / 3).cast("bigint") % 7)).otherwise(F.lit("wide"))
    assert found.where(~F.col("m.tenant").eqNullSafe(want)).count() == 0 and found.count() == 2007


def test_blocks_with_own_lengths_against_brute_force(spark):
    """An entry covers a prefix only if it is no longer than it: the chain of an interval is walked upwards."""
    draw = random.Random(11)
    nets = {ipaddress.ip_network((0x0A000000 | draw.getrandbits(10) << draw.randint(0, 14), n), strict=False) for n in range(0, 33) for _ in range(3)}
    nets |= {ipaddress.ip_network((V6 | draw.getrandbits(9) << draw.randint(0, 80), n), strict=False) for n in range(20, 129) for _ in range(2)}
    entries = [(*halves(n), n.prefixlen, f"t{i}") for i, n in enumerate(sorted(nets, key=str))]
    asked = [ipaddress.ip_network((int(n.network_address), draw.randint(0, n.max_prefixlen)), strict=False) for n in sorted(nets, key=str) for _ in range(3)]
    table = spark.createDataFrame(entries, "family INT, net_hi BIGINT, net_lo BIGINT, prefix_len INT, tenant STRING")
    df = spark.createDataFrame([(i, *halves(n), n.prefixlen) for i, n in enumerate(asked)], "i INT, family INT, hi BIGINT, lo BIGINT, n INT")
    got = {r.i: r.m and (r.m.tenant, r.m.prefix_len) for r in joins.longest_prefix_match(df, table, {"m": ("family", "hi", "lo", "n")}, ["tenant"]).collect()}
    named = list(zip(sorted(nets, key=str), entries, strict=True))
    for i, prefix in enumerate(asked):
        over = [(n.prefixlen, e[4]) for n, e in named if n.version == prefix.version and prefix.subnet_of(n)]
        best = max(over) if over else None
        assert got[i] == (best and (best[1], best[0]))


def test_overlaps_without_pairs_against_brute_force(spark):
    draw = random.Random(5)
    rows = []
    for position in range(400):
        net = ipaddress.ip_network((0x0A000000 | draw.getrandbits(12) << 8, draw.choice([8, 16, 20, 22, 24, 28, 32])), strict=False)
        rows.append((position, net, draw.choice(["a", "a", "a", "b", "c", None])))
    draw.shuffle(rows)
    df = spark.createDataFrame([(p, *halves(n), n.prefixlen, t) for p, n, t in rows], "position INT, family INT, net_hi BIGINT, net_lo BIGINT, prefix_len INT, tenant STRING")
    got = {r.position: r.other for r in joins.earliest_of_others(df, "position", "tenant").collect()}
    for position, net, tenant in rows:
        near = [p for p, n, t in rows if n != net and t and tenant and t != tenant and (n.subnet_of(net) or net.subnet_of(n))]
        assert got[position] == (min(near) if near else None)


def test_one_network_listed_very_often(spark):
    """Rows that two tenants repeat make no pairs: each network counts once a tenant."""
    df = spark.range(20_000).select(
        F.col("id").cast("int").alias("position"), F.lit(4).alias("family"), F.lit(0).cast("bigint").alias("net_hi"), F.lit(10 << 24).cast("bigint").alias("net_lo"),
        F.when(F.col("id") % 2 == 0, 16).otherwise(24).alias("prefix_len"), F.when(F.col("id") % 2 == 0, F.lit("a")).otherwise(F.lit("b")).alias("tenant"), F.array(F.lit("rtbh")).alias("actions"))
    errors = mitigation.validate_allowlist(df)
    assert errors.groupBy("error_code").count().collect() == [("overlap", 19_999)]


def test_candidates_meet_by_whole_keys(spark, sf):
    matched = policy.match_policies(dc.scopes(spark, sf), dc.policies(spark, sf))
    plan = plan_of(matched)
    assert "NestedLoop" not in plan and "Cartesian" not in plan
    for key in ("k_kind", "k_hi", "k_lo", "k_len", "k_group", "k_family", "k_tenant", "k_scope", "k_direction"):
        assert key in plan


def test_window_counts_of_no_flows_and_of_flows_without_a_time(spark, sf):
    flows = dc.classified(spark, sf)
    assert snapshots.window_stats(flows.where("false"), 60_000).collect() == [(0, 0, 0)]
    whole = snapshots.window_stats(flows, 60_000).first()
    late = snapshots.window_stats(flows.withColumn("ts", F.lit(None).cast(flows.schema["ts"].dataType)), 60_000).first()
    assert late[:2] == whole[:2] and late[2] == 0 < whole[2]
    assert snapshots.snapshots(flows, 60_000).count() == whole[2]


def test_streamed_exporters_are_exact(spark, sf, tmp_path):
    """More exporters than a 64-bit sketch can tell apart."""
    flows = view(spark, sf, "flows").withColumn("exporter", F.concat(F.lit("10.0."), F.col("flow_id") % 200, F.lit(".1")))
    at = F.expr("timestamp_millis(1700006400000 + (flow_id DIV 700) * 86400000 + (flow_id % 700) * 1000)")  # two days
    flows = flows.withColumn("ts", at.cast(flows.schema["ts"].dataType))
    source = split_by_time(flows, str(tmp_path / "flows"), "ts", 3)
    prefixes, rates = view(spark, sf, "prefixes"), view(spark, sf, "exporter_rates")
    live = stream(spark, source, flows.schema).withWatermark("ts", "1 minute")
    out = str(tmp_path / "snaps")
    run(jobs.stream_snapshots(jobs.classified_flows(live, prefixes, rates, 100), 86_400_000, out, str(tmp_path / "cp")))
    batch = snapshots.snapshots(jobs.classified_flows(flows, prefixes, rates, 100), 86_400_000)
    newest = batch.agg(F.max("window_start")).first()[0]
    want = batch.where(F.col("window_start") < newest)
    got = spark.read.parquet(out).drop("batch_id").where(F.col("window_start") < newest)
    assert {str(r) for r in got.select(*want.columns).collect()} == {str(r) for r in want.collect()}
    assert want.agg(F.max("exporters_observed")).first()[0] > 64


@pytest.mark.parametrize("how", ["left", "inner", "left_semi", "left_anti"])
def test_only_hot_keys_are_copied_past_the_broadcast_bound(spark, monkeypatch, how):
    monkeypatch.setattr(joins, "HOT_ROWS", 40)
    left = spark.range(300).select(F.when(F.col("id") < 100, 7).when(F.col("id") < 120, F.lit(None)).otherwise(F.col("id")).alias("k"), "id")
    right = spark.range(0, 280).select(F.col("id").alias("k"), (F.col("id") * 2).alias("v")).drop(*([] if how in ("left", "inner") else ["v"]))
    assert [r.k for r in joins.hot_keys(left.where("k IS NOT NULL"), ["k"]).collect()] == [7]
    out = joins.lookup_join(left, right, ["k"], how, small=False)
    assert sorted(out.collect(), key=repr) == sorted(left.join(right, ["k"], how).collect(), key=repr)
    copies = [line for line in out._jdf.queryExecution().optimizedPlan().toString().splitlines() if "explode(" in line]
    assert copies and all("CASE WHEN" in line for line in copies)
