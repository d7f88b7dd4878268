"""Golden values, longest-prefix match against brute force, and the plans."""

import ipaddress
import random

import pytest
from pyspark.sql import functions as F

from checks import traffic_checks as tc
from floodplain.functions import net
from floodplain.operators import classify as cls
from floodplain.operators import normalize as nrm
from floodplain.operators import rollup as agg
from floodplain.plans import traffic
from floodplain.sources import tables


def plan_of(df):
    return df._jdf.queryExecution().executedPlan().toString()


def by_family(spark, rows):
    return spark.createDataFrame(rows, "window_start long, family int, bytes long, packets long").withColumn(
        "window_start", F.timestamp_seconds("window_start"))


def test_summary_puts_both_families_in_one_bucket(spark):
    end = 1_700_000_000
    bucket = end - 600
    df = by_family(spark, [(bucket, 4, 1_000_000, 2000), (bucket, 6, 500_000, 1000)])
    rows = traffic.traffic_summary(df, end - 3600, end).collect()
    assert [(r["ipv4_pps"], r["ipv6_pps"], r["ipv4_bps"], r["ipv6_bps"]) for r in rows] == [(200.0, 100.0, 800_000.0, 400_000.0)]
    assert rows[0]["time"] == bucket - bucket % 10


def test_top_hosts_are_ranked_by_bytes(spark):
    now = 1_700_000_000
    df = spark.createDataFrame([(now - 300, "203.0.113.10", 900, 9, 1), (now - 300, "203.0.113.20", 700, 7, 1), (now - 200, "203.0.113.10", 100, 1, 1),
                                (now - 300, "203.0.113.30", 100, 1, 1)], "s long, address string, bytes long, packets long, flows long")
    df = df.withColumn("window_start", F.timestamp_seconds("s"))
    rows = traffic.top_talkers(df, "host", now - 3600, now, 2).collect()
    assert [(r["key"], r["bytes"]) for r in rows] == [("203.0.113.10", 1000), ("203.0.113.20", 700)]


def test_exporter_rates_over_five_minutes(spark):
    now = 1_700_000_000
    df = spark.createDataFrame([(now - 60, "192.0.2.1", 30_000, 300), (now - 7200, "192.0.2.2", 1, 1), (now - 90_000, "192.0.2.3", 1, 1)],
                               "s long, exporter string, bytes long, packets long").withColumn("window_start", F.timestamp_seconds("s"))
    rows = {r["exporter"]: r for r in traffic.exporters(df, now).collect()}
    assert set(rows) == {"192.0.2.1", "192.0.2.2"}
    assert (rows["192.0.2.1"]["bps"], rows["192.0.2.1"]["pps"], rows["192.0.2.1"]["silent_seconds"]) == (800.0, 1.0, 60)
    assert rows["192.0.2.2"]["bps"] == 0.0 and rows["192.0.2.2"]["silent_seconds"] == 7200


@pytest.mark.parametrize("start, end", [(10, 10), (20, 10), (0, 31 * 86_400), (-5, 10), (2**32 - 10, 2**32)])
def test_bad_ranges_are_refused(start, end):
    with pytest.raises(ValueError):
        traffic.check_range(start, end)


def flow_rows(spark, rows):
    return spark.createDataFrame(rows, "flow_id long, src_lo long, dst_lo long, raw_bytes long, raw_packets long, sampling_record long, sampling_options long, exporter string")


def test_sampling_order_and_rejection(spark):
    big = 2**62
    df = flow_rows(spark, [(1, 1, 2, 10, 1, 100, 50, "a"), (2, 1, 2, 10, 1, 0, 50, "a"), (3, 1, 2, 10, 1, None, None, "a"), (4, 1, 2, 10, 1, None, None, "b"),
                           (5, 1, 2, 0, 0, None, None, "b"), (6, None, 2, 1, 1, None, None, "b"), (7, 1, 2, big, 1, 4, None, "b"), (8, 1, 2, 10, 1, 7, 0, "a"),
                           (9, 1, 2, 10, 0, 0, 0, "c")])
    rates = spark.createDataFrame([("a", 10), ("b", 0)], "exporter string, rate int")
    got = {r["flow_id"]: (r["sampling_rate"], r["sampling_source"], r["zero_rate_skipped"], r["reject_reason"]) for r in nrm.normalize_all(df, rates, 20).collect()}
    assert got == {1: (100, "record", False, None), 2: (50, "options", True, None), 3: (10, "exporter", False, None), 4: (20, "global", True, None),
                   5: (20, "global", True, "empty"), 6: (20, "global", True, "missing_addresses"), 7: (4, "record", False, "sampling_overflow"),
                   8: (7, "record", False, None), 9: (20, "global", True, None)}


def test_no_prefixes_means_unknown(spark, sf):
    df = cls.classify(tc.normal(spark, sf), tc.view(spark, sf, "prefixes").where("false"), with_reason=True)
    assert [r[0] for r in df.select("direction").distinct().collect()] == ["unknown"]


def brute(address, prefixes):
    held = [p for p in prefixes if address.version == p[0].version and address in p[0]]
    return max(held, key=lambda p: p[0].prefixlen)[1] if held else None


@pytest.mark.parametrize("options", [{}, {"broadcast_rows": 0}, {"max_lengths": 2}])
def test_longest_prefix_match_against_brute_force(spark, options):
    rng = random.Random(7)
    v4 = {ipaddress.ip_network((rng.getrandbits(32) & 0xFFFF0FFF, n), strict=False) for n in (0, 1, 8, 9, 16, 24, 31, 32) for _ in range(1 if n == 0 else 12)}
    v6 = {ipaddress.ip_network((rng.getrandbits(128), n), strict=False) for n in (1, 3, 63, 64, 65, 127, 128) for _ in range(8)}
    prefixes = [(p, f"t{i}") for i, p in enumerate(sorted(v4, key=str) + sorted(v6, key=str))]
    inside = [ipaddress.ip_address(int(p.network_address) | (rng.getrandbits(p.max_prefixlen - p.prefixlen) if p.prefixlen < p.max_prefixlen else 0))
              if p.version == 4 else ipaddress.IPv6Address(int(p.network_address)) for p, _ in prefixes]
    addresses = inside + [ipaddress.IPv4Address(rng.getrandbits(32)) for _ in range(100)] + [ipaddress.IPv6Address(rng.getrandbits(128)) for _ in range(100)]
    signed = lambda v: v - 2**64 if v >= 2**63 else v
    halves = lambda a: (4, 0, int(a)) if a.version == 4 else (6, signed(int(a) >> 64), signed(int(a) & (2**64 - 1)))
    table = spark.createDataFrame([(*halves(p.network_address), p.prefixlen, t, None) for p, t in prefixes],
                                  "family int, net_hi long, net_lo long, prefix_len int, tenant string, hostgroup string")
    df = spark.createDataFrame([(i, *halves(a)) for i, a in enumerate(addresses)], "i int, family int, hi long, lo long")
    from floodplain.operators.joins import longest_prefix_match

    got = {r["i"]: r["m"] and r["m"]["tenant"] for r in longest_prefix_match(df, table, {"m": ("family", "hi", "lo")}, ["tenant", "hostgroup"], **options).collect()}
    assert got == {i: brute(a, prefixes) for i, a in enumerate(addresses)}


def test_classification_does_not_shuffle_flows(spark, sf):
    plan = plan_of(tc.classified(spark, sf))
    assert "SortMergeJoin" not in plan and "CartesianProduct" not in plan and "BroadcastNestedLoopJoin" not in plan
    assert "BroadcastHashJoin" in plan


def test_all_rollups_read_the_flows_once(spark, sf):
    plan = plan_of(agg.rollup_all(tc.classified(spark, sf), 3600, **tc.LENGTHS))
    assert plan.count("events.parquet") == 1


def test_stored_rollups_prune_days_and_dimensions(spark, sf, tmp_path):
    path = str(tmp_path / "rollups")
    tables.write_rollups(agg.rollup_all(tc.classified(spark, sf), 3600, **tc.LENGTHS), path, batch_id=1)
    first = spark.read.parquet(path).count()
    tables.write_rollups(agg.rollup_all(tc.classified(spark, sf), 3600, **tc.LENGTHS), path, batch_id=1)  # the same batch again
    assert spark.read.parquet(path).count() == first
    day = traffic.in_range(tables.read_rollups(spark, path, "host"), tc.FROM, tc.FROM + 86_400)
    plan = plan_of(day)
    filters = plan[plan.index("PartitionFilters"):][:400]
    assert "dimension" in filters and "date" in filters
    assert day.select("date").distinct().count() == 1


def test_mixed_counters_saturate(spark):
    df = spark.createDataFrame([("2024-01-01 00:00:00", 2**62, 1), ("2024-01-01 00:00:01", 2**62, 1), ("2024-01-01 00:00:02", 2**62, 1)], "ts string, bytes long, packets long")
    df = df.withColumn("ts", F.col("ts").cast("timestamp"))
    for name, kind in (("protocol", "int"), ("tcp_flags", "int"), ("fragmented", "boolean"), ("forwarding_status_known", "boolean"), ("dropped", "boolean")):
        df = df.withColumn(name, F.lit(None).cast(kind))
    row = agg.rollup_total(df, 60).first()
    assert row["bytes"] == 2**63 - 1 and row["flows"] == 3


def test_rate_windows_fill_gaps_and_hide_the_open_window(spark):
    df = spark.createDataFrame([(0, 100, 1), (7, 50, 2), (12, 10, 1)], "s long, bytes long, packets long").withColumn("ts", F.timestamp_seconds("s"))
    rows = sorted((r["duration"], r["window_start"], r["bps"], r["fps"]) for r in agg.rate_windows(df, [1, 5], spine_chunk=3).collect())
    five = [r for r in rows if r[0] == 5]
    assert five == [(5, 0, 160.0, 0.2), (5, 5, 80.0, 0.2)]
    assert [r[1] for r in rows if r[0] == 1] == list(range(12))


def test_a_hot_group_is_ranked_exactly(spark):
    from floodplain.operators.joins import first_rows

    df = spark.range(5000).select((F.col("id") % 7 == 0).cast("int").alias("g"), F.col("id"))
    got = first_rows(df, ["g"], ["id"], 10).collect()
    assert sorted((r["g"], r["id"]) for r in got) == sorted([(1, i * 7) for i in range(10)] + [(0, i) for i in range(1, 12) if i % 7])


def test_masks_of_literals():
    assert net.mask_halves(4, 24) == (0, 0xFFFFFF00) and net.mask_halves(6, 48) == (-65536, 0) and net.mask_halves(6, 0) == (0, 0)


def test_a_registry_of_many_lengths_needs_no_exchange_of_the_flows(spark):
    """All lengths of both families against a plain search, and the plan."""
    import random

    from floodplain.operators.joins import longest_prefix_match

    draw = random.Random(4)

    def signed(v):
        return v - 2**64 if v >= 2**63 else v

    def bits(family, hi, lo):
        return lo if family == 4 else ((hi % 2**64) << 64) | (lo % 2**64)

    base = {4: 0x0A000000, 6: 0x20010DB8 << 96}
    prefixes, addresses = [], []
    for family, width in ((4, 32), (6, 128)):
        for n in range(400):
            length = draw.randint(0, width)
            spread = draw.getrandbits(width // 2) << draw.randint(0, width // 2)
            address = (base[family] ^ spread) % 2**width
            network = address >> (width - length) << (width - length)
            prefixes.append((family, length, signed(network >> 64) if family == 6 else 0, signed(network % 2**64) if family == 6 else network, f"t{n}"))
            addresses.append((family, signed(address >> 64) if family == 6 else 0, signed(address % 2**64) if family == 6 else address))
            addresses.append((family, *((0, draw.getrandbits(32)) if family == 4 else (signed(draw.getrandbits(64)), signed(draw.getrandbits(64))))))
    table = spark.createDataFrame(prefixes, "family INT, prefix_len INT, net_hi BIGINT, net_lo BIGINT, tenant STRING")
    frame = spark.createDataFrame([(i, *a) for i, a in enumerate(addresses)], "n INT, family INT, hi BIGINT, lo BIGINT")
    matched = longest_prefix_match(frame, table, {"m": ("family", "hi", "lo")}, ["tenant"])
    best = {}
    for family, length, hi, lo, tenant in prefixes:
        key = (family, length, hi, lo)
        best[key] = min(best.get(key, tenant), tenant)
    for row in matched.collect():
        width = 32 if row.family == 4 else 128
        value = bits(row.family, row.hi, row.lo)
        want = None
        for length in range(width, -1, -1):
            network = value >> (width - length) << (width - length)
            key = (row.family, length, signed(network >> 64) if row.family == 6 else 0, signed(network % 2**64) if row.family == 6 else network)
            if key in best:
                want = (best[key], length)
                break
        assert (None if row.m is None else (row.m.tenant, row.m.prefix_len)) == want
    plan = matched._jdf.queryExecution().executedPlan().toString().partition("== Initial Plan ==")[0]
    assert "SortMergeJoin" not in plan and plan.count("BroadcastHashJoin") == 4 + 16
