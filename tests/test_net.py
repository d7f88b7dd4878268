import ipaddress

import pytest
from pyspark.sql import functions as F

from floodplain.functions import net, rates, text

ADDRESSES = [
    "0.0.0.0", "10.0.0.1", "255.255.255.255", "203.0.113.7", "::", "::1", "2001:db8::1", "2001:db8:0:1:0:0:0:1",
    "fe80::1:0:0:1", "1:0:0:2:0:0:0:3", "ffff:ffff:ffff:ffff:ffff:ffff:ffff:ffff", "2001:db8::", "1:2:3:4:5:6:7:8",
    "::ffff:192.0.2.1", "64:ff9b::192.0.2.33", "0:1::", "1:0:2:0:3:0:4:0",
]
NOT_ADDRESSES = ["", "1.2.3", "1.2.3.256", "1.2.3.4.5", ":::", "1::2::3", "2001:db8", "g::1", "12345::", "1:2:3:4:5:6:7:8:9",
                 ":1:2:3:4:5:6:7:8", "a.b.c.d", "1:2:3:4:5:6:7:", "01.2.3.4"]


def halves(address):
    ip = ipaddress.ip_address(address)
    if ip.version == 4:
        return 4, 0, int(ip)
    signed = lambda v: v - 2**64 if v >= 2**63 else v
    return 6, signed(int(ip) >> 64), signed(int(ip) & (2**64 - 1))


def test_parse_and_print_round_trip(spark):
    df = spark.createDataFrame([(a,) for a in ADDRESSES], "t string").withColumn("a", net.parse_address(F.col("t")))
    df = df.withColumn("back", net.address_text(F.col("a.family"), F.col("a.hi"), F.col("a.lo")))
    for row in df.collect():
        assert tuple(row["a"]) == halves(row["t"]), row
        assert row["back"] == str(ipaddress.ip_address(row["t"])), row


def test_malformed_addresses_are_null(spark):
    df = spark.createDataFrame([(a,) for a in NOT_ADDRESSES], "t string")
    bad = df.where(net.parse_address(F.col("t")).isNotNull()).collect()
    assert bad == []


def test_mask_columns_match_integer_masks(spark):
    cases = [(f, n) for f, top in ((4, 32), (6, 128)) for n in range(top + 1)] + [(4, 40), (6, 200)]
    df = spark.createDataFrame(cases, "f int, n int")
    for row in df.select("f", "n", net.mask_hi(F.col("f"), F.col("n")).alias("h"), net.mask_lo(F.col("f"), F.col("n")).alias("l")).collect():
        assert (row["h"], row["l"]) == net.mask_halves(row["f"], row["n"])


def test_contains_refuses_other_family_and_overlong(spark):
    cases = [("10.0.0.0", 8, "10.9.9.9", True), ("10.0.0.0", 0, "11.0.0.0", True), ("10.0.0.0", 33, "10.0.0.0", False),
             ("::", 0, "10.0.0.0", False), ("2001:db8::", 32, "2001:db8:1::1", True), ("2001:db8::", 127, "2001:db8::2", False)]
    df = spark.createDataFrame(cases, "n string, l int, a string, want boolean")
    n, a = net.parse_address(F.col("n")), net.parse_address(F.col("a"))
    got = net.contains(n["family"], n["hi"], n["lo"], F.col("l"), a["family"], a["hi"], a["lo"])
    assert df.where(got != F.col("want")).count() == 0


def test_unmap(spark):
    row = spark.range(1).select(net.unmap(net.parse_address(F.lit("::ffff:10.0.0.1"))).alias("a")).first()
    assert tuple(row["a"]) == (4, 0, 167772161)


@pytest.mark.parametrize("spelling, want", [
    ("250ms", 250), ("30s", 30_000), ("5m", 300_000), ("2h", 7_200_000), ("1d", 86_400_000), (" 5m ", 300_000),
    ("300", None), ("5 m", None), ("", None), ("m", None), ("99999999999999999999d", None), ("9223372036854775807d", None)])
def test_durations(spark, spelling, want):
    assert spark.range(1).select(text.parse_duration_ms(F.lit(spelling))).first()[0] == want


@pytest.mark.parametrize("spelling, want", [
    ("250", 250), ("1k", 1000), ("1K", 1000), ("500M", 500_000_000), ("10G", 10_000_000_000), ("2T", 2 * 10**12),
    ("1.5G", None), ("10g", None), ("-1", None), ("", None), ("99999999T", None)])
def test_magnitudes(spark, spelling, want):
    assert spark.range(1).select(text.parse_magnitude(F.lit(spelling))).first()[0] == want


def test_rendered_durations_are_shortest_and_exact(spark):
    cases = {300_000: "5m", 90_000: "90s", 86_400_000: "1d", 250: "250ms", 0: "0ms", 7_200_000: "2h"}
    df = spark.createDataFrame([(k,) for k in cases], "v bigint").select("v", text.render_duration(F.col("v")).alias("t"))
    assert {r["v"]: r["t"] for r in df.collect()} == cases


def test_rates_saturate_instead_of_overflowing(spark):
    big = 2**63 - 1
    one = spark.range(1)
    ratio = lambda o, t: one.select(rates.ratio_percent(F.lit(o).cast("bigint"), F.lit(t).cast("bigint"))).first()[0]
    assert ratio(250, 100) == 250 and ratio(299, 100) == 299 and ratio(1, 3) == 33
    assert ratio(big, 1) == big and ratio(5, 0) == big and ratio(big, big) == 100
    clear = lambda t, p: one.select(rates.clear_threshold(F.lit(t).cast("bigint"), F.lit(p))).first()[0]
    assert clear(20000, 80) == 16000 and clear(7, 50) == 3 and clear(big, 100) == big
    assert one.select(rates.bits_per_second(F.lit(big).cast("bigint"), 1000)).first()[0] == big
    assert one.select(rates.bits_per_second(F.lit(30_000).cast("bigint"), 300_000)).first()[0] == 800
    assert one.select(rates.bits_per_second(F.lit(100).cast("bigint"), 250)).first()[0] == 3200


@pytest.mark.parametrize("span, step", [(3600, 10), (86_400, 180), (30 * 86_400, 5190), (1, 10), (5001, 20)])
def test_step(spark, span, step):
    assert rates.step_for(0, span) == step
    assert spark.range(1).select(rates.step_seconds(F.lit(0), F.lit(span).cast("bigint"))).first()[0] == step
