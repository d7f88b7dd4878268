"""Policies over time, and histories that no task orders whole."""

import datetime
import random

import pytest
from pyspark.sql import functions as F

from checks import detection_checks as dc
from checks.views import policies
from floodplain.operators import detect as dt
from floodplain.operators import evaluate as evl
from floodplain.operators import slices
from floodplain.operators import timeline as tml
from floodplain.operators.machine import RECORD
from tests.test_detection import HEAVY, LIGHT, ROW, S, plain_pass

DAY = 86_400


def at(second):
    return datetime.datetime.fromtimestamp(second, datetime.timezone.utc)


@pytest.mark.parametrize("sets", [[0], [5 * DAY + 7], [0, 1, DAY, DAY + 1, 40 * DAY], sorted(random.Random(3).sample(range(60 * DAY), 50))])
def test_the_set_in_force(spark, sets):
    draw = random.Random(4)
    moments = sorted({draw.randrange(-DAY, 70 * DAY) for _ in range(200)} | {x + d for x in sets for d in (-1, 0, 1)})
    rows = spark.createDataFrame([(at(m),) for m in moments], "window_end TIMESTAMP")
    known = tml.revisions_of(spark.createDataFrame([(at(x), name) for x in sets for name in ("a", "b")], "valid_from TIMESTAMP, policy_id STRING"))
    found = {int(r.window_end.timestamp()): r.revision for r in tml.as_of(rows, "window_end", known).collect()}
    assert found == {m: max((x * S for x in sets if x <= m), default=None) for m in moments}
    assert all(r.revision is None for r in tml.as_of(rows, "window_end", known.limit(0)).collect())


def logged(log):
    names = ["scope_key", *(n for n in RECORD if n not in ("in_previous", "record")), "record"]
    return sorted(map(str, log.where("record IN ('event', 'transition', 'suppressed')").select(*names).collect()))


def test_one_set_is_no_timeline_and_a_disabled_set_ends_everything(spark, sf):
    snaps, known = dc.snapshots(spark, sf).persist(), policies(spark, sf)
    stale = 7_200_000
    always = known.withColumn("valid_from", F.timestamp_seconds(F.lit(0)))
    plain = dt.detect(evl.evaluate(dc.pol.select_policy(snaps, known), known), None, stale_after_ms=stale)
    assert logged(tml.detect_as_of(snaps, always, stale_after_ms=stale)) == logged(plain)
    # The same set again changes nothing.
    middle = plain.where("kind = 'started'").agg(F.expr("percentile(t, 0.5)")).first()[0] // S
    again = always.unionByName(known.withColumn("valid_from", F.timestamp_seconds(F.lit(middle))))
    assert logged(tml.detect_as_of(snaps, again, stale_after_ms=stale)) == logged(plain)
    # From one microsecond after an opening on nothing is watched any more.
    opened = plain.where("kind = 'started'").agg(F.max("t")).first()[0]
    none = known.withColumn("enabled", F.lit(False)).withColumn("valid_from", F.timestamp_micros(F.lit(opened + 1)))
    log = tml.detect_as_of(snaps, always.unionByName(none), stale_after_ms=stale).where("record = 'event'").collect()
    withdrawn = [r for r in log if r.reason == "policyWithdrawn"]
    assert withdrawn and all(r.t == opened + 1 and r.kind == "ended" and r.closing for r in withdrawn)
    assert max(r.t for r in log) == opened + 1
    assert {(r.scope_key, r.started) for r in log if r.kind == "started"} == {(r.scope_key, r.started) for r in log if r.kind == "ended"}


def test_a_change_goes_before_a_snapshot_of_its_moment(spark):
    timers = (0, 0, 0, 0, 60_000)
    snap = lambda second, version: ("k", second * S, True, True, False, "[]", "p", version, *timers, "{}")
    rows = [snap(1, 1), snap(2, 2), ("k", 2 * S, False, None, None, None, "policyChanged", None, *[None] * 5, None), ("k", 3 * S, False, None, None, None, "manualReset", None, *[None] * 5, None), snap(3, 2)]
    cut = dt.episodes(spark.createDataFrame(rows, ROW), 180_000).withColumn("_turn", dt.in_turn())
    from floodplain.operators.folds import ordered_fold

    log = ordered_fold(cut, ["scope_key", "episode"], ["t", "_turn"], dt.FOLD_INPUT, lambda *_: dt._EpisodeFold(180 * S, None), f"scope_key STRING, episode BIGINT, {dt.LOG_COLUMNS}")
    events = [(r.t // S, r.kind, r.reason) for r in log.where("record = 'event'").orderBy("t", "started", "sequence").collect()]
    assert events == [(1, "started", "thresholdCrossed"), (2, "ended", "policyChanged"), (2, "started", "thresholdCrossed"), (3, "ended", "manualReset")]


def test_one_long_scope_is_cut_and_folds_in_parallel(spark):
    """A scope of 200 000 snapshots: the cut log is that of one pass, and many tasks fold it."""
    draw = random.Random(9)
    rows, t = [], 0
    timers = (30_000, 30_000, 60_000, 0, 600_000)
    while len(rows) < 200_000:
        for length, bps in ((draw.choice((5, 40)), HEAVY), (draw.choice((30, 700)), LIGHT)):
            for _ in range(length):
                t += 15
                rows.append(("long", t * S, True, bps == HEAVY, bps == LIGHT, '[{"metric": "bps", "observed": 1, "threshold": 1, "excess": 0, "ratio_percent": 100}]' if bps == HEAVY else None, "p", 1, *timers, "{}"))
    cut = dt.episodes(spark.createDataFrame(rows, ROW)).withColumn("_turn", dt.in_turn())
    assert cut.select("episode").distinct().count() > 100 and cut.count() < len(rows) / 2
    from floodplain.operators.folds import ordered_fold

    log = ordered_fold(cut, ["scope_key", "episode"], ["t", "_turn"], dt.FOLD_INPUT, lambda *_: dt._EpisodeFold(180 * S, None), f"scope_key STRING, episode BIGINT, {dt.LOG_COLUMNS}")
    got = log.where("record IN ('event', 'transition')").collect()
    names = [n for n in RECORD if n != "in_previous"]
    want = [tuple(v for n, v in zip(RECORD, r) if n != "in_previous") for r in plain_pass(rows, 180, None) if r[0] in ("event", "transition")]
    assert sorted((tuple(r[n] for n in names) for r in got), key=repr) == sorted(want, key=repr)


def test_earlier_rows_by_slices_equal_one_window(spark):
    draw = random.Random(5)
    rows = [(draw.choice(("a", "b", None)), t, draw.choice((None, 1, 2, 3, 9)), draw.random()) for t in range(600)]
    df = spark.createDataFrame(rows, "k STRING, t LONG, v INT, other DOUBLE")
    facts = {"newest": ("last", F.struct("v", "t")), "kept": ("last", F.col("v")), "top": ("max", F.col("v"))}
    for sliced in (slices.by_range(df.repartition(9), ["k"], "t"), slices.by_time(df, F.col("t") * 1000, 17)):
        found = {r.t: r for r in slices.before(sliced, ["k"], ["t"], facts).collect()}
        for k, t, *_ in rows:
            earlier = [r for r in rows if r[0] == k and r[1] < t]
            values = [r[2] for r in earlier if r[2] is not None]
            assert found[t].kept == (values[-1] if values else None) and found[t].top == max(values, default=None)
            assert found[t].newest == ((earlier[-1][2], earlier[-1][1]) if earlier else None)


def test_no_window_orders_the_raw_rows_of_a_scope(spark):
    """Windows over raw rows are of a slice; windows over a whole scope see one row a slot."""
    timers = (0, 0, 0, 0, 60_000)
    df = spark.createDataFrame([("k", k * S, True, k % 7 == 0, k % 7 != 0, None, "p", 1, *timers, "{}") for k in range(500)], ROW)
    plan = dt.episodes(df, 5000, slot_ms=10_000)._jdf.queryExecution().optimizedPlan().toString()
    # Every window stands above the aggregate by scope and slot, none between it and the rows.
    assert "Window [" in plan and plan.rindex("Window [") < plan.rindex("Aggregate [scope_key")
