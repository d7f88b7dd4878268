"""The state machine by scenario, and the parallel fold against one plain pass."""

import json
import random

import pytest
from pyspark.sql import functions as F

from floodplain.operators import detect as dt
from floodplain.operators.machine import RECORD, Scope

S = 1_000_000
POLICY = ("p-host", 1, 2 * S, 2 * S, 60 * S, 0, 60 * S)  # trigger 2s, clear 2s, cooldown 60s, no hold-down, update 60s
THRESHOLD, CLEAR = 1_000_000, 800_000
HEAVY, LIGHT = 10_000_000, 80_000


def feed(scope, second, bps, policy=POLICY, threshold=THRESHOLD, clear=CLEAR):
    over = bps >= threshold
    matched = [{"metric": "bps", "observed": bps, "threshold": threshold, "excess": bps - threshold,
                "ratio_percent": bps * 100 // threshold}] if over else []
    scope.snapshot(second * S, over, bps <= clear, matched, policy, "{}")


def rows(scope, record):
    at = {n: i for i, n in enumerate(RECORD)}
    return [{n: r[i] for n, i in at.items()} for r in scope.out if r[at["record"]] == record]


def run(series, policy=POLICY, **levels):
    scope = Scope()
    for second, bps in series:
        feed(scope, second, bps, policy, **levels)
    return scope


def kinds(scope):
    return [e["kind"] for e in rows(scope, "event")]


def test_one_attack_makes_one_start_and_one_end():
    scope = run([(t, HEAVY) for t in range(6)] + [(t, LIGHT) for t in range(6, 10)])
    events = rows(scope, "event")
    assert [(e["kind"], e["sequence"]) for e in events] == [("started", 0), ("ended", 1)]
    assert events[0]["t"] == 2 * S and events[1]["t"] == 8 * S and events[1]["started"] == 2 * S
    assert json.loads(events[1]["peak"])[0]["observed"] == HEAVY
    assert scope.state == "cooldown"


def test_quiet_traffic_and_short_bursts_make_nothing():
    assert kinds(run([(t, LIGHT) for t in range(20)])) == []
    assert kinds(run([(0, LIGHT), (1, HEAVY)] + [(t, LIGHT) for t in range(2, 8)])) == []


def test_a_pending_trigger_aborts_in_the_hysteresis_band():
    scope = run([(0, HEAVY), (1, 900_000)])
    assert [t["reason"] for t in rows(scope, "transition")] == ["thresholdCrossed", "triggerAborted"]


def test_exactly_at_the_threshold_matches_and_exactly_at_clear_clears():
    scope = run([(t, THRESHOLD) for t in range(3)] + [(t, CLEAR) for t in range(3, 6)])
    assert kinds(scope) == ["started", "ended"]


def test_the_band_neither_updates_nor_clears():
    scope = run([(t, HEAVY) for t in range(3)] + [(t, 900_000) for t in range(3, 100)])
    assert kinds(scope) == ["started"] and scope.state == "active"


def test_cooldown_collapses_a_flapping_attack():
    series = [(t, HEAVY) for t in range(6)] + [(t, LIGHT) for t in range(6, 10)] + [(t, HEAVY) for t in range(10, 16)]
    scope = run(series)
    assert kinds(scope).count("started") == 1
    assert {r["reason"] for r in rows(scope, "suppressed")} == {"cooldown"}


def test_cooldown_expires_before_evaluation_in_the_same_step():
    scope = run([(t, HEAVY) for t in range(3)] + [(t, LIGHT) for t in range(3, 6)] + [(65, HEAVY)])
    assert [t["reason"] for t in rows(scope, "transition")][-2:] == ["cooldownExpired", "thresholdCrossed"]


def test_hold_down_delays_clearing():
    policy = ("p", 1, 2 * S, 2 * S, 0, 10 * S, 60 * S)
    scope = run([(t, HEAVY) for t in range(3)] + [(t, LIGHT) for t in range(3, 20)], policy)
    assert rows(scope, "event")[-1]["t"] == 14 * S and scope.state == "idle"
    assert {r["reason"] for r in rows(scope, "suppressed")} == {"holdDown"}


def test_clearing_is_aborted_by_the_band():
    scope = run([(t, HEAVY) for t in range(3)] + [(3, LIGHT), (4, 900_000), (5, LIGHT), (6, LIGHT), (7, LIGHT)])
    assert [t["reason"] for t in rows(scope, "transition")] == [
        "thresholdCrossed", "triggerSustained", "fellBelowClear", "clearAborted", "fellBelowClear", "clearSustained"]


def test_updates_are_paced():
    scope = run([(t, HEAVY) for t in range(0, 200)])
    assert [(e["kind"], e["t"] // S) for e in rows(scope, "event")] == [("started", 2), ("updated", 62), ("updated", 122), ("updated", 182)]


def test_peaks_keep_first_crossed_order():
    scope = Scope()
    reason = lambda m, o: {"metric": m, "observed": o, "threshold": 1, "excess": o - 1, "ratio_percent": o * 100}
    for second, matched in enumerate([[reason("pps", 5)], [reason("pps", 5)], [reason("pps", 4)], [reason("bps", 9), reason("pps", 7)]]):
        scope.snapshot(second * S, True, False, matched, POLICY, "{}")
    assert [(p["metric"], p["observed"]) for p in scope.peak] == [("pps", 7), ("bps", 9)]


def test_a_silent_exporter_closes_by_staleness_not_by_clearing():
    scope = run([(t, HEAVY) for t in range(6)])
    scope.sweep(184 * S, 180 * S)
    assert scope.state == "active"
    scope.sweep(185 * S, 180 * S)
    last = rows(scope, "event")[-1]
    assert (last["kind"], last["reason"], last["t"], last["closing"]) == ("ended", "stale", 185 * S, True)


def test_a_snapshot_exactly_at_the_stale_mark_still_counts():
    scope = run([(t, HEAVY) for t in range(3)])
    scope.sweep(182 * S, 180 * S, inclusive=False)
    feed(scope, 182, HEAVY)
    assert scope.state == "active" and kinds(scope) == ["started", "updated"]


def test_replays_neither_advance_nor_rewind():
    scope = run([(0, HEAVY), (1, HEAVY), (1, HEAVY), (0, HEAVY)])
    assert [r["reason"] for r in rows(scope, "ignored")] == ["duplicate", "outOfOrder"] and scope.state == "pendingTrigger"


def test_a_policy_change_ends_and_starts_afresh():
    scope = run([(t, HEAVY) for t in range(4)])
    feed(scope, 4, HEAVY, ("p-host", 2, *POLICY[2:]))
    assert kinds(scope) == ["started", "ended"]
    ended = rows(scope, "event")[-1]
    assert ended["reason"] == "policyChanged" and ended["policy_version"] == 1
    assert scope.state == "pendingTrigger" and scope.policy_version == 2


def test_manual_reset_closes_an_open_scope_only():
    scope = run([(t, HEAVY) for t in range(4)])
    scope.end(5 * S, "manualReset")
    scope.end(6 * S, "manualReset")
    assert kinds(scope) == ["started", "ended"] and scope.state == "idle"


def test_state_survives_a_round_trip():
    scope = run([(t, HEAVY) for t in range(5)])
    again = Scope.load(scope.dump())
    assert again.dump() == scope.dump()


@pytest.mark.parametrize("pattern, starts", [("steady", 0), ("flood", 1), ("spike", 0)])
def test_traffic_shapes(pattern, starts):
    peak = 10_000_000
    shape = {"steady": lambda t: peak // 10, "flood": lambda t: peak, "spike": lambda t: peak if 5 <= t < 7 else peak // 10}[pattern]
    policy = ("p", 1, 3 * S, 3 * S, 60 * S, 0, 60 * S)
    assert kinds(run([(t, shape(t)) for t in range(120)], policy, threshold=peak, clear=peak * 8 // 10)).count("started") == starts


def test_a_ramp_opens_once_when_the_rate_has_crossed():
    shape = lambda t: 1_000_000 + 9_000_000 * t // 119
    scope = run([(t, shape(t)) for t in range(120)], threshold=5_000_000, clear=4_000_000)
    events = rows(scope, "event")
    crossing = next(t for t in range(120) if shape(t) >= 5_000_000)
    assert [e["kind"] for e in events] == ["started"] + ["updated"] * (len(events) - 1)
    assert events[0]["t"] == (crossing + 2) * S


def test_flap_is_collapsed_by_cooldown():
    shape = lambda t: 10_000_000 if t // 6 % 2 == 0 else 1_000_000
    policy = ("p", 1, 3 * S, 3 * S, 60 * S, 0, 60 * S)
    assert kinds(run([(t, shape(t)) for t in range(120)], policy, threshold=10_000_000, clear=8_000_000)).count("started") == 2


@pytest.mark.parametrize("seed", range(30))
def test_events_are_well_nested_and_gapless(seed):
    rng = random.Random(seed)
    scope, t = Scope(), 0
    for _ in range(400):
        t += rng.choice([1, 1, 1, 2, 5, 200])
        scope.sweep(t * S, 180 * S, inclusive=False)
        feed(scope, t, rng.choice([HEAVY, HEAVY, 900_000, LIGHT, LIGHT]))
    opened = None
    for event in rows(scope, "event"):
        if event["kind"] == "started":
            assert opened is None and event["sequence"] == 0
            opened = event["started"]
        else:
            assert event["started"] == opened and event["sequence"] == sequence + 1
            opened = None if event["kind"] == "ended" else opened
        sequence = event["sequence"]


# --- through Spark ----------------------------------------------------------

ROW = ("scope_key string, t bigint, is_snapshot boolean, over boolean, below boolean, crossed string, policy_id string, "
       "policy_version bigint, trigger_for_ms bigint, clear_for_ms bigint, cooldown_ms bigint, hold_down_ms bigint, "
       "event_update_ms bigint, payload string")


def random_rows(seed, key):
    """A long history with quiet stretches, gaps, policy changes and resets."""
    rng = random.Random(seed)
    t, version, out = 0, 1, []
    timers = rng.choice([(2000, 2000, 60_000, 0, 60_000), (5000, 3000, 0, 10_000, 7000), (0, 0, 4000, 0, 1000)])
    for _ in range(60):
        mode = rng.choice(["attack", "quiet", "band", "mixed", "silence", "long quiet"])
        if mode == "silence":
            t += rng.choice([4, 5, 6, 30])
            continue
        for _ in range(rng.randint(1, 12) if mode != "long quiet" else 140):
            t += rng.choice([1, 1, 2, 5])
            if rng.random() < 0.01:
                version += 1
            if rng.random() < 0.02:
                out.append((key, t * S, False, None, None, None, "manualReset", None, None, None, None, None, None, None))
            bps = {"attack": HEAVY, "quiet": LIGHT, "long quiet": LIGHT, "band": 900_000}.get(mode) or rng.choice([HEAVY, LIGHT, 900_000])
            crossed = json.dumps([{"metric": "bps", "observed": bps + t, "threshold": THRESHOLD, "excess": 0, "ratio_percent": 0}])
            over = bps >= THRESHOLD
            out.append((key, t * S, True, over, bps <= CLEAR, crossed if over else None, "p", version, *timers, f'{{"n":{t}}}'))
    return out


def plain_pass(rows_, stale, asof):
    fold = dt._EpisodeFold(stale * S, asof and asof * S)
    out = []
    newest = max(r[1] for r in rows_ if r[2])
    for r in sorted(rows_, key=lambda r: (r[1], not r[2])):
        out += fold.row(r[1], newest, *r[2:])
    return out + fold.finish()


@pytest.mark.parametrize("swept, slot", [(True, 7), (False, 20), (True, 90)])
def test_cutting_histories_changes_nothing(spark, swept, slot):
    """Episodes folded apart give the events and transitions of one pass per scope."""
    stale = 5
    data = {f"scope-{s}": random_rows(s, f"scope-{s}") for s in range(40)}
    asof = max(r[1] for rows_ in data.values() for r in rows_) // S + 100 if swept else None
    clock = asof and asof * S
    df = spark.createDataFrame([r for rows_ in data.values() for r in rows_], ROW)
    cut = dt.episodes(df, stale * 1000, slot_ms=slot * 1000).withColumn("_turn", dt.in_turn())
    from floodplain.operators.folds import ordered_fold

    log = ordered_fold(cut, ["scope_key", "episode"], ["t", "_turn"], dt.FOLD_INPUT,
                       lambda *_: dt._EpisodeFold(stale * S, clock), f"scope_key STRING, episode BIGINT, {dt.LOG_COLUMNS}")
    rows_ = log.where("record in ('event', 'transition', 'suppressed')").collect()
    assert len({(r["scope_key"], r["episode"]) for r in rows_}) > 200
    drop = {"in_previous"}
    names = [n for n in RECORD if n not in drop]
    got = {}
    for r in rows_:
        got.setdefault(r["scope_key"], []).append(tuple(r[n] for n in names))
    for key, history in data.items():
        want = [tuple(v for n, v in zip(RECORD, r) if n not in drop) for r in plain_pass(history, stale, asof)
                if r[0] in ("event", "transition", "suppressed")]
        assert sorted(got.get(key, []), key=repr) == sorted(want, key=repr), key
