"""One stateful processor for every keyed fold.

The state objects are those of the batch folds; here they are stored as text per
key, and event-time timers stand in for the as-of clock. Rows wait until the
watermark has passed them and are then applied in the order of their times, so
that neither micro-batches nor several inputs decide what goes first.

What grows as long as a key lives, such as the detections of an incident, is no
part of that text: each is an entry of a map, asked for by its key and written once
a batch at most, so what a batch writes follows its rows and not the key's age.
"""

from __future__ import annotations

import json
from collections.abc import Callable, Iterator
from itertools import islice

import pandas as pd
from pyspark.sql import DataFrame
from pyspark.sql import types as T
from pyspark.sql.streaming.stateful_processor import StatefulProcessor, StatefulProcessorHandle

from ..operators.case import Case, CasePolicy
from ..operators.detect import POLICY_ENDS, TIMERS
from ..operators.incidents import COMMAND_FACTS
from ..operators.machine import Scope
from ..operators.notify import Bucket, Delivery, Repeats

STATE = T.StructType([T.StructField("text", T.StringType())])
MEMBER = T.StructType([T.StructField("owner", T.StringType()), T.StructField("member", T.StringType())])
REMOVED_AT_ONCE = 10_000


class KeyedFold(StatefulProcessor):
    """``adapter`` is picklable: COLUMNS, load, apply, due, expire, dump; see below.

    One with ``attach`` keeps sets apart from its text: ``attach(folder, known)`` lends it the test whether
    (owner, member) is stored, ``members(folder)`` gives what to store and ``owners(folder)`` whose members stay.
    """

    def __init__(self, adapter, names: list[str]):
        self.adapter, self.names = adapter, names

    def init(self, handle: StatefulProcessorHandle) -> None:
        self.handle = handle
        self.value = handle.getValueState("state", STATE)
        self.waiting = handle.getListState("waiting", STATE)
        self.sets = handle.getMapState("sets", MEMBER, STATE) if hasattr(self.adapter, "attach") else None

    def handleInputRows(self, key, rows: Iterator[pd.DataFrame], timerValues) -> Iterator[pd.DataFrame]:
        fresh = []
        for frame in rows:
            frame = frame[self.adapter.COLUMNS].astype(object)
            fresh += frame.where(frame.notna(), None).to_dict("records")
        yield from self._step(key, fresh, timerValues.getCurrentWatermarkInMs(), None)

    def handleExpiredTimer(self, key, timerValues, expiredTimerInfo) -> Iterator[pd.DataFrame]:
        yield from self._step(key, [], timerValues.getCurrentWatermarkInMs(), expiredTimerInfo.getExpiryTimeInMs())

    def _step(self, key, fresh: list[dict], watermark: int, expired: int | None) -> Iterator[pd.DataFrame]:
        stored = self.value.get()[0] if self.value.exists() else None
        folder = self.adapter.load(key, stored)
        owners = set()
        if self.sets is not None:
            owners = self.adapter.owners(folder)
            self.adapter.attach(folder, lambda owner, member: self.sets.containsKey((owner, member)))
        held = [json.loads(row[0]) for row in self.waiting.get()] if self.waiting.exists() else []
        passed = lambda row: int(row["t"]) // 1000 <= watermark
        ready = [row for row in [*held, *fresh] if passed(row)]
        later = [row for row in [*held, *fresh] if not passed(row)]
        out = self.adapter.apply(folder, pd.DataFrame(ready, columns=self.adapter.COLUMNS, dtype=object)) if ready else []
        if expired is not None:
            out = [*out, *self.adapter.expire(folder, expired)]
        text = lambda row: (json.dumps(row, default=lambda x: x.item()),)
        if len(later) < len(held) + len(fresh) and held:
            self.waiting.put([text(row) for row in later]) if later else self.waiting.clear()
        elif later[len(held):]:
            self.waiting.appendList([text(row) for row in later[len(held):]])
        if self.sets is not None:
            self._keep_sets(folder, owners)
        yield from self._done(key, folder, out, later, stored)

    def _keep_sets(self, folder, before: set) -> None:
        stay = self.adapter.owners(folder)
        for owner, member in self.adapter.members(folder):
            self.sets.updateValue((owner, member), ("",))
        gone = before - stay
        while gone:
            part = list(islice((tuple(entry) for entry in self.sets.keys() if entry[0] in gone), REMOVED_AT_ONCE))
            for entry in part:
                self.sets.removeKey(entry)
            if len(part) < REMOVED_AT_ONCE:
                break

    def _done(self, key, folder, out, later, stored):
        for timer in list(self.handle.listTimers()):
            self.handle.deleteTimer(timer)
        text = self.adapter.dump(folder)
        due = [int(row["t"]) // 1000 for row in later]
        if text is None:
            self.value.clear()
        else:
            if text != stored:
                self.value.update((text,))
            due.append(self.adapter.due(folder))
        due = [moment for moment in due if moment is not None]
        if due:
            self.handle.registerTimer(min(due))
        if out:
            rows = [tuple(key) + tuple(r) for r in out]
            yield pd.DataFrame({n: pd.Series(c, dtype=object) for n, c in zip(self.names, zip(*rows))})

    def close(self) -> None:
        pass


def keyed_fold(df: DataFrame, keys: list[str], adapter, schema: str) -> DataFrame:
    names = [part.split()[0] for part in schema.split(",")]
    return df.groupBy(*keys).transformWithStateInPandas(
        statefulProcessor=KeyedFold(adapter, names), outputStructType=schema, outputMode="Append", timeMode="EventTime")


class DetectAdapter:
    """Scopes: rows of ``fold_rows`` and ``reset_rows``."""

    COLUMNS = ["t", "is_snapshot", "over", "below", "crossed", "policy_id", "policy_version", *TIMERS, "payload"]

    def __init__(self, stale_after_ms: int):
        self.stale = stale_after_ms * 1000

    def load(self, key, text):
        return Scope.load(text)

    def apply(self, scope, batch):
        turn = [1 if snapshot else 0 if reason in POLICY_ENDS else 2 for snapshot, reason in zip(batch["is_snapshot"], batch["policy_id"])]
        for r in batch.assign(turn=turn).sort_values(["t", "turn"], kind="stable").itertuples():
            scope.sweep(int(r.t), self.stale, inclusive=False)
            if not r.is_snapshot:
                scope.end(int(r.t), r.policy_id)  # a command row carries its reason here
                continue
            timers = [int(x) * 1000 for x in (r.trigger_for_ms, r.clear_for_ms, r.cooldown_ms, r.hold_down_ms, r.event_update_ms)]
            matched = json.loads(r.crossed) if r.crossed else []
            scope.snapshot(int(r.t), bool(r.over), bool(r.below), matched, (r.policy_id, int(r.policy_version), *timers), r.payload)
        return scope.drain()

    def due(self, scope):
        # One millisecond on, because a snapshot exactly at the mark still counts.
        return (scope.last_snapshot + self.stale) // 1000 + 1 if scope.last_snapshot is not None else None

    def expire(self, scope, now_ms):
        scope.sweep(now_ms * 1000, self.stale)
        # Quiet for so long a scope is idle, whatever it was: nothing of it is
        # kept. Rows older than its newest one are below the watermark by now.
        scope.forgotten = scope.state == "idle" and (scope.last_snapshot is None or now_ms * 1000 >= scope.last_snapshot + self.stale)
        return scope.drain()

    def dump(self, scope):
        return None if getattr(scope, "forgotten", False) else scope.dump()


class Known(dict):
    """Detections of an incident: those of this batch, and a test for the stored ones."""

    def __init__(self, stored: Callable[[str], bool], fresh=()):
        super().__init__(fresh)
        self.stored = stored

    def __contains__(self, detection) -> bool:
        return super().__contains__(detection) or self.stored(detection)


class CaseAdapter:
    """Correlation keys: rows of ``case_rows``. The detections an incident knows are kept apart, by incident."""

    COLUMNS = ["t", "at_sequence", "at_id", "is_event", "repeat", "body"]

    def __init__(self, policy: CasePolicy):
        self.policy = policy

    def load(self, key, text):
        case = Case.load(key[0], self.policy, text)
        for incident in case.incidents:
            incident.setdefault("detections", {})
        return case

    def attach(self, case, known):
        for incident in case.incidents:
            owner = incident["incident_id"]
            incident["detections"] = Known(lambda detection, owner=owner: known(owner, detection), incident["detections"])

    def owners(self, case):
        return {incident["incident_id"] for incident in case.incidents}

    def members(self, case):
        return [(incident["incident_id"], detection) for incident in case.incidents for detection in incident["detections"]]

    def apply(self, case, batch):
        batch["at_sequence"] = [-1 if s is None else int(s) for s in batch["at_sequence"]]
        for r in batch.sort_values(["t", "at_sequence", "at_id"], kind="stable").itertuples():
            facts = json.loads(r.body)
            if r.is_event:
                facts["metrics"] = facts.get("metrics") or []
                case.event(int(r.t), facts, bool(r.repeat))
            else:
                case.command(int(r.t), {name: facts.get(name) for name in COMMAND_FACTS})
        return self._with_snapshots(case)

    def expire(self, case, now_ms):
        case.advance(now_ms * 1000)
        return self._with_snapshots(case)

    def _with_snapshots(self, case):
        """The log rows, and the current version of every incident they touched."""
        touched = {r[3] for r in case.out if r[3]}
        for incident in case.incidents:
            if incident["incident_id"] in touched:
                case._final(incident)
        # Ended incidents that no later row can reach leave the state, and so do
        # the keys of repeats, which a stream drops before they come here.
        case.forget(keep_all=False)
        case.unlinked.clear()
        return case.drain()

    def due(self, case):
        timer = case._next_timer()
        return -(-timer[0] // 1000) if timer else None

    def dump(self, case):
        held = Case(case.key, case.policy, [{k: v for k, v in incident.items() if k != "detections"} for incident in case.incidents])
        held.unlinked, held.order = case.unlinked, case.order
        return held.dump()


class RepeatAdapter:
    """Repeats of one (channel, incident, event): rows of ``message_rows``."""

    COLUMNS = ["t", "message_id"]

    def __init__(self, window_us: int):
        self.window = window_us

    def load(self, key, text):
        folder = Repeats(self.window)
        folder.sent = int(text) if text else None
        return folder

    def apply(self, folder, batch):
        ordered = batch.sort_values(["t", "message_id"], kind="stable")
        return [row for t, m in zip(ordered["t"], ordered["message_id"]) for row in folder.row(int(t), m)]

    def due(self, folder):
        return (folder.sent + self.window) // 1000 + 1

    def expire(self, folder, now_ms):
        if folder.sent is not None and now_ms * 1000 >= folder.sent + self.window:
            folder.sent = None  # the next one is sent whatever was before
        return []

    def dump(self, folder):
        return None if folder.sent is None else str(folder.sent)


class BucketAdapter:
    """The token bucket of one channel: rows of ``message_rows``."""

    COLUMNS = ["t", "message_id"]

    def __init__(self, per_minute: int):
        self.per_minute = per_minute

    def load(self, key, text):
        folder = Bucket(self.per_minute)
        if text:
            folder.tokens, folder.last = json.loads(text)
        return folder

    apply = RepeatAdapter.apply

    def due(self, folder):
        return (folder.last + 60_000_000) // 1000 + 1

    def expire(self, folder, now_ms):
        if folder.last is not None and now_ms * 1000 >= folder.last + 60_000_000:
            folder.last = None  # full again
        return []

    def dump(self, folder):
        return None if folder.last is None else json.dumps([folder.tokens, folder.last])


class DeliveryAdapter:
    """Repeats and the bucket of one channel together: rows of ``message_rows``."""

    COLUMNS = ["t", "message_id", "incident_id", "event_type"]

    def __init__(self, window_us: int, per_minute: int):
        self.window, self.per_minute = window_us, per_minute

    def load(self, key, text):
        folder = Delivery(self.window, self.per_minute)
        if text:
            held = json.loads(text)
            folder.bucket.tokens, folder.bucket.last = held["bucket"]
            folder.sent = {(incident, event): t for incident, event, t in held["sent"]}
        return folder

    def apply(self, folder, batch):
        ordered = batch.sort_values(["t", "message_id"], kind="stable")
        out = [row for t, *facts in ordered[self.COLUMNS].itertuples(index=False) for row in folder.row(int(t), *facts)]
        self._forget(folder, int(ordered["t"].iloc[-1]))
        return out

    def _forget(self, folder, now):
        folder.sent = {key: t for key, t in folder.sent.items() if now - t < self.window}
        if folder.bucket.last is not None and now >= folder.bucket.last + 60_000_000:
            folder.bucket.tokens, folder.bucket.last = folder.bucket.full, None

    def due(self, folder):
        moments = [t + self.window for t in folder.sent.values()] + ([folder.bucket.last + 60_000_000] if folder.bucket.last is not None else [])
        return max(moments) // 1000 + 1 if moments else None

    def expire(self, folder, now_ms):
        self._forget(folder, now_ms * 1000)
        return []

    def dump(self, folder):
        if not folder.sent and folder.bucket.last is None:
            return None
        sent = [[*key, t] for key, t in folder.sent.items()]
        return json.dumps({"bucket": [folder.bucket.tokens, folder.bucket.last], "sent": sent}, default=lambda x: x.item())
