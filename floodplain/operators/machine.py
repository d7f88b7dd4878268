"""The hysteresis rules of one scope, as a small state object.

The same object is driven from batch (rows in time order) and from a stream
(state restored per key). All times are microseconds.

Within one snapshot the order is: policy change, cooldown expiry, evaluation,
paced update. So one snapshot may make two transitions.

    state           on                                          to
    idle            over                                        pendingTrigger, or active when triggerFor is 0
    pendingTrigger  over for triggerFor                         active (event: started)
    pendingTrigger  not over                                    idle
    active          all below clear, open for holdDown          pendingClear, or closed when clearFor is 0
    active          all below clear, open for less              stays (suppressed: holdDown)
    pendingClear    all below clear for clearFor                cooldown, or idle when cooldown is 0 (event: ended)
    pendingClear    anything not below clear                    active
    cooldown        cooldown elapsed                            idle, then evaluated
    cooldown        over                                        stays (suppressed: cooldown)
    open            over, no event this step, update due        stays (event: updated)
    not idle        quiet for stale_after                       idle (event: ended when open)
"""

from __future__ import annotations

import json

OPEN = ("active", "pendingClear")
RECORD = ["record", "t", "from_state", "to_state", "reason", "kind", "sequence", "started", "peak", "snapshots",
          "in_previous", "policy_id", "policy_version", "closing", "payload"]


class Scope:
    """State of one scope between snapshots."""

    FIELDS = ("state", "entered", "since", "last_snapshot", "last_event", "peak", "snapshots", "events", "policy_id",
              "policy_version", "payload")

    def __init__(self):
        self.state = "idle"
        self.entered = self.since = self.last_snapshot = self.last_event = None
        self.peak: list[dict] = []
        self.snapshots = self.events = 0
        self.policy_id = self.policy_version = self.payload = None
        self.out: list[tuple] = []

    @classmethod
    def load(cls, text: str | None) -> "Scope":
        scope = cls()
        if text:
            for name, value in json.loads(text).items():
                setattr(scope, name, value)
        return scope

    def dump(self) -> str:
        return json.dumps({name: getattr(self, name) for name in self.FIELDS})

    def drain(self) -> list[tuple]:
        out, self.out = self.out, []
        return out

    @property
    def is_open(self) -> bool:
        return self.state in OPEN

    # --- moves -------------------------------------------------------------

    def _emit(self, record, t, before, reason, **more):
        row = dict.fromkeys(RECORD)
        row.update(record=record, t=t, from_state=before, to_state=self.state, reason=reason,
                   policy_id=self.policy_id, policy_version=self.policy_version, closing=False, **more)
        self.out.append(tuple(row[name] for name in RECORD))

    def _move(self, to: str, reason: str, t: int, kind: str | None = None, payload=None, closing=False):
        """One transition, and the event it makes, if any."""
        before, since = self.state, self.since
        # Idle time is not told: idle rows without a crossing never reach the fold.
        spent = None if before == "idle" else t - self.entered
        self.state, self.entered = to, t
        if to == "active" and since is None:
            self.since, self.snapshots, self.events, self.peak = t, 0, 0, []
        elif to in ("idle", "cooldown"):
            self.since = None
        self._emit("transition", t, before, reason, in_previous=spent)
        if kind == "ended" and since is not None:
            self._signal(kind, t, before, reason, since, spent, payload, closing)
        return before, spent

    def _signal(self, kind, t, before, reason, started, spent, payload, closing=False):
        sequence, self.events = self.events, self.events + 1
        row = dict.fromkeys(RECORD)
        row.update(record="event", t=t, from_state=before, to_state=self.state, reason=reason, kind=kind, sequence=sequence,
                   started=started, peak=json.dumps(self.peak), snapshots=self.snapshots, in_previous=spent,
                   policy_id=self.policy_id, policy_version=self.policy_version, closing=closing, payload=payload)
        self.out.append(tuple(row[name] for name in RECORD))

    def _raise_peaks(self, matched: list[dict]):
        held = {p["metric"]: i for i, p in enumerate(self.peak)}
        for reason in matched:
            at = held.get(reason["metric"])
            if at is None:
                self.peak.append(reason)
            elif reason["observed"] > self.peak[at]["observed"]:
                self.peak[at] = reason

    def _open(self, reason, t, matched, payload):
        before, spent = self._move("active", reason, t)
        self._raise_peaks(matched)
        self.last_event = t
        self._signal("started", t, before, reason, self.since, spent, payload)

    # --- inputs ------------------------------------------------------------

    def snapshot(self, t, over, below, matched, policy, payload):
        """Apply one evaluated snapshot. ``policy`` is (id, version, five timers)."""
        if self.last_snapshot is not None and t <= self.last_snapshot:
            self._emit("ignored", t, self.state, "duplicate" if t == self.last_snapshot else "outOfOrder")
            return
        policy_id, version, trigger_for, clear_for, cooldown, hold_down, update_every = policy
        signalled = False
        if self.policy_id is None:
            self.policy_id, self.policy_version, self.entered = policy_id, version, t
        elif (self.policy_id, self.policy_version) != (policy_id, version):
            if self.state != "idle":
                signalled = self.is_open
                self._move("idle", "policyChanged", t, "ended", payload)
            self.policy_id, self.policy_version = policy_id, version
            self.last_event, self.peak = None, []
        self.last_snapshot, self.payload = t, payload

        if self.state == "cooldown" and t - self.entered >= cooldown:
            self._move("idle", "cooldownExpired", t)
        if self.is_open:
            self.snapshots += 1
            self._raise_peaks(matched)

        if self.state == "idle":
            if over and trigger_for == 0:
                self._open("thresholdCrossed", t, matched, payload)
                signalled = True
            elif over:
                self._move("pendingTrigger", "thresholdCrossed", t)
        elif self.state == "pendingTrigger":
            if not over:
                self._move("idle", "triggerAborted", t)
            elif t - self.entered >= trigger_for:
                self._open("triggerSustained", t, matched, payload)
                signalled = True
        elif self.state == "active":
            if below and t - self.since < hold_down:
                self._emit("suppressed", t, self.state, "holdDown")
            elif below and clear_for == 0:
                self._close(t, cooldown, payload)
                signalled = True
            elif below:
                self._move("pendingClear", "fellBelowClear", t)
        elif self.state == "pendingClear":
            if not below:
                self._move("active", "clearAborted", t)
            elif t - self.entered >= clear_for:
                self._close(t, cooldown, payload)
                signalled = True
        elif over:
            self._emit("suppressed", t, self.state, "cooldown")

        due = self.last_event is None or t - self.last_event >= update_every
        if self.is_open and over and not signalled and due:
            self.last_event = t
            self._signal("updated", t, self.state, "stillActive", self.since, t - self.entered, payload)

    def _close(self, t, cooldown, payload):
        self.last_event = t
        self._move("cooldown" if cooldown else "idle", "clearSustained", t, "ended", payload)

    def sweep(self, now: int, stale_after: int, inclusive: bool = True):
        """Close a scope whose snapshots stopped, at the moment it became stale.

        A snapshot exactly ``stale_after`` later still counts, so a later row
        sweeps exclusively; the clock itself sweeps inclusively.
        """
        if self.state == "idle" or self.last_snapshot is None:
            return
        due = self.last_snapshot + stale_after
        if now > due or (inclusive and now == due):
            self._move("idle", "stale", due, "ended", self.payload, closing=True)

    def end(self, t: int, reason: str):
        """Close by hand or because the policy went away; an idle scope has nothing to close."""
        self.last_event = t
        if self.state != "idle":
            self._move("idle", reason, t, "ended", self.payload, closing=True)

    def final(self):
        if self.last_snapshot is not None:
            self._emit("final", self.last_snapshot, self.state, None, started=self.since)
