"""The life of the incidents of one correlation key, as a small state object.

Rows arrive in decision-time order; times are microseconds. Before a row at
time t every timer due by t has fired, in the order silent, recovered, closed.

    detection event                               outcome
    an incident is active                         updated (an ended event also starts recovery)
    newest resolved or closed incident, and
      the event ended or its detection is held    linked_late
      within the reopen window                    reopened
    nothing to attach to, event ended             quarantined
    otherwise                                     created
"""

from __future__ import annotations

import hashlib
import json
from dataclasses import dataclass
from json.encoder import encode_basestring_ascii

from ..functions.vocab import (
    AUTOMATIC_EDGES, CATEGORY_FAMILIES, CATEGORY_LADDER, INCIDENT_ACTIVE, MANY_FAMILIES, NO_CATEGORY, OPERATOR_EDGES, PRIORITIES, SEVERITIES,
)

SECOND = 1_000_000
MINUTE = 60 * SECOND

END_CAUSES = {"stale": "detector_stale", "policyWithdrawn": "policy_withdrawn", "manualReset": "detector_reset"}
# What a verb's arguments must be: "text" and "words" (not blank) are texts, "count" a whole number above 0,
# "index" one from 0, the others a word of their vocabulary; "?" may be missing.
ARGUMENTS = {
    "acknowledge": {}, "begin_investigation": {}, "mark_monitoring": {}, "resolve": {"note": "text?"}, "close": {"reason": "text?"}, "reopen": {"reason": "text?"},
    "suppress": {"reason": "words", "duration_s": "count"}, "unsuppress": {}, "assign": {"assignee": "words"}, "unassign": {},
    "change_severity": {"severity": "severity", "reason": "text?"}, "change_priority": {"priority": "priority"},
    "add_note": {"body": "words", "visibility": "text?"}, "edit_note": {"note_index": "index", "body": "words"}, "redact_note": {"note_index": "index", "reason": "text?"},
    "add_tag": {"key": "words", "value": "text"}, "remove_tag": {"key": "words"},
    "open_manual": {"title": "words", "severity": "severity", "priority": "priority?", "description": "text?"},
}


def _as_json(value) -> str:
    """What ``json.dumps`` gives, which sets up a whole encoder for each of the many small bodies."""
    kind = type(value)
    if kind is str:
        return encode_basestring_ascii(value)
    if kind is int:
        return int.__repr__(value)
    if kind is dict:
        return "{" + ", ".join([f"{encode_basestring_ascii(name)}: {_as_json(inner)}" for name, inner in value.items()]) + "}"
    if kind is list:
        return "[" + ", ".join([_as_json(inner) for inner in value]) + "]"
    return "null" if value is None else json.dumps(value)


def _whole(value, least: int) -> bool:
    return isinstance(value, int) and not isinstance(value, bool) and least <= value <= 1 << 40


FITS = {
    "text": lambda value: isinstance(value, str), "words": lambda value: isinstance(value, str) and bool(value.strip()),
    "count": lambda value: _whole(value, 1), "index": lambda value: _whole(value, 0),
    "severity": lambda value: isinstance(value, str) and value in SEVERITIES, "priority": lambda value: isinstance(value, str) and value in PRIORITIES.values(),
}
DERIVED = {"acknowledge": "acknowledged", "begin_investigation": "investigating", "mark_monitoring": "monitoring"}


@dataclass(frozen=True)
class CasePolicy:
    """Timers in microseconds; None switches a timer off. Bounds default to none.

    ``evidence_max`` bounds how many links count as retained, never which
    detections an incident knows, so it changes no decision.
    """

    reopen_window: int = 15 * MINUTE
    silent_after: int | None = 5 * MINUTE
    recovery_confirmation: int | None = 5 * MINUTE
    closure_delay: int | None = 30 * MINUTE
    close_critical: bool = False
    abort_on_event: bool = False
    evidence_max: int | None = None
    policy_refs_max: int | None = None
    tags_max: int | None = None
    title_max: int | None = None

    def settled_after(self) -> int | None:
        """After so long without a row, a key's next detection certainly opens anew."""
        if self.silent_after is None or self.recovery_confirmation is None:
            return None
        return self.silent_after + self.recovery_confirmation + (self.closure_delay or 0) + self.reopen_window


def category_of(metrics) -> str:
    """From the union of matched metrics."""
    seen = set(metrics)
    if sum(not seen.isdisjoint(family) for family in CATEGORY_FAMILIES) >= 2:
        return MANY_FAMILIES
    return next((name for name, members in CATEGORY_LADDER if not seen.isdisjoint(members)), NO_CATEGORY)


def _below(n: int, bound: int | None) -> bool:
    return bound is None or n < bound


class Refused(Exception):
    """A command the current state does not allow; the text is its result code."""


def arguments(verb, text: str | None) -> dict:
    """The arguments of a command, as its verb takes them; further ones are left out."""
    try:
        given = json.loads(text) if text else {}
    except (ValueError, RecursionError):
        given = None
    if not isinstance(given, dict):
        raise Refused("validation_error")
    out = {}
    for name, kind in ARGUMENTS.get(verb, {}).items():
        value = given.get(name)
        if not (kind.endswith("?") and value is None) and not FITS[kind.rstrip("?")](value):
            raise Refused("validation_error")
        out[name] = value
    return out


class Case:
    """All incidents of one correlation key."""

    def __init__(self, key: str, policy: CasePolicy, incidents: list[dict] | None = None):
        self.key, self.policy = key, policy
        self.incidents: list[dict] = incidents or []
        self.unlinked: set[str] = set()
        self.out: list[tuple] = []
        self.order = 0

    def dump(self) -> str:
        return json.dumps({"incidents": self.incidents, "unlinked": sorted(self.unlinked), "order": self.order})

    @classmethod
    def load(cls, key: str, policy: CasePolicy, text: str | None) -> "Case":
        case = cls(key, policy)
        if text:
            held = json.loads(text)
            case.incidents, case.unlinked, case.order = held["incidents"], set(held["unlinked"]), held["order"]
        return case

    def drain(self) -> list[tuple]:
        out, self.out = self.out, []
        return out

    # --- writing -----------------------------------------------------------

    def _emit(self, record, t, incident, ref, **body):
        self.order += 1
        incident_id = incident["incident_id"] if incident else None
        text = json.dumps(body) if record == "incident" else _as_json(body)
        self.out.append((record, t, self.order, incident_id, ref, text))

    def _timeline(self, t, incident, entry, actor="system", **payload):
        incident["timeline_entries"] += 1
        self._emit("timeline", t, incident, entry, actor=actor, payload=payload)

    def _outbox(self, t, incident, event_type, **payload):
        self._emit("outbox", t, incident, event_type, version=incident["version"], severity=incident["severity"], payload=payload)

    def _touch(self, t, incident):
        incident["version"] += 1
        incident["last_updated_at"] = t

    def _set_state(self, t, incident, to, cause, actor="system"):
        before, incident["state"] = incident["state"], to
        self._touch(t, incident)
        self._timeline(t, incident, "state_changed", actor, **{"from": before, "to": to, "cause": cause})

    # --- lookups -----------------------------------------------------------

    @property
    def active(self) -> dict | None:
        return next((i for i in self.incidents if i["state"] not in ("resolved", "closed")), None)

    def _newest_past(self) -> dict | None:
        past = [i for i in self.incidents if i["state"] in ("resolved", "closed")]
        when = lambda i: i["resolved_at"] if i["state"] == "resolved" else i["closed_at"]
        return min(past, key=lambda i: (-when(i), i["incident_id"]), default=None)

    # --- timers ------------------------------------------------------------

    def _next_timer(self):
        due = []
        p = self.policy
        for incident in self.incidents:
            state = incident["state"]
            if state in INCIDENT_ACTIVE and p.silent_after is not None:
                due.append((incident["last_detected_at"] + p.silent_after, 0, incident))
            elif state == "recovering" and p.recovery_confirmation is not None:
                due.append((incident["recovering_since"] + p.recovery_confirmation, 1, incident))
            elif state == "resolved" and self._closes_by_itself(incident):
                due.append((incident["resolved_at"] + p.closure_delay, 2, incident))
        return min(due, key=lambda d: d[:2], default=None)

    def _closes_by_itself(self, incident) -> bool:
        critical = incident["ever_critical"] or incident["severity"] == "critical"
        return self.policy.closure_delay is not None and (self.policy.close_critical or not critical)

    def advance(self, now: int):
        """Fire the timers due by ``now``. A timer set in the past fires when first looked at."""
        while (timer := self._next_timer()) is not None and timer[0] <= now:
            at, step, incident = timer
            at = max(at, incident["last_updated_at"])
            if step == 0:
                self._recover(at, incident, "detector_silent")
            elif step == 1:
                self._resolve(at, incident, "recovery_confirmed")
            else:
                self._close(at, incident, "resolved", "automatic_closure")

    def _recover(self, t, incident, cause):
        incident["state_before_recovering"], incident["recovering_since"] = incident["state"], t
        self._set_state(t, incident, "recovering", cause)
        self._outbox(t, incident, "incident.recovering")

    def _resolve(self, t, incident, cause, actor="system"):
        incident.update(resolved_at=t, recovering_since=None, state_before_recovering=None)
        self._set_state(t, incident, "resolved", cause, actor)
        self._outbox(t, incident, "incident.resolved")

    def _close(self, t, incident, reason, cause, actor="system"):
        incident.update(closed_at=t, closure_reason=reason)
        self._set_state(t, incident, "closed", cause, actor)
        self._outbox(t, incident, "incident.closed")

    # --- detection events --------------------------------------------------

    def event(self, t, e, repeat=False):
        """Correlate one publishable event; ``repeat`` marks a key delivered before."""
        self.advance(t)
        if repeat and e["dedup_key"] not in self.unlinked:
            self._emit("outcome", t, None, e["event_id"], outcome="duplicate")
            return
        self.unlinked.discard(e["dedup_key"])
        ended = e["kind"] == "ended"
        incident = self.active
        if incident is not None:
            self._link(t, incident, e, late=False)
            if ended and incident["state"] in INCIDENT_ACTIVE:
                self._recover(t, incident, END_CAUSES.get(e["reason"], "traffic_cleared"))
            elif not ended and self.policy.abort_on_event and incident["state"] == "recovering":
                back = incident["state_before_recovering"]
                incident.update(recovering_since=None, state_before_recovering=None)
                self._set_state(t, incident, back, "recovery_aborted")
            return
        past = self._newest_past()
        if past is not None:
            if ended or e["detection_id"] in past["detections"]:
                self._link(t, past, e, late=True)
                return
            since = past["resolved_at"] if past["state"] == "resolved" else past["closed_at"]
            if self.policy.reopen_window and t - since <= self.policy.reopen_window:
                self._reopen(t, past, e)
                return
        if ended:
            self.unlinked.add(e["dedup_key"])
            self._emit("outcome", t, None, e["event_id"], outcome="quarantined")
            return
        self._create(t, e)

    def _evidence(self, t, incident, e, link_type):
        incident["evidence_observed"] += 1
        if _below(incident["evidence_retained"], self.policy.evidence_max):
            incident["evidence_retained"] += 1
        incident["detections"][e["detection_id"]] = True
        self._emit("link", t, incident, e["event_id"], link_type=link_type, detection_id=e["detection_id"],
                   dedup_key=e["dedup_key"], metrics=e["metrics"])

    def _fresh(self, t, opener, title, severity, priority=None, source="detection", created_by="system", description=None):
        name = hashlib.sha256(f"{self.key}|{t}|{opener}".encode()).hexdigest()[:32]
        incident = {
            "incident_id": name, "state": "open", "version": 1, "title": title[: self.policy.title_max], "description": description,
            "severity": severity, "severity_source": source, "ever_critical": severity == "critical",
            "maximum_detected_severity": severity, "priority": priority or PRIORITIES[severity], "category": "unclassified",
            "metrics": [], "created_by": created_by, "first_detected_at": t, "opened_at": t, "last_detected_at": t, "last_updated_at": t,
            "acknowledged_at": None, "recovering_since": None, "resolved_at": None, "closed_at": None, "reopened_at": None,
            "reopen_count": 0, "closure_reason": None, "state_before_recovering": None, "suppressed_until": None,
            "suppression_reason": None, "assignee": None, "evidence_observed": 0, "evidence_retained": 0, "detections": {},
            "policy_refs": [], "policy_refs_omitted": 0, "notes": [], "tags": {}, "timeline_entries": 0,
        }
        self.incidents.append(incident)
        self._timeline(t, incident, "opened", created_by)
        return incident

    def _create(self, t, e):
        incident = self._fresh(t, e["event_id"], e["summary"], e["severity"])
        incident["metrics"] = sorted(set(e["metrics"]))
        incident["category"] = category_of(incident["metrics"])
        incident["policy_refs"] = [self._policy_ref(e)]
        self._evidence(t, incident, e, "opening")
        self._timeline(t, incident, "event_linked", event_id=e["event_id"])
        self._outbox(t, incident, "incident.opened")
        self._emit("outcome", t, incident, e["event_id"], outcome="created")

    @staticmethod
    def _policy_ref(e):
        return {"policy_id": e["policy_id"], "policy_version": e["policy_version"], "first_seen": e["sequence"], "last_seen": e["sequence"]}

    def _note_policy(self, incident, e):
        ref = next((r for r in incident["policy_refs"] if r["policy_id"] == e["policy_id"]), None)
        if ref is None:
            if _below(len(incident["policy_refs"]), self.policy.policy_refs_max):
                incident["policy_refs"].append(self._policy_ref(e))
            else:
                incident["policy_refs_omitted"] += 1
            return
        if e["sequence"] >= ref["last_seen"]:
            ref.update(last_seen=e["sequence"], policy_version=e["policy_version"])
        ref["first_seen"] = min(ref["first_seen"], e["sequence"])

    def _grow(self, incident, e):
        incident["metrics"] = sorted({*incident["metrics"], *e["metrics"]})
        before, incident["category"] = incident["category"], category_of(incident["metrics"])
        return before

    def _link(self, t, incident, e, late):
        late = late or t < incident["last_detected_at"]
        before = self._grow(incident, e)
        self._note_policy(incident, e)
        if not late:
            incident["last_detected_at"] = t
        self._touch(t, incident)
        self._evidence(t, incident, e, "late" if late else "update")
        self._timeline(t, incident, "late_event_linked" if late else "event_linked", event_id=e["event_id"])
        if before != incident["category"]:
            self._timeline(t, incident, "category_changed", **{"from": before, "to": incident["category"]})
        self._outbox(t, incident, "incident.updated")
        self._emit("outcome", t, incident, e["event_id"], outcome="linked_late" if late else "updated")

    def _back_to_open(self, t, incident, cause, actor="system", reason=None):
        incident.update(reopen_count=incident["reopen_count"] + 1, reopened_at=t, closure_reason=None, resolved_at=None, closed_at=None)
        self._set_state(t, incident, "open", cause, actor)
        self._timeline(t, incident, "reopened", actor, reopen_count=incident["reopen_count"], reason=reason)

    def _reopen(self, t, incident, e):
        incident["last_detected_at"] = t
        self._grow(incident, e)
        self._evidence(t, incident, e, "opening")
        self._back_to_open(t, incident, "reopened_by_recurrence")
        self._outbox(t, incident, "incident.reopened", reopen_count=incident["reopen_count"])
        self._emit("outcome", t, incident, e["event_id"], outcome="reopened")

    # --- operator commands -------------------------------------------------

    def command(self, t, c):
        """Apply one command row in order; the result is a record, never an exception.

        A command whose arguments are no JSON object, or not what its verb takes, is
        refused with ``validation_error`` whatever it addresses.
        """
        self.advance(t)
        incident = None
        try:
            args = arguments(c["verb"], c["args"])
            if c["verb"] == "open_manual":
                incident = self._open_manual(t, c, args)
            else:
                incident = self._addressed(c)
                if c["expected_version"] is not None and c["expected_version"] != incident["version"]:
                    raise Refused("version_conflict")
                self._apply(t, incident, c["verb"], args, c["actor"] or "operator")
            result = "applied"
        except Refused as refusal:
            result = str(refusal)
        version = incident["version"] if incident else None
        self._emit("command", t, incident, c["command_id"], verb=c["verb"], result=result, version=version)

    def _addressed(self, c):
        if c["incident_id"]:
            found = next((i for i in self.incidents if i["incident_id"] == c["incident_id"]), None)
        else:
            found = self.active or self._newest_past()
        if found is None:
            raise Refused("not_found")
        return found

    def _open_manual(self, t, c, args):
        if self.active is not None:
            raise Refused("duplicate_active_incident")
        incident = self._fresh(t, c["command_id"], args["title"], args["severity"], args.get("priority"), "operator",
                               c["actor"] or "operator", args.get("description"))
        self._outbox(t, incident, "incident.opened")
        return incident

    def _apply(self, t, incident, verb, args, actor):
        if verb in DERIVED or verb in ("resolve", "close", "reopen"):
            self._operator_move(t, incident, verb, args, actor)
            return
        effect = getattr(self, f"_do_{verb}", None)
        if effect is None:
            raise Refused("unknown_command")
        entry, event, payload = effect(t, incident, args, actor)
        self._touch(t, incident)
        self._timeline(t, incident, entry, actor, **payload)
        if event:
            self._outbox(t, incident, event)

    def _operator_move(self, t, incident, verb, args, actor):
        to = {"resolve": "resolved", "close": "closed", "reopen": "open"}.get(verb) or DERIVED[verb]
        if incident["state"] == to and verb not in ("close", "reopen"):
            raise Refused("state_unchanged")
        if (incident["state"], to) not in OPERATOR_EDGES:
            raise Refused("invalid_transition")
        if verb == "reopen":
            if self.active is not None:
                raise Refused("open_incident_already_exists")
            self._back_to_open(t, incident, "reopen", actor, args.get("reason"))
        elif verb == "resolve":
            self._resolve(t, incident, "resolve", actor)
            if args.get("note"):
                self._add_note(t, incident, args["note"], actor)
        elif verb == "close":
            self._close(t, incident, args["reason"] or "resolved", "close", actor)
        else:
            if to == "acknowledged":
                incident["acknowledged_at"] = t
            self._set_state(t, incident, to, verb, actor)

    def _do_suppress(self, t, incident, args, actor):
        incident.update(suppressed_until=t + args["duration_s"] * SECOND, suppression_reason=args["reason"])
        return "suppressed", "incident.suppression_changed", {"reason": args["reason"]}

    def _do_unsuppress(self, t, incident, args, actor):
        incident.update(suppressed_until=None, suppression_reason=None)
        return "unsuppressed", "incident.suppression_changed", {}

    def _do_assign(self, t, incident, args, actor):
        before, incident["assignee"] = incident["assignee"], args.get("assignee")
        return "assignment_changed", "incident.assignment_changed", {"from": before, "to": incident["assignee"]}

    def _do_unassign(self, t, incident, args, actor):
        return self._do_assign(t, incident, {}, actor)

    def _do_change_severity(self, t, incident, args, actor):
        to, before = args["severity"], incident["severity"]
        if SEVERITIES.index(to) < SEVERITIES.index(before) and not args["reason"]:
            raise Refused("validation_error")
        incident.update(severity=to, severity_source="operator", ever_critical=incident["ever_critical"] or to == "critical")
        return "severity_changed", "incident.severity_changed", {"from": before, "to": to, "reason": args.get("reason")}

    def _do_change_priority(self, t, incident, args, actor):
        before, incident["priority"] = incident["priority"], args["priority"]
        return "priority_changed", "incident.priority_changed", {"from": before, "to": args["priority"]}

    def _add_note(self, t, incident, body, actor, supersedes=None):
        index = len(incident["notes"])
        incident["notes"].append({"note_index": index, "body": body, "author": actor, "supersedes": supersedes, "redacted": False})
        return index

    def _do_add_note(self, t, incident, args, actor):
        if args["visibility"] == "customer_visible":
            raise Refused("validation_error")
        return "note_added", None, {"note_index": self._add_note(t, incident, args["body"], actor)}

    def _note_at(self, incident, args):
        index = args["note_index"]
        if index >= len(incident["notes"]):
            raise Refused("not_found")
        return incident["notes"][index]

    def _do_edit_note(self, t, incident, args, actor):
        note = self._note_at(incident, args)
        replaced = any(n["supersedes"] == note["note_index"] for n in incident["notes"])
        if note["redacted"] or replaced:
            raise Refused("validation_error")
        index = self._add_note(t, incident, args["body"], actor, note["note_index"])
        return "note_superseded", None, {"note_index": index, "supersedes": note["note_index"]}

    def _do_redact_note(self, t, incident, args, actor):
        note = self._note_at(incident, args)
        if note["redacted"]:
            raise Refused("validation_error")
        note.update(body="", redacted=True)
        return "note_redacted", None, {"note_index": note["note_index"], "reason": args.get("reason")}

    def _do_add_tag(self, t, incident, args, actor):
        if args["key"] not in incident["tags"] and not _below(len(incident["tags"]), self.policy.tags_max):
            raise Refused("capacity_exceeded")
        incident["tags"][args["key"]] = args["value"]
        return "tag_added", None, {"key": args["key"], "value": args["value"]}

    def _do_remove_tag(self, t, incident, args, actor):
        incident["tags"].pop(args["key"], None)
        return "tag_removed", None, {"key": args["key"]}

    # --- end ---------------------------------------------------------------

    def forget(self, keep_all: bool):
        """Hand over ended incidents no later row can reach, so that memory stays flat."""
        if keep_all or len(self.incidents) < 2:
            return
        reachable = self._newest_past()
        waiting = {id(i) for i in self.incidents if i["state"] == "resolved" and self._closes_by_itself(i)}
        for incident in list(self.incidents):
            ended = incident["state"] in ("resolved", "closed")
            if ended and incident is not reachable and id(incident) not in waiting:
                self._final(incident)
                self.incidents.remove(incident)

    def _final(self, incident):
        shown = {k: v for k, v in incident.items() if k != "detections"}
        self._emit("incident", incident["last_updated_at"], incident, None, **shown)

    def finish(self):
        for incident in self.incidents:
            self._final(incident)


assert set(DERIVED.values()) <= {to for _, to in OPERATOR_EDGES} and ("recovering", "resolved") in AUTOMATIC_EDGES
