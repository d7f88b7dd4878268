"""Who is told what: routing, repeat suppression, rate limits, rendering, results."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from ..functions.vocab import severity_rank
from .folds import ordered_fold
from .joins import lookup_join

DEDUP_SECONDS, PER_MINUTE = 300, 30
# How severe a change counts; any other is minor.
CHANGES_CRITICAL = ["mitigation.failed", "mitigation.kill_switch_engaged", "bgp.peer_down"]
CHANGES_MAJOR = ["mitigation.proposed", "mitigation.requested", "mitigation.active", "mitigation.kill_switch_released"]


def route_notifications(outbox: DataFrame, incidents: DataFrame, routes: DataFrame) -> DataFrame:
    """One row per message and channel, each channel once.

    Outbox: outbox_id, tenant, incident_id, event_type. An incident that is gone
    has nobody to tell. Routes: tenant, events[], min_severity?, channels[]. A
    severity outside the vocabulary fails where a minimum is set.
    """
    known = outbox.join(incidents.select("incident_id", "severity"), "incident_id", "inner")
    each = routes.select(F.col("tenant"), F.explode(F.array_distinct("events")).alias("event_type"), "min_severity", "channels")
    matched = lookup_join(known, each, ["tenant", "event_type"], "inner", salt_from=["outbox_id"])
    enough = F.col("min_severity").isNull() | F.coalesce(
        severity_rank(F.col("severity")) >= severity_rank(F.col("min_severity")), F.lit(False))
    told = matched.where(enough).select(*known.columns, F.explode("channels").alias("channel"))
    return told.dropDuplicates(["outbox_id", "channel"])


def change_severity(event_type: Column, payload: Column) -> Column:
    """The fixed severity of a mitigation's, the kill switch's or a peer's change."""
    killed = (event_type == "mitigation.withdrawn") & F.coalesce(F.get_json_object(payload, "$.withdrawal_cause") == "kill_switch", F.lit(False))
    return F.when(event_type.isin(*CHANGES_CRITICAL), "critical").when(event_type.isin(*CHANGES_MAJOR) | killed, "major").otherwise("minor")


def route_changes(outbox: DataFrame, routes: DataFrame) -> DataFrame:
    """As ``route_notifications`` for changes that are no incident's own.

    Outbox: outbox_id, tenant, event_type, payload (JSON). The severity follows
    from the kind of change; ``incident_id`` is the payload's, if it names one.
    """
    known = outbox.withColumn("severity", change_severity(F.col("event_type"), F.col("payload"))).withColumn("incident_id", F.get_json_object("payload", "$.incident_id"))
    each = routes.select("tenant", F.explode(F.array_distinct("events")).alias("event_type"), "min_severity", "channels")
    matched = lookup_join(known, each, ["tenant", "event_type"], "inner", salt_from=["outbox_id"])
    enough = F.col("min_severity").isNull() | F.coalesce(severity_rank(F.col("severity")) >= severity_rank(F.col("min_severity")), F.lit(False))
    return matched.where(enough).select(*known.columns, F.explode("channels").alias("channel")).dropDuplicates(["outbox_id", "channel"])


class Repeats:
    def __init__(self, window):
        self.window, self.sent = window, None

    def row(self, t, message):
        fresh = self.sent is None or t - self.sent >= self.window
        if fresh:
            self.sent = t
        return [(t, message, bool(fresh))]

    def finish(self):
        return []


def _islands(rows: DataFrame, keys: list[str], pause_us: int) -> DataFrame:
    """Number the busy stretches of each key; a pause of ``pause_us`` ends one.

    Decided on summaries of pause-long slots, inside which no pause fits: a busy
    key is never ordered row by row here.
    """
    slot = F.floor(F.col("t") / pause_us).cast("bigint")
    df = rows.withColumn("_slot", slot)
    slots = df.groupBy(*keys, "_slot").agg(F.min("t").alias("_first"), F.max("t").alias("_last"))
    order = Window.partitionBy(*keys).orderBy("_slot")
    gap = F.coalesce(F.col("_first") - F.lag("_last").over(order) >= pause_us, F.lit(True))
    numbered = slots.withColumn("island", F.sum(F.when(gap, 1).otherwise(0)).over(order.rowsBetween(Window.unboundedPreceding, 0)))
    return df.join(numbered.drop("_first", "_last"), [*keys, "_slot"]).drop("_slot")


def dedup_notifications(messages: DataFrame, window_seconds: int = DEDUP_SECONDS) -> DataFrame:
    """Add ``kept``: false when the same thing was *sent* less than the window before.

    Messages: message_id, channel, incident_id, event_type, at. After a pause of
    a whole window the next message is surely kept, so busy stretches fold apart.
    """
    keys = ["channel", "incident_id", "event_type"]
    rows = messages.select("message_id", *keys, F.unix_micros("at").alias("t"))
    kinds = ", ".join(f"{c} {dict(rows.dtypes)[c]}" for c in keys)
    kept = ordered_fold(_islands(rows, keys, window_seconds * 1_000_000), [*keys, "island"], ["t", "message_id"], ["t", "message_id"],
                        lambda *_: Repeats(window_seconds * 1_000_000),
                        f"{kinds}, island BIGINT, t BIGINT, message_id {dict(rows.dtypes)['message_id']}, kept BOOLEAN")
    return kept.select("message_id", *keys, F.timestamp_micros("t").alias("at"), "kept")


class Bucket:
    """Tokens in units of 1/60e6, so that refilling is whole numbers."""

    UNIT = 60_000_000

    def __init__(self, per_minute):
        self.rate = max(per_minute, 1)
        self.full = self.tokens = self.rate * self.UNIT
        self.last = None

    def row(self, t, message):
        if self.last is not None:
            self.tokens = min(self.full, self.tokens + (t - self.last) * self.rate)
        self.last = t
        sent = self.tokens >= self.UNIT
        if sent:
            self.tokens -= self.UNIT
        return [(t, message, sent)]

    def finish(self):
        return []


def rate_limit(messages: DataFrame, per_minute: int = PER_MINUTE) -> DataFrame:
    """Add ``sent``: a token bucket per channel, full at first, refilled evenly.

    A minute without a message fills any bucket, so busy stretches fold apart.
    """
    rows = messages.select("message_id", "channel", F.unix_micros("at").alias("t"))
    cut = _islands(rows, ["channel"], 60_000_000)
    limited = ordered_fold(cut, ["channel", "island"], ["t", "message_id"], ["t", "message_id"], lambda *_: Bucket(per_minute),
                           f"channel STRING, island BIGINT, t BIGINT, message_id {dict(rows.dtypes)['message_id']}, sent BOOLEAN")
    return limited.select("message_id", "channel", F.timestamp_micros("t").alias("at"), "sent")


class Delivery:
    """Repeats and the token bucket of one channel together: only what the bucket lets through counts as sent."""

    def __init__(self, window, per_minute):
        self.window, self.bucket, self.sent = window, Bucket(per_minute), {}

    def row(self, t, message, incident_id, event_type):
        key = (incident_id, event_type)
        last = self.sent.get(key)
        if last is not None and t - last < self.window:
            return [(t, message, "duplicate")]
        if not self.bucket.row(t, message)[0][2]:
            return [(t, message, "rate_limited")]
        if len(self.sent) > 10_000:
            self.sent = {k: at for k, at in self.sent.items() if t - at < self.window}
        self.sent[key] = t
        return [(t, message, "sent")]

    def finish(self):
        return []


def deliverable(messages: DataFrame, window_seconds: int = DEDUP_SECONDS, per_minute: int = PER_MINUTE) -> DataFrame:
    """Add ``outcome``: sent, duplicate or rate_limited, both rules in one pass per channel.

    A message is a duplicate if the same thing was sent less than the window
    before; one that the rate limit drops was not sent and blocks nothing. A
    channel is cut where it rests long enough for both rules to forget.
    """
    keys = ["channel", "incident_id", "event_type"]
    rows = messages.select("message_id", *keys, F.unix_micros("at").alias("t"))
    cut = _islands(rows, ["channel"], max(window_seconds, 60) * 1_000_000)
    done = ordered_fold(cut, ["channel", "island"], ["t", "message_id"], ["t", "message_id", "incident_id", "event_type"],
                        lambda *_: Delivery(window_seconds * 1_000_000, per_minute),
                        f"channel STRING, island BIGINT, t BIGINT, message_id {dict(rows.dtypes)['message_id']}, outcome STRING")
    return done.select("message_id", "channel", F.timestamp_micros("t").alias("at"), "outcome")


NOTICE = ["event_type", "tenant", "incident_id", "incident_number", "title", "severity", "state", "priority", "target", "direction",
          "mitigation_status", "link"]


def render_notice(routed: DataFrame, incidents: DataFrame, ui_base: str | None = None) -> DataFrame:
    """The notice columns of each routed message and its JSON body."""
    facts = incidents.select("incident_id", "incident_number", "title", F.col("severity"), "state", "priority", F.col("target_id").alias("target"), "direction",
                             F.coalesce("mitigation_status", F.lit("none")).alias("mitigation_status"))
    df = routed.drop("severity").join(facts, "incident_id", "inner")
    link: Column = F.lit(None).cast("string")
    if ui_base:
        link = F.concat(F.lit(ui_base.rstrip("/") + "/incidents/"), F.col("incident_id").cast("string"))
    df = df.withColumn("link", link)
    return df.select("outbox_id", "channel", *NOTICE, F.to_json(F.struct(*NOTICE)).alias("body"))


def record_results(outcomes: DataFrame) -> DataFrame:
    """Delivery outcomes as timeline rows; a name that is not plain is refused."""
    plain = lambda c: F.col(c).rlike("^[A-Za-z0-9_.-]{1,64}$")
    result = F.struct(F.struct("channel", "event_type", "outcome").alias("result"))
    return outcomes.where(plain("channel") & plain("event_type")).select(
        "incident_id", F.col("at").alias("occurred_at"), F.lit("notification_result").alias("entry_type"), F.to_json(result).alias("payload"))
