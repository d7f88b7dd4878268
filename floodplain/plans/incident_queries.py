"""Reads over incidents and their history. The tenant predicate always comes first."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from ..functions.vocab import MITIGATION_ENDED, by_case
from ..operators.joins import first_rows

EXPORT_FORMAT, EXPORT_VERSION = "incident-export", 1
RETENTION = {"closed_months": 24, "outbox_days": 7, "inbox_days": 7, "dead_letter_days": 90}


def filter_incidents(incidents: DataFrame, tenant: str, states=(), severities=(), priorities=(), direction=None, target_type=None,
                     number=None, opened_between: tuple[int, int] | None = None) -> DataFrame:
    df = incidents.where(F.col("tenant_id") == tenant)
    for column, values in (("state", states), ("severity", severities), ("priority", priorities)):
        if values:
            df = df.where(F.col(column).isin(*values))
    for column, value in (("direction", direction), ("target_type", target_type), ("incident_number", number)):
        if value is not None:
            df = df.where(F.col(column) == value)
    if opened_between:
        start, end = opened_between
        if end <= start:
            raise ValueError("the opened range must be positive")
        opened = F.col("opened_at").cast("timestamp")
        df = df.where((opened >= F.timestamp_seconds(F.lit(start))) & (opened < F.timestamp_seconds(F.lit(end))))
    return df


def page(df: DataFrame, order: list[Column], limit: int) -> DataFrame:
    """The first ``limit`` rows and, on each, whether more follow."""
    some = df.orderBy(*order).limit(limit + 1)
    whole = Window.partitionBy(F.lit(0))  # one page: at most limit + 1 rows
    counted = some.withColumn("_n", F.count(F.lit(1)).over(whole)).withColumn("_r", F.row_number().over(whole.orderBy(*order)))
    return counted.withColumn("has_more", F.col("_n") > limit).where(F.col("_r") <= limit).drop("_n", "_r")


def list_incidents(incidents: DataFrame, tenant: str, sort: str = "opened_at", order: str = "desc", after: tuple | None = None,
                   limit: int = 50, **filters) -> DataFrame:
    """One keyset page: ``after`` is the (sort value in epoch microseconds, id) of the last row seen."""
    if sort not in ("opened_at", "last_detected_at") or limit < 1:
        raise ValueError("unknown sort column or limit")
    df = filter_incidents(incidents, tenant, **filters)
    key = F.unix_micros(F.col(sort).cast("timestamp"))
    if after is not None:
        position, here = F.struct(key.alias("k"), F.col("incident_id").alias("i")), F.struct(F.lit(after[0]).alias("k"), F.lit(after[1]).alias("i"))
        df = df.where(position < here if order == "desc" else position > here)
    direction = F.desc if order == "desc" else F.asc
    return page(df, [direction(sort), direction("incident_id")], limit)


def count_incidents(incidents: DataFrame, tenant: str, **filters) -> DataFrame:
    return filter_incidents(incidents, tenant, **filters).agg(F.count(F.lit(1)).alias("incidents"))


def incident_timeline(timeline: DataFrame, incident_id, after=None, limit: int = 50, id_column: str = "timeline_id") -> DataFrame:
    """Oldest first, by id; also reads audit rows, with their id column."""
    df = timeline.where(F.col("incident_id") == incident_id)
    if after is not None:
        df = df.where(F.col(id_column) > after)
    return page(df, [F.asc(id_column)], limit)


def incident_audit(audit: DataFrame, incident_id, after=None, limit: int = 50) -> DataFrame:
    return incident_timeline(audit, incident_id, after, limit, "audit_id")


def incident_detections(links: DataFrame, incident_id, after: tuple | None = None, limit: int = 50) -> DataFrame:
    """By (detected_at, event_id); ``after`` is that pair of the last row, the time in epoch microseconds."""
    df = links.where(F.col("incident_id") == incident_id)
    if after is not None:
        here = F.struct(F.unix_micros(F.col("detected_at").cast("timestamp")).alias("k"), F.col("event_id").alias("i"))
        df = df.where(here > F.struct(F.lit(after[0]).alias("k"), F.lit(after[1]).alias("i")))
    return page(df, [F.asc("detected_at"), F.asc("event_id")], limit)


def incident_notes(notes: DataFrame, include_superseded: bool = False) -> DataFrame:
    """Notes with the index that replaced them; the current text only, unless asked.

    A redacted note shows no body.
    """
    later = notes.where("supersedes IS NOT NULL").groupBy("incident_id", F.col("supersedes").alias("note_index")).agg(
        F.max("note_index").alias("superseded_by"))
    df = notes.join(later, ["incident_id", "note_index"], "left")
    df = df.withColumn("body", F.when(F.col("redacted"), F.lit("")).otherwise(F.col("body")))
    return df if include_superseded else df.where("superseded_by IS NULL")


STATUS_WORDS = {"proposed": "pending_approval", "requested": "pending_approval", "approved": "approved", "announcing": "active",
                "active": "active", "withdrawing": "withdrawing", "withdrawn": "withdrawn", "rejected": "rejected", "expired": "expired",
                "failed": "failed"}


def mitigation_status(incidents: DataFrame, mitigations: DataFrame) -> DataFrame:
    """Per incident the word for its most relevant mitigation: live before ended, then newest."""
    ended = F.col("state").isin(*MITIGATION_ENDED)
    rank = F.struct((~ended).alias("live"), "updated_at", "mitigation_id")
    best = mitigations.groupBy("tenant_id", "incident_id").agg(F.max_by(F.struct("state", "dry_run"), rank).alias("m"))
    state = F.col("m.state")
    word = F.when(state.isin("announcing", "active") & F.col("m.dry_run"), F.lit("dry_run")).otherwise(by_case(state, STATUS_WORDS))
    words = best.select("tenant_id", "incident_id", word.alias("mitigation_status"))
    return incidents.join(words, ["tenant_id", "incident_id"], "left").withColumn(
        "mitigation_status", F.coalesce("mitigation_status", F.lit("none")))


def notification_status(timeline: DataFrame) -> DataFrame:
    """Per incident: every channel's latest outcome, as none, failed, delivered or partial."""
    inside = lambda name: F.get_json_object("payload", f"$.result.{name}")
    results = timeline.where("entry_type = 'notification_result'").select("incident_id", "timeline_id", inside("channel").alias("channel"),
                                                                         inside("outcome").alias("outcome"))
    latest = results.groupBy("incident_id", "channel").agg(F.max_by("outcome", "timeline_id").alias("outcome"))
    counted = latest.groupBy("incident_id").agg(F.count(F.lit(1)).alias("n"), F.count_if(F.col("outcome") == "delivered").alias("ok"))
    known = timeline.select("incident_id").distinct().join(counted, "incident_id", "left")
    word = F.when(F.col("n").isNull(), "none").when(F.col("ok") == 0, "failed").when(F.col("ok") == F.col("n"), "delivered").otherwise("partial")
    return known.select("incident_id", word.alias("notification_status"))


def timeline_pressure(incidents: DataFrame, timeline: DataFrame) -> DataFrame:
    """The most timeline rows on any active incident; zero when there is none."""
    counts = timeline.groupBy("incident_id").agg(F.count(F.lit(1)).alias("entries"))
    active = incidents.where(~F.col("state").isin("resolved", "closed")).select("incident_id")
    return active.join(counts, "incident_id", "inner").agg(F.coalesce(F.max("entries"), F.lit(0).cast("bigint")).alias("pressure"))


def queue_stats(outbox: DataFrame, inbox: DataFrame, dead_letters: DataFrame) -> DataFrame:
    """Pending and retrying rows per queue, and dead letters nobody looked at."""
    def stats(df: DataFrame, queue: str) -> DataFrame:
        of = lambda status: F.count_if(F.col("status") == status).alias(status)
        return df.agg(of("pending"), of("retrying"), of("dead_letter")).select(F.lit(queue).alias("queue"), "*")

    unread = dead_letters.agg(F.lit(0).cast("bigint").alias("pending"), F.lit(0).cast("bigint").alias("retrying"),
                              F.count_if(F.col("reviewed_at").isNull()).alias("dead_letter"))
    return stats(outbox, "outbox").unionByName(stats(inbox, "inbox")).unionByName(unread.select(F.lit("unreviewed").alias("queue"), "*"))


def purge_closed(incidents: DataFrame, asof: Column, months: int = RETENTION["closed_months"]) -> DataFrame:
    """Incidents to keep. Rewrite the children with ``keep_children`` after it."""
    gone = (F.col("state") == "closed") & (F.col("closed_at").cast("timestamp") <= F.add_months(asof, -months).cast("timestamp"))
    return incidents.where(~F.coalesce(gone, F.lit(False)))


def keep_children(children: DataFrame, incidents: DataFrame, kept: DataFrame) -> DataFrame:
    """Children of purged incidents go with them."""
    gone = incidents.select("incident_id").join(kept.select("incident_id"), "incident_id", "left_anti")
    return children.join(gone, "incident_id", "left_anti")


def purge_queue(queue: DataFrame, asof: Column, done: str, at: str, days: int) -> DataFrame:
    gone = (F.col("status") == done) & (F.col(at).cast("timestamp") <= asof - F.expr(f"INTERVAL {days} DAYS"))
    return queue.where(~F.coalesce(gone, F.lit(False)))


def purge_dead_letters(dead: DataFrame, asof: Column, days: int = RETENTION["dead_letter_days"]) -> DataFrame:
    gone = F.col("reviewed_at").isNotNull() & (F.col("first_seen_at").cast("timestamp") <= asof - F.expr(f"INTERVAL {days} DAYS"))
    return dead.where(~F.coalesce(gone, F.lit(False)))


def _section(children: DataFrame, order: list[str], name: str, max_rows: int) -> DataFrame:
    """Per incident the first rows as one array, and whether rows were left out."""
    fields = [c for c in children.columns if c != "incident_id"]
    head = first_rows(children, ["incident_id"], order, max_rows + 1)
    packed = head.groupBy("incident_id").agg(
        F.array_sort(F.collect_list(F.when(F.col("_rank") <= max_rows, F.struct("_rank", F.struct(*fields).alias("row"))))).alias("_rows"),
        (F.max("_rank") > max_rows).alias(f"{name}_cut"))
    return packed.select("incident_id", F.transform("_rows", lambda r: r["row"]).alias(name), f"{name}_cut")


def export_incidents(incidents: DataFrame, timeline: DataFrame, notes: DataFrame, detections: DataFrame, audit: DataFrame | None = None,
                     max_rows: int | None = None) -> DataFrame:
    """One JSON document per incident of a filtered set, notes with their edits.

    ``max_rows`` cuts each section and says so under ``truncated``; without it
    sections are whole.
    """
    max_rows = 2**31 - 2 if max_rows is None else max_rows
    sections = {"timeline": (timeline, ["timeline_id"]), "notes": (notes, ["note_index"]), "detections": (detections, ["detected_at", "event_id"])}
    if audit is not None:
        sections["audit"] = (audit, ["audit_id"])
    df = incidents.select("incident_id", F.struct(*incidents.columns).alias("incident"))
    wanted = incidents.select("incident_id")
    for name, (children, order) in sections.items():
        own = children.join(wanted, "incident_id", "left_semi")
        df = df.join(_section(own, order, name, max_rows), "incident_id", "left")
    cuts = [F.coalesce(f"{n}_cut", F.lit(False)).alias(n) for n in sections if n != "notes"]
    parts = [F.coalesce(n, F.array()).alias(n) for n in sections]
    document = F.struct(F.lit(EXPORT_FORMAT).alias("format"), F.lit(EXPORT_VERSION).alias("format_version"), "incident", *parts,
                        F.struct(*cuts).alias("truncated"))
    return df.select("incident_id", F.to_json(document).alias("document"))
