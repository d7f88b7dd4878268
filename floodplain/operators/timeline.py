"""Policies that change over time: which set was in force, and what a change ends.

A timeline is a table of policies with one more column, ``valid_from``: all rows
of one moment are the whole set that is in force from then on, until the next.
A set that watches nothing is one of disabled policies.
"""

from __future__ import annotations

from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from ..session import cut_lineage
from .detect import STALE_AFTER_MS, detect
from .evaluate import evaluate
from .joins import is_small
from .policy import select_policy
from .snapshots import SCOPE

#: Names a set: its ``valid_from`` in microseconds.
REVISION = "revision"
DAY_US = 86_400_000_000


def revisions_of(timeline: DataFrame) -> DataFrame:
    """``timeline`` with the number of each row's set."""
    return timeline.withColumn(REVISION, F.unix_micros(F.col("valid_from").cast("timestamp"))).drop("valid_from")


def intervals(policies: DataFrame) -> DataFrame:
    """``(revision, until)``: when each set is in force; the newest has no end. One row a set."""
    sets = policies.select(REVISION).distinct()
    return sets.withColumn("until", F.lead(REVISION).over(Window.orderBy(REVISION)))


def as_of(rows: DataFrame, time: str, policies: DataFrame) -> DataFrame:
    """Add the ``revision`` in force at ``time``: the newest that is not later; NULL before the first.

    An equal-key join on the day, with the sets of a day told apart by their
    intervals, so a long timeline costs a row no more than the sets of its day. Days after
    the last change read as that day.
    """
    spans = intervals(policies)
    last = spans.agg(F.max(REVISION)).first()[0]
    if last is None:
        return rows.withColumn(REVISION, F.lit(None).cast("bigint"))
    day = lambda c: F.floor(c / F.lit(DAY_US)).cast("bigint")
    days = spans.select("*", F.explode(F.sequence(day(F.col(REVISION)), day(F.coalesce(F.col("until") - 1, F.lit(last))))).alias("_day"))
    if is_small(days):
        days = F.broadcast(days)
    at = F.unix_micros(time)
    fits = (F.least(day(at), day(F.lit(last))) == F.col("_day")) & (at >= F.col(REVISION)) & (F.col("until").isNull() | (at < F.col("until")))
    return rows.join(days, fits, "left").drop("until", "_day")


def select_as_of(snaps: DataFrame, policies: DataFrame, time: str = "window_end") -> DataFrame:
    """``select_policy`` under the set in force when each snapshot ended; rows before the first set have no winner."""
    return select_policy(as_of(snaps, time, policies), policies, also=(REVISION,))


def evaluate_as_of(selected: DataFrame, policies: DataFrame) -> DataFrame:
    """``evaluate`` against the thresholds and timers of the set each winner comes from."""
    return evaluate(selected, policies, also=(REVISION,))


def policy_ends(selected: DataFrame, policies: DataFrame, stale_after_ms: int = STALE_AFTER_MS) -> DataFrame:
    """Commands ``(scope, scope_display, at, reason)`` for the moments at which a watched scope's winner changed.

    ``selected`` comes from ``select_as_of``. A change matters while a scope may be
    anything but idle: within ``stale_after_ms`` of its last snapshot under a winner.
    Sets are met by equal keys on stretches of that length, and the winner is looked up
    again only for the few scopes and sets that meet. Of several changes the first
    counts: ``policyWithdrawn`` if no policy watches the scope then, else
    ``policyChanged``. A set that keeps id and version changes nothing.
    """
    stale = stale_after_ms * 1000
    scope = [*SCOPE, "scope_display"]
    watched = selected.where("policy_id IS NOT NULL").groupBy(*scope, REVISION, "policy_id", "policy_version").agg(F.max(F.unix_micros("window_end")).alias("_last"))
    bucket = lambda c: F.floor(c / F.lit(stale)).cast("bigint")
    moments = policies.select(F.col(REVISION).alias("_moment")).distinct().withColumn("_bucket", bucket(F.col("_moment")))
    if is_small(moments):
        moments = F.broadcast(moments)
    near = watched.withColumn("_bucket", F.explode(F.array(bucket(F.col("_last")), bucket(F.col("_last")) + 1)))
    met = near.join(moments, "_bucket").where((F.col("_moment") > F.col("_last")) & (F.col("_moment") <= F.col("_last") + stale))
    asked = met.select(*scope, F.col("policy_id").alias("_old"), F.col("policy_version").alias("_old_version"), F.col(REVISION).alias("_under"), F.col("_moment").alias(REVISION))
    found = select_policy(asked, policies, also=(REVISION,))
    reason = F.when(F.col("policy_id").isNull(), F.lit("policyWithdrawn")).when(
        (F.col("policy_id") != F.col("_old")) | (F.col("policy_version") != F.col("_old_version")), F.lit("policyChanged"))
    changed = found.withColumn("reason", reason).where("reason IS NOT NULL")
    first = changed.groupBy(*scope, "_under", "_old", "_old_version").agg(F.min(F.struct(REVISION, "reason")).alias("end"))
    return first.select(*scope, F.timestamp_micros(F.col("end")[REVISION]).alias("at"), F.col("end.reason").alias("reason")).distinct()


def detect_as_of(snaps: DataFrame, timeline: DataFrame, asof: int | None = None, resets: DataFrame | None = None, stale_after_ms: int = STALE_AFTER_MS) -> DataFrame:
    """The detection log of snapshots under policies that change: ``detect`` with each snapshot's own set.

    A detection whose policy is withdrawn or replaced ends at that moment, under
    the policy it was opened with. ``resets`` are further commands.
    """
    policies = revisions_of(timeline)
    selected = cut_lineage(select_as_of(snaps, policies))  # read for the commands and for the machine
    ends = policy_ends(selected, policies, stale_after_ms)
    commands = ends if resets is None else ends.unionByName(resets.select(*ends.columns))
    return detect(evaluate_as_of(selected, policies), asof, resets=commands, stale_after_ms=stale_after_ms)
