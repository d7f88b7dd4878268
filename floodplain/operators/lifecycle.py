"""The life of mitigations as a log of commands: what each command did, or why it was refused.

No mitigation makes more than five moves, because the fourteen edges have no
circle. So a history is found in five rounds of "the first command that is legal
now", an aggregate that is combined before any shuffle, and no mitigation's
commands are ever ordered in one task. What lives apart from a mitigation's own
commands, that only one may be live per action, prefix and match, is decided
afterwards on one row a mitigation.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from ..functions import net
from ..functions.vocab import MITIGATION_EDGES, MITIGATION_ENDED, by_case
from ..session import cut_lineage
from . import mitigation as rules
from .folds import ordered_fold
from .joins import hot_keys, lookup_join
from .slices import before, by_range

CREATED_AS = {"propose": "proposed", "request": "requested"}
# withdraw and begin_withdrawal lead to withdrawn where nothing was announced yet.
LEADS_TO = {"approve": "approved", "reject": "rejected", "expire": "expired", "announce": "announcing", "activate": "active", "fail": "failed",
            "withdraw": "withdrawing", "begin_withdrawal": "withdrawing", "finish_withdrawal": "withdrawn"}
CAUSES = ["operator", "duration_reached", "kill_switch"]
KINDS = ["rtbh", "parent_prefix", "flowspec_discard", "flowspec_rate_limit"]
MAX_REASON = 1000
MOST_MOVES = 5
FACTS = {"incident_id": None, "family": "int", "hi": "bigint", "lo": "bigint", "prefix_len": "int", "action": "string", "duration_seconds": "int",
         "bytes_per_second": "bigint", "match_protocol": "int", "match_source": "string", "match_source_family": "int", "match_source_len": "int",
         "match_source_port": "int", "match_destination_port": "int"}
OPTIONAL = {"expected_version": "bigint", "actor_type": "string", "actor_id": "string", "reason": "string", "cause": "string", "dry_run": "boolean",
            "route": "string", "kill_switch": "boolean"}


def _rows(commands: DataFrame) -> DataFrame:
    """All columns there, each command id once (its earliest row), places in the order of time and id."""
    types = dict(commands.dtypes)
    filled = [
        (F.col(name) if name in types else F.lit(None)).cast(kind or types.get(name, "string")).alias(name) for name, kind in {**OPTIONAL, **FACTS}.items()
    ]
    rows = commands.select("command_id", "mitigation_id", "tenant_id", F.col("at").cast("timestamp").alias("at"), "verb", *filled)
    rows = rows.withColumn("t", F.unix_micros("at")).withColumn("kill_switch", F.coalesce("kill_switch", F.lit(False)))
    lead = ["t", *[c for c in rows.columns if c not in ("t", "command_id")]]
    once = rows.groupBy("command_id").agg(F.min(F.struct(*lead)).alias("r")).select("command_id", "r.*")
    return once.withColumn("place", F.struct("t", F.col("command_id").cast("string").alias("c")))


def _sound_reason() -> Column:
    text = F.trim("reason")
    return F.coalesce((text != "") & (F.length(text) <= MAX_REASON) & ~text.rlike(r"\p{Cntrl}"), F.lit(False))


def _sound() -> Column:
    """Whether a row is a command at all."""
    whole = F.col("command_id").isNotNull() & F.col("mitigation_id").isNotNull() & F.col("tenant_id").isNotNull() & F.col("t").isNotNull()
    return whole & F.coalesce(F.col("verb").isin(*CREATED_AS, *LEADS_TO), F.lit(False))


def _request_error() -> Column:
    hi, lo = net.masked(F.col("family"), F.col("hi"), F.col("lo"), F.col("prefix_len"))
    width = net.width(F.col("family"))
    right = (
        F.col("family").isin(4, 6) & F.col("prefix_len").between(0, width) & (hi == F.col("hi")) & (lo == F.col("lo"))
        & F.col("action").isin(*KINDS) & F.col("duration_seconds").between(*rules.DURATION_BOUNDS)
    )
    return F.when(~F.coalesce(right, F.lit(False)) | rules.action_error().isNotNull() | ~_sound_reason(), "mitigation.invalid")


def _next_state() -> Column:
    to = by_case(F.col("verb"), LEADS_TO)
    return F.when(F.col("verb").isin("withdraw", "begin_withdrawal") & (F.col("state") == "approved"), "withdrawn").otherwise(to)


def _refusal(allow_self_approval: bool) -> Column:
    """Why a command does not move a mitigation of ``state``, ``version``, ``owner``, ``requested``, ``guard``; NULL if it does."""
    to = _next_state()
    edge = F.concat_ws(">", "state", to).isin(*(f"{a}>{b}" for a, b in MITIGATION_EDGES))
    # Only a withdrawal says why, so nothing else may end an approved mitigation.
    edge = edge & ~((F.col("verb") == "finish_withdrawal") & (F.col("state") == "approved"))
    own = F.struct("actor_type", "actor_id").eqNullSafe(F.col("requested"))
    wordless = F.col("verb").isin("reject", "withdraw") & ~_sound_reason()
    causeless = (F.col("verb") == "begin_withdrawal") & ~F.coalesce(F.col("cause").isin(*CAUSES), F.lit(False))
    stale = F.coalesce(F.col("expected_version") != F.col("version"), F.lit(False))
    return (
        F.when(F.col("state").isNull() | (F.col("owner") != F.col("tenant_id")), "mitigation.not_found")
        .when(stale, "mitigation.version_conflict")
        .when(wordless | causeless, "mitigation.invalid")
        .when(~edge, "mitigation.illegal_transition")
        .when((F.col("verb") == "approve") & own & F.lit(not allow_self_approval), "mitigation.self_approval")
        .when(to.isin("approved", "announcing") & F.col("kill_switch"), "mitigation.kill_switch")
        .when(to.isin("approved", "announcing"), F.col("guard"))
    )


class OneAtATime:
    """Of mitigations of one duplicate key, in the order of their beginnings: whether each finds none live."""

    def __init__(self, *_):
        self.until = None

    def row(self, mitigation, t, c, end_t, end_c):
        free = self.until is None or self.until <= (t, c)
        if free:
            self.until = (float("inf"), "") if end_t is None else (end_t, end_c)
        return [(mitigation, free)]

    def finish(self):
        return []


def _free(lives: DataFrame) -> DataFrame:
    """(mitigation_id, free): false while another of the same action, prefix and match is live.

    ``lives``: mitigation_id, duplicate_key, place, ended. A key is cut where all
    that began earlier has ended, however it was decided, so a hot key is many groups.
    """
    types = dict(lives.dtypes)
    flat = lives.select("mitigation_id", "duplicate_key", "place", "ended", "place.t", "place.c")
    open_end = F.struct(F.lit(2**63 - 1).alias("t"), F.lit("").alias("c"))
    keys, order = ["duplicate_key"], ["t", "c"]
    sliced = by_range(flat, keys, "t")
    busy = before(sliced, keys, order, {"busy": ("max", F.coalesce("ended", open_end))})
    begins = busy.withColumn("begin", F.when(F.col("busy").isNull() | (F.col("busy") <= F.col("place")), F.to_json("place")))
    cut = before(cut_lineage(begins), keys, order, {"run": ("last", F.col("begin"))}).withColumn("run", F.coalesce("begin", "run"))
    folded = cut.select(*keys, "run", "mitigation_id", "t", "c", F.col("ended.t").alias("end_t"), F.col("ended.c").alias("end_c"))
    schema = f"duplicate_key STRING, run STRING, mitigation_id {types['mitigation_id']}, free BOOLEAN"
    return ordered_fold(folded, ["duplicate_key", "run"], order, ["mitigation_id", "t", "c", "end_t", "end_c"], OneAtATime, schema).select("mitigation_id", "free")


def mitigation_log(commands: DataFrame, allowlist: DataFrame, allow_self_approval: bool = False, **config) -> DataFrame:
    """One row per command with what it did: ``outcome`` is ``applied`` or the code of its refusal.

    Commands: command_id, mitigation_id, tenant_id, at, verb; the columns of
    ``OPTIONAL`` and, for ``propose`` and ``request``, of ``FACTS`` where they are needed;
    one that is absent counts as NULL. ``kill_switch`` is the switch as it stood at that moment. ``config``
    as in ``guard_check``, which decides at the request, at approval and at announcing.

    Commands are applied in the order of time, ties by the text of the id; repeats of a command id do nothing
    more (the earliest row counts). An id is its first request's: later ones, rows without
    id, mitigation, tenant or time and unknown verbs are ``mitigation.invalid``.
    What was never created does not exist: ``mitigation.not_found``. No commands, no rows.
    """
    rows = cut_lineage(_rows(commands).withColumn("sound", _sound()))
    asked = rows.where("sound").where(F.col("verb").isin(*CREATED_AS))
    facts = [*FACTS, "reason", "kill_switch", "verb", "tenant_id", "actor_type", "actor_id", "command_id"]
    first = asked.groupBy("mitigation_id").agg(F.min_by(F.struct("place", *facts), F.col("place")).alias("r")).select("mitigation_id", "r.*")
    checked = rules.guard_check(first.withColumn("tenant", F.col("tenant_id")), allowlist, source_len="match_source_len", **config).withColumnRenamed("refusal", "guard")
    code = F.coalesce(_request_error(), F.when(F.col("kill_switch"), "mitigation.kill_switch"), F.col("guard"))
    created = cut_lineage(rules.with_duplicate_key(checked).withColumn("refused", code))

    state = created.where("refused IS NULL").select(
        "mitigation_id", F.col("tenant_id").alias("owner"), F.struct("actor_type", "actor_id").alias("requested"), "guard", "place",
        by_case(F.col("verb"), CREATED_AS).alias("state"), F.lit(1).cast("bigint").alias("version"),
        F.lit(None).cast("boolean").alias("dry_run"), F.lit(None).cast("string").alias("cause"), F.lit(None).cast("string").alias("route"))
    kept = state.columns
    moves = rows.where("sound").where(F.col("verb").isin(*LEADS_TO))
    hot = cut_lineage(hot_keys(rows, ["mitigation_id"]))
    steps = state = cut_lineage(state)
    for _ in range(MOST_MOVES):
        live = state.where(~F.col("state").isin(*MITIGATION_ENDED))
        now = live.select("mitigation_id", "owner", "requested", "guard", "state", "version", F.col("place").alias("since"),
                          F.struct("dry_run", "cause", "route").alias("was"))
        met = lookup_join(moves, now, ["mitigation_id"], "inner", salt_from=["command_id"], hot=hot).where(F.col("place") > F.col("since"))
        legal = met.where(_refusal(allow_self_approval).isNull())
        moved = legal.select(
            "mitigation_id", "place", "owner", "requested", "guard", _next_state().alias("state"), (F.col("version") + 1).alias("version"),
            F.when(F.col("verb") == "announce", F.coalesce("dry_run", F.lit(False))).otherwise(F.col("was.dry_run")).alias("dry_run"),
            F.when(F.col("verb") == "withdraw", "operator").when(F.col("verb") == "begin_withdrawal", F.col("cause")).otherwise(F.col("was.cause")).alias("cause"),
            F.when(F.col("verb") == "announce", F.col("route")).otherwise(F.col("was.route")).alias("route"))
        state = cut_lineage(moved.groupBy("mitigation_id").agg(F.min_by(F.struct(*[c for c in kept if c != "mitigation_id"]), F.col("place")).alias("r"))
                            .select("mitigation_id", "r.*").select(*kept))
        steps = steps.unionByName(state)
        if state.isEmpty():
            break

    ended = F.max(F.when(F.col("state").isin(*MITIGATION_ENDED), F.col("place")))
    path = F.collect_list(F.struct("place", "state", "version", "dry_run", "cause", "route"))  # six at most
    lives = steps.groupBy("mitigation_id").agg(ended.alias("ended"), path.alias("path"), F.first("requested").alias("requested"))
    lives = cut_lineage(created.where("refused IS NULL").select("mitigation_id", "duplicate_key", "place").join(lives, "mitigation_id"))
    free = _free(lives.select("mitigation_id", "duplicate_key", "place", "ended"))
    outcome = created.join(free, "mitigation_id", "left").withColumn(
        "refused", F.coalesce("refused", F.when(~F.coalesce("free", F.lit(True)), "mitigation.duplicate")))
    known = outcome.join(lives.select("mitigation_id", "path", "requested"), "mitigation_id", "left").select(
        "mitigation_id", F.col("command_id").alias("first_command"), "refused", "guard", F.col("tenant_id").alias("owner"), "requested",
        F.when(F.col("refused").isNull(), F.col("path")).alias("path"), F.struct(*FACTS, F.trim("reason").alias("reason"), "duplicate_key").alias("request"))
    return _outcomes(rows, cut_lineage(known), hot, allow_self_approval)


def _outcomes(rows: DataFrame, known: DataFrame, hot: DataFrame, allow_self_approval: bool) -> DataFrame:
    """Every command against the state just before it."""
    df = lookup_join(rows, known, ["mitigation_id"], "left", salt_from=["command_id"], hot=hot)
    earlier = F.array_max(F.filter("path", lambda x: x["place"] < F.col("place")))
    df = df.withColumn("b", earlier).withColumn("state", F.col("b.state")).withColumn("version", F.col("b.version"))
    create = F.col("verb").isin(*CREATED_AS)
    taken = ~F.col("command_id").eqNullSafe(F.col("first_command"))
    code = F.when(~F.col("sound"), "mitigation.invalid").when(create & taken, "mitigation.invalid").when(create, F.col("refused")).otherwise(_refusal(allow_self_approval))
    clean = F.substring(F.regexp_replace("reason", r"\p{Cntrl}", ""), 1, MAX_REASON)
    said = (
        F.when(create | (F.col("verb") == "reject"), F.trim("reason")).when(F.col("verb") == "withdraw", F.concat(F.lit("operator: "), F.trim("reason")))
        .when(F.col("verb") == "begin_withdrawal", F.col("cause")).when(F.col("verb") == "announce", F.when(F.col("dry_run"), "dry_run"))
        .when(F.col("verb") == "fail", F.coalesce(clean, F.lit("")))
    )
    to = F.when(create, by_case(F.col("verb"), CREATED_AS)).otherwise(_next_state())
    after = F.array_max(F.filter("path", lambda x: x["place"] <= F.col("place")))
    done = F.col("code").isNull()
    return df.withColumn("code", code).select(
        "command_id", "mitigation_id", "tenant_id", "at", "verb", "actor_type", "actor_id", F.coalesce("code", F.lit("applied")).alias("outcome"),
        F.when(done, F.coalesce(F.col("version") + 1, F.lit(1).cast("bigint"))).alias("version"), F.when(~create & (done | (F.col("code") != "mitigation.not_found")), F.col("state")).alias("from_state"),
        F.when(done, to).alias("to_state"), F.when(done, said).alias("detail"), F.when(done, after.dropFields("place", "state", "version")).alias("facts"),
        F.when(done, F.col("request")).alias("request"))


def current_mitigations(log: DataFrame) -> DataFrame:
    """Every created mitigation as it stands after the log, with the columns the work-lists read."""
    of = lambda state, value: F.max(F.when(F.col("to_state") == state, value))
    done = log.where("outcome = 'applied'")
    actor = F.struct("actor_type", "actor_id")
    newest = F.max_by(F.struct("to_state", "version", "at", "facts"), F.col("version"))
    df = done.groupBy("mitigation_id", "tenant_id").agg(
        newest.alias("n"), F.max_by(F.struct("request", "at", actor.alias("actor")), -F.col("version")).alias("c"), of("approved", F.struct("at", actor.alias("actor"))).alias("a"),
        of("active", F.col("at")).alias("active_since"), F.max(F.when(F.col("to_state").isin(*MITIGATION_ENDED), F.col("at"))).alias("ended_at"),
        of("failed", F.col("detail")).alias("last_error"))
    return df.select(
        "mitigation_id", "tenant_id", "c.request.*", F.col("n.to_state").alias("state"), "n.version", F.col("c.actor").alias("requested_by"), F.col("a.actor").alias("approved_by"),
        "n.facts.dry_run", F.col("n.facts.cause").alias("withdrawal_cause"), "n.facts.route", "last_error", F.col("c.at").alias("created_at"), F.col("n.at").alias("updated_at"),
        F.col("a.at").alias("approved_at"), "active_since", (F.col("active_since") + F.make_dt_interval(secs=F.col("c.request.duration_seconds"))).alias("expires_at"), "ended_at")


def history_rows(log: DataFrame) -> DataFrame:
    """What ``mitigation_history`` reads: one row per version."""
    return log.where("outcome = 'applied'").select(
        "mitigation_id", "tenant_id", "version", F.col("at").alias("occurred_at"), "from_state", "to_state", "actor_type", "actor_id", "detail")


def outbox_rows(log: DataFrame) -> DataFrame:
    """What ``route_changes`` reads: one message per version, ``outbox_id`` being the mitigation and its version."""
    r, f = (lambda name: F.col(f"request.{name}")), (lambda name: F.col(f"facts.{name}"))
    prefix = F.concat(net.address_text(r("family"), r("hi"), r("lo")), F.lit("/"), r("prefix_len").cast("string"))
    payload = F.struct(
        "mitigation_id", "tenant_id", r("incident_id").alias("incident_id"), prefix.alias("prefix"), r("action").alias("action"), F.col("to_state").alias("state"),
        F.col("from_state").alias("previous_state"), "version", f("dry_run").alias("dry_run"), f("cause").alias("withdrawal_cause"), r("reason").alias("reason"), "detail")
    return log.where("outcome = 'applied'").select(
        F.concat_ws(":", F.col("mitigation_id").cast("string"), "version").alias("outbox_id"), F.col("tenant_id").alias("tenant"),
        F.concat(F.lit("mitigation."), "to_state").alias("event_type"), F.to_json(payload).alias("payload"))


def audit_rows(log: DataFrame) -> DataFrame:
    """Every command, allowed or denied, with the state before and after as JSON.

    ``audit_id`` is the command's id. What another tenant tried on a mitigation says nothing of its state, as in the log.
    """
    done = F.col("outcome") == "applied"
    return log.select(
        F.col("command_id").alias("audit_id"), "tenant_id", "actor_type", "actor_id", F.concat(F.lit("mitigation."), "verb").alias("action"), F.lit("mitigation").alias("resource_type"),
        F.col("mitigation_id").alias("resource_id"), F.when(done, "allowed").otherwise("denied").alias("result"), F.when(done, F.col("detail")).otherwise(F.col("outcome")).alias("reason"),
        F.when(F.col("from_state").isNotNull(), F.to_json(F.struct(F.col("from_state").alias("state")))).alias("before"),
        F.when(done, F.to_json(F.struct(F.col("to_state").alias("state"), "version"))).alias("after"), F.col("at").alias("occurred_at"))
