"""Policies: validation, ownership, matching and the choice of one winner per scope."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from ..functions.vocab import SCOPE_SPECIFICITY, by_case
from .joins import covering, is_small, lookup_join
from .snapshots import SCOPE

WILDCARD = "*"
LIMITS = {"id": 128, "name": 256, "description": 2048, "labels": 16, "label_key": 64, "label_value": 256}
MAX_WINDOW_MS = 300_000
MAX_TIMER_MS = 7 * 24 * 3_600_000

# Which selector can name a scope of which type, besides "any".
SELECTOR_FOR = {"host": "host", "prefix": "network", "slash24": "network", "hostgroupTotal": "hostgroup"}


def error_code(ownership: Column | None = None) -> Column:
    """The first violated rule of a draft, in rule order; NULL when none is."""
    selector, scope = F.col("selector"), F.col("scope_type")
    blank = lambda c: F.trim(F.coalesce(F.col(c), F.lit(""))) == ""
    long_label = F.exists(F.map_entries("labels"), lambda e: (F.length(e["key"]) > LIMITS["label_key"])
                          | (F.length(e["value"]) > LIMITS["label_value"]))
    timers = ["trigger_for_ms", "clear_for_ms", "cooldown_ms", "hold_down_ms", "event_update_ms"]
    too_long = F.greatest(*timers) > MAX_TIMER_MS
    fits = (selector == "any") | F.coalesce(
        (selector == by_case(scope, SELECTOR_FOR)) & ((scope != "slash24") | (F.col("sel_len") == 24)), F.lit(False))
    widest = F.when(F.col("sel_family") == 4, F.lit(32)).otherwise(F.lit(128))
    required = ["window_ms", *timers, "clear_percent", "scope_type", "direction", "severity", "mode"]
    rules = [
        ("empty_id", F.coalesce(F.col("policy_id"), F.lit("")) == ""),
        ("id_too_long", F.length("policy_id") > LIMITS["id"]),
        ("id_character", ~F.col("policy_id").rlike("^[A-Za-z0-9_.-]*$")),
        ("empty_name", blank("name")),
        ("name_too_long", F.length("name") > LIMITS["name"]),
        ("description_too_long", F.length("description") > LIMITS["description"]),
        ("empty_tenant", blank("tenant")),
        ("too_many_labels", F.size("labels") > LIMITS["labels"]),
        ("label_too_long", long_label),
        ("missing_value", F.greatest(*[F.col(c).isNull() for c in required])),
        ("missing_threshold_value", F.exists(F.map_values("thresholds"), lambda v: v.isNull())),
        ("zero_window", F.col("window_ms") == 0),
        ("window_too_long", F.col("window_ms") > MAX_WINDOW_MS),
        ("no_thresholds", F.coalesce(F.size("thresholds"), F.lit(0)) <= 0),
        ("zero_threshold", F.exists(F.map_values("thresholds"), lambda v: v == 0)),
        ("invalid_clear_percent", ~F.col("clear_percent").between(1, 100)),
        ("trigger_shorter_than_window", F.col("trigger_for_ms") < F.col("window_ms")),
        ("clear_shorter_than_window", F.col("clear_for_ms") < F.col("window_ms")),
        ("timer_too_long", too_long),
        ("zero_event_update_interval", F.col("event_update_ms") == 0),
        ("selector_scope_mismatch", ~fits),
        ("invalid_prefix_length", (selector == "network") & (F.col("sel_len") > widest)),
        ("unsupported_direction", F.col("direction") == "unknown"),
    ]
    if ownership is not None:
        rules.append(("prefix_not_owned", ownership))
    code = F.lit(None).cast("string")
    for name, broken in reversed(rules):
        code = F.when(F.coalesce(broken, F.lit(False)), F.lit(name)).otherwise(code)
    return code


def unowned(policies: DataFrame, owned: DataFrame) -> DataFrame:
    """Policies whose host or network their tenant has no covering prefix for."""
    asked = policies.where((F.col("tenant") != WILDCARD) & F.col("selector").isin("host", "network"))
    return covering(asked, owned, ("sel_family", "sel_hi", "sel_lo", "sel_len"), "anti", ["tenant"])


def validate_policies(policies: DataFrame, owned: DataFrame | None = None) -> DataFrame:
    """Each policy with its ``error_code``; a repeated id is an error of the later rows.

    ``owned`` gives the prefixes of each tenant; none, or an empty one, skips that rule.
    """
    checked = policies
    test = None
    if owned is not None and owned.limit(1).count():
        ids = unowned(policies.where("sel_lo IS NOT NULL"), owned).select("policy_id", "version").distinct()
        checked = lookup_join(policies, ids.withColumn("_unowned", F.lit(True)), ["policy_id", "version"], "left")
        test = F.coalesce(F.col("_unowned"), F.lit(False))
    code = error_code(test)
    if "source_error" in policies.columns:
        code = F.coalesce("source_error", code)
    order = F.col("position") if "position" in policies.columns else F.col("version")
    repeated = F.row_number().over(Window.partitionBy("policy_id").orderBy(order)) > 1
    code = F.coalesce(code, F.when(repeated, F.lit("duplicate_id")))
    return checked.withColumn("error_code", code).drop("_unowned")


def specificity() -> Column:
    """How specific a policy is: tenant, then scope type, then selector, then family."""
    selector = F.col("selector")
    by_selector = (
        F.when(selector == "host", F.lit(900)).when(selector == "network", F.lit(100) + F.col("sel_len"))
        .when(selector == "hostgroup", F.lit(50)).otherwise(F.lit(0))
    )
    named = F.when(F.col("tenant") == WILDCARD, F.lit(0)).otherwise(F.lit(1_000_000))
    scope = by_case(F.col("scope_type"), SCOPE_SPECIFICITY) * 1000
    return (named + scope + by_selector + F.when(F.col("family").isNotNull(), F.lit(1)).otherwise(F.lit(0))).cast("int")


def _candidates(policies: DataFrame) -> DataFrame:
    fits = (F.col("selector") == "any") | (F.col("selector") == by_case(F.col("scope_type"), SELECTOR_FOR))
    whole = F.col("window_ms").isNotNull() & ~F.exists(F.map_values("thresholds"), lambda v: v.isNull())
    if "source_error" in policies.columns:
        whole = whole & F.col("source_error").isNull()
    return policies.where(F.col("enabled") & fits & whole).withColumn("specificity", specificity())


def _full_key(kind: Column, hi: Column, lo: Column, length: Column, group: Column) -> dict[str, Column]:
    """What a selector of a kind compares, the rest filled in, so that equal keys mean a match."""
    addressed = kind.isin("host", "network")
    return {
        "k_kind": kind,
        "k_hi": F.when(addressed, hi).otherwise(F.lit(_FILL["k_hi"]).cast("bigint")),
        "k_lo": F.when(addressed, lo).otherwise(F.lit(_FILL["k_lo"]).cast("bigint")),
        "k_len": F.when(kind == "network", length).otherwise(F.lit(_FILL["k_len"])),
        "k_group": F.when(kind == "hostgroup", group).otherwise(F.lit(_FILL["k_group"])),
    }


def match_policies(scopes: DataFrame, policies: DataFrame) -> DataFrame:
    """All (scope, policy) pairs that apply, for diagnostics on distinct scopes.

    A scope asks four times, for its own tenant and for any, by its own selector and by
    none, each time with a whole key: only pairs that apply are ever made.
    """
    families = F.when(F.col("family").isNotNull(), F.array("family")).otherwise(F.array(F.lit(4), F.lit(6), F.lit(0)))
    p = _candidates(policies).withColumn("k_family", F.explode(families))
    p = p.where(~F.col("selector").isin("host", "network") | (F.col("k_family") == F.col("sel_family")))
    p = p.select(
        F.col("tenant").alias("k_tenant"), F.col("scope_type").alias("k_scope"), F.col("direction").alias("k_direction"), "k_family",
        *[value.alias(name) for name, value in _full_key(*[F.col(c) for c in ("selector", "sel_hi", "sel_lo", "sel_len", "sel_hostgroup")]).items()],
        F.struct("policy_id", F.col("version").alias("policy_version"), "specificity", "priority").alias("_policy"))
    keys = [c for c in p.columns if c.startswith("k_")]
    kinds = F.array_compact(F.array(F.lit("any"), by_case(F.col("scope_type"), SELECTOR_FOR)))
    asked = scopes.withColumn("k_tenant", F.explode(F.array_distinct(F.array(F.lit(WILDCARD), "tenant")))).withColumn("_kind", F.explode(kinds))
    asked = asked.withColumns({
        "k_scope": F.col("scope_type"), "k_direction": F.col("direction"), "k_family": F.coalesce("family", F.lit(0)),
        **_full_key(*[F.col(c) for c in ("_kind", "scope_hi", "scope_lo", "scope_len", "hostgroup")]),
    }).drop("_kind")
    joined = lookup_join(asked, p, keys, "inner", small=is_small(p, 10_000))
    return joined.select(*scopes.columns, "_policy.*")


_FILL = {"k_hi": 0, "k_lo": 0, "k_len": -1, "k_group": ""}


def _best_two(policies: DataFrame, specific: bool, also: tuple[str, ...] = ()) -> DataFrame:
    """Per fully written lookup key, the best policy and the runner-up.

    A policy for both families is written out for each, so that the key is
    complete and one equal-key join answers.
    """
    p = _candidates(policies).where(F.col("selector") != "any" if specific else F.col("selector") == "any")
    addressed = F.col("selector").isin("host", "network")
    families = F.when(F.col("family").isNotNull(), F.array("family")).otherwise(F.array(F.lit(4), F.lit(6)))
    p = p.withColumn("k_family", F.explode(families))
    p = p.where(~addressed | (F.col("k_family") == F.col("sel_family")))
    p = p.withColumns({f"k_{name}": F.col(name) for name in also})
    keys = ["k_tenant", "k_scope", "k_direction", "k_family", *(f"k_{name}" for name in also)]
    if specific:
        p = (p.withColumn("k_hi", F.coalesce("sel_hi", F.lit(_FILL["k_hi"]).cast("bigint")))
             .withColumn("k_lo", F.coalesce("sel_lo", F.lit(_FILL["k_lo"]).cast("bigint")))
             .withColumn("k_len", F.when(addressed, F.col("sel_len")).otherwise(F.lit(_FILL["k_len"])))
             .withColumn("k_group", F.coalesce("sel_hostgroup", F.lit(_FILL["k_group"]))))
        keys += list(_FILL)
    p = p.withColumn("k_tenant", F.col("tenant")).withColumn("k_scope", F.col("scope_type")).withColumn("k_direction", F.col("direction"))
    order = Window.partitionBy(*keys).orderBy(F.desc("specificity"), F.desc("priority"), "policy_id")
    entry = F.struct("policy_id", F.col("version").alias("policy_version"), "specificity", "priority")
    ranked = p.select(*keys, entry.alias("_e"), F.row_number().over(order).alias("_r")).where("_r <= 2")
    return ranked.groupBy(*keys).agg(F.max(F.when(F.col("_r") == 1, F.col("_e"))).alias("first"),
                                     F.max(F.when(F.col("_r") == 2, F.col("_e"))).alias("second"))


def select_policy(scopes: DataFrame, policies: DataFrame, also: tuple[str, ...] = ()) -> DataFrame:
    """Add the winner: most specific, then highest priority, then lowest id.

    Four equal-key lookups (named or wildcard tenant, specific or any selector)
    in order of specificity; no pairs are made and the scopes are not shuffled.
    Scopes nobody watches keep a NULL ``policy_id``. ``also`` names columns of both
    sides that must be equal too, such as the set that a policy belongs to.
    """
    narrow, broad = _best_two(policies, True, also), _best_two(policies, False, also)
    small = is_small(policies, 50_000)
    key = {
        "k_scope": F.col("scope_type"), "k_direction": F.col("direction"), "k_family": F.col("family"),
        "k_hi": F.coalesce("scope_hi", F.lit(_FILL["k_hi"]).cast("bigint")),
        "k_lo": F.coalesce("scope_lo", F.lit(_FILL["k_lo"]).cast("bigint")),
        "k_len": F.coalesce("scope_len", F.lit(_FILL["k_len"])), "k_group": F.coalesce("hostgroup", F.lit(_FILL["k_group"])),
        **{f"k_{name}": F.col(name) for name in also},
    }
    df = scopes
    for name, value in key.items():
        df = df.withColumn(name, value)
    found = []
    for i, (table, tenant) in enumerate([(narrow, F.col("tenant")), (broad, F.col("tenant")),
                                         (narrow, F.lit(WILDCARD)), (broad, F.lit(WILDCARD))]):
        on = [c for c in table.columns if c.startswith("k_")]
        renamed = table.withColumnsRenamed({"first": f"_f{i}", "second": f"_s{i}"})
        df = lookup_join(df.withColumn("k_tenant", tenant), renamed, on, "left", small=small)
        found += [F.col(f"_f{i}"), F.col(f"_s{i}")]
    ranked = F.array_compact(F.array(*found))
    df = df.select(*scopes.columns, ranked.alias("_ranked"))
    winner, runner = F.get("_ranked", F.lit(0)), F.get("_ranked", F.lit(1))
    reason = (
        F.when(winner.isNull(), F.lit(None)).when(runner.isNull(), F.lit("onlyCandidate"))
        .when(winner["specificity"] != runner["specificity"], F.lit("moreSpecific"))
        .when(winner["priority"] != runner["priority"], F.lit("higherPriority")).otherwise(F.lit("lowestId"))
    )
    return df.select(*scopes.columns, winner["policy_id"].alias("policy_id"), winner["policy_version"].alias("policy_version"),
                     winner["specificity"].alias("specificity"), winner["priority"].alias("priority"),
                     reason.cast("string").alias("precedence"))


def rank_candidates(scopes: DataFrame, policies: DataFrame) -> DataFrame:
    """Every candidate of each distinct scope, best first, the winner marked."""
    matched = match_policies(scopes.select(*SCOPE).distinct(), policies)
    order = Window.partitionBy(*SCOPE).orderBy(F.desc("specificity"), F.desc("priority"), "policy_id")
    rank = F.row_number().over(order)
    return matched.withColumn("rank", rank).withColumn("selected", F.col("rank") == 1)


def policy_diff(open_scopes: DataFrame, old: DataFrame, new: DataFrame) -> DataFrame:
    """Open scopes whose winner vanished or became another policy or version."""
    before = select_policy(open_scopes, old).select(
        *open_scopes.columns, F.col("policy_id").alias("old_policy_id"), F.col("policy_version").alias("old_version"))
    after = select_policy(before, new)
    change = F.when(F.col("policy_id").isNull(), F.lit("policyWithdrawn")).when(
        (F.col("policy_id") != F.col("old_policy_id")) | (F.col("policy_version") != F.col("old_version")), F.lit("policyChanged"))
    return after.where(F.col("old_policy_id").isNotNull()).select(
        *open_scopes.columns, "old_policy_id", "old_version", F.col("policy_id").alias("new_policy_id"),
        F.col("policy_version").alias("new_version"), change.alias("change")).where("change IS NOT NULL")
