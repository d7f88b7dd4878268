"""Dimension lookups and the longest-prefix-match join.

A dimension side is broadcast only after its row count was checked; past the
bound the same lookup runs as a salted shuffle join, so one hot key never lands
in one task.
"""

from __future__ import annotations

from collections import Counter

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from ..functions import net
from ..session import cut_lineage

BROADCAST_ROWS = 200_000  # dimension rows here are at most a few hundred bytes
MAX_CHAINED_LENGTHS = 24
SALTS = 32
HOT_ROWS = 100_000  # of one key, past which its rows are dealt to several tasks
BROADCAST_BYTES = 128 << 20
BLOCK_BITS = 8  # prefix lengths of a block; its networks cut at most 256 intervals


def is_small(df: DataFrame, rows: int = BROADCAST_ROWS) -> bool:
    """Whether ``df`` has at most ``rows`` rows; reads no more than one over."""
    return df.limit(rows + 1).count() <= rows


def lookup_join(left: DataFrame, right: DataFrame, on: list[str], how: str = "left",
                salt_from: list[str] | None = None, small: bool | None = None,
                salts: int = SALTS, hot: DataFrame | None = None) -> DataFrame:
    """Join a large ``left`` to a dimension ``right`` on equal columns.

    Past the bound, rows of a hot key are dealt to ``salts`` parts, each with a copy of that key's
    ``right`` rows; all other keys stand once. ``salt_from`` names columns that differ between rows
    of one hot key. ``hot`` are the ``hot_keys`` of ``left`` if the caller has them.
    """
    if small is None:
        small = is_small(right)
    if small:
        return left.join(F.broadcast(right), on, how)
    source = salt_from or [c for c, t in left.dtypes if not t.startswith(("map", "struct", "array"))]
    marked = F.broadcast((hot_keys(left, on) if hot is None else hot).withColumn("_hot", F.lit(True)))
    keyless = F.greatest(*(F.col(c).isNull() for c in on), F.lit(False))  # they meet nothing, and may be many
    part = F.pmod(F.xxhash64(*source), F.lit(salts)).cast("int")
    salted = left.join(marked, on, "left").withColumn("_salt", F.when(F.col("_hot") | keyless, part).otherwise(0)).drop("_hot")
    parts = F.when(F.col("_hot"), F.sequence(F.lit(0), F.lit(salts - 1))).otherwise(F.array(F.lit(0)))
    copies = right.join(marked, on, "left").withColumn("_salt", F.explode(parts)).drop("_hot")
    return salted.join(copies, [*on, "_salt"], how).drop("_salt")


def hot_keys(df: DataFrame, on: list[str]) -> DataFrame:
    """The keys with more than ``HOT_ROWS`` rows: as many as the rows allow, so few."""
    return df.groupBy(*on).agg(F.count(F.lit(1)).alias("_rows")).where(F.col("_rows") > HOT_ROWS).select(*on)


def _registry(prefixes: DataFrame, value: list[str]) -> DataFrame:
    """Masked networks, one row each: the same network twice keeps the smallest value."""
    hi, lo = net.masked(F.col("family"), F.col("net_hi"), F.col("net_lo"), F.col("prefix_len"))
    legal = (F.col("prefix_len") >= 0) & (F.col("prefix_len") <= net.width(F.col("family")))
    entry = F.struct(*[F.col(c) for c in value], F.col("prefix_len"))
    return (
        prefixes.where(legal)
        .select("family", F.col("prefix_len").alias("len"), hi.alias("n_hi"), lo.alias("n_lo"), entry.alias("entry"))
        .groupBy("family", "len", "n_hi", "n_lo")
        .agg(F.min("entry").alias("entry"))
    )


def lengths_of(prefixes: DataFrame) -> list[tuple[int, int, int]]:
    """(family, length, rows) of the registered prefixes: at most 162 rows."""
    counted = prefixes.groupBy("family", "prefix_len").count().collect()
    return sorted(
        ((r["family"], r["prefix_len"], r["count"]) for r in counted), key=lambda r: (r[0], -r[1])
    )


def longest_prefix_match(
    df: DataFrame,
    prefixes: DataFrame,
    sides: dict[str, tuple[str, ...]],
    value: list[str],
    broadcast_rows: int = BROADCAST_ROWS,
    max_lengths: int = MAX_CHAINED_LENGTHS,
    lengths: list[tuple[int, int, int]] | None = None,
) -> DataFrame:
    """Add, per side, the struct of the most specific prefix holding its address.

    ``sides`` maps the new column to its (family, hi, lo) columns, and optionally
    the column of a prefix's own length, past which entries do not cover it. The
    struct has the ``value`` columns and ``prefix_len``, NULL where nothing matches.
    """
    lengths = lengths_of(prefixes) if lengths is None else lengths
    registry = _registry(prefixes, value)
    rows = sum(n for _, _, n in lengths)
    if rows <= broadcast_rows and len(lengths) <= max_lengths:
        return _chained(df, registry, sides, lengths)
    chained = any(len(columns) > 3 for columns in sides.values())
    deepest = max(Counter((f, _block(n)) for f, n, _ in lengths).values()) if chained else 1
    if broadcast_rows and 2 * deepest * registry_bytes(prefixes, value) <= BROADCAST_BYTES:  # two ends, each with its chain
        return _blocked(df, registry, sides, lengths, chained)
    return _by_distinct_address(df, registry, sides, lengths, broadcast_rows)


def registry_bytes(prefixes: DataFrame, value: list[str]) -> int:
    """About what the registry takes in memory: its texts and 64 bytes of numbers and overhead an entry."""
    texts = sum((F.coalesce(F.octet_length(F.col(c).cast("string")), F.lit(0)) for c in value), F.lit(64))
    return prefixes.agg(F.coalesce(F.sum(texts), F.lit(0))).first()[0]


def _block(length: int) -> int:
    """The bits before a length's block: block 8 has the lengths 9 to 16, block 0 those from 0 to 8."""
    return max(length - 1, 0) // BLOCK_BITS * BLOCK_BITS


def _byte(family: Column, hi: Column, lo: Column, start: Column) -> Column:
    """The bits of an address that its place within a block is read from."""
    shifted = lambda half, last: F.call_function("shiftrightunsigned", half, F.lit(last - BLOCK_BITS) - start)
    bits = F.when(family == 4, shifted(lo, 32)).when(start < 64, shifted(hi, 64)).otherwise(shifted(lo, 128))
    return bits.bitwiseAND(F.lit((1 << BLOCK_BITS) - 1)).cast("int")


def _intervals(registry: DataFrame, lengths: list[tuple[int, int, int]], chained: bool) -> DataFrame:
    """Nested prefixes as disjoint intervals: per block the places where another prefix becomes the longest.

    Every end of a prefix is such a place; which prefixes hold it is looked up by one
    equal key for each length of its block. ``held`` is the longest of them, NULL in a gap, or
    with ``chained`` all, longest first. A block is one row of sorted arrays of at most 256 places.
    """
    start = F.floor(F.greatest(F.col("len") - 1, F.lit(0)) / BLOCK_BITS).cast("int") * BLOCK_BITS
    family, block = F.col("family"), F.col("block")
    own = registry.withColumn("block", start)
    k_hi, k_lo = net.masked(family, F.col("n_hi"), F.col("n_lo"), block)
    size = F.call_function("shiftleft", F.lit(1), F.lit(BLOCK_BITS) + block - F.col("len"))
    key = ["family", "block", "k_hi", "k_lo"]
    held = own.select("family", "block", k_hi.alias("k_hi"), k_lo.alias("k_lo"), _byte(family, F.col("n_hi"), F.col("n_lo"), block).alias("first"), "len",
                      F.struct((-F.col("len")).alias("order"), "len", "entry").alias("item"))
    places = held.select(*key, F.explode(F.array(F.col("first"), F.col("first") + size)).alias("place")).where(F.col("place") < 1 << BLOCK_BITS).distinct()
    known = F.when(family == 4, F.array(*[F.lit(n) for f, n, _ in lengths if f == 4]).cast("array<int>")).otherwise(
        F.array(*[F.lit(n) for f, n, _ in lengths if f == 6]).cast("array<int>"))
    own_lengths = F.filter(known, lambda n: F.floor(F.greatest(n - 1, F.lit(0)) / BLOCK_BITS) * BLOCK_BITS == block)
    probes = places.withColumn("len", F.explode(own_lengths)).withColumn("first", F.col("place") - F.pmod(F.col("place"), size))
    met = probes.join(held, [*key, "len", "first"], "left").groupBy(*key, "place")
    cut = met.agg(F.array_sort(F.collect_list("item")).alias("held")) if chained else met.agg(F.min("item").alias("i")).select(*key, "place", F.col("i.entry").alias("held"))
    blocks = cut.groupBy(*key).agg(F.array_sort(F.collect_list(F.struct("place", "held"))).alias("cut"))
    # Steps of a binary search, only those that fit the array.
    steps = F.filter(F.array(*[F.lit(1 << b) for b in range(BLOCK_BITS, -1, -1)]), lambda n: n <= F.size("cut"))
    return blocks.select(*key, F.col("cut.place").alias("places"), steps.alias("steps"), F.col("cut.held").alias("held"))


def _blocked(df, registry, sides, lengths, chained):
    """One broadcast hash join per block of lengths, however many lengths there are.

    An address finds its interval in a block's row by binary search; longer blocks
    come first. The flows are neither shuffled nor copied.
    """
    cut = cut_lineage(_intervals(registry, lengths, chained))
    blocks = {fam: sorted({_block(n) for f, n, _ in lengths if f == fam and 0 <= n <= (32 if fam == 4 else 128)}, reverse=True) for fam in (4, 6)}
    for side, (family, hi, lo, *own_length) in sides.items():
        found = []
        for fam in (4, 6):
            for start in blocks[fam]:
                mask_hi, mask_lo = net.mask_halves(fam, start)
                name = f"_{side}_{fam}_{start}"
                table = cut.where((F.col("family") == fam) & (F.col("block") == start)).select(
                    F.col("k_hi").alias(f"{name}_hi"), F.col("k_lo").alias(f"{name}_lo"), F.struct("places", "steps", "held").alias(name))
                same = F.col(family) == fam
                keys = [F.when(same, F.col(half).bitwiseAND(F.lit(mask))) for half, mask in ((hi, mask_hi), (lo, mask_lo))]
                df = df.join(F.broadcast(table), (keys[0] == F.col(f"{name}_hi")) & (keys[1] == F.col(f"{name}_lo")), "left").drop(f"{name}_hi", f"{name}_lo")
                byte = _byte(F.lit(fam), F.col(hi), F.col(lo), F.lit(start))
                before = F.aggregate(F.col(name)["steps"], F.lit(0), lambda n, step: F.when(  # noqa: B023
                    F.get(F.col(name)["places"], n + step - 1) <= byte, n + step).otherwise(n))  # noqa: B023
                held = F.get(F.col(name)["held"], before - 1)
                if chained:
                    longest = F.col(own_length[0]) if own_length else F.lit(128)
                    held = F.get(F.filter(held, lambda i: i["len"] <= longest), F.lit(0))["entry"]  # noqa: B023
                found.append(held)
        df = df.withColumn(side, F.coalesce(*found) if found else F.lit(None)).drop(*[f"_{side}_{fam}_{start}" for fam in (4, 6) for start in blocks[fam]])
    return df


def _chained(df, registry, sides, lengths):
    """One broadcast hash join per length, longest first: no shuffle, no row copies."""
    for side, (family, hi, lo, *own_length) in sides.items():
        found: dict[int, list[Column]] = {4: [], 6: []}
        for fam, length, _ in lengths:
            mask_hi, mask_lo = net.mask_halves(fam, length)
            name = f"_{side}_{fam}_{length}"
            same = F.col(family) == fam
            if own_length:
                same = same & (F.col(own_length[0]) >= length)
            keys = {"lo": F.when(same, F.col(lo).bitwiseAND(F.lit(mask_lo)))}
            if fam == 6:
                keys["hi"] = F.when(same, F.col(hi).bitwiseAND(F.lit(mask_hi)))
                if length <= 64:  # the low half is masked away
                    del keys["lo"]
            table = registry.where((F.col("family") == fam) & (F.col("len") == length)).select(
                *[F.col(f"n_{half}").alias(f"{name}_{half}") for half in keys], F.col("entry").alias(name)
            )
            condition = None
            for half, expression in keys.items():
                term = expression == F.col(f"{name}_{half}")
                condition = term if condition is None else condition & term
            df = df.join(F.broadcast(table), condition, "left").drop(*[f"{name}_{half}" for half in keys])
            found[fam].append(F.col(name))
        matches = found[4] + found[6]  # an address has one family, so the order between them is free
        best = F.coalesce(*matches) if matches else F.lit(None)
        df = df.withColumn(side, best).drop(*[f"_{side}_{f}_{n}" for f, n, _ in lengths])
    return df


def _by_distinct_address(df, registry, sides, lengths, broadcast_rows):
    """For registries too large or too varied to chain: match each distinct address once.

    Distinct addresses take one pre-aggregated shuffle; the result joins back
    through a salted key.
    """
    addresses = None
    for family, hi, lo, *own_length in sides.values():
        longest = F.col(own_length[0]).cast("int") if own_length else F.lit(128)
        part = df.select(F.col(family).alias("a_family"), F.col(hi).alias("a_hi"), F.col(lo).alias("a_lo"), longest.alias("a_len"))
        addresses = part if addresses is None else addresses.unionByName(part)
    addresses = addresses.where("a_family IS NOT NULL AND a_hi IS NOT NULL AND a_lo IS NOT NULL").distinct()
    choices = F.when(
        F.col("a_family") == 4, F.array(*[F.lit(n) for f, n, _ in lengths if f == 4]).cast("array<int>")
    ).otherwise(F.array(*[F.lit(n) for f, n, _ in lengths if f == 6]).cast("array<int>"))
    probes = addresses.withColumn("len", F.explode(choices)).where("len <= a_len")
    n_hi, n_lo = net.masked(F.col("a_family"), F.col("a_hi"), F.col("a_lo"), F.col("len"))
    probes = probes.withColumn("n_hi", n_hi).withColumn("n_lo", n_lo).withColumn("family", F.col("a_family"))
    small = sum(rows for _, _, rows in lengths) <= broadcast_rows
    hits = lookup_join(
        probes, registry, ["family", "len", "n_hi", "n_lo"], "inner", salt_from=["a_hi", "a_lo"], small=small
    )
    matched = hits.groupBy("a_family", "a_hi", "a_lo", "a_len").agg(F.max_by("entry", "len").alias("entry"))
    for side, (family, hi, lo, *own_length) in sides.items():
        longest = F.col(own_length[0]).cast("int") if own_length else F.lit(128)
        table = matched.select(
            F.col("a_family").alias(f"_{side}_f"), F.col("a_hi").alias(f"_{side}_h"),
            F.col("a_lo").alias(f"_{side}_l"), F.col("a_len").alias(f"_{side}_n"), F.col("entry").alias(side),
        ).withColumn("_salt", F.explode(F.sequence(F.lit(0), F.lit(SALTS - 1))))
        plain = [c for c, t in df.dtypes if not t.startswith(("map", "struct", "array"))]
        df = df.withColumn("_salt", F.pmod(F.xxhash64(*plain), F.lit(SALTS)).cast("int"))
        condition = (
            (F.col(family) == F.col(f"_{side}_f")) & (F.col(hi) == F.col(f"_{side}_h"))
            & (F.col(lo) == F.col(f"_{side}_l")) & (longest == F.col(f"_{side}_n")) & (df["_salt"] == table["_salt"])
        )
        df = df.join(table, condition, "left").drop(f"_{side}_f", f"_{side}_h", f"_{side}_l", f"_{side}_n", df["_salt"], table["_salt"])
    return df


def covering(requests: DataFrame, networks: DataFrame, cols: tuple[str, str, str, str], kind: str,
             extra_on: list[str] | None = None) -> DataFrame:
    """Semi/anti join of prefixes against networks that contain them.

    ``cols`` are the (family, hi, lo, length) columns of ``requests``. The test is
    an equi-join per registered length, never a comparison of all pairs.
    """
    family, hi, lo, length = cols
    extra_on = extra_on or []
    lengths = lengths_of(networks)
    if not lengths:
        return requests if kind == "anti" else requests.where(F.lit(False))
    legal = networks.where(F.col("prefix_len") <= net.width(F.col("family")))
    n_hi, n_lo = net.masked(F.col("family"), F.col("net_hi"), F.col("net_lo"), F.col("prefix_len"))
    registry = legal.select(
        F.col("family").alias("c_family"), F.col("prefix_len").alias("c_len"), n_hi.alias("c_hi"),
        n_lo.alias("c_lo"), *[F.col(c).alias(f"c_{c}") for c in extra_on],
    ).distinct()
    choices = F.array(*[F.struct(F.lit(f).alias("f"), F.lit(n).alias("n")) for f, n, _ in lengths])
    key = "_request"
    keyed = requests.withColumn(key, F.struct(*[F.col(c) for c in {*cols, *extra_on}]))
    probes = (
        keyed.select(key).distinct().withColumn("_try", F.explode(choices))
        .where((F.col("_try.f") == F.col(f"{key}.{family}")) & (F.col("_try.n") <= F.col(f"{key}.{length}")))
    )
    at = lambda c: F.col(f"{key}.{c}")
    p_hi, p_lo = net.masked(at(family), at(hi), at(lo), F.col("_try.n"))
    probes = probes.select(
        key, at(family).alias("c_family"), F.col("_try.n").alias("c_len"), p_hi.alias("c_hi"), p_lo.alias("c_lo"),
        *[at(c).alias(f"c_{c}") for c in extra_on],
    )
    on = ["c_family", "c_len", "c_hi", "c_lo", *[f"c_{c}" for c in extra_on]]
    held = lookup_join(probes, registry, on, "left_semi", salt_from=["c_hi", "c_lo"]).select(key).distinct()
    how = {"semi": "left_semi", "anti": "left_anti"}[kind]
    return keyed.join(held, key, how).drop(key)


def nested_pairs(entries: DataFrame, keep: list[str]) -> DataFrame:
    """Pairs of networks where one lies inside a shorter one: ``inner_*`` and ``outer_*``.

    Each entry looks itself up once per registered shorter length.
    """
    hi, lo = net.masked(F.col("family"), F.col("net_hi"), F.col("net_lo"), F.col("prefix_len"))
    table = entries.select("family", "prefix_len", hi.alias("hi"), lo.alias("lo"), *keep)
    lengths = table.select("family", F.col("prefix_len").alias("n")).distinct()
    probes = table.join(F.broadcast(lengths), "family").where("n < prefix_len")  # at most 162 lengths
    p_hi, p_lo = net.masked(F.col("family"), F.col("hi"), F.col("lo"), F.col("n"))
    inner = probes.select("family", "n", p_hi.alias("p_hi"), p_lo.alias("p_lo"), F.col("prefix_len").alias("inner_len"),
                          *[F.col(c).alias(f"inner_{c}") for c in keep])
    outer = table.select("family", F.col("prefix_len").alias("n"), F.col("hi").alias("p_hi"), F.col("lo").alias("p_lo"),
                         *[F.col(c).alias(f"outer_{c}") for c in keep])
    salt_from = [f"inner_{c}" for c in keep]
    return lookup_join(inner, outer, ["family", "n", "p_hi", "p_lo"], "inner", salt_from=salt_from).withColumnRenamed("n", "outer_len")


def _two_owners(df: DataFrame, group: list[str]) -> DataFrame:
    """Per group the least ``value`` of each of the two owners that have the least ones.

    That answers what the least value of anybody else is, whoever asks.
    """
    return first_rows(df.groupBy(*group, "owner").agg(F.min("value").alias("value")), group, [F.col("value"), F.col("owner")], 2).drop("_rank")


def earliest_of_others(entries: DataFrame, value: str, owner: str) -> DataFrame:
    """The entries with ``other``: the least ``value`` among networks of another owner that lie inside
    theirs or around it; NULL if there is none. Equal networks do not count.

    No pairs of entries are made: a network is two rows, however often it is listed, and
    meets its registered wider networks, so rows grow with networks and lengths alone.
    """
    hi, lo = net.masked(F.col("family"), F.col("net_hi"), F.col("net_lo"), F.col("prefix_len"))
    at = ["family", "n", "hi", "lo"]
    table = entries.withColumns({"n": F.col("prefix_len"), "hi": hi, "lo": lo, "value": F.col(value), "owner": F.col(owner)})
    nets = _two_owners(table.where(F.col("owner").isNotNull()), at)
    around = ["family", "w_n", "w_hi", "w_lo"]
    wide = dict(zip(at, around, strict=True))
    lengths = nets.select("family", F.col("n").alias("w_n")).distinct()
    probes = nets.select(*at).distinct().join(F.broadcast(lengths), "family").where("w_n < n")  # at most 162 lengths
    w_hi, w_lo = net.masked(F.col("family"), F.col("hi"), F.col("lo"), F.col("w_n"))
    probes = probes.withColumn("w_hi", w_hi).withColumn("w_lo", w_lo)
    wider = nets.withColumnsRenamed(wide)
    links = lookup_join(probes, wider.select(*around).distinct(), around, "left_semi")
    outside = lookup_join(links, wider, around, "inner").select(*at, "owner", "value")
    inside = lookup_join(links, nets, at, "inner").select(*[F.col(w).alias(c) for c, w in wide.items()], "owner", "value")
    near = _two_owners(outside.unionByName(inside), at)
    found = near.groupBy(*at).agg(F.array_sort(F.collect_list(F.struct("value", "owner"))).alias("_near"))  # two at most
    met = lookup_join(table.drop("value"), found, at, "left")
    other = F.get(F.filter("_near", lambda e: e["owner"] != F.col("owner")), F.lit(0))["value"]
    return met.select(*entries.columns, other.alias("other"))


def first_rows(df: DataFrame, group: list[str], order: list, keep: int, rank: str = "_rank", slices: int = 64) -> DataFrame:
    """The first ``keep`` rows of each group, with their position in ``rank``.

    Ranked in hash slices of a group first, so that a huge group is never sorted
    in one task; at most ``slices * keep`` rows of a group reach the second step.
    """
    plain = [c for c, t in df.dtypes if not t.startswith(("map", "struct", "array"))]
    sliced = df.withColumn("_slice", F.pmod(F.xxhash64(*plain), F.lit(slices)))
    first = Window.partitionBy(*group, "_slice").orderBy(*order)
    kept = sliced.withColumn("_r", F.row_number().over(first)).where(F.col("_r") <= keep).drop("_r", "_slice")
    second = Window.partitionBy(*group).orderBy(*order)
    return kept.withColumn(rank, F.row_number().over(second)).where(F.col(rank) <= keep)


def mark_first(df: DataFrame, keys: list, order: list, slices: int = 64) -> DataFrame:
    """Add ``_first``: true on exactly one row of each group, the first by ``order``.

    Works where one group of copies holds a large part of all rows: they are
    ranked within slices by source partition, then only the slices' own firsts
    against each other.
    """
    sliced = df.withColumn("_slice", F.pmod(F.spark_partition_id(), F.lit(slices)))
    inside = Window.partitionBy(*keys, "_slice").orderBy(*order)
    ranked = sliced.withColumn("_ahead", F.row_number().over(inside) == 1)
    apart = F.when(F.col("_ahead"), F.lit(-1)).otherwise(F.col("_slice"))
    across = Window.partitionBy(*keys, apart).orderBy(*order)
    return ranked.withColumn("_first", F.col("_ahead") & (F.row_number().over(across) == 1)).drop("_slice", "_ahead")
