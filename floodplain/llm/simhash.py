"""SimHash fingerprints, and the documents whose fingerprints nearly agree."""

from __future__ import annotations

import itertools
import math
from collections.abc import Callable
from functools import partial

import numpy as np
import pyarrow as pa
import xxhash
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T

from floodplain.llm.passages import FILTER_BITS, band_filter
from floodplain.llm.shared import components, group_min, list_array, map_texts, slices, texts_of
from floodplain.llm.tiles import batches_of, build_tiles, compare_tiles
from floodplain.session import cut_lineage

SEED = 42
TILE = 1024
# Digits of a cell are packed eight bits apart; steps below zero never meet a
# digit in use, since no digit comes near 256.
DIGIT = 256
#: Shingles that a tile of sets may hold, if it has more than one row, and rows it may have.
SET_TILE, SET_ROWS = 1 << 15, 128
#: Rows of shingle sets in an Arrow batch.
SETS_AT_ONCE = 256


def shingle_hashes(text: str, words: int, seed: int) -> np.ndarray:
    """XXH64 of every run of ``words`` words, repeats included; of all words where there are fewer."""
    found = text.encode().lower().split()
    if not found:
        return np.zeros(0, np.uint64)
    if len(found) < words:
        runs = [b" ".join(found)]
    else:
        runs = map(b" ".join, zip(*(found[k:] for k in range(words)), strict=False))
    return np.array(list(map(partial(xxhash.xxh64_intdigest, seed=seed), runs)), np.uint64)


def fingerprint(hashes: np.ndarray) -> int:
    """Bit by bit, whether more than half of the hashes have it; signed 64 bits."""
    if not len(hashes):
        return 0
    counts = np.zeros(64, np.int64)
    for at in range(0, len(hashes), 1 << 16):
        part = hashes[at : at + (1 << 16)]
        counts += np.unpackbits(part.view(np.uint8).reshape(-1, 8), axis=1, bitorder="little").sum(0, dtype=np.int64)
    return int(np.packbits(counts * 2 > len(hashes), bitorder="little").view(np.int64)[0])


def set_hash(hashes: np.ndarray) -> int:
    """Signed 64 bits that stand for a sorted set of hashes."""
    return int(np.uint64(xxhash.xxh64_intdigest(hashes.tobytes())).view(np.int64))


def fingerprints(docs: DataFrame, words: int = 3, parts: int = 1, id_col: str = "doc_id", text_col: str = "text", sets: bool = False) -> DataFrame:
    """``(id, f0 … BIGINT, shingles)`` of whole texts: 64 bits for each part, from seeds 42, 43, …

    A-Z are lowered; words are runs of anything but ASCII white space. A null,
    empty or blank text has fingerprint zero and no shingles. With ``sets`` each
    different shingle counts once, and ``alike`` stands for their set.
    """

    def hashes_of(text: str) -> list[np.ndarray]:
        found = [shingle_hashes(text, words, SEED + k) for k in range(parts)]
        if sets:
            once = np.unique(found[0], return_index=True)[1]
            found = [hashes[once] for hashes in found]
        return found

    def work(texts: list[str]) -> dict[str, pa.Array]:
        made: dict[str, list[int]] = {name: [] for name in kinds}
        for text in texts:
            found = hashes_of(text)
            for k, hashes in enumerate(found):
                made[f"f{k}"].append(fingerprint(hashes))
            made["shingles"].append(len(found[0]))
            if sets:
                made["alike"].append(set_hash(found[0]))
        return {name: pa.array(column, pa.int64()) for name, column in made.items()}

    kinds = {**{f"f{k}": T.LongType() for k in range(parts)}, "shingles": T.LongType(), **({"alike": T.LongType()} if sets else {})}
    return map_texts(docs, id_col, text_col, kinds, work)


def _half(digits: list[list[int]], allowed) -> list[int]:
    """Packed steps from a cell to its neighbours, one of each two opposite ones, the cell itself left out."""
    steps = []
    for step in itertools.product(*digits):
        lead = next((s for s in reversed(step) if s), 0)
        if lead > 0 and allowed(step):
            steps.append(sum(s * DIGIT**k for k, s in enumerate(step)))
    return steps


def near_groups(prints: DataFrame, radius: int, ratio: float | None = None, id_col: str = "doc_id", tile: int = TILE, extra: tuple[str, ...] = (), confirm: Callable | None = None) -> DataFrame:
    """``(id, f0 …, shingles, extra …, component_id)``: the smallest id that links of at most ``radius`` bits reach.

    Fingerprints are compared exactly, tile against tile, by exclusive-or and bit
    counts. A tile meets another only if their population counts allow ``radius``:
    up to radius 4 the counts of the four 16-bit words, whose differences add up
    to no more than the distance, beyond it the count of the first 64 bits. With
    ``ratio`` a link also needs that share between the two numbers of shingles,
    and tiles are kept apart by it too: what is at least that similar is at
    least that alike in length, and so short that this means equal must be equal. Equal fingerprints are one row with its smallest id, so
    copies cost nothing; of a tile pair only a spanning set of links leaves the
    task. Rows with the same id are one node; a row with a null id joins the
    component of an equal fingerprint, or has none. Where ``prints`` has ``alike``,
    equal fingerprints of different sets are different rows. ``confirm`` gets the
    components so found as ``(node, component)``, the compared rows, and the
    function that finds links between two tiles; it returns the components to use.
    """
    parts = [name for name in prints.columns if name.startswith("f") and name[1:].isdigit()]
    key = [*parts, "shingles"] if ratio else parts
    if "alike" in prints.columns:
        key = [*key, "alike"]
    prints = cut_lineage(prints.select(id_col, *dict.fromkeys([*key, "shingles"]), *extra))
    classes = prints.groupBy(*key).agg(F.min(id_col).alias("rep"))
    rows = classes.where("rep IS NOT NULL")

    def ones(column: Column) -> Column:
        return F.bit_count(column).cast("long")

    if radius <= 4:
        digits = [ones(F.shiftrightunsigned(F.col("f0"), 16 * k).bitwiseAND(F.lit(0xFFFF))) for k in range(4)]
        reach = [list(range(-radius, radius + 1))] * 4
    else:
        digits = [F.floor(ones(F.col("f0")) / (radius + 1)).cast("long")]
        reach = [[-1, 0, 1]]
    pops = len(digits)
    if ratio:
        digits.append(length_digit(F.col("shingles"), ratio))
        reach = [*reach, [-1, 0, 1]]
    steps = _half(reach, lambda step: pops == 1 or sum(map(abs, step[:pops])) <= radius)
    cell = sum((digit * DIGIT**k for k, digit in enumerate(digits[1:], 1)), digits[0])

    def hits(a: dict, b: dict) -> np.ndarray:
        n, found = len(b["f0"]), []
        rows_at_once = max(1, (1 << 18) // n)
        for at in range(0, len(a["f0"]), rows_at_once):
            # At most 64 bits a part, so one byte holds the sum of three parts.
            apart = sum((np.bitwise_count(a[part][at : at + rows_at_once, None] ^ b[part][None, :]) for part in parts[1:]),
                        np.bitwise_count(a["f0"][at : at + rows_at_once, None] ^ b["f0"][None, :]))
            found.append(np.flatnonzero(apart <= radius) + at * n)
        flat = np.concatenate(found)
        if ratio and len(flat):
            x, y = a["shingles"][flat // n], b["shingles"][flat % n]
            short = np.minimum(x, y)
            i, j = flat // n, flat % n
            equal = np.all([a[part][i] == b[part][j] for part in parts], axis=0)
            flat = flat[(short >= ratio * np.maximum(x, y)) & (equal | (short * (1 - ratio) + 1e-9 >= ratio))]
        return flat

    payload = [*parts, *(["shingles"] if ratio else [])]
    tiles = build_tiles(rows.withColumn("cell", cell), "cell", "rep", payload, tile)
    found = compare_tiles(tiles, "rep", {**{part: "u8" for part in parts}, **({"shingles": "i8"} if ratio else {})}, hits, steps, slots=1 if pops > 1 else 8)
    labels = components(found.where("node <> root"), "node", "root")
    if confirm:
        labels = confirm(labels, rows, hits)
    named = group_min(classes, labels, "rep")
    named = named.select(*(F.col(name).alias(f"_{name}") for name in key), F.col("component").alias("component_id"))
    equal = [prints[name] == named[f"_{name}"] for name in key]
    return prints.join(named, equal, "left").select(id_col, *dict.fromkeys([*key, "shingles"]), *extra, "component_id")


def simhash_groups(docs: DataFrame, words: int = 3, parts: int = 1, radius: int = 3, ratio: float | None = None, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """Fingerprint whole texts and group those that nearly agree; see ``fingerprints`` and ``near_groups``."""
    return near_groups(fingerprints(docs, words, parts, id_col, text_col), radius, ratio, id_col)


def length_digit(column: Column, ratio: float) -> Column:
    """The power of ``1 / ratio`` that a number of shingles reaches: numbers within ``ratio`` of each other are a step apart at most."""
    return F.floor(F.log(F.greatest(column, F.lit(1)).cast("double")) / -math.log(ratio) + 1e-9).cast("long")


def shingle_sets(docs: DataFrame, wanted: DataFrame, words: int) -> DataFrame:
    """``(rep, alike, set)`` of the texts whose id and set are in ``wanted``, each once; ``docs`` has ``id`` and ``text``.

    Other texts are left out by a bit filter of 8 MB before anything is shuffled.
    """
    sent = docs.sparkSession.sparkContext.broadcast(band_filter(wanted.select(F.xxhash64("rep").alias("band"))))

    def run(batches):
        bits = sent.value
        for batch in batches:
            spot = batch.column("spot").to_numpy().view(np.uint64) >> np.uint64(64 - FILTER_BITS)
            there = bits[spot >> np.uint64(5)] >> (spot & np.uint64(31)).astype(np.uint32) & np.uint32(1)
            for part in slices([batch.filter(pa.array(there.astype(bool)))]):
                sets = [np.unique(shingle_hashes(text, words, SEED)) for text in texts_of(part)]
                if sets:
                    yield pa.RecordBatch.from_arrays(
                        [part.column("id"), pa.array([set_hash(x) for x in sets], pa.int64()), list_array(np.concatenate(sets).view(np.int64), np.array([len(x) for x in sets]))],
                        names=["id", "alike", "set"])

    made = docs.where("id IS NOT NULL").select("id", F.xxhash64("id").alias("spot"), "text").mapInArrow(run, "id long, alike long, set array<long>")
    mine = wanted.select(F.col("rep").alias("_rep"), F.col("alike").alias("_alike"))
    met = made.join(mine, (F.col("id") == F.col("_rep")) & (F.col("alike") == F.col("_alike")), "left_semi")
    return met.groupBy(F.col("id").alias("rep"), "alike").agg(F.first("set").alias("set"))


def set_hits(near, ratio: float):
    """Of the pairs that ``near`` finds in two tiles, those whose sets have at least Jaccard ``ratio``.

    A pair that others already connect is not compared: what connects is the same.
    """

    def hits(a: dict, b: dict) -> np.ndarray:
        flat = near(a, b)
        if not len(flat):
            return flat
        m, n = len(a["f0"]), len(b["f0"])
        sets = [part for side in (a, b) for part in np.split(side["set"], np.cumsum(side["shingles"])[:-1])]
        low = list(range(m + n))

        def find(x: int) -> int:
            while low[x] != x:
                low[x] = x = low[low[x]]
            return x

        out = []
        for pair in flat.tolist():
            i, j = pair // n, m + pair % n
            x, y = find(i), find(j)
            if x == y:
                continue
            short, long = sorted((sets[i], sets[j]), key=len)
            if len(short):
                at = np.minimum(np.searchsorted(long, short), len(long) - 1)
                both = int(np.count_nonzero(long[at] == short))
                if both + 1e-9 < ratio * (len(short) + len(long) - both):
                    continue
            low[max(x, y)] = min(x, y)
            out.append(pair)
        return np.array(out, np.int64)

    return hits


def exact_components(docs: DataFrame, words: int, parts: int, ratio: float):
    """For ``near_groups``: components of the links that also have Jaccard ``ratio`` between their sets of shingles.

    Only within the components found by fingerprints are sets fetched and compared,
    tile against tile, where lengths allow it.
    """

    def confirm(labels: DataFrame, rows: DataFrame, near) -> DataFrame:
        prints = [f"f{k}" for k in range(parts)]
        members = cut_lineage(rows.join(labels, F.col("rep") == F.col("node")).select("rep", *prints, "shingles", "alike", "component"))
        sets = shingle_sets(docs, members, words).withColumnRenamed("rep", "_rep").withColumnRenamed("alike", "_alike")
        held = members.join(sets, (F.col("rep") == F.col("_rep")) & (F.col("alike") == F.col("_alike")))
        # Components that share a cell are only compared for nothing.
        held = held.withColumn("cell", F.shiftleft(F.xxhash64("component"), 8) + length_digit(F.col("shingles"), ratio))

        def size(cell: int) -> int:
            return max(1, min(SET_ROWS, int(SET_TILE * ratio ** (cell % DIGIT + 1))))

        with batches_of(docs.sparkSession, SETS_AT_ONCE):
            tiles = build_tiles(held, "cell", "rep", [*prints, "shingles", "set"], size)
        found = compare_tiles(tiles, "rep", {**{name: "u8" for name in prints}, "shingles": "i8", "set": "u8"}, set_hits(near, ratio), [1], slots=8, flat=("set",))
        return components(found.where("node <> root"), "node", "root")

    return confirm


def drop_near_copies(docs: DataFrame, words: int = 5, parts: int = 2, radius: int = 30, ratio: float = 0.8, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """The rows and columns of documents, of each group of near copies one.

    Near copies are texts whose sets of five-word shingles have Jaccard similarity
    ``ratio`` or more, counted exactly, and chains of such texts. Pairs to compare are
    those whose fingerprints, by default of 128 bits over the same sets, are at most
    ``radius`` apart: at similarity 0.8 exactly that is true of 99 pairs in a hundred
    and more, above it of nearly all. The row with the smallest id stays; of several with that id the one whose text hashes lowest, once. Rows
    without an id give way to an equal one with an id, else one of them stays.
    Empty texts are one group. The one shuffle of whole texts is the join that
    picks the survivors.
    """
    mine = docs.select(F.struct(F.col(id_col).alias("id"), F.xxhash64(text_col).alias("h")).alias("row"), F.col(text_col).alias("text"))
    prints = fingerprints(mine, words, parts, "row", "text", sets=True).select("row.*", *(f"f{k}" for k in range(parts)), "shingles", "alike")
    confirm = exact_components(docs.select(F.col(id_col).alias("id"), F.col(text_col).alias("text")), words, parts, ratio)
    groups = near_groups(prints, radius, ratio, "id", extra=("h",), confirm=confirm).where("id <=> component_id")
    unnamed = F.when(F.col("id").isNull(), F.struct(*(f"f{k}" for k in range(parts)), "shingles", "alike"))
    stay = groups.groupBy("id", unnamed.alias("unnamed")).agg(F.min("h").alias("h")).select(F.col("id").alias("stays"), F.col("h").alias("stays_h"))
    rows = docs.select(F.struct("*").alias("doc"), F.col(id_col).alias("id"), F.xxhash64(text_col).alias("h"))
    kept = rows.join(stay, F.col("h").eqNullSafe(F.col("stays_h")) & F.col("id").eqNullSafe(F.col("stays")), "left_semi")
    return kept.dropDuplicates(["h", "id"]).select("doc.*")  # repeats meet in their own task first
