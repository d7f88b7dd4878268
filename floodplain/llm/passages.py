"""Repeated passages: paragraphs under MinHash banding, exact Jaccard, clusters by components."""

from __future__ import annotations

import uuid
from collections.abc import Iterator
from itertools import islice

import numpy as np
import pyarrow as pa
import xxhash
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F
from pyspark.sql import types as T

from floodplain.llm.pieces import numbering
from floodplain.llm.shared import components, list_array, ragged, slices, texts_of
from floodplain.llm.tiles import build_tiles, compare_tiles
from floodplain.session import checkpoint_dir, cut_lineage

SHINGLE = 5
SIMILARITY = 0.8
#: Five bands of two minima: 99.4 % of pairs at similarity 0.8 and 99.98 % at 0.9 meet.
BANDS, ROWS = 5, 2
#: Shorter lines are too likely to be boilerplate to be compared.
MIN_LINE = 20
#: Runs of RUN words are looked for in other documents. Of every PASSAGE words in a
#: row, line ends among them or not, one run is taken, by its words alone, so that
#: any two places that share so many words have a run in common. Neighbouring taken
#: runs overlap, as no more than PASSAGE - RUN words lie between their beginnings.
RUN, PASSAGE = 32, 51
WINDOW = PASSAGE - RUN + 1
TILE = 128
#: Tiles of a band that one task compares others with.
TILES_A_SLOT = 16
FILTER_BITS = 26
REMEMBERED = 200_000

_MIXERS = np.random.default_rng(20260101).integers(1, 1 << 63, BANDS * ROWS, dtype=np.uint64) | np.uint64(1)


class Words:
    """A 64-bit hash of each distinct word, remembered by a worker."""

    def __init__(self):
        self.forget()

    def forget(self) -> None:
        self.index = numbering()
        self.hashes = np.zeros(0, np.uint64)

    def look(self, words: list[bytes]) -> np.ndarray:
        if len(self.index) > REMEMBERED:
            self.forget()
        before = len(self.index)
        numbers = np.fromiter(map(self.index.__getitem__, words), np.int64, len(words))
        if len(self.index) > before:
            new = list(islice(self.index, before, None))
            self.hashes = np.r_[self.hashes, np.fromiter(map(xxhash.xxh64_intdigest, new), np.uint64, len(new))]
        return self.hashes[numbers]


_WORDS = Words()


def sliding(values: np.ndarray, width: int, least: np.ufunc, fill: np.uint64) -> np.ndarray:
    """The least (or greatest) of every ``width`` values in a row, at constant work a value: of the ends and beginnings of two blocks."""
    padded = np.full(-(-len(values) // width) * width, fill, np.uint64)
    padded[: len(values)] = values
    blocks = padded.reshape(-1, width)
    from_left = least.accumulate(blocks, 1).ravel()
    to_right = least.accumulate(blocks[:, ::-1], 1)[:, ::-1].ravel()
    n = len(values) - width + 1
    return least(to_right[:n], from_left[width - 1 : width - 1 + n])


def run_hashes(hashes: np.ndarray) -> np.ndarray:
    """64 bits for the RUN words that begin at each place, by doubling."""
    out, size = hashes, 1
    while size < RUN:
        n = len(out) - size
        out = (out[:n] ^ (out[:n] >> np.uint64(29))) * np.uint64(0x9E3779B97F4A7C15) + out[size:] * np.uint64(0xBF58476D1CE4E5B9)
        out ^= out >> np.uint64(32)
        size *= 2
    return out


def anchors(hashes: np.ndarray, begin: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """``(places, hashes)`` of the runs that are taken in texts that start at ``begin``: the lowest hash of each window of runs.

    A window is the runs within PASSAGE words, or within a text that is shorter. As the
    hash is of the whole run, equal windows give equal runs; equal ones of a window are all taken.
    """
    n = len(hashes) - RUN + 1
    if n < 1:
        return np.zeros(0, np.int64), np.zeros(0, np.uint64)
    value = run_hashes(hashes)
    end = np.r_[begin[1:], len(hashes)]
    runs = np.maximum(end - begin - RUN + 1, 0)
    taken = np.zeros(n, bool)
    if n >= WINDOW:
        low = sliding(value, WINDOW, np.minimum, np.uint64(2**64 - 1))
        # A window counts if all its runs are runs of one text.
        inside = np.zeros(len(low), bool)
        inside[ragged(begin, np.maximum(runs - WINDOW + 1, 0))] = True
        low[~inside] = 0
        # A run is the lowest of some window if it equals the highest minimum of the windows that hold it.
        around = np.r_[np.zeros(WINDOW - 1, np.uint64), low, np.zeros(WINDOW - 1, np.uint64)]
        covered = np.r_[np.zeros(WINDOW - 1, bool), inside, np.zeros(WINDOW - 1, bool)]
        taken = (sliding(around, WINDOW, np.maximum, np.uint64(0)) == value) & (sliding(covered.astype(np.uint64), WINDOW, np.maximum, np.uint64(0)) > 0)
    short = np.flatnonzero((runs > 0) & (runs < WINDOW))
    at, size = ragged(begin[short], runs[short]), runs[short]
    if len(at):
        low = np.minimum.reduceat(value[at], np.cumsum(size) - size)
        taken[at] = value[at] == np.repeat(low, size)
    places = np.flatnonzero(taken)
    return places, value[places]


def paragraphs_of(texts: list[str], with_runs: bool = True) -> dict[str, np.ndarray]:
    """Word hashes of whole texts, A-Z lowered, with the lines of at least MIN_LINE words and the runs that are taken.

    ``line`` and ``run`` are ``(first word, size, text)`` over all words of the
    slice, ``run_id`` the runs' hashes; ``begin`` is each text's first word. Lines end at line
    feeds; runs take them as any other space.
    """
    words: list[bytes] = []
    ends, begins = [], []
    for text in texts:
        begins.append(len(words))
        for line in text.encode().lower().split(b"\n"):
            mine = line.split()
            if mine:
                words += mine
                ends.append(len(words))
    hashes = _WORDS.look(words)
    end, begin = np.array(ends, np.int64), np.array(begins, np.int64)
    first = np.r_[0, end[:-1]] if len(end) else end
    size = end - first
    long = size >= MIN_LINE
    at, run_id = anchors(hashes, begin) if with_runs else (np.zeros(0, np.int64), np.zeros(0, np.uint64))
    owner = lambda places: np.searchsorted(begin, places, "right") - 1
    return {"hashes": hashes, "begin": begin, "line": (first[long], size[long], owner(first[long])), "run": (at, np.full(len(at), RUN, np.int64), owner(at)), "run_id": run_id.view(np.int64)}


def shingles_of(hashes: np.ndarray, first: np.ndarray, size: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """Hashes of every run of five words of each paragraph (of all its words if it has fewer), and how many."""
    n = np.maximum(size - SHINGLE + 1, 1)
    at = ragged(first, n)
    out = np.zeros(len(at), np.uint64)
    left = np.repeat(size, n) - (at - np.repeat(first, n))
    for k in range(SHINGLE):
        inside = left > k
        out[inside] = (out[inside] ^ hashes[at[inside] + k]) * np.uint64(0x9E3779B97F4A7C15)
        out ^= out >> np.uint64(32)
    return out, n


def paragraph_ids(hashes: np.ndarray, first: np.ndarray, size: np.ndarray) -> np.ndarray:
    """64 bits that stand for a paragraph's words in their order."""
    at = ragged(first, size)
    place = (at - np.repeat(first, size)).astype(np.uint64)
    mixed = (hashes[at] + place * np.uint64(0xD6E8FEB86659FD93)) * np.uint64(0x9E3779B97F4A7C15)
    mixed = (mixed ^ (mixed >> np.uint64(29))) * np.uint64(0xBF58476D1CE4E5B9)
    starts = np.cumsum(size) - size
    total = np.add.reduceat(mixed ^ (mixed >> np.uint64(32)), starts) if len(size) else mixed
    return (total ^ size.astype(np.uint64)).view(np.int64)


def band_keys(shingles: np.ndarray, n: np.ndarray) -> np.ndarray:
    """``(paragraphs, bands)``: each band's key from the minima of its rows."""
    starts = np.cumsum(n) - n
    keys = np.zeros((len(n), BANDS), np.uint64)
    for k, mixer in enumerate(_MIXERS):
        mixed = (shingles ^ (shingles >> np.uint64(31))) * mixer
        low = np.minimum.reduceat(mixed ^ (mixed >> np.uint64(33)), starts)
        band = k // ROWS
        keys[:, band] = (keys[:, band] ^ low) * np.uint64(0x9E3779B97F4A7C15) + np.uint64(band)
    return keys.view(np.int64)


def stored(rows: DataFrame, name: str) -> DataFrame:
    """Written to a folder of its own beside the checkpoints, and read back: pruned columns, no recomputation."""
    path = f"{checkpoint_dir(rows.sparkSession)}/{name}-{uuid.uuid4().hex}"
    rows.write.parquet(path)
    return rows.sparkSession.read.parquet(path)


def paragraph_rows(docs: DataFrame, id_col: str, text_col: str) -> DataFrame:
    """``(text_no, doc, copy, first_word, words, par, bands)``: a row for each line and run, those of runs without bands.

    ``copy`` tells texts of one id apart, ``text_no`` every row of ``docs``. Store the rows before
    they are used: the numbers are those of one run.
    """
    schema = T.StructType([T.StructField("text_no", T.LongType()), T.StructField("doc", docs.schema[id_col].dataType), *(T.StructField(n, k) for n, k in (("copy", T.LongType()), ("first_word", T.IntegerType()), ("words", T.IntegerType()), ("par", T.LongType()), ("bands", T.ArrayType(T.LongType()))))])

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        from pyspark import TaskContext

        count = TaskContext.get().partitionId() << 40
        for batch in slices(batches, "text"):
            made = paragraphs_of(texts_of(batch, "text"))
            count += batch.num_rows
            lines = len(made["line"][0])
            first, size, owner = (np.concatenate(part) for part in zip(made["line"], made["run"], strict=True))
            if not len(first):
                continue
            line, line_size = first[:lines], size[:lines]
            par = np.r_[paragraph_ids(made["hashes"], line, line_size), made["run_id"]]
            keys = band_keys(*shingles_of(made["hashes"], line, line_size)) if lines else np.zeros((0, BANDS), np.int64)
            offsets = np.minimum(np.arange(len(first) + 1), lines) * BANDS
            bands = pa.ListArray.from_arrays(pa.array(offsets.astype(np.int32)), pa.array(keys.reshape(-1)), mask=pa.array(np.arange(len(first)) >= lines))
            take = pa.array(owner)
            yield pa.RecordBatch.from_arrays(
                [pa.array(count - batch.num_rows + owner), batch.column("doc").take(take), batch.column("copy").take(take), pa.array((first - made["begin"][owner]).astype(np.int32)), pa.array(size.astype(np.int32)), pa.array(par), bands],
                names=["text_no", "doc", "copy", "first_word", "words", "par", "bands"])

    rows = docs.select(F.col(id_col).alias("doc"), F.xxhash64(text_col).alias("copy"), F.col(text_col).alias("text"))
    return rows.mapInArrow(run, schema)


def distinct_lines(texts: list[str]) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """``(par, shingles, shingles per line)`` of the different lines of a slice, so that copies are thinned before they move."""
    made = paragraphs_of(texts, with_runs=False)
    first, size, _ = made["line"]
    if not len(first):
        return np.zeros(0, np.int64), np.zeros(0, np.uint64), np.zeros(0, np.int64)
    par, once = np.unique(paragraph_ids(made["hashes"], first, size), return_index=True)
    return par, *shingles_of(made["hashes"], first[once], size[once])


def band_filter(bands: DataFrame) -> np.ndarray:
    """One bit for the top bits of each band key: 8 MB whatever the input, so that most others are left out before a shuffle."""
    spot = F.shiftrightunsigned("band", 64 - FILTER_BITS)
    words = bands.select(spot.alias("spot")).groupBy(F.expr("int(spot div 32)").alias("at")).agg(F.bit_or(F.expr("shiftleft(1L, int(spot % 32))")).alias("bits")).toArrow()
    out = np.zeros(1 << (FILTER_BITS - 5), np.uint32)
    out[words["at"].to_numpy()] = words["bits"].to_numpy().astype(np.uint32)
    return out


def candidates(docs: DataFrame, bands: DataFrame, text_col: str) -> DataFrame:
    """``(band, par, shingles)`` of the paragraphs in ``bands``, each once."""
    sent = docs.sparkSession.sparkContext.broadcast(band_filter(bands))

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        bits = sent.value
        for batch in slices(batches, text_col):
            par, shingles, n = distinct_lines(texts_of(batch, text_col))
            if not len(par):
                continue
            keys = band_keys(shingles, n)
            spot = keys.view(np.uint64) >> np.uint64(64 - FILTER_BITS)
            row, band = np.nonzero(bits[spot >> np.uint64(5)] >> (spot & np.uint64(31)).astype(np.uint32) & np.uint32(1))
            if not len(row):
                continue
            starts = np.cumsum(n) - n
            sets = [np.unique(shingles[starts[k] : starts[k] + n[k]]).view(np.int64) for k in row.tolist()]
            yield pa.RecordBatch.from_arrays([pa.array(keys[row, band]), pa.array(par[row]), list_array(np.concatenate(sets), np.array([len(x) for x in sets]))], names=["band", "par", "shingles"])

    met = docs.select(text_col).mapInArrow(run, "band long, par long, shingles array<long>").groupBy("band", "par").agg(F.first("shingles").alias("shingles"))
    # Once each first: a join on the band alone may then be split where many meet.
    return met.join(bands.select(F.col("band").alias("_band")), F.col("band") == F.col("_band"), "left_semi")


def jaccard_hits(similarity: float):
    """Pairs of a tile pair whose shingle sets are similar enough, by one product of membership matrices."""

    def members(side: dict, index: np.ndarray, width: int) -> np.ndarray:
        out = np.zeros((len(side["par"]), width), np.float32)
        out[np.repeat(np.arange(len(side["n"])), side["n"]), index] = 1
        return out

    def hits(a: dict, b: dict) -> np.ndarray:
        known, index = np.unique(np.r_[a["shingles"], b["shingles"]], return_inverse=True)
        cut = len(a["shingles"])
        both = members(a, index[:cut], len(known)) @ members(b, index[cut:], len(known)).T
        either = a["n"][:, None] + b["n"][None, :] - both
        return np.flatnonzero(both >= similarity * either)

    return hits


def similar_paragraphs(docs: DataFrame, units: DataFrame, text_col: str = "text", similarity: float = SIMILARITY) -> DataFrame:
    """``(node, component)`` of different paragraphs that chains of exact Jaccard similarity connect.

    Bands are first only counted: of each, whether two different paragraphs of ``units`` meet
    in it. Paragraphs and their shingles are then made for those bands alone and
    compared tile by tile, so a band in which many meet is neither gathered nor
    written out as pairs.
    """
    lines = units.where("bands IS NOT NULL").select("par", F.explode("bands").alias("band"))
    bands = cut_lineage(lines.groupBy("band").agg(F.min("par").alias("low"), F.max("par").alias("high")).where("low <> high").select("band"))
    rows = candidates(docs, bands, text_col).withColumn("n", F.size("shingles").cast("long"))
    tiles = build_tiles(rows, "band", "par", ["n", "shingles"], TILE)
    found = compare_tiles(tiles, "par", {"n": "i8", "shingles": "i8"}, jaccard_hits(similarity), tiles_a_slot=TILES_A_SLOT, flat=("shingles",))
    return components(found.where("node <> root"), "node", "root")


def whole_passages(members: DataFrame) -> DataFrame:
    """Runs of one text that always stand together, as one passage with the first one's cluster.

    Two clusters of runs belong together if each place of one is followed by a place
    of the other, always as many words on, and both have as many places: then every
    text cuts its runs into the same passages. Needs an order only within a text.
    """
    along = Window.partitionBy("text_no").orderBy("first_word")
    gap = F.lead("first_word").over(along) - F.col("first_word")
    after = F.when(gap <= RUN, F.struct(F.lead("cluster_id").over(along).alias("next"), gap.alias("gap"), F.lead("cluster_size").over(along).alias("size")))
    followed = members.select("cluster_id", "cluster_size", after.alias("after")).groupBy("cluster_id").agg(
        F.min("after").alias("least"), F.max("after").alias("most"), F.count("after").alias("n"), F.max("cluster_size").alias("cluster_size"))
    # The smaller side stands by itself, so that a cluster with very many places can be split.
    further = cut_lineage(followed.where("least = most AND n = cluster_size AND least.size = cluster_size AND least.next <> cluster_id").select(F.col("least.next").alias("_next")))
    marked = members.join(further, F.col("cluster_id") == F.col("_next"), "left")
    passage = F.sum(F.col("_next").isNull().cast("int")).over(along)
    return marked.withColumn("passage", passage).groupBy("text_no", "passage").agg(
        F.first("doc").alias("doc"), F.first("copy").alias("copy"), F.min("first_word").alias("first_word"), F.max(F.col("first_word") + F.col("words")).alias("end"),
        F.min_by("cluster_id", "first_word").alias("cluster_id"), F.first("cluster_size").alias("cluster_size")).select(
        "doc", "copy", "first_word", (F.col("end") - F.col("first_word")).alias("words"), "cluster_id", "cluster_size")


def repeated_passages(docs: DataFrame, similarity: float = SIMILARITY, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """``(id, first_word, n_words, cluster_id, cluster_size, kept)``: every paragraph or passage that another document repeats.

    A row for each line of at least MIN_LINE words that is equal to one of another
    document or reaches it by links of Jaccard similarity of five-word shingles of at
    least ``similarity``, and for each passage of RUN words or more that another document
    holds word by word, whatever lines it is wrapped in: every one of PASSAGE words is found.
    A passage is made of the taken runs that always stand together; up to
    PASSAGE - RUN words at either end may lie beyond it. What repeats only within
    one document gives no row. ``first_word`` counts the text's words from 0. A cluster keeps its first place
    by id, then word; the others are removals. Shorter lines that many texts share
    are not compared by themselves. Texts that are null, empty or short give no row; rows of one id
    with different texts are different documents, repeated rows are one; a null id sorts first. Ids may be of any
    type that orders; other columns are not read.
    """
    units = stored(paragraph_rows(docs, id_col, text_col), "paragraphs")
    labels = similar_paragraphs(docs, units, text_col, similarity)
    document = F.xxhash64("doc", "copy")
    is_run = F.col("bands").isNull().alias("is_run")
    counts = units.groupBy("par", is_run).agg(F.count(F.lit(1)).alias("n"), F.min(document).alias("low"), F.max(document).alias("high"))
    grouped = counts.join(labels, (F.col("par") == F.col("node")) & ~F.col("is_run"), "left").where("n > 1 OR component IS NOT NULL")
    grouped = cut_lineage(grouped.select("par", "is_run", "n", "low", "high", F.coalesce("component", "par").alias("cluster_id")))
    clusters = grouped.groupBy(F.col("cluster_id").alias("_cluster"), F.col("is_run").alias("_is_run")).agg(F.sum("n").alias("cluster_size"), F.min("low").alias("low"), F.max("high").alias("high"))
    across = clusters.where("low <> high").drop("low", "high")
    # The smaller sides of these joins stand by themselves, so that a paragraph or a
    # cluster with very many places can be split.
    repeated = cut_lineage(grouped.join(across, (F.col("cluster_id") == F.col("_cluster")) & (F.col("is_run") == F.col("_is_run"))).select(F.col("par").alias("_par"), F.col("is_run").alias("_is_run"), "cluster_id", "cluster_size"))
    mine = units.select("text_no", "doc", "copy", "first_word", "words", "par", is_run)
    found = stored(mine.join(repeated, (F.col("par") == F.col("_par")) & (F.col("is_run") == F.col("_is_run"))).select("text_no", "doc", "copy", "first_word", "words", "is_run", "cluster_id", "cluster_size"), "members")
    lines = found.where("NOT is_run").drop("is_run", "text_no")
    members = stored(lines.unionByName(whole_passages(found.where("is_run"))), "passages")
    place = F.struct("doc", "first_word", "copy")
    firsts = cut_lineage(members.groupBy(F.col("cluster_id").alias("_cluster")).agg(F.min(place).alias("_first")))
    out = members.join(firsts, F.col("cluster_id") == F.col("_cluster"))
    return out.select(F.col("doc").alias(id_col), "first_word", F.col("words").alias("n_words"), "cluster_id", "cluster_size", place.eqNullSafe(F.col("_first")).alias("kept"))
