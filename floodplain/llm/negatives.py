"""Hard negatives by angular triangle filtering: angles to reference directions bound every score."""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F
from pyspark.sql import types as T

from floodplain.llm.grid import PAIRS_AT_ONCE, QUERY_TILE, TILE, Best, build_tiles, exact_kind, listed, meetings, usable_rows, vertical
from floodplain.llm.tiles import batches_of
from floodplain.session import cut_lineage

#: Reference directions: a bounded sample of the rows, by a hash of their ids.
REFERENCES = 16
#: Rounding of angles, in radians, and of scores, relative to the product of both lengths.
ANGLE_SLACK, SCORE_SLACK = 1e-7, 1e-9


def directions(rows: DataFrame, scale: int, count: int = REFERENCES) -> dict[int, np.ndarray]:
    """Unit reference directions by length of vector; any choice gives the same results, a near one saves more work."""
    sample = rows.select(F.transform("v", lambda x: F.floor(x * scale)).alias("w"), F.xxhash64("id", "v").alias("h")).where(F.exists("w", lambda x: x != 0))
    taken = sample.orderBy("h").limit(count).collect()
    out: dict[int, list] = {}
    for row in taken:
        wide = np.array(row.w, np.float64)
        out.setdefault(len(wide), []).append(wide / np.linalg.norm(wide))
    return {dims: np.array(units) for dims, units in out.items()}


def angles_of(values: np.ndarray, references: np.ndarray | None) -> tuple[np.ndarray, np.ndarray]:
    """``(norms, angles)`` of a tile's columns: one row of angles for each reference; a zero vector is at a right angle to all."""
    wide = values.astype(np.float64)
    norms = np.sqrt((wide * wide).sum(0))
    if references is None:
        return norms, np.zeros((0, len(norms)))
    cosines = references @ wide / np.where(norms > 0, norms, 1)
    return norms, np.arccos(np.clip(cosines, -1, 1))


def score_bounds(norm: float, angles: np.ndarray, norms: np.ndarray, column_angles: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """Whole numbers that the inner products with one vector cannot leave: ``(low, high)`` for each column.

    The angle between two vectors is at least the difference of their angles to a
    reference and at most their sum; over all references the largest difference and
    the smallest sum count. Cosines times both lengths, widened by the rounding
    that can have happened, are rounded outwards.
    """
    size = norm * norms
    if not len(angles):
        return np.floor(-size * (1 + SCORE_SLACK) - 1), np.ceil(size * (1 + SCORE_SLACK) + 1)
    near = np.clip(np.abs(column_angles - angles[:, None]).max(0) - ANGLE_SLACK, 0, np.pi)
    far = np.clip((column_angles + angles[:, None]).min(0) + ANGLE_SLACK, 0, np.pi)
    slack = SCORE_SLACK * size
    return np.floor(np.cos(far) * size - slack), np.ceil(np.cos(near) * size + slack)


def window_of(positive: np.ndarray, low: int, high: int, whole: int) -> tuple[np.ndarray, np.ndarray]:
    """The scores ``n`` with ``low * p <= whole * n <= high * p`` as whole numbers from, to."""
    return -((-low * positive) // whole), (high * positive) // whole


def _scan(pairs: DataFrame, references: dict[int, np.ndarray], schema: T.StructType, begin, meet, finish) -> DataFrame:
    """Fold tile pairs: ``begin()`` makes a task's state, ``meet`` sees one query and one tile, ``finish`` gives rows."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        from pyspark.sql.pandas.types import to_arrow_schema

        target = to_arrow_schema(schema)
        state = begin()
        for batch in batches:
            for row in range(batch.num_rows):
                asked, columns = vertical(batch, row, "q_"), vertical(batch, row, "c_")
                mine = references.get(len(asked))
                norms, angles = angles_of(asked, mine)
                column_norms, column_angles = angles_of(columns, mine)
                number = exact_kind(asked, columns)
                asked, columns = asked.astype(number), columns.astype(number)
                ids, labels = listed(batch, row, "c_ids"), listed(batch, row, "c_label")
                facts = [listed(batch, row, name) for name in batch.schema.names if name.startswith("q_") and name not in ("q_ids", "q_dims", "q_n", "q_values", "q_tile")]
                for place, name in enumerate(listed(batch, row, "q_ids").tolist()):
                    bounds = score_bounds(norms[place], angles[:, place], column_norms, column_angles)
                    meet(state, name, [fact[place] for fact in facts], asked[:, place], columns, ids, labels, bounds)
        rows = list(finish(state))
        if rows:
            yield pa.RecordBatch.from_arrays([pa.array(column, field.type) for column, field in zip(zip(*rows, strict=True), target, strict=True)], schema=target)

    with batches_of(pairs.sparkSession, PAIRS_AT_ONCE):
        return cut_lineage(pairs.mapInArrow(run, schema))


def best_positives(anchors: DataFrame, tiles: DataFrame, references: dict[int, np.ndarray], positives: int) -> DataFrame:
    """``(anchor_id, place, positive_id, positive_score)``: each anchor's first other rows of its label."""
    kind = tiles.schema["ids"].dataType.elementType
    schema = T.StructType([T.StructField("anchor_id", kind), T.StructField("positive_id", kind), T.StructField("positive_score", T.LongType())])

    def meet(state, name, facts, asked, columns, ids, labels, bounds):
        mine = state.setdefault(name, Best(positives))
        may = (labels == facts[0]) & (ids != name)
        if mine.least is not None:
            may &= bounds[1] >= mine.least
        at = np.flatnonzero(may)
        if len(at):
            mine.add((asked @ columns[:, at]).astype(np.int64), ids[at])

    def finish(state):
        for name, mine in state.items():
            for score, found in zip(mine.scores.tolist(), mine.ids.tolist() if mine.ids is not None else [], strict=False):
                yield name, found, score

    found = _scan(meetings(anchors, tiles), references, schema, dict, meet, finish)
    order = Window.partitionBy("anchor_id").orderBy(F.desc("positive_score"), "positive_id")
    return found.withColumn("place", F.row_number().over(order)).where(F.col("place") <= positives)


def best_negatives(anchors: DataFrame, tiles: DataFrame, references: dict[int, np.ndarray], negatives: int, low: int, high: int, whole: int) -> DataFrame:
    """``(anchor_id, place, negative_id, negative_score)``: candidates for every positive of every anchor; ``anchors`` carry ``scores``."""
    kind = tiles.schema["ids"].dataType.elementType
    schema = T.StructType([T.StructField("anchor_id", kind), T.StructField("place", T.IntegerType()), T.StructField("negative_id", kind), T.StructField("negative_score", T.LongType())])

    def meet(state, name, facts, asked, columns, ids, labels, bounds):
        if name not in state:
            begin, end = window_of(np.asarray(facts[1], np.int64), low, high, whole)
            state[name] = (begin, end, [Best(negatives) for _ in begin])
        begin, end, best = state[name]
        # What a score must reach to matter for a positive: its window's lower end, or the least it keeps.
        needed = [b if mine.least is None else max(b, mine.least) for b, mine in zip(begin.tolist(), best, strict=True)]
        open_at = [k for k, need in enumerate(needed) if need <= end[k]]
        if not open_at:
            return
        overlap = np.zeros(len(ids), bool)
        for need, last in {(needed[k], int(end[k])) for k in open_at}:
            overlap |= (bounds[1] >= need) & (bounds[0] <= last)
        at = np.flatnonzero(overlap & (labels != facts[0]))
        if not len(at):
            return
        scores, found = (asked @ columns[:, at]).astype(np.int64), ids[at]
        for k in open_at:
            fits = np.flatnonzero((scores >= needed[k]) & (scores <= end[k]))
            if len(fits):
                best[k].add(scores[fits], found[fits])

    def finish(state):
        for name, (_, _, best) in state.items():
            for k, mine in enumerate(best):
                for score, found in zip(mine.scores.tolist(), mine.ids.tolist() if mine.ids is not None else [], strict=False):
                    yield name, k + 1, found, score

    return _scan(meetings(anchors, tiles), references, schema, dict, meet, finish)


def hard_negatives(
    vectors: DataFrame, is_anchor: Column, positives: int = 5, negatives: int = 10, low: int = 30, high: int = 90, whole: int = 100, scale: int = 256,
    id_col: str = "vec_id", vector_col: str = "embedding", label: Column | None = None, references: int = REFERENCES, tile: int = TILE, query_tile: int = QUERY_TILE,
) -> DataFrame:
    """``(anchor_id, positive_id, rank, negative_id, positive_score, negative_score)``: per anchor and positive, the hardest allowed negatives.

    Components become ``floor(scale * x)``; a score is the whole-number inner product
    with the anchor, equal scores go to the smaller id. An anchor's positives are its
    first ``positives`` other rows of the same label, fewer if there are fewer. For
    each, the first ``negatives`` rows of another label whose score n satisfies
    ``low * p <= whole * n <= high * p`` are returned, ranked from 1; with a
    negative p there are none.

    Rows take no part without an id, a label or a vector, or with a component that
    is null or not finite. Vectors of other lengths than the anchor's are not
    compared with it. A repeated row counts each time it stands, rows with the
    anchor's own id never count as positives; of several rows under an anchor's id
    the one with the smallest label and vector is the anchor. An empty table and
    anchors without positives give no rows. Other columns are not read. Labels are
    whole numbers, or anything else by its 64-bit hash. Anchors grow with the table, so nothing is broadcast but the
    reference directions (``references`` sampled rows; they decide what is
    skipped, never what is found).

    Two passes over the tiles, as windows need the positives' scores: a tile's
    angles to the references bound the scores with an anchor from both sides, and
    only rows whose bounds reach an open window are multiplied.
    """
    label = label if label is not None else F.col("label")
    marked = vectors.where(F.col(id_col).isNotNull()).withColumns({"_anchor": is_anchor, "_label": label})
    rows = usable_rows(marked, id_col, vector_col, label="_label", anchor="_anchor").where("label IS NOT NULL")
    if not isinstance(rows.schema["label"].dataType, T.IntegralType):
        rows = rows.withColumn("label", F.xxhash64("label"))
    rows = rows.withColumn("label", F.col("label").cast("long"))
    known = directions(rows, scale, references)
    one = rows.where("anchor").groupBy("id").agg(F.min(F.struct("label", "v")).alias("one")).select("id", "one.*")
    one = cut_lineage(one)
    tiles, anchors = build_tiles(rows.select("id", "v", "label"), scale, tile, ("label",)), build_tiles(one, scale, query_tile, ("label",))
    first = cut_lineage(best_positives(anchors, tiles, known, positives))
    scores = first.groupBy(F.col("anchor_id").alias("_anchor")).agg(F.transform(F.sort_array(F.collect_list(F.struct("place", "positive_score"))), lambda x: x["positive_score"]).alias("scores"))
    ready = one.join(scores, F.col("id") == F.col("_anchor")).drop("_anchor")
    again = build_tiles(ready, scale, query_tile, ("label", "scores"))
    found = best_negatives(again, tiles, known, negatives, low, high, whole)
    order = Window.partitionBy("anchor_id", "place").orderBy(F.desc("negative_score"), "negative_id")
    ranked = found.withColumn("rank", F.row_number().over(order)).where(F.col("rank") <= negatives)
    named = first.select(F.col("anchor_id").alias("_anchor"), F.col("place").alias("_place"), "positive_id", "positive_score")
    return ranked.join(named, (F.col("anchor_id") == F.col("_anchor")) & (F.col("place") == F.col("_place"))).select(
        "anchor_id", "positive_id", "rank", "negative_id", "positive_score", "negative_score")


#: The same for the given table, whose whole numbers and their products are exact in doubles.
NEGATIVES_SQL = """
WITH whole AS (
  SELECT vec_id, CASE WHEN vec_id % 7 = 0 THEN (label + 1) % 10 ELSE label END AS label,
    [floor(256 * CAST(x AS DOUBLE)) for x in embedding] AS v
  FROM embeddings
  WHERE vec_id IS NOT NULL AND label IS NOT NULL AND embedding IS NOT NULL
    AND len([x for x in embedding if x IS NULL OR NOT isfinite(x)]) = 0
), scored AS (
  SELECT a.vec_id AS anchor_id, a.label AS anchor_label, c.vec_id, c.label,
    CAST(list_inner_product(a.v, c.v) AS BIGINT) AS score
  FROM whole a JOIN whole c ON a.vec_id % 100 = 0 AND c.vec_id <> a.vec_id
), positives AS (
  SELECT anchor_id, vec_id AS positive_id, score AS positive_score,
    row_number() OVER (PARTITION BY anchor_id ORDER BY score DESC, vec_id) AS place
  FROM scored WHERE label = anchor_label
), ranked AS (
  SELECT p.anchor_id, p.positive_id, p.positive_score, s.vec_id AS negative_id, s.score AS negative_score,
    row_number() OVER (PARTITION BY p.anchor_id, p.positive_id ORDER BY s.score DESC, s.vec_id) AS place
  FROM positives p JOIN scored s ON s.anchor_id = p.anchor_id AND s.label <> s.anchor_label
  WHERE p.place <= 5 AND 30 * p.positive_score <= 100 * s.score AND 100 * s.score <= 90 * p.positive_score
)
SELECT anchor_id, positive_id, CAST(place AS INTEGER) AS rank, negative_id, positive_score, negative_score FROM ranked WHERE place <= 10
"""
