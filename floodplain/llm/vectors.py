"""Near-duplicate vectors: int8 tile products with rigorous error bounds."""

from __future__ import annotations

from collections.abc import Iterator
from dataclasses import dataclass

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T

from floodplain.llm.shared import components, list_array
from floodplain.llm.tiles import build_tiles, compare_tiles

TILE = 512
#: Pairs that are computed again at a time.
PAIRS_AT_ONCE = 1 << 14
#: Tiles of a label that one task compares others with.
TILES_A_SLOT = 16
# Beyond what the quantisation bound covers: rounding of the products themselves.
SLACK = 1e-9
# Sums of products of two int8 numbers stay whole in float32 up to this many.
EXACT_IN_FLOAT32 = (1 << 24) // (127 * 127)


def unit_rows(vectors: np.ndarray) -> np.ndarray:
    wide = vectors.astype(np.float64)
    wide = wide / np.abs(wide).max(1, keepdims=True)
    return wide / np.sqrt((wide * wide).sum(1, keepdims=True))


def quantise(vectors: np.ndarray) -> tuple[np.ndarray, np.ndarray, np.ndarray, np.ndarray]:
    """``(unit, int8, scale, error)``: unit rows, their rounded form and the length of what rounding lost."""
    unit = unit_rows(vectors)
    scale = np.abs(unit).max(1) / 127
    whole = np.rint(unit / scale[:, None])
    error = np.sqrt(((unit - whole * scale[:, None]) ** 2).sum(1))
    return unit, whole.astype(np.int8), scale, error


@dataclass
class Quantised:
    """A tile's vectors with their rounded form and what rounding lost; unit rows are made only where they are needed."""

    vectors: np.ndarray
    whole: np.ndarray
    scale: np.ndarray
    error: np.ndarray


def linked_pairs(a: Quantised, b: Quantised, threshold: float, same: bool = False) -> np.ndarray:
    """Flat indices of the pairs whose cosine is at least ``threshold``; with ``same`` the two are one tile and no row meets itself.

    With u = s·q + d, |d| = e, the cosine differs from s·s'·(q·q') by at most
    e + (1 + e)·e'. Only pairs that this leaves undecided or above are computed
    again, each by itself, in double precision.
    """
    kind = np.float32 if a.whole.shape[1] <= EXACT_IN_FLOAT32 else np.float64
    rough = (a.whole.astype(kind) @ b.whole.astype(kind).T).astype(np.float64) * a.scale[:, None] * b.scale[None, :]
    may = rough + a.error[:, None] + (1 + a.error[:, None]) * b.error[None, :] + SLACK >= threshold
    left, right = np.nonzero(np.triu(may, 1) if same else may)
    linked = np.zeros(len(left), bool)
    for at in range(0, len(left), PAIRS_AT_ONCE):
        part = slice(at, at + PAIRS_AT_ONCE)
        rows, row = np.unique(left[part], return_inverse=True)
        columns, column = np.unique(right[part], return_inverse=True)
        linked[part] = np.einsum("ij,ij->i", unit_rows(a.vectors[rows])[row], unit_rows(b.vectors[columns])[column]) >= threshold
    left, right = left[linked], right[linked]
    found = left * len(b.vectors) + right
    return np.r_[found, right * len(b.vectors) + left] if same else found


def quantised_rows(classes: DataFrame) -> DataFrame:
    """Add each vector's rounded form ``q``, its ``scale`` and ``error``, once for all tiles it will meet."""
    schema = T.StructType([*classes.schema.fields, T.StructField("q", T.ArrayType(T.ByteType())), T.StructField("scale", T.DoubleType()), T.StructField("error", T.DoubleType())])

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            column = batch.column("v")
            sizes = np.diff(column.offsets.to_numpy())
            for size in np.unique(sizes).tolist():
                part = batch.take(pa.array(np.flatnonzero(sizes == size)))
                values = part.column("v").flatten().to_numpy(zero_copy_only=False).reshape(part.num_rows, size)
                _, whole, scale, error = quantise(values)
                yield pa.RecordBatch.from_arrays([*part.columns, list_array(whole.reshape(-1), np.full(part.num_rows, size)), pa.array(scale), pa.array(error)], names=[field.name for field in schema])

    return classes.mapInArrow(run, schema)


def near_vectors(
    vectors: DataFrame, threshold: float = 0.98, id_col: str = "vec_id", vector_col: str = "embedding", label_col: str = "label", tile: int = TILE,
) -> DataFrame:
    """``(id, n_links, component_id, kept)``: how many other vectors of the same label reach ``threshold``.

    One row per row. Vectors that are null, empty, zero or hold a null, NaN or
    infinite component, and vectors without a label or an id, have no links, are
    their own component and are kept; vectors of different lengths do not link.
    Equal vectors of a label are compared as one, with their number, so a large
    group of copies is one row of a tile; other near copies leave a tile pair as
    counts and a spanning set of links. Rows with the same id are one node. Ids may be of any
    type that orders; other than whole numbers are compared by 64-bit hashes of their vectors. Labels
    are compared whole: the work grows with the square of a label's distinct
    vectors, in tiles of ``tile`` that are spread over as many tasks as a label needs.
    """
    rows = vectors.select(F.col(id_col).alias("id"), F.col(label_col).alias("label"), F.col(vector_col).alias("v"))
    kind, id_kind = rows.schema["v"].dataType.elementType, rows.schema["id"].dataType
    floating, numbered = isinstance(kind, (T.FloatType, T.DoubleType)), isinstance(id_kind, T.IntegralType)
    rows = rows.withColumn("v", F.col("v").cast(T.ArrayType(T.DoubleType() if not floating else kind)))
    finite = F.forall("v", lambda x: x.isNotNull() & ~F.isnan(x) & (F.abs(x) != F.lit(float("inf"))))
    usable = F.coalesce(F.col("id").isNotNull() & F.col("label").isNotNull() & F.col("v").isNotNull() & finite & F.exists("v", lambda x: x != 0), F.lit(False))
    classes = rows.where(usable).groupBy("label", "v").agg(F.min("id").alias("first"), F.count(F.lit(1)).alias("copies"))
    classes = classes.withColumn("rep", F.col("first").cast("long") if numbered else F.xxhash64("label", "v"))
    cell = F.concat_ws(":", F.col("label").cast("string"), F.size("v").cast("string"))
    tiles = build_tiles(quantised_rows(classes.select("rep", "v", "copies", cell.alias("cell"))), "cell", "rep", ["v", "copies", "q", "scale", "error"], tile)

    def hits(a: dict, b: dict) -> np.ndarray:
        left, right = (Quantised(side["v"].reshape(len(side["rep"]), -1), side["q"].reshape(len(side["rep"]), -1), side["scale"], side["error"]) for side in (a, b))
        return linked_pairs(left, right, threshold, np.array_equal(a["rep"], b["rep"]))

    number = "f4" if isinstance(kind, T.FloatType) else "f8"
    found = compare_tiles(tiles, "rep", {"v": number, "copies": "i8", "q": "i1", "scale": "f8", "error": "f8"}, hits, tiles_a_slot=TILES_A_SLOT, weight="copies")
    groups = components(found.where("node <> root"), "node", "root")
    links = found.groupBy("node").agg(F.sum("links").alias("links"))
    named = links.join(groups.withColumnRenamed("node", "_node"), F.col("node") == F.col("_node"), "left")
    named = named.select(F.col("node").alias("_rep"), "links", F.coalesce("component", "node").alias("component"))
    # Copies find their class again by the vector itself; a class without copies
    # or links needs no row here.
    known = classes.join(named, F.col("rep") == F.col("_rep"), "left").where("copies > 1 OR links IS NOT NULL")
    if numbered:
        known = known.withColumn("low", F.col("component").cast(id_kind))
    else:
        lows = known.where("component IS NOT NULL").groupBy(F.col("component").alias("_component")).agg(F.min("first").alias("low"))
        known = known.join(lows, F.col("component") == F.col("_component"), "left")
    known = known.select(F.col("label").alias("_label"), F.col("v").alias("_v"),
                         (F.col("copies") - 1 + F.coalesce("links", F.lit(0))).alias("n"), F.coalesce("low", "first").alias("component"))
    out = rows.withColumn("usable", usable).join(known, F.col("usable") & (F.col("label") == F.col("_label")) & (F.col("v") == F.col("_v")), "left")
    component = F.coalesce("component", "id")
    return out.select(
        F.col("id").alias(id_col), F.coalesce("n", F.lit(0)).cast("long").alias("n_links"), component.alias("component_id"),
        F.coalesce(F.col("id") == component, F.lit(True)).alias("kept"),
    )
