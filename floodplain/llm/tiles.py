"""Exact comparison of all rows of neighbouring cells, tile by tile."""

from __future__ import annotations

import contextlib
from collections.abc import Callable

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T

from floodplain.llm.shared import local_components
from floodplain.session import cut_lineage

#: Joined tile pairs that one Arrow batch may hold.
PAIRS_AT_ONCE = 64
#: Large cells whose numbers of slots are broadcast; more are joined.
CELLS_SENT = 100_000
#: Linked rows that a task gathers before it merges them.
MERGE_ROWS = 400_000


@contextlib.contextmanager
def batches_of(spark, rows: int):
    """Arrow batches of at most ``rows`` rows for what is run inside: a tile is a wide row."""
    name = "spark.sql.execution.arrow.maxRecordsPerBatch"
    before = spark.conf.get(name)
    spark.conf.set(name, str(rows))
    try:
        yield
    finally:
        spark.conf.set(name, before)


def build_tiles(rows: DataFrame, cell: str, node: str, payload: list[str], size: int | Callable[[int], int]) -> DataFrame:
    """Pack rows of one cell into tiles of at most ``size``: ``(cell, tile, node BINARY, payload… BINARY)``.

    ``size`` may depend on the cell, where cells differ in the width of their rows. Rows are dealt by ranges of (cell, node), so that a large cell is spread over
    many tasks, and cut as they stream by; no cell is ever gathered. The result is
    checkpointed: both sides of a comparison must see the same tiles.
    """
    kinds = {name: rows.schema[name].dataType for name in payload}
    schema = T.StructType([T.StructField("cell", rows.schema[cell].dataType), T.StructField("tile", T.LongType()), T.StructField(node, T.BinaryType()), *(T.StructField(name, T.BinaryType()) for name in kinds)])

    def values(column: pa.Array) -> np.ndarray:
        if pa.types.is_list(column.type):
            return column.flatten().to_numpy(zero_copy_only=False)
        return column.to_numpy(zero_copy_only=False)

    def pack(batches):
        for batch in batches:
            cells = batch.column(0).to_pylist()
            cuts = [0, *(i for i in range(1, len(cells)) if cells[i] != cells[i - 1]), len(cells)]
            nodes = batch.column(1).to_numpy()
            out = []
            for begin, end in zip(cuts, cuts[1:], strict=False):
                most = size(cells[begin]) if callable(size) and end > begin else size
                for at in range(begin, end, most) if end > begin else ():
                    part = batch.slice(at, min(most, end - at))
                    out.append((cells[at], int(nodes[at]), *(values(part.column(k)).tobytes() for k in range(1, part.num_columns))))
            yield pa.RecordBatch.from_arrays([pa.array(column, field.type) for column, field in zip(zip(*out, strict=True), target, strict=True)], schema=target) if out else pa.RecordBatch.from_pylist([], schema=target)

    from pyspark.sql.pandas.types import to_arrow_schema

    target = to_arrow_schema(schema)
    dealt = rows.select(F.col(cell).alias("cell"), node, *payload).repartitionByRange("cell", node).sortWithinPartitions("cell", node)
    return cut_lineage(dealt.mapInArrow(pack, schema))


def compare_tiles(
    tiles: DataFrame, node: str, payload: dict[str, str], hits: Callable[[dict, dict], np.ndarray],
    neighbours: list[int] | None = None, slots: int = 1, weight: str | None = None, flat: tuple[str, ...] = (), tiles_a_slot: int | None = None,
) -> DataFrame:
    """Compare every tile with itself, the tiles of its cell and those of ``neighbours``; checkpointed.

    ``payload`` names the arrays and their numpy types; ``hits`` gets two tiles and
    returns the flat indices ``i * len(b) + j`` of the pairs that link.
    ``neighbours`` are offsets added to a numeric cell, one of each pair of
    directions. Only this leaves a task: for every row with a link ``(node, root,
    links)``, where rows that links within the task connect share the root and
    ``links`` counts a row's links there (weighted by the array ``weight``). A group
    of n near copies therefore makes rows in proportion to n times the tasks it is
    spread over, not n squared, and no connection is lost. ``slots`` spreads
    the tiles of a large cell over that many tasks; ``tiles_a_slot`` instead gives each cell
    the slots that its number of tiles needs (without ``neighbours``), so that small cells are not copied. Arrays named in ``flat`` have
    rows of different lengths and stay flat.
    """
    spark = tiles.sparkSession
    kinds = {node: "i8", **payload}
    offsets = [0, *(neighbours or [])]
    steps: Column = F.explode(F.array(*(F.lit(step).cast("long") for step in offsets))) if neighbours else F.lit(0).cast("long")
    left = tiles.select(*(F.col(name).alias(f"a_{name}") for name in tiles.columns), steps.alias("step"))
    left = left.withColumn("at", F.col("a_cell") + F.col("step") if neighbours else F.col("a_cell"))
    right = tiles.select(*(F.col(name).alias(f"b_{name}") for name in tiles.columns))
    if tiles_a_slot is not None:
        # Only cells of more than one slot are looked up, so that most tiles are not moved for it.
        counts = tiles.groupBy(F.col("cell").alias("_cell")).agg(F.ceil(F.count(F.lit(1)) / tiles_a_slot).cast("int").alias("_slots"))
        needs = cut_lineage(counts.where("_slots > 1"))
        if needs.count() <= CELLS_SENT:
            needs = F.broadcast(needs)
        left, right = (df.join(needs, F.col(of) == F.col("_cell"), "left").drop("_cell") for df, of in ((left, "at"), (right, "b_cell")))
        slots_of = F.coalesce("_slots", F.lit(1))
        left = left.withColumn("slot", F.explode(F.sequence(F.lit(0), slots_of - 1))).drop("_slots")
        right = right.withColumn("b_slot", F.pmod(F.xxhash64("b_tile"), slots_of).cast("int")).drop("_slots")
    else:
        left = left.withColumn("slot", F.explode(F.sequence(F.lit(0), F.lit(slots - 1))) if slots > 1 else F.lit(0))
        right = right.withColumn("b_slot", F.pmod(F.xxhash64("b_tile"), F.lit(slots)).cast("int"))
    parts = max(int(spark.conf.get("spark.sql.shuffle.partitions")), 2 * spark.sparkContext.defaultParallelism)
    joined = left.repartition(parts, "at", "slot").join(
        right.repartition(parts, "b_cell", "b_slot"),
        (F.col("at") == F.col("b_cell")) & (F.col("slot") == F.col("b_slot")) & ((F.col("step") != 0) | (F.col("a_tile") <= F.col("b_tile"))),
    ).select("a_tile", "b_tile", "step", *(f"a_{name}" for name in kinds), *(f"b_{name}" for name in kinds))

    def side(batch: pa.RecordBatch, row: int, prefix: str) -> dict[str, np.ndarray]:
        arrays = {name: np.frombuffer(batch.column(f"{prefix}{name}")[row].as_buffer(), kind) for name, kind in kinds.items()}
        n = len(arrays[node])
        return {name: array if len(array) == n or name in flat else array.reshape(n, -1) for name, array in arrays.items()}

    def linked(batch: pa.RecordBatch, row: int) -> tuple[np.ndarray, np.ndarray, np.ndarray] | None:
        a, b = side(batch, row, "a_"), side(batch, row, "b_")
        same = batch.column("step")[row].as_py() == 0 and batch.column("a_tile")[row].as_py() == batch.column("b_tile")[row].as_py()
        pairs = hits(a, b)
        n = len(b[node])
        i, j = pairs // n, pairs % n
        if same:
            i, j = i[i != j], j[i != j]
        if not len(i):
            return None
        nodes = a[node] if same else np.r_[a[node], b[node]]
        weights = [side[weight] if weight else np.ones(len(side[node]), np.int64) for side in (a, b)]
        links = np.bincount(i, weights[1][j], len(nodes))
        right_at = j
        if not same:
            right_at = j + len(a[node])
            links += np.bincount(right_at, weights[0][i], len(nodes))
        label = local_components(i, right_at, len(nodes))
        at = np.flatnonzero(links > 0)
        return nodes[at], nodes[label[at]], links[at].astype(np.int64)

    def merged(parts: list[tuple[np.ndarray, np.ndarray, np.ndarray]]) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
        nodes, roots, links = (np.concatenate(part) for part in zip(*parts, strict=True))
        known, place = np.unique(np.r_[nodes, roots], return_inverse=True)
        left, right = place[: len(nodes)], place[len(nodes) :]
        label = local_components(left, right, len(known))
        return known, known[label], np.bincount(left, links, len(known)).astype(np.int64)

    def run(batches):
        # What a task finds is merged before it leaves: a row for each linked node
        # of the task, however many tiles it was compared with.
        held, size = [], 0
        for batch in batches:
            found = [part for row in range(batch.num_rows) if (part := linked(batch, row)) is not None]
            held += found
            size += sum(len(part[0]) for part in found)
            if size > MERGE_ROWS:
                held = [merged(held)]
                size = len(held[0][0])
                if size > MERGE_ROWS // 2:
                    yield pa.RecordBatch.from_arrays([pa.array(column) for column in held[0]], names=["node", "root", "links"])
                    held, size = [], 0
        if held:
            yield pa.RecordBatch.from_arrays([pa.array(column) for column in merged(held)], names=["node", "root", "links"])

    with batches_of(spark, PAIRS_AT_ONCE):
        return cut_lineage(joined.mapInArrow(run, "node long, root long, links long"))
