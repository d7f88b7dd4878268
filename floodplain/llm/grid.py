"""Integer vectors in vertical tiles, and the meeting of query tiles with all tiles in a grid of cells."""

from __future__ import annotations

import math
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T

from floodplain.session import cut_lineage

#: Rows of a tile of candidates and of queries.
TILE, QUERY_TILE = 1024, 256
#: Pairs of rows that one cell of the grid may hold.
CELL_PAIRS = 1 << 31
#: Joined tile pairs that one Arrow batch holds.
PAIRS_AT_ONCE = 8
#: Whole numbers that a double holds exactly, and that 64 bits hold.
EXACT, WHOLE = 1 << 53, 1 << 63


def usable_rows(vectors: DataFrame, id_col: str, vector_col: str, **more: str) -> DataFrame:
    """``(id, v, more…)`` of rows with an id and a vector all of whose components are finite; ``more`` maps names to columns."""
    rows = vectors.select(F.col(id_col).alias("id"), F.col(vector_col).cast(T.ArrayType(T.DoubleType())).alias("v"), *(F.col(column).alias(name) for name, column in more.items()))
    finite = F.forall("v", lambda x: x.isNotNull() & ~F.isnan(x) & (F.abs(x) != F.lit(float("inf"))))
    return rows.where(F.col("id").isNotNull() & F.col("v").isNotNull() & finite)


def whole_numbers(batch: pa.RecordBatch, rows: np.ndarray, dims: int, scale: int) -> np.ndarray:
    """``floor(scale * x)`` of the vectors at ``rows``, which have ``dims`` components: one row for each component."""
    lists = batch.column("v").take(pa.array(rows))
    wide = np.floor(scale * lists.flatten().to_numpy(zero_copy_only=False)).reshape(len(rows), dims)
    if wide.size and np.abs(wide).max() >= 1 << 31:
        raise ValueError("a component times the scale does not fit into 32 bits")
    return np.ascontiguousarray(wide.astype(np.int32).T)


def build_tiles(rows: DataFrame, scale: int, size: int, carried: tuple[str, ...] = ()) -> DataFrame:
    """``(tile, dims, n, ids, values, carried…)``: up to ``size`` rows of equal length, component by component.

    ``rows`` are ``usable_rows``. Tiles are cut where the rows stand, without a
    shuffle, and checkpointed, so that a recomputed task cannot deal them
    otherwise. ``values`` are 32-bit numbers, all first components first; the
    columns ``carried`` become lists.
    """
    lists = [T.StructField("ids", T.ArrayType(rows.schema["id"].dataType)), T.StructField("values", T.BinaryType()), *(T.StructField(name, T.ArrayType(rows.schema[name].dataType)) for name in carried)]
    schema = T.StructType([T.StructField("dims", T.IntegerType()), T.StructField("n", T.IntegerType()), *lists])

    def tile(batch: pa.RecordBatch, at: np.ndarray, dims: int, target: pa.Schema) -> pa.RecordBatch:
        listed = {name: pa.array([batch.column("id" if name == "ids" else name).take(pa.array(at)).to_pylist()], target.field(name).type) for name in ("ids", *carried)}
        columns = {"dims": pa.array([dims], pa.int32()), "n": pa.array([len(at)], pa.int32()), "values": pa.array([whole_numbers(batch, at, dims, scale).tobytes()], pa.binary()), **listed}
        return pa.RecordBatch.from_arrays([columns[field.name] for field in target], schema=target)

    def pack(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        from pyspark.sql.pandas.types import to_arrow_schema

        target = to_arrow_schema(schema)
        for batch in batches:
            lengths = np.diff(batch.column("v").offsets.to_numpy())
            for dims in np.unique(lengths).tolist():
                at = np.flatnonzero(lengths == dims)
                for begin in range(0, len(at), size):
                    yield tile(batch, at[begin : begin + size], dims, target)

    few = rows.coalesce(max(1, math.ceil(rows.count() / size)))
    made = few.select("id", "v", *carried).mapInArrow(pack, schema)
    return cut_lineage(made.withColumn("tile", F.monotonically_increasing_id()))


def grid_of(queries: int, rows: int, query_tiles: int, row_tiles: int, tasks: int) -> tuple[int, int]:
    """Into how many groups queries and rows are dealt, so that cells are small enough and little is copied.

    Every row goes to as many cells as there are groups of queries and every
    query to as many as there are groups of rows; for a number of cells the copies
    are fewest when the two shares are alike.
    """
    cells = max(tasks, math.ceil(queries * rows / CELL_PAIRS))
    of_queries = min(max(1, round(math.sqrt(cells * queries / max(1, rows)))), max(1, query_tiles))
    return of_queries, min(max(1, math.ceil(cells / of_queries)), max(1, row_tiles))


def meetings(queries: DataFrame, tiles: DataFrame) -> DataFrame:
    """Each tile of ``queries`` beside each of ``tiles`` with vectors of its length: columns ``q_…`` and ``c_…``.

    Not a product of two tables in one place: both are dealt to the cells of a
    grid, and a join on the cell brings them together. In a task the tiles of a
    cell follow one another, so that what is known of a query carries on.
    """
    spark = tiles.sparkSession
    sizes = [df.agg(F.coalesce(F.sum("n"), F.lit(0)), F.count(F.lit(1))).first() for df in (queries, tiles)]
    parts = max(int(spark.conf.get("spark.sql.shuffle.partitions")), 2 * spark.sparkContext.defaultParallelism)
    of_queries, of_rows = grid_of(sizes[0][0], sizes[1][0], sizes[0][1], sizes[1][1], 4 * parts)

    def dealt(df: DataFrame, prefix: str, mine: str, mine_n: int, other: str, other_n: int) -> DataFrame:
        named = df.select(*(F.col(name).alias(f"{prefix}{name}") for name in df.columns))
        named = named.withColumn(mine, F.pmod(F.xxhash64(f"{prefix}tile"), F.lit(mine_n)).cast("int"))
        return named.withColumn(other, F.explode(F.sequence(F.lit(0), F.lit(other_n - 1)))).repartition(parts, "cell_q", "cell_c", f"{prefix}dims")

    left = dealt(queries, "q_", "cell_q", of_queries, "cell_c", of_rows)
    right = dealt(tiles, "c_", "cell_c", of_rows, "cell_q", of_queries).withColumnsRenamed({"cell_q": "_q", "cell_c": "_c"})
    return left.join(right, (F.col("cell_q") == F.col("_q")) & (F.col("cell_c") == F.col("_c")) & (F.col("q_dims") == F.col("c_dims"))).drop("_q", "_c", "cell_q", "cell_c")


def vertical(batch: pa.RecordBatch, row: int, prefix: str) -> np.ndarray:
    """The numbers of a tile, one row for each component."""
    dims, n = (batch.column(f"{prefix}{name}")[row].as_py() for name in ("dims", "n"))
    return np.frombuffer(batch.column(f"{prefix}values")[row].as_buffer(), np.int32).reshape(dims, n)


def listed(batch: pa.RecordBatch, row: int, column: str) -> np.ndarray:
    return batch.column(column)[row].values.to_numpy(zero_copy_only=False)


def exact_kind(a: np.ndarray, b: np.ndarray) -> type:
    """The number type in which inner products of columns of ``a`` and ``b`` are exact."""
    if not a.size or not b.size:
        return np.float64
    bound = len(a) * int(np.abs(a.astype(np.int64)).max()) * int(np.abs(b.astype(np.int64)).max())
    if bound >= WHOLE:
        raise ValueError("an inner product may not fit into 64 bits")
    return np.float64 if bound < EXACT else np.int64


class Best:
    """The best ``k`` of one query so far: scores from the highest, equal ones by the smaller id."""

    def __init__(self, k: int):
        self.k, self.scores, self.ids = k, np.zeros(0, np.int64), None

    @property
    def least(self) -> int | None:
        """What a further row must reach; nothing while there are fewer than ``k``."""
        return int(self.scores[-1]) if len(self.scores) >= self.k else None

    def add(self, scores: np.ndarray, ids: np.ndarray) -> None:
        if self.least is not None:
            at = np.flatnonzero(scores >= self.least)
            scores, ids = scores[at], ids[at]
        if not len(scores):
            return
        if len(scores) > 4 * self.k:  # only what can be among the first k
            at = np.flatnonzero(scores >= np.partition(scores, len(scores) - self.k)[len(scores) - self.k])
            scores, ids = scores[at], ids[at]
        scores = np.r_[self.scores, scores.astype(np.int64)]
        ids = ids if self.ids is None else np.concatenate([self.ids, ids])
        order = np.lexsort((id_order(ids), -scores))[: self.k]
        self.scores, self.ids = scores[order], ids[order]


def id_order(ids: np.ndarray) -> np.ndarray:
    """Numbers in the order of the ids, whatever their type."""
    return ids if ids.dtype != object else np.unique(ids, return_inverse=True)[1]
