"""Exact search for the highest inner products: columnar branch and bound."""

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

#: Components that are summed up between two looks at the bounds.
BLOCK = 8
#: Rounding of the bounds' square roots and sums, relative to their size.
SLACK = 1e-9


def block_norms(values: np.ndarray, block: int = BLOCK) -> np.ndarray:
    """The length of every vector within each block of components: ``(blocks, vectors)``."""
    wide = values.astype(np.float64)
    starts = np.arange(0, max(1, len(wide)), block)
    return np.sqrt(np.add.reduceat(wide * wide, starts, axis=0)) if len(wide) else np.zeros((1, wide.shape[1]))


def search_tile(query: np.ndarray, norms: np.ndarray, order: np.ndarray, columns: np.ndarray, column_norms: np.ndarray, least: int | None, block: int = BLOCK) -> tuple[np.ndarray, np.ndarray]:
    """``(places, scores)`` of the columns whose inner product with ``query`` may reach ``least``, with their exact product.

    Products are summed block by block, the query's heaviest block first. What the
    remaining blocks can add is at most the sum of the products of both lengths
    within each; columns for which even that stays below ``least`` are left out, and
    the survivors are moved together before the next block is read.
    """
    at = np.arange(columns.shape[1])
    total = np.zeros(len(at), columns.dtype)
    rest = norms @ column_norms if least is not None else None
    for step, k in enumerate(order.tolist()):
        if least is not None and len(at):
            slack = SLACK * (np.abs(total) + np.abs(rest) + 1)
            alive = np.flatnonzero(total + rest + slack >= least)
            if len(alive) < len(at):
                at, total, rest = at[alive], total[alive], rest[alive]
        if not len(at):
            break
        part = slice(k * block, (k + 1) * block)
        rows = columns[part]
        total = total + query[part] @ (rows if len(at) == columns.shape[1] else rows[:, at])
        if least is not None:
            rest = rest - norms[k] * (column_norms[k] if len(at) == columns.shape[1] else column_norms[k, at])
    return at, total.astype(np.int64)


def top_inner_products(
    vectors: DataFrame, is_query: Column, k: int = 5, scale: int = 256, id_col: str = "vec_id", vector_col: str = "embedding", tile: int = TILE, query_tile: int = QUERY_TILE,
) -> DataFrame:
    """``(query_id, rank, id, score)``: for each query row the ``k`` other rows with the highest inner product, fewer if there are fewer.

    Components become ``floor(scale * x)`` and scores are whole numbers; equal scores
    go to the smaller id. Rows without an id, without a vector or with a component
    that is null or not finite take no part; a query meets the vectors of its own
    length (empty ones score 0). A repeated row is a candidate each time it stands;
    rows with the query's own id are never its candidates. Of several vectors
    under one query id the smallest is the query. No table rows give no rows. Other
    columns are not read. Ids may be of any type that orders; a number that does
    not fit (component of 32 bits, product of 64) is an error.

    Queries grow with the table, so neither side is broadcast: tiles of both are
    dealt to a grid of cells (``grid.meetings``). Within a task each query keeps
    its best ``k``, which bound the next tile; a task gives at most ``k`` rows for
    each of its queries, and these are ranked.
    """
    rows = usable_rows(vectors.where(F.col(id_col).isNotNull()).withColumn("_asks", is_query), id_col, vector_col, asks="_asks")
    asked = rows.where("asks").groupBy("id").agg(F.min("v").alias("v"))
    tiles, queries = build_tiles(rows.select("id", "v"), scale, tile), build_tiles(asked, scale, query_tile)
    kind = rows.schema["id"].dataType
    schema = T.StructType([T.StructField("query_id", kind), T.StructField("id", kind), T.StructField("score", T.LongType())])

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        from pyspark.sql.pandas.types import to_arrow_schema

        target = to_arrow_schema(schema)
        best: dict = {}
        for batch in batches:
            for row in range(batch.num_rows):
                asked, columns = vertical(batch, row, "q_"), vertical(batch, row, "c_")
                number = exact_kind(asked, columns)
                asked, columns = asked.astype(number), columns.astype(number)
                ids, norms, column_norms = listed(batch, row, "c_ids"), block_norms(asked), block_norms(columns)
                for place, name in enumerate(listed(batch, row, "q_ids").tolist()):
                    mine = best.setdefault(name, Best(k))
                    order = np.argsort(-norms[:, place], kind="stable")
                    at, scores = search_tile(asked[:, place], norms[:, place], order, columns, column_norms, mine.least)
                    other = ids[at] != name
                    mine.add(scores[other], ids[at][other])
        found = [(name, mine) for name, mine in best.items() if len(mine.scores)]
        if found:
            names = np.repeat(np.array([name for name, _ in found], object), [len(mine.scores) for _, mine in found])
            columns = [names.tolist(), np.concatenate([mine.ids for _, mine in found]).tolist(), np.concatenate([mine.scores for _, mine in found]).tolist()]
            yield pa.RecordBatch.from_arrays([pa.array(column, field.type) for column, field in zip(columns, target, strict=True)], schema=target)

    with batches_of(vectors.sparkSession, PAIRS_AT_ONCE):
        found = cut_lineage(meetings(queries, tiles).mapInArrow(run, schema))
    order = Window.partitionBy("query_id").orderBy(F.desc("score"), "id")
    ranked = found.withColumn("rank", F.row_number().over(order)).where(F.col("rank") <= k)
    return ranked.select("query_id", "rank", F.col("id").alias(id_col), "score")


#: The same for the given table, whose whole numbers and their products are exact in doubles.
SEARCH_SQL = """
WITH whole AS (
  SELECT vec_id, [floor(256 * CAST(x AS DOUBLE)) for x in embedding] AS v
  FROM embeddings
  WHERE vec_id IS NOT NULL AND embedding IS NOT NULL
    AND len([x for x in embedding if x IS NULL OR NOT isfinite(x)]) = 0
), scored AS (
  SELECT q.vec_id AS query_id, c.vec_id, CAST(list_inner_product(q.v, c.v) AS BIGINT) AS score
  FROM whole q JOIN whole c ON q.vec_id % 50 = 0 AND c.vec_id <> q.vec_id
), ranked AS (
  SELECT *, row_number() OVER (PARTITION BY query_id ORDER BY score DESC, vec_id) AS place FROM scored
)
SELECT query_id, CAST(place AS INTEGER) AS rank, vec_id, score FROM ranked WHERE place <= 5
"""
