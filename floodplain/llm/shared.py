"""What the operators share: tables, slices of Arrow batches, links to components, lineage."""

from __future__ import annotations

import functools
from collections.abc import Callable, Iterator

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
from pyspark import StorageLevel
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql import types as T

from floodplain.session import cut_lineage

# Texts are worked on in slices of about this many characters, whatever the
# number of rows Spark puts into a batch; a longer text is a slice of its own.
SLICE_CHARS = 1_500_000


def table(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    return spark.read.parquet(f"{sf_dir}/{name}.parquet")


def slices(batches: Iterator[pa.RecordBatch], text_col: str = "text", chars: int = SLICE_CHARS) -> Iterator[pa.RecordBatch]:
    """Cut batches so that the texts of one slice stay near ``chars`` bytes."""
    for batch in batches:
        sizes = pc.fill_null(pc.binary_length(batch.column(text_col)), 0).to_numpy(zero_copy_only=False)
        begin, held = 0, 0
        for row, size in enumerate(sizes.tolist()):
            if row > begin and held + size > chars:
                yield batch.slice(begin, row - begin)
                begin, held = row, 0
            held += size
        if batch.num_rows > begin:
            yield batch.slice(begin)


def texts_of(batch: pa.RecordBatch, text_col: str = "text") -> list[str]:
    """The texts of a batch; null reads as empty."""
    return [text or "" for text in batch.column(text_col).to_pylist()]


def map_texts(docs: DataFrame, id_col: str, text_col: str, out: dict[str, T.DataType], work: Callable[[list[str]], dict[str, pa.Array]], chars: int = SLICE_CHARS) -> DataFrame:
    """One row out for each row in: the id and what ``work`` makes of the whole text.

    Only the two named columns reach Python, so other columns may have any name.
    """
    field = docs.schema[id_col]
    schema = T.StructType([T.StructField(id_col, field.dataType), *(T.StructField(name, kind) for name, kind in out.items())])

    def run(batches):
        for batch in slices(batches, text_col, chars):
            made = work(texts_of(batch, text_col))
            yield pa.RecordBatch.from_arrays([batch.column(id_col), *(made[name] for name in out)], names=[id_col, *out])

    return docs.select(id_col, text_col).mapInArrow(run, schema)


def ragged(starts: np.ndarray, sizes: np.ndarray) -> np.ndarray:
    """Indices that gather the runs ``starts[i] .. starts[i] + sizes[i]`` one after another."""
    total = int(sizes.sum())
    if not total:
        return np.zeros(0, np.int64)
    ends = np.cumsum(sizes)
    return np.arange(total, dtype=np.int64) + np.repeat(starts - (ends - sizes), sizes)


def list_array(values: np.ndarray, sizes: np.ndarray) -> pa.Array:
    offsets = np.zeros(len(sizes) + 1, np.int32)
    np.cumsum(sizes, out=offsets[1:])
    return pa.ListArray.from_arrays(pa.array(offsets), pa.array(values))


def local_components(left: np.ndarray, right: np.ndarray, n: int) -> np.ndarray:
    """For ``n`` nodes and their links, the smallest node of each one's component."""
    label = np.arange(n)
    while True:
        low = np.minimum(label[left], label[right])
        new = label.copy()
        np.minimum.at(new, label[left], low)
        np.minimum.at(new, label[right], low)
        while True:
            jumped = new[new]
            if np.array_equal(jumped, new):
                break
            new = jumped
        if np.array_equal(new, label):
            return label
        label = new


def union_all(frames: list[DataFrame]) -> DataFrame:
    return functools.reduce(DataFrame.unionByName, frames)


def components(links: DataFrame, a: str = "a", b: str = "b") -> DataFrame:
    """``(node, component)`` for every node that has a link; the component is its smallest node.

    First every node that is nowhere the smaller end of a link is set aside behind
    its smallest partner, whose other partners are linked with that one instead:
    what then goes round is as large as the set of smaller ends, not as the links.
    Links of a node to itself and repeated or null links are harmless.
    """
    links = cut_lineage(links.where(F.col(a) != F.col(b)).select(F.greatest(a, b).alias("hi"), F.least(a, b).alias("lo")).groupBy("hi", "lo").agg(F.lit(1).alias("_one")).drop("_one"))
    first = cut_lineage(links.groupBy("hi").agg(F.min("lo").alias("first")).withColumnRenamed("hi", "node"))
    ends = links.groupBy("lo").agg(F.lit(1).alias("_one")).select(F.col("lo").alias("end"))
    beside = links.join(first, F.col("hi") == F.col("node")).select(F.col("lo").alias("u"), F.col("first").alias("v"))
    upward = first.join(ends, F.col("node") == F.col("end"), "left_semi").select(F.col("node").alias("u"), F.col("first").alias("v"))
    core = spread_labels(beside.unionByName(upward))
    known = core.select(F.col("node").alias("at"), "component")
    behind = first.join(known, F.col("first") == F.col("at"), "left").select("node", F.coalesce("component", "first").alias("component"))
    # A smaller end that no other one meets has no row in the core.
    alone = ends.select(F.col("end").alias("node")).join(known, F.col("node") == F.col("at"), "left").select("node", F.coalesce("component", "node").alias("component"))
    rest = behind.join(ends, F.col("node") == F.col("end"), "left_anti")
    return cut_lineage(rest.unionByName(alone))


def spread_labels(pairs: DataFrame) -> DataFrame:
    """``(node, component)`` for the nodes of ``pairs`` (u, v) that have another partner than themselves.

    Labels spread along links and are then shortened by following them, so the
    rounds grow with the logarithm of the longest chain. Minima are combined
    before each shuffle and the joins are plain equal-key joins, which adaptive
    execution splits where one node has very many links. Each round is cut off by
    a reliable checkpoint; only whether anything changed comes to the driver.
    """
    pairs = pairs.where("u <> v")
    edges = cut_lineage(pairs.unionByName(pairs.select(F.col("v").alias("u"), F.col("u").alias("v"))).groupBy("u", "v").agg(F.lit(1).alias("_one")).drop("_one"))
    labels = cut_lineage(edges.groupBy("u").agg(F.min("v").alias("low")).select(F.col("u").alias("node"), F.least("u", "low").alias("component")))
    while True:
        heard = edges.join(labels, F.col("v") == F.col("node")).groupBy("u").agg(F.min("component").alias("heard"))
        mine = labels.join(heard, F.col("node") == F.col("u")).select("node", F.col("component").alias("was"), F.least("component", "heard").alias("low"))
        # Hooking: what a node hears also lowers the node it pointed to.
        hooked = mine.groupBy(F.col("was").alias("root")).agg(F.min("low").alias("root_low"))
        # Kept apart from the join that follows, so that one label's many rows can be split there.
        lowered = cut_lineage(mine.join(hooked, F.col("node") == F.col("root"), "left").select("node", "was", F.least("low", F.coalesce("root_low", "low")).alias("to")))
        nxt = lowered.select(F.col("node").alias("at"), F.col("to").alias("beyond"))
        new = lowered.join(nxt, F.col("to") == F.col("at"), "left").select("node", "was", F.least("to", F.coalesce("beyond", "to")).alias("component"))
        new = cut_lineage(new)
        changed = new.where("component <> was").limit(1).count()
        labels = new.select("node", "component")
        if not changed:
            return labels


def group_min(members: DataFrame, labels: DataFrame, node: str) -> DataFrame:
    """Add ``component`` to ``members``: the label of its node, or the node itself where it has no link."""
    named = labels.select(F.col("node").alias("_node"), F.col("component").alias("_component"))
    return members.join(named, members[node] == named["_node"], "left").withColumn("component", F.coalesce("_component", F.col(node))).drop("_node", "_component")


KEEP = StorageLevel.MEMORY_AND_DISK
