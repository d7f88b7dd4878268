"""Ranked lexical search: impact lists of document slices, searched by the Best Position Algorithm."""

from __future__ import annotations

import math
import uuid
from collections.abc import Iterator
from dataclasses import dataclass
from itertools import repeat

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession, Window
from pyspark.sql import functions as F
from pyspark.sql import types as T

from floodplain.llm.grid import id_order
from floodplain.llm.shared import list_array, slices, texts_of, union_all
from floodplain.llm.tiles import batches_of
from floodplain.session import checkpoint_dir

#: Characters of item text that are broadcast at a time; more items take more scans.
PART_CHARS = 16 << 20
#: Documents whose impact lists are searched together.
SLICE_ROWS = 8192
#: Places that are read from every list in the first round; each round doubles them.
FIRST_DEPTH = 32

# What is no term: ASCII but for digits and letters. Only A-Z are lowered.
_SIGNS = bytes(range(0x30)) + bytes(range(0x3A, 0x41)) + bytes(range(0x5B, 0x61)) + bytes(range(0x7B, 0x80))
_TO_TERMS = bytes.maketrans(_SIGNS + bytes(range(0x41, 0x5B)), b" " * len(_SIGNS) + bytes(range(0x61, 0x7B)))


def terms_of(text: str) -> list[bytes]:
    """Longest runs of digits, letters and signs beyond ASCII, A-Z lowered."""
    return text.encode().translate(_TO_TERMS).split()


def weight(documents: int, holding: int) -> int:
    """A term's weight, as a whole number of thousandths."""
    return math.floor(1000 * math.log((2 * documents + 2) / (2 * holding + 1)))


def impacts(tf: np.ndarray, n: np.ndarray, documents: int, total: int) -> np.ndarray:
    """What ``tf`` occurrences are worth in texts of ``n`` terms, before the term's weight."""
    m = 100 - 75 + (75 * n * documents) // total
    return (1_000_000_000 * tf) // (1000 * tf + 8 * m)


class ImpactList:
    """One term's documents from the highest impact, with the place of each document for direct access."""

    def __init__(self, docs: np.ndarray, impact: np.ndarray):
        order = np.argsort(-impact, kind="stable")
        self.by_impact, self.impact = docs[order], impact[order]
        self.docs = docs  # ascending
        self.place = np.empty(len(docs), np.int64)
        self.place[order] = np.arange(len(docs))

    def look(self, wanted: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
        """``(which, places)``: those of the ``wanted`` documents that the list holds, and where."""
        at = np.minimum(np.searchsorted(self.docs, wanted), len(self.docs) - 1)
        which = np.flatnonzero(self.docs[at] == wanted)
        return which, self.place[at[which]]


def best_position_search(lists: list[tuple[int, ImpactList]], documents: int, least: int | None, k: int, depth: int = FIRST_DEPTH) -> tuple[np.ndarray, np.ndarray]:
    """``(docs, scores)``: among them all documents of the ``k`` highest sums, and of every sum that ties with the last.

    ``lists`` are pairs of a positive factor and a list; a document's sum is over the
    lists that hold it. Lists are read side by side from the highest impact. A
    document met for the first time is looked up in all other lists, and its places
    there count as seen. A list's best position is the end of the places seen
    without a gap; no unseen document can stand before it. The sum of the impacts
    just behind all best positions therefore bounds what is unseen, and reading
    stops when it is strictly below the k-th sum or below ``least``, the sum that
    k documents of other slices reach already.
    """
    known = np.zeros(documents, bool)
    seen = [np.zeros(len(entry.impact) + 1, bool) for _, entry in lists]
    best = [0] * len(lists)
    docs, sums, at = [], [], 0
    top = np.zeros(0, np.int64)
    while True:
        fresh = np.unique(np.concatenate([entry.by_impact[at : at + depth] for _, entry in lists]))
        fresh = fresh[~known[fresh]]
        known[fresh] = True
        total = np.zeros(len(fresh), np.int64)
        for (factor, entry), places in zip(lists, seen, strict=True):
            which, where = entry.look(fresh)
            total[which] += factor * entry.impact[where]
            places[where] = True
        docs.append(fresh)
        sums.append(total)
        at, depth = at + depth, depth * 2
        bound = 0
        for k_list, ((factor, entry), places) in enumerate(zip(lists, seen, strict=True)):
            best[k_list] += int(np.argmin(places[best[k_list] :]))  # the place behind the last one is never seen
            if best[k_list] < len(entry.impact):
                bound += factor * int(entry.impact[best[k_list]])
        top = np.sort(np.r_[top, total])[::-1][:k]
        kth = int(top[-1]) if len(top) == k else None
        reached = max((x for x in (kth, least) if x is not None), default=None)
        if bound == 0 or (reached is not None and bound < reached):
            return np.concatenate(docs), np.concatenate(sums)


@dataclass
class Items:
    """A part of the items: their terms as numbers, and how often each item asks for each."""

    ids: list
    vocabulary: dict[bytes, int]
    asked: list[list[tuple[int, int]]]

    @classmethod
    def build(cls, rows: list[tuple]) -> Items:
        vocabulary: dict[bytes, int] = {}
        ids, asked = [], []
        for item, text in rows:
            numbers = [vocabulary.setdefault(term, len(vocabulary)) for term in terms_of(text or "")]
            if numbers:
                terms, times = np.unique(np.array(numbers), return_counts=True)
                ids.append(item)
                asked.append(list(zip(terms.tolist(), times.tolist(), strict=True)))
        return cls(ids, vocabulary, asked)


def term_counts(docs: DataFrame, vocabulary: dict[bytes, int], id_col: str, text_col: str) -> DataFrame:
    """``(doc, n, terms, tfs)`` of every document with a term: its number of terms, and which of ``vocabulary`` it holds how often."""
    sent = docs.sparkSession.sparkContext.broadcast(vocabulary)
    schema = T.StructType([T.StructField("doc", docs.schema[id_col].dataType), T.StructField("n", T.LongType()), T.StructField("terms", T.ArrayType(T.IntegerType())), T.StructField("tfs", T.ArrayType(T.IntegerType()))])

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        number = sent.value.get
        for batch in slices(batches, text_col):
            split = [terms_of(text) for text in texts_of(batch, text_col)]
            sizes = np.fromiter(map(len, split), np.int64, len(split))
            found = np.fromiter((number(term, -1) for terms in split for term in terms), np.int64, int(sizes.sum()))
            owner = np.repeat(np.arange(len(split)), sizes)
            hit = found >= 0
            pair, tf = np.unique(owner[hit] * (len(sent.value) + 1) + found[hit], return_counts=True)
            per_doc = np.bincount(pair // (len(sent.value) + 1), minlength=len(split))
            terms = list_array((pair % (len(sent.value) + 1)).astype(np.int32), per_doc)
            made = pa.RecordBatch.from_arrays([batch.column(id_col), pa.array(sizes), terms, list_array(tf.astype(np.int32), per_doc)], names=["doc", "n", "terms", "tfs"])
            yield made.filter(pa.array(sizes > 0))

    return docs.select(id_col, text_col).mapInArrow(run, schema)


def search_slices(counted: DataFrame, items: Items, weights: np.ndarray, documents: int, total: int, k: int, item_type: T.DataType) -> DataFrame:
    """``(item, doc, score)``: of every slice of documents, each item's first ``k`` that earlier slices of the task do not rule out."""
    schema = T.StructType([T.StructField("item", item_type), T.StructField("doc", counted.schema["doc"].dataType), T.StructField("score", T.LongType())])
    sent = counted.sparkSession.sparkContext.broadcast((items, weights))

    def lists_of(batch: pa.RecordBatch) -> dict[int, ImpactList]:
        terms, tfs = batch.column("terms"), batch.column("tfs")
        sizes = np.diff(terms.offsets.to_numpy())
        owner = np.repeat(np.arange(batch.num_rows), sizes)
        flat, n = terms.flatten().to_numpy(), batch.column("n").to_numpy()
        impact = impacts(tfs.flatten().to_numpy().astype(np.int64), n[owner], documents, total)
        order = np.argsort(flat, kind="stable")
        cuts = np.flatnonzero(np.diff(flat[order])) + 1
        return {int(flat[at[0]]): ImpactList(owner[at], impact[at]) for at in np.split(order, cuts) if len(at)}

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        from pyspark.sql.pandas.types import to_arrow_schema

        items, weights = sent.value
        target = to_arrow_schema(schema)
        best: list[list[tuple[int, object]]] = [[] for _ in items.ids]
        for batch in batches:
            ids = batch.column("doc").to_numpy(zero_copy_only=False)
            # Documents are numbered by their ids, so that ties fall alike everywhere.
            batch = batch.take(pa.array(np.argsort(id_order(ids), kind="stable")))
            ids, lists = batch.column("doc").to_pylist(), lists_of(batch)
            for number, asked in enumerate(items.asked):
                mine = [(times * int(weights[term]), lists[term]) for term, times in asked if weights[term] > 0 and term in lists]
                if not mine:
                    continue
                least = best[number][-1][0] if len(best[number]) == k else None
                docs, scores = best_position_search(mine, len(ids), least, k)
                at = np.flatnonzero(scores > 0)
                at = at[np.lexsort((docs[at], -scores[at]))[:k]]
                merged = [*best[number], *((int(scores[place]), ids[docs[place]]) for place in at.tolist())]
                best[number] = sorted(merged, key=lambda row: (-row[0], row[1]))[:k]
        rows = [(item, doc, score) for item, found in zip(items.ids, best, strict=True) for score, doc in found]
        if rows:
            yield pa.RecordBatch.from_arrays([pa.array(column, field.type) for column, field in zip(zip(*rows, strict=True), target, strict=True)], schema=target)

    with batches_of(counted.sparkSession, SLICE_ROWS):
        return counted.where("doc IS NOT NULL").mapInArrow(run, schema)


def lexical_search(
    docs: DataFrame, items: DataFrame, k: int = 10, id_col: str = "doc_id", text_col: str = "text", item_col: str = "item_id", item_text_col: str = "text", part_chars: int = PART_CHARS,
) -> DataFrame:
    """``(item, rank, doc, score)``: each item's ``k`` documents with the highest score above 0, fewer if there are fewer.

    Terms are runs of digits, letters and signs beyond ASCII in whole texts, A-Z
    lowered. A term's weight is ``floor(1000 * ln((2N + 2) / (2df + 1)))``, N being
    the documents with a term; an occurrence count tf in a document of n terms is
    worth ``10**9 * tf // (1000 * tf + 8 * m)`` with ``m = 25 + 75 * n * N // L``, L
    being all terms of all documents; a score sums weight times worth over the
    item's terms, repeated ones as often as they stand. Equal scores go to the
    smaller id. Null and empty texts and items have no terms: they find nothing
    and are not found. Repeated documents are ranked each; documents without an
    id count for N, L and df but are not ranked. Of several texts under one item
    id the smallest is taken. Empty tables give no rows; other columns are not read.

    Items are broadcast ``part_chars`` characters at a time; each part is written
    before the next is read. Documents are counted once a part and never shuffled:
    every task searches its slices of ``SLICE_ROWS`` documents one after another
    and sends on each item's first ``k``.
    """
    spark = docs.sparkSession
    asked = items.select(F.col(item_col).alias("item"), F.col(item_text_col).alias("text")).where("text IS NOT NULL").groupBy("item").agg(F.min("text").alias("text"))
    kind = items.schema[item_col].dataType
    chars = asked.agg(F.sum(F.length("text"))).first()[0] or 0
    parts = max(1, -(-chars // part_chars))
    base = f"{checkpoint_dir(spark)}/lexical-{uuid.uuid4().hex}"
    slot = F.pmod(F.xxhash64("item", "text"), F.lit(parts))
    found = [_search_part(spark, docs, Items.build(sorted(map(tuple, asked.where(slot == part).collect()), key=repr)), k, id_col, text_col, kind, f"{base}/{part}") for part in range(parts)]
    order = Window.partitionBy("item").orderBy(F.desc("score"), "doc")
    ranked = union_all(found).withColumn("rank", F.row_number().over(order)).where(F.col("rank") <= k)
    return ranked.select(F.col("item").alias(item_col), "rank", F.col("doc").alias(id_col), "score")


def _search_part(spark: SparkSession, docs: DataFrame, items: Items, k: int, id_col: str, text_col: str, item_type: T.DataType, path: str) -> DataFrame:
    term_counts(docs, items.vocabulary, id_col, text_col).write.parquet(f"{path}/counts")
    counted = spark.read.parquet(f"{path}/counts")
    documents, total = counted.agg(F.count(F.lit(1)), F.coalesce(F.sum("n"), F.lit(0))).first()
    weights = np.zeros(len(items.vocabulary), np.int64)
    for term, holding in counted.select(F.explode("terms").alias("term")).groupBy("term").count().collect():  # a row for each term of the part
        weights[term] = weight(documents, holding)
    search_slices(counted, items, weights, documents, total, k, item_type).write.parquet(f"{path}/found")
    return spark.read.parquet(f"{path}/found")


LEXICAL_SQL = r"""
WITH doc_terms AS (
  SELECT row_number() OVER () AS place, doc_id,
    regexp_extract_all(translate(coalesce(text, ''), 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz'), '[^\x00-\x2F\x3A-\x40\x5B-\x60\x7B-\x7F]+') AS terms
  FROM documents
), sized AS (
  SELECT place, doc_id, CAST(len(terms) AS BIGINT) AS n, terms FROM doc_terms WHERE len(terms) > 0
), whole AS (
  SELECT CAST(count(*) AS BIGINT) AS docs, CAST(sum(n) AS BIGINT) AS total FROM sized
), counted AS (
  SELECT place, doc_id, n, term, CAST(count(*) AS BIGINT) AS tf
  FROM (SELECT place, doc_id, n, unnest(terms) AS term FROM sized) GROUP BY ALL
), weights AS (
  SELECT term, CAST(floor(1000 * ln((2 * docs + 2) / CAST(2 * df + 1 AS DOUBLE))) AS BIGINT) AS w
  FROM (SELECT term, count(*) AS df FROM counted GROUP BY term), whole
), items AS (
  SELECT item_id, unnest(regexp_extract_all(translate(text, 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz'), '[^\x00-\x2F\x3A-\x40\x5B-\x60\x7B-\x7F]+')) AS term
  FROM (SELECT item_id, min(text) AS text FROM benchmark GROUP BY item_id)
), scored AS (
  SELECT item_id, place, doc_id,
    CAST(sum(w * ((1000000000 * tf) // (1000 * tf + 8 * (100 - 75 + ((75 * n * docs) // total))))) AS BIGINT) AS score
  FROM items JOIN counted USING (term) JOIN weights USING (term), whole
  WHERE doc_id IS NOT NULL
  GROUP BY item_id, place, doc_id
), ranked AS (
  SELECT *, row_number() OVER (PARTITION BY item_id ORDER BY score DESC, doc_id) AS pos FROM scored WHERE score > 0
)
SELECT item_id, CAST(pos AS INTEGER) AS rank, doc_id, score FROM ranked WHERE pos <= 10
"""
