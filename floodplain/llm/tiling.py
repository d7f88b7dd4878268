"""Benchmark decontamination by greedy string tiling over seeds that rolling hashes find."""

from __future__ import annotations

import re
from collections import defaultdict
from collections.abc import Iterator
from dataclasses import dataclass
from itertools import repeat

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T

from floodplain.llm.shared import slices, texts_of, union_all

WORD = re.compile(r"\w+")
_BASE = np.uint64(0x100000001B3)
#: Characters of benchmark text that are broadcast at a time; a larger benchmark
#: is taken in parts, each in a scan of its own.
PART_CHARS = 32 << 20


def tokens_of(text: str) -> list[str]:
    return WORD.findall(text.lower())


def rolling(ids: np.ndarray, size: int) -> np.ndarray:
    """Karp-Rabin hashes of every run of ``size`` ids, modulo 2**64."""
    out = np.zeros(max(0, len(ids) - size + 1), np.uint64)
    for k in range(size):
        out = out * _BASE + ids[k : k + len(out)].astype(np.uint64)
    return out


def tile(doc: list[int], item: list[int], seeds: list[tuple[int, int]], least: int) -> list[tuple[int, int, int]]:
    """Tiles ``(doc place, item place, length)``: the longest matches first, none overlapping in either text.

    Each round grows every seed whose tokens are still free as far as free equal
    tokens go and takes the longest of them, the leftmost first; it ends when
    none is ``least`` tokens long. Seeds are all places where ``least`` tokens agree.
    """
    doc_used, item_used, tiles = set(), set(), []
    open_seeds = sorted(seeds)
    while open_seeds:
        grown, still = [], []
        covered: dict[int, int] = {}
        for i, j in open_seeds:
            # A seed inside a match that began further left on the same diagonal adds nothing.
            if covered.get(i - j, -1) > i:
                still.append((i, j))
                continue
            n = 0
            while i + n < len(doc) and j + n < len(item) and doc[i + n] == item[j + n] and i + n not in doc_used and j + n not in item_used:
                n += 1
            if n >= least:
                grown.append((-n, i, j))
                still.append((i, j))
                covered[i - j] = i + n - least + 1
        if not grown:
            break
        grown.sort()
        longest = -grown[0][0]
        for n, i, j in grown:
            if -n < longest:
                break
            if any(i + k in doc_used or j + k in item_used for k in range(longest)):
                continue
            tiles.append((i, j, longest))
            doc_used.update(range(i, i + longest))
            item_used.update(range(j, j + longest))
        open_seeds = still
    return sorted(tiles)


@dataclass
class Benchmark:
    """The items' tokens as numbers, and where every seed occurs in them."""

    items: list
    vocabulary: dict[str, int]
    tokens: list[list[int]]
    least: list[int]
    seeds: dict[int, dict[int, list[tuple[int, int]]]]
    sorted_seeds: dict[int, np.ndarray]

    @classmethod
    def build(cls, rows: list[tuple], min_match: int) -> Benchmark:
        vocabulary: dict[str, int] = {}
        items, tokens, least = [], [], []
        seeds: dict[int, dict[int, list[tuple[int, int]]]] = defaultdict(lambda: defaultdict(list))
        for item_id, text in rows:
            words = tokens_of(text or "")
            if not words:
                continue
            ids = [vocabulary.setdefault(word, len(vocabulary) + 1) for word in words]
            size = min(min_match, len(ids))
            for j, seed in enumerate(rolling(np.array(ids), size).tolist()):
                seeds[size][seed].append((len(items), j))
            items.append(item_id)
            tokens.append(ids)
            least.append(size)
        ordered = {size: np.sort(np.fromiter(table, np.uint64, len(table))) for size, table in seeds.items()}
        return cls(items, vocabulary, tokens, least, {size: dict(table) for size, table in seeds.items()}, ordered)

    def matches(self, text: str, threshold: float) -> list[tuple[int, list[tuple[int, int, int]]]]:
        """``(item number, tiles)`` of the items of which tiles cover at least ``threshold`` of the tokens."""
        words = tokens_of(text)
        ids = np.fromiter(map(self.vocabulary.get, words, repeat(0)), np.int64, len(words))
        found: dict[int, list[tuple[int, int]]] = defaultdict(list)
        doc: list[int] | None = None
        for size, ordered in self.sorted_seeds.items():
            if len(ids) < size:
                continue
            known = np.convolve(ids > 0, np.ones(size, np.int64), "valid") == size if size > 1 else ids > 0
            at = np.flatnonzero(known)
            if not len(at):
                continue
            hashes = rolling(ids, size)[at]
            place = np.minimum(np.searchsorted(ordered, hashes), len(ordered) - 1)
            hit = ordered[place] == hashes
            if not hit.any():
                continue
            doc = doc if doc is not None else ids.tolist()
            table = self.seeds[size]
            for i, seed in zip(at[hit].tolist(), hashes[hit].tolist(), strict=True):
                for item, j in table[seed]:
                    if doc[i : i + size] == self.tokens[item][j : j + size]:
                        found[item].append((i, j))
        out = []
        for item, seeds in sorted(found.items()):
            size, whole = self.least[item], len(self.tokens[item])
            # Every tile is made of seeds, so what seeds cover bounds what tiles can.
            reach = {k for j in {j for _, j in seeds} for k in range(j, j + size)}
            if len(reach) < threshold * whole:
                continue
            tiles = tile(doc, self.tokens[item], seeds, size)
            if sum(n for _, _, n in tiles) >= threshold * whole:
                out.append((item, tiles))
        return out


TILE = T.StructType([T.StructField("doc_token", T.IntegerType(), False), T.StructField("item_token", T.IntegerType(), False), T.StructField("length", T.IntegerType(), False)])


def parts_of(benchmark: DataFrame, min_match: int, item_col: str, text_col: str, part_chars: int) -> Iterator[Benchmark]:
    """The benchmark in parts small enough to broadcast, whatever its size: the driver holds one at a time."""
    rows = benchmark.select(F.col(item_col).alias("item"), F.col(text_col).alias("text")).where("text IS NOT NULL")
    chars = rows.agg(F.sum(F.length("text"))).first()[0] or 0
    parts = -(-chars // part_chars)
    slot = F.pmod(F.xxhash64("item", "text"), F.lit(max(1, parts)))
    for k in range(parts):
        yield Benchmark.build(sorted(map(tuple, rows.where(slot == k).collect()), key=lambda r: (str(r[0]), r[1])), min_match)


def find_leaks(
    docs: DataFrame, benchmark: DataFrame, min_match: int = 5, threshold: float = 0.5,
    id_col: str = "doc_id", text_col: str = "text", item_col: str = "item_id", item_text_col: str = "text", part_chars: int = PART_CHARS,
) -> DataFrame:
    """``(id, item, matched, item_tokens, coverage, tiles, reordered)``: a row for each text and the item it holds.

    Tokens are runs of word signs in lower case. Texts are joined with the items
    on shared runs of ``min_match`` tokens (an item with fewer must occur whole),
    tiled greedily, and kept where the tiles cover at least ``threshold`` of the
    item, in whatever order: ``reordered`` says that some tile stands before one
    that precedes it in the item. Documents are neither shuffled nor sampled; a
    passage that very many of them share is work for each one's own task. Null
    and empty texts and items match nothing; repeated rows repeat; other columns
    are not read.
    """
    from pyspark.sql.pandas.types import to_arrow_schema

    schema = T.StructType([
        T.StructField(id_col, docs.schema[id_col].dataType), T.StructField(item_col, benchmark.schema[item_col].dataType),
        T.StructField("matched", T.IntegerType()), T.StructField("item_tokens", T.IntegerType()), T.StructField("coverage", T.DoubleType()),
        T.StructField("tiles", T.ArrayType(TILE, False)), T.StructField("reordered", T.BooleanType())])
    target = to_arrow_schema(schema)
    context = docs.sparkSession.sparkContext

    def scan(part: Benchmark) -> DataFrame:
        sent = context.broadcast(part)

        def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
            known = sent.value
            for batch in slices(batches, text_col):
                ids = batch.column(id_col).to_pylist()
                out = []
                for doc_id, text in zip(ids, texts_of(batch, text_col), strict=True):
                    for item, tiles in known.matches(text, threshold):
                        matched, whole = sum(n for _, _, n in tiles), len(known.tokens[item])
                        order = [j for _, j, _ in tiles]
                        spans = [{"doc_token": i, "item_token": j, "length": n} for i, j, n in tiles]
                        out.append((doc_id, known.items[item], matched, whole, matched / whole, spans, order != sorted(order)))
                if out:
                    yield pa.RecordBatch.from_arrays([pa.array(column, field.type) for column, field in zip(zip(*out, strict=True), target, strict=True)], schema=target)

        return docs.select(id_col, text_col).mapInArrow(run, schema)

    scans = [scan(part) for part in parts_of(benchmark, min_match, item_col, item_text_col, part_chars)]
    return union_all(scans) if scans else docs.sparkSession.createDataFrame([], schema)


def drop_leaks(
    docs: DataFrame, benchmark: DataFrame, min_match: int = 5, threshold: float = 0.5,
    text_col: str = "text", item_col: str = "item_id", item_text_col: str = "text", part_chars: int = PART_CHARS,
) -> DataFrame:
    """The rows and columns of documents that hold no benchmark item to the threshold.

    Null and empty texts hold none and stay; so do all documents if the benchmark is
    empty or holds only nulls. Repeated rows are judged alike; nothing is shuffled.
    """
    context = docs.sparkSession.sparkContext

    def clean(rows: DataFrame, part: Benchmark) -> DataFrame:
        sent = context.broadcast(part)

        def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
            known = sent.value
            for batch in slices(batches, text_col):
                yield batch.filter(pa.array([not known.matches(text, threshold) for text in texts_of(batch, text_col)], pa.bool_()))

        return rows.mapInArrow(run, docs.schema)

    for part in parts_of(benchmark, min_match, item_col, item_text_col, part_chars):
        docs = clean(docs, part)
    return docs
