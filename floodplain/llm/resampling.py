"""Quality by importance resampling: hashed n-gram models of target and raw text, Gumbel top-k."""

from __future__ import annotations

import zlib
from collections.abc import Iterator
from itertools import islice

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T

from floodplain.llm.pieces import numbering
from floodplain.llm.shared import map_texts, slices, texts_of
from floodplain.session import cut_lineage

BUCKETS = 10_000
SMOOTHING = 1.0
SEED = 42
REMEMBERED = 250_000
#: Labelled documents that the target model is fitted on, chosen by a hash of the id.
TARGET_ROWS = 20_000


class Words:
    """CRC-32 of each distinct word, remembered by a worker."""

    def __init__(self):
        self.forget()

    def forget(self) -> None:
        self.index = numbering()
        self.hashes = np.zeros(0, np.uint32)

    def hash(self, words: list[bytes]) -> np.ndarray:
        if len(self.index) > REMEMBERED:
            self.forget()
        before = len(self.index)
        numbers = np.fromiter(map(self.index.__getitem__, words), np.int64, len(words))
        if len(self.index) > before:
            new = np.fromiter(map(zlib.crc32, islice(self.index, before, None)), np.uint32, len(self.index) - before)
            self.hashes = np.r_[self.hashes, new]
        return self.hashes[numbers]


_WORDS = Words()


def grams_of(texts: list[str]) -> tuple[np.ndarray, np.ndarray]:
    """``(bucket, text)`` of every word and every two neighbouring words of whole texts, A-Z lowered."""
    parts = [text.encode().lower().split() for text in texts]
    sizes = np.fromiter(map(len, parts), np.int64, len(parts))
    owner = np.repeat(np.arange(len(parts), dtype=np.int32), sizes)
    one = _WORDS.hash([word for part in parts for word in part]).astype(np.uint64)
    same = owner[1:] == owner[:-1]
    two = (one[:-1] * np.uint64(0x9E3779B1) + one[1:] + np.uint64(1))[same]
    two ^= two >> np.uint64(29)
    return np.r_[one % np.uint64(BUCKETS), two % np.uint64(BUCKETS)].astype(np.int64), np.r_[owner, owner[1:][same]]


def gram_counts(docs: DataFrame, text_col: str = "text") -> np.ndarray:
    """How often each bucket occurs in all texts: summed in the tasks, then by bucket; 10 000 numbers come back."""

    def count(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        held = np.zeros(BUCKETS, np.int64)
        for batch in slices(batches, text_col):
            held += np.bincount(grams_of(texts_of(batch, text_col))[0], minlength=BUCKETS)
        at = np.flatnonzero(held)
        yield pa.RecordBatch.from_arrays([pa.array(at.astype(np.int32)), pa.array(held[at])], names=["bucket", "n"])

    sums = docs.select(text_col).mapInArrow(count, "bucket int, n long").groupBy("bucket").agg(F.sum("n").alias("n")).toArrow()
    out = np.zeros(BUCKETS)
    out[sums["bucket"].to_numpy()] = sums["n"].to_numpy()
    return out


def log_ratio(target: np.ndarray, raw: np.ndarray) -> np.ndarray:
    """Log of each bucket's probability in the target over that in the raw text."""

    def logp(counts: np.ndarray) -> np.ndarray:
        return np.log(counts + SMOOTHING) - np.log(counts.sum() + SMOOTHING * BUCKETS)

    return logp(target) - logp(raw)


def weigh(docs: DataFrame, ratio: np.ndarray, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """``(id, n_grams, log_weight)``: the summed log ratio of a whole text's grams."""
    sent = docs.sparkSession.sparkContext.broadcast(ratio)

    def work(texts: list[str]) -> dict[str, pa.Array]:
        bucket, owner = grams_of(texts)
        return {"n_grams": pa.array(np.bincount(owner, minlength=len(texts))), "log_weight": pa.array(np.bincount(owner, sent.value[bucket], len(texts)).astype(float))}

    return map_texts(docs, id_col, text_col, {"n_grams": T.LongType(), "log_weight": T.DoubleType()}, work)


def kth_largest(rows: DataFrame, key: str, k: int, bins: int = 4096) -> float | None:
    """The k-th largest value of ``key``, from counts in ever narrower intervals; no row is sorted or moved."""
    low, high, n = rows.agg(F.min(key), F.max(key), F.count(key)).first()
    if k <= 0 or not n:
        return None
    if k >= n:
        return low
    wanted = k
    while low < high:
        width = (high - low) / bins
        if not width:
            break
        slot = F.least(F.floor((F.col(key) - low) / width), F.lit(bins - 1))
        inside = rows.where(F.col(key).between(low, high))
        found = inside.groupBy(slot.alias("slot")).agg(F.count(F.lit(1)).alias("n"), F.min(key).alias("low"), F.max(key).alias("high")).orderBy(F.desc("slot")).collect()
        before = (low, high)
        for row in found:
            if wanted <= row["n"]:
                low, high = row["low"], row["high"]
                break
            wanted -= row["n"]
        if before == (low, high):
            break
    return low


def resample(docs: DataFrame, target: DataFrame, share: float = 0.5, seed: int = SEED, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """``(id, n_grams, log_weight, gumbel_key, selected)``: every row, and whether sampling took it.

    Both models count all grams of all their texts. The key is the log weight plus
    Gumbel noise drawn from a hash of the id, the text and the seed, so that a
    rerun draws alike; the ``share`` of rows with the largest keys is a sample
    without replacement in proportion to the weights. Ties at the border are
    taken whole. Texts without a word weigh 0 and compete like any other; null
    texts are empty; repeated rows draw the same noise. An empty target has the
    uniform model; an empty table gives an empty one.
    """
    weighed = cut_lineage(weigh(
        docs.select(F.struct(F.col(id_col).alias("id"), F.xxhash64(F.col(id_col), F.col(text_col), F.lit(seed)).alias("draw")).alias("row"), F.col(text_col).alias("text")),
        log_ratio(gram_counts(target, text_col), gram_counts(docs, text_col)), "row", "text",
    ).select("row.id", "n_grams", "log_weight", (F.col("log_weight") - F.log(-F.log((F.pmod(F.col("row.draw"), F.lit(1 << 52)) + 0.5) / float(1 << 52)))).alias("gumbel_key")))
    n = weighed.count()
    border = kth_largest(weighed, "gumbel_key", int(np.ceil(share * n)))
    selected = F.lit(False) if border is None else F.col("gumbel_key") >= F.lit(border)
    return weighed.select(F.col("id").alias(id_col), "n_grams", "log_weight", "gumbel_key", selected.alias("selected"))


def labelled_target(docs: DataFrame, labels: DataFrame, rows: int = TARGET_ROWS, id_col: str = "doc_id", quality_col: str = "quality", toxic_col: str = "toxic") -> DataFrame:
    """Documents labelled good and not toxic: the texts that sampling is to resemble.

    At most ``rows`` labelled ids, those that hash lowest, so that the ids can be
    broadcast and no text is shuffled to find them.
    """
    good = labels.where((F.col(quality_col) == 1) & (F.coalesce(toxic_col, F.lit(0)) == 0)).select(F.col(id_col).alias("_good")).where("_good IS NOT NULL").distinct()
    good = F.broadcast(good.orderBy(F.xxhash64("_good"), "_good").limit(rows))
    return docs.join(good, docs[id_col] == good["_good"], "left_semi")
