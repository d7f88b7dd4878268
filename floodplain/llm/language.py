"""Language identification: multinomial naive Bayes over hashed character n-grams."""

from __future__ import annotations

import functools
from collections.abc import Iterator
from dataclasses import dataclass

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T

from floodplain.llm.shared import map_texts, slices, texts_of

GRAMS = (1, 2, 3)
BUCKET_BITS = 15
BUCKETS = 1 << BUCKET_BITS
SMOOTHING = 0.5
#: Labelled documents per language that the model is fitted on, chosen by a hash of the id.
TRAIN_ROWS = 20_000
#: The log-probability matrix is broadcast: so many languages at most (64 MB).
MAX_LANGUAGES = 256
UNDETERMINED = "und"
_MIX, _SPREAD = np.uint32(0x01000193), np.uint32(0x9E3779B1)


@functools.cache
def letters() -> np.ndarray:
    return np.fromiter((chr(c).isalpha() for c in range(0x110000)), bool, 0x110000)


def grams_of(texts: list[str]) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """``(bucket, text, has_letter)``: every n-gram of every whole text, and whether a text has a letter.

    Letters are lowered and everything else reads as a space; a gram lies within
    one text and has a letter at its beginning or its end.
    """
    low = [text.lower() for text in texts]
    codes = np.frombuffer("".join(low).encode("utf-32-le"), np.uint32)
    sizes = np.fromiter(map(len, low), np.int64, len(low))
    owner = np.repeat(np.arange(len(low), dtype=np.int32), sizes)
    letter = letters()[codes]
    codes = np.where(letter, codes, np.uint32(32))
    has_letter = np.bincount(owner[letter], minlength=len(low)) > 0
    buckets, owners = [], []
    mixed = np.full(len(codes), 0x811C9DC5, np.uint32)
    for n in range(1, max(GRAMS) + 1):
        if len(codes) < n:
            break
        # mixed[i] covers the n characters from i on.
        mixed = (mixed[: len(codes) - n + 1] ^ codes[n - 1 :]) * _MIX
        mixed ^= mixed >> np.uint32(15)
        if n in GRAMS:
            last = slice(n - 1, len(codes))
            good = (owner[: len(mixed)] == owner[last]) & (letter[: len(mixed)] | letter[last])
            buckets.append(((mixed[good] + np.uint32(n)) * _SPREAD) >> np.uint32(32 - BUCKET_BITS))
            owners.append(owner[: len(mixed)][good])
    if not buckets:
        return np.zeros(0, np.uint32), np.zeros(0, np.int32), has_letter
    return np.concatenate(buckets), np.concatenate(owners), has_letter


@dataclass
class LanguageModel:
    """``logp[bucket, language]`` with the languages' names in order and their log priors."""

    names: list[str]
    prior: np.ndarray
    logp: np.ndarray

    def predict(self, texts: list[str]) -> tuple[list[str], np.ndarray]:
        """The best language of each text and its posterior probability; the first name wins a tie."""
        bucket, owner, has_letter = grams_of(texts)
        if not self.names:
            return [UNDETERMINED] * len(texts), np.zeros(len(texts))
        total = np.stack([np.bincount(owner, self.logp[:, k][bucket], len(texts)) + self.prior[k] for k in range(len(self.names))], axis=1)
        best = total.argmax(1)
        top = total[np.arange(len(texts)), best]
        score = 1 / np.exp(total - top[:, None]).sum(1)
        return [self.names[k] if ok else UNDETERMINED for k, ok in zip(best.tolist(), has_letter.tolist(), strict=True)], np.where(has_letter, score, 0.0)


def held_out(id_col: str = "doc_id") -> Column:
    """Whether the CRC-32 of the id's text is divisible by five; never of a null id."""
    return F.coalesce(F.crc32(F.col(id_col).cast("string").cast("binary")) % 5 == 0, F.lit(False))


def train(docs: DataFrame, rows_per_language: int = TRAIN_ROWS, id_col: str = "doc_id", text_col: str = "text", lang_col: str = "lang") -> LanguageModel:
    """Fit on labelled documents that are not held out, about ``rows_per_language`` of each language.

    The sample is the documents whose id hashes below the language's share, the
    same on every run. Grams are counted within the tasks and summed by
    (language, bucket); what reaches the driver is bounded by the matrix.
    """
    labelled = docs.select(F.col(id_col).alias("id"), F.col(text_col).alias("text"), F.col(lang_col).cast("string").alias("lang")).where(
        F.col("id").isNotNull() & F.col("text").isNotNull() & F.col("lang").isNotNull() & ~held_out("id"))
    counts = labelled.groupBy("lang").agg(F.count(F.lit(1)).alias("n")).orderBy("lang").limit(MAX_LANGUAGES + 1).collect()
    if len(counts) > MAX_LANGUAGES:
        raise ValueError(f"more than {MAX_LANGUAGES} languages; the matrix would not be small enough to broadcast")
    names = [row["lang"] for row in counts]
    if not names:
        return LanguageModel([], np.zeros(0), np.zeros((BUCKETS, 0)))
    index = {name: k for k, name in enumerate(names)}
    share = F.create_map(*(F.lit(x) for row in counts for x in (row["lang"], min(1.0, rows_per_language / row["n"]))))
    spot = F.pmod(F.xxhash64("id"), F.lit(1_000_003)) / 1_000_003.0
    sample = labelled.where(spot < share[F.col("lang")]).select("lang", "text")

    def count(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        held = np.zeros((len(names), BUCKETS), np.int64)
        for batch in slices(batches, "text"):
            lang = np.array([index[name] for name in batch.column("lang").to_pylist()], np.int64)
            bucket, owner, _ = grams_of(texts_of(batch, "text"))
            if len(bucket):
                held += np.bincount(lang[owner] * BUCKETS + bucket, minlength=held.size).reshape(held.shape)
        k, bucket = np.nonzero(held)
        yield pa.RecordBatch.from_arrays([pa.array(k.astype(np.int32)), pa.array(bucket.astype(np.int32)), pa.array(held[k, bucket])], names=["k", "bucket", "n"])

    sums = sample.mapInArrow(count, "k int, bucket int, n long").groupBy("k", "bucket").agg(F.sum("n").alias("n")).toArrow()
    seen = np.zeros((BUCKETS, len(names)))
    seen[sums["bucket"].to_numpy(), sums["k"].to_numpy()] = sums["n"].to_numpy()
    logp = np.log(seen + SMOOTHING) - np.log(seen.sum(0) + SMOOTHING * BUCKETS)
    docs_of = np.array([row["n"] for row in counts], float)
    return LanguageModel(names, np.log(docs_of / docs_of.sum()), logp)


def identify(docs: DataFrame, model: LanguageModel, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """``(id, lang_pred, score)`` of whole texts, one row per row, the score being the posterior probability.

    Null and empty texts and those without a letter are ``und`` with score 0, and
    so is everything if nothing was learned. Repeated rows repeat. Nothing is
    shuffled; only the id and the text are read.
    """
    sent = docs.sparkSession.sparkContext.broadcast(model)

    def work(texts: list[str]) -> dict[str, pa.Array]:
        names, scores = sent.value.predict(texts)
        return {"lang_pred": pa.array(names, pa.string()), "score": pa.array(scores)}

    return map_texts(docs, id_col, text_col, {"lang_pred": T.StringType(), "score": T.DoubleType()}, work)


def keep_identified(docs: DataFrame, model: LanguageModel, min_score: float = 0.5, text_col: str = "text") -> DataFrame:
    """The rows and columns of documents whose language is determined with at least even odds.

    Null and empty texts and those without a letter go. If nothing was learned, no
    language can be told from another and all texts with a letter stay. Repeated rows
    are judged alike.
    """
    if not model.names:
        return docs.where(F.col(text_col).rlike(r"\p{L}"))
    sent = docs.sparkSession.sparkContext.broadcast(model)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in slices(batches, text_col):
            names, scores = sent.value.predict(texts_of(batch, text_col))
            good = np.array([name != UNDETERMINED for name in names], bool) & (scores >= min_score)
            yield batch.filter(pa.array(good))

    return docs.mapInArrow(run, docs.schema)
