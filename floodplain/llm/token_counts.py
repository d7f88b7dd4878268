"""Token counts without tokens: rank-synchronous merging of batched pre-tokens."""

from __future__ import annotations

from itertools import chain, islice

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T

from floodplain.llm.pieces import REMEMBERED, Model, model_of, numbering, read_model
from floodplain.llm.shared import map_texts


class Counter:
    """How many tokens each pre-token makes, for one worker."""

    def __init__(self, model: Model):
        self.model = model
        self.forget()

    def forget(self) -> None:
        self.index = numbering()
        self.tokens = np.zeros(0, np.int64)

    def learn(self, words: list[str]) -> None:
        """Merge all new pre-tokens together and count the surviving symbols; one without a piece counts its bytes."""
        sym, first, number = self.model.merged(words)
        codes, _, _ = self.model.symbols(words)
        code = codes[first]
        weight = np.where(sym < 0, 1 + (code > 0x7F) + (code > 0x7FF) + (code > 0xFFFF), 1)
        owner = np.repeat(np.arange(len(words)), number)
        self.tokens = np.r_[self.tokens, np.bincount(owner, weight, len(words)).astype(np.int64)]

    def count(self, texts: list[str]) -> np.ndarray:
        model = self.model
        if len(self.index) > REMEMBERED:
            self.forget()
        parts = [model.pretokens(model.normalise(text)[0] if model.charmap.rules or model.squeeze else model.escape(text)) for text in texts]
        index, before = self.index, len(self.index)
        sizes = np.fromiter(map(len, parts), np.int64, len(parts))
        numbers = np.fromiter(map(index.__getitem__, chain.from_iterable(parts)), np.int64, int(sizes.sum()))
        if len(index) > before:
            self.learn(list(islice(index, before, None)))
        total = np.r_[0, np.cumsum(self.tokens[numbers])]
        ends = np.cumsum(sizes)
        return total[ends] - total[ends - sizes]


_COUNTERS: dict[int, Counter] = {}


def counter_of(data: bytes) -> Counter:
    model = model_of(data)
    if id(model) not in _COUNTERS:
        _COUNTERS.clear()
        _COUNTERS[id(model)] = Counter(model)
    return _COUNTERS[id(model)]


def token_counts(docs: DataFrame, model: str, limit: int = 4096, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """``(id, n_bytes, n_tokens, over_limit)`` of whole texts, one row per row.

    Pre-tokens of a slice are merged together in ragged arrays; each distinct one
    is merged once per worker. Null and empty texts have no bytes and no tokens;
    repeated rows repeat; an empty table gives an empty one; other columns are
    not read. Nothing is shuffled.
    """
    data = read_model(model)

    def work(texts: list[str]) -> dict[str, pa.Array]:
        return {
            "n_bytes": pa.array([len(text.encode()) for text in texts], pa.int64()),
            "n_tokens": pa.array(counter_of(data).count(texts)),
        }

    counted = map_texts(docs, id_col, text_col, {"n_bytes": T.LongType(), "n_tokens": T.LongType()}, work)
    return counted.withColumn("over_limit", F.col("n_tokens") > F.lit(limit))
