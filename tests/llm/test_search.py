"""Exact search, hard negatives and lexical ranking against comparing everything."""

import math
import re
from collections import Counter

import numpy as np
import pytest
from hypothesis import given, settings
from hypothesis import strategies as st
from pyspark.sql import functions as F

from floodplain.llm import grid, lexical, negatives, search

CLASH = ["id", "v", "n", "tile", "dims", "values", "ids", "score", "rank", "place", "q_ids", "asks", "anchor", "anchor_id", "query_id", "scores", "item", "doc", "terms"]
VECTORS = "vec_id LONG, embedding ARRAY<FLOAT>, label INT"


def floored(v):
    if v is None or any(x is None or not math.isfinite(x) for x in v):
        return None
    return [math.floor(256 * float(x)) for x in v]


def dot(a, b):
    return sum(x * y for x, y in zip(a, b, strict=True))


def plain_top(rows, asks, k):
    known = [(i, w) for i, v, _ in rows if i is not None and (w := floored(v)) is not None]
    out = []
    for q in sorted({i for i, _ in known if asks(i)}):
        mine = min(w for i, w in known if i == q)
        scored = sorted((-dot(mine, w), i) for i, w in known if i != q and len(w) == len(mine))
        out += [(q, rank, i, -score) for rank, (score, i) in enumerate(scored[:k], 1)]
    return sorted(out)


def plain_negatives(rows, asks, positives=5, negatives=10, low=30, high=90, whole=100):
    known = [(i, w, label) for i, v, label in rows if i is not None and label is not None and (w := floored(v)) is not None]
    out = []
    for a in sorted({i for i, _, _ in known if asks(i)}):
        label, mine = min((label, w) for i, w, label in known if i == a)
        scored = sorted((-dot(mine, w), i, other) for i, w, other in known if len(w) == len(mine))
        first = [(i, -s) for s, i, other in scored if other == label and i != a][:positives]
        for p, ps in first:
            fits = [(i, -s) for s, i, other in scored if other != label and low * ps <= whole * -s <= high * ps]
            out += [(a, p, rank, i, ps, s) for rank, (i, s) in enumerate(fits[:negatives], 1)]
    return sorted(out)


def sample(seed, n=180, dims=12):
    """Clustered and scattered vectors, ties, copies under new ids, repeated rows, and everything that takes no part."""
    draw = np.random.default_rng(seed)
    centres = draw.normal(size=(6, dims)) * draw.choice([0.2, 1, 3], size=(6, 1))
    rows = []
    for i in range(n):
        base = centres[draw.integers(6)] if draw.random() < 0.7 else draw.normal(size=dims)
        rows.append((i, [float(np.float32(x)) for x in base + draw.normal(size=dims) * draw.choice([0, 0.05, 0.4])], int(draw.integers(4))))
    rows += [(n + k, rows[10][1], rows[10][2]) for k in range(12)]
    rows += [rows[0], rows[3], rows[3]]
    bad = [None, [None] * dims, [float("nan")] * dims, [float("inf")] + [0.0] * (dims - 1)]
    rows += [(400 + k, v, 1) for k, v in enumerate(bad)]
    rows += [(None, rows[1][1], 1), (410, [0.0] * dims, 2), (420, rows[1][1][:5], 1), (430, rows[2][1][:5], 1), (440, [], 1), (450, [], 2)]
    return rows


def frame(spark, rows, kind=VECTORS):
    made = spark.createDataFrame(rows, kind)
    return made.select("*", *(F.lit("x").alias(name) for name in CLASH))


@pytest.mark.parametrize("seed,tile,query_tile", [(1, 16, 7), (2, 1024, 256), (3, 5, 100)])
def test_top_k_equals_comparing_all(spark, seed, tile, query_tile):
    rows = sample(seed)
    made = search.top_inner_products(frame(spark, rows), F.col("vec_id") % 10 == 0, k=5, tile=tile, query_tile=query_tile)
    assert sorted(map(tuple, made.collect())) == plain_top(rows, lambda i: i % 10 == 0, 5)


def test_top_k_with_fewer_rows_string_ids_and_none(spark):
    rows = [(f"v{i}", v, label) for i, v, label in sample(4, 20) if i is not None and i < 20]
    made = search.top_inner_products(frame(spark, rows, VECTORS.replace("LONG", "STRING")), F.col("vec_id").isin("v0", "v7"), k=50)
    assert sorted(map(tuple, made.collect())) == plain_top(rows, lambda i: i in ("v0", "v7"), 50)
    nothing = search.top_inner_products(frame(spark, []), F.col("vec_id") % 10 == 0)
    assert nothing.columns == ["query_id", "rank", "vec_id", "score"] and not nothing.collect()


def test_large_components_stay_exact_or_are_refused(spark):
    rows = [(0, [1e6 + 0.5, 3.0], 1), (1, [1e6 - 0.25, 7.0], 1), (2, [-1e6, 1.0], 1), (3, [4e6, -1.0], 2)]
    made = search.top_inner_products(frame(spark, rows), F.col("vec_id") == 0, k=3)
    assert sorted(map(tuple, made.collect())) == plain_top(rows, lambda i: i == 0, 3)
    with pytest.raises(Exception, match="32 bits"):
        search.top_inner_products(frame(spark, [*rows, (4, [1e9, 0.0], 1)]), F.col("vec_id") == 0).collect()


@settings(max_examples=60, deadline=None)
@given(st.integers(0, 10_000), st.integers(1, 40), st.sampled_from([1, 10, 300, 40_000]))
def test_branch_and_bound_never_loses_a_score(seed, dims, size):
    draw = np.random.default_rng(seed)
    query, columns = draw.integers(-size, size + 1, dims), draw.integers(-size, size + 1, (dims, 60))
    columns[:, ::7] = query[:, None]
    scores = query @ columns
    for least in (None, int(np.sort(scores)[-5]), int(scores.max()), int(scores.max()) + 1):
        norms = search.block_norms(query[:, None].astype(float))
        number = grid.exact_kind(query[:, None], columns)
        at, found = search.search_tile(query.astype(number), norms[:, 0], np.argsort(-norms[:, 0]), columns.astype(number), search.block_norms(columns), least)
        assert set(np.flatnonzero(scores >= (least if least is not None else scores.min()))) <= set(at.tolist())
        assert (scores[at] == found).all()


def test_branch_and_bound_leaves_most_out():
    draw = np.random.default_rng(5)
    near = draw.normal(size=64)
    columns = np.floor(256 * np.c_[near[:, None] + 0.02 * draw.normal(size=(64, 6)), draw.normal(size=(64, 500)) * 0.3])
    read = []

    class Counting(np.ndarray):
        def __matmul__(self, other):
            read.append(other.size)
            return np.asarray(self) @ np.asarray(other)

    query = np.floor(256 * near)
    norms = search.block_norms(query[:, None])
    search.search_tile(query.view(Counting), norms[:, 0], np.argsort(-norms[:, 0]), columns, search.block_norms(columns), int(np.sort(query @ columns)[-5]))
    assert sum(read) < columns.size / 3


@pytest.mark.parametrize("seed,tile,query_tile", [(11, 16, 5), (12, 1024, 256), (13, 7, 3)])
def test_hard_negatives_equal_comparing_all(spark, seed, tile, query_tile):
    rows = sample(seed) + [(460, sample(seed)[0][1], None)]
    made = negatives.hard_negatives(frame(spark, rows), F.col("vec_id") % 10 == 0, tile=tile, query_tile=query_tile)
    want = plain_negatives(rows, lambda i: i % 10 == 0)
    assert len(want) > 200
    assert sorted(map(tuple, made.collect())) == want


def test_hard_negatives_with_text_labels_and_ids_and_none(spark):
    rows = [(f"v{i:03d}", v, f"l{label}") for i, v, label in sample(14, 80) if i is not None and label is not None]
    kind = VECTORS.replace("LONG", "STRING").replace("label INT", "label STRING")
    made = negatives.hard_negatives(frame(spark, rows, kind), F.col("vec_id").isin("v000", "v010"), positives=3, negatives=4, low=10, high=95)
    want = plain_negatives(rows, lambda i: i in ("v000", "v010"), 3, 4, 10, 95)
    assert want and sorted(map(tuple, made.collect())) == want
    nothing = negatives.hard_negatives(frame(spark, []), F.col("vec_id") % 10 == 0)
    assert nothing.columns == ["anchor_id", "positive_id", "rank", "negative_id", "positive_score", "negative_score"] and not nothing.collect()
    assert not negatives.hard_negatives(frame(spark, [(0, [1.0], 1)]), F.lit(True)).collect()


@settings(max_examples=60, deadline=None)
@given(st.integers(0, 10_000), st.integers(1, 24), st.sampled_from([1, 10, 300, 40_000]))
def test_angle_bounds_hold(seed, dims, size):
    draw = np.random.default_rng(seed)
    anchor, columns = draw.integers(-size, size + 1, (dims, 1)), draw.integers(-size, size + 1, (dims, 50))
    columns[:, ::5] = anchor
    columns[:, 1::9] = 0
    references = draw.normal(size=(4, dims))
    references[0] = np.where(anchor[:, 0].any(), anchor[:, 0], 1)
    references /= np.linalg.norm(references, axis=1, keepdims=True)
    scores = anchor[:, 0] @ columns
    for known in (references, None):
        norm, angle = negatives.angles_of(anchor, known)
        norms, angles = negatives.angles_of(columns, known)
        low, high = negatives.score_bounds(norm[0], angle[:, 0], norms, angles)
        assert (low <= scores).all() and (scores <= high).all()
    if anchor.any():
        low, high = negatives.score_bounds(norm[0], *(negatives.angles_of(anchor, references)[1][:, 0],), norms, negatives.angles_of(columns, references)[1])
        # A reference in the anchor's own direction leaves hardly anything open.
        assert (high - low <= 2 + 1e-6 * norm[0] * norms + 4).all()


@pytest.mark.parametrize("positive,want", [(10, (3, 9)), (11, (4, 9)), (-10, (-3, -9)), (0, (0, 0))])
def test_windows_are_whole_numbers(positive, want):
    begin, end = negatives.window_of(np.array([positive]), 30, 90, 100)
    assert (int(begin[0]), int(end[0])) == want


def plain_lexical(docs, items, k):
    pattern = re.compile("[^\x00-\x2f\x3a-\x40\x5b-\x60\x7b-\x7f]+")
    lower = lambda text: re.sub("[A-Z]", lambda m: chr(ord(m[0]) + 32), text or "")
    counts = [(i, Counter(pattern.findall(lower(text)))) for i, text in docs]
    counts = [(i, c) for i, c in counts if c]
    whole, total = len(counts), sum(sum(c.values()) for _, c in counts)
    df = Counter(term for _, c in counts for term in c)
    out = []
    for item in {i for i, _ in items}:
        texts = [text for i, text in items if i == item and text is not None]
        scored = []
        for i, c in counts:
            if i is None:
                continue
            m = 100 - 75 + ((75 * sum(c.values()) * whole) // total)
            score = sum(math.floor(1000 * math.log((2 * whole + 2) / (2 * df[t] + 1))) * ((1000000000 * c[t]) // (1000 * c[t] + 8 * m))
                        for t in pattern.findall(lower(min(texts, default=""))) if c[t])
            if score > 0:
                scored.append((-score, i))
        out += [(item, rank, i, -score) for rank, (score, i) in enumerate(sorted(scored)[:k], 1)]
    return sorted(out, key=repr)


def corpus(seed, n=150):
    draw = np.random.default_rng(seed)
    words = [f"w{k}" for k in range(60)] + ["Über", "ünd", "漢字", "A1b2", "naïve"]
    odds = np.array([1 / (k + 1) for k in range(len(words))])
    text = lambda size: " ".join(draw.choice(words, size, p=odds / odds.sum())).replace("w3 ", "W3-")
    texts = [text(int(draw.choice([1, 5, 20, 60]))) for _ in range(n)]
    texts += [None, "", " ...!? \n", texts[0], texts[0], "w1 " * 30_000, "everywhere " + texts[5]]
    docs = [*enumerate(texts), (3, texts[3]), (None, "w1 w2 w50")]
    items = [(k, text(int(draw.choice([1, 3, 12, 40])))) for k in range(25)]
    items += [(100, None), (101, ""), (102, "nowhere to be found"), (103, "w1 w1 w1 W1"), (0, items[0][1]), (104, "zz"), (104, "w9 aa"), (None, "w5 w6")]
    return docs, items


@pytest.mark.parametrize("seed,rows,part_chars", [(1, 8192, 1 << 24), (2, 20, 300), (3, 64, 1 << 24)])
def test_lexical_search_equals_scoring_all(spark, monkeypatch, seed, rows, part_chars):
    monkeypatch.setattr(lexical, "SLICE_ROWS", rows)
    docs, items = corpus(seed)
    clash = [F.lit("x").alias(name) for name in CLASH]
    left = spark.createDataFrame(docs, "doc_id LONG, text STRING").select("*", *clash)
    right = spark.createDataFrame(items, "item_id LONG, text STRING").select("*", *clash)
    found = lexical.lexical_search(left, right, k=10, part_chars=part_chars).collect()
    assert sorted(map(tuple, found), key=repr) == plain_lexical(docs, items, 10)


def test_lexical_search_string_ids_and_empty_tables(spark):
    docs, items = [("b", "one two"), ("a", "one two"), ("c", "two three")], [("q", "one two two")]
    left, right = spark.createDataFrame(docs, "doc_id STRING, text STRING"), spark.createDataFrame(items, "item_id STRING, text STRING")
    found = [tuple(r) for r in lexical.lexical_search(left, right).collect()]
    assert sorted(found) == plain_lexical(docs, items, 10)
    assert lexical.lexical_search(left.limit(0), right).collect() == [] == lexical.lexical_search(left, right.limit(0)).collect()


@settings(max_examples=80, deadline=None)
@given(st.integers(0, 10_000), st.integers(1, 6), st.integers(1, 80), st.sampled_from([1, 2, 16]))
def test_best_positions_find_the_first_k_and_all_ties(seed, lists, documents, depth):
    draw = np.random.default_rng(seed)
    made, sums = [], np.zeros(documents, np.int64)
    for _ in range(lists):
        docs = np.flatnonzero(draw.random(documents) < draw.choice([0.1, 0.5, 1]))
        if not len(docs):
            continue
        impact, factor = draw.integers(1, draw.choice([2, 5, 100]) + 1, len(docs)), int(draw.integers(1, 4))
        made.append((factor, lexical.ImpactList(docs, impact)))
        np.add.at(sums, docs, factor * impact)
    if not made:
        return
    k = 3
    for least in (None, int(np.sort(sums)[-1])):
        docs, scores = lexical.best_position_search(made, documents, least, k, depth)
        assert (sums[docs] == scores).all() and len(set(docs.tolist())) == len(docs)
        kth = np.sort(sums)[::-1][: k][-1] if least is None else least
        assert set(np.flatnonzero((sums >= kth) & (sums > 0))) <= set(docs.tolist())


def test_best_positions_stop_early():
    draw = np.random.default_rng(2)
    made = []
    for _ in range(4):
        docs = np.arange(5000)
        impact = draw.integers(1, 1000, 5000)
        impact[:10] = 100_000
        made.append((1, lexical.ImpactList(docs, impact)))
    docs, _ = lexical.best_position_search(made, 5000, None, 10)
    assert len(docs) < 500
