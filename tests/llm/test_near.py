"""Vectors, fingerprints, paragraphs and components against comparing everything with everything."""

import random

import numpy as np
import pytest
import xxhash
from pyspark.sql import functions as F

from floodplain.llm import passages, queries, shared, simhash, vectors


def groups(nodes, links):
    low = {node: node for node in nodes}

    def find(x):
        while low[x] != x:
            x = low[x]
        return x

    for a, b in links:
        a, b = find(a), find(b)
        low[max(a, b)] = min(a, b)
    return {node: find(node) for node in nodes}


@pytest.mark.parametrize("links", [
    [], [(1, 1)], [(1, 2), (2, 1), (1, 2)], [(i, i + 1) for i in range(40)], [(0, i) for i in range(1, 60)],
    [(5, 9), (9, 2), (7, 8), (8, 100), (100, 3), (3, 2), (50, 51)],
])
def test_components(spark, links):
    found = shared.components(spark.createDataFrame(links, "a LONG, b LONG"))
    nodes = {x for link in links if link[0] != link[1] for x in link}
    assert {r.node: r.component for r in found.collect()} == groups(nodes, [link for link in links if link[0] != link[1]])


def test_random_components(spark):
    draw = random.Random(1)
    links = [(draw.randint(0, 300), draw.randint(0, 300)) for _ in range(200)]
    found = {r.node: r.component for r in shared.components(spark.createDataFrame(links, "a LONG, b LONG")).collect()}
    nodes = {x for link in links if link[0] != link[1] for x in link}
    assert found == groups(nodes, links)


def plain_vectors(rows, threshold):
    def unit(v):
        if v is None or not v or any(x is None or not np.isfinite(x) for x in v) or not any(v):
            return None
        wide = np.array(v, float)
        return wide / np.linalg.norm(wide)

    known = [(i, unit(v), label) for i, v, label in rows]
    links = [(i, j) for k, (i, u, a) in enumerate(known) for j, w, b in known[k + 1 :]
             if a is not None and a == b and u is not None and w is not None and len(u) == len(w) and u @ w >= threshold]
    return links, groups([i for i, _, _ in known], links)


def test_vectors_equal_comparing_all(spark):
    draw = np.random.default_rng(7)
    rows, i = [], 0
    for label in (1, 2, 3):
        for _ in range(30):
            base = draw.normal(size=16)
            for _ in range(draw.integers(1, 5)):
                rows.append((i, [float(np.float32(x)) for x in base + draw.normal(size=16) * draw.choice([0, 0.02, 0.05, 0.1])], label))
                i += 1
    rows += [(i, rows[0][1], 1), (i + 1, [x * 2 for x in rows[0][1]], 1), (i + 2, rows[0][1], None), (i + 3, None, 1), (i + 4, [0.0] * 16, 1),
             (i + 5, [float("nan")] * 16, 1), (i + 6, [float("inf")] * 16, 1), (i + 7, [None] * 16, 1), (i + 8, rows[0][1][:8], 1), (i + 9, [], 1), (i + 10, [1e-30] * 16, 1), (i + 11, [2e-30] * 16, 1)]
    frame = spark.createDataFrame(rows, "vec_id LONG, embedding ARRAY<FLOAT>, label INT").withColumn("component", F.lit("x"))
    links, want = plain_vectors(rows, 0.98)
    assert len(links) > 50
    found = vectors.near_vectors(frame, 0.98, tile=16).collect()
    assert {r.vec_id: (r.n_links, r.component_id, r.kept) for r in found} == {
        k: (sum(k in link for link in links), low, low == k) for k, low in want.items()}


def test_quantisation_bound_holds():
    draw = np.random.default_rng(8)
    a, b = draw.normal(size=(200, 48)), draw.normal(size=(200, 48)) ** 3
    ua, qa, sa, ea = vectors.quantise(a)
    ub, qb, sb, eb = vectors.quantise(b)
    rough = (qa.astype(float) @ qb.astype(float).T) * sa[:, None] * sb[None, :]
    assert (np.abs(ua @ ub.T - rough) <= ea[:, None] + (1 + ea[:, None]) * eb[None, :]).all()


def test_vectors_odd_rows(spark):
    schema = "vec_id LONG, embedding ARRAY<FLOAT>, label INT"
    assert vectors.near_vectors(spark.createDataFrame([], schema)).count() == 0
    rows = [(None, [1.0, 0.0], 1), (4, [1.0, 0.0], 1), (4, [1.0, 0.0], 1), (9, [1.0, 0.1], 1)]
    found = vectors.near_vectors(spark.createDataFrame(rows, schema)).collect()
    assert sorted((str(r.vec_id), r.n_links, str(r.component_id), r.kept) for r in found) == [("4", 2, "4", True)] * 2 + [("9", 2, "4", False), ("None", 0, "None", True)]


def test_only_undecided_pairs_are_computed_again(monkeypatch):
    draw = np.random.default_rng(21)
    rows = draw.normal(size=(300, 32))
    rows[250:] = rows[:50] + draw.normal(size=(50, 32)) * 0.01
    tile = vectors.Quantised(rows, *vectors.quantise(rows)[1:])
    unit, again = vectors.unit_rows(rows), []
    einsum = np.einsum
    monkeypatch.setattr(vectors.np, "einsum", lambda how, a, b: again.append(len(a)) or einsum(how, a, b))
    found = vectors.linked_pairs(tile, tile, 0.98, same=True)
    want = np.argwhere((unit @ unit.T >= 0.98) & ~np.eye(300, dtype=bool))
    assert sorted(found.tolist()) == sorted((i * 300 + j) for i, j in want.tolist()) and len(want) == 100
    assert 50 <= sum(again) <= 80


@pytest.mark.parametrize("kind,make", [("INT", lambda i: i), ("STRING", lambda i: f"v{i:04d}")])
def test_vectors_with_other_ids(spark, kind, make):
    draw = np.random.default_rng(22)
    rows = []
    for i in range(120):
        base = rows[draw.integers(len(rows))][1] if rows and draw.random() < 0.5 else draw.normal(size=8).tolist()
        rows.append((make(119 - i), [float(np.float32(x)) for x in np.array(base) + draw.normal(size=8) * draw.choice([0, 0.03])], int(draw.integers(2))))
    links, want = plain_vectors(rows, 0.98)
    found = vectors.near_vectors(spark.createDataFrame(rows, f"vec_id {kind}, embedding ARRAY<FLOAT>, label INT"), 0.98, tile=8).collect()
    assert len(links) > 30 and {r.vec_id: (r.n_links, r.component_id, r.kept) for r in found} == {
        k: (sum(k in link for link in links), low, low == k) for k, low in want.items()}


def plain_print(text, words, seed=42):
    found = (text or "").encode().lower().split()
    if not found:
        return 0
    runs = [b" ".join(found[i : i + words]) for i in range(max(1, len(found) - words + 1))]
    hashes = [xxhash.xxh64_intdigest(run, seed=seed) for run in runs]
    return sum(1 << k for k in range(64) if 2 * sum(h >> k & 1 for h in hashes) > len(hashes))


def near_texts(n, seed):
    draw = random.Random(seed)
    words = [f"w{k}" for k in range(400)]
    out = []
    for _ in range(n):
        base = [draw.choice(words) for _ in range(draw.choice([1, 2, 3, 30, 120]))]
        for _ in range(draw.randint(1, 4)):
            changed = list(base)
            for _ in range(draw.randint(0, 2)):
                changed[draw.randrange(len(changed))] = draw.choice(words)
            out.append(" ".join(changed))
    return out


def test_fingerprints_and_links(spark, documents, odd_documents):
    texts = near_texts(60, 9)
    want = [plain_print(text, 3) for text in texts]
    links = [(i, j) for i in range(len(texts)) for j in range(i) if (want[i] ^ want[j]).bit_count() <= 3]
    low = groups(range(len(texts)), links)
    found = simhash.simhash_groups(documents(texts), 3, 1, 3).collect()
    assert {r.doc_id: (r.f0 % 2**64, r.component_id) for r in found} == {i: (want[i], low[i]) for i in range(len(texts))}
    assert len(set(low.values())) < len(texts)
    odd = simhash.simhash_groups(odd_documents).collect()
    assert sorted((str(r.doc_id), r.component_id) for r in odd if r.f0 == 0) == [("0", 0), ("1", 0), ("2", 0)] and len(odd) == 8
    assert [r.component_id for r in odd if r.doc_id is None] == [None] and [r.component_id for r in odd if r.doc_id == 3] == [3, 3]


@pytest.mark.parametrize("radius", [2, 8])
def test_links_over_wider_radius_and_two_parts(spark, documents, radius):
    texts = near_texts(40, 10)
    prints = [(plain_print(text, 3), plain_print(text, 3, 43)) for text in texts]
    links = [(i, j) for i in range(len(texts)) for j in range(i) if sum((a ^ b).bit_count() for a, b in zip(prints[i], prints[j], strict=True)) <= radius]
    found = simhash.near_groups(simhash.fingerprints(documents(texts), 3, 2), radius, tile=16).collect()
    assert {r.doc_id: r.component_id for r in found} == groups(range(len(texts)), links)


def test_contract_columns(spark, tmp_path, documents):
    documents(["a b c", "", None]).write.parquet(f"{tmp_path}/documents.parquet")
    rows = {r.doc_id: r for r in queries.op8_simhash(spark, str(tmp_path)).collect()}
    assert rows[1].fingerprint == "0" * 16 and rows[2].component_id == 1
    assert rows[0].fingerprint == f"{xxhash.xxh64_intdigest(b'a b c', seed=42):016x}"


def test_one_of_each_group_stays(spark, documents, odd_documents, no_documents):
    draw = random.Random(11)
    base = [" ".join(f"w{draw.randint(0, 5000)}" for _ in range(200)) for _ in range(6)]
    near = [text.replace(text.split()[k], "changed", 1) for k, text in enumerate(base)]
    texts = [*base, *near, "short text here", "short text there", base[0], base[0]]
    kept = simhash.drop_near_copies(documents(texts))
    assert sorted(r.doc_id for r in kept.collect()) == [0, 1, 2, 3, 4, 5, 12, 13]
    odd = simhash.drop_near_copies(odd_documents)
    assert odd.columns == odd_documents.columns
    assert sorted(str(r.doc_id) for r in odd.collect()) == ["0", "3", "5", "6", "None"]
    nameless = simhash.drop_near_copies(documents(["same words in here"] * 3 + ["other words over there"], [None, None, 4, None]))
    assert sorted(str(r.doc_id) for r in nameless.collect()) == ["4", "None"]
    assert simhash.drop_near_copies(no_documents).count() == 0 and simhash.simhash_groups(no_documents).count() == 0


# -- passages ------------------------------------------------------------------


def prose(draw, sentences):
    return " ".join(" ".join(f"x{draw.randint(0, 3000)}" for _ in range(draw.randint(5, 12))) + "." for _ in range(sentences))


def plain_lines(texts):
    """(text, first word, words) of the long lines."""
    out = []
    for t, text in enumerate(texts):
        at = 0
        for line in (text or "").lower().split("\n"):
            words = line.split()
            if len(words) >= passages.MIN_LINE:
                out.append((t, at, tuple(words)))
            at += len(words)
    return out


def plain_clusters(texts):
    """Long lines by their place, with the component of exact Jaccard links, where it spans documents."""
    rows = plain_lines(texts)
    distinct = sorted({words for _, _, words in rows})

    def shingles(words):
        return {words[i : i + 5] for i in range(max(1, len(words) - 4))}

    sets = [shingles(words) for words in distinct]
    links = [(i, j) for i in range(len(sets)) for j in range(i) if len(sets[i] & sets[j]) >= 0.8 * len(sets[i] | sets[j])]
    low = groups(range(len(distinct)), links)
    number = {words: low[i] for i, words in enumerate(distinct)}
    holders = {}
    for t, _, words in rows:
        holders.setdefault(number[words], set()).add(t)
    return {(t, first, len(words)): number[words] for t, first, words in rows if len(holders[number[words]]) > 1}


def same_groups(mine, want):
    pairs = {(mine[key], want[key]) for key in want}
    return len(pairs) == len({a for a, _ in pairs}) == len({b for _, b in pairs})


def check_passages(texts, found):
    """Lines as comparing all gives them; passages repeat word by word and touch all that 51 words repeat."""
    words = [text.lower().split() for text in texts]
    want = plain_clusters(texts)
    mine = {(r.doc_id, r.first_word, r.n_words): r.cluster_id for r in found}
    assert want.keys() <= mine.keys() and same_groups(mine, want)
    places = {}
    for t, own in enumerate(words):
        for k in range(len(own) - passages.RUN + 1):
            places.setdefault(tuple(own[k : k + passages.RUN]), set()).add(t)
    covered = [np.zeros(len(own) + 1, int) for own in words]
    clusters = {}
    for r in found:
        if (r.doc_id, r.first_word, r.n_words) in want:
            continue
        assert r.n_words >= passages.RUN
        piece = words[r.doc_id][r.first_word : r.first_word + r.n_words]
        for k in range(len(piece) - passages.RUN + 1):
            assert len(places[tuple(piece[k : k + passages.RUN])]) > 1
        clusters.setdefault(r.cluster_id, []).append((r.doc_id, piece))
        covered[r.doc_id][r.first_word : r.first_word + r.n_words] = 1
    for rows in clusters.values():
        assert len({t for t, _ in rows}) > 1 and all(piece == rows[0][1] for _, piece in rows)
    firsts = set()
    for r in sorted(found, key=lambda r: (r.doc_id, r.first_word)):
        assert r.kept == (r.cluster_id not in firsts)
        firsts.add(r.cluster_id)
    windows = {}
    for t, own in enumerate(words):
        for k in range(len(own) - 50):
            windows.setdefault(tuple(own[k : k + 51]), []).append((t, k))
    for held in windows.values():
        if len({t for t, _ in held}) > 1:
            assert all(covered[t][k : k + 51].sum() >= passages.RUN for t, k in held)
    return clusters


def test_passages_equal_comparing_all(spark, documents):
    draw = random.Random(12)
    shared_text = [prose(draw, 14) for _ in range(4)]
    texts = []
    for k in range(40):
        parts = [prose(draw, draw.randint(1, 6))]
        if k % 2:
            parts.insert(draw.randint(0, 1), shared_text[k % 4])
        if k % 3 == 0:
            parts.append("\n" + "common line of eight words that all have")
        texts.append(" ".join(parts))
    long = [f"y{i}" for i in range(80)]
    texts += [" ".join(long), " ".join([*long[:40], "changed", *long[41:]])]
    # What one document alone repeats is none of another's.
    alone = " ".join(f"z{i}" for i in range(90))
    texts.append(f"{alone}\n{alone} {alone}")
    found = passages.repeated_passages(documents(texts)).collect()
    check_passages(texts, found)
    assert {(r.doc_id, r.first_word, r.n_words) for r in found} >= {(40, 0, 80), (41, 0, 80)}
    # The short line that every third text has does not count.
    assert {r.doc_id for r in found} == {k for k in range(40) if k % 2} | {40, 41}


def test_passages_of_texts_in_pieces(spark, documents):
    """Passages in other orders, wrapped otherwise, between long lines, in groups of many sizes, cut at either end."""
    draw = random.Random(17)
    pool = [[f"p{k}w{i}" for i in range(draw.choice((51, 60, 130, 400)))] for k in range(12)]
    texts = []
    for _ in range(60):
        words = []
        for piece in draw.sample(pool, draw.randint(0, 3)):
            cut = draw.choice((0, 0, 5, 30))
            words += [f"own{draw.randint(0, 9999)}" for _ in range(draw.choice((0, 3, 70)))] + piece[cut : draw.choice((len(piece), len(piece) - 7))]
        width = draw.choice((7, 13, 40, 60, 10_000))
        texts.append("\n".join(" ".join(words[k : k + width]) for k in range(0, len(words), width)))
    found = passages.repeated_passages(documents(texts)).collect()
    clusters = check_passages(texts, found)
    # Neighbouring runs that always stand together are one row.
    assert max(len(rows[0][1]) for rows in clusters.values()) > 200


def test_one_hot_passage_makes_one_row_a_document(spark, documents):
    passage = " ".join(f"h{i}" for i in range(300))
    texts = [f"a{k} b{k} {passage} c{k}" for k in range(700)]
    found = passages.repeated_passages(documents(texts)).collect()
    lines, runs = ([r for r in found if (r.first_word == 0) == whole] for whole in (True, False))
    assert len(lines) == len(runs) == 700 and {r.cluster_size for r in found} == {700} and sum(r.kept for r in found) == 2


def test_a_line_end_between_long_lines(spark, documents):
    draw = random.Random(18)
    passage = [f"x{i}" for i in range(60)]
    inside = " ".join([prose(draw, 8).replace("\n", " "), *passage, prose(draw, 8).replace("\n", " ")])
    around = [f"u{i}" for i in range(60)], [f"v{i}" for i in range(60)]
    broken = " ".join([*around[0], *passage[:30]]) + "\n" + " ".join([*passage[30:], *around[1]])
    assert repeats(spark, documents, [inside, broken, prose(draw, 20)]) == {0, 1}


@pytest.mark.parametrize("sizes", [[0, 31, 32, 33, 50, 51, 52, 200], [5000], [0], [40, 0, 0, 700, 31, 51]])
def test_runs_taken_are_the_lowest_of_every_window(sizes):
    draw = np.random.default_rng(19)
    hashes = draw.integers(0, 1 << 62, sum(sizes)).astype(np.uint64)
    hashes[100:160] = hashes[100:101] if len(hashes) > 160 else 0
    begin = np.cumsum(sizes) - sizes
    places, ids = passages.anchors(hashes, begin)
    want, value = set(), passages.run_hashes(hashes) if len(hashes) >= passages.RUN else []
    for at, size in zip(begin.tolist(), sizes, strict=True):
        runs = list(range(at, at + size - passages.RUN + 1))
        width = min(len(runs), passages.WINDOW)
        for k in range(len(runs) - width + 1) if runs else []:
            window = runs[k : k + width]
            low = min(value[x] for x in window)
            want |= {x for x in window if value[x] == low}
    assert places.tolist() == sorted(want) and ids.tolist() == [value[x] for x in sorted(want)]


def test_passages_odd_rows(spark, odd_documents, no_documents, documents):
    text = prose(random.Random(13), 10)
    found = passages.repeated_passages(odd_documents).collect()
    assert {r.doc_id for r in found} <= {6}
    assert passages.repeated_passages(no_documents).count() == 0
    twice = passages.repeated_passages(documents([text, text, text], [5, 5, None])).collect()
    assert {r.cluster_size for r in twice} == {3} and sum(r.kept for r in twice) == len({r.cluster_id for r in twice})


def test_near_copies_have_the_exact_similarity(spark, documents):
    def jaccard(a, b):
        a, b = ({tuple(x[i : i + 5]) for i in range(len(x) - 4)} for x in (a.split(), b.split()))
        return len(a & b) / len(a | b)

    draw = random.Random(14)
    texts = []
    for changes in (1, 3, 4, 5, 6, 7, 8, 9):
        for _ in range(4):
            base = [f"w{draw.randint(0, 5000)}" for _ in range(250)]
            other = list(base)
            for k in draw.sample(range(10, 240), changes):
                other[k] = "changed"
            texts += [" ".join(base), " ".join(other)]
    # Many repeats of one word do not make texts alike.
    texts += [" ".join(["same"] * 600 + [f"{side}{k}" for k in range(200)]) for side in "ab"]
    # A text and the same text twice have nearly the same shingles.
    texts += [texts[0].replace("w", "v"), " ".join([texts[0].replace("w", "v")] * 2)]
    kept = {r.doc_id for r in simhash.drop_near_copies(documents(texts), radius=48).collect()}
    want = {i for i in range(len(texts)) if i % 2 == 0 or jaccard(texts[i - 1], texts[i]) < 0.8}
    assert kept == want and 20 < sum(i % 2 == 0 for i in kept) < len(kept) < len(texts)
    # As called by default, nothing below the similarity goes.
    assert want <= {r.doc_id for r in simhash.drop_near_copies(documents(texts)).collect()}


def test_near_copies_at_the_threshold_are_found(spark, documents):
    """300 pairs of exactly 0.8: 200 shingles, of each side's 180 the other has 160."""
    draw = random.Random(18)
    texts = []
    for _ in range(300):
        base = [f"w{draw.randint(0, 10**6)}" for _ in range(184)]
        other = list(base)
        for k in draw.sample(range(20, 160, 8), 4):
            other[k] = f"v{draw.randint(0, 10**6)}"
        texts += [" ".join(base), " ".join(other)]
    gone = {r.doc_id for r in documents(texts).join(simhash.drop_near_copies(documents(texts)), "doc_id", "left_anti").collect()}
    assert len(gone) >= 297 and all(i % 2 for i in gone)


def test_near_copies_take_repeats_and_short_texts(spark, documents):
    """One row repeated very often stays once; eight and nine words that share four of five shingles link."""
    texts = ["one two three four five six seven eight"] * 500 + ["one two three four five six seven eight nine", "quite another text of words here"]
    kept = simhash.drop_near_copies(documents(texts, [0] * 500 + [1, 2]))
    assert sorted(r.doc_id for r in kept.collect()) == [0, 2]


def repeats(spark, documents, texts):
    return {r.doc_id for r in passages.repeated_passages(documents(texts)).collect()}


def test_every_passage_of_51_words_is_found(spark, documents):
    draw = random.Random(15)
    texts = []
    for _ in range(150):
        passage = " ".join(f"x{draw.randint(0, 3000)}" for _ in range(51))
        texts += [f"{prose(draw, 6)} {passage} {prose(draw, 6)}" for _ in range(2)]
    assert repeats(spark, documents, texts) == set(range(300))


def test_passages_pass_line_ends(spark, documents):
    draw = random.Random(16)
    texts = []
    for width in (5, 8, 12, 16, 25, 50):
        words = [f"x{draw.randint(0, 3000)}" for _ in range(draw.choice((51, 90)))]
        for shift in (0, 3):
            lines = [words[:shift], *(words[k : k + width] for k in range(shift, len(words), width))]
            texts.append(prose(draw, 3) + "\n" + "\n".join(map(" ".join, lines)) + "\n" + prose(draw, 3))
    texts.append(prose(draw, 20))
    assert repeats(spark, documents, texts) == set(range(12))
