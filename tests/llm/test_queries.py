"""The registered queries themselves, columns and digests, against the tokenizer library, the defining patterns and plain loops."""

import hashlib
import re

import numpy as np
import pytest

from floodplain.llm import queries

TEXTS = [
    None, "", " \n\t ", "plain words here", "plain words here", "Straße und ÜBER allem ▁ 漢字 😀   é",
    "mail a.b+c@d-e.org, again x@y.zz; +49 (30) 123-45 67 then 10.1.2.3 and 10.1.2.333 card 4111 1111 1111 1111 done",
    "word " * 30_000, "4111111111111111" * 40, "<s> </s> <unk> <0x41>",
]


@pytest.fixture
def folder(spark, documents, tmp_path):
    documents(TEXTS).write.parquet(f"{tmp_path}/documents.parquet")
    return str(tmp_path)


def digest(values):
    return hashlib.sha256(",".join(map(str, values)).encode()).hexdigest()


@pytest.fixture(scope="module")
def library():
    import sentencepiece

    return sentencepiece.SentencePieceProcessor(model_file=queries.model_path())


def test_op1_digests_are_the_librarys(spark, folder, library):
    rows = {r.doc_id: r for r in queries.op1_sentencepiece(spark, folder).collect()}
    assert set(rows) == set(range(len(TEXTS)))
    for i, text in enumerate(TEXTS):
        ids = library.encode(text or "")
        decoded = hashlib.sha256(library.decode(ids).encode()).hexdigest()
        assert (rows[i].n_tokens, rows[i].ids_sha256, rows[i].decoded_sha256) == (len(ids), digest(ids), decoded), i


def test_op10_counts_are_the_librarys(spark, folder, library):
    rows = {r.doc_id: r for r in queries.op10_token_counts(spark, folder).collect()}
    for i, text in enumerate(TEXTS):
        n = len(library.encode(text or ""))
        assert (rows[i].n_bytes, rows[i].n_tokens, rows[i].over_limit) == (len((text or "").encode()), n, n > 4096), i


def plain_spans(text):
    def luhn(digits):
        doubled = [int(d) * 2 if k % 2 else int(d) for k, d in enumerate(reversed(digits))]
        return sum(d - 9 if d > 9 else d for d in doubled) % 10 == 0

    only = lambda s: re.sub("[^0-9]", "", s)
    kinds = {
        "email": (r"[A-Za-z0-9._%+-]+@[A-Za-z0-9-]+(\.[A-Za-z0-9-]+)+", lambda s: True),
        "ip": (r"[0-9]+(\.[0-9]+)(\.[0-9]+)(\.[0-9]+)", lambda s: all(int(part) <= 255 for part in s.split("."))),
        "card": (r"[0-9]([\x20-]?[0-9])+", lambda s: 16 <= len(only(s)) <= 19 and luhn(only(s))),
        "phone": (r"\+[0-9][\x20().0-9-]+[0-9]", lambda s: 8 <= len(only(s)) <= 15),
    }
    return {kind: [(m.start(), m.end()) for m in re.finditer(pattern, text) if good(m.group())] for kind, (pattern, good) in kinds.items()}


def test_op2_digests_are_the_patterns(spark, folder):
    rows = {r.doc_id: r for r in queries.op2_personal_data(spark, folder).collect()}
    for i, text in enumerate(TEXTS):
        found = plain_spans(text or "")
        listed = [f"{kind}:{start}:{end}" for kind, spans in found.items() for start, end in sorted(spans)]
        assert [rows[i][f"n_{kind}"] for kind in found] == [len(spans) for spans in found.values()], i
        assert rows[i].base_sha256 == digest(listed), i
        assert set(listed) <= set(rows[i].spans.split(",")), i


def test_op3_classes_are_those_of_all_pairs(spark, tmp_path):
    rng = np.random.default_rng(5)
    base = rng.normal(size=(40, 16))
    values = np.concatenate([base, base[:20] * 2, base[:10] + rng.normal(size=(10, 16)) * 0.05]).tolist()
    labels = [i % 3 for i in range(40)] + [i % 3 for i in range(20)] + [i % 3 for i in range(10)]
    values += [None, [0.0] * 16, [float("nan")] * 16, [1.0] * 16, [1.0] * 16]
    labels += [0, 0, 0, None, None]
    rows = [(i, value, label) for i, (value, label) in enumerate(zip(values, labels, strict=True))]
    spark.createDataFrame(rows, "vec_id BIGINT, embedding ARRAY<FLOAT>, label INT").write.parquet(f"{tmp_path}/embeddings.parquet")
    stored = {r.vec_id: (r.embedding, r.label) for r in spark.read.parquet(f"{tmp_path}/embeddings.parquet").collect()}
    unit = {}
    for i, (value, label) in stored.items():
        vector = None if value is None or label is None else np.array(value, float)
        if vector is not None and np.isfinite(vector).all() and np.linalg.norm(vector) > 0:
            unit[i] = vector / np.linalg.norm(vector)
    links = {i: [j for j in unit if j != i and stored[i][1] == stored[j][1] and float(unit[i] @ unit[j]) >= 0.98] for i in unit}
    first = {i: i for i in stored}
    for _ in stored:
        first = {i: min([first[i], *(first[j] for j in links.get(i, []))]) for i in stored}
    assert any(len(found) > 1 for found in links.values())
    found = {r.vec_id: (r.n_links, r.component_id, r.kept) for r in queries.op3_near_vectors(spark, str(tmp_path)).collect()}
    assert found == {i: (len(links.get(i, [])), first[i], first[i] == i) for i in stored}
