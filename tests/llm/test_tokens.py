"""Tokens against the library: ids, counts, decoding, spans, character maps."""

import random

import numpy as np
import pytest

from floodplain.llm import pieces, token_counts
from floodplain.llm.merges import MergeTable, merge_queued, merge_ranked
from floodplain.llm.queries import model_path

sentencepiece = pytest.importorskip("sentencepiece")

PARTS = [" ", "  ", "\n", "a", "b", "the", "ing", "é", "ß", "漢", "字", "😀", "▁", ".", ",", "0", "\t", "​", "x" * 7, "    " * 9, "\x00", "ﬁ", "www.", "http://", "aaaa"]


def texts(n, seed):
    draw = random.Random(seed)
    fixed = ["", " ", "  ", "▁", "\n", " \n a", "a" * 500, " " * 300, "\x00", "é" * 200, "the " * 50, "ab" * 3000]
    return fixed + ["".join(draw.choice(PARTS) for _ in range(draw.randint(1, 60))) for _ in range(n)]


@pytest.fixture(scope="module")
def library():
    return sentencepiece.SentencePieceProcessor(model_file=model_path())


@pytest.fixture(scope="module")
def model():
    return pieces.Model(pieces.read_model(model_path()))


def test_ids_counts_and_decoding_equal_the_library(library, model):
    sample = texts(1500, 1)
    made = model.encode(sample)
    ends = np.cumsum(made["sizes"])
    mine = [made["ids"][end - size : end].tolist() for end, size in zip(ends, made["sizes"], strict=True)]
    theirs = library.encode(sample)
    assert mine == theirs
    assert token_counts.Counter(model).count(sample).tolist() == [len(ids) for ids in theirs]
    assert model.decode(made["ids"], made["sizes"]) == library.decode(theirs)


def test_any_ids_decode_as_in_the_library(library, model):
    draw = random.Random(2)
    runs = [[draw.choice([draw.randint(3, 258), draw.randint(0, 31999), draw.randint(0, 2)]) for _ in range(draw.randint(0, 12))] for _ in range(1500)]
    flat = np.array([i for run in runs for i in run], np.int64)
    assert model.decode(flat, np.array([len(run) for run in runs])) == [library.decode(run) for run in runs]


def test_spans_cover_the_source_in_order(model):
    for text in texts(200, 3):
        made = model.encode([text])
        raw = text.encode()
        assert "".join(raw[b:e].decode("latin-1") for b, e in zip(made["begin"], made["end"], strict=True)) == raw.decode("latin-1")
        assert (made["begin"][1:] == made["end"][:-1]).all()


@pytest.mark.parametrize("rule", ["nmt_nfkc", "nfkc", "nmt_nfkc_cf"])
def test_character_maps_replace_the_longest_key(rule):
    from sentencepiece import sentencepiece_model_pb2

    theirs = sentencepiece.SentencePieceNormalizer(rule_name=rule, add_dummy_prefix=False, escape_whitespaces=False, remove_extra_whitespaces=False)
    proto = sentencepiece_model_pb2.ModelProto()
    proto.ParseFromString(theirs.serialized_model_proto())
    charmap = pieces.CharMap(proto.normalizer_spec.precompiled_charsmap)
    draw = random.Random(4)
    for _ in range(300):
        text = "".join(draw.choice(["ﬁ", "Ａ", "①", "é", "x", "　", "ｶﾞ", "\t", "™", "é", "が", "½", "ß", "가"]) for _ in range(8))
        out, at = "", 0
        for new, begin, end in charmap.replace(text):
            out, at = out + text[at:begin] + new, end
        assert out + text[at:] == theirs.normalize(text)


def test_a_piece_projects_onto_what_it_replaced():
    """With a character map, the bytes of 'ﬁ' belong to both letters that it becomes."""
    model = pieces.Model(pieces.read_model(model_path()))
    model.charmap.rules, model.charmap.longest = {"ﬁ": "fi"}, 1
    import re

    model.charmap._begin = re.compile("ﬁ")
    normal, begin, end = model.normalise("aﬁb")
    assert (normal, begin.tolist(), end.tolist()) == ("▁afib", [0, 0, 1, 1, 4], [0, 1, 4, 4, 5])


def plain_merge(table, symbols):
    sym = list(symbols)
    while True:
        made = [int(table.join(np.array([a], np.int32), np.array([b], np.int32))[0]) for a, b in zip(sym, sym[1:], strict=False)]
        best = min(((int(table.rank[m]), i) for i, m in enumerate(made) if m >= 0), default=None)
        if best is None:
            return sym
        i = best[1]
        sym[i : i + 2] = [made[i]]


def test_arrays_and_queue_merge_one_pair_at_a_time():
    """Random vocabularies, in which parts may rank later than the whole and ranks repeat."""
    draw = random.Random(5)
    for _ in range(40):
        words = sorted({"".join(draw.choice("ab") for _ in range(draw.randint(2, 5))) for _ in range(12)})
        vocabulary = {piece: i for i, piece in enumerate(["a", "b", *words])}
        rank = np.array([draw.randint(0, 8) for _ in vocabulary], np.int32)
        table = MergeTable(vocabulary, rank)
        runs = [[draw.randint(0, 1) for _ in range(draw.randint(1, 14))] for _ in range(30)]
        flat = np.array([s for run in runs for s in run], np.int32)
        sym, _, sizes = merge_ranked(table, flat, np.array([len(run) for run in runs]))
        ends = np.cumsum(sizes)
        want = [plain_merge(table, run) for run in runs]
        assert [sym[end - n : end].tolist() for end, n in zip(ends, sizes, strict=True)] == want
        assert [merge_queued(table, run)[0] for run in runs] == want


def test_odd_rows(spark, odd_documents, library):
    made = {(r.doc_id, len(r.decoded)): r for r in pieces.encode_decode(odd_documents, model_path()).collect()}
    counted = token_counts.token_counts(odd_documents, model_path(), limit=4096).collect()
    assert len(counted) == odd_documents.count() == 8
    by_id = {r.doc_id: r for r in counted}
    assert (by_id[0].n_bytes, by_id[0].n_tokens, by_id[0].over_limit) == (0, 0, False)
    assert by_id[6].over_limit and by_id[6].n_tokens == len(library.encode("word " * 40_000))
    assert made[(0, 0)].ids == [] and made[(None, 5)].ids == library.encode("no id")


def test_empty_table(no_documents):
    assert pieces.encode_decode(no_documents, model_path()).count() == 0
    assert token_counts.token_counts(no_documents, model_path()).count() == 0
