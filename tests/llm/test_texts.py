"""Licences, languages, resampling, leaks and the pipeline."""

import math
import os
import random
import zlib

import numpy as np
import pytest

from floodplain.llm import language, licenses, queries, resampling, tiling


def test_licences_equal_sql(spark, tmp_path, documents, sf):
    import duckdb

    texts = [
        None, "", "  ", "Released under the MIT License.", "x under the MIT license under the mit license y", "Apache License,\nVersion 2.0",
        "CC-BY-NC 4.0; cc by nc", "This work is licensed under the GNU General Public License, version 3.", "All rights\nreserved", "ALL RIGHTS RESERVED and more",
        "under the mit", "wor licensed under cc by nc 4 0", "Über under the MİT license", "ünder the mit license", "under\x00the\tmit-license",
        "a gnu license under general version 3 public licensed", "mit " * 3000 + "under the mit license", "Released under the MIT License.", None,
    ]
    frame = documents(texts, [*range(len(texts) - 2), 3, None])
    frame.write.parquet(f"{tmp_path}/documents.parquet")
    con = duckdb.connect()
    con.execute(f"CREATE VIEW documents AS SELECT * FROM read_parquet('{tmp_path}/documents.parquet/*.parquet')")
    relation = con.execute(queries.oracle_sql()["op5_licenses"])
    names = [d[0] for d in relation.description]
    theirs = sorted(relation.fetchall(), key=repr)
    mine = queries.op5_licenses(spark, str(tmp_path))
    assert sorted((tuple(r[n] for n in names) for r in mine.collect()), key=repr) == theirs
    rows = {r.doc_id: r for r in mine.collect()}
    assert (rows[4].n_base, rows[4].first_word, rows[4].last_word) == (2, 1, 5) and rows[5].base_labels == "apache-2"
    assert rows[8].labels == "all-rights-reserved" and rows[9].labels == "all-rights-reserved"


NOTICES = {
    "mit": "Permission is hereby granted, free of charge, to any person obtaining a copy of this software and associated documentation files (the \"Software\"), to deal in the Software without restriction, including without limitation the rights to use, copy, modify, merge",
    "gpl-3": "This program is free software: you can redistribute it and/or modify it under the terms of the GNU General Public License as published by the Free Software Foundation, either version 3 of the License, or (at your option) any later version.",
    "bsd": "Redistribution and use in source and binary forms, with or without modification, are permitted provided that the following conditions are met:",
    "mpl-2": "This Source Code Form is subject to the terms of the Mozilla Public License, v. 2.0. If a copy of the MPL was not distributed with this file, You can obtain one at",
}


@pytest.mark.parametrize("width", [20, 40, 72, 80, 10_000])
def test_notices_are_found_however_they_are_wrapped(spark, tmp_path, documents, width):
    import textwrap

    import duckdb

    def comment(text, lead="some code here;\n"):
        return lead + "\n".join(f" * {line}" for line in textwrap.wrap(text, width)) + "\n more_code();\n" + "other words again\n" * 3

    texts = [comment(text) for text in NOTICES.values()] + [comment(text, "word " * 400 + "\n\n") for text in NOTICES.values()]
    # A line without words ends a block, and words scattered over a text are no notice.
    parts = [text.split() for text in NOTICES.values()]
    texts += ["\n *\n".join(" ".join(words[k : k + 5]) for k in range(0, len(words), 5)) for words in parts]
    texts += ["\n".join(f"{word} is one of many words that stand in this line of text here" for word in words) for words in parts]
    documents(texts).write.parquet(f"{tmp_path}/documents.parquet")
    con = duckdb.connect()
    con.execute(f"CREATE VIEW documents AS SELECT * FROM read_parquet('{tmp_path}/documents.parquet/*.parquet')")
    relation = con.execute(queries.oracle_sql()["op5_licenses"])
    names = [d[0] for d in relation.description]
    found = queries.op5_licenses(spark, str(tmp_path)).collect()
    assert sorted((tuple(r[n] for n in names) for r in found), key=repr) == sorted(relation.fetchall(), key=repr)
    labels = {r.doc_id: r.labels for r in found}
    assert [labels[k] for k in range(8)] == list(NOTICES) * 2 and {labels[k] for k in range(8, 16)} == {""}


def test_licence_blocks_and_thresholds(spark, documents, no_documents, odd_documents):
    templates = (licenses.Template("t", "t", "a b c d e f g h i j"),)
    texts = ["a b c d e f g h", "a b c d e f g", "j i h g f e d c b a z z", "a b c d\ne f g h", "q"]
    found = licenses.find_licenses(documents(texts), 0.8, templates).collect()
    assert sorted((r.doc_id, r.line, r.share) for r in found) == [(0, 0, 0.8), (2, 0, 1.0), (3, 0, 0.8)]
    assert licenses.license_summary(no_documents).count() == 0
    assert licenses.license_summary(odd_documents).count() == 8


def plain_counts(texts, names, langs):
    counts = {name: np.zeros(language.BUCKETS) for name in names}
    for text, lang in zip(texts, langs, strict=True):
        for bucket in language.grams_of([text])[0].tolist():
            counts[lang][bucket] += 1
    return counts


def test_language_model_equals_plain_counting(spark, documents):
    draw = random.Random(1)
    alphabets = {"de": "abcäöü", "en": "abcdef", "fr": "éàçab"}
    texts, langs = [], []
    for _ in range(200):
        lang = draw.choice(list(alphabets))
        texts.append(" ".join("".join(draw.choice(alphabets[lang]) for _ in range(draw.randint(1, 7))) for _ in range(12)))
        langs.append(lang)
    model = language.train(documents(texts, langs=langs))
    train = [i for i in range(200) if zlib.crc32(str(i).encode()) % 5]
    counts = plain_counts([texts[i] for i in train], sorted(alphabets), [langs[i] for i in train])
    assert model.names == ["de", "en", "fr"]
    for k, name in enumerate(model.names):
        want = np.log((counts[name] + language.SMOOTHING) / (counts[name].sum() + language.SMOOTHING * language.BUCKETS))
        assert np.allclose(model.logp[:, k], want)
    found = {r.doc_id: r for r in language.identify(documents(texts, langs=[None] * 200), model).collect()}
    for i in range(0, 200, 9):
        grams = language.grams_of([texts[i]])[0]
        total = [model.prior[k] + sum(model.logp[b, k] for b in grams.tolist()) for k in range(3)]
        best = max(range(3), key=total.__getitem__)
        assert found[i].lang_pred == model.names[best]
        assert math.isclose(found[i].score, 1 / sum(math.exp(t - total[best]) for t in total), rel_tol=1e-6)
    held = [i for i in range(200) if i not in train]
    assert sum(found[i].lang_pred == langs[i] for i in held) >= 0.95 * len(held)


def test_grams_stay_within_their_text():
    alone = [language.grams_of([text])[0] for text in ("ab c", "d", "", "xy")]
    bucket, owner, letter = language.grams_of(["ab c", "d", "", "xy"])
    assert [sorted(bucket[owner == k].tolist()) for k in range(4)] == [sorted(b.tolist()) for b in alone]
    assert letter.tolist() == [True, True, False, True]


def test_language_odd_rows(spark, odd_documents, no_documents, documents):
    model = language.train(documents(["hello there", "guten tag"] * 5, langs=["en", "de"] * 5))
    found = language.identify(odd_documents, model).collect()
    assert sorted(str(r.doc_id) for r in found if r.lang_pred == "und") == ["0", "1", "2"] and len(found) == 8
    kept = language.keep_identified(odd_documents, model, 0.0)
    assert kept.columns == odd_documents.columns and sorted(str(r.doc_id) for r in kept.collect()) == ["3", "3", "5", "6", "None"]
    nothing = language.train(no_documents)
    assert sorted(str(r.doc_id) for r in language.keep_identified(odd_documents, nothing).collect()) == ["3", "3", "5", "6", "None"]
    assert nothing.names == [] and {r.lang_pred for r in language.identify(odd_documents, nothing).collect()} == {"und"}


@pytest.mark.skipif(not os.path.isdir("/root/testdata/sf0.01"), reason="no test tables")
def test_held_out_accuracy(spark):
    docs = spark.read.parquet("/root/testdata/sf0.01/documents.parquet")
    found = queries.op7_language(spark, "/root/testdata/sf0.01").join(docs.select("doc_id", "lang"), "doc_id").where("held_out AND lang IS NOT NULL").collect()
    assert len(found) > 100 and sum(r.lang == r.lang_pred for r in found) / len(found) > 0.98


def test_resampling_equals_plain(spark, documents):
    draw = random.Random(2)
    texts = [" ".join(draw.choice("abcdefgh" if k % 3 else "stuvwxyz") * 3 for _ in range(draw.randint(0, 30))) for k in range(120)]
    docs = documents(texts)
    good = docs.where("doc_id % 3 <> 0")

    def count(chosen):
        out = np.zeros(resampling.BUCKETS)
        for text in chosen:
            for bucket in resampling.grams_of([text])[0].tolist():
                out[bucket] += 1
        return out

    ratio = resampling.log_ratio(count(t for k, t in enumerate(texts) if k % 3), count(texts))
    rows = {r.doc_id: r for r in resampling.resample(docs, good, 0.4).collect()}
    for k, text in enumerate(texts):
        assert math.isclose(rows[k].log_weight, sum(ratio[b] for b in resampling.grams_of([text])[0].tolist()), abs_tol=1e-9)
    border = sorted((r.gumbel_key for r in rows.values()), reverse=True)[47]
    assert all(r.selected == (r.gumbel_key >= border) for r in rows.values()) and sum(r.selected for r in rows.values()) == 48
    again = {r.doc_id: r.gumbel_key for r in resampling.resample(docs, good, 0.4).collect()}
    assert again == {k: r.gumbel_key for k, r in rows.items()}


@pytest.mark.parametrize("k", [0, 1, 2, 5, 6, 7])
def test_kth_largest(spark, k):
    values = [3.0, -1e9, 3.0, 1e9, 0.25, 0.25000000001]
    frame = spark.createDataFrame([(v,) for v in values], "x DOUBLE")
    want = None if k == 0 else sorted(values, reverse=True)[min(k, 6) - 1]
    assert resampling.kth_largest(frame, "x", k, bins=4) == want


def test_resampling_odd_rows(spark, odd_documents, no_documents, documents):
    rows = resampling.resample(odd_documents, no_documents, 1.0).collect()
    assert len(rows) == 8 and all(r.selected for r in rows)
    assert resampling.resample(no_documents, odd_documents).count() == 0
    labels = spark.createDataFrame([(1, 1, 0), (1, 1, 0), (2, 1, 1), (3, 0, 0), (4, 1, None), (None, 1, 0)], "doc_id LONG, quality INT, toxic INT")
    assert sorted(r.doc_id for r in resampling.labelled_target(documents(["t"] * 6), labels).collect()) == [1, 4]


# -- leaks -----------------------------------------------------------------------


def plain_tiles(doc, item, least):
    """Greedy string tiling by trying every pair of places in every round."""
    doc_used, item_used, tiles = set(), set(), []
    while True:
        best = least
        found = []
        for i in range(len(doc)):
            for j in range(len(item)):
                n = 0
                while i + n < len(doc) and j + n < len(item) and doc[i + n] == item[j + n] and i + n not in doc_used and j + n not in item_used:
                    n += 1
                if n > best:
                    best, found = n, [(i, j)]
                elif n == best:
                    found.append((i, j))
        if not found:
            return sorted(tiles)
        for i, j in found:
            if not any(i + k in doc_used or j + k in item_used for k in range(best)):
                tiles.append((i, j, best))
                doc_used.update(range(i, i + best))
                item_used.update(range(j, j + best))


def test_tiling_equals_trying_all_places():
    draw = random.Random(3)
    for _ in range(300):
        words = [f"w{k}" for k in range(draw.choice([2, 3, 8, 40]))]
        item = [draw.choice(words) for _ in range(draw.randint(1, 25))]
        doc = [draw.choice(words) for _ in range(draw.randint(0, 15))]
        for _ in range(draw.randint(0, 4)):
            a = draw.randrange(len(item))
            doc += item[a : a + draw.randint(1, 12)]
        known = tiling.Benchmark.build([(7, " ".join(item))], 3)
        least = min(3, len(item))
        want = plain_tiles(doc, item, least)
        covered = sum(n for _, _, n in want)
        found = known.matches(" ".join(doc), 0.3)
        assert found == ([(0, want)] if covered >= 0.3 * len(item) and want else [])


def test_leaks(spark, documents, odd_documents, no_documents):
    item = " ".join(f"Word{k}" for k in range(30))
    parts = item.split()
    reordered = " ".join(parts[20:] + ["between"] + parts[10:20] + ["and"] + parts[:10])
    bench = spark.createDataFrame([(1, item), (2, "only three words"), (3, ""), (4, None), (5, item)], "item_id LONG, text STRING")
    texts = [f"before {item.upper()}, after", reordered, " ".join(parts[:12]), "has only three, words", "only three"]
    for size in (tiling.PART_CHARS, 40):
        rows = {(r.doc_id, r.item_id): r for r in tiling.find_leaks(documents(texts), bench, part_chars=size).collect()}
        assert set(rows) == {(0, 1), (0, 5), (1, 1), (1, 5), (3, 2)}
        assert rows[1, 1].coverage == 1.0 and rows[1, 1].reordered and not rows[0, 1].reordered and len(rows[1, 1].tiles) == 3
        kept = tiling.drop_leaks(documents(texts), bench, part_chars=size)
        assert sorted(r.doc_id for r in kept.collect()) == [2, 4]
    assert tiling.find_leaks(odd_documents, bench).count() == 0 and tiling.drop_leaks(odd_documents, bench).count() == 8
    assert tiling.find_leaks(documents(texts), bench.limit(0)).count() == 0 and tiling.find_leaks(no_documents, bench).count() == 0


# -- pipeline --------------------------------------------------------------------


@pytest.mark.skipif(not os.path.isdir("/root/testdata/sf0.001"), reason="no test tables")
def test_pipeline_stages_follow_from_their_inputs(spark, sf, tmp_path):
    import corpus_pipeline
    from floodplain.llm import personal, pieces

    docs = spark.read.parquet(f"{sf}/documents.parquet")
    columns = docs.columns
    taken = {}
    for name, stage in corpus_pipeline.STAGES:
        out = stage(spark, docs, sf)
        out.write.parquet(f"{tmp_path}/{name}")
        before, docs = docs, spark.read.parquet(f"{tmp_path}/{name}")
        taken[name] = (before, docs)
        assert name == "tokens" or docs.columns == columns
    rows = {name: ({r.doc_id: r for r in a.collect()}, {r.doc_id: r for r in b.collect()}) for name, (a, b) in taken.items()}
    before, after = rows["language"]
    assert set(before) - set(after) <= {i for i, r in before.items() if not any(c.isalpha() for c in r.text or "")}
    before, after = rows["near_copies"]
    texts = {}
    for i in sorted(before):
        texts.setdefault(before[i].text, i)
    assert set(after) <= set(texts.values()) and len(after) > 0.7 * len(texts)
    before, after = rows["benchmark_leaks"]
    bench = [(r.item_id, r.text) for r in spark.read.parquet(f"{sf}/benchmark.parquet").collect()]
    known = tiling.Benchmark.build(bench, 5)
    assert set(after) == {i for i, r in before.items() if not known.matches(r.text, 0.5)}
    assert not any(text in r.text for r in after.values() for _, text in bench)
    before, after = rows["personal_data"]
    assert {i: r.text for i, r in after.items()} == {i: personal.redact(r.text, personal.spans_of(r.text)) for i, r in before.items()}
    before, after = rows["tokens"]
    model = pieces.Model(pieces.read_model(queries.model_path()))
    assert all(r.ids == model.encode([before[i].text])["ids"].tolist() and r.round_trip for i, r in after.items())
    whole = {r.doc_id: r.ids for r in corpus_pipeline.run(spark, sf).collect()}
    assert whole == {i: r.ids for i, r in after.items()}


def test_every_dealt_operator_is_registered():
    assert sorted(int(name[2:].split("_")[0]) for name in queries.queries()) == list(range(1, 14))
    assert set(queries.oracle_sql()) <= set(queries.queries())
