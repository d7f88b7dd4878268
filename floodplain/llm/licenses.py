"""Licence statements: an exact set-similarity join of text blocks with templates, in DataFrame functions only."""

from __future__ import annotations

import math
from dataclasses import dataclass

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from floodplain.session import cut_lineage

UPPER, LOWER = "ABCDEFGHIJKLMNOPQRSTUVWXYZ", "abcdefghijklmnopqrstuvwxyz"
KELVIN = "K"
SEPARATORS = r"[\x00-\x2F\x3A-\x60\x7B-\x7F]+"


@dataclass(frozen=True)
class Template:
    """``words`` in lower case. A phrase is sought whole and in order in a whole text, any
    other template by the share of its distinct words that a block of the text holds: one
    line, or as many words as SPREAD templates from a line's beginning on, past line ends but not
    past a line without words."""

    name: str
    label: str
    words: str
    phrase: bool = False


# The phrases and their labels, and the wording of common licence statements.
TEMPLATES = (
    Template("mit phrase", "mit", "under the mit license", phrase=True),
    Template("apache phrase", "apache-2", "apache license version 2", phrase=True),
    Template("cc phrase", "cc-by-nc", "cc by nc", phrase=True),
    Template("mit grant", "mit", "permission is hereby granted free of charge to any person obtaining a copy of this software and associated documentation files the software to deal in the software without restriction"),
    Template("apache notice", "apache-2", "licensed under the apache license version 2 0 the license you may not use this file except in compliance with the license"),
    Template("apache short", "apache-2", "licensed under the apache license version 2 0"),
    Template("gpl short", "gpl-3", "licensed under the gnu general public license version 3"),
    Template("gpl notice", "gpl-3", "this program is free software you can redistribute it and or modify it under the terms of the gnu general public license as published by the free software foundation version 3"),
    Template("bsd grant", "bsd", "redistribution and use in source and binary forms with or without modification are permitted provided that the following conditions are met"),
    Template("cc short", "cc-by-nc", "licensed under cc by nc 4 0"),
    Template("cc name", "cc-by-nc", "creative commons attribution noncommercial 4 0 international license"),
    Template("mit short", "mit", "released under the mit license"),
    Template("mpl notice", "mpl-2", "this source code form is subject to the terms of the mozilla public license v 2 0"),
    Template("reserved", "all-rights-reserved", "all rights reserved"),
)

#: How many times as long as a template the stretch over line ends is in which it is sought.
SPREAD = 2

#: Templates are literals of the plan; their words are the only thing counted on the driver.
MAX_TEMPLATE_WORDS = 5000


def needed(template: Template, threshold: float) -> int:
    """How many distinct words a block must share with the template."""
    size = len(set(template.words.split()))
    return size if template.phrase else max(1, math.ceil(threshold * size - 1e-9))


def lowered(text: Column) -> Column:
    """A-Z lowered. The quick function lowers more; of its further results only the Kelvin sign's is ASCII."""
    whole = F.coalesce(text, F.lit(""))
    return F.when(whole.contains(KELVIN), F.translate(whole, UPPER, LOWER)).otherwise(F.lower(whole))


def words_of(low: Column) -> Column:
    return F.array_remove(F.split(low, SEPARATORS, -1), "")


def strings(values) -> Column:
    return F.array(*(F.lit(value) for value in values)) if values else F.array().cast("array<string>")


def word_order(docs: DataFrame, templates: tuple[Template, ...], text_col: str = "text") -> list[str]:
    """The templates' words, rarest first by the number of texts that hold them; equal numbers by spelling.

    Counted over all texts; only the templates' own words and their counts reach the driver.
    """
    vocabulary = sorted({word for template in templates for word in template.words.split()})
    if len(vocabulary) > MAX_TEMPLATE_WORDS:
        raise ValueError(f"{len(vocabulary)} template words; at most {MAX_TEMPLATE_WORDS} are sent to the tasks")
    held = docs.select(F.explode(F.array_intersect(words_of(lowered(F.col(text_col))), strings(vocabulary))).alias("word"))
    counts = {row["word"]: row["n"] for row in held.groupBy("word").agg(F.count(F.lit(1)).alias("n")).collect()}
    return sorted(vocabulary, key=lambda word: (counts.get(word, 0), word))


def entries(templates: tuple[Template, ...], order: list[str], threshold: float) -> list[tuple]:
    """``(template, place, word)`` of each template's prefix: its rarest words, one of which any match must hold."""
    rank = {word: i for i, word in enumerate(order)}
    out = []
    for number, template in enumerate(templates):
        mine = sorted(set(template.words.split()), key=rank.get)
        out += [(number, place, rank[word]) for place, word in enumerate(mine[: len(mine) - needed(template, threshold) + 1])]
    return out


def similar_blocks(blocks: DataFrame, words: str, keep: list[str], templates: tuple[Template, ...], order: list[str], threshold: float, only: Column | None = None, spread: int | None = None) -> DataFrame:
    """``keep`` columns with the templates a block contains to the needed share: ``template, shared, size``.

    A block's words are put into the common order; those in some prefix are joined
    with the prefixes, pairs are dropped whose sizes or places leave too few words
    to share, and the rest are counted exactly; with ``spread`` within the block's
    first words, so many times as long as the template. The prefixes are a table as long
    as the templates and are broadcast.
    """
    spark = blocks.sparkSession
    prefix = entries(templates, order, threshold)
    tables = [(n, len(set(t.words.split())), needed(t, threshold), sorted(order.index(w) for w in set(t.words.split())), t.phrase, t.words.split()) for n, t in enumerate(templates)]
    facts = spark.createDataFrame(tables, "template INT, size INT, need INT, ranks ARRAY<INT>, phrase BOOLEAN, terms ARRAY<STRING>")
    starts = spark.createDataFrame(prefix, "template INT, place INT, rank INT")
    table = F.broadcast(starts.join(facts if only is None else facts.where(only), "template"))
    rarest = strings(sorted({order[rank] for _, _, rank in prefix}))
    ranked = F.create_map(*(F.lit(x) for i, word in enumerate(order) for x in (word, i)))
    held = F.array_sort(F.transform(F.array_intersect(words, strings(order)), lambda word: ranked[word]))
    rows = blocks.where(F.arrays_overlap(words, rarest)).withColumn("_held", held)
    found = rows.select("*", F.posexplode("_held").alias("_at", "_rank")).join(table, F.col("_rank") == F.col("rank"))
    room = F.least(F.col("_at"), F.col("place")) + 1 + F.least(F.size("_held") - F.col("_at") - 1, F.col("size") - F.col("place") - 1)
    found = found.where((F.size("_held") >= F.col("need")) & (room >= F.col("need")))
    # Of several common prefix words the first one stands for the pair.
    first = F.element_at(F.array_intersect("_held", "ranks"), 1) == F.col("_rank")
    shared = F.size(F.array_intersect("_held", "ranks"))
    if spread is not None:
        shared = F.size(F.array_intersect(F.slice(words, 1, F.size("terms") * spread), "terms"))
    return found.where(first & (shared >= F.col("need"))).select(*keep, "template", shared.alias("shared"), "size")


def scan_texts(docs: DataFrame, order: list[str], threshold: float, templates: tuple[Template, ...], id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """``(id, text_hash, n_words, low)``: one row per row, the lowered text only where it holds a word of some prefix.

    Checkpointed, so that the texts are cut into words once; only the few texts
    that can match anything are carried on.
    """
    rarest = strings(sorted({order[rank] for _, _, rank in entries(templates, order, threshold)}))
    whole = docs.select(F.col(id_col).alias("id"), F.xxhash64(text_col).alias("text_hash"), lowered(F.col(text_col)).alias("low")).withColumn("words", words_of(F.col("low")))
    return cut_lineage(whole.select("id", "text_hash", F.size("words").cast("long").alias("n_words"), F.when(F.arrays_overlap("words", rarest), F.col("low")).alias("low")))


def matches(scanned: DataFrame, order: list[str], threshold: float, templates: tuple[Template, ...]) -> DataFrame:
    """Every block of scanned texts that contains a template; see ``find_licenses``."""
    whole = scanned.where("low IS NOT NULL").select("id", "text_hash", "low", words_of(F.col("low")).alias("words"))
    texts = similar_blocks(whole, "words", ["id", "text_hash", "low", "words"], templates, order, threshold)
    text_hits = texts.groupBy("id", "text_hash", "template").agg(F.first("low").alias("low"), F.first("words").alias("words"))
    phrase_rows = [(number, template.words.split()) for number, template in enumerate(templates) if template.phrase]
    phrase = F.create_map(*(x for number, words in phrase_rows for x in (F.lit(number), strings(words)))) if phrase_rows else F.create_map().cast("map<int,array<string>>")
    sought = phrase[F.col("template")]
    begins = F.filter(F.sequence(F.lit(0), F.size("words") - F.size(sought)), lambda i: F.slice("words", i + 1, F.size(sought)) == sought)
    phrases = text_hits.where(sought.isNotNull() & (F.size("words") >= F.size(sought))).withColumn("places", begins).where(F.size("places") > 0).select(
        "id", "text_hash", "template", F.lit(None).cast("int").alias("line"), F.lit(1.0).alias("share"), "places")
    # A line can only contain what its text contains, so only such texts are cut.
    lines = text_hits.where(sought.isNull()).groupBy("id", "text_hash").agg(F.first("low").alias("low"))
    lines = lines.select("id", "text_hash", F.posexplode(F.split("low", "\n", -1)).alias("line", "block")).withColumn("words", words_of(F.col("block")))
    keep = ["id", "text_hash", "line"]
    near = similar_blocks(lines, "words", keep, templates, order, threshold, only=~F.col("phrase"))
    near = near.unionByName(similar_blocks(stretches(lines, templates), "stretch", keep, templates, order, threshold, only=~F.col("phrase"), spread=SPREAD))
    near = near.groupBy(*keep, "template").agg(F.max(F.col("shared") / F.col("size")).alias("share"))
    return phrases.unionByName(near.select("id", "text_hash", "template", "line", "share", F.lit(None).cast("array<int>").alias("places")))


def stretches(lines: DataFrame, templates: tuple[Template, ...]) -> DataFrame:
    """Add ``stretch`` to every line with words: its words and those of the lines below it, up to a line without words and as many as any template needs.

    A look ahead over a bounded number of a text's lines, each cut to that many words.
    """
    most = SPREAD * max((len(t.words.split()) for t in templates if not t.phrase), default=1)
    ahead = Window.partitionBy("id", "text_hash").orderBy("line").rowsBetween(0, most - 1)
    cut = lines.withColumn("_ahead", F.collect_list(F.slice("words", 1, most)).over(ahead)).where(F.size("words") > 0)
    blank = F.array_position(F.transform("_ahead", F.size), 0)
    block = F.when(blank > 0, F.slice("_ahead", F.lit(1), F.greatest(blank - 1, F.lit(0)).cast("int"))).otherwise(F.col("_ahead"))
    return cut.withColumn("stretch", F.slice(F.flatten(block), 1, most)).drop("_ahead")


def find_licenses(docs: DataFrame, threshold: float = 0.8, templates: tuple[Template, ...] = TEMPLATES, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """Every block that contains a template: ``(id, text_hash, template, line, share, places)``.

    ``line`` is the line, counted from 0, in which the block begins (null: the whole text, for phrases),
    ``share`` is the part of the template's distinct words in the block (the greater of the
    line's and the stretch's from there on, see ``Template``), so that a notice is found
    however it is wrapped; ``places``
    the word numbers at which a phrase begins (else null). A phrase is found
    through the same join, with all its words needed, and then its order is
    checked. ``text_hash`` tells rows of one id apart. Null texts are empty.
    """
    order = word_order(docs, templates, text_col)
    return matches(scan_texts(docs, order, threshold, templates, id_col, text_col), order, threshold, templates).withColumnRenamed("id", id_col)


def license_summary(docs: DataFrame, threshold: float = 0.8, templates: tuple[Template, ...] = TEMPLATES, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """One row per row: ``(id, n_words, n_base, first_word, last_word, base_labels, labels, score)``.

    ``n_base`` counts the places of all phrases, the two word numbers are their
    first and last; labels are distinct, sorted and joined by commas; the score is
    the greatest share found, 0 where nothing is. Rows of the same id and text get
    the same results each; ids may be null.
    """
    label = F.create_map(*(x for number, template in enumerate(templates) for x in (F.lit(number), F.lit(template.label))))
    order = word_order(docs, templates, text_col)
    rows = scan_texts(docs, order, threshold, templates, id_col, text_col)
    found = matches(rows, order, threshold, templates).withColumn("label", label[F.col("template")])
    joined = found.groupBy(F.col("id").alias("_id"), F.col("text_hash").alias("_hash")).agg(
        F.flatten(F.collect_list("places")).alias("all_places"),
        F.array_sort(F.collect_set(F.when(F.col("places").isNotNull(), F.col("label")))).alias("base"),
        F.array_sort(F.collect_set("label")).alias("every"), F.max("share").alias("best"))
    out = rows.join(joined, F.col("id").eqNullSafe(F.col("_id")) & (F.col("text_hash") == F.col("_hash")), "left")
    return out.select(
        F.col("id").alias(id_col), "n_words", F.coalesce(F.size("all_places"), F.lit(0)).cast("long").alias("n_base"),
        F.array_min("all_places").cast("long").alias("first_word"), F.array_max("all_places").cast("long").alias("last_word"),
        F.coalesce(F.array_join("base", ","), F.lit("")).alias("base_labels"), F.coalesce(F.array_join("every", ","), F.lit("")).alias("labels"),
        F.coalesce("best", F.lit(0.0)).alias("score"))


def summary_sql(threshold: float = 0.8, templates: tuple[Template, ...] = TEMPLATES) -> str:
    """The same by plain comparison of every line, stretch and text with every template, for DuckDB."""
    values = ", ".join(f"({n}, '{t.label}', {t.phrase}, string_split('{t.words}', ' '), {len(set(t.words.split()))}, {needed(t, threshold)})" for n, t in enumerate(templates))
    pattern = r"[^\x00-\x2F\x3A-\x60\x7B-\x7F]+"
    return rf"""
WITH t(template, label, phrase, words, size, need) AS (VALUES {values}),
d AS (SELECT doc_id, translate(coalesce(text, ''), '{UPPER}', '{LOWER}') AS low, row_number() OVER () AS n FROM documents),
w AS (SELECT doc_id, n, low, regexp_extract_all(low, '{pattern}') AS words FROM d),
places AS (
  SELECT n, label, i FROM (SELECT n, label, w.words AS held, t.words AS sought, unnest(range(len(w.words)::BIGINT)) AS i FROM w, t WHERE phrase AND list_has_all(w.words, t.words))
  WHERE held[i + 1 : i + len(sought)] = sought),
cut AS (SELECT n, unnest(blocks) AS block, generate_subscripts(blocks, 1) AS i FROM (SELECT n, string_split(low, chr(10)) AS blocks FROM d)),
spoken AS (SELECT n, i, regexp_extract_all(block, '{pattern}') AS words FROM cut),
line AS (SELECT n, list_distinct(words) AS words FROM spoken),
numbered AS (SELECT n, i, words, part, sum(len(words)) OVER (PARTITION BY n, part ORDER BY i) - len(words) AS start
  FROM (SELECT *, sum(CASE WHEN len(words) = 0 THEN 1 ELSE 0 END) OVER (PARTITION BY n ORDER BY i) AS part FROM spoken)),
spelled AS (SELECT n, part, start + generate_subscripts(words, 1) - 1 AS at, unnest(words) AS word FROM numbered),
sought AS (SELECT template, label, size, need, len(words) AS total, unnest(list_distinct(words)) AS word FROM t WHERE NOT phrase),
stretch AS (
  SELECT b.n, b.i, s.label, count(DISTINCT s.word) AS shared, any_value(s.size) AS size, any_value(s.need) AS need
  FROM spelled p JOIN sought s USING (word) JOIN numbered b ON b.n = p.n AND b.part = p.part AND len(b.words) > 0 AND p.at >= b.start AND p.at < b.start + {SPREAD} * s.total
  GROUP BY b.n, b.i, s.template, s.label),
near AS (
  SELECT n, label, shared / size AS share
  FROM (SELECT n, label, need, size, len(list_intersect(line.words, t.words)) AS shared FROM line, t WHERE NOT phrase AND len(line.words) >= need)
  WHERE shared >= need
  UNION ALL SELECT n, label, shared / size AS share FROM stretch WHERE shared >= need),
base AS (SELECT n, count(*) AS n_base, min(i) AS first_word, max(i) AS last_word, string_agg(DISTINCT label, ',' ORDER BY label) AS base_labels FROM places GROUP BY n),
every AS (
  SELECT n, string_agg(DISTINCT label, ',' ORDER BY label) AS labels, max(share) AS score
  FROM (SELECT n, label, 1.0::DOUBLE AS share FROM places UNION ALL SELECT n, label, share FROM near) GROUP BY n)
SELECT doc_id, len(w.words)::BIGINT AS n_words, coalesce(n_base, 0)::BIGINT AS n_base, first_word::BIGINT AS first_word, last_word::BIGINT AS last_word,
  coalesce(base_labels, '') AS base_labels, coalesce(labels, '') AS labels, coalesce(score, 0)::DOUBLE AS score
FROM w LEFT JOIN base USING (n) LEFT JOIN every USING (n)"""
