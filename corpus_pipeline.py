"""From raw documents to token ids: language, near copies, benchmark leaks, personal data, tokens."""

from __future__ import annotations

import uuid

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from floodplain.llm import language, personal, pieces, simhash, tiling
from floodplain.llm.queries import model_path
from floodplain.llm.shared import table
from floodplain.session import checkpoint_dir

COLUMNS = ("doc_id", "text", "lang", "source", "n_chars")


def identify(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Documents without a letter, and those whose best language has less than even odds, go."""
    return language.keep_identified(docs, language.train(docs))


def deduplicate(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Of each group of near copies the document with the smallest id stays."""
    return simhash.drop_near_copies(docs)


def decontaminate(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Documents that hold at least half of a benchmark item, in whatever order, go."""
    return tiling.drop_leaks(docs, table(spark, sf_dir, "benchmark"))


def redact(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Personal data in the texts is replaced."""
    return personal.redact_personal(docs)


def encode(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """The documents with their token ids, the source bytes of each, and whether decoding gives the text back."""
    rows = docs.select(F.struct(*COLUMNS).alias("doc"), F.col("text"))
    made = pieces.encode_decode(rows, model_path(), "doc")
    # The vocabulary's space sign decodes to a space.
    back = F.col("decoded") == F.translate(F.coalesce("doc.text", F.lit("")), pieces.SPACE, " ")
    return made.select("doc.*", F.size("ids").cast("long").alias("n_tokens"), "ids", "begins", "ends", back.alias("round_trip"))


STAGES = [
    ("language", identify),
    ("near_copies", deduplicate),
    ("benchmark_leaks", decontaminate),
    ("personal_data", redact),
    ("tokens", encode),
]

#: Fingerprints, naive Bayes and byte-pair merges have no SQL; tests compare with plain versions.
ORACLE_SQL = None


def run(spark: SparkSession, sf_dir: str) -> DataFrame:
    """All stages over ``documents``, each one's result written to the shared folder and read again."""
    docs = table(spark, sf_dir, "documents")
    base = f"{checkpoint_dir(spark)}/pipeline-{uuid.uuid4().hex}"
    for name, stage in STAGES[:-1]:
        stage(spark, docs, sf_dir).write.parquet(f"{base}/{name}")
        docs = spark.read.parquet(f"{base}/{name}")
    return STAGES[-1][1](spark, docs, sf_dir)
