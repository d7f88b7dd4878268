"""The registered queries of these operators, each over whole tables, and SQL where SQL can say it."""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from floodplain.llm import language, lexical, licenses, negatives, passages, personal, pieces, resampling, search, simhash, tiling, token_counts, vectors
from floodplain.llm.shared import table

MODEL = "piece_bpe_32k.model"


def model_path() -> str:
    import public_tokenizers

    return public_tokenizers.path(MODEL)


def op1_sentencepiece(spark: SparkSession, sf_dir: str) -> DataFrame:
    made = pieces.encode_decode(table(spark, sf_dir, "documents"), model_path())
    return made.select(
        "doc_id", F.size("ids").cast("long").alias("n_tokens"),
        F.sha2(F.array_join(F.col("ids").cast("array<string>"), ","), 256).alias("ids_sha256"),
        F.sha2("decoded", 256).alias("decoded_sha256"),
        F.sha2(F.array_join(F.col("ends").cast("array<string>"), ","), 256).alias("ends_sha256"),
    )


def op9_decontamination(spark: SparkSession, sf_dir: str) -> DataFrame:
    return tiling.find_leaks(table(spark, sf_dir, "documents"), table(spark, sf_dir, "benchmark"), min_match=5, threshold=0.5)


def op10_token_counts(spark: SparkSession, sf_dir: str) -> DataFrame:
    return token_counts.token_counts(table(spark, sf_dir, "documents"), model_path(), limit=4096)


def op2_personal_data(spark: SparkSession, sf_dir: str) -> DataFrame:
    found = personal.find_personal(table(spark, sf_dir, "documents"))
    counts = [personal.number("spans", kind).alias(f"n_{kind}") for kind in personal.BASE]
    return found.select("doc_id", *counts, F.sha2(personal.joined("spans", personal.BASE), 256).alias("base_sha256"), personal.joined("spans", personal.KINDS).alias("spans"))


def op3_near_vectors(spark: SparkSession, sf_dir: str) -> DataFrame:
    return vectors.near_vectors(table(spark, sf_dir, "embeddings"), threshold=0.98)


def op4_repeated_passages(spark: SparkSession, sf_dir: str) -> DataFrame:
    return passages.repeated_passages(table(spark, sf_dir, "documents"))


def op5_licenses(spark: SparkSession, sf_dir: str) -> DataFrame:
    return licenses.license_summary(table(spark, sf_dir, "documents"), threshold=0.8)


def op6_importance_resampling(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = table(spark, sf_dir, "documents")
    return resampling.resample(docs, resampling.labelled_target(docs, table(spark, sf_dir, "labels")), share=0.75)


def op7_language(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = table(spark, sf_dir, "documents")
    found = language.identify(docs, language.train(docs))
    return found.select("doc_id", language.held_out().alias("held_out"), "lang_pred", "score")


def op8_simhash(spark: SparkSession, sf_dir: str) -> DataFrame:
    groups = simhash.simhash_groups(table(spark, sf_dir, "documents"), words=3, radius=3)
    return groups.select("doc_id", F.lower(F.lpad(F.hex("f0"), 16, "0")).alias("fingerprint"), "component_id")


def op11_hard_negatives(spark: SparkSession, sf_dir: str) -> DataFrame:
    label = F.when(F.col("vec_id") % 7 == 0, (F.col("label") + 1) % 10).otherwise(F.col("label"))
    return negatives.hard_negatives(table(spark, sf_dir, "embeddings"), F.col("vec_id") % 100 == 0, label=label)


def op12_top_k(spark: SparkSession, sf_dir: str) -> DataFrame:
    return search.top_inner_products(table(spark, sf_dir, "embeddings"), F.col("vec_id") % 50 == 0, k=5, scale=256)


def op13_lexical_search(spark: SparkSession, sf_dir: str) -> DataFrame:
    return lexical.lexical_search(table(spark, sf_dir, "documents"), table(spark, sf_dir, "benchmark"), k=10)


def queries() -> dict[str, Callable[[SparkSession, str], DataFrame]]:
    registered = [
        op1_sentencepiece, op2_personal_data, op3_near_vectors, op4_repeated_passages, op5_licenses,
        op6_importance_resampling, op7_language, op8_simhash, op9_decontamination, op10_token_counts,
        op11_hard_negatives, op12_top_k, op13_lexical_search,
    ]
    return {query.__name__: query for query in registered}


def oracle_sql() -> dict[str, str]:
    return {
        "op5_licenses": licenses.summary_sql(0.8), "op11_hard_negatives": negatives.NEGATIVES_SQL,
        "op12_top_k": search.SEARCH_SQL, "op13_lexical_search": lexical.LEXICAL_SQL,
    }
