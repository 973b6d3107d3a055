"""One query per operator of this subpackage, with the parameters of production."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from . import (
    centroids,
    decontaminate,
    exact_dedup,
    fill_in_middle,
    language,
    line_chunks,
    mixing,
    near_dedup,
    pii,
    quality,
    rows,
    secrets,
    toxicity,
    url_filter,
)
from .oracle import ORACLE

__all__ = ["ORACLE", "QUERIES"]


def op1_decontamination(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = rows.table(spark, sf_dir, "documents").select("doc_id", "text")
    benchmark = rows.table(spark, sf_dir, "benchmark")
    return decontaminate.digest(
        decontaminate.find_contamination(docs, benchmark, keep=["doc_id"])
    )


def op2_pii(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = rows.table(spark, sf_dir, "documents").select("doc_id", "text")
    return pii.digest(pii.find_personal_data(docs))


def op3_line_dedup(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = rows.table(spark, sf_dir, "documents").select("doc_id", "text")
    return line_chunks.remove_repeated(docs).withColumn("n_removed", F.col("n_removed").cast("bigint"))


def op4_toxicity(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = rows.table(spark, sf_dir, "documents").select("doc_id", "text")
    labels = rows.table(spark, sf_dir, "labels")
    model = toxicity.learn(docs, labels, rows.fold(F.col("_key"), 5) != 0)
    scored = toxicity.score(docs, model, keep=["doc_id"])
    return scored.select(
        "doc_id", (rows.fold(F.col("doc_id"), 5) == 0).alias("held_out"), "score", "predicted"
    )


def op5_near_dedup(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = rows.table(spark, sf_dir, "documents").select("doc_id", "text")
    return near_dedup.near_duplicates(docs)


def op6_quality(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = rows.table(spark, sf_dir, "documents").select("doc_id", "text")
    return quality.judge(docs, rows.table(spark, sf_dir, "labels"))


def op7_secrets(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = rows.table(spark, sf_dir, "documents").select("doc_id", "text")
    return secrets.digest(secrets.find_secrets(docs))


def op8_url_filter(spark: SparkSession, sf_dir: str) -> DataFrame:
    pages = rows.table(spark, sf_dir, "pages").select("page_id", "url")
    return url_filter.judge(pages, keep=["page_id"])


def op9_language_id(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = rows.table(spark, sf_dir, "documents").select("doc_id", "text", "lang")
    held_out = rows.fold(F.col("doc_id"), 4) == 2
    prototypes = language.learn(docs, "doc_id", ~held_out)
    found = language.identify(docs, prototypes, keep=["doc_id"])
    return found.select(
        "doc_id", (rows.fold(F.col("doc_id"), 4) == 2).alias("held_out"), "lang_pred", "score"
    )


def op10_mixing(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = rows.table(spark, sf_dir, "documents").select("doc_id", "text", "source")
    return mixing.mix(docs)


def op11_exact_dedup(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = rows.table(spark, sf_dir, "documents").select("doc_id", "text")
    return exact_dedup.exact_duplicates(docs)


def op12_fill_in_middle(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = rows.table(spark, sf_dir, "documents").select("doc_id", "text")
    return fill_in_middle.digest(fill_in_middle.fill_in_middle(docs, keep=["doc_id"]))


def op13_centroids(spark: SparkSession, sf_dir: str) -> DataFrame:
    vectors = rows.table(spark, sf_dir, "embeddings").select("vec_id", "embedding")
    return centroids.digest(*centroids.cluster(vectors))


QUERIES = {
    f.__name__: f
    for f in (
        op1_decontamination,
        op2_pii,
        op3_line_dedup,
        op4_toxicity,
        op5_near_dedup,
        op6_quality,
        op7_secrets,
        op8_url_filter,
        op9_language_id,
        op10_mixing,
        op11_exact_dedup,
        op12_fill_in_middle,
        op13_centroids,
    )
}
