"""Registered queries of the training-data operators, over whole tables, and their SQL where SQL can express them."""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from folioscope.llm import (
    decontaminate, heap_clusters, importance, jaccard_join, language_id, mixing, oracles, projection_forest, pu_quality,
    resharding, site_style, string_kernel, token_counts, voronoi_knn)
from folioscope.llm.common import table


def op1_source_mixing(spark: SparkSession, sf_dir: str) -> DataFrame:
    drawn = mixing.decide(table(spark, sf_dir, "documents"), ["doc_id", "source"])
    return drawn.select("doc_id", "source", "size", "source_size", "target",
                        (F.col("copies") * F.col("size")).alias("taken"), "copies")


def op2_resharding(spark: SparkSession, sf_dir: str) -> DataFrame:
    placed = resharding.assign(table(spark, sf_dir, "documents"), ["doc_id"])
    return placed.select("doc_id", "size", "text_crc32", F.lit("rows").alias("law"), "shard", "slot",
                         F.lit(None).cast("int").alias("grown_shard"), "old_shard")


def op3_pu_quality(spark: SparkSession, sf_dir: str) -> DataFrame:
    return pu_quality.score(table(spark, sf_dir, "documents"), table(spark, sf_dir, "labels"))


def op4_string_kernel(spark: SparkSession, sf_dir: str) -> DataFrame:
    return string_kernel.score(table(spark, sf_dir, "documents"), table(spark, sf_dir, "labels"))


def op5_site_style(spark: SparkSession, sf_dir: str) -> DataFrame:
    return site_style.extract(table(spark, sf_dir, "pages"))


def op6_decontamination(spark: SparkSession, sf_dir: str) -> DataFrame:
    return decontaminate.matches(table(spark, sf_dir, "documents"), table(spark, sf_dir, "benchmark"))


def op7_jaccard_join(spark: SparkSession, sf_dir: str) -> DataFrame:
    return jaccard_join.join(table(spark, sf_dir, "documents")).select(
        "doc_id", "n_shingles", "component_id", "class_id")


def op8_voronoi_knn(spark: SparkSession, sf_dir: str) -> DataFrame:
    return voronoi_knn.top_k(table(spark, sf_dir, "embeddings"))


def op9_token_counts(spark: SparkSession, sf_dir: str) -> DataFrame:
    return token_counts.count_tokens(table(spark, sf_dir, "documents").select("doc_id", "text"))


def op10_language_id(spark: SparkSession, sf_dir: str) -> DataFrame:
    return language_id.identify(table(spark, sf_dir, "documents"))


def op11_importance_resampling(spark: SparkSession, sf_dir: str) -> DataFrame:
    return importance.resample(table(spark, sf_dir, "documents"), table(spark, sf_dir, "benchmark"))


def op12_heap_clusters(spark: SparkSession, sf_dir: str) -> DataFrame:
    return heap_clusters.cluster(table(spark, sf_dir, "embeddings")).drop("scans")


def op13_projection_forest(spark: SparkSession, sf_dir: str) -> DataFrame:
    return projection_forest.near_copies(table(spark, sf_dir, "embeddings"))


QUERIES: dict[str, Callable[[SparkSession, str], DataFrame]] = {
    "op1_source_mixing": op1_source_mixing,
    "op2_resharding": op2_resharding,
    "op3_pu_quality": op3_pu_quality,
    "op4_string_kernel": op4_string_kernel,
    "op5_site_style": op5_site_style,
    "op6_decontamination": op6_decontamination,
    "op7_jaccard_join": op7_jaccard_join,
    "op8_voronoi_knn": op8_voronoi_knn,
    "op9_token_counts": op9_token_counts,
    "op10_language_id": op10_language_id,
    "op11_importance_resampling": op11_importance_resampling,
    "op12_heap_clusters": op12_heap_clusters,
    "op13_projection_forest": op13_projection_forest,
}

ORACLES: dict[str, str] = oracles.ORACLES
