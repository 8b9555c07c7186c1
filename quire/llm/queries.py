"""The opN_ queries: each applies its operator to its whole table."""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from quire.llm import annforest, bm25, bpe, dartminhash, licences, linededup, mixing, quality, secretscan, toxicity
from quire.session import table

QUERIES: dict[str, Callable[[SparkSession, str], DataFrame]] = {}
ORACLE_SQL_BY_QUERY: dict[str, str] = {}


def query(name: str):
    def add(f):
        QUERIES[name] = f
        return f

    return add


@query("op2_bpe_encode_decode")
def op2(spark: SparkSession, sf_dir: str) -> DataFrame:
    return bpe.digests(table(spark, sf_dir, "documents"))


@query("op4_license_scan")
def op4(spark: SparkSession, sf_dir: str) -> DataFrame:
    got = licences.licences(table(spark, sf_dir, "documents"))
    base = F.filter("places", lambda p: p["base"])
    starts = F.transform(base, lambda p: p["word"])
    return got.select(
        "doc_id",
        "n_words",
        F.size(base).cast("bigint").alias("n_base"),
        F.array_min(starts).alias("first_word"),
        F.array_max(starts).alias("last_word"),
        F.concat_ws(",", F.array_sort(F.array_distinct(F.transform(base, lambda p: p["label"])))).alias("base_labels"),
        F.concat_ws(",", "labels").alias("labels"),
        "score",
    )


@query("op8_secret_scan")
def op8(spark: SparkSession, sf_dir: str) -> DataFrame:
    got = secretscan.secrets(table(spark, sf_dir, "documents"))
    said = lambda spans: F.concat_ws(",", F.transform(spans, lambda s: F.concat_ws(":", s["kind"], s["start"], s["end"])))
    count = lambda kind: F.size(F.filter("spans", lambda s: s["kind"] == kind)).cast("bigint").alias(f"n_{kind}")
    base = F.filter("spans", lambda s: s["kind"].isin(*secretscan.BASE_KINDS))
    return got.select("doc_id", *map(count, secretscan.BASE_KINDS), F.sha2(said(base).cast("binary"), 256).alias("base_sha256"), said(F.col("spans")).alias("spans"))


@query("op6_source_mixing")
def op6(spark: SparkSession, sf_dir: str) -> DataFrame:
    got = mixing.plan(table(spark, sf_dir, "documents").select("doc_id", "source", "text"))
    rows = got.withColumn("row", F.explode(F.sequence(F.lit(1), F.col("q_n"))))
    return rows.select(
        F.col("q_id").alias("doc_id"),
        F.col("q_size").alias("size"),
        F.col("q_source_size").alias("source_size"),
        F.col("q_target").alias("target"),
        (F.col("q_size") * F.col("q_copies")).alias("taken"),
        F.col("q_source").alias("source"),
    )


@query("op9_line_dedup")
def op9(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = table(spark, sf_dir, "documents").select("doc_id", "text")
    return linededup.dedup(docs, counts=True).select("doc_id", "n_lines", "n_deleted", "text")


@query("op7_minhash_near_dedup")
def op7(spark: SparkSession, sf_dir: str) -> DataFrame:
    got = dartminhash.classes(table(spark, sf_dir, "documents").select("doc_id", "text"))
    return got.select(F.col("q_id").alias("doc_id"), "class_id", F.col("q_first").alias("kept"))


@query("op1_toxicity")
def op1(spark: SparkSession, sf_dir: str) -> DataFrame:
    return toxicity.scored(table(spark, sf_dir, "documents").select("doc_id", "text"), table(spark, sf_dir, "labels"))


@query("op5_quality_classifier")
def op5(spark: SparkSession, sf_dir: str) -> DataFrame:
    return quality.graded(table(spark, sf_dir, "documents").select("doc_id", "text"), table(spark, sf_dir, "labels"))


@query("op10_ann_forest")
def op10(spark: SparkSession, sf_dir: str) -> DataFrame:
    return annforest.neighbours(table(spark, sf_dir, "embeddings").select("vec_id", "embedding"))


@query("op3_exact_topk_search")
def op3(spark: SparkSession, sf_dir: str) -> DataFrame:
    return bm25.search(table(spark, sf_dir, "documents").select("doc_id", "text"))
