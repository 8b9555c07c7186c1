"""The corpus pipeline: five stages over ``documents``, each written as Parquet and read again as the next one's documents.

The files between stages go to the folder that the cluster names in ``spark.checkpoint.dir``; a stage's files are deleted
once the next stage is written.  The last stage is not written, so the files that it reads stay.
"""

from __future__ import annotations

import uuid
from collections.abc import Callable

from pyspark.sql import DataFrame, SparkSession

from quire.llm import bpe, dartminhash, linededup, mixing, toxicity
from quire.session import checkpoint_dir, remove, table


def drop_toxic(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Documents that the toxicity operator does not reject."""
    return toxicity.keep_clean(docs, table(spark, sf_dir, "labels"))


def dedup_lines(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Documents without the blocks of lines that repeat earlier documents; those that are left without any word go, as copies.

    A document that had no text before stays.
    """
    got = linededup.dedup(docs, counts=True)
    return got.filter("n_deleted = 0 or text rlike '\\\\S'").select(*docs.columns)


def dedup_near(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """One document of each near-duplicate class."""
    return dartminhash.dedup(docs)


def mix_sources(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Documents as often as the mix of sources takes them."""
    return mixing.mix(docs)


def tokenize(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Token ids of every document and the digests of op2."""
    return bpe.digests(docs)


STAGES: list[tuple[str, Callable[[SparkSession, DataFrame, str], DataFrame]]] = [
    ("toxicity", drop_toxic),
    ("line_dedup", dedup_lines),
    ("minhash_near_dedup", dedup_near),
    ("source_mixing", mix_sources),
    ("bpe_encode_decode", tokenize),
]

#: Trained scores, alignments, signatures and sampling are beyond SQL.  The tests hold the line stage against a brute-force
#: search for repeated passages, and the other stages' rows against their operators, whose own tests have the brute force.
ORACLE_SQL = None


def run(spark: SparkSession, sf_dir: str) -> DataFrame:
    """All stages over the documents of ``sf_dir``."""
    docs = table(spark, sf_dir, "documents")
    folder = f"{checkpoint_dir(spark)}/pipeline-{uuid.uuid4().hex}"
    before = None
    for name, stage in STAGES[:-1]:
        stage(spark, docs, sf_dir).write.parquet(f"{folder}/{name}")
        docs = spark.read.parquet(f"{folder}/{name}")
        if before:
            remove(spark, before)
        before = f"{folder}/{name}"
    return STAGES[-1][1](spark, docs, sf_dir)


QUERIES = {"pipeline": run}
ORACLE_SQL_BY_QUERY = {"pipeline": ORACLE_SQL}
