"""A corpus pipeline: five stages over ``documents``, each on all that its predecessor kept.

Order: quality classifier, line deduplication, near-duplicate removal, benchmark decontamination, BPE encoding.
"""

from __future__ import annotations

import uuid

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from opswatch.llm import bpe, decontamination, importance, line_dedup, near_copies
from opswatch.llm.common import shared_dir, stored, table
from opswatch.llm.queries import tokenizer_path


def _without(docs: DataFrame, gone: DataFrame) -> DataFrame:
    return docs.join(gone.select(F.col("doc_id").alias("gone_id")), F.col("doc_id").eqNullSafe(F.col("gone_id")), "left_anti")


def quality(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Documents drawn by importance resampling against the labelled good ones."""
    drawn = importance.resample(docs, table(spark, sf_dir, "labels")).select(F.col("doc_id").alias("drawn_id")).distinct()
    return docs.join(drawn, F.col("doc_id").eqNullSafe(F.col("drawn_id")), "left_semi")


def lines(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Texts without lines that an earlier line repeats; every document stays."""
    kept = line_dedup.dedup_lines(docs).select(*docs.columns)
    return kept.withColumn("n_chars", F.char_length("text").cast(docs.schema["n_chars"].dataType))


def near_duplicates(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """One document of each group of near duplicates: the one with the smallest doc_id.

    Texts are linked at a Jaccard of 0.8 of their five-word shingles; a group is all that links reach.
    Texts without words, such as copies emptied by the stage before, are one group. Rows with equal doc_id are one document.
    """
    groups = near_copies.near_copies(docs)
    later = stored(groups.filter(~F.col("id").eqNullSafe(F.col("component_id"))).select(F.col("id").alias("doc_id")).distinct())
    return _without(docs, later)


def decontaminate(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Documents that hold no benchmark item."""
    found = decontamination.contaminated(docs, table(spark, sf_dir, "benchmark"))
    return _without(docs, found.select("doc_id").distinct())


def tokens(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Token ids of every kept document, with digests of the ids and of the text decoded from them."""
    path = tokenizer_path("byte_bpe_50k.json")
    return bpe.digests(bpe.encode(docs, path, decoded=True))


STAGES = [
    ("quality classifier", quality),
    ("line dedup", lines),
    ("near duplicates", near_duplicates),
    ("decontamination", decontaminate),
    ("bpe", tokens),
]

#: fitted weights, fingerprints and token ids have no SQL form
ORACLE_SQL = None


def run(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = table(spark, sf_dir, "documents")
    folder = f"{shared_dir(spark)}/pipeline-{uuid.uuid4().hex}"
    for k, (_, stage) in enumerate(STAGES[:-1]):
        stage(spark, docs, sf_dir).write.option("compression", "zstd").parquet(f"{folder}/{k}")
        docs = spark.read.parquet(f"{folder}/{k}")
    return STAGES[-1][1](spark, docs, sf_dir)
