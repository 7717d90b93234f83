"""The corpus pipeline: five stages from documents to shards.

Each stage takes (spark, docs, sf_dir) and works on all that its predecessor
kept; all but the last return the columns of ``documents``.
"""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession

from tablescape.llm import decontamination, mixing, quality, sharding, simhash
from tablescape.session import release_staged, stage, staged_count

#: SQL can't express a trained classifier, so the stages are tested one by one against brute force.
ORACLE_SQL = None


def classify(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Documents that the quality classifier rejects go.

    Null and empty texts are scored as empty ones; repeated rows share their
    fate; without labels nothing goes; an empty table stays empty. All columns
    stay, whatever their names.
    """
    return quality.accepted(docs, spark.read.parquet(f"{sf_dir}/labels.parquet"))


def near_dedup(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """One document stays of each group of near-duplicates, that of the least doc_id, nulls last.

    SimHash fingerprints of 3-word shingles within 3 bits link, as in
    op3_simhash, and so do those within 9 bits if the fingerprints of the single
    words are within 3: most copies that share 0.8 of their five-word shingles.
    Null and empty texts are one group; an empty table stays empty. All columns
    stay, whatever their names.
    """
    return simhash.keep_first(docs)


def decontaminate(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Documents that hold benchmark passages go, by the operator's rule.

    Null and empty texts stay; repeated rows share their fate; without
    benchmark items nothing goes; an empty table stays empty. All columns
    stay, whatever their names.
    """
    return decontamination.clean_documents(docs, spark.read.parquet(f"{sf_dir}/benchmark.parquet"))


def mix(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Documents stay as often as the mix takes them: not at all, once or twice.

    Rows without words are not taken; a null source is a source; repeated rows
    are rows of their own; an empty table stays empty. All columns stay,
    whatever their names.
    """
    return mixing.mixed_documents(docs)


def shard(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Every document with its shard and its slot there, and all its columns.

    Equal texts share a shard, null texts are one group; null ids and repeated
    rows each have a slot; a column that shares its name with a new one gets
    an underscore after it; an empty table stays empty.
    """
    return sharding.shard_documents(docs, 8, carry=tuple(c for c in docs.columns if c != "doc_id"))


STAGES = [("quality", classify), ("near_dedup", near_dedup), ("decontaminate", decontaminate), ("mix", mix), ("shard", shard)]


def run(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = spark.read.parquet(f"{sf_dir}/documents.parquet")
    for name, step in STAGES[:-1]:
        before = staged_count(spark)
        docs = stage(step(spark, docs, sf_dir), name)
        release_staged(spark, before, keep=1)  # what the stage wrote on its way
    return STAGES[-1][1](spark, docs, sf_dir)
