"""The corpus pipeline: five stages over `documents`, each calling one operator of shelfwise.llm."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession, functions as F

from shelfwise.llm import common, decontaminate, minhash, mixing, sharding, toxicity


def drop_toxic(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """The documents that the tagger does not predict to be toxic.

    A text decides: rows of equal texts go together. Null and empty texts stay; without labels of both kinds all rows stay;
    repeated rows stay repeated; an empty table gives an empty one; further columns, whatever their names, are kept.
    """
    labels = spark.read.parquet(f"{sf_dir}/labels.parquet")
    return toxicity.clean(docs, labels)


def drop_near_duplicates(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """One document of each group of near-duplicates: that of the least doc_id, and one row of it.

    Null and empty texts have no duplicates but rows of the same doc_id; rows with a null doc_id stay; an empty table gives an
    empty one; further columns, whatever their names, are kept.
    """
    return minhash.deduplicate(docs)


def drop_contaminated(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """The documents that no benchmark item contaminates.

    A text decides, whatever its doc_id. Null and empty texts stay; items of fewer than five tokens contaminate only texts
    that say nothing else; an empty benchmark takes nothing; repeated rows stay repeated; further columns are kept.
    """
    return decontaminate.clean(docs, spark.read.parquet(f"{sf_dir}/benchmark.parquet"))


def mix_sources(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """A row for each time that the mix takes a document, in the order of the curriculum.

    Texts without words are taken no times; a null source is a source of its own; each of several equal rows has its own
    copies; an empty table gives an empty one; further columns, whatever their names, are kept.
    """
    return mixing.mixed_documents(docs)


def shard(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """doc_id, size, text_crc32, law, shard, slot and grown_shard of every row that is left.

    Copies of a text share a shard, each with a slot of its own; a null text has a size of 8 and no checksum; an empty table
    gives an empty result; further columns are ignored.
    """
    return sharding.shard_documents(docs)


STAGES = [
    ("toxicity", drop_toxic),
    ("near_dedup", drop_near_duplicates),
    ("decontamination", drop_contaminated),
    ("mixing", mix_sources),
    ("sharding", shard),
]


def run(spark: SparkSession, sf_dir: str) -> DataFrame:
    """All stages, each written and read again by the next."""
    docs = common.documents(spark, sf_dir)
    for name, stage in STAGES[:-1]:
        docs = common.materialise(stage(spark, docs, sf_dir), f"pipeline-{name}")
    return STAGES[-1][1](spark, docs, sf_dir)


#: Tagging, linking and tiling have no SQL form; tests compare the stages with brute-force versions.
ORACLE_SQL = None
