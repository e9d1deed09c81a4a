"""The corpus pipeline: toxicity, near duplicates, benchmark leaks, source mix, shards.

Each stage takes (spark, docs, sf_dir) and returns a DataFrame, which run() writes as Parquet to
the shared folder and reads again as the next stage's docs. All stages but the last return the
columns of documents. Every stage reads doc_id, text and source alone and passes other columns
through, whatever their names; an empty table gives an empty one. Long texts are read whole.
"""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession

from tidemark.llm import decontam, jaccard, mixing, sharding, toxicity
from tidemark.llm.common import scratch


def drop_toxic(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Documents that the classifier does not reject. Null and empty texts are scored like others; repeated rows get one score; without labels nothing is rejected."""
    return toxicity.clean(docs, spark.read.parquet(f"{sf_dir}/labels.parquet"))


def drop_near_duplicates(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """One document of each group of near duplicates, that of the smallest id. Repeated rows leave one; null ids, and texts without words, all stay; rows that only share an id stay with their own texts."""
    return jaccard.one_of_each(docs)


def drop_leaks(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Documents without a benchmark item. Null and empty texts stay; repeated rows go or stay together."""
    return decontam.clean(docs, spark.read.parquet(f"{sf_dir}/benchmark.parquet"))


def mix_sources(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Every document as often as the mix of sources takes it. Texts without words have no size and are taken as often as others of their source; a null source is one of its own; repeated rows are taken one by one."""
    return mixing.emit(docs)


def shard(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """The corpus in 40 shards of near equal bytes, with shard and slot, read back from the shard files. Null texts have no bytes; repeated rows each have a slot; columns called shard or slot are replaced."""
    return sharding.rewritten(docs)


STAGES = [
    ("toxicity", drop_toxic),
    ("near_duplicates", drop_near_duplicates),
    ("decontamination", drop_leaks),
    ("mixing", mix_sources),
    ("sharding", shard),
]

#: A trained model, an exact set join and fingerprints come first: SQL gives none of their rows.
ORACLE_SQL = None


def run(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = spark.read.parquet(f"{sf_dir}/documents.parquet")
    for name, stage in STAGES:
        path = scratch(spark, f"stage-{name}")
        stage(spark, docs, sf_dir).write.parquet(path)
        docs = spark.read.parquet(path)
    return docs
