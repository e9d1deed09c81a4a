"""Small helpers shared by the training-data operators."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession

from ..sources.shared import saved, scratch, shared_dir

__all__ = ["WORD", "saved", "scratch", "shared_dir", "table"]

#: The words of the contracts: runs of bytes other than space and \t..\r.
WORD = r"[^\x20\x09-\x0D]+"


def table(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    return spark.read.parquet(f"{sf_dir}/{name}.parquet")
