"""Streams of bars: a folder of files as a source with a subscription of symbols."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from .bars import SCHEMA


def bar_stream(spark: SparkSession, path: str, symbols: list[str], *, kind: str = "parquet", watermark: str | None = None, files: int | None = None, extra: str = "") -> DataFrame:
    """A streaming frame of the bars of these symbols from files that arrive under path.

    The subscription is a filter that reaches the scan; symbols are compared trimmed and in upper
    case, and none gives none. `watermark` is how late a bar may come and still count in stateful
    operators; `files` bounds a micro-batch; `extra` names further columns, such as an arrival time.
    """
    wanted = sorted({s.strip().upper() for s in symbols})
    reader = spark.readStream.schema(SCHEMA + (f", {extra}" if extra else ""))
    if files:
        reader = reader.option("maxFilesPerTrigger", files)
    rows = reader.format(kind).load(path)
    rows = rows.where(F.upper(F.trim("symbol")).isin(wanted)) if wanted else rows.where(F.lit(False))
    return rows.withWatermark("ts", watermark) if watermark else rows
