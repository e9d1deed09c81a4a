"""Bars stored copy-on-write: partitions are never changed in place, a manifest says which files count.

A write puts the new state of each touched (timeframe, year) into a folder of its own and then
publishes a manifest by one rename. Until then readers see the old version, whatever a lost job
left behind; after it they see the new one. Old versions stay readable. Two writers that start
from the same version cannot both publish: the rename of the second fails.
"""

from __future__ import annotations

import tempfile
import uuid

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from .bars import COLUMNS, SCHEMA, upsert

MANIFEST = "timeframe string, year int, folder string"


class Conflict(RuntimeError):
    """Another writer has published since this one read the store."""


def temporary(spark: SparkSession, name: str) -> str:
    """A new path in the folder that spark.checkpoint.dir names; a folder of this machine only in local mode."""
    base = spark.conf.get("spark.checkpoint.dir", None)
    if not base:
        if not spark.sparkContext.master.startswith("local"):
            raise ValueError("set spark.checkpoint.dir to a folder that the driver and all executors share")
        base = "file://" + tempfile.mkdtemp(prefix="tidemark-")
    return f"{base.rstrip('/')}/{name}-{uuid.uuid4().hex}"


class BarStore:
    """Bars under a path of any file system that Spark reads."""

    def __init__(self, spark: SparkSession, path: str):
        self.spark, self.path = spark, path.rstrip("/")

    def _fs(self, path: str):
        p = self.spark._jvm.org.apache.hadoop.fs.Path(path)
        return p.getFileSystem(self.spark._jsc.hadoopConfiguration()), p

    def versions(self) -> list[int]:
        fs, p = self._fs(f"{self.path}/manifest")
        return sorted(int(s.getPath().getName()[1:]) for s in fs.listStatus(p) if s.getPath().getName()[:1] == "v") if fs.exists(p) else []

    def manifest(self, version: int | None = None) -> list[tuple[str, int, str]]:
        """(timeframe, year, folder) of the partitions of a version, the last one by default: as many rows as partitions."""
        known = self.versions()
        version = version if version is not None else (known[-1] if known else 0)
        if not version:
            return []
        if version not in known:
            raise ValueError(f"no version {version}")
        return sorted(tuple(r) for r in self.spark.read.schema(MANIFEST).parquet(f"{self.path}/manifest/v{version:08d}").collect())

    def read(self, timeframe: str | None = None, version: int | None = None, years: set[int] | None = None) -> DataFrame:
        """Bars with timeframe and year; filters on both prune folders. A store without data gives no rows."""
        schema = f"{SCHEMA}, timeframe string, year int"
        found = [f"{self.path}/data/timeframe={t}/year={y}/w={f}" for t, y, f in self.manifest(version) if timeframe in (None, t) and (years is None or y in years)]
        if not found:
            return self.spark.createDataFrame([], schema)
        return self.spark.read.schema(schema).option("basePath", f"{self.path}/data").parquet(*found)

    def _published(self, base: int, rows: list[tuple[str, int, str]]) -> int:
        version = base + 1
        draft = f"{self.path}/manifest/draft-{uuid.uuid4().hex}"
        self.spark.createDataFrame(rows, MANIFEST).coalesce(1).write.parquet(draft)
        fs, source = self._fs(draft)
        _, target = self._fs(f"{self.path}/manifest/v{version:08d}")
        if fs.exists(target) or not fs.rename(source, target):
            raise Conflict(f"version {version} is there already")
        return version

    def _rewritten(self, timeframe: str, base: int, now: list[tuple[str, int, str]], touched: set[int], rows: DataFrame) -> int:
        """Writes rows as the whole new state of the touched years; other partitions stay as they are."""
        write = uuid.uuid4().hex
        out = rows.select(*COLUMNS).withColumns({"timeframe": F.lit(timeframe), "year": F.year("ts"), "w": F.lit(write)})
        # A year is dealt out by symbol, so that a large one is written by many tasks.
        out.repartition("year", F.pmod(F.xxhash64("symbol"), F.lit(16))).sortWithinPartitions("year", "symbol", "ts").write.mode("append").partitionBy("timeframe", "year", "w").parquet(f"{self.path}/data")
        written = set()
        for y in touched:
            fs, p = self._fs(f"{self.path}/data/timeframe={timeframe}/year={y}/w={write}")
            if fs.exists(p):
                written.add(y)
        kept = [m for m in now if m[0] != timeframe or m[1] not in touched]
        return self._published(base, [*kept, *[(timeframe, y, write) for y in written]])

    def _state(self) -> tuple[int, list[tuple[str, int, str]]]:
        known = self.versions()
        return (known[-1], self.manifest(known[-1])) if known else (0, [])

    @staticmethod
    def _years(bars: DataFrame) -> set[int]:
        return {r.year for r in bars.select(F.year("ts").alias("year")).distinct().collect()}

    def _holding(self, timeframe: str, base: int, symbols: DataFrame) -> set[int]:
        """Years in which one of the symbols has bars."""
        rows = self.read(timeframe, base or None).select("symbol", "year").join(symbols.select("symbol").distinct(), "symbol", "left_semi")
        return {r.year for r in rows.select("year").distinct().collect()}

    def replace(self, bars: DataFrame, timeframe: str) -> int:
        """The symbols of bars get these bars and no others; other symbols stay. Returns the new version."""
        base, now = self._state()
        new = bars.select(*COLUMNS)
        touched = self._years(new) | self._holding(timeframe, base, new)
        old = self.read(timeframe, base or None, touched).join(new.select("symbol").distinct(), "symbol", "left_anti").select(*COLUMNS)
        return self._rewritten(timeframe, base, now, touched, old.unionByName(new))

    def upsert(self, bars: DataFrame, timeframe: str) -> int:
        """New bars are added and replace stored ones of the same symbol and time. Returns the new version."""
        base, now = self._state()
        touched = self._years(bars)
        return self._rewritten(timeframe, base, now, touched, upsert(self.read(timeframe, base or None, touched), bars))

    def delete(self, symbols: DataFrame, timeframe: str) -> int:
        """Removes the symbols; only the years that hold one are written anew. Returns the version, a new one unless there was nothing to remove."""
        base, now = self._state()
        touched = self._holding(timeframe, base, symbols)
        if not touched:
            return base
        return self._rewritten(timeframe, base, now, touched, self.read(timeframe, base or None, touched).join(symbols.select("symbol").distinct(), "symbol", "left_anti"))
