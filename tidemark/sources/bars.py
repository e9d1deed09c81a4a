"""Long bar tables: (ts, symbol, open, high, low, close, volume), stored by timeframe and year."""

from __future__ import annotations

from datetime import datetime

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

SCHEMA = "ts timestamp, symbol string, open double, high double, low double, close double, volume double"
COLUMNS = ["ts", "symbol", "open", "high", "low", "close", "volume"]


def from_ticks(ticks: DataFrame, symbol: Column, ts: Column, price: Column, volume: Column, order: list[Column], unit: str) -> DataFrame:
    """Bars of a unit (hour, day, week) from ticks; first and last price by `order`, which must be unique in a bar."""
    rows = ticks.select(symbol.cast("string").alias("symbol"), F.date_trunc(unit, ts).alias("ts"), price.cast("double").alias("p"), volume.cast("double").alias("v"), F.struct(*order).alias("o"))
    return rows.groupBy("ts", "symbol").agg(F.min_by("p", "o").alias("open"), F.max("p").alias("high"), F.min("p").alias("low"), F.max_by("p", "o").alias("close"), F.sum("v").alias("volume"))


def hourly(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Bars of event values by event type and hour."""
    e = spark.read.parquet(f"{sf_dir}/events.parquet")
    ts = F.col("ts").cast("timestamp")
    return from_ticks(e, F.col("event_type"), ts, F.col("value"), F.lit(1), [ts, F.col("event_id")], "hour")


def daily(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Bars of event values by user and day."""
    e = spark.read.parquet(f"{sf_dir}/events.parquet")
    ts = F.col("ts").cast("timestamp")
    return from_ticks(e, F.col("user_id"), ts, F.col("value"), F.lit(1), [ts, F.col("event_id")], "day")


def weekly(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Bars of unit prices by brand and week of shipment."""
    l = spark.read.parquet(f"{sf_dir}/lineitem.parquet").select("l_partkey", "l_shipdate", "l_orderkey", "l_linenumber", "l_extendedprice", "l_quantity")  # noqa: E741
    p = spark.read.parquet(f"{sf_dir}/part.parquet").select(F.col("p_partkey").alias("l_partkey"), "p_brand")
    order = [F.col(c) for c in ("l_shipdate", "l_orderkey", "l_linenumber", "l_partkey")]
    return from_ticks(l.join(p, "l_partkey"), F.col("p_brand"), F.col("l_shipdate").cast("timestamp"), F.col("l_extendedprice") / F.col("l_quantity"), F.col("l_quantity"), order, "week")


def as_of(bars: DataFrame, moment: Column | datetime | str) -> DataFrame:
    """Rows known at the moment. The one home of the rule that nothing later is seen."""
    moment = moment if isinstance(moment, Column) else F.lit(moment).cast("timestamp")
    return bars.where(F.col("ts") <= moment)


def scan(bars: DataFrame, universe: list[str] | DataFrame | None, moment: str, lookback_days: int = 365, columns: list[str] | None = None) -> DataFrame:
    """Bars with moment - lookback < ts <= moment of the universe, with a year filter that prunes partitions.

    A table of symbols is joined as a semi join, a short list is a filter. An empty universe
    gives an empty frame with the columns. ts and symbol are always kept.
    """
    end = F.lit(moment).cast("timestamp")
    start = end - F.expr(f"INTERVAL {int(lookback_days)} DAYS")
    out = as_of(bars, end).where(F.col("ts") > start)
    if "year" in bars.columns:
        out = out.where(F.col("year").between(F.year(start), F.year(end)))
    if isinstance(universe, DataFrame):
        out = out.join(universe.select("symbol").distinct(), "symbol", "left_semi")
    elif universe is not None:
        out = out.where(F.col("symbol").isin(sorted(set(universe)))) if universe else out.where(F.lit(False))
    return out.select("ts", "symbol", *[c for c in columns or COLUMNS[2:] if c not in ("ts", "symbol")])


def canonical(df: DataFrame) -> DataFrame:
    return df.orderBy("ts", "symbol")


def upsert(old: DataFrame, new: DataFrame) -> DataFrame:
    """The union of both, the newer row winning for each (symbol, ts)."""
    both = old.select(*COLUMNS, F.lit(0).alias("seq")).unionByName(new.select(*COLUMNS, F.lit(1).alias("seq")))
    return both.groupBy("symbol", "ts").agg(*[F.max_by(c, "seq").alias(c) for c in COLUMNS[2:]]).select(*COLUMNS)


def write(bars: DataFrame, path: str, timeframe: str) -> None:
    """Writes all years of the given symbols under path/timeframe=../year=..; each touched partition is replaced as a whole."""
    rows = bars.select(*COLUMNS).withColumn("timeframe", F.lit(timeframe)).withColumn("year", F.year("ts"))
    rows.repartition("timeframe", "year").sortWithinPartitions("symbol", "ts").write.mode("overwrite").option("partitionOverwriteMode", "dynamic").partitionBy("timeframe", "year").parquet(path)


def replace_symbols(stored: DataFrame, bars: DataFrame) -> DataFrame:
    """stored without the symbols of bars, and bars: what write() is given when symbols are replaced."""
    return stored.join(bars.select("symbol").distinct(), "symbol", "left_anti").select(*COLUMNS).unionByName(bars.select(*COLUMNS))


def without_symbols(stored: DataFrame, symbols: DataFrame) -> DataFrame:
    return stored.join(symbols.select("symbol").distinct(), "symbol", "left_anti")


def sql(bars: DataFrame, query: str, args: list | None = None, view: str = "bars") -> DataFrame:
    """Runs SQL over the bars under a view name, with positional parameters."""
    bars.createOrReplaceTempView(view)
    return bars.sparkSession.sql(query, args=args)


def to_utc(ts: Column, zone: str = "America/New_York") -> Column:
    """A wall-clock time of the zone as an instant of a UTC session."""
    return F.to_utc_timestamp(ts, zone)


def shift_days(ts: Column, days: int, zone: str = "America/New_York") -> Column:
    """The instant `days` calendar days later on the zone's clock, across daylight-saving changes."""
    return F.to_utc_timestamp(F.from_utc_timestamp(ts, zone) + F.expr(f"INTERVAL {int(days)} DAYS"), zone)


def market_instant(text: Column, zone: str = "America/New_York") -> Column:
    """The instant of a date or ISO time in a UTC session: without an offset it is on the zone's clock, a bare date its midnight; null where it cannot be read."""
    read = F.try_to_timestamp(text)
    return F.when(text.rlike(r"[T ]\d{2}.*(Z|[+-]\d{2}:?\d{2})$"), read).otherwise(F.to_utc_timestamp(read, zone))
