"""Which bars have been fetched: interval tables (symbol, start, end, fetched_at)."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F


def merged(fetches: DataFrame, keys: tuple[str, ...] = ("symbol",)) -> DataFrame:
    """Overlapping and touching intervals of a key as one: keys, start, end."""
    w = Window.partitionBy(*keys).orderBy("start", "end")
    reach = F.max("end").over(w.rowsBetween(Window.unboundedPreceding, -1))
    marked = fetches.select(*keys, "start", "end", F.when(reach.isNull() | (F.col("start") > reach), 1).otherwise(0).alias("opens"))
    numbered = marked.withColumn("island", F.sum("opens").over(w.rowsBetween(Window.unboundedPreceding, 0)))
    return numbered.groupBy(*keys, "island").agg(F.min("start").alias("start"), F.max("end").alias("end")).drop("island")


def gaps(fetches: DataFrame, requests: DataFrame) -> DataFrame:
    """What the requests (symbol, start, end) ask for and no fetch covers: symbol, gap_start, gap_end."""
    islands = merged(fetches).select("symbol", F.col("start").alias("s"), F.col("end").alias("e"))
    asked = requests.select("symbol", F.col("start").alias("a"), F.col("end").alias("d"))
    near = asked.join(islands, ["symbol"], "left").where(F.col("s").isNull() | ((F.col("e") >= F.col("a")) & (F.col("s") <= F.col("d"))))
    far = asked.join(near.select("symbol", "a", "d").distinct(), ["symbol", "a", "d"], "left_anti").select("symbol", "a", "d", F.lit(None).cast("timestamp").alias("s"), F.lit(None).cast("timestamp").alias("e"))
    w = Window.partitionBy("symbol", "a", "d").orderBy("s")
    pieces = near.select("symbol", "a", "d", "s", "e").unionByName(far).withColumn("next", F.lead("s").over(w)).withColumn("first", F.row_number().over(w) == 1)
    piece = lambda x, y: F.struct(x.alias("gap_start"), y.alias("gap_end"))
    return (
        pieces.withColumn(
            "g",
            F.explode(
                F.array(
                    F.when(F.col("first"), piece(F.col("a"), F.coalesce(F.least("s", "d"), F.col("d")))),
                    F.when(F.col("e").isNotNull(), piece(F.greatest("e", "a"), F.coalesce(F.least("next", "d"), F.col("d")))),
                )
            ),
        )
        .where("g.gap_start < g.gap_end")
        .select("symbol", "g.gap_start", "g.gap_end")
    )


def vintage(fetches: DataFrame, start: Column, end: Column) -> DataFrame:
    """Latest fetch time of what overlaps (start, end) strictly, by symbol."""
    return fetches.where((F.col("end") > start) & (F.col("start") < end)).groupBy("symbol").agg(F.max("fetched_at").alias("vintage"))


def rebuilt(bars: DataFrame) -> DataFrame:
    """One interval for each stored symbol."""
    return bars.groupBy("symbol").agg(F.min("ts").alias("start"), F.max("ts").alias("end"))


def status(fetches: DataFrame, bars: DataFrame) -> DataFrame:
    """By symbol: first start, last end, last fetch, and whether no bar is stored (drift)."""
    seen = fetches.groupBy("symbol").agg(F.min("start").alias("start"), F.max("end").alias("end"), F.max("fetched_at").alias("fetched_at"))
    stored = bars.select("symbol", F.lit(True).alias("stored")).distinct()
    return seen.join(stored, "symbol", "left").select("symbol", "start", "end", "fetched_at", F.col("stored").isNull().alias("drift"))


def missing(fetches: DataFrame, requests: DataFrame) -> DataFrame:
    """The hull of all gaps of a symbol over its requests."""
    return gaps(fetches, requests).groupBy("symbol").agg(F.min("gap_start").alias("start"), F.max("gap_end").alias("end"), F.count("*").alias("n_gaps"))


def missing_windows(fetches: DataFrame, requests: DataFrame, zone: str = "America/New_York") -> DataFrame:
    """timeframe, symbol, start, end of each stretch that several requests (timeframe, symbol, start, end) lack together.

    first_date and last_date are the zone's dates that one fetch of the timeframe has to name to
    cover all of its stretches: a date is its midnight, so an end later in a day takes the next.
    Nothing lacking: no rows.
    """
    key = F.struct("timeframe", "symbol").alias("symbol")
    found = gaps(fetches.select(key, "start", "end"), requests.select(key, "start", "end").distinct())
    each = merged(found.select("symbol", F.col("gap_start").alias("start"), F.col("gap_end").alias("end"))).select("symbol.timeframe", "symbol.symbol", "start", "end")
    wall = lambda c: F.from_utc_timestamp(c, zone)
    last = wall(F.max("end"))
    dates = each.groupBy("timeframe").agg(F.to_date(wall(F.min("start"))).alias("first_date"), F.date_add(F.to_date(last), F.when(last == F.date_trunc("day", last), 0).otherwise(1)).alias("last_date"))
    return each.join(dates, "timeframe").select("timeframe", "symbol", "start", "end", F.col("first_date").cast("string").alias("first_date"), F.col("last_date").cast("string").alias("last_date"))


def record_fetch(fetches: DataFrame, done: DataFrame) -> DataFrame:
    """fetches with the intervals just fetched (symbol, start, end, fetched_at), whether or not they brought a bar."""
    return fetches.unionByName(done.select(*fetches.columns))


def forget(fetches: DataFrame, symbols: DataFrame) -> DataFrame:
    return fetches.join(symbols.select("symbol").distinct(), "symbol", "left_anti")


def clipped(incoming: DataFrame, wanted: DataFrame) -> DataFrame:
    """The incoming bars that lie in a gap (symbol, gap_start, gap_end), both ends included, each once."""
    g = wanted.select("symbol", "gap_start", "gap_end")
    return incoming.join(g, (incoming.symbol == g.symbol) & (F.col("ts") >= F.col("gap_start")) & (F.col("ts") <= F.col("gap_end")), "left_semi")


def warm_summary(fetches: DataFrame, requests: DataFrame) -> DataFrame:
    """symbol, already_cached, gaps_to_fetch of each symbol that the requests name."""
    found = gaps(fetches, requests).groupBy("symbol").agg(F.count("*").alias("n"))
    return requests.select("symbol").distinct().join(found, "symbol", "left").select("symbol", F.col("n").isNull().alias("already_cached"), F.coalesce("n", F.lit(0)).alias("gaps_to_fetch"))


def refresh_windows(fetches: DataFrame, requests: DataFrame) -> DataFrame:
    """(symbol, start, end; a null bound takes that of the symbol's coverage) -> symbol, refreshed, start, end; not refreshed if a bound is still unknown."""
    known = fetches.groupBy("symbol").agg(F.min("start").alias("__s"), F.max("end").alias("__e"))
    both = requests.join(known, "symbol", "left").select("symbol", F.coalesce("start", "__s").alias("start"), F.coalesce("end", "__e").alias("end"))
    return both.select("symbol", (F.col("start").isNotNull() & F.col("end").isNotNull()).alias("refreshed"), "start", "end")
