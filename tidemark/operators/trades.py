"""Trades: extraction from signals, barriers, analytics."""

from __future__ import annotations

from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from ..functions.scalars import ratio


def from_signals(bars: DataFrame) -> DataFrame:
    """(ts, symbol, open, close, held) -> long trades: symbol, entry_time, entry_price, exit_time, exit_price, exit_reason, pnl_pct.

    held (0 or 1) is decided on a bar's close and acted on at the next open; a position still
    held at the end leaves at the last close.
    """
    w = Window.partitionBy("symbol").orderBy("ts")
    acted = bars.withColumn("on", F.coalesce(F.lag("held").over(w), F.lit(0))).withColumn("was", F.coalesce(F.lag("on").over(w), F.lit(0)))
    last = F.lead("ts").over(w).isNull()
    events = acted.select("symbol", "ts", "open", "close", "on", "was", last.alias("last"), F.sum(F.when((F.col("on") == 1) & (F.col("was") == 0), 1).otherwise(0)).over(w).alias("k"))
    held = events.where((F.col("on") == 1) | (F.col("was") == 1))
    return (
        held.groupBy("symbol", "k")
        .agg(
            F.min("ts").alias("entry_time"),
            F.min_by("open", "ts").alias("entry_price"),
            F.max("ts").alias("exit_time"),
            F.max_by(F.when(F.col("on") == 0, F.col("open")).otherwise(F.col("close")), "ts").alias("exit_price"),
            F.max_by(F.when(F.col("on") == 0, F.lit("SIGNAL")).otherwise(F.lit("END_OF_PERIOD")), "ts").alias("exit_reason"),
        )
        .drop("k")
        .withColumn("pnl_pct", ratio(F.col("exit_price"), F.col("entry_price")) - 1)
    )


def during(trades: DataFrame, bars: DataFrame, key: str, columns: list[str], every: str = "month") -> DataFrame:
    """trades beside the bars (ts and `columns`) of their key from entry_time to exit_time, both included.

    Trades and bars meet in calendar pieces of a key, so a trade is only held against the pieces
    it spans, and one key is many groups.
    """
    piece = F.explode(F.sequence(F.date_trunc(every, "entry_time"), F.date_trunc(every, "exit_time"), F.expr(f"interval 1 {every}"))).alias("__piece")
    cut = bars.select(key, "ts", *columns, F.date_trunc(every, "ts").alias("__piece"))
    return trades.select("*", piece).join(cut, [key, "__piece"]).where((F.col("ts") >= F.col("entry_time")) & (F.col("ts") <= F.col("exit_time"))).drop("__piece")


def barrier_exits(trades: DataFrame, bars: DataFrame, *, stop: float, take: float) -> DataFrame:
    """The first bar of a trade that crosses its stop or its target: symbol, entry_time, hit_time, reason, price.

    Inside one bar the stop comes first; a gap fills at the open.
    """
    t = trades.select("symbol", "entry_time", "exit_time", (F.col("entry_price") * (1 - stop)).alias("s"), (F.col("entry_price") * (1 + take)).alias("t"))
    inside = during(t, bars, "symbol", ["open", "high", "low"]).where(F.col("ts") < F.col("exit_time"))
    hit = inside.withColumn("reason", F.when(F.col("low") <= F.col("s"), "STOP_LOSS").when(F.col("high") >= F.col("t"), "TAKE_PROFIT")).where("reason is not null")
    price = F.when(F.col("reason") == "STOP_LOSS", F.least("s", "open")).otherwise(F.greatest("t", "open"))
    return hit.groupBy("symbol", "entry_time").agg(F.min("ts").alias("hit_time"), F.min_by("reason", "ts").alias("reason"), F.min_by(price, "ts").alias("price"))


def excursions(trades: DataFrame, bars: DataFrame) -> DataFrame:
    """Worst and best move of each trade while held, percent of entry, floored at 0: symbol, entry_time, mae_pct, mfe_pct."""
    inside = during(trades, bars, "symbol", ["high", "low"])
    return inside.groupBy("symbol", "entry_time", "entry_price").agg(F.min("low").alias("l"), F.max("high").alias("h")).select(
        "symbol", "entry_time",
        F.greatest(100 * (1 - ratio(F.col("l"), F.col("entry_price"))), F.lit(0.0)).alias("mae_pct"),
        F.greatest(100 * (ratio(F.col("h"), F.col("entry_price")) - 1), F.lit(0.0)).alias("mfe_pct"),
    )


def by_exit_reason(trades: DataFrame) -> DataFrame:
    """Count, share, pnl and mean holding days of each exit reason."""
    everything = Window.partitionBy()
    return trades.groupBy("exit_reason").agg(
        F.count("*").alias("n"), F.sum("pnl").alias("pnl"), F.avg((F.col("pnl") > 0).cast("double")).alias("win_rate"), F.avg("days").alias("avg_days"), F.median("days").alias("median_days"),
    ).withColumn("share", F.col("n") / F.sum("n").over(everything))


def legs(trades: DataFrame) -> DataFrame:
    """Long and short side by side."""
    return trades.groupBy("side").agg(F.count("*").alias("n"), F.sum("pnl").alias("pnl"), F.sum("cost").alias("cost"), F.avg("pnl").alias("avg_pnl"), F.stddev_samp("pnl").alias("pnl_std"))
