"""Trades on both sides from signals: round trips, exits at stops and targets, records of profit; and two scores that signals come from."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from ..functions.scalars import ratio, round_tick
from .timeseries import by, full, last, rolling_std, sma
from .trades import during

TRADE = ("symbol", "side", "entry_time", "entry_price", "reference", "exit_time", "exit_price", "exit_reason")


def breakout_score(n: int, trend: int) -> Column:
    """How far a close is above the highest high of the n bars before it, where it is also above its mean of `trend` bars; else -1."""
    if n >= trend:
        raise ValueError(f"the entry period, {n}, must be shorter than the trend period, {trend}")
    before = by().rowsBetween(-n, -1)
    top = F.when(F.count("high").over(before) == n, F.max("high").over(before))
    close = F.col("close")
    return F.coalesce(F.when((close > top) & (close > sma(close, trend)), ratio(close - top, top)), F.lit(-1.0))


def reversion_score(n: int, band: float) -> Column:
    """The negative distance of a close from its mean of n bars, in their standard deviations (of n values, not n - 1); 0 within the band, before n bars and without dispersion."""
    close = F.col("close")
    z = ratio(close - full(F.avg(close).over(last(n)), close, n), rolling_std(close, n, population=True))
    return F.coalesce(F.when(F.abs(z) >= band, -z), F.lit(0.0))


def round_trips(bars: DataFrame) -> DataFrame:
    """(ts, symbol, open, close, signal) -> TRADE columns; side is BUY or SELL.

    A bar's signal acts at the next open: BUY and SELL open a side and end the other at the same
    price, CLOSE_BUY and CLOSE_SELL end theirs, all else (null too) holds. What is held at the end
    leaves at the last close. reference is the close that the decision was made on.

    The side held is that of the last BUY or SELL unless its closing signal came since, so it
    needs running windows only, and trades are the changes of it.
    """
    w = by()
    opens = F.when(F.col("act") == "BUY", 1).when(F.col("act") == "SELL", -1)
    acted = bars.select("symbol", "ts", "open", "close", F.lag("signal").over(w).alias("act"), F.lag("close").over(w).alias("reference")).withColumn("entries", F.count(opens).over(w)).withColumn("side", F.last(opens, ignorenulls=True).over(w.rowsBetween(Window.unboundedPreceding, 0)))
    ends = ((F.col("side") == 1) & (F.col("act") == "CLOSE_BUY")) | ((F.col("side") == -1) & (F.col("act") == "CLOSE_SELL"))
    within = Window.partitionBy("symbol", "entries").orderBy("ts").rowsBetween(Window.unboundedPreceding, 0)
    held = acted.withColumn("held", F.when(F.max(F.coalesce(ends, F.lit(False))).over(within), 0).otherwise(F.coalesce("side", F.lit(0))))
    whole = w.rowsBetween(Window.unboundedPreceding, Window.unboundedFollowing)
    moved = held.withColumns({"was": F.coalesce(F.lag("held").over(w), F.lit(0)), "last_ts": F.last("ts").over(whole), "last_close": F.last("close").over(whole)}).where("held <> was")
    over = F.lead("ts").over(w)
    return moved.select(
        "symbol", "held", F.when(F.col("held") == 1, "BUY").otherwise("SELL").alias("side"), F.col("ts").alias("entry_time"), F.col("open").alias("entry_price"), "reference",
        F.coalesce(over, "last_ts").alias("exit_time"), F.when(over.isNull(), F.col("last_close")).otherwise(F.lead("open").over(w)).alias("exit_price"), F.when(over.isNull(), "END_OF_PERIOD").otherwise("SIGNAL").alias("exit_reason"),
    ).where("held <> 0").select(*TRADE)


def bracket_exits(trades: DataFrame, bars: DataFrame, *, stop: float, take: float, margin_bps: float = 0.0, every: str = "month") -> DataFrame:
    """The TRADE columns, with the exit at a stop or target where one came before the trade's own.

    Levels are shares of the reference, rounded to the tick; a target counts as reached margin_bps
    beyond it. On each bar from the entry on: an open beyond a level fills at the open, the stop's
    first; then the trade's own signal; then a level that the bar traded through fills at the
    level, the stop's first, a target at no worse than the open. So the bar of a signal only knows
    its open.
    """
    d = F.when(F.col("side") == "BUY", 1.0).otherwise(-1.0)
    levels = trades.select(*TRADE, d.alias("d"), round_tick(F.col("reference") * (1 - d * stop)).alias("stop"), round_tick(F.col("reference") * (1 + d * take)).alias("take"))
    held = during(levels, bars.select("symbol", "ts", "open", "high", "low"), "symbol", ["open", "high", "low"], every)
    d, opened, level, target = F.col("d"), F.col("d") * F.col("open"), F.col("d") * F.col("stop"), F.col("d") * F.col("take")
    trigger = d * F.col("take") * (1 + d * margin_bps / 1e4)
    worst, best = F.when(d > 0, F.col("low")).otherwise(-F.col("high")), F.when(d > 0, F.col("high")).otherwise(-F.col("low"))
    within = ~((F.col("exit_reason") == "SIGNAL") & (F.col("ts") == F.col("exit_time")))
    found = lambda reason, price: F.struct("ts", F.lit(reason).alias("reason"), price.alias("price"))
    hit = (
        F.when(opened <= level, found("STOP_LOSS", F.col("open")))
        .when(opened >= trigger, found("TAKE_PROFIT", F.col("open")))
        .when(within & (worst <= level), found("STOP_LOSS", F.col("stop")))
        .when(within & (best >= trigger), found("TAKE_PROFIT", d * F.greatest(opened, target)))
    )
    first = held.groupBy(*TRADE).agg(F.min(hit).alias("hit"))
    changed = {"exit_time": "ts", "exit_price": "price", "exit_reason": "reason"}
    return first.select(*[F.coalesce(F.col(f"hit.{changed[c]}"), F.col(c)).alias(c) if c in changed else F.col(c) for c in TRADE])


def trade_records(trades: DataFrame, bars: DataFrame, every: str = "month") -> DataFrame:
    """TRADE columns, size, entry_cost, exit_cost -> with gross_pnl, cost, pnl, mae_pct and mfe_pct.

    The excursions are percent of the entry price over the lows and highs of all bars from entry
    to exit, floored at 0; a short trade's adverse one is of the highs. A missing cost is 0.
    """
    keys = [*TRADE, "size", "entry_cost", "exit_cost"]
    seen = during(trades.select(*keys), bars.select("symbol", "ts", "high", "low"), "symbol", ["high", "low"], every)
    low, high, entry = F.least("l", "entry_price"), F.greatest("h", "entry_price"), F.col("entry_price")
    down, up = F.greatest(100 * ratio(entry - low, entry), F.lit(0.0)), F.greatest(100 * ratio(high - entry, entry), F.lit(0.0))
    long = F.col("side") == "BUY"
    cost = F.coalesce("entry_cost", F.lit(0.0)) + F.coalesce("exit_cost", F.lit(0.0))
    gross = (F.col("exit_price") - entry) * F.col("size") * F.when(long, 1).otherwise(-1)
    return seen.groupBy(*keys).agg(F.min("low").alias("l"), F.max("high").alias("h")).select(
        *TRADE, "size", gross.alias("gross_pnl"), cost.alias("cost"), (gross - cost).alias("pnl"), F.when(long, down).otherwise(up).alias("mae_pct"), F.when(long, up).otherwise(down).alias("mfe_pct")
    )
