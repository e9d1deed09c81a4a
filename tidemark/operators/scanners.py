"""Scanners, scorers and the probes that hold them to their clock."""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from ..functions.scalars import ratio
from ..sources.bars import as_of
from .timeseries import latest, sma

#: The recent dollar volume that a name must keep, as a share of its longer mean.
HOLDING_UP = 0.75


def liquidity_scan(bars: DataFrame, *, lookback: int = 20, least: float = 5e6) -> DataFrame:
    """bars with avg_dollar_volume, liquidity_trend, signal (BUY or empty) and strength, in multiples of the floor; 0 until the lookback is full."""
    dollars = F.col("close") * F.col("volume")
    wide, recent = sma(dollars, lookback), sma(dollars, max(3, lookback // 4))
    rows = bars.withColumn("avg_dollar_volume", wide).withColumn("liquidity_trend", ratio(recent, wide))
    good = F.coalesce((F.col("avg_dollar_volume") >= least) & (F.col("liquidity_trend") >= HOLDING_UP), F.lit(False))
    return rows.withColumn("signal", F.when(good, "BUY").otherwise("")).withColumn("strength", F.when(good, F.col("avg_dollar_volume") / least).otherwise(0.0))


def resolved_universe(flagged: DataFrame, candidates: DataFrame) -> DataFrame:
    """The flagged symbols among the candidates, or all candidates if there are none."""
    named = candidates.select("symbol").distinct()
    kept = named.join(flagged.select("symbol").distinct().withColumn("__hit", F.lit(1)), "symbol", "left")
    # One row, so the join only tells each candidate whether anything was flagged.
    some = kept.agg(F.count("__hit").alias("__n"))
    return kept.join(F.broadcast(some)).where((F.col("__n") == 0) | F.col("__hit").isNotNull()).select("symbol")


def last_score(scored: DataFrame, score: str) -> DataFrame:
    """symbol, score of its last bar; 0 without a value."""
    return latest(scored.select("ts", "symbol", score)).select("symbol", F.coalesce(F.nanvl(F.col(score).cast("double"), F.lit(None)), F.lit(0.0)).alias("score"))


def direction(signal: Column) -> Column:
    """1 for BUY, -1 for SELL, 0 for all else."""
    return F.coalesce(F.when(signal == "BUY", 1.0).when(signal == "SELL", -1.0), F.lit(0.0))


def signal_score(signals: DataFrame) -> DataFrame:
    """(ts, symbol, signal) -> symbol, score: the direction of the last bar."""
    return latest(signals.select("ts", "symbol", "signal")).select("symbol", direction(F.col("signal")).alias("score"))


def scanner_score(scanned: DataFrame) -> DataFrame:
    """(ts, symbol, signal, strength) -> symbol, score: the last bar's strength with the sign of its signal."""
    return latest(scanned.select("ts", "symbol", "signal", "strength")).select("symbol", (F.coalesce("strength", F.lit(0.0)) * direction(F.col("signal"))).alias("score"))


def clock_probe(scan: Callable[[DataFrame], DataFrame], bars: DataFrame, moment: str) -> DataFrame:
    """One row: what scan returns as of a moment from all bars and from those up to it: n_full, n_cut, n_changed, passed (null if both are empty).

    scan takes bars and returns its rows up to the moment. Rows are compared as multisets, so any operator can be probed.
    """
    full, cut = scan(bars), scan(as_of(bars, moment))
    sizes = full.select(F.lit("full").alias("part")).unionAll(cut.select(F.lit("cut"))).unionAll(full.exceptAll(cut).select(F.lit("changed"))).unionAll(cut.exceptAll(full).select(F.lit("changed")))
    count = lambda part: F.count_if(F.col("part") == part)
    out = sizes.agg(count("full").alias("n_full"), count("cut").alias("n_cut"), count("changed").alias("n_changed"))
    return out.withColumn("passed", F.when(F.col("n_full") + F.col("n_cut") > 0, F.col("n_changed") == 0))


def shift_probe(trade: Callable[[DataFrame], DataFrame], bars: DataFrame, n: int = 5, digits: int = 9) -> DataFrame:
    """One row: base_trades, shifted_trades, passed: whether the trades' pnl changes if every bar carries the values of n bars later.

    A rule that reads the future by itself does not notice. Without any trade it passes.
    """
    from .timeseries import by

    values = [c for c in ("open", "high", "low", "close", "volume") if c in bars.columns]
    shifted = bars.withColumns({c: F.lead(c, n).over(by()) for c in values}).dropna(subset=values)
    pnl = lambda b: trade(b).select(F.round("pnl_pct", digits).alias("pnl"))
    base, moved = pnl(bars), pnl(shifted)
    parts = base.select(F.lit("base").alias("part")).unionAll(moved.select(F.lit("moved"))).unionAll(base.exceptAll(moved).select(F.lit("changed"))).unionAll(moved.exceptAll(base).select(F.lit("changed")))
    count = lambda part: F.count_if(F.col("part") == part)
    return parts.agg(count("base").alias("base_trades"), count("moved").alias("shifted_trades"), count("changed").alias("changed")).select("base_trades", "shifted_trades", ((F.col("changed") > 0) | (F.col("base_trades") + F.col("shifted_trades") == 0)).alias("passed"))
