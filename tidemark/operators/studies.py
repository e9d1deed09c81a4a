"""Liquidity inputs, breadth, exposures, rebalance dates, return panels and checks of open positions."""

from __future__ import annotations

import math

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from ..functions.scalars import is_flat, ratio
from .timeseries import by, ema, simple_return
from .xsection import winsorize

#: Effective spread as a share of the trading range, its least share of the default, and its most.
RANGE_SHARE, LEAST_SHARE, MOST_SPREAD = 0.1, 0.2, 0.02


def gap_score(close: Column, fast: int, slow: int) -> Column:
    """Distance of the fast exponential mean from the slow one, as a share of the slow."""
    return ratio(ema(close, fast) - ema(close, slow), ema(close, slow))


def liquidity_inputs(bars: DataFrame, *, default_spread: float = 0.0005, window: int = 20) -> DataFrame:
    """symbol, spread, adv_dollar, daily_vol from the last `window` bars of each symbol.

    The spread is a share of the median range, within bounds; the default without one. Symbols
    with one bar have no row; the volatility is 0 where it cannot be measured.
    """
    back = Window.partitionBy("symbol").orderBy(F.col("ts").desc())
    rows = bars.withColumn("ret", simple_return(F.col("close"))).withColumn("back", F.row_number().over(back)).withColumn("n", F.count("*").over(Window.partitionBy("symbol")))
    recent = rows.where((F.col("back") <= window) & (F.col("n") >= 2))
    spread = F.median(ratio(F.col("high") - F.col("low"), F.col("close"))) * RANGE_SHARE
    return recent.groupBy("symbol").agg(
        F.coalesce(F.least(F.greatest(spread, F.lit(LEAST_SHARE * default_spread)), F.lit(MOST_SPREAD)), F.lit(default_spread)).alias("spread"),
        (F.max_by("close", "ts") * F.avg("volume")).alias("adv_dollar"),
        F.coalesce(F.stddev_samp("ret"), F.lit(0.0)).alias("daily_vol"),
    )


def residual_correlation(pairs: DataFrame, *, min_overlap: int = 20, least_share: float = 0.5) -> DataFrame:
    """(ts, symbol, ret, bench) -> names, pairs, rho: the mean correlation of what the benchmark leaves of each pair of names.

    A name's beta comes from its own overlap with the benchmark, a pair's correlation from the
    ts both have; under min_overlap neither counts. rho is null if fewer than least_share of all
    pairs count. Pairs are of names, so the join is per ts and grows with the square of the names
    traded at one ts, not with the rows.
    """
    both = pairs.where("ret is not null and bench is not null")
    fit = both.groupBy("symbol").agg(F.count("*").alias("k"), F.when(F.var_samp("bench") > 0, F.covar_samp("ret", "bench") / F.var_samp("bench")).alias("beta")).where((F.col("k") >= max(min_overlap, 3)) & F.col("beta").isNotNull())
    left = both.join(fit, "symbol").select("ts", "symbol", (F.col("ret") - F.col("beta") * F.col("bench")).alias("x"))
    a, b = left.select("ts", F.col("symbol").alias("i"), "x"), left.select("ts", F.col("symbol").alias("j"), F.col("x").alias("y"))
    flat = is_flat(F.stddev_samp("x"), F.avg(F.abs("x"))) | is_flat(F.stddev_samp("y"), F.avg(F.abs("y")))
    each = a.join(b, "ts").where("i < j").groupBy("i", "j").agg(F.count("*").alias("k"), F.when(~flat, F.corr("x", "y")).alias("c")).where((F.col("k") >= max(min_overlap, 3)) & F.col("c").isNotNull())
    names = pairs.agg(F.countDistinct("symbol").alias("names"))
    used = each.agg(F.count("*").alias("pairs"), F.avg("c").alias("mean"))
    total = F.col("names") * (F.col("names") - 1) / 2
    # Both sides are one row.
    return names.join(F.broadcast(used)).select("names", "pairs", F.when((F.col("pairs") > 0) & (F.col("pairs") >= least_share * total), F.col("mean")).alias("rho"))


def effective_breadth(names: Column, rebalances: Column, rho: Column) -> Column:
    """Independent bets a year among names of mean correlation rho; all of them where the discount is not positive."""
    discount = 1 + (names - 1) * rho
    return rebalances * names / F.when(discount > 0, discount).otherwise(1.0)


def case_scale(panel: DataFrame, score: str, vol: str) -> DataFrame:
    """(ts, symbol, score, vol) -> ts, scale: dispersion of the winsorised score over that of score / vol; null where either cannot be formed."""
    known = panel.where(F.col(score).isNotNull()).withColumn("g", winsorize(F.col(score)))
    of = F.when(F.col(vol) > 0, F.col("g") / F.col(vol))
    return known.groupBy("ts").agg(F.when((F.count("g") >= 2) & (F.stddev_pop(of) > 0), F.stddev_pop("g") / F.stddev_pop(of)).alias("scale"))


def factor_exposures(bars: DataFrame, betas: DataFrame, *, momentum: int = 126, skip: int = 21, vol: int = 60) -> DataFrame:
    """symbol, market, momentum, volatility, size at each symbol's last bar, standardised over symbols.

    betas: symbol, beta. Symbols with too few bars, or without one of the four, have no row; fewer
    than two symbols give none. A factor without dispersion is centred only.
    """
    back = Window.partitionBy("symbol").orderBy(F.col("ts").desc())
    rows = bars.withColumn("ret", simple_return(F.col("close"))).withColumn("k", F.row_number().over(back))
    at = lambda n: F.max(F.when(F.col("k") == n, F.col("close")))
    recent = F.col("k") <= vol
    raw = rows.where(F.col("k") <= max(momentum + skip + 1, vol + 1)).groupBy("symbol").agg(
        (ratio(at(1 + skip), at(1 + skip + momentum)) - 1).alias("momentum"),
        F.stddev_samp(F.when(recent, F.col("ret"))).alias("volatility"),
        F.ln(at(1) * F.avg(F.when(recent, F.col("volume")))).alias("size"),
        F.count("*").alias("n"),
    )
    full = raw.where(F.col("n") >= momentum + skip + 1).join(betas.select("symbol", F.col("beta").alias("market")), "symbol").dropna(subset=["market", "momentum", "volatility", "size"])
    names = ["market", "momentum", "volatility", "size"]
    moments = full.agg(F.count("*").alias("__n"), *[f(c).alias(f"__{k}_{c}") for c in names for k, f in (("m", F.avg), ("s", F.stddev_pop))])
    return full.join(F.broadcast(moments)).where("__n >= 2").select("symbol", *[((F.col(c) - F.col(f"__m_{c}")) / F.when(F.col(f"__s_{c}") > 0, F.col(f"__s_{c}")).otherwise(1.0)).alias(c) for c in names])


def rebalance_points(calendar: DataFrame, horizon: int, n_points: int, warm_up: int = 30) -> DataFrame:
    """(ts) -> k, ts: evenly spaced bars after the warm-up that leave `horizon` bars; none in a shorter calendar."""
    bars = calendar.select("ts").distinct().withColumn("k", F.row_number().over(Window.orderBy("ts")) - 1)
    last = bars.count() - horizon - 1
    n = min(n_points, last - warm_up)
    points = {warm_up + math.floor(i * (last - warm_up) / max(n - 1, 1)) for i in range(n)} if last > warm_up else set()
    return bars.where(F.col("k").isin(sorted(points)))


def returns_panel(series: DataFrame, min_overlap: int = 60) -> DataFrame:
    """(trial_id, ts, ret) -> ts, trial_id, ret at the ts that all used trials share.

    Used are those with min_overlap ts in common with the longest series (of equal ones the
    smallest id). With fewer common ts than min_overlap there are no rows.
    """
    longest = series.groupBy("trial_id").agg(F.count("*").alias("n")).orderBy(F.col("n").desc(), "trial_id").limit(1)
    reference = series.join(F.broadcast(longest.select("trial_id")), "trial_id").select("ts")
    used = series.join(reference, "ts", "left_semi").groupBy("trial_id").count().where(F.col("count") >= min_overlap).select("trial_id")
    rows = series.join(used, "trial_id", "left_semi")
    common = rows.groupBy("ts").agg(F.count("*").alias("k")).join(F.broadcast(used.agg(F.count("*").alias("all"))), F.col("k") == F.col("all")).select("ts")
    enough = common.agg(F.count("*").alias("m")).where(F.col("m") >= min_overlap)
    return rows.join(common, "ts", "left_semi").join(F.broadcast(enough)).select("ts", "trial_id", "ret")


def exit_flags(bars: DataFrame, positions: DataFrame) -> DataFrame:
    """bars beside exit_reason and signal of the open positions (symbol, side, stop_loss, take_profit); a take overrides a stop, bars without either hold."""
    long = F.col("side") == "BUY"
    sign = F.when(long, 1).when(F.col("side") == "SELL", -1)
    reason = F.when((F.col("close") - F.col("take_profit")) * sign >= 0, "TAKE_PROFIT").when((F.col("close") - F.col("stop_loss")) * sign <= 0, "STOP_LOSS").otherwise("")
    return bars.join(positions, "symbol").withColumn("exit_reason", reason).withColumn("signal", F.when(F.col("exit_reason") == "", "HOLD").otherwise(F.concat(F.lit("CLOSE_"), F.col("side"))))


def valid_signals(signals: DataFrame, positions: DataFrame) -> DataFrame:
    """signals (symbol, signal, ...) with valid: an exit needs the position it closes, an entry none of its own side."""
    held = positions.select("symbol", F.col("side").alias("__side"))
    closes = F.col("signal").startswith("CLOSE_")
    right = F.when(closes, F.coalesce(F.concat(F.lit("CLOSE_"), F.col("__side")) == F.col("signal"), F.lit(False))).otherwise(F.coalesce(F.col("__side") != F.col("signal"), F.lit(True)))
    return signals.join(held, "symbol", "left").withColumn("valid", right).drop("__side")


def fill_gaps(orders: DataFrame, keys: list[str]) -> DataFrame:
    """keys, requested, filled (notional), outcome (filled, rounded, too_small) -> drag_pct, unfillable_pct; zeros where nothing was asked for."""
    asked, got = F.sum("requested"), F.sum("filled")
    lost = F.count_if(F.col("outcome").isin("rounded", "too_small"))
    return orders.groupBy(*keys).agg(F.count("*").alias("n"), F.coalesce(F.when(asked > 0, (1 - ratio(got, asked)) * 100), F.lit(0.0)).alias("drag_pct"), (lost / F.count("*") * 100).alias("unfillable_pct"))
