"""Summaries over bars, scores, weights and equity: scanners, decay, regimes, capacity, exposure, excursion."""

from __future__ import annotations

import math

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from ..functions.scalars import ratio
from .timeseries import by, last, sma


def bar_summary(bars: DataFrame) -> DataFrame:
    """One row a symbol: bars, last close, period return, volatility of returns, trend of means, worst drawdown, volumes, range."""
    close = F.col("close")
    rows = bars.withColumns({"ret": ratio(close, F.lag(close).over(by())) - 1, "m10": sma(close, 10), "m30": sma(close, 30), "dd": ratio(close, F.max(close).over(by().rowsBetween(Window.unboundedPreceding, 0))) - 1, "v5": F.avg("volume").over(last(5))})
    return rows.groupBy("symbol").agg(
        F.count("*").alias("n"), F.max_by("close", "ts").alias("last_close"), (ratio(F.max_by("close", "ts"), F.min_by("close", "ts")) - 1).alias("period_return"), F.stddev_samp("ret").alias("volatility"),
        F.max_by(F.when(F.col("m10") > F.col("m30"), "up").when(F.col("m10") < F.col("m30"), "down").otherwise("flat"), "ts").alias("trend"), F.min("dd").alias("max_drawdown"), F.avg("volume").alias("avg_volume"),
        ratio(F.max_by("v5", "ts"), F.avg("volume")).alias("recent_volume"), F.max("high").alias("high"), F.min("low").alias("low"),
    )


def volume_scan(bars: DataFrame, *, n: int = 20, times: float = 1.5, move: float = 0.01, least: float = 1.0) -> DataFrame:
    """bars with `signal` (BUY, SELL, HOLD) and `strength`: a volume spike over the mean of n bars with an intrabar move."""
    mean, step = sma(F.col("volume"), n), ratio(F.col("close") - F.col("open"), F.col("open"))
    rows = bars.withColumns({"ratio": ratio(F.col("volume"), mean), "step": step})
    hit = (F.col("ratio") > times) & (F.abs("step") > move) & (F.col("volume") >= least)
    return rows.withColumn("signal", F.when(hit & (F.col("step") > 0), "BUY").when(hit, "SELL").otherwise("HOLD")).withColumn("strength", F.when(hit, F.least(F.col("ratio") / times / 2, F.lit(1.0))).otherwise(0.0))


def forward_evaluation(signals: DataFrame, hold: int) -> DataFrame:
    """Per signal: count, hit rate and mean percent of the close `hold` bars later, or of the last close if the series ends before."""
    w = by()
    later = F.coalesce(F.lead("close", hold).over(w), F.last("close").over(w.rowsBetween(Window.currentRow, hold)))
    sign = F.when(F.col("signal") == "SELL", -1.0).otherwise(1.0)
    moved = signals.withColumn("move", F.when(F.lead("close").over(w).isNotNull(), sign * (ratio(later, F.col("close")) - 1))).where("signal <> 'HOLD' and move is not null")
    return moved.groupBy("signal").agg(F.count("*").alias("n"), F.avg((F.col("move") > 0).cast("double")).alias("hit_rate"), F.avg(100 * F.col("move")).alias("avg_pct"))


def ic_by_lag(scores: DataFrame, lags: int) -> DataFrame:
    """(ts, symbol, score, ret) -> lag, n, mean IC with the one-bar return `lag` bars ahead: all lags in one pass."""
    ahead = F.array(*[F.struct(F.lit(k).alias("lag"), F.lead("ret", k).over(by()).alias("fwd")) for k in range(1, lags + 1)])
    rows = scores.withColumn("a", ahead).select("ts", "score", F.explode("a").alias("a")).select("ts", "score", "a.lag", "a.fwd").where("score is not null and fwd is not null")
    spread = F.stddev_pop("score") * F.stddev_pop("fwd")
    per = rows.groupBy("lag", "ts").agg(F.when(spread > 1e-18, F.covar_pop("score", "fwd") / spread).alias("ic"))
    return per.groupBy("lag").agg(F.count("ic").alias("n"), F.avg("ic").alias("mean_ic"))


def decay_fit(profile: DataFrame) -> DataFrame:
    """Exponential decay over the lags with a positive IC: rate, half-life (null unless decaying) and level."""
    slope, cut = F.regr_slope(F.ln("mean_ic"), F.col("lag")), F.regr_intercept(F.ln("mean_ic"), F.col("lag"))
    return profile.where("mean_ic > 0").agg(F.count("*").alias("lags"), slope.alias("rate"), F.when(slope < 0, math.log(2) / -slope).alias("half_life"), F.exp(cut).alias("level"))


#: Fixed value: the horizon, in time constants of the decay, at which a decaying signal tells most about a return (where e**x = 1 + 2x).
PEAK = 1.2564312086


def horizon_fit(profile: DataFrame, z: float = 1.96) -> DataFrame:
    """(lag, mean_ic) -> one row: lags used, delta (kept a period), half_life, ic0, r_squared, the slope's standard error, the half-life at z errors to either side, peak_horizon.

    Fitted on the logarithm of the positive coefficients from lag 0 on; under two of them only
    r_squared, 0, is given. A profile that does not decay has an infinite half-life. Under three
    lags there is no error, and both bounds are the half-life. All from moments of one pass.
    """
    x, y = F.col("lag").cast("double"), F.ln("mean_ic")
    sums = profile.where("mean_ic > 0 and lag >= 0").agg(F.count("*").alias("n"), F.regr_slope(y, x).alias("b"), F.regr_intercept(y, x).alias("a"), F.regr_sxx(y, x).alias("sxx"), F.regr_syy(y, x).alias("syy"), F.regr_sxy(y, x).alias("sxy"))
    left = F.greatest(F.col("syy") - F.col("b") * F.col("sxy"), F.lit(0.0))
    some = F.col("n") >= 2
    error = F.when((F.col("n") > 2) & (F.col("sxx") > 0), F.sqrt(left / F.when(F.col("n") > 2, F.col("n") - 2) / F.when(F.col("sxx") > 0, F.col("sxx"))))
    life = lambda slope: F.when(slope < 0, -math.log(2) / slope).otherwise(float("inf"))
    b = F.col("b")
    only = lambda c: F.when(some, c)
    return sums.select(
        F.col("n").alias("lags"), only(F.exp(b)).alias("delta"), only(life(b)).alias("half_life"), only(F.exp("a")).alias("ic0"), F.when(some & (F.col("syy") > 0), 1 - left / F.when(F.col("syy") > 0, F.col("syy"))).otherwise(0.0).alias("r_squared"),
        error.alias("slope_error"), only(life(b - z * F.coalesce(error, F.lit(0.0)))).alias("half_life_lower"), only(life(b + z * F.coalesce(error, F.lit(0.0)))).alias("half_life_upper"), only(PEAK / math.log(2) * life(b)).alias("peak_horizon"),
    )


def cadence_curve(profile: DataFrame) -> DataFrame:
    """(lag, mean_ic) -> lag, ir (the coefficient over the root of the lag) for lags of 1 and more, and whether it is the recommended cadence: the least lag of the highest ir."""
    rows = profile.where("lag >= 1").select("lag", (F.col("mean_ic") / F.sqrt(F.col("lag").cast("double"))).alias("ir"))
    best = rows.agg(F.min_by("lag", F.struct(-F.col("ir"), F.col("lag"))).alias("best"))
    return rows.join(F.broadcast(best)).select("lag", "ir", (F.col("lag") == F.col("best")).alias("recommended"))


def blend_weights(gamma: Column, rho: Column) -> tuple[Column, Column]:
    """Weights on a signal and its lagged copy that give the best coefficient, for a decay gamma and an autocorrelation rho; (1, 0) where they cannot be told apart."""
    total = (1 - gamma * rho) + (gamma - rho)
    now = F.when(F.abs(total) < 1e-12, 1.0).otherwise((1 - gamma * rho) / F.when(F.abs(total) >= 1e-12, total))
    return now, 1 - now


def forecast_quality(pairs: DataFrame) -> DataFrame:
    """(symbol, realized, forecast) variances -> Mincer-Zarnowitz intercept, slope, r2 and mean QLIKE over positive pairs."""
    good = pairs.where("realized > 0 and forecast > 0")
    x = F.col("realized") / F.col("forecast")
    return good.groupBy("symbol").agg(F.count("*").alias("n"), F.regr_intercept("realized", "forecast").alias("a"), F.regr_slope("realized", "forecast").alias("b"), F.regr_r2("realized", "forecast").alias("r2"), F.avg(x - F.ln(x) - 1).alias("qlike"))


def regimes(series: DataFrame, by_col: str, value: str, labels: tuple[str, ...] = ("low", "mid", "high")) -> DataFrame:
    """Mean and deviation of `value` in equal quantile regimes of `by_col`."""
    k = len(labels)
    cuts = series.agg(F.percentile(by_col, F.array(*[F.lit(i / k) for i in range(1, k)])).alias("cuts"))
    label = F.element_at(F.array(*[F.lit(x) for x in labels]), F.size(F.filter("cuts", lambda c: F.col(by_col) > c)) + 1)
    return series.crossJoin(F.broadcast(cuts)).where(F.col(by_col).isNotNull()).groupBy(label.alias("regime")).agg(F.count("*").alias("n"), F.avg(value).alias("mean"), F.stddev_samp(value).alias("std"))


def risk_buckets(vols: DataFrame, k: int) -> DataFrame:
    """(symbol, vol) in k near-equal buckets, larger ones first: bucket, n, mean volatility, share of total variance."""
    w = Window.orderBy("vol", "symbol")
    total = F.sum("variance").over(Window.partitionBy())
    return vols.where("vol is not null").withColumn("bucket", F.ntile(k).over(w)).groupBy("bucket").agg(F.count("*").alias("n"), F.avg("vol").alias("mean_vol"), F.sum(F.pow("vol", 2)).alias("variance")).withColumn("share", ratio(F.col("variance"), total)).drop("variance")


def exposure_report(samples: DataFrame, caps: list[float]) -> DataFrame:
    """(equity, net) samples -> each cap with the share of samples that it binds, and whether it is the least that never does."""
    x = F.abs(ratio(F.col("net"), F.col("equity")))
    rows = samples.select(x.alias("x")).where("x is not null").withColumn("cap", F.explode(F.array(*[F.lit(float(c)) for c in caps])))
    found = rows.groupBy("cap").agg(F.count("*").alias("n"), F.avg((F.col("x") > F.col("cap")).cast("double")).alias("binding"))
    return found.withColumn("recommended", F.col("cap") == F.min(F.when(F.col("binding") == 0, F.col("cap"))).over(Window.partitionBy()))


def excursion(samples: DataFrame, keys: list[str]) -> DataFrame:
    """keys, ts, equity_close, equity_adverse -> worst adverse drawdown against the running peak, when, and the closing one."""
    w = Window.partitionBy(*keys).orderBy("ts").rowsBetween(Window.unboundedPreceding, 0)
    low = samples.withColumn("peak", F.max("equity_close").over(w)).withColumn("d", ratio(F.col("equity_adverse"), F.col("peak")) - 1)
    return low.groupBy(*keys).agg(F.min("d").alias("worst"), F.min_by("ts", F.struct("d", "ts")).alias("worst_ts"), F.max_by(ratio(F.col("equity_close"), F.col("peak")) - 1, "ts").alias("closing"))


def capacity(holdings: DataFrame, alpha: float, *, grid: tuple[float, float, int] = (1e4, 1e9, 26), eta: float = 0.1) -> DataFrame:
    """(weight, adv, vol) -> capital on a logarithmic grid, net alpha after square-root impact there, and whether it is still positive."""
    low, high, n = grid
    capitals = [low * (high / low) ** (k / (n - 1)) for k in range(n)]
    rows = holdings.where("adv > 0").withColumn("capital", F.explode(F.array(*[F.lit(c) for c in capitals])))
    size = F.abs("weight") * F.col("capital")
    return rows.groupBy("capital").agg((alpha - F.sum(eta * F.col("vol") * F.sqrt(size / F.col("adv")) * F.abs("weight"))).alias("net_alpha")).withColumn("open", F.col("net_alpha") > 0)


def active_weights(book: DataFrame, benchmark: DataFrame) -> DataFrame:
    """(symbol, weight) twice -> active weight of every name, each side first scaled to sum to 1."""
    scale = lambda t, c: t.select("symbol", ratio(F.col("weight"), F.sum("weight").over(Window.partitionBy())).alias(c))
    return scale(book, "w").join(scale(benchmark, "b"), "symbol", "full_outer").select("symbol", (F.coalesce("w", F.lit(0.0)) - F.coalesce("b", F.lit(0.0))).alias("active"))


def asof(left: DataFrame, right: DataFrame, value: str) -> DataFrame:
    """left (key, ts) with the latest `value` of right (key, ts) at or before each ts: a union and one window, no range join."""
    both = left.select("key", "ts", F.lit(None).cast("double").alias("v"), F.lit(1).alias("side")).unionByName(right.select("key", "ts", F.col(value).cast("double").alias("v"), F.lit(0).alias("side")))
    w = Window.partitionBy("key").orderBy("ts", "side").rowsBetween(Window.unboundedPreceding, 0)
    return both.withColumn(value, F.last("v", ignorenulls=True).over(w)).where("side = 1").select("key", "ts", value)


def score_distribution(results: DataFrame, score: str, params: list[str]) -> DataFrame:
    """Mean and best score of each value of each parameter: param, value, n, mean, best."""
    rows = results.select(score, F.explode(F.array(*[F.struct(F.lit(p).alias("param"), F.col(p).cast("double").alias("value")) for p in params])).alias("p"))
    return rows.groupBy("p.param", "p.value").agg(F.count("*").alias("n"), F.avg(score).alias("mean"), F.max(score).alias("best"))
