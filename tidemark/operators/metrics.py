"""Return-series metrics: one grouped aggregate a series; degenerate groups have defined values."""

from __future__ import annotations

import math

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from ..functions.scalars import is_flat, normal_cdf, normal_quantile, ratio

INF = float("inf")


def _or(value: Column, otherwise: float = 0.0) -> Column:
    return F.coalesce(value, F.lit(otherwise))


def _over(a: Column, b: Column, otherwise: float) -> Column:
    """a / b, or `otherwise` where b is 0 or missing."""
    return F.when(b != 0, ratio(a, b)).otherwise(F.lit(otherwise))


def sharpe(r: Column, ppy: float) -> Column:
    s = F.stddev_samp(r)
    return F.when(is_flat(s, F.avg(F.abs(r))), 0.0).otherwise(math.sqrt(ppy) * ratio(F.avg(r), s))


def downside(r: Column) -> Column:
    """Root mean square of the losses over all observations."""
    return F.sqrt(F.avg(F.pow(F.least(r, F.lit(0.0)), 2)))


def sample_skewness(r: Column) -> Column:
    """Bias-corrected; 0 under three observations or without dispersion."""
    n = F.count(r).cast("double")
    return F.when((F.count(r) >= 3) & ~is_flat(F.stddev_samp(r), F.avg(F.abs(r))), F.skewness(r) * F.sqrt(n * (n - 1)) / (n - 2)).otherwise(0.0)


def sample_kurtosis(r: Column) -> Column:
    """Bias-corrected excess; 0 under four observations or without dispersion."""
    n = F.count(r).cast("double")
    return F.when((F.count(r) >= 4) & ~is_flat(F.stddev_samp(r), F.avg(F.abs(r))), (n - 1) / ((n - 2) * (n - 3)) * ((n + 1) * F.kurtosis(r) + 6)).otherwise(0.0)


def return_metrics(series: DataFrame, keys: list[str], *, ppy: float = 252.0) -> DataFrame:
    """keys, ts, ret -> one row of metrics for each key."""
    r = F.col("ret")
    var95 = F.percentile(r, F.lit(0.05))
    gains, losses = F.sum(F.greatest(r, F.lit(0.0))), -F.sum(F.least(r, F.lit(0.0)))
    rows = series.where("ret is not null").withColumn("__cut", F.percentile(r, F.lit(0.05)).over(Window.partitionBy(*keys)))
    return rows.groupBy(*keys).agg(
        F.count("*").alias("n"),
        (F.exp(F.sum(F.ln(1 + F.when(r > -1, r)))) - 1).alias("total_return"),
        _or(F.stddev_samp(r) * math.sqrt(ppy)).alias("volatility"),
        (downside(r) * math.sqrt(ppy)).alias("downside"),
        sharpe(r, ppy).alias("sharpe"),
        _over(F.avg(r) * math.sqrt(ppy), downside(r), 0.0).alias("sortino"),
        F.greatest(-var95, F.lit(0.0)).alias("var_95"),
        F.greatest(-F.avg(F.when(r <= F.col("__cut"), r)), F.lit(0.0)).alias("cvar_95"),
        sample_skewness(r).alias("skew"),
        sample_kurtosis(r).alias("kurtosis"),
        _over(F.abs(F.percentile(r, F.lit(0.95))), F.abs(var95), INF).alias("tail_ratio"),
        _over(gains, losses, INF).alias("omega"),
        _over(F.sum(r), losses, INF).alias("gain_to_pain"),
        F.max(r).alias("best"),
        F.min(r).alias("worst"),
        (F.count_if(r > 0) / F.count("*")).alias("win_rate"),
    )


def drawdown_metrics(equity: DataFrame, keys: list[str]) -> DataFrame:
    """keys, ts, equity -> max, average and root-mean-square drawdown, longest run under water."""
    w = Window.partitionBy(*keys).orderBy("ts")
    low = equity.withColumn("dd", ratio(F.col("equity"), F.max("equity").over(w.rowsBetween(Window.unboundedPreceding, 0))) - 1)
    runs = low.withColumn("under", F.col("dd") < 0).withColumn("island", F.row_number().over(w) - F.row_number().over(Window.partitionBy(*keys, "under").orderBy("ts")))
    lengths = runs.groupBy(*keys, "under", "island").agg(F.count("*").alias("k"), F.min("dd").alias("low"), F.sum("dd").alias("total"), F.sum(F.col("dd") * F.col("dd")).alias("squares"))
    return lengths.groupBy(*keys).agg(
        F.min("low").alias("max_drawdown"),
        (F.sum("total") / F.sum("k")).alias("avg_drawdown"),
        F.sqrt(F.sum("squares") / F.sum("k")).alias("ulcer"),
        _or(F.max(F.when(F.col("under"), F.col("k"))).cast("double")).cast("long").alias("longest_under"),
    )


def metric_row(equity: DataFrame, keys: list[str], *, ppy: float = 252.0) -> DataFrame:
    """keys, ts, equity, bench (return of the benchmark) -> growth, risk and the ratios of the two, one row for each key.

    Zero drawdown gives an infinite Calmar, Sterling and recovery and a zero Martin ratio; growth
    is 0 without time or for an equity that is not positive, Treynor for a beta under 0.05.
    low_sample marks keys with fewer than 30 returns. Rows without equity are left out.
    """
    w = Window.partitionBy(*keys).orderBy("ts")
    rows = equity.where("equity is not null").withColumn("ret", ratio(F.col("equity"), F.lag("equity").over(w)) - 1).withColumn("peak", F.max("equity").over(w.rowsBetween(Window.unboundedPreceding, 0)))
    first, last = F.min_by("equity", "ts"), F.max_by("equity", "ts")
    years = (F.unix_timestamp(F.max("ts")) - F.unix_timestamp(F.min("ts"))) / (365.25 * 86400)
    growth = rows.groupBy(*keys).agg(
        F.when((F.count("*") >= 2) & (years > 0) & (first > 0) & (last > 0), F.pow(ratio(last, first), 1 / F.when(years > 0, years)) - 1).otherwise(0.0).alias("cagr"),
        (last - first).alias("net"),
        F.max(F.col("peak") - F.col("equity")).alias("drawdown_value"),
        F.greatest(-F.percentile("ret", F.lit(0.01)), F.lit(0.0)).alias("var_99"),
        F.avg("ret").alias("mean"),
        (F.count("ret") < 30).alias("low_sample"),
    )
    found = growth.join(return_metrics(rows, keys, ppy=ppy), keys).join(drawdown_metrics(rows, keys), keys).join(benchmark_metrics(rows, keys, ppy=ppy).select(*keys, "beta"), keys, "left")
    c, beta = F.col("cagr"), F.col("beta")
    return found.select(
        *keys, "n", "low_sample", "cagr", "volatility", "downside", "sharpe", "sortino", "max_drawdown", "avg_drawdown", "ulcer", "longest_under", "var_95", "var_99", "cvar_95", "skew", "kurtosis",
        _over(c, F.abs("max_drawdown"), INF).alias("calmar"),
        _over(c, F.abs("avg_drawdown"), INF).alias("sterling"),
        _over(F.col("net"), F.col("drawdown_value"), INF).alias("recovery"),
        _over(c, F.col("ulcer"), 0.0).alias("martin"),
        F.when(F.abs(beta) >= 0.05, ratio(F.col("mean") * ppy, beta)).otherwise(0.0).alias("treynor"),
    )


def expected_max_sharpe(variance: Column, trials: Column) -> Column:
    """Expected best per-period Sharpe ratio of independent trials without skill (Bailey and Lopez de Prado, 2014); 0 for one trial or no variance."""
    euler = 0.5772156649015329
    several = F.when(trials > 1, trials)
    z1, z2 = normal_quantile(1 - 1 / several), normal_quantile(1 - 1 / (several * math.e))
    return F.when((trials > 1) & (variance > 0), F.sqrt(variance) * ((1 - euler) * z1 + euler * z2)).otherwise(0.0)


def deflated_sharpe(per_period: Column, n: Column, skew: Column, kurtosis: Column, trials: Column, variance: Column | None = None) -> Column:
    """Probability that the true Sharpe ratio exceeds the best expected of that many trials; their ratios' variance is 1 / (n - 1) if unknown. 0 under three rows or one trial."""
    if variance is None:
        variance = 1 / F.when(n > 1, n - 1)
    return F.when((n >= 3) & (trials >= 1), probabilistic_sharpe(per_period, n, skew, kurtosis, expected_max_sharpe(variance, trials))).otherwise(0.0)


def benchmark_metrics(pairs: DataFrame, keys: list[str], *, ppy: float = 252.0) -> DataFrame:
    """keys, ret, bench -> alpha a period, beta, r2, information ratio; zeros under three rows or a flat side."""
    r, b = F.col("ret"), F.col("bench")
    bad = (F.count("*") < 3) | is_flat(F.stddev_samp(b), F.avg(F.abs(b))) | is_flat(F.stddev_samp(r), F.avg(F.abs(r)))
    return pairs.where("ret is not null and bench is not null").groupBy(*keys).agg(
        F.when(bad, 0.0).otherwise(F.regr_intercept(r, b)).alias("alpha"),
        F.when(bad, 0.0).otherwise(F.regr_slope(r, b)).alias("beta"),
        F.when(bad, 0.0).otherwise(F.regr_r2(r, b)).alias("r2"),
        sharpe(r - b, ppy).alias("information_ratio"),
        F.when(bad, 1.0).otherwise(_over(F.covar_samp(r, b), F.var_samp(b), 1.0)).alias("beta_or_one"),
    )


def probabilistic_sharpe(per_period: Column, n: Column, skew: Column, kurtosis: Column, against: Column | float = 0.0) -> Column:
    """Probability that the true Sharpe ratio exceeds `against`; 0 under two observations."""
    spread = 1 - skew * per_period + (kurtosis + 2) / 4 * per_period * per_period
    return F.when((n > 1) & (spread > 0), normal_cdf((per_period - against) * F.sqrt(n - 1) / F.sqrt(F.when(spread > 0, spread)))).otherwise(0.0)


def trade_metrics(trades: DataFrame, keys: list[str]) -> DataFrame:
    """keys, pnl -> win rate, profit factor, expectancy, payoff, Kelly share, SQN."""
    p = F.col("pnl")
    won, lost = F.sum(F.greatest(p, F.lit(0.0))), -F.sum(F.least(p, F.lit(0.0)))
    avg_win, avg_loss = _or(F.avg(F.when(p > 0, p))), _or(-F.avg(F.when(p < 0, p)))
    rate = F.count_if(p > 0) / F.count("*")
    payoff = _over(avg_win, avg_loss, INF)
    return trades.groupBy(*keys).agg(
        F.count("*").alias("n_trades"),
        rate.alias("win_rate"),
        F.when(lost > 0, ratio(won, lost)).when(won > 0, INF).otherwise(0.0).alias("profit_factor"),
        F.avg(p).alias("expectancy"),
        payoff.alias("payoff"),
        F.when((avg_loss > 0) & (avg_win > 0), rate - ratio(1 - rate, payoff)).otherwise(0.0).alias("kelly"),
        F.when(is_flat(F.stddev_samp(p), F.avg(F.abs(p))), 0.0).otherwise(F.sqrt(F.count("*")) * ratio(F.avg(p), F.stddev_samp(p))).alias("sqn"),
    )
