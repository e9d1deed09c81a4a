"""Cross-sectional regressions on several exposures, factor risk, attribution, conditional variance.

A cross-section is summed to its normal equations, which column expressions solve: no Python runs
and no cross-section is held whole.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from ..functions.scalars import ratio
from . import linear
from .timeseries import by


def _fitted(names: list[str]) -> Column:
    value = F.col("__level")
    for c in names:
        value = value + F.col(f"__b_{c}") * F.col(c)
    return value


def _fit(rows: DataFrame, names: list[str], y: str) -> DataFrame:
    """rows with the number of whole rows of their ts (__n) and its fit of y on names: __level and __b_<name>."""
    w = Window.partitionBy("ts")
    return linear.fitted(rows.withColumns({n: c.over(w) for n, c in linear.moments(names, y).items()}), names, y, "__level", {c: f"__b_{c}" for c in names})


def neutralized(panel: DataFrame, value: str, exposures: list[str]) -> DataFrame:
    """(ts, symbol, value, exposures) -> ts, symbol, residual of value on an intercept and the exposures.

    Names without an exposure keep their value, as does a single valid name. From two names on
    the fit is the least-squares one; with no more names than coefficients it leaves nothing.
    """
    x = [F.col(c).cast("double").alias(c) for c in exposures]
    rows = _fit(panel.select("ts", "symbol", F.col(value).cast("double").alias("__y"), *x), exposures, "__y")
    left = F.col("__y") - _fitted(exposures)
    good = (F.col("__n") >= 2) & left.isNotNull() & ~F.isnan(left)
    return rows.select("ts", "symbol", F.when(good, left).otherwise(F.col("__y")).alias("residual"))


def factor_returns(panel: DataFrame, exposures: list[str]) -> DataFrame:
    """(ts, symbol, ret, exposures) -> ts, factor, ret by OLS with an intercept ('market'); a ts with too few names gives none. An exposure that the others already hold returns 0."""
    sums = panel.groupBy("ts").agg(*[c.alias(n) for n, c in linear.moments(exposures, "ret").items()]).where(F.col("__n") > len(exposures) + 1)
    fit = linear.fitted(sums, exposures, "ret", "__level", {c: f"__b_{c}" for c in exposures})
    found = [F.struct(F.lit("market").alias("factor"), F.col("__level").alias("ret")), *[F.struct(F.lit(c).alias("factor"), F.col(f"__b_{c}").alias("ret")) for c in exposures]]
    return fit.select("ts", F.explode(F.array(*found)).alias("f")).select("ts", "f.factor", "f.ret")


def factor_covariance(returns: DataFrame) -> DataFrame:
    """(ts, factor, ret) -> i, j, cov (sample) of the factors."""
    a = returns.select("ts", F.col("factor").alias("i"), F.col("ret").alias("x"))
    return a.join(returns.select("ts", F.col("factor").alias("j"), F.col("ret").alias("y")), "ts").groupBy("i", "j").agg(F.covar_samp("x", "y").alias("cov"))


def specific_variance(panel: DataFrame, exposures: list[str], returns: DataFrame) -> DataFrame:
    """symbol, variance of what the factor returns leave of each name."""
    wide = returns.groupBy("ts").pivot("factor", ["market", *exposures]).agg(F.first("ret"))
    explained = F.col("f.market")
    for e in exposures:
        explained = explained + F.col(f"p.{e}") * F.col(f"f.{e}")
    return panel.alias("p").join(wide.alias("f"), "ts").groupBy("p.symbol").agg(F.var_samp(F.col("p.ret") - explained).alias("variance"))


def attribution(panel: DataFrame, exposures: list[str], signal: str | None = None) -> DataFrame:
    """(ts, symbol, weight, ret, beta, bench, exposures) -> ts, systematic, factor, specific, total; the parts sum to the total.

    With a signal, a further column of the panel, what it explains beside the exposures is a part
    of its own, `signal`. Rows with a missing value are left out; a ts with no more names than
    coefficients explains nothing.
    """
    names = [*exposures, *([signal] if signal else [])]
    rest = F.col("ret") - F.col("beta") * F.col("bench")
    whole = F.lit(True)
    for c in ["weight", "ret", "beta", "bench", *names]:
        whole &= F.col(c).isNotNull() & ~F.isnan(F.col(c).cast("double")) & (F.abs(c) < float("inf"))
    rows = _fit(panel.where(whole).withColumn("__y", rest), names, "__y")
    enough = F.col("__n") > len(names) + 1
    of = lambda c: F.when(enough, c).otherwise(0.0) * F.col("weight")
    mine = F.col(f"__b_{signal}") * F.col(signal) if signal else F.lit(0.0)
    parts = {"systematic": F.sum(F.col("weight") * F.col("beta") * F.col("bench")), "factor": F.sum(of(_fitted(names) - mine)), **({"signal": F.sum(of(mine))} if signal else {}), "total": F.sum(F.col("weight") * F.col("ret"))}
    found = rows.groupBy("ts").agg(*[c.alias(n) for n, c in parts.items()])
    specific = F.col("total") - F.col("systematic") - F.col("factor") - (F.col("signal") if signal else 0.0)
    return found.select("ts", *[c for c in parts if c != "total"], specific.alias("specific"), "total")


def attribution_report(parts: DataFrame, ppy: float) -> DataFrame:
    """component, total, information ratio a year, t statistic, share of the summed variance."""
    rows = parts.select(F.explode(F.array(*[F.struct(F.lit(c).alias("component"), F.col(c).alias("x")) for c in ("systematic", "factor", "signal", "specific") if c in parts.columns])).alias("c")).select("c.*")
    found = rows.groupBy("component").agg(F.sum("x").alias("total"), ratio(F.avg("x"), F.stddev_samp("x")).alias("s"), F.count("x").alias("n"), F.var_samp("x").alias("v"))
    return found.select("component", "total", (F.col("s") * ppy**0.5).alias("ir"), (F.col("s") * F.sqrt("n")).alias("t_stat"), ratio(F.col("v"), F.sum("v").over(Window.partitionBy())).alias("variance_share"))


def conditioned(cov: DataFrame, variances: DataFrame) -> DataFrame:
    """(i, j, cov) rescaled to the variances (symbol, variance), correlations kept; names without one keep theirs."""
    old = cov.where("i = j").select(F.col("i").alias("symbol"), F.col("cov").alias("old"))
    scale = old.join(variances, "symbol", "left").select("symbol", F.sqrt(F.coalesce(ratio(F.col("variance"), F.col("old")), F.lit(1.0))).alias("k"))
    return cov.join(scale.select(F.col("symbol").alias("i"), F.col("k").alias("ki")), "i").join(scale.select(F.col("symbol").alias("j"), F.col("k").alias("kj")), "j").select("i", "j", (F.col("cov") * F.col("ki") * F.col("kj")).alias("cov"))


def har_features(returns: DataFrame) -> DataFrame:
    """(ts, symbol, ret) -> with daily, weekly (5) and monthly (22) means of squared returns, null until full, and the next square."""
    q = F.col("ret") * F.col("ret")
    mean = lambda n: F.when(F.count("ret").over(by().rowsBetween(1 - n, 0)) == n, F.avg(q).over(by().rowsBetween(1 - n, 0)))
    return returns.select("ts", "symbol", q.alias("d"), mean(5).alias("w"), mean(22).alias("m"), F.lead(q).over(by()).alias("next"))
