"""Structural and conditional risk: factor models from moments, long matrices, forecasts of variance and what they are worth.

Matrices are long tables (i, j, cov) with i <= j. Nothing is pivoted over names and nothing runs
as grouped Python: cross-sections are summed to normal equations and solved in column expressions.
"""

from __future__ import annotations

import math

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from ..functions.scalars import ratio
from ..sources.shared import saved
from . import linear, scan
from .risk import both_halves
from .timeseries import by

MARKET = "market"
#: Decay of daily and of weekly or slower variances, and the cadence between them.
DECAY_DAILY, DECAY_WEEKLY, WEEKLY_PPY = 0.94, 0.97, 100.0
#: Parts that names are dealt into when all pairs of them are the result.
PARTS = 8


def default_decay(ppy: float) -> float:
    return DECAY_DAILY if ppy > WEEKLY_PPY else DECAY_WEEKLY


# Factor model


class FactorModel:
    """Frames of one estimate: exposures (symbol, factors), factor returns (ts, factors), residuals (ts, symbol, residual), specific variances (symbol, variance), and the factor covariances as numbers by pair: a handful, whatever the panel's size."""

    def __init__(self, factors: list[str], exposures: DataFrame, returns: DataFrame, residuals: DataFrame, covariance: dict[tuple[str, str], float], specific: DataFrame):
        self.factors, self.exposures, self.returns, self.residuals, self.covariance, self.specific = factors, exposures, returns, residuals, covariance, specific


def projected(exposures: DataFrame, styles: list[str]) -> DataFrame:
    """(symbol, styles) -> symbol, market (1), styles and the weights p_<factor> that turn a cross-section of returns into factor returns by least squares.

    The normal matrix is one row of sums over names. Names with a missing exposure are left out;
    unless the names outnumber the factors, market included, by two there are no rows.
    """
    factors = [MARKET, *styles]
    whole = F.lit(True)
    for s in styles:
        whole &= F.col(s).isNotNull() & ~F.isnan(F.col(s).cast("double"))
    names = exposures.where(whole).select("symbol", F.lit(1.0).alias(MARKET), *[F.col(s).cast("double").alias(s) for s in styles])
    sums = names.agg(F.count("*").alias("__n"), *[F.sum(F.col(a) * F.col(b)).alias(f"__s_{a}_{b}") for a, b in linear.pairs(factors)]).where(F.col("__n") > len(factors) + 1)
    both = names.join(F.broadcast(sums))
    out = linear.solved(both, factors, {(a, b): f"__s_{a}_{b}" for a, b in linear.pairs(factors)}, {f: f for f in factors}, {f: f"p_{f}" for f in factors})
    return out.select("symbol", *factors, *[f"p_{f}" for f in factors])


def factor_model(panel: DataFrame, exposures: DataFrame, styles: list[str], ppy: float) -> FactorModel:
    """Complete-case panel (ts, symbol, ret) and exposures (symbol, styles), one row a name -> a model with annual covariances (n - 1)."""
    factors = [MARKET, *styles]
    names = projected(exposures.join(panel.select("symbol").distinct(), "symbol", "left_semi"), styles)
    # All that follows reads these frames several times over. They are written: kept frames that are made of one another would repeat all earlier plans in each later one.
    rows = saved(panel.join(names, "symbol"), "model-rows")
    returns = saved(rows.groupBy("ts").agg(*[F.sum(F.col("ret") * F.col(f"p_{f}")).alias(f) for f in factors]), "factor-returns")
    explained = F.lit(0.0)
    for f in factors:
        explained = explained + F.col(f"a.{f}") * F.col(f"b.{f}")
    residuals = saved(rows.alias("a").join(returns.alias("b"), "ts").select("ts", "a.symbol", (F.col("a.ret") - explained).alias("residual")), "residuals")
    pairs = linear.pairs(factors)
    covariance = dict(zip(pairs, returns.agg(*[F.covar_samp(a, b) * ppy for a, b in pairs]).first(), strict=True))
    specific = residuals.groupBy("symbol").agg((F.var_samp("residual") * ppy).alias("variance"))
    return FactorModel(factors, rows.select("symbol", *factors).distinct(), returns, residuals, covariance, specific)


def all_pairs(names: DataFrame, parts: int = PARTS) -> DataFrame:
    """names joined with themselves as a (i) and b (j), i <= j, each pair once: an equi-join of parts of the names, so that tasks share the matrix."""
    part = F.pmod(F.xxhash64("symbol"), F.lit(parts))
    left = names.withColumn("__part", F.explode(F.array(*[F.lit(k).cast("long") for k in range(parts)])))
    return left.alias("a").join(names.withColumn("__part", part).alias("b"), "__part").where(F.col("a.symbol") <= F.col("b.symbol"))


def assembled(model: FactorModel) -> DataFrame:
    """The whole matrix of a factor model: i, j (i <= j), cov."""
    both = model.exposures.join(model.specific, "symbol")
    of = lambda a, b: F.lit(model.covariance.get((a, b), model.covariance.get((b, a)))).cast("double")
    pulls = []
    for a in model.factors:
        pull = F.lit(0.0)
        for b in model.factors:
            pull = pull + of(a, b) * F.col(b)
        pulls.append(pull.alias(f"g_{a}"))
    names = saved(both.select("symbol", *model.factors, *pulls, "variance"), "model-names")
    cov = F.when(F.col("a.symbol") == F.col("b.symbol"), F.col("a.variance")).otherwise(0.0)
    for f in model.factors:
        cov = cov + F.col(f"a.g_{f}") * F.col(f"b.{f}")
    return all_pairs(names).select(F.col("a.symbol").alias("i"), F.col("b.symbol").alias("j"), cov.alias("cov"))


# Conditional variances


def end_weights(dates: DataFrame, decay: float, min_obs: int, seconds: int = 366 * 86400) -> DataFrame:
    """(ts) -> ts, weight: what a square at ts counts in the exponentially weighted second moment at the last ts, seeded with the mean of the first min_obs. No rows if there are fewer."""
    rows = scan.numbered(dates.select("ts").distinct(), [], "ts", seconds)
    size = rows.agg(F.count("*").alias("t")).where(F.col("t") >= min_obs)
    age = F.col("t") - 1 - F.col("i")
    early = F.pow(F.lit(decay), F.col("t") - min_obs) / min_obs
    return rows.join(F.broadcast(size)).select("ts", F.when(F.col("i") < min_obs, early).otherwise((1 - decay) * F.pow(F.lit(decay), age)).alias("weight"))


def weighted_variances(rows: DataFrame, value: str, decay: float, min_obs: int) -> DataFrame:
    """(ts, symbol, value) of a complete-case panel -> symbol, variance at its last ts (a bar's, about zero)."""
    return rows.join(end_weights(rows, decay, min_obs), "ts").groupBy("symbol").agg(F.sum(F.col("weight") * F.col(value) * F.col(value)).alias("variance"))


def har_variances(rows: DataFrame, value: str, min_obs: int) -> DataFrame:
    """(ts, symbol, value) -> symbol, variance: next bar's square by a fit on the mean squares of 1, 5 and 22 bars, 0 at least; names with fewer than min_obs usable bars have none."""
    q = F.col(value) * F.col(value)
    mean = lambda n: F.when(F.count(value).over(by().rowsBetween(1 - n, 0)) == n, F.avg(q).over(by().rowsBetween(1 - n, 0)))
    wide = rows.select("ts", "symbol", q.alias("d"), mean(5).alias("w"), mean(22).alias("m"), F.lead(q).over(by()).alias("y"))
    names = ["d", "w", "m"]
    last = [F.max_by(c, "ts").alias(f"last_{c}") for c in names]
    found = wide.groupBy("symbol").agg(F.count("*").alias("t"), *last, *[c.alias(n) for n, c in linear.moments(names, "y").items()])
    fit = linear.fitted(found.where((F.col("t") > min_obs) & (F.col("__n") >= min_obs)), names, "y", "level", {c: f"b_{c}" for c in names})
    ahead = F.col("level")
    for c in names:
        ahead = ahead + F.col(f"b_{c}") * F.col(f"last_{c}")
    return fit.select("symbol", F.greatest(ahead, F.lit(0.0)).alias("variance")).where("variance is not null")


def forecasts(rows: DataFrame, value: str, method: str, decay: float, min_obs: int) -> DataFrame:
    if method == "ewma":
        return weighted_variances(rows, value, decay, min_obs)
    if method == "har":
        return har_variances(rows, value, min_obs)
    raise ValueError(f"method is 'ewma' or 'har', not {method!r}")


def conditioned(cov: DataFrame, panel: DataFrame, method: str, ppy: float, *, min_obs: int = 60, decay: float | None = None, horizon: int = 1) -> DataFrame:
    """(i, j, cov) with the diagonal of a forecast from the same panel (ts, symbol, ret), correlations kept: i, j, cov.

    Names without a forecast keep their variance. A name without variance before has no
    correlation with others and gets the forecast alone.
    """
    ahead = forecasts(panel, "ret", method, decay or default_decay(ppy), min_obs).select("symbol", (F.col("variance") * horizon * ppy).alias("new"))
    own = cov.where("i = j").select(F.col("i").alias("symbol"), F.col("cov").alias("old")).join(ahead, "symbol", "left").withColumn("new", F.coalesce("new", "old"))
    scale = own.select("symbol", "new", F.when(F.col("old") > 0, F.sqrt(F.col("new") / F.col("old"))).otherwise(0.0).alias("k"))
    one = lambda c: scale.select(F.col("symbol").alias(c), F.col("k").alias(f"k{c}"), F.col("new").alias(f"new{c}"))
    return cov.join(one("i"), "i").join(one("j"), "j").select("i", "j", F.when(F.col("i") == F.col("j"), F.col("newi")).otherwise(F.col("cov") * F.col("ki") * F.col("kj")).alias("cov"))


def conditioned_model(model: FactorModel, method: str, ppy: float, *, min_obs: int = 60, decay: float | None = None, horizon: int = 1) -> FactorModel:
    """The model with exponentially weighted factor covariances and forecast specific variances: both or, for a panel too short, neither is conditioned."""
    share = decay or default_decay(ppy)
    weighted = model.returns.join(end_weights(model.returns, share, min_obs), "ts")
    pairs = linear.pairs(model.factors)
    sums = weighted.agg(*[F.sum(F.col("weight") * F.col(a) * F.col(b)) * ppy * horizon for a, b in pairs]).first()
    ahead = forecasts(model.residuals, "residual", method, share, min_obs).select("symbol", (F.col("variance") * horizon * ppy).alias("new"))
    ahead = saved(ahead, "forecasts")
    if None in sums or ahead.isEmpty():
        return model
    specific = model.specific.join(ahead, "symbol", "left").select("symbol", F.coalesce("new", "variance").alias("variance"))
    return FactorModel(model.factors, model.exposures, model.returns, model.residuals, dict(zip(pairs, sums, strict=True)), specific)


def regimes(before: DataFrame, after: DataFrame) -> DataFrame:
    """Variances (symbol, variance) before and after conditioning -> symbol, unconditional_vol, conditional_vol, regime (their ratio of variances, 1 without one), mean_regime."""
    both = before.select("symbol", F.col("variance").alias("u")).join(after.select("symbol", F.col("variance").alias("c")), "symbol")
    regime = F.when(F.col("u") > 0, F.col("c") / F.col("u")).otherwise(1.0)
    rows = both.select("symbol", F.sqrt(F.greatest("u", F.lit(0.0))).alias("unconditional_vol"), F.sqrt(F.greatest("c", F.lit(0.0))).alias("conditional_vol"), regime.alias("regime"))
    return rows.join(F.broadcast(rows.agg(F.avg("regime").alias("mean_regime"))))


def diagonal(cov: DataFrame) -> DataFrame:
    return cov.where("i = j").select(F.col("i").alias("symbol"), F.col("cov").alias("variance"))


# Completion and queries


def completed(cov: DataFrame, universe: DataFrame) -> DataFrame:
    """cov with a row for each further symbol of universe: independent, at the median variance."""
    median = cov.where("i = j").agg(F.median("cov").alias("cov"))
    more = universe.select("symbol").distinct().join(cov.where("i = j").select(F.col("i").alias("symbol")), "symbol", "left_anti")
    return cov.select("i", "j", "cov").unionByName(more.join(F.broadcast(median)).select(F.col("symbol").alias("i"), F.col("symbol").alias("j"), "cov"))


def _pull(cov: DataFrame, weights: DataFrame) -> DataFrame:
    """symbol, pull: the matrix times the weights (symbol, weight), for every name of the matrix."""
    w = weights.groupBy(F.col("symbol").alias("j")).agg(F.sum("weight").alias("w"))
    return both_halves(cov).join(w, "j", "left").groupBy(F.col("i").alias("symbol")).agg(F.sum(F.col("cov") * F.coalesce("w", F.lit(0.0))).alias("pull"))


def _active(weights: DataFrame, benchmark: DataFrame | None) -> DataFrame:
    if benchmark is None:
        return weights.select("symbol", "weight")
    return weights.select("symbol", "weight").unionByName(benchmark.select("symbol", (-F.col("weight")).alias("weight"))).groupBy("symbol").agg(F.sum("weight").alias("weight"))


def variance(cov: DataFrame, weights: DataFrame) -> DataFrame:
    """variance, volatility of a book: one row. Names outside the matrix count as 0."""
    v = F.coalesce(F.sum(F.col("weight") * F.col("pull")), F.lit(0.0))
    return _pull(cov, weights).join(weights, "symbol").agg(v.alias("variance")).withColumn("volatility", F.sqrt(F.greatest("variance", F.lit(0.0))))


def tracking_error(cov: DataFrame, weights: DataFrame, benchmark: DataFrame) -> DataFrame:
    return variance(cov, _active(weights, benchmark)).select(F.col("volatility").alias("tracking_error"))


def implied_beta(cov: DataFrame, benchmark: DataFrame) -> DataFrame:
    """symbol, beta to the benchmark that the matrix implies; 0 if the benchmark carries no risk."""
    total = variance(cov, benchmark).select(F.col("variance").alias("v"))
    return _pull(cov, benchmark).join(F.broadcast(total)).select("symbol", F.when(F.col("v") > 0, F.col("pull") / F.col("v")).otherwise(0.0).alias("beta"))


def marginal(cov: DataFrame, weights: DataFrame, benchmark: DataFrame | None = None) -> DataFrame:
    """symbol, marginal contribution to the (active) risk; 0 without risk."""
    active = _active(weights, benchmark)
    total = variance(cov, active).select("volatility")
    return _pull(cov, active).join(F.broadcast(total)).select("symbol", F.when(F.col("volatility") > 0, F.col("pull") / F.col("volatility")).otherwise(0.0).alias("marginal"))


def correlation(cov: DataFrame) -> DataFrame:
    """i, j, rho; 0 beside a name without variance."""
    one = lambda c: cov.where("i = j").select(F.col("i").alias(c), F.col("cov").alias(f"v{c}"))
    scale = F.sqrt(F.col("vi") * F.col("vj"))
    return cov.join(one("i"), "i").join(one("j"), "j").select("i", "j", F.when((F.col("vi") > 0) & (F.col("vj") > 0), F.col("cov") / scale).otherwise(0.0).alias("rho"))


def volatilities(cov: DataFrame) -> DataFrame:
    return diagonal(cov).select("symbol", F.sqrt("variance").alias("volatility"))


def model_split(model: FactorModel, weights: DataFrame) -> DataFrame:
    """factor, specific and total variance of a book, and the factors' share (null without risk): one row."""
    w = weights.groupBy("symbol").agg(F.sum("weight").alias("weight"))
    loads = model.exposures.join(w, "symbol").agg(*[F.coalesce(F.sum(F.col("weight") * F.col(f)), F.lit(0.0)).alias(f) for f in model.factors])
    factor = F.lit(0.0)
    for a, b in linear.pairs(model.factors):
        factor = factor + F.lit(1.0 if a == b else 2.0) * F.col(a) * F.col(b) * F.lit(model.covariance[a, b]).cast("double")
    own = model.specific.join(w, "symbol").agg(F.coalesce(F.sum(F.col("variance") * F.col("weight") * F.col("weight")), F.lit(0.0)).alias("specific"))
    both = loads.join(F.broadcast(own)).select(factor.alias("factor"), "specific")
    return both.withColumn("total", F.col("factor") + F.col("specific")).withColumn("factor_share", ratio(F.col("factor"), F.col("total")))


# What forecasts are worth

METHODS = ("ewma", "har", "unconditional")


def evaluation_points(returns: DataFrame, *, min_obs: int = 60, n_points: int = 60, decay: float = DECAY_DAILY) -> DataFrame:
    """(ts, symbol, ret) -> symbol, ts, i, realized (the next square) and the ewma, har and unconditional forecasts made at each of n_points rows from min_obs to the last but one.

    All three come from one pass: running moments of the squares give every refit, a small solve
    for each point.
    """
    rows = scan.ewma_variance(returns, decay=decay, min_obs=min_obs)
    q = F.col("ret") * F.col("ret")
    mean = lambda n: F.when(F.count("ret").over(by().rowsBetween(1 - n, 0)) == n, F.avg(q).over(by().rowsBetween(1 - n, 0)))
    names = ["d", "w", "m"]
    wide = rows.select("ts", "symbol", "i", F.col("variance").alias("ewma"), q.alias("d"), mean(5).alias("w"), mean(22).alias("m"), F.lead(q).over(by()).alias("y"), F.count("*").over(Window.partitionBy("symbol")).alias("t"), F.avg(q).over(by().rowsBetween(Window.unboundedPreceding, 0)).alias("unconditional"))
    # A fit at row i knows the squares up to i: pairs whose next square is row i at the latest.
    known = by().rowsBetween(Window.unboundedPreceding, -1)
    first, last = F.lit(min_obs), F.col("t") - 2
    k = F.least(F.lit(n_points).cast("long"), last - first + 1)
    # Point number j of k stands at first + floor(j x step); a row is one if some j gives it.
    step = (last - first) / F.greatest(k - 1, F.lit(1))
    place = lambda j: F.when(j >= k - 1, last).otherwise(F.floor(first + j * step))
    j = F.floor((F.col("i") - first) / step)
    hit = (place(j) == F.col("i")) | (place(j + 1) == F.col("i"))
    inside = (last > first) & F.col("i").between(first, last)
    at = wide.withColumns({n: c.over(known) for n, c in linear.moments(names, "y").items()}).where(inside & F.when(k > 1, hit).otherwise(F.col("i") == first))
    fit = linear.fitted(at, names, "y", "level", {c: f"b_{c}" for c in names})
    ahead = F.col("level")
    for c in names:
        ahead = ahead + F.col(f"b_{c}") * F.col(c)
    har = F.when((F.col("i") + 1 > min_obs) & (F.col("__n") >= min_obs), F.greatest(ahead, F.lit(0.0)))
    return fit.select("symbol", "ts", "i", F.col("y").alias("realized"), "ewma", har.alias("har"), "unconditional")


def _quality(rows: DataFrame, keys: list[str]) -> DataFrame:
    """keys, n pairs, intercept, slope and r2 of realized on forecast (null under three pairs), mean qlike of the positive pairs."""
    x = F.when((F.col("realized") > 0) & (F.col("forecast") > 0), F.col("realized") / F.col("forecast"))
    both = rows.where("realized is not null and forecast is not null")
    some = F.count("*") >= 3
    found = both.groupBy(*keys).agg(
        F.count("*").alias("n"), F.when(some, F.regr_intercept("realized", "forecast")).alias("a"), F.when(some, F.regr_slope("realized", "forecast")).alias("b"),
        F.when(some, F.coalesce(F.regr_r2("realized", "forecast"), F.lit(0.0))).alias("r2"), F.avg(x - F.ln(x) - 1).alias("qlike"),
    )
    return found


def _methods(points: DataFrame) -> DataFrame:
    return points.withColumn("f", F.explode(F.array(*[F.struct(F.lit(m).alias("method"), F.col(m).alias("forecast")) for m in METHODS]))).select("*", "f.method", "f.forecast")


def evaluated(points: DataFrame) -> DataFrame:
    """Points -> symbol, method, regime (all, and the thirds of realized variance low, mid, high), n, a, b, r2, qlike. The thirds are labels for the report alone."""
    cuts = points.groupBy("symbol").agg(F.percentile("realized", F.array(F.lit(1 / 3), F.lit(2 / 3))).alias("cut"), F.count("realized").alias("k"))
    label = F.when((F.col("k") < 3), "mid").when(F.col("realized") <= F.col("cut")[0], "low").when(F.col("realized") <= F.col("cut")[1], "mid").otherwise("high")
    rows = _methods(points.join(cuts, "symbol").withColumn("regime", F.explode(F.array(F.lit("all"), label))))
    return _quality(rows, ["symbol", "method", "regime"])


def gate(points: DataFrame, least_points: int = 10) -> DataFrame:
    """All names' points pooled -> method, n, a, b, r2, qlike, best (lowest qlike) and adopt: true for a best method other than the unconditional one whose slope is also nearer to 1. Names with fewer than least_points are left out."""
    kept = points.groupBy("symbol").agg(F.count("*").alias("k")).where(F.col("k") >= least_points).select("symbol")
    pooled = _quality(_methods(points.join(kept, "symbol", "left_semi")), ["method"])
    base = pooled.where("method = 'unconditional'").select(F.abs(F.col("b") - 1).alias("base_gap"))
    least = pooled.agg(F.min_by("method", F.struct("qlike", "method")).alias("winner"))
    rows = pooled.join(F.broadcast(base), how="left").join(F.broadcast(least))
    best = F.col("method") == F.col("winner")
    return rows.select("method", "n", "a", "b", "r2", "qlike", best.alias("best"), (best & (F.col("method") != "unconditional") & F.coalesce(F.abs(F.col("b") - 1) < F.col("base_gap"), F.lit(False))).alias("adopt"))
