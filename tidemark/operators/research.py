"""Alphas over all rebalances at once: information, scaling tests, signal measures and attribution of active returns."""

from __future__ import annotations

import math

import numpy as np
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from ..functions.scalars import is_flat, ratio
from .studies import effective_breadth
from .xsection import average_rank, refine, top

#: Rebalances under which an information coefficient is called thin.
LEAST_PERIODS = 20
#: Names that a cross-section needs to be measured.
LEAST_NAMES = 5


def at() -> Window:
    return Window.partitionBy("ts")


def forward_residuals(bars: DataFrame, horizon: int) -> DataFrame:
    """(ts, symbol, close, ret, bench) -> with beta, fwd and resid: the return of the next `horizon` bars and what beta times the benchmark's leaves of it.

    Beta comes from the symbol's returns up to the ts, 1 under three of them or against a flat
    benchmark. The benchmark's forward return compounds the `bench` of the same bars.
    """
    w = Window.partitionBy("symbol").orderBy("ts")
    past, ahead = w.rowsBetween(Window.unboundedPreceding, 0), w.rowsBetween(1, horizon)
    both = F.col("ret").isNotNull() & F.col("bench").isNotNull()
    x, y = F.when(both, F.col("bench")), F.when(both, F.col("ret"))
    slope = F.when((F.count(x).over(past) >= 3) & (F.var_samp(x).over(past) > 1e-24), F.covar_samp(y, x).over(past) / F.var_samp(x).over(past)).otherwise(1.0)
    later = F.when(F.count(F.lit(1)).over(ahead) == horizon, F.exp(F.sum(F.log1p("bench")).over(ahead)) - 1)
    rows = bars.withColumns({"beta": slope, "fwd": ratio(F.lead("close", horizon).over(w), F.col("close")) - 1, "__b": later})
    return rows.withColumn("resid", F.col("fwd") - F.col("beta") * F.col("__b")).drop("__b")


def alphas(panel: DataFrame, *, scaling: str = "case1", ic: float = 0.05, scale: DataFrame | None = None) -> DataFrame:
    """(ts, symbol, score, exposure, vol) -> with alpha, for every ts at once: refined scores times ic and the residual volatility (case1), or ic and the constant of the ts (case2).

    scale: (ts, scale) for case2; a ts without one is scaled as in case1.
    """
    if scaling == "case1":
        return refine(panel, ic=ic)
    joined = panel.join(scale, "ts", "left").withColumn("__vol", F.coalesce("scale", "vol"))
    return refine(joined, vol="__vol", ic=ic).drop("__vol", "scale")


def alpha_table(panel: DataFrame, n: int, **how) -> DataFrame:
    """The n largest alphas of each ts by size, with rank, score and vol."""
    return top(alphas(panel, **how).where("alpha is not null").select("ts", "symbol", "score", "vol", "alpha", "thin"), "alpha", n)


def paper_books(panel: DataFrame) -> DataFrame:
    """(ts, symbol, alpha, resid) -> ts, names, ic, rank_ic, book: the coefficients, and the return of weights (alpha - mean) / deviation.

    Only rows with both and cross-sections of LEAST_NAMES; a flat alpha has no book and no
    coefficient.
    """
    both = panel.where("alpha is not null and resid is not null").withColumn("__n", F.count("*").over(at())).where(F.col("__n") >= LEAST_NAMES)
    ranked = both.withColumns({"__ra": average_rank(F.col("alpha")), "__rr": average_rank(F.col("resid"))})
    flat = is_flat(F.stddev_samp("alpha"), F.avg(F.abs("alpha")))
    still = flat | is_flat(F.stddev_samp("resid"), F.avg(F.abs("resid")))
    book = ratio(F.covar_pop("alpha", "resid") * F.count("*"), F.stddev_samp("alpha"))
    return ranked.groupBy("ts").agg(F.count("*").alias("names"), F.when(~still, F.corr("alpha", "resid")).alias("ic"), F.when(~still, F.corr("__ra", "__rr")).alias("rank_ic"), F.when(~flat, book).alias("book"))


def information_report(books: DataFrame, *, per_year: float, years: float, horizon: int = 1, spacing: float = 1.0, rho: Column | None = None, n_trials: int = 1) -> DataFrame:
    """paper_books -> one row: coefficients and their t statistics, breadth, predicted and realised information ratio with its error, the shrinkage of the alpha level, and warnings.

    rho: mean residual correlation; without one neither breadth nor a predicted ratio is given.
    Realised deviations are of the population.
    """
    rho = F.lit(None).cast("double") if rho is None else rho
    t_of = lambda c: ratio(F.avg(c) * F.sqrt(F.count(c)), F.stddev_samp(c))
    base = books.agg(
        F.count("ic").alias("periods"), F.avg("ic").alias("mean_ic"), F.stddev_samp("ic").alias("ic_vol"), t_of("ic").alias("ic_tstat"), F.avg("rank_ic").alias("mean_rank_ic"), t_of("rank_ic").alias("rank_ic_tstat"),
        F.floor(F.median("names")).alias("n_names"), F.coalesce(ratio(F.avg("book"), F.stddev_pop("book")) * math.sqrt(per_year), F.lit(0.0)).alias("realized_ir"),
    )
    names = F.coalesce("n_names", F.lit(0))
    breadth = F.when(rho.isNotNull(), effective_breadth(names, F.lit(per_year), rho))
    t_eff = F.col("periods") / max(1.0, horizon / max(spacing, 1e-9))
    g = t_eff * F.col("mean_ic") * F.col("mean_ic")
    error = F.sqrt((1 + F.col("realized_ir") * F.col("realized_ir") / 2) / years) if years > 0 else F.lit(float("inf"))
    return base.withColumns({
        "breadth": breadth, "breadth_naive": names * per_year, "predicted_ir": F.col("mean_ic") * F.sqrt(F.greatest(breadth, F.lit(0.0))), "ir_error": error, "t_eff": t_eff,
        "level_shrink": F.coalesce(F.when(g > 0, g / (g + 1)), F.lit(0.0)), "inflation": F.lit(1 - 0.95 ** max(n_trials, 0)), "low_sample": F.col("periods") < LEAST_PERIODS, "too_good": F.abs("realized_ir") > 2,
    })


def scaling_comparison(panel: DataFrame, scale: DataFrame, *, per_year: float, ic: float = 0.05) -> DataFrame:
    """scaling, periods, mean_ic, realized_ir of the paper books of the same scores under case 1 and case 2."""
    each = [paper_books(alphas(panel, scaling=case, ic=ic, scale=scale)).withColumn("scaling", F.lit(case)) for case in ("case1", "case2")]
    return each[0].unionByName(each[1]).groupBy("scaling").agg(F.count("ic").alias("periods"), F.avg("ic").alias("mean_ic"), F.coalesce(ratio(F.avg("book"), F.stddev_pop("book")) * math.sqrt(per_year), F.lit(0.0)).alias("realized_ir"))


def case_test(scores: DataFrame, vols: DataFrame, *, price_derived: bool = True, least: int = 36, high: float = 0.25, low: float = 0.05, t_least: float = 2.0) -> DataFrame:
    """(ts, symbol, score) and (symbol, vol) -> one row: case, r2, t_stat, slope, n_obs, n_names, ambiguous, why.

    Each name's deviation of the score over time on its residual volatility: proportional means
    the volatility is already in the signal (case 2), unrelated means it is not (case 1), anything
    between or too little history the default (2 for price-derived signals).
    """
    default = 2 if price_derived else 1
    each = scores.groupBy("symbol").agg(F.stddev_samp("score").alias("y"), F.count("score").alias("n"))
    mid = each.agg(F.floor(F.median("n")).alias("n_obs"))
    rows = each.join(vols.select("symbol", F.col("vol").alias("x")), "symbol").where("x is not null and y is not null").join(F.broadcast(mid))
    used = F.col("n") >= F.least(F.lit(least), F.greatest("n_obs", F.lit(2)))
    x, y = F.when(used, F.col("x")), F.when(used, F.col("y"))
    fit = rows.agg(F.first("n_obs").alias("n_obs"), F.count(x).alias("n_names"), F.var_pop(x).alias("vx"), F.var_pop(y).alias("vy"), F.covar_pop(x, y).alias("c")).withColumn("n_obs", F.coalesce("n_obs", F.lit(0)))
    slope = F.when(F.col("vx") > 0, F.col("c") / F.col("vx"))
    r2 = F.coalesce(F.when(F.col("vy") > 0, slope * F.col("c") / F.col("vy")), F.lit(0.0))
    left = F.greatest(F.col("vy") - slope * F.col("c"), F.lit(0.0)) * F.col("n_names")
    error = F.when((F.col("n_names") > 2) & (left > 0), F.sqrt(left / (F.col("n_names") - 2) / (F.col("vx") * F.col("n_names"))))
    found = fit.select("n_obs", "n_names", "vx", F.coalesce(slope, F.lit(0.0)).alias("slope"), r2.alias("r2"), F.coalesce(slope / error, F.lit(0.0)).alias("t_stat"))
    short = (F.col("n_obs") < least) | (F.col("n_names") < 3)
    none = short | F.coalesce(F.col("vx") <= 0, F.lit(True))
    two = (F.col("r2") >= high) & (F.col("t_stat") >= t_least) & (F.col("slope") > 0)
    why = F.when(short, "insufficient history").when(none, "no dispersion").when(two, "proportional").when(F.col("r2") <= low, "unrelated").otherwise("ambiguous")
    blank = lambda c: F.when(none, 0.0).otherwise(F.col(c)).alias(c)
    return found.select(F.when(none, default).when(two, 2).when(F.col("r2") <= low, 1).otherwise(default).alias("case"), blank("r2"), blank("t_stat"), blank("slope"), "n_obs", "n_names", (none | ~(two | (F.col("r2") <= low))).alias("ambiguous"), why.alias("why"))


def measured_signals(panel: DataFrame, names: list[str], *, ridge: float = 1e-4, least_names: int = LEAST_NAMES) -> DataFrame:
    """(ts, symbol, each signal, resid) -> signal, ic, shrunk_ic, weight, combined_ic, periods.

    Per ts the correlation of every pair of signals and of each with resid, over names that have
    all; then their means. The weights solve (correlation + ridge) w = shrunk coefficients, a
    system of as many rows as there are signals, on the driver. Without a measured ts all are 0.
    """
    whole = panel.dropna(subset=[*names, "resid"])
    pairs = [(a, b) for i, a in enumerate(names) for b in names[i + 1 :]]
    each = whole.groupBy("ts").agg(F.count("*").alias("__n"), *[F.corr(a, "resid").alias(f"__ic_{a}") for a in names], *[F.corr(a, b).alias(f"__c_{a}_{b}") for a, b in pairs]).where(F.col("__n") >= least_names)
    clean = lambda c: F.avg(F.when(~F.isnan(c), F.col(c)))
    m = each.agg(F.count("*").alias("periods"), *[clean(c).alias(c) for c in each.columns if c not in ("ts", "__n")]).first()
    ics = [m[f"__ic_{a}"] or 0.0 for a in names]
    gains = [m.periods * x * x for x in ics]
    shrunk = np.array([x * g / (g + 1) for x, g in zip(ics, gains, strict=True)])
    corr = np.eye(len(names))
    for a, b in pairs:
        i, j = names.index(a), names.index(b)
        corr[i, j] = corr[j, i] = m[f"__c_{a}_{b}"] or 0.0
    weights = np.linalg.solve(corr + ridge * np.eye(len(names)), shrunk) if m.periods else np.zeros(len(names))
    total = math.sqrt(max(float(shrunk @ weights), 0.0))
    rows = [(a, float(ics[i]), float(shrunk[i]), float(weights[i]), total, m.periods) for i, a in enumerate(names)]
    return panel.sparkSession.createDataFrame(rows, "signal string, ic double, shrunk_ic double, weight double, combined_ic double, periods long")


def alpha_memory(panel: DataFrame) -> DataFrame:
    """(ts, symbol, alpha) -> ts, n, corr: the correlation of each rebalance's alphas with the same names' at their one before; null under LEAST_NAMES pairs or if either is flat."""
    before = panel.withColumn("__p", F.lag("alpha").over(Window.partitionBy("symbol").orderBy("ts"))).where("alpha is not null and __p is not null")
    flat = is_flat(F.stddev_samp("alpha"), F.avg(F.abs("alpha"))) | is_flat(F.stddev_samp("__p"), F.avg(F.abs("__p")))
    return before.groupBy("ts").agg(F.count("*").alias("n"), F.when((F.count("*") >= LEAST_NAMES) & ~flat, F.corr("alpha", "__p")).alias("corr"))


def systematic_split(periods: DataFrame, keys: list[str], mu: float) -> DataFrame:
    """(keys, beta, bench) a row a period -> keys, n, expected, surprise, timing: what the mean active beta earned as expected, by the benchmark's surprise, and by its timing."""
    b, x, n = F.avg("beta"), F.avg("bench"), F.count("*")
    return periods.groupBy(*keys).agg(n.alias("n"), (b * mu * n).alias("expected"), (b * (x - mu) * n).alias("surprise"), (F.covar_pop("beta", "bench") * n).alias("timing"))


def blended_stats(values: DataFrame, keys: list[str], x: str, *, per_year: float, prior: float, t0: float) -> DataFrame:
    """keys, periods, mean, ann_mean, vol, ir, t_stat: the variance is the prior's, worth t0 periods, blended with the sample's; missing values are left out."""
    v = F.when(~F.isnan(x), F.col(x))
    n, mean = F.count(v), F.coalesce(F.avg(v), F.lit(0.0))
    own = F.when(n > 1, F.var_samp(v)).otherwise(prior)
    blend = F.when(n + t0 > 0, (prior * t0 + own * n) / (n + t0)).otherwise(prior)
    out = values.groupBy(*keys).agg(n.alias("periods"), mean.alias("mean"), F.sqrt(F.greatest(blend, F.lit(0.0))).alias("vol"))
    z = F.when(F.col("vol") > 0, F.col("mean") / F.col("vol"))
    return out.withColumns({"ann_mean": F.col("mean") * per_year, "ir": F.coalesce(z * math.sqrt(per_year), F.lit(0.0)), "t_stat": F.coalesce(z * F.sqrt("periods"), F.lit(0.0))})


def linked(periods: DataFrame, keys: list[str], order: str, components: list[str]) -> DataFrame:
    """(keys, order, active, portfolio, bench, components) -> keys, linked_* of each component, naive (compounded active), honest (difference of compounded returns), delta.

    A component of a period counts with the growth of the active returns before it. A loss of all
    or more leaves nothing to grow.
    """
    log = lambda c: F.log1p(F.greatest(F.col(c), F.lit(-1 + 1e-15)))
    w = Window.partitionBy(*keys).orderBy(order).rowsBetween(Window.unboundedPreceding, -1)
    grown = periods.withColumn("__g", F.exp(F.coalesce(F.sum(log("active")).over(w), F.lit(0.0))))
    all_of = lambda c: F.exp(F.sum(log(c)))
    out = grown.groupBy(*keys).agg(*[F.sum(F.col(c) * F.col("__g")).alias(f"linked_{c}") for c in components], (all_of("active") - 1).alias("naive"), (all_of("portfolio") - all_of("bench")).alias("honest"))
    return out.withColumn("delta", F.col("honest") - F.col("naive"))


def error_by_regime(periods: DataFrame, per_year: float, keys: list[str] | None = None) -> DataFrame:
    """(keys, variance, active, vol) a rebalance -> keys, regime, n, predicted_te, realized_te, gap by terciles of the benchmark's volatility; none for a book with under six known ones."""
    keys = keys or []
    known = periods.where("vol is not null and not isnan(vol)")
    cuts = known.groupBy(*keys).agg(F.count("*").alias("__n"), F.percentile("vol", F.lit(1 / 3)).alias("__a"), F.percentile("vol", F.lit(2 / 3)).alias("__b"))
    regime = F.when(F.col("vol") <= F.col("__a"), "low").when(F.col("vol") <= F.col("__b"), "mid").otherwise("high")
    # Without keys the cuts are one row.
    beside = known.join(cuts, keys) if keys else known.join(F.broadcast(cuts))
    rows = beside.where(F.col("__n") >= 6).groupBy(*keys, regime.alias("regime"))
    out = rows.agg(F.count("*").alias("n"), F.sqrt(F.greatest(F.avg("variance"), F.lit(0.0))).alias("predicted_te"), F.coalesce(F.stddev_samp("active") * math.sqrt(per_year), F.lit(0.0)).alias("realized_te"))
    return out.withColumn("gap", F.col("realized_te") - F.col("predicted_te"))


def factor_split(panel: DataFrame, fitted: DataFrame, factors: list[str]) -> DataFrame:
    """(ts, symbol, weight, factors, ret) and (ts, factor, ret) of the same ts -> ts, factor_return, specific_return: the book's exposures times the factors' returns, and the rest of its return."""
    exposures = panel.groupBy("ts").agg(F.sum(F.col("weight") * F.col("ret")).alias("total"), *[F.sum(F.col("weight") * F.col(f)).alias(f) for f in factors])
    long = exposures.select("ts", "total", F.explode(F.array(*[F.struct(F.lit(f).alias("factor"), F.col(f).alias("x")) for f in factors])).alias("e")).select("ts", "total", "e.*")
    own = fitted.select("ts", "factor", F.col("ret").alias("__f"))
    rows = long.join(own, ["ts", "factor"]).groupBy("ts", "total").agg(F.sum(F.col("x") * F.col("__f")).alias("factor_return"))
    return rows.select("ts", "factor_return", (F.col("total") - F.col("factor_return")).alias("specific_return"))
