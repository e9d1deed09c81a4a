"""Walk-forward validation: configurations by fold, the summary over folds, and the promotion gates."""

from __future__ import annotations

from functools import reduce

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from ..functions.scalars import finite, ratio
from .metrics import sharpe
from .sweep import by_fold
from .timeseries import by, sma

# The gates of a promotable configuration.
GATES = {
    "min_oos_sharpe": 1.2,
    "min_oos_profit_factor": 1.3,
    "min_wfe": 0.4,
    "wfe_relaxed": 0.3,
    "max_dd_ratio": 1.5,
    "min_oos_trades": 100.0,
    "max_param_sensitivity_loss": 0.25,
    "min_deflated_sharpe": 0.5,
}


def crossover_returns(bars: DataFrame, configs: list[tuple[int, int]]) -> DataFrame:
    """(fast, slow) pairs -> ts, symbol, fast, slow, r, entered: the return of holding while the fast mean was above the slow one at the last close.

    Each mean is one window column, the configurations an array exploded after it.
    """
    means = {n: f"m{n}" for n in sorted({n for pair in configs for n in pair})}
    base = bars.withColumns({"ret": ratio(F.col("close"), F.lag("close").over(by())) - 1} | {c: sma(F.col("close"), n) for n, c in means.items()})
    above = base.withColumns({f"a{f}_{s}": (F.col(means[f]) > F.col(means[s])).cast("int") for f, s in configs})
    held = above.withColumns({f"h{f}_{s}": F.lag(f"a{f}_{s}").over(by()) for f, s in configs} | {f"p{f}_{s}": F.lag(f"a{f}_{s}", 2).over(by()) for f, s in configs})
    rows = F.array(*[F.struct(F.lit(f).alias("fast"), F.lit(s).alias("slow"), F.col(f"h{f}_{s}").alias("held"), F.col(f"p{f}_{s}").alias("before")) for f, s in configs])
    each = held.where("ret is not null").select("ts", "symbol", "ret", F.explode(rows).alias("c")).where("c.held is not null")
    entered = (F.col("c.held") == 1) & (F.coalesce("c.before", F.lit(0)) == 0)
    return each.select("ts", "symbol", F.col("c.fast").alias("fast"), F.col("c.slow").alias("slow"), (F.col("ret") * F.col("c.held")).alias("r"), entered.alias("entered"), "ret")


def scored(returns: DataFrame, keys: list[str], ppy: float = 252.0) -> DataFrame:
    """(keys, ts, r, entered, ret) -> keys, n, total, sharpe, profit_factor, max_drawdown, trades, benchmark: equal weight over symbols.

    The benchmark is the equal-weight return of all symbols over the same ts; profit_factor is of
    the book's returns, infinite without a loss.
    """
    book = returns.groupBy(*keys, "ts").agg(F.avg("r").alias("r"), F.count_if("entered").alias("entries"), F.avg("ret").alias("b"))
    growth = lambda x: F.ln(F.greatest(1 + x, F.lit(1e-12)))
    w = Window.partitionBy(*keys).orderBy("ts").rowsBetween(Window.unboundedPreceding, 0)
    curve = book.withColumn("level", F.sum(growth(F.col("r"))).over(w)).withColumn("peak", F.greatest(F.max("level").over(w), F.lit(0.0)))
    won, lost = F.sum(F.greatest("r", F.lit(0.0))), -F.sum(F.least("r", F.lit(0.0)))
    return curve.groupBy(*keys).agg(
        F.count("*").alias("n"), (F.exp(F.sum(growth(F.col("r")))) - 1).alias("total"), sharpe(F.col("r"), ppy).alias("sharpe"), F.when(lost > 0, won / lost).when(won > 0, float("inf")).otherwise(0.0).alias("profit_factor"),
        F.max(1 - F.exp(F.col("level") - F.col("peak"))).alias("max_drawdown"), F.sum("entries").alias("trades"), (F.exp(F.sum(growth(F.col("b")))) - 1).alias("benchmark"),
    )


def fold_results(returns: DataFrame, plan: DataFrame, params: list[str], *, objective: str = "sharpe", ppy: float = 252.0) -> DataFrame:
    """One row a fold: its best configuration in sample, with is_* and oos_* metrics.

    Returns carry their own warm-up, as they look back over all bars; what counts in a segment is
    what lies in it. A configuration needs a finite objective; ties go to the smaller parameters.
    """
    names = ["n", "total", "sharpe", "profit_factor", "max_drawdown", "trades", "benchmark"]
    rows = scored(by_fold(returns, plan), ["fold", "segment", *params], ppy)
    part = lambda segment, tag: rows.where(F.col("segment") == segment).select("fold", *params, *[F.col(c).alias(f"{tag}_{c}") for c in names])
    of = finite(F.col(f"is_{objective}"))
    best = part("is", "is").withColumn("__k", F.row_number().over(Window.partitionBy("fold").orderBy(of.desc_nulls_last(), *params))).where("__k = 1").drop("__k")
    return best.join(part("oos", "oos"), ["fold", *params], "left")


def fold_summary(folds: DataFrame, *, objective: str = "sharpe") -> DataFrame:
    """One row over folds: medians out of sample, efficiency (median, and ratio of means), degradation of each metric, excess over the benchmark, trades, folds.

    An efficiency only counts against a positive score in sample; without one it is 0.
    """
    filled = lambda c: F.coalesce(F.col(c).cast("double"), F.lit(0.0))
    mid = lambda c: F.coalesce(F.median(filled(c)), F.lit(0.0))
    mean = lambda c: F.avg(finite(filled(c)))
    inside = finite(F.col(f"is_{objective}"))
    each = F.when(inside > 0, filled(f"oos_{objective}") / inside)
    drops = [(mean(f"is_{c}") - mean(f"oos_{c}")).alias(f"degradation_{c}") for c in ("sharpe", "profit_factor", "max_drawdown", "total")]
    return folds.agg(
        F.count("*").alias("folds"), mid("oos_sharpe").alias("oos_sharpe"), mid("oos_profit_factor").alias("oos_profit_factor"), mid("oos_max_drawdown").alias("oos_drawdown"), mid("is_max_drawdown").alias("is_drawdown"),
        F.coalesce(F.median(each), F.lit(0.0)).alias("median_efficiency"), F.coalesce(F.when(mean(f"is_{objective}") > 0, mean(f"oos_{objective}") / mean(f"is_{objective}")), F.lit(0.0)).alias("efficiency"), *drops,
        F.median(F.col("oos_total") - F.col("oos_benchmark")).alias("median_excess"), F.coalesce(F.sum("oos_trades"), F.lit(0)).alias("oos_trades"),
    )


def trial_variance(sharpes: Column, ppy: float = 252.0) -> Column:
    """Variance of the trials' ratios in units of one period; null under two."""
    return F.var_samp(sharpes / F.sqrt(F.lit(ppy)))


def gates(summary: DataFrame, limits: dict[str, float] | None = None) -> DataFrame:
    """The summary row -> check, value, threshold, passed, promotable (whether all passed).

    Columns deflated_sharpe, sensitivity_loss and leakage_passed are checked where the summary
    has them with a value. A low efficiency passes at the relaxed bar if the ratio clears its own.
    """
    g = GATES | (limits or {})
    c = F.col
    row = lambda name, value, at, ok: F.struct(F.lit(name).alias("check"), value.cast("double").alias("value"), at.cast("double").alias("threshold"), ok.alias("passed"))
    floor = lambda name, key, value: row(name, c(value), F.lit(g[key]), c(value) >= g[key])
    most = g["max_dd_ratio"] * c("is_drawdown")
    checks = [
        floor("oos_sharpe", "min_oos_sharpe", "oos_sharpe"), floor("oos_profit_factor", "min_oos_profit_factor", "oos_profit_factor"),
        row("walk_forward_efficiency", c("median_efficiency"), F.lit(g["min_wfe"]), (c("median_efficiency") >= g["min_wfe"]) | ((c("oos_sharpe") >= g["min_oos_sharpe"]) & (c("median_efficiency") >= g["wfe_relaxed"]))),
        row("oos_drawdown_vs_is", c("oos_drawdown"), F.when(c("is_drawdown") == 0, float("inf")).otherwise(most), (c("oos_trades") > 0) & ((c("is_drawdown") == 0) | (c("oos_drawdown") <= most))),
        floor("min_oos_trades", "min_oos_trades", "oos_trades"),
    ]
    if "deflated_sharpe" in summary.columns:
        checks.append(row("deflated_sharpe", c("deflated_sharpe"), F.lit(g["min_deflated_sharpe"]), F.coalesce(c("deflated_sharpe") > g["min_deflated_sharpe"], F.lit(False))))
    if "sensitivity_loss" in summary.columns:
        checks.append(F.when(c("sensitivity_loss").isNotNull(), row("parameter_sensitivity", c("sensitivity_loss"), F.lit(g["max_param_sensitivity_loss"]), c("sensitivity_loss") <= g["max_param_sensitivity_loss"])))
    if "leakage_passed" in summary.columns:
        checks.append(F.when(c("leakage_passed").isNotNull(), row("leakage_probe", c("leakage_passed"), F.lit(1.0), c("leakage_passed"))))
    found = summary.select(F.array_compact(F.array(*checks)).alias("checks"))
    return found.select(F.inline("checks"), F.forall("checks", lambda x: x["passed"]).alias("promotable"))


def perturbed(best: dict[str, int], bounds: dict[str, tuple[int, int]], share: float = 0.1) -> list[dict[str, int]]:
    """best first, then each parameter moved down and up by the share, whole and within its bounds."""
    moved = [best | {name: int(round(min(max(best[name] * times, low), high)))} for name, (low, high) in bounds.items() for times in (1 - share, 1 + share)]
    return [best, *moved]


def sensitivity(scores: DataFrame, params: list[str], best: dict[str, int]) -> DataFrame:
    """(params, sharpe) of the best configuration and its neighbours -> base_sharpe, max_sharpe_loss (share of the base, 0 at least), neighbours."""
    own = reduce(lambda a, b: a & b, [F.col(p) == best[p] for p in params])
    base = F.max(F.when(own, F.col("sharpe")))
    worst = F.min(F.when(~own, F.col("sharpe")))
    return scores.agg(base.alias("base_sharpe"), F.greatest(F.coalesce(F.when(base != 0, (base - worst) / F.abs(base)), F.lit(0.0)), F.lit(0.0)).alias("max_sharpe_loss"), F.count_if(~own).alias("neighbours"))


def concat_trades(frames: list[DataFrame]) -> DataFrame:
    """Trades of all frames, columns matched by name and missing ones null, by exit time, then symbol and entry time."""
    return reduce(lambda a, b: a.unionByName(b, allowMissingColumns=True), frames).orderBy("exit_time", "symbol", "entry_time")
