"""What a run's trades, a sweep's scores and a record's returns say: distributions with what went unmeasured, exit paths, noise baselines, gradients, bootstrap skill."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from ..functions.scalars import ratio
from . import sweep
from .metrics import expected_max_sharpe, is_flat, sharpe

#: Objectives whose mean is 0 without skill, and the level of significance.
CENTRED, LEVEL = ("sharpe_ratio", "sortino_ratio", "information_ratio", "sharpe"), 0.05
#: Fixed value: returns under which a record cannot be resampled.
LEAST_RETURNS = 8


def measured(c: str) -> Column:
    """The value where it is a finite number, else null."""
    x = F.col(c).cast("double")
    return F.when(~F.isnan(x) & (F.abs(x) < float("inf")), x)


def distribution(rows: DataFrame, keys: list[str], column: str) -> DataFrame:
    """keys, n_measured, n_unmeasured, median, mean, p25, p75, p90, min, max: nulls where nothing was measured."""
    x = measured(column)
    at = lambda q, name: F.percentile(x, F.lit(q)).alias(name)
    return rows.groupBy(*keys).agg(F.count(x).alias("n_measured"), (F.count("*") - F.count(x)).alias("n_unmeasured"), at(0.5, "median"), F.avg(x).alias("mean"), at(0.25, "p25"), at(0.75, "p75"), at(0.9, "p90"), F.min(x).alias("min"), F.max(x).alias("max"))


def win_loss(trades: DataFrame, keys: list[str]) -> DataFrame:
    """keys, rows, trades (with a measured pnl), unmeasured, wins, losses, flat, win_rate (percent), net_pnl, gross_profit, gross_loss, avg_win, avg_loss, largest_win, largest_loss, expectancy, profit_factor, payoff_ratio; averages of nothing are null, sums of nothing 0."""
    p = measured("pnl")
    win, loss = F.when(p > 0, p), F.when(p < 0, p)
    some = F.count(p) > 0
    gain, cost = F.coalesce(F.sum(win), F.lit(0.0)), F.coalesce(-F.sum(loss), F.lit(0.0))
    up, down = F.coalesce(F.avg(win), F.lit(0.0)), F.coalesce(-F.avg(loss), F.lit(0.0))
    over = lambda a, b: F.when(some, F.when(b > 0, a / F.when(b > 0, b)).otherwise(F.when(a > 0, float("inf")).otherwise(0.0)))
    return trades.groupBy(*keys).agg(
        F.count("*").alias("rows"), F.count(p).alias("trades"), (F.count("*") - F.count(p)).alias("unmeasured"), F.count(win).alias("wins"), F.count(loss).alias("losses"), (F.count(p) - F.count(win) - F.count(loss)).alias("flat"),
        F.when(some, F.count(win) / F.count(p)).alias("win_rate"), F.sum(p).alias("net_pnl"), gain.alias("gross_profit"), (-cost).alias("gross_loss"), F.avg(win).alias("avg_win"), F.avg(loss).alias("avg_loss"), F.max(win).alias("largest_win"), F.min(loss).alias("largest_loss"),
        F.avg(p).alias("expectancy"), over(gain, cost).alias("profit_factor"), over(up, down).alias("payoff_ratio"),
    )


def exit_paths(trades: DataFrame, keys: list[str] | None = None) -> DataFrame:
    """win_loss of each exit reason of each key, with its place by net pnl, its share of the rows and of the gains (null for a loss), and whether most of the gain came by it.

    Null and empty reasons are '(unlabelled)'. The reasons of a key are few, so their places come from a window over them.
    """
    keys = keys or []
    reason = F.when(F.coalesce("exit_reason", F.lit("")) == "", "(unlabelled)").otherwise(F.col("exit_reason"))
    found = win_loss(trades.withColumn("exit_reason", reason), [*keys, "exit_reason"])
    own = Window.partitionBy(*keys)
    gain = F.when(F.col("net_pnl") > 0, F.col("net_pnl"))
    order = own.orderBy(F.col("net_pnl").desc_nulls_last(), "exit_reason")
    place = F.row_number().over(order)
    return found.withColumns({"place": place, "share_of_rows": F.col("rows") / F.sum("rows").over(own), "share_of_gain": ratio(gain, F.sum(gain).over(own))}).withColumn("top_gain", (F.col("place") == 1) & F.col("share_of_gain").isNotNull())


def durations(trades: DataFrame, keys: list[str]) -> DataFrame:
    """The distribution of days held; a trade without one of its times is unmeasured."""
    return distribution(trades.withColumn("days", (F.unix_micros("exit_time") - F.unix_micros("entry_time")) / 8.64e10), keys, "days")


class Partial(ValueError):
    """The trades are not, or not known to be, all of the run's."""


def trade_analytics(trades: DataFrame, keys: list[str], *, total_rows: int | None, allow_partial: bool = False) -> tuple[str, dict[str, DataFrame]]:
    """(complete or truncated, sections) of a run's trades: overall, exit_reasons, duration, mae_pct, mfe_pct, each where its columns are there.

    total_rows is how many trades the run made. With fewer at hand, or an unknown number, every
    total would be short, so it is refused unless allow_partial.
    """
    stored = trades.count()
    whole = total_rows is not None and stored >= total_rows
    if not whole and not allow_partial:
        raise Partial("how many trades the run made is not known" if total_rows is None else f"{stored} of the run's {total_rows} trades are at hand")
    has = set(trades.columns)
    sections = {}
    if "pnl" in has:
        sections["overall"] = win_loss(trades, keys)
    if {"pnl", "exit_reason"} <= has:
        sections["exit_reasons"] = exit_paths(trades, keys)
    if {"entry_time", "exit_time"} <= has:
        sections["duration"] = durations(trades, keys)
    sections |= {c: distribution(trades, keys, c) for c in ("mae_pct", "mfe_pct") if c in has}
    return "complete" if whole else "truncated", sections


# Sweeps


def score_summary(results: DataFrame, objective: str) -> DataFrame:
    """n, n_finite, n_dropped, median, mean, std, p25, p75, min, max, positive_rate of a sweep's scores: one row. Scores that are no finite numbers are counted, not taken as 0."""
    x = measured(objective)
    return results.agg(F.count("*").alias("n"), F.count(x).alias("n_finite"), (F.count("*") - F.count(x)).alias("n_dropped"), F.percentile(x, F.lit(0.5)).alias("median"), F.avg(x).alias("mean"), F.stddev_samp(x).alias("std"), F.percentile(x, F.lit(0.25)).alias("p25"), F.percentile(x, F.lit(0.75)).alias("p75"), F.min(x).alias("min"), F.max(x).alias("max"), F.avg((x > 0).cast("double")).alias("positive_rate"))


def noise_baseline(results: DataFrame, objective: str) -> DataFrame:
    """n_draws, dispersion, expected_best, observed_best, applicable, reason: what the best of so many independent draws without skill would score. Only for objectives that are 0 without skill, and for two different scores at least."""
    x = measured(objective)
    sums = results.agg(F.count(x).alias("n_draws"), F.var_samp(x).alias("v"), F.max(x).alias("observed_best"))
    centred = F.lit(objective in CENTRED)
    reason = F.when(~centred, "no null").when(F.col("n_draws") < 2, "under two points").when(F.col("v") <= 0, "no spread").otherwise("")
    good = reason == ""
    return sums.select("n_draws", F.when(good, F.sqrt("v")).alias("dispersion"), F.when(good, expected_max_sharpe(F.col("v"), F.col("n_draws"))).alias("expected_best"), "observed_best", good.alias("applicable"), reason.alias("reason"))


def gradients(results: DataFrame, parameters: list[str], objective: str) -> DataFrame:
    """param, value, n, positive, positive_rate, median, max for each value of each parameter that took two at least."""
    rows = results.select(measured(objective).alias("x"), F.explode(F.array(*[F.struct(F.lit(p).alias("param"), F.col(p).cast("double").alias("value")) for p in parameters])).alias("p")).where("x is not null")
    found = rows.groupBy(F.col("p.param").alias("param"), F.col("p.value").alias("value")).agg(F.count("*").alias("n"), F.count_if(F.col("x") > 0).alias("positive"), F.avg((F.col("x") > 0).cast("double")).alias("positive_rate"), F.median("x").alias("median"), F.max("x").alias("max"))
    return found.withColumn("__k", F.count("*").over(Window.partitionBy("param"))).where("__k >= 2").drop("__k")


def screen_report(results: DataFrame, parameters: list[str], objective: str) -> dict[str, DataFrame]:
    """distribution, baseline, best (the highest score, ties by parameters) and gradients of a sweep."""
    best = results.where(measured(objective).isNotNull()).orderBy(F.col(objective).desc(), *parameters).limit(1)
    return {"distribution": score_summary(results, objective), "baseline": noise_baseline(results, objective), "best": best, "gradients": gradients(results, parameters, objective)}


# Bootstrap skill


def bootstrap_null(series: DataFrame, samples: int = 2000, block: float | None = None, seed: int = 0, ppy: float = 252.0) -> DataFrame:
    """(i, ret), i from 0 without gaps -> observed, p_value, p_se, block_length, n_obs, p_half, p_double, flips, sufficient: one row.

    The null is the demeaned series in stationary blocks; p counts the observation itself. p at half
    and at twice the block length shows whether significance hangs on it (`flips`). Under 8 returns
    p is 1 and nothing is drawn.
    """
    n = series.count()
    if n < LEAST_RETURNS:
        return series.sparkSession.createDataFrame([(0.0, 1.0, 0.0, 0.0, n, None, None, False, False)], "observed double, p_value double, p_se double, block_length double, n_obs long, p_half double, p_double double, flips boolean, sufficient boolean")
    length = block if block is not None else sweep.block_length(series)
    runs = None
    for name, of in (("p_value", length), ("p_half", max(length / 2, 1.0)), ("p_double", 2 * length)):
        one = sweep.null_p_value(series, samples, of, seed, ppy).select("observed", F.lit(name).alias("run"), "p_value")
        runs = one if runs is None else runs.unionByName(one)
    p = lambda name: F.max(F.when(F.col("run") == name, F.col("p_value"))).alias(name)
    found = runs.agg(F.max("observed").alias("observed"), p("p_value"), p("p_half"), p("p_double"))
    low = lambda c: F.col(c) < LEVEL
    flips = (low("p_value") != low("p_half")) | (low("p_value") != low("p_double"))
    return found.select("observed", "p_value", F.sqrt(F.col("p_value") * (1 - F.col("p_value")) / samples).alias("p_se"), F.lit(float(length)).alias("block_length"), F.lit(n).cast("long").alias("n_obs"), "p_half", "p_double", flips.alias("flips"), F.lit(True).alias("sufficient"))


def skill_report(own: DataFrame, family: DataFrame | None = None, samples: int = 2000, block: float | None = None, seed: int = 0, ppy: float = 252.0) -> DataFrame:
    """bootstrap_null of a record beside family_p and a verdict: skill if both p values lie under 0.05 and do not flip, selection if only its own does, luck otherwise, unknown for too few returns.

    family: (trial_id, i, ret) of all trials on shared steps, of which the record is the best.
    """
    mine = bootstrap_null(own, samples, block, seed, ppy)
    if family is None:
        rows = mine.withColumn("family_p", F.lit(None).cast("double"))
    else:
        length = block if block is not None else sweep.block_length(own)
        rows = mine.join(F.broadcast(sweep.family_p_value(family, samples, length, seed, ppy).select(F.col("p_value").alias("family_p"))), how="left")
    good = (F.col("p_value") < LEVEL) & ~F.col("flips")
    verdict = F.when(~F.col("sufficient"), "unknown").when(~good, "luck").when(F.col("family_p").isNotNull() & (F.col("family_p") >= LEVEL), "selection").otherwise("skill")
    return rows.withColumn("verdict", verdict)


def yearly(series: DataFrame, keys: list[str], ppy: float) -> DataFrame:
    """keys, n, sharpe, flat of (keys, ret): what the reports are read against."""
    x = F.col("ret")
    return series.groupBy(*keys).agg(F.count(x).alias("n"), sharpe(x, ppy).alias("sharpe"), is_flat(F.stddev_samp(x), F.avg(F.abs(x))).alias("flat"))
