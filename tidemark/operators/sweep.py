"""Parameter grids, folds and resampling as tables joined to bars or returns."""

from __future__ import annotations

import math
from datetime import datetime, timedelta

from pyspark.sql import Column, DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from ..functions.scalars import FLAT, ratio
from .metrics import sharpe


def grid(spark: SparkSession, ranges: dict[str, tuple[float, float, float]], valid: Column | None = None) -> DataFrame:
    """Every step-aligned combination of (low, high, step), both ends included, that is valid."""
    out = spark.range(1).select()
    for name, (low, high, step) in ranges.items():
        values = spark.range(int(math.floor((high - low) / step + 1e-9)) + 1).select((F.lit(low) + F.col("id") * step).alias(name))
        out = out.crossJoin(values)
    return out if valid is None else out.where(valid)


def sample(configs: DataFrame, n: int, seed: int = 0) -> DataFrame:
    """n configurations without replacement, the same for the same seed."""
    return configs.orderBy(F.xxhash64(*configs.columns, F.lit(seed))).limit(n)


def crossover_sweep(bars: DataFrame, fasts: list[int], slows: list[int], ppy: float = 252.0) -> DataFrame:
    """fast, slow, n, total, sharpe of holding a symbol while its fast mean was above its slow one at the last close, equally over symbols.

    Each mean is computed once for all configurations that use it, in one window pass; the
    configurations are then rows of an array, so bars are never joined with the grid.
    """
    from .timeseries import by, sma

    means = {n: f"m{n}" for n in sorted({*fasts, *slows})}
    base = bars.withColumns({"ret": ratio(F.col("close"), F.lag("close").over(by())) - 1} | {c: sma(F.col("close"), n) for n, c in means.items()})
    held = {f"h{f}_{s}": F.lag((F.col(means[f]) > F.col(means[s])).cast("double")).over(by()) for f in fasts for s in slows if f < s}
    rows = base.withColumns(held).where("ret is not null")
    configs = F.array(*[F.struct(F.lit(f).alias("fast"), F.lit(s).alias("slow"), F.col(f"h{f}_{s}").alias("held")) for f in fasts for s in slows if f < s])
    each = rows.select("ts", "ret", F.explode(configs).alias("c")).where("c.held is not null").select("ts", F.col("c.fast").alias("fast"), F.col("c.slow").alias("slow"), (F.col("ret") * F.col("c.held")).alias("r"))
    book = each.groupBy("fast", "slow", "ts").agg(F.avg("r").alias("r"))
    return book.groupBy("fast", "slow").agg(F.count("*").alias("n"), F.sum("r").alias("total"), sharpe(F.col("r"), ppy).alias("sharpe"))


def ranked(results: DataFrame, objective: str, params: list[str]) -> DataFrame:
    """Finite objectives first and best first, ties by parameters."""
    good = F.col(objective).isNotNull() & ~F.isnan(objective) & (F.abs(objective) != F.lit(float("inf")))
    return results.withColumn("rank", F.row_number().over(Window.orderBy(good.desc(), F.when(good, F.col(objective)).desc_nulls_last(), *params)))


def folds(spark: SparkSession, start: datetime, end: datetime, *, train_days: int, test_days: int, embargo_days: int = 0, anchored: bool = False) -> DataFrame:
    """fold, segment (is, oos), start, end (exclusive): a handful of rows planned on the driver."""
    rows, k, at = [], 0, start
    while at + timedelta(days=train_days + embargo_days + test_days) <= end:
        train_end = at + timedelta(days=train_days)
        test = train_end + timedelta(days=embargo_days)
        rows += [(k, "is", start if anchored else at, train_end), (k, "oos", test, test + timedelta(days=test_days))]
        k, at = k + 1, at + timedelta(days=test_days)
    return spark.createDataFrame(rows, "fold int, segment string, start timestamp, end timestamp")


def fold_plan(start: datetime, end: datetime, *, anchored: bool = True, n_folds: int = 4, train_days: int | None = None, test_days: int | None = None, embargo_days: int = 0, holdout_days: int = 0) -> list[tuple]:
    """(fold, segment, start, end) with end exclusive, for `folds_table`: is and oos of each fold, and one holdout of fold null.

    The holdout is the end of the span and no fold reaches into it. Without train_days and
    test_days both are what n_folds of equal length leave; one alone is refused, as is a span that
    holds no fold.
    """
    if (train_days is None) != (test_days is None):
        raise ValueError("train_days and test_days go together")
    last = end - timedelta(days=holdout_days)
    span = (last - start).days
    if span <= embargo_days:
        raise ValueError(f"{span} days are too short for an embargo of {embargo_days}")
    if train_days is None or test_days is None:
        train_days = test_days = max((span - embargo_days) // (n_folds + 1), 1)
    plan, cut = [], start + timedelta(days=train_days)
    while (test := cut + timedelta(days=embargo_days)) + timedelta(days=test_days) <= last:
        k = len(plan) // 2
        plan += [(k, "is", start if anchored else cut - timedelta(days=train_days), cut), (k, "oos", test, test + timedelta(days=test_days))]
        cut += timedelta(days=test_days)
    if not plan:
        raise ValueError("no fold fits the span")
    return plan + ([(None, "holdout", last, end)] if holdout_days else [])


def folds_table(spark: SparkSession, plan: list[tuple]) -> DataFrame:
    return spark.createDataFrame(plan, "fold int, segment string, start timestamp, end timestamp")


def by_fold(rows: DataFrame, plan: DataFrame) -> DataFrame:
    """rows with the folds and segments they fall in; the plan is small and broadcast."""
    return rows.join(F.broadcast(plan), (F.col("ts") >= F.col("start")) & (F.col("ts") < F.col("end"))).drop("start", "end")


def overfit_share(scores: DataFrame) -> DataFrame:
    """(fold, is_score, oos_score), one row a fold -> pbo, splits: the share of all choices of half the folds whose best fold in sample ends under the median out of sample of the others.

    A choice is a bit mask over the numbered folds, so all of them are one range joined to the
    folds; 24 folds at most (16.8 million masks). Ties in sample go to the earlier fold; missing
    scores are 0 and infinite ones a million. Under four folds pbo is null and splits is 0.
    """
    known = scores.select("fold", *[F.when(F.isnan(c) | F.col(c).isNull(), 0.0).otherwise(F.greatest(F.lit(-1e6), F.least(F.lit(1e6), F.col(c)))).alias(c) for c in ("is_score", "oos_score")])
    n = known.count()
    if n > 24:
        raise ValueError(f"{n} folds; 24 are the most")
    placed = F.broadcast(known.withColumn("bit", F.row_number().over(Window.orderBy("fold")) - 1))
    masks = scores.sparkSession.range(1 << n if n >= 4 else 0).where(F.bit_count("id") == n // 2)
    inside = F.getbit("id", F.col("bit")) == 1
    each = masks.join(placed).groupBy("id").agg(F.max_by(F.when(inside, F.col("oos_score")), F.when(inside, F.struct("is_score", -F.col("bit")))).alias("chosen"), F.median(F.when(~inside, F.col("oos_score"))).alias("middle"))
    return each.agg(F.avg((F.col("chosen") < F.col("middle")).cast("double")).alias("pbo"), F.count("*").alias("splits"))


def stationary_steps(index: DataFrame, samples: int, block: float, seed: int = 0) -> DataFrame:
    """(i) from 0 without gaps -> sample, i: circular blocks of geometric length.

    A step starts a new block with probability 1 / block; its place follows from the last start,
    so that the indices are a window, not a recursion. Resamples are independent keys.
    """
    n = index.count()
    uniform = lambda tag: F.pmod(F.xxhash64("sample", "step", F.lit(tag), F.lit(seed)), F.lit(1 << 52)) / float(1 << 52)
    steps = index.sparkSession.range(samples).select(F.col("id").alias("sample"), F.explode(F.sequence(F.lit(0), F.lit(max(n - 1, 0)))).alias("step"))
    starts = (F.col("step") == 0) | (uniform("new") < 1 / block)
    w = Window.partitionBy("sample").orderBy("step").rowsBetween(Window.unboundedPreceding, 0)
    placed = steps.withColumn("s", F.last(F.when(starts, F.struct(F.floor(uniform("at") * n).alias("fresh"), F.col("step").alias("since"))), ignorenulls=True).over(w))
    return placed.select("sample", F.pmod(F.col("s.fresh") + F.col("step") - F.col("s.since"), F.lit(max(n, 1))).alias("i"))


def stationary_bootstrap(series: DataFrame, samples: int, block: float, seed: int = 0, ppy: float = 252.0) -> DataFrame:
    """(i, ret), i from 0 -> sample, sharpe of each resample."""
    drawn = stationary_steps(series.select("i"), samples, block, seed)
    return drawn.join(series, "i").groupBy("sample").agg(sharpe(F.col("ret"), ppy).alias("sharpe"), F.count("*").alias("n"))


def null_p_value(series: DataFrame, samples: int, block: float, seed: int = 0, ppy: float = 252.0) -> DataFrame:
    """(i, ret) -> observed Sharpe ratio and the share of resamples of the demeaned series that reach it, counted with the observation itself."""
    centred = series.select("i", (F.col("ret") - F.avg("ret").over(Window.partitionBy())).alias("ret"))
    seen = series.agg(sharpe(F.col("ret"), ppy).alias("observed"))
    drawn = stationary_bootstrap(centred, samples, block, seed, ppy)
    return drawn.crossJoin(F.broadcast(seen)).groupBy("observed").agg(((F.count_if(F.col("sharpe") >= F.col("observed")) + 1) / (F.count("*") + 1)).alias("p_value"))


def family_p_value(series: DataFrame, samples: int, block: float, seed: int = 0, ppy: float = 252.0) -> DataFrame:
    """(trial_id, i, ret) on shared steps -> best observed ratio and its p value against the best of each resample.

    All trials of a resample use the same steps, so that their dependence is kept.
    """
    w = Window.partitionBy("trial_id")
    centred = series.select("trial_id", "i", (F.col("ret") - F.avg("ret").over(w)).alias("ret"))
    best = series.groupBy("trial_id").agg(sharpe(F.col("ret"), ppy).alias("s")).agg(F.max("s").alias("observed"))
    steps = stationary_steps(series.select("i").distinct(), samples, block, seed)
    each = steps.join(centred, "i").groupBy("sample", "trial_id").agg(sharpe(F.col("ret"), ppy).alias("s")).groupBy("sample").agg(F.max("s").alias("m"))
    return each.crossJoin(F.broadcast(best)).groupBy("observed").agg(((F.count_if(F.col("m") >= F.col("observed")) + 1) / (F.count("*") + 1)).alias("p_value"))


def block_length(series: DataFrame, most_lag: int = 100) -> float:
    """Mean block length for the stationary bootstrap of (i, ret), i from 0 without gaps (flat-top rule of Politis and White, 2004).

    Under 20 rows it is a quarter of them, 1 at least; without variance 1. Lags go up to half the
    series and most_lag. Autocovariances come from a join of each row with those most_lag after
    it, so no task holds the series; the rule over them runs on the driver.
    """
    first = series.agg(F.count("ret").alias("n"), F.avg("ret").alias("mean"), F.var_pop("ret").alias("v"), F.avg(F.abs("ret")).alias("level")).first()
    n = first.n
    if n < 20:
        return max(n / 4, 1.0)
    if math.sqrt(max(first.v, 0.0)) <= FLAT * max(1.0, first.level):
        return 1.0
    reach = min(n // 2, most_lag)
    x = series.where("ret is not null").select("i", (F.col("ret") - first.mean).alias("x"))
    ahead = x.select(F.explode(F.sequence(F.lit(1), F.lit(reach))).alias("k"), F.col("i").alias("j"), F.col("x").alias("y")).withColumn("i", F.col("j") + F.col("k"))
    sums = {r.k: r.s for r in ahead.join(x, "i").groupBy("k").agg(F.sum(F.col("x") * F.col("y")).alias("s")).collect()}
    rho = [1.0, *[sums.get(k, 0.0) / n / first.v for k in range(1, reach + 1)]]
    # The first lag from which on enough lags in a row lie within the band.
    quiet, band = max(5, math.ceil(math.sqrt(math.log10(n)))), 2 * math.sqrt(math.log10(n) / n)
    m = next((k for k in range(1, max(reach - quiet + 1, 2)) if all(abs(r) < band for r in rho[k : k + quiet])), reach)
    width = min(max(2 * m, 1), reach)
    weight = {k: min(1.0, 2 * (1 - k / width)) for k in range(1, width + 1)}
    slope = 2 * sum(w * k * rho[k] for k, w in weight.items())
    spectrum = 1 + 2 * sum(w * rho[k] for k, w in weight.items())
    if spectrum <= 0:
        return float(max(width, 1))
    return min(max((slope / spectrum) ** 2 * n, 0.0) ** (1 / 3), max(n // 4, 1)) if slope and (slope / spectrum) ** 2 * n > 1 else 1.0
