"""Cross-sectional operators: columns over all symbols of one ts."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from ..functions.scalars import finite, is_flat

THIN = 10


def at() -> Window:
    return Window.partitionBy("ts")


def zscore(x: Column) -> Column:
    """(x - mean) / population deviation; 0 in a flat cross-section, null where x is not finite."""
    x = finite(x)
    flat = is_flat(F.stddev_pop(x).over(at()), F.avg(F.abs(x)).over(at()))
    return F.when(x.isNotNull(), F.when(flat, 0.0).otherwise(F.try_divide(x - F.avg(x).over(at()), F.stddev_pop(x).over(at()))))


def winsorize(x: Column, low: float = 0.025, high: float = 0.975) -> Column:
    """x held between two linear quantiles."""
    x = finite(x)
    return F.when(x.isNotNull(), F.least(F.greatest(x, F.percentile(x, F.lit(low)).over(at())), F.percentile(x, F.lit(high)).over(at())))


def average_rank(x: Column) -> Column:
    """Rank from 1, ties sharing their mean rank, null where x is."""
    ordered, tied = Window.partitionBy("ts").orderBy(x.asc_nulls_last()), Window.partitionBy("ts", x)
    return F.when(x.isNotNull(), F.rank().over(ordered) + (F.count("*").over(tied) - 1) / 2)


def demean(x: Column) -> Column:
    x = finite(x)
    return x - F.avg(x).over(at())


def neutralize(x: Column, exposure: Column) -> Column:
    """Residual of x on an intercept and one exposure; x itself without an exposure, or with fewer than two valid names."""
    y = F.when(x.isNotNull(), exposure)
    n = F.count(F.when(y.isNotNull(), 1)).over(at())
    slope, cut = F.regr_slope(x, y).over(at()), F.regr_intercept(x, y).over(at())
    return F.when(y.isNull() | (n < 2) | slope.isNull(), x).otherwise(x - cut - slope * y)


def cap(x: Column, times: float = 3.0) -> Column:
    """x within +- times its population deviation; unchanged in a flat cross-section."""
    s = F.stddev_pop(x).over(at())
    return F.when(x.isNull() | is_flat(s, F.avg(F.abs(x)).over(at())), x).otherwise(F.least(F.greatest(x, -times * s), times * s))


def refine(panel: DataFrame, *, score: str = "score", exposure: str = "exposure", vol: str = "vol", ic: float = 0.05) -> DataFrame:
    """(ts, symbol, score, exposure, vol) -> with alpha: winsorised, standardised, neutralised, scaled by ic * vol, capped.

    A cross-section of fewer than THIN names is only demeaned, and flagged as thin.
    """
    n = F.count(finite(F.col(score))).over(at())
    step = panel.withColumns({"__thin": n < THIN, "__w": winsorize(F.col(score)), "__d": demean(F.col(score)), "__e": F.coalesce(finite(F.col(exposure)), F.lit(0.0))})
    step = step.withColumn("__z", zscore(F.col("__w")))
    step = step.withColumn("__r", neutralize(F.col("__z"), F.col("__e")))
    step = step.withColumn("__a", F.when(F.col("__thin"), F.col("__d")).otherwise(F.col("__r")) * ic * F.col(vol))
    return step.withColumn("alpha", F.when(F.col("__thin"), F.col("__a")).otherwise(cap(F.col("__a")))).withColumn("thin", F.col("__thin")).drop("__thin", "__w", "__d", "__e", "__z", "__r", "__a")


def combine(panel: DataFrame, weights: dict[str, float]) -> DataFrame:
    """panel with `combined`, the weighted sum of its signals' z-scores; a missing signal counts 0."""
    total = None
    for name, weight in weights.items():
        term = F.coalesce(zscore(F.col(name)), F.lit(0.0)) * weight
        total = term if total is None else total + term
    return panel.withColumn("combined", total)


def top(panel: DataFrame, by: str, n: int) -> DataFrame:
    """The n rows of each ts with the largest |by|, ties by symbol, with their rank."""
    w = Window.partitionBy("ts").orderBy(F.abs(by).desc_nulls_last(), "symbol")
    return panel.withColumn("rank", F.row_number().over(w)).where(F.col("rank") <= n)
