"""Per-symbol time-series operators as window columns; all look back only."""

from __future__ import annotations

import math

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from ..functions.scalars import ratio

def by() -> Window:
    return Window.partitionBy("symbol").orderBy("ts")


def last(n: int) -> Window:
    """The current row and the n - 1 before it."""
    return by().rowsBetween(-(n - 1), 0)


def full(value: Column, of: Column, n: int) -> Column:
    """value where the window of n rows holds n values of `of`."""
    return F.when(F.count(of).over(last(n)) == n, value)


def sma(x: Column, n: int) -> Column:
    return full(F.avg(x).over(last(n)), x, n)


def rolling_std(x: Column, n: int, population: bool = False) -> Column:
    return full((F.stddev_pop if population else F.stddev_samp)(x).over(last(n)), x, n)


def ema(x: Column, span: int) -> Column:
    """Exponential mean seeded on the first value, nulls skipped.

    The recursion runs over as many bars as carry weight in double precision, so a row costs the
    same however long the series is.
    """
    alpha = 2 / (span + 1)
    reach = math.ceil(36.8 / -math.log(1 - alpha))
    values = F.collect_list(x).over(last(reach))
    return F.when(F.size(values) > 0, F.aggregate(F.slice(values, 2, reach), values[0], lambda e, v: e * (1 - alpha) + v * alpha))


def simple_return(x: Column) -> Column:
    return ratio(x, F.lag(x).over(by())) - 1


def true_range(high: Column, low: Column, close: Column) -> Column:
    before = F.lag(close).over(by())
    return F.greatest(high - low, F.abs(high - before), F.abs(low - before))


def drawdown(equity: Column, keys: Window | None = None) -> Column:
    """Share below the highest value so far, 0 or negative."""
    return ratio(equity, F.max(equity).over((keys or by()).rowsBetween(Window.unboundedPreceding, 0))) - 1


def indicators(bars: DataFrame, *, n: int = 20, rsi_n: int = 14) -> DataFrame:
    """bars with sma, ema, ret, rsi, atr, z, donchian, adv, ret_vol, spike and drawdown columns.

    Two narrow steps, since a window cannot stand inside a window: all share one partitioning.
    """
    close, volume = F.col("close"), F.col("volume")
    move = close - F.lag(close).over(by())
    steps = bars.withColumns(
        {
            "ret": simple_return(close),
            "__gain": F.when(move.isNotNull(), F.greatest(move, F.lit(0.0))),
            "__loss": F.when(move.isNotNull(), F.greatest(-move, F.lit(0.0))),
            "__range": true_range(F.col("high"), F.col("low"), close),
        }
    )
    gain, loss = (F.when(F.count(c).over(last(rsi_n)) == rsi_n, F.avg(c).over(last(rsi_n))) for c in ("__gain", "__loss"))
    prior = by().rowsBetween(-n, -1)
    mean_volume, std = sma(volume, n), rolling_std(close, n, population=True)
    return steps.withColumns(
        {
            "sma": sma(close, n),
            "ema": ema(close, n),
            "rsi": F.when(loss > 0, 100 - 100 / (1 + gain / loss)).when(gain > 0, 100.0),
            "atr": sma(F.col("__range"), rsi_n),
            "z": F.when(std > 1e-12, (close - sma(close, n)) / std),
            "donchian": F.when(F.count("high").over(prior) == n, F.max("high").over(prior)),
            "adv": F.when(F.count("*").over(prior) == n, F.avg(close * volume).over(prior)),
            "ret_vol": F.when(F.count("ret").over(prior) == n, F.stddev_samp("ret").over(prior)),
            "spike": F.coalesce((volume > 1.5 * mean_volume) & (F.abs("ret") > 0.01), F.lit(False)),
            "drawdown": drawdown(close),
        }
    ).drop("__gain", "__loss", "__range")


def latest(bars: DataFrame) -> DataFrame:
    """The last row of each symbol."""
    rest = [c for c in bars.columns if c != "symbol"]
    return bars.groupBy("symbol").agg(F.max_by(F.struct(*rest), "ts").alias("r")).select("symbol", "r.*")


def streaks(flags: DataFrame, keys: list[str], order: str, flag: str) -> DataFrame:
    """Longest run of true and of false rows of each key: gaps and islands."""
    w = Window.partitionBy(*keys).orderBy(order)
    runs = flags.withColumn("island", F.row_number().over(w) - F.row_number().over(Window.partitionBy(*keys, flag).orderBy(order))).groupBy(*keys, flag, "island").count()
    return runs.groupBy(*keys).agg(*[F.coalesce(F.max(F.when(F.col(flag) == v, F.col("count"))), F.lit(0)).alias(f"longest_{str(v).lower()}") for v in (True, False)])


def held_direction(score: Column, enter: float, leave: float) -> Column:
    """Long-only hysteresis: 1 from a score above enter until one at or under leave; other scores hold."""
    return F.coalesce(F.last(F.when(score > enter, 1).when(score <= leave, 0), ignorenulls=True).over(by().rowsBetween(Window.unboundedPreceding, 0)), F.lit(0))


def ewma_variance(returns: DataFrame, *, decay: float = 0.94, seed_rows: int = 20) -> DataFrame:
    """Last exponentially weighted variance of each symbol, seeded with the mean of its first squares: symbol, variance. A symbol with fewer than seed_rows returns has none."""
    w = Window.partitionBy("symbol").orderBy("ts")
    rows = returns.where("ret is not null").select("symbol", F.pow("ret", 2).alias("q"), F.row_number().over(w).alias("i"), F.count("*").over(Window.partitionBy("symbol")).alias("n"))
    m = F.lit(seed_rows)
    return rows.where(F.col("n") >= seed_rows).groupBy("symbol").agg(
        (
            F.avg(F.when(F.col("i") <= m, F.col("q"))) * F.first(F.pow(F.lit(decay), F.col("n") - m))
            + F.coalesce(F.sum(F.when(F.col("i") > m, (1 - decay) * F.pow(F.lit(decay), F.col("n") - F.col("i")) * F.col("q"))), F.lit(0.0))
        ).alias("variance")
    )
