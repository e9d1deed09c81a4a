"""Equity by business day from closed trades, the trade half of a metric row, and block resamples of daily profit."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from ..functions.scalars import ratio
from .metrics import metric_row, trade_metrics

#: Trades under which a sample is low, and trading days a year.
LOW_SAMPLE, DAYS_PER_YEAR = 30, 252


def business_day(ts: Column) -> Column:
    """The day of ts, Saturdays and Sundays as the Friday before."""
    day = F.to_date(ts)
    return F.date_sub(day, F.greatest(F.weekday(day) - 4, F.lit(0)))


def dated_equity(trades: DataFrame, keys: list[str], capital: float) -> DataFrame:
    """(keys, exit_time, pnl) -> keys, ts, pnl, equity: one row a business day from the first exit to the last, and before them the capital on the business day before. Days without an exit hold. Trades without an exit time are left out, null profits count 0."""
    daily = trades.where("exit_time is not null").groupBy(*keys, business_day(F.col("exit_time")).alias("day")).agg(F.coalesce(F.sum("pnl"), F.lit(0.0)).alias("pnl"))
    span = daily.groupBy(*keys).agg(F.min("day").alias("__first"), F.max("day").alias("__last"))
    before = F.date_sub("__first", F.when(F.weekday("__first") == 0, 3).otherwise(1))
    calendar = span.select(*keys, F.explode(F.filter(F.sequence(before, F.col("__last")), lambda d: F.weekday(d) < 5)).alias("day"))
    a, b = calendar.alias("a"), daily.alias("b")
    on = F.col("a.day") == F.col("b.day")
    for k in keys:
        on &= F.col(f"a.{k}").eqNullSafe(F.col(f"b.{k}"))
    rows = a.join(b, on, "left").select(*[f"a.{k}" for k in keys], F.col("a.day").cast("timestamp").alias("ts"), F.coalesce("b.pnl", F.lit(0.0)).alias("pnl"))
    return rows.withColumn("equity", capital + F.sum("pnl").over(Window.partitionBy(*keys).orderBy("ts").rowsBetween(Window.unboundedPreceding, 0)))


def exposure(trades: DataFrame, keys: list[str], start: str, end: str) -> DataFrame:
    """keys, exposure: the share of the window that the union of holdings covers, 1 at most; 0 for a window without length."""
    # Of the trades that begin together the last to end covers the others.
    held = trades.where("entry_time is not null and exit_time is not null").groupBy(*keys, "entry_time").agg(F.max("exit_time").alias("exit_time"))
    w = Window.partitionBy(*keys).orderBy("entry_time")
    top = F.max("exit_time").over(w.rowsBetween(Window.unboundedPreceding, -1))
    micros = F.unix_micros
    new = F.greatest(micros("exit_time") - F.greatest(micros("entry_time"), F.coalesce(micros(top), micros("entry_time"))), F.lit(0))
    total = F.unix_timestamp(F.lit(end).cast("timestamp")) - F.unix_timestamp(F.lit(start).cast("timestamp"))
    covered = held.withColumn("__new", new).groupBy(*keys).agg((F.sum("__new") / 1e6).alias("__c"))
    return covered.select(*keys, F.when(total > 0, F.least(F.col("__c") / total, F.lit(1.0))).otherwise(0.0).alias("exposure"))


def buy_and_hold(bars: DataFrame, keys: list[str]) -> DataFrame:
    """(keys, symbol, ts, open, close) -> keys, buy_hold: the mean over symbols of the percent from the first open to the last close."""
    own = bars.groupBy(*dict.fromkeys([*keys, "symbol"])).agg(F.min_by("open", "ts").alias("o"), F.max_by("close", "ts").alias("c"))
    return own.groupBy(*keys).agg(F.coalesce(F.avg(F.when(F.col("o") != 0, (F.col("c") / F.col("o") - 1) * 100)), F.lit(0.0)).alias("buy_hold"))


def streaks(trades: DataFrame, keys: list[str], order: str = "exit_time") -> DataFrame:
    """keys, max_wins, max_losses: the longest stretches of trades with and of those without profit, by the instant `order` and then all other columns; a missing or zero profit ends both.

    A key's trades are cut into months of `order`, each numbered by itself; only a month's first
    and last stretch meet those of other months.
    """
    cut = [*keys, "__piece"]
    rows = trades.withColumns({"__piece": F.date_trunc("month", F.col(order)), "__s": F.signum("pnl")})
    w = Window.partitionBy(*cut).orderBy(order, *sorted(c for c in trades.columns if c not in (order, *keys)))
    changes = F.coalesce((F.col("__s") != F.lag("__s").over(w)).cast("int"), F.lit(1))
    runs = rows.withColumn("__new", changes).withColumn("__run", F.sum("__new").over(w.rowsBetween(Window.unboundedPreceding, 0))).groupBy(*cut, "__run", "__s").agg(F.count("*").alias("n"))
    best = lambda v: F.max(F.when(F.col("__s") == v, F.col("n")))
    end = lambda of, pos: F.struct(F.lit(pos).alias("pos"), of(F.struct("__s", "n"), "__run").alias("run"))
    pieces = runs.groupBy(*cut).agg(best(1).alias("w"), best(-1).alias("l"), F.count("*").alias("k"), end(F.min_by, 0).alias("first"), end(F.max_by, 1).alias("last"))
    ends = pieces.withColumn("e", F.explode(F.when(F.col("k") == 1, F.array("first")).otherwise(F.array("first", "last")))).select(*cut, "w", "l", "e.pos", F.col("e.run.__s").alias("__s"), F.col("e.run.n").alias("n"))
    over = Window.partitionBy(*keys).orderBy("__piece", "pos")
    # A last stretch is never the first of its month, whatever their signs.
    opens = F.when(F.col("pos") == 1, 1).otherwise(F.coalesce((F.col("__s") != F.lag("__s").over(over)).cast("int"), F.lit(1)))
    joined = ends.withColumn("__new", opens).withColumn("__run", F.sum("__new").over(over.rowsBetween(Window.unboundedPreceding, 0))).groupBy(*keys, "__run", "__s").agg(F.sum("n").alias("n"), F.max("w").alias("w"), F.max("l").alias("l"))
    longest = lambda v, own: F.greatest(F.coalesce(best(v), F.lit(0)), F.coalesce(F.max(own), F.lit(0)))
    return joined.groupBy(*keys).agg(longest(1, "w").alias("max_wins"), longest(-1, "l").alias("max_losses"))


def trade_row(trades: DataFrame, keys: list[str], *, capital: float, start: str, end: str, order: str = "exit_time") -> DataFrame:
    """keys, entry_time, exit_time, entry_price, size, pnl, mae_pct, mfe_pct (the last two may be missing) -> the trade half of a metric row, one row for each key.

    Percents are of 100. Streaks go by `order` and then by all other columns; a trade without
    profit ends a streak of either kind. low_sample marks keys with under 30 trades.
    """
    p = F.col("pnl")
    # All that follows reads the trades several times over; lost parts of them are made anew.
    trades = trades.persist()
    mean = lambda c: F.coalesce(F.avg(c), F.lit(0.0)).alias(c) if c in trades.columns else F.lit(0.0).alias(c)
    own = trades.groupBy(*keys).agg(
        (F.sum(p) / capital * 100).alias("total_return"),
        F.coalesce(F.avg(F.when(p > 0, p)), F.lit(0.0)).alias("avg_win"), F.coalesce(F.abs(F.avg(F.when(p < 0, p))), F.lit(0.0)).alias("avg_loss"),
        F.coalesce(F.max(F.when(p > 0, p)), F.lit(0.0)).alias("largest_win"), F.coalesce(F.abs(F.min(F.when(p < 0, p))), F.lit(0.0)).alias("largest_loss"),
        F.when(F.sum(F.when(p < 0, -p)) > 0, F.sum(p) / F.sum(F.when(p < 0, -p))).otherwise(F.when(F.sum(p) > 0, float("inf")).otherwise(0.0)).alias("gain_to_pain"),
        F.coalesce(F.avg((F.unix_micros("exit_time") - F.unix_micros("entry_time")) / 3.6e9), F.lit(0.0)).alias("avg_hours"),
        (F.coalesce(F.sum(F.col("entry_price") * F.col("size")), F.lit(0.0)) / capital).alias("turnover"),
        mean("mae_pct"), mean("mfe_pct"), (F.count("*") < LOW_SAMPLE).alias("low_sample"),
    )
    return own.join(trade_metrics(trades, keys), keys).join(streaks(trades, keys, order), keys).join(exposure(trades, keys, start, end), keys, "left").withColumn("exposure", F.coalesce("exposure", F.lit(0.0)) * 100)


def backtest_row(trades: DataFrame, keys: list[str], *, capital: float, start: str, end: str, bars: DataFrame | None = None) -> DataFrame:
    """Both halves of a metric row: the trades', and those of the equity that their exits make by business day."""
    equity = dated_equity(trades, keys, capital).withColumn("bench", F.lit(None).cast("double"))
    found = trade_row(trades, keys, capital=capital, start=start, end=end).join(metric_row(equity, keys, ppy=DAYS_PER_YEAR).drop("low_sample"), keys)
    return found if bars is None else found.join(buy_and_hold(bars, keys), keys, "left")


def draw(seed: int, *of: Column) -> Column:
    """A number from 0 to 2**32 - 1, the same in every run for the same seed and columns: the first 32 bits of an MD5."""
    return F.conv(F.substring(F.md5(F.concat_ws(":", F.lit(str(seed)), *[c.cast("string") for c in of]).cast("binary")), 1, 8), 16, 10).cast("long")


def block_resamples(daily: DataFrame, keys: list[str], *, samples: int = 1000, block: int = 20, seed: int = 0) -> DataFrame:
    """(keys, ts, pnl) by day -> keys, sample, sharpe (annual), total: resamples of as many days as there are, out of blocks of consecutive days.

    A block's sum and sum of squares are differences of running sums, so a resample costs one row
    a block, not one a day; blocks are drawn by hash. Keys with fewer days than a block give none.
    A resample without spread has a Sharpe ratio of 0.
    """
    w = Window.partitionBy(*keys).orderBy("ts")
    rows = daily.withColumn("i", F.row_number().over(w) - 1).withColumn("n", F.count("*").over(Window.partitionBy(*keys))).where(F.col("n") >= block)
    blocks = F.ceil(F.col("n") / block)
    rest = F.col("n") - (blocks - 1) * block
    ahead = F.collect_list("pnl").over(w.rowsBetween(0, block - 1))
    total = lambda xs, f: F.aggregate(xs, F.lit(0.0), lambda s, x: s + f(x))
    starts = rows.withColumn("__x", ahead).where(F.col("i") <= F.col("n") - block).withColumn("__y", F.slice("__x", 1, rest.cast("int")))
    starts = starts.select(*keys, "i", "n", *[total(F.col(c), f).alias(name) for c, f, name in (("__x", lambda x: x, "s"), ("__x", lambda x: x * x, "q"), ("__y", lambda x: x, "rs"), ("__y", lambda x: x * x, "rq"))])
    sizes = rows.groupBy(*keys).agg(F.first("n").alias("n"))
    drawn = sizes.withColumn("sample", F.explode(F.sequence(F.lit(0), F.lit(samples - 1)))).withColumn("k", F.explode(F.sequence(F.lit(0).cast("long"), F.ceil(F.col("n") / block) - 1)))
    drawn = drawn.select(*keys, "sample", "k", (F.col("k") == F.ceil(F.col("n") / block) - 1).alias("last"), (draw(seed, F.col("sample"), F.col("k")) % (F.col("n") - block + 1)).alias("i"))
    both = drawn.join(starts, [*keys, "i"])
    sums = both.groupBy(*keys, "sample").agg(F.first("n").alias("n"), F.sum(F.when(F.col("last"), F.col("rs")).otherwise(F.col("s"))).alias("total"), F.sum(F.when(F.col("last"), F.col("rq")).otherwise(F.col("q"))).alias("squares"))
    mean = F.col("total") / F.col("n")
    spread = F.sqrt(F.greatest((F.col("squares") - F.col("total") * mean) / (F.col("n") - 1), F.lit(0.0)))
    flat = spread <= 1e-7 * F.sqrt(F.col("squares") / F.col("n")) + 1e-12
    return sums.select(*keys, "sample", F.when(flat, 0.0).otherwise(mean / spread * DAYS_PER_YEAR**0.5).alias("sharpe"), "total")


def monte_carlo(daily: DataFrame, keys: list[str], *, samples: int = 1000, block: int = 20, seed: int = 0) -> DataFrame:
    """keys, samples, periods, sharpe_p05, sharpe_p50, return_p05; no samples and nulls for a series shorter than a block."""
    found = block_resamples(daily, keys, samples=samples, block=block, seed=seed).groupBy(*keys).agg(F.count("*").alias("samples"), F.percentile("sharpe", F.lit(0.05)).alias("sharpe_p05"), F.percentile("sharpe", F.lit(0.5)).alias("sharpe_p50"), F.percentile("total", F.lit(0.05)).alias("return_p05"))
    return daily.groupBy(*keys).agg(F.count("*").alias("periods")).join(found, keys, "left").withColumn("samples", F.coalesce("samples", F.lit(0)))


def trailing_score(bars: DataFrame) -> DataFrame:
    """symbol, score: the rise from the first close to the last, 0 at least."""
    return bars.groupBy("symbol").agg(F.greatest(ratio(F.max_by("close", "ts"), F.min_by("close", "ts")) - 1, F.lit(0.0)).alias("score"))
