"""Scans along a symbol's history in pieces: many tasks share one symbol.

A running sum, maximum or decayed sum is computed inside pieces of a history; each piece leaves its
total (and, for decay, how much of what came before it lets through); the few totals are scanned,
and what they carry into a piece is added to its rows. The rows of one key are never sorted in one
task, only the totals of its pieces are.
"""

from __future__ import annotations

import math

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

#: Rows of a piece of a decayed sum are few enough for powers of the decay to stay finite.
MOST_ROWS = 4096


def _pieces(keys: list[str], order: str, seconds: int) -> tuple[Column, Window, Window]:
    piece = F.floor(F.unix_timestamp(order) / seconds)
    inside = Window.partitionBy(*keys, "__piece").orderBy(order)
    before = Window.partitionBy(*keys).orderBy("__piece").rowsBetween(Window.unboundedPreceding, -1)
    return piece, inside, before


def _same(keys: list[str]) -> Column:
    on = F.col("a.__piece") == F.col("b.__piece")
    for k in keys:
        on &= F.col(f"a.{k}").eqNullSafe(F.col(f"b.{k}"))
    return on


def running(rows: DataFrame, keys: list[str], order: str, columns: dict[str, tuple[str, Column]], seconds: int) -> DataFrame:
    """rows with running columns along `order` of each key: {name: (how, value)}, how being count, sum or max; pieces are `seconds` long.

    Nulls are skipped. Rows of one key at the same instant are in any order, so `order` has to be
    unique within a key for results that do not depend on it.
    """
    piece, inside, before = _pieces(keys, order, seconds)
    combine = {"count": F.sum, "sum": F.sum, "max": F.max}
    upto = inside.rowsBetween(Window.unboundedPreceding, 0)
    cut = rows.withColumn("__piece", piece)
    local = cut.withColumns({f"__{n}": (F.count(v) if how == "count" else combine[how](v)).over(upto) for n, (how, v) in columns.items()})
    totals = cut.groupBy(*keys, "__piece").agg(*[(F.count(v) if how == "count" else combine[how](v)).alias(f"__{n}_all") for n, (how, v) in columns.items()])
    carried = totals.select(*keys, "__piece", *[combine[how](f"__{n}_all").over(before).alias(f"__{n}_in") for n, (how, _) in columns.items()])
    both = local.alias("a").join(carried.alias("b"), _same(keys))

    def put(name: str, how: str) -> Column:
        own, come = F.col(f"a.__{name}"), F.col(f"b.__{name}_in")
        return (F.greatest(own, come) if how == "max" else F.coalesce(own + come, own, come)).alias(name)

    return both.select(*[F.col(f"a.{c}") for c in rows.columns], *[put(n, how) for n, (how, _) in columns.items()])


def numbered(rows: DataFrame, keys: list[str], order: str, seconds: int, name: str = "i") -> DataFrame:
    """rows with their number along `order` within each key, from 0."""
    return running(rows, keys, order, {name: ("count", F.lit(1))}, seconds).withColumn(name, F.col(name) - 1)


def decayed(rows: DataFrame, keys: list[str], number: str, value: Column, decay: float, name: str) -> DataFrame:
    """rows (numbered 0, 1, ... in `number`) with the sum of value times decay ** (rows since), nulls as 0.

    What a piece carries on fades with its length, so a piece looks back at as many earlier totals
    as can still be told in double precision.
    """
    if not 0 < decay < 1:
        raise ValueError("decay lies between 0 and 1")
    size = max(1, min(MOST_ROWS, int(300 / -math.log(decay))))
    back = math.ceil(41.5 / -math.log(decay) / size) + 1
    cut = rows.withColumns({"__piece": F.floor(F.col(number) / size), "__v": F.coalesce(value, F.lit(0.0)), "__at": (F.col(number) % size).cast("double")})
    inside = Window.partitionBy(*keys, "__piece").orderBy(number).rowsBetween(Window.unboundedPreceding, 0)
    local = cut.withColumn("__s", F.sum(F.col("__v") * F.pow(F.lit(decay), -F.col("__at"))).over(inside) * F.pow(F.lit(decay), F.col("__at")))
    totals = cut.groupBy(*keys, "__piece").agg(F.sum(F.col("__v") * F.pow(F.lit(decay), size - 1 - F.col("__at"))).alias("__t"))
    past = F.collect_list("__t").over(Window.partitionBy(*keys).orderBy("__piece").rowsBetween(-back, -1))
    carried = totals.select(*keys, "__piece", F.aggregate(past, F.lit(0.0), lambda s, t: s * decay**size + t).alias("__in"))
    both = local.alias("a").join(carried.alias("b"), _same(keys))
    return both.select(*[F.col(f"a.{c}") for c in rows.columns], (F.col("a.__s") + F.col("b.__in") * F.pow(F.lit(decay), F.col("a.__at") + 1)).alias(name))


def ewma_variance(returns: DataFrame, *, decay: float = 0.94, min_obs: int = 60, seconds: int = 366 * 86400) -> DataFrame:
    """(ts, symbol, ret) -> ts, symbol, i, ret, variance: the exponentially weighted variance at every return, null for the first min_obs - 1.

    Row min_obs - 1 holds the mean of the first squares; from there a share 1 - decay of each new
    square comes in. A decay of 1 keeps the seed. Null returns are left out.
    """
    rows = numbered(returns.where("ret is not null").select("ts", "symbol", "ret"), ["symbol"], "ts", seconds)
    seed = rows.where(F.col("i") < min_obs).groupBy("symbol").agg(F.avg(F.col("ret") * F.col("ret")).alias("seed"), F.count("*").alias("n")).where(F.col("n") == min_obs)
    seeded = rows.join(seed.select("symbol", "seed"), "symbol", "left")
    late = F.col("i") >= min_obs - 1
    if decay == 1:
        return seeded.select("ts", "symbol", "i", "ret", F.when(late, F.col("seed")).alias("variance"))
    new = F.when(F.col("i") == min_obs - 1, F.col("seed")).when(late, (1 - decay) * F.col("ret") * F.col("ret"))
    return decayed(seeded, ["symbol"], "i", new, decay, "v").select("ts", "symbol", "i", "ret", F.when(late, F.col("v")).alias("variance"))


def drawdowns(bars: DataFrame, seconds: int = 366 * 86400) -> DataFrame:
    """(ts, symbol, close) -> with the highest close so far, the share below it, and bars and volume so far."""
    out = running(bars, ["symbol"], "ts", {"peak": ("max", F.col("close")), "n": ("count", F.col("close")), "traded": ("sum", F.col("volume"))}, seconds)
    return out.select("ts", "symbol", "close", "peak", F.when(F.col("peak") != 0, F.col("close") / F.col("peak") - 1).alias("drawdown"), "n", "traded")
