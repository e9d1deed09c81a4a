"""Covariances as long tables (i, j, cov), and what is read from them."""

from __future__ import annotations

import math

from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from ..functions.scalars import ratio


def complete_cases(returns: DataFrame, min_obs: int) -> DataFrame:
    """(ts, symbol, ret) of symbols with min_obs returns at least, at the ts where all of those have one."""
    some = returns.where("ret is not null")
    kept = some.groupBy("symbol").agg(F.count("*").alias("n")).where(F.col("n") >= min_obs).select("symbol")
    panel = some.join(kept, "symbol", "left_semi")
    return panel.withColumn("__k", F.count("*").over(Window.partitionBy("ts"))).join(F.broadcast(kept.agg(F.count("*").alias("__all"))), F.col("__k") == F.col("__all")).select("ts", "symbol", "ret")


def covariance(panel: DataFrame) -> DataFrame:
    """Population covariance of every pair i <= j by a self join on ts: pairs of the columns of a panel, not of its rows."""
    a = panel.select("ts", F.col("symbol").alias("i"), F.col("ret").alias("x"))
    b = panel.select("ts", F.col("symbol").alias("j"), F.col("ret").alias("y"))
    return a.join(b, "ts").where("i <= j").groupBy("i", "j").agg(F.covar_pop("x", "y").alias("cov"), F.count("*").alias("n"))


def chunk_sums(chunks, n: int):
    """(rows, means, sums of squares and products about them) of returns that come as arrays of rows x n, held one chunk at a time: memory is one chunk and one n x n matrix, however many chunks there are."""
    import numpy as np

    count, mean, spread = 0, np.zeros(n), np.zeros((n, n))
    for x in chunks:
        if not len(x):
            continue
        own = x.mean(axis=0)
        x = x - own
        gap, total = own - mean, count + len(x)
        spread += x.T @ x + np.outer(gap, gap) * (count * len(x) / total)
        mean += gap * (len(x) / total)
        count = total
    return count, mean, spread


def streamed_covariance(panel: DataFrame, symbols: list[str]) -> DataFrame:
    """The covariance of `covariance` for a complete-case panel of these symbols, without joining it with itself: i, j, cov, n.

    Each ts becomes one vector; a task folds its vectors into one matrix as they stream by and
    gives out that matrix, so memory is that of the matrix and a shuffle carries one matrix a task.
    The names are a bounded list, the columns of the matrix.
    """
    import numpy as np
    import pyarrow as pa

    names = sorted(symbols)
    place = F.array_position(F.array(*[F.lit(s) for s in names]), F.col("symbol")) - 1
    rows = panel.groupBy("ts").agg(F.array_sort(F.collect_list(F.struct(place.alias("k"), "ret"))).alias("x")).where(F.size("x") == len(names)).select(F.col("x.ret").alias("x"))

    def fold(batches):
        n, mean, spread = chunk_sums((b.column("x").flatten().to_numpy(zero_copy_only=False).reshape(-1, len(names)) for b in batches), len(names))
        if n:
            i, j = np.triu_indices(len(names))
            yield pa.RecordBatch.from_arrays([pa.array(i, pa.int32()), pa.array(j, pa.int32()), pa.array(np.full(len(i), n, np.int64)), pa.array(mean[i]), pa.array(mean[j]), pa.array(spread[i, j])], names=["a", "b", "n", "x", "y", "s"])

    sums = rows.mapInArrow(fold, "a int, b int, n long, x double, y double, s double").groupBy("a", "b").agg(
        F.sum("n").alias("n"), F.sum("s").alias("s"), F.sum(F.col("n") * F.col("x")).alias("sx"), F.sum(F.col("n") * F.col("y")).alias("sy"), F.sum(F.col("n") * F.col("x") * F.col("y")).alias("sxy")
    )
    name = lambda c: F.get(F.array(*[F.lit(s) for s in names]), F.col(c))
    return sums.select(name("a").alias("i"), name("b").alias("j"), ((F.col("s") + F.col("sxy") - F.col("sx") * F.col("sy") / F.col("n")) / F.col("n")).alias("cov"), "n")


def shrunk(panel: DataFrame) -> DataFrame:
    """i, j (i <= j), cov, intensity: the covariance blended with the constant-correlation matrix of the same variances.

    The intensity is the one that minimises the expected squared error (Ledoit and Wolf, 2004):
    every term is a moment of a pair, so the pairs of names are aggregated and then summed. It is
    0 for one name, for a name without variance and where the target fits exactly; under two
    rows all covariances are 0. An empty panel gives no rows.
    """
    centred = panel.select("ts", "symbol", (F.col("ret") - F.avg("ret").over(Window.partitionBy("symbol"))).alias("x"))
    a = centred.select("ts", F.col("symbol").alias("i"), "x")
    b = centred.select("ts", F.col("symbol").alias("j"), F.col("x").alias("y"))
    x, y = F.col("x"), F.col("y")
    pairs = a.join(b, "ts").where("i <= j").groupBy("i", "j").agg(F.avg(x * y).alias("cov"), F.avg(x * x * y * y).alias("square"), F.avg(x * x * x * y).alias("xxxy"), F.avg(y * y * y * x).alias("yyyx"), F.avg(x * x).alias("vi"), F.avg(y * y).alias("vj"), F.count("*").alias("n"))
    apart = F.col("i") < F.col("j")
    si, sj = F.sqrt("vi"), F.sqrt("vj")
    rho = pairs.agg(F.avg(F.when(apart, ratio(F.col("cov"), si * sj))).alias("rho"), F.min("vi").alias("least"))
    both = pairs.join(F.broadcast(rho))
    target = F.when(apart, F.coalesce("rho", F.lit(0.0)) * si * sj).otherwise(F.col("cov"))
    spread = F.col("square") - F.col("cov") * F.col("cov")
    # The off-diagonal covariance of target and sample.
    shared = F.col("rho") / 2 * (ratio(sj, si) * (F.col("xxxy") - F.col("vi") * F.col("cov")) + ratio(si, sj) * (F.col("yyyx") - F.col("vj") * F.col("cov")))
    times = F.when(apart, 2.0).otherwise(1.0)
    sums = both.agg(F.sum(times * spread).alias("pi"), F.sum(F.when(apart, 2 * shared).otherwise(spread)).alias("r"), F.sum(times * F.pow(target - F.col("cov"), 2)).alias("gap"), F.max("n").alias("t"), F.min("least").alias("low"))
    good = (F.col("low") > 0) & (F.col("gap") > 0) & (F.col("t") >= 2)
    delta = sums.select(F.when(good, F.greatest(F.lit(0.0), F.least(F.lit(1.0), (F.col("pi") - F.col("r")) / F.when(F.col("gap") > 0, F.col("gap")) / F.col("t")))).otherwise(0.0).alias("intensity"))
    return both.join(F.broadcast(delta)).select("i", "j", F.when(F.col("n") < 2, 0.0).otherwise(F.col("intensity") * target + (1 - F.col("intensity")) * F.col("cov")).alias("cov"), "intensity")


def both_halves(cov: DataFrame) -> DataFrame:
    return cov.select("i", "j", "cov").unionByName(cov.where("i < j").select(F.col("j").alias("i"), F.col("i").alias("j"), "cov"))


def contributions(cov: DataFrame, weights: DataFrame) -> DataFrame:
    """symbol, weight, marginal (of volatility), share of variance; weights: symbol, weight."""
    w = weights.select(F.col("symbol").alias("j"), F.col("weight").alias("wj"))
    pull = both_halves(cov).join(w, "j").groupBy("i").agg(F.sum(F.col("cov") * F.col("wj")).alias("pull"))
    own = weights.join(pull, F.col("symbol") == F.col("i")).select("symbol", "weight", "pull")
    total = F.sum(F.col("weight") * F.col("pull")).over(Window.partitionBy())
    return own.select("symbol", "weight", ratio(F.col("pull"), F.sqrt(total)).alias("marginal"), ratio(F.col("weight") * F.col("pull"), total).alias("share"))


def beta(pairs: DataFrame, ppy: float = 252.0) -> DataFrame:
    """(symbol, ret, bench) -> symbol, beta (1 under three rows or a flat benchmark), annual residual and total volatility."""
    r, b = F.col("ret"), F.col("bench")
    fit = pairs.where("ret is not null and bench is not null").groupBy("symbol").agg(
        F.count("*").alias("n"), F.covar_samp(r, b).alias("c"), F.var_samp(b).alias("vb"), F.var_samp(r).alias("vr")
    )
    slope = F.when((F.col("n") >= 3) & (F.col("vb") > 1e-24), F.col("c") / F.col("vb")).otherwise(1.0)
    left = F.col("vr") - 2 * slope * F.col("c") + slope * slope * F.col("vb")
    return fit.select("symbol", "n", slope.alias("beta"), (F.sqrt(F.greatest(left, F.lit(0.0))) * math.sqrt(ppy)).alias("residual_vol"), (F.sqrt("vr") * math.sqrt(ppy)).alias("total_vol"))


def information(scores: DataFrame) -> DataFrame:
    """(ts, symbol, score, fwd) -> ts, n, ic (Pearson), rank_ic; null for flat or single-name cross-sections."""
    from .xsection import average_rank

    both = scores.where("score is not null and fwd is not null")
    ranked = both.withColumn("rs", average_rank(F.col("score"))).withColumn("rf", average_rank(F.col("fwd")))

    def pearson(x: str, y: str):
        spread = F.stddev_pop(x) * F.stddev_pop(y)
        return F.when(spread > 1e-18, F.covar_pop(x, y) / spread)

    return ranked.groupBy("ts").agg(F.count("*").alias("n"), pearson("score", "fwd").alias("ic"), pearson("rs", "rf").alias("rank_ic"))


def ic_summary(ics: DataFrame) -> DataFrame:
    """Mean, deviation, t statistic and number of the measured ICs."""
    return ics.agg(
        F.avg("ic").alias("mean_ic"), F.stddev_samp("ic").alias("ic_vol"),
        ratio(F.avg("ic") * F.sqrt(F.count("ic")), F.stddev_samp("ic")).alias("t_stat"), F.count("ic").alias("periods"), F.avg("rank_ic").alias("mean_rank_ic"),
    )
