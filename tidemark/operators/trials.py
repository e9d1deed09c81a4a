"""The experiment table: families, leaderboards, duplicates, quarantine, series comparison."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from ..functions.labels import IN_SAMPLE, in_sample, sharpe_basis
from ..functions.scalars import is_flat

FAMILY = ("strategy", "universe_hash", "accounting")


def family_counts(trials: DataFrame) -> DataFrame:
    """How many configurations a family has tried: sessions count all of theirs, alpha runs none."""
    tried = F.when(F.col("kind").isin("walkforward", "research"), F.coalesce("n_trials_in_session", F.lit(1))).otherwise(1)
    return trials.where("kind <> 'alpha'").groupBy(*FAMILY).agg(F.sum(tried).cast("long").alias("n_tried"))


def leaderboard(trials: DataFrame, n: int, by: str = "oos_sharpe") -> DataFrame:
    """The best clean trials of each strategy, with their family's count."""
    w = Window.partitionBy("strategy").orderBy(F.col(by).desc_nulls_last(), "id")
    ranked = trials.where("contaminated_at is null").withColumn("rank", F.row_number().over(w)).where(F.col("rank") <= n)
    return ranked.join(family_counts(trials), list(FAMILY), "left")


def listing(
    trials: DataFrame, *, sort: str = "ts", n: int | None = None, offset: int = 0, since: Column | None = None, until: Column | None = None, before: Column | None = None,
    min_sharpe: float | None = None, kinds: list[str] | None = None, strategy: str | None = None, universe: str | None = None, accounting: int | None = None, contaminated: bool = True, include_in_sample: bool = False,
) -> tuple[DataFrame, DataFrame]:
    """(the rows asked for, newest or best first, with sharpe_basis and in_sample; one row of counts: total, hidden, undated).

    sort: ts, oos_sharpe or deflated_sharpe, missing values last, ties by id. Sorted or cut by a
    metric, it is a ranking and hides trials measured in sample, unless their kind is asked for;
    `hidden` counts those. `undated` counts those that a bound on time leaves out for having none.
    A `since`, `until` (both included) or `before` bound is a column of the type of ts.
    """
    fits = F.lit(True)
    for name, value in (("strategy", strategy), ("universe_hash", universe), ("accounting", accounting)):
        fits = fits if value is None else fits & (F.col(name) == value)
    fits = fits if kinds is None else fits & F.col("kind").isin(*kinds)
    fits = fits if min_sharpe is None else fits & (F.col("oos_sharpe") >= min_sharpe)
    fits = fits if contaminated else fits & F.col("contaminated_at").isNull()
    dated = F.lit(True)
    for bound, test in ((since, F.col("ts").__ge__), (until, F.col("ts").__le__), (before, F.col("ts").__lt__)):
        dated = dated if bound is None else dated & test(bound)
    bounded = any(x is not None for x in (since, until, before))
    ranks = (sort != "ts" or min_sharpe is not None) and not include_in_sample and not set(kinds or ()) & set(IN_SAMPLE)
    shown = ~in_sample(F.col("kind")) if ranks else F.lit(True)
    yes = lambda c: F.coalesce(c, F.lit(False))
    counts = trials.agg(F.count_if(yes(fits & dated & shown)).alias("total"), F.count_if(yes(fits & dated & ~shown)).alias("hidden"), F.count_if(yes(fits & shown & F.lit(bounded) & F.col("ts").isNull())).alias("undated"))
    rows = trials.where(fits & dated & shown).withColumns({"sharpe_basis": sharpe_basis(F.col("kind")), "in_sample": in_sample(F.col("kind"))}).orderBy(F.col(sort).desc_nulls_last(), "id").offset(offset)
    return (rows if n is None else rows.limit(n)), counts


def resolved(trials: DataFrame, refs: DataFrame, least: int = 4) -> DataFrame:
    """(ref) -> ref, id, n: the trial a reference names. An exact id wins; else a prefix of `least` characters and more if only one id has it; n counts the ids with that prefix.

    Each id is cut to the lengths that references have, and meets them by equality in one grouping:
    the work grows with the ids times those lengths, and no side is sent whole to every task.
    """
    asked = refs.select(F.trim("ref").alias("ref")).where("ref is not null")
    sizes = asked.agg(F.collect_set(F.length("ref")).alias("__sizes"))
    whole = F.col("__size") == F.length("id")
    # The sizes are one row.
    cut = trials.select("id").where("id is not null").distinct().join(F.broadcast(sizes)).withColumn("__size", F.explode("__sizes")).where((F.col("__size") <= F.length("id")) & ((F.col("__size") >= least) | whole))
    ids = cut.select(F.expr("substring(id, 1, __size)").alias("ref"), F.lit(False).alias("asked"), F.when(F.col("__size") >= least, 1).otherwise(0).alias("n"), "id", whole.alias("exact"))
    rows = asked.select("ref", F.lit(True).alias("asked"), F.lit(0).alias("n"), F.lit(None).cast("string").alias("id"), F.lit(False).alias("exact")).unionByName(ids)
    found = rows.groupBy("ref").agg(F.max("asked").alias("asked"), F.sum("n").alias("n"), F.min("id").alias("one"), F.max("exact").alias("exact")).where("asked")
    return found.select("ref", F.when(F.col("exact"), F.col("ref")).when(F.col("n") == 1, F.col("one")).alias("id"), "n")


def detail(trials: DataFrame, returns: DataFrame, weights: DataFrame, trades: DataFrame) -> DataFrame:
    """trials beside the span of their returns (trial_id, ts), the number of their trades, and the count and sum of their weights (trial_id, symbol, weight); nulls where there are none.

    params_json and metrics_json, where present, are also read as maps, empty if broken.
    """
    span = returns.groupBy("trial_id").agg(F.count("*").alias("periods"), F.min("ts").alias("first_ts"), F.max("ts").alias("last_ts"))
    held = weights.groupBy("trial_id").agg(F.count("*").alias("n_weights"), F.sum("weight").alias("net_weight"))
    traded = trades.groupBy("trial_id").agg(F.count("*").alias("n_trades"))
    out = trials.withColumns({"sharpe_basis": sharpe_basis(F.col("kind")), "in_sample": in_sample(F.col("kind"))})
    for name in ("params", "metrics"):
        if f"{name}_json" in trials.columns:
            out = out.withColumn(name, F.coalesce(F.from_json(f"{name}_json", "map<string,string>"), F.create_map().cast("map<string,string>")))
    for part in (span, held, traded):
        out = out.join(part.withColumnRenamed("trial_id", "id"), "id", "left")
    return out


def store_status(trials: DataFrame, journal: DataFrame) -> DataFrame:
    """One row: rows, trial_lines (of the journal's lines with a trial tool), orphaned, contaminated, drift; journal: (tool), one row a readable line."""
    kept = trials.agg(F.count("*").alias("rows"), F.count_if(F.col("strategy").isNull()).alias("orphaned"), F.count_if(F.col("contaminated_at").isNotNull()).alias("contaminated"))
    lines = journal.agg(F.count("*").alias("lines"), F.count_if(F.col("tool").startswith("trial:") | (F.col("tool") == "research:trial")).alias("trial_lines"))
    # Both sides are one row.
    return kept.join(F.broadcast(lines)).withColumn("drift", (F.col("rows") < F.col("trial_lines")) | (F.col("orphaned") > 0))


def duplicates(trials: DataFrame, identity: list[str]) -> DataFrame:
    """Trials that repeat an earlier one of the same identity: id, first_id, nth."""
    w = Window.partitionBy(*identity).orderBy("ts", "id")
    return trials.withColumn("first_id", F.first("id").over(w)).withColumn("nth", F.row_number().over(w)).where("nth > 1").select("id", "first_id", "nth")


def latest_by_id(old: DataFrame, new: DataFrame) -> DataFrame:
    """Upsert: the newer row of each id."""
    both = old.withColumn("__seq", F.lit(0)).unionByName(new.withColumn("__seq", F.lit(1)))
    return both.withColumn("__k", F.row_number().over(Window.partitionBy("id").orderBy(F.desc("__seq"), F.desc("ts")))).where("__k = 1").drop("__k", "__seq")


def quarantine(trials: DataFrame, marks: DataFrame) -> DataFrame:
    """trials with contaminated_at and contamination_reason; the first mark of an id wins, an older one stays."""
    first = marks.groupBy("id").agg(F.min("at").alias("at"), F.min_by("reason", "at").alias("why"))
    return trials.join(first, "id", "left").withColumn("contamination_reason", F.when(F.col("contaminated_at").isNull(), F.col("why")).otherwise(F.col("contamination_reason"))).withColumn("contaminated_at", F.coalesce("contaminated_at", "at")).drop("at", "why")


def compare_series(series: DataFrame, min_overlap: int = 60) -> DataFrame:
    """(trial_id, ts, ret) -> a, b, overlap, corr and its 95 % interval by Fisher's z, or the reason why not.

    Pairs of series, joined on the shared ts.
    """
    a = series.select(F.col("trial_id").alias("a"), "ts", F.col("ret").alias("x"))
    b = series.select(F.col("trial_id").alias("b"), "ts", F.col("ret").alias("y"))
    both = a.join(b, "ts").where("a < b and x is not null and y is not null").groupBy("a", "b")
    flat = is_flat(F.stddev_samp("x"), F.avg(F.abs("x"))) | is_flat(F.stddev_samp("y"), F.avg(F.abs("y")))
    found = both.agg(F.count("*").alias("overlap"), F.when(F.count("*") < min_overlap, "overlap").when(flat, "flat").alias("refused"), F.when(~flat, F.try_divide(F.covar_pop("x", "y"), F.stddev_pop("x") * F.stddev_pop("y"))).alias("c"))
    corr = F.when(F.col("refused").isNull(), F.col("c"))
    z, half = F.atanh(F.least(F.greatest(corr, F.lit(-0.999999)), F.lit(0.999999))), 1.959964 / F.sqrt(F.greatest(F.col("overlap") - 3, F.lit(1)))
    return found.select("a", "b", "overlap", "refused", corr.alias("corr"), F.tanh(z - half).alias("low"), F.tanh(z + half).alias("high"))


def drift(before: DataFrame, after: DataFrame) -> DataFrame:
    """Symbols added, dropped and kept between two universes, and the turnover in percent."""
    both = before.select("symbol", F.lit(1).alias("x")).distinct().join(after.select("symbol", F.lit(1).alias("y")).distinct(), "symbol", "full_outer")
    return both.agg(F.count_if(F.col("x").isNull()).alias("added"), F.count_if(F.col("y").isNull()).alias("dropped"), F.count_if(F.col("x").isNotNull() & F.col("y").isNotNull()).alias("kept"), F.count("*").alias("n")).withColumn("turnover_pct", F.try_divide(100.0 * (F.col("added") + F.col("dropped")), F.col("n")))
