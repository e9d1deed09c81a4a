"""Reports on books and trials: net caps, moments of excursion, largest capital, book exposures, legs, sessions, leaderboard, series comparison."""

from __future__ import annotations

from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from ..functions.labels import in_sample
from ..functions.scalars import INF, finite, is_flat, ratio
from .metrics import sharpe
from .reports import asof
from .timeseries import by
from .trials import FAMILY, family_counts

# The shares of the 95th percentile that are tried as caps, that of the maximum, and
# the samples under which a percentile is thin.
HEADROOMS = (1.0, 1.25, 1.5)
ABOVE_MAX = 1.1
FEW = 30
# What each kind of run's stored series is.
SERIES = {"walkforward": "stitched out-of-sample folds", "research": "stitched out-of-sample folds", "backtest": "full-window, in-sample", "optimize": "full-window, in-sample"}


def exposure_stats(samples: DataFrame, keys: list[str]) -> DataFrame:
    """keys, equity, net, gross -> samples, skipped (no positive equity), median, p90, p95, p99 and max of |net| over equity, mean of the signed one, max of gross over equity."""
    good = F.when(F.col("equity") > 0, F.col("equity"))
    x = F.abs(ratio(F.col("net"), good))
    marks = F.percentile(x, F.array(*[F.lit(p) for p in (0.5, 0.9, 0.95, 0.99)]))
    found = samples.groupBy(*keys).agg(F.count(x).alias("samples"), (F.count("*") - F.count(x)).alias("skipped"), marks.alias("q"), F.max(x).alias("max"), F.avg(ratio(F.col("net"), good)).alias("signed_mean"), F.max(ratio(F.col("gross"), good)).alias("gross_max"))
    return found.select(*keys, "samples", "skipped", *[F.col("q")[i].alias(n) for i, n in enumerate(("median", "p90", "p95", "p99"))], "max", "signed_mean", "gross_max")


def candidate_caps(samples: DataFrame, keys: list[str]) -> DataFrame:
    """keys, cap, binding_rate (share of samples whose |net| over equity is above it), above_observed_max; none for a book that never tilted.

    Caps come from the book's own distribution; all of a book's are counted in one pass.
    """
    stats = exposure_stats(samples, keys).where("max > 0")
    caps = F.array(*[F.round(F.col("p95") * h, 4) for h in HEADROOMS], F.round(F.col("max") * ABOVE_MAX, 4))
    x = F.abs(ratio(F.col("net"), F.when(F.col("equity") > 0, F.col("equity"))))
    rows = samples.select(*keys, x.alias("x")).where("x is not null").join(stats.select(*keys, "max", caps.alias("caps")), keys)
    each = [F.struct(F.first("caps")[i].alias("cap"), F.avg((F.col("x") > F.col("caps")[i]).cast("double")).alias("binding_rate")) for i in range(len(HEADROOMS) + 1)]
    found = rows.groupBy(*keys).agg(F.first("max").alias("max"), F.array_distinct(F.array(*each)).alias("each"))
    return found.select(*keys, "max", F.explode("each").alias("e")).where("e.cap > 0").select(*keys, "e.cap", "e.binding_rate", (F.col("e.cap") >= F.col("max")).alias("above_observed_max"))


def net_cap(samples: DataFrame, keys: list[str], gross_cap: float | None = None) -> DataFrame:
    """exposure_stats with thin, no_tilt, recommended (the least candidate that never bound, null if all did) and whether the gross cap subsumes it. A book without samples has no row."""
    best = candidate_caps(samples, keys).where("binding_rate = 0").groupBy(*keys).agg(F.min("cap").alias("recommended"))
    subsumed = F.coalesce(F.col("recommended") >= gross_cap, F.lit(False)) if gross_cap is not None else F.lit(False)
    return exposure_stats(samples, keys).where("samples > 0").join(best, keys, "left").withColumns({"thin": F.col("samples") < FEW, "no_tilt": F.col("max") <= 0, "subsumed": subsumed})


def moments(samples: DataFrame, keys: list[str]) -> DataFrame:
    """keys, ts, equity_close, equity_adverse, equity_favourable, gross, net, open_positions -> the worst, the best and the worst closing moment of each book.

    All are percent of the highest close so far; the first of equal moments counts, and samples
    before any positive peak count in n_steps alone. adverse_at, favourable_at and closing_at are
    structs: ts, equity, equity_at_close, peak, open_positions, gross_pct, net_pct (of the close
    there) and drawdown_at_close_pct. understatement_pct is what the closing marks leave out.
    """
    w = Window.partitionBy(*keys).orderBy("ts").rowsBetween(Window.unboundedPreceding, 0)
    close, peak = F.col("equity_close"), F.col("peak")
    rows = samples.withColumn("peak", F.max("equity_close").over(w))
    adverse, favourable = F.coalesce("equity_adverse", close), F.coalesce("equity_favourable", close)
    pct = {"adverse": 100 * ratio(peak - adverse, peak), "favourable": 100 * ratio(favourable - peak, peak), "closing": 100 * ratio(peak - close, peak)}
    equity = {"adverse": adverse, "favourable": favourable, "closing": close}
    some = lambda c: F.when(peak > 0, c)
    at = lambda name: F.struct("ts", equity[name].alias("equity"), close.alias("equity_at_close"), "peak", "open_positions", (100 * ratio(F.col("gross"), close)).alias("gross_pct"), (100 * ratio(F.col("net"), close)).alias("net_pct"), pct["closing"].alias("drawdown_at_close_pct"))
    first = lambda name: F.max_by(at(name), F.when(peak > 0, F.struct(pct[name], -F.unix_micros("ts"))))
    found = rows.groupBy(*keys).agg(F.count("*").alias("n_steps"), *[x for name, c in pct.items() for x in (F.max(some(c)).alias(f"{name}_pct"), first(name).alias(f"{name}_at"))])
    return found.withColumn("understatement_pct", F.col("adverse_pct") - F.col("closing_pct"))


def largest_capital(holdings: DataFrame, keys: list[str], *, years: float, low: float = 1e3, high: float = 1e12, commission_bps: float = 1.0, spread_bps: float = 5.0, eta: float = 0.3) -> DataFrame:
    """keys, weight, price, adv (shares), vol, gross_alpha -> keys, capital, status: where the cost of a round trip over `years` takes all of the gross alpha.

    Commission and half spread are a fixed share of the capital and impact grows with its root, so
    the capital is a square of sums and nothing is searched. It is given for the status measured
    only; the others: no_priced_holdings, no_edge, below_search_floor (low), above_search_ceiling
    (high). Holdings without price or weight are left out, those without adv have no impact.
    """
    w = F.abs("weight")
    priced = (F.col("price") > 0) & (F.col("weight") != 0) & finite(F.col("vol")).isNotNull()
    impact = F.when(F.col("adv") > 0, eta * F.col("vol") * F.sqrt(ratio(w, F.col("price") * F.col("adv"))) * w).otherwise(0.0)
    sums = holdings.groupBy(*keys).agg(F.max("gross_alpha").alias("alpha"), F.count_if(priced).alias("n"), F.sum(F.when(priced, w * (commission_bps + spread_bps / 2) / 1e4)).alias("flat"), F.sum(F.when(priced, impact)).alias("impact"))
    net = lambda capital: F.col("alpha") - 2 * (F.col("flat") + F.col("impact") * capital**0.5) / max(years, 1e-9)
    status = F.when(F.col("n") == 0, "no_priced_holdings").when(~(F.col("alpha") > 0), "no_edge").when(net(low) <= 0, "below_search_floor").when(net(high) > 0, "above_search_ceiling").otherwise("measured")
    root = ratio(F.col("alpha") * max(years, 1e-9) / 2 - F.col("flat"), F.col("impact"))
    return sums.select(*keys, F.when(status == "measured", F.pow(root, 2)).alias("capital"), status.alias("status"))


def book_exposures(weights: DataFrame, panel: DataFrame, keys: list[str]) -> DataFrame:
    """(keys, symbol, weight) and (symbol, factor, value) -> keys, factor, exposure: the weighted sum of the values there are."""
    return weights.join(panel.where("value is not null and not isnan(value)"), "symbol").groupBy(*keys, "factor").agg(F.sum(F.col("weight") * F.col("value")).alias("exposure"))


def restricted(weights: DataFrame, covered: DataFrame, keys: list[str]) -> DataFrame:
    """(keys, symbol, weight) restricted to the covered symbols and scaled to sum to 1, with coverage, the share of the weight kept. A book whose kept weight is not positive has no rows."""
    seen = weights.join(covered.select("symbol", F.lit(True).alias("covered")).distinct(), "symbol", "left")
    kept = F.sum(F.when(F.col("covered"), F.col("weight")))
    sums = seen.groupBy(*keys).agg(kept.alias("kept"), F.when(F.sum("weight") > 0, kept / F.sum("weight")).otherwise(0.0).alias("coverage"))
    return seen.where("covered").join(sums.where("kept > 0"), keys).select(*keys, "symbol", (F.col("weight") / F.col("kept")).alias("weight"), "coverage")


def binding_fraction(book: DataFrame, universe: DataFrame, keys: list[str]) -> DataFrame:
    """(keys, symbol, weight) of a long-only book and (keys, symbol) -> keys, n, binding: the share of the universe that it holds nothing of."""
    return universe.select(*keys, "symbol").distinct().join(book, [*keys, "symbol"], "left").groupBy(*keys).agg(F.count("*").alias("n"), F.avg((F.coalesce("weight", F.lit(0.0)) <= 1e-9).cast("double")).alias("binding"))


def leg_report(curves: DataFrame, trades: DataFrame, benchmark: DataFrame, capital: float) -> DataFrame:
    """(side, ts, value: profit so far, realised and not), (side, pnl, cost) and (ts, ret) -> side, trades, pnl, cost, return_pct, volatility_pct, max_drawdown_pct, beta, benchmark_correlation.

    Curves are shares of the capital. Beta and correlation need two steps with a benchmark return
    and dispersion in both, else they are null.
    """
    w = Window.partitionBy("side").orderBy("ts")
    share = F.col("value") / capital
    peak = F.max(1 + share).over(w.rowsBetween(Window.unboundedPreceding, 0))
    steps = curves.select("side", "ts", share.alias("share"), (share - F.lag(share).over(w)).alias("step"), (ratio(1 + share, peak) - 1).alias("dd")).join(benchmark.select("ts", F.col("ret").alias("bench")), "ts", "left")
    x, y = F.when(F.col("bench").isNotNull(), F.col("step")), F.when(F.col("step").isNotNull(), F.col("bench"))
    flat = is_flat(F.stddev_samp(x), F.avg(F.abs(x))) | is_flat(F.stddev_samp(y), F.avg(F.abs(y)))
    held = steps.groupBy("side").agg(
        (100 * F.max_by("share", "ts")).alias("return_pct"), (100 * F.stddev_samp("step")).alias("volatility_pct"), (100 * F.abs(F.min("dd"))).alias("max_drawdown_pct"),
        F.when(~flat, F.try_divide(F.covar_samp(x, y), F.var_samp(y))).alias("beta"), F.when(~flat, F.try_divide(F.covar_pop(x, y), F.stddev_pop(x) * F.stddev_pop(y))).alias("benchmark_correlation"),
    )
    closed = trades.groupBy("side").agg(F.count("*").alias("trades"), F.sum("pnl").alias("pnl"), F.sum("cost").alias("cost"))
    return held.join(closed, "side", "full_outer").na.fill(0, ["trades", "pnl", "cost"])


def sessions(ledger: DataFrame, keys: list[str]) -> DataFrame:
    """keys, seq, event -> keys, seq, outcome_seq: every session with the first session_outcome after it and before the next session, null if there is none.

    An outcome with no session before it in its ledger is dropped.
    """
    w = Window.partitionBy(*keys).orderBy("seq").rowsBetween(Window.unboundedPreceding, 0)
    rows = ledger.where("event in ('session', 'session_outcome')").withColumn("k", F.count_if(F.col("event") == "session").over(w)).where("k > 0")
    of = lambda event: F.min(F.when(F.col("event") == event, F.col("seq")))
    return rows.groupBy(*keys, "k").agg(of("session").alias("seq"), of("session_outcome").alias("outcome_seq")).drop("k")


def board(trials: DataFrame, n: int = 10, *, rank_by: str = "dsr", include_in_sample: bool = False) -> tuple[DataFrame, DataFrame]:
    """(the n best trials by deflated (dsr) or raw (sharpe) ratio with their rank and family_n_trials; one row of what is not ranked).

    Left out, in this order: trials measured in sample (in_sample_excluded), quarantined ones
    (contaminated_excluded), those without a finite value (unranked_excluded). Ties go by id.
    """
    if rank_by not in ("dsr", "sharpe"):
        raise ValueError(f"rank_by must be 'dsr' or 'sharpe', got {rank_by!r}")
    metric = "deflated_sharpe" if rank_by == "dsr" else "oos_sharpe"
    shown = F.lit(True) if include_in_sample else ~in_sample(F.col("kind"))
    clean, ranked = F.col("contaminated_at").isNull(), finite(F.col(metric)).isNotNull()
    counts = trials.agg(F.count_if(shown & clean & ranked).alias("eligible"), F.count_if(~shown).alias("in_sample_excluded"), F.count_if(shown & ~clean).alias("contaminated_excluded"), F.count_if(shown & clean & ~ranked).alias("unranked_excluded"))
    first = trials.where(shown & clean & ranked).orderBy(F.col(metric).desc(), "id").limit(n)
    placed = first.withColumn("rank", F.row_number().over(Window.orderBy(F.col(metric).desc(), "id")))  # n rows
    return placed.join(family_counts(trials).withColumnRenamed("n_tried", "family_n_trials"), list(FAMILY), "left"), counts


def recorded(old: DataFrame, new: DataFrame, key: str = "trial_id") -> DataFrame:
    """Returns, weights or trades of trials after a record: a trial in `new` has all its rows from there, the others keep theirs."""
    return old.join(new.select(key).distinct(), key, "left_anti").unionByName(new)


def compared(trials: DataFrame, series: DataFrame, keys: list[str], *, min_overlap: int = 60, across_accounting: bool = False) -> DataFrame:
    """(keys, id, ts, kind, accounting) and (trial_id, ts, ret) -> every pair of trials of equal keys: a, b, status, reason, overlap, first_ts, last_ts, corr, low, high, comparable, unlike_basis.

    status is compared or refused; reasons, in this order: no_series, accounting, overlap, flat.
    An id given twice counts once, by its first ts. The interval is 95 % by Fisher's z, null at a
    correlation of 1. Pairs meet their series by trial and ts.
    """
    once = trials.withColumn("__k", F.row_number().over(Window.partitionBy("id").orderBy("ts", "kind"))).where("__k = 1")
    stored = series.groupBy("trial_id").agg(F.count("*").alias("rows"))
    named = once.join(stored, once["id"] == stored["trial_id"], "left").select(*keys, "id", "kind", "accounting", F.coalesce("rows", F.lit(0)).alias("rows"))
    side = lambda x: named.select(*keys, *[F.col(c).alias(f"{c}_{x}") for c in ("id", "kind", "accounting", "rows")])
    pairs = side("a").join(side("b"), keys).where("id_a < id_b")
    same = F.col("accounting_a").eqNullSafe(F.col("accounting_b"))
    reason = F.when((F.col("rows_a") == 0) | (F.col("rows_b") == 0), "no_series").when(~same & (not across_accounting), "accounting")
    pairs = pairs.withColumns({"why": reason, "comparable": same})
    value = lambda x, y: series.select(F.col("trial_id").alias(f"id_{x}"), "ts", finite(F.col("ret")).alias(y)).where(f"{y} is not null")
    both = pairs.where("why is null").select("id_a", "id_b").join(value("a", "x"), "id_a").join(value("b", "y"), ["id_b", "ts"]).groupBy("id_a", "id_b")
    flat = is_flat(F.stddev_pop("x"), F.avg(F.abs("x"))) | is_flat(F.stddev_pop("y"), F.avg(F.abs("y")))
    stats = both.agg(F.count("*").alias("n"), F.min("ts").alias("first_ts"), F.max("ts").alias("last_ts"), flat.alias("flat"), F.try_divide(F.covar_pop("x", "y"), F.stddev_pop("x") * F.stddev_pop("y")).alias("r"))
    found = pairs.join(stats, ["id_a", "id_b"], "left").withColumn("overlap", F.coalesce("n", F.lit(0)))
    found = found.withColumn("reason", F.coalesce("why", F.when(F.col("overlap") < min_overlap, "overlap").when(F.col("flat"), "flat")))
    corr = F.when(F.col("reason").isNull(), F.col("r"))
    open_ = (F.abs(corr) < 1) & (F.col("overlap") >= 4)
    z, half = F.atanh(F.when(open_, corr)), 1.959963984540054 / F.sqrt(F.when(F.col("overlap") > 3, F.col("overlap") - 3))
    label = lambda c: F.element_at(F.create_map(*[F.lit(x) for kv in SERIES.items() for x in kv]), F.coalesce(c, F.lit("")))
    return found.select(
        *keys, F.col("id_a").alias("a"), F.col("id_b").alias("b"), F.when(F.col("reason").isNull(), "compared").otherwise("refused").alias("status"), "reason", "overlap", "first_ts", "last_ts",
        corr.alias("corr"), F.tanh(z - half).alias("low"), F.tanh(z + half).alias("high"), "comparable", (~label(F.col("kind_a")).eqNullSafe(label(F.col("kind_b")))).alias("unlike_basis"),
    )


def signal_evaluation(signals: DataFrame, hold: int, keys: list[str], *, ppy: float = 252.0) -> DataFrame:
    """keys (columns that include symbol or depend on it), n_signals, hit_rate and avg_return in percent, sharpe and profit_factor of BUY and SELL signals by the close `hold` bars later, or the last if the series ends before.

    A signal on the last bar is not measured. Without a loss the profit factor is infinite.
    """
    w = by()
    later = F.coalesce(F.lead("close", hold).over(w), F.last("close").over(w.rowsBetween(0, hold)))
    move = F.when(F.lead("close").over(w).isNotNull(), 100 * (ratio(later, F.col("close")) - 1) * F.when(F.col("signal") == "SELL", -1.0).otherwise(1.0))
    rows = signals.withColumn("move", move).where("signal in ('BUY', 'SELL') and move is not null")
    m = F.col("move")
    lost = -F.sum(F.least(m, F.lit(0.0)))
    return rows.groupBy(*keys).agg(F.count("*").alias("n_signals"), (100 * F.avg((m > 0).cast("double"))).alias("hit_rate"), F.avg(m).alias("avg_return"), sharpe(m, ppy).alias("sharpe"), F.when(lost == 0, INF).otherwise(F.try_divide(F.sum(F.greatest(m, F.lit(0.0))), lost)).alias("profit_factor"))


def overlaps(left: DataFrame, right: DataFrame, key: str, every: str = "month") -> DataFrame:
    """left (key, start, end) beside right (key, start, end as r_start, r_end) where they share more than an instant, with that share: from_ts, to_ts.

    Both are cut into calendar pieces and meet by key and piece, so that a long interval or a key
    with many is spread; a pair counts in the piece where its share begins. Intervals that are
    empty or lack an end match nothing.
    """
    piece = lambda s, e: F.explode(F.sequence(F.date_trunc(every, s), F.date_trunc(every, e), F.expr(f"interval 1 {every}"))).alias("__piece")
    ours = left.where("start < end").select("*", piece("start", "end"))
    theirs = right.where("start < end").select(key, F.col("start").alias("r_start"), F.col("end").alias("r_end"), piece("start", "end"))
    a, b = F.greatest("start", "r_start"), F.least("end", "r_end")
    met = ours.join(theirs, [key, "__piece"]).where((a < b) & (F.date_trunc(every, a) == F.col("__piece")))
    return met.withColumns({"from_ts": a, "to_ts": b}).drop("__piece")


def benchmark_returns(times: DataFrame, bars: DataFrame) -> DataFrame:
    """(key, ts) of an equity curve and (key, ts, open, close) of its benchmark -> key, step, ts, ret at the curve's own instants, its first left out.

    A close is carried to instants without a bar. Step 1 has no return before it: where bars stand
    before it and one on it, its return is that bar's from open to close, else null. A curve with
    fewer than two returns gives no rows.
    """
    w = Window.partitionBy("key").orderBy("ts")
    stamps = times.select("key", "ts").distinct().withColumn("step", F.row_number().over(w) - 1).where("step > 0")
    closes = bars.where("close is not null")
    aligned = asof(stamps, closes, "close").join(stamps, ["key", "ts"]).join(closes.select("key", "ts", F.col("open").alias("o"), F.col("close").alias("c")), ["key", "ts"], "left").join(closes.groupBy("key").agg(F.min("ts").alias("begin")), "key")
    first = F.when((F.col("begin") < F.col("ts")) & (F.col("o") > 0), ratio(F.col("c"), F.col("o")) - 1)
    rows = aligned.withColumn("ret", F.when(F.col("step") == 1, first).otherwise(ratio(F.col("close"), F.lag("close").over(w)) - 1))
    carried = F.count(F.when(F.col("step") > 1, F.col("ret"))).over(Window.partitionBy("key"))
    return rows.withColumn("__n", carried).where("__n >= 2").select("key", "step", "ts", "ret")
