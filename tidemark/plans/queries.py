"""The registered market-research queries and, for each, the same in DuckDB SQL.

Instants are given as epoch seconds and doubles are rounded, so that both engines' rows compare.
"""

from __future__ import annotations

from datetime import datetime

from pyspark.sql import DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from ..functions import scalars as S
from ..operators import factors, ledger, metrics, reports, risk, studies, sweep, timeseries, trades, trials, xsection
from ..sources import bars, coverage, ingest
from ..sources.shared import saved
from ..streaming import barcheck

DIGITS = 6


def tidy(df: DataFrame, digits: int = DIGITS) -> DataFrame:
    """Timestamps as epoch seconds, doubles rounded, -0 as 0."""
    out = []
    for name, kind in df.dtypes:
        c = F.col(f"`{name}`")
        out.append((F.unix_timestamp(c) if kind == "timestamp" else F.round(c, digits) + 0.0 if kind == "double" else c).alias(name))
    return df.select(*out)


HOUR = """bars as (
  select date_trunc('hour', e.ts) as ts, e.event_type as symbol, first(e.value order by e.ts, e.event_id) as open, max(e.value) as high, min(e.value) as low,
    last(e.value order by e.ts, e.event_id) as close, count(*)::double as volume from events e group by date_trunc('hour', e.ts), e.event_type)"""
DAY = HOUR.replace("'hour'", "'day'").replace("e.event_type", "e.user_id::varchar")
WEEK = """bars as (
  select date_trunc('week', l.l_shipdate)::timestamp as ts, p.p_brand as symbol,
    first(l.l_extendedprice / l.l_quantity order by l.l_shipdate, l.l_orderkey, l.l_linenumber, l.l_partkey) as open,
    max(l.l_extendedprice / l.l_quantity) as high, min(l.l_extendedprice / l.l_quantity) as low,
    last(l.l_extendedprice / l.l_quantity order by l.l_shipdate, l.l_orderkey, l.l_linenumber, l.l_partkey) as close, sum(l.l_quantity)::double as volume
  from lineitem l join part p on l.l_partkey = p.p_partkey group by date_trunc('week', l.l_shipdate), p.p_brand)"""
RETS = "rets as (select *, close / nullif(lag(close) over (partition by symbol order by ts), 0) - 1 as ret from bars)"
BENCH = "bench as (select ts, avg(ret) as bench from rets group by ts)"


def r(x: str, digits: int = DIGITS) -> str:
    return f"round(({x})::double, {digits}) + 0.0"


def returns_of(b: DataFrame) -> DataFrame:
    return b.withColumn("ret", timeseries.simple_return(F.col("close")))


def weekly_returns(spark: SparkSession, sf: str) -> DataFrame:
    """Volumes and returns by week (ts, symbol, volume, ret), worked out once and kept, for queries that read them several times: a row for each name and week, however many ticks these have."""
    return saved(returns_of(bars.weekly(spark, sf)).select("ts", "symbol", "volume", "ret"), "weekly-returns")


def with_bench(b: DataFrame) -> DataFrame:
    """Returns beside their mean over symbols at each ts."""
    return returns_of(b).withColumn("bench", F.avg("ret").over(Window.partitionBy("ts")))


# Scans, upserts and coverage.


def a_scan(spark: SparkSession, sf: str) -> DataFrame:
    b = bars.hourly(spark, sf)
    return tidy(bars.scan(b, ["click", "view", "view"], "2024-01-20 12:00:00", 10, ["close", "volume"]))


def a_upsert(spark: SparkSession, sf: str) -> DataFrame:
    b = bars.hourly(spark, sf)
    new = b.where("hour(ts) % 3 = 0").withColumn("close", F.col("close") * 2)
    return tidy(bars.upsert(b, new).groupBy("symbol").agg(F.count("*").alias("n"), F.sum("close").alias("close"), F.sum("volume").alias("volume")), 4)


def fetches(spark: SparkSession, sf: str) -> DataFrame:
    e = spark.read.parquet(f"{sf}/events.parquet")
    ts = F.col("ts").cast("timestamp")
    return e.groupBy(F.col("user_id").cast("string").alias("symbol"), F.date_trunc("week", ts).alias("w")).agg(F.min(ts).alias("start"), F.max(ts).alias("end")).select("symbol", "start", "end", F.col("end").alias("fetched_at"))


FETCHES = "fetches as (select user_id::varchar as symbol, min(ts) as start, max(ts) as \"end\", max(ts) as fetched_at from events group by user_id, date_trunc('week', ts))"
ISLANDS = """reach as (select *, max("end") over (partition by symbol order by start, "end" rows between unbounded preceding and 1 preceding) as m from fetches),
marked as (select *, sum(case when m is null or start > m then 1 else 0 end) over (partition by symbol order by start, "end" rows unbounded preceding) as island from reach),
islands as (select symbol, min(start) as s, max("end") as e from marked group by symbol, island)"""
REQUEST = "('2024-01-05 00:00:00', '2024-01-25 00:00:00')"
GAPS = """asked as (select distinct symbol, timestamp '2024-01-05' as a, timestamp '2024-01-25' as d from fetches),
near as (select asked.symbol, a, d, s, e from asked join islands on asked.symbol = islands.symbol and e >= a and s <= d),
every as (select * from near union all select symbol, a, d, null, null from asked where (symbol, a, d) not in (select symbol, a, d from near)),
seq as (select *, lead(s) over w as nxt, row_number() over w = 1 as fst from every window w as (partition by symbol, a, d order by s)),
gaps as (
  select symbol, a as gap_start, coalesce(least(s, d), d) as gap_end from seq where fst
  union all select symbol, greatest(e, a), coalesce(least(nxt, d), d) from seq where e is not null)"""


def requests(f: DataFrame) -> DataFrame:
    return f.select("symbol").distinct().select("symbol", F.lit("2024-01-05").cast("timestamp").alias("start"), F.lit("2024-01-25").cast("timestamp").alias("end"))


def a_intervals(spark: SparkSession, sf: str) -> DataFrame:
    return tidy(coverage.merged(fetches(spark, sf)))


def a_gaps(spark: SparkSession, sf: str) -> DataFrame:
    f = fetches(spark, sf)
    return tidy(coverage.gaps(f, requests(f)))


def a_missing(spark: SparkSession, sf: str) -> DataFrame:
    f = fetches(spark, sf)
    return tidy(coverage.missing(f, requests(f)))


def a_vintage(spark: SparkSession, sf: str) -> DataFrame:
    return tidy(coverage.vintage(fetches(spark, sf), F.lit("2024-01-03").cast("timestamp"), F.lit("2024-01-10").cast("timestamp")))


def a_status(spark: SparkSession, sf: str) -> DataFrame:
    return tidy(coverage.status(fetches(spark, sf), bars.daily(spark, sf).where("ts >= '2024-01-20'")))


def a_sql(spark: SparkSession, sf: str) -> DataFrame:
    return tidy(bars.sql(bars.weekly(spark, sf), "select symbol, count(*) as n, max(close) as top from bars where volume > ? group by symbol", [10.0]))


# Time series and cross-sections.


def c_indicators(spark: SparkSession, sf: str) -> DataFrame:
    return tidy(timeseries.indicators(bars.hourly(spark, sf)).drop("open", "high", "low"), 5)


def c_latest(spark: SparkSession, sf: str) -> DataFrame:
    return tidy(timeseries.latest(bars.daily(spark, sf)))


def c_streaks(spark: SparkSession, sf: str) -> DataFrame:
    b = returns_of(bars.daily(spark, sf)).where("ret is not null").withColumn("up", F.col("ret") > 0)
    return timeseries.streaks(b, ["symbol"], "ts", "up")


def c_hysteresis(spark: SparkSession, sf: str) -> DataFrame:
    b = returns_of(bars.hourly(spark, sf)).withColumn("held", timeseries.held_direction(F.col("ret"), 0.2, -0.2))
    return tidy(b.groupBy("symbol").agg(F.sum("held").alias("bars_held"), F.count("*").alias("n")))


def c_ewma(spark: SparkSession, sf: str) -> DataFrame:
    return tidy(timeseries.ewma_variance(returns_of(bars.weekly(spark, sf)), decay=0.97), 8)


def x_scores(spark: SparkSession, sf: str) -> DataFrame:
    b = returns_of(bars.daily(spark, sf))
    x = F.col("ret")
    return tidy(b.select("ts", "symbol", xsection.zscore(x).alias("z"), xsection.winsorize(x).alias("w"), xsection.average_rank(x).alias("rank"), xsection.demean(x).alias("d"), xsection.neutralize(x, F.col("volume")).alias("neutral"), xsection.cap(x, 1.0).alias("capped")))


def x_refine(spark: SparkSession, sf: str) -> DataFrame:
    b = returns_of(bars.daily(spark, sf)).select("ts", "symbol", F.col("ret").alias("score"), F.col("volume").alias("exposure"), F.lit(0.3).alias("vol"))
    return tidy(xsection.refine(b).select("ts", "symbol", "alpha", "thin"))


def x_combine(spark: SparkSession, sf: str) -> DataFrame:
    b = returns_of(bars.daily(spark, sf))
    return tidy(xsection.combine(b, {"ret": 0.7, "volume": 0.3}).select("ts", "symbol", "combined"))


def x_top(spark: SparkSession, sf: str) -> DataFrame:
    return tidy(xsection.top(returns_of(bars.daily(spark, sf)).where("ret is not null").select("ts", "symbol", "ret"), "ret", 5))


# Metrics, risk and skill.


def e_returns(spark: SparkSession, sf: str) -> DataFrame:
    return tidy(metrics.return_metrics(returns_of(bars.weekly(spark, sf)), ["symbol"], ppy=52.0), 5)


def e_drawdown(spark: SparkSession, sf: str) -> DataFrame:
    return tidy(metrics.drawdown_metrics(bars.weekly(spark, sf).select("symbol", "ts", F.col("close").alias("equity")), ["symbol"]))


def e_metric_row(spark: SparkSession, sf: str) -> DataFrame:
    return tidy(metrics.metric_row(with_bench(bars.weekly(spark, sf)).withColumnRenamed("close", "equity"), ["symbol"], ppy=52.0).drop("downside", "sortino", "cvar_95", "skew", "kurtosis"), 5)


def e_benchmark(spark: SparkSession, sf: str) -> DataFrame:
    return tidy(metrics.benchmark_metrics(with_bench(bars.weekly(spark, sf)), ["symbol"], ppy=52.0))


def e_beta(spark: SparkSession, sf: str) -> DataFrame:
    return tidy(risk.beta(with_bench(bars.weekly(spark, sf)), 52.0))


def e_covariance(spark: SparkSession, sf: str) -> DataFrame:
    return tidy(risk.covariance(risk.complete_cases(weekly_returns(spark, sf).select("ts", "symbol", "ret"), 100)), 8)


def e_shrunk(spark: SparkSession, sf: str) -> DataFrame:
    return tidy(risk.shrunk(risk.complete_cases(weekly_returns(spark, sf).select("ts", "symbol", "ret"), 100)), 8)


def e_contributions(spark: SparkSession, sf: str) -> DataFrame:
    panel = risk.complete_cases(weekly_returns(spark, sf).select("ts", "symbol", "ret"), 100)
    weights = panel.select("symbol").distinct().withColumn("weight", (F.right("symbol", F.lit(1)).cast("double") + 1) / 100)
    return tidy(risk.contributions(risk.covariance(panel), weights))


def scored(spark: SparkSession, sf: str) -> DataFrame:
    w = Window.partitionBy("symbol").orderBy("ts")
    return returns_of(bars.weekly(spark, sf)).select("ts", "symbol", (-F.col("ret")).alias("score"), (S.ratio(F.lead("close").over(w), F.col("close")) - 1).alias("fwd"))


def e_information(spark: SparkSession, sf: str) -> DataFrame:
    return tidy(risk.information(scored(spark, sf)))


def e_ic_summary(spark: SparkSession, sf: str) -> DataFrame:
    return tidy(risk.ic_summary(risk.information(scored(spark, sf))))


# Trades, ledger and trials.


def trade_table(spark: SparkSession, sf: str) -> DataFrame:
    o = spark.read.parquet(f"{sf}/orders.parquet").select("o_orderkey", "o_orderdate")
    l = spark.read.parquet(f"{sf}/lineitem.parquet")  # noqa: E741
    p = spark.read.parquet(f"{sf}/part.parquet").select("p_partkey", "p_brand", "p_retailprice")
    joined = l.join(o, l.l_orderkey == o.o_orderkey).join(p, l.l_partkey == p.p_partkey).where("l_shipdate >= o_orderdate")
    q, price, entry = (F.col(c).cast("double") for c in ("l_quantity", "l_extendedprice", "p_retailprice"))
    return joined.select(
        F.col("p_brand").alias("symbol"), F.when(F.col("l_linestatus") == "F", "BUY").otherwise("SELL").alias("side"), F.col("l_returnflag").alias("exit_reason"),
        F.datediff("l_shipdate", "o_orderdate").alias("days"), (price - entry * q).alias("pnl"), (F.col("l_tax").cast("double") * price).alias("cost"), q.alias("size"),
    )


TRADES = """trades as (
  select p_brand as symbol, case when l_linestatus = 'F' then 'BUY' else 'SELL' end as side, l_returnflag as exit_reason, date_diff('day', o_orderdate::date, l_shipdate::date) as days,
    l_extendedprice::double - p_retailprice::double * l_quantity::double as pnl, l_tax::double * l_extendedprice::double as cost, l_quantity::double as size
  from lineitem join orders on l_orderkey = o_orderkey join part on l_partkey = p_partkey where l_shipdate >= o_orderdate)"""


def e_trades(spark: SparkSession, sf: str) -> DataFrame:
    return tidy(metrics.trade_metrics(trade_table(spark, sf), ["symbol"]), 4)


def e_exit_reason(spark: SparkSession, sf: str) -> DataFrame:
    return tidy(trades.by_exit_reason(trade_table(spark, sf)), 3)


def e_legs(spark: SparkSession, sf: str) -> DataFrame:
    return tidy(trades.legs(trade_table(spark, sf)), 2)


def held_bars(spark: SparkSession, sf: str) -> DataFrame:
    return returns_of(bars.hourly(spark, sf)).withColumn("held", timeseries.held_direction(F.col("ret"), 0.2, -0.2))


def g_trades(spark: SparkSession, sf: str) -> DataFrame:
    return tidy(trades.from_signals(held_bars(spark, sf)))


def g_barriers(spark: SparkSession, sf: str) -> DataFrame:
    b = held_bars(spark, sf)
    return tidy(trades.barrier_exits(trades.from_signals(b), b, stop=0.3, take=0.5))


def g_excursions(spark: SparkSession, sf: str) -> DataFrame:
    b = held_bars(spark, sf)
    return tidy(trades.excursions(trades.from_signals(b), b), 4)


def ledger_table(spark: SparkSession, sf: str) -> DataFrame:
    e = spark.read.parquet(f"{sf}/events.parquet")
    kind = F.create_map(*[F.lit(x) for p in (("purchase", "fill"), ("signup", "adopt"), ("error", "close"), ("view", "decision"), ("click", "intent")) for x in p])
    return e.select(
        F.col("event_id").alias("seq"), F.col("user_id").cast("string").alias("symbol"), kind[F.col("event_type")].alias("event"), F.when(F.col("event_id") % 3 == 0, "sell").otherwise("buy").alias("side"),
        F.floor(F.col("value")).cast("double").alias("qty"), (F.col("event_id") % 50).cast("string").alias("order_id"), F.when(F.col("event_id") % 2 == 0, "cumulative").otherwise("incremental").alias("basis"),
    )


LEDGER = """ledger as (
  select event_id as seq, user_id::varchar as symbol, case event_type when 'purchase' then 'fill' when 'signup' then 'adopt' when 'error' then 'close' when 'view' then 'decision' when 'click' then 'intent' end as event,
    case when event_id % 3 = 0 then 'sell' else 'buy' end as side, floor(value)::double as qty, (event_id % 50)::varchar as order_id, case when event_id % 2 = 0 then 'cumulative' else 'incremental' end as basis from events)"""
POSITIONS = """resets as (select symbol, max(seq) as since, arg_max(case when event = 'adopt' then qty else 0 end, seq) as base from ledger where event in ('close', 'adopt', 'flatten') group by symbol),
fills as (select l.*, case when side = 'sell' then -qty else qty end as signed from ledger l left join resets r on l.symbol = r.symbol where event = 'fill' and (since is null or seq > since)),
orders_ as (select symbol, order_id, coalesce(arg_max(signed, seq) filter (where basis <> 'incremental'), 0) + coalesce(sum(signed) filter (where basis = 'incremental'), 0) as q from fills group by symbol, order_id),
filled as (select symbol, sum(q) as q from orders_ group by symbol),
positions as (select coalesce(f.symbol, r.symbol) as symbol, coalesce(base, 0) + coalesce(q, 0) as position from filled f full join resets r on f.symbol = r.symbol)"""


def l_positions(spark: SparkSession, sf: str) -> DataFrame:
    return tidy(ledger.net_positions(ledger_table(spark, sf)))


def l_reconcile(spark: SparkSession, sf: str) -> DataFrame:
    expected = ledger.net_positions(ledger_table(spark, sf))
    s = F.col("symbol").cast("int")
    actual = expected.where(s % 5 != 0).withColumn("position", F.col("position") + F.when(s % 7 == 0, 1.0).otherwise(0.0))
    return tidy(ledger.reconcile(expected, actual))


def l_outcomes(spark: SparkSession, sf: str) -> DataFrame:
    return ledger.outcomes(ledger_table(spark, sf)).groupBy("next_event").agg(F.count("*").alias("n"))


def trial_table(spark: SparkSession, sf: str) -> DataFrame:
    c = spark.read.parquet(f"{sf}/customer.parquet")
    k = F.col("c_custkey")
    return c.select(
        k.cast("string").alias("id"), F.col("c_mktsegment").alias("strategy"), F.col("c_nationkey").cast("string").alias("universe_hash"), F.lit(1).alias("accounting"),
        F.element_at(F.array(*[F.lit(x) for x in ("backtest", "walkforward", "alpha", "research")]), (k % 4 + 1).cast("int")).alias("kind"), (k % 9).alias("n_trials_in_session"),
        (F.col("c_acctbal").cast("double") / 1000).alias("oos_sharpe"), k.alias("ts"), F.when(k % 11 == 0, k).alias("contaminated_at"), F.lit(None).cast("string").alias("contamination_reason"),
    )


TRIALS = """trials as (
  select c_custkey::varchar as id, c_mktsegment as strategy, c_nationkey::varchar as universe_hash, 1 as accounting, (['backtest', 'walkforward', 'alpha', 'research'])[c_custkey % 4 + 1] as kind,
    c_custkey % 9 as n_trials_in_session, c_acctbal::double / 1000 as oos_sharpe, c_custkey as ts, case when c_custkey % 11 = 0 then c_custkey end as contaminated_at from customer),
families as (select strategy, universe_hash, accounting, sum(case when kind in ('walkforward', 'research') then n_trials_in_session else 1 end)::bigint as n_tried from trials where kind <> 'alpha' group by all)"""


def t_families(spark: SparkSession, sf: str) -> DataFrame:
    return trials.family_counts(trial_table(spark, sf))


def t_leaderboard(spark: SparkSession, sf: str) -> DataFrame:
    return tidy(trials.leaderboard(trial_table(spark, sf), 10).select("id", "strategy", "oos_sharpe", "rank", "n_tried"))


def t_duplicates(spark: SparkSession, sf: str) -> DataFrame:
    return trials.duplicates(trial_table(spark, sf), ["strategy", "universe_hash", "kind"])


def t_compare(spark: SparkSession, sf: str) -> DataFrame:
    s = returns_of(bars.hourly(spark, sf)).select(F.col("symbol").alias("trial_id"), "ts", "ret")
    return tidy(trials.compare_series(s).select("a", "b", "overlap", "refused", "corr"))


def s_drift(spark: SparkSession, sf: str) -> DataFrame:
    b = bars.daily(spark, sf)
    return tidy(trials.drift(b.where("ts = '2024-01-05'"), b.where("ts = '2024-01-20'")))


# Summaries, scanners and reports.


def e_bar_summary(spark: SparkSession, sf: str) -> DataFrame:
    return tidy(reports.bar_summary(bars.weekly(spark, sf)))


def g_scan(spark: SparkSession, sf: str) -> DataFrame:
    return tidy(timeseries.latest(bars.as_of(reports.volume_scan(bars.hourly(spark, sf)).select("ts", "symbol", "ratio", "signal", "strength"), "2024-01-20 10:00:00")))


def g_forward(spark: SparkSession, sf: str) -> DataFrame:
    return tidy(reports.forward_evaluation(reports.volume_scan(bars.hourly(spark, sf)), 5))


def lagged(spark: SparkSession, sf: str) -> DataFrame:
    return returns_of(bars.weekly(spark, sf)).select("ts", "symbol", (-F.col("ret")).alias("score"), "ret")


def e_ic_by_lag(spark: SparkSession, sf: str) -> DataFrame:
    return tidy(reports.ic_by_lag(lagged(spark, sf), 4))


def e_decay(spark: SparkSession, sf: str) -> DataFrame:
    """The decay of the coefficients' sizes over all lags; e_horizon takes the positive ones alone."""
    return tidy(reports.decay_fit(reports.ic_by_lag(lagged(spark, sf), 4).withColumn("mean_ic", F.abs("mean_ic"))))


def e_forecast(spark: SparkSession, sf: str) -> DataFrame:
    past = Window.partitionBy("symbol").orderBy("ts").rowsBetween(-8, -1)
    b = returns_of(bars.weekly(spark, sf)).withColumn("q", F.col("ret") * F.col("ret"))
    return tidy(reports.forecast_quality(b.select("symbol", F.col("q").alias("realized"), F.avg("q").over(past).alias("forecast"))))


def e_regimes(spark: SparkSession, sf: str) -> DataFrame:
    past = Window.orderBy("ts").rowsBetween(-7, 0)
    book = returns_of(bars.weekly(spark, sf)).groupBy("ts").agg(F.avg("ret").alias("ret")).where("ret is not null")
    return tidy(reports.regimes(book.select("ret", F.stddev_samp("ret").over(past).alias("vol")), "vol", "ret"))


def x_buckets(spark: SparkSession, sf: str) -> DataFrame:
    vols = returns_of(bars.daily(spark, sf)).groupBy("symbol").agg(F.stddev_samp("ret").alias("vol"))
    return tidy(reports.risk_buckets(vols, 5), 4)


def e_exposure(spark: SparkSession, sf: str) -> DataFrame:
    return tidy(reports.exposure_report(bars.daily(spark, sf).select(F.col("high").alias("equity"), (F.col("close") - F.col("open")).alias("net")), [0.25, 0.5, 0.9, 1.0, 2.0]))


def e_excursion(spark: SparkSession, sf: str) -> DataFrame:
    return tidy(reports.excursion(bars.weekly(spark, sf).select("symbol", "ts", F.col("close").alias("equity_close"), F.col("low").alias("equity_adverse")), ["symbol"]))


def e_capacity(spark: SparkSession, sf: str) -> DataFrame:
    h = returns_of(bars.weekly(spark, sf)).groupBy("symbol").agg(F.lit(0.04).alias("weight"), F.avg(F.col("close") * F.col("volume")).alias("adv"), F.stddev_samp("ret").alias("vol"))
    return tidy(reports.capacity(h, 0.05, grid=(1e3, 1e6, 4)))


def e_active(spark: SparkSession, sf: str) -> DataFrame:
    w = lambda day: bars.daily(spark, sf).where(F.col("ts") == day).select("symbol", F.col("volume").alias("weight"))
    return tidy(reports.active_weights(w("2024-01-05"), w("2024-01-20")))


def j_asof(spark: SparkSession, sf: str) -> DataFrame:
    e = spark.read.parquet(f"{sf}/events.parquet").select(F.col("user_id").alias("key"), F.col("ts").cast("timestamp").alias("ts"), "event_type", "value")
    left = e.where("event_type = 'purchase'").select("key", "ts")
    return tidy(reports.asof(left, e.where("event_type = 'view'").select("key", "ts", "value"), "value").groupBy("key").agg(F.count("*").alias("n"), F.count("value").alias("matched"), F.sum("value").alias("value")), 4)


def p_distribution(spark: SparkSession, sf: str) -> DataFrame:
    return tidy(reports.score_distribution(sweep.crossover_sweep(bars.weekly(spark, sf), [4, 8], [12, 26], 52.0), "total", ["fast", "slow"]), 4)


# Factors, attribution and ingest.

EXPOSURES = ["size", "momentum"]


def exposed(spark: SparkSession, sf: str) -> DataFrame:
    """Weekly returns beside last week's exposures, equal weights, unit betas and the mean return."""
    w = Window.partitionBy("symbol").orderBy("ts")
    b = with_bench(bars.weekly(spark, sf)).withColumns({"size": F.ln(F.lag("volume").over(w)), "momentum": F.lag("ret").over(w), "weight": (F.right("symbol", F.lit(1)).cast("double") - 3) / 10, "beta": F.lit(1.0)})
    return b.where("ret is not null and size is not null and momentum is not null")


def r_neutral(spark: SparkSession, sf: str) -> DataFrame:
    return tidy(factors.neutralized(exposed(spark, sf), "ret", EXPOSURES))


def r_factor_cov(spark: SparkSession, sf: str) -> DataFrame:
    return tidy(factors.factor_covariance(factors.factor_returns(exposed(spark, sf), EXPOSURES)))


def r_specific(spark: SparkSession, sf: str) -> DataFrame:
    panel = exposed(spark, sf)
    return tidy(factors.specific_variance(panel, EXPOSURES, factors.factor_returns(panel, EXPOSURES)))


def r_attribution(spark: SparkSession, sf: str) -> DataFrame:
    return tidy(factors.attribution_report(factors.attribution(exposed(spark, sf), EXPOSURES), 52.0))


def r_conditioned(spark: SparkSession, sf: str) -> DataFrame:
    panel = risk.complete_cases(weekly_returns(spark, sf).select("ts", "symbol", "ret"), 100)
    return tidy(factors.conditioned(risk.covariance(panel), panel.groupBy("symbol").agg((F.avg(F.col("ret") * F.col("ret")) * 2).alias("variance"))), 8)


def r_har(spark: SparkSession, sf: str) -> DataFrame:
    return tidy(factors.har_features(returns_of(bars.weekly(spark, sf))))


def a_journal(spark: SparkSession, sf: str) -> DataFrame:
    """Journal lines made of customers, every 13th one broken, read back with their session's context."""
    c = spark.read.parquet(f"{sf}/customer.parquet")
    k = F.col("c_custkey")
    start = k % 10 == 1
    line = F.to_json(F.struct(
        F.when(start, "session_start").otherwise("backtest").alias("tool"), k.cast("string").alias("run_id"), F.floor(k / 10).cast("string").alias("session_id"),
        F.struct(F.when(start, F.col("c_mktsegment")).alias("strategy")).alias("inputs"), (k % 10).alias("n_trials"),
    ))
    rows, _ = ingest.parsed(c.select(k.alias("seq"), F.when(k % 13 == 0, F.lit("{broken")).otherwise(line).alias("value")), ingest.JOURNAL, "tool")
    return ingest.with_session(rows).select("seq", "session_id", "strategy", F.col("n_trials_in_round").alias("n"))


def a_holdings(spark: SparkSession, sf: str) -> DataFrame:
    s = spark.read.parquet(f"{sf}/supplier.parquet").select(F.concat(F.lit(" s"), "s_nationkey").alias("symbol"), F.abs(F.col("s_acctbal").cast("double")).alias("weight"))
    return tidy(ingest.holdings(s.groupBy("symbol").agg(F.sum("weight").alias("weight"))))


def p_null(spark: SparkSession, sf: str) -> DataFrame:
    """Rows only, as p_bootstrap."""
    book = returns_of(bars.weekly(spark, sf)).groupBy("ts").agg(F.avg("ret").alias("ret")).where("ret is not null")
    series = book.select((F.row_number().over(Window.orderBy("ts")) - 1).alias("i"), "ret")
    return tidy(sweep.null_p_value(series, 200, 8.0, ppy=52.0))


# Sweeps, folds and the bar check.


def p_sweep(spark: SparkSession, sf: str) -> DataFrame:
    return tidy(sweep.ranked(sweep.crossover_sweep(bars.weekly(spark, sf), [4, 8], [12, 26], 52.0), "sharpe", ["fast", "slow"]))


def p_folds(spark: SparkSession, sf: str) -> DataFrame:
    plan = sweep.folds(spark, datetime(1993, 1, 4), datetime(1998, 1, 5), train_days=364, test_days=182, embargo_days=7)
    rows = sweep.by_fold(returns_of(bars.weekly(spark, sf)).where("ret is not null"), plan)
    return tidy(rows.groupBy("fold", "segment").agg(F.count("*").alias("n"), F.avg("ret").alias("mean"), F.stddev_samp("ret").alias("std")))


def c_liquidity(spark: SparkSession, sf: str) -> DataFrame:
    return tidy(studies.liquidity_inputs(bars.weekly(spark, sf)), 5)


def c_gap(spark: SparkSession, sf: str) -> DataFrame:
    return tidy(bars.hourly(spark, sf).select("ts", "symbol", studies.gap_score(F.col("close"), 5, 20).alias("gap")))


def c_points(spark: SparkSession, sf: str) -> DataFrame:
    return tidy(studies.rebalance_points(bars.weekly(spark, sf), 4, 24))


def e_breadth(spark: SparkSession, sf: str) -> DataFrame:
    found = studies.residual_correlation(with_bench(bars.weekly(spark, sf)))
    return tidy(found.withColumn("breadth", studies.effective_breadth(F.col("names"), F.lit(12.0), F.coalesce("rho", F.lit(0.0)))))


def x_case(spark: SparkSession, sf: str) -> DataFrame:
    b = bars.weekly(spark, sf).withColumn("ret", timeseries.simple_return(F.col("close")))
    return tidy(studies.case_scale(b.withColumn("vol", timeseries.rolling_std(F.col("ret"), 10)), "ret", "vol"))


def x_exposures(spark: SparkSession, sf: str) -> DataFrame:
    b = with_bench(bars.weekly(spark, sf))
    return tidy(studies.factor_exposures(b, risk.beta(b, 52.0), momentum=26, skip=4, vol=12), 5)


def book(spark: SparkSession, sf: str) -> DataFrame:
    """An open position for two of three brands, with its levels about the first close."""
    k = F.right("symbol", F.lit(1)).cast("int")
    first = bars.weekly(spark, sf).groupBy("symbol").agg(F.min_by("close", "ts").alias("price"))
    side = F.when(k % 3 == 1, "BUY").when(k % 3 == 2, "SELL")
    wide = lambda sign: F.col("price") * (1 + sign * F.when(side == "BUY", 0.1).otherwise(-0.1))
    return first.select("symbol", side.alias("side"), wide(-1).alias("stop_loss"), wide(1).alias("take_profit")).where("side is not null")


def g_exits(spark: SparkSession, sf: str) -> DataFrame:
    return tidy(studies.exit_flags(bars.weekly(spark, sf), book(spark, sf)).select("ts", "symbol", "exit_reason", "signal"))


def g_valid(spark: SparkSession, sf: str) -> DataFrame:
    at = F.month("ts") % 4
    signals = bars.weekly(spark, sf).select("ts", "symbol", F.when(at == 0, "BUY").when(at == 1, "SELL").when(at == 2, "CLOSE_BUY").otherwise("CLOSE_SELL").alias("signal"))
    return tidy(studies.valid_signals(signals, book(spark, sf)))


def e_fill_gaps(spark: SparkSession, sf: str) -> DataFrame:
    """Order lines as orders: returned ones are unfilled, others lose their discount."""
    l = spark.read.parquet(f"{sf}/lineitem.parquet")  # noqa: E741
    price, off = F.col("l_extendedprice").cast("double"), F.col("l_discount").cast("double")
    outcome = F.when(F.col("l_returnflag") == "R", "rounded").when(F.col("l_quantity") < 3, "too_small").otherwise("filled")
    orders = l.select(F.year("l_shipdate").alias("year"), price.alias("requested"), F.when(outcome == "filled", price * (1 - off)).otherwise(0.0).alias("filled"), outcome.alias("outcome"))
    return tidy(studies.fill_gaps(orders, ["year"]))


def t_panel(spark: SparkSession, sf: str) -> DataFrame:
    rets = returns_of(bars.weekly(spark, sf)).where("ret is not null").select(F.col("symbol").alias("trial_id"), "ts", "ret")
    return tidy(studies.returns_panel(rets, 60))


def p_overfit(spark: SparkSession, sf: str) -> DataFrame:
    """Years as folds: mean weekly return over all names in the first half of a year, and in the second."""
    half = lambda first: F.avg(F.when((F.month("ts") <= 6) == F.lit(first), F.col("ret")))
    return tidy(sweep.overfit_share(returns_of(bars.weekly(spark, sf)).groupBy(F.year("ts").alias("fold")).agg(half(True).alias("is_score"), half(False).alias("oos_score"))))


def p_bootstrap(spark: SparkSession, sf: str) -> DataFrame:
    """Rows only: resamples are hash-drawn, so SQL has no counterpart; invariants are tested."""
    book = returns_of(bars.weekly(spark, sf)).groupBy("ts").agg(F.avg("ret").alias("ret")).where("ret is not null")
    series = book.select((F.row_number().over(Window.orderBy("ts")) - 1).alias("i"), "ret")
    return tidy(sweep.stationary_bootstrap(series, 200, 8.0, ppy=52.0))


def w_barcheck(spark: SparkSession, sf: str) -> DataFrame:
    """Rows only: each verdict depends on the last bar accepted, a recursion."""
    return barcheck.rejection_counts(barcheck.batch_verdicts(bars.daily(spark, sf)))


def w_faults(spark: SparkSession, sf: str) -> DataFrame:
    """Bars of the 3rd are given a low over their high, unless a price of theirs is already at fault; those of the 4th a negative volume."""
    b = bars.daily(spark, sf).withColumn("low", F.when((F.dayofmonth("ts") == 3) & (F.col("low") > 0), F.col("high") * 2).otherwise(F.col("low"))).withColumn("volume", F.when(F.dayofmonth("ts") == 4, -1.0).otherwise(F.col("volume")))
    return barcheck.checked(b).groupBy(F.coalesce("fault", F.lit("none")).alias("fault")).agg(F.count("*").alias("n"))


W = "partition by symbol order by ts"
HELD = "held_ as (select *, coalesce(last_value(case when ret > 0.2 then 1 when ret <= -0.2 then 0 end ignore nulls) over (partition by symbol order by ts rows unbounded preceding), 0) as held from rets)"
EXTRACTED = """acted as (select *, coalesce(lag(held) over (partition by symbol order by ts), 0) as on_, lead(ts) over (partition by symbol order by ts) is null as lst from held_),
acted2 as (select *, coalesce(lag(on_) over (partition by symbol order by ts), 0) as was from acted),
evs as (select *, sum(case when on_ = 1 and was = 0 then 1 else 0 end) over (partition by symbol order by ts rows unbounded preceding) as k from acted2),
tr as (select symbol, min(ts) as entry_time, arg_min(open, ts) as entry_price, max(ts) as exit_time, arg_max(case when on_ = 0 then open else close end, ts) as exit_price,
  arg_max(case when on_ = 0 then 'SIGNAL' else 'END_OF_PERIOD' end, ts) as exit_reason from evs where on_ = 1 or was = 1 group by symbol, k)"""
ALPHA = 2 / 21
FLAT_Z = "case when ret is null then null when coalesce(sd, 0) <= 1e-12 * greatest(1, ma) then 0 else (ret - mu) / sd end"
XS = f"""xs as (select *, stddev_pop(ret) over w as sd, avg(ret) over w as mu, avg(abs(ret)) over w as ma, quantile_cont(ret, 0.025) over w as q1, quantile_cont(ret, 0.975) over w as q2,
  count(ret) over w as nn, regr_slope(ret, case when ret is not null then volume end) over w as sl, regr_intercept(ret, case when ret is not null then volume end) over w as ic,
  avg(volume) over w as vm, stddev_pop(volume) over w as vs, avg(abs(volume)) over w as va from rets window w as (partition by ts))"""
SCAN = f"""v as (select *, volume / nullif(case when count(volume) over w = 20 then avg(volume) over w end, 0) as ratio, (close - open) / nullif(open, 0) as step from bars window w as ({W} rows between 19 preceding and current row)),
sig as (select *, case when ratio > 1.5 and abs(step) > 0.01 and volume >= 1 then case when step > 0 then 'BUY' else 'SELL' end else 'HOLD' end as signal, case when ratio > 1.5 and abs(step) > 0.01 and volume >= 1 then least(ratio / 1.5 / 2, 1) else 0 end as strength from v)"""
LAGS = f"""lg as ({' union all '.join(f'select {k} as lag, ts, -ret as score, lead(ret, {k}) over ({W}) as fwd from rets' for k in (1, 2, 3, 4))}),
pl as (select lag, ts, case when stddev_pop(score) * stddev_pop(fwd) > 1e-18 then covar_pop(score, fwd) / (stddev_pop(score) * stddev_pop(fwd)) end as ic from lg where score is not null and fwd is not null group by lag, ts),
prof as (select lag, count(ic) as n, avg(ic) as mean_ic from pl group by lag)"""
BOOK = """book as (select symbol, side, sg, price * (1 - sg * 0.1) as stop_loss, price * (1 + sg * 0.1) as take_profit
  from (select symbol, arg_min(close, ts) as price, case "right"(symbol, 1)::int % 3 when 1 then 'BUY' when 2 then 'SELL' end as side, case "right"(symbol, 1)::int % 3 when 1 then 1 when 2 then -1 end as sg from bars group by symbol) where side is not null)"""
#: Two exposures and an intercept by their normal equations: each ts is one aggregate.
EXPOSED = f"""wb as (select *, avg(ret) over (partition by ts) as bench from rets),
ex0 as (select ts, symbol, ret, bench, ln(lag(volume) over ({W})) as size, lag(ret) over ({W}) as momentum, ("right"(symbol, 1)::double - 3) / 10 as weight from wb),
ex as (select *, ret - bench as rest from ex0 where ret is not null and size is not null and momentum is not null),
mo as (select ts, count(*) as n, avg(size) as m1, avg(momentum) as m2, avg(ret) as my, avg(rest) as mr, var_pop(size) as s11, var_pop(momentum) as s22, covar_pop(size, momentum) as s12,
  covar_pop(size, ret) as s1y, covar_pop(momentum, ret) as s2y, covar_pop(size, rest) as s1r, covar_pop(momentum, rest) as s2r from ex group by ts),
sl as (select *, (s1y * s22 - s2y * s12) / nullif(s11 * s22 - s12 * s12, 0) as b1, (s2y * s11 - s1y * s12) / nullif(s11 * s22 - s12 * s12, 0) as b2,
  (s1r * s22 - s2r * s12) / nullif(s11 * s22 - s12 * s12, 0) as c1, (s2r * s11 - s1r * s12) / nullif(s11 * s22 - s12 * s12, 0) as c2 from mo),
fit as (select *, my - b1 * m1 - b2 * m2 as b0, mr - c1 * m1 - c2 * m2 as c0 from sl),
fr as (select ts, unnest(['market', 'size', 'momentum']) as factor, unnest([b0, b1, b2]) as ret from fit where n > 3)"""
PARTS = """att as (select ts, sum(weight * ret) as total, sum(weight * bench) as systematic, sum(weight * case when n > 3 then c0 + c1 * size + c2 * momentum else 0 end) as factor from ex join fit using (ts) group by ts),
comp as (select unnest(['systematic', 'factor', 'specific']) as component, unnest([systematic, factor, total - systematic - factor]) as x from att)"""
CC = """kept as (select symbol from rets where ret is not null group by symbol having count(*) >= 100),
panel as (select ts, symbol, ret from (select *, count(*) over (partition by ts) as k from rets where ret is not null and symbol in (select symbol from kept)) where k = (select count(*) from kept)),
cov as (select a.symbol as i, b.symbol as j, covar_pop(a.ret, b.ret) as cov, count(*) as n from panel a join panel b on a.ts = b.ts and a.symbol <= b.symbol group by 1, 2)"""
SCORED = """scored as (select ts, symbol, -ret as score, lead(close) over (partition by symbol order by ts) / nullif(close, 0) - 1 as fwd from rets),
both_ as (select * from scored where score is not null and fwd is not null),
rk as (select *, rank() over (partition by ts order by score) + (count(*) over (partition by ts, score) - 1) / 2.0 as rs, rank() over (partition by ts order by fwd) + (count(*) over (partition by ts, fwd) - 1) / 2.0 as rf from both_),
info as (select ts, count(*) as n, case when stddev_pop(score) * stddev_pop(fwd) > 1e-18 then covar_pop(score, fwd) / (stddev_pop(score) * stddev_pop(fwd)) end as ic,
  case when stddev_pop(rs) * stddev_pop(rf) > 1e-18 then covar_pop(rs, rf) / (stddev_pop(rs) * stddev_pop(rf)) end as rank_ic from rk group by ts)"""


def flat(x: str) -> str:
    return f"coalesce(stddev_samp({x}), 0) <= 1e-12 * greatest(1, avg(abs({x})))"


def sharpe(x: str, ppy: float) -> str:
    return f"case when {flat(x)} then 0 else sqrt({ppy}) * avg({x}) / stddev_samp({x}) end"


SQL = {
    "a_scan": f"with {HOUR} select epoch(ts)::bigint as ts, symbol, {r('close')} as close, {r('volume')} as volume from bars where ts > timestamp '2024-01-10 12:00:00' and ts <= timestamp '2024-01-20 12:00:00' and symbol in ('click', 'view')",
    "a_upsert": f"with {HOUR} select symbol, count(*) as n, {r('sum(case when hour(ts) % 3 = 0 then close * 2 else close end)', 4)} as close, {r('sum(volume)', 4)} as volume from bars group by symbol",
    "a_intervals": f"with {FETCHES}, {ISLANDS} select symbol, floor(epoch(s))::bigint as start, floor(epoch(e))::bigint as \"end\" from islands",
    "a_gaps": f"with {FETCHES}, {ISLANDS}, {GAPS} select symbol, floor(epoch(gap_start))::bigint as gap_start, floor(epoch(gap_end))::bigint as gap_end from gaps where gap_start < gap_end",
    "a_missing": f"with {FETCHES}, {ISLANDS}, {GAPS} select symbol, floor(epoch(min(gap_start)))::bigint as start, floor(epoch(max(gap_end)))::bigint as \"end\", count(*) as n_gaps from gaps where gap_start < gap_end group by symbol",
    "a_vintage": f"with {FETCHES} select symbol, floor(epoch(max(fetched_at)))::bigint as vintage from fetches where \"end\" > timestamp '2024-01-03' and start < timestamp '2024-01-10' group by symbol",
    "a_status": f"with {FETCHES}, {DAY} select symbol, floor(epoch(min(start)))::bigint as start, floor(epoch(max(\"end\")))::bigint as \"end\", floor(epoch(max(fetched_at)))::bigint as fetched_at, symbol not in (select symbol from bars where ts >= timestamp '2024-01-20') as drift from fetches group by symbol",
    "a_sql": f"with {WEEK} select symbol, count(*) as n, {r('max(close)')} as top from bars where volume > 10 group by symbol",
    "c_indicators": f"""with {HOUR}, {RETS},
steps as (select *, greatest(close - lag(close) over w, 0) as gain, greatest(lag(close) over w - close, 0) as loss, greatest(high - low, abs(high - lag(close) over w), abs(low - lag(close) over w)) as tr from rets window w as ({W})),
fix as (select * replace (case when ret is null and lag(close) over w is null then null else gain end as gain, case when lag(close) over w is null then null else loss end as loss) from steps window w as ({W})),
agg as (select *, count(close) over w20 as n20, avg(close) over w20 as a20, stddev_pop(close) over w20 as s20, avg(volume) over w20 as v20, count(gain) over w14 as n14, avg(gain) over w14 as g14, avg(loss) over w14 as l14,
  count(tr) over w14 as nt, avg(tr) over w14 as t14, count(high) over p20 as np, max(high) over p20 as hp, avg(close * volume) over p20 as dv, count(ret) over p20 as nr, stddev_samp(ret) over p20 as rv, max(close) over (partition by symbol order by ts rows unbounded preceding) as top,
  list(close) over (partition by symbol order by ts rows unbounded preceding) as hist
  from fix window w20 as ({W} rows between 19 preceding and current row), w14 as ({W} rows between 13 preceding and current row), p20 as ({W} rows between 20 preceding and 1 preceding))
select epoch(ts)::bigint as ts, symbol, {r('close', 5)} as close, {r('volume', 5)} as volume, {r('ret', 5)} as ret, {r('case when n20 = 20 then a20 end', 5)} as sma,
  {r(f'list_reduce(hist, lambda e, v: e * (1 - {ALPHA!r}) + v * {ALPHA!r})', 5)} as ema,
  {r('case when n14 = 14 and l14 > 0 then 100 - 100 / (1 + g14 / l14) when n14 = 14 and g14 > 0 then 100 end', 5)} as rsi, {r('case when nt = 14 then t14 end', 5)} as atr,
  {r('case when n20 = 20 and s20 > 1e-12 then (close - a20) / s20 end', 5)} as z, {r('case when np = 20 then hp end', 5)} as donchian, {r('case when np = 20 then dv end', 5)} as adv, {r('case when nr = 20 then rv end', 5)} as ret_vol,
  coalesce(volume > 1.5 * case when n20 = 20 then v20 end and abs(ret) > 0.01, false) as spike, {r('close / nullif(top, 0) - 1', 5)} as drawdown from agg""",
    "c_latest": f"with {DAY} select symbol, epoch(max(ts))::bigint as ts, {', '.join(f'{r(f'arg_max({c}, ts)')} as {c}' for c in ('open', 'high', 'low', 'close', 'volume'))} from bars group by symbol",
    "c_streaks": f"with {DAY}, {RETS}, f as (select symbol, ts, ret > 0 as up from rets where ret is not null), i as (select *, row_number() over (partition by symbol order by ts) - row_number() over (partition by symbol, up order by ts) as island from f), c as (select symbol, up, island, count(*) as k from i group by all) select symbol, coalesce(max(k) filter (where up), 0) as longest_true, coalesce(max(k) filter (where not up), 0) as longest_false from c group by symbol",
    "c_hysteresis": f"with {HOUR}, {RETS}, {HELD} select symbol, sum(held)::bigint as bars_held, count(*) as n from held_ group by symbol",
    "c_ewma": f"with {WEEK}, {RETS}, q as (select symbol, ret * ret as q, row_number() over (partition by symbol order by ts) as i, count(*) over (partition by symbol) as n from rets where ret is not null) select symbol, {r('avg(q) filter (where i <= 20) * first(pow(0.97, n - 20)) + coalesce(sum(case when i > 20 then 0.03 * pow(0.97, n - i) * q end), 0)', 8)} as variance from q where n >= 20 group by symbol",
    "x_scores": f"""with {DAY}, {RETS}, {XS} select epoch(ts)::bigint as ts, symbol, {r(FLAT_Z)} as z, {r('case when ret is not null then least(greatest(ret, q1), q2) end')} as w,
  {r('case when ret is not null then rank() over (partition by ts order by ret nulls last) + (count(*) over (partition by ts, ret) - 1) / 2.0 end')} as rank, {r('ret - mu')} as d,
  {r('case when ret is null or nn < 2 or sl is null or isnan(sl) then ret else ret - ic - sl * volume end')} as neutral, {r('case when ret is null then null when coalesce(sd, 0) <= 1e-12 * greatest(1, ma) then ret else least(greatest(ret, -sd), sd) end')} as capped from xs""",
    "x_combine": f"with {DAY}, {RETS}, {XS} select epoch(ts)::bigint as ts, symbol, {r(f'0.7 * coalesce({FLAT_Z}, 0) + 0.3 * (case when vs <= 1e-12 * greatest(1, va) then 0 else (volume - vm) / vs end)')} as combined from xs",
    "x_top": f"with {DAY}, {RETS} select epoch(ts)::bigint as ts, symbol, {r('ret')} as ret, rank from (select ts, symbol, ret, row_number() over (partition by ts order by abs(ret) desc, symbol)::int as rank from rets where ret is not null) where rank <= 5",
    "e_returns": f"""with {WEEK}, {RETS}, g as (select *, quantile_cont(ret, 0.05) over (partition by symbol) as cut from rets where ret is not null)
select symbol, count(*) as n, {r('exp(sum(ln(1 + case when ret > -1 then ret end))) - 1', 5)} as total_return, {r('coalesce(stddev_samp(ret), 0) * sqrt(52)', 5)} as volatility, {r('sqrt(avg(pow(least(ret, 0), 2))) * sqrt(52)', 5)} as downside, {r(sharpe('ret', 52), 5)} as sharpe,
  {r('case when avg(pow(least(ret, 0), 2)) <> 0 then avg(ret) * sqrt(52) / sqrt(avg(pow(least(ret, 0), 2))) else 0 end', 5)} as sortino, {r('greatest(-quantile_cont(ret, 0.05), 0)', 5)} as var_95, {r('greatest(-avg(ret) filter (where ret <= cut), 0)', 5)} as cvar_95,
  {r(f'case when count(*) >= 3 and not {flat("ret")} then skewness(ret) else 0 end', 5)} as skew, {r(f'case when count(*) >= 4 and not {flat("ret")} then kurtosis(ret) else 0 end', 5)} as kurtosis,
  {r('abs(quantile_cont(ret, 0.95)) / abs(quantile_cont(ret, 0.05))', 5)} as tail_ratio, {r('sum(greatest(ret, 0)) / -sum(least(ret, 0))', 5)} as omega, {r('sum(ret) / -sum(least(ret, 0))', 5)} as gain_to_pain,
  {r('max(ret)', 5)} as best, {r('min(ret)', 5)} as worst, {r('count(*) filter (where ret > 0) / count(*)', 5)} as win_rate from g group by symbol""",
    "e_drawdown": f"""with {WEEK}, d as (select symbol, ts, close / max(close) over (partition by symbol order by ts rows unbounded preceding) - 1 as dd from bars),
i as (select *, row_number() over (partition by symbol order by ts) - row_number() over (partition by symbol, dd < 0 order by ts) as island from d), c as (select symbol, dd < 0 as u, island, count(*) as k from i group by 1, 2, 3)
select symbol, {r('min(dd)')} as max_drawdown, {r('avg(dd)')} as avg_drawdown, {r('sqrt(avg(dd * dd))')} as ulcer, (select coalesce(max(k), 0) from c where c.symbol = d.symbol and u) as longest_under from d group by symbol""",
    "e_benchmark": f"""with {WEEK}, {RETS}, {BENCH}, g as (select * from rets join bench using (ts) where ret is not null and bench is not null) select symbol, {r('regr_intercept(ret, bench)')} as alpha, {r('regr_slope(ret, bench)')} as beta, {r('regr_r2(ret, bench)')} as r2,
  {r(sharpe('(ret - bench)', 52))} as information_ratio, {r('covar_samp(ret, bench) / var_samp(bench)')} as beta_or_one from g group by symbol""",
    "e_beta": f"""with {WEEK}, {RETS}, {BENCH}, g as (select symbol, count(*) as n, covar_samp(ret, bench) as c, var_samp(bench) as vb, var_samp(ret) as vr from rets join bench using (ts) where ret is not null group by symbol)
select symbol, n, {r('c / vb')} as beta, {r('sqrt(greatest(vr - c * c / vb, 0) * 52)')} as residual_vol, {r('sqrt(vr * 52)')} as total_vol from g""",
    "e_covariance": f"with {WEEK}, {RETS}, {CC} select i, j, {r('cov', 8)} as cov, n from cov",
    "e_shrunk": f"""with {WEEK}, {RETS}, {CC}, ce as (select ts, symbol, ret - avg(ret) over (partition by symbol) as x from panel),
pr as (select a.symbol as i, b.symbol as j, avg(a.x * b.x) as cov, avg(a.x * a.x * b.x * b.x) as sq, avg(a.x * a.x * a.x * b.x) as xxxy, avg(b.x * b.x * b.x * a.x) as yyyx, avg(a.x * a.x) as vi, avg(b.x * b.x) as vj, count(*) as n
  from ce a join ce b on a.ts = b.ts and a.symbol <= b.symbol group by 1, 2),
rh as (select avg(cov / sqrt(vi * vj)) filter (where i < j) as rho from pr),
tg as (select *, case when i < j then rho * sqrt(vi * vj) else cov end as target, case when i < j then 2 else 1 end as k from pr, rh),
su as (select sum(k * (sq - cov * cov)) as p, sum(case when i < j then rho * (sqrt(vj / vi) * (xxxy - vi * cov) + sqrt(vi / vj) * (yyyx - vj * cov)) else sq - cov * cov end) as r, sum(k * (target - cov) ** 2) as gap, max(n) as t from tg),
de as (select greatest(0, least(1, (p - r) / gap / t)) as d from su)
select i, j, {r('d * target + (1 - d) * cov', 8)} as cov, {r('d', 8)} as intensity from tg, de""",
    "e_metric_row": f"""with {WEEK}, {RETS}, {BENCH}, q as (select *, max(close) over ({W} rows unbounded preceding) as peak from rets join bench using (ts)),
u as (select *, close / peak - 1 as dd, row_number() over ({W}) as i from q), v as (select *, i - row_number() over (partition by symbol, dd < 0 order by ts) as island from u),
lo as (select symbol, max(k) as longest_under from (select symbol, count(*) as k from v where dd < 0 group by symbol, island) group by symbol),
be as (select symbol, case when count(*) < 3 or {flat('bench')} or {flat('ret')} then 0 else regr_slope(ret, bench) end as beta from rets join bench using (ts) where ret is not null and bench is not null group by symbol),
g as (select symbol, count(ret) as n, arg_min(close, ts) as first, arg_max(close, ts) as last, (epoch(max(ts)) - epoch(min(ts))) / (365.25 * 86400) as years, max(peak - close) as lost, min(dd) as mdd, avg(dd) as add, sqrt(avg(dd * dd)) as ulcer,
  avg(ret) as mean, coalesce(stddev_samp(ret) * sqrt(52), 0) as volatility, {sharpe('ret', 52)} as sharpe, greatest(-quantile_cont(ret, 0.05), 0) as var_95, greatest(-quantile_cont(ret, 0.01), 0) as var_99 from u group by symbol),
h as (select *, case when years > 0 and n >= 1 then pow(last / first, 1 / years) - 1 else 0 end as cagr from g)
select symbol, n, n < 30 as low_sample, {r('cagr', 5)} as cagr, {r('volatility', 5)} as volatility, {r('sharpe', 5)} as sharpe, {r('mdd', 5)} as max_drawdown, {r('add', 5)} as avg_drawdown, {r('ulcer', 5)} as ulcer, coalesce(longest_under, 0) as longest_under,
  {r('var_95', 5)} as var_95, {r('var_99', 5)} as var_99, {r("case when mdd = 0 then 'inf'::double else cagr / abs(mdd) end", 5)} as calmar, {r("case when add = 0 then 'inf'::double else cagr / abs(add) end", 5)} as sterling,
  {r("case when lost = 0 then 'inf'::double else (last - first) / lost end", 5)} as recovery, {r('case when ulcer = 0 then 0 else cagr / ulcer end', 5)} as martin, {r('case when abs(beta) >= 0.05 then mean * 52 / beta else 0 end', 5)} as treynor
from h left join lo using (symbol) join be using (symbol) where n > 0""",
    "c_liquidity": f"""with {WEEK}, {RETS}, z as (select *, row_number() over (partition by symbol order by ts desc) as k, count(*) over (partition by symbol) as n from rets)
select symbol, {r('coalesce(least(greatest(median((high - low) / nullif(close, 0)) * 0.1, 0.0001), 0.02), 0.0005)', 5)} as spread, {r('arg_max(close, ts) * avg(volume)', 5)} as adv_dollar, {r('coalesce(stddev_samp(ret), 0)', 5)} as daily_vol from z where k <= 20 and n >= 2 group by symbol""",
    "c_gap": f"""with {HOUR}, hs as (select *, list(close) over ({W} rows unbounded preceding) as h from bars), em as (select *, list_reduce(h, lambda e, v: e * (1 - 2.0::double / 6) + v * 2.0::double / 6) as fast, list_reduce(h, lambda e, v: e * (1 - 2.0::double / 21) + v * 2.0::double / 21) as slow from hs)
select epoch(ts)::bigint as ts, symbol, {r('(fast - slow) / nullif(slow, 0)')} as gap from em""",
    "c_points": f"""with {WEEK}, ca as (select ts, row_number() over (order by ts) - 1 as k, count(*) over () as n from (select distinct ts from bars)), la as (select max(n) - 5 as l from ca),
po as (select 30 + floor(i * (l - 30)::double / greatest(least(24, l - 30) - 1, 1))::bigint as k from la, range(24) t(i) where l > 30 and i < least(24, l - 30))
select k, epoch(ts)::bigint as ts from ca where k in (select k from po)""",
    "e_breadth": f"""with {WEEK}, {RETS}, {BENCH}, bo as (select symbol, ts, ret, bench from rets join bench using (ts) where ret is not null and bench is not null),
fi as (select symbol, covar_samp(ret, bench) / nullif(var_samp(bench), 0) as beta from bo group by symbol having count(*) >= 20), le as (select ts, symbol, ret - beta * bench as x from bo join fi using (symbol) where beta is not null),
ea as (select a.symbol as i, b.symbol as j, case when not ({flat('a.x')}) and not ({flat('b.x')}) then corr(a.x, b.x) end as c from le a join le b on a.ts = b.ts and a.symbol < b.symbol group by 1, 2 having count(*) >= 20),
nm as (select count(distinct symbol) as names from rets), us as (select count(c) as pairs, avg(c) as m from ea), rr as (select names, pairs, case when pairs > 0 and pairs >= 0.5 * names * (names - 1) / 2 then m end as rho from nm, us)
select names, pairs, {r('rho')} as rho, {r('12.0 * names / case when 1 + (names - 1) * coalesce(rho, 0) > 0 then 1 + (names - 1) * coalesce(rho, 0) else 1 end')} as breadth from rr""",
    "x_case": f"""with {WEEK}, {RETS}, vo as (select *, case when count(ret) over w10 = 10 then stddev_samp(ret) over w10 end as vol, quantile_cont(ret, 0.025) over (partition by ts) as q1, quantile_cont(ret, 0.975) over (partition by ts) as q2 from rets window w10 as ({W} rows between 9 preceding and current row)),
gg as (select ts, least(greatest(ret, q1), q2) as g, case when vol > 0 then vol end as vol from vo where ret is not null)
select epoch(ts)::bigint as ts, {r('case when count(g) >= 2 and stddev_pop(g / vol) > 0 then stddev_pop(g) / stddev_pop(g / vol) end')} as scale from gg group by ts""",
    "x_exposures": f"""with {WEEK}, {RETS}, {BENCH}, z as (select *, row_number() over (partition by symbol order by ts desc) as k from rets),
be as (select symbol, case when count(*) >= 3 and var_samp(bench) > 1e-24 then covar_samp(ret, bench) / var_samp(bench) else 1 end as market from rets join bench using (ts) where ret is not null and bench is not null group by symbol),
ra as (select symbol, max(close) filter (where k = 5) / nullif(max(close) filter (where k = 31), 0) - 1 as momentum, stddev_samp(ret) filter (where k <= 12) as volatility, ln(max(close) filter (where k = 1) * avg(volume) filter (where k <= 12)) as size from z where k <= 31 group by symbol having count(*) >= 31),
fu as (select * from ra join be using (symbol) where momentum is not null and volatility is not null and size is not null), mo as (select count(*) as n, {', '.join(f'avg({c}) as m_{c}, stddev_pop({c}) as s_{c}' for c in ('market', 'momentum', 'volatility', 'size'))} from fu)
select symbol, {', '.join(f"{r(f'({c} - m_{c}) / case when s_{c} > 0 then s_{c} else 1 end', 5)} as {c}" for c in ('market', 'momentum', 'volatility', 'size'))} from fu, mo where n >= 2""",
    "g_exits": f"""with {WEEK}, {BOOK}, fl as (select ts, symbol, side, case when (close - take_profit) * sg >= 0 then 'TAKE_PROFIT' when (close - stop_loss) * sg <= 0 then 'STOP_LOSS' else '' end as exit_reason from bars join book using (symbol))
select epoch(ts)::bigint as ts, symbol, exit_reason, case when exit_reason = '' then 'HOLD' else 'CLOSE_' || side end as signal from fl""",
    "g_valid": f"""with {WEEK}, {BOOK}, si as (select ts, symbol, (['BUY', 'SELL', 'CLOSE_BUY', 'CLOSE_SELL'])[month(ts) % 4 + 1] as signal from bars)
select epoch(ts)::bigint as ts, symbol, signal, case when signal like 'CLOSE_%' then coalesce('CLOSE_' || side = signal, false) else coalesce(side <> signal, true) end as valid from si left join book using (symbol)""",
    "e_fill_gaps": f"""with o as (select year(l_shipdate) as year, l_extendedprice::double as p, l_discount::double as d, case when l_returnflag = 'R' then 'rounded' when l_quantity < 3 then 'too_small' else 'filled' end as outcome from lineitem)
select year, count(*) as n, {r("coalesce((1 - sum(case when outcome = 'filled' then p * (1 - d) else 0 end) / nullif(sum(p), 0)) * 100, 0)")} as drag_pct, {r("count(*) filter (where outcome <> 'filled')::double / count(*) * 100")} as unfillable_pct from o group by year""",
    "t_panel": f"""with {WEEK}, {RETS}, se as (select symbol as trial_id, ts, ret from rets where ret is not null), lo as (select trial_id from se group by 1 order by count(*) desc, trial_id limit 1),
us as (select trial_id from se where ts in (select ts from se where trial_id = (select trial_id from lo)) group by 1 having count(*) >= 60), ro as (select * from se where trial_id in (select trial_id from us)),
co as (select ts from ro group by ts having count(*) = (select count(*) from us)) select epoch(ts)::bigint as ts, trial_id, {r('ret')} as ret from ro where ts in (select ts from co) and (select count(*) from co) >= 60""",
    "p_overfit": f"""with {WEEK}, {RETS}, sc as (select year(ts) as fold, coalesce(avg(ret) filter (where month(ts) <= 6), 0) as a, coalesce(avg(ret) filter (where month(ts) > 6), 0) as o from rets group by 1),
nu as (select *, row_number() over (order by fold) - 1 as bit, count(*) over () as n from sc), ma as (select m from range((select 1 << max(n) from nu)) t(m) where bit_count(m) = (select max(n) // 2 from nu)),
ea as (select m, arg_max(o, a) filter (where (m >> bit) & 1 = 1) as chosen, median(o) filter (where (m >> bit) & 1 = 0) as middle from ma, nu group by m)
select {r('avg((chosen < middle)::int)')} as pbo, count(*) as splits from ea""",
    "r_neutral": f"with {WEEK}, {RETS}, {EXPOSED} select epoch(ts)::bigint as ts, symbol, {r('case when n = 1 then ret when n <= 3 then 0 else ret - b0 - b1 * size - b2 * momentum end')} as residual from ex join fit using (ts)",
    "r_factor_cov": f"with {WEEK}, {RETS}, {EXPOSED} select a.factor as i, b.factor as j, {r('covar_samp(a.ret, b.ret)')} as cov from fr a join fr b using (ts) group by 1, 2",
    "r_specific": f"with {WEEK}, {RETS}, {EXPOSED} select symbol, {r('var_samp(ret - b0 - b1 * size - b2 * momentum)')} as variance from ex join fit using (ts) where n > 3 group by symbol",
    "r_attribution": f"""with {WEEK}, {RETS}, {EXPOSED}, {PARTS}, g as (select component, sum(x) as total, avg(x) / nullif(stddev_samp(x), 0) as s, count(x) as n, var_samp(x) as v from comp group by component)
select component, {r('total')} as total, {r('s * sqrt(52)')} as ir, {r('s * sqrt(n)')} as t_stat, {r('v / sum(v) over ()')} as variance_share from g""",
    "e_contributions": f"""with {WEEK}, {RETS}, {CC}, w as (select distinct symbol, ("right"(symbol, 1)::double + 1) / 100 as weight from panel), h as (select i, j, cov from cov union all select j, i, cov from cov where i < j),
p as (select i, sum(cov * weight) as pull from h join w on w.symbol = j group by i), t as (select symbol, weight, pull, sum(weight * pull) over () as total from w join p on i = symbol)
select symbol, {r('weight')} as weight, {r('pull / sqrt(total)')} as marginal, {r('weight * pull / total')} as share from t""",
    "e_information": f"with {WEEK}, {RETS}, {SCORED} select epoch(ts)::bigint as ts, n, {r('ic')} as ic, {r('rank_ic')} as rank_ic from info",
    "e_ic_summary": f"with {WEEK}, {RETS}, {SCORED} select {r('avg(ic)')} as mean_ic, {r('stddev_samp(ic)')} as ic_vol, {r('avg(ic) * sqrt(count(ic)) / stddev_samp(ic)')} as t_stat, count(ic) as periods, {r('avg(rank_ic)')} as mean_rank_ic from info",
    "e_trades": f"""with {TRADES}, g as (select symbol, count(*) as n, count(*) filter (where pnl > 0) / count(*) as rate, sum(greatest(pnl, 0)) as won, -sum(least(pnl, 0)) as lost, avg(pnl) as e, stddev_samp(pnl) as s, avg(pnl) filter (where pnl > 0) as aw, -avg(pnl) filter (where pnl < 0) as al from trades group by symbol)
select symbol, n as n_trades, {r('rate', 4)} as win_rate, {r('won / lost', 4)} as profit_factor, {r('e', 4)} as expectancy, {r('aw / al', 4)} as payoff, {r('rate - (1 - rate) / (aw / al)', 4)} as kelly, {r('sqrt(n) * e / s', 4)} as sqn from g""",
    "e_exit_reason": f"with {TRADES} select exit_reason, count(*) as n, {r('sum(pnl)', 3)} as pnl, {r('count(*) filter (where pnl > 0) / count(*)', 3)} as win_rate, {r('avg(days)', 3)} as avg_days, {r('median(days)', 3)} as median_days, {r('count(*) / sum(count(*)) over ()', 3)} as share from trades group by exit_reason",
    "e_legs": f"with {TRADES} select side, count(*) as n, {r('sum(pnl)', 2)} as pnl, {r('sum(cost)', 2)} as cost, {r('avg(pnl)', 2)} as avg_pnl, {r('stddev_samp(pnl)', 2)} as pnl_std from trades group by side",
    "g_trades": f"with {HOUR}, {RETS}, {HELD}, {EXTRACTED} select symbol, epoch(entry_time)::bigint as entry_time, {r('entry_price')} as entry_price, epoch(exit_time)::bigint as exit_time, {r('exit_price')} as exit_price, exit_reason, {r('exit_price / nullif(entry_price, 0) - 1')} as pnl_pct from tr",
    "g_barriers": f"""with {HOUR}, {RETS}, {HELD}, {EXTRACTED}, ins as (select t.symbol, t.entry_time, b.ts, b.open, b.high, b.low, t.entry_price * (1 - 0.3) as s, t.entry_price * (1 + 0.5) as k from tr t join bars b on t.symbol = b.symbol and b.ts >= t.entry_time and b.ts < t.exit_time),
hit as (select *, case when low <= s then 'STOP_LOSS' when high >= k then 'TAKE_PROFIT' end as reason from ins)
select symbol, epoch(entry_time)::bigint as entry_time, epoch(min(ts))::bigint as hit_time, arg_min(reason, ts) as reason, {r("arg_min(case when reason = 'STOP_LOSS' then least(s, open) else greatest(k, open) end, ts)")} as price from hit where reason is not null group by symbol, entry_time""",
    "g_excursions": f"with {HOUR}, {RETS}, {HELD}, {EXTRACTED} select t.symbol, epoch(entry_time)::bigint as entry_time, {r('greatest(100 * (1 - min(b.low) / nullif(first(entry_price), 0)), 0)', 4)} as mae_pct, {r('greatest(100 * (max(b.high) / nullif(first(entry_price), 0) - 1), 0)', 4)} as mfe_pct from tr t join bars b on t.symbol = b.symbol and b.ts >= t.entry_time and b.ts <= t.exit_time group by t.symbol, entry_time",
    "l_positions": f"with {LEDGER}, {POSITIONS} select symbol, {r('position')} as position from positions",
    "l_reconcile": f"""with {LEDGER}, {POSITIONS}, act as (select symbol, position + case when symbol::int % 7 = 0 then 1 else 0 end as actual from positions where symbol::int % 5 <> 0),
b as (select p.symbol, position as expected, coalesce(actual, 0) as actual from positions p left join act using (symbol))
select symbol, {r('expected')} as expected, {r('actual')} as actual, case when abs(actual) <= 1e-6 then 'missing' when abs(expected) <= 1e-6 then 'unexpected' else 'quantity_drift' end as status from b where abs(expected - actual) > 1e-6""",
    "l_outcomes": f"with {LEDGER}, n as (select *, lead(event) over (partition by symbol order by seq) as next_event from ledger) select next_event, count(*) as n from n where event = 'intent' group by next_event",
    "t_families": f"with {TRIALS} select * from families",
    "t_leaderboard": f"with {TRIALS}, k as (select *, row_number() over (partition by strategy order by oos_sharpe desc nulls last, id)::int as rank from trials where contaminated_at is null) select id, strategy, {r('oos_sharpe')} as oos_sharpe, rank, n_tried from k left join families using (strategy, universe_hash, accounting) where rank <= 10",
    "t_duplicates": f"with {TRIALS}, k as (select id, first(id) over w as first_id, row_number() over w as nth from trials window w as (partition by strategy, universe_hash, kind order by ts, id)) select id, first_id, nth::int as nth from k where nth > 1",
    "t_compare": f"with {HOUR}, {RETS} select a.symbol as a, b.symbol as b, count(*) as overlap, case when count(*) < 60 then 'overlap' end as refused, {r('case when count(*) >= 60 then corr(a.ret, b.ret) end')} as corr from rets a join rets b on a.ts = b.ts and a.symbol < b.symbol where a.ret is not null and b.ret is not null group by 1, 2",
    "s_drift": f"with {DAY}, x as (select symbol from bars where ts = timestamp '2024-01-05'), y as (select symbol from bars where ts = timestamp '2024-01-20'), j as (select x.symbol as x, y.symbol as y from x full join y on x.symbol = y.symbol) select count(*) filter (where x is null) as added, count(*) filter (where y is null) as dropped, count(*) filter (where x is not null and y is not null) as kept, count(*) as n, {r('100.0 * (count(*) filter (where x is null or y is null)) / count(*)')} as turnover_pct from j",
    "p_sweep": f"""with {WEEK}, {RETS}, m as (select *, {', '.join(f'case when count(close) over w{n} = {n} then avg(close) over w{n} end as m{n}' for n in (4, 8, 12, 26))} from rets window {', '.join(f'w{n} as ({W} rows between {n - 1} preceding and current row)' for n in (4, 8, 12, 26))}),
c as ({' union all '.join(f'select {f} as fast, {s} as slow, ts, ret, lag((m{f} > m{s})::int) over ({W}) as held from m' for f in (4, 8) for s in (12, 26))}),
k as (select fast, slow, ts, avg(ret * held) as x from c where ret is not null and held is not null group by fast, slow, ts), z as (select fast, slow, count(*) as n, sum(x) as total, {sharpe('x', 52)} as sharpe from k group by fast, slow)
select fast, slow, n, {r('total')} as total, {r('sharpe')} as sharpe, row_number() over (order by sharpe desc, fast, slow)::int as rank from z""",
    "p_folds": f"""with {WEEK}, {RETS}, plan as (select k as fold, unnest([{{'segment': 'is', 's': a, 'e': a + interval 364 day}}, {{'segment': 'oos', 's': a + interval 371 day, 'e': a + interval 553 day}}]) as p from (select k::int as k, timestamp '1993-01-04' + to_days((182 * k)::int) as a from range(0, 20) t(k)) where a + interval 553 day <= timestamp '1998-01-05')
select fold, p.segment as segment, count(*) as n, {r('avg(ret)')} as mean, {r('stddev_samp(ret)')} as std from rets join plan on ts >= p.s and ts < p.e where ret is not null group by fold, p.segment""",
    "e_bar_summary": f"""with {WEEK}, {RETS}, m as (select *, case when count(close) over a = 10 then avg(close) over a end as m10, case when count(close) over b = 30 then avg(close) over b end as m30, close / nullif(max(close) over (partition by symbol order by ts rows unbounded preceding), 0) - 1 as dd, avg(volume) over v as v5
  from rets window a as ({W} rows between 9 preceding and current row), b as ({W} rows between 29 preceding and current row), v as ({W} rows between 4 preceding and current row))
select symbol, count(*) as n, {r('arg_max(close, ts)')} as last_close, {r('arg_max(close, ts) / arg_min(close, ts) - 1')} as period_return, {r('stddev_samp(ret)')} as volatility, arg_max(case when m10 > m30 then 'up' when m10 < m30 then 'down' else 'flat' end, ts) as trend, {r('min(dd)')} as max_drawdown,
  {r('avg(volume)')} as avg_volume, {r('arg_max(v5, ts) / avg(volume)')} as recent_volume, {r('max(high)')} as high, {r('min(low)')} as low from m group by symbol""",
    "g_scan": f"with {HOUR}, {SCAN}, l as (select * from sig where ts <= timestamp '2024-01-20 10:00:00' qualify row_number() over (partition by symbol order by ts desc) = 1) select symbol, epoch(ts)::bigint as ts, {r('ratio')} as ratio, signal, {r('strength')} as strength from l",
    "g_forward": f"with {HOUR}, {SCAN}, f as (select *, case when lead(close) over w is not null then case when signal = 'SELL' then -1 else 1 end * (coalesce(lead(close, 5) over w, last_value(close) over (partition by symbol order by ts rows between current row and 5 following)) / nullif(close, 0) - 1) end as move from sig window w as ({W})) select signal, count(*) as n, {r('avg((move > 0)::int)')} as hit_rate, {r('avg(100 * move)')} as avg_pct from f where signal <> 'HOLD' and move is not null group by signal",
    "e_ic_by_lag": f"with {WEEK}, {RETS}, {LAGS} select lag, n, {r('mean_ic')} as mean_ic from prof",
    "e_decay": f"with {WEEK}, {RETS}, {LAGS}, q as (select lag, abs(mean_ic) as m from prof where mean_ic <> 0) select count(*) as lags, {r('regr_slope(ln(m), lag)')} as rate, {r('case when regr_slope(ln(m), lag) < 0 then ln(2) / -regr_slope(ln(m), lag) end')} as half_life, {r('exp(regr_intercept(ln(m), lag))')} as level from q",
    "e_forecast": f"with {WEEK}, {RETS}, q as (select symbol, ret * ret as y, avg(ret * ret) over ({W} rows between 8 preceding and 1 preceding) as x from rets) select symbol, count(*) as n, {r('regr_intercept(y, x)')} as a, {r('regr_slope(y, x)')} as b, {r('regr_r2(y, x)')} as r2, {r('avg(y / x - ln(y / x) - 1)')} as qlike from q where y > 0 and x > 0 group by symbol",
    "e_regimes": f"with {WEEK}, {RETS}, book as (select ts, avg(ret) as ret from rets group by ts having avg(ret) is not null), v as (select ret, stddev_samp(ret) over (order by ts rows between 7 preceding and current row) as vol from book), c as (select quantile_cont(vol, 1/3.0::double) as a, quantile_cont(vol, 2/3.0::double) as b from v) select case when vol > b then 'high' when vol > a then 'mid' else 'low' end as regime, count(*) as n, {r('avg(ret)')} as mean, {r('stddev_samp(ret)')} as std from v, c where vol is not null group by 1",
    "x_buckets": f"with {DAY}, {RETS}, v as (select symbol, stddev_samp(ret) as vol from rets group by symbol having stddev_samp(ret) is not null), k as (select *, ntile(5) over (order by vol, symbol)::int as bucket from v) select bucket, count(*) as n, {r('avg(vol)', 4)} as mean_vol, {r('sum(vol * vol) / sum(sum(vol * vol)) over ()', 4)} as share from k group by bucket",
    "e_exposure": f"with {DAY}, x as (select abs((close - open) / nullif(high, 0)) as x from bars), c as (select unnest([0.25, 0.5, 0.9, 1.0, 2.0])::double as cap), k as (select cap, count(*) as n, avg((x > cap)::int) as binding from x, c where x is not null group by cap) select cap, n, {r('binding')} as binding, cap = min(cap) filter (where binding = 0) over () as recommended from k",
    "e_excursion": f"with {WEEK}, d as (select symbol, ts, close, max(close) over (partition by symbol order by ts rows unbounded preceding) as peak, low from bars), e as (select *, low / peak - 1 as d from d) select symbol, {r('min(d)')} as worst, epoch(first(ts order by d, ts))::bigint as worst_ts, {r('arg_max(close / peak - 1, ts)')} as closing from e group by symbol",
    "e_capacity": f"with {WEEK}, {RETS}, h as (select symbol, 0.04::double as weight, avg(close * volume) as adv, stddev_samp(ret) as vol from rets group by symbol), c as (select unnest([1e3, 1e4, 1e5, 1e6])::double as capital) select {r('capital')} as capital, {r('0.05 - sum(0.1 * vol * sqrt(weight * capital / adv) * weight)')} as net_alpha, 0.05 - sum(0.1 * vol * sqrt(weight * capital / adv) * weight) > 0 as open from h, c where adv > 0 group by capital",
    "e_active": f"with {DAY}, a as (select symbol, volume / sum(volume) over () as w from bars where ts = timestamp '2024-01-05'), b as (select symbol, volume / sum(volume) over () as w from bars where ts = timestamp '2024-01-20') select coalesce(a.symbol, b.symbol) as symbol, {r('coalesce(a.w, 0) - coalesce(b.w, 0)')} as active from a full join b on a.symbol = b.symbol",
    "j_asof": f"with l as (select user_id as key, ts from events where event_type = 'purchase'), q as (select user_id as key, ts, value from events where event_type = 'view'), j as (select l.key, l.ts, q.value from l asof left join q on l.key = q.key and l.ts >= q.ts) select key, count(*) as n, count(value) as matched, {r('sum(value)', 4)} as value from j group by key",
    "r_conditioned": f"with {WEEK}, {RETS}, {CC}, v as (select symbol, 2 * avg(ret * ret) as v from panel group by symbol), k as (select i as symbol, sqrt(v / cov) as k from cov join v on i = symbol where i = j) select i, j, {r('cov * a.k * b.k', 8)} as cov from cov join k a on a.symbol = i join k b on b.symbol = j",
    "r_har": f"with {WEEK}, {RETS} select epoch(ts)::bigint as ts, symbol, {r('ret * ret')} as d, {r('case when count(ret) over w5 = 5 then avg(ret * ret) over w5 end')} as w, {r('case when count(ret) over w22 = 22 then avg(ret * ret) over w22 end')} as m, {r(f'lead(ret * ret) over ({W})')} as next from rets window w5 as ({W} rows between 4 preceding and current row), w22 as ({W} rows between 21 preceding and current row)",
    "a_journal": "with l as (select c_custkey as seq, (c_custkey // 10)::varchar as session_id, c_custkey % 10 = 1 as start, c_mktsegment, c_custkey % 10 as n from customer where c_custkey % 13 <> 0), s as (select session_id, first(c_mktsegment order by seq) as strategy from l where start group by session_id) select seq, l.session_id, strategy, greatest(coalesce(n - lag(n) over (partition by l.session_id order by seq), n, 1), 1) as n from l left join s on l.session_id = s.session_id where not start",
    "a_holdings": f"with g as (select 'S' || s_nationkey as symbol, sum(abs(s_acctbal::double)) as w from supplier group by 1) select symbol, {r('w / sum(w) over ()')} as weight from g",
    "w_faults": f"with {DAY} select case when day(ts) = 3 then 'inverted_range' when day(ts) = 4 then 'negative_volume' else 'none' end as fault, count(*) as n from bars where open > 0 and high > 0 and low > 0 and close > 0 group by 1 union all select 'non_positive', count(*) from bars where not (open > 0 and high > 0 and low > 0 and close > 0) having count(*) > 0",
}

QUERIES = {
    f.__name__: f
    for f in (
        a_scan, a_upsert, a_intervals, a_gaps, a_missing, a_vintage, a_status, a_sql, c_indicators, c_latest, c_streaks, c_hysteresis, c_ewma, c_liquidity, c_gap, c_points, x_case, x_exposures, e_breadth, g_exits, g_valid, e_fill_gaps, t_panel,
        x_scores, x_refine, x_combine, x_top, e_returns, e_drawdown, e_metric_row, e_benchmark, e_beta, e_covariance, e_shrunk, e_contributions, e_information, e_ic_summary,
        e_trades, e_exit_reason, e_legs, g_trades, g_barriers, g_excursions, l_positions, l_reconcile, l_outcomes, t_families, t_leaderboard, t_duplicates,
        t_compare, e_bar_summary, g_scan, g_forward, e_ic_by_lag, e_decay, e_forecast, e_regimes, x_buckets, e_exposure, e_excursion, e_capacity, e_active, j_asof, p_distribution, s_drift, r_neutral, r_factor_cov, r_specific, r_attribution, r_conditioned, r_har, a_journal, a_holdings, p_null, p_sweep, p_folds, p_overfit, p_bootstrap, w_barcheck, w_faults,
    )
}
