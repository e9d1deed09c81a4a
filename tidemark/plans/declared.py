"""Registered queries of declared signals and scanners, feature producers and the journal of trials, each with its DuckDB SQL."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from .. import contracts
from ..sources import bars, journal
from . import desk
from . import queries as market
from .queries import BENCH, HOUR, RETS, SCAN, WEEK, r, returns_of, tidy


def u_sweep(spark: SparkSession, sf: str) -> DataFrame:
    """The declared crossover over four points: the sweep of its own operator, from a declaration."""
    return tidy(contracts.CROSSOVER.swept(bars.weekly(spark, sf), contracts.CROSSOVER.points(fast=[4, 8], slow=[12, 26]), 52.0))


def u_signal(spark: SparkSession, sf: str) -> DataFrame:
    return tidy(contracts.CROSSOVER.compiled(bars.weekly(spark, sf), {"fast": 6, "slow": 20}).select("ts", "symbol", "score", "held"))


def u_volume(spark: SparkSession, sf: str) -> DataFrame:
    return tidy(contracts.VOLUME.compiled(bars.hourly(spark, sf)).select("ts", "symbol", "signal", "strength"))


def u_liquidity(spark: SparkSession, sf: str) -> DataFrame:
    return tidy(contracts.LIQUIDITY.compiled(bars.weekly(spark, sf), {"least": 5e4}).select("ts", "symbol", "signal", "strength"))


def u_features(spark: SparkSession, sf: str) -> DataFrame:
    b = bars.weekly(spark, sf)
    bench = returns_of(b).groupBy("ts").agg(F.avg("ret").alias("bench"))
    return tidy(contracts.risk_features(b, bench, 52.0).unionByName(contracts.risk_features(b, None, 52.0)))


def journal_lines(spark: SparkSession, sf: str) -> DataFrame:
    """A journal made of orders: session starts, rounds, trials, withdrawals, other tools and broken lines."""
    k = F.col("o_orderkey")
    session = F.concat(F.lit("s"), (F.col("o_custkey") % 40).cast("string"))
    run = F.concat(F.lit("r"), k.cast("string"))
    start = F.to_json(F.struct(F.lit(journal.START).alias("tool"), F.struct(session.alias("session_id"), F.col("o_orderpriority").alias("strategy"), F.array(F.lit("A"), F.col("o_orderstatus")).alias("symbols"), F.struct(F.to_date("o_orderdate").cast("string").alias("start")).alias("research_window"), (k % 7).alias("seed")).alias("inputs")))
    params = F.struct((k % 5).alias("slow"), (k % 3 == 0).alias("on"), F.struct(F.lit("x=1;").alias("é")).alias("more"))
    research = F.to_json(F.struct(F.lit(journal.ROUND).alias("tool"), run.alias("run_id"), F.struct(session.alias("session_id"), F.when(k % 4 != 0, k).alias("n_trials_cumulative"), params.alias("params"), F.when(k % 8 == 1, F.lit("own")).alias("strategy"), F.struct((F.col("o_totalprice") / 1000).alias("sharpe_ratio")).alias("oos_aggregate")).alias("inputs")))
    trial = F.to_json(F.struct(F.lit("trial:backtest").alias("tool"), run.alias("run_id"), F.struct(F.col("o_orderpriority").alias("strategy")).alias("inputs"), F.struct((F.col("o_totalprice") / 500).alias("sharpe_ratio"), (k % 90).alias("total_trades")).alias("result_summary"), (k % 6).alias("n_trials")))
    spoilt = F.to_json(F.struct(F.lit(journal.SPOILT).alias("tool"), F.struct(F.array(F.concat(F.lit("r"), (k - 3).cast("string")), F.lit("none")).alias("trial_ids"), F.col("o_orderpriority").alias("reason")).alias("inputs")))
    value = F.when(k % 20 == 0, start).when(k % 10 < 6, research).when(k % 10 == 6, trial).when(k % 10 == 8, spoilt).when(k % 10 == 9, '{"tool": "other"}').otherwise("{broken")
    return spark.read.parquet(f"{sf}/orders.parquet").select(k.alias("seq"), value.alias("value"))


def a_trials(spark: SparkSession, sf: str) -> DataFrame:
    rows = journal.trials(journal_lines(spark, sf))
    return tidy(rows.select("seq", "id", "kind", "strategy", F.concat_ws(",", "symbols").alias("symbols"), "params", "params_hash", "session_id", "window_start", "oos_sharpe", "oos_trades", "n_trials", "seed", "orphan", "spoilt"))


def a_journal_counts(spark: SparkSession, sf: str) -> DataFrame:
    return journal.lines(journal_lines(spark, sf))[1]


QUERIES = {f.__name__: f for f in (u_sweep, u_signal, u_volume, u_liquidity, u_features, a_trials, a_journal_counts)}

W = "partition by symbol order by ts"
SQL = {
    "u_sweep": "select fast, slow, n, total, sharpe from (" + market.SQL["p_sweep"] + ")",
    "u_signal": f"""with {WEEK}, m as (select *, case when count(*) over a = 6 then avg(close) over a end as q, case when count(*) over b = 20 then avg(close) over b end as c from bars window a as ({W} rows between 5 preceding and current row), b as ({W} rows between 19 preceding and current row)),
s as (select *, (q - c) / nullif(c, 0) as score from m)
select epoch(ts)::bigint as ts, symbol, {r('score')} as score, coalesce(last_value(case when score > 0 then 1 when score <= 0 then 0 end ignore nulls) over ({W} rows unbounded preceding), 0) as held from s""",
    "u_volume": f"with {HOUR}, {SCAN} select epoch(ts)::bigint as ts, symbol, signal, {r('strength')} as strength from sig",
    "u_liquidity": f"with {WEEK}, {desk.LIQUID} select epoch(ts)::bigint as ts, symbol, case when good then 'BUY' else 'HOLD' end as signal, {r('case when good then adv / 5e4 else 0 end')} as strength from liquid",
    "u_features": f"""with {WEEK}, {RETS}, {BENCH}, f as (select symbol, covar_samp(ret, bench) / var_samp(bench) as beta, covar_samp(ret, bench) as c, var_samp(bench) as vb, var_samp(ret) as vr from rets join bench using (ts) where ret is not null group by symbol)
select symbol, {r('beta')} as beta, {r('case when vr - 2 * beta * c + beta * beta * vb > 0 then sqrt(52 * (vr - 2 * beta * c + beta * beta * vb)) else 0.2 end')} as residual_vol, true as benchmark_available from f
union all select symbol, 1.0::double, {r('case when stddev_samp(ret) > 0 then stddev_samp(ret) * sqrt(52) else 0.2 end')}, false from rets group by symbol""",
    "a_trials": f"""with o as (select o_orderkey as k, o_custkey % 40 as s, *, case when o_orderkey % 20 = 0 then 'start' when o_orderkey % 10 < 6 then 'round' when o_orderkey % 10 = 6 then 'trial' when o_orderkey % 10 = 8 then 'spoilt' end as t from orders),
c as (select *, max(case when t = 'start' then k end) over (partition by s order by k rows unbounded preceding) as began from o where t in ('start', 'round')),
n as (select *, case when t = 'round' and k % 4 <> 0 then k end as cum from c),
p as (select *, case when cum is not null then greatest(cum - coalesce(last_value(cum ignore nulls) over (partition by s, began order by k rows between unbounded preceding and 1 preceding), 0), 1) end as own from n),
j as (select p.*, x.o_orderpriority as xp, x.o_orderstatus as xs, x.o_orderdate as xd from p left join orders x on x.o_orderkey = p.began where t = 'round'),
w as (select 'r' || (k - 3) as id, k as wk, o_orderpriority as reason from o where t = 'spoilt'),
a as (select k as seq, 'r' || k as id, 'research' as kind, case when k % 8 = 1 then 'own' else xp end as strategy, case when began is null then '' else 'A,' || xs end as symbols,
    '{{"more":{{"\\u00e9":"x=1;"}},"on":' || (k % 3 = 0) || ',"slow":' || (k % 5) || '.0}}' as params, 's' || s as session_id, xd::date::varchar as window_start, o_totalprice::double / 1000 as sharpe, null::bigint as trades, own as n_trials, began % 7 as seed, began is null as orphan from j
  union all select k, 'r' || k, 'backtest', o_orderpriority, '', '{{}}', null, null, o_totalprice::double / 500, k % 90, k % 6, null, false from o where t = 'trial')
select seq, id, kind, strategy, symbols, params, sha256(params) as params_hash, session_id, window_start, {r('sharpe')} as oos_sharpe, trades as oos_trades, n_trials, seed, orphan, reason as spoilt from a left join w using (id)""",
    "a_journal_counts": "select count(*) filter (where not (o_orderkey % 10 = 7)) as good, count(*) filter (where o_orderkey % 10 = 7) as malformed from orders",
}
