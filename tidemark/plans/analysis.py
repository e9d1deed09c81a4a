"""Registered queries of trade analytics, screens, bootstrap skill and sizing rules, each with its DuckDB SQL; and the SQL of older queries that had none."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from ..functions import scalars as S
from ..operators import analytics, sweep
from ..sources import bars, coverage
from . import queries as market
from .books import FED, TRADED, dated_trades
from .queries import r, returns_of, tidy


def closed(spark: SparkSession, sf: str) -> DataFrame:
    """Order lines as trades, with an exit reason by the day of the week; those of one line number have no measured profit, some no entry."""
    rows = dated_trades(spark, sf)
    reason = F.element_at(F.array(*[F.lit(x) for x in ("STOP_LOSS", "TAKE_PROFIT", "SIGNAL", "", None)]), (F.col("l_orderkey") % 5 + 1).cast("int"))
    return rows.withColumns({"exit_reason": reason, "pnl": F.when(F.col("l_linenumber") == 6, float("nan")).otherwise(F.col("pnl")), "entry_time": F.when(F.col("l_linenumber") != 5, F.col("entry_time"))})


def e_win_loss(spark: SparkSession, sf: str) -> DataFrame:
    return tidy(analytics.win_loss(closed(spark, sf), ["symbol"]), 3)


def e_exit_paths(spark: SparkSession, sf: str) -> DataFrame:
    found = analytics.exit_paths(closed(spark, sf), ["symbol"])
    return tidy(found.select("symbol", "exit_reason", "place", "rows", "trades", "net_pnl", "win_rate", "share_of_rows", "share_of_gain", "top_gain"), 3)


def e_durations(spark: SparkSession, sf: str) -> DataFrame:
    return tidy(analytics.durations(closed(spark, sf), ["symbol"]), 4)


def swept(spark: SparkSession, sf: str) -> DataFrame:
    return sweep.crossover_sweep(bars.weekly(spark, sf), [4, 8], [12, 26], 52.0)


def p_screen(spark: SparkSession, sf: str) -> DataFrame:
    report = analytics.screen_report(swept(spark, sf), ["fast", "slow"], "sharpe")
    return tidy(report["distribution"].join(F.broadcast(report["best"].select("fast", "slow"))), 4)


def p_baseline(spark: SparkSession, sf: str) -> DataFrame:
    """Rows only: SQL has no normal quantile; the formula is tested."""
    return tidy(analytics.noise_baseline(swept(spark, sf), "sharpe"), 4)


def p_gradients(spark: SparkSession, sf: str) -> DataFrame:
    return tidy(analytics.gradients(swept(spark, sf), ["fast", "slow"], "sharpe"), 4)


def p_skill(spark: SparkSession, sf: str) -> DataFrame:
    """Rows only: resamples are hash-drawn; invariants are tested."""
    book = returns_of(bars.weekly(spark, sf)).groupBy("ts").agg(F.avg("ret").alias("ret")).where("ret is not null")
    return tidy(analytics.skill_report(book.select((F.row_number().over(Window.orderBy("ts")) - 1).alias("i"), "ret"), samples=100, ppy=52.0))


def b_sizing(spark: SparkSession, sf: str) -> DataFrame:
    l = spark.read.parquet(f"{sf}/lineitem.parquet")  # noqa: E741
    q, price, tax, discount = (F.col(c).cast("double") for c in ("l_quantity", "l_extendedprice", "l_tax", "l_discount"))
    unit = price / q
    return tidy(l.select(
        "l_orderkey", "l_linenumber", S.round_tick(unit / 997).alias("tick"), S.whole_shares(q / 3).cast("long").alias("shares"), S.under_minimum(q, unit, 20000.0).alias("small"),
        S.risk_size(F.lit(1e6), unit, tax, 0.01, 0.02, 5e4).alias("risk_size"), S.beta_scaled(q, discount * 50).alias("scaled"), S.weight_size(discount, F.lit(1e6), unit).alias("weighted"),
        S.trade_cost(-price, q * 1000, tax).alias("cost"), S.trade_cost(price, q * 100, tax, linear=True, cap=0.5).alias("capped_cost"), S.annual_cost(tax, q).alias("yearly"), S.borrow_carry(F.when(F.col("l_linenumber") % 2 == 0, -price).otherwise(price), 0.03, q, 252.0).alias("carry"),
        S.slippage_bps(F.when(F.col("l_linenumber") % 2 == 0, "Buy").otherwise("sell"), unit, unit * (1 + tax)).alias("slippage"), S.elapsed_ms(F.col("l_shipdate").cast("string"), F.when(F.col("l_linenumber") == 2, "soon").otherwise((F.col("l_shipdate").cast("timestamp") + F.expr("make_dt_interval(0, l_linenumber, 0, 1.5)")).cast("string"))).alias("elapsed"),
        S.to_float(F.when(F.col("l_linenumber") == 3, "n/a").otherwise(F.col("l_quantity").cast("string"))).alias("stated"),
    ), 7)


def b_costs(spark: SparkSession, sf: str) -> DataFrame:
    """Every order line as a trade: its costs by part under both impact laws, their rates, carry and coefficients; some lines have no volume, spread or size."""
    l = spark.read.parquet(f"{sf}/lineitem.parquet")  # noqa: E741
    q, price, tax, discount = (F.col(c).cast("double") for c in ("l_quantity", "l_extendedprice", "l_tax", "l_discount"))
    line = F.col("l_linenumber")
    shares, adv, spread = F.when(line == 6, 0.0).when(line % 2 == 0, -q).otherwise(q), F.when(line == 5, 0.0).when(line != 4, q * (1 + discount * 200)), F.when(line != 3, tax / 10)
    # In steps, so that no value's formula is written out in each one that uses it: one method of it all is too long to be compiled to machine code.
    own = l.select("l_orderkey", "l_linenumber", q.alias("q"), price.alias("p"), tax.alias("t"), discount.alias("d"), shares.alias("shares"), (price / q).alias("unit"), adv.alias("adv"), spread.alias("spread"))
    parts, linear = S.cost_parts(F.col("shares"), F.col("unit"), F.col("adv"), F.col("t"), F.col("spread")), S.cost_parts(F.col("shares"), F.col("unit"), F.col("adv"), F.col("t"), linear=True, limit=0.2)
    known = ("l_orderkey", "l_linenumber", "q", "p", "d", "shares", "turnover", "k")
    priced = own.select(*known[:6], S.turnover_rate(F.col("spread")).alias("turnover"), S.impact_coefficient(F.col("t"), F.col("p") * 50, F.when(line != 2, 1e6)).alias("k"), parts.alias("c"), linear.alias("lin"))
    flat = priced.select(*known, *[F.col(f"c.{x}").alias(x) for x in ("notional", "commission", "spread_cost", "impact_cost", "total", "participation", "capped")], F.col("lin.impact_cost").alias("linear_impact"), F.col("lin.capped").alias("linear_capped"))
    rated = flat.withColumn("rate", S.cost_rate(F.struct("notional", "total")))
    return tidy(rated.select(
        "l_orderkey", "l_linenumber", "commission", "spread_cost", "impact_cost", "total", F.when(F.col("participation") < S.INF, F.col("participation")).alias("participation"), "capped", "linear_impact", "linear_capped", "rate",
        S.annual_cost_rate(F.col("rate"), F.col("q") / 52).alias("annual_rate"), S.carry_cost(F.col("shares") * F.col("p"), F.col("shares") < 0, F.col("q") / 52, own_rate=F.when(F.col("d") > 0.05, F.col("d"))).alias("carry"), "turnover", "k", S.cost_curvature(F.col("k"), F.col("d")).alias("curvature"),
    ), 8)


def a_windows(spark: SparkSession, sf: str) -> DataFrame:
    """What two reads of each user's bars lack, by timeframe: one over both timeframes, one that overlaps it over days alone."""
    own = market.fetches(spark, sf).withColumn("timeframe", F.when(F.dayofmonth("start") % 2 == 0, "1d").otherwise("1h"))
    read = lambda tf, a, b: own.select("symbol").distinct().select(F.lit(tf).alias("timeframe"), "symbol", bars.market_instant(F.lit(a)).alias("start"), bars.market_instant(F.lit(b)).alias("end"))
    reads = read("1h", "2024-01-05", "2024-01-25").unionByName(read("1d", "2024-01-05", "2024-01-25")).unionByName(read("1d", "2024-01-20T10:00:00", "2024-02-05T12:30:00Z"))
    return tidy(coverage.missing_windows(own, reads))


QUERIES = {f.__name__: f for f in (e_win_loss, e_exit_paths, e_durations, p_screen, p_baseline, p_gradients, p_skill, b_sizing, b_costs, a_windows)}

CLOSED = f"""{TRADED}, cl as (select td.* replace (case when l_linenumber = 6 then null else pnl end as pnl, case when l_linenumber <> 5 then entry_time end as entry_time), case l_orderkey % 5 when 0 then 'STOP_LOSS' when 1 then 'TAKE_PROFIT' when 2 then 'SIGNAL' else '(unlabelled)' end as exit_reason from td)"""
P = "case when pnl > 0 then pnl end"
L = "case when pnl < 0 then pnl end"


def over(a: str, b: str) -> str:
    return f"case when count(pnl) > 0 then case when {b} > 0 then {a} / {b} when {a} > 0 then 'inf'::double else 0 end end"


WINDOWS = (
    market.FETCHES.replace("fetches as", "fetched as")
    + ", fetches as (select case when day(start) % 2 = 0 then '1d' else '1h' end || symbol as symbol, start, \"end\" from fetched), "
    + market.ISLANDS
    + """, users as (select distinct symbol as u from fetched),
asked as (select '1h' || u as symbol, timestamp '2024-01-05 05:00:00' as a, timestamp '2024-01-25 05:00:00' as d from users union all select '1d' || u, timestamp '2024-01-05 05:00:00', timestamp '2024-01-25 05:00:00' from users
  union all select '1d' || u, timestamp '2024-01-20 15:00:00', timestamp '2024-02-05 12:30:00' from users),
near as"""
    + market.GAPS.split("near as", 1)[1]
    + """, g as (select * from gaps where gap_start < gap_end),
gr as (select *, max(gap_end) over (partition by symbol order by gap_start, gap_end rows between unbounded preceding and 1 preceding) as m from g),
gm as (select *, sum(case when m is null or gap_start > m then 1 else 0 end) over (partition by symbol order by gap_start, gap_end rows unbounded preceding) as island from gr),
parts as (select left(symbol, 2) as timeframe, substr(symbol, 3) as symbol, min(gap_start) as s, max(gap_end) as e from gm group by gm.symbol, island),
dates as (select timeframe, (min(s) - interval 5 hour)::date::varchar as first_date, case when max(e) - interval 5 hour = date_trunc('day', max(e) - interval 5 hour) then (max(e) - interval 5 hour)::date else (max(e) + interval 19 hour)::date end::varchar as last_date from parts group by timeframe)"""
)
#: Profits of the trades of g_trades from bars as they are, and from bars that each carry the values of five bars later.
PNL = f"with {market.HOUR}, {market.RETS}, {market.HELD}, {market.EXTRACTED} select round(exit_price / nullif(entry_price, 0) - 1, 6) as pnl from tr"
MOVED = PNL.replace("bars as (", "unmoved as (", 1).replace("rets as (", f"bars as (select * from (select ts, symbol, {', '.join(f'lead({c}, 5) over ({market.W}) as {c}' for c in ('open', 'high', 'low', 'close', 'volume'))} from unmoved) where close is not null), rets as (", 1)
NEAR = (7, 8, 9, 23, 26, 29)
#: The sweep of p_sweep, unrounded.
SWEEP = "sw as (select fast, slow, n, total, sharpe from (" + market.SQL["p_sweep"] + "))"
SQL = {
    "e_win_loss": f"""with {CLOSED} select symbol, count(*) as rows, count(pnl) as trades, count(*) - count(pnl) as unmeasured, count({P}) as wins, count({L}) as losses, count(*) filter (where pnl = 0) as flat, {r(f'count({P}) / count(pnl)', 3)} as win_rate, {r('sum(pnl)', 3)} as net_pnl,
  {r(f'coalesce(sum({P}), 0)', 3)} as gross_profit, {r(f'coalesce(sum({L}), 0)', 3)} as gross_loss, {r(f'avg({P})', 3)} as avg_win, {r(f'avg({L})', 3)} as avg_loss, {r(f'max({P})', 3)} as largest_win, {r(f'min({L})', 3)} as largest_loss, {r('avg(pnl)', 3)} as expectancy,
  {r(over(f'coalesce(sum({P}), 0)', f'coalesce(-sum({L}), 0)'), 3)} as profit_factor, {r(over(f'coalesce(avg({P}), 0)', f'coalesce(-avg({L}), 0)'), 3)} as payoff_ratio from cl group by symbol""",
    "e_exit_paths": f"""with {CLOSED}, g as (select symbol, exit_reason, count(*) as rows, count(pnl) as trades, sum(pnl) as net, count({P}) / nullif(count(pnl), 0) as wr from cl group by symbol, exit_reason),
h as (select *, row_number() over (partition by symbol order by net desc nulls last, exit_reason) as place, rows / sum(rows) over (partition by symbol) as sr, case when net > 0 then net / sum(case when net > 0 then net end) over (partition by symbol) end as sg from g)
select symbol, exit_reason, place, rows, trades, {r('net', 3)} as net_pnl, {r('wr', 3)} as win_rate, {r('sr', 3)} as share_of_rows, {r('sg', 3)} as share_of_gain, place = 1 and sg is not null as top_gain from h""",
    "e_durations": f"""with {CLOSED}, d as (select symbol, (epoch(exit_time) - epoch(entry_time)) / 86400 as x from cl)
select symbol, count(x) as n_measured, count(*) - count(x) as n_unmeasured, {r('quantile_cont(x, 0.5)', 4)} as median, {r('avg(x)', 4)} as mean, {r('quantile_cont(x, 0.25)', 4)} as p25, {r('quantile_cont(x, 0.75)', 4)} as p75, {r('quantile_cont(x, 0.9)', 4)} as p90, {r('min(x)', 4)} as min, {r('max(x)', 4)} as max from d group by symbol""",
    "p_screen": f"""with {SWEEP} select count(*) as n, count(sharpe) as n_finite, 0::bigint as n_dropped, {r('quantile_cont(sharpe, 0.5)', 4)} as median, {r('avg(sharpe)', 4)} as mean, {r('stddev_samp(sharpe)', 4)} as std, {r('quantile_cont(sharpe, 0.25)', 4)} as p25, {r('quantile_cont(sharpe, 0.75)', 4)} as p75,
  {r('min(sharpe)', 4)} as min, {r('max(sharpe)', 4)} as max, {r('avg((sharpe > 0)::int)', 4)} as positive_rate, arg_max(fast, sharpe) as fast, arg_max(slow, sharpe) as slow from sw""",
    "p_gradients": f"""with {SWEEP}, u as (select 'fast' as param, fast::double as value, sharpe from sw union all select 'slow', slow, sharpe from sw)
select param, value, count(*) as n, count(*) filter (where sharpe > 0) as positive, {r('avg((sharpe > 0)::int)', 4)} as positive_rate, {r('median(sharpe)', 4)} as median, {r('max(sharpe)', 4)} as max from u group by param, value""",
    "b_sizing": f"""with l as (select *, l_quantity::double as q, l_extendedprice::double as p, l_tax::double as t, l_discount::double as d, l_extendedprice::double / l_quantity::double as u from lineitem)
select l_orderkey, l_linenumber, {r('case when abs(u / 997) < 1 then round(u / 997, 4) else round(u / 997, 2) end', 7)} as tick, floor(q / 3)::bigint as shares, q * u < 20000 as small,
  {r('case when u > 0 and t > 0 then least(1e6 * 0.01 / (u * t), 5e4 / u, 1e6 * 0.02 / (u * t)) else 0 end', 7)} as risk_size, {r('q / least(greatest(abs(d * 50), 0.25), 4)', 7)} as scaled, {r('d * 1e6 / u', 7)} as weighted,
  {r('p * 3 / 1e4 + 0.1 * t * sqrt(p / (q * 1000)) * p', 7)} as cost, {r('p * 3 / 1e4 + 0.1 * t * least(p / (q * 100), 0.5) * p', 7)} as capped_cost, {r('t * 252 / q', 7)} as yearly, {r('case when l_linenumber % 2 = 0 then p * 0.03 * q / 252 else 0 end', 7)} as carry,
  {r('case when l_linenumber % 2 = 0 then 1 else -1 end * (u * (1 + t) - u) / u * 1e4', 7)} as slippage, case when l_linenumber <> 2 then l_linenumber * 3600000 + 1500 end::bigint as elapsed, {r('case when l_linenumber <> 3 then q end', 7)} as stated from l""",
    "b_costs": f"""with l as (select l_orderkey, l_linenumber, l_linenumber as n, l_quantity::double as q, l_extendedprice::double as p, l_tax::double as t, l_discount::double as d from lineitem),
m as (select *, case when n = 6 then 0 when n % 2 = 0 then -q else q end as sh, case when n = 5 then 0 when n <> 4 then q * (1 + d * 200) end as adv, coalesce(case when n <> 3 then t / 10 end, 0.0005) as sp from l),
c as (select *, case when n = 6 then 0 else p end as size, case when n = 6 then 0 when adv > 0 then q / adv end as part, case when n <> 2 and t > 0 then 0.3 * t * sqrt(1e6 / (p * 50)) else 0 end as k from m),
e as (select *, size / 1e4 as com, sp / 2 * size as spc, coalesce(0.3 * t * sqrt(part) * size, 0) as imp from c), f as (select *, com + spc + imp as total, case when size > 0 then (com + spc + imp) / size else 0 end as rate from e)
select l_orderkey, l_linenumber, {r('com', 8)} as commission, {r('spc', 8)} as spread_cost, {r('imp', 8)} as impact_cost, {r('total', 8)} as total, {r('part', 8)} as participation, n <> 6 and coalesce(part > 0.1, true) as capped, {r('coalesce(0.3 * t * part * size, 0)', 8)} as linear_impact,
  n <> 6 and coalesce(part > 0.2, true) as linear_capped, {r('rate', 8)} as rate, {r('2 * rate / (q / 52)', 8)} as annual_rate, {r('case when sh < 0 then case when d > 0.05 then d else 0.005 end * abs(sh * p) * (q / 52) else 0 end', 8)} as carry, {r('0.0001 + sp / 2', 8)} as turnover, {r('k', 8)} as k,
  {r('case when k > 0 and d > 0 then 0.75 * k / sqrt(d) end', 8)} as curvature from f""",
    "a_windows": f"with {WINDOWS} select timeframe, symbol, floor(epoch(s))::bigint as start, floor(epoch(e))::bigint as \"end\", first_date, last_date from parts join dates using (timeframe)",
    # Older queries.
    "p_distribution": f"with {SWEEP}, u as (select 'fast' as param, fast::double as value, total from sw union all select 'slow', slow, total from sw) select param, value, count(*) as n, {r('avg(total)', 4)} as mean, {r('max(total)', 4)} as best from u group by param, value",
    "x_refine": f"""with {market.DAY}, {market.RETS}, {market.XS}, w1 as (select *, case when ret is not null then least(greatest(ret, q1), q2) end as w from xs), w2 as (select *, avg(w) over p as wm, stddev_pop(w) over p as ws, avg(abs(w)) over p as wa from w1 window p as (partition by ts)),
z1 as (select *, case when w is null then null when coalesce(ws, 0) <= 1e-12 * greatest(1, wa) then 0 else (w - wm) / ws end as z from w2), z2 as (select *, regr_slope(z, case when z is not null then volume end) over p as s2, regr_intercept(z, case when z is not null then volume end) over p as c2, count(z) over p as n2 from z1 window p as (partition by ts)),
a1 as (select *, 0.015 * case when nn < 10 then ret - mu when z is null or n2 < 2 or s2 is null or isnan(s2) then z else z - c2 - s2 * volume end as a from z2), a2 as (select *, stddev_pop(a) over p as sa, avg(abs(a)) over p as aa from a1 window p as (partition by ts))
select epoch(ts)::bigint as ts, symbol, {r('case when nn < 10 or a is null or coalesce(sa, 0) <= 1e-12 * greatest(1, aa) then a else least(greatest(a, -3 * sa), 3 * sa) end')} as alpha, nn < 10 as thin from a2""",
    "p_shift": f"""with b as (select count(*) as n from ({PNL})), m as (select count(*) as n from ({MOVED})), d as (select count(*) as n from ((({PNL}) except all ({MOVED})) union all (({MOVED}) except all ({PNL}))))
select b.n as base_trades, m.n as shifted_trades, d.n > 0 or b.n + m.n = 0 as passed from b, m, d""",
    "p_sensitivity": f"""with {market.WEEK}, {market.RETS}, m as (select *, {', '.join(f'case when count(close) over w{n} = {n} then avg(close) over w{n} end as m{n}' for n in NEAR)} from rets window {', '.join(f'w{n} as ({market.W} rows between {n - 1} preceding and current row)' for n in NEAR)}),
c as ({' union all '.join(f'select {f} as fast, {s} as slow, ts, ret, lag((m{f} > m{s})::int) over ({market.W}) as held from m' for f, s in ((8, 26), (7, 26), (9, 26), (8, 23), (8, 29)))}),
k as (select fast, slow, ts, avg(ret * held) as x from c where ret is not null and held is not null group by fast, slow, ts), z as (select fast, slow, {market.sharpe('x', 52)} as s from k group by fast, slow), g as (select max(case when fast = 8 and slow = 26 then s end) as base, min(case when fast <> 8 or slow <> 26 then s end) as worst, count(*) - 1 as n from z)
select {r('base', 5)} as base_sharpe, {r('greatest(coalesce((base - worst) / nullif(abs(base), 0), 0), 0)', 5)} as max_sharpe_loss, n as neighbours from g""",
    "w_barcheck": f"with recursive {FED.replace('as late,', 'and false as late,').replace('fd as (select *, ts + case when day(ts) % 5 = 2 then interval 5 day else interval 1 day end as arrival from bars union all select *, ts + interval 6 day from bars where day(ts) % 7 = 3)', 'fd as (select *, ts as arrival from bars)')} select coalesce(reason, 'accepted') as reason, count(*) as n from wk group by 1",
}
