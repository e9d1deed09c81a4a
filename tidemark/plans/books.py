"""Registered queries of the bar store, event-time bar checks, equity of trades, block resamples and signal horizons, each with its DuckDB SQL."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from ..operators import equity, reports
from ..sources import bars, store
from ..streaming import barcheck
from .queries import DAY, HOUR, LAGS, RETS, WEEK, lagged, r, tidy

CAPITAL, START, END = 1_000_000.0, "1995-01-01", "1997-01-01"
SAMPLES, BLOCK = 200, 20


def a_replace(spark: SparkSession, sf: str) -> DataFrame:
    """Hourly bars stored, one symbol replaced by half of its bars at twice the close, bars of January 5th upserted, one symbol removed, read back."""
    b = bars.hourly(spark, sf)
    held = store.BarStore(spark, store.temporary(spark, "bars"))
    held.upsert(b, "1Hour")
    held.replace(b.where("symbol = 'click' and hour(ts) % 2 = 0").withColumn("close", F.col("close") * 2), "1Hour")
    held.upsert(b.where("to_date(ts) = '2024-01-05'").withColumn("volume", F.col("volume") + 1), "1Hour")
    held.delete(b.where("symbol = 'view'").select("symbol"), "1Hour")
    return tidy(held.read("1Hour").select("ts", "symbol", "close", "volume"))


def fed(spark: SparkSession, sf: str) -> DataFrame:
    """Daily bars as a feed sends them: a day later, some five days later, some again."""
    b = bars.daily(spark, sf)
    day = F.dayofmonth("ts")
    first = b.withColumn("arrival", F.col("ts") + F.when(day % 5 == 2, F.expr("interval 5 days")).otherwise(F.expr("interval 1 day")))
    return first.unionByName(b.where(day % 7 == 3).withColumn("arrival", F.col("ts") + F.expr("interval 6 days")))


def verdicts(spark: SparkSession, sf: str) -> DataFrame:
    return barcheck.batch_verdicts(fed(spark, sf), order="arrival", arrival="arrival", minutes=1440)


def w_verdicts(spark: SparkSession, sf: str) -> DataFrame:
    return tidy(verdicts(spark, sf))


def w_rejections(spark: SparkSession, sf: str) -> DataFrame:
    return tidy(barcheck.rejection_report(verdicts(spark, sf), ["symbol"]).drop("by_reason"))


def dated_trades(spark: SparkSession, sf: str) -> DataFrame:
    """Order lines as trades from the order's day to the shipment's."""
    o = spark.read.parquet(f"{sf}/orders.parquet").select("o_orderkey", "o_orderdate")
    l = spark.read.parquet(f"{sf}/lineitem.parquet").select("l_orderkey", "l_linenumber", "l_partkey", "l_shipdate", "l_quantity", "l_extendedprice")  # noqa: E741
    p = spark.read.parquet(f"{sf}/part.parquet").select("p_partkey", "p_brand", "p_retailprice")
    rows = l.join(o, l.l_orderkey == o.o_orderkey).join(p, l.l_partkey == p.p_partkey).where("l_shipdate >= o_orderdate")
    q, price, entry = (F.col(c).cast("double") for c in ("l_quantity", "l_extendedprice", "p_retailprice"))
    return rows.select(F.col("p_brand").alias("symbol"), F.col("o_orderdate").cast("timestamp").alias("entry_time"), F.col("l_shipdate").cast("timestamp").alias("exit_time"), entry.alias("entry_price"), q.alias("size"), (price - entry * q).alias("pnl"), "l_orderkey", "l_linenumber")


def e_dated(spark: SparkSession, sf: str) -> DataFrame:
    return tidy(equity.dated_equity(dated_trades(spark, sf), ["symbol"], CAPITAL), 3)


def e_trade_row(spark: SparkSession, sf: str) -> DataFrame:
    return tidy(equity.trade_row(dated_trades(spark, sf), ["symbol"], capital=CAPITAL, start=START, end=END), 4)


def e_buy_hold(spark: SparkSession, sf: str) -> DataFrame:
    return tidy(equity.buy_and_hold(bars.weekly(spark, sf).withColumn("maker", F.substring("symbol", 7, 1)), ["maker"]), 4)


def p_montecarlo(spark: SparkSession, sf: str) -> DataFrame:
    daily = equity.dated_equity(dated_trades(spark, sf), ["symbol"], CAPITAL)
    begun = daily.withColumn("__i", F.row_number().over(Window.partitionBy("symbol").orderBy("ts"))).where("__i > 1")
    return tidy(equity.monte_carlo(begun, ["symbol"], samples=SAMPLES, block=BLOCK), 3)


def e_candidates(spark: SparkSession, sf: str) -> DataFrame:
    return tidy(equity.trailing_score(bars.weekly(spark, sf)))


def e_horizon(spark: SparkSession, sf: str) -> DataFrame:
    """The decay of the coefficients of a momentum score of returns: only positive ones count."""
    return tidy(reports.horizon_fit(reports.ic_by_lag(lagged(spark, sf), 8)), 5)


def e_cadence(spark: SparkSession, sf: str) -> DataFrame:
    return tidy(reports.cadence_curve(reports.ic_by_lag(lagged(spark, sf), 8)))


QUERIES = {f.__name__: f for f in (a_replace, w_verdicts, w_rejections, e_dated, e_trade_row, e_buy_hold, p_montecarlo, e_candidates, e_horizon, e_cadence)}

FED = f"""{DAY},
fd as (select *, ts + case when day(ts) % 5 = 2 then interval 5 day else interval 1 day end as arrival from bars union all select *, ts + interval 6 day from bars where day(ts) % 7 = 3),
fo as (select *, row_number() over (partition by symbol order by arrival, ts) as rn, arrival - ts > interval 3 day as late,
  case when open is null or high is null or low is null or close is null then 'malformed' when least(open, high, low, close) <= 0 then 'non_positive' when high < low then 'inverted_range' when close > high or close < low or open > high or open < low then 'outside_range' when volume < 0 then 'negative_volume' end as fault from fd),
wk as (select symbol, rn, ts, close, coalesce(fault, case when late then 'stale' end) as reason, case when fault is null and not late then ts end as last_ts, case when fault is null and not late then close end as last_close, coalesce(fault is null and not late and volume > 0, false) as traded from fo where rn = 1
  union all select symbol, rn, ts, close, reason, case when reason is null then ts else last_ts end, case when reason is null then close else last_close end, traded or (reason is null and volume > 0)
  from (select f.symbol, f.rn, f.ts, f.close, f.volume, w.last_ts, w.last_close, w.traded,
      coalesce(f.fault, case when f.ts <= w.last_ts then 'out_of_order' when f.late then 'stale' when w.last_close <> 0 and abs(f.close / w.last_close - 1) > 0.35 then 'spike' when w.traded and f.volume = 0 then 'zero_volume' end) as reason
    from wk w join fo f on f.symbol = w.symbol and f.rn = w.rn + 1))"""
TRADED = """td as (select p_brand as symbol, o_orderdate::timestamp as entry_time, l_shipdate::timestamp as exit_time, p_retailprice::double as entry_price, l_quantity::double as size, l_extendedprice::double - p_retailprice::double * l_quantity::double as pnl, l_orderkey, l_linenumber
  from lineitem join orders on l_orderkey = o_orderkey join part on l_partkey = p_partkey where l_shipdate >= o_orderdate)"""
DATED = """bd as (select symbol, (exit_time::date - greatest(isodow(exit_time) - 5, 0)::int)::date as d, sum(pnl) as pnl from td group by 1, 2),
sp as (select symbol, min(d) as f, max(d) as l from bd group by symbol),
ca as (select symbol, unnest(generate_series((f - case when isodow(f) = 1 then 3 else 1 end)::timestamp, l::timestamp, interval 1 day)) as ts from sp),
de as (select ca.symbol, ca.ts, coalesce(pnl, 0) as pnl, 1000000 + sum(coalesce(pnl, 0)) over (partition by ca.symbol order by ca.ts rows unbounded preceding) as equity from ca left join bd on bd.symbol = ca.symbol and bd.d = ca.ts::date where isodow(ca.ts) <= 5)"""
#: Each block is added up day by day: no running sums.
RESAMPLED = f"""da as (select * from (select *, row_number() over (partition by symbol order by ts) - 2 as i, count(*) over (partition by symbol) - 1 as n from de) where i >= 0 and n >= {BLOCK}),
sz as (select symbol, any_value(n) as n, ceil(any_value(n) / {BLOCK})::bigint as nb from da group by symbol),
dr as (select symbol, n, nb, sample, k, ('0x' || substr(md5('0:' || sample || ':' || k), 1, 8))::bigint % (n - {BLOCK} + 1) as s from (select *, unnest(generate_series(0, nb - 1)) as k from (select *, unnest(generate_series(0, {SAMPLES - 1})) as sample from sz))),
dy as (select symbol, n, sample, s + unnest(generate_series(0, case when k = nb - 1 then n - (nb - 1) * {BLOCK} - 1 else {BLOCK - 1} end)) as i from dr),
rs as (select dy.symbol, sample, sum(pnl) as total, case when stddev_samp(pnl) > 1e-9 then sqrt(252) * avg(pnl) / stddev_samp(pnl) else 0 end as sharpe from dy join da on da.symbol = dy.symbol and da.i = dy.i group by dy.symbol, sample)"""
LAGS8 = LAGS.split("),\npl as")[0].replace("lg as (", "")
LAGS8 = " union all ".join(LAGS8.split(" union all ")[0].replace("select 1 as lag", f"select {k} as lag").replace("lead(ret, 1)", f"lead(ret, {k})") for k in range(1, 9))
PROFILE = f"lg as ({LAGS8}),\npl as" + LAGS.split("),\npl as")[1]
SQL = {
    "a_replace": f"""with {HOUR}, st as (select * from bars where symbol not in ('click', 'view') union all select * replace (close * 2 as close) from bars where symbol = 'click' and hour(ts) % 2 = 0),
up as (select ts, symbol, close, volume + 1 as volume from bars where ts::date = date '2024-01-05' and symbol <> 'view')
select epoch(ts)::bigint as ts, symbol, {r('close')} as close, {r('volume')} as volume from (select ts, symbol, close, volume from st where ts::date <> date '2024-01-05' union all select * from up)""",
    "w_verdicts": f"with recursive {FED} select symbol, epoch(ts)::bigint as ts, {r('close')} as close, reason from wk",
    "w_rejections": f"with recursive {FED} select symbol, count(*) as seen, count(reason) as rejected, {r('count(reason) / count(*)')} as rate, count(reason) / count(*) > 0.05 and count(reason) > 5 as elevated from wk group by symbol",
    "e_dated": f"with {TRADED}, {DATED} select symbol, epoch(ts)::bigint as ts, {r('pnl', 3)} as pnl, {r('equity', 3)} as equity from de",
    "e_trade_row": f"""with {TRADED}, sg as (select *, sign(pnl) as s from td), rn as (select *, row_number() over (partition by symbol order by exit_time, entry_price, entry_time, l_linenumber, l_orderkey, pnl, size) as i, row_number() over (partition by symbol, s order by exit_time, entry_price, entry_time, l_linenumber, l_orderkey, pnl, size) as j from sg),
lr as (select symbol, max(case when s = 1 then c end) as w, max(case when s = -1 then c end) as l from (select symbol, s, count(*) as c from rn group by symbol, s, i - j) group by symbol),
se as (select symbol, unnest(generate_series(entry_time, exit_time - interval 1 day, interval 1 day)) as d from td), ex as (select symbol, count(distinct d) * 86400 as c from se group by symbol),
ag as (select symbol, count(*) as n, sum(pnl) as net, avg(pnl) filter (where pnl > 0) as aw, -avg(pnl) filter (where pnl < 0) as al, max(pnl) filter (where pnl > 0) as lw, -min(pnl) filter (where pnl < 0) as ll, sum(pnl) filter (where pnl > 0) as won, -sum(pnl) filter (where pnl < 0) as lost,
  count(*) filter (where pnl > 0) / count(*) as wr, avg(pnl) as ex, stddev_samp(pnl) as sd, avg(epoch(exit_time) - epoch(entry_time)) / 3600 as hours, sum(entry_price * size) / 1000000 as turn from td group by symbol)
select symbol, {r('net / 10000', 4)} as total_return, {r('coalesce(aw, 0)', 4)} as avg_win, {r('coalesce(al, 0)', 4)} as avg_loss, {r('coalesce(lw, 0)', 4)} as largest_win, {r('coalesce(ll, 0)', 4)} as largest_loss,
  {r("case when lost > 0 then net / lost when net > 0 then 'inf'::double else 0 end", 4)} as gain_to_pain, {r('hours', 4)} as avg_hours, {r('turn', 4)} as turnover, 0.0::double as mae_pct, 0.0::double as mfe_pct, n < 30 as low_sample, n as n_trades, {r('wr', 4)} as win_rate,
  {r("case when lost > 0 then coalesce(won, 0) / lost when won > 0 then 'inf'::double else 0 end", 4)} as profit_factor, {r('ex', 4)} as expectancy, {r("case when coalesce(al, 0) > 0 then coalesce(aw, 0) / al when aw > 0 then 'inf'::double else 0 end", 4)} as payoff,
  {r('case when al > 0 and aw > 0 then wr - (1 - wr) / (aw / al) else 0 end', 4)} as kelly, {r('case when sd > 0 then sqrt(n) * ex / sd else 0 end', 4)} as sqn, coalesce(w, 0) as max_wins, coalesce(l, 0) as max_losses,
  {r("100 * least(coalesce(c, 0) / (epoch(timestamp '1997-01-01') - epoch(timestamp '1995-01-01')), 1)", 4)} as exposure from ag join lr using (symbol) left join ex using (symbol)""",
    "e_buy_hold": f"with {WEEK}, o as (select symbol, substr(symbol, 7, 1) as maker, arg_min(open, ts) as o, arg_max(close, ts) as c from bars group by symbol) select maker, {r('avg((c / o - 1) * 100)', 4)} as buy_hold from o group by maker",
    "p_montecarlo": f"with {TRADED}, {DATED}, {RESAMPLED}, pe as (select symbol, count(*) as periods from de group by symbol), q as (select symbol, count(*) as samples, quantile_cont(sharpe, 0.05) as a, quantile_cont(sharpe, 0.5) as b, quantile_cont(total, 0.05) as c from rs group by symbol) select symbol, periods - 1 as periods, coalesce(samples, 0) as samples, {r('a', 3)} as sharpe_p05, {r('b', 3)} as sharpe_p50, {r('c', 3)} as return_p05 from pe left join q using (symbol)",
    "e_candidates": f"with {WEEK} select symbol, {r('greatest(arg_max(close, ts) / arg_min(close, ts) - 1, 0)')} as score from bars group by symbol",
    "e_horizon": f"""with {WEEK}, {RETS}, {PROFILE}, x as (select lag::double as x, ln(mean_ic) as y from prof where mean_ic > 0), f as (select count(*) as n, regr_slope(y, x) as b, regr_intercept(y, x) as a, regr_sxx(y, x) as sxx, regr_r2(y, x) as r2, regr_syy(y, x) as syy from x),
g as (select *, case when n > 2 then sqrt(syy * (1 - r2) / (n - 2) / sxx) end as se from f)
select n as lags, {r('case when n >= 2 then exp(b) end', 5)} as delta, {r("case when n >= 2 then case when b < 0 then -ln(2) / b else 'inf'::double end end", 5)} as half_life, {r('case when n >= 2 then exp(a) end', 5)} as ic0, {r('case when n >= 2 then r2 else 0 end', 5)} as r_squared, {r('se', 5)} as slope_error,
  {r("case when n >= 2 then case when b - 1.96 * coalesce(se, 0) < 0 then -ln(2) / (b - 1.96 * coalesce(se, 0)) else 'inf'::double end end", 5)} as half_life_lower, {r("case when n >= 2 then case when b + 1.96 * coalesce(se, 0) < 0 then -ln(2) / (b + 1.96 * coalesce(se, 0)) else 'inf'::double end end", 5)} as half_life_upper,
  {r("case when n >= 2 then case when b < 0 then -1.2564312086 / b else 'inf'::double end end", 5)} as peak_horizon from g""",
    "e_cadence": f"with {WEEK}, {RETS}, {PROFILE} select lag, {r('mean_ic / sqrt(lag)')} as ir, lag = (select arg_max(lag, mean_ic / sqrt(lag)) from prof) as recommended from prof",
}
