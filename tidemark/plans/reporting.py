"""Registered queries of two-sided trades and of reports on books and trials, each with its DuckDB SQL."""

from __future__ import annotations

from datetime import datetime

from pyspark.sql import DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from ..functions import scalars as S
from ..operators import reporting, rounds, sweep
from ..sources import bars
from . import queries as market
from .queries import r, returns_of, tidy

SIDES = 'case when ret > 0.5 then \'BUY\' when ret < -0.4 then \'SELL\' when hour(ts) % 7 = 3 then \'CLOSE_BUY\' when hour(ts) % 5 = 2 then \'CLOSE_SELL\' end'


def signalled(spark: SparkSession, sf: str) -> DataFrame:
    """Hourly bars with signals of both sides and of both closings."""
    return returns_of(bars.hourly(spark, sf)).withColumn("signal", F.expr(SIDES))


def c_scores(spark: SparkSession, sf: str) -> DataFrame:
    return tidy(bars.hourly(spark, sf).select("ts", "symbol", rounds.breakout_score(5, 20).alias("breakout"), rounds.reversion_score(20, 1.0).alias("reversion")))


def g_rounds(spark: SparkSession, sf: str) -> DataFrame:
    return tidy(rounds.round_trips(signalled(spark, sf)))


def bracketed(spark: SparkSession, sf: str) -> DataFrame:
    b = signalled(spark, sf)
    return rounds.bracket_exits(rounds.round_trips(b), b, stop=0.3, take=0.5, margin_bps=20.0)


def g_brackets(spark: SparkSession, sf: str) -> DataFrame:
    return tidy(bracketed(spark, sf))


def g_records(spark: SparkSession, sf: str) -> DataFrame:
    none = F.lit(None).cast("double")
    size = S.whole_shares(F.try_divide(F.lit(1e5), F.col("entry_price")))
    sized = bracketed(spark, sf).withColumn("size", size)
    costed = sized.withColumns({"entry_cost": S.trade_cost(F.col("entry_price") * F.col("size"), none, none), "exit_cost": S.trade_cost(F.col("exit_price") * F.col("size"), none, none)})
    return tidy(rounds.trade_records(costed, signalled(spark, sf)), 7)


def g_signals(spark: SparkSession, sf: str) -> DataFrame:
    return tidy(reporting.signal_evaluation(signalled(spark, sf).select("ts", "symbol", "close", "signal"), 5, ["symbol"]), 4)


def samples(spark: SparkSession, sf: str) -> DataFrame:
    """Weekly bars as books: the high is their equity (none in the first days of a month), the move their net, the range their gross exposure."""
    b = bars.weekly(spark, sf)
    return b.select("symbol", "ts", F.when(F.dayofmonth("ts") > 3, F.col("high")).otherwise(0.0).alias("equity"), (F.col("close") - F.col("open")).alias("net"), (F.col("high") - F.col("low")).alias("gross"), "close", "high", "low", F.dayofmonth("ts").alias("open_positions"))


def e_net_cap(spark: SparkSession, sf: str) -> DataFrame:
    return tidy(reporting.net_cap(samples(spark, sf), ["symbol"], gross_cap=1.0), 5)


def e_net_caps(spark: SparkSession, sf: str) -> DataFrame:
    return tidy(reporting.candidate_caps(samples(spark, sf), ["symbol"]), 5)


def e_moments(spark: SparkSession, sf: str) -> DataFrame:
    s = samples(spark, sf).select("symbol", "ts", F.col("close").alias("equity_close"), F.col("low").alias("equity_adverse"), F.col("high").alias("equity_favourable"), "gross", "net", "open_positions")
    found = reporting.moments(s, ["symbol"])
    flat = [F.col(f"{m}_at.{c}").alias(f"{m}_{c}") for m in ("adverse", "favourable", "closing") for c in ("ts", "equity", "peak", "open_positions", "gross_pct", "net_pct", "drawdown_at_close_pct")]
    return tidy(found.select("symbol", "n_steps", "adverse_pct", "favourable_pct", "closing_pct", "understatement_pct", *flat), 5)


def e_capital(spark: SparkSession, sf: str) -> DataFrame:
    """A book for each day of the month, of the brands by their last close, volume and deviation."""
    h = returns_of(bars.weekly(spark, sf)).groupBy(F.dayofmonth("ts").alias("book"), "symbol").agg(F.max_by("close", "ts").alias("price"), F.avg("volume").alias("adv"), F.stddev_samp("ret").alias("vol"))
    k = F.col("book")
    return tidy(reporting.largest_capital(h.withColumns({"weight": F.when(k != 7, 0.04).otherwise(0.0), "gross_alpha": (k - 2).cast("double") / 1e4 * F.when(k > 28, 1e9).otherwise(1.0)}), ["book"], years=0.25), 2)


def books(spark: SparkSession, sf: str) -> DataFrame:
    """Books by region: a nation's weight is what its customers hold, or 0."""
    c = spark.read.parquet(f"{sf}/customer.parquet").join(spark.read.parquet(f"{sf}/nation.parquet"), F.col("c_nationkey") == F.col("n_nationkey"))
    return c.groupBy(F.col("n_regionkey").alias("book"), F.col("n_name").alias("symbol")).agg(F.greatest(F.sum(F.when(F.col("c_acctbal") > 0, F.col("c_acctbal").cast("double")).otherwise(-9 * F.col("c_acctbal").cast("double") * (F.col("c_nationkey") % 3 - 2))), F.lit(0.0)).alias("weight"))


BOOKS = "bks as (select n_regionkey as book, n_name as symbol, greatest(sum(case when c_acctbal > 0 then c_acctbal::double else -9 * c_acctbal::double * (c_nationkey % 3 - 2) end), 0) as weight from customer join nation on c_nationkey = n_nationkey group by 1, 2)"


def e_restricted(spark: SparkSession, sf: str) -> DataFrame:
    w = books(spark, sf)
    covered = spark.read.parquet(f"{sf}/supplier.parquet").where("s_acctbal > 9000").join(spark.read.parquet(f"{sf}/nation.parquet"), F.col("s_nationkey") == F.col("n_nationkey")).select(F.col("n_name").alias("symbol"))
    return tidy(reporting.restricted(w, covered, ["book"]))


def e_book_factors(spark: SparkSession, sf: str) -> DataFrame:
    """Exposures of the books to what their nations' suppliers own and how many they are, and the share of nations that they hold nothing of."""
    s = spark.read.parquet(f"{sf}/supplier.parquet").join(spark.read.parquet(f"{sf}/nation.parquet"), F.col("s_nationkey") == F.col("n_nationkey")).groupBy(F.col("n_name").alias("symbol")).agg(F.avg(F.col("s_acctbal").cast("double")).alias("owned"), F.count("*").cast("double").alias("many"))
    panel = s.select("symbol", F.explode(F.array(*[F.struct(F.lit(f).alias("factor"), F.col(f).alias("value")) for f in ("owned", "many")])).alias("x")).select("symbol", "x.*")
    w = books(spark, sf).withColumn("weight", F.col("weight") / 1e6)
    every = spark.read.parquet(f"{sf}/nation.parquet").select(F.col("n_regionkey").alias("book"), F.col("n_name").alias("symbol"))
    return tidy(reporting.book_exposures(w, panel, ["book"]).join(reporting.binding_fraction(w, every, ["book"]), "book"), 3)


def e_leg_report(spark: SparkSession, sf: str) -> DataFrame:
    """Order lines by ship week: the profit of each side so far as its curve, against the brands' mean return."""
    t = market.trade_table(spark, sf)
    l = spark.read.parquet(f"{sf}/lineitem.parquet")  # noqa: E741
    side = F.when(F.col("l_linestatus") == "F", "BUY").otherwise("SELL")
    week = l.groupBy(side.alias("side"), F.date_trunc("week", "l_shipdate").alias("ts")).agg(F.sum(F.col("l_extendedprice").cast("double") * (F.col("l_discount").cast("double") - 0.05)).alias("x"))
    curve = week.select("side", "ts", F.sum("x").over(Window.partitionBy("side").orderBy("ts")).alias("value"))
    bench = returns_of(bars.weekly(spark, sf)).groupBy("ts").agg(F.avg("ret").alias("ret"))
    return tidy(reporting.leg_report(curve, t, bench, 1e7), 3)


def l_sessions(spark: SparkSession, sf: str) -> DataFrame:
    e = spark.read.parquet(f"{sf}/events.parquet")
    kind = F.when(F.col("event_type") == "view", "session").when(F.col("event_type") == "purchase", "session_outcome").otherwise(F.col("event_type"))
    return reporting.sessions(e.select("user_id", F.col("event_id").alias("seq"), kind.alias("event")), ["user_id"])


def deflated(spark: SparkSession, sf: str) -> DataFrame:
    return market.trial_table(spark, sf).withColumn("deflated_sharpe", F.when(F.col("ts") % 7 != 0, F.col("oos_sharpe") - F.col("n_trials_in_session") / 10))


def t_board(spark: SparkSession, sf: str) -> DataFrame:
    rows, _ = reporting.board(deflated(spark, sf), 25)
    return tidy(rows.select("id", "strategy", "deflated_sharpe", "rank", "family_n_trials"))


def t_board_counts(spark: SparkSession, sf: str) -> DataFrame:
    """What the boards by both ratios and with trials in sample leave out."""
    t = deflated(spark, sf)
    parts = [reporting.board(t, rank_by=m, include_in_sample=i)[1].withColumns({"rank_by": F.lit(m), "all_kinds": F.lit(i)}) for m in ("dsr", "sharpe") for i in (False, True)]
    return parts[0].unionByName(parts[1]).unionByName(parts[2]).unionByName(parts[3])


def t_pairs(spark: SparkSession, sf: str) -> DataFrame:
    """Pairs of brands of one manufacturer as trials of several kinds and two accountings; one brand of each is stored without returns."""
    s = returns_of(bars.weekly(spark, sf)).select(F.col("symbol").alias("trial_id"), "ts", "ret")
    last, maker = F.expr("right(symbol, 1)").cast("int"), F.expr("substring(symbol, 1, length(symbol) - 1)")
    names = s.select(F.col("trial_id").alias("symbol")).distinct()
    t = names.select(maker.alias("maker"), F.col("symbol").alias("id"), F.lit(0).alias("ts"), F.when(last % 2 == 0, "walkforward").when(last == 1, "research").when(last == 3, "backtest").alias("kind"), F.when(last == 4, 2).otherwise(1).alias("accounting"))
    twice = t.unionByName(t.withColumn("ts", F.lit(1)).withColumn("kind", F.lit("optimize")))
    return tidy(reporting.compared(twice, s.where("right(trial_id, 1) <> '5'"), ["maker"]))


def t_recorded(spark: SparkSession, sf: str) -> DataFrame:
    """Hourly returns of all event types after those of some were recorded anew, with fewer rows."""
    old = returns_of(bars.hourly(spark, sf)).select(F.col("symbol").alias("trial_id"), "ts", "ret")
    new = old.where("trial_id > 'e' and hour(ts) < 12").withColumn("ret", F.col("ret") * 2)
    return tidy(reporting.recorded(old, new))


def p_plan(spark: SparkSession, sf: str) -> DataFrame:
    plan = sweep.fold_plan(datetime(1993, 1, 4), datetime(1998, 1, 5), n_folds=5, embargo_days=7, holdout_days=182)
    rows = sweep.by_fold(returns_of(bars.weekly(spark, sf)).where("ret is not null"), sweep.folds_table(spark, plan))
    return tidy(rows.groupBy("fold", "segment", "symbol").agg(F.count("*").alias("n"), F.avg("ret").alias("mean"), F.min("ts").alias("first_ts"), F.max("ts").alias("last_ts")))


def a_overlaps(spark: SparkSession, sf: str) -> DataFrame:
    """Stretches of each customer's orders, by year, that meet those of any year's deliveries. None leaves its year, so years are the pieces and each is one row."""
    o = spark.read.parquet(f"{sf}/orders.parquet")
    l = spark.read.parquet(f"{sf}/lineitem.parquet").join(o, F.col("l_orderkey") == F.col("o_orderkey"))  # noqa: E741
    span = lambda t, d: t.groupBy(F.col("o_custkey").alias("symbol"), F.year(d).alias("year")).agg(F.min(d).cast("timestamp").alias("start"), F.max(d).cast("timestamp").alias("end"))
    return tidy(reporting.overlaps(span(o, "o_orderdate"), span(l, "l_shipdate").drop("year"), "symbol", every="year"))


def j_benchmark(spark: SparkSession, sf: str) -> DataFrame:
    """The benchmark is a brand's weekly bars of even months from 1993 on; the curve has all its weeks, of some brands from before the first bar."""
    b = bars.weekly(spark, sf).withColumnRenamed("symbol", "key")
    bench = b.where("month(ts) % 2 = 0 and ts >= '1993-01-01'")
    return tidy(reporting.benchmark_returns(b.where("right(key, 1) < '3' or ts >= '1994-02-01'").select("key", "ts"), bench))


QUERIES = {f.__name__: f for f in (c_scores, g_rounds, g_brackets, g_records, g_signals, e_net_cap, e_net_caps, e_moments, e_capital, e_restricted, e_book_factors, e_leg_report, l_sessions, t_board, t_board_counts, t_pairs, t_recorded, p_plan, a_overlaps, j_benchmark)}

W = "partition by symbol order by ts"
# The side held, bar by bar: a state machine, where the operator takes running windows.
ROUNDS = f"""sg as (select *, {SIDES} as signal, row_number() over ({W}) as rn from rets),
st as (select symbol, rn, 0 as pos from sg where rn = 1 union all
  select s.symbol, s.rn, case p.signal when 'BUY' then 1 when 'SELL' then -1 when 'CLOSE_BUY' then least(pos, 0) when 'CLOSE_SELL' then greatest(pos, 0) else pos end from st join sg p on p.symbol = st.symbol and p.rn = st.rn join sg s on s.symbol = st.symbol and s.rn = st.rn + 1),
ch as (select sg.*, pos, coalesce(lag(pos) over (partition by sg.symbol order by sg.rn), 0) as was, lag(close) over (partition by sg.symbol order by sg.rn) as before from sg join st on sg.symbol = st.symbol and sg.rn = st.rn),
ends as (select symbol, max(rn) as z, arg_max(ts, rn) as zt, arg_max(close, rn) as zc from sg group by symbol),
opn as (select symbol, rn as a, ts as entry_time, open as entry_price, pos as d, before as reference from ch where pos <> 0 and pos <> was),
nxt as (select o.*, (select min(c.rn) from ch c where c.symbol = o.symbol and c.rn > o.a and c.pos <> c.was) as b from opn o),
tr as (select n.symbol, d, a, coalesce(b, z) as b, b is not null as own, case when d = 1 then 'BUY' else 'SELL' end as side, entry_time, entry_price, reference, coalesce(x.ts, zt) as exit_time, coalesce(x.open, zc) as exit_price, case when b is null then 'END_OF_PERIOD' else 'SIGNAL' end as exit_reason
  from nxt n join ends using (symbol) left join sg x on x.symbol = n.symbol and x.rn = n.b)"""
# Halves are rounded up as they are written in decimals, as Spark does.
TICK = lambda x: f"case when abs({x}) < 1 then round(({x})::varchar::decimal(30, 20), 4) else round(({x})::varchar::decimal(30, 20), 2) end::double"
BRACKETS = f"""lv as (select *, {TICK('reference * (1 - d * 0.3)')} as sl, {TICK('reference * (1 + d * 0.5)')} as tp from tr),
hb as (select lv.symbol, lv.a, s.rn, s.ts, s.open, case when d * s.open <= d * sl then 'S' when d * s.open >= d * tp * (1 + d * 0.002) then 'T' when own and s.rn = lv.b then null when d = 1 and s.low <= sl or d = -1 and s.high >= sl then 's' when d = 1 and s.high >= tp * 1.002 or d = -1 and s.low <= tp * 0.998 then 't' end as hit,
  sl, case when d = 1 then greatest(s.open, tp) else least(s.open, tp) end as tp from lv join sg s on s.symbol = lv.symbol and s.rn between lv.a and lv.b),
fh as (select symbol, a, arg_min(ts, rn) as ht, arg_min(case when lower(hit) = 's' then 'STOP_LOSS' else 'TAKE_PROFIT' end, rn) as hr, arg_min(case hit when 's' then sl when 't' then tp else open end, rn) as hp from hb where hit is not null group by symbol, a),
bk as (select tr.* replace (coalesce(ht, exit_time) as exit_time, coalesce(hp, exit_price) as exit_price, coalesce(hr, exit_reason) as exit_reason) from tr left join fh using (symbol, a))"""
SHOWN = f"symbol, side, epoch(entry_time)::bigint as entry_time, {r('entry_price')} as entry_price, {r('reference')} as reference, epoch(exit_time)::bigint as exit_time, {r('exit_price')} as exit_price, exit_reason"
SAMPLES = "sm as (select symbol, ts, case when day(ts) > 3 then high else 0 end as equity, close - open as net, high - low as gross, close, high, low, day(ts) as n from bars)"
CAPS = """sx as (select symbol, case when equity > 0 then abs(net) / equity end as x, case when equity > 0 then net / equity end as sx, case when equity > 0 then gross / equity end as g from sm),
ss as (select symbol, count(x) as samples, count(*) - count(x) as skipped, quantile_cont(x, 0.5) as median, quantile_cont(x, 0.9) as p90, quantile_cont(x, 0.95) as p95, quantile_cont(x, 0.99) as p99, max(x) as mx, avg(sx) as signed_mean, max(g) as gross_max from sx group by symbol),
cc as (select distinct symbol, mx, unnest([round(p95, 4), round(p95 * 1.25, 4), round(p95 * 1.5, 4), round(mx * 1.1, 4)]) as cap from ss where mx > 0),
cr as (select cc.symbol, cap, avg((x > cap)::int) as rate, any_value(mx) as mx from cc join sx on cc.symbol = sx.symbol where x is not null and cap > 0 group by cc.symbol, cap)"""
MOMENT = lambda m: f"""epoch({m}.ts)::bigint as {m}_ts, {r(f'{m}.e', 5)} as {m}_equity, {r(f'{m}.peak', 5)} as {m}_peak, {m}.n::int as {m}_open_positions, {r(f'100 * {m}.gross / {m}.close', 5)} as {m}_gross_pct, {r(f'100 * {m}.net / {m}.close', 5)} as {m}_net_pct, {r(f'100 * ({m}.peak - {m}.close) / {m}.peak', 5)} as {m}_drawdown_at_close_pct"""
FIRST = lambda m, e, pct: f"{m} as (select *, {e} as e, {pct} as pct from pk qualify row_number() over (partition by symbol order by {pct} desc, ts) = 1)"
DEFLATED = market.TRIALS.replace("families as", "df as (select *, case when ts % 7 <> 0 then oos_sharpe - n_trials_in_session / 10 end as dsr, kind in ('optimize', 'alpha', 'backtest') as ins from trials),\nfamilies as")
SQL = {
    "c_scores": f"""with {market.HOUR}, m as (select *, case when count(high) over p = 5 then max(high) over p end as top, case when count(close) over w = 20 then avg(close) over w end as mean, case when count(close) over w = 20 then stddev_pop(close) over w end as dev from bars window p as ({W} rows between 5 preceding and 1 preceding), w as ({W} rows between 19 preceding and current row))
select epoch(ts)::bigint as ts, symbol, {r('coalesce(case when close > top and close > mean then (close - top) / nullif(top, 0) end, -1)')} as breakout, {r('coalesce(case when abs((close - mean) / nullif(dev, 0)) >= 1 then -(close - mean) / nullif(dev, 0) end, 0)')} as reversion from m""",
    "g_rounds": f"with recursive {market.HOUR}, {market.RETS}, {ROUNDS} select {SHOWN} from tr",
    "g_brackets": f"with recursive {market.HOUR}, {market.RETS}, {ROUNDS}, {BRACKETS} select {SHOWN} from bk",
    "g_records": f"""with recursive {market.HOUR}, {market.RETS}, {ROUNDS}, {BRACKETS}, z as (select bk.symbol, a, min(low) as l, max(high) as h from bk join sg s on s.symbol = bk.symbol and s.ts between entry_time and exit_time group by bk.symbol, a),
y as (select bk.*, floor(1e5 / entry_price)::bigint as size, least(l, entry_price) as l, greatest(h, entry_price) as h from bk join z using (symbol, a)), x as (select *, (exit_price - entry_price) * size * d as gross, 3e-4 * size * (entry_price + exit_price) as cost, 100 * (entry_price - l) / entry_price as dn, 100 * (h - entry_price) / entry_price as up from y)
select {SHOWN.replace(', 6)', ', 7)')}, size, {r('gross', 7)} as gross_pnl, {r('cost', 7)} as cost, {r('gross - cost', 7)} as pnl, {r('case when d = 1 then dn else up end', 7)} as mae_pct, {r('case when d = 1 then up else dn end', 7)} as mfe_pct from x""",
    "g_signals": f"""with {market.HOUR}, {market.RETS}, f as (select *, {SIDES} as signal, case when lead(close) over w is not null then coalesce(lead(close, 5) over w, last_value(close) over (partition by symbol order by ts rows between current row and 5 following)) end as later from rets window w as ({W})),
m as (select symbol, case when signal = 'SELL' then -100 else 100 end * (later / nullif(close, 0) - 1) as m from f where signal in ('BUY', 'SELL') and later is not null)
select symbol, count(*) as n_signals, {r('100 * avg((m > 0)::int)', 4)} as hit_rate, {r('avg(m)', 4)} as avg_return, {r(market.sharpe('m', 252), 4)} as sharpe, {r("case when -sum(least(m, 0)) = 0 then 'inf'::double else sum(greatest(m, 0)) / -sum(least(m, 0)) end", 4)} as profit_factor from m where m is not null group by symbol""",
    "e_net_cap": f"""with {market.WEEK}, {SAMPLES}, {CAPS}, b as (select symbol, min(cap) as cap from cr where rate = 0 group by symbol)
select symbol, samples, skipped, {', '.join(f'{r(c, 5)} as {c}' for c in ('median', 'p90', 'p95', 'p99'))}, {r('mx', 5)} as max, {r('signed_mean', 5)} as signed_mean, {r('gross_max', 5)} as gross_max, {r('cap', 5)} as recommended, samples < 30 as thin, mx <= 0 as no_tilt, coalesce(cap >= 1, false) as subsumed from ss left join b using (symbol) where samples > 0""",
    "e_net_caps": f"with {market.WEEK}, {SAMPLES}, {CAPS} select symbol, {r('cap', 5)} as cap, {r('rate', 5)} as binding_rate, cap >= mx as above_observed_max from cr",
    "e_moments": f"""with {market.WEEK}, {SAMPLES}, pk as (select *, max(close) over ({W} rows unbounded preceding) as peak, count(*) over (partition by symbol) as n_steps from sm),
{FIRST('adverse', 'low', '100 * (peak - low) / peak')}, {FIRST('favourable', 'high', '100 * (high - peak) / peak')}, {FIRST('closing', 'close', '100 * (peak - close) / peak')}
select symbol, adverse.n_steps, {r('adverse.pct', 5)} as adverse_pct, {r('favourable.pct', 5)} as favourable_pct, {r('closing.pct', 5)} as closing_pct, {r('adverse.pct - closing.pct', 5)} as understatement_pct, {', '.join(MOMENT(m) for m in ('adverse', 'favourable', 'closing'))} from adverse join favourable using (symbol) join closing using (symbol)""",
    "e_capital": f"""with {market.WEEK}, {market.RETS}, h as (select day(ts) as book, symbol, arg_max(close, ts) as price, avg(volume) as adv, stddev_samp(ret) as vol from rets group by 1, 2),
w as (select *, case when book <> 7 then 0.04 else 0 end as w, (book - 2)::double / 1e4 * case when book > 28 then 1e9 else 1 end as alpha from h),
s as (select book, max(alpha) as alpha, count(*) filter (where w <> 0 and price > 0 and vol is not null) as n, sum(w * 3.5 / 1e4) filter (where w <> 0 and price > 0 and vol is not null) as f, sum(0.3 * vol * sqrt(w / (price * adv)) * w) filter (where w <> 0 and price > 0 and vol is not null) as i from w group by book),
t as (select *, case when n = 0 then 'no_priced_holdings' when alpha <= 0 then 'no_edge' when alpha - 8 * (f + i * sqrt(1e3)) <= 0 then 'below_search_floor' when alpha - 8 * (f + i * 1e6) > 0 then 'above_search_ceiling' else 'measured' end as status from s)
select book::int as book, {r("case when status = 'measured' then ((alpha / 8 - f) / i) ** 2 end", 2)} as capital, status from t""",
    "e_restricted": f"""with {BOOKS}, cv as (select distinct n_name as symbol from supplier join nation on s_nationkey = n_nationkey where s_acctbal > 9000), k as (select *, symbol in (select symbol from cv) as c, sum(weight) over (partition by book) as total, sum(case when symbol in (select symbol from cv) then weight end) over (partition by book) as kept from bks)
select book, symbol, {r('weight / kept')} as weight, {r('kept / total')} as coverage from k where c and kept > 0""",
    "e_book_factors": f"""with {BOOKS}, s as (select n_name as symbol, avg(s_acctbal::double) as owned, count(*) as many from supplier join nation on s_nationkey = n_nationkey group by 1), x as (select book, symbol, weight / 1e6 as w, unnest(['owned', 'many']) as factor, unnest([owned, many]) as v from bks join s using (symbol)),
b as (select n_regionkey as book, count(*) as n, avg((coalesce(weight / 1e6, 0) <= 1e-9)::int) as binding from nation left join bks on n_name = symbol group by 1) select book, factor, {r('sum(w * v)', 3)} as exposure, any_value(n) as n, {r('any_value(binding)', 3)} as binding from x join b using (book) group by book, factor""",
    "e_leg_report": f"""with {market.TRADES}, {market.WEEK}, {market.RETS}, {market.BENCH}, w as (select case when l_linestatus = 'F' then 'BUY' else 'SELL' end as side, date_trunc('week', l_shipdate)::timestamp as ts, sum(l_extendedprice::double * (l_discount::double - 0.05)) as x from lineitem group by 1, 2),
c as (select side, ts, sum(x) over (partition by side order by ts) / 1e7 as v from w), s as (select c.*, v - lag(v) over (partition by side order by ts) as step, (1 + v) / max(1 + v) over (partition by side order by ts) - 1 as dd, bench from c left join bench using (ts)),
h as (select side, arg_max(v, ts) as v, stddev_samp(step) as sd, min(dd) as dd, covar_samp(step, bench) / var_samp(case when step is not null then bench end) as beta, corr(step, bench) as c from s group by side), t as (select side, count(*) as trades, sum(pnl) as pnl, sum(cost) as cost from trades group by side)
select side, trades, {r('pnl', 3)} as pnl, {r('cost', 3)} as cost, {r('100 * v', 3)} as return_pct, {r('100 * sd', 3)} as volatility_pct, {r('100 * abs(dd)', 3)} as max_drawdown_pct, {r('beta', 3)} as beta, {r('c', 3)} as benchmark_correlation from h join t using (side)""",
    "l_sessions": """with e as (select user_id, event_id as seq, lead(event_id) over (partition by user_id order by event_id) as up from events where event_type = 'view') select user_id, seq, (select min(event_id) from events o where o.user_id = e.user_id and event_type = 'purchase' and event_id > seq and (up is null or event_id < up)) as outcome_seq from e""",
    "t_board": f"with {DEFLATED}, k as (select *, row_number() over (order by dsr desc, id)::int as rank from df where not ins and contaminated_at is null and dsr is not null) select id, strategy, {r('dsr')} as deflated_sharpe, rank, n_tried as family_n_trials from k left join families using (strategy, universe_hash, accounting) where rank <= 25",
    "t_board_counts": f"""with {DEFLATED}, b as (select df.*, m as rank_by, a as all_kinds, case m when 'dsr' then dsr else oos_sharpe end as v, a or not ins as shown from df, (values ('dsr', true), ('dsr', false), ('sharpe', true), ('sharpe', false)) o(m, a))
select rank_by, all_kinds, count(*) filter (where shown and contaminated_at is null and v is not null) as eligible, count(*) filter (where not shown) as in_sample_excluded, count(*) filter (where shown and contaminated_at is not null) as contaminated_excluded, count(*) filter (where shown and contaminated_at is null and v is null) as unranked_excluded from b group by 1, 2""",
    "t_pairs": f"""with {market.WEEK}, {market.RETS}, n as (select distinct symbol as id, left(symbol, -1) as maker, "right"(symbol, 1)::int as k from rets), t as (select *, case when k % 2 = 0 or k = 1 then 'out' when k = 3 then 'in' end as basis, case when k = 4 then 2 else 1 end as acc from n),
p as (select a.maker, a.id as a, b.id as b, a.acc = b.acc as comparable, a.basis is distinct from b.basis as unlike_basis, case when a.k = 5 or b.k = 5 then 'no_series' when a.acc <> b.acc then 'accounting' end as why from t a join t b on a.maker = b.maker and a.id < b.id),
s as (select p.a, p.b, count(*) as n, min(x.ts) as f, max(x.ts) as l, corr(x.ret, y.ret) as c, {market.flat('x.ret')} or {market.flat('y.ret')} as flat from p join rets x on x.symbol = p.a join rets y on y.symbol = p.b and x.ts = y.ts where why is null and x.ret is not null and y.ret is not null group by 1, 2),
q as (select p.*, coalesce(n, 0) as n, f, l, c, coalesce(why, case when coalesce(n, 0) < 60 then 'overlap' when flat then 'flat' end) as reason from p left join s using (a, b)), z as (select *, case when reason is null then c end as r, atanh(case when reason is null then c end) as z, 1.959963984540054 / sqrt(nullif(greatest(n - 3, 0), 0)) as h from q)
select maker, a, b, case when reason is null then 'compared' else 'refused' end as status, reason, n as overlap, epoch(f)::bigint as first_ts, epoch(l)::bigint as last_ts, {r('r')} as corr, {r('(exp(2 * (z - h)) - 1) / (exp(2 * (z - h)) + 1)')} as low, {r('(exp(2 * (z + h)) - 1) / (exp(2 * (z + h)) + 1)')} as high, comparable, unlike_basis from z""",
    "t_recorded": f"with {market.HOUR}, {market.RETS} select symbol as trial_id, epoch(ts)::bigint as ts, {r("case when symbol > 'e' then 2 * ret else ret end")} as ret from rets where symbol <= 'e' or hour(ts) < 12",
    "p_plan": f"""with {market.WEEK}, {market.RETS}, c as (select timestamp '1993-01-04' as a, timestamp '1998-01-05' - interval 182 day as z), d as (select *, (date_diff('day', a, z) - 7) // 6 as t from c), k as (select a, z, t, unnest(range(0, 5)) as k from d),
plan as (select k as fold, 'is' as segment, a as s, a + to_days(((k + 1) * t)::int) as e from k union all select k, 'oos', a + to_days(((k + 1) * t + 7)::int), a + to_days(((k + 2) * t + 7)::int) from k union all select null, 'holdout', z, z + interval 182 day from c)
select fold::int as fold, segment, symbol, count(*) as n, {r('avg(ret)')} as mean, epoch(min(ts))::bigint as first_ts, epoch(max(ts))::bigint as last_ts from rets join plan on ts >= s and ts < e where ret is not null group by 1, 2, 3""",
    "a_overlaps": """with o as (select o_custkey as symbol, year(o_orderdate) as year, min(o_orderdate)::timestamp as s, max(o_orderdate)::timestamp as e from orders group by 1, 2), l as (select o_custkey as symbol, min(l_shipdate)::timestamp as s, max(l_shipdate)::timestamp as e from lineitem join orders on l_orderkey = o_orderkey group by 1, year(l_shipdate))
select o.symbol, year::int as year, epoch(o.s)::bigint as start, epoch(o.e)::bigint as "end", epoch(l.s)::bigint as r_start, epoch(l.e)::bigint as r_end, epoch(greatest(o.s, l.s))::bigint as from_ts, epoch(least(o.e, l.e))::bigint as to_ts from o join l on o.symbol = l.symbol and o.s < o.e and l.s < l.e and greatest(o.s, l.s) < least(o.e, l.e)""",
    "j_benchmark": f"""with {market.WEEK}, b as (select * from bars where month(ts) % 2 = 0 and ts >= timestamp '1993-01-01'), t as (select symbol, ts, row_number() over ({W}) - 1 as step from bars where "right"(symbol, 1) < '3' or ts >= timestamp '1994-02-01'),
g as (select t.*, (select arg_max(close, b.ts) from b where b.symbol = t.symbol and b.ts <= t.ts) as c, o.open as o, o.close as oc, (select min(ts) from b where b.symbol = t.symbol) as begin from t left join b o on o.symbol = t.symbol and o.ts = t.ts where step > 0),
h as (select *, case when step = 1 then case when begin < ts and o > 0 then oc / o - 1 end else c / nullif(lag(c) over ({W}), 0) - 1 end as ret from g), k as (select *, count(case when step > 1 then ret end) over (partition by symbol) as n from h where begin is not null)
select symbol as key, step::int as step, epoch(ts)::bigint as ts, {r('ret')} as ret from k where n >= 2""",
}
