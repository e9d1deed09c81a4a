"""Registered queries of scanners, streams, walk-forward, execution, coverage and the trial store, each with its DuckDB SQL."""

from __future__ import annotations

from datetime import datetime

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from ..functions import labels
from ..operators import execution, scanners, studies, timeseries, trades, trials, walkforward
from ..operators import sweep as sweeps
from ..sources import bars, coverage
from ..streaming import signals
from .queries import DAY, EXTRACTED, FETCHES, GAPS, HELD, HOUR, ISLANDS, LEDGER, RETS, TRIALS, WEEK, fetches, held_bars, ledger_table, r, requests, returns_of, tidy, trial_table

W = "partition by symbol order by ts"

# Scanners and scores.


def g_liquidity(spark: SparkSession, sf: str) -> DataFrame:
    return tidy(scanners.liquidity_scan(bars.weekly(spark, sf), least=5e4).select("ts", "symbol", "avg_dollar_volume", "liquidity_trend", "signal", "strength"))


LIQUID = """dv as (select *, case when count(*) over a = 20 then avg(close * volume) over a end as adv, case when count(*) over b = 5 then avg(close * volume) over b end as rv
  from bars window a as (partition by symbol order by ts rows between 19 preceding and current row), b as (partition by symbol order by ts rows between 4 preceding and current row)),
liquid as (select *, coalesce(adv >= 5e4 and rv / nullif(adv, 0) >= 0.75, false) as good from dv)"""


def g_universe(spark: SparkSession, sf: str) -> DataFrame:
    """Names flagged on the last day, and all names where none is."""
    found = timeseries.latest(scanners.liquidity_scan(bars.weekly(spark, sf), least=5e4)).where("signal = 'BUY'")
    everyone = bars.weekly(spark, sf).select("symbol").distinct()
    some = scanners.resolved_universe(found, everyone).withColumn("asked", F.lit("liquid"))
    return some.unionAll(scanners.resolved_universe(found.where("strength > 1e9"), everyone).withColumn("asked", F.lit("nothing")))


def g_scores(spark: SparkSession, sf: str) -> DataFrame:
    b = bars.weekly(spark, sf)
    scan = scanners.liquidity_scan(b, least=5e4)
    strength = scanners.scanner_score(scan).withColumnRenamed("score", "strength")
    side = scanners.signal_score(scan).withColumnRenamed("score", "side")
    return tidy(scanners.last_score(returns_of(b), "ret").join(strength, "symbol").join(side, "symbol"), 4)


def g_clock(spark: SparkSession, sf: str) -> DataFrame:
    """The liquidity scan passes; a score against the mean of all bars reads the future and fails."""
    week = bars.weekly(spark, sf)
    at = "1995-06-05 00:00:00"
    fair = scanners.clock_probe(lambda b: bars.as_of(scanners.liquidity_scan(b, least=5e4).select("ts", "symbol", "signal", F.round("strength", 6).alias("strength")), at), week, at)
    means = lambda b: b.join(b.groupBy("symbol").agg(F.avg("close").alias("m")), "symbol")
    unfair = scanners.clock_probe(lambda b: bars.as_of(means(b).select("ts", "symbol", F.round(F.col("close") - F.col("m"), 6).alias("score")), at), week, at)
    return fair.withColumn("scan", F.lit("fair")).unionAll(unfair.withColumn("scan", F.lit("unfair")))


# Signals.

BANDS = signals.Bands(0.2, -0.05, -0.2, 0.05)


def w_signals(spark: SparkSession, sf: str) -> DataFrame:
    return tidy(signals.walk(returns_of(bars.hourly(spark, sf)), "ret", BANDS))


def w_warm(spark: SparkSession, sf: str) -> DataFrame:
    daily = bars.daily(spark, sf)
    return signals.warm_coverage(daily.where("ts >= '2024-01-20'"), daily, 5)


def w_fills(spark: SparkSession, sf: str) -> DataFrame:
    return tidy(signals.filled(ledger_table(spark, sf).where("event = 'fill'").withColumn("order_id", F.concat_ws("-", "symbol", "order_id"))))


# Coverage.


def a_forget(spark: SparkSession, sf: str) -> DataFrame:
    """Coverage after every third symbol was forgotten and every sixth fetched anew without a bar."""
    f = fetches(spark, sf)
    k = F.col("symbol").cast("int")
    done = f.where(k % 6 == 0).select("symbol", F.lit("2024-01-10").cast("timestamp").alias("start"), F.lit("2024-01-12").cast("timestamp").alias("end"), F.lit("2024-02-01").cast("timestamp").alias("fetched_at")).distinct()
    return tidy(coverage.record_fetch(coverage.forget(f, f.where(k % 3 == 0)), done))


def a_warm(spark: SparkSession, sf: str) -> DataFrame:
    f = fetches(spark, sf)
    return coverage.warm_summary(f, requests(f))


def a_refresh(spark: SparkSession, sf: str) -> DataFrame:
    f = fetches(spark, sf)
    k = F.col("symbol").cast("int")
    asked = requests(f).select("symbol", F.when(k % 2 == 0, F.col("start")).alias("start"), F.when(k % 3 == 0, F.col("end")).alias("end"))
    unknown = asked.withColumn("symbol", F.concat("symbol", F.lit("x")))
    return tidy(coverage.refresh_windows(f, asked.unionByName(unknown)))


def a_clip(spark: SparkSession, sf: str) -> DataFrame:
    f = fetches(spark, sf)
    return tidy(coverage.clipped(bars.daily(spark, sf).withColumn("ts", F.col("ts") + F.expr("interval 12 hours")), coverage.gaps(f, requests(f))).select("ts", "symbol", "close"))


# Orders, execution and the book.


def orders_ledger(spark: SparkSession, sf: str) -> DataFrame:
    """Events as a ledger: a view decides, a click submits, a purchase fills; ids by user and slot."""
    e = spark.read.parquet(f"{sf}/events.parquet")
    slot = F.concat_ws("-", "user_id", F.col("event_id") % 8)
    ours = ledger_table(spark, sf).drop("order_id").join(e.select(F.col("event_id").alias("seq"), F.col("ts").cast("timestamp").alias("ts"), "value", slot.alias("slot")), "seq")
    k = F.col("seq") % 5
    return ours.select(
        "seq", "event", "ts", "symbol", "side", F.when(F.col("event") == "intent", F.col("qty") + 20).otherwise(F.col("qty")).alias("qty"), "basis", F.col("slot").alias("order_id"), F.col("slot").alias("decision_id"),
        (F.col("value") + 1).alias("fill_price"), (F.col("value") + 2).alias("reference_price"), (k == 0).alias("allowed"),
        F.when(k == 1, "net_exposure").alias("reason_code"), F.when(k == 2, F.concat(F.lit("book is full: "), "seq")).when(k == 3, "market is closed").when(k == 1, "net exposure capped: 1 of 2").alias("reason"),
    )


ORDERS = """o as (select l.seq, event, e.ts, l.symbol, side, case when event = 'intent' then qty + 20 else qty end as qty, basis, e.user_id || '-' || (e.event_id % 8) as order_id,
  value + 1 as fill_price, value + 2 as reference_price, l.seq % 5 as k from ledger l join events e on l.seq = e.event_id),
intents as (select * from o where event = 'intent' qualify row_number() over (partition by order_id order by seq desc) = 1),
decided as (select order_id, ts from o where event = 'decision' qualify row_number() over (partition by order_id order by seq desc) = 1),
marks as (select *, max(seq) filter (where basis <> 'incremental') over (partition by order_id) as mark from o where event = 'fill'),
got as (select order_id, coalesce(sum(qty) filter (where mark is null or seq >= mark), 0) as filled_qty, count(*) as n_fills, arg_max(fill_price, seq) as price, arg_max(ts, seq) as filled_at from marks group by order_id),
life as (select i.order_id, i.symbol, i.side, i.qty as submitted_qty, coalesce(g.filled_qty, 0) as filled_qty, i.reference_price, g.price as fill_price,
  case when i.side = 'buy' then 1 else -1 end * (g.price - i.reference_price) / nullif(i.reference_price, 0) * 1e4 as slip, coalesce(d.ts, i.ts) as decided_at, i.ts as submitted_at, g.filled_at,
  epoch_us(g.filled_at) // 1000 - epoch_us(coalesce(d.ts, i.ts)) // 1000 as ms, coalesce(n_fills, 0) as n_fills from intents i left join decided d on i.order_id = d.order_id left join got g on i.order_id = g.order_id)"""


def l_lifecycles(spark: SparkSession, sf: str) -> DataFrame:
    return tidy(execution.lifecycles(orders_ledger(spark, sf)).drop("decision_id", "reason"), 4)


def l_execution(spark: SparkSession, sf: str) -> DataFrame:
    return tidy(execution.execution_report(execution.lifecycles(orders_ledger(spark, sf)), ("side",)), 3)


def l_declines(spark: SparkSession, sf: str) -> DataFrame:
    return execution.declines(orders_ledger(spark, sf))


def yearly_books(spark: SparkSession, sf: str) -> DataFrame:
    l = spark.read.parquet(f"{sf}/lineitem.parquet")  # noqa: E741
    price, off = F.col("l_extendedprice").cast("double"), F.col("l_discount").cast("double")
    outcome = F.when((F.col("l_returnflag") == "R") & (F.col("l_linenumber") == 7), "rounded").when(F.col("l_quantity") < 3, "too_small").otherwise("filled")
    orders = l.select(F.year("l_shipdate").alias("year"), price.alias("requested"), F.when(outcome == "filled", price * (1 - off)).otherwise(0.0).alias("filled"), outcome.alias("outcome"))
    y = F.col("year")
    return studies.fill_gaps(orders, ["year"]).select("year", "drag_pct", "unfillable_pct", (y % 3).alias("max_positions"), F.lit(25).alias("universe"), ((y % 4) * 100.0 - 100).alias("gross_profit"), F.lit(45.0).alias("cost"))


def l_checks(spark: SparkSession, sf: str) -> DataFrame:
    return tidy(execution.execution_checks(yearly_books(spark, sf), ["year"]), 4)


CHECKS = """g as (select year(l_shipdate) as year, l_extendedprice::double as asked, case when l_returnflag = 'R' and l_linenumber = 7 then 'rounded' when l_quantity < 3 then 'too_small' else 'filled' end as outcome, l_discount::double as off from lineitem),
b as (select year, (1 - sum(case when outcome = 'filled' then asked * (1 - off) else 0 end) / sum(asked)) * 100 as drag, count(*) filter (where outcome <> 'filled') * 100.0 / count(*) as un from g group by year),
checks as (select year, 'rounding_drag' as "check", drag as value, 10.0 as threshold, drag <= 10 as passed from b union all select year, 'unfillable_entries', un, 5.0, un <= 5 from b
  union all select year, 'book_breadth', year % 3, 2.0, year % 3 >= 2 from b union all select year, 'cost_share_of_gross', 4500.0 / ((year % 4) * 100 - 100), 40.0, 4500.0 / ((year % 4) * 100 - 100) <= 40 from b where year % 4 > 1)"""


def l_verdict(spark: SparkSession, sf: str) -> DataFrame:
    found = execution.execution_checks(yearly_books(spark, sf), ["year"]).withColumn("direction", F.lit("<="))
    asked = execution.prerequisites(found.where("check <> 'book_breadth'").withColumn("value", F.when(F.col("check") != "cost_share_of_gross", F.col("value"))))
    return execution.verdict(asked, ["year"])


def book_positions(spark: SparkSession, sf: str) -> DataFrame:
    t = trades.from_signals(held_bars(spark, sf))
    side = F.when(F.hour("entry_time") % 2 == 0, "BUY").otherwise("SELL")
    return t.select("symbol", side.alias("side"), F.lit(10.0).alias("size"), "entry_price", (F.col("entry_price") * 10).alias("notional"), (F.col("entry_price") * 0.2).alias("risk"), "entry_time", "exit_time")


def l_marks(spark: SparkSession, sf: str) -> DataFrame:
    prices = execution.timeline(bars.hourly(spark, sf), ["close"])
    return tidy(execution.marked(book_positions(spark, sf), prices, 1000.0), 3)


def s_timeline(spark: SparkSession, sf: str) -> DataFrame:
    return tidy(execution.timeline(bars.hourly(spark, sf), ["close"]))


ALIGNED = """grid as (select t.ts, s.symbol from (select distinct ts from bars) t join (select symbol, min(ts) as a from bars group by symbol) s on t.ts >= s.a),
aligned as (select g.ts, g.symbol, b.ts is not null as fresh, last_value(b.close ignore nulls) over (partition by g.symbol order by g.ts) as close from grid g left join bars b on g.ts = b.ts and g.symbol = b.symbol)"""


def g_stress(spark: SparkSession, sf: str) -> DataFrame:
    t = trades.from_signals(held_bars(spark, sf)).withColumn("days", (F.unix_timestamp("exit_time") - F.unix_timestamp("entry_time")) / 86400)
    costed = t.select("symbol", (F.col("pnl_pct") * 100).alias("gross"), F.lit(0.9).alias("turnover_cost"), (F.col("days") * 0.5).alias("carry_cost"))
    return tidy(execution.stressed(costed, [1.0, 2.0, 3.0, 5.0]))


# Walk-forward.

START, END = datetime(1993, 1, 4), datetime(1998, 1, 5)
CONFIGS = [(f, s) for f in (4, 8) for s in (12, 26)]


def plan_of(spark: SparkSession) -> DataFrame:
    return sweeps.folds(spark, START, END, train_days=364, test_days=182, embargo_days=7)


def fold_table(spark: SparkSession, sf: str) -> DataFrame:
    return walkforward.fold_results(walkforward.crossover_returns(bars.weekly(spark, sf), CONFIGS), plan_of(spark), ["fast", "slow"], ppy=52.0)


def p_walkforward(spark: SparkSession, sf: str) -> DataFrame:
    return tidy(fold_table(spark, sf), 5)


def p_summary(spark: SparkSession, sf: str) -> DataFrame:
    return tidy(walkforward.fold_summary(fold_table(spark, sf)), 5)


def p_gates(spark: SparkSession, sf: str) -> DataFrame:
    return tidy(walkforward.gates(walkforward.fold_summary(fold_table(spark, sf)), {"min_oos_trades": 10.0}), 5)


def p_sensitivity(spark: SparkSession, sf: str) -> DataFrame:
    best = {"fast": 8, "slow": 26}
    moved = walkforward.perturbed(best, {"fast": (2, 10), "slow": (12, 30)})
    scores = walkforward.scored(walkforward.crossover_returns(bars.weekly(spark, sf), sorted({(c["fast"], c["slow"]) for c in moved})), ["fast", "slow"], 52.0)
    return tidy(walkforward.sensitivity(scores, ["fast", "slow"], best), 5)


def p_shift(spark: SparkSession, sf: str) -> DataFrame:
    held = lambda b: trades.from_signals(returns_of(b).withColumn("held", timeseries.held_direction(F.col("ret"), 0.2, -0.2)))
    return scanners.shift_probe(held, bars.hourly(spark, sf).select("ts", "symbol", "open", "high", "low", "close", "volume"), digits=6)


def p_trades(spark: SparkSession, sf: str) -> DataFrame:
    """Trades of two halves of the names as one table."""
    t = trades.from_signals(held_bars(spark, sf))
    left, right = t.where("symbol < 'f'").drop("pnl_pct"), t.where("symbol >= 'f'")
    return tidy(walkforward.concat_trades([left, right]))


# The trial store and labels.


def t_listing(spark: SparkSession, sf: str) -> DataFrame:
    rows, _ = trials.listing(trial_table(spark, sf), sort="oos_sharpe", min_sharpe=1.0, until=F.lit(5000), contaminated=False)
    return tidy(rows.drop("contamination_reason", "contaminated_at"))


def t_counts(spark: SparkSession, sf: str) -> DataFrame:
    t = trial_table(spark, sf).withColumn("ts", F.when(F.col("ts") % 7 != 0, F.col("ts")))
    by = lambda name, **how: trials.listing(t, **how)[1].withColumn("asked", F.lit(name))
    return by("history").unionAll(by("ranking", sort="oos_sharpe")).unionAll(by("dated", since=F.lit(40), before=F.lit(900))).unionAll(by("in_sample", sort="oos_sharpe", kinds=["backtest"]))


def t_resolve(spark: SparkSession, sf: str) -> DataFrame:
    t = trial_table(spark, sf).select(F.sha2("id", 256).alias("id"), F.col("id").cast("int").alias("k"))
    refs = t.select(F.when(F.col("k") % 5 == 0, F.col("id")).when(F.col("k") % 5 == 1, F.substring("id", 1, 3)).otherwise(F.substring("id", 1, 4)).alias("ref"))
    return trials.resolved(t.select("id"), refs)


def t_detail(spark: SparkSession, sf: str) -> DataFrame:
    o = spark.read.parquet(f"{sf}/orders.parquet")
    rets = o.select(F.col("o_custkey").cast("string").alias("trial_id"), F.unix_date(F.col("o_orderdate").cast("date")).alias("ts"))
    held = o.where("o_orderstatus = 'F'").select(F.col("o_custkey").cast("string").alias("trial_id"), F.col("o_orderkey").cast("string").alias("symbol"), (F.col("o_totalprice").cast("double") / 1e6).alias("weight"))
    return tidy(trials.detail(trial_table(spark, sf), rets, held, held.where("weight > 0.1")).drop("contamination_reason", "contaminated_at", "n_trials_in_session"), 5)


def t_status(spark: SparkSession, sf: str) -> DataFrame:
    t = trial_table(spark, sf)
    tools = t.select(F.when(F.col("ts") % 3 == 0, F.concat(F.lit("trial:"), "kind")).when(F.col("ts") % 3 == 1, "research:trial").otherwise("session_start").alias("tool"))
    return trials.store_status(t.withColumn("strategy", F.when(F.col("ts") % 100 != 0, F.col("strategy"))), tools)


def b_labels(spark: SparkSession, sf: str) -> DataFrame:
    """Labels of each trial: its basis, the zeros that stand for nothing, and the fault of its window."""
    t = trial_table(spark, sf)
    k = F.col("ts")
    stood = labels.unmeasured(["alpha", "beta", "treynor_ratio", "sharpe_ratio"], k % 3 != 0, k % 4 != 0)
    names = F.concat_ws(",", F.transform(stood, lambda m: m["metric"]))
    return t.select("id", labels.sharpe_basis(F.col("kind")).alias("basis"), labels.in_sample(F.col("kind")).alias("in_sample"), names.alias("unmeasured"), labels.window_fault(k % 10, k % 7, F.lit(5)).alias("fault"))


SWEEP = f"""m as (select *, {', '.join(f'case when count(close) over w{n} = {n} then avg(close) over w{n} end as m{n}' for n in (4, 8, 12, 26))} from rets window {', '.join(f'w{n} as ({W} rows between {n - 1} preceding and current row)' for n in (4, 8, 12, 26))}),
c as ({' union all '.join(f'select {f} as fast, {s} as slow, symbol, ts, ret, lag((m{f} > m{s})::int) over ({W}) as held, lag((m{f} > m{s})::int, 2) over ({W}) as before from m' for f in (4, 8) for s in (12, 26))})"""
FOLDS = f"""plan as (select k as fold, unnest([{{'segment': 'is', 's': a, 'e': a + interval 364 day}}, {{'segment': 'oos', 's': a + interval 371 day, 'e': a + interval 553 day}}]) as p from (select k::int as k, timestamp '1993-01-04' + to_days((182 * k)::int) as a from range(50) t(k)) where a + interval 553 day <= timestamp '1998-01-05'),
{SWEEP},
k as (select fold, p.segment as segment, fast, slow, ts, avg(ret * held) as x, count(*) filter (where held = 1 and coalesce(before, 0) = 0) as entries, avg(ret) as b from c join plan on ts >= p.s and ts < p.e where ret is not null and held is not null group by all),
lv as (select *, sum(ln(1 + x)) over (partition by fold, segment, fast, slow order by ts) as lev from k), pk as (select *, greatest(max(lev) over (partition by fold, segment, fast, slow order by ts), 0) as pkk from lv),
sc as (select fold, segment, fast, slow, count(*) as n, exp(sum(ln(1 + x))) - 1 as total, case when stddev_samp(x) > 1e-12 then avg(x) / stddev_samp(x) * sqrt(52) else 0 end as sharpe,
  case when sum(least(x, 0)) < 0 then sum(greatest(x, 0)) / -sum(least(x, 0)) when sum(greatest(x, 0)) > 0 then 'infinity'::double else 0 end as profit_factor,
  max(1 - exp(lev - pkk)) as max_drawdown, sum(entries)::bigint as trades, exp(sum(ln(1 + b))) - 1 as benchmark from pk group by all),
best as (select * from sc where segment = 'is' qualify row_number() over (partition by fold order by sharpe desc, fast, slow) = 1),
ft as (select i.fold, i.fast, i.slow, {', '.join(f'{t}.{c} as {n}_{c}' for t, n in (('i', 'is'), ('o', 'oos')) for c in ('n', 'total', 'sharpe', 'profit_factor', 'max_drawdown', 'trades', 'benchmark'))}
  from best i left join sc o on i.fold = o.fold and i.fast = o.fast and i.slow = o.slow and o.segment = 'oos')"""
SUMMARY = """su as (select count(*) as folds, median(oos_sharpe) as oos_sharpe, median(oos_profit_factor) as oos_profit_factor, median(oos_max_drawdown) as oos_drawdown, median(is_max_drawdown) as is_drawdown,
  coalesce(median(oos_sharpe / is_sharpe) filter (where is_sharpe > 0), 0) as median_efficiency, case when avg(is_sharpe) > 0 then avg(oos_sharpe) / avg(is_sharpe) else 0 end as efficiency,
  avg(is_sharpe) - avg(oos_sharpe) as degradation_sharpe, avg(is_profit_factor) filter (where isfinite(is_profit_factor)) - avg(oos_profit_factor) filter (where isfinite(oos_profit_factor)) as degradation_profit_factor, avg(is_max_drawdown) - avg(oos_max_drawdown) as degradation_max_drawdown, avg(is_total) - avg(oos_total) as degradation_total,
  median(oos_total - oos_benchmark) as median_excess, sum(oos_trades)::bigint as oos_trades from ft)"""


def listed(columns: str, digits: int = 6) -> str:
    return ", ".join(f"{r(c, digits)} as {c}" for c in columns.split())


TRADE = f"with {HOUR}, {RETS}, {HELD}, {EXTRACTED}, tp as (select *, exit_price / nullif(entry_price, 0) - 1 as pnl from tr)"
KINDS = "case kind when 'walkforward' then 'out-of-sample, aggregate over folds' when 'research' then 'out-of-sample, median fold' when 'backtest' then 'full window, in-sample' end"

SQL: dict[str, str] = {
    "g_liquidity": f"with {WEEK}, {LIQUID} select epoch(ts)::bigint as ts, symbol, {r('adv')} as avg_dollar_volume, {r('rv / nullif(adv, 0)')} as liquidity_trend, case when good then 'BUY' else '' end as signal, {r('case when good then adv / 5e4 else 0 end')} as strength from liquid",
    "g_universe": f"""with {WEEK}, {LIQUID}, l as (select symbol, arg_max(good, ts) as good from liquid group by symbol)
select symbol, 'liquid' as asked from l where good or not (select bool_or(good) from l) union all select symbol, 'nothing' from l""",
    "g_scores": f"""with {WEEK}, {RETS}, {LIQUID}, s as (select symbol, arg_max(case when good then adv / 5e4 else 0 end, ts) as strength, arg_max(good::int, ts) as side from liquid group by symbol)
select r.symbol, {r('coalesce(arg_max_null(r.ret, r.ts), 0)', 4)} as score, {r('any_value(s.strength)', 4)} as strength, any_value(s.side)::double as side from rets r join s on r.symbol = s.symbol group by r.symbol""",
    "g_clock": f"""with {WEEK}, n as (select count(*) as n from bars where ts <= timestamp '1995-06-05'), f as (select symbol, avg(close) as a, avg(close) filter (where ts <= timestamp '1995-06-05') as c from bars group by symbol),
q as (select count(*) filter (where round(close - a, 6) <> round(close - c, 6)) as d from bars join f using (symbol) where ts <= timestamp '1995-06-05')
select 'fair' as scan, n as n_full, n as n_cut, 0 as n_changed, true as passed from n union all select 'unfair', n, n, 2 * d, d = 0 from n, q""",
    "w_signals": f"""with recursive {HOUR}, {RETS}, k as (select symbol, ts, ret, row_number() over ({W}) as k from rets),
s as (select symbol, ts, ret, k, 'HOLD' as signal, 0 as st from k where k = 1
  union all select symbol, ts, ret, k, case when ret is null or w = st then 'HOLD' when st = 0 then case w when 1 then 'BUY' else 'SELL' end when st = 1 then 'CLOSE_BUY' else 'CLOSE_SELL' end, case when ret is null or w = st then st when st = 0 then w else 0 end
  from (select k.symbol, k.ts, k.ret, k.k, s.st, case when s.st = 1 and k.ret > -0.05 then 1 when s.st = -1 and k.ret < 0.05 then -1 when k.ret > 0.2 then 1 when k.ret < -0.2 then -1 else 0 end as w from s join k on k.symbol = s.symbol and k.k = s.k + 1))
select symbol, epoch(ts)::bigint as ts, {r('ret')} as score, signal, st as direction from s""",
    "w_warm": f"with {DAY}, n as (select symbol, count(*) filter (where ts >= timestamp '2024-01-20') as n from bars group by symbol) select count(*) as asked, count(*) filter (where n > 0) as warmed, count(*) filter (where n >= 5) as sufficient from n",
    "w_fills": f"""with {LEDGER}, m as (select symbol || '-' || order_id as order_id, seq, basis, qty from ledger where event = 'fill'), a as (select *, max(seq) filter (where basis <> 'incremental') over (partition by order_id) as mark from m)
select order_id, {r('coalesce(sum(qty) filter (where mark is null or seq >= mark), 0)')} as filled_qty, count(*) as n_fills from a group by order_id""",
    "a_forget": f"""with {FETCHES}, kept as (select * from fetches where symbol::int % 3 <> 0 union all select distinct symbol, timestamp '2024-01-10', timestamp '2024-01-12', timestamp '2024-02-01' from fetches where symbol::int % 6 = 0)
select symbol, floor(epoch(start))::bigint as start, floor(epoch("end"))::bigint as "end", floor(epoch(fetched_at))::bigint as fetched_at from kept""",
    "a_warm": f"with {FETCHES}, {ISLANDS}, {GAPS}, n as (select symbol, count(*) as n from gaps where gap_start < gap_end group by symbol) select a.symbol, n is null as already_cached, coalesce(n, 0) as gaps_to_fetch from asked a left join n on a.symbol = n.symbol",
    "a_refresh": f"""with {FETCHES}, k as (select symbol, min(start) as s, max("end") as e from fetches group by symbol), q as (select symbol, case when symbol::int % 2 = 0 then timestamp '2024-01-05' end as a, case when symbol::int % 3 = 0 then timestamp '2024-01-25' end as d from k),
v as (select q.symbol, coalesce(a, s) as a, coalesce(d, e) as d from q join k on q.symbol = k.symbol union all select symbol || 'x', a, d from q)
select symbol, a is not null and d is not null as refreshed, floor(epoch(a))::bigint as start, floor(epoch(d))::bigint as "end" from v""",
    "a_clip": f"""with {DAY}, {FETCHES}, {ISLANDS}, {GAPS} select epoch(b.ts)::bigint + 43200 as ts, b.symbol, {r('b.close')} as close from bars b
where exists (select 1 from gaps g where g.symbol = b.symbol and gap_start < gap_end and b.ts + interval 12 hour between gap_start and gap_end)""",
    "l_lifecycles": f"""with {LEDGER}, {ORDERS} select order_id, symbol, side, {listed('submitted_qty filled_qty reference_price fill_price', 4)}, {r('slip', 4)} as slippage_bps,
  floor(epoch(decided_at))::bigint as decided_at, floor(epoch(submitted_at))::bigint as submitted_at, floor(epoch(filled_at))::bigint as filled_at, ms as decision_to_fill_ms, n_fills from life""",
    "l_execution": f"""with {LEDGER}, {ORDERS} select side, count(*) as n_orders, count(*) filter (where filled_qty > 0) as n_filled, count(*) filter (where not filled_qty > 0) as n_unfilled, count(*) filter (where filled_qty > 0 and filled_qty < submitted_qty - 1e-9) as n_short,
  count(*) filter (where n_fills > 1) as n_multi_print, count(slip) as n_measured, {r('avg(slip)', 3)} as mean_bps, {r('median(slip)', 3)} as median_bps, {r('max(slip)', 3)} as worst_bps, {r('min(slip)', 3)} as best_bps,
  first(symbol order by slip desc nulls last, symbol desc) as worst_symbol, count(*) filter (where ms >= 0) as n_timed, count(*) filter (where ms < 0) as n_clock_skew, {r('median(ms) filter (where ms >= 0)', 3)} as median_ms, max(ms) filter (where ms >= 0) as worst_ms,
  {r('sum(submitted_qty * reference_price)', 3)} as submitted_notional, {r('coalesce(sum(filled_qty * fill_price) filter (where filled_qty > 0), 0)', 3)} as filled_notional,
  {r('coalesce(sum(filled_qty * fill_price) filter (where filled_qty > 0), 0) / sum(submitted_qty * reference_price)', 3)} as fill_ratio from life group by side""",
    "l_declines": f"""with {LEDGER}, {ORDERS}, d as (select seq, case k when 1 then 'net_exposure' when 2 then 'book_full' when 3 then 'market is closed' else 'unknown' end as family,
  case k when 1 then 'net exposure capped: 1 of 2' when 2 then 'book is full: ' || seq when 3 then 'market is closed' end as reason from o where event = 'decision' and k <> 0)
select family, count(*) as n, first(reason order by seq) as example from d group by family""",
    "l_checks": f'with {CHECKS} select year, "check", {r("value", 4)} as value, {r("threshold", 4)} as threshold, passed from checks',
    "l_verdict": f"""with {CHECKS} select year, count(*) filter (where "check" <> 'cost_share_of_gross') as n_evaluated, count(*) as n_checks, bool_and(passed) filter (where "check" <> 'cost_share_of_gross') as passed,
  coalesce(string_agg("check", ', ' order by "check") filter (where not passed and "check" <> 'cost_share_of_gross'), '') as failed from checks where "check" <> 'book_breadth' group by year""",
    "s_timeline": f"with {HOUR}, {ALIGNED} select epoch(ts)::bigint as ts, symbol, fresh, {r('close')} as close from aligned",
    "l_marks": f"""{TRADE}, {ALIGNED}, p as (select *, case when hour(entry_time) % 2 = 0 then 1 else -1 end as sign from tr), h as (select a.ts, a.close, p.entry_price, p.sign from p join aligned a on a.symbol = p.symbol and a.ts >= entry_time and a.ts < exit_time)
select epoch(ts)::bigint as ts, count(*) as n, {r('sum(close * 10)', 3)} as gross, {r('sum(close * 10 * sign)', 3)} as net, {r('sum(entry_price * 10)', 3)} as reserved, {r('sum(entry_price * 0.2)', 3)} as open_risk,
  {r('sum(entry_price * 10 + (close - entry_price) * 10 * sign)', 3)} as market_value, {r('sum(entry_price * 10 + (close - entry_price) * 10 * sign) + 1000', 3)} as equity from h group by ts""",
    "g_stress": f"""{TRADE}, s as (select m, pnl * 100 - m * (0.9 + (epoch(exit_time) - epoch(entry_time)) / 86400 * 0.5) as net, m * (0.9 + (epoch(exit_time) - epoch(entry_time)) / 86400 * 0.5) as cost from tp, (select unnest([1.0, 2.0, 3.0, 5.0])::double as m)),
q as (select m, count(*) as n, sum(net) as net, sum(cost) as cost, avg(net) / nullif(stddev_samp(net), 0) as sharpe from s group by m)
select {r('m')} as multiple, n, {listed('net cost sharpe')}, bool_and(coalesce(net > 0 and sharpe > 0, false)) over (order by m) as survives from q""",
    "p_walkforward": f"with {WEEK}, {RETS}, {FOLDS} select fold, fast, slow, is_n, oos_n, is_trades, oos_trades, {listed(' '.join(f'{n}_{c}' for n in ('is', 'oos') for c in ('total', 'sharpe', 'profit_factor', 'max_drawdown', 'benchmark')), 5)} from ft",
    "p_summary": f"with {WEEK}, {RETS}, {FOLDS}, {SUMMARY} select folds, oos_trades, {listed('oos_sharpe oos_profit_factor oos_drawdown is_drawdown median_efficiency efficiency degradation_sharpe degradation_profit_factor degradation_max_drawdown degradation_total median_excess', 5)} from su",
    "p_gates": f"""with {WEEK}, {RETS}, {FOLDS}, {SUMMARY}, g as (select 'oos_sharpe' as "check", oos_sharpe as value, 1.2 as threshold, oos_sharpe >= 1.2 as passed from su
  union all select 'oos_profit_factor', oos_profit_factor, 1.3, oos_profit_factor >= 1.3 from su union all select 'walk_forward_efficiency', median_efficiency, 0.4, median_efficiency >= 0.4 or (oos_sharpe >= 1.2 and median_efficiency >= 0.3) from su
  union all select 'oos_drawdown_vs_is', oos_drawdown, 1.5 * is_drawdown, oos_trades > 0 and oos_drawdown <= 1.5 * is_drawdown from su union all select 'min_oos_trades', oos_trades, 10, oos_trades >= 10 from su)
select "check", {r('value', 5)} as value, {r('threshold', 5)} as threshold, passed, (select bool_and(passed) from g) as promotable from g""",
    "p_trades": f"{TRADE} select symbol, epoch(entry_time)::bigint as entry_time, {r('entry_price')} as entry_price, epoch(exit_time)::bigint as exit_time, {r('exit_price')} as exit_price, exit_reason, {r('''case when symbol >= 'f' then pnl end''')} as pnl_pct from tp",
    "t_listing": f"""with {TRIALS} select id, strategy, universe_hash, accounting, kind, n_trials_in_session, {r('oos_sharpe')} as oos_sharpe, ts, {KINDS} as sharpe_basis, false as in_sample from trials
where oos_sharpe >= 1 and ts <= 5000 and contaminated_at is null and kind not in ('alpha', 'backtest')""",
    "t_counts": f"""with {TRIALS}, t as (select kind, kind in ('alpha', 'backtest') as hid, case when ts % 7 <> 0 then ts end as ts from trials)
select 'history' as asked, count(*) as total, 0 as hidden, 0 as undated from t union all select 'ranking', count(*) filter (where not hid), count(*) filter (where hid), 0 from t
union all select 'dated', count(*) filter (where ts >= 40 and ts < 900), 0, count(*) filter (where ts is null) from t union all select 'in_sample', count(*) filter (where kind = 'backtest'), 0, 0 from t""",
    "t_resolve": f"""with {TRIALS}, t as (select sha256(id) as id, ts as k from trials), q as (select distinct case when k % 5 = 0 then id when k % 5 = 1 then left(id, 3) else left(id, 4) end as ref from t),
n as (select ref, count(*) as n, min(id) as one from q join (select distinct id from t) t on length(ref) >= 4 and starts_with(id, ref) group by ref)
select q.ref, case when length(q.ref) = 64 then q.ref when n = 1 then one end as id, coalesce(n, 0) as n from q left join n on q.ref = n.ref""",
    "t_detail": f"""with {TRIALS}, s as (select o_custkey::varchar as id, count(*) as periods, min(o_orderdate::date - date '1970-01-01')::int as first_ts, max(o_orderdate::date - date '1970-01-01')::int as last_ts from orders group by 1),
h as (select o_custkey::varchar as id, count(*) as n_weights, sum(o_totalprice::double / 1e6) as net_weight, count(*) filter (where o_totalprice::double / 1e6 > 0.1) as nt from orders where o_orderstatus = 'F' group by 1)
select t.id, strategy, universe_hash, accounting, kind, {r('oos_sharpe', 5)} as oos_sharpe, ts, {KINDS} as sharpe_basis, kind in ('alpha', 'backtest') as in_sample, periods, first_ts, last_ts, n_weights, {r('net_weight', 5)} as net_weight, nullif(nt, 0) as n_trades
from trials t left join s on t.id = s.id left join h on t.id = h.id""",
    "t_status": f"with {TRIALS} select count(*) as rows, count(*) filter (where ts % 100 = 0) as orphaned, count(contaminated_at) as contaminated, count(*) as lines, count(*) filter (where ts % 3 <> 2) as trial_lines, count(*) filter (where ts % 100 = 0) > 0 as drift from trials",
    "b_labels": f"""with {TRIALS} select id, {KINDS} as basis, kind in ('alpha', 'backtest') as in_sample, case when ts % 3 = 0 then 'alpha,beta,treynor_ratio' when ts % 4 = 0 then 'treynor_ratio' else '' end as unmeasured,
  case when ts % 10 = ts % 7 then 'empty' when ts % 7 < ts % 10 then 'reversed' when ts % 10 >= 5 then 'future' end as fault from trials""",
}

QUERIES = {
    f.__name__: f
    for f in (
        g_liquidity, g_universe, g_scores, g_clock, w_signals, w_warm, w_fills, a_forget, a_warm, a_refresh, a_clip, l_lifecycles, l_execution, l_declines, l_checks, l_verdict, l_marks, s_timeline, g_stress,
        p_walkforward, p_summary, p_gates, p_sensitivity, p_shift, p_trades, t_listing, t_counts, t_resolve, t_detail, t_status, b_labels,
    )
}
