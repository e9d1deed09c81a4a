"""Registered queries of alphas, information, scaling and attribution over all rebalances, each with its DuckDB SQL."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from ..operators import factors, research, risk, studies, timeseries
from ..sources import bars
from . import queries as market
from .queries import EXPOSED, EXPOSURES, RETS, WEEK, exposed, r, tidy, with_bench

HORIZON = 4


def panel(spark: SparkSession, sf: str) -> DataFrame:
    """Weekly reversal scores with trailing volatility, volume as exposure, and the residual return of the next four weeks."""
    b = with_bench(bars.weekly(spark, sf))
    rows = research.forward_residuals(b, HORIZON)
    return rows.withColumns({"score": -F.col("ret"), "vol": timeseries.rolling_std(F.col("ret"), 10), "exposure": F.col("volume")})


def scales(rows: DataFrame) -> DataFrame:
    return studies.case_scale(rows.select("ts", "symbol", "score", "vol"), "score", "vol")


def x_residuals(spark: SparkSession, sf: str) -> DataFrame:
    return tidy(panel(spark, sf).select("ts", "symbol", "beta", "fwd", "resid", "vol"), 5)


def x_alphas(spark: SparkSession, sf: str) -> DataFrame:
    return tidy(research.alpha_table(panel(spark, sf), 5))


def x_alphas2(spark: SparkSession, sf: str) -> DataFrame:
    rows = panel(spark, sf)
    return tidy(research.alphas(rows, scaling="case2", scale=scales(rows)).select("ts", "symbol", "alpha", "thin"))


def e_paper(spark: SparkSession, sf: str) -> DataFrame:
    return tidy(research.paper_books(research.alphas(panel(spark, sf))), 5)


def e_report(spark: SparkSession, sf: str) -> DataFrame:
    rho = studies.residual_correlation(with_bench(bars.weekly(spark, sf))).select(F.round("rho", 6).alias("rho")).first().rho
    books = research.paper_books(research.alphas(panel(spark, sf)))
    return tidy(research.information_report(books, per_year=52.0 / HORIZON, years=7.0, horizon=HORIZON, spacing=1.0, rho=F.lit(rho).cast("double"), n_trials=3), 4)


def e_scaling(spark: SparkSession, sf: str) -> DataFrame:
    rows = panel(spark, sf)
    return tidy(research.scaling_comparison(rows, scales(rows), per_year=52.0 / HORIZON), 5)


def e_case(spark: SparkSession, sf: str) -> DataFrame:
    vols = risk.beta(with_bench(bars.weekly(spark, sf)), 52.0).select("symbol", F.col("residual_vol").alias("vol"))
    return tidy(research.case_test(panel(spark, sf), vols), 4)


def e_signals(spark: SparkSession, sf: str) -> DataFrame:
    w = Window.partitionBy("symbol").orderBy("ts")
    rows = panel(spark, sf).withColumns({"reversal": F.col("score"), "crowd": F.col("volume") / F.lag("volume", 4).over(w)})
    return tidy(research.measured_signals(rows, ["reversal", "crowd"]), 5)


def e_memory(spark: SparkSession, sf: str) -> DataFrame:
    points = studies.rebalance_points(bars.weekly(spark, sf), HORIZON, 24).select("ts")
    return tidy(research.alpha_memory(research.alphas(panel(spark, sf)).join(F.broadcast(points), "ts", "left_semi")))


def periods(spark: SparkSession, sf: str) -> DataFrame:
    """Each name as a small book of a thousandth of itself, weekly."""
    rows = panel(spark, sf).where("ret is not null")
    return rows.select("symbol", "ts", (F.col("beta") - 1).alias("beta"), "bench", ((F.col("ret") - F.col("bench")) / 1000).alias("active"), (F.col("ret") / 1000).alias("portfolio"), (F.col("bench") / 1000).alias("base"), ((F.col("beta") - 1) * F.col("bench") / 1000).alias("systematic"))


def e_split(spark: SparkSession, sf: str) -> DataFrame:
    return tidy(research.systematic_split(periods(spark, sf), ["symbol"], 0.001), 5)


def e_blend(spark: SparkSession, sf: str) -> DataFrame:
    return tidy(research.blended_stats(periods(spark, sf), ["symbol"], "active", per_year=52.0, prior=0.0004, t0=26.0), 7)


def e_linked(spark: SparkSession, sf: str) -> DataFrame:
    return tidy(research.linked(periods(spark, sf).drop("bench").withColumnRenamed("base", "bench"), ["symbol"], "ts", ["systematic"]), 4)


def e_te(spark: SparkSession, sf: str) -> DataFrame:
    """The book of each brand against all, by regimes of the market's volatility."""
    past = Window.partitionBy("symbol").orderBy("ts").rowsBetween(-7, 0)
    rows = periods(spark, sf).select("symbol", "active", (F.var_samp("active").over(past) * 52).alias("variance"), F.stddev_samp("bench").over(past).alias("vol"))
    return tidy(research.error_by_regime(rows, 52.0, ["symbol"]), 5)


def r_split(spark: SparkSession, sf: str) -> DataFrame:
    rows = exposed(spark, sf).withColumn("market", F.lit(1.0))
    return tidy(research.factor_split(rows, factors.factor_returns(rows, EXPOSURES), ["market", *EXPOSURES]), 5)


W = "partition by symbol order by ts"
PANEL = f"""wk as (select *, avg(ret) over (partition by ts) as bench from rets), wk2 as (select *, case when ret is not null then bench end as bx from wk),
pn as (select ts, symbol, close, ret, bench, volume, -ret as score, case when count(ret) over w10 = 10 then stddev_samp(ret) over w10 end as vol,
  case when count(bx) over p >= 3 and var_samp(bx) over p > 1e-24 then covar_samp(ret, bx) over p / var_samp(bx) over p else 1 end as beta, lead(close, 4) over ({W}) / nullif(close, 0) - 1 as fwd,
  case when count(*) over f = 4 then exp(sum(ln(1 + bench)) over f) - 1 end as later, volume / nullif(lag(volume, 4) over ({W}), 0) as crowd
  from wk2 window w10 as ({W} rows between 9 preceding and current row), p as ({W} rows unbounded preceding), f as ({W} rows between 1 following and 4 following)),
pan as (select *, fwd - beta * later as resid from pn),
wz as (select *, least(greatest(score, quantile_cont(score, 0.025) over t), quantile_cont(score, 0.975) over t) as w, count(score) over t as nn, avg(score) over t as sm from pan window t as (partition by ts)),
zs as (select *, case when w is null then null when stddev_pop(w) over t <= 1e-12 * greatest(1, avg(abs(w)) over t) then 0 else (w - avg(w) over t) / stddev_pop(w) over t end as z, case when w is not null then volume end as y from wz window t as (partition by ts)),
sc as (select ts, case when count(w) >= 2 and stddev_pop(case when vol > 0 then w / vol end) > 0 then stddev_pop(w) / stddev_pop(case when vol > 0 then w / vol end) end as scale from wz where w is not null group by ts),
rs as (select zs.*, case when y is null or count(y) over t < 2 or var_pop(y) over t = 0 then z else z - regr_intercept(z, y) over t - regr_slope(z, y) over t * y end as res from zs window t as (partition by ts))"""
PERIODS = "pd as (select symbol, ts, beta - 1 as beta, bench, (ret - bench) / 1000 as active, ret / 1000 as portfolio, bench / 1000 as base, (beta - 1) * bench / 1000 as systematic from pan where ret is not null)"


def alphas_sql(name: str, vol: str) -> str:
    return f"""{name}0 as (select rs.*, case when nn < 10 then score - sm else res end * 0.05 * {vol} as a from rs left join sc on rs.ts = sc.ts),
{name} as (select *, case when nn < 10 or a is null or coalesce(stddev_pop(a) over t, 0) <= 1e-12 * greatest(1, avg(abs(a)) over t) then a else least(greatest(a, -3 * stddev_pop(a) over t), 3 * stddev_pop(a) over t) end as alpha from {name}0 window t as (partition by ts))"""


def books_sql(name: str, of: str) -> str:
    """Coefficients and books; the means of tied ranks come from min and count."""
    return f"""{name}0 as (select *, count(*) over (partition by ts) as cnt, rank() over (partition by ts order by alpha) + (count(*) over (partition by ts, alpha) - 1) / 2 as ra, rank() over (partition by ts order by resid) + (count(*) over (partition by ts, resid) - 1) / 2 as rr
  from {of} where alpha is not null and resid is not null),
{name} as (select ts, count(*) as names, corr(alpha, resid) as ic, corr(ra, rr) as rank_ic, covar_pop(alpha, resid) * count(*) / stddev_samp(alpha) as book from {name}0 where cnt >= 5 group by ts)"""


ONE, TWO = alphas_sql("al", "vol"), alphas_sql("am", "coalesce(scale, vol)")
BASE = f"with {WEEK}, {RETS}, {PANEL}"
IR = "avg(book) / nullif(stddev_pop(book), 0) * sqrt(13.0)"

SQL: dict[str, str] = {
    "x_residuals": f"{BASE} select epoch(ts)::bigint as ts, symbol, {r('beta', 5)} as beta, {r('fwd', 5)} as fwd, {r('resid', 5)} as resid, {r('vol', 5)} as vol from pan",
    "x_alphas": f"""{BASE}, {ONE}, k as (select *, row_number() over (partition by ts order by abs(alpha) desc, symbol)::int as rank from al where alpha is not null)
select epoch(ts)::bigint as ts, symbol, {r('score')} as score, {r('vol')} as vol, {r('alpha')} as alpha, nn < 10 as thin, rank from k where rank <= 5""",
    "x_alphas2": f"{BASE}, {TWO} select epoch(ts)::bigint as ts, symbol, {r('alpha')} as alpha, nn < 10 as thin from am",
    "e_paper": f"{BASE}, {ONE}, {books_sql('bk', 'al')} select epoch(ts)::bigint as ts, names, {r('ic', 5)} as ic, {r('rank_ic', 5)} as rank_ic, {r('book', 5)} as book from bk",
    "e_report": f"""{BASE}, {ONE}, {books_sql('bk', 'al')}, rh as (select rho from ({market.SQL['e_breadth']})),
s as (select count(ic) as periods, avg(ic) as mean_ic, stddev_samp(ic) as ic_vol, avg(ic) * sqrt(count(ic)) / stddev_samp(ic) as ic_tstat, avg(rank_ic) as mean_rank_ic, avg(rank_ic) * sqrt(count(rank_ic)) / stddev_samp(rank_ic) as rank_ic_tstat,
  floor(median(names))::bigint as n_names, coalesce({IR}, 0) as realized_ir from bk),
q as (select *, case when rho is not null then 13.0::double * n_names / case when 1 + (n_names - 1) * rho > 0 then 1 + (n_names - 1) * rho else 1 end end as breadth, periods / 4.0 * mean_ic * mean_ic as g from s, rh)
select periods, {r('mean_ic', 4)} as mean_ic, {r('ic_vol', 4)} as ic_vol, {r('ic_tstat', 4)} as ic_tstat, {r('mean_rank_ic', 4)} as mean_rank_ic, {r('rank_ic_tstat', 4)} as rank_ic_tstat, n_names, {r('realized_ir', 4)} as realized_ir, {r('breadth', 4)} as breadth,
  {r('n_names * 13', 4)} as breadth_naive, {r('mean_ic * sqrt(greatest(breadth, 0))', 4)} as predicted_ir, {r('sqrt((1 + realized_ir * realized_ir / 2) / 7)', 4)} as ir_error, {r('periods / 4.0', 4)} as t_eff, {r('case when g > 0 then g / (g + 1) else 0 end', 4)} as level_shrink,
  {r('1 - 0.95::double * 0.95 * 0.95', 4)} as inflation, periods < 20 as low_sample, abs(realized_ir) > 2 as too_good from q""",
    "e_scaling": f"""{BASE}, {ONE}, {TWO}, {books_sql('bk', 'al')}, {books_sql('bm', 'am')}, u as (select 'case1' as scaling, * from bk union all select 'case2', * from bm)
select scaling, count(ic) as periods, {r('avg(ic)', 5)} as mean_ic, {r(f'coalesce({IR}, 0)', 5)} as realized_ir from u group by scaling""",
    "e_case": f"""{BASE}, vl as (select symbol, beta_, sqrt(greatest(vr - 2 * beta_ * c + beta_ * beta_ * vb, 0)) * sqrt(52) as x from (select symbol, covar_samp(ret, bench) as c, var_samp(bench) as vb, var_samp(ret) as vr, case when count(*) >= 3 and var_samp(bench) > 1e-24 then covar_samp(ret, bench) / var_samp(bench) else 1 end as beta_ from wk where ret is not null and bench is not null group by symbol)),
ys as (select symbol, stddev_samp(score) as y, count(score) as n from pan group by symbol), m as (select floor(median(n))::bigint as n_obs from ys),
f as (select any_value(n_obs) as n_obs, count(*) as k, regr_slope(y, x) as b, regr_r2(y, x) as r2, var_pop(x) as vx, var_pop(y) as vy, covar_pop(x, y) as c from ys join vl using (symbol), m where y is not null and x is not null and n >= least(36, greatest(n_obs, 2))),
g as (select *, b / sqrt((vy - b * c) * k / (k - 2) / (vx * k)) as t from f)
select (case when r2 >= 0.25 and t >= 2 and b > 0 then 2 when r2 <= 0.05 then 1 else 2 end)::int as "case", {r('r2', 4)} as r2, {r('t', 4)} as t_stat, {r('b', 4)} as slope, n_obs, k as n_names, not ((r2 >= 0.25 and t >= 2 and b > 0) or r2 <= 0.05) as ambiguous,
  case when r2 >= 0.25 and t >= 2 and b > 0 then 'proportional' when r2 <= 0.05 then 'unrelated' else 'ambiguous' end as why from g""",
    "e_signals": f"""{BASE}, e as (select ts, corr(score, resid) as i1, corr(crowd, resid) as i2, corr(score, crowd) as c from pan where score is not null and crowd is not null and resid is not null group by ts having count(*) >= 5),
m as (select count(*) as n, avg(i1) as i1, avg(i2) as i2, avg(c) as c from e), h as (select *, i1 * (n * i1 * i1) / (n * i1 * i1 + 1) as h1, i2 * (n * i2 * i2) / (n * i2 * i2 + 1) as h2, 1.0001::double as d from m),
v as (select *, (d * h1 - c * h2) / (d * d - c * c) as w1, (d * h2 - c * h1) / (d * d - c * c) as w2 from h)
select 'reversal' as signal, {r('i1', 5)} as ic, {r('h1', 5)} as shrunk_ic, {r('w1', 5)} as weight, {r('sqrt(h1 * w1 + h2 * w2)', 5)} as combined_ic, n as periods from v
union all select 'crowd', {r('i2', 5)}, {r('h2', 5)}, {r('w2', 5)}, {r('sqrt(h1 * w1 + h2 * w2)', 5)}, n from v""",
    "e_memory": f"""{BASE}, {ONE}, cal as (select ts, row_number() over (order by ts) - 1 as k, count(*) over () as n from (select distinct ts from bars)),
pts as (select ts from cal where k in (select 30 + floor(i * (n - 5 - 30) / (least(24, n - 5 - 30) - 1)) from cal, range(24) t(i) where i < least(24, n - 5 - 30))),
b as (select ts, alpha, lag(alpha) over ({W}) as p from al where ts in (select ts from pts))
select epoch(ts)::bigint as ts, count(*) as n, {r('case when count(*) >= 5 then corr(alpha, p) end')} as corr from b where alpha is not null and p is not null group by ts""",
    "e_split": f"{BASE}, {PERIODS} select symbol, count(*) as n, {r('avg(beta) * 0.001 * count(*)', 5)} as expected, {r('avg(beta) * (avg(bench) - 0.001) * count(*)', 5)} as surprise, {r('covar_pop(beta, bench) * count(*)', 5)} as timing from pd group by symbol",
    "e_blend": f"""{BASE}, {PERIODS}, b as (select symbol, count(*) as n, avg(active) as m, sqrt((0.0004 * 26 + var_samp(active) * count(*)) / (count(*) + 26)) as v from pd group by symbol)
select symbol, n as periods, {r('m', 7)} as mean, {r('v', 7)} as vol, {r('m * 52', 7)} as ann_mean, {r('m / v * sqrt(52)', 7)} as ir, {r('m / v * sqrt(n)', 7)} as t_stat from b""",
    "e_linked": f"""{BASE}, {PERIODS}, g as (select *, exp(coalesce(sum(ln(1 + active)) over ({W} rows between unbounded preceding and 1 preceding), 0)) as g from pd),
l as (select symbol, sum(systematic * g) as linked_systematic, exp(sum(ln(1 + active))) - 1 as naive, exp(sum(ln(1 + portfolio))) - exp(sum(ln(1 + base))) as honest from g group by symbol)
select symbol, {r('linked_systematic', 4)} as linked_systematic, {r('naive', 4)} as naive, {r('honest', 4)} as honest, {r('honest - naive', 4)} as delta from l""",
    "e_te": f"""{BASE}, {PERIODS}, q as (select symbol, active, var_samp(active) over p * 52 as variance, stddev_samp(bench) over p as vol from pd window p as (partition by symbol order by ts rows between 7 preceding and current row)),
c as (select symbol, count(vol) as n, quantile_cont(vol, 1 / 3.0::double) as a, quantile_cont(vol, 2 / 3.0::double) as b from q group by symbol), t as (select symbol, case when vol <= a then 'low' when vol <= b then 'mid' else 'high' end as regime, count(*) as n, sqrt(avg(variance)) as p, stddev_samp(active) * sqrt(52) as z from q join c using (symbol) where vol is not null and c.n >= 6 group by 1, 2)
select symbol, regime, n, {r('p', 5)} as predicted_te, {r('z', 5)} as realized_te, {r('z - p', 5)} as gap from t""",
    "r_split": f"""with {WEEK}, {RETS}, {EXPOSED}, e as (select ts, sum(weight * ret) as total, sum(weight) as x0, sum(weight * size) as x1, sum(weight * momentum) as x2 from ex group by ts),
q as (select e.ts, any_value(total) as total, sum(fr.ret * case factor when 'market' then x0 when 'size' then x1 else x2 end) as f from e join fr on e.ts = fr.ts group by e.ts)
select epoch(ts)::bigint as ts, {r('f', 5)} as factor_return, {r('total - f', 5)} as specific_return from q""",
}

QUERIES = {f.__name__: f for f in (x_residuals, x_alphas, x_alphas2, e_paper, e_report, e_scaling, e_case, e_signals, e_memory, e_split, e_blend, e_linked, e_te, r_split)}
