"""Registered queries of split scans, factor and conditional risk, forecast evaluation and matrix queries, each with its DuckDB SQL."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from ..operators import risk, riskmodel, scan
from ..sources import bars
from .queries import CC, HOUR, RETS, WEEK, W, r, tidy, weekly_returns

PPY = 52.0
STYLES = ["size", "dispersion"]
MIN_OBS = 60


def panel(rets: DataFrame) -> DataFrame:
    return risk.complete_cases(rets.select("ts", "symbol", "ret"), 100)


def styles(rets: DataFrame) -> DataFrame:
    """Slow exposures of each name: the logarithm of its mean volume, and the deviation of its returns."""
    return rets.groupBy("symbol").agg(F.ln(F.avg("volume")).alias("size"), F.stddev_samp("ret").alias("dispersion"))


def model(rets: DataFrame) -> riskmodel.FactorModel:
    return riskmodel.factor_model(panel(rets), styles(rets), STYLES, PPY)


def annual(rows: DataFrame) -> DataFrame:
    return risk.covariance(rows).select("i", "j", (F.col("cov") * PPY).alias("cov"))


def books(rows: DataFrame) -> tuple[DataFrame, DataFrame]:
    """A book of weights by the last digit of the name, and an equal-weighted benchmark."""
    names = rows.select("symbol").distinct()
    return names.select("symbol", ((F.right("symbol", F.lit(1)).cast("double") + 1) / 100).alias("weight")), names.select("symbol", F.lit(0.04).alias("weight"))


def c_ewma_series(spark: SparkSession, sf: str) -> DataFrame:
    rows = scan.ewma_variance(weekly_returns(spark, sf), decay=0.97, min_obs=20)
    return tidy(rows.select("ts", "symbol", "i", "variance"))


def c_running(spark: SparkSession, sf: str) -> DataFrame:
    return tidy(scan.drawdowns(bars.hourly(spark, sf), seconds=3 * 86400), 4)


def r_streamed(spark: SparkSession, sf: str) -> DataFrame:
    rows = panel(weekly_returns(spark, sf))
    return tidy(risk.streamed_covariance(rows, [x.symbol for x in rows.select("symbol").distinct().collect()]), 8)


def r_matrix(spark: SparkSession, sf: str) -> DataFrame:
    return tidy(riskmodel.assembled(model(weekly_returns(spark, sf))))


def r_conditional(spark: SparkSession, sf: str) -> DataFrame:
    rows = panel(weekly_returns(spark, sf))
    cov = annual(rows)
    both = [riskmodel.conditioned(cov, rows, m, PPY, min_obs=MIN_OBS).select(F.lit(m).alias("method"), "i", "j", "cov") for m in ("ewma", "har")]
    return tidy(both[0].unionByName(both[1]))


def r_conditional_factor(spark: SparkSession, sf: str) -> DataFrame:
    made = model(weekly_returns(spark, sf))
    both = [riskmodel.assembled(riskmodel.conditioned_model(made, m, PPY, min_obs=MIN_OBS)).select(F.lit(m).alias("method"), "i", "j", "cov") for m in ("ewma", "har")]
    return tidy(both[0].unionByName(both[1]), 5)


def r_regimes(spark: SparkSession, sf: str) -> DataFrame:
    rows = panel(weekly_returns(spark, sf))
    cov = annual(rows)
    before = riskmodel.diagonal(cov)
    both = [riskmodel.regimes(before, riskmodel.diagonal(riskmodel.conditioned(cov, rows, m, PPY, min_obs=MIN_OBS))).withColumn("method", F.lit(m)) for m in ("ewma", "har")]
    return tidy(both[0].unionByName(both[1]), 5)


def points(spark: SparkSession, sf: str) -> DataFrame:
    return riskmodel.evaluation_points(weekly_returns(spark, sf), min_obs=MIN_OBS, n_points=50, decay=0.97)


def e_forecast_points(spark: SparkSession, sf: str) -> DataFrame:
    return tidy(points(spark, sf), 5)


def e_forecast_eval(spark: SparkSession, sf: str) -> DataFrame:
    return tidy(riskmodel.evaluated(points(spark, sf)), 4)


def e_forecast_gate(spark: SparkSession, sf: str) -> DataFrame:
    return tidy(riskmodel.gate(points(spark, sf)), 4)


def r_complete(spark: SparkSession, sf: str) -> DataFrame:
    """Names ending in 5 begin late: too few returns for the panel, so they come in at the median variance."""
    rets = weekly_returns(spark, sf).where("right(symbol, 1) <> '5' or ts >= '1998-01-01'").select("ts", "symbol", "ret")
    cov = risk.covariance(risk.complete_cases(rets, 100)).select("i", "j", (F.col("cov") * PPY).alias("cov"))
    return tidy(riskmodel.completed(cov, rets))


def r_queries(spark: SparkSession, sf: str) -> DataFrame:
    rows = panel(weekly_returns(spark, sf))
    cov = annual(rows)
    book, bench = books(rows)
    one = lambda metric, df, value, i="symbol", j=None: df.select(F.lit(metric).alias("metric"), (F.col(i) if i else F.lit("")).alias("i"), (F.col(j) if j else F.lit("")).alias("j"), F.col(value).alias("value"))
    rows = one("variance", riskmodel.variance(cov, book), "variance", None)
    for more in (
        one("volatility", riskmodel.variance(cov, book), "volatility", None), one("tracking_error", riskmodel.tracking_error(cov, book, bench), "tracking_error", None),
        one("beta", riskmodel.implied_beta(cov, bench), "beta"), one("marginal", riskmodel.marginal(cov, book, bench), "marginal"),
        one("name_volatility", riskmodel.volatilities(cov), "volatility"), one("correlation", riskmodel.correlation(cov), "rho", "i", "j"),
    ):
        rows = rows.unionByName(more)
    return tidy(rows)


def r_book_split(spark: SparkSession, sf: str) -> DataFrame:
    rets = weekly_returns(spark, sf)
    book, bench = books(panel(rets))
    made, rows = model(rets), None
    for name, weights in (("book", book), ("benchmark", bench)):
        one = riskmodel.model_split(made, weights).withColumn("book", F.lit(name))
        rows = one if rows is None else rows.unionByName(one)
    return tidy(rows)


QUERIES = {f.__name__: f for f in (c_ewma_series, c_running, r_streamed, r_matrix, r_conditional, r_conditional_factor, r_regimes, e_forecast_points, e_forecast_eval, e_forecast_gate, r_complete, r_queries, r_book_split)}


def ewma_sql(decay: float, m: int) -> str:
    """Series of all names: (symbol, ts, i, q, v)."""
    return f"""nu as (select ts, symbol, ret * ret as q, row_number() over ({W}) - 1 as i from rets where ret is not null),
se as (select symbol, avg(q) as seed from nu where i < {m} group by symbol having count(*) = {m}),
ew as (select a.symbol, a.ts, a.i, a.q, case when a.i >= {m - 1} then any_value(seed) * pow({decay}, a.i - {m - 1}) + coalesce(sum({1 - decay!r} * pow({decay}, a.i - b.i) * b.q) filter (where b.i >= {m}), 0) end as v
  from nu a join nu b on a.symbol = b.symbol and b.i <= a.i left join se on a.symbol = se.symbol group by a.symbol, a.ts, a.i, a.q)"""


MODEL = """fx as (select symbol, ln(avg(volume)) as size, stddev_samp(ret) as dispersion from rets group by symbol),
pf as (select panel.*, size, dispersion from panel join fx using (symbol)),
fm as (select ts, avg(ret) as my, avg(size) as m1, avg(dispersion) as m2, var_pop(size) as s11, var_pop(dispersion) as s22, covar_pop(size, dispersion) as s12, covar_pop(size, ret) as r1, covar_pop(dispersion, ret) as r2 from pf group by ts having count(*) > 4),
fs as (select *, (r1 * s22 - r2 * s12) / (s11 * s22 - s12 * s12) as f1, (r2 * s11 - r1 * s12) / (s11 * s22 - s12 * s12) as f2 from fm),
fr as (select ts, my - f1 * m1 - f2 * m2 as f0, f1, f2 from fs),
re as (select ts, symbol, size, dispersion, ret - f0 - f1 * size - f2 * dispersion as e from pf join fr using (ts)),
nx as (select distinct symbol, size, dispersion from pf)"""
PLAIN = """fc as (select 52 * var_samp(f0) as c00, 52 * covar_samp(f0, f1) as c01, 52 * covar_samp(f0, f2) as c02, 52 * var_samp(f1) as c11, 52 * covar_samp(f1, f2) as c12, 52 * var_samp(f2) as c22 from fr),
sd as (select symbol, 52 * var_samp(e) as d from re group by symbol)"""


def matrix_sql(fc: str, sd: str) -> str:
    return f"""select a.symbol as i, b.symbol as j, c00 + c01 * (a.size + b.size) + c02 * (a.dispersion + b.dispersion) + c11 * a.size * b.size + c22 * a.dispersion * b.dispersion
  + c12 * (a.size * b.dispersion + b.size * a.dispersion) + case when a.symbol = b.symbol then d else 0 end as cov from nx a join nx b on a.symbol <= b.symbol join {sd} s on s.symbol = a.symbol cross join {fc}"""


def weights_sql(of: str, decay: float, m: int) -> str:
    return f"""da as (select ts, row_number() over (order by ts) - 1 as i, count(*) over () as t from (select distinct ts from {of})),
om as (select ts, case when i < {m} then pow({decay}, t - {m}) / {m} else {1 - decay!r} * pow({decay}, t - 1 - i) end as w from da where t >= {m})"""


def har_sql(name: str, of: str, value: str, m: int) -> str:
    """(symbol, v): the fit's determinants written out."""
    return f"""{name}0 as (select symbol, ts, {value} * {value} as d, case when count(*) over w5 = 5 then avg({value} * {value}) over w5 end as w, case when count(*) over w22 = 22 then avg({value} * {value}) over w22 end as m, lead({value} * {value}) over ({W}) as y
  from {of} window w5 as ({W} rows between 4 preceding and current row), w22 as ({W} rows between 21 preceding and current row)),
{name}1 as (select symbol, count(*) as n, {moments_sql('')} from {name}0 where w is not null and m is not null and y is not null group by symbol having count(*) >= {m}),
{name}2 as (select symbol, arg_max(d, ts) as ld, arg_max(w, ts) as lw, arg_max(m, ts) as lm, count(*) as t from {name}0 group by symbol),
{name} as (select symbol, greatest(my + b1 * (ld - m1) + b2 * (lw - m2) + b3 * (lm - m3), 0) as v from (select *, {cramer_sql()} from {name}1) join {name}2 using (symbol) where t > {m})"""


def moments_sql(a: str) -> str:
    return ", ".join([f"avg({a}y) as my", *[f"avg({a}{c}) as m{k}" for k, c in enumerate("dwm", 1)], *[f"covar_pop({a}{c}, {a}y) as r{k}" for k, c in enumerate("dwm", 1)], *[f"covar_pop({a}{x}, {a}{y}) as s{i}{j}" for i, x in enumerate("dwm", 1) for j, y in enumerate("dwm", 1) if i <= j]])


def cramer_sql() -> str:
    s = lambda i, j: f"s{min(i, j)}{max(i, j)}"

    def det(put: int) -> str:
        e = lambda i, j: f"r{i}" if j == put else s(i, j)
        return f"({e(1, 1)} * ({e(2, 2)} * {e(3, 3)} - {e(2, 3)} * {e(3, 2)}) - {e(1, 2)} * ({e(2, 1)} * {e(3, 3)} - {e(2, 3)} * {e(3, 1)}) + {e(1, 3)} * ({e(2, 1)} * {e(3, 2)} - {e(2, 2)} * {e(3, 1)}))"

    return ", ".join(f"{det(k)} / nullif({det(0)}, 0) as b{k}" for k in (1, 2, 3))


BASE = f"with {WEEK}, {RETS}, {CC}"
COND = f"""{weights_sql('panel', 0.97, MIN_OBS)}, va as (select symbol, sum(w * ret * ret) * 52 as v from panel join om using (ts) group by symbol), {har_sql('hv', 'panel', 'ret', MIN_OBS)},
fo as (select 'ewma' as method, symbol, v from va union all select 'har', symbol, v * 52 from hv),
ba as (select method, i as symbol, 52 * cov as u, coalesce(v, 52 * cov) as v from cov cross join (select unnest(['ewma', 'har']) as method) left join fo using (method) where i = j and (symbol = i or symbol is null))"""
COND = COND.replace("left join fo using (method) where i = j and (symbol = i or symbol is null)", "mm left join fo on fo.method = mm.method and fo.symbol = i where i = j").replace("ba as (select method, i as symbol", "ba as (select mm.method as method, i as symbol").replace("as method) mm left", "as method) mm left")
POINTS = f"""{ewma_sql(0.97, MIN_OBS)},
ft as (select symbol, ts, i, q as d, v as ewma, case when count(*) over w5 = 5 then avg(q) over w5 end as w, case when count(*) over w22 = 22 then avg(q) over w22 end as m, lead(q) over (partition by symbol order by i) as y, count(*) over (partition by symbol) as t, avg(q) over (partition by symbol order by i rows unbounded preceding) as unconditional
  from ew window w5 as (partition by symbol order by i rows between 4 preceding and current row), w22 as (partition by symbol order by i rows between 21 preceding and current row)),
sz as (select symbol, {MIN_OBS} as f, max(t) - 2 as l, least(50, max(t) - 1 - {MIN_OBS}) as k from ft group by symbol having max(t) - 2 > {MIN_OBS}),
pt as (select distinct symbol, case when j = k - 1 and k > 1 then l else floor(f + j * ((l - f)::double / greatest(k - 1, 1)))::bigint end as i from (select *, unnest(generate_series(0, k - 1)) as j from sz)),
hp as (select p.symbol, p.i, count(*) as n, {moments_sql('b.')} from pt p join ft b on p.symbol = b.symbol and b.i < p.i where b.w is not null and b.m is not null and b.y is not null group by p.symbol, p.i),
hq as (select *, {cramer_sql()} from hp),
po as (select ft.symbol, ts, i, y as realized, ewma, case when i + 1 > {MIN_OBS} and n >= {MIN_OBS} then greatest(my + b1 * (d - m1) + b2 * (w - m2) + b3 * (m - m3), 0) end as har, unconditional from pt join ft using (symbol, i) left join hq using (symbol, i))"""
LONG = "lo as (select symbol, i, realized, unnest(['ewma', 'har', 'unconditional']) as method, unnest([ewma, har, unconditional]) as forecast from po)"


def quality_sql(digits: int) -> str:
    some = "count(*) >= 3"
    x = "realized / forecast"
    qlike = f"avg(case when realized > 0 and forecast > 0 then {x} - ln({x}) - 1 end)"
    return f"count(*) as n, {r(f'case when {some} then regr_intercept(realized, forecast) end', digits)} as a, {r(f'case when {some} then regr_slope(realized, forecast) end', digits)} as b, {r(f'case when {some} then coalesce(regr_r2(realized, forecast), 0) end', digits)} as r2, {r(qlike, digits)} as qlike"


PULL = """h as (select i, j, 52 * cov as cov from cov union all select j, i, 52 * cov from cov where i < j),
wt as (select i as symbol, ("right"(i, 1)::double + 1) / 100 as w, 0.04 as b from cov where i = j),
pu as (select h.i as symbol, sum(cov * w) as pw, sum(cov * b) as pb from h join wt on wt.symbol = h.j group by h.i),
tt as (select sum(w * pw) as vw, sum(b * pb) as vb, sum((w - b) * (pw - pb)) as va from wt join pu using (symbol))"""
LATE = CC.replace("from rets where ret is not null group by", "from late where ret is not null group by").replace("from rets where ret is not null and symbol", "from late where ret is not null and symbol")
SQL = {
    "c_ewma_series": f"with {WEEK}, {RETS}, {ewma_sql(0.97, 20)} select epoch(ts)::bigint as ts, symbol, i, {r('v')} as variance from ew",
    "c_running": f"with {HOUR} select epoch(ts)::bigint as ts, symbol, {r('close', 4)} as close, {r('max(close) over w', 4)} as peak, {r('close / nullif(max(close) over w, 0) - 1', 4)} as drawdown, count(close) over w as n, {r('sum(volume) over w', 4)} as traded from bars window w as ({W} rows unbounded preceding)",
    "r_streamed": f"{BASE} select i, j, {r('cov', 8)} as cov, n from cov",
    "r_matrix": f"{BASE}, {MODEL}, {PLAIN}, ma as ({matrix_sql('fc', 'sd')}) select i, j, {r('cov')} as cov from ma",
    "r_conditional": f"{BASE}, {COND} select a.method, i, j, {r('case when i = j then a.v when a.u > 0 and b.u > 0 then 52 * cov * sqrt(a.v / a.u * b.v / b.u) else 0 end')} as cov from cov join ba a on a.symbol = i join ba b on b.symbol = j and b.method = a.method",
    "r_conditional_factor": f"""{BASE}, {MODEL}, {PLAIN}, {weights_sql('fr', 0.97, MIN_OBS)},
fe as (select 52 * sum(w * f0 * f0) as c00, 52 * sum(w * f0 * f1) as c01, 52 * sum(w * f0 * f2) as c02, 52 * sum(w * f1 * f1) as c11, 52 * sum(w * f1 * f2) as c12, 52 * sum(w * f2 * f2) as c22 from fr join om using (ts)),
se as (select symbol, 52 * sum(w * e * e) as d from re join om using (ts) group by symbol), {har_sql('hr', 're', 'e', MIN_OBS)}, sh as (select symbol, coalesce(52 * v, d) as d from sd left join hr using (symbol)),
m1 as ({matrix_sql('fe', 'se')}), m2 as ({matrix_sql('fe', 'sh')})
select 'ewma' as method, i, j, {r('cov', 5)} as cov from m1 union all select 'har', i, j, {r('cov', 5)} from m2""",
    "r_regimes": f"{BASE}, {COND}, rg as (select *, case when u > 0 then v / u else 1 end as g from ba) select symbol, {r('sqrt(u)', 5)} as unconditional_vol, {r('sqrt(v)', 5)} as conditional_vol, {r('g', 5)} as regime, {r('avg(g) over (partition by method)', 5)} as mean_regime, method from rg",
    "e_forecast_points": f"with {WEEK}, {RETS}, {POINTS} select symbol, epoch(ts)::bigint as ts, i, {r('realized', 5)} as realized, {r('ewma', 5)} as ewma, {r('har', 5)} as har, {r('unconditional', 5)} as unconditional from po",
    "e_forecast_eval": f"""with {WEEK}, {RETS}, {POINTS}, {LONG}, ct as (select symbol, quantile_cont(realized, 1/3) as q1, quantile_cont(realized, 2/3) as q2, count(*) as k from po group by symbol),
lb as (select symbol, method, realized, forecast, unnest(['all', case when k < 3 then 'mid' when realized <= q1 then 'low' when realized <= q2 then 'mid' else 'high' end]) as regime from lo join ct using (symbol))
select symbol, method, regime, {quality_sql(4)} from lb where realized is not null and forecast is not null group by symbol, method, regime""",
    "e_forecast_gate": f"""with {WEEK}, {RETS}, {POINTS}, {LONG}, kp as (select symbol from po group by symbol having count(*) >= 10),
pq as (select method, {quality_sql(12)} from lo where symbol in (select symbol from kp) and realized is not null and forecast is not null group by method),
wn as (select arg_min(method, qlike) as winner, max(case when method = 'unconditional' then abs(b - 1) end) as gap from pq)
select method, n, {r('a', 4)} as a, {r('b', 4)} as b, {r('r2', 4)} as r2, {r('qlike', 4)} as qlike, method = winner as best, method = winner and method <> 'unconditional' and abs(b - 1) < gap as adopt from pq cross join wn""",
    "r_complete": f"with {WEEK}, {RETS}, late as (select * from rets where \"right\"(symbol, 1) <> '5' or ts >= timestamp '1998-01-01'), {LATE} select i, j, {r('52 * cov')} as cov from cov union all select symbol, symbol, {r('52 * (select median(cov) from cov where i = j)')} from (select distinct symbol from late) where symbol not in (select symbol from kept)",
    "r_queries": f"""{BASE}, {PULL} select 'variance' as metric, '' as i, '' as j, {r('vw')} as value from tt union all select 'volatility', '', '', {r('sqrt(vw)')} from tt union all select 'tracking_error', '', '', {r('sqrt(va)')} from tt
union all select 'beta', symbol, '', {r('pb / vb')} from pu cross join tt union all select 'marginal', symbol, '', {r('(pw - pb) / sqrt(va)')} from pu cross join tt
union all select 'name_volatility', i, '', {r('sqrt(52 * cov)')} from cov where i = j
union all select 'correlation', c.i, c.j, {r('c.cov / sqrt(a.cov * b.cov)')} from cov c join cov a on a.i = c.i and a.j = c.i join cov b on b.i = c.j and b.j = c.j""",
    "r_book_split": f"""{BASE}, {MODEL}, {PLAIN}, bk as (select symbol, unnest(['book', 'benchmark']) as book, unnest([("right"(symbol, 1)::double + 1) / 100, 0.04]) as w from (select distinct symbol from panel)),
ld as (select book, sum(w) as l0, sum(w * size) as l1, sum(w * dispersion) as l2, sum(w * w * d) as specific from bk join nx using (symbol) join sd using (symbol) group by book),
sp as (select book, specific, l0 * l0 * c00 + l1 * l1 * c11 + l2 * l2 * c22 + 2 * (l0 * l1 * c01 + l0 * l2 * c02 + l1 * l2 * c12) as factor from ld cross join fc)
select book, {r('factor')} as factor, {r('specific')} as specific, {r('factor + specific')} as total, {r('factor / (factor + specific)')} as factor_share from sp""",
}
