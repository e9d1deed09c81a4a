"""Trade analytics, screens and bootstrap skill, against DuckDB and plain numbers."""

import math

import duckdb
import numpy as np
import pytest
from pyspark.sql import functions as F
from test_market import TABLES, flat_rows

from tidemark.functions import scalars as S
from tidemark.operators import analytics, metrics, sweep
from tidemark.plans import analysis, desk
from tidemark.plans import queries as market
from tidemark.sources import bars, coverage

SF = "/root/testdata/sf0.01"


@pytest.fixture(scope="module")
def duck():
    con = duckdb.connect()
    for t in TABLES:
        con.sql(f"create view {t} as select * from '{SF}/{t}.parquet'")
    return con


@pytest.mark.parametrize("name", sorted({*analysis.QUERIES, *analysis.SQL}))
def test_query_equals_sql(spark, duck, name):
    got = (analysis.QUERIES | market.QUERIES | desk.QUERIES)[name](spark, SF).toPandas()
    assert len(got) > 0
    if name in analysis.SQL:
        assert flat_rows(got) == flat_rows(duck.sql(analysis.SQL[name]).df())


@pytest.fixture(scope="module")
def trades(spark):
    rows = [("A", "STOP", -1.0, "2024-01-01", "2024-01-03"), ("A", "TAKE", 5.0, "2024-01-01", "2024-01-02"), ("A", "TAKE", 0.0, None, "2024-01-02"), ("A", None, 2.0, "2024-01-01", "2024-01-09"), ("A", "", float("nan"), "2024-01-01", None), ("B", "STOP", None, "2024-01-01", "2024-01-02")]
    return spark.createDataFrame(rows, "symbol string, exit_reason string, pnl double, entry_time string, exit_time string").withColumns({c: F.col(c).cast("timestamp") for c in ("entry_time", "exit_time")})


def test_trade_analytics(trades):
    status, parts = analytics.trade_analytics(trades, ["symbol"], total_rows=6)
    assert status == "complete" and set(parts) == {"overall", "exit_reasons", "duration"}
    a, b = parts["overall"].orderBy("symbol").collect()
    assert (a.rows, a.trades, a.unmeasured, a.wins, a.losses, a.flat, a.net_pnl, a.profit_factor, a.payoff_ratio) == (5, 4, 1, 2, 1, 1, 6.0, 7.0, 3.5)
    assert (b.trades, b.net_pnl, b.win_rate, b.avg_win, b.gross_profit, b.profit_factor) == (0, None, None, None, 0.0, None)
    paths = {(r.symbol, r.exit_reason): r for r in parts["exit_reasons"].collect()}
    assert (paths["A", "TAKE"].place, paths["A", "TAKE"].share_of_gain, paths["A", "TAKE"].top_gain) == (1, pytest.approx(5 / 7), True)
    assert (paths["A", "(unlabelled)"].rows, paths["A", "(unlabelled)"].unmeasured, paths["A", "STOP"].share_of_gain, paths["B", "STOP"].top_gain) == (2, 1, None, False)
    held = {r.symbol: r for r in parts["duration"].collect()}["A"]
    assert (held.n_measured, held.n_unmeasured, held.median, held.max) == (3, 2, 2.0, 8.0)
    for total in (9, None):
        with pytest.raises(analytics.Partial):
            analytics.trade_analytics(trades, [], total_rows=total)
        assert analytics.trade_analytics(trades, [], total_rows=total, allow_partial=True)[0] == "truncated"


def test_screens(spark):
    rows = [(1, 1, 0.5), (1, 2, -0.5), (2, 1, 1.5), (2, 2, float("nan")), (3, 2, None), (3, 1, float("inf"))]
    results = spark.createDataFrame([(a, b, 7, c) for a, b, c in rows], "a int, b int, same int, sharpe double")
    report = analytics.screen_report(results, ["a", "b", "same"], "sharpe")
    d = report["distribution"].first()
    assert (d.n, d.n_finite, d.n_dropped, d.median, d.positive_rate) == (6, 3, 3, 0.5, pytest.approx(2 / 3))
    b = report["baseline"].first()
    want = spark.range(1).select(metrics.expected_max_sharpe(F.lit(1.0), F.lit(3))).first()[0]
    assert b.applicable and (b.dispersion, b.expected_best, b.observed_best) == (pytest.approx(1.0), pytest.approx(want), 1.5)
    assert (report["best"].first().a, report["best"].first().b) == (2, 1)
    g = {(r.param, r.value): (r.n, r.positive, r.median) for r in report["gradients"].collect()}
    assert g == {("a", 1.0): (2, 1, 0.0), ("a", 2.0): (1, 1, 1.5), ("b", 1.0): (2, 2, 1.0), ("b", 2.0): (1, 0, -0.5)}
    reason = lambda df, o="sharpe": analytics.noise_baseline(df, o).first().reason
    assert reason(results.withColumn("profit", F.col("sharpe")), "profit") == "no null" and reason(results.where("a = 3")) == "under two points"
    assert analytics.score_summary(results.where("a = 3"), "sharpe").first().median is None


def test_bootstrap_skill(spark):
    rng = np.random.default_rng(1)
    frame = lambda xs: spark.createDataFrame([(k, float(x)) for k, x in enumerate(xs)], "i long, ret double")
    good = analytics.skill_report(frame(rng.normal(0.01, 0.01, 80)), samples=99, block=4.0).first()
    assert good.verdict == "skill" and good.p_value == pytest.approx(0.01) and not good.flips and good.p_se == pytest.approx(math.sqrt(0.01 * 0.99 / 99))
    assert (good.block_length, good.n_obs, good.family_p) == (4.0, 80, None)
    assert analytics.skill_report(frame(rng.normal(-0.01, 0.01, 40)), samples=50, block=4.0).first().verdict == "luck"
    few = analytics.skill_report(frame([0.1] * 7), samples=50).first()
    assert (few.verdict, few.p_value, few.sufficient) == ("unknown", 1.0, False)
    x = rng.normal(0.0025, 0.01, 60)  # the best of its family
    family = spark.createDataFrame([(f"t{j}", k, float(v)) for j in range(12) for k, v in enumerate(x if j == 0 else rng.normal(-0.01, 0.01, 60))], "trial_id string, i long, ret double")
    report = analytics.skill_report(frame(x), family, samples=60, block=3.0).first()
    alone = sweep.null_p_value(frame(x), 60, 3.0, 0, 252.0).first()
    assert report.family_p >= report.p_value == pytest.approx(alone.p_value)


def test_cost_rules(spark):
    n, nan = F.lit(None).cast("double"), F.lit(float("nan"))
    row = spark.range(1).select(
        S.cost_parts(F.lit(-100.0), F.lit(10.0), F.lit(400.0), F.lit(0.02)).alias("a"), S.cost_parts(F.lit(100.0), F.lit(10.0), n, F.lit(0.02)).alias("b"), S.cost_parts(F.lit(100.0), F.lit(10.0), nan, F.lit(0.02)).alias("c"), S.cost_parts(F.lit(0.0), F.lit(10.0), F.lit(0.0), F.lit(0.02)).alias("d"),
        S.annual_cost_rate(F.lit(0.01), F.lit(0.0)).alias("never"), S.impact_coefficient(nan, F.lit(1e6), F.lit(1e6)).alias("k"), S.cost_curvature(F.lit(0.04), F.lit(0.25)).alias("bend"), S.cost_curvature(F.lit(0.0), F.lit(0.25)).alias("flat"), S.carry_cost(F.lit(-1000.0), F.lit(True), F.lit(0.5)).alias("carry"),
    ).first()
    assert row.a.asDict() == pytest.approx({"notional": 1000, "commission": 0.1, "spread_cost": 0.25, "impact_cost": 0.3 * 0.02 * 0.5 * 1000, "total": 3.35, "participation": 0.25, "capped": True})
    assert row.b == row.c and (row.b.impact_cost, row.b.participation, row.b.capped) == (0, math.inf, True)
    assert (row.d.total, row.d.participation, row.d.capped) == (0, 0, False)
    assert (row.never, row.k, row.bend, row.flat, row.carry) == (math.inf, 0, pytest.approx(0.06), None, pytest.approx(2.5))


def test_market_instants(spark):
    texts = ["2024-01-02", "2024-07-02", "2024-01-02T09:30", "2024-01-02T09:30:00Z", "2024-01-02T09:30:00+01:00", "soon", None]
    got = spark.createDataFrame(list(enumerate(texts)), "i int, t string").select(F.date_format(bars.market_instant(F.col("t")), "yyyy-MM-dd HH:mm").alias("at"), "i").orderBy("i").collect()
    assert [x["at"] for x in got] == ["2024-01-02 05:00", "2024-07-02 04:00", "2024-01-02 14:30", "2024-01-02 09:30", "2024-01-02 08:30", None, None]


def test_missing_windows(spark):
    of = lambda rows: spark.createDataFrame(rows, "timeframe string, symbol string, start string, end string").withColumns({c: F.col(c).cast("timestamp") for c in ("start", "end")})
    have = of([("1d", "A", "2024-01-01 05:00:00", "2024-01-10 05:00:00")])
    reads = of([("1d", "A", "2024-01-05 05:00:00", "2024-01-12 05:00:00"), ("1d", "A", "2024-01-08 05:00:00", "2024-01-15 05:00:00"), ("1h", "A", "2024-01-02 05:00:00", "2024-01-03 06:00:00"), ("1d", "B", "2024-01-03 05:00:00", "2024-01-04 05:00:00")])
    got = {(r.timeframe, r.symbol, str(r.start)[:10], str(r.end)[:10], r.first_date, r.last_date) for r in coverage.missing_windows(have, reads).collect()}
    assert got == {("1d", "A", "2024-01-10", "2024-01-15", "2024-01-03", "2024-01-15"), ("1d", "B", "2024-01-03", "2024-01-04", "2024-01-03", "2024-01-15"), ("1h", "A", "2024-01-02", "2024-01-03", "2024-01-02", "2024-01-04")}
    assert coverage.missing_windows(have, of([("1d", "A", "2024-01-02 05:00:00", "2024-01-03 05:00:00")])).isEmpty()


def test_cost_formulas_are_not_written_out_in_each_use(spark):
    plan = analysis.b_costs(spark, SF)._jdf.queryExecution().optimizedPlan().toString()
    assert plan.lower().count("sqrt(") <= 5
