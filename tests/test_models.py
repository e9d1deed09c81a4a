"""Split scans, moment solves, risk models and their queries against DuckDB and numpy."""

import tracemalloc

import duckdb
import numpy as np
import pytest
from pyspark.sql import functions as F

from test_market import TABLES, flat_rows
from tidemark.operators import factors, linear, risk, riskmodel, scan
from tidemark.plans import models

SF = "/root/testdata/sf0.01"


@pytest.fixture(scope="module")
def duck():
    con = duckdb.connect()
    for t in TABLES:
        con.sql(f"create view {t} as select * from '{SF}/{t}.parquet'")
    return con


@pytest.mark.parametrize("name", sorted(models.QUERIES))
def test_query_equals_sql(spark, duck, name):
    got = models.QUERIES[name](spark, SF).toPandas()
    assert len(got) > 0
    assert flat_rows(got) == flat_rows(duck.sql(models.SQL[name]).df())


@pytest.mark.parametrize("name", ["r_conditional_factor", "r_book_split"])
def test_ticks_are_read_once(spark, monkeypatch, name):
    from tidemark.sources import bars

    real, calls = bars.weekly, []
    monkeypatch.setattr(bars, "weekly", lambda *a: calls.append(a) or real(*a))
    df = models.QUERIES[name](spark, SF)
    assert len(calls) == 1
    # What it was read into was written, and the plan does not hold all plans before.
    plan = df._jdf.queryExecution().toString()
    assert "lineitem" not in plan and "InMemoryRelation" not in plan


def series(spark, symbol, values, step=3600):
    rows = [(1_700_000_000 + k * step, symbol, None if v is None else float(v)) for k, v in enumerate(values)]
    return spark.createDataFrame(rows, "ts long, symbol string, ret double").withColumn("ts", F.timestamp_seconds("ts"))


@pytest.mark.parametrize("decay", [0.5, 0.94, 0.999, 1.0])
def test_split_scan_equals_the_recursion(spark, decay):
    rng = np.random.default_rng(1)
    values = [None if k % 17 == 5 else v for k, v in enumerate(rng.normal(0, 0.02, 3000))]
    got = scan.ewma_variance(series(spark, "A", values).unionByName(series(spark, "B", values[:5])), decay=decay, min_obs=20, seconds=86400).orderBy("symbol", "i").collect()
    x = np.array([v for v in values if v is not None])
    want, v = [None] * 19, np.mean(x[:20] ** 2)
    want.append(v)
    for r in x[20:]:
        v = decay * v + (1 - decay) * r * r
        want.append(v)
    assert [r.variance for r in got[: len(x)]] == [w if w is None else pytest.approx(w, rel=1e-9) for w in want]
    assert [(r.symbol, r.variance) for r in got[len(x) :]] == [("B", None)] * 5


def test_one_symbol_runs_in_many_tasks(spark):
    rows = series(spark, "A", np.arange(4000) / 4000)
    tasks = lambda df: df.select(F.spark_partition_id().alias("p")).distinct().count()
    conf = {"spark.sql.shuffle.partitions": "16", "spark.sql.adaptive.coalescePartitions.enabled": "false", "spark.sql.autoBroadcastJoinThreshold": "-1"}
    before = {k: spark.conf.get(k) for k in conf}
    try:
        for k, v in conf.items():
            spark.conf.set(k, v)
        done = scan.running(rows, ["symbol"], "ts", {"n": ("count", F.col("ret")), "peak": ("max", F.col("ret")), "total": ("sum", F.col("ret"))}, 86400)
        assert tasks(done) > 4
        assert tasks(scan.ewma_variance(rows, decay=0.5, min_obs=20, seconds=86400)) > 4
        got = done.orderBy("ts").collect()
        assert [r.n for r in got] == list(range(1, 4001)) and [r.total for r in got] == pytest.approx(np.cumsum(np.arange(4000) / 4000))
    finally:
        for k, v in before.items():
            spark.conf.set(k, v)


def test_scans_take_nulls_and_no_rows(spark):
    rows = spark.createDataFrame([("A", 1, None), ("A", 2, 3.0), (None, 1, 2.0)], "symbol string, k int, v double").withColumn("ts", F.timestamp_seconds(F.col("k") * 100))
    got = {(r.symbol, r.k): (r.s, r.m) for r in scan.running(rows, ["symbol"], "ts", {"s": ("sum", F.col("v")), "m": ("max", F.col("v"))}, 100).collect()}
    assert got == {("A", 1): (None, None), ("A", 2): (3.0, 3.0), (None, 1): (2.0, 2.0)}
    assert scan.ewma_variance(series(spark, "A", [0.1]).limit(0)).count() == 0


def test_moment_fits_equal_least_squares(spark):
    rng = np.random.default_rng(2)
    rows, want = [], {}
    for g, (n, kind) in enumerate([(30, "full"), (30, "twice"), (4, "exact"), (3, "few"), (30, "flat"), (30, "holes")]):
        x, y = rng.normal(size=(n, 3)), rng.normal(size=n)
        if kind == "twice":
            x[:, 2] = 2 * x[:, 0] - x[:, 1]
        if kind == "flat":
            x[:, 1] = 5.0
        if kind == "holes":
            x[3, 0] = np.nan
        good = np.isfinite(x).all(axis=1)
        full = np.column_stack([np.ones(n), x])
        fit = y.copy()
        fit[good] = y[good] - full[good] @ np.linalg.lstsq(full[good], y[good], rcond=None)[0]
        for k in range(n):
            rows.append((g, f"s{k}", float(y[k]), *map(float, x[k])))
            want[g, f"s{k}"] = fit[k]
    df = spark.createDataFrame(rows, "ts long, symbol string, y double, a double, b double, c double").withColumn("ts", F.timestamp_seconds("ts"))
    for r in factors.neutralized(df, "y", ["a", "b", "c"]).withColumn("g", F.unix_timestamp("ts")).collect():
        assert r.residual == pytest.approx(want[r.g, r.symbol], abs=1e-7)


def test_factor_model_equals_numpy(spark):
    rng = np.random.default_rng(3)
    n, t = 9, 80
    x = np.column_stack([np.ones(n), rng.normal(size=(n, 2))])
    ret = rng.normal(0, 0.02, (t, n)) + rng.normal(0, 0.03, (t, 3)) @ x.T
    panel = spark.createDataFrame([(int(d), f"n{k}", float(ret[d, k])) for d in range(t) for k in range(n)], "ts long, symbol string, ret double").withColumn("ts", F.timestamp_seconds(F.col("ts") * 86400))
    exposures = spark.createDataFrame([(f"n{k}", float(x[k, 1]), float(x[k, 2])) for k in range(n)] + [("other", 1.0, 2.0)], "symbol string, u double, v double")
    f = ret @ x @ np.linalg.pinv(x.T @ x)
    e = ret - f @ x.T
    cov = np.cov(f, rowvar=False) * 252
    sigma = x @ cov @ x.T + np.diag(e.var(axis=0, ddof=1) * 252)
    model = riskmodel.factor_model(panel, exposures, ["u", "v"], 252.0)
    check = lambda m, s: [(r.i, r.j, pytest.approx(r.cov)) for r in riskmodel.assembled(m).orderBy("i", "j").collect()] == [(f"n{a}", f"n{b}", s[a, b]) for a in range(n) for b in range(a, n)]
    assert check(model, sigma)
    lam, m = 0.94, 60
    ew, d = f[:m].T @ f[:m] / m, np.mean(e[:m] ** 2, axis=0)
    for k in range(m, t):
        ew, d = lam * ew + (1 - lam) * np.outer(f[k], f[k]), lam * d + (1 - lam) * e[k] ** 2
    later = riskmodel.conditioned_model(model, "ewma", 252.0)
    assert check(later, x @ ew @ x.T * 252 + np.diag(d * 252))
    assert riskmodel.conditioned_model(model, "ewma", 252.0, min_obs=81) is model
    w = rng.normal(size=n)
    book = spark.createDataFrame([(f"n{k}", float(w[k])) for k in range(n)], "symbol string, weight double")
    split = riskmodel.model_split(later, book).first()
    assert split.factor == pytest.approx(w @ x @ ew @ x.T @ w * 252) and split.total == pytest.approx(split.factor + (d * w * w).sum() * 252)
    few = panel.where("symbol < 'n4'")
    assert riskmodel.projected(exposures.join(few.select("symbol").distinct(), "symbol"), ["u", "v"]).count() == 0


def test_attribution_parts_sum_to_the_total(spark):
    rng = np.random.default_rng(4)
    rows = [(g, f"s{k}", *map(float, rng.normal(size=6))) for g in range(5) for k in range(2 if g == 4 else 12)]
    df = spark.createDataFrame(rows, "ts long, symbol string, weight double, ret double, beta double, bench double, size double, score double").withColumn("ts", F.timestamp_seconds("ts"))
    plain = {r.ts: r for r in factors.attribution(df, ["size"]).collect()}
    for r in factors.attribution(df, ["size"], signal="score").collect():
        assert r.systematic + r.factor + r.signal + r.specific == pytest.approx(r.total)
        assert r.total == pytest.approx(plain[r.ts].total) and r.systematic == pytest.approx(plain[r.ts].systematic)
    assert {r.component for r in factors.attribution_report(factors.attribution(df, ["size"], signal="score"), 52.0).collect()} == {"systematic", "factor", "signal", "specific"}


def test_covariance_by_chunks_holds_a_quarter_of_the_panel_at_most(spark):
    n, size, count = 8, 256, 400
    full = n * size * count * 8

    def chunks():
        rng = np.random.default_rng(5)
        for _ in range(count):
            yield rng.normal(0.001, 0.02, (size, n))

    tracemalloc.start()
    rows, _, spread = risk.chunk_sums(chunks(), n)
    peak = tracemalloc.get_traced_memory()[1]
    tracemalloc.stop()
    assert rows == size * count and peak < full / 4
    assert np.allclose(spread / rows, np.cov(np.concatenate(list(chunks())), rowvar=False, ddof=0), atol=1e-12)
    assert risk.chunk_sums([], 2)[0] == 0


def test_evaluation_points_are_those_of_an_even_grid(spark):
    for t, k in ((200, 60), (75, 60), (63, 60), (62, 60), (150, 1)):
        x = np.random.default_rng(t).normal(0, 0.02, t)
        got = sorted(r.i for r in riskmodel.evaluation_points(series(spark, "A", x), n_points=k).collect())
        last = t - 2
        want = sorted(set(np.linspace(60, last, num=min(k, last - 60 + 1), dtype=int).tolist())) if last > 60 else []
        assert got == want


def test_completion_and_queries_of_a_matrix(spark):
    cov = spark.createDataFrame([("A", "A", 4.0), ("A", "B", 1.0), ("B", "B", 9.0), ("C", "C", 0.0)], "i string, j string, cov double")
    universe = spark.createDataFrame([("A",), ("D",), ("D",)], "symbol string")
    assert {(r.i, r.j): r.cov for r in riskmodel.completed(cov, universe).collect()}["D", "D"] == 4.0
    none = spark.createDataFrame([("Z", 1.0)], "symbol string, weight double")
    assert riskmodel.variance(cov, none).first().variance == 0.0
    assert {r.beta for r in riskmodel.implied_beta(cov, none).collect()} == {0.0} == {r.marginal for r in riskmodel.marginal(cov, none).collect()}
    assert {(r.i, r.j): r.rho for r in riskmodel.correlation(cov).collect()} == {("A", "A"): 1.0, ("A", "B"): 1 / 6, ("B", "B"): 1.0, ("C", "C"): 0.0}


def test_singular_systems_keep_the_first_columns(spark):
    df = spark.createDataFrame([(4.0, 2.0, 1.0, 8.0, 4.0)], "aa double, ab double, bb double, ya double, yb double")
    r = linear.solved(df, ["a", "b"], {("a", "a"): "aa", ("a", "b"): "ab", ("b", "b"): "bb"}, {"a": "ya", "b": "yb"}, {"a": "x", "b": "y"}).first()
    assert (r.x, r.y) == (2.0, 0.0)
