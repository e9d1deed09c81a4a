"""Two-sided trades and reports on books and trials, against DuckDB and plain numbers."""

import json
from datetime import datetime, timedelta

import duckdb
import numpy as np
import pytest
from pyspark.sql import functions as F
from test_market import TABLES, flat_rows

from tidemark.operators import reporting, rounds, sweep
from tidemark.plans import reporting as plans
from tidemark.sources import ingest

SF = "/root/testdata/sf0.01"
DAY = datetime(2024, 1, 1)


@pytest.fixture(scope="module")
def duck():
    con = duckdb.connect()
    for t in TABLES:
        con.sql(f"create view {t} as select * from '{SF}/{t}.parquet'")
    return con


@pytest.mark.parametrize("name", sorted(plans.QUERIES))
def test_query_equals_sql(spark, duck, name):
    got = plans.QUERIES[name](spark, SF).toPandas()
    assert len(got) > 0
    assert flat_rows(got) == flat_rows(duck.sql(plans.SQL[name]).df())


def series(spark, rows):
    """(open, high, low, close, signal) as daily bars of one symbol."""
    return spark.createDataFrame([(DAY + timedelta(days=i), "A", *map(float, x[:4]), x[4]) for i, x in enumerate(rows)], "ts timestamp, symbol string, open double, high double, low double, close double, signal string")


def test_round_trips(spark):
    signals = ["BUY", "BUY", "SELL", "CLOSE_BUY", "CLOSE_SELL", None, "BUY", "CLOSE_BUY", "BUY"]
    b = series(spark, [(10 + i, 11 + i, 9 + i, 10.5 + i, s) for i, s in enumerate(signals)] + [(30, 31, 29, 30.5, "SELL")])
    got = [(r.side, (r.entry_time - DAY).days, r.entry_price, r.reference, (r.exit_time - DAY).days, r.exit_price, r.exit_reason) for r in rounds.round_trips(b).orderBy("entry_time").collect()]
    # The second BUY holds, SELL flips at one open, CLOSE_BUY does not end a short, the last BUY is still held at the last close.
    assert got == [("BUY", 1, 11.0, 10.5, 3, 13.0, "SIGNAL"), ("SELL", 3, 13.0, 12.5, 5, 15.0, "SIGNAL"), ("BUY", 7, 17.0, 16.5, 8, 18.0, "SIGNAL"), ("BUY", 9, 30.0, 18.5, 9, 30.5, "END_OF_PERIOD")]
    assert rounds.round_trips(b.where("false")).count() == 0


@pytest.mark.parametrize(
    "side, bar, hit",
    [
        ("BUY", (89, 120, 80, 100), (89.0, "STOP_LOSS")),  # opens beyond the stop
        ("BUY", (112, 120, 80, 100), (112.0, "TAKE_PROFIT")),  # opens beyond the target
        ("BUY", (100, 120, 80, 100), (90.0, "STOP_LOSS")),  # both within: the stop
        ("BUY", (100, 110.05, 95, 100), None),  # reached, but not by the margin
        ("BUY", (100, 110.2, 95, 100), (110.0, "TAKE_PROFIT")),
        ("BUY", (110.05, 111, 95, 100), (110.05, "TAKE_PROFIT")),  # no worse than the open
        ("SELL", (111, 120, 80, 100), (111.0, "STOP_LOSS")),
        ("SELL", (88, 120, 80, 100), (88.0, "TAKE_PROFIT")),
        ("SELL", (100, 120, 80, 100), (110.0, "STOP_LOSS")),
        ("SELL", (100, 105, 89.8, 100), (90.0, "TAKE_PROFIT")),
        ("SELL", (100, 105, 89.95, 100), None),
    ],
)
def test_brackets(spark, side, bar, hit):
    b = series(spark, [(100, 100, 100, 100, side), (100, 101, 99, 100, None), (*bar, None), (100, 101, 99, 100, None)])
    r = rounds.bracket_exits(rounds.round_trips(b), b, stop=0.1, take=0.1, margin_bps=10.0).first()
    assert (r.exit_price, r.exit_reason) == (hit or (100.0, "END_OF_PERIOD")) and (r.exit_time - DAY).days == (2 if hit else 3)


def test_signal_bar_knows_its_open(spark):
    b = series(spark, [(100, 100, 100, 100, "BUY"), (100, 101, 99, 100, "CLOSE_BUY"), (101, 150, 50, 100, None)])
    t = rounds.bracket_exits(rounds.round_trips(b), b, stop=0.1, take=0.1)
    assert t.first()["exit_reason"] == "SIGNAL"
    r = rounds.trade_records(t.withColumns({"size": F.lit(10.0), "entry_cost": F.lit(1.0), "exit_cost": F.lit(None).cast("double")}), b).first()
    assert (r.gross_pnl, r.cost, r.pnl, r.mae_pct, r.mfe_pct) == (10.0, 1.0, 9.0, 50.0, 50.0)


def test_scores_refuse_periods():
    with pytest.raises(ValueError):
        rounds.breakout_score(20, 20)


def test_capital_is_where_cost_takes_the_alpha(spark):
    h = spark.createDataFrame([("x", 0.5, 20.0, 1e6, 0.02, 0.01), ("x", -0.5, 50.0, 2e5, 0.03, 0.01), ("x", 0.0, 1.0, 1.0, 1.0, 0.01), ("none", 0.1, None, 1.0, 0.1, 0.01), ("flat", 0.1, 5.0, 1.0, 0.1, 0.0), ("thin", 1.0, 5.0, 1e-3, 9.0, 0.01), ("deep", 1.0, 5.0, 0.0, 0.1, 0.5)], "book string, weight double, price double, adv double, vol double, gross_alpha double")
    got = {r.book: r for r in reporting.largest_capital(h, ["book"], years=0.5).collect()}
    assert {k: v.status for k, v in got.items()} == {"x": "measured", "none": "no_priced_holdings", "flat": "no_edge", "thin": "below_search_floor", "deep": "above_search_ceiling"}
    net = lambda c: 0.01 - 4 * sum(w * (3.5e-4 + 0.3 * v * np.sqrt(w * c / p / a)) for w, p, a, v in ((0.5, 20, 1e6, 0.02), (0.5, 50, 2e5, 0.03)))
    low, high = 1e3, 1e12
    for _ in range(200):
        mid = (low + high) / 2
        low, high = (mid, high) if net(mid) > 0 else (low, mid)
    assert got["x"].capital == pytest.approx(low, rel=1e-9) and got["flat"].capital is None


def test_caps_and_moments_of_odd_books(spark):
    s = spark.createDataFrame([("a", 1.0, 0.0, 1.0), ("a", 2.0, 0.0, 1.0), ("b", 0.0, 1.0, 1.0), ("c", 10.0, -5.0, 6.0), ("c", None, 1.0, 1.0)], "k string, equity double, net double, gross double")
    got = {r.k: r for r in reporting.net_cap(s, ["k"], gross_cap=0.5).collect()}
    assert set(got) == {"a", "c"} and got["a"].no_tilt and got["a"].recommended is None and not got["a"].subsumed
    assert (got["c"].recommended, got["c"].subsumed, got["c"].signed_mean, got["c"].skipped, got["c"].thin) == (0.5, True, -0.5, 1, True)
    rows = [("a", DAY + timedelta(days=i), *x) for i, x in enumerate([(0.0, 0.0, 0.0), (100.0, 90.0, 100.0), (100.0, 90.0, 130.0), (120.0, 108.0, 121.0)])]
    m = spark.createDataFrame([(*x, 1.0, 1.0, 1) for x in rows], "k string, ts timestamp, equity_close double, equity_adverse double, equity_favourable double, gross double, net double, open_positions int")
    r = reporting.moments(m, ["k"]).first()
    assert (r.n_steps, r.adverse_pct, r.adverse_at.ts, r.favourable_pct, r.favourable_at.equity, r.closing_pct) == (4, 10.0, rows[1][1], 30.0, 130.0, 0.0)


def test_comparison_refuses(spark):
    t = spark.createDataFrame([("g", "a", 0, "walkforward", 1), ("g", "b", 0, "research", 1), ("g", "c", 0, "backtest", 2), ("g", "d", 0, None, 1), ("g", "e", 0, "optimize", 1), ("g", "a", 1, "backtest", 9)], "g string, id string, ts int, kind string, accounting int")
    day = lambda i: DAY + timedelta(days=i)
    s = spark.createDataFrame([(k, day(i), x) for i in range(80) for k, x in (("a", float(i % 7)), ("b", -2.0 * (i % 7)), ("c", 1.0 * i), ("e", 5.0))], "trial_id string, ts timestamp, ret double")
    got = {(r.a, r.b): r for r in reporting.compared(t, s, ["g"]).collect()}
    assert len(got) == 10 and {k: v.reason for k, v in got.items() if v.reason} == {("a", "c"): "accounting", ("b", "c"): "accounting", ("c", "e"): "accounting", ("a", "d"): "no_series", ("b", "d"): "no_series", ("c", "d"): "no_series", ("d", "e"): "no_series", ("a", "e"): "flat", ("b", "e"): "flat"}
    assert got["a", "b"].corr == pytest.approx(-1) and not got["a", "b"].unlike_basis and got["a", "e"].unlike_basis and got["a", "b"].overlap == 80
    across = {(r.a, r.b): r for r in reporting.compared(t, s, ["g"], across_accounting=True).collect()}
    assert across["a", "c"].status == "compared" and not across["a", "c"].comparable and across["a", "c"].low < across["a", "c"].corr < across["a", "c"].high


def test_fold_plan():
    start = DAY
    plan = sweep.fold_plan(start, start + timedelta(days=110), n_folds=4, embargo_days=5, holdout_days=5, anchored=False)
    assert [(k, s, (a - start).days, (b - start).days) for k, s, a, b in plan] == [(0, "is", 0, 20), (0, "oos", 25, 45), (1, "is", 20, 40), (1, "oos", 45, 65), (2, "is", 40, 60), (2, "oos", 65, 85), (3, "is", 60, 80), (3, "oos", 85, 105), (None, "holdout", 105, 110)]
    for bad in ({"train_days": 10}, {"holdout_days": 110}, {"train_days": 90, "test_days": 90}):
        with pytest.raises(ValueError):
            sweep.fold_plan(start, start + timedelta(days=110), **bad)


def test_holdings_file(spark, tmp_path):
    (tmp_path / "a.csv").write_text("symbol,weight\n x ,1\ny,3\n")
    (tmp_path / "b.json").write_text(json.dumps({"x": 1, "y": 3}, indent=1))
    (tmp_path / "none.csv").write_text("symbol,weight\nx,0\n")
    for name in ("a.csv", "b.json"):
        assert {r.symbol: r.weight for r in ingest.holdings_file(spark, f"file://{tmp_path}/{name}").collect()} == {"X": 0.25, "Y": 0.75}
    with pytest.raises(ValueError):
        ingest.holdings_file(spark, "weights.txt")
    with pytest.raises(Exception, match="sum to nothing"):
        ingest.holdings_file(spark, f"file://{tmp_path}/none.csv").collect()


def test_intervals_and_sessions(spark):
    span = lambda rows: spark.createDataFrame([(k, DAY + timedelta(days=a), None if b is None else DAY + timedelta(days=b)) for k, a, b in rows], "k string, start timestamp, end timestamp")
    left = span([("a", 0, 100), ("a", 5, 5), ("b", 0, 10), (None, 0, 10), ("c", 0, None)])
    right = span([("a", 90, 200), ("a", 100, 101), ("a", 40, 41), ("b", 10, 12), (None, 0, 10)])
    got = sorted(((r.from_ts - DAY).days, (r.to_ts - DAY).days) for r in reporting.overlaps(left, right, "k").collect())
    assert got == [(40, 41), (90, 100)]
    e = spark.createDataFrame([("f", i, x) for i, x in enumerate(["session_outcome", "session", "fill", "session", "session_outcome", "session_outcome", "session"])], "f string, seq int, event string")
    assert sorted((r.seq, r.outcome_seq) for r in reporting.sessions(e, ["f"]).collect()) == [(1, None), (3, 4), (6, None)]


def test_benchmark_first_step(spark):
    bars = spark.createDataFrame([(k, DAY + timedelta(days=i), 10.0 + i, 11.0 + i) for k, d in (("warm", 0), ("cold", 2)) for i in range(d, 6) if i != 4], "key string, ts timestamp, open double, close double")
    times = spark.createDataFrame([(k, DAY + timedelta(days=i)) for k in ("warm", "cold", "none") for i in range(1, 6)], "key string, ts timestamp")
    got = {(r.key, r.step): r.ret for r in reporting.benchmark_returns(times, bars).collect()}
    assert got["warm", 1] == pytest.approx(13 / 12 - 1) and got["cold", 1] is None and got["warm", 3] == 0.0 and got["warm", 4] == pytest.approx(16 / 14 - 1) and not any(k == "none" for k, _ in got)


def test_board_counts_each_trial_once(spark):
    t = spark.createDataFrame([("1", "walkforward", 2.0, None), ("2", "backtest", 9.0, None), ("3", "walkforward", 3.0, 1), ("4", "research", None, None), ("5", None, 2.0, None)], "id string, kind string, deflated_sharpe double, contaminated_at int").withColumns({"strategy": F.lit("s"), "universe_hash": F.lit("u"), "accounting": F.lit(1), "oos_sharpe": F.col("deflated_sharpe"), "n_trials_in_session": F.lit(3)})
    rows, counts = reporting.board(t)
    assert [(r.id, r["rank"]) for r in rows.orderBy("rank").collect()] == [("1", 1), ("5", 2)] and tuple(counts.first()) == (2, 1, 1, 1)
    with pytest.raises(ValueError):
        reporting.board(t, rank_by="pnl")


def test_yearly_stretches_are_cut_by_years(spark, monkeypatch):
    seen = []
    real = plans.reporting.overlaps
    monkeypatch.setattr(plans.reporting, "overlaps", lambda *a, **k: seen.append(k.get("every")) or real(*a, **k))
    assert plans.a_overlaps(spark, SF).count() > 0 and seen == ["year"]
