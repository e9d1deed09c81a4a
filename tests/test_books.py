"""The bar store's versions, event time in streams, equity of trades and resamples, against DuckDB and plain Python."""

import itertools
import math

import duckdb
import numpy as np
import pandas as pd
import pytest
from pyspark.sql import functions as F
from test_market import TABLES, flat_rows

from tidemark.operators import equity, reports
from tidemark.plans import books
from tidemark.sources import ingest, store, stream
from tidemark.streaming import barcheck

SF = "/root/testdata/sf0.01"
BAR = "ts string, symbol string, open double, high double, low double, close double, volume double"


@pytest.fixture(scope="module")
def duck():
    con = duckdb.connect()
    for t in TABLES:
        con.sql(f"create view {t} as select * from '{SF}/{t}.parquet'")
    return con


@pytest.mark.parametrize("name", sorted(books.QUERIES))
def test_query_equals_sql(spark, duck, name):
    got = books.QUERIES[name](spark, SF).toPandas()
    assert len(got) > 0
    assert flat_rows(got) == flat_rows(duck.sql(books.SQL[name]).df())


def bars_of(spark, *rows):
    return spark.createDataFrame([(ts, s, c, c, c, c, 1.0) for ts, s, c in rows], BAR).withColumn("ts", F.col("ts").cast("timestamp"))


def held(frame):
    return sorted((str(r.ts.date()), r.symbol, r.close) for r in frame.collect())


def test_store_rewrites_touched_partitions_alone_and_keeps_versions(spark, tmp_path, monkeypatch):
    s = store.BarStore(spark, f"file://{tmp_path}/s")
    assert s.read().count() == 0 and s.delete(bars_of(spark, ("2024-01-01", "A", 1.0)), "1Day") == 0
    first = [("2023-05-01", "A", 1.0), ("2023-05-01", "B", 2.0), ("2024-05-01", "A", 3.0), ("2025-05-01", "B", 4.0)]
    assert s.upsert(bars_of(spark, *first), "1Day") == 1
    folders = dict((m[:2], m[2]) for m in s.manifest())
    # A symbol's own years are rewritten, also those that it leaves; 2025 is not.
    assert s.replace(bars_of(spark, ("2024-06-01", "A", 9.0)), "1Day") == 2
    now = dict((m[:2], m[2]) for m in s.manifest())
    assert now["1Day", 2025] == folders["1Day", 2025] and now["1Day", 2023] != folders["1Day", 2023] and now["1Day", 2024] != folders["1Day", 2024]
    want = [("2023-05-01", "B", 2.0), ("2024-06-01", "A", 9.0), ("2025-05-01", "B", 4.0)]
    assert held(s.read("1Day")) == want and held(s.read(version=1)) == sorted(first) and s.read("1Hour").count() == 0
    # A write that is lost before it is published changes nothing.
    with monkeypatch.context() as m:
        m.setattr(store.BarStore, "_published", lambda *_: (_ for _ in ()).throw(RuntimeError("lost")))
        with pytest.raises(RuntimeError, match="lost"):
            s.upsert(bars_of(spark, ("2024-06-01", "A", 0.0), ("2026-01-01", "C", 1.0)), "1Day")
    assert held(s.read("1Day")) == want and s.versions() == [1, 2]
    assert s.upsert(bars_of(spark, ("2024-06-01", "A", 10.0)), "1Day") == 3
    # The last symbol of a year takes its partition with it.
    assert s.delete(spark.createDataFrame([("A",), ("no",)], "symbol string"), "1Day") == 4
    assert [m[1] for m in s.manifest()] == [2023, 2025] and held(s.read("1Day", years={2025})) == [("2025-05-01", "B", 4.0)]
    with pytest.raises(ValueError):
        s.manifest(9)


def test_store_lets_one_of_two_writers_publish(spark, tmp_path):
    s = store.BarStore(spark, f"file://{tmp_path}/s")
    s.upsert(bars_of(spark, ("2024-01-01", "A", 1.0)), "1Day")
    base, now = s._state()
    s.upsert(bars_of(spark, ("2024-01-02", "A", 2.0)), "1Day")
    with pytest.raises(store.Conflict):
        s._rewritten("1Day", base, now, {2024}, bars_of(spark, ("2024-01-03", "A", 3.0)))
    assert [x[2] for x in held(s.read())] == [1.0, 2.0]


def test_store_prunes_columns_and_years(spark, tmp_path):
    s = store.BarStore(spark, f"file://{tmp_path}/s")
    s.upsert(bars_of(spark, ("2023-01-01", "A", 1.0), ("2024-01-01", "A", 1.0)), "1Day")
    plan = s.read("1Day").where("year = 2024 and symbol = 'A'").select("close")._jdf.queryExecution().toString()
    assert "PartitionFilters" in plan and "PushedFilters: [IsNotNull(symbol), EqualTo(symbol,A)]" in plan and "ReadSchema: struct<symbol:string,close:double>" in plan


def feed(n=40):
    rows, base = [], pd.Timestamp("2024-01-01")
    for k in range(n):
        for s in ("A", "b"):
            ts = base + pd.Timedelta(minutes=5 * k)
            late = pd.Timedelta(minutes=40 if k % 9 == 4 or k == n - 1 else 1)
            price = 100.0 * (5.0 if k % 11 == 7 else 1.0) + k / 10
            rows.append((ts, s, price, price, price, price, float(k % 6 > 0), ts + late))
            if k % 8 == 3:
                rows.append((ts, s, price, price, price, price, 1.0, ts + pd.Timedelta(minutes=25)))
    return rows


def streamed(spark, tmp_path, rows, keep, parts):
    rows = sorted(rows, key=lambda r: (r[7], r[0]))
    frame = lambda part: spark.createDataFrame([tuple(v.to_pydatetime() if isinstance(v, pd.Timestamp) else v for v in x) for x in part], BAR.replace("ts string", "ts timestamp") + ", arrival timestamp")
    source = tmp_path / "in"
    for k, part in enumerate(parts(rows)):
        frame(part).coalesce(1).write.parquet(f"{source}/{k:03d}")
    bars = stream.bar_stream(spark, f"{source}/*", ["a ", "B"], watermark="2 hours" if keep else None, files=1, extra="arrival timestamp")
    out = f"{tmp_path}/out"
    query = barcheck.stream_verdicts(bars, "arrival", 5, keep=keep).writeStream.format("parquet").option("path", out).option("checkpointLocation", f"{tmp_path}/ck").outputMode("append").trigger(availableNow=True).start()
    query.awaitTermination()
    return sorted(map(str, map(tuple, spark.read.parquet(out).collect()))), frame(rows), [p.stateOperators[0].numRowsTotal for p in query.recentProgress if p.stateOperators]


def test_late_and_stale_bars_are_the_same_in_stream_and_batch(spark, tmp_path):
    got, rows, _ = streamed(spark, tmp_path, feed(), "1 day", lambda r: [r[:60], r[60:]])
    batch = barcheck.batch_verdicts(rows, order="arrival", arrival="arrival", minutes=5)
    assert got == sorted(map(str, map(tuple, batch.collect())))
    reasons = {r.reason: r.n for r in barcheck.rejection_counts(batch).collect()}
    assert {"accepted", "stale", "out_of_order", "spike", "zero_volume"} <= set(reasons)
    report = barcheck.rejection_report(batch).first()
    assert (report.seen, report.rejected) == (len(feed()), len(feed()) - reasons["accepted"]) and report.elevated and report.by_reason == {k: v for k, v in reasons.items() if k != "accepted"}
    assert barcheck.rejection_report(batch.limit(0), ["symbol"]).count() == 0


def test_state_goes_once_the_watermark_has_passed(spark, tmp_path):
    base = pd.Timestamp("2024-01-01")
    bar = lambda day, s, minutes=1: (base + pd.Timedelta(days=day), s, 1.0, 1.0, 1.0, 1.0, 1.0, base + pd.Timedelta(days=day, minutes=minutes))
    rows = [bar(0, "A"), bar(0, "B"), *[bar(d, "A") for d in range(1, 8)], bar(1, "B", 60 * 24 * 7)]
    got, _, held_rows = streamed(spark, tmp_path, rows, "1 day", lambda r: [[x] for x in r])
    assert max(held_rows) == 2 and held_rows[-1] == 1  # B's state is gone
    assert sum("'B'" in x for x in got) == 1  # its bar from behind the watermark is dropped


def test_subscription_is_a_filter(spark, tmp_path):
    with pytest.raises(Exception, match="PATH_NOT_FOUND|does not exist"):
        stream.bar_stream(spark, f"{tmp_path}/none", ["A"]).isStreaming  # noqa: B018
    bars_of(spark, ("2024-01-01", "A", 1.0), ("2024-01-01", "B", 1.0)).write.parquet(f"{tmp_path}/in")
    for symbols, want in ((["a"], ["A"]), ([], [])):
        name = f"sub{len(symbols)}"
        stream.bar_stream(spark, f"{tmp_path}/in", symbols).writeStream.format("memory").queryName(name).trigger(availableNow=True).start().awaitTermination()
        assert [r.symbol for r in spark.table(name).collect()] == want


def trades_of(spark, *rows):
    return spark.createDataFrame(rows, "symbol string, entry_time string, exit_time string, entry_price double, size double, pnl double").withColumns({c: F.col(c).cast("timestamp") for c in ("entry_time", "exit_time")})


def test_dated_equity_equals_a_business_day_resample(spark):
    rng = np.random.default_rng(1)
    base = pd.Timestamp("2024-03-02")  # a Saturday
    rows = [("A", str(base), str(base + pd.Timedelta(hours=int(h))), 1.0, 1.0, float(p)) for h, p in zip(rng.integers(0, 900, 40), rng.normal(0, 10, 40), strict=True)]
    got = equity.dated_equity(trades_of(spark, *rows, (None, "2024-01-01", "2024-01-03", 1.0, 1.0, 5.0)), ["symbol"], 100.0)
    frame = pd.DataFrame({"exit_time": pd.to_datetime([r[2] for r in rows]), "pnl": [r[5] for r in rows]})
    daily = frame.set_index("exit_time")["pnl"].resample("B").sum().fillna(0)
    want = pd.concat([pd.Series([100.0], [daily.index[0] - pd.offsets.BDay(1)]), 100.0 + daily.cumsum()])
    own = got.where("symbol = 'A'").orderBy("ts").collect()
    assert [pd.Timestamp(r.ts) for r in own] == list(want.index) and [r.equity for r in own] == pytest.approx(list(want))
    assert [r.equity for r in got.where("symbol is null").orderBy("ts").collect()] == [100.0, 105.0]


def test_exposure_is_a_union_of_holdings(spark):
    t = trades_of(spark, ("A", "2024-01-01", "2024-01-03", 1.0, 2.0, 1.0), ("A", "2024-01-02", "2024-01-02", 1.0, 2.0, -1.0), ("A", "2024-01-02", "2024-01-04", 1.0, 1.0, 2.0), ("A", "2024-01-06", "2024-01-07", 1.0, 1.0, 3.0), ("B", "2024-01-01", None, 1.0, 1.0, 1.0))
    got = {r.symbol: r.exposure for r in equity.exposure(t, ["symbol"], "2024-01-01", "2024-01-11").collect()}
    assert got == {"A": pytest.approx(0.4)}
    row = {r.symbol: r for r in equity.backtest_row(t, ["symbol"], capital=100.0, start="2024-01-01", end="2024-01-11").collect()}["A"]
    assert (row.n_trades, row.max_wins, row.max_losses, row.turnover, row.total_return, row.low_sample) == (4, 3, 1, pytest.approx(0.06), pytest.approx(5.0), True)
    assert row.exposure == pytest.approx(40.0) and row.max_drawdown <= 0
    assert equity.exposure(t, ["symbol"], "2024-01-01", "2024-01-01").first().exposure == 0.0


def test_block_resamples_equal_plain_blocks(spark):
    rng = np.random.default_rng(3)
    x = rng.normal(1, 5, 47)
    daily = spark.createDataFrame([("A", k, float(v)) for k, v in enumerate(x)] + [("B", 0, 1.0)] + [("C", k, 2.0) for k in range(25)], "symbol string, k long, pnl double").withColumn("ts", F.timestamp_seconds(F.col("k") * 86400))
    import hashlib

    want = []
    for sample in range(30):
        starts = [int(hashlib.md5(f"7:{sample}:{k}".encode()).hexdigest()[:8], 16) % (47 - 20 + 1) for k in range(3)]
        s = np.concatenate([x[i : i + 20] for i in starts])[:47]
        want.append((sample, pytest.approx(s.mean() / s.std(ddof=1) * math.sqrt(252)), pytest.approx(s.sum())))
    got = equity.block_resamples(daily, ["symbol"], samples=30, block=20, seed=7)
    assert [(r.sample, r.sharpe, r.total) for r in got.where("symbol = 'A'").orderBy("sample").collect()] == want
    report = {r.symbol: r for r in equity.monte_carlo(daily, ["symbol"], samples=30, block=20, seed=7).collect()}
    assert (report["B"].samples, report["B"].periods, report["B"].sharpe_p05) == (0, 1, None)
    assert (report["C"].sharpe_p50, report["C"].return_p05) == (0.0, 50.0)
    assert report["A"].sharpe_p05 <= report["A"].sharpe_p50


def test_horizon_bounds(spark):
    def fit(*rows):
        return reports.horizon_fit(spark.createDataFrame(rows, "lag int, mean_ic double")).first()

    exact = fit(*[(k, 0.1 * 0.5**k) for k in range(4)])
    assert exact.half_life == pytest.approx(1) and exact.half_life_upper == pytest.approx(1, abs=1e-4) and exact.delta == pytest.approx(0.5) and exact.peak_horizon == pytest.approx(1.8126, abs=1e-3)
    assert fit((1, 0.1), (2, -0.2)).delta is None and fit((1, 0.1), (2, -0.2)).r_squared == 0.0
    assert math.isinf(fit((1, 0.1), (2, 0.2)).half_life)
    two = fit((1, 0.2), (2, 0.1))
    assert two.slope_error is None and two.half_life_lower == two.half_life == two.half_life_upper
    rng = np.random.default_rng(5)
    noisy = [(k, float(0.1 * 0.8**k * math.exp(e))) for k, e in enumerate(rng.normal(0, 0.1, 8))]
    x, y = np.arange(8.0), np.log([v for _, v in noisy])
    slope, level = np.polyfit(x, y, 1)
    se = math.sqrt(((y - slope * x - level) ** 2).sum() / 6 / ((x - x.mean()) ** 2).sum())
    r = fit(*noisy)
    assert r.slope_error == pytest.approx(se) and r.half_life_upper == pytest.approx(-math.log(2) / (slope + 1.96 * se)) and r.half_life_lower == pytest.approx(-math.log(2) / (slope - 1.96 * se))
    curve = reports.cadence_curve(spark.createDataFrame([(0, 9.0), (1, 0.1), (2, 0.2), (8, 0.4)], "lag int, mean_ic double")).orderBy("lag").collect()
    assert [(r.lag, r.recommended) for r in curve] == [(1, False), (2, True), (8, False)]
    one = spark.range(1).select(*reports.blend_weights(F.lit(0.5), F.lit(0.5)), *reports.blend_weights(F.lit(0.3), F.lit(1.0))).first()
    assert tuple(one) == (1.0, 0.0, 1.0, 0.0)


def test_payload_is_the_same_in_every_run(spark):
    rows = [("A", "2024-01-01", "2024-01-02", 1.0, 1.0, float(p)) for p in itertools.chain(range(5), range(5))]
    got = ingest.payload(trades_of(spark, *rows).repartition(4), 3)
    assert [r[got["columns"].index("pnl")] for r in got["rows"]] == [0.0, 0.0, 1.0] and (got["total_rows"], got["truncated"]) == (10, True)


def test_streaks_go_on_from_month_to_month(spark):
    rng = np.random.default_rng(5)
    pnl = [None if x == 9 else float(np.sign(x - 2)) for x in rng.integers(0, 10, 400)]
    pnl[50:200] = [3.0] * 150
    rows = [(k, str(pd.Timestamp("2024-01-01") + pd.Timedelta(days=i)), p) for k in ("A", "B") for i, p in enumerate(pnl if k == "A" else [-1.0, None, -1.0, -1.0])]
    t = spark.createDataFrame(rows, "symbol string, exit_time string, pnl double").withColumn("exit_time", F.col("exit_time").cast("timestamp"))
    longest = lambda s: max((len(list(g)) for x, g in itertools.groupby([0 if p is None else (p > 0) - (p < 0) for p in pnl]) if x == s), default=0)
    got = {r.symbol: (r.max_wins, r.max_losses) for r in equity.streaks(t, ["symbol"]).collect()}
    assert got == {"A": (longest(1), longest(-1)), "B": (0, 2)} and longest(1) >= 150
