"""Streams against their batch twins, re-affirmed entries, labels, orders and folds on small cases."""

import time
from datetime import datetime

import pandas as pd
import pytest
from pyspark.sql import functions as F

from tidemark.functions import labels
from tidemark.operators import execution, research, scanners, trials, walkforward
from tidemark.streaming import signals

BAR = "ts string, symbol string, open double, high double, low double, close double, volume double"
EVENT = "symbol string, ts timestamp, kind string, side string, open double, high double, low double, close double, volume double"
BANDS = signals.Bands(0.2, 0.0, -0.2, 0.0)


def test_bands_pass_through_flat():
    state, seen = 0, []
    for score in (0.1, 0.3, None, 0.1, -0.5, -0.5, float("nan"), 0.5, 0.0):
        signal, state = signals.step(score, state, BANDS)
        seen.append((signal, state))
    assert seen == [("HOLD", 0), ("BUY", 1), ("HOLD", 1), ("HOLD", 1), ("CLOSE_BUY", 0), ("SELL", -1), ("HOLD", -1), ("CLOSE_SELL", 0), ("HOLD", 0)]
    assert signals.step(-0.5, 0, signals.Bands(0.2, 0.0, -0.2, 0.0, long_only=True)) == ("HOLD", 0)


def test_reaffirmed_entries_are_spent_once_held():
    assert signals.reaffirmed("HOLD", 1, None, None) == ("BUY", None)
    assert signals.reaffirmed("HOLD", 1, None, None, entries=False) == ("HOLD", None)
    assert signals.reaffirmed("HOLD", 1, "BUY", None) == ("HOLD", "BUY")
    assert signals.reaffirmed("HOLD", 1, None, "BUY") == ("HOLD", "BUY")
    assert signals.reaffirmed("HOLD", 0, None, "BUY") == ("HOLD", None)
    assert signals.reaffirmed("HOLD", -1, "BUY", "BUY") == ("CLOSE_BUY", None)
    assert signals.reaffirmed("HOLD", 0, "SELL", None, entries=False) == ("CLOSE_SELL", None)
    assert signals.reaffirmed("SELL", -1, None, "SELL") == ("SELL", "SELL")


def test_stream_equals_a_walk_over_each_buffer(spark, tmp_path):
    closes = [1.0, 1.5, 1.4, 0.9, 0.5, 0.9, 1.4, 1.3, 1.2, 0.7]
    rows = [("A", datetime(2024, 1, 1 + k), "history" if k < 2 else "bar", None, c, c, c, c, 1.0) for k, c in enumerate(closes)]
    rows.insert(6, ("A", datetime(2024, 1, 6, 1), "position", "BUY", None, None, None, None, None))
    rows.append(("B", datetime(2024, 1, 1), "bar", None, 1.0, 1.0, 1.0, 1.0, 1.0))
    # Two files, one micro-batch each, so that state is carried.
    for k, part in enumerate((rows[:5], rows[5:])):
        spark.createDataFrame(part, EVENT).coalesce(1).write.mode("append").parquet(str(tmp_path / "in"))
        if k == 0:
            time.sleep(1.1)  # files are read in order of their time
    scores = lambda b: b["close"].pct_change()
    out = signals.stream(spark.readStream.schema(EVENT).option("maxFilesPerTrigger", 1).parquet(str(tmp_path / "in")), scores, BANDS, lookback=3, buffer=4)
    query = out.writeStream.format("memory").queryName("desk_signals").outputMode("append").option("checkpointLocation", str(tmp_path / "check")).trigger(availableNow=True).start()
    assert query.awaitTermination(120)
    got = [(r.ts, r.signal, r.direction) for r in spark.table("desk_signals").orderBy("ts").collect()]

    wanted, buffer, held, spent = [], [], None, None
    for _, ts, kind, side, *_, close, _ in [r for r in rows if r[0] == "A"]:
        if kind == "position":
            held = side
            continue
        buffer = [*buffer, close][-4:]
        if kind == "bar" and len(buffer) >= 3:
            signal, direction = "HOLD", 0
            for value in pd.Series(buffer).pct_change():
                signal, direction = signals.step(value, direction, BANDS)
            signal, spent = signals.reaffirmed(signal, direction, held, spent)
            wanted.append((ts, signal if signals.valid(signal, held) else "HOLD", direction))
    assert got == wanted and len({s for _, s, _ in got}) > 2


def test_walk_keeps_state_between_arrow_batches(spark):
    rows = [(f"2024-01-{k + 1:02d}", s, 0.0, 0.0, 0.0, c, 0.0) for s in ("A", "B") for k, c in enumerate((0.3, 0.1, 0.1, -0.3, -0.3, 0.3))]
    bars = spark.createDataFrame(rows, BAR).withColumn("ts", F.col("ts").cast("timestamp"))
    before = spark.conf.get("spark.sql.execution.arrow.maxRecordsPerBatch")
    spark.conf.set("spark.sql.execution.arrow.maxRecordsPerBatch", 2)
    try:
        got = signals.walk(bars, "close", BANDS).orderBy("symbol", "ts").collect()
    finally:
        spark.conf.set("spark.sql.execution.arrow.maxRecordsPerBatch", before)
    assert [r.signal for r in got] == ["BUY", "HOLD", "HOLD", "CLOSE_BUY", "SELL", "CLOSE_SELL"] * 2
    assert signals.walk(bars.limit(0), "close", BANDS).count() == 0


def test_fills_in_any_order_as_stream_and_batch(spark, tmp_path):
    fills = spark.createDataFrame([("a", 3, "incremental", 2.0), ("a", 1, "incremental", 9.0), ("a", 2, "cumulative", 3.0), ("b", 1, None, 5.0), ("b", 2, None, 8.0), ("c", 1, "incremental", None)], "order_id string, seq long, basis string, qty double")
    want = {"a": 5.0, "b": 8.0, "c": 0.0}
    assert {r.order_id: r.filled_qty for r in signals.filled(fills).collect()} == want
    assert {r.order_id: r.filled_qty for r in execution.filled_quantity(fills).collect()} == want
    fills.repartition(6).write.parquet(str(tmp_path / "in"))
    stream = spark.readStream.schema(fills.schema).option("maxFilesPerTrigger", 1).parquet(str(tmp_path / "in"))
    query = signals.filled(stream).writeStream.format("memory").queryName("desk_fills").outputMode("complete").option("checkpointLocation", str(tmp_path / "check")).trigger(availableNow=True).start()
    assert query.awaitTermination(120)
    assert {r.order_id: r.filled_qty for r in spark.table("desk_fills").collect()} == want


def test_labels(spark):
    one = spark.range(1)
    family = lambda code, reason: one.select(labels.reason_family(F.lit(code).cast("string"), F.lit(reason).cast("string")).alias("f")).first().f
    assert [family("x", "y"), family(None, "halted - stop"), family("halted now", "halted now"), family(None, None), family("", "market is closed")] == ["x", "halted", "halted", "unknown", "market is closed"]
    keyed = one.select(labels.identity(F.create_map(F.lit("fast"), F.lit(3.0)), capital=F.lit(1000), spread=F.lit(None)).alias("p")).first().p
    assert keyed == {"fast": 3.0, "__capital__": 1000.0}


def test_prefixes_name_one_trial_or_none(spark):
    ids = spark.createDataFrame([("abcd1",), ("abcd2",), ("abce9",), ("ab%d1",)], "id string")
    refs = spark.createDataFrame([("abcd1",), ("abcd",), ("abce",), ("abc",), ("ab%d",), ("zzzz",)], "ref string")
    got = {r.ref: (r.id, r.n) for r in trials.resolved(ids, refs).collect()}
    assert got == {"abcd1": ("abcd1", 1), "abcd": (None, 2), "abce": ("abce9", 1), "abc": (None, 0), "ab%d": ("ab%d1", 1), "zzzz": (None, 0)}


def test_folds_without_rows_fail_their_gates(spark):
    columns = ["n", "total", "sharpe", "profit_factor", "max_drawdown", "trades", "benchmark"]
    empty = spark.createDataFrame([], ", ".join(["fold int", *[f"{t}_{c} double" for t in ("is", "oos") for c in columns]]))
    rows = walkforward.gates(walkforward.fold_summary(empty).withColumn("leakage_passed", F.lit(None).cast("boolean")).withColumn("deflated_sharpe", F.lit(None).cast("double"))).collect()
    assert not any(r.promotable for r in rows) and not any(r.passed for r in rows) and len(rows) == 6


def test_perturbed_stays_in_bounds():
    assert walkforward.perturbed({"a": 10, "b": 100}, {"a": (10, 20), "b": (1, 105)}) == [{"a": 10, "b": 100}, {"a": 10, "b": 100}, {"a": 11, "b": 100}, {"a": 10, "b": 90}, {"a": 10, "b": 105}]


def test_universe_falls_back_and_probe_without_rows(spark):
    names = spark.createDataFrame([("A",), ("B",)], "symbol string")
    pick = lambda flagged: sorted(r.symbol for r in scanners.resolved_universe(names.where(flagged), names).collect())
    assert pick("symbol = 'B'") == ["B"] and pick("false") == ["A", "B"]
    bars = spark.createDataFrame([], BAR).withColumn("ts", F.col("ts").cast("timestamp"))
    assert scanners.clock_probe(lambda b: b, bars, "2024-01-01").first().passed is None


@pytest.mark.parametrize("axis, costs", [("all", [3.0, 6.0]), ("turnover", [3.0, 5.0]), ("borrow", [3.0, 4.0])])
def test_stress_scales_its_axis_and_stops_at_the_first_failure(spark, axis, costs):
    t = spark.createDataFrame([("A", 4.0, 1.0, 0.5), ("B", 9.0, 1.0, 0.5)], "symbol string, gross double, turnover_cost double, carry_cost double")
    rows = execution.stressed(t, [1.0, 2.0], axis=axis).orderBy("multiple").collect()
    assert [r.cost for r in rows] == costs and [r.survives for r in rows] == [True, True]
    worse = execution.stressed(t.withColumn("gross", F.col("gross") - 8), [1.0, 5.0]).collect()
    assert not any(r.survives for r in worse)


def series(spark, rows, columns):
    return spark.createDataFrame(rows, columns)


def test_linking_survives_a_total_loss(spark):
    rows = series(spark, [("A", 1, 0.5, 0.5, 0.0, 0.1), ("A", 2, -1.0, -1.0, 0.0, 0.2), ("A", 3, 0.5, 0.5, 0.0, 0.4)], "k string, t int, active double, portfolio double, bench double, x double")
    got = research.linked(rows, ["k"], "t", ["x"]).first()
    assert got.linked_x == pytest.approx(0.1 + 0.2 * 1.5) and got.naive == pytest.approx(-1.0) and got.honest == pytest.approx(-1.0) and got.delta == pytest.approx(0.0)


def test_blend_rests_on_the_prior_without_data(spark):
    rows = series(spark, [("A", None), ("A", float("nan")), ("B", 0.1)], "k string, x double")
    got = {r.k: r for r in research.blended_stats(rows, ["k"], "x", per_year=4.0, prior=0.04, t0=3.0).collect()}
    assert (got["A"].periods, got["A"].mean, got["A"].vol, got["A"].ir, got["A"].t_stat) == (0, 0.0, pytest.approx(0.2), 0.0, 0.0)
    assert got["B"].vol == pytest.approx(0.2) and got["B"].t_stat == pytest.approx(0.5)


def test_case_test_needs_history_and_dispersion(spark):
    scores = series(spark, [(t, s, (t % 3 - 1) * (1.0 + k) * (1.05 if k == 1 else 1.0)) for t in range(40) for k, s in enumerate("ABCD")], "ts int, symbol string, score double")
    vols = series(spark, [(s, 1.0 + k) for k, s in enumerate("ABCD")], "symbol string, vol double")
    row = research.case_test(scores, vols, price_derived=False).first()
    assert row.case == 2 and row.r2 == pytest.approx(1.0, abs=0.02) and row.t_stat > 5
    flat = research.case_test(scores, vols.withColumn("vol", F.lit(1.0))).first()
    assert (flat.case, flat.why, flat.slope, flat.ambiguous) == (2, "no dispersion", 0.0, True)
    short = research.case_test(scores.where("ts < 10"), vols, price_derived=False).first()
    assert (short.case, short.why, short.n_obs) == (1, "insufficient history", 10)
    assert research.case_test(scores.where("false"), vols).first().why == "insufficient history"


def test_redundant_signals_share_their_weight(spark):
    rows = [(t, f"s{k}", float(k), float(k), float((k * 7 + t) % 5) + 0.3 * k) for t in range(30) for k in range(8)]
    panel = series(spark, rows, "ts int, symbol string, a double, b double, resid double")
    a, b = research.measured_signals(panel, ["a", "b"]).collect()
    assert a.weight == pytest.approx(b.weight) and a.periods == 30 and a.weight > 0
    assert [r.weight for r in research.measured_signals(panel.where("symbol < 's4'"), ["a", "b"]).collect()] == [0.0, 0.0]


def test_regimes_need_six_known_volatilities(spark):
    rows = series(spark, [(0.04, 0.01 * k, float(k)) for k in range(5)], "variance double, active double, vol double")
    assert research.error_by_regime(rows, 12.0).count() == 0
    assert {r.regime: r.n for r in research.error_by_regime(rows.unionAll(rows), 12.0).collect()} == {"low": 4, "mid": 4, "high": 2}


def test_references_send_no_ids_to_every_task(spark):
    ids, refs = spark.range(50).selectExpr("sha2(cast(id as string), 256) as id"), spark.range(50).selectExpr("substring(sha2(cast(id as string), 256), 1, 5) as ref")
    found = trials.resolved(ids, refs)
    assert found.where("id is not null").count() > 40 and "BroadcastHashJoin" not in found._jdf.queryExecution().toString()
