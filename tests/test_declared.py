"""Declarations and what they refuse, canonical JSON, and the journal, against DuckDB and plain Python."""

import hashlib
import json

import duckdb
import pytest
from pyspark.sql import functions as F
from test_market import TABLES, flat_rows

from tidemark import contracts
from tidemark.contracts import CROSSOVER, LIQUIDITY, VOLUME, Feature, Parameter, Scanner, Signal
from tidemark.functions import canonical
from tidemark.operators import sweep
from tidemark.plans import declared
from tidemark.sources import bars, journal

SF = "/root/testdata/sf0.01"


@pytest.fixture(scope="module")
def duck():
    con = duckdb.connect()
    for t in TABLES:
        con.sql(f"create view {t} as select * from '{SF}/{t}.parquet'")
    return con


@pytest.mark.parametrize("name", sorted(declared.QUERIES))
def test_query_equals_sql(spark, duck, name):
    got = declared.QUERIES[name](spark, SF).toPandas()
    assert len(got) > 0
    assert flat_rows(got) == flat_rows(duck.sql(declared.SQL[name]).df())


@pytest.mark.parametrize(
    ("params", "says"),
    [({"fats": 4}, "did you mean 'fast'"), ({"fast": 4.5}, "whole number"), ({"fast": True}, "is a number"), ({"fast": "4"}, "is a number"), ({"fast": 1}, "outside 2 to 60"), ({"fast": 40, "slow": 12}, "fast < slow"), ({"fast": float("nan")}, "is a number")],
)
def test_wrong_parameters_are_refused(params, says):
    with pytest.raises(ValueError, match=says):
        CROSSOVER.resolved(params)


def test_wrong_declarations_are_refused(spark):
    p = {"n": Parameter(2, 10, 1, 4)}
    score = lambda x: x["m"]
    for make, says in (
        (lambda: Feature("smaa", {"column": "close", "n": 3}), "did you mean 'sma'"), (lambda: Feature("sma", {"column": "close"}), "needs n"), (lambda: Feature("sma", {"colum": "close", "n": 3}), "did you mean 'column'"),
        (lambda: Signal("s", p, {"n": Feature("step")}, score=score), "both a parameter and a feature"), (lambda: Signal("s", p, {}), "no score"), (lambda: Signal("s", p, {}, score=score, enter=0.1, leave=0.2), "above enter"),
        (lambda: Signal("s", p, {}, (("n", "<", "m"),), score=score), "no parameter 'm'"), (lambda: Signal("s", p, {}, (("n", "=<", 3),), score=score), "no operator"), (lambda: Signal("s", p, {}, (("n", ">", 4),), score=score), "needs n > 4"),
        (lambda: Scanner("s", p, {}, strength=score), "no hit"), (lambda: Signal("s", {"n": Parameter(2, 10, 1, 40)}, {}, score=score), "outside"),
    ):
        with pytest.raises(ValueError, match=says):
            make()
    odd = Signal("s", p, {"m": Feature("sma", {"column": "closing", "n": "n"})}, score=score)
    with pytest.raises(ValueError, match="did you mean 'close'"):
        odd.compiled(spark.createDataFrame([], bars.SCHEMA))
    with pytest.raises(ValueError, match="parameter of volume"):
        VOLUME.points(tines=[2])


def test_a_search_space_holds_valid_points_alone():
    points = CROSSOVER.points(fast=[4, 8, 30], slow=[8, 20])
    assert points == [{"fast": 4, "slow": 8}, {"fast": 4, "slow": 20}, {"fast": 8, "slow": 20}]
    assert LIQUIDITY.points(lookback=[10], least=[1.0], keeping=[0.5], recent=[3, 20]) == [{"lookback": 10, "recent": 3, "least": 1.0, "keeping": 0.5}]
    assert len(CROSSOVER.points(fast=[4])) == 98 and Parameter(0, 1, 0.25, 0.5, whole=False).values() == [0, 0.25, 0.5, 0.75, 1.0]


def test_a_declared_crossover_is_the_sweep_and_reads_bars_once(spark):
    b = bars.weekly(spark, SF)
    got = CROSSOVER.swept(b, CROSSOVER.points(fast=[4, 8], slow=[12, 26]), 52.0)
    want = sweep.crossover_sweep(b, [4, 8], [12, 26], 52.0)
    assert flat_rows(got.toPandas()) == flat_rows(want.toPandas())
    assert got._jdf.queryExecution().sparkPlan().toString().count("lineitem.parquet") == 1


def test_short_bands_and_nulls(spark):
    s = Signal("s", {}, {"m": Feature("sma", {"column": "close", "n": 1})}, score=lambda x: x["m"], enter=1.0, leave=0.5, long_only=False)
    closes = [None, 0.7, 1.2, 0.7, None, 0.4, -1.5, -0.7, -0.5, 3.0]
    rows = spark.createDataFrame([(f"2024-01-{k + 1:02d}", "A", c, c, c, c, 1.0) for k, c in enumerate(closes)], bars.SCHEMA.replace("ts timestamp", "ts string")).withColumn("ts", F.col("ts").cast("timestamp"))
    assert [r.held for r in s.compiled(rows).orderBy("ts").collect()] == [0, 0, 1, 1, 1, 0, -1, -1, 0, 1]
    assert [r.signal for r in VOLUME.compiled(rows.limit(0)).collect()] == []


def test_json_keys_tell_values_apart_and_spellings_together(spark):
    same = ['{"a": 1, "b": {"c": [1, 2.0, true], "d": "é"}}', '{"b":{"d":"\\u00e9","c":[1.0,2,true]},"a":1.0000000001}']
    other = ['{"a": true, "b": {"c": [1, 2.0, true], "d": "é"}}', '{"a": "1", "b": {"c": [1, 2, true], "d": "é"}}', '{"a": 1, "b": {"c": [2, 1, true], "d": "é"}}', '{"a=1;b": 2}', '{"a": "1;b=2"}', "[]", '"x"', "{}", "[null]", '{"a": -0.0}', '{"a": null}']
    odd = [None, "", "{broken", "nope", "[" * 5000 + "]" * 5000]
    rows = spark.createDataFrame([(k, t) for k, t in enumerate([*same, *other, *odd])], "k int, t string")
    got = [(r.c, r.h) for r in rows.select("k", canonical.canonical_json(F.col("t")).alias("c"), canonical.json_key(F.col("t")).alias("h")).orderBy("k").collect()]
    assert got[0] == got[1] and len({h for _, h in got[: len(same) + len(other)]}) == len(other) + 1
    value = {"a": 1.0, "b": {"c": [1.0, 2.0, True], "d": "é"}}
    assert got[0][1] == hashlib.sha256(json.dumps(value, sort_keys=True, separators=(",", ":")).encode()).hexdigest()
    assert [c for c, _ in got[-5:-1]] == [None] * 4 and got[-5][1] == got[2 + other.index("{}")][1] and got[-4][1] is None


def test_journal_carries_sessions_on(spark):
    lines = [
        {"tool": "research:trial", "run_id": "early", "inputs": {"session_id": "s", "n_trials_cumulative": 3}},
        {"tool": "research:session_start", "inputs": {"session_id": "s", "strategy": "one", "symbols": ["A", "B"], "research_window": {"start": "x", "end": "y"}, "seed": 5}},
        {"tool": "research:trial", "run_id": "a", "inputs": {"session_id": "s", "n_trials_cumulative": 4, "oos_aggregate": {"sharpe_ratio": 1}}},
        {"tool": "research:trial", "run_id": "b", "inputs": {"session_id": "s", "oos_sharpe": 2.5, "oos_aggregate": {"sharpe_ratio": 1}}},
        {"tool": "research:trial", "run_id": "c", "inputs": {"session_id": "s", "n_trials_cumulative": 9, "strategy": "made"}},
        {"tool": "research:trial", "run_id": "c2", "inputs": {"session_id": "s", "n_trials_cumulative": 9}},
        {"tool": "research:session_start", "inputs": {"session_id": "s", "strategy": "two"}},
        {"tool": "research:trial", "run_id": "d", "inputs": {"session_id": "s", "n_trials_cumulative": 2}},
        {"tool": "research:trial", "run_id": "alone", "inputs": {"n_trials_cumulative": 7}},
        {"tool": "trial:walk", "run_id": "t", "inputs": {"strategy": "x", "symbols": ["Q"]}, "resolved_config": {"b": 1, "a": "k=v;"}, "result_summary": {"total_trades": 4}, "n_trials": 6, "promotable": True},
        {"tool": "trials:contaminated", "inputs": {"trial_ids": ["t", "late"], "reason": "seen"}},
        {"tool": "trial:walk", "run_id": "late", "inputs": {"strategy": "x"}},
        {"tool": "trial:walk", "inputs": {"strategy": "no id"}},
        {"tool": "chat", "run_id": "no"},
    ]
    text = [(k, json.dumps(v)) for k, v in enumerate(lines)] + [(90, "{broken"), (91, "  "), (92, "[1]"), (93, None)]
    table = spark.createDataFrame(text, "seq long, value string").repartition(3)
    got = {r.id: r for r in journal.trials(table).collect()}
    assert set(got) == {"early", "a", "b", "c", "c2", "d", "alone", "t", "late"}
    assert [(got[k].strategy, got[k].n_trials, got[k].orphan) for k in ("early", "a", "b", "c", "c2", "d", "alone")] == [(None, 3, True), ("one", 4, False), ("one", None, False), ("made", 5, False), ("one", 1, False), ("two", 2, False), (None, 7, True)]
    assert (got["a"].symbols, got["a"].window_end, got["a"].seed, got["a"].oos_sharpe, got["b"].oos_sharpe) == (["A", "B"], "y", 5, 1.0, 2.5)
    t = got["t"]
    assert (t.kind, t.params, t.symbols, t.oos_trades, t.promotable, t.spoilt, got["late"].spoilt) == ("walk", '{"a":"k=v;","b":1.0}', ["Q"], 4, True, "seen", None)
    counts = journal.lines(table)[1].first()
    assert (counts.good, counts.malformed) == (len(lines), 2)


def test_risk_features_fall_back(spark):
    rows = [(f"2024-01-{k + 1:02d}", s, c, c, c, c, 1.0) for s, cs in (("A", [1.0, 1.0, 1.0]), ("B", [1.0, 2.0, 1.0])) for k, c in enumerate(cs)]
    b = spark.createDataFrame(rows, bars.SCHEMA.replace("ts timestamp", "ts string")).withColumn("ts", F.col("ts").cast("timestamp"))
    got = {r.symbol: r for r in contracts.risk_features(b, None, 252.0).collect()}
    assert (got["A"].residual_vol, got["A"].beta, got["A"].benchmark_available) == (0.2, 1.0, False) and got["B"].residual_vol > 1
