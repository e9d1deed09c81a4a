"""Scores to signals as keyed state: the three-state band rule, its stream with warm-up and re-affirmed entries, and fills as they arrive.

One walk over scores serves the batch (state kept between Arrow batches of sorted bars, so that no
symbol is held whole) and the stream (over a symbol's buffer of its last bars).
"""

from __future__ import annotations

import math
from collections.abc import Callable, Iterator
from dataclasses import dataclass

import pandas as pd
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql.streaming.state import GroupState, GroupStateTimeout

HOLD = "HOLD"
SIDES = {1: "BUY", -1: "SELL"}
BUFFER = 1000
BAR = ["open", "high", "low", "close", "volume"]
SIGNALS = "symbol string, ts timestamp, score double, signal string, direction int"


@dataclass(frozen=True)
class Bands:
    """Scores above enter_long open a long and keep it while above exit_long; the short side mirrors it."""

    enter_long: float
    exit_long: float
    enter_short: float
    exit_short: float
    long_only: bool = False


def step(score: float | None, state: int, bands: Bands) -> tuple[str, int]:
    """(signal, new direction) of one score; a missing score holds, and a turn to the other side closes first."""
    if score is None or math.isnan(score):
        return HOLD, state
    if state == 1 and score > bands.exit_long or state == -1 and score < bands.exit_short:
        return HOLD, state
    wanted = 1 if score > bands.enter_long else -1 if score < bands.enter_short and not bands.long_only else 0
    if wanted == state:
        return HOLD, state
    return (SIDES[wanted], wanted) if state == 0 else (f"CLOSE_{SIDES[state]}", 0)


def walk(bars: DataFrame, score: str, bands: Bands) -> DataFrame:
    """(ts, symbol, score) -> symbol, ts, score, signal, direction after it, bars of a symbol in order of ts."""

    def run(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        last, state = None, 0
        for rows in batches:
            signals, directions = [], []
            for symbol, value in zip(rows["symbol"].tolist(), rows["score"].tolist(), strict=True):
                if (symbol,) != last:
                    last, state = (symbol,), 0
                signal, state = step(value, state, bands)
                signals.append(signal)
                directions.append(state)
            yield rows.assign(signal=pd.Series(signals, rows.index, dtype=object), direction=pd.Series(directions, rows.index, dtype="int32"))

    return bars.select("symbol", "ts", F.col(score).cast("double").alias("score")).repartition("symbol").sortWithinPartitions("symbol", F.col("ts").asc_nulls_last()).mapInPandas(run, SIGNALS)


def reaffirmed(signal: str, direction: int, held: str | None, spent: str | None, entries: bool = True) -> tuple[str, str | None]:
    """(signal to send, spent side): re-states an edge that the book missed.

    A side is spent once the book has held it, until the score leaves that side; a spent entry is
    not repeated. Exits are always re-stated, entries only with `entries`.
    """
    wanted = SIDES.get(direction)
    spent = spent if spent == wanted else None
    spent = held if held is not None and held == wanted else spent
    if signal != HOLD or wanted == held:
        return signal, spent
    if held is not None:
        return f"CLOSE_{held}", spent
    return (wanted or HOLD) if entries and spent != wanted else HOLD, spent


def valid(signal: str, held: str | None) -> bool:
    """An exit needs the position it closes, an entry none of its own side."""
    return signal == f"CLOSE_{held}" if signal.startswith("CLOSE_") else signal == HOLD or held != signal


def stream(events: DataFrame, scores: Callable[[pd.DataFrame], pd.Series], bands: Bands, *, lookback: int, buffer: int = BUFFER, entries: bool = True) -> DataFrame:
    """Streaming events -> symbol, ts, score, signal, direction, a row for each bar once a symbol has `lookback` bars.

    events: symbol, ts, kind and open to volume. A `history` event only fills the buffer (warm-up).
    A `position` event sets the side the book holds, in `side` (null: flat), and a `spent` event
    marks that side's entry as taken or refused. A bar is appended to the symbol's last `buffer`
    bars, the scores of the buffer are walked anew, and the last signal is checked against the
    book. A tick is a bar of four equal prices. State: the buffer, the held and the spent side.
    """

    def run(key: tuple, batches: Iterator[pd.DataFrame], state: GroupState) -> Iterator[pd.DataFrame]:
        times, columns, held, spent = state.get if state.exists else ([], [[] for _ in BAR], None, None)
        times, columns, out = list(times), [list(c) for c in columns], []
        rows = pd.concat(list(batches)).sort_values("ts", kind="stable")
        for row in rows.itertuples(index=False):
            side = None if pd.isna(row.side) else row.side
            if row.kind == "position":
                held = side
                continue
            if row.kind == "spent":
                spent = side or spent
                continue
            times.append(row.ts.value // 1000)
            for name, values in zip(BAR, columns, strict=True):
                values.append(float(getattr(row, name)))
            del times[:-buffer]
            for values in columns:
                del values[:-buffer]
            if row.kind == "history" or len(times) < lookback:
                continue
            found = scores(pd.DataFrame(dict(zip(BAR, columns, strict=True)), index=pd.to_datetime(pd.Series(times), unit="us")))
            signal, direction = HOLD, 0
            for value in found.tolist():
                signal, direction = step(value, direction, bands)
            signal, spent = reaffirmed(signal, direction, held, spent, entries)
            out.append((key[0], row.ts, found.iloc[-1], signal if valid(signal, held) else HOLD, direction))
        state.update((times, columns, held, spent))
        yield pd.DataFrame(out, columns=["symbol", "ts", "score", "signal", "direction"]).astype({"direction": "int32", "score": "float64"})

    kept = "times array<long>, columns array<array<double>>, held string, spent string"
    return events.select("symbol", "ts", "kind", "side", *BAR).groupBy("symbol").applyInPandasWithState(run, SIGNALS, kept, "append", GroupStateTimeout.NoTimeout)


def warm_coverage(bars: DataFrame, asked: DataFrame, lookback: int) -> DataFrame:
    """One row: asked symbols, those with any bar (warmed), those with the whole lookback (sufficient)."""
    n = bars.groupBy("symbol").agg(F.count("*").alias("n"))
    return asked.select("symbol").distinct().join(n, "symbol", "left").agg(F.count("*").alias("asked"), F.count("n").alias("warmed"), F.count_if(F.col("n") >= lookback).alias("sufficient"))


def filled(fills: DataFrame) -> DataFrame:
    """order_id, filled_qty, n_fills of fills (order_id, seq, basis, qty), batch or stream, in whatever order they arrive.

    The last cumulative report and the incremental ones after it count. An order's reports, few
    by nature, are its state; the plan is an ordinary aggregate, so a stream updates it.
    """
    report = F.struct("seq", F.coalesce(F.col("basis") == "incremental", F.lit(False)).alias("inc"), F.coalesce("qty", F.lit(0.0)).alias("qty"))
    add: Callable[[Column, Column], Column] = lambda total, x: F.when(x["inc"], total + x["qty"]).otherwise(x["qty"])
    return fills.groupBy("order_id").agg(F.aggregate(F.array_sort(F.collect_list(report)), F.lit(0.0), add).alias("filled_qty"), F.count("*").alias("n_fills"))
