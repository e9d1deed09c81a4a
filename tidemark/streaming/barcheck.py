"""Bar-quality filter over a stream or a batch of bars.

A bar is held against the last one accepted for its symbol: reject, never repair, and a rejected
bar leaves the state as it was. That is a recursion, so it runs as keyed state: the same update
serves the stream (state kept between micro-batches) and the batch twin (kept between Arrow batches
of sorted bars, so that no symbol is held whole).
"""

from __future__ import annotations

from collections.abc import Iterator
from typing import Any

import pandas as pd
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql.streaming.state import GroupState, GroupStateTimeout

from ..functions.scalars import ohlc_fault

SPIKE = 0.35
VERDICTS = "symbol string, ts timestamp, close double, reason string"


def checked(bars: DataFrame, arrival: str | None = None, minutes: float | None = None, times: float = 3.0) -> DataFrame:
    """ts, symbol, close, volume, `fault`, the reason that a bar is broken by itself, and `late`: whether it is older on arrival than `times` bar lengths (false without an arrival column)."""
    late = F.lit(False) if arrival is None else is_late(arrival, minutes, times)
    return bars.select("ts", "symbol", "close", "volume", ohlc_fault(*[F.col(c) for c in ("open", "high", "low", "close", "volume")]).alias("fault"), late.alias("late"), *([arrival] if arrival and arrival not in ("ts", "symbol", "close", "volume") else []))


def is_late(arrival: str, minutes: float, times: float = 3.0) -> Column:
    return F.coalesce(F.unix_micros(F.col(arrival)) - F.unix_micros(F.col("ts")) > int(times * minutes * 60e6), F.lit(False))


def _judge(rows: pd.DataFrame, last_ts: Any, last_close: float | None, traded: bool) -> tuple[list, Any, float | None, bool]:
    reasons = []
    for ts, close, volume, fault, late in zip(rows["ts"], rows["close"], rows["volume"], rows["fault"], rows["late"], strict=True):
        if isinstance(fault, str):
            reason = fault
        elif last_ts is not None and ts <= last_ts:
            reason = "out_of_order"
        elif late:
            reason = "stale"
        elif last_close and abs(close / last_close - 1) > SPIKE:
            reason = "spike"
        elif volume == 0 and traded:
            reason = "zero_volume"
        else:
            reason, last_ts, last_close, traded = None, ts, close, traded or volume > 0
        reasons.append(reason)
    return reasons, last_ts, last_close, traded


def batch_verdicts(bars: DataFrame, order: str = "ts", arrival: str | None = None, minutes: float | None = None, times: float = 3.0) -> DataFrame:
    """One row a bar: symbol, ts, close and the reason of its rejection, null if accepted; bars of a symbol in `order`, then ts. With an arrival column, bars older than `times` lengths of `minutes` on arrival are stale."""

    def judge(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        # Symbols follow each other in a task; the state of the last one goes from batch to batch.
        last, state = None, (None, None, False)
        for rows in batches:
            rows = rows.assign(reason=None)
            reasons: list = []
            new = rows["symbol"].ne(rows["symbol"].shift()).to_numpy().cumsum() if len(rows) else []
            for _, own in rows.groupby(new, sort=False):
                symbol = own["symbol"].iloc[0]
                symbol = None if pd.isna(symbol) else symbol
                if (symbol,) != last:
                    last, state = (symbol,), (None, None, False)
                found, *state = _judge(own, *state)
                reasons += found
            yield rows.assign(reason=pd.Series(reasons, rows.index, dtype=object))[["symbol", "ts", "close", "reason"]]

    rows = checked(bars, arrival, minutes, times).repartition("symbol").sortWithinPartitions("symbol", F.col(order).asc_nulls_last(), "ts")
    return rows.mapInPandas(judge, VERDICTS)


def stream_verdicts(bars: DataFrame, arrival: str | None = None, minutes: float | None = None, times: float = 3.0, keep: str | None = None) -> DataFrame:
    """The same verdicts of a streaming frame, in order of arrival; state: last accepted time and close, and whether it has traded.

    `keep`, for a frame with a watermark on ts, lets a symbol's state go once the watermark has
    passed its last accepted bar by so long, and drops bars that come later than the watermark.
    Without it every symbol ever seen is kept.
    """
    order = [arrival, "ts"] if arrival else ["ts"]
    hold = None if keep is None else int(pd.Timedelta(keep).total_seconds() * 1000)

    def judge(key: tuple, batches: Iterator[pd.DataFrame], state: GroupState) -> Iterator[pd.DataFrame]:
        if state.hasTimedOut:
            state.remove()
            return
        last_ts, last_close, traded = state.get if state.exists else (None, None, False)
        last_ts = None if last_ts is None else pd.Timestamp(last_ts, unit="us")
        for rows in batches:
            rows = rows.sort_values(order, kind="stable")
            reasons, last_ts, last_close, traded = _judge(rows, last_ts, last_close, traded)
            yield rows.assign(reason=reasons)[["symbol", "ts", "close", "reason"]]
        state.update((None if last_ts is None else int(last_ts.value // 1000), last_close, bool(traded)))
        if hold is not None:
            low = state.getCurrentWatermarkMs()
            state.setTimeoutTimestamp(max(low + 1, (low if last_ts is None else int(last_ts.value // 1_000_000)) + hold))

    timeout = GroupStateTimeout.NoTimeout if hold is None else GroupStateTimeout.EventTimeTimeout
    return checked(bars, arrival, minutes, times).groupBy("symbol").applyInPandasWithState(judge, VERDICTS, "last_ts long, last_close double, traded boolean", "append", timeout)


def rejection_counts(verdicts: DataFrame) -> DataFrame:
    """Bars of each reason; accepted ones under 'accepted'."""
    return verdicts.groupBy(F.coalesce("reason", F.lit("accepted")).alias("reason")).agg(F.count("*").alias("n"))


#: The share and the number of rejections beyond which a feed is at fault.
ELEVATED_RATE, ELEVATED_COUNT = 0.05, 5


def rejection_report(verdicts: DataFrame, keys: list[str] | None = None) -> DataFrame:
    """keys, seen, rejected, rate, elevated (a feed that is mostly thrown away), by_reason (a map of counts): one row for each key, one in all without keys."""
    keys = keys or []
    per = verdicts.groupBy(*keys, "reason").agg(F.count("*").alias("n"))
    found = per.groupBy(*keys).agg(F.coalesce(F.sum("n"), F.lit(0)).alias("seen"), F.coalesce(F.sum(F.when(F.col("reason").isNotNull(), F.col("n"))), F.lit(0)).alias("rejected"), F.map_from_entries(F.array_sort(F.collect_list(F.when(F.col("reason").isNotNull(), F.struct("reason", "n"))))).alias("by_reason"))
    rate = F.when(F.col("seen") > 0, F.col("rejected") / F.col("seen")).otherwise(0.0)
    return found.select(*keys, "seen", "rejected", rate.alias("rate"), ((rate > ELEVATED_RATE) & (F.col("rejected") > ELEVATED_COUNT)).alias("elevated"), "by_reason")


def stale(bars: DataFrame, arrival: str, minutes: float, times: float = 3.0) -> DataFrame:
    """bars with `late`: older on arrival than so many bar lengths."""
    return bars.withColumn("late", is_late(arrival, minutes, times))
