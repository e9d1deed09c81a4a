"""Replay of an append-only position ledger as aggregates; order is the record's own sequence number."""

from __future__ import annotations

from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from ..functions.scalars import slippage_bps

RESETS = ("close", "adopt", "flatten")


def net_positions(ledger: DataFrame) -> DataFrame:
    """(seq, symbol, event, side, qty, order_id, basis) -> symbol, position.

    The last reset of a symbol sets its position (adopt: its quantity, else 0) and later fills
    add to it. Of an order's cumulative fills the last counts, incremental ones add up.
    """
    reset = ledger.where(F.col("event").isin(*RESETS)).groupBy("symbol").agg(F.max("seq").alias("at"), F.max_by(F.when(F.col("event") == "adopt", F.col("qty")).otherwise(0.0), "seq").alias("base"))
    fills = ledger.where("event = 'fill'").join(reset.select("symbol", "at"), "symbol", "left").where(F.col("at").isNull() | (F.col("seq") > F.col("at")))
    signed = F.when(F.lower("side") == "sell", -F.col("qty")).otherwise(F.col("qty"))
    orders = fills.groupBy("symbol", "order_id").agg(
        F.coalesce(F.max_by(F.when(F.col("basis") != "incremental", signed), F.when(F.col("basis") != "incremental", F.col("seq"))), F.lit(0.0)).alias("last"),
        F.coalesce(F.sum(F.when(F.col("basis") == "incremental", signed)), F.lit(0.0)).alias("added"),
    )
    filled = orders.groupBy("symbol").agg(F.sum(F.col("last") + F.col("added")).alias("filled"))
    return filled.join(reset, "symbol", "full_outer").select("symbol", (F.coalesce("base", F.lit(0.0)) + F.coalesce("filled", F.lit(0.0))).alias("position"))


def reconcile(expected: DataFrame, actual: DataFrame, tolerance: float = 1e-6) -> DataFrame:
    """(symbol, position) twice -> rows that differ: missing, unexpected or quantity_drift."""
    e, a = expected.select("symbol", F.col("position").alias("expected")), actual.select("symbol", F.col("position").alias("actual"))
    both = e.join(a, "symbol", "full_outer").na.fill(0.0, ["expected", "actual"])
    differs = F.abs(F.col("expected") - F.col("actual")) > tolerance
    kind = F.when(F.abs("actual") <= tolerance, "missing").when(F.abs("expected") <= tolerance, "unexpected").otherwise("quantity_drift")
    return both.where(differs).withColumn("status", kind)


def execution_quality(fills: DataFrame) -> DataFrame:
    """(symbol, side, reference, fill_price, latency_ms) -> slippage and latency by symbol; negative latency is clock skew, counted apart."""
    s = slippage_bps(F.col("side"), F.col("reference"), F.col("fill_price"))
    good = F.when(F.col("latency_ms") >= 0, F.col("latency_ms"))
    return fills.withColumn("s", s).withColumn("l", good).groupBy("symbol").agg(F.count("*").alias("n"), F.avg("s").alias("avg_slippage"), F.median("s").alias("median_slippage"), F.max("s").alias("worst_slippage"), F.median("l").alias("median_latency"), F.count_if(F.col("latency_ms") < 0).alias("skewed"))


def outcomes(ledger: DataFrame) -> DataFrame:
    """Each intent with the event that follows it for its symbol."""
    w = Window.partitionBy("symbol").orderBy("seq")
    return ledger.withColumn("next_event", F.lead("event").over(w)).where("event = 'intent'").select("seq", "symbol", "next_event")
