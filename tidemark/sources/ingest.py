"""Line-delimited JSON journals, ledgers and holdings as tables; broken lines are counted, not fatal."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from ..functions.scalars import ratio

LEDGER = "event string, ts string, v int, symbol string, side string, qty double, order_id string, decision_id string, status string, basis string, fill_price double, reason string"
JOURNAL = "tool string, run_id string, timestamp string, session_id string, inputs struct<strategy:string,symbols:array<string>,session_id:string>, result_summary map<string,double>, n_trials long"


def parsed(lines: DataFrame, schema: str, key: str) -> tuple[DataFrame, DataFrame]:
    """(value) text lines -> (rows of the schema with their line's `seq`, one row with the counts of good and malformed lines).

    A line is malformed if it is no JSON object or lacks the key. seq must come with the lines:
    a distributed read has no order of its own.
    """
    read = lines.withColumn("r", F.from_json("value", schema, {"mode": "PERMISSIVE"}))
    good = F.col("r").isNotNull() & F.col(f"r.{key}").isNotNull()
    counts = read.where(F.trim("value") != "").agg(F.count_if(good).alias("good"), F.count_if(~good).alias("malformed"))
    return read.where(good).select("seq", "r.*"), counts


def with_session(journal: DataFrame) -> DataFrame:
    """Trial lines with the strategy and symbols of their session's start line where they have none, and the trials of the round.

    n_trials counts up through a session; the round's own share is its step, 1 at least.
    """
    start = journal.where("tool = 'session_start'").groupBy("session_id").agg(F.min_by("inputs", "seq").alias("context"))
    w = Window.partitionBy("session_id").orderBy("seq")
    lines = journal.where("tool <> 'session_start'").join(start, "session_id", "left")
    step = F.greatest(F.coalesce(F.col("n_trials") - F.lag("n_trials").over(w), F.col("n_trials"), F.lit(1)), F.lit(1))
    return lines.select("seq", "session_id", "tool", "run_id", F.coalesce("inputs.strategy", "context.strategy").alias("strategy"), F.coalesce("inputs.symbols", "context.symbols").alias("symbols"), "result_summary", step.alias("n_trials_in_round"))


def versions(ledger: DataFrame) -> DataFrame:
    return ledger.groupBy("v").agg(F.count("*").alias("n"))


def holdings(rows: DataFrame) -> DataFrame:
    """(symbol, weight) -> weights that sum to 1; equal ones where none is given. Fails if the total is not positive."""
    w = F.coalesce("weight", F.lit(1.0)) if "weight" in rows.columns else F.lit(1.0)
    total = F.sum(w).over(Window.partitionBy())
    return rows.select(F.upper(F.trim("symbol")).alias("symbol"), F.when(total > 0, ratio(w, total)).otherwise(F.raise_error(F.lit("weights sum to nothing"))).alias("weight"))


def holdings_file(spark: SparkSession, path: str) -> DataFrame:
    """symbol, weight (summing to 1) of a CSV file with these columns or a JSON file of one object, symbol to weight. Other endings are refused; a total that is not positive fails the job."""
    if path.lower().endswith(".csv"):
        rows = spark.read.csv(path, header=True).select(F.trim("symbol").alias("symbol"), F.col("weight").cast("double").alias("weight"))
    elif path.lower().endswith(".json"):
        whole = spark.read.text(path, wholetext=True)
        rows = whole.select(F.explode(F.from_json("value", "map<string,double>")).alias("symbol", "weight"))
    else:
        raise ValueError(f"a holdings file must be .csv or .json: {path}")
    return holdings(rows)


def trades_payload(trades: DataFrame, most: int) -> tuple[DataFrame, int, bool]:
    """(the first `most` trades by exit time and then by all other columns, how many there are, whether some are left out)."""
    total = trades.count()
    rest = sorted(c for c in trades.columns if c != "exit_time")
    return trades.orderBy("exit_time", *rest).limit(most), total, total > most


def payload(trades: DataFrame, most: int = 5000) -> dict:
    """columns, rows (of the first `most` trades, as trades_payload takes them), total_rows, truncated: bounded by `most`, for a reader outside Spark."""
    first, total, truncated = trades_payload(trades, most)
    return {"columns": first.columns, "rows": [list(r) for r in first.collect()], "total_rows": total, "truncated": truncated}
