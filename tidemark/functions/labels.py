"""Labels of recorded runs and decisions as columns."""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F

# What the Sharpe ratio of each kind of run measures, the kinds measured in sample,
# the metrics that need a benchmark, and the families of refusals recorded without a code.
SHARPE_BASIS = {
    "walkforward": "out-of-sample, aggregate over folds",
    "research": "out-of-sample, median fold",
    "backtest": "full window, in-sample",
    "optimize": "best of N candidates, in-sample",
}
IN_SAMPLE = ("optimize", "alpha", "backtest")
NEED_BENCHMARK = ("alpha", "beta", "r_squared", "information_ratio", "benchmark_buy_hold_return")
REFUSALS = {
    "book is full": "book_full",
    "gross exposure capped": "gross_exposure",
    "net exposure capped": "net_exposure",
    "risk budget exhausted": "risk_budget",
    "cannot check portfolio limits": "equity_unreadable",
    "halted": "halted",
}


def sharpe_basis(kind: Column) -> Column:
    """What a run's Sharpe ratio measures, null for a kind that has none."""
    out = F.lit(None).cast("string")
    for name, basis in SHARPE_BASIS.items():
        out = F.when(kind == name, basis).otherwise(out)
    return out


def in_sample(kind: Column) -> Column:
    return F.coalesce(kind.isin(*IN_SAMPLE), F.lit(False))


def unmeasured(metrics: list[str], benchmark: Column, treynor: Column) -> Column:
    """array<struct<metric,reason>> of those `metrics` whose stored 0 stands for no measurement; the flags count as true where null."""
    needs = [m for m in metrics if m in (*NEED_BENCHMARK, "treynor_ratio")]
    row = lambda name, why: F.struct(F.lit(name).alias("metric"), F.lit(why).alias("reason"))
    none = F.array().cast("array<struct<metric:string,reason:string>>")
    all_of = F.array(*[row(m, "no benchmark") for m in needs]) if needs else none
    one = F.array(row("treynor_ratio", "beta too close to zero")) if "treynor_ratio" in metrics else none
    return F.when(~F.coalesce(benchmark, F.lit(True)), all_of).when(~F.coalesce(treynor, F.lit(True)), one).otherwise(none)


def window_fault(start: Column, end: Column, now: Column) -> Column:
    """Why [start, end] is no research window (empty, reversed, future), null if it is one."""
    return F.when(end == start, "empty").when(end < start, "reversed").when(start >= now, "future")


def reason_family(code: Column, reason: Column) -> Column:
    """The family of a recorded decision: its code, else the one its message begins with, else the message."""
    text = F.coalesce(reason, F.lit(""))
    out = F.when(text == "", "unknown").otherwise(text)
    for prefix, family in reversed(REFUSALS.items()):
        out = F.when(text.startswith(prefix), family).otherwise(out)
    return F.when((F.coalesce(code, F.lit("")) != "") & (code != text), code).otherwise(out)


def identity(params: Column, **shape: Column) -> Column:
    """params (map<string,double>) with what else decides a run's result under reserved names, to be hashed as one; a null part is left out."""
    extra = F.map_from_entries(F.filter(F.array(*[F.struct(F.lit(f"__{k}__").alias("key"), v.cast("double").alias("value")) for k, v in shape.items()]), lambda e: e["value"].isNotNull()))
    return F.map_concat(params, extra)
