"""Orders from decision to fill, what execution cost, and open positions at market prices."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from ..functions.labels import reason_family
from ..functions.scalars import ratio, slippage_bps
from .trades import during

# The limits of the execution checks, in percent, and the least book of more than one name.
LIMITS = {"rounding_drag": 10.0, "unfillable_entries": 5.0, "cost_share_of_gross": 40.0}
LEAST_BOOK = 2.0


def filled_quantity(fills: DataFrame) -> DataFrame:
    """(order_id, seq, basis, qty, ...) -> order_id, filled_qty, n_fills, last (the row of the highest seq).

    A cumulative report is the whole truth so far; incremental ones after it add to it. A report
    without a basis is cumulative.
    """
    inc = F.coalesce(F.col("basis") == "incremental", F.lit(False))
    rest = [c for c in fills.columns if c != "order_id"]
    qty = F.coalesce(F.col("qty"), F.lit(0.0))
    marked = fills.withColumn("__at", F.max(F.when(~inc, F.col("seq"))).over(Window.partitionBy("order_id")))
    counts = F.col("__at").isNull() | (F.col("seq") >= F.col("__at"))
    return marked.groupBy("order_id").agg(F.coalesce(F.sum(F.when(counts, qty)), F.lit(0.0)).alias("filled_qty"), F.count("*").alias("n_fills"), F.max_by(F.struct(*rest), "seq").alias("last"))


def lifecycles(ledger: DataFrame) -> DataFrame:
    """(seq, event, ts, symbol, side, qty, order_id, decision_id, basis, fill_price, reference_price, reason) -> one row an order.

    The last intent of an order id and the last decision of a decision id count. Orders without a
    fill have filled_qty 0 and no price; without a decision the time runs from the intent.
    """
    last = lambda rows, key: rows.where(F.col(key).isNotNull()).groupBy(key).agg(F.max_by(F.struct(*[c for c in rows.columns if c != key]), "seq").alias("r")).select(key, "r.*")
    intents = last(ledger.where("event = 'intent'").select("order_id", "seq", "decision_id", "symbol", "side", F.col("qty").alias("submitted_qty"), "reference_price", F.col("ts").alias("submitted_at")), "order_id")
    decisions = last(ledger.where("event = 'decision'").select("decision_id", "seq", F.col("ts").alias("__decided"), "reason"), "decision_id").drop("seq")
    fills = filled_quantity(ledger.where("event = 'fill' and order_id is not null").select("order_id", "seq", "basis", "qty", "ts", "fill_price"))
    rows = intents.drop("seq").join(decisions, "decision_id", "left").join(fills, "order_id", "left").withColumn("decided_at", F.coalesce("__decided", "submitted_at"))
    return rows.select(
        "order_id", "decision_id", "symbol", "side", "submitted_qty", F.coalesce("filled_qty", F.lit(0.0)).alias("filled_qty"), "reference_price", F.col("last.fill_price").alias("fill_price"),
        slippage_bps(F.col("side"), F.col("reference_price"), F.col("last.fill_price")).alias("slippage_bps"), "decided_at", "submitted_at", F.col("last.ts").alias("filled_at"),
        (F.unix_millis("last.ts") - F.unix_millis("decided_at")).alias("decision_to_fill_ms"), F.coalesce("n_fills", F.lit(0)).alias("n_fills"), "reason",
    )


def execution_report(orders: DataFrame, keys: tuple[str, ...] = ()) -> DataFrame:
    """Slippage, latency and fills of lifecycles, a row for each key: negative latency is clock skew, counted apart; the fill ratio is null where nothing was submitted."""
    slip, ms, asked, got = F.col("slippage_bps"), F.col("decision_to_fill_ms"), F.abs("submitted_qty"), F.abs("filled_qty")
    forward = F.when(ms >= 0, ms)
    has = F.coalesce(got > 0, F.lit(False))
    submitted, filled = F.coalesce(F.sum(asked * F.col("reference_price")), F.lit(0.0)), F.coalesce(F.sum(F.when(has, got * F.col("fill_price"))), F.lit(0.0))
    return orders.groupBy(*keys).agg(
        F.count("*").alias("n_orders"), F.count_if(has).alias("n_filled"), F.count_if(~has).alias("n_unfilled"), F.count_if(has & (got < asked - 1e-9)).alias("n_short"), F.count_if(F.col("n_fills") > 1).alias("n_multi_print"),
        F.count(slip).alias("n_measured"), F.avg(slip).alias("mean_bps"), F.median(slip).alias("median_bps"), F.max(slip).alias("worst_bps"), F.min(slip).alias("best_bps"), F.max_by("symbol", F.when(slip.isNotNull(), F.struct(slip, F.col("symbol")))).alias("worst_symbol"),
        F.count(forward).alias("n_timed"), F.count_if(ms < 0).alias("n_clock_skew"), F.median(forward).alias("median_ms"), F.max(forward).alias("worst_ms"),
        submitted.alias("submitted_notional"), filled.alias("filled_notional"), ratio(filled, submitted).alias("fill_ratio"),
    )


def declines(ledger: DataFrame) -> DataFrame:
    """(seq, event, allowed, reason_code, reason) -> family, n, example: the decisions not allowed, by family, with the first message of each."""
    refused = ledger.where("event = 'decision' and not coalesce(allowed, false)")
    return refused.groupBy(reason_family(F.col("reason_code"), F.col("reason")).alias("family")).agg(F.count("*").alias("n"), F.min_by("reason", "seq").alias("example"))


def execution_checks(books: DataFrame, keys: list[str], limits: dict[str, float] | None = None) -> DataFrame:
    """keys, drag_pct, unfillable_pct, max_positions, universe, gross_profit, cost -> keys, check, value, threshold, passed: only the checks that apply.

    Cost is judged against a positive gross profit, breadth in a universe of more than one name.
    """
    limit = LIMITS | (limits or {})
    row = lambda name, value, most, ok, when=None: F.when(F.lit(True) if when is None else when, F.struct(F.lit(name).alias("check"), value.cast("double").alias("value"), F.lit(most).alias("threshold"), ok.alias("passed")))
    below = lambda name, value, when=None: row(name, value, limit[name], value <= limit[name], when)
    places = F.col("max_positions")
    found = F.array(
        below("rounding_drag", F.col("drag_pct")), below("unfillable_entries", F.col("unfillable_pct")),
        row("book_breadth", places, LEAST_BOOK, places >= LEAST_BOOK, places.isNotNull() & (F.col("universe") > 1)),
        below("cost_share_of_gross", ratio(F.col("cost"), F.col("gross_profit")) * 100, F.col("gross_profit") > 0),
    )
    return books.select(*keys, F.inline(F.array_compact(found)))


def prerequisites(checks: DataFrame) -> DataFrame:
    """(check, value, threshold, direction: >=, >, <=) -> with evaluated, passed: a missing value is not evaluated and does not pass."""
    v, t = F.col("value"), F.col("threshold")
    ok = F.when(F.col("direction") == ">=", v >= t).when(F.col("direction") == ">", v > t).when(F.col("direction") == "<=", v <= t)
    return checks.withColumn("evaluated", v.isNotNull()).withColumn("passed", F.coalesce(ok, F.lit(False)))


def verdict(checks: DataFrame, keys: list[str]) -> DataFrame:
    """keys, check, passed, evaluated -> keys, n_evaluated, n_checks, passed (null if nothing was evaluated), failed: the names of failed checks in order."""
    seen = F.col("evaluated")
    return checks.groupBy(*keys).agg(F.count_if(seen).alias("n_evaluated"), F.count("*").alias("n_checks"), F.bool_and(F.when(seen, F.col("passed"))).alias("passed"), F.concat_ws(", ", F.array_sort(F.collect_list(F.when(seen & ~F.col("passed"), F.col("check"))))).alias("failed"))


def timeline(bars: DataFrame, columns: list[str], every: str = "day") -> DataFrame:
    """Every symbol at every ts that any symbol has, from its own first bar on, with `columns` of its last bar by then and `fresh`, whether that is the ts itself.

    The grid is the result itself: a row for each name and ts. Names and times meet by calendar
    piece, so that the grid is dealt out by time.
    """
    w = Window.partitionBy("symbol").orderBy("ts")
    piece, one = F.date_trunc(every, "ts").alias("__piece"), F.expr(f"interval 1 {every}")
    times, names = bars.select("ts", piece).distinct(), bars.groupBy("symbol").agg(F.min("ts").alias("__from"))
    # The last ts is one row.
    spans = names.join(F.broadcast(bars.agg(F.max("ts").alias("__to")))).select("symbol", "__from", F.explode(F.sequence(F.date_trunc(every, "__from"), F.date_trunc(every, "__to"), one)).alias("__piece"))
    grid = times.join(spans, "__piece").where(F.col("ts") >= F.col("__from")).select("ts", "symbol")
    own = bars.select("ts", "symbol", F.struct(*columns).alias("__own"))
    return grid.join(own, ["ts", "symbol"], "left").select("ts", "symbol", F.col("__own").isNotNull().alias("fresh"), F.last("__own", ignorenulls=True).over(w).alias("r")).select("ts", "symbol", "fresh", "r.*")


def marked(positions: DataFrame, prices: DataFrame, cash: Column | float = 0.0) -> DataFrame:
    """positions (symbol, side, size, entry_price, notional, risk, entry_time, exit_time) at prices (ts, symbol, close) -> ts, n, gross, net, reserved, open_risk, market_value, equity.

    A position counts from its entry until before its exit.
    """
    sign = F.when(F.col("side") == "BUY", 1.0).otherwise(-1.0)
    value = F.col("close") * F.col("size")
    held = during(positions, prices, "symbol", ["close"]).where(F.col("ts") < F.col("exit_time"))
    return held.groupBy("ts").agg(
        F.count("*").alias("n"), F.sum(value).alias("gross"), F.sum(value * sign).alias("net"), F.sum("notional").alias("reserved"), F.sum("risk").alias("open_risk"),
        F.sum(F.col("notional") + (F.col("close") - F.col("entry_price")) * F.col("size") * sign).alias("market_value"),
    ).withColumn("equity", F.col("market_value") + cash)


def stressed(trades: DataFrame, multiples: list[float], *, axis: str = "all") -> DataFrame:
    """trades (symbol, gross, turnover_cost, carry_cost) under multiples of their costs -> multiple, n, net, cost, sharpe (of trades), survives.

    axis scales turnover, borrow or all costs. A multiple survives if it and every milder one
    leave a positive net result and ratio: one pass over the trades for all multiples.
    """
    m = F.col("multiple")
    cost = F.col("turnover_cost") * (m if axis in ("all", "turnover") else 1) + F.col("carry_cost") * (m if axis in ("all", "borrow") else 1)
    each = trades.withColumn("multiple", F.explode(F.array(*[F.lit(float(x)) for x in multiples]))).select("multiple", (F.col("gross") - cost).alias("net"), cost.alias("cost"))
    out = each.groupBy("multiple").agg(F.count("*").alias("n"), F.sum("net").alias("net"), F.sum("cost").alias("cost"), ratio(F.avg("net"), F.stddev_samp("net")).alias("sharpe"))
    return out.withColumn("survives", F.bool_and(F.coalesce((F.col("net") > 0) & (F.col("sharpe") > 0), F.lit(False))).over(Window.orderBy("multiple")))
