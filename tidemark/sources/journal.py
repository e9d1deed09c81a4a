"""A research journal read back as a table of trials: lines are told apart by their `tool`, sessions carry their state on."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from ..functions.canonical import canonical_json

#: The tools of the journal.
START, ROUND, SPOILT, TRIAL = "research:session_start", "research:trial", "trials:contaminated", "trial:"


def _get(path: str, kind: str = "string") -> Column:
    return F.try_variant_get("v", f"$.{path}", kind)


def lines(journal: DataFrame) -> tuple[DataFrame, DataFrame]:
    """(seq, value) -> (seq, tool, v: the line as a variant, of lines that are JSON objects, one row: good, malformed). Blank lines do not count."""
    read = journal.where(F.trim("value") != "").withColumn("v", F.try_parse_json("value"))
    good = F.col("v").isNotNull() & F.startswith(F.schema_of_variant("v"), F.lit("OBJECT"))
    good = F.coalesce(good, F.lit(False))
    return read.where(good).select("seq", F.coalesce(_get("tool"), F.lit("")).alias("tool"), "v"), read.agg(F.count_if(good).alias("good"), F.count_if(~good).alias("malformed"))


def trials(journal: DataFrame) -> DataFrame:
    """(seq, value) -> one row per trial id, its last line's: seq, id, kind, strategy, symbols, params and params_hash, accounting, session_id, ts, window_start, window_end, oos_sharpe, oos_profit_factor, oos_max_dd, deflated_sharpe, oos_trades, efficiency, promotable, n_trials, seed, orphan, spoilt.

    A round of a session has the universe, window and seed of the session's last start before it,
    and its strategy unless it names one; n_trials, a running total there, is given as the round's
    own share, 1 at least. A round whose session has not started is kept as an orphan. `spoilt` is
    the reason of the last later line that withdraws the trial. Lines of other tools and trials
    without an id are left out.
    """
    read, _ = lines(journal)
    session = _get("inputs.session_id")
    w = Window.partitionBy("session").orderBy("seq")
    started = F.col("tool") == START
    rows = read.where(F.col("tool").isin(START, ROUND) | F.startswith("tool", F.lit(TRIAL))).withColumn("session", F.when(~F.startswith("tool", F.lit(TRIAL)), session))
    # Lines without a session share nothing: each is a session of its own.
    rows = rows.withColumn("session", F.coalesce(F.concat(F.lit("s:"), "session"), F.concat(F.lit("n:"), F.col("seq").cast("string"))))
    context = F.struct(*[_get(f"inputs.{p}", k).alias(n) for n, p, k in (("strategy", "strategy", "string"), ("symbols", "symbols", "array<string>"), ("start", "research_window.start", "string"), ("end", "research_window.end", "string"), ("seed", "seed", "long"))])
    rows = rows.withColumn("cumulative", F.when(F.col("tool") == ROUND, _get("inputs.n_trials_cumulative", "long"))).withColumns({
        "context": F.last(F.when(started & session.isNotNull(), context), ignorenulls=True).over(w), "epoch": F.sum((started & session.isNotNull()).cast("int")).over(w.rowsBetween(Window.unboundedPreceding, 0)),
    })
    prior = F.last("cumulative", ignorenulls=True).over(Window.partitionBy("session", "epoch").orderBy("seq").rowsBetween(Window.unboundedPreceding, -1))
    share = F.when(F.col("cumulative").isNotNull(), F.greatest(F.col("cumulative") - F.coalesce(prior, F.lit(0)), F.lit(1)))
    cli = F.startswith("tool", F.lit(TRIAL))
    pick = lambda a, b: F.when(cli, a).otherwise(b)
    of = lambda a, b, kind="string": pick(_get(a, kind), _get(b, kind))
    object_text = lambda path: F.to_json(_get(path, "variant"))
    found = rows.withColumn("share", share).where(~started).select(
        "seq", _get("run_id").alias("id"), pick(F.coalesce(_get("kind"), F.substring("tool", len(TRIAL) + 1, 1000)), F.lit("research")).alias("kind"),
        pick(_get("inputs.strategy"), F.coalesce(_get("inputs.strategy"), F.col("context.strategy"))).alias("strategy"),
        F.coalesce(pick(_get("inputs.symbols", "array<string>"), F.col("context.symbols")), F.array().cast("array<string>")).alias("symbols"),
        F.coalesce(pick(object_text("resolved_config"), object_text("inputs.params")), F.lit("{}")).alias("params"), F.coalesce(_get("accounting", "int"), F.lit(1)).alias("accounting"),
        F.when(~cli, session).alias("session_id"), _get("timestamp").alias("ts"), pick(_get("inputs.window.start"), F.col("context.start")).alias("window_start"), pick(_get("inputs.window.end"), F.col("context.end")).alias("window_end"),
        pick(_get("result_summary.sharpe_ratio", "double"), F.coalesce(_get("inputs.oos_sharpe", "double"), _get("inputs.oos_aggregate.sharpe_ratio", "double"))).alias("oos_sharpe"),
        of("result_summary.profit_factor", "inputs.oos_aggregate.profit_factor", "double").alias("oos_profit_factor"),
        pick(_get("result_summary.max_drawdown", "double"), F.coalesce(_get("inputs.oos_max_drawdown", "double"), _get("inputs.oos_aggregate.max_drawdown", "double"))).alias("oos_max_dd"),
        of("result_summary.deflated_sharpe_ratio", "inputs.oos_aggregate.deflated_sharpe_ratio", "double").alias("deflated_sharpe"), of("result_summary.total_trades", "inputs.oos_aggregate.total_trades", "long").alias("oos_trades"),
        of("efficiency", "inputs.efficiency", "double").alias("efficiency"), of("promotable", "inputs.promotable", "boolean").alias("promotable"), pick(_get("n_trials", "long"), F.col("share")).alias("n_trials"),
        F.when(~cli, F.col("context.seed")).alias("seed"), (~cli & F.col("context").isNull()).alias("orphan"),
    ).where("id is not null and id <> ''")
    last = found.groupBy("id").agg(F.max_by(F.struct(*[c for c in found.columns if c != "id"]), "seq").alias("r")).select("r.seq", "id", *[f"r.{c}" for c in found.columns if c not in ("id", "seq")])
    withdrawn = read.where(F.col("tool") == SPOILT).select(F.col("seq").alias("at"), F.explode(F.coalesce(_get("inputs.trial_ids", "array<string>"), F.array().cast("array<string>"))).alias("id"), F.coalesce(_get("inputs.reason"), F.lit("unspecified")).alias("reason"))
    spoilt = last.select("id", "seq").join(withdrawn, "id").where(F.col("at") > F.col("seq")).groupBy("id").agg(F.max_by("reason", "at").alias("spoilt"))
    out = last.withColumn("params", canonical_json(F.col("params"))).withColumn("params_hash", F.sha2("params", 256))
    return out.join(spoilt, "id", "left")
