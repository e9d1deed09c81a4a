"""Declared signals and scanners: parameters, features, scores and bands, checked before a plan is built.

A declaration names its parameters with their ranges, the features it reads, a score and the bands
that hold a position. Everything that can be wrong with a name or a value is refused on the driver,
with the nearest name that would be right. What passes becomes one DataFrame plan: all parameter
points of a sweep share one pass over the bars.
"""

from __future__ import annotations

import difflib
import operator
from collections.abc import Callable, Iterable, Mapping
from dataclasses import dataclass, field
from itertools import product

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from .functions.scalars import ratio
from .operators import timeseries
from .operators.metrics import sharpe

OPERATORS = {"<": operator.lt, "<=": operator.le, ">": operator.gt, ">=": operator.ge, "==": operator.eq, "!=": operator.ne}


def nearest(name: str, known: Iterable[str]) -> str:
    """A hint at the known name that is nearest by edits, empty if none is near."""
    close = difflib.get_close_matches(name, list(known), n=1, cutoff=0.6)
    return f" (did you mean {close[0]!r}?)" if close else ""


def refuse_unknown(names: Iterable[str], known: Iterable[str], what: str) -> None:
    known = list(known)
    wrong = [n for n in names if n not in known]
    if wrong:
        raise ValueError(f"no {what} {'; '.join(f'{n!r}{nearest(n, known)}' for n in wrong)}. Known: {', '.join(sorted(known))}")


#: Features by name: what they take and the column they make. None looks ahead.
FEATURES: dict[str, tuple[tuple[str, ...], Callable[..., Column]]] = {
    "sma": (("column", "n"), lambda column, n: timeseries.sma(F.col(column), n)),
    "ema": (("column", "n"), lambda column, n: timeseries.ema(F.col(column), n)),
    "std": (("column", "n"), lambda column, n: timeseries.rolling_std(F.col(column), n)),
    "change": (("column",), lambda column: timeseries.simple_return(F.col(column))),
    "step": ((), lambda: ratio(F.col("close") - F.col("open"), F.col("open"))),
    "dollars": (("n",), lambda n: timeseries.sma(F.col("close") * F.col("volume"), n)),
}


@dataclass(frozen=True)
class Feature:
    """A feature of the catalogue with its arguments; an argument that is a parameter's name takes its value."""

    name: str
    arguments: Mapping[str, object] = field(default_factory=dict)

    def __post_init__(self):
        refuse_unknown([self.name], FEATURES, "feature")
        takes = FEATURES[self.name][0]
        refuse_unknown(self.arguments, takes, f"argument of {self.name}")
        missing = [a for a in takes if a not in self.arguments]
        if missing:
            raise ValueError(f"feature {self.name!r} needs {', '.join(missing)}")

    def bound(self, params: Mapping[str, object]) -> tuple:
        """Name and arguments with parameters put in: equal for features that are the same column."""
        return (self.name, tuple(sorted((k, params.get(v, v) if isinstance(v, str) else v) for k, v in self.arguments.items())))


def _column(bound: tuple) -> Column:
    return FEATURES[bound[0]][1](**dict(bound[1]))


@dataclass(frozen=True)
class Parameter:
    low: float
    high: float
    step: float
    default: float
    whole: bool = True

    def checked(self, name: str, value: object) -> float:
        if isinstance(value, bool) or not isinstance(value, (int, float)) or value != value:
            raise ValueError(f"{name} is a number, not {value!r}")
        if self.whole and value != int(value):
            raise ValueError(f"{name} is a whole number, not {value!r}")
        if not self.low <= value <= self.high:
            raise ValueError(f"{name} = {value!r} is outside {self.low} to {self.high}")
        return int(value) if self.whole else float(value)

    def values(self) -> list[float]:
        count = int((self.high - self.low) / self.step + 1e-9) + 1
        return [int(self.low + k * self.step) if self.whole else self.low + k * self.step for k in range(count)]


@dataclass(frozen=True)
class Declaration:
    """What signals and scanners share: a name, parameters, constraints between them and features."""

    name: str
    parameters: Mapping[str, Parameter]
    features: Mapping[str, Feature]
    constraints: tuple[tuple[str, str, object], ...] = ()

    def __post_init__(self):
        for left, op, right in self.constraints:
            refuse_unknown([op], OPERATORS, "operator")
            refuse_unknown([s for s in (left, right) if isinstance(s, str)], self.parameters, "parameter")
        clash = set(self.parameters) & set(self.features)
        if clash:
            raise ValueError(f"names of both a parameter and a feature: {', '.join(sorted(clash))}")
        self.resolved({})

    def broken(self, params: Mapping[str, float]) -> list[str]:
        """Constraints that the parameters do not meet."""
        value = lambda s: params[s] if isinstance(s, str) else s
        return [f"{a} {op} {b}" for a, op, b in self.constraints if not OPERATORS[op](value(a), value(b))]

    def resolved(self, params: Mapping[str, object]) -> dict[str, float]:
        """All parameters, defaults put in; unknown names, wrong kinds, values out of range and broken constraints are refused."""
        refuse_unknown(params, self.parameters, f"parameter of {self.name}")
        out = {n: p.checked(n, params.get(n, p.default)) for n, p in self.parameters.items()}
        if wrong := self.broken(out):
            raise ValueError(f"{self.name} needs {' and '.join(wrong)}; got {out}")
        return out

    def points(self, **values: Iterable[float]) -> list[dict[str, float]]:
        """Every combination of the given values, of the whole range where none are given, that meets the constraints: a search space holds no point that could not run."""
        refuse_unknown(values, self.parameters, f"parameter of {self.name}")
        axes = {n: [p.checked(n, v) for v in values.get(n, p.values())] for n, p in self.parameters.items()}
        every = [dict(zip(axes, combination, strict=True)) for combination in product(*axes.values())]
        return [p for p in every if not self.broken(p)]

    def prepared(self, bars: DataFrame, points: list[dict[str, float]]) -> tuple[DataFrame, dict[tuple, str]]:
        """bars with each different feature of all points once, in one window pass, and their column names."""
        refuse_unknown([a for f in self.features.values() for k, a in f.arguments.items() if k == "column" and isinstance(a, str)], bars.columns, "column of the bars")
        needed = dict.fromkeys(f.bound(p) for p in points for f in self.features.values())
        names = {b: f"__f{k}" for k, b in enumerate(needed)}
        return bars.withColumns({n: _column(b) for b, n in names.items()}), names

    def inputs(self, names: dict[tuple, str], point: Mapping[str, float]) -> dict[str, Column]:
        return {n: F.col(names[f.bound(point)]) for n, f in self.features.items()} | {n: F.lit(v) for n, v in point.items()}


@dataclass(frozen=True)
class Signal(Declaration):
    """A score from features and parameters, and the bands that turn it into a position: held above `enter` until it is at or under `leave`; short positions below -enter until at or over -leave unless long_only."""

    score: Callable[[Mapping[str, Column]], Column] | None = None
    enter: float = 0.0
    leave: float = 0.0
    long_only: bool = True

    def __post_init__(self):
        super().__post_init__()
        if self.score is None:
            raise ValueError(f"{self.name} declares no score")
        if self.leave > self.enter:
            raise ValueError(f"{self.name}: leave ({self.leave}) lies above enter ({self.enter})")

    def _held(self, score: Column) -> Column:
        long = timeseries.held_direction(score, self.enter, self.leave)
        return long if self.long_only else long - timeseries.held_direction(-score, self.enter, self.leave)

    def compiled(self, bars: DataFrame, params: Mapping[str, object] | None = None) -> DataFrame:
        """bars with score and held. A score is null until its features are full; a null score holds what is held."""
        point = self.resolved(params or {})
        rows, names = self.prepared(bars, [point])
        scored = rows.withColumn("score", self.score(self.inputs(names, point)))
        return scored.withColumn("held", self._held(F.col("score"))).select(*bars.columns, "score", "held")

    def swept(self, bars: DataFrame, points: list[Mapping[str, object]], ppy: float = 252.0) -> DataFrame:
        """One row a point: its parameters, n, total and sharpe of the book that holds each symbol as decided on the bar before, equally over symbols. Bars are read once for all points."""
        resolved = [self.resolved(p) for p in points]
        rows, names = self.prepared(bars.withColumn("__ret", timeseries.simple_return(F.col("close"))), resolved)
        by = timeseries.by()
        rows = rows.withColumns({f"__s{k}": self.score(self.inputs(names, p)) for k, p in enumerate(resolved)})
        known = by.rowsBetween(Window.unboundedPreceding, 0)
        rows = rows.withColumns({f"__h{k}": F.when(F.count(f"__s{k}").over(known) > 0, self._held(F.col(f"__s{k}"))) for k in range(len(resolved))})
        rows = rows.withColumns({f"__h{k}": F.lag(f"__h{k}").over(by) for k in range(len(resolved))})
        each = F.array(*[F.struct(*[F.lit(v).alias(n) for n, v in p.items()], F.col(f"__h{k}").cast("double").alias("held")) for k, p in enumerate(resolved)])
        long = rows.where("__ret is not null").select("ts", "__ret", F.explode(each).alias("p")).where("p.held is not null")
        book = long.groupBy(*[F.col(f"p.{n}").alias(n) for n in self.parameters], "ts").agg(F.avg(F.col("__ret") * F.col("p.held")).alias("r"))
        return book.groupBy(*self.parameters).agg(F.count("*").alias("n"), F.sum("r").alias("total"), sharpe(F.col("r"), ppy).alias("sharpe"))


@dataclass(frozen=True)
class Scanner(Declaration):
    """A condition that flags a bar, the side it is flagged for and its strength."""

    hit: Callable[[Mapping[str, Column]], Column] | None = None
    strength: Callable[[Mapping[str, Column]], Column] | None = None
    side: Callable[[Mapping[str, Column]], Column] | None = None

    def __post_init__(self):
        super().__post_init__()
        if self.hit is None or self.strength is None:
            raise ValueError(f"{self.name} declares no {'hit' if self.hit is None else 'strength'}")

    def compiled(self, bars: DataFrame, params: Mapping[str, object] | None = None) -> DataFrame:
        """bars with signal (BUY, SELL or HOLD) and strength (0 for HOLD)."""
        point = self.resolved(params or {})
        rows, names = self.prepared(bars, [point])
        inputs = self.inputs(names, point)
        hit = F.coalesce(self.hit(inputs), F.lit(False))
        up = F.lit(True) if self.side is None else F.coalesce(self.side(inputs), F.lit(False))
        out = rows.withColumn("signal", F.when(hit & up, "BUY").when(hit, "SELL").otherwise("HOLD")).withColumn("strength", F.when(hit, self.strength(inputs)).otherwise(0.0))
        return out.select(*bars.columns, "signal", "strength")


CROSSOVER = Signal(
    "crossover", {"fast": Parameter(2, 60, 2, 4), "slow": Parameter(4, 200, 2, 12)}, {"quick": Feature("sma", {"column": "close", "n": "fast"}), "calm": Feature("sma", {"column": "close", "n": "slow"})},
    (("fast", "<", "slow"),), score=lambda x: ratio(x["quick"] - x["calm"], x["calm"]),
)
VOLUME = Scanner(
    "volume", {"n": Parameter(2, 250, 1, 20), "times": Parameter(1.0, 10.0, 0.5, 1.5, whole=False), "move": Parameter(0.0, 0.5, 0.01, 0.01, whole=False), "least": Parameter(0.0, 1e9, 1e6, 1.0, whole=False)},
    {"usual": Feature("sma", {"column": "volume", "n": "n"}), "rise": Feature("step")},
    hit=lambda x: (ratio(F.col("volume"), x["usual"]) > x["times"]) & (F.abs(x["rise"]) > x["move"]) & (F.col("volume") >= x["least"]),
    strength=lambda x: F.least(ratio(F.col("volume"), x["usual"]) / x["times"] / 2, F.lit(1.0)), side=lambda x: x["rise"] > 0,
)
LIQUIDITY = Scanner(
    "liquidity", {"lookback": Parameter(4, 250, 1, 20), "recent": Parameter(3, 60, 1, 5), "least": Parameter(0.0, 1e12, 1e6, 5e6, whole=False), "keeping": Parameter(0.0, 1.0, 0.05, 0.75, whole=False)},
    {"wide": Feature("dollars", {"n": "lookback"}), "near": Feature("dollars", {"n": "recent"})}, (("recent", "<=", "lookback"),),
    hit=lambda x: (x["wide"] >= x["least"]) & (ratio(x["near"], x["wide"]) >= x["keeping"]), strength=lambda x: x["wide"] / x["least"],
)


def risk_features(bars: DataFrame, bench: DataFrame | None, ppy: float, default: float = 0.20) -> DataFrame:
    """symbol, beta, residual_vol, benchmark_available: what a score is scaled by. bench: ts, bench (its return).

    The volatility is of the whole window, never conditional. Without a benchmark the beta is 1 and
    the volatility the total one; one that is 0 or unknown becomes the default.
    """
    from .operators import risk

    rows = bars.withColumn("ret", timeseries.simple_return(F.col("close")))
    if bench is None:
        found = rows.groupBy("symbol").agg(F.lit(1.0).alias("beta"), (F.stddev_samp("ret") * ppy**0.5).alias("vol"))
    else:
        fit = risk.beta(rows.join(bench, "ts"), ppy).select("symbol", "beta", F.col("residual_vol").alias("vol"))
        found = rows.select("symbol").distinct().join(fit, "symbol", "left").withColumn("beta", F.coalesce("beta", F.lit(1.0)))
    vol = F.when(F.col("vol") > 0, F.col("vol")).otherwise(default)
    return found.select("symbol", "beta", vol.alias("residual_vol"), F.lit(bench is not None).alias("benchmark_available"))
