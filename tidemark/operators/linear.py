"""Least squares from moments: a fixed small system solved in column expressions, one for each row."""

from __future__ import annotations

from itertools import combinations_with_replacement

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

#: A pivot under this share of its diagonal is a column that the earlier ones already hold.
SINGULAR = 1e-10


def pairs(names: list[str]) -> list[tuple[str, str]]:
    return list(combinations_with_replacement(names, 2))


def solved(df: DataFrame, names: list[str], matrix: dict[tuple[str, str], str], right: dict[str, str], out: dict[str, str]) -> DataFrame:
    """df with columns out[name], the solution of matrix x = right by Cholesky; matrix has (a, b) for a before b in names, and (a, a).

    Columns that hold nothing new get the coefficient 0, so that fitted values are those of the
    least-squares solution whatever the rank. Each step is a projection of its own: no expression
    is written out twice.
    """
    had, k = df.columns, len(names)
    at = lambda a, b: F.col(f"__l{a}_{b}")
    for a in range(k):
        for b in range(a + 1):
            rest = F.col(matrix[names[b], names[a]])
            for c in range(b):
                rest = rest - at(a, c) * at(b, c)
            if a == b:
                diagonal = F.col(matrix[names[a], names[a]])
                value = F.when((diagonal > 0) & (rest > SINGULAR * diagonal), F.sqrt(rest)).otherwise(0.0)
            else:
                value = F.when(at(b, b) > 0, rest / at(b, b)).otherwise(0.0)
            df = df.withColumn(f"__l{a}_{b}", value)
    for a in range(k):
        rest = F.col(right[names[a]])
        for c in range(a):
            rest = rest - at(a, c) * F.col(f"__z{c}")
        df = df.withColumn(f"__z{a}", F.when(at(a, a) > 0, rest / at(a, a)).otherwise(0.0))
    for a in range(k - 1, -1, -1):
        rest = F.col(f"__z{a}")
        for c in range(a + 1, k):
            rest = rest - at(c, a) * F.col(f"__x{c}")
        df = df.withColumn(f"__x{a}", F.when(at(a, a) > 0, rest / at(a, a)).otherwise(0.0))
    return df.select(*had, *[F.col(f"__x{a}").alias(out[n]) for a, n in enumerate(names)])


def moments(names: list[str], y: str) -> dict[str, Column]:
    """Aggregates for a fit of y on names with an intercept: means and covariances of the rows where all are there."""
    whole = F.lit(True)
    for c in [*names, y]:
        whole &= F.col(c).isNotNull() & ~F.isnan(F.col(c).cast("double")) & (F.abs(c) < float("inf"))
    of = lambda c: F.when(whole, F.col(c).cast("double"))
    out = {"__n": F.count(F.when(whole, 1)), **{f"__m_{c}": F.avg(of(c)) for c in [*names, y]}}
    out |= {f"__s_{a}_{b}": F.covar_pop(of(a), of(b)) for a, b in pairs(names)}
    return out | {f"__r_{a}": F.covar_pop(of(a), of(y)) for a in names}


def fitted(df: DataFrame, names: list[str], y: str, intercept: str, coefficients: dict[str, str]) -> DataFrame:
    """df, which holds moments, with the intercept and coefficients of the fit; the moments go but for the count `__n`."""
    df = solved(df, names, {(a, b): f"__s_{a}_{b}" for a, b in pairs(names)}, {a: f"__r_{a}" for a in names}, coefficients)
    level = F.col(f"__m_{y}")
    for a in names:
        level = level - F.col(coefficients[a]) * F.col(f"__m_{a}")
    return df.withColumn(intercept, level).drop(*[f"__m_{c}" for c in [*names, y]], *[f"__s_{a}_{b}" for a, b in pairs(names)], *[f"__r_{a}" for a in names])
