"""Column expressions shared by the operators."""

from __future__ import annotations

from collections.abc import Sequence
from functools import reduce

from pyspark.sql import Column
from pyspark.sql import functions as F


def finite(c: Column) -> Column:
    """NaN and infinities become null."""
    x = c.cast("double")
    return F.when(~F.isnan(x) & (F.abs(x) != F.lit(float("inf"))), x)


def clip(c: Column, lower=None, upper=None) -> Column:
    """Clamp to bounds; null stays null (``greatest``/``least`` alone would skip it)."""
    x = c
    if lower is not None:
        x = F.greatest(x, F.lit(float(lower)))
    if upper is not None:
        x = F.least(x, F.lit(float(upper)))
    return F.when(c.isNotNull(), x)


def log_or_null(c: Column, eps: float | None = None) -> Column:
    """log(c + eps); null where that is not finite."""
    x = c if eps is None else c + F.lit(float(eps))
    return F.when(x > 0, F.log(x))


def mean_horizontal(cols: Sequence[Column | str]) -> Column:
    """Row-wise mean of the non-null columns."""
    cs = [F.col(c) if isinstance(c, str) else c for c in cols]
    total = reduce(lambda a, b: a + b, [F.coalesce(c.cast("double"), F.lit(0.0)) for c in cs])
    n = reduce(lambda a, b: a + b, [c.isNotNull().cast("int") for c in cs])
    return F.when(n > 0, total / n)


def piecewise_linear(x: Column, xs: Sequence[float], ys: Sequence[float]) -> Column:
    """Linear interpolation in a sorted table, clamped at both ends; null stays null.

    The table is one literal array; the segment is found by its position in it.
    """
    grid = F.array(*[F.lit(float(v)) for v in xs])
    values = F.array(*[F.lit(float(v)) for v in ys])
    i = F.size(F.filter(grid, lambda g: g <= x))
    x0, x1 = F.element_at(grid, i), F.element_at(grid, i + 1)
    y0, y1 = F.element_at(values, i), F.element_at(values, i + 1)
    return (
        F.when(x.isNull(), None)
        .when(x <= F.lit(float(xs[0])), F.lit(float(ys[0])))
        .when(x >= F.lit(float(xs[-1])), F.lit(float(ys[-1])))
        .otherwise(y0 + (x - x0) * (y1 - y0) / (x1 - x0))
    )


def dot(coefs: Sequence[float], cols: Sequence[str | Column]) -> Column:
    """Linear form with literal coefficients."""
    cs = [F.col(c) if isinstance(c, str) else c for c in cols]
    return reduce(lambda a, b: a + b, [F.lit(float(w)) * c for w, c in zip(coefs, cs)])


def logistic(c: Column) -> Column:
    return F.lit(1.0) / (F.lit(1.0) + F.exp(-c))
