"""Learning-curve analytics: many short curves, one point per sample size of the grid.

Rows are averaged per (curve, x) first, so a curve is never longer than the size grid.
"""

from __future__ import annotations

import warnings
from collections.abc import Mapping, Sequence

import numpy as np
import pandas as pd
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F
from pyspark.sql import types as T

from ..functions.joins import join_groups
from .metrics import GREATER_IS_BETTER
from .order_stats import HOT_ROWS, quantiles

# Spline settings, extension of the ends, fitted end points.
SPLINE_DEGREE = 2
KNOTS_PER_POINT = 0.5
SMOOTHING = 1e-4
MONOTONE_PENALTY = 1e6
MAX_ITERATIONS = 30
END_POINTS = 6
END_EXTENSION = 4.0
#: Longest curve handled (the size grid has 23 values).
MAX_POINTS = 1_000


def _points(df: DataFrame, keys: Sequence[str], x: str, y: str) -> DataFrame:
    """keys, points: array of (x, y, w) sorted by x."""
    per_x = df.where(F.col(y).isNotNull()).groupBy(*keys, x).agg(
        F.avg(y).alias("y"), F.count("*").cast("double").alias("w")
    )
    arr = F.sort_array(F.collect_list(F.struct(F.col(x).cast("double").alias("x"), "y", "w")))
    checked = F.when(F.count("*") <= MAX_POINTS, arr).otherwise(
        F.raise_error(F.lit(f"a curve has more than {MAX_POINTS} points"))
    )
    return per_x.groupBy(*keys).agg(checked.alias("points"))


def _isotonic_array(points: Column, increasing: bool) -> Column:
    """Least-squares monotone fit by the max-min formula over prefix sums."""
    sign = F.lit(1.0 if increasing else -1.0)
    zero = F.array(F.lit(0.0))

    def prefix(get) -> Column:
        return F.aggregate(
            points, zero, lambda acc, p: F.concat(acc, F.array(F.element_at(acc, -1) + get(p)))
        )

    cy, cw = prefix(lambda p: p["w"] * p["y"] * sign), prefix(lambda p: p["w"])
    n = F.size(points)

    def block(j: Column, k: Column) -> Column:
        top = F.element_at(F.col("_cy"), k + 1) - F.element_at(F.col("_cy"), j)
        return top / (F.element_at(F.col("_cw"), k + 1) - F.element_at(F.col("_cw"), j))

    fit = F.transform(
        F.sequence(F.lit(1), n),
        lambda i: sign
        * F.array_max(
            F.transform(
                F.sequence(F.lit(1), i),
                lambda j: F.array_min(F.transform(F.sequence(i, n), lambda k: block(j, k))),
            )
        ),
    )
    return cy, cw, fit


def _fitted(df: DataFrame, keys: Sequence[str], x: str, y: str, increasing: bool) -> DataFrame:
    """keys, points, fit (arrays of equal length)."""
    p = _points(df, keys, x, y)
    cy, cw, fit = _isotonic_array(F.col("points"), increasing)
    return p.withColumns({"_cy": cy, "_cw": cw}).withColumn("fit", fit).drop("_cy", "_cw")


def isotonic(df: DataFrame, keys: Sequence[str], x: str, y: str, increasing: bool) -> DataFrame:
    """Monotone least-squares fit of ``y`` along ``x`` per curve."""
    f = _fitted(df, keys, x, y, increasing)
    pairs = F.arrays_zip(F.col("points.x").alias(x), F.col("points.y").alias(y), "fit")
    return f.select(*keys, F.inline(pairs).alias(x, y, "fit"))


def _pieces(x: np.ndarray, start: float, width: float, count: int) -> tuple[np.ndarray, np.ndarray]:
    """Values and slopes at ``x`` of ``count`` quadratic bumps, each three ``width`` long and one ``width`` apart."""
    t = (x[:, None] - start) / width - np.arange(count)
    part = [(t >= k) & (t < k + 1) for k in range(3)]
    value = np.select(part, [t * t / 2, 0.75 - (t - 1.5) ** 2, (3 - t) ** 2 / 2])
    slope = np.select(part, [t, 3 - 2 * t, t - 3]) / width
    return value, slope


def _rising(design: np.ndarray, target: np.ndarray) -> np.ndarray:
    """Weights of a smooth fit whose falling steps between neighbouring weights are penalised.

    One least-squares problem of stacked rows: the points, the third differences, and the steps that are held. The
    held steps are those that fall in the solution; the fit is done when they stay the same.
    """
    count = design.shape[1]
    step = np.eye(count)[1:] - np.eye(count)[:-1]
    bend = step[2:, 2:] @ step[1:, 1:] @ step if count > 3 else np.zeros((0, count))
    held = np.zeros(len(step), bool)
    for _ in range(MAX_ITERATIONS):
        rows = np.vstack([design, SMOOTHING**0.5 * bend, MONOTONE_PENALTY**0.5 * step[held]])
        weights = np.linalg.lstsq(rows, np.pad(target, (0, len(rows) - len(target))), rcond=None)[0]
        falls = step @ weights < 0
        if (falls == held).all():
            return weights
        held = falls
    warnings.warn("the held steps of a monotone curve did not settle", stacklevel=2)
    return weights


def monotone_spline(
    x: np.ndarray, y: np.ndarray, x_new: np.ndarray, increasing: bool = True
) -> np.ndarray:
    """Penalised monotone quadratic spline, continued by its end tangents."""
    sign = 1.0 if increasing else -1.0
    ends = np.array([x.min(), x.max()], dtype=float)
    inner = int(len(x) * KNOTS_PER_POINT)
    if inner == 0 or ends[0] == ends[1]:
        return np.full(len(x_new), y.mean())
    # Bumps reach a margin beyond both ends and cover it evenly.
    margin = (SPLINE_DEGREE + 1) * (ends[1] - ends[0]) / inner
    count = inner + SPLINE_DEGREE
    grid = (ends[0] - margin, (ends[1] - ends[0] + 2 * margin) / (inner + 2 * SPLINE_DEGREE), count)
    weights = _rising(_pieces(x, *grid)[0], sign * y)
    inside = np.clip(x_new, *ends)
    slope = _pieces(ends, *grid)[1] @ weights
    beyond = np.where(x_new < ends[0], slope[0], slope[1]) * (x_new - inside)
    return sign * (_pieces(inside, *grid)[0] @ weights + beyond)


def smooth_curves(
    df: DataFrame, keys: Sequence[str], x: str, y: str, x_new: Sequence[float], increasing: bool
) -> DataFrame:
    """Monotone spline of ``y`` over log ``x`` per curve, evaluated at ``x_new``."""
    fields = [df.schema[k] for k in keys] + [T.StructField(x, T.DoubleType()), T.StructField(y, T.DoubleType())]
    per_x = df.where(F.col(y).isNotNull()).groupBy(*keys, x).agg(F.avg(y).alias(y))
    names, at = [*keys, x, y], np.asarray(list(x_new), dtype=float)

    def smooth(curve: pd.DataFrame) -> pd.DataFrame:
        curve = curve.sort_values(x)
        fit = monotone_spline(np.log(curve[x].to_numpy(float)), curve[y].to_numpy(float), np.log(at), increasing)
        out = pd.DataFrame({x: at, y: fit})
        for k in keys:
            out[k] = curve[k].iloc[0]
        return out[names]

    return per_x.groupBy(*keys).applyInPandas(smooth, T.StructType(fields))


def curve_band(
    df: DataFrame,
    keys: Sequence[str],
    value: str,
    x: str = "n_target",
    sizes: Sequence[float] | None = None,
    xlim: tuple[float, float] | None = None,
    hot_rows: int = HOT_ROWS,
) -> DataFrame:
    """10 %, median, 90 % quantile and sd over seeds per (curve, size), sizes optionally filtered."""
    if sizes is not None:
        df = df.where(F.col(x).isin(list(sizes)))
    if xlim is not None:
        df = df.where(F.col(x).between(*xlim))
    group = [*keys, x]
    q = quantiles(df, group, {"_q": F.col(value)}, [0.1, 0.5, 0.9], hot_rows=hot_rows)
    sd = df.groupBy(*group).agg(F.stddev_pop(value).alias("sd"))
    return join_groups(q, sd, group).select(
        *group,
        F.col("_q")[0].alias("q10"),
        F.col("_q")[1].alias("median"),
        F.col("_q")[2].alias("q90"),
        "sd",
    )


def find_intersection(
    df: DataFrame, keys: Sequence[str], t: str, x: str, increasing: bool, out: str = "crossing"
) -> DataFrame:
    """t where x first becomes positive (negative if not increasing), linearly interpolated.

    Never: +inf. Already at the first point: -inf.
    """
    mult = 1.0 if increasing else -1.0
    w = Window.partitionBy(*keys).orderBy(t)
    rows = df.select(
        *keys,
        F.col(t).cast("double").alias("_t"),
        F.col(x).cast("double").alias("_x"),
        F.lag(F.col(t).cast("double")).over(w).alias("_t0"),
        F.lag(F.col(x).cast("double")).over(w).alias("_x0"),
    )
    hit = F.when(F.lit(mult) * F.col("_x") > 0, F.col("_t"))
    first = rows.groupBy(*keys).agg(
        F.min_by(F.when(hit.isNotNull(), F.struct("_t", "_x", "_t0", "_x0")), hit).alias("_h")
    )
    h = F.col("_h")
    crossing = h["_t0"] - h["_x0"] * (h["_t"] - h["_t0"]) / (h["_x"] - h["_x0"])
    value = (
        F.when(h.isNull(), F.lit(float("inf")))
        .when(h["_t0"].isNull(), F.lit(float("-inf")))
        .otherwise(crossing)
    )
    return first.select(*keys, value.alias(out))


def regimes(
    n_samples: DataFrame, refit: DataFrame, cv: DataFrame, keys: Sequence[str], metric: str
) -> DataFrame:
    """Sample sizes where refitting and training from scratch start to win.

    ``n_samples`` and ``refit`` are bands (median, sd) on a common size grid, ``cv`` has one
    ``cv`` value per curve.
    """
    up = metric in GREATER_IS_BETTER
    mult = 0.02 if up else -0.1
    rows = (
        n_samples.select(*keys, "n_target", F.col("median").alias("_n"))
        .join(
            refit.select(*keys, "n_target", F.col("median").alias("_r"), F.col("sd").alias("_sd")),
            [*keys, "n_target"],
        )
        .join(cv.select(*keys, "cv"), list(keys))
        .withColumn("_t", F.log("n_target"))
        .withColumns(
            {
                "_a": F.col("_n") - F.col("cv"),
                "_b": F.col("_r") - F.lit(mult) * F.col("_sd") - F.col("cv"),
                "_c": F.col("_n") - F.col("_r"),
            }
        )
    )
    # A curve has one row per size, so its ends may be taken over a window.
    w = Window.partitionBy(*keys)
    rows = rows.withColumns(
        {
            "_min": F.min("n_target").over(w).cast("double"),
            "_max": F.max("n_target").over(w).cast("double"),
        }
    )
    kinds = {"cv_vs_n_samples": "_a", "cv_vs_refit": "_b", "n_samples_vs_refit": "_c"}
    pairs = F.array(*[F.struct(F.lit(k).alias("_kind"), F.col(c).alias("_x")) for k, c in kinds.items()])
    group = [*keys, "_min", "_max"]
    long = rows.select(*group, "_t", F.inline(pairs))
    crossings = find_intersection(long, [*group, "_kind"], "_t", "_x", up)
    ends = crossings.groupBy(*group).agg(
        *[F.max(F.when(F.col("_kind") == k, F.col("crossing"))).alias(k) for k in kinds]
    )
    a, b, c = (F.exp(x) for x in ("cv_vs_n_samples", "cv_vs_refit", "n_samples_vs_refit"))
    cap = 4 * F.col("_max")
    return ends.select(
        *keys,
        a.alias("cv_vs_n_samples"),
        F.when(b == 0, F.col("_min")).otherwise(b).alias("cv_vs_refit"),
        F.least(c, cap).alias("n_samples_vs_refit"),
    )


def _interpolate(value: Column, pts: Column, first: bool) -> Column:
    """Second coordinate where the polyline ``pts`` (v, l) takes ``value``; null outside."""
    hits = F.transform(
        F.sequence(F.lit(1), F.size(pts) - 1),
        lambda i: _on_segment(value, F.element_at(pts, i), F.element_at(pts, i + 1), first),
    )
    return F.array_min(hits) if first else F.array_max(hits)


def _on_segment(value: Column, a: Column, b: Column, first: bool) -> Column:
    inside = (value >= F.least(a["v"], b["v"])) & (value <= F.greatest(a["v"], b["v"]))
    flat = a["l"] if first else b["l"]
    at = F.when(a["v"] == b["v"], flat).otherwise(
        a["l"] + (value - a["v"]) / (b["v"] - a["v"]) * (b["l"] - a["l"])
    )
    return F.when(inside, at)


def invert_curve(
    band: DataFrame, values: DataFrame, keys: Sequence[str], value: str, out: str = "n_equivalent"
) -> DataFrame:
    """Sample size at which the median curve takes each value; null outside its range."""
    pts = band.groupBy(*keys).agg(
        F.sort_array(F.collect_list(F.struct(F.log("n_target").alias("l"), F.col("median").alias("v")))).alias(
            "_pts"
        )
    )
    joined = values.join(pts, list(keys))
    safe = F.when(F.size("_pts") > 1, _interpolate(F.col(value), F.col("_pts"), False))
    return joined.withColumn(out, F.exp(safe)).drop("_pts")


def _line(points: Column) -> tuple[Column, Column]:
    """Least-squares (slope, intercept) of l on v; null slope when v is constant."""
    n = F.size(points).cast("double")

    def total(f) -> Column:
        return F.aggregate(points, F.lit(0.0), lambda acc, p: acc + f(p))

    mv, ml = total(lambda p: p["v"]) / n, total(lambda p: p["l"]) / n
    svv = total(lambda p: (p["v"] - mv) * (p["v"] - mv))
    svl = total(lambda p: (p["v"] - mv) * (p["l"] - ml))
    slope = F.when(svv > 1e-18, svl / svv)
    return slope, ml - slope * mv


def equivalent_n(
    curves: DataFrame,
    values: DataFrame,
    keys: Sequence[str],
    wanted: Mapping[str, str],
    metric: str,
    y: str = "test_value",
) -> DataFrame:
    """Number of target samples that reach given values of the metric.

    ``wanted`` maps value columns of ``values`` to output columns. The isotonic curve is extended at both ends by the line through its outer points and
    read backwards; values beyond the extended ends are clamped to them.
    """
    up = metric in GREATER_IS_BETTER
    f = _fitted(curves, keys, "n_target", y, up)
    pts = F.zip_with(
        "points", "fit", lambda p, v: F.struct(v.alias("v"), F.log(p["x"]).alias("l"))
    )
    f = f.select(*keys, pts.alias("_p"))
    head, tail = F.slice("_p", 1, END_POINTS), F.slice("_p", -END_POINTS, END_POINTS)
    tail = F.when(F.size("_p") >= END_POINTS, tail).otherwise(F.col("_p"))
    first, last = F.element_at("_p", 1), F.element_at("_p", -1)
    worse = F.lit(-1.0 if up else 1.0)
    ends = {}
    for name, part, l_end, edge, sign in (
        ("_front", head, first["l"] - END_EXTENSION, first["v"], worse),
        ("_back", tail, last["l"] + END_EXTENSION, last["v"], -worse),
    ):
        slope, intercept = _line(part)
        v = (l_end - intercept) / slope
        beyond = F.when(sign * (v - edge) > 0, v)
        ends[name] = F.struct(beyond.alias("v"), l_end.alias("l"))
    f = f.withColumns(ends)
    some = lambda c: F.when(F.col(c)["v"].isNotNull(), F.array(c)).otherwise(
        F.array().cast("array<struct<v:double,l:double>>")
    )
    f = f.withColumn("_all", F.concat(some("_front"), "_p", some("_back"))).drop("_front", "_back", "_p")
    j = values.join(f, list(keys))
    pts = F.col("_all")
    first, last = F.element_at(pts, 1), F.element_at(pts, -1)
    out = {}
    for column, name in wanted.items():
        v = F.col(column)
        log_n = (
            F.when(v.isNull(), None)
            .when(worse * (v - first["v"]) >= 0, first["l"])
            .when(-worse * (v - last["v"]) > 0, last["l"])
            .otherwise(F.when(F.size(pts) > 1, _interpolate(v, pts, True)))
        )
        out[name] = F.exp(log_n)
    return j.withColumns(out).drop("_all")


def improvement(
    equivalents: DataFrame,
    keys: Sequence[str] = ("target", "metric"),
    from_equiv: str = "from_equiv",
    to_equiv: str = "to_equiv",
    nearest: bool = True,
) -> DataFrame:
    """20 %, median and 80 % of the relative change in equivalent sample size, in percent.

    The outer quantiles are elements of the sample (nearest rank) unless ``nearest`` is off.
    """
    pct = equivalents.select(
        *keys, (100 * (F.col(to_equiv) / F.col(from_equiv)) - 100.0).alias("_pct")
    ).where("_pct is not null")
    if not nearest:
        q = quantiles(pct, keys, {"_q": F.col("_pct")}, [0.2, 0.5, 0.8])
        return q.select(
            *keys, *[F.col("_q")[i].alias(n) for i, n in enumerate(("20%", "median", "80%"))]
        ).orderBy(*reversed(keys))
    # One value per seed: a group has as many rows as there are seeds.
    w = Window.partitionBy(*keys)
    ranked = pct.withColumns(
        {
            "_i": F.row_number().over(w.orderBy("_pct")) - 1,
            "_n": F.count("*").over(w),
        }
    )

    def at(q: float) -> Column:
        return F.max(F.when(F.col("_i") == F.round((F.col("_n") - 1) * F.lit(q)), F.col("_pct")))

    return (
        ranked.groupBy(*keys)
        .agg(
            at(0.2).alias("20%"),
            F.percentile("_pct", 0.5).alias("median"),
            at(0.8).alias("80%"),
        )
        .orderBy(*reversed(keys))
    )
