"""Scoring of model grids and residual, classification and projected metrics.

Scored tables hold ``y`` and ``yhat`` and are grouped by ``by`` columns (target, split,
model). Moment-like metrics are one partial aggregate; quantiles and rank metrics go
through ``order_stats`` so that no group has to fit one task.
"""

from __future__ import annotations

from collections.abc import Iterable, Mapping, Sequence
from functools import reduce
from itertools import product

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from ..functions.bounded import lookup
from ..functions.columns import dot, logistic
from ..functions.joins import join_groups
from ..session import stored
from .order_stats import HOT_ROWS, quantiles, running_totals

# Quantile levels and clipping of probabilities.
RESIDUAL_Q = (0.05, 0.1, 0.25, 0.5, 0.75, 0.9, 0.95)
LOSS_Q = (0.8, 0.9, 0.95)
PROJECTED_Q = (0.5, 0.6, 0.7, 0.8, 0.9, 0.95)
CLIP = 1e-14

#: Metrics where larger is better (fixed values).
GREATER_IS_BETTER = ("roc", "auroc", "auc", "auprc", "accuracy", "prc", "r2")


def param_grid(spark: SparkSession, grid: Mapping[str, Sequence]) -> DataFrame:
    """All combinations of the value lists; the first list varies slowest."""
    df = spark.range(1).select(F.array(*[F.lit(v) for v in next(iter(grid.values()))]).alias("_v"))
    names = list(grid)
    df = df.select(F.explode("_v").alias(names[0]))
    for n in names[1:]:
        df = df.withColumn(n, F.explode(F.array(*[F.lit(v) for v in grid[n]])))
    return df


def score_grid(
    df: DataFrame,
    models: Iterable[Mapping],
    features: Sequence[str],
    keep: Sequence[str],
    link: str = "identity",
    out: str = "yhat",
) -> DataFrame:
    """Predictions of every linear model on every row, long by ``model``.

    Each model has ``model``, ``intercept`` and ``coef``. Coefficients are literals of one
    array expression, so the only fan-out is the number of models and nothing is joined.
    """
    scored = []
    for m in models:
        eta = F.lit(float(m["intercept"])) + dot(m["coef"], features)
        yhat = logistic(eta) if link == "logit" else eta
        scored.append(F.struct(F.lit(m["model"]).alias("model"), yhat.alias(out)))
    return df.select(*keep, F.inline(F.array(*scored)))


def clip_predictions(df: DataFrame, by: Sequence[str], yhat: str = "yhat") -> DataFrame:
    """Clip a group's predictions only if none is above 1 and some is negative."""
    return _with_clip(df, by, yhat).withColumn(yhat, F.col("_yhat")).drop("_yhat")


def _with_clip(df: DataFrame, by: Sequence[str], yhat: str = "yhat") -> DataFrame:
    """Adds ``_yhat``, the predictions after the clipping rule (once per table)."""
    if "_yhat" in df.columns:
        return df
    ends = lookup(
        df.groupBy(*by).agg(
            ((F.max(yhat) <= 1) & (F.min(yhat) < 0)).alias("_clip"),
        )
    )
    return (
        join_groups(df, ends, by)
        .withColumn("_yhat", F.when(F.col("_clip"), _unit(F.col(yhat))).otherwise(F.col(yhat)))
        .drop("_clip")
    )


def _scores(df: DataFrame, by: Sequence[str], also: Sequence[str] = ()) -> DataFrame:
    """The columns that metrics read, written once: the clipping rule and the metric each pass over them."""
    return df if "_yhat" in df.columns else stored(df, [*by, *also, "y", "yhat"])


def _unit(c: Column) -> Column:
    return F.least(F.greatest(c, F.lit(CLIP)), F.lit(1 - CLIP))


def log_loss(y: Column, yhat: Column) -> Column:
    """Per-row loss with probabilities clipped away from 0 and 1."""
    p = _unit(yhat)
    return F.when(y == 1, -F.log(p)).otherwise(-F.log(1 - p))


def _spread(df: DataFrame, keys: Sequence[str], arrays: Mapping[str, tuple[Sequence[float], str]]):
    """Array columns of quantiles to one named column per level."""
    cols = [
        F.col(a)[i].alias(name.format(q=q)) for a, (qs, name) in arrays.items() for i, q in enumerate(qs)
    ]
    return df.select(*keys, *cols)


def residual_metrics(
    df: DataFrame, by: Sequence[str], binary: bool = False, hot_rows: int = HOT_ROWS
) -> DataFrame:
    """Residual quantiles and mean, residual = y - yhat."""
    src = _with_clip(_scores(df, by), by) if binary else df
    r = {"r": F.col("y") - F.col("_yhat" if binary else "yhat")}
    mean = {"mean_residual": F.avg("r")}
    q = quantiles(src, by, r, RESIDUAL_Q, hot_rows=hot_rows, extra=mean)
    return _spread(q, [*by, "mean_residual"], {"r": (RESIDUAL_Q, "quantile_{q}")})


def regression_metrics(df: DataFrame, by: Sequence[str]) -> DataFrame:
    """mse, rmse and mae in one aggregate."""
    r = F.col("y") - F.col("yhat")
    return df.groupBy(*by).agg(
        F.avg(r * r).alias("mse"), F.sqrt(F.avg(r * r)).alias("rmse"), F.avg(F.abs(r)).alias("mae")
    )


def absolute_quantiles(df: DataFrame, by: Sequence[str], hot_rows: int = HOT_ROWS) -> DataFrame:
    """Quantiles of the absolute residual, and their squares."""
    q = quantiles(df, by, {"a": F.abs(F.col("y") - F.col("yhat"))}, RESIDUAL_Q, hot_rows=hot_rows)
    out = _spread(q, by, {"a": (RESIDUAL_Q, "abs_quantile_{q}")})
    squares = {f"mse_quantile_{p}": F.col(f"`abs_quantile_{p}`") ** 2 for p in RESIDUAL_Q}
    return out.select("*", *[c.alias(n) for n, c in squares.items()])


def binary_losses(df: DataFrame, by: Sequence[str]) -> DataFrame:
    """accuracy, log loss and Brier score; null where only one class is present."""
    src = _with_clip(_scores(df, by), by)
    y, p = F.col("y"), F.col("_yhat")
    both = F.min("y") < F.max("y")
    hit = ((p >= 0.5) == (y == 1)).cast("double")
    return src.groupBy(*by).agg(
        F.when(both, F.avg(hit)).alias("accuracy"),
        F.when(both, F.avg(log_loss(y, p))).alias("log_loss"),
        F.when(both, F.avg((y - p) * (y - p))).alias("brier"),
    )


def log_loss_quantiles(df: DataFrame, by: Sequence[str], hot_rows: int = HOT_ROWS) -> DataFrame:
    src = _with_clip(_scores(df, by), by)
    q = quantiles(
        src, by, {"l": log_loss(F.col("y"), F.col("_yhat"))}, LOSS_Q, hot_rows=hot_rows
    )
    return _spread(q, by, {"l": (LOSS_Q, "log_loss_quantile_{q}")})


def rank_metrics(df: DataFrame, by: Sequence[str], hot_rows: int = HOT_ROWS) -> DataFrame:
    """AuROC with average ranks for ties and average precision (step, not trapezoid).

    Both come from one pass over distinct scores in falling order. A group with a single
    class gets nulls.
    """
    src = _with_clip(_scores(df, by), by).select(*by, _unit(F.col("_yhat")).alias("_s"), "y")
    falling = src.withColumn("_s", -F.col("_s"))
    pos = F.count(F.when(F.col("y") == 1, 1))
    neg = F.count(F.when(F.col("y") != 1, 1))
    d = running_totals(falling, by, "_s", {"pos": pos, "neg": neg}, hot_rows)
    dpos, dneg = F.col("pos").cast("double"), F.col("neg").cast("double")
    above = F.col("cum_neg").cast("double") - dneg / 2
    precision = F.col("cum_pos") / (F.col("cum_pos") + F.col("cum_neg"))
    sums = d.groupBy(*by).agg(
        F.sum(dpos).alias("_p"),
        F.sum(dneg).alias("_n"),
        F.sum(dpos * above).alias("_above"),
        F.sum(dpos * precision).alias("_precision"),
    )
    both = (F.col("_p") > 0) & (F.col("_n") > 0)
    p, n = F.col("_p"), F.col("_n")
    return sums.select(
        *by,
        F.when(both, (p * n - F.col("_above")) / (p * n)).alias("roc"),
        F.when(both, F.col("_precision") / p).alias("auprc"),
    )


def auroc(df: DataFrame, by: Sequence[str], hot_rows: int = HOT_ROWS) -> DataFrame:
    return rank_metrics(df, by, hot_rows).select(*by, "roc")


def auprc(df: DataFrame, by: Sequence[str], hot_rows: int = HOT_ROWS) -> DataFrame:
    return rank_metrics(df, by, hot_rows).select(*by, "auprc")


def _projected(
    df: DataFrame, by: Sequence[str], group: Sequence[str], value: Column, hot_rows: int, square: bool
) -> DataFrame:
    """Quantiles ``p`` and mean ``_mean`` over rows of a group-mean projection, on group level."""
    keys = [*by, *[c for c in group if c not in by]]
    g = df.select(*keys, value.alias("_v")).groupBy(*keys).agg(
        F.count("*").alias("_n"), F.avg("_v").alias("_m")
    )
    m = F.col("_m") * F.col("_m") if square else F.col("_m")
    mean = {"_mean": F.sum(F.col("p") * F.col("_weight")) / F.sum("_weight")}
    return quantiles(g, by, {"p": m}, PROJECTED_Q, weight=F.col("_n"), hot_rows=hot_rows, extra=mean)


def projected_metrics(
    df: DataFrame,
    by: Sequence[str],
    group: Sequence[str],
    binary: bool = False,
    hot_rows: int = HOT_ROWS,
) -> DataFrame:
    """Mean and quantiles of the squared residual projection on the anchor groups."""
    src = _with_clip(_scores(df, by, group), by) if binary else df.withColumn("_yhat", F.col("yhat"))
    q = _projected(src, by, group, F.col("y") - F.col("_yhat"), hot_rows, True)
    q = q.withColumnRenamed("_mean", "proj_residuals_sq")
    return _spread(q, [*by, "proj_residuals_sq"], {"p": (PROJECTED_Q, "proj_residuals_sq_quantile_{q}")})


def projected_log_loss(
    df: DataFrame, by: Sequence[str], group: Sequence[str], hot_rows: int = HOT_ROWS
) -> DataFrame:
    """Mean and quantiles of the log-loss projection on the anchor groups."""
    src = _with_clip(_scores(df, by, group), by)
    q = _projected(src, by, group, log_loss(F.col("y"), F.col("_yhat")), hot_rows, False)
    q = q.withColumnRenamed("_mean", "proj_logloss")
    return _spread(q, [*by, "proj_logloss"], {"p": (PROJECTED_Q, "proj_logloss_quantile_{q}")})


def all_metrics(
    df: DataFrame,
    by: Sequence[str],
    task: str,
    group: Sequence[str] | None = None,
    hot_rows: int = HOT_ROWS,
) -> DataFrame:
    """Every metric of the task, one wide row per group.

    Quantiles and means share one pass; rank metrics and projections take one more each, over scores written once.
    """
    df = _scores(df, by, group or ())
    if task == "binary":
        df = _with_clip(df, by)
        parts = [_binary_pass(df, by, hot_rows), rank_metrics(df, by, hot_rows)]
    else:
        parts = [_regression_pass(df, by, hot_rows)]
    if group is not None:
        parts.append(projected_metrics(df, by, group, task == "binary", hot_rows))
        if task == "binary":
            parts.append(projected_log_loss(df, by, group, hot_rows))
    return reduce(lambda a, b: join_groups(a, b, by), parts)


def _regression_pass(df: DataFrame, by: Sequence[str], hot_rows: int) -> DataFrame:
    r = F.col("y") - F.col("yhat")
    mse = F.avg(F.col("r") * F.col("r"))
    means = {
        "mean_residual": F.avg("r"),
        "mse": mse,
        "rmse": F.sqrt(mse),
        "mae": F.avg("a"),
    }
    q = quantiles(df, by, {"r": r, "a": F.abs(r)}, RESIDUAL_Q, hot_rows=hot_rows, extra=means)
    arrays = {"r": (RESIDUAL_Q, "quantile_{q}"), "a": (RESIDUAL_Q, "abs_quantile_{q}")}
    out = _spread(q, [*by, *means], arrays)
    squares = [(F.col(f"`abs_quantile_{p}`") ** 2).alias(f"mse_quantile_{p}") for p in RESIDUAL_Q]
    return out.select("*", *squares)


def _binary_pass(df: DataFrame, by: Sequence[str], hot_rows: int) -> DataFrame:
    y, p = F.col("y"), F.col("_yhat")
    both = F.min("_one") < F.max("_one")
    carry = {"_one": (y == 1).cast("double"), "_hit": ((p >= 0.5) == (y == 1)).cast("double")}
    means = {
        "mean_residual": F.avg("r"),
        "accuracy": F.when(both, F.avg("_hit")),
        "log_loss": F.when(both, F.avg("l")),
        "brier": F.when(both, F.avg(F.col("r") * F.col("r"))),
    }
    values = {"r": y - p, "l": log_loss(y, p)}
    levels = {"r": RESIDUAL_Q, "l": LOSS_Q}
    q = quantiles(df, by, values, levels, hot_rows=hot_rows, extra=means, carry=carry)
    arrays = {"r": (RESIDUAL_Q, "quantile_{q}"), "l": (LOSS_Q, "log_loss_quantile_{q}")}
    return _spread(q, [*by, *means], arrays)


def metrics_long(wide: DataFrame, by: Sequence[str]) -> DataFrame:
    """(by, metric, value) from wide metric columns."""
    names = [c for c in wide.columns if c not in by]
    pairs = [
        F.struct(F.lit(n).alias("metric"), F.col(f"`{n}`").cast("double").alias("value")) for n in names
    ]
    return wide.select(*by, F.inline(F.array(*pairs)))


def to_wide(results: DataFrame, ids: Sequence[str], names: Sequence[str]) -> DataFrame:
    """Long (target, split, metric, value) to ``{target}/{split}/{metric}`` columns."""
    name = F.concat_ws("/", "target", "split", "metric")
    return results.withColumn("_name", name).groupBy(*ids).pivot("_name", list(names)).agg(F.first("value"))


def to_long(wide: DataFrame, ids: Sequence[str]) -> DataFrame:
    """Columns named ``{target}/{split}/{metric}`` back to long rows."""
    names = [c for c, t in wide.dtypes if c.count("/") == 2 and t == "double"]
    long = wide.unpivot(list(ids), [F.col(f"`{n}`") for n in names], "_name", "value")
    parts = F.split("_name", "/")
    return long.select(
        *ids,
        parts[0].alias("target"),
        parts[1].alias("split"),
        parts[2].alias("metric"),
        "value",
    )


