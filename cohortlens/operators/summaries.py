"""Summary tables and distributions per dataset."""

from __future__ import annotations

from collections.abc import Mapping, Sequence

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from ..functions.bounded import bounded_rows, lookup
from ..functions.joins import join_groups
from .features import transform_by_dictionary
from .results import best_by, greater_is_better, loeo_cv

MAX_DATASETS = 1_000
# Points of a density curve, share of the range used as bandwidth.
KDE_POINTS = 300
KDE_SHARE = 80


def _n_values(c: str):
    """Number of distinct values where null counts as one."""
    return F.count_distinct(c) + F.max(F.col(c).isNull().cast("int"))


def anchor_table(
    df: DataFrame, cols: Sequence[str], lists: Sequence[str] = (), by: str = "dataset"
) -> DataFrame:
    """Number of distinct values of every anchor per dataset."""
    out = df.groupBy(by).agg(*[_n_values(c).cast("long").alias(c) for c in cols])
    for c in lists:
        elements = df.select(by, F.explode_outer(c).alias(c))
        out = out.join(elements.groupBy(by).agg(_n_values(c).cast("long").alias(c)), by)
    return out


def dataset_summary(
    df: DataFrame, by: str = "dataset", patient: str = "patient_id", stay: str = "stay_id", display: bool = False
) -> DataFrame:
    """Patients, stays and mean length of stay in days (hourly rows per stay / 24)."""
    out = df.groupBy(by).agg(
        F.count_distinct(patient).alias("num_patients"),
        F.count_distinct(stay).alias("num_stays"),
        (F.count("*") / F.count_distinct(stay) / 24).alias("average_los"),
    )
    if not display:
        return out
    return out.select(
        by,
        F.format_number("num_patients", 0).alias("num_patients"),
        F.format_number("num_stays", 0).alias("num_stays"),
        F.format_number("average_los", 1).alias("average_los"),
    )


def outcome_summary(
    df: DataFrame,
    outcomes: Mapping[str, str],
    by: str = "dataset",
    patient: str = "patient_id",
    stay: str = "stay_id",
) -> DataFrame:
    """Per dataset and outcome: patients, stays, samples, and prevalence or mean and sd.

    ``outcomes`` maps a column to ``binary`` or ``regression``; rows without the outcome
    do not count for it.
    """
    pairs = [
        F.struct(
            F.lit(o).alias("outcome"), F.lit(t).alias("task"), F.col(o).cast("double").alias("_y")
        )
        for o, t in outcomes.items()
    ]
    long = df.select(by, patient, stay, F.inline(F.array(*pairs))).where("_y is not null")
    binary = F.first("task") == "binary"
    return long.groupBy(by, "outcome").agg(
        F.count_distinct(patient).alias("num_patients"),
        F.count_distinct(stay).alias("num_stays"),
        F.count("*").alias("num_samples"),
        F.when(binary, 100 * F.avg("_y")).alias("prevalence"),
        F.when(~binary, F.avg("_y")).alias("mean"),
        F.when(~binary, F.stddev_pop("_y")).alias("sd"),
    )


def transpose(df: DataFrame, header: str, out: str = "column") -> DataFrame:
    """Turn a small table: one row per former column, one column per former row."""
    labels = [r[0] for r in bounded_rows(df.select(F.col(header).cast("string")), MAX_DATASETS, "table")]
    if len(set(labels)) != len(labels):
        raise ValueError(f"{header} does not identify rows")
    rest = [c for c in df.columns if c != header]
    long = df.select(F.col(header).cast("string").alias("_h"), *[F.col(c).cast("string") for c in rest])
    long = long.unpivot(["_h"], rest, out, "_v")
    return long.groupBy(out).pivot("_h", sorted(labels)).agg(F.first("_v"))


def prevalence(df: DataFrame, y: str = "y", by: str = "dataset") -> DataFrame:
    return df.groupBy(by).agg(F.avg(F.col(y).cast("double")).alias("prevalence")).orderBy(by)


def missing_rate(df: DataFrame, cols: Sequence[str], by: str = "dataset") -> DataFrame:
    return df.groupBy(by).agg(*[F.avg(F.col(c).isNull().cast("double")).alias(c) for c in cols])


def category_shares(df: DataFrame, keys: Sequence[str], c: str) -> DataFrame:
    """(keys, category, share): share of each value among the non-null ones."""
    counts = df.where(F.col(c).isNotNull()).groupBy(*keys, F.col(c).alias("category")).agg(
        F.count("*").alias("_n")
    )
    totals = counts.groupBy(*keys).agg(F.sum("_n").alias("_total"))
    return join_groups(counts, lookup(totals), keys).select(
        *keys, "category", (F.col("_n") / F.col("_total")).alias("share")
    )


def category_distribution(df: DataFrame, c: str, by: str = "dataset") -> DataFrame:
    """Value shares per dataset side by side, absent values 0, plus a row of null shares."""
    names = sorted(r[0] for r in bounded_rows(df.select(by).distinct(), MAX_DATASETS, by))
    shares = category_shares(df.withColumn(c, F.col(c).cast("string")), [by], c)
    nulls = missing_rate(df, [c], by).select(by, F.lit("(missing)").alias("category"), F.col(c).alias("share"))
    both = shares.unionByName(nulls)
    return both.groupBy("category").pivot(by, names).agg(F.first("share")).fillna(0.0, names)


def kde(
    df: DataFrame,
    value: str,
    points: int = KDE_POINTS,
    by: str = "dataset",
    over: Sequence[str] = (),
) -> DataFrame:
    """Gaussian kernel density on a grid from each dataset's minimum to its maximum.

    The kernel width is a fixed share of the overall range, scaled by the dataset's sd over
    the overall sd (per group of ``over``). Equal values are counted first; every distinct
    value then adds to each grid point inside a partial aggregate, so the shuffle carries
    one row per grid point and task. Datasets with fewer than two distinct values get no curve.
    """
    keys = [*over, by]
    x = F.col(value).cast("double")
    base = df.where(F.col(value).isNotNull())
    counts = base.groupBy(*keys, x.alias("_v")).agg(F.count("*").alias("_c"))
    spread = [
        F.count("*").alias("_n"),
        F.min(x).alias("_min"),
        F.max(x).alias("_max"),
        F.stddev_samp(x).alias("_sd"),
    ]
    each = base.groupBy(*keys).agg(*spread)
    scale = base.groupBy(*(over or [F.lit(1).alias("_all")])).agg(
        ((F.max(x) - F.min(x)) / F.lit(KDE_SHARE) / F.stddev_pop(x)).alias("_bw")
    )
    if over:
        each = each.join(lookup(scale), list(over))
    else:
        each = each.withColumn("_bw", F.lit(scale.first()["_bw"]).cast("double"))
    each = lookup(each.where("_n > 1 and _min < _max").withColumn("_h", F.col("_sd") * F.col("_bw")))
    grid = F.explode(F.sequence(F.lit(0), F.lit(points - 1))).alias("point")
    spots = counts.join(each, keys).select(*keys, "_v", "_c", "_n", "_h", "_min", "_max", grid)
    at = F.col("_min") + F.col("point") * (F.col("_max") - F.col("_min")) / F.lit(points - 1)
    z = (at - F.col("_v")) / F.col("_h")
    weight = F.col("_c") * F.exp(-0.5 * z * z) / (F.col("_n") * F.col("_h") * F.sqrt(2 * F.pi()))
    return spots.withColumn("x", at).groupBy(*keys, "point", "x").agg(F.sum(weight).alias("density"))


def variable_report(
    df: DataFrame, dictionary: DataFrame, by: str = "dataset", points: int = KDE_POINTS
) -> tuple[DataFrame, DataFrame]:
    """Distribution of every dictionary variable: (densities, category shares).

    Continuous variables are clipped, freed of treatment zeros and log-transformed, then
    get a density and a missing share; discrete ones get value shares, where a missing
    treatment indicator counts as false. All variables share one pass over a long table.
    """
    types = dict(df.dtypes)
    meta = bounded_rows(dictionary.select("VariableTag", "DataType"), what="dictionary")
    smooth = [r[0] for r in meta if r[1] in ("continuous", "treatment_cont") and r[0] in types]
    discrete = [(r[0], r[1]) for r in meta if r[1] in ("categorical", "treatment_ind") and r[0] in types]
    long = transform_by_dictionary(
        _long(df, by, {v: F.col(v).cast("double") for v in smooth}, "double"), dictionary
    )
    missing = long.groupBy("variable", by).agg(
        F.avg(F.col("value").isNull().cast("double")).alias("missing")
    )
    density = join_groups(kde(long, "value", points, by, ["variable"]), lookup(missing), ["variable", by])
    cats = {
        v: (F.coalesce(F.col(v), F.lit(False)) if t == "treatment_ind" else F.col(v)).cast("string")
        for v, t in discrete
    }
    shares = category_shares(_long(df, by, cats, "string"), ["variable", by], "value")
    return density, shares


def _long(df: DataFrame, by: str, cols: Mapping[str, Column], dtype: str) -> DataFrame:
    """(by, variable, value) of the given columns; no rows when there are none."""
    pairs = [F.struct(F.lit(v).alias("variable"), c.alias("value")) for v, c in cols.items()]
    typed = F.array(*pairs).cast(f"array<struct<variable:string,value:{dtype}>>")
    return df.select(by, F.inline(typed))


def residual_band(
    results: DataFrame, params: Sequence[str], cv_metric: str, by: str = "gamma"
) -> DataFrame:
    """Mean and quantiles of the test residuals at the best run for each ``by`` value."""
    cv = loeo_cv(results, params, [cv_metric]).where("run_id is not null")
    best = best_by(cv, ["eval_target", by], "cv_value", greater_is_better(), list(params))
    best = best.select("eval_target", by, "run_id", *[p for p in params if p != by])
    wanted = results.where(
        (F.col("split") == "test")
        & (F.col("metric").startswith("quantile_") | (F.col("metric") == "mean_residual"))
    ).select("run_id", *params, F.col("target").alias("eval_target"), "metric", "value")
    return wanted.join(best, ["eval_target", "run_id", *params])
