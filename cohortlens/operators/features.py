"""Features along the hourly grid and value transforms driven by the dictionary."""

from __future__ import annotations

from collections.abc import Mapping, Sequence

from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from ..functions.bounded import lookup
from ..functions.columns import clip, log_or_null
from .cohort import STAY, TIME

# Trailing horizons in hours, fill values for missing anchors.
HORIZONS = (8, 24)
MISSING_INT_ANCHOR = 2010
MISSING_STRING_ANCHOR = "other"


def _trailing(keys: Sequence[str], hours: int | None = None):
    w = Window.partitionBy(*keys).orderBy(TIME)
    start = Window.unboundedPreceding if hours is None else -(hours - 1)
    return w.rowsBetween(start, 0)


def ffill(
    df: DataFrame, cols: Sequence[str], keys: Sequence[str] = STAY, suffix: str = "_ffilled"
) -> DataFrame:
    """Last non-null value per stay up to each hour."""
    w = _trailing(keys)
    return df.withColumns({c + suffix: F.last(c, ignorenulls=True).over(w) for c in cols})


def horizon_mean(
    df: DataFrame, cols: Sequence[str], hours: int, keys: Sequence[str] = STAY
) -> DataFrame:
    """Mean of the observed values in the trailing ``hours``."""
    w = _trailing(keys, hours)
    return df.withColumns({f"{c}_mean_h{hours}": F.avg(c).over(w) for c in cols})


def all_missing(
    df: DataFrame, cols: Sequence[str], hours: int, keys: Sequence[str] = STAY
) -> DataFrame:
    """Whether nothing was observed in the trailing ``hours``."""
    w = _trailing(keys, hours)
    return df.withColumns({f"{c}_all_missing_h{hours}": F.count(c).over(w) == 0 for c in cols})


def clip_bounds(df: DataFrame, bounds: Mapping[str, tuple[float | None, float | None]]) -> DataFrame:
    """Clamp wide columns to their (lower, upper) dictionary bounds."""
    return df.withColumns({c: clip(F.col(c), lo, up) for c, (lo, up) in bounds.items()})


def log_transform(df: DataFrame, eps: Mapping[str, float | None]) -> DataFrame:
    """log(x + eps) for the listed columns, not finite results become null."""
    return df.withColumns({c: log_or_null(F.col(c), e) for c, e in eps.items()})


def zero_to_null(df: DataFrame, cols: Sequence[str]) -> DataFrame:
    return df.withColumns({c: F.nullif(F.col(c), F.lit(0.0)) for c in cols})


def fill_anchor_nulls(df: DataFrame, cols: Sequence[str]) -> DataFrame:
    """Missing integers become a fixed year, strings a fixed category, booleans false."""
    types = dict(df.dtypes)
    fill = {}
    for c in cols:
        if types[c] in ("int", "bigint", "smallint", "tinyint"):
            fill[c] = MISSING_INT_ANCHOR
        elif types[c] == "string":
            fill[c] = MISSING_STRING_ANCHOR
        elif types[c] == "boolean":
            fill[c] = False
    return df.fillna(fill)


def saturation_input(
    df: DataFrame, flag: str, if_true: str, if_false: str, out: str, fill_from: str | None = None
) -> DataFrame:
    """``if_true`` where flagged, else ``if_false``; then nulls get the mean of a column."""
    mean = df.agg(F.avg(fill_from or if_false)).first()[0]
    chosen = F.when(F.col(flag), F.col(if_true)).otherwise(F.col(if_false))
    return df.withColumn(out, F.coalesce(chosen, F.lit(mean).cast("double")))


def transform_by_dictionary(
    long: DataFrame, dictionary: DataFrame, tag: str = "variable", value: str = "value"
) -> DataFrame:
    """Clip, drop treatment zeros and log-transform a long table in one pass.

    ``dictionary`` is metadata with one row per variable (bounded, hence looked up).
    """
    meta = lookup(
        dictionary.select(
            F.col("VariableTag").alias(tag),
            F.col("DataType").alias("_type"),
            F.col("LowerBound").alias("_lo"),
            F.col("UpperBound").alias("_up"),
            F.col("LogTransform").alias("_log"),
            F.col("LogTransformEps").alias("_eps"),
        )
    )
    x = F.col(value).cast("double")
    clipped = F.when(x.isNotNull(), F.least(F.greatest(x, F.col("_lo")), F.col("_up")))
    kept = F.when(F.col("_type") == "treatment_cont", F.nullif(clipped, F.lit(0.0))).otherwise(clipped)
    shifted = kept + F.coalesce(F.col("_eps"), F.lit(0.0))
    logged = F.when(F.col("_log"), F.when(shifted > 0, F.log(shifted))).otherwise(kept)
    out = long.join(meta, tag).withColumn(value, logged)
    return out.drop("_lo", "_up", "_log", "_eps").withColumnRenamed("_type", "data_type")
