"""Window operators along the hourly grid of one stay."""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from .cohort import STAY, TIME


def _frame(n: int, align: str) -> tuple[int, int]:
    if align == "left":
        return 0, n - 1
    if align == "right":
        return -(n - 1), 0
    if align == "center":
        return -(n - 1 - n // 2), n // 2
    raise ValueError(f"unknown alignment: {align}")


def pad_rollsum(
    df: DataFrame,
    col: str,
    n: int,
    align: str,
    out: str | None = None,
    keys: Sequence[str] = STAY,
    na_rm: bool = True,
) -> DataFrame:
    """Rolling sum over ``n`` rows; the frame may reach over the ends into missing padding.

    With ``na_rm`` missing cells count as zero, otherwise a frame that holds any missing
    or padded cell gives null.
    """
    w = Window.partitionBy(*keys).orderBy(TIME).rowsBetween(*_frame(n, align))
    total = F.sum(F.col(col).cast("double")).over(w)
    value = F.coalesce(total, F.lit(0.0)) if na_rm else F.when(F.count(col).over(w) == n, total)
    return df.withColumn(out or col, value)


def pad_rollind(
    df: DataFrame,
    col: str,
    n: int,
    align: str,
    out: str | None = None,
    keys: Sequence[str] = STAY,
    na_rm: bool = True,
) -> DataFrame:
    """Whether the rolling sum is positive; input must not be negative."""
    value = F.col(col).cast("double")
    checked = df.withColumn(
        out or col,
        F.when(value < 0, F.raise_error(F.lit(f"{col} must not be negative"))).otherwise(value),
    )
    summed = pad_rollsum(checked, out or col, n, align, out or col, keys, na_rm)
    return summed.withColumn(out or col, F.col(out or col) > 0)


def outcome_window(
    df: DataFrame,
    col: str,
    before: int,
    after: int,
    out: str | None = None,
    keys: Sequence[str] = STAY,
) -> DataFrame:
    """Spread an event to ``before`` hours earlier and ``after`` hours later.

    Spreading back and then forward covers exactly the rows from ``after`` before to
    ``before`` behind each row, so one frame does both passes.
    """
    value = F.col(col).cast("double")
    value = F.when(value < 0, F.raise_error(F.lit(f"{col} must not be negative"))).otherwise(value)
    order = Window.partitionBy(*keys).orderBy(TIME)
    total = F.sum(value).over(order.rowsBetween(-after, before))
    step = F.col(TIME) - F.lag(TIME).over(order)
    failed = F.raise_error(F.lit("an id's hours have gaps or repeats")).cast("boolean")
    if before + after == 0:
        # Nothing is spread, but the checks hold all the same.
        same = F.when(F.coalesce(value, F.lit(0.0)) < 0, None).otherwise(F.col(col))
        return df.withColumn(out or col, F.when(step != 1, failed.cast(df.schema[col].dataType)).otherwise(same))
    return df.withColumn(out or col, F.when(step != 1, failed).otherwise(F.coalesce(total, F.lit(0.0)) > 0))


def set_window(
    df: DataFrame, col: str, start: int, stop: int, value, keys: Sequence[str] = STAY
) -> DataFrame:
    """Set ``col`` to a constant where ``start <= time < stop``; hours with gaps or repeats raise an error."""
    inside = (F.col(TIME) >= start) & (F.col(TIME) < stop)
    step = F.col(TIME) - F.lag(TIME).over(Window.partitionBy(*keys).orderBy(TIME))
    failed = F.raise_error(F.lit("an id's hours have gaps or repeats")).cast(df.schema[col].dataType)
    return df.withColumn(col, F.when(step != 1, failed).when(inside, F.lit(value)).otherwise(F.col(col)))


def gaps(df: DataFrame, keys: Sequence[str] = STAY) -> DataFrame:
    """Whether each id's hours, in order, ever step by anything but one."""
    hours = df.groupBy(*keys, TIME).agg(F.count("*").alias("_rows"))
    span = F.max(TIME) - F.min(TIME) + 1
    return hours.groupBy(*keys).agg(
        ((F.count("*") < span) | (F.max("_rows") > 1)).alias("has_gaps")
    )


def has_gaps(df: DataFrame, keys: Sequence[str] = STAY) -> bool:
    """True when any id has a hole or a repeated hour."""
    return not gaps(df, keys).where("has_gaps").isEmpty()
