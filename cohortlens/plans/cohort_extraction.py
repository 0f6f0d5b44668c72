"""Observations to a gridded cohort with attrition report."""

from __future__ import annotations

from collections.abc import Sequence

from pyspark import StorageLevel
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from ..operators.cohort import (
    MAX_STAY_DAYS,
    STAY,
    Rules,
    attrition,
    concepts_wide,
    flag_exclusions,
    map_to_grid,
    static_for,
    stay_windows,
    stop_obs_at,
)
from ..sources.stores import Cohort


def extract_cohort(
    obs: DataFrame,
    sta: DataFrame,
    concepts: Sequence[str],
    rules: Rules = Rules(),
    max_days: int = MAX_STAY_DAYS,
    stays: DataFrame | None = None,
) -> Cohort:
    """Windows, truncation, exclusions, grid.

    ``obs`` is long (dataset, stay_id, concept, time_h, value). It is pivoted once; the wide
    table and the one-row-per-stay flags serve several outputs, so both are kept.
    ``stays`` (keys, start_h, end_h) may bring ``los_icu``, the source's own length of stay in days; else
    it is taken from the whole hours.
    """
    wide = concepts_wide(obs, concepts).persist(StorageLevel.MEMORY_AND_DISK)
    windows = stay_windows(obs) if stays is None else stays
    hours = F.col("end_h") - F.col("start_h")
    own = F.coalesce(F.col("los_icu") * 24, hours) if "los_icu" in windows.columns else hours
    windows = windows.withColumn("los_h", own).drop("los_icu")
    whole = F.col("end_h").alias("whole_end_h")
    cut = stop_obs_at(windows.select("*", whole), max_days * 24)
    marked = flag_exclusions(cut, wide, concepts, rules).persist(StorageLevel.MEMORY_AND_DISK)
    hit = F.col("rule_1") | F.col("rule_2") | F.col("rule_3") | F.col("rule_4")
    kept = marked.where(~hit & (F.col("n_rows") > 0)).select(*STAY, "start_h", "end_h")
    return Cohort(
        patients=marked.select(*STAY, "start_h", F.col("whole_end_h").alias("end_h")),
        los_icu=marked.select(*STAY, (F.col("los_h") / 24).alias("los_icu")),
        dyn=map_to_grid(kept, wide),
        sta=static_for(kept, sta),
        attrition=attrition(marked),
        cached=(wide, marked),
    )
