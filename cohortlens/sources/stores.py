"""Result and cohort tables on shared storage."""

from __future__ import annotations

from dataclasses import dataclass

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

SECONDS_PER_HOUR = 3600


def write_results(
    df: DataFrame,
    root: str,
    experiment: str,
    mode: str = "append",
    format: str = "parquet",
    name: str = "results",
) -> str:
    """Write a result table of one experiment; the experiment is a partition folder."""
    path = f"{root}/{name}"
    out = df.withColumn("experiment", F.lit(experiment))
    writer = out.write.mode(mode).partitionBy("experiment")
    if format == "csv":
        writer.option("header", True).csv(path)
    elif format == "parquet":
        writer.parquet(path)
    else:
        raise ValueError(f"unknown format: {format}")
    return path


def parse_list_tags(df: DataFrame, tags: list[str]) -> DataFrame:
    """Tags like ``['a', 'b']`` become arrays; other texts become one-element arrays."""
    parsed = {}
    for t in tags:
        as_json = F.from_json(F.regexp_replace(t, "'", '"'), "array<string>")
        listed = F.col(t).contains("[") & F.col(t).contains("]") & F.col(t).contains(",")
        parsed[t] = F.when(listed, as_json).otherwise(F.array(F.col(t)))
    return df.withColumns(parsed)


def read_results(
    spark: SparkSession,
    root: str,
    experiment: str | None = None,
    list_tags: tuple[str, ...] = ("sources",),
    name: str = "results",
) -> DataFrame:
    """All runs of an experiment as one table with merged columns; list tags become arrays."""
    df = spark.read.option("mergeSchema", "true").parquet(f"{root}/{name}")
    if experiment is not None:
        df = df.where(F.col("experiment") == experiment)
    types = dict(df.dtypes)
    return parse_list_tags(df, [t for t in list_tags if types.get(t) == "string"])


@dataclass
class Cohort:
    """Tables of an extracted cohort; ``dyn`` has ``time_h`` in hours."""

    patients: DataFrame
    los_icu: DataFrame
    dyn: DataFrame
    sta: DataFrame
    attrition: DataFrame
    hospital: DataFrame | None = None
    cached: tuple[DataFrame, ...] = ()

    def release(self) -> None:
        """Drop the tables kept for the outputs, once they are written."""
        for df in self.cached:
            df.unpersist()


def write_cohort(c: Cohort, path: str, mode: str = "overwrite", multi_centre: bool = False) -> None:
    """Write the cohort: Parquet by dataset, time in seconds, attrition as CSV.

    The hospital table is written only for multi-centre sources.
    """
    seconds = (F.col("time_h") * SECONDS_PER_HOUR).cast("long")
    dyn = c.dyn.withColumn("time", seconds).drop("time_h")
    for name, df in (("patients", c.patients), ("los_icu", c.los_icu), ("dyn", dyn), ("sta", c.sta)):
        df.write.mode(mode).partitionBy("dataset").parquet(f"{path}/{name}")
    c.attrition.write.mode(mode).option("header", True).csv(f"{path}/attrition")
    if multi_centre and c.hospital is not None:
        c.hospital.write.mode(mode).parquet(f"{path}/hospital")
