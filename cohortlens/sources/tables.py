"""Reading feature tables, the variable dictionary and single columns."""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql import types as T

from ..functions.columns import finite

DICTIONARY_SCHEMA = T.StructType(
    [
        T.StructField(name, T.StringType())
        for name in (
            "VariableID",
            "VariableTag",
            "VariableName",
            "VariableType",
            "DatasetVersion",
            "OrganSystem",
            "TreatmentGroups",
            "Unit",
            "DataType",
            "LowerBound",
            "UpperBound",
            "Description",
            "LogTransform",
            "LogTransformEps",
            "PossibleValues",
            "TreatmentDetailLevel",
        )
    ]
)


def normalise_missing(df: DataFrame) -> DataFrame:
    """NaN and infinities of floating columns become null, so that null alone means missing."""
    floats = [c for c, t in df.dtypes if t in ("double", "float")]
    return df.withColumns({c: finite(F.col(c)) for c in floats})


def load(
    spark: SparkSession,
    root: str,
    sources: Sequence[str],
    outcome: str,
    split: str | None = None,
    variables: Sequence[str] | None = None,
    horizons: Sequence[int] | None = None,
    other_columns: Sequence[str] = (),
) -> DataFrame:
    """Features, outcome ``y`` and side columns of the chosen datasets and split.

    The table is partitioned by ``dataset``: sources prune folders, the column list prunes
    the scan. Horizon features are named ``{variable}_..._h{hours}``; ``horizons`` limits
    which hours are kept.
    """
    df = spark.read.parquet(root).where(F.col("dataset").isin(list(sources)))
    df = df.where(F.col(outcome).isNotNull())
    if split is not None:
        df = df.where(F.col("split") == split)
    features = []
    if variables is not None:
        for c in df.columns:
            stem = next((v for v in variables if c == v or c.startswith(v + "_")), None)
            if stem is None:
                continue
            hours = c.rsplit("_h", 1)[-1] if "_h" in c else ""
            if horizons is not None and hours.isdigit() and int(hours) not in horizons:
                continue
            features.append(c)
    else:
        special = {outcome, "split", "dataset", *other_columns}
        features = [c for c in df.columns if c not in special]
    out = normalise_missing(df.select(*features, F.col(outcome).alias("y"), *other_columns))
    return out.where("y is not null")


def scan_column(spark: SparkSession, path: str, column: str) -> DataFrame:
    """One column of a table; nothing else is read."""
    return spark.read.parquet(path).select(column)


def read_dictionary(spark: SparkSession, path: str) -> DataFrame:
    """The variable dictionary: tab separated, ``None`` is null, rows with a version."""
    raw = spark.read.csv(path, sep="\t", header=True, nullValue="None", schema=DICTIONARY_SCHEMA)
    return raw.where("DatasetVersion is not null").withColumns(
        {
            "VariableID": F.col("VariableID").cast("int"),
            "LowerBound": F.col("LowerBound").cast("double"),
            "UpperBound": F.col("UpperBound").cast("double"),
            "LogTransformEps": F.col("LogTransformEps").cast("double"),
            "LogTransform": F.lower("LogTransform") == "true",
        }
    )
