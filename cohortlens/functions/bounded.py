"""Small side tables: collected and broadcast only after their size was checked."""

from __future__ import annotations

import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql import types as T
from pyspark.sql.pandas.types import to_arrow_schema

#: Most rows a side table may have to be shipped whole to every executor.
MAX_LOOKUP_ROWS = 10_000


def bounded_rows(df: DataFrame, max_rows: int = MAX_LOOKUP_ROWS, what: str = "table") -> list:
    """Rows of a table that must be small by design; fails loudly when it is not."""
    rows = df.limit(max_rows + 1).collect()
    if len(rows) > max_rows:
        raise ValueError(f"{what} has more than {max_rows} rows")
    return rows


def lookup(df: DataFrame, max_rows: int = MAX_LOOKUP_ROWS) -> DataFrame:
    """Side table for a join: broadcast when at most ``max_rows``, else left as it is.

    The bounded fetch evaluates the aggregate once and replaces it by its rows, so the
    following join neither recomputes it nor shuffles the large side. Above the bound
    the join stays a shuffle join, where adaptive execution splits skewed partitions.
    """
    table = df.limit(max_rows + 1).toArrow()
    if table.num_rows > max_rows:
        return df
    return F.broadcast(df.sparkSession.createDataFrame(table, schema=df.schema))


def local_table(spark: SparkSession, rows: list[dict], schema: str) -> DataFrame:
    """A driver-made table (grids, roles, coefficients), marked for broadcast."""
    parsed = T.StructType.fromDDL(schema)
    arrow = to_arrow_schema(parsed)
    return F.broadcast(spark.createDataFrame(pa.Table.from_pylist(rows, schema=arrow), schema=parsed))
