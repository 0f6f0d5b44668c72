"""Helpers that several of the operators share."""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

#: Most bytes of one column that a Python worker holds at a time, one long value aside.
BATCH_BYTES = 4 << 20


def table(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    return spark.read.parquet(f"{sf_dir}/{name}.parquet")


def only(df: DataFrame, **columns: str) -> DataFrame:
    """Just the wanted columns under internal names, so that other columns cannot clash.

    Names are matched as Spark matches them; a name that occurs twice raises an error.
    """
    return df.select(*(F.col(f"`{source}`").alias(name) for name, source in columns.items()))


def fresh(df: DataFrame, name: str) -> str:
    """``name``, or the first longer one that no column of ``df`` has."""
    taken = {c.lower() for c in df.columns}
    while name.lower() in taken:
        name += "_"
    return name


def slices(batches: Iterator[pa.RecordBatch], column: str, most: int = BATCH_BYTES) -> Iterator[pa.RecordBatch]:
    """Arrow batches cut so that ``column`` has about ``most`` bytes in each (a longer single value
    stands alone)."""
    at_most_rows = 4096
    for batch in batches:
        values = batch.column(column)
        sizes = np.asarray(pc.fill_null(pc.binary_length(values), 0), dtype=np.int64)
        start = total = 0
        for i, size in enumerate(sizes.tolist()):
            if i > start and (total + size > most or i - start >= at_most_rows):
                yield batch.slice(start, i - start)
                start, total = i, 0
            total += size
        if start < batch.num_rows:
            yield batch.slice(start)


def merge_labels(labels: np.ndarray, u: np.ndarray, v: np.ndarray) -> np.ndarray:
    """Joins the sets of ``u[i]`` and ``v[i]``; ``labels[x]`` is the smallest member of x's set."""
    while True:
        a, b = labels[u], labels[v]
        open_ = a != b
        if not open_.any():
            return labels
        u, v, a, b = u[open_], v[open_], a[open_], b[open_]
        np.minimum.at(labels, np.maximum(a, b), np.minimum(a, b))
        while True:
            up = labels[labels]
            if np.array_equal(up, labels):
                break
            labels = up


def sorted_groups(batches: Iterator[pa.RecordBatch], keys: list[str]) -> Iterator[pa.Table]:
    """Whole groups of a partition that is sorted by ``keys`` (no nulls in them); groups must be bounded."""
    held: list[pa.RecordBatch] = []
    last = None
    for batch in batches:
        if batch.num_rows == 0:
            continue
        columns = [np.asarray(batch.column(k)) for k in keys]
        new = np.zeros(batch.num_rows, bool)
        for c in columns:
            new[1:] |= c[1:] != c[:-1]
        cuts = [0, *np.flatnonzero(new).tolist(), batch.num_rows]
        for s, e in zip(cuts[:-1], cuts[1:], strict=True):
            key = tuple(c[s] for c in columns)
            if held and key != last:
                yield pa.Table.from_batches(held)
                held = []
            held.append(batch.slice(s, e - s))
            last = key
    if held:
        yield pa.Table.from_batches(held)
