"""Joins in which a null key is a key like any other."""

from __future__ import annotations

from collections.abc import Sequence
from functools import reduce

from pyspark.sql import DataFrame
from pyspark.sql import functions as F


def join_groups(left: DataFrame, right: DataFrame, keys: Sequence[str], how: str = "inner") -> DataFrame:
    """Join on equal keys, nulls included; the keys appear once, in front as in a join by names."""
    names = {k: f"_key_{i}" for i, k in enumerate(keys)}
    renamed = right.withColumnsRenamed(names)
    same = reduce(lambda a, b: a & b, [F.col(f"`{k}`").eqNullSafe(F.col(n)) for k, n in names.items()])
    joined = left.join(renamed, same, how)
    if how in ("left_semi", "left_anti"):
        return joined
    # Of an outer join's two keys, the one of the side that has no row is null.
    key = [F.coalesce(F.col(f"`{k}`"), F.col(n)).alias(k) for k, n in names.items()]
    rest = [f"`{c}`" for c in [*left.columns, *right.columns] if c not in names]
    return joined.select(*key, *rest)
