"""Exact order statistics per group that do not depend on a group fitting one task.

Rows are written to storage once, since every method passes over them more than once. Smaller groups
are sorted by one window, which can spill. For quantiles of a larger group the values are
counted in bins of equal width; only the bins that hold a wanted rank are looked at again, in narrower bins,
until they are small enough to be ordered. Running totals of a larger group are taken in ranges of values.
Bins and ranges only balance the work: their counts are exact, so the result is exact wherever they are cut.
"""

from __future__ import annotations

import math
from collections.abc import Mapping, Sequence
from functools import reduce

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from ..functions.bounded import lookup
from ..functions.joins import join_groups
from ..session import pin, pinned

#: Largest group handled inside one task, and largest one that is sorted for its quantiles: counting costs less.
HOT_ROWS = 4_000_000
SORT_ROWS = 100_000
#: Bins between the ends of a bracket, and rounds of narrowing after which brackets are ordered as they are.
BINS = 1024
ROUNDS = 10
#: Rows of a range of running totals, about, and most ranges.
RANGE_ROWS = 1_000_000
MOST_RANGES = 4_096


def running_totals(
    df: DataFrame,
    keys: Sequence[str],
    value: str,
    sums: Mapping[str, Column],
    hot_rows: int = HOT_ROWS,
) -> DataFrame:
    """Per group and distinct value: ``sums``, and their totals up to and including it.

    Rows are reduced to distinct values before anything is ordered. Columns out: keys,
    value, each sum ``s`` and ``cum_s``.
    """
    d = pin(df.groupBy(*keys, value).agg(*[c.alias(s) for s, c in sums.items()]))
    sizes = d.groupBy(*keys).agg(F.count("*").alias("_rows"))
    most, rows = sizes.agg(F.max("_rows"), F.sum("_rows")).first()
    if most is None or most <= hot_rows:
        w = Window.partitionBy(*keys).orderBy(value).rowsBetween(Window.unboundedPreceding, 0)
        return d.withColumns({f"cum_{s}": F.sum(s).over(w) for s in sums})
    # Written down, since ranges cut twice need not be the same twice.
    ranges = min(MOST_RANGES, max(2, math.ceil(rows / min(hot_rows, RANGE_ROWS))))
    cut = d.repartitionByRange(ranges, *[f"`{c}`" for c in (*keys, value)])
    b = pin(cut.withColumn("_range", F.spark_partition_id()))
    # At most MOST_RANGES ranges per group, so this window is small for any group.
    across = Window.partitionBy(*keys).orderBy("_range").rowsBetween(Window.unboundedPreceding, -1)
    offsets = (
        b.groupBy(*keys, "_range")
        .agg(*[F.sum(s).alias(f"_t_{s}") for s in sums])
        .select(
            *keys,
            "_range",
            *[F.coalesce(F.sum(f"_t_{s}").over(across), F.lit(0)).alias(f"_o_{s}") for s in sums],
        )
    )
    within = Window.partitionBy(*keys, "_range").orderBy(value).rowsBetween(Window.unboundedPreceding, 0)
    inner = b.withColumns({f"_w_{s}": F.sum(s).over(within) for s in sums})
    return join_groups(inner, offsets, [*keys, "_range"]).select(
        *keys, value, *sums, *[(F.col(f"_w_{s}") + F.col(f"_o_{s}")).alias(f"cum_{s}") for s in sums]
    )


def _long(base: DataFrame, keys: Sequence[str], per: Mapping[str, list[float]]) -> DataFrame:
    """(keys, _weight, _q, _v): one row for every value that is not null, ``_q`` its place in ``per``."""
    fields = ", ".join(f"named_struct('_q', {i}, '_v', `{o}`)" for i, o in enumerate(per))
    return base.select(*keys, "_weight", F.expr(f"inline(array({fields}))")).where("_v is not null")


def _ranks(per: Mapping[str, list[float]]) -> list[tuple[int, int, str, str]]:
    """(place of the value, place of the level, end, rank as an expression of ``_n``)."""
    ends = (("lo", "floor"), ("hi", "ceil"))
    return [(i, k, end, f"{f}((_n - 1) * {p!r}D)") for i, ps in enumerate(per.values()) for k, p in enumerate(ps) for end, f in ends]


def _hot_quantiles(
    base: DataFrame, sizes: DataFrame, keys: Sequence[str], per: Mapping[str, list[float]], hot_rows: int
) -> DataFrame:
    """Rank selection in brackets of values: (keys, _q, _n, _from, _to, _v) of the values at the wanted ranks.

    A bracket holds the values from ``_lo`` to ``_hi``, both of which occur; ``_before`` values are smaller. Not
    finite values have bins of their own.
    """
    ends = ", ".join(f"named_struct('_q', {i}, '_n', _n{i}, '_lo', _lo{i}, '_hi', _hi{i})" for i in range(len(per)))
    open_ = lookup(sizes.select(*keys, F.expr(f"inline(array({ends}))")).withColumn("_before", F.lit(0).cast("long")))
    at = [*keys, "_q"]
    # Halves, so that a width is finite where its ends are.
    place = f"((_v / 2 - _lo / 2) / (_hi / 2 - _lo / 2)) * {BINS}"
    bin_ = F.expr(
        f"CASE WHEN isnan(_v) THEN {BINS + 1} WHEN _v = double('Infinity') THEN {BINS} WHEN _v = double('-Infinity') THEN -1 "
        f"WHEN _hi / 2 <= _lo / 2 THEN 0 ELSE cast(least({BINS - 1}D, floor({place})) AS int) END"
    )
    holds = " OR ".join(f"(_q = {i} AND {r} >= _before AND {r} < _before + _m)" for i, _, _, r in _ranks(per))
    before = Window.partitionBy(*at, "_start").orderBy("_bin").rowsBetween(Window.unboundedPreceding, -1)
    rows = join_groups(_long(base, keys, per), open_, at).withColumnRenamed("_before", "_start")
    done = []
    for turn in range(ROUNDS):
        rows = rows.withColumn("_bin", bin_)
        counts = rows.groupBy(*at, "_n", "_start", "_bin").agg(
            F.sum("_weight").alias("_m"), F.count("*").alias("_rows"), F.min("_v").alias("_lo"), F.max("_v").alias("_hi")
        )
        counts = counts.withColumn("_before", F.col("_start") + F.coalesce(F.sum("_m").over(before), F.lit(0)))
        found = pin(counts.where(holds))
        one = found.where("_lo = _hi")
        done.append(one.select(*at, "_n", F.col("_before").alias("_from"), (F.col("_before") + F.col("_m")).alias("_to"), F.col("_lo").alias("_v")))
        wide = found.where("_lo < _hi")
        # Ends that are next to each other leave few distinct values, which need no narrowing.
        largest = wide.where("_hi / 2 > _lo / 2").agg(F.max("_rows")).first()[0]
        if largest is None and wide.isEmpty():
            return _union(done)
        wide = lookup(wide.select(*at, "_start", "_bin", "_before", "_lo", "_hi"))
        kept = join_groups(rows.drop("_lo", "_hi"), wide, [*at, "_start", "_bin"])
        rows = pin(kept.drop("_start", "_bin").withColumnRenamed("_before", "_start"))
        if largest is None or largest <= hot_rows:
            break
    values = rows.groupBy(*at, "_n", "_start", "_v").agg(F.sum("_weight").alias("_c"))
    within = Window.partitionBy(*at, "_start").orderBy("_v").rowsBetween(Window.unboundedPreceding, 0)
    ranked = values.withColumn("_to", F.col("_start") + F.sum("_c").over(within))
    done.append(ranked.select(*at, "_n", (F.col("_to") - F.col("_c")).alias("_from"), "_to", "_v"))
    return _union(done)


def _union(parts: Sequence[DataFrame]) -> DataFrame:
    return reduce(DataFrame.unionByName, parts)


def quantiles(
    df: DataFrame,
    keys: Sequence[str],
    values: Mapping[str, Column],
    probs: Sequence[float] | Mapping[str, Sequence[float]],
    weight: Column | None = None,
    hot_rows: int = HOT_ROWS,
    extra: Mapping[str, Column] | None = None,
    carry: Mapping[str, Column] | None = None,
) -> DataFrame:
    """Exact quantiles with linear interpolation; one array column per entry of ``values``.

    ``weight`` is an integer number of copies per row. Nulls are left out. ``extra`` are
    plain aggregates over the value columns and the ``carry`` columns, taken in the same pass.
    """
    per = {o: [float(p) for p in (probs[o] if isinstance(probs, Mapping) else probs)] for o in values}
    base = df.select(
        *keys,
        *[c.cast("double").alias(o) for o, c in values.items()],
        *[c.alias(n) for n, c in (carry or {}).items()],
        (F.lit(1) if weight is None else weight).cast("long").alias("_weight"),
    )
    hot_rows = min(hot_rows, SORT_ROWS)
    if not pinned(df):
        base = pin(base)
    finite = {o: F.when(F.abs(F.col(o)) < float("inf"), F.col(o)) for o in per}
    sizes = lookup(
        base.groupBy(*keys).agg(
            F.count("*").alias("_rows"),
            *[F.sum(F.when(F.col(o).isNotNull(), F.col("_weight"))).alias(f"_n{i}") for i, o in enumerate(per)],
            *[f(finite[o]).alias(f"{end}{i}") for i, o in enumerate(per) for end, f in (("_lo", F.min), ("_hi", F.max))],
            *[c.alias(n) for n, c in (extra or {}).items()],
        )
    )
    hot = sizes.where(F.col("_rows") > hot_rows)
    if hot.isEmpty():
        ranked = _sorted_ranks(base, sizes, keys, per, weight is not None)
    else:
        hot = lookup(hot)
        small = join_groups(base, hot.select(*keys), keys, "left_anti")
        ranked = _sorted_ranks(small, sizes, keys, per, weight is not None)
        ranked = ranked.unionByName(_hot_quantiles(base, hot, keys, per, hot_rows))
    return join_groups(sizes.select(*keys, *(extra or {})), _interpolated(ranked, keys, per), keys, "left")


def _sorted_ranks(
    base: DataFrame, sizes: DataFrame, keys: Sequence[str], per: Mapping[str, list[float]], weighted: bool
) -> DataFrame:
    """Sort each group once and keep the rows at the wanted ranks.

    Unlike a hash of all values, the sort can spill; the group sizes are known before, so
    rows are dropped while they stream by.
    """
    order = Window.partitionBy(*keys, "_q").orderBy("_v")
    if weighted:
        upto = F.sum("_weight").over(order.rowsBetween(Window.unboundedPreceding, 0))
    else:
        upto = F.row_number().over(order).cast("long")
    counts = sizes.select(*keys, *[f"_n{i}" for i in range(len(per))])
    n = "element_at(array(" + ", ".join(f"_n{i}" for i in range(len(per))) + "), _q + 1)"
    ranked = join_groups(_long(base, keys, per).withColumn("_to", upto), counts, keys).withColumn("_n", F.expr(n))
    hits = [f"(_q = {i} AND _to - _weight <= {r} AND {r} < _to)" for i, _, _, r in _ranks(per)]
    kept = ranked.where(" OR ".join(hits))
    return kept.select(*keys, "_q", "_n", (F.col("_to") - F.col("_weight")).alias("_from"), "_to", "_v")


def _interpolated(ranked: DataFrame, keys: Sequence[str], per: Mapping[str, list[float]]) -> DataFrame:
    """Array columns of the quantiles from the values at the wanted ranks."""
    ends = [F.expr(f"max(CASE WHEN _q = {i} AND _from <= {r} AND {r} < _to THEN _v END)").alias(f"{e}_{i}_{k}") for i, k, e, r in _ranks(per)]
    counts = [F.expr(f"max(CASE WHEN _q = {i} THEN _n END)").alias(f"_n{i}") for i in range(len(per))]
    picked = ranked.groupBy(*keys).agg(*counts, *ends)
    arrays = []
    for i, (o, ps) in enumerate(per.items()):
        h = [f"((_n{i} - 1) * {p!r}D)" for p in ps]
        items = [f"lo_{i}_{k} + ({x} - floor({x})) * (hi_{i}_{k} - lo_{i}_{k})" for k, x in enumerate(h)]
        arrays.append(F.expr(f"CASE WHEN _n{i} > 0 THEN array({', '.join(items)}) END").alias(o))
    return picked.select(*keys, *arrays)
