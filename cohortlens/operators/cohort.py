"""Cohort construction: stay windows, hourly grid, exclusions, attrition.

Tables are keyed by ``(dataset, stay_id)`` unless other keys are given; time is whole
hours since admission. Observations are reduced to at most one row per stay and hour
before any per-stay window runs, so a window group never exceeds the stay's hours.
"""

from __future__ import annotations

from collections.abc import Callable, Mapping, Sequence
from dataclasses import dataclass
from functools import reduce

from pyspark import StorageLevel
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

STAY = ("dataset", "stay_id")
TIME = "time_h"

# Cohort rules (days, hours, rows, hours).
MAX_STAY_DAYS = 14
MIN_STAY_HOURS = 4
MIN_MEASUREMENTS = 4
MAX_GAP_HOURS = 48


def concepts_wide(
    obs: DataFrame,
    concepts: Sequence[str],
    keys: Sequence[str] = STAY,
    agg: Callable[[str], Column] = F.avg,
) -> DataFrame:
    """One column per concept, merged on (stay, hour): one pivot instead of N outer joins.

    Only the listed concepts make rows.
    """
    listed = obs.where(F.col("concept").isin(list(concepts)))
    return listed.groupBy(*keys, TIME).pivot("concept", list(concepts)).agg(agg("value"))


def change_id(df: DataFrame, id_map: DataFrame, old: str, new: str) -> DataFrame:
    """Replace the id column ``old`` by ``new`` as given in ``id_map``."""
    rest = [c for c in df.columns if c != old]
    return df.join(id_map.select(old, new), old).select(new, *rest)


def to_interval(df: DataFrame, ts: str, origin: str, out: str = TIME, hours: int = 1) -> DataFrame:
    """Whole ``hours``-intervals between ``origin`` and ``ts`` (floor, negative before origin)."""
    micros = F.expr(f"timestampdiff(MICROSECOND, `{origin}`, `{ts}`)")
    return df.withColumn(out, F.floor(micros / F.lit(3_600_000_000 * hours)).cast("long"))


def stay_windows(obs: DataFrame, keys: Sequence[str] = STAY) -> DataFrame:
    """One (id, start, end) interval per stay, start moved to 0."""
    return obs.groupBy(*keys).agg(
        F.lit(0).cast("long").alias("start_h"), F.max(TIME).cast("long").alias("end_h")
    )


def stop_obs_at(
    stays: DataFrame, max_hours: int = MAX_STAY_DAYS * 24, keys: Sequence[str] = STAY
) -> DataFrame:
    """Cut every stay at its first start plus ``max_hours``."""
    first = F.min("start_h").over(Window.partitionBy(*keys))
    return stays.withColumn("end_h", F.least("end_h", first + F.lit(max_hours)).cast("long"))


def expand_grid(stays: DataFrame, keys: Sequence[str] = STAY) -> DataFrame:
    """Every hour from start to end, both included."""
    hours = F.explode(F.sequence("start_h", "end_h")).alias(TIME)
    return stays.where("end_h >= start_h").select(*keys, hours)


def map_to_grid(stays: DataFrame, x: DataFrame, keys: Sequence[str] = STAY) -> DataFrame:
    """Left join onto the grid; observations off the grid drop out."""
    return expand_grid(stays, keys).join(x, [*keys, TIME], "left")


def filter_step(df: DataFrame, cond: Callable[[Column], Column], col: str) -> DataFrame:
    """Rows whose data column satisfies the predicate."""
    return df.where(cond(F.col(col)))


def filter_in_windows(ts: DataFrame, win: DataFrame, keys: Sequence[str] = STAY) -> DataFrame:
    """Rows inside any interval of the same id, both ends included.

    Time is whole hours, so the intervals become the set of hours they cover: at most one row
    per id and hour, however many intervals overlap. The range condition turns into an equi
    semi join on (id, hour), which neither compares pairs nor piles a busy id onto one task.
    """
    longest = win.groupBy(*keys, "start_h").agg(F.max("end_h").alias("end_h"))
    hours = F.explode(F.sequence("start_h", "end_h")).alias(TIME)
    covered = longest.where("end_h >= start_h").select(*keys, hours).distinct()
    return ts.join(covered, [*keys, TIME], "left_semi")


def mutate_step(
    df: DataFrame,
    f: Callable[[Column], Column],
    cols: Sequence[str],
    by: Sequence[str] | None = None,
) -> DataFrame:
    """Apply ``f`` to every data column; with ``by``, ``f`` is an aggregate over the group."""
    if by is None:
        return df.withColumns({c: f(F.col(c)) for c in cols})
    w = Window.partitionBy(*by)
    return df.withColumns({c: f(F.col(c)).over(w) for c in cols})


def summary_step(
    df: DataFrame, aggs: Mapping[str, Column], keys: Sequence[str] = STAY
) -> DataFrame:
    """One row per id with the given aggregates."""
    return df.groupBy(*keys).agg(*[c.alias(name) for name, c in aggs.items()])


def summary_exists(df: DataFrame, out: str = "exists", keys: Sequence[str] = STAY) -> DataFrame:
    return df.groupBy(*keys).agg(F.lit(True).alias(out))


def summary_count(df: DataFrame, keys: Sequence[str] = STAY) -> DataFrame:
    """Rows per id (not non-null cells)."""
    return df.groupBy(*keys).agg(F.count("*").alias("n"))


def summary_any(df: DataFrame, cols: Sequence[str], keys: Sequence[str] = STAY) -> DataFrame:
    """Logical OR per id and boolean column; nulls are ignored."""
    wrong = [c for c in cols if dict(df.dtypes)[c] != "boolean"]
    if wrong:
        raise TypeError(f"not boolean: {wrong}")
    return df.groupBy(*keys).agg(*[F.bool_or(c).alias(c) for c in cols])


def _edge(df: DataFrame, pick, keys: Sequence[str], order: Sequence[str]) -> DataFrame:
    data = [c for c in df.columns if c not in keys]
    row = pick(F.struct(*data), F.struct(*order)).alias("_row")
    return df.groupBy(*keys).agg(row).select(*keys, *[F.col(f"_row.{c}").alias(c) for c in data])


def summary_first(
    df: DataFrame, keys: Sequence[str] = STAY, order: Sequence[str] = (TIME,)
) -> DataFrame:
    """First row per id; ``order`` may list tie-breaks after the time."""
    return _edge(df, F.min_by, keys, order)


def summary_last(
    df: DataFrame, keys: Sequence[str] = STAY, order: Sequence[str] = (TIME,)
) -> DataFrame:
    """Last row per id."""
    return _edge(df, F.max_by, keys, order)


def n_obs_per_row(df: DataFrame, cols: Sequence[str], out: str = "n") -> DataFrame:
    """Number of non-null data columns per row."""
    n = reduce(lambda a, b: a + b, [F.col(c).isNotNull().cast("int") for c in cols])
    return df.withColumn(out, n)


def longest_run(
    df: DataFrame, value: str, val, keys: Sequence[str] = STAY, out: str = "lengths"
) -> DataFrame:
    """Longest run of consecutive rows with ``value == val`` per id, 0 without any."""
    by_time = Window.partitionBy(*keys).orderBy(TIME)
    hit = F.col(value).eqNullSafe(F.lit(val))
    # Rows of one run share the number of non-hits seen so far.
    breaks = F.sum(F.when(hit, 0).otherwise(1)).over(by_time)
    runs = (
        df.select(*keys, hit.alias("_hit"), breaks.alias("_run"))
        .groupBy(*keys, "_run")
        .agg(F.sum(F.col("_hit").cast("long")).alias("_len"))
    )
    return runs.groupBy(*keys).agg(F.max("_len").alias(out))


@dataclass(frozen=True)
class Rules:
    """Thresholds of the four exclusion rules."""

    min_stay_hours: float = MIN_STAY_HOURS
    min_rows: int = MIN_MEASUREMENTS
    max_gap_hours: int = MAX_GAP_HOURS


def longest_gap(
    stays: DataFrame, seen: DataFrame, keys: Sequence[str] = STAY, out: str = "gap_h"
) -> DataFrame:
    """Stays with their longest run of hours without a row in ``seen``.

    Equals ``longest_run`` of empty hours on the grid, but works on the observed hours only:
    the grid is never built. Hours outside the stay do not count.
    """
    t, start, end = F.col("_t"), F.col("start_h"), F.col("end_h")
    hours = seen.select(*keys, F.col(TIME).alias("_t"))
    rows = stays.select(*keys, "start_h", "end_h").join(hours, list(keys), "left")
    rows = rows.withColumn("_t", F.when(t.between(start, end), t))
    before = F.lag("_t").over(Window.partitionBy(*keys).orderBy("_t"))
    rows = rows.withColumn("_gap", t - F.coalesce(before, start - 1) - 1)
    last = F.coalesce(F.max("_t"), F.max("start_h") - 1)
    gaps = rows.groupBy(*keys).agg(F.greatest(F.max("_gap"), F.max("end_h") - last).alias(out))
    return stays.join(gaps, list(keys), "left")


def flag_exclusions(
    stays: DataFrame,
    wide: DataFrame,
    concepts: Sequence[str],
    rules: Rules = Rules(),
    keys: Sequence[str] = STAY,
) -> DataFrame:
    """Stays with ``n_rows``, ``gap_h`` and one boolean per rule: ``rule_1`` ... ``rule_4``.

    Rules: negative length, short stay, few rows, long gap. ``stays`` needs ``start_h`` and
    ``end_h`` and may bring ``los_h`` (length before truncation); ``wide`` is one row per
    stay and hour, as ``concepts_wide`` gives it.
    """
    los = F.col("los_h") if "los_h" in stays.columns else F.col("end_h")
    any_value = reduce(lambda a, b: a | b, [F.col(c).isNotNull() for c in concepts])
    marked = longest_gap(stays, wide.where(any_value), keys)
    marked = marked.join(summary_count(wide, keys).withColumnRenamed("n", "n_rows"), list(keys), "left")
    n = F.col("n_rows")
    return marked.withColumns(
        {
            "n_rows": F.coalesce(n, F.lit(0)),
            "rule_1": F.col("end_h") < 0,
            "rule_2": los < rules.min_stay_hours,
            # A stay without any row is not listed here; it has no dynamic data at all.
            "rule_3": F.coalesce(n < rules.min_rows, F.lit(False)),
            "rule_4": F.coalesce(F.col("gap_h") > rules.max_gap_hours, F.lit(False)),
        }
    )


def exclusions(
    stays: DataFrame,
    wide: DataFrame,
    concepts: Sequence[str],
    rules: Rules = Rules(),
    keys: Sequence[str] = STAY,
) -> list[DataFrame]:
    """Ids hit by each of the four rules, one table per rule.

    The tables share one set of flags per stay, which is kept for them.
    """
    marked = flag_exclusions(stays, wide, concepts, rules, keys).persist(StorageLevel.MEMORY_AND_DISK)
    return [marked.where(f"rule_{i}").select(*keys).distinct() for i in range(1, 5)]


def attrition(marked: DataFrame, n_rules: int = 4) -> DataFrame:
    """Per step: stays left, stays hit by the rule, stays it removed. One aggregate."""
    steps = range(1, n_rules + 1)
    first = F.coalesce(*[F.when(F.col(f"rule_{i}"), F.lit(i)) for i in steps], F.lit(n_rules + 1))
    counts = marked.withColumn("_first", first).agg(
        *[F.count(F.when(F.col("_first") > i, 1)).alias(f"in_{i}") for i in steps],
        *[F.count(F.when(F.col("_first") == i, 1)).alias(f"out_{i}") for i in steps],
        *[F.count(F.when(F.col(f"rule_{i}"), 1)).alias(f"hit_{i}") for i in steps],
    )
    rows = [
        F.struct(
            F.lit(i).alias("step"),
            F.col(f"in_{i}").alias("incl_n"),
            F.col(f"hit_{i}").alias("excl_n_total"),
            F.col(f"out_{i}").alias("excl_n"),
        )
        for i in steps
    ]
    return counts.select(F.inline(F.array(*rows)))


def exclude(
    stays: DataFrame, lists: Sequence[DataFrame], keys: Sequence[str] = STAY
) -> tuple[DataFrame, DataFrame]:
    """Remove the listed ids in order; return (kept stays, attrition table).

    The lists are tagged with their position and reduced to one set of flags per id, so a
    single join replaces the chain of anti-joins. Listed ids that are no stays count in
    ``excl_n_total`` only.
    """
    steps = range(1, len(lists) + 1)
    tagged = [d.select(*keys).distinct().withColumn("_step", F.lit(i)) for i, d in enumerate(lists, 1)]
    hits = reduce(lambda a, b: a.unionByName(b), tagged)
    flags = hits.groupBy(*keys).agg(
        *[F.bool_or(F.col("_step") == i).alias(f"rule_{i}") for i in steps], F.lit(True).alias("_listed")
    )
    marked = stays.withColumn("_stay", F.lit(True)).join(flags, list(keys), "full")
    rules = [f"rule_{i}" for i in steps]
    marked = marked.withColumns({r: F.coalesce(r, F.lit(False)) for r in rules})
    is_stay = F.col("_stay").isNotNull()
    kept = marked.where(is_stay & F.col("_listed").isNull()).select(*stays.columns)
    report = attrition(marked.where(is_stay), len(lists))
    totals = hits.groupBy(F.col("_step").alias("step")).agg(F.count("*").alias("_total"))
    report = report.drop("excl_n_total").join(totals, "step", "left")
    total = F.coalesce("_total", F.lit(0)).alias("excl_n_total")
    return kept, report.select("step", "incl_n", total, "excl_n")


def require_dynamic(
    stays: DataFrame, dyn: DataFrame, keys: Sequence[str] = STAY
) -> tuple[DataFrame, DataFrame]:
    """Stays with at least one dynamic row, and a one-row table with the number removed."""
    kept = stays.join(dyn.select(*keys).distinct(), list(keys), "left_semi")
    removed = stays.join(dyn.select(*keys).distinct(), list(keys), "left_anti")
    return kept, removed.agg(F.count("*").alias("removed"))


def static_for(
    stays: DataFrame,
    sta: DataFrame,
    rename: Mapping[str, str] | None = None,
    keys: Sequence[str] = STAY,
) -> DataFrame:
    """Static rows of the cohort with renamed key columns."""
    out = sta.join(stays.select(*keys).distinct(), list(keys), "left_semi")
    return out.withColumnsRenamed(dict(rename or {}))
