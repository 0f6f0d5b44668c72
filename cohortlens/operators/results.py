"""Result tables: unions, grids, leave-one-environment-out selection, best rows.

Results are long: ``run_id, sources, params..., target, split, metric, value``.
"""

from __future__ import annotations

import math
from collections.abc import Mapping, Sequence
from functools import reduce
from itertools import combinations_with_replacement

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from ..functions.bounded import bounded_rows, local_table, lookup
from ..functions.columns import mean_horizontal
from .metrics import GREATER_IS_BETTER
from .order_stats import HOT_ROWS, quantiles

MAX_SUBSETS = 50_000


def union_results(dfs: Sequence[DataFrame]) -> DataFrame:
    """Diagonal union: missing columns become null, int meeting double becomes double."""
    types: dict[str, set[str]] = {}
    for d in dfs:
        for c, t in d.dtypes:
            types.setdefault(c, set()).add(t)
    wide = {c for c, t in types.items() if len(t) > 1 and t <= {"int", "bigint", "float", "double"}}
    cast = [d.withColumns({c: F.col(c).cast("double") for c in d.columns if c in wide}) for d in dfs]
    return reduce(lambda a, b: a.unionByName(b, allowMissingColumns=True), cast)


def source_subsets(spark: SparkSession, sources: Sequence[str]) -> DataFrame:
    """All sources, all but one, all but two: one row per subset."""
    sets = {
        tuple(s for s in sources if s not in left_out)
        for left_out in combinations_with_replacement(sorted(sources), 2)
    } | {tuple(sources)}
    rows = [{"sources": list(s)} for s in sorted(sets, key=lambda s: (-len(s), s))]
    return local_table(spark, rows, "sources array<string>")


def sources_key(sources: Column) -> Column:
    """Order-free name of a source set."""
    return F.array_join(F.array_sort(sources), ",")


def snap(df: DataFrame, col: str, base: float, tol: float = 0.01) -> DataFrame:
    """Rows whose ``col`` is a power of ``base`` within ``tol`` on the log scale."""
    e = F.log(col) / F.lit(math.log(base))
    return df.where(F.abs(e - F.round(e)) <= tol)


def alpha_index(df: DataFrame, col: str = "alpha", out: str = "alpha_index") -> DataFrame:
    """Decades above the smallest alpha where that is 2, 3 or 4, else null."""
    lowest = df.agg(F.min(F.log10(col))).first()[0]
    d = F.log10(col) - F.lit(lowest)
    picks = [F.when(F.abs(d - k) < 0.01, F.lit(k)) for k in (2, 3, 4)]
    return df.withColumn(out, F.coalesce(*picks))


def filter_eq(df: DataFrame, conds: Mapping[str, object]) -> DataFrame:
    """Equality per column; a list means membership, a (op, value) pair a comparison."""
    ops = {
        "le": lambda c, v: c <= v,
        "ge": lambda c, v: c >= v,
        "lt": lambda c, v: c < v,
        "gt": lambda c, v: c > v,
    }
    for c, v in conds.items():
        if isinstance(v, tuple):
            df = df.where(ops[v[0]](F.col(c), F.lit(v[1])))
        elif isinstance(v, (list, set)):
            df = df.where(F.col(c).isin(list(v)))
        else:
            df = df.where(F.col(c) == F.lit(v))
    return df


def ood(results: DataFrame, targets: Sequence[str], out: str = "eval_target") -> DataFrame:
    """Results of runs not trained on the target, for every target at once."""
    out_of = F.filter(F.array(*[F.lit(t) for t in targets]), lambda t: ~F.array_contains(F.col("sources"), t))
    return results.withColumn(out, F.explode(out_of))


def in_domain(results: DataFrame, target: str) -> DataFrame:
    """Single-source runs trained on the target itself."""
    return results.where((F.size("sources") == 1) & F.array_contains("sources", target))


def _roles(results: DataFrame) -> tuple[list[str], DataFrame]:
    """Which source set serves which evaluation target, and as what.

    A target's runs are those not trained on it. With m sources left among them, sets of
    size m - 1 give cross-validation values on their one left-out source and sets of size
    m are the models. Sets and targets are metadata and handled on the driver.
    """
    seen = bounded_rows(
        results.select("sources", "target", "split").distinct(), MAX_SUBSETS, "source sets and targets"
    )
    subsets = {frozenset(r["sources"]) for r in seen}
    targets = sorted({r["target"] for r in seen})
    scored = {r["target"] for r in seen if r["split"] == "train_val"}
    rows = []
    for t in targets:
        out = {s for s in subsets if t not in s}
        left = {x for s in out for x in s} & scored
        m = len(left)
        cv = {s for s in out if len(s) == m - 1 and len(left - s) == 1}
        for s in out:
            row = {"sources_key": ",".join(sorted(s)), "eval_target": t, "left_out": None, "no_cv": not cv}
            if s in cv:
                rows.append({**row, "role": "cv", "left_out": next(iter(left - s))})
            elif not cv or len(s) == m:
                rows.append({**row, "role": "model"})
    schema = "sources_key string, eval_target string, left_out string, no_cv boolean, role string"
    return targets, local_table(results.sparkSession, rows, schema)


def loeo_cv(results: DataFrame, params: Sequence[str], metrics: Sequence[str] | None = None) -> DataFrame:
    """Leave-one-environment-out CV value next to each model's test value.

    Columns: eval_target, params, metric, cv_value, n_cv (left-out sources seen), run_id,
    sources, test_value. A parameter set seen on fewer sources than expected keeps its row;
    ``n_cv`` tells. Targets without any CV set get 0 as CV value.
    """
    if metrics is not None:
        results = results.where(F.col("metric").isin(list(metrics)))
    _, roles = _roles(results)
    keyed = results.withColumn("sources_key", sources_key(F.col("sources")))
    cv_roles = roles.where("role = 'cv'").select(
        "sources_key", "eval_target", F.col("left_out").alias("target")
    )
    cv = (
        keyed.where("split = 'train_val'")
        .join(F.broadcast(cv_roles), ["sources_key", "target"])
        .groupBy("eval_target", *params, "metric")
        .agg(F.avg("value").alias("cv_value"), F.count("*").alias("n_cv"))
    )
    model_roles = roles.where("role = 'model'").select(
        "sources_key", F.col("eval_target").alias("target"), "no_cv"
    )
    models = (
        keyed.where("split = 'test'")
        .join(F.broadcast(model_roles), ["sources_key", "target"])
        .select(
            F.col("target").alias("eval_target"),
            *params,
            "metric",
            "run_id",
            "sources",
            F.col("value").alias("test_value"),
            "no_cv",
        )
    )
    joined = cv.join(models, ["eval_target", *params, "metric"], "full")
    value = F.when(F.coalesce("no_cv", F.lit(False)), F.lit(0.0)).otherwise(F.col("cv_value"))
    return joined.withColumn("cv_value", value).drop("no_cv")


def _rank_struct(value: str, maximize: bool | Column, ties: Sequence[str]) -> Column:
    v = F.col(value)
    if isinstance(maximize, Column):
        v = F.when(maximize, -v).otherwise(v)
    elif maximize:
        v = -v
    missing = F.col(value).isNull() | F.isnan(F.col(value).cast("double"))
    return F.struct(missing.alias("_missing"), v.alias("_value"), *ties)


def best_by(
    df: DataFrame,
    keys: Sequence[str],
    value: str,
    maximize: bool | Column,
    ties: Sequence[str] = (),
) -> DataFrame:
    """The whole row with the best value per group; missing values lose, ties break on ``ties``."""
    row = F.min_by(F.struct(*df.columns), _rank_struct(value, maximize, ties)).alias("_row")
    return df.groupBy(*keys).agg(row).select(*[F.col(f"_row.`{c}`").alias(c) for c in df.columns])


def greater_is_better(metric: str | Column = "metric") -> Column:
    c = F.col(metric) if isinstance(metric, str) else metric
    return c.isin(list(GREATER_IS_BETTER))


def top_k(df: DataFrame, k: int, value: str, maximize: bool = True, ties: Sequence[str] = ()) -> DataFrame:
    """The ``k`` best rows overall."""
    order = F.col(value).desc_nulls_last() if maximize else F.col(value).asc_nulls_last()
    return df.orderBy(order, *ties).limit(k)


def signed_cv(df: DataFrame, value: str = "cv_value", metric: str = "metric") -> DataFrame:
    """Make larger mean better: flip the sign of losses."""
    v = F.col(value)
    return df.withColumn(value, F.when(greater_is_better(metric), v).otherwise(-v))


def pivot_metrics(df: DataFrame, rest: Sequence[str], metrics: Sequence[str]) -> DataFrame:
    """Metric rows to ``cv_value/{m}`` and ``test_value/{m}`` columns."""
    wide = df.groupBy(*rest).pivot("metric", list(metrics)).agg(
        F.first("cv_value").alias("cv_value"), F.first("test_value").alias("test_value")
    )
    names = {f"{m}_{v}": f"{v}/{m}" for m in metrics for v in ("cv_value", "test_value")}
    return wide.withColumnsRenamed(names)


def select_curves(
    wide: DataFrame, keys: Sequence[str], metrics: Sequence[str], ties: Sequence[str] = ()
) -> DataFrame:
    """Best row per group for every CV metric at once (signed values: larger is better)."""
    choice = F.array(
        *[
            F.struct(F.lit(m).alias("cv_metric"), F.col(f"`cv_value/{m}`").alias("_score"))
            for m in metrics
        ]
    )
    long = wide.select("*", F.inline(choice))
    return best_by(long, [*keys, "cv_metric"], "_score", True, ties).drop("_score")


def completeness(df: DataFrame, keys: Sequence[str], n: int = 20) -> DataFrame:
    """One row: whether every group has exactly ``n`` rows, and how many groups there are."""
    sizes = df.groupBy(*keys).agg(F.count("*").alias("_n"))
    return sizes.agg(
        F.bool_and(F.col("_n") == n).alias("complete"), F.count("*").alias("n_groups")
    )


def assert_complete(df: DataFrame, keys: Sequence[str], n: int = 20) -> DataFrame:
    """Pass the table through, or fail when a group does not have ``n`` rows."""
    if not completeness(df, keys, n).first()["complete"]:
        raise ValueError(f"not every group of {list(keys)} has {n} rows")
    return df


def model_selection_table(
    results: DataFrame, params: Sequence[str], metric: str, hot_rows: int = HOT_ROWS
) -> DataFrame:
    """CV value against test value per target; rows not above the median in both.

    Losses are compared as they are; for metrics where greater is better the CV value is
    negated first.
    """
    cv = loeo_cv(results, params, [metric]).where("run_id is not null")
    if cv.groupBy("eval_target", *params).count().where("count > 1").limit(1).count():
        raise ValueError("parameters do not identify a model")
    sign = -1.0 if metric in GREATER_IS_BETTER else 1.0
    cv = cv.withColumn("cv_value", F.col("cv_value") * F.lit(sign))
    mid = quantiles(
        cv, ["eval_target"], {"_c": F.col("cv_value"), "_t": F.col("test_value")}, [0.5], hot_rows=hot_rows
    )
    kept = cv.join(lookup(mid), "eval_target")
    kept = kept.where((F.col("cv_value") <= F.col("_c")[0]) & (F.col("test_value") <= F.col("_t")[0]))
    return kept.drop("_c", "_t")


def mean_columns(df: DataFrame, cols: Sequence[str], out: str) -> DataFrame:
    """Row-wise mean of the non-null columns."""
    return df.withColumn(out, mean_horizontal([F.col(f"`{c}`") for c in cols]))


def own_target_value(df: DataFrame, targets: Sequence[str], metric: str, out: str) -> DataFrame:
    """From wide rows, the value of the row's own target."""
    picks = [F.when(F.col("target") == t, F.col(f"`{t}/test/{metric}`")) for t in targets]
    return df.withColumn(out, F.coalesce(*picks))


def curves(df: DataFrame, x: str, y: str, others: Sequence[str], max_points: int = 1_000) -> DataFrame:
    """One curve per combination of the other parameters, points sorted by ``x``.

    A curve has one point per grid value of ``x``; repeated rows are averaged before the
    points are gathered, and more points than a grid can have are refused.
    """
    points = df.groupBy(*others, x).agg(F.avg(y).alias(y))
    arr = F.sort_array(F.collect_list(F.struct(x, y)))
    checked = F.when(F.count("*") <= max_points, arr).otherwise(
        F.raise_error(F.lit(f"a curve over {x} has more than {max_points} points"))
    )
    return points.groupBy(*others).agg(checked.alias("points"))


def match_sources(runs: DataFrame, wanted: DataFrame) -> DataFrame:
    """Runs whose source set equals the wanted one, whatever its order."""
    left = runs.withColumn("_k", sources_key(F.col("sources")))
    right = wanted.withColumn("_k", sources_key(F.col("wanted")))
    return left.join(right, "_k").drop("_k")
