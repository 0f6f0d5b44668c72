"""Result tables: unions, grids, selection."""

from __future__ import annotations

from pyspark.sql import functions as F

from ..functions.bounded import local_table
from ..operators import results as re
from .registry import query
from .roles import REGIONS, learning_curves, r6, results, with_roles

_P = ["gamma", "alpha"]


@query(
    "r01_union_results",
    with_roles("results")
    + "SELECT run_id, target, CASE WHEN metric = 'mse' THEN 1.0 ELSE alpha END AS alpha, CASE WHEN metric = 'mse' THEN gamma END AS gamma, "
    "CASE WHEN metric <> 'mse' THEN split END AS split FROM results WHERE metric IN ('mse', 'r2')",
)
def _(spark, sf):
    res = results(spark, sf)
    one = res.where("metric = 'mse'").select("run_id", "target", F.lit(1).alias("alpha"), "gamma")
    two = res.where("metric = 'r2'").select("run_id", "target", "alpha", "split")
    return re.union_results([one, two])


@query(
    "r02_source_subsets",
    "WITH s AS (SELECT DISTINCT event_type AS s FROM events UNION SELECT 'other') SELECT array_to_string(list_sort(list(k.s)), ',') AS sources, "
    "count(*)::INTEGER AS size FROM (SELECT a.s AS a, b.s AS b FROM s a JOIN s b ON a.s <= b.s UNION ALL SELECT '', '') p JOIN s k ON k.s <> p.a AND k.s <> p.b GROUP BY p.a, p.b",
)
def _(spark, sf):
    """All, all but one and all but two of six sources: 22 subsets."""
    from .roles import table

    found = table(spark, sf, "events").select("event_type").distinct().collect()
    sets = re.source_subsets(spark, sorted([r[0] for r in found] + ["other"]))
    return sets.select(re.sources_key(F.col("sources")).alias("sources"), F.size("sources").alias("size"))


@query(
    "r03_snap",
    with_roles("results")
    + "SELECT run_id, target, split, metric FROM results WHERE abs(ln(gamma) / ln(2) - round(ln(gamma) / ln(2))) <= 0.01",
)
def _(spark, sf):
    return re.snap(results(spark, sf), "gamma", 2.0).select("run_id", "target", "split", "metric")


@query(
    "r04_alpha_index",
    with_roles("results")
    + "SELECT DISTINCT run_id, CASE WHEN abs(d - 2) < 0.01 THEN 2 WHEN abs(d - 3) < 0.01 THEN 3 WHEN abs(d - 4) < 0.01 THEN 4 END AS alpha_index "
    "FROM (SELECT run_id, log10(alpha) - (SELECT min(log10(alpha)) FROM results) AS d FROM results)",
)
def _(spark, sf):
    runs = results(spark, sf).select("run_id", "alpha").distinct()
    return re.alpha_index(runs).select("run_id", "alpha_index")


@query(
    "r05_filter_eq",
    with_roles("results")
    + "SELECT run_id, target, round(value, 6) AS value FROM results WHERE split = 'test' AND metric = 'mse' AND gamma IN (1, 4) AND alpha <= 0.1",
)
def _(spark, sf):
    conds = {"split": "test", "metric": "mse", "gamma": [1.0, 4.0], "alpha": ("le", 0.1)}
    return re.filter_eq(results(spark, sf), conds).select("run_id", "target", r6("value").alias("value"))


@query(
    "r06_out_of_domain",
    with_roles("results")
    + "SELECT t.eval_target, run_id, target, split, metric FROM results, (SELECT r_name AS eval_target FROM region) t WHERE NOT list_contains(sources, t.eval_target)",
)
def _(spark, sf):
    return re.ood(results(spark, sf), REGIONS).select("eval_target", "run_id", "target", "split", "metric")


@query(
    "r06_in_domain",
    with_roles("reg") + "SELECT dataset AS source, split, round(avg((y - 9) ** 2), 6) AS value FROM reg WHERE dataset = 'ASIA' GROUP BY dataset, split",
)
def _(spark, sf):
    from .roles import reg

    rows = reg(spark, sf).groupBy("dataset", "split").agg(r6(F.avg((F.col("y") - 9) ** 2)).alias("value"))
    single = rows.withColumn("sources", F.array("dataset"))
    return re.in_domain(single, "ASIA").select(F.col("dataset").alias("source"), "split", "value")


_LOEO = (
    ", regions AS (SELECT list_sort(list(r_name)) AS allr FROM region), "
    "cv AS (SELECT t.r_name AS eval_target, gamma, alpha, metric, avg(value) AS cv_value, count(*) AS n_cv FROM results r, region t, regions "
    "WHERE NOT list_contains(sources, t.r_name) AND len(sources) = 3 AND split = 'train_val' AND target <> t.r_name AND NOT list_contains(sources, target) "
    "GROUP BY t.r_name, gamma, alpha, metric), "
    "mod AS (SELECT target AS eval_target, gamma, alpha, metric, run_id, value AS test_value, sources FROM results WHERE len(sources) = 4 AND NOT list_contains(sources, target) AND split = 'test'), "
    "loeo AS (SELECT * FROM cv FULL JOIN mod USING (eval_target, gamma, alpha, metric)) "
)


def _loeo(spark, sf, metrics=None):
    return re.loeo_cv(results(spark, sf), _P, metrics)


@query(
    "r07_loeo_cv",
    with_roles("results") + _LOEO
    + "SELECT eval_target, gamma, alpha, metric, n_cv, run_id, round(cv_value, 6) + 0.0 AS cv_value, round(test_value, 6) + 0.0 AS test_value FROM loeo",
)
def _(spark, sf):
    out = _loeo(spark, sf)
    return out.select("eval_target", *_P, "metric", "n_cv", "run_id", r6("cv_value").alias("cv_value"), r6("test_value").alias("test_value"))


def _best_sql(keys: str, order: str, where: str) -> str:
    return (
        f"SELECT eval_target, gamma, alpha, metric, run_id, round(cv_value, 6) + 0.0 AS cv_value, round(test_value, 6) + 0.0 AS test_value FROM "
        f"(SELECT *, row_number() OVER (PARTITION BY {keys} ORDER BY {order}, gamma, alpha) AS i FROM loeo WHERE {where}) WHERE i = 1"
    )


_SIGNED = "round(CASE WHEN metric = 'r2' THEN -cv_value ELSE cv_value END, 9)"


def _show(df):
    return df.select("eval_target", *_P, "metric", "run_id", r6("cv_value").alias("cv_value"), r6("test_value").alias("test_value"))


@query(
    "r08_best_by",
    with_roles("results") + _LOEO + _best_sql("eval_target, metric", _SIGNED, "metric IN ('mse', 'r2')"),
)
def _(spark, sf):
    cv = _loeo(spark, sf, ["mse", "r2"]).withColumn("cv_value", F.round("cv_value", 9))
    return _show(re.best_by(cv, ["eval_target", "metric"], "cv_value", re.greater_is_better(), _P))


@query(
    "r09_best_per_gamma",
    with_roles("results") + _LOEO + _best_sql("eval_target, gamma", "round(cv_value, 9)", "metric = 'rmse'"),
)
def _(spark, sf):
    cv = _loeo(spark, sf, ["rmse"]).withColumn("cv_value", F.round("cv_value", 9))
    return _show(re.best_by(cv, ["eval_target", "gamma"], "cv_value", False, _P).orderBy("eval_target", "gamma"))


@query(
    "r10_top_k",
    with_roles("results") + _LOEO
    + "SELECT eval_target, gamma, alpha, round(cv_value, 6) AS cv_value FROM loeo WHERE metric = 'r2' ORDER BY round(cv_value, 9) DESC, eval_target, gamma, alpha LIMIT 3",
)
def _(spark, sf):
    cv = _loeo(spark, sf, ["r2"]).withColumn("cv_value", F.round("cv_value", 9))
    return re.top_k(cv, 3, "cv_value", True, ["eval_target", *_P]).select("eval_target", *_P, r6("cv_value").alias("cv_value"))


@query(
    "r11_signed_cv",
    with_roles("curves")
    + "SELECT experiment, target, seed, n_target, metric, round(CASE WHEN metric = 'r2' THEN cv_value ELSE -cv_value END, 6) + 0.0 AS cv_value FROM curves",
)
def _(spark, sf):
    out = re.signed_cv(learning_curves(spark, sf))
    return out.select("experiment", "target", "seed", "n_target", "metric", r6("cv_value").alias("cv_value"))


_KEYS = ["experiment", "target", "seed", "n_target"]


@query(
    "r12_pivot_metrics",
    with_roles("curves")
    + "SELECT experiment, target, seed, n_target, "
    + ", ".join(f"round(max({v}) FILTER (WHERE metric = '{m}'), 6) + 0.0 AS \"{v}/{m}\"" for m in ("mse", "r2") for v in ("cv_value", "test_value"))
    + " FROM curves GROUP BY experiment, target, seed, n_target",
)
def _(spark, sf):
    wide = re.pivot_metrics(learning_curves(spark, sf), _KEYS, ["mse", "r2"])
    return wide.select(*_KEYS, *[r6(F.col(f"`{c}`")).alias(c) for c in wide.columns if c not in _KEYS])


@query(
    "r13_select_curves",
    with_roles("curves")
    + ", w AS (SELECT experiment, target, seed, n_target, "
    + ", ".join(
        f"round(max(CASE WHEN metric = '{m}' THEN {sign}cv_value END), 9) AS c_{m}, max(test_value) FILTER (WHERE metric = '{m}') AS t_{m}" for m, sign in (("mse", "-"), ("r2", ""))
    )
    + " FROM curves GROUP BY experiment, target, seed, n_target), "
    "l AS (SELECT *, unnest(['mse', 'r2']) AS cv_metric, unnest([c_mse, c_r2]) AS score FROM w) "
    "SELECT target, seed, n_target, cv_metric, experiment, round(t_mse, 6) AS test_mse, round(t_r2, 6) + 0.0 AS test_r2 FROM "
    "(SELECT *, row_number() OVER (PARTITION BY target, seed, n_target, cv_metric ORDER BY score DESC, experiment) AS i FROM l) WHERE i = 1",
)
def _(spark, sf):
    signed = re.signed_cv(learning_curves(spark, sf)).withColumn("cv_value", F.round("cv_value", 9))
    wide = re.pivot_metrics(signed, _KEYS, ["mse", "r2"])
    best = re.select_curves(wide, ["target", "seed", "n_target"], ["mse", "r2"], ["experiment"])
    return best.select(
        "target", "seed", "n_target", "cv_metric", "experiment", r6(F.col("`test_value/mse`")).alias("test_mse"), r6(F.col("`test_value/r2`")).alias("test_r2")
    )


@query(
    "r14_completeness",
    with_roles("curves")
    + "SELECT bool_and(n = 5) AS complete, count(*) AS n_groups FROM (SELECT count(*) AS n FROM curves GROUP BY experiment, target, n_target, metric)",
)
def _(spark, sf):
    return re.completeness(learning_curves(spark, sf), ["experiment", "target", "n_target", "metric"], 5)


@query(
    "r15_model_selection_table",
    with_roles("results") + _LOEO
    + ", m AS (SELECT *, median(cv_value) OVER w AS c, median(test_value) OVER w AS t FROM loeo WHERE metric = 'mse' WINDOW w AS (PARTITION BY eval_target)) "
    "SELECT eval_target, gamma, alpha, round(cv_value, 6) AS cv_value, round(test_value, 6) AS test_value FROM m WHERE cv_value <= c AND test_value <= t",
)
def _(spark, sf):
    out = re.model_selection_table(results(spark, sf), _P, "mse")
    return out.select("eval_target", *_P, r6("cv_value").alias("cv_value"), r6("test_value").alias("test_value"))


@query(
    "r16_mean_horizontal",
    with_roles("reg_null")
    + "SELECT stay_id, l_linenumber, l_partkey, l_suppkey, round(CASE WHEN x_disc IS NULL AND x_tax IS NULL THEN NULL ELSE (coalesce(x_disc, 0) + coalesce(x_tax, 0)) "
    "/ (CAST(x_disc IS NOT NULL AS INTEGER) + CAST(x_tax IS NOT NULL AS INTEGER)) END, 6) AS m FROM reg_null",
)
def _(spark, sf):
    from .roles import ROW_ID, reg_null

    return re.mean_columns(reg_null(spark, sf), ["x_disc", "x_tax"], "m").select(*ROW_ID, r6("m").alias("m"))


@query(
    "r17_own_target_value",
    with_roles("results")
    + "SELECT run_id, target, round(value, 6) AS own FROM results WHERE split = 'test' AND metric = 'mse'",
)
def _(spark, sf):
    from ..operators.metrics import to_wide

    names = [f"{t}/test/mse" for t in REGIONS]
    wide = to_wide(results(spark, sf), ["run_id"], names)
    rows = wide.withColumn("target", F.explode(F.array(*[F.lit(t) for t in REGIONS])))
    return re.own_target_value(rows, REGIONS, "mse", "own").select("run_id", "target", r6("own").alias("own"))


@query(
    "r18_curves",
    with_roles("results")
    + "SELECT k, alpha, array_to_string(list(printf('%.1f:%.4f', gamma, value) ORDER BY gamma), ' ') AS points FROM (SELECT split_part(run_id, '|', 1) AS k, alpha, gamma, "
    "round(value, 4) AS value FROM results WHERE target = 'ASIA' AND split = 'test' AND metric = 'rmse') GROUP BY k, alpha",
)
def _(spark, sf):
    res = results(spark, sf).where("target = 'ASIA' and split = 'test' and metric = 'rmse'")
    res = res.withColumn("k", F.split("run_id", r"\|")[0])
    out = re.curves(res, "gamma", "value", ["k", "alpha"])
    text = F.transform("points", lambda p: F.format_string("%.1f:%.4f", p["gamma"], F.round(p["value"], 4)))
    return out.select("k", "alpha", F.array_join(text, " ").alias("points"))


@query(
    "r19_match_sources",
    with_roles("results")
    + "SELECT DISTINCT t.r_name AS target, run_id FROM results, region t WHERE len(sources) = 4 AND NOT list_contains(sources, t.r_name)",
)
def _(spark, sf):
    runs = results(spark, sf).select("run_id", "sources").distinct()
    wanted = [{"target": t, "wanted": [r for r in reversed(REGIONS) if r != t]} for t in REGIONS]
    table = local_table(spark, wanted, "target string, wanted array<string>")
    return re.match_sources(runs, table).select("target", "run_id")
