"""Summary tables and distributions."""

from __future__ import annotations

from pyspark.sql import functions as F

from ..operators import summaries as su
from ..session import pin
from .q_features import icd
from .q_sources import written_dictionary
from .registry import query
from .roles import REGIONS, binary, grid, r6, reg, reg_null, results, with_roles

_HOLES = ", h AS (SELECT * REPLACE (CASE WHEN year % 3 <> 0 THEN year END AS year, nullif(adm, '5-LOW') AS adm) FROM reg) "


def _anchors(spark, sf):
    return reg(spark, sf).withColumns(
        {"year": F.when(F.col("year") % 3 != 0, F.col("year")), "adm": F.nullif(F.col("adm"), F.lit("5-LOW"))}
    )


@query(
    "t01_anchor_table",
    with_roles("reg") + _HOLES
    + ", e AS (SELECT dataset, CASE WHEN p_brand <> 'Brand#7' THEN p_brand END AS blocks FROM reg JOIN part ON p_partkey = l_partkey), "
    "n AS (SELECT dataset, "
    + ", ".join(f"count(DISTINCT {c}) + max(CAST({c} IS NULL AS BIGINT)) AS {c}" for c in ("year", "adm", "ward", "insurance", "patient_id"))
    + " FROM h GROUP BY dataset) SELECT n.*, b.blocks FROM n JOIN (SELECT dataset, count(DISTINCT blocks) + max(CAST(blocks IS NULL AS BIGINT)) AS blocks FROM e GROUP BY dataset) b USING (dataset)",
)
def _(spark, sf):
    blocks = icd(spark, sf).withColumn("blocks", F.transform("blocks", lambda b: F.nullif(b, F.lit("Brand#7"))))
    df = _anchors(spark, sf).join(blocks, "stay_id")
    return su.anchor_table(df, ["year", "adm", "ward", "insurance", "patient_id"], ["blocks"])


@query(
    "t02_dataset_summary",
    with_roles("reg")
    + "SELECT dataset, count(DISTINCT patient_id) AS num_patients, count(DISTINCT stay_id) AS num_stays, round(count(*) / count(DISTINCT stay_id) / 24, 6) AS average_los FROM reg GROUP BY dataset",
)
def _(spark, sf):
    return su.dataset_summary(reg(spark, sf)).withColumn("average_los", r6("average_los"))


@query(
    "t02_dataset_summary_display",
    with_roles("grid")
    + "SELECT dataset, format('{:,}', count(DISTINCT stay_id)) AS num_patients, format('{:,}', count(DISTINCT stay_id)) AS num_stays, "
    "format('{:,.1f}', count(*) / count(DISTINCT stay_id) / 24) AS average_los FROM grid GROUP BY dataset",
)
def _(spark, sf):
    return su.dataset_summary(grid(spark, sf), patient="stay_id", display=True)


_OUT = (
    "SELECT dataset, '{o}' AS outcome, count(DISTINCT patient_id) AS num_patients, count(DISTINCT stay_id) AS num_stays, count(*) AS num_samples, "
    "{p} AS prevalence, {m} AS mean, {s} AS sd FROM o WHERE {o} IS NOT NULL GROUP BY dataset"
)
_NULL = "CAST(NULL AS DOUBLE)"


@query(
    "t03_outcome_summary",
    with_roles("reg")
    + ", o AS (SELECT *, CASE WHEN flag <> 'N' THEN CAST(flag = 'R' AS DOUBLE) END AS returned, CASE WHEN x_line < 6 THEN y END AS log_price FROM reg) "
    + _OUT.format(o="returned", p="round(100 * avg(returned), 6)", m=_NULL, s=_NULL)
    + " UNION ALL "
    + _OUT.format(o="log_price", p=_NULL, m="round(avg(log_price), 6)", s="round(stddev_pop(log_price), 6)"),
)
def _(spark, sf):
    df = reg(spark, sf).withColumns(
        {
            "returned": F.when(F.col("flag") != "N", (F.col("flag") == "R").cast("double")),
            "log_price": F.when(F.col("x_line") < 6, F.col("y")),
        }
    )
    out = su.outcome_summary(df, {"returned": "binary", "log_price": "regression"})
    return out.withColumns({c: r6(c) for c in ("prevalence", "mean", "sd")})


@query(
    "t04_transpose",
    with_roles("reg")
    + ", s AS (SELECT dataset, count(*) AS n, count(DISTINCT patient_id) AS patients FROM reg GROUP BY dataset) "
    + " UNION ALL ".join(
        f"SELECT '{c}' AS \"column\", " + ", ".join(f"max(CASE WHEN dataset = '{d}' THEN CAST({c} AS VARCHAR) END) AS \"{d}\"" for d in REGIONS) + " FROM s"
        for c in ("n", "patients")
    ),
)
def _(spark, sf):
    s = reg(spark, sf).groupBy("dataset").agg(F.count("*").alias("n"), F.count_distinct("patient_id").alias("patients"))
    return su.transpose(s, "dataset")


@query("t05_prevalence", with_roles("bin") + "SELECT dataset, round(avg(y), 6) AS prevalence FROM bin GROUP BY dataset")
def _(spark, sf):
    return su.prevalence(binary(spark, sf)).withColumn("prevalence", r6("prevalence"))


def _share(d: str) -> str:
    hit = f"dataset = '{d}' AND adm IS NOT NULL"
    return f"round(count(*) FILTER (WHERE dataset = '{d}') / (SELECT count(*) FROM h WHERE {hit}), 6)"


@query(
    "t06_category_distribution",
    with_roles("reg") + _HOLES
    + "SELECT adm AS category, " + ", ".join(f"{_share(d)} AS \"{d}\"" for d in REGIONS) + " FROM h WHERE adm IS NOT NULL GROUP BY adm UNION ALL SELECT '(missing)', "
    + ", ".join(f"round(avg(CAST(adm IS NULL AS DOUBLE)) FILTER (WHERE dataset = '{d}'), 6)" for d in REGIONS) + " FROM h",
)
def _(spark, sf):
    out = su.category_distribution(_anchors(spark, sf), "adm")
    return out.select("category", *[r6(F.col(f"`{d}`")).alias(d) for d in REGIONS])


_KDE = (
    ", a AS (SELECT (max(v) - min(v)) / 80 / stddev_pop(v) AS bw FROM s), "
    "e AS (SELECT dataset, count(*) AS n, min(v) AS lo, max(v) AS hi, stddev_samp(v) * any_value(bw) AS h FROM s, a GROUP BY dataset HAVING min(v) < max(v)), "
    "c AS (SELECT dataset, v, count(*) AS c FROM s GROUP BY dataset, v), "
    "g AS (SELECT *, lo + point * (hi - lo) / {last} AS x FROM e, (SELECT CAST(range AS INTEGER) AS point FROM range({n}))) "
)


@query(
    "t07_kde",
    with_roles("reg")
    + ", s AS (SELECT dataset, x_qty AS v FROM reg)"
    + _KDE.format(n=300, last="299.0")
    + "SELECT dataset, point, round(x, 6) AS x, round(sum(c * exp(-0.5 * ((x - v) / h) ** 2)) / any_value(n * h) / sqrt(2 * pi()), 6) AS density FROM g JOIN c USING (dataset) GROUP BY dataset, point, x",
)
def _(spark, sf):
    return su.kde(reg(spark, sf), "x_qty").withColumns({"x": r6("x"), "density": r6("density")})


@query(
    "t08_missing_rate",
    with_roles("reg_null")
    + "SELECT dataset, round(avg(CAST(x_disc IS NULL AS DOUBLE)), 6) AS x_disc, round(avg(CAST(x_tax IS NULL AS DOUBLE)), 6) AS x_tax FROM reg_null GROUP BY dataset",
)
def _(spark, sf):
    out = su.missing_rate(reg_null(spark, sf), ["x_disc", "x_tax"])
    return out.withColumns({"x_disc": r6("x_disc"), "x_tax": r6("x_tax")})


_BOUNDS = ", ".join(
    f"(SELECT min(value) FROM events WHERE event_type = '{c}') AS lo_{c}, (SELECT max(value) / 2 FROM events WHERE event_type = '{c}') AS up_{c}"
    for c in ("click", "error", "purchase", "view")
)


@query(
    "t09_variable_report",
    with_roles("grid")
    + f", b AS (SELECT {_BOUNDS}), l AS ("
    "SELECT 'click' AS variable, dataset, CASE WHEN click IS NOT NULL THEN ln(least(greatest(click, lo_click), up_click) + 0.1) END AS v FROM grid, b UNION ALL "
    "SELECT 'error', dataset, CASE WHEN error IS NOT NULL THEN least(greatest(error, lo_error), up_error) END FROM grid, b UNION ALL "
    "SELECT 'purchase', dataset, CASE WHEN purchase IS NOT NULL THEN nullif(least(greatest(purchase, lo_purchase), up_purchase), 0) END FROM grid, b UNION ALL "
    "SELECT 'view', dataset, CASE WHEN greatest(\"view\", lo_view) > 0 AND \"view\" IS NOT NULL THEN ln(greatest(\"view\", lo_view)) END FROM grid, b), "
    "mis AS (SELECT variable, dataset, avg(CAST(v IS NULL AS DOUBLE)) AS missing FROM l GROUP BY variable, dataset), "
    "s AS (SELECT * FROM l WHERE v IS NOT NULL), "
    "a AS (SELECT variable, (max(v) - min(v)) / 80 / stddev_pop(v) AS bw FROM s GROUP BY variable), "
    "e AS (SELECT variable, dataset, count(*) AS n, min(v) AS lo, max(v) AS hi, stddev_samp(v) * any_value(bw) AS h FROM s JOIN a USING (variable) GROUP BY variable, dataset HAVING min(v) < max(v)), "
    "g AS (SELECT *, lo + point * (hi - lo) / 19.0 AS x FROM e, (SELECT CAST(range AS INTEGER) AS point FROM range(20))) "
    "SELECT variable, dataset, point, round(x, 5) AS x, round(sum(exp(-0.5 * ((x - v) / h) ** 2)) / any_value(n * h) / sqrt(2 * pi()), 5) AS density, round(any_value(missing), 6) AS missing "
    "FROM g JOIN s USING (variable, dataset) JOIN mis USING (variable, dataset) GROUP BY variable, dataset, point, x",
)
def _(spark, sf):
    density, _ = su.variable_report(grid(spark, sf), written_dictionary(spark, sf), points=20)
    return density.withColumns({"x": r6("x", 5), "density": r6("density", 5), "missing": r6("missing")})


@query(
    "t09_variable_report_discrete",
    with_roles("reg")
    + ", h AS (SELECT dataset, nullif(adm, '5-LOW') AS adm, coalesce(CASE WHEN flag <> 'N' THEN flag = 'R' END, false) AS ind FROM reg), "
    "l AS (SELECT 'adm' AS variable, dataset, adm AS category FROM h UNION ALL SELECT 'ind', dataset, CAST(ind AS VARCHAR) FROM h) "
    "SELECT variable, dataset, category, round(count(*) / sum(count(*)) OVER (PARTITION BY variable, dataset), 6) AS share FROM l WHERE category IS NOT NULL GROUP BY variable, dataset, category",
)
def _(spark, sf):
    from ..functions.bounded import local_table

    df = reg(spark, sf).select(
        "dataset",
        F.nullif(F.col("adm"), F.lit("5-LOW")).alias("adm"),
        F.when(F.col("flag") != "N", F.col("flag") == "R").alias("ind"),
        F.col("x_qty").alias("qty"),
    )
    schema = "VariableTag string, DataType string, LowerBound double, UpperBound double, LogTransform boolean, LogTransformEps double"
    rows = [{"VariableTag": v, "DataType": t} for v, t in (("adm", "categorical"), ("ind", "treatment_ind"), ("qty", "continuous"))]
    _, shares = su.variable_report(df, local_table(spark, rows, schema), points=20)
    return shares.withColumn("share", r6("share"))


@query(
    "t10_residual_band",
    with_roles("scored")
    + ", pick AS (SELECT dataset, 1.0::DOUBLE AS gamma, arg_min(model, mse) AS model FROM (SELECT r_name AS dataset, model, avg(m) AS mse FROM region, (SELECT dataset AS u, model, avg((y - yhat) ** 2) AS m FROM scored WHERE split = 'train_val' GROUP BY dataset, model) WHERE u <> r_name GROUP BY r_name, model) GROUP BY dataset) "
    "SELECT eval_target, gamma, metric, round(value, 6) AS value FROM ("
    "SELECT s.dataset AS eval_target, gamma, unnest(['quantile_0.1', 'quantile_0.5', 'quantile_0.9', 'mean_residual']) AS metric, "
    "unnest([quantile_cont(y - yhat, 0.1), quantile_cont(y - yhat, 0.5), quantile_cont(y - yhat, 0.9), avg(y - yhat)]) AS value "
    "FROM scored s JOIN pick p ON p.dataset = s.dataset AND p.model = s.model WHERE s.split = 'test' GROUP BY s.dataset, gamma)",
)
def _(spark, sf):
    """Residual quantiles of the run that CV prefers."""
    from ..operators.metrics import all_metrics, metrics_long
    from .roles import scored

    by = ["dataset", "split", "model"]
    # One small table, read once for the runs and once for the CV sets.
    long = pin(metrics_long(all_metrics(scored(spark, sf), by, "regression"), by))
    runs = F.array(
        *[
            F.struct(F.array(*[F.lit(r) for r in REGIONS if r not in out]).alias("sources"), F.lit("+".join(out)).alias("k"))
            for out in ([t] for t in REGIONS)
        ]
    )
    res = long.select(
        F.col("dataset").alias("target"), "split", "metric", "value", F.col("model").alias("alpha"), F.lit(1.0).alias("gamma"), F.inline(runs)
    )
    # Sets of all but two sources are the CV sets.
    pairs = F.array(
        *[
            F.struct(F.array(*[F.lit(r) for r in REGIONS if r not in (t, u)]).alias("sources"), F.lit(t).alias("t"), F.lit(u).alias("u"))
            for i, t in enumerate(REGIONS)
            for u in REGIONS[i + 1 :]
        ]
    )
    cv = long.where("split = 'train_val'").select(
        F.col("dataset").alias("target"), "split", "metric", "value", F.col("model").alias("alpha"), F.lit(1.0).alias("gamma"), F.inline(pairs)
    )
    res = res.unionByName(cv.withColumn("k", F.concat("t", F.lit("+"), "u")).drop("t", "u"))
    res = res.withColumn("run_id", F.concat_ws("|", "k", "alpha")).drop("k")
    band = su.residual_band(res, ["gamma", "alpha"], "mse")
    band = band.where(F.col("metric").isin("quantile_0.1", "quantile_0.5", "quantile_0.9", "mean_residual"))
    return band.select("eval_target", "gamma", "metric", r6("value").alias("value"))
