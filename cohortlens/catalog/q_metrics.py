"""Scoring, metrics, closed-form baselines, resampling."""

from __future__ import annotations

from pyspark.sql import functions as F

from ..operators import baselines as b
from ..operators import linear as lin
from ..operators import metrics as me
from ..operators import sampling as sa
from ..plans import learning
from ..session import pin
from .descent_sql import descent, matrix, scaled, vector
from .registry import query
from .roles import BINARY_MODELS, FEATURES, ROW_ID, binary, kept, r6, reg, reg_null, results, scored, scored_binary, with_roles

_BY = ["dataset", "split", "model"]
_G = "dataset, split, model"
_ID = ", ".join(ROW_ID)


def _round_all(df, keys):
    return df.select(*keys, *[r6(F.col(f"`{c}`")).alias(c) for c in df.columns if c not in keys])


def _q(expr: str, levels, name: str) -> str:
    return ", ".join(f'round(quantile_cont({expr}, {q}), 6) + 0.0 AS "{name.format(q=q)}"' for q in levels)


#: The clipping rule as SQL: only a group without values above 1 and with negative ones.
_CLIPPED = (
    ", c AS (SELECT *, CASE WHEN max(yhat) OVER w <= 1 AND min(yhat) OVER w < 0 THEN "
    "least(greatest(yhat, 1e-14), 1 - 1e-14) ELSE yhat END AS p FROM scored_binary WINDOW w AS "
    f"(PARTITION BY {_G})), l AS (SELECT *, CASE WHEN y = 1 THEN -ln(least(greatest(p, 1e-14), 1 - 1e-14)) "
    "ELSE -ln(1 - least(greatest(p, 1e-14), 1 - 1e-14)) END AS loss FROM c) "
)


@query("p01_score_grid", with_roles("scored") + f"SELECT {_ID}, model, round(yhat, 6) AS yhat FROM scored")
def _(spark, sf):
    return scored(spark, sf).select(*ROW_ID, "model", r6("yhat").alias("yhat"))


@query(
    "p02_param_grid",
    with_roles("reg")
    + "SELECT gamma, l1_ratio, round(avg(abs(y - 10)) * gamma + l1_ratio, 6) AS value FROM reg, "
    "(SELECT unnest([1.0, 2.0, 4.0]::DOUBLE[]) AS gamma), (SELECT unnest([0.5, 1.0]::DOUBLE[]) AS l1_ratio) GROUP BY gamma, l1_ratio",
)
def _(spark, sf):
    """Every combination applied to a statistic of the data."""
    mean = reg(spark, sf).agg(F.avg(F.abs(F.col("y") - 10))).scalar()
    grid_ = me.param_grid(spark, {"gamma": [1.0, 2.0, 4.0], "l1_ratio": [0.5, 1.0]})
    return grid_.withColumn("value", r6(mean * F.col("gamma") + F.col("l1_ratio")))


def _linear_scores(spark, sf):
    """Linear scores of a 0/1 outcome: one model may be clipped, one goes above 1."""
    models = [
        {"model": "low", "intercept": -0.2, "coef": [0.01, 1.0, 0.0, 0.0]},
        {"model": "high", "intercept": -0.2, "coef": [0.05, 0.0, 0.0, 0.0]},
    ]
    return me.score_grid(binary(spark, sf), models, FEATURES, ["dataset", "split", *ROW_ID, "y"])


@query(
    "p03_clip_predictions",
    with_roles("bin")
    + ", s AS (SELECT *, 'low' AS model, -0.2 + 0.01 * x_qty + 1.0 * x_disc AS yhat FROM bin UNION ALL "
    "SELECT *, 'high', -0.2 + 0.05 * x_qty FROM bin) "
    f"SELECT {_ID}, dataset, split, model, round(CASE WHEN max(yhat) OVER w <= 1 AND min(yhat) OVER w < 0 THEN "
    f"least(greatest(yhat, 1e-14), 1 - 1e-14) ELSE yhat END, 6) + 0.0 AS yhat FROM s WINDOW w AS (PARTITION BY {_G})",
)
def _(spark, sf):
    out = me.clip_predictions(_linear_scores(spark, sf), _BY)
    return out.select(*ROW_ID, *_BY, r6("yhat").alias("yhat"))


@query(
    "p04_residual_metrics",
    with_roles("scored") + f"SELECT {_G}, {_q('y - yhat', me.RESIDUAL_Q, 'quantile_{q}')}, "
    f"round(avg(y - yhat), 6) AS mean_residual FROM scored GROUP BY {_G}",
)
def _(spark, sf):
    return _round_all(me.residual_metrics(scored(spark, sf), _BY), _BY)


@query(
    "p04_residual_metrics_split_groups",
    with_roles("scored") + f"SELECT model, {_q('y - yhat', me.RESIDUAL_Q, 'quantile_{q}')}, "
    "round(avg(y - yhat), 6) AS mean_residual FROM scored GROUP BY model",
)
def _(spark, sf):
    """The same metric with every group above the size one task may hold."""
    return _round_all(me.residual_metrics(scored(spark, sf), ["model"], hot_rows=1000), ["model"])


@query(
    "p05_regression_metrics",
    with_roles("scored") + f"SELECT {_G}, round(avg((y - yhat) ** 2), 6) AS mse, round(sqrt(avg((y - yhat) ** 2)), 6) AS rmse, "
    f"round(avg(abs(y - yhat)), 6) AS mae FROM scored GROUP BY {_G}",
)
def _(spark, sf):
    return _round_all(me.regression_metrics(scored(spark, sf), _BY), _BY)


@query(
    "p06_absolute_quantiles",
    with_roles("scored") + f"SELECT {_G}, {_q('abs(y - yhat)', me.RESIDUAL_Q, 'abs_quantile_{q}')}, "
    + ", ".join(f'round(quantile_cont(abs(y - yhat), {q}) ** 2, 6) AS "mse_quantile_{q}"' for q in me.RESIDUAL_Q)
    + f" FROM scored GROUP BY {_G}",
)
def _(spark, sf):
    return _round_all(me.absolute_quantiles(scored(spark, sf), _BY), _BY)


@query(
    "p07_accuracy",
    with_roles("scored_binary") + _CLIPPED
    + f"SELECT {_G}, round(avg(CASE WHEN (p >= 0.5) = (y = 1) THEN 1.0 ELSE 0.0 END), 6) AS accuracy FROM l GROUP BY {_G}",
)
def _(spark, sf):
    return _round_all(me.binary_losses(scored_binary(spark, sf), _BY).select(*_BY, "accuracy"), _BY)


@query(
    "p08_log_loss",
    with_roles("scored_binary") + _CLIPPED + f"SELECT {_G}, round(avg(loss), 6) AS log_loss, "
    f"{_q('loss', me.LOSS_Q, 'log_loss_quantile_{q}')} FROM l GROUP BY {_G}",
)
def _(spark, sf):
    src = pin(scored_binary(spark, sf).select(*_BY, "y", "yhat"))
    out = me.binary_losses(src, _BY).select(*_BY, "log_loss").join(me.log_loss_quantiles(src, _BY), _BY)
    return _round_all(out, _BY)


@query(
    "p09_brier",
    with_roles("scored_binary") + _CLIPPED + f"SELECT {_G}, round(avg((y - p) ** 2), 6) AS brier FROM l GROUP BY {_G}",
)
def _(spark, sf):
    return _round_all(me.binary_losses(scored_binary(spark, sf), _BY).select(*_BY, "brier"), _BY)


_AUROC = (
    f", r AS (SELECT {_G}, y, rank() OVER (PARTITION BY {_G} ORDER BY p) + (count(*) OVER (PARTITION BY {_G}, p) - 1) / 2.0 AS k FROM l) "
    f"SELECT {_G}, round((sum(k) FILTER (WHERE y = 1) - count(*) FILTER (WHERE y = 1) * (count(*) FILTER (WHERE y = 1) + 1) / 2.0) "
    f"/ (count(*) FILTER (WHERE y = 1)::DOUBLE * count(*) FILTER (WHERE y = 0)), 6) AS roc FROM r GROUP BY {_G}"
)


@query("p10_auroc", with_roles("scored_binary") + _CLIPPED + _AUROC)
def _(spark, sf):
    return _round_all(me.auroc(scored_binary(spark, sf), _BY), _BY)


@query("p10_auroc_split_groups", with_roles("scored_binary") + _CLIPPED + _AUROC)
def _(spark, sf):
    return _round_all(me.auroc(scored_binary(spark, sf), _BY, hot_rows=100), _BY)


@query(
    "p11_auprc",
    with_roles("scored_binary") + _CLIPPED
    + f", d AS (SELECT {_G}, p, sum(y) AS tp, count(*) AS n FROM l GROUP BY {_G}, p), "
    f"k AS (SELECT *, sum(tp) OVER w AS ctp, sum(n) OVER w AS cn, sum(tp) OVER (PARTITION BY {_G}) AS total FROM d "
    f"WINDOW w AS (PARTITION BY {_G} ORDER BY p DESC)) SELECT {_G}, round(sum(tp / total * ctp / cn), 6) AS auprc FROM k GROUP BY {_G}",
)
def _(spark, sf):
    return _round_all(me.auprc(scored_binary(spark, sf), _BY), _BY)


@query(
    "p12_single_class",
    with_roles("scored_binary")
    + ", l AS (SELECT model, flag, count(*) AS n, round(quantile_cont(-ln(CASE WHEN y = 1 THEN yhat ELSE 1 - yhat END), 0.9), 6) "
    'AS "log_loss_quantile_0.9" FROM scored_binary GROUP BY model, flag) '
    'SELECT model, flag, n, "log_loss_quantile_0.9", CAST(NULL AS DOUBLE) AS roc, CAST(NULL AS DOUBLE) AS auprc, CAST(NULL AS DOUBLE) AS accuracy, '
    "CAST(NULL AS DOUBLE) AS log_loss, CAST(NULL AS DOUBLE) AS brier FROM l",
)
def _(spark, sf):
    """Groups by the outcome's own source hold one class: rank and loss metrics are null."""
    flagged = me.score_grid(
        binary(spark, sf),
        BINARY_MODELS,
        FEATURES,
        ["flag", "y"],
        link="logit",
    )
    flagged = pin(flagged)
    by = ["model", "flag"]
    out = (
        flagged.groupBy(*by)
        .agg(F.count("*").alias("n"))
        .join(me.rank_metrics(flagged, by), by)
        .join(me.binary_losses(flagged, by), by)
        .join(me.log_loss_quantiles(flagged, by).select(*by, F.col("`log_loss_quantile_0.9`")), by)
    )
    return _round_all(out, [*by, "n"])


@query(
    "p13_projected_residuals",
    with_roles("scored")
    + f", p AS (SELECT {_G}, avg(y - yhat) OVER (PARTITION BY {_G}, ward) ** 2 AS e FROM scored) "
    f"SELECT {_G}, {_q('e', me.PROJECTED_Q, 'proj_residuals_sq_quantile_{q}')}, round(avg(e), 6) AS proj_residuals_sq FROM p GROUP BY {_G}",
)
def _(spark, sf):
    return _round_all(me.projected_metrics(scored(spark, sf), _BY, ["ward"]), _BY)


@query(
    "p14_projected_log_loss",
    with_roles("scored_binary") + _CLIPPED
    + f", p2 AS (SELECT {_G}, avg(loss) OVER (PARTITION BY {_G}, patient_id) AS e FROM l) "
    f"SELECT {_G}, {_q('e', me.PROJECTED_Q, 'proj_logloss_quantile_{q}')}, round(avg(e), 6) AS proj_logloss FROM p2 GROUP BY {_G}",
)
def _(spark, sf):
    return _round_all(me.projected_log_loss(scored_binary(spark, sf), _BY, ["patient_id"]), _BY)


_NAMES = [f"{t}/{s}/mse" for t in ("ASIA", "EUROPE") for s in ("train_val", "test")]


@query(
    "p15_to_wide",
    with_roles("results")
    + "SELECT run_id, "
    + ", ".join(
        f"round(max(value) FILTER (WHERE target = '{n.split('/')[0]}' AND split = '{n.split('/')[1]}' AND metric = 'mse'), 6) AS \"{n}\""
        for n in _NAMES
    )
    + " FROM results GROUP BY run_id",
)
def _(spark, sf):
    wide = me.to_wide(results(spark, sf), ["run_id"], _NAMES)
    return _round_all(wide, ["run_id"])


@query(
    "p15_to_long",
    with_roles("results")
    + "SELECT run_id, target, split, metric, round(value, 6) AS value FROM results WHERE target IN ('ASIA', 'EUROPE') AND metric = 'mse'",
)
def _(spark, sf):
    wide = me.to_wide(results(spark, sf), ["run_id"], _NAMES)
    return me.to_long(wide, ["run_id"]).withColumn("value", r6("value"))


def _saturation(spark, sf):
    """Quantity and tax as a saturation in percent; price as log pressure."""
    sat = (F.lit(50.0) + F.col("x_qty")).alias("sat")
    return reg(spark, sf).select("dataset", *ROW_ID, sat, (F.col("y") - 6).alias("y"), "x_tax", "x_disc", "ward", "adm", "x_line", "x_qty")


_ELLIS = (
    ", e AS (SELECT dataset, y - 6 AS y, least((50.0 + x_qty) / 100, 0.997) AS s, * EXCLUDE (dataset, y) FROM reg), "
    "i AS (SELECT *, s * 11700 / (1 - s) AS k FROM e), "
    "po AS (SELECT *, pow(sqrt(k * k + 125000) + k, 1.0 / 3) - pow(sqrt(k * k + 125000) - k, 1.0 / 3) AS po2 FROM i) "
)


@query(
    "p16_po2_from_saturation",
    with_roles("reg") + _ELLIS
    + ", t AS (SELECT *, po2 * exp((36 + x_line / 7 - 37) * (0.058 / (0.243 * pow(0.01 * po2, 3.88) + 1) + 0.013)) AS warm FROM po), "
    "h AS (SELECT *, warm * exp((7.3 + x_tax - 7.4) * (pow(warm / 26.6, 0.184) - 2.2)) AS full_po2 FROM t) "
    f"SELECT {_ID}, round(po2, 5) AS po2, round(full_po2, 5) AS corrected, round(1 / (23400 / (po2 * po2 * po2 + 150 * po2) + 1), 6) AS back FROM h",
)
def _(spark, sf):
    df = _saturation(spark, sf)
    po2 = b.po2_from_saturation(F.col("sat") / 100)
    full = b.po2_from_saturation(F.col("sat") / 100, F.lit(36) + F.col("x_line") / 7, F.lit(7.3) + F.col("x_tax"))
    return df.select(*ROW_ID, r6(po2, 5).alias("po2"), r6(full, 5).alias("corrected"), r6(b.saturation_from_po2(po2)).alias("back"))


@query(
    "p16_po2_metrics",
    with_roles("reg") + _ELLIS
    + f"SELECT dataset, {_q('y - ln(po2)', me.RESIDUAL_Q, 'quantile_{q}')}, round(avg(y - ln(po2)), 6) AS mean_residual, "
    "round(avg((y - ln(po2)) ** 2), 6) AS mse, round(sqrt(avg((y - ln(po2)) ** 2)), 6) AS rmse, round(avg(abs(y - ln(po2))), 6) AS mae FROM po GROUP BY dataset",
)
def _(spark, sf):
    return _round_all(b.score_po2_baseline(_saturation(spark, sf), "sat", ["dataset"]), ["dataset"])


def _segments(xs, ys) -> str:
    rows = ", ".join(f"({x0}::DOUBLE, {x1}::DOUBLE, {y0}::DOUBLE, {y1}::DOUBLE)" for x0, x1, y0, y1 in zip(xs, xs[1:], ys, ys[1:]))
    return f"(VALUES {rows}) seg(x0, x1, y0, y1)"


_SAT = [s / 100 for s in b.SATURATION_GRID]


@query(
    "p17_interp_lookup",
    with_roles("reg")
    + ", v AS (SELECT DISTINCT (x_qty * 2 + x_tax * 10) / 100 AS x FROM reg) "
    f"SELECT round(x, 8) AS x, round(CASE WHEN x <= {_SAT[0]} THEN 1.0 WHEN x >= {_SAT[-1]} THEN 500.0 ELSE "
    f"(SELECT max(y0 + (x - x0) * (y1 - y0) / (x1 - x0)) FROM {_segments(_SAT, b.PO2_GRID)} WHERE x0 <= x AND x < x1) END, 5) AS po2 FROM v",
)
def _(spark, sf):
    x = ((F.col("x_qty") * 2 + F.col("x_tax") * 10) / 100).alias("x")
    v = reg(spark, sf).select(x).distinct()
    return v.select(r6("x", 8).alias("x"), r6(b.interp_lookup(F.col("x")), 5).alias("po2"))


def _curve_case(values) -> str:
    return f"(SELECT max(y0 + (s - x0) * (y1 - y0) / (x1 - x0)) FROM {_segments(b.SCORE_GRID, values)} WHERE x0 <= s AND s < x1)"


@query(
    "p18_mortality_baseline",
    with_roles("reg")
    + ", s AS (SELECT *, coalesce(CASE WHEN l_linenumber <> 3 THEN x_qty * 1.1 END, 0.1) AS s, CASE ward WHEN 'BUILDING' THEN 'surg' "
    "WHEN 'MACHINERY' THEN 'med' WHEN 'HOUSEHOLD' THEN 'other' WHEN 'FURNITURE' THEN 'elective' END AS a FROM reg) "
    f"SELECT {_ID}, a AS adm, round(CASE WHEN a = 'surg' THEN {_curve_case(b.SURGICAL_MORTALITY)} WHEN a = 'elective' THEN 0.0 "
    f"ELSE {_curve_case(b.MEDICAL_MORTALITY)} END / 100, 6) AS yhat FROM s",
)
def _(spark, sf):
    adm = (
        F.when(F.col("ward") == "BUILDING", "surg")
        .when(F.col("ward") == "MACHINERY", "med")
        .when(F.col("ward") == "HOUSEHOLD", "other")
        .when(F.col("ward") == "FURNITURE", "elective")
    )
    score = F.when(F.col("l_linenumber") != 3, F.col("x_qty") * 1.1)
    df = reg(spark, sf).select(*ROW_ID, adm.alias("adm"), score.alias("score"))
    return b.score_mortality_baseline(df, "score", "adm").select(*ROW_ID, "adm", r6("yhat").alias("yhat"))


_RANKS = (
    "WITH k AS (SELECT DISTINCT o_custkey FROM orders), r AS (SELECT o_custkey, seed, row_number() OVER (PARTITION BY seed ORDER BY "
    "md5(CAST(seed AS VARCHAR) || ':' || CAST(o_custkey AS VARCHAR)), o_custkey) AS rank FROM k, (SELECT CAST(range AS INTEGER) AS seed FROM range(3))) "
)
_SIZES = [25, 35, 50, 70, 100, 140, 200, 280, 400, 560, 800, 1120, 1600]


def _orders(spark, sf):
    from .roles import table

    return table(spark, sf, "orders")


@query("l01_nested_ranks", _RANKS + "SELECT o_custkey, seed, rank FROM r WHERE rank <= 200")
def _(spark, sf):
    return sa.nested_ranks(_orders(spark, sf), "o_custkey", [0, 1, 2], 200)


@query(
    "l01_nested_samples",
    _RANKS + f", n AS (SELECT CAST(unnest({_SIZES}) AS INTEGER) AS n_target) SELECT seed, n_target, count(*) AS n, sum(o_custkey)::BIGINT AS checksum "
    "FROM r JOIN n ON rank <= n_target WHERE n_target <= (SELECT count(*) FROM k) GROUP BY seed, n_target",
)
def _(spark, sf):
    s = sa.nested_samples(_orders(spark, sf), "o_custkey", [0, 1, 2], _SIZES)
    return s.groupBy("seed", "n_target").agg(F.count("*").alias("n"), F.sum("o_custkey").alias("checksum"))


@query(
    "l02_feasible_sizes",
    with_roles("reg") + f"SELECT dataset, n_target FROM (SELECT CAST(unnest({_SIZES}) AS INTEGER) AS n_target), "
    "(SELECT dataset, count(DISTINCT patient_id) AS c FROM reg GROUP BY dataset) WHERE n_target <= c",
)
def _(spark, sf):
    return sa.feasible_sizes(reg(spark, sf), "patient_id", _SIZES, ["dataset"])


@query(
    "l03_group_folds",
    "SELECT o_orderkey, CAST(('0x' || substr(md5(CAST(o_custkey AS VARCHAR)), 1, 7))::BIGINT % 5 AS BIGINT) AS fold FROM orders",
)
def _(spark, sf):
    return sa.group_folds(_orders(spark, sf), "o_custkey").select("o_orderkey", "fold")


@query(
    "l03_balanced_folds",
    "WITH s AS (SELECT o_custkey, count(*) AS c FROM orders GROUP BY o_custkey), "
    "p AS (SELECT o_custkey, row_number() OVER (ORDER BY c DESC, md5(CAST(o_custkey AS VARCHAR)), o_custkey) - 1 AS i FROM s) "
    "SELECT o_orderkey, CAST(CASE WHEN (i // 5) % 2 = 0 THEN i % 5 ELSE 4 - i % 5 END AS BIGINT) AS fold FROM orders JOIN p USING (o_custkey)",
)
def _(spark, sf):
    return sa.group_folds(_orders(spark, sf), "o_custkey", balanced=True).select("o_orderkey", "fold")


@query(
    "l04_out_of_fold",
    with_roles("reg")
    + ", f AS (SELECT *, ('0x' || substr(md5(CAST(patient_id AS VARCHAR)), 1, 7))::BIGINT % 5 AS fold FROM reg), "
    "m AS (SELECT k.fold, covar_pop(x_qty, y) / var_pop(x_qty) / 1.1 AS b, avg(x_qty) AS mx, avg(y) AS my FROM f, "
    "(SELECT DISTINCT fold FROM f) k WHERE f.fold <> k.fold GROUP BY k.fold) "
    f"SELECT {_ID}, fold, round(my + b * (x_qty - mx), 6) AS yhat_cv FROM f JOIN m USING (fold)",
)
def _(spark, sf):
    out, _full = lin.fit_predict_cv(reg(spark, sf), ["x_qty"], "y", "patient_id", alpha=0.1)
    return out.select(*ROW_ID, "fold", r6("yhat_cv").alias("yhat_cv"))


_LC_SIZES = [10, 20, 40, 80]


@query(
    "l05_learning_curve",
    with_roles("reg")
    + ", tr AS (SELECT *, ('0x' || substr(md5(CAST(patient_id AS VARCHAR)), 1, 7))::BIGINT % 5 AS fold FROM reg WHERE split = 'train_val'), "
    "rk AS (SELECT patient_id, seed, row_number() OVER (PARTITION BY seed ORDER BY md5(CAST(seed AS VARCHAR) || ':' || CAST(patient_id AS VARCHAR)), patient_id) AS rank "
    "FROM (SELECT DISTINCT patient_id FROM tr), (SELECT CAST(range AS INTEGER) AS seed FROM range(3))), "
    f"sm AS (SELECT seed, n_target, fold, x_qty, y FROM tr JOIN rk USING (patient_id), (SELECT CAST(unnest({_LC_SIZES}) AS INTEGER) AS n_target) WHERE rank <= n_target), "
    "fm AS (SELECT a.seed, a.n_target, k.fold, covar_pop(x_qty, y) / var_pop(x_qty) / 1.1 AS b, avg(x_qty) AS mx, avg(y) AS my FROM sm a "
    "JOIN (SELECT DISTINCT seed, n_target, fold FROM sm) k ON k.seed = a.seed AND k.n_target = a.n_target AND k.fold <> a.fold GROUP BY a.seed, a.n_target, k.fold), "
    "cv AS (SELECT seed, n_target, avg((y - my - b * (x_qty - mx)) ** 2) AS v FROM sm JOIN fm USING (seed, n_target, fold) GROUP BY seed, n_target), "
    "full_m AS (SELECT seed, n_target, covar_pop(x_qty, y) / var_pop(x_qty) / 1.1 AS b, avg(x_qty) AS mx, avg(y) AS my FROM sm GROUP BY seed, n_target), "
    "te AS (SELECT seed, n_target, avg((y - my - b * (x_qty - mx)) ** 2) AS v FROM full_m, (SELECT * FROM reg WHERE split = 'test') GROUP BY seed, n_target) "
    "SELECT seed, n_target, round(cv.v, 6) AS cv_value, round(te.v, 6) AS test_value FROM cv JOIN te USING (seed, n_target)",
)
def _(spark, sf):
    df = reg(spark, sf)
    out = learning.learning_curve(
        df.where("split = 'train_val'"), df.where("split = 'test'"), ["x_qty"], "y", "patient_id", [0, 1, 2], [0.1], sizes=_LC_SIZES
    )
    return out.where("metric = 'mse'").select("seed", "n_target", r6("cv_value").alias("cv_value"), r6("test_value").alias("test_value"))


_FP = len(FEATURES)


def _samples_sql(role: str, where: str, seeds: int) -> str:
    """CTEs ``sm`` (seed, n_target, fold, features, y), ``sets`` (sid, seed, n_target, k) and ``tn`` (rows to train on, by sid)."""
    cols = ", ".join(FEATURES)
    return (
        f"tr AS MATERIALIZED (SELECT *, ('0x' || substr(md5(CAST(patient_id AS VARCHAR)), 1, 7))::BIGINT % 5 AS fold FROM {role} WHERE {where} AND split = 'train_val'), "
        "rk AS (SELECT patient_id, seed, row_number() OVER (PARTITION BY seed ORDER BY md5(CAST(seed AS VARCHAR) || ':' || CAST(patient_id AS VARCHAR)), patient_id) AS rank "
        f"FROM (SELECT DISTINCT patient_id FROM tr), (SELECT CAST(range AS INTEGER) AS seed FROM range({seeds}))), "
        f"sm AS MATERIALIZED (SELECT seed, n_target, fold, {cols}, y FROM tr JOIN rk USING (patient_id), (SELECT CAST(unnest({_LC_SIZES}) AS INTEGER) AS n_target) "
        "WHERE rank <= n_target AND n_target <= (SELECT count(DISTINCT patient_id) FROM tr)), "
        # k is the fold left out; -1 leaves out none.
        "sets AS MATERIALIZED (SELECT row_number() OVER () AS sid, * FROM (SELECT DISTINCT seed, n_target, fold AS k FROM sm UNION SELECT DISTINCT seed, n_target, -1 FROM sm)), "
        f"tn AS MATERIALIZED (SELECT sid, {cols}, y FROM sets JOIN sm USING (seed, n_target) WHERE fold <> k)"
    )


def _curve_sql(where: str, role: str, l1: float) -> str:
    """The curve's rows from ``md`` (sid, alpha, a, b1.., m1.., s1..): models on columns imputed by m and scaled by s."""
    yhat = "a + " + " + ".join(f"b{i} * (coalesce({c}, m{i}) - m{i}) / s{i}" for i, c in enumerate(FEATURES))
    value = {"mse": "avg(r * r)", "rmse": "sqrt(avg(r * r))", "mean_residual": "avg(r)"}
    metrics = " UNION ALL ".join(
        f"SELECT seed, n_target, alpha, '{k}' AS metric, round(any_value(cv.{k}), 6) + 0.0 AS cv_value, round(any_value(te.{k}), 6) + 0.0 AS test_value "
        "FROM cv JOIN te USING (seed, n_target, alpha) GROUP BY seed, n_target, alpha"
        for k in value
    )
    sums = ", ".join(f"{v} AS {k}" for k, v in value.items())
    return (
        f"cv AS (SELECT seed, n_target, alpha, {sums} FROM (SELECT seed, n_target, alpha, y - ({yhat}) AS r FROM sm JOIN sets USING (seed, n_target) JOIN md USING (sid) WHERE fold = k) GROUP BY seed, n_target, alpha), "
        f"te AS (SELECT seed, n_target, alpha, {sums} FROM (SELECT seed, n_target, alpha, y - ({yhat}) AS r FROM sets JOIN md USING (sid), (SELECT * FROM {role} WHERE {where} AND split = 'test') WHERE k = -1) GROUP BY seed, n_target, alpha) "
        f"SELECT seed, n_target, 0::INTEGER AS model_idx, alpha, {l1}::DOUBLE AS l1_ratio, metric, cv_value, test_value FROM ({metrics})"
    )


def _list(name: str, q: int = _FP) -> str:
    return ", ".join(f"b[{i + 1}] AS {name}{i}" for i in range(q))


_PRIOR_ROWS = scaled("pq", FEATURES).replace("dataset, ", "")
_REFIT_Z = ", ".join(f"(x.{c} - p.m{i}) / p.s{i} AS z{i}" for i, c in enumerate(FEATURES))


@query(
    "l05_refit_curve",
    with_roles("reg").replace("WITH ", "WITH RECURSIVE ", 1)
    + f", pq AS MATERIALIZED (SELECT * FROM reg WHERE split = 'train_val' AND dataset <> 'ASIA'), {_PRIOR_ROWS}, "
    + f"pr AS (SELECT 1 AS id, 0.01::DOUBLE AS alpha, 0.5::DOUBLE AS l1, {matrix(lambda i, j: f'covar_pop(z{i}, z{j})', _FP, _FP)} AS g, "
    + f"{vector(lambda i: f'covar_pop(z{i}, z{_FP})', _FP)} AS c, {vector(lambda i: '1.0::DOUBLE', _FP)} AS f FROM z), "
    + descent(60)
    + ", "
    + f"pb AS MATERIALIZED (SELECT b AS b0, sc.* FROM cd, sc), {_samples_sql('reg', "dataset = 'ASIA'", 3)}, "
    + f"zz AS (SELECT sid, {_REFIT_Z}, x.y AS z{_FP} FROM tn x, pb p), "
    + f"gg AS MATERIALIZED (SELECT sid, {matrix(lambda i, j: f'covar_pop(z{i}, z{j})', _FP, _FP)} AS g, {vector(lambda i: f'covar_pop(z{i}, z{_FP})', _FP)} AS c, "
    + f"{vector(lambda i: f'avg(z{i})', _FP)} AS mz, avg(z{_FP}) AS my FROM zz GROUP BY sid), "
    # What the prior leaves over is fitted and added to it.
    + f"pr2 AS MATERIALIZED (SELECT row_number() OVER () AS id, sid, alpha, 0.0::DOUBLE AS l1, g, [c[i] - list_inner_product(g[i], b0) FOR i IN range(1, {_FP + 1})] AS c, "
    + f"{vector(lambda i: '1.0::DOUBLE', _FP)} AS f, mz, my FROM gg, pb, (SELECT unnest([1.0, 0.1]::DOUBLE[]) AS alpha)), "
    + descent(60, "cd2", "st2", "pr2")
    + f", md AS MATERIALIZED (SELECT sid, alpha, my - list_inner_product(b, mz) AS a, {_list('b')}, {', '.join(f'm{i}, s{i}' for i in range(_FP))} "
    + f"FROM (SELECT sid, alpha, my, mz, [cd2.b[i] + b0[i] FOR i IN range(1, {_FP + 1})] AS b, {', '.join(f'm{i}, s{i}' for i in range(_FP))} FROM cd2 JOIN pr2 USING (id), pb)), "
    + _curve_sql("dataset = 'ASIA'", "reg", 0.0),
)
def _(spark, sf):
    df = kept(reg(spark, sf), "dataset", "split", "patient_id", *FEATURES, "y")
    train = df.where("split = 'train_val'")

    cols = [*FEATURES, "y"]
    m = lin.Moments.gather(train, cols)
    rest = [e for e in m.envs() if e != ("ASIA",)]
    prior = lin.fit_linear(m, [0.01], 0.5, rest)[0]
    prior = lin.replace(prior, params={**prior.params, "scale": m.scaling(rest)[1][:-1]})
    out = learning.learning_curve(
        train.where("dataset = 'ASIA'"),
        df.where("split = 'test' and dataset = 'ASIA'"),
        FEATURES,
        "y",
        "patient_id",
        [0, 1, 2],
        [1.0, 0.1],
        sizes=_LC_SIZES,
        priors=[prior],
    )
    return out.withColumns({c: r6(c) for c in ("cv_value", "test_value")})


@query(
    "l06_learning_curve_in_fold",
    with_roles("reg_null").replace("WITH ", "WITH RECURSIVE ", 1)
    + f", {_samples_sql('reg_null', 'true', 4)}, "
    + f"mm AS MATERIALIZED (SELECT sid, {', '.join(f'avg({c}) AS m{i}' for i, c in enumerate(FEATURES))} FROM tn GROUP BY sid), "
    + f"sc AS MATERIALIZED (SELECT sid, {', '.join(f'any_value(m{i}) AS m{i}, stddev_pop(coalesce({c}, m{i})) AS s{i}' for i, c in enumerate(FEATURES))} FROM tn JOIN mm USING (sid) GROUP BY sid), "
    + f"zz AS (SELECT sid, {', '.join(f'(coalesce({c}, m{i}) - m{i}) / s{i} AS z{i}' for i, c in enumerate(FEATURES))}, y AS z{_FP} FROM tn JOIN sc USING (sid)), "
    + f"pr AS MATERIALIZED (SELECT row_number() OVER () AS id, *, 0.5::DOUBLE AS l1 FROM (SELECT sid, {matrix(lambda i, j: f'covar_pop(z{i}, z{j})', _FP, _FP)} AS g, "
    + f"{vector(lambda i: f'covar_pop(z{i}, z{_FP})', _FP)} AS c, {vector(lambda i: '1.0::DOUBLE', _FP)} AS f, avg(z{_FP}) AS a FROM zz GROUP BY sid), (SELECT unnest([0.1, 0.01]::DOUBLE[]) AS alpha)), "
    + descent(60)
    + f", md AS MATERIALIZED (SELECT sid, alpha, a, {_list('b')}, {', '.join(f'm{i}, s{i}' for i in range(_FP))} FROM cd JOIN pr USING (id) JOIN sc USING (sid)), "
    + _curve_sql("true", "reg_null", 0.5),
)
def _(spark, sf):
    """Features with holes: imputation and scaling are learned inside each fold."""
    df = reg_null(spark, sf)
    out = learning.learning_curve(
        df.where("split = 'train_val'"), df.where("split = 'test'"), FEATURES, "y", "patient_id", [0, 1, 2, 3], [0.1, 0.01], [0.5], _LC_SIZES
    )
    return out.withColumns({c: r6(c) for c in ("cv_value", "test_value")})


@query(
    "l07_filter_priors",
    with_roles("results")
    + "SELECT DISTINCT run_id, gamma, alpha FROM results WHERE abs(log2(gamma) - round(log2(gamma))) <= 0.1 AND gamma <= 2 "
    "AND abs(log10(alpha / (SELECT min(alpha) FROM results)) - 3) <= 0.01",
)
def _(spark, sf):
    runs = results(spark, sf).select("run_id", "gamma", "alpha").distinct()
    return learning.filter_prior_alpha(learning.filter_priors(runs, "gamma", largest=2.0), "alpha")
