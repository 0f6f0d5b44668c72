"""Learning-curve analytics."""

from __future__ import annotations

from pyspark.sql import functions as F

from ..operators import curves as cu
from .registry import query
from .roles import CURVE_SIZES, learning_curves, r6, with_roles

_K = ["experiment", "target", "seed"]
_MSE = ", q AS (SELECT experiment, target, seed, n_target, test_value AS v FROM curves WHERE metric = 'mse') "


def _mse(spark, sf):
    return learning_curves(spark, sf).where("metric = 'mse'")


#: Isotonic (falling) fit by the max-min formula over all blocks.
_ISO = (
    ", pts AS (SELECT *, row_number() OVER (PARTITION BY experiment, target, seed ORDER BY n_target) AS i, "
    "sum(v) OVER (PARTITION BY experiment, target, seed ORDER BY n_target) AS cs FROM q), "
    "blk AS (SELECT a.experiment, a.target, a.seed, a.i AS j, b.i AS k, (b.cs - a.cs + a.v) / (b.i - a.i + 1) AS m FROM pts a JOIN pts b "
    "ON a.experiment = b.experiment AND a.target = b.target AND a.seed = b.seed AND a.i <= b.i), "
    "inner_max AS (SELECT p.experiment, p.target, p.seed, p.i, b.j, max(b.m) AS m FROM pts p JOIN blk b ON b.experiment = p.experiment AND b.target = p.target "
    "AND b.seed = p.seed AND b.j <= p.i AND b.k >= p.i GROUP BY p.experiment, p.target, p.seed, p.i, b.j), "
    "iso AS (SELECT p.experiment, p.target, p.seed, p.n_target, p.i, p.v, min(x.m) AS fit FROM pts p JOIN inner_max x USING (experiment, target, seed, i) "
    "GROUP BY p.experiment, p.target, p.seed, p.n_target, p.i, p.v) "
)


@query(
    "v01_isotonic",
    with_roles("curves") + _MSE + _ISO
    + "SELECT experiment, target, seed, n_target, round(v, 6) AS test_value, round(fit, 6) AS fit FROM iso",
)
def _(spark, sf):
    out = cu.isotonic(_mse(spark, sf), _K, "n_target", "test_value", increasing=False)
    return out.select(*_K, F.col("n_target").cast("int").alias("n_target"), r6("test_value").alias("test_value"), r6("fit").alias("fit"))


@query("v02_smooth_curves")
def _(spark, sf):
    sizes = [5, 7, 10, 14, 20, 28, 40, 56, 80, 112, 160]
    df = _mse(spark, sf)
    return cu.smooth_curves(df, _K, "n_target", "test_value", sizes, increasing=False)


_BAND = (
    ", band AS (SELECT experiment, target, n_target, quantile_cont(v, 0.1) AS q10, median(v) AS median, quantile_cont(v, 0.9) AS q90, stddev_pop(v) AS sd "
    "FROM q GROUP BY experiment, target, n_target) "
)


def _band(spark, sf, **kw):
    return cu.curve_band(_mse(spark, sf), ["experiment", "target"], "test_value", **kw)


@query(
    "v03_curve_band",
    with_roles("curves") + _MSE + _BAND
    + "SELECT experiment, target, n_target, round(q10, 6) AS q10, round(median, 6) AS median, round(q90, 6) AS q90, round(sd, 6) AS sd FROM band",
)
def _(spark, sf):
    b = _band(spark, sf)
    return b.select("experiment", "target", "n_target", *[r6(c).alias(c) for c in ("q10", "median", "q90", "sd")])


_CROSS = (
    "(SELECT {keys}, CASE WHEN f IS NULL THEN 'inf'::DOUBLE WHEN f = 1 THEN '-inf'::DOUBLE ELSE t0 - x0 * (t - t0) / (x - x0) END AS crossing FROM "
    "(SELECT {keys}, min(i) FILTER (WHERE x < 0) AS f FROM {src} GROUP BY {keys}) LEFT JOIN (SELECT {keys}, i, t, x, lag(t) OVER w AS t0, lag(x) OVER w AS x0 "
    "FROM {src} WINDOW w AS (PARTITION BY {keys} ORDER BY i)) s USING ({keys}) WHERE f IS NULL AND s.i = 1 OR s.i = f)"
)


@query(
    "v04_find_intersection",
    with_roles("curves") + _MSE
    + ", s AS (SELECT experiment, target, seed, ln(n_target) AS t, v - 0.2175 AS x, row_number() OVER (PARTITION BY experiment, target, seed ORDER BY n_target) AS i FROM q) "
    + "SELECT experiment, target, seed, round(crossing, 5) AS crossing FROM " + _CROSS.format(keys="experiment, target, seed", src="s"),
)
def _(spark, sf):
    df = _mse(spark, sf).withColumns({"t": F.log("n_target"), "x": F.col("test_value") - 0.2175})
    return cu.find_intersection(df, _K, "t", "x", increasing=False).withColumn("crossing", r6("crossing", 5))


_CV = (
    ", cvv AS (SELECT target, avg(q90) AS cv FROM band WHERE experiment = 'n_samples' GROUP BY target) "
    ", j AS (SELECT a.target, a.n_target, ln(a.n_target) AS t, row_number() OVER (PARTITION BY a.target ORDER BY a.n_target) AS i, "
    "a.median - cv AS xa, b.median + 0.1 * b.sd - cv AS xb, a.median - b.median AS xc FROM band a JOIN band b ON a.target = b.target AND a.n_target = b.n_target "
    "AND a.experiment = 'n_samples' AND b.experiment = 'refit' JOIN cvv ON cvv.target = a.target), "
    "ja AS (SELECT target, t, i, xa AS x FROM j), jb AS (SELECT target, t, i, xb AS x FROM j), jc AS (SELECT target, t, i, xc AS x FROM j) "
)


@query(
    "v05_regimes",
    with_roles("curves") + _MSE + _BAND + _CV
    + "SELECT target, round(exp(a.crossing), 4) AS cv_vs_n_samples, round(CASE WHEN exp(b.crossing) = 0 THEN lo ELSE exp(b.crossing) END, 4) AS cv_vs_refit, "
    "round(least(exp(c.crossing), 4 * hi), 4) AS n_samples_vs_refit FROM " + _CROSS.format(keys="target", src="ja") + " a JOIN "
    + _CROSS.format(keys="target", src="jb") + " b USING (target) JOIN " + _CROSS.format(keys="target", src="jc")
    + " c USING (target) JOIN (SELECT target, min(n_target) AS lo, max(n_target) AS hi FROM band GROUP BY target) USING (target)",
)
def _(spark, sf):
    b = _band(spark, sf)
    n, r = b.where("experiment = 'n_samples'"), b.where("experiment = 'refit'")
    cv = n.groupBy("target").agg(F.avg("q90").alias("cv"))
    out = cu.regimes(n, r, cv, ["target"], "mse")
    return out.select("target", *[r6(c, 4).alias(c) for c in out.columns if c != "target"])


_EQ = (
    ", vals AS (SELECT target, avg(v) AS from_value, min(v) AS to_value FROM q WHERE experiment = 'refit' GROUP BY target) "
    ", c AS (SELECT target, seed, i, fit AS v, ln(n_target) AS l, count(*) OVER (PARTITION BY target, seed) AS m FROM iso WHERE experiment = 'n_samples'), "
    "ends AS (SELECT target, seed, min(l) AS l0, max(l) AS l1, max(v) AS v0, min(v) AS v1, "
    "regr_slope(l, v) FILTER (WHERE i <= 6) AS a0, regr_intercept(l, v) FILTER (WHERE i <= 6) AS b0, var_pop(v) FILTER (WHERE i <= 6) AS s0, "
    "regr_slope(l, v) FILTER (WHERE i > m - 6) AS a1, regr_intercept(l, v) FILTER (WHERE i > m - 6) AS b1, var_pop(v) FILTER (WHERE i > m - 6) AS s1 "
    "FROM c GROUP BY target, seed), "
    "ext AS (SELECT target, seed, CAST(i AS DOUBLE) AS i, v, l FROM c UNION ALL "
    "SELECT target, seed, 0, (l0 - 4 - b0) / a0, l0 - 4 FROM ends WHERE s0 > 1e-18 AND (l0 - 4 - b0) / a0 > v0 UNION ALL "
    "SELECT target, seed, 1e6, (l1 + 4 - b1) / a1, l1 + 4 FROM ends WHERE s1 > 1e-18 AND (l1 + 4 - b1) / a1 < v1), "
    "seg AS (SELECT target, seed, v, l, lead(v) OVER w AS v2, lead(l) OVER w AS l2 FROM ext WINDOW w AS (PARTITION BY target, seed ORDER BY i)), "
    "lim AS (SELECT target, seed, arg_min(v, i) AS vf, min(l) AS lf, arg_max(v, i) AS vb, max(l) AS lb FROM ext GROUP BY target, seed), "
    "ask AS (SELECT target, seed, unnest(['from', 'to']) AS which, unnest([from_value, to_value]) AS x, vf, lf, vb, lb FROM lim JOIN vals USING (target)), "
    "eq AS (SELECT a.target, a.seed, a.which, exp(CASE WHEN any_value(x) >= any_value(vf) THEN any_value(lf) WHEN any_value(x) < any_value(vb) THEN any_value(lb) ELSE "
    "min(CASE WHEN x BETWEEN v2 AND v THEN CASE WHEN v = v2 THEN l ELSE l + (x - v) / (v2 - v) * (l2 - l) END END) END) AS n "
    "FROM ask a JOIN seg s USING (target, seed) GROUP BY a.target, a.seed, a.which) "
)


def _equivalents(spark, sf):
    df = _mse(spark, sf)
    n = df.where("experiment = 'n_samples'")
    values = df.where("experiment = 'refit'").groupBy("target").agg(
        F.avg("test_value").alias("from_value"), F.min("test_value").alias("to_value")
    )
    seeds = n.select("target", "seed").distinct().join(values, "target")
    wanted = {"from_value": "from_equiv", "to_value": "to_equiv"}
    return cu.equivalent_n(n, seeds, ["target", "seed"], wanted, "mse")


@query(
    "v06_equivalent_n",
    with_roles("curves") + _MSE + _ISO + _EQ
    + "SELECT target, seed, round(ln(max(n) FILTER (WHERE which = 'from')), 4) + 0.0 AS log_from, round(ln(max(n) FILTER (WHERE which = 'to')), 4) + 0.0 AS log_to FROM eq GROUP BY target, seed",
)
def _(spark, sf):
    e = _equivalents(spark, sf)
    return e.select("target", "seed", r6(F.log("from_equiv"), 4).alias("log_from"), r6(F.log("to_equiv"), 4).alias("log_to"))


@query(
    "v07_invert_curve",
    with_roles("curves", "results") + _MSE + _BAND
    + ", b AS (SELECT target, median AS v, ln(n_target) AS l, lead(median) OVER w AS v2, lead(ln(n_target)) OVER w AS l2 FROM band WHERE experiment = 'n_samples' WINDOW w AS (PARTITION BY target ORDER BY n_target)), "
    "a AS (SELECT target, round(0.2 + CAST(range AS DOUBLE) / 200, 6) AS value FROM (SELECT DISTINCT target FROM band), range(12)) "
    "SELECT a.target, a.value, round(exp(max(CASE WHEN value BETWEEN least(v, v2) AND greatest(v, v2) THEN CASE WHEN v = v2 THEN l2 ELSE l + (value - v) / (v2 - v) * (l2 - l) END END)), 4) AS n_equivalent "
    "FROM a JOIN b USING (target) GROUP BY a.target, a.value",
)
def _(spark, sf):
    band = _band(spark, sf).where("experiment = 'n_samples'")
    steps = F.explode(F.array(*[F.lit(round(0.2 + k / 200, 6)) for k in range(12)])).alias("value")
    asked = band.select("target").distinct().select("target", steps)
    out = cu.invert_curve(band, asked, ["target"], "value")
    return out.select("target", "value", r6("n_equivalent", 4).alias("n_equivalent"))


@query(
    "v08_improvement",
    with_roles("curves") + _MSE + _ISO + _EQ
    + ", pct AS (SELECT target, 100 * (max(n) FILTER (WHERE which = 'to') / max(n) FILTER (WHERE which = 'from')) - 100 AS p FROM eq GROUP BY target, seed), "
    "k AS (SELECT *, row_number() OVER (PARTITION BY target ORDER BY p) - 1 AS i, count(*) OVER (PARTITION BY target) AS n FROM pct) "
    "SELECT target, round(max(p) FILTER (WHERE i = round((n - 1) * 0.2)), 2) AS \"20%\", round(median(p), 2) AS median, round(max(p) FILTER (WHERE i = round((n - 1) * 0.8)), 2) AS \"80%\" FROM k GROUP BY target",
)
def _(spark, sf):
    out = cu.improvement(_equivalents(spark, sf), ["target"])
    return out.select("target", *[F.round(F.col(f"`{c}`"), 2).alias(c) for c in ("20%", "median", "80%")])


@query(
    "v09_size_filter",
    with_roles("curves") + _MSE + _BAND
    + "SELECT experiment, target, n_target, round(median, 6) AS median FROM band WHERE n_target IN (10, 20, 40, 160) AND n_target BETWEEN 10 AND 80",
)
def _(spark, sf):
    b = _band(spark, sf, sizes=[s for s in CURVE_SIZES if s in (10, 20, 40, 160)], xlim=(10, 80))
    return b.select("experiment", "target", "n_target", r6("median").alias("median"))
