"""Moments, anchor projections, linear model grids and boosted trees."""

from __future__ import annotations

from pyspark.sql import functions as F

from ..functions.bounded import local_table
from ..operators import anchors as a
from ..operators import linear as lin
from ..operators import moments as mo
from ..operators import trees
from ..plans import study
from .boosting_sql import boosting, refit
from .descent_sql import descent, logistic, matrix, scaled, vector
from .registry import query
from .roles import FEATURES, ROW_ID, binary, kept, r6, reg, reg_null, table, with_roles

_ID = ", ".join(ROW_ID)
_COLS = ["x_qty", "x_disc", "x_tax", "y"]


def _pairs_sql(role: str, weight: str = "1") -> str:
    parts = []
    for i, u in enumerate(_COLS):
        for j in range(i, len(_COLS)):
            v = _COLS[j]
            parts.append(
                f"SELECT dataset, {i} AS i, {j} AS j, round(sum({weight}), 4) AS n, round(sum({weight} * {u}) / sum({weight}), 6) AS mi, "
                f"round(sum({weight} * {v}) / sum({weight}), 6) AS mj, round(sum({weight} * {u} * {v}) / sum({weight}), 6) AS mij "
                f"FROM {role} WHERE {u} IS NOT NULL AND {v} IS NOT NULL GROUP BY dataset"
            )
    return " UNION ALL ".join(parts)


def _recursive(role):
    return with_roles(role).replace("WITH ", "WITH RECURSIVE ", 1) + ", "


def _stages_sql(rounds, depth=3):
    cols = ", ".join(f"round(avg((y - score) ** 2) FILTER (step = {k * depth}), 6) + 0.0 AS mse_{k}" for k in rounds)
    return f" SELECT dataset, split, count(DISTINCT rid) AS n, {cols} FROM b0 JOIN st USING (rid) GROUP BY dataset, split"


def _means(m):
    n = F.col("n")
    return m.select(
        "dataset",
        "i",
        "j",
        r6(n, 4).alias("n"),
        r6(F.col("si") / n).alias("mi"),
        r6(F.col("sj") / n).alias("mj"),
        r6(F.col("cij") / n).alias("mij"),
    )


@query("m01_env_moments", with_roles("reg_null") + _pairs_sql("reg_null", "1.0::DOUBLE"))
def _(spark, sf):
    return _means(mo.env_moments(reg_null(spark, sf), _COLS))


@query(
    "m01_env_moments_large",
    "WITH x AS (SELECT vec_id, label, embedding, list_sum([CAST(e AS DOUBLE) * ((i - 1) % 5 - 2) FOR e, i IN embedding]) AS y FROM embeddings), "
    "v AS (SELECT vec_id, label, CAST(unnest(range(64)) AS INTEGER) AS i, CAST(unnest(embedding) AS DOUBLE) AS e FROM x "
    "UNION ALL SELECT vec_id, label, 64, y FROM x) "
    "SELECT p.label, p.i, q.i AS j, CAST(count(*) AS DOUBLE) AS n, round(avg(p.e * q.e), 6) + 0.0 AS mij FROM v p JOIN v q ON p.vec_id = q.vec_id AND p.i <= q.i "
    "GROUP BY p.label, p.i, q.i",
)
def _(spark, sf):
    emb = table(spark, sf, "embeddings")
    x = [F.col("embedding")[i].cast("double").alias(f"x{i}") for i in range(64)]
    wide = emb.select("label", *x)
    y = sum((F.col(f"x{i}") * (i % 5 - 2) for i in range(64)), F.lit(0.0))
    m = mo.env_moments(wide.withColumn("y", y), [*[f"x{i}" for i in range(64)], "y"], ["label"])
    return m.select("label", "i", "j", "n", r6(F.col("cij") / F.col("n")).alias("mij"))


@query(
    "m02_project_groups",
    with_roles("reg")
    + f"SELECT {_ID}, dataset, ward, round(avg(x_qty) OVER w - (SELECT avg(x_qty) FROM reg), 6) + 0.0 AS x_qty_proj, "
    "round(avg(y) OVER w - (SELECT avg(y) FROM reg), 6) + 0.0 AS y_proj FROM reg WINDOW w AS (PARTITION BY dataset, ward)",
)
def _(spark, sf):
    df = kept(reg(spark, sf), *ROW_ID, "dataset", "ward", "x_qty", "y")
    out = mo.project_groups(df, ["x_qty", "y"], ["dataset", "ward"])
    return out.select(*ROW_ID, "dataset", "ward", r6("x_qty_proj").alias("x_qty_proj"), r6("y_proj").alias("y_proj"))


@query(
    "m02_project_patients",
    with_roles("reg")
    + f"SELECT {_ID}, round(avg(y) OVER (PARTITION BY dataset, patient_id) - (SELECT avg(y) FROM reg), 6) + 0.0 AS y_proj FROM reg",
)
def _(spark, sf):
    df = kept(reg(spark, sf), *ROW_ID, "dataset", "patient_id", "y")
    out = mo.project_groups(df, ["y"], ["dataset", "patient_id"])
    return out.select(*ROW_ID, r6("y_proj").alias("y_proj"))


@query(
    "m03_project_design",
    with_roles("reg")
    + f"SELECT {_ID}, round(avg(y) OVER (PARTITION BY dataset, ward) - (SELECT avg(y) FROM reg), 6) + 0.0 AS y_proj, "
    "round(avg(x_tax) OVER (PARTITION BY dataset, ward) - (SELECT avg(x_tax) FROM reg), 6) + 0.0 AS x_tax_proj FROM reg",
)
def _(spark, sf):
    """A saturated factor design: its projection is the cell mean."""
    df = kept(reg(spark, sf), *ROW_ID, "dataset", "ward", "y", "x_tax")
    df, _ = a.sparse_design(df, [a.C("ward")])
    out = mo.project_terms(df, ["y", "x_tax"])
    return out.select(*ROW_ID, r6("y_proj").alias("y_proj"), r6("x_tax_proj").alias("x_tax_proj"))


@query(
    "m04_anchor_transform",
    with_roles("reg")
    + f"SELECT {_ID}, "
    + ", ".join(
        f"round(m{i} + 0.5 * ({c} - m{i}) + 0.5 * (avg({c}) OVER (PARTITION BY dataset) - m{i}), 6) AS {c}_anchor"
        for i, c in enumerate(["x_qty", "y"])
    )
    + " FROM reg, (SELECT avg(x_qty) AS m0, avg(y) AS m1 FROM reg)",
)
def _(spark, sf):
    df = kept(reg(spark, sf), *ROW_ID, "dataset", "x_qty", "y")
    out = mo.anchor_transform(df, ["x_qty", "y"], ["dataset"], 4.0)
    return out.select(*ROW_ID, r6("x_qty_anchor").alias("x_qty_anchor"), r6("y_anchor").alias("y_anchor"))


def _moments(spark, sf, features, y="y", df=None):
    df = reg(spark, sf) if df is None else df
    cols = [*features, y]
    return lin.Moments.gather(df, cols)


_P = len(FEATURES)
_SCALED = scaled("reg_null", FEATURES)
_TOTAL = matrix(lambda i, j: f"covar_pop(z{i}, z{j})", _P, _P + 1)
# Columns of a result: intercept and slopes on the raw columns.
_SLOPES = ", ".join(f"round(b[{i + 1}] / s{i}, 6) + 0.0 AS b_{c}" for i, c in enumerate(FEATURES))
_RAW = " - ".join([f"a{_P}", *(f"b[{i + 1}] * a{i}" for i in range(_P)), *(f"b[{i + 1}] / s{i} * m{i}" for i in range(_P))])


def _grid(name, values):
    return f"(SELECT unnest({list(values)}::DOUBLE[]) AS {name})"


_PARAMS = ("alpha", "gamma", "l1_ratio", "ratio", "l2_ratio")


def _table(spark, models, names=("x_qty",)):
    """Coefficients as rows: one per model."""
    used = [p for p in _PARAMS if p in models[0].params]
    rows = [
        {
            **{p: float(m.params[p]) for p in used},
            "intercept": round(m.intercept, 6) + 0.0,
            **{f"b_{n}": round(float(b), 6) + 0.0 for n, b in zip(names, m.coef)},
        }
        for m in models
    ]
    schema = ", ".join(f"{c} double" for c in rows[0])
    return local_table(spark, rows, schema)


# One feature: the elastic net is a soft threshold of the standardised slope.
_ONE = (
    ", t AS (SELECT avg(x_qty) AS mx, stddev_pop(x_qty) AS sx, avg(y) AS my, covar_pop(x_qty, y) AS cxy FROM reg), "
    "grid AS (SELECT alpha, l1_ratio FROM (SELECT unnest([1.0, 0.1, 0.01, 0.0]::DOUBLE[]) AS alpha), "
    "(SELECT unnest([0.0, 0.5, 1.0]::DOUBLE[]) AS l1_ratio)), "
)


@query(
    "m05_elastic_net_path",
    with_roles("reg")
    + _ONE
    + "fit AS (SELECT alpha, l1_ratio, sign(cxy) * greatest(abs(cxy / sx) - alpha * l1_ratio, 0) / (1 + alpha * (1 - l1_ratio)) / sx AS b, mx, my "
    "FROM grid, t) SELECT alpha, l1_ratio, round(my - b * mx, 6) AS intercept, round(b, 6) + 0.0 AS b_x_qty FROM fit",
)
def _(spark, sf):
    m = _moments(spark, sf, ["x_qty"])
    return _table(spark, [f for l1 in (0.0, 0.5, 1.0) for f in lin.fit_linear(m, [1.0, 0.1, 0.01, 0.0], l1)])


@query(
    "m05_least_squares",
    with_roles("reg")
    + ", s AS (SELECT var_pop(x_qty) AS a, covar_pop(x_qty, x_disc) AS b, var_pop(x_disc) AS d, covar_pop(x_qty, y) AS e, "
    "covar_pop(x_disc, y) AS f, avg(x_qty) AS mq, avg(x_disc) AS md, avg(y) AS my FROM reg), "
    "c AS (SELECT (e * d - b * f) / (a * d - b * b) AS b1, (a * f - b * e) / (a * d - b * b) AS b2, mq, md, my FROM s) "
    "SELECT 0.0::DOUBLE AS alpha, 0.0::DOUBLE AS l1_ratio, round(my - b1 * mq - b2 * md, 6) AS intercept, round(b1, 6) AS b_x_qty, round(b2, 6) AS b_x_disc FROM c",
)
def _(spark, sf):
    m = _moments(spark, sf, ["x_qty", "x_disc"])
    return _table(spark, lin.fit_linear(m, [0.0], 0.0), ["x_qty", "x_disc"])


_ALPHAS = [0.5 * 10 ** (-k / 2) for k in range(7)]
_L1S = (0.01, 0.5, 1.0)


@query(
    "m05_elastic_net_grid",
    _recursive("reg_null")
    + f"{_SCALED}, tt AS (SELECT {_TOTAL} AS t FROM z), "
    + f"pr AS (SELECT row_number() OVER () AS id, alpha, l1, [e[1:{_P}] FOR e IN t] AS g, [e[{_P + 1}] FOR e IN t] AS c, "
    + f"{vector(lambda i: '1.0::DOUBLE', _P)} AS f FROM tt, {_grid('alpha', _ALPHAS)}, {_grid('l1', _L1S)}), "
    + descent(60)
    + f" SELECT alpha, l1 AS l1_ratio, round({_RAW}, 6) + 0.0 AS intercept, {_SLOPES} FROM cd JOIN pr USING (id), sc, mo",
)
def _(spark, sf):
    m = _moments(spark, sf, FEATURES, df=reg_null(spark, sf))
    return _table(spark, lin.in_tasks(spark, _L1S, lambda l1: lin.fit_linear(m, _ALPHAS, l1)), FEATURES)


@query(
    "m06_logistic_constant",
    with_roles("bin")
    + "SELECT unnest([0.1, 0.01]::DOUBLE[]) AS alpha, 0.0::DOUBLE AS l1_ratio, round(ln(count(*)), 6) AS intercept, 0.0::DOUBLE AS b_x_qty FROM bin WHERE y = 1",
)
def _(spark, sf):
    only = binary(spark, sf).where("y = 1")
    return _table(spark, lin.fit_logistic(only, ["x_qty"], "y", [0.1, 0.01]))


@query(
    "m06_logistic_null_model",
    with_roles("bin")
    + "SELECT 10.0::DOUBLE AS alpha, 1.0::DOUBLE AS l1_ratio, round(ln(avg(y) / (1 - avg(y))), 6) AS intercept, 0.0::DOUBLE AS b_x_qty, 0.0::DOUBLE AS b_x_disc FROM bin",
)
def _(spark, sf):
    df = kept(binary(spark, sf), "x_qty", "x_disc", "y")
    fits = lin.fit_logistic(df, ["x_qty", "x_disc"], "y", [10.0], 1.0)
    return _table(spark, fits, ["x_qty", "x_disc"])


@query(
    "m06_logistic_path",
    _recursive("reg")
    + f"{scaled('reg', FEATURES)}, rw AS MATERIALIZED (SELECT {', '.join(f'z{i} AS x{i + 1}' for i in range(_P))}, (z{_P} > 10.5)::INT::DOUBLE AS y, 0.0::DOUBLE AS o FROM z), "
    + f"lg_pr AS (SELECT row_number() OVER () AS id, alpha, 0.5::DOUBLE AS l1 FROM {_grid('alpha', [0.1, 0.01, 0.001])}), "
    + logistic("rw", _P, "lg")
    + f" SELECT alpha, l1 AS l1_ratio, round(a, 6) + 0.0 AS intercept, {', '.join(f'round(b[{i + 1}], 6) + 0.0 AS b_{c}' for i, c in enumerate(FEATURES))} FROM lg JOIN lg_pr USING (id)",
)
def _(spark, sf):
    df = reg(spark, sf).withColumn("y", (F.col("y") > 10.5).cast("double"))
    from ..operators.preprocess import LinearPreprocessing

    df = kept(df, *FEATURES, "y")
    prep = LinearPreprocessing(FEATURES).fit(df)
    fits = lin.fit_logistic(prep.transform(df), FEATURES, "y", [0.1, 0.01, 0.001], 0.5)
    return _table(spark, fits, FEATURES)


@query(
    "m07_anchor_path",
    with_roles("reg")
    + ", t AS (SELECT avg(x_qty) AS mx, stddev_pop(x_qty) AS sx, avg(y) AS my, count(*) AS n FROM reg), "
    "g AS (SELECT count(*) AS ng, avg(x_qty) AS gx, avg(y) AS gy FROM reg GROUP BY dataset), "
    "b AS (SELECT sum(ng * (gx - mx) * (gx - mx)) / any_value(n) / any_value(sx * sx) AS bxx, sum(ng * (gx - mx) * (gy - my)) / any_value(n) / any_value(sx) AS bxy FROM g, t), "
    "v AS (SELECT 1.0 AS xx, covar_pop(x_qty, y) / stddev_pop(x_qty) AS xy FROM reg), "
    "p AS (SELECT * FROM (SELECT unnest([1.0, 4.0, 256.0]::DOUBLE[]) AS gamma), (SELECT unnest([0.1, 0.001]::DOUBLE[]) AS alpha), (SELECT unnest([0.01, 1.0]::DOUBLE[]) AS l1_ratio)), "
    "k AS (SELECT gamma, alpha, l1_ratio, (xx - bxx) / gamma + bxx AS gxx, (xy - bxy) / gamma + bxy AS gxy, sx, mx, my FROM p, b, v, t), "
    "f AS (SELECT *, sign(gxy) * greatest(abs(gxy) - alpha * l1_ratio, 0) / (gxx + alpha * (1 - l1_ratio)) / sx AS slope FROM k) "
    "SELECT gamma, alpha, l1_ratio, round(my - slope * mx, 6) AS intercept, round(slope, 6) + 0.0 AS b_x_qty FROM f",
)
def _(spark, sf):
    m = _moments(spark, sf, ["x_qty"])
    return _table(spark, lin.fit_anchor(m, [1.0, 4.0, 256.0], [0.1, 0.001], [0.01, 1.0]))


_GAMMAS = [2 ** (k / 2) for k in range(17)]


@query(
    "m07_anchor_grid",
    _recursive("reg_null")
    + f"{_SCALED}, tt AS (SELECT {_TOTAL} AS t FROM z), "
    + f"gm AS (SELECT count(*) AS ng, {', '.join(f'avg(z{i}) AS g{i}' for i in range(_P + 1))} FROM z GROUP BY dataset), "
    + f"bb AS (SELECT {matrix(lambda i, j: f'sum(ng * (g{i} - a{i}) * (g{j} - a{j})) / any_value(n)', _P, _P + 1)} AS w FROM gm, mo), "
    + f"mx AS (SELECT gamma, {matrix(lambda i, j: f'(t[{i + 1}][{j + 1}] - w[{i + 1}][{j + 1}]) / gamma + w[{i + 1}][{j + 1}]', _P, _P + 1)} AS t FROM tt, bb, {_grid('gamma', _GAMMAS)}), "
    + f"pr AS (SELECT row_number() OVER () AS id, gamma, alpha, l1, [e[1:{_P}] FOR e IN t] AS g, [e[{_P + 1}] FOR e IN t] AS c, "
    + f"{vector(lambda i: '1.0::DOUBLE', _P)} AS f FROM mx, {_grid('alpha', [0.1, 0.01, 0.001])}, {_grid('l1', _L1S)}), "
    + descent(60)
    + f" SELECT alpha, gamma, l1 AS l1_ratio, round({_RAW}, 6) + 0.0 AS intercept, {_SLOPES} FROM cd JOIN pr USING (id), sc, mo",
)
def _(spark, sf):
    m = _moments(spark, sf, FEATURES, df=reg_null(spark, sf))
    return _table(spark, lin.in_tasks(spark, _GAMMAS, lambda g: lin.fit_anchor(m, [g], [0.1, 0.01, 0.001], _L1S)), FEATURES)


_REGIONS = ["AFRICA", "AMERICA", "ASIA", "EUROPE", "MIDDLE EAST"]
_D = len(_REGIONS)
# Interacted columns in full: shared, indicators, deviations centred within their dataset.
_WIDE = [f"z{i}" for i in range(_P)] + [f"(dataset = '{d}')::INT::DOUBLE" for d in _REGIONS]
_WIDE += [f"CASE WHEN dataset = '{d}' THEN z{i} - avg(z{i}) OVER (PARTITION BY dataset) ELSE 0.0::DOUBLE END" for d in _REGIONS for i in range(_P)]
_K = len(_WIDE)


@query(
    "m08_data_shared",
    _recursive("reg")
    + f"{scaled('reg', FEATURES)}, v AS MATERIALIZED (SELECT z{_P} AS y, {', '.join(f'{x} AS v{i}' for i, x in enumerate(_WIDE))} FROM z), "
    + f"gs AS MATERIALIZED (SELECT {matrix(lambda i, j: f'covar_pop(v{i}, v{j})', _K, _K)} AS g, {vector(lambda i: f'covar_pop(v{i}, y)', _K)} AS c, "
    + f"{vector(lambda i: f'avg(v{i})', _K)} AS mv, {vector(lambda i: f'sqrt(avg(v{_P + i}))', _D)} AS r FROM v), "
    + "pr AS MATERIALIZED (SELECT row_number() OVER () AS id, ratio, alpha, 1.0::DOUBLE AS l1, g, c, mv, "
    + f"list_concat({vector(lambda i: '1.0::DOUBLE', _P)}, list_concat([e * ratio FOR e IN r], {vector(lambda i: f'r[{i // _P + 1}] * ratio', _D * _P)})) AS f "
    + f"FROM gs, {_grid('ratio', [0.5, 1.0, 2.0])}, {_grid('alpha', [0.1, 0.01, 0.001])}), "
    + descent(150)
    + f" SELECT alpha, l1 AS l1_ratio, ratio, round(a{_P} - list_inner_product(b, mv) - ({' + '.join(f'b[{i + 1}] / s{i} * m{i}' for i in range(_P))}), 6) + 0.0 AS intercept, "
    + f"{_SLOPES} FROM cd JOIN pr USING (id), sc, mo",
)
def _(spark, sf):
    m = _moments(spark, sf, FEATURES)
    fits = lin.in_tasks(spark, (0.5, 1.0, 2.0), lambda ratio: lin.fit_data_shared(m, ratio, [0.1, 0.01, 0.001], 1.0))
    return _table(spark, fits, FEATURES)


@query(
    "m09_anticausal",
    with_roles("reg")
    + ", t AS (SELECT avg(x_qty) AS mx, stddev_pop(x_qty) AS sx, avg(y) AS my, count(*) AS n, covar_pop(x_qty, y) AS cxy FROM reg), "
    "d AS (SELECT greatest(sum(ng * (gx - mx) * (gx - mx)) / any_value(sx * sx) / (any_value(n) - 1), 1e-10) AS d FROM "
    "(SELECT count(*) AS ng, avg(x_qty) AS gx FROM reg GROUP BY dataset), t), "
    "p AS (SELECT * FROM (SELECT unnest([0.0, 0.01]::DOUBLE[]) AS l2_ratio), (SELECT unnest([0.1, 0.01]::DOUBLE[]) AS alpha)), "
    "f AS (SELECT alpha, l2_ratio, cxy / sx / (1 + alpha * 100 * (d + 100 * l2_ratio)) / sx AS b, mx, my FROM p, t, d) "
    "SELECT alpha, l2_ratio, round(my - b * mx, 6) AS intercept, round(b, 6) AS b_x_qty FROM f",
)
def _(spark, sf):
    return _table(spark, lin.fit_anticausal(_moments(spark, sf, ["x_qty"]), [0.0, 0.01], [0.1, 0.01]))


@query(
    "m09_anticausal_grid",
    _recursive("reg")
    + f"{scaled('reg', FEATURES)}, tt AS (SELECT {_TOTAL} AS t FROM z), "
    + f"gm AS (SELECT count(*) AS ng, {', '.join(f'avg(z{i}) AS g{i}' for i in range(_P))} FROM z GROUP BY dataset), "
    + f"bb AS (SELECT {matrix(lambda i, j: f'sum(ng * (g{i} - a{i}) * (g{j} - a{j})) / (any_value(n) - 1)', _P, _P)} AS w FROM gm, mo), "
    # The ridge in the rotated basis is a quadratic form of the between-dataset covariance in this one.
    + "pr AS (SELECT row_number() OVER () AS id, l2, alpha AS penalty, 0.0::DOUBLE AS alpha, 1.0::DOUBLE AS l1, "
    + f"{matrix(lambda i, j: f't[{i + 1}][{j + 1}] + alpha * 100 * (w[{i + 1}][{j + 1}] + {100 if i == j else 0} * l2)', _P, _P)} AS g, "
    + f"[e[{_P + 1}] FOR e IN t] AS c, {vector(lambda i: '0.0::DOUBLE', _P)} AS f "
    + f"FROM tt, bb, {_grid('l2', [0.0, 0.001, 0.01, 0.1])}, {_grid('alpha', [0.1, 0.01, 0.001])}), "
    + descent(60)
    + f" SELECT penalty AS alpha, l2 AS l2_ratio, round({_RAW}, 6) + 0.0 AS intercept, {_SLOPES} FROM cd JOIN pr USING (id), sc, mo",
)
def _(spark, sf):
    m = _moments(spark, sf, FEATURES)
    fits = lin.in_tasks(spark, (0.0, 0.001, 0.01, 0.1), lambda l2: lin.fit_anticausal(m, [l2], [0.1, 0.01, 0.001]))
    return _table(spark, fits, FEATURES)


@query(
    "m10_weighted_moments",
    with_roles("reg") + _pairs_sql("reg", "sqrt(x_qty)"),
)
def _(spark, sf):
    df = reg(spark, sf).withColumn("w", F.sqrt("x_qty"))
    return _means(mo.env_moments(df, _COLS, weight="w"))


# Weighted covariances: the weights of all rows add up to one.
_WEIGHTED = "w0 AS MATERIALIZED (SELECT *, sqrt(x_qty) / (SELECT sum(sqrt(x_qty)) FROM {r}) AS w FROM {r}), "


def _wcov(a, b):
    return f"sum(w * {a} * {b}) - sum(w * {a}) * sum(w * {b})"


def _weighted(df):
    w = F.sqrt("x_qty")
    return df.withColumn("w", w / F.lit(df.agg(F.sum(w)).first()[0]))


@query(
    "m10_weighted_elastic_net",
    _recursive("reg_null")
    + _WEIGHTED.format(r="reg_null")
    + scaled("w0", FEATURES).replace(f"y AS z{_P} FROM w0", f"y AS z{_P}, w FROM w0")
    + f", pr AS (SELECT row_number() OVER () AS id, alpha, l1, g, c, f, mz FROM (SELECT {matrix(lambda i, j: _wcov(f'z{i}', f'z{j}'), _P, _P)} AS g, "
    + f"{vector(lambda i: _wcov(f'z{i}', f'z{_P}'), _P)} AS c, {vector(lambda i: '1.0::DOUBLE', _P)} AS f, {vector(lambda i: f'sum(w * z{i})', _P + 1)} AS mz FROM z), "
    + f"{_grid('alpha', [0.1, 0.01])}, {_grid('l1', _L1S)}), "
    + descent(60)
    + f" SELECT alpha, l1 AS l1_ratio, round(mz[{_P + 1}] - list_inner_product(b, mz[1:{_P}]) - ({' + '.join(f'b[{i + 1}] / s{i} * m{i}' for i in range(_P))}), 6) + 0.0 AS intercept, "
    + f"{_SLOPES} FROM cd JOIN pr USING (id), sc",
)
def _(spark, sf):
    """Row weights count in the fit; imputation and scaling are without them."""
    m = lin.Moments.gather(_weighted(reg_null(spark, sf)), [*FEATURES, "y"], weight="w")
    return _table(spark, lin.in_tasks(spark, _L1S, lambda l1: lin.fit_linear(m, [0.1, 0.01], l1)), FEATURES)


_WWIDE = _WIDE[: _P + _D]
_WWIDE += [f"CASE WHEN dataset = '{d}' THEN z{i} - sum(w * z{i}) OVER d / sum(w) OVER d ELSE 0.0::DOUBLE END" for d in _REGIONS for i in range(_P)]


@query(
    "m08_weighted_data_shared",
    _recursive("reg")
    + _WEIGHTED.format(r="reg")
    + scaled("w0", FEATURES).replace(f"y AS z{_P} FROM w0", f"y AS z{_P}, w FROM w0")
    + f", v AS MATERIALIZED (SELECT w, z{_P} AS y, {', '.join(f'{x} AS v{i}' for i, x in enumerate(_WWIDE))} FROM z WINDOW d AS (PARTITION BY dataset)), "
    + f"gs AS MATERIALIZED (SELECT {matrix(lambda i, j: _wcov(f'v{i}', f'v{j}'), _K, _K)} AS g, {vector(lambda i: _wcov(f'v{i}', 'y'), _K)} AS c, "
    + f"{vector(lambda i: f'sum(w * v{i})', _K)} AS mv, sum(w * y) AS my, {vector(lambda i: f'sqrt(1 / sum(w * w) / sum(v{_P + i})) * sum(w * v{_P + i})', _D)} AS r FROM v), "
    + "pr AS MATERIALIZED (SELECT row_number() OVER () AS id, ratio, alpha, 1.0::DOUBLE AS l1, g, c, mv, my, "
    + f"list_concat({vector(lambda i: '1.0::DOUBLE', _P)}, list_concat([e * ratio FOR e IN r], {vector(lambda i: f'r[{i // _P + 1}] * ratio', _D * _P)})) AS f "
    + f"FROM gs, {_grid('ratio', [0.5, 2.0])}, {_grid('alpha', [0.1, 0.01])}), "
    + descent(150)
    + f" SELECT alpha, l1 AS l1_ratio, ratio, round(my - list_inner_product(b, mv) - ({' + '.join(f'b[{i + 1}] / s{i} * m{i}' for i in range(_P))}), 6) + 0.0 AS intercept, "
    + f"{_SLOPES} FROM cd JOIN pr USING (id), sc",
)
def _(spark, sf):
    df = _weighted(reg(spark, sf))
    m = lin.Moments.gather(df, [*FEATURES, "y"], weight="w")
    factors = lin.weighted_penalties(df, "w")
    fits = lin.in_tasks(spark, (0.5, 2.0), lambda ratio: lin.fit_data_shared(m, ratio, [0.1, 0.01], 1.0, penalties=factors))
    return _table(spark, fits, FEATURES)


def _prior(m):
    prior = lin.fit_linear(m, [0.1], 0.0, [("AFRICA",)])[0]
    return prior, m.scaling([("AFRICA",)])[1][:-1]


@query(
    "m11_refit_with_offset",
    with_roles("reg")
    + ", a AS (SELECT avg(x_qty) AS m0, stddev_pop(x_qty) AS s0, covar_pop(x_qty, y) / stddev_pop(x_qty) / 1.1 AS b0 FROM reg WHERE dataset = 'AFRICA'), "
    "n AS (SELECT avg(x_qty) AS mx, avg(y) AS my, var_pop(x_qty) AS vx, covar_pop(x_qty, y) AS cxy FROM reg WHERE dataset = 'ASIA'), "
    "f AS (SELECT alpha, (b0 + (cxy / s0 - b0 * vx / (s0 * s0)) / (vx / (s0 * s0) + alpha)) / s0 AS b, mx, my FROM a, n, (SELECT unnest([10.0, 1.0, 0.01]::DOUBLE[]) AS alpha)) "
    "SELECT alpha, 0.0::DOUBLE AS l1_ratio, round(my - b * mx, 6) AS intercept, round(b, 6) AS b_x_qty FROM f",
)
def _(spark, sf):
    m = _moments(spark, sf, ["x_qty"])
    prior, scale = _prior(m)
    return _table(spark, lin.fit_with_offset(m, prior, scale, [10.0, 1.0, 0.01], envs=[("ASIA",)]))


@query(
    "m11_logistic_offset",
    _recursive("reg")
    + "r0 AS MATERIALIZED (SELECT x_qty AS x1, x_disc AS x2, (y > 10.5)::INT::DOUBLE AS y, 0.0::DOUBLE AS o FROM reg WHERE dataset = 'AFRICA'), "
    + "p0_pr AS (SELECT 1 AS id, 0.01::DOUBLE AS alpha, 0.0::DOUBLE AS l1), "
    + logistic("r0", 2, "p0")
    + ", r1 AS MATERIALIZED (SELECT x_qty AS x1, x_disc AS x2, (y > 10.5)::INT::DOUBLE AS y, a + b[1] * x_qty + b[2] * x_disc AS o FROM reg, p0 WHERE dataset = 'ASIA'), "
    + f"p1_pr AS (SELECT row_number() OVER () AS id, alpha, 0.0::DOUBLE AS l1 FROM {_grid('alpha', [1.0, 0.01])}), "
    + logistic("r1", 2, "p1")
    + " SELECT alpha, l1 AS l1_ratio, round(a, 6) + 0.0 AS intercept, round(b[1], 6) + 0.0 AS b_x_qty, round(b[2], 6) + 0.0 AS b_x_disc FROM p1 JOIN p1_pr USING (id)",
)
def _(spark, sf):
    df = reg(spark, sf).withColumn("y", (F.col("y") > 10.5).cast("double"))
    df = kept(df, "dataset", "x_qty", "x_disc", "y")
    prior = lin.fit_logistic(df.where("dataset = 'AFRICA'"), ["x_qty", "x_disc"], "y", [0.01])
    chosen = lin.pick_alpha(prior, 0.01)
    new = df.where("dataset = 'ASIA'").withColumn("offset", chosen.predictor(["x_qty", "x_disc"]))
    return _table(spark, lin.fit_logistic(new, ["x_qty", "x_disc"], "y", [1.0, 0.01], offset="offset"), ["x_qty", "x_disc"])


@query(
    "m12_refit_intercept",
    with_roles("scored") + "SELECT dataset, model, round(avg(y) - avg(yhat), 6) AS \"offset\" FROM scored WHERE split = 'train_val' GROUP BY dataset, model",
)
def _(spark, sf):
    from .roles import scored

    out = lin.refit_intercept(scored(spark, sf).where("split = 'train_val'"), by=["dataset", "model"])
    return out.withColumn("offset", r6("offset"))


@query(
    "m13_passthrough",
    with_roles("reg")
    + f", p AS (SELECT regr_slope(y, x_qty) AS b, regr_intercept(y, x_qty) AS a FROM reg WHERE dataset = 'AFRICA') SELECT {_ID}, round(a + b * x_qty, 6) AS yhat FROM reg, p",
)
def _(spark, sf):
    m = _moments(spark, sf, ["x_qty"])
    prior = lin.fit_linear(m, [0.0], 0.0, [("AFRICA",)])[0]
    return lin.passthrough(reg(spark, sf), prior, ["x_qty"]).select(*ROW_ID, r6("yhat").alias("yhat"))


@query(
    "m14_ffill_predict",
    with_roles("grid")
    + "SELECT dataset, stay_id, time_h, round(coalesce(last_value(click IGNORE NULLS) OVER (PARTITION BY dataset, stay_id ORDER BY time_h "
    "ROWS BETWEEN UNBOUNDED PRECEDING AND CURRENT ROW), (SELECT avg(click) FROM grid)), 6) AS yhat FROM grid",
)
def _(spark, sf):
    from .roles import grid

    g = grid(spark, sf)
    mean_y = g.agg(F.avg("click")).first()[0]
    return lin.ffill_predict(g, "click", mean_y, keys=["dataset", "stay_id"]).select("dataset", "stay_id", "time_h", r6("yhat").alias("yhat"))


_TREE_FEATURES = ["x_qty", "x_disc", "x_tax", "x_line"]


def _stages(df, model, rounds):
    out = trees.predict(df, model, rounds)
    cols = [r6(F.avg((F.col("y") - F.col(f"yhat_{k}")) ** 2)).alias(f"mse_{k}") for k in rounds]
    return out.groupBy("dataset", "split").agg(F.count("*").alias("n"), *cols)


@query(
    "m15_boosted_trees",
    _recursive("reg_null") + boosting("reg_null", "split = 'train_val'", _TREE_FEATURES, 6, 0.3) + _stages_sql([1, 3, 6]),
)
def _(spark, sf):
    df = kept(reg_null(spark, sf), "dataset", "split", *_TREE_FEATURES, "y")
    model = trees.fit_gbt(df.where("split = 'train_val'"), _TREE_FEATURES, "y", rounds=6, learning_rate=0.3)
    return _stages(df, model, [1, 3, 6])


@query(
    "m15_weighted_trees",
    _recursive("reg_null")
    + boosting("reg_null", "split = 'train_val'", _TREE_FEATURES, 2, 0.3, 2, weight="sqrt(x_qty)")
    + _stages_sql([1, 2], 2),
)
def _(spark, sf):
    """Row weights count in the sums of splits and leaves."""
    df = kept(reg_null(spark, sf), "dataset", "split", *_TREE_FEATURES, "y").withColumn("w", F.sqrt("x_qty"))
    train = df.where("split = 'train_val'")
    return _stages(df, trees.fit_gbt(train, _TREE_FEATURES, "y", 2, 2, learning_rate=0.3, weight="w"), [1, 2])


@query(
    "m16_anchor_boosting",
    _recursive("reg") + boosting("reg", "split = 'train_val'", _TREE_FEATURES, 6, 0.3, gamma=4.0) + _stages_sql([1, 3, 6]),
)
def _(spark, sf):
    df = kept(reg(spark, sf), "dataset", "split", *_TREE_FEATURES, "y")
    model = trees.fit_anchor_boosting(
        df.where("split = 'train_val'"), _TREE_FEATURES, "y", 6, gamma=4.0, group=["dataset"], learning_rate=0.3
    )
    return _stages(df, model, [1, 3, 6])


_DECAYS = (0.0, 0.5, 1.0)
_MOVED = ", ".join(f"round(avg((y - rf.score) ** 2) FILTER (decay = {d}), 6) + 0.0 AS mse_decay_{int(d * 10)}" for d in _DECAYS)


@query(
    "m17_refit_leaves",
    _recursive("reg")
    + boosting("reg", "split = 'train_val' AND dataset <> 'ASIA'", _TREE_FEATURES, 4, 0.3)
    + ", "
    + refit(4, "dataset = 'ASIA' AND split = 'train_val'", 0.3, _DECAYS)
    + f" SELECT split, {_MOVED} FROM b0 JOIN rf USING (rid) WHERE tree = 4 AND dataset = 'ASIA' GROUP BY split",
)
def _(spark, sf):
    df = kept(reg(spark, sf), "dataset", "split", *_TREE_FEATURES, "y")
    train = df.where("split = 'train_val'")
    model = trees.fit_gbt(train.where("dataset <> 'ASIA'"), _TREE_FEATURES, "y", 4, learning_rate=0.3)
    new = train.where("dataset = 'ASIA'")
    out = df.where("dataset = 'ASIA'")
    for decay in _DECAYS:
        fitted = trees.refit_leaves(model, new, "y", decay)
        out = trees.predict(out, fitted, out=f"yhat_{int(decay * 10)}")
    cols = [r6(F.avg((F.col("y") - F.col(f"yhat_{k}")) ** 2)).alias(f"mse_decay_{k}") for k in (0, 5, 10)]
    return out.groupBy("split").agg(*cols)


@query("study_loeo_anchor")
def _(spark, sf):
    """All source subsets, anchor strengths and penalties from one pass, selected by LOEO-CV."""
    from ..operators.results import best_by, greater_is_better, loeo_cv

    res = study.loeo_study(
        reg(spark, sf), FEATURES, "y", gammas=[1.0, 2.0, 4.0, 16.0], alphas=[0.1, 0.01, 0.001], l1_ratios=[0.5]
    )
    params = ["gamma", "alpha", "l1_ratio"]
    best = best_by(loeo_cv(res, params, ["mse", "r2"]), ["eval_target", "metric"], "cv_value", greater_is_better(), params)
    return best.drop("sources")


@query("study_score_selected")
def _(spark, sf):
    """Every metric, projected ones included, of a few fitted models on all targets and splits."""
    df = kept(reg(spark, sf), "dataset", "split", "ward", *FEATURES, "y")
    m = study.study_moments(df, FEATURES, "y")
    names = sorted({e[0] for e in m.envs()})
    fits = study.fit_grid(m, [names, names[1:]], [1.0, 4.0], [0.01], [0.5])
    return study.score_study(df, FEATURES, "y", fits, group=["dataset", "ward"])
