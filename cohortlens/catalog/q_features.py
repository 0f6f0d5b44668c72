"""Feature and preprocessing queries over the hourly panel and the regression rows."""

from __future__ import annotations

from pyspark.sql import functions as F

from ..operators import anchors as a
from ..operators import features as f
from ..operators import preprocess as p
from .registry import query
from .roles import FEATURES, ROW_ID, grid, kept, r6, reg, reg_null, table, with_roles

_PANEL = ["dataset", "stay_id", "time_h"]
_ID = ", ".join(ROW_ID)


def _win(a: str) -> str:
    return f"(PARTITION BY dataset, stay_id ORDER BY time_h ROWS BETWEEN {a} AND CURRENT ROW)"


@query(
    "f01_ffill",
    with_roles("grid")
    + f"SELECT dataset, stay_id, time_h, round(last_value(click IGNORE NULLS) OVER {_win('UNBOUNDED PRECEDING')}, 6) "
    f"AS click_ffilled, round(last_value(view IGNORE NULLS) OVER {_win('UNBOUNDED PRECEDING')}, 6) AS view_ffilled FROM grid",
)
def _(spark, sf):
    out = f.ffill(grid(spark, sf), ["click", "view"])
    return out.select(*_PANEL, r6("click_ffilled").alias("click_ffilled"), r6("view_ffilled").alias("view_ffilled"))


@query(
    "f02_horizon_mean",
    with_roles("grid")
    + f"SELECT dataset, stay_id, time_h, round(avg(click) OVER {_win('7 PRECEDING')}, 6) AS click_mean_h8, "
    f"round(avg(click) OVER {_win('23 PRECEDING')}, 6) AS click_mean_h24 FROM grid",
)
def _(spark, sf):
    out = grid(spark, sf)
    for h in f.HORIZONS:
        out = f.horizon_mean(out, ["click"], h)
    return out.select(*_PANEL, *[r6(f"click_mean_h{h}").alias(f"click_mean_h{h}") for h in f.HORIZONS])


@query(
    "f03_all_missing",
    with_roles("grid")
    + f"SELECT dataset, stay_id, time_h, count(error) OVER {_win('7 PRECEDING')} = 0 AS error_all_missing_h8 FROM grid",
)
def _(spark, sf):
    return f.all_missing(grid(spark, sf), ["error"], 8).select(*_PANEL, "error_all_missing_h8")


@query(
    "f04_clip_bounds",
    with_roles("grid")
    + "SELECT dataset, stay_id, time_h, CASE WHEN click IS NOT NULL THEN round(least(greatest(click, 5.0), 150.0), 6) "
    "END AS click, CASE WHEN view IS NOT NULL THEN round(greatest(view, 20.0), 6) END AS view FROM grid",
)
def _(spark, sf):
    out = f.clip_bounds(grid(spark, sf), {"click": (5.0, 150.0), "view": (20.0, None)})
    return out.select(*_PANEL, r6("click").alias("click"), r6("view").alias("view"))


@query(
    "f05_log_transform",
    with_roles("obs")
    + "SELECT dataset, stay_id, time_h, concept, CASE WHEN value - 10 > 0 THEN round(ln(value - 10), 6) END AS value, "
    "round(ln(value + 0.1), 6) AS shifted FROM obs WHERE value > 0",
)
def _(spark, sf):
    from .roles import obs

    o = obs(spark, sf).where("value > 0").withColumn("shifted", F.col("value"))
    out = f.log_transform(o.withColumn("value", F.col("value") - 10), {"value": None, "shifted": 0.1})
    return out.withColumns({"value": r6("value"), "shifted": r6("shifted")})


@query(
    "f06_zero_to_null",
    with_roles("reg") + f"SELECT {_ID}, nullif(x_disc, 0) AS x_disc, nullif(x_tax, 0) AS x_tax FROM reg",
)
def _(spark, sf):
    return f.zero_to_null(reg(spark, sf), ["x_disc", "x_tax"]).select(*ROW_ID, "x_disc", "x_tax")


@query(
    "f07_fill_anchor_nulls",
    with_roles("reg")
    + f"SELECT {_ID}, CASE WHEN year % 3 = 0 THEN 2010 ELSE year END AS year, "
    "CASE WHEN adm = '5-LOW' THEN 'other' ELSE adm END AS adm, "
    "CASE WHEN flag = 'N' THEN false ELSE flag = 'R' END AS flag FROM reg",
)
def _(spark, sf):
    holes = reg(spark, sf).select(
        *ROW_ID,
        F.when(F.col("year") % 3 != 0, F.col("year")).alias("year"),
        F.nullif(F.col("adm"), F.lit("5-LOW")).alias("adm"),
        F.when(F.col("flag") != "N", F.col("flag") == "R").alias("flag"),
    )
    return f.fill_anchor_nulls(holes, ["year", "adm", "flag"])


@query(
    "f08_saturation_input",
    with_roles("grid")
    + f", t AS (SELECT dataset, stay_id, time_h, count(click) OVER {_win('7 PRECEDING')} = 0 AS miss, "
    f"avg(view) OVER {_win('7 PRECEDING')} AS m, last_value(click IGNORE NULLS) OVER {_win('UNBOUNDED PRECEDING')} AS c "
    "FROM grid) SELECT dataset, stay_id, time_h, round(coalesce(CASE WHEN miss THEN m ELSE c END, "
    "(SELECT avg(c) FROM t)), 6) AS sat FROM t",
)
def _(spark, sf):
    g = grid(spark, sf)
    g = f.all_missing(g, ["click"], 8)
    g = f.ffill(f.horizon_mean(g, ["view"], 8), ["click"])
    out = f.saturation_input(g, "click_all_missing_h8", "view_mean_h8", "click_ffilled", "sat")
    return out.select(*_PANEL, r6("sat").alias("sat"))


@query(
    "f10_mean_imputer",
    with_roles("reg_null")
    + f"SELECT {_ID}, x_qty, round(coalesce(x_disc, (SELECT avg(x_disc) FROM reg_null WHERE split = 'train_val')), 6) AS x_disc, "
    "round(coalesce(x_tax, (SELECT avg(x_tax) FROM reg_null WHERE split = 'train_val')), 6) AS x_tax, 0.0::DOUBLE AS x_empty FROM reg_null",
)
def _(spark, sf):
    df = reg_null(spark, sf).withColumn("x_empty", F.lit(None).cast("double"))
    cols = ["x_disc", "x_tax", "x_empty"]
    out = p.MeanImputer(cols).fit(df.where("split = 'train_val'")).transform(df)
    return out.select(*ROW_ID, "x_qty", *[r6(c).alias(c) for c in cols])


@query(
    "f11_standardizer",
    with_roles("reg")
    + f"SELECT {_ID}, round((x_qty - m1) / s1, 6) + 0.0 AS x_qty, round((x_tax - m2) / s2, 6) + 0.0 AS x_tax, 0.0::DOUBLE AS x_const "
    "FROM reg, (SELECT avg(x_qty) AS m1, stddev_pop(x_qty) AS s1, avg(x_tax) AS m2, stddev_pop(x_tax) AS s2 "
    "FROM reg WHERE split = 'train_val')",
)
def _(spark, sf):
    df = reg(spark, sf).withColumn("x_const", F.lit(3.0))
    cols = ["x_qty", "x_tax", "x_const"]
    out = p.Standardizer(cols).fit(df.where("split = 'train_val'")).transform(df)
    return out.select(*ROW_ID, *[r6(c).alias(c) for c in cols])


@query(
    "f12_one_hot",
    with_roles("reg")
    + f"SELECT {_ID}, "
    + ", ".join(f"CASE WHEN adm = '{v}' THEN 1.0::DOUBLE ELSE 0.0::DOUBLE END AS \"adm_{v}\"" for v in ("1-URGENT", "2-HIGH", "3-MEDIUM"))
    + ", CASE WHEN adm = '5-LOW' THEN 1.0::DOUBLE ELSE 0.0::DOUBLE END AS \"adm_None\" FROM reg",
)
def _(spark, sf):
    df = reg(spark, sf).withColumn("adm", F.nullif(F.col("adm"), F.lit("5-LOW")))
    seen = df.where("adm is null or adm <> '4-NOT SPECIFIED'")
    enc = p.OneHot(["adm"]).fit(seen)
    return enc.transform(df).select(*ROW_ID, *enc.names())


@query(
    "f13_ordinal",
    with_roles("reg")
    + ", cats AS (SELECT ward, CAST(dense_rank() OVER (ORDER BY ward) - 1 AS BIGINT) AS code FROM (SELECT DISTINCT ward FROM reg "
    "WHERE dataset <> 'ASIA' AND ward <> 'MACHINERY')) "
    f"SELECT {_ID}, coalesce(code, 99) AS ward, CAST(flag = 'R' AS BIGINT) AS is_r FROM reg LEFT JOIN cats USING (ward)",
)
def _(spark, sf):
    df = reg(spark, sf).withColumn("is_r", F.col("flag") == "R")
    seen = df.where("dataset <> 'ASIA' and ward <> 'MACHINERY'")
    return p.OrdinalEncoder(["ward", "is_r"]).fit(seen).transform(df).select(*ROW_ID, "ward", "is_r")


@query(
    "f14_assemble",
    with_roles("reg")
    + f"SELECT {_ID}, round(x_qty, 6) AS v0, round(x_disc, 6) AS v1, round(x_tax, 6) AS v2, round(x_line, 6) AS v3, 4 AS width FROM reg",
)
def _(spark, sf):
    df = reg(spark, sf)
    out = p.assemble(df, p.column_groups(df, FEATURES)["continuous"])
    parts = [r6(F.col("features")[i]).alias(f"v{i}") for i in range(4)]
    return out.select(*ROW_ID, *parts, F.size("features").alias("width"))


@query("f14_linear_preprocessing")
def _(spark, sf):
    df = reg_null(spark, sf).withColumn("is_r", F.col("flag") == "R")
    df = kept(df, *ROW_ID, "dataset", "split", *FEATURES, "is_r", "adm")
    prep = p.LinearPreprocessing([*FEATURES, "is_r", "adm"]).fit(df.where("split = 'train_val'"))
    out = p.assemble(prep.transform(df), prep.features)
    return out.select("dataset", "split", *ROW_ID, "features")


_PRIORITIES = ["1-URGENT", "2-HIGH", "3-MEDIUM", "4-NOT SPECIFIED", "5-LOW"]
_ENCODED = [f"coalesce({c}, m{i})" for i, c in enumerate(FEATURES)] + ["(flag = 'R')::INT::DOUBLE"]
_ENCODED += [f"coalesce(adm = '{v}', false)::INT::DOUBLE" for v in _PRIORITIES]


@query(
    "f14_linear_columns",
    with_roles("reg_null")
    + f", t AS (SELECT {', '.join(f'avg({c}) AS m{i}' for i, c in enumerate(FEATURES))} FROM reg_null WHERE split = 'train_val'), "
    + f"e AS MATERIALIZED (SELECT {_ID}, split, {', '.join(f'{x} AS e{i}' for i, x in enumerate(_ENCODED))} FROM reg_null, t), "
    + f"s AS (SELECT {', '.join(f'avg(e{i}) AS a{i}, stddev_pop(e{i}) AS d{i}' for i in range(len(_ENCODED)))} FROM e WHERE split = 'train_val') "
    + f"SELECT {_ID}, {', '.join(f'round((e{i} - a{i}) / d{i}, 6) + 0.0 AS v{i}' for i in range(len(_ENCODED)))} FROM e, s",
)
def _(spark, sf):
    """Every column of the linear preprocessing: imputed, encoded, scaled by the training rows."""
    df = reg_null(spark, sf).withColumn("is_r", F.col("flag") == "R")
    df = kept(df, *ROW_ID, "dataset", "split", *FEATURES, "is_r", "adm")
    prep = p.LinearPreprocessing([*FEATURES, "is_r", "adm"]).fit(df.where("split = 'train_val'"))
    out = p.assemble(prep.transform(df), prep.features)
    return out.select(*ROW_ID, *(r6(F.col("features")[i]).alias(f"v{i}") for i in range(len(_ENCODED))))


@query(
    "f14_tree_preprocessing",
    with_roles("reg_null")
    + f"SELECT {_ID}, x_disc, x_tax, (SELECT count(DISTINCT w.adm) FROM reg_null w WHERE w.adm < reg_null.adm) AS adm FROM reg_null",
)
def _(spark, sf):
    df = reg_null(spark, sf)
    prep = p.TreePreprocessing(["x_disc", "x_tax", "adm"]).fit(df)
    return prep.transform(df).select(*ROW_ID, "x_disc", "x_tax", "adm")


@query(
    "f15_dataset_codes",
    with_roles("reg") + f"SELECT {_ID}, CAST(dense_rank() OVER (ORDER BY dataset) - 1 AS BIGINT) AS anchor FROM reg",
)
def _(spark, sf):
    return a.anchor_codes(reg(spark, sf), "").select(*ROW_ID, "anchor")


@query(
    "f16_patient_groups",
    with_roles("reg")
    + "SELECT anchor, count(*) AS n FROM (SELECT CAST(patient_id AS VARCHAR) || dataset AS anchor FROM reg) GROUP BY anchor",
)
def _(spark, sf):
    out = a.anchor_codes(reg(spark, sf), "patient_id")
    return out.groupBy("anchor").agg(F.count("*").alias("n"))


_BRANDS = [f"Brand#{i}" for i in range(1, 26)]


def icd(spark, sf):
    """Per order the set of brands it holds: the list-valued anchor."""
    lines = table(spark, sf, "lineitem").select("l_orderkey", "l_partkey")
    parts = table(spark, sf, "part").select("p_partkey", "p_brand")
    return (
        lines.join(parts, F.col("l_partkey") == F.col("p_partkey"))
        .groupBy(F.col("l_orderkey").alias("stay_id"))
        .agg(F.collect_set("p_brand").alias("blocks"))
    )


@query(
    "f17_multi_hot",
    "SELECT l_orderkey AS stay_id, "
    + ", ".join(f"CAST(max(CASE WHEN p_brand = '{b}' THEN 1.0 ELSE 0.0 END) AS DOUBLE) AS \"blocks_{b}\"" for b in _BRANDS)
    + " FROM lineitem JOIN part ON l_partkey = p_partkey GROUP BY l_orderkey",
)
def _(spark, sf):
    hot, names = a.multi_hot(icd(spark, sf), "blocks")
    return hot.select("stay_id", *names)


@query(
    "f18_design_categorical",
    with_roles("reg")
    + ", lv AS (SELECT dataset, ward, row_number() OVER (PARTITION BY dataset ORDER BY ward) AS i FROM (SELECT DISTINCT dataset, ward FROM reg)), "
    "terms AS (SELECT dataset || ':Intercept' AS term, dataset, CAST(NULL AS VARCHAR) AS ward FROM (SELECT DISTINCT dataset FROM reg) "
    "UNION ALL SELECT dataset || ':C(ward)[' || ward || ']', dataset, ward FROM lv WHERE i > 1) "
    "SELECT term, CAST(count(*) AS DOUBLE) AS total FROM terms t JOIN reg USING (dataset) "
    "WHERE t.ward IS NULL OR t.ward = reg.ward GROUP BY term",
)
def _(spark, sf):
    """Column sums of the block-diagonal design with an intercept and one factor per dataset."""
    df, names = a.design_matrix(reg(spark, sf), [a.C("ward")])
    pairs = F.arrays_zip(F.array(*[F.lit(n) for n in names]).alias("term"), "z")
    long = df.select(F.inline(pairs).alias("term", "v")).where("v <> 0")
    return long.groupBy("term").agg(F.sum("v").alias("total"))


def _basis_sql(x: str, lo: str, inner: list[str], hi: str, degree: int = 3) -> list[str]:
    """B-spline basis as nested SQL expressions."""
    t = [lo] * (degree + 1) + inner + [hi] * (degree + 1)
    b = [
        f"CASE WHEN {t[i]} < {t[i + 1]} AND {x} >= {t[i]} AND ({x} < {t[i + 1]} OR {x} <= {t[i + 1]} AND {t[i + 1]} = {hi}) THEN 1.0::DOUBLE ELSE 0.0::DOUBLE END"
        for i in range(len(t) - 1)
    ]
    part = lambda top, wide, f: f"CASE WHEN {wide} > 0 THEN {top} / ({wide}) * ({f}) ELSE 0.0::DOUBLE END"
    for d in range(1, degree + 1):
        b = [
            f"{part(f'({x} - {t[i]})', f'{t[i + d]} - {t[i]}', b[i])} + {part(f'({t[i + d + 1]} - {x})', f'{t[i + d + 1]} - {t[i + 1]}', b[i + 1])}"
            for i in range(len(t) - 1 - d)
        ]
    return b


_SPLINE = _basis_sql("year", "lo", ["mid"], "hi")[1:]


@query(
    "f18_design_spline",
    with_roles("reg")
    + ", kn AS (SELECT dataset, min(year)::DOUBLE AS lo, quantile_cont(year, 0.5) AS mid, max(year)::DOUBLE AS hi FROM reg GROUP BY dataset), "
    "total AS (SELECT count(*) AS n FROM reg), "
    "lv AS (SELECT dataset, adm, row_number() OVER (PARTITION BY dataset ORDER BY adm) AS i FROM (SELECT DISTINCT dataset, adm FROM reg)), "
    "v AS (SELECT dataset || ':Intercept' AS term, 1.0::DOUBLE AS v FROM reg UNION ALL "
    "SELECT dataset || ':C(adm)[' || adm || ']', 1.0 FROM reg JOIN lv USING (dataset, adm) WHERE i > 1 UNION ALL "
    + " UNION ALL ".join(f"SELECT dataset || ':bs(year)[{k}]', {b} FROM reg JOIN kn USING (dataset) WHERE lo < hi" for k, b in enumerate(_SPLINE, 1))
    + ") SELECT term, round(sum(v) / any_value(n), 6) AS mean, round(max(v), 6) AS top FROM v, total GROUP BY term",
)
def _(spark, sf):
    df, names = a.design_matrix(reg(spark, sf), [a.C("adm"), a.BS("year", 4)])
    pairs = F.arrays_zip(F.array(*[F.lit(n) for n in names]).alias("term"), "z")
    long = df.select(F.inline(pairs).alias("term", "v"))
    return long.groupBy("term").agg(r6(F.avg("v")).alias("mean"), r6(F.max("v")).alias("top"))


_REGIONS = ["AFRICA", "AMERICA", "ASIA", "EUROPE", "MIDDLE EAST"]


@query(
    "f19_interact",
    with_roles("reg")
    + f"SELECT {_ID}, dataset, "
    + ", ".join(f"CASE WHEN dataset = '{d}' THEN 1.0::DOUBLE ELSE 0.0::DOUBLE END AS \"_dataset={d}\"" for d in _REGIONS)
    + ", "
    + ", ".join(
        f"CASE WHEN dataset = '{d}' THEN round({x} - avg({x}) OVER (PARTITION BY dataset), 6) + 0.0 ELSE 0.0 END AS \"_dataset={d}_x_{x}\""
        for d in _REGIONS
        for x in ("x_qty", "x_tax")
    )
    + " FROM reg",
)
def _(spark, sf):
    out, names = a.interact(reg(spark, sf), ["x_qty", "x_tax"])
    return out.select(*ROW_ID, "dataset", *[r6(F.col(f"`{n}`")).alias(n) for n in names])


@query(
    "f18_sparse_design",
    with_roles("reg")
    + ", kn AS (SELECT dataset, min(year)::DOUBLE AS lo, quantile_cont(year, 0.5) AS mid, max(year)::DOUBLE AS hi FROM reg GROUP BY dataset), "
    "lv AS (SELECT dataset, l_partkey, row_number() OVER (PARTITION BY dataset ORDER BY CAST(l_partkey AS VARCHAR)) AS i FROM (SELECT DISTINCT dataset, l_partkey FROM reg)), "
    "v AS (SELECT dataset, 'Intercept' AS name, 1.0::DOUBLE AS v FROM reg UNION ALL "
    "SELECT dataset, 'C(l_partkey)[' || l_partkey || ']', 1.0 FROM reg JOIN lv USING (dataset, l_partkey) WHERE i > 1 UNION ALL "
    + " UNION ALL ".join(f"SELECT dataset, 'bs(year)[{k}]', {b} FROM reg JOIN kn USING (dataset) WHERE lo < hi" for k, b in enumerate(_SPLINE, 1))
    + ") SELECT dataset, name, count(*) AS n, round(sum(v), 4) AS total FROM v WHERE v <> 0 GROUP BY dataset, name",
)
def _(spark, sf):
    """A factor of many levels and a spline, entry by entry."""
    df = kept(reg(spark, sf), "dataset", "l_partkey", "year")
    df, names = a.sparse_design(df, [a.C("l_partkey"), a.BS("year", 4)])
    sums = df.select("dataset", F.inline("z")).groupBy("dataset", "t").agg(F.count("*").alias("n"), r6(F.sum("v"), 4).alias("total"))
    return sums.join(names, ["dataset", "t"]).select("dataset", "name", "n", "total")
