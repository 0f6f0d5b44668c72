"""The given tables seen as cohort data: each role as a DataFrame and as a SQL definition."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from ..functions.bounded import lookup
from ..operators.cohort import concepts_wide, map_to_grid, stay_windows, stop_obs_at, to_interval
from ..operators.metrics import score_grid
from ..operators.sampling import assign_split, nested_samples
from ..session import pin

CONCEPTS = ["click", "error", "purchase", "signup", "view"]
REGIONS = ["AFRICA", "AMERICA", "ASIA", "EUROPE", "MIDDLE EAST"]
FEATURES = ["x_qty", "x_disc", "x_tax", "x_line"]
ROW_ID = ["stay_id", "l_linenumber", "l_partkey", "l_suppkey"]
CURVE_SIZES = [5, 10, 20, 40, 80, 160, 320]
CURVE_SEEDS = [0, 1, 2, 3, 4]

#: Fixed linear models: name, intercept, coefficients of FEATURES.
MODELS = [
    {"model": "a", "intercept": 9.0, "coef": [0.04, -0.5, 0.0, 0.0]},
    {"model": "b", "intercept": 9.3, "coef": [0.035, 0.0, 0.2, -0.01]},
    {"model": "c", "intercept": 10.2, "coef": [0.0, 0.0, 0.0, 0.0]},
]
#: Fixed logistic models of a binary outcome.
BINARY_MODELS = [
    {"model": "p", "intercept": -1.0, "coef": [0.02137, -3.1731, 1.0193, 0.0]},
    {"model": "q", "intercept": 0.3, "coef": [-0.01037, 0.0, 0.0, -0.1013]},
]


def table(spark: SparkSession, sf: str, name: str) -> DataFrame:
    return spark.read.parquet(f"{sf}/{name}.parquet")


def places(spark: SparkSession, sf: str) -> DataFrame:
    """customer with nation and region names."""
    return (
        table(spark, sf, "customer")
        .join(table(spark, sf, "nation"), F.col("c_nationkey") == F.col("n_nationkey"))
        .join(table(spark, sf, "region"), F.col("n_regionkey") == F.col("r_regionkey"))
    )


def sta(spark: SparkSession, sf: str) -> DataFrame:
    """Static data: one row per possible stay."""
    return places(spark, sf).select(
        F.col("r_name").alias("dataset"),
        F.col("c_custkey").alias("stay_id"),
        F.col("c_mktsegment").alias("ward"),
        F.col("c_nationkey").alias("hospital_id"),
        F.col("c_acctbal").alias("age"),
    )


def obs(spark: SparkSession, sf: str) -> DataFrame:
    """Long observations with whole hours since the stay's first event."""
    events = table(spark, sf, "events").select(
        F.col("user_id").alias("stay_id"), F.col("event_type").alias("concept"), "value", "ts"
    )
    first = events.groupBy("stay_id").agg(F.min("ts").alias("t0"))
    origin = first.join(sta(spark, sf).select("dataset", "stay_id"), "stay_id")
    timed = to_interval(events.join(origin, "stay_id"), "ts", "t0")
    return timed.select("dataset", "stay_id", "concept", "time_h", "value")


def stays(spark: SparkSession, sf: str) -> DataFrame:
    return stop_obs_at(stay_windows(obs(spark, sf)))


def wide(spark: SparkSession, sf: str) -> DataFrame:
    return concepts_wide(obs(spark, sf), CONCEPTS)


def grid(spark: SparkSession, sf: str) -> DataFrame:
    """Hourly panel of the truncated stays."""
    o = obs(spark, sf)
    return map_to_grid(stop_obs_at(stay_windows(o)), concepts_wide(o, CONCEPTS))


def reg(spark: SparkSession, sf: str) -> DataFrame:
    """Regression rows: log price of a line item, four features, anchors, split.

    Orders find their place first, so that the lines are shuffled once.
    """
    lines = table(spark, sf, "lineitem")
    orders = table(spark, sf, "orders").join(places(spark, sf), F.col("o_custkey") == F.col("c_custkey"))
    rows = (
        lines.join(orders, F.col("l_orderkey") == F.col("o_orderkey")).select(
            F.col("r_name").alias("dataset"),
            F.col("o_custkey").alias("patient_id"),
            F.col("l_orderkey").alias("stay_id"),
            "l_linenumber",
            "l_partkey",
            "l_suppkey",
            F.log("l_extendedprice").alias("y"),
            F.col("l_quantity").alias("x_qty"),
            F.col("l_discount").alias("x_disc"),
            F.col("l_tax").alias("x_tax"),
            F.col("l_linenumber").cast("double").alias("x_line"),
            F.col("c_mktsegment").alias("ward"),
            F.col("c_nationkey").alias("hospital_id"),
            F.year("o_orderdate").cast("long").alias("year"),
            F.col("o_orderpriority").alias("adm"),
            F.col("o_orderstatus").alias("insurance"),
            F.col("l_returnflag").alias("flag"),
        )
    )
    return assign_split(rows, "patient_id")


def reg_null(spark: SparkSession, sf: str) -> DataFrame:
    """``reg`` with holes in two features."""
    hole = (F.col("stay_id") * 7 + F.col("l_linenumber")) % 5 == 0
    hole2 = (F.col("stay_id") * 3 + F.col("l_linenumber")) % 7 == 0
    return reg(spark, sf).withColumns(
        {
            "x_tax": F.when(~hole, F.col("x_tax")),
            "x_disc": F.when(~hole2, F.col("x_disc")),
        }
    )


def binary(spark: SparkSession, sf: str) -> DataFrame:
    return reg(spark, sf).withColumn("y", (F.col("flag") == "R").cast("double"))


def kept(df: DataFrame, *columns: str) -> DataFrame:
    """``columns`` written once, for operators that pass over their rows several times: the joins then run once."""
    return pin(df.select(*dict.fromkeys(columns)))


def scored(spark: SparkSession, sf: str) -> DataFrame:
    """Three fixed models on every regression row."""
    keep = ["dataset", "split", "patient_id", "ward", *ROW_ID, "y"]
    return score_grid(reg(spark, sf), MODELS, FEATURES, keep)


def scored_binary(spark: SparkSession, sf: str) -> DataFrame:
    keep = ["dataset", "split", "patient_id", "ward", *ROW_ID, "y"]
    return score_grid(binary(spark, sf), BINARY_MODELS, FEATURES, keep, link="logit")


def r6(c: Column | str, digits: int = 6) -> Column:
    return F.round(F.col(c) if isinstance(c, str) else c, digits)


GAMMAS = [1.0, 2.0, 3.0, 4.0]
ALPHAS = [0.001, 0.1, 1.0, 10.0]


def results(spark: SparkSession, sf: str) -> DataFrame:
    """Fixed models per source subset, gamma and alpha, judged by moments of ``reg``.

    yhat = b0 + bq x_qty + bd x_disc with b0 = 9 + 0.05 k, bq = 0.04 / (1 + alpha / 20),
    bd = -gamma / 10, k the number of the subset. One scan gives the moments of (y, x_qty,
    x_disc) by dataset and split; all errors follow from them.
    """
    m = (
        reg(spark, sf)
        .groupBy(F.col("dataset").alias("target"), "split")
        .agg(
            F.avg("y").alias("my"),
            F.avg("x_qty").alias("mq"),
            F.avg("x_disc").alias("md"),
            F.avg(F.col("y") * F.col("y")).alias("yy"),
            F.avg(F.col("x_qty") * F.col("x_qty")).alias("qq"),
            F.avg(F.col("x_disc") * F.col("x_disc")).alias("dd"),
            F.avg(F.col("y") * F.col("x_qty")).alias("yq"),
            F.avg(F.col("y") * F.col("x_disc")).alias("yd"),
            F.avg(F.col("x_qty") * F.col("x_disc")).alias("qd"),
        )
    )
    m = lookup(m)
    sets = F.array(*[F.struct(F.lit(k).alias("k"), subset_array(k).alias("sources")) for k in SUBSET_MASKS])
    runs = m.select("*", F.inline(sets))
    runs = runs.withColumn("gamma", F.explode(F.array(*[F.lit(g) for g in GAMMAS])))
    runs = runs.withColumn("alpha", F.explode(F.array(*[F.lit(a) for a in ALPHAS])))
    runs = runs.withColumns(
        {
            "b0": F.lit(9.0) + F.lit(0.05) * F.col("k"),
            "bq": F.lit(0.04) / (F.lit(1.0) + F.col("alpha") / 20),
            "bd": -F.col("gamma") / 10,
        }
    )
    c = F.col
    mean_r = c("my") - c("b0") - c("bq") * c("mq") - c("bd") * c("md")
    mse = (
        c("yy") + c("b0") * c("b0") + c("bq") * c("bq") * c("qq") + c("bd") * c("bd") * c("dd")
        - 2 * c("b0") * c("my") - 2 * c("bq") * c("yq") - 2 * c("bd") * c("yd")
        + 2 * c("b0") * c("bq") * c("mq") + 2 * c("b0") * c("bd") * c("md")
        + 2 * c("bq") * c("bd") * c("qd")
    )
    values = F.array(
        F.struct(F.lit("mse").alias("metric"), mse.alias("value")),
        F.struct(F.lit("rmse").alias("metric"), F.sqrt(mse).alias("value")),
        F.struct(F.lit("mean_residual").alias("metric"), mean_r.alias("value")),
        F.struct(
            F.lit("r2").alias("metric"),
            (1 - mse / (c("yy") - c("my") * c("my"))).alias("value"),
        ),
    )
    run_id = F.concat_ws("|", c("k").cast("string"), (c("gamma") * 10).cast("int"), (c("alpha") * 1000).cast("int"))
    return runs.select(
        run_id.alias("run_id"), "sources", "gamma", "alpha", "target", "split", F.inline(values)
    )


#: Source subsets of 5, 4 and 3 regions as bit masks.
SUBSET_MASKS = [k for k in range(32) if bin(k).count("1") >= 3]


def subset_array(k: int) -> Column:
    return F.array(*[F.lit(r) for i, r in enumerate(REGIONS) if k >> i & 1])


def learning_curves(spark: SparkSession, sf: str) -> DataFrame:
    """Intercept refits on nested samples of patients, from scratch and shrunk to a prior.

    Residuals of one fixed slope are summed per patient first, and that table is kept; samples
    fan out over patients.
    """
    r = F.col("y") - F.lit(9.0) - F.lit(0.04) * F.col("x_qty")
    rows = reg(spark, sf).select("dataset", "patient_id", "split", r.alias("r"))
    sums = rows.groupBy("dataset", "patient_id", "split").agg(
        F.count("*").alias("n"), F.sum("r").alias("s"), F.sum(F.col("r") * F.col("r")).alias("ss")
    )
    sums = pin(sums)
    per_patient = sums.where("split = 'train_val'").drop("split")
    prior = per_patient.agg((F.sum("s") / F.sum("n"))).first()[0]
    test = (
        sums.where("split = 'test'")
        .groupBy("dataset")
        .agg((F.sum("s") / F.sum("n")).alias("t1"), (F.sum("ss") / F.sum("n")).alias("t2"))
    )
    samples = nested_samples(per_patient, "patient_id", CURVE_SEEDS, CURVE_SIZES, ["dataset"])
    points = (
        samples.join(per_patient, ["dataset", "patient_id"])
        .groupBy("dataset", "seed", "n_target")
        .agg((F.sum("s") / F.sum("n")).alias("m"), (F.sum("ss") / F.sum("n")).alias("mm"))
        .join(test, "dataset")
    )
    kinds = F.array(
        F.struct(F.lit("n_samples").alias("experiment"), F.col("m").alias("shift")),
        F.struct(
            F.lit("refit").alias("experiment"),
            (F.col("m") * 0.6 + F.lit(0.4 * prior)).alias("shift"),
        ),
    )
    points = points.select("*", F.inline(kinds))
    shift = F.col("shift")
    mse = F.col("t2") - 2 * shift * F.col("t1") + shift * shift
    cv = F.col("mm") - 2 * shift * F.col("m") + shift * shift
    values = F.array(
        F.struct(F.lit("mse").alias("metric"), cv.alias("cv_value"), mse.alias("test_value")),
        F.struct(
            F.lit("r2").alias("metric"),
            (1 - cv / (F.col("mm") - F.col("m") * F.col("m"))).alias("cv_value"),
            (1 - mse / (F.col("t2") - F.col("t1") * F.col("t1"))).alias("test_value"),
        ),
    )
    return points.select(
        "experiment", F.col("dataset").alias("target"), "seed", "n_target", F.inline(values)
    )


# SQL definitions of the same roles: name -> (roles it reads, body).
SQL_ROLES: dict[str, tuple[tuple[str, ...], str]] = {
    "places": (
        (),
        "SELECT * FROM customer JOIN nation ON c_nationkey = n_nationkey "
        "JOIN region ON n_regionkey = r_regionkey",
    ),
    "sta": (
        ("places",),
        "SELECT r_name AS dataset, c_custkey AS stay_id, c_mktsegment AS ward, "
        "c_nationkey AS hospital_id, c_acctbal AS age FROM places",
    ),
    "obs": (
        ("sta",),
        "SELECT s.dataset, e.user_id AS stay_id, e.event_type AS concept, "
        "CAST((epoch_us(e.ts) - epoch_us(o.t0)) // 3600000000 AS BIGINT) AS time_h, e.value "
        "FROM events e JOIN (SELECT user_id, min(ts) AS t0 FROM events GROUP BY user_id) o "
        "ON o.user_id = e.user_id JOIN sta s ON s.stay_id = e.user_id",
    ),
    "windows": (
        ("obs",),
        "SELECT dataset, stay_id, CAST(0 AS BIGINT) AS start_h, max(time_h) AS end_h "
        "FROM obs GROUP BY dataset, stay_id",
    ),
    "stays": (
        ("windows",),
        "SELECT dataset, stay_id, start_h, least(end_h, start_h + 336) AS end_h FROM windows",
    ),
    "wide": (
        ("obs",),
        "SELECT dataset, stay_id, time_h, "
        + ", ".join(f"avg(value) FILTER (WHERE concept = '{c}') AS \"{c}\"" for c in CONCEPTS)
        + " FROM obs GROUP BY dataset, stay_id, time_h",
    ),
    "hours": (
        ("stays",),
        "SELECT dataset, stay_id, CAST(h AS BIGINT) AS time_h FROM "
        "(SELECT dataset, stay_id, unnest(range(start_h, end_h + 1)) AS h FROM stays)",
    ),
    "grid": (
        ("hours", "wide"),
        "SELECT h.dataset, h.stay_id, h.time_h, "
        + ", ".join(f'w."{c}"' for c in CONCEPTS)
        + " FROM hours h LEFT JOIN wide w ON w.dataset = h.dataset AND w.stay_id = h.stay_id "
        "AND w.time_h = h.time_h",
    ),
    "reg": (
        ("places",),
        "SELECT r_name AS dataset, o_custkey AS patient_id, l_orderkey AS stay_id, l_linenumber, "
        "l_partkey, l_suppkey, ln(l_extendedprice) AS y, l_quantity AS x_qty, l_discount AS x_disc, "
        "l_tax AS x_tax, CAST(l_linenumber AS DOUBLE) AS x_line, c_mktsegment AS ward, "
        "c_nationkey AS hospital_id, CAST(year(o_orderdate) AS BIGINT) AS year, "
        "o_orderpriority AS adm, o_orderstatus AS insurance, l_returnflag AS flag, "
        "CASE WHEN (o_custkey * 7919) % 10 < 3 THEN 'test' ELSE 'train_val' END AS split "
        "FROM lineitem JOIN orders ON l_orderkey = o_orderkey JOIN places ON o_custkey = c_custkey",
    ),
    "reg_null": (
        ("reg",),
        "SELECT * REPLACE ("
        "CASE WHEN (stay_id * 7 + l_linenumber) % 5 <> 0 THEN x_tax END AS x_tax, "
        "CASE WHEN (stay_id * 3 + l_linenumber) % 7 <> 0 THEN x_disc END AS x_disc) FROM reg",
    ),
    "bin": (
        ("reg",),
        "SELECT * REPLACE (CASE WHEN flag = 'R' THEN 1.0::DOUBLE ELSE 0.0::DOUBLE END AS y) FROM reg",
    ),
    "models": (
        (),
        "SELECT * FROM (VALUES "
        + ", ".join(
            f"('{m['model']}', {m['intercept']}::DOUBLE, "
            + ", ".join(f"{b}::DOUBLE" for b in m["coef"])
            + ")"
            for m in MODELS
        )
        + ") t(model, b0, b1, b2, b3, b4)",
    ),
    "binary_models": (
        (),
        "SELECT * FROM (VALUES "
        + ", ".join(
            f"('{m['model']}', {m['intercept']}::DOUBLE, "
            + ", ".join(f"{b}::DOUBLE" for b in m["coef"])
            + ")"
            for m in BINARY_MODELS
        )
        + ") t(model, b0, b1, b2, b3, b4)",
    ),
    "scored": (
        ("reg", "models"),
        "SELECT reg.*, model, b0 + (b1 * x_qty + b2 * x_disc + b3 * x_tax + b4 * x_line) AS yhat "
        "FROM reg, models",
    ),
    "scored_binary": (
        ("bin", "binary_models"),
        "SELECT bin.*, model, 1.0::DOUBLE / (1.0::DOUBLE + exp(-(b0 + "
        "(b1 * x_qty + b2 * x_disc + b3 * x_tax + b4 * x_line)))) AS yhat FROM bin, binary_models",
    ),
    "subsets": (
        (),
        "SELECT k, [r FOR r, i IN ['AFRICA','AMERICA','ASIA','EUROPE','MIDDLE EAST'] "
        "IF (k >> (i - 1)) % 2 = 1] AS sources FROM (SELECT CAST(range AS INTEGER) AS k FROM range(32)) "
        "WHERE bit_count(k) >= 3",
    ),
    "results": (
        ("reg", "subsets"),
        "SELECT run_id, sources, gamma, alpha, target, split, unnest(['mse','rmse','mean_residual','r2']) "
        "AS metric, unnest([mse, sqrt(mse), mean_r, 1 - mse / v]) AS value FROM ("
        "SELECT CAST(k AS VARCHAR) || '|' || CAST(CAST(gamma * 10 AS INTEGER) AS VARCHAR) || '|' || "
        "CAST(CAST(alpha * 1000 AS INTEGER) AS VARCHAR) AS run_id, sources, gamma, alpha, "
        "dataset AS target, split, avg(r * r) AS mse, avg(r) AS mean_r, var_pop(y) AS v FROM ("
        "SELECT k, sources, gamma, alpha, dataset, split, y, y - (9.0 + 0.05 * k) "
        "- 0.04 / (1 + alpha / 20) * x_qty + gamma / 10 * x_disc AS r FROM reg, subsets, "
        "(SELECT unnest([1.0, 2.0, 3.0, 4.0]::DOUBLE[]) AS gamma), "
        "(SELECT unnest([0.001, 0.1, 1.0, 10.0]::DOUBLE[]) AS alpha)) "
        "GROUP BY k, sources, gamma, alpha, dataset, split)",
    ),
    "res_rows": (
        ("reg",),
        "SELECT dataset, patient_id, split, y - 9.0 - 0.04 * x_qty AS r FROM reg",
    ),
    "ranks": (
        ("res_rows",),
        "SELECT dataset, patient_id, seed, row_number() OVER (PARTITION BY dataset, seed ORDER BY "
        "md5(CAST(seed AS VARCHAR) || ':' || CAST(patient_id AS VARCHAR)), patient_id) AS rank FROM "
        "(SELECT DISTINCT dataset, patient_id FROM res_rows WHERE split = 'train_val'), "
        "(SELECT CAST(range AS INTEGER) AS seed FROM range(5))",
    ),
    "curves": (
        ("res_rows", "ranks"),
        "SELECT experiment, target, seed, n_target, unnest(['mse', 'r2']) AS metric, "
        "unnest([mm - 2 * shift * m + shift * shift, 1 - (mm - 2 * shift * m + shift * shift) / (mm - m * m)]) "
        "AS cv_value, unnest([t2 - 2 * shift * t1 + shift * shift, "
        "1 - (t2 - 2 * shift * t1 + shift * shift) / (t2 - t1 * t1)]) AS test_value FROM ("
        "SELECT dataset AS target, seed, n_target, m, mm, t1, t2, unnest(['n_samples', 'refit']) AS experiment, "
        "unnest([m, 0.6 * m + 0.4 * (SELECT avg(r) FROM res_rows WHERE split = 'train_val')]) AS shift FROM ("
        "SELECT k.dataset, k.seed, n.n_target, avg(x.r) AS m, avg(x.r * x.r) AS mm FROM ranks k "
        f"JOIN (SELECT CAST(unnest({CURVE_SIZES}) AS INTEGER) AS n_target) n ON k.rank <= n.n_target "
        "JOIN res_rows x ON x.dataset = k.dataset AND x.patient_id = k.patient_id AND x.split = 'train_val' "
        "JOIN (SELECT dataset, count(DISTINCT patient_id) AS c FROM res_rows WHERE split = 'train_val' "
        "GROUP BY dataset) z ON z.dataset = k.dataset AND n.n_target <= z.c "
        "GROUP BY k.dataset, k.seed, n.n_target) JOIN (SELECT dataset, avg(r) AS t1, avg(r * r) AS t2 "
        "FROM res_rows WHERE split = 'test' GROUP BY dataset) USING (dataset))",
    ),
}


def with_roles(*names: str) -> str:
    """``WITH`` clause that defines the roles and everything they read."""
    order: list[str] = []

    def visit(name: str) -> None:
        for dep in SQL_ROLES[name][0]:
            visit(dep)
        if name not in order:
            order.append(name)

    for n in names:
        visit(n)
    return "WITH " + ", ".join(f"{n} AS ({SQL_ROLES[n][1]})" for n in order) + " "
