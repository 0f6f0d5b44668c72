"""Scans, dictionary and stores: tables derived from the data, written and read back."""

from __future__ import annotations

from pyspark.sql import functions as F

from ..operators.sampling import assign_split
from ..plans.cohort_extraction import extract_cohort
from ..session import scratch_path
from ..sources import stores, tables
from .registry import query
from .roles import CONCEPTS, obs, r6, reg, results, sta, table, with_roles


@query(
    "s01_load",
    with_roles("reg")
    + "SELECT round(x_qty, 6) AS x_qty, round(x_disc, 6) AS x_disc_mean_h8, round(y, 6) AS y, dataset, patient_id "
    "FROM reg WHERE dataset IN ('ASIA', 'EUROPE') AND split = 'train_val' AND flag <> 'N'",
)
def _(spark, sf):
    root = scratch_path(spark, "features")
    rows = reg(spark, sf).withColumns(
        {
            "outcome": F.when(F.col("flag") != "N", F.col("y")),
            "x_disc_mean_h8": F.col("x_disc"),
            "x_disc_mean_h24": F.col("x_disc"),
        }
    )
    rows.drop("x_disc").write.partitionBy("dataset").parquet(root)
    df = tables.load(
        spark,
        root,
        ["ASIA", "EUROPE"],
        "outcome",
        "train_val",
        variables=["x_qty", "x_disc"],
        horizons=[8],
        other_columns=["dataset", "patient_id"],
    )
    return df.withColumns({c: r6(c) for c in ("x_qty", "x_disc_mean_h8", "y")})


@query(
    "s02_assign_split",
    "SELECT split, count(*) AS n, count(DISTINCT o_custkey) AS patients FROM (SELECT o_custkey, CASE WHEN "
    "(o_custkey * 7919) % 10 < 3 THEN 'test' ELSE 'train_val' END AS split FROM orders) GROUP BY split",
)
def _(spark, sf):
    df = assign_split(table(spark, sf, "orders"), "o_custkey")
    return df.groupBy("split").agg(F.count("*").alias("n"), F.count_distinct("o_custkey").alias("patients"))


@query("s03_scan_column", "SELECT l_quantity, count(*) AS n FROM lineitem GROUP BY l_quantity")
def _(spark, sf):
    return tables.scan_column(spark, f"{sf}/lineitem.parquet", "l_quantity").groupBy("l_quantity").agg(
        F.count("*").alias("n")
    )


def derived_dictionary(spark, sf):
    """A variable dictionary for the event types: bounds from the data, fixed transforms."""
    d = table(spark, sf, "events").groupBy("event_type").agg(F.min("value").alias("lo"), F.max("value").alias("up"))
    none = F.lit("None")
    text = {
        "VariableID": F.length("event_type").cast("string"),
        "VariableTag": F.col("event_type"),
        "VariableName": F.initcap("event_type"),
        "VariableType": F.lit("observation"),
        "DatasetVersion": F.when(F.col("event_type") == "signup", none).otherwise(F.lit("v0.0")),
        "OrganSystem": none,
        "TreatmentGroups": none,
        "Unit": none,
        "DataType": F.when(F.col("event_type") == "purchase", F.lit("treatment_cont")).otherwise(F.lit("continuous")),
        "LowerBound": F.col("lo").cast("string"),
        "UpperBound": F.when(F.col("event_type") == "view", none).otherwise((F.col("up") / 2).cast("string")),
        "Description": none,
        "LogTransform": F.when(F.col("event_type") == "click", F.lit("TRUE"))
        .when(F.col("event_type") == "view", F.lit("True"))
        .otherwise(F.lit("False")),
        "LogTransformEps": F.when(F.col("event_type") == "click", F.lit("0.1")).otherwise(none),
        "PossibleValues": none,
        "TreatmentDetailLevel": none,
    }
    return d.select(*[c.alias(n) for n, c in text.items()])


def written_dictionary(spark, sf):
    path = scratch_path(spark, "dictionary")
    derived_dictionary(spark, sf).write.option("sep", "\t").option("header", True).csv(path)
    return tables.read_dictionary(spark, path)


@query(
    "s04_read_dictionary",
    "SELECT event_type AS \"VariableTag\", CASE WHEN event_type = 'purchase' THEN 'treatment_cont' ELSE 'continuous' END AS \"DataType\", "
    "round(min(value), 6) AS \"LowerBound\", CASE WHEN event_type <> 'view' THEN round(max(value) / 2, 6) END AS \"UpperBound\", "
    "event_type IN ('click', 'view') AS \"LogTransform\", CASE WHEN event_type = 'click' THEN 0.1::DOUBLE END AS \"LogTransformEps\" "
    "FROM events WHERE event_type <> 'signup' GROUP BY event_type",
)
def _(spark, sf):
    d = written_dictionary(spark, sf)
    return d.select(
        "VariableTag",
        "DataType",
        r6("LowerBound").alias("LowerBound"),
        r6("UpperBound").alias("UpperBound"),
        "LogTransform",
        "LogTransformEps",
    )


@query(
    "s05_read_results",
    with_roles("results")
    + "SELECT run_id, array_to_string(sources, ',') AS sources, gamma, CASE WHEN gamma < 3 THEN alpha END AS alpha, target, split, "
    "metric, round(value, 6) + 0.0 AS value FROM results",
)
def _(spark, sf):
    root = scratch_path(spark, "runs")
    tag = F.concat(F.lit("['"), F.array_join("sources", "', '"), F.lit("']"))
    res = results(spark, sf).withColumn("sources", tag)
    stores.write_results(res.where("gamma < 3"), root, "exp")
    stores.write_results(res.where("gamma >= 3").drop("alpha"), root, "exp")
    back = stores.read_results(spark, root, "exp")
    return back.select(
        "run_id", F.array_join("sources", ",").alias("sources"), "gamma", "alpha", "target", "split", "metric", r6("value").alias("value")
    )


@query(
    "s06_write_results_csv",
    with_roles("results")
    + "SELECT target, split, metric, count(*) AS n, round(avg(value), 6) AS value FROM results WHERE metric <> 'mean_residual' "
    "GROUP BY target, split, metric",
)
def _(spark, sf):
    root = scratch_path(spark, "runs")
    path = stores.write_results(results(spark, sf).drop("sources"), root, "exp", format="csv")
    schema = "run_id string, gamma double, alpha double, target string, split string, metric string, value double, experiment string"
    back = spark.read.csv(path, header=True, schema=schema).where("experiment = 'exp' and metric <> 'mean_residual'")
    return back.groupBy("target", "split", "metric").agg(F.count("*").alias("n"), r6(F.avg("value")).alias("value"))


def _stored_cohort(spark, sf, multi_centre):
    cohort = extract_cohort(obs(spark, sf), sta(spark, sf), CONCEPTS)
    if multi_centre:
        nation = table(spark, sf, "nation")
        cohort.hospital = nation.select(F.col("n_nationkey").alias("hospital_id"), F.col("n_name").alias("name"))
    path = scratch_path(spark, "cohort")
    stores.write_cohort(cohort, path, multi_centre=multi_centre)
    cohort.release()
    return path


@query(
    "s07_write_cohort",
    with_roles("windows", "grid")
    + ", n AS (SELECT dataset, stay_id, max(gap) AS gap FROM (SELECT dataset, stay_id, t, coalesce(lead(t) OVER "
    "(PARTITION BY dataset, stay_id ORDER BY t), 1 + (SELECT s.end_h FROM stays s WHERE s.dataset = q.dataset AND s.stay_id = q.stay_id)) "
    "- t - 1 AS gap FROM (SELECT DISTINCT o.dataset, o.stay_id, o.time_h AS t FROM obs o JOIN stays s ON s.dataset = o.dataset AND "
    "s.stay_id = o.stay_id AND o.time_h <= s.end_h) q) GROUP BY dataset, stay_id), "
    "kept AS (SELECT n.dataset, n.stay_id FROM n JOIN windows w USING (dataset, stay_id) WHERE gap <= 48 AND w.end_h >= 4 "
    "AND (SELECT count(*) FROM wide x WHERE x.dataset = n.dataset AND x.stay_id = n.stay_id) >= 4) "
    "SELECT g.dataset, count(*) AS n_rows, CAST(max(g.time_h) * 3600 AS BIGINT) AS last_second, "
    "count(g.click) AS clicks FROM grid g JOIN kept k ON k.dataset = g.dataset AND k.stay_id = g.stay_id GROUP BY g.dataset",
)
def _(spark, sf):
    dyn = spark.read.parquet(f"{_stored_cohort(spark, sf, False)}/dyn")
    return dyn.groupBy("dataset").agg(
        F.count("*").alias("n_rows"), F.max("time").alias("last_second"), F.count("click").alias("clicks")
    )


@query("s08_hospital_table", "SELECT n_nationkey AS hospital_id, n_name AS name FROM nation")
def _(spark, sf):
    return spark.read.parquet(f"{_stored_cohort(spark, sf, True)}/hospital")
