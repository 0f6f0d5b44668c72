"""The physical plans: what is read, what is shuffled, what stays out of Python."""

import contextlib
import io

from pyspark.sql import functions as F

from cohortlens.catalog import roles
from cohortlens.functions.bounded import lookup
from cohortlens.operators import cohort as c
from cohortlens.operators import metrics as me
from cohortlens.operators import moments as mo
from cohortlens.operators.sampling import nested_ranks
from cohortlens.sources.tables import load

SF = "/root/testdata/sf0.001"


def plan(df) -> str:
    out = io.StringIO()
    with contextlib.redirect_stdout(out):
        df.explain("formatted")
    return out.getvalue()


def test_load_reads_only_its_folders_and_columns(spark, tmp_path):
    root = str(tmp_path / "t")
    roles.reg(spark, SF).write.partitionBy("dataset").parquet(root)
    text = plan(load(spark, root, ["ASIA"], "y", "test", variables=["x_qty"], other_columns=["dataset"]))
    assert "PartitionFilters" in text and "dataset" in text.split("PartitionFilters")[1][:120]
    schema = [line for line in text.splitlines() if "ReadSchema" in line][0]
    assert "x_qty" in schema and "x_tax" not in schema and "patient_id" not in schema
    assert "PushedFilters" in text and "EqualTo(split,test)" in text.replace(" ", "")


def test_moments_of_few_columns_stay_in_the_jvm(spark):
    text = plan(mo.env_moments(roles.reg(spark, SF), ["x_qty", "x_tax", "y"]))
    assert "MapInArrow" not in text and "Python" not in text
    assert text.count("HashAggregate") >= 2


def test_interval_filter_is_an_equi_join(spark):
    o = roles.obs(spark, SF)
    win = o.select("dataset", "stay_id", F.col("time_h").alias("start_h"), (F.col("time_h") + 2).alias("end_h"))
    text = plan(c.filter_in_windows(o, win))
    assert "CartesianProduct" not in text and "NestedLoop" not in text and "LeftSemi" in text


def test_no_window_runs_over_a_whole_seed(spark):
    text = plan(nested_ranks(roles.reg(spark, SF), "patient_id", [0, 1], 50))
    ranks = [line for line in text.splitlines() if "row_number" in line and "windowspecdefinition" in line]
    assert ranks and all("_bucket" in line.split("windowspecdefinition")[1] for line in ranks)


def test_scoring_joins_nothing(spark):
    df = spark.read.parquet(f"{SF}/lineitem.parquet").select(
        F.col("l_quantity").alias("x_qty"), F.col("l_discount").alias("x_disc"), F.col("l_tax").alias("x_tax"), F.lit(1.0).alias("x_line")
    )
    text = plan(me.score_grid(df, roles.MODELS, roles.FEATURES, ["x_qty"]))
    assert "Join" not in text and "Exchange" not in text


def test_side_tables_above_the_bound_are_not_broadcast(spark):
    df = spark.range(1000).withColumn("k", F.col("id") % 100)
    means = df.groupBy("k").agg(F.avg("id").alias("m"))
    assert "LocalTableScan" in plan(lookup(means, 100)) or "Scan" in plan(lookup(means, 100))
    assert lookup(means, 99) is means
    joined = df.join(lookup(means, 100), "k")
    assert "BroadcastHashJoin" in plan(joined)
    assert joined.count() == 1000


def test_projection_on_many_groups_equals_the_window(spark):
    df = spark.range(30_000).select(F.col("id"), (F.col("id") % 12_000).alias("g"), (F.col("id") % 7).cast("double").alias("v"))
    out = mo.project_groups(df, ["v"], ["g"])
    total = out.agg(F.sum("v_proj")).first()[0]
    assert abs(total) < 1e-6 and out.count() == 30_000


def test_rows_of_a_learning_curve_group(spark):
    """A task of a learning curve holds the moments of one sample, whatever the rows, seeds and sizes."""
    from cohortlens.operators.moments import env_moments
    from cohortlens.plans.learning import sample_moments

    df = spark.range(0, 5000).selectExpr(
        "cast(id % 3 as int) AS seed", "cast(id % 4 as int) AS bucket", "id % 5 AS fold", "id * 0.5 AS a", "id % 7 * 1.0 AS y"
    )
    rows = sample_moments(env_moments(df, ["a", "y"], ["seed", "bucket", "fold"]), 4)
    groups = rows.groupBy("seed", "size").agg(F.count("*").alias("n"), F.max("top").alias("top"), F.sum(F.expr("IF(i = 0 AND j = 0, n, 0)")).alias("all"))
    got = groups.collect()
    assert len(got) == 12 and {r["n"] for r in got} == {5 * 3} and all(r["top"] == r["size"] for r in got)
    want = {(s, z): sum(1 for i in range(5000) if i % 3 == s and i % 4 <= z) for s in range(3) for z in range(4)}
    assert {(r["seed"], r["size"]): r["all"] for r in got} == want
