"""Operators that pass over their rows several times compute them once; ranks are exact for any spread of values."""

from datetime import date

import numpy as np
import pytest
from pyspark.sql import functions as F

from cohortlens.catalog import load_all, roles
from cohortlens.operators import anchors, order_stats
from cohortlens.operators import metrics as me


def counted(spark, n):
    """A scored table and a counter of the rows that were computed for it."""
    seen = spark.sparkContext.accumulator(0)

    def look(batches):
        for b in batches:
            seen.add(b.num_rows)
            yield b

    ids = spark.range(n, numPartitions=2).mapInArrow(look, "id bigint")
    part = (F.col("id") % 2).cast("string").alias("g")
    return ids.select(part, (F.col("id") % 5).alias("w"), (F.col("id") % 3 == 0).cast("double").alias("y"), (F.col("id") / n).alias("yhat")), seen


@pytest.mark.parametrize("hot_rows", [10, 10**9])
def test_scores_are_computed_once(spark, hot_rows):
    for run in (
        lambda df: me.residual_metrics(df, ["g"], hot_rows=hot_rows),
        lambda df: me.rank_metrics(df, ["g"], hot_rows),
        lambda df: me.log_loss_quantiles(df, ["g"], hot_rows),
        lambda df: me.all_metrics(df, ["g"], "binary", ["w"], hot_rows),
        lambda df: me.all_metrics(df, ["g"], "regression", ["w"], hot_rows),
    ):
        df, seen = counted(spark, 400)
        assert run(df).count() == 2 and seen.value == 400


def test_quantiles_of_far_and_unordered_values(spark):
    """Brackets are narrowed time and again; not finite values and single values have their ranks too."""
    rng = np.random.default_rng(5)
    near = 1 + np.arange(300) * np.finfo(float).eps
    far = np.concatenate([10.0 ** rng.uniform(-300, 300, 700), -(10.0 ** rng.uniform(-300, 300, 300)), near, [1.7e308, -1.7e308]])
    odd = np.concatenate([rng.normal(size=200), [np.inf] * 40, [-np.inf] * 40, [0.0, -0.0] * 30])
    rows = [("far", float(v)) for v in far] + [("odd", float(v)) for v in odd] + [("same", 3.0)] * 50 + [(None, float(v)) for v in near]
    rows += [("none", None)] * 20
    df = spark.createDataFrame(rows, "k string, v double").repartition(3)
    probs = [0.0, 0.05, 0.3, 0.5, 0.77, 0.95, 1.0]
    found = [{r.k: r.q for r in order_stats.quantiles(df, ["k"], {"q": F.col("v")}, probs, hot_rows=h).collect()} for h in (2, 10**9)]
    assert found[0].keys() == found[1].keys() and found[0]["none"] is None
    for k in ("far", "odd", "same", None):
        assert np.array_equal(found[0][k], found[1][k], equal_nan=True)


def test_spline_columns_do_not_multiply(spark):
    df = spark.createDataFrame([("d", float(i)) for i in range(40)], "dataset string, x double")
    out, _ = anchors.sparse_design(df, [anchors.BS("x", 7, 6)])
    assert len(out._jdf.queryExecution().optimizedPlan().toString()) < 200_000
    assert out.count() == 40


@pytest.mark.parametrize(
    "name", ["f14_linear_columns", "f14_linear_preprocessing", "m03_project_design", "m11_logistic_offset", "m16_anchor_boosting", "m17_refit_leaves"]
)
def test_lines_are_read_once(spark, monkeypatch, tmp_path, name):
    """Queries with several passes read, join and shuffle the lines in one of them only."""
    n, seen = 600, spark.sparkContext.accumulator(0)
    rng = np.random.default_rng(2)
    places = ["AFRICA", "AMERICA", "ASIA", "EUROPE", "MIDDLE EAST"]
    tables = {
        "region": spark.createDataFrame(list(enumerate(places)), "r_regionkey bigint, r_name string"),
        "nation": spark.createDataFrame([(i, i) for i in range(5)], "n_nationkey bigint, n_regionkey bigint"),
        "customer": spark.createDataFrame([(i, i % 5, "ab"[i // 5 % 2]) for i in range(40)], "c_custkey bigint, c_nationkey bigint, c_mktsegment string"),
        "orders": spark.createDataFrame(
            [(i, i % 40, "O", date(1995, 1, 1), ["1-URGENT", "2-HIGH", "3-MEDIUM", "4-NOT SPECIFIED", "5-LOW"][i % 5 - i // 7 % 2]) for i in range(200)],
            "o_orderkey bigint, o_custkey bigint, o_orderstatus string, o_orderdate date, o_orderpriority string",
        ),
        "lineitem": spark.createDataFrame(
            [
                (i // 3, i % 3, i, i, float(q), float(np.exp(10.4 + 0.02 * q * e)), i % 7 / 100, i % 5 / 100, "RN"[i % 2])
                for i, (q, e) in enumerate(zip(rng.integers(1, 50, n), rng.normal(size=n), strict=True))
            ],
            "l_orderkey bigint, l_linenumber bigint, l_partkey bigint, l_suppkey bigint, l_quantity double, l_extendedprice double, l_discount double, l_tax double, l_returnflag string",
        ),
    }

    def look(batches):
        for b in batches:
            seen.add(b.num_rows)
            yield b

    def table(session, sf, which):
        df = session.read.parquet(f"{sf}/{which}.parquet")
        return df.mapInArrow(look, df.schema) if which == "lineitem" else df

    for k, v in tables.items():
        v.write.parquet(f"{tmp_path}/{k}.parquet")
    monkeypatch.setattr(roles, "table", table)
    load_all()[name].run(spark, str(tmp_path)).write.format("noop").mode("overwrite").save()
    assert seen.value == n
