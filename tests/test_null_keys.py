"""Null keys, gap checks and odd names keep their rows."""

import pytest
from pyspark.sql import functions as F

from cohortlens.operators import baselines, curves, sampling, sequential
from cohortlens.operators.preprocess import LinearPreprocessing


def test_null_groups(spark):
    df = spark.createDataFrame([("a", 95.0, 4.0), (None, 96.0, 4.1), ("a", 90.0, 4.2), (None, 91.0, 4.0)], "d string, sat double, y double")
    assert {r["d"] for r in baselines.score_po2_baseline(df, "sat", ["d"]).collect()} == {"a", None}
    band = spark.createDataFrame([("a", 10, 1.0), (None, 10, 2.0), (None, 10, 4.0)], "k string, n_target int, v double")
    assert {(r["k"], r["median"], r["sd"]) for r in curves.curve_band(band, ["k"], "v").collect()} == {("a", 1.0, 0.0), (None, 3.0, 1.0)}


@pytest.mark.parametrize("balanced", [False, True])
def test_null_keys_have_a_fold(spark, balanced):
    rows = [(k,) for k in [None, None, 1, 2, 2, 3] + list(range(10, 60)) + [7] * 40]
    got = sampling.group_folds(spark.createDataFrame(rows, "k int"), "k", 3, balanced).collect()
    assert len(got) == len(rows) and all(r["fold"] is not None for r in got)
    assert len({r["fold"] for r in got if r["k"] is None}) == 1


def test_balanced_folds_by_size_ranges(spark):
    """Sizes over several ranges; the order is that of one sort over all of them."""
    sizes = [1, 1, 1, 2, 3, 5, 8, 40, 41, 300, 4097, 4098, 9000]
    df = spark.createDataFrame([(k, n) for k, n in enumerate(sizes)], "k int, n int").withColumn("i", F.explode(F.sequence(F.lit(1), F.col("n"))))
    folds = {r["k"]: r["fold"] for r in sampling.group_folds(df, "k", 3, True).select("k", "fold").distinct().collect()}
    by_size = [folds[k] for k in sorted(folds, key=lambda k: -sizes[k]) if sizes[k] > 1]
    snake = [0, 1, 2, 2, 1, 0] * 3
    assert by_size == snake[: len(by_size)]
    windows = sampling.group_folds(df, "k", 3, True)._jdf.queryExecution().optimizedPlan().toString()
    assert "Window [" in windows and all("], [" in w for w in windows.split("\n") if "Window [" in w)


def test_outcome_window_of_no_hours_still_checks(spark):
    schema = "dataset string, stay_id int, time_h int, event double"
    whole = spark.createDataFrame([("a", 1, 0, 1.0), ("a", 1, 1, None)], schema)
    assert [r["event"] for r in sequential.outcome_window(whole, "event", 0, 0).orderBy("time_h").collect()] == [1.0, None]
    for rows in ([("a", 1, 0, 1.0), ("a", 1, 5, 0.0)], [("a", 1, 0, -1.0)]):
        with pytest.raises(Exception, match="gaps|negative"):
            sequential.outcome_window(spark.createDataFrame(rows, schema), "event", 0, 0).collect()


def test_odd_category_names(spark):
    df = spark.createDataFrame([(1.0, "1.5"), (2.0, "a`b"), (None, None), (4.0, "x y")], "v double, `c.d` string")
    prep = LinearPreprocessing(["v", "c.d"]).fit(df)
    out = prep.transform(df)
    assert out.count() == 4 and set(prep.features) <= set(out.columns) and "c.d_1.5" in prep.features
