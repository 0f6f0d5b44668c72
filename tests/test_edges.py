"""Null keys, unlisted concepts, gaps and a source's own length of stay."""

import numpy as np
import pytest

from cohortlens.functions.joins import join_groups
from cohortlens.operators import anchors, cohort, linear, metrics, moments, order_stats, preprocess, sequential, summaries
from cohortlens.plans.cohort_extraction import extract_cohort


def test_join_groups(spark):
    a = spark.createDataFrame([("x", 1), (None, 2), ("y", 3)], "g string, v int")
    b = spark.createDataFrame([("x", 10), (None, 20), ("z", 30)], "g string, w int")
    rows = {tuple(r) for r in join_groups(a, b, ["g"], "full").collect()}
    assert rows == {("x", 1, 10), (None, 2, 20), ("y", 3, None), ("z", None, 30)}
    assert {r["v"] for r in join_groups(a, b, ["g"], "left_anti").collect()} == {3}


def test_null_groups_keep_their_rows(spark):
    rows = [(None, 1.0, 0.2), (None, 3.0, 0.6), ("b", 2.0, 0.4), ("b", 6.0, -0.1)]
    df = spark.createDataFrame(rows, "g string, y double, yhat double")
    got = {(r["g"], r["y"]): r["y_proj"] for r in moments.project_groups(df, ["y"], ["g"]).collect()}
    assert got == {(None, 1.0): -1.0, (None, 3.0): -1.0, ("b", 2.0): 1.0, ("b", 6.0): 1.0}
    assert moments.anchor_transform(df, ["y"], ["g"], 4.0).count() == 4
    assert metrics.clip_predictions(df, ["g"]).count() == 4
    for hot in (1, 4_000_000):
        q = order_stats.quantiles(df, ["g"], {"v": df["y"]}, [0.5], hot_rows=hot).collect()
        assert {r["g"]: r["v"] for r in q} == {None: [2.0], "b": [4.0]}
    out, names = anchors.interact(df, ["y"], "g")
    assert out.count() == 4 and len(names) == 4
    shares = summaries.category_shares(df.withColumn("c", df["y"].cast("string")), ["g"], "c").collect()
    assert {r["g"] for r in shares} == {None, "b"}


def test_null_environments_enter_moments(spark):
    df = spark.createDataFrame([(None, 1.0, 2.0), (None, 2.0, 4.5), ("b", 3.0, 6.0)], "dataset string, x double, y double")
    m = linear.Moments.collect(moments.env_moments(df, ["x", "y"], ["dataset"]), ["x", "y"])
    assert set(m.envs()) == {(None,), ("b",)}
    assert np.isclose(sum(m.n[e][-1, -1] for e in m.envs()), 3)


OBS = "dataset string, stay_id long, concept string, time_h long, value double"


def test_unlisted_concepts_make_no_rows(spark):
    rows = [("d", 1, "hr", h, 80.0) for h in range(2)] + [("d", 1, "other", h, 1.0) for h in range(10)]
    rows += [("d", 2, "hr", h, 70.0) for h in range(8)] + [("d", 3, "other", h, 1.0) for h in range(9)]
    obs = spark.createDataFrame(rows, OBS)
    assert cohort.concepts_wide(obs, ["hr"]).count() == 10
    sta = spark.createDataFrame([("d", k) for k in (1, 2, 3)], "dataset string, stay_id long")
    found = extract_cohort(obs, sta, ["hr"])
    assert {r["stay_id"] for r in found.dyn.collect()} == {2}
    found.release()


def test_own_length_of_stay(spark):
    obs = spark.createDataFrame([("d", 1, "hr", h, 80.0) for h in range(8)], OBS)
    stays = spark.createDataFrame([("d", 1, 0, 7, 0.3125)], "dataset string, stay_id long, start_h long, end_h long, los_icu double")
    found = extract_cohort(obs, stays.select("dataset", "stay_id"), ["hr"], stays=stays)
    assert [r["los_icu"] for r in found.los_icu.collect()] == [0.3125]
    found.release()


def test_gaps_and_negative_events_are_errors(spark):
    grid = [("d", 1, h, 0) for h in (1, 2, 50)]
    df = spark.createDataFrame(grid, "dataset string, stay_id long, time_h long, e int")
    bad = spark.createDataFrame([("d", 1, 0, 0), ("d", 1, 1, -1)], df.schema)
    for frame in (sequential.outcome_window(df, "e", 1, 3), sequential.set_window(df, "e", 0, 5, 1), sequential.outcome_window(bad, "e", 1, 1)):
        with pytest.raises(Exception, match="gaps|negative"):
            frame.collect()


def test_tree_preprocessing_without_categories(spark):
    df = spark.createDataFrame([(1.0,), (2.0,)], "x double")
    p = preprocess.TreePreprocessing(["x"]).fit(df)
    assert p.transform(df).count() == 2
