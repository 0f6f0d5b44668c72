"""Boosted trees against a plain learner that sorts every feature."""

import numpy as np
import pandas as pd
import pytest
from pyspark.sql import functions as F

from cohortlens.operators import trees

X = ["a", "b", "c"]


def frame(n=900, seed=1):
    rng = np.random.default_rng(seed)
    a, b = rng.normal(size=n), rng.integers(0, 12, n).astype(float)
    c = np.where(rng.random(n) < 0.3, np.nan, rng.normal(size=n).round(1))
    y = np.sin(2 * a) + 0.2 * b + np.where(np.isnan(c), 1.5, c * (a > 0)) + 0.1 * rng.normal(size=n)
    return pd.DataFrame({"a": a, "b": b, "c": c, "y": y, "k": rng.choice(["u", "v", "w"], n), "w": rng.integers(1, 4, n).astype(float)})


def best_split(x, r, h, rows, l2):
    """(gain, -feature, threshold, missing left) by trying every value."""
    out = None
    for f in range(x.shape[1]):
        v = x[rows, f]
        for cut in np.unique(v[~np.isnan(v)]):
            for missing_left in (True, False):
                left = (v <= cut) | (np.isnan(v) & missing_left)
                if min(left.sum(), (~left).sum()) < trees.MIN_LEAF_ROWS:
                    continue
                part = lambda m: r[rows][m].sum() ** 2 / (h[rows][m].sum() + l2)
                gain = part(left) + part(~left) - part(left | True)
                if out is None or gain > out[0] + 1e-9:
                    out = (gain, f, cut, missing_left)
    return out


def plain(pdf, rounds, rate, leaves, depth, gamma=1.0, weighted=False, l2=0.0, binary=False):
    x, y = pdf[X].to_numpy(), pdf["y"].to_numpy()
    w = pdf["w"].to_numpy() if weighted else np.ones(len(y))
    start = np.log(y.mean() / (1 - y.mean())) if binary else y.mean()
    score = np.full(len(y), start)
    for _ in range(rounds):
        p = 1 / (1 + np.exp(-score))
        r, h = (y - p, p * (1 - p)) if binary else (y - score, np.ones(len(y)))
        if gamma != 1:
            means = pd.DataFrame({"k": pdf["k"], "r": w * r, "w": w}).groupby("k").sum()
            r = r + (gamma - 1) * (means["r"] / means["w"]).loc[pdf["k"]].to_numpy()
        open_ = [(np.arange(len(y)), 0, best_split(x, w * r, w * h, np.arange(len(y)), l2))]
        while len(open_) < leaves:
            can = [o for o in open_ if o[2] is not None and o[2][0] > 0 and o[1] < depth]
            if not can:
                break
            one = max(can, key=lambda o: o[2][0])
            open_ = [o for o in open_ if o is not one]
            rows, d, (_, f, cut, missing_left) = one
            v = x[rows, f]
            left = (v <= cut) | (np.isnan(v) & missing_left)
            open_ += [(s, d + 1, best_split(x, w * r, w * h, s, l2)) for s in (rows[left], rows[~left])]
        for rows, _, _ in open_:
            score[rows] += rate * (w * r)[rows].sum() / ((w * h)[rows].sum() + l2)
    return 1 / (1 + np.exp(-score)) if binary else score


@pytest.mark.parametrize(
    "options",
    [
        {"leaves": 8, "depth": 3},
        {"leaves": 6, "depth": 30},
        {"leaves": 5, "depth": 4, "weighted": True, "l2": 2.0},
        {"leaves": 4, "depth": 2, "gamma": 3.0},
        {"leaves": 4, "depth": 2, "gamma": 3.0, "weighted": True},
        {"leaves": 4, "depth": 2, "binary": True},
    ],
)
def test_against_plain_learner(spark, options):
    pdf = frame(400)
    if options.get("binary"):
        pdf["y"] = (pdf["y"] > 1.3).astype(float)
    df = spark.createDataFrame(pdf.assign(row=range(len(pdf)))).repartition(3)
    named = {"weight": "w"} if options.get("weighted") else {}
    model = trees.fit_anchor_boosting(
        df, X, "y", 2, options.get("gamma", 1.0), ["k"], options["depth"], 0.4,
        "binary" if options.get("binary") else "regression", leaves=options["leaves"], l2=options.get("l2", 0.0), bins=254, **named,
    )
    got = trees.predict(df, model).toPandas().sort_values("row")["yhat"]
    # Values of the first column are as many as rows; with 254 bins some thresholds are missing, so the fit may differ a little.
    exact = trees.cut_points(df, X)
    want = plain(pdf.assign(a=snapped(pdf["a"].to_numpy(), exact[0])), 2, 0.4, **options)
    np.testing.assert_allclose(got, want, atol=1e-9)


def snapped(v, cuts):
    """Values as the learner tells them apart: the number of their bin."""
    return np.searchsorted(cuts, v, "left").astype(float)


def test_cut_points(spark):
    rng = np.random.default_rng(0)
    v = np.concatenate([rng.normal(size=4000), np.full(3000, 0.25), -rng.integers(0, 50, 1000), [1e300, -1e300, 5e-324, 0.0, -0.0]])
    few = np.resize([3.0, -1.5, 7e-9, 0.0, 1e18], len(v))
    df = spark.createDataFrame(pd.DataFrame({"v": v, "few": few, "none": np.nan}))
    for parts in (1, 5):
        cuts = trees.cut_points(df.repartition(parts), ["v", "few", "none"], 64)
        assert [len(c) for c in cuts[1:]] == [4, 0]
        bins = np.searchsorted(cuts[0], v, "left")
        for k in range(len(cuts[0]) + 1):
            inside = v[bins == k]
            assert len(inside) and (len(inside) <= 2 * len(v) / 64 or len(np.unique(inside)) == 1)
        if parts == 1:
            first = cuts
        assert all(np.array_equal(a, b) for a, b in zip(first, cuts))


def test_partitions_play_no_part(spark):
    df = spark.createDataFrame(frame())
    one, many = (trees.fit_gbt(df.repartition(k), X, "y", 3) for k in (1, 7))
    assert [t.root for t in one.trees] == [t.root for t in many.trees]
    np.testing.assert_allclose(np.concatenate([t.values for t in one.trees]), np.concatenate([t.values for t in many.trees]))


def test_weights_are_repeated_rows(spark, monkeypatch):
    monkeypatch.setattr(trees, "MIN_LEAF_ROWS", 1)
    pdf = frame(300).assign(a=lambda d: d["a"].round(1))
    df = spark.createDataFrame(pdf)
    repeated = df.withColumn("again", F.explode(F.sequence(F.lit(1), F.col("w").cast("int"))))
    one = trees.fit_gbt(df, X, "y", 1, learning_rate=1.0, weight="w", leaves=4)
    two = trees.fit_gbt(repeated, X, "y", 1, learning_rate=1.0, leaves=4)
    assert one.trees[0].root == two.trees[0].root
    # The start score is without weights.
    np.testing.assert_allclose(np.add(one.trees[0].values, one.init), np.add(two.trees[0].values, two.init))


def test_written_scores_many_trees_and_refits(spark, monkeypatch):
    monkeypatch.setattr(trees, "PIN_EVERY", 2)
    df = spark.createDataFrame(frame(300))
    model = trees.fit_gbt(df, X, "y", 5, depth=2)
    monkeypatch.setattr(trees, "PIN_EVERY", 32)
    whole = trees.fit_gbt(df, X, "y", 5, depth=2)
    assert [t.root for t in whole.trees] == [t.root for t in model.trees]
    np.testing.assert_allclose(np.concatenate([t.values for t in whole.trees]), np.concatenate([t.values for t in model.trees]))
    stages = trees.predict(df, model, [1, 5]).toPandas()
    again = trees.refit_leaves(model, df, "y", 0.3)
    monkeypatch.setattr(trees, "PIN_EVERY", 2)
    for x, y in zip(trees.refit_leaves(model, df, "y", 0.3).trees, again.trees):
        np.testing.assert_allclose(x.values, y.values)
    monkeypatch.setattr(trees, "FEW_TREES", 0)
    batches = trees.predict(df, model, [1, 5])
    assert batches.columns == [*df.columns, "yhat_1", "yhat_5"]
    np.testing.assert_allclose(batches.toPandas()[["yhat_1", "yhat_5"]], stages[["yhat_1", "yhat_5"]], rtol=1e-12)


def test_many_groups(spark, monkeypatch):
    df = spark.createDataFrame(frame(300)).withColumn("k", F.when(F.col("b") > 2, F.col("b").cast("string")))
    few = trees.fit_anchor_boosting(df, X, "y", 2, 4.0, ["k"], 2)
    monkeypatch.setattr(trees, "MAX_LOOKUP_ROWS", 3)
    many = trees.fit_anchor_boosting(df, X, "y", 2, 4.0, ["k"], 2)
    assert [t.root for t in few.trees] == [t.root for t in many.trees]
    np.testing.assert_allclose(np.concatenate([t.values for t in few.trees]), np.concatenate([t.values for t in many.trees]))


def test_nothing_to_split(spark):
    df = spark.createDataFrame([(None, 1.0, 2.0), (None, 1.0, 4.0)], "a double, b double, y double")
    model = trees.fit_gbt(df, ["a", "b"], "y", 2)
    assert model.init == 3.0 and [len(t.values) for t in model.trees] == [1, 1]
    assert [r.yhat for r in trees.predict(df, model).collect()] == [3.0, 3.0]


def test_rows_are_read_in_blocks(spark, monkeypatch):
    """Passes read a row for thousands; with more groups than are sent, their means join the rows and blocks are packed again."""
    pdf = frame(4000)
    df = spark.createDataFrame(pdf).coalesce(1)
    cuts = trees.cut_points(df, X)
    more = {"y": F.col("y"), "w": F.lit(1.0), "score": F.lit(0.0)}
    data = trees._pin_blocks(trees._binned(df, X, cuts, more))
    assert data.count() <= 2
    [block] = trees._blocks(data.toArrow().to_batches())
    assert np.array_equal(block["y"], pdf["y"]) and block["bins"].shape == (4000, 3)
    assert np.array_equal(block["bins"][:, 0], np.searchsorted(cuts[0], pdf["a"]) + 1)
    few = trees.fit_anchor_boosting(df, X, "y", 2, gamma=3.0, group=["k"], weight="w")
    monkeypatch.setattr(trees, "MAX_LOOKUP_ROWS", 2)
    many = trees.fit_anchor_boosting(df, X, "y", 2, gamma=3.0, group=["k"], weight="w")
    for a, b in zip(few.trees, many.trees, strict=True):
        assert a.root == b.root and np.allclose(a.values, b.values, rtol=1e-9)


def test_missing_outcome_is_refused(spark):
    df = spark.createDataFrame(frame(100)).withColumn("y", F.when(F.col("a") > 0, F.col("y")))
    with pytest.raises(Exception, match="null"):
        trees.fit_gbt(df, X, "y", 1)
