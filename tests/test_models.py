"""Model grids and metrics against small dense computations."""

import numpy as np
import pandas as pd
import pytest
from pyspark.sql import functions as F

from cohortlens.operators import curves as cu
from cohortlens.operators import linear as lin
from cohortlens.operators import metrics as me
from cohortlens.operators import moments as mo
from cohortlens.operators import order_stats as os_
from cohortlens.operators import sampling as sa
from cohortlens.operators import trees
from cohortlens.operators.anchors import BS, design_matrix
from cohortlens.plans.learning import learning_curve

COLS = ["a", "b", "c", "y"]


@pytest.fixture(scope="module")
def data():
    rng = np.random.default_rng(3)
    n = 600
    d = rng.choice(["u", "v", "w"], n, p=[0.6, 0.3, 0.1])
    shift = {"u": 0.0, "v": 2.0, "w": -3.0}
    x = rng.normal(size=(n, 3)) + np.array([shift[k] for k in d])[:, None] * [1, 0.5, 0]
    y = 1 + x @ [1.0, -2.0, 0.5] + np.array([shift[k] for k in d]) + rng.normal(size=n)
    pdf = pd.DataFrame(x, columns=["a", "b", "c"]).assign(y=y, dataset=d, pid=rng.integers(0, 80, n))
    return pdf


def _moments(spark, pdf, by=("dataset",)):
    df = spark.createDataFrame(pdf)
    return lin.Moments.collect(mo.env_moments(df, COLS, list(by)), COLS, by)


def _scaled(pdf):
    x = pdf[COLS[:3]]
    x = x.fillna(x.mean())
    return ((x - x.mean()) / x.std(ddof=0)).to_numpy()


def _penalised_gap(x, y, b, alpha, l1):
    """Largest violation of the optimality conditions of the elastic net."""
    g = x.T @ (y - x @ b) / len(y) - alpha * (1 - l1) * b
    active = b != 0
    on = np.abs(g[active] - alpha * l1 * np.sign(b[active])).max() if active.any() else 0.0
    off = np.maximum(np.abs(g[~active]) - alpha * l1, 0).max() if (~active).any() else 0.0
    return max(on, off)


def test_both_moment_paths_agree(spark, data):
    df = spark.createDataFrame(data.assign(a=data["a"].where(data["a"] < 1.5)))
    key = ["dataset", "i", "j"]
    one = mo._moments_by_expression(df, COLS, ["dataset"], None, None).toPandas().sort_values(key)
    two = mo._moments_by_blocks(df, COLS, ["dataset"], None, None).toPandas().sort_values(key)
    np.testing.assert_allclose(one[list(mo.MOMENT_FIELDS)], two[list(mo.MOMENT_FIELDS)], rtol=1e-9, atol=1e-9)


def test_anchor_fit_equals_fit_on_transformed_rows(spark, data):
    m = _moments(spark, data)
    x, y = _scaled(data), data["y"].to_numpy()
    y = y - y.mean()
    for gamma in (1.0, 4.0, 100.0):
        proj = lambda v: pd.Series(v).groupby(data["dataset"].to_numpy()).transform("mean").to_numpy()
        k = gamma**-0.5
        xt = np.column_stack([k * v + (1 - k) * proj(v) for v in x.T])
        yt = k * y + (1 - k) * proj(y)
        fit = lin.fit_anchor(m, [gamma], [0.05], [0.5])[0]
        b = np.asarray(fit.coef) * data[COLS[:3]].std(ddof=0).to_numpy()
        assert _penalised_gap(xt, yt, b, 0.05, 0.5) < 1e-9


def test_gamma_one_without_penalty_is_least_squares(spark, data):
    fit = lin.fit_anchor(_moments(spark, data), [1.0], [0.0], [0.0])[0]
    design = np.column_stack([np.ones(len(data)), data[COLS[:3]]])
    want = np.linalg.lstsq(design, data["y"], rcond=None)[0]
    np.testing.assert_allclose([fit.intercept, *fit.coef], want, rtol=1e-8)


def test_missing_cells_are_imputed_and_scaled_from_moments(spark, data):
    holes = data.assign(a=data["a"].where(data.index % 4 != 0), c=data["c"].where(data.index % 3 != 0))
    for envs in ([("u",), ("v",), ("w",)], [("u",), ("w",)]):
        sub = holes[holes["dataset"].isin([e[0] for e in envs])]
        fit = lin.fit_linear(_moments(spark, holes), [0.1], 0.5, envs)[0]
        x = _scaled(sub)
        filled = sub[COLS[:3]].fillna(sub[COLS[:3]].mean())
        b = np.asarray(fit.coef) * filled.std(ddof=0).to_numpy()
        y = sub["y"].to_numpy()
        assert _penalised_gap(x, y - y.mean(), b, 0.1, 0.5) < 1e-9
        got = spark.createDataFrame(sub).select(fit.predictor(COLS[:3]).alias("p")).toPandas()["p"].mean()
        assert abs(got - y.mean()) < 1e-9


def test_data_shared_lasso_on_explicit_columns(spark, data):
    fit = lin.fit_data_shared(_moments(spark, data), 1.5, [0.05], 1.0)[0]
    x, y, d = _scaled(data), data["y"].to_numpy(), data["dataset"].to_numpy()
    names = ["u", "v", "w"]
    hot = np.column_stack([(d == k).astype(float) for k in names])
    inter = np.hstack([(x - x[d == k].mean(axis=0)) * (d == k)[:, None] for k in names])
    full = np.hstack([x, hot, inter])
    full = full - full.mean(axis=0)
    r = 1.5 * np.sqrt([np.mean(d == k) for k in names])
    factor = np.concatenate([np.ones(3), r, np.repeat(r, 3)])
    b = lin.elastic_net(full.T @ full / len(y), full.T @ (y - y.mean()) / len(y), [0.05], 1.0, factor, factor)[0]
    scale = data[COLS[:3]].std(ddof=0).to_numpy()
    np.testing.assert_allclose(np.asarray(fit.coef) * scale, b[:3], atol=1e-6)


def test_group_penalty_with_equal_weights_is_root_share():
    n = np.array([10.0, 30.0, 60.0])
    w = n / n.sum()
    np.testing.assert_allclose(lin.group_penalties(n, w, n / n.sum() ** 2), lin.group_penalties(n))


def test_weighted_penalties_with_inverse_size_weights(spark, data):
    n = data.groupby("dataset").size()
    df = spark.createDataFrame(data.assign(w=1 / data["dataset"].map(n) / 3))
    got = lin.weighted_penalties(df, "w")
    np.testing.assert_allclose(got, 1 / np.sqrt((1 / n).sum() * n.to_numpy()))


def test_anticausal_in_the_original_basis(spark, data):
    fit = lin.fit_anticausal(_moments(spark, data), [0.02], [0.1])[0]
    x, y = _scaled(data), data["y"].to_numpy()
    means = pd.DataFrame(x).groupby(data["dataset"].to_numpy()).mean().to_numpy()
    n = data.groupby("dataset").size().to_numpy()
    cov = np.cov(means.T, fweights=n)
    values, vectors = np.linalg.eigh(cov)
    penalty = 100 * (np.maximum(values, 1e-10) + 2.0)
    ridge = vectors @ np.diag(penalty) @ vectors.T
    b = np.linalg.solve(x.T @ x / len(y) + 0.1 * ridge, x.T @ (y - y.mean()) / len(y))
    np.testing.assert_allclose(np.asarray(fit.coef) * data[COLS[:3]].std(ddof=0).to_numpy(), b, rtol=1e-8)


def test_logistic_conditions_and_constant_outcome(spark, data):
    label = (data["y"] > 1).astype(float)
    pdf = data.assign(y=label)
    df = spark.createDataFrame(pdf)
    x = data[COLS[:3]].to_numpy()
    for fit in lin.fit_logistic(df, COLS[:3], "y", [0.1, 0.01], 0.5):
        p = 1 / (1 + np.exp(-(fit.intercept + x @ fit.coef)))
        alpha = fit.params["alpha"]
        g = x.T @ (label - p) / len(label) - alpha * 0.5 * fit.coef
        on = fit.coef != 0
        assert np.abs(g[on] - alpha * 0.5 * np.sign(fit.coef[on])).max() < 1e-6
        assert (np.abs(g[~on]) <= alpha * 0.5 + 1e-6).all()
        assert abs((label - p).mean()) < 1e-6
    zero = lin.fit_logistic(df.where("y = 0"), ["a"], "y", [0.1])[0]
    assert zero.intercept == pytest.approx(-np.log((label == 0).sum())) and zero.coef[0] == 0


def test_offset_refit_limits(spark, data):
    m = _moments(spark, data)
    prior = lin.fit_linear(m, [0.1], 0.0, [("u",)])[0]
    scale = m.scaling([("u",)])[1][:-1]
    far, near = lin.fit_with_offset(m, prior, scale, [1e9, 0.0], envs=[("v",)])
    np.testing.assert_allclose(far.coef, prior.coef, atol=1e-6)
    free = lin.fit_linear(m, [0.0], 0.0, [("v",)])[0]
    np.testing.assert_allclose(near.coef, free.coef, atol=1e-8)
    with pytest.raises(ValueError):
        lin.pick_alpha([prior], 0.2)


def test_trees_learn_and_refit_limits(spark, data):
    df = spark.createDataFrame(data.assign(a=data["a"].where(data.index % 9 != 0)))
    model = trees.fit_gbt(df, COLS[:3], "y", rounds=7, learning_rate=0.5)
    out = trees.predict(df, model, [1, 7]).toPandas()
    errors = [((out["y"] - out[f"yhat_{k}"]) ** 2).mean() for k in (1, 7)]
    assert errors[1] < errors[0] < data["y"].var()
    assert trees.refit_leaves(model, df, "y", 1.0) is model
    again = trees.refit_leaves(model, df, "y", 0.0)
    for old, new in zip(model.trees, again.trees):
        np.testing.assert_allclose(old.values, new.values, rtol=1e-6, atol=1e-8)
    plain = trees.fit_anchor_boosting(df, COLS[:3], "y", 2, gamma=1.0, group=["dataset"])
    strong = trees.fit_anchor_boosting(df, COLS[:3], "y", 2, gamma=10.0, group=["dataset"])
    assert plain.trees != strong.trees
    binary = spark.createDataFrame(data.assign(y=(data["y"] > 1).astype(float)))
    fit = trees.fit_gbt(binary, COLS[:3], "y", 3, objective="binary")
    p = trees.predict(binary, fit).toPandas()
    assert p["yhat"].between(0, 1).all() and p[p["y"] == 1]["yhat"].mean() > p[p["y"] == 0]["yhat"].mean()


def _skewed(spark):
    """One group holds two thirds of the rows, half of them the same value."""
    rng = np.random.default_rng(5)
    k = np.where(np.arange(3000) < 2000, "big", np.where(np.arange(3000) % 2 == 0, "x", "z"))
    v = np.where(np.arange(3000) % 2 == 0, 0.5, rng.normal(size=3000).round(3))
    return pd.DataFrame({"k": k, "v": v, "y": rng.integers(0, 2, 3000).astype(float)})


@pytest.mark.parametrize("hot_rows", [10, 600, 10**9])
def test_quantiles_are_exact_for_any_group_size(spark, hot_rows):
    pdf = _skewed(spark)
    probs = [0.0, 0.05, 0.25, 0.5, 0.9, 0.999, 1.0]
    got = os_.quantiles(spark.createDataFrame(pdf), ["k"], {"q": F.col("v")}, probs, hot_rows=hot_rows, extra={"m": F.avg("q")})
    for r in got.collect():
        want = pdf[pdf["k"] == r["k"]]["v"]
        np.testing.assert_allclose(r["q"], np.quantile(want, probs), atol=1e-12)
        assert r["m"] == pytest.approx(want.mean())


@pytest.mark.parametrize("hot_rows", [10, 600, 10**9])
def test_rank_metrics_for_any_group_size(spark, hot_rows):
    pdf = _skewed(spark)
    pdf["yhat"] = 1 / (1 + np.exp(-pdf["v"]))
    df = spark.createDataFrame(pdf)
    got = {r["k"]: r for r in me.rank_metrics(df, ["k"], hot_rows).collect()}
    flipped = {r["k"]: r["roc"] for r in me.auroc(df.withColumn("yhat", 1 - F.col("yhat")), ["k"], hot_rows).collect()}
    for k, g in pdf.groupby("k"):
        rank = g["v"].rank()
        pos, neg = (g["y"] == 1).sum(), (g["y"] == 0).sum()
        roc = (rank[g["y"] == 1].sum() - pos * (pos + 1) / 2) / (pos * neg)
        assert got[k]["roc"] == pytest.approx(roc)
        assert flipped[k] == pytest.approx(1 - roc)
        ap = 0.0
        for t in sorted(g["v"].unique(), reverse=True):
            at, above = g[g["v"] == t], g[g["v"] >= t]
            ap += (at["y"] == 1).sum() / pos * (above["y"] == 1).mean()
        assert got[k]["auprc"] == pytest.approx(ap)


def test_projection_splits_the_error(spark, data):
    df = spark.createDataFrame(data.assign(yhat=1.0))
    mse = me.regression_metrics(df.withColumn("all", F.lit(1)), ["all"]).first()["mse"]
    part = me.projected_metrics(df.withColumn("all", F.lit(1)), ["all"], ["dataset"]).first()["proj_residuals_sq"]
    r = data["y"] - 1.0
    rest = ((r - r.groupby(data["dataset"]).transform("mean")) ** 2).mean()
    assert mse == pytest.approx(part + rest)


def test_samples_are_nested_and_folds_keep_groups(spark, data):
    df = spark.createDataFrame(data)
    n = data["pid"].nunique()
    s = sa.nested_samples(df, "pid", [0, 1], [5, 20, 60, 5000]).toPandas()
    sets = {k: set(g["pid"]) for k, g in s.groupby(["seed", "n_target"])}
    assert set(sets) == {(a, b) for a in (0, 1) for b in (5, 20, 60)}
    for seed in (0, 1):
        assert sets[seed, 5] < sets[seed, 20] < sets[seed, 60]
        assert [len(sets[seed, b]) for b in (5, 20, 60)] == [5, 20, 60]
    assert sets[0, 20] != sets[1, 20]
    ranks = sa.nested_ranks(df, "pid", [0], 10**6).toPandas()
    assert sorted(ranks["rank"]) == list(range(1, n + 1))
    for balanced in (False, True):
        f = sa.group_folds(df, "pid", 5, balanced).toPandas()
        assert (f.groupby("pid")["fold"].nunique() == 1).all() and f["fold"].between(0, 4).all()
    sizes = f.groupby("fold").size()
    assert sizes.max() - sizes.min() <= data.groupby("pid").size().max()


def test_learning_curve_equals_direct_fits(spark, data):
    holes = data.assign(a=data["a"].where(data.index % 4 != 0))
    train, test = holes[holes.index % 3 != 0], holes[holes.index % 3 == 0]
    got = learning_curve(
        spark.createDataFrame(train), spark.createDataFrame(test), COLS[:3], "y", "pid", [0, 1], [0.1], [0.0], [20, 60]
    ).toPandas()
    folds = sa.group_folds(spark.createDataFrame(train), "pid").select("pid", "fold").distinct().toPandas()
    ranks = sa.nested_ranks(spark.createDataFrame(train), "pid", [0, 1], 60).toPandas()

    def predict(tr, te):
        mean = tr[COLS[:3]].mean()
        x = tr[COLS[:3]].fillna(mean)
        sd = x.std(ddof=0)
        z = ((x - mean) / sd).to_numpy()
        b = np.linalg.solve(z.T @ z / len(z) - np.outer(z.mean(0), z.mean(0)) + 0.1 * np.eye(3), z.T @ (tr["y"] - tr["y"].mean()) / len(z))
        return tr["y"].mean() + ((te[COLS[:3]].fillna(mean) - mean) / sd).to_numpy() @ b

    for (seed, n), rows in got[got["metric"] == "mse"].groupby(["seed", "n_target"]):
        chosen = ranks[(ranks["seed"] == seed) & (ranks["rank"] <= n)]["pid"]
        sample = train[train["pid"].isin(chosen)].merge(folds, on="pid")
        assert ((test["y"] - predict(sample, test)) ** 2).mean() == pytest.approx(rows["test_value"].iloc[0])
        sse = sum(
            ((g["y"] - predict(sample[sample["fold"] != f], g)) ** 2).sum() for f, g in sample.groupby("fold")
        )
        assert sse / len(sample) == pytest.approx(rows["cv_value"].iloc[0])


def test_out_of_fold_predictions_skip_the_fold(spark, data):
    out, full = lin.fit_predict_cv(spark.createDataFrame(data), COLS[:3], "y", "pid", 0.0)
    pdf = out.toPandas()
    for f, g in pdf.groupby("fold"):
        rest = pdf[pdf["fold"] != f]
        design = np.column_stack([np.ones(len(rest)), rest[COLS[:3]]])
        b = np.linalg.lstsq(design, rest["y"], rcond=None)[0]
        np.testing.assert_allclose(g["yhat_cv"], b[0] + g[COLS[:3]].to_numpy() @ b[1:], rtol=1e-6)
    assert full.coef.shape == (3,)


def test_monotone_spline():
    x = np.log(np.array([25, 50, 100, 200, 400, 800, 1600.0]))
    y = np.array([1.0, 0.8, 0.85, 0.6, 0.55, 0.56, 0.5])
    new = np.linspace(x[0] - 1, x[-1] + 1, 60)
    fit = cu.monotone_spline(x, y, new, increasing=False)
    assert (np.diff(fit) <= 1e-6).all()
    # A falling quadratic is neither penalised nor bent: it comes back unchanged.
    quadratic = 2 - 0.1 * x - 0.02 * x**2
    np.testing.assert_allclose(cu.monotone_spline(x, quadratic, x, False), quadratic, atol=1e-8)
    low, high = fit[new < x[0]], fit[new > x[-1]]
    assert np.abs(np.diff(low, 2)).max() < 1e-9 and np.abs(np.diff(high, 2)).max() < 1e-9
    np.testing.assert_allclose(fit, -cu.monotone_spline(x, -y, new, True))


def test_isotonic_against_pooling(spark):
    rng = np.random.default_rng(1)
    rows, want = [], {}
    for k in range(4):
        y = rng.normal(size=9) - np.arange(9) * 0.3
        rows += [(k, 10 * (i + 1), float(v)) for i, v in enumerate(y)]
        pools = []
        for v in -y:
            pools.append([v, 1])
            while len(pools) > 1 and pools[-2][0] > pools[-1][0]:
                b, a = pools.pop(), pools.pop()
                pools.append([(a[0] * a[1] + b[0] * b[1]) / (a[1] + b[1]), a[1] + b[1]])
        want[k] = [-v for v, m in pools for _ in range(m)]
    df = spark.createDataFrame(rows, "k int, n int, v double")
    got = cu.isotonic(df, ["k"], "n", "v", False).toPandas().sort_values(["k", "n"])
    for k, g in got.groupby("k"):
        np.testing.assert_allclose(g["fit"], want[k], atol=1e-12)


def test_spline_design_spans_polynomials_per_dataset(spark):
    rng = np.random.default_rng(2)
    pdf = pd.DataFrame({"dataset": np.repeat(["p", "q"], 60), "year": rng.integers(2000, 2020, 120)})
    pdf["v"] = np.where(pdf["dataset"] == "p", 1.0, -1.0) * (pdf["year"] - 2010) ** 2.0
    df, names = design_matrix(spark.createDataFrame(pdf), [BS("year", 4)])
    assert len(names) == 10
    out = mo.project_design(df, ["v"], "z", centre=False).toPandas()
    np.testing.assert_allclose(out["v_proj"], out["v"], atol=1e-5)


def test_all_metrics_agree_with_the_single_ones(spark, data):
    df = spark.createDataFrame(data.assign(yhat=data["a"] / 10 + 0.3))
    one = me.all_metrics(df, ["dataset"], "regression", ["pid"]).toPandas().set_index("dataset")
    for part in (me.residual_metrics(df, ["dataset"]), me.regression_metrics(df, ["dataset"]), me.absolute_quantiles(df, ["dataset"])):
        want = part.toPandas().set_index("dataset")
        pd.testing.assert_frame_equal(one[want.columns].sort_index(), want.sort_index())
    label = df.withColumn("y", (F.col("y") > 1).cast("double"))
    two = me.all_metrics(label, ["dataset"], "binary", ["pid"]).toPandas().set_index("dataset")
    parts = [
        me.residual_metrics(label, ["dataset"], True),
        me.binary_losses(label, ["dataset"]),
        me.rank_metrics(label, ["dataset"]),
        me.log_loss_quantiles(label, ["dataset"]),
    ]
    for part in parts:
        want = part.toPandas().set_index("dataset")
        pd.testing.assert_frame_equal(two[want.columns].sort_index(), want.sort_index())


def test_study_results_equal_scored_rows(spark, data):
    from cohortlens.plans import study

    pdf = data.assign(split=np.where(data["pid"] % 3 == 0, "test", "train_val"))
    df = spark.createDataFrame(pdf)
    res = study.loeo_study(df, COLS[:3], "y", [1.0, 4.0], [0.1], [0.5]).toPandas()
    assert res["run_id"].nunique() == 2 * 7
    m = study.study_moments(df, COLS[:3], "y")
    fits = study.fit_grid(m, study.subsets(["u", "v", "w"]), [1.0, 4.0], [0.1], [0.5])
    for run, _, fit in fits[:4]:
        scored = df.withColumn("p", fit.predictor(COLS[:3])).toPandas()
        for (d, s), g in scored.groupby(["dataset", "split"]):
            row = res[(res["run_id"] == run) & (res["target"] == d) & (res["split"] == s)].set_index("metric")["value"]
            assert row["mse"] == pytest.approx(((g["y"] - g["p"]) ** 2).mean())
            assert row["mean_residual"] == pytest.approx((g["y"] - g["p"]).mean())


def test_separable_outcome_is_reported(spark):
    x = np.linspace(-1, 1, 60)
    df = spark.createDataFrame(pd.DataFrame({"x": x, "y": (x > 0).astype(float)}))
    with pytest.warns(UserWarning, match="did not converge"):
        free, held = lin.fit_logistic(df, ["x"], "y", [0.0, 0.1], max_iter=12)
    assert not free.params["converged"] and held.params["converged"]
    assert free.coef[0] > held.coef[0] > 0


def test_logistic_steps_never_raise_the_loss(spark):
    """Far tails and a large offset, where whole Newton steps overshoot."""
    rng = np.random.default_rng(11)
    x = np.concatenate([rng.normal(size=400), [60.0, -55.0]])
    y = (rng.random(402) < 1 / (1 + np.exp(-2 * np.clip(x, -3, 3)))).astype(float)
    pdf = pd.DataFrame({"x": x, "y": y, "o": np.where(np.arange(402) % 7 == 0, 6.0, -6.0), "w": rng.integers(1, 4, 402).astype(float)})
    fit = lin.fit_logistic(spark.createDataFrame(pdf).repartition(3), ["x"], "y", [0.05], 0.0, "o", "w")[0]
    assert fit.params["converged"]
    mu = 1 / (1 + np.exp(-(fit.intercept + fit.coef[0] * x + pdf["o"])))
    r = (pdf["w"] * (y - mu)).to_numpy()
    assert abs(r.sum() / pdf["w"].sum()) < 1e-6
    assert abs((r * x).sum() / pdf["w"].sum() - 0.05 * fit.coef[0]) < 1e-6
