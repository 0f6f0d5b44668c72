"""Data-shared lasso by blocks against descent on the whole interacted matrix."""

import time

import numpy as np
import pandas as pd
import pytest

from cohortlens.operators import linear as lin


def moments(n=300, p=4, sets=3, seed=0):
    rng = np.random.default_rng(seed)
    d = rng.integers(0, sets, n)
    x = rng.normal(size=(n, p)) + d[:, None] * 0.5
    y = x @ np.linspace(1, -1, p) + (d == 1) * x[:, 0] + 0.3 * d + rng.normal(size=n)
    full = np.column_stack([x, y])
    envs = {(str(k),): full[d == k] for k in range(sets)}
    n_, s_, c_ = {}, {}, {}
    for k, v in envs.items():
        n_[k], s_[k], c_[k] = np.full((p + 1, p + 1), float(len(v))), np.repeat(v.sum(0)[:, None], p + 1, 1), v.T @ v
    return lin.Moments([*(f"x{i}" for i in range(p)), "y"], n_, s_, c_), d, x, y


def whole_path(d, x, y, ratio, alphas, l1):
    """The interacted columns in full, scaled as the moments scale them."""
    sets = d.max() + 1
    z = (x - x.mean(0)) / x.std(0)
    ones = (d[:, None] == np.arange(sets)).astype(float)
    dev = [np.where(d[:, None] == g, z - z[d == g].mean(0), 0.0) for g in range(sets)]
    v = np.column_stack([z, ones, *dev])
    c = v - v.mean(0)
    r = ratio * np.sqrt(ones.mean(0))
    f = np.concatenate([np.ones(x.shape[1]), r, np.repeat(r, x.shape[1])])
    b = lin.elastic_net(c.T @ c / len(y), c.T @ (y - y.mean()) / len(y), alphas, l1, f, f)
    p = x.shape[1]
    raw = b[:, :p] / x.std(0)
    return raw, y.mean() - b @ v.mean(0) - raw @ x.mean(0)


@pytest.mark.parametrize("l1", [1.0, 0.5])
@pytest.mark.parametrize("ratio", [0.3, 2.0])
def test_blocks_against_whole(l1, ratio):
    m, d, x, y = moments()
    alphas = [0.5, 0.1, 0.01]
    fits = lin.fit_data_shared(m, ratio, alphas, l1)
    coef, intercept = whole_path(d, x, y, ratio, alphas, l1)
    np.testing.assert_allclose([f.coef for f in fits], coef, atol=1e-6)
    np.testing.assert_allclose([f.intercept for f in fits], intercept, atol=1e-6)
    assert all(f.params["converged"] for f in fits)
    assert not lin.fit_data_shared(m, ratio, [0.01], l1, max_iter=1)[0].params["converged"]


def test_thousand_columns_in_a_task(spark):
    """1,000 columns x 9 datasets: the whole matrix would have 10,009 columns."""
    m, *_ = moments(12_000, 1000, 9)

    def solve(ratio):
        start = time.time()
        fits = lin.fit_data_shared(m, ratio, [1.0], 1.0, tol=1e-3)
        return [lin.replace(f, params={**f.params, "seconds": time.time() - start}) for f in fits]

    fits = lin.in_tasks(spark, [1.0, 4.0], solve)
    assert [f.params["ratio"] for f in fits] == [1.0, 4.0] and all(f.params["converged"] for f in fits)
    assert all(len(f.coef) == 1000 and f.params["seconds"] < 240 for f in fits)
    assert pd.Series(fits[0].coef).abs().max() > 0
