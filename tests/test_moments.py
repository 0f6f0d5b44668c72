"""Packed moments of many columns and environments."""

import numpy as np
import pandas as pd
import pyarrow as pa
import pytest
from pyspark.sql import functions as F

from cohortlens.operators import moments as mo
from cohortlens.operators.linear import Moments


def wide(n=700, p=9, seed=2):
    rng = np.random.default_rng(seed)
    x = np.where(rng.random((n, p)) < 0.1, np.nan, rng.normal(size=(n, p)).round(3))
    pdf = pd.DataFrame(x, columns=[f"c{k}" for k in range(p)])
    return pdf.assign(e=rng.choice(["a", "b", None], n, p=[0.7, 0.2, 0.1]), f=rng.integers(0, 5, n), w=rng.integers(1, 4, n).astype(float))


def dense(pdf, cols, weight):
    x, w = pdf[cols].to_numpy(), pdf["w"].to_numpy() if weight else np.ones(len(pdf))
    seen, v = (~np.isnan(x)).astype(float), np.nan_to_num(x)
    return (seen * w[:, None]).T @ seen, (v * w[:, None]).T @ seen, (v * w[:, None]).T @ v


@pytest.mark.parametrize("weight", [None, "w"])
@pytest.mark.parametrize(
    "sizes",
    [{}, {"task_bytes": 0}, {"task_bytes": 0, "strip_bytes": 32 * 9 * 2, "block_rows": 50}, {"strip_bytes": 32 * 9 * 4}],
)
def test_strips(spark, weight, sizes):
    pdf = wide()
    cols = [c for c in pdf.columns if c.startswith("c")]
    df = spark.createDataFrame(pdf).repartition(5)
    strips = mo.moment_strips(df, cols, ["e", "f"], weight, **sizes)
    m = Moments.collect(strips, cols, ["e", "f"])
    groups = {(None if pd.isna(e) else e, f): g for (e, f), g in pdf.groupby(["e", "f"], dropna=False)}
    assert set(m.envs()) == set(groups)
    for key, g in groups.items():
        for got, want in zip((m.n[key], m.s[key], m.c[key]), dense(g, cols, weight)):
            np.testing.assert_allclose(got, want, atol=1e-9)


def test_long_form_of_strips(spark):
    pdf = wide(200)
    cols = [c for c in pdf.columns if c.startswith("c")]
    df = spark.createDataFrame(pdf)
    m, long = Moments.gather(df, cols, ["f"]), Moments.collect(mo.env_moments(df, cols, ["f"]), cols, ["f"])
    for key in m.envs():
        for a, b in ((m.n, long.n), (m.s, long.s), (m.c, long.c)):
            np.testing.assert_allclose(a[key], b[key], atol=1e-9)
    assert mo.moment_strips(df.limit(0), cols, ["f"]).count() == 0


def test_many_columns_and_environments(spark):
    """500 columns x 2,000 environments: 6 MB of sums each, 16 GB in all, of which a task holds one."""
    p, n_envs = 500, 2000
    x = [(F.pmod(F.col("id") * (2 * k + 3), F.lit(17)) - 8).cast("double").alias(f"c{k}") for k in range(p)]
    df = spark.range(0, 4 * n_envs, 1, 8).select((F.col("id") % n_envs).alias("env"), *x)
    strips = mo.moment_strips(df, [f"c{k}" for k in range(p)], ["env"])
    text = strips._jdf.queryExecution().executedPlan().toString()
    assert text.count("MapInArrow") == 1  # rows are dealt by environment, nothing is left to add up

    def told(batches):
        for b in batches:
            for k in range(b.num_rows):
                _, n, s, _, c = mo._read_strip(b.slice(k, 1), p)
                sums = [float(n.sum()), float(np.diag(c)[::7].sum()), float(s[3, 4])]
                yield pa.record_batch([b.column("env").slice(k, 1), pa.array([n.shape[0]]), *(pa.array([v]) for v in sums)], names=["env", "k", "n", "c", "s"])

    got = strips.mapInArrow(told, "env bigint, k bigint, n double, c double, s double").collect()
    assert len(got) == n_envs and {r["k"] for r in got} == {p} and {r["n"] for r in got} == {4.0 * p * p}
    for r in got[::97]:
        rows = np.array([[(i * (2 * k + 3)) % 17 - 8 for k in range(p)] for i in range(r["env"], 4 * n_envs, n_envs)], float)
        assert r["c"] == (rows[:, ::7] ** 2).sum() and r["s"] == rows[:, 3].sum()


def test_weights_leave_the_preprocessing_alone(spark):
    pdf = wide(300, 4).assign(y=lambda d: d["c0"].fillna(0) - d["c1"].fillna(0))
    cols = ["c0", "c1", "c2", "c3", "y"]
    df = spark.createDataFrame(pdf)
    m, plain = Moments.gather(df, cols, ["f"], "w"), Moments.gather(df, cols, ["f"])
    for a, b in zip(m.scaling(m.envs()), plain.scaling(plain.envs())):
        np.testing.assert_allclose(a, b)
    x = pdf[cols[:-1]]
    z = ((x.fillna(x.mean()) - x.mean()) / x.fillna(x.mean()).std(ddof=0)).to_numpy()
    w = pdf["w"].to_numpy()
    blocks = m.blocks(m.envs())
    total = sum(b.c for b in blocks.values())
    np.testing.assert_allclose(total[:-1, :-1], (z * w[:, None]).T @ z, atol=1e-8)
    np.testing.assert_allclose(sum(b.n for b in blocks.values()), w.sum())
