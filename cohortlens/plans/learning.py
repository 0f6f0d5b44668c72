"""Learning curves from cumulative moments.

Rows are summed once per (seed, size bucket, fold). Buckets up to a size make its sample, and
a fold's training moments are the sum of the other folds, so no sample is ever copied or refit
from rows. Each (seed, size, l1 ratio, prior) is a small solve of its own.
"""

from __future__ import annotations

from collections.abc import Sequence

import numpy as np
import pandas as pd
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from ..operators.linear import Block, LinearModel, Moments, _sum, fit_linear, refit_block, squared_error
from ..operators.moments import MOMENT_FIELDS, env_moments
from ..operators.sampling import N_FOLDS, SIZES, hash_fold, nested_ranks, size_bucket

CURVE_SCHEMA = (
    "seed int, n_target int, model_idx int, alpha double, l1_ratio double, metric string, "
    "cv_value double, test_value double"
)


def _metrics(parts: list[tuple[Block, LinearModel, tuple]]) -> dict[str, float]:
    sums = [squared_error(b, m, s) for b, m, s in parts]
    n = sum(b.n for b, _, _ in parts)
    mse = sum(s[0] for s in sums) / n
    return {"mse": mse, "rmse": max(mse, 0.0) ** 0.5, "mean_residual": sum(s[1] for s in sums) / n}


def _paths(moments: Moments, envs, alphas, l1, prior: LinearModel | None) -> list[LinearModel]:
    if prior is None:
        return fit_linear(moments, alphas, l1, envs)
    scaling = (np.append(prior.means, 0.0), np.append(prior.params["scale"], 1.0))
    block = _sum(moments.blocks(envs, scaling).values())
    return refit_block(block, scaling, prior, alphas, l1, {"l1_ratio": float(l1)})


def _point(pdf: pd.DataFrame, cols, test: Moments, sizes, alphas, l1s, priors) -> pd.DataFrame:
    """One (seed, size, l1 ratio, prior): the path of penalties, in folds and on the whole sample."""
    first = pdf.iloc[0]
    seed, size, l1, idx = int(first["seed"]), int(first["size"]), float(l1s[int(first["l1_idx"])]), int(first["model_idx"])
    names = [c.split()[0] for c in CURVE_SCHEMA.split(", ")]
    if pdf["top"].max() < size:
        return pd.DataFrame([], columns=names)
    prior = priors[idx]
    m = Moments.of(pdf, cols, ["fold"])
    unit = np.ones(len(cols))
    per_fold = []
    for f in m.envs():
        train = [e for e in m.envs() if e != f]
        if train:
            per_fold.append((f, _paths(m, train, alphas, l1, prior)))
    full = _paths(m, m.envs(), alphas, l1, prior)
    out = []
    for a, alpha in enumerate(alphas):
        held_out = []
        for f, path in per_fold:
            scale = (np.append(path[a].means, 0.0), unit)
            held_out.append((m.blocks([f], scale)[f], path[a], scale))
        scale = (np.append(full[a].means, 0.0), unit)
        on_test = _metrics([(test.blocks(test.envs(), scale)[test.envs()[0]], full[a], scale)])
        cv = _metrics(held_out) if held_out else dict.fromkeys(on_test, np.nan)
        out += [(seed, sizes[size], idx, float(alpha), l1, name, cv[name], value) for name, value in on_test.items()]
    return pd.DataFrame(out, columns=names)


def sample_moments(moments: DataFrame, n_sizes: int) -> DataFrame:
    """(seed, size, fold, i, j, top, sums): moments of whole samples from those of the buckets between two sizes.

    At most folds x columns^2 / 2 rows a sample; ``top`` is the last bucket that has rows.
    """
    upto = moments.withColumn("size", F.explode(F.sequence(F.col("bucket"), F.lit(n_sizes - 1))))
    sums = [F.sum(f).alias(f) for f in MOMENT_FIELDS]
    return upto.groupBy("seed", "size", "fold", "i", "j").agg(F.max("bucket").alias("top"), *sums)


def learning_curve(
    train: DataFrame,
    test: DataFrame,
    features: Sequence[str],
    y: str,
    key: str,
    seeds: Sequence[int],
    alphas: Sequence[float],
    l1_ratios: Sequence[float] = (0.0,),
    sizes: Sequence[int] = SIZES,
    priors: Sequence[LinearModel] | None = None,
    k: int = N_FOLDS,
) -> DataFrame:
    """CV and test metrics per (seed, size, model) of one target.

    Without ``priors`` models are trained from scratch; imputation and scaling are learned
    inside each training fold. With priors (their sds in ``params['scale']``) each is refit.
    """
    n = train.select(F.count_distinct(key)).first()[0]
    sizes = [s for s in sizes if s <= n]
    if not sizes:
        raise ValueError("fewer groups than the smallest size")
    cols = [*features, y]
    ranks = nested_ranks(train, key, list(seeds), max(sizes))
    sampled = train.select(key, *cols).join(ranks, key)
    sampled = sampled.withColumns(
        {"bucket": size_bucket(F.col("rank"), sizes), "fold": hash_fold(F.col(key), k)}
    )
    moments = sample_moments(env_moments(sampled, cols, ["seed", "bucket", "fold"]), len(sizes))
    on_test = Moments.gather(test.withColumn("all", F.lit(0)), cols, ["all"])
    given = list(priors) if priors else [None]
    l1s, penalties = list(l1_ratios), list(alphas)
    models = [F.struct(F.lit(l).alias("l1_idx"), F.lit(k).alias("model_idx")) for l in range(len(l1s)) for k in range(len(given))]
    jobs = moments.withColumn("job", F.explode(F.array(*models))).select("*", "job.*").drop("job")

    def solve(pdf: pd.DataFrame) -> pd.DataFrame:
        return _point(pdf, cols, on_test, sizes, penalties, l1s, given)

    return jobs.groupBy("seed", "size", "l1_idx", "model_idx").applyInPandas(solve, CURVE_SCHEMA)


def filter_priors(df: DataFrame, col: str = "gamma", tol: float = 0.1, largest: float = 128.0) -> DataFrame:
    """Priors whose parameter is a power of two within ``tol`` and not above ``largest``."""
    e = F.log2(F.coalesce(F.col(col), F.lit(1.0)))
    return df.where((F.abs(e - F.round(e)) <= tol) & (F.coalesce(col, F.lit(1.0)) <= largest))


def filter_prior_alpha(df: DataFrame, col: str = "prior_alpha", decades: int = 3, tol: float = 0.01) -> DataFrame:
    """Rows whose prior penalty lies ``decades`` decades above the smallest."""
    lowest = df.agg(F.min(col)).first()[0]
    return df.where(F.abs(F.log10(F.col(col) / F.lit(lowest)) - decades) <= tol)
