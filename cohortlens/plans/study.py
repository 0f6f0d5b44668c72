"""Leave-one-environment-out study: fit grids on source subsets, score all, select.

Two passes over the data: per-environment moments (all fits and all squared-error metrics
follow from them), and, only where quantile or rank metrics are wanted, one scoring pass.
"""

from __future__ import annotations

from collections.abc import Iterator, Sequence
from itertools import combinations

import numpy as np
import pandas as pd
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql.types import StructType

from ..operators.linear import LinearModel, Moments, fit_anchor, squared_error
from ..operators.metrics import all_metrics, metrics_long
from ..session import pin

RESULT_SCHEMA = (
    "run_id string, sources array<string>, gamma double, alpha double, l1_ratio double, "
    "target string, split string, metric string, value double"
)


def subsets(sources: Sequence[str]) -> list[tuple[str, ...]]:
    """All sources, all but one, all but two."""
    n = len(sources)
    return [c for k in (n, n - 1, n - 2) for c in combinations(sorted(sources), k)]


def fit_grid(
    moments: Moments,
    sources: Sequence[Sequence[str]],
    gammas: Sequence[float],
    alphas: Sequence[float],
    l1_ratios: Sequence[float],
) -> list[tuple[str, tuple[str, ...], LinearModel]]:
    """(run id, sources, model) for every subset and parameter combination."""
    out = []
    for sub in sources:
        envs = [(d, "train_val") for d in sub if (d, "train_val") in moments.n]
        for m in fit_anchor(moments, gammas, alphas, l1_ratios, envs):
            run = f"{'+'.join(sub)}|{m.params['gamma']:g}|{m.params['alpha']:g}|{m.params['l1_ratio']:g}"
            out.append((run, tuple(sub), m))
    return out


def study_moments(df: DataFrame, features: Sequence[str], y: str) -> Moments:
    """Moments by (dataset, split): the one scan behind every fit."""
    cols = [*features, y]
    return Moments.gather(df, cols, ["dataset", "split"])


def _judge(moments: Moments, run: str, sub: Sequence[str], m: LinearModel) -> list[tuple]:
    """mse, rmse, r2 and mean residual of a model on every dataset and split, from moments.

    Exact for completely observed inputs and for inputs imputed by the model's own means.
    """
    rows = []
    scaling = (np.append(m.means, 0.0), np.ones(len(m.means) + 1))
    params = (m.params["gamma"], m.params["alpha"], m.params["l1_ratio"])
    for env, b in moments.blocks(moments.envs(), scaling).items():
        sse, res = squared_error(b, m, scaling)
        mse = sse / b.n
        var = b.c[-1, -1] / b.n - (b.s[-1] / b.n) ** 2
        values = {"mse": mse, "rmse": max(mse, 0.0) ** 0.5, "mean_residual": res / b.n}
        if var > 0:
            values["r2"] = 1 - mse / var
        rows += [(run, list(sub), *params, env[0], env[1], k, float(v)) for k, v in values.items()]
    return rows


def loeo_study(
    df: DataFrame,
    features: Sequence[str],
    y: str,
    gammas: Sequence[float],
    alphas: Sequence[float],
    l1_ratios: Sequence[float],
    sources: Sequence[str] | None = None,
) -> DataFrame:
    """Long results of the whole grid, written once. ``df`` has dataset, split, features, outcome.

    The moments are small and travel to the tasks; the grid of (subset, gamma, l1) is the
    distributed table, and each task solves and judges its own cells.
    """
    spark = df.sparkSession
    moments = study_moments(df, features, y)
    names = sorted({e[0] for e in moments.envs()}) if sources is None else list(sources)
    cells = [
        (list(sub), float(g), float(l1)) for sub in subsets(names) for g in gammas for l1 in l1_ratios
    ]
    grid = spark.createDataFrame(cells, "sources array<string>, gamma double, l1_ratio double")
    columns = [f.name for f in StructType.fromDDL(RESULT_SCHEMA)]

    def solve(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for batch in batches:
            for cell in batch.itertuples(index=False):
                fits = fit_grid(moments, [list(cell.sources)], [cell.gamma], alphas, [cell.l1_ratio])
                rows = [r for run, sub, m in fits for r in _judge(moments, run, sub, m)]
                yield pd.DataFrame(rows, columns=columns)

    tasks = min(len(cells), spark.sparkContext.defaultParallelism)
    return pin(grid.repartition(tasks).mapInPandas(solve, RESULT_SCHEMA))


def score_study(
    df: DataFrame,
    features: Sequence[str],
    y: str,
    fits,
    task: str = "regression",
    group: Sequence[str] | None = None,
) -> DataFrame:
    """All metrics of the chosen fits by (run, target, split): the scoring pass."""
    scored = [F.struct(F.lit(run).alias("run_id"), m.predictor(features).alias("yhat")) for run, _, m in fits]
    keep = [c for c in (group or []) if c not in ("dataset", "split")]
    long = df.select(
        F.col("dataset").alias("target"), "split", F.col(y).alias("y"), *keep, F.inline(F.array(*scored))
    )
    by = ["run_id", "target", "split"]
    groups = None if group is None else ["target" if g == "dataset" else g for g in group]
    return metrics_long(all_metrics(long, by, task, groups), by)
