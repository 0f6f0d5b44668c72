"""Linear model grids from aggregated moments.

The heavy pass is one Spark aggregation of per-environment moments. What reaches the driver
is environments x columns^2 numbers, and each model is a small coordinate descent on them:
every source subset, anchor strength and penalty is served without reading the data again.
"""

from __future__ import annotations

import pickle
import warnings
from collections.abc import Callable, Iterable, Iterator, Mapping, Sequence
from dataclasses import dataclass, field, replace

import numpy as np
import pandas as pd
import pyarrow as pa
from pyspark import StorageLevel, cloudpickle
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from ..functions.bounded import bounded_rows
from ..functions.columns import dot
from .features import ffill
from .moments import MAX_EXPRESSION_COLUMNS, env_moments, moment_strips
from .sampling import hash_fold

# Eigenvalue floor and scale of the ridge on between-dataset directions,
# tolerance for finding a penalty in a path.
EIGEN_FLOOR = 1e-10
RIDGE_SCALE = 100.0
ALPHA_TOLERANCE = 1e-12
#: Bytes of moments that may come to the driver.
MAX_MOMENT_BYTES = 1 << 30


@dataclass(frozen=True)
class LinearModel:
    """Coefficients on the raw columns; missing inputs are replaced by ``means``."""

    coef: np.ndarray
    intercept: float
    means: np.ndarray
    params: Mapping[str, object] = field(default_factory=dict)

    def predictor(self, cols: Sequence[str]) -> Column:
        seen = [F.nullif(F.col(c).cast("double"), F.lit(float("nan"))) for c in cols]
        x = [F.coalesce(c, F.lit(float(m))) for c, m in zip(seen, self.means)]
        return F.lit(float(self.intercept)) + dot(self.coef, x)


@dataclass(frozen=True)
class Block:
    """Row count, sums and cross products in imputed and scaled coordinates, y last."""

    n: float
    s: np.ndarray
    c: np.ndarray

    def __add__(self, other: Block) -> Block:
        return Block(self.n + other.n, self.s + other.s, self.c + other.c)

    def __sub__(self, other: Block) -> Block:
        return Block(self.n - other.n, self.s - other.s, self.c - other.c)

    def gram(self) -> np.ndarray:
        """Centred second moments per row."""
        m = self.s / self.n
        return self.c / self.n - np.outer(m, m)


@dataclass
class Moments:
    """Pairwise-observed moments per environment: counts, sums, cross products.

    Weighted moments carry the ``plain`` ones of the same rows, from which means and sds of the preprocessing are taken.
    """

    cols: list[str]
    n: dict[tuple, np.ndarray]
    s: dict[tuple, np.ndarray]
    c: dict[tuple, np.ndarray]
    plain: Moments | None = None

    @classmethod
    def of(cls, rows: pd.DataFrame, cols: Sequence[str], by: Sequence[str]) -> Moments:
        """From long moment rows, as ``env_moments`` gives them; the last column is y."""
        p = len(cols)
        n: dict[tuple, np.ndarray] = {}
        s: dict[tuple, np.ndarray] = {}
        c: dict[tuple, np.ndarray] = {}
        for key, g in rows.groupby(list(by), sort=True, dropna=False):
            key = key if isinstance(key, tuple) else (key,)
            key = tuple(None if pd.isna(k) else k for k in key)
            i, j = g["i"].to_numpy(), g["j"].to_numpy()
            ne, se, ce = np.zeros((p, p)), np.zeros((p, p)), np.zeros((p, p))
            ne[i, j] = ne[j, i] = g["n"].to_numpy()
            ce[i, j] = ce[j, i] = g["cij"].to_numpy()
            se[i, j] = g["si"].to_numpy()
            se[j, i] = g["sj"].to_numpy()
            n[key], s[key], c[key] = ne, se, ce
        return cls(list(cols), n, s, c)

    @classmethod
    def collect(cls, moments: DataFrame, cols: Sequence[str], by: Sequence[str] = ("dataset",)) -> Moments:
        """From ``env_moments`` or ``moment_strips``; more than ``MAX_MOMENT_BYTES`` of them raise an error."""
        p = len(cols)
        if "first" not in moments.columns:
            rows = bounded_rows(moments, MAX_MOMENT_BYTES // 64, "moments")
            return cls.of(pd.DataFrame(rows, columns=moments.columns), cols, by)
        mats: dict[tuple, np.ndarray] = {}
        for r in bounded_rows(moments, max(1, MAX_MOMENT_BYTES // (32 * p * p)), "moments"):
            key = tuple(r[b] for b in by)
            whole = mats.setdefault(key, np.zeros((3, p, p)))
            for m, f in zip(whole, ("n", "si", "cij"), strict=True):
                strip = np.frombuffer(r[f]).reshape(-1, p)
                m[r["first"] : r["first"] + len(strip)] = strip
        order = sorted(mats, key=lambda k: [(v is None, v) for v in k])
        return cls(list(cols), *({k: mats[k][f] for k in order} for f in range(3)))

    @classmethod
    def gather(cls, df: DataFrame, cols: Sequence[str], by: Sequence[str] = ("dataset",), weight: str | None = None) -> Moments:
        """Long rows of a few columns, packed strips of many. Row weights count in the fit, not in the preprocessing:
        with ``weight`` the weighted and the plain moments are gathered, from one copy of the columns."""
        of = env_moments if len(cols) <= MAX_EXPRESSION_COLUMNS else moment_strips
        if weight is None:
            return cls.collect(of(df, cols, by), cols, by)
        held = df.select(*dict.fromkeys([*by, *cols, weight])).persist(StorageLevel.DISK_ONLY)
        try:
            return replace(cls.collect(of(held, cols, by, weight), cols, by), plain=cls.collect(of(held, cols, by), cols, by))
        finally:
            held.unpersist()

    def envs(self) -> list[tuple]:
        return list(self.n)

    def scaling(self, envs: Iterable[tuple]) -> tuple[np.ndarray, np.ndarray]:
        """Mean and population sd of the imputed columns over the environments (y: 0 and 1)."""
        envs = list(envs)
        if self.plain is not None:
            return self.plain.scaling(envs)
        n, s, c = (sum(m[e] for e in envs) for m in (self.n, self.s, self.c))
        seen = np.maximum(np.diag(n), 1e-300)
        mean = np.diag(s) / seen
        var = (np.diag(c) - seen * mean**2) / n[-1, -1]
        sd = np.sqrt(np.maximum(var, 0.0))
        sd = np.where(sd > 1e-12 * np.maximum(1.0, np.abs(mean)), sd, 1.0)
        mean[-1], sd[-1] = 0.0, 1.0
        return mean, sd

    def blocks(
        self, envs: Iterable[tuple], scaling: tuple[np.ndarray, np.ndarray] | None = None
    ) -> dict[tuple, Block]:
        envs = list(envs)
        mu, sd = self.scaling(envs) if scaling is None else scaling
        out = {}
        for e in envs:
            n, s, c = self.n[e], self.s[e], self.c[e]
            sums = (np.diag(s) - mu * np.diag(n)) / sd
            cross = c - mu[:, None] * s.T - s * mu[None, :] + np.outer(mu, mu) * n
            out[e] = Block(float(n[-1, -1]), sums, cross / np.outer(sd, sd))
        return out


def _sum(blocks: Iterable[Block]) -> Block:
    it = iter(blocks)
    total = next(it)
    for b in it:
        total = total + b
    return total


def elastic_net(
    gram: np.ndarray,
    cov: np.ndarray,
    alphas: Sequence[float],
    l1_ratio: float,
    p1: np.ndarray | None = None,
    p2: np.ndarray | None = None,
    start: np.ndarray | None = None,
    max_iter: int = 10_000,
    tol: float = 1e-12,
) -> np.ndarray:
    """Coordinate descent for b'Gb/2 - g'b + alpha (l1 p1|b| + (1 - l1) p2 b^2 / 2), warm starts."""
    k = len(cov)
    p1 = np.ones(k) if p1 is None else p1
    p2 = np.ones(k) if p2 is None else p2
    b = np.zeros(k) if start is None else start.copy()
    path = []
    for alpha in alphas:
        lasso, ridge = alpha * l1_ratio * p1, alpha * (1 - l1_ratio) * p2
        if l1_ratio == 0:
            b = np.linalg.lstsq(gram + np.diag(ridge), cov, rcond=None)[0]
            path.append(b.copy())
            continue
        grad = cov - gram @ b
        for _ in range(max_iter):
            largest = 0.0
            for j in range(k):
                curve = gram[j, j] + ridge[j]
                if curve <= 0:
                    continue
                r = grad[j] + gram[j, j] * b[j]
                new = np.sign(r) * max(abs(r) - lasso[j], 0.0) / curve
                step = new - b[j]
                if step != 0.0:
                    grad -= gram[:, j] * step
                    b[j] = new
                    largest = max(largest, abs(step))
            if largest < tol:
                break
        else:
            warnings.warn(f"coordinate descent did not settle in {max_iter} rounds at alpha {alpha}", stacklevel=2)
        path.append(b.copy())
    return np.array(path)


def _models(
    path: np.ndarray, block: Block, scaling, alphas: Sequence[float], params: Mapping
) -> list[LinearModel]:
    """Paths in scaled coordinates to models on raw columns."""
    mu, sd = scaling[0][:-1], scaling[1][:-1]
    mean = block.s / block.n
    out = []
    for alpha, b in zip(alphas, path):
        intercept = mean[-1] - b @ mean[:-1]
        raw = b / sd
        out.append(LinearModel(raw, float(intercept - raw @ mu), mu, {**params, "alpha": float(alpha)}))
    return out


def anchor_gram(blocks: Mapping[tuple, Block], gamma: float) -> np.ndarray:
    """Within-group moments over gamma plus between-group moments."""
    total = _sum(blocks.values())
    m = total.s / total.n
    between = sum(np.outer(b.s - b.n * m, b.s - b.n * m) / b.n for b in blocks.values() if b.n > 0)
    between = between / total.n
    return (total.gram() - between) / gamma + between


def fit_anchor(
    moments: Moments,
    gammas: Sequence[float],
    alphas: Sequence[float],
    l1_ratios: Sequence[float],
    envs: Sequence[tuple] | None = None,
    params: Mapping | None = None,
) -> list[LinearModel]:
    """Anchor regression for the whole grid; the environments are the anchor groups."""
    envs = moments.envs() if envs is None else list(envs)
    scaling = moments.scaling(envs)
    blocks = moments.blocks(envs, scaling)
    total = _sum(blocks.values())
    out = []
    for gamma in gammas:
        g = anchor_gram(blocks, gamma)
        for l1 in l1_ratios:
            path = elastic_net(g[:-1, :-1], g[:-1, -1], alphas, l1)
            out += _models(
                path, total, scaling, alphas, {**(params or {}), "gamma": float(gamma), "l1_ratio": float(l1)}
            )
    return out


def fit_linear(
    moments: Moments,
    alphas: Sequence[float],
    l1_ratio: float,
    envs: Sequence[tuple] | None = None,
    params: Mapping | None = None,
) -> list[LinearModel]:
    """Elastic-net path for squared loss (anchor strength 1)."""
    fits = fit_anchor(moments, [1.0], alphas, [l1_ratio], envs, params)
    return [replace(m, params={k: v for k, v in m.params.items() if k != "gamma"}) for m in fits]


def group_penalties(
    counts: np.ndarray, weight_sums: np.ndarray | None = None, square_sums: np.ndarray | None = None
) -> np.ndarray:
    """Penalty factor per dataset: sqrt(share), or by effective sample size with weights."""
    if weight_sums is None:
        return np.sqrt(counts / counts.sum())
    n_eff = weight_sums.sum() ** 2 / square_sums.sum()
    return np.sqrt(n_eff / counts) * weight_sums


def weighted_penalties(df: DataFrame, weight: str, by: str = "dataset") -> np.ndarray:
    """Penalty factors of the sorted datasets from row weights, by one aggregate."""
    w = F.col(weight).cast("double")
    stats = df.groupBy(by).agg(F.count(w).alias("n"), F.sum(w).alias("w"), F.sum(w * w).alias("ww"))
    rows = sorted(bounded_rows(stats, what=by), key=lambda r: r[by])
    return group_penalties(*(np.array([float(r[c]) for r in rows]) for c in ("n", "w", "ww")))


def _shared_path(
    blocks: Sequence[Block], factors: np.ndarray, alphas: Sequence[float], l1: float, max_iter: int, tol: float
) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """Shared coefficients, dataset intercepts and whether each point settled, by descent over blocks.

    With b shared, a_g an intercept and d_g the deviations of dataset g (on columns centred within it), the gradients of
    all parts follow from sums of the datasets' own matrices; the matrix of all columns together is never formed.
    """
    total = _sum(blocks)
    n, p, d = total.n, len(total.s) - 1, len(blocks)
    mean, y_mean = total.s[:-1] / n, total.s[-1] / n
    shares = np.array([g.n for g in blocks]) / n
    own = np.array([g.s[:-1] for g in blocks]) / n  # shared column x indicator
    within = [(g.c - np.outer(g.s, g.s) / g.n) / n for g in blocks]
    gram = total.gram()[:-1, :-1]
    ones = np.diag(shares) - np.outer(shares, shares)
    cross = own.T - np.outer(mean, shares)
    grad_b = total.gram()[:-1, -1].copy()
    grad_a = np.array([g.s[-1] for g in blocks]) / n - shares * y_mean
    grad_d = [w[:-1, -1].copy() for w in within]
    inner = [np.ascontiguousarray(w[:-1, :-1]) for w in within]
    b, a, dev = np.zeros(p), np.zeros(d), np.zeros((d, p))

    def moved(r: float, curve: float, old: float, lasso: float, ridge: float) -> float:
        r += curve * old
        return float(np.sign(r) * max(abs(r) - lasso, 0.0) / (curve + ridge)) - old if curve + ridge > 0 else 0.0

    path, intercepts, settled = [], [], []
    for alpha in alphas:
        lasso, ridge = alpha * l1, alpha * (1 - l1)
        ok, full = False, True
        for _ in range(max_iter):
            # Between sweeps over everything, only what is not zero moves.
            largest = 0.0
            for j in range(p) if full else np.flatnonzero(b).tolist():
                step = moved(grad_b[j], gram[j, j], b[j], lasso, ridge)
                if step:
                    b[j] += step
                    grad_b -= gram[:, j] * step
                    grad_a -= cross[j] * step
                    for g in range(d):
                        grad_d[g] -= inner[g][:, j] * step
                    largest = max(largest, abs(step))
            for g in range(d):
                step = moved(grad_a[g], ones[g, g], a[g], lasso * factors[g], ridge * factors[g])
                if step:
                    a[g] += step
                    grad_a -= ones[g] * step
                    grad_b -= cross[:, g] * step
                    largest = max(largest, abs(step))
                w, grad = inner[g], grad_d[g]
                for j in range(p) if full else np.flatnonzero(dev[g]).tolist():
                    step = moved(grad[j], w[j, j], dev[g, j], lasso * factors[g], ridge * factors[g])
                    if step:
                        dev[g, j] += step
                        grad -= w[:, j] * step
                        grad_b -= w[:, j] * step
                        largest = max(largest, abs(step))
            if largest < tol and full:
                ok = True
                break
            full = largest < tol
        path.append(b.copy())
        intercepts.append(a.copy())
        settled.append(ok)
    return np.array(path), np.array(intercepts), np.array(settled)


def fit_data_shared(
    moments: Moments,
    ratio: float,
    alphas: Sequence[float],
    l1_ratio: float,
    envs: Sequence[tuple] | None = None,
    penalties: np.ndarray | None = None,
    max_iter: int = 10_000,
    tol: float = 1e-10,
) -> list[LinearModel]:
    """Shared coefficients plus per-dataset intercepts and deviations; the shared part predicts.

    ``penalties`` follow the order of ``envs``; for weighted moments ``weighted_penalties``
    gives them. Memory is that of the datasets' own matrices. A point of the path that has not settled after
    ``max_iter`` rounds has ``converged`` False among its parameters.
    """
    envs = moments.envs() if envs is None else list(envs)
    scaling = moments.scaling(envs)
    by_env = moments.blocks(envs, scaling)
    blocks = [by_env[e] for e in envs]
    total = _sum(blocks)
    if penalties is None:
        penalties = group_penalties(np.array([b.n for b in blocks]))
    path, intercepts, settled = _shared_path(blocks, ratio * np.asarray(penalties), alphas, l1_ratio, max_iter, tol)
    mu, sd = scaling[0][:-1], scaling[1][:-1]
    mean, shares = total.s / total.n, np.array([b.n for b in blocks]) / total.n
    out = []
    for alpha, b, a, ok in zip(alphas, path, intercepts, settled):
        raw = b / sd
        intercept = mean[-1] - b @ mean[:-1] - a @ shares - raw @ mu
        params = {"alpha": float(alpha), "ratio": float(ratio), "l1_ratio": float(l1_ratio), "converged": bool(ok)}
        out.append(LinearModel(raw, float(intercept), mu, params))
    return out


def in_tasks(spark: SparkSession, jobs: Sequence, solve: Callable[[object], list[LinearModel]]) -> list[LinearModel]:
    """``solve(job)`` of every job, each in a task of its own; what ``solve`` holds (moments) is sent once."""
    held = spark.sparkContext.broadcast(cloudpickle.dumps((list(jobs), solve)))

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        given, of = pickle.loads(held.value)
        for b in batches:
            for k in b.column("id").to_pylist():
                fits = of(given[k])
                yield pa.record_batch([pa.array([k]), pa.array([pickle.dumps(fits)], pa.binary())], names=["id", "fits"])

    rows = spark.range(0, len(jobs), 1, max(1, len(jobs))).mapInArrow(run, "id bigint, fits binary").collect()
    return [m for r in sorted(rows, key=lambda r: r["id"]) for m in pickle.loads(r["fits"])]


def fit_anticausal(
    moments: Moments,
    l2_ratios: Sequence[float],
    alphas: Sequence[float],
    l1_ratio: float = 0.0,
    envs: Sequence[tuple] | None = None,
) -> list[LinearModel]:
    """Penalise directions in which dataset means vary: ridge in the rotated basis."""
    envs = moments.envs() if envs is None else list(envs)
    scaling = moments.scaling(envs)
    blocks = moments.blocks(envs, scaling)
    total = _sum(blocks.values())
    mean = total.s[:-1] / total.n
    cov = sum(
        b.n * np.outer(b.s[:-1] / b.n - mean, b.s[:-1] / b.n - mean) for b in blocks.values()
    ) / (total.n - 1)
    values, vectors = np.linalg.eigh(cov)
    values = np.maximum(values, EIGEN_FLOOR)
    g = total.gram()
    gram, xy = vectors.T @ g[:-1, :-1] @ vectors, vectors.T @ g[:-1, -1]
    out = []
    for l2 in l2_ratios:
        ridge = RIDGE_SCALE * (values + RIDGE_SCALE * l2)
        path = elastic_net(gram, xy, alphas, l1_ratio, None, ridge) @ vectors.T
        out += _models(path, total, scaling, alphas, {"l2_ratio": float(l2)})
    return out


def pick_alpha(models: Sequence[LinearModel], alpha: float) -> LinearModel:
    """The one model of a path with this penalty."""
    hits = [m for m in models if abs(m.params["alpha"] - alpha) <= ALPHA_TOLERANCE + 1e-5 * abs(alpha)]
    if len(hits) != 1:
        raise ValueError(f"{len(hits)} models with alpha {alpha}")
    return hits[0]


def refit_block(block: Block, scaling, prior: LinearModel, alphas, l1_ratio, params=None) -> list[LinearModel]:
    """Shrink to the prior: fit what its predictions leave over, in its own scaling."""
    sd = scaling[1][:-1]
    b0 = np.asarray(prior.coef) * sd
    g = block.gram()
    path = elastic_net(g[:-1, :-1], g[:-1, -1] - g[:-1, :-1] @ b0, alphas, l1_ratio)
    return _models(path + b0, block, scaling, alphas, params or {})


def fit_with_offset(
    moments: Moments,
    prior: LinearModel,
    prior_scale: np.ndarray,
    alphas: Sequence[float],
    l1_ratio: float = 0.0,
    envs: Sequence[tuple] | None = None,
) -> list[LinearModel]:
    """Squared-loss refit on new data with the prior's prediction as offset.

    Inputs are imputed and scaled as in the prior's training (``prior_scale`` holds its sds).
    """
    envs = moments.envs() if envs is None else list(envs)
    scaling = (np.append(prior.means, 0.0), np.append(prior_scale, 1.0))
    block = _sum(moments.blocks(envs, scaling).values())
    return refit_block(block, scaling, prior, alphas, l1_ratio, {"l1_ratio": float(l1_ratio)})


def squared_error(block: Block, model: LinearModel, scaling) -> tuple[float, float]:
    """(sum of squared residuals, sum of residuals) of a model on a block."""
    mu, sd = scaling[0][:-1], scaling[1][:-1]
    b = np.asarray(model.coef) * sd
    a = model.intercept + np.asarray(model.coef) @ mu
    v = np.append(-b, 1.0)
    total = v @ block.s - a * block.n
    return float(v @ block.c @ v - 2 * a * (v @ block.s) + a * a * block.n), float(total)


def _irls_sums(df: DataFrame, p: int, betas: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """For all coefficient rows in one pass: weighted cross products of (1, x, working response), and the log loss.

    Each task hands on one packed matrix a model; they are added one at a time, and one row a model is collected.
    """
    k_models = len(betas)
    width = p + 2

    def partial(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        acc, loss = np.zeros((k_models, width, width)), np.zeros(k_models)
        for batch in batches:
            m = np.column_stack([c.to_numpy(zero_copy_only=False) for c in batch.columns]).astype(float)
            if len(m) == 0:
                continue
            x, y, offset, weight = m[:, :p], m[:, p], m[:, p + 1], m[:, p + 2]
            design = np.column_stack([np.ones(len(m)), x])
            for k in range(k_models):
                raw = design @ betas[k] + offset
                loss[k] += (weight * (np.logaddexp(0.0, raw) - y * raw)).sum()
                eta = np.clip(raw, -30.0, 30.0)
                mu = 1.0 / (1.0 + np.exp(-eta))
                w = np.maximum(mu * (1 - mu), 1e-10)
                z = eta - offset + (y - mu) / w
                full = np.column_stack([design, z])
                acc[k] += (full * (w * weight)[:, None]).T @ full
        yield told(range(k_models), acc, loss)

    def told(ks, mats, losses) -> pa.RecordBatch:
        packed = pa.array([np.ascontiguousarray(m).tobytes() for m in mats], pa.binary())
        return pa.record_batch([pa.array(list(ks), pa.int32()), packed, pa.array(list(losses), pa.float64())], names=["k", "m", "loss"])

    def add_up(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        key, total, loss = None, None, 0.0
        for batch in batches:
            for i in range(batch.num_rows):
                k, m = batch.column("k")[i].as_py(), np.frombuffer(batch.column("m")[i].as_buffer())
                if k != key and key is not None:
                    yield told([key], [total], [loss])
                    total = None
                total, loss = (m, batch.column("loss")[i].as_py()) if total is None else (total + m, loss + batch.column("loss")[i].as_py())
                key = k
        if key is not None:
            yield told([key], [total], [loss])

    schema = "k int, m binary, loss double"
    sums = df.mapInArrow(partial, schema).repartition("k").sortWithinPartitions("k").mapInArrow(add_up, schema)
    mats, losses = np.zeros((k_models, width, width)), np.zeros(k_models)
    for r in bounded_rows(sums, k_models, "models"):
        mats[r["k"]], losses[r["k"]] = np.frombuffer(r["m"]).reshape(width, width), r["loss"]
    return mats, losses


def fit_logistic(
    df: DataFrame,
    features: Sequence[str],
    y: str,
    alphas: Sequence[float],
    l1_ratio: float = 0.0,
    offset: str | None = None,
    weight: str | None = None,
    max_iter: int = 50,
    tol: float = 1e-8,
) -> list[LinearModel]:
    """Penalised logistic regression; every penalty advances by one step per pass over the data.

    ``features`` are preprocessed columns without nulls. A step that raises the penalised loss is halved. A penalty whose
    steps are not below ``tol`` after ``max_iter`` passes, as without a penalty on a separable outcome, has ``converged``
    False among its parameters and a warning is given. A constant outcome gives zero
    coefficients and the log odds of n rows against one row of the other label.
    """
    p = len(features)
    zeros = np.zeros(p)
    ends = df.agg(F.min(y).alias("lo"), F.max(y).alias("hi"), F.count(y).alias("n")).first()
    if ends["lo"] == ends["hi"]:
        a = float(-(1 - 2 * int(ends["lo"])) * np.log(ends["n"]))
        params = {"l1_ratio": float(l1_ratio), "converged": True}
        return [LinearModel(zeros, a, zeros, {"alpha": float(v), **params}) for v in alphas]
    data = df.select(
        *[F.col(c).cast("double").alias(f"x{i}") for i, c in enumerate(features)],
        F.col(y).cast("double").alias("y"),
        (F.lit(0.0) if offset is None else F.col(offset).cast("double")).alias("o"),
        (F.lit(1.0) if weight is None else F.col(weight).cast("double")).alias("w"),
    ).persist(StorageLevel.MEMORY_AND_DISK)
    total = data.agg(F.sum("w")).first()[0]
    penalty = np.asarray(alphas, float)
    kept, tried = np.zeros((len(alphas), p + 1)), np.zeros((len(alphas), p + 1))
    least, done = np.full(len(alphas), np.inf), np.zeros(len(alphas), bool)
    try:
        for _ in range(max_iter):
            open_ = np.flatnonzero(~done)
            mats, losses = _irls_sums(data, p, tried[open_])
            for k, m, loss in zip(open_, mats, losses, strict=True):
                slopes = tried[k, 1:]
                value = loss / total + penalty[k] * (l1_ratio * np.abs(slopes).sum() + (1 - l1_ratio) * (slopes @ slopes) / 2)
                if value > least[k] + 1e-12 * (1 + abs(least[k])):
                    tried[k] = (kept[k] + tried[k]) / 2
                else:
                    kept[k], least[k] = tried[k], value
                    w = m[0, 0]
                    mean = m[0, 1:] / w
                    c = (m[1:, 1:] - w * np.outer(mean, mean)) / total
                    b = elastic_net(c[:-1, :-1], c[:-1, -1], [penalty[k]], l1_ratio, start=slopes)[0]
                    tried[k] = np.append(mean[-1] - b @ mean[:-1], b)
                done[k] = np.abs(tried[k] - kept[k]).max() < tol
            if done.all():
                break
    finally:
        data.unpersist()
    if not done.all():
        warnings.warn(f"logistic fits for alpha {penalty[~done].tolist()} did not converge in {max_iter} passes", stacklevel=2)
    return [
        LinearModel(b[1:], float(b[0]), zeros, {"alpha": float(a), "l1_ratio": float(l1_ratio), "converged": bool(ok)})
        for a, b, ok in zip(alphas, np.where(done[:, None], tried, kept), done)
    ]


def refit_intercept(scored: DataFrame, y: str = "y", yhat: str = "yhat", by: Sequence[str] = ()) -> DataFrame:
    """Shift of the prior's intercept: mean outcome minus mean prediction."""
    return scored.groupBy(*by).agg((F.avg(y) - F.avg(yhat)).alias("offset"))


def passthrough(df: DataFrame, prior: LinearModel, cols: Sequence[str], out: str = "yhat") -> DataFrame:
    """Predictions of the prior as they are."""
    return df.withColumn(out, prior.predictor(cols))


def ffill_predict(
    df: DataFrame, last_value: str, mean_y: float, out: str = "yhat", keys: Sequence[str] | None = None
) -> DataFrame:
    """Last observed value, else the training mean; NaN counts as missing.

    With ``keys`` the column is first filled forward along each stay.
    """
    if keys is not None:
        df = ffill(df, [last_value], keys)
        last_value += "_ffilled"
    x = F.col(last_value).cast("double")
    return df.withColumn(out, F.coalesce(F.when(~F.isnan(x), x), F.lit(float(mean_y))))


def fit_predict_cv(
    df: DataFrame,
    cols: Sequence[str],
    y: str,
    group: str,
    alpha: float,
    l1_ratio: float = 0.0,
    k: int = 5,
    out: str = "yhat_cv",
) -> tuple[DataFrame, LinearModel]:
    """Out-of-fold predictions and the model refitted on all rows.

    One moments pass by fold: training moments are the total minus the fold, so imputation
    and scaling are also learned without the fold.
    """
    folded = df.withColumn("fold", hash_fold(F.col(group), k))
    m = Moments.gather(folded, [*cols, y], ["fold"])
    prediction = F.lit(None).cast("double")
    for f in m.envs():
        rest = [e for e in m.envs() if e != f]
        model = fit_linear(m, [alpha], l1_ratio, rest)[0]
        prediction = F.when(F.col("fold") == F.lit(int(f[0])), model.predictor(cols)).otherwise(prediction)
    return folded.withColumn(out, prediction), fit_linear(m, [alpha], l1_ratio)[0]
