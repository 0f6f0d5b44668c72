"""Additive second moments per environment, and projections on anchors.

One aggregate gives everything linear models need: moments of any source subset or fold
are sums of these rows. Partial sums are formed before the shuffle, so an environment
that holds most of the rows costs no more than any other.
"""

from __future__ import annotations

from collections.abc import Iterator, Sequence

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T

from ..functions.bounded import lookup
from ..functions.joins import join_groups
from ..session import pin

#: Up to this many columns the sums are plain aggregate expressions.
MAX_EXPRESSION_COLUMNS = 6
#: Bytes of the sums that a task may hold for all environments together, and of a strip.
TASK_BYTES = 256 << 20
STRIP_BYTES = 64 << 20
#: Rows of a block of a large environment, about, and most blocks of one.
BLOCK_ROWS = 1 << 16
MOST_BLOCKS = 256

MOMENT_FIELDS = ("n", "si", "sj", "cij")


def _shifted(c: str, shift: dict[str, float] | None) -> Column:
    x = F.nullif(F.col(c).cast("double"), F.lit(float("nan")))
    return x - F.lit(float(shift[c])) if shift and c in shift else x


def env_moments(
    df: DataFrame,
    cols: Sequence[str],
    by: Sequence[str] = ("dataset",),
    weight: str | None = None,
    shift: dict[str, float] | None = None,
) -> DataFrame:
    """Long moments: one row per (environment, i, j) with i <= j.

    Over rows where both columns are observed: ``n`` (weight sum), ``si``, ``sj`` (sums) and
    ``cij`` (cross product). ``shift`` subtracts rough means
    first so that large offsets do not cancel. NaN counts as missing.
    """
    cols = list(cols)
    if len(cols) <= MAX_EXPRESSION_COLUMNS:
        return _moments_by_expression(df, cols, by, weight, shift)
    return _moments_by_blocks(df, cols, by, weight, shift)


def _moments_by_expression(df, cols, by, weight, shift) -> DataFrame:
    x = [f"_x{k}" for k in range(len(cols))]
    data = df.select(
        *by,
        (F.lit(1.0) if weight is None else F.col(weight).cast("double")).alias("_w"),
        *[_shifted(c, shift).alias(n) for c, n in zip(cols, x)],
    )
    pairs = [(i, j) for i in range(len(cols)) for j in range(i, len(cols))]
    sums, rows = [], []
    for i, j in pairs:
        a, b = f"_x{i}", f"_x{j}"
        # A product with a missing factor is null and drops out of its sum.
        terms = {
            "n": f"CASE WHEN {a} IS NOT NULL AND {b} IS NOT NULL THEN _w END",
            "si": f"CASE WHEN {b} IS NOT NULL THEN _w * {a} END",
            "sj": f"CASE WHEN {a} IS NOT NULL THEN _w * {b} END",
            "cij": f"_w * {a} * {b}",
        }
        sums += [F.expr(f"sum({t})").alias(f"{f}_{i}_{j}") for f, t in terms.items()]
        fields = ", ".join(f"'{f}', coalesce({f}_{i}_{j}, 0D)" for f in MOMENT_FIELDS)
        rows.append(f"named_struct('i', {i}, 'j', {j}, {fields})")
    wide = data.groupBy(*by).agg(*sums)
    return wide.select(*by, F.expr(f"inline(array({', '.join(rows)}))"))


def _moments_by_blocks(df, cols, by, weight, shift) -> DataFrame:
    """Long moments read off the strips; nothing is shuffled in long form."""
    p = len(cols)
    strips = moment_strips(df, cols, by, weight, shift)
    fields = [strips.schema[b] for b in by]
    schema = T.StructType(
        [*fields, *(T.StructField(c, T.IntegerType()) for c in "ij"), *(T.StructField(f, T.DoubleType()) for f in MOMENT_FIELDS)]
    )
    names = list(by)

    def spread(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for k in range(batch.num_rows):
                first, n, s, st, c = _read_strip(batch.slice(k, 1), p)
                i, j = np.nonzero(np.arange(first, first + len(n))[:, None] <= np.arange(p))
                keys = [pa.repeat(batch.column(name)[k], len(i)) for name in names]
                sums = [pa.array(m[i, j]) for m in (n, s, st, c)]
                yield pa.RecordBatch.from_arrays(
                    [*keys, pa.array(i + first, pa.int32()), pa.array(j, pa.int32()), *sums], names=[*names, "i", "j", *MOMENT_FIELDS]
                )

    return strips.mapInArrow(spread, schema)


def _read_strip(row: pa.RecordBatch, p: int) -> tuple:
    """(first column, n, si, sj, cij) of one strip: its columns against all."""
    read = lambda c: np.frombuffer(row.column(c)[0].as_buffer()).reshape(-1, p)
    return (row.column("first")[0].as_py(), *(read(c) for c in MOMENT_FIELDS))


class _Sums:
    """Moments of some columns against all, held as four matrices."""

    def __init__(self, first: int, last: int, p: int):
        self.first, self.last = first, last
        self.mats = np.zeros((4, last - first, p))

    def add(self, x: np.ndarray, w: np.ndarray) -> None:
        seen = (~np.isnan(x)).astype(float)
        v = np.where(seen > 0, x, 0.0)
        own = slice(self.first, self.last)
        ws, wv = seen[:, own] * w[:, None], v[:, own] * w[:, None]
        for m, (left, right) in zip(self.mats, ((ws, seen), (wv, seen), (ws, v), (wv, v)), strict=True):
            m += left.T @ right

    def row(self) -> list[bytes]:
        return [m.tobytes() for m in self.mats]


_STRIP = "_e bigint, first int, n binary, si binary, sj binary, cij binary"


def _strip_batch(e: int, first: int, mats: list[bytes]) -> pa.RecordBatch:
    columns = [pa.array([e], pa.int64()), pa.array([first], pa.int32()), *(pa.array([m], pa.binary()) for m in mats)]
    return pa.RecordBatch.from_arrays(columns, names=["_e", "first", *MOMENT_FIELDS])


def _rows(batch: pa.RecordBatch, p: int) -> tuple[np.ndarray, np.ndarray]:
    x = batch.column("x")
    flat = x.values.to_numpy(zero_copy_only=False)
    start = np.asarray(x.offsets)[0]
    return flat[start : start + batch.num_rows * p].reshape(-1, p), batch.column("_w").to_numpy()


def moment_strips(
    df: DataFrame,
    cols: Sequence[str],
    by: Sequence[str] = ("dataset",),
    weight: str | None = None,
    shift: dict[str, float] | None = None,
    task_bytes: int = TASK_BYTES,
    strip_bytes: int = STRIP_BYTES,
    block_rows: int = BLOCK_ROWS,
) -> DataFrame:
    """(*by, first, n, si, sj, cij): moments of every environment as packed matrices, in strips of columns.

    A strip holds the moments of the columns from ``first`` on with all columns, of ``strip_bytes`` or less. Where all
    environments together fit ``task_bytes``, every task sums its rows in place. Else rows are dealt by
    environment (a large one into blocks of about ``block_rows`` rows, at most ``MOST_BLOCKS``) and a task holds the
    strip of one environment at a time. Both ways the partial strips are then added up, one at a time.
    """
    p = len(cols)
    data = df.select(
        *(F.col(b) for b in by),
        (F.lit(1.0) if weight is None else F.col(weight).cast("double")).alias("_w"),
        F.array(*(F.coalesce(_shifted(c, shift), F.lit(float("nan"))) for c in cols)).alias("x"),
    )
    counts = df.groupBy(*by).agg(F.count("*").alias("_rows"))
    blocks = F.least(F.ceil(F.col("_rows") / block_rows), F.lit(MOST_BLOCKS)).cast("int")
    envs = pin(counts.withColumns({"_blocks": blocks, "_e": F.monotonically_increasing_id()}))
    n_envs = envs.count()
    height = max(1, min(p, strip_bytes // (32 * p)))
    firsts = list(range(0, p, height))
    coded = join_groups(data, lookup(envs.drop("_rows")), by).select("_e", "_blocks", "_w", "x")

    def in_place(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        sums: dict[int, _Sums] = {}
        for batch in batches:
            if batch.num_rows == 0:
                continue
            x, w = _rows(batch, p)
            codes = batch.column("_e").to_numpy()
            for e in np.unique(codes).tolist():
                at = codes == e
                sums.setdefault(e, _Sums(0, p, p)).add(x[at], w[at])
        for e, s in sums.items():
            for first in firsts:
                yield _strip_batch(e, first, [m[first : first + height].tobytes() for m in s.mats])

    def one_by_one(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        """Rows in the order of (environment, block, strip): one strip is open at a time."""
        key, open_ = None, None
        for batch in batches:
            if batch.num_rows == 0:
                continue
            x, w = _rows(batch, p)
            keys = np.stack([batch.column(c).to_numpy() for c in ("_e", "_block", "first")], axis=1)
            cuts = [0, *(np.flatnonzero((keys[1:] != keys[:-1]).any(axis=1)) + 1).tolist(), len(keys)]
            for s, e in zip(cuts[:-1], cuts[1:], strict=True):
                now = tuple(keys[s].tolist())
                if now != key:
                    if open_ is not None:
                        yield _strip_batch(key[0], key[2], open_.row())
                    key, open_ = now, _Sums(now[2], min(p, now[2] + height), p)
                open_.add(x[s:e], w[s:e])
        if open_ is not None:
            yield _strip_batch(key[0], key[2], open_.row())

    def add_up(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        key, total = None, None
        for batch in batches:
            for k in range(batch.num_rows):
                now = batch.column("_e")[k].as_py(), batch.column("first")[k].as_py()
                mats = [np.frombuffer(batch.column(f)[k].as_buffer()) for f in MOMENT_FIELDS]
                if now != key:
                    if total is not None:
                        yield _strip_batch(*key, [m.tobytes() for m in total])
                    key, total = now, mats
                else:
                    total = [a + b for a, b in zip(total, mats, strict=True)]
        if total is not None:
            yield _strip_batch(*key, [m.tobytes() for m in total])

    def summed(parts: DataFrame) -> DataFrame:
        return parts.repartition("_e", "first").sortWithinPartitions("_e", "first").mapInArrow(add_up, _STRIP)

    if n_envs * 32 * p * p <= task_bytes:
        strips = summed(coded.mapInArrow(in_place, _STRIP))
    else:
        block = F.pmod(F.xxhash64("x", "_w"), F.col("_blocks").cast("bigint"))
        dealt = coded.withColumns({"_block": block, "first": F.explode(F.array(*map(F.lit, firsts)))})
        keys = ["_e", "_block", "first"]
        sorted_ = dealt.select(*keys, "_blocks", "_w", "x").repartition(*keys).sortWithinPartitions(*keys)
        single = sorted_.where("_blocks = 1").mapInArrow(one_by_one, _STRIP)
        strips = single
        if not envs.where("_blocks > 1").isEmpty():
            strips = strips.unionByName(summed(sorted_.where("_blocks > 1").mapInArrow(one_by_one, _STRIP)))
    found = strips.join(lookup(envs.drop("_rows", "_blocks")), "_e")
    return found.select(*(f"`{b}`" for b in by), "first", *MOMENT_FIELDS)


def _grand_means(df: DataFrame, cols: Sequence[str]) -> dict[str, float]:
    row = df.agg(*[F.avg(c).alias(c) for c in cols]).first()
    return {c: row[c] or 0.0 for c in cols}


def project_groups(
    df: DataFrame, cols: Sequence[str], group: Sequence[str], suffix: str = "_proj"
) -> DataFrame:
    """Projection of the centred columns on group indicators: group mean minus grand mean."""
    mean = _grand_means(df, cols)
    g = df.groupBy(*group).agg(*[(F.avg(c) - F.lit(mean[c])).alias(c + suffix) for c in cols])
    return join_groups(df, lookup(g), group)


def project_design(
    df: DataFrame,
    cols: Sequence[str],
    z: str,
    width: int | None = None,
    suffix: str = "_proj",
    centre: bool = True,
) -> DataFrame:
    """Projection on a general design: Z (Z'Z)^+ Z'v with Z in an array column of ``width``.

    One pass sums the few-hundred-square cross products of (1, Z, v), which also hold the
    means for centring; the second pass applies the coefficients.
    """
    q = len(df.select(z).first()[0]) if width is None else width
    p = len(cols)
    names = ["_one", *[f"_z{k}" for k in range(q)], *[f"_v{k}" for k in range(p)]]
    wide = df.select(
        F.lit(1.0).alias("_one"),
        *[F.col(z)[k].alias(f"_z{k}") for k in range(q)],
        *[F.col(c).cast("double").alias(f"_v{k}") for k, c in enumerate(cols)],
        F.lit(0).alias("_all"),
    )
    m = _moments_by_blocks(wide, names, ["_all"], None, None).where(F.col("i") <= q)
    gram = np.zeros((q + 1 + p, q + 1 + p))
    for r in m.select("i", "j", "cij").collect():
        gram[r["i"], r["j"]] = gram[r["j"], r["i"]] = r["cij"]
    zz, zv, z1 = gram[1 : q + 1, 1 : q + 1], gram[1 : q + 1, q + 1 :], gram[1 : q + 1, 0]
    if centre:
        zv = zv - np.outer(z1, gram[0, q + 1 :] / gram[0, 0])
    coef = np.linalg.pinv(zz, rcond=1e-12, hermitian=True) @ zv
    out = {}
    for k, c in enumerate(cols):
        # A written-out sum stays in generated code; a fold over the array would not.
        terms = [f"`{z}`[{i}] * {float(b)!r}D" for i, b in enumerate(coef[:, k])]
        out[c + suffix] = F.expr(" + ".join(terms))
    return df.withColumns(out)


#: Terms up to which normal equations are solved densely; more are solved by conjugate gradients.
DENSE_TERMS = 200
#: Relative residual at which the gradients stop.
SOLVED = 1e-13


def _solve_sparse(i: np.ndarray, j: np.ndarray, v: np.ndarray, right: np.ndarray) -> np.ndarray:
    """One least-squares solution of the symmetric system whose upper entries are (i, j, v)."""
    q = len(right)
    off = i != j
    if q <= DENSE_TERMS:
        gram = np.zeros((q, q))
        gram[i, j] = gram[j, i] = v
        return np.linalg.pinv(gram, rcond=1e-12, hermitian=True) @ right
    scale = np.zeros(q)
    scale[i[~off]] = v[~off]
    inverse = np.where(scale > 0, 1 / np.where(scale > 0, scale, 1), 0.0)
    times = lambda x: np.bincount(i, v * x[j], q) + np.bincount(j[off], (v * x[i])[off], q)
    out = np.zeros_like(right)
    for k in range(right.shape[1]):
        x, r = np.zeros(q), right[:, k].copy()
        z = inverse * r
        p, rz, start = z.copy(), r @ z, np.sqrt(r @ (inverse * r))
        for _ in range(20 * q):
            if np.sqrt(max(rz, 0.0)) <= SOLVED * start:
                break
            ap = times(p)
            curve = p @ ap
            if curve <= 0:
                break
            x += rz / curve * p
            r -= rz / curve * ap
            z = inverse * r
            rz, old = r @ z, rz
            p = z + rz / old * p
        else:
            raise ArithmeticError("the projection did not converge")
        out[:, k] = x
    return out


def project_terms(df: DataFrame, cols: Sequence[str], z: str = "z", by: str = "dataset", suffix: str = "_proj") -> DataFrame:
    """Projection of the centred columns on a sparse block-diagonal design (see ``anchors.sparse_design``).

    Every dataset has terms of its own, so Z'Z falls into one block for each: blocks are summed from the entries that occur
    together in a row, solved one by one in tasks, and applied to the entries of a row. A block's size is the square of
    its dataset's terms at most, and far less where few terms meet.
    """
    mean = _grand_means(df, cols)
    fields = [df.schema[by]]
    pairs = df.select(by, F.explode(z).alias("a"), F.col(z).alias("_z")).select(by, "a", F.explode("_z").alias("b"))
    gram = pairs.where("a.t <= b.t").groupBy(by, F.col("a.t").alias("i"), F.col("b.t").alias("j")).agg(F.sum(F.expr("a.v * b.v")).alias("v"))
    v = [(F.col(c).cast("double") - F.lit(float(mean[c]))).alias(f"_v{k}") for k, c in enumerate(cols)]
    entries = df.select(by, F.explode(z).alias("a"), *v)
    right = entries.groupBy(by, F.col("a.t").alias("t")).agg(*(F.sum(F.expr(f"a.v * _v{k}")).alias(f"r{k}") for k in range(len(cols))))
    p = len(cols)

    def solve(left: pa.Table, sums: pa.Table) -> pa.Table:
        if not sums.num_rows:
            return pa.table({})
        t = sums.column("t").to_numpy()
        where = np.argsort(t)
        known = t[where]
        r = np.column_stack([sums.column(f"r{k}").fill_null(0.0).to_numpy() for k in range(p)])[where]
        at = lambda c: np.searchsorted(known, left.column(c).to_numpy())
        solved = _solve_sparse(at("i"), at("j"), left.column("v").to_numpy(), r)
        whole = np.zeros((int(known[-1]) + 1, p))
        whole[known] = solved
        return pa.table([sums.column(by)[:1], *(pa.array([whole[:, k].tolist()]) for k in range(p))], names=[by, *(f"_b{k}" for k in range(p))])

    schema = T.StructType([*fields, *(T.StructField(f"_b{k}", T.ArrayType(T.DoubleType())) for k in range(p))])
    coef = pin(gram).groupBy(by).cogroup(pin(right).groupBy(by)).applyInArrow(solve, schema)
    joined = join_groups(df, lookup(coef), [by], "left")

    def fitted(k: int) -> Column:
        return F.aggregate(z, F.lit(0.0), lambda total, e: total + e["v"] * F.col(f"_b{k}")[e["t"].cast("int")])

    out = {c + suffix: fitted(k) for k, c in enumerate(cols)}
    return joined.withColumns(out).select(*df.columns, *out)


def anchor_transform(
    df: DataFrame,
    cols: Sequence[str],
    group: Sequence[str],
    gamma: float,
    suffix: str = "_anchor",
) -> DataFrame:
    """mean + m (x - mean) + (1 - m) P (x - mean) with m = sqrt(1 / gamma)."""
    m = (1.0 / gamma) ** 0.5
    mean = _grand_means(df, cols)
    g = df.groupBy(*group).agg(*[F.avg(c).alias(f"_g_{c}") for c in cols])
    joined = join_groups(df, lookup(g), group)
    out = {
        c + suffix: F.lit(mean[c])
        + F.lit(m) * (F.col(c) - F.lit(mean[c]))
        + F.lit(1.0 - m) * (F.col(f"_g_{c}") - F.lit(mean[c]))
        for c in cols
    }
    return joined.withColumns(out).drop(*[f"_g_{c}" for c in cols])
