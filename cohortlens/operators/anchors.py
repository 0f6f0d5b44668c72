"""Anchor variables: group codes, multi-hot lists, per-dataset designs, interactions."""

from __future__ import annotations

from collections.abc import Sequence
from dataclasses import dataclass
from functools import reduce

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from ..functions.bounded import MAX_LOOKUP_ROWS, bounded_rows, lookup
from ..functions.joins import join_groups
from ..session import pin
from .order_stats import quantiles
from .preprocess import OrdinalEncoder

MAX_TERMS = 2_000


def anchor_codes(df: DataFrame, formula: str, out: str = "anchor") -> DataFrame:
    """Group anchor: dense code of the dataset (``""``) or a patient key (``"patient_id"``).

    Patients are too many for a dense code and do not need one; the key identifies the group.
    """
    if formula == "patient_id":
        return df.withColumn(out, F.concat(F.col("patient_id").cast("string"), F.col("dataset")))
    if formula == "":
        tmp = df.withColumn(out, F.col("dataset"))
        return OrdinalEncoder([out]).fit(tmp).transform(tmp)
    raise ValueError(f"not a group anchor: {formula!r}")


def multi_hot(df: DataFrame, col: str, prefix: str | None = None) -> tuple[DataFrame, list[str]]:
    """One 0/1 column per distinct element of a list column, elements sorted."""
    elements = df.select(F.explode(col).alias("e")).where("e is not null").distinct()
    vocab = sorted(r["e"] for r in bounded_rows(elements, MAX_TERMS, f"vocabulary of {col}"))
    names = {f"{prefix or col}_{v}": v for v in vocab}
    hot = {
        n: F.coalesce(F.array_contains(F.col(col), v), F.lit(False)).cast("double")
        for n, v in names.items()
    }
    return df.withColumns(hot), list(names)


@dataclass(frozen=True)
class C:
    """Categorical term: dummies for all but the first sorted level."""

    col: str


@dataclass(frozen=True)
class BS:
    """B-spline term with ``df`` columns (degree 3, no intercept), quantile knots."""

    col: str
    df: int
    degree: int = 3


def bspline_basis(x: Column, knots: Sequence[float], degree: int) -> list[Column]:
    """Cox-de Boor recursion as column expressions over a full knot vector."""
    t = [float(k) for k in knots]
    last = max(i for i in range(len(t) - 1) if t[i] < t[i + 1])
    basis: list[Column | None] = []
    for i in range(len(t) - 1):
        if t[i] == t[i + 1]:
            basis.append(None)
            continue
        upper = (x <= F.lit(t[i + 1])) if i == last else (x < F.lit(t[i + 1]))
        basis.append(F.when((x >= F.lit(t[i])) & upper, F.lit(1.0)).otherwise(F.lit(0.0)))
    for d in range(1, degree + 1):
        nxt: list[Column | None] = []
        for i in range(len(t) - 1 - d):
            terms = []
            if basis[i] is not None and t[i + d] > t[i]:
                terms.append((x - F.lit(t[i])) / F.lit(t[i + d] - t[i]) * basis[i])
            if basis[i + 1] is not None and t[i + d + 1] > t[i + 1]:
                terms.append(
                    (F.lit(t[i + d + 1]) - x) / F.lit(t[i + d + 1] - t[i + 1]) * basis[i + 1]
                )
            nxt.append(None if not terms else terms[0] if len(terms) == 1 else terms[0] + terms[1])
        basis = nxt
    return [F.lit(0.0) if b is None else b for b in basis]


def _spline_knots(df: DataFrame, term: BS, by: str) -> dict[str, list[float]]:
    """Boundary and inner quantile knots per dataset."""
    n_inner = term.df - term.degree
    if n_inner < 0:
        raise ValueError("df must be at least the degree")
    probs = [(i + 1) / (n_inner + 1) for i in range(n_inner)]
    q = quantiles(df, [by], {"q": F.col(term.col)}, [0.0, *probs, 1.0])
    out = {}
    for r in bounded_rows(q, MAX_LOOKUP_ROWS, by):
        if r["q"] is None or r["q"][0] == r["q"][-1]:
            out[r[by]] = []
            continue
        lo, *inner, hi = r["q"]
        out[r[by]] = [lo] * (term.degree + 1) + inner + [hi] * (term.degree + 1)
    return out


def design_matrix(
    df: DataFrame, terms: Sequence[C | BS], by: str = "dataset", out: str = "z"
) -> tuple[DataFrame, list[str]]:
    """Block-diagonal design: every term is built per dataset, other datasets get zeros.

    Returns the table with an array column and the names of its entries. All levels come
    from one job, knots from one quantile job per spline.
    """
    factors = [t.col for t in terms if isinstance(t, C)]
    pairs = [F.struct(F.lit(c).alias("c"), F.col(c).cast("string").alias("v")) for c in factors]
    pairs.append(F.struct(F.lit("").alias("c"), F.lit("").alias("v")))
    seen = df.select(by, F.inline(F.array(*pairs))).where("v is not null").distinct()
    rows = bounded_rows(seen, MAX_TERMS, "levels of the design")
    datasets = sorted({r[by] for r in rows})
    blocks: dict[str, list[tuple[str, Column]]] = {d: [(f"{d}:Intercept", F.lit(1.0))] for d in datasets}
    for term in terms:
        if isinstance(term, C):
            for d in datasets:
                levels = sorted(r["v"] for r in rows if r[by] == d and r["c"] == term.col)
                for v in levels[1:]:
                    hit = F.col(term.col).cast("string").eqNullSafe(F.lit(v)).cast("double")
                    blocks[d].append((f"{d}:C({term.col})[{v}]", hit))
        else:
            knots = _spline_knots(df, term, by)
            x = F.col(term.col).cast("double")
            for d in datasets:
                if not knots.get(d):
                    continue
                basis = bspline_basis(x, knots[d], term.degree)[1:]
                for k, b in enumerate(basis, 1):
                    blocks[d].append((f"{d}:bs({term.col})[{k}]", F.coalesce(b, F.lit(0.0))))
    names, cols = [], []
    for d in datasets:
        for name, c in blocks[d]:
            names.append(name)
            cols.append(F.when(F.col(by) == F.lit(d), c).otherwise(F.lit(0.0)))
    return df.withColumn(out, F.array(*cols)), names


@dataclass(frozen=True)
class Multi:
    """List term: a 0/1 entry for every distinct element."""

    col: str


#: Name of the intercept among the terms of a dataset.
INTERCEPT = "Intercept"


def _spline_rows(
    df: DataFrame, x: Column, lo: Column, inner: Sequence[Column], hi: Column, degree: int, prefix: str
) -> tuple[DataFrame, list[Column]]:
    """Cox-de Boor recursion with knots that differ by row; intervals without width hold nothing.

    Every degree is a set of columns of its own, named after ``prefix``: written as one expression, a function would
    hold each lower one as often as the recursion reaches it.
    """
    known = {f"{prefix}x": x, f"{prefix}lo": lo, f"{prefix}hi": hi, **{f"{prefix}in{i}": c for i, c in enumerate(inner)}}
    df = df.withColumns(known)
    x, lo, hi, *inner = (F.col(c) for c in known)
    t = [lo] * (degree + 1) + inner + [hi] * (degree + 1)
    basis = [
        F.when((t[i] < t[i + 1]) & (x >= t[i]) & ((x < t[i + 1]) | ((x <= t[i + 1]) & (t[i + 1] == hi))), F.lit(1.0)).otherwise(F.lit(0.0))
        for i in range(len(t) - 1)
    ]
    ratio = lambda top, wide, b: F.when(wide > 0, top / wide * b).otherwise(F.lit(0.0))
    for d in range(1, degree + 1):
        lower = {f"{prefix}{d}_{i}": c for i, c in enumerate(basis)}
        df, basis = df.withColumns(lower), [F.col(c) for c in lower]
        basis = [
            ratio(x - t[i], t[i + d] - t[i], basis[i]) + ratio(t[i + d + 1] - x, t[i + d + 1] - t[i + 1], basis[i + 1])
            for i in range(len(t) - 1 - d)
        ]
    return df, basis


def _looked_up(places: Column, elements: Column) -> Column:
    return F.transform(elements, lambda e: places[e])


def sparse_design(
    df: DataFrame, terms: Sequence[C | BS | Multi], by: str = "dataset", out: str = "z"
) -> tuple[DataFrame, DataFrame]:
    """The design of ``design_matrix`` in sparse form, for any number of terms.

    Adds a list of (t, v), the entries of a row that are not zero, numbered within its dataset; also returns the
    table (by, t, name) of all terms. Levels are joined from that table (sent to all tasks only if few), so neither
    their number nor that of the datasets shows in the plan. A null value has no entry.
    """
    splines = [t for t in terms if isinstance(t, BS)]
    fixed = [(0, INTERCEPT)]
    entries = [F.struct(F.lit(0).cast("bigint").alias("t"), F.lit(1.0).alias("v"))]
    levels = []
    for n, term in enumerate(terms):
        if isinstance(term, C):
            seen = df.select(F.col(by).alias("d"), F.col(term.col).cast("string").alias("level"))
        elif isinstance(term, Multi):
            seen = df.select(F.col(by).alias("d"), F.explode(F.col(term.col).cast("array<string>")).alias("level"))
        else:
            continue
        seen = seen.where("level is not null").distinct().withColumn("term", F.lit(n))
        if isinstance(term, C):
            seen = seen.withColumn("first", F.row_number().over(Window.partitionBy("d").orderBy("level"))).where("first > 1").drop("first")
        levels.append(seen)
    wide = df
    for s, term in enumerate(splines):
        n_inner = term.df - term.degree
        if n_inner < 0:
            raise ValueError("df must be at least the degree")
        probs = [(i + 1) / (n_inner + 1) for i in range(n_inner)]
        knots = quantiles(df, [by], {f"_k{s}": F.col(term.col)}, [0.0, *probs, 1.0])
        wide = join_groups(wide, lookup(knots), [by])
        k = lambda i, s=s: F.col(f"_k{s}")[i]
        x = F.col(term.col).cast("double")
        inner = [k(i + 1) for i in range(n_inner)]
        wide, basis = _spline_rows(wide, x, k(0), inner, k(n_inner + 1), term.degree, f"_s{s}_")
        for i, b in enumerate(basis[1:], 1):
            entries.append(F.struct(F.lit(len(fixed)).cast("bigint").alias("t"), F.coalesce(b, F.lit(0.0)).alias("v")))
            fixed.append((len(fixed), f"bs({term.col})[{i}]"))
    names = df.select(F.col(by).alias("d")).distinct().select(
        "d", F.inline(F.array(*(F.struct(F.lit(t).cast("bigint").alias("t"), F.lit(n).alias("name")) for t, n in fixed)))
    )
    if levels:
        vocabulary = reduce(DataFrame.unionByName, levels)
        order = Window.partitionBy("d").orderBy("term", "level")
        vocabulary = pin(vocabulary.withColumn("t", F.lit(len(fixed) - 1) + F.row_number().over(order).cast("bigint")))
        shown = F.element_at(F.create_map(*(F.lit(v) for n, t in enumerate(terms) if not isinstance(t, BS) for v in (n, t.col))), F.col("term"))
        kind = F.when(F.col("term").isin([n for n, t in enumerate(terms) if isinstance(t, C)]), F.concat(F.lit("C("), shown, F.lit(")["))).otherwise(
            F.concat(shown, F.lit("["))
        )
        names = names.unionByName(vocabulary.select("d", "t", F.concat(kind, "level", F.lit("]")).alias("name")))
    for n, term in enumerate(terms):
        if isinstance(term, C):
            known = vocabulary.where(F.col("term") == n).select(F.col("d").alias(by), F.col("level").alias(f"_l{n}"), F.col("t").alias(f"_t{n}"))
            wide = join_groups(wide.withColumn(f"_l{n}", F.col(term.col).cast("string")), lookup(known), [by, f"_l{n}"], "left")
            entries.append(F.struct(F.col(f"_t{n}").alias("t"), F.lit(1.0).alias("v")))
    z = F.filter(F.array(*entries), lambda e: e["t"].isNotNull() & (e["v"] != 0))
    for n, term in enumerate(terms):
        if isinstance(term, Multi):
            pairs = F.map_from_entries(F.collect_list(F.struct("level", "t"))).alias(f"_m{n}")
            known = vocabulary.where(F.col("term") == n).groupBy("d").agg(pairs).withColumnRenamed("d", by)
            wide = join_groups(wide, lookup(known), [by], "left")
            place = F.col(f"_m{n}")
            elements = F.coalesce(F.col(term.col).cast("array<string>"), F.array().cast("array<string>"))
            held = F.array_distinct(_looked_up(place, F.filter(elements, lambda e: e.isNotNull())))
            z = F.concat(z, F.transform(F.filter(held, lambda t: t.isNotNull()), lambda t: F.struct(t.alias("t"), F.lit(1.0).alias("v"))))
    return wide.withColumn(out, z).select(*df.columns, out), names.withColumnRenamed("d", by)


def interact(
    df: DataFrame, cols: Sequence[str], by: str = "dataset"
) -> tuple[DataFrame, list[str]]:
    """Per-dataset indicators and dataset-centred copies of every column."""
    means = df.groupBy(by).agg(*[F.avg(c).alias(f"_mean_{c}") for c in cols])
    means = lookup(means, MAX_TERMS)
    found = [r[by] for r in bounded_rows(means.select(by), MAX_TERMS, by)]
    datasets = sorted(found, key=lambda d: (d is None, "" if d is None else d))
    joined = join_groups(df, means, [by])
    # The names of generated columns.
    new = {f"_dataset={d}": F.col(by).eqNullSafe(F.lit(d)).cast("double") for d in datasets}
    for d in datasets:
        for c in cols:
            centred = F.col(c) - F.col(f"_mean_{c}")
            new[f"_dataset={d}_x_{c}"] = F.when(F.col(by).eqNullSafe(F.lit(d)), centred).otherwise(F.lit(0.0))
    return joined.withColumns(new).drop(*[f"_mean_{c}" for c in cols]), list(new)
