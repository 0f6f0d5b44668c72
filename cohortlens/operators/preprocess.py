"""Imputation, scaling and encoding: fitted by one aggregate, applied as column expressions.

The fitted state is one value per column or one list of categories per column; it is
bounded by the number of columns, never by the number of rows.
"""

from __future__ import annotations

from collections.abc import Sequence
from dataclasses import dataclass, field

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from ..functions.bounded import bounded_rows

#: Code of a category that was not seen when the encoder was fitted (fixed value).
UNKNOWN_CODE = 99
#: Most categories one encoded column may have.
MAX_CATEGORIES = 1_000

NUMERIC = ("double", "float", "int", "bigint", "smallint", "tinyint")


def column_groups(df: DataFrame, cols: Sequence[str] | None = None) -> dict[str, list[str]]:
    """Columns by type: continuous (float or integer), bool, other."""
    groups: dict[str, list[str]] = {"continuous": [], "bool": [], "other": []}
    for name, dtype in df.dtypes:
        if cols is not None and name not in cols:
            continue
        if dtype in NUMERIC or dtype.startswith("decimal"):
            groups["continuous"].append(name)
        elif dtype == "boolean":
            groups["bool"].append(name)
        else:
            groups["other"].append(name)
    return groups


def _col(name: str) -> Column:
    """A column by its whole name, whatever signs that holds."""
    return F.col("`" + name.replace("`", "``") + "`")


def _seen(c: str) -> Column:
    return F.nullif(_col(c).cast("double"), F.lit(float("nan")))


@dataclass
class MeanImputer:
    """Nulls and NaN become the training mean; a column without any value becomes 0."""

    cols: Sequence[str]
    means: dict[str, float] = field(default_factory=dict)

    def fit(self, df: DataFrame) -> MeanImputer:
        if not self.cols:
            return self
        row = df.agg(*[F.avg(_seen(c)).alias(c) for c in self.cols]).first()
        self.means = {c: 0.0 if row[c] is None else float(row[c]) for c in self.cols}
        return self

    def transform(self, df: DataFrame) -> DataFrame:
        return df.withColumns({c: F.coalesce(_seen(c), F.lit(self.means[c])) for c in self.cols})


@dataclass
class Standardizer:
    """(x - mean) / population sd; a constant column is only centred."""

    cols: Sequence[str]
    stats: dict[str, tuple[float, float]] = field(default_factory=dict)

    def fit(self, df: DataFrame) -> Standardizer:
        x = {c: _col(c).cast("double") for c in self.cols}
        row = df.agg(
            *[F.avg(x[c]).alias(f"m{i}") for i, c in enumerate(self.cols)],
            *[F.stddev_pop(x[c]).alias(f"s{i}") for i, c in enumerate(self.cols)],
        ).first()
        for i, c in enumerate(self.cols):
            mean, sd = row[f"m{i}"] or 0.0, row[f"s{i}"] or 0.0
            self.stats[c] = (mean, sd if sd > 10 * 2.3e-16 * max(1.0, abs(mean)) else 1.0)
        return self

    def transform(self, df: DataFrame) -> DataFrame:
        return df.withColumns(
            {
                c: (_col(c).cast("double") - F.lit(mean)) / F.lit(sd)
                for c, (mean, sd) in self.stats.items()
            }
        )


def _categories(df: DataFrame, cols: Sequence[str]) -> dict[str, list]:
    """Sorted distinct values per column (null last), all columns in one job."""
    if not cols:
        return {}
    pairs = df.select(
        F.explode(
            F.array(
                *[
                    F.struct(F.lit(c).alias("col"), _col(c).cast("string").alias("val"))
                    for c in cols
                ]
            )
        ).alias("p")
    ).select("p.*")
    rows = bounded_rows(pairs.distinct(), MAX_CATEGORIES * len(cols), "category list")
    out: dict[str, list] = {c: [] for c in cols}
    for r in rows:
        out[r["col"]].append(r["val"])
    return {c: sorted(v, key=lambda x: (x is None, x or "")) for c, v in out.items()}


@dataclass
class OneHot:
    """One 0/1 column per training category, null counts as its own; unknown gives zeros."""

    cols: Sequence[str]
    categories: dict[str, list] = field(default_factory=dict)

    def fit(self, df: DataFrame) -> OneHot:
        self.categories = _categories(df, self.cols)
        return self

    def names(self) -> list[str]:
        return [f"{c}_{v}" for c in self.cols for v in self.categories[c]]

    def transform(self, df: DataFrame) -> DataFrame:
        hot = {
            f"{c}_{v}": _col(c).cast("string").eqNullSafe(F.lit(v)).cast("double")
            for c in self.cols
            for v in self.categories[c]
        }
        return df.withColumns(hot).drop(*self.cols)


@dataclass
class OrdinalEncoder:
    """Position in the sorted training categories; unknown values get a fixed code."""

    cols: Sequence[str]
    categories: dict[str, list] = field(default_factory=dict)

    def fit(self, df: DataFrame) -> OrdinalEncoder:
        self.categories = _categories(df, self.cols)
        return self

    def transform(self, df: DataFrame) -> DataFrame:
        codes = {}
        for c in self.cols:
            cats = [v for v in self.categories[c] if v is not None]
            listed = F.array(*[F.lit(v) for v in cats]) if cats else F.array().cast("array<string>")
            position = F.array_position(listed, _col(c).cast("string"))
            known = F.when(position > 0, position - 1).otherwise(UNKNOWN_CODE)
            null_code = len(cats) if None in self.categories[c] else UNKNOWN_CODE
            codes[c] = F.when(_col(c).isNull(), null_code).otherwise(known).cast("long")
        return df.withColumns(codes)


def assemble(df: DataFrame, cols: Sequence[str], out: str = "features") -> DataFrame:
    """Ordered feature vector as an array of doubles."""
    return df.withColumn(out, F.array(*[_col(c).cast("double") for c in cols]))


@dataclass
class LinearPreprocessing:
    """Impute continuous, pass booleans, one-hot the rest, then scale everything."""

    cols: Sequence[str]

    def fit(self, df: DataFrame) -> LinearPreprocessing:
        g = column_groups(df, self.cols)
        self.imputer = MeanImputer(g["continuous"]).fit(df)
        self.onehot = OneHot(g["other"]).fit(df) if g["other"] else None
        hot = self.onehot.names() if self.onehot else []
        self.features = [*g["continuous"], *g["bool"], *hot]
        self.scaler = Standardizer(self.features).fit(self._encode(df))
        return self

    def _encode(self, df: DataFrame) -> DataFrame:
        out = self.imputer.transform(df)
        return self.onehot.transform(out) if self.onehot else out

    def transform(self, df: DataFrame) -> DataFrame:
        return self.scaler.transform(self._encode(df))


@dataclass
class TreePreprocessing:
    """Continuous columns pass through, everything else becomes an ordinal code."""

    cols: Sequence[str]

    def fit(self, df: DataFrame) -> TreePreprocessing:
        g = column_groups(df, self.cols)
        self.encoder = OrdinalEncoder([*g["other"], *g["bool"]]).fit(df)
        self.features = [*g["continuous"], *g["other"], *g["bool"]]
        return self

    def transform(self, df: DataFrame) -> DataFrame:
        return self.encoder.transform(df)
