"""Sparse anchor designs and projections on them against dense algebra."""

import numpy as np
import pandas as pd
import pytest
from pyspark.sql import functions as F

from cohortlens.operators import anchors as an
from cohortlens.operators import moments as mo


def frame(n=500, levels=6, seed=1):
    rng = np.random.default_rng(seed)
    return pd.DataFrame(
        {
            "id": np.arange(n),
            "dataset": rng.choice(["u", "v", None], n, p=[0.7, 0.2, 0.1]),
            "k": rng.choice([*(f"l{i}" for i in range(levels)), None], n),
            "year": rng.integers(2000, 2012, n).astype(float),
            "codes": [sorted(set(rng.choice(list("abcd"), rng.integers(0, 4)).tolist())) or None for _ in range(n)],
            "y": rng.normal(size=n),
            "x": rng.normal(size=n),
        }
    )


def dense_design(pdf, df):
    """Z from the table of names and the entries of every row."""
    rows = df.select("id", "dataset", F.inline("z")).toPandas()
    rows["d"] = rows["dataset"].fillna("?")
    terms = {k: i for i, k in enumerate(sorted(set(zip(rows["d"], rows["t"]))))}
    z = np.zeros((len(pdf), len(terms)))
    z[rows["id"], [terms[k] for k in zip(rows["d"], rows["t"])]] = rows["v"]
    return z


@pytest.mark.parametrize("terms", [[an.C("k")], [an.C("k"), an.BS("year", 5)], [an.BS("year", 4), an.Multi("codes"), an.C("k")]])
@pytest.mark.parametrize("dense_terms", [200, 0])
def test_projection(spark, monkeypatch, terms, dense_terms):
    monkeypatch.setattr(mo, "DENSE_TERMS", dense_terms)
    pdf = frame()
    df = spark.createDataFrame(pdf).repartition(3)
    made, names = an.sparse_design(df, terms)
    assert made.columns == [*df.columns, "z"] and names.columns == ["dataset", "t", "name"]
    z = dense_design(pdf, made)
    got = mo.project_terms(made, ["y", "x"]).orderBy("id").toPandas()
    for c in ("y", "x"):
        v = pdf[c] - pdf[c].mean()
        np.testing.assert_allclose(got[f"{c}_proj"], z @ np.linalg.lstsq(z, v, rcond=None)[0], atol=1e-8)


def test_same_terms_as_dense_design(spark):
    pdf = frame().dropna(subset=["dataset"])
    df = spark.createDataFrame(pdf)
    terms = [an.C("k"), an.BS("year", 5)]
    wide, labels = an.design_matrix(df, terms)
    made, names = an.sparse_design(df, terms)
    long = wide.select("id", F.posexplode("z").alias("p", "v")).where("v <> 0").toPandas()
    want = {(i, labels[p]): round(v, 9) for i, p, v in zip(long["id"], long["p"], long["v"])}
    rows = made.select("id", "dataset", F.inline("z")).join(names, ["dataset", "t"]).toPandas()
    got = {(i, f"{d}:{n}"): round(v, 9) for i, d, n, v in zip(rows["id"], rows["dataset"], rows["name"], rows["v"])}
    assert got == want


def test_thousands_of_terms(spark):
    """2,500 terms in one dataset, a third of the rows in one level."""
    n = 20_000
    k = F.when(F.col("id") % 3 == 0, F.lit(0)).otherwise(F.pmod(F.xxhash64("id"), F.lit(2500)))
    df = spark.range(0, n, 1, 4).select("id", F.when(F.col("id") % 5 == 0, "b").otherwise("a").alias("dataset"), k.alias("k"), (F.pmod(F.xxhash64("id", F.lit(7)), F.lit(1000)) / 100.0).alias("y"))
    made, names = an.sparse_design(df, [an.C("k")])
    assert names.where("dataset = 'a'").count() > 2300
    got = mo.project_terms(made, ["y"]).groupBy("dataset", "k").agg(F.avg("y").alias("m"), F.min("y_proj").alias("lo"), F.max("y_proj").alias("hi")).toPandas()
    grand = df.agg(F.avg("y")).first()[0]
    np.testing.assert_allclose(got["lo"], got["m"] - grand, atol=1e-9)
    np.testing.assert_allclose(got["hi"], got["m"] - grand, atol=1e-9)


def test_no_rows_and_nulls(spark):
    df = spark.createDataFrame(frame(20))
    made, names = an.sparse_design(df.limit(0), [an.C("k"), an.BS("year", 4)])
    assert made.count() == 0 and names.count() == 0
    same = df.withColumns({"k": F.lit(None).cast("string"), "year": F.lit(2000.0)})
    made, _ = an.sparse_design(same, [an.C("k"), an.BS("year", 4)])
    assert {tuple(e["t"] for e in r["z"]) for r in made.collect()} == {(0,)}
