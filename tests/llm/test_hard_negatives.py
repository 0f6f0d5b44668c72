"""Hard negatives against plain scoring of all rows."""

import math

import numpy as np
import pytest

from cohortlens.llm import hard_negatives, queries

SCHEMA = "vec_id bigint, embedding array<double>, label int"


def plain(rows, every=50):
    """(anchor, positive, rank, negative, scores) by exact integers; rows alike in all count once."""
    known = []
    for key, vec, label in rows:
        if key is None or vec is None or label is None or any(x is None or not math.isfinite(x) for x in vec):
            continue
        row = (key, (label + 1) % 10 if key % 7 == 0 else label, tuple(math.floor(256 * x) for x in vec))
        if row not in known:
            known.append(row)
    out = []
    for a in (r for r in known if r[0] % every == 0):
        scored = sorted((-sum(x * y for x, y in zip(a[2], r[2])), r[0], r[1]) for r in known if r[0] != a[0] and len(r[2]) == len(a[2]))
        for p, key, _ in [s for s in scored if s[2] == a[1]][:5]:
            hard = [s for s in scored if s[2] != a[1] and 50 * -p <= 100 * -s[0] <= 95 * -p][:3]
            out += [(a[0], key, k + 1, s[1], -p, -s[0]) for k, s in enumerate(hard)]
    return sorted(out)


def mined(df, **options):
    names = ["anchor_id", "positive_id", "rank", "negative_id", "positive_score", "negative_score"]
    return sorted(tuple(r[n] for n in names) for r in hard_negatives.mine(df, **options).collect())


def test_query(spark):
    sf = "/root/testdata/sf0.01"
    rows = [(r.vec_id, r.embedding, r.label) for r in spark.read.parquet(f"{sf}/embeddings.parquet").collect()]
    got = sorted(map(tuple, queries.op13(spark, sf).collect()))
    assert got == plain(rows) and len(got) > 50


@pytest.mark.parametrize("tree, sent", [(4, 8), (7, 1000), (1000, 1000)])
def test_trees_and_scans(spark, tree, sent):
    """A third of the rows lie around one direction; many scores tie."""
    rng = np.random.default_rng(tree)
    v = rng.integers(-2, 3, (600, 6)) / 4
    v[::3] = np.array([2, 1, 0, 0, 1, 0]) + rng.integers(-1, 2, (200, 6)) / 8
    rows = [(int(i), v[i].tolist(), int(i % 3)) for i in range(600)]
    df = spark.createDataFrame(rows, SCHEMA).repartition(3)
    want = plain(rows, every=10)
    assert mined(df, every=10, tree=tree, sent=sent) == want and len(want) > 300


def test_odd_rows(spark):
    rng = np.random.default_rng(5)
    rows = [(int(i), [*rng.normal(size=4).round(2).tolist()], int(i % 2)) for i in range(0, 300, 5)]
    rows += [rows[10], rows[11], (0, [1.0, 1.0, 1.0, 1.0], 1), (50, [9.0, 0.0, 0.0, 0.0], 0)]
    rows += [(None, [1.0] * 4, 1), (400, None, 1), (450, [1.0] * 4, None), (500, [1.0, None, 1.0, 1.0], 1), (550, [1.0, math.nan, 1.0, 1.0], 0)]
    rows += [(600, [math.inf] * 4, 0), (650, [], 1), (651, [], 0), (652, [], 1), (700, [2.0, 2.0], 1), (701, [2.0, 3.0], 1), (702, [2.0, 1.0], 0)]
    rows += [(800, [0.0] * 4, 1), (-50, [1.0, 0.5, 0.25, 0.0], 0), (-49, [1.0, 0.5, 0.25, 0.0], 3)]
    df = spark.createDataFrame([(*r, "x", 1.0, 3) for r in rows], SCHEMA + ", vec string, score double, row int")
    got = mined(df, tree=3, sent=6)
    assert got == plain(rows) and got
    assert mined(df.limit(0)) == []


def test_long_scores(spark):
    rows = [(50, [3e11, 1.0], 1), (51, [2e11, 3.0], 1), (52, [1.5e11, 7.0], 2), (53, [1.5e11, 6.0], 2), (54, [1e300, 1.0], 2)]
    got = mined(spark.createDataFrame(rows, SCHEMA))
    score = lambda a, b: min((1 << 63) - 1, sum(math.floor(256 * x) * math.floor(256 * y) for x, y in zip(a, b)))
    assert score(rows[0][1], rows[1][1]) == (1 << 63) - 1  # held to the end of a long
    assert [g[:4] for g in got] == [] or all(g[4] == (1 << 63) - 1 for g in got)
    rows = [(50, [3e6, 1.0], 1), (51, [2e6, 3.0], 1), (52, [1.5e6, 7.0], 2), (53, [1.5e6, 6.0], 2)]
    assert mined(spark.createDataFrame(rows, SCHEMA)) == plain(rows) != []


def test_spanning_tree():
    rng = np.random.default_rng(1)
    x = rng.normal(size=(60, 3))
    order, parent, length = hard_negatives.spanning_tree(x)
    assert sorted(order) == list(range(60)) and parent[0] == -1
    seen = set()
    for k in order:
        assert parent[k] == -1 or parent[k] in seen
        seen.add(k)
    # Kruskal's total.
    d = np.sqrt(((x[:, None] - x[None]) ** 2).sum(-1))
    roots, total = list(range(60)), 0.0
    for i, j in sorted(((i, j) for i in range(60) for j in range(i)), key=lambda p: d[p]):
        if roots[i] != roots[j]:
            roots, total = [roots[i] if r == roots[j] else r for r in roots], total + d[i, j]
    assert abs(length.sum() - total) < 1e-9
