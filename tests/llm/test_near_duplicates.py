"""SimHash, embedding near-duplicates and connected components against brute force."""

import math
import re

import numpy as np
import pytest
import xxhash

from cohortlens.llm import components as components_module
from cohortlens.llm import embedding_dedup, simhash
from cohortlens.llm.common import merge_labels
from cohortlens.llm.components import components
from cohortlens.session import pinned

DOCS = "id bigint, doc_id bigint, text string, fp string"


def plain_fingerprint(text, shingle=4):
    low = "".join(chr(ord(c) + 32) if "A" <= c <= "Z" else c for c in text or "")
    words = re.findall(r"[^\x20\x09-\x0D]+", low)
    rows = [" ".join(words[i : i + shingle]) for i in range(len(words) - shingle + 1)] or [" ".join(words)] * bool(words)
    hashes = [xxhash.xxh64_intdigest(r.encode(), 42) for r in rows]
    return sum(1 << b for b in range(64) if 2 * sum((h >> b) & 1 for h in hashes) > len(hashes))


def closure(n, pairs):
    labels = np.arange(n)
    for u, v in pairs:
        labels = merge_labels(labels, np.array([u]), np.array([v]))
    return labels


@pytest.mark.parametrize("text", [None, "", " \t ", "One", "one two THREE", "a b c d e", "a b a b a b a b a b", "Ünïcode İ ß\x0bx", "w " * 70_000])
def test_fingerprint(text):
    assert simhash.fingerprint(text) == plain_fingerprint(text)


@pytest.mark.parametrize("distance", [0, 1, 3, 4, 6])
def test_trie_join_links_what_is_near(distance):
    rng = np.random.default_rng(distance)
    keys = [rng.integers(0, 2**63, 60, dtype=np.uint64)]
    for _ in range(5):
        far = keys[0].copy()
        for _ in range(rng.integers(0, 7)):
            far ^= np.uint64(1) << rng.integers(0, 64, len(far), dtype=np.uint64)
        keys.append(far)
    keys = np.unique(np.concatenate(keys))
    near = [(i, j) for i in range(len(keys)) for j in range(i) if int(keys[i] ^ keys[j]).bit_count() <= distance]
    labels = np.arange(len(keys))
    turn = lambda k: (k << np.uint64(32)) | (k >> np.uint64(32))
    for swap, half in [(0, distance // 2)] + [(1, distance - distance // 2 - 1)] * bool(distance):
        for u, v in simhash.trie_join(np.sort(turn(keys) if swap else keys), None, 0, 0, half, distance):
            u, v = (turn(u), turn(v)) if swap else (u, v)
            labels = merge_labels(labels, np.searchsorted(keys, u), np.searchsorted(keys, v))
    assert np.array_equal(labels, closure(len(keys), near))


@pytest.mark.parametrize("node_size", [4, 1 << 20])
def test_links_over_several_nodes(spark, node_size):
    rng = np.random.default_rng(8)
    base = rng.integers(0, 2**63, 50, dtype=np.uint64)
    flips = np.uint64(1) << rng.integers(0, 64, (3, 50), dtype=np.uint64)
    keys = np.unique(np.concatenate([base, base ^ flips[0], base ^ flips[0] ^ flips[1] ^ flips[2]]))
    df = spark.createDataFrame([(int(k),) for k in keys.view(np.int64)], "fp bigint")
    got = {r["node"]: r["component"] for r in components(simhash.links(df, 4, node_size)).collect()}
    signed = keys.view(np.int64)
    near = [(i, j) for i in range(len(keys)) for j in range(i) if int(keys[i] ^ keys[j]).bit_count() <= 4]
    labels = closure(len(keys), near)
    least = {c: min(signed[labels == c].tolist()) for c in set(labels.tolist())}
    assert all(got.get(int(s), int(s)) == least[c] for s, c in zip(signed, labels.tolist(), strict=True))


def test_components(spark):
    chain = [(k, k + 1) for k in range(40)] + [(100, 101), (101, 100), (7, 7), (None, 3), (200, 150), (150, 199), (199, 200)]
    got = {r["node"]: r["component"] for r in components(spark.createDataFrame(chain, "a bigint, b bigint")).collect()}
    assert got == {**{k: 0 for k in range(41)}, 100: 100, 101: 100, 150: 150, 199: 150, 200: 150}
    assert components(spark.createDataFrame([], "a bigint, b bigint")).count() == 0


def test_settled_links_take_no_round(spark, monkeypatch):
    """Links that one task reads are stars at once; links in several tasks are joined in rounds."""
    rounds = []
    small_star = components_module._small_star
    monkeypatch.setattr(components_module, "_small_star", lambda edges: rounds.append(1) or small_star(edges))
    chain = [(k, k + 1) for k in range(50)] + [(70, 70), (None, 3), (80, 81), (81, 80)]
    df = spark.createDataFrame(chain, "a bigint, b bigint")
    want = {k: 0 for k in range(51)} | {80: 80, 81: 80}
    assert {r["node"]: r["component"] for r in components(df.coalesce(1)).collect()} == want and not rounds
    assert {r["node"]: r["component"] for r in components(df.repartition(7)).collect()} == want and rounds


def test_links_are_written_before_stars_are_made(spark, monkeypatch):
    read = []
    monkeypatch.setattr(simhash, "components", lambda links: read.append(pinned(links)) or components(links))
    rows = [(i, i, t, None) for i, t in enumerate(["a b c d e", "a b c d e", "A b C d e", "x y z"])]
    kept = simhash.keep_representatives(spark.createDataFrame(rows, DOCS))
    assert sorted(r["doc_id"] for r in kept.collect()) == [0, 3] and read == [True]


def test_simhash_rows(spark):
    long = " ".join(f"w{k}" for k in range(3000))
    rows = [
        (9, 5, "the same text of some words here", "x"),
        (9, 3, "the same  text of SOME words here", "y"),
        (1, 3, "the same text of some words here", "y"),
        (1, 8, None, None),
        (1, 7, "", "z"),
        (1, None, " \n", "z"),
        (1, None, "quite another text that stands alone", "z"),
        (2, 11, long, "q"),
        (2, 12, long + " end", "q"),
    ]
    got = simhash.near_duplicates(spark.createDataFrame(rows, DOCS)).collect()
    assert len(got) == len(rows)
    parts = sorted((str(r["id"]), str(r["component"])) for r in got)
    assert parts == sorted(
        [("5", "3"), ("3", "3"), ("3", "3"), ("8", "7"), ("7", "7"), ("None", "7"), ("None", "None"), ("11", "11"), ("12", "11")]
    )
    assert simhash.near_duplicates(spark.createDataFrame([], DOCS)).count() == 0
    kept = simhash.keep_representatives(spark.createDataFrame(rows, DOCS)).collect()
    assert sorted((str(r["doc_id"]), str(r["id"])) for r in kept) == [("11", "2"), ("3", "1"), ("7", "1"), ("None", "1")]
    assert kept[0].asDict().keys() == {"id", "doc_id", "text", "fp"}


def brute_vectors(vectors, threshold=0.95):
    n = len(vectors)
    links = [[] for _ in range(n)]
    for i in range(n):
        for j in range(n):
            x, y = vectors[i], vectors[j]
            if i != j and x is not None and y is not None and len(x) == len(y):
                a, b = np.array(x, float), np.array(y, float)
                if np.isfinite(a).all() and np.isfinite(b).all() and a.any() and b.any():
                    if a @ b / math.sqrt(a @ a) / math.sqrt(b @ b) >= threshold:
                        links[i].append(j)
    return [len(x) for x in links], closure(n, [(i, j) for i in range(n) for j in links[i]])


def test_vectors_against_brute_force(spark):
    rng = np.random.default_rng(3)
    base = rng.standard_normal((40, 16))
    rows = [base[k % 40] + rng.standard_normal(16) * 0.05 * (k % 5) for k in range(200)]
    rows += [base[0] * (1 + k) for k in range(60)] + [base[1]] * 30
    vectors = [np.float32(r).tolist() for r in rows]
    odd = [None, [], [0.0] * 16, [float("nan")] * 16, [float("inf")] + [1.0] * 15, [None] + [1.0] * 15, [1.0] * 3, [2.0] * 3]
    vectors += odd
    table = [(k, v, "x", 0) for k, v in enumerate(vectors)]
    df = spark.createDataFrame(table, "vec_id bigint, embedding array<float>, id string, cls int")
    counts, labels = brute_vectors([None if v is None or None in v else v for v in vectors])
    for window, part_rows, tile in ((64, 1 << 16, 1024), (8, 100, 16)):
        got = {r["id"]: r for r in embedding_dedup.near_duplicates(df, window=window, part_rows=part_rows, tile=tile).collect()}
        assert len(got) == len(vectors)
        right = np.mean([got[k]["n_links"] == counts[k] and got[k]["component"] == labels[k] for k in got])
        assert right >= 0.97
        assert all(got[k]["kept"] == (got[k]["component"] == k) for k in got)
        assert all(got[k]["n_links"] <= counts[k] for k in got)


def test_vector_rows_and_recall(spark):
    rng = np.random.default_rng(4)
    base = rng.standard_normal((1500, 32))
    other = base + 0.28 * rng.standard_normal((1500, 32))
    rows = [(k, v.tolist()) for k, v in enumerate(np.concatenate([base, other]))]
    df = spark.createDataFrame(rows, "vec_id bigint, embedding array<double>")
    unit = np.concatenate([base, other])
    unit /= np.linalg.norm(unit, axis=1)[:, None]
    true = (unit @ unit.T >= 0.95).sum() - len(unit)
    found = sum(r["n_links"] for r in embedding_dedup.near_duplicates(df, part_rows=1000).collect())
    assert 0.9 * true <= found <= true
    same = [(None, [1.0, 2.0]), (4, [1.0, 2.0]), (4, [1.0, 2.0]), (None, [5.0, -1.0])]
    got = embedding_dedup.near_duplicates(spark.createDataFrame(same, "vec_id bigint, embedding array<double>")).collect()
    assert sorted((str(r["id"]), r["n_links"], str(r["component"]), r["kept"]) for r in got) == [
        ("4", 2, "4", True), ("4", 2, "4", True), ("None", 0, "None", True), ("None", 2, "4", False)
    ]
    assert embedding_dedup.near_duplicates(spark.createDataFrame([], "vec_id bigint, embedding array<float>")).count() == 0


@pytest.mark.parametrize("n, mutual", [(20_000, 0.8), (20_000, 0.9), (60_000, 0.8), (60_000, 0.9)])
def test_recall_around_one_direction(spark, n, mutual):
    """A third of the vectors lie around one direction; planted pairs are at the threshold, there and elsewhere."""
    rng = np.random.default_rng(n)
    unit = lambda m: m / np.linalg.norm(m, axis=-1, keepdims=True)
    around, size = unit(rng.standard_normal(64)), 64

    def partner(v):
        side = rng.standard_normal(v.shape)
        side = unit(side - (side * v).sum(1, keepdims=True) * v)
        cosine = rng.uniform(0.952, 0.99, (len(v), 1))
        return cosine * v + np.sqrt(1 - cosine**2) * side

    dense = unit(math.sqrt(mutual) * around + math.sqrt(1 - mutual) * unit(rng.standard_normal((n // 3, size))))
    rest = unit(rng.standard_normal((n - len(dense), size)))
    vectors = np.concatenate([dense, rest, partner(dense[:400]), partner(rest[:200])])
    df = spark.createDataFrame([(i, v.tolist()) for i, v in enumerate(vectors)], "vec_id bigint, embedding array<double>").repartition(8)
    got = embedding_dedup.near_duplicates(df).collect()
    component, links = np.empty(len(vectors), np.int64), np.empty(len(vectors), np.int64)
    for r in got:
        component[r["id"]], links[r["id"]] = r["component"], r["n_links"]
    exact = np.zeros(len(vectors), np.int64)
    hits = {True: [], False: []}
    for s in range(0, len(vectors), 2000):
        i, j = np.nonzero(vectors[s : s + 2000] @ vectors.T >= 0.95)
        i += s
        np.add.at(exact, i[i != j], 1)
        for k in (True, False):
            at = (i < j) & ((i < len(dense)) == k)
            hits[k].append(component[i[at]] == component[j[at]])
    assert np.mean(np.concatenate(hits[True])) >= 0.95 and np.mean(np.concatenate(hits[False])) >= 0.95
    assert (links <= exact).all() and links.sum() >= 0.95 * exact.sum()
