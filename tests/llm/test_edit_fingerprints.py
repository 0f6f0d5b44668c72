"""Edit fingerprints against a walk taken step by step, and near copies against all pairs."""

import hashlib

import numpy as np
import pytest

from cohortlens.llm import edit_fingerprints as ef
from cohortlens.llm import queries
from cohortlens.session import pin
from tests.llm.test_near_duplicates import closure

WALK = ef.Walk()


def plain_walk(text):
    """Characters at the sampled steps, one step of the walk at a time."""
    rng = np.random.default_rng(ef.SEED)
    coins = rng.random((ef.CLASSES, ef.PERIOD)) < 0.5
    coins[:, ::64] = True
    steps, at, i, shown = WALK.steps.tolist(), 0, 0, ""
    for step in range(10**9):
        if i >= len(text):
            return shown
        if steps[at] == step:
            mixed = (ord(text[i]) + 1) * int(WALK.salt[at]) % 2**64
            mixed = (mixed ^ (mixed >> 32)) * 0xD6E8FEB86659FD93 % 2**64
            shown, at = shown + f"{mixed >> 60:x}", at + 1
        kind = (ord(text[i]) * 0x9E3779B97F4A7C15 % 2**64) >> ef.SHIFT
        i += bool(coins[kind, step % ef.PERIOD])
    raise AssertionError


def plain_like(a, b):
    n, m = sorted((len(a), len(b)))
    return sum(WALK.weight[i] for i in range(n) if a[i] == b[i]) / WALK.weight[:m].sum() if m else 1.0


def plain_rows(rows):
    """Expected results of distinct ids."""
    rows = sorted(((k, t or "") for k, t in rows), key=lambda r: -np.inf if r[0] is None else r[0], reverse=True)
    out = {}
    for (key, text), (_, follow) in zip(rows, rows[1:] + rows[:1]):
        h = len(text) // 2
        edited = text[: len(text) - h] + follow[:h]
        a, b, c = plain_walk(text), plain_walk(edited), plain_walk(follow)
        out[key] = (len(text), hashlib.sha256(edited.encode()).hexdigest(), a, b, plain_like(a, b), plain_like(a, c))
    return out


def told(df, key="id"):
    names = ["n_chars", "edited_sha256", "fingerprint", "edited_fingerprint", "near_edited", "near_next"]
    rows = df.collect()
    assert len({r[key] for r in rows}) == len(rows)
    return {r[key]: tuple(r[n] for n in names) for r in rows}


def same(got, want):
    assert got.keys() == want.keys()
    for k in want:
        assert got[k][:4] == want[k][:4], k
        assert got[k][4:] == pytest.approx(want[k][4:])


def test_query(spark):
    sf = "/root/testdata/sf0.001"
    docs = [(r.doc_id, r.text) for r in spark.read.parquet(f"{sf}/documents.parquet").collect()]
    got = queries.op12(spark, sf)
    same(told(got, "doc_id"), plain_rows(docs))
    rows = got.collect()
    assert sum(r.near_edited > r.near_next + 0.2 for r in rows) > 0.95 * len(rows)


@pytest.mark.parametrize("part_bytes", [1, 300, 1 << 20])
def test_parts_meet(spark, part_bytes):
    rng = np.random.default_rng(2)
    rows = [(int(i), "".join(rng.choice(list("abc é日"), rng.integers(0, 60)))) for i in rng.permutation(90)]
    df = spark.createDataFrame([(*r, 1, "x") for r in rows], "doc_id bigint, text string, part int, edge string")
    same(told(ef.fingerprints(df, part_bytes=part_bytes)), plain_rows(rows))


def test_odd_rows(spark):
    long = "The walk goes on. " * 8000 + "𝔘nicode"
    rows = [(5, None), (4, ""), (3, "a"), (2, "ab"), (None, "last of all"), (9, long), (8, long[1:]), (7, "ß" * 70_000)]
    df = spark.createDataFrame(rows, "doc_id bigint, text string")
    got = told(ef.fingerprints(df))
    same(got, plain_rows(rows))
    assert got[9][5] > 0.9  # one letter less at the beginning
    assert ef.fingerprints(df.limit(0)).collect() == []
    assert ef.near_copies(ef.fingerprints(df.limit(0))).collect() == []
    one = ef.fingerprints(df.where("doc_id = 9")).first()
    assert one.near_next == 1.0 and one.near_edited > 0.5


def test_repeated_ids(spark):
    df = spark.createDataFrame([(1, "same text"), (1, "same text"), (1, "other"), (2, "x"), (None, None), (None, None)], "doc_id bigint, text string")
    rows = ef.fingerprints(df, part_bytes=8).collect()
    assert len(rows) == 6 and len({r.fingerprint for r in rows if r.n_chars == 9}) == 1


@pytest.mark.parametrize("edit", ["insert", "delete", "replace", "move"])
def test_edits_keep_walks_alike(edit):
    rng = np.random.default_rng(7)
    base = "".join(rng.choice(list("abcdefghij "), 4000))
    likes = []
    for _ in range(30):
        at = int(rng.integers(0, 3900))
        changed = {
            "insert": base[:at] + "xyz" + base[at:],
            "delete": base[:at] + base[at + 3 :],
            "replace": base[:at] + "xyz" + base[at + 3 :],
            "move": base[:at] + base[at + 3 :] + base[at : at + 3],
        }[edit]
        likes.append(WALK.likeness(WALK.go(base)[2], WALK.go(changed)[2]))
    other = "".join(rng.choice(list("abcdefghij "), 4000))
    assert np.median(likes) > 0.9 and WALK.likeness(WALK.go(base)[2], WALK.go(other)[2]) < 0.35


def plain_near(shown, near=ef.NEAR):
    return [(i, j) for i in range(len(shown)) for j in range(i) if plain_like(shown[i], shown[j]) >= near]


@pytest.mark.parametrize("band", [8, ef.BAND])
def test_near_copies_recall(spark, band):
    """A third of the texts are versions of one, others come in pairs; bands of 8 are divided again and again."""
    rng = np.random.default_rng(4)
    draw = lambda n: "".join(rng.choice(list("etaoinshr d"), n))
    base, texts = draw(1500), []
    for i in range(100):
        at = int(rng.integers(0, 1500))
        texts.append(base[:at] + draw(int(rng.integers(0, 4))) + base[at:])
    for i in range(100):
        one = draw(int(rng.integers(20, 2000)))
        at = int(rng.integers(0, len(one)))
        texts += [one, one[:at] + draw(1) + one[at + 1 :]]
    shown = [ef._shown(WALK.go(t)[2]) for t in texts]
    df = spark.createDataFrame([(i, s, 0, "c") for i, s in enumerate(shown)], "id bigint, fingerprint string, cls int, shown string").repartition(4)
    got = {r.id: r.component for r in ef.near_copies(df, band=band).collect()}
    pairs = plain_near(shown)
    want = closure(len(shown), pairs)
    found = np.mean([got[i] == got[j] for i, j in pairs])
    assert found >= 0.95
    assert all(want[i] == want[got[i]] for i in range(len(shown)))  # nothing is united that is not near


def test_large_bands_lose_no_link(spark):
    """Versions that are near some others and not the head of their band: divided bands unite what one whole band does."""
    rng = np.random.default_rng(11)
    digits = list("0123456789abcdef")
    base, shown = rng.choice(digits, 3 * ef.SAMPLES), []
    for _ in range(60):
        one = base.copy()
        at = rng.permutation(len(one))[: len(one) // 3]
        one[at] = rng.choice(digits, len(at))
        shown.append("".join(one))
        at = rng.permutation(len(one))[: len(one) // 8]
        one[at] = rng.choice(digits, len(at))
        shown.append("".join(one))
    df = spark.createDataFrame(list(enumerate(shown)), "id bigint, fingerprint string").repartition(4)
    united = lambda band: {r.id: r.component for r in ef.near_copies(df, near=0.75, band=band).collect()}
    assert united(2) == united(10**6)


def test_classes_left_apart_are_compared_in_tiles(spark):
    """Every near pair of different components is linked, whatever the tiles; pairs within one are not looked at."""
    rng = np.random.default_rng(12)
    base = "".join(rng.choice(list("0123456789abcdef"), 96))
    shown = [base[:k] + "".join(rng.choice(list("0123456789abcdef"), 24)) + base[k + 24 :] for k in range(0, 72, 2)]
    fps = spark.createDataFrame(list(enumerate(shown)), "cls bigint, fingerprint string")
    whole = spark.createDataFrame([(i, 7) for i in range(len(shown))], "cls bigint, key bigint")
    one = spark.createDataFrame([(i, 0) for i in range(5)], "node bigint, component bigint")
    near = lambda: {(i, j) for i, j in plain_near(shown, 0.6) if i >= 5 or j >= 5}
    for tile in (5, 100):
        got = {(max(r), min(r)) for r in ef._apart(whole, one, fps, 0.6, tile).collect()}
        assert got == near() and got
    alone = spark.createDataFrame([(i, 0) for i in range(len(shown))], "node bigint, component bigint")
    assert ef._apart(whole, alone, fps, 0.6).isEmpty()


def test_large_bands_take_few_passes(spark, monkeypatch):
    """Fingerprints that agree in a whole octave are divided to the end: a few tables are written, not one in four digits."""
    written = []
    monkeypatch.setattr(ef, "pin", lambda df: written.append(df.columns) or pin(df))
    shown = [f"{'7' * ef.SAMPLES}{i:048x}" for i in range(40)]
    df = spark.createDataFrame(list(enumerate(shown)), "id bigint, fingerprint string")
    got = {r.id: r.component for r in ef.near_copies(df, band=4).collect()}
    want = closure(len(shown), plain_near(shown))
    assert got == dict(enumerate(want))
    assert sum("octave" in c for c in written) <= 2 * (len(ef.FURTHER) + 1) <= 8
    assert sum(ef.FURTHER) == ef.SAMPLES


def test_links_between_components_join_them(spark):
    united = spark.createDataFrame([(1, 1), (2, 1), (5, 5), (6, 5), (8, 8), (9, 8)], "node bigint, component bigint")
    links = spark.createDataFrame([(6, 2), (9, 20), (30, 31), (31, 30)], "a bigint, b bigint")
    got = sorted(map(tuple, ef._merged(united, links).collect()))
    assert got == [(1, 1), (2, 1), (5, 1), (6, 1), (8, 8), (9, 8), (20, 8), (30, 30), (31, 30)]
