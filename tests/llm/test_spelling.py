"""Spelling variants against plain comparison of all words."""

import re
from collections import Counter
from zlib import crc32

import numpy as np
import pytest

from cohortlens.llm import queries, spelling

SF = "/root/testdata/sf0.001"


def plain_words(rows, least=7):
    counts = Counter()
    for key, text in rows:
        for run in re.findall("[A-Za-zÀ-ÿ]+", text or ""):
            run = "".join(chr(ord(c) + 32) if "A" <= c <= "Z" else c for c in run)
            h = crc32(f"{'' if key is None else key}:{run}".encode())
            if h % 31 == 0:
                at = h % len(run)
                run = run[:at] + run[at + 1 :]
            if len(run) >= least:
                counts[run] += 1
    return {w: n for w, n in counts.items() if n >= 2}


def one_edit(word, letters):
    for i in range(len(word) + 1):
        for c in letters:
            yield word[:i] + c + word[i:]
        if i < len(word):
            yield word[:i] + word[i + 1 :]
            for c in letters:
                yield word[:i] + c + word[i + 1 :]


def plain_groups(words, ratio=10):
    letters = sorted({c for w in words for c in w})
    near = {w: {x for x in one_edit(w, letters) if x in words and x != w} for w in words}
    form = {}
    for w, n in words.items():
        best = min(near[w], key=lambda x: (-words[x], x), default=None)
        form[w] = best if best is not None and words[best] >= ratio * n else None
    out = set()
    for w, n in words.items():
        root = w
        while form[root] is not None:
            root = form[root]
        out.add((w, form[w], root, n, len(near[w]), None if form[w] is None else words[form[w]]))
    return out


def rows_of(df):
    got = [(r["word"], r["form"], r["root"], r["n"], r["n_near"], r["form_n"]) for r in df.collect()]
    assert len(got) == len(set(got))
    return set(got)


def test_query(spark):
    docs = spark.read.parquet(f"{SF}/documents.parquet").select("doc_id", "text").collect()
    assert rows_of(queries.op11(spark, SF)) == plain_groups(plain_words(docs))


@pytest.mark.parametrize("block", [2, 5, 4096])
def test_divided_blocks(spark, block):
    rng = np.random.default_rng(3)
    words = {}
    for _ in range(40):
        w = "".join(rng.choice(list("abé"), rng.integers(7, 12)))
        words[w] = int(rng.integers(2, 2000))
        for x in rng.permutation(list(one_edit(w, "abé")))[:12].tolist():
            if len(x) >= 7:
                words[x] = int(rng.integers(2, 2000))
    # A third of the words share all letters but one, at the beginning, in the middle and at the end.
    for c in "abcdefghijklmnopqrstuvwxyzß":
        words |= {"prefixed" + c: 5, c + "suffixed": 50, "mid" + c + "dle": 500, "prefixed" + c + c: 60}
    df = spark.createDataFrame(list(words.items()), "word string, n bigint")
    assert rows_of(spelling.group_variants(df, block=block)) == plain_groups(words)


def test_chain_of_forms(spark):
    words = {"aaaaaaa": 2, "aaaaaab": 20, "aaaaabb": 200, "aaaabbb": 2000, "aaabbbb": 20000, "aabbbbb": 200000}
    df = spark.createDataFrame(list(words.items()), "word string, n bigint")
    got = {r["word"]: r["root"] for r in spelling.group_variants(df).collect()}
    assert set(got.values()) == {"aabbbbb"}


def test_ties_and_ratio(spark):
    words = {"abcdefg": 3, "abcdefh": 30, "abcdefi": 30, "zzzzzzz": 3, "zzzzzzy": 29}
    df = spark.createDataFrame(list(words.items()), "word string, n bigint")
    got = {r["word"]: (r["form"], r["n_near"]) for r in spelling.group_variants(df).collect()}
    assert got["abcdefg"] == ("abcdefh", 2) and got["zzzzzzz"] == (None, 1) and got["abcdefh"] == (None, 2)


def test_long_words(spark):
    long = "ab" * 3000
    words = {long: 100, long + "c": 5, long[:-1]: 7, long[:4000] + "x" + long[4001:]: 4, "short" + long: 3, "c" + long: 2}
    df = spark.createDataFrame(list(words.items()), "word string, n bigint")
    for letters in (10_000, 1 << 20):
        got = {r["word"]: r["n_near"] for r in spelling.group_variants(df, letters=letters).collect()}
        assert got[long] == 4 and sum(got.values()) == 8 and got["short" + long] == 0


def test_odd_rows(spark):
    texts = [
        (None, "Variant variant VARIANT"),
        (1, None),
        (2, ""),
        (3, "variant variants variant-variants ÀÉÎÕÜÝÞ ÀÉÎÕÜÝÞ"),
        (3, "variant variants variant-variants ÀÉÎÕÜÝÞ ÀÉÎÕÜÝÞ"),
        (4, "x" * 100_000 + " " + "x" * 100_000),
        (5, "naïveté× naïveté× 1234567 1234567 日本語日本語日本 日本語日本語日本"),
        (6, "Repeated words " * 20_000),
    ]
    df = spark.createDataFrame([(k, t, "word", 7, "key") for k, t in texts], "doc_id bigint, text string, word string, n int, key string")
    assert rows_of(spelling.spelling_variants(df)) == plain_groups(plain_words(texts))
    assert spelling.spelling_variants(df.limit(0)).collect() == []
    assert spelling.spelling_variants(df.where("doc_id in (1, 2)")).collect() == []
