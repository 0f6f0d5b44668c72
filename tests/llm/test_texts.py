"""Suffix dedup, BPE, licences and decontamination against plain versions."""

import hashlib
import random
import textwrap
import tracemalloc

import numpy as np
import pytest

from cohortlens.llm import bpe, contamination, licenses, suffix_dedup

public_tokenizers = pytest.importorskip("public_tokenizers")
PATH = public_tokenizers.path("word_bpe_49k.json")


def plain_removal(docs, length):
    """Expects documents in their order; returns (kept, spans) of each."""
    seen, out = set(), []
    for text in docs:
        raw = (text or "").encode()
        gone = bytearray(len(raw))
        for k in range(len(raw) - length + 1):
            part = raw[k : k + length]
            if part in seen:
                gone[k : k + length] = b"\1" * length
            seen.add(part)
        kept = bytes(b for b, g in zip(raw, gone, strict=True) if not g)
        starts = [k for k in range(len(raw)) if gone[k] and (k == 0 or not gone[k - 1])]
        out.append((kept, starts))
    return out


def test_same_strings():
    rnd = random.Random(5)
    for _ in range(25):
        length = rnd.choice([2, 4, 5, 6, 7, 10, 12])
        texts = [bytes(rnd.choice(b"ab") for _ in range(rnd.randint(length, length + 9))) for _ in range(rnd.randint(1, 12))]
        text, start, group = (x.tolist() for x in suffix_dedup.same_strings(texts, length))
        assert len(set(zip(text, start, strict=True))) == len(text) == sum(len(t) - length + 1 for t in texts)
        strings = [texts[t][s : s + length] for t, s in zip(text, start, strict=True)]
        assert len(set(zip(strings, group, strict=True))) == len(set(strings)) == len(set(group))


def test_long_strings_take_few_columns(monkeypatch):
    """Strings of 100 bytes are five columns; texts with few strings give no document that could not hold one."""
    grown = []
    insert = suffix_dedup.Columns.insert
    monkeypatch.setattr(suffix_dedup.Columns, "insert", lambda self: grown.append(len(self.sizes)) or insert(self))
    rnd = random.Random(6)
    part = bytes(rnd.choice(b"ab") for _ in range(120))
    texts = [part, b"x" + part, part[3:110], part[:100], part[20:] + b"y" * 50]
    text, start, group = (x.tolist() for x in suffix_dedup.same_strings(texts, 100))
    strings = [texts[t][s : s + 100] for t, s in zip(text, start, strict=True)]
    assert len(set(zip(text, start, strict=True))) == len(text) == sum(len(t) - 99 for t in texts)
    assert len(set(zip(strings, group, strict=True))) == len(set(strings)) == len(set(group))
    assert len(grown) <= 9 and grown[0] == 20 + 20 + 8 + 1 + 20


def test_a_part_of_a_bin_is_a_small_collection(monkeypatch):
    """What a Python worker once took stays with it; a symbol takes some fifty bytes, here of runs of 125 bytes."""
    grown = []
    made = suffix_dedup.Columns.__init__
    monkeypatch.setattr(suffix_dedup.Columns, "__init__", lambda self, symbols, *a: grown.append(len(symbols)) or made(self, symbols, *a))
    texts = np.random.default_rng(4).integers(0, 256, (suffix_dedup.BIN // suffix_dedup.PARTS // 125, 125), np.uint8)
    texts = [t.tobytes() for t in texts]
    n = len(texts)
    bits = suffix_dedup._later(texts + texts[:1], np.arange(n + 1), np.zeros(n + 1, np.int64), 100)
    assert not bits[:-1].any() and bits[-1] == (1 << 26) - 1
    assert len(grown) == 1 and grown[0] < 800_000


def test_whole_characters_of_a_long_text(monkeypatch):
    monkeypatch.setattr(suffix_dedup, "CHUNK", 5)
    text = "aé€😀b" * 7
    raw = np.frombuffer(text.encode(), np.uint8)
    gone = np.random.default_rng(2).random(len(raw)) < 0.8
    at, wanted = 0, []
    for c in text:
        n = len(c.encode())
        wanted += [bool(gone[at : at + n].all())] * n
        at += n
    assert suffix_dedup._whole(raw, gone).tolist() == wanted and 0 < sum(wanted) < sum(gone)
    monkeypatch.undo()
    raw = np.frombuffer(text.encode() * 50_000, np.uint8)
    gone = np.ones(len(raw), bool)
    tracemalloc.start()
    try:
        assert suffix_dedup._whole(raw, gone).all()
        peak = tracemalloc.get_traced_memory()[1]
    finally:
        tracemalloc.stop()
    assert peak < 3 * len(raw)


@pytest.mark.parametrize("width", range(1, 21))
def test_numbered(width):
    rnd = random.Random(width)
    raw = bytes(rnd.choice(b"ab") for _ in range(300)) * 2
    numbers = suffix_dedup._numbered(np.frombuffer(raw, np.uint8), width).tolist()
    strings = [raw[k : k + width] for k in range(len(raw) - width + 1)]
    assert len(numbers) == len(strings) and min(numbers) == 0
    assert len(set(zip(strings, numbers, strict=True))) == len(set(strings)) == len(set(numbers)) == max(numbers) + 1
    assert len(suffix_dedup._numbered(np.frombuffer(raw[: width - 1], np.uint8), width)) == 0


@pytest.mark.parametrize("length, sizes", [(12, {}), (12, {"block": 400, "bin_bytes": 300, "hot": 1}), (100, {"block": 2000, "bin_bytes": 900, "hot": 3})])
def test_removal_against_brute_force(spark, length, sizes):
    rnd = random.Random(length)
    words = ["alpha", "beta", "gamma", "délta", "漢字", "x"]
    passage = " ".join(rnd.choice(words) for _ in range(60))
    texts = [None, "", passage, passage, passage[:length], "a" * 500, "a" * 30, "é" * 200, passage[7:] + "!" + passage[:90]]
    texts += [" ".join(rnd.choice(words) for _ in range(rnd.randint(0, 60))) + passage[rnd.randint(0, 50) :] * rnd.randint(0, 1) for _ in range(60)]
    order = list(range(len(texts)))
    rnd.shuffle(order)
    rows = [(i, texts[i], "k", i) for i in order]
    df = spark.createDataFrame(rows, "doc_id bigint, text string, kept string, id bigint").repartition(3)
    got = {r["id"]: r for r in suffix_dedup.remove_repeats(df, length=length, **sizes).collect()}
    for i, (kept, starts) in enumerate(plain_removal(texts, length)):
        assert bytes(got[i]["kept"]) == kept and list(got[i]["starts"]) == starts
        assert got[i]["n_bytes"] - len(kept) == sum(got[i]["stops"]) - sum(got[i]["starts"])


def test_removal_of_odd_rows(spark):
    text = "the quick brown fox jumps over the lazy dog"
    rows = [(None, text, "n"), (3, text, "a"), (3, text, "a"), (3, "é" + text[3:], "b"), (4, None, None)]
    df = spark.createDataFrame(rows, "doc_id bigint, text string, source string")
    got = suffix_dedup.remove_repeats(df, length=10, carry=("source",), whole_characters=True).collect()
    assert sorted((str(r["id"]), r["source"] or "", bytes(r["kept"]).decode()) for r in got) == sorted(
        [("None", "n", text), ("3", "a", ""), ("3", "a", ""), ("3", "b", "é"), ("4", "", "")]
    )
    assert suffix_dedup.remove_repeats(df.limit(0), length=10).count() == 0
    odd = spark.createDataFrame([(1, "1234567890é"), (2, "1234567890è")], "doc_id bigint, text string")
    kept = {r["id"]: bytes(r["kept"]) for r in suffix_dedup.remove_repeats(odd, length=11, whole_characters=True).collect()}
    assert kept[2].decode() == "è"  # its first byte repeats, the character does not


ALPHABET = ["a", "B", "é", "e", "́", "'s", "'", "r", "1", "２", "!", "<|endoftext|>", "<|", " ", "\n", " ", "\x0b", "漢", "İ", "Σ", "🙂", "‍", "ᄀ", "ᅡ", "|>", "the", "ﬁ", "̈"]


def library():
    from tokenizers import Tokenizer

    return Tokenizer.from_file(PATH)


def test_tree_concatenation():
    rnd, lib, own = random.Random(3), library(), bpe.Encoder(PATH)
    for _ in range(1500):
        text = "".join(rnd.choice(ALPHABET) for _ in range(rnd.randint(0, 60)))
        own.leaf = rnd.choice([1, 2, 3, 7])
        want = lib.encode(text, add_special_tokens=False).ids
        assert own.encode(text) == want
        assert " ".join(u.decoded for u in own.tree(text) if u.n) == own.decode(want) == lib.decode(want, skip_special_tokens=False)


def test_encode_decode_rows(spark):
    rnd, lib = random.Random(4), library()
    unsplit = "".join(rnd.choice("abcdefgh") for _ in range(3000))
    texts = [None, "", "Hello, it's  12 naïve\tcafé", unsplit, "word " * 900, "<|endoftext|>" * 100, "é" * 300, "a" * 65 + " "]
    rows = [(k, t, k, "z") for k, t in enumerate(texts)] + [(None, "again", 1, "z"), (2, texts[2], 2, "z")]
    df = spark.createDataFrame(rows, "doc_id bigint, text string, ids bigint, hash string")
    for piece in (64, 1 << 16):
        got = bpe.encode_decode(df, PATH, piece=piece).collect()
        assert len(got) == len(rows)
        want = sorted((str(i), lib.encode(t or "", add_special_tokens=False).ids) for i, t, *_ in rows)
        assert sorted((str(r["id"]), list(r["ids"])) for r in got) == want
        for r in got:
            assert r["n_tokens"] == len(r["ids"]) and r["shown"] == " ".join(map(str, r["ids"]))
            assert r["decoded"] == lib.decode(list(r["ids"]), skip_special_tokens=False)
    assert bpe.encode_decode(df.limit(0), PATH).count() == 0


def test_licenses(spark):
    mit = licenses.LICENSES["MIT"]
    changed = "MIT\n".join(["", "Copyright (c) 2024 Somebody\n\n" + mit.replace("sublicense", "sub-licence").upper().replace(",", " ;")])[4:]
    rows = [(1, mit, 0), (2, changed, 0), (3, mit + " and more", 0), (4, None, 0), (5, "Copyright 2020", 0), (None, "released under the *MIT* licence", 0), (1, mit, 0), (7, "x " * 50_000, 0)]
    df = spark.createDataFrame(rows, "doc_id bigint, text string, digest int")
    got = sorted((str(r["id"]), r["license_id"] or "") for r in licenses.scan(df).collect())
    assert got == sorted([("1", "MIT"), ("2", "MIT"), ("3", ""), ("4", ""), ("5", ""), ("None", "MIT-notice"), ("1", "MIT"), ("7", "")])
    empty = hashlib.sha256(b"").hexdigest()
    assert {r["digest"] for r in licenses.scan(df).collect() if r["id"] in (4, 5)} == {empty}
    assert licenses.scan(df.limit(0)).count() == 0
    own = spark.createDataFrame([("B", "some text"), ("A", "Some, text!"), ("C", None), (None, "k")], "license_id string, text string")
    docs = spark.createDataFrame([(1, "SOME text"), (2, "")], "doc_id int, text string")
    assert {r["id"]: r["license_id"] for r in licenses.scan(docs, own).collect()} == {1: "A", 2: None}
    assert {r["id"]: r["license_id"] for r in licenses.scan(docs, own.limit(0)).collect()} == {1: None, 2: None}
    plan = licenses.scan(df)._jdf.queryExecution().executedPlan().toString()
    assert "Python" not in plan and "Arrow" not in plan


HOLDERS = ("Copyright (c) 2024 Some Body", "Copyright 2019-2024, Some Body. All rights reserved.", "(c) 2024 Some Body", "© Some Body", "Copyright The Some Authors\nCopyright Other Authors", "# Copyright: Some Body\nAll rights reserved.", "Copyright (c) 2024 Some Body. All\nrights reserved.")


def test_wrapped_licenses(spark):
    names = [k for k in licenses.LICENSES if not k.endswith("-notice")]
    rows = []
    for name in names:
        paragraphs = licenses.LICENSES[name].split("\n\n")
        for width in (20, 33, 47, 60, 72, 80, 100, 120, 10**6):
            rows.append((name, "\n\n".join(textwrap.fill(" ".join(p.split()), width) for p in paragraphs)))
        rows.append((name, " ".join(licenses.LICENSES[name].split())))
        rows += [(name, f"{h}\n\n{licenses.LICENSES[name]}") for h in HOLDERS]
    for start in ("notice, this", "holder or", "holders and"):
        rows.append(("BSD-3-Clause", licenses.LICENSES["BSD-3-Clause"].lower().replace(f"copyright {start}", f"\ncopyright {start}")))
    rows.append((None, licenses.LICENSES["MIT"].replace("COPYRIGHT HOLDERS BE LIABLE", "COPYRIGHT HOLDERS BE FULLY LIABLE")))
    df = spark.createDataFrame([(k, n, t) for k, (n, t) in enumerate(rows)], "doc_id bigint, name string, text string")
    got = {r["id"]: r["license_id"] for r in licenses.scan(df).collect()}
    assert [(rows[k], got[k]) for k in got if got[k] != rows[k][0]] == []


def test_sql_has_the_same_rule(spark):
    """Over rows that tell a holder's line from a wrapped line of the terms."""
    import duckdb

    texts = [None, "", "Copyright", "copyright\ncopyright", "a\nCopyright Foo\nb", "a\n\nCopyright Foo\nCopyright Bar\n\nCopyright\tBaz", "x\n# \n# copyright: foo\n# b"]
    texts += ["a\ncopyright holders be liable", "\n\ncopyright  holders be", "copyright laws", "copyright lawsuit inc", "All rights\n reserved. x", "all rights reserved.\nAll rights reserved"]
    texts += ["Copyright (C) 1989, 1991 Free Software\nFoundation, Inc. <http://fsf.org/> rest", "copyright [yyyy] [name of copyright owner] z", "Copyright 2024 X. All\nrights reserved. Permission", "foo copyright (c) 2020 x"]
    texts += ["(c) 2020 x\n(c) copyright 2020 y\n(c) if this", "// Copyright by 2020 z\r\n// term\r\n", "copyright by\tyear", "copyright, {year} w", "é© z\n© z"]
    texts += [f"{h}\n\n{licenses.LICENSES['MIT']}" for h in HOLDERS] + [textwrap.fill(licenses.LICENSES["BSD-3-Clause"], w) for w in (25, 40, 61)]
    texts += [p.read_text(encoding="utf-8") for p in sorted(licenses.TEXTS.glob("*.txt"))[:4]]
    df = spark.createDataFrame(list(enumerate(texts)), "doc_id bigint, text string")
    got = {r["id"]: (r["digest"], r["license_id"]) for r in licenses.scan(df).collect()}
    con = duckdb.connect()
    con.register("documents", df.toArrow())
    want = {r[0]: (r[1], r[2]) for r in con.execute(licenses.sql()).fetchall()}
    assert {k: (texts[k], got[k], want[k]) for k in got if got[k] != want[k]} == {}
    assert got.keys() == want.keys() and sum(v[1] is not None for v in got.values()) >= 12


@pytest.mark.parametrize("unit", ["#", "*", ";", "/", "//", " ", "\t", "\n", "\r\n", "#\n", "copyright (c) 2020 ", "\ncopyright foo", "\n\ncopyright foo", "\n(c) 2020", "2020, ", "copyright ", "all rights reserved\n", "(c)"])
def test_licenses_in_long_lines(spark, unit):
    """A million signs in one line and 100,000 lines: no stack or time beyond what their length asks for."""
    many = unit * (1_000_000 // len(unit) if len(unit) < 3 else 100_000)
    mit = licenses.LICENSES["MIT"]
    rows = [(1, f"{many}\n\n{mit}"), (2, f"{mit}\n{many}"), (3, f"copyright {many}"), (4, f"copyright (c) {many}"), (5, f"\n#{many}copyright foo")]
    df = spark.createDataFrame(rows, "doc_id bigint, text string")
    got = {r["id"]: r["license_id"] for r in licenses.scan(df).collect()}
    assert len(got) == 5
    if not any(c.isalnum() for c in unit):
        assert got[1] == got[2] == "MIT"


def test_full_license_texts(spark):
    rows = []
    for path in sorted(licenses.TEXTS.glob("*.txt")):
        text = path.read_text(encoding="utf-8")
        paragraphs = text.split("\n\n")
        rows += [(path.stem, text), (path.stem, "Copyright (c) 2024 Some Body\n\n" + text), (path.stem, " ".join(text.split()))]
        rows += [(path.stem, "\n\n".join(textwrap.fill(" ".join(p.split()), width) for p in paragraphs)) for width in (45, 66, 72, 90, 10**6)]
        rows += [(None, text + " And more.")]
        if "END OF TERMS AND CONDITIONS" in text:
            rows += [(path.stem, text.split("END OF TERMS AND CONDITIONS")[0])]
    df = spark.createDataFrame([(k, n, t) for k, (n, t) in enumerate(rows)], "doc_id bigint, name string, text string")
    got = {r["id"]: r["license_id"] for r in licenses.scan(df).collect()}
    assert [(rows[k][0], k, rows[k][1][:60], got[k]) for k in got if got[k] != rows[k][0]] == []
    assert len(rows) > 100


QUESTION = "Alice bought 12 apples and gave 5 kg of them to Bob while the farmer kept 12 in the barn for his two sons and daughters"


def test_contamination(spark):
    filler = "some quite ordinary words that nobody asked about stand here before and after it "
    texts = {
        1: filler + QUESTION + " " + filler,
        2: filler * 3,
        3: QUESTION.replace("Alice", "Carol").replace("12", "31").replace("5 kg", "9 lb"),
        4: None,
        5: "",
        6: "one short item of words",
        7: (filler * 900) + QUESTION,
        8: "Dora bought 5 apples and gave 5 kg",
    }
    rows = [(k, t, 1, 2) for k, t in texts.items()] + [(None, QUESTION, 1, 2), (1, texts[1], 1, 2)]
    docs = spark.createDataFrame(rows, "doc_id bigint, text string, item_id int, id int")
    items = spark.createDataFrame(
        [(10, QUESTION, "x"), (11, "One short item of words", "x"), (12, None, "x"), (13, "", "x"), (14, QUESTION, "x"), (None, "12 13 14 15", "x")],
        "item_id bigint, text string, doc_id string",
    )
    for turn in (10, 1_000_000):
        got = contamination.contaminated(docs, items, turn=turn).collect()
        pairs = sorted((str(r["id"]), r["item_id"]) for r in got)
        want = [("1", 10), ("1", 14)] * 2 + [("3", 10), ("3", 14), ("6", 11), ("7", 10), ("7", 14), ("None", 10), ("None", 14)]
        assert pairs == sorted(want)
        assert all(r["share"] == 1 for r in got)
        assert all(r["exact"] == (r["id"] != 3) for r in got)
        kept = contamination.keep_clean(docs, items, turn=turn).collect()
        assert sorted(r["doc_id"] for r in kept) == [2, 4, 5, 8]
    assert contamination.contaminated(docs, items.limit(0)).count() == 0
    assert contamination.keep_clean(docs, items.limit(0)).count() == len(rows)
    assert contamination.contaminated(docs.limit(0), items).count() == 0


def test_slots_must_agree():
    read = contamination.Reader()
    text = "the first bin holds 12 red balls and the second bin holds 12 blue ones too"
    index = contamination.Index([(1, text)], 13, 7)
    assert index.search(read(text.replace("12", "40")))[0].exact is False
    one = text.replace("12", "40", 1)  # the same figure became two different ones
    assert not index.search(read(one)) or index.search(read(one))[0].share < 1


POOR = (
    "Alice gave Bob 3 apples, Carol gave Dan 5 pears and Eve gave Frank 7 plums",
    "Anna Lee has 12 red pens, Tom Ray has 15, Eva Orr has 18, Max Day has 21",
    "What Is The Name Of The First Large City On The Long River Nile",
    "Who Is Ada Lovelace",
    "12 13 14 15",
    " ".join(str(k) for k in range(40)),
)


@pytest.mark.parametrize("text", [*POOR, QUESTION])
@pytest.mark.parametrize("change", [str, str.lower, str.upper, str.title, str.swapcase])
def test_every_item_is_found_in_any_case(text, change):
    read = contamination.Reader()
    index = contamination.Index([(1, text)], 13, 7)
    for around in ("", " some other words 1 2 3 Here And there "):
        got = index.search(read(around + change(text) + around))
        assert [(f.item, f.share, f.exact) for f in got] == [(1, 1.0, True)]


def test_words_are_no_passages(spark):
    """Items of one or two tokens are found only in texts that are nothing else."""
    items = spark.createDataFrame([(1, "yes"), (2, "12"), (3, "Paris"), (4, "the answer"), (5, "well yes he")], "item_id bigint, text string")
    texts = ["well, yes he said there were 12 of them in Paris", "Yes.", "13", "the answer", "the answer is here", "yes yes"]
    docs = spark.createDataFrame(list(enumerate(texts)), "doc_id bigint, text string")
    got = {(r["id"], r["item_id"]) for r in contamination.contaminated(docs, items).collect()}
    assert {(0, 5), (1, 1), (3, 4)} <= got and {k for k, _ in got} <= {0, 1, 2, 3}
    assert {r["doc_id"] for r in contamination.keep_clean(docs, items).collect()} >= {4, 5}
    assert {k for k, i in ((r["id"], r["item_id"]) for r in contamination.contaminated(docs, items, least=1).collect()) if i == 1} == {0, 1, 5}


def test_changed_values_below_the_literal_floor():
    read = contamination.Reader()
    index = contamination.Index([(1, POOR[0])], 13, 7)
    assert index.search(read(POOR[0].replace("Alice", "Zoe").replace("3", "40")))[0].exact is False
    long = POOR[1] + " and each of them buys some more at the shop"
    index = contamination.Index([(1, long)], 13, 7)
    assert index.search(read(long.replace("Anna", "Olga").replace("12", "40")))
    assert not index.search(read("Olga Kim has 40 blue pens and nothing else that was ever asked about here"))
