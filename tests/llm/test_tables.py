"""WARC packages, chat views, shards, the quality classifier and the pipeline."""

import base64
import gzip
import hashlib
import json
import zipfile
import zlib

import numpy as np
import pytest
from pyspark.sql import functions as F

import corpus_pipeline
from cohortlens.llm import chat, quality, sharding, warc

SF = "/root/testdata/sf0.001"


def test_warc_round_trip(spark):
    big, other = "x" * 2000, "é" * 500
    rows = [(1, "u", big, 1), (5, "u", big, 1), (None, "u", big, 2), (5, None, big, 1), (7, "v", "small", 1), (8, "v", "small", 2), (9, None, None, 3)]
    rows += [(None, "q\r\nX: y", "z" * 1200, 1), (None, "q", "z" * 1200, 1), (11, "h", other, 1), (12, "h", other, 1), (13, "l", "long " * 300_000, 1)]
    df = spark.createDataFrame(rows, "page_id bigint, url string, html string, digest int")
    for package in (1, warc.PACKAGE):
        packages = warc.write_archives(df, warc.new_folder(spark), package=package)
        index = warc.read_index(packages)
        assert index.count() == len(rows)
        got = warc.read_records(index, span=500).collect()
        want = []
        for page, _, html, _ in rows:
            raw = (html or "").encode()
            same = [p for p, _, h, _ in rows if h == html]
            top = max((p for p in same if p is not None), default=None)
            revisit = len(raw) >= 1000 and len(same) > 1 and top is not None and page != top
            want.append((str(page), len(raw), hashlib.sha1(raw).hexdigest(), "revisit" if revisit else "response", str(top if revisit else None)))
        found = [(str(r["page_id"]), r["payload_bytes"], r["payload_digest"], r["record_type"], str(r["refers_to"])) for r in got]
        assert sorted(found) == sorted(want)
        assert all((r["payload"] is None) == (r["record_type"] == "revisit") for r in got)
    one = warc.read_records(index.where("page_id = 7")).collect()
    assert [bytes(r["payload"]) for r in one] == [b"small"]
    empty = warc.write_archives(df.limit(0), warc.new_folder(spark))
    assert warc.read_records(warc.read_index(empty)).count() == 0


def test_packages_are_zip_archives(spark, tmp_path):
    path = f"{tmp_path}/a.wacz"
    record = warc._record("response", 3, "http://a", b"hello", hashlib.sha1(b"hello").hexdigest(), None)
    assert warc.write_package(path, iter([(record, {"url": "http://a"})] * 3)) == 3
    with zipfile.ZipFile(path) as z:
        assert z.testzip() is None
        assert gzip.decompress(z.read("archive/data.warc.gz")) == record * 3
        assert len(z.read("indexes/index.cdxj").splitlines()) == 3
    wide = f"{tmp_path}/wide.zip"
    limit, zipfile.ZIP64_LIMIT, most = zipfile.ZIP64_LIMIT, 10, zipfile.ZIP_FILECOUNT_LIMIT
    try:
        zipfile.ZIP_FILECOUNT_LIMIT = 1
        with zipfile.ZipFile(wide, "w") as z:
            z.writestr("deflated", b"no" * 50, zipfile.ZIP_DEFLATED)
            z.writestr("stored", b"yes" * 50)
            z.comment = b"a comment"
    finally:
        zipfile.ZIP64_LIMIT, zipfile.ZIP_FILECOUNT_LIMIT = limit, most
    assert warc.END64 in open(wide, "rb").read()
    package = warc.Package(wide)
    assert list(package.members) == ["stored"] and package.read(*package.locate("stored")) == b"yes" * 50
    package.close()
    broken = f"{tmp_path}/broken"
    open(broken, "wb").write(b"nothing of the kind")
    with pytest.raises(ValueError):
        warc.Package(broken)
    with pytest.raises(ValueError):
        warc.parse_record(record.replace(b"hello", b"jello"))


def _foreign(lines, block):
    return "\r\n".join(["WARC/1.0", *lines, f"content-length: {len(block)}", "", ""]).encode() + block + b"\r\n\r\n"


def test_records_of_other_archives(spark, tmp_path):
    body = b"<p>hello</p>"
    http = b"HTTP/1.1 200 OK\r\nContent-Length: 12\r\n\r\n"
    sha256 = hashlib.sha256(body).hexdigest()
    sha1 = base64.b32encode(hashlib.sha1(body).digest()).decode()
    records = [
        (_foreign(["WARC-Type: warcinfo", "Content-Type: application/warc-fields"], b"software: x"), ("warcinfo", None, 11, hashlib.sha1(b"software: x").hexdigest())),
        (_foreign(["warc-type:response", "WARC-TARGET-URI: http://a", f"Warc-Payload-Digest: SHA1:{sha1.lower()}", "Content-Type: application/http; msgtype=response"], http + body), ("response", "http://a", 12, hashlib.sha1(body).hexdigest())),
        (_foreign(["WARC-Type: response", "WARC-Target-URI: http://b", f"WARC-Payload-Digest: sha-256:{sha256}"], http + body), ("response", "http://b", 12, sha256)),
        (_foreign(["WARC-Type: request", "WARC-Target-URI: http://a", "Content-Type: application/http"], b"GET / HTTP/1.1\r\n\r\n"), ("request", "http://a", 0, hashlib.sha1(b"").hexdigest())),
        (_foreign(["WARC-Type: metadata", "WARC-Payload-Digest: odd:ABC"], b"k: v"), ("metadata", None, 4, "abc")),
        (_foreign(["WARC-Type: revisit", "WARC-Target-URI: http://a"], b""), ("revisit", "http://a", None, None)),
    ]
    path = f"{tmp_path}/other.wacz"
    members, indexes = {"one.warc.gz": b"", "two.warc.gz": b""}, {"a.cdxj": [], "b.cdxj": []}
    for k, (data, _) in enumerate(records):
        name = "one.warc.gz" if k % 2 else "two.warc.gz"
        packed = gzip.compress(data)
        line = json.dumps({"offset": str(len(members[name])), "length": len(packed), "filename": name, "page": "x"})
        indexes["a.cdxj" if k < 3 else "b.cdxj"].append(f"com,a)/ 2020 {line}" if k % 3 else line)
        members[name] += packed
    with zipfile.ZipFile(path, "w") as z:
        for name, data in members.items():
            z.writestr(f"archive/{name}", data)
        for name, lines in indexes.items():
            z.writestr(f"indexes/{name}", "\n".join([*lines, ""]))
        z.writestr("archive/unused.warc.gz", b"\0" * 50)
        z.comment = b"see " + warc.END + b" and more " * 9
    index = warc.read_index(spark.createDataFrame([(path, 1)], "path string, records bigint"))
    got = {(r["record_type"], r["url"], r["payload_bytes"], r["payload_digest"]) for r in warc.read_records(index).collect()}
    assert got == {want for _, want in records}
    with pytest.raises(ValueError, match="digest"):
        warc.parse_record(records[2][0].replace(b"hello", b"jello"))


def test_ranges_are_read_in_many_tasks(spark):
    df = spark.range(0, 400).selectExpr("id AS page_id", "'u' AS url", "repeat(md5(string(id)), 40) AS html")
    index = warc.read_index(warc.write_archives(df, warc.new_folder(spark)))
    records = warc.read_records(index, ("page_id", "payload_bytes"), span=2000)
    tasks = {r["p"] for r in records.select(F.spark_partition_id().alias("p")).collect()}
    assert len(tasks) > 10 and records.count() == 400


def test_perspectives(spark):
    rows = [
        (1, 0, "system", "be kind", 0), (1, 1, "ann", "hi", 0), (1, 2, "bob", None, 0), (1, 3, None, "?", 0), (1, 4, " ", "!", 0), (1, 4, " ", "!", 0),
        (2, 0, "system", "alone", 0), (None, None, "ann", "who", 0), (None, 1, "cy", "me", 0), (3, 1, "ann", "x" * 100_000, 0),
    ]
    df = spark.createDataFrame(rows, "conv_id bigint, turn bigint, role string, text string, perspective int")
    got = [r.asDict() for r in chat.rotate(df).collect()]
    views = {}
    for r in sorted(got, key=lambda r: r["seq"]):
        views.setdefault((r["conv_id"], r["perspective"]), []).append(r)
    assert set(views) == {(1, "ann"), (1, "bob"), (1, "unknown"), (None, "ann"), (None, "cy"), (3, "ann")}
    for (_, view), turns in views.items():
        text = "".join(t["rendered"] for t in turns)
        assert [t["seq"] for t in turns] == list(range(len(turns)))
        for t in turns:
            assert text[t["start"] : t["stop"]] == t["rendered"]
            assert t["loss"] == (t["role"] == "assistant") == (t["speaker"] == view)
            if t["loss"]:
                assert text[t["loss_start"] : t["loss_stop"]].endswith("<|end|>\n") and not text[t["loss_start"] :].startswith("<|assistant")
    ann = "".join(t["rendered"] for t in views[1, "ann"])
    assert ann.startswith("<|system|>\nbe kind<|end|>\n<|assistant|>\nhi<|end|>\n<|user name=bob|>\n<|end|>\n<|user name=unknown|>\n?")
    assert ann.count("!") == 2
    assert chat.rotate(df.limit(0)).count() == 0


def test_shards(spark):
    rows = [(k, f"text {k}", "s") for k in range(300)] + [(1000 + k, "the same", "s") for k in range(200)]
    rows += [(2000 + k, f"pair {k // 2}", "s") for k in range(100)] + [(None, None, "s"), (None, "", "s"), (5, "text 5", "s")]
    df = spark.createDataFrame(rows, "doc_id bigint, text string, shard string")
    got = sharding.assign(df, shards=8).collect()
    assert len(got) == len(rows)
    by = {}
    for r in got:
        by.setdefault(r["shard"], []).append(r["slot"])
    assert max(map(len, by.values())) - min(map(len, by.values())) <= 1 and set(by) == set(range(8))
    assert all(sorted(s) == list(range(len(s))) for s in by.values())
    place = {r["id"]: r["shard"] for r in got}
    split = sum(place[2000 + k] != place[2001 + k] for k in range(0, 100, 2))
    assert split <= 5
    assert len({place[1000 + k] for k in range(200)}) <= 5  # more than two shards' worth
    assert all(r["size"] == len((t or "").encode()) + 1 for r in got for i, t, _ in rows if i is not None and i == r["id"])
    assert {r["text_crc32"] for r in got if r["id"] is None} == {0}
    assert {r["text_crc32"] for r in got if r["id"] == 1000} == {zlib.crc32(b"the same")}
    few = sharding.assign(df.limit(3), shards=8).collect()
    assert sorted((r["shard"], r["slot"]) for r in few) == [(0, 0), (1, 0), (2, 0)]
    assert sharding.assign(df.limit(0), shards=8).count() == 0


def test_quotas():
    wishes = {(0, 1): 10, (1, 0): 4, (2, 1): 6}
    got = sharding._quotas(wishes, [0, 6, 5])
    assert got == {(0, 1): 4 + 3, (1, 0): 4, (2, 1): 3}


def test_prior_and_risk():
    rng = np.random.default_rng(1)
    good, bad = rng.normal(1.5, 1, (6000, 4)), rng.normal(-1.5, 1, (6000, 4))
    unlabelled = np.concatenate([good[3000:5100], bad[:900]])
    model = quality.fit(good[:3000].astype(np.float32), unlabelled.astype(np.float32))
    assert abs(model.prior - 0.7) < 0.08
    assert (model.score(good[5100:]) > 0.5).mean() > 0.95 and (model.score(bad[900:]) < 0.5).mean() > 0.95


def test_quality_held_out(spark):
    docs, labels = (spark.read.parquet(f"/root/testdata/sf0.01/{t}.parquet") for t in ("documents", "labels"))
    model = quality.train(docs, labels)
    rows = quality.score(docs, model).join(labels.withColumnRenamed("doc_id", "id"), "id").where("held_out").collect()
    assert len(rows) > 40
    good = [r["score"] for r in rows if r["quality"] == 1]
    bad = [r["score"] for r in rows if r["quality"] == 0]
    assert np.mean([g > b for g in good for b in bad]) > 0.97
    assert np.mean([(r["score"] >= 0.3) == (r["quality"] == 1) for r in rows]) > 0.95
    again = quality.train(docs.repartition(5), labels)
    assert np.allclose(model.weights, again.weights)


def test_quality_odd_rows(spark):
    rows = [(1, None, 0.0), (None, "text", 0.0), (2, "", 0.0), (2, "", 0.0), (3, "w " * 100_000, 0.0)]
    docs = spark.createDataFrame(rows, "doc_id bigint, text string, score double")
    labels = spark.createDataFrame([(1, 1), (2, None), (None, 1), (1, 0)], "doc_id bigint, quality int")
    assert quality.train(docs, labels) is None
    got = quality.score(docs, None).collect()
    assert len(got) == 5 and {r["score"] for r in got} == {quality.NO_MODEL}
    held = {r["id"]: r["held_out"] for r in got}
    assert held == {i: zlib.crc32(str(i).encode()) % 5 == 0 for i in (1, 2, 3)} | {None: False}
    ones = spark.createDataFrame([(k, 1) for k in range(4)], "doc_id bigint, quality int")
    model = quality.train(docs, ones)
    got = quality.score(docs, model).collect()
    assert all(0 <= r["score"] <= 1 for r in got)
    assert quality.score(docs.limit(0), model).count() == 0
    assert quality.keep_good(docs.limit(0), model).count() == 0


def test_pipeline_stages(spark):
    from cohortlens.llm import contamination, simhash
    from tests.llm.test_texts import PATH, library, plain_removal

    docs = spark.read.parquet(f"{SF}/documents.parquet")
    steps = [docs]
    for name, stage in corpus_pipeline.STAGES:
        out = stage(spark, steps[-1], SF)
        steps.append(spark.createDataFrame(out.toArrow(), out.schema))
    tables = [{r["doc_id"]: r for r in s.collect()} for s in steps]
    assert [s.columns for s in steps[:-1]] == [docs.columns] * 5
    prints = {k: simhash.fingerprint(r["text"]) for k, r in tables[1].items()}
    ids = sorted(prints)
    near = {}
    for k, a in enumerate(ids):
        near[a] = min([near[b] for b in ids[:k] if (prints[a] ^ prints[b]).bit_count() <= 4], default=a)
    for a in ids:  # follow chains to their ends
        while near[near[a]] != near[a]:
            near[a] = near[near[a]]
    assert set(tables[2]) <= {near[a] for a in ids}
    ids = sorted(tables[2])
    for i, (kept, _) in zip(ids, plain_removal([tables[2][k]["text"] for k in ids], 100), strict=True):
        text = tables[3][i]["text"] if i in tables[3] else ""
        assert kept.decode(errors="ignore") == text or len(text.encode()) - len(kept) <= 8
    items = spark.read.parquet(f"{SF}/benchmark.parquet").collect()
    index = contamination.Index([(r["item_id"], r["text"]) for r in items], contamination.WINDOW, contamination.LITERAL)
    read = contamination.Reader()
    assert set(tables[4]) == {k for k, r in tables[3].items() if not index.search(read(r["text"]))}
    lib = library()
    for k, r in tables[5].items():
        assert list(r["ids"]) == lib.encode(tables[4][k]["text"], add_special_tokens=False).ids
    assert len(tables[5]) == len(tables[4]) and PATH


def test_pipeline_of_nothing(spark):
    docs = spark.read.parquet(f"{SF}/documents.parquet").limit(0)
    for _, stage in corpus_pipeline.STAGES:
        docs = stage(spark, docs, SF)
    assert docs.count() == 0


def test_pipeline_rejects_low_quality(spark):
    docs = spark.read.parquet(f"{SF}/documents.parquet")
    kept = {r["doc_id"] for r in corpus_pipeline.keep_quality(spark, docs, SF).select("doc_id").collect()}
    bad = {r["doc_id"] for r in spark.read.parquet(f"{SF}/labels.parquet").where("quality = 0").collect()}
    gone = {r["doc_id"] for r in docs.select("doc_id").collect()} - kept
    assert len(bad & gone) >= 0.9 * len(bad)
