"""WARC records in ZIP packages: written, indexed and read by range without extraction.

A package is a ZIP archive with two stored members: ``archive/data.warc.gz``, in which every record is a
gzip stream of its own, and ``indexes/index.cdxj``, one line for each record with its place in the first.
"""

from __future__ import annotations

import base64
import gzip
import hashlib
import json
import math
import re
import struct
import uuid
import zipfile
from collections.abc import Iterator

import pyarrow as pa
from pyarrow import fs
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from cohortlens.functions.bounded import lookup
from cohortlens.llm.common import only, slices
from cohortlens.session import pin, scratch_path

#: Compressed bytes of records in a package.
PACKAGE = 256 << 20
#: Bytes that one read fetches; neighbouring records are read together.
RANGE = 4 << 20
#: Most partitions in which ranges are read.
MOST_PARTS = 20_000
#: Payloads of fewer bytes are never replaced by a reference.
LEAST_SHARED = 1000

# The revisit profile of the WARC 1.1 format and the signatures of the ZIP format.
PROFILE = "http://netpreserve.org/warc/1.1/revisit/identical-payload-digest"
END, END64, LOCATOR64, CENTRAL, LOCAL = b"PK\5\6", b"PK\6\6", b"PK\6\7", b"PK\1\2", b"PK\3\4"
DATE = "2020-01-01T00:00:00Z"


def _record(kind: str, page: int | None, url: str | None, payload: bytes, digest: str, refers: int | None) -> bytes:
    """A WARC record; a revisit has the HTTP headers of the full payload and no payload."""
    url = (url or "").replace("\r", "%0D").replace("\n", "%0A")
    http = f"HTTP/1.1 200 OK\r\nContent-Type: text/html; charset=utf-8\r\nContent-Length: {len(payload)}\r\n\r\n".encode()
    block = http + (payload if kind == "response" else b"")
    sha = base64.b32encode(bytes.fromhex(digest)).decode()
    lines = [
        "WARC/1.1",
        f"WARC-Type: {kind}",
        f"WARC-Record-ID: <urn:page:{'' if page is None else page}>",
        f"WARC-Date: {DATE}",
        f"WARC-Target-URI: {url}",
        f"WARC-Payload-Digest: sha1:{sha}",
        "Content-Type: application/http; msgtype=response",
    ]
    if kind == "revisit":
        lines += [f"WARC-Profile: {PROFILE}", f"WARC-Refers-To: <urn:page:{refers}>"]
    head = "\r\n".join([*lines, f"Content-Length: {len(block)}"])
    return head.encode("utf-8", "surrogatepass") + b"\r\n\r\n" + block + b"\r\n\r\n"


def _digest(value: str | None, payload: bytes) -> tuple[str | None, bool]:
    """A digest header (``algorithm:value``, base32 or hex) in hex, and whether the payload has it (or cannot be checked)."""
    name, _, text = (value or "").strip().partition(":")
    try:
        own = hashlib.new(name.replace("-", "").lower(), payload).digest()
    except (ValueError, TypeError):  # no digest, or one of an unknown kind
        return (text.lower() or None), True
    if len(text) == 2 * len(own):
        given = bytes.fromhex(text)
    else:
        given = base64.b32decode(text.upper() + "=" * (-len(text) % 8))
    return given.hex(), given == own


def parse_record(data: bytes) -> dict:
    """Page, url, kind, reference, payload and its size and digest of a WARC record of any type.

    Names of headers are matched without case. The payload is what follows the HTTP headers, in a record without them
    the whole block; a revisit has none, and its size is that of its HTTP headers, if they tell it. A digest of another
    kind than SHA-1 is returned as it is; without one, that of the payload is computed. What a record does not say is null.
    """
    head, _, rest = data.partition(b"\r\n\r\n")
    pairs = (x.partition(":") for x in head.decode("utf-8", "surrogatepass").split("\r\n")[1:])
    fields = {name.strip().lower(): value.strip(" \t") for name, _, value in pairs}
    block = rest[: int(fields["content-length"])]
    http, payload = b"", block
    if "application/http" in fields.get("content-type", "").lower() or block.startswith(b"HTTP/"):
        http, _, payload = block.partition(b"\r\n\r\n")
    page = lambda name: int(m[1]) if (m := re.search(r"<urn:page:(-?\d+)>", fields.get(name, ""))) else None
    kind = fields.get("warc-type")
    whole = kind != "revisit"
    digest, right = _digest(fields.get("warc-payload-digest"), payload)
    if kind in ("response", "resource") and not right:
        raise ValueError(f"payload of {fields.get('warc-record-id')} does not have its digest")
    told = re.search(rb"(?i)content-length: *(\d+)", http)
    return {
        "page_id": page("warc-record-id"),
        "url": fields.get("warc-target-uri"),
        "record_type": kind,
        "refers_to": page("warc-refers-to"),
        "payload_bytes": len(payload) if whole else int(told[1]) if told else None,
        "payload_digest": digest or (hashlib.sha1(payload).hexdigest() if whole else None),
        "payload": payload if whole else None,
    }


class Package:
    """Stored members of a ZIP archive, found through its central directory and read by range."""

    def __init__(self, path: str):
        system, name = fs.FileSystem.from_uri(path)
        self.file = system.open_input_file(name)
        self.size = self.file.size()
        self.members = dict(self._directory())

    def _at(self, offset: int, size: int) -> bytes:
        got = self.file.read_at(size, offset)
        if len(got) != size:
            raise ValueError("the archive ends too early")
        return got

    def _directory(self) -> Iterator[tuple[str, tuple[int, int]]]:
        """(name, (local header, size)) of the stored members."""
        base = max(0, self.size - (1 << 16) - 22)
        tail = self._at(base, self.size - base)
        # The comment at the end may hold the signature: the right one is followed by just that comment.
        end = tail.rfind(END)
        while end >= 0 and len(tail) - end >= 22 and struct.unpack("<H", tail[end + 20 : end + 22])[0] != len(tail) - end - 22:
            end = tail.rfind(END, 0, end)
        if end < 0 or len(tail) - end < 22:
            raise ValueError("no ZIP archive")
        count, size, offset = struct.unpack("<HII", tail[end + 10 : end + 20])
        if count == 0xFFFF or size == 0xFFFFFFFF or offset == 0xFFFFFFFF:
            locator = self._at(base + end - 20, 20)
            if locator[:4] != LOCATOR64:
                raise ValueError("no ZIP64 locator")
            record = self._at(struct.unpack("<Q", locator[8:16])[0], 56)
            if record[:4] != END64:
                raise ValueError("no ZIP64 directory")
            count, size, offset = struct.unpack("<QQQ", record[32:56])
        directory, at = self._at(offset, size), 0
        for _ in range(count):
            if directory[at : at + 4] != CENTRAL:
                raise ValueError("broken ZIP directory")
            flags, method = struct.unpack("<HH", directory[at + 8 : at + 12])
            packed, full, n_name, n_extra, n_comment = struct.unpack("<IIHHH", directory[at + 20 : at + 34])
            header = struct.unpack("<I", directory[at + 42 : at + 46])[0]
            name = directory[at + 46 : at + 46 + n_name].decode("utf-8" if flags & 0x800 else "cp437")
            extra = directory[at + 46 + n_name : at + 46 + n_name + n_extra]
            while len(extra) >= 4:
                kind, length = struct.unpack("<HH", extra[:4])
                if kind == 1:  # ZIP64: only the fields that did not fit, in this order
                    wide, place = extra[4 : 4 + length], 0
                    values = []
                    for short in (full, packed, header):
                        if short == 0xFFFFFFFF:
                            values.append(struct.unpack("<Q", wide[place : place + 8])[0])
                            place += 8
                        else:
                            values.append(short)
                    full, packed, header = values
                extra = extra[4 + length :]
            if method == 0:
                yield name, (header, full)
            at += 46 + n_name + n_extra + n_comment

    def locate(self, name: str) -> tuple[int, int]:
        """Offset and size of a stored member's bytes in the archive."""
        header, size = self.members[name]
        local = self._at(header, 30)
        if local[:4] != LOCAL:
            raise ValueError("broken ZIP member")
        n_name, n_extra = struct.unpack("<HH", local[26:30])
        return header + 30 + n_name + n_extra, size

    def read(self, offset: int, size: int) -> bytes:
        return self._at(offset, size)

    def close(self) -> None:
        self.file.close()


def write_package(path: str, records: Iterator[tuple[bytes, dict]], most: int = PACKAGE) -> int:
    """Writes records with their index fields until ``most`` bytes are reached; returns how many."""
    system, name = fs.FileSystem.from_uri(path)
    lines: list[str] = []
    at = 0
    with system.open_output_stream(name) as out, zipfile.ZipFile(out, "w", zipfile.ZIP_STORED) as package:
        with package.open("archive/data.warc.gz", "w", force_zip64=True) as member:
            for data, fields in records:
                packed = gzip.compress(data, 1, mtime=0)
                member.write(packed)
                lines.append(json.dumps(fields | {"offset": str(at), "length": str(len(packed)), "filename": "data.warc.gz"}))
                at += len(packed)
                if at >= most:
                    break
        package.writestr("indexes/index.cdxj", "".join(f"{x}\n" for x in lines))
    return len(lines)


def write_archives(
    pages: DataFrame,
    folder: str,
    id_col: str = "page_id",
    url_col: str = "url",
    html_col: str = "html",
    least_shared: int = LEAST_SHARED,
    package: int = PACKAGE,
) -> DataFrame:
    """Writes a record for every row of ``pages`` and returns (path, records) of the packages.

    Of rows whose payloads of at least ``least_shared`` bytes are equal, those with the largest id are
    responses and the others refer to it; a null id counts as smaller than all ids, and rows of a payload with null ids
    only are all responses. Other rows are responses. A null html is an empty payload, a null url an empty one.
    Every attempt of a task writes packages under names of its own and only those of the attempt that counts
    are returned, so a lost executor leaves no half or double package behind in the result.
    """
    spark = pages.sparkSession
    rows = only(pages, id=id_col, url=url_col, html=html_col).select(
        F.col("id").cast("bigint").alias("id"), "url", F.encode(F.coalesce("html", F.lit("")), "utf-8").alias("payload")
    )
    rows = rows.withColumn("digest", F.sha1("payload"))
    large = rows.where(F.octet_length("payload") >= least_shared)
    shared = large.groupBy("digest").agg(F.max("id").alias("first"), F.count("*").alias("n")).where("n > 1").select("digest", "first")
    marked = rows.join(lookup(shared), "digest", "left")
    refers = F.when((F.octet_length("payload") >= least_shared) & ~F.col("id").eqNullSafe(F.col("first")), F.col("first"))
    marked = marked.select("id", "url", "payload", "digest", refers.alias("refers"))
    system, root = fs.FileSystem.from_uri(folder)
    system.create_dir(root, recursive=True)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        def records() -> Iterator[tuple[bytes, dict]]:
            for b in slices(batches, "payload"):
                for page, url, payload, digest, to in zip(*(c.to_pylist() for c in b.columns), strict=True):
                    kind = "response" if to is None else "revisit"
                    yield _record(kind, page, url, payload, digest, to), {"url": url or "", "page": page, "type": kind, "digest": f"sha1:{digest}"}

        def after(first, rest):
            yield first
            yield from rest

        rest = records()
        while (first := next(rest, None)) is not None:
            path = f"{folder}/{uuid.uuid4().hex}.wacz"
            n = write_package(path, after(first, rest), package)
            yield pa.record_batch([pa.array([path]), pa.array([n])], names=["path", "records"])

    return pin(marked.mapInArrow(run, "path string, records bigint"))


def read_index(packages: DataFrame) -> DataFrame:
    """(path, offset, size, url, page_id, record_type, digest) of all records of the packages in ``path``.

    Only the directories and the index members of the archives are read. ``offset`` counts from the start of the
    package, so a record can be fetched by it alone. A package may hold several WARC members and several indexes
    (``indexes/*.cdxj``); a line of an index, whose JSON may follow a key and a time, names its member as ``filename``. What a
    line does not tell is null; a line whose member is missing or not stored is an error.
    """

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for path in (p for b in batches for p in b.column("path").to_pylist()):
            package = Package(path)
            for index in sorted(n for n in package.members if n.startswith("indexes/") and n.endswith(".cdxj")):
                lines = [x for x in package.read(*package.locate(index)).splitlines() if b"{" in x]
                bases: dict[str, int] = {}
                for k in range(0, len(lines), 10_000):
                    x = [json.loads(line[line.index(b"{") :]) for line in lines[k : k + 10_000]]
                    for name in {r.get("filename", "data.warc.gz") for r in x} - bases.keys():
                        member = name if name in package.members else f"archive/{name}"
                        if member not in package.members:
                            raise ValueError(f"{path} has no stored member {name}")
                        bases[name] = package.locate(member)[0]
                    yield pa.record_batch(
                        [
                            pa.array([path] * len(x)),
                            pa.array([bases[r.get("filename", "data.warc.gz")] + int(r["offset"]) for r in x]),
                            pa.array([int(r["length"]) for r in x]),
                            pa.array([r.get("url") for r in x], pa.string()),
                            pa.array([r.get("page") if isinstance(r.get("page"), int) else None for r in x], pa.int64()),
                            pa.array([r.get("type") for r in x], pa.string()),
                            pa.array([(r.get("digest") or "").removeprefix("sha1:") or None for r in x], pa.string()),
                        ],
                        names=["path", "offset", "size", "url", "page_id", "record_type", "digest"],
                    )
            package.close()

    schema = "path string, offset bigint, size bigint, url string, page_id bigint, record_type string, digest string"
    return packages.select("path").repartition(max(1, min(packages.count(), 4096))).mapInArrow(run, schema)


#: Columns of records that read_records can return.
FIELDS = {
    "page_id": "bigint",
    "url": "string",
    "record_type": "string",
    "refers_to": "bigint",
    "payload_bytes": "bigint",
    "payload_digest": "string",
    "payload": "binary",
}


def read_records(index: DataFrame, fields: tuple[str, ...] = tuple(FIELDS), span: int = RANGE) -> DataFrame:
    """The records that ``index`` (path, offset, size) names, each read by its range of the package.

    Ranges are dealt out by package and part of it, sorted, and neighbours are fetched together. A response
    whose payload does not have the digest of its header is an error. A revisit has no payload.
    """
    types = {"bigint": pa.int64(), "string": pa.string(), "binary": pa.binary()}

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        package, path = None, None
        for b in batches:
            paths, offsets, sizes = (b.column(c).to_pylist() for c in ("path", "offset", "size"))
            k = 0
            while k < len(paths):
                end = k + 1
                while end < len(paths) and paths[end] == paths[k] and offsets[end] == offsets[end - 1] + sizes[end - 1] and offsets[end] - offsets[k] < span:
                    end += 1
                if paths[k] != path:
                    if package:
                        package.close()
                    package, path = Package(paths[k]), paths[k]
                data = package.read(offsets[k], offsets[end - 1] + sizes[end - 1] - offsets[k])
                found = [parse_record(gzip.decompress(data[offsets[i] - offsets[k] :][: sizes[i]])) for i in range(k, end)]
                yield pa.record_batch([pa.array([r[f] for r in found], types[FIELDS[f]]) for f in fields], names=list(fields))
                k = end
        if package:
            package.close()

    places = pin(index.select("path", "offset", "size"))
    total = places.agg(F.sum("size")).first()[0] or 0
    # The rows are small, the ranges they stand for are not: partitions by the bytes to read.
    parts = max(1, min(math.ceil(total / span), MOST_PARTS))
    part = F.floor(F.col("offset") / span).alias("part")
    dealt = places.select("path", "offset", "size", part).repartition(parts, "path", "part").sortWithinPartitions("path", "offset")
    return dealt.select("path", "offset", "size").mapInArrow(run, ", ".join(f"{f} {FIELDS[f]}" for f in fields))


def new_folder(spark: SparkSession) -> str:
    """A folder for packages that driver and executors share."""
    return scratch_path(spark, "warc")
