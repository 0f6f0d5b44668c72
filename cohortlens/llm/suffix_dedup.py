"""Removal of repeated byte strings by a column-wise multi-document suffix structure.

A document is cut into runs: consecutive starts of ``length``-byte strings that share an anchor, the
half-length substring with the smallest hash in each of them. Equal strings have equal anchors at equal
places, so strings that occur twice lie in runs whose anchors occur twice, and all runs of one anchor go to
one bin. A bin's distinct runs are the documents of a collection whose Burrows-Wheeler transform and common
prefixes are built column by column: each round inserts one symbol of every document. Neighbours with a
common prefix of ``length`` bytes are the same string; all of its occurrences but the first are removed.
"""

from __future__ import annotations

import math
import os
import tempfile
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
import xxhash
import zstandard
from pyspark import TaskContext
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql.pandas.types import to_arrow_schema

from cohortlens.llm.common import sorted_groups
from cohortlens.session import pin

#: Bytes of text in a block, the unit that is packed, joined and answered.
BLOCK = 4 << 20
#: String starts hashed together.
CHUNK = 1 << 19
#: Anchors that are counted together.
BUCKET = 1 << 20
#: Bytes of runs in a bin, which a task holds, and parts of it whose collections are built one after the other.
BIN, PARTS = 10 << 20, 16
#: Distinct runs of one anchor beyond which its strings are dealt out one by one.
HOT = 20_000
#: Most bytes of a symbol: the columns of a string are its symbols, and every round goes over all columns so far.
SYMBOL = 20

_BASE = np.uint64(0x9E3779B97F4A7C15)
_UNBASE = np.uint64(pow(0x9E3779B97F4A7C15, -1, 1 << 64))
_BYTES = np.random.default_rng(7).integers(0, 1 << 63, 256, dtype=np.uint64) * np.uint64(2) + np.uint64(1)
_PLACE = np.uint64((1 << 24) - 1)


def _mix(x: np.ndarray) -> np.ndarray:
    x = (x ^ (x >> np.uint64(30))) * np.uint64(0xBF58476D1CE4E5B9)
    x = (x ^ (x >> np.uint64(27))) * np.uint64(0x94D049BB133111EB)
    return x ^ (x >> np.uint64(31))


class Runs:
    """Runs of a block: first and last start, anchor hash and hash of the run's bytes."""

    def __init__(self, text: np.ndarray, sizes: np.ndarray, length: int):
        self.text, self.length = text, length
        self.anchor_size = max(1, length // 2)
        ends = np.cumsum(sizes)
        room = np.zeros(len(text) + 1, np.int8)
        np.add.at(room, ends - sizes, (sizes >= length).astype(np.int8))
        np.add.at(room, np.maximum(ends - sizes, ends - length + 1), -(sizes >= length).astype(np.int8))
        valid = np.cumsum(room[:-1], dtype=np.int8) > 0
        parts = [self._chunk(valid, s) for s in range(0, len(text), CHUNK)]
        self.first, self.last, self.anchor, self.key = (
            np.concatenate([p[k] for p in parts] or [np.empty(0, t)])
            for k, t in enumerate((np.int64, np.int64, np.uint64, np.uint64))
        )

    def _chunk(self, valid: np.ndarray, base: int):
        length, size = self.length, self.anchor_size
        text = self.text[base : base + CHUNK + length - 1]
        n = len(text) - length + 1
        if n <= 0 or not valid[base : base + n].any():
            return tuple(np.empty(0, t) for t in (np.int64, np.int64, np.uint64, np.uint64))
        power = np.multiply.accumulate(np.full(len(text) + 1, _BASE, np.uint64))
        unpower = np.multiply.accumulate(np.full(len(text), _UNBASE, np.uint64))
        prefix = np.concatenate(([np.uint64(0)], np.cumsum(_BYTES[text] * unpower, dtype=np.uint64)))
        grams = _mix((prefix[size:] - prefix[:-size]) * power[: len(text) - size + 1])
        low = (grams & ~_PLACE) | np.arange(len(grams), dtype=np.uint64)
        width, span = 1, length - size + 1
        while width * 2 <= span:
            low = np.minimum(low[:-width], low[width:])
            width *= 2
        if width < span:
            low = np.minimum(low[: len(low) - (span - width)], low[span - width :])
        place = (low & _PLACE).astype(np.int64)
        ok = valid[base : base + n]
        starts = ok.copy()
        starts[1:] &= (place[1:] != place[:-1]) | ~ok[:-1]
        ends = ok.copy()
        ends[:-1] &= (place[1:] != place[:-1]) | ~ok[1:]
        first, last = np.flatnonzero(starts), np.flatnonzero(ends)
        key = _mix((prefix[last + length] - prefix[first]) * power[first]) ^ (last - first).astype(np.uint64)
        return first + base, last + base, _mix(grams[place[first]] + np.uint64(1)), key

    def window_keys(self, starts: np.ndarray) -> np.ndarray:
        """A hash of the string at each start."""
        view = np.lib.stride_tricks.sliding_window_view(self.text, self.length)[starts]
        return np.array([xxhash.xxh64_intdigest(v.tobytes()) for v in view], np.uint64)


class Records:
    """The runs of a block that may hold repeated strings, each kept once, and where they occur.

    Anchors that have very many distinct runs give their strings one by one. ``first`` and ``size`` are the
    earliest place and the number of strings of a record; ``of`` maps every occurrence (``at``,
    ``count``) to its record; records are ordered by bin and part of it.
    """

    def __init__(self, runs: Runs, repeated: np.ndarray, hot: np.ndarray, bins: int):
        inverse = np.unique(runs.anchor, return_inverse=True)[1]
        wanted, single = repeated[inverse], hot[inverse]
        plain = np.flatnonzero(wanted & ~single)
        at, count, route = runs.first[plain], runs.last[plain] - runs.first[plain] + 1, runs.anchor[plain]
        spread = np.flatnonzero(wanted & single)
        if len(spread):
            alone = np.concatenate([np.arange(runs.first[k], runs.last[k] + 1) for k in spread])
            at = np.concatenate([at, alone])
            count = np.concatenate([count, np.ones(len(alone), np.int64)])
            route = np.concatenate([route, runs.window_keys(alone)])
            order = np.argsort(at, kind="stable")
            at, count, route = at[order], count[order], route[order]
        raw, more = runs.text.tobytes(), runs.length - 1
        known: dict[bytes, int] = {}
        of = np.fromiter(
            (known.setdefault(raw[a : a + c + more], len(known)) for a, c in zip(at.tolist(), count.tolist(), strict=True)),
            np.int64,
            len(at),
        )
        index = np.unique(of, return_index=True)[1]
        route = _mix(route[index])
        bin_ = (route % np.uint64(bins)).astype(np.int64)
        part = ((route >> np.uint64(40)) % np.uint64(PARTS)).astype(np.uint8)
        order = np.lexsort((part, bin_))
        place = np.empty(len(order), np.int64)
        place[order] = np.arange(len(order))
        self.at, self.count, self.of = at, count, place[of]
        self.first, self.size, self.bin, self.part = at[index][order], count[index][order], bin_[order], part[order]
        self.is_first = np.zeros(len(at), bool)
        self.is_first[index] = True


def _pack(*arrays: np.ndarray) -> bytes:
    return zstandard.compress(b"".join(np.int64(a.nbytes).tobytes() + a.tobytes() for a in arrays), 1)


def _unpack(data: bytes, *types) -> list[np.ndarray]:
    raw, out, at = zstandard.decompress(data), [], 0
    for t in types:
        size = int(np.frombuffer(raw, np.int64, 1, at)[0])
        out.append(np.frombuffer(raw, t, size // np.dtype(t).itemsize, at + 8))
        at += 8 + size
    return out


class RangeMin:
    """Minima of ranges of small numbers, from minima of ranges whose sizes are powers of two."""

    def __init__(self, values: np.ndarray):
        self.levels = [values]
        while 2 * (1 << (len(self.levels) - 1)) <= len(values):
            last, half = self.levels[-1], 1 << (len(self.levels) - 1)
            self.levels.append(np.minimum(last[:-half], last[half:]))

    def __call__(self, low: np.ndarray, high: np.ndarray) -> np.ndarray:
        """Minimum of values[low..high], both ends included."""
        level = np.frexp((high - low + 1).astype(np.float64))[1] - 1
        out = np.empty(len(low), self.levels[0].dtype)
        for k in np.unique(level):
            at = np.flatnonzero(level == k)
            out[at] = np.minimum(self.levels[k][low[at]], self.levels[k][high[at] - (1 << int(k)) + 1])
        return out


def _order(symbols: np.ndarray) -> np.ndarray:
    """Stable order of symbols from -1 upwards, by radix passes of 16 bits."""
    s = (symbols + 1).astype(np.uint32)
    order = np.argsort((s & np.uint32(0xFFFF)).astype(np.uint16), kind="stable")
    high = (s >> np.uint32(16)).astype(np.uint16)
    return order[np.argsort(high[order], kind="stable")] if high.any() else order


class Columns:
    """Burrows-Wheeler transform and common prefixes of a collection, grown one symbol per document and round.

    Between rounds both lie in two files of a folder of the task, which each round reads from start to
    end and writes anew. ``docs[i]`` are the symbols of document i; ends of documents differ from each other
    and come before all symbols.
    """

    def __init__(self, symbols: np.ndarray, sizes: np.ndarray, folder: str):
        self.symbols, self.sizes, self.folder = symbols, sizes, folder
        self.ends = np.cumsum(sizes)
        m = len(sizes)
        self._write(np.where(sizes > 0, symbols[np.maximum(self.ends - 1, 0)], -1), np.zeros(m, np.uint8))
        self.docs = np.flatnonzero(sizes > 0)  # documents with a symbol to insert, and where it stands
        self.at = self.docs.copy()
        self.round = 0

    def _write(self, bwt: np.ndarray, lcp: np.ndarray) -> None:
        bwt.astype(np.int32).tofile(f"{self.folder}/bwt")
        lcp.tofile(f"{self.folder}/lcp")

    def _read(self) -> tuple[np.ndarray, np.ndarray]:
        return np.fromfile(f"{self.folder}/bwt", np.int32), np.fromfile(f"{self.folder}/lcp", np.uint8)

    def insert(self) -> bool:
        """One round; false once every document is used up."""
        if not len(self.docs):
            return False
        bwt, lcp = self._read()
        m, n = len(self.sizes), len(bwt)
        order = _order(bwt)
        done = int((bwt < 0).sum())
        rank = np.empty(n, np.int64)
        rank[order] = np.arange(n)
        new = rank[self.at] - done + m
        self.round += 1
        rest = self.sizes[self.docs] - self.round
        following = np.where(rest > 0, self.symbols[self.ends[self.docs] - self.round - np.where(rest > 0, 1, 0)], -1)

        fresh = np.zeros(n + len(new), bool)
        fresh[new] = True
        bwt2, lcp2 = np.empty(len(fresh), np.int32), np.empty(len(fresh), np.uint8)
        bwt2[~fresh], lcp2[~fresh] = bwt, lcp
        bwt2[new] = following
        # common prefixes of the new suffixes and of those after them: one more than the smallest between
        # the places of the two suffixes without their first symbol
        touched = fresh.copy()
        touched[1:] |= fresh[:-1]
        touched[:m] = False
        t = np.flatnonzero(touched) - m + done
        lcp2[t - done + m] = 0
        t = t[(t > 0)]
        t = t[bwt[order[t]] == bwt[order[t - 1]]]
        t = t[bwt[order[t]] >= 0]
        lcp2[t - done + m] = RangeMin(lcp)(order[t - 1] + 1, order[t]) + np.uint8(1)
        self._write(bwt2, lcp2)
        going = rest > 0
        self.docs, self.at = self.docs[going], new[going]
        return True

    def groups(self, common: int) -> list[tuple[np.ndarray, np.ndarray, np.ndarray]]:
        """By place: (documents, symbol places, groups) of all suffixes of at least ``common`` symbols.

        Suffixes are in one group if they begin with the same ``common`` symbols. All documents are walked
        backwards together, from their ends, through the finished transform.
        """
        bwt, lcp = self._read()
        group = np.cumsum(lcp < common)
        m, n = len(self.sizes), len(bwt)
        order = _order(bwt)
        rank = np.empty(n, np.int64)
        rank[order] = np.arange(n)
        done = int((bwt < 0).sum())
        docs, at, out = np.arange(m), np.arange(m), []
        for k in range(int(self.sizes.max(initial=0)) + 1):
            if k >= common:
                out.append((docs, self.sizes[docs] - k, group[at]))
            going = self.sizes[docs] > k
            docs = docs[going]
            at = rank[at[going]] - done + m
        return out


def _numbered(raw: np.ndarray, width: int) -> np.ndarray:
    """A number for the ``width`` bytes from each place on; equal bytes have equal numbers, from 0 on."""
    n = max(0, len(raw) - width + 1)
    if width <= 5:
        value = np.zeros(n, np.uint64)
        for w in range(width):
            value = (value << np.uint64(8)) | raw[w : n + w]
        return pa.array(value).dictionary_encode().indices.to_numpy()
    size = max(5, (width + 1) // 2)  # two strings of this size, which may overlap, are the whole
    half = _numbered(raw, size)
    value = (half[:n].astype(np.uint64) << np.uint64(32)) | half[width - size : width - size + n].astype(np.uint64)
    order = np.argsort(value)
    value = value[order]
    out = np.empty(n, np.int32)
    out[order] = np.cumsum(np.append(False, value[1:] != value[:-1])[:n])
    return out


def same_strings(texts: list[bytes], length: int) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """(text, start, group) of all ``length``-byte strings of ``texts``; equal strings share a group.

    Bytes are joined to symbols of up to ``SYMBOL`` bytes; a text gives one document for each place modulo
    the symbol's size, so strings at any start are compared. Documents too short for a string are left out.
    """
    width = max(w for w in range(1, SYMBOL + 1) if length % w == 0)
    raw = np.frombuffer(b"".join(texts), np.uint8)
    sizes = np.fromiter(map(len, texts), np.int64, len(texts))
    begin = np.cumsum(sizes) - sizes
    value = _numbered(raw, width)
    phases = np.clip(sizes - length + 1, 0, width)
    docs = np.repeat(np.arange(len(texts)), phases)
    phase = np.arange(len(docs)) - np.repeat(np.cumsum(phases) - phases, phases)
    count = (sizes[docs] - phase) // width
    owner = np.repeat(np.arange(len(docs)), count)
    inner = np.arange(len(owner)) - np.repeat(np.cumsum(count) - count, count)
    symbols = value[begin[docs[owner]] + phase[owner] + inner * width]
    with tempfile.TemporaryDirectory() as folder:
        columns = Columns(symbols, count, folder)
        while columns.insert():
            pass
        found = columns.groups(length // width)
        for name in ("bwt", "lcp"):
            os.truncate(f"{folder}/{name}", 0)
    text = np.concatenate([docs[d] for d, _, _ in found] or [np.empty(0, np.int64)])
    start = np.concatenate([p * width + phase[d] for d, p, _ in found] or [np.empty(0, np.int64)])
    return text, start, np.concatenate([g for _, _, g in found] or [np.empty(0, np.int64)])


def _later(texts: list[bytes], place: np.ndarray, start: np.ndarray, length: int) -> np.ndarray:
    """By record, bits of its strings that also start earlier; ``place`` ranks a record's document."""
    known: dict[bytes, int] = {}
    of = np.fromiter((known.setdefault(t, len(known)) for t in texts), np.int64, len(texts))
    order = np.lexsort((start, place, of))
    first = order[np.unique(of[order], return_index=True)[1]]  # of each distinct text, its first record
    out = np.empty(len(texts), np.uint64)
    windows = np.fromiter(map(len, texts), np.int64, len(texts)) - length + 1
    out[:] = np.where(windows >= 64, ~np.uint64(0), (np.uint64(1) << (windows % 64).astype(np.uint64)) - np.uint64(1))
    text, offset, group = same_strings(list(known), length)
    rank = (place[first[text]].astype(np.int64) << 40) + start[first[text]] + offset
    least = np.full(int(group.max(initial=0)) + 1, np.iinfo(np.int64).max)
    np.minimum.at(least, group, rank)
    late = rank > least[group]
    bits = np.zeros(len(known), np.uint64)
    np.bitwise_or.at(bits, text[late], np.uint64(1) << offset[late].astype(np.uint64))
    out[first] = bits
    return out


def _whole(text: np.ndarray, gone: np.ndarray) -> np.ndarray:
    """``gone`` without the bytes of characters of which a byte is left; a chunk at a time, as places take 8 bytes each."""
    out, start = np.empty(len(gone), bool), 0
    while start < len(text):
        stop = min(start + CHUNK, len(text))
        while stop < len(text) and text[stop] & 0xC0 == 0x80:
            stop += 1
        letters = np.flatnonzero((text[start:stop] & 0xC0) != 0x80)
        sizes = np.diff(np.append(letters, stop - start))
        out[start:stop] = np.repeat(np.logical_and.reduceat(gone[start:stop], letters), sizes)
        start = stop
    return out


def remove_repeats(
    docs: DataFrame,
    id_col: str = "doc_id",
    text_col: str = "text",
    length: int = 100,
    carry: tuple[str, ...] = (),
    whole_characters: bool = False,
    block: int = BLOCK,
    bin_bytes: int = BIN,
    hot: int = HOT,
) -> DataFrame:
    """(id, n_bytes, kept, starts, stops, *carry) for every row of ``docs``.

    A text is its UTF-8 bytes. Every byte covered by a ``length``-byte string that also starts earlier, in a
    document with a smaller id or at an earlier place of the same one, is removed; strings are those of the
    input. ``kept`` are the remaining bytes, ``starts`` and ``stops`` the maximal removed spans. Null texts are empty.
    A null id comes before all ids; rows with equal ids are ordered by a hash of their texts, and equal
    rows one after the other, so of two copies one loses everything. ``carry`` columns are passed through.
    With ``whole_characters`` a character goes only if all of its bytes go, so ``kept`` remains valid UTF-8.
    ``length`` is 2 to 126: a run then has at most 64 strings, whose answers fit one number.
    """
    if not 2 <= length <= 126:
        raise ValueError("length must be 2 to 126")
    spark = docs.sparkSession
    names = [f"c{k}" for k in range(len(carry))]
    rows = docs.select(
        F.col(f"`{id_col}`").cast("bigint").alias("id"),
        F.encode(F.coalesce(F.col(f"`{text_col}`"), F.lit("")), "utf-8").alias("text"),
        F.struct(F.lit(0).alias("_"), *(F.col(f"`{c}`").alias(n) for c, n in zip(carry, names, strict=True))).alias("more"),
    )
    more_type = rows.schema["more"].dataType
    more_arrow = to_arrow_schema(rows.select("more").schema).field("more").type

    def pack(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        base = TaskContext.get().partitionId() << 20
        held: list[tuple] = []
        more: list[pa.Array] = []
        total = made = 0

        def flush() -> pa.RecordBatch:
            texts = [h[1] for h in held]
            tie = np.array([xxhash.xxh64_intdigest(t) for t in texts], np.uint64)
            key = np.array([0 if h[0] is None else h[0] + (1 << 63) for h in held], np.uint64)
            order = np.lexsort((np.arange(len(held)), tie, key))
            extra = pa.concat_arrays(more).take(pa.array(order))
            sizes = np.array([len(texts[k]) for k in order], np.int64)
            return pa.record_batch(
                [
                    pa.array([base + made]),
                    pa.array([[held[k][0] for k in order]], pa.list_(pa.int64())),
                    pa.array([_pack(key[order], tie[order], sizes)], pa.binary()),
                    pa.array([zstandard.compress(b"".join(texts[k] for k in order), 3)], pa.binary()),
                    pa.array([int(sizes.sum())]),
                    pa.ListArray.from_arrays(pa.array([0, len(extra)], pa.int32()), extra.cast(more_arrow)),
                ],
                names=["block", "ids", "meta", "text", "bytes", "more"],
            )

        for b in batches:
            texts, ids = b.column("text"), b.column("id").to_pylist()
            for i in range(b.num_rows):
                t = texts[i].as_py()
                if held and (total + len(t) > block or len(held) >= 1 << 16):
                    yield flush()
                    made += 1
                    held, more, total = [], [], 0
                held.append((ids[i], t))
                more.append(b.column("more").slice(i, 1))
                total += len(t)
        if held:
            yield flush()

    schema = f"block bigint, ids array<bigint>, meta binary, text binary, bytes bigint, more array<{more_type.simpleString()}>"
    blocks = pin(rows.mapInArrow(pack, schema))
    n_bytes = blocks.agg(F.coalesce(F.sum("bytes"), F.lit(0)).alias("n")).first()["n"]
    step = (length - length // 2) / 2
    buckets = 1 << max(0, math.ceil(math.log2(max(1, n_bytes / step / BUCKET))))
    shift = 64 - int(math.log2(buckets))

    def opened(row: dict) -> tuple[Runs, np.ndarray, np.ndarray, np.ndarray]:
        key, tie, sizes = _unpack(row["meta"], np.uint64, np.uint64, np.int64)
        return Runs(np.frombuffer(zstandard.decompress(row["text"]), np.uint8), sizes, length), key, tie, sizes

    def anchors(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for row in (r for b in batches for k in range(b.num_rows) for r in b.slice(k, 1).to_pylist()):
            runs = opened(row)[0]
            order = np.lexsort((runs.key, runs.anchor))
            a, k = runs.anchor[order], runs.key[order]
            if not len(a):
                continue
            new = np.append(True, a[1:] != a[:-1])
            kinds = np.append(True, (a[1:] != a[:-1]) | (k[1:] != k[:-1]))
            start = np.flatnonzero(new)
            occurs = np.diff(np.append(start, len(a)))
            different = np.add.reduceat(kinds.astype(np.int64), start)
            count = np.minimum(different + (occurs > different), 0xFFFF).astype(np.uint16)
            ids = a[start]
            bucket = (ids >> np.uint64(shift)).astype(np.int64) if buckets > 1 else np.zeros(len(ids), np.int64)
            cuts = [0, *(np.flatnonzero(np.diff(bucket)) + 1).tolist(), len(ids)]
            data = [_pack(ids[s:e], count[s:e]) for s, e in zip(cuts[:-1], cuts[1:], strict=True)]
            columns = [pa.array(bucket[cuts[:-1]], pa.int32()), pa.array([row["block"]] * len(data)), pa.array(data, pa.binary())]
            yield pa.record_batch(columns, names=["bucket", "block", "data"])

    def repeated(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for t in sorted_groups(batches, ["bucket"]):
            parts = [_unpack(d, np.uint64, np.uint16) for d in t.column("data").to_pylist()]
            inverse = np.unique(np.concatenate([p[0] for p in parts]), return_inverse=True)[1]
            total = np.bincount(inverse, np.concatenate([p[1] for p in parts]))[inverse]
            ends = np.cumsum([len(p[0]) for p in parts])
            for block_, (ids, count), e in zip(t.column("block").to_pylist(), parts, ends.tolist(), strict=True):
                own = total[e - len(ids) : e]
                runs = int(count[own > 1].astype(np.int64).sum())
                flags = _pack(np.packbits(own > 1), np.packbits(own > hot), np.array([len(own)]))
                yield pa.record_batch(
                    [t.column("bucket")[:1].combine_chunks(), pa.array([block_]), pa.array([flags], pa.binary()), pa.array([runs])],
                    names=["bucket", "block", "flags", "runs"],
                )

    counted = (
        blocks.select("block", "meta", "text").mapInArrow(anchors, "bucket int, block bigint, data binary")
        .repartition("bucket").sortWithinPartitions("bucket").mapInArrow(repeated, "bucket int, block bigint, flags binary, runs bigint")
    )
    counted = pin(counted)
    n_runs = counted.agg(F.coalesce(F.sum("runs"), F.lit(0)).alias("n")).first()["n"]
    bins = max(1, math.ceil(n_runs * (length + step) / bin_bytes))
    flags = counted.groupBy("block").agg(F.sort_array(F.collect_list(F.struct("bucket", "flags"))).alias("flags"))
    flagged = blocks.select("block", "meta", "text").join(flags, "block")

    def recorded(row: dict) -> tuple[Records, Runs, np.ndarray, np.ndarray, np.ndarray]:
        runs, key, tie, sizes = opened(row)
        bits = [_unpack(f["flags"], np.uint8, np.uint8, np.int64) for f in row["flags"] or []]
        marks = [np.concatenate([np.unpackbits(b[k], count=int(b[2][0])) for b in bits] or [np.empty(0, np.uint8)]).astype(bool) for k in (0, 1)]
        return Records(runs, *marks, bins), runs, key, tie, sizes

    def deal(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for row in (r for b in batches for k in range(b.num_rows) for r in b.slice(k, 1).to_pylist()):
            rec, runs, key, tie, sizes = recorded(row)
            begin = np.cumsum(sizes) - sizes
            doc = np.searchsorted(begin, rec.first, side="right") - 1
            uid = np.uint64(row["block"] << 16) + doc.astype(np.uint64)
            cuts = [0, *(np.flatnonzero(np.diff(rec.bin)) + 1).tolist(), len(rec.bin)]
            raw, packs = runs.text.tobytes(), []
            for s, e in zip(cuts[:-1], cuts[1:], strict=True) if len(rec.bin) else ():
                text = b"".join(raw[f : f + c + length - 1] for f, c in zip(rec.first[s:e].tolist(), rec.size[s:e].tolist(), strict=True))
                own = doc[s:e]
                data = _pack(key[own], tie[own], uid[s:e], rec.first[s:e] - begin[own], rec.size[s:e].astype(np.uint8), rec.part[s:e], np.frombuffer(text, np.uint8))
                packs.append((int(rec.bin[s]), row["block"], data))
            if packs:
                columns = zip(*packs, strict=True)
                types = (pa.int32(), pa.int64(), pa.binary())
                yield pa.record_batch([pa.array(c, t) for c, t in zip(columns, types, strict=True)], names=["bin", "block", "data"])

    def judge(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        types = (np.uint64, np.uint64, np.uint64, np.int64, np.uint8, np.uint8, np.uint8)
        for t in sorted_groups(batches, ["bin"]):
            parts = [_unpack(d, *types) for d in t.column("data").to_pylist()]
            texts = []
            for p in parts:
                size = p[4].astype(np.int64) + length - 1
                raw, ends = p[6].tobytes(), np.cumsum(size)
                texts += [raw[e - s : e] for e, s in zip(ends.tolist(), size.tolist(), strict=True)]
            key, tie, uid, start, _, part = (np.concatenate([p[k] for p in parts]) for k in range(6))
            order = np.lexsort((uid, tie, key))
            new = np.append(False, (np.diff(uid[order]) != 0))
            place = np.empty(len(order), np.int64)
            place[order] = np.cumsum(new)
            bits = np.zeros(len(texts), np.uint64)
            for k in np.unique(part):
                own = np.flatnonzero(part == k)
                bits[own] = _later([texts[i] for i in own.tolist()], place[own], start[own], length)
            ends = np.cumsum([len(p[0]) for p in parts])
            for block_, p, e in zip(t.column("block").to_pylist(), parts, ends.tolist(), strict=True):
                yield pa.record_batch(
                    [t.column("bin")[:1].combine_chunks(), pa.array([block_]), pa.array([_pack(bits[e - len(p[0]) : e])], pa.binary())],
                    names=["bin", "block", "bits"],
                )

    dealt = flagged.mapInArrow(deal, "bin int, block bigint, data binary").repartition("bin").sortWithinPartitions("bin")
    judged = pin(dealt.mapInArrow(judge, "bin int, block bigint, bits binary"))
    answers = judged.groupBy("block").agg(F.sort_array(F.collect_list(F.struct("bin", "bits"))).alias("bits"))

    kinds = ", ".join(["id bigint, n_bytes bigint, kept binary, starts array<int>, stops array<int>", *(f"{n} {more_type[n].dataType.simpleString()}" for n in names)])

    def covered(row: dict) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
        """A block's bytes, the sizes of its documents and which bytes are covered."""
        rec, runs, _, _, sizes = recorded(row)
        bits = np.concatenate([_unpack(x["bits"], np.uint64)[0] for x in row["bits"] or []] or [np.empty(0, np.uint64)])
        edge = np.zeros(len(runs.text) + 1, np.int8)
        for o in range(int(rec.count.max(initial=0))):
            hit = (o < rec.count) & (~rec.is_first | ((bits[rec.of] >> np.uint64(o)) & np.uint64(1)).astype(bool))
            edge[rec.at[hit] + o] += 1
            edge[rec.at[hit] + o + length] -= 1
        return runs.text, sizes, np.cumsum(edge[:-1], dtype=np.int8) > 0

    def remove(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in (b.slice(k, 1) for b in batches for k in range(b.num_rows)):
            ids, more = b.column("ids").flatten(), b.column("more").flatten()
            raw = gone = own = None  # the last block's, before the next one is opened
            raw, sizes, gone = covered(b.select(["block", "meta", "text", "flags", "bits"]).to_pylist()[0])
            ends = np.cumsum(sizes).tolist()
            for s in range(0, len(ends), 256):
                kept, starts, stops = [], [], []
                for e, n in zip(ends[s : s + 256], sizes[s : s + 256].tolist(), strict=True):
                    own = gone[e - n : e]
                    if whole_characters and own.any():
                        own = _whole(raw[e - n : e], own)
                    turn = np.flatnonzero(np.diff(np.concatenate(([0], own.view(np.int8), [0]))))
                    kept.append(raw[e - n : e][~own].tobytes())
                    starts.append(turn[::2])
                    stops.append(turn[1::2])
                part = more.slice(s, 256)
                yield pa.record_batch(
                    [
                        ids.slice(s, 256), pa.array(sizes[s : s + 256]), pa.array(kept, pa.binary()),
                        pa.array(starts, pa.list_(pa.int32())), pa.array(stops, pa.list_(pa.int32())),
                        *(part.field(n) for n in names),
                    ],
                    names=["id", "n_bytes", "kept", "starts", "stops", *names],
                )

    whole = blocks.join(flags, "block", "left").join(answers, "block", "left").select("block", "ids", "meta", "text", "more", "flags", "bits")
    out = whole.mapInArrow(remove, kinds)
    return out.select("id", "n_bytes", "kept", "starts", "stops", *(F.col(n).alias(c) for n, c in zip(names, carry, strict=True)))
