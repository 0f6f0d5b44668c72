"""Near-duplicate documents by SimHash fingerprints and a self-join of binary tries."""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
import xxhash
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from cohortlens.llm.common import merge_labels, only, slices
from cohortlens.llm.components import components
from cohortlens.session import pin

SEED = 42
#: Fingerprints below one node of the routing level, on average.
NODE_SIZE = 32_768
#: Node pairs that are traversed together.
FRONTIER = 1 << 21
#: Shingles hashed before their bits are counted.
BLOCK = 1 << 16


def fingerprint(text: str | None, shingle: int = 4) -> int:
    """64 bits: a bit is set if it is set in over half of the shingles' hashes."""
    words = (text or "").encode("utf-8", "surrogatepass").lower().split()
    if not words:
        return 0
    if len(words) <= shingle:
        return xxhash.xxh64_intdigest(b" ".join(words), SEED)
    line = b" ".join(words)
    ends = np.cumsum(np.fromiter(map(len, words), np.int64, len(words)) + 1) - 1
    starts = np.concatenate(([0], ends[:-1] + 1))[: len(words) - shingle + 1].tolist()
    ends = ends[shingle - 1 :].tolist()
    digest = xxhash.xxh64_intdigest
    counts = np.zeros(64, np.int64)
    for k in range(0, len(starts), BLOCK):
        some = [digest(line[s:e], SEED) for s, e in zip(starts[k : k + BLOCK], ends[k : k + BLOCK], strict=True)]
        bits = np.unpackbits(np.array(some, dtype=">u8").view(np.uint8).reshape(-1, 8), axis=1)
        counts += bits.sum(axis=0, dtype=np.int64)
    return int.from_bytes(np.packbits(2 * counts > len(starts)).tobytes(), "big")


def fingerprints(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text", shingle: int = 4) -> DataFrame:
    """(id, fp): the fingerprint as a signed 64-bit number, one row per row of ``docs``."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in slices(batches, "text"):
            fps = np.array([fingerprint(t, shingle) for t in b.column("text").to_pylist()], dtype=np.uint64)
            yield pa.record_batch([b.column("id").cast(pa.int64()), pa.array(fps.view(np.int64))], names=["id", "fp"])

    return only(docs, id=id_col, text=text_col).mapInArrow(run, "id bigint, fp bigint")


class Trie:
    """Binary trie over sorted distinct 64-bit keys below their first ``top`` bits.

    ``child[d]`` has two rows: for every node of depth ``top + d`` its children at the next depth, or -1.
    ``first[d]`` has the place in ``keys`` of every node's first key, and the number of keys at the end.
    """

    def __init__(self, keys: np.ndarray, top: int):
        self.keys, self.top = keys, top
        n = len(keys)
        # depth at which a key parts from the one before it: the number of leading bits they share
        split = np.zeros(n, np.int64)
        if n > 1:
            differ = keys[1:] ^ keys[:-1]
            high = differ.copy()
            for s in (1, 2, 4, 8, 16, 32):
                high |= high >> np.uint64(s)
            split[1:] = 64 - np.bitwise_count(high).astype(np.int64)
        self.first, self.child = [np.array([0, n])], []
        for depth in range(top, 64):
            new = split <= depth  # a key that starts a node of depth + 1
            new[0] = True
            starts = np.flatnonzero(new)
            nodes = self.first[-1][:-1]
            owner = np.searchsorted(nodes, starts, side="right") - 1
            bit = (keys[starts] >> np.uint64(63 - depth)) & np.uint64(1)
            child = np.full((2, len(nodes)), -1, np.int64)
            child[bit.astype(np.int64), owner] = np.arange(len(starts))
            self.child.append(child)
            self.first.append(np.append(starts, n))
            if len(starts) == n:
                break
        self.depth = len(self.child)

    def uniform(self, labels: np.ndarray) -> list[np.ndarray]:
        """By depth: a node's label if all keys below it have the same one, else -1."""
        out = []
        for first in self.first:
            low = np.minimum.reduceat(labels, first[:-1])
            out.append(np.where(low == np.maximum.reduceat(labels, first[:-1]), low, -1))
        return out


def _grow(t: Trie, depth: int, nodes: np.ndarray) -> list[np.ndarray]:
    """The two children of every node; a trie that has ended keeps its single keys as they are."""
    if depth < t.depth:
        return [t.child[depth][0][nodes], t.child[depth][1][nodes]]
    bit = (t.keys[nodes] >> np.uint64(63 - t.top - depth)) & np.uint64(1)
    return [np.where(bit == k, nodes, -1) for k in (0, 1)]


def trie_join(
    x: np.ndarray, y: np.ndarray | None, top: int, used: int, half: int, budget: int
) -> Iterator[tuple[np.ndarray, np.ndarray]]:
    """Labels of linked keys: yields, once, (keys, label keys) with a star for every linked set.

    ``x`` and ``y`` are sorted distinct keys below two nodes of depth ``top`` whose paths differ in ``used``
    bits (``y`` None: below the same node). Node pairs go down together; the bits in which their paths
    differ add up, and a pair is dropped once they exceed ``half`` within the first 32 bits or ``budget``
    at all. A pair whose keys are all in one set already is dropped too, so a dense group is linked
    without visiting its pairs; small budgets go first for that.
    """
    a = Trie(x, top)
    b = a if y is None else Trie(y, top)
    shift = 0 if y is None else len(x)
    keys = x if y is None else np.concatenate([x, y])
    labels = np.arange(len(keys))
    for most in sorted({min(1, budget), budget}):
        flat = [a.uniform(labels), b.uniform(labels[shift:])]
        stack = [(0, np.array([0]), np.array([0]), np.array([used]))]
        while stack:
            depth, i, j, diff = stack.pop()
            single = min(depth, a.depth) == a.depth and min(depth, b.depth) == b.depth
            if single or top + depth == 64:
                off = np.bitwise_count(a.keys[i] ^ b.keys[j]) <= most
                high = np.bitwise_count((a.keys[i] ^ b.keys[j]) >> np.uint64(32)) <= half
                ok = off & high
                labels = merge_labels(labels, i[ok], j[ok] + shift)
                flat = [a.uniform(labels), b.uniform(labels[shift:])] if ok.any() and stack else flat
                continue
            ca, cb = _grow(a, depth, i), _grow(b, depth, j)
            limit = min(half, most) if top + depth < 32 else most
            found = []
            for p, q in ((0, 0), (1, 1), (0, 1), (1, 0)):
                keep = (ca[p] >= 0) & (cb[q] >= 0) & (diff + (p != q) <= limit)
                if y is None and (p, q) == (1, 0):
                    keep &= i != j  # a node with itself: its two children meet once
                found.append((ca[p][keep], cb[q][keep], diff[keep] + (p != q)))
            i, j, diff = (np.concatenate(z) for z in zip(*found, strict=True))
            depth += 1
            fa, fb = flat[0][min(depth, a.depth)][i], flat[1][min(depth, b.depth)][j]
            keep = (fa != fb) | (fa < 0)
            i, j, diff = i[keep], j[keep], diff[keep]
            for k in range(0, len(i), FRONTIER):
                stack.append((depth, i[k : k + FRONTIER], j[k : k + FRONTIER], diff[k : k + FRONTIER]))
    linked = labels != np.arange(len(labels))
    yield keys[linked], keys[labels[linked]]


def _neighbours(top: int, most: int) -> list[list[tuple[int, int]]]:
    """For every node of depth ``top``: the nodes whose paths differ in at most ``most`` bits."""
    masks = [m for m in range(1 << top) if m.bit_count() <= most]
    return [[(node ^ m, m.bit_count()) for m in masks] for node in range(1 << top)]


def links(classes: DataFrame, distance: int = 4, node_size: int = NODE_SIZE) -> DataFrame:
    """(a, b): links of distinct fingerprints that connect exactly what is within ``distance`` bits.

    ``classes`` has a column ``fp`` without repeats. Two tries are joined with themselves: over the
    bits in their order and over the halves swapped. A pair within ``distance`` bits differs in at most
    ``distance // 2`` bits of the first half, or in fewer than ``distance - distance // 2`` of the second,
    so the budget of the first 32 levels can be that small. Spark deals out the pairs of nodes of one
    level, chosen so that a node has about ``node_size`` fingerprints; a task joins two subtries.
    """
    n = classes.count()
    top = max(0, min(16, int(np.ceil(np.log2(max(1, n / node_size))))))
    tries = [(0, distance // 2)] + ([(1, distance - distance // 2 - 1)] if distance else [])
    near = {swap: _neighbours(top, half) for swap, half in tries}

    def turn(keys: np.ndarray, swap: int) -> np.ndarray:
        return (keys << np.uint64(32)) | (keys >> np.uint64(32)) if swap else keys

    def deal(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            raw = batch.column("fp").to_numpy(zero_copy_only=False).view(np.uint64)
            for swap, _ in tries:
                keys = np.sort(turn(raw, swap))
                node = (keys >> np.uint64(64 - top)).astype(np.int64) if top else np.zeros(len(keys), np.int64)
                cuts = np.flatnonzero(np.diff(node)) + 1
                for part in np.split(keys, cuts) if len(keys) else []:
                    own = int(part[0] >> np.uint64(64 - top)) if top else 0
                    data = part.tobytes()
                    to = near[swap][own]
                    yield pa.record_batch(
                        [
                            pa.array([swap] * len(to), pa.int32()),
                            pa.array([min(own, x) for x, _ in to], pa.int32()),
                            pa.array([max(own, x) for x, _ in to], pa.int32()),
                            pa.array([own] * len(to), pa.int32()),
                            pa.array([data] * len(to), pa.binary()),
                        ],
                        names=["swap", "x", "y", "own", "keys"],
                    )

    def join(t: pa.Table) -> pa.Table:
        swap, x, y = (t.column(c)[0].as_py() for c in ("swap", "x", "y"))
        own, packs = t.column("own").to_numpy(), t.column("keys").to_pylist()
        side = lambda node: np.sort(np.concatenate([np.frombuffer(k, np.uint64) for o, k in zip(own, packs, strict=True) if o == node] or [np.empty(0, np.uint64)]))  # noqa: E731, E501
        left, right = side(x), side(y)
        out = []
        if len(left) and len(right):
            half = dict(tries)[swap]
            out = list(trie_join(left, None if x == y else right, top, (x ^ y).bit_count(), half, distance))
        pairs = [np.concatenate([o[k] for o in out] or [np.empty(0, np.uint64)]) for k in (0, 1)]
        return pa.table({c: pa.array(turn(p, swap).view(np.int64)) for c, p in zip("ab", pairs, strict=True)})

    dealt = classes.mapInArrow(deal, "swap int, x int, y int, own int, keys binary")
    return dealt.groupBy("swap", "x", "y").applyInArrow(join, "a bigint, b bigint")


def near_duplicates(
    docs: DataFrame, id_col: str = "doc_id", text_col: str = "text", shingle: int = 4, distance: int = 4
) -> DataFrame:
    """(id, fp, component) for every row of ``docs``.

    Words are runs of bytes other than ASCII white space after lower-casing A-Z; shingles are hashed with
    XXH64 (seed 42). Rows link if their fingerprints differ in at most ``distance`` bits; ``component`` is
    the smallest id reachable. Null and blank texts have fingerprint zero and link like any other. A
    null id is never the smallest: a set of null ids only has component null. Repeated rows give repeated
    rows. An empty table gives an empty result; other columns are ignored. Rows with equal fingerprints
    are one class before any join, so groups of copies cost one row there.
    """
    prints = pin(fingerprints(docs, id_col, text_col, shingle))
    own = _grouped(prints.groupBy("fp").agg(F.min("id").alias("least")), distance)
    least = own.groupBy("component").agg(F.min("least").alias("smallest"))
    named = own.join(least, "component").select("fp", F.col("smallest").alias("component"))
    return prints.join(named, "fp").select("id", "fp", "component")


def _grouped(classes: DataFrame, distance: int) -> DataFrame:
    """Classes of equal fingerprints with the smallest fingerprint of their component.

    Links are written before they are joined: a task that joins tries and makes stars at once takes two Python workers,
    and executors keep those for all that follows.
    """
    classes = pin(classes)
    parts = components(pin(links(classes.select("fp"), distance)))
    joined = classes.join(parts.withColumnRenamed("node", "fp"), "fp", "left")
    return joined.withColumn("component", F.coalesce("component", "fp"))


def keep_representatives(
    docs: DataFrame, id_col: str = "doc_id", text_col: str = "text", shingle: int = 4, distance: int = 4
) -> DataFrame:
    """One row of each group of ``near_duplicates``, with all columns: the one with the smallest id.

    Of rows that share that id and the fingerprint, the one whose columns sort first stays; a group of null ids keeps
    one row in the same way.
    """
    columns = docs.columns
    schema = docs.select("*", F.lit(0).cast("bigint").alias("__fp")).schema

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in slices(batches, text_col):
            fps = np.array([fingerprint(t, shingle) for t in b.column(text_col).to_pylist()], dtype=np.uint64)
            yield pa.record_batch([*b.columns, pa.array(fps.view(np.int64))], names=[*b.schema.names, "__fp"])

    printed = pin(docs.mapInArrow(run, schema))
    rows = only(printed, id=id_col, fp="__fp").select(F.col("id").cast("bigint").alias("id"), "fp")
    own = _grouped(rows.groupBy("fp").agg(F.min("id").alias("least")), distance)
    first = F.min(F.struct(F.col("least").isNull().alias("unknown"), "least", "fp")).alias("first")
    chosen = own.groupBy("component").agg(first).select("first.fp", "first.least")
    counted = rows.join(chosen, "fp").where("id <=> least").groupBy("fp", "least").agg(F.count("*").alias("n"))
    chosen = pin(counted.toDF("__fp", "__id", "__n"))
    picked = printed.join(chosen, "__fp").where(F.col(f"`{id_col}`").eqNullSafe(F.col("__id")))
    alone = picked.where("__n = 1").select(*columns)
    least = picked.where("__n > 1").groupBy("__fp").agg(F.min(F.struct(*columns)).alias("row")).select("row.*")
    return alone.unionByName(least)
