"""Near-duplicate vectors by sorted projection passes."""

from __future__ import annotations

import heapq
import math
import warnings
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark import TaskContext
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from cohortlens.llm.common import merge_labels, only, sorted_groups
from cohortlens.llm.components import components
from cohortlens.session import pin

#: Hash bits in a sort key.
BITS = 62
#: Following rows that a row is compared with in each pass.
WINDOW = 256
#: Greatest share of the links of the probes that all passes together may miss.
MISS = 0.01
#: Probes: vectors whose links are looked up among all rows, to measure what the passes find, and how many links of each.
PROBES = 2048
PROBE_LINKS = 8
#: Vectors of the sample from which the places of the cuts are learnt.
SAMPLE = 1 << 14
#: Vectors of the sample that a cut divides, at least.
LEAST = 32
#: Passes of the first round; each further round doubles them all, up to the last number, where a warning tells what is missed.
PASSES = 6
MOST_PASSES = 384
#: Rows of a sorted partition, on average.
PART_ROWS = 1 << 16
#: Numbers in one side of a verification tile.
TILE = 1 << 20
SEED = 20_011


def _unit(data: list[bytes], dtype: str) -> np.ndarray:
    """Rows of length one in double precision."""
    m = np.frombuffer(b"".join(data), dtype).astype(np.float64).reshape(len(data), -1)
    m = m / np.abs(m).max(axis=1, keepdims=True)
    return m / np.sqrt(np.einsum("ij,ij->i", m, m))[:, None]


class Cuts:
    """The hash of one pass for vectors of one size: projections on random directions, one bit each.

    A bit tells on which side of a cut the projection lies. The cuts of the first bits are the medians of the sample's
    vectors that share the bits before, so that dense regions are divided as evenly as sparse ones; those of the further
    bits are the projections of the mean of the sample's vectors that share all the first bits.
    """

    def __init__(self, sample: np.ndarray, size: int, number: int):
        self.planes = np.random.default_rng([SEED, number, size]).standard_normal((size, BITS))
        self.depth = max(0, int(math.log2(len(sample) / LEAST))) if len(sample) else 0
        values, node = sample @ self.planes, np.zeros(len(sample), np.int64)
        self.medians = []
        for level in range(self.depth):
            order = np.lexsort((values[:, level], node))
            nodes, first, members = np.unique(node[order], return_index=True, return_counts=True)
            cut = np.zeros(1 << level)
            cut[nodes] = values[order[first + members // 2], level]
            self.medians.append(cut)
            node = 2 * node + (values[:, level] > cut[node])
        total = np.zeros((1 << self.depth, BITS))
        np.add.at(total, node, values)
        self.means = total / np.maximum(np.bincount(node, minlength=1 << self.depth), 1)[:, None]

    def keys(self, m: np.ndarray) -> np.ndarray:
        values, node = m @ self.planes, np.zeros(len(m), np.int64)
        for level, cut in enumerate(self.medians):
            node = 2 * node + (values[:, level] > cut[node])
        key = node
        bits = values[:, self.depth :] > self.means[node, self.depth :]
        for k in range(bits.shape[1]):
            key = 2 * key + bits[:, k]
        return key


def _star(ids: np.ndarray, u: np.ndarray, v: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    labels = merge_labels(np.arange(len(ids)), u, v)
    own = np.flatnonzero(labels != np.arange(len(ids)))
    return ids[own], ids[labels[own]]


def _banded(m: np.ndarray, window: int, threshold: float) -> tuple[np.ndarray, np.ndarray]:
    """Pairs (i, i + 1 .. i + window) of rows whose cosine reaches the threshold."""
    us, vs = [], []
    for s in range(0, len(m), window):
        left, right = m[s : s + window], m[s : s + 2 * window]
        i, j = np.nonzero(left @ right.T >= threshold)
        ok = (j > i) & (j - i <= window)
        us.append(i[ok] + s)
        vs.append(j[ok] + s)
    return np.concatenate(us or [np.empty(0, int)]), np.concatenate(vs or [np.empty(0, int)])


def near_duplicates(
    vectors: DataFrame,
    id_col: str = "vec_id",
    vector_col: str = "embedding",
    threshold: float = 0.95,
    window: int = WINDOW,
    miss: float = MISS,
    part_rows: int = PART_ROWS,
    tile: int = TILE,
    passes: int = PASSES,
) -> DataFrame:
    """(id, n_links, component, kept) for every row of ``vectors``.

    In every pass the distinct vectors are sorted by random projections, one bit each, written one after
    the other (see ``Cuts``), and each is compared with the ``window`` rows after it; cosines are taken in double
    precision. The links of all passes are united. What the passes find is measured: ``PROBES`` vectors are compared with
    all rows, and while more than ``miss`` of their links (at most ``PROBE_LINKS`` a probe and task, chosen by a
    hash) are not within one group, a further round runs with fresh directions. Dense regions, where vectors
    at the threshold are cut apart more often, so get as many passes as they need.

    Then all pairs within a united group are verified in tiles of ``tile`` numbers a side, so that ``n_links`` does not
    depend on windows and dense groups are complete. Only link counts leave a tile, never its pairs.

    Vectors that are null or empty, all zero, or hold a null, NaN or infinity have no link and are their
    own component. Vectors of other lengths never link. Copies of a vector are one class with a count.
    A null id is never the smallest of its component (a component of null ids has a null one); ``kept`` is true
    where id and component are the same, nulls included. Repeated rows count as copies and are all returned.
    """
    spark = vectors.sparkSession
    kind = only(vectors, v=vector_col).schema["v"].dataType.elementType.typeName()
    dtype = "<f4" if kind == "float" else "<f8"
    value = "float" if kind == "float" else "double"
    rows = only(vectors, id=id_col, v=vector_col).select("id", F.col("v").cast(f"array<{value}>").alias("v"))

    def pack(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in batches:
            v = b.column("v")
            flat = v.values.to_numpy(zero_copy_only=False)
            offsets, there = np.asarray(v.offsets), np.asarray(v.is_valid())
            out = []
            for i in range(len(v)):
                x = flat[offsets[i] : offsets[i + 1]]
                out.append(x.astype(dtype).tobytes() if there[i] and len(x) and np.isfinite(x).all() and x.any() else None)
            yield pa.record_batch([b.column("id").cast(pa.int64()), pa.array(out, pa.binary())], names=["id", "vec"])

    packed = pin(rows.mapInArrow(pack, "id bigint, vec binary"))
    grouped = packed.where("vec is not null").groupBy("vec").agg(F.min("id").alias("least"), F.count("*").alias("copies"))
    classes = pin(grouped.withColumn("cls", F.monotonically_increasing_id()))
    n = classes.count()
    longest = classes.agg(F.max(F.length("vec"))).first()[0] or 1
    rows_held = max(64, min(SAMPLE, (64 << 20) // longest))
    drawn = classes.orderBy(F.xxhash64("vec"), "cls").limit(rows_held).select("cls", "vec").collect()
    sample = spark.sparkContext.broadcast([(r.cls, bytes(r.vec)) for r in drawn])

    known, done, missed = None, 0, 1.0
    probed = _probe_links(classes, sample, threshold, dtype)
    while True:
        upto = min(MOST_PASSES, done + passes if done == 0 else 2 * done)
        found = _pass_links(classes, sample, range(done, upto), window, threshold, dtype, max(1, math.ceil(n * (upto - done) / part_rows)))
        parts_of = pin(components(found if known is None else found.unionByName(known)))
        known, done = parts_of.select(F.col("node").alias("a"), F.col("component").alias("b")), upto
        ends = [parts_of.select(F.col("node").alias(c), F.col("component").alias(f"of_{c}")) for c in ("a", "b")]
        seen = probed.join(ends[0], "a", "left").join(ends[1], "b", "left")
        total, met = seen.agg(F.count("*"), F.count_if(F.col("of_a") == F.col("of_b"))).first()
        missed = 1 - met / total if total else 0.0
        if missed <= miss:
            break
        if done == MOST_PASSES:
            warnings.warn(f"{missed:.1%} of the probes' links are missed after {done} passes", stacklevel=2)
            break

    tile_rows = max(64, tile // max(1, longest // np.dtype(dtype).itemsize))
    sizes = parts_of.groupBy("component").agg(F.count("*").alias("members"))
    members = parts_of.join(sizes, "component").join(classes.withColumnRenamed("cls", "node"), "node")
    members = members.withColumn("chunks", F.ceil(F.col("members") / tile_rows).cast("int"))
    members = members.withColumn("chunk", F.pmod(F.xxhash64("node"), F.col("chunks").cast("bigint")).cast("int"))
    tiles = members.select(
        "component", "node", "vec", "copies", "chunk", F.explode(F.sequence(F.lit(0), F.col("chunks") - 1)).alias("other")
    ).select(
        "component", "node", "vec", "copies", F.col("chunk").alias("own"), F.least("chunk", "other").alias("i"), F.greatest("chunk", "other").alias("j")
    )
    keys = ["component", "i", "j"]

    def verify(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for t in sorted_groups(batches, keys):
            own, i, j = t.column("own").to_numpy(), t.column("i")[0].as_py(), t.column("j")[0].as_py()
            node, copies = t.column("node").to_numpy(), t.column("copies").to_numpy()
            total = np.zeros(len(node), np.int64)
            for _, at, x in _sized(t.column("vec").to_pylist(), dtype):
                left, right = np.flatnonzero(own[at] == i), np.flatnonzero(own[at] == j)
                for s in range(0, len(left), 512):
                    some = left[s : s + 512]
                    hit = x[some] @ x[right].T >= threshold
                    if i == j:
                        hit[np.arange(len(some)), np.arange(s, s + len(some))] = False
                    else:
                        total[at[right]] += copies[at[some]] @ hit
                    total[at[some]] += hit @ copies[at[right]]
            yield pa.record_batch([pa.array(node), pa.array(total)], names=["node", "linked"])

    counted = tiles.repartition(*keys).sortWithinPartitions(*keys).mapInArrow(verify, "node bigint, linked bigint")
    counted = counted.groupBy("node").agg(F.sum("linked").alias("linked"))
    least = parts_of.join(classes.select(F.col("cls").alias("node"), "least"), "node").groupBy("component").agg(F.min("least").alias("smallest"))
    grouped = parts_of.join(least, "component").join(counted, "node").select(F.col("node").alias("cls"), "smallest", "linked")
    known = classes.join(grouped, "cls", "left").select(
        "vec",
        (F.coalesce("linked", F.lit(0)) + F.col("copies") - 1).alias("n_links"),
        F.when(F.col("linked").isNull(), F.col("least")).otherwise(F.col("smallest")).alias("component"),
    )
    ok = packed.where("vec is not null").join(known, "vec").select("id", "n_links", "component")
    alone = packed.where("vec is null").select("id", F.lit(0).cast("bigint").alias("n_links"), F.col("id").alias("component"))
    return ok.unionByName(alone).withColumn("kept", F.col("id").eqNullSafe(F.col("component")))


def _sized(data: list[bytes], dtype: str) -> Iterator[tuple[int, np.ndarray, np.ndarray]]:
    """(bytes of a vector, places, rows of length one) by size."""
    sizes = np.array([len(x) for x in data], np.int64)
    for size in np.unique(sizes).tolist():
        at = np.flatnonzero(sizes == size)
        yield size, at, _unit([data[i] for i in at], dtype)


def _probe_links(classes: DataFrame, sample, threshold: float, dtype: str) -> DataFrame:
    """(a, b): links between the first vectors of the sample and all others, some of each probe and task."""

    def scan(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        held = sample.value[:PROBES]
        cls = np.array([c for c, _ in held], np.int64)
        probes = {size: (cls[at], m) for size, at, m in _sized([v for _, v in held], dtype)}
        kept: dict[int, list[tuple[int, int]]] = {}
        for b in batches:
            own = b.column("cls").to_numpy()
            for size, at, m in _sized(b.column("vec").to_pylist(), dtype):
                if size not in probes:
                    continue
                keys, p = probes[size]
                for s in range(0, len(at), 1024):
                    i, j = np.nonzero(p @ m[s : s + 1024].T >= threshold)
                    a, z = keys[i], own[at[s + j]]
                    lot = (z.astype(np.uint64) * np.uint64(0x9E3779B97F4A7C15)) >> np.uint64(11)
                    for x, y, h in zip(a[a != z].tolist(), z[a != z].tolist(), lot[a != z].tolist(), strict=True):
                        heapq.heappush(kept.setdefault(x, []), (-h, y))
                        if len(kept[x]) > PROBE_LINKS:
                            heapq.heappop(kept[x])
        pairs = [(x, y) for x, ys in kept.items() for _, y in ys]
        yield pa.record_batch([pa.array([p[k] for p in pairs], pa.int64()) for k in (0, 1)], names=["a", "b"])

    return pin(classes.select("cls", "vec").mapInArrow(scan, "a bigint, b bigint"))


def _pass_links(classes: DataFrame, sample, numbers: range, window: int, threshold: float, dtype: str, parts: int) -> DataFrame:
    """(a, b): stars of the links that the passes ``numbers`` find."""

    def project(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        drawn = {size: m for size, _, m in _sized([v for _, v in sample.value], dtype)}
        cuts: dict[tuple[int, int], Cuts] = {}
        for b in batches:
            data, cls = b.column("vec").to_pylist(), b.column("cls").to_numpy()
            for size, at, m in _sized(data, dtype):
                vec = pa.array([data[i] for i in at], pa.binary())
                for p in numbers:
                    if (size, p) not in cuts:
                        cuts[size, p] = Cuts(drawn.get(size, m[:0]), m.shape[1], p)
                    columns = [np.full(len(at), p, np.int32), np.full(len(at), size, np.int32), cuts[size, p].keys(m), cls[at]]
                    yield pa.record_batch([*map(pa.array, columns), vec], names=["pass", "size", "key", "cls", "vec"])

    order = ["pass", "size", "key", "cls"]
    keyed = classes.select("cls", "vec").mapInArrow(project, "pass int, size int, key bigint, cls bigint, vec binary")
    sorted_ = keyed.repartitionByRange(parts, *order).sortWithinPartitions(*order)

    def compare(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        """Links within the partition, and its first and last rows for the places where partitions meet."""
        part = TaskContext.get().partitionId()
        names = ["a", "b", "part", "pass", "size", "key", "cls", "vec"]
        empty = lambda k, t: pa.nulls(k, t)

        def edge(t: pa.Table, side: int) -> pa.RecordBatch:
            cols = [empty(t.num_rows, pa.int64())] * 2 + [pa.array([part - side] * t.num_rows, pa.int32())]
            return pa.record_batch(cols + [t.column(c).combine_chunks() for c in names[3:]], names=names)

        tail = head = None
        for b in batches:
            if b.num_rows == 0:
                continue
            t = pa.Table.from_batches([b])
            if head is None or head.num_rows < window:
                head = t.slice(0, window) if head is None else pa.concat_tables([head, t]).slice(0, window)
            held = t if tail is None else pa.concat_tables([tail, t])
            a, z = _links(held, window, threshold, dtype)
            if len(a):
                cols = [pa.array(a), pa.array(z), empty(len(a), pa.int32())]
                types = (pa.int32(), pa.int32(), pa.int64(), pa.int64(), pa.binary())
                yield pa.record_batch(cols + [empty(len(a), x) for x in types], names=names)
            tail = held.slice(max(0, held.num_rows - window))
        if tail is not None:
            yield edge(head, 1)
            yield edge(tail, 0)

    schema = "a bigint, b bigint, part int, pass int, size int, key bigint, cls bigint, vec binary"
    found = pin(sorted_.mapInArrow(compare, schema))

    def seams(t: pa.Table) -> pa.Table:
        a, z = _links(t.sort_by([(c, "ascending") for c in order]), window, threshold, dtype)
        return pa.table({"a": pa.array(a), "b": pa.array(z)})

    across = found.where("part is not null").groupBy("part").applyInArrow(seams, "a bigint, b bigint")
    return found.where("part is null").select("a", "b").unionByName(across).distinct()


def _links(t: pa.Table, window: int, threshold: float, dtype: str) -> tuple[np.ndarray, np.ndarray]:
    """Stars that connect the similar rows of sorted rows, pass by pass."""
    a, z = [np.empty(0, np.int64)], [np.empty(0, np.int64)]
    run = np.asarray(t.column("pass")).astype(np.int64) << 32 | np.asarray(t.column("size"))
    cuts = [0, *(np.flatnonzero(np.diff(run)) + 1).tolist(), t.num_rows]
    for s, e in zip(cuts[:-1], cuts[1:], strict=True):
        if e - s > 1:
            some = t.slice(s, e - s)
            u, v = _banded(_unit(some.column("vec").to_pylist(), dtype), window, threshold)
            x, y = _star(some.column("cls").to_numpy(), u, v)
            a.append(x)
            z.append(y)
    return np.concatenate(a), np.concatenate(z)
