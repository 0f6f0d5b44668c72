"""Hard negatives of anchors, with score bounds along a spanning tree of the anchors."""

from __future__ import annotations

import math
from collections.abc import Iterator
from functools import reduce

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from cohortlens.functions.bounded import bounded_rows
from cohortlens.llm.common import only
from cohortlens.session import pin

#: Components are multiplied by this and rounded down, so that scores are whole numbers.
SCALE = 256
#: One row in so many is an anchor; one in so many gets another label.
ANCHORS = 50
MOVED = 7
LABELS = 10
POSITIVES = 5
NEGATIVES = 3
#: A negative's score lies between these percentages of the positive's.
LOW, HIGH = 50, 95
#: Anchors of a tree, on average.
TREE = 1024
#: Anchors that are sent to all tasks at a time.
SENT = 16 * TREE
#: Candidates scored at a time.
CHUNK = 2048
#: Whole numbers up to here are exact in double precision.
EXACT = float(1 << 53)
LONG = (1 << 63) - 1


def _matrix(data: list[bytes]) -> np.ndarray:
    return np.frombuffer(b"".join(data), np.float64).reshape(len(data), -1)


def _prepared(vectors: DataFrame, id_col: str, vector_col: str, label_col: str) -> DataFrame:
    """(row, id, label, dim, vec): the rows that take part, once each, with whole components packed as doubles."""
    rows = only(vectors, id=id_col, label=label_col, v=vector_col).where("id is not null and label is not null and v is not null")
    rows = rows.select("id", F.col("label").cast("bigint").alias("label"), F.col("v").cast("array<double>").alias("v"))

    def pack(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in batches:
            v = b.column("v")
            flat, offsets = v.values.to_numpy(zero_copy_only=False), np.asarray(v.offsets)
            scaled = np.floor(np.ldexp(flat, int(math.log2(SCALE))))
            whole = [scaled[s:e] if np.isfinite(flat[s:e]).all() else None for s, e in zip(offsets[:-1], offsets[1:], strict=True)]
            packed = pa.array([None if x is None else x.tobytes() for x in whole], pa.binary())
            dims = pa.array([0 if x is None else len(x) for x in whole], pa.int32())
            yield pa.record_batch([b.column("id").cast(pa.int64()), b.column("label"), dims, packed], names=["id", "label", "dim", "vec"])

    packed = rows.mapInArrow(pack, "id bigint, label bigint, dim int, vec binary").where("vec is not null")
    moved = F.when(F.col("id") % MOVED == 0, F.pmod(F.col("label") + 1, F.lit(LABELS))).otherwise(F.col("label"))
    return pin(packed.withColumn("label", moved).distinct().withColumn("row", F.monotonically_increasing_id()))


def spanning_tree(points: np.ndarray) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """(order, parent, length): the shortest tree that joins the points, parents before children, from point 0."""
    n = len(points)
    with np.errstate(over="ignore", invalid="ignore"):
        sq = np.einsum("ij,ij->i", points, points)
        order, parent, length = np.zeros(n, np.int64), np.full(n, -1), np.zeros(n)
        open_, near, far = np.ones(n, bool), np.zeros(n, np.int64), np.full(n, np.inf)
        open_[0], at = False, 0
        for k in range(1, n):
            d = sq + sq[at] - 2 * (points @ points[at])
            closer = open_ & (np.nan_to_num(d, nan=np.inf) < far)
            far[closer], near[closer] = d[closer], at
            left = np.flatnonzero(open_)
            at = left[np.argmin(far[left])]
            open_[at], order[k], parent[at] = False, at, near[at]
        steps = order[1:]
        length[steps] = np.sqrt(((points[steps] - points[parent[steps]]) ** 2).sum(axis=1))
    return order, parent, length


def _trees(anchors: DataFrame, groups: int) -> DataFrame:
    """One row per tree: (dim, tree, rows, ids, labels, vecs, order, parent, length)."""

    def grow(t: pa.Table) -> pa.Table:
        t = t.sort_by("row")
        order, parent, length = spanning_tree(_matrix(t.column("vec").to_pylist()) if t.column("dim")[0].as_py() else np.zeros((t.num_rows, 0)))
        lists = {"rows": t.column("row"), "ids": t.column("id"), "labels": t.column("label"), "vecs": t.column("vec")}
        arrays = [pa.array([v.to_pylist()]) for v in lists.values()] + [pa.array([x.tolist()]) for x in (order, parent, length)]
        names = ["dim", "tree", *lists, "sequence", "parent", "length"]
        return pa.table([t.column("dim")[:1], t.column("tree")[:1], *arrays], names=names)

    dealt = anchors.withColumn("tree", F.pmod(F.xxhash64("row"), F.lit(groups)).cast("int"))
    return dealt.groupBy("dim", "tree").applyInArrow(
        grow,
        "dim int, tree int, rows array<bigint>, ids array<bigint>, labels array<bigint>, vecs array<binary>, "
        "sequence array<bigint>, parent array<bigint>, length array<double>",
    )


def _exact(x: np.ndarray, a: np.ndarray, small: bool) -> np.ndarray:
    """Whole inner products, held to the range of a long."""
    if small:
        return (x @ a).astype(np.int64)
    whole = [int(v) for v in a]
    scores = [sum(int(u) * v for u, v in zip(row.tolist(), whole, strict=True)) for row in x]
    return np.array([max(-LONG, min(LONG, s)) for s in scores], np.int64)


class _Best:
    """The ``k`` best scores of one window, ties by smaller id."""

    def __init__(self, k: int, low: float, high: float):
        self.k, self.low, self.high = k, low, high
        self.score, self.id = np.empty(0, np.int64), np.empty(0, np.int64)

    def floor(self) -> float:
        return max(self.low, self.score[-1]) if len(self.score) == self.k else self.low

    def add(self, score: np.ndarray, ids: np.ndarray) -> None:
        ok = (score >= self.floor()) & (score <= self.high)
        if ok.any():
            score, ids = np.concatenate([self.score, score[ok]]), np.concatenate([self.id, ids[ok]])
            by = np.lexsort((ids, -score))[: self.k]
            self.score, self.id = score[by], ids[by]


class _Tree:
    """A tree of anchors with what has been found for them so far."""

    def __init__(self, row, wanted: dict[int, list[tuple[float, float]]], k: int, same: bool):
        self.dim, self.rows, self.ids, self.labels, self.vecs = row.dim, row.rows, row.ids, row.labels, row.vecs
        self.sequence, self.parent, self.length = row.sequence, row.parent, row.length
        self.k, self.same = k, same
        self.best = [[_Best(k, *w) for w in wanted.get(r, [])] for r in row.rows]
        self.points = None

    def ready(self) -> None:
        """Unpacks the anchors in the task; each of them serves the others as a first candidate."""
        if self.points is None:
            self.points = _matrix(self.vecs) if self.dim else np.zeros((len(self.rows), 0))
            self.last = {p: i for i, p in enumerate(self.parent[k] for k in self.sequence)}
            # Members are seen again with the candidates; a score is then not counted twice, see ``found``.
            self.floors = [_Floor(self.best[i]) for i in range(len(self.rows))]
            self.scan(np.array(self.ids), np.array(self.labels), self.points, self.floors)

    def scan(self, ids: np.ndarray, labels: np.ndarray, x: np.ndarray, into: list) -> None:
        """Scores of candidates with all anchors, as far as the bounds leave any of them open.

        A score with an anchor differs from that with its parent by at most the edge's length times the
        candidate's norm. Bounds are handed down the tree; a candidate is scored where they overlap a window.
        """
        norms = np.sqrt((x * x).sum(axis=1))
        most = np.abs(x).max(initial=0) * max((np.abs(self.points).max(initial=0)), 1.0) * max(1, self.dim)
        small = bool(most < EXACT)
        bounds: dict[int, tuple[np.ndarray, np.ndarray]] = {}
        for step, k in enumerate(self.sequence):
            p = self.parent[k]
            if p < 0:
                score = _exact(x, self.points[k], small)
                low, high = score.astype(np.float64), score.astype(np.float64)
                scored = np.arange(len(x))
            else:
                slack = norms * (self.length[k] * (1 + 1e-9)) + 1e-3
                low, high = bounds[p][0] - slack, bounds[p][1] + slack
                if self.last[p] == step:
                    del bounds[p]
                scored, score = np.empty(0, np.int64), np.empty(0, np.int64)
            if into[k]:
                floor, ceiling = min(b.floor() for b in into[k]), max(b.high for b in into[k])
                mine = (labels == self.labels[k]) == self.same
                wanted = mine & (ids != self.ids[k]) & ~((high < floor) | (low > ceiling))
                if p < 0:
                    at = np.flatnonzero(wanted)
                    for b in into[k]:
                        b.add(score[at], ids[at])
                else:
                    scored = np.flatnonzero(wanted)
                    if len(scored):
                        score = _exact(x[scored], self.points[k], small)
                        for b in into[k]:
                            b.add(score, ids[scored])
                        low[scored] = high[scored] = score
            if k in self.last:
                bounds[k] = (low, high)

    def found(self, ids: np.ndarray, labels: np.ndarray, x: np.ndarray) -> None:
        self.ready()
        self.scan(ids, labels, x, [[_Above(b, f) for b, f in zip(bs, fs)] for bs, fs in zip(self.best, self.floors)])

    def rows_found(self) -> Iterator[tuple]:
        for row, found in zip(self.rows, self.best, strict=True):
            for w, b in enumerate(found):
                for s, i in zip(b.score.tolist(), b.id.tolist(), strict=True):
                    yield row, w, i, s


def _Floor(best: list[_Best]) -> list[_Best]:
    return [_Best(b.k, b.low, b.high) for b in best]


class _Above:
    """A window that takes no score below the k-th best which the anchors of the tree already give."""

    def __init__(self, best: _Best, known: _Best):
        self.best, self.known, self.high = best, known, best.high

    def floor(self) -> float:
        return max(self.best.floor(), self.known.floor())

    def add(self, score: np.ndarray, ids: np.ndarray) -> None:
        ok = score >= self.known.floor()
        self.best.add(score[ok], ids[ok])


def _search(rows: DataFrame, trees: list, wanted: dict, k: int, same: bool) -> DataFrame:
    """(anchor, w, id, score): for every window of an anchor the ``k`` best of each task."""
    held = rows.sparkSession.sparkContext.broadcast((trees, wanted))

    def scan(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        known = [_Tree(t, held.value[1], k, same) for t in held.value[0]]
        for b in batches:
            dims = b.column("dim").to_numpy()
            for s in range(0, b.num_rows, CHUNK):
                part = b.slice(s, CHUNK)
                for dim in np.unique(dims[s : s + CHUNK]):
                    g = part.filter(pa.array(dims[s : s + CHUNK] == dim))
                    x = _matrix(g.column("vec").to_pylist()) if dim else np.zeros((g.num_rows, 0))
                    for t in known:
                        if t.dim == dim:
                            t.found(g.column("id").to_numpy(), g.column("label").to_numpy(), x)
        for t in known:
            out = list(t.rows_found())
            columns = [pa.array(c, pa.int64()) for c in zip(*out, strict=True)] if out else [pa.array([], pa.int64())] * 4
            yield pa.record_batch(columns, names=["anchor", "w", "id", "score"])

    found = rows.select("id", "label", "dim", "vec").mapInArrow(scan, "anchor bigint, w bigint, id bigint, score bigint")
    best = Window.partitionBy("anchor", "w").orderBy(F.col("score").desc(), "id")
    return found.withColumn("rank", F.row_number().over(best)).where(F.col("rank") <= k)


def mine(
    vectors: DataFrame,
    id_col: str = "vec_id",
    vector_col: str = "embedding",
    label_col: str = "label",
    every: int = ANCHORS,
    positives: int = POSITIVES,
    negatives: int = NEGATIVES,
    low: int = LOW,
    high: int = HIGH,
    tree: int = TREE,
    sent: int = SENT,
) -> DataFrame:
    """(anchor_id, positive_id, rank, negative_id, positive_score, negative_score).

    Anchors are the rows whose id ``every`` divides; a score is the inner product of vectors scaled by ``SCALE`` and
    rounded down. For each anchor and each of its ``positives`` best rows of the same label, the ``negatives`` best
    rows of other labels whose score lies between ``low`` and ``high`` percent of the positive's; ties go to the
    smaller id. Rows whose id ``MOVED`` divides first get the next of ``LABELS`` labels.

    Anchors are dealt to trees of ``tree`` anchors on average. All rows are scanned in chunks, twice: for positives and,
    their scores known, for negatives. In each task the bounds of ``_Tree.scan`` leave only candidates that may still
    enter a window to be scored. At most ``sent`` anchors (on average) are sent to the tasks at a time, so what is sent
    does not grow; more anchors mean more scans. Only the best of each window leave a task.

    Rows with a null id, label or vector, or a null or non-finite component, take no part. Vectors of other lengths are
    never compared. Rows alike in id, label and vector count once; other rows that share an id are rows of their
    own, but never partners of each other; a partner id that occurs more than once may be returned as often. Scores
    beyond a long stand at its ends. Other columns play no part.
    """
    spark = vectors.sparkSession
    rows = _prepared(vectors, id_col, vector_col, label_col)
    anchors = rows.where(F.col("id") % every == 0)
    n = anchors.count()
    groups = max(1, math.ceil(n / tree))
    trees = pin(_trees(anchors, groups))
    at_once = max(1, sent // tree)
    parts = []
    for s in range(0, groups, at_once):
        known = bounded_rows(trees.where((F.col("tree") >= s) & (F.col("tree") < s + at_once)), what="trees")
        if not known:
            continue
        every_score = {r: [(-math.inf, math.inf)] for t in known for r in t.rows}
        best = pin(_search(rows, known, every_score, positives, True).select("anchor", "id", "score"))
        # At most ``positives`` scores of each of the anchors just sent.
        scores: dict[int, set[int]] = {}
        for r in best.select("anchor", "score").toLocalIterator():
            scores.setdefault(r.anchor, set()).add(r.score)
        windows = {a: [(p, -((-low * p) // 100), high * p // 100) for p in sorted(ps)] for a, ps in scores.items()}
        windows = {a: [w for w in ws if w[1] <= w[2]] for a, ws in windows.items()}
        wanted = {a: [w[1:] for w in ws] for a, ws in windows.items() if ws}
        numbered = [(a, w, p[0]) for a, ws in windows.items() for w, p in enumerate(ws)]
        places = spark.createDataFrame(
            pa.table({c: pa.array([x[i] for x in numbered], pa.int64()) for i, c in enumerate(("anchor", "w", "score"))}),
            "anchor bigint, w bigint, score bigint",
        )
        ids = spark.createDataFrame(
            pa.table({"anchor": pa.array([r for t in known for r in t.rows], pa.int64()), "anchor_id": pa.array([i for t in known for i in t.ids], pa.int64())}),
            "anchor bigint, anchor_id bigint",
        )
        worse = _search(rows, known, wanted, negatives, False).withColumnsRenamed({"id": "negative_id", "score": "negative_score"})
        pairs = best.join(places, ["anchor", "score"]).join(ids, "anchor").withColumnsRenamed({"id": "positive_id", "score": "positive_score"})
        parts.append(
            pin(
                pairs.join(worse, ["anchor", "w"]).select(
                    "anchor_id", "positive_id", F.col("rank").cast("int").alias("rank"), "negative_id", "positive_score", "negative_score"
                )
            )
        )
    if not parts:
        return spark.createDataFrame(
            [], "anchor_id bigint, positive_id bigint, rank int, negative_id bigint, positive_score bigint, negative_score bigint"
        )
    return reduce(DataFrame.unionByName, parts)
