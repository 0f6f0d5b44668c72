"""Boosted trees, plain and anchor-regularised, grown on histograms.

Features are cut into bins once and written as one byte each, thousands of rows to a block. A pass over the blocks sums
residuals, curvatures and rows by (node, feature, bin) within every task and adds them up by (node, feature), where the
best split is found too; only one row for each node comes back to the driver. Of two siblings the smaller one is summed,
the other is the parent less the first. A grown tree reads raw columns: as column expressions, or, where there are many
trees, in Arrow batches.
"""

from __future__ import annotations

import heapq
import math
from collections.abc import Iterator, Sequence
from dataclasses import dataclass, replace
from functools import cached_property

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T

from ..functions.bounded import MAX_LOOKUP_ROWS, bounded_rows
from ..functions.columns import logistic
from ..functions.joins import join_groups
from ..session import discard, pin

#: Bins of a feature; bin 0 holds the missing values.
MAX_BINS = 255
#: Rounds between two writes of the running score.
PIN_EVERY = 32
#: Trees up to which predictions are column expressions.
FEW_TREES = 24
#: Smallest share of either class that a start score stands for (fixed value).
LEAST_SHARE = 1e-6
#: Rows a leaf must hold (fixed value).
MIN_LEAF_ROWS = 20
#: Bytes of a row group of blocks, about: readers hold one at a time.
BLOCK_GROUP_BYTES = 16 << 20


@dataclass(frozen=True)
class Node:
    """Inner node (column, threshold, children) or leaf (number); missing values go left or right."""

    leaf: int | None = None
    column: str | None = None
    threshold: float = 0.0
    left: Node | None = None
    right: Node | None = None
    missing_left: bool = True


@dataclass(frozen=True)
class Tree:
    root: Node
    values: tuple[float, ...]


@dataclass(frozen=True)
class Boosted:
    """Start score and trees; leaf values already hold the learning rate."""

    init: float
    trees: tuple[Tree, ...]
    objective: str
    learning_rate: float


# Scoring


def _present(c: str) -> Column:
    """NaN and null are missing; negative zero is zero."""
    return F.nullif(F.col(f"`{c}`").cast("double"), F.lit(float("nan"))) + F.lit(0.0)


def _walk(node: Node, leaf) -> Column:
    if node.leaf is not None:
        return leaf(node.leaf)
    x = _present(node.column)
    left = F.coalesce(x <= F.lit(node.threshold), F.lit(node.missing_left))
    return F.when(left, _walk(node.left, leaf)).otherwise(_walk(node.right, leaf))


def _leaf_of(node: Node) -> Column:
    return _walk(node, F.lit)


def _value_of(tree: Tree) -> Column:
    return _walk(tree.root, lambda k: F.lit(tree.values[k]))


def _leaves(node: Node, x: dict[str, np.ndarray], rows: np.ndarray, out: np.ndarray) -> None:
    """Leaf numbers of ``rows`` into ``out``; a missing value is NaN."""
    if node.leaf is not None:
        out[rows] = node.leaf
        return
    v = x[node.column][rows]
    left = (v <= node.threshold) | (np.isnan(v) & node.missing_left)
    _leaves(node.left, x, rows[left], out)
    _leaves(node.right, x, rows[~left], out)


def _doubles(batch: pa.RecordBatch, columns: Sequence[str], names: Sequence[str] | None = None) -> dict[str, np.ndarray]:
    read = lambda c: batch.column(c).cast(pa.float64()).to_numpy(zero_copy_only=False) + 0.0
    return {c: read(n) for c, n in zip(columns, names or columns, strict=True)}


def predict(df: DataFrame, model: Boosted, rounds: Sequence[int] | None = None, out: str = "yhat") -> DataFrame:
    """Predictions, or one column per stage (``{out}_{k}``) from a single pass."""
    stages = [len(model.trees)] if rounds is None else sorted(set(rounds))
    names = [out] if rounds is None else [f"{out}_{k}" for k in stages]
    if max(stages, default=0) > FEW_TREES:
        return _predict_batches(df, model, stages, names)
    link = logistic if model.objective == "binary" else (lambda c: c)
    score, done, columns = F.lit(model.init), 0, {}
    for k, name in zip(stages, names, strict=True):
        for t in model.trees[done:k]:
            score = score + _value_of(t)
        columns[name], done = link(score), k
    return df.withColumns(columns)


def _predict_batches(df: DataFrame, model: Boosted, stages: Sequence[int], names: Sequence[str]) -> DataFrame:
    columns = sorted({c for t in model.trees for c in _columns(t.root)})
    given = [f"_x{i}_" for i in range(len(columns))]
    kept = [c for c in df.columns if c not in names]
    schema = T.StructType([*(df.schema[c] for c in kept), *(T.StructField(n, T.DoubleType()) for n in names)])

    def score(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in batches:
            x, total, leaf = _doubles(b, columns, given), np.full(b.num_rows, model.init), np.empty(b.num_rows, np.int64)
            every, stage, done = np.arange(b.num_rows), [], 0
            for k in stages:
                for t in model.trees[done:k]:
                    _leaves(t.root, x, every, leaf)
                    total = total + np.asarray(t.values)[leaf]
                stage.append(1 / (1 + np.exp(-total)) if model.objective == "binary" else total)
                done = k
            yield pa.RecordBatch.from_arrays([*(b.column(c) for c in kept), *map(pa.array, stage)], names=[*kept, *names])

    wide = df.select(*(f"`{c}`" for c in kept), *(_present(c).alias(g) for c, g in zip(columns, given, strict=True)))
    return wide.mapInArrow(score, schema)


# Bins


def _ordered(x: np.ndarray) -> np.ndarray:
    """Whole numbers in the order of the doubles."""
    bits = x.view(np.int64)
    return bits ^ ((bits >> 63) & np.int64(0x7FFF_FFFF_FFFF_FFFF))


def cut_points(df: DataFrame, features: Sequence[str], bins: int = MAX_BINS - 1) -> list[np.ndarray]:
    """Thresholds of every feature: between all distinct values where those are few, else such that no bin of more than
    one value holds more than one in ``bins`` of the rows.

    Values are counted by their leading bits; groups that hold too many rows, and more than one value, are counted again by
    further bits. Every row is counted, so that neither a sample nor the partitioning plays a part.
    """
    held = df.select(*(_present(c).alias(f"_x{i}_") for i, c in enumerate(features)))
    groups: list[dict[int, tuple[int, float, float]]] = [{} for _ in features]
    open_: dict[int, np.ndarray] = {i: np.array([0], np.int64) for i in range(len(features))}
    shift, total = 64, None
    while open_:
        above, shift = shift, shift - 16

        def count(batches: Iterator[pa.RecordBatch], open_=open_, above=above, shift=shift) -> Iterator[pa.RecordBatch]:
            names = ["f", "g", "n", "low", "high"]
            for b in batches:
                for i, wanted in open_.items():
                    x = b.column(f"_x{i}_").drop_null().to_numpy(zero_copy_only=False)
                    x = np.sort(x)
                    code = _ordered(x)
                    if above < 64:
                        ok = np.isin(code >> above, wanted)
                        x, code = x[ok], code[ok]
                    if not len(x):
                        continue
                    g, first, n = np.unique(code >> shift, return_index=True, return_counts=True)
                    columns = [pa.array(np.full(len(g), i, np.int32)), *map(pa.array, (g, n, x[first], x[first + n - 1]))]
                    yield pa.record_batch(columns, names=names)

        counted = held.mapInArrow(count, "f int, g bigint, n bigint, low double, high double")
        counted = counted.groupBy("f", "g").agg(F.sum("n").alias("n"), F.min("low").alias("low"), F.max("high").alias("high"))
        found = counted.toArrow()
        of = found.column("f").to_numpy()
        g, n, low, high = (found.column(c).to_numpy() for c in ("g", "n", "low", "high"))
        if total is None:
            total = np.bincount(of, weights=n, minlength=len(features))
        further = {}
        for i, wanted in open_.items():
            mine = of == i
            for k in wanted.tolist():
                groups[i].pop((above, k), None)
            groups[i] |= {(shift, k): v for k, *v in zip(g[mine].tolist(), n[mine].tolist(), low[mine].tolist(), high[mine].tolist(), strict=True)}
            # Few values in all are told apart one by one.
            large = 0 if len(groups[i]) <= bins else total[i] / bins
            again = mine & (low < high) & (n > large)
            if again.any() and shift > 0:
                further[i] = g[again]
        open_ = further
    return [_cuts(list(v.values()), bins) for v in groups]


def _cuts(groups: list, bins: int) -> np.ndarray:
    """Thresholds half-way between neighbouring groups, fewer where there are more than ``bins``."""
    groups = sorted(groups, key=lambda v: v[1])
    most = 1 if len(groups) <= bins else sum(n for n, *_ in groups) / bins
    cuts, held = [], 0
    for (n, _, high), (after, low, _) in zip(groups[:-1], groups[1:], strict=True):
        held += n
        if held + after > most:
            cut = high + (low - high) / 2
            cuts.append(cut if high <= cut < low else high)
            held = 0
    return np.array(cuts[: MAX_BINS - 1])


def _binned(df: DataFrame, features: Sequence[str], cuts: list[np.ndarray], more: dict[str, Column]) -> DataFrame:
    """Blocks of rows with (bins, *more): one byte for every feature."""
    given = df.select(*(_present(c).alias(f"_x{i}_") for i, c in enumerate(features)), *(v.alias(k) for k, v in more.items()))
    names, width = list(more), len(features)

    def pack(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in batches:
            if b.num_rows == 0:
                continue
            codes = np.zeros((b.num_rows, width), np.uint8)
            for i, cut in enumerate(cuts):
                x = b.column(f"_x{i}_").to_numpy(zero_copy_only=False)
                codes[:, i] = np.where(np.isnan(x), 0, np.searchsorted(cut, x, "left") + 1)
            yield _block({"bins": codes, **{k: b.column(k).to_numpy() for k in names}})

    return given.mapInArrow(pack, _block_schema(names))


# Blocks: rows of a table that hold many rows each, every column as the bytes of its values. Reading rows one by one
# would cost more than what is done with them.


def _block_schema(names: Sequence[str]) -> str:
    return ", ".join(f"{k} binary" for k in ["bins", *names])


def _block(columns: dict[str, np.ndarray]) -> pa.RecordBatch:
    kinds = {"bins": np.uint8, "g": np.int64}
    held = [np.ascontiguousarray(v, kinds.get(k, np.float64)).tobytes() for k, v in columns.items()]
    return pa.record_batch([pa.array([v], pa.binary()) for v in held], names=list(columns))


def _blocks(batches: Iterator[pa.RecordBatch]) -> Iterator[dict[str, np.ndarray]]:
    for b in batches:
        for i in range(b.num_rows):
            held = {k: b.column(k)[i].as_buffer() for k in b.schema.names}
            block = {k: np.frombuffer(v, np.int64 if k == "g" else np.float64) for k, v in held.items() if k != "bins"}
            yield {"bins": np.frombuffer(held["bins"], np.uint8).reshape(len(block["y"]), -1), **block}


def _pin_blocks(df: DataFrame) -> DataFrame:
    return pin(df, **{"parquet.block.size": str(BLOCK_GROUP_BYTES)})


def _with_means(data: DataFrame, means: DataFrame) -> DataFrame:
    """The blocks with the mean ``p`` of every row's group, joined row by row."""
    names = [k for k in data.columns if k not in ("bins", "p")]

    def rows(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in _blocks(batches):
            bins = pa.array([v.tobytes() for v in b["bins"]], pa.binary())
            yield pa.record_batch([bins, *(pa.array(b[k]) for k in names)], names=["bins", *names])

    def pack(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in batches:
            if b.num_rows:
                bins = np.frombuffer(b"".join(b.column("bins").to_pylist()), np.uint8)
                yield _block({"bins": bins, **{k: b.column(k).to_numpy() for k in [*names, "p"]}})

    kinds = ", ".join(f"{k} {'bigint' if k == 'g' else 'double'}" for k in names)
    joined = data.mapInArrow(rows, f"bins binary, {kinds}").join(means, "g").select("bins", *names, "p")
    return joined.mapInArrow(pack, _block_schema([*names, "p"]))


# Growing


@dataclass
class _Grown:
    """A node while its tree grows: sums, rows, depth, and its best split once that is known."""

    g: float
    h: float
    n: int
    depth: int
    split: tuple | None = None
    known: bool = False
    children: tuple[int, int] = ()


@dataclass(frozen=True)
class _Bits:
    """A tree over bins: inner nodes (feature, bin, missing left, left, right), leaves by number."""

    nodes: dict[int, tuple[int, int, bool, int, int]]
    leaf: dict[int, int]
    values: tuple[float, ...] = ()

    @cached_property
    def _steps(self) -> tuple[int, np.ndarray, np.ndarray]:
        """Depth, feature by node, and the next node by (node, bin); a node without children stays."""
        size = max([0, *(c for v in self.nodes.values() for c in v[3:])]) + 1
        feature, after, bins = np.zeros(size, np.int64), np.repeat(np.arange(size), 256).reshape(size, 256), np.arange(256)
        for k, (f, cut, missing_left, left, right) in self.nodes.items():
            feature[k] = f
            after[k] = np.where((bins <= cut) & (bins > 0) | (bins == 0) & missing_left, left, right)
        depth, level = 0, [0]
        while level := [c for k in level if k in self.nodes for c in self.nodes[k][3:]]:
            depth += 1
        return depth, feature, after.ravel()

    def place(self, codes: np.ndarray) -> np.ndarray:
        """The node without children that each row reaches."""
        depth, feature, after = self._steps
        flat, first = codes.ravel(), np.arange(len(codes)) * codes.shape[1]
        at = np.zeros(len(codes), np.int64)
        for _ in range(depth):
            at = after.take((at << 8) + flat.take(first + feature.take(at)))
        return at

    def add(self, codes: np.ndarray, score: np.ndarray) -> np.ndarray:
        by = np.zeros(max(self.leaf) + 1)
        by[list(self.leaf)] = [self.values[k] for k in self.leaf.values()]
        return score + by[self.place(codes)]


def _residual(objective: str, y: np.ndarray, score: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    if objective == "binary":
        p = 1 / (1 + np.exp(-score))
        return y - p, p * (1 - p)
    return y - score, np.ones(len(y))


class _Work:
    """The binned table and what changes in a round; sent to the tasks as it is."""

    def __init__(self, objective: str, gamma: float, bins: list[int]):
        self.objective, self.gamma, self.bins = objective, gamma, bins
        self.pending: list[_Bits] = []
        self.means: np.ndarray | None = None

    def rows(self, b: dict[str, np.ndarray]) -> tuple[np.ndarray, ...]:
        """(codes, target, curvature, weight) of a block, trees not yet written into the score included."""
        codes, score, y, w = (b[c] for c in ("bins", "score", "y", "w"))
        for t in self.pending:
            score = t.add(codes, score)
        r, h = _residual(self.objective, y, score)
        if self.gamma != 1.0:
            p = b["p"] if self.means is None else self.means[b["g"]]
            r = r + (self.gamma - 1.0) * p
        return codes, r, h, w


def _best_split(hist: np.ndarray, l2: float, min_rows: int) -> tuple | None:
    """(gain, bin, missing left, sums of the left, sums of the right) of one node and feature.

    ``hist`` has rows g, h, n by bin. Of equal gains the lowest bin, missing values to the left.
    """
    total = hist.sum(axis=1, keepdims=True)
    inner = np.cumsum(hist[:, 1:], axis=1)
    best = None
    for missing_left in (True, False):
        left = inner + hist[:, :1] * missing_left
        right = total - left
        ok = (left[2] >= min_rows) & (right[2] >= min_rows)
        if not ok.any():
            continue
        with np.errstate(divide="ignore", invalid="ignore"):
            gain = left[0] ** 2 / (left[1] + l2) + right[0] ** 2 / (right[1] + l2) - total[0] ** 2 / (total[1] + l2)
        gain = np.where(ok & np.isfinite(gain), gain, -np.inf)
        k = int(np.argmax(gain))
        key = (float(gain[k]), -k, missing_left)
        if np.isfinite(gain[k]) and (best is None or key > best[0]):
            best = (key, (float(gain[k]), k + 1, missing_left, *left[:, k].tolist(), *right[:, k].tolist()))
    return best and best[1]


_SPLIT = "gain double, bin int, missing_left boolean, gl double, hl double, nl double, gr double, hr double, nr double"


class _Grower:
    """Grows one tree, best split first, on as few passes as the order of splits allows."""

    def __init__(self, data: DataFrame, work: _Work, depth: int, leaves: int, min_gain: float, l2: float, min_rows: int):
        self.data, self.work = data, work
        self.depth, self.leaves, self.min_gain, self.l2, self.min_rows = depth, leaves, min_gain, l2, min_rows
        self.nodes: dict[int, _Grown] = {}
        self.tables: list[tuple[set[int], DataFrame]] = []

    def _chosen(self) -> tuple[set[int], set[int]]:
        """Splits that the best-first order takes by what is known, and their children not yet looked into."""
        heap, taken, unknown = [], set(), set()

        def offer(k: int) -> None:
            node = self.nodes[k]
            if node.n < 2 * self.min_rows or node.depth >= self.depth:
                return
            if not node.known:
                unknown.add(k)
            elif node.split is not None and node.split[1] > self.min_gain:
                heapq.heappush(heap, (-node.split[1], k))

        offer(0)
        while heap and len(taken) < self.leaves - 1:
            k = heapq.heappop(heap)[1]
            taken.add(k)
            for child in self._children(k):
                offer(child)
        return taken, unknown

    def _children(self, k: int) -> tuple[int, int]:
        node = self.nodes[k]
        if not node.children:
            _, _, _, _, gl, hl, nl, gr, hr, nr = node.split
            node.children = len(self.nodes), len(self.nodes) + 1
            for child, sums in zip(node.children, ((gl, hl, nl), (gr, hr, nr)), strict=True):
                self.nodes[child] = _Grown(sums[0], sums[1], int(sums[2]), node.depth + 1)
        return node.children

    def _bits(self, splits: set[int]) -> _Bits:
        nodes = {k: (*self.nodes[k].split[:1], *self.nodes[k].split[2:4], *self.nodes[k].children) for k in splits}
        ends = sorted({0, *(c for v in nodes.values() for c in v[3:])} - set(nodes))
        return _Bits(nodes, {k: i for i, k in enumerate(ends)})

    def grow(self) -> _Bits:
        self.nodes[0] = _Grown(0.0, 0.0, 1 << 62, 0)
        while True:
            taken, unknown = self._chosen()
            if not unknown:
                break
            self._look(self._bits({k for k in self.nodes if self.nodes[k].children}), unknown)
        for _, table in self.tables:
            table.unpersist()
        return self._bits(taken)

    def _look(self, bits: _Bits, unknown: set[int]) -> None:
        """Histograms and best splits of ``unknown``: one pass over the data."""
        parents = {c: k for k, v in self.nodes.items() if v.children for c in v.children}
        sums: dict[int, tuple[int, ...]] = {}  # the node that is summed, and the sibling that is the rest
        for k in sorted(unknown):
            if k == 0:
                sums[0] = (0,)
                continue
            pair = self.nodes[parents[k]].children
            small = min(pair, key=lambda c: (self.nodes[c].n, c))
            sums[small] = (small, *(c for c in pair if c != small))
        slots = {k: i for i, k in enumerate(sums)}
        work, l2, min_rows, width = self.work, self.l2, self.min_rows, max(self.work.bins)
        n_features = len(work.bins)

        def add_up(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
            total = np.zeros((3, len(slots) * n_features * width))
            lookup = np.full(max([*slots, *bits.leaf, 0]) + 1, -1)
            lookup[list(slots)] = list(slots.values())
            for b in _blocks(batches):
                codes, r, h, w = work.rows(b)
                slot = lookup[bits.place(codes)]
                own = np.flatnonzero(slot >= 0)
                codes, first, r, h = codes[own], slot[own] * (n_features * width), (w * r)[own], (w * h)[own]
                plain = bool((h == 1.0).all())  # then curvatures sum to the rows
                for f in range(n_features):
                    at = first + f * width + codes[:, f]
                    n = np.bincount(at, minlength=total.shape[1])
                    total[0] += np.bincount(at, r, total.shape[1])
                    total[1] += n if plain else np.bincount(at, h, total.shape[1])
                    total[2] += n
            total = total.reshape(3, len(slots), n_features, width)
            there = np.argwhere(total[2].sum(axis=2) > 0)
            hist = [np.ascontiguousarray(total[:, s, f]).tobytes() for s, f in there]
            columns = [pa.array(there[:, 0], pa.int32()), pa.array(there[:, 1], pa.int32()), pa.array(hist, pa.binary()), pa.array([False] * len(hist))]
            yield pa.record_batch(columns, names=["slot", "f", "hist", "whole"])

        nodes = list(sums.values())

        def split(t: pa.Table) -> pa.Table:
            own, whole = np.zeros((3, width)), None
            for x, is_whole in zip(t.column("hist").to_pylist(), t.column("whole").to_pylist(), strict=True):
                h = np.frombuffer(x).reshape(3, width)
                if is_whole:
                    whole = h
                else:
                    own = own + h
            slot, f = t.column("slot")[0].as_py(), t.column("f")[0].as_py()
            out = []
            for k, h in zip(nodes[slot], (own, own if whole is None else whole - own), strict=False):
                h = np.where(h[2] > 0, h, 0.0)
                best = _best_split(h[:, : work.bins[f]], l2, min_rows)
                out.append((k, f, h.tobytes(), *h.sum(axis=1).tolist(), *(best or [None] * 9)))
            types = [pa.int32(), pa.int32(), pa.binary(), *[pa.float64()] * 4, pa.int32(), pa.bool_(), *[pa.float64()] * 6]
            names = ["node", "f", "hist", "g", "h", "n", *(c.split()[0] for c in _SPLIT.split(", "))]
            return pa.table([pa.array(c, t) for c, t in zip(zip(*out, strict=True), types, strict=True)], names=names)

        parts = self.data.mapInArrow(add_up, "slot int, f int, hist binary, whole boolean")
        for held, table in self.tables:
            wanted = {parents[k]: i for k, i in slots.items() if k and parents[k] in held}
            if wanted:
                slot = F.element_at(F.create_map(*(F.lit(v) for kv in wanted.items() for v in kv)), F.col("node"))
                whole = table.where(F.col("node").isin(*wanted)).select(slot.cast("int").alias("slot"), "f", "hist", F.lit(True).alias("whole"))
                parts = parts.unionByName(whole)
        schema = f"node int, f int, hist binary, g double, h double, n double, {_SPLIT}"
        # Kept until the tree has grown; where an executor is lost, summed again from the binned table.
        table = parts.groupBy("slot", "f").applyInArrow(split, schema).persist()
        self.tables.append(({k for pair in nodes for k in pair}, table))
        names = [c.split()[0] for c in _SPLIT.split(", ")]
        best = F.struct("gain", (-F.col("f")).alias("f"), *names[1:])
        found = table.groupBy("node").agg(
            F.max(F.when(F.col("gain").isNotNull(), best)).alias("s"), F.max(F.struct("n", "g", "h")).alias("sums")
        )
        for pair in nodes:
            for k in pair:
                self.nodes[k].known = True
        for row in found.collect():  # one row a node
            node, s = self.nodes[row["node"]], row["s"]
            if s is not None:
                node.split = (-s["f"], s["gain"], *(s[c] for c in names[1:]))
            if row["node"] == 0:
                node.g, node.h, node.n = row["sums"]["g"], row["sums"]["h"], int(row["sums"]["n"])


def _init(df: DataFrame, y: str, objective: str) -> float:
    mean = float(df.agg(F.avg(F.col(y).cast("double"))).first()[0])
    if objective == "binary":
        away = 1 - LEAST_SHARE if mean > 0.5 else LEAST_SHARE
        p = mean if LEAST_SHARE < mean < 1 - LEAST_SHARE else away
        return math.log(p / (1 - p))
    return mean


def _coded_groups(df: DataFrame, group: Sequence[str]) -> tuple[DataFrame, int]:
    """``df`` with a number ``_g`` for its anchor group; null keys are groups like any other."""
    groups = pin(df.select(*group).distinct().withColumn("_g", F.monotonically_increasing_id()))
    n = groups.count()
    if n <= MAX_LOOKUP_ROWS:
        dense = {r["_g"]: i for i, r in enumerate(sorted(bounded_rows(groups.select("_g")), key=lambda r: r["_g"]))}
        numbers = F.create_map(*(F.lit(v) for kv in dense.items() for v in kv))
        groups = F.broadcast(groups.withColumn("_g", F.element_at(numbers, F.col("_g")).cast("bigint")))
    return join_groups(df, groups, group), n


def fit_anchor_boosting(
    df: DataFrame,
    features: Sequence[str],
    y: str,
    rounds: int,
    gamma: float = 1.0,
    group: Sequence[str] = (),
    depth: int = 3,
    learning_rate: float = 0.1,
    objective: str = "regression",
    min_gain: float = 0.0,
    weight: str | None = None,
    leaves: int | None = None,
    l2: float = 0.0,
    bins: int = MAX_BINS - 1,
) -> Boosted:
    """Boosting on |(I - P) r|^2 + gamma |P r|^2, P the (weighted) mean within anchor groups.

    Each tree is grown on r + (gamma - 1) P r; gamma 1 is plain boosting. Leaves are split best first while there are fewer
    than ``leaves`` (2 ** ``depth`` by default) and the gain G^2/(H + l2) of the halves over the whole exceeds
    ``min_gain``; a leaf holds ``MIN_LEAF_ROWS`` rows or more. Missing values go to the side that gains more. Row weights
    count in sums, not in the start score or the least rows. Of equal gains the first feature and the lowest threshold win.
    """
    df = df.select(*dict.fromkeys([*features, *group, y, *([weight] if weight else [])])).persist()
    init = _init(df, y, objective)
    cuts = cut_points(df, features, min(bins, MAX_BINS - 1))
    w = F.lit(1.0) if weight is None else F.col(weight).cast("double")
    more = {"y": F.col(y).cast("double"), "w": w, "score": F.lit(init)}
    coded, n_groups = df, 0
    if gamma != 1.0:
        coded, n_groups = _coded_groups(df, group)
        more["g"] = F.col("_g")
    work = _Work(objective, gamma, [len(c) + 2 for c in cuts])
    data = _pin_blocks(_binned(coded, features, cuts, more))
    df.unpersist()
    trees: list[Tree] = []
    for i in range(rounds):
        target, data_now = work, data
        if gamma != 1.0:
            means = _group_means(data, work, n_groups)
            if n_groups <= MAX_LOOKUP_ROWS:
                work.means = np.zeros(n_groups)
                for r in bounded_rows(means):
                    work.means[r["g"]] = r["p"]
            else:
                # Too many groups to send: the means are joined, once for all passes of the round.
                data_now = _pin_blocks(_with_means(data, means))
                work.means = None
        grower = _Grower(data_now, target, depth, leaves or 2**depth, min_gain, l2, MIN_LEAF_ROWS)
        grown = grower.grow()
        ends = [grower.nodes[k] for k in grown.leaf]
        values = tuple(learning_rate * (e.g / (e.h + l2) if e.h + l2 else 0.0) for e in ends)
        grown = replace(grown, values=values)
        trees.append(Tree(_unbinned(grown, 0, features, cuts), values))
        work.pending.append(grown)
        if data_now is not data:
            discard(data_now)
        if len(work.pending) == PIN_EVERY and i + 1 < rounds:
            data, old = _pin_blocks(_advanced(data, work.pending)), data
            discard(old)
            work.pending = []
    discard(data)
    return Boosted(init, tuple(trees), objective, learning_rate)


def _group_means(data: DataFrame, work: _Work, n_groups: int) -> DataFrame:
    """(g, p): weighted means of the residuals in the anchor groups."""
    plain = _Work(work.objective, 1.0, work.bins)
    plain.pending = work.pending

    def told(g: np.ndarray, sums: np.ndarray) -> pa.RecordBatch:
        return pa.record_batch([pa.array(g), *map(pa.array, sums)], names=["g", "r", "w"])

    def add_up(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        few = n_groups <= MAX_LOOKUP_ROWS  # then numbered without gaps
        total = np.zeros((2, n_groups if few else 0))
        for b in _blocks(batches):
            _, r, _, w = plain.rows(b)
            if few:
                total += [np.bincount(b["g"], v, n_groups) for v in (w * r, w)]
                continue
            g, at = np.unique(b["g"], return_inverse=True)
            yield told(g, np.array([np.bincount(at, v) for v in (w * r, w)]))
        if few:
            yield told(np.arange(n_groups), total)

    sums = data.mapInArrow(add_up, "g bigint, r double, w double").groupBy("g").agg(F.sum("r").alias("r"), F.sum("w").alias("w"))
    return sums.select("g", F.when(F.col("w") != 0, F.col("r") / F.col("w")).otherwise(0.0).alias("p"))


def _advanced(data: DataFrame, pending: list[_Bits]) -> DataFrame:
    """The blocks with the trees so far in their score."""

    def step(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in _blocks(batches):
            for t in pending:
                b["score"] = t.add(b["bins"], b["score"])
            yield _block(b)

    return data.mapInArrow(step, data.schema)


def _unbinned(grown: _Bits, k: int, features: Sequence[str], cuts: list[np.ndarray]) -> Node:
    if k not in grown.nodes:
        return Node(leaf=grown.leaf[k])
    f, cut, missing_left, left, right = grown.nodes[k]
    threshold = float(cuts[f][cut - 1]) if cut <= len(cuts[f]) else float("inf")
    sides = (_unbinned(grown, c, features, cuts) for c in (left, right))
    return Node(None, features[f], threshold, *sides, missing_left)


def fit_gbt(
    df: DataFrame,
    features: Sequence[str],
    y: str,
    rounds: int,
    depth: int = 3,
    learning_rate: float = 0.1,
    objective: str = "regression",
    **options,
) -> Boosted:
    """Plain boosting; ``options`` as in ``fit_anchor_boosting``."""
    return fit_anchor_boosting(
        df, features, y, rounds, depth=depth, learning_rate=learning_rate, objective=objective, **options
    )


def refit_leaves(model: Boosted, df: DataFrame, y: str, decay: float, weight: str | None = None) -> Boosted:
    """Move leaf values towards new data: decay * old + (1 - decay) * new step.

    Tree by tree, at the score the refitted trees before it give; the structure stays. The leaf of every row in every tree
    is found once and written, one or two bytes a tree; each tree is then one sum by leaf.
    """
    if decay >= 1 or not model.trees:
        return model
    columns = sorted({c for t in model.trees for c in _columns(t.root)})
    given = [f"_x{i}_" for i in range(len(columns))]
    wide = df.select(
        *(_present(c).alias(g) for c, g in zip(columns, given, strict=True)),
        F.col(y).cast("double").alias("y"),
        (F.lit(1.0) if weight is None else F.col(weight).cast("double")).alias("w"),
    )
    trees, init, objective = model.trees, model.init, model.objective
    kind = np.uint8 if max(len(t.values) for t in trees) < 256 else np.uint16

    def place(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in batches:
            x, every = _doubles(b, columns, given), np.arange(b.num_rows)
            leaves, leaf = np.empty((b.num_rows, len(trees)), kind), np.empty(b.num_rows, np.int64)
            for i, t in enumerate(trees):
                _leaves(t.root, x, every, leaf)
                leaves[:, i] = leaf
            packed = pa.array([row.tobytes() for row in leaves], pa.binary())
            yield pa.record_batch([packed, b.column("y"), b.column("w"), pa.array(np.full(b.num_rows, init))], names=["leaves", "y", "w", "score"])

    schema = "leaves binary, y double, w double, score double"
    data, start, refitted = pin(wide.mapInArrow(place, schema)), 0, []

    def scored(b: pa.RecordBatch, since: int, values: list[tuple[float, ...]]) -> tuple[np.ndarray, np.ndarray]:
        leaves = np.frombuffer(b"".join(b.column("leaves").to_pylist()), kind).reshape(b.num_rows, -1)
        score = b.column("score").to_numpy()
        for k, v in enumerate(values, since):
            score = score + np.asarray(v)[leaves[:, k]]
        return leaves, score

    for i, t in enumerate(trees):
        since, values = start, [r.values for r in refitted[start:]]

        def add_up(batches: Iterator[pa.RecordBatch], i=i, n=len(t.values), since=since, values=values) -> Iterator[pa.RecordBatch]:
            total = np.zeros((2, n))
            for b in batches:
                leaves, score = scored(b, since, values)
                r, h = _residual(objective, b.column("y").to_numpy(), score)
                w = b.column("w").to_numpy()
                for k, v in enumerate((w * r, w * h)):
                    total[k] += np.bincount(leaves[:, i], weights=v, minlength=n)
            yield pa.record_batch([pa.array(np.arange(n)), *map(pa.array, total)], names=["leaf", "r", "h"])

        sums = data.mapInArrow(add_up, "leaf bigint, r double, h double").groupBy("leaf").agg(F.sum("r").alias("r"), F.sum("h").alias("h"))
        steps = {row["leaf"]: row["r"] / row["h"] for row in sums.collect() if row["h"]}  # one row a leaf
        new = (decay * old + (1 - decay) * model.learning_rate * steps.get(k, 0.0) for k, old in enumerate(t.values))
        refitted.append(replace(t, values=tuple(new)))
        if len(refitted) - start == PIN_EVERY and i + 1 < len(trees):
            since, values = start, [r.values for r in refitted[start:]]

            def step(batches: Iterator[pa.RecordBatch], since=since, values=values) -> Iterator[pa.RecordBatch]:
                for b in batches:
                    yield b.set_column(3, "score", pa.array(scored(b, since, values)[1]))

            data, old = pin(data.mapInArrow(step, schema)), data
            discard(old)
            start = len(refitted)
    discard(data)
    return replace(model, trees=tuple(refitted))


def _columns(node: Node) -> set[str]:
    if node.leaf is not None:
        return set()
    return {node.column} | _columns(node.left) | _columns(node.right)
