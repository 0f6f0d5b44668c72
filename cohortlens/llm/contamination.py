"""Benchmark decontamination by template windows.

Numbers, names and units of a text become typed placeholders, so that a question whose figures or
names were changed keeps its template. Windows of template tokens are looked up among those of the
benchmark; where they meet, the values in the placeholders are held against each other.
"""

from __future__ import annotations

import re
from array import array
from collections.abc import Iterator
from typing import NamedTuple

import numpy as np
import pyarrow as pa
import xxhash
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from cohortlens.llm.common import only, slices

#: Template tokens of a window; shorter items are one window.
WINDOW = 13
#: Tokens of a window that must not be placeholders.
LITERAL = 7
#: Tokens from which an item is a passage; a shorter one is found only in texts that hold nothing else.
LEAST = 3
#: Windows of the benchmark that a task holds at a time; more are looked up in turns over the documents.
TURN_WINDOWS = 1_000_000
#: Words a Python worker keeps.
KEPT_WORDS = 400_000

# Units of measure in their usual spellings.
UNITS = frozenset(
    """
    mm cm m km inch inches in ft foot feet yard yards mile miles mg g kg gram grams kilogram kilograms lb lbs pound
    pounds oz ounce ounces ton tons ml l liter liters litre litres gallon gallons s sec second seconds min minute
    minutes h hr hour hours day days week weeks month months year years dollar dollars cent cents euro euros percent
    degree degrees meter meters metre metres kilometer kilometers kilometre kilometres centimeter centimeters
    """.split()
)

_TOKEN = re.compile(r"\d+(?:[.,]\d+)*|[^\W\d_]+")
LITERAL_KIND, NUMBER, NAME, UNIT = 0, 1, 2, 3


def _hash(text: str) -> int:
    return xxhash.xxh64_intdigest(text.encode("utf-8", "surrogatepass"))


_PLACEHOLDER = {k: _hash(f"\0{k}") for k in (NUMBER, NAME, UNIT)}


class Template(NamedTuple):
    """By token: hash in the template, hash of the case-folded value, and kind; the same with names as words of no case."""

    shape: np.ndarray
    value: np.ndarray
    kind: np.ndarray
    folded_shape: np.ndarray
    folded_kind: np.ndarray


def _kind(token: str) -> int:
    if token[0].isdigit():
        return NUMBER
    if len(token) > 1 and token[0].isupper() and token[1:].islower():
        return NAME
    return UNIT if token.lower() in UNITS else LITERAL_KIND


def _folded_kind(token: str) -> int:
    return NUMBER if token[0].isdigit() else UNIT if token.casefold() in UNITS else LITERAL_KIND


class Reader:
    """Turns texts into templates; tokens are numbered, and what a chunk between white space gives is kept."""

    def __init__(self) -> None:
        self._clear()

    def _clear(self) -> None:
        self.chunks: dict[str, tuple[int, ...]] = {}
        self.tokens: dict[str, int] = {}
        self.columns = tuple(array("Q") for _ in Template._fields)

    def _token(self, token: str) -> int:
        n = self.tokens.get(token)
        if n is None:
            n = self.tokens[token] = len(self.tokens)
            kind, folded, value = _kind(token), _folded_kind(token), _hash(token.casefold())
            row = (_PLACEHOLDER.get(kind, value), value, kind, _PLACEHOLDER.get(folded, value), folded)
            for column, x in zip(self.columns, row, strict=True):
                column.append(x)
        return n

    def __call__(self, text: str | None) -> Template:
        if len(self.chunks) >= KEPT_WORDS:
            self._clear()
        chunks, rows = self.chunks, []
        for chunk in (text or "").split():
            got = chunks.get(chunk)
            if got is None:
                got = chunks[chunk] = tuple(self._token(t) for t in _TOKEN.findall(chunk))
            rows += got
        at = np.array(rows, np.int64)
        shape, value, kind, folded_shape, folded_kind = (np.frombuffer(c, np.uint64)[at] if rows else np.empty(0, np.uint64) for c in self.columns)
        return Template(shape, value, kind.astype(np.int64), folded_shape, folded_kind.astype(np.int64))


_BASE = 0x9E3779B97F4A7C15
_powers = (np.ones(1, np.uint64), np.ones(1, np.uint64))


def _powers_to(n: int) -> tuple[np.ndarray, np.ndarray]:
    """Powers of the base and of its inverse modulo 2**64, ``n`` at least."""
    global _powers
    if len(_powers[0]) < n:
        size = max(n, 1 << 12)
        bases = (_BASE, pow(_BASE, -1, 1 << 64))
        _powers = tuple(np.cumprod(np.concatenate((np.ones(1, np.uint64), np.full(size, x, np.uint64)))) for x in bases)
    return _powers


def _keys(shape: np.ndarray, start: np.ndarray, width: np.ndarray, salt: int) -> np.ndarray:
    """Hashes of the windows, polynomials of their tokens' hashes."""
    power, inverse = _powers_to(len(shape) + 1)
    total = np.concatenate((np.zeros(1, np.uint64), np.cumsum(shape * inverse[: len(shape)], dtype=np.uint64)))
    key = (total[start + width] - total[start]) * power[start + width - 1]
    key ^= key >> np.uint64(29)
    return (key + width.astype(np.uint64) + np.uint64(salt)) * np.uint64(0xBF58476D1CE4E5B9)


#: Sets of windows: typed placeholders; the same with names as words without case; values alone.
TYPED, FOLDED, EXACT = 0, 1, 2


class Windows(NamedTuple):
    start: np.ndarray
    width: np.ndarray
    mode: np.ndarray
    key: np.ndarray


def _windows(t: Template, window: int, literal: int) -> Windows:
    """Windows by which a text is found; a short text is one, and every start has one of its own values at least.

    A window with too few literal tokens is lengthened until it has ``literal`` of them. Where it has too few even with
    its names counted as words, it is taken by its values as well.
    """
    n = len(t.shape)
    parts = []
    width = min(window, n)
    if n:
        start = np.arange(n - width + 1)
        for mode, shape, kind in ((TYPED, t.shape, t.kind), (FOLDED, t.folded_shape, t.folded_kind)):
            plain = np.concatenate(([0], np.cumsum(kind == LITERAL_KIND)))
            size = np.full(len(start), width)
            poor = (plain[width:] - plain[:-width]) * window < literal * width
            ok = ~poor
            if width == window and poor.any():
                # the first place by which the window has enough
                end = np.searchsorted(plain, plain[start[poor]] + literal)
                size[poor] = end - start[poor]
                ok[poor] = end <= n
            parts.append((start[ok], size[ok], mode, _keys(shape, start[ok], size[ok], mode)))
        if poor.any():
            size = np.full(int(poor.sum()), width)
            parts.append((start[poor], size, EXACT, _keys(t.value, start[poor], size, EXACT)))
    join = lambda k, kind: np.concatenate([np.empty(0, kind), *(p[k] for p in parts)])
    mode = np.repeat(np.array([p[2] for p in parts], np.int64), [len(p[0]) for p in parts])
    return Windows(join(0, np.int64), join(1, np.int64), mode, join(3, np.uint64))


def _consistent(item: Template, doc: Template, at: int, to: int, size: int, mode: int) -> tuple[bool, bool]:
    """Whether the run's placeholders map one to one from item to document; whether values are equal."""
    a, b = item.value[at : at + size], doc.value[to : to + size]
    equal = bool(np.array_equal(a, b))
    if mode == EXACT:
        return equal, equal
    shapes, kinds = (item.shape, item.kind) if mode == TYPED else (item.folded_shape, item.folded_kind)
    other = doc.shape if mode == TYPED else doc.folded_shape
    if not np.array_equal(shapes[at : at + size], other[to : to + size]):
        return False, False
    there, back = {}, {}
    for x, y, k in zip(a.tolist(), b.tolist(), kinds[at : at + size].tolist(), strict=True):
        if k != LITERAL_KIND and (there.setdefault((k, x), y) != y or back.setdefault((k, y), x) != x):
            return False, False
    return True, equal


def _short(t: Template, width: int, window: int, literal: int) -> Windows:
    """Windows of the width of a short item, with literal tokens in proportion."""
    start = np.arange(len(t.shape) - width + 1)
    parts = []
    for mode, shape, kind in ((TYPED, t.shape, t.kind), (FOLDED, t.folded_shape, t.folded_kind)):
        plain = np.concatenate(([0], np.cumsum(kind == LITERAL_KIND)))
        poor = (plain[width:] - plain[:-width]) * window < literal * width
        parts.append((start[~poor], mode, shape))
    parts.append((start[poor], EXACT, t.value))
    keys = [_keys(shape, at, np.full(len(at), width), mode) for at, mode, shape in parts]
    at = np.concatenate([p[0] for p in parts])
    mode = np.repeat(np.array([p[1] for p in parts]), [len(p[0]) for p in parts])
    return Windows(at, np.full(len(at), width), mode, np.concatenate(keys))


class Found(NamedTuple):
    item: int
    windows: int
    share: float
    exact: bool


class Index:
    """Windows of some benchmark items, sorted by hash."""

    def __init__(self, items: list[tuple[int, str | None]], window: int, literal: int, least: int = LEAST):
        read = Reader()
        self.window, self.literal, self.least = window, literal, least
        self.ids = [i for i, _ in items]
        self.templates = [read(t) for _, t in items]
        parts = [_windows(t, window, literal) for t in self.templates]
        owner = np.repeat(np.arange(len(items)), [len(p.start) for p in parts])
        start, width, mode, key = (np.concatenate([np.empty(0, k), *c]) for c, k in zip(zip(*parts, strict=True), (np.int64, np.int64, np.int64, np.uint64), strict=False)) if parts else [np.empty(0, np.uint64)] * 4
        order = np.argsort(key, kind="stable")
        self.key, self.owner, self.start, self.width, self.mode = (c[order] for c in (key, owner, start, width, mode))
        self.count = [max(0, len(t.shape) - min(window, len(t.shape)) + 1) for t in self.templates]
        #: which leading bits occur, to pass over most windows of documents at once
        bits = min(26, max(16, len(key).bit_length() + 5))
        self.shift = np.uint64(64 - bits)
        self.there = np.zeros(1 << bits, bool)
        self.there[self.key >> self.shift] = True
        #: widths below the window that short items have
        self.short = sorted({len(t.shape) for t in self.templates if 0 < len(t.shape) < window})

    def search(self, doc: Template) -> list[Found]:
        hits: dict[tuple[int, int], dict[int, dict[int, int]]] = {}
        for width in [self.window, *self.short]:
            if len(doc.shape) < width or (width < self.least and len(doc.shape) > width) or not len(self.key):
                continue
            found = _windows(doc, self.window, self.literal) if width == self.window else _short(doc, width, self.window, self.literal)
            maybe = np.flatnonzero(self.there[found.key >> self.shift])
            low = np.searchsorted(self.key, found.key[maybe])
            some = self.key[np.minimum(low, len(self.key) - 1)] == found.key[maybe]
            for k, p in zip(maybe[some].tolist(), low[some].tolist(), strict=True):
                key, start, size, mode = found.key[k], int(found.start[k]), int(found.width[k]), int(found.mode[k])
                while p < len(self.key) and self.key[p] == key:
                    if self.mode[p] == mode and self.width[p] == size:
                        at = int(self.start[p])
                        hits.setdefault((int(self.owner[p]), start - at), {}).setdefault(mode, {})[at] = size
                    p += 1
        best: dict[int, tuple[set[int], bool]] = {}
        for (item, shift), modes in hits.items():
            done: set[int] = set()
            for mode in sorted(modes):
                sizes = {at: size for at, size in modes[mode].items() if at not in done}
                # neighbouring windows are judged as one passage; if that fails, each for itself
                runs: list[list[int]] = []
                for at in sorted(sizes):
                    if runs and at <= end:
                        runs[-1].append(at)
                        end = max(end, at + sizes[at])
                    else:
                        runs.append([at])
                        end = at + sizes[at]
                while runs:
                    run = runs.pop()
                    size = max(at + sizes[at] for at in run) - run[0]
                    ok, equal = _consistent(self.templates[item], doc, run[0], run[0] + shift, size, mode)
                    if ok:
                        seen, exact = best.get(item, (set(), False))
                        best[item] = (seen | set(run), exact or equal)
                        done |= set(run)
                    elif len(run) > 1:
                        runs += [[p] for p in run]
        return [Found(self.ids[i], len(w), len(w) / self.count[i], x) for i, (w, x) in sorted(best.items())]


def _turns(items: DataFrame, most: int) -> Iterator[list[tuple[int, str | None]]]:
    """Items in blocks of a bounded number of windows, read one partition after the other."""
    held: list[tuple[int, str | None]] = []
    size = 0
    for row in items.toLocalIterator():
        n = len((row["text"] or "").split())
        if held and size + n > most:
            yield held
            held, size = [], 0
        held.append((row["id"], row["text"]))
        size += n
    if held:
        yield held


def contaminated(
    docs: DataFrame,
    items: DataFrame,
    id_col: str = "doc_id",
    text_col: str = "text",
    item_id_col: str = "item_id",
    item_text_col: str = "text",
    window: int = WINDOW,
    literal: int = LITERAL,
    turn: int = TURN_WINDOWS,
    least: int = LEAST,
) -> DataFrame:
    """(id, item_id, windows, share, exact): what each document holds of each benchmark item.

    ``windows`` counts the item's template windows found in the document with consistent placeholders,
    ``share`` is their part of the item's windows, ``exact`` says that a passage has the same values.
    A document without a match has no row. Null and empty texts hold nothing; null ids stay null; repeated
    documents give repeated rows. A window needs ``literal`` of its ``window`` tokens outside placeholders (in
    proportion for items shorter than a window) and is lengthened until it has them. A second set of windows takes names as
    words without case, so that copies in other case are found; where those are too poor in words as well, the values
    themselves are looked up. So every item of ``least`` tokens or more is found where it
    is copied; one of fewer tokens is a word that any text may hold, and is found only in texts that hold nothing else. The benchmark goes to the tasks in blocks of at most ``turn`` words, one
    pass over the documents for each, so no table of unknown size is broadcast.
    """
    rows = only(docs, id=id_col, text=text_col).select(F.col("id").cast("bigint").alias("id"), "text")
    schema = "id bigint, item_id bigint, windows bigint, share double, exact boolean"
    out = None
    for block in _turns(only(items, id=item_id_col, text=item_text_col), turn):
        found = rows.mapInArrow(_searcher(block, window, literal, least), schema)
        out = found if out is None else out.unionByName(found)
    return docs.sparkSession.createDataFrame([], schema) if out is None else out


def _searcher(block: list[tuple[int, str | None]], window: int, literal: int, least: int):
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        index, read = Index(block, window, literal, least), Reader()
        for b in slices(batches, "text"):
            hits = []
            for i, t in zip(b.column("id").to_pylist(), b.column("text").to_pylist(), strict=True):
                hits += [(i, *f) for f in index.search(read(t))]
            columns = list(zip(*hits, strict=True)) or [[]] * 5
            types = (pa.int64(), pa.int64(), pa.int64(), pa.float64(), pa.bool_())
            yield pa.record_batch(
                [pa.array(list(c), k) for c, k in zip(columns, types, strict=True)],
                names=["id", "item_id", "windows", "share", "exact"],
            )

    return run


def keep_clean(docs: DataFrame, items: DataFrame, text_col: str = "text", item_id_col: str = "item_id", item_text_col: str = "text", window: int = WINDOW, literal: int = LITERAL, turn: int = TURN_WINDOWS, least: int = LEAST) -> DataFrame:
    """The rows of ``docs``, with all their columns, that hold no passage of a benchmark item (see ``contaminated``)."""
    out = docs
    for block in _turns(only(items, id=item_id_col, text=item_text_col), turn):

        def run(batches: Iterator[pa.RecordBatch], block=block) -> Iterator[pa.RecordBatch]:
            index, read = Index(block, window, literal, least), Reader()
            for b in slices(batches, text_col):
                yield b.filter(pa.array([not index.search(read(t)) for t in b.column(text_col).to_pylist()], pa.bool_()))

        out = out.mapInArrow(run, docs.schema)
    return out
