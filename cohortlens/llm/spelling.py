"""Spelling variants: words one edit apart, found by blocked products of letter counts."""

from __future__ import annotations

import re
from collections import Counter
from collections.abc import Iterator
from functools import reduce
from zlib import crc32

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from cohortlens.functions.bounded import lookup
from cohortlens.llm.common import only, slices, sorted_groups
from cohortlens.session import pin

#: Fewest code points of a word, and fewest occurrences.
LEAST_LENGTH = 7
LEAST_COUNT = 2
#: One in so many (document, run) pairs loses a letter.
DELETED = 31
#: A form occurs at least so many times as often as its variant.
RATIO = 10
#: Words of a block; blocks above it are divided further.
BLOCK = 4096
#: Letters of a block, for very long words.
LETTERS = 1 << 20
#: Rows of a block multiplied at a time.
ROWS = 512
#: Distinct words counted in a task before their counts are handed on.
HELD = 200_000


def count_words(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text", least: int = LEAST_LENGTH) -> DataFrame:
    """(word, n) over whole texts: runs of Latin letters with A-Z lowered, some of them with one letter less.

    Let h be the crc32 of ``<id>:<run>``; where ``DELETED`` divides it, the letter at ``h % length`` is left out. Only
    words of ``least`` letters or more are counted. A null text has no words; a null id reads as an empty string.
    """
    runs = re.compile("[A-Za-zÀ-ÿ]{%d,}" % least)

    def count(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        held: Counter[bytes] = Counter()

        def flush() -> pa.RecordBatch:
            words = pa.array([w.decode("latin-1") for w in held], pa.string())
            return pa.record_batch([words, pa.array(list(held.values()), pa.int64())], names=["word", "n"])

        for batch in (s for b in batches for s in slices(iter([b]), "text")):
            for key, text in zip(batch.column("id").to_pylist(), batch.column("text").to_pylist(), strict=True):
                if not text:
                    continue
                prefix = crc32(f"{key or ''}:".encode())
                for run, n in Counter(runs.findall(text)).items():
                    word = run.encode("latin-1").lower()
                    h = crc32(word if word.isascii() else word.decode("latin-1").encode(), prefix)
                    if h % DELETED == 0:
                        at = h % len(word)
                        word = word[:at] + word[at + 1 :]
                        if len(word) < least:
                            continue
                    held[word] += n
                if len(held) > HELD:
                    yield flush()
                    held.clear()
        if held:
            yield flush()

    rows = only(docs, id=id_col, text=text_col).select(F.col("id").cast("string").alias("id"), F.col("text").cast("string").alias("text"))
    return rows.mapInArrow(count, "word string, n bigint").groupBy("word").agg(F.sum("n").alias("n"))


def _keyed(rows: DataFrame, level: int) -> DataFrame:
    """Rows of (word, n, longer, cut) with the key of the block in which the word lies at that level.

    Lengths are paired: a block holds words of ``size`` letters and words one letter longer. ``size`` letters are
    divided in ``2 ** level`` stretches; a block's words agree in everything outside stretch ``cut``. Words one
    edit apart agree outside the stretch of the edit.
    """
    size = F.length("word") - F.col("longer")
    begin, end = F.shiftright(size * F.col("cut"), level), F.shiftright(size * (F.col("cut") + 1), level)
    placed = rows.withColumns({"size": size, "begin": begin, "end": end}).where("end > begin")
    left = F.expr("substring(word, 1, begin)")
    right = F.expr("substring(word, end + longer + 1)")
    return placed.withColumn("key", F.xxhash64(F.lit(level), "size", "cut", left, right))


def _blocks(words: DataFrame, least: int, block: int, letters: int) -> DataFrame:
    """(key, size, begin, end, longer, word, n): every word in all blocks where a partner may be.

    Blocks of more than ``block`` words, or ``letters`` letters, are divided: their stretch is halved until it is one
    letter, when no more words than letters of the alphabet (squared, for the longer ones) can agree outside it.
    """
    sides = words.withColumn("longer", F.explode(F.array(F.lit(0), F.lit(1)))).where(F.length("word") - F.col("longer") >= least)
    rows, level, done = sides.withColumn("cut", F.explode(F.array(F.lit(0), F.lit(1)))), 1, []
    while True:
        keyed = _keyed(rows, level)
        sizes = keyed.groupBy("key").agg(
            F.count("*").alias("members"), F.max("size").alias("size_"), F.max(F.col("end") - F.col("begin")).alias("stretch")
        )
        large = f"members > {block} OR (members > 2 AND members * size_ > {letters})"
        hot = pin(sizes.where(f"({large}) AND stretch > 1").select("key"))
        if hot.isEmpty():
            return reduce(DataFrame.unionByName, [*done, keyed])
        hot = lookup(hot)
        done.append(keyed.join(hot, "key", "left_anti"))
        open_ = pin(keyed.join(hot, "key", "left_semi").select("word", "n", "longer", "cut"))
        rows = open_.withColumn("cut", F.explode(F.array(F.col("cut") * 2, F.col("cut") * 2 + 1)))
        level += 1


def _letters(words: list[bytes]) -> np.ndarray:
    return np.frombuffer(b"".join(words), np.uint8).reshape(len(words), -1)


def _counts(letters: np.ndarray, alphabet: np.ndarray) -> np.ndarray:
    """Letter counts in a type in which all squared distances are exact."""
    at = np.searchsorted(alphabet, letters) + (np.arange(len(letters)) * len(alphabet))[:, None]
    counts = np.bincount(at.ravel(), minlength=len(letters) * len(alphabet)).reshape(len(letters), len(alphabet))
    return counts.astype(np.float32 if letters.shape[1] < 2000 else np.float64)


def _close(a: np.ndarray, b: np.ndarray, same: bool) -> Iterator[tuple[np.ndarray, np.ndarray]]:
    """Pairs of rows whose letter counts lie at a squared distance of one or two, by products of blocks."""
    aa, bb = np.einsum("ij,ij->i", a, a), np.einsum("ij,ij->i", b, b)
    for s in range(0, len(a), ROWS):
        for t in range(s if same else 0, len(b), 4 * ROWS):
            x, y = slice(s, s + ROWS), slice(t, t + 4 * ROWS)
            d = aa[x, None] + bb[None, y] - 2 * (a[x] @ b[y].T)
            i, j = np.nonzero((d > 0.5) & (d < 2.5))
            i, j = i + s, j + t
            yield (i[i < j], j[i < j]) if same else (i, j)


def _near(short: list[bytes], long: list[bytes], begin: int, end: int) -> tuple[np.ndarray, np.ndarray]:
    """Pairs (positions in ``short + long``) exactly one edit apart whose edit lies in the block's own stretch.

    The place of an edit is the length of the common beginning, so that each pair belongs to one block only.
    """
    if not short:
        return np.empty(0, np.int64), np.empty(0, np.int64)
    a = _letters(short)
    b = _letters(long) if long else np.empty((0, a.shape[1] + 1), np.uint8)
    size, n = a.shape[1], len(short)
    alphabet = np.unique(np.concatenate([a.ravel(), b.ravel()]))
    ca, cb = _counts(a, alphabet), _counts(b, alphabet)
    us, vs = [], []
    step = max(1, LETTERS // size)

    def parts(pairs):
        for i, j in pairs:
            for s in range(0, len(i), step):
                yield i[s : s + step], j[s : s + step]

    for i, j in parts(_close(ca, ca, True)):
        differ = a[i] != a[j]
        at = differ.argmax(axis=1)
        ok = (differ.sum(axis=1) == 1) & (at >= begin) & (at < end)
        us.append(i[ok])
        vs.append(j[ok])
    for i, j in parts(_close(ca, cb, False)):
        x, y = a[i], b[j]
        differ = x != y[:, :size]
        at = np.where(differ.any(axis=1), differ.argmax(axis=1), size)
        after = (x == y[:, 1:]) | (np.arange(size) < at[:, None])
        ok = after.all(axis=1) & (at >= begin) & ((at < end) | ((at == size) & (end == size)))
        us.append(i[ok])
        vs.append(j[ok] + n)
    return np.concatenate(us or [np.empty(0, np.int64)]), np.concatenate(vs or [np.empty(0, np.int64)])


def _link(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """Of every word of a block: how many near words the block holds for it, and the best of them."""
    for t in sorted_groups(batches, ["key"]):
        if t.num_rows < 2:
            continue
        sizes = t.column("size").to_numpy()
        for size in np.unique(sizes):  # one size but for colliding keys
            g = t.filter(pa.array(sizes == size))
            longer, counts = g.column("longer").to_numpy(), g.column("n").to_numpy()
            spans = np.unique(np.stack([g.column("begin").to_numpy(), g.column("end").to_numpy()], axis=1), axis=0)
            words = [w.encode("latin-1") for w in g.column("word").to_pylist()]
            order = np.argsort(longer, kind="stable")
            words, counts, cut = [words[k] for k in order], counts[order], int((longer == 0).sum())
            for begin, end in spans.tolist():
                u, v = _near(words[:cut], words[cut:], begin, end)
                if not len(u):
                    continue
                u, v = np.concatenate([u, v]), np.concatenate([v, u])
                rank = np.empty(len(words), np.int64)
                rank[sorted(range(len(words)), key=words.__getitem__)] = np.arange(len(words))
                by = np.lexsort((rank[v], -counts[v], u))
                u, v = u[by], v[by]
                who, first, near = np.unique(u, return_index=True, return_counts=True)
                best = v[first]
                yield pa.record_batch(
                    [
                        pa.array([words[k].decode("latin-1") for k in who], pa.string()),
                        pa.array(near, pa.int64()),
                        pa.array(counts[best], pa.int64()),
                        pa.array([words[k].decode("latin-1") for k in best], pa.string()),
                    ],
                    names=["word", "n_near", "best_n", "best"],
                )


def _roots(forms: DataFrame) -> DataFrame:
    """(word, root) for words that have a form: pointers are doubled until none has a successor.

    Counts rise tenfold with every step, so that the longest chain is short and has no circle.
    """
    to = pin(forms.select("word", F.col("form").alias("root")))
    while True:
        ahead = to.select(F.col("word").alias("root"), F.col("root").alias("next"))
        if to.join(ahead, "root", "left_semi").isEmpty():
            return to
        to = pin(to.join(ahead, "root", "left").select("word", F.coalesce("next", "root").alias("root")))


def group_variants(
    words: DataFrame, least: int = LEAST_LENGTH, ratio: int = RATIO, block: int = BLOCK, letters: int = LETTERS
) -> DataFrame:
    """(word, form, root, n, n_near, form_n) of a table of distinct (word, n); words have ``least`` Latin letters or more.

    Words are near if exactly one letter is put in, left out or replaced. Their letter counts then lie at a squared
    distance of one or two, in lengths that are equal or adjacent. Words meet in blocks by length and by all their
    letters but one stretch; products of count matrices give the distances within a block, and what is left is
    compared letter by letter. Blocks are divided until they are small, so no word's partners are capped. Only each
    word's number of near words and the best of them leave a block, never pairs.

    A word's form is its near word with the largest n (ties: smallest by code points) if that is at least ``ratio``
    times its own; ``root`` follows forms to the last. An empty table gives an empty result.
    """
    words = pin(words.select("word", "n"))
    blocks = _blocks(words, least, block, letters).select("key", "size", "begin", "end", "longer", "word", "n")
    found = blocks.repartition("key").sortWithinPartitions("key").mapInArrow(
        _link, "word string, n_near bigint, best_n bigint, best string"
    )
    best = found.groupBy("word").agg(
        F.sum("n_near").alias("n_near"), F.min(F.struct((-F.col("best_n")).alias("m"), "best")).alias("top")
    )
    is_form = -F.col("top.m") >= F.col("n") * ratio
    known = pin(
        words.join(best, "word", "left").select(
            "word",
            F.when(is_form, F.col("top.best")).alias("form"),
            "n",
            F.coalesce("n_near", F.lit(0)).alias("n_near"),
            F.when(is_form, -F.col("top.m")).alias("form_n"),
        )
    )
    roots = _roots(known.where("form is not null"))
    return known.join(roots, "word", "left").select(
        "word", "form", F.coalesce("root", "word").alias("root"), "n", "n_near", "form_n"
    )


def spelling_variants(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text", least_count: int = LEAST_COUNT, **sizes: int) -> DataFrame:
    """``group_variants`` of the words of whole texts that occur ``least_count`` times or more (see ``count_words``).

    Repeated rows count as often as they are there; other columns play no part.
    """
    return group_variants(count_words(docs, id_col, text_col).where(F.col("n") >= least_count), **sizes)
