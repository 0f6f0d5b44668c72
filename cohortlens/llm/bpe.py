"""BPE encoding and decoding by tree concatenation of the parts of a text."""

from __future__ import annotations

import re
from collections.abc import Iterator
from functools import lru_cache
from typing import NamedTuple

import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from tokenizers import Tokenizer

from cohortlens.llm.common import only, slices, sorted_groups

#: Characters of a leaf of the tree.
LEAF = 4096
#: Characters of a piece that is encoded as a row of its own.
PIECE = 1 << 16
#: Words kept in a worker's memory, in each of two generations.
KEPT_WORDS = 250_000
#: Longer words are cut into the units that the vocabulary's own splitting gives, and are not kept.
LONG_WORD = 256
#: Characters of white space that separate words for every tokenizer used here.
SPACE = re.compile("[ \t\n\r\f]+")


class Unit(NamedTuple):
    """A part of a text that is encoded on its own, with its tokens."""

    text: str
    glued: bool  # no white space before it
    n: int  # tokens
    shown: str  # decimal ids joined by one space
    decoded: str  # the tokens as decode() joins them


UNIT = pa.struct(
    {"text": pa.string(), "glued": pa.bool_(), "n": pa.int64(), "shown": pa.string(), "decoded": pa.string()}
)


class Encoder:
    """Encodes with a tokenizer file of the tokenizers library; texts of any length in memory of their size.

    A leaf is split at white space; each word is encoded by the library and kept. A text without
    white space is split at the places where the library starts a new pre-token. Both are units: the
    library encodes a unit the same way whatever follows the next one.
    """

    def __init__(self, path: str, leaf: int = LEAF):
        self.tokenizer = Tokenizer.from_file(path)
        self.tokenizer.no_truncation()
        self.tokenizer.no_padding()
        self.leaf = max(1, leaf)
        self.new: dict[str, Unit] = {}
        self.old: dict[str, Unit] = {}
        added = self.tokenizer.get_added_tokens_decoder().values()
        self.longest = max((len(t.content) for t in added), default=0)

    def _make(self, text: str, glued: bool, ids: list[int], tokens: list[str]) -> Unit:
        return Unit(text, glued, len(ids), " ".join(map(str, ids)), " ".join(tokens))

    def _word(self, word: str, glued: bool) -> list[Unit]:
        """Units of text without ASCII white space."""
        if len(word) <= LONG_WORD and not glued:
            unit = self.new.get(word)
            if unit is None:
                unit = self.old.get(word)
                if unit is None:
                    e = self.tokenizer.encode(word, add_special_tokens=False)
                    unit = self._make(word, False, e.ids, e.tokens)
                if len(self.new) >= KEPT_WORDS:
                    self.old, self.new = self.new, {}
                self.new[word] = unit
            return [unit]
        e = self.tokenizer.encode(word, add_special_tokens=False)
        ids, tokens, owner, spans = e.ids, e.tokens, e.word_ids, e.offsets
        starts = [k for k in range(len(ids)) if k == 0 or owner[k] != owner[k - 1] or owner[k] is None]
        # pre-tokens whose characters overlap after normalisation stay together
        starts = [k for k in starts if k == 0 or spans[k][0] >= spans[k - 1][1]]
        if not starts:
            return [self._make(word, glued, [], [])]
        cuts = [*starts, len(ids)]
        places = [0, *(spans[k][0] for k in starts[1:]), len(word)]
        return [
            self._make(word[places[n] : places[n + 1]], glued or n > 0, ids[s:t], tokens[s:t])
            for n, (s, t) in enumerate(zip(cuts[:-1], cuts[1:], strict=True))
        ]

    def units(self, text: str, glued: bool = False) -> list[Unit]:
        out: list[Unit] = []
        new = self.new
        for n, word in enumerate(SPACE.split(text)):
            if word:
                unit = new.get(word) if n or not glued else None
                if unit is not None:
                    out.append(unit)
                else:
                    out += self._word(word, glued and n == 0)
                    new = self.new
        return out

    def join(self, left: list[Unit], right: list[Unit]) -> list[Unit]:
        """Units of the text of ``left`` followed by that of ``right``.

        Encodes a window around the join anew, twice as wide each time, until its first unit is what
        ``left`` has there and its last unit what ``right`` has, or until it covers both.
        """
        if not left or not right:
            return left + right
        width = 2
        while True:
            a, b = left[-width:], right[:width]
            middle = self.units("".join(u.text if u.glued else " " + u.text for u in [a[0]._replace(glued=True), *a[1:], *b]), a[0].glued)
            whole_left, whole_right = width >= len(left), width >= len(right)
            # an added token over the join may not reach beyond the window
            wide_left, wide_right = (sum(len(u.text) for u in x) >= self.longest for x in (a, b))
            same_left = whole_left or (wide_left and len(middle) > 1 and _same(middle[0], a[0]))
            same_right = whole_right or (wide_right and len(middle) > 1 and _same(middle[-1], b[-1]))
            if same_left and same_right:
                return left[: len(left) - len(a)] + middle + right[len(b) :]
            width *= 2

    def tree(self, text: str, glued: bool = False) -> list[Unit]:
        """Units of a whole text: halves down to leaves, then joined upwards."""
        if len(text) <= self.leaf:
            return self.units(text, glued)
        half = len(text) // 2
        # only a white space character before the cut makes the right half's first word a word of its own
        return self.join(self.tree(text[:half], glued), self.tree(text[half:], not SPACE.match(text[half - 1])))

    def encode(self, text: str | None) -> list[int]:
        return [int(i) for u in self.tree(text or "") if u.n for i in u.shown.split(" ")]

    def decode(self, ids: list[int]) -> str:
        return self.tokenizer.decode(ids, skip_special_tokens=False)


def _same(x: Unit, y: Unit) -> bool:
    return x.text == y.text and x.shown == y.shown


@lru_cache(maxsize=2)
def encoder(path: str) -> Encoder:
    """One encoder for each Python worker, so that words stay known from task to task."""
    return Encoder(path)


#: Columns that encode_decode can return beside the id.
OUTPUTS = {
    "ids": ("array<int>", pa.list_(pa.int32()), lambda us: [int(i) for u in us if u.n for i in u.shown.split(" ")]),
    "n_tokens": ("bigint", pa.int64(), lambda us: sum([u.n for u in us])),
    "shown": ("string", pa.string(), lambda us: " ".join([u.shown for u in us if u.n])),
    "decoded": ("string", pa.string(), lambda us: " ".join([u.decoded for u in us if u.n])),
}


def encode_decode(
    docs: DataFrame,
    path: str,
    id_col: str = "doc_id",
    text_col: str = "text",
    outputs: tuple[str, ...] = tuple(OUTPUTS),
    piece: int = PIECE,
) -> DataFrame:
    """(id, *outputs) for every row of ``docs``.

    ``ids`` are the token ids of the whole text as one array, ``shown`` the same in decimal with one space
    between, ``decoded`` their decoding. A null text counts as empty and gives no tokens. Texts longer than
    ``piece`` characters are cut into pieces that are encoded as rows of their own, in parallel, and joined by
    a tree in one task for each text; others are one piece and need no shuffle. Null ids and repeated rows are
    kept as they are; other columns are ignored; an empty table gives an empty result. ``path`` is a
    tokenizer file that every executor can read.
    """
    schema = "id bigint, " + ", ".join(f"{c} {OUTPUTS[c][0]}" for c in outputs)
    rows = only(docs, id=id_col, text=text_col).select("id", F.coalesce("text", F.lit("")).alias("text"))

    def result(ids: list[int | None], units: list[list[Unit]]) -> pa.RecordBatch:
        columns = [pa.array([OUTPUTS[c][2](us) for us in units], OUTPUTS[c][1]) for c in outputs]
        return pa.record_batch([pa.array(ids, pa.int64()), *columns], names=["id", *outputs])

    def whole(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        enc = encoder(path)
        for b in slices(batches, "text", 1 << 20):
            yield result(b.column("id").to_pylist(), [enc.tree(t) for t in b.column("text").to_pylist()])

    def encode_piece(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        enc = encoder(path)
        for b in slices(batches, "text", 1 << 20):
            for k, (text, glued) in enumerate(zip(b.column("text").to_pylist(), b.column("glued").to_pylist(), strict=True)):
                units = pa.array([u._asdict() for u in enc.tree(text, glued)], UNIT)
                one = pa.ListArray.from_arrays([0, len(units)], units)
                yield pa.record_batch([*(b.column(c).slice(k, 1) for c in key), one], names=[*key, "units"])

    def join_pieces(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        enc = encoder(path)
        for t in sorted_groups(batches, ["hash", "row"]):
            level = [[Unit(**u) for u in us] for us in t.column("units").to_pylist()]
            while len(level) > 1:
                level = [enc.join(*level[k : k + 2]) if k + 1 < len(level) else level[k] for k in range(0, len(level), 2)]
            yield result(t.column("id")[:1].to_pylist(), level)

    key = ["hash", "row", "no", "id"]
    short = rows.where(F.length("text") <= piece).mapInArrow(whole, schema)
    long = rows.where(F.length("text") > piece).select(
        "id", "text", F.xxhash64("text").alias("hash"), F.monotonically_increasing_id().alias("row")
    )
    starts = F.posexplode(F.sequence(F.lit(1), F.length("text"), F.lit(piece))).alias("no", "at")
    cut = long.select("id", "hash", "row", "text", starts).select(
        *key,
        F.substring("text", F.col("at"), F.lit(piece)).alias("text"),
        ((F.col("at") > 1) & ~F.substring("text", F.col("at") - 1, F.lit(1)).isin(*" \t\n\r\f")).alias("glued"),
    )
    pieces = cut.repartition("hash", "row", "no").mapInArrow(
        encode_piece,
        "hash bigint, row bigint, no int, id bigint, "
        "units array<struct<text: string, glued: boolean, n: bigint, shown: string, decoded: string>>",
    )
    order = pieces.repartition("hash", "row").sortWithinPartitions("hash", "row", "no")
    return short.unionByName(order.mapInArrow(join_pieces, schema))
