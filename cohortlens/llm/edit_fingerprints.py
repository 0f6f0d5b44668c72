"""Document fingerprints: samples of random walks over the characters, shared by all texts."""

from __future__ import annotations

import hashlib
import math
from collections.abc import Iterator
from functools import cache, reduce

import numpy as np
import pyarrow as pa
from pyspark import TaskContext
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from cohortlens.functions.bounded import bounded_rows, local_table, lookup
from cohortlens.llm.common import fresh, merge_labels, only, slices, sorted_groups
from cohortlens.llm.components import components
from cohortlens.session import pin

SEED = 12_041
#: Steps after which the walk's coins repeat, and classes of characters that have coins of their own.
PERIOD = 1024
CLASSES = 64
SHIFT = 64 - 6
#: Samples of an octave: the first one has as many steps, each further one twice the steps of the one before.
SAMPLES = 48
OCTAVES = 44
#: Characters walked at a time.
PIECE = 1 << 16
#: Bytes of text in a sorted partition, up to ``PARTS`` of them; then more.
PART_BYTES = 8 << 20
PARTS = 10_000
#: Likeness from which documents are near, and samples of an octave two unrelated texts share.
NEAR = 0.8
CHANCE = 0.15
#: Fingerprints of a band that are compared with each other; larger bands are divided.
BAND = 1024
#: Further digits by which large bands are divided, time after time; together the whole octave.
FURTHER = (8, 16, 24)
#: Fingerprints of a large band that a task holds at a time.
TILE = 4096


class Walk:
    """Walks over characters: at every step a coin, which depends on the step and on the character stood upon, says
    whether to go on to the next character. Equal coins bring the walks over two texts together again after an edit, so
    that the steps at which they stand on different characters bound the edits from both sides."""

    def __init__(self) -> None:
        rng = np.random.default_rng(SEED)
        coins = rng.random((CLASSES, PERIOD)) < 0.5
        coins[:, ::64] = True  # no character holds a walk for longer
        twice = np.concatenate([coins, coins], axis=1)
        after = np.where(twice, np.arange(2 * PERIOD), 4 * PERIOD)
        after = np.minimum.accumulate(after[:, ::-1], axis=1)[:, ::-1][:, :PERIOD] + 1
        one = list(range(PERIOD))  # one object for each number keeps the table small
        self.leave = [one[t] for t in (after % PERIOD).ravel().tolist()]
        octave = np.repeat(np.arange(OCTAVES), SAMPLES)
        wide = (1 << octave).astype(np.int64)
        inside = (rng.random(len(wide)) * wide).astype(np.int64)
        self.steps = SAMPLES * (wide - 1) + np.tile(np.arange(SAMPLES), OCTAVES) * wide + inside
        self.salt = rng.integers(1, 1 << 62, len(wide)).astype(np.uint64)
        self.weight = np.ldexp(1.0, octave)

    def go(self, text: str, state: tuple[int, int, bytes] = (0, 0, b"")) -> tuple[int, int, bytes]:
        """(step, step within the period, samples so far) after the characters of ``text``."""
        step, t, taken = state[0], state[1], [state[2]]
        leave = self.leave
        for s in range(0, len(text), PIECE):
            codes = np.frombuffer(text[s : s + PIECE].encode("utf-32-le", "surrogatepass"), np.uint32).astype(np.uint64)
            rows = ((codes * np.uint64(0x9E3779B97F4A7C15)) >> np.uint64(SHIFT)).astype(np.int64) * PERIOD
            first = t
            times = np.array([t := leave[r + t] for r in rows.tolist()], np.int64)
            stay = times.copy()
            stay[0] -= first
            stay[1:] -= times[:-1]
            stay[stay <= 0] += PERIOD
            ends = np.cumsum(stay, out=stay)
            ends += step
            a, z = np.searchsorted(self.steps, [step, ends[-1]])
            if z > a:
                at = codes[np.searchsorted(ends, self.steps[a:z], "right")]
                mixed = (at + np.uint64(1)) * self.salt[a:z]
                mixed ^= mixed >> np.uint64(32)
                mixed *= np.uint64(0xD6E8FEB86659FD93)
                taken.append((mixed >> np.uint64(60)).astype(np.uint8).tobytes())
            step = int(ends[-1])
        return step, t, b"".join(taken)

    def likeness(self, a: bytes, b: bytes) -> float:
        """Share of steps, as sampled, at which both walks stand on the same character; 1 for two empty texts."""
        n, most = sorted((len(a), len(b)))
        if most == 0:
            return 1.0
        same = np.frombuffer(a[:n], np.uint8) == np.frombuffer(b[:n], np.uint8)
        return float((self.weight[:n] * same).sum() / self.weight[:most].sum())


@cache
def _walk() -> Walk:
    """One walk for all tasks of a Python worker."""
    return Walk()


def _shown(taken: bytes) -> str:
    return taken.hex()[1::2]


#: What tasks tell of a document; samples are packed two to a byte, with their number.
OUT = (
    "id bigint, n_chars bigint, edited_sha256 binary, own binary, n_own int, edited binary, n_edited int, "
    "near_edited double, near_next double"
)


def _packed(taken: bytes) -> bytes:
    v = np.frombuffer(taken + bytes(len(taken) % 2), np.uint8)
    return (v[::2] << 4 | v[1::2]).tobytes()


def _pair(walk: Walk, text: str, own: tuple, half: tuple, follow: str, fresh: bytes) -> tuple:
    """What is told of a document, the text that follows it and that one's samples."""
    n = len(text)
    moved = n // 2
    edited = text[: n - moved] + follow[:moved]
    changed = walk.go(follow[:moved], half)[2]
    digest = hashlib.sha256(edited.encode("utf-8", "surrogatepass")).digest()
    shown = _packed(own[2]), len(own[2]), _packed(changed), len(changed)
    return n, digest, *shown, walk.likeness(own[2], changed), walk.likeness(own[2], fresh)


def _walked(walk: Walk, text: str) -> tuple[tuple, tuple]:
    """The states after the half that an edit leaves, and after the whole text."""
    half = walk.go(text[: len(text) - len(text) // 2])
    return walk.go(text[len(text) - len(text) // 2 :], half), half


def _told(rows: list[tuple], part: int | None = None, edge: str | None = None, text: str | None = None) -> pa.RecordBatch:
    types = {"bigint": pa.int64(), "int": pa.int32(), "binary": pa.binary(), "double": pa.float64()}
    names, kinds = zip(*(c.split() for c in OUT.split(", ")), strict=True)
    columns = [pa.array(c, types[k]) for c, k in zip(zip(*rows, strict=True), kinds, strict=True)]
    n = len(rows)
    more = [pa.array([part] * n, pa.int32()), pa.array([edge] * n, pa.string()), pa.array([text] * n, pa.string())]
    return pa.record_batch([*columns, *more], names=[*names, "part", "edge", "text"])


def fingerprints(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text", part_bytes: int = PART_BYTES) -> DataFrame:
    """(id, n_chars, edited_sha256, fingerprint, edited_fingerprint, near_edited, near_next) of every row.

    A text's edited twin has its last ``n_chars // 2`` characters replaced by the first as many (or all) of the next row
    in descending order of ids (after the last: the first). Fingerprints are the characters, as hex digits, at
    sampled steps of the text's walk (see ``Walk``): ``SAMPLES`` steps in every octave of steps that the walk
    reaches, so that they grow with the logarithm of the text. ``near_edited`` and ``near_next`` estimate the
    share of steps that two walks have in common.

    Rows are sorted over ranges of ids; each partition tells of all its rows but the last, whose follower is the first
    row of a later partition: only those two rows of each partition are joined afterwards. A walk is continued from
    the middle for the edited text, so each text is walked one and a half times.

    A null text counts as empty; the fingerprint of an empty text is empty and like another empty one. Null ids come
    last. Rows that share an id follow each other in the order of a hash of their texts. A single row follows itself.
    """
    rows = only(docs, id=id_col, text=text_col).select(
        F.col("id").cast("bigint").alias("id"), F.coalesce(F.col("text").cast("string"), F.lit("")).alias("text")
    )
    rows = rows.withColumn("hash", F.xxhash64("text"))
    size = rows.agg(F.sum(F.octet_length("text").cast("bigint")).alias("b"), F.count("*").alias("n")).first()
    total = (size["b"] or 0) + size["n"]
    parts = max(1, min(math.ceil(total / part_bytes), max(PARTS, math.ceil(total / (32 * part_bytes)))))
    order = [F.col("id").desc_nulls_last(), "hash"]

    def pack(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        """Texts travel compressed."""
        codec = pa.Codec("zstd", compression_level=3)
        for batch in (s for b in batches for s in slices(iter([b]), "text")):
            texts = [t.encode("utf-8", "surrogatepass") for t in batch.column("text").to_pylist()]
            small = pa.array([codec.compress(t, asbytes=True) for t in texts], pa.binary())
            sizes = pa.array([len(t) for t in texts], pa.int64())
            yield pa.record_batch([batch.column("id"), batch.column("hash"), sizes, small], names=["id", "hash", "size", "small"])

    def tell(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        walk, part, last, out = _walk(), TaskContext.get().partitionId(), None, []
        codec, blank = pa.Codec("zstd"), [None] * OUT.count(",")
        for batch in (s for b in batches for s in slices(iter([b]), "small")):
            for key, size, small in zip(*(batch.column(c).to_pylist() for c in ("id", "size", "small")), strict=True):
                text = codec.decompress(small, size, asbytes=True).decode("utf-8", "surrogatepass")
                own, half = _walked(walk, text)
                if last is None:
                    yield _told([(key, *blank)], part, "first", text)
                else:
                    out.append((last[0], *_pair(walk, *last[1:], text, own[2])))
                last = (key, text, own, half)
            if out:
                yield _told(out)
                out = []
        if last is not None:
            yield _told([(last[0], *blank)], part, "last", last[1])

    packed = rows.mapInArrow(pack, "id bigint, hash bigint, size bigint, small binary")
    spread = packed.repartitionByRange(parts, *order).sortWithinPartitions(*order)
    found = pin(spread.mapInArrow(tell, f"{OUT}, part int, edge string, text string"))
    done = found.where("part is null").drop("part", "edge", "text")

    used = sorted(r["part"] for r in bounded_rows(found.where("edge = 'first'").select("part"), 1_000_000, "partitions"))
    follows = [{"part": a, "then": b} for a, b in zip(used, [*used[1:], *used[:1]], strict=True)]
    firsts = found.where("edge = 'first'").select(F.col("part").alias("then"), F.col("text").alias("follow"))
    ends = found.where("edge = 'last'").select("id", "text", "part").join(local_table(docs.sparkSession, follows, "part int, then int"), "part")

    def close(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        walk = _walk()
        for batch in batches:
            for key, text, follow in zip(*(batch.column(c).to_pylist() for c in ("id", "text", "follow")), strict=True):
                own, half = _walked(walk, text)
                told = _told([(key, *_pair(walk, text, own, half, follow, _walked(walk, follow)[0][2]))])
                yield told.select([c.split()[0] for c in OUT.split(", ")])

    closed = ends.join(firsts, "then").select("id", "text", "follow").mapInArrow(close, OUT)
    hex_ = lambda c, n: F.lower(F.substring(F.hex(c), F.lit(1), F.col(n)))
    return done.unionByName(closed).select(
        "id",
        "n_chars",
        F.lower(F.hex("edited_sha256")).alias("edited_sha256"),
        hex_("own", "n_own").alias("fingerprint"),
        hex_("edited", "n_edited").alias("edited_fingerprint"),
        "near_edited",
        "near_next",
    )


def _bands(n: int) -> tuple[int, int]:
    """Samples of a band, so many that unrelated texts seldom agree in all, and bands of an octave, so many that seven
    in ten of the texts at ``NEAR`` share one."""
    width = max(6, math.ceil(math.log(max(2, n)) / -math.log(CHANCE)))
    return width, math.ceil(math.log(0.3) / math.log(1 - NEAR**width))


def _band_rows(batches: Iterator[pa.RecordBatch], width: int, bands: int) -> Iterator[pa.RecordBatch]:
    """Rows (band, key) for the last two octaves that a fingerprint fills (or its beginning, if it fills none)."""
    rng = np.random.default_rng([SEED, 1])
    picks = [np.sort(rng.permutation(SAMPLES)[:width]) for _ in range(bands)]
    for b in batches:
        cls, band, key = [], [], []
        for c, fp in zip(b.column("cls").to_pylist(), b.column("fingerprint").to_pylist(), strict=True):
            full = len(fp) // SAMPLES
            for k in range(max(0, full - 2), max(1, full)):
                part = fp[k * SAMPLES : (k + 1) * SAMPLES].ljust(SAMPLES, ".")
                for i, pick in enumerate(picks):
                    cls.append(c)
                    band.append(k * bands + i)
                    key.append("".join([part[j] for j in pick]))
        yield pa.record_batch([pa.array(cls, pa.int64()), pa.array(band, pa.int32()), pa.array(key, pa.string())], names=["cls", "band", "key"])


def near_copies(found: DataFrame, id_col: str = "id", fingerprint_col: str = "fingerprint", near: float = NEAR, band: int = BAND) -> DataFrame:
    """``found`` with ``component``: documents whose fingerprints are ``near`` alike, united, named by the smallest id.

    Equal fingerprints are one class. Classes that agree in a band of sampled digits of one of their last two octaves
    are compared by the likeness of their whole fingerprints. Bands are chosen so that seven in ten of the classes at
    ``near`` share one in a given octave; they are a search by chance, whose recall the tests measure. Bands of the
    same members are compared once. In a band of more than ``band`` classes each is compared with the smallest class;
    then the band is divided by ``FURTHER`` digits, until it is small or its classes agree in its whole octave. What this
    leaves apart is made up for: of each large band the classes that are not united yet are compared all with all, in
    tiles that a task can hold. A band of one component takes no comparison, one of unrelated classes as many as it has pairs.

    Rows with a null fingerprint are alone. A null id is never the smallest of its component. Other columns are kept,
    but for one named ``component``, which is replaced.
    """
    known = only(found, id=id_col, fingerprint=fingerprint_col).where("fingerprint is not null")
    key = F.unhex(F.md5(F.col("fingerprint")))
    known = known.groupBy(key.alias("key")).agg(F.min("id").alias("least"), F.count("*").alias("copies"), F.min("fingerprint").alias("fingerprint"))
    known = pin(known.withColumn("cls", F.monotonically_increasing_id()))
    width, bands = _bands(known.count())
    keyed = known.select("cls", "fingerprint").mapInArrow(lambda b: _band_rows(b, width, bands), "cls bigint, band int, key string")
    octave = F.floor(F.col("band") / bands).cast("int")
    keyed = pin(keyed.select("cls", octave.alias("octave"), "band", F.xxhash64("band", "key").alias("key")))

    parts, heads, whole = [], [], None
    part = F.expr(f"rpad(substring(fingerprint, octave * {SAMPLES} + 1, {SAMPLES}), {SAMPLES}, '.')")
    for depth, more in enumerate((*FURTHER, 0)):
        members = F.sum(F.xxhash64("cls").cast("decimal(38,0)")).alias("who")
        sizes = keyed.groupBy("key").agg(F.count("*").alias("members"), members, F.min("cls").alias("head"))
        sizes = pin(sizes.where("members > 1"))
        large = sizes.where(F.col("members") > band).select("key", "head")
        once = sizes.where(F.col("members") <= band).groupBy("members", "who").agg(F.min("key").alias("key"))
        parts.append(keyed.join(once.select("key"), "key", "left_semi").select("cls", "key"))
        if large.isEmpty():
            break
        hot = pin(keyed.join(lookup(large), "key"))
        if not depth:
            whole = hot.select("cls", "key")
        heads.append(hot.where("cls <> head").select(F.col("cls").alias("a"), F.col("head").alias("b")))
        if not more:
            break
        # Each band takes its further digits from a place of its own on.
        first = F.pmod(F.xxhash64("band") + sum(FURTHER[:depth]), F.lit(SAMPLES)).cast("int") + 1
        hot = hot.join(known.select("cls", "fingerprint"), "cls").withColumn("part", part)
        keyed = pin(hot.select("cls", "octave", "band", F.xxhash64("key", F.substring(F.repeat("part", F.lit(2)), first, F.lit(more))).alias("key")))

    fps = known.select("cls", "fingerprint")
    small = reduce(DataFrame.unionByName, parts).join(fps, "cls")

    def compare(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        walk = _walk()
        for t in sorted_groups(batches, ["key"]):
            a, b = _alike(walk, t.column("fingerprint").to_pylist(), near)
            cls = t.column("cls").to_numpy()
            labels = merge_labels(np.arange(len(cls)), a, b)
            own = np.flatnonzero(labels != np.arange(len(cls)))
            if len(own):
                yield pa.record_batch([pa.array(cls[own]), pa.array(cls[labels[own]])], names=["a", "b"])

    def verify(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        walk = _walk()
        for t in batches:
            ok = [walk.likeness(_digits(x), _digits(y)) >= near for x, y in zip(t.column("x").to_pylist(), t.column("y").to_pylist(), strict=True)]
            yield t.select(["a", "b"]).filter(pa.array(ok, pa.bool_()))

    links = small.repartition("key").sortWithinPartitions("key", "cls").select("key", "cls", "fingerprint").mapInArrow(compare, "a bigint, b bigint")
    if heads:
        pairs = reduce(DataFrame.unionByName, heads).distinct()
        pairs = pairs.join(fps.withColumnsRenamed({"cls": "a", "fingerprint": "x"}), "a").join(fps.withColumnsRenamed({"cls": "b", "fingerprint": "y"}), "b")
        links = links.unionByName(pairs.select("a", "b", "x", "y").mapInArrow(verify, "a bigint, b bigint"))
    links = pin(links)
    united = pin(components(links))
    if whole is not None and not (apart := _apart(whole, united, fps, near)).isEmpty():
        united = _merged(united, apart)
    least = united.join(known.select(F.col("cls").alias("node"), "least"), "node").groupBy("component").agg(F.min("least").alias("smallest"))
    placed = known.join(united.join(least, "component").select(F.col("node").alias("cls"), "smallest"), "cls", "left")
    component = F.when(F.col("smallest").isNull(), F.col("least")).otherwise(F.col("smallest"))
    shown, united_as = fresh(found, "shown"), fresh(found, "united_as")
    # Only classes of more than one document say something new.
    placed = placed.where("copies > 1 OR smallest is not null").select(F.col("key").alias(shown), component.alias(united_as))
    own = F.when(F.col(shown).isNull(), F.col(f"`{id_col}`")).otherwise(F.col(united_as))
    joined = found.join(placed, F.unhex(F.md5(F.col(f"`{fingerprint_col}`"))) == F.col(shown), "left")
    return joined.withColumn("component", own).drop(shown, united_as)


def _merged(united: DataFrame, links: DataFrame) -> DataFrame:
    """Components (node, component) once ``links`` (a, b) between classes of ``united`` or others join them."""
    ends = links
    for end in ("a", "b"):
        ends = ends.join(united.select(F.col("node").alias(end), F.col("component").alias(f"{end}_of")), end, "left")
    joined = components(ends.select(*(F.coalesce(f"{end}_of", end).alias(end) for end in ("a", "b"))))
    nodes = united.unionByName(joined.select("node", F.col("node").alias("component"))).distinct()
    nodes = nodes.join(joined.select(F.col("node").alias("component"), F.col("component").alias("further")), "component", "left")
    return nodes.select("node", F.coalesce("further", "component").alias("component"))


def _apart(whole: DataFrame, united: DataFrame, fps: DataFrame, near: float, tile: int = TILE) -> DataFrame:
    """Links (a, b) between classes of a band (``whole``: cls, key) that ``united`` (node, component) leaves apart.

    A band is dealt into blocks of about ``tile`` classes. Every two blocks meet in a tile, where classes of different
    components are compared; bands of one component, and bands of the same members but one, take no part.
    """
    label = F.coalesce("component", "cls").alias("label")
    placed = pin(whole.join(united, F.col("cls") == F.col("node"), "left").select("cls", "key", label))
    members = F.sum(F.xxhash64("cls").cast("decimal(38,0)")).alias("who")
    bands = placed.groupBy("key").agg(F.count("*").alias("members"), members, F.min("label").alias("least"), F.max("label").alias("most"))
    bands = bands.where("least < most").groupBy("members", "who").agg(F.min("key").alias("key"))
    blocks = F.ceil(F.col("members") / tile).cast("int")
    dealt = placed.join(bands.select("key", blocks.alias("blocks")), "key")
    dealt = dealt.withColumn("own", F.pmod(F.xxhash64("cls"), F.col("blocks").cast("bigint")).cast("int"))
    others = F.filter(F.sequence(F.lit(0), F.col("blocks") - 1), lambda o: (o != F.col("own")) | (F.col("blocks") == 1))
    dealt = dealt.withColumn("other", F.explode(others))
    tiles = dealt.select("cls", "label", F.xxhash64("key", F.least("own", "other"), F.greatest("own", "other")).alias("tile")).join(fps, "cls")

    def compare(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        walk = _walk()
        for t in sorted_groups(batches, ["tile"]):
            cls, labels = t.column("cls").to_numpy(), t.column("label").to_numpy()
            # The largest component last: its members need not be gone through.
            kinds, kind, sizes = np.unique(labels, return_inverse=True, return_counts=True)
            order = np.lexsort((kind, sizes[kind]))
            kind = kind[order]
            after = np.append(np.flatnonzero(kind[1:] != kind[:-1]) + 1, len(kind))
            after = after[np.searchsorted(after, np.arange(len(kind)), side="right")]
            a, b = _alike(walk, t.column("fingerprint").take(pa.array(order)).to_pylist(), near, after)
            if len(a):
                yield pa.record_batch([pa.array(cls[order[a]]), pa.array(cls[order[b]])], names=["a", "b"])

    sorted_ = tiles.repartition("tile").sortWithinPartitions("tile", "cls").select("tile", "cls", "label", "fingerprint")
    return pin(sorted_.mapInArrow(compare, "a bigint, b bigint"))


def _digits(shown: str) -> bytes:
    return bytes(int(c, 16) for c in shown)


def _alike(walk: Walk, shown: list[str], near: float, after: np.ndarray | None = None) -> tuple[np.ndarray, np.ndarray]:
    """Pairs of fingerprints that are at least ``near`` alike: each with all that follow it, or from ``after`` on."""
    after = np.arange(1, len(shown) + 1) if after is None else after
    most = max(len(x) for x in shown)
    codes = np.frombuffer("".join(x.ljust(most, ".") for x in shown).encode(), np.uint8).reshape(len(shown), most)
    weight = walk.weight[:most]
    reach = np.concatenate([[0.0], np.cumsum(weight)])[[len(x) for x in shown]]
    us, vs = [np.empty(0, np.int64)], [np.empty(0, np.int64)]
    there = codes != ord(".")
    for i, start in enumerate(after.tolist()):
        if start >= len(shown):
            continue
        rest = slice(start, None)
        same = ((codes[rest] == codes[i]) & there[i]) @ weight
        whole = np.maximum(reach[rest], reach[i])
        j = np.flatnonzero(same >= near * np.where(whole > 0, whole, 1)) + start
        us.append(np.full(len(j), i))
        vs.append(j)
    return np.concatenate(us), np.concatenate(vs)
