"""Shards of equal size that keep linked rows together, by balanced label propagation."""

from __future__ import annotations

import math
from functools import reduce

from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from cohortlens.session import pin

#: Rounds of propagation; more only refine what quotas held back.
ROUNDS = 8
#: Priorities within one gain, by a hash of the node; a round moves whole priorities.
LEVELS = 1024
#: Rows that one window orders, on average.
RANK_ROWS = 20_000


def _numbered(rows: DataFrame, groups: list[str], key: str, n: int) -> DataFrame:
    """Adds ``rank``, gapless from 0 within ``groups``, without a window over a whole group.

    Rows are dealt to buckets by a hash; the buckets' counts are summed up, then each bucket is numbered.
    """
    buckets = max(1, math.ceil(n / RANK_ROWS))
    cells = rows.withColumn("bucket", F.pmod(F.xxhash64(key, F.lit("rank")), F.lit(buckets)))
    before = Window.partitionBy(*groups).orderBy("bucket").rowsBetween(Window.unboundedPreceding, -1)
    counts = cells.groupBy(*groups, "bucket").agg(F.count("*").alias("n"))
    counts = counts.withColumn("before", F.coalesce(F.sum("n").over(before), F.lit(0))).drop("n")
    inside = F.row_number().over(Window.partitionBy(*groups, "bucket").orderBy(key)) - 1
    return cells.withColumn("inside", inside).join(counts, [*groups, "bucket"]).withColumn(
        "rank", (F.col("before") + F.col("inside")).cast("bigint")
    ).drop("bucket", "before", "inside")


def _quotas(wishes: dict[tuple[int, int], int], room: list[int]) -> dict[tuple[int, int], int]:
    """How many of the wished moves between two shards may happen.

    As many as wish the opposite way swap; the others share the free room of their target.
    """
    swap = {ij: min(n, wishes.get(ij[::-1], 0)) for ij, n in wishes.items()}
    rest = {ij: n - swap[ij] for ij, n in wishes.items()}
    out = {}
    for (i, j), n in wishes.items():
        into = sum(m for (_, k), m in rest.items() if k == j)
        out[i, j] = swap[i, j] + (rest[i, j] if into <= room[j] else rest[i, j] * room[j] // into)
    return out


def propagate(members: DataFrame, capacity: list[int], rounds: int = ROUNDS) -> DataFrame:
    """(node, shard) for every node of ``members`` (node bigint, key): nodes that share a key are linked.

    Each round every node looks at how many of its neighbours, itself included, are in each shard, and
    wishes to be where most are; ties go to the shard that a hash of its smallest key names, so that all
    nodes of a group agree. Every other round looks only at shards with a twentieth of their capacity free, for groups larger than what is left of the
    shard they prefer. Of those who wish to move from one shard to another, as many as the quota allows
    move, greatest gain first. The start fills shards in hash order in proportion to their ``capacity``, which no
    round exceeds either; the capacities together must hold all nodes. Counts are aggregated by (key, shard) before anything is joined to nodes, so
    a key with very many nodes costs one row for each shard.
    """
    shards = len(capacity)
    votes = [f"v{s}" for s in range(shards)]
    members = members.select("node", "key")
    first = members.groupBy("node").agg(F.min("key").alias("home"))
    numbered = _numbered(first, [], "node", first.count())
    # the start: nodes in hash order fill the shards in proportion to their capacity
    n, share = numbered.count(), max(1, sum(capacity))
    ends = [math.ceil(n * sum(capacity[: s + 1]) / share) for s in range(shards)]
    place = reduce(lambda c, s: c.when(F.col("rank") < ends[s], s), range(1, shards), F.when(F.col("rank") < ends[0], 0))
    state = pin(numbered.select("node", "home", place.cast("int").alias("shard")))
    idle = 0
    for k in range(rounds):
        load = {r["shard"]: r["n"] for r in state.groupBy("shard").agg(F.count("*").alias("n")).collect()}
        room = [capacity[s] - load.get(s, 0) for s in range(shards)]
        open_ = [s for s in range(shards) if k % 2 == 0 or room[s] > capacity[s] // 20]
        seen = members.join(state.select("node", "shard"), "node")
        tally = seen.groupBy("key").agg(*(F.sum((F.col("shard") == s).cast("bigint")).alias(v) for s, v in enumerate(votes)))
        near = seen.select("node", "key").join(tally, "key").groupBy("node").agg(*(F.sum(v).alias(v) for v in votes))
        full = state.join(near, "node")
        turn = lambda s: F.pmod(F.xxhash64("home") + s, F.lit(shards))
        options = F.array(*(F.struct(F.col(v).alias("votes"), turn(s).alias("turn"), F.lit(s).alias("to")) for s, v in enumerate(votes)))
        best = F.array_max(F.filter(options, lambda o: o["to"].isin(open_) | (o["to"] == F.col("shard"))))
        now = F.element_at(options, F.col("shard") + 1)
        wish = full.select("node", "home", "shard", best["to"].alias("to"), (best["votes"] - now["votes"]).alias("gain"))
        level = F.floor(F.log2(F.col("gain") + 1)) * LEVELS + F.pmod(F.xxhash64("node", F.lit("priority")), F.lit(LEVELS))
        wish = pin(wish.withColumn("level", level.cast("bigint")))
        cells = wish.where("shard <> `to`").groupBy("shard", "to", "level").agg(F.count("*").alias("n"))
        down = Window.partitionBy("shard", "to").orderBy(F.desc("level"))
        stairs = pin(cells.withColumn("sum", F.sum("n").over(down)))
        wishes = {(r["shard"], r["to"]): r["n"] for r in stairs.groupBy("shard", "to").agg(F.sum("n").alias("n")).collect()}
        quota = _quotas(wishes, room)
        if not any(quota.values()):
            idle += 1
            if idle == 2:
                break
            continue
        allowed = reduce(lambda a, b: a | b, ((F.col("shard") == i) & (F.col("to") == j) & (F.col("sum") <= q) for (i, j), q in quota.items()))
        lowest = {(r["shard"], r["to"]): r["m"] for r in stairs.where(allowed).groupBy("shard", "to").agg(F.min("level").alias("m")).collect()}
        idle = 0
        if not lowest:
            continue
        moves = reduce(lambda a, b: a | b, ((F.col("shard") == i) & (F.col("to") == j) & (F.col("level") >= m) for (i, j), m in lowest.items()))
        state = pin(wish.select("node", "home", F.when(moves, F.col("to")).otherwise(F.col("shard")).cast("int").alias("shard")))
    return state.select("node", "shard")


def assign(
    docs: DataFrame, id_col: str = "doc_id", text_col: str = "text", shards: int = 8, rounds: int = ROUNDS
) -> DataFrame:
    """(id, size, text_crc32, shard, slot) for every row of ``docs``; rows with equal texts are linked.

    The law is ``rows``: the shards' counts differ by one at most. Linked rows are placed by ``propagate``, whose
    capacities are the shards' final counts; all others then fill the shards up, in hash order. A group larger than
    a shard is spread over several. ``slot`` numbers the rows of a shard from 0 without gaps. ``size`` is the text's
    UTF-8 bytes plus one. Null texts count as empty ones and are linked with them. Null and repeated ids are
    rows like any other. An empty table gives an empty result.
    """
    text = F.encode(F.coalesce(F.col(f"`{text_col}`"), F.lit("")), "utf-8")
    rows = pin(
        docs.select(F.col(f"`{id_col}`").cast("bigint").alias("id"), text.alias("text")).select(
            F.monotonically_increasing_id().alias("node"),
            "id",
            (F.octet_length("text") + 1).cast("bigint").alias("size"),
            F.crc32("text").alias("text_crc32"),
            F.unhex(F.md5("text")).alias("key"),
        )
    )
    n = rows.count()
    target = [n // shards + (s < n % shards) for s in range(shards)]
    shared = rows.groupBy("key").agg(F.count("*").alias("copies")).where("copies > 1").select("key")
    linked = pin(propagate(rows.select("node", "key").join(shared, "key"), target, rounds))
    count = {r["shard"]: r["n"] for r in linked.groupBy("shard").agg(F.count("*").alias("n")).collect()}
    placed = _numbered(linked, ["shard"], "node", n).select("node", "shard", F.col("rank").alias("slot"))
    need = [target[s] - count.get(s, 0) for s in range(shards)]
    free = _numbered(rows.join(linked, "node", "left_anti").select("node"), [], "node", n)
    shard, slot, start = F.lit(None), F.lit(None), 0
    for s in range(shards):
        here = (F.col("rank") >= start) & (F.col("rank") < start + need[s])
        shard = F.when(here, s).otherwise(shard)
        slot = F.when(here, F.col("rank") - start + count.get(s, 0)).otherwise(slot)
        start += need[s]
    filled = free.select("node", shard.cast("int").alias("shard"), slot.cast("bigint").alias("slot"))
    out = rows.join(placed.unionByName(filled), "node")
    return out.select("id", "size", "text_crc32", "shard", "slot")
