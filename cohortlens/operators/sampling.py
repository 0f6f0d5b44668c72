"""Patient-level splits, nested samples and folds, all by hash: deterministic and shuffle-light."""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from ..functions.bounded import bounded_rows, local_table
from ..functions.joins import join_groups
from ..session import pin

# Sample sizes, number of seeds and folds of the learning curves.
SIZES = (
    25, 35, 50, 70, 100, 140, 200, 280, 400, 560, 800, 1120, 1600, 2250, 3200, 4480, 6400, 8960,
    12800, 17920, 25600, 35840, 51200,
)
N_SEEDS = 20
N_FOLDS = 5


def split_bucket(key: Column, test_tenths: int = 3) -> Column:
    """``test`` for a fixed share of integer keys, else ``train_val``."""
    return F.when((key * 7919) % 10 < test_tenths, "test").otherwise("train_val")


def assign_split(df: DataFrame, key: str, test_tenths: int = 3, out: str = "split") -> DataFrame:
    """Split by patient, so that no patient is on both sides."""
    return df.withColumn(out, split_bucket(F.col(key), test_tenths))


def nested_ranks(
    df: DataFrame, key: str, seeds: Sequence[int], max_n: int, by: Sequence[str] = ()
) -> DataFrame:
    """(by, key, seed, rank) of the first ``max_n`` keys in a seeded random order.

    The order is by hash, and the leading hash digits are uniform buckets: their counts give
    the offset of each bucket, and ranks are then taken inside buckets. No task orders all keys.
    """
    keys = df.select(*by, key).where(F.col(key).isNotNull()).distinct()
    seeded = keys.withColumn("seed", F.explode(F.array(*[F.lit(s) for s in seeds])))
    h = F.md5(F.concat_ws(":", F.col("seed").cast("string"), F.col(key).cast("string")))
    seeded = seeded.withColumn("_h", h).withColumn("_bucket", F.substring("_h", 1, 3))
    group = [*by, "seed"]
    before = Window.partitionBy(*group).orderBy("_bucket").rowsBetween(Window.unboundedPreceding, -1)
    offsets = (
        seeded.groupBy(*group, "_bucket")
        .agg(F.count("*").alias("_c"))
        .withColumn("_before", F.coalesce(F.sum("_c").over(before), F.lit(0)))
        .where(F.col("_before") < max_n)
        .drop("_c")
    )
    inside = Window.partitionBy(*group, "_bucket").orderBy("_h", key)
    return (
        seeded.join(offsets, [*group, "_bucket"])
        .withColumn("rank", F.row_number().over(inside) + F.col("_before"))
        .where(F.col("rank") <= max_n)
        .select(*by, key, "seed", "rank")
    )


def feasible_sizes(
    df: DataFrame, key: str, sizes: Sequence[int], by: Sequence[str] = ()
) -> DataFrame:
    """(by, n_target): the sizes not above the number of distinct keys."""
    n = df.groupBy(*by).agg(F.count_distinct(key).alias("_n"))
    allowed = F.filter(F.array(*[F.lit(s) for s in sizes]), lambda s: s <= F.col("_n"))
    return n.select(*by, F.explode(allowed).alias("n_target"))


def nested_samples(
    df: DataFrame, key: str, seeds: Sequence[int], sizes: Sequence[int], by: Sequence[str] = ()
) -> DataFrame:
    """(by, seed, n_target, key): the first n of each seed's order, for every feasible n.

    Membership follows from one rank; sizes fan out only over the sampled keys.
    """
    ranks = nested_ranks(df, key, seeds, max(sizes), by)
    n_keys = df.groupBy(*by).agg(F.count_distinct(key).alias("_n"))
    if by:
        ranks = ranks.join(n_keys, list(by))
        total = F.col("_n")
    else:
        total = F.lit(n_keys.first()[0])
    sizes_col = F.filter(
        F.array(*[F.lit(s) for s in sizes]), lambda s: (s >= F.col("rank")) & (s <= total)
    )
    return ranks.select(*by, "seed", F.explode(sizes_col).alias("n_target"), key)


def size_bucket(rank: Column, sizes: Sequence[int]) -> Column:
    """Index of the smallest size that contains ``rank``; buckets up to it make the sample."""
    expr = F.lit(None).cast("int")
    for i, s in reversed(list(enumerate(sizes))):
        expr = F.when(rank <= s, F.lit(i)).otherwise(expr)
    return expr


def hash_fold(key: Column, k: int = N_FOLDS) -> Column:
    """Fold of a group key from its hash; a null key is a group like any other."""
    text = F.coalesce(key.cast("string"), F.lit(""))
    return F.conv(F.substring(F.md5(text), 1, 7), 16, 10).cast("long") % k


def group_folds(
    df: DataFrame, key: str, k: int = N_FOLDS, balanced: bool = False, out: str = "fold"
) -> DataFrame:
    """All rows of a group share a fold.

    ``balanced`` orders the groups by size and deals them out in snake order, by rank of
    (size, hash) taken in size classes, so that fold row counts stay close together.
    """
    if not balanced:
        return df.withColumn(out, hash_fold(F.col(key), k))
    sizes = df.groupBy(key).agg(F.count("*").alias("_size"))
    h = F.md5(F.coalesce(F.col(key).cast("string"), F.lit("")))
    sizes = sizes.withColumns({"_h": h, "_bucket": F.substring(h, 1, 3)})
    counts = sizes.groupBy("_size", "_bucket").agg(F.count("*").alias("_c"))
    # Offsets in two levels: distinct sizes first, then hash buckets inside a size.
    per_size = pin(counts.groupBy("_size").agg(F.sum("_c").alias("_s")))
    # Sizes fall into ranges by their leading bits: sums of ranges, then sums within a range.
    power = F.floor(F.log2(F.col("_size"))).cast("int")
    per_size = per_size.withColumn("_power", power).withColumn("_range", F.col("_power").cast("bigint") * 8192 + F.expr("(_size - shiftleft(1L, _power)) >> greatest(_power - 12, 0)"))
    totals = bounded_rows(per_size.groupBy("_range").agg(F.sum("_s").alias("s")), 64 * 8192, "size ranges")
    before, offsets = 0, []
    for r in sorted(totals, key=lambda r: -r["_range"]):
        offsets.append({"_range": r["_range"], "_before": before})
        before += r["s"]
    w_size = Window.partitionBy("_range").orderBy(F.col("_size").desc()).rowsBetween(Window.unboundedPreceding, -1)
    ranges = local_table(df.sparkSession, offsets, "_range bigint, _before bigint")
    per_size = per_size.join(ranges, "_range").select(
        "_size", (F.coalesce(F.sum("_s").over(w_size), F.lit(0)) + F.col("_before")).alias("_o1")
    )
    w_bucket = Window.partitionBy("_size").orderBy("_bucket").rowsBetween(Window.unboundedPreceding, -1)
    counts = counts.select("_size", "_bucket", F.coalesce(F.sum("_c").over(w_bucket), F.lit(0)).alias("_o2"))
    w_in = Window.partitionBy("_size", "_bucket").orderBy("_h", key)
    position = F.row_number().over(w_in) - 1 + F.col("_o1") + F.col("_o2")
    turn, place = F.floor(position / k), position % k
    fold = F.when(turn % 2 == 0, place).otherwise(k - 1 - place).cast("long")
    dealt = (
        sizes.join(counts, ["_size", "_bucket"]).join(per_size, "_size").withColumn(out, fold)
    ).select(key, out)
    return join_groups(df, dealt, [key])
