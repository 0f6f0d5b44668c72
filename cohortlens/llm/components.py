"""Connected components of a link table by rounds of joins."""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from cohortlens.llm.common import merge_labels
from cohortlens.session import pin

#: Rounds that no graph of fewer than 2^60 links needs; reaching it is an error, not a result.
MAX_ROUNDS = 200


def _stars(batches: Iterator[pa.RecordBatch], most: int = 1 << 20) -> Iterator[pa.RecordBatch]:
    """Up to ``most`` links at a time as stars: every node of theirs is linked to the smallest that it reaches by them."""

    def joined(held: list[pa.RecordBatch]) -> pa.RecordBatch:
        links = pa.Table.from_batches(held)
        nodes, ends = np.unique(np.concatenate([links.column(c).to_numpy() for c in ("a", "b")]), return_inverse=True)
        least = merge_labels(np.arange(len(nodes)), ends[: links.num_rows], ends[links.num_rows :])
        own = np.flatnonzero(least != np.arange(len(nodes)))
        return pa.record_batch([pa.array(nodes[own]), pa.array(nodes[least[own]])], names=["a", "b"])

    held, total = [], 0
    for batch in batches:
        held.append(batch)
        total += batch.num_rows
        if total >= most:
            yield joined(held)
            held, total = [], 0
    if total:
        yield joined(held)


def _both_ways(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """The stars of a task's links, each link in both directions."""
    for stars in _stars(batches):
        yield stars
        yield pa.record_batch([stars.column("b"), stars.column("a")], names=["a", "b"])


def _settled(edges: DataFrame) -> bool:
    """Whether every component is a star: larger ends have one link each and are no smaller end."""
    ends = edges.select(F.col("a").alias("node"), F.lit(1).alias("up"), F.lit(0).alias("down"))
    ends = ends.unionByName(edges.select(F.col("b").alias("node"), F.lit(0).alias("up"), F.lit(1).alias("down")))
    return ends.groupBy("node").agg(F.sum("up").alias("up"), F.max("down").alias("down")).where("up + down > 1 AND up > 0").isEmpty()


def _large_star(edges: DataFrame) -> DataFrame:
    """Every larger neighbour of a node is linked to the smallest of its neighbourhood: one row for each link."""
    both = edges.mapInArrow(_both_ways, "a bigint, b bigint")
    least = both.groupBy("a").agg(F.least(F.min("b"), F.col("a")).alias("m"))
    return both.join(least, "a").where("b > a").select(F.col("b").alias("a"), F.col("m").alias("b"))


def _small_star(edges: DataFrame) -> DataFrame:
    """A node and its smaller neighbours are linked to the smallest of them."""
    least = edges.groupBy("a").agg(F.min("b").alias("m"))
    rest = edges.join(least, "a").where("b <> m").select(F.col("b").alias("a"), F.col("m").alias("b"))
    return rest.unionByName(least.select("a", F.col("m").alias("b"))).distinct()


def components(links: DataFrame) -> DataFrame:
    """(node, component) for every node that has a link to another node.

    ``links`` has two bigint columns ``a`` and ``b``; order, repeats, self links and rows with nulls do not
    matter. ``component`` is the smallest node reachable. Links become stars in the tasks that read them; then the
    large-star and small-star steps join the stars of different tasks, until one star is left of every component.
    Each round is written to the shared folder, so lineage stays short and a lost executor costs a re-read. Minima are
    aggregated before the shuffle and a hub's rows sit on one side of a shuffle join only, which adaptive execution splits.
    """
    edges = pin(links.where("a <> b").select("a", "b").mapInArrow(_stars, "a bigint, b bigint").distinct())
    for _ in range(MAX_ROUNDS):
        if _settled(edges):
            break
        edges = pin(_small_star(_large_star(edges)))
    else:
        raise RuntimeError("components did not settle")
    roots = edges.select(F.col("b").alias("node"), F.col("b").alias("component")).distinct()
    return edges.select(F.col("a").alias("node"), F.col("b").alias("component")).unionByName(roots)
