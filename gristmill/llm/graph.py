"""Connected components of a link table by alternating large and small stars.

Each round is two joins and partial aggregations over the links; nothing is collected, and a node with
many links is a minimum and a split join, never a list. Rounds are cut by a table in the shared folder.
What is left of a link table that is small (it is counted) is settled by one task, with the same result.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .common import forget, settle

#: Rounds follow the logarithm of a component's length; so many are never needed below 2**60 nodes.
MAX_ROUNDS = 60
#: Links that one task may settle.
SMALL = 20_000


def _large_star(links: DataFrame) -> DataFrame:
    both = links.select("u", "v").unionAll(links.select(F.col("v").alias("u"), F.col("u").alias("v")))
    least = both.groupBy("u").agg(F.least(F.min("v"), F.first("u")).alias("m"))
    out = both.where("v > u").join(least, "u").select(F.col("v").alias("u"), F.col("m").alias("v"))
    return out.where("u <> v").distinct()


def _small_star(links: DataFrame) -> DataFrame:
    down = links.select(F.greatest("u", "v").alias("u"), F.least("u", "v").alias("v"))
    least = down.groupBy("u").agg(F.min("v").alias("m"))
    moved = down.join(least, "u").select(F.col("v").alias("u"), F.col("m").alias("v")).where("u <> v")
    return moved.unionAll(least.select("u", F.col("m").alias("v"))).distinct()


def smallest_of(labels: np.ndarray, a: np.ndarray, b: np.ndarray) -> None:
    """Give linked places the smallest label of their component, in place."""
    while True:
        low = np.minimum(labels[a], labels[b])
        if (labels[a] == low).all() and (labels[b] == low).all():
            return
        np.minimum.at(labels, labels[a], low)
        np.minimum.at(labels, labels[b], low)
        while True:
            up = labels[labels]
            if (up == labels).all():
                break
            labels[:] = up


def _in_one_task(links: DataFrame) -> DataFrame:
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        parts = [[c.to_numpy(zero_copy_only=False) for c in b.columns] for b in batches if b.num_rows]
        if parts:
            u, v = (np.concatenate(c) for c in zip(*parts, strict=True))
            nodes, place = np.unique(np.concatenate((u, v)), return_inverse=True)
            labels = np.arange(len(nodes))
            smallest_of(labels, place[: len(u)], place[len(u) :])
            moved = labels != np.arange(len(nodes))
            yield pa.RecordBatch.from_arrays([pa.array(nodes[moved]), pa.array(nodes[labels[moved]])], names=["node", "root"])

    return links.repartition(1).mapInArrow(run, "node long, root long")


def components(links: DataFrame, small: int = SMALL) -> DataFrame:
    """links: u, v (longs). node, root (the smallest node of its component) for every linked node but the roots."""
    links = settle(_small_star(links.where("u <> v")), "links")
    for _ in range(MAX_ROUNDS):
        if links.count() <= small:
            return settle(_in_one_task(links), "roots")
        # stars: every node has one parent, and no parent has one
        twice = links.groupBy("u").agg(F.count(F.lit(1)).alias("n")).where("n > 1").select("u")
        if twice.unionAll(links.select(F.col("v").alias("u")).join(links.select("u"), "u", "left_semi")).isEmpty():
            return links.select(F.col("u").alias("node"), F.col("v").alias("root"))
        last, links = links, settle(_small_star(_large_star(links)), "links")
        forget(last)
    raise RuntimeError("components did not settle")
