"""Connected components of a link table, without leaving the cluster.

Alternating large-star and small-star steps: every step points nodes at the
smallest neighbour they know, with aggregates that combine before the shuffle.
Links of each task are first replaced by a forest, which leaves few of them.
Each round is written to the shared folder, so plans stay short and a lost
executor costs one round at most.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from pairloom.llm._shared import discard, materialise


class Forest:
    """Union-find over 0..n-1 with the smallest member as root."""

    def __init__(self, n: int):
        self.root = list(range(n))
        self.trees = n

    def find(self, i: int) -> int:
        root = self.root
        while root[i] != i:
            root[i] = root[root[i]]
            i = root[i]
        return i

    def union(self, i: int, j: int) -> bool:
        i, j = self.find(i), self.find(j)
        if i == j:
            return False
        self.root[max(i, j)] = min(i, j)
        self.trees -= 1
        return True


def star_forest(a: np.ndarray, b: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """(node, smallest node of its tree) for the non-roots of the forest that links a-b span."""
    nodes, at = np.unique(np.concatenate([a, b]), return_inverse=True)
    forest = Forest(len(nodes))
    n = len(a)
    for i, j in zip(at[:n].tolist(), at[n:].tolist(), strict=True):
        forest.union(i, j)
    root = np.fromiter(map(forest.find, range(len(nodes))), np.int64, len(nodes))
    low = root != np.arange(len(nodes))
    return nodes[low], nodes[root[low]]


def _local(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    for b in batches:
        if b.num_rows:
            a, c = star_forest(b["a"].to_numpy(), b["b"].to_numpy())
            yield pa.RecordBatch.from_arrays([pa.array(a), pa.array(c)], ["a", "b"])


def _whole(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    held = [(b["a"].to_numpy(), b["b"].to_numpy()) for b in batches if b.num_rows]
    if held:
        a, c = star_forest(*(np.concatenate(x) for x in zip(*held, strict=True)))
        yield pa.RecordBatch.from_arrays([pa.array(a), pa.array(c)], ["node", "component"])


#: So few links are settled in one task.
SMALL = 20_000


def connected_components(links: DataFrame) -> DataFrame:
    """node, component (its smallest node) for every node of ``links`` (a, b) but the smallest ones.

    Links from a node to itself and nulls are ignored; an empty table gives none.
    """
    clean = links.where(F.col("a").isNotNull() & F.col("b").isNotNull() & (F.col("a") != F.col("b"))).select("a", "b")
    now = materialise(clean.mapInArrow(_local, "a long, b long").distinct(), "links")
    if now.count() <= SMALL:
        done = materialise(now.coalesce(1).mapInArrow(_whole, "node long, component long"), "components")
        discard(now)
        return done
    mark = None
    while True:
        both = now.unionByName(now.select(F.col("b").alias("a"), F.col("a").alias("b")))
        low = both.groupBy("a").agg(F.least(F.min("b"), F.col("a")).alias("m"))
        large = both.join(low, "a").where(F.col("b") > F.col("a")).select(F.col("b").alias("a"), F.col("m").alias("b"))
        large = materialise(large.where(F.col("a") != F.col("b")).distinct(), "links")
        # now every link points down: a > b
        low = large.groupBy("a").agg(F.min("b").alias("m"))
        small = large.join(low, "a").where(F.col("b") != F.col("m")).select(F.col("b").alias("a"), F.col("m").alias("b"))
        small = materialise(small.unionByName(low.select("a", F.col("m").alias("b"))).distinct(), "links")
        seen = small.agg(F.count(F.lit(1)), F.sum(F.xxhash64("a", "b").cast("decimal(38,0)"))).first()
        discard(now, large)
        now = small
        if tuple(seen) == mark:
            return now.select(F.col("a").alias("node"), F.col("b").alias("component"))
        mark = tuple(seen)
