"""Clusters and the block pairs that meet: the inputs of ranged queries."""

from __future__ import annotations

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from pairloom.operators.pairs import fetched
from pairloom.session import checkpoints

#: Bins or labels that the driver numbers itself.
FEW = 50_000


def _running(df: DataFrame, order: list[str], amount: Column, name: str) -> DataFrame:
    """Adds the sum of ``amount`` over all rows before each row, in order of ``order``, by ranges.

    Every range has a running sum of its own; what lies before a range is one
    number for each range.  So no task orders more than a range.  Where there
    are at most ``FEW`` rows the driver sums them, and they are broadcast.
    """
    few = fetched(df.withColumn("_amount", amount.cast("long")), FEW)
    if few is not None:
        few = few.take(pc.sort_indices(few, [(c, "ascending") for c in order], null_placement="at_start"))
        own = few["_amount"].to_numpy()
        return F.broadcast(df.sparkSession.createDataFrame(few.drop_columns("_amount").append_column(name, pa.array(np.cumsum(own) - own, pa.int64()))))
    checkpoints(df.sparkSession)
    placed = df.withColumn("_amount", amount).repartitionByRange(*order).withColumn("_range", F.spark_partition_id()).checkpoint()
    own = Window.partitionBy("_range").orderBy(*order).rowsBetween(Window.unboundedPreceding, -1)
    totals = placed.groupBy("_range").agg(F.sum("_amount").alias("_total"))
    # one row for each range
    before = totals.select("_range", F.coalesce(F.sum("_total").over(Window.orderBy("_range").rowsBetween(Window.unboundedPreceding, -1)), F.lit(0)).alias("_before"))
    summed = placed.withColumn("_own", F.coalesce(F.sum("_amount").over(own), F.lit(0))).join(F.broadcast(before), "_range")
    return summed.withColumn(name, F.col("_own") + F.col("_before")).drop("_amount", "_range", "_own", "_before")


def grid_cluster(df: DataFrame, column: str, size: float, dim: int, label: str = "label") -> DataFrame:
    """Adds the number of each point's cubic bin, bins numbered in order without gaps.

    Bins are ranked over the distinct bins, not the points, and never collide.
    """
    array = df.schema[column].dataType.typeName() == "array"
    bins = [F.floor((F.col(column)[d] if array else F.col(column)) / size).alias(f"_bin{d}") for d in range(dim)]
    names = [f"_bin{d}" for d in range(dim)]
    binned = df.select("*", *bins)
    ranked = _running(binned.select(*names).distinct(), names, F.lit(1), label).withColumn(label, F.col(label).cast("int"))
    return binned.join(ranked, names).drop(*names)


def sort_clusters(df: DataFrame, label: str, row_id: str) -> DataFrame:
    """Rows in order of their label."""
    return df.orderBy(label, row_id)


def cluster_ranges(df: DataFrame, label: str) -> DataFrame:
    """label, start, end: places of each label's rows once sorted by label."""
    counts = _running(df.groupBy(label).agg(F.count(F.lit(1)).alias("n")), [label], F.col("n"), "start")
    return counts.select(label, "start", (F.col("start") + F.col("n")).alias("end"))


def cluster_centroids(df: DataFrame, column: str, label: str, dim: int, weight: Column | str | None = None) -> DataFrame:
    """label, centroid, weight: weighted means."""
    w = F.lit(1.0) if weight is None else F.col(weight) if isinstance(weight, str) else weight
    array = df.schema[column].dataType.typeName() == "array"
    part = lambda d: (F.col(column)[d] if array else F.col(column)).cast("double")
    total = F.sum(w)
    return df.groupBy(label).agg(F.array(*(F.sum(w * part(d)) / total for d in range(dim))).alias("centroid"), total.cast("double").alias("weight"))


def cluster_ranges_centroids(df: DataFrame, column: str, label: str, dim: int, weight=None) -> DataFrame:
    """label, start, end, centroid, weight."""
    return cluster_ranges(df, label).join(cluster_centroids(df, column, label, dim, weight), label)


def from_matrix(keep: DataFrame, left: str = "bi", right: str = "bj") -> DataFrame:
    """A table of block pairs from a mask (bi, bj, keep)."""
    return keep.where(F.col("keep").cast("boolean")).select(F.col(left).alias("bi"), F.col(right).alias("bj")).distinct()


def close_blocks(a: DataFrame, b: DataFrame, radius: float) -> DataFrame:
    """Block pairs whose centroids are closer than ``radius``; tables (label, centroid)."""
    d = F.aggregate(F.zip_with("ca", "cb", lambda x, y: (x - y) * (x - y)), F.lit(0.0), lambda s, x: s + x)
    first = a.select(F.size("centroid")).first()
    dims = min(3, first[0]) if first else 0
    # centroids that close lie in neighbouring cells of that size in each of the first coordinates
    cell = lambda k: F.floor(F.col("centroid")[k] / radius)
    if not dims:
        return a.select(F.col("label").alias("bi"), F.col("label").alias("bj")).limit(0)
    left = a.select(F.col("label").alias("bi"), F.col("centroid").alias("ca"), *(cell(k).alias(f"_c{k}") for k in range(dims)))
    for k in range(dims):
        left = left.withColumn(f"_c{k}", F.explode(F.array(*(F.col(f"_c{k}") + s for s in (-1, 0, 1)))))
    right = b.select(F.col("label").alias("bj"), F.col("centroid").alias("cb"), *(cell(k).alias(f"_c{k}") for k in range(dims)))
    return left.join(right, [f"_c{k}" for k in range(dims)]).where(d < radius * radius).select("bi", "bj")


def swap_axes(ranges: DataFrame) -> DataFrame:
    """Block pairs with the roles of i and j exchanged."""
    return ranges.select(F.col("bj").alias("bi"), F.col("bi").alias("bj"))
