"""Pair reductions over a stream of rows j: partial states merge as batches arrive.

Every reduction is a commutative monoid, so the state of a row i after a batch
is the merge of its state before and the batch's partial.  ``fold_stream``
keeps that state as a table in a folder, one version per batch; a batch that is
retried writes the same version again.
"""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from pairloom.genred import PairReduce
from pairloom.operators.pairs import PairKernel, _by_blocks, _fewer, _by_small_side, _vars, bound_parameters, name_of, small_side
from pairloom.plans.expr import VI, VJ
from pairloom.session import ship


def partial_states(query: PairReduce, left: DataFrame, right: DataFrame, left_id: str = "i", right_id: str = "j", params: dict | None = None) -> DataFrame:
    """i, partial: what a batch of rows j contributes to each row i, one state (or one for each block of j)."""
    exprs = [query.formula, query.weight]
    kernel = PairKernel(query.formula, query.weight, query.reduction, VI, bound_parameters(exprs, params))
    kept, other = _vars(exprs, VI), _vars(exprs, VJ)
    a = left.select(F.col(left_id).cast("long").alias(left_id), *dict.fromkeys(name_of(v) for v in kept))
    b = right.select(F.col(right_id).cast("long").alias(right_id), *dict.fromkeys(name_of(v) for v in other))
    if (whole := small_side(b, other)) is not None:
        return _by_small_side(ship(left.sparkSession), kernel, a, b, kept, other, left_id, right_id, [], [], [], None, whole)
    return _by_blocks(kernel, a, b, kept, other, left_id, right_id, [], [], [], None)


def fold_stream(query: PairReduce, left: DataFrame, stream: DataFrame, folder: str, left_id: str = "i", right_id: str = "j", params: dict | None = None):
    """A streaming query (not started by a sink of its own): ``writeStream`` with foreachBatch.

    Returns the DataStreamWriter; ``state(spark, folder, query)`` reads the result so far.
    """
    if query.keep != VI:
        raise ValueError("streams are reduced along j")
    bound_parameters([query.formula, query.weight], params)  # a missing one is an error here, not in the first batch

    def step(batch: DataFrame, number: int) -> None:
        spark = batch.sparkSession
        new = partial_states(query, left, batch, left_id, right_id, params)
        if number:
            new = new.unionByName(spark.read.parquet(f"{folder}/state/{number - 1}"))
        merged = _fewer(new, [left_id], query.reduction).groupBy(left_id).agg(query.reduction.merge("partial").alias("partial"))
        merged.write.mode("overwrite").parquet(f"{folder}/state/{number}")
        if number > 1:  # the version before may be needed by a retry, older ones not
            old = spark.sparkContext._jvm.org.apache.hadoop.fs.Path(f"{folder}/state/{number - 2}")
            old.getFileSystem(spark.sparkContext._jsc.hadoopConfiguration()).delete(old, True)

    return stream.writeStream.foreachBatch(step).option("checkpointLocation", f"{folder}/checkpoint")


def reduce_available(query: PairReduce, left: DataFrame, stream: DataFrame, folder: str, left_id: str = "i", right_id: str = "j", params: dict | None = None) -> DataFrame:
    """Everything the stream has now, batch by batch; the state goes on where the folder's last run ended."""
    run = fold_stream(query, left, stream, folder, left_id, right_id, params).trigger(availableNow=True).start()
    run.awaitTermination()
    spark = left.sparkSession
    root = spark.sparkContext._jvm.org.apache.hadoop.fs.Path(f"{folder}/state")
    found = root.getFileSystem(spark.sparkContext._jsc.hadoopConfiguration()).listStatus(root)
    return state(query, left, folder, max(int(f.getPath().getName()) for f in found), left_id)


def state(query: PairReduce, left: DataFrame, folder: str, number: int, left_id: str = "i") -> DataFrame:
    """i and the result columns after batch ``number``; rows without pairs get the neutral value."""
    now = left.sparkSession.read.parquet(f"{folder}/state/{number}")
    full = left.select(F.col(left_id).cast("long").alias(left_id)).join(now, left_id, "left")
    full = full.withColumn("partial", F.coalesce("partial", query.reduction.neutral()))
    return full.select(left_id, *(c.alias(n) for n, c in query.reduction.finish("partial").items()))
