"""Pair reductions over a stream of rows j with a state for each row i, in Spark's own state store.

A micro-batch is folded against the rows i that it meets (all, those of its
batch keys, or those of the blocks that ranges name), sent to each task once.
What it adds to a row goes to that row's state by key, and only rows that it
touches are read, written and put out (update mode).  With a window of event
time each window has states of its own, which a watermark closes: later rows
of a closed window are dropped and its states leave the store.

Sums, minima and maxima are streaming aggregates of the JVM.  K lowest,
exponential and compensated sums are no built-in aggregate of bounded size;
their states are two short arrays, merged by ``applyInPandasWithState``.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pandas as pd
import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession, Window
from pyspark.sql import functions as F
from pyspark.sql.streaming.state import GroupState, GroupStateTimeout

from pairloom.genred import PairReduce
from pairloom.operators.pairs import SMALL_RANGES, STATES, PairKernel, _grouped, _sorted_side, _table, _vars, bound_parameters, fetched, name_of, small_side
from pairloom.operators.reductions import K_LOWEST, VALUE_ARG
from pairloom.plans.expr import VI, VJ
from pairloom.session import ship

#: Types of the two arrays of a state.
_KINDS = ("array<double>", "array<bigint>")


def keyed_stream(
    query: PairReduce,
    left: DataFrame,
    stream: DataFrame,
    params: dict | None = None,
    batch: list[str] = (),
    ranges: DataFrame | None = None,
    time: str | None = None,
    window: str | None = None,
    slide: str | None = None,
    delay: str | None = None,
    left_id: str = "i",
    right_id: str = "j",
) -> DataFrame:
    """A streaming table (window_start, window_end, keys, id, value and/or index), to be written in update mode.

    ``batch`` are key columns of both sides; with ``ranges`` (bi, bj) ``left``
    has a column bi and the stream bj.  ``window`` (and ``slide``) cut the
    column ``time`` of the stream; ``delay`` is how long a window waits after
    its end, measured against the latest end seen.  Rows of the stream with a
    null key, block or time meet nothing.  Rows i that nothing has met are not
    put out.  A row of ``left`` that comes twice has one state for both, so its
    ids must be distinct within the keys.  ``left`` must be a small side; a
    larger one goes through ``fold_stream``, whose plan sends blocks of both.
    """
    if query.keep != VI:
        raise ValueError("streams are reduced along j")
    if (window is None) != (time is None) or ((delay or slide) and window is None):
        raise ValueError("a window needs a time column, and a delay or a slide needs a window")
    exprs, reduction = [query.formula, query.weight], query.reduction
    if reduction.name == "Zero":
        raise ValueError("a sum of zeros needs no stream")
    kernel = PairKernel(query.formula, query.weight, reduction, VI, bound_parameters(exprs, params), query.chunks)
    mine, theirs = _vars(exprs, VI), _vars(exprs, VJ)
    keys, spark, ranged = list(batch), ship(left.sparkSession), ranges is not None
    tags = [*keys, *(["bi"] if ranged else [])]
    a = left.select(*tags, F.col(left_id).cast("long").alias(left_id), *dict.fromkeys(name_of(v) for v in mine))
    whole = small_side(a, mine)
    if whole is None:
        raise ValueError("the kept side is too large to be sent: use fold_stream")
    partners: dict[object, list] = {}
    if ranges is not None:
        listed = fetched(ranges.select("bi", "bj").distinct(), SMALL_RANGES)
        if listed is None:
            raise ValueError("too many ranges to be sent: use batch keys")
        for p, q in zip(listed["bi"].to_pylist(), listed["bj"].to_pylist(), strict=True):
            partners.setdefault(q, []).append(p)
    kept = {}
    for tag, rows in _grouped(whole, tags):
        part = whole.take(rows)
        kept[tag] = (part[left_id].to_numpy().astype(np.int64), _table(part, mine))
    sent = spark.sparkContext.broadcast((kept, partners))

    timed = ["_start", "_end"] if window is not None else []
    b = stream
    if window is not None:
        b = stream.withColumn("_w", F.window(F.col(time), window, slide)).withColumn("_start", F.col("_w.start").cast("timestamp")).withColumn("_end", F.col("_w.end").cast("timestamp"))
    cut = [*timed, *keys, *(["bj"] if ranged else [])]
    b = b.select(*cut, F.col(right_id).cast("long").alias(right_id), *dict.fromkeys(name_of(v) for v in theirs))
    types = {f.name: f.dataType.simpleString() for f in b.schema}
    by = [*timed, *keys, left_id]
    first, second = ("_a array<double>", f"_b {_KINDS[reduction.name in VALUE_ARG or reduction.name in K_LOWEST]}")
    head = ", ".join([*(f"{c} {types[c]}" for c in (*timed, *keys)), f"{left_id} bigint"])

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        kept, partners = sent.value
        states, held = {}, 0

        def out():
            for (place, whole_tag), state in states.items():
                columns = [pa.array([v] * len(kept[place][0]), t) for v, t in zip(whole_tag, kinds, strict=True)]
                yield _flat(columns, kept[place][0], state, [*timed, *keys, left_id])
            states.clear()

        for batch in batches:
            kinds = [batch.schema.field(c).type for c in (*timed, *keys)]
            for tag, rows in _grouped(batch, cut) if batch.num_rows else ():
                if None in tag:
                    continue
                some = batch.take(rows)
                ids, vectors = _sorted_side(some[right_id].to_numpy(), _table(some, theirs))
                shown = tag[: len(timed) + len(keys)]
                places = [(*shown[len(timed) :], p) for p in partners.get(tag[-1], ())] if ranged else [shown[len(timed) :]]
                for place in places:
                    if place in kept:
                        own = kept[place]
                        if (place, shown) not in states:
                            states[place, shown] = reduction.start(len(own[0]))
                            held += len(own[0])
                        states[place, shown] = kernel.fold(states[place, shown], own[1], vectors, ids)
                if held > STATES:
                    yield from out()
                    held = 0
        yield from out()

    added = b.mapInArrow(run, f"{head}, {first}, {second}")
    if window is not None:
        added = added.withWatermark("_end", delay or "0 seconds")
    if reduction.name == "Sum" and not reduction.exact:
        found = added.groupBy(*by).agg(F.array(*(F.sum(F.col("_a")[d]) for d in range(reduction.dim))).alias("partial"))
    elif reduction.name in VALUE_ARG:
        lowest = lambda d: F.min(F.when(F.col("_a")[d] < float("inf"), F.struct(F.col("_a")[d].alias("v"), F.col("_b")[d].alias("i"))))
        found = added.groupBy(*by).agg(F.array(*(F.array_compact(F.array(lowest(d))) for d in range(reduction.dim))).alias("partial"))
    else:
        merged = _merging(reduction, by, bool(timed))
        shape = f"{head}, partial {reduction.partial_type}"
        timeout = GroupStateTimeout.EventTimeTimeout if timed else GroupStateTimeout.NoTimeout
        found = added.groupBy(*by).applyInPandasWithState(merged, shape, f"{first}, {second}", "update", timeout)
    names = {"_start": "window_start", "_end": "window_end"}
    return found.select(*(F.col(c).alias(names.get(c, c)) for c in by), *(c.alias(n) for n, c in reduction.finish("partial").items()))


def _flat(columns: list[pa.Array], ids: np.ndarray, state: tuple[np.ndarray, np.ndarray], names: list[str]) -> pa.RecordBatch:
    lists = []
    for x in state:
        flat = np.ascontiguousarray(x).reshape(len(ids), -1)
        ends = np.arange(len(ids) + 1, dtype=np.int32) * flat.shape[1]
        lists.append(pa.ListArray.from_arrays(pa.array(ends), pa.array(flat.ravel())))
    return pa.RecordBatch.from_arrays([*columns, pa.array(ids), *lists], [*names, "_a", "_b"])


def _merging(reduction, by: list[str], timed: bool):
    """The function of a row's state: what batches add is merged, a closed window's state is dropped."""
    shapes = [x.shape for x in reduction.start(1)]
    kinds = [x.dtype for x in reduction.start(1)]

    def merge(key: tuple, frames: Iterator[pd.DataFrame], state: GroupState) -> Iterator[pd.DataFrame]:
        if state.hasTimedOut:
            state.remove()
            return
        whole = lambda pair: tuple(np.array(list(x), t).reshape(s) for x, t, s in zip(pair, kinds, shapes, strict=True))
        now = whole(state.get) if state.exists else reduction.start(1)
        for frame in frames:
            for pair in zip(frame["_a"], frame["_b"], strict=True):
                now = reduction.combine(now, whole(pair))
        state.update(tuple(x.ravel().tolist() for x in now))
        if timed:
            end = int(pd.Timestamp(key[by.index("_end")]).timestamp() * 1000)
            # a window is taken as long as the watermark is not past its end
            state.setTimeoutTimestamp(max(end, state.getCurrentWatermarkMs() + 1))
        yield pd.DataFrame([[*key, reduction.partial(now)[0]]], columns=[*by, "partial"])

    return merge


def write_changes(stream: DataFrame, folder: str):
    """The writer of a keyed stream: the changed rows of each batch, once; a batch that is retried writes the same place."""

    def step(rows: DataFrame, number: int) -> None:
        rows.write.mode("overwrite").parquet(f"{folder}/changes/batch={number}")

    return stream.writeStream.outputMode("update").foreachBatch(step).option("checkpointLocation", f"{folder}/checkpoint")


def latest(spark: SparkSession, folder: str, by: list[str]) -> DataFrame:
    """Each row as the last batch that changed it left it; ``by``: id, keys and window columns."""
    changes = spark.read.parquet(f"{folder}/changes")
    last = Window.partitionBy(*by).orderBy(F.desc("batch"))
    return changes.withColumn("_n", F.row_number().over(last)).where("_n = 1").drop("_n", "batch")
