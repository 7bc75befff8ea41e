"""Sums within a tolerance: pairs of blocks that cannot matter are never evaluated.

Rows of both sides come in blocks.  A block's box (the least and the greatest of
each component) bounds what any pair of two blocks can add, whatever the formula
(``plans.bounds``).  A kept block leaves out the blocks of the other side that
add least, as long as all that it leaves out is within the tolerance; so the
error of each row is bounded, and the bound is a column of the result.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from pairloom.genred import PairReduce
from pairloom.operators.pairs import TILE, _bounded, _vars, bound_parameters, fetched, matrix, met_blocks, name_of, own_operations, split_product, unpacked
from pairloom.plans.bounds import bounds
from pairloom.plans.expr import VI, VJ, Expr, Var, call
from pairloom.session import checkpoints, ship

#: Blocks of the other side whose boxes are sent to every task.
BOXES = 10_000
#: Bounds hold up to rounding; they are taken this much larger.
SLACK = 1 + 1e-6


def cells(df: DataFrame, column: str, size: float, dim: int, block: str) -> DataFrame:
    """Adds the cubic cell of each point as text: blocks for ``truncated_sum``, without a shuffle.

    Points with a null or a NaN have a cell of their own.
    """
    array = df.schema[column].dataType.typeName() == "array"
    part = lambda d: F.get(F.col(column), F.lit(d)) if array else F.col(column)
    return df.withColumn(block, F.concat_ws(",", *(F.coalesce(F.floor(part(d).cast("double") / size).cast("string"), F.lit("-")) for d in range(dim))))


def block_boxes(df: DataFrame, block: str, variables: list[Var], name: str) -> DataFrame:
    """(block, rows, box): the lows of all components of the variables, then the highs; a NaN where a value is null or NaN."""
    array = {v.key: df.schema[name_of(v)].dataType.typeName() == "array" for v in variables}

    def part(v: Var, d: int):
        c = F.col(name_of(v))
        c = F.when(F.size(c) == v.dim, F.get(c, F.lit(d))) if array[v.key] else c
        return F.coalesce(c.cast("double"), F.lit(float("nan")))

    each = [part(v, d) for v in variables for d in range(v.dim)]
    box = [f(c) for f in (F.min, F.max) for c in each]
    found = df.groupBy(F.col(block).alias(name)).agg(F.count(F.lit(1)).alias("_rows"), *(c.alias(f"_b{n}") for n, c in enumerate(box)))
    return found.select(name, "_rows", F.array(*(F.col(f"_b{n}") for n in range(len(box)))).cast("array<double>").alias("_box"))


class _Amounts:
    """The most that a pair of two blocks can add, of either sign, in each component."""

    def __init__(self, query: PairReduce, params: dict | None):
        exprs = [query.formula]
        self.formula, self.params = query.formula, bound_parameters(exprs, params)
        self.mine, self.theirs = _vars(exprs, query.keep), _vars(exprs, VJ if query.keep == VI else VI)

    @staticmethod
    def _sides(boxes: np.ndarray, variables: list[Var], axis: int) -> dict:
        half, at, out = boxes.shape[1] // 2, 0, {}
        for v in variables:
            low, high = boxes[:, at : at + v.dim], boxes[:, half + at : half + at + v.dim]
            out[v.key] = (np.expand_dims(low, axis), np.expand_dims(high, axis))
            at += v.dim
        return out

    def __call__(self, mine: np.ndarray, theirs: np.ndarray) -> np.ndarray:
        """(blocks, blocks, dim); infinite where nothing is known, so that the pairs stay."""
        there = self._sides(mine, self.mine, 1) | self._sides(theirs, self.theirs, 0) | {k: (v, v) for k, v in self.params.items()}
        low, high = bounds(self.formula, there)
        most = np.broadcast_to(np.maximum(np.abs(low), np.abs(high)), (len(mine), len(theirs), self.formula.dim)) * SLACK
        odd = ~np.isfinite(mine).all(1)[:, None, None] | ~np.isfinite(theirs).all(1)[None, :, None]
        return np.where(odd | ~np.isfinite(most), np.inf, most)

    @property
    def width(self) -> int:
        return 2 * max(e.dim for e in self.formula.walk())


def _named(column: pa.Array) -> pa.Array:
    if column.null_count:
        raise ValueError("blocks must not be null")
    return column


def kept_blocks(query: PairReduce, left: DataFrame, right: DataFrame, tolerance: float, params: dict | None = None, left_block: str = "bi", right_block: str = "bj") -> DataFrame:
    """(mine, gone, theirs): for each block of the kept side the blocks that it meets, and what the others could add.

    ``theirs`` is a list; ``gone`` has a bound for each component, at most
    ``tolerance``.  Up to ``BOXES`` blocks of the other side each block leaves
    out those that add least.  Beyond, boxes meet as pairs of blocks of boxes,
    and a pair is left out if it is within its rows' share of the tolerance; a
    block then comes in several rows.
    """
    if query.reduction.name != "Sum":
        raise ValueError("sums only")
    if not tolerance >= 0:
        raise ValueError("the tolerance must not be negative")
    if own_operations(query.formula):
        raise ValueError("operations of one's own have no bounds")
    spark = ship(left.sparkSession)
    checkpoints(spark)
    amounts = _Amounts(query, params)
    (a, ka), (b, kb) = ((left, left_block), (right, right_block)) if query.keep == VI else ((right, right_block), (left, left_block))
    mine, theirs = block_boxes(a, ka, amounts.mine, "mine"), block_boxes(b, kb, amounts.theirs, "theirs").checkpoint()
    own, other = (next(f.dataType.simpleString() for f in df.schema if f.name == n) for df, n in ((mine, "mine"), (theirs, "theirs")))
    schema, wide = f"mine {own}, gone array<double>, theirs array<{other}>", (2 * sum(v.dim for v in amounts.mine), 2 * sum(v.dim for v in amounts.theirs))
    whole = fetched(theirs, BOXES)
    if whole is None:
        total = theirs.agg(F.sum("_rows")).first()[0]
        met = met_blocks(mine.withColumn("_i", F.xxhash64("mine")), theirs.withColumn("_j", F.xxhash64("theirs")), "_i", "_j", [], [], None).select("mine", "theirs")

        def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
            for batch in batches:
                for r in range(batch.num_rows):
                    x, y = unpacked(batch, r)
                    yield from _chosen(amounts, x, _named(y["theirs"]), y["_rows"].to_numpy(), matrix(y["_box"], wide[1]), tolerance, wide[0], total)

        return met.mapInArrow(run, schema)
    names, rows, boxes = _named(whole["theirs"].combine_chunks()), whole["_rows"].to_numpy(), matrix(whole["_box"], wide[1])
    sent = spark.sparkContext.broadcast((names, rows, boxes))

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            yield from _chosen(amounts, batch, *sent.value, tolerance, wide[0], None)

    return mine.mapInArrow(run, schema)


def _chosen(amounts: _Amounts, mine: pa.RecordBatch, names: pa.Array, rows: np.ndarray, boxes: np.ndarray, tolerance: float, wide: int, total: int | None) -> Iterator[pa.RecordBatch]:
    """Rows of ``kept_blocks``; ``total``: the rows that share the tolerance, or None where blocks are left out in order."""
    _named(mine["mine"])
    own = matrix(mine["_box"], wide)
    step = max(1, TILE // max(1, len(rows) * amounts.width))
    for k in range(0, len(own), step):
        each = amounts(own[k : k + step], boxes)
        gone, kept = [], []
        for most in each:
            added = most * rows[:, None]
            if total is None:
                order = np.argsort(added.max(1), kind="stable")
                count = int(np.searchsorted(np.cumsum(added[order], 0).max(1), tolerance, side="right"))
                out = order[:count]
            else:
                out = np.flatnonzero(most.max(1) * total <= tolerance)
            stay = np.ones(len(rows), bool)
            stay[out] = False
            gone.append(added[out].sum(0))
            kept.append(np.flatnonzero(stay))
        ends = np.concatenate([[0], np.cumsum([len(x) for x in kept])])
        lists = pa.ListArray.from_arrays(pa.array(ends, pa.int32()), names.take(pa.array(np.concatenate(kept), pa.int64())))
        yield pa.RecordBatch.from_arrays([mine["mine"].slice(k, step), pa.array([g.tolist() for g in gone], pa.list_(pa.float64())), lists], ["mine", "gone", "theirs"])


def _signed(df: DataFrame, columns: list[str]) -> DataFrame:
    """Adds which components are below 0 or -0.0, as Spark takes 0.0 and -0.0 for one key."""
    array = {c: df.schema[c].dataType.typeName() == "array" for c in columns}
    below = lambda x: F.atan2(x.cast("double"), F.lit(-1.0)) < 0
    return df.withColumn("_signs", F.concat(F.array().cast("array<boolean>"), *(F.transform(c, below) if array[c] else F.array(below(F.col(c))) for c in columns)))


def _names(e: Expr, cat: int) -> list[str]:
    return list(dict.fromkeys(name_of(v) for v in _vars([e], cat)))


def _over_distinct(query: PairReduce, other: DataFrame, row_id: str, block: str) -> tuple[PairReduce, DataFrame]:
    """The same sums over the distinct rows of the other side, each with the sum of its weights, or the number of its rows."""
    side = VJ if query.keep == VI else VI
    own, weight = split_product(query.formula, query.keep)
    if not (isinstance(weight, Var) and own.dim == 1 and name_of(weight) not in _names(own, side)):
        own, weight = query.formula, None
    if weight is None:
        sums = F.count(F.lit(1)).cast("double")
    else:  # null, and so refused later, where one of them is
        c = F.col(name_of(weight))
        array = other.schema[name_of(weight)].dataType.typeName() == "array"
        parts = [F.when(F.size(c) == weight.dim, F.get(c, F.lit(d))) for d in range(weight.dim)] if array else [c]
        each = [F.when(F.count(x) == F.count(F.lit(1)), F.sum(x.cast("double"))) for x in parts]
        sums = F.array(*each) if array else each[0]
    names, column = _names(own, side), Var(10_000_002, weight.dim if weight is not None else 1, side, "_weight")
    rows = _signed(other, names).groupBy(block, *names, "_signs").agg(F.min(row_id).alias(row_id), sums.alias("_weight"))
    return query._like(call("Mult", own, column)), rows


def truncated_sum(query: PairReduce, left: DataFrame, right: DataFrame, tolerance: float, params: dict | None = None, left_block: str = "bi", right_block: str = "bj", left_id: str = "i", right_id: str = "j") -> DataFrame:
    """(id, value, bound): the sums of ``query``, each component within ``bound`` (at most ``tolerance``) of the whole sum.

    ``left`` and ``right`` have a column that names each row's block (``cells``,
    or any clusters); the more alike the rows of a block, the more is left out.
    Null blocks are refused; rows with NaN or infinite components meet all rows.
    Repeated rows count as often as they come, but are evaluated once; without rows on the other side
    sums and bounds are 0.
    """
    if query.reduction.name != "Sum" or own_operations(query.formula):
        kept_blocks(query, left, right, tolerance, params, left_block, right_block)  # says what is wrong
    keep_left = query.keep == VI
    kept, kept_id, kept_block = (left, left_id, left_block) if keep_left else (right, right_id, right_block)
    other, other_id, other_block = (right, right_id, right_block) if keep_left else (left, left_id, left_block)
    # equal rows of either side are one: what grows are the distinct ones
    checkpoints(ship(left.sparkSession))
    mine = _names(query.formula, query.keep)
    whole = _signed(kept.select(F.col(kept_id).cast("long").alias("_id"), kept_block, *mine), mine)
    rows = whole.select(kept_block, *mine, "_signs").distinct().withColumn(kept_id, F.monotonically_increasing_id()).checkpoint()
    if not query.reduction.exact:
        query, other = _over_distinct(query, other, other_id, other_block)
        other = other.checkpoint()
    sides = (rows, other) if keep_left else (other, rows)
    out = _truncated_sum(query, *sides, tolerance, params, left_block, right_block, left_id, right_id)
    out = rows.join(out, kept_id).drop(kept_id)
    return whole.join(out, [kept_block, *mine, "_signs"]).select(F.col("_id").alias(kept_id), "value", "bound")


def _truncated_sum(query: PairReduce, left: DataFrame, right: DataFrame, tolerance: float, params: dict | None, left_block: str, right_block: str, left_id: str, right_id: str) -> DataFrame:
    chosen = kept_blocks(query, left, right, tolerance, params, left_block, right_block).checkpoint()
    mine, theirs = ("bi", "bj") if query.keep == VI else ("bj", "bi")
    ranges = chosen.select(F.col("mine").alias(mine), F.explode("theirs").alias(theirs))
    gone = chosen.select(F.col("mine").alias("_of"), F.posexplode("gone").alias("_d", "_g")).groupBy("_of", "_d").agg(F.sum("_g").alias("_g"))
    gone = gone.groupBy("_of").agg(F.sort_array(F.collect_list(F.struct("_d", "_g"))).alias("_g")).select("_of", F.col("_g._g").alias("bound"))
    names = lambda cat: list(dict.fromkeys(name_of(v) for v in _vars([query.formula], cat)))
    a = left.select(F.col(left_id), *names(VI), F.col(left_block).alias("bi"), *([F.col(left_block).alias("_of")] if query.keep == VI else []))
    b = right.select(F.col(right_id), *names(VJ), F.col(right_block).alias("bj"), *([F.col(right_block).alias("_of")] if query.keep == VJ else []))
    kept_id = left_id if query.keep == VI else right_id
    out = query.run(a, b, params, ranges=ranges, batch=["_of"], left_id=left_id, right_id=right_id)
    none = F.array_repeat(F.lit(0.0), query.formula.dim)
    return out.join(_bounded(gone), "_of", "left").select(kept_id, "value", F.coalesce("bound", none).alias("bound"))
