"""Pair reductions as table functions of SQL.

``register_query`` makes a function of one query; its result columns follow
from the formula:

    SELECT i, value FROM gauss(TABLE(SELECT i, x FROM suppliers))

``register_pair_reduce`` makes one that takes the formula as text, and the name
of one of some right sides:

    SELECT id, value, index FROM pair_reduce(
        TABLE(SELECT i AS id, x FROM suppliers), 'nations', 'Exp(-SqDist(x,y))', 'x = Vi(3); y = Vj(3)', 'Sum')

The table argument streams past in Arrow batches, wherever its rows are: no
shuffle, and no row moves to Python on its own.  The right sides are sent to
each task once; they must be small (``SMALL_BYTES``, checked when they are
registered).  Where both sides are large, ``PairReduce.run`` has a plan for it.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from pairloom.genred import PairReduce
from pairloom.operators.pairs import PairKernel, _grouped, _sorted_side, _table, _vars, bound_parameters, matrix, name_of, small_side
from pairloom.plans.expr import VI, VJ, Var
from pairloom.session import ship


def _lists(x: np.ndarray) -> pa.Array:
    flat = np.ascontiguousarray(x)
    return pa.ListArray.from_arrays(pa.array(np.arange(len(flat) + 1, dtype=np.int32) * flat.shape[1]), pa.array(flat.ravel()))


class _Fold:
    """A query on Arrow batches of rows i: complete states, and so results."""

    def __init__(self, query: PairReduce, params: dict | None):
        if query.keep != VI:
            raise ValueError("table functions keep side i")
        if query.reduction.name == "Zero":
            raise ValueError("a sum of zeros needs no table function")
        exprs = [query.formula, query.weight]
        self.kernel = PairKernel(query.formula, query.weight, query.reduction, VI, bound_parameters(exprs, params), query.chunks)
        self.mine, self.theirs = _vars(exprs, VI), _vars(exprs, VJ)

    def __call__(self, rows: pa.RecordBatch, there: tuple[np.ndarray, dict] | None) -> dict[str, np.ndarray]:
        state = self.kernel.start(rows.num_rows)[0]
        if there is not None:
            state = self.kernel.fold(state, _table(rows, self.mine), there[1], there[0])
        return self.kernel.reduction.result(state)


def register_query(spark: SparkSession, name: str, query: PairReduce, right: DataFrame, params: dict | None = None, batch: list[str] = (), left_id: str = "i", right_id: str = "j") -> None:
    """Makes ``name`` a table function of a table of rows i: (batch keys, id, value and/or index).

    The table has a column for the id, the keys of ``batch`` and each Vi; other
    columns are ignored.  Both sides have the keys; a key that the right side
    has not, or null, meets nothing.  Null ids stay null.
    """
    fold, keys = _Fold(query, params), list(batch)
    ship(spark)
    b = right.select(*keys, F.col(right_id).cast("long").alias(right_id), *dict.fromkeys(name_of(v) for v in fold.theirs))
    whole = small_side(b, fold.theirs)
    if whole is None:
        raise ValueError("the right side is too large to be sent: use PairReduce.run")
    there = {}
    for tag, rows in _grouped(whole, keys):
        part = whole.take(rows)
        if None not in tag and part.num_rows:
            there[tag] = _sorted_side(part[right_id].to_numpy(), _table(part, fold.theirs))
    sent = spark.sparkContext.broadcast(there)
    types = {f.name: f.dataType.simpleString() for f in right.schema}
    kinds = {"value": "array<double>", "index": "array<bigint>"}
    shown = list(fold.kernel.reduction.result(fold.kernel.start(0)[0]))

    class Reduced:
        def eval(self, rows: pa.RecordBatch) -> Iterator[pa.Table]:
            for tag, places in _grouped(rows, keys):
                some = rows.take(places) if keys else rows
                found = fold(some, sent.value.get(tag))
                yield pa.table({**{k: some[k] for k in keys}, left_id: some[left_id].cast(pa.int64()), **{c: _lists(x) for c, x in found.items()}})

    kind = ", ".join([*(f"{k} {types[k]}" for k in keys), f"{left_id} bigint", *(f"{c} {kinds[c]}" for c in shown)])
    spark.udtf.register(name, F.arrow_udtf(Reduced, returnType=kind))


def register_pair_reduce(spark: SparkSession, sides: dict[str, DataFrame], name: str = "pair_reduce", right_id: str = "j") -> None:
    """Makes ``name(TABLE(rows), side, formula, aliases, reduction, k, formula2)`` a table function: (id, value, index).

    ``rows`` has a column id and one for each Vi; ``side`` names one of
    ``sides``, which have columns for the Vj.  Aliases are parted by semicolons.
    ``k`` and ``formula2`` may be left out, or null.  What a reduction has not
    (value or index) is null.  Without rows on the side, results are neutral.
    """
    ship(spark)
    held = {}
    for side, df in sides.items():
        columns = [c for c in df.columns if c != right_id]
        one = df.select(F.col(right_id).cast("long").alias(right_id), *columns)
        wide = [f.dataType.typeName() == "array" for f in df.select(*columns).schema]
        # how long the vectors are is known from the rows
        first = one.first()
        whole = small_side(one, [Var(n, len(first[c]) if first is not None and wide[n] and first[c] is not None else 1, VJ, c) for n, c in enumerate(columns)])
        if whole is None:
            raise ValueError(f"{side} is too large to be sent: use PairReduce.run")
        held[side] = whole
    sent = spark.sparkContext.broadcast(held)

    class Reduced:
        def __init__(self):
            self.made: dict[tuple, tuple] = {}

        def _query(self, side, formula, aliases, reduction, k, formula2):
            asked = (side, formula, aliases, reduction, k, formula2)
            if asked not in self.made:
                if side not in sent.value:
                    raise ValueError(f"no side {side}: there are {', '.join(sorted(sent.value))}")
                fold = _Fold(PairReduce(formula, [a.strip() for a in aliases.split(";") if a.strip()], reduction, 1, k=k or 0, formula2=formula2), None)
                whole = sent.value[side]
                there = _sorted_side(whole[right_id].to_numpy(), {v.key: matrix(whole[name_of(v)], v.dim) for v in fold.theirs})
                self.made[asked] = fold, there if whole.num_rows else None
            return self.made[asked]

        def eval(self, rows: pa.RecordBatch, side, formula, aliases, reduction, k=None, formula2=None) -> Iterator[pa.Table]:
            fold, there = self._query(*(x[0].as_py() if isinstance(x, (pa.Array, pa.ChunkedArray)) and len(x) else x for x in (side, formula, aliases, reduction, k, formula2)))
            found = fold(rows, there)
            none = lambda t: pa.nulls(rows.num_rows, pa.list_(t))
            yield pa.table({"id": rows["id"].cast(pa.int64()), "value": _lists(found["value"]) if "value" in found else none(pa.float64()), "index": _lists(found["index"]) if "index" in found else none(pa.int64())})

    spark.udtf.register(name, F.arrow_udtf(Reduced, returnType="id bigint, value array<double>, index array<bigint>"))
