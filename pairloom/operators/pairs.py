"""Physical plans of pair queries: which rows i meet which rows j, and where.

* the reduced side small (checked: ``SMALL_BYTES``, and for ranges
  ``SMALL_RANGES``): it is sent to every task once as numpy arrays, cut by batch
  key and cluster, and the kept side streams past it.  No shuffle at all.
* both sides large: each is packed into blocks of ``BLOCK_ROWS`` rows, and a
  small table lists which blocks meet: all, those of one batch key, or those of
  two clusters that a table of ranges names.  Pairs of blocks are what is dealt
  to tasks, by a hash of key and both blocks, into a number of tasks that
  follows from the number of pairs, so a hot key or cluster is as many tasks as
  its pairs fill.  Partial states of a row are merged by hash aggregates.
* columns: a plain join and component columns, for short vectors and for SQL.

In the first two, pairs exist only inside a tile: ``TILE`` numbers in the
widest part of the formula that has rows of both sides.
"""

from __future__ import annotations

import functools
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from pairloom.functions.ops import BUILT_IN, TABLE, Precision
from pairloom.operators.reductions import EXPONENTIAL, K_LOWEST, VALUE_ARG, Reduction
from pairloom.plans.evaluate import SLICE, as_columns, folded_sums, free_of, l1_sides, on_blocks, shared_subtrees, whole_parts
from pairloom.plans.expr import PM, VI, VJ, Expr, IntCst, Var, call
from pairloom.session import checkpoints, ship

#: The streamed-past side may have at most so many bytes of vectors.
SMALL_BYTES = 64 * 1024 * 1024
#: Numbers in one tile of pairs.
TILE = 500_000
#: A tile of pairs, and candidates at a time, where the lowest are looked for by matrix products.
NEAR_ROWS, NEAR_COLUMNS, NEAR_PAIRS = 512, 2048, 20_000
#: Rows of a tile of L1 distances in bytes, steps that a component is rounded to, and components whose steps a byte adds up.
L1_ROWS, L1_STEPS, L1_GROUP = 64, 63, 4
#: Rows in a block where both sides are large.
BLOCK_ROWS = 8192
#: Numbers of pairs that a task folds where one side is small; more are dealt to more tasks.
TASK = 50_000_000
#: Rows of a table of ranges that is sent with a small side.
SMALL_RANGES = 1_000_000
#: Rows of a list of block pairs, or of keys of more than one block, that is broadcast.
SMALL_LIST = 200_000
#: Sets of parameters in one query, and states (rows times sets) that a task has at a time.
MOST_SETS, STATES = 1000, 1_000_000
#: Exponents of one bucket of sums of exponentials: e to this power is far from overflow.
BUCKET = 500.0


def matrix(column: pa.Array, dim: int) -> np.ndarray:
    """(rows, dim) of an Arrow column of numbers or of arrays of numbers; nulls are refused."""
    if isinstance(column, pa.ChunkedArray):
        column = column.combine_chunks()
    if column.null_count:
        raise ValueError("vectors must not be null")
    if pa.types.is_list(column.type) or pa.types.is_large_list(column.type):
        flat = column.flatten()
        if flat.null_count:
            raise ValueError("components must not be null")
        if len(flat) != len(column) * dim:
            raise ValueError(f"vectors of length {dim} expected")
        return flat.cast(pa.float64()).to_numpy(zero_copy_only=False).reshape(-1, dim)
    if dim != 1:
        raise ValueError(f"vectors of length {dim} expected")
    return column.cast(pa.float64()).to_numpy(zero_copy_only=False).reshape(-1, 1)


def pair_width(e: Expr | None, ordered: bool = False, folded: frozenset = frozenset()) -> int:
    """Numbers for one pair in the widest subtree that has variables of both sides.

    Distances and products of vectors are matrix products, but not where order
    decides (``ordered``): then they too go through all components.  ``folded``
    sums have a slice of their summands at a time, L1 distances a component.
    """
    if e is None or len({v.cat for v in e.variables()} & {VI, VJ}) < 2:
        return 0
    if e.key in folded:
        if l1_sides(e) is not None:
            return 1
        return max(SLICE, *(pair_width(c, ordered, folded) for c in whole_parts(e)), 0)
    inner = max((c.dim for c in e.children), default=0) if ordered and e.name in ("SqDist", "Scalprod", "WeightedSqDist", "WeightedSqNorm") else 0
    return max(e.dim, inner, *(pair_width(c, ordered, folded) for c in e.children))


def factors(e: Expr) -> list[Expr]:
    """The factors of a product of products."""
    return [f for c in e.children for f in factors(c)] if getattr(e, "name", "") == "Mult" else [e]


def split_product(e: Expr, keep: int) -> tuple[Expr, Expr | None]:
    """A product as what needs the kept side or no side, times what needs only the other side (None: nothing does)."""
    own, other = [], []
    for f in factors(e):
        (other if {v.cat for v in f.variables()} & {VI, VJ} == {VJ if keep == VI else VI} else own).append(f)
    product = lambda parts: functools.reduce(lambda a, b: call("Mult", a, b), parts)
    return product(own) if own else IntCst(1), product(other) if other else None


def own_operations(*trees: Expr | None) -> dict[str, object]:
    """The operations in the formulas that were registered beside those of this package."""
    found = {}
    for t in trees:
        if t is not None:
            if t.children and t.name in TABLE and t.name not in BUILT_IN:
                found[t.name] = TABLE[t.name]
            found |= own_operations(*t.children)
    return found


def product_form(e: Expr, keep: int) -> tuple[Expr, list[tuple[Expr, int]], float] | None:
    """A formula as sign * distance or product * factors of one side to the power 1 or -1: (SqDist or Scalprod, factors, sign).

    Such a formula is a matrix product of columns of either side.
    """
    other = VJ if keep == VI else VI
    cats = {v.cat for v in e.variables()}
    name = getattr(e, "name", "")
    if name in ("SqDist", "Scalprod"):
        a, b = ({v.cat for v in c.variables()} & {VI, VJ} for c in e.children)
        return (e, [], 1.0) if {frozenset(a), frozenset(b)} == {frozenset([keep]), frozenset([other])} and e.children[0].dim == e.children[1].dim else None
    if name == "Minus" and (found := product_form(e.children[0], keep)):
        return found[0], found[1], -found[2]
    if name not in ("Mult", "Divide") or e.dim != 1 or not {VI, VJ} <= cats:
        return None
    core, parts, sign = None, [], 1.0
    todo = [(e.children[0], 1), (e.children[1], -1 if name == "Divide" else 1)]
    while todo:
        f, power = todo.pop()
        if len({v.cat for v in f.variables()} & {VI, VJ}) < 2:
            parts.append((f, power))
        elif power == 1 and core is None and (found := product_form(f, keep)):
            core, sign = found[0], found[2]
            parts += found[1]
        elif getattr(f, "name", "") in ("Mult", "Divide"):
            todo += [(f.children[0], power), (f.children[1], -power if f.name == "Divide" else power)]
        elif getattr(f, "name", "") == "Inv":
            todo.append((f.children[0], -power))
        else:
            return None
    return (core, parts, sign) if core is not None and all(f.dim == 1 for f, _ in parts) else None


def subtrees(e: Expr) -> Iterator[Expr]:
    yield e
    for c in e.children:
        yield from subtrees(c)


def l1_form(e: Expr, keep: int) -> tuple[Expr, Expr] | None:
    """The two sides of an L1 distance, the kept one first."""
    sides = l1_sides(e)
    return sides if sides is None or any(v.cat == keep for v in sides[0].variables()) else sides[::-1]


class PairKernel:
    """Folds blocks of rows of the kept side against blocks of the reduced side.

    ``params`` has the parameters' values, or a list of sets of them: each set
    has states of its own, and what does not depend on parameters is computed
    once for all sets.
    """

    def __init__(self, formula: Expr, weight: Expr | None, reduction: Reduction, keep: int, params: dict[tuple, np.ndarray] | list[dict[tuple, np.ndarray]], chunks: bool = True):
        self.formula, self.weight, self.reduction, self.keep = formula, weight, reduction, keep
        self.sets = params if isinstance(params, list) else [params]
        self.params = self.sets[0] if self.sets else {}
        self.folded = folded_sums(formula, weight) if chunks else frozenset()
        # a sum of kernels times what only the other side has is a matrix product
        self.matrix, self.linear = formula, None
        if reduction.name == "Sum" and not reduction.exact:
            own, linear = split_product(formula, keep)
            if linear is not None and own.dim == 1 and linear.dim == formula.dim:
                self.matrix, self.linear = own, linear
        self.form = product_form(formula, keep) if reduction.name in K_LOWEST and formula.dim == 1 else None
        self.l1 = l1_form(formula, keep) if reduction.name in K_LOWEST and formula.dim == 1 else None
        self.l1_trees = [e for t in (formula, weight) if t is not None for e in subtrees(t) if e.key in self.folded]
        self.one_sided = weight is not None and all(v.cat != keep for v in weight.variables())
        self.free = free_of([self.matrix, self.linear, weight], PM) if len(self.sets) > 1 else frozenset()
        self.own = own_operations(formula, weight)  # workers know those of this package only

    def values(self, kept: dict[tuple, np.ndarray], other: dict[tuple, np.ndarray], params: dict | None = None) -> dict[tuple, np.ndarray]:
        out = {k: v[None, None] for k, v in (self.params if params is None else params).items()}
        return out | {k: v[:, None] for k, v in kept.items()} | {k: v[None] for k, v in other.items()}

    def start(self, rows: int) -> list:
        return [self.reduction.start(rows) for _ in self.sets]

    def fold(self, state, kept, other, ids: np.ndarray):
        return self.fold_sets([state], kept, other, ids, [self.params])[0]

    def fold_sets(self, states: list, kept, other, ids: np.ndarray, sets: list[dict] | None = None) -> list:
        """States of each set of parameters after ``ids``."""
        sets = self.sets if sets is None else sets
        for name, operation in self.own.items():
            TABLE.setdefault(name, operation)
        Precision.ordered = self.reduction.name in K_LOWEST or self.reduction.name in VALUE_ARG
        if not states:
            return states
        if self.form is not None and len(sets) == 1 and len(ids) and (found := self._nearest(states[0], kept, other, ids, sets[0])) is not None:
            return [found]
        if self.l1 is not None and len(sets) == 1 and len(ids) and (found := self._nearest_l1(states[0], kept, other, ids, sets[0])) is not None:
            return [found]
        rows, width = len(next(iter(states[0]))), max(self.matrix.dim, pair_width(self.matrix, Precision.ordered, self.folded), pair_width(self.weight, False, self.folded), 1)
        n = len(ids)
        # the folded sums of L1 distances go along rows of a tile
        high = 128 if any(l1_sides(e) is not None for e in self.l1_trees) else 1024
        step = max(1, min(n, TILE // max(1, min(rows, high) * width)))
        tall = max(1, TILE // max(1, step * width))
        parts = [[] for _ in sets]
        for a in range(0, rows, tall):
            pieces = [tuple(x[a : a + tall] for x in state) for state in states]
            mine = {k: v[a : a + tall] for k, v in kept.items()}
            size = min(tall, rows - a)
            for b in range(0, n, step):
                theirs = {k: v[b : b + step] for k, v in other.items()}
                cols, same = min(step, n - b), {}
                for t, params in enumerate(sets):
                    there = self.values(mine, theirs, params)
                    evaluate = lambda e, rows: np.broadcast_to(on_blocks(e, there, self.folded, same, self.free), (rows, cols, e.dim))  # noqa: B023, E731
                    if self.linear is not None:
                        with np.errstate(all="ignore"):
                            total, lost = pieces[t]
                            pieces[t] = total + evaluate(self.matrix, size)[..., 0] @ evaluate(self.linear, 1)[0], lost
                        continue
                    g = evaluate(self.weight, 1 if self.one_sided else size) if self.weight is not None else None
                    pieces[t] = self.reduction.update(pieces[t], evaluate(self.formula, size), ids[b : b + step], g)
            for found, piece in zip(parts, pieces, strict=True):
                found.append(piece)
        return [tuple(np.concatenate(x) for x in zip(*found, strict=True)) if found else state for found, state in zip(parts, states, strict=True)]


    def _columns(self, kept, other, params) -> tuple[np.ndarray, np.ndarray]:
        """(rows, m), (n, m): columns of either side whose products are the formula, up to rounding."""
        core, parts, sign = self.form
        there = self.values(kept, other, params)
        a, b = (e for e in core.children)
        if any(v.cat == self.keep for v in b.variables()):
            a, b = b, a
        x, y = on_blocks(a, there)[:, 0], on_blocks(b, there)[0]
        if core.name == "SqDist":
            m = y.mean(0)
            x, y = x - m, y - m
            one = lambda v: np.ones((len(v), 1))
            x, y = np.concatenate([(x * x).sum(1, keepdims=True), one(x), -2 * x], 1), np.concatenate([one(y), (y * y).sum(1, keepdims=True), y], 1)
        x = sign * x
        for f, power in parts:
            v = on_blocks(f, there)
            if any(u.cat == (VJ if self.keep == VI else VI) for u in f.variables()):
                y = y * v[0] if power == 1 else y / v[0]
            else:
                x = x * v[:, 0] if power == 1 else x / v[:, 0]
        return x, y

    def _nearest(self, state, kept, other, ids: np.ndarray, params: dict):
        """The K lowest after ``ids``, where the formula is a matrix product; None where that is not finite.

        A product in single precision with a bound of its error says which pairs
        may be among the lowest; only those are computed as the formula says.
        """
        with np.errstate(all="ignore"):
            x, y = self._columns(kept, other, params)
            a, b = np.sqrt((x * x).sum(1)), np.sqrt((y * y).sum(1))
            top, most = a.max(initial=0.0), b.max(initial=0.0)
            unit = top * most
            if not (1e-100 < unit < 1e100 and 1e-100 < top < 1e100 and 1e-100 < most < 1e100):
                return None
        k, m = self.reduction.k, x.shape[1]
        x, y = (x / top).astype(np.float32), np.ascontiguousarray((y / most).astype(np.float32).T)
        error = 4 * (m + 8) * 2.0**-24 * (a / top) + 1e-30
        values, places = state[0][:, 0].copy(), state[1][:, 0].copy()
        for r in range(0, len(x), NEAR_ROWS):
            v, i, mine = values[r : r + NEAR_ROWS], places[r : r + NEAR_ROWS], slice(r, r + NEAR_ROWS)
            wide = error[mine]
            for c in range(0, len(ids), NEAR_COLUMNS):
                near = x[mine] @ y[:, c : c + NEAR_COLUMNS]
                edge = v[:, k - 1] / unit + wide
                if near.shape[1] > k and np.isinf(edge).any():
                    edge = np.minimum(edge, np.partition(near, k - 1, 1)[:, k - 1] + 2 * wide)
                at = np.flatnonzero(near <= np.nextafter(edge.astype(np.float32), np.float32(np.inf))[:, None])
                self._lowered(v, i, at, near.shape[1], {n: z[mine] for n, z in kept.items()}, {n: z[c : c + NEAR_COLUMNS] for n, z in other.items()}, ids[c : c + NEAR_COLUMNS], params)
        return values[:, None], places[:, None]

    def _nearest_l1(self, state, kept, other, ids: np.ndarray, params: dict):
        """The K lowest L1 distances after ``ids``; None where vectors are not finite or very long.

        Components are cut to where most of them are and rounded to ``L1_STEPS``
        steps, so that sums of a few fit into bytes.  Cutting never lengthens a
        difference, and what rounding takes from either row is known: so the
        whole numbers bound the distance from below, and only pairs that may be
        among the lowest are computed as the formula says.
        """
        there = self.values(kept, other, params)
        x, y = on_blocks(self.l1[0], there)[:, 0], on_blocks(self.l1[1], there)[0]
        k, dim = self.reduction.k, x.shape[1]
        if dim * L1_STEPS > np.iinfo(np.int16).max or not (np.isfinite(x).all() and np.isfinite(y).all()):
            return None
        with np.errstate(all="ignore"):
            some = y[:: max(1, len(y) // 1000)]  # where steps lie decides what is computed, not the result
            middle = np.median(some, 0)
            step = 2 * np.quantile(np.abs(some - middle), 0.99) / L1_STEPS
        if not 1e-100 < step < 1e100 or not np.isfinite(middle).all():
            return None
        steps, lost = [], []
        for side in (x, y):
            cut = np.clip((side - middle) / step + L1_STEPS / 2, 0, L1_STEPS)
            whole = np.rint(cut)
            steps.append(np.ascontiguousarray(whole.T.astype(np.uint8)))
            lost.append(np.abs(cut - whole).sum(1))
        mine, theirs = steps
        # the sum of differences is twice the sum of greater ones less both sums; all in steps
        own, half = mine.sum(0, dtype=np.int64), (theirs.sum(0, dtype=np.int64) // 2).astype(np.int16)
        # what rounding of doubles may take from cut components; what it takes from the formula's sum is in proportion to that
        error = lost[0] + lost[1].max() + 1e-12 * dim * (L1_STEPS + np.abs(middle).max() / step)
        values, places = state[0][:, 0].copy(), state[1][:, 0].copy()
        for c in range(0, len(ids), NEAR_COLUMNS):
            columns = slice(c, c + NEAR_COLUMNS)
            right, some, width = theirs[:, None, columns], {n: z[columns] for n, z in other.items()}, len(ids[columns])
            for r in range(0, len(x), L1_ROWS):
                rows = slice(r, r + L1_ROWS)
                near = _greater_sums(mine[:, rows, None], right)
                near -= half[columns]
                v, i, few = values[rows], places[rows], {n: z[rows] for n, z in kept.items()}
                edge = v[:, k - 1].copy()
                if width > k and np.isinf(edge).any():  # any k pairs bound the k-th lowest
                    at = np.argpartition(near, k - 1, 1)[:, :k]
                    found = self._pairs(np.repeat(np.arange(len(v)), k), at.ravel(), few, some, params).reshape(-1, k)
                    edge = np.minimum(edge, np.where(np.isnan(found), np.inf, found).max(1))
                most = ((edge / step) * (1 + 1e-12 * dim) + error[rows] + own[rows]) / 2 + 1
                at = np.flatnonzero(near <= np.clip(np.floor(most), -1, np.iinfo(np.int16).max).astype(np.int16)[:, None])
                self._lowered(v, i, at, width, few, some, ids[columns], params)
        return values[:, None], places[:, None]

    def _pairs(self, row: np.ndarray, col: np.ndarray, kept: dict, other: dict, params: dict) -> np.ndarray:
        """The formula's values of single pairs."""
        there = self.values({n: z[row] for n, z in kept.items()}, {}, params) | {n: z[col][:, None] for n, z in other.items()}
        with np.errstate(all="ignore"):
            return np.broadcast_to(on_blocks(self.formula, there, self.folded), (len(row), 1, 1))[:, 0, 0]

    def _lowered(self, v: np.ndarray, i: np.ndarray, at: np.ndarray, width: int, kept: dict, other: dict, ids: np.ndarray, params: dict) -> None:
        """Puts the pairs at places ``at`` of a tile into the lowest values ``v`` and their indices ``i``."""
        k = v.shape[1]
        for p in range(0, len(at), NEAR_PAIRS):
            row, col = np.divmod(at[p : p + NEAR_PAIRS], width)
            f = self._pairs(row, col, kept, other, params)
            fine = f < np.inf
            row, f, j = row[fine], f[fine], ids[col[fine]]
            touched = np.unique(row)
            row = np.concatenate([np.repeat(touched, k), row])
            f, j = np.concatenate([v[touched].ravel(), f]), np.concatenate([i[touched].ravel(), j])
            order = np.lexsort((np.where(f < np.inf, j, np.iinfo(np.int64).max), f, row))
            row, f, j = row[order], f[order], j[order]
            first = np.flatnonzero(np.r_[True, row[1:] != row[:-1]]) if len(row) else np.zeros(0, np.int64)
            rank = np.arange(len(row)) - np.repeat(first, np.diff(np.r_[first, len(row)]))
            v[touched] = f[rank < k].reshape(-1, k)
            i[touched] = j[rank < k].reshape(-1, k)


def _greater_sums(x: np.ndarray, y: np.ndarray) -> np.ndarray:
    """(rows, columns): sums over components of the greater of either side's; (components, rows, 1) and (components, 1, columns) bytes."""
    shape = (x.shape[1], y.shape[2])
    total, wide, few, one = np.zeros(shape, np.int16), np.empty(shape, np.int16), np.empty(shape, np.uint8), np.empty(shape, np.uint8)
    for a in range(0, len(x), L1_GROUP):
        np.maximum(x[a], y[a], few)
        for d in range(a + 1, min(a + L1_GROUP, len(x))):
            np.maximum(x[d], y[d], one)
            np.add(few, one, few)
        wide[...] = few
        np.add(total, wide, total)
    return total


def _sorted_side(ids: np.ndarray, vectors: dict[tuple, np.ndarray]):
    order = np.argsort(ids, kind="stable")
    return ids[order], {k: v[order] for k, v in vectors.items()}


def _vars(exprs: list[Expr | None], cat: int) -> list[Var]:
    found: dict[tuple, Var] = {}
    for e in exprs:
        if e is not None:
            for v in e.variables():
                if v.cat == cat:
                    found.setdefault(v.key, v)
    return list(found.values())


def name_of(v: Var) -> str:
    return v.name or f"v{v.ind}"


def _ids_type(df: DataFrame, name: str) -> Column:
    return F.col(name).cast("long").alias(name)


def bound_parameters(exprs: list[Expr | None], params: dict[str, object] | None) -> dict[tuple, np.ndarray]:
    """The value of each parameter of the formulas, by its key; a missing one or a wrong length is an error."""
    given = {k: np.atleast_1d(np.asarray(v, float)) for k, v in (params or {}).items()}
    own = {}
    for v in _vars(exprs, PM):
        if name_of(v) not in given:
            raise ValueError(f"no value for parameter {name_of(v)}")
        own[v.key] = given[name_of(v)]
        if len(own[v.key]) != v.dim:
            raise ValueError(f"parameter {name_of(v)} has length {len(own[v.key])}, not {v.dim}")
    return own


def _parameter_sets(exprs: list[Expr | None], table: DataFrame, key: str | None) -> tuple[tuple[str, pa.Array, DataFrame], list[dict]]:
    """((key, its values, a table of them), the values of each set)."""
    if key is None or key not in table.columns:
        raise ValueError("a table of parameters needs params_key, the column that names its rows")
    names = list(dict.fromkeys(name_of(v) for v in _vars(exprs, PM)))
    if missing := [n for n in names if n not in table.columns]:
        raise ValueError(f"no value for parameter {missing[0]}")
    rows = fetched(table.select(key, *names), MOST_SETS)
    if rows is None:
        raise ValueError(f"more than {MOST_SETS} sets of parameters")
    keys = rows[key].combine_chunks()
    if keys.null_count or len(keys.unique()) < len(keys):
        raise ValueError("names of sets of parameters must be distinct and not null")
    sets = [bound_parameters(exprs, {n: row[n] for n in names}) for row in rows.to_pylist()]
    return (key, keys, F.broadcast(table.select(key))), sets


def reduce_pairs(
    formula: Expr,
    reduction: Reduction,
    left: DataFrame,
    right: DataFrame,
    keep: int = VI,
    weight: Expr | None = None,
    params: dict[str, object] | DataFrame | None = None,
    left_id: str = "i",
    right_id: str = "j",
    batch: list[str] = (),
    ranges: DataFrame | None = None,
    strategy: str = "auto",
    params_key: str | None = None,
    enable_chunks: bool = True,
) -> DataFrame:
    """(batch keys, id of the kept side, value and/or index): every row of the kept side once.

    ``left`` has id ``left_id`` and a column for each Vi, ``right`` ``right_id``
    and the Vj.  ``ranges`` is a table (bi, bj): only blocks listed meet; then
    ``left`` has a column bi and ``right`` bj.  Batch keys missing on a side
    repeat it for all.  ``strategy``: auto, small, blocks or columns.
    ``params`` may be a table of at most ``MOST_SETS`` rows, one for each set of
    values, named by its column ``params_key``, which the result then has: all
    sets are served by one pass over both sides.  ``enable_chunks``: wide sums
    over components are folded by slices.
    """
    spark = ship(left.sparkSession)
    exprs = [formula, weight]
    kept_df, other_df = (left, right) if keep == VI else (right, left)
    kept_id, other_id = (left_id, right_id) if keep == VI else (right_id, left_id)
    kept_vars, other_vars = _vars(exprs, keep), _vars(exprs, VJ if keep == VI else VI)
    named, sets = None, bound_parameters(exprs, params) if not isinstance(params, DataFrame) else None
    if sets is None:
        named, sets = _parameter_sets(exprs, params, params_key)
        if strategy == "columns":
            raise ValueError("columns take one set of parameters")
    kernel = PairKernel(formula, weight, reduction, keep, sets, enable_chunks)
    kept_keys = [k for k in batch if k in kept_df.columns]
    other_keys = [k for k in batch if k in other_df.columns]
    keys = list(dict.fromkeys(kept_keys + other_keys))
    if reduction.name == "Zero":
        base = kept_df.select(*kept_keys, _ids_type(kept_df, kept_id))
        if set(keys) - set(kept_keys):
            base = base.crossJoin(other_df.select(*[k for k in keys if k not in kept_keys]).distinct())
        if named:
            base, keys = base.crossJoin(named[2]), [named[0], *keys]
        return base.select(*keys, kept_id, F.array_repeat(F.lit(0.0), reduction.dim).alias("value"))
    # column pruning: only ids, keys and bound vectors travel
    k_block, o_block = ("bi", "bj") if keep == VI else ("bj", "bi")
    in_ranges = ranges is not None
    kept = kept_df.select(*kept_keys, _ids_type(kept_df, kept_id), *([F.col(k_block)] if in_ranges else []), *dict.fromkeys(name_of(v) for v in kept_vars))
    other = other_df.select(*other_keys, _ids_type(other_df, other_id), *([F.col(o_block)] if in_ranges else []), *dict.fromkeys(name_of(v) for v in other_vars))
    meet = ranges.select(F.col(k_block).alias("_mine_block"), F.col(o_block).alias("_theirs_block")).distinct() if in_ranges else None
    if in_ranges:
        kept, other = kept.withColumnRenamed(k_block, "_mine_block"), other.withColumnRenamed(o_block, "_theirs_block")
    sides = (kernel, kept, other, kept_vars, other_vars, kept_id, other_id, kept_keys, other_keys, keys, meet)
    if reduction.name == "Sum" and not keys and not in_ranges and not named and strategy != "columns" and (whole := _by_factors(*sides[:7])) is not None:
        return whole
    if strategy in ("auto", "small") and (whole := small_side(other, other_vars)) is not None:
        listed = fetched(meet, SMALL_RANGES) if in_ranges else None
        if listed is not None or not in_ranges:
            return _finish(reduction, _by_small_side(spark, *sides[:-1], listed, whole, named), [*([named[0]] if named else []), *keys], kept_id)
    if strategy == "columns":
        partial = _by_columns(*sides)
        if reduction.exact:
            partial = _fewer(partial, [*keys, kept_id], reduction)
    else:
        partial = _fewer(_by_blocks(*sides, named), [*([named[0]] if named else []), *keys, kept_id], reduction)
    own_keys = [k for k in keys if k not in kept_keys]
    if named:
        keys = [named[0], *keys]
    merged = partial.groupBy(*keys, kept_id).agg(reduction.merge("partial").alias("partial"))
    # rows that no pair covers get the neutral value
    base = kept.select(*kept_keys, kept_id)
    if own_keys:
        base = base.crossJoin(other.select(*own_keys).distinct())
    if named:
        base = base.crossJoin(named[2])
    full = base.join(merged, [*keys, kept_id], "left").withColumn("partial", F.coalesce("partial", reduction.neutral()))
    return _finish(reduction, full, keys, kept_id)


def _by_factors(kernel: PairKernel, kept, other, kept_vars, other_vars, kept_id, other_id) -> DataFrame | None:
    """(id, value) where each factor of the formula needs one side: its factors times one sum over the other side.

    So no pair is made.  None where a factor needs both sides, or where the sum
    is not finite or may overflow, which sums over pairs need not.
    """
    own, theirs = split_product(kernel.formula, kernel.keep)
    if theirs is None or any(v.cat not in (kernel.keep, PM) for v in own.variables()) or kernel.own:
        return None
    kind, dim = kernel.reduction, kernel.formula.dim
    part = Reduction("Sum", theirs.dim, scheme=kind.scheme)
    there = {k: v[None, None] for k, v in kernel.params.items()}

    def fold(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        # sums, the number of rows, whether there are zeros, positive and negative numbers, and the largest in size
        state, seen = part.start(1), np.zeros((5, theirs.dim))
        for b in batches:
            for a in range(0, b.num_rows, TILE // theirs.dim):
                piece = b.slice(a, TILE // theirs.dim)
                with np.errstate(all="ignore"):
                    g = np.broadcast_to(on_blocks(theirs, there | {k: v[None] for k, v in _table(piece, other_vars).items()}), (1, piece.num_rows, theirs.dim))
                state = part.update(state, g, np.zeros(0, np.int64), None)
                seen[0] += piece.num_rows
                seen[1:] = np.maximum(seen[1:], [*(x.any(1)[0] for x in (g == 0, g > 0, g < 0)), np.abs(g).max(1)[0]])
        yield pa.RecordBatch.from_arrays([pa.array(part.partial(state), pa.list_(pa.float64())), pa.array([seen.ravel().tolist()], pa.list_(pa.float64())), pa.array([0])], ["partial", "seen", "one"])

    found = other.mapInArrow(fold, "partial array<double>, seen array<double>, one long")
    checkpoints(kept.sparkSession)
    found = found.checkpoint()  # a row for each task
    marks = found.agg(*((F.max if n >= theirs.dim else F.sum)(F.col("seen")[n]).alias(f"m{n}") for n in range(5 * theirs.dim))).first()
    if not marks[0]:
        return kept.select(kept_id, F.array_repeat(F.lit(0.0), dim).alias("value"))
    seen = np.array(marks, float).reshape(5, theirs.dim)
    if not (seen[4] < 1e300 / seen[0]).all():
        return None
    sums = _fewer(found.select("one", "partial"), ["one"], part).groupBy("one").agg(part.merge("partial").alias("partial")).first()["partial"]
    total, lost = np.array(sums[: theirs.dim]), np.array(sums[theirs.dim :] or [0.0] * theirs.dim)
    # what an infinite factor makes of the sum: its sign, or no number
    with np.errstate(all="ignore"):
        endless = np.where((seen[1] > 0) | ((seen[2] > 0) & (seen[3] > 0)), np.nan, np.where(seen[2] > 0, np.inf, -np.inf))

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in batches:
            if b.num_rows:
                with np.errstate(all="ignore"):
                    f = np.broadcast_to(on_blocks(own, there | {k: v[:, None] for k, v in _table(b, kept_vars).items()}), (b.num_rows, 1, own.dim))[:, 0]
                    v = np.where(np.isfinite(f), f * total + f * lost, f * endless)
                yield pa.RecordBatch.from_arrays([b[kept_id], pa.array(np.broadcast_to(v, (b.num_rows, dim)).tolist(), pa.list_(pa.float64()))], [kept_id, "value"])

    return kept.mapInArrow(run, f"{kept_id} long, value array<double>")


def _fewer(partial: DataFrame, by: list[str], reduction: Reduction) -> DataFrame:
    """A bounded number of states for each row, whatever the number of blocks they come from."""
    if reduction.name in EXPONENTIAL:
        return _summed_by_bucket(partial, by, reduction.weight_dim)
    if reduction.name in K_LOWEST:
        return _lowest_of_each(partial, by, reduction.dim, reduction.k)
    if reduction.exact:
        return _summed_exactly(partial, by, reduction.dim)
    return partial


def _finish(reduction: Reduction, df: DataFrame, keys: list[str], kept_id: str) -> DataFrame:
    return df.select(*keys, kept_id, *(c.alias(n) for n, c in reduction.finish("partial").items()))


def fetched(df: DataFrame, most: int) -> pa.Table | None:
    """All rows, if they are at most ``most``; else None.

    What Spark expects to be small is fetched at once, up to one row too many;
    anything else is counted first, by rows without columns.
    """
    try:
        expected = int(df._jdf.queryExecution().optimizedPlan().stats().sizeInBytes())
    except ValueError:  # products of sizes may have more digits than a number is read from
        expected = 5 * SMALL_BYTES
    if expected > 4 * SMALL_BYTES and df.select(F.lit(1)).limit(most + 1).count() > most:
        return None
    rows = df.limit(most + 1).toArrow()
    return rows if rows.num_rows <= most else None


def small_side(df: DataFrame, variables: list[Var]) -> pa.Table | None:
    return fetched(df, SMALL_BYTES // (8 * (1 + sum(v.dim for v in variables))))


def _table(batch: pa.RecordBatch | pa.Table, variables: list[Var]) -> dict[tuple, np.ndarray]:
    return {v.key: matrix(batch[name_of(v)], v.dim) for v in variables}


def _by_small_side(spark, kernel, kept, other, kept_vars, other_vars, kept_id, other_id, kept_keys, other_keys, keys, listed: pa.Table | None, whole: pa.Table, named: tuple | None = None) -> DataFrame:
    """(keys, id, partial): the state of every row of the kept side, complete; ``whole`` has all rows of the other.

    The other side is cut by the tags that have to agree (shared keys, or the
    cluster) and, within those, by the keys that only it has: a row of the kept
    side meets each of the latter on its own.  A null key meets nothing.
    """
    shared, own = [k for k in kept_keys if k in other_keys], [k for k in other_keys if k not in kept_keys]
    ranged = listed is not None
    tags = [*shared, *(["_theirs_block"] if ranged else []), *own]
    there: dict[tuple, dict[tuple, tuple]] = {}
    size = len(tags) - len(own)
    for tag, rows in _grouped(whole, tags):
        part = whole.take(rows) if tags else whole
        there.setdefault(tag[:size], {})[tag[size:]] = _sorted_side(part[other_id].to_numpy().astype(np.int64), _table(part, other_vars))
    others = sorted({t for x in there.values() for t in x}, key=repr) if own else [()]
    partners: dict[object, list] = {}
    if ranged:
        for a, b in zip(listed["_mine_block"].to_pylist(), listed["_theirs_block"].to_pylist(), strict=True):
            partners.setdefault(a, []).append(b)
    sent = spark.sparkContext.broadcast((there, partners))
    reduction = kernel.reduction
    # a small file is one partition however many pairs its rows make
    work = max(1, whole.num_rows // max(1, 1 if ranged else len(there))) * max(pair_width(kernel.formula, reduction.name in K_LOWEST or reduction.name in VALUE_ARG), 1)
    most = 8 * spark.sparkContext.defaultParallelism
    if work * 1000 > TASK and (tasks := -(-kept.select(F.lit(1)).limit(most * TASK // work + 1).count() * work // TASK)) > 1:
        tasks = int(min(tasks, most))
        # rows of a cluster meet their partners together; ranges of ids cut a hot cluster
        kept = kept.repartitionByRange(tasks, "_mine_block", kept_id).sortWithinPartitions("_mine_block") if ranged else kept.repartition(tasks)
    kind = reduction.partial_type
    named, told = named and named[:2], named

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        there, partners = sent.value
        for b in batches:
            for tag, rows in _grouped(b, [*shared, *(["_mine_block"] if ranged else [])]) if b.num_rows else ():
                mine = b.take(rows) if len(rows) < b.num_rows else b
                places = [(*tag[:-1], block) for block in partners.get(tag[-1], ())] if ranged else [tag]
                for extra in others:
                    found = [x for place in places if None not in place and (x := there.get(place, {}).get(extra)) is not None]
                    only = dict(zip(own, extra, strict=True))
                    columns = [pa.array([only[k]] * mine.num_rows, types[k]) if k in only else mine[k] for k in keys]
                    yield from _states(kernel, _table(mine, kept_vars), found, mine.num_rows, [*columns, mine[kept_id]], [*keys, kept_id], named and named[:2])

    types = {k: whole.schema.field(k).type for k in own}
    return kept.mapInArrow(run, _schema(kept, other, keys, kept_id, kind, told))


def _schema(kept: DataFrame, other: DataFrame, keys: list[str], kept_id: str, kind: str, named: tuple | None) -> str:
    kinds = {f.name: f.dataType.simpleString() for df in (kept, other, *([named[2]] if named else [])) for f in df.schema}
    return ", ".join([*(f"{k} {kinds[k]}" for k in ([named[0]] if named else []) + keys), f"{kept_id} long", f"partial {kind}"])


def _joined(others: list[tuple]) -> Iterator[tuple]:
    """(ids, vectors) of many small parts as few of up to ``BLOCK_ROWS`` rows, or one that is larger."""
    held, size = [], 0
    for part in others:
        if held and size + len(part[0]) > BLOCK_ROWS:
            yield _one(held)
            held, size = [], 0
        held.append(part)
        size += len(part[0])
    if held:
        yield _one(held)


def _one(parts: list[tuple]) -> tuple:
    return parts[0] if len(parts) == 1 else _sorted_side(np.concatenate([p[0] for p in parts]), {k: np.concatenate([p[1][k] for p in parts]) for k in parts[0][1]})


def _states(kernel: PairKernel, mine: dict, others: list[tuple], count: int, columns: list, names: list[str], named: tuple | None) -> Iterator[pa.RecordBatch]:
    """Partial states of ``count`` rows that meet ``others`` (ids, vectors); for each set of parameters where those have names."""
    kind = kernel.reduction.partial_type
    few = max(1, STATES // max(1, count))
    for a in range(0, len(kernel.sets), few):
        sets = kernel.sets[a : a + few]
        states = [kernel.reduction.start(count) for _ in sets]
        for ids, there in _joined(others):
            states = kernel.fold_sets(states, mine, there, ids, sets)
        for t, state in enumerate(states):
            name = [named[1].slice(a + t, 1).take(pa.array(np.zeros(count, np.int64)))] if named else []
            yield _rows([*name, *columns], [*([named[0]] if named else []), *names], kernel.reduction.partial(state), kind)


def _grouped(table: pa.RecordBatch | pa.Table, tags: list[str]) -> list[tuple[tuple, pa.Array]]:
    """Each combination of ``tags`` and the places of its rows."""
    if not tags:
        return [((), pa.array(np.arange(table.num_rows)))]
    found: dict[tuple, list[int]] = {}
    for at, tag in enumerate(zip(*(table[t].to_pylist() for t in tags), strict=True)):
        found.setdefault(tag, []).append(at)
    return [(tag, pa.array(rows)) for tag, rows in found.items()]


def _rows(columns: list, names: list[str], partial: list, kind: str) -> pa.RecordBatch:
    types = {
        "array<double>": pa.list_(pa.float64()),
        "array<array<struct<v:double,i:bigint>>>": pa.list_(pa.list_(pa.struct([("v", pa.float64()), ("i", pa.int64())]))),
        "struct<m:double,s:array<double>>": pa.struct([("m", pa.float64()), ("s", pa.list_(pa.float64()))]),
    }
    return pa.RecordBatch.from_arrays([*columns, pa.array(partial, types[kind])], [*names, "partial"])


def _bounded(df: DataFrame) -> DataFrame:
    """``df``, to be broadcast if its rows are counted to be at most ``SMALL_LIST``."""
    return F.broadcast(df) if df.select(F.lit(1)).limit(SMALL_LIST + 1).count() <= SMALL_LIST else df


def _packed(df: DataFrame, tags: list[str], counts: DataFrame, row_id: str, part: str, prefix: str) -> DataFrame:
    """One row per block: its tags, the number of its part, and the structs of its rows."""
    # tags of one block need no look-up: what is left has at most a row for each BLOCK_ROWS rows of ``df``
    large = _bounded(counts.where(F.col("_many") > 1))
    df = df.join(large, tags, "left") if tags else df.crossJoin(F.broadcast(counts))
    cols = [c for c in df.columns if c not in (*tags, "_many")]
    df = df.withColumn(part, F.pmod(F.xxhash64(row_id), F.coalesce("_many", F.lit(1))))
    return df.groupBy(*tags, part).agg(F.collect_list(F.struct(*cols)).alias(prefix))


def met_blocks(kept: DataFrame, other: DataFrame, kept_id: str, other_id: str, kept_keys: list[str], other_keys: list[str], meet: DataFrame | None) -> DataFrame:
    """(tags, mine, theirs): each pair of blocks that meet, dealt to tasks by its tags and parts."""
    mine_tags = [*kept_keys, *(["_mine_block"] if meet is not None else [])]
    their_tags = [*other_keys, *(["_theirs_block"] if meet is not None else [])]
    shared = [k for k in kept_keys if k in other_keys]
    spark = kept.sparkSession
    checkpoints(spark)
    tasks = max(int(spark.conf.get("spark.sql.shuffle.partitions")), 8 * spark.sparkContext.defaultParallelism)
    many = F.ceil(F.count(F.lit(1)) / BLOCK_ROWS).cast("long").alias("_many")
    a_counts, b_counts = kept.groupBy(*mine_tags).agg(many).checkpoint(), other.groupBy(*their_tags).agg(many).checkpoint()
    # which blocks meet: numbers only; a key's parts are spread before their partners are listed
    a, b = a_counts.withColumnRenamed("_many", "_a"), b_counts.withColumnRenamed("_many", "_b")
    if meet is not None:
        a = a.join(meet, "_mine_block")
    on = [*shared, *(["_theirs_block"] if meet is not None else [])]
    both = a.join(b, on) if on else a.crossJoin(b)
    spread = both.select("*", F.explode(F.sequence(F.lit(0).cast("long"), F.col("_a") - 1)).alias("_mine_part")).where("_a > 0 AND _b > 0")
    tags = list(dict.fromkeys([*mine_tags, *their_tags]))
    listed = spread.repartition(*tags, "_mine_part").select(*tags, "_mine_part", F.explode(F.sequence(F.lit(0).cast("long"), F.col("_b") - 1)).alias("_theirs_part")).checkpoint()
    pairs = listed.count()
    tasks = max(1, min(pairs, tasks))
    place = [*tags, "_mine_part", "_theirs_part"]
    if pairs <= SMALL_LIST:
        listed = F.broadcast(listed)
    mine = _packed(kept, mine_tags, a_counts, kept_id, "_mine_part", "mine").join(listed, [*mine_tags, "_mine_part"])
    theirs = _packed(other, their_tags, b_counts, other_id, "_theirs_part", "theirs").join(listed, [*their_tags, "_theirs_part"])
    # a number of partitions that is given is not coalesced by bytes, which say nothing about pairs
    return mine.repartition(tasks, *place).join(theirs.repartition(tasks, *place), place)


def unpacked(batch: pa.RecordBatch, row: int) -> tuple[pa.RecordBatch, pa.RecordBatch]:
    """The rows of the two blocks that one row of ``met_blocks`` holds."""
    return tuple(pa.RecordBatch.from_struct_array(batch[c].slice(row, 1).flatten()) for c in ("mine", "theirs"))


def _by_blocks(kernel, kept, other, kept_vars, other_vars, kept_id, other_id, kept_keys, other_keys, keys, meet, named: tuple | None = None) -> DataFrame:
    """(keys, id, partial): a state of a kept row for each block that it meets, and for each set of parameters."""
    met = met_blocks(kept, other, kept_id, other_id, kept_keys, other_keys, meet)
    schema, named = _schema(kept, other, keys, kept_id, kernel.reduction.partial_type, named), named and named[:2]

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for r in range(batch.num_rows):
                mine, theirs = unpacked(batch, r)
                side = _sorted_side(theirs[other_id].to_numpy(), _table(theirs, other_vars))
                tags = [batch[k].slice(r, 1).take(pa.array(np.zeros(mine.num_rows, np.int64))) for k in keys]
                yield from _states(kernel, _table(mine, kept_vars), [side], mine.num_rows, [*tags, mine[kept_id]], [*keys, kept_id], named)

    return met.select(*keys, "mine", "theirs").mapInArrow(run, schema)


def _by_columns(kernel, kept, other, kept_vars, other_vars, kept_id, other_id, kept_keys, other_keys, keys, meet) -> DataFrame:
    """A join and component columns: all in the JVM."""
    a = kept.select(*[F.col(c).alias(f"a_{c}") for c in kept.columns])
    b = other.select(*[F.col(c).alias(f"b_{c}") for c in other.columns])
    cond = [F.col(f"a_{k}") == F.col(f"b_{k}") for k in kept_keys if k in other_keys]
    if meet is not None:
        a = a.join(meet, F.col("a__mine_block") == F.col("_mine_block"))
        cond.append(F.col("_theirs_block") == F.col("b__theirs_block"))
    if cond:
        both = cond[0]
        for c in cond[1:]:
            both = both & c
        pairs = a.join(b, both)
    else:
        pairs = a.crossJoin(b)

    def parts(prefix: str, v: Var) -> list[Column]:
        c = F.col(f"{prefix}_{name_of(v)}")
        array = pairs.schema[f"{prefix}_{name_of(v)}"].dataType.typeName() == "array"
        return [(c[d] if array else c).cast("double") for d in range(v.dim)]

    values = {v.key: parts("a", v) for v in kept_vars} | {v.key: parts("b", v) for v in other_vars}
    values |= {k: [F.lit(float(x)) for x in v] for k, v in kernel.params.items()}
    # what occurs more than once becomes columns, which later ones refer to
    for n, e in enumerate(shared_subtrees(*(x for x in (kernel.formula, kernel.weight) if x is not None))):
        names = [f"_s{n}_{d}" for d in range(e.dim)]
        pairs = pairs.withColumns(dict(zip(names, as_columns(e, values), strict=True)))
        values[e.key] = [F.col(c) for c in names]
    r = kernel.reduction
    f = as_columns(kernel.formula, values)
    j = F.col(f"b_{other_id}")
    if r.name == "Sum":
        partial = F.array(*f, *([F.lit(0.0)] * len(f) if r.exact else []))
    elif r.name in EXPONENTIAL:
        g = as_columns(kernel.weight, values) if kernel.weight is not None else [F.lit(1.0)]
        # a term on its own: its exponent and its weight
        partial = F.struct(f[0].alias("m"), F.array(*(F.when(f[0] == F.lit(float("-inf")), F.lit(0.0)).otherwise(x) for x in g)).alias("s"))
    else:
        sign = -1.0 if r.name in ("Max", "ArgMax", "Max_ArgMax") else 1.0
        one = lambda c: F.when(F.isnan(c), F.array().cast("array<struct<v:double,i:bigint>>")).otherwise(F.array(F.struct((sign * c).alias("v"), j.alias("i"))))
        partial = F.array(*map(one, f))
    tag = [(F.col(f"a_{k}") if k in kept_keys else F.col(f"b_{k}")).alias(k) for k in keys]
    terms = pairs.select(*tag, F.col(f"a_{kept_id}").alias(kept_id), partial.alias("partial"))
    if r.name in EXPONENTIAL:
        return _summed_by_bucket(terms, [*keys, kept_id], r.weight_dim)
    if r.name in K_LOWEST:
        return _lowest_of_each(terms, [*keys, kept_id], r.dim, r.k)
    return terms


def _summed_by_bucket(terms: DataFrame, by: list[str], size: int) -> DataFrame:
    """Partial states of exponential sums from single terms: a few for each row, by hash aggregation.

    Terms of one ``BUCKET`` of exponents are summed against its lower end, which
    neither overflows nor loses them, so no list of terms is ever collected.
    """
    m, s = F.col("partial")["m"], F.col("partial")["s"]
    bucket = F.when(m.isin(float("inf"), float("-inf")) | F.isnan(m), F.lit(0.0)).otherwise(F.floor(m / BUCKET) * BUCKET)
    rows = terms.select(*by, m.alias("_m"), bucket.cast("double").alias("_bucket"), *(s[d].alias(f"_s{d}") for d in range(size)))
    weight = F.when(F.col("_m") == F.lit(float("-inf")), F.lit(0.0)).otherwise(F.exp(F.col("_m") - F.col("_bucket")))
    summed = rows.groupBy(*by, "_bucket").agg(F.max("_m").alias("m"), *(F.sum(weight * F.col(f"_s{d}")).alias(f"s{d}") for d in range(size)))
    scale = F.when(F.col("m") == F.lit(float("-inf")), F.lit(1.0)).otherwise(F.exp(F.col("_bucket") - F.col("m")))
    return summed.select(*by, F.struct("m", F.array(*(F.col(f"s{d}") * scale for d in range(size))).alias("s")).alias("partial"))


def _times_power(x: Column, exponent: Column) -> Column:
    """x times a power of two, in two steps, as one of them may be beyond the range of numbers."""
    half = F.floor(exponent / 2)
    return x * F.pow(F.lit(2.0), half) * F.pow(F.lit(2.0), exponent - half)


def _summed_exactly(partial: DataFrame, by: list[str], dim: int) -> DataFrame:
    """One state for each row: sums and errors of all its states, in any order, without a rounding before the end.

    Numbers of eight neighbouring exponents are whole multiples of one power of
    two, so their sum is a sum of integers: a row has at most some hundred such
    sums, by hash aggregation.  Those are added up with compensation.
    """
    numbers = partial.select(*by, F.posexplode("partial").alias("_d", "_v")).withColumn("_d", F.col("_d") % dim)
    odd = F.isnan("_v") | (F.abs("_v") == F.lit(float("inf")))
    e = F.when(odd | (F.col("_v") == 0), F.lit(None)).otherwise(F.floor(F.log2(F.abs("_v")) / 8) * 8).cast("long")
    whole = _times_power(F.col("_v"), 54 - F.col("_e")).cast("long").cast("decimal(20,0)")
    sums = numbers.withColumn("_e", e).groupBy(*by, "_d", "_e").agg(F.sum(F.when(F.col("_e").isNotNull(), whole)).alias("_m"), F.sum(F.when(odd, F.col("_v"))).alias("_odd"))
    # parts of 30 bits, and what is above, are doubles without rounding
    low = F.col("_m") % F.lit(2**30)
    mid = (F.col("_m") - low) % F.lit(2**60).cast("decimal(20,0)")
    part = lambda c: _times_power(c.cast("double"), F.col("_e") - 54)
    terms = F.when(F.col("_e").isNotNull(), F.array(part(F.col("_m") - low - mid), part(mid), part(low)))
    each = sums.select(*by, "_d", "_odd", terms.alias("_t")).groupBy(*by, "_d").agg(F.flatten(F.collect_list("_t")).alias("_t"), F.sum("_odd").alias("_odd"))
    ordered = F.reverse(F.array_sort(F.transform("_t", lambda t: F.struct(F.abs(t).alias("size"), t.alias("t")))))

    def add(state: Column, x: Column) -> Column:
        s, t = state["s"], x["t"]
        total = s + t
        lost = F.when(F.abs(s) >= F.abs(t), (s - total) + t).otherwise((t - total) + s)
        return F.struct(total.alias("s"), (state["c"] + lost).alias("c"))

    zero = F.struct(F.lit(0.0).alias("s"), F.lit(0.0).alias("c"))
    state = F.aggregate(ordered, zero, add)
    found = each.select(*by, "_d", F.when(F.col("_odd").isNotNull(), F.struct(F.col("_odd").alias("s"), F.lit(0.0).alias("c"))).otherwise(state).alias("_x"))
    of = lambda d, name: F.max(F.when(F.col("_d") == d, F.col("_x")[name]))
    return found.groupBy(*by).agg(F.array(*(of(d, name) for name in "sc" for d in range(dim))).alias("partial"))


def _lowest_of_each(terms: DataFrame, by: list[str], dim: int, k: int) -> DataFrame:
    """Partial states of the K lowest: a window's limit keeps K rows a group in each task before they move."""
    rows = terms.select(*by, F.posexplode("partial").alias("_d", "_x")).select(*by, "_d", F.explode("_x").alias("_x"))
    first = Window.partitionBy(*by, "_d").orderBy("_x.v", "_x.i")
    few = rows.withColumn("_n", F.row_number().over(first)).where(F.col("_n") <= k)
    of = lambda d: F.sort_array(F.collect_list(F.when(F.col("_d") == d, F.col("_x")))).alias(f"_{d}")
    lists = few.groupBy(*by).agg(*(of(d) for d in range(dim)))
    return lists.select(*by, F.array(*(F.col(f"_{d}") for d in range(dim))).alias("partial"))
