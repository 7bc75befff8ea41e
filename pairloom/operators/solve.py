"""Conjugate gradients for kernel systems: (K + alpha) a = b.

Several right-hand sides are one block: they share their directions, and a small
matrix of steps takes the place of a number (after Ji and Li, 2017).
Each iteration is one pair query and two sums over rows.  Vectors are written
to the shared folder between iterations, so plans stay short, and the ones
before are deleted; only dot products, and for a preconditioner as many numbers
as it has landmarks, reach the driver.
"""

from __future__ import annotations

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from pairloom.operators.pairs import matrix
from pairloom.plans.expr import VI, VJ, Var, call
from pairloom.session import Steps, ship

#: Landmarks at most, unless more are asked for, and the trace in units of alpha that they may leave out.
LANDMARKS, LEFT = 1280, 10.0


def solve(kernel, table: DataFrame, row_id: str, b: str, alpha: float = 1e-10, eps: float = 1e-6, max_iterations: int = 500, preconditioner: str | None = None, landmarks: int = 100) -> DataFrame:
    """(row id, value): stops when |r|^2 < rows * eps^2 for each right-hand side (component of b), or after ``max_iterations``.

    ``kernel`` is a symmetric tensor of dim 1 between the table and itself.
    ``preconditioner``: "diagonal" divides residuals by the diagonal of K + alpha;
    "nystrom" applies the inverse of alpha plus the kernel's approximation by
    ``landmarks`` rows, chosen by a hash of their id, or by up to ``LANDMARKS``
    where these leave out much, and pays where alpha is small.  The kernel between rows and landmarks is computed where it is
    needed, never stored: what an iteration writes does not depend on them.
    Raises ``ArithmeticError`` if the residual is still larger after
    ``max_iterations``, and ``ValueError`` for a curvature that isn't positive,
    as the matrix then isn't positive definite.
    """
    from pairloom.tensor import SymTensor

    steps = Steps(ship(table.sparkSession), "solve")
    dim = len(table.select(b).first()[0]) if table.schema[b].dataType.typeName() == "array" else 1
    vector = F.col(b) if table.schema[b].dataType.typeName() == "array" else F.array(F.col(b).cast("double"))
    names = {v.name for v in kernel.expr.variables() if v.cat == VJ}
    k_id = kernel.tables[VI][1]

    def apply(x: DataFrame, column: str, width: int) -> DataFrame:
        """row id, q: (K + alpha) x."""
        expr = call("Mult", kernel.expr, Var(10_000_000, width, VJ, "_p"))
        side = table.select(row_id, *names).join(x.select(row_id, F.col(column).alias("_p")), row_id)
        tables = dict(kernel.tables) | {VJ: (side, row_id, [])}
        out = SymTensor(expr, tables, kernel.params, kernel.ranges).sum(axis=1)
        out = out.withColumnRenamed(k_id, row_id).join(x.select(row_id, column), row_id)
        return out.select(row_id, _axpy("value", column, alpha).alias("q"))

    def _axpy(x: str, y: str, s: float):
        return F.zip_with(x, y, lambda u, v: u + F.lit(float(s)) * v)

    def _dot(x: str, y: str):
        return F.sum(F.aggregate(F.zip_with(x, y, lambda u, v: u * v), F.lit(0.0), lambda u, v: u + v))

    start = table.select(F.col(row_id).cast("long").alias(row_id), vector.alias("b"))
    scale = F.lit(1.0)
    if preconditioner == "diagonal":
        from pairloom.plans.evaluate import as_columns

        near, near_id, *_ = kernel.tables[VI]
        mine = {v.name for v in kernel.expr.variables() if v.cat == VI}
        diag = table.select(F.col(row_id).cast("long").alias(row_id), *(F.col(c).alias(f"_theirs_{c}") for c in names))
        diag = diag.join(near.select(F.col(near_id).cast("long").alias(row_id), *(F.col(c).alias(f"_mine_{c}") for c in mine)), row_id)

        def parts(v: Var) -> list:
            name = f"{'_mine_' if v.cat == VI else '_theirs_'}{v.name}"
            return [(F.col(name)[d] if diag.schema[name].dataType.typeName() == "array" else F.col(name)).cast("double") for d in range(v.dim)]

        values = {v.key: parts(v) if v.cat in (VI, VJ) else [F.lit(float(x)) for x in kernel.params[v.name]] for v in kernel.expr.variables()}
        start = start.join(diag.select(row_id, (as_columns(kernel.expr, values)[0] + alpha).alias("m")), row_id)
        scale = F.col("m")
    nystrom = None
    if preconditioner == "nystrom":
        nystrom = _Nystrom(kernel, table, row_id, landmarks, alpha)
    state = start.select(row_id, F.transform("b", lambda x: x * 0.0).alias("a"), F.col("b").alias("r"), scale.alias("m"))

    def conditioned(state: DataFrame) -> DataFrame:
        """Adds z, the preconditioned residual."""
        if nystrom is not None:
            return nystrom.apply(state, dim)
        return state.withColumn("z", F.transform("r", lambda x: x / F.col("m")))

    if dim > 1:
        return _block(state, row_id, dim, apply, conditioned, steps, eps, max_iterations)
    state = steps.keep(conditioned(state).withColumn("p", F.col("z")))
    n, rr, rz = state.select(F.count(F.lit(1)), _dot("r", "r"), _dot("r", "z")).first()
    state = state.drop("z")
    done = 0
    while n and rr >= n * dim * eps * eps:
        if done == max_iterations:
            raise ArithmeticError(f"not solved in {max_iterations} iterations: the residual is {(rr / (n * dim)) ** 0.5:.3g}, not {eps:.3g}")
        done += 1
        state = steps.keep(state.join(apply(state, "p", dim), row_id))
        (pq,) = state.select(_dot("p", "q")).first()
        if not pq > 0:
            raise ValueError("the kernel matrix is not positive definite")
        step = rz / pq
        state = state.select(row_id, _axpy("a", "p", step).alias("a"), _axpy("r", "q", -step).alias("r"), "m", "p")
        state = steps.keep(conditioned(steps.keep(state) if nystrom is not None else state))
        rr, new = state.select(_dot("r", "r"), _dot("r", "z")).first()
        state = state.select(row_id, "a", "r", "m", _axpy("z", "p", new / rz).alias("p"))
        rz = new
    return state.select(row_id, F.col("a").alias("value"))


def _grams(rows: DataFrame, widths: dict[str, int]) -> dict[tuple[str, str], np.ndarray]:
    """For each two of the array columns the sum over rows of the products of their entries."""
    size = sum(widths.values())

    def run(batches):
        total = np.zeros((size, size))
        for b in batches:
            v = np.concatenate([matrix(b[c], w) for c, w in widths.items()], 1)
            total += v.T @ v
        yield pa.RecordBatch.from_arrays([pa.array(np.arange(size)), pa.array(list(total), pa.list_(pa.float64()))], ["k", "s"])

    parts = rows.select(*widths).mapInArrow(run, "k long, s array<double>").groupBy("k").agg(F.array(*(F.sum(F.col("s")[d]) for d in range(size))).alias("s"))
    whole = np.array([r["s"] for r in parts.orderBy("k").collect()]).reshape(size, size)
    ends = dict(zip(widths, np.cumsum(list(widths.values())), strict=True))
    at = {c: slice(ends[c] - w, ends[c]) for c, w in widths.items()}
    return {(c, d): whole[at[c], at[d]] for c in widths for d in widths}


def _turned(rows: DataFrame, row_id: str, made: dict[str, list[tuple[str, np.ndarray]]], kept: list[str]) -> DataFrame:
    """row id, ``kept`` and arrays ``made``: sums of arrays of the row, each times a small matrix."""

    def run(batches):
        for b in batches:
            if b.num_rows:
                found = [sum(matrix(b[c], len(m)) @ m for c, m in terms) for terms in made.values()]
                yield pa.RecordBatch.from_arrays([*(b[c] for c in (row_id, *kept)), *(pa.array(list(x), pa.list_(pa.float64())) for x in found)], [row_id, *kept, *made])

    kinds = {f.name: f.dataType.simpleString() for f in rows.schema}
    return rows.mapInArrow(run, ", ".join([*(f"{c} {kinds[c]}" for c in (row_id, *kept)), *(f"{c} array<double>" for c in made)]))


def _spanning(gram: np.ndarray) -> np.ndarray:
    """Weights that make an orthonormal base of the span of some vectors, given their products; fewer where they depend on each other."""
    size = np.sqrt(np.maximum(np.diag(gram), 0))
    there = size > 0
    scaled = gram[np.ix_(there, there)] / np.outer(size[there], size[there])
    e, q = np.linalg.eigh((scaled + scaled.T) / 2)
    few = e > 1e-12 * len(e)
    out = np.zeros((len(gram), int(few.sum())))
    out[there] = q[:, few] / np.sqrt(e[few]) / size[there][:, None]
    return out


def _block(state: DataFrame, row_id: str, dim: int, apply, conditioned, steps: Steps, eps: float, max_iterations: int) -> DataFrame:
    """Block conjugate gradients: all right-hand sides, also equal or dependent ones and zeros, by shared directions.

    Directions are orthonormal and span what the residuals still need, so that
    there are as many as the residuals have dimensions, and it takes no more
    iterations than the hardest right-hand side alone would.
    """
    one = np.eye(dim)
    state = steps.keep(conditioned(state))
    n = state.count()
    sums = _grams(state, {"r": dim, "z": dim}) if n else {}
    residual = np.diag(sums["r", "r"]) if n else np.zeros(dim)
    if n:
        base = _spanning(sums["z", "z"])
        state = _turned(state, row_id, {"p": [("z", base)]}, ["a", "r", "m"])
    done = 0
    while n and (residual >= n * eps * eps).any():
        if done == max_iterations:
            raise ArithmeticError(f"not solved in {max_iterations} iterations: the residual is {(residual.max() / n) ** 0.5:.3g}, not {eps:.3g}")
        done += 1
        width = base.shape[1]
        if not width:
            raise ValueError("the preconditioned residuals vanish: the preconditioner is not positive definite")
        state = steps.keep(state)
        state = steps.keep(state.join(apply(state, "p", width), row_id))
        sums = _grams(state, {"p": width, "q": width, "r": dim})
        curved = (sums["p", "q"] + sums["p", "q"].T) / 2
        if not np.linalg.eigvalsh(curved).min() > 0:
            raise ValueError("the kernel matrix is not positive definite")
        step = np.linalg.solve(curved, sums["p", "r"])
        state = _turned(state, row_id, {"a": [("a", one), ("p", step)], "r": [("r", one), ("q", -step)]}, ["m", "p", "q"])
        state = steps.keep(conditioned(steps.keep(state)))
        sums = _grams(state, {"p": width, "q": width, "r": dim, "z": dim})
        residual = np.diag(sums["r", "r"])
        turn = -np.linalg.solve(curved, sums["q", "z"])
        base = _spanning(sums["z", "z"] + turn.T @ sums["p", "z"] + sums["z", "p"] @ turn + turn.T @ sums["p", "p"] @ turn)
        state = _turned(state, row_id, {"p": [("z", base), ("p", turn @ base)]}, ["a", "r", "m"])
    return state.select(row_id, F.col("a").alias("value"))


def _added(parts: DataFrame) -> list[list[float]]:
    """The lists ``s`` of each ``k`` added up, by ``k``."""

    def add(t: pa.Table) -> pa.Table:
        s = t["s"].combine_chunks()
        return pa.table({"k": t["k"].slice(0, 1), "s": pa.array([matrix(s, len(s[0])).sum(0).tolist()], pa.list_(pa.float64()))})

    found = parts.groupBy("k").applyInArrow(add, "k long, s array<double>").toArrow().sort_by("k")
    return found["s"].to_pylist()


def left_out(trace: float, alpha: float) -> bool:
    """Whether the landmarks leave out so much of the kernel that more of them are worth it."""
    return trace > LEFT * abs(alpha)


class _Nystrom:
    """z = (alpha + B B') ^-1 r, where B B' is the kernel's approximation U M^-1 U' by a few landmarks.

    U has the kernel between all rows and the landmarks, M among those; B = U T,
    where T T' is the inverse of M without its directions that are nothing but
    rounding.  By the identity of Woodbury z is (r - B (alpha + B'B)^-1 B'r) /
    alpha: sums over rows of as many numbers as there are landmarks, squared
    once.  What the approximation leaves out has the trace of K less that of
    B B'; while that is more than ``LEFT`` times alpha, which would be many
    iterations, four times as many landmarks are taken.
    """

    def __init__(self, kernel, table: DataFrame, row_id: str, landmarks: int, alpha: float):
        from pairloom.operators.pairs import _vars, name_of

        near, kept_id, *_ = kernel.tables[VI]
        self.expr = kernel.expr
        self.mine, self.theirs = _vars([kernel.expr], VI), _vars([kernel.expr], VJ)
        self.params = {v.key: np.asarray(kernel.params[v.name], float)[None, None] for v in kernel.expr.variables() if v.name in kernel.params}
        ship(near.sparkSession)
        self.row_id, self.alpha = row_id, alpha
        own = table.select(F.col(row_id).cast("long").alias(row_id), *(name_of(v) for v in self.theirs))
        self.near = near.select(F.col(kept_id).cast("long").alias(row_id), *(name_of(v) for v in self.mine))
        rows = self.near.join(own.select(row_id, *(F.col(name_of(v)).alias(f"_own_{name_of(v)}") for v in self.theirs)), row_id)
        self.count = min(landmarks, most := max(landmarks, LANDMARKS))
        while True:
            found = self._fit(own, rows)
            if not left_out(found, alpha) or self.count >= most:
                return
            self.count = min(4 * self.count, most)

    def _fit(self, own: DataFrame, rows: DataFrame) -> float:
        """Sets ``features`` and ``inverse`` for ``count`` landmarks (or all rows); the trace of what they leave out."""
        from pairloom.operators.pairs import _table, name_of
        from pairloom.plans.evaluate import on_blocks

        expr, mine, theirs, params, row_id = self.expr, self.mine, self.theirs, self.params, self.row_id
        chosen = own.orderBy(F.xxhash64(row_id), row_id).limit(self.count).toArrow()
        there, count = {k: v[None] for k, v in _table(chosen, theirs).items()}, chosen.num_rows

        def kernels(b) -> np.ndarray:
            """The kernel between the rows of a batch and the landmarks."""
            here = {k: v[:, None] for k, v in _table(b, mine).items()}
            return np.broadcast_to(on_blocks(expr, params | here | there), (b.num_rows, count, 1))[..., 0]

        places = own.sparkSession.createDataFrame([(i.as_py(), n) for n, i in enumerate(chosen[row_id])], f"{row_id} long, _place int")  # as many rows as landmarks
        small = kernels(self.near.join(F.broadcast(places), row_id).orderBy("_place").toArrow()) if count else np.zeros((0, 0))
        e, v = np.linalg.eigh((small + small.T) / 2)
        there_is = e > 1e-12 * max(e.max(initial=0.0), 0.0)
        turn = v[:, there_is] / np.sqrt(e[there_is])
        size = turn.shape[1]

        def features(b) -> np.ndarray:
            return kernels(b) @ turn

        def run(batches):
            total, left = np.zeros((size, size)), 0.0
            for b in batches:
                if b.num_rows:
                    u = features(b)
                    total += u.T @ u
                    here = {k: x[:, None] for k, x in _table(b, mine).items()} | {w.key: matrix(b[f"_own_{name_of(w)}"], w.dim)[:, None] for w in theirs}
                    left += float(np.broadcast_to(on_blocks(expr, params | here), (b.num_rows, 1, 1)).sum() - (u * u).sum())
            yield pa.RecordBatch.from_arrays([pa.array(np.arange(size + 1)), pa.array([*total.tolist(), [left]], pa.list_(pa.float64()))], ["k", "s"])

        self.features = features
        sums = _added(rows.mapInArrow(run, "k long, s array<double>"))
        gram = np.array(sums[:size]).reshape(size, size)
        self.inverse = np.linalg.inv(self.alpha * np.eye(size) + (gram + gram.T) / 2)
        return sums[size][0] if len(sums) > size else 0.0

    def _sums(self, rows: DataFrame, column: str) -> np.ndarray:
        """Sum over rows of the products of their features with ``column``: (features, width)."""
        features = self.features

        def run(batches):
            total = None
            for b in batches:
                if b.num_rows:
                    total = features(b).T @ np.array(b[column].to_pylist(), float).reshape(b.num_rows, -1) + (0 if total is None else total)
            if total is not None:
                yield pa.RecordBatch.from_arrays([pa.array(np.arange(len(total))), pa.array(list(total), pa.list_(pa.float64()))], ["k", "s"])

        return np.array(_added(rows.mapInArrow(run, "k long, s array<double>")))

    def apply(self, state: DataFrame, dim: int) -> DataFrame:
        """``state`` with z."""
        rows, features, alpha, names = self.near.join(state, self.row_id), self.features, self.alpha, state.columns
        weights = self.inverse @ self._sums(rows, "r").reshape(len(self.inverse), -1)

        def run(batches):
            for b in batches:
                if b.num_rows:
                    z = (np.array(b["r"].to_pylist(), float).reshape(b.num_rows, -1) - features(b) @ weights) / alpha
                    yield pa.RecordBatch.from_arrays([*(b[c] for c in names), pa.array(list(z), pa.list_(pa.float64()))], [*names, "z"])

        schema = ", ".join(f"{f.name} {f.dataType.simpleString()}" for f in state.schema)
        return rows.mapInArrow(run, f"{schema}, z array<double>")


class KernelSolve:
    """The formula form: ``KernelSolve("Exp(-SqDist(x,y))*b", [...], "b")``; b is the unknown's variable."""

    def __init__(self, formula: str, aliases: list[str], varinvalias: str, axis: int = 1):
        from pairloom.genred import transpose
        from pairloom.plans.parse import parse

        tree, variables = parse(formula, aliases)
        v = next(x for x in variables if x.name == varinvalias)
        from pairloom.plans.expr import IntCst, Op

        self.kernel = tree.replace(v, IntCst(1)) if v.dim == 1 else _without(tree, v)
        if axis == 0:
            self.kernel = transpose(self.kernel)
        self.unknown = v
        assert not isinstance(self.kernel, Op) or self.kernel.dim == 1, "the formula must be a scalar kernel times the unknown"

    def run(self, left: DataFrame, right: DataFrame, params: dict | None = None, alpha: float = 1e-10, eps: float = 1e-6, left_id: str = "i", right_id: str = "j", max_iterations: int = 500, preconditioner: str | None = None, landmarks: int = 100) -> DataFrame:
        from pairloom.tensor import SymTensor

        t = SymTensor(self.kernel, {VI: (left, left_id, []), VJ: (right, right_id, [])}, {k: list(x) for k, x in (params or {}).items()})
        return solve(t, right, right_id, self.unknown.name, alpha, eps, max_iterations, preconditioner, landmarks)


    def grad(self, v: str, left: DataFrame, right: DataFrame, e: str = "eta", params: dict | None = None, alpha: float = 1e-10, eps: float = 1e-6, left_id: str = "i", right_id: str = "j", max_iterations: int = 500) -> DataFrame:
        """The gradient of the solution by variable ``v``, applied to column ``e`` of ``right``: (id, value).

        With z solving (K + alpha) z = e: z itself by the right-hand side; by any
        other variable, minus the gradient of the product K a applied to z, where
        a is the solution.  A variable of side i gives a row for each i, one of
        side j for each j.
        """
        from pairloom.genred import PairReduce

        more = {"params": params, "alpha": alpha, "eps": eps, "left_id": left_id, "right_id": right_id, "max_iterations": max_iterations}
        unknown = self.unknown.name
        z = self.run(left, right.drop(unknown).withColumnRenamed(e, unknown), **more)
        if v == unknown:
            return z
        a = self.run(left, right, **more)
        kernel = self.kernel
        product = PairReduce(call("Mult", kernel, Var(10_000_001, self.unknown.dim, VJ, unknown)), (), "Sum", 1).grad(v, e)
        # z has the rows of side i, as K is square
        near = left.join(z.select(F.col(right_id).alias(left_id), F.col("value").alias(e)), left_id)
        far = right.drop(unknown, e).join(a.select(right_id, F.col("value").alias(unknown)), right_id)
        out = product.run(near, far, params, left_id=left_id, right_id=right_id)
        return out.withColumn("value", F.transform("value", lambda x: -x))


def _without(tree, v):
    """The factor beside ``v`` in a product."""
    if getattr(tree, "name", "") == "Mult":
        a, b = tree.children
        if b.key == v.key:
            return a
        if a.key == v.key:
            return b
    raise ValueError("the formula must be a scalar kernel times the unknown")
