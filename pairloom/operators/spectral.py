"""Leading eigenpairs of symmetric kernels, by subspace iteration with Rayleigh-Ritz steps.

All vectors of an iteration are one array a row; a product with the kernel is
one pair query for all of them.  What the driver sees are products of vectors
with each other, a small matrix; the tables of an iteration are written to the
shared folder and deleted once the next is written.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from pairloom.operators.pairs import matrix
from pairloom.plans.expr import VI, VJ, Var, call
from pairloom.session import Steps, ship

#: Vectors beside those that are asked for: convergence goes by the first eigenvalue that is left out.
EXTRA = 6


def _products(rows: DataFrame, columns: list[str], width: int) -> np.ndarray:
    """Sums over rows of the products of all entries of the arrays ``columns``, each ``width`` long."""
    size = width * len(columns)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        total = np.zeros((size, size))
        for b in batches:
            v = np.concatenate([matrix(b[c], width) for c in columns], 1)
            total += v.T @ v
        yield pa.RecordBatch.from_arrays([pa.array(np.arange(size)), pa.array(list(total), pa.list_(pa.float64()))], ["r", "s"])

    parts = rows.select(*columns).mapInArrow(run, "r long, s array<double>").groupBy("r").agg(F.array(*(F.sum(F.col("s")[d]) for d in range(size))).alias("s"))
    return np.array([r["s"] for r in parts.orderBy("r").collect()]).reshape(size, size)


def _combined(rows: DataFrame, row_id: str, column: str, weights: np.ndarray, name: str) -> DataFrame:
    """row id and ``name``: each row's array times a small matrix."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in batches:
            if b.num_rows:
                out = matrix(b[column], len(weights)) @ weights
                yield pa.RecordBatch.from_arrays([b[row_id], pa.array(list(out), pa.list_(pa.float64()))], [row_id, name])

    return rows.select(row_id, column).mapInArrow(run, f"{row_id} long, {name} array<double>")


def leading_eigenpairs(kernel, table: DataFrame, row_id: str, count: int, eps: float = 1e-8, max_iterations: int = 200) -> tuple[list[float], DataFrame]:
    """(eigenvalues, falling, of a symmetric kernel between ``table`` and itself; (row id, value): unit eigenvectors' entries).

    Ends when no |K v - e v| of those asked for is above ``eps`` times the first
    eigenvalue, and raises ``ArithmeticError`` if that takes more than
    ``max_iterations``.  A table with fewer rows has as many pairs as rows.
    Signs of vectors are arbitrary.
    """
    from pairloom.tensor import SymTensor

    if kernel.dim != 1 or count < 1:
        raise ValueError("eigenpairs are of scalar kernels, and at least one")
    spark = ship(table.sparkSession)
    steps = Steps(spark, "eigen")
    width = min(count + EXTRA, table.count())
    count = min(count, width)
    ids = table.select(F.col(row_id).cast("long").alias(row_id))
    if not width:
        return [], ids.select(row_id, F.array().cast("array<double>").alias("value"))
    names = {v.name for v in kernel.expr.variables() if v.cat == VJ}
    near_id = kernel.tables[VI][1]
    expr = call("Mult", kernel.expr, Var(10_000_000, width, VJ, "_p"))

    def applied(vectors: DataFrame) -> DataFrame:
        """row id, v, w: the vectors and the kernel's products with them."""
        side = table.select(F.col(row_id).cast("long").alias(row_id), *names).join(vectors.withColumnRenamed("v", "_p"), row_id)
        out = SymTensor(expr, dict(kernel.tables) | {VJ: (side, row_id, [])}, kernel.params, kernel.ranges).sum(axis=1)
        return steps.keep(vectors.join(out.select(F.col(near_id).alias(row_id), F.col("value").alias("w")), row_id))

    def orthonormal(gram: np.ndarray) -> np.ndarray:
        e, q = np.linalg.eigh((gram + gram.T) / 2)
        return q / np.sqrt(np.maximum(e, e.max() * 1e-14))

    # directions from a hash of the id: the same again, whatever is lost
    noise = F.array(*((F.xxhash64(row_id, F.lit(k)) / F.lit(2.0**63)).alias(f"n{k}") for k in range(width)))
    start = steps.keep(ids.select(row_id, noise.alias("v")))
    vectors = _combined(start, row_id, "v", orthonormal(_products(start, ["v"], width)), "v")
    for _ in range(max_iterations):
        state = applied(vectors)
        g = _products(state, ["v", "w"], width)
        vv, vw, ww = g[:width, :width], g[:width, width:], g[width:, width:]
        values, q = np.linalg.eigh((vw + vw.T) / 2)
        values, q = values[::-1], q[:, ::-1]
        # |w q - v q e| from the same products
        off = np.einsum("ij,ik,kj->j", q, ww, q) - 2 * values * np.einsum("ij,ik,kj->j", q, vw, q) + values**2 * np.einsum("ij,ik,kj->j", q, vv, q)
        if np.sqrt(np.maximum(off[:count], 0)).max() <= max(eps, 1e-8) * abs(values[0]):
            return values[:count].tolist(), _combined(state, row_id, "v", q[:, :count], "value")
        # products with Ritz vectors, each over its eigenvalue, are nearly orthonormal already
        turned = q / np.maximum(np.abs(values), 1e-10 * abs(values[0]))
        vectors = _combined(state, row_id, "w", turned @ orthonormal(turned.T @ ww @ turned), "v")
    raise ArithmeticError(f"no {count} eigenpairs in {max_iterations} iterations")
