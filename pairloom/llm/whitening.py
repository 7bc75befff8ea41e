"""Operator 11: whitening of embeddings from sums of products over the upper triangle.

Vectors become whole numbers x.  One aggregation sums each dimension; the next
sums, for every pair of dimensions i <= j, the product of the two entries, each
less the whole part of its mean: as many Spark SQL expressions as the triangle
has entries, combined in every task before anything moves.  What is left of the
means is put right in exact integers, so the covariance is the correctly
rounded one of the centred products whatever the order of the rows.  It is as
large as the square of a vector; LAPACK decomposes it on the driver, and rows
are projected in batches by a matrix product.

Products are summed as 64-bit integers where row count and range prove that
they fit, else as decimals.
"""

from __future__ import annotations

from collections.abc import Iterator
from fractions import Fraction

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from pairloom.llm._shared import prepare

COMPONENTS = 32
SCALE, OFFSET = 64, 1_000_000
#: Whole numbers up to this are exact as doubles.
EXACT = 2**53
#: Expressions of one aggregation at most; a vector of 90 entries has more pairs and takes several.
EXPRESSIONS = 4096
#: An eigenvalue below this share of the trace is rounding: its direction has no variance to divide by.
RANK = 1e-12
LONG = 2**63 - 1


def whole_numbers(embeddings: DataFrame, vector: str = "embedding", row_id: str = "vec_id") -> tuple[DataFrame, int]:
    """(vec_id, x array<long>) of the rows that count, and their dimension.

    Left out are null vectors, empty ones, those with a null or non-finite entry
    or one whose whole number is beyond 2^53, and those that are not of the
    commonest length (of two as common, the greater).
    """
    entries = F.col(vector).cast("array<double>")
    x = F.transform("v", lambda c: F.floor(c * SCALE) + F.lit(OFFSET).cast("long"))
    fine = F.forall("v", lambda c: c.isNotNull() & (F.abs(c * SCALE) < EXACT - OFFSET))  # false for NaN too, as that is above all numbers
    rows = embeddings.select(F.col(row_id).cast("long").alias("vec_id"), entries.alias("v")).where(F.col("v").isNotNull() & (F.size("v") > 0) & fine)
    common = rows.groupBy(F.size("v").alias("d")).count().orderBy(F.desc("count"), F.desc("d")).first()
    dim = common["d"] if common else 0
    return rows.where(F.size("v") == dim).select("vec_id", x.alias("x")), dim


def _columns(rows: DataFrame, dim: int) -> DataFrame:
    return rows.select(*(F.col("x")[d].alias(f"x{d}") for d in range(dim)))


def sums(rows: DataFrame, dim: int) -> tuple[int, list[int], int]:
    """(rows, sum of each dimension, largest distance between two entries of one dimension)."""
    wide = "decimal(20,0)"
    each = [f(F.col(f"x{d}")) for d in range(dim) for f in (lambda c: F.sum(c.cast(wide)), F.min, F.max)]
    row = _columns(rows, dim).agg(F.count(F.lit(1)), *each).first()
    if not row[0]:
        return 0, [], 0
    return row[0], [int(s) for s in row[1::3]], max(high - low for low, high in zip(row[2::3], row[3::3], strict=True))


def triangle_sums(rows: DataFrame, dim: int, n: int, middle: list[int], reach: int) -> dict[tuple[int, int], int]:
    """Sum of (x_i - middle_i) (x_j - middle_j) for each i <= j, exactly."""
    fits = n * (reach + 1) ** 2 <= LONG
    kind = "long" if fits else "decimal(19,0)"
    centred = _columns(rows, dim).select(*((F.col(f"x{d}") - F.lit(m)).cast(kind).alias(f"c{d}") for d, m in enumerate(middle)))
    pairs = [(i, j) for i in range(dim) for j in range(i, dim)]
    found: dict[tuple[int, int], int] = {}
    for k in range(0, len(pairs), EXPRESSIONS):
        some = pairs[k : k + EXPRESSIONS]
        row = centred.agg(*(F.expr(f"sum(c{i} * c{j})") for i, j in some)).first()
        found |= {p: int(v) for p, v in zip(some, row, strict=True)}
    return found


def covariance(rows: DataFrame, dim: int, n: int, totals: list[int], reach: int) -> np.ndarray:
    """The covariance (divisor n), every entry rounded once."""
    middle = [s // n for s in totals]
    rest = [s - n * m for s, m in zip(totals, middle, strict=True)]  # the sum of the centred entries
    out = np.empty((dim, dim))
    for (i, j), c in triangle_sums(rows, dim, n, middle, reach).items():
        out[i, j] = out[j, i] = float(Fraction(n * c - rest[i] * rest[j], n * n))
    return out


def principal(cov: np.ndarray, most: int = COMPONENTS) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """(eigenvalues, unit eigenvectors as columns, shares of the trace), falling; only those with variance."""
    values, vectors = np.linalg.eigh(cov)
    order = np.argsort(-values, kind="stable")[:most]
    trace = float(np.trace(cov))
    order = order[values[order] > RANK * trace]
    return values[order], vectors[:, order], values[order] / trace if len(order) else values[order]


def _matrix(column: pa.Array, dim: int) -> np.ndarray:
    return column.flatten().to_numpy(zero_copy_only=False).reshape(-1, dim)


def _deviations(x: np.ndarray, n: int, totals: np.ndarray, reach: int) -> pa.Array:
    """Sum of (n x - S)^2 in each row, exactly; null where that is beyond 64 bits."""
    if x.shape[1] * (n * (reach + 1)) ** 2 <= LONG and n * 2 * EXACT <= LONG:
        d = n * x - totals.astype(np.int64)
        return pa.array((d * d).sum(1))
    wide = ((n * x.astype(object) - totals) ** 2).sum(1)
    return pa.array([int(v) if v <= LONG else None for v in wide], pa.int64())


def whiten(embeddings: DataFrame, components: int = COMPONENTS, vector: str = "embedding", row_id: str = "vec_id") -> DataFrame:
    """vec_id, component (from 1), n, deviation, whitened, explained, identity_error for every row that counts.

    Rows as in ``whole_numbers``; equal rows and rows of one id stay, each with
    its own results, and a null id is an id.  Directions without variance have
    no component, so equal vectors, a single row and an empty table give no
    rows.  A deviation beyond 64 bits is null.  ``identity_error`` is measured
    on the whitened rows.  Other columns are not read.
    """
    spark = prepare(embeddings.sparkSession)
    rows, dim = whole_numbers(embeddings, vector, row_id)
    schema = "vec_id long, component int, n long, deviation long, whitened double, explained double, identity_error double"
    n, totals, reach = sums(rows, dim)
    values, axes, shares = principal(covariance(rows, dim, n, totals, reach), components) if n else (np.zeros(0),) * 3
    k = len(values)
    if not k:
        return spark.createDataFrame([], schema)
    middle = np.array([s // n for s in totals], np.int64)
    rest = np.array([(s - n * int(m)) / n for s, m in zip(totals, middle, strict=True)])
    exact_totals, scaled = np.array(totals, object), axes / np.sqrt(values)

    def projected(x: np.ndarray) -> np.ndarray:
        return ((x - middle) - rest) @ scaled

    def gram(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        total = np.zeros((k, k))
        for b in batches:
            w = projected(_matrix(b["x"], dim))
            total += w.T @ w
        yield pa.RecordBatch.from_arrays([pa.array(np.arange(k)), pa.array(list(total), pa.list_(pa.float64()))], ["r", "g"])

    parts = rows.select("x").mapInArrow(gram, "r long, g array<double>").groupBy("r").agg(F.array(*(F.sum(F.col("g")[c]) for c in range(k))).alias("g"))
    measured = np.array([r["g"] for r in parts.orderBy("r").collect()]) / n  # as many rows as components
    error = float(np.abs(measured - np.eye(k)).max())

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in batches:
            x = _matrix(b["x"], dim)
            count = len(x)
            at = pa.array(np.repeat(np.arange(count), k))
            constant = lambda v, kind: pa.array(np.full(count * k, v), kind)
            yield pa.RecordBatch.from_arrays(
                [
                    b["vec_id"].take(at), pa.array(np.tile(np.arange(1, k + 1), count), pa.int32()), constant(n, pa.int64()),
                    _deviations(x, n, exact_totals, reach).take(at), pa.array(projected(x).ravel()), pa.array(np.tile(shares, count)), constant(error, pa.float64()),
                ],
                ["vec_id", "component", "n", "deviation", "whitened", "explained", "identity_error"],
            )

    return rows.mapInArrow(run, schema)
