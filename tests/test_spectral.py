"""Leading eigenpairs against numpy."""

import numpy as np
import pytest

from pairloom.operators.spectral import leading_eigenpairs
from pairloom.tensor import Vi, Vj


def kernel(spark, points):
    left = spark.createDataFrame([(i, p.tolist()) for i, p in enumerate(points)], "i long, x array<double>").repartition(3)
    right = left.withColumnsRenamed({"i": "j", "x": "y"})
    dim = points.shape[1] if len(points) else 2
    return (-Vi(left, "x", dim=dim).sqdist(Vj(right, "y", dim=dim))).exp(), right


def test_leading_eigenpairs(spark):
    points = np.random.default_rng(3).normal(size=(2000, 2))
    k, table = kernel(spark, points)
    values, vectors = leading_eigenpairs(k, table, "j", 5)
    dense = np.exp(-((points[:, None] - points[None]) ** 2).sum(-1))
    want = np.linalg.eigvalsh(dense)[::-1][:5]
    assert np.abs(np.array(values) / want - 1).max() < 1e-6
    found = np.array([r["value"] for r in vectors.orderBy("j").collect()])
    assert np.abs(found.T @ found - np.eye(5)).max() < 1e-8
    assert np.abs(dense @ found - found * values).max() < 1e-6 * values[0]


def test_eigenpairs_of_few_rows(spark):
    points = np.array([[0.0, 1.0], [2.0, 0.0], [0.5, 0.5]])
    values, vectors = leading_eigenpairs(*kernel(spark, points), "j", 7)
    dense = np.exp(-((points[:, None] - points[None]) ** 2).sum(-1))
    assert np.allclose(values, np.linalg.eigvalsh(dense)[::-1]) and vectors.count() == 3
    values, vectors = leading_eigenpairs(*kernel(spark, points[:0]), "j", 2)
    assert values == [] and vectors.count() == 0
    with pytest.raises(ValueError):
        leading_eigenpairs(*kernel(spark, points), "j", 0)
