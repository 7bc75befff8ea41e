"""Systems with several right-hand sides."""

import numpy as np
import pytest
from pyspark.sql import functions as F

from pairloom.operators import solve as module
from pairloom.tensor import Vi, Vj


def _system(spark, rows, columns, seed=1):
    r = np.random.default_rng(seed)
    x, b = r.normal(size=(rows, 2)), r.normal(size=(rows, columns))
    return x, b


def _kernel(spark, x, b):
    left = spark.createDataFrame([(i, v.tolist()) for i, v in enumerate(x)], "i long, x array<double>").repartition(3)
    right = spark.createDataFrame([(j, v.tolist(), w.tolist()) for j, (v, w) in enumerate(zip(x, b, strict=True))], "j long, y array<double>, b array<double>").repartition(2)
    return (-Vi(left, "x", dim=2).sqdist(Vj(right, "y", dim=2))).exp(), right


def _products(monkeypatch):
    """Counts products with the kernel."""
    from pairloom.tensor import SymTensor

    seen, plain = [], SymTensor.sum

    def counted(self, *a, **k):
        seen.append(1)
        return plain(self, *a, **k)

    monkeypatch.setattr(SymTensor, "sum", counted)
    return seen


@pytest.mark.parametrize("preconditioner", [None, "diagonal", "nystrom"])
def test_many_right_hand_sides(spark, monkeypatch, preconditioner):
    x, b = _system(spark, 40, 8)
    k, table = _kernel(spark, x, b)
    seen = _products(monkeypatch)
    out = module.solve(k, table, "j", "b", alpha=2.0, eps=1e-7, preconditioner=preconditioner, landmarks=10)
    got = np.array([r["value"] for r in out.orderBy("j").collect()])
    dense = np.exp(-((x[:, None] - x[None]) ** 2).sum(-1)) + 2.0 * np.eye(40)
    assert np.abs(dense @ got - b).max() < 1e-6
    if preconditioner is None:
        block, hardest = len(seen), 0
        for c in range(1):
            seen.clear()
            module.solve(k, table.withColumn("b", F.col("b")[c]), "j", "b", alpha=2.0, eps=1e-7)
            hardest = max(hardest, len(seen))
        assert block <= hardest


def test_dependent_and_empty_right_hand_sides(spark):
    """Equal, dependent and zero columns, and scales far apart."""
    x, b = _system(spark, 30, 2)
    b = np.stack([b[:, 0], b[:, 0], np.zeros(30), b[:, 0] - 2 * b[:, 1], 1e6 * b[:, 1]], 1)
    k, table = _kernel(spark, x, b)
    got = np.array([r["value"] for r in module.solve(k, table, "j", "b", alpha=2.0, eps=1e-7).orderBy("j").collect()])
    dense = np.exp(-((x[:, None] - x[None]) ** 2).sum(-1)) + 2.0 * np.eye(30)
    assert np.abs(dense @ got - b).max() < 1e-5 and (got[:, 2] == 0).all()
    none = module.solve(k, table.withColumn("b", F.transform("b", lambda v: v * 0)), "j", "b", alpha=0.5)
    assert all(set(r["value"]) == {0.0} for r in none.collect())
    with pytest.raises(ArithmeticError, match="not solved"):
        module.solve(k, table, "j", "b", alpha=1e-3, max_iterations=1)
    with pytest.raises(ValueError, match="positive definite"):
        module.solve(-k, table, "j", "b", alpha=0.1)


@pytest.mark.parametrize("columns", [1, 2])
def test_more_landmarks_where_few_leave_much_out(spark, monkeypatch, columns):
    """A small ``alpha`` and few landmarks to begin with: iterations do not grow with what those leave out."""
    x, b = _system(spark, 400, columns)
    k, table = _kernel(spark, x, b)
    seen = _products(monkeypatch)
    out = module.solve(k, table, "j", "b", alpha=0.01, eps=1e-8, preconditioner="nystrom", landmarks=5)
    got = np.array([r["value"] for r in out.orderBy("j").collect()])
    dense = np.exp(-((x[:, None] - x[None]) ** 2).sum(-1)) + 0.01 * np.eye(400)
    assert np.abs(dense @ got - b).max() < 1e-6 and len(seen) <= 6
