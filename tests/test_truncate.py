"""Bounds of formulas, and sums that leave out what cannot matter."""

import numpy as np
import pytest
from hypothesis import given, settings
from hypothesis import strategies as st
from pyspark.sql import functions as F

from pairloom.genred import PairReduce
from pairloom.operators import truncate
from pairloom.operators.truncate import cells, kept_blocks, truncated_sum
from pairloom.plans.bounds import bounds
from pairloom.plans.evaluate import on_blocks

ALIASES = ["x = Vi(3)", "y = Vj(3)", "b = Vj(1)"]
FORMULAS = [
    "Exp(-SqDist(x,y))*b", "Exp(-Norm2(x-y))", "x*y - y/(2+Square(x))", "Rsqrt(1+SqDist(x,y))*(x-y)", "Abs(x-y)+ReLU(y)-Step(x)", "Sin(x)*Cos(y)+Atan(b)",
    "Pow(x-y,3)+Pow(y,2)", "Powf(1+Square(x),y)", "Log(1+SqDist(x,y))", "Max(x-y)*Min(x)", "IfElse(x-y,x,y*b)", "Clamp(x,y-1,y+1)", "(x<y)*b", "Concat(x,y)", "Elem(x,1)*Extract(y,0,2)",
    "(x|y)*b", "Sqrt(SqDist(x,y))*Sign(b)", "MatVecMult(Concat(x,y),y)", "Inv(3+Sin(b))", "Floor(x)+Round(y,1)", "XLogX(1+Square(b))", "ClampInt(x*2,0,1)", "Divide(x,y)", "Sqrt(b)", "Log(x)",
]


@settings(max_examples=40, deadline=None)
@given(st.integers(0, 10**6), st.sampled_from(FORMULAS))
def test_bounds_hold(seed, formula):
    """No value of random points in random boxes is beyond the bounds; NaN only where nothing is known."""
    r = np.random.default_rng(seed)
    q = PairReduce(formula, ALIASES, "Sum", 1)
    boxes, values = {}, {}
    for v in q.formula.variables():
        low = r.normal(size=v.dim) * 2
        high = low + r.exponential(size=v.dim) * r.choice([0.0, 0.1, 2.0])
        boxes[v.key] = (low, high)
        points = low + (high - low) * r.random((30, v.dim))
        values[v.key] = points[:, None] if v.cat == 0 else points[None]
    low, high = bounds(q.formula, boxes)
    with np.errstate(all="ignore"):
        got = np.broadcast_to(on_blocks(q.formula, values), (30, 30, q.formula.dim))
    low, high = np.broadcast_to(low, got.shape), np.broadcast_to(high, got.shape)
    fine = (got >= low - 1e-9 * (1 + np.abs(got))) & (got <= high + 1e-9 * (1 + np.abs(got)))
    assert (fine | (np.isnan(got) & (low == -np.inf) & (high == np.inf))).all()


def _sides(spark, rows=300):
    r = np.random.default_rng(3)
    centres = r.normal(size=(12, 3)) * 6
    x, y = centres[r.integers(0, 12, rows)] + r.normal(size=(rows, 3)) * 0.2, centres[r.integers(0, 12, rows)] + r.normal(size=(rows, 3)) * 0.2
    b = r.normal(size=rows)
    left = spark.createDataFrame([(i, v.tolist(), "other") for i, v in enumerate(x)], "i long, x array<double>, note string")
    right = spark.createDataFrame([(j, v.tolist(), float(w)) for j, (v, w) in enumerate(zip(y, b, strict=True))], "j long, y array<double>, b double")
    return left, right, x, y, b


@pytest.mark.parametrize("kernel", ["gauss", "laplace", "vector", "transposed"])
@pytest.mark.parametrize("many", [False, True])
def test_within_the_bound(spark, monkeypatch, kernel, many):
    left, right, x, y, b = _sides(spark)
    if many:  # boxes meet as pairs of blocks
        monkeypatch.setattr(truncate, "BOXES", 3)
    left, right = cells(left, "x", 1.0, 3, "bi"), cells(right, "y", 1.0, 3, "bj")
    d2 = ((x[:, None] - y[None]) ** 2).sum(-1)
    formula, want = {
        "gauss": ("Exp(-SqDist(x,y))*b", (np.exp(-d2) @ b)[:, None]),
        "laplace": ("Exp(-Norm2(x-y))*b", (np.exp(-np.sqrt(d2)) @ b)[:, None]),
        "vector": ("Exp(-SqDist(x,y))*(x-y)", np.einsum("ij,ijd->id", np.exp(-d2), x[:, None] - y[None])),
        "transposed": ("Exp(-SqDist(x,y))*b", (np.exp(-d2).sum(0) * b)[:, None]),
    }[kernel]
    q = PairReduce(formula, ALIASES, "Sum", 0 if kernel == "transposed" else 1)
    tolerance = 0.05
    got = {r[0]: (r.value, r.bound) for r in truncated_sum(q, left, right, tolerance).collect()}
    assert len(got) == 300
    error = np.abs(np.array([got[i][0] for i in range(300)]) - want)
    bound = np.array([got[i][1] for i in range(300)])
    assert (bound <= tolerance).all() and (error <= bound + 1e-12).all()
    chosen = kept_blocks(q, left, right, tolerance).agg(F.sum(F.size("theirs"))).first()[0]
    blocks = left.select("bi").distinct().count() * right.select("bj").distinct().count()
    assert chosen < blocks * (0.6 if many or kernel == "laplace" else 0.35)


def test_odd_rows_and_empty_tables(spark):
    q = PairReduce("Exp(-SqDist(x,y))*b", ALIASES, "Sum", 1)
    left = spark.createDataFrame([(1, [0.0, 0.0, 0.0], "a"), (2, [99.0, 0.0, 0.0], "b"), (2, [99.0, 0.0, 0.0], "b")], "i long, x array<double>, bi string")
    right = spark.createDataFrame([(1, [0.0, 0.0, 0.0], 1.0, 1), (2, [float("nan"), 0.0, 0.0], 1.0, 2)], "j long, y array<double>, b double, bj int")
    # a NaN stays a NaN for all rows
    assert all(np.isnan(r.value[0]) and r.bound == [0.0] for r in truncated_sum(q, left, right.where("j = 2"), 0.1).collect())
    got = sorted((r.i, r.value[0]) for r in truncated_sum(q, left, right.where("j = 1"), 0.0).collect())
    assert got == [(1, 1.0), (2, 0.0), (2, 0.0)]
    assert [(r.value, r.bound) for r in truncated_sum(q, left, right.limit(0), 0.1).collect()] == [([0.0], [0.0])] * 3
    assert truncated_sum(q, left.limit(0), right, 0.1).count() == 0
    with pytest.raises(Exception, match="null"):
        truncated_sum(q, left.withColumn("bi", F.lit(None).cast("string")), right, 0.1).count()
    with pytest.raises(ValueError, match="sums only"):
        truncated_sum(PairReduce("SqDist(x,y)", ALIASES, "Min", 1), left, right, 0.1)
    with pytest.raises(ValueError, match="no value for parameter"):
        truncated_sum(PairReduce("Exp(-g*SqDist(x,y))", [*ALIASES, "g = Pm(1)"], "Sum", 1), left, right, 0.1)


@pytest.mark.parametrize("axis", [1, 0])
def test_equal_rows_are_evaluated_once(spark, monkeypatch, axis):
    """Copies of points count with their weights; what is evaluated grows with the distinct rows only."""
    r = np.random.default_rng(11)
    points, copies = r.random((30, 2)) * 4, 20
    points[0] = [0.0, -0.0]
    rows = [(n, points[n % 30].tolist(), float(n % 7)) for n in range(30 * copies)]
    left = truncate.cells(spark.createDataFrame([x[:2] for x in rows], "i long, x array<double>"), "x", 0.5, 2, "bi")
    right = truncate.cells(spark.createDataFrame(rows, "j long, y array<double>, b double"), "y", 0.5, 2, "bj")
    seen, run = [], PairReduce.run

    def counted(self, a, b, *args, **more):
        seen.append((a.count(), b.count()))
        return run(self, a, b, *args, **more)

    monkeypatch.setattr(PairReduce, "run", counted)
    formula = "Exp(-3*SqDist(x,y))*b" if axis else "Exp(-3*SqDist(x,y))"
    got = truncate.truncated_sum(PairReduce(formula, ["x = Vi(2)", "y = Vj(2)"] + ["b = Vj(1)"] * axis, "Sum", axis), left, right, 1e-9).collect()
    assert seen == [(30, 30)] and len(got) == 30 * copies
    k = np.exp(-3 * ((points[:, None] - points[None]) ** 2).sum(-1))
    want = k @ [sum(b for n, _, b in rows if n % 30 == p) for p in range(30)] if axis else k.sum(0) * copies
    for row in got:
        assert abs(row.value[0] - want[(row.i if axis else row.j) % 30]) <= row.bound[0] + 1e-9 and row.bound[0] <= 1e-9
