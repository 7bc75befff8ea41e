"""Parsing, simplification and derivatives, without Spark."""

import numpy as np
import pytest

from pairloom.plans.diff import differential, divergence, gradient, laplacian
from pairloom.plans.evaluate import on_blocks
from pairloom.plans.expr import IntCst, Var, Zero, call
from pairloom.plans.parse import parse, parse_alias

X, Y = Var(0, 4, 0, "x"), Var(1, 4, 1, "y")

UNARY = (
    "Minus Inv Exp Log XLogX Sin Cos SinXDivX Atan Square Sqrt Rsqrt Abs ReLU Sum Max Min SqNorm2 Norm2 Normalize Sign Step Floor "
    "ComplexReal ComplexImag Real2Complex Imag2Complex Conj ComplexSquareAbs ComplexAbs ComplexAngle ComplexExp ComplexExp1j ComplexSum"
).split()
FORMULAS = [f"{n}(x)" for n in UNARY] + [
    "Asin(x/9)", "Acos(x/9)", "x/y", "Atan2(x,y)", "Powf(x,y)", "x+y", "x-y", "x*y", "Pow(x,3)", "Clamp(x,y,y+1/4)", "ClampInt(x,1,2)",
    "IfElse(x-y,x*y,y)", "Mod(x,y,Elem(x,0))", "(x|y)", "SqDist(x,y)", "SqNormIso(Elem(y,1),x)", "SqNormDiag(y,x)", "SymSqNorm(TensorProd(x,y),x)",
    "WeightedSqDist(y,x,x*x)", "MatVecMult(TensorProd(x,y),x)", "VecMatMult(x,TensorProd(x,y))", "TensorProd(x,y)",
    "TensorDot(TensorProd(x,y),TensorProd(x,x),[4,4],[4,4],[1],[0],[1,0])", "Kron(x,y,[2,2],[2,2])", "Elem(x,2)", "Extract(x,1,2)", "ExtractT(x,1,6)",
    "ElemT(Elem(x,0),3,1)", "Concat(x,y*x)", "SumT(Elem(x,1),3)", "ComplexAdd(x,y)", "ComplexSubtract(x,Extract(x,0,2))", "ComplexMult(x,y)",
    "ComplexDivide(x,y)", "ComplexDivide(y,Extract(x,0,2))", "ComplexRealScal(Elem(x,0),x)", "ComplexSumT(Extract(x,0,2),6)", "Exp(-SqDist(x,y))*y",
]


def values(seed=0):
    rng = np.random.default_rng(seed)
    return rng, rng.uniform(0.5, 3, (2, 1, 4)), rng.uniform(0.5, 3, (1, 3, 4))


@pytest.mark.parametrize("formula", [*FORMULAS, "SoftDTW_SqDist(x,y,Elem(y,0))"])
def test_gradient_and_differential_match_finite_differences(formula):
    rng, x, y = values()
    e, _ = parse(formula, [X, Y])
    w, u = Var(9, e.dim, 0), Var(8, 4, 0)
    weight, way = rng.normal(size=(2, 1, e.dim)), rng.normal(size=(2, 1, 4))
    at = lambda v: on_blocks(e, {X.key: v, Y.key: y})
    got = np.broadcast_to(on_blocks(gradient(e, X, w), {X.key: x, Y.key: y, w.key: weight}), (2, 3, 4))
    want = np.zeros((2, 3, 4))
    for k in range(4):
        h = np.zeros((2, 1, 4))
        h[..., k] = 1e-6
        want[..., k] = ((at(x + h) - at(x - h)) / 2e-6 * weight).sum(-1)
    assert np.allclose(got, want, atol=1e-4, rtol=1e-4)
    if "SoftDTW" not in formula:
        d = on_blocks(differential(e, X, u), {X.key: x, Y.key: y, u.key: way})
        assert np.allclose(d, (at(x + 1e-6 * way) - at(x - 1e-6 * way)) / 2e-6, atol=1e-4, rtol=1e-4)


def test_second_derivatives():
    _, x, y = values()
    k, _ = parse("Exp(-SqDist(x,y))", [X, Y])
    d = ((x - y) ** 2).sum(-1, keepdims=True)
    got = on_blocks(laplacian(k, X), {X.key: x, Y.key: y})
    assert np.allclose(got, np.exp(-d) * (4 * d - 8))
    assert np.allclose(on_blocks(divergence(k * X, X), {X.key: x, Y.key: y}), np.exp(-d) * (4 - 2 * ((x - y) * x).sum(-1, keepdims=True)))


def test_simplification():
    assert isinstance(X - X, Zero) and (X + 0) is X and (1 * X) is X and -(-X) is X
    assert str(2 * X + 3 * X) == "Mult(IntCst(5),x)"
    assert str(X * X) == "Square(x)" and str(X / 2) == "Mult(RatCst(1,2),x)"
    assert (IntCst(2) / IntCst(6)).value * 3 == 1
    assert str(call("Sum", X * Y)) == "Scalprod(x,y)"
    assert str(call("Exp", X) * call("Exp", Y)) == "Exp(Add(x,y))"
    g, _ = parse("x + y", [X, Y])
    assert isinstance(gradient(gradient(g, X, Var(7, 4, 1)), X, Var(6, 4, 0)), Zero)


@pytest.mark.parametrize("text", ["__import__('os')", "x.y", "Nope(x)", "x if x else y", "z + 1", "x[0]"])
def test_what_is_not_a_formula_is_refused(text):
    with pytest.raises(ValueError):
        parse(text, [X, Y])


def test_dimensions_are_checked():
    for text in ("x + Extract(y,0,2)", "(x | Extract(y,0,2))", "Elem(x,4)", "Extract(x,3,2)", "OneHot(x,3)", "Laplacian(x,x)"):
        with pytest.raises(ValueError):
            parse(text, [X, Y])
    with pytest.raises(ZeroDivisionError):
        X / Zero(1)


def test_aliases():
    v = parse_alias("b = Vj(2, 5)", 0)
    assert (v.ind, v.dim, v.cat, v.name) == (2, 5, 1, "b")
    assert parse_alias("Var(3,2,2)", 0).cat == 2
    e, found = parse("Square(Var(0,3,0) - Var(1,3,1)) * Pm(2,1)")
    assert [v.cat for v in found] == [0, 1, 2] and e.dim == 3


def test_edges_of_functions():
    v = lambda *x: np.array(x, float).reshape(1, 1, -1)
    def f(t, *x):
        return on_blocks(parse(t, [Var(0, len(x), 0, "x")])[0], {("Var", 0, len(x), 0): v(*x)}).ravel().tolist()
    assert f("Step(x)", 0.0, -1.0) == [1, 0] and f("Rsqrt(x)", 0.0, 4.0) == [0, 0.5] and f("SinXDivX(x)", 0.0) == [1]
    assert f("XLogX(x)", 0.0) == [0] and f("Log(x)", 0.0) == [-np.inf] and f("Inv(x)", 0.0) == [np.inf]
    assert f("Round(x,0)", 2.5, -2.5) == [3, -3] and f("Mod(x,3,0)", -1.0) == [2] and f("ClampInt(x,2,1)", 0.0, 3.0) == [2, 1]
    assert f("ArgMax(x)", 1.0, 5.0, 5.0) == [1] and f("OneHot(x,3)", 1.6) == [0, 0, 1] and f("Normalize(x)", 0.0, 0.0) == [0, 0]
    assert f("BSpline(x,Elem(x,1)/2,1)", 0.0, 1.0, 2.0, 3.0) == [0.5, 0.0]
