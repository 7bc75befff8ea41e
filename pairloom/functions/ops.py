"""Registry of formula operations.

Each entry has a rule for its vector length, a numpy kernel over blocks of
pairs (arrays of shape (rows i, rows j, length), broadcast along i or j), a
Column form over lists of component columns, and partial derivatives.  New
operations register the same way.
"""

from __future__ import annotations

import math
from collections.abc import Callable
from dataclasses import dataclass

import numpy as np
from pyspark.sql import Column
from pyspark.sql import functions as F

from pairloom.plans.expr import Const, Expr, IntCst, Zero, call, is_zero, joint_dim, node, spread

NAN, INF = float("nan"), float("inf")


@dataclass
class Operation:
    name: str
    arity: int | None
    dim: Callable
    kernel: Callable  # (*arrays, *params) -> array
    columns: Callable | None  # (*lists of Column, *params) -> list of Column
    #: (args, params, e) -> adjoint of each argument applied to e; None: not differentiable
    adjoint: Callable | None = None
    rewrite: Callable | None = None
    #: each component of the result comes from the same component of the arguments (or from one of length 1)
    by_component: bool = False


TABLE: dict[str, Operation] = {}


class Precision:
    """Where the order of values decides (indices, K lowest), equal rows must give equal values.

    Matrix products add up in an order that depends on the place of a row, so
    they are used for other reductions only.
    """

    ordered = False


def register(name, arity, dim, kernel, columns, adjoint=None, rewrite=None) -> None:
    TABLE[name] = Operation(name, arity, dim, kernel, columns, adjoint, rewrite)


def _fit(e: Expr, dim: int) -> Expr:
    """Adjoint of broadcasting: a scalar argument gathers the components."""
    return e if e.dim == dim else call("Sum", e)


def elementwise(name, arity, kernel, column, partials=None, zero_gradient=False, rewrite=None):
    """``partials(args, params)``: derivative with respect to each argument."""

    def columns(*args):
        vectors, params = args[:arity], args[arity:]
        size = max(map(len, vectors))
        at = lambda v, k: v[0] if len(v) == 1 else v[k]
        return [column(*(at(v, k) for v in vectors), *params) for k in range(size)]

    def adjoint(args, params, e):
        if zero_gradient:
            return [Zero(a.dim) for a in args]
        return [_fit(e * d if not is_zero(d) else Zero(e.dim), a.dim) for a, d in zip(args, partials(args, params), strict=True)]

    register(name, arity, lambda a, p: joint_dim(*a), kernel, columns, adjoint if partials or zero_gradient else None, rewrite)
    TABLE[name].by_component = True


def _c(x) -> Column:
    return F.lit(float(x))


def safe_div(x: Column, y: Column) -> Column:
    """IEEE division: x / 0 is an infinity, 0 / 0 is NaN."""
    zero = F.when((x == 0) | F.isnan(x), _c(NAN)).when((x > 0) == (y.cast("string") != "-0.0"), _c(INF)).otherwise(_c(-INF))
    return F.when(y == 0, zero).otherwise(F.try_divide(x, y))


def _quiet(f: Callable) -> Callable:
    def run(*args):
        with np.errstate(all="ignore"):
            return f(*args)

    return run


def _truth(f: Callable) -> Callable:
    return lambda *a: F.when(f(*a), _c(1)).otherwise(_c(0))


def _half_away(x, d=0):
    s = 10.0**d
    return np.copysign(np.floor(np.abs(x) * s + 0.5) / s, x)


_x = lambda a, p: a[0]
one = IntCst(1)

# -- arithmetic -----------------------------------------------------------
elementwise("Add", 2, lambda a, b: a + b, lambda a, b: a + b, lambda a, p: [one, one])
elementwise("Subtract", 2, lambda a, b: a - b, lambda a, b: a - b, lambda a, p: [one, IntCst(-1)])
elementwise("Minus", 1, lambda a: -a, lambda a: -a, lambda a, p: [IntCst(-1)])
elementwise("Mult", 2, lambda a, b: a * b, lambda a, b: a * b, lambda a, p: [a[1], a[0]])
elementwise("Divide", 2, _quiet(lambda a, b: a / b), safe_div, lambda a, p: [call("Inv", a[1]), -a[0] / call("Square", a[1])])
elementwise("Inv", 1, _quiet(lambda a: 1.0 / a), lambda a: safe_div(_c(1), a), lambda a, p: [-call("Square", call("Inv", a[0]))])

# -- functions of one number ------------------------------------------------
elementwise("Exp", 1, _quiet(np.exp), F.exp, lambda a, p: [call("Exp", a[0])])
elementwise(
    "Log", 1, _quiet(np.log),
    lambda x: F.when(x == 0, _c(-INF)).when((x < 0) | F.isnan(x), _c(NAN)).otherwise(F.log(x)),
    lambda a, p: [call("Inv", a[0])],
)
elementwise(
    "XLogX", 1, _quiet(lambda x: np.where(x == 0, 0.0, x * np.log(np.where(x == 0, 1.0, x)))),
    lambda x: F.when(x == 0, _c(0)).when((x < 0) | F.isnan(x), _c(NAN)).otherwise(x * F.log(x)),
    lambda a, p: [call("Log", a[0]) + 1],
)
elementwise("Sin", 1, np.sin, F.sin, lambda a, p: [call("Cos", a[0])])
elementwise("Cos", 1, np.cos, F.cos, lambda a, p: [-call("Sin", a[0])])
elementwise(
    "SinXDivX", 1, lambda x: np.sinc(x / np.pi), lambda x: F.when(x == 0, _c(1)).otherwise(F.try_divide(F.sin(x), x)),
    # (cos x - sinc x) / x; at 0 the quotient is 0 / 0 and the slope 0
    lambda a, p: [call("SinXDivXSlope", a[0])],
)
elementwise(
    "SinXDivXSlope", 1, _quiet(lambda x: np.where(x == 0, 0.0, (np.cos(x) - np.sinc(x / np.pi)) / np.where(x == 0, 1.0, x))),
    lambda x: F.when(x == 0, _c(0)).otherwise(F.try_divide(F.cos(x) - F.try_divide(F.sin(x), x), x)),
    lambda a, p: [-call("SinXDivX", a[0]) - 2 * call("SinXDivXSlope", a[0]) * call("Inv", a[0])],
)
elementwise("Asin", 1, _quiet(np.arcsin), F.asin, lambda a, p: [call("Rsqrt", 1 - call("Square", a[0]))])
elementwise("Acos", 1, _quiet(np.arccos), F.acos, lambda a, p: [-call("Rsqrt", 1 - call("Square", a[0]))])
elementwise("Atan", 1, np.arctan, F.atan, lambda a, p: [call("Inv", 1 + call("Square", a[0]))])
elementwise(
    "Atan2", 2, np.arctan2, F.atan2,
    lambda a, p: [a[1] / (call("Square", a[0]) + call("Square", a[1])), -a[0] / (call("Square", a[0]) + call("Square", a[1]))],
)
elementwise(
    "Pow", 1, _quiet(lambda x, m: np.power(x, float(m))), lambda x, m: F.pow(x, _c(m)),
    lambda a, p: [IntCst(p[0]) * call("Pow", a[0], params=(p[0] - 1,))],
    rewrite=lambda a, p: a[0] if p[0] == 1 else IntCst(1) if p[0] == 0 and a[0].dim == 1 else Const(a[0].value ** p[0]) if isinstance(a[0], Const) and a[0].value else None,
)
elementwise("Powf", 2, _quiet(np.power), F.pow, lambda a, p: [a[1] * call("Powf", a[0], a[1] - 1), call("Log", a[0]) * call("Powf", a[0], a[1])])
elementwise("Square", 1, lambda x: x * x, lambda x: x * x, lambda a, p: [2 * a[0]], rewrite=lambda a, p: Const(a[0].value ** 2) if isinstance(a[0], Const) else a[0] if isinstance(a[0], Zero) else None)
elementwise("Sqrt", 1, _quiet(np.sqrt), F.sqrt, lambda a, p: [call("Rsqrt", a[0]) / 2])
elementwise(
    "Rsqrt", 1, _quiet(lambda x: np.where(x == 0, 0.0, 1 / np.sqrt(np.where(x == 0, 1.0, x)))),
    lambda x: F.when(x == 0, _c(0)).when(x < 0, _c(NAN)).otherwise(F.try_divide(_c(1), F.sqrt(x))),
    lambda a, p: [call("Pow", call("Rsqrt", a[0]), params=(3,)) / -2],
)
elementwise("Abs", 1, np.abs, F.abs, lambda a, p: [call("Sign", a[0])])
elementwise("Sign", 1, lambda x: np.sign(x) + 0.0, lambda x: F.signum(x) + 0.0, zero_gradient=True)
elementwise("Step", 1, lambda x: np.where(x < 0, 0.0, 1.0), lambda x: F.when(x < 0, _c(0)).otherwise(_c(1)), zero_gradient=True)
elementwise("ReLU", 1, lambda x: np.where(x < 0, 0.0, x), lambda x: F.when(x < 0, _c(0)).otherwise(x), lambda a, p: [call("Step", a[0])])
elementwise(
    "Clamp", 3, lambda x, a, b: np.where(x < a, a, np.where(x > b, b, x)), lambda x, a, b: F.when(x < a, a).when(x > b, b).otherwise(x),
    lambda a, p: [call("IfElse", a[0] - a[1], call("IfElse", a[2] - a[0], one, IntCst(0)), IntCst(0)),
                  a[0] < a[1], (a[1] <= a[0]) * (a[2] < a[0])],
)
elementwise(
    "ClampInt", 1, lambda x, a, b: np.where(x < a, float(a), np.where(x > b, float(b), x)),
    lambda x, a, b: F.when(x < a, _c(a)).when(x > b, _c(b)).otherwise(x),
    lambda a, p: [call("DiffClampInt", a[0], params=p)],
)
elementwise(
    "DiffClampInt", 1, lambda x, a, b: np.where((x < a) | (x > b), 0.0, 1.0),
    lambda x, a, b: F.when((x < a) | (x > b), _c(0)).otherwise(_c(1)), zero_gradient=True,
)
elementwise(
    "IfElse", 3, lambda f, a, b: np.where(f >= 0, a, b), lambda f, a, b: F.when((f >= 0) & ~F.isnan(f), a).otherwise(b),
    lambda a, p: [IntCst(0), call("Step", a[0]), 1 - call("Step", a[0])],
)
elementwise(
    "Mod", 3, _quiet(lambda x, n, d: x - n * np.floor((x - d) / n)), lambda x, n, d: x - n * F.floor(safe_div(x - d, n)).cast("double"),
    lambda a, p: [one, -call("Floor", (a[0] - a[2]) / a[1]), IntCst(0)],
)
elementwise("Floor", 1, np.floor, lambda x: F.floor(x).cast("double"), zero_gradient=True)
elementwise("Round", 1, _half_away, lambda x, d: F.round(x, d), zero_gradient=True)
elementwise("Equal", 2, lambda a, b: (a == b) * 1.0, _truth(lambda a, b: (a == b) & ~F.isnan(a)), zero_gradient=True)
elementwise("NotEqual", 2, lambda a, b: (a != b) * 1.0, _truth(lambda a, b: (a != b) | F.isnan(a)), zero_gradient=True)
elementwise("LessThan", 2, lambda a, b: (a < b) * 1.0, _truth(lambda a, b: (a < b) & ~F.isnan(b)), zero_gradient=True)
elementwise("LessOrEqual", 2, lambda a, b: (a <= b) * 1.0, _truth(lambda a, b: (a <= b) & ~F.isnan(b)), zero_gradient=True)


# -- shapes of a vector -------------------------------------------------------
def _total(cols):
    out = cols[0]
    for c in cols[1:]:
        out = out + c
    return out


def _sum_rewrite(a, p):
    x = a[0]
    if isinstance(x, Zero):
        return Zero(1)
    if x.dim == 1:
        return x
    if getattr(x, "name", "") == "SumT":
        return x.dim * x.children[0]
    if getattr(x, "name", "") == "Minus":
        return -call("Sum", x.children[0])
    if getattr(x, "name", "") == "Mult":
        f, g = x.children
        if f.dim == 1:
            return f * call("Sum", g)
        if g.dim == 1:
            return g * call("Sum", f)
        return f | g
    return None


register("Sum", 1, lambda a, p: 1, lambda x: x.sum(-1, keepdims=True), lambda x: [_total(x)], lambda a, p, e: [spread(e, a[0].dim)], _sum_rewrite)
register("SumT", 1, lambda a, p: p[0], lambda x, d: np.broadcast_to(x, (*x.shape[:-1], d)), lambda x, d: x * d, lambda a, p, e: [call("Sum", e)],
         lambda a, p: Zero(p[0]) if is_zero(a[0]) else a[0] if p[0] == 1 else None)


def _arg(cols, better):
    best, at = cols[0], _c(0)
    best = F.when(F.isnan(best), _c(NAN)).otherwise(best)
    for k, c in enumerate(cols[1:], 1):
        wins = better(c, best) & ~F.isnan(c) & ~F.isnan(cols[0])
        best, at = F.when(wins, c).otherwise(best), F.when(wins, _c(k)).otherwise(at)
    return best, at


def _first(x, f, worst):
    return f(np.where(np.isnan(x), worst, x), -1)[..., None].astype(float)


register("Max", 1, lambda a, p: 1, _quiet(lambda x: np.fmax.reduce(x, -1, keepdims=True)), lambda x: [F.greatest(*(F.when(~F.isnan(c), c) for c in x), _c(-INF))] if len(x) > 1 else x,
         lambda a, p, e: [e * call("OneHot", call("ArgMax", a[0]), params=(a[0].dim,))])
register("Min", 1, lambda a, p: 1, _quiet(lambda x: np.fmin.reduce(x, -1, keepdims=True)), lambda x: [F.least(*(F.when(~F.isnan(c), c) for c in x), _c(INF))] if len(x) > 1 else x,
         lambda a, p, e: [e * call("OneHot", call("ArgMin", a[0]), params=(a[0].dim,))])
register("ArgMax", 1, lambda a, p: 1, lambda x: _first(x, np.argmax, -INF), lambda x: [_arg(x, lambda c, b: c > b)[1]], lambda a, p, e: [Zero(a[0].dim)])
register("ArgMin", 1, lambda a, p: 1, lambda x: _first(x, np.argmin, INF), lambda x: [_arg(x, lambda c, b: c < b)[1]], lambda a, p, e: [Zero(a[0].dim)])


def _bounds(a, low, high, size):
    if not 0 <= low < high <= size:
        raise ValueError(f"[{low}, {high}) is not within a vector of length {size}")


def _elem_dim(a, p):
    _bounds(a, p[0], p[0] + 1, a[0].dim)
    return 1


def _extract_dim(a, p):
    _bounds(a, p[0], p[0] + p[1], a[0].dim)
    return p[1]


def _place(x, start, size):
    out = np.zeros((*x.shape[:-1], size))
    out[..., start : start + x.shape[-1]] = x
    return out


def _place_columns(x, start, size):
    return [_c(0)] * start + list(x) + [_c(0)] * (size - start - len(x))


register("Elem", 1, _elem_dim, lambda x, m: x[..., m : m + 1], lambda x, m: [x[m]], lambda a, p, e: [call("ElemT", e, params=(a[0].dim, p[0]))],
         lambda a, p: IntCst(0) if isinstance(a[0], Zero) else None)
register("ElemT", 1, lambda a, p: p[0], lambda x, n, m: _place(x, m, n), lambda x, n, m: _place_columns(x, m, n), lambda a, p, e: [call("Elem", e, params=(p[1],))])
register("Extract", 1, _extract_dim, lambda x, s, d: x[..., s : s + d], lambda x, s, d: x[s : s + d], lambda a, p, e: [call("ExtractT", e, params=(p[0], a[0].dim))],
         lambda a, p: Zero(p[1]) if isinstance(a[0], Zero) else a[0] if p == (0, a[0].dim) else None)
register("ExtractT", 1, lambda a, p: p[1], lambda x, s, d: _place(x, s, d), lambda x, s, d: _place_columns(x, s, d), lambda a, p, e: [call("Extract", e, params=(p[0], a[0].dim))],
         lambda a, p: Zero(p[1]) if isinstance(a[0], Zero) else None)


def _concat(x, y):
    shape = np.broadcast_shapes(x.shape[:-1], y.shape[:-1])
    return np.concatenate([np.broadcast_to(v, (*shape, v.shape[-1])) for v in (x, y)], -1)


register("Concat", 2, lambda a, p: a[0].dim + a[1].dim, _concat, lambda x, y: [*x, *y],
         lambda a, p, e: [call("Extract", e, params=(0, a[0].dim)), call("Extract", e, params=(a[0].dim, a[1].dim))])


def _scalar_only(a, p):
    if a[0].dim != 1:
        raise ValueError("OneHot takes a scalar")
    return p[0]


register("OneHot", 1, _scalar_only, lambda x, d: (np.floor(x + 0.5) == np.arange(d)) * 1.0,
         lambda x, d: [F.when(F.floor(x[0] + 0.5) == k, _c(1)).otherwise(_c(0)) for k in range(d)], lambda a, p, e: [Zero(1)])


def _bspline(knots, x, k, where, ratio):
    n = len(knots) - 1
    basis = [where(knots[i], x, knots[i + 1]) for i in range(n)]
    for order in range(1, k + 1):
        basis = [
            ratio(x - knots[i], knots[i + order] - knots[i]) * basis[i]
            + ratio(knots[i + order + 1] - x, knots[i + order + 1] - knots[i + 1]) * basis[i + 1]
            for i in range(n - order)
        ]
    return basis


@_quiet
def _bspline_kernel(knots, x, k):
    t = [knots[..., i : i + 1] for i in range(knots.shape[-1])]
    inside = lambda a, v, b: ((a <= v) & (v < b)) * 1.0
    ratio = lambda a, b: np.where(b == 0, 0.0, a / np.where(b == 0, 1.0, b))
    out = _bspline(t, x, k, inside, ratio)
    shape = np.broadcast_shapes(*(o.shape for o in out))
    return np.concatenate([np.broadcast_to(o, shape) for o in out], -1)


def _bspline_columns(knots, x, k):
    inside = lambda a, v, b: F.when((a <= v) & (v < b), _c(1)).otherwise(_c(0))
    ratio = lambda a, b: F.when(b == 0, _c(0)).otherwise(F.try_divide(a, b))
    return _bspline(knots, x[0], k, inside, ratio)


register("BSpline", 2, lambda a, p: a[0].dim - p[0] - 1, _bspline_kernel, _bspline_columns)


# -- norms and products ---------------------------------------------------------
def _same(a, p):
    if a[0].dim != a[1].dim:
        raise ValueError(f"dot product of lengths {a[0].dim} and {a[1].dim}")
    return 1


def _dot_rewrite(a, p):
    f, g = a
    if f.dim == 1 or g.dim == 1:
        return f * g if f.dim == g.dim == 1 else call("Sum", f * g)
    if is_zero(f) or is_zero(g):
        return Zero(1)
    for x, y in ((f, g), (g, f)):
        if getattr(x, "name", "") == "Mult" and x.children[0].dim == 1:
            return x.children[0] * (x.children[1] | y)
        if getattr(x, "name", "") == "Minus":
            return -(x.children[0] | y)
    return None


def _dot(x, y):
    if x.shape[0] == 1 and y.shape[1] == 1:
        x, y = y, x
    if x.shape[1] == 1 and y.shape[0] == 1 and not Precision.ordered:  # rows i against rows j: one matrix product
        return (x[:, 0] @ y[0].T)[..., None]
    if Precision.ordered:
        return sum(x[..., k] * y[..., k] for k in range(x.shape[-1]))[..., None]
    return (x * y).sum(-1, keepdims=True)


register("Scalprod", 2, _same, _dot, lambda x, y: [_total([a * b for a, b in zip(x, y, strict=True)])], lambda a, p, e: [e * a[1], e * a[0]], _dot_rewrite)


def _rewritten(name, arity, f):
    """An operation that is a composition of others."""
    register(name, arity, None, None, None, None, f)


_rewritten("SqNorm2", 1, lambda a, p: a[0] | a[0])
_rewritten("Norm2", 1, lambda a, p: call("Sqrt", a[0] | a[0]))
_rewritten("Normalize", 1, lambda a, p: call("Rsqrt", a[0] | a[0]) * a[0])
_rewritten("SqNormIso", 2, lambda a, p: a[0] * (a[1] | a[1]))
_rewritten("SqNormDiag", 2, lambda a, p: a[0] | call("Square", a[1]))
_rewritten("SymSqNorm", 2, lambda a, p: a[1] | call("MatVecMult", a[0], a[1]))
_rewritten("WeightedSqNorm", 2, lambda a, p: call("SqNormIso" if a[0].dim == 1 else "SqNormDiag" if a[0].dim == a[1].dim else "SymSqNorm", *a))
_rewritten("WeightedSqDist", 3, lambda a, p: call("WeightedSqNorm", a[0], a[1] - a[2]))
_rewritten("IntInv", 0, lambda a, p: Const(IntCst(1).value / p[0]))
_rewritten("Norm", 1, lambda a, p: call("Norm2", a[0]))


def _sqdist(x, y):
    if x.shape[0] == 1 and y.shape[1] == 1:
        x, y = y, x
    if not Precision.ordered and x.shape[1] == 1 and y.shape[0] == 1 and x.shape[-1] > 8:
        a, b = x[:, 0], y[0]
        # about a common point far fewer digits cancel
        m = b.mean(0)
        a, b = a - m, b - m
        d = (a * a).sum(1)[:, None] + (b * b).sum(1)[None] - 2 * (a @ b.T)
        return np.maximum(d, 0, where=~np.isnan(d), out=d)[..., None]
    out = 0.0
    for k in range(max(x.shape[-1], y.shape[-1])):
        d = x[..., min(k, x.shape[-1] - 1)] - y[..., min(k, y.shape[-1] - 1)]
        out = out + d * d
    return out[..., None]


register("SqDist", 2, lambda a, p: joint_dim(*a) * 0 + 1, _sqdist,
         lambda x, y: [_total([(x[k if len(x) > 1 else 0] - y[k if len(y) > 1 else 0]) * (x[k if len(x) > 1 else 0] - y[k if len(y) > 1 else 0]) for k in range(max(len(x), len(y)))])],
         lambda a, p, e: [_fit(2 * e * (a[0] - a[1]), a[0].dim), _fit(2 * e * (a[1] - a[0]), a[1].dim)],
         lambda a, p: Zero(1) if a[0].key == a[1].key else None)


def _quotient(size, by, what):
    if size % by:
        raise ValueError(f"{what}: {size} is no multiple of {by}")
    return size // by


_mat = lambda a, n, p: a.reshape(*a.shape[:-1], n, p)
register("MatVecMult", 2, lambda a, p: _quotient(a[0].dim, a[1].dim, "MatVecMult"),
         lambda a, b: np.einsum("...np,...p->...n", _mat(a, a.shape[-1] // b.shape[-1], b.shape[-1]), b),
         lambda a, b: [_total([a[i * len(b) + k] * b[k] for k in range(len(b))]) for i in range(len(a) // len(b))],
         lambda a, p, e: [call("TensorProd", e, a[1]), call("VecMatMult", e, a[0])])
register("VecMatMult", 2, lambda a, p: _quotient(a[1].dim, a[0].dim, "VecMatMult"),
         lambda b, a: np.einsum("...n,...np->...p", b, _mat(a, b.shape[-1], a.shape[-1] // b.shape[-1])),
         lambda b, a: [_total([b[i] * a[i * (len(a) // len(b)) + k] for i in range(len(b))]) for k in range(len(a) // len(b))],
         lambda a, p, e: [call("MatVecMult", a[1], e), call("TensorProd", a[0], e)])
register("TensorProd", 2, lambda a, p: a[0].dim * a[1].dim, lambda a, b: (lambda t: t.reshape(*t.shape[:-2], -1))(a[..., :, None] * b[..., None, :]),
         lambda a, b: [x * y for x in a for y in b], lambda a, p, e: [call("MatVecMult", e, a[1]), call("VecMatMult", a[0], e)])


def tensordot_plan(da, db, ca, cb, perm=()):
    """(shape of the result, for each result entry the pairs of flat entries to multiply)."""
    if [da[k] for k in ca] != [db[k] for k in cb]:
        raise ValueError(f"contracted sizes differ: {da} over {ca}, {db} over {cb}")
    ia, ib = np.arange(math.prod(da)).reshape(da), np.arange(math.prod(db)).reshape(db)
    ka, kb = [k for k in range(len(da)) if k not in ca], [k for k in range(len(db)) if k not in cb]
    ia = ia.transpose(ka + list(ca)).reshape(math.prod([da[k] for k in ka]), -1)
    ib = ib.transpose(kb + list(cb)).reshape(math.prod([db[k] for k in kb]), -1)
    shape = [da[k] for k in ka] + [db[k] for k in kb]
    where = np.arange(math.prod(shape)).reshape(shape or [1])
    if perm:
        where = where.transpose(perm)
    left, right = np.divmod(where.ravel(), len(ib))
    return list(where.shape), ia[left], ib[right]


def _gather(a, b, size, triples):
    out = np.zeros((*np.broadcast_shapes(a.shape[:-1], b.shape[:-1]), size))
    for r, x, y in triples:
        out[..., r] += a[..., x] * b[..., y]
    return out


def _gather_columns(a, b, size, triples):
    out: list = [None] * size
    for r, x, y in triples:
        out[r] = a[x] * b[y] if out[r] is None else out[r] + a[x] * b[y]
    return [_c(0) if c is None else c for c in out]


def _gather_adjoint(args, params, e):
    (a, b), (_, triples) = args, params
    return [
        node("IndexedProduct", e, b, params=(a.dim, tuple((x, r, y) for r, x, y in triples)), dim=a.dim),
        node("IndexedProduct", e, a, params=(b.dim, tuple((y, r, x) for r, x, y in triples)), dim=b.dim),
    ]


def _tensordot(a, p):
    shape, ia, ib = tensordot_plan(*p)
    triples = tuple((r, x, y) for r, (m, n) in enumerate(zip(ia.tolist(), ib.tolist(), strict=True)) for x, y in zip(m, n, strict=True))
    return call("IndexedProduct", *a, params=(math.prod(shape), triples))


#: out[r] = sum of a[x] * b[y] over its (r, x, y): any bilinear map, and closed under adjoints
register("IndexedProduct", 2, lambda a, p: p[0], _gather, _gather_columns, _gather_adjoint)
register("TensorDot", 2, None, None, None, None, _tensordot)


def _kron(a, p):
    da, db = p
    if len(da) != len(db):
        raise ValueError("Kron takes shapes of as many axes")
    n = len(da)
    order = tuple(k for pair in zip(range(n), range(n, 2 * n), strict=True) for k in pair)
    return call("TensorDot", *a, params=(tuple(da), tuple(db), (), (), order))


_rewritten("Kron", 2, _kron)


# -- soft dynamic time warping -----------------------------------------------
def _softmin_tables(x, y, gamma):
    """Costs and the soft-minimum table, rim included; infinities outside."""
    n, m = x.shape[-1], y.shape[-1]
    shape = np.broadcast_shapes(x.shape[:-1], y.shape[:-1], gamma.shape[:-1])
    g = np.broadcast_to(gamma[..., 0], shape)
    cost = np.broadcast_to((x[..., :, None] - y[..., None, :]) ** 2, (*shape, n, m))
    r = np.full((*shape, n + 2, m + 2), INF)
    r[..., 0, 0] = 0.0
    with np.errstate(all="ignore"):
        for i in range(1, n + 1):
            for j in range(1, m + 1):
                three = np.stack([r[..., i - 1, j], r[..., i, j - 1], r[..., i - 1, j - 1]], -1)
                low = three.min(-1)
                soft = low - g * np.log(np.exp(-(three - low[..., None]) / g[..., None]).sum(-1))
                r[..., i, j] = cost[..., i - 1, j - 1] + soft
    return r, cost, g


def _softdtw(x, y, gamma):
    r, _, _ = _softmin_tables(x, y, gamma)
    return r[..., x.shape[-1], y.shape[-1]][..., None]


def _softdtw_gradient(x, y, gamma):
    r, cost, g = _softmin_tables(x, y, gamma)
    n, m = x.shape[-1], y.shape[-1]
    w = np.zeros_like(r)
    w[..., n, m] = 1.0
    with np.errstate(all="ignore"):
        for i in range(n, 0, -1):
            for j in range(m, 0, -1):
                if (i, j) != (n, m):
                    total = 0.0
                    for a, b in ((i + 1, j), (i, j + 1), (i + 1, j + 1)):
                        if a <= n and b <= m:
                            # share of this cell in the soft minimum behind cell (a, b)
                            total = total + w[..., a, b] * np.exp((r[..., a, b] - r[..., i, j] - cost[..., a - 1, b - 1]) / g)
                    w[..., i, j] = total
    d = 2 * (x[..., :, None] - y[..., None, :]) * w[..., 1 : n + 1, 1 : m + 1]
    return np.concatenate([d.sum(-1), -d.sum(-2)], -1)


def _softdtw_adjoint(a, p, e):
    both = call("GradSoftDTW_SqDist", *a)
    return [e * call("Extract", both, params=(0, a[0].dim)), e * call("Extract", both, params=(a[0].dim, a[1].dim)), Zero(1)]


register("SoftDTW_SqDist", 3, lambda a, p: 1, _softdtw, None, _softdtw_adjoint)
register("GradSoftDTW_SqDist", 3, lambda a, p: a[0].dim + a[1].dim, _softdtw_gradient, None)


# -- complex numbers: re, im, re, im ... ------------------------------------------
def _half(a, p):
    return _quotient(a[0].dim, 2, "complex vector")


def _z(x):
    return x[..., 0::2] + 1j * x[..., 1::2]


def _r(z):
    out = np.empty((*z.shape[:-1], 2 * z.shape[-1]))
    out[..., 0::2], out[..., 1::2] = z.real, z.imag
    return out


def _pairs(x):
    return list(zip(x[0::2], x[1::2], strict=True))


def _flat(pairs):
    return [c for p in pairs for c in p]


def complex_op(name, arity, kernel, pair, adjoint=None, real_out=False):
    """``kernel`` over complex arrays, ``pair`` over (re, im) columns of each argument."""

    def dim(a, p):
        for x in a:
            _quotient(x.dim, 2, name)
        sizes = {x.dim for x in a if x.dim != 2}
        if len(sizes) > 1:
            raise ValueError(f"{name}: dimensions {sorted(sizes)} do not go together")
        d = sizes.pop() if sizes else 2
        return d // 2 if real_out else d

    def columns(*vectors):
        zs = [_pairs(v) for v in vectors]
        out = [pair(*(z[k if len(z) > 1 else 0] for z in zs)) for k in range(max(map(len, zs)))]
        return out if real_out else _flat(out)

    register(name, arity, dim, _quiet(lambda *v: kernel(*map(_z, v)) if real_out else _r(kernel(*map(_z, v)))), columns, adjoint)


def _cfit(e, dim):
    return e if e.dim == dim else call("ComplexSum", e)


def _cmul(a, b):
    return (a[0] * b[0] - a[1] * b[1], a[0] * b[1] + a[1] * b[0])


def _cdiv(a, b):
    n = b[0] * b[0] + b[1] * b[1]
    t = _cmul(a, (b[0], -b[1]))
    return (safe_div(t[0], n), safe_div(t[1], n))


conj = lambda e: call("Conj", e)
register("ComplexReal", 1, _half, lambda x: x[..., 0::2], lambda x: x[0::2], lambda a, p, e: [call("Real2Complex", e)])
register("ComplexImag", 1, _half, lambda x: x[..., 1::2], lambda x: x[1::2], lambda a, p, e: [call("Imag2Complex", e)])
register("Real2Complex", 1, lambda a, p: 2 * a[0].dim, lambda x: _r(x + 0j), lambda x: _flat([(c, _c(0)) for c in x]), lambda a, p, e: [call("ComplexReal", e)])
register("Imag2Complex", 1, lambda a, p: 2 * a[0].dim, lambda x: _r(x * 1j), lambda x: _flat([(_c(0), c) for c in x]), lambda a, p, e: [call("ComplexImag", e)])
complex_op("Conj", 1, np.conj, lambda a: (a[0], -a[1]), lambda a, p, e: [conj(e)])
complex_op("ComplexSquareAbs", 1, lambda z: z.real**2 + z.imag**2, lambda a: a[0] * a[0] + a[1] * a[1],
           lambda a, p, e: [2 * call("ComplexMult", call("Real2Complex", e), a[0])], real_out=True)
_rewritten("ComplexAbs", 1, lambda a, p: call("Sqrt", call("ComplexSquareAbs", a[0])))
_rewritten("ComplexAngle", 1, lambda a, p: call("Atan2", call("ComplexImag", a[0]), call("ComplexReal", a[0])))
complex_op("ComplexExp", 1, np.exp, lambda a: (F.exp(a[0]) * F.cos(a[1]), F.exp(a[0]) * F.sin(a[1])),
           lambda a, p, e: [call("ComplexMult", conj(call("ComplexExp", a[0])), e)])
register("ComplexExp1j", 1, lambda a, p: 2 * a[0].dim, lambda x: _r(np.exp(1j * x)), lambda x: _flat([(F.cos(c), F.sin(c)) for c in x]),
         lambda a, p, e: [call("ComplexImag", call("ComplexMult", conj(call("ComplexExp1j", a[0])), e))])
complex_op("ComplexAdd", 2, lambda a, b: a + b, lambda a, b: (a[0] + b[0], a[1] + b[1]), lambda a, p, e: [_cfit(e, a[0].dim), _cfit(e, a[1].dim)])
complex_op("ComplexSubtract", 2, lambda a, b: a - b, lambda a, b: (a[0] - b[0], a[1] - b[1]), lambda a, p, e: [_cfit(e, a[0].dim), -_cfit(e, a[1].dim)])
complex_op("ComplexMult", 2, lambda a, b: a * b, _cmul,
           lambda a, p, e: [_cfit(call("ComplexMult", conj(a[1]), e), a[0].dim), _cfit(call("ComplexMult", conj(a[0]), e), a[1].dim)])
complex_op("ComplexDivide", 2, lambda a, b: a / b, _cdiv,
           lambda a, p, e: [_cfit(call("ComplexDivide", e, conj(a[1])), a[0].dim),
                            -_cfit(call("ComplexDivide", call("ComplexMult", e, conj(a[0])), conj(call("ComplexMult", a[1], a[1]))), a[1].dim)])


def _real_scal_dim(a, p):
    return (a[1] if a[0].dim == 1 else a[0]).dim


register("ComplexRealScal", 2, _real_scal_dim, lambda s, z: s * z, lambda s, z: [s[0] * c for c in z], lambda a, p, e: [a[1] | e, a[0] * e],
         lambda a, p: None if a[0].dim == 1 else node("ComplexRealScal", a[1], a[0], dim=a[0].dim))
register("ComplexSum", 1, lambda a, p: 2 + 0 * _half(a, p), lambda x: _r(_z(x).sum(-1, keepdims=True)), lambda x: [_total(x[0::2]), _total(x[1::2])],
         lambda a, p, e: [call("ComplexSumT", e, params=(a[0].dim,))])
register("ComplexSumT", 1, lambda a, p: p[0], lambda x, d: np.tile(x, d // 2), lambda x, d: list(x) * (d // 2), lambda a, p, e: [call("ComplexSum", e)])
_rewritten("ComplexScal", 2, lambda a, p: call("ComplexMult", *a))

#: The operations of this package; others that ``register`` adds travel with the formulas that use them.
BUILT_IN = frozenset(TABLE)
