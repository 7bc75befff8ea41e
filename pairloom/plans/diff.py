"""Symbolic calculus: every result is a formula again, and runs as any other."""

from __future__ import annotations

from pairloom.functions import ops
from pairloom.plans.expr import Expr, IntCst, Op, Var, Zero, call, is_zero, spread


def gradient(f: Expr, v: Var, e: Expr | None = None) -> Expr:
    """Adjoint of the derivative of ``f`` by ``v``, applied to ``e`` (of f's length)."""
    if e is None:
        if f.dim != 1:
            raise ValueError("a gradient of a vector needs the vector it is applied to")
        e = IntCst(1)
    if e.dim != f.dim:
        raise ValueError(f"applied to length {e.dim}, not {f.dim}")
    if f.key == v.key:
        return e
    if is_zero(e) or v.key not in {x.key for x in f.variables()}:
        return Zero(v.dim)
    if not isinstance(f, Op):
        return Zero(v.dim)
    adjoint = ops.TABLE[f.name].adjoint
    if adjoint is None:
        raise NotImplementedError(f"{f.name} has no gradient")
    total: Expr = Zero(v.dim)
    for child, part in zip(f.children, adjoint(f.children, f.params, e), strict=True):
        if v.key in {x.key for x in child.variables()} and not is_zero(part):
            total = total + gradient(child, v, spread(part, child.dim) if part.dim != child.dim else part)
    return total


def _marker(f: Expr, dim: int, cat: int) -> Var:
    """A variable that ``f`` doesn't have."""
    return Var(min([-1, *(x.ind - 1 for x in f.variables())]), dim, cat)


def adjoint_operator(f: Expr, v: Var, u: Expr) -> Expr:
    """For ``f`` linear in ``v``: the transposed map, applied to ``u``."""
    return gradient(f, v, u)


def differential(f: Expr, v: Var, u: Expr) -> Expr:
    """Directional derivative of ``f`` by ``v`` along ``u``: the adjoint of the gradient, which is linear."""
    if u.dim != v.dim:
        raise ValueError(f"direction of length {u.dim}, not {v.dim}")
    if v.key not in {x.key for x in f.variables()}:
        return Zero(f.dim)
    w = _marker(f, f.dim, v.cat)
    return gradient(gradient(f, v, w), w, u)


def _unit(k: int, n: int) -> Expr:
    return IntCst(1) if n == 1 else call("ElemT", IntCst(1), params=(n, k))


def gradient_matrix(f: Expr, v: Var) -> Expr:
    """The gradients of all components of ``f``, one after another."""
    out = gradient(f, v, _unit(0, f.dim))
    for k in range(1, f.dim):
        out = call("Concat", out, gradient(f, v, _unit(k, f.dim)))
    return out


def trace_operator(f: Expr, v: Var, w: Expr | None = None) -> Expr:
    """Trace of ``f`` as a linear map of ``v`` (times ``w``)."""
    if f.dim != v.dim:
        raise ValueError(f"trace of a map from length {v.dim} to {f.dim}")
    total: Expr = IntCst(0)
    for k in range(v.dim):
        row = gradient(f, v, _unit(k, f.dim))
        total = total + (call("Elem", row, params=(k,)) if v.dim > 1 else row)
    return total if w is None else total * w


def sum_operator(f: Expr, v: Var, wl: Expr | None = None, wr: Expr | None = None) -> Expr:
    """Sum of the entries of ``f`` as a matrix acting on ``v``, weighted left and right."""
    left = wl if wl is not None else spread(IntCst(1), f.dim)
    row = gradient(f, v, left)
    return call("Sum", row if wr is None else row * wr)


def divergence(f: Expr, v: Var) -> Expr:
    if f.dim != v.dim:
        raise ValueError(f"divergence by length {v.dim} of length {f.dim}")
    return trace_operator(f, v)


def laplacian(f: Expr, v: Var) -> Expr:
    if f.dim != 1:
        raise ValueError("the Laplacian takes a scalar")
    return divergence(gradient(f, v), v)


CALCULUS = {
    "Grad": gradient, "Diff": differential, "GradMatrix": gradient_matrix, "Divergence": divergence, "Laplacian": laplacian,
    "AdjointOperator": adjoint_operator, "TraceOperator": trace_operator, "SumLinOperator": sum_operator,
}
