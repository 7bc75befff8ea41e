"""What a formula can be at most and at least when each variable is within a box.

Interval arithmetic on trees: every operation with a rule maps the bounds of its
arguments to bounds of its result; one without a rule is unbounded, so what is
not understood is never taken to be small.  Arrays have any leading shape (one
entry for each pair of boxes) and the components last.
"""

from __future__ import annotations

from collections.abc import Callable

import numpy as np

from pairloom.plans.expr import Const, Expr, Var, Zero

INF = float("inf")
Bounds = tuple[np.ndarray, np.ndarray]
RULES: dict[str, Callable[..., Bounds]] = {}


def _rule(*names: str):
    def add(f):
        for n in names:
            RULES[n] = f
        return f

    return add


def _sure(low: np.ndarray, high: np.ndarray) -> Bounds:
    """Bounds without NaN: where one is undefined, nothing is known."""
    return np.where(np.isnan(low), -INF, low), np.where(np.isnan(high), INF, high)


def _products(a: Bounds, b: Bounds) -> Bounds:
    found = [x * y for x in a for y in b]
    return _sure(np.minimum.reduce(found), np.maximum.reduce(found))


def _inverse(a: Bounds) -> Bounds:
    low, high = a
    safe = (low > 0) | (high < 0)
    return np.where(safe, 1 / np.where(safe, high, 1.0), -INF), np.where(safe, 1 / np.where(safe, low, 1.0), INF)


def _square(a: Bounds) -> Bounds:
    low, high = a[0] * a[0], a[1] * a[1]
    return np.where((a[0] <= 0) & (a[1] >= 0), 0.0, np.minimum(low, high)), np.maximum(low, high)


def _rising(f: Callable) -> Callable[..., Bounds]:
    return lambda a, *p: (f(a[0], *p), f(a[1], *p))


def _within(low: float, high: float) -> Callable[..., Bounds]:
    """A rule for what is between two numbers."""

    def rule(*args) -> Bounds:
        shape = np.broadcast_shapes(*(x[0].shape for x in args if isinstance(x, tuple)))
        return np.full(shape, low), np.full(shape, high)

    return rule


def _components(f: Callable) -> Callable[..., Bounds]:
    """A rule that goes through both bounds alike, where the operation only places, copies or adds components."""
    return lambda *a: tuple(f(*(x[side] if isinstance(x, tuple) else x for x in a)) for side in (0, 1))


RULES["Add"] = lambda a, b: _sure(a[0] + b[0], a[1] + b[1])
RULES["Subtract"] = lambda a, b: _sure(a[0] - b[1], a[1] - b[0])
RULES["Minus"] = lambda a: (-a[1], -a[0])
RULES["Mult"] = _products
RULES["Divide"] = lambda a, b: _products(a, _inverse(b))
RULES["Inv"] = _inverse
RULES["Square"] = _square
RULES["Exp"] = _rising(np.exp)
RULES["Atan"] = _rising(np.arctan)
RULES["Floor"] = _rising(np.floor)
RULES["ReLU"] = _rising(lambda x: np.maximum(x, 0.0))
RULES["Step"] = _rising(lambda x: np.where(x < 0, 0.0, 1.0))
RULES["Sign"] = _rising(np.sign)
RULES["ClampInt"] = lambda a, low, high: (np.clip(a[0], low, high), np.clip(a[1], low, high))
RULES["Sin"] = RULES["Cos"] = RULES["SinXDivX"] = _within(-1.0, 1.0)
RULES["DiffClampInt"] = RULES["Equal"] = RULES["NotEqual"] = _within(0.0, 1.0)


@_rule("Abs")
def _abs(a: Bounds) -> Bounds:
    low, high = np.abs(a[0]), np.abs(a[1])
    return np.where((a[0] <= 0) & (a[1] >= 0), 0.0, np.minimum(low, high)), np.maximum(low, high)


@_rule("Sqrt")
def _sqrt(a: Bounds) -> Bounds:
    # a negative number has no root, and may be in the box: then nothing is known
    known = a[0] >= 0
    return np.where(known, np.sqrt(np.maximum(a[0], 0.0)), -INF), np.where(known, np.sqrt(np.maximum(a[1], 0.0)), INF)


@_rule("Log")
def _log(a: Bounds) -> Bounds:
    known = a[0] > 0
    return np.where(known, np.log(np.where(known, a[0], 1.0)), -INF), np.where(known, np.log(np.where(known, a[1], 1.0)), INF)


@_rule("Rsqrt")
def _rsqrt(a: Bounds) -> Bounds:
    # at 0 it is 0
    known = a[0] > 0
    return np.where(known, 1 / np.sqrt(np.where(known, a[1], 1.0)), np.where(a[0] == 0, 0.0, -INF)), np.where(known, 1 / np.sqrt(np.where(known, a[0], 1.0)), INF)


@_rule("Pow")
def _pow(a: Bounds, m: int) -> Bounds:
    if m < 0:
        return _inverse(_pow(a, -m))
    if m % 2:
        return np.power(a[0], float(m)), np.power(a[1], float(m))
    low, high = _abs(a)
    return np.power(low, float(m)), np.power(high, float(m))


@_rule("Powf")
def _powf(a: Bounds, b: Bounds) -> Bounds:
    shape = np.broadcast_shapes(a[0].shape, b[0].shape)
    low, high = _products(b, _log(a))
    known = np.broadcast_to(a[0] > 0, shape)
    return np.where(known, np.exp(low), -INF), np.where(known, np.exp(high), INF)


@_rule("IfElse")
def _either(f: Bounds, a: Bounds, b: Bounds) -> Bounds:
    yes, no = f[0] >= 0, f[1] < 0
    return (np.where(yes, a[0], np.where(no, b[0], np.minimum(a[0], b[0]))), np.where(yes, a[1], np.where(no, b[1], np.maximum(a[1], b[1]))))


@_rule("Clamp")
def _clamp(x: Bounds, a: Bounds, b: Bounds) -> Bounds:
    # whichever of the three it is
    return np.minimum.reduce(np.broadcast_arrays(x[0], a[0], b[0])), np.maximum.reduce(np.broadcast_arrays(x[1], a[1], b[1]))


@_rule("LessThan")
def _less(a: Bounds, b: Bounds) -> Bounds:
    return (a[1] < b[0]) * 1.0, (a[0] < b[1]) * 1.0


@_rule("LessOrEqual")
def _not_more(a: Bounds, b: Bounds) -> Bounds:
    return (a[1] <= b[0]) * 1.0, (a[0] <= b[1]) * 1.0


def _added(a: Bounds) -> Bounds:
    return _sure(a[0].sum(-1, keepdims=True), a[1].sum(-1, keepdims=True))


RULES["Sum"] = _added
RULES["SumT"] = _components(lambda x, d: np.broadcast_to(x, (*x.shape[:-1], d)))
RULES["Max"] = _components(lambda x: x.max(-1, keepdims=True))
RULES["Min"] = _components(lambda x: x.min(-1, keepdims=True))
RULES["Elem"] = _components(lambda x, m: x[..., m : m + 1])
RULES["Extract"] = _components(lambda x, s, d: x[..., s : s + d])


@_rule("Concat")
def _concat(a: Bounds, b: Bounds) -> Bounds:
    shape = np.broadcast_shapes(a[0].shape[:-1], b[0].shape[:-1])
    return tuple(np.concatenate([np.broadcast_to(x[s], (*shape, x[s].shape[-1])) for x in (a, b)], -1) for s in (0, 1))


@_rule("SqDist")
def _sqdist(a: Bounds, b: Bounds) -> Bounds:
    return _added(_square(RULES["Subtract"](a, b)))


@_rule("MatVecMult")
def _matvec(a: Bounds, b: Bounds) -> Bounds:
    p = b[0].shape[-1]
    low, high = _products(tuple(x.reshape(*x.shape[:-1], -1, p) for x in a), tuple(x[..., None, :] for x in b))
    return _sure(low.sum(-1), high.sum(-1))


def bounds(e: Expr, boxes: dict[tuple, Bounds]) -> Bounds:
    """(low, high) of ``e``; ``boxes`` has those of each variable, by its key.  Holds up to rounding.

    A product of a tree with itself is its square, so that a squared norm is
    never below 0; any other dependence between arguments is not seen.  What has
    an argument of which nothing is known may be NaN, so nothing is known of it.
    """
    memo: dict[tuple, Bounds] = {}

    def known(found: Bounds, parts: list[Bounds]) -> Bounds:
        lost = np.logical_or.reduce(np.broadcast_arrays(*(((low == -INF) & (high == INF)).any(-1, keepdims=True) for low, high in parts)))
        low, high = _sure(*found)
        return np.where(lost, -INF, low), np.where(lost, INF, high)

    def go(n: Expr) -> Bounds:
        k = n.key
        if k not in memo:
            if isinstance(n, Var):
                memo[k] = boxes[k]
            elif isinstance(n, (Const, Zero)):
                x = np.full((n.dim,), float(getattr(n, "value", 0)))
                memo[k] = x, x
            elif n.name in RULES or n.name == "Scalprod":
                parts = [go(c) for c in n.children]
                if n.name in ("Mult", "Scalprod"):
                    found = _square(parts[0]) if n.children[0].key == n.children[1].key else _products(*parts)
                    found = found if n.name == "Mult" else _added(found)
                else:
                    found = RULES[n.name](*parts, *n.params)
                memo[k] = known(found, parts)
            else:
                memo[k] = np.full((n.dim,), -INF), np.full((n.dim,), INF)
        return memo[k]

    with np.errstate(all="ignore"):
        low, high = go(e)
    memo.clear()
    return low, high
