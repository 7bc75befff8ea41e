"""Typed formula trees.

Every node knows the length of its vector (``dim``) when it is built.  Leaves
are variables of category 0 (indexed by i), 1 (indexed by j) or 2 (parameters),
exact integers and rationals, and zero vectors.  Constructors of ``+ - * /``
and a few others simplify as they build, so gradients stay small.
"""

from __future__ import annotations

from collections.abc import Callable, Iterator
from dataclasses import dataclass, field
from fractions import Fraction

VI, VJ, PM = 0, 1, 2
CATEGORY = {"Vi": VI, "Vj": VJ, "Pm": PM, "Vx": VI, "Vy": VJ}


class Expr:
    dim: int
    children: tuple[Expr, ...]

    # -- building --------------------------------------------------------
    def __add__(self, other):
        return add(self, lift(other))

    def __radd__(self, other):
        return add(lift(other), self)

    def __sub__(self, other):
        return sub(self, lift(other))

    def __rsub__(self, other):
        return sub(lift(other), self)

    def __mul__(self, other):
        return mul(self, lift(other))

    def __rmul__(self, other):
        return mul(lift(other), self)

    def __truediv__(self, other):
        return div(self, lift(other))

    def __rtruediv__(self, other):
        return div(lift(other), self)

    def __neg__(self):
        return neg(self)

    def __or__(self, other):
        return call("Scalprod", self, lift(other))

    def __pow__(self, other):
        return power(self, other)

    # comparison builds nodes; identity of trees is ``key``
    def __lt__(self, other):
        return call("LessThan", self, lift(other))

    def __gt__(self, other):
        return call("LessThan", lift(other), self)

    def __le__(self, other):
        return call("LessOrEqual", self, lift(other))

    def __ge__(self, other):
        return call("LessOrEqual", lift(other), self)

    # -- reading ---------------------------------------------------------
    @property
    def key(self) -> tuple:
        raise NotImplementedError

    def walk(self) -> Iterator[Expr]:
        yield self
        for c in self.children:
            yield from c.walk()

    def contains(self, part: Expr) -> bool:
        return any(n.key == part.key for n in self.walk())

    def variables(self) -> list[Var]:
        found: dict[tuple, Var] = {}
        for n in self.walk():
            if isinstance(n, Var):
                found.setdefault(n.key, n)
        return list(found.values())

    def categories(self) -> set[int]:
        return {v.cat for v in self.variables()}

    def replace(self, old: Expr, new: Expr) -> Expr:
        """The tree with every occurrence of ``old`` exchanged, simplified again."""
        if self.key == old.key:
            return new
        if not self.children:
            return self
        return call(self.name, *(c.replace(old, new) for c in self.children), params=self.params)


@dataclass(frozen=True, eq=False)
class Var(Expr):
    ind: int
    dim: int
    cat: int
    name: str = ""
    children: tuple = ()

    @property
    def key(self):
        return ("Var", self.ind, self.dim, self.cat)

    def __str__(self):
        return self.name or f"Var({self.ind},{self.dim},{self.cat})"


@dataclass(frozen=True, eq=False)
class Const(Expr):
    """An exact rational scalar."""

    value: Fraction
    dim: int = 1
    children: tuple = ()

    @property
    def key(self):
        return ("Const", self.value)

    def __str__(self):
        v = self.value
        return f"IntCst({v.numerator})" if v.denominator == 1 else f"RatCst({v.numerator},{v.denominator})"


@dataclass(frozen=True, eq=False)
class Zero(Expr):
    dim: int
    children: tuple = ()

    @property
    def key(self):
        return ("Zero", self.dim)

    def __str__(self):
        return f"Zero({self.dim})"


@dataclass(frozen=True, eq=False)
class Op(Expr):
    name: str
    children: tuple[Expr, ...]
    params: tuple
    dim: int = field(default=0)

    @property
    def key(self):
        return (self.name, self.params, *(c.key for c in self.children))

    def __str__(self):
        inner = ",".join([*map(str, self.children), *(str(list(p)) if isinstance(p, tuple) else str(p) for p in self.params)])
        return f"{self.name}({inner})"


def IntCst(n: int) -> Const:
    return Const(Fraction(int(n)))


def RatCst(p: int, q: int) -> Const:
    return Const(Fraction(int(p), int(q)))


def lift(x) -> Expr:
    """A number as an exact constant; a float keeps its exact binary value."""
    if isinstance(x, Expr):
        return x
    if isinstance(x, bool) or not isinstance(x, (int, float, Fraction)):
        raise TypeError(f"cannot use {x!r} in a formula")
    return Const(Fraction(x))


def joint_dim(*args: Expr) -> int:
    """Length of an element-wise result: all lengths equal, or 1."""
    dims = {a.dim for a in args if a.dim != 1}
    if len(dims) > 1:
        raise ValueError(f"dimensions {sorted(dims)} do not go together")
    return dims.pop() if dims else 1


def is_zero(e: Expr) -> bool:
    return isinstance(e, Zero) or (isinstance(e, Const) and not e.value)


def node(name: str, *args: Expr, params: tuple = (), dim: int) -> Op:
    return Op(name, tuple(args), tuple(params), dim)


def spread(e: Expr, dim: int) -> Expr:
    """``e`` as a vector of length ``dim``."""
    if e.dim == dim:
        return e
    return Zero(dim) if is_zero(e) else node("SumT", e, params=(dim,), dim=dim)


def _terms(e: Expr) -> tuple[Fraction, Expr]:
    """e = coefficient * rest."""
    if isinstance(e, Op) and e.name == "Mult" and isinstance(e.children[0], Const):
        return e.children[0].value, e.children[1]
    if isinstance(e, Op) and e.name == "Minus":
        c, r = _terms(e.children[0])
        return -c, r
    return Fraction(1), e


def add(a: Expr, b: Expr) -> Expr:
    dim = joint_dim(a, b)
    if is_zero(a):
        return spread(b, dim)
    if is_zero(b):
        return spread(a, dim)
    if isinstance(a, Const) and isinstance(b, Const):
        return Const(a.value + b.value)
    (p, x), (q, y) = _terms(a), _terms(b)
    if x.key == y.key and not isinstance(x, Const):
        return mul(Const(p + q), x)
    if isinstance(b, Op) and b.name == "Minus":
        return sub(a, b.children[0])
    if isinstance(a, Const) and not isinstance(b, Const):
        a, b = b, a
    if isinstance(b, Const) and isinstance(a, Op) and a.name == "Add" and isinstance(a.children[1], Const):
        return add(a.children[0], Const(a.children[1].value + b.value))
    return node("Add", a, b, dim=dim)


def sub(a: Expr, b: Expr) -> Expr:
    dim = joint_dim(a, b)
    if is_zero(b):
        return spread(a, dim)
    if is_zero(a):
        return spread(neg(b), dim)
    if isinstance(b, Const):
        return add(a, Const(-b.value))
    (p, x), (q, y) = _terms(a), _terms(b)
    if x.key == y.key:
        return mul(Const(p - q), x)
    if isinstance(b, Op) and b.name == "Minus":
        return add(a, b.children[0])
    return node("Subtract", a, b, dim=dim)


def neg(a: Expr) -> Expr:
    if isinstance(a, Const):
        return Const(-a.value)
    if isinstance(a, Zero):
        return a
    if isinstance(a, Op) and a.name == "Minus":
        return a.children[0]
    if isinstance(a, Op) and a.name == "Mult" and isinstance(a.children[0], Const):
        return mul(Const(-a.children[0].value), a.children[1])
    return node("Minus", a, dim=a.dim)


def mul(a: Expr, b: Expr) -> Expr:
    dim = joint_dim(a, b)
    if is_zero(a) or is_zero(b):
        return Zero(dim)
    if isinstance(b, Const):
        a, b = b, a
    if isinstance(a, Const):
        if isinstance(b, Const):
            return Const(a.value * b.value)
        if a.value == 1:
            return b
        if a.value == -1:
            return neg(b)
        c, rest = _terms(b)
        if c != 1:
            return mul(Const(a.value * c), rest)
    else:
        (p, x), (q, y) = _terms(a), _terms(b)
        if p * q != 1:
            return mul(Const(p * q), mul(x, y))
        if a.key == b.key:
            return call("Square", a)
        if isinstance(a, Op) and isinstance(b, Op) and a.name == b.name == "Exp":
            return call("Exp", add(a.children[0], b.children[0]))
    return node("Mult", a, b, dim=dim)


def div(a: Expr, b: Expr) -> Expr:
    dim = joint_dim(a, b)
    if is_zero(b):
        raise ZeroDivisionError("division by a zero constant")
    if is_zero(a):
        return Zero(dim)
    if isinstance(b, Const):
        return mul(Const(1 / b.value), a)
    if isinstance(a, Const) and a.value == 1:
        return call("Inv", b)
    return node("Divide", a, b, dim=dim)


def power(a: Expr, b) -> Expr:
    if isinstance(b, Const) and b.value.denominator == 1:
        b = int(b.value)
    if isinstance(b, int):
        if b == 2:
            return call("Square", a)
        return call("Inv", a) if b == -1 else call("Pow", a, params=(b,))
    if isinstance(b, (float, Fraction)) and float(b) in (0.5, -0.5):
        return call("Sqrt" if b > 0 else "Rsqrt", a)
    return call("Powf", a, lift(b))


def call(name: str, *args, params: tuple = ()) -> Expr:
    """The node ``name`` over ``args``: checked, given its dimension, simplified."""
    from pairloom.functions import ops

    args = tuple(lift(a) for a in args)
    build: dict[str, Callable] = {"Add": add, "Subtract": sub, "Mult": mul, "Divide": div, "Minus": neg}
    if name in build:
        return build[name](*args)
    if name not in ops.TABLE:
        raise ValueError(f"unknown operation {name}")
    op = ops.TABLE[name]
    if op.arity is not None and len(args) != op.arity:
        raise ValueError(f"{name} takes {op.arity} arguments, not {len(args)}")
    if op.rewrite is not None:
        out = op.rewrite(args, params)
        if out is not None:
            return out
    return node(name, *args, params=params, dim=op.dim(args, params))
