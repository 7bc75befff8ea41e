"""A formula tree on blocks of numbers, or as columns of a joined row."""

from __future__ import annotations

import numpy as np
from pyspark.sql import Column
from pyspark.sql import functions as F

from pairloom.functions import ops
from pairloom.plans.expr import VI, VJ, Const, Expr, Var, Zero


#: Components of a slice where a sum over components is folded.
SLICE = 32
#: Numbers of a tile of L1 distances, of so many rows: two such tiles fit into a core's cache.
L1_TILE, L1_ROWS = 32_768, 16
#: Numbers that numpy copies before it repeats a side; the least it takes, as these copies cost more than the differences.
L1_BUFFER = 16


def _two_sided(e: Expr) -> bool:
    return len({v.cat for v in e.variables()} & {VI, VJ}) == 2


def _by_component(e: Expr, dim: int) -> bool:
    """Whether a slice of ``e`` follows from slices of its variables; parts of length 1 are evaluated whole."""
    if e.dim == 1 or isinstance(e, Zero) or (isinstance(e, Var) and e.dim == dim):
        return True
    return e.dim == dim and bool(e.children) and ops.TABLE[e.name].by_component and all(_by_component(c, dim) for c in e.children)


def folded_sums(*trees: Expr | None) -> frozenset:
    """Keys of the sums and products over components that are added up slice by slice.

    Those whose summands stand for pairs and are wider than a slice: so no block
    of pairs is as wide as the vectors.
    """
    found = set()

    def go(e: Expr) -> None:
        name, dim = getattr(e, "name", ""), max((c.dim for c in e.children), default=0)
        if name in ("Sum", "Scalprod") and dim > SLICE and any(c.dim == dim and _two_sided(c) for c in e.children) and all(_by_component(c, dim) for c in e.children):
            found.add(e.key)
        for c in e.children:
            go(c)

    for t in trees:
        if t is not None:
            go(t)
    return frozenset(found)


def l1_sides(e: Expr) -> tuple[Expr, Expr] | None:
    """The two sides of an L1 distance of a row i and a row j."""
    if getattr(e, "name", "") != "Sum" or getattr(e.children[0], "name", "") != "Abs" or getattr(e.children[0].children[0], "name", "") != "Subtract":
        return None
    a, b = e.children[0].children[0].children
    sides = [{v.cat for v in c.variables()} & {VI, VJ} for c in (a, b)]
    return (a, b) if a.dim == b.dim and all(len(s) == 1 for s in sides) and sides[0] != sides[1] else None


def l1_distances(x: np.ndarray, y: np.ndarray) -> np.ndarray:
    """(rows, columns) of (rows, length) and (columns, length): component by component, in their order, on tiles that stay in the cache."""
    out = np.zeros((len(x), len(y)))
    columns = max(1, min(len(y), L1_TILE // L1_ROWS))
    rows = L1_TILE // columns
    before = np.setbufsize(L1_BUFFER)
    try:
        with np.errstate(all="ignore"):
            for s in range(0, x.shape[1], SLICE):
                u, v = (np.ascontiguousarray(side[:, s : s + SLICE].T) for side in (x, y))
                for a in range(0, len(x), rows):
                    for b in range(0, len(y), columns):
                        mine, theirs, total = u[:, a : a + rows, None], v[:, None, b : b + columns], out[a : a + rows, b : b + columns]
                        one = np.empty(total.shape)
                        for d in range(len(u)):
                            np.subtract(mine[d], theirs[d], one)
                            np.abs(one, one)
                            np.add(total, one, total)
    finally:
        np.setbufsize(before)
    return out


def whole_parts(e: Expr) -> list[Expr]:
    """The parts of length 1 below a folded sum, which are evaluated whole."""
    return [x for c in e.children for x in ([c] if c.dim == 1 else whole_parts(c))]


def free_of(trees: list[Expr | None], cat: int) -> frozenset:
    """Keys of the subtrees without variables of a category."""
    found = set()

    def go(e: Expr) -> None:
        if all(v.cat != cat for v in e.variables()):
            found.add(e.key)
        for c in e.children:
            go(c)

    for t in trees:
        if t is not None:
            go(t)
    return frozenset(found)


def on_blocks(e: Expr, values: dict[tuple, np.ndarray], folded: frozenset = frozenset(), kept: dict | None = None, free: frozenset = frozenset()) -> np.ndarray:
    """(i, j, length) array of ``e``; ``values`` by the key of each variable.

    Subtrees of one side stay (i, 1, .) or (1, j, .) until they meet, and equal
    subtrees are evaluated once.  ``folded`` sums go slice by slice; subtrees of
    ``free`` are kept in ``kept`` for the next call on the same blocks.
    """
    memo: dict[tuple, np.ndarray] = {}
    kept = memo if kept is None else kept

    def go(n: Expr) -> np.ndarray:
        k = n.key
        held = kept if k in free else memo
        if k not in held:
            if isinstance(n, Var):
                held[k] = values[k]
            elif isinstance(n, Const):
                held[k] = np.full((1, 1, 1), float(n.value))
            elif isinstance(n, Zero):
                held[k] = np.zeros((1, 1, n.dim))
            elif k in folded and (sides := l1_sides(n)) is not None:
                x, y = map(go, sides)
                if x.shape[0] == 1:
                    x, y = y, x
                if x.shape[1] == 1 and y.shape[0] == 1:
                    held[k] = l1_distances(x[:, 0], y[0])[..., None]
                else:  # a list of pairs: the same order of components, so the same numbers
                    terms = np.ascontiguousarray(np.moveaxis(np.abs(x - y), -1, 0))
                    total = terms[0].copy()
                    for t in terms[1:]:
                        total += t
                    held[k] = total[..., None]
            elif k in folded:
                dim = max(c.dim for c in n.children)
                total = 0.0
                for a in range(0, dim, SLICE):
                    parts: dict[tuple, np.ndarray] = {}
                    # a component that is alone counts for all of the slice
                    mine = [np.broadcast_to(x, (*x.shape[:-1], min(SLICE, dim - a))) for x in (cut(c, a, min(a + SLICE, dim), parts) for c in n.children)]
                    total = total + (mine[0].sum(-1, keepdims=True) if n.name == "Sum" else np.einsum("...k,...k->...", *mine)[..., None])
                held[k] = total
            else:
                held[k] = ops.TABLE[n.name].kernel(*map(go, n.children), *n.params)
        return held[k]

    def cut(n: Expr, a: int, b: int, parts: dict) -> np.ndarray:
        if n.dim == 1:
            return go(n)
        if n.key not in parts:
            if isinstance(n, Var):
                parts[n.key] = values[n.key][..., a:b]
            elif isinstance(n, Zero):
                parts[n.key] = np.zeros((1, 1, b - a))
            else:
                parts[n.key] = ops.TABLE[n.name].kernel(*(cut(c, a, b, parts) for c in n.children), *n.params)
        return parts[n.key]

    out = go(e)
    memo.clear()  # ``go`` refers to itself: its blocks would stay until the garbage collector comes
    return out


def shared_subtrees(*trees: Expr) -> list[Expr]:
    """Operations that occur more than once, innermost first: those that are worth a column of their own.

    A subtree that only occurs within another shared one is that one's business.
    """
    seen: dict[tuple, int] = {}
    order: list[Expr] = []

    def go(n: Expr) -> None:
        if not n.children:
            return
        seen[n.key] = seen.get(n.key, 0) + 1
        if seen[n.key] == 1:
            for c in n.children:
                go(c)
            order.append(n)

    for t in trees:
        go(t)
    return [n for n in order if seen[n.key] > 1]


def as_columns(e: Expr, values: dict[tuple, list[Column]]) -> list[Column]:
    """One DOUBLE column for each component of ``e``; ``values`` may also have those of subtrees."""
    memo: dict[tuple, list[Column]] = {}

    def go(n: Expr) -> list[Column]:
        k = n.key
        if k not in memo:
            if k in values:
                memo[k] = values[k]
            elif isinstance(n, Const):
                memo[k] = [F.lit(float(n.value))]
            elif isinstance(n, Zero):
                memo[k] = [F.lit(0.0)] * n.dim
            else:
                f = ops.TABLE[n.name].columns
                if f is None:
                    raise NotImplementedError(f"{n.name} has a block kernel only")
                memo[k] = f(*map(go, n.children), *n.params)
        return memo[k]

    return go(e)
