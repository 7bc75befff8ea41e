"""Block kernels on their own: what is computed for how many pairs."""

import numpy as np
import pytest

from pairloom.genred import PairReduce
from pairloom.operators import pairs
from pairloom.plans.expr import VI


def _kernel(formula: str, op: str, dim: int, k: int = 0, **more):
    q = PairReduce(formula, [f"x = Vi({dim})", f"y = Vj({dim})", *(["b = Vj(1)"] if "b" in formula else [])], op, 1, k=k, **more)
    keys = {v.name: v.key for v in q.formula.variables() + (q.weight.variables() if q.weight is not None else [])}
    return pairs.PairKernel(q.formula, q.weight, q.reduction, VI, {}), keys


@pytest.fixture
def evaluated(monkeypatch):
    """Sizes of what formulas were evaluated to."""
    sizes, plain = [], pairs.on_blocks

    def counted(*args):
        out = plain(*args)
        sizes.append(out.size)
        return out

    monkeypatch.setattr(pairs, "on_blocks", counted)
    return sizes


FORMULAS = {
    "SqDist(x,y)": lambda x, y: ((x - y) ** 2).sum(),
    "-(x|y)": lambda x, y: -(x * y).sum(),
    "SqDist(x,y) / ((2 + Elem(x,0)) * (2 + Elem(y,0)))": lambda x, y: ((x - y) ** 2).sum() / ((2 + x[0]) * (2 + y[0])),
    "-SqDist(x,y) * Elem(y,1)": lambda x, y: -((x - y) ** 2).sum() * y[1],
}


@pytest.mark.parametrize("formula", FORMULAS)
def test_lowest_by_products(evaluated, formula):
    """Of most pairs only a bounded product is computed; lowest rows, ties and values are those of the formula."""
    r = np.random.default_rng(2)
    x, y = (v / np.linalg.norm(v, axis=1, keepdims=True) for v in (r.normal(size=(60, 16)), r.normal(size=(4000, 16))))
    y[100], y[3999], y[1234], x[5] = y[7], y[7], y[7] * (1 + 1e-15), y[7]
    kernel, keys = _kernel(formula, "KMin_ArgKMin", 16, 4)
    ids = np.arange(4000) * 3 + 1
    value, index = kernel.fold(kernel.start(60)[0], {keys["x"]: x}, {keys["y"]: y}, ids)
    want = np.array([[FORMULAS[formula](a, b) for b in y] for a in x])
    assert np.allclose(value[:, 0], np.sort(want, 1)[:, :4], rtol=1e-12, atol=1e-14)
    assert np.allclose(want[np.arange(60)[:, None], index[:, 0] // 3], value[:, 0], rtol=1e-12, atol=1e-14)
    if formula != "-SqDist(x,y) * Elem(y,1)":
        assert index[5, 0, :2].tolist() == [22, 301] or abs(value[5, 0, 0] - value[5, 0, 2]) > 0
    assert sum(evaluated) < 0.3 * 60 * 4000


@pytest.mark.parametrize("odd", [np.nan, np.inf, 1e200, 1e-200])
def test_lowest_of_odd_numbers(odd):
    """What has no bounded product goes through the formula, with the same answer."""
    r = np.random.default_rng(3)
    x, y = r.normal(size=(5, 9)), r.normal(size=(50, 9))
    y[3, 2], y[20] = odd, y[10]
    if odd == 1e-200:
        x, y = x * 1e-200, y * 1e-200
    kernel, keys = _kernel("SqDist(x,y)", "KMin_ArgKMin", 9, 60)
    got = kernel.fold(kernel.start(5)[0], {keys["x"]: x}, {keys["y"]: y}, np.arange(50))
    kernel.form = None
    want = kernel.fold(kernel.start(5)[0], {keys["x"]: x}, {keys["y"]: y}, np.arange(50))
    assert np.array_equal(got[0], want[0]) and np.array_equal(got[1], want[1])


def test_linear_parts_are_matrix_products(evaluated):
    """A kernel times weights of the other side is evaluated without the weights' width, and so are soft-max weights."""
    r = np.random.default_rng(4)
    x, y, b = r.normal(size=(30, 3)), r.normal(size=(40, 3)), r.normal(size=(40, 1))
    d = ((x[:, None] - y[None]) ** 2).sum(-1)
    kernel, keys = _kernel("Exp(-SqDist(x,y))*b*y", "Sum", 3)
    total, _ = kernel.fold(kernel.start(30)[0], {keys["x"]: x}, {keys["y"]: y, keys["b"]: b}, np.arange(40))
    assert np.allclose(total, np.exp(-d) @ (b * y), rtol=1e-12, atol=1e-13) and max(evaluated) == 30 * 40
    kernel, keys = _kernel("-SqDist(x,y)", "SumSoftMaxWeight", 3, formula2="y")
    m, s = kernel.fold(kernel.start(30)[0], {keys["x"]: x}, {keys["y"]: y}, np.arange(40))
    assert np.allclose(s[:, 1:] / s[:, :1], np.exp(-d) @ y / np.exp(-d).sum(1, keepdims=True), rtol=1e-12, atol=1e-13)


def test_l1_distances_are_added_in_the_order_of_components(monkeypatch):
    """On tiles, on lists of pairs and in SQL the sum is the same number; blocks of pairs are not wider than one."""
    from pairloom.operators import pairs
    from pairloom.plans import evaluate
    from pairloom.plans.parse import parse

    monkeypatch.setattr(evaluate, "L1_TILE", 64)
    r = np.random.default_rng(2)
    x, y = r.normal(size=(30, 64)), r.normal(size=(50, 64))
    x[3, 5], y[7, 60] = np.inf, np.nan
    want = np.zeros((30, 50))
    for d in range(64):
        want += np.abs(x[:, d, None] - y[:, d])
    for text, turn in (("Sum(Abs(x-y))", False), ("Sum(Abs(y-x))", True)):
        f = parse(text, ["x = Vi(64)", "y = Vj(64)"])[0]
        folded = evaluate.folded_sums(f)
        (xv,), (yv,) = pairs._vars([f], pairs.VI), pairs._vars([f], pairs.VJ)
        assert pairs.pair_width(f, True, folded) == 1
        got = evaluate.on_blocks(f, {xv.key: x[:, None], yv.key: y[None]}, folded)
        row, col = np.divmod(np.arange(1500), 50)
        listed = evaluate.on_blocks(f, {xv.key: x[row][:, None], yv.key: y[col][:, None]}, folded)
        assert np.array_equal(got[..., 0], want, equal_nan=True) and np.array_equal(listed.ravel(), want.ravel(), equal_nan=True)
