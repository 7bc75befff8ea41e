"""The formula mini-language: Python expressions over an allow-list, never evaluated as Python.

``Exp(-SqDist(x,y))*b`` with aliases ``x = Vi(3)``, ``y = Vj(3)``, ``b = Vj(1)``.
"""

from __future__ import annotations

import ast
import re

from pairloom.plans import expr
from pairloom.plans.expr import CATEGORY, Expr, Var, Zero, call

_BINARY = {ast.Add: "Add", ast.Sub: "Subtract", ast.Mult: "Mult", ast.Div: "Divide", ast.BitOr: "Scalprod"}
_COMPARE = {ast.Lt: ("LessThan", False), ast.Gt: ("LessThan", True), ast.LtE: ("LessOrEqual", False), ast.GtE: ("LessOrEqual", True), ast.Eq: ("Equal", False), ast.NotEq: ("NotEqual", False)}
#: name: how many of the arguments, from the end, are parameters and not formulas
PARAMS = {
    "Pow": 1, "ClampInt": 2, "DiffClampInt": 2, "Round": 1, "SumT": 1, "Elem": 1, "ElemT": 2, "Extract": 2, "ExtractT": 2,
    "OneHot": 1, "BSpline": 1, "Kron": 2, "ComplexSumT": 1, "IntInv": 1,
}


def parse_alias(text: str, place: int) -> Var:
    """``name = Vi(dim)``, ``Vj(place, dim)``, ``Pm(dim)`` or ``Var(place, dim, category)``."""
    m = re.fullmatch(r"\s*(?:(\w+)\s*=\s*)?(Vi|Vj|Pm|Vx|Vy|Var)\s*\(\s*([\d\s,]+)\)\s*", text)
    if not m:
        raise ValueError(f"not a variable: {text!r}")
    name, kind = m[1] or "", m[2]
    numbers = [int(x) for x in m[3].split(",")]
    if kind == "Var":
        ind, dim, cat = numbers
    else:
        ind, dim = numbers if len(numbers) == 2 else (place, numbers[0])
        cat = CATEGORY[kind]
    return Var(ind, dim, cat, name)


def parse(formula: str, aliases: list[str] | list[Var] = ()) -> tuple[Expr, list[Var]]:
    """The tree of ``formula`` and all its variables by place; inline ones extend the aliases."""
    variables = [a if isinstance(a, Var) else parse_alias(a, k) for k, a in enumerate(aliases)]
    names = {v.name: v for v in variables if v.name}
    found = {v.ind: v for v in variables}

    def number(n: ast.AST):
        """A parameter: an integer or a nested list of integers."""
        if isinstance(n, ast.UnaryOp) and isinstance(n.op, ast.USub):
            return -number(n.operand)
        if isinstance(n, ast.Constant) and isinstance(n.value, (int, float)):
            return n.value
        if isinstance(n, (ast.List, ast.Tuple)):
            return tuple(number(x) for x in n.elts)
        if isinstance(n, ast.Call) and isinstance(n.func, ast.Name) and n.func.id == "CAT":
            return tuple(number(x) for x in n.args)
        raise ValueError(f"not a number: {ast.unparse(n)}")

    def visit(n: ast.AST) -> Expr:
        if isinstance(n, ast.Expression):
            return visit(n.body)
        if isinstance(n, ast.Constant) and isinstance(n.value, (int, float)) and not isinstance(n.value, bool):
            return expr.lift(n.value)
        if isinstance(n, ast.Name):
            if n.id in names:
                return names[n.id]
            raise ValueError(f"unknown variable {n.id}")
        if isinstance(n, ast.UnaryOp) and isinstance(n.op, ast.USub):
            return -visit(n.operand)
        if isinstance(n, ast.UnaryOp) and isinstance(n.op, ast.UAdd):
            return visit(n.operand)
        if isinstance(n, ast.BinOp):
            if isinstance(n.op, ast.Pow):
                p = visit(n.right)
                return expr.power(visit(n.left), p.value if isinstance(p, expr.Const) else p)
            if type(n.op) in _BINARY:
                return call(_BINARY[type(n.op)], visit(n.left), visit(n.right))
        if isinstance(n, ast.Compare) and len(n.ops) == 1:
            name, swap = _COMPARE[type(n.ops[0])]
            a, b = visit(n.left), visit(n.comparators[0])
            return call(name, *((b, a) if swap else (a, b)))
        if isinstance(n, ast.Call) and isinstance(n.func, ast.Name) and not n.keywords:
            return function(n.func.id, n.args)
        raise ValueError(f"not part of the formula language: {ast.unparse(n)}")

    def function(name: str, args: list[ast.AST]) -> Expr:
        from pairloom.plans import diff

        if name in ("Var", "Vi", "Vj", "Pm"):
            v = parse_alias(f"{name}({','.join(str(number(a)) for a in args)})", max(found, default=-1) + 1)
            v = found.setdefault(v.ind, v)
            return v
        if name == "IntCst":
            return expr.IntCst(number(args[0]))
        if name == "RatCst":
            return expr.RatCst(number(args[0]), number(args[1]))
        if name == "Zero":
            return Zero(number(args[0]))
        if name == "TensorDot":
            return call(name, *map(visit, args[:2]), params=tuple(number(a) for a in args[2:]))
        if name == "AutoFactorize":  # what occurs twice gets a column, or a block, of its own anyway
            return visit(args[0])
        if name == "Factorize":
            whole, part = visit(args[0]), visit(args[1])
            if not whole.contains(part):
                raise ValueError(f"{ast.unparse(args[1])} is no part of the formula")
            return whole
        if name in diff.CALCULUS:
            return diff.CALCULUS[name](*map(visit, args))
        k = PARAMS.get(name, 0)
        if len(args) < k:
            raise ValueError(f"{name} takes {k} numbers at least")
        cut = len(args) - k
        return call(name, *map(visit, args[:cut]), params=tuple(number(a) for a in args[cut:]))

    tree = visit(ast.parse(formula.strip(), mode="eval"))
    for v in tree.variables():
        found.setdefault(v.ind, v)
    return tree, [found[k] for k in sorted(found)]


