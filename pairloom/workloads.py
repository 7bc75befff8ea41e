"""Queries over the star-schema tables, one for each operation, with the SQL they are held against.

Points i are suppliers, points j nations (three coordinates each); embeddings
give 64-dimensional ones.  Vectors of results become columns v1, v2 ...,
rounded to six digits on both sides.
"""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from pairloom import streaming
from pairloom.genred import PairReduce, generic_argkmin, generic_argmin, generic_logsumexp, generic_sum
from pairloom.operators import cluster, neighbours, truncate
from pairloom.operators.solve import KernelSolve
from pairloom.sources import components, points, table
from pairloom.streaming import keyed
from pairloom.table_functions import register_pair_reduce, register_query
from pairloom.tensor import Pm, Vi, Vj, as_complex, exp1j

DIGITS = 6
ALIASES = ["x = Vi(3)", "y = Vj(3)", "b = Vj(1)"]
QUERIES: dict[str, Callable[[SparkSession, str], DataFrame]] = {}
ORACLES: dict[str, str] = {}

#: i with x1..x3, j with y1..y3 and b
POINTS_SQL = """l AS (SELECT CAST(s_suppkey AS BIGINT) AS i, s_acctbal / 9973::DOUBLE AS x1, s_nationkey::DOUBLE / 25::DOUBLE AS x2, (s_suppkey % 7)::DOUBLE / 7::DOUBLE AS x3 FROM supplier),
r AS (SELECT CAST(n_nationkey AS BIGINT) AS j, (n_nationkey + 1)::DOUBLE / 26::DOUBLE AS y1, (n_regionkey + 1)::DOUBLE / 6::DOUBLE AS y2, length(n_name)::DOUBLE / 20::DOUBLE AS y3, (n_regionkey + 1)::DOUBLE AS b FROM nation)"""


def suppliers(spark: SparkSession, sf_dir: str) -> DataFrame:
    d = lambda c: F.col(c).cast("double")
    x = [d("s_acctbal") / 9973.0, d("s_nationkey") / 25.0, (F.col("s_suppkey") % 7).cast("double") / 7.0]
    return points(table(spark, sf_dir, "supplier"), "s_suppkey", {"x": x}, "i")


def nations(spark: SparkSession, sf_dir: str) -> DataFrame:
    d = lambda c: c.cast("double")
    region = F.col("n_regionkey") + 1
    y = [d(F.col("n_nationkey") + 1) / 26.0, d(region) / 6.0, d(F.length("n_name")) / 20.0]
    return points(table(spark, sf_dir, "nation"), "n_nationkey", {"y": y, "b": d(region)}, "j")


def embeddings(spark: SparkSession, sf_dir: str, as_id: str, name: str) -> DataFrame:
    return points(table(spark, sf_dir, "embeddings"), "vec_id", {name: "embedding", "label": "label"}, as_id)


def _shown(df: DataFrame, size: int) -> DataFrame:
    return components(df, "value", "v", size, DIGITS)


def _sum_query(name: str, formula: str, sql: list[str], aliases: list[str] = ALIASES) -> None:
    """Sum over j of a formula, and of its components in SQL."""
    query = PairReduce(formula, aliases, "Sum", axis=1)

    def run(spark: SparkSession, sf_dir: str, query=query) -> DataFrame:
        return _shown(query.run(suppliers(spark, sf_dir), nations(spark, sf_dir)), query.formula.dim)

    QUERIES[name] = run
    if sql:
        cols = ", ".join(f"round(sum({s}), {DIGITS}) + 0.0::DOUBLE AS v{k + 1}" for k, s in enumerate(sql))
        ORACLES[name] = f"WITH {POINTS_SQL} SELECT i, {cols} FROM l, r GROUP BY i"


#: SQL of one component, from {a} (of x), {c} (of y); scalar operations of §2.3
_SCALAR = {
    "Add": ("x + y", "{a} + {c}"), "Subtract": ("x - y", "{a} - {c}"), "Minus": ("Minus(x) * y", "-{a} * {c}"), "Mult": ("x * y", "{a} * {c}"),
    "Divide": ("x / y", "{a} / {c}"), "Inv": ("Inv(y) * x", "{a} * (1 / {c})"), "IntInv": ("IntInv(4) * x + y", "{a} / 4::DOUBLE + {c}"),
    "Exp": ("Exp(x - y)", "exp({a} - {c})"), "Log": ("Log(y) + x", "ln({c}) + {a}"), "XLogX": ("XLogX(y) + x", "{c} * ln({c}) + {a}"),
    "Sin": ("Sin(x + y)", "sin({a} + {c})"), "Cos": ("Cos(x + y)", "cos({a} + {c})"), "SinXDivX": ("SinXDivX(x + y + 2)", "sin({a} + {c} + 2) / ({a} + {c} + 2)"),
    "Asin": ("Asin(y) + x", "asin({c}) + {a}"), "Acos": ("Acos(y) + x", "acos({c}) + {a}"), "Atan": ("Atan(x + y)", "atan({a} + {c})"),
    "Atan2": ("Atan2(x, y)", "atan2({a}, {c})"), "Pow": ("Pow(x - y, 3)", "pow({a} - {c}, 3)"), "Powf": ("Powf(y, x + 1)", "pow({c}, {a} + 1)"),
    "Square": ("Square(x - y)", "({a} - {c}) * ({a} - {c})"), "Sqrt": ("Sqrt(y) + x", "sqrt({c}) + {a}"), "Rsqrt": ("Rsqrt(y) + x", "1 / sqrt({c}) + {a}"),
    "Abs": ("Abs(x - y)", "abs({a} - {c})"), "Sign": ("Sign(x - y)", "CASE WHEN {a} > {c} THEN 1.0::DOUBLE WHEN {a} < {c} THEN -1.0::DOUBLE ELSE 0.0::DOUBLE END"),
    "Step": ("Step(x - y)", "CASE WHEN {a} - {c} < 0 THEN 0.0::DOUBLE ELSE 1.0::DOUBLE END"), "ReLU": ("ReLU(x - y)", "greatest({a} - {c}, 0.0::DOUBLE)"),
    "Clamp": ("Clamp(x - y, -y / 2, y / 2)", "CASE WHEN {a} - {c} < -{c} / 2 THEN -{c} / 2 WHEN {a} - {c} > {c} / 2 THEN {c} / 2 ELSE {a} - {c} END"),
    "ClampInt": ("ClampInt(x * 4 - y, 0, 1)", "greatest(0.0::DOUBLE, least(1.0::DOUBLE, {a} * 4 - {c}))"),
    "DiffClampInt": ("DiffClampInt(x * 4 - y, 0, 1)", "CASE WHEN {a} * 4 - {c} < 0 OR {a} * 4 - {c} > 1 THEN 0.0::DOUBLE ELSE 1.0::DOUBLE END"),
    "IfElse": ("IfElse(x - y, x, y)", "CASE WHEN {a} - {c} >= 0 THEN {a} ELSE {c} END"), "Mod": ("Mod(x, y, 0)", "{a} - {c} * floor({a} / {c})"),
    "Floor": ("Floor(x * 10) + y", "floor({a} * 10) + {c}"), "Round": ("Round(x * 10, 1) + y", "round({a} * 10, 1) + {c}"),
    "Equal": ("(Floor(x * 4) == Floor(y * 4))", "CASE WHEN floor({a} * 4) = floor({c} * 4) THEN 1.0::DOUBLE ELSE 0.0::DOUBLE END"),
    "NotEqual": ("(Floor(x * 4) != Floor(y * 4))", "CASE WHEN floor({a} * 4) <> floor({c} * 4) THEN 1.0::DOUBLE ELSE 0.0::DOUBLE END"),
    "LessThan": ("(x < y)", "CASE WHEN {a} < {c} THEN 1.0::DOUBLE ELSE 0.0::DOUBLE END"), "LessOrEqual": ("(x <= y)", "CASE WHEN {a} <= {c} THEN 1.0::DOUBLE ELSE 0.0::DOUBLE END"),
}
for _name, (_formula, _sql) in _SCALAR.items():
    _sum_query(f"fn_{_name.lower()}", _formula, [_sql.format(a=f"x{k}", c=f"y{k}") for k in (1, 2, 3)])

_DOT, _XX, _YY = "(x1*y1 + x2*y2 + x3*y3)", "(x1*x1 + x2*x2 + x3*x3)", "(y1*y1 + y2*y2 + y3*y3)"
_D2 = "((x1-y1)*(x1-y1) + (x2-y2)*(x2-y2) + (x3-y3)*(x3-y3))"
_Z = [("x1", "y1"), ("x2", "y2"), ("x3", "y3")]  # Concat(x, y) read as three complex numbers: (x1,x2), (x3,y1), (y2,y3)
_C = [("x1", "x2"), ("x3", "y1"), ("y2", "y3")]
_W = [("y1", "y2"), ("y3", "x1"), ("x2", "x3")]  # Concat(y, x)


def _cat(pairs: list[tuple[str, str]]) -> list[str]:
    return [c for p in pairs for c in p]


def _argbest(cols: list[str], best: str) -> str:
    f = {">": "greatest", "<": "least"}[best]
    top = f"{f}({', '.join(cols)})"
    return "CASE " + " ".join(f"WHEN {c} = {top} THEN {k}.0::DOUBLE" for k, c in enumerate(cols)) + " END"


_XY = ["x1-y1", "x2-y2", "x3-y3"]
_cm = lambda a, b: (f"({a[0]}*{b[0]} - {a[1]}*{b[1]})", f"({a[0]}*{b[1]} + {a[1]}*{b[0]})")
_cd = lambda a, b: (f"(({a[0]}*{b[0]} + {a[1]}*{b[1]}) / ({b[0]}*{b[0]} + {b[1]}*{b[1]}))", f"(({a[1]}*{b[0]} - {a[0]}*{b[1]}) / ({b[0]}*{b[0]} + {b[1]}*{b[1]}))")
_P = [("(x1+2)", "y1"), ("(x2+2)", "y2")]

#: vector, norm, tensor and complex operations: formula and SQL of each component
_VECTOR = {
    "sum": ("Sum(x * y)", [_DOT]), "sumt": ("SumT(Elem(x, 0), 3) * y", ["x1*y1", "x1*y2", "x1*y3"]),
    "max": ("Max(x - y)", [f"greatest({', '.join(_XY)})"]), "min": ("Min(x - y)", [f"least({', '.join(_XY)})"]),
    "argmax": ("ArgMax(x - y)", [_argbest(_XY, ">")]), "argmin": ("ArgMin(x - y)", [_argbest(_XY, "<")]),
    "elem": ("Elem(x, 1) * Elem(y, 2)", ["x2*y3"]), "elemt": ("ElemT(Elem(x, 1) * Elem(y, 0), 3, 2)", ["0.0::DOUBLE", "0.0::DOUBLE", "x2*y1"]),
    "extract": ("Extract(x * y, 1, 2)", ["x2*y2", "x3*y3"]), "extractt": ("ExtractT(x * y, 1, 5)", ["0.0::DOUBLE", "x1*y1", "x2*y2", "x3*y3", "0.0::DOUBLE"]),
    "concat": ("Concat(x, y)", ["x1", "x2", "x3", "y1", "y2", "y3"]),
    "onehot": ("OneHot(Elem(y, 1) * 6 - 1, 5) * Elem(x, 0)", [f"CASE WHEN floor(y2 * 6 - 1 + 0.5) = {k} THEN x1 ELSE 0.0::DOUBLE END" for k in range(5)]),
    "scalprod": ("(x | y)", [_DOT]), "sqnorm2": ("SqNorm2(x - y)", [_D2]), "norm2": ("Norm2(x - y)", [f"sqrt({_D2})"]),
    "normalize": ("Normalize(y) * Elem(x, 0)", [f"x1 * y{k} / sqrt({_YY})" for k in (1, 2, 3)]), "sqdist": ("SqDist(x, y)", [_D2]),
    "sqnormiso": ("SqNormIso(b, x - y)", [f"b * {_D2}"]), "sqnormdiag": ("SqNormDiag(y, x)", ["y1*x1*x1 + y2*x2*x2 + y3*x3*x3"]),
    "symsqnorm": ("SymSqNorm(TensorProd(y, y), x)", [f"{_DOT} * {_DOT}"]), "weightedsqnorm": ("WeightedSqNorm(y, x)", ["y1*x1*x1 + y2*x2*x2 + y3*x3*x3"]),
    "weightedsqdist": ("WeightedSqDist(b, x, y)", [f"b * {_D2}"]), "matvecmult": ("MatVecMult(TensorProd(x, y), y)", [f"x{k} * {_YY}" for k in (1, 2, 3)]),
    "vecmatmult": ("VecMatMult(x, TensorProd(x, y))", [f"y{k} * {_XX}" for k in (1, 2, 3)]), "tensorprod": ("TensorProd(x, y)", [f"x{a}*y{c}" for a in (1, 2, 3) for c in (1, 2, 3)]),
    "tensordot": ("TensorDot(TensorProd(x, y), y, [3,3], [3], [1], [0])", [f"x{k} * {_YY}" for k in (1, 2, 3)]),
    "kron": ("Kron(Concat(x, Elem(y, 0)), Extract(y, 0, 2), [2,2], [1,2])", [f"{a}*{c}" for row in (("x1", "x2"), ("x3", "y1")) for a in row for c in ("y1", "y2")]),
    "gradmatrix": ("GradMatrix(x * y, x)", ["y1", "0.0::DOUBLE", "0.0::DOUBLE", "0.0::DOUBLE", "y2", "0.0::DOUBLE", "0.0::DOUBLE", "0.0::DOUBLE", "y3"]),
    "complexreal": ("ComplexReal(Concat(x, y))", [p[0] for p in _C]), "compleximag": ("ComplexImag(Concat(x, y))", [p[1] for p in _C]),
    "real2complex": ("Real2Complex(x * y)", _cat([(f"x{k}*y{k}", "0.0::DOUBLE") for k in (1, 2, 3)])),
    "imag2complex": ("Imag2Complex(x * y)", _cat([("0.0::DOUBLE", f"x{k}*y{k}") for k in (1, 2, 3)])),
    "conj": ("Conj(Concat(x, y))", _cat([(a, f"-{c}") for a, c in _C])), "complexabs": ("ComplexAbs(Concat(x, y))", [f"sqrt({a}*{a} + {c}*{c})" for a, c in _C]),
    "complexsquareabs": ("ComplexSquareAbs(Concat(x, y))", [f"{a}*{a} + {c}*{c}" for a, c in _C]), "complexangle": ("ComplexAngle(Concat(x, y))", [f"atan2({c}, {a})" for a, c in _C]),
    "complexexp": ("ComplexExp(Concat(x, y))", _cat([(f"exp({a})*cos({c})", f"exp({a})*sin({c})") for a, c in _C])),
    "complexexp1j": ("ComplexExp1j(x - y)", _cat([(f"cos({v})", f"sin({v})") for v in _XY])),
    "complexadd": ("ComplexAdd(Concat(x, y), Concat(y, x))", _cat([(f"{a[0]}+{c[0]}", f"{a[1]}+{c[1]}") for a, c in zip(_C, _W, strict=True)])),
    "complexsubtract": ("ComplexSubtract(Concat(x, y), Concat(y, x))", _cat([(f"{a[0]}-{c[0]}", f"{a[1]}-{c[1]}") for a, c in zip(_C, _W, strict=True)])),
    "complexmult": ("ComplexMult(Concat(x, y), Concat(y, x))", _cat([_cm(a, c) for a, c in zip(_C, _W, strict=True)])),
    "complexscal": ("ComplexScal(Extract(x, 0, 2), Concat(x, y))", _cat([_cm(("x1", "x2"), c) for c in _C])),
    "complexdivide": ("ComplexDivide(Concat(x, y), Extract(y, 0, 2))", _cat([_cd(a, ("y1", "y2")) for a in _C])),
    "complexrealscal": ("ComplexRealScal(b, Concat(x, y))", [f"b*{v}" for v in _cat(_C)]),
    "complexsum": ("ComplexSum(Concat(x, y))", ["x1+x3+y2", "x2+y1+y3"]), "complexsumt": ("ComplexSumT(Concat(Elem(x, 0), Elem(y, 0)), 4)", ["x1", "y1", "x1", "y1"]),
    # calculus: derivatives by hand
    "grad": ("Grad(Exp(-SqDist(x, y)), x, 1)", [f"-2 * (x{k}-y{k}) * exp(-{_D2})" for k in (1, 2, 3)]),
    "diff": ("Diff(Exp(-SqDist(x, y)), x, y)", [f"-2 * ({_DOT} - {_YY}) * exp(-{_D2})"]),
    "divergence": ("Divergence(Exp(-SqDist(x, y)) * x, x)", [f"exp(-{_D2}) * (3 - 2 * ({_XX} - {_DOT}))"]),
    "laplacian": ("Laplacian(Exp(-SqDist(x, y)), x)", [f"exp(-{_D2}) * (4 * {_D2} - 6)"]),
    "adjointoperator": ("AdjointOperator(MatVecMult(TensorProd(y, y), x), x, y)", [f"y{k} * {_YY}" for k in (1, 2, 3)]),
    "traceoperator": ("TraceOperator(MatVecMult(TensorProd(y, y), x), x)", [_YY]),
    "sumlinoperator": ("SumLinOperator(MatVecMult(TensorProd(y, y), x), x)", ["(y1+y2+y3)*(y1+y2+y3)"]),
    "factorize_part": ("Factorize(Exp(-SqDist(x, y)) * (1 + Exp(-SqDist(x, y))), SqDist(x, y))", [f"exp(-{_D2}) + exp(-{_D2})*exp(-{_D2})"]),
    "factorize": ("AutoFactorize(Exp(-SqDist(x, y)) + Square(Exp(-SqDist(x, y))))", [f"exp(-{_D2}) + exp(-{_D2})*exp(-{_D2})"]),
}
for _name, (_formula, _cols) in _VECTOR.items():
    _sum_query(f"op_{_name}", _formula, _cols)
def _spline_sql() -> list[str]:
    """First-order B-splines over the knots y - 1, y, y + 1: two ramps each, by cases."""
    t = [f"(y{d} + ({s}))" for s in (-1, 0, 1) for d in (1, 2, 3)]
    out = []
    for k in range(7):
        up = f"CASE WHEN {t[k]} <= x1 AND x1 < {t[k + 1]} THEN coalesce((x1 - {t[k]}) / nullif({t[k + 1]} - {t[k]}, 0), 0) ELSE 0::DOUBLE END"
        down = f"CASE WHEN {t[k + 1]} <= x1 AND x1 < {t[k + 2]} THEN coalesce(({t[k + 2]} - x1) / nullif({t[k + 2]} - {t[k + 1]}, 0), 0) ELSE 0::DOUBLE END"
        out.append(f"{up} + {down}")
    return out


_sum_query("op_bspline", "BSpline(Concat(Concat(y - 1, y), y + 1), Elem(x, 0), 1)", _spline_sql())


def _warping_sql() -> tuple[str, list[str]]:
    """Columns c.., r.., w.. of the alignment of three by three components, and the six gradients; the temperature is a half."""
    cells = [(i, j) for i in (1, 2, 3) for j in (1, 2, 3)]
    steps = [", ".join(f"(x{i} - y{j}) * (x{i} - y{j}) AS c{i}{j}" for i, j in cells)]
    for i, j in cells:
        behind = [f"r{a}{b}" for a, b in ((i - 1, j), (i, j - 1), (i - 1, j - 1)) if a and b]
        low = f"least({', '.join(behind)})"
        soft = f" + {low} - 0.5::DOUBLE * ln({' + '.join(f'exp(-2 * ({b} - {low}))' for b in behind)})" if behind else ""
        steps.append(f"c{i}{j}{soft} AS r{i}{j}")
    for i, j in reversed(cells):
        ahead = [(a, b) for a, b in ((i + 1, j), (i, j + 1), (i + 1, j + 1)) if a < 4 and b < 4]
        steps.append((" + ".join(f"w{a}{b} * exp(2 * (r{a}{b} - r{i}{j} - c{a}{b}))" for a, b in ahead) or "1::DOUBLE") + f" AS w{i}{j}")
    table = "SELECT l.*, r.* FROM l, r"
    for x in steps:
        table = f"SELECT *, {x} FROM ({table})"
    by_x = [" + ".join(f"2 * (x{i} - y{j}) * w{i}{j}" for j in (1, 2, 3)) for i in (1, 2, 3)]
    by_y = [" - ".join(["0", *(f"2 * (x{i} - y{j}) * w{i}{j}" for i in (1, 2, 3))]) for j in (1, 2, 3)]
    return table, by_x + by_y


_WARPED, _WARPED_GRADIENT = _warping_sql()
_sum_query("op_softdtw_sqdist", "SoftDTW_SqDist(x, y, RatCst(1,2))", [])
ORACLES["op_softdtw_sqdist"] = f"WITH {POINTS_SQL} SELECT i, round(sum(r33), {DIGITS}) + 0.0::DOUBLE AS v1 FROM ({_WARPED}) GROUP BY i"
_sum_query("op_grad_softdtw_sqdist", "GradSoftDTW_SqDist(x, y, RatCst(1,2))", [])
ORACLES["op_grad_softdtw_sqdist"] = f"WITH {POINTS_SQL} SELECT i, {', '.join(f'round(sum({g}), {DIGITS}) + 0.0::DOUBLE AS v{k + 1}' for k, g in enumerate(_WARPED_GRADIENT))} FROM ({_WARPED}) GROUP BY i"


# -- reductions: {f} of SqDist, over j ------------------------------------------------
def _reduce_query(name: str, op: str, sql: str, k: int = 0, formula2: str | None = None, formula: str = "SqDist(x, y)", size: int = 1, index: bool = False, value: bool = True) -> None:
    query = PairReduce(formula, ALIASES, op, axis=1, k=k, formula2=formula2)

    def run(spark: SparkSession, sf_dir: str) -> DataFrame:
        out = query.run(suppliers(spark, sf_dir), nations(spark, sf_dir))
        if index:
            out = out.select("*", *(F.col("index")[n].alias(f"j{n + 1}") for n in range(size))).drop("index")
        return _shown(out, size) if value else out

    QUERIES[name] = run
    ORACLES[name] = f"WITH {POINTS_SQL}, p AS (SELECT i, j, {_D2} AS f, b, y1, y2, y3 FROM l, r) {sql}"


_R = lambda x: f"round({x}, {DIGITS}) + 0.0::DOUBLE"
_FIRST = "first(j ORDER BY f {way}, j)"
_reduce_query("red_sum", "Sum", f"SELECT i, {_R('sum(f)')} AS v1 FROM p GROUP BY i")
_reduce_query("red_min", "Min", f"SELECT i, {_R('min(f)')} AS v1 FROM p GROUP BY i")
_reduce_query("red_max", "Max", f"SELECT i, {_R('max(f)')} AS v1 FROM p GROUP BY i")
_reduce_query("red_argmin", "ArgMin", f"SELECT i, {_FIRST.format(way='')} AS j1 FROM p GROUP BY i", index=True, value=False)
_reduce_query("red_argmax", "ArgMax", f"SELECT i, {_FIRST.format(way='DESC')} AS j1 FROM p GROUP BY i", index=True, value=False)
_reduce_query("red_min_argmin", "Min_ArgMin", f"SELECT i, {_R('min(f)')} AS v1, {_FIRST.format(way='')} AS j1 FROM p GROUP BY i", index=True)
_reduce_query("red_max_argmax", "Max_ArgMax", f"SELECT i, {_R('max(f)')} AS v1, {_FIRST.format(way='DESC')} AS j1 FROM p GROUP BY i", index=True)
_RANKED = "SELECT i, {cols} FROM (SELECT *, row_number() OVER (PARTITION BY i ORDER BY f, j) AS n FROM p) GROUP BY i"
_KV = [_R(f"min(f) FILTER (n = {n})") + f" AS v{n}" for n in (1, 2, 3)]
_KJ = [f"min(j) FILTER (n = {n}) AS j{n}" for n in (1, 2, 3)]
_reduce_query("red_kmin", "KMin", _RANKED.format(cols=", ".join(_KV)), k=3, size=3)
_reduce_query("red_argkmin", "ArgKMin", _RANKED.format(cols=", ".join(_KJ)), k=3, size=3, index=True, value=False)
_reduce_query("red_kmin_argkmin", "KMin_ArgKMin", _RANKED.format(cols=", ".join(_KV + _KJ)), k=3, size=3, index=True)
_reduce_query("red_max_sumshiftexp", "Max_SumShiftExp", f"SELECT i, {_R('max(m)')} AS v1, {_R('sum(exp(f - m))')} AS v2 FROM (SELECT *, max(f) OVER (PARTITION BY i) AS m FROM p) GROUP BY i", size=2)
_reduce_query("red_max_sumshiftexpweight", "Max_SumShiftExpWeight", f"SELECT i, {_R('max(m)')} AS v1, {_R('sum(b * exp(f - m))')} AS v2 FROM (SELECT *, max(f) OVER (PARTITION BY i) AS m FROM p) GROUP BY i", formula2="b", size=2)
_reduce_query("red_logsumexp", "LogSumExp", f"SELECT i, {_R('ln(sum(exp(f)))')} AS v1 FROM p GROUP BY i")
_reduce_query("red_logsumexpweight", "LogSumExpWeight", f"SELECT i, {_R('ln(sum(b * exp(f)))')} AS v1 FROM p GROUP BY i", formula2="b")
_reduce_query("red_sumsoftmaxweight", "SumSoftMaxWeight", "SELECT i, " + ", ".join(_R(f"sum(y{k} * exp(f)) / sum(exp(f))") + f" AS v{k}" for k in (1, 2, 3)) + " FROM p GROUP BY i", formula2="y", size=3)
_reduce_query("red_zero", "Sum", "SELECT i, 0.0::DOUBLE AS v1, 0.0::DOUBLE AS v2, 0.0::DOUBLE AS v3 FROM l", formula="x - x", size=3)


def _kahan(spark, sf_dir):
    return _shown(PairReduce("SqDist(x,y)", ALIASES, "Sum", 1, sum_scheme="kahan_scheme").run(suppliers(spark, sf_dir), nations(spark, sf_dir)), 1)


QUERIES["red_sum_kahan"], ORACLES["red_sum_kahan"] = _kahan, ORACLES["red_sum"]


# -- entry points, tensors, batches, ranges --------------------------------------------
def gaussian_sum(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Flagship: sum over j of exp(-|x_i - y_j|^2) * label_j over all pairs of embeddings."""
    q = PairReduce("Exp(-SqDist(x,y))*label", ["x = Vi(64)", "y = Vj(64)", "label = Vj(1)"], "Sum", axis=1)
    return _shown(q.run(embeddings(spark, sf_dir, "i", "x"), embeddings(spark, sf_dir, "j", "y")), 1)


_E = "e AS (SELECT CAST(vec_id AS BIGINT) AS id, embedding::DOUBLE[] AS v, label FROM embeddings)"
_ED = "list_sum(list_transform(list_zip(a.v, c.v), lambda t: (t[1]-t[2])*(t[1]-t[2])))"
_EDOT = "list_sum(list_transform(list_zip(a.v, c.v), lambda t: t[1]*t[2]))"
QUERIES["gaussian_sum"] = gaussian_sum
ORACLES["gaussian_sum"] = f"WITH {_E} SELECT a.id AS i, {_R(f'sum(exp(-{_ED}) * c.label)')} AS v1 FROM e a, e c GROUP BY 1"


def _query(name: str, sql: str | None = None):
    def add(f):
        QUERIES[name] = f
        if sql:
            ORACLES[name] = sql
        return f

    return add


def _lr(sql: str) -> str:
    return f"WITH {POINTS_SQL}, p AS (SELECT *, {_D2} AS f FROM l, r) {sql}"


@_query("api_generic_sum", _lr(f"SELECT j, {_R('sum(exp(-f) * x1)')} AS v1 FROM p GROUP BY j"))
def _generic_sum(spark, sf_dir):
    return _shown(generic_sum("Exp(-SqDist(x,y)) * Elem(x,0)", "a = Vj(1)", *ALIASES[:2]).run(suppliers(spark, sf_dir), nations(spark, sf_dir)), 1)


@_query("api_generic_logsumexp", _lr(f"SELECT i, {_R('ln(sum(exp(-f)))')} AS v1 FROM p GROUP BY i"))
def _generic_lse(spark, sf_dir):
    return _shown(generic_logsumexp("-SqDist(x,y)", "a = Vi(1)", *ALIASES[:2]).run(suppliers(spark, sf_dir), nations(spark, sf_dir)), 1)


@_query("api_generic_argmin", _lr("SELECT i, first(j ORDER BY f, j) AS j1 FROM p GROUP BY i"))
def _generic_argmin(spark, sf_dir):
    return generic_argmin("SqDist(x,y)", "a = Vi(1)", *ALIASES[:2]).run(suppliers(spark, sf_dir), nations(spark, sf_dir)).select("i", F.col("index")[0].alias("j1"))


@_query("api_generic_argkmin", _lr("SELECT i, min(j) FILTER (n = 1) AS j1, min(j) FILTER (n = 2) AS j2 FROM (SELECT *, row_number() OVER (PARTITION BY i ORDER BY f, j) AS n FROM p) GROUP BY i"))
def _generic_argkmin(spark, sf_dir):
    out = generic_argkmin("SqDist(x,y)", "a = Vi(2)", *ALIASES[:2]).run(suppliers(spark, sf_dir), nations(spark, sf_dir))
    return out.select("i", F.col("index")[0].alias("j1"), F.col("index")[1].alias("j2"))


def _xy(spark, sf_dir):
    left, right = suppliers(spark, sf_dir), nations(spark, sf_dir)
    return Vi(left, "x", dim=3), Vj(right, "y", dim=3), Vj(right, "b", dim=1)


@_query("tensor_gaussian_matvec", _lr(f"SELECT i, {_R('sum(exp(-f / 0.5::DOUBLE) * b)')} AS v1 FROM p GROUP BY i"))
def _tensor(spark, sf_dir):
    x, y, b = _xy(spark, sf_dir)
    return _shown((-((x - y) ** 2).sum(-1) / Pm(0.5)).exp() @ b, 1)


@_query("tensor_transpose", _lr(f"SELECT j AS i, {_R('sum(exp(-f) * x1)')} AS v1 FROM p GROUP BY j"))
def _transposed(spark, sf_dir):
    x, y, _ = _xy(spark, sf_dir)
    out = ((-x.sqdist(y)).exp() * x[0]).t().sum(axis=1)
    return _shown(out.withColumnRenamed("j", "i"), 1)


@_query("tensor_gradient", _lr("SELECT i, " + ", ".join(_R(f"sum(-2 * (x{k}-y{k}) * exp(-f) * b)") + f" AS v{k}" for k in (1, 2, 3)) + " FROM p GROUP BY i"))
def _tensor_gradient(spark, sf_dir):
    q = PairReduce("Exp(-SqDist(x,y))*b", ALIASES, "Sum", 1).grad("x")
    return _shown(q.run(suppliers(spark, sf_dir).withColumn("eta", F.lit(1.0)), nations(spark, sf_dir)), 3)


@_query("tensor_directional", _lr(f"SELECT i, {_R('sum(-2 * ((x1-y1) + 2 * (x2-y2) + 3 * (x3-y3)) * exp(-f) * b)')} AS v1 FROM p GROUP BY i"))
def _tensor_directional(spark, sf_dir):
    left = suppliers(spark, sf_dir).withColumn("u", F.array(F.lit(1.0), F.lit(2.0), F.lit(3.0)))
    return _shown(PairReduce("Exp(-SqDist(x,y))*b", ALIASES, "Sum", 1).diff("x").run(left, nations(spark, sf_dir)), 1)


@_query("gradient_of_logsumexp", _lr("SELECT i, " + ", ".join(_R(f"sum(-2 * (x{k}-y{k}) * exp(-f)) / sum(exp(-f))") + f" AS v{k}" for k in (1, 2, 3)) + " FROM p GROUP BY i"))
def _gradient_of_logsumexp(spark, sf_dir):
    left, right = suppliers(spark, sf_dir), nations(spark, sf_dir)
    q = PairReduce("-SqDist(x,y)", ALIASES[:2], "LogSumExp", 1)
    own = q.run(left, right).select("i", F.col("value")[0].alias("saved"))
    return _shown(q.grad("x").run(left.join(own, "i").withColumn("eta", F.lit(1.0)), right), 3)


@_query("parameter_scale", _lr(f"SELECT i, {_R('sum(exp(-2.5::DOUBLE * f) * b)')} AS v1 FROM p GROUP BY i"))
def _parameter(spark, sf_dir):
    q = PairReduce("Exp(-g*SqDist(x,y))*b", [*ALIASES, "g = Pm(1)"], "Sum", 1)
    return _shown(q.run(suppliers(spark, sf_dir), nations(spark, sf_dir), params={"g": 2.5}), 1)


@_query("parameter_table", f"WITH {POINTS_SQL}, g AS (SELECT p_size, p_size::DOUBLE / 10::DOUBLE AS g FROM (SELECT DISTINCT p_size FROM part)), p AS (SELECT i, p_size, g, {_D2} AS f, b FROM l, r, g) SELECT CAST(p_size AS INT) AS p_size, i, {_R('sum(exp(-g * f) * b)')} AS v1 FROM p GROUP BY p_size, i")
def _parameter_table(spark, sf_dir):
    """A scale for each size of part, all in one pass over suppliers and nations."""
    sizes = table(spark, sf_dir, "part").select("p_size").distinct().withColumn("g", F.col("p_size").cast("double") / 10.0)
    q = PairReduce("Exp(-g*SqDist(x,y))*b", [*ALIASES, "g = Pm(1)"], "Sum", 1)
    return _shown(q.run(suppliers(spark, sf_dir), nations(spark, sf_dir), params=sizes, params_key="p_size"), 1)


@_query("chunked_manhattan", f"WITH {_E}, p AS (SELECT a.id AS i, list_sum(list_transform(list_zip(a.v, c.v), lambda t: abs(t[1]-t[2]))) AS d, c.label AS b FROM e a, e c) SELECT i, {_R('sum(exp(-d) * b)')} AS v1 FROM p GROUP BY i")
def _chunked(spark, sf_dir):
    """A kernel of the L1 distance, whose components are added up by slices."""
    q = PairReduce("Exp(-Sum(Abs(x-y)))*label", ["x = Vi(64)", "y = Vj(64)", "label = Vj(1)"], "Sum", 1)
    return _shown(q.run_itself(embeddings(spark, sf_dir, "i", "x"), {"x": "x", "y": "x", "label": "label"}), 1)


@_query("batch_broadcast", f"WITH {POINTS_SQL}, p AS (SELECT l.i, r.j % 3 AS g, {_D2} AS f, b FROM l, r) SELECT CAST(g AS BIGINT) AS g, i, {_R('sum(exp(-f) * b)')} AS v1 FROM p GROUP BY g, i")
def _batch_broadcast(spark, sf_dir):
    """Only the j side has the batch key: every i meets every batch."""
    left, right = suppliers(spark, sf_dir), nations(spark, sf_dir).withColumn("g", F.col("j") % 3)
    x, y, b = Vi(left, "x", dim=3), Vj(right, "y", dim=3, batch=["g"]), Vj(right, "b", dim=1, batch=["g"])
    return _shown(((-x.sqdist(y)).exp() * b).sum(axis=1), 1)


@_query("stream_logsumexp", _lr(f"SELECT i, {_R('ln(sum(exp(-f)))')} AS v1 FROM p GROUP BY i"))
def _stream(spark, sf_dir):
    """Nations arrive as a stream; states of suppliers merge."""
    from pairloom.session import work_folder

    raw = spark.readStream.schema(table(spark, sf_dir, "nation").schema).parquet(f"{sf_dir}/nation*.parquet")
    y = [(F.col("n_nationkey") + 1).cast("double") / 26.0, (F.col("n_regionkey") + 1).cast("double") / 6.0, F.length("n_name").cast("double") / 20.0]
    stream = points(raw, "n_nationkey", {"y": y}, "j")
    q = PairReduce("-SqDist(x,y)", ALIASES[:2], "LogSumExp", 1)
    return _shown(streaming.reduce_available(q, suppliers(spark, sf_dir), stream, work_folder(spark, "stream")), 1)


@_query("columns_strategy", _lr(f"SELECT i, {_R('sum(exp(-f) * b)')} AS v1 FROM p GROUP BY i"))
def _columns(spark, sf_dir):
    return _shown(PairReduce("Exp(-SqDist(x,y))*b", ALIASES, "Sum", 1).run(suppliers(spark, sf_dir), nations(spark, sf_dir), strategy="columns"), 1)


@_query("blocks_strategy", _lr(f"SELECT i, {_R('sum(exp(-f) * b)')} AS v1 FROM p GROUP BY i"))
def _blocks(spark, sf_dir):
    return _shown(PairReduce("Exp(-SqDist(x,y))*b", ALIASES, "Sum", 1).run(suppliers(spark, sf_dir), nations(spark, sf_dir), strategy="blocks"), 1)


@_query("batched_sum", f"WITH {POINTS_SQL}, p AS (SELECT l.*, r.*, i % 3 AS g, {_D2} AS f FROM l, r WHERE i % 3 = j % 3) SELECT CAST(g AS BIGINT) AS g, i, {_R('sum(exp(-f) * b)')} AS v1 FROM p GROUP BY g, i")
def _batched(spark, sf_dir):
    left, right = suppliers(spark, sf_dir).withColumn("g", F.col("i") % 3), nations(spark, sf_dir).withColumn("g", F.col("j") % 3)
    x, y, b = Vi(left, "x", dim=3, batch=["g"]), Vj(right, "y", dim=3, batch=["g"]), Vj(right, "b", dim=1, batch=["g"])
    return _shown(((-x.sqdist(y)).exp() * b).sum(axis=1), 1)


def _gridded(spark, sf_dir):
    left = cluster.grid_cluster(suppliers(spark, sf_dir), "x", 0.5, 3, "bi")
    right = cluster.grid_cluster(nations(spark, sf_dir), "y", 0.5, 3, "bj")
    return left, right


_GRID = f"""{POINTS_SQL}, lc AS (SELECT *, dense_rank() OVER (ORDER BY floor(x1/0.5::DOUBLE), floor(x2/0.5::DOUBLE), floor(x3/0.5::DOUBLE)) - 1 AS bi FROM l),
rc AS (SELECT *, dense_rank() OVER (ORDER BY floor(y1/0.5::DOUBLE), floor(y2/0.5::DOUBLE), floor(y3/0.5::DOUBLE)) - 1 AS bj FROM r),
ca AS (SELECT bi, avg(x1) AS c1, avg(x2) AS c2, avg(x3) AS c3, count(*)::DOUBLE AS weight FROM lc GROUP BY bi),
cb AS (SELECT bj, avg(y1) AS d1, avg(y2) AS d2, avg(y3) AS d3 FROM rc GROUP BY bj)"""


@_query("grid_cluster", f"WITH {_GRID} SELECT i, CAST(bi AS INT) AS label FROM lc")
def _grid(spark, sf_dir):
    return cluster.grid_cluster(suppliers(spark, sf_dir), "x", 0.5, 3).select("i", "label")


@_query("sort_clusters", f"WITH {_GRID} SELECT i, CAST(bi AS INT) AS label FROM lc ORDER BY bi, i")
def _sorted(spark, sf_dir):
    return cluster.sort_clusters(cluster.grid_cluster(suppliers(spark, sf_dir), "x", 0.5, 3), "label", "i").select("i", "label")


@_query("cluster_ranges", f'WITH {_GRID} SELECT CAST(bi AS INT) AS label, CAST(sum(n) OVER (ORDER BY bi) - n AS BIGINT) AS "start", CAST(sum(n) OVER (ORDER BY bi) AS BIGINT) AS "end" FROM (SELECT bi, count(*) AS n FROM lc GROUP BY bi)')
def _ranges(spark, sf_dir):
    return cluster.cluster_ranges(cluster.grid_cluster(suppliers(spark, sf_dir), "x", 0.5, 3), "label")


@_query("cluster_centroids", f"WITH {_GRID} SELECT CAST(bi AS INT) AS label, weight, {_R('c1')} AS v1, {_R('c2')} AS v2, {_R('c3')} AS v3 FROM ca")
def _centroids(spark, sf_dir):
    return components(cluster.cluster_centroids(cluster.grid_cluster(suppliers(spark, sf_dir), "x", 0.5, 3), "x", "label", 3), "centroid", "v", 3, DIGITS)


@_query("cluster_ranges_centroids", f'WITH {_GRID} SELECT CAST(bi AS INT) AS label, weight, CAST(sum(weight) OVER (ORDER BY bi) - weight AS BIGINT) AS "start", CAST(sum(weight) OVER (ORDER BY bi) AS BIGINT) AS "end", {_R("c1")} AS v1, {_R("c2")} AS v2, {_R("c3")} AS v3 FROM ca')
def _both(spark, sf_dir):
    return components(cluster.cluster_ranges_centroids(cluster.grid_cluster(suppliers(spark, sf_dir), "x", 0.5, 3), "x", "label", 3), "centroid", "v", 3, DIGITS)


_NEAR = "((c1-d1)*(c1-d1) + (c2-d2)*(c2-d2) + (c3-d3)*(c3-d3)) < 0.64::DOUBLE"


@_query("block_sparse_sum", f"WITH {_GRID}, p AS (SELECT i, {_D2} AS f, b FROM lc JOIN ca USING (bi), rc JOIN cb USING (bj) WHERE {_NEAR}) SELECT l.i, round(coalesce(sum(exp(-f) * b), 0.0::DOUBLE), {DIGITS}) + 0.0::DOUBLE AS v1 FROM l LEFT JOIN p ON l.i = p.i GROUP BY l.i")
def _sparse(spark, sf_dir):
    left, right = _gridded(spark, sf_dir)
    a, b = cluster.cluster_centroids(left, "x", "bi", 3).withColumnRenamed("bi", "label"), cluster.cluster_centroids(right, "y", "bj", 3).withColumnRenamed("bj", "label")
    ranges = cluster.close_blocks(a, b, 0.8)
    return _shown(PairReduce("Exp(-SqDist(x,y))*b", ALIASES, "Sum", 1).run(left, right, ranges=ranges), 1)


@_query("block_sparse_swapped", f"WITH {_GRID}, p AS (SELECT j, {_D2} AS f, x1 FROM lc JOIN ca USING (bi), rc JOIN cb USING (bj) WHERE {_NEAR}) SELECT r.j, round(coalesce(sum(exp(-f) * x1), 0.0::DOUBLE), {DIGITS}) + 0.0::DOUBLE AS v1 FROM r LEFT JOIN p ON r.j = p.j GROUP BY r.j")
def _swapped(spark, sf_dir):
    left, right = _gridded(spark, sf_dir)
    a, b = cluster.cluster_centroids(left, "x", "bi", 3).withColumnRenamed("bi", "label"), cluster.cluster_centroids(right, "y", "bj", 3).withColumnRenamed("bj", "label")
    # the nations become side i, so the blocks of the pairs change sides too
    ranges = cluster.swap_axes(cluster.close_blocks(a, b, 0.8))
    q = PairReduce("Exp(-SqDist(x,y))*Elem(y,0)", ["x = Vi(3)", "y = Vj(3)"], "Sum", 1)
    right, left = right.withColumnRenamed("y", "x"), left.withColumnRenamed("x", "y")
    out = q.run(right.withColumnRenamed("bj", "bi").withColumnRenamed("j", "i"), left.withColumnRenamed("bi", "bj").withColumnRenamed("i", "j"), ranges=ranges)
    return _shown(out.withColumnRenamed("i", "j"), 1)


@_query("tensor_transpose_ranged", f"WITH {_GRID}, p AS (SELECT j, {_D2} AS f, x1 FROM lc JOIN ca USING (bi), rc JOIN cb USING (bj) WHERE {_NEAR}) SELECT r.j, round(coalesce(sum(exp(-f) * x1), 0.0::DOUBLE), {DIGITS}) + 0.0::DOUBLE AS v1 FROM r LEFT JOIN p ON r.j = p.j GROUP BY r.j")
def _transposed_ranged(spark, sf_dir):
    """The transpose of a block-sparse kernel times a vector over i."""
    left, right = _gridded(spark, sf_dir)
    a, b = cluster.cluster_centroids(left, "x", "bi", 3).withColumnRenamed("bi", "label"), cluster.cluster_centroids(right, "y", "bj", 3).withColumnRenamed("bj", "label")
    left = left.withColumn("c", F.col("x")[0])
    x, y, c = Vi(left, "x", dim=3), Vj(right, "y", dim=3), Vi(left, "c", dim=1)
    kernel = (-x.sqdist(y)).exp() * c
    kernel.ranges = cluster.close_blocks(a, b, 0.8)
    return _shown(kernel.t().sum(axis=1), 1)


@_query("ranges_from_matrix", "SELECT DISTINCT CAST(n_regionkey AS BIGINT) AS bi, CAST(n_nationkey AS BIGINT) AS bj FROM nation WHERE n_nationkey % 2 = 0")
def _from_matrix(spark, sf_dir):
    mask = table(spark, sf_dir, "nation").select(F.col("n_regionkey").cast("long").alias("bi"), F.col("n_nationkey").cast("long").alias("bj"), (F.col("n_nationkey") % 2 == 0).cast("double").alias("keep"))
    return cluster.from_matrix(mask)


# -- reference workloads -----------------------------------------------------------------
_KNN = "SELECT i, {cols} FROM (SELECT a.id AS i, c.id AS j, row_number() OVER (PARTITION BY a.id ORDER BY {d}, c.id) AS n FROM e a, e c) WHERE n <= 5 GROUP BY i"
_KNN_COLS = ", ".join(f"min(j) FILTER (n = {n}) AS j{n}" for n in range(1, 6))


def _knn(formula: str):
    def run(spark, sf_dir):
        q = PairReduce(formula, ["x = Vi(64)", "y = Vj(64)"], "ArgKMin", 1, k=5)
        out = q.run(embeddings(spark, sf_dir, "i", "x"), embeddings(spark, sf_dir, "j", "y"))
        return out.select("i", *(F.col("index")[n].alias(f"j{n + 1}") for n in range(5)))

    return run


_query("knn_euclidean", f"WITH {_E} {_KNN.format(cols=_KNN_COLS, d=_ED)}")(_knn("SqDist(x,y)"))
_query("knn_manhattan", f"WITH {_E} {_KNN.format(cols=_KNN_COLS, d='list_sum(list_transform(list_zip(a.v, c.v), lambda t: abs(t[1]-t[2])))')}")(_knn("Sum(Abs(x-y))"))
_query("knn_angular", f"WITH {_E} {_KNN.format(cols=_KNN_COLS, d=f'-{_EDOT}')}")(_knn("-(x|y)"))
_query("knn_hyperbolic", f"WITH {_E} {_KNN.format(cols=_KNN_COLS, d=f'{_ED} / ((2 + a.v[1]) * (2 + c.v[1]))')}")(_knn("SqDist(x,y) / ((2 + Elem(x,0)) * (2 + Elem(y,0)))"))


@_query("knn_pruned", ORACLES["knn_euclidean"])
def _knn_pruned(spark, sf_dir):
    """The same neighbours, without the clusters that cannot hold any."""
    near = neighbours.NearestRows(embeddings(spark, sf_dir, "i", "x"), embeddings(spark, sf_dir, "j", "y"), "x", "y", 5, 64)
    return near.run().select("i", *(F.col("index")[n].alias(f"j{n + 1}") for n in range(5)))


def rounded_length(column: str):
    """A number from 0 to 2^43 rounded half up to ``DIGITS`` digits, without the decimals that ``round`` makes of each row."""
    return F.floor(F.col(column) * 10.0**DIGITS + 0.5) / 10.0**DIGITS


@_query("distance_join_embeddings", f"WITH {_E} SELECT i, j, {_R('sqrt(d)')} AS v1 FROM (SELECT a.id AS i, c.id AS j, {_ED} AS d FROM e a, e c) WHERE d <= 1.44::DOUBLE")
def _close_embeddings(spark, sf_dir):
    """All pairs of embeddings at a distance of at most 1.2."""
    out = neighbours.close_pairs(embeddings(spark, sf_dir, "i", "x"), embeddings(spark, sf_dir, "j", "y"), "x", "y", 1.2, 64)
    return out.select("i", "j", rounded_length("value").alias("v1"))


@_query("distance_join_points", f"WITH a AS (SELECT CAST(c_custkey AS BIGINT) AS i, c_acctbal / 9973::DOUBLE AS x1, c_nationkey::DOUBLE / 25::DOUBLE AS x2 FROM customer), b AS (SELECT CAST(s_suppkey AS BIGINT) AS j, s_acctbal / 9973::DOUBLE AS y1, s_nationkey::DOUBLE / 25::DOUBLE AS y2 FROM supplier) SELECT i, j, {_R('sqrt(d)')} AS v1 FROM (SELECT i, j, (x1 - y1) * (x1 - y1) + (x2 - y2) * (x2 - y2) AS d FROM a, b) WHERE d <= 0.0053::DOUBLE")
def _close_points(spark, sf_dir):
    """Customers and suppliers alike in balance and nation: all pairs within the radius."""
    of = lambda name, c: points(table(spark, sf_dir, name), f"{c}_{'cust' if c == 'c' else 'supp'}key", {"p": [F.col(f"{c}_acctbal").cast("double") / 9973.0, F.col(f"{c}_nationkey").cast("double") / 25.0]}, "i" if c == "c" else "j")
    out = neighbours.close_pairs(of("customer", "c"), of("supplier", "s"), "p", "p", 0.0053**0.5, 2)
    return out.select("i", "j", rounded_length("value").alias("v1"))


@_query("knn_classifier", f"WITH {_E}, k AS (SELECT a.id AS i, c.label, row_number() OVER (PARTITION BY a.id ORDER BY {_ED}, c.id) AS n FROM e a, e c), m AS (SELECT i, label, count(*) AS c FROM k WHERE n <= 10 GROUP BY i, label) SELECT i, CAST(first(label ORDER BY c DESC, label) AS INT) AS label FROM m GROUP BY i")
def _classifier(spark, sf_dir):
    q = PairReduce("SqDist(x,y)", ["x = Vi(64)", "y = Vj(64)"], "ArgKMin", 1, k=10)
    near = q.run(embeddings(spark, sf_dir, "i", "x"), embeddings(spark, sf_dir, "j", "y")).select("i", F.explode("index").alias("j"))
    labels = table(spark, sf_dir, "embeddings").select(F.col("vec_id").alias("j"), "label")
    votes = near.join(labels, "j").groupBy("i", "label").count()
    return votes.groupBy("i").agg(F.min(F.struct((-F.col("count")).alias("c"), "label")).alias("best")).select("i", F.col("best.label").cast("int").alias("label"))


@_query("attention_softmax", f"WITH {_E}, w AS (SELECT a.id AS i, exp({_EDOT}) AS w, c.v FROM e a, e c) SELECT i, {', '.join(_R(f'sum(w * v[{k}]) / sum(w)') + f' AS v{k}' for k in range(1, 65))} FROM w GROUP BY i")
def _attention(spark, sf_dir):
    q = PairReduce("(x|y)", ["x = Vi(64)", "y = Vj(64)"], "SumSoftMaxWeight", 1, formula2="y")
    return _shown(q.run_itself(embeddings(spark, sf_dir, "i", "x"), {"x": "x", "y": "x"}, digits=DIGITS), 64)


@_query("varifold_matvec", f"WITH {_E} SELECT a.id AS i, {_R(f'sum(exp(-{_ED}) * {_EDOT} * {_EDOT} * c.label)')} AS v1 FROM e a, e c GROUP BY 1")
def _varifold(spark, sf_dir):
    q = PairReduce("Exp(-SqDist(x,y)) * Square((x|y)) * label", ["x = Vi(64)", "y = Vj(64)", "label = Vj(1)"], "Sum", 1)
    return _shown(q.run_itself(embeddings(spark, sf_dir, "i", "x"), {"x": "x", "y": "x", "label": "label"}), 1)


@_query("gaussian_mixture", _lr(f"SELECT i, {_R('ln(sum(b * exp(-(b * f))))')} AS v1 FROM p GROUP BY i"))
def _mixture(spark, sf_dir):
    x, y, b = _xy(spark, sf_dir)
    return _shown((-x.weightedsqdist(y, b)).logsumexp(axis=1, weight=b), 1)


@_query("anisotropic_kernel", _lr(f"SELECT i, {_R('sum(exp(-(2*(x1-y1)*(x1-y1) + (x2-y2)*(x2-y2) + 3*(x3-y3)*(x3-y3))) * b)')} AS v1 FROM p GROUP BY i"))
def _anisotropic(spark, sf_dir):
    x, y, b = _xy(spark, sf_dir)
    return _shown((-(x - y).weightedsqnorm(Pm([2.0, 1.0, 3.0]))).exp() @ b, 1)


@_query("theta_join_count", _lr("SELECT i, CAST(count(*) FILTER (f < 0.3::DOUBLE) AS DOUBLE) AS v1 FROM p GROUP BY i"))
def _theta(spark, sf_dir):
    x, y, _ = _xy(spark, sf_dir)
    return _shown((x.sqdist(y) < 0.3).sum(axis=1), 1)


@_query("kmeans_step", f"WITH {_E}, c AS (SELECT id, v FROM e WHERE id < 8), n AS (SELECT a.id, a.v, first(c.id ORDER BY {_ED}, c.id) AS k FROM e a, c GROUP BY a.id, a.v) SELECT k, count(*) AS n, {', '.join(_R(f'avg(v[{d}])') + f' AS v{d}' for d in range(1, 65))} FROM n GROUP BY k")
def _kmeans(spark, sf_dir):
    """One Lloyd step from the first eight vectors as centres."""
    left = embeddings(spark, sf_dir, "i", "x")
    right = embeddings(spark, sf_dir, "j", "y").where(F.col("j") < 8)
    near = PairReduce("SqDist(x,y)", ["x = Vi(64)", "y = Vj(64)"], "ArgMin", 1).run(left, right)
    joined = near.select("i", F.col("index")[0].alias("k")).join(left.select("i", "x"), "i")
    return joined.groupBy("k").agg(F.count(F.lit(1)).alias("n"), *((F.round(F.avg(F.col("x")[d]), DIGITS) + 0.0).alias(f"v{d + 1}") for d in range(64)))


@_query("kmeans_lloyd", f"WITH {_E}, c0 AS (SELECT id AS k, v FROM e WHERE id < 8)" + "".join(f", n{s} AS (SELECT a.id, a.v, first(c.k ORDER BY {_ED}, c.k) AS k FROM e a, c{s} c GROUP BY a.id, a.v), c{s + 1} AS (SELECT k, [{', '.join(f'avg(v[{d}])' for d in range(1, 65))}] AS v FROM n{s} GROUP BY k)" for s in range(3)) + f" SELECT k, {', '.join(_R(f'v[{d}]') + f' AS v{d}' for d in range(1, 65))} FROM c3")
def _lloyd(spark, sf_dir):
    """Three Lloyd steps from the first eight vectors as centres."""
    left = embeddings(spark, sf_dir, "i", "x")
    centres = embeddings(spark, sf_dir, "j", "y").where(F.col("j") < 8).select("j", "y")
    return components(kmeans(left, centres, "x", "y", 64, 3).withColumnRenamed("j", "k"), "y", "v", 64, DIGITS)


def kmeans(left: DataFrame, centres: DataFrame, x: str, y: str, dim: int, steps: int) -> DataFrame:
    """Centres (j, ``y``) after ``steps`` Lloyd steps over the rows (i, ``x``); a centre without rows goes."""
    q = PairReduce(f"SqDist({x},{y})", [f"{x} = Vi({dim})", f"{y} = Vj({dim})"], "ArgMin", 1)
    for _ in range(steps):
        near = q.run(left, centres).select("i", F.col("index")[0].alias("j")).join(left.select("i", x), "i")
        centres = near.groupBy("j").agg(F.array(*(F.avg(F.col(x)[d]) for d in range(dim))).alias(y))
    return centres


def _solved_sql(kernel: str, b: str, shown: str = "round(m[p][n + 1], 4) + 0.0::DOUBLE", rows: str = "r") -> str:
    """j, v1: (K + 0.1) a = ``b`` over the nations by Gauss-Jordan elimination, a row of the matrix and the right-hand side each a list."""
    return f"""WITH RECURSIVE {POINTS_SQL}, k AS (SELECT s.j AS i, t.j, {kernel} + CASE WHEN s.j = t.j THEN 0.1::DOUBLE ELSE 0 END AS k FROM {rows} s, {rows} t),
m AS (SELECT list(line ORDER BY i) AS m, count(*) AS n FROM (SELECT i, list_append(list(k ORDER BY j), (SELECT {b} FROM {rows} r WHERE r.j = k.i)) AS line FROM k GROUP BY i)),
g AS (SELECT 1 AS step, n, m FROM m
UNION ALL SELECT step + 1, n, list_transform(m, lambda line, p: CASE WHEN p = step THEN list_transform(line, lambda v: v / line[step]) ELSE list_transform(list_zip(line, m[step]), lambda t: t[1] - line[step] / m[step][step] * t[2]) END) FROM g WHERE step <= n)
SELECT j, {shown} AS v1 FROM g, (SELECT j, row_number() OVER (ORDER BY j) AS p FROM {rows}) WHERE step = n + 1"""


_KERNEL_D2 = "((s.y1-t.y1)*(s.y1-t.y1) + (s.y2-t.y2)*(s.y2-t.y2) + (s.y3-t.y3)*(s.y3-t.y3))"


def _both_nations(spark, sf_dir):
    right = nations(spark, sf_dir)
    return right.select(F.col("j").alias("i"), F.col("y").alias("x")), right


@_query("rbf_interpolation", _solved_sql(f"exp(-{_KERNEL_D2})", "b"))
def _rbf(spark, sf_dir):
    """a with (K + alpha) a = b over the nations, Gaussian K."""
    solver = KernelSolve("Exp(-SqDist(x,y))*b", ALIASES, "b", axis=1)
    return components(solver.run(*_both_nations(spark, sf_dir), alpha=0.1, eps=1e-9), "value", "v", 1, 4)


@_query("laplacian_kernel_solve", _solved_sql(f"exp(-sqrt({_KERNEL_D2}))", "b"))
def _laplacian(spark, sf_dir):
    return components(KernelSolve("Exp(-Norm2(x-y))*b", ALIASES, "b", axis=1).run(*_both_nations(spark, sf_dir), alpha=0.1, eps=1e-9), "value", "v", 1, 4)


@_query("gradient_of_solve", _solved_sql(f"exp(-{_KERNEL_D2})", "y1"))
def _gradient_of_solve(spark, sf_dir):
    """The gradient of the solution by the right-hand side, applied to the first coordinate."""
    left, right = _both_nations(spark, sf_dir)
    out = KernelSolve("Exp(-SqDist(x,y))*b", ALIASES, "b").grad("b", left, right.withColumn("eta", F.col("y")[0]), alpha=0.1, eps=1e-9)
    return components(out, "value", "v", 1, 4)


_KERNEL_R = f"k AS (SELECT s.j AS i, t.j, exp(-{_KERNEL_D2}) AS k FROM r s, r t)"


@_query("power_iteration", f"WITH {POINTS_SQL}, {_KERNEL_R}, a0 AS (SELECT j, b FROM r)" + "".join(f", o{s} AS (SELECT i AS j, sum(k * b) AS b FROM k JOIN a{s} USING (j) GROUP BY i), a{s + 1} AS (SELECT j, b / (SELECT sqrt(sum(b * b)) FROM o{s}) AS b FROM o{s})" for s in range(3)) + f" SELECT j, {_R('b')} AS v1 FROM a3")
def _power(spark, sf_dir):
    """Three steps towards the first eigenvector of the Gaussian kernel of the nations."""
    left, right = _both_nations(spark, sf_dir)
    q = PairReduce("Exp(-SqDist(x,y))*b", ALIASES, "Sum", 1)
    for _ in range(3):
        out = q.run(left, right).select(F.col("i").alias("j"), F.col("value")[0].alias("b"))
        norm = out.agg(F.sqrt(F.sum(F.col("b") * F.col("b")))).first()[0]
        right = right.drop("b").join(out.withColumn("b", F.col("b") / norm), "j")
    return right.select("j", F.round("b", DIGITS).alias("v1"))


@_query("power_iteration_operator", f"WITH {POINTS_SQL}, {_KERNEL_R} SELECT i, {_R('sum(k * b)')} AS v1 FROM k JOIN r USING (j) GROUP BY i")
def _matvec(spark, sf_dir):
    """One product through the linear operator's own method."""
    left, right = _both_nations(spark, sf_dir)
    x, y, b = Vi(left, "x", dim=3), Vj(right, "y", dim=3), Vj(right, "b", dim=1)
    return _shown((-x.sqdist(y)).exp().matvec(b), 1)


@_query("anisotropic_full", _lr(f"SELECT i, {_R('sum(exp(-(2*(x1-y1)*(x1-y1) + (x2-y2)*(x2-y2) + 3*(x3-y3)*(x3-y3) + (x1-y1)*(x2-y2))) * b)')} AS v1 FROM p GROUP BY i"))
def _anisotropic_full(spark, sf_dir):
    """A full matrix of weights: half the mixed term on either side of the diagonal."""
    x, y, b = _xy(spark, sf_dir)
    return _shown((-(x - y).weightedsqnorm(Pm([2.0, 0.5, 0.0, 0.5, 1.0, 0.0, 0.0, 0.0, 3.0]))).exp() @ b, 1)


@_query("anisotropic_scalar", _lr(f"SELECT i, {_R('sum(exp(-(2 * f)) * b)')} AS v1 FROM p GROUP BY i"))
def _anisotropic_scalar(spark, sf_dir):
    x, y, b = _xy(spark, sf_dir)
    return _shown((-(x - y).weightedsqnorm(Pm(2.0))).exp() @ b, 1)


@_query("directional_logsumexp", _lr(f"SELECT i, {_R('sum(exp(-f) * (2 * (x1-y1) * y1 + 2 * (x2-y2) * y2 + 2 * (x3-y3) * y3)) / sum(exp(-f))')} AS v1 FROM p GROUP BY i"))
def _directional_logsumexp(spark, sf_dir):
    """The derivative of a log-sum-exp along y, given its own values."""
    left, right = suppliers(spark, sf_dir), nations(spark, sf_dir)
    q = PairReduce("-SqDist(x,y)", ALIASES[:2], "LogSumExp", 1)
    own = q.run(left, right).select("i", F.col("value")[0].alias("saved"))
    return _shown(q.diff("y").run(left.join(own, "i"), right.withColumn("u", F.col("y"))), 1)


@_query("complex_tensor", _lr(f"SELECT i, {_R('sum(x1 * y1 - x2 * y2)')} AS v1, {_R('sum(x1 * y2 + x2 * y1)')} AS v2 FROM p GROUP BY i"))
def _complex(spark, sf_dir):
    """Complex numbers of two coordinates each: the sum of their products."""
    left = suppliers(spark, sf_dir).withColumn("z", F.slice("x", 1, 2))
    right = nations(spark, sf_dir).withColumn("w", F.slice("y", 1, 2))
    z, w = Vi(left, "z", dim=2), Vj(right, "w", dim=2)
    return _shown((z.op("ComplexMult", w)).sum(axis=1), 2)


@_query("complex_tensor_class", _lr("SELECT i, " + ", ".join(f"{_R(f'sum({c})')} AS v{k + 1}" for k, c in enumerate(["(x1 * y1 + x2 * y2) / (y1 * y1 + y2 * y2) + exp(x1) * cos(x2)", "(x2 * y1 - x1 * y2) / (y1 * y1 + y2 * y2) - exp(x1) * sin(x2) + sqrt(y1 * y1 + y2 * y2)"])) + " FROM p GROUP BY i"))
def _complex_class(spark, sf_dir):
    """Quotient, conjugate, exponential and modulus of complex tensors: z / w + conj(exp z) + |w| i."""
    left, right = suppliers(spark, sf_dir).withColumn("z", F.slice("x", 1, 2)), nations(spark, sf_dir).withColumn("w", F.slice("y", 1, 2))
    z, w = as_complex(Vi(left, "z", dim=2)), as_complex(Vj(right, "w", dim=2))
    return _shown((z / w + z.exp().conj() + abs(w).imag2complex()).sum(axis=1), 2)


@_query("complex_tensor_parts", _lr(f"SELECT i, {_R('sum((x1*x1 + x2*x2) * cos(y3) - atan2(x2, x1) * x1)')} AS v1 FROM p GROUP BY i"))
def _complex_parts(spark, sf_dir):
    """Squared modulus, angle, real parts, and exponentials on the unit circle."""
    left, right = suppliers(spark, sf_dir).withColumn("z", F.slice("x", 1, 2)), nations(spark, sf_dir).withColumn("t", F.col("y")[2])
    z, t = as_complex(Vi(left, "z", dim=2)), Vj(right, "t", dim=1)
    return _shown((z.squareabs() * exp1j(t).real - z.angle() * z.real).sum(axis=1), 1)


@_query("tensor_functions", _lr("SELECT i, " + ", ".join(_R(f"sum(atan2(x{k}, y{k}) + CASE WHEN x{k} >= y{k} THEN x{k} ELSE y{k} * y{k} END + CASE WHEN x{k} < 0.2::DOUBLE THEN 0.2::DOUBLE WHEN x{k} > y{k} THEN y{k} ELSE x{k} END + pow(y{k}, 1 + x{k}) + x{k} - y{k} * floor(x{k} / y{k}))") + f" AS v{k}" for k in (1, 2, 3)) + " FROM p GROUP BY i"))
def _tensor_functions(spark, sf_dir):
    """Methods of two and three arguments."""
    x, y, _ = _xy(spark, sf_dir)
    return _shown((x.atan2(y) + (x - y).ifelse(x, y * y) + x.clamp(0.2, y) + y ** (x + 1) + x.mod(y)).sum(axis=1), 3)


@_query("tensor_calculus", _lr(f"SELECT i, {_R('sum(-2 * (x1 - y1) * exp(-f) * 2 + y3 * (' + _YY + ') + (y1 + 2 * y2 + 3 * y3) * (x1 * y1 + x2 * y2 + x3 * y3))')} AS v1 FROM p GROUP BY i"))
def _tensor_calculus(spark, sf_dir):
    """A gradient, a trace times a weight, and the weighted sum of a linear map, as methods."""
    x, y, _ = _xy(spark, sf_dir)
    linear = y.tensorprod(y).matvecmult(x)
    return _shown(((-x.sqdist(y)).exp().grad(x, 2)[0] + linear.trace_operator(x, y[2]) + linear.sum_operator(x, Pm([1.0, 2.0, 3.0]), x)).sum(axis=1), 1)


@_query("operator_rmatvec", _lr(f"SELECT j AS i, {_R('sum(exp(-f) * x2)')} AS v1 FROM p GROUP BY j"))
def _rmatvec(spark, sf_dir):
    """The transposed product through the linear operator's own method."""
    left = suppliers(spark, sf_dir).withColumn("c", F.col("x")[1])
    x, y = Vi(left, "x", dim=3), Vj(nations(spark, sf_dir), "y", dim=3)
    kernel = (-x.sqdist(y)).exp()
    return _shown(kernel.rmatvec(Vj(left, "c", row_id="i", dim=1)).withColumnRenamed("j", "i"), 1)


@_query("own_operation", _lr(f"SELECT i, {_R('sum(' + ' + '.join(f'CASE WHEN abs(x{k}-y{k}) <= 0.5::DOUBLE THEN (x{k}-y{k})*(x{k}-y{k}) / 2 ELSE 0.5::DOUBLE * (abs(x{k}-y{k}) - 0.25::DOUBLE) END' for k in (1, 2, 3)) + ')')} AS v1 FROM p GROUP BY i"))
def _own_operation(spark, sf_dir):
    """A Huber loss, registered here: operations of one's own travel with the formula."""
    import numpy as np

    from pairloom.functions import ops

    if "Huber" not in ops.TABLE:
        ops.elementwise("Huber", 1, lambda d: np.where(np.abs(d) <= 0.5, d * d / 2, 0.5 * (np.abs(d) - 0.25)), lambda d: F.when(F.abs(d) <= 0.5, d * d / 2).otherwise(0.5 * (F.abs(d) - 0.25)))
    x, y, _ = _xy(spark, sf_dir)
    return _shown((x - y).op("Huber").sum(-1).sum(axis=1), 1)


@_query("exact_sum", "WITH l AS (SELECT CAST(s_suppkey AS BIGINT) AS i, CASE s_suppkey % 3 WHEN 0 THEN 1 WHEN 1 THEN 2 ELSE 4 END AS x FROM supplier) SELECT i, round(CAST(x * (SELECT sum(CAST(o_totalprice AS DECIMAL(20, 2))) FROM orders) AS DOUBLE), 2) + 0.0::DOUBLE AS v1 FROM l")
def _exact_sum(spark, sf_dir):
    """Prices among numbers of 10^16 that cancel: only sums that keep their rounding errors have the total."""
    huge = (F.lit(1e16) * (1 + F.col("o_orderkey") % 5)).alias("huge")
    terms = table(spark, sf_dir, "orders").select("o_orderkey", F.posexplode(F.array(huge, F.col("o_totalprice").cast("double"), -huge)).alias("k", "y"))
    right = points(terms.withColumn("id", F.col("o_orderkey") * 3 + F.col("k")), "id", {"y": "y"}, "j")
    scale = F.when(F.col("s_suppkey") % 3 == 0, 1.0).when(F.col("s_suppkey") % 3 == 1, 2.0).otherwise(4.0)
    left = points(table(spark, sf_dir, "supplier"), "s_suppkey", {"x": scale}, "i")
    out = PairReduce("x*y", ["x = Vi(1)", "y = Vj(1)"], "Sum", 1, sum_scheme="kahan_scheme").run(left, right, strategy="blocks")
    return components(out, "value", "v", 1, 2)


_SUPPLIER_R = "(SELECT i AS j, x1 AS y1, x2 AS y2, x3 AS y3, x3 + 1 AS b FROM l)"


@_query("kriging_preconditioned", _solved_sql(f"exp(-4 * {_KERNEL_D2})", "b", rows=_SUPPLIER_R))
def _kriging(spark, sf_dir):
    """Kriging weights of all suppliers by the tensor's own solver, with a Nystrom preconditioner."""
    left = suppliers(spark, sf_dir)
    right = left.select(F.col("i").alias("j"), F.col("x").alias("y"), (F.col("x")[2] + 1).alias("b"))
    x, y = Vi(left, "x", dim=3), Vj(right, "y", dim=3)
    return components((-(x.sqdist(y) * 4)).exp().solve("b", alpha=0.1, eps=1e-9, preconditioner="nystrom", landmarks=20), "value", "v", 1, 4)


@_query("gradient_of_solve_points", f"WITH {POINTS_SQL}, a AS ({_solved_sql(f'exp(-{_KERNEL_D2})', 'b', 'm[p][n + 1]')}), z AS ({_solved_sql(f'exp(-{_KERNEL_D2})', 'y1', 'm[p][n + 1]')}) SELECT s.j AS i, " + ", ".join(f"round(sum(2 * z.v1 * a.v1 * (s.y{k} - t.y{k}) * exp(-{_KERNEL_D2})), 4) + 0.0::DOUBLE AS v{k}" for k in (1, 2, 3)) + " FROM r s, r t, a, z WHERE z.j = s.j AND a.j = t.j GROUP BY s.j")
def _gradient_of_solve_points(spark, sf_dir):
    """The gradient of the solution by the points of side i, applied to the first coordinate."""
    left, right = _both_nations(spark, sf_dir)
    out = KernelSolve("Exp(-SqDist(x,y))*b", ALIASES, "b").grad("x", left, right.withColumn("eta", F.col("y")[0]), alpha=0.1, eps=1e-10)
    return components(out, "value", "v", 3, 4)


_PART_SQL = """l AS (SELECT CAST(p_partkey AS BIGINT) AS i, (p_retailprice - 900) / 10::DOUBLE AS x1, p_size::DOUBLE / 5::DOUBLE AS x2, p_size::DOUBLE AS b FROM part)"""
_PART_D2 = "((s.x1-t.x1)*(s.x1-t.x1) + (s.x2-t.x2)*(s.x2-t.x2))"
_PART_ALIASES = ["x = Vi(2)", "y = Vj(2)", "b = Vj(1)"]


def parts(spark: SparkSession, sf_dir: str, as_id: str, name: str) -> DataFrame:
    d = lambda c: F.col(c).cast("double")
    return points(table(spark, sf_dir, "part"), "p_partkey", {name: [(d("p_retailprice") - 900) / 10.0, d("p_size") / 5.0], "b": d("p_size")}, as_id)


def _truncated(formula: str, size: float, spark, sf_dir) -> DataFrame:
    left, right = truncate.cells(parts(spark, sf_dir, "i", "x"), "x", size, 2, "bi"), truncate.cells(parts(spark, sf_dir, "j", "y"), "y", size, 2, "bj")
    out = truncate.truncated_sum(PairReduce(formula, _PART_ALIASES, "Sum", 1), left, right, 1e-12)
    return components(out.withColumn("within", F.col("bound")[0] <= 1e-12), "value", "v", 1, 4).drop("bound")


@_query("truncated_gaussian", f"WITH {_PART_SQL} SELECT s.i, round(sum(exp(-8 * {_PART_D2}) * t.b), 4) + 0.0::DOUBLE AS v1, true AS within FROM l s, l t GROUP BY s.i")
def _truncated_gaussian(spark, sf_dir):
    """Blocks of parts that add less than 1e-12 to a row are not evaluated."""
    return _truncated("Exp(-8*SqDist(x,y))*b", 0.5, spark, sf_dir)


@_query("truncated_laplacian", f"WITH {_PART_SQL} SELECT s.i, round(sum(exp(-12 * sqrt({_PART_D2})) * t.b), 4) + 0.0::DOUBLE AS v1, true AS within FROM l s, l t GROUP BY s.i")
def _truncated_laplacian(spark, sf_dir):
    return _truncated("Exp(-12*Norm2(x-y))*b", 0.5, spark, sf_dir)


def _kept_by_row(spark: SparkSession, stream: DataFrame, by: list[str]) -> DataFrame:
    """What a keyed stream has put out once it has taken all there is, latest row by row."""
    from pairloom.session import work_folder

    folder = work_folder(spark, "keyed")
    keyed.write_changes(stream, folder).trigger(availableNow=True).start().awaitTermination()
    return keyed.latest(spark, folder, by)


@_query("stream_keyed_logsumexp", _lr(f"SELECT CAST(i % 3 AS BIGINT) AS g, i, {_R('ln(sum(exp(-f)))')} AS v1 FROM p WHERE i % 3 = j % 3 GROUP BY i"))
def _stream_keyed(spark, sf_dir):
    """Nations arrive as a stream; each touches the suppliers of its key, whose states Spark keeps by row."""
    raw = spark.readStream.schema(table(spark, sf_dir, "nation").schema).parquet(f"{sf_dir}/nation*.parquet")
    y = [(F.col("n_nationkey") + 1).cast("double") / 26.0, (F.col("n_regionkey") + 1).cast("double") / 6.0, F.length("n_name").cast("double") / 20.0]
    stream = points(raw, "n_nationkey", {"y": y}, "j").withColumn("g", F.col("j") % 3)
    q = PairReduce("-SqDist(x,y)", ALIASES[:2], "LogSumExp", 1)
    found = keyed.keyed_stream(q, suppliers(spark, sf_dir).withColumn("g", F.col("i") % 3), stream, batch=["g"])
    return _shown(_kept_by_row(spark, found, ["g", "i"]), 1)


_EVENT_SQL = """WITH l AS (SELECT CAST(n_nationkey AS BIGINT) AS i, n_nationkey * 4::DOUBLE AS x FROM nation), e AS (SELECT event_id AS j, strftime(ts, '%Y-%m-%d') AS day, value AS y FROM events WHERE ts IS NOT NULL AND value IS NOT NULL AND event_id IS NOT NULL)"""


def _by_day(op: str, formula: str, k: int, spark, sf_dir) -> DataFrame:
    raw = spark.readStream.schema(table(spark, sf_dir, "events").schema).parquet(f"{sf_dir}/events*.parquet")
    stream = points(raw, "event_id", {"y": "value"}, "j", ["ts"])
    left = points(table(spark, sf_dir, "nation"), "n_nationkey", {"x": F.col("n_nationkey") * 4.0}, "i")
    q = PairReduce(formula, ["x = Vi(1)", "y = Vj(1)"], op, 1, k=k)
    found = _kept_by_row(spark, keyed.keyed_stream(q, left, stream, time="ts", window="1 day", delay="1 day"), ["window_start", "window_end", "i"])
    return found.withColumn("day", F.date_format("window_start", "yyyy-MM-dd")).drop("window_start", "window_end")


@_query("stream_windowed_sum", f"{_EVENT_SQL} SELECT i, day, round(sum(exp(-(x-y)*(x-y) / 100::DOUBLE)), {DIGITS}) + 0.0::DOUBLE AS v1 FROM l, e GROUP BY i, day")
def _stream_windowed(spark, sf_dir):
    """Kernel sums over the events of each day, in windows that a watermark closes."""
    return _shown(_by_day("Sum", "Exp(-Square(x-y)/100)", 0, spark, sf_dir), 1)


@_query("stream_windowed_argkmin", f"{_EVENT_SQL}, n AS (SELECT *, row_number() OVER (PARTITION BY i, day ORDER BY abs(x-y), j) AS n FROM l, e) SELECT i, day, " + ", ".join(f"coalesce(min(j) FILTER (n = {k}), 0) AS j{k}" for k in (1, 2, 3)) + " FROM n GROUP BY i, day")
def _stream_nearest(spark, sf_dir):
    """The three nearest events of each day."""
    return _by_day("ArgKMin", "Abs(x-y)", 3, spark, sf_dir).select("i", "day", *(F.col("index")[k].alias(f"j{k + 1}") for k in range(3)))


@_query("sql_pair_reduce", _lr(f"SELECT i, {_R('sum(exp(-f) * b)')} AS v1 FROM p GROUP BY i"))
def _sql_pair_reduce(spark, sf_dir):
    """The formula as text in a SQL statement."""
    suppliers(spark, sf_dir).createOrReplaceTempView("pairloom_suppliers")
    register_pair_reduce(spark, {"nations": nations(spark, sf_dir)})
    return _shown(spark.sql("""SELECT id AS i, value FROM pair_reduce(
        TABLE(SELECT i AS id, x FROM pairloom_suppliers), 'nations', 'Exp(-SqDist(x,y))*b', 'x = Vi(3); y = Vj(3); b = Vj(1)', 'Sum')"""), 1)


@_query("sql_nearest_join", f"WITH {POINTS_SQL}, p AS (SELECT *, {_D2} AS f FROM l, r), n AS (SELECT *, row_number() OVER (PARTITION BY i ORDER BY f, j) AS n FROM p) SELECT n.i, n.n AS place, n_name AS name, round(f, {DIGITS}) + 0.0::DOUBLE AS v1 FROM n JOIN nation ON n_nationkey = n.j WHERE n.n <= 2")
def _sql_nearest_join(spark, sf_dir):
    """A table function of one query within a larger statement: the two nearest nations by name."""
    suppliers(spark, sf_dir).createOrReplaceTempView("pairloom_suppliers")
    table(spark, sf_dir, "nation").createOrReplaceTempView("pairloom_nations")
    register_query(spark, "nearest_nations", PairReduce("SqDist(x,y)", ALIASES[:2], "KMin_ArgKMin", 1, k=2), nations(spark, sf_dir))
    return spark.sql(f"""SELECT t.i, CAST(t.place + 1 AS BIGINT) AS place, n.n_name AS name, round(t.value[t.place], {DIGITS}) + 0.0D AS v1
        FROM (SELECT f.*, posexplode(f.index) AS (place, j) FROM nearest_nations(TABLE(SELECT i, x FROM pairloom_suppliers)) f) t
        JOIN pairloom_nations n ON n.n_nationkey = t.j""")


_COLUMN = lambda b: "(" + _solved_sql(f"exp(-4 * {_KERNEL_D2})", b, "m[p][n + 1]", rows=_SUPPLIER_R) + ")"


@_query("kriging_block", f"WITH {POINTS_SQL}, a AS {_COLUMN('b')}, c AS {_COLUMN('y1')}, d AS {_COLUMN('y2')} SELECT a.j, round(a.v1, 4) + 0.0::DOUBLE AS v1, round(c.v1, 4) + 0.0::DOUBLE AS v2, round(a.v1 - c.v1, 4) + 0.0::DOUBLE AS v3, round(d.v1, 4) + 0.0::DOUBLE AS v4 FROM a JOIN c USING (j) JOIN d USING (j)")
def _kriging_block(spark, sf_dir):
    """Kriging weights of all suppliers for four right-hand sides at once, one of them the difference of two others."""
    left = suppliers(spark, sf_dir)
    third, x1 = F.col("x")[2] + 1, F.col("x")[0]
    right = left.select(F.col("i").alias("j"), F.col("x").alias("y"), F.array(third, x1, third - x1, F.col("x")[1]).alias("b"))
    x, y = Vi(left, "x", dim=3), Vj(right, "y", dim=3)
    return components((-(x.sqdist(y) * 4)).exp().solve("b", alpha=0.1, eps=1e-9, preconditioner="nystrom", landmarks=20), "value", "v", 4, 4)
