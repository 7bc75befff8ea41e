"""Symbolic tensors: expressions over the rows i and j of two tables, reduced on demand.

    x, y = Vi(points, "x"), Vj(points, "x")
    K = (-((x - y) ** 2).sum(-1)).exp()
    K.sum(axis=1)       # a DataFrame: i, value
    K @ Vj(points, "b")
"""

from __future__ import annotations

from itertools import count

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from pairloom.genred import PairReduce, transpose
from pairloom.operators.cluster import swap_axes
from pairloom.plans import diff
from pairloom.plans.expr import PM, VI, VJ, Expr, IntCst, Var, call, lift, power

_fresh = count()


class SymTensor:
    """An expression with the tables and parameters that its variables stand for.

    ``tables`` maps VI and VJ to (DataFrame, id column, batch keys, block column).
    Variables are named by column, so a side has one table.
    """

    def __init__(self, expr: Expr, tables: dict | None = None, params: dict | None = None, ranges: DataFrame | None = None):
        self.expr, self.tables, self.params, self.ranges = expr, tables or {}, params or {}, ranges

    # -- metadata ----------------------------------------------------------
    @property
    def dim(self) -> int:
        return self.expr.dim

    @property
    def shape(self) -> tuple:
        """(batch keys..., rows i or 1, rows j or 1[, length if over 1]); counts the tables."""
        keys = self.batch
        rows = tuple(self.tables[c][0].count() if c in self.tables else 1 for c in (VI, VJ))
        return (*keys, *rows, *((self.dim,) if self.dim > 1 else ()))

    @property
    def batch(self) -> list[str]:
        return list(dict.fromkeys(k for c in (VI, VJ) if c in self.tables for k in self.tables[c][2]))

    @property
    def nbatchdims(self) -> int:
        return len(self.batch)

    def __str__(self):
        return str(self.expr)

    # -- joining expressions -----------------------------------------------
    def promote(self, other) -> SymTensor:
        if isinstance(other, SymTensor):
            return other
        if isinstance(other, DataFrame):
            raise TypeError("wrap a DataFrame with Vi or Vj; a reduced tensor takes no part in formulas")
        if isinstance(other, (list, tuple)):
            return Pm(other)
        return SymTensor(lift(other))

    def _with(self, expr: Expr, *others: SymTensor) -> SymTensor:
        tables, params, ranges = dict(self.tables), dict(self.params), self.ranges
        for o in others:
            for c, t in o.tables.items():
                if c in tables and tables[c][0] is not t[0]:
                    raise ValueError("one table for each side: join the columns first")
                tables[c] = t
            params |= o.params
            ranges = ranges if ranges is not None else o.ranges
        return SymTensor(expr, tables, params, ranges)

    def op(self, name: str, *others, params: tuple = ()) -> SymTensor:
        others = [self.promote(o) for o in others]
        return self._with(call(name, self.expr, *(o.expr for o in others), params=params), *others)

    def with_ranges(self, ranges: DataFrame) -> SymTensor:
        """Only blocks (bi, bj) listed meet; the tables have columns bi and bj."""
        return SymTensor(self.expr, self.tables, self.params, ranges)

    # -- arithmetic ------------------------------------------------------------
    def __add__(self, o):
        return self.op("Add", o)

    def __radd__(self, o):
        return self.promote(o).op("Add", self)

    def __sub__(self, o):
        return self.op("Subtract", o)

    def __rsub__(self, o):
        return self.promote(o).op("Subtract", self)

    def __mul__(self, o):
        return self.op("Mult", o)

    def __rmul__(self, o):
        return self.promote(o).op("Mult", self)

    def __truediv__(self, o):
        return self.op("Divide", o)

    def __rtruediv__(self, o):
        return self.promote(o).op("Divide", self)

    def __or__(self, o):
        return self.op("Scalprod", o)

    def __ror__(self, o):
        return self.promote(o).op("Scalprod", self)

    def __abs__(self):
        return self.op("Abs")

    def __neg__(self):
        return self.op("Minus")

    def __pow__(self, o):
        if isinstance(o, (int, float)):
            return self._with(power(self.expr, o))
        return self.op("Powf", o)

    def __eq__(self, o):
        return self.op("Equal", o)

    def __ne__(self, o):
        return self.op("NotEqual", o)

    def __lt__(self, o):
        return self.op("LessThan", o)

    def __gt__(self, o):
        return self.promote(o).op("LessThan", self)

    def __le__(self, o):
        return self.op("LessOrEqual", o)

    def __ge__(self, o):
        return self.promote(o).op("LessOrEqual", self)

    __hash__ = object.__hash__

    # -- functions with numbers as parameters -----------------------------------
    def power(self, o):
        return self**o

    def sinc(self):
        """sin(pi x) / (pi x)."""
        import math

        return (self * math.pi).sinxdivx()

    def clamp(self, a, b):
        return self.op("ClampInt", params=(a, b)) if isinstance(a, int) and isinstance(b, int) else self.op("Clamp", a, b)

    def clampint(self, a: int, b: int):
        return self.op("ClampInt", params=(a, b))

    def mod(self, n, d=0):
        return self.op("Mod", n, d)

    def round(self, d: int = 0):
        return self.op("Round", params=(d,))

    def elem(self, m: int):
        return self.op("Elem", params=(m,))

    def elemT(self, n: int, m: int):
        return self.op("ElemT", params=(n, m))

    def extract(self, start: int, dim: int):
        return self.op("Extract", params=(start, dim))

    def extractT(self, start: int, dim: int):
        return self.op("ExtractT", params=(start, dim))

    def __getitem__(self, key):
        if isinstance(key, tuple):
            *rest, key = key
            if any(k not in (Ellipsis, slice(None)) for k in rest):
                raise ValueError("only the last axis can be indexed")
        if isinstance(key, slice):
            start, stop, step = key.indices(self.dim)
            if step != 1:
                raise ValueError("slices have step 1")
            return self.extract(start, stop - start)
        return self.elem(key % self.dim)

    def one_hot(self, d: int):
        return self.op("OneHot", params=(d,))

    def bspline(self, x, k: int = 0):
        return self.op("BSpline", x, params=(k,))

    def concat(self, o):
        return self.op("Concat", o)

    @staticmethod
    def cat(tensors, axis: int = -1):
        if axis != -1:
            raise ValueError("only the last axis can be joined")
        out = tensors[0]
        for t in tensors[1:]:
            out = out.concat(t)
        return out

    concatenate = cat


    def tensordot(self, o, da, db, ca, cb, perm=()):
        return self.op("TensorDot", o, params=tuple(map(tuple, (da, db, ca, cb, perm))))

    def kron(self, o, da, db):
        return self.op("Kron", o, params=(tuple(da), tuple(db)))

    def norm(self, p: int = 2):
        if p != 2:
            raise ValueError("norms have p = 2")
        return self.op("Norm2")

    def weightedsqnorm(self, s):
        return self.promote(s).op("WeightedSqNorm", self)

    def weightedsqdist(self, g, s):
        return self.promote(s).op("WeightedSqDist", self, g)

    # -- calculus ---------------------------------------------------------------
    def _v(self, v: SymTensor) -> Var:
        if not isinstance(v.expr, Var):
            raise ValueError("a derivative is by a variable")
        return v.expr

    def grad(self, v, e=1):
        e = self.promote(e)
        return self._with(diff.gradient(self.expr, self._v(v), e.expr), v, e)

    def diff(self, v, u):
        u = self.promote(u)
        return self._with(diff.differential(self.expr, self._v(v), u.expr), v, u)

    def grad_matrix(self, v):
        return self._with(diff.gradient_matrix(self.expr, self._v(v)), v)

    def trace_operator(self, v, w=None):
        w = None if w is None else self.promote(w)
        return self._with(diff.trace_operator(self.expr, self._v(v), None if w is None else w.expr), v, *([] if w is None else [w]))

    def adjoint_operator(self, v, u):
        return self._with(diff.adjoint_operator(self.expr, self._v(v), self.promote(u).expr), v)

    def sum_operator(self, v, wl=None, wr=None):
        """Sum of the entries of the linear map of ``v``, with weights of its rows and columns."""
        wl, wr = (None if w is None else self.promote(w) for w in (wl, wr))
        expr = diff.sum_operator(self.expr, self._v(v), *(None if w is None else w.expr for w in (wl, wr)))
        return self._with(expr, v, *(w for w in (wl, wr) if w is not None))

    def divergence(self, v):
        return self._with(diff.divergence(self.expr, self._v(v)), v)

    def laplacian(self, v):
        return self._with(diff.laplacian(self.expr, self._v(v)), v)

    def factorize(self, part: SymTensor):
        """The same tensor; ``part``, which must occur in it, is evaluated once, as all that occurs twice is."""
        if not self.expr.contains(part.expr):
            raise ValueError("not a part of the tensor")
        return self

    def auto_factorize(self):
        return self

    # -- linear operators ----------------------------------------------------------
    def t(self) -> SymTensor:
        swap = {VI: VJ, VJ: VI}
        tables = {swap[c]: t for c, t in self.tables.items()}
        ranges = self.ranges
        if ranges is not None:  # blocks change their side with the rows
            ranges = swap_axes(ranges)
            for c, old, new in ((VI, "bj", "bi"), (VJ, "bi", "bj")):
                df, *rest = tables[c]
                tables[c] = (df.withColumnRenamed(old, new), *rest)
        return SymTensor(transpose(self.expr), tables, self.params, ranges)

    @property
    def T(self) -> SymTensor:
        return self.t()

    def __matmul__(self, v: SymTensor) -> DataFrame:
        if self.dim != 1:
            raise ValueError("a matrix of vectors has no product with a vector")
        return (self * v).sum(axis=1)

    matvec = __matmul__

    def rmatvec(self, v: SymTensor) -> DataFrame:
        return self.t() @ v

    def solve(self, b: str, alpha: float = 1e-10, eps: float = 1e-6, max_iterations: int = 500, preconditioner: str | None = None, landmarks: int = 100) -> DataFrame:
        """a with (K + alpha) a = b, where b is a column of the j table; K symmetric positive; preconditioners as ``operators.solve`` has them."""
        from pairloom.operators.solve import solve

        table = self.tables[VJ]
        return solve(self, table[0], table[1], b, alpha, eps, max_iterations, preconditioner, landmarks)

    # -- reductions ------------------------------------------------------------------
    def reduction(self, op: str, axis: int, k: int = 0, weight: SymTensor | None = None, strategy: str = "auto", sum_scheme: str = "auto") -> DataFrame:
        if axis not in (0, 1):
            raise ValueError("reductions run over axis 0 (i) or 1 (j)")
        whole = self._with(self.expr, weight) if weight is not None else self
        query = PairReduce(self.expr, (), op, axis, k, weight.expr if weight is not None else None, sum_scheme)
        sides = []
        for c, name in ((VI, "i"), (VJ, "j")):
            if c in whole.tables:
                sides.append(whole.tables[c][:2])
            else:  # no variable of this side: one row
                spark = next(iter(whole.tables.values()))[0].sparkSession
                sides.append((spark.range(1).select(F.col("id").alias(name)), name))
        return query.run(sides[0][0], sides[1][0], whole.params, whole.ranges, whole.batch, sides[0][1], sides[1][1], strategy)

    def sum(self, axis: int = -1, **more):
        return self.op("Sum") if axis == -1 else self.reduction("Sum", axis, **more)

    def _vector_or(self, name: str, op: str, axis: int, **more):
        return self.op(name) if axis == -1 else self.reduction(op, axis, **more)

    def min(self, axis: int = -1, **more):
        return self._vector_or("Min", "Min", axis, **more)

    def max(self, axis: int = -1, **more):
        return self._vector_or("Max", "Max", axis, **more)

    def argmin(self, axis: int = -1, **more):
        return self._vector_or("ArgMin", "ArgMin", axis, **more)

    def argmax(self, axis: int = -1, **more):
        return self._vector_or("ArgMax", "ArgMax", axis, **more)

    def min_argmin(self, axis: int, **more):
        return self.reduction("Min_ArgMin", axis, **more)

    def max_argmax(self, axis: int, **more):
        return self.reduction("Max_ArgMax", axis, **more)

    def Kmin(self, K: int, axis: int, **more):
        return self.reduction("KMin", axis, k=K, **more)

    def argKmin(self, K: int, axis: int, **more):
        return self.reduction("ArgKMin", axis, k=K, **more)

    def Kmin_argKmin(self, K: int, axis: int, **more):
        return self.reduction("KMin_ArgKMin", axis, k=K, **more)

    def logsumexp(self, axis: int, weight=None, **more):
        return self.reduction("LogSumExp" if weight is None else "LogSumExpWeight", axis, weight=None if weight is None else self.promote(weight), **more)

    def sumsoftmaxweight(self, weight, axis: int, **more):
        return self.reduction("SumSoftMaxWeight", axis, weight=self.promote(weight), **more)

    def max_sumshiftexp(self, axis: int, weight=None, **more):
        return self.reduction("Max_SumShiftExpWeight", axis, weight=None if weight is None else self.promote(weight), **more)


def _plain(name: str, n: int):
    def method(self, *others):
        if len(others) != n:
            raise TypeError(f"{name} takes {n} arguments")
        return self.op(name, *others)

    return method


for _method, _name, _n in [
    ("abs", "Abs", 0), ("exp", "Exp", 0), ("log", "Log", 0), ("xlogx", "XLogX", 0), ("cos", "Cos", 0), ("sin", "Sin", 0), ("sinxdivx", "SinXDivX", 0),
    ("asin", "Asin", 0), ("acos", "Acos", 0), ("atan", "Atan", 0), ("atan2", "Atan2", 1), ("sqrt", "Sqrt", 0), ("rsqrt", "Rsqrt", 0), ("inv", "Inv", 0),
    ("square", "Square", 0), ("sign", "Sign", 0), ("step", "Step", 0), ("relu", "ReLU", 0), ("floor", "Floor", 0), ("ifelse", "IfElse", 2),
    ("sqnorm2", "SqNorm2", 0), ("norm2", "Norm2", 0), ("normalize", "Normalize", 0), ("sqdist", "SqDist", 1), ("matvecmult", "MatVecMult", 1),
    ("vecmatmult", "VecMatMult", 1), ("tensorprod", "TensorProd", 1), ("softdtw_sqdist", "SoftDTW_SqDist", 2),
]:
    setattr(SymTensor, _method, _plain(_name, _n))

for _op in ("sum", "min", "max", "argmin", "argmax", "min_argmin", "max_argmax", "Kmin", "argKmin", "Kmin_argKmin", "logsumexp", "sumsoftmaxweight"):
    setattr(SymTensor, f"{_op}_reduction", getattr(SymTensor, _op))


class ComplexSymTensor(SymTensor):
    """Complex vectors as interleaved real ones (re, im, re, im ...)."""

    def _with(self, expr, *others):
        base = super()._with(expr, *others)
        return ComplexSymTensor(base.expr, base.tables, base.params, base.ranges)

    def _complex(self, o) -> SymTensor:
        o = self.promote(o)
        return o if isinstance(o, ComplexSymTensor) else o.op("Real2Complex")

    def _real(self, name: str) -> SymTensor:
        return SymTensor(call(name, self.expr), self.tables, self.params, self.ranges)

    @property
    def real(self):
        return self._real("ComplexReal")

    @property
    def imag(self):
        return self._real("ComplexImag")

    def angle(self):
        return self._real("ComplexAngle")

    def abs(self):
        return self._real("ComplexAbs")

    __abs__ = abs

    def squareabs(self):
        return self._real("ComplexSquareAbs")

    def conj(self):
        return self.op("Conj")

    def exp(self):
        return self.op("ComplexExp")

    def __add__(self, o):
        return self.op("ComplexAdd", self._complex(o))

    __radd__ = __add__

    def __sub__(self, o):
        return self.op("ComplexSubtract", self._complex(o))

    def __rsub__(self, o):
        return ComplexSymTensor.op(as_complex(self._complex(o)), "ComplexSubtract", self)

    def __mul__(self, o):
        o = self.promote(o)
        if not isinstance(o, ComplexSymTensor) and o.dim == 1:
            return self._with(call("ComplexRealScal", o.expr, self.expr), o)
        return self.op("ComplexMult", self._complex(o))

    __rmul__ = __mul__

    def __truediv__(self, o):
        return self.op("ComplexDivide", self._complex(o))

    def __neg__(self):
        return self.op("Minus")

    def sum(self, axis: int = -1, **more):
        return self.op("ComplexSum") if axis == -1 else self.reduction("Sum", axis, **more)


def as_complex(t: SymTensor) -> ComplexSymTensor:
    return ComplexSymTensor(t.expr, t.tables, t.params, t.ranges)


for _method, _name in (("real2complex", "Real2Complex"), ("imag2complex", "Imag2Complex"), ("exp1j", "ComplexExp1j")):
    setattr(SymTensor, _method, lambda self, _name=_name: as_complex(self.op(_name)))


def real2complex(t: SymTensor) -> ComplexSymTensor:
    return as_complex(t.op("Real2Complex"))


def exp1j(t: SymTensor) -> ComplexSymTensor:
    return as_complex(t.op("ComplexExp1j"))


def _side(cat: int, df: DataFrame, column: str, row_id: str, dim: int | None, batch: list[str]) -> SymTensor:
    if dim is None:
        kind = df.schema[column].dataType.typeName()
        if kind != "array":
            dim = 1
        else:
            first = df.select(F.size(column)).first()
            if first is None:
                raise ValueError(f"the length of {column} can't be read from an empty table: give dim")
            dim = first[0]
    return SymTensor(Var(next(_fresh), dim, cat, column), {cat: (df, row_id, list(batch))})


def Vi(df: DataFrame, column: str, row_id: str = "i", dim: int | None = None, batch: list[str] = ()) -> SymTensor:
    return _side(VI, df, column, row_id, dim, batch)


def Vj(df: DataFrame, column: str, row_id: str = "j", dim: int | None = None, batch: list[str] = ()) -> SymTensor:
    return _side(VJ, df, column, row_id, dim, batch)


def Pm(value) -> SymTensor:
    """A parameter vector; an integer stays exact."""
    if isinstance(value, int):
        return SymTensor(IntCst(value))
    vector = [float(value)] if isinstance(value, float) else [float(x) for x in value]
    n = next(_fresh)
    name = f"p{n}"
    return SymTensor(Var(n, len(vector), PM, name), {}, {name: vector})


