"""Formula queries: a formula, variables, a reduction and an axis make a DataFrame function."""

from __future__ import annotations

from pyspark.sql import DataFrame

from pairloom.operators.mirror import reduce_itself
from pairloom.operators.pairs import name_of, reduce_pairs
from pairloom.operators.reductions import EXPONENTIAL, Reduction
from pairloom.plans import diff
from pairloom.plans.expr import PM, VI, VJ, Expr, IntCst, Var, call
from pairloom.plans.parse import parse, parse_alias


class PairReduce:
    """``Sum_j Exp(-SqDist(x_i, y_j)) * b_j`` and the like.

    >>> q = PairReduce("Exp(-SqDist(x,y))*b", ["x = Vi(3)", "y = Vj(3)", "b = Vj(1)"], "Sum", axis=1)
    >>> q.run(left, right)          # i, value

    ``axis=1`` reduces over j and keeps i, ``axis=0`` the other way round.
    ``k`` is the K of the k-lowest reductions, ``formula2`` the weight of the
    exponential ones.  Indices are the ids of the rows, not their places.
    ``enable_chunks``: sums over many components are added up slice by slice.
    """

    def __init__(self, formula: str | Expr, aliases=(), reduction_op: str = "Sum", axis: int = 1, k: int = 0, formula2: str | Expr | None = None, sum_scheme: str = "auto", enable_chunks: bool = True):
        if axis not in (0, 1):
            raise ValueError("axis is 0 or 1")
        self.formula, self.variables = (formula, formula.variables()) if isinstance(formula, Expr) else parse(formula, list(aliases))
        self.weight = None
        if formula2 is not None:
            self.weight, more = (formula2, formula2.variables()) if isinstance(formula2, Expr) else parse(formula2, list(aliases))
            known = {v.key for v in self.variables}
            self.variables = [*self.variables, *(v for v in more if v.key not in known)]
        self.op, self.axis, self.keep = reduction_op, axis, VI if axis == 1 else VJ
        self.k, self.scheme, self.chunks = k, sum_scheme, enable_chunks
        if reduction_op in ("SoftMax", "SumSoftMaxWeight"):
            if self.weight is None:
                raise ValueError("a soft-max sum needs weights (formula2)")
            self.weight = call("Concat", IntCst(1), self.weight)
        self.reduction = Reduction.of(reduction_op, self.formula.dim, k, self.weight.dim if self.weight is not None else 1, sum_scheme)
        if self.weight is not None and self.reduction.name not in EXPONENTIAL:
            raise ValueError(f"{reduction_op} takes no second formula")
        if self.reduction.name == "Sum" and str(self.formula).startswith("Zero("):
            self.reduction = Reduction.of("Zero", self.formula.dim)

    def run(self, left: DataFrame, right: DataFrame, params: dict | DataFrame | None = None, ranges: DataFrame | None = None, batch: list[str] = (), left_id: str = "i", right_id: str = "j", strategy: str = "auto", params_key: str | None = None) -> DataFrame:
        """``params``: values by name, or a table of sets of values named by its column ``params_key``."""
        return reduce_pairs(self.formula, self.reduction, left, right, self.keep, self.weight, params, left_id, right_id, list(batch), ranges, strategy, params_key, self.chunks)

    __call__ = run

    def run_itself(self, rows: DataFrame, columns: dict[str, str], params: dict | None = None, row_id: str = "i", digits: int | None = None) -> DataFrame:
        """Every row of a table with every row of it; ``columns`` names the column that each Vi and Vj is read from.

        Of a kernel that is the same both ways, each pair of rows is computed once.
        ``digits``: values are going to be rounded to so many digits.
        """
        return reduce_itself(self.formula, self.reduction, rows, columns, self.keep, self.weight, params, row_id, self.chunks, digits)

    def transposed(self) -> PairReduce:
        """The query with the roles of i and j exchanged."""
        return self._like(transpose(self.formula), transpose(self.weight) if self.weight is not None else None)

    def _like(self, formula: Expr, weight: Expr | None = None, op: str | None = None, axis: int | None = None) -> PairReduce:
        out = object.__new__(PairReduce)
        out.__dict__ |= self.__dict__
        out.formula, out.weight = formula, weight
        out.variables = list({v.key: v for e in (formula, weight) if e is not None for v in e.variables()}.values())
        out.op, out.axis = op or self.op, self.axis if axis is None else axis
        out.keep = VI if out.axis == 1 else VJ
        out.reduction = Reduction.of(out.op, formula.dim, self.k, weight.dim if weight is not None else 1, self.scheme)
        return out

    def grad(self, v: str | Var, e: str = "eta", saved: str = "saved") -> PairReduce:
        """The gradient by a variable, as another query.

        For a sum, column ``e`` of the kept side has the vector the gradient is
        applied to.  For a log-sum-exp the kept side also has its own result in
        column ``saved``.  Reductions to indices have zero gradients; minima and
        maxima have none.  The gradient by a parameter keeps this query's side:
        its rows still have to be summed.
        """
        v = next(x for x in self.variables if name_of(x) == v) if isinstance(v, str) else v
        keep_axis = {VI: 1, VJ: 0, PM: self.axis}[v.cat]
        name = self.reduction.name
        if name.startswith("Arg") or name == "Zero":
            out = self._like(self.formula, None, "Sum", keep_axis)
            out.reduction = Reduction.of("Zero", v.dim)
            return out
        fresh = 1 + max((x.ind for x in self.variables), default=0)
        if name == "Sum":
            eta = Var(fresh, self.formula.dim, self.keep, e)
            g = diff.gradient(self.formula, v, eta)
        elif name in ("LogSumExp", "LogSumExpWeight"):
            eta, own = Var(fresh, self.reduction.weight_dim, self.keep, e), Var(fresh + 1, self.reduction.weight_dim, self.keep, saved)
            share = call("Exp", self.formula - own)  # exp(F) over the sum that the saved logarithm is of
            w = self.weight if self.weight is not None else IntCst(1)
            g = diff.gradient(self.formula, v, call("Sum", eta * share * w)) + diff.gradient(w, v, eta * share)
        else:
            raise NotImplementedError(f"{name} has no gradient")
        out = self._like(g, None, "Sum", keep_axis)
        if str(g).startswith("Zero("):
            out.reduction = Reduction.of("Zero", v.dim)
        return out


    def diff(self, v: str | Var, u: str = "u", saved: str = "saved") -> PairReduce:
        """The directional derivative by a variable, along column ``u`` of that variable's side.

        A log-sum-exp also needs its own result in column ``saved`` of the kept side.
        """
        v = next(x for x in self.variables if name_of(x) == v) if isinstance(v, str) else v
        name = self.reduction.name
        fresh = 1 + max((x.ind for x in self.variables), default=0)
        way = Var(fresh, v.dim, v.cat, u)
        if name.startswith("Arg") or name == "Zero":
            out = self._like(self.formula, None, "Sum")
            out.reduction = Reduction.of("Zero", self.formula.dim)
            return out
        d = diff.differential(self.formula, v, way)
        if name in ("LogSumExp", "LogSumExpWeight"):
            own = Var(fresh + 1, self.reduction.weight_dim, self.keep, saved)
            w = self.weight if self.weight is not None else IntCst(1)
            d = call("Exp", self.formula - own) * (w * d + diff.differential(w, v, way))
        elif name != "Sum":
            raise NotImplementedError(f"{name} has no derivative")
        out = self._like(d, None, "Sum")
        if str(d).startswith("Zero("):
            out.reduction = Reduction.of("Zero", d.dim)
        return out


def transpose(e: Expr) -> Expr:
    """The formula with categories Vi and Vj exchanged."""
    if isinstance(e, Var):
        return Var(e.ind, e.dim, {VI: VJ, VJ: VI, PM: PM}[e.cat], e.name)
    if not e.children:
        return e
    return call(e.name, *map(transpose, e.children), params=e.params)


def _generic(op: str, output: str, formulas: list[str], aliases: tuple[str, ...], **more) -> PairReduce:
    out = parse_alias(output, 0)
    return PairReduce(formulas[0], list(aliases), op, axis=1 if out.cat == VI else 0, formula2=formulas[1] if len(formulas) > 1 else None, **more)


def generic_sum(formula: str, output: str, *aliases: str) -> PairReduce:
    """The side that survives is that of ``output``, such as ``a = Vi(1)``."""
    return _generic("Sum", output, [formula], aliases)


def generic_logsumexp(formula: str, output: str, *aliases: str) -> PairReduce:
    return _generic("LogSumExp", output, [formula], aliases)


def generic_argmin(formula: str, output: str, *aliases: str) -> PairReduce:
    return _generic("ArgMin", output, [formula], aliases)


def generic_argkmin(formula: str, output: str, *aliases: str) -> PairReduce:
    """K is the length of ``output``."""
    return _generic("ArgKMin", output, [formula], aliases, k=parse_alias(output, 0).dim)
