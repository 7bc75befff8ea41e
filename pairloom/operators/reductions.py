"""Reductions over pairs: a block kernel, a mergeable partial, and its SQL merge.

Every reduction is a commutative monoid.  ``Kernel.update`` folds a block of
values into the state of some rows; ``partial`` gives one struct for each row;
``merge`` combines structs of one row with built-in aggregates, so partial
states of different tasks meet in an ordinary hash aggregate; ``finish`` turns
the merged struct into the result columns.

Ties go to the lowest index; NaN is ignored by minima and maxima; without any
pair, sums are 0, minima +inf, maxima -inf and indices 0; K beyond the number
of pairs is padded with +inf and index 0.  A -inf term of a log-sum-exp weighs
nothing, and without terms its value is -inf.
"""

from __future__ import annotations

from dataclasses import dataclass

import numpy as np
from pyspark.sql import Column
from pyspark.sql import functions as F

INF = float("inf")


def two_sum(a: np.ndarray, b: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """The rounded sum and what rounding took from it, exactly."""
    s = a + b
    back = s - a
    return s, (a - (s - back)) + (b - back)


def compensated(f: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """Sum over axis 1 and the sum of its rounding errors, by halves."""
    lost = np.zeros((f.shape[0], *f.shape[2:]))
    while f.shape[1] > 1:
        half = f.shape[1] // 2
        s, e = two_sum(f[:, :half], f[:, half : 2 * half])
        lost += e.sum(1)
        f = np.concatenate([s, f[:, 2 * half :]], 1) if f.shape[1] % 2 else s
    return (f[:, 0] if f.shape[1] else np.zeros_like(lost)), lost

#: other names of reductions
ALIASES = {
    "SoftMax": "SumSoftMaxWeight", "Max_SumShiftExp": "Max_SumShiftExpWeight", "LogSumExpVect": "LogSumExpWeight",
}
VALUE_ARG = {"Min": (1, True, False), "Max": (-1, True, False), "ArgMin": (1, False, True), "ArgMax": (-1, False, True),
             "Min_ArgMin": (1, True, True), "Max_ArgMax": (-1, True, True)}
K_LOWEST = {"KMin": (True, False), "ArgKMin": (False, True), "KMin_ArgKMin": (True, True)}
EXPONENTIAL = ("Max_SumShiftExpWeight", "LogSumExp", "LogSumExpWeight", "SumSoftMaxWeight")
NAMES = ("Sum", "Zero", *VALUE_ARG, *K_LOWEST, *EXPONENTIAL, "Max_SumShiftExp")


@dataclass(frozen=True)
class Reduction:
    name: str
    dim: int  # of the formula
    k: int = 0
    weight_dim: int = 1  # of the second formula
    scheme: str = "auto"

    @classmethod
    def of(cls, name: str, dim: int, k: int = 0, weight_dim: int = 1, scheme: str = "auto") -> Reduction:
        name = ALIASES.get(name, name)
        if name not in NAMES:
            raise ValueError(f"unknown reduction {name}")
        if name in K_LOWEST and k < 1:
            raise ValueError(f"{name} needs a positive K")
        if name in EXPONENTIAL and dim != 1:
            raise ValueError(f"{name} takes a scalar exponent")
        if scheme not in ("auto", "direct_sum", "block_sum", "kahan_scheme"):
            raise ValueError(f"unknown sum scheme {scheme}")
        if scheme == "kahan_scheme" and name != "Sum":
            raise ValueError("kahan_scheme is for sums")
        return cls(name, dim, k, weight_dim, scheme)

    @property
    def exact(self) -> bool:
        """Whether sums carry their rounding errors: states are sums, then errors, and merge exactly."""
        return self.scheme == "kahan_scheme" and self.name == "Sum"

    # -- block kernel ------------------------------------------------------
    def start(self, rows: int) -> tuple[np.ndarray, ...]:
        shape = (rows, self.dim)
        if self.name == "Sum":
            return np.zeros(shape), np.zeros(shape)
        if self.name in VALUE_ARG:
            return np.full(shape, INF), np.zeros(shape, np.int64)
        if self.name in K_LOWEST:
            return np.full((*shape, self.k), INF), np.zeros((*shape, self.k), np.int64)
        return np.full((rows, 1), -INF), np.zeros((rows, self.weight_dim))

    def update(self, state, f: np.ndarray, ids: np.ndarray, g: np.ndarray | None):
        """``f``: (rows, columns, dim), columns in ascending order of ``ids``."""
        with np.errstate(all="ignore"):
            if self.name == "Sum":
                total, lost = state
                if not self.exact:
                    return total + f.sum(1), lost
                part, errors = compensated(f)
                total, e = two_sum(total, part)
                return total, lost + np.where(np.isfinite(total), errors + e, 0.0)
            if self.name in VALUE_ARG:
                f = VALUE_ARG[self.name][0] * f
                f = np.where(np.isnan(f), INF, f)
                at = f.argmin(1)
                low = np.take_along_axis(f, at[:, None], 1)[:, 0]
                v, i = state
                j = ids[at]
                better = (low < v) | ((low == v) & (low < INF) & (j < i))
                return np.where(better, low, v), np.where(better, j, i)
            if self.name in K_LOWEST:
                f = np.where(np.isnan(f), INF, f).transpose(0, 2, 1)
                v, i = state
                if f.shape[-1] > 4 * self.k:  # only what can be among the lowest, ties with the last included by index
                    edge = np.partition(f, self.k - 1, -1)[..., self.k - 1 : self.k]
                    order = np.argsort(np.where(f <= edge, f, INF), -1, kind="stable")[..., : self.k]
                else:
                    order = np.argsort(f, -1, kind="stable")[..., : self.k]
                low = np.take_along_axis(f, order, -1)
                v = np.concatenate([v, low], -1)
                i = np.concatenate([i, np.where(low < INF, ids[order], 0)], -1)
                order = np.lexsort((np.where(v < INF, i, np.iinfo(np.int64).max), v), axis=-1)[..., : self.k]
                return np.take_along_axis(v, order, -1), np.take_along_axis(i, order, -1)
            m, s = state
            f = f[..., 0]
            top = np.maximum(m[:, 0], np.fmax.reduce(f, 1))
            at = np.where(np.isfinite(top), top, 0.0)
            w = np.exp(f - at[:, None])
            if g is None:
                part = w.sum(1, keepdims=True)
            else:  # weights that do not depend on the row: a matrix product
                part = w @ g[0] if len(g) == 1 else np.einsum("mn,mnd->md", w, np.broadcast_to(g, (*w.shape, g.shape[-1])))
            return top[:, None], s * np.exp(np.where(np.isfinite(m), m - at[:, None], -INF)) + part

    def combine(self, a, b):
        """The states of the same rows after what either has seen."""
        with np.errstate(all="ignore"):
            if self.name == "Sum":
                total, lost = two_sum(a[0], b[0])
                return total, a[1] + b[1] + np.where(np.isfinite(total), lost, 0.0)
            if self.name in VALUE_ARG:
                better = (b[0] < a[0]) | ((b[0] == a[0]) & (b[0] < INF) & (b[1] < a[1]))
                return np.where(better, b[0], a[0]), np.where(better, b[1], a[1])
            if self.name in K_LOWEST:
                v, i = np.concatenate([a[0], b[0]], -1), np.concatenate([a[1], b[1]], -1)
                order = np.lexsort((np.where(v < INF, i, np.iinfo(np.int64).max), v), axis=-1)[..., : self.k]
                return np.take_along_axis(v, order, -1), np.take_along_axis(i, order, -1)
            top = np.maximum(a[0], b[0])
            at = np.where(np.isfinite(top), top, 0.0)
            scaled = [s * np.exp(np.where(np.isfinite(m), m - at, -INF)) for m, s in (a, b)]
            return top, scaled[0] + scaled[1]

    def result(self, state) -> dict[str, np.ndarray]:
        """``value`` and/or ``index`` of complete states, flat over components: what ``finish`` is for columns."""
        with np.errstate(all="ignore"):
            if self.name == "Sum":
                return {"value": state[0] + state[1] if self.exact else state[0]}
            if self.name in VALUE_ARG or self.name in K_LOWEST:
                sign, value, index = (1, *K_LOWEST[self.name]) if self.name in K_LOWEST else VALUE_ARG[self.name]
                v, i = (x.reshape(len(x), self.dim * (self.k or 1)) for x in state)
                return ({"value": sign * v} if value else {}) | ({"index": i} if index else {})
            m, s = state
            if self.name == "Max_SumShiftExpWeight":
                return {"value": np.concatenate([m, s], 1)}
            if self.name in ("LogSumExp", "LogSumExpWeight"):
                return {"value": np.where(m == -INF, m, m + np.log(s))}
            return {"value": np.where(s[:, :1] == 0, np.nan, s[:, 1:] / s[:, :1])}

    # -- partial states as columns ---------------------------------------------
    @property
    def partial_type(self) -> str:
        if self.name == "Sum":
            return "array<double>"
        if self.name in VALUE_ARG or self.name in K_LOWEST:
            return "array<array<struct<v:double,i:bigint>>>"
        return "struct<m:double,s:array<double>>"

    def partial(self, state) -> list:
        if self.name == "Sum":
            return (np.concatenate(state, 1) if self.exact else state[0]).tolist()
        if self.name in VALUE_ARG:
            state = tuple(x[..., None] for x in state)
        if self.name in VALUE_ARG or self.name in K_LOWEST:
            return [
                [[{"v": a, "i": b} for a, b in zip(v, i, strict=True) if a < INF] for v, i in zip(vs, js, strict=True)]
                for vs, js in zip(state[0].tolist(), state[1].tolist(), strict=True)
            ]
        return [{"m": m[0], "s": s} for m, s in zip(state[0].tolist(), state[1].tolist(), strict=True)]

    def merge(self, p: str) -> Column:
        """Aggregate of partial column ``p``: partial states of one row combined."""
        c = F.col(p)
        if self.name == "Sum":
            return F.array(*(F.sum(c[d]) for d in range(self.dim * (1 + self.exact))))
        if self.name in VALUE_ARG:
            return F.array(*(F.array_compact(F.array(F.min(F.get(c[d], F.lit(0))))) for d in range(self.dim)))
        if self.name in K_LOWEST:
            each = F.collect_list(p)
            component = lambda d: F.transform(each, lambda x: x[d])
            return F.array(*(F.slice(F.array_sort(F.flatten(component(d))), 1, self.k) for d in range(self.dim)))
        states = F.collect_list(p)
        top = F.max(c["m"])
        scale = lambda x: F.when(x["m"] == F.lit(-INF), F.lit(0.0)).otherwise(F.exp(x["m"] - top))
        add = lambda acc, x: F.zip_with(acc, x["s"], lambda a, b: a + b * scale(x))
        return F.struct(top.alias("m"), F.aggregate(states, F.array_repeat(F.lit(0.0), self.weight_dim), add).alias("s"))

    def neutral(self) -> Column:
        """The partial state of a row without pairs."""
        if self.name == "Sum":
            return F.array_repeat(F.lit(0.0), self.dim * (1 + self.exact))
        if self.name in VALUE_ARG or self.name in K_LOWEST:
            return F.array_repeat(F.array().cast("array<struct<v:double,i:bigint>>"), self.dim)
        return F.struct(F.lit(-INF).alias("m"), F.array_repeat(F.lit(0.0), self.weight_dim).alias("s"))

    def finish(self, p: str) -> dict[str, Column]:
        """Result columns from the merged partial: ``value`` and/or ``index``, flat over components."""
        c = F.col(p)
        if self.name == "Sum":
            return {"value": F.array(*(c[d] + c[self.dim + d] for d in range(self.dim))) if self.exact else c}
        if self.name in VALUE_ARG or self.name in K_LOWEST:
            k = self.k or 1
            sign, value, index = (1, *K_LOWEST[self.name]) if self.name in K_LOWEST else VALUE_ARG[self.name]
            flat = lambda f: F.flatten(F.transform(c, f))
            pad = lambda x, by: F.concat(x, F.array_repeat(by, k - F.size(x)))
            out = {}
            if value:
                out["value"] = flat(lambda x: pad(F.transform(x, lambda y: sign * y["v"]), F.lit(sign * INF)))
            if index:
                out["index"] = flat(lambda x: pad(F.transform(x, lambda y: y["i"]), F.lit(0).cast("long")))
            return out
        m, s = c["m"], c["s"]
        if self.name == "Max_SumShiftExpWeight":
            return {"value": F.concat(F.array(m), s)}
        if self.name in ("LogSumExp", "LogSumExpWeight"):
            log = lambda x: F.when(x == 0, F.lit(-INF)).when(x < 0, F.lit(float("nan"))).otherwise(F.log(x))
            return {"value": F.transform(s, lambda x: F.when(m == F.lit(-INF), m).otherwise(m + log(x)))}
        # weights with a leading 1: the first entry is the total weight
        return {"value": F.transform(F.slice(s, 2, self.weight_dim - 1), lambda x: F.when(s[0] == 0, F.lit(float("nan"))).otherwise(F.try_divide(x, s[0])))}
