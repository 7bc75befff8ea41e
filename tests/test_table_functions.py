"""Pair reductions in SQL."""

import numpy as np
import pytest
from pyspark.sql import functions as F

from pairloom.genred import PairReduce
from pairloom.table_functions import register_pair_reduce, register_query

ALIASES = ["x = Vi(3)", "y = Vj(3)", "b = Vj(1)"]


@pytest.fixture(scope="module")
def sides(spark):
    r = np.random.default_rng(7)
    left = spark.createDataFrame([(i, i % 4, r.normal(size=3).tolist(), "x") for i in range(50)], "i long, g int, x array<double>, note string")
    right = spark.createDataFrame([(j, j % 3, r.normal(size=3).tolist(), float(j)) for j in range(30)], "j long, g int, y array<double>, b double")
    left.createOrReplaceTempView("tf_left")
    return left, right


def _rows(df, by):
    return {tuple(r[c] for c in by): [x for c in df.columns if c not in by and r[c] is not None for x in r[c]] for r in df.collect()}


@pytest.mark.parametrize(
    ("op", "k", "second"),
    [("Sum", 0, None), ("Min", 0, None), ("Max_ArgMax", 0, None), ("ArgKMin", 3, None), ("KMin_ArgKMin", 40, None), ("LogSumExp", 0, None), ("LogSumExpWeight", 0, "b"), ("SumSoftMaxWeight", 0, "y"), ("Max_SumShiftExp", 0, None)],
)
def test_equal_to_the_query(spark, sides, op, k, second):
    left, right = sides
    q = PairReduce("-SqDist(x,y)", ALIASES, op, 1, k=k, formula2=second)
    register_query(spark, "tf_query", q, right)
    got, want = _rows(spark.sql("SELECT * FROM tf_query(TABLE(SELECT i, x, note FROM tf_left))"), ["i"]), _rows(q.run(left, right), ["i"])
    assert got.keys() == want.keys() and all(np.allclose(got[i], want[i], rtol=1e-12, equal_nan=True) for i in want)
    register_pair_reduce(spark, {"stars": right})
    more = f", {k}" + (f", '{second}'" if second else "") if k or second else ""
    text = f"SELECT id, value, index FROM pair_reduce(TABLE(SELECT i AS id, x FROM tf_left), 'stars', '-SqDist(x,y)', 'x = Vi(3); y = Vj(3); b = Vj(1)', '{op}'{more})"
    again = {(i,): x for (i,), x in _rows(spark.sql(text), ["id"]).items()}
    assert again.keys() == want.keys() and all(np.allclose(again[i], want[i], rtol=1e-12, equal_nan=True) for i in want)


def test_batch_keys_and_parameters(spark, sides):
    left, right = sides
    q = PairReduce("Exp(-h*SqDist(x,y))*b", [*ALIASES, "h = Pm(1)"], "Sum", 1)
    register_query(spark, "tf_batched", q, right, params={"h": 0.5}, batch=["g"])
    got = _rows(spark.sql("SELECT g, i, value FROM tf_batched(TABLE(SELECT i, g, x FROM tf_left))"), ["g", "i"])
    want = _rows(q.run(left.drop("note"), right, params={"h": 0.5}, batch=["g"]), ["g", "i"])
    # key 3 is on the left alone: it meets nothing, and its sums are 0
    assert got.keys() == want.keys() and any(g == 3 for g, _ in got) and all(np.allclose(got[k], want[k]) for k in want)


def test_odd_tables(spark, sides):
    left, right = sides
    q = PairReduce("SqDist(x,y)", ALIASES, "Min", 1)
    register_query(spark, "tf_none", q, right.limit(0))
    assert {r.value[0] for r in spark.sql("SELECT * FROM tf_none(TABLE(SELECT i, x FROM tf_left))").collect()} == {float("inf")}
    assert spark.sql("SELECT * FROM tf_none(TABLE(SELECT i, x FROM tf_left WHERE i < 0))").count() == 0
    register_query(spark, "tf_some", q, right)
    twice = spark.sql("SELECT * FROM tf_some(TABLE(SELECT i, x FROM tf_left UNION ALL SELECT NULL, x FROM tf_left))")
    assert twice.count() == 100 and twice.where(F.col("i").isNull()).count() == 50
    with pytest.raises(Exception, match="vectors must not be null"):
        spark.sql("SELECT * FROM tf_some(TABLE(SELECT 1 AS i, CAST(NULL AS ARRAY<DOUBLE>) AS x))").collect()
    register_pair_reduce(spark, {"stars": right})
    with pytest.raises(Exception, match="no side moons"):
        spark.sql("SELECT * FROM pair_reduce(TABLE(SELECT i AS id, x FROM tf_left), 'moons', 'SqDist(x,y)', 'x = Vi(3); y = Vj(3)', 'Sum')").collect()
