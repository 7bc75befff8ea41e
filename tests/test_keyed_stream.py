"""Streams with a state for each row."""

import datetime as dt

import numpy as np
import pytest
from pyspark.sql import functions as F

from pairloom.genred import PairReduce
from pairloom.operators.reductions import Reduction
from pairloom.streaming.keyed import keyed_stream, latest, write_changes

ALIASES = ["x = Vi(3)", "y = Vj(3)"]


def _sides(spark):
    r = np.random.default_rng(5)
    left = spark.createDataFrame([(i, i % 3, r.normal(size=3).tolist()) for i in range(20)], "i long, g int, x array<double>")
    right = [(j, j % 3, r.normal(size=3).tolist()) for j in range(30)]
    return left, spark.createDataFrame(right, "j long, g int, y array<double>")


def _ran(spark, right, path, query, left, **more):
    """The stream's batches, one for each g of the right side; what is latest."""
    for g in range(3):
        right.where(F.col("g") == g).coalesce(1).write.mode("append").parquet(f"{path}/in")
    stream = spark.readStream.schema(right.schema).option("maxFilesPerTrigger", 1).parquet(f"{path}/in")
    write_changes(keyed_stream(query, left, stream, **more), f"{path}/out").trigger(availableNow=True).start().awaitTermination()


@pytest.mark.parametrize(("op", "k"), [("Sum", 0), ("Min_ArgMin", 0), ("ArgKMin", 3), ("LogSumExp", 0), ("Kahan", 0)])
def test_equals_the_batch_query(spark, tmp_path, op, k):
    left, right = _sides(spark)
    q = PairReduce("-SqDist(x,y)", ALIASES, "Sum" if op == "Kahan" else op, 1, k=k, sum_scheme="kahan_scheme" if op == "Kahan" else "auto")
    _ran(spark, right, tmp_path, q, left.drop("g"))
    rows = lambda df: {r.i: [x for c in r[1:] for x in c] for r in df.collect()}
    got, want = rows(latest(spark, f"{tmp_path}/out", ["i"])), rows(q.run(left.drop("g"), right.drop("g")))
    assert got.keys() == want.keys() and all(np.allclose(got[i], want[i], rtol=1e-12) for i in want)


@pytest.mark.parametrize("op", ["Sum", "LogSumExp"])
def test_a_batch_writes_what_it_touches(spark, tmp_path, op):
    left, right = _sides(spark)
    q = PairReduce("-SqDist(x,y)", ALIASES, op, 1)
    _ran(spark, right, tmp_path, q, left, batch=["g"])
    changed = spark.read.parquet(f"{tmp_path}/out/changes").groupBy("batch", "g").count().collect()
    # each batch has one key, and puts out that key's rows alone
    assert len({r.batch for r in changed}) == 3 and sorted((r.g, r["count"]) for r in changed) == [(0, 7), (1, 7), (2, 6)]
    want = {(r.g, r.i): r.value[0] for r in q.run(left, right, batch=["g"]).collect()}
    got = {(r.g, r.i): r.value[0] for r in latest(spark, f"{tmp_path}/out", ["g", "i"]).collect()}
    assert got.keys() == want.keys() and all(abs(got[i] - want[i]) < 1e-9 for i in want)


def test_ranges_in_a_stream(spark, tmp_path):
    left, right = _sides(spark)
    left, right = left.withColumnRenamed("g", "bi"), right.withColumn("bj", F.col("g"))
    ranges = spark.createDataFrame([(0, 0), (0, 1), (2, 1)], "bi int, bj int")
    q = PairReduce("Exp(-g*SqDist(x,y))", [*ALIASES, "g = Pm(1)"], "Sum", 1)
    _ran(spark, right, tmp_path, q, left, ranges=ranges, params={"g": 0.5})
    want = {r.i: r.value[0] for r in q.run(left, right.drop("g"), params={"g": 0.5}, ranges=ranges).collect() if r.value[0]}
    got = {r.i: r.value[0] for r in latest(spark, f"{tmp_path}/out", ["i"]).collect()}
    assert got.keys() == want.keys() and all(abs(got[i] - want[i]) < 1e-12 for i in want)


@pytest.mark.parametrize(("op", "k"), [("Sum", 0), ("KMin", 2)])
def test_windows_close(spark, tmp_path, op, k):
    """A row of a window that the watermark has passed is dropped; a late one before that counts."""
    at = lambda h: dt.datetime(2024, 1, 1, h, 30)
    left = spark.createDataFrame([(1, 0.0), (2, 10.0)], "i long, x double")
    batches = [[(1, at(0), 1.0), (2, at(1), 2.0)], [(3, at(0), 3.0), (4, at(6), 4.0)], [(5, at(0), 5.0), (6, at(6), 6.0)], [(7, None, 7.0), (8, at(6), 8.0)]]
    q = PairReduce("Abs(x-y)", ["x = Vi(1)", "y = Vj(1)"], op, 1, k=k)
    schema = "j long, ts timestamp, y double"
    (tmp_path / "in").mkdir()
    stream = spark.readStream.schema(schema).parquet(f"{tmp_path}/in")
    for rows in batches:  # a run for each batch: states and watermark go on where the last run ended
        spark.createDataFrame(rows, schema).coalesce(1).write.mode("append").parquet(f"{tmp_path}/in")
        writer = write_changes(keyed_stream(q, left, stream, time="ts", window="1 hour", delay="2 hours"), f"{tmp_path}/out")
        writer.trigger(availableNow=True).start().awaitTermination()
    got = {(r.window_start.hour, r.i): r.value for r in latest(spark, f"{tmp_path}/out", ["window_start", "window_end", "i"]).collect()}
    seen = {0: [1.0, 3.0], 1: [2.0], 6: [4.0, 6.0, 8.0]}  # 5 came after the window of hour 0 was closed
    assert got.keys() == {(h, i) for h in seen for i in (1, 2)}
    for (h, i), value in got.items():
        each = sorted(abs((0.0 if i == 1 else 10.0) - y) for y in seen[h])
        assert value == ([sum(each)] if op == "Sum" else (each + [float("inf")])[:2])


def test_states_combine():
    """Two states are combined into that of all their rows, in any order."""
    r = np.random.default_rng(2)
    f = r.integers(0, 4, (5, 40, 2)).astype(float)
    ids = np.arange(40)
    for name, k in (("Sum", 0), ("Min_ArgMin", 0), ("KMin_ArgKMin", 3), ("LogSumExp", 0)):
        red = Reduction.of(name, 1 if name == "LogSumExp" else 2, k)
        x = f[..., :1] if name == "LogSumExp" else f
        fold = lambda part, red=red, x=x: red.update(red.start(5), x[:, part], ids[part], None)
        whole, a, b = fold(slice(0, 40)), fold(slice(0, 15)), fold(slice(15, 40))
        for both in (red.combine(a, b), red.combine(b, a), red.combine(red.combine(red.start(5), a), b)):
            assert all(np.allclose(p, q) for p, q in zip(both, whole, strict=True))


def test_what_is_refused(spark):
    left, right = _sides(spark)
    q = PairReduce("SqDist(x,y)", ALIASES, "Sum", 1)
    with pytest.raises(ValueError, match="window needs"):
        keyed_stream(q, left, right, delay="1 hour")
    with pytest.raises(ValueError, match="along j"):
        keyed_stream(PairReduce("SqDist(x,y)", ALIASES, "Sum", 0), left, right)
