"""Reductions and physical plans against numpy."""

import numpy as np
import pytest
from pyspark.sql import functions as F

from pairloom.genred import PairReduce
from pairloom.operators import cluster
from pairloom.operators.solve import KernelSolve
from pairloom.tensor import Pm, Vi, Vj, exp1j

M, N = 20, 15
rng = np.random.default_rng(0)
X, Y, B = rng.uniform(size=(M, 3)), rng.uniform(size=(N, 3)), rng.normal(size=N)
Y[4] = Y[9]  # a tie
D = ((X[:, None] - Y[None]) ** 2).sum(-1)


@pytest.fixture(scope="module")
def left(spark):
    return spark.createDataFrame([(i, r.tolist(), i % 3) for i, r in enumerate(X)], "i long, x array<double>, g int").cache()


@pytest.fixture(scope="module")
def right(spark):
    return spark.createDataFrame([(j, r.tolist(), float(B[j]), j % 3) for j, r in enumerate(Y)], "j long, y array<double>, b double, g int").cache()


def got(df, col="value", key="i"):
    return np.array([r[col] for r in df.orderBy(key).collect()])


@pytest.mark.parametrize("strategy", ["auto", "blocks", "columns"])
def test_all_plans_give_the_same(left, right, strategy):
    x, y, b = Vi(left, "x"), Vj(right, "y"), Vj(right, "b")
    d = x.sqdist(y)
    assert np.allclose(got(((-d).exp() * b).sum(axis=1, strategy=strategy))[:, 0], np.exp(-D) @ B)
    r = d.min_argmin(axis=1, strategy=strategy)
    assert np.allclose(got(r)[:, 0], D.min(1)) and (got(r, "index")[:, 0] == D.argmin(1)).all()
    r = d.Kmin_argKmin(4, axis=1, strategy=strategy)
    order = np.argsort(D, 1, kind="stable")[:, :4]
    assert np.allclose(got(r), np.sort(D, 1)[:, :4]) and (got(r, "index") == order).all()
    w = np.exp(D)
    assert np.allclose(got(d.sumsoftmaxweight(y, axis=1, strategy=strategy)), (w @ Y) / w.sum(1, keepdims=True))
    assert np.allclose(got(d.logsumexp(axis=0, strategy=strategy), key="j")[:, 0], np.log(w.sum(0)))


def test_ties_nan_and_padding(spark):
    nan = float("nan")
    left = spark.createDataFrame([(0, 0.0)], "i long, x double")
    right = spark.createDataFrame([(7, 1.0), (3, 1.0), (5, nan), (1, 2.0)], "j long, y double")
    x, y = Vi(left, "x"), Vj(right, "y")
    for strategy in ("auto", "blocks", "columns"):
        r = (x + y).Kmin_argKmin(5, axis=1, strategy=strategy).first()
        assert r["value"] == [1.0, 1.0, 2.0, float("inf"), float("inf")] and r["index"] == [3, 7, 1, 0, 0]
        assert (x + y).argmin(axis=1, strategy=strategy).first()["index"] == [3]
        assert (x + y).max(axis=1, strategy=strategy).first()["value"] == [2.0]


def test_large_exponents(spark):
    left = spark.createDataFrame([(0, 1.0)], "i long, x double")
    right = spark.createDataFrame([(j, v) for j, v in enumerate([1000.0, 999.0, -1000.0, float("-inf")])], "j long, y double")
    for strategy in ("auto", "blocks", "columns"):
        v = (Vi(left, "x") * Vj(right, "y")).logsumexp(axis=1, strategy=strategy).first()["value"][0]
        assert abs(v - (1000 + np.log1p(np.exp(-1)))) < 1e-9


def test_batches_and_ranges(left, right):
    x, y = Vi(left, "x", batch=["g"]), Vj(right, "y", batch=["g"])
    same = np.arange(M)[:, None] % 3 == np.arange(N)[None] % 3
    assert np.allclose(got((-x.sqdist(y)).exp().sum(axis=1))[:, 0], (np.exp(-D) * same).sum(1))
    a, b = cluster.grid_cluster(left, "x", 0.5, 3, "bi"), cluster.grid_cluster(right, "y", 0.5, 3, "bj")
    ranges = a.select("bi").distinct().crossJoin(b.select("bj").distinct()).where("(bi + bj) % 2 = 0 and bi > 0")
    la, lb = {r.i: r.bi for r in a.collect()}, {r.j: r.bj for r in b.collect()}
    mask = np.array([[(la[i] + lb[j]) % 2 == 0 and la[i] > 0 for j in range(N)] for i in range(M)])
    for strategy in ("auto", "columns"):
        k = (-Vi(a, "x").sqdist(Vj(b, "y"))).exp().with_ranges(ranges)
        assert np.allclose(got(k.sum(axis=1, strategy=strategy))[:, 0], (np.exp(-D) * mask).sum(1))
        none = (~mask).all(1)
        assert np.isinf(got(k.min(axis=1, strategy=strategy))[none, 0]).all()


def test_gradients_of_reductions(left, right):
    aliases = ["x = Vi(3)", "y = Vj(3)", "b = Vj(1)"]
    g = PairReduce("Exp(-SqDist(x,y))*b", aliases, "Sum", 1).grad("x")
    want = (-2 * (X[:, None] - Y[None]) * (np.exp(-D) * B)[..., None]).sum(1)
    assert np.allclose(got(g.run(left.withColumn("eta", F.lit(1.0)), right)), want)
    lse = PairReduce("-SqDist(x,y)", aliases[:2], "LogSumExp", 1)
    own = lse.run(left, right).select("i", F.col("value")[0].alias("saved"))
    p = np.exp(-D) / np.exp(-D).sum(1, keepdims=True)
    out = lse.grad("x").run(left.join(own, "i").withColumn("eta", F.lit(1.0)), right)
    assert np.allclose(got(out), (-2 * (X[:, None] - Y[None]) * p[..., None]).sum(1))
    assert (got(PairReduce("SqDist(x,y)", aliases[:2], "ArgMin", 1).grad("y").run(left, right), key="j") == 0).all()
    with pytest.raises(NotImplementedError):
        PairReduce("SqDist(x,y)", aliases[:2], "Min", 1).grad("x")


def test_operators(left, right):
    x, y, b = Vi(left, "x"), Vj(right, "y"), Vj(right, "b")
    k = (-((x - y) ** 2).sum(-1) / 0.5).exp()
    assert np.allclose(got(k @ b)[:, 0], np.exp(-2 * D) @ B)
    assert np.allclose(got((x[0] * y[1:3]).sum(axis=1)), X[:, :1] * Y[:, 1:].sum(0))
    assert np.allclose(got(k.t().sum(axis=1), key="j")[:, 0], np.exp(-2 * D).sum(0))
    assert np.allclose(got((x | Pm([1.0, 2.0, 3.0])).sum(axis=1))[:, 0], X @ [1, 2, 3])
    z = (exp1j(x) * exp1j(y)).sum(axis=1)
    want = np.exp(1j * (X[:, None] + Y[None])).sum(1)
    assert np.allclose(got(z)[:, 0::2] + 1j * got(z)[:, 1::2], want)
    assert k.shape == (M, N)
    with pytest.raises(TypeError):
        x + x.sum(axis=1)


def test_solver(right):
    left = right.select(F.col("j").alias("i"), F.col("y").alias("x"))
    solver = KernelSolve("Exp(-SqDist(x,y))*b", ["x = Vi(3)", "y = Vj(3)", "b = Vj(1)"], "b")
    a = got(solver.run(left, right, alpha=0.1, eps=1e-8), key="j")[:, 0]
    k = np.exp(-((Y[:, None] - Y[None]) ** 2).sum(-1)) + 0.1 * np.eye(N)
    assert np.abs(k @ a - B).max() < 1e-5


def test_nulls_are_refused(spark, right):
    left = spark.createDataFrame([(0, [1.0, None, 2.0])], "i long, x array<double>")
    with pytest.raises(Exception, match="null"):
        Vi(left, "x").sqdist(Vj(right, "y")).sum(axis=1).collect()


def test_clusters(spark):
    df = spark.createDataFrame([(i, [v]) for i, v in enumerate([0.1, 5.2, 0.2, -3.0, 5.9])], "i long, x array<double>")
    lab = cluster.grid_cluster(df, "x", 1.0, 1)
    assert [r.label for r in lab.orderBy("i").collect()] == [1, 2, 1, 0, 2]
    assert [(r.label, r.start, r.end) for r in cluster.cluster_ranges(lab, "label").orderBy("label").collect()] == [(0, 0, 1), (1, 1, 3), (2, 3, 5)]
    c = cluster.cluster_centroids(lab, "x", "label", 1).orderBy("label").collect()
    assert np.allclose([r.centroid[0] for r in c], [-3.0, 0.15, 5.55])


def test_stream_equals_batch(spark, left, right, tmp_path):
    from pairloom import streaming

    src = str(tmp_path / "in")
    right.repartition(3).write.parquet(src)
    q = PairReduce("-SqDist(x,y)", ["x = Vi(3)", "y = Vj(3)"], "LogSumExp", 1)
    stream = spark.readStream.schema(right.schema).option("maxFilesPerTrigger", 1).parquet(src)
    run = streaming.fold_stream(q, left, stream, str(tmp_path / "state")).start()
    run.processAllAvailable()
    n = run.lastProgress["batchId"] if run.lastProgress else 0
    run.stop()
    import os

    n = max(int(x) for x in os.listdir(tmp_path / "state" / "state"))
    assert np.allclose(got(streaming.state(q, left, str(tmp_path / "state"), n))[:, 0], np.log(np.exp(-D).sum(1)))


def test_entry_and_oracles(spark):
    duckdb = pytest.importorskip("duckdb")
    import os

    import __spark_entry__ as entry

    sf = "/root/testdata/sf0.001"
    if not os.path.isdir(sf):
        pytest.skip("no test data")
    con = duckdb.connect()
    for t in ("supplier", "nation", "embeddings"):
        con.execute(f"CREATE VIEW {t} AS SELECT * FROM '{sf}/{t}.parquet'")
    queries, oracles = entry.queries(), entry.oracle_sql()
    for name in ("gaussian_sum", "red_kmin_argkmin", "op_laplacian", "block_sparse_sum", "fn_mod"):
        a, b = queries[name](spark, sf).toPandas(), con.execute(oracles[name]).df()
        cols = sorted(a.columns)
        assert cols == sorted(b.columns)
        assert (a[cols].sort_values(cols).values == b[cols].sort_values(cols).values).all(), name


def test_equal_rows_tie_in_high_dimension(spark):
    r = np.random.default_rng(1)
    base = r.normal(size=(40, 64))
    rows = np.concatenate([base, base, base])
    df = spark.createDataFrame([(i, v.tolist()) for i, v in enumerate(rows)], "j long, y array<double>")
    left = df.where("j < 40").select(F.col("j").alias("i"), F.col("y").alias("x"))
    x, y = Vi(left, "x"), Vj(df, "y")
    for d in (x.sqdist(y), -(x | y)):
        assert (got(d.argKmin(3, axis=1), "index")[:5] == [[i, i + 40, i + 80] for i in range(5)]).all() or str(d).startswith("Minus")
        first = got(d.argmin(axis=1), "index")[:, 0]
        assert (first < 40).all()


# -- plans at size ---------------------------------------------------------------------
def _sides(spark, m=7, n=23, dim=3, seed=4, big=1.0):
    r = np.random.default_rng(seed)
    left = spark.createDataFrame([(i, [float(v) for v in r.normal(0, big, dim)]) for i in range(m)], "i long, x array<double>")
    right = spark.createDataFrame([(j, [float(v) for v in r.normal(0, big, dim)], float(r.normal())) for j in range(n)], "j long, y array<double>, b double").repartition(3)
    return left, right


@pytest.mark.parametrize("op", ["LogSumExp", "LogSumExpWeight", "Max_SumShiftExpWeight", "SumSoftMaxWeight", "KMin", "ArgKMin", "KMin_ArgKMin"])
@pytest.mark.parametrize("big", [1.0, 60.0])
def test_columns_merge_without_lists(spark, op, big):
    """Sums of exponentials by buckets (exponents reach some tens of thousands) and K lowest by a window agree with the kernels."""
    left, right = _sides(spark, big=big)
    more = {"k": 4} if "K" in op else {}
    weight = {"formula2": "b"} if "Weight" in op else {}
    q = PairReduce("SqDist(x,y)" if "K" in op else "SqDist(x,y) - 5", ["x = Vi(3)", "y = Vj(3)", "b = Vj(1)"], op, 1, **more, **weight)
    flat = lambda df: {r.i: [v for c in df.columns if c != "i" for v in r[c]] for r in df.collect()}
    got, want = flat(q.run(left, right, strategy="columns")), flat(q.run(left, right))
    assert set(got) == set(want) and all(np.allclose(got[i], want[i], rtol=1e-9, equal_nan=True) for i in got)


def test_tile_is_bounded_by_the_widest_part():
    import tracemalloc

    from pairloom.operators.pairs import PairKernel, pair_width
    from pairloom.operators.reductions import Reduction
    from pairloom.plans.parse import parse

    f, _ = parse("Sum(Abs(x-y))", ["x = Vi(300)", "y = Vj(300)"])
    assert pair_width(f) == 300 and pair_width(parse("Exp(-SqDist(x,y))", ["x = Vi(300)", "y = Vj(300)"])[0]) == 1
    x, y = (v.key for v in f.variables())
    r = np.random.default_rng(0)
    a, b = r.normal(size=(600, 300)), r.normal(size=(700, 300))
    red = Reduction.of("Sum", 1)
    tracemalloc.start()
    state = PairKernel(f, None, red, 0, {}).fold(red.start(600), {x: a}, {y: b}, np.arange(700))
    peak = tracemalloc.get_traced_memory()[1]
    tracemalloc.stop()
    assert peak < 250e6  # whole pairs would be 1 GB, twice
    assert np.allclose(state[0][:5, 0], np.abs(a[:5, None] - b[None]).sum((1, 2)))


def test_wide_points_and_wide_results(spark):
    """300 components, and 300 result columns, by blocks and by the small side."""
    r = np.random.default_rng(1)
    x, y, b = r.normal(size=(20, 300)) / 17, r.normal(size=(30, 300)) / 17, r.normal(size=(30, 300))
    left = spark.createDataFrame([(i, v.tolist()) for i, v in enumerate(x)], "i long, x array<double>")
    right = spark.createDataFrame([(j, v.tolist(), w.tolist()) for j, (v, w) in enumerate(zip(y, b, strict=True))], "j long, y array<double>, b array<double>")
    k = np.exp(-((x[:, None] - y[None]) ** 2).sum(-1))
    q = PairReduce("Exp(-SqDist(x,y))*b", ["x = Vi(300)", "y = Vj(300)", "b = Vj(300)"], "Sum", 1)
    for strategy in ("auto", "blocks"):
        got = {r.i: r.value for r in q.run(left, right, strategy=strategy).collect()}
        assert np.allclose([got[i] for i in range(20)], k @ b)


def test_hot_clusters_are_cut(spark, monkeypatch):
    from pairloom.operators import pairs

    monkeypatch.setattr(pairs, "BLOCK_ROWS", 4)
    left, right = _sides(spark)
    left, right = left.withColumn("bi", F.lit(0).cast("long")), right.withColumn("bj", (F.col("j") % 2).cast("long"))
    ranges = spark.createDataFrame([(0, 0), (0, 1)], "bi long, bj long")
    q = PairReduce("Exp(-SqDist(x,y))*b", ["x = Vi(3)", "y = Vj(3)", "b = Vj(1)"], "Sum", 1)
    got, want = ({r.i: r.value[0] for r in x.collect()} for x in (q.run(left, right, ranges=ranges), q.run(left, right)))
    assert got.keys() == want.keys() and all(abs(got[i] - want[i]) < 1e-12 for i in got)


@pytest.mark.parametrize("broadcasts", [True, False])
@pytest.mark.parametrize("kind", ["batch", "ranges", "all"])
def test_pairs_of_blocks_are_dealt_to_tasks(spark, monkeypatch, kind, broadcasts):
    """A key, or a cluster, with nearly all rows is as many tasks as its pairs of blocks fill."""
    from pairloom.operators import pairs

    monkeypatch.setattr(pairs, "BLOCK_ROWS", 128)
    monkeypatch.setattr(pairs, "SMALL_BYTES", 0)
    if not broadcasts:
        monkeypatch.setattr(pairs, "SMALL_LIST", 0)
    seen = []
    fewer = pairs._fewer
    monkeypatch.setattr(pairs, "_fewer", lambda partial, by, reduction: fewer(seen.append(partial) or partial, by, reduction))
    hot = lambda c: F.when(F.col(c) < 8, F.col(c)).otherwise(F.lit(99)).cast("long")
    left = spark.range(2048).select(F.col("id").alias("i"), (F.col("id") % 7).cast("double").alias("x"), hot("id").alias("g"), hot("id").alias("bi"))
    right = spark.range(2048).select(F.col("id").alias("j"), (F.col("id") % 5).cast("double").alias("y"), hot("id").alias("g"), hot("id").alias("bj"))
    more = {"batch": {"batch": ["g"]}, "ranges": {"ranges": spark.createDataFrame([(99, 99), (1, 99)], "bi long, bj long")}, "all": {}}[kind]
    before = spark.conf.get("spark.sql.autoBroadcastJoinThreshold")
    try:
        if not broadcasts:
            spark.conf.set("spark.sql.autoBroadcastJoinThreshold", "-1")
        out = PairReduce("Square(x-y)", ["x = Vi(1)", "y = Vj(1)"], "Sum", 1).run(left, right, **more)
        by_task = [r["count"] for r in seen[0].groupBy(F.spark_partition_id()).count().collect()]
        got = {r.i: r.value[0] for r in out.collect()}
    finally:
        spark.conf.set("spark.sql.autoBroadcastJoinThreshold", before)
    assert sum(by_task) > 2000 * 16 and len(by_task) >= 14 and max(by_task) < 0.2 * sum(by_task)
    meets = {"batch": lambda i, j: (i if i < 8 else 99) == (j if j < 8 else 99), "ranges": lambda i, j: (i >= 8 or i == 1) and j >= 8, "all": lambda i, j: True}[kind]
    assert len(got) == 2048 and all(got[i] == sum((i % 7 - j % 5) ** 2 for j in range(2048) if meets(i, j)) for i in (0, 1, 3, 8, 77, 2047))


@pytest.mark.parametrize("op, k", [("Sum", 0), ("ArgKMin", 3), ("KMin_ArgKMin", 2), ("LogSumExp", 0), ("Min_ArgMin", 0)])
def test_small_side_by_keys_and_clusters(spark, op, k):
    """The small side by batch keys, clusters and keys of its own gives what blocks and columns give."""
    r = np.random.default_rng(6)
    left = spark.createDataFrame([(i, v.tolist(), i % 3 if i % 11 else None, i % 4) for i, v in enumerate(r.normal(size=(40, 3)))], "i long, x array<double>, g long, bi long").repartition(3)
    right = spark.createDataFrame([(j, v.tolist(), j % 4 if j % 7 else None, "ab"[j % 2], j % 5) for j, v in enumerate(r.normal(size=(30, 3)))], "j long, y array<double>, g long, h string, bj long")
    ranges = spark.createDataFrame([(0, 1), (0, 2), (1, 4), (3, 0), (3, 0)], "bi long, bj long")
    q = PairReduce("-SqDist(x,y)", ["x = Vi(3)", "y = Vj(3)"], op, 1, k=k)
    for more in ({"batch": ["g"]}, {"ranges": ranges}, {"batch": ["g"], "ranges": ranges}, {"batch": ["h"]}, {"batch": ["h"], "ranges": ranges}):
        small, blocks, columns = (sorted(repr([np.round(v, 9).tolist() if isinstance(v, list) else v for v in row]) for row in q.run(left, right, strategy=s, **more).collect()) for s in ("auto", "blocks", "columns"))
        assert small == blocks == columns, more


@pytest.mark.parametrize("strategy", ["auto", "blocks"])
def test_many_sets_of_parameters(spark, strategy):
    """Each set of a table gives what it gives alone, with batch keys and ranges too."""
    left, right = _sides(spark)
    left, right = left.withColumn("bi", F.col("i") % 2), right.withColumn("bj", F.col("j") % 3)
    scales = [(f"s{k}", 0.1 * k, [float(k), 1.0, 2.0]) for k in range(1, 8)]
    sets = spark.createDataFrame(scales, "name string, g double, w array<double>")
    ranges = spark.createDataFrame([(0, 1), (1, 0)], "bi long, bj long")
    for op, formula2, more in (("Sum", None, {}), ("LogSumExp", None, {"ranges": ranges}), ("ArgKMin", None, {}), ("SumSoftMaxWeight", "y", {})):
        q = PairReduce("-g*Sum(w*Square(x-y))", ["x = Vi(3)", "y = Vj(3)", "g = Pm(1)", "w = Pm(3)"], op, 1, k=2 if op == "ArgKMin" else 0, formula2=formula2)
        got = {(r.name, r.i): r[2] for r in q.run(left, right, params=sets, params_key="name", strategy=strategy, **more).collect()}
        for name, g, w in scales:
            want = {r.i: r[1] for r in q.run(left, right, params={"g": g, "w": w}, **more).collect()}
            assert all(np.allclose(got[name, i], v) for i, v in want.items()) and len(got) == len(want) * len(scales)
    with pytest.raises(ValueError, match="no value for parameter w"):
        q.run(left, right, params=sets.drop("w"), params_key="name")
    with pytest.raises(ValueError, match="distinct"):
        q.run(left, right, params=sets.union(sets), params_key="name")
    with pytest.raises(ValueError, match="params_key"):
        q.run(left, right, params=sets)


def test_what_parameters_do_not_change_is_computed_once():
    from pairloom.functions import ops
    from pairloom.operators import pairs
    from pairloom.operators.reductions import Reduction

    q = PairReduce("Exp(-g*SqDist(x,y))", ["x = Vi(3)", "y = Vj(3)", "g = Pm(1)"], "Sum", 1)
    x, y, g = q.variables if [v.name for v in q.variables] == ["x", "y", "g"] else sorted(q.variables, key="xyg".index)
    sets = [{g.key: np.array([0.1 * k])} for k in range(1, 51)]
    kernel, calls = pairs.PairKernel(q.formula, None, Reduction.of("Sum", 1), q.keep, sets), []
    plain = ops.TABLE["SqDist"].kernel
    try:
        ops.TABLE["SqDist"].kernel = lambda *a: calls.append(1) or plain(*a)
        states = kernel.fold_sets(kernel.start(M), {x.key: X}, {y.key: Y}, np.arange(N))
    finally:
        ops.TABLE["SqDist"].kernel = plain
    assert len(calls) == 1 and all(np.allclose(s[0][:, 0], np.exp(-0.1 * k * D).sum(1)) for k, s in enumerate(states, 1))


@pytest.mark.parametrize("formula", ["Sum(Abs(x-y))", "Norm2(Abs(x-y)+y)", "Sum(Square(x-y)*Exp(-Elem(x,0)))", "Exp(-Sum(Abs(x-y)))*(Abs(x-y)|y)"])
def test_components_by_slices(formula):
    """Vectors of 1000 components take the memory of few, and give the same values."""
    import tracemalloc

    from pairloom.operators import pairs
    from pairloom.operators.reductions import Reduction

    r = np.random.default_rng(3)

    def fold(dim, chunks=True):
        a, b = np.random.default_rng(1).normal(size=(300, dim)) / dim, np.random.default_rng(2).normal(size=(400, dim)) / dim
        q = PairReduce(formula, [f"x = Vi({dim})", f"y = Vj({dim})"], "Sum", 1)
        x, y = (next(v for v in q.variables if v.name == n) for n in "xy")
        kernel = pairs.PairKernel(q.formula, None, Reduction.of("Sum", 1), q.keep, {}, chunks)
        tracemalloc.start()
        out = kernel.fold(kernel.reduction.start(300), {x.key: a}, {y.key: b}, np.arange(400))[0]
        peak = tracemalloc.get_traced_memory()[1]
        tracemalloc.stop()
        return out, peak, kernel

    (wide, high, kernel), (whole, _, plain), (_, low, _) = fold(1000), fold(1000, False), fold(64)
    assert kernel.folded and not plain.folded and np.allclose(wide, whole, rtol=1e-10)
    assert pairs.pair_width(kernel.formula, False, kernel.folded) <= 64 and high < 2 * low + 3e6


def test_chunks_in_queries(spark):
    r = np.random.default_rng(1)
    x, y = r.normal(size=(20, 300)) / 17, r.normal(size=(30, 300)) / 17
    left = spark.createDataFrame([(i, v.tolist()) for i, v in enumerate(x)], "i long, x array<double>")
    right = spark.createDataFrame([(j, v.tolist()) for j, v in enumerate(y)], "j long, y array<double>")
    want = np.abs(x[:, None] - y[None]).sum(-1)
    for chunks in (True, False):
        q = PairReduce("Sum(Abs(x-y))", ["x = Vi(300)", "y = Vj(300)"], "KMin_ArgKMin", 1, k=3, enable_chunks=chunks)
        got = {r.i: r for r in q.run(left, right).collect()}
        assert all(np.allclose(got[i].value, np.sort(want[i])[:3]) and got[i]["index"] == np.argsort(want[i])[:3].tolist() for i in range(20))


def test_a_stream_takes_parameters(spark, tmp_path):
    from pairloom import streaming

    left, right = _sides(spark)
    right.select("j", "y").write.parquet(f"{tmp_path}/in")
    stream = spark.readStream.schema(right.select("j", "y").schema).parquet(f"{tmp_path}/in")
    q = PairReduce("Exp(-g*SqDist(x,y))", ["x = Vi(3)", "y = Vj(3)", "g = Pm(1)"], "Sum", 1)
    got = {r.i: r.value[0] for r in streaming.reduce_available(q, left, stream, f"{tmp_path}/state", params={"g": 2.5}).collect()}
    want = {r.i: r.value[0] for r in q.run(left, right, params={"g": 2.5}).collect()}
    assert got.keys() == want.keys() and all(abs(got[i] - want[i]) < 1e-12 for i in got)
    with pytest.raises(ValueError, match="no value for parameter g"):
        streaming.fold_stream(q, left, stream, f"{tmp_path}/other")


def test_clusters_are_numbered_alike_by_ranges(spark, monkeypatch):
    df = spark.range(200).select("id", F.array((F.col("id") % 7).cast("double"), (F.col("id") % 5).cast("double")).alias("x"))
    own = {r.id: r.label for r in cluster.grid_cluster(df, "x", 2.0, 2).collect()}
    places = sorted(map(tuple, cluster.cluster_ranges(cluster.grid_cluster(df, "x", 2.0, 2), "label").collect()))
    monkeypatch.setattr(cluster, "FEW", 0)
    assert own == {r.id: r.label for r in cluster.grid_cluster(df, "x", 2.0, 2).collect()} and len(set(own.values())) == 12
    assert places == sorted(map(tuple, cluster.cluster_ranges(cluster.grid_cluster(df, "x", 2.0, 2), "label").collect()))


def test_many_blocks_leave_few_states(spark, monkeypatch):
    """Lowest and exponential states of many blocks are merged without a list of all of them."""
    from pairloom.operators import pairs

    monkeypatch.setattr(pairs, "BLOCK_ROWS", 2)
    left, right = _sides(spark)
    for op, k in (("ArgKMin", 3), ("LogSumExp", 0)):
        q = PairReduce("-SqDist(x,y)", ["x = Vi(3)", "y = Vj(3)"], op, 1, k=k)
        a, b = ({r[0]: r[1] for r in q.run(left, right, strategy=s).collect()} for s in ("blocks", "small"))
        assert a.keys() == b.keys() and all(np.allclose(a[i], b[i], rtol=1e-12) for i in a)


def test_ranged_tensor_is_transposed(spark):
    left, right = _sides(spark)
    left, right = left.withColumn("bi", F.col("i") % 3), right.withColumn("bj", F.col("j") % 4)
    x, y = Vi(left, "x", dim=3), Vj(right, "y", dim=3)
    k = (-x.sqdist(y)).exp()
    k.ranges = spark.createDataFrame([(0, 1), (1, 1), (2, 3)], "bi long, bj long")
    there, back = {r.j: r.value[0] for r in k.sum(axis=0).collect()}, {r.j: r.value[0] for r in k.t().sum(axis=1).collect()}
    assert there.keys() == back.keys() and all(abs(there[j] - back[j]) < 1e-12 for j in there) and any(there.values())
    assert {r.i: r.value for r in k.t().t().sum(axis=1).collect()} == {r.i: r.value for r in k.sum(axis=1).collect()}


def test_gradient_of_solve(spark):
    """Against finite differences of e . a by the right-hand side and by the points of either side."""
    from pairloom.operators.solve import KernelSolve

    r = np.random.default_rng(2)
    x, y, b, e = r.normal(size=(5, 2)), None, r.normal(size=5), r.normal(size=5)
    y = x.copy()
    k = lambda x, y: np.exp(-((x[:, None] - y[None]) ** 2).sum(-1)) + 0.3 * np.eye(5)
    value = lambda x, y, b: e @ np.linalg.solve(k(x, y), b)
    left = spark.createDataFrame([(i, x[i].tolist()) for i in range(5)], "i long, x array<double>")
    right = spark.createDataFrame([(j, y[j].tolist(), float(b[j]), float(e[j])) for j in range(5)], "j long, y array<double>, b double, eta double")
    solver = KernelSolve("Exp(-SqDist(x,y))*b", ["x = Vi(2)", "y = Vj(2)", "b = Vj(1)"], "b")
    for name, at in (("b", b), ("x", x), ("y", y)):
        rows = solver.grad(name, left, right, alpha=0.3, eps=1e-11).collect()
        got = np.array([r.value for r in sorted(rows, key=lambda r: r[0])]).reshape(at.shape)
        for spot in np.ndindex(at.shape):
            step = np.zeros_like(at)
            step[spot] = 1e-6
            args = {"x": x, "y": y, "b": b}
            up, down = value(**args | {name: at + step}), value(**args | {name: at - step})
            assert abs((up - down) / 2e-6 - got[spot]) < 1e-5
    with pytest.raises(ArithmeticError, match="not solved in 1 iterations"):
        solver.run(left, right, alpha=0.3, eps=1e-11, max_iterations=1)


def test_bins_are_numbered_by_ranges(spark):
    from pairloom.operators import cluster

    r = np.random.default_rng(3)
    pts = r.uniform(-2, 2, (200, 2))
    df = spark.createDataFrame([(i, p.tolist()) for i, p in enumerate(pts)], "i long, x array<double>")
    binned = cluster.grid_cluster(df, "x", 0.5, 2)
    got = {r.i: r.label for r in binned.collect()}
    bins = [tuple(np.floor(p / 0.5)) for p in pts]
    rank = {b: k for k, b in enumerate(sorted(set(bins)))}
    assert got == {i: rank[b] for i, b in enumerate(bins)}
    ranges = sorted(tuple(r) for r in cluster.cluster_ranges(binned, "label").collect())
    assert ranges[0][1] == 0 and ranges[-1][2] == 200 and all(a[2] == b[1] for a, b in zip(ranges, ranges[1:], strict=False))
    means = cluster.cluster_centroids(binned, "x", "label", 2)
    near = {tuple(r) for r in cluster.close_blocks(means, means, 0.8).collect()}
    c = {r.label: np.array(r.centroid) for r in means.collect()}
    assert near == {(a, b) for a in c for b in c if ((c[a] - c[b]) ** 2).sum() < 0.64}


def test_nystrom_preconditioner(spark):
    """With as many landmarks as the kernel has rank, a few steps instead of dozens."""
    r = np.random.default_rng(5)
    x, b = r.normal(size=(60, 2)), r.normal(size=60)
    left = spark.createDataFrame([(i, v.tolist()) for i, v in enumerate(x)], "i long, x array<double>")
    right = spark.createDataFrame([(j, v.tolist(), float(c)) for j, (v, c) in enumerate(zip(x, b, strict=True))], "j long, y array<double>, b double")
    solver = KernelSolve("Exp(-SqDist(x,y))*b", ["x = Vi(2)", "y = Vj(2)", "b = Vj(1)"], "b")
    want = np.linalg.solve(np.exp(-((x[:, None] - x[None]) ** 2).sum(-1)) + 0.01 * np.eye(60), b)
    out = solver.run(left, right, alpha=0.01, eps=1e-6, max_iterations=7, preconditioner="nystrom", landmarks=45)
    assert np.allclose(got(out, key="j")[:, 0], want, atol=1e-3)
    with pytest.raises(ArithmeticError):
        solver.run(left, right, alpha=0.01, eps=1e-6, max_iterations=7)


def test_shared_subtrees_become_columns(spark):
    left, right = _sides(spark)
    q = PairReduce("AutoFactorize(Exp(-SqDist(x,y)) * (1 + Exp(-SqDist(x,y))))", ["x = Vi(3)", "y = Vj(3)"], "Sum", 1)
    out = q.run(left, right, strategy="columns")
    assert out._jdf.queryExecution().optimizedPlan().toString().lower().count("exp(") <= 2  # once as written, and once in the name of a column
    a, b = ({r.i: r.value[0] for r in x.collect()} for x in (out, q.run(left, right)))
    assert all(abs(a[i] - b[i]) < 1e-12 for i in a)
    with pytest.raises(ValueError, match="no part"):
        PairReduce("Factorize(Exp(-SqDist(x,y)), Square(y))", ["x = Vi(3)", "y = Vj(3)"], "Sum", 1)


@pytest.mark.parametrize("strategy", ["small", "blocks", "columns"])
def test_exact_sums(spark, monkeypatch, strategy):
    """Sums keep their rounding errors in tiles and over merges, in any order; what is not finite stays so."""
    import math

    from pairloom.operators import pairs

    monkeypatch.setattr(pairs, "BLOCK_ROWS", 2)
    left = spark.createDataFrame([(0, 1.0), (1, 0.5)], "i long, x double")
    r = np.random.default_rng(5)
    many = np.concatenate([s := r.normal(size=30) * 10.0 ** r.integers(-5, 12, 30), -s[::-1], r.normal(size=7), [5e-324, 1e-310]])
    q = PairReduce("x*y", ["x = Vi(1)", "y = Vj(1)"], "Sum", 1, sum_scheme="kahan_scheme")
    for values in ([1e16, 1.0, -1e16, 1.0], [1.0, 1e16, 1.0, -1e16], [1e300, 1.0, -1e300], [1e308, 1e-300, -1e308], many.tolist(), [0.0, -0.0], [float("inf"), 1.0], [float("inf"), float("-inf")], [float("nan"), 1.0]):
        right = spark.createDataFrame([(j, float(v)) for j, v in enumerate(values)], "j long, y double").repartition(3)
        got = {r.i: r.value[0] for r in q.run(left, right, strategy=strategy).collect()}
        for i, x in ((0, 1.0), (1, 0.5)):
            want = math.fsum(x * v for v in values) if np.isfinite(values).all() else sum(values)
            assert got[i] == want or (np.isnan(got[i]) and np.isnan(want)) or abs(got[i] - want) < 1e-14 * abs(want)


@pytest.mark.parametrize("scheme", ["auto", "kahan_scheme"])
def test_factors_of_one_side_make_no_pairs(spark, monkeypatch, scheme):
    """Sums of products, each factor of one side, are products of sums: no pair is made, and what is not finite stays so."""
    from pairloom.operators import pairs

    def none(*_):
        raise AssertionError("pairs were made")

    q = PairReduce("x*y*g*z", ["x = Vi(1)", "y = Vj(2)", "g = Pm(1)", "z = Vj(1)"], "Sum", 1, sum_scheme=scheme)
    xs, r = [1.5, -2.0, 0.0, float("inf"), float("-inf"), float("nan")], np.random.default_rng(3)
    left = spark.createDataFrame(list(enumerate(xs)), "i long, x double")
    ys = np.concatenate([r.random((40, 2)) + 0.5, [[1e16, 1.0], [-1e16, 0.0]]]) if scheme != "auto" else r.random((40, 2)) * [1, -1]
    right = spark.createDataFrame([(j, y.tolist(), 0.5) for j, y in enumerate(ys)], "j long, y array<double>, z double").repartition(3)
    with monkeypatch.context() as m:
        for name in ("_by_blocks", "_by_small_side"):
            m.setattr(pairs, name, none)
        got = {v.i: v.value for v in q.run(left, right, {"g": 4.0}, strategy="blocks").collect()}
        empty = q.run(left, right.where("j < 0"), {"g": 4.0}, strategy="blocks").collect()
    with np.errstate(all="ignore"):
        import math

        for i, x in enumerate(xs):
            terms = x * ys * 2.0
            want = [math.fsum(t) if np.isfinite(t).all() else t.sum() for t in terms.T]
            assert np.allclose(got[i], want, rtol=1e-13, atol=0, equal_nan=True)
    assert len(empty) == 6 and all(v.value == [0.0, 0.0] for v in empty)


def test_own_operations_reach_the_workers(spark):
    from pairloom.functions import ops

    name = "Cubed"
    if name not in ops.TABLE:
        ops.elementwise(name, 1, lambda x: x * x * x, lambda x: x * x * x)
    left, right = _sides(spark)
    x, y = Vi(left, "x", dim=3), Vj(right, "y", dim=3)
    a, b = ({r.i: r.value for r in t.sum(axis=1).collect()} for t in ((x - y).op(name), (x - y) * (x - y) * (x - y)))
    assert all(np.allclose(a[i], b[i]) for i in b) and name not in ops.BUILT_IN
