"""Operator 6: documents whose statistics are robust outliers of their kind.

One pass over the texts counts words, symbols, repeated lines and repeated
eight-word windows.  The counts become a vector of rates on stabilising scales,
and each (language, source) gets a minimum-covariance-determinant estimate:
from a median/MAD start and from small random subsets, concentration steps
re-estimate mean and covariance on the three quarters of the rows nearest to
the estimate before, until no determinant moves; the estimate of the smallest
determinant stays.  Every step is two aggregations over a narrow table, with
quantile sketches and moment sums that combine before any shuffle; estimates, a
small row for each group, are broadcast to the rows after their number is
checked.  So a source that holds a third of all rows is no task's burden.
Variances have a floor, as in the regularised estimator: most clean documents
have no symbols or repeats at all, and a zero covariance would reject the first
that has one.

A document is rejected if its squared Mahalanobis distance passes ``CUTOFF``.
"""

from __future__ import annotations

import math
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from pairloom.llm._shared import discard, free_name, materialise, prepare

WINDOW = 8
MIN_WORDS = 20
MAX_REPEAT_PERCENT = 30
SYMBOLS = "#*$%&|<>"

#: Rows a step keeps; half the breakdown of the median start remains.
KEEP = 0.75
#: Concentration steps at most; they end as soon as no logarithm of a determinant moves by ``SETTLED``.
#: A group whose estimate still moves then is marked (column ``settled``).
STEPS = 40
SETTLED = 0.01
#: Random starts beside the median/MAD one, and about how many rows of a group each begins with.
STARTS = 2
PICKS = 40
#: Estimates up to this many are broadcast (about 300 bytes each).
BROADCAST_ROWS = 100_000
#: Groups whose sums one task puts together and turns into estimates.
GROUPS_PER_TASK = 5_000
#: Groups with fewer rows are estimated with all small groups of their language.
MIN_ROWS = 100
DIMENSIONS = 4
#: Coordinates are multiples of one over this, so that their sums are exact.
GRID = 2**20
#: Ranks are exact among multiples of one over this; a bin has ``BIN`` of them, and what is above ``FAR`` counts as that.
UNIT, BIN, FAR = 2**12, 2**8, 1e9
#: Standard deviations that a coordinate is allowed at least.  Where the core of a group has no
#: symbols or repeats these decide: each must let its rate alone pass ``CUTOFF`` (repeated words
#: at 26 %, before the base rule's 30 %).
FLOORS = (0.06, 0.6, 0.4, 0.3)
#: Chi-square with four degrees of freedom lies above this once in a thousand.
CUTOFF = 18.47

COUNTS = ("n_words", "word_chars", "n_symbols", "n_dup_lines", "n_repeat_words")


def repeated_words(words: list[bytes], window: int = WINDOW) -> int:
    """Words within windows of ``window`` words that the text has twice or more."""
    n = len(words)
    if n <= window:
        return 0
    number: dict[bytes, int] = {}
    ids = np.fromiter((number.setdefault(w, len(number)) for w in words), np.int64, n)
    if len(number) == n:
        return 0
    # numbers of windows of 2, 4, 8 words from those of half as many: exact, no hash
    size = 1
    while size < window:
        pair = ids[:-size] * (int(ids.max()) + 1) + ids[size:]
        order = np.sort(pair)
        kinds = order[np.r_[True, order[1:] != order[:-1]]]
        ids = np.searchsorted(kinds, pair)
        if len(kinds) == len(pair):
            return 0
        size *= 2
    often = np.bincount(ids)[ids] > 1
    edge = np.zeros(n + 1, np.int64)
    np.add.at(edge, np.flatnonzero(often), 1)
    np.add.at(edge, np.flatnonzero(often) + window, -1)
    return int((np.cumsum(edge)[:n] > 0).sum())


def count_text(text: str | None) -> tuple[int, int, int, int, int]:
    """``COUNTS`` of one text; a null text has no words."""
    text = text or ""
    words = text.encode("utf-8", "surrogatepass").split()  # bytes split at exactly x20, x09-x0D
    blank = sum(map(text.count, " \t\n\v\f\r"))
    lines = [x for x in text.split("\n") if x.strip(" \t\v\f\r")] if "\n" in text else ()
    return (
        len(words),
        len(text) - blank,
        sum(map(text.count, SYMBOLS)),
        len(lines) - len(set(lines)),
        repeated_words(words),
    )


def statistics(docs: DataFrame) -> DataFrame:
    """doc_id, lang, source and ``COUNTS`` of each row."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in batches:
            rows = [count_text(t.as_py()) for t in b["text"]]
            cols = list(zip(*rows, strict=True)) if rows else [[]] * 5
            yield pa.RecordBatch.from_arrays(
                [b["doc_id"], b["lang"], b["source"], *(pa.array(c, pa.int64()) for c in cols)], ["doc_id", "lang", "source", *COUNTS]
            )

    prepare(docs.sparkSession)
    cols = [F.col("doc_id").cast("long").alias("doc_id")] + [F.col(c).cast("string").alias(c) for c in ("lang", "source", "text")]
    return docs.select(*cols).mapInArrow(run, "doc_id long, lang string, source string, " + ", ".join(f"{c} long" for c in COUNTS))


def base_failed() -> Column:
    return (F.col("n_words") < MIN_WORDS) | (100 * F.col("n_repeat_words") > MAX_REPEAT_PERCENT * F.col("n_words"))


def vector() -> list[Column]:
    """Length is no fault and is left out; rates are per word or line, on log scales."""
    words = F.greatest(F.col("n_words"), F.lit(1)).cast("double")
    return [
        F.log(F.greatest(F.col("word_chars"), F.lit(1)) / words),
        F.log1p(100.0 * F.col("n_symbols") / words),
        F.log1p(100.0 * F.col("n_dup_lines") / words),
        F.log1p(10.0 * F.col("n_repeat_words") / words),
    ]


def _joined(rows: DataFrame, small: DataFrame, on: str | list[str], many: int, how: str = "inner") -> DataFrame:
    """``rows`` with the rows of ``small`` for their group: without a shuffle of ``rows`` if those are not ``many``."""
    return rows.join(F.broadcast(small) if many <= BROADCAST_ROWS else small, on, how)


def _moments(rows: DataFrame) -> DataFrame:
    """key, start, n, sums and cross sums in units of ``GRID`` and its square: exact, as decimals."""
    xs = [(F.col(f"x{i}") * GRID).cast("long") for i in range(DIMENSIONS)]
    total = lambda c: F.sum(c.cast("decimal(20,0)"))
    return rows.groupBy("key", "start").agg(
        F.count(F.lit(1)).alias("n"),
        F.array(*(total(x) for x in xs)).alias("s"),
        F.array(*(total(a * b) for a in xs for b in xs)).alias("c"),
    )


def _ranked(rows: DataFrame, by: list[str], value: Column, share: float, many: int) -> DataFrame:
    """``by``, rank: the least unit that at least ``share`` of a group's rows do not exceed.

    Counted by bins, then by units in the bin that has the rank: two tables of a
    bounded number of counters for each group, whatever its rows.
    """
    units = F.floor(F.least(F.greatest(value, F.lit(-FAR)), F.lit(FAR)) * UNIT)
    rows = rows.select(*by, units.alias("_u")).withColumn("_b", F.floor(F.col("_u") / BIN))
    up = Window.partitionBy(*by)
    bins = rows.groupBy(*by, "_b").agg(F.count(F.lit(1)).alias("_n")).withColumns({"_upto": F.sum("_n").over(up.orderBy("_b")), "_all": F.sum("_n").over(up)})
    need = F.greatest(F.ceil(F.col("_all") * share), F.lit(1))
    least = F.min(F.when(F.col("_upto") >= need, F.struct("_b", (need - (F.col("_upto") - F.col("_n"))).alias("_need"))))
    found = bins.groupBy(*by).agg(least.alias("_f")).select(*by, "_f.*")
    inside = _joined(rows, found, [*by, "_b"], many).groupBy(*by, "_u").agg(F.count(F.lit(1)).alias("_n"), F.first("_need").alias("_need"))
    inside = inside.withColumn("_upto", F.sum("_n").over(up.orderBy("_u")))
    return inside.where(F.col("_upto") >= F.col("_need")).groupBy(*by).agg(F.min("_u").alias("rank"))


def _medians(rows: DataFrame, many: int) -> DataFrame:
    """key, center: the median of each coordinate, to a unit."""
    tall = rows.select("key", F.posexplode(F.array(*(f"x{i}" for i in range(DIMENSIONS)))).alias("at", "v"))
    of = lambda i: F.max(F.when(F.col("at") == i, F.col("rank"))) / UNIT
    return _ranked(tall, ["key", "at"], F.col("v"), 0.5, many * DIMENSIONS).groupBy("key").agg(F.array(*(of(i) for i in range(DIMENSIONS))).alias("center"))


def _few(sums: DataFrame, many: int) -> DataFrame:
    """Aggregates of ``many`` groups in as few tasks as they need: one group is one small row."""
    return sums.coalesce(max(1, many // GROUPS_PER_TASK))


def _estimate(rows: DataFrame) -> DataFrame:
    """key, start, center, precision, logdet from moments: one small row for each group and start."""
    p = DIMENSIONS
    # how far the covariance of the central KEEP of a normal cloud falls short (even degrees have closed forms)
    low, high = 0.0, 100.0
    for _ in range(80):
        mid = (low + high) / 2
        low, high = (mid, high) if 1 - math.exp(-mid / 2) * (1 + mid / 2) < KEEP else (low, mid)
    factor = KEEP / (1 - math.exp(-low / 2) * (1 + low / 2 + low * low / 8))
    floors = np.diag(np.array(FLOORS) ** 2)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in batches:
            n = np.maximum(b["n"].to_numpy(zero_copy_only=False), 1)[:, None]
            s = np.array(b["s"].to_pylist(), float).reshape(-1, p) / n / GRID
            c = np.array(b["c"].to_pylist(), float).reshape(-1, p, p) / n[:, :, None] / GRID**2 - s[:, :, None] * s[:, None, :]
            cov = factor * (c + c.transpose(0, 2, 1)) / 2 + floors
            inv = np.linalg.inv(cov) if len(s) else np.zeros((0, p, p))
            det = np.linalg.slogdet(cov)[1] if len(s) else np.zeros(0)
            arrays = [pa.array(list(x), pa.list_(pa.float64())) for x in (s, inv.reshape(-1, p * p))]
            yield pa.RecordBatch.from_arrays([b["key"], b["start"], *arrays, pa.array(det)], ["key", "start", "center", "precision", "logdet"])

    return rows.mapInArrow(run, "key string, start int, center array<double>, precision array<double>, logdet double")


def _distance() -> Column:
    p = DIMENSIONS
    d = [F.col(f"x{i}") - F.col("center")[i] for i in range(p)]
    return sum((F.col("precision")[i * p + j] * d[i] * d[j] * (1 if i == j else 2) for i in range(p) for j in range(i, p)), F.lit(0.0))


def estimates(vectors: DataFrame) -> DataFrame:
    """key, center, precision, settled: the minimum-covariance-determinant estimate of each key."""
    p = DIMENSIONS
    xs = [F.col(f"x{i}") for i in range(p)]
    sizes = materialise(vectors.groupBy("key").agg(F.count(F.lit(1)).alias("rows")), "mcd")
    many = sizes.count() * (STARTS + 1)  # rows of every small table below, at most
    middle = materialise(_few(_medians(vectors, many).join(sizes, "key"), many), "mcd")
    away = _joined(vectors, middle, "key", many).select("key", *(F.abs(x - F.col("center")[i]).alias(f"x{i}") for i, x in enumerate(xs)))
    apart = _few(_medians(away, many).withColumnRenamed("center", "away").join(middle, "key"), many)
    # a normal deviate is 1.4826 median absolute deviations
    spread = [F.pow(1.4826 * F.col("away")[i], 2) + FLOORS[i] ** 2 for i in range(p)]
    mad = F.array(*(1 / spread[i] if i == j else F.lit(0.0) for i in range(p) for j in range(p))).alias("precision")
    now = apart.select("key", F.lit(0).alias("start"), "center", mad, F.lit(None).cast("double").alias("logdet"))
    # rows whose hash falls low: which ones depends on the rows alone, so a lost task makes the same start again
    start = F.explode(F.array(*(F.lit(k) for k in range(1, STARTS + 1)))).alias("start")
    picked = _joined(vectors, sizes, "key", many).select("key", "rows", *xs, start).where(F.pmod(F.xxhash64(*xs, "start"), F.col("rows")) < PICKS)
    now = materialise(now.unionByName(_estimate(_few(_moments(picked), many))), "mcd")
    before, settled = None, now.select("key").distinct().withColumn("settled", F.lit(False))
    for step in range(1, STEPS + 1):
        near = _joined(vectors, now, "key", many).withColumn("d2", _distance())
        edge = _few(_ranked(near, ["key", "start"], F.col("d2"), KEEP, many), many)
        core = _joined(near, edge, ["key", "start"], many).where(F.col("d2") * UNIT < F.col("rank") + 1)
        after = materialise(_estimate(_few(_moments(core), many)), "mcd")
        if before is not None:
            discard(before)
        before, now = now, after
        moved = F.coalesce(F.abs(F.col("logdet") - F.col("old")) >= SETTLED, F.lit(True))
        old = before.select("key", "start", F.col("logdet").alias("old"))
        settled = _few(now.join(old, ["key", "start"]).groupBy("key").agg((~F.max(moved)).alias("settled")), many)
        if step == STEPS or settled.where(~F.col("settled")).isEmpty():
            break
    best = F.min_by(F.struct("center", "precision"), F.struct("logdet", "start")).alias("m")
    out = materialise(_few(now.groupBy("key").agg(best).select("key", "m.center", "m.precision").join(settled, "key"), many), "mcd")
    discard(now, middle, sizes, *([before] if before is not None else []))
    return out


def judge(docs: DataFrame, min_rows: int = MIN_ROWS) -> DataFrame:
    """doc_id, lang, source, ``COUNTS``, base_failed, distance, kept, settled for every row.

    A null text has no words and fails the base rules; null languages and
    sources are kinds of their own; repeated rows are judged alike; an empty
    table gives no rows; other columns are not read.  A document that fails the
    base rules takes no part in the estimates and has a null distance.
    ``settled`` is false where a group's estimate still moved after ``STEPS``
    steps, and null where there is none.  A group of fewer than ``min_rows`` rows is estimated with all such groups of its
    language, and if those together have fewer too, with those of all languages:
    a covariance of four rates from a handful of rows says nothing.
    """
    counted = materialise(statistics(docs), "statistics")
    good = counted.withColumn("base_failed", base_failed())
    name = lambda c: F.coalesce(F.concat(F.lit("="), F.col(c)), F.lit("-"))
    tall = good.withColumn("lang_key", name("lang")).withColumn("key", F.concat_ws("\t", name("lang"), name("source")))
    groups = tall.where(~F.col("base_failed")).groupBy("key", "lang_key").count()
    small = groups.where(F.col("count") < min_rows)
    by_lang = small.groupBy("lang_key").agg(F.sum("count").alias("of_lang"))
    pooled = F.when(F.col("of_lang") >= min_rows, F.concat(F.lit("lang\t"), F.col("lang_key"))).otherwise(F.lit("rest"))
    renamed = materialise(small.join(by_lang, "lang_key").select("key", pooled.alias("pool")), "pools")
    keyed = _joined(tall, renamed, "key", renamed.count(), "left").withColumn("key", F.coalesce("pool", "key"))
    for i, x in enumerate(vector()):
        keyed = keyed.withColumn(f"x{i}", F.round(x * GRID) / GRID)
    vectors = materialise(keyed.where(~F.col("base_failed")).select("key", *(f"x{i}" for i in range(DIMENSIONS))), "vectors")
    model = estimates(vectors)
    discard(vectors)
    judged = _joined(keyed, model, "key", model.count(), "left").withColumn("distance", F.when(~F.col("base_failed"), _distance()))
    kept = ~F.col("base_failed") & F.coalesce(F.col("distance") <= CUTOFF, F.lit(True))
    return judged.select("doc_id", "lang", "source", *COUNTS, "base_failed", "distance", kept.alias("kept"), "settled")


def keep_good(docs: DataFrame) -> DataFrame:
    """The rows of ``docs`` that ``judge`` keeps, with all their columns.

    Rows with one ``doc_id`` are judged each by its own text and kept together
    if any of them is; a row with a null id is kept if any such row is.
    """
    name = free_name(docs, "kept_id")
    verdict = judge(docs).where("kept").select(F.col("doc_id").alias(name)).distinct()
    return docs.join(verdict, docs["doc_id"].eqNullSafe(F.col(name)), "left_semi")
