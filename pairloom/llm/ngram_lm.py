"""Operator 7: stupid-backoff scores, from count tables partitioned by hash.

Relationally: n-grams of all documents are counted, the counts joined to each
document's n-grams by hash, and the logarithms of the scores summed for each
document.  Rows of that join are kept in bulk: a block of texts sends its
distinct n-grams, sorted and as differences, to the partitions of their hash
ranges; a partition adds up what all blocks sent and answers each block in the
order it asked.  Counts of a block are combined before anything moves, so a
word that is everywhere is one entry for each block.  (A row for every n-gram
of a block would be about 630 million rows for a gigabyte of input, and more to
move than the limit of four times the input.)

A document is scored against all others: its own n-grams are taken out of the
counts first.  With c the counts without it,

  S(w | u v) = c(u v w) / c(u v)  if c(u v w) > 0, else BACKOFF * S(w | v)
  S(w | v)   = c(v w) / c(v)      if c(v w) > 0,   else BACKOFF * S(w)
  S(w)       = c(w) / c()         if c(w) > 0,     else BACKOFF / (c() + 1)

where c() is the number of all words: the count of the empty n-gram.
"""

from __future__ import annotations

import hashlib
import uuid
from collections.abc import Callable, Iterator
from functools import partial

import numpy as np
import pyarrow as pa
from pyarrow.fs import FileType
from pyspark.sql import DataFrame

from pairloom.llm._shared import ARROW_BATCH_BYTES, block_size, filesystem, give_back, id_text, new_folder, partitions, prepare
from pairloom.llm.suffix_dedup import _groups, _lean, _pack, _read, _squeeze, _swell, _unpack, _write
from pairloom.llm.words import run_hashes, word_hashes

ORDER = 3
BACKOFF = 0.4
#: n-grams are told apart by so many bits of their hash.
_BITS = np.uint64(16)
_EMPTY = np.uint64(0)
_UPPER = "ABCDEFGHIJKLMNOPQRSTUVWXYZ"
#: Digits behind the point that the query shows of a score.
DIGITS = 6


def _grams(words: np.ndarray) -> list[np.ndarray]:
    """48-bit hashes of the n-grams that end at each word, by order; entry i - n + 1 for a word i."""
    return [run_hashes(words, n) >> _BITS if len(words) >= n else words[:0] for n in range(1, ORDER + 1)]


def _first(s: np.ndarray) -> np.ndarray:
    """Whether each of some sorted values is the first of its kind."""
    first = np.ones(len(s), bool)
    np.not_equal(s[1:], s[:-1], out=first[1:])
    return first


def _runs(s: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """Distinct values of sorted ones and how often each occurs."""
    at = np.flatnonzero(_first(s))
    return s[at], np.diff(at, append=len(s))


def _distinct(x: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """Sorted distinct values and how often each occurs."""
    return _runs(np.sort(x))


def _texts(table: pa.Table) -> list[np.ndarray]:
    return word_hashes(_raw(table), lower=True)


def _raw(table: pa.Table) -> list[bytes]:
    return table["text"].cast(pa.binary()).to_pylist()


def _block_grams(words: list[np.ndarray]) -> np.ndarray:
    """Sorted n-grams of a block, as often as they occur; the empty one comes first and once more than hashes are equal to it."""
    grams = np.empty(1 + sum(max(len(w) - n, 0) for w in words for n in range(ORDER)), np.uint64)
    grams[0], at = _EMPTY, 1
    for w in words:
        for g in _grams(w):
            grams[at : at + len(g)] = g
            at += len(g)
    grams.sort()
    return grams


def _write_once(uri: str, table: pa.Table) -> None:
    """The file appears whole or not at all; of attempts that write the same rows the first counts."""
    fs, path = filesystem(uri)
    draft = f"{path}.{uuid.uuid4().hex}"
    if fs.get_file_info(path).type != FileType.NotFound:
        return
    _write(uri.removesuffix(path.rpartition("/")[2]) + draft.rpartition("/")[2], table)
    try:
        fs.move(draft, path)
    except OSError:  # some stores refuse to move onto a file: then another attempt was first
        if fs.get_file_info(path).type == FileType.NotFound:
            raise
        fs.delete_file(draft)


def _file(folder: str, name: bytes) -> str:
    """The URI of a block's texts: rows carry sixteen bytes, not a path."""
    return f"{folder}/{name.hex()}"


def _digest(table: pa.Table) -> bytes:
    """Eight bytes of a hash of the rows, in their order."""
    h = hashlib.blake2b(repr(table["doc_id"].to_pylist()).encode(), digest_size=8)
    for raw in _raw(table):
        h.update(len(raw).to_bytes(8))
        h.update(raw)
    return h.digest()


def _by_range(words: list[np.ndarray], many: int) -> Iterator[tuple[int, np.ndarray, np.ndarray]]:
    """(range, distinct n-grams, their counts) of a block whose words are used up; but for its sorted n-grams one range is held at a time."""
    total = sum(map(len, words))
    grams = _block_grams(words)
    words.clear()
    cut = np.searchsorted(grams, np.arange(1, many, dtype=np.uint64) * np.uint64((1 << 48) // many + 1))
    for bucket, (a, b) in enumerate(zip([0, *cut.tolist()], [*cut.tolist(), len(grams)], strict=True)):
        if a < b:
            some, counts = _runs(grams[a:b])
            counts[:1] += (total - 1) * (a == 0)
            yield bucket, some, counts


_ASKED = pa.schema([("block", pa.binary()), ("bucket", pa.int32()), ("n", pa.int32()), ("grams", pa.binary()), ("counts", pa.binary())])


def _ask(folder: str, many: int, block_bytes: int) -> Callable:
    def close(batches: list[pa.RecordBatch], part: int, number: int) -> Iterator[pa.RecordBatch]:
        # the name says which texts these are: a retried task writes the same file again, or with other rows another
        table = pa.Table.from_batches(batches)
        batches.clear()
        name = part.to_bytes(4) + number.to_bytes(4) + _digest(table)
        _write_once(_file(folder, name), table)
        words = _texts(table)
        del table
        rows: list[tuple] = []
        size = 0
        for bucket, grams, counts in _by_range(words, many):
            rows.append((name, bucket, len(grams), _pack(grams), _squeeze(counts)))
            size += len(rows[-1][3]) + len(rows[-1][4])
            if size >= ARROW_BATCH_BYTES:
                yield _rows(rows)
                rows, size = [], 0
        if rows:
            yield _rows(rows)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        from pyspark import TaskContext

        part, number, held, size = TaskContext.get().partitionId(), 0, [], 0
        for b in batches:
            held.append(b)
            size += b["text"].nbytes
            del b  # else it stays beside the block's n-grams
            if size >= block_bytes:
                yield from close(held, part, number)
                give_back()
                size, number = 0, number + 1
        if held:
            yield from close(held, part, number)

    return run


def _rows(rows: list[tuple]) -> pa.RecordBatch:
    return pa.RecordBatch.from_arrays([pa.array(x, f.type) for x, f in zip(zip(*rows, strict=True), _ASKED, strict=True)], schema=_ASKED)


def _join(parts: pa.ChunkedArray, sizes: list[int], kind, read: Callable) -> np.ndarray:
    """What ``read`` makes of each part and its size, one after another."""
    out, at = np.empty(sum(sizes), kind), 0
    for x, n in zip(parts, sizes, strict=True):
        out[at : at + n] = read(x.as_py(), n)
        at += n
    return out


def _counts(b: bytes, n: int) -> np.ndarray:
    return _swell(b, n, np.int64)


def _totals(bucket: int, t: pa.Table) -> pa.RecordBatch:
    size = t["n"].to_pylist()
    grams = _join(t["grams"], size, np.uint64, lambda x, n: _unpack(x))
    order = np.argsort(grams, kind="stable")
    grams = grams[order]
    at = np.flatnonzero(_first(grams))
    del grams
    sums = np.add.reduceat(_join(t["counts"], size, np.int64, _counts)[order], at)
    total = np.empty(len(order), np.int64)
    total[order] = np.repeat(sums, np.diff(at, append=len(order)))
    del order, at, sums
    ends = np.cumsum(size).tolist()
    parts = [_squeeze(total[e - n : e]) for e, n in zip(ends, size, strict=True)]
    return pa.RecordBatch.from_arrays([t["block"].combine_chunks(), pa.array([bucket] * len(size), pa.int32()), pa.array(size, pa.int32()), pa.array(parts, pa.binary())], ["block", "bucket", "n", "totals"])


def _add_up(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    for bucket, t in _groups(batches, "bucket"):
        yield _totals(bucket, t)


def _score_text(words: np.ndarray, grams: np.ndarray, totals: np.ndarray) -> tuple[float, int]:
    """Sum of ln S over the words, and how many backed off."""
    n = len(words)
    if not n:
        return 0.0, 0
    every = _grams(words)
    own, count = _distinct(np.concatenate(every))
    rest = totals[np.searchsorted(grams, own)] - count
    if grams[0] == _EMPTY and own[0] == _EMPTY:
        rest[0] -= n
    at = [rest[np.searchsorted(own, g)] for g in every]  # counts without this text
    words_left = totals[0] - n
    with np.errstate(divide="ignore", invalid="ignore"):
        score = np.where(at[0] > 0, at[0] / max(words_left, 1), BACKOFF / (words_left + 1))
        backed = np.zeros(n, bool)
        for k in range(1, ORDER):
            g = at[k]
            if not len(g):
                break
            seen = g > 0
            score[k:] = np.where(seen, g / at[k - 1][: len(g)], BACKOFF * score[k:])
            backed[k:] = ~seen
    return float(np.log(score).sum()), int(backed.sum())


def _score_block(folder: str, name: bytes, t: pa.Table) -> pa.RecordBatch:
    table = _read(_file(folder, name))
    ids, words = table["doc_id"].combine_chunks(), _texts(table)
    del table
    grams = _block_grams(words)
    grams = grams[_first(grams)]
    totals = _join(t["totals"], t["n"].to_pylist(), np.int64, _counts)
    scores = [_score_text(w, grams, totals) for w in words]
    return pa.RecordBatch.from_arrays(
        [ids, pa.array([len(w) for w in words], pa.int64()), pa.array([s for s, _ in scores], pa.float64()), pa.array([b for _, b in scores], pa.int64())],
        ["doc_id", "n_words", "log_score", "n_backed_off"],
    )


def _score(folder: str, batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    for name, t in _groups(batches, "block"):
        yield _score_block(folder, name, t)
        give_back()


def score_documents(docs: DataFrame, block_bytes: int | None = None) -> DataFrame:
    """doc_id, n_words, log_score (sum of ln S), n_backed_off for every row.

    Words are maximal runs of anything but ASCII white space, ASCII lower case.
    Null and empty texts have no words and score 0; rows that repeat are
    documents of their own and count for each other; an empty table gives no
    rows; other columns are not read.
    """
    spark = prepare(docs.sparkSession)
    many, folder = partitions(spark), new_folder(spark, "grams")
    asked = id_text(docs).mapInArrow(_lean(_ask(folder, 4 * many, block_bytes or block_size(4 * many))), "block binary, bucket int, n int, grams binary, counts binary")
    to_range = asked.repartition(many, "bucket").sortWithinPartitions("bucket", "block")
    answered = to_range.mapInArrow(_lean(_add_up), "block binary, bucket int, n int, totals binary")
    to_block = answered.repartition(many, "block").sortWithinPartitions("block", "bucket")
    return to_block.mapInArrow(_lean(partial(_score, folder)), "doc_id long, n_words long, log_score double, n_backed_off long")


def oracle() -> str:
    """The scores by joins of rows: exploded n-grams, count tables, sums for each document."""
    count = lambda k: f"coalesce(c{k}.n, 0)"
    return rf"""
WITH w AS (SELECT doc_id, row_number() OVER () AS d, list_filter(regexp_split_to_array(translate(coalesce(text, ''), '{_UPPER}', '{_UPPER.lower()}'), '[ \t-\r]+'), lambda x: x <> '') AS ws FROM documents),
p AS (SELECT d, i, ws[i] AS w1, CASE WHEN i >= 2 THEN ws[i - 1] || ' ' || ws[i] END AS w2, CASE WHEN i >= 3 THEN ws[i - 2] || ' ' || ws[i - 1] || ' ' || ws[i] END AS w3
  FROM (SELECT d, ws, unnest(range(1, len(ws) + 1)) AS i FROM w)),
g AS (SELECT d, g, count(*) AS n FROM (SELECT d, w1 AS g FROM p UNION ALL SELECT d, w2 FROM p UNION ALL SELECT d, w3 FROM p) WHERE g IS NOT NULL GROUP BY d, g),
t AS (SELECT g, sum(n) AS n FROM g GROUP BY g),
r AS (SELECT d, g, t.n - g.n AS n FROM g JOIN t USING (g)),
a AS (SELECT sum(len(ws)) AS words FROM w),
c AS (SELECT p.d, p.i, {count(1)}::DOUBLE AS n1, {count(2)}::DOUBLE AS n2, {count(3)}::DOUBLE AS n3
  FROM p LEFT JOIN r c1 ON c1.d = p.d AND c1.g = p.w1 LEFT JOIN r c2 ON c2.d = p.d AND c2.g = p.w2 LEFT JOIN r c3 ON c3.d = p.d AND c3.g = p.w3),
s AS (SELECT c.*, lag(n1) OVER (PARTITION BY d ORDER BY i) AS before1, lag(n2) OVER (PARTITION BY d ORDER BY i) AS before2, (a.words - len(w.ws))::DOUBLE AS rest FROM c JOIN w USING (d), a),
s1 AS (SELECT *, CASE WHEN n1 > 0 THEN n1 / greatest(rest, 1) ELSE {BACKOFF}::DOUBLE / (rest + 1) END AS x1 FROM s),
s2 AS (SELECT *, CASE WHEN i < 2 THEN x1 WHEN n2 > 0 THEN n2 / before1 ELSE {BACKOFF}::DOUBLE * x1 END AS x2 FROM s1),
s3 AS (SELECT *, CASE WHEN i < 3 THEN x2 WHEN n3 > 0 THEN n3 / before2 ELSE {BACKOFF}::DOUBLE * x2 END AS x3 FROM s2),
f AS (SELECT d, sum(ln(x3)) AS score, count(*) FILTER ((i = 2 AND n2 = 0) OR (i > 2 AND n3 = 0)) AS backed FROM s3 GROUP BY d)
SELECT CAST(doc_id AS BIGINT) AS doc_id, CAST(len(ws) AS BIGINT) AS n_words, round(coalesce(score, 0::DOUBLE), {DIGITS}) + 0.0::DOUBLE AS log_score, CAST(coalesce(backed, 0) AS BIGINT) AS n_backed_off
FROM w LEFT JOIN f USING (d)"""
