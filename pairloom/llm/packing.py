"""Operator 10: documents packed into sequences of a fixed number of tokens.

Bin completion (branch and bound) over the *histogram* of piece lengths.  Items
of one length are interchangeable, so the search state has at most ``capacity``
counters however many documents there are: around the largest length left,
fillings that no other filling dominates are listed, the chosen one is repeated
as often as the counters allow, and branches are cut by the waste that the
incumbent (a best-fit-decreasing packing) still leaves room for.

The plan: one pass that encodes texts and numbers the pieces of each length
within its task, a histogram of at most ``capacity`` rows for the search, and a
join that turns (task, length, number) into a global number.  Tokens never
leave the task that made them.
"""

from __future__ import annotations

import zlib
from collections import defaultdict, deque
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from pairloom.llm._shared import discard, id_text, materialise, prepare
from pairloom.llm.tokens import gathered, library_coder

CAPACITY = 2048
#: Nodes the search may open beyond one for each length, which a first full packing needs at most.
NODES = 200

Pattern = tuple[tuple[int, ...], int]


def best_fit_decreasing(counts: dict[int, int], capacity: int) -> list[Pattern]:
    """Best fit on a histogram: (lengths in a sequence, how many such sequences)."""
    room: dict[int, dict[tuple[int, ...], int]] = defaultdict(dict)
    for size in sorted(counts, reverse=True):
        left = counts[size]
        while left:
            fit = min((r for r in room if r >= size), default=None)
            if fit is None:
                each = capacity // size
                for per, n in ((each, left // each), (left % each, 1)):
                    if per and n:
                        key = (size,) * per
                        slot = room[capacity - per * size]
                        slot[key] = slot.get(key, 0) + n
                break
            key, n = next(iter(room[fit].items()))
            use = min(n, left)
            room[fit][key] -= use
            if not room[fit][key]:
                del room[fit][key]
            if not room[fit]:
                del room[fit]
            slot = room[fit - size]
            slot[(*key, size)] = slot.get((*key, size), 0) + use
            left -= use
    return [(k, n) for slot in room.values() for k, n in slot.items()]


def lower_bound(counts: dict[int, int], capacity: int) -> int:
    """Sequences that any packing needs: lengths above half never share one."""
    sizes = np.array(sorted(counts), np.int64)
    n = np.array([counts[s] for s in sizes.tolist()], np.int64)
    best = -(-int((sizes * n).sum()) // capacity) if len(sizes) else 0
    for k in sizes[sizes <= capacity // 2].tolist() + [0]:
        big, mid = sizes > capacity - k, (sizes > capacity // 2) & (sizes <= capacity - k)
        small = (sizes >= k) & (sizes <= capacity // 2)
        spare = int(n[mid].sum()) * capacity - int((sizes * n)[mid].sum())
        best = max(best, int(n[big].sum()) + int(n[mid].sum()) + max(0, -(-(int((sizes * n)[small].sum()) - spare) // capacity)))
    return best


def completions(counts: np.ndarray, first: int, capacity: int, tries: int = NODES, slack: int | None = None) -> Iterator[tuple[int, ...]]:
    """Undominated fillings of what ``first`` leaves: perfect ones as they are found, then least waste first.

    ``counts[s]`` items of length ``s`` are left, ``first`` already taken.  A
    single item that fills the room dominates all other fillings.  Fillings
    have any number of pieces: the last two are found at once for each of
    ``tries`` beginnings, which are taken by turns from those of no piece, one
    piece, two pieces and so on.  Of the others the ``NODES`` fillings of least
    waste are kept, none that wastes more than ``slack``.
    """
    room = capacity - first
    if room <= 0 or not counts[1 : room + 1].any():
        yield ()
        return
    if counts[room]:
        yield (room,)
        return
    slack = room if slack is None else slack
    at = np.arange(len(counts))
    largest = np.maximum.accumulate(np.where(counts > 0, at, 0))  # largest length at hand up to each
    sizes = np.flatnonzero(counts[: room + 1])[::-1]
    least = int(sizes[-1])

    def pairs(outer: tuple[int, ...], space: int) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
        """Waste and both lengths of pairs that fill ``space``, least waste first."""
        free = counts.copy()
        for x in outer:
            free[x] -= 1
        there = np.maximum.accumulate(np.where(free > 0, at, 0))
        a = sizes[(free[sizes] > 0) & (sizes <= min(outer[-1] if outer else space, space))]
        b = there[np.minimum(space - a, a)]
        b = np.where((b == a) & (free[a] < 2), there[a - 1], b)
        a, b = a[b > 0], b[b > 0]
        waste = space - a - b
        order = np.argsort(waste, kind="stable")[:NODES]
        order = order[waste[order] <= slack]
        return waste[order], a[order], b[order]

    def longer(outer: tuple[int, ...], space: int) -> Iterator[tuple[tuple[int, ...], int]]:
        for x in sizes[np.searchsorted(-sizes, -min(outer[-1] if outer else space, space - 2 * least)) :].tolist():
            if outer.count(x) < counts[x]:
                yield (*outer, x), space - x

    out: list[tuple[int, ...]] = []

    def dominated(x: tuple[int, ...]) -> bool:
        """Item for item no longer than another filling of the same number."""
        return any(len(x) <= len(y) and all(p <= q for p, q in zip(x, y, strict=False)) for y in out)

    outers: list[tuple[int, ...]] = [()]
    rest = [np.array([[room - int(largest[room])], [0], [int(largest[room])], [0]])]  # waste, beginning, two lengths
    levels: list[deque] = [deque([iter([((), room)])])]
    while tries and any(levels):
        for depth, level in enumerate(levels):
            while level and (turn := next(level[0], None)) is None:
                level.popleft()
            if not level or not tries:
                continue
            level.rotate(-1)
            tries -= 1
            outer, space = turn
            waste, a, b = pairs(outer, space)
            perfect = int((waste == 0).sum())
            for x in zip(a[:perfect].tolist(), b[:perfect].tolist(), strict=True):
                if not dominated(filling := (*outer, *x)):
                    out.append(filling)
                    yield filling
            rest.append(np.stack([waste, np.full(len(a), len(outers)), a, b])[:, perfect:])
            outers.append(outer)
            if space >= 3 * least:
                if depth + 1 == len(levels):
                    levels.append(deque())
                levels[depth + 1].append(longer(outer, space))
        if sum(x.shape[1] for x in rest) > 4 * NODES:
            rest = [_shortest(rest)]
    for _, k, a, b in _shortest(rest).T.tolist():
        filling = (*outers[k], a, b) if b else (*outers[k], a)
        if not dominated(filling):
            out.append(filling)
            yield filling


def _shortest(parts: list[np.ndarray]) -> np.ndarray:
    every = np.concatenate(parts, axis=1)
    return every[:, np.argsort(every[0], kind="stable")[:NODES]]


def bin_completion(counts: dict[int, int], capacity: int = CAPACITY, nodes: int = NODES) -> list[Pattern]:
    """As few sequences as the search finds; never more than best fit needs."""
    counts = {int(s): int(n) for s, n in counts.items() if n}
    if not counts:
        return []
    best = best_fit_decreasing(counts, capacity)
    used = sum(n for _, n in best)
    least = lower_bound(counts, capacity)
    total = sum(s * n for s, n in counts.items())
    start = np.zeros(capacity + 1, np.int64)
    for s, n in counts.items():
        start[s] = n
    # depth first; a node is (counters, patterns as a linked list, sequences, waste, longest length, fillings not yet opened)
    stack: list[tuple] = []
    nodes += len(counts)
    new: tuple | None = (start, None, 0, 0)
    while (new or stack) and nodes and used > least:
        if new:
            nodes -= 1
            left, path, bins, waste = new
            new = None
            there = np.flatnonzero(left)
            slack = (used - 1) * capacity - total - waste
            if not len(there):
                if bins < used:
                    used, best = bins, []
                    while path:
                        best.append(path[0])
                        path = path[1]
            elif slack >= 0:
                first = int(there[-1])
                rest = left.copy()
                rest[first] -= 1
                stack.append((left, path, bins, waste, first, completions(rest, first, capacity, slack=slack)))
            continue
        left, path, bins, waste, first, fillings = stack[-1]
        filling = next(fillings, None)
        if filling is None:
            stack.pop()
            continue
        whole = (first, *filling)
        need = np.bincount(whole, minlength=capacity + 1)
        times = int((left[need > 0] // need[need > 0]).min())
        spill = times * (capacity - sum(whole))
        if waste + spill <= (used - 1) * capacity - total or not filling:
            new = (left - need * times, ((whole, times), path), bins + times, waste + spill)
    return best


class Slots:
    """Where the n-th piece of a length goes, by binary search."""

    def __init__(self, patterns: list[Pattern], capacity: int):
        at: dict[int, list[tuple[int, int, int]]] = defaultdict(list)
        base = 0
        for whole, times in patterns:
            offset = 0
            for size in whole:
                at[size].append((times, base, offset))
                offset += size
            base += times
        self.first_full = base
        self.capacity = capacity
        self.at = {}
        for size, x in at.items():
            n, seq, off = (np.array(v, np.int64) for v in zip(*x, strict=True))
            self.at[size] = (np.cumsum(n) - n, seq, off)

    def place(self, length: np.ndarray, number: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
        seq, off = np.zeros(len(length), np.int64), np.zeros(len(length), np.int64)
        for size in np.unique(length).tolist():
            m = length == size
            if size == self.capacity:
                seq[m] = self.first_full + number[m]
                continue
            start, s, o = self.at[size]
            k = np.searchsorted(start, number[m], "right") - 1
            seq[m], off[m] = s[k] + number[m] - start[k], o[k]
        return seq, off


def pieces(docs: DataFrame, tokenizer: str, capacity: int, end_id: int, with_ids: bool) -> DataFrame:
    """doc_id, piece, start, length, ids_crc32[, ids], part, number: pieces numbered per task and length."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        from pyspark import TaskContext

        coder = library_coder(tokenizer)
        part = TaskContext.get().partitionId()
        seen = np.zeros(capacity + 1, np.int64)
        for batch in gathered(batches):
            ids, ends = coder.encode_flat(batch["text"])
            n = np.diff(ends, prepend=0) + 1  # with the end id
            ids = np.insert(ids, ends, end_id).astype("<u4")
            many = -(-n // capacity)
            row = np.repeat(np.arange(len(n)), many)
            piece = np.arange(len(row)) - np.repeat(np.cumsum(many) - many, many)
            head = (n - 1) % capacity + 1  # length of the first piece
            length = np.where(piece == 0, head[row], capacity)
            start = np.where(piece == 0, 0, head[row] + (piece - 1) * capacity)
            stop = np.cumsum(length)
            raw, edge = memoryview(ids).cast("B"), (4 * np.r_[0, stop]).tolist()
            crc = [zlib.crc32(raw[a:b]) for a, b in zip(edge[:-1], edge[1:], strict=True)]
            # pieces of one length are numbered in order of the task
            order = np.argsort(length, kind="stable")
            first = np.flatnonzero(np.r_[True, np.diff(length[order]) != 0]) if len(order) else order
            number = np.empty(len(order), np.int64)
            number[order] = np.arange(len(order)) - np.repeat(first, np.diff(np.r_[first, len(order)])) + seen[length[order]]
            seen += np.bincount(length, minlength=capacity + 1)
            cols = {
                "doc_id": batch["doc_id"].take(pa.array(row)),
                "piece": pa.array(piece.astype(np.int32)),
                "start": pa.array(start),
                "length": pa.array(length),
                "ids_crc32": pa.array(crc, pa.int64()),
                "ids": pa.LargeBinaryArray.from_buffers(pa.large_binary(), len(row), [None, pa.py_buffer(4 * np.r_[0, stop]), pa.py_buffer(ids)]).cast(pa.binary()) if with_ids else None,
                "part": pa.array(np.full(len(row), part, np.int32)),
                "number": pa.array(number),
            }
            yield pa.RecordBatch.from_pydict({k: v for k, v in cols.items() if v is not None})

    schema = "doc_id long, piece int, start long, length long, ids_crc32 long, " + "ids binary, " * with_ids + "part int, number long"
    return id_text(docs).mapInArrow(run, schema)


def pack(docs: DataFrame, tokenizer: str, capacity: int = CAPACITY, end_id: int = 0, with_ids: bool = False, nodes: int = NODES) -> DataFrame:
    """Pieces of all documents with their ``sequence_id`` and ``offset``.

    The search for fewer sequences opens ``nodes`` nodes beyond one for each
    length there is; then the best packing so far stands, which never needs
    more sequences than best fit.  The bound is one for the whole corpus, as
    the search is over the histogram of lengths.

    A null or empty text is the end id alone; rows that repeat are documents of
    their own; a null ``doc_id`` stays null.  Only documents longer than
    ``capacity`` are cut, and only their first piece may be shorter.  An empty
    table gives no rows.  Columns besides doc_id and text are not read.
    """
    spark = prepare(docs.sparkSession)
    cut = materialise(pieces(docs, tokenizer, capacity, end_id, with_ids), "pieces")
    counts = cut.groupBy("part", "length").agg(F.max("number").alias("top"))
    before = Window.partitionBy("length").orderBy("part").rowsBetween(Window.unboundedPreceding, -1)
    shift = counts.select("part", "length", F.coalesce(F.sum(F.col("top") + 1).over(before), F.lit(0)).alias("shift"))
    # at most one row for each length up to the capacity
    histogram = {r[0]: r[1] for r in cut.where(F.col("length") < capacity).groupBy("length").count().collect()}
    slots = Slots(bin_completion(histogram, capacity, nodes), capacity)

    def place(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            seq, off = slots.place(batch["length"].to_numpy(), batch["number"].to_numpy())
            yield pa.RecordBatch.from_arrays(
                [*(batch[n] for n in names), pa.array(seq), pa.array(off)], [*names, "sequence_id", "offset"]
            )

    names = [c for c in cut.columns if c not in ("part", "number")]
    numbered = cut.join(shift, ["part", "length"]).withColumn("number", F.col("number") + F.col("shift")).select(*names, "number")
    kinds = {f.name: f.dataType.simpleString() for f in cut.schema}
    return numbered.mapInArrow(place, ", ".join(f"{n} {kinds[n]}" for n in names) + ", sequence_id long, offset long")
