"""Operator 9: documents whose shingle sets overlap, by R-trees over count vectors.

Shingles are hashed into groups, and a set becomes the point of its group
counts; the number of groups grows with the set, so that a group has about
``PER_GROUP`` shingles at most.  Two sets share at most the sum of their
coordinate minima; a box of points bounds that sum from above by its upper
corner.  An R-tree over points thus rules out whole branches, and the pairs
left are verified exactly.

One tree over everything would be asked by every document, and with these
similarities prunes little by position alone.  So there is a forest: a tree for
each shingle that sets have among their first few in one global order.  Sets
that are similar enough always share one of those (the order puts frequent
shingles last, so that no shingle of everyone's makes a tree of everyone).

 1. sets, points, first shingles; sets that are equal become one.
 2. a tree per first shingle; pairs that survive the bound, as a forest.  A
    shingle of more than ``HOT`` sets has several trees, in order of size, and
    the boxes of what each connects are compared afterwards.
 3. components of those: cells that no true link leaves.
 4. a cell's sets are verified in blocks, each set in one block; of what a
    block connects one set goes on to the next round, until one block is left.
    A cell that became one component is done.
 5. of other cells of several blocks, pairs that survive the bound, were in
    different blocks and are not connected yet are looked for with the trees
    again, and verified by pairs of blocks that have any.
 6. components of the verified links, carried back to equal sets.

Within a tree and a block, pairs whose ends are already connected are passed
over, so a group of near copies costs about its size, not its square, and a
text moves once for each round it is in, whatever the size of its cell.
"""

from __future__ import annotations

from collections.abc import Callable, Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from pairloom.llm._shared import discard, free_name, id_text, materialise, partitions, prepare, release, worker_cache
from pairloom.llm.components import connected_components, star_forest
from pairloom.llm.words import mix, shingle_sets

#: Groups of the smallest points; those of larger sets double until a group has ``PER_GROUP`` shingles.
#: Counts of random sets differ by about 0.6 of a root of their mean, so at most a fifth of eight
#: and more of fewer: what two sets seem to share by chance stays below what similar ones share.
GROUPS = 128
PER_GROUP = 8
LEAF = 32
FAN = 16
#: Sets in a block of a cell, and about as many shingles in all.
BLOCK = 128
BLOCK_SHINGLES = 1_500_000
#: Sets in one tree.
HOT = 2048
#: Boxes of one shingle that are compared pair by pair; of more, neighbours in size are joined unseen.
BOXES = 4096
#: Shingles known as frequent: 16 bytes each, at most so many on every executor.
FREQUENT = 65_536
#: Texts of a task that make a shingle a candidate for that.
OFTEN = 6
#: A round that leaves more of its sets than this share settles nothing any more.
STALLED = 0.7
#: Rows of a later round that may be broadcast, below 100 bytes each.
BROADCAST_TASKS = 200_000
#: Rows of one long each that may be broadcast.
BROADCAST_ROWS = 2_000_000

#: A count that does not fit a byte; it bounds nothing.
_FULL = 255
_ENDLESS = 2**30


def groups_of(n: int) -> int:
    """Groups of a set of ``n`` shingles: a power of two times ``GROUPS``, at most 128 times.

    Sets of more than a million shingles are bounded less tightly for it; a tree
    of ``HOT`` such points stays below 200 MB.
    """
    return GROUPS << min(7, max(0, -(-n // (PER_GROUP * GROUPS)) - 1).bit_length())


def points(sets: list[np.ndarray]) -> list[np.ndarray]:
    """Group counts of each set, of as many groups as its size has."""
    return [np.bincount((s & np.uint64(groups_of(len(s)) - 1)).astype(np.int64), minlength=groups_of(len(s))).astype(np.int32) for s in sets]


def pack_point(p: np.ndarray) -> bytes:
    return np.minimum(p, _FULL).astype(np.uint8).tobytes()


def unpack_point(b: bytes) -> np.ndarray:
    p = np.frombuffer(b, np.uint8).astype(np.int32)
    p[p == _FULL] = _ENDLESS
    return p


def folded(pts: list[np.ndarray], groups: int) -> np.ndarray:
    """The points of the same sets for fewer groups; counts that bound nothing go on bounding nothing."""
    out = np.empty((len(pts), groups), np.int32)
    width = np.array([len(p) for p in pts])
    for w in np.unique(width).tolist():
        at = np.flatnonzero(width == w)
        same = np.concatenate([pts[k] for k in at.tolist()]).reshape(len(at), -1, groups)
        if same.dtype == np.uint8:  # packed
            same = np.where(same == _FULL, _ENDLESS, same.astype(np.int32))
        out[at] = np.minimum(same.sum(1, dtype=np.int64), _ENDLESS)
    return out


class CountTree:
    """R-tree over count vectors, packed by total and widest coordinate.

    ``percent``: sets link when 100 * shared >= percent * union, which is
    (100 + percent) * shared >= percent * (sum of both sizes).
    """

    def __init__(self, pts: np.ndarray, percent: int, total: np.ndarray):
        self.percent = percent
        order = np.argsort(total, kind="stable")
        slab = LEAF * FAN
        for at in range(0, len(order), slab):  # within a slab of like totals, by the coordinate that spreads most
            part = order[at : at + slab]
            wide = int(np.argmax(np.ptp(pts[part], axis=0)))
            order[at : at + slab] = part[np.argsort(pts[part, wide], kind="stable")]
        self.order, self.pts, self.total = order, pts[order], total[order]
        #: from the leaves up: upper corners, smallest and largest totals
        self.levels: list[tuple[np.ndarray, np.ndarray, np.ndarray]] = []
        high, low_n, high_n, step = self.pts, self.total, self.total, LEAF
        while len(high) > 1:
            cut = np.arange(0, len(high), step)
            high, low_n, high_n = np.maximum.reduceat(high, cut), np.minimum.reduceat(low_n, cut), np.maximum.reduceat(high_n, cut)
            self.levels.append((high, low_n, high_n))
            step = FAN

    def label(self, component: np.ndarray) -> None:
        """Tells each node the smallest and largest component below it."""
        low = high = component[self.order]
        self.labels, step = [], LEAF
        for _ in self.levels:
            cut = np.arange(0, len(low), step)
            low, high = np.minimum.reduceat(low, cut), np.maximum.reduceat(high, cut)
            self.labels.append((low, high))
            step = FAN

    def survivors(self, point: np.ndarray, n: int, own: int | None = None) -> np.ndarray:
        """Places (in the order given at first) of the points that the bound doesn't rule out.

        With ``own`` also without nodes that are all of that component.
        """
        p = self.percent
        alive = None
        for depth in range(len(self.levels) - 1, -1, -1):
            high, low_n, high_n = self.levels[depth]
            alive = np.arange(len(high)) if alive is None else (alive[:, None] * FAN + np.arange(FAN)).ravel()
            alive = alive[alive < len(high)]
            if own is not None:
                low, top = self.labels[depth]
                alive = alive[(low[alive] != own) | (top[alive] != own)]
            high, low_n, high_n = high[alive], low_n[alive], high_n[alive]
            ok = (100 * high_n >= p * n) & (p * low_n <= 100 * n)
            ok &= (100 + p) * np.minimum(high, point).sum(1, dtype=np.int64) >= p * (n + low_n)
            alive = alive[ok]
            if not len(alive):
                return alive
        if alive is None:
            alive = np.arange(len(self.pts))
        else:
            alive = (alive[:, None] * LEAF + np.arange(LEAF)).ravel()
            alive = alive[alive < len(self.pts)]
        m = self.total[alive]
        ok = (100 + p) * np.minimum(self.pts[alive], point).sum(1, dtype=np.int64) >= p * (n + m)
        return np.sort(self.order[alive[ok]])


class Joiner:
    """Which sets are connected, with the smallest place as name."""

    def __init__(self, labels: np.ndarray):
        _, first, at = np.unique(labels, return_index=True, return_inverse=True)
        self.component = first[at]
        self.trees = len(first)

    def join(self, i: int, j: int) -> bool:
        a, b = sorted((int(self.component[i]), int(self.component[j])))
        if a == b:
            return False
        self.component[self.component == b] = a
        self.trees -= 1
        return True


def _tree_links(some: np.ndarray, pts: np.ndarray, total: np.ndarray, percent: int, joined: Joiner, confirm, left, out: list[tuple[int, int]]) -> None:
    """Links among the sets at places ``some``, whose points ``pts`` have like many groups."""
    tree = CountTree(pts, percent, total)
    tree.label(joined.component[some])
    trees = joined.trees
    for k, i in enumerate(some.tolist()):
        if left is not None and not left[i]:
            continue
        near = some[tree.survivors(pts[k], int(total[k]), int(joined.component[i]))]
        near = near[near > i] if left is None else near[~left[near]]
        near = near[joined.component[near] != joined.component[i]]
        before, step = joined.trees, 4
        while len(near):
            near = near[joined.component[near] != joined.component[i]]
            some_near, near = near[:step], near[step:]
            step *= 4
            for j in (some_near if confirm is None or not len(some_near) else some_near[confirm(i, some_near)]).tolist():
                if joined.join(i, j):
                    out.append((i, j))
        if joined.trees == 1:
            return
        if joined.trees < before and (joined.trees & 7 == 0 or trees > 2 * joined.trees):
            trees = joined.trees
            tree.label(joined.component[some])


def forest_links(pts: list[np.ndarray], total: np.ndarray, percent: int, confirm: Callable[[int, np.ndarray], np.ndarray] | None = None, left: np.ndarray | None = None, labels: np.ndarray | None = None) -> list[tuple[int, int]]:
    """Links that connect what survivors (or those that ``confirm`` keeps) connect.

    Sets of one ``labels`` are connected already.  ``left``: only pairs of a
    true and a false entry are looked at.
    """
    joined, out = Joiner(np.arange(len(pts)) if labels is None else labels), []
    for some, own in _like_sizes(pts, total, percent):
        if joined.trees > 1:
            _tree_links(some, own, total[some], percent, joined, confirm, left, out)
    return out


def _like_sizes(pts: list[np.ndarray], total: np.ndarray, percent: int) -> Iterator[tuple[np.ndarray, np.ndarray]]:
    """(places, points of as many groups) of sets that may link, for each number of groups there is."""
    width = np.array([len(p) for p in pts])
    for groups in np.unique(width).tolist():
        top = int(total[width == groups].max())
        some = np.flatnonzero((width == groups) | ((width > groups) & (percent * total <= 100 * top)))
        if len(some) > 1:
            yield some, folded([pts[k] for k in some.tolist()], groups)


def surviving_pairs(pts: list[np.ndarray], total: np.ndarray, percent: int, labels: np.ndarray, left: np.ndarray | None = None) -> Iterator[tuple[np.ndarray, np.ndarray]]:
    """All pairs of different labels that the bound leaves, some at a time; ``left`` as in ``forest_links``."""
    a, b, many = [], [], 0
    for some, own in _like_sizes(pts, total, percent):
        tree = CountTree(own, percent, total[some])
        tree.label(labels[some])
        for k, i in enumerate(some.tolist()):
            if left is not None and not left[i]:
                continue
            near = some[tree.survivors(own[k], int(total[i]), int(labels[i]))]
            near = near[near > i] if left is None else near[~left[near]]
            near = near[labels[near] != labels[i]]
            a.append(np.full(len(near), i))
            b.append(near)
            many += len(near)
            if many > 1_000_000:
                yield np.concatenate(a), np.concatenate(b)
                a, b, many = [], [], 0
    if many:
        yield np.concatenate(a), np.concatenate(b)


def _hot_shingles(docs: DataFrame, size: int) -> np.ndarray:
    """The most frequent shingles, frequent first: one order for all tasks of this run.

    Any order gives the same links; this one keeps trees small.  At most
    ``FREQUENT`` rows reach the driver, whatever the number of documents.
    """

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        worker_cache("jaccard join")
        held: list[np.ndarray] = []
        n = 0

        def flush() -> pa.RecordBatch:
            s = np.sort(np.concatenate(held))
            first = np.flatnonzero(np.r_[True, s[1:] != s[:-1]])
            count = np.diff(np.r_[first, len(s)])
            top = np.flatnonzero(count >= OFTEN)
            top = top[np.argsort(-count[top], kind="stable")[:FREQUENT]]
            return pa.RecordBatch.from_arrays([pa.array(s[first[top]].view(np.int64)), pa.array(count[top].astype(np.int64))], ["shingle", "n"])

        for b in batches:
            for s in shingle_sets([t.encode("utf-8", "surrogatepass") for t in b["text"].to_pylist()], size):
                held.append(s)
                n += len(s)
            if n > 3_000_000:
                yield flush()
                held, n = [], 0
        if held:
            yield flush()

    counted = id_text(docs).mapInArrow(run, "shingle long, n long").groupBy("shingle").agg(F.sum("n").alias("n"))
    rows = counted.orderBy(F.desc("n"), "shingle").limit(FREQUENT).collect()
    return np.array([r[0] for r in rows], np.int64).view(np.uint64)


def set_digest(s: np.ndarray) -> tuple[int, int]:
    """128 bits that tell sets apart, whatever the order; an empty set has zeros."""
    if not len(s):
        return 0, 0
    with np.errstate(over="ignore"):
        return int(np.bitwise_xor.reduce(mix(s)).view(np.int64)), int(np.add.reduce(mix(s ^ np.uint64(0xA5A5A5A5A5A5A5A5))).view(np.int64))


def _sketches(docs: DataFrame, size: int, percent: int, hot: np.ndarray) -> DataFrame:
    """doc_id, n, digest (two longs), keys, point of each text."""
    by_value = np.argsort(hot)
    sorted_hot = hot[by_value]

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in batches:
            sets = shingle_sets([t.encode("utf-8", "surrogatepass") for t in b["text"].to_pylist()], size)
            digests = [set_digest(s) for s in sets]
            keys = []
            for s in sets:
                many = len(s) - -(-percent * len(s) // 100) + 1 if len(s) else 0
                if len(s) and len(sorted_hot):
                    at = np.minimum(np.searchsorted(sorted_hot, s), len(sorted_hot) - 1)
                    # rank 0: not frequent; then the least frequent first
                    rank = np.where(sorted_hot[at] == s, len(hot) - by_value[at], 0)
                    s = s[np.argsort(rank, kind="stable")]
                keys.append(s[:many].tobytes())
            yield pa.RecordBatch.from_arrays(
                [b["doc_id"], pa.array([len(s) for s in sets], pa.int64()), pa.array([d for d, _ in digests], pa.int64()), pa.array([d for _, d in digests], pa.int64()),
                 pa.array(keys, pa.binary()), pa.array(list(map(pack_point, points(sets))), pa.binary())],
                ["doc_id", "n", "d1", "d2", "keys", "point"],
            )

    return id_text(docs).mapInArrow(run, "doc_id long, n long, d1 long, d2 long, keys binary, point binary")


def _spread_keys(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    for b in batches:
        keys = b["keys"].to_pylist()
        many = np.array([len(k) // 8 for k in keys], np.int64)
        flat, rows = np.frombuffer(b"".join(keys), np.int64), np.repeat(np.arange(len(keys)), many)
        for at in range(0, len(rows), 100_000):
            part = pa.array(rows[at : at + 100_000])
            yield pa.RecordBatch.from_arrays([pa.array(flat[at : at + 100_000]), b["cls"].take(part), b["n"].take(part)], ["key", "cls", "n"])


def _meeting(percent: int) -> Callable:
    """Rows, sorted by key and size, whose key another set of a fitting size has, and their tree's number."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        last: pa.RecordBatch | None = None  # the row before this batch, and whether it has been sent
        sent = True
        now, seen = None, 0  # key sent last and its rows so far
        for b in batches:
            if not b.num_rows:
                continue
            t = pa.Table.from_batches([b] if last is None else [last, b]).combine_chunks()
            key, n = t["key"].to_numpy(), t["n"].to_numpy()
            fits = (key[1:] == key[:-1]) & (100 * n[:-1] >= percent * n[1:])
            keep = np.r_[fits, False] | np.r_[False, fits]
            if last is not None and sent:
                keep[0] = False
            last, sent = t.slice(len(key) - 1).to_batches()[0], bool(keep[-1])
            if not keep.any():
                continue
            out = t.filter(pa.array(keep)).select(["key", "cls"]).combine_chunks()
            k = key[keep]
            first = np.flatnonzero(np.r_[True, k[1:] != k[:-1]])
            size = np.diff(np.r_[first, len(k)])
            rank = np.arange(len(k)) - np.repeat(first, size)
            if k[0] == now:
                rank[: size[0]] += seen
            now, seen = int(k[-1]), int(rank[-1]) + 1
            yield from out.append_column("tree", pa.array((rank // HOT).astype(np.int32))).to_batches()

    return run


def _grouped(batches: Iterator[pa.RecordBatch], keys: tuple[str, ...]) -> Iterator[pa.Table]:
    """Tables that hold whole groups of sorted keys."""
    held: list[pa.RecordBatch] = []

    def at(b: pa.RecordBatch, i: int) -> tuple:
        return tuple(b[k][i].as_py() for k in keys)

    for b in batches:
        if not b.num_rows:
            continue
        new = _group_starts(b, keys)
        last = int(new[-1])  # where the group that may go on begins
        if held and at(held[0], 0) != at(b, 0):
            yield pa.Table.from_batches(held)
            held = []
        if last:
            yield pa.Table.from_batches([*held, b.slice(0, last)])
            held = [b.slice(last)]
        else:
            held.append(b)
    if held:
        yield pa.Table.from_batches(held)


def _group_starts(t: pa.Table | pa.RecordBatch, keys: tuple[str, ...]) -> np.ndarray:
    new = np.zeros(t.num_rows, bool)
    new[:1] = True
    for k in keys:
        x = t[k].to_numpy(zero_copy_only=False) if isinstance(t, pa.RecordBatch) else t[k].to_numpy()
        new[1:] |= x[1:] != x[:-1]
    return np.flatnonzero(new)


def _candidates(percent: int) -> Callable:
    """Links of the forests of each tree; for a key of several trees also the boxes of its components."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for t in _grouped(batches, ("key", "tree")):
            key, cls, n, tree = (t[c].to_numpy() for c in ("key", "cls", "n", "tree"))
            first = _group_starts(t, ("key", "tree"))
            size = np.diff(np.r_[first, len(key)])
            points_of, total = t["point"].to_pylist(), n
            a, b = [], []
            boxes: list[tuple] = []
            _pairs_of_small(points_of, total, first, size, percent, cls, a, b)
            for at, m in zip(first[size > LEAF].tolist(), size[size > LEAF].tolist(), strict=True):
                pts = [unpack_point(x) for x in points_of[at : at + m]]
                found = np.array(forest_links(pts, total[at : at + m], percent), np.int64).reshape(-1, 2)
                a.append(cls[at + found[:, 0]])
                b.append(cls[at + found[:, 1]])
                if m >= HOT or tree[at]:
                    boxes += _boxes(int(key[at]), cls[at : at + m], pts, total[at : at + m], found)
            for at, m in zip(first.tolist(), size.tolist(), strict=True):
                if m <= LEAF and tree[at]:
                    pts = [unpack_point(x) for x in points_of[at : at + m]]
                    boxes += _boxes(int(key[at]), cls[at : at + m], pts, total[at : at + m], np.zeros((0, 2), np.int64))
            x, y = star_forest(np.concatenate(a), np.concatenate(b)) if a else (cls[:0], cls[:0])
            if len(x) or boxes:
                cols = list(zip(*boxes, strict=True)) if boxes else [()] * 5
                none = len(boxes)
                yield pa.RecordBatch.from_arrays(
                    [pa.array([*x.tolist(), *cols[1]], pa.int64()), pa.array([*y.tolist(), *[None] * none], pa.int64()), pa.array([*[None] * len(x), *cols[0]], pa.int64()),
                     pa.array([*[None] * len(x), *cols[2]], pa.int64()), pa.array([*[None] * len(x), *cols[3]], pa.int64()), pa.array([*[None] * len(x), *cols[4]], pa.binary())],
                    ["a", "b", "key", "low", "high", "corner"],
                )

    return run


def _pairs_of_small(points_of: list[bytes], total: np.ndarray, first: np.ndarray, size: np.ndarray, percent: int, cls: np.ndarray, a: list, b: list) -> None:
    """Surviving pairs of groups that fit a leaf, all at once: a tree of one leaf is its points."""
    small = np.repeat((size > 1) & (size <= LEAF), size)
    end = np.repeat(first + size, size)
    width = np.array([len(x) for x in points_of])
    for groups in np.unique(width[small]).tolist():
        # sizes of similar sets are within 100 / percent, their numbers of groups within twice that
        near = small & (width >= groups) & (percent * width <= 200 * groups)
        row = np.full(len(width), -1)
        row[near] = np.arange(int(near.sum()))
        pts = folded([np.frombuffer(points_of[k], np.uint8) for k in np.flatnonzero(near).tolist()], groups)
        for gap in range(1, LEAF):
            i = np.flatnonzero(near[:-gap] & near[gap:] & (np.arange(len(width) - gap) + gap < end[:-gap])) if len(width) > gap else np.zeros(0, np.int64)
            i = i[np.minimum(width[i], width[i + gap]) == groups]
            for k in range(0, len(i), 50_000):
                p = i[k : k + 50_000]
                q = p + gap
                ok = (100 + percent) * np.minimum(pts[row[p]], pts[row[q]]).sum(1, dtype=np.int64) >= percent * (total[p] + total[q])
                a.append(cls[p[ok]])
                b.append(cls[q[ok]])


def _boxes(key: int, cls: np.ndarray, pts: list[np.ndarray], total: np.ndarray, found: np.ndarray) -> list[tuple]:
    """key, a set, smallest and largest size, upper corner (of ``GROUPS`` groups) of what the links connect."""
    joined = Joiner(np.arange(len(cls)))
    for i, j in found.tolist():
        joined.join(i, j)
    out = []
    for c in np.unique(joined.component).tolist():
        some = np.flatnonzero(joined.component == c)
        corner = folded([pts[k] for k in some.tolist()], GROUPS).max(0)
        out.append((key, int(cls[c]), int(total[some].min()), int(total[some].max()), corner.astype("<i4").tobytes()))
    return out


def _boxes_that_meet(percent: int) -> Callable:
    """Links of the boxes of one key that may hold similar sets; sorted by key and smallest size."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        key, held, last, high = None, [], None, 0
        for b in batches:
            a, c = [], []
            for k, cls, low, top, corner in zip(*(b[x].to_pylist() for x in ("key", "a", "low", "high", "corner")), strict=True):
                if k != key:
                    key, held, last, high = k, [], None, 0
                if held is not None and len(held) == BOXES:
                    # too many for one task: a chain in order of size, which joins more than it must
                    for (x, *_), (y, y_low, *_), top_so_far in zip(held, held[1:], np.maximum.accumulate([h[2] for h in held]).tolist(), strict=False):
                        if 100 * top_so_far >= percent * y_low:
                            a.append(y)
                            c.append(x)
                    last, held = held[-1][0], None
                if held is not None:
                    box = np.frombuffer(corner, "<i4")
                    for other, o_low, o_top, o_corner in held:
                        if 100 * o_top >= percent * low and (100 + percent) * int(np.minimum(box, o_corner).sum(dtype=np.int64)) >= percent * (low + o_low):
                            a.append(cls)
                            c.append(other)
                    held.append((cls, low, top, box))
                else:
                    if 100 * high >= percent * low:
                        a.append(cls)
                        c.append(last)
                    last = cls
                high = max(high, top)
            if a:
                yield pa.RecordBatch.from_arrays([pa.array(a, pa.int64()), pa.array(c, pa.int64())], ["a", "b"])

    return run


def _open_blocks(percent: int) -> Callable:
    """cell, low, high, sets: for pairs of blocks the sets of either that a key's surviving pairs have.

    Those are pairs of one key, or of two trees of it, whose ends are not
    connected and were in different blocks.  The lists of a task are put
    together over all its keys, so what many keys say of a set is one entry.
    """

    def distinct(parts: list[np.ndarray]) -> list[np.ndarray]:
        rows = np.concatenate(parts)
        order = np.lexsort(rows.T[::-1])
        rows = rows[order]
        return [rows[np.r_[True, (rows[1:] != rows[:-1]).any(1)]]]

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        held: list[np.ndarray] = []  # rows of cell, low, high, set
        for t in _grouped(batches, ("key", "one", "two")):
            starts = _group_starts(t, ("key", "one", "two"))
            for at, to in zip(starts.tolist(), [*starts[1:].tolist(), t.num_rows], strict=True):
                g = t.slice(at, to - at)
                label, block, cls, cell = (g[c].to_numpy() for c in ("label", "block", "cls", "cell"))
                if len(g) < 2 or (label == label[0]).all():
                    continue
                left = g["left"].to_numpy() if g["one"][0].as_py() != g["two"][0].as_py() else None
                for i, j in surviving_pairs([unpack_point(x) for x in g["point"].to_pylist()], g["n"].to_numpy(), percent, label, left):
                    ok = (block[i] != block[j]) & (cell[i] == cell[j])
                    i, j = i[ok], j[ok]
                    low, high = np.minimum(block[i], block[j]), np.maximum(block[i], block[j])
                    held += [np.stack([cell[x], low, high, cls[x]], 1) for x in (i, j) if len(x)]
            if sum(map(len, held)) > 1_000_000:
                held = distinct(held)
                if len(held[0]) > 500_000:
                    yield from packed(held[0])
                    held = []
        if held:
            yield from packed(distinct(held)[0])

    def packed(rows: np.ndarray) -> Iterator[pa.RecordBatch]:
        first = np.flatnonzero(np.r_[True, (rows[1:, :3] != rows[:-1, :3]).any(1)])
        lists = pa.ListArray.from_arrays(pa.array(np.r_[first, len(rows)].astype(np.int32)), pa.array(rows[:, 3]))
        yield pa.RecordBatch.from_arrays([*(pa.array(rows[first, k]) for k in range(3)), lists], ["cell", "low", "high", "sets"])

    return run


def _verify(size: int, percent: int) -> Callable:
    """Links of each task, as the star of what they connect; of its rows those count whose text has the set asked for."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        worker_cache("jaccard join")
        for t in _grouped(batches, ("task",)):
            starts = _group_starts(t, ("task",))
            for at, to in zip(starts.tolist(), [*starts[1:].tolist(), t.num_rows], strict=True):
                g = t.slice(at, to - at)
                sets = shingle_sets([x.encode("utf-8", "surrogatepass") for x in g["text"].to_pylist()], size)
                # rows that share an id are told apart by their set; rows that repeat count once
                seen: dict[int, int] = {}
                for k, (c, d, s) in enumerate(zip(g["cls"].to_pylist(), g["d1"].to_pylist(), sets, strict=True)):
                    if c not in seen and set_digest(s)[0] == d:
                        seen[c] = k
                own = np.fromiter(seen.values(), np.int64, len(seen))
                if len(own) < 2:
                    continue
                cls, label, side = g["cls"].to_numpy()[own], g["label"].to_numpy()[own], g["left"].to_numpy()[own]
                sets = [sets[k] for k in own.tolist()]

                def confirm(i: int, some: np.ndarray, sets=sets) -> np.ndarray:
                    mine, many = sets[i], [len(sets[j]) for j in some.tolist()]
                    flat = np.concatenate([sets[j] for j in some.tolist()])
                    hit = mine[np.minimum(np.searchsorted(mine, flat), len(mine) - 1)] == flat
                    both = np.add.reduceat(hit.astype(np.int64), np.cumsum(many) - many)
                    return 100 * both >= percent * (len(mine) + np.array(many) - both)

                found = forest_links(points(sets), np.array([len(x) for x in sets]), percent, confirm, side if g["cross"][0].as_py() else None, label)
                if found:
                    i, j = np.array(found).T
                    x, y = star_forest(cls[i], cls[j])
                    yield pa.RecordBatch.from_arrays([pa.array(x), pa.array(y)], ["a", "b"])

    return run


def _blocks_of(members: DataFrame) -> DataFrame:
    """``members`` (cls, cell, n, ...) with the number of blocks of their cell and their own block."""
    blocks = F.greatest(F.ceil(F.count(F.lit(1)) / BLOCK), F.ceil(F.sum("n") / BLOCK_SHINGLES)).cast("int")
    sizes = members.groupBy("cell").agg(blocks.alias("blocks"), F.count(F.lit(1)).alias("sets"))
    return members.join(sizes, "cell").withColumn("block", F.pmod(F.xxhash64("cls"), "blocks").cast("int"))


def _verified(docs: DataFrame, rows: DataFrame, size: int, percent: int, name: str) -> DataFrame:
    """Links within the tasks of ``rows`` (task, cls, rep, d1, label, left, cross); texts join them by id.

    ``name``: "links" is the first round.
    """
    many = partitions(docs.sparkSession)
    texts = id_text(docs).where(F.col("doc_id").isNotNull()).withColumnRenamed("doc_id", "rep")
    # the first round asks for most texts and always shuffles them by id; later ones ask for few
    few = name != "links" and rows.count() <= BROADCAST_TASKS
    loaded = texts.join(F.broadcast(rows) if few else rows.hint("merge"), "rep").repartition(many, "task").sortWithinPartitions("task", "cls")
    return materialise(loaded.mapInArrow(_verify(size, percent), "a long, b long"), name)


def similar_documents(docs: DataFrame, size: int = 5, percent: int = 80) -> DataFrame:
    """doc_id, n_shingles, component_id of every row of ``docs``.

    Two rows link when their sets of distinct ``size``-word shingles (ASCII
    lower case; fewer words: all of them as one) satisfy 100 * shared >=
    ``percent`` * union; component_id is the smallest doc_id reachable.  Null
    and empty texts and texts without words have no shingles and stay alone.
    Rows with a null id stay alone with a null component.  Rows that repeat get
    rows that repeat; rows of one id with different texts are sets of their
    own.  An empty table gives no rows; other columns aren't read.  Sets are
    compared by 64-bit shingle hashes and 128-bit set digests.
    """
    spark = prepare(docs.sparkSession)
    many = partitions(spark)
    hot = _hot_shingles(docs, size)
    sketch = materialise(_sketches(docs, size, percent, hot).withColumn("row", F.monotonically_increasing_id()), "sketches")
    real = sketch.where((F.col("n") > 0) & F.col("doc_id").isNotNull())
    # equal sets are one class, named by the row that stands for it
    least = F.min(F.struct("doc_id", "row")).alias("m")
    classes = materialise(real.groupBy("d1", "d2", "n").agg(least).select("d1", "d2", "n", F.col("m.doc_id").alias("rep"), F.col("m.row").alias("cls")), "classes")
    heads = _only(real.select(F.col("row").alias("cls"), "n", "keys", "point"), classes.select("cls"))
    spread = heads.select("cls", "n", "keys").mapInArrow(_spread_keys, "key long, cls long, n long")
    # most first shingles are one set's alone: points travel only where sets of fitting sizes meet
    met = spread.repartition(many, "key").sortWithinPartitions("key", "n").mapInArrow(_meeting(percent), "key long, cls long, tree int")
    met = materialise(met, "met")
    release(spark)
    by_key = met.join(heads.select("cls", "n", "point"), "cls").repartition(many, "key", "tree").sortWithinPartitions("key", "tree", "n", "cls")
    rough = materialise(by_key.mapInArrow(_candidates(percent), "a long, b long, key long, low long, high long, corner binary"), "candidates")
    release(spark)
    boxes = rough.where(F.col("key").isNotNull()).repartition(many, "key").sortWithinPartitions("key", "low", "a")
    across = boxes.mapInArrow(_boxes_that_meet(percent), "a long, b long")
    cells = connected_components(rough.where(F.col("key").isNull()).select("a", "b").unionByName(across))
    discard(rough)
    own = cells.select(F.col("component").alias("cls"), F.col("component").alias("cell")).distinct()
    members = cells.select(F.col("node").alias("cls"), F.col("component").alias("cell")).unionByName(own)
    members = materialise(_blocks_of(members.join(classes.select("cls", "rep", "d1", "n"), "cls")), "cells")
    task = F.xxhash64("cell", "block").alias("task")
    plain = (F.col("cls").alias("label"), F.lit(False).alias("left"), F.lit(False).alias("cross"))
    links = [_verified(docs, members.select(task, "cls", "rep", "d1", *plain), size, percent, "links")]
    release(spark)
    # of cells of several blocks, what each block connected goes on as one set
    now = members.where("blocks > 1").select("cls", "cell", "rep", "d1", "n")
    sets, last_round = now.count(), False
    while sets:
        roots = now.join(links[-1].select(F.col("a").alias("cls")), "cls", "left_anti")
        roots = materialise(_blocks_of(roots).where("sets > 1"), "roots")
        left = roots.count()
        if last_round or not left or left > STALLED * sets:
            break
        links.append(_verified(docs, roots.select(task, "cls", "rep", "d1", *plain), size, percent, "later"))
        last_round = not roots.where("blocks > 1").limit(1).count()
        now, sets = roots.drop("blocks", "sets", "block"), left
    every = links[0]
    for more in links[1:]:
        every = every.unionByName(more)
    if sets and left:
        unsettled = members.join(roots.select("cell").distinct(), "cell", "left_semi")
        every = every.unionByName(_across_blocks(docs, unsettled, met, heads, every, size, percent))
    comp = connected_components(every)
    discard(*links, met, members)
    found = classes.join(comp.withColumnRenamed("node", "cls"), "cls", "left").withColumn("component", F.coalesce("component", "cls"))
    names = found.groupBy("component").agg(F.min("rep").alias("component_id"))
    found = found.join(names, "component").select("d1", "d2", "n", "component_id")
    out = sketch.select("doc_id", "n", "d1", "d2").join(found, ["d1", "d2", "n"], "left")
    alone = F.when(F.col("n") > 0, F.coalesce("component_id", "doc_id")).otherwise(F.col("doc_id"))
    component = F.when(F.col("doc_id").isNotNull(), alone).alias("component_id")
    return out.select("doc_id", F.col("n").alias("n_shingles"), component)


def _only(rows: DataFrame, wanted: DataFrame) -> DataFrame:
    """``rows`` whose cls is ``wanted``; the shorter list of the two is broadcast if its size allows."""
    rest = materialise(rows.select("cls").join(wanted, "cls", "left_anti"), "rest")
    if rest.count() <= BROADCAST_ROWS:
        return rows.join(F.broadcast(rest), "cls", "left_anti")
    return rows.join(wanted, "cls", "left_semi")


def _across_blocks(docs: DataFrame, members: DataFrame, met: DataFrame, heads: DataFrame, links: DataFrame, size: int, percent: int) -> DataFrame:
    """Verified links between sets of different blocks of one cell that ``links`` do not connect."""
    many = partitions(docs.sparkSession)
    comp = connected_components(links)
    labels = comp.withColumnRenamed("node", "cls").withColumnRenamed("component", "label")
    open_ = members.join(labels, "cls", "left").withColumn("label", F.coalesce("label", "cls"))
    open_ = materialise(open_.select("cls", "rep", "d1", "cell", "block", "label"), "open")
    rows = met.join(open_.select("cls", "cell", F.col("block").cast("long").alias("block"), "label"), "cls").join(heads.select("cls", "n", "point"), "cls")
    trees = rows.groupBy("key").agg((F.max("tree") + 1).alias("trees"))
    other = F.explode(F.sequence(F.lit(0), F.col("trees") - 1)).alias("other")
    pairs = rows.join(trees, "key").select("key", "cls", "n", "point", "cell", "block", "label", "tree", other).select(
        "key", "cls", "n", "point", "cell", "block", "label",
        F.least("tree", "other").alias("one"), F.greatest("tree", "other").alias("two"), (F.col("tree") < F.col("other")).alias("left"),
    )
    placed = pairs.repartition(many, "key", "one", "two").sortWithinPartitions("key", "one", "two", "n", "cls")
    found = materialise(placed.mapInArrow(_open_blocks(percent), "cell long, low long, high long, sets array<long>"), "pairs")
    # a list has at most the sets of two blocks
    lists = found.groupBy("cell", "low", "high").agg(F.array_distinct(F.flatten(F.collect_list("sets"))).alias("sets"))
    ask = lists.select(F.xxhash64("cell", "low", "high").alias("task"), "low", F.explode("sets").alias("cls"))
    tasks = ask.join(open_, "cls").select("task", "cls", "rep", "d1", "label", (F.col("block") == F.col("low")).alias("left"), F.lit(True).alias("cross"))
    out = _verified(docs, materialise(tasks, "tasks"), size, percent, "across")
    discard(found, open_)
    return out


def keep_first(docs: DataFrame, size: int = 5, percent: int = 80) -> DataFrame:
    """The rows of ``docs`` that are the smallest of their component, with all their columns.

    Rows with a null id are kept; of rows that share an id all are kept or
    none.  Columns of any name pass; an empty table gives no rows.
    """
    same = similar_documents(docs, size, percent)
    name = free_name(docs, "gone_id")
    gone = same.where(F.col("component_id") < F.col("doc_id")).select(F.col("doc_id").alias(name)).distinct()
    return docs.join(gone, docs["doc_id"] == F.col(name), "left_anti")


def oracle(size: int, percent: int) -> str:
    """The same by a join of all shingle rows and a recursive search for what links reach."""
    upper = "ABCDEFGHIJKLMNOPQRSTUVWXYZ"
    return rf"""
WITH RECURSIVE w AS (SELECT doc_id, list_filter(regexp_split_to_array(translate(coalesce(text, ''), '{upper}', '{upper.lower()}'), '[ \t-\r]+'), lambda x: x <> '') AS ws FROM documents),
s AS (SELECT DISTINCT doc_id, array_to_string(ws[i : i + {size - 1}], ' ') AS s FROM (SELECT doc_id, ws, unnest(range(1, greatest(len(ws) - {size - 1}, 1) + 1)) AS i FROM w WHERE len(ws) > 0)),
n AS (SELECT doc_id, count(*) AS n FROM s GROUP BY doc_id),
l AS (SELECT a.doc_id AS a, b.doc_id AS b FROM s a JOIN s b ON a.s = b.s AND a.doc_id <> b.doc_id JOIN n x ON x.doc_id = a.doc_id JOIN n y ON y.doc_id = b.doc_id
  GROUP BY a.doc_id, b.doc_id HAVING 100 * count(*) >= {percent} * (first(x.n) + first(y.n) - count(*))),
c AS (SELECT DISTINCT a, b FROM l UNION SELECT c.a, l.b FROM c JOIN l ON l.a = c.b)
SELECT CAST(w.doc_id AS BIGINT) AS doc_id, CAST(coalesce(first(n.n), 0) AS BIGINT) AS n_shingles, CAST(least(w.doc_id, coalesce(min(c.b), w.doc_id)) AS BIGINT) AS component_id
FROM w LEFT JOIN n ON n.doc_id = w.doc_id LEFT JOIN c ON c.a = w.doc_id GROUP BY w.doc_id"""
