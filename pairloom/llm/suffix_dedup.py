"""Operator 4: bytes of passages that an earlier document has too.

A byte is removed if it lies in a string of ``LENGTH`` bytes that also starts
in a document with a smaller id.  The result is exact: hashes only decide which
strings meet where, and what has equal hashes is compared byte by byte.

 1. Texts are written in blocks to the shared folder.  Of every string of
    LENGTH bytes the smallest hash of its ``SEED``-byte parts is an anchor; equal
    strings have equal anchors, so strings can only match where anchors do.
 2. Anchors of a block go, sorted and as differences, to the task of their key
    range, which answers with those that two documents have.  Keys are hashed
    once more: anchors are smallest hashes, so ranges of these would be uneven.
 3. Around each repeated anchor lie all strings that have it: its context.
    Distinct contexts of a block go to the shard of the anchor's key range.
    An anchor that may have more than ``HOT`` contexts would be one task's:
    its strings are asked for one by one instead (step 2 again, with strings
    for anchors), and repeated ones go to the shard of their own key.
 4. A shard sorts the suffixes of its contexts (Larsson-Sadakane), finds
    common prefixes (Kasai), and so the classes of equal strings and the
    smallest document of each.  Contexts of one anchor beyond ``SHARD`` are
    sorted in several shards, whose classes are merged by binary search.
 5. Blocks read the answers and cut their texts.

Texts are never shuffled: what moves are four bytes per anchor (about one in
sixteen bytes is one) and the distinct contexts of repeated anchors.
"""

from __future__ import annotations

import hashlib
import uuid
from collections.abc import Callable, Iterator

import numpy as np
import pyarrow as pa
import pyarrow.parquet as pq
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T

from pairloom.llm._shared import block_size, discard, filesystem, give_back, materialise, new_folder, partitions, prepare, worker_cache
from pairloom.llm.suffix_array import common_prefixes, suffix_order
from pairloom.llm.words import mix

LENGTH = 50
SEED = 18
#: Contexts in one suffix array.
SHARD = 40_000
#: Contexts that an anchor may have before its strings are dealt one by one.
HOT = 40_000
#: Ranges of keys at least, however few partitions there are: a range is held in memory.
LEAST_RANGES = 256
#: Rows of a shard, or places of a block, that are worked on at a time.
PIECE = 200_000
#: Bytes of a block whose hashes are made at a time.
_STEP = 1 << 18
#: Anchors that a block has fewer times are not counted one by one.
_FEW = 4
_SPAN = LENGTH - SEED + 1  # seeds in a string, and strings around a seed
_WIDTH = 2 * LENGTH - SEED  # bytes of a context
_BASE = np.uint64(0x9E3779B97F4A7C15)
_ALL = np.uint64(2**64 - 1)
_U = np.uint64


def _power(n: int) -> np.uint64:
    return _U(pow(int(_BASE), n, 1 << 64))


def _sliding(x: np.ndarray, size: int, best) -> np.ndarray:
    """best(x[i], ..., x[i + size - 1]) for every i, by doubling."""
    have = 1
    out = x
    while have * 2 <= size:
        out = best(out[:-have], out[have:])
        have *= 2
    if have < size:
        out = best(out[: len(x) - size + 1], out[size - have :])
    return out


def seed_hashes(buf: np.ndarray, at: np.ndarray) -> np.ndarray:
    h = np.zeros(len(at), _U)
    for k in range(SEED):
        h = h * _BASE + buf[at + k] + _U(1)
    return mix(h)


def _keys(h: np.ndarray) -> np.ndarray:
    """48 bits by which equal seeds or strings meet, even also for hashes that are the least of some."""
    return mix(h) >> _U(16)


def _rolling(buf: np.ndarray, length: int = SEED) -> np.ndarray:
    """``seed_hashes`` at every place (or those of ``length`` bytes), from hashes of 1, 2, 4 ... bytes."""
    h, size = buf.astype(_U) + _U(1), 1
    parts = {1: h} if length & 1 else {}
    while size * 2 <= length:
        h = h[:-size] * _power(size) + h[size:]
        size *= 2
        if length & size:
            parts[size] = h
    n = len(buf) - length + 1
    out, at = None, 0
    for size in sorted(parts, reverse=True):
        piece = parts[size][at : at + n]
        out = piece if out is None else out * _power(size) + piece
        at += size
    return mix(out)


def anchors(buf: np.ndarray, ends: np.ndarray) -> np.ndarray:
    """Places of the anchors of all strings that lie in one text; texts end at ``ends``.

    Strings across two texts may add anchors; those only cost time.
    """
    out, step = [], _STEP
    for at in range(0, max(0, len(buf) - SEED + 1), step):  # to the last seed, not the last string: its seeds may lie a step further
        low, high = max(0, at - _SPAN), min(len(buf), at + step + LENGTH + SEED)
        h = _rolling(buf[low:high])
        if len(h) < _SPAN:
            continue
        least = _sliding(h, _SPAN, np.minimum)
        # a seed is an anchor if it is the least of some string: if the greatest of the leasts around it is its own
        edge = np.zeros(_SPAN - 1, _U)
        around = _sliding(np.concatenate([edge, least, edge]), _SPAN, np.maximum)
        found = np.flatnonzero(around[: len(h)] == h) + low
        out.append(found[(found >= at) & (found < at + step)])
    found = np.concatenate(out) if out else np.zeros(0, np.int64)
    end = ends[np.minimum(np.searchsorted(ends, found, "right"), len(ends) - 1)] if len(ends) else found
    return found[found + SEED <= end]


class Block:
    """Texts of a block file, back to back."""

    def __init__(self, table: pa.Table):
        self.table = table
        self.raw = [t or b"" for t in table["text"].cast(pa.large_binary()).to_pylist()]
        #: the texts, with zeros before and after for contexts at the ends
        self.around = np.frombuffer(b"".join([bytes(LENGTH - SEED), *self.raw, bytes(LENGTH)]), np.uint8)
        self.buf = self.around[LENGTH - SEED : -LENGTH]
        size = np.array([len(t) for t in self.raw], np.int64)
        self.ends = np.cumsum(size)
        self.starts = self.ends - size
        ids = table["doc_id"].to_numpy()
        self.known = ~np.asarray(table["doc_id"].is_null())
        self.ids = np.where(self.known, ids, 0).astype(np.int64)

    def text_of(self, at: np.ndarray) -> np.ndarray:
        return np.searchsorted(self.ends, at, "right")

    def anchors(self) -> np.ndarray:
        at = anchors(self.buf, self.ends)
        return at[self.known[self.text_of(at)]] if len(at) else at

    @classmethod
    def read(cls, uri: str) -> Block:
        return cls(_read(uri))


def _read(uri: str) -> pa.Table:
    fs, path = filesystem(uri)
    with fs.open_input_file(path) as f:
        return pq.read_table(f)


def _write(uri: str, table: pa.Table) -> None:
    fs, path = filesystem(uri)
    fs.create_dir(path.rpartition("/")[0], recursive=True)
    with fs.open_output_stream(path) as f:
        pq.write_table(table, f, compression="zstd", compression_level=1)


def _buckets(h: np.ndarray, many: int) -> np.ndarray:
    """Range of each 48-bit hash."""
    return (h // _U((1 << 48) // many + 1)).astype(np.int64)


def _pack(x: np.ndarray) -> bytes:
    """A sorted array of distinct numbers as differences, in four bytes where they fit."""
    gap = np.diff(x, prepend=_U(0))
    kind = "<u4" if not len(gap) or int(gap.max()) < 1 << 32 else "<u8"
    return kind[-1].encode() + gap.astype(kind).tobytes()


def _unpack(b: bytes) -> np.ndarray:
    return np.cumsum(np.frombuffer(b, f"<u{b[:1].decode()}", offset=1), dtype=_U)


def _squeeze(x: np.ndarray) -> bytes:
    return pa.compress(x.tobytes(), "zstd", asbytes=True)


def _swell(b: bytes, size: int, kind) -> np.ndarray:
    return np.frombuffer(pa.decompress(b, size * np.dtype(kind).itemsize, "zstd", asbytes=True), kind)


def _groups(batches: Iterator[pa.RecordBatch], key: str) -> Iterator[tuple[object, pa.Table]]:
    """(key, rows) of a column that rows are sorted by."""
    held: list[pa.RecordBatch] = []
    now = None
    for b in batches:
        keys = b[key].to_pylist()
        at = 0
        for i in range(1, len(keys) + 1):
            if i == len(keys) or keys[i] != keys[at]:
                if held and now != keys[at]:
                    yield now, pa.Table.from_batches(held)
                    held = []
                now = keys[at]
                held.append(b.slice(at, i - at))
                at = i
    if held:
        yield now, pa.Table.from_batches(held)


_ASKED = "block string, bucket int, n int, hashes binary, several binary, often binary"


def _ask(uri: str, keys: np.ndarray, ids: np.ndarray, many: int) -> list[tuple]:
    """Rows of _ASKED: a block's distinct keys by range, whether two of its documents have them, and counts of frequent ones."""
    if not len(keys):
        return []
    order = np.argsort(keys)
    keys, ids = keys[order], ids[order]
    first = np.flatnonzero(np.r_[True, keys[1:] != keys[:-1]])
    several = np.minimum.reduceat(ids, first) < np.maximum.reduceat(ids, first)
    count = np.diff(np.r_[first, len(keys)])
    kinds = keys[first]
    bucket = _buckets(kinds, many)
    cut = np.flatnonzero(np.r_[True, bucket[1:] != bucket[:-1]])
    rows = []
    for a, b in zip(cut.tolist(), [*cut[1:].tolist(), len(kinds)], strict=True):
        often = np.flatnonzero(count[a:b] >= _FEW)
        pairs = np.stack([often, count[a:b][often]]).astype("<u4").tobytes() if len(often) else None
        rows.append((uri, int(bucket[a]), b - a, _pack(kinds[a:b]), np.packbits(several[a:b]).tobytes(), pairs))
    return rows


def _asked(rows: list[tuple]) -> pa.RecordBatch:
    kinds = pa.string(), pa.int32(), pa.int32(), pa.binary(), pa.binary(), pa.binary()
    return pa.RecordBatch.from_arrays([pa.array(c, t) for c, t in zip(zip(*rows, strict=True), kinds, strict=True)], ["block", "bucket", "n", "hashes", "several", "often"])


def _make_blocks(folder: str, many: int, block_bytes: int) -> Callable:
    def close(batches: list[pa.RecordBatch]) -> list[tuple]:
        uri = f"{folder}/{uuid.uuid4().hex}"
        table = pa.Table.from_batches(batches)
        block = Block(table)
        _write(f"{uri}.texts", table)
        at = block.anchors()
        _write(f"{uri}.anchors", pa.table({"gap": np.diff(at, prepend=0).astype(np.uint32)}))
        return [(uri, -1, 0, None, None, None), *_ask(uri, _keys(seed_hashes(block.buf, at)), block.ids[block.text_of(at)], many)]

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        held: list[pa.RecordBatch] = []
        size = 0
        for b in batches:
            at = 0
            lengths = np.diff(np.frombuffer(b["text"].cast(pa.large_string()).buffers()[1], np.int64, b.num_rows + 1, 8 * b["text"].offset)) if b.num_rows else np.zeros(0, np.int64)
            for i, n in enumerate(lengths.tolist()):
                if size and size + n > block_bytes:
                    if i > at:
                        held.append(b.slice(at, i - at))
                    yield _asked(close(held))
                    held, size, at = [], 0, i
                size += n
            if at < b.num_rows:
                held.append(b.slice(at))
        if held:
            yield _asked(close(held))

    return run


def _find_repeated(hot: int | None) -> Callable:
    """Per block the keys that two documents have; apart from them those that may have more than ``hot`` contexts."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for bucket, t in _groups(batches, "bucket"):
            lists = [_unpack(x) for x in t["hashes"].to_pylist()]
            many = [np.unpackbits(np.frombuffer(x, np.uint8), count=len(v)).astype(bool) for x, v in zip(t["several"].to_pylist(), lists, strict=True)]
            flat = np.sort(np.concatenate(lists))
            again = np.concatenate([flat[1:][flat[1:] == flat[:-1]], *(v[m] for v, m in zip(lists, many, strict=True))])
            again = np.unique(again)
            if not len(again):
                continue
            frequent = np.zeros(len(again), bool)
            if hot is not None:
                total = (np.searchsorted(flat, again, "right") - np.searchsorted(flat, again)) * (_FEW - 1)
                for x, v in zip(t["often"].to_pylist(), lists, strict=True):
                    if x is not None:
                        which, count = np.frombuffer(x, "<u4").reshape(2, -1)
                        spot = np.minimum(np.searchsorted(again, v[which]), len(again) - 1)
                        same = again[spot] == v[which]  # once each, as a block's keys are distinct
                        total[spot[same]] += count[same]
                frequent = total > hot
            blocks, bits, hots = [], [], []
            for uri, v in zip(t["block"].to_pylist(), lists, strict=True):
                spot = np.minimum(np.searchsorted(again, v), len(again) - 1)
                hit = again[spot] == v
                if hit.any():
                    much = frequent[spot[hit]]
                    blocks.append(uri)
                    bits.append(_pack(v[hit][~much]))
                    hots.append(_pack(v[hit][much]) if much.any() else None)
            if blocks:
                yield pa.RecordBatch.from_arrays([pa.array(blocks), pa.array([bucket] * len(blocks), pa.int32()), pa.array(bits, pa.binary()), pa.array(hots, pa.binary())], ["block", "bucket", "repeated", "hot"])

    return run


def _joined(lists: list[bytes | None]) -> np.ndarray:
    """Packed arrays as one, sorted."""
    return np.sort(np.concatenate([np.zeros(0, _U), *(_unpack(x) for x in lists if x is not None)]))


def _among(keys: np.ndarray, some: np.ndarray) -> np.ndarray:
    return some[np.minimum(np.searchsorted(some, keys), len(some) - 1)] == keys if len(some) else np.zeros(len(keys), bool)


def _anchors_of(uri: str, block: Block) -> tuple[np.ndarray, np.ndarray]:
    at = np.cumsum(_read(f"{uri}.anchors")["gap"].to_numpy().astype(np.int64))
    return at, _keys(seed_hashes(block.buf, at))


def _strings_around(block: Block, at: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """(place, key) of every string of LENGTH bytes that has one of these seeds in it, each place once."""
    text = block.text_of(at)
    edge = np.zeros(len(block.buf) + 1, np.int16)
    low = np.maximum(at - (LENGTH - SEED), block.starts[text])
    high = np.maximum(low, np.minimum(at, block.ends[text] - LENGTH) + 1)
    np.add.at(edge, low, np.int16(1))
    np.add.at(edge, high, np.int16(-1))
    places = np.flatnonzero(np.cumsum(edge, dtype=np.int16, out=edge)[:-1] > 0)
    del edge
    keys = np.empty(len(places), _U)
    i = 0
    while i < len(places):
        base = int(places[i])
        end = int(np.searchsorted(places, base + _STEP))
        keys[i:end] = _keys(_rolling(block.buf[base : int(places[end - 1]) + LENGTH], LENGTH)[places[i:end] - base])
        i = end
    return places, keys


def _ask_strings(many: int) -> Callable:
    """Step 2 for the strings of hot anchors."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for uri, t in _groups(batches, "block"):
            block = Block.read(f"{uri}.texts")
            at, seed = _anchors_of(uri, block)
            places, keys = _strings_around(block, at[_among(seed, _joined(t["hot"].to_pylist()))])
            rows = _ask(uri, keys, block.ids[block.text_of(places)], many)
            if rows:
                yield _asked(rows)

    return run


def _contexts(block: Block, at: np.ndarray, alone: np.ndarray) -> np.ndarray:
    """A row has bytes before the seed, bytes from it on, and the context, zero outside its text; ``alone``: of the one string that begins there."""
    text = block.text_of(at)
    before = np.where(alone, 0, np.minimum(at - block.starts[text], LENGTH - SEED))
    after = np.minimum(block.ends[text] - at, LENGTH)
    rows = np.empty((len(at), _WIDTH + 2), np.uint8)
    rows[:, 0], rows[:, 1] = before, after
    column = np.arange(_WIDTH) - (LENGTH - SEED)
    contexts = np.lib.stride_tricks.sliding_window_view(block.around, _WIDTH)  # of every place
    for i in range(0, len(at), 50_000):
        b, a = (x[i : i + 50_000, None] for x in (before, after))
        body = contexts[at[i : i + 50_000]]
        body[(column < -b) | (column >= a)] = 0
        rows[i : i + 50_000, 2:] = body
    return rows


def _row_hash(rows: np.ndarray) -> np.ndarray:
    wide = np.zeros((len(rows), -(-rows.shape[1] // 8) * 8), np.uint8)
    wide[:, : rows.shape[1]] = rows
    words = wide.view("<u8")
    h = np.zeros(len(rows), _U)
    for k in range(words.shape[1]):
        h = mix(h * _BASE + words[:, k])
    return h


def _new_contexts(rows: Callable, seed: np.ndarray, h: np.ndarray, order: np.ndarray) -> np.ndarray:
    """Where another context begins in ``order``, by (seed, hash); rows of equal hashes, which ``rows`` gives, are compared."""
    new = np.r_[True, (seed[order[1:]] != seed[order[:-1]]) | (h[order[1:]] != h[order[:-1]])]
    same = np.flatnonzero(~new)
    for i in range(0, len(same), 100_000):
        k = same[i : i + 100_000]
        new[k] = (rows(order[k]) != rows(order[k - 1])).any(1)
    return new


def _send_contexts(many: int) -> Callable:
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for uri, t in _groups(batches, "block"):
            block = Block.read(f"{uri}.texts")
            at, seed = _anchors_of(uri, block)
            hit = _among(seed, _joined(t["repeated"].to_pylist()))
            hot = _among(seed, _joined(t["hot"].to_pylist()))
            text = block.text_of(at)
            hit &= np.minimum(at - block.starts[text], LENGTH - SEED) + np.minimum(block.ends[text] - at, LENGTH) >= LENGTH
            places, keys = _strings_around(block, at[hot]) if hot.any() else (at[:0], seed[:0])
            again = _among(keys, _joined(t["strings"].to_pylist()))
            alone = np.repeat([False, True], [hit.sum(), again.sum()])
            at, seed = np.r_[at[hit], places[again]], np.r_[seed[hit], keys[again]]
            if not len(at):
                continue
            # distinct contexts in order of key and hash: answers come back in this order
            if len(at) <= PIECE:
                rows = _contexts(block, at, alone).__getitem__
            else:  # made again where they are needed

                def rows(k, block=block, at=at, alone=alone):
                    return _contexts(block, at[k], alone[k])

            h = np.concatenate([_row_hash(rows(slice(i, i + PIECE))) for i in range(0, len(at), PIECE)])
            order = np.lexsort((h, seed))
            new = _new_contexts(rows, seed, h, order)
            at, seed, alone = at[order], seed[order], alone[order]
            first = np.flatnonzero(new)
            ids = block.ids[block.text_of(at)]
            lowest = np.minimum.reduceat(ids, first)
            _write(f"{uri}.found", pa.table({"at": at.astype(np.uint32) if len(block.buf) < 1 << 32 else at, "context": (np.cumsum(new) - 1).astype(np.uint32), "alone": alone}))
            bucket = _buckets(seed[first], many)
            cut = np.flatnonzero(np.r_[True, bucket[1:] != bucket[:-1]])
            for a, b in zip(cut.tolist(), [*cut[1:].tolist(), len(first)], strict=True):
                k = first[a:b]
                cols = [uri], [int(bucket[a])], [b - a], [seed[k].tobytes()], [lowest[a:b].tobytes()], [_squeeze(rows(order[k]))]
                kinds = pa.string(), pa.int32(), pa.int32(), pa.binary(), pa.binary(), pa.binary()
                yield pa.RecordBatch.from_arrays([pa.array(c, k) for c, k in zip(cols, kinds, strict=True)], ["block", "bucket", "n", "seeds", "lowest", "rows"])

    return run


def string_classes(rows: np.ndarray) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """(row, shift, class) of every string of LENGTH bytes in the contexts, by their suffix array."""
    width = _WIDTH + 1
    text = np.zeros((len(rows), width), np.uint8)
    text[:, :_WIDTH] = rows[:, 2:]
    flat = text.ravel()
    order = suffix_order(flat)
    shared = common_prefixes(flat, order, width, LENGTH)
    number = np.cumsum(shared[order] < LENGTH, dtype=order.dtype)
    del shared
    row, shift = np.divmod(order, order.dtype.type(width))
    del order
    low = (LENGTH - SEED) - rows[:, 0].astype(np.int16)
    high = (LENGTH - SEED) + rows[:, 1].astype(np.int16) - LENGTH
    valid = np.flatnonzero((shift >= low[row]) & (shift <= high[row]))
    return row[valid], shift[valid], number[valid]


def covered(rows: np.ndarray, seeds: np.ndarray, lowest: np.ndarray) -> np.ndarray:
    """Per distinct context the bits of its strings that a smaller document than ``lowest`` has.

    Contexts are sorted by seed; only seeds with several contexts need sorting.
    """
    out = np.zeros(len(rows), _U)
    first = np.flatnonzero(np.r_[True, seeds[1:] != seeds[:-1]])
    size = np.diff(np.r_[first, len(seeds)])
    todo = np.flatnonzero(np.repeat(size > 1, size))
    group = np.repeat(np.arange(len(first)), size)[todo]
    at = 0
    while at < len(todo):
        end = min(len(todo), at + SHARD)
        if end < len(todo) and group[end] == group[end - 1]:
            back = int(np.searchsorted(group, group[end]))  # keep an anchor together where it fits
            end = back if back > at else int(np.searchsorted(group, group[at], "right"))
        _mark(rows, lowest, todo[at:end], out)
        at = end
    return out


def _mark(rows: np.ndarray, lowest: np.ndarray, some: np.ndarray, out: np.ndarray) -> None:
    shards = []
    for at in range(0, len(some), SHARD):
        part = some[at : at + SHARD]
        row, shift, number = string_classes(rows[part])
        cut = np.flatnonzero(np.r_[True, number[1:] != number[:-1]]) if len(number) else np.zeros(0, np.int64)
        least = np.minimum.reduceat(lowest[part][row], cut) if len(cut) else lowest[:0]
        shards.append([part[row], shift, np.repeat(np.arange(len(cut), dtype=number.dtype), np.diff(np.r_[cut, len(number)])), least, cut])
    if len(shards) > 1:
        # one anchor in several shards: classes by a digest of their string, sorted, found in each other by binary search
        tables = []
        for row, shift, _, least, cut in shards:
            body = rows[row[cut]][np.arange(len(cut))[:, None], 2 + shift[cut][:, None] + np.arange(LENGTH)]
            digest = _row_hash(body)
            order = np.argsort(digest)
            tables.append((digest[order], least[order], order, body[order]))
        for k, (digest, least, order, body) in enumerate(tables):
            best = least.copy()
            for j, (other, value, _, text) in enumerate(tables):
                spot = np.searchsorted(other, digest) if j != k else ()
                while len(spot):  # strings of one digest stand together: each is compared
                    live = np.flatnonzero(spot < len(other))
                    live = live[other[spot[live]] == digest[live]]
                    if not len(live):
                        break
                    hit = live[(text[spot[live]] == body[live]).all(1)]
                    best[hit] = np.minimum(best[hit], value[spot[hit]])
                    spot = np.where(np.isin(np.arange(len(spot)), live), spot + 1, len(other))
            shards[k][3] = np.empty_like(best)
            shards[k][3][order] = best
    for row, shift, number, least, _ in shards:
        hit = least[number] < lowest[row] if len(row) else np.zeros(0, bool)
        np.bitwise_or.at(out, row[hit], _U(1) << shift[hit].astype(_U))


def _settle(rows: np.ndarray, seeds: np.ndarray, ids: np.ndarray) -> np.ndarray:
    """Answers for contexts of several blocks, with all that belong to their seeds."""
    h = _row_hash(rows)
    order = np.lexsort((h, seeds))
    new = _new_contexts(lambda k: rows[k], seeds, h, order)
    first = np.flatnonzero(new)
    lowest = np.minimum.reduceat(ids[order], first)
    bits = covered(rows[order[first]], seeds[order[first]], lowest)
    context = np.empty(len(order), np.int64)
    context[order] = np.cumsum(new) - 1
    # a block whose smallest document isn't the smallest of all has the whole context covered
    return np.where(ids > lowest[context], _ALL, bits[context])


def _sort_shards(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    for bucket, t in _groups(batches, "bucket"):
        size = t["n"].to_pylist()
        seeds = [np.frombuffer(x, _U) for x in t["seeds"].to_pylist()]
        ids = [np.frombuffer(x, np.int64) for x in t["lowest"].to_pylist()]
        rows = [_swell(x, n * (_WIDTH + 2), np.uint8).reshape(n, -1) for x, n in zip(t["rows"].to_pylist(), size, strict=True)]
        t = t.select(["block"])
        # a block's contexts stand in order of seeds: ranges of seeds are taken one after another
        limits = np.unique(np.sort(np.concatenate(seeds))[PIECE::PIECE])
        cuts = [np.r_[0, np.searchsorted(x, limits), len(x)].tolist() for x in seeds]
        parts: list[list[np.ndarray]] = [[] for _ in seeds]
        for k in range(len(limits) + 1):
            some = [(j, c[k], c[k + 1]) for j, c in enumerate(cuts) if c[k + 1] > c[k]]
            if not some:
                continue
            answer = _settle(*(np.concatenate([x[j][a:b] for j, a, b in some]) for x in (rows, seeds, ids)))
            at = 0
            for j, a, b in some:
                parts[j].append(answer[at : at + b - a])
                at += b - a
        answers = [_squeeze(np.concatenate(x)) for x in parts]
        yield pa.RecordBatch.from_arrays(
            [t["block"].combine_chunks(), pa.array([bucket] * len(size), pa.int32()), pa.array(size, pa.int32()), pa.array(answers, pa.binary())],
            ["block", "bucket", "n", "answer"],
        )


def removed_bytes(block: Block, at: np.ndarray, context: np.ndarray, alone: np.ndarray, answer: np.ndarray) -> np.ndarray:
    """True for every byte of the block that goes."""
    edge = np.zeros(len(block.buf) + 1, np.int16)  # fewer than LENGTH * _SPAN strings, and LENGTH + _WIDTH contexts, lie over a byte
    one = np.int16(1)
    if len(at):
        text = block.text_of(at)
        ids = block.ids[text]
        first = np.flatnonzero(np.r_[True, context[1:] != context[:-1]])
        lowest = np.minimum.reduceat(ids, first)[context]
        bits = answer[context]
        whole = (bits == _ALL) | (ids > lowest)
        p = at[whole]
        np.add.at(edge, np.where(alone[whole], p, np.maximum(p - (LENGTH - SEED), block.starts[text[whole]])), one)
        np.add.at(edge, np.minimum(p + LENGTH, block.ends[text[whole]]), -one)
        some = np.flatnonzero(~whole & (bits != 0))
        for shift in range(_SPAN):
            p = at[some[(bits[some] >> _U(shift)) & _U(1) == 1]] - (LENGTH - SEED) + shift
            np.add.at(edge, p, one)
            np.add.at(edge, p + LENGTH, -one)
    return np.cumsum(edge, dtype=np.int16, out=edge)[:-1] > 0


def removed_runs(block: Block, gone: np.ndarray, whole_characters: bool) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """(text, begin, end) of the maximal runs of ``gone``, each in one text; with ``whole_characters`` of characters whose bytes all go."""
    some = block.starts < block.ends
    edge = gone.copy()
    edge[1:] &= ~gone[:-1]
    edge[block.starts[some]] = gone[block.starts[some]]
    begin = np.flatnonzero(edge)
    edge = gone.copy()
    edge[:-1] &= ~gone[1:]
    edge[block.ends[some] - 1] = gone[block.ends[some] - 1]
    end = np.flatnonzero(edge) + 1
    del edge
    text = block.text_of(begin)
    if whole_characters:
        # only the characters at a run's two ends may stay in part
        while len(k := np.flatnonzero((begin < end) & (begin > block.starts[text]) & (block.around[begin + LENGTH - SEED] & 0xC0 == 0x80))):
            begin[k] += 1
        while len(k := np.flatnonzero((begin < end) & (end < block.ends[text]) & (block.around[end + LENGTH - SEED] & 0xC0 == 0x80))):
            end[k] -= 1
        text, begin, end = (x[begin < end] for x in (text, begin, end))
    return text, begin, end


def _kept(block: Block, text: np.ndarray, begin: np.ndarray, end: np.ndarray) -> list[bytes]:
    """The texts without their runs."""
    out = list(block.raw)
    first = np.flatnonzero(np.r_[True, text[1:] != text[:-1]]) if len(text) else text
    for a, b in zip(first.tolist(), [*first[1:].tolist(), len(text)], strict=True) if len(first) else ():
        k = int(text[a])
        start = int(block.starts[k])
        stops, goes_on = (begin[a:b] - start).tolist(), (end[a:b] - start).tolist()
        out[k] = b"".join([out[k][i:j] for i, j in zip([0, *goes_on], [*stops, len(out[k])], strict=True)])
    return out


def _finish(whole_characters: bool, names: list[str], digest: bool, counts: bool) -> Callable:
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for uri, t in _groups(batches, "block"):
            block = Block.read(f"{uri}.texts")
            parts = [(n, a) for n, a in zip(t["n"].to_pylist(), t["answer"].to_pylist(), strict=True) if a is not None]
            at, context, alone, answer = np.zeros(0, np.int64), np.zeros(0, np.int64), np.zeros(0, bool), np.zeros(0, _U)
            if parts:
                found = _read(f"{uri}.found")
                at, context, alone = found["at"].to_numpy().astype(np.int64), found["context"].to_numpy().astype(np.int64), found["alone"].to_numpy()
                answer = np.concatenate([_swell(a, n, _U) for n, a in parts])
            gone = removed_bytes(block, at, context, alone, answer)
            del at, context, alone, answer, parts
            text, begin, end = removed_runs(block, gone, whole_characters)
            del gone
            texts = _kept(block, text, begin, end)
            removed = np.zeros(len(texts), np.int64)
            np.add.at(removed, text, end - begin)
            extra = [pa.array(block.ends - block.starts), pa.array(removed), pa.array(np.bincount(text, minlength=len(texts)).astype(np.int64))]
            for a in range(0, len(texts), 4096):
                part = block.table.slice(a, 4096).combine_chunks()
                cols = []
                for n in names:
                    if n == "text" and whole_characters:
                        null = part["text"].is_null().to_pylist()
                        cols.append(pa.array([None if z else x.decode("utf-8", "surrogatepass") for x, z in zip(texts[a : a + 4096], null, strict=True)], pa.string()))
                    elif n == "text":
                        cols.append(pa.array([hashlib.sha256(x).hexdigest() for x in texts[a : a + 4096]], pa.string()) if digest else pa.array(texts[a : a + 4096], pa.binary()))
                    else:
                        c = part[n]
                        cols.append(c.combine_chunks() if isinstance(c, pa.ChunkedArray) else c)
                cols += [x.slice(a, 4096) for x in extra] * counts
                yield pa.RecordBatch.from_arrays(cols, [f"c{i}" for i in range(len(cols))])

    return run


def _lean(run: Callable) -> Callable:
    """``run`` without other operators' caches; what its arrays took goes back to the system.

    Workers outlive their step, and what one keeps stands beside the executor's own heap.
    """

    def task(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        worker_cache("suffix dedup")
        try:
            yield from run(batches)
        finally:
            give_back()

    return task


def remove_repeats(docs: DataFrame, whole_characters: bool = False, digest: bool = False, block_bytes: int | None = None, counts: bool = True, hot: int = HOT) -> DataFrame:
    """``docs`` with what earlier documents have taken out of ``text``.

    All columns stay; ``text`` becomes the kept bytes (binary), their SHA-256
    with ``digest``, or with ``whole_characters`` a string from which only whole
    characters are taken.  Added with ``counts``: n_bytes, n_removed, n_spans
    (columns of these names are replaced then, and stay without).  A null text is empty (and stays null as a string); a
    row with a null id is left as it is and takes nothing from others; rows of
    one id take nothing from each other; an empty table gives no rows.  ``hot``
    decides how anchors travel, not what is removed.
    """
    spark = prepare(docs.sparkSession)
    if counts:
        docs = docs.select([c for c in docs.columns if c not in ("n_bytes", "n_removed", "n_spans")])
    docs = docs.withColumn("doc_id", F.col("doc_id").cast("long")).withColumn("text", F.col("text").cast("string"))
    many, folder = partitions(spark), new_folder(spark, "blocks")
    fine = max(LEAST_RANGES, 4 * many)
    made = materialise(docs.mapInArrow(_lean(_make_blocks(folder, fine, block_bytes or block_size(fine))), _ASKED), "anchors")
    answered = "block string, bucket int, repeated binary, hot binary"

    def by_bucket(rows: DataFrame) -> DataFrame:
        return rows.repartition(many, "bucket").sortWithinPartitions("bucket", "block")

    repeated = materialise(by_bucket(made.where(F.col("bucket") >= 0)).mapInArrow(_lean(_find_repeated(hot)), answered), "repeated")
    blocks = materialise(made.where(F.col("bucket") < 0).select("block"), "blocks")
    discard(made)
    told = repeated.withColumn("strings", F.lit(None).cast("binary"))
    much = repeated.where(F.col("hot").isNotNull()).select("block", "bucket", "hot")
    strings = None
    if not much.isEmpty():
        asked = much.repartition(many, "block").sortWithinPartitions("block", "bucket").mapInArrow(_lean(_ask_strings(fine)), _ASKED)
        strings = materialise(by_bucket(asked).mapInArrow(_lean(_find_repeated(None)), answered), "strings")
        nothing = F.lit(None).cast("binary")
        told = told.unionByName(strings.select("block", "bucket", nothing.alias("repeated"), nothing.alias("hot"), F.col("repeated").alias("strings")))
    by_block = told.repartition(many, "block").sortWithinPartitions("block", "bucket")
    sent = by_block.mapInArrow(_lean(_send_contexts(fine)), "block string, bucket int, n int, seeds binary, lowest binary, rows binary")
    answers = materialise(by_bucket(sent).mapInArrow(_lean(_sort_shards), "block string, bucket int, n int, answer binary"), "answers")
    discard(*([repeated] if strings is None else [repeated, strings]))
    none = blocks.select("block", F.lit(-1).alias("bucket"), F.lit(0).alias("n"), F.lit(None).cast("binary").alias("answer"))
    tasks = answers.unionByName(none).repartition(many, "block").sortWithinPartitions("block", "bucket")
    names = docs.columns
    kind = T.StringType() if whole_characters or digest else T.BinaryType()
    fields = [T.StructField(n, kind if n == "text" else docs.schema[n].dataType) for n in names]
    fields += [T.StructField(n, T.LongType()) for n in ("n_bytes", "n_removed", "n_spans")] * counts
    plain = T.StructType([T.StructField(f"c{i}", f.dataType) for i, f in enumerate(fields)])
    return tasks.mapInArrow(_lean(_finish(whole_characters, names, digest, counts)), plain).toDF(*(f.name for f in fields))


def oracle() -> str:
    """The same by every string of every text, as hexadecimal digits of its bytes."""
    return f"""
WITH h AS (SELECT doc_id, row_number() OVER () AS d, hex(encode(coalesce(text, ''))) AS h FROM documents),
s AS (SELECT d, doc_id, p, substr(h, 2 * p - 1, {2 * LENGTH}) AS s FROM (SELECT d, doc_id, h, unnest(range(1, len(h) // 2 - {LENGTH} + 2)) AS p FROM h)),
m AS (SELECT s, min(doc_id) AS first FROM s GROUP BY s),
hit AS (SELECT d, p FROM s JOIN m USING (s) WHERE m.first < s.doc_id),
b AS (SELECT d, q, substr(h, 2 * q - 1, 2) AS x FROM (SELECT d, h, unnest(range(1, len(h) // 2 + 1)) AS q FROM h)),
g AS (SELECT b.d, q, x, coalesce(max(hit.p) OVER (PARTITION BY b.d ORDER BY q) > q - {LENGTH}, false) AS gone FROM b LEFT JOIN hit ON hit.d = b.d AND hit.p = b.q),
e AS (SELECT *, gone AND NOT coalesce(lag(gone) OVER (PARTITION BY d ORDER BY q), false) AS begins FROM g),
f AS (SELECT d, count(*) FILTER (gone) AS removed, count(*) FILTER (begins) AS spans, string_agg(x, '' ORDER BY q) FILTER (NOT gone) AS kept FROM e GROUP BY d)
SELECT CAST(doc_id AS BIGINT) AS doc_id, CAST(len(h) // 2 AS BIGINT) AS n_bytes, CAST(coalesce(removed, 0) AS BIGINT) AS n_removed, CAST(coalesce(spans, 0) AS BIGINT) AS n_spans,
  sha256(unhex(coalesce(kept, ''))) AS kept_sha256
FROM h LEFT JOIN f USING (d)"""
