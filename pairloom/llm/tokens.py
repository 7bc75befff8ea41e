"""Token ids of whole texts, put together from ids of their distinct chunks.

Byte-level vocabularies tokenise each match of a splitting pattern on its own,
so ids of a text are a concatenation of ids of its matches.  A batch of texts
is cut at places that are certainly between two matches (``cut_places``), its
chunks are dictionary-encoded in Arrow, and only chunks that the worker has not
met lately reach the pattern and the merge engine.  Ids of the batch are then
one ``take`` over the dictionary.
"""

from __future__ import annotations

import heapq
import json
import re
from collections.abc import Callable, Iterator, Sequence
from itertools import chain

import numpy as np
import pyarrow as pa

from pairloom.llm._shared import worker_cache

#: Letters, numbers and white space of the first 256 code points.
_LETTERS = "A-Za-z\xaa\xb5\xba\xc0-\xd6\xd8-\xf6\xf8-\xff"
_NUMBERS = "0-9\xb2\xb3\xb9\xbc-\xbe"
_SPACES = "\t-\r \x85\xa0"

#: Entries a worker keeps in each of its tables.
MEMO_ENTRIES = 600_000
#: Longer chunks (in characters) are not kept.
MEMO_CHARACTERS = 64
#: Bytes of text that are encoded together, unless one row is longer.
GATHER_BYTES = 12 * 1024 * 1024

_UNKNOWN, _LETTER, _DIGIT, _SPACE, _BLANK, _OTHER, _QUOTE = range(7)


def _classes() -> np.ndarray:
    """Class of each ASCII byte; control characters and all other bytes are unknown."""
    out = np.zeros(256, np.uint8)
    for c in range(33, 127):
        out[c] = _LETTER if chr(c).isalpha() else _DIGIT if chr(c).isdigit() else _OTHER
    out[ord("'")], out[32] = _QUOTE, _SPACE
    out[9:14] = _BLANK
    return out


def _pairs_of(pairs: list[tuple[int, int]]) -> np.ndarray:
    out = np.zeros(64, bool)
    out[[8 * a + b for a, b in pairs]] = True
    return out


_CLASS = _classes()
_INK, _WHITE = (_LETTER, _DIGIT, _OTHER, _QUOTE), (_SPACE, _BLANK)
#: By 8 * one class + the next: a match can't go on from one to the other (a quote may begin a contraction).
_BETWEEN = _pairs_of(
    [(a, b) for a in _INK for b in _WHITE] + [(a, b) for a in (_LETTER, _DIGIT) for b in _INK if a != b] + [(_OTHER, _LETTER), (_OTHER, _DIGIT)]
)
_BOTH_WHITE = _pairs_of([(a, b) for a in _WHITE for b in _WHITE])
_IS_INK = np.isin(np.arange(8), _INK)


def kinds_of(buf: np.ndarray) -> np.ndarray:
    """Class of each byte: ASCII, and letters of Latin-1; all else is unknown."""
    kind = _CLASS[buf]
    lead = np.flatnonzero(buf[:-1] == 0xC3)
    lead = lead[(buf[lead + 1] != 0x97) & (buf[lead + 1] != 0xB7)]  # the signs of times and division
    kind[lead] = kind[lead + 1] = _LETTER
    return kind


def cut_places(kind: np.ndarray, starts: np.ndarray) -> np.ndarray:
    """Places where a match begins whatever stands around: a subset of all, sorted, with ``starts``.

    ``kind`` is that of texts in UTF-8 back to back that begin at ``starts``.
    """
    n = len(kind)
    cut = np.zeros(n + 1, bool)
    if n > 1:
        step = (kind[:-1] << 3) | kind[1:]
        cut[1:-1] = _BETWEEN[step]
        # of white space before ink the last character is a match of its own, or begins one if it is a space
        last = np.flatnonzero(_BOTH_WHITE[step]) + 1
        last = last[last < n - 1]
        last = last[_IS_INK[kind[last + 1]]]
        blank = np.flatnonzero(kind[:-1] == _BLANK)
        blank = blank[_IS_INK[kind[blank + 1]]]
        blank = blank[(blank == 0) | (kind[blank - 1] != _UNKNOWN)]
        mark = np.zeros(n + 1, bool)
        mark[last] = True
        mark[starts[starts > 0] - 1] = False  # what follows is another text
        cut |= mark
        cut[blank + 1] = True
    cut[starts] = True
    cut[-1] = False
    return np.flatnonzero(cut)


class Memo:
    """A table of bounded size: when half of it is full, what was not used since the last time goes."""

    def __init__(self, entries: int):
        self.half = max(1, entries // 2)
        self.now: dict[str, bytes] = {}
        self.old: dict[str, bytes] = {}

    def get(self, keys: list[str], make: Callable[[np.ndarray], list[bytes]]) -> list[bytes]:
        """Values of distinct ``keys``; those not at hand are made, given their places."""
        out = list(map(self.now.get, keys))
        missing = [k for k, v in enumerate(out) if v is None]
        if not missing:
            return out
        old = list(map(self.old.get, map(keys.__getitem__, missing))) if self.old else [None] * len(missing)
        fresh = [k for k, v in zip(missing, old, strict=True) if v is None]
        for k, v in zip(missing, old, strict=True):
            out[k] = v
        for k, v in zip(fresh, make(np.array(fresh, np.int64)) if fresh else (), strict=True):
            out[k] = v
        if len(self.now) + len(missing) > self.half:
            self.old, self.now = self.now, {}
            missing = missing[-self.half :]
        self.now.update((keys[k], out[k]) for k in missing if len(keys[k]) <= MEMO_CHARACTERS)
        return out


def latin_pattern(pattern: str) -> re.Pattern:
    """``pattern`` for texts below U+0100, with classes that ``re`` understands."""
    inside = {r"\p{L}": _LETTERS, r"\p{N}": _NUMBERS, r"\s": _SPACES}

    def brackets(m: re.Match) -> str:
        body = m[0]
        for k, v in inside.items():
            body = body.replace(k, v)
        return body

    out = re.sub(r"\[[^\]]*\]", brackets, pattern)
    out = out.replace(r"(?!\S)", f"(?![^{_SPACES}])")
    for k, v in inside.items():
        out = out.replace(k, f"[{v}]")
    return re.compile(out)


def is_latin(text: str) -> bool:
    if text.isascii():
        return True
    try:
        text.encode("latin-1")
    except UnicodeEncodeError:
        return False
    return True


class ChunkCoder:
    """ids of texts by way of their distinct chunks.

    ``encode_many`` maps pattern matches (their UTF-8 back to back, and the
    length of each) to packed little-endian unsigned 32-bit ids.  Chunks below
    U+0100 are split by ``pattern`` here; others by the ``regex`` module, or
    they go whole to ``encode_wide`` if that is given.  With ``word_ends``
    matches have no spaces, are lower-cased, and digits stand alone.
    """

    def __init__(self, pattern: str, encode_many: Callable[[np.ndarray, np.ndarray], list[bytes]], word_ends: bool = False, encode_wide: Callable[[list[str]], list[bytes]] | None = None, entries: int = MEMO_ENTRIES):
        import regex

        self.wide = regex.compile(pattern)
        self.narrow = latin_pattern(pattern)
        self.encode_many = encode_many
        self.encode_wide = encode_wide
        self.word_ends = word_ends
        self.memo = Memo(entries)

    def _make(self, chunks: pa.LargeStringArray) -> list[bytes]:
        """ids of distinct chunks: those of one kind of character are one match, the rest is split."""
        n = len(chunks)
        bounds = np.frombuffer(chunks.buffers()[1], np.int64, n + 1, 8 * chunks.offset)
        buf = np.frombuffer(chunks.buffers()[2], np.uint8, int(bounds[-1] - bounds[0]), int(bounds[0]))
        starts, size = bounds[:-1] - bounds[0], np.diff(bounds)
        kind = kinds_of(buf)
        spaced = (kind[starts] == _SPACE) & (size > 1)
        first = starts + spaced
        least = np.minimum.reduceat(kind, np.stack([first, starts + size - 1]).T.ravel())[::2] if n else size
        most = np.maximum.reduceat(kind, np.stack([first, starts + size - 1]).T.ravel())[::2] if n else size
        end = kind[starts + size - 1]
        one = (np.minimum(least, end) == np.maximum(most, end)) & ((end == _LETTER) | (end == _OTHER) | (end == _DIGIT))
        if self.word_ends:
            one &= (end != _DIGIT) | (size == 1 + spaced)
            starts, size = first, size - spaced
            buf = _LOWER[buf]
            upper = np.flatnonzero((buf[:-1] == 0xC3) & (buf[1:] >= 0x80) & (buf[1:] <= 0x9E) & (buf[1:] != 0x97))
            buf[upper + 1] += 0x20
        out = np.empty(n, object)
        simple = np.flatnonzero(one)
        out[simple] = self._run(buf, starts[simple], size[simple])
        rest = np.flatnonzero(~one)
        for k, x in zip(rest.tolist(), self._split(chunks.take(pa.array(rest)).to_pylist()), strict=True):
            out[k] = x
        return out.tolist()

    def _run(self, buf: np.ndarray, starts: np.ndarray, size: np.ndarray) -> np.ndarray:
        out = np.empty(len(starts), object)
        ends = np.cumsum(size)
        flat = buf[np.arange(int(size.sum())) + np.repeat(starts - ends + size, size)]
        out[:] = self.encode_many(flat, size)
        return out

    def _split(self, chunks: list[str]) -> list[bytes]:
        out: list[bytes] = [b""] * len(chunks)
        found: list[list[str]] = []
        own, wide = [], []
        for k, c in enumerate(chunks):
            if is_latin(c) and not (self.word_ends and _SEPARATORS.search(c)):
                own.append(k)
                found.append(self.narrow.findall(c.lower() if self.word_ends else c))
            elif self.encode_wide:
                wide.append(k)
            else:
                own.append(k)
                found.append(self.wide.findall(c))
        if wide:
            for k, x in zip(wide, self.encode_wide([chunks[k] for k in wide]), strict=True):
                out[k] = x
        matches = list(dict.fromkeys(chain.from_iterable(found)))
        raw = [m.encode("utf-8") for m in matches]
        ids = dict(zip(matches, self.encode_many(np.frombuffer(b"".join(raw), np.uint8), np.fromiter(map(len, raw), np.int64, len(raw))), strict=True))
        for k, x in zip(own, found, strict=True):
            out[k] = b"".join(map(ids.__getitem__, x))
        return out

    def encode_flat(self, texts: pa.Array) -> tuple[np.ndarray, np.ndarray]:
        """(ids of all texts one after another, where each text's end); a null text has none."""
        texts = texts.cast(pa.large_string())
        n = len(texts)
        bounds = np.frombuffer(texts.buffers()[1], np.int64, n + 1, 8 * texts.offset) if n else np.zeros(1, np.int64)
        low, high = int(bounds[0]), int(bounds[-1])
        if low == high:
            return np.zeros(0, np.uint32), np.zeros(n, np.int64)
        data = texts.buffers()[2]
        starts = bounds[:-1] - low
        places = cut_places(kinds_of(np.frombuffer(data, np.uint8, high - low, low)), starts[bounds[1:] > bounds[:-1]])
        ends = np.concatenate([places, [high - low]]) + low
        chunks = pa.LargeStringArray.from_buffers(len(places), pa.py_buffer(ends), data).dictionary_encode()
        kinds = chunks.dictionary
        values = self.memo.get(kinds.to_pylist(), lambda at: self._make(kinds.take(pa.array(at))))
        taken = pa.array(values, pa.large_binary()).take(chunks.indices)
        edge = np.frombuffer(taken.buffers()[1], np.int64, len(taken) + 1, 8 * taken.offset)
        ids = np.frombuffer(taken.buffers()[2], "<u4", int(edge[-1] - edge[0]) // 4, int(edge[0])) if edge[-1] > edge[0] else np.zeros(0, "<u4")
        return ids, (edge[np.searchsorted(places, bounds[1:] - low)] - edge[0]) // 4

    def encode(self, texts: list[str]) -> list[bytes]:
        """ids of each text as packed little-endian unsigned 32-bit integers."""
        ids, ends = self.encode_flat(pa.array(texts, pa.large_string()))
        raw, ends = ids.tobytes(), (4 * ends).tolist()
        return [raw[a:b] for a, b in zip([0, *ends[:-1]], ends, strict=True)]


_LOWER = np.arange(256, dtype=np.uint8)
_LOWER[65:91] += 32
#: Controls that some engines take for white space.
_SEPARATORS = re.compile("[\x1c-\x1f]")


def gathered(batches: Iterator[pa.RecordBatch], size: int = GATHER_BYTES) -> Iterator[pa.RecordBatch]:
    """Batches put together up to ``size`` bytes: more of their chunks are the same."""
    held: list[pa.RecordBatch] = []
    have = 0
    for b in batches:
        if held and have + b.nbytes > size:
            yield pa.concat_batches(held)
            held, have = [], 0
        held.append(b)
        have += b.nbytes
    if held:
        yield pa.concat_batches(held)


def merge_by_heap(ids: list[int], pairs: dict[int, int], made: Sequence[int]) -> list[int]:
    """Byte-pair merges of one word; ``pairs`` has the rank of (left << 20) | right, ``made`` the id of a rank's merge.

    The symbols are a linked list; pairs wait in a heap by (rank, place of the
    left one), and a pair that has changed since is passed over.
    """
    n = len(ids)
    after, before = list(range(1, n + 1)), list(range(-1, n - 1))
    get, push, pop = pairs.get, heapq.heappush, heapq.heappop
    heap = [(r << 32) | i for i in range(n - 1) if (r := get((ids[i] << 20) | ids[i + 1])) is not None]
    heapq.heapify(heap)
    while heap:
        top = pop(heap)
        r, i = top >> 32, top & 0xFFFFFFFF
        j = after[i]
        if ids[i] < 0 or j >= n or get((ids[i] << 20) | ids[j]) != r:
            continue
        new = ids[i] = made[r]
        ids[j] = -1
        k = after[i] = after[j]
        if k < n:
            before[k] = i
            if (x := get((new << 20) | ids[k])) is not None:
                push(heap, (x << 32) | i)
        p = before[i]
        if p >= 0 and (x := get((ids[p] << 20) | new)) is not None:
            push(heap, (x << 32) | p)
    return [x for x in ids if x >= 0]


class MergeTable:
    """Byte-pair merges of many words at once: one merge per word and round.

    A round takes the leftmost lowest-ranked pair of every unfinished word,
    which is the order a priority queue over each word gives.  Words of more
    than ``LONG`` symbols, whose rounds would cost the square of their length,
    go through such a queue.  Ids and ranks have up to 20 bits.
    """

    NONE = np.int32(2**31 - 1)
    LONG = 96
    _EMPTY = np.uint64(2**64 - 1)

    def __init__(self, left: np.ndarray, right: np.ndarray, made: np.ndarray):
        self.key = (left.astype(np.uint64) << np.uint64(20)) | right.astype(np.uint64)
        self.made = made.astype(np.int32)
        self.pairs: dict[int, int] = {}  # made when a long word comes
        self.made_list: list[int] = []
        # open addressing: an entry is the pair and its rank, at the pair's slot or one of those behind it
        self.bits = int(16 * len(self.key)).bit_length()
        self.table = np.full((1 << self.bits) + 64, self._EMPTY, np.uint64)
        todo, step = np.arange(len(self.key)), 0
        while len(todo):
            slot = self._slot(self.key[todo]) + step
            spot, first = np.unique(slot, return_index=True)
            free = self.table[spot] == self._EMPTY
            spot, first = spot[free], first[free]
            self.table[spot] = (self.key[todo[first]] << np.uint64(20)) | todo[first].astype(np.uint64)
            todo = np.delete(todo, first)
            step += 1

    def _slot(self, key: np.ndarray) -> np.ndarray:
        return ((key * np.uint64(0x9E3779B97F4A7C15)) >> np.uint64(64 - self.bits)).astype(np.int64)

    def look(self, a: np.ndarray, b: np.ndarray) -> np.ndarray:
        """Rank of the merge of each pair; -1 stands for a place after the word."""
        q = ((a.astype(np.int64) << 20) | b).view(np.uint64)
        slot = self._slot(q)
        entry = self.table[slot]
        hit = (entry >> np.uint64(20)) == q
        out = np.where(hit, (entry & np.uint64(0xFFFFF)).astype(np.int32), self.NONE)
        more = np.nonzero(~hit & (entry != self._EMPTY))
        slot, q = slot[more], q[more]
        while len(slot):
            slot += 1
            entry = self.table[slot]
            hit = (entry >> np.uint64(20)) == q
            out[tuple(m[hit] for m in more)] = (entry[hit] & np.uint64(0xFFFFF)).astype(np.int32)
            go = ~hit & (entry != self._EMPTY)
            more, slot, q = tuple(m[go] for m in more), slot[go], q[go]
        return out

    def run(self, symbols: np.ndarray, sizes: np.ndarray) -> list[bytes]:
        """``symbols`` of all words one after another, ``sizes`` of each."""
        starts = np.cumsum(sizes) - sizes
        order = np.argsort(sizes, kind="stable")
        out: list[bytes] = [b""] * len(sizes)
        at, short = 0, int(np.searchsorted(sizes[order], self.LONG, "right"))
        while at < short:
            # rows of like size: padding stays small, and so does the block
            first = max(1, int(sizes[order[at]]))
            end = min(short, at + max(1, min(4096, 200_000 // first)))
            end = max(at + 1, at + int(np.searchsorted(sizes[order[at:end]], first + first // 8 + 1, "right")))
            self._block(symbols, starts[order[at:end]], sizes[order[at:end]], order[at:end], out)
            at = end
        if short < len(order) and not self.pairs:
            self.pairs, self.made_list = dict(zip(self.key.tolist(), range(len(self.key)), strict=True)), self.made.tolist()
        for k in order[short:].tolist():
            word = symbols[starts[k] : starts[k] + sizes[k]].tolist()
            out[k] = np.array(merge_by_heap(word, self.pairs, self.made_list), "<u4").tobytes()
        return out

    def _block(self, symbols, starts, sizes, rows, out) -> None:
        width = int(sizes.max())
        if not width:
            return
        columns = np.arange(width, dtype=np.int32)
        place = np.minimum(starts[:, None] + columns, len(symbols) - 1)
        s = np.where(columns < sizes[:, None], symbols[place], -1).astype(np.int32)
        pair = np.full(s.shape, self.NONE, np.int32)
        pair[:, :-1] = self.look(s[:, :-1], s[:, 1:])
        while len(rows):
            best = pair.argmin(1).astype(np.int32)
            rank = pair[np.arange(len(rows)), best]
            done = rank == self.NONE
            if done.any():
                self._emit(s[done], rows[done], out)
                live = np.flatnonzero(~done)
                rows, s, pair, best, rank = rows[live], s[live], pair[live], best[live], rank[live]
                if not len(rows):
                    return
            n = np.arange(len(rows))
            right = columns[:-1] > best[:, None]
            s[:, :-1] = np.where(right, s[:, 1:], s[:, :-1])
            pair[:, :-1] = np.where(right, pair[:, 1:], pair[:, :-1])
            s[:, -1], pair[:, -1] = -1, self.NONE
            s[n, best] = self.made[rank]
            pair[n, best] = self.look(s[n, best], s[n, np.minimum(best + 1, width - 1)])
            pair[n[best == width - 1], -1] = self.NONE
            m = np.flatnonzero(best > 0)
            b = best[m] - 1
            pair[m, b] = self.look(s[m, b], s[m, b + 1])

    @staticmethod
    def _emit(s, rows, out) -> None:
        kept = s >= 0
        data = s[kept].astype("<u4").tobytes()
        ends = (np.cumsum(kept.sum(1)) * 4).tolist()
        at = 0
        for r, e in zip(rows.tolist(), ends, strict=True):
            out[r] = data[at:e]
            at = e


def byte_symbols() -> list[str]:
    """The printable character that stands for each byte in byte-level files."""
    plain = [*range(33, 127), *range(161, 173), *range(174, 256)]
    spare = iter(range(256, 512))
    return [chr(b) if b in plain else chr(next(spare)) for b in range(256)]


class LibraryCoder:
    """ids as ``tokenizers`` gives them for a byte-pair vocabulary file.

    Chunks below U+0100 are merged by ``MergeTable``, all others go to the
    library as they are.  Names of added tokens within texts are plain text
    (``encode_special_tokens``, as the vocabulary files' notes advise).
    """

    def __init__(self, path: str):
        import os

        os.environ["TOKENIZERS_PARALLELISM"] = "false"
        from tokenizers import Tokenizer

        with open(path, encoding="utf-8") as f:
            spec = json.load(f)
        model, vocab = spec["model"], spec["model"]["vocab"]
        self.library = Tokenizer.from_file(path)
        self.library.encode_special_tokens = True
        self.end = model["end_of_word_suffix"] or ""
        merges = [m.split(" ") if isinstance(m, str) else m for m in model["merges"]]
        self.table = MergeTable(*(np.array([vocab[x] for x in col]) for col in (
            [a for a, _ in merges], [b for _, b in merges], [a + b for a, b in merges])))
        symbols = byte_symbols()
        self.first = np.array([vocab[c] for c in symbols], np.int32)
        self.last = np.array([vocab[c + self.end] for c in symbols], np.int32)
        self.words = bool(self.end)
        if self.words:
            pattern = spec["pre_tokenizer"]["pretokenizers"][0]["pattern"]["Regex"]
        else:
            import public_tokenizers

            pattern = public_tokenizers.PATTERN
        # with word ends the normaliser composes, folds case and collapses white space: lower() below U+0100
        self.coder = ChunkCoder(pattern, self.merged, self.words, self.by_library)

    def by_library(self, texts: list[str]) -> list[bytes]:
        return [np.array(e.ids, "<u4").tobytes() for e in self.library.encode_batch_fast(texts, add_special_tokens=False)]

    def merged(self, flat: np.ndarray, sizes: np.ndarray) -> list[bytes]:
        """ids of pattern matches below U+0100, given as bytes."""
        symbols = self.first[flat]
        ends = np.cumsum(sizes)[sizes > 0] - 1
        symbols[ends] = self.last[flat[ends]]
        return self.table.run(symbols, sizes)

    def encode_flat(self, texts: pa.Array) -> tuple[np.ndarray, np.ndarray]:
        return self.coder.encode_flat(texts)

    def encode(self, texts: list[str]) -> list[bytes]:
        return self.coder.encode(texts)


def library_coder(path: str) -> LibraryCoder:
    """One per worker process, whatever the number of tasks it runs."""
    held = worker_cache(f"tokens {path}")
    if path not in held:
        held[path] = LibraryCoder(path)
    return held[path]
