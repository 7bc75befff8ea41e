"""Suffix arrays by prefix doubling, and common prefixes, in numpy.

``suffix_order`` is Larsson and Sadakane's refinement: suffixes are sorted by
their first bytes, then groups that are still equal are sorted again by the
group of the suffix a step further on, the step doubling each time; groups that
are alone are left in peace, and refinement ends when all are.  ``common_prefixes`` is Kasai's scan: a suffix shares at least
one byte less with its predecessor than the suffix before it did; all strips
(texts of equal length one after another) are scanned at once.
"""

from __future__ import annotations

import numpy as np


#: Suffixes of open groups that are refined at a time, unless one group has more.
_OPEN = 1 << 18


def _places(n: int) -> type:
    """Four bytes for places and ranks where they fit; arrays of all suffixes are most of what a task holds."""
    return np.int32 if n < 1 << 29 else np.int64


def suffix_order(text: np.ndarray) -> np.ndarray:
    """Places of all suffixes in order; one that ends comes before its continuations."""
    n = len(text)
    kind = _places(n)
    if not n:
        return np.zeros(0, kind)
    padded = np.concatenate([text, np.zeros(8, np.uint8)])
    word = np.zeros(n, np.uint64)
    for k in range(8):
        word <<= np.uint64(8)
        word |= padded[k : n + k]
    order = np.argsort(word).astype(kind)
    word = word[order]
    first = np.r_[True, word[1:] != word[:-1]]
    del word
    rank = np.empty(n, kind)
    head = np.where(first, np.arange(n, dtype=kind), kind(0))
    rank[order] = np.maximum.accumulate(head, out=head)
    del head
    step = 8
    while True:
        # places in the order that belong to groups of several suffixes
        alone = first & np.r_[first[1:], True]
        every = np.flatnonzero(~alone).astype(kind)
        if not len(every):
            return order
        starts = np.r_[np.flatnonzero(first[every]), len(every)]
        low = 0
        while low < len(every):  # whole groups; ranks that others got in this round only tell more
            high = int(starts[max(np.searchsorted(starts, low + _OPEN, "right") - 1, np.searchsorted(starts, low, "right"))])
            open_ = every[low:high]
            low = high
            at = order[open_]
            ahead = at + kind(step)
            # a suffix that ends within the step comes first, the shortest of all at the front
            key = rank[at].astype(np.int64) << 32
            key |= np.where(ahead < n, rank[np.minimum(ahead, n - 1)] + kind(step + 1), n - at)
            turn = np.argsort(key)
            at, key = at[turn], key[turn]
            order[open_] = at
            new = np.r_[True, key[1:] != key[:-1]]
            first[open_] = new
            rank[at] = np.maximum.accumulate(np.where(new, open_, kind(0)))
        step *= 2


def common_prefixes(text: np.ndarray, order: np.ndarray, width: int, most: int) -> np.ndarray:
    """Bytes that each suffix shares with the one before it in ``order``, at most ``most``.

    ``text`` is strips of ``width`` bytes; entry [i] belongs to the suffix at i.
    """
    n = len(text)
    before = np.full(n, -1, _places(n))
    before[order[1:]] = order[:-1]
    out = np.zeros(n, _places(n))
    strips = np.arange(0, n, width)
    h = np.zeros(len(strips), np.int64)
    for k in range(width):
        at = strips + k
        prev = before[at]
        h = np.where(prev < 0, 0, np.maximum(h - 1, 0))
        live = np.flatnonzero((prev >= 0) & (h < most))
        while len(live):
            a, b = at[live] + h[live], prev[live] + h[live]
            ok = (a < n) & (b < n)
            ok &= text[np.minimum(a, n - 1)] == text[np.minimum(b, n - 1)]
            live = live[ok]
            h[live] += 1
            live = live[h[live] < most]
        out[at] = h
    return out
