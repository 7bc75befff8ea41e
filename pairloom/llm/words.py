"""64-bit hashes of words and word runs, for whole batches of texts at once.

A word is a maximal run of anything but ASCII white space (x20, x09-x0D).  Its
hash comes from prefix sums of byte * BASE ** place modulo 2 ** 64, divided by
the power at its start (BASE is odd, so it has an inverse), then mixed.
"""

from __future__ import annotations

import numpy as np

_BASE = 0x9E3779B97F4A7C15
_INVERSE = pow(_BASE, -1, 1 << 64)
_U = np.uint64
_SPACE = np.zeros(256, bool)
_SPACE[[32, *range(9, 14)]] = True
_LOWER = np.arange(256, dtype=np.uint8)
_LOWER[65:91] += 32
#: Bytes hashed together; longer texts are hashed alone.
_CHUNK = 1 << 20
_powers: list[np.ndarray] = []


def _tables(n: int) -> tuple[np.ndarray, np.ndarray]:
    if not _powers or len(_powers[0]) < n:
        size = max(n, _CHUNK + 1)
        _powers[:] = []
        for base in (_BASE, _INVERSE):
            p = np.full(size, base, _U)
            p[0] = 1
            np.multiply.accumulate(p, out=p)
            _powers.append(p)
    return _powers[0], _powers[1]


def mix(h: np.ndarray) -> np.ndarray:
    h = (h ^ (h >> _U(30))) * _U(0xBF58476D1CE4E5B9)
    h = (h ^ (h >> _U(27))) * _U(0x94D049BB133111EB)
    return h ^ (h >> _U(31))


def word_hashes(texts: list[bytes], lower: bool = False) -> list[np.ndarray]:
    """One array per text: the hashes of its words in order."""
    out: list[np.ndarray] = []
    at = 0
    while at < len(texts):
        size, end = 0, at
        while end < len(texts) and (end == at or size + len(texts[end]) < _CHUNK):
            size += len(texts[end]) + 1
            end += 1
        out += _hash_chunk(texts[at:end], lower)
        at = end
    return out


def _hash_chunk(texts: list[bytes], lower: bool) -> list[np.ndarray]:
    buf = np.frombuffer(b"\n".join(texts) + b"\n", np.uint8)
    if lower:
        buf = _LOWER[buf]
    power, inverse = _tables(len(buf) + 1)
    space = _SPACE[buf]
    edge = np.flatnonzero(space[1:] != space[:-1]) + 1
    if not space[0]:
        edge = np.r_[0, edge]
    start, end = edge[::2], edge[1::2]
    total = np.cumsum((buf.astype(_U) + _U(1)) * power[: len(buf)])
    total = np.r_[_U(0), total]
    h = mix((total[end] - total[start]) * inverse[start] + (end - start).astype(_U))
    cut = np.searchsorted(start, np.cumsum([len(t) + 1 for t in texts])[:-1])
    return np.split(h, cut)


def run_hashes(h: np.ndarray, size: int) -> np.ndarray:
    """Hashes of all runs of ``size`` words, in order; of fewer words, one of all."""
    size = min(size, len(h))
    if not size:
        return h[:0]
    out = h[: len(h) - size + 1] + _U(size)
    for k in range(1, size):
        out = mix(out * _U(_BASE) + h[k : len(h) - size + 1 + k])
    return mix(out)


def shingle_sets(texts: list[bytes], size: int) -> list[np.ndarray]:
    """Sorted distinct ``size``-word shingles of each text, ASCII lower-cased."""
    out = []
    for h in word_hashes(texts, lower=True):
        s = np.sort(run_hashes(h, size))
        out.append(s[np.r_[True, s[1:] != s[:-1]]] if len(s) else s)
    return out
