"""Operator 1: byte-level BPE by two-tier lookup, and the way back.

First tier: a minimal perfect hash over the vocabulary answers for pre-tokens
that are tokens themselves.  Second tier: the bytes of any other pre-token form
a linked list whose neighbouring pairs wait in a heap by (rank, place); the
lowest pair is merged until none is left.
"""

from __future__ import annotations

import base64
import hashlib
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame

from pairloom.llm._shared import id_text, prepare, worker_cache
from pairloom.llm.tokens import ChunkCoder, gathered, merge_by_heap


class PerfectHash:
    """Minimal perfect hash by displacement: n keys fill exactly n slots.

    Buckets of several keys get a displacement that sends all of them to free
    slots, largest buckets first; a bucket of one key stores its slot.
    """

    def __init__(self, keys: list[bytes]):
        import xxhash

        self.n = max(1, len(keys))
        self.keys: list[bytes | None] = [None] * self.n
        self.values = np.zeros(self.n, np.int64)
        self.shift = [0] * self.n
        buckets: list[list[tuple[int, int]]] = [[] for _ in range(self.n)]
        for value, key in enumerate(keys):
            h = xxhash.xxh3_64_intdigest(key)
            buckets[h % self.n].append((h, value))
        order = sorted(range(self.n), key=lambda b: -len(buckets[b]))
        taken = bytearray(self.n)
        free = 0
        for b in order:
            group = buckets[b]
            if len(group) > 1:
                d = 1
                while True:
                    slots = {self._slot(h, d) for h, _ in group}
                    if len(slots) == len(group) and not any(taken[s] for s in slots):
                        break
                    d += 1
                self.shift[b] = d
                for h, value in group:
                    self._put(self._slot(h, d), value, keys[value], taken)
            elif group:
                while taken[free]:
                    free += 1
                self.shift[b] = -free - 1
                self._put(free, group[0][1], keys[group[0][1]], taken)
        self.values = self.values.tolist()

    def _slot(self, h: int, d: int) -> int:
        return ((h >> 17) ^ (d * 0x9E3779B97F4A7C15 & 0xFFFFFFFFFFFF)) % self.n

    def _put(self, slot: int, value: int, key: bytes, taken: bytearray) -> None:
        taken[slot] = 1
        self.keys[slot], self.values[slot] = key, value

    def get(self, key: bytes) -> int:
        """The key's number, or -1."""
        import xxhash

        h = xxhash.xxh3_64_intdigest(key)
        d = self.shift[h % self.n]
        slot = -d - 1 if d < 0 else self._slot(h, d)
        return self.values[slot] if self.keys[slot] == key else -1


class ByteBpe:
    """Encoder and decoder for a vocabulary in rank order."""

    def __init__(self, vocabulary: list[bytes], pattern: str):
        self.vocabulary = vocabulary
        self.whole = PerfectHash(vocabulary)
        index = {t: k for k, t in enumerate(vocabulary)}
        self.byte = [index[bytes([b])] for b in range(256)]
        #: rank of the token that a pair of tokens makes; every pair lies within a token, so the table is bounded
        self.pairs = {
            (a << 20) | b: rank
            for rank, t in enumerate(vocabulary)
            for cut in range(1, len(t))
            if (a := index.get(t[:cut])) is not None and (b := index.get(t[cut:])) is not None
        }
        self.made = range(len(vocabulary))
        #: each token's bytes, and its decimal number with a comma: texts of both are one ``take``
        self.bytes = pa.array(vocabulary, pa.large_binary())
        self.decimals = pa.array([b"%d," % k for k in range(len(vocabulary))], pa.large_binary())
        self.coder = ChunkCoder(pattern, self._many)

    @classmethod
    def from_file(cls, path: str, pattern: str) -> ByteBpe:
        with open(path, "rb") as f:
            ranks = dict((int(r), base64.b64decode(t)) for t, r in (line.split() for line in f if line.strip()))
        return cls([ranks[k] for k in range(len(ranks))], pattern)

    def word(self, raw: bytes) -> list[int]:
        """ids of one pre-token."""
        rank = self.whole.get(raw)
        return [rank] if rank >= 0 else self.merge(raw)

    def merge(self, raw: bytes) -> list[int]:
        return merge_by_heap([self.byte[b] for b in raw], self.pairs, self.made)

    def _many(self, flat: np.ndarray, sizes: np.ndarray) -> list[bytes]:
        raw, ends = flat.tobytes(), np.cumsum(sizes).tolist()
        found = [self.word(raw[a:b]) for a, b in zip([0, *ends[:-1]], ends, strict=False)]
        many = np.cumsum(np.fromiter(map(len, found), np.int64, len(found)) * 4).tolist()
        packed = np.array([x for f in found for x in f], "<u4").tobytes()
        return [packed[a:b] for a, b in zip([0, *many[:-1]], many, strict=False)]

    def encode_batch(self, texts: pa.Array) -> tuple[np.ndarray, np.ndarray]:
        """(ids of all texts one after another, where each text's end)."""
        return self.coder.encode_flat(texts)

    @staticmethod
    def _joined(table: pa.Array, ids: np.ndarray, ends: np.ndarray) -> tuple[memoryview, np.ndarray]:
        """Entries of ``table`` for all ids back to back, and where each text's end."""
        taken = table.take(pa.array(ids))
        edge = np.frombuffer(taken.buffers()[1], np.int64, len(taken) + 1, 8 * taken.offset)
        return memoryview(taken.buffers()[2] or b"")[int(edge[0]) :], edge[ends] - edge[0]

    def decode_batch(self, ids: np.ndarray, ends: np.ndarray) -> tuple[memoryview, np.ndarray]:
        """Bytes that ids stand for, of all texts, and where each text's end."""
        return self._joined(self.bytes, ids, ends)

    def decimal_batch(self, ids: np.ndarray, ends: np.ndarray) -> tuple[memoryview, np.ndarray]:
        """Decimal ids, each with a comma behind it."""
        return self._joined(self.decimals, ids, ends)

    def decode(self, ids) -> bytes:
        return b"".join(map(self.vocabulary.__getitem__, ids))


def engine(path: str, pattern: str) -> ByteBpe:
    """One per worker process."""
    held = worker_cache("byte bpe")
    if (path, pattern) not in held:
        held[path, pattern] = ByteBpe.from_file(path, pattern)
    return held[path, pattern]


def encode(docs: DataFrame, path: str, pattern: str) -> DataFrame:
    """doc_id, ids: one row per row of ``docs``; a null text has no ids."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        coder = engine(path, pattern)
        for b in batches:
            flat, ends = coder.encode_batch(b["text"])
            ids = pa.ListArray.from_arrays(pa.array(np.r_[0, ends].astype(np.int32)), pa.array(flat.astype(np.int32)))
            yield pa.RecordBatch.from_arrays([b["doc_id"], ids], ["doc_id", "ids"])

    prepare(docs.sparkSession)
    return id_text(docs).mapInArrow(run, "doc_id long, ids array<int>")


def decode(tokens: DataFrame, path: str, pattern: str) -> DataFrame:
    """doc_id, bytes: the bytes that ``ids`` stand for; null ids give none."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        coder = engine(path, pattern)
        for b in batches:
            raw = pa.array([coder.decode(x or ()) for x in b["ids"].to_pylist()], pa.binary())
            yield pa.RecordBatch.from_arrays([b["doc_id"], raw], ["doc_id", "bytes"])

    prepare(tokens.sparkSession)
    return tokens.select("doc_id", "ids").mapInArrow(run, "doc_id long, bytes binary")


def _digests(data: memoryview, ends: np.ndarray, last: int = 0) -> list[str]:
    """SHA-256 of each text's part, without its ``last`` bytes."""
    edge = ends.tolist()
    return [hashlib.sha256(data[a : max(a, b - last)]).hexdigest() for a, b in zip([0, *edge[:-1]], edge, strict=False)]


def round_trip(docs: DataFrame, path: str, pattern: str) -> DataFrame:
    """Digests of each text's ids and of what they decode to.

    The same engine as ``encode`` and ``decode`` in one pass, so that ids need
    not cross into the JVM and back.  A null or empty text has 0 tokens and the
    digests of no bytes; rows that repeat give rows that repeat; an empty table
    gives none; columns besides doc_id and text are not read.
    """

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        coder = engine(path, pattern)
        for b in gathered(batches):
            ids, ends = coder.encode_batch(b["text"])
            size = np.diff(ends, prepend=0)
            of_ids = _digests(*coder.decimal_batch(ids, ends), last=1)
            of_bytes = _digests(*coder.decode_batch(ids, ends))
            yield pa.RecordBatch.from_arrays(
                [b["doc_id"], pa.array(size, pa.int64()), pa.array(of_ids, pa.string()), pa.array(of_bytes, pa.string())],
                ["doc_id", "n_tokens", "ids_sha256", "decoded_sha256"],
            )

    prepare(docs.sparkSession)
    return id_text(docs).mapInArrow(run, "doc_id long, n_tokens long, ids_sha256 string, decoded_sha256 string")
