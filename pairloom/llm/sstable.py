"""Operator 5: token ids in sorted-string-table shards.

File: data blocks, a Bloom filter, a sparse index, a footer of fixed size.
A block holds entries (shared, rest, size as varints; the rest of the key; the
value); a key repeats only what differs from the key before it, and the first
key of a block is whole.  The index has the last key and the place of every
block, so a lookup reads the footer, index and filter once, then one block.

Keys are document ids as eight big-endian bytes with the sign bit turned, so
that bytes order as numbers do; a null id is the empty key and comes first.
Values are token ids, little-endian, in two bytes where the vocabulary allows.

Executors write with pyarrow's file systems to the shared folder.  A shard's
name is unique to the attempt that wrote it, and only names that a finished
task reported are read: a retried task leaves no trace in the result.
"""

from __future__ import annotations

import struct
import uuid
import zlib
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from pairloom.llm._shared import filesystem, id_text, materialise, new_folder, partitions, prepare
from pairloom.llm.tokens import gathered, library_coder

MAGIC = b"PLSST001"
FOOTER = struct.Struct("<QQQQQI8s")  # filter at, index at, end, documents, tokens, bytes of an id, magic
BLOCK_BYTES = 64 * 1024
#: About one lookup in a hundred for an absent key reads a block in vain.
BITS_PER_KEY = 10
HASHES = 7


def key_of(doc_id: int | None) -> bytes:
    return b"" if doc_id is None else ((doc_id + 2**63) & (2**64 - 1)).to_bytes(8, "big")


def id_of(key: bytes) -> int | None:
    return int.from_bytes(key, "big") - 2**63 if key else None


def _varint(n: int) -> bytes:
    out = bytearray()
    while n > 127:
        out.append(n & 127 | 128)
        n >>= 7
    out.append(n)
    return bytes(out)


def _read_varint(data, at: int) -> tuple[int, int]:
    n = shift = 0
    while True:
        b = data[at]
        at += 1
        n |= (b & 127) << shift
        if b < 128:
            return n, at
        shift += 7


def _probes(keys: list[bytes], bits: int) -> np.ndarray:
    import xxhash

    h = np.array([xxhash.xxh3_64_intdigest(k) for k in keys], np.uint64)
    a, b = h & np.uint64(0xFFFFFFFF), (h >> np.uint64(32)) | np.uint64(1)
    return (a[:, None] + b[:, None] * np.arange(HASHES, dtype=np.uint64)) % np.uint64(bits)


class ShardWriter:
    """Entries in key order to one file."""

    def __init__(self, sink, id_bytes: int, block_bytes: int = BLOCK_BYTES):
        self.sink, self.id_bytes, self.block_bytes = sink, id_bytes, block_bytes
        self.block, self.at, self.last = bytearray(), 0, b""
        self.index: list[tuple[bytes, int, int]] = []
        self.keys: list[bytes] = []
        self.tokens = 0

    def add(self, key: bytes, ids: np.ndarray) -> None:
        shared = 0
        if self.block:
            for x, y in zip(self.last, key, strict=False):
                if x != y:
                    break
                shared += 1
        value = ids.astype(f"<u{self.id_bytes}", copy=False).tobytes()
        self.block += _varint(shared) + _varint(len(key) - shared) + _varint(len(value)) + key[shared:] + value
        self.last = key
        self.keys.append(key)
        self.tokens += len(ids)
        if len(self.block) >= self.block_bytes:
            self._flush()

    def _flush(self) -> None:
        if self.block:
            self.sink.write(bytes(self.block))
            self.index.append((self.last, self.at, len(self.block)))
            self.at += len(self.block)
            self.block = bytearray()

    def close(self) -> None:
        self._flush()
        bits = max(64, len(self.keys) * BITS_PER_KEY)
        table = np.zeros(bits, np.uint8)
        if self.keys:
            table[_probes(self.keys, bits).ravel().astype(np.int64)] = 1
        bloom = struct.pack("<Q", bits) + np.packbits(table).tobytes()
        index = b"".join(_varint(len(k)) + k + struct.pack("<QQ", at, n) for k, at, n in self.index)
        self.sink.write(bloom + index)
        self.sink.write(FOOTER.pack(self.at, self.at + len(bloom), self.at + len(bloom) + len(index), len(self.keys), self.tokens, self.id_bytes, MAGIC))
        self.sink.close()


class ShardReader:
    """One shard by key or from end to end; blocks are read one at a time."""

    def __init__(self, uri: str):
        fs, path = filesystem(uri)
        self.file = fs.open_input_file(path)
        size = self.file.size()
        foot = FOOTER.unpack(self.file.read_at(FOOTER.size, size - FOOTER.size))
        bloom_at, index_at, end, self.documents, self.tokens, self.id_bytes, magic = foot
        if magic != MAGIC:
            raise ValueError(f"not a token shard: {uri}")
        raw = self.file.read_at(index_at - bloom_at, bloom_at)
        (self.bits,) = struct.unpack_from("<Q", raw)
        self.bloom = np.unpackbits(np.frombuffer(raw, np.uint8, offset=8))
        self.index, at, raw = [], 0, self.file.read_at(end - index_at, index_at)
        while at < len(raw):
            n, at = _read_varint(raw, at)
            self.index.append((raw[at : at + n], *struct.unpack_from("<QQ", raw, at + n)))
            at += n + 16

    def _entries(self, at: int, size: int) -> Iterator[tuple[bytes, np.ndarray]]:
        data, i, key = self.file.read_at(size, at), 0, b""
        while i < size:
            shared, i = _read_varint(data, i)
            rest, i = _read_varint(data, i)
            n, i = _read_varint(data, i)
            key = key[:shared] + data[i : i + rest]
            i += rest
            yield key, np.frombuffer(data, f"<u{self.id_bytes}", n // self.id_bytes, i)
            i += n

    def __iter__(self) -> Iterator[tuple[int | None, np.ndarray]]:
        for _, at, size in self.index:
            for key, ids in self._entries(at, size):
                yield id_of(key), ids

    def get(self, doc_id: int | None) -> np.ndarray | None:
        """ids of the first entry of a document; None if it isn't there."""
        key = key_of(doc_id)
        if not self.bloom[_probes([key], self.bits).ravel().astype(np.int64)].all():
            return None
        low, high = 0, len(self.index)
        while low < high:
            mid = (low + high) // 2
            low, high = (mid + 1, high) if self.index[mid][0] < key else (low, mid)
        if low < len(self.index):
            for k, ids in self._entries(*self.index[low][1:]):
                if k == key:
                    return ids
        return None


def write_shards(docs: DataFrame, tokenizer: str, end_id: int, folder: str | None = None) -> DataFrame:
    """Encode every text, append ``end_id`` and write shards in ascending id order.

    Returns the manifest: shard (its number in id order), uri, first_id,
    last_id, n_docs, n_tokens, start (ids in all shards before).  A null text
    is the end id alone; a null id sorts first; rows with one id stay apart,
    ordered by text; an empty table makes no shard.
    """
    spark = prepare(docs.sparkSession)
    folder = folder or new_folder(spark, "shards")

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        from pyspark import TaskContext

        coder, writer, first, doc = library_coder(tokenizer), None, None, None
        width = 2 if max(coder.library.get_vocab_size() - 1, end_id) < 1 << 16 else 4
        fs, path = filesystem(folder)
        name = f"{TaskContext.get().partitionId():08d}-{uuid.uuid4().hex}.sst"
        for b in gathered(batches):
            if not b.num_rows:
                continue
            ids, ends = coder.encode_flat(b["text"])
            ids = np.insert(ids, ends, end_id).astype(f"<u{width}")
            edge = (np.r_[0, ends] + np.arange(len(ends) + 1)).tolist()
            if writer is None:
                fs.create_dir(path, recursive=True)
                writer, first = ShardWriter(fs.open_output_stream(f"{path}/{name}"), width), b["doc_id"][0].as_py()
            for doc, low, high in zip(b["doc_id"].to_pylist(), edge[:-1], edge[1:], strict=True):
                writer.add(key_of(doc), ids[low:high])
        if writer is not None:
            writer.close()
            row = [TaskContext.get().partitionId()], [f"{folder}/{name}"], [first], [doc], [len(writer.keys)], [writer.tokens]
            kinds = pa.int32(), pa.string(), pa.int64(), pa.int64(), pa.int64(), pa.int64()
            yield pa.RecordBatch.from_arrays([pa.array(v, t) for v, t in zip(row, kinds, strict=True)], ["shard", "uri", "first_id", "last_id", "n_docs", "n_tokens"])

    placed = id_text(docs).repartitionByRange(partitions(spark), "doc_id").sortWithinPartitions("doc_id", "text")
    manifest = materialise(placed.mapInArrow(run, "shard int, uri string, first_id long, last_id long, n_docs long, n_tokens long"), "manifest")
    # one row for each shard: the only ordering over all of them
    before = Window.orderBy("shard").rowsBetween(Window.unboundedPreceding, -1)
    return manifest.withColumn("start", F.coalesce(F.sum("n_tokens").over(before), F.lit(0)))


def read_shards(manifest: DataFrame, with_ids: bool = False) -> DataFrame:
    """doc_id, start, n_tokens, ids_crc32[, ids] of every entry of the shards of a manifest."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in batches:
            for uri, start in zip(b["uri"].to_pylist(), b["start"].to_pylist(), strict=True):
                rows: list[tuple] = []
                held = 0
                for doc, ids in ShardReader(uri):
                    rows.append((doc, start, len(ids), zlib.crc32(ids.astype("<u4").tobytes()), ids))
                    start += len(ids)
                    held += len(ids)
                    if len(rows) >= 10_000 or held > 4_000_000:
                        yield batch(rows)
                        rows, held = [], 0
                if rows:
                    yield batch(rows)

    def batch(rows: list[tuple]) -> pa.RecordBatch:
        cols = list(zip(*rows, strict=True))
        arrays = [pa.array(c, pa.int64()) for c in cols[:4]]
        if with_ids:
            arrays.append(pa.array([x.astype(np.int32) for x in cols[4]], pa.list_(pa.int32())))
        return pa.RecordBatch.from_arrays(arrays, ["doc_id", "start", "n_tokens", "ids_crc32", "ids"][: len(arrays)])

    spark = prepare(manifest.sparkSession)
    shards = manifest.select("shard", "uri", "start").repartitionByRange(partitions(spark), "shard")
    return shards.mapInArrow(run, "doc_id long, start long, n_tokens long, ids_crc32 long" + ", ids array<int>" * with_ids)
