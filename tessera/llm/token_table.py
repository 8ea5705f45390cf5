"""Token ids of documents in sorted-string-table shards.

A shard is one file: blocks of entries, a Bloom filter, a sparse index and a footer.

* An entry is a key and the token ids of one document. Keys are byte strings that sort as the
  identifiers do (null first); in a block a key is stored as the length it shares with the key
  before it and the rest. A block ends after BLOCK bytes and is compressed by itself.
* The index has the first key and the place of each block, the Bloom filter has all keys, and the
  footer (fixed size, at the end) has the places of both.

``write_shards`` deals documents out by ranges of the identifier, so shards follow one another in
ascending order and one shard is written by one task in one pass with one block in memory. A
lookup reads the footer, asks the Bloom filter, finds the block by binary search and reads that
block alone.

Null text counts as empty (the end id alone). Null identifiers sort first; repeated identifiers
keep all their rows, in the order of Spark's xxhash64 of their texts (then of the texts), over shards too. Other
columns of the input are not read. No input rows: shards without entries or none.
"""

from __future__ import annotations

import bisect
import struct
import zlib
from array import array
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark import TaskContext
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from ._shared import file_system, publish
from ._text import slices
from ._tokens import encoder

BLOCK = 256 * 1024
SHARD_BYTES = 256_000_000  # of text in a shard, on average at most
MAGIC = b"TSST0001"
FOOTER = struct.Struct("<QQQQQQ8s")  # index place, size; filter place, size; entries, tokens; magic


def key_of(doc_id: int | None) -> bytes:
    return b"\0" if doc_id is None else b"\1" + struct.pack(">Q", doc_id + 2**63)


def id_of(key: bytes) -> int | None:
    return None if key == b"\0" else struct.unpack(">Q", key[1:])[0] - 2**63


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


def _hashes(key: bytes) -> tuple[int, int]:
    return zlib.crc32(key), zlib.crc32(key, 0x5BD1E995) | 1


def _probes(key: bytes, bits: int) -> list[int]:
    a, b = _hashes(key)
    return [(a + i * b) % bits for i in range(7)]


class ShardWriter:
    """Entries in ascending key order to an output stream; of a key, eight bytes are held until the filter is written."""

    def __init__(self, out):
        self.out, self.place, self.index, self.hashes, self.entries, self.tokens = out, 0, [], array("Q"), 0, 0
        self.lowest = self.highest = None
        self._new_block()

    def _new_block(self) -> None:
        self.block, self.last, self.first = bytearray(), b"", None

    def add(self, key: bytes, ids: np.ndarray) -> None:
        shared = 0
        if self.first is None:
            self.first = key
        else:
            while shared < min(len(key), len(self.last)) and key[shared] == self.last[shared]:
                shared += 1
        value = ids.tobytes()
        self.block += _varint(shared) + _varint(len(key) - shared) + key[shared:] + _varint(ids.itemsize) + _varint(len(value)) + value
        self.last = key
        self.lowest = key if self.lowest is None else self.lowest
        if key != self.highest:
            a, b = _hashes(key)
            self.hashes.append(a << 32 | b)
        self.highest = key
        self.entries += 1
        self.tokens += len(ids)
        if len(self.block) >= BLOCK:
            self._end_block()

    def _end_block(self) -> None:
        if self.first is not None:
            packed = pa.compress(bytes(self.block), codec="zstd", asbytes=True)
            self.out.write(packed)
            self.index.append((self.first, self.place, len(packed), len(self.block)))
            self.place += len(packed)
        self._new_block()

    def close(self) -> None:
        self._end_block()
        size = max(64, 10 * self.entries)
        bloom = np.zeros(size, bool)
        hashes = np.frombuffer(self.hashes, np.uint64) if self.hashes else np.zeros(0, np.uint64)
        for i in range(7):
            bloom[(((hashes >> np.uint64(32)) + np.uint64(i) * (hashes & np.uint64(2**32 - 1))) % np.uint64(size)).astype(np.int64)] = True
        bits = struct.pack("<Q", size) + np.packbits(bloom).tobytes()
        index = b"".join(_varint(len(k)) + k + _varint(at) + _varint(n) + _varint(raw) for k, at, n, raw in self.index)
        self.out.write(bits + index + FOOTER.pack(self.place + len(bits), len(index), self.place, len(bits), self.entries, self.tokens, MAGIC))


class ShardReader:
    """A shard in any file system that pyarrow opens."""

    def __init__(self, path: str):
        files, where = file_system(path)
        self.file = files.open_input_file(where)
        end = self.file.size()
        self.index_at, n, self.filter_at, self.filter_size, self.entries, self.tokens, magic = FOOTER.unpack(self.file.read_at(FOOTER.size, end - FOOTER.size))
        if magic != MAGIC:
            raise ValueError(f"{path} is no token table shard")
        data, at, self.index = self.file.read_at(n, self.index_at), 0, []
        while at < n:
            k, at = _read_varint(data, at)
            key, at = data[at : at + k], at + k
            place, at = _read_varint(data, at)
            size, at = _read_varint(data, at)
            raw, at = _read_varint(data, at)
            self.index.append((key, place, size, raw))

    def _block(self, i: int) -> Iterator[tuple[bytes, np.ndarray]]:
        _, place, size, raw = self.index[i]
        data, at, key = pa.decompress(self.file.read_at(size, place), raw, codec="zstd", asbytes=True), 0, b""
        while at < raw:
            shared, at = _read_varint(data, at)
            rest, at = _read_varint(data, at)
            key, at = key[:shared] + data[at : at + rest], at + rest
            width, at = _read_varint(data, at)
            n, at = _read_varint(data, at)
            yield key, np.frombuffer(data, f"<u{width}", n // width, at)
            at += n

    def __iter__(self) -> Iterator[tuple[bytes, np.ndarray]]:
        for i in range(len(self.index)):
            yield from self._block(i)

    def may_have(self, key: bytes) -> bool:
        bits = self.file.read_at(self.filter_size, self.filter_at)
        size = struct.unpack_from("<Q", bits)[0]
        return all(bits[8 + p // 8] >> (7 - p % 8) & 1 for p in _probes(key, size))

    def get(self, doc_id: int | None) -> list[np.ndarray]:
        """Token ids of each document with that identifier."""
        key = key_of(doc_id)
        if not self.index or not self.may_have(key):
            return []
        firsts, found = [x[0] for x in self.index], []
        for i in range(max(0, bisect.bisect_left(firsts, key) - 1), bisect.bisect_right(firsts, key)):
            found += [ids.copy() for k, ids in self._block(i) if k == key]
        return found


def shards_for(docs: DataFrame) -> int:
    """As many shards as the session has shuffle partitions, or more if the bytes of all texts ask for it."""
    total = docs.agg(F.sum(F.octet_length(F.col("text").cast("string")))).first()[0] or 0
    return max(int(docs.sparkSession.conf.get("spark.sql.shuffle.partitions")), -(-total // SHARD_BYTES))


def write_shards(docs: DataFrame, path: str, tokenizer_path: str, end_id: int, shards: int | None = None) -> list[dict]:
    """Writes the documents' ids under ``path``; returns one entry for each shard, in order.

    An entry has path, docs, tokens, start (tokens in all shards before it), first and last (keys). Only these few
    values a shard come to the driver. A shard holds ``SHARD_BYTES`` of text on average at most (unless ``shards`` says how many), however few
    shuffle partitions are set.
    """
    shards = shards or shards_for(docs)
    ordered = docs.select("doc_id", "text").repartitionByRange(shards, F.col("doc_id"), F.xxhash64("text")).sortWithinPartitions(F.col("doc_id"), F.xxhash64("text"), F.col("text"))

    def write(batches):
        shard = TaskContext.get().partitionId()
        done: list = [0, 0, None, None]

        def fill(out):
            tokens, writer = encoder(tokenizer_path), ShardWriter(out)
            end = np.array([end_id], tokens.kind)
            for part in slices(batches, "text"):
                ids, bounds = tokens.batch(part.column("text"))
                for i, doc_id in enumerate(part.column("doc_id").to_pylist()):
                    writer.add(key_of(doc_id), np.concatenate((ids[bounds[i] : bounds[i + 1]], end)))
            writer.close()
            done[:] = writer.entries, writer.tokens, writer.lowest, writer.highest

        target = publish(f"{path}/shard-{shard:06d}.sst", fill)
        values = (shard, target, *done)
        yield pa.RecordBatch.from_arrays([pa.array([x], kind) for x, kind in zip(values, (pa.int64(), pa.string(), pa.int64(), pa.int64(), pa.binary(), pa.binary()), strict=True)], names=["shard", "path", "docs", "tokens", "first", "last"])

    found = ordered.mapInArrow(write, "shard long, path string, docs long, tokens long, first binary, last binary").collect()
    out, start = [], 0
    for r in sorted(found, key=lambda r: r.shard):
        out.append({"path": r.path, "docs": r.docs, "tokens": r.tokens, "start": start, "first": r.first and bytes(r.first), "last": r.last and bytes(r.last)})
        start += r.tokens
    return out


def read_shards(spark: SparkSession, shards: list[dict]) -> DataFrame:
    """One row per document of the files: doc_id, start, n_tokens, ids_crc32."""
    listed = spark.createDataFrame([(s["path"], s["start"]) for s in shards], "path string, start long").repartition(max(1, len(shards)))
    schema = "doc_id long, start long, n_tokens long, ids_crc32 long"

    def read(batches):
        for batch in batches:
            for path, start in zip(batch.column("path").to_pylist(), batch.column("start").to_pylist(), strict=True):
                rows = []
                for key, ids in ShardReader(path):
                    rows.append((id_of(key), start, len(ids), zlib.crc32(ids.astype("<u4").tobytes())))
                    start += len(ids)
                if rows:
                    yield pa.RecordBatch.from_arrays([pa.array(c, pa.int64()) for c in zip(*rows, strict=True)], names=["doc_id", "start", "n_tokens", "ids_crc32"])

    return listed.mapInArrow(read, schema)


def lookup(shards: list[dict], doc_id: int | None) -> list[np.ndarray]:
    """Token ids of the documents with an identifier; only shards whose range of keys holds it are opened."""
    key = key_of(doc_id)
    return [ids for s in shards if s["docs"] and s["first"] <= key <= s["last"] for ids in ShardReader(s["path"]).get(doc_id)]
