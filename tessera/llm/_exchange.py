"""Finds which hashes occur in several places of a corpus, without a row per hash.

Documents are dealt into chunks by a hash of identifier and text; a chunk is a few MB. A chunk offers its
distinct hashes, packed by bucket (a bucket is a range of hash values), so a hash is sent once for
each chunk that has it, however often it occurs there. A bucket counts, and answers each chunk with
those of its hashes that occur more than once. A hot hash costs one entry per chunk.

A chunk holds ``CHUNK_BYTES`` of text on average at most, whatever the session's number of partitions is; there are
``CHUNKS_PER_PARTITION`` chunks for each shuffle partition at least, for even work. There are half as many buckets as chunks (65536 at most). A chunk
and a bucket exchange no more messages than they share distinct hashes, so messages are linear in the text too.
"""

from __future__ import annotations

from collections.abc import Callable, Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

CHUNKS_PER_PARTITION = 2
CHUNK_BYTES = 32_000_000
SHORT = 6  # bytes of a hash that are sent, besides what the bucket says
OFFERS = "bucket int, chunk int, hashes binary, counts binary"
ANSWERS = "chunk int, hashes binary, counts binary"


def sizes(docs: DataFrame) -> tuple[int, int]:
    """(chunks, buckets), from the bytes of all texts."""
    total = docs.agg(F.sum(F.octet_length(F.col("text").cast("string")))).first()[0] or 0
    partitions = int(docs.sparkSession.conf.get("spark.sql.shuffle.partitions"))
    chunks = max(CHUNKS_PER_PARTITION * partitions, -(-total // CHUNK_BYTES))
    return chunks, min(chunks // CHUNKS_PER_PARTITION, 65536)


def with_chunks(docs: DataFrame, chunks: int, *more: str) -> DataFrame:
    """chunk, doc_id, text and further columns of the documents."""
    doc_id, text = F.col("doc_id").cast("long").alias("doc_id"), F.col("text").cast("string").alias("text")
    return docs.select(F.pmod(F.xxhash64("doc_id", "text"), F.lit(chunks)).cast("int").alias("chunk"), doc_id, text, *more)


def bucket_of(hashes: np.ndarray, buckets: int) -> np.ndarray:
    return ((hashes >> np.uint64(48)) * np.uint64(buckets) >> np.uint64(16)).astype(np.int64)


def short(hashes: np.ndarray) -> bytes:
    """The lower bytes of hashes."""
    return np.ascontiguousarray(hashes.astype("<u8")).view(np.uint8).reshape(-1, 8)[:, :SHORT].tobytes()


def wide(data: bytes) -> np.ndarray:
    out = np.zeros((len(data) // SHORT, 8), np.uint8)
    out[:, :SHORT] = np.frombuffer(data, np.uint8).reshape(-1, SHORT)
    return out.view("<u8").ravel()


def low(hashes: np.ndarray) -> np.ndarray:
    """Hashes as answers have them: the lower bytes alone, still told apart by 48 bits."""
    return hashes & np.uint64((1 << (8 * SHORT)) - 1)


def by_bucket(hashes: np.ndarray, buckets: int) -> Iterator[tuple[int, np.ndarray]]:
    """(bucket, places of its hashes), for hashes in ascending order."""
    bucket = bucket_of(hashes, buckets)
    edge = np.flatnonzero(np.diff(bucket)) + 1
    for s, e in zip(np.concatenate(([0], edge)), np.concatenate((edge, [len(bucket)])), strict=True):
        if e > s:
            yield int(bucket[s]), np.arange(s, e)


def repeated(chunked: DataFrame, prints: Callable[[pa.Table], tuple[np.ndarray, np.ndarray]], buckets: int) -> DataFrame:
    """For each chunk the hashes that occur more than once in the corpus, with how often (65535 at most).

    ``prints`` gives the distinct hashes of a chunk's table, ascending, and how often each occurs there.
    """
    def offer(table: pa.Table) -> pa.Table:
        hashes, counts = prints(table)
        rows = [(b, short(hashes[at]), np.minimum(counts[at], 65535).astype("<u2").tobytes()) for b, at in by_bucket(hashes, buckets)]
        chunk = table.column("chunk")[0].as_py()
        return pa.table({"bucket": pa.array([r[0] for r in rows], pa.int32()), "chunk": pa.array([chunk] * len(rows), pa.int32()), "hashes": pa.array([r[1] for r in rows], pa.binary()), "counts": pa.array([r[2] for r in rows], pa.binary())})

    def judge(table: pa.Table) -> pa.Table:
        parts = [wide(x) for x in table.column("hashes").to_pylist()]
        counts = np.concatenate([np.frombuffer(x, "<u2") for x in table.column("counts").to_pylist()]).astype(np.int64)
        hashes = np.concatenate(parts)
        order = np.argsort(hashes, kind="stable")
        ordered = hashes[order]
        edge = np.flatnonzero(np.concatenate(([True], ordered[1:] != ordered[:-1])))
        total = np.add.reduceat(counts[order], edge) if len(edge) else np.zeros(0, np.int64)
        per = np.empty(len(hashes), np.int64)
        per[order] = np.repeat(total, np.diff(np.concatenate((edge, [len(hashes)]))))
        rows, at = [], 0
        for chunk, part in zip(table.column("chunk").to_pylist(), parts, strict=True):
            own = per[at : at + len(part)]
            keep = own > 1
            if keep.any():
                rows.append((chunk, short(part[keep]), np.minimum(own[keep], 65535).astype("<u2").tobytes()))
            at += len(part)
        return pa.table({"chunk": pa.array([r[0] for r in rows], pa.int32()), "hashes": pa.array([r[1] for r in rows], pa.binary()), "counts": pa.array([r[2] for r in rows], pa.binary())})

    offers = chunked.groupBy("chunk").applyInArrow(offer, OFFERS)
    return offers.groupBy("bucket").applyInArrow(judge, ANSWERS)


def known(answers: pa.Table) -> tuple[np.ndarray, np.ndarray]:
    """Ascending hashes (lower bytes) of a chunk's answers, with their counts."""
    if not answers.num_rows:
        return np.zeros(0, np.uint64), np.zeros(0, np.int64)
    hashes = np.concatenate([wide(x) for x in answers.column("hashes").to_pylist()])
    counts = np.concatenate([np.frombuffer(x, "<u2") for x in answers.column("counts").to_pylist()]).astype(np.int64)
    order = np.argsort(hashes)
    return hashes[order], counts[order]


def find(table: np.ndarray, values: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """(whether each value is in the ascending table, where)"""
    if not len(table):
        return np.zeros(len(values), bool), np.zeros(len(values), np.int64)
    at = np.minimum(np.searchsorted(table, values), len(table) - 1)
    return table[at] == values, at
