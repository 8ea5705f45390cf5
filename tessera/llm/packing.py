"""Packing of tokenized documents into fixed-length sequences by dynamic programming, in order.

Documents follow each other by doc_id. A window (one sequence) may end after a document, after a
sentence, or, in a sentence longer than a window, anywhere. Windows cost their padding plus a
penalty for a cut inside a document; the cheapest cutting is found by

    cost[i] = padding-free part + min over j with 0 < place[i] - place[j] <= length of (cost[j] + place[j])

where the minimum over a moving range comes from a monotone queue, so work is linear in the number
of places. Sequences are padded to ``length`` unless they are a power of two long; windows of
such sizes are tried besides.

Each task packs one range of doc_id, with one last sequence that may be short. Ranges hold many
sequences, so the padding this adds is a small share of them; tasks hold one batch of documents
and the open tail only: a batch is cut, and what its last window left goes to the next batch.

Null text counts as empty (the end id alone). Null and repeated doc_ids keep their rows, ordered by
Spark's xxhash64 of the text, then by the text. Extra columns are not read. No input rows: no output rows.
"""

from __future__ import annotations

import zlib
from collections import deque
from functools import lru_cache

import numpy as np
import pyarrow as pa
from pyspark import TaskContext
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from ._text import slices
from ._tokens import encoder

LENGTH = 4096
SENTENCE_PENALTY = 16.0
HARD_PENALTY = 256.0
SCHEMA = "doc_id long, start long, length long, ids_crc32 long, doc_tokens long, sequence_id long, offset long"


@lru_cache(maxsize=4)
def _sentence_ends(path: str) -> np.ndarray:
    """True for ids of tokens that end a sentence: only marks of ``.!?`` once the word end is gone."""
    vocab = encoder(path).tokenizer.get_vocab(with_added_tokens=True)
    out = np.zeros(max(vocab.values()) + 1, bool)
    out[[i for t, i in vocab.items() if t.removesuffix("</w>") and not t.removesuffix("</w>").strip(".!?")]] = True
    return out


def best_cuts(place: np.ndarray, penalty: np.ndarray, length: int) -> list[int]:
    """Places to cut at (the last one included) from 0 on, at the least padding and penalties.

    ``place`` ascends from above 0 in steps of ``length`` at most; ``penalty`` is what a cut there costs.
    """
    at = [0, *place.tolist()]
    cost, come = [0.0] * len(at), [0] * len(at)
    where = {p: i for i, p in enumerate(at)}
    powers = [1 << k for k in range(length.bit_length()) if 1 << k < length]
    queue: deque[int] = deque([0])
    for i in range(1, len(at)):
        p = at[i]
        while p - at[queue[0]] > length:
            queue.popleft()
        j = queue[0]
        best, origin = cost[j] + at[j] + length - p, j
        for size in powers:
            j = where.get(p - size)
            if j is not None and cost[j] < best:
                best, origin = cost[j], j
        cost[i], come[i] = best + penalty[i - 1], origin
        mine = cost[i] + p
        while queue and cost[queue[-1]] + at[queue[-1]] >= mine:
            queue.pop()
        queue.append(i)
    out, i = [], len(at) - 1
    while i:
        out.append(at[i])
        i = come[i]
    return out[::-1]


def _places(ids: np.ndarray, doc_end: np.ndarray, ends: np.ndarray, length: int) -> tuple[np.ndarray, np.ndarray]:
    """Where windows may end, and what each cut costs."""
    mark = ends[ids]
    mark[:-1] &= ~mark[1:]  # after the last of several marks
    mark[doc_end - 1] = True
    place = np.flatnonzero(mark) + 1
    gap = np.diff(np.concatenate(([0], place)))
    long = np.flatnonzero(gap > length // 4)
    hard = [np.arange(place[i] - gap[i] + length // 8, place[i], length // 8) for i in long]
    all_ = np.unique(np.concatenate([place, *hard]))
    penalty = np.full(len(all_), HARD_PENALTY)
    penalty[np.searchsorted(all_, place)] = SENTENCE_PENALTY
    penalty[np.searchsorted(all_, doc_end)] = 0.0
    return all_, penalty


def pack(docs: DataFrame, tokenizer_path: str, end_id: int, length: int = LENGTH, shards: int | None = None) -> DataFrame:
    """One row per piece: doc_id, start, length, ids_crc32, doc_tokens, sequence_id, offset.

    sequence_id is the range's number times 2**32 plus the window's number in it.
    """
    shards = shards or int(docs.sparkSession.conf.get("spark.sql.shuffle.partitions"))
    ordered = docs.select("doc_id", "text").repartitionByRange(shards, F.col("doc_id"), F.xxhash64("text")).sortWithinPartitions(F.col("doc_id"), F.xxhash64("text"), F.col("text"))

    def run(batches):
        tokens, ends = encoder(tokenizer_path), _sentence_ends(tokenizer_path)
        end = np.array([end_id], tokens.kind)
        sequence = TaskContext.get().partitionId() << 32
        # what is open: ids not yet in a window, and their documents (id, ids before here, all ids, ids here)
        open_ids, open_docs = np.zeros(0, tokens.kind), []

        def cut(last: bool):
            nonlocal open_ids, open_docs, sequence
            if not len(open_ids):
                return None
            doc_end = np.cumsum([d[3] for d in open_docs])
            cuts = best_cuts(*_places(open_ids, doc_end, ends, length), length)
            if not last:  # the last windows wait for what follows
                cuts = cuts[:-2]
            rows, d, used, begin = [], 0, 0, 0
            for stop in cuts:
                offset = 0
                while begin < stop:
                    doc_id, before, total, here = open_docs[d]
                    n = min(stop - begin, here - used)
                    rows.append((doc_id, before + used, n, zlib.crc32(open_ids[begin : begin + n].astype("<u4").tobytes()), total, sequence, offset))
                    begin, used, offset = begin + n, used + n, offset + n
                    if used == here:
                        d, used = d + 1, 0
                sequence += 1
            open_ids, open_docs = open_ids[begin:], open_docs[d:]
            if used:
                doc_id, before, total, here = open_docs[0]
                open_docs[0] = (doc_id, before + used, total, here - used)
            return pa.RecordBatch.from_arrays([pa.array(c, pa.int64()) for c in (zip(*rows, strict=True) if rows else [[]] * 7)], names=["doc_id", "start", "length", "ids_crc32", "doc_tokens", "sequence_id", "offset"])

        for part in slices(batches, "text"):
            ids, bounds = tokens.batch(part.column("text"))
            pieces = [open_ids]
            for i, doc_id in enumerate(part.column("doc_id").to_pylist()):
                n = int(bounds[i + 1] - bounds[i]) + 1
                pieces += [ids[bounds[i] : bounds[i + 1]], end]
                open_docs.append((doc_id, 0, n, n))
            open_ids = np.concatenate(pieces)
            if (out := cut(False)) is not None:
                yield out
        if (out := cut(True)) is not None:
            yield out

    return ordered.mapInArrow(run, SCHEMA)
