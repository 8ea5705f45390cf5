"""Substring dedup in words, with anchors at the places of a difference cover.

A window is ``width`` = 13 consecutive words. Of a document's word places, those whose number modulo 7 is
in the cover {0, 1, 3} are anchor places; every difference modulo 7 is a difference of two cover
members, so wherever two equal windows begin, some offset under 7 puts both on anchor places, and
the 7 words there (which the window holds) hash alike. So:

1. chunks offer the hashes of their anchors; those that occur in several documents come back;
2. every window around such an anchor is a candidate; chunks offer its hash and the smallest doc_id
   that has it, and learn the smallest doc_id anywhere;
3. words covered by a window that also starts in a document with a smaller doc_id are removed.

Windows are judged on the input. Windows are told apart by 62-bit hashes of their words (``_text.SpanHash``). Work and shuffle are linear in the
text; a passage in a third of all documents is one entry per chunk. A single very long text is hashed in pieces, but held whole, with
some dozen bytes a word, by the task of its chunk.

Null text: no words. Null doc_ids count as the largest id (their words go if any other document has them;
among themselves they keep). Rows that share a doc_id don't remove each other's words. Columns
besides doc_id and text are not read.
"""

from __future__ import annotations

import hashlib
from collections.abc import Callable

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from ._exchange import by_bucket, find, known, low, repeated, sizes, with_chunks
from ._text import SpanHash, buffer, inside, slices, window_cover, word_codes, words

WIDTH = 13
# fixed values: a perfect difference set
PERIOD, COVER = 7, (0, 1, 3)
NULL_ID = 2**63 - 1
LEAST = "bucket int, chunk int, hashes binary, ids binary"


def _parts(table: pa.Table):
    """(ids, bytes, word starts, word ends, first word of each document, hashes) of bounded parts of a chunk."""
    for part in slices(table.to_batches(), "text"):
        data, offsets = buffer(part.column("text"))
        start, end, first = words(data, offsets, "space")
        ids = part.column("doc_id").fill_null(NULL_ID).to_numpy(zero_copy_only=False)
        yield ids, data, start, end, first, SpanHash(word_codes(data, start, end))


def _anchors(first: np.ndarray, seq: SpanHash, gram: int) -> tuple[np.ndarray, np.ndarray]:
    """(places, hashes) of the anchors in documents that hold a whole window."""
    fits = inside(first, seq.n, gram)
    if not len(fits):
        return np.zeros(0, np.int64), np.zeros(0, np.uint64)
    count = np.diff(first)
    place = np.arange(seq.n) - np.repeat(first[:-1], count)
    on = np.isin(np.arange(PERIOD), COVER)[place % PERIOD]
    at = np.flatnonzero(fits & on[: len(fits)])
    return at, seq(at, at + gram)


def _reduce_min(hashes: np.ndarray, ids: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """Distinct hashes, ascending, with the smallest id of each."""
    order = np.lexsort((ids, hashes))
    hashes, ids = hashes[order], ids[order]
    edge = np.concatenate(([True], hashes[1:] != hashes[:-1])) if len(hashes) else np.zeros(0, bool)
    return hashes[edge], ids[edge]


def _candidates(ids, first, seq: SpanHash, flagged: np.ndarray, width: int) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """(starts, hashes, ids) of windows around anchors that occur elsewhere."""
    gram = width - PERIOD + 1
    at, h = _anchors(first, seq, gram)
    if not len(at):
        return at, h, np.zeros(0, np.int64)
    at = at[find(flagged, low(h))[0]]
    fits = inside(first, seq.n, width)
    mark = np.zeros(seq.n + 1, bool)
    for k in range(PERIOD):
        mark[at[at >= k] - k] = True
    starts = np.flatnonzero(mark[: len(fits)] & fits)
    return starts, seq(starts, starts + width), ids[np.searchsorted(first, starts, "right") - 1]


def covered(docs: DataFrame, finish: Callable, schema: str, width: int = WIDTH) -> DataFrame:
    """Runs ``finish(ids, data, start, end, first, removed)`` on every part of every chunk; it gives a record batch.

    removed has one flag for each word of the part.
    """
    if width < 2 * PERIOD - 1:
        raise ValueError(f"windows of {width} words are too short for a cover modulo {PERIOD}")
    gram = width - PERIOD + 1
    chunks, buckets = sizes(docs)
    chunked = with_chunks(docs, chunks)

    def prints(table: pa.Table):
        hashes, owners = [np.zeros(0, np.uint64)], [np.zeros(0, np.int64)]
        for ids, _, _, _, first, seq in _parts(table):
            at, h = _anchors(first, seq, gram)
            hashes.append(h)
            owners.append(ids[np.searchsorted(first, at, "right") - 1])
        order = np.lexsort((h := np.concatenate(hashes), o := np.concatenate(owners))[::-1])
        h, o = h[order], o[order]
        # one for each document that has it
        new = np.concatenate(([True], (h[1:] != h[:-1]) | (o[1:] != o[:-1]))) if len(h) else np.zeros(0, bool)
        return np.unique(h[new], return_counts=True)

    flagged = repeated(chunked, prints, buckets)

    def offer(table: pa.Table, answers: pa.Table) -> pa.Table:
        if not table.num_rows:
            return pa.table({"bucket": pa.array([], pa.int32()), "chunk": pa.array([], pa.int32()), "hashes": pa.array([], pa.binary()), "ids": pa.array([], pa.binary())})
        marks, _ = known(answers)
        found = [(h, o) for ids, _, _, _, first, seq in _parts(table) for _, h, o in [_candidates(ids, first, seq, marks, width)]]
        h, o = _reduce_min(np.concatenate([x for x, _ in found]), np.concatenate([x for _, x in found]))
        rows = [(b, h[at].tobytes(), o[at].tobytes()) for b, at in by_bucket(h, buckets)]
        chunk = table.column("chunk")[0].as_py()
        return pa.table({"bucket": pa.array([r[0] for r in rows], pa.int32()), "chunk": pa.array([chunk] * len(rows), pa.int32()), "hashes": pa.array([r[1] for r in rows], pa.binary()), "ids": pa.array([r[2] for r in rows], pa.binary())})

    def judge(table: pa.Table) -> pa.Table:
        parts = [np.frombuffer(x, np.uint64) for x in table.column("hashes").to_pylist()]
        own = [np.frombuffer(x, np.int64) for x in table.column("ids").to_pylist()]
        h, o = _reduce_min(np.concatenate(parts), np.concatenate(own))
        rows = []
        for chunk, part, ids in zip(table.column("chunk").to_pylist(), parts, own, strict=True):
            least = o[np.searchsorted(h, part)]
            keep = least < ids  # else the chunk knows the smallest id already
            if keep.any():
                rows.append((chunk, part[keep].tobytes(), least[keep].tobytes()))
        return pa.table({"chunk": pa.array([r[0] for r in rows], pa.int32()), "hashes": pa.array([r[1] for r in rows], pa.binary()), "ids": pa.array([r[2] for r in rows], pa.binary())})

    empty = F.lit(b"").cast("binary")
    offers = chunked.groupBy("chunk").cogroup(flagged.groupBy("chunk")).applyInArrow(offer, LEAST)
    least = offers.groupBy("bucket").applyInArrow(judge, "chunk int, hashes binary, ids binary")
    # what a chunk needs in the end: the marked anchors and the smallest ids
    both = flagged.select("chunk", F.lit(0).alias("kind"), "hashes", "counts", empty.alias("ids")).unionByName(least.select("chunk", F.lit(1).alias("kind"), "hashes", empty.alias("counts"), "ids"))

    def end(table: pa.Table, answers: pa.Table) -> pa.Table:
        kind = answers.column("kind").to_numpy()
        marks, _ = known(answers.filter(pa.array(kind == 0)))
        mine = answers.filter(pa.array(kind == 1))
        far = (np.concatenate([np.frombuffer(x, np.uint64) for x in mine.column("hashes").to_pylist()] or [np.zeros(0, np.uint64)]), np.concatenate([np.frombuffer(x, np.int64) for x in mine.column("ids").to_pylist()] or [np.zeros(0, np.int64)]))
        found = [(h, o) for ids, _, _, _, first, seq in _parts(table) for _, h, o in [_candidates(ids, first, seq, marks, width)]]
        h, o = _reduce_min(np.concatenate([far[0], *(x for x, _ in found)]), np.concatenate([far[1], *(x for _, x in found)]))
        out = []
        for ids, data, start, end_, first, seq in _parts(table):
            starts, own, owner = _candidates(ids, first, seq, marks, width)
            gone = starts[o[np.searchsorted(h, own)] < owner] if len(starts) else starts
            out.append(finish(ids, data, start, end_, first, window_cover(gone, width, seq.n)))
        return pa.Table.from_batches([x for x in out if x.num_rows], schema=out[0].schema if out else None) if out else empty_table

    fields = [f.split() for f in schema.split(",")]
    kinds = {"long": pa.int64(), "string": pa.string(), "binary": pa.binary()}
    empty_table = pa.table({n: pa.array([], kinds[k]) for n, k in fields})
    return chunked.groupBy("chunk").cogroup(both.groupBy("chunk")).applyInArrow(end, schema)


def digests(docs: DataFrame, width: int = WIDTH) -> DataFrame:
    """doc_id, n_words, n_removed, kept_sha256 (of the kept words joined by one blank)."""

    def finish(ids, data, start, end, first, removed):
        raw, sha = data.tobytes(), []
        for a, b in zip(first[:-1].tolist(), first[1:].tolist(), strict=True):
            kept = np.flatnonzero(~removed[a:b]) + a
            sha.append(hashlib.sha256(b" ".join([raw[x:y] for x, y in zip(start[kept].tolist(), end[kept].tolist(), strict=True)])).hexdigest())
        gone = np.concatenate(([0], np.cumsum(removed)))
        owner = pa.array(ids, pa.int64(), mask=ids == NULL_ID)
        return pa.RecordBatch.from_arrays([owner, pa.array(np.diff(first).astype(np.int64)), pa.array((gone[first[1:]] - gone[first[:-1]]).astype(np.int64)), pa.array(sha)], names=["doc_id", "n_words", "n_removed", "kept_sha256"])

    return covered(docs, finish, "doc_id long,n_words long,n_removed long,kept_sha256 string", width)


def kept_text(docs: DataFrame, width: int = WIDTH) -> DataFrame:
    """doc_id, text: what is left of each document, kept words joined by one blank."""

    def finish(ids, data, start, end, first, removed):
        raw, out = data.tobytes(), []
        for a, b in zip(first[:-1].tolist(), first[1:].tolist(), strict=True):
            kept = np.flatnonzero(~removed[a:b]) + a
            out.append(b" ".join([raw[x:y] for x, y in zip(start[kept].tolist(), end[kept].tolist(), strict=True)]).decode())
        return pa.RecordBatch.from_arrays([pa.array(ids, pa.int64(), mask=ids == NULL_ID), pa.array(out, pa.string())], names=["doc_id", "text"])

    return covered(docs, finish, "doc_id long,text string", width)
