"""Lines that many documents share, by a sharded minimal perfect hash of all distinct lines.

1. ``index``: tasks offer the 128-bit hashes of their documents' distinct line keys, packed by shard (a range of hash values), with the number
   of documents that have each; a shard builds a minimal perfect hash of its distinct hashes (``_perfect``) and fills two arrays by it:
   32-bit fingerprints and document counts. The shards are a table in the shared folder.
2. ``covered``: documents probe. A chunk of documents sends its distinct hashes, packed, to the shards that own them; a shard looks
   them up in its arrays and answers with those that enough documents have. No line is a row and no line text is sent.

A line's key is the line without blanks (``[\\x20\\x09-\\x0D]``) at both ends, A-Z lower-cased. Keys under ``min_chars`` code points are never
dropped. A hot line is one entry for each task or chunk that has it. Shards hold ``SHARD_LINES`` lines at most on average, chunks
``_exchange.CHUNK_BYTES`` of text, both by a count of the input. Lines are told apart by 128 bits when the index is made;
every line of the indexed documents has a number of its own, so its answer is exact. Documents that were not indexed can be probed as well:
a line that the index doesn't know passes for a known one with a chance of 2**-32.

Null or empty text: one empty line. Every row counts as a document, repeated rows and rows without a doc_id too. An empty table gives an
empty result. Other columns are not read. A single text is held whole by the task of its chunk, with some ten bytes for each of
its bytes. Counts are kept up to 65535, which bounds ``min_docs``.
"""

from __future__ import annotations

import hashlib
from collections.abc import Callable, Iterator
from dataclasses import dataclass

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from . import _perfect
from ._exchange import sizes, with_chunks
from ._shared import stored
from ._text import buffer, lower_ascii, slices

SHARD_LINES = 1_000_000
MOST_COUNTED = 65535
GATHERED = 500_000  # hashes that a task of ``index`` holds before it merges or sends them
OFFERS = "shard int, keys binary, counts binary"
SHARDS = "shard int, n long, words binary, sizes binary, fingerprints binary, counts binary"
BLANK = np.isin(np.arange(256), [9, 10, 11, 12, 13, 32])
_U = np.uint64


@dataclass
class LineIndex:
    """The shards of an index and how many there are."""

    table: DataFrame
    shards: int


@dataclass
class Lines:
    """The lines of a few documents: bounds in ``data``, hashes of keys, and which lines have a key of ``min_chars`` code points."""

    data: np.ndarray
    start: np.ndarray
    end: np.ndarray
    first: np.ndarray  # number of each document's first line, and one more
    counted: np.ndarray  # numbers of lines with a key
    keys: np.ndarray  # of those, two words each


def _lines(column, min_chars: int) -> Lines:
    import xxhash

    data, offsets = buffer(column)
    breaks = np.flatnonzero(data == 10)
    start = np.sort(np.concatenate((offsets[:-1], breaks + 1)))
    end = np.sort(np.concatenate((breaks, offsets[1:])))
    first = np.arange(len(offsets)) + np.searchsorted(breaks, offsets)
    solid = np.flatnonzero(~BLANK[data])
    low, high = np.searchsorted(solid, start), np.searchsorted(solid, end)
    counted = np.flatnonzero(high > low)
    a, b = solid[low[counted]], solid[high[counted] - 1] + 1
    if min_chars > 1:
        points = np.concatenate(([0], np.cumsum((data & 0xC0) != 0x80)))
        enough = points[b] - points[a] >= min_chars
        counted, a, b = counted[enough], a[enough], b[enough]
    raw = memoryview(lower_ascii(data))
    digests = b"".join([xxhash.xxh3_128_digest(raw[x:y]) for x, y in zip(a.tolist(), b.tolist(), strict=True)])
    return Lines(data, start, end, first, counted, np.frombuffer(digests, "<u8").reshape(-1, 2))


def _distinct(keys: np.ndarray, counts: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """Distinct keys in ascending order, with the sums of their counts."""
    order = np.lexsort((keys[:, 1], keys[:, 0]))
    keys, counts = keys[order], counts[order]
    edge = np.flatnonzero(np.concatenate((np.ones(min(1, len(keys)), bool), (keys[1:] != keys[:-1]).any(axis=1))))
    return keys[edge], np.add.reduceat(counts, edge) if len(edge) else counts


def _by_document(lines: Lines) -> np.ndarray:
    """Keys of a part's lines, each once for every document that has it."""
    owner = np.searchsorted(lines.first, lines.counted, "right")
    order = np.lexsort((lines.keys[:, 1], lines.keys[:, 0], owner))
    keys, owner = lines.keys[order], owner[order]
    return keys[np.concatenate((np.ones(min(1, len(keys)), bool), (keys[1:] != keys[:-1]).any(axis=1) | (owner[1:] != owner[:-1])))]


def _by_shard(keys: np.ndarray, shards: int) -> Iterator[tuple[int, slice]]:
    """(shard, places of its keys), for keys in ascending order."""
    shard = ((keys[:, 0] >> _U(32)) * _U(shards) >> _U(32)).astype(np.int64)
    edge = np.flatnonzero(np.diff(shard)) + 1
    for s, e in zip(np.concatenate(([0], edge)), np.concatenate((edge, [len(shard)])), strict=True):
        if e > s:
            yield int(shard[s]), slice(s, e)


def _keys(parts: list[bytes]) -> np.ndarray:
    return np.frombuffer(b"".join(parts), "<u8").reshape(-1, 2)


def index(docs: DataFrame, min_chars: int = 1) -> LineIndex:
    """A minimal perfect hash of all distinct line keys, with fingerprints and document counts, in shards."""
    text = F.col("text").cast("string")
    n = docs.agg(F.sum(F.length(text) - F.length(F.replace(text, F.lit("\n"), F.lit(""))) + 1)).first()[0] or 0
    shards = max(int(docs.sparkSession.conf.get("spark.sql.shuffle.partitions")), -(-n // SHARD_LINES))

    def send(keys: np.ndarray, counts: np.ndarray) -> pa.RecordBatch:
        rows = [(s, keys[at].tobytes(), counts[at].astype("<u4").tobytes()) for s, at in _by_shard(keys, shards)]
        return pa.RecordBatch.from_arrays([pa.array([r[0] for r in rows], pa.int32()), pa.array([r[1] for r in rows], pa.binary()), pa.array([r[2] for r in rows], pa.binary())], names=["shard", "keys", "counts"])

    def offer(batches):
        held, counts = np.zeros((0, 2), _U), np.zeros(0, np.int64)
        for part in slices(batches, "text"):
            own = _by_document(_lines(part.column("text"), min_chars))
            held, counts = np.concatenate((held, own)), np.concatenate((counts, np.ones(len(own), np.int64)))
            if len(held) > GATHERED:
                held, counts = _distinct(held, counts)
                if 2 * len(held) > GATHERED:
                    yield send(held, counts)
                    held, counts = held[:0], counts[:0]
        yield send(*_distinct(held, counts))

    def build(table: pa.Table) -> pa.Table:
        counts = np.concatenate([np.frombuffer(x, "<u4") for x in table.column("counts").to_pylist()]).astype(np.int64)
        keys, counts = _distinct(_keys(table.column("keys").to_pylist()), counts)
        words, sizes_ = _perfect.build(keys)
        at = _perfect.numbers(words, sizes_, keys)
        prints, many = np.zeros(len(keys), "<u4"), np.zeros(len(keys), "<u2")
        prints[at], many[at] = keys[:, 1] & _U(0xFFFFFFFF), np.minimum(counts, MOST_COUNTED)
        row = [table.column("shard")[0].as_py(), len(keys), *(x.tobytes() for x in (words, sizes_, prints, many))]
        return pa.table({"shard": pa.array(row[:1], pa.int32()), "n": pa.array(row[1:2], pa.int64())} | {k: pa.array([v], pa.binary()) for k, v in zip(("words", "sizes", "fingerprints", "counts"), row[2:], strict=True)})

    offers = docs.select(text.alias("text")).mapInArrow(offer, OFFERS)
    return LineIndex(stored(offers.groupBy("shard").applyInArrow(build, SHARDS), "line-index"), shards)


def document_counts(shard: pa.Table, keys: np.ndarray) -> np.ndarray:
    """In how many documents each key occurs, by the arrays of its shard; 0 for keys that the shard doesn't know."""
    row = {c: shard.column(c)[0].as_py() for c in ("words", "sizes", "fingerprints", "counts")}
    at = _perfect.numbers(np.frombuffer(row["words"], _U), np.frombuffer(row["sizes"], np.int64), keys)
    prints, many = np.frombuffer(row["fingerprints"], "<u4"), np.frombuffer(row["counts"], "<u2")
    out, there = np.zeros(len(keys), np.int64), np.flatnonzero(at >= 0)
    there = there[prints[at[there]] == (keys[there, 1] & _U(0xFFFFFFFF))]
    out[there] = many[at[there]]
    return out


def covered(docs: DataFrame, finish: Callable, schema: str, min_docs: int = 10, min_chars: int = 1, known: LineIndex | None = None) -> DataFrame:
    """Runs ``finish(part, lines, dropped)`` on every part of every chunk; it gives a record batch. dropped has one flag for each line.

    ``known`` is an index made before (of these documents or others); else one of ``docs`` is made.
    """
    if not 1 <= min_docs <= MOST_COUNTED:
        raise ValueError(f"min_docs={min_docs}: 1 to {MOST_COUNTED}")
    known = known or index(docs, min_chars)
    chunked = with_chunks(docs, sizes(docs)[0])

    def ask(table: pa.Table) -> pa.Table:
        parts = [_lines(p.column("text"), min_chars).keys for p in slices(table.to_batches(), "text")]
        keys, _ = _distinct(k := np.concatenate([np.zeros((0, 2), _U), *parts]), np.ones(len(k), np.int64))
        rows = [(s, keys[at].tobytes()) for s, at in _by_shard(keys, known_shards)]
        chunk = table.column("chunk")[0].as_py()
        return pa.table({"shard": pa.array([r[0] for r in rows], pa.int32()), "chunk": pa.array([chunk] * len(rows), pa.int32()), "keys": pa.array([r[1] for r in rows], pa.binary())})

    def answer(asks: pa.Table, shard: pa.Table) -> pa.Table:
        rows = []
        if shard.num_rows:
            for batch in asks.to_batches(max_chunksize=64):
                parts = [_keys([x]) for x in batch.column("keys").to_pylist()]
                hit, at = document_counts(shard, np.concatenate(parts)) >= min_docs, 0
                for chunk, part in zip(batch.column("chunk").to_pylist(), parts, strict=True):
                    if (own := hit[at : at + len(part)]).any():
                        rows.append((chunk, part[own].tobytes()))
                    at += len(part)
        return pa.table({"chunk": pa.array([r[0] for r in rows], pa.int32()), "keys": pa.array([r[1] for r in rows], pa.binary())})

    def end(table: pa.Table, answers: pa.Table) -> pa.Table:
        common, _ = _distinct(k := _keys(answers.column("keys").to_pylist()), np.ones(len(k), np.int64))
        out = []
        for part in slices(table.to_batches(), "text"):
            lines = _lines(part.column("text"), min_chars)
            dropped = np.zeros(len(lines.start), bool)
            if len(common):
                at = np.minimum(np.searchsorted(common[:, 0], lines.keys[:, 0]), len(common) - 1)
                # keys with an equal first word are next to each other
                while len(step := np.flatnonzero((common[at, 0] == lines.keys[:, 0]) & (common[at, 1] < lines.keys[:, 1]) & (at + 1 < len(common)))):
                    at[step] += 1
                dropped[lines.counted] = (common[at] == lines.keys).all(axis=1)
            out.append(finish(part, lines, dropped))
        return pa.Table.from_batches(out, schema=out[0].schema if out else None) if out else empty

    known_shards = known.shards
    fields = [f.split() for f in schema.split(",")]
    kinds = {"long": pa.int64(), "string": pa.string()}
    empty = pa.table({n: pa.array([], kinds[k]) for n, k in fields})
    asks = chunked.groupBy("chunk").applyInArrow(ask, "shard int, chunk int, keys binary")
    answers = asks.groupBy("shard").cogroup(known.table.groupBy("shard")).applyInArrow(answer, "chunk int, keys binary")
    return chunked.groupBy("chunk").cogroup(answers.groupBy("chunk")).applyInArrow(end, schema)


def _kept(lines: Lines, dropped: np.ndarray) -> Iterator[bytes]:
    """What is left of each document."""
    raw, start, end = lines.data.tobytes(), lines.start, lines.end
    gone = np.concatenate(([0], np.cumsum(dropped)))
    for a, b in zip(lines.first[:-1].tolist(), lines.first[1:].tolist(), strict=True):
        if gone[a] == gone[b]:
            yield raw[start[a] : end[b - 1]]
        else:
            kept = np.flatnonzero(~dropped[a:b]) + a
            yield b"\n".join([raw[x:y] for x, y in zip(start[kept].tolist(), end[kept].tolist(), strict=True)])


def digests(docs: DataFrame, min_docs: int = 10, min_chars: int = 1, known: LineIndex | None = None) -> DataFrame:
    """doc_id, n_lines, n_dropped, kept_sha256 (of the kept lines joined by a line break)."""

    def finish(part, lines, dropped):
        gone = np.concatenate(([0], np.cumsum(dropped)))
        sha = [hashlib.sha256(x).hexdigest() for x in _kept(lines, dropped)]
        return pa.RecordBatch.from_arrays([part.column("doc_id"), pa.array(np.diff(lines.first)), pa.array(np.diff(gone[lines.first])), pa.array(sha, pa.string())], names=["doc_id", "n_lines", "n_dropped", "kept_sha256"])

    return covered(docs, finish, "doc_id long,n_lines long,n_dropped long,kept_sha256 string", min_docs, min_chars, known)


def kept_text(docs: DataFrame, min_docs: int = 10, min_chars: int = 1, known: LineIndex | None = None) -> DataFrame:
    """doc_id, text: what is left of each document (null texts are empty)."""

    def finish(part, lines, dropped):
        return pa.RecordBatch.from_arrays([part.column("doc_id"), pa.array([x.decode() for x in _kept(lines, dropped)], pa.string())], names=["doc_id", "text"])

    return covered(docs, finish, "doc_id long,text string", min_docs, min_chars, known)
