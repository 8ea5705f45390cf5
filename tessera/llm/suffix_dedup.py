"""Substring dedup in bytes with longest-previous-factor arrays of suffix arrays.

A window is ``length`` = 400 consecutive bytes of one document. Which windows occur more than once,
and which occur earlier (in an earlier document, or earlier in the same one), is found in two steps.

1. Anchors. A window's anchor is the place of the smallest hash of ``GRAM`` bytes in it (the first, on
   ties); equal windows have equal anchors at equal offsets, and neighbouring windows mostly share one.
   Chunks offer their anchors' hashes; a window whose anchor occurs once in the corpus is unique.
2. Stretches. The windows that share an anchor place lie in one stretch of text. Stretches of anchors that occur
   again are gathered by the anchor's hash. Over the texts of whole anchor groups, in the order of
   (doc_id, place), a suffix array to the depth of ``length`` is built by prefix doubling, with the lengths that
   neighbours share. From the previous and the next smaller place in suffix order and the least shared length on the way
   there comes the longest previous factor of every place: it is a later copy if that factor is ``length`` long,
   and what the factor points to has a copy.

Equal stretches are one entry with its first holder and a count: in each chunk first, then in the
group, each time after their texts have been compared. So a stretch that is there twice has a copy of each of its windows, and only
distinct ones go to the suffix array. Anchors with more
than ``HOT`` distinct stretches in all chunks (a passage that stands in ever different surroundings) would make groups too large for one
task; windows of these are offered one by one with their first holder, once for each chunk, and counted by bucket.

``keep="none"`` removes every byte under a window that starts anywhere else too; ``keep="first"`` leaves
the first copy and removes later ones. Both judge the input, not what is left. Hot windows are told apart by 128-bit hashes (XXH3);
all others by their symbols.

A text longer than ``SEGMENT`` is hashed in overlapping segments; besides it, its task holds a few bytes for each of its bytes.

Null text is empty; shorter texts than a window keep all bytes. Null doc_ids come last in the order. Rows
that share a doc_id take the same place in the order: at equal places in them neither is
earlier, so ``keep="first"`` leaves both.

With ``unit="word"`` all of this is done on words (runs of bytes that are not blanks): lengths and anchors are
counted in words, a symbol is the hash of a word's bytes, and blanks between removed words go with them.
Words are the same only in the same case; how blanks separate them does not matter.
"""

from __future__ import annotations

import hashlib
from collections.abc import Callable, Iterator

import numpy as np
import pyarrow as pa
import xxhash
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from ._exchange import bucket_of, find, known, low, repeated, sizes, with_chunks
from ._text import _byte_codes, buffer, inside, mix, runs, slices, sliding_min, window_cover, window_hash, word_codes, words
from ._tokens import gather

LENGTH = 400
GRAM = 100
UNITS = {"byte": np.dtype(np.uint8), "word": np.dtype(np.uint64)}
HOT = 700
NULL_ID = 2**63 - 1
BATCH_BITS = 19  # a suffix array has fewer than 2**19 places; HOT stretches fit one
SEGMENT = 800_000  # windows that are hashed at a time
PLACE_BITS = np.uint64(22)  # of a place in a segment
STRETCH = np.dtype([("anchor", "<u8"), ("content", "<u8"), ("check", "<u8"), ("doc", "<i8"), ("place", "<i8"), ("size", "<i4"), ("count", "u1")])
WINDOW = np.dtype([("content", "<u8"), ("check", "<u8"), ("doc", "<i8"), ("place", "<i8"), ("count", "u1")])
OFFER = "bucket int, chunk int, kind int, rows binary, texts binary"


class Part:
    """Documents of one chunk: bytes and symbols (bytes or words)."""

    def __init__(self, batch: pa.RecordBatch, unit: str):
        self.batch, self.unit = batch, unit
        self.data, self.offsets = buffer(batch.column("text"))
        self.ids = batch.column("doc_id").fill_null(NULL_ID).to_numpy(zero_copy_only=False)
        self.symbols, self.edges = self.data, self.offsets
        if unit == "word":
            self.start, self.end, self.edges = words(self.data, self.offsets, "space")
            self.symbols = word_codes(self.data, self.start, self.end)

    def segments(self, length: int, gram: int) -> Iterator[Segment]:
        """All windows: several documents together, or one in overlapping segments."""
        step = SEGMENT if len(self.edges) == 2 else max(1, len(self.symbols))
        for a in range(0, max(0, len(self.symbols) - length + 1), step):
            yield Segment(self, a, min(a + step + length - 1, len(self.symbols)), length, gram)

    def owner(self, at: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
        """(doc_id, place in the document) of places."""
        doc = np.searchsorted(self.edges, at, "right") - 1
        return self.ids[doc], at - self.edges[doc]

    def in_bytes(self, gone: np.ndarray) -> np.ndarray:
        """Flags of bytes from those of symbols; blanks inside a run of words have the run's."""
        if self.unit == "byte":
            return gone
        d = np.zeros(len(self.data) + 1, np.int32)
        cut = np.zeros(len(gone) + 1, bool)
        cut[self.edges] = True
        d[self.start[gone & (cut[:-1] | np.concatenate(([True], ~gone[:-1])))]] += 1
        d[self.end[gone & (cut[1:] | np.concatenate((~gone[1:], [True])))]] -= 1
        return np.cumsum(d[:-1], dtype=np.int32) > 0


class Segment:
    """Symbols [begin, stop) of a part, and runs of windows (first to last, places in the segment) with a common anchor place."""

    def __init__(self, part: Part, begin: int, stop: int, length: int, gram: int):
        self.part, self.begin, self.symbols = part, begin, part.symbols[begin:stop]
        self.first = self.last = self.anchor = np.zeros(0, np.int64)
        self.code = np.zeros(0, np.uint64)
        windows = np.flatnonzero(inside(np.clip(part.edges - begin, 0, len(self.symbols)), len(self.symbols), length))
        if not len(windows):
            return
        h = window_hash(_byte_codes()[self.symbols] if part.unit == "byte" else self.symbols, gram)
        place = sliding_min((h >> PLACE_BITS) << PLACE_BITS | np.arange(len(h), dtype=np.uint64), length - gram + 1) & ((np.uint64(1) << PLACE_BITS) - np.uint64(1))
        place = place[windows].astype(np.int64)
        new = np.concatenate(([True], (place[1:] != place[:-1]) | (windows[1:] != windows[:-1] + 1)))
        edge = np.flatnonzero(new)
        self.first = windows[edge]
        self.last = windows[np.concatenate((edge[1:], [len(windows)])) - 1]
        self.anchor = place[edge]
        # least hashes are all small; mixed again they spread over the buckets
        self.code = mix(h[self.anchor])

    def digests(self, start: np.ndarray, stop: np.ndarray) -> np.ndarray:
        """128-bit hashes of spans, as two columns."""
        width = self.symbols.itemsize
        raw, h = memoryview(np.ascontiguousarray(self.symbols).view(np.uint8)), xxhash.xxh3_128_digest
        return np.frombuffer(b"".join([h(raw[a:b]) for a, b in zip((start * width).tolist(), (stop * width).tolist(), strict=True)]), "<u8").reshape(-1, 2)

    def stretches(self, at: np.ndarray, length: int) -> np.ndarray:
        out = np.zeros(len(at), STRETCH)
        out["anchor"], out["size"], out["count"] = self.code[at], self.last[at] - self.first[at] + length, 1
        out["content"], out["check"] = self.digests(self.first[at], self.last[at] + length).T
        out["doc"], out["place"] = self.part.owner(self.begin + self.first[at])
        return out

    def windows(self, at: np.ndarray, length: int) -> tuple[np.ndarray, np.ndarray]:
        """(places in the segment, rows) of the windows of runs."""
        starts = gather(np.arange(len(self.symbols)), self.first[at], self.last[at] - self.first[at] + 1)
        out = np.zeros(len(starts), WINDOW)
        out["content"], out["check"] = self.digests(starts, starts + length).T
        out["count"] = 1
        out["doc"], out["place"] = self.part.owner(self.begin + starts)
        return starts, out


def _parts(table: pa.Table, unit: str) -> Iterator[Part]:
    for batch in slices(table.to_batches(), "text", SEGMENT):
        yield Part(batch, unit)


def _identity(rows: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """The two hashes that tell rows apart."""
    return rows["content"], rows["check"]


def _merge(rows: np.ndarray) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """(distinct contents with the first holder and summed counts, input row each comes from, distinct row of each input row)."""
    if not len(rows):
        return rows, np.zeros(0, np.int64), np.zeros(0, np.int64)
    content, other = _identity(rows)
    order = np.lexsort((rows["place"], rows["doc"], other, content))
    content, other = content[order], other[order]
    new = np.concatenate(([True], (content[1:] != content[:-1]) | (other[1:] != other[:-1])))
    edge = np.flatnonzero(new)
    out = rows[order[edge]].copy()
    out["count"] = np.minimum(np.add.reduceat(rows["count"][order].astype(np.int64), edge), 255)
    back = np.empty(len(rows), np.int64)
    back[order] = np.cumsum(new) - 1
    return out, order[edge], back


def _compare(symbols: np.ndarray, a: np.ndarray, b: np.ndarray, size: np.ndarray) -> None:
    """Merged stretches begin at a, what they are merged with at b; both hold the same symbols."""
    width = symbols.itemsize
    raw = np.ascontiguousarray(symbols).tobytes()
    for x, y, n in zip((a * width).tolist(), (b * width).tolist(), (size.astype(np.int64) * width).tolist(), strict=True):
        if x != y and raw[x : x + n] != raw[y : y + n]:
            raise RuntimeError("two stretches of text have one hash")


def _find(table: np.ndarray, rows: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """(whether each row is in the table, which is ascending by content, where)"""
    hit, at = find(table["content"], rows["content"])
    if len(table):
        hit &= _identity(table)[1][at] == _identity(rows)[1]
    return hit, at


def suffix_order(text: np.ndarray, starts: np.ndarray, length: int) -> tuple[np.ndarray, np.ndarray]:
    """Suffixes at ``starts`` in the order of their first ``length`` symbols, then of place: (places, how many symbols, up to ``length``, each shares with the one before).

    Prefix doubling: ranks by 5 bytes (one word), then by 10, 20, ... and at last by ``length``. Shared lengths come from the ranks of
    all depths, the deepest first. Every start has ``length`` symbols.
    """
    n, bits = len(text), np.uint64(BATCH_BITS)
    if n >= 1 << BATCH_BITS:
        raise ValueError("too much text for one suffix array")
    mask = (np.uint64(1) << bits) - np.uint64(1)
    if text.dtype == np.uint8:
        depth, padded = 5, np.concatenate((text, np.zeros(length, np.uint8)))
        key = np.zeros(n, np.uint64)
        for k in range(5):
            key = key << np.uint64(8) | padded[k : k + n]
    else:  # words by their number, as a whole hash leaves no room for the place
        depth, key = 1, np.unique(text, return_inverse=True)[1].astype(np.uint64)
    place = np.arange(n, dtype=np.uint64)

    def ranks(keys: np.ndarray) -> np.ndarray:
        keys.sort()
        at, keys = (keys & mask).astype(np.int64), keys >> bits
        rank = np.zeros(n + length, np.uint32)
        rank[at] = np.cumsum(np.concatenate(([0], keys[1:] != keys[:-1])))
        return rank

    rank = ranks(key << bits | place)
    levels = [(depth, rank)]
    while depth * 2 <= length:
        wide = rank.astype(np.uint64)
        rank = ranks((wide[:n] << bits | wide[depth : depth + n]) << bits | place)
        depth *= 2
        levels.append((depth, rank))
    shift = length - depth
    last = (rank[starts].astype(np.uint64) << bits | rank[starts + shift]) << bits | starts.astype(np.uint64)
    last.sort()
    at, last = (last & mask).astype(np.int64), last >> bits
    shared = np.zeros(len(at), np.int64)
    if len(at) > 1:
        same = last[1:] == last[:-1]
        shared[1:][same] = length
        i = np.flatnonzero(~same) + 1
        x, y, l = at[i - 1], at[i], np.zeros(len(i), np.int64)
        for depth, rank in reversed(levels):
            l[(l + depth <= length) & (rank[x + l] == rank[y + l])] += depth
        if levels[0][0] > 1:
            going = np.ones(len(i), bool)
            for _ in range(levels[0][0] - 1):
                going &= l < length
                going[going] = text[x[going] + l[going]] == text[y[going] + l[going]]
                l[going] += 1
        shared[i] = l
    return at, shared


def _previous_smaller(at: np.ndarray, shared: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """For each row of suffix order: the row before it with a smaller place (-1: none) and the least shared length on the way there.

    All rows jump at once: a row whose candidate has a larger place takes over that one's candidate.
    """
    to, least = np.arange(len(at)) - 1, shared.copy()
    open_ = np.arange(1, len(at))
    open_ = open_[at[to[open_]] > at[open_]]
    while len(open_):
        by = to[open_]
        least[open_], to[open_] = np.minimum(least[open_], least[by]), to[by]
        open_ = open_[to[open_] >= 0]
        open_ = open_[at[to[open_]] > at[open_]]
    return to, np.where(to < 0, 0, least)


def longest_previous_factors(text: np.ndarray, starts: np.ndarray, length: int) -> tuple[np.ndarray, np.ndarray]:
    """For each start (ascending): (the most symbols, up to ``length``, that an earlier start shares with it, one such start or -1)."""
    at, shared = suffix_order(text, starts, length)
    factor, source = np.zeros(len(at), np.int64), np.full(len(at), -1)
    # rows that share all of ``length`` are ascending by place: the row before has the previous smaller place, and only the first of
    # them looks further, over the first ones of other such runs
    head = np.flatnonzero(shared < length)
    inner = np.flatnonzero(shared >= length)
    factor[inner], source[inner] = length, at[inner - 1]
    if len(head):
        places = at[head]
        back, least = _previous_smaller(places, shared[head])
        turned = np.concatenate(([0], shared[head][:0:-1]))
        ahead, other = _previous_smaller(places[::-1], turned)
        ahead, other = len(head) - 1 - ahead[::-1], other[::-1]
        ahead = np.where(ahead == len(head), -1, ahead)
        # the previous smaller place lies in the run that begins at the row found: its last place that is smaller
        ends = np.concatenate((head[1:], [len(at)]))
        before = _last_below(at, head[back], ends[back], places)
        near = least >= other
        factor[head] = np.where(near, least, other)
        pick = np.where(near, before, places[ahead])
        source[head] = np.where(factor[head] > 0, pick, -1)
    row = np.searchsorted(starts, at)
    out, origin = np.empty_like(factor), np.empty_like(source)
    out[row], origin[row] = factor, source
    return out, origin


def _last_below(at: np.ndarray, begin: np.ndarray, end: np.ndarray, value: np.ndarray) -> np.ndarray:
    """The last of at[begin : end] (ascending) below value, which is above the first; by bisection of all at once."""
    low, high = begin.copy(), end.copy()
    while (high - low > 1).any():
        middle = (low + high) // 2
        below = at[np.minimum(middle, len(at) - 1)] < value
        low, high = np.where(below & (high - low > 1), middle, low), np.where(~below & (high - low > 1), middle, high)
    return at[low]


def copies(texts: np.ndarray, size: np.ndarray, length: int) -> tuple[np.ndarray, np.ndarray]:
    """For all windows of concatenated texts, in order: (has a copy, has an earlier copy)."""
    ends = np.cumsum(size)
    count = size - length + 1
    starts = np.arange(count.sum()) + np.repeat(ends - size - np.cumsum(count) + count, count)
    factor, source = longest_previous_factors(texts, starts, length)
    earlier = factor >= length
    copy = earlier.copy()
    copy[np.searchsorted(starts, source[earlier])] = True
    return copy, earlier


def covered(docs: DataFrame, finish: Callable, schema: str, keep: str, columns: tuple[str, ...] = (), length: int = LENGTH, hot: int = HOT, gram: int = GRAM, unit: str = "byte") -> DataFrame:
    """Runs ``finish(part, removed)`` on every part of every chunk; removed has one flag for each byte."""
    if keep not in ("none", "first"):
        raise ValueError(f"keep={keep!r}: none or first")
    if length < 2 * gram:
        raise ValueError(f"windows of {length} {unit}s are too short for anchors of {gram}")
    symbol = UNITS[unit]
    chunks, buckets = sizes(docs)
    chunked = with_chunks(docs, chunks, *columns)
    wide = length - gram + 1  # windows of a stretch at most
    mask_bytes = -(-wide // 8)
    stretch_answer = np.dtype([("content", "<u8"), ("check", "<u8"), ("doc", "<i8"), ("place", "<i8"), ("all", "u1"), ("mask", "u1", (mask_bytes,))])

    def prints(table: pa.Table):
        """Anchors of a chunk, with the number of their distinct stretches; one that is there several times counts twice at least."""
        rows = [np.zeros(0, STRETCH)]
        for p in _parts(table, unit):
            rows += [_merge(x.stretches(np.arange(len(x.code)), length))[0] for x in p.segments(length, gram)]
        rows = _merge(np.concatenate(rows))[0]
        order = np.argsort(rows["anchor"], kind="stable")
        anchors, edge = np.unique(rows["anchor"][order], return_index=True)
        several = np.minimum(np.add.reduceat(rows["count"][order].astype(np.int64), edge), 2) if len(edge) else edge
        return anchors, np.maximum(np.diff(np.append(edge, len(rows))), several)

    flagged = repeated(chunked, prints, buckets)
    offer_kind = pa.schema([("bucket", pa.int32()), ("chunk", pa.int32()), ("kind", pa.int32()), ("rows", pa.binary()), ("texts", pa.binary())])

    def split(p: Segment, marks, counts):
        """(runs whose anchors occur again, runs of hot ones) of a segment."""
        hit, at = find(marks, low(p.code))
        many = hit & (counts[at] > hot) if len(counts) else hit
        return np.flatnonzero(hit & ~many), np.flatnonzero(many)

    def offer(table: pa.Table, answers: pa.Table) -> pa.Table:
        marks, counts = known(answers)
        cold, texts, warm = [np.zeros(0, STRETCH)], [], [np.zeros(0, WINDOW)]
        if len(marks):
            for p in (x for part in _parts(table, unit) for x in part.segments(length, gram)):
                a, b = split(p, marks, counts)
                all_rows = p.stretches(a, length)
                rows, source, back = _merge(all_rows)
                _compare(p.symbols, p.first[a], p.first[a[source]][back], all_rows["size"])
                cold.append(rows)
                texts += [p.symbols[x : x + n] for x, n in zip(p.first[a[source]].tolist(), rows["size"].tolist(), strict=True)]
                if len(b):
                    warm.append(_merge(p.windows(b, length)[1])[0])
        rows, source, back = _merge(np.concatenate(cold))
        if any(not np.array_equal(texts[i], texts[source[k]]) for i, k in enumerate(back.tolist()) if source[k] != i):
            raise RuntimeError("two stretches of text have one hash")
        chunk = table.column("chunk")[0].as_py() if table.num_rows else None
        out = []
        own = bucket_of(rows["anchor"], buckets)
        order = np.argsort(own, kind="stable")
        for b in np.unique(own).tolist():
            at = order[np.searchsorted(own[order], b) : np.searchsorted(own[order], b, "right")]
            out.append((b, chunk, 0, rows[at].tobytes(), np.concatenate([texts[source[i]] for i in at]).tobytes()))
        rows = _merge(np.concatenate(warm))[0]
        own = bucket_of(rows["content"], buckets)
        for b in np.unique(own).tolist():
            out.append((b, chunk, 1, rows[own == b].tobytes(), b""))
        return pa.Table.from_arrays([pa.array(c, t) for c, t in zip(list(zip(*out, strict=True)) or [[]] * 5, offer_kind.types, strict=True)], schema=offer_kind)

    answer_kind = pa.schema([("chunk", pa.int32()), ("kind", pa.int32()), ("hashes", pa.binary()), ("counts", pa.binary())])

    def judge(table: pa.Table) -> pa.Table:
        out = []
        kind = table.column("kind").to_numpy()
        # stretches: one entry for each content, in the order of anchor and first holder
        mine = table.filter(pa.array(kind == 0))
        if mine.num_rows:
            blocks = [np.frombuffer(x, STRETCH) for x in mine.column("rows").to_pylist()]
            texts = np.frombuffer(b"".join(mine.column("texts").to_pylist()), symbol)
            rows = np.concatenate(blocks)
            begin = np.cumsum(rows["size"]) - rows["size"]
            merged, source, back = _merge(rows)
            _compare(texts, begin, begin[source][back], rows["size"])
            order = np.lexsort((merged["place"], merged["doc"], merged["anchor"]))
            ranked = merged[order]
            group = np.concatenate((np.flatnonzero(np.concatenate(([True], ranked["anchor"][1:] != ranked["anchor"][:-1]))), [len(ranked)]))
            ends = np.concatenate(([0], np.cumsum(ranked["size"].astype(np.int64))))
            answer = np.zeros(len(merged), stretch_answer)
            for f in ("content", "check", "doc", "place"):
                answer[f] = merged[f]
            some = np.zeros(len(merged), bool)
            g = 0
            while g < len(group) - 1:  # as many whole groups as one suffix array takes
                stop = int(np.searchsorted(ends[group], ends[group[g]] + (1 << BATCH_BITS) - 1, "right")) - 1
                stop = max(stop, g + 1)
                at = order[group[g] : group[stop]]
                g = stop
                size = merged["size"][at].astype(np.int64)
                copy, earlier = copies(gather(texts, begin[source[at]], size), size, length)
                count = size - length + 1
                grid = np.zeros((len(at), mask_bytes * 8), bool)
                row, col = np.repeat(np.arange(len(at)), count), np.arange(count.sum()) - np.repeat(np.cumsum(count) - count, count)
                grid[row, col] = earlier if keep == "first" else copy
                answer["mask"][at] = np.packbits(grid, axis=1)
                some[at] = grid.any(axis=1)
            answer["all"] = merged["count"] > 1
            some |= merged["count"] > 1
            per = np.split(back, np.cumsum([len(b) for b in blocks])[:-1])
            for chunk, own in zip(mine.column("chunk").to_pylist(), per, strict=True):
                own = own[some[own]]
                if len(own):
                    out.append((chunk, 1, answer[own].tobytes(), b""))
        # windows of hot anchors
        mine = table.filter(pa.array(kind == 1))
        if mine.num_rows:
            blocks = [np.frombuffer(x, WINDOW) for x in mine.column("rows").to_pylist()]
            merged, _, back = _merge(np.concatenate(blocks))
            per = np.split(back, np.cumsum([len(b) for b in blocks])[:-1])
            for chunk, own in zip(mine.column("chunk").to_pylist(), per, strict=True):
                own = own[merged["count"][own] > 1]
                if len(own):
                    out.append((chunk, 2, merged[own].tobytes(), b""))
        return pa.Table.from_arrays([pa.array(c, t) for c, t in zip(list(zip(*out, strict=True)) or [[]] * 4, answer_kind.types, strict=True)], schema=answer_kind)

    offers = chunked.groupBy("chunk").cogroup(flagged.groupBy("chunk")).applyInArrow(offer, OFFER)
    judged = offers.groupBy("bucket").applyInArrow(judge, "chunk int, kind int, hashes binary, counts binary")
    answers = flagged.select("chunk", F.lit(0).alias("kind"), "hashes", "counts").unionByName(judged)

    def end(table: pa.Table, answers: pa.Table) -> pa.Table:
        kind = answers.column("kind").to_numpy()
        marks, counts = known(answers.filter(pa.array(kind == 0)))

        def read(k: int, dtype) -> np.ndarray:
            rows = np.frombuffer(b"".join(answers.filter(pa.array(kind == k)).column("hashes").to_pylist()), dtype)
            return rows[np.argsort(rows["content"], kind="stable")]

        known_stretches, known_windows = read(1, stretch_answer), read(2, WINDOW)
        out = []
        for part in _parts(table, unit):
            gone = np.zeros(len(part.symbols), bool)
            for p in part.segments(length, gram) if len(marks) else ():
                a, b = split(p, marks, counts)
                rows = p.stretches(a, length)
                hit, at = _find(known_stretches, rows)
                a, rows, found = a[hit], rows[hit], known_stretches[at[hit]]
                count = p.last[a] - p.first[a] + 1
                other = (found["doc"] != rows["doc"]) | (found["place"] != rows["place"])
                grid = np.unpackbits(found["mask"], axis=1).astype(bool) if len(a) else np.zeros((0, mask_bytes * 8), bool)
                # an equal stretch elsewhere (earlier, if the first one stays) is a copy of all windows
                grid[found["all"] > 0 if keep == "none" else other] = True
                row, col = np.repeat(np.arange(len(a)), count), np.arange(count.sum()) - np.repeat(np.cumsum(count) - count, count)
                gone[(p.begin + np.repeat(p.first[a], count) + col)[grid[row, col]]] = True
                if len(b):
                    starts, rows = p.windows(b, length)
                    hit, at = _find(known_windows, rows)
                    if keep == "first" and len(known_windows):
                        found = known_windows[at]
                        hit &= (found["doc"] != rows["doc"]) | (found["place"] != rows["place"])
                    gone[p.begin + starts[hit]] = True
            out.append(finish(part, part.in_bytes(window_cover(np.flatnonzero(gone), length, len(part.symbols)))))
        return pa.Table.from_batches(out) if out else none

    from pyspark.sql.pandas.types import to_arrow_schema

    fields = to_arrow_schema(docs.sparkSession.createDataFrame([], schema).schema)
    none = fields.empty_table()
    return chunked.groupBy("chunk").cogroup(answers.groupBy("chunk")).applyInArrow(end, schema)


def digests(docs: DataFrame, keep: str = "none", length: int = LENGTH, hot: int = HOT) -> DataFrame:
    """doc_id, n_bytes, n_removed, n_spans (maximal removed runs), kept_sha256 (of the bytes left)."""

    def finish(p: Part, gone: np.ndarray) -> pa.RecordBatch:
        n, spans, sha = [], [], []
        for a, b in zip(p.offsets[:-1].tolist(), p.offsets[1:].tolist(), strict=True):
            own = gone[a:b]
            n.append(int(own.sum()))
            spans.append(len(runs(own)[0]) if n[-1] else 0)
            sha.append(hashlib.sha256((p.data[a:b][~own] if n[-1] else p.data[a:b]).tobytes()).hexdigest())
        return pa.RecordBatch.from_arrays([p.batch.column("doc_id"), pa.array(np.diff(p.offsets)), pa.array(n, pa.int64()), pa.array(spans, pa.int64()), pa.array(sha, pa.string())], names=["doc_id", "n_bytes", "n_removed", "n_spans", "kept_sha256"])

    return covered(docs, finish, "doc_id long, n_bytes long, n_removed long, n_spans long, kept_sha256 string", keep, (), length, hot)


def dedup(docs: DataFrame, keep: str = "first", length: int = LENGTH, hot: int = HOT, gram: int = GRAM, unit: str = "byte") -> DataFrame:
    """``docs`` with repeated passages cut out of text, all columns and rows kept (a null text becomes empty); characters are cut whole or not at all."""
    others = [c for c in docs.columns if c not in ("doc_id", "text")]
    renamed = docs.select("doc_id", "text", *[F.col(f"`{c}`").alias(f"_c{i}") for i, c in enumerate(others)])
    kinds = dict(renamed.dtypes)

    def finish(p: Part, gone: np.ndarray) -> pa.RecordBatch:
        if gone.any():
            head = np.flatnonzero((p.data & 0xC0) != 0x80)
            gone = np.repeat(np.logical_and.reduceat(gone, head), np.diff(np.concatenate((head, [len(gone)]))))
        kept = np.concatenate(([0], np.cumsum(~gone)))[p.offsets]
        text = pa.LargeStringArray.from_buffers(len(p.offsets) - 1, pa.py_buffer(kept.astype(np.int64)), pa.py_buffer(p.data[~gone].tobytes())).cast(pa.string())
        cols = [p.batch.column("doc_id"), text, *(p.batch.column(f"_c{i}") for i in range(len(others)))]
        return pa.RecordBatch.from_arrays(cols, names=["doc_id", "text", *(f"_c{i}" for i in range(len(others)))])

    schema = ", ".join(["doc_id long", "text string", *(f"_c{i} {kinds[f'_c{i}']}" for i in range(len(others)))])
    done = covered(renamed, finish, schema, keep, tuple(f"_c{i}" for i in range(len(others))), length, hot, gram, unit)
    back = {f"_c{i}": c for i, c in enumerate(others)}
    place = {c: n for n, c in enumerate(docs.columns)}
    return done.select(*[F.col(c).alias(back.get(c, c)) for c in sorted(done.columns, key=lambda c: place[back.get(c, c)])])
