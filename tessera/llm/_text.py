"""Byte-level helpers for Arrow batches: hashes of spans, word bounds, run lengths.

Every helper works on one bounded buffer inside one task. ``slices`` cuts Arrow batches so that
a task holds a few MB of text at a time. A single text is never cut by it: what goes through one in pieces
(segments of suffix_dedup) says so.
"""

from __future__ import annotations

from collections.abc import Iterator
from functools import lru_cache

import numpy as np
import pyarrow as pa

SLICE_BYTES = 1_000_000
_U = np.uint64


P = 2**31 - 1
# two bases for a hash, and two more for a second one
BASES = ((1_183_186_591, 742_938_285), (1_956_611_049, 319_274_473))


def _mod(x: np.ndarray) -> np.ndarray:
    """x modulo P but for multiples of P that may be left."""
    return (x & _U(P)) + (x >> _U(31))


_held: dict[int, np.ndarray] = {}  # one table for each base, as long as was ever needed


def powers(base: int, n: int) -> np.ndarray:
    """base**i modulo P for i up to n, by doubling."""
    have = len(_held.get(base, ()))
    if have <= n:
        size = 1 << max(16, (n + 1).bit_length())
        out = np.ones(size, np.uint32)
        have = 1
        while have < size:
            out[have : 2 * have] = out[:have].astype(_U) * _U(pow(base, have, P)) % _U(P)
            have *= 2
        _held[base] = out
    return _held[base][: n + 1]


@lru_cache(maxsize=2)
def _byte_codes() -> np.ndarray:
    return np.random.default_rng(20240229).integers(1, 2**62, 256, dtype=np.int64).astype(_U)


def mix(x: np.ndarray) -> np.ndarray:
    """A bijection of 64-bit words that spreads every input bit."""
    with np.errstate(over="ignore"):
        x = (x ^ (x >> _U(30))) * _U(0xBF58476D1CE4E5B9)
        x = (x ^ (x >> _U(27))) * _U(0x94D049BB133111EB)
    return x ^ (x >> _U(31))


class SpanHash:
    """Polynomial hashes of any spans of one sequence of 62-bit symbols, after one prefix sum.

    A span's hash is a pair of sum(part[i] * base**(end - 1 - i)) modulo the prime P, one for the lower and one for the upper 31 bits
    of the symbols, so it depends on the span alone. Two spans of n symbols collide with a probability of (n / P)**2 at most over the
    choice of the bases, whatever their structure. ``second`` takes another pair of bases: with both, spans are told apart by 124 bits.
    """

    def __init__(self, codes: np.ndarray, second: bool = False):
        n = len(codes)
        self.n, self.bases, self.sums = n, BASES[second], []
        for k, base in enumerate(self.bases):
            part = codes >> _U(31) & _U(P) if k else codes & _U(P)
            total = np.zeros(n + 1, _U)
            np.cumsum(_mod(part * powers(base, n)[:n][::-1]), out=total[1:])
            self.sums.append(total)

    def _join(self, parts: list[np.ndarray]) -> np.ndarray:
        high, low = (_mod(_mod(x)) for x in parts)
        high[high >= P] -= _U(P)
        low[low >= P] -= _U(P)
        return mix(high << _U(31) | low)

    def __call__(self, start: np.ndarray, end: np.ndarray) -> np.ndarray:
        up = [powers(pow(base, -1, P), self.n) for base in self.bases]
        return self._join([_mod(_mod(s[end] - s[start])) * inv[self.n - end] for s, inv in zip(self.sums, up, strict=True)])

    def rolling(self, width: int) -> np.ndarray:
        """Hash of every window of that width."""
        m = self.n - width + 1
        if m <= 0:
            return np.zeros(0, _U)
        up = [powers(pow(base, -1, P), self.n) for base in self.bases]
        return self._join([_mod(_mod(s[width:] - s[:m])) * inv[:m][::-1] for s, inv in zip(self.sums, up, strict=True)])


def window_hash(codes: np.ndarray, width: int) -> np.ndarray:
    """A hash of every window of that width, by doubling. It is quick and spreads well, but structured texts collide: for choosing places, not for telling
    texts apart."""
    out, span, factor = codes, 1, 0x9E3779B97F4A7C15
    with np.errstate(over="ignore"):
        while span * 2 <= width:
            out = out[: len(out) - span] * _U(factor) + out[span:]
            factor = factor * factor % 2**64
            span *= 2
        if rest := width - span:
            out = out[: len(out) - rest] * _U(0xD1B54A32D192ED03) + out[rest:]
        return (out ^ (out >> _U(29))) * _U(0xBF58476D1CE4E5B9) if len(codes) >= width else np.zeros(0, _U)


def byte_hash(data: np.ndarray, second: bool = False) -> SpanHash:
    return SpanHash(_byte_codes()[data], second)


LONG_WORD = 1024


def word_codes(data: np.ndarray, start: np.ndarray, end: np.ndarray) -> np.ndarray:
    """Hashes of spans (words) of a text: 8 bytes at a time go through ``mix``; spans over ``LONG_WORD`` bytes are hashed by XXH3."""
    n = (end - start).astype(np.int64)
    eight = np.ndarray(len(data) + 1, "<u8", np.concatenate((data, np.zeros(8, np.uint8))), 0, (1,))  # the 8 bytes from each place on
    out = mix(n.astype(_U) + _U(0x9E3779B97F4A7C15))
    at, done = np.flatnonzero((n > 0) & (n <= LONG_WORD)), 0
    while len(at):
        left = n[at] - done
        part = eight[start[at] + done]
        short = left < 8
        part[short] &= (_U(1) << (_U(8) * left[short].astype(_U))) - _U(1)
        with np.errstate(over="ignore"):
            out[at] = mix(out[at] * _U(0xD1B54A32D192ED03) + part)
        done += 8
        at = at[left > 8]
    long = np.flatnonzero(n > LONG_WORD)
    if len(long):
        import xxhash

        raw = memoryview(np.ascontiguousarray(data))
        out[long] = [xxhash.xxh3_64_intdigest(raw[a:b]) for a, b in zip(start[long].tolist(), end[long].tolist(), strict=True)]
    return out


def buffer(column) -> tuple[np.ndarray, np.ndarray]:
    """(bytes, offsets) of a string or binary column, nulls empty, offsets from 0."""
    if isinstance(column, pa.ChunkedArray):
        column = column.combine_chunks() if column.num_chunks != 1 else column.chunk(0)
    if column.null_count:
        column = column.fill_null("" if pa.types.is_string(column.type) or pa.types.is_large_string(column.type) else b"")
    column = column.cast(pa.large_binary())
    _, off, data = column.buffers()
    offsets = np.frombuffer(off, np.int64, len(column) + 1, column.offset * 8)
    raw = np.frombuffer(data, np.uint8) if data is not None else np.zeros(0, np.uint8)
    return raw[offsets[0] : offsets[-1]], offsets - offsets[0]


def slices(batches, column: str, limit: int = SLICE_BYTES) -> Iterator[pa.RecordBatch]:
    """The batches cut between rows so that each part holds about ``limit`` bytes of a column at most."""
    for batch in batches:
        if not batch.num_rows:
            continue
        _, offsets = buffer(batch.column(column))
        start = 0
        while start < batch.num_rows:
            stop = int(np.searchsorted(offsets, offsets[start] + limit, "right")) - 1
            stop = min(max(stop, start + 1), batch.num_rows)
            yield batch.slice(start, stop - start)
            start = stop


def lower_ascii(data: np.ndarray) -> np.ndarray:
    return np.where((data >= 65) & (data <= 90), data + 32, data).astype(np.uint8)


@lru_cache(maxsize=8)
def _table(kind: str) -> np.ndarray:
    t = np.ones(256, bool)
    if kind == "space":  # all but blanks: [^\x20\x09-\x0D]+
        t[[32, 9, 10, 11, 12, 13]] = False
    else:  # ASCII letters in lower case, digits and every byte past ASCII
        t[:128] = False
        t[48:58] = t[97:123] = True
    return t


def words(data: np.ndarray, offsets: np.ndarray, kind: str) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """Bounds of words and, for each document, the number of its first word (one more at the end).

    Both kinds are unions of byte classes in which all bytes past ASCII are word bytes, so working
    on UTF-8 bytes gives what a regular expression on characters gives.
    """
    n = len(data)
    if not n:
        return np.zeros(0, np.int64), np.zeros(0, np.int64), np.zeros(len(offsets), np.int64)
    w = _table(kind)[data]
    first = w.copy()
    first[1:] &= ~w[:-1]
    cut = offsets[(offsets > 0) & (offsets < n)]
    first[cut] = w[cut]
    last = w.copy()
    last[:-1] &= ~w[1:]
    last[cut - 1] = w[cut - 1]
    start, end = np.flatnonzero(first), np.flatnonzero(last) + 1
    return start, end, np.searchsorted(start, offsets)


def window_cover(starts: np.ndarray, width: int, n: int) -> np.ndarray:
    """True for each of n places that a window beginning at one of ``starts`` (distinct, ending by n) covers."""
    d = np.zeros(n + 1, np.int32)
    d[starts] += 1
    d[starts + width] -= 1
    return np.cumsum(d[:n], dtype=np.int32) > 0


def unused(name: str, columns: list[str]) -> str:
    """``name``, or with underscores in front what no column has (Spark's names ignore case)."""
    taken = {c.lower() for c in columns}
    while name.lower() in taken:
        name = "_" + name
    return name


def runs(flags: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """Starts and ends of the runs of True."""
    d = np.diff(np.concatenate(([0], flags.astype(np.int8), [0])))
    return np.flatnonzero(d == 1), np.flatnonzero(d == -1)


def sliding_min(x: np.ndarray, width: int) -> np.ndarray:
    """Minimum of each window, in log2(width) passes."""
    out, span = x, 1
    while span * 2 <= width:
        out = np.minimum(out[: len(out) - span], out[span:])
        span *= 2
    rest = width - span
    return np.minimum(out[: len(out) - rest], out[rest:]) if rest else out


def inside(doc_first: np.ndarray, n: int, width: int) -> np.ndarray:
    """True for starts of windows of ``width`` items (of n) that end in the document they start in."""
    ok = np.zeros(max(0, n - width + 1), bool)
    for a, b in zip(doc_first[:-1], doc_first[1:], strict=True):
        if b - a >= width:
            ok[a : b - width + 1] = True
    return ok
