"""Character-level helpers for Arrow batches: code points, letters, words, and bounded samples of rows."""

from __future__ import annotations

from dataclasses import dataclass
from functools import lru_cache

import numpy as np
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from ._text import SpanHash, mix


@lru_cache(maxsize=1)
def letters() -> np.ndarray:
    return np.fromiter((chr(i).isalpha() for i in range(0x110000)), bool, 0x110000)


@dataclass
class Chars:
    """Texts as code points, with the words (runs of letters) of all of them."""

    codes: np.ndarray
    offsets: np.ndarray  # of texts in codes
    letter: np.ndarray
    start: np.ndarray  # of words
    end: np.ndarray
    first: np.ndarray  # number of each text's first word, and one more


def chars(texts: list[str | None]) -> Chars:
    parts = [np.frombuffer(t.encode("utf-32-le"), np.uint32) if t else np.zeros(0, np.uint32) for t in texts]
    offsets = np.concatenate(([0], np.cumsum([len(p) for p in parts]))).astype(np.int64)
    codes = np.concatenate([*parts, np.zeros(0, np.uint32)])
    n, letter = len(codes), letters()[codes]
    begin, last = letter.copy(), letter.copy()
    begin[1:] &= ~letter[:-1]
    last[:-1] &= ~letter[1:]
    cut = offsets[(offsets > 0) & (offsets < n)]
    begin[cut] = letter[cut]
    last[cut - 1] = letter[cut - 1]
    start = np.flatnonzero(begin)
    return Chars(codes, offsets, letter, start, np.flatnonzero(last) + 1, np.searchsorted(start, offsets))


def code_hash(codes: np.ndarray) -> SpanHash:
    return SpanHash(mix(codes.astype(np.uint64) + np.uint64(1)))


def term_hashes(terms: list[str]) -> np.ndarray:
    """What code_hash gives for each term as a span."""
    c = chars(["".join(terms)])
    ends = np.cumsum([len(t) for t in terms]).astype(np.int64)
    return code_hash(c.codes)(ends - np.array([len(t) for t in terms], np.int64), ends) if terms else np.zeros(0, np.uint64)


def fold(doc_id: str = "doc_id") -> Column:
    """crc32 of the identifier as text, modulo 3; null for a null identifier."""
    return F.crc32(F.col(doc_id).cast("long").cast("string").cast("binary")) % 3


def held_out() -> Column:
    return F.coalesce(fold() == 1, F.lit(False))


def bounded_sample(rows: DataFrame, key: str, most: int) -> DataFrame:
    """About ``most`` rows at most, chosen by a hash of the key alone; all rows where there are fewer."""
    n = rows.count()
    if n <= most:
        return rows
    return rows.filter(F.pmod(F.xxhash64(key, F.lit("sample")), F.lit(1_000_000)) < int(1_000_000 * most / n))
