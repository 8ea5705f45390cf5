"""A minimal perfect hash of distinct 128-bit keys: bit arrays in levels, as in "Fast and scalable minimal perfect hashing for massive key sets" (2017).

At each level a key has one bit; bits that one key alone has are set, the other keys go to the next level. A key's number is the rank of
its bit. That takes some four bits a key; the keys are not kept.
"""

from __future__ import annotations

import numpy as np

from ._text import mix

GAMMA = 2  # bits of a level for each key that comes to it
LEVELS = 64  # the chance that keys are left is below 2**-64
_U = np.uint64


def _bits(keys: np.ndarray, level: int, size: int) -> np.ndarray:
    """The bit of each key (a row of two words) at a level of ``size`` < 2**32 bits."""
    with np.errstate(over="ignore"):
        x = mix(keys[:, 0] + _U(0x9E3779B97F4A7C15 * (level + 1) % 2**64)) ^ mix(keys[:, 1] + _U(0xD1B54A32D192ED03 * (level + 1) % 2**64))
        return ((x >> _U(32)) * _U(size) >> _U(32)).astype(np.int64)


def build(keys: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """(64-bit words of all levels, bits of each level) for distinct keys."""
    words, sizes = [np.zeros(0, _U)], []
    for level in range(LEVELS):
        if not len(keys):
            break
        size = -(-GAMMA * len(keys) // 64) * 64
        at = _bits(keys, level, size)
        count = np.bincount(at, minlength=size)
        words.append(np.packbits(count == 1, bitorder="little").view("<u8").astype(_U))
        sizes.append(size)
        keys = keys[count[at] > 1]
    if len(keys):
        raise ValueError("minimal perfect hash: keys are not distinct")
    return np.concatenate(words), np.array(sizes, np.int64)


def numbers(words: np.ndarray, sizes: np.ndarray, keys: np.ndarray) -> np.ndarray:
    """The number of each key, from 0. A key that was not there when the hash was built gets -1 or the number of another one."""
    ones = np.bitwise_count(words).astype(np.int64)
    before = np.cumsum(ones) - ones
    out, left, base = np.full(len(keys), -1, np.int64), np.arange(len(keys)), 0
    for level, size in enumerate(sizes.tolist()):
        at = _bits(keys[left], level, size) + base
        word, bit = words[at >> 6], (at & 63).astype(_U)
        hit = (word >> bit & _U(1)).astype(bool)
        out[left[hit]] = before[at[hit] >> 6] + np.bitwise_count(word[hit] & ((_U(1) << bit[hit]) - _U(1)))
        left, base = left[~hit], base + size
    return out
