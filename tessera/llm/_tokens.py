"""Token ids by a public tokenizer, with the ids of pieces of text kept in each Python worker."""

from __future__ import annotations

import os
from functools import lru_cache

import numpy as np

from ._text import buffer, word_codes

SLOTS = 1 << 20  # pieces kept by a worker at most
ARENA = 12_000_000  # ids kept by a worker at most


@lru_cache(maxsize=1)
def _classes() -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    blank, letter, stop = (np.zeros(256, bool) for _ in range(3))
    blank[[9, 10, 11, 12, 13, 32]] = True
    letter[65:91] = letter[97:123] = True
    stop[[ord(c) for c in ".,!?;:"]] = True
    return blank, letter, stop


def _after(mask: np.ndarray) -> np.ndarray:
    """The mask moved one place on."""
    out = np.zeros(len(mask), bool)
    out[1:] = mask[:-1]
    return out


def gather(values: np.ndarray, start: np.ndarray, length: np.ndarray) -> np.ndarray:
    """values[start : start + length] of each pair, one after another."""
    ends = np.cumsum(length)
    return values[np.arange(ends[-1] if len(ends) else 0) + np.repeat(start - ends + length, length)]


class Encoder:
    """``batch`` gives what Tokenizer.encode(text, add_special_tokens=False) of the file gives for each text.

    Both public vocabularies that are used here split a text, before any merge, at these places: before
    the last of blanks that stand before a non-blank; between other white space and non-blanks; between an
    ASCII or Latin-1 letter and one of ``.,!?;:``. So the ids of a text are those of the pieces between
    such places, and each distinct piece goes through the tokenizers library about once in a worker:
    ids are kept in a table with one slot for a hash (a newer piece takes a slot over). Pieces are told
    apart by a 62-bit hash. Texts with white space outside ASCII, and those that may hold an added token (``<|endoftext|>``) are encoded whole.
    """

    def __init__(self, path: str):
        os.environ["TOKENIZERS_PARALLELISM"] = "false"
        from tokenizers import Tokenizer

        self.tokenizer = Tokenizer.from_file(path)
        vocab = self.tokenizer.get_vocab(with_added_tokens=True)
        self.kind = np.dtype(np.uint32 if max(vocab.values()) > 65535 else np.uint16)
        line = self.tokenizer.encode("\n", add_special_tokens=False).ids
        # a piece of letters ends where the line break's id follows, or else with an id that ends a word
        self.glue, self.ends = "\n" if len(line) == 1 else " ", np.zeros(max(vocab.values()) + 1, bool)
        self.ends[line if len(line) == 1 else [i for t, i in vocab.items() if t.endswith("</w>")]] = True
        # how the added tokens begin: they are cut out of a text before anything else
        self.added = sorted({t.content.encode()[:2] for t in self.tokenizer.get_added_tokens_decoder().values()})
        self._clear()

    def _clear(self) -> None:
        self.hash = np.zeros(SLOTS, np.uint64)
        self.start = np.zeros(SLOTS, np.int32)
        self.length = np.zeros(SLOTS, np.int32)
        self.arena = np.zeros(1_000_000, self.kind)
        self.used = 0

    def _whole(self, text: str) -> np.ndarray:
        return np.array(self.tokenizer.encode(text, add_special_tokens=False).ids, self.kind)

    def _encode(self, pieces: list[bytes], pure: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
        """(ids, lengths) of pieces; pure: those of letters only, after a blank at most."""
        out: list[np.ndarray | None] = [None] * len(pieces)
        places = np.flatnonzero(pure)
        for a in range(0, len(places), 400):
            part = places[a : a + 400]
            ids = np.array(self.tokenizer.encode(self.glue.join(pieces[i].decode() for i in part) + self.glue, add_special_tokens=False).ids, self.kind)
            cut = np.flatnonzero(self.ends[ids])
            if len(cut) != len(part):  # not expected; each piece by itself is always right
                for i in part:
                    out[i] = self._whole(pieces[i].decode())
                continue
            first = np.concatenate(([0], cut[:-1] + 1))
            last = cut if self.glue == "\n" else cut + 1
            for i, x, y in zip(part.tolist(), first.tolist(), last.tolist(), strict=True):
                out[i] = ids[x:y]
        rest = np.flatnonzero(~pure)
        for i, e in zip(rest, self.tokenizer.encode_batch_fast([pieces[i].decode() for i in rest], add_special_tokens=False) if len(rest) else [], strict=True):
            out[i] = np.array(e.ids, self.kind)
        return np.concatenate(out) if out else np.zeros(0, self.kind), np.fromiter(map(len, out), np.int64, len(out))

    def batch(self, column) -> tuple[np.ndarray, np.ndarray]:
        """(ids of all texts, where each text's ids begin and the last ends) of an Arrow string column; null is empty."""
        data, offsets = buffer(column)
        n = len(data)
        if not n:
            return np.zeros(0, self.kind), np.zeros(len(offsets), np.int64)
        blank_, letter_, stop_ = _classes()
        blank, stop = blank_[data], stop_[data]
        lead = data == 0xC3
        tail = _after(lead) & (data != 0x97) & (data != 0xB7)
        letter = letter_[data] | tail
        cut = np.zeros(n, bool)
        cut[0] = True
        was_blank = _after(blank)
        space = data == 32
        cut |= blank & ~was_blank
        before_word = np.zeros(n, bool)
        before_word[:-1] = blank[:-1] & ~blank[1:]
        before_word[offsets[1:][offsets[1:] > 0] - 1] = False
        cut |= before_word
        cut |= ~blank & was_blank & ~_after(space)
        cut |= stop & _after(letter)
        cut[offsets[(offsets > 0) & (offsets < n)]] = True
        start = np.flatnonzero(cut)
        end = np.concatenate((start[1:], [n]))
        key = word_codes(data, start, end)
        key[key == 0] = 1
        slot = (key >> np.uint64(44)).astype(np.int64)
        missing = np.flatnonzero(self.hash[slot] != key)
        lengths, starts = self.length[slot], self.start[slot]
        extra = np.zeros(0, self.kind)
        if len(missing):
            new, at, back = np.unique(key[missing], return_index=True, return_inverse=True)
            a, b = start[missing[at]], end[missing[at]]
            raw = data.tobytes()
            plain = np.zeros(n + 1, np.int32)
            np.cumsum(letter | lead, out=plain[1:])
            first = a + (data[a] == 32)
            pure = (plain[b] - plain[first] == b - first) & (b > first) & (b - a < 200)
            extra, size = self._encode([raw[x:y] for x, y in zip(a.tolist(), b.tolist(), strict=True)], pure)
            offset = np.cumsum(size) - size
            held = self.arena
            if self.used + len(extra) > ARENA:
                self._clear()
            # ids of this batch: from the arena as it was, then the new ones
            base = len(held)
            lengths[missing], starts[missing] = size[back], offset[back] + base
            values = np.concatenate((held, extra)) if len(extra) else held
            keep = size <= 64
            if len(extra) <= ARENA:
                if self.used + len(extra) > len(self.arena):
                    grown = np.zeros(min(max(2 * len(self.arena), self.used + len(extra)), ARENA + len(extra)), self.kind)
                    grown[: self.used] = self.arena[: self.used]
                    self.arena = grown
                self.arena[self.used : self.used + len(extra)] = extra
                s = (new[keep] >> np.uint64(44)).astype(np.int64)
                self.hash[s], self.start[s], self.length[s] = new[keep], (offset[keep] + self.used).astype(np.int32), size[keep]
                self.used += len(extra)
        else:
            values = self.arena
        ids = gather(values, starts.astype(np.int64), lengths.astype(np.int64))
        per = np.concatenate(([0], np.cumsum(lengths)))
        bounds = per[np.searchsorted(start, offsets)]
        odd = self._odd(data, offsets, self.added)
        if len(odd):
            parts, raw = [ids[bounds[i] : bounds[i + 1]] for i in range(len(offsets) - 1)], data.tobytes()
            for i in odd:
                parts[i] = self._whole(raw[offsets[i] : offsets[i + 1]].decode())
            ids, bounds = np.concatenate(parts), np.concatenate(([0], np.cumsum([len(x) for x in parts])))
        return ids, bounds

    @staticmethod
    def _odd(data: np.ndarray, offsets: np.ndarray, added: list[bytes]) -> np.ndarray:
        """Texts with white space outside ASCII or an added token (or what begins like them)."""
        if len(data) < 2:
            return np.zeros(0, np.int64)
        a, b = data[:-1], data[1:]
        hit = np.flatnonzero(((a == 0xC2) & ((b == 0x85) | (b == 0xA0))) | ((a == 0xE1) & (b == 0x9A)) | ((a == 0xE2) & (b == 0x81)) | ((a == 0xE3) & (b == 0x80)))
        special = [np.flatnonzero((a == x[0]) & (b == x[-1])) if len(x) > 1 else np.flatnonzero(data == x[0]) for x in added]
        wide = np.flatnonzero((a == 0xE2) & (b == 0x80))
        third = data[np.minimum(wide + 2, len(data) - 1)]
        wide = wide[(third <= 0x8A) | (third == 0xA8) | (third == 0xA9) | (third == 0xAF)]
        return np.unique(np.searchsorted(offsets, np.concatenate((hit, wide, *special)), "right") - 1)


_held: dict[str, Encoder] = {}


def encoder(path: str) -> Encoder:
    """One encoder for a file in each worker."""
    if path not in _held:
        _held[path] = Encoder(path)
    return _held[path]
