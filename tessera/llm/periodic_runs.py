"""Passages that repeat themselves, by runs in grammar-compressed texts.

A run is a stretch of consecutive words with smallest period q (words q apart are equal) of at least max(``LEAST``, 3 q) words that no neighbouring word
extends. For the documents of a batch (about a MB of text) a task

1. numbers words, and gives a grammar to every document that has any four words twice (others have no run: 3 q words with period q,
   and 24 at least, repeat four words next to any place in them);
2. Re-Pair: in rounds, pairs of neighbouring symbols that occur more often than the pairs they overlap become nonterminals, until no pair of
   a document occurs twice; what is left of a document is halved into a balanced tree. So every nonterminal has two parts and a list of
   its places in the derivation;
3. finds the runs that cross the boundary between the two parts of each nonterminal, once, at one of its places. More than half of such a run lies on
   one side, so the four words next to the boundary occur again there one period away: these places give the periods to try, each
   of which is extended both ways by comparing hashes of stretches;
4. translates what it found to all places of the nonterminal, and merges stretches of one period that overlap by a period into maximal ones. A run is found whole at
   the smallest nonterminal that holds it.

Runs are confirmed word by word in the end; hashes only choose (another pair of bases is tried should they ever mislead). Work is n log n in words, there is
no shuffle. Null or empty text: no words and no runs. Repeated rows are judged alike, a null doc_id is kept, an empty table gives an
empty result, other columns are not read. A single text is held whole by its task, with some hundred bytes for each of its words.
"""

from __future__ import annotations

import hashlib
from collections.abc import Callable, Iterator
from dataclasses import dataclass

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from ._text import SpanHash, _table, buffer, mix, slices, words

LEAST = 24
REPEATS = 3
GRAM = 4  # words: of 24 with period q, half a run holds q + 4 at least on one side of any place
BLOCK = 2_000_000  # periods tried at a time, unless one nonterminal has more
_U = np.uint64


@dataclass
class Nodes:
    """All places of all nonterminals: rule, and where both parts begin and the second one ends."""

    rule: np.ndarray
    start: np.ndarray
    middle: np.ndarray
    end: np.ndarray


@dataclass
class Runs:
    start: np.ndarray
    length: np.ndarray
    period: np.ndarray


def _ragged(start: np.ndarray, count: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """(number of the range, member) for ranges of whole numbers."""
    which = np.repeat(np.arange(len(count)), count)
    return which, np.arange(len(which)) - np.repeat(np.cumsum(count) - count, count) + np.repeat(start, count)


def _join(symbol, size, chosen, names):
    """Each chosen symbol and the one after it become one symbol."""
    symbol, size = symbol.copy(), size.copy()
    symbol[chosen] = names
    size[chosen] += size[chosen + 1]
    left = np.ones(len(symbol), bool)
    left[chosen + 1] = False
    return symbol[left], size[left], left


def grammar(ids: np.ndarray, owner: np.ndarray) -> Nodes:
    """Re-Pair over the word ids of documents (``owner`` ascends), then a balanced tree over what is left of each."""
    n = len(ids)
    _, symbol = np.unique(mix(owner.astype(_U)) ^ mix(ids.astype(_U) + _U(1) << _U(20)), return_inverse=True)  # of one document each, or else pairs are counted together, which does no harm
    symbol, size, at = symbol.astype(np.int64), np.ones(n, np.int64), np.arange(n)
    found, next_name, done = [], n, []

    def note(chosen, names):
        found.append((names, at[chosen], at[chosen + 1], at[chosen + 1] + size[chosen + 1]))

    while len(symbol) > 1:
        inside = np.flatnonzero(owner[:-1] == owner[1:])
        pairs, which, count = np.unique(symbol[inside] << 32 | symbol[inside + 1], return_inverse=True, return_counts=True)
        twice = count > 1
        if not twice.any():
            break
        rank = np.empty(len(pairs), np.int64)
        rank[np.lexsort((mix(pairs.astype(_U)), count))] = np.arange(len(pairs))
        rank[~twice] = -1
        weight = np.full(len(symbol) + 1, -1, np.int64)  # of the pair that begins one place before, so that both ends have a neighbour
        weight[inside + 1] = rank[which]
        # stretches of one pair, as in a a a a, where it is taken at every other place
        edge = np.flatnonzero(np.concatenate(([True], weight[1:] != weight[:-1])))
        value = weight[edge]
        top = np.zeros(len(edge), bool)
        top[1:-1] = (value[1:-1] >= 0) & (value[1:-1] > value[:-2]) & (value[1:-1] > value[2:])
        length = np.diff(np.concatenate((edge, [len(weight)])))
        which_edge, place = _ragged(edge[top], length[top])
        chosen = place[(place - edge[top][which_edge]) % 2 == 0] - 1
        rules, names = np.unique(weight[chosen + 1], return_inverse=True)
        note(chosen, next_name + names)
        symbol, size, left = _join(symbol, size, chosen, next_name + names)
        owner, at, next_name = owner[left], at[left], next_name + len(rules)
        # documents without a pair that occurs twice take no part in further rounds
        if len(found) % 4 == 0:
            inside = np.flatnonzero(owner[:-1] == owner[1:])
            pairs, which, count = np.unique(symbol[inside] << 32 | symbol[inside + 1], return_inverse=True, return_counts=True)
            live = np.isin(owner, np.unique(owner[inside[count[which] > 1]]))
            done.append((symbol[~live], size[~live], at[~live], owner[~live]))
            symbol, size, at, owner = symbol[live], size[live], at[live], owner[live]
    symbol, size, at, owner = (np.concatenate(x) for x in zip(*done, (symbol, size, at, owner), strict=True))
    order = np.argsort(at, kind="stable")
    symbol, size, at, owner = symbol[order], size[order], at[order], owner[order]
    while len(symbol) > 1:
        edge = np.flatnonzero(np.concatenate(([True], owner[1:] != owner[:-1])))
        number = np.arange(len(owner)) - np.repeat(edge, np.diff(np.concatenate((edge, [len(owner)]))))
        chosen = np.flatnonzero((owner[:-1] == owner[1:]) & (number[:-1] % 2 == 0))
        if not len(chosen):
            break
        names = next_name + np.arange(len(chosen))
        note(chosen, names)
        symbol, size, left = _join(symbol, size, chosen, names)
        owner, at, next_name = owner[left], at[left], next_name + len(chosen)
    return Nodes(*(np.concatenate(x) for x in zip(*found, strict=True))) if found else Nodes(*[np.zeros(0, np.int64)] * 4)


def _common(hashes: SpanHash, a: np.ndarray, b: np.ndarray, most: np.ndarray, back: bool) -> np.ndarray:
    """Words that are equal from places a and b on (or before them, if back), ``most`` at most."""
    low, high = np.zeros(len(a), np.int64), most + 1
    while len(at := np.flatnonzero(high - low > 1)):
        middle = (low[at] + high[at]) // 2
        x, y = a[at], b[at]
        same = hashes(x - middle, x) == hashes(y - middle, y) if back else hashes(x, x + middle) == hashes(y, y + middle)
        low[at[same]], high[at[~same]] = middle[same], middle[~same]
    return low


def _crossing(lo, mid, hi, grams: tuple, hashes: SpanHash, least: int):
    """(number of the nonterminal, start, end, period) of the runs over each boundary, inside of lo to hi."""
    order, rank, group, keys, n = grams
    size = hi - lo
    out = []
    for side in ("right", "left"):
        x = mid if side == "right" else mid - GRAM
        fits = np.flatnonzero((x >= lo) & (x + GRAM <= hi))
        x, span = x[fits], size[fits] // REPEATS
        base = group[x] * n
        if side == "right":
            first, stop = rank[x] + 1, np.searchsorted(keys, base + np.minimum(x + span, hi[fits] - GRAM), "right")
        else:
            first, stop = np.searchsorted(keys, base + np.maximum(x - span, lo[fits]), "left"), rank[x]
        count = np.maximum(stop - first, 0)
        total, begin = np.cumsum(count), 0
        while begin < len(count):
            end = max(begin + 1, int(np.searchsorted(total, (total[begin - 1] if begin else 0) + BLOCK, "right")))
            which, place = _ragged(first[begin:end], count[begin:end])
            node, where = fits[begin:end][which], x[begin:end][which]
            period = np.abs(order[place] - where)
            a = mid[node] if side == "right" else mid[node] - period  # equal to the word a period on
            ahead = _common(hashes, a, a + period, hi[node] - a - period, False)
            behind = _common(hashes, a, a + period, a - lo[node], True)
            start, stop_ = a - behind, a + period + ahead
            good = (start < mid[node]) & (stop_ > mid[node]) & (stop_ - start >= np.maximum(least, REPEATS * period))
            out.append((node[good], start[good], stop_[good], period[good]))
            begin = end
    node, start, stop, period = (np.concatenate(x) for x in zip(*out, strict=True))
    # the least period of each stretch
    order = np.lexsort((period, stop, start, node))
    node, start, stop, period = node[order], start[order], stop[order], period[order]
    new = np.concatenate((np.ones(min(1, len(node)), bool), (node[1:] != node[:-1]) | (start[1:] != start[:-1]) | (stop[1:] != stop[:-1])))
    return node[new], start[new], stop[new], period[new]


def _confirmed(ids: np.ndarray, owner: np.ndarray, runs: Runs) -> bool:
    """Whether all words a period apart are equal and no neighbour extends a run."""
    at = 0
    while at < len(runs.start):
        end = max(at + 1, int(np.searchsorted(np.cumsum(runs.length[at:]), BLOCK, "right")) + at)
        which, place = _ragged(runs.start[at:end], runs.length[at:end] - runs.period[at:end])
        if (ids[place] != ids[place + runs.period[at:end][which]]).any():
            return False
        at = end
    stop = runs.start + runs.length
    before, after = np.maximum(runs.start - 1, 0), np.minimum(stop, len(ids) - 1)
    longer = (runs.start > 0) & (owner[before] == owner[runs.start]) & (ids[before] == ids[before + runs.period])
    longer |= (stop < len(ids)) & (owner[after] == owner[runs.start]) & (ids[after] == ids[after - runs.period])
    return not longer.any()


def find_runs(ids: np.ndarray, owner: np.ndarray, least: int = LEAST) -> Runs:
    """All runs of documents, given as word numbers and the ascending number of the document of each; sorted by start, then period."""
    if least < LEAST:
        raise ValueError(f"runs of {least} words are too short for grams of {GRAM}")
    none = Runs(*[np.zeros(0, np.int64)] * 3)
    n = len(ids)
    if n < least:
        return none
    for second in (False, True):
        hashes = SpanHash(mix(ids.astype(_U) + _U(1)), second)
        # places with equal grams, in order
        whole = np.flatnonzero(owner[: n - GRAM + 1] == owner[GRAM - 1 :])
        gram = hashes(whole, whole + GRAM) ^ mix(owner[whole].astype(_U) + _U(1))
        by = np.argsort(gram, kind="stable")
        new = np.concatenate(([False], gram[by][1:] != gram[by][:-1])) if len(by) else np.zeros(0, bool)
        order, group_of = whole[by], np.cumsum(new)
        rank, group = np.zeros(n, np.int64), np.zeros(n, np.int64)
        rank[order], group[order] = np.arange(len(order)), group_of
        again = np.bincount(group_of, minlength=1) > 1
        # documents with no gram twice have no run
        live = np.zeros(int(owner[-1]) + 1, bool)
        live[owner[order[again[group_of]]]] = True
        words_left = np.flatnonzero(live[owner])
        if not len(words_left):
            return none
        nodes = grammar(ids[words_left], owner[words_left])
        shift = words_left - np.arange(len(words_left))  # documents are whole, so one shift holds for all of a node
        large = np.flatnonzero(nodes.end - nodes.start >= least)
        rule, start, middle, end = (x[large] for x in (nodes.rule, nodes.start, nodes.middle, nodes.end))
        if not len(large):
            return none
        move = shift[start]
        start, middle, end = start + move, middle + move, end + move
        sort = np.argsort(rule, kind="stable")
        start, middle, end = start[sort], middle[sort], end[sort]
        first = np.flatnonzero(np.concatenate(([True], np.diff(rule[sort]) > 0)))
        places = np.diff(np.concatenate((first, [len(sort)])))
        node, s, e, period = _crossing(start[first], middle[first], end[first], (order, rank, group, group_of * n + order, n), hashes, least)
        # to all places of the nonterminal
        which, place = _ragged(first[node], places[node])
        move = start[place] - start[first[node]][which]
        s, e, period = s[which] + move, e[which] + move, period[which]
        sort = np.lexsort((-e, s, period))
        s, e, period = s[sort], e[sort], period[sort]
        far = np.maximum.accumulate(period * (n + 1) + e) - period * (n + 1) if len(e) else e  # the furthest end so far of this period
        fresh = np.concatenate((np.ones(min(1, len(s)), bool), (period[1:] != period[:-1]) | (s[1:] > far[:-1] - period[1:])))
        at = np.flatnonzero(fresh)
        last = np.concatenate((at[1:], [len(s)]))[: len(at)] - 1
        sort = np.lexsort((period[at], s[at]))
        runs = Runs(s[at][sort], (far[last] - s[at])[sort], period[at][sort])
        if _confirmed(ids, owner, runs):
            return runs
    raise RuntimeError("periodic runs: hashes of stretches collide under both pairs of bases")


@dataclass
class Batch:
    """Words of some documents, in their order after ``remap``, and their runs (places in the document)."""

    raw: bytes
    start: np.ndarray
    end: np.ndarray
    first: np.ndarray  # number of each document's first word, and one more
    source: np.ndarray | None  # where words of remapped documents come from
    runs: Runs
    run_first: np.ndarray  # number of each document's first run, and one more

    def runs_of(self, k: int) -> list[tuple[int, int, int]]:
        a, b = self.run_first[k : k + 2].tolist()
        r = self.runs
        return list(zip((r.start[a:b] - self.first[k]).tolist(), r.length[a:b].tolist(), r.period[a:b].tolist(), strict=True))

    def collapsed(self) -> Iterator[bytes]:
        """The words of each document but those that a run has after its first period, joined by one blank."""
        size = self.end - self.start
        filled = np.full(int(size.sum()) + len(size), 32, np.uint8)
        at = np.cumsum(size + 1) - size - 1
        which, place = _ragged(self.start, size)
        filled[at[which] + place - self.start[which]] = np.frombuffer(self.raw, np.uint8)[place]
        plain, at = filled.tobytes(), np.concatenate((at, [len(filled)])).tolist()
        low, high = self.start.tolist(), self.end.tolist()
        for k, (a, b) in enumerate(zip(self.first[:-1].tolist(), self.first[1:].tolist(), strict=True)):
            own = self.runs_of(k)
            if self.source is None and not own:
                yield plain[at[a] : at[b] - 1] if b > a else b""
                continue
            kept = np.ones(b - a, bool)
            for s, n, q in own:
                kept[s + q : s + n] = False
            order = np.arange(a, b) if self.source is None else self.source[a:b]
            yield b" ".join([self.raw[low[i] : high[i]] for i in order[kept].tolist()])


def _batch(part: pa.RecordBatch, remap: Callable | None, least: int) -> Batch:
    data, offsets = buffer(part.column("text"))
    start, end, first = words(data, offsets, "space")
    bounds = np.concatenate(([0], np.cumsum(end - start)))
    spelled = pa.LargeBinaryArray.from_buffers(pa.large_binary(), len(start), [None, pa.py_buffer(bounds.astype(np.int64)), pa.py_buffer(np.ascontiguousarray(data[_table("space")[data]]))])
    ids = spelled.dictionary_encode().indices.to_numpy().astype(np.int64) if len(start) else np.zeros(0, np.int64)
    source = None
    if remap is not None:
        for k, (doc, a, b) in enumerate(zip(part.column("doc_id").to_pylist(), first[:-1].tolist(), first[1:].tolist(), strict=True)):
            if (places := remap(doc, b - a)) is not None:
                source = np.arange(len(start)) if source is None else source
                source[a:b] = a + places
    owner = np.repeat(np.arange(len(first) - 1), np.diff(first))
    runs = find_runs(ids if source is None else ids[source], owner, least)
    return Batch(data.tobytes(), start, end, first, source, runs, np.searchsorted(runs.start, first))


def _each(docs: DataFrame, finish: Callable, schema: str, remap: Callable | None, least: int) -> DataFrame:
    """Runs ``finish(part, batch)`` on parts of the documents; it gives a record batch."""

    def work(batches):
        for part in slices(batches, "text"):
            yield finish(part, _batch(part, remap, least))

    return docs.select(F.col("doc_id").cast("long").alias("doc_id"), F.col("text").cast("string").alias("text")).mapInArrow(work, schema)


def find(docs: DataFrame, remap: Callable | None = None, least: int = LEAST) -> DataFrame:
    """doc_id, n_words, runs (start, length and period in words; by start, then period).

    ``remap(doc_id, n)`` may give n places: the words of a document are then taken from there.
    """
    run = pa.list_(pa.struct([(c, pa.int64()) for c in ("start", "length", "period")]))

    def finish(part, batch):
        runs = [[dict(zip(("start", "length", "period"), r, strict=True)) for r in batch.runs_of(k)] for k in range(part.num_rows)]
        return pa.RecordBatch.from_arrays([part.column("doc_id"), pa.array(np.diff(batch.first).astype(np.int64)), pa.array(runs, run)], names=["doc_id", "n_words", "runs"])

    return _each(docs, finish, "doc_id long, n_words long, runs array<struct<start:long,length:long,period:long>>", remap, least)


def collapsed_text(docs: DataFrame, remap: Callable | None = None, least: int = LEAST) -> DataFrame:
    """doc_id, text: the first period of every run stays; words are joined by one blank."""

    def finish(part, batch):
        return pa.RecordBatch.from_arrays([part.column("doc_id"), pa.array([x.decode() for x in batch.collapsed()], pa.string())], names=["doc_id", "text"])

    return _each(docs, finish, "doc_id long, text string", remap, least)


def strongest(runs: list[tuple[int, int, int]]) -> tuple[int, int, int] | None:
    """The run with the greatest exact length / period; ties: smallest start, then period. Runs come in that order."""
    best = None
    for run in runs:
        if best is None or run[1] * best[2] > best[1] * run[2]:
            best = run
    return best


def digests(docs: DataFrame, remap: Callable | None = None, least: int = LEAST) -> DataFrame:
    """doc_id, n_runs; start, length, period and exponent_milli of the strongest run; SHA-256 of all runs and of the collapsed text."""

    def finish(part, batch):
        rows = []
        for k, text in enumerate(batch.collapsed()):
            runs = batch.runs_of(k)
            best = strongest(runs)
            head = (*best, 1000 * best[1] // best[2]) if best else (None,) * 4
            rows.append((len(runs), *head, hashlib.sha256("".join(f"{s},{n},{q}\n" for s, n, q in runs).encode()).hexdigest(), hashlib.sha256(text).hexdigest()))
        columns = list(zip(*rows, strict=True)) if rows else [()] * 7
        return pa.RecordBatch.from_arrays([part.column("doc_id"), *(pa.array(c, pa.int64()) for c in columns[:5]), *(pa.array(c, pa.string()) for c in columns[5:])], names=["doc_id", *"n_runs start length period exponent_milli runs_sha256 collapsed_sha256".split()])

    return _each(docs, finish, "doc_id long, n_runs long, start long, length long, period long, exponent_milli long, runs_sha256 string, collapsed_sha256 string", remap, least)
