"""Benchmark decontamination by winnowing.

Texts are lower-cased (A-Z) and cut into words of letters and digits (any byte past ASCII counts). Of the hashes of k-word
grams, the smallest in every run of ``window - k + 1`` neighbours is kept; so any ``window`` words
that a document and an item share keep the same fingerprint on both sides. Documents' fingerprints
meet the items', and a hit is extended: every window around it is compared with the items' windows.
Items shorter than a window (but not empty) are one window of their own length, looked up at every place.

The items' index is broadcast in slices of at most ``SLICE_WORDS`` words (a proven bound, checked by a count); each slice
is one pass over the documents, and hits of several slices are united per distinct (doc_id, text).

Null text has no words. Items with null or no words never hit. Null item_ids hit but aren't listed or
counted; equal item_ids count once. Repeated documents keep their rows. Extra columns of ``docs``
pass through ``remove``; ``hits`` reads doc_id and text alone.
"""

from __future__ import annotations

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from ._text import SpanHash, buffer, inside, lower_ascii, runs, slices, sliding_min, unused, window_cover, word_codes, words

WINDOW = 10
GRAM = 5
SLICE_WORDS = 2_000_000
HITS = "doc_id long, text_hash long, n_words long, spans array<struct<start:long,end:long>>, items array<long>"
_MAX = np.uint64(2**64 - 1)


def _hashes(text) -> tuple[SpanHash, np.ndarray, np.ndarray, np.ndarray]:
    data, offsets = buffer(text)
    data = lower_ascii(data)
    start, end, first = words(data, offsets, "word")
    return SpanHash(word_codes(data, start, end)), first, start, end


def _winnow(seq: SpanHash, first: np.ndarray, gram: int, window: int) -> tuple[np.ndarray, np.ndarray]:
    """(gram hash at each place, whether it is the least of some window). Grams across texts never are."""
    h = seq.rolling(gram)
    if not len(h):
        return h, np.zeros(0, bool)
    valid = inside(first, seq.n, gram)
    h = np.where(valid, h, _MAX)
    span = window - gram + 1
    low = sliding_min(np.concatenate((np.full(span - 1, _MAX), h, np.full(span - 1, _MAX))), span)
    # h is selected if it equals the least of some window over it, the largest of those least values
    best = ~sliding_min(~np.where(low == _MAX, np.uint64(0), low), span)
    return h, valid & (best == h)


class Index:
    """Windows of a bounded set of items: sorted hashes by length, and which items have them."""

    def __init__(self, items: list[tuple[int | None, str]], window: int, gram: int):
        self.window, self.gram, self.ids = window, gram, [i for i, _ in items]
        seq, first, _, _ = _hashes(pa.array([t for _, t in items], pa.string()))
        count = np.diff(first)
        h, chosen = _winnow(seq, first, gram, window)
        self.prints = np.unique(h[chosen]) if len(h) else np.zeros(0, np.uint64)
        self.tables: dict[int, tuple[np.ndarray, np.ndarray]] = {}
        for length in sorted({int(min(c, window)) for c in count if c}):
            whole = np.flatnonzero((count >= window) if length == window else (count == length))
            starts = np.concatenate([np.arange(first[i], first[i + 1] - length + 1) for i in whole])
            owner = np.repeat(whole, count[whole] - length + 1)
            hashes = seq(starts, starts + length)
            pair = np.unique(np.stack((hashes, owner.astype(np.uint64))), axis=1)
            self.tables[length] = (pair[0], pair[1].astype(np.int64))

    def find(self, text) -> tuple[np.ndarray, list[tuple[np.ndarray, np.ndarray]], list[set]]:
        """For each text: words, hit runs, items."""
        seq, first, _, _ = _hashes(text)
        n, docs = seq.n, len(first) - 1
        hit = np.zeros(n, bool)
        items: list[set] = [set() for _ in range(docs)]
        for length, (table, owner) in self.tables.items():
            if n < length:
                continue
            fits = inside(first, n, length)
            if length == self.window:
                h, chosen = _winnow(seq, first, self.gram, self.window)
                at = np.flatnonzero(chosen)
                near = np.searchsorted(self.prints, h[at])
                at = at[self.prints[np.minimum(near, len(self.prints) - 1)] == h[at]] if len(self.prints) else at[:0]
                around = np.unique((at[:, None] - np.arange(self.window - self.gram + 1)[None, :]).ravel())
                starts = around[(around >= 0) & (around < len(fits))]
            else:
                starts = np.arange(len(fits))
            starts = starts[fits[starts]]
            own = seq(starts, starts + length)
            lo = np.searchsorted(table, own)
            found = table[np.minimum(lo, len(table) - 1)] == own
            starts, own, lo = starts[found], own[found], lo[found]
            if not len(starts):
                continue
            hit |= window_cover(starts, length, n)
            doc = np.searchsorted(first, starts, "right") - 1
            pair = np.unique(np.stack((doc, lo)), axis=1)
            hi = np.searchsorted(table, table[pair[1]], "right")
            for d, a, b in zip(pair[0].tolist(), pair[1].tolist(), hi.tolist(), strict=True):
                items[d].update(owner[a:b].tolist())
        spans = []
        for d in range(docs):
            spans.append(runs(hit[first[d] : first[d + 1]]) if items[d] else (np.zeros(0, np.int64),) * 2)
        return np.diff(first), spans, items


def _pass(docs: DataFrame, items: list[tuple[int | None, str]], window: int, gram: int) -> DataFrame:
    shared = docs.sparkSession.sparkContext.broadcast(items)
    held: dict[str, Index] = {}

    def run(batches):
        if "index" not in held:
            held["index"] = Index(shared.value, window, gram)
        index = held["index"]
        for part in slices(batches, "text"):
            count, spans, items = index.find(part.column("text"))
            rows = [[{"start": int(a), "end": int(b)} for a, b in zip(*s, strict=True)] for s in spans]
            ids = [sorted({index.ids[i] for i in x} - {None}) for x in items]
            kind = pa.list_(pa.struct([("start", pa.int64()), ("end", pa.int64())]))
            yield pa.RecordBatch.from_arrays([part.column("doc_id"), part.column("text_hash"), pa.array(count.astype(np.int64)), pa.array(rows, kind), pa.array(ids, pa.list_(pa.int64()))], names=["doc_id", "text_hash", "n_words", "spans", "items"])

    return docs.select(F.col("doc_id").cast("long").alias("doc_id"), "text", F.xxhash64("text").alias("text_hash")).mapInArrow(run, HITS)


def hits(docs: DataFrame, benchmark: DataFrame, window: int = WINDOW, gram: int = GRAM) -> DataFrame:
    """doc_id, text_hash, n_words, spans (of words, [start, end)), items (ids) of every document."""
    items = benchmark.select(F.col("item_id").cast("long").alias("item_id"), F.col("text").cast("string").alias("text")).filter("text is not null").distinct()
    # a word takes two bytes but the last, so bytes / 2 bounds the words
    size = items.agg(F.coalesce(F.sum(F.octet_length("text") / 2 + 1), F.lit(0.0))).first()[0]
    count = max(1, -(-int(size) // SLICE_WORDS))
    passes = []
    for k in range(count):
        part = items.filter(F.pmod(F.xxhash64("item_id", "text"), F.lit(count)) == k)
        passes.append(_pass(docs, [(r.item_id, r.text) for r in part.toLocalIterator()], window, gram))
    if count == 1:
        return passes[0]
    found = passes[0]
    for other in passes[1:]:
        found = found.unionByName(other)
    key = [F.col("doc_id"), F.col("text_hash")]
    joined = found.groupBy(*key).agg(F.max("n_words").alias("n_words"), F.array_distinct(F.flatten(F.collect_set("spans"))).alias("spans"), F.array_distinct(F.flatten(F.collect_set("items"))).alias("items"))
    # spans of several passes may overlap: each word once
    places = F.array_sort(F.array_distinct(F.flatten(F.transform("spans", lambda s: F.sequence(s["start"], s["end"] - 1)))))
    one = F.transform(places, lambda p: F.struct(p.alias("start"), (p + 1).alias("end")))
    copies = docs.select(F.col("doc_id").cast("long").alias("doc_id"), F.xxhash64("text").alias("text_hash"))
    joined = joined.withColumn("spans", F.when(F.size("spans") > 0, one).otherwise(F.col("spans"))).withColumnRenamed("doc_id", "d").withColumnRenamed("text_hash", "h")
    return copies.join(joined, F.col("doc_id").eqNullSafe(F.col("d")) & (F.col("text_hash") == F.col("h"))).select("doc_id", "text_hash", "n_words", "spans", "items")


def remove(docs: DataFrame, benchmark: DataFrame, window: int = WINDOW, gram: int = GRAM, unnamed: bool = False) -> DataFrame:
    """``docs`` without documents that share a window with an item, all columns kept; items with a null item_id count if ``unnamed``."""
    doc, text = (unused(c, docs.columns) for c in ("__hit_doc", "__hit_text"))
    key = hits(docs, benchmark, window, gram).filter(F.size("spans" if unnamed else "items") > 0).select(F.col("doc_id").alias(doc), F.col("text_hash").alias(text)).distinct()
    # documents are looked up by (doc_id, hash of the text); few are hit
    return docs.join(key, F.col("doc_id").eqNullSafe(F.col(doc)) & (F.xxhash64("text") == F.col(text)), "left_anti")
