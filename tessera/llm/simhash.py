"""SimHash near-duplicates by anchor points of a covering code.

A document's fingerprint has bit i set if over half of its shingle hashes have it set (XXH64 with
seed 42 of lower-cased word shingles). Two fingerprints link if at most ``MAX_BITS`` = 4 bits differ.

Links are found exactly: 64 bits are cut into three blocks, so of two linked fingerprints some
block differs in one bit at most. In each block the anchors are the codewords of the perfect
binary Golay code (23 bits, 4096 codewords, covering radius 3): every block value has one home
anchor within 3 bits, and whatever is within one bit of it is within 4 bits of that anchor. So a
fingerprint goes to every anchor within 4 bits (5.3 of them on average), and full fingerprints
are compared per anchor, homes with all that came. A hot anchor is cut into a grid of parts.

Equal fingerprints are one class before any of this, so copies cost nothing. Per anchor only
links are written that hold the group together (a spanning forest where links are dense), never
all pairs.

Null text and text without words have fingerprint zero, linked like any other. Null doc_ids keep
their rows and never name a component (component_id is null if a component has no other).
Repeated rows stay, each with its component. Extra columns are not read by ``fingerprints``.
"""

from __future__ import annotations

from functools import lru_cache

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from ._components import components
from ._shared import stored
from ._text import inside, lower_ascii, slices, unused, words

SHINGLE = 4
MAX_BITS = 4
BLOCKS = ((0, 22), (22, 21), (43, 21))  # first bit, bits
HOT_ROWS = 20_000  # rows of an anchor beyond which it is cut into parts
# fixed value: the generator polynomial of the binary Golay code
GOLAY = 0xC75


def shingle_hashes(text, width: int) -> tuple[np.ndarray, np.ndarray]:
    """(hashes of the shingles of all texts in order, how many each text has); a text shorter than a shingle is one."""
    import xxhash

    from ._text import buffer

    data, offsets = buffer(text)
    data = lower_ascii(data)
    start, end, first = words(data, offsets, "space")
    n = len(start)
    if not n:
        return np.zeros(0, np.uint64), np.zeros(len(offsets) - 1, np.int64)
    # words of the batch joined by one blank each
    from ._tokens import gather

    size = end - start
    place = np.concatenate(([0], np.cumsum(size + 1)))
    joined = np.full(place[-1], 32, np.uint8)
    joined[gather(np.arange(place[-1]), place[:-1], size)] = gather(data, start, size)
    count = np.diff(first)
    begin = np.flatnonzero(inside(first, n, width))
    stop = begin + width
    short = np.flatnonzero((count > 0) & (count < width))
    begin = np.concatenate((begin, first[short]))
    order = np.argsort(begin, kind="stable")
    stop = np.concatenate((stop, first[short + 1]))[order]
    begin = begin[order]
    view, h = memoryview(joined.tobytes()), xxhash.xxh64_intdigest
    hashes = np.array([h(view[a:b], 42) for a, b in zip(place[begin].tolist(), (place[stop] - 1).tolist(), strict=True)], np.uint64)
    return hashes, np.where(count >= width, count - width + 1, (count > 0).astype(np.int64))


def _fingerprint_batch(text, width: int) -> np.ndarray:
    hashes, per = shingle_hashes(text, width)
    out = np.zeros(len(per), np.uint64)
    full = np.flatnonzero(per)
    at = (np.cumsum(per) - per)[full]
    for a in range(0, len(full), 4096):  # bits of some thousand documents at a time
        lo, hi = at[a], at[a + 4096] if a + 4096 < len(full) else len(hashes)
        bits = np.unpackbits(hashes[lo:hi].astype(">u8").view(np.uint8).reshape(-1, 8), axis=1)
        sums = np.add.reduceat(bits, at[a : a + 4096] - lo, axis=0, dtype=np.int64)
        out[full[a : a + 4096]] = np.packbits(sums * 2 > per[full[a : a + 4096], None], axis=1).view(">u8").ravel()
    return out


def fingerprints(docs: DataFrame, width: int = SHINGLE) -> DataFrame:
    """doc_id, text_hash, fp (the 64 bits as a long) of each document."""

    def run(batches):
        for part in slices(batches, "text", 500_000):
            fp = pa.array(_fingerprint_batch(part.column("text"), width).view(np.int64))
            yield pa.RecordBatch.from_arrays([part.column("doc_id"), part.column("text_hash"), fp], names=["doc_id", "text_hash", "fp"])

    return docs.select(F.col("doc_id").cast("long").alias("doc_id"), "text", F.xxhash64("text").alias("text_hash")).mapInArrow(run, "doc_id long, text_hash long, fp long")


@lru_cache(maxsize=1)
def _golay() -> tuple[np.ndarray, np.ndarray, np.ndarray, np.ndarray]:
    """Syndromes by byte (3 x 256); for each syndrome the error patterns of up to 4 bits, how many, and which is the home's."""
    rest = []
    for i in range(23):
        v = 1 << i
        for b in range(22, 10, -1):
            if v >> b & 1:
                v ^= GOLAY << (b - 11)
        rest.append(v)
    by_byte = np.zeros((3, 256), np.int64)
    for k in range(3):
        for x in range(256):
            for b in range(8):
                if x >> b & 1 and 8 * k + b < 23:
                    by_byte[k, x] ^= rest[8 * k + b]
    from itertools import combinations

    lists: list[list[int]] = [[] for _ in range(2048)]
    for weight in range(5):
        for bits in combinations(range(23), weight):
            s = p = 0
            for b in bits:
                s ^= rest[b]
                p |= 1 << b
            lists[s].append(p)  # the lightest pattern, the home's, comes first
    most = max(map(len, lists))
    patterns = np.array([x + [0] * (most - len(x)) for x in lists], np.int64)
    return by_byte, patterns, np.array([len(x) for x in lists]), np.array([x[0] for x in lists])


def anchors(fp: np.ndarray) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """(index of the fingerprint, anchor key, whether it is its home) for all blocks."""
    by_byte, patterns, count, _ = _golay()
    index, keys, homes = [], [], []
    for k, (shift, bits) in enumerate(BLOCKS):
        x = ((fp >> np.uint64(shift)) & np.uint64((1 << bits) - 1)).astype(np.int64)
        s = by_byte[0, x & 255] ^ by_byte[1, x >> 8 & 255] ^ by_byte[2, x >> 16]
        for j in range(patterns.shape[1]):
            has = np.flatnonzero(j < count[s])
            index.append(has)
            keys.append(((x[has] ^ patterns[s[has], j]) >> 11) + (k << 12))
            homes.append(np.full(len(has), j == 0))
    return np.concatenate(index), np.concatenate(keys), np.concatenate(homes)


def group_links(fp: np.ndarray, home: np.ndarray, bits: int = MAX_BITS) -> list[tuple[np.ndarray, np.ndarray]]:
    """Links of one group, homes with all; where they are dense, a spanning forest of them."""
    n, out, found = len(fp), [], 0
    h = np.flatnonzero(home)
    step = max(1, 1_000_000 // max(1, n))
    for a in range(0, len(h), step):
        i, j = np.nonzero(np.bitwise_count(fp[h[a : a + step], None] ^ fp[None, :]) <= bits)
        i = h[a : a + step][i]
        keep = i != j
        out.append((fp[i[keep]], fp[j[keep]]))
        found += int(keep.sum())
        if found > 8 * n:
            break
    else:
        return out
    # dense: search outwards from each node; whoever is reached leaves the rest, so work stays small
    left, out = np.arange(n), []
    while len(left):
        front, left = left[:1], left[1:]
        while len(front) and len(left):
            part, front = front[:64], front[64:]
            near = np.bitwise_count(fp[part, None] ^ fp[None, left]) <= bits
            hit = near.any(axis=0)
            if hit.any():
                out.append((fp[part[near[:, hit].argmax(axis=0)]], fp[left[hit]]))
                front = np.concatenate((front, left[hit]))
                left = left[~hit]
    return out


def links(classes: DataFrame) -> DataFrame:
    """(a, b): links between distinct fingerprints (column fp), enough of them to keep every component together."""

    def spread(batches):
        for batch in batches:
            if batch.num_rows:
                fp = batch.column("fp").to_numpy(zero_copy_only=False)
                for a in range(0, len(fp), 2000):
                    own = fp[a : a + 2000]
                    i, key, home = anchors(own.view(np.uint64))
                    yield pa.RecordBatch.from_arrays([pa.array(key.astype(np.int32)), pa.array(own[i]), pa.array(home)], names=["anchor", "fp", "home"])

    dealt = dealt_out(classes.select("fp").mapInArrow(spread, "anchor int, fp long, home boolean"), "fp", "fp", "home")

    def compare(batches):
        held: list[np.ndarray] = [np.zeros(0, np.int64) for _ in range(3)]

        def done(cols, upto):
            key, fp, home = (c[:upto] for c in cols)
            edge = np.flatnonzero(np.diff(key)) + 1
            a_out, b_out = [], []
            for s, e in zip(np.concatenate(([0], edge)), np.concatenate((edge, [len(key)])), strict=True):
                if e - s > 1:
                    for a, b in group_links(fp[s:e].view(np.uint64), home[s:e]):
                        a_out.append(a)
                        b_out.append(b)
            if a_out:
                a, b = np.concatenate(a_out).view(np.int64), np.concatenate(b_out).view(np.int64)
                pair = np.unique(np.stack((np.maximum(a, b), np.minimum(a, b))), axis=1)
                return pa.RecordBatch.from_arrays([pa.array(pair[0]), pa.array(pair[1])], names=["a", "b"])

        for batch in batches:
            if not batch.num_rows:
                continue
            own = (batch.column("key").to_numpy(), batch.column("fp").to_numpy(), batch.column("home").to_numpy(zero_copy_only=False).astype(np.int64))
            held = [np.concatenate(x) for x in zip(held, own, strict=True)]
            upto = int(np.searchsorted(held[0], held[0][-1]))  # the last group may go on
            if upto:
                if (out := done(held, upto)) is not None:
                    yield out
                held = [c[upto:] for c in held]
        if len(held[0]) and (out := done(held, len(held[0]))) is not None:
            yield out

    return dealt.mapInArrow(compare, "a long, b long")


def dealt_out(rows: DataFrame, by: str, *columns: str) -> DataFrame:
    """Rows of anchors (anchor, home and others) by cells (key), with some columns: homes of a cell meet all its rows; hot anchors are grids of cells."""
    others = [c for c in rows.columns if c not in ("anchor", "home")]
    # a fixed number of anchors, whatever the input
    hot = rows.groupBy("anchor").count().filter(F.col("count") > HOT_ROWS).select("anchor", F.ceil(F.col("count") / HOT_ROWS).cast("int").alias("parts"))
    cut = rows.join(F.broadcast(hot), "anchor", "left").withColumn("parts", F.coalesce("parts", F.lit(1)))
    mine, all_parts = F.pmod(F.hash(by), F.col("parts")), F.sequence(F.lit(0), F.col("parts") - 1)
    # homes of part x meet all rows of part y in cell (x, y)
    whole = cut.filter("parts = 1").select("anchor", F.lit(0).alias("cell"), *others, "home")
    as_home = cut.filter("parts > 1 and home").select("anchor", F.explode(F.transform(all_parts, lambda y: mine * F.col("parts") + y)).alias("cell"), *others, F.lit(True).alias("home"))
    as_guest = cut.filter("parts > 1").select("anchor", F.explode(F.transform(all_parts, lambda x: x * F.col("parts") + mine)).alias("cell"), *others, F.lit(False).alias("home"))
    cells = whole.unionByName(as_home).unionByName(as_guest)
    key = F.shiftleft(F.col("anchor").cast("long"), 32).bitwiseOR(F.col("cell").cast("long"))
    return cells.select(key.alias("key"), *columns).repartition("key").sortWithinPartitions("key")


def _rooted(docs: DataFrame, width: int) -> tuple[DataFrame, DataFrame]:
    """(fingerprints of the documents, the component root, smallest doc_id and first document of each distinct fingerprint)"""
    prints = stored(fingerprints(docs, width), "fingerprints")
    order = F.struct(F.col("doc_id").isNull(), F.col("doc_id"), F.col("text_hash"))
    classes = prints.groupBy("fp").agg(F.min("doc_id").alias("least"), F.min(order).alias("best"))
    found = components(links(classes))
    return prints, classes.join(found.withColumnRenamed("node", "fp"), "fp", "left").withColumn("root", F.coalesce("root", "fp"))


def near_duplicates(docs: DataFrame, width: int = SHINGLE) -> DataFrame:
    """doc_id, fp, component_id (the smallest doc_id reachable over links) of each document."""
    prints, named = _rooted(docs, width)
    names = named.groupBy("root").agg(F.min("least").alias("component_id"))
    by_print = named.join(names, "root").select("fp", "component_id")
    return prints.join(by_print, "fp").select("doc_id", "fp", "component_id")


def keep_one(docs: DataFrame, width: int = SHINGLE) -> DataFrame:
    """One document of each component, the one with the smallest doc_id (then text hash); all columns."""
    return first_of(docs, _rooted(docs, width)[1])


def first_of(docs: DataFrame, named: DataFrame) -> DataFrame:
    """The first document of each root of ``named`` (root, best); all columns."""
    chosen = named.groupBy("root").agg(F.min("best").alias("best"))

    def key(doc_id, text_hash):
        return F.concat_ws(":", doc_id.cast("string"), text_hash.cast("string"))

    name, turn = (unused(c, docs.columns) for c in ("__simhash_key", "__simhash_n"))
    keys = chosen.select(key(F.col("best.doc_id"), F.col("best.text_hash")).alias(name))
    kept = docs.withColumn(name, key(F.col("doc_id").cast("long"), F.xxhash64("text"))).join(keys, name, "left_semi")
    # repeated rows have one key
    return kept.withColumn(turn, F.row_number().over(Window.partitionBy(name).orderBy(name))).filter(F.col(turn) == 1).drop(turn, name)
