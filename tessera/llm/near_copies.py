"""One document of each group of near copies: anchors of SimHash propose pairs, Jaccard similarity settles them.

Two documents are near copies if the sets of their shingles (five lower-cased words) have a Jaccard similarity of at
least 0.8; groups are the components of that relation. At 0.8 the fingerprints differ in about 0.15 of their bits, more
than ``simhash`` reaches with one fingerprint of 64. So a document has ``WORDS`` independent fingerprints of 64 bits. Their
bits are dealt by fixed permutations into 88 blocks of 23, and in each block a document goes to its home
anchor, the nearest codeword of the Golay code. Near copies at exactly 0.8 share a home in a block with a probability of about
0.12, and in no block with about 0.0003; higher similarity makes that vanish.

Per anchor, pairs are proposed if their sizes allow 0.8 and ``CHECK`` fingerprints differ in ``REACH`` bits at most, and linked
only if the shingle sets themselves reach 0.8. Links inside a component change nothing, so this has three steps:

1. the blocks of the first permutation propose; where pairs are dense (large groups of near copies), only a minimum spanning
   forest of them, and the classes of such groups are noted. The components of what is confirmed are known from then on.
2. The other blocks propose pairs of different components (but of two classes that are noted), and note the classes of groups where even these are
   dense.
3. All noted classes meet exactly (``prefix_pairs``): sets of a similarity of 0.8 share one of their rarest fifth of shingles. So texts
   that share much, but under 0.8 (forms, long passages), are never paired one by one, and nothing is capped.

Equal sets are one class before any of this: sets of one 64-bit hash, size and fingerprints (512 bits more; ``told_apart``). Shingles are 64-bit hashes. Null texts and texts without words are
one class. Which document stays is as in ``simhash.keep_one``.
"""

from __future__ import annotations

from functools import lru_cache

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from ._components import components
from ._shared import release, stored
from ._text import mix, slices
from .simhash import _golay, dealt_out, first_of, shingle_hashes

SHINGLE = 5
WORDS = 8  # fingerprints of 64 bits
CHECK = 3  # of them that go to anchors with the document
REACH = 58  # of 64 * CHECK bits; 0.19 of them differ at 0.8 in the worst case, of very short texts
DEALS = 4  # permutations
FIRST = 22  # blocks of the first one
SMALL = 256  # rows of an anchor that are compared together with other anchors
DENSE = 2  # pairs per row of an anchor beyond which not all are proposed
SKETCH = "doc_id long, text_hash long, node long, n int, prints binary"


@lru_cache(maxsize=1)
def _deals() -> np.ndarray:
    """Bits of each block (22 * DEALS x 23)."""
    r = np.random.default_rng(20240301)
    return np.concatenate([r.permutation(64 * WORDS)[: 22 * 23].reshape(22, 23) for _ in range(DEALS)])


def similar(inter, union):
    """Whether a Jaccard similarity is at least 0.8."""
    return 5 * inter >= 4 * union


def shingle_sets(text, width: int = SHINGLE) -> list[np.ndarray]:
    """Sorted distinct shingle hashes of each text."""
    hashes, per = shingle_hashes(text, width)
    return [np.unique(x) for x in np.split(hashes, np.cumsum(per)[:-1])]


def sketch(sets: list[np.ndarray]) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """(hash of each set, its size, fingerprints as WORDS words of 64 bits)"""
    n = np.array([len(x) for x in sets], np.int64)
    node, prints = np.zeros(len(sets), np.uint64), np.zeros((len(sets), 8 * WORDS), np.uint8)
    full = np.flatnonzero(n)
    ends = np.cumsum(n[full])
    a = 0
    while a < len(full):  # some thousand shingles at a time
        b = max(a + 1, int(np.searchsorted(ends, (ends[a - 1] if a else 0) + 20_000, "right")))
        own = full[a:b]
        a = b
        h, size = np.concatenate([sets[i] for i in own]), n[own]
        first = np.cumsum(size) - size
        with np.errstate(over="ignore"):
            node[own] = mix(np.add.reduceat(mix(h), first) + size.astype(np.uint64))
            many = np.stack([mix(h + np.uint64(k) * np.uint64(0x9E3779B97F4A7C15)) for k in range(1, WORDS + 1)], axis=1)
        bits = np.unpackbits(many.view(np.uint8).reshape(len(h), -1), axis=1)
        # one byte counts up to 255 shingles
        pieces = -(-size // 255)
        at = np.cumsum(pieces) - pieces
        start = np.repeat(first, pieces) + 255 * (np.arange(pieces.sum()) - np.repeat(at, pieces))
        counts = np.add.reduceat(bits.view(np.uint64), start, axis=0).view(np.uint8)
        sums = np.add.reduceat(counts, at, axis=0, dtype=np.int64)
        prints[own] = np.packbits(sums * 2 > size[:, None], axis=1)
    return node, n, prints.view(np.uint64)


def homes(prints: np.ndarray) -> np.ndarray:
    """The home anchor in each block (documents x blocks)."""
    by_byte, _, _, home = _golay()
    blocks = _deals()
    bits = np.unpackbits(np.ascontiguousarray(prints).view(np.uint8).reshape(len(prints), -1), axis=1)
    x = bits[:, blocks].astype(np.int64) @ (1 << np.arange(23))
    s = by_byte[0, x & 255] ^ by_byte[1, x >> 8 & 255] ^ by_byte[2, x >> 16]
    return ((x ^ home[s]) >> 11) + (np.arange(len(blocks)) << 12)


def _near(n1, c1, n2, c2) -> np.ndarray:
    """Bits that differ, or 255 where sizes or bits are too far apart."""
    d = sum(np.bitwise_count(c1[k] ^ c2[k]).astype(np.uint8) for k in range(CHECK))
    return np.where((d <= REACH) & (5 * np.minimum(n1, n2) >= 4 * np.maximum(n1, n2)), d, 255).astype(np.uint8)


def _forest(node: np.ndarray, n: np.ndarray, check: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """A minimum spanning forest of the near pairs of one anchor."""
    m = len(node)
    left, right = [], []
    far, parent, out = np.full(m, 256, np.int64), np.zeros(m, np.int64), np.ones(m, bool)
    x = 0
    for _ in range(m - 1):
        out[x] = False
        far[x] = 1000
        d = _near(n[x], check[:, x], n, check)
        better = out & (d < np.minimum(far, 255))
        far[better], parent[better] = d[better], x
        x = int(np.argmin(far))
        if far[x] < 255:
            left.append(x)
            right.append(int(parent[x]))
    return node[np.array(left, np.int64)], node[np.array(right, np.int64)]


def group_pairs(key: np.ndarray, node: np.ndarray, n: np.ndarray, check: np.ndarray, part: np.ndarray | None = None) -> tuple[np.ndarray, np.ndarray]:
    """Proposed pairs of nodes of different parts (if given); rows are ordered by key.

    Nodes of dense groups are given as pairs with themselves, besides a spanning forest where there are no parts yet.
    """
    edge = np.flatnonzero(np.concatenate(([True], key[1:] != key[:-1], [True])))
    size = np.diff(edge)
    group = np.repeat(np.arange(len(size)), size)
    order = np.lexsort((n, group))
    node, n, check = node[order], n[order], check[:, order]
    own = node if part is None else part[order]
    stop = np.repeat(edge[1:], size)
    left, right, found = [], [], np.zeros(len(size), np.int64)
    # groups of moderate size together: each row with the next, the next but one, ... of its group, while sizes allow it
    at = np.flatnonzero((size[group] > 1) & (size[group] <= SMALL))
    for shift in range(1, SMALL):
        at = at[at + shift < stop[at]]
        at = at[5 * n[at] >= 4 * n[at + shift]]
        if not len(at):
            break
        i = at[own[at] != own[at + shift]]
        i = i[_near(n[i], check[:, i], n[i + shift], check[:, i + shift]) < 255]
        left.append(i)
        right.append(i + shift)
        found += np.bincount(group[i], minlength=len(size))
    i, j = (np.concatenate(x) if x else np.zeros(0, np.int64) for x in (left, right))
    many = found > DENSE * size
    keep = ~many[group[i]]
    pairs = [(node[i[keep]], node[j[keep]])]
    for g in np.flatnonzero(many | (size > SMALL)).tolist():
        a, b = edge[g], edge[g + 1]
        mine, total = [], 0
        step = max(1, 1_000_000 // (b - a))
        for x in range(a, b if not many[g] else a, step):
            y = min(x + step, b)
            z = a + int(np.searchsorted(n[a:b], n[y - 1] * 5 // 4, "right"))
            i, j = np.nonzero((_near(n[x:y, None], check[:, x:y, None], n[None, x:z], check[:, None, x:z]) < 255) & (own[x:y, None] != own[None, x:z]))
            keep = j > i
            mine.append((node[x:y][i[keep]], node[x:z][j[keep]]))
            total += int(keep.sum())
            if total > DENSE * (b - a):
                break
        if many[g] or total > DENSE * (b - a):
            mine = [(node[a:b], node[a:b])]
            if part is None:
                mine.append(_forest(node[a:b], n[a:b], check[:, a:b]))
        pairs += mine
    a, b = (np.concatenate(x) for x in zip(*pairs, strict=True))
    pair = np.unique(np.stack((np.maximum(a, b), np.minimum(a, b))), axis=1)
    return pair[0], pair[1]


def sketches(docs: DataFrame) -> DataFrame:
    """doc_id, text_hash, node (hash of the shingle set), n (shingles in it), prints of each document."""

    def run(batches):
        for part in slices(batches, "text", 500_000):
            node, n, prints = sketch(shingle_sets(part.column("text")))
            cols = [part.column("doc_id"), part.column("text_hash"), pa.array(node.view(np.int64)), pa.array(n.astype(np.int32)), pa.array([x.tobytes() for x in prints], pa.binary())]
            yield pa.RecordBatch.from_arrays(cols, names=["doc_id", "text_hash", "node", "n", "prints"])

    return docs.select(F.col("doc_id").cast("long").alias("doc_id"), "text", F.xxhash64("text").alias("text_hash")).mapInArrow(run, SKETCH)


def proposed(classes: DataFrame, first: bool) -> DataFrame:
    """(a, b): pairs of classes (node, n, prints; in the second step also part) that share a home and may be similar.

    The first step takes the blocks of one permutation, the second one the others, for pairs of different parts. Nodes of dense groups
    are pairs with themselves.
    """
    columns = ["node", "n", *(f"c{k}" for k in range(CHECK)), *([] if first else ["part"])]

    def spread(batches):
        for batch in batches:
            for s in range(0, batch.num_rows, 1000):
                part = batch.slice(s, 1000)
                prints = np.frombuffer(b"".join(part.column("prints").to_pylist()), np.uint64).reshape(-1, WORDS)
                key = homes(prints)
                key = key[:, :FIRST] if first else key[:, FIRST:]
                own = [part.column("node").to_numpy(), part.column("n").to_numpy(), *(prints[:, k].view(np.int64) for k in range(CHECK)), *([] if first else [part.column("part").to_numpy()])]
                cols = [key.ravel().astype(np.int32), np.ones(key.size, bool), *(np.repeat(c, key.shape[1]) for c in own)]
                yield pa.RecordBatch.from_arrays([pa.array(c) for c in cols], names=["anchor", "home", *columns])

    schema = "anchor int, home boolean, " + ", ".join(f"{c} {'int' if c == 'n' else 'long'}" for c in columns)
    rows = classes.filter("n > 0").select("node", "n", "prints", *([] if first else ["part"])).mapInArrow(spread, schema)

    def compare(batches):
        held: list[np.ndarray] = [np.zeros(0, np.int64) for _ in range(1 + len(columns))]

        def done(upto: int):
            key, node, n, *rest = (c[:upto] for c in held)
            a, b = group_pairs(key, node, n, np.stack(rest[:CHECK]).view(np.uint64), None if first else rest[CHECK])
            return pa.RecordBatch.from_arrays([pa.array(a), pa.array(b)], names=["a", "b"])

        for batch in batches:
            if not batch.num_rows:
                continue
            held = [np.concatenate(x) for x in zip(held, (batch.column(c).to_numpy().astype(np.int64) for c in ("key", *columns)), strict=True)]
            upto = int(np.searchsorted(held[0], held[0][-1]))  # the last group may go on
            if upto:
                yield done(upto)
                held = [c[upto:] for c in held]
        if len(held[0]):
            yield done(len(held[0]))

    return dealt_out(rows, "node", *columns).mapInArrow(compare, "a long, b long").distinct()


def shingles_of(docs: DataFrame, classes: DataFrame, nodes: DataFrame) -> DataFrame:
    """(node, shingles: the sorted hashes as bytes) of some classes, from the text of one document of each."""
    wanted = classes.join(nodes, "node", "left_semi").select("node", F.col("best.doc_id").alias("d"), F.col("best.text_hash").alias("h"))
    own = docs.select(F.col("doc_id").cast("long").alias("doc_id"), "text", F.xxhash64("text").alias("text_hash"))
    found = own.join(wanted, F.col("doc_id").eqNullSafe(F.col("d")) & (F.col("text_hash") == F.col("h"))).select("node", "text")

    def run(batches):
        for part in slices(batches, "text", 500_000):
            yield pa.RecordBatch.from_arrays([part.column("node"), pa.array([x.tobytes() for x in shingle_sets(part.column("text"))], pa.binary())], names=["node", "shingles"])

    # repeated rows have one node
    return stored(found.mapInArrow(run, "node long, shingles binary").groupBy("node").agg(F.first("shingles").alias("shingles")), "shingles")


def confirmed(sets: DataFrame, pairs: DataFrame) -> DataFrame:
    """The pairs whose shingle sets reach 0.8."""
    left = sets.select(F.col("node").alias("a"), F.col("shingles").alias("x"))
    right = sets.select(F.col("node").alias("b"), F.col("shingles").alias("y"))

    def settle(batches):
        for batch in batches:
            good = np.zeros(batch.num_rows, bool)
            for start in range(0, batch.num_rows, 256):  # sets of some hundred pairs at a time
                part = batch.slice(start, 256)
                for i, (x, y) in enumerate(zip(part.column("x").to_pylist(), part.column("y").to_pylist(), strict=True), start):
                    x, y = np.frombuffer(x, np.uint64), np.frombuffer(y, np.uint64)
                    inter = len(np.intersect1d(x, y, assume_unique=True))
                    good[i] = similar(inter, len(x) + len(y) - inter)
            yield batch.select(["a", "b"]).filter(pa.array(good))

    return pairs.join(left, "a").join(right, "b").select("a", "b", "x", "y").mapInArrow(settle, "a long, b long")


def prefix_pairs(sets: DataFrame, roots: DataFrame) -> DataFrame:
    """(a, b): pairs of different roots among ``sets`` (node, shingles) that may reach 0.8; no pair that does is missing.

    Two sets of sizes x and y that reach 0.8 share at least s = ceil(4 (x + y) / 9) shingles. So in any fixed order of shingles, the first one that they
    share is among the first x - s + 1 of the one and the first y - s + 1 of the other; a set alone offers its first x - ceil(0.8 x) + 1. The order is by
    how many of the sets have a shingle, the rarest first. Shingles that one root alone has among its first ones pair nothing.
    """

    def spread(batches):
        for batch in batches:
            for s in range(0, batch.num_rows, 256):
                part = batch.slice(s, 256)
                own = [np.frombuffer(x, np.int64) for x in part.column("shingles").to_pylist()]
                node = np.repeat(part.column("node").to_numpy(), [len(x) for x in own])
                yield pa.RecordBatch.from_arrays([pa.array(node), pa.array(np.concatenate(own))], names=["node", "shingle"])

    rows = sets.select("node", "shingles").mapInArrow(spread, "node long, shingle long")
    often = rows.groupBy("shingle").agg(F.count("*").alias("often"))
    own = Window.partitionBy("node")  # the shingles of one text
    placed = rows.join(often, "shingle").withColumns({"place": F.row_number().over(own.orderBy("often", "shingle")), "n": F.count("*").over(own)})
    first = placed.filter(F.col("place") <= F.col("n") - F.ceil(F.col("n") * 4 / 5) + 1).select("shingle", "node", "n", "place")
    first = stored(first.join(roots, "node"), "prefixes")
    shared = first.groupBy("shingle").agg(F.min("root").alias("x"), F.max("root").alias("y")).filter("x < y").select("shingle")
    first = first.join(shared, "shingle")
    a, b = (first.select("shingle", *[F.col(c).alias(f"{c}_{k}") for c in ("node", "root", "n", "place")]) for k in (1, 2))
    least = F.ceil((F.col("n_1") + F.col("n_2")) * 4 / 9)
    fits = (F.col("root_1") < F.col("root_2")) & (F.col("place_1") <= F.col("n_1") - least + 1) & (F.col("place_2") <= F.col("n_2") - least + 1)
    return a.join(b, "shingle").filter(fits).select(F.greatest("node_1", "node_2").alias("a"), F.least("node_1", "node_2").alias("b")).distinct()


def told_apart(seen: DataFrame) -> DataFrame:
    """node, n, prints, best (order, doc_id and text hash of the first document) of each class of equal sets in ``seen`` (of ``sketches``).

    Different sets of one 64-bit hash differ in size or fingerprints: the second one takes the next number as its node, and so on. (That this is the hash of a third set
    is as likely as such a collision times the share of numbers in use.)
    """
    order = F.struct(F.col("doc_id").isNull(), F.col("doc_id"), F.col("text_hash"))
    classes = seen.groupBy("node", "n", "prints").agg(F.min(order).alias("best"))
    turn = F.row_number().over(Window.partitionBy("node").orderBy("n", "prints"))  # one row but for collisions
    # towards zero, so that nothing overflows
    return classes.withColumn("turn", turn).select(F.when(F.col("node") > 0, F.col("node") - F.col("turn") + 1).otherwise(F.col("node") + F.col("turn") - 1).alias("node"), "n", "prints", "best")


def groups(docs: DataFrame) -> tuple[DataFrame, DataFrame]:
    """(node, best, n, prints of each class of equal shingle sets; node, root of the classes that are linked to others)"""
    seen = stored(sketches(docs), "sketches")
    # what is read no more is deleted as it goes
    classes = stored(told_apart(seen), "classes")
    release(seen)
    pairs = stored(proposed(classes, True), "pairs")
    sets = shingles_of(docs, classes, pairs.select(F.explode(F.array("a", "b")).alias("node")).distinct())
    links = stored(confirmed(sets, pairs.filter("a != b")), "links")
    release(sets)
    known = classes.join(components(links), "node", "left").withColumn("root", F.coalesce("root", "node"))
    dense = pairs.filter("a = b").select(F.col("a").alias("node"), F.lit(True).alias("__dense"))
    # classes that are noted already need not meet each other before step 3: for step 2 they are one part
    part = F.when(F.col("__dense"), F.lit(-(2**63))).otherwise(F.col("root"))
    known = stored(known.join(dense, "node", "left").select("node", "root", "n", "prints", part.alias("part")), "known")
    more = stored(proposed(known, False), "pairs")
    dense = pairs.unionByName(more).filter("a = b").select(F.col("a").alias("node")).distinct()
    sets = shingles_of(docs, classes, more.select(F.explode(F.array("a", "b")).alias("node")).unionByName(dense).distinct())
    left = stored(prefix_pairs(sets.join(dense, "node", "left_semi"), known.select("node", "root")), "pairs")
    return classes, components(links.unionByName(confirmed(sets, more.filter("a != b").unionByName(left).distinct())))


def keep_one(docs: DataFrame) -> DataFrame:
    """One document of each group of near copies, the one with the smallest doc_id (then text hash); all columns."""
    classes, found = groups(docs)
    return first_of(docs, classes.join(found, "node", "left").select(F.coalesce("root", "node").alias("root"), "best"))
