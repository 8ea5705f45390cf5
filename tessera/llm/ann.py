"""Nearest neighbours by cosine with randomly rotated one-bit codes.

A unit vector o is rotated and kept as the signs of its D coordinates (packed bits) and one scalar,
c = <signs / sqrt(D), o>. For a rotated unit query q, <signs / sqrt(D), q> / c estimates <o, q>; its
error stays under ERROR * sqrt((1 - c*c) / (c*c * (D - 1))) but for a tail that shrinks as
exp(-ERROR**2 / 2). The query's coordinates are rounded to ``PLANES`` bits, so the product with the signs is a weighted sum
of the set bits that packed words of the code and of the query's bit planes share; rounding adds ERROR deviations of a
uniform step to the bound. In each block, the best by estimate are scored exactly (cosine in double precision
on the original vectors); vectors whose upper bound reaches the k-th of those scores are reranked, and the best k of all
blocks stay. The rotation is drawn from a seed; nothing is fitted, and every row is coded.

Queries in blocks meet blocks of coded vectors, in a shuffled join: either side is repeated for the parts of the other one, which
no estimate of its size knows of, so neither may be broadcast. Equal vectors are one entry with its k + 1
smallest ids (no answer can use more: a query's own row leaves k), so copies cost no pairs.

Vectors that are null, zero, or hold null or non-finite components take no part, neither do rows
with a null id or of another length than most; repeated (id, vector) rows count once, and rows of
one id with other vectors are rows of their own (a query's own rows are all rows of its id).
With fewer candidates than k, all are returned.
"""

from __future__ import annotations

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

ERROR = 3.0
PLANES = 4
QUERY_BLOCK = 2048
QUERY_GROUP = 64 << 20  # bytes of query vectors that a task holds; entries are sent once to each group of query blocks
QUERIES_AT_ONCE = 64
ENTRY_BLOCK = 8192
ENTRY_PART = 1024  # rows for each part of the entries, at least: every part gets all queries
SEED = 7
RESULT = "query_id long, vec_id long, score double"


def rotation(dim: int) -> np.ndarray:
    """A random orthogonal matrix of the next multiple of 64 dimensions: a code is whole words."""
    size = -(-dim // 64) * 64
    q, r = np.linalg.qr(np.random.default_rng(SEED).standard_normal((size, size)))
    return (q * np.sign(np.diag(r)))[:dim]


def usable(df: DataFrame) -> DataFrame:
    """vec_id, v (array<double>): the rows that take part."""
    v = F.col("embedding").cast("array<double>")
    fine = F.forall("v", lambda x: x.isNotNull() & ~F.isnan(x) & (F.abs(x) < F.lit(float("inf"))))
    rows = df.select(F.col("vec_id").cast("long").alias("vec_id"), v.alias("v")).filter("vec_id is not null and v is not null and size(v) > 0")
    return rows.filter(fine & F.exists("v", lambda x: x != 0))


def _unit(v: np.ndarray) -> np.ndarray:
    top = np.abs(v).max(axis=1, keepdims=True)
    v = v / top
    return v / np.sqrt(np.einsum("ij,ij->i", v, v))[:, None]


def _scaled(v: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """(rows scaled so that squares stay finite, their norms)."""
    v = v / np.abs(v).max(axis=1, keepdims=True)
    return v, np.sqrt(np.einsum("ij,ij->i", v, v))


def _pairs(q: tuple[np.ndarray, np.ndarray], v: tuple[np.ndarray, np.ndarray], i: np.ndarray, j: np.ndarray) -> np.ndarray:
    """Exact scores of (query, entry) pairs of scaled rows, some thousand vectors at a time."""
    out = np.empty(len(i))
    for a in range(0, len(i), 16384):
        x, y = i[a : a + 16384], j[a : a + 16384]
        out[a : a + 16384] = np.einsum("ij,ij->i", q[0][x], v[0][y]) / (q[1][x] * v[1][y])
    return out


def coded_blocks(entries: DataFrame, dim: int) -> DataFrame:
    """Entries (v, ids) as blocks: packed bits, correction scalars, original vectors, ids."""

    def run(batches):
        turn = rotation(dim)
        for batch in batches:
            for a in range(0, batch.num_rows, ENTRY_BLOCK):
                part = batch.slice(a, ENTRY_BLOCK)
                v = part.column("v").flatten().to_numpy(zero_copy_only=False).reshape(-1, dim)
                o = _unit(v) @ turn
                bits = o > 0
                scalar = np.abs(o).sum(axis=1) / np.sqrt(turn.shape[1])
                ids = part.column("ids")
                yield pa.RecordBatch.from_arrays(
                    [pa.array([x], pa.binary()) for x in (np.packbits(bits, axis=1).tobytes(), scalar.astype(np.float32).tobytes(), v.tobytes(), ids.flatten().to_numpy().tobytes(), ids.value_lengths().to_numpy().astype(np.int32).tobytes())],
                    names=["bits", "scalar", "vectors", "ids", "counts"],
                )

    return entries.select("v", "ids").mapInArrow(run, "bits binary, scalar binary, vectors binary, ids binary, counts binary")


def estimates(rotated: np.ndarray, codes: np.ndarray, c: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """(estimated cosines, error bounds) of rotated unit queries and coded entries, from packed words alone."""
    size = rotated.shape[1]
    low = rotated.min(axis=1, keepdims=True)
    step = np.maximum((rotated.max(axis=1, keepdims=True) - low) / (2**PLANES - 1), 1e-12)
    level = np.rint((rotated - low) / step).astype(np.uint8)
    both = np.zeros((len(rotated), len(codes)), np.int32)
    for b in range(PLANES):
        plane = np.packbits(level >> b & 1, axis=1).view(np.uint64)
        for w in range(codes.shape[1]):
            both += np.bitwise_count(plane[:, w, None] & codes[None, :, w]).astype(np.int32) << b
    ones = np.bitwise_count(codes).sum(axis=1, dtype=np.int32)
    # signs are 2 * bit - 1, coordinates are low + step * level
    product = 2 * step * both + 2 * low * ones[None, :] - size * low - step * level.sum(axis=1, dtype=np.int64)[:, None]
    scale = np.sqrt(size) * c.astype(np.float64)
    error = ERROR * np.sqrt(np.maximum(0, 1 - c * c) / (c * c * (size - 1))) + ERROR * step / (np.sqrt(12) * c) + 1e-5
    return product / scale, error


def _search(row: dict, dim: int, k: int, turn: np.ndarray) -> tuple[list, list, list]:
    size = turn.shape[1]
    q = np.frombuffer(row["q_vectors"]).reshape(-1, dim)
    q_ids = np.frombuffer(row["q_ids"], np.int64)
    codes = np.frombuffer(row["bits"], np.uint64).reshape(-1, size // 64)
    c = np.frombuffer(row["scalar"], np.float32)
    v = np.frombuffer(row["vectors"]).reshape(-1, dim)
    counts = np.frombuffer(row["counts"], np.int32)
    ids, begin = np.frombuffer(row["ids"], np.int64), np.cumsum(counts) - counts
    out: tuple[list, list, list] = ([], [], [])
    rotated, exact = _unit(q) @ turn, _scaled(v)
    only = np.where(counts == 1, ids[begin], -1)
    for a in range(0, len(q), QUERIES_AT_ONCE):
        own_ids, asked = q_ids[a : a + QUERIES_AT_ONCE], _scaled(q[a : a + QUERIES_AT_ONCE])
        near, error = estimates(rotated[a : a + QUERIES_AT_ONCE], codes, c)
        # the exact k-th score of the best by estimate is a bar that no answer is under
        first = min(4 * (k + 1), len(v))
        best = np.argpartition(near, len(v) - first, axis=1)[:, len(v) - first :]
        i = np.repeat(np.arange(len(near)), first)
        score = _pairs(asked, exact, i, best.ravel()).reshape(-1, first)
        score[(counts[best] == 1) & (only[best] == own_ids[:, None])] = -np.inf
        bar = np.partition(score, first - k, axis=1)[:, first - k] if first >= k else np.full(len(near), -np.inf)
        i, j = np.nonzero(near + error >= (bar - 1e-9)[:, None])
        score = _pairs(asked, exact, i, j)
        fine = score >= bar[i]
        i, j, score = i[fine], j[fine], score[fine]
        order = np.lexsort((ids[begin[j]], -score, i))
        i, j, score = i[order], j[order], score[order]
        for x in range(len(near)):
            s, e = np.searchsorted(i, [x, x + 1])
            rows = []
            own = own_ids[x]
            # entries of equal score may interleave by id, so all of the k-th score count
            kept, last = 0, None
            for y in range(s, e):
                if kept >= k and score[y] != last:
                    break
                mine = [int(z) for z in ids[begin[j[y]] : begin[j[y]] + counts[j[y]]] if z != own]
                if mine:
                    kept, last = kept + len(mine), score[y]
                    rows += [(-score[y], z) for z in mine]
            for s_, z in sorted(rows)[:k]:
                out[0].append(int(own))
                out[1].append(z)
                out[2].append(float(-s_))
    return out


def search(vectors: DataFrame, queries: DataFrame, k: int = 5) -> DataFrame:
    """query_id, rank, vec_id, score: for each query row the k nearest rows of ``vectors`` with another id."""
    spark = vectors.sparkSession
    rows = usable(vectors)
    dim = rows.groupBy(F.size("v").alias("n")).count().orderBy(F.desc("count"), "n").first()
    if dim is None:
        return spark.createDataFrame([], "query_id long, rank int, vec_id long, score double")
    dim, most = dim["n"], dim["count"]
    rows = rows.filter(F.size("v") == dim).distinct()
    asked = usable(queries).filter(F.size("v") == dim).dropDuplicates(["vec_id", "v"])
    ranked = rows.withColumn("r", F.row_number().over(Window.partitionBy("v").orderBy("vec_id"))).filter(F.col("r") <= k + 1)
    entries = ranked.groupBy("v").agg(F.sort_array(F.collect_list("vec_id")).alias("ids"))
    blocks = coded_blocks(entries, dim)
    n = asked.count()
    q_parts, e_parts = max(1, -(-n // QUERY_BLOCK)), min(int(spark.conf.get("spark.sql.shuffle.partitions")), -(-most // ENTRY_PART))
    together = max(1, QUERY_GROUP // (QUERY_BLOCK * dim * 8))  # query blocks of a group
    groups = -(-q_parts // together)

    def gather_queries(batches):
        for batch in batches:
            for part in sorted(set(batch.column("q_part").to_pylist())):
                own = batch.filter(pc.equal(batch.column("q_part"), part))
                for a in range(0, own.num_rows, QUERY_BLOCK):
                    x = own.slice(a, QUERY_BLOCK)
                    yield pa.RecordBatch.from_arrays([pa.array([part], pa.int32()), pa.array([x.column("vec_id").to_numpy().tobytes()], pa.binary()), pa.array([x.column("v").flatten().to_numpy().tobytes()], pa.binary())], names=["q_part", "q_ids", "q_vectors"])

    # a block of queries is at most QUERY_BLOCK vectors; blocks are dealt to every part of the entries
    packed = asked.withColumn("q_part", F.pmod(F.xxhash64("vec_id"), F.lit(q_parts)).cast("int")).repartition(min(q_parts, int(spark.conf.get("spark.sql.shuffle.partitions"))), "q_part").mapInArrow(gather_queries, "q_part int, q_ids binary, q_vectors binary")
    left = blocks.withColumn("e_part", F.pmod(F.xxhash64("ids"), F.lit(e_parts)).cast("int")).withColumn("q_group", F.explode(F.sequence(F.lit(0), F.lit(groups - 1))))
    right = packed.withColumn("q_group", F.floor(F.col("q_part") / together).cast("int")).drop("q_part").withColumn("e_part", F.explode(F.sequence(F.lit(0), F.lit(e_parts - 1))))

    def run(batches):
        turn = rotation(dim)
        for batch in batches:
            for row in (r for i in range(batch.num_rows) for r in batch.slice(i, 1).to_pylist()):
                a, b, c = _search(row, dim, k, turn)
                yield pa.RecordBatch.from_arrays([pa.array(a, pa.int64()), pa.array(b, pa.int64()), pa.array(c, pa.float64())], names=["query_id", "vec_id", "score"])

    found = left.hint("merge").join(right, ["q_group", "e_part"]).drop("q_group", "e_part").mapInArrow(run, RESULT)
    best = Window.partitionBy("query_id").orderBy(F.desc("score"), "vec_id")
    return found.groupBy("query_id", "vec_id").agg(F.max("score").alias("score")).withColumn("rank", F.row_number().over(best)).filter(F.col("rank") <= k).select("query_id", "rank", "vec_id", "score")
