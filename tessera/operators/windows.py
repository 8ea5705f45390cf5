"""Picks, tails, ranks and batches: windows that always end in a unique key."""

from __future__ import annotations

import hashlib
import math
from collections.abc import Sequence
from functools import reduce

import numpy as np
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from ..sources.shared import written


def pick(df: DataFrame, group: Sequence[str], order: Sequence[Column], k: int = 1, rank: str | None = None) -> DataFrame:
    """The first k rows of each group in the order (Spark limits each group before the shuffle already)."""
    name = rank or "_rank"
    out = df.withColumn(name, F.row_number().over(Window.partitionBy(*group).orderBy(*order))).filter(F.col(name) <= k)
    return out if rank else out.drop(name)


def priority(value: Column, first: Sequence[str]) -> Column:
    """0, 1, ... for values in the list, its length for others."""
    return F.when(value.isin(*first), F.array_position(F.array(*map(F.lit, first)), value) - 1).otherwise(len(first)) if first else F.lit(0)


def representative_visit(df: DataFrame, who: str, visit: str, n: str, first: Sequence[str]) -> DataFrame:
    """One visit per participant: the priority list, then most rows, then the name."""
    return pick(df, [who], [priority(F.col(visit), first), F.desc(n), F.col(visit)])


def with_aggregates(df: DataFrame, group: Sequence[str], **aggregates: Column) -> DataFrame:
    """Every row with aggregates of its group (null is a group): one partial aggregation and a join, no window over a group's rows."""
    keys = {g: f"__group_{i}" for i, g in enumerate(group)}
    sums = df.groupBy(*[F.col(g).alias(k) for g, k in keys.items()]).agg(*[c.alias(n) for n, c in aggregates.items()])
    if not group:
        return df.crossJoin(F.broadcast(sums))  # one row
    return df.join(sums, reduce(lambda x, y: x & y, [F.col(g).eqNullSafe(F.col(k)) for g, k in keys.items()])).drop(*keys.values())


def closest_to_mean(df: DataFrame, group: Sequence[str], value: str, tie: Sequence[Column]) -> DataFrame:
    """The row of each group whose value is nearest to the group's mean."""
    return pick(with_aggregates(df, group, _mean=F.avg(value)), group, [F.abs(F.col(value) - F.col("_mean")), *tie]).drop("_mean")


def keep_last(df: DataFrame, keys: Sequence[str], order: Sequence[str]) -> DataFrame:
    return pick(df, keys, [F.desc(o) for o in order])


def portable_hash(seed: object, *parts: Column, bits: int = 32) -> Column:
    """A pseudo-random integer from the MD5 of seed and parts; any SQL engine can recompute it."""
    text = F.concat_ws("|", F.lit(str(seed)), *[p.cast("string") for p in parts])
    return F.conv(F.substring(F.md5(text), 1, bits // 4), 16, 10).cast("bigint")


def hashed_numbers(seed: object, rep: int, numbers: np.ndarray) -> np.ndarray:
    """``portable_hash(seed, rep, number, bits=48)`` of whole numbers from 0, all at once: texts this short are one block of MD5."""
    out = np.empty(len(numbers), np.int64)
    prefix = f"{seed}|{rep}|".encode()
    digits = np.searchsorted(10 ** np.arange(1, 19), numbers, "right") + 1
    if len(prefix) > 36:  # more than one block
        return np.array([int(hashlib.md5(prefix + str(i).encode()).hexdigest()[:12], 16) for i in numbers.tolist()], np.int64)
    for width in np.unique(digits).tolist():
        which = np.flatnonzero(digits == width)
        for part in np.array_split(which, -(-len(which) // 16384)):  # stays in the processor's cache
            text = np.zeros((len(part), 64), np.uint8)
            text[:, : len(prefix)] = np.frombuffer(prefix, np.uint8)
            rest = numbers[part]
            for k in range(len(prefix) + width - 1, len(prefix) - 1, -1):
                rest, last = np.divmod(rest, 10)
                text[:, k] = last + 48
            text[:, len(prefix) + width] = 0x80
            text[:, 56] = 8 * (len(prefix) + width) & 255
            text[:, 57] = 8 * (len(prefix) + width) >> 8
            a, b = _md5_block(np.ascontiguousarray(text.view("<u4").T))
            high, low = a.byteswap().astype(np.int64), b.byteswap().astype(np.int64)
            out[part] = high << 16 | low >> 16
    return out


_MD5_ADD = [int(abs(math.sin(i + 1)) * 2**32) for i in range(64)]
_MD5_TURN = [n for turns in ((7, 12, 17, 22), (5, 9, 14, 20), (4, 11, 16, 23), (6, 10, 15, 21)) for n in turns * 4]


def _md5_block(words: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """The first two of four words of the MD5 of texts of one block (RFC 1321); ``words``: 16 rows of 32 bits."""
    start = [np.uint32(x) for x in (0x67452301, 0xEFCDAB89, 0x98BADCFE, 0x10325476)]
    a, b, c, d = (np.full(words.shape[1], x, np.uint32) for x in start)
    for i in range(64):
        if i < 16:
            f, k = d ^ (b & (c ^ d)), i
        elif i < 32:
            f, k = c ^ (d & (b ^ c)), (5 * i + 1) % 16
        elif i < 48:
            f, k = b ^ c ^ d, (3 * i + 5) % 16
        else:
            f, k = c ^ (b | ~d), 7 * i % 16
        f = f + a
        f += words[k]
        f += np.uint32(_MD5_ADD[i])
        turned = f << np.uint32(_MD5_TURN[i])
        turned |= f >> np.uint32(32 - _MD5_TURN[i])
        turned += b
        a, d, c, b = d, c, b, turned
    return a + start[0], b + start[1]


def seeded_pick(df: DataFrame, group: Sequence[str], key: str, seed: object, k: int = 1) -> DataFrame:
    """k rows of each group in the order of a seeded SHA-256 of the key."""
    return pick(df, group, [F.sha2(F.concat(F.lit(f"{seed}|"), F.col(key).cast("string")), 256), F.col(key)], k)


def hash_order(seed: object, *parts: Column, rows: int) -> tuple[Column, Column]:
    """(48 pseudo-random bits of seed and parts, their first bits: even buckets in the same order, of ``SCAN_ROWS`` of ``rows`` rows or so)"""
    h = portable_hash(seed, *parts, bits=48)
    return h, F.shiftright(h, 48 - max(1, (rows // SCAN_ROWS).bit_length()))


#: Rows that one window holds, on average at most. More rows are cut into ranges of the order.
SCAN_ROWS = 1_000_000


def _ranges(df: DataFrame, part: Sequence[str], order: Sequence[Column]) -> DataFrame | None:
    """The rows with the number of their range (``_range``, ascending in part and order); None where one range is enough."""
    n = df.count()
    if n <= SCAN_ROWS:
        return None
    # ranges come from a sample of the order's own columns: ties are cut apart where the order goes on after them
    return written(df.repartitionByRange(-(-n // SCAN_ROWS), *map(F.col, part), *order).withColumn("_range", F.spark_partition_id()), "ranges")


def scan(df: DataFrame, part: Sequence[str], order: Sequence[Column], number: str | None = None, sums: dict[str, Column] | None = None, least: dict[str, Column] | None = None, buckets: Column | None = None, back: Sequence[Column] = ()) -> DataFrame:
    """Row numbers from 1, running sums, and running minima from a row to the end, per part (null is one) in an order that is unique there.

    The rows are written once. Up to ``SCAN_ROWS`` of them are plain windows. More are cut into ranges of part and order by their count; a window holds
    a range at most, each part and range gives one row of sums, and what the ranges before (or after) hold is added. ``buckets``
    that do not decrease in the order stand for ranges where they are known beforehand (nothing is written then). Minima need ``back``, the order turned round:
    a frame that ends with the last row is read again for each row.
    """
    sums, least = sums or {}, least or {}
    rows = written(df, "scan") if buckets is None else df.withColumn("_range", buckets)
    cut = _ranges(rows, part, order) if buckets is None else rows
    if least and len(back) != len(order):
        raise ValueError("minima to the end need the order turned round")
    first = Window.unboundedPreceding
    inner = Window.partitionBy(*part, *(["_range"] if cut is not None else [])).orderBy(*order)
    turned = Window.partitionBy(*part, *(["_range"] if cut is not None else [])).orderBy(*back) if least else None
    found = {n: F.sum(c).over(inner.rowsBetween(first, 0)) for n, c in sums.items()} | {n: F.min(c).over(turned.rowsBetween(first, 0)) for n, c in least.items()}
    if number:
        found[number] = F.row_number().over(inner).cast("long")
        sums = {**sums, number: F.lit(1)}
    if cut is None:
        return rows.withColumns(found)
    keys = [*part, "_range"]
    names = {k: f"_key_{i}" for i, k in enumerate(keys)}
    outer = Window.partitionBy(*[names[k] for k in part]).orderBy(names["_range"])  # a row for each part and range
    after = Window.partitionBy(*[names[k] for k in part]).orderBy(F.desc(names["_range"]))
    own = cut.groupBy(*[F.col(k).alias(n) for k, n in names.items()]).agg(*[F.sum(c).alias(f"_own_{n}") for n, c in sums.items()], *[F.min(c).alias(f"_own_{n}") for n, c in least.items()])
    own = own.withColumns({f"_own_{n}": F.coalesce(F.sum(f"_own_{n}").over(outer.rowsBetween(first, -1)), F.lit(0)) for n in sums} | {f"_own_{n}": F.min(f"_own_{n}").over(after.rowsBetween(first, -1)) for n in least})
    both = cut.withColumns(found).join(own, reduce(lambda x, y: x & y, [F.col(k).eqNullSafe(F.col(n)) for k, n in names.items()]))
    both = both.withColumns({n: F.col(n) + F.col(f"_own_{n}") for n in sums} | {n: F.least(n, f"_own_{n}") for n in least})
    return both.drop("_range", *names.values(), *[f"_own_{n}" for n in [*sums, *least]])


def ranked(df: DataFrame, part: Sequence[str], order: Sequence[Column], name: str, buckets: Column | None = None) -> DataFrame:
    """Row numbers from 1 in each part."""
    return scan(df, part, order, number=name, buckets=buckets)


def balanced_sample(df: DataFrame, label: str, key: str, seed: object) -> DataFrame:
    """As many rows of each class as the smallest class has, in seeded order."""
    known = df.filter(F.col(label).isNotNull())
    least = known.groupBy(label).count().agg(F.min("count").alias("_least"))
    order, bucket = hash_order(seed, F.col(key), rows=known.count())
    rows = ranked(known, [label], [order, F.col(key)], "_rank", bucket)
    return rows.crossJoin(F.broadcast(least)).filter("_rank <= _least").drop("_rank", "_least")


def group_mean(df: DataFrame, group: Sequence[str], value: str, name: str) -> DataFrame:
    return with_aggregates(df, group, **{name: F.avg(value)})


def numbered(df: DataFrame, column: str, name: str) -> DataFrame:
    """Row numbers from 1 over all rows in the order of a number (unique, or ties in any order)."""
    return ranked(df, [], [F.col(column)], name)


def running(df: DataFrame, part: Sequence[str], value: str, sums: dict[str, Column] | None = None, least: dict[str, Column] | None = None, descending: bool = False) -> DataFrame:
    """Running sums (in the order of ``value``) and running minima from there to the end, per part; values are distinct in a part."""
    up, down = F.asc(value), F.desc(value)
    return scan(df, part, [down if descending else up], sums=sums, least=least, back=[up if descending else down])


def tails(df: DataFrame, value: str, key: str, fraction: float, label: str = "tail") -> DataFrame:
    """The lowest and the highest ceil(fraction * n) rows (half of all at most), ties by key: label bottom or top."""
    if not 0 < fraction <= 0.25:
        raise ValueError("fraction must be in (0, 0.25]")
    rows = df.filter(F.col(value).isNotNull() & ~F.isnan(value) & (F.abs(F.col(value)) < float("inf")))
    n = rows.count()
    if n < 4:
        raise ValueError("at least 4 rows are needed")
    size = min(max(1, -int(-n * fraction // 1)), n // 2)
    placed = ranked(rows, [], [F.col(value), F.col(key)], "_rank")
    return placed.withColumn(label, F.when(F.col("_rank") <= size, "bottom").when(F.col("_rank") > n - size, "top")).filter(F.col(label).isNotNull()).drop("_rank")


def quantile_extremes(df: DataFrame, group: str, value: str, low: float = 0.1, high: float = 0.9) -> DataFrame:
    """Rows at or past their group's low or high quantile, with the thresholds; a row at both is low."""
    from .quantiles import exact

    cuts = exact(df, [group], {"low_cut": (value, low), "high_cut": (value, high)})
    joined = df.join(cuts, group)
    return joined.withColumn("extreme", F.when(F.col(value) <= F.col("low_cut"), "bottom").when(F.col(value) >= F.col("high_cut"), "top")).filter("extreme is not null")


def evenly_spaced(df: DataFrame, group: Sequence[str], order: Sequence[str], k: int) -> DataFrame:
    """Rows at k evenly spaced ranks of each group (all rows of groups with k or fewer); the order is unique in a group."""
    placed = with_aggregates(ranked(df, group, [F.col(c) for c in order], "_r"), group, _n=F.count("*"))
    wanted = F.transform(F.sequence(F.lit(0), F.lit(k - 1)), lambda i: F.rint(i * (F.col("_n") - 1) / F.lit(max(k - 1, 1))).cast("long"))
    return placed.filter((F.col("_n") <= k) | F.array_contains(wanted, F.col("_r") - 1)).drop("_r", "_n")


def average_ranks(df: DataFrame, names: dict[str, str], group: Sequence[str] = (), tied: str | None = None) -> DataFrame:
    """Ranks from 1 with ties sharing their mean, of several columns (column: name of its rank) for rows that have all of them.

    The rows are written once; ranks come from counts per distinct value, so ties and large groups stay cheap. ``tied``: rows with the last column's value.
    """
    rows = written(df.filter(reduce(lambda x, y: x & y, [F.col(v).isNotNull() for v in names])), "ranked")
    out = rows
    for value, name in names.items():
        counts = running(rows.groupBy(*group, value).agg(F.count("*").alias("_t")), group, value, {"_b": F.col("_t")})
        ranks = counts.select(*group, value, (F.col("_b") - (F.col("_t") - 1) / 2).alias(name), *([F.col("_t").alias(tied)] if tied and value == [*names][-1] else []))
        out = out.join(ranks, [*group, value])
    return out


def average_rank(df: DataFrame, value: str, name: str, group: Sequence[str] = ()) -> DataFrame:
    """``average_ranks`` of one column, with n_tied."""
    return average_ranks(df, {value: name}, group, "n_tied")


def running_min_from_end(df: DataFrame, family: Sequence[str], order: str, value: str, name: str) -> DataFrame:
    """The least value from each row to the end of its family, in the order of a number that is unique there."""
    return running(df, family, order, least={name: F.col(value)})


def contiguous(df: DataFrame, group: Sequence[str], start: str, stop: str) -> DataFrame:
    """Per group: intervals, whether the first starts at 0 and each follows the one before, the end reached without a gap.

    Each start is joined to an end in the same place, so there is no window over a group. A group is covered up to the first start other than 0 that is no end, or that
    several intervals have.
    """
    keys = {g: f"_g{i}" for i, g in enumerate(group)}
    starts = df.groupBy(*group, F.col(start).alias("_start")).agg(F.count("*").alias("_n"), F.max(stop).alias("_stop"))
    ends = df.select(*[F.col(g).alias(k) for g, k in keys.items()], F.col(stop).alias("_end")).distinct()
    joined = starts.join(ends, reduce(lambda x, y: x & y, [F.col(g).eqNullSafe(F.col(k)) for g, k in keys.items()], F.col("_start") == F.col("_end")), "left")
    odd = F.when((F.col("_n") > 1) | ((F.col("_start") != 0) & F.col("_end").isNull()), F.col("_start"))
    gaps = with_aggregates(joined.withColumn("_odd", odd).drop(*keys.values()), group, _gap=F.min("_odd"))
    covered = F.max(F.when(F.col("_gap").isNull() | (F.col("_start") < F.col("_gap")), F.col("_stop")))
    return gaps.groupBy(*group).agg(F.sum("_n").alias("n_intervals"), (F.min("_start").eqNullSafe(0) & F.max("_gap").isNull()).alias("contiguous"), F.coalesce(F.when(F.min("_start") == 0, covered), F.lit(0)).alias("covered_to"))


def top_by(df: DataFrame, columns: Sequence[str], n: int, *tie: str) -> DataFrame:
    """The n highest rows by the first column, by the next where it is null."""
    return df.orderBy(F.coalesce(*[F.col(c).cast("double") for c in columns]).desc_nulls_last(), *tie).limit(n)


def report(df: DataFrame, columns: Sequence[str], n: int) -> DataFrame:
    """The first n rows in ascending order of the columns, unknown values last."""
    return df.orderBy(*[F.col(c).asc_nulls_last() for c in columns]).limit(n)


def top_k_jaccard(heads: DataFrame, model: str, position: str, coefficient: str, k: int) -> DataFrame:
    """(model_a, model_b, jaccard) of the k largest |coefficients| of each pair of models."""
    top = pick(heads, [model], [F.desc(F.abs(F.col(coefficient))), F.col(position)], k).select(model, position)
    shared = top.select(F.col(model).alias("model_a"), position).join(top.select(F.col(model).alias("model_b"), position), position).filter("model_a < model_b").groupBy("model_a", "model_b").agg(F.count("*").alias("n_shared"))
    return shared.withColumn("jaccard", F.col("n_shared") / (2 * k - F.col("n_shared")))


def fixed_batches(df: DataFrame, source: Sequence[str], order: Sequence[str], size: int, name: str = "batch_index") -> DataFrame:
    """Batches of ``size`` rows, stable inside each source; the order is unique there."""
    placed = ranked(df, source, [F.col(c) for c in order], name)
    return placed.withColumn(name, F.floor((F.col(name) - 1) / size).cast("long"))


def batch_intervals(total: int, size: int) -> list[tuple[int, int]]:
    if total < 0 or size < 1:
        raise ValueError("total must be 0 or more and size 1 or more")
    return [(a, min(a + size, total)) for a in range(0, total, size)]
