"""Bootstrap and permutation with hashed draws: the same seed gives the same draw on any engine and any partitioning.

Units are numbered in the order of ``hash(seed, "unit", unit)``. A replicate's draw for place i is ``hash(seed, rep, i) mod n``; a permutation deals
the labels, in that order, to the units ordered by ``hash(seed, rep, unit)``. Hashes are even, so numbers come from buckets of
them, sized by a count of the rows, and no window holds a whole group or replicate. Rows are multiplied by the replicates, so reduce to one row per unit first; partial
aggregation shrinks replicates on the map side.

Draws of a bootstrap travel as two bytes each: places of all groups are numbered on from group to group and cut into buckets of ``BUCKET`` of them, tasks pack what they
draw by bucket, and a bucket's rows get the list of replicates that drew them. Rows cross the network once, not once for each replicate.
"""

from __future__ import annotations

from collections.abc import Sequence

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql.types import ArrayType, IntegerType, StructField, StructType

from ..sources.shared import checkpointed, written
from .quantiles import approximate, exact, join_groups, sketch
from .windows import hash_order, hashed_numbers, portable_hash, ranked, running, scan

#: Places of a bucket of draws: an offset takes two bytes.
BUCKET = 1 << 16
#: Replicates whose draws of a bucket meet in one task.
SLICE = 64
#: Draws that a task packs at a time.
PACKED = 4_000_000


def replicates(df: DataFrame, count: int) -> DataFrame:
    """Every row once per replicate (column rep, from 0)."""
    return df.withColumn("rep", F.explode(F.sequence(F.lit(0), F.lit(count - 1))))


def bootstrap_groups(df: DataFrame, group: Sequence[str], unit: str, count: int, seed: object) -> DataFrame:
    """Rows of ``count`` bootstrap replicates: within each group, n draws with replacement of its n rows (one for each ``unit``)."""
    return drawn_rows(df, group, unit, count, seed).withColumn("rep", F.explode("_reps")).drop("_reps")


def drawn_rows(df: DataFrame, group: Sequence[str], unit: str, count: int, seed: object) -> DataFrame:
    """Rows with a list of replicates that drew them (_reps, as often as drawn); a row comes once for each ``SLICE`` replicates."""
    known = df.dropna(subset=list(group)) if group else df
    sizes = known.groupBy(*group).agg(F.count("*").alias("_n"))
    groups = scan(sizes, [], [F.col(g) for g in group], sums={"_upto": F.col("_n")}) if group else sizes.withColumn("_upto", F.col("_n"))
    groups = groups.filter("_n > 0").withColumn("_base", F.col("_upto") - F.col("_n")).drop("_upto")
    total = groups.agg(F.sum("_n")).first()[0] or 0

    starts = groups.select("_base", "_n", F.explode(F.sequence(F.lit(0).cast("long"), F.col("_n") - 1, F.lit(BUCKET).cast("long"))).alias("_start")).repartition(1 + total * count // (2 * PACKED))
    places = starts.select("_base", "_n", F.explode(F.sequence("_start", F.least(F.col("_start") + BUCKET, F.col("_n")) - 1)).alias("_i"))
    draws = places.mapInArrow(_packer(count, seed), "_bucket long, _slice int, sizes binary, offsets binary")

    rows = _numbered(known, group, unit, seed)
    rows = rows.join(groups, list(group)) if group else rows.crossJoin(F.broadcast(groups))
    rows = rows.withColumn("_at", F.col("_base") + F.col("_i")).withColumn("_bucket", F.shiftright("_at", 16))
    rows = rows.select(*df.columns, F.col("_at").bitwiseAND(BUCKET - 1).cast("int").alias("_at"), "_bucket", F.explode(F.sequence(F.lit(0), F.lit((count - 1) // SLICE))).alias("_slice"))
    keys = ["_bucket", "_slice"]
    schema = StructType([*df.schema.fields, StructField("_reps", ArrayType(IntegerType()))])
    return rows.groupBy(*keys).cogroup(draws.groupBy(*keys)).applyInArrow(_dealer(list(df.columns)), schema)


#: (rows of a group, how far in shares the quantile of a replicate may be from that of the group): 12 deviations and more, with a sketch's error.
NEAR = ((4_000_000, 0.004), (100_000, 0.02), (10_000, 0.07), (1_000, 0.2))


def replicate_aggregates(df: DataFrame, group: Sequence[str], unit: str, count: int, seed: object, aggregates: Sequence[Column], name: str, value: Column, share: float) -> DataFrame:
    """(group, rep, aggregates, exact quantile ``name`` of ``value``) of bootstrap replicates.

    A large group's quantile moves little from replicate to replicate. Values near it are kept with their counts, those below are only counted; where that
    doesn't hold the place of every replicate, all values are kept.
    """
    sizes = sketch(df.withColumn("_value", value.cast("double")), group, "_value", "_sketch", 8192)
    cuts = {f"_{side}_{k}": min(max(share + sign * far, 0.0), 1.0) for k, (_, far) in enumerate(NEAR) for side, sign in (("low", -1), ("high", 1))}
    cuts = approximate(sizes, group, cuts, "_sketch")
    n = F.col("n")
    low, high = (F.coalesce(*[F.when(n >= least, F.col(f"_{side}_{k}")) for k, (least, _) in enumerate(NEAR)]) for side in ("low", "high"))
    rows = join_groups(df.withColumn("_value", value.cast("double")), cuts.select(*group, low.alias("_low"), high.alias("_high")), group)
    drawn = written(drawn_rows(rows, group, unit, count, seed), "drawn").withColumn("rep", F.explode("_reps")).drop("_reps")
    v = F.col("_value")
    below = F.coalesce(v < F.col("_low"), F.lit(False))
    near = v.isNotNull() & ~below & F.coalesce(v <= F.col("_high"), F.lit(True))
    facts = written(drawn.groupBy(*group, "rep").agg(*aggregates, F.count(v).alias("_n"), F.count_if(below).alias("_below"), F.count_if(near).alias("_near")), "replicates")
    place = (F.col("_n") - 1) * share
    if not facts.filter((F.col("_n") > 0) & ((F.floor(place) < F.col("_below")) | (F.ceil(place) >= F.col("_below") + F.col("_near")))).isEmpty():
        found = exact(drawn, [*group, "rep"], {name: ("_value", share)})
    else:
        counts = drawn.filter(near).groupBy(*group, "rep", "_value").agg(F.count("*").alias("_c"))
        upto = running(counts, [*group, "rep"], "_value", {"_upto": F.col("_c")})
        placed = join_groups(upto, facts.select(*group, "rep", "_n", "_below"), [*group, "rep"])
        at = F.col("_upto") + F.col("_below")
        lows = placed.groupBy(*group, "rep").agg(F.min(F.when(at > F.floor(place), v)).alias("_lo"), F.min(F.when(at > F.ceil(place), v)).alias("_hi"), F.max(place).alias("_place"))
        p = F.col("_place")
        found = lows.select(*group, "rep", F.when(F.col("_lo") == F.col("_hi"), F.col("_lo")).otherwise((F.ceil(p) - p) * F.col("_lo") + (p - F.floor(p)) * F.col("_hi")).alias(name))
    return facts.drop("_n", "_below", "_near").join(found, [*group, "rep"], "left")


def _packer(count: int, seed: object):
    """Draws of the places of a task, by bucket and slice: for each replicate of the slice how many, and their offsets in the bucket."""

    def packed(rep_draws: list[list[np.ndarray]]):
        for first in range(0, count, SLICE):
            reps = range(first, min(first + SLICE, count))
            by_rep = [np.sort(np.concatenate(rep_draws[r])) for r in reps]
            buckets = np.unique(np.concatenate([np.unique(x >> 16) for x in by_rep]))
            edges = [np.searchsorted(x, np.append(buckets, buckets[-1] + 1) << 16) for x in by_rep]
            by_rep = [(x & (BUCKET - 1)).astype("<u2") for x in by_rep]
            sizes = [np.array([e[k + 1] - e[k] for e in edges], "<u4").tobytes() for k in range(len(buckets))]
            offsets = [b"".join(x[e[k] : e[k + 1]].tobytes() for x, e in zip(by_rep, edges, strict=True)) for k in range(len(buckets))]
            for a in range(0, len(buckets), 256):
                part = slice(a, a + 256)
                yield pa.RecordBatch.from_arrays([pa.array(buckets[part]), pa.array(np.full(len(buckets[part]), first // SLICE, "i4")), pa.array(sizes[part], pa.binary()), pa.array(offsets[part], pa.binary())], ["_bucket", "_slice", "sizes", "offsets"])

    def run(batches):
        held, n = [[] for _ in range(count)], 0
        for batch in batches:
            base, size, i = (batch.column(c).to_numpy() for c in ("_base", "_n", "_i"))
            for rep in range(count):
                held[rep].append(base + hashed_numbers(seed, rep, i) % size)
            n += len(i) * count
            if n >= PACKED:
                yield from packed(held)
                held, n = [[] for _ in range(count)], 0
        if n:
            yield from packed(held)

    return run


def _dealer(columns: list[str]):
    """The rows of a bucket, each with the replicates that drew it."""

    def run(rows: pa.Table, draws: pa.Table) -> pa.Table:
        if not rows.num_rows or not draws.num_rows:
            return rows.select(columns).append_column("_reps", pa.array([[]] * rows.num_rows, pa.list_(pa.int32())))
        first = draws.column("_slice")[0].as_py() * SLICE
        sizes = np.concatenate([np.frombuffer(x, "<u4") for x in draws.column("sizes").to_pylist()])
        width = len(draws.column("sizes")[0].as_py()) // 4
        offsets = np.frombuffer(b"".join(draws.column("offsets").to_pylist()), "<u2")
        reps = np.repeat(np.tile(np.arange(first, first + width, dtype="i4"), draws.num_rows), sizes)
        reps = reps[np.argsort(offsets, kind="stable")]
        upto = np.concatenate([[0], np.cumsum(np.bincount(offsets, minlength=BUCKET))]).astype("i4")
        rows = rows.take(pa.array(np.argsort(rows.column("_at").to_numpy())))  # a bucket's rows have all offsets from the first to the last
        at = rows.column("_at").to_numpy()
        return rows.select(columns).append_column("_reps", pa.ListArray.from_arrays(pa.array(np.append(upto[at], upto[at[-1] + 1])), pa.array(reps)))

    return run


def _numbered(df: DataFrame, group: Sequence[str], unit: str, seed: object) -> DataFrame:
    """Rows with their number _i in the group, from 0, in hashed order of the unit."""
    h, bucket = hash_order(seed, F.lit("unit"), F.col(unit), rows=df.count())
    return ranked(df, group, [h, F.col(unit)], "_i", bucket).withColumn("_i", F.col("_i") - 1)


def bootstrap_limits(df: DataFrame, unit: str, statistic: Column, count: int, seed: object, group: Sequence[str] = (), strata: Sequence[str] = ()) -> DataFrame:
    """Percentile limits of a statistic (an aggregate column) per group; draws are stratified if asked."""
    drawn = bootstrap_groups(df, [*group, *strata], unit, count, seed).groupBy(*group, "rep").agg(statistic.alias("s"))
    return drawn.groupBy(*group).agg(F.percentile("s", F.lit(0.025)).alias("ci_low"), F.percentile("s", F.lit(0.975)).alias("ci_high"), F.avg("s").alias("bootstrap_mean"), F.count("s").alias("n_replicates"))


def bootstrap_p(df: DataFrame, unit: str, value: str, count: int, seed: object) -> DataFrame:
    """Mean, limits and the two-sided bootstrap p of a mean, at least 1/count."""
    limits = bootstrap_groups(df, [], unit, count, seed).groupBy("rep").agg(F.avg(value).alias("s"))
    out = limits.agg(F.percentile("s", F.lit(0.025)).alias("ci_low"), F.percentile("s", F.lit(0.975)).alias("ci_high"), (2 * F.least(F.avg((F.col("s") <= 0).cast("double")), F.avg((F.col("s") >= 0).cast("double")))).alias("p"))
    mean = df.agg(F.count(value).alias("n"), F.avg(value).alias("estimate"))
    return mean.crossJoin(out).withColumn("p_value", F.greatest(F.least("p", F.lit(1.0)), F.lit(1.0 / count))).drop("p")


def _welch(label: str, value: str = "v") -> Column:
    a, b = F.when(F.col(label) == 1, F.col(value)), F.when(F.col(label) == 0, F.col(value))
    return (F.avg(a) - F.avg(b)) / F.nullif(F.sqrt(F.var_samp(a) / F.count(a) + F.var_samp(b) / F.count(b)), F.lit(0.0))


def _difference(label: str, value: str = "v") -> Column:
    return F.avg(F.when(F.col(label) == 1, F.col(value))) - F.avg(F.when(F.col(label) == 0, F.col(value)))


def _long(df: DataFrame, keep: Sequence[str], metrics: Sequence[str]) -> DataFrame:
    cells = F.explode(F.array(*[F.struct(F.lit(m).alias("metric"), F.col(m).cast("double").alias("v")) for m in metrics])).alias("c")
    return df.select(*keep, cells).select(*keep, "c.*").filter("v is not null")


def max_t(observed: DataFrame, permuted: DataFrame, count: int, metric: Sequence[str] = ("metric",)) -> DataFrame:
    """Per metric: statistic, unadjusted and family-wise p ((1 + exceedances) / (count + 1)).

    ``observed`` has t per metric; ``permuted`` has rep and t per metric. Largest |t| per replicate are ``count`` numbers.
    """
    top = permuted.groupBy("rep").agg(F.max(F.abs("t")).alias("top"))
    tops = top.agg(F.sort_array(F.collect_list("top")).alias("tops"))  # one number per replicate
    near = permuted.join(observed.select(*metric, F.abs("t").alias("_t")), list(metric)).groupBy(*metric).agg(F.count_if(F.abs("t") >= F.col("_t") - 1e-12).alias("_own"))
    out = observed.join(near, list(metric), "left").crossJoin(tops)
    family = F.size(F.filter("tops", lambda x: x >= F.abs(F.col("t")) - 1e-12))
    return out.withColumns({"p_unadjusted": (1 + F.coalesce("_own", F.lit(0))) / F.lit(count + 1.0), "p_fwer": (1 + family) / F.lit(count + 1.0)}).drop("tops", "_own")


def _shuffled(df: DataFrame, unit: str, label: str, count: int, seed: object, block: Sequence[str]) -> DataFrame:
    """(rep, unit, label) with labels dealt anew within each block."""
    named = _numbered(df.select(*block, unit, label), block, unit, seed).withColumn("_i", F.col("_i") + 1)
    h, bucket = hash_order(seed, F.col("rep"), F.col(unit), rows=df.count())  # of one replicate
    placed = ranked(replicates(named.select(*block, unit), count), ["rep", *block], [h, F.col(unit)], "_i", bucket)
    return placed.join(named.select(*block, "_i", label), [*block, "_i"]).select("rep", unit, label)


#: Rows of a block that one task deals labels to; with a larger block, places are numbered across tasks.
BLOCK_ROWS = 100_000


def _shuffled_blocks(df: DataFrame, unit: str, label: str, count: int, seed: object, block: Sequence[str]) -> DataFrame:
    """Rows of ``df`` with what ``_shuffled`` deals to them in each replicate (_labels): blocks are dealt to chunks of some ``BLOCK_ROWS`` rows, and
    all replicates of a chunk are settled where it is."""
    h = [F.conv(F.substring(F.md5(F.concat_ws("|", F.lit(str(seed)), first, F.col(unit).cast("string"))), 1, 12), 16, 10).cast("bigint") for first in (F.lit("unit"), *[F.lit(str(r)) for r in range(count)])]
    chunk = F.pmod(F.xxhash64(*block), F.lit(1 + df.count() // BLOCK_ROWS))
    known = df.dropna(subset=list(block)).withColumn("_chunk", chunk)
    schema = StructType([*df.schema.fields, StructField("_labels", ArrayType(df.schema[label].dataType))])
    return known.repartition("_chunk").withColumn("_hashes", F.array(*h)).groupBy("_chunk").applyInArrow(_block_dealer(list(df.columns), list(block), unit, label, count), schema)


def _block_dealer(columns: list[str], block: list[str], unit: str, label: str, count: int):
    def run(rows: pa.Table) -> pa.Table:
        n = rows.num_rows
        order = rows.append_column("_place", pa.array(np.arange(n))).sort_by([*((b, "ascending") for b in block), (unit, "ascending")]).column("_place").to_numpy()
        rows = rows.take(pa.array(order)).combine_chunks()  # blocks one after the other, and units in their order: later sorts keep it
        new = np.zeros(n, bool)
        for b in block:
            codes = rows.column(b).combine_chunks().dictionary_encode().indices.to_numpy()
            new[1:] |= codes[1:] != codes[:-1]
        of = np.cumsum(new)
        hashes = rows.column("_hashes").combine_chunks().flatten().to_numpy().reshape(n, count + 1)
        dealt = np.lexsort((hashes[:, 0], of))  # the k-th label
        got = np.empty((n, count), np.int64)
        for rep in range(count):
            got[np.lexsort((hashes[:, rep + 1], of)), rep] = dealt
        labels = rows.column(label).combine_chunks().take(pa.array(got.ravel()))
        return rows.select(columns).append_column("_labels", pa.ListArray.from_arrays(pa.array(np.arange(n + 1, dtype="i4") * count), labels))

    return run


def permutation_test(df: DataFrame, unit: str, label: str, metrics: Sequence[str], count: int, seed: object, block: Sequence[str] = ()) -> DataFrame:
    """Label permutation (within ``block`` if given) with max |T| control over metrics: difference, t, p_unadjusted, p_fwer."""
    values = _long(df, [unit, *block], metrics)
    own = _long(df, [unit, label], metrics).groupBy("metric").agg(_difference(label).alias("difference"), _welch(label).alias("t"))
    if block and (df.dropna(subset=list(block)).groupBy(*block).count().agg(F.max("count")).first()[0] or 0) <= BLOCK_ROWS:
        cells = F.array(*[F.struct(F.lit(m).alias("metric"), F.col(m).cast("double").alias("v")) for m in metrics])
        dealt = _shuffled_blocks(df.select(*dict.fromkeys([*block, unit, label]), cells.alias("_cells")), unit, label, count, seed, block)
        permuted = dealt.select("_cells", F.posexplode("_labels").alias("rep", label)).select("rep", label, F.explode("_cells").alias("c")).select("rep", label, "c.*").filter("v is not null")
    else:
        permuted = values.join(_shuffled(df.select(unit, label, *block), unit, label, count, seed, block), unit)
    return max_t(own, checkpointed(permuted.groupBy("rep", "metric").agg(_welch(label).alias("t"))), count)  # a row for each replicate and metric, read twice


def sign_flip_test(df: DataFrame, pair: str, metrics: Sequence[str], count: int, seed: object) -> DataFrame:
    """Paired differences (columns ``metrics``) under random signs per pair, with max |T| control."""
    t = F.avg("v") / F.nullif(F.stddev_samp("v") / F.sqrt(F.count("v")), F.lit(0.0))
    values = _long(df, [pair], metrics)
    own = values.groupBy("metric").agg(F.avg("v").alias("difference"), t.alias("t"))
    sign = F.when(F.pmod(portable_hash(seed, F.col("rep"), F.col(pair)), F.lit(2)) == 0, 1.0).otherwise(-1.0)
    flipped = replicates(values, count).withColumn("v", F.col("v") * sign)
    return max_t(own, flipped.groupBy("rep", "metric").agg(t.alias("t")), count)


def patch_test(maps: DataFrame, unit: str, label: str, row: str, col: str, value: str, count: int, seed: object) -> DataFrame:
    """Patchwise comparison of long maps: per cell difference, t, unadjusted, FDR and family-wise p."""
    from .stats import benjamini_hochberg

    cells = maps.select(F.col(unit).alias("unit"), F.col(label).alias("label"), F.col(row).alias("row"), F.col(col).alias("col"), F.col(value).cast("double").alias("v")).filter("v is not null")
    own = cells.groupBy("row", "col").agg(_difference("label").alias("difference"), _welch("label").alias("t"))
    shuffled = _shuffled(cells.select("unit", "label").distinct(), "unit", "label", count, seed, ())
    permuted = checkpointed(cells.select("unit", "row", "col", "v").join(shuffled, "unit").groupBy("rep", "row", "col").agg(_welch("label").alias("t")))  # read three times
    return benjamini_hochberg(max_t(own, permuted, count, ("row", "col")), "p_unadjusted", ["row", "col"], (), "p_fdr")


def set_bootstrap(df: DataFrame, match_set: str, label: str, value: str, count: int, seed: object) -> DataFrame:
    """Limits of the mean within-set difference when whole match sets are drawn."""
    sets = df.groupBy(match_set).agg(_difference(label, value).alias("d")).filter("d is not null")
    return sets.agg(F.count("*").alias("n_sets"), F.avg("d").alias("difference")).crossJoin(bootstrap_limits(sets, match_set, F.avg("d"), count, seed))
