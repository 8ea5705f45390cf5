"""Quantiles of groups of any size: exact ones from running counts of distinct values, approximate ones from mergeable sketches.

``exact`` interpolates like the engine's own percentile, whose buffer holds all distinct values of a group. Here they are rows: counts per
group and value, running counts by a prefix scan (``windows.scan``), and for each quantile the least values whose running counts pass the two
places around it. ``sketch`` keeps a KLL sketch per group, some thousand values however many rows there are; sketches of batches merge.
"""

from __future__ import annotations

from collections.abc import Mapping, Sequence
from functools import reduce

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from .windows import running

#: Items that a sketch keeps on its lowest level; the rank error of a quantile is about 2.3 / k (0.6 %) for this one.
SKETCH_K = 400


def join_groups(a: DataFrame, b: DataFrame, group: Sequence[str]) -> DataFrame:
    """Two tables with one row per group (null is one)."""
    if not group:
        return a.crossJoin(F.broadcast(b))  # one row each
    keys = {g: f"__group_{i}" for i, g in enumerate(group)}
    return a.join(b.withColumnsRenamed(keys), reduce(lambda x, y: x & y, [F.col(g).eqNullSafe(F.col(k)) for g, k in keys.items()])).drop(*keys.values())


def exact(df: DataFrame, group: Sequence[str], wanted: Mapping[str, tuple[str | Column, float]]) -> DataFrame:
    """One row per group with a column for each of ``wanted``: {name: (column, share)}. Nulls don't count; a group without values has nulls."""
    values, at = [], {}
    for name, (column, share) in wanted.items():
        if not 0 <= share <= 1:
            raise ValueError(f"{name}: a share from 0 to 1 is asked for, not {share}")
        where = next((i for i, c in enumerate(values) if c is column or (isinstance(c, str) and isinstance(column, str) and c == column)), len(values))
        if where == len(values):
            values.append(column)
        at[name] = (where, share)
    cells = F.explode(F.array(*[F.struct(F.lit(i).alias("_q_of"), (F.col(c) if isinstance(c, str) else c).cast("double").alias("_q_value")) for i, c in enumerate(values)])).alias("_q")
    counts = df.select(*group, cells).select(*group, "_q.*").groupBy(*group, "_q_of", "_q_value").agg(F.count("*").alias("_q_n"))
    part = [*group, "_q_of"]
    # null values come first in the order; they count nothing
    upto = running(counts, part, "_q_value", {"_q_upto": F.when(F.col("_q_value").isNotNull(), F.col("_q_n")).otherwise(0)})
    placed = join_groups(upto, upto.groupBy(*part).agg(F.max("_q_upto").alias("_q_total")), part)
    picked = []
    for name, (where, share) in at.items():
        place = (F.col("_q_total") - 1) * share
        of = (F.col("_q_of") == where) & F.col("_q_value").isNotNull()
        picked += [F.min(F.when(of & (F.col("_q_upto") > f(place)), F.col("_q_value"))).alias(f"{name}{side}") for side, f in (("_lo", F.floor), ("_hi", F.ceil))]
        picked.append(F.max(F.when(of, place)).alias(f"{name}_at"))
    found = placed.groupBy(*group).agg(*picked)

    def between(name: str) -> Column:
        low, high, place = F.col(f"{name}_lo"), F.col(f"{name}_hi"), F.col(f"{name}_at")
        return F.when(low == high, low).otherwise((F.ceil(place) - place) * low + (place - F.floor(place)) * high)

    return found.select(*group, *[between(n).alias(n) for n in wanted])


def with_exact(df: DataFrame, group: Sequence[str], aggregates: Sequence[Column], wanted: Mapping[str, tuple[str | Column, float]]) -> DataFrame:
    """Aggregates of each group beside its exact quantiles."""
    return join_groups(df.groupBy(*group).agg(*aggregates), exact(df, group, wanted), group)


def sketch(df: DataFrame, group: Sequence[str], value: str | Column, name: str = "sketch", k: int = SKETCH_K) -> DataFrame:
    """group and a binary column: the sketch of each group's values. Rows of many batches with equal groups merge by ``merged``."""
    column = (F.col(value) if isinstance(value, str) else value).cast("double")
    return df.groupBy(*group).agg(F.kll_sketch_agg_double(column, k).alias(name))


def merged(sketches: DataFrame, group: Sequence[str], name: str = "sketch", k: int = SKETCH_K) -> DataFrame:
    return sketches.groupBy(*group).agg(F.kll_merge_agg_double(name, k).alias(name))


def approximate(sketches: DataFrame, group: Sequence[str], wanted: Mapping[str, float], name: str = "sketch") -> DataFrame:
    """group, n and the value of a rank near each share: {column: share}; null where a sketch holds nothing."""
    n = F.kll_sketch_get_n_double(name)
    return sketches.select(*group, n.alias("n"), *[F.when(n > 0, F.kll_sketch_get_quantile_double(name, F.lit(float(q)))).alias(c) for c, q in wanted.items()])
