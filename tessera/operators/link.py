"""Joins of the cohort work: validated, classified, banded, nearest."""

from __future__ import annotations

from collections.abc import Sequence
from functools import reduce

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from .checks import CheckFailed, assert_unique

BROADCAST_ROWS = 200_000


def small(df: DataFrame, rows: int = BROADCAST_ROWS) -> DataFrame:
    """``df`` marked for broadcast if a bounded count shows at most ``rows`` rows, else as it is."""
    return F.broadcast(df) if df.limit(rows + 1).count() <= rows else df


def join_validated(left: DataFrame, right: DataFrame, keys: Sequence[str], how: str = "inner", validate: str = "many_to_one") -> DataFrame:
    """A join whose declared sides are unique by ``keys`` (one_to_one, many_to_one, one_to_many), else CheckFailed."""
    if validate not in ("one_to_one", "many_to_one", "one_to_many"):
        raise ValueError(validate)
    if validate != "many_to_one":
        assert_unique(left, keys, "left side")
    if validate != "one_to_many":
        assert_unique(right, keys, "right side")
    return left.join(right, list(keys), how)


def left_with_status(left: DataFrame, right: DataFrame, keys: Sequence[str], value: str, status: str = "link_status") -> DataFrame:
    """Left join; status: matched, value_missing (partner without the value) or no_partner."""
    marked = right.withColumn("_partner", F.lit(True))
    joined = left.join(marked, list(keys), "left")
    return joined.withColumn(status, F.when(F.col("_partner").isNull(), "no_partner").when(F.col(value).isNull(), "value_missing").otherwise("matched")).drop("_partner")


def without(left: DataFrame, right: DataFrame, keys: Sequence[str]) -> DataFrame:
    return left.join(right.select(*keys).distinct(), list(keys), "left_anti")


def within(left: DataFrame, right: DataFrame, keys: Sequence[str]) -> DataFrame:
    return left.join(right.select(*keys).distinct(), list(keys), "left_semi")


def join_on(left: DataFrame, right: DataFrame, pairs: Sequence[tuple[str, str]], how: str = "inner") -> DataFrame:
    """Equality of differently named columns; the right names go."""
    r = right.select(*[F.col(f"`{c}`").alias(f"_r_{c}" if c in [p[1] for p in pairs] else c) for c in right.columns])
    cond = [F.col(a) == F.col(f"_r_{b}") for a, b in pairs]
    return left.join(r, cond, how).drop(*[f"_r_{b}" for _, b in pairs])


def fill_from(left: DataFrame, right: DataFrame, keys: Sequence[str], columns: Sequence[str]) -> DataFrame:
    """Left join that fills nulls of ``columns`` from the partner."""
    linked = right.select(*keys, *[F.col(c).alias(f"_linked_{c}") for c in columns])
    joined = left.join(linked, list(keys), "left")
    return joined.withColumns({c: F.coalesce(F.col(c), F.col(f"_linked_{c}")) for c in columns}).drop(*[f"_linked_{c}" for c in columns])


def refresh(derived: DataFrame, source: DataFrame, key: str, columns: Sequence[str]) -> DataFrame:
    """Source columns replaced by those of ``source``, derived columns kept; one to one by ``key``."""
    return join_validated(derived.drop(*columns), source.select(key, *columns), [key], "left", "one_to_one")


def with_baseline(df: DataFrame, keys: Sequence[str], visit: str, baseline: str, columns: Sequence[str]) -> DataFrame:
    """Baseline values of ``columns`` carried to every visit as baseline_*."""
    base = df.filter(F.col(visit) == baseline).select(*keys, *[F.col(c).alias(f"baseline_{c}") for c in columns])
    return df.join(assert_unique(base, keys, "baseline visit"), list(keys), "left")


#: Pairs that a task of ``band_pairs`` compares, and rows that it reads where there are few pairs.
TASK_PAIRS, TASK_ROWS = 4_000_000, 1_000_000


def band_pairs(left: DataFrame, right: DataFrame, value: tuple[str, str], width: float, exact: Sequence[str] = ()) -> DataFrame:
    """All pairs with equal ``exact`` columns (null never matches) and values within ``width``.

    Values are cut in buckets as wide as the band; the left side visits three buckets, so the join is an
    equi-join whatever the spread of values, and each pair meets in one bucket. Pairs grow with the square of a bucket's rows, so tasks are dealt by pairs, not
    by bytes: rows of each bucket are counted first, and a bucket with too many pairs for a task cuts its left rows in pieces that all see its right rows.
    """
    a, b = value
    if width <= 0:
        raise ValueError("the band must be wider than 0")
    bucket = lambda c: F.floor(F.col(c) / F.lit(float(width)))
    finite = lambda c: F.abs(F.col(c)) < F.lit(float("inf"))  # noqa: E731  (others are in no band)
    l = left.filter(finite(a)).withColumn("_bucket", F.explode(F.array(*[bucket(a) + k for k in (-1, 0, 1)])))
    r = right.filter(finite(b)).withColumn("_bucket", bucket(b))
    keys = [*exact, "_bucket"]
    cells = l.groupBy(*keys).agg(F.count("*").alias("_l")).join(r.groupBy(*keys).agg(F.count("*").alias("_r")), keys)
    cells = cells.withColumn("_pieces", F.ceil(F.col("_l") * F.col("_r") / TASK_PAIRS))
    found = cells.agg(F.sum(F.col("_l") * F.col("_r")).alias("pairs"), F.sum(F.col("_l") + F.col("_r")).alias("rows"), F.max("_pieces").alias("pieces")).first()
    tasks = min(50_000, max(1, -(-int(found.pairs or 0) // TASK_PAIRS), -(-int(found.rows or 0) // TASK_ROWS)))
    if (found.pieces or 0) > 1:
        hot = cells.filter("_pieces > 1").select(*keys, "_pieces")
        plain = [f.name for f in left.schema.fields if "map<" not in f.dataType.simpleString()]  # maps have no hash
        pieces = F.coalesce("_pieces", F.lit(1).cast("long"))
        l = l.join(hot, keys, "left").withColumn("_piece", F.pmod(F.xxhash64(*plain), pieces)).drop("_pieces")
        r = r.join(hot, keys, "left").withColumn("_piece", F.explode(F.sequence(F.lit(0).cast("long"), pieces - 1))).drop("_pieces")
        keys.append("_piece")
    # a number of tasks that is asked for is not cut down to the size of the input
    pairs = l.repartition(tasks, *keys).hint("merge").join(r.repartition(tasks, *keys), keys)
    return pairs.filter(F.abs(F.col(a) - F.col(b)) <= width).drop("_bucket", "_piece")


def nearest_distance(left: DataFrame, right: DataFrame, value: tuple[str, str], keys: Sequence[str] = (), bucket: float | None = None) -> DataFrame:
    """``left`` with nearest_distance to any ``right`` value (equal ``keys``), on either side; null if there is none.

    Both sides are put in one order, once upward and once downward, so that either window runs on from row to row; the last right value of each is the nearest on its side. Without keys the order is global, so values
    are cut in buckets of ``bucket``: within a bucket by window, and across buckets by each bucket's least and greatest value.
    """
    a, b = value
    if bucket is None and not keys:
        raise ValueError("keys or a bucket width are needed, else all rows are one partition")
    part = [*keys]
    l = left.withColumn("_v", F.col(a).cast("double")).withColumn("_r", F.lit(None).cast("double"))
    r = right.filter(reduce(lambda x, y: x & y, [F.col(c).isNotNull() for c in [b, *keys]])).select(*keys, F.col(b).cast("double").alias("_v"), F.col(b).cast("double").alias("_r"))
    both = l.withColumn("_left", F.lit(True)).unionByName(r.withColumn("_left", F.lit(False)), allowMissingColumns=True)
    if bucket is not None:
        both = both.withColumn("_bucket", F.floor(F.col("_v") / bucket))
        part.append("_bucket")
    back = Window.partitionBy(*part).orderBy("_v").rangeBetween(Window.unboundedPreceding, 0)
    ahead = Window.partitionBy(*part).orderBy(F.desc("_v")).rangeBetween(Window.unboundedPreceding, 0)
    both = both.withColumns({"_lo": F.last("_r", True).over(back), "_hi": F.last("_r", True).over(ahead)})
    if bucket is not None:
        # the extreme right values of other buckets: one row per bucket that has any
        ends = r.withColumn("_bucket", F.floor(F.col("_v") / bucket)).groupBy(*part).agg(F.min("_r").alias("_min"), F.max("_r").alias("_max"))
        grid = both.filter("_left").select(*part).distinct().join(ends, part, "full") if keys else both.select("_bucket").distinct().join(ends, part, "left")
        whole = Window.partitionBy(*keys).orderBy("_bucket")
        grid = grid.withColumns({"_before": F.last("_max", True).over(whole.rowsBetween(Window.unboundedPreceding, -1)), "_after": F.last("_min", True).over(Window.partitionBy(*keys).orderBy(F.desc("_bucket")).rowsBetween(Window.unboundedPreceding, -1))})
        both = both.join(grid.select(*part, "_before", "_after"), part, "left").withColumns({"_lo": F.coalesce("_lo", "_before"), "_hi": F.coalesce("_hi", "_after")})
    out = both.filter("_left").withColumn("nearest_distance", F.least(F.col("_v") - F.col("_lo"), F.col("_hi") - F.col("_v")))
    return out.select(*left.columns, "nearest_distance")


def crosswalk(left: DataFrame, bridge: DataFrame, source: str, target: str) -> DataFrame:
    """Left join over a bridge that must be one to one on both of its columns."""
    known = bridge.select(source, target).filter(F.col(source).isNotNull() & F.col(target).isNotNull()).distinct()
    assert_unique(known, [source], "bridge")
    assert_unique(known, [target], "bridge")
    return left.join(known, source, "left")


def stacked(tables: Sequence[DataFrame]) -> DataFrame:
    """Rows of tables with the same columns, in whatever order; other columns are an error."""
    names = {tuple(sorted(t.columns)) for t in tables}
    if len(names) != 1:
        raise CheckFailed(f"tables to stack differ in their columns: {sorted(names)}")
    return reduce(DataFrame.unionByName, tables)


def explode_children(master: DataFrame, children: str, keep: Sequence[str]) -> DataFrame:
    """One row per nested child struct, its fields as columns."""
    return master.select(*keep, F.explode(children).alias("_child")).select(*keep, "_child.*")


def exclusions(reasons: dict[str, DataFrame]) -> DataFrame:
    """Union of exclusion branches with their reason; columns that a branch lacks are null."""
    out = None
    for reason, df in reasons.items():
        part = df.withColumn("exclusion_reason", F.lit(reason))
        out = part if out is None else out.unionByName(part, allowMissingColumns=True)
    return out


def replay_error(parent: DataFrame, child: DataFrame, keys: Sequence[str], parent_score: str, child_score: str) -> DataFrame:
    """n and max_error between each parent's score and the mean of its children's."""
    means = child.groupBy(*keys).agg(F.avg(child_score).alias("_mean"))
    joined = parent.join(means, list(keys))
    return joined.agg(F.count("*").alias("n"), F.max(F.abs(F.col(parent_score) - F.col("_mean"))).alias("max_error"))


def assert_replay(parent: DataFrame, child: DataFrame, keys: Sequence[str], parent_score: str, child_score: str, tolerance: float) -> None:
    row = replay_error(parent, child, keys, parent_score, child_score).first()
    if row.n and row.max_error > tolerance:
        raise CheckFailed(f"scores differ by {row.max_error}")


def eligible(condition: Column) -> Column:
    """Three-valued eligibility as a filter: unknown is not eligible."""
    return F.coalesce(condition, F.lit(False))
