"""Assertions and ledgers: each is one pass, and none collects more than counts."""

from __future__ import annotations

from collections.abc import Mapping, Sequence

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F


class CheckFailed(ValueError):
    """A table breaks a rule that a later step relies on."""


def require_columns(df: DataFrame, columns: Sequence[str], what: str = "table") -> DataFrame:
    if missing := [c for c in columns if c not in df.columns]:
        raise CheckFailed(f"{what} lacks {missing}")
    return df


def duplicate_keys(df: DataFrame, keys: Sequence[str]) -> DataFrame:
    return df.groupBy(*keys).agg(F.count("*").alias("n_rows")).filter("n_rows > 1")


def assert_unique(df: DataFrame, keys: Sequence[str], what: str = "table") -> DataFrame:
    """``df`` if no key repeats."""
    require_columns(df, keys, what)
    if (row := duplicate_keys(df, keys).limit(1).first()) is not None:
        raise CheckFailed(f"{what}: one row per {list(keys)} expected, {row.asDict()} repeats")
    return df


def require_values(df: DataFrame, rules: Mapping[str, Column], what: str = "table") -> DataFrame:
    """``df`` if every rule holds on every row; all rules are counted in one pass."""
    counts = df.agg(*[F.count_if(~F.coalesce(ok, F.lit(False))).alias(name) for name, ok in rules.items()]).first()
    if broken := {k: v for k, v in counts.asDict().items() if v}:
        raise CheckFailed(f"{what}: rows that break a rule: {broken}")
    return df


def input_ledger(df: DataFrame, keys: Sequence[str], valid: Column) -> DataFrame:
    """(metric, value): rows read, invalid ids, exact duplicates, keys with conflicting rows."""
    rows = df.agg(F.count("*").alias("rows_read"), F.count_if(~F.coalesce(valid, F.lit(False))).alias("invalid_ids"))
    good = df.filter(valid)
    # a row's content as one hash, so that both counts come from one aggregation of keys
    content = F.xxhash64(*[F.coalesce(F.col(f"`{c}`").cast("string"), F.lit("\0")) for c in df.columns])
    by_key = good.groupBy(*keys).agg(F.count("*").alias("n"), F.count_distinct(content).alias("kinds"))
    counts = by_key.agg(F.coalesce(F.sum(F.col("n") - F.col("kinds")), F.lit(0)).alias("exact_duplicates"), F.count_if(F.col("kinds") > 1).alias("conflicting_keys"))
    both = rows.crossJoin(counts)  # one row each
    return both.unpivot([], ["rows_read", "invalid_ids", "exact_duplicates", "conflicting_keys"], "metric", "value")


def conflicts(df: DataFrame, keys: Sequence[str]) -> DataFrame:
    """Rows whose key has more than one distinct row."""
    several = df.distinct().groupBy(*keys).agg(F.count("*").alias("kinds")).filter("kinds > 1").select(*keys)
    return df.join(several, list(keys), "left_semi")


def quarantine(df: DataFrame, keys: Sequence[str], path: str) -> DataFrame:
    """Distinct rows of ``df``; conflicting ones go to ``path`` first and then fail the run."""
    bad = conflicts(df, keys)
    if bad.limit(1).count():
        bad.write.mode("overwrite").parquet(path)
        raise CheckFailed(f"conflicting rows for {list(keys)} are in {path}")
    return df.distinct()


def vector_errors(df: DataFrame, vector: str, dim: int, keys: Sequence[str]) -> DataFrame:
    """One row of counts by cause: missing vectors or ids, wrong lengths, non-finite or zero vectors, duplicate keys."""
    v = F.col(vector)
    finite = F.forall(v, lambda x: x.isNotNull() & ~F.isnan(x) & (F.abs(x) < float("inf")))
    norm = F.aggregate(v, F.lit(0.0), lambda a, x: a + x.cast("double") * x)
    missing = F.lit(False)
    for k in keys:
        missing = missing | F.col(k).isNull()
    main = df.agg(
        F.count("*").alias("rows"),
        F.count_if(v.isNull()).alias("missing_vector"),
        F.count_if(F.size(v) != dim).alias("wrong_length"),
        F.count_if(~finite).alias("non_finite"),
        F.count_if(finite & (norm == 0)).alias("zero_norm"),
        F.count_if(missing).alias("missing_key"),
    )
    repeats = duplicate_keys(df, keys).agg(F.count("*").alias("duplicate_keys"))
    return main.crossJoin(repeats)  # one row each


def assert_vectors(df: DataFrame, vector: str, dim: int, keys: Sequence[str]) -> DataFrame:
    row = vector_errors(df, vector, dim, keys).first().asDict()
    if bad := {k: v for k, v in row.items() if k != "rows" and v}:
        raise CheckFailed(f"vectors: {bad}")
    return df


def signature(df: DataFrame, columns: Sequence[str]) -> DataFrame:
    """Row count and an order-free digest of the rows: two folds of 60-bit parts of each row's SHA-256."""
    text = F.concat_ws("|", *[F.coalesce(F.col(c).cast("string"), F.lit("<null>")) for c in columns])
    digest = F.sha2(text, 256)
    part = lambda at: F.conv(F.substring(digest, at, 15), 16, 10).cast("bigint")
    rows = df.select(part(1).alias("a"), part(16).alias("b"))
    return rows.agg(F.count("*").alias("rows"), F.bit_xor("a").alias("fold_a"), F.bit_xor("b").alias("fold_b"))


def invariance(df: DataFrame, keys: Sequence[str], columns: Sequence[str]) -> DataFrame:
    """Keys and, for each column, whether the group has exactly one distinct non-null value."""
    return df.groupBy(*keys).agg(*[(F.count_distinct(c) == 1).alias(f"{c}_invariant") for c in columns])


def accounting(expected: DataFrame, done: DataFrame, failed: DataFrame, keys: Sequence[str]) -> DataFrame:
    """(expected, done, failed, missing, extra, both) counts of distinct keys; exact if the last three are 0."""
    keys = list(keys)
    side = lambda df, name: df.select(*keys).distinct().withColumn(name, F.lit(1))
    joined = side(expected, "e").join(side(done, "d"), keys, "full").join(side(failed, "f"), keys, "full")
    e, d, f = (F.col(c).isNotNull() for c in "edf")
    return joined.agg(F.count_if(e).alias("expected"), F.count_if(d).alias("done"), F.count_if(f).alias("failed"), F.count_if(e & ~d & ~f).alias("missing"), F.count_if(~e).alias("extra"), F.count_if(d & f).alias("both"))


def assert_accounted(expected: DataFrame, done: DataFrame, failed: DataFrame, keys: Sequence[str]) -> None:
    row = accounting(expected, done, failed, keys).first()
    if row.missing or row.extra or row["both"]:
        raise CheckFailed(f"accounting: {row.asDict()}")


def batch_completeness(expected: DataFrame, observed: DataFrame, batch: str, keys: Sequence[str]) -> DataFrame:
    """For each batch: expected and observed keys, missing, unexpected, repeated, complete."""
    keys = [batch, *keys]
    left = expected.select(*keys).distinct().withColumn("e", F.lit(1))
    right = observed.groupBy(*keys).agg(F.count("*").alias("n"))
    joined = left.join(right, keys, "full")
    e, o = F.col("e").isNotNull(), F.col("n").isNotNull()
    out = joined.groupBy(batch).agg(F.count_if(e).alias("expected"), F.count_if(o).alias("observed"), F.count_if(e & ~o).alias("missing"), F.count_if(o & ~e).alias("unexpected"), F.count_if(F.col("n") > 1).alias("repeated"))
    return out.withColumn("complete", (F.col("missing") == 0) & (F.col("unexpected") == 0) & (F.col("repeated") == 0))


def readiness(needed: DataFrame, inventory: DataFrame, name: str, group: str) -> DataFrame:
    """For each group of needed names: how many, how many are there, and the missing ones in order."""
    found = inventory.select(name).distinct().withColumn("_there", F.lit(1))
    joined = needed.join(found, name, "left")
    out = joined.groupBy(group).agg(F.count("*").alias("n_needed"), F.count("_there").alias("n_present"), F.array_join(F.array_sort(F.collect_list(F.when(F.col("_there").isNull(), F.col(name)))), "|").alias("missing"))
    return out.withColumn("ready", F.col("n_needed") == F.col("n_present"))
