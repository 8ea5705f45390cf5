"""Summaries: every function is one or two grouped aggregations."""

from __future__ import annotations

from collections.abc import Mapping, Sequence

from pyspark.ml.functions import array_to_vector, vector_to_array
from pyspark.ml.stat import Summarizer
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from .quantiles import with_exact

QUARTILES = {"q1": 0.25, "median": 0.5, "q3": 0.75}


def quartiles(value: str) -> dict[str, tuple[str, float]]:
    return {name: (value, share) for name, share in QUARTILES.items()}


def variable_qc(df: DataFrame, raw: Mapping[str, Column], clean: Mapping[str, Column]) -> DataFrame:
    """One row per variable: n, non-null, recognized missing, unparsed, min, max, mean, sd; one pass over the rows.

    ``raw`` and ``clean`` are the released text and its cleaned number.
    """
    rows = df.select(F.explode(F.array(*[F.struct(F.lit(v).alias("variable"), raw[v].cast("string").alias("raw"), clean[v].cast("double").alias("value"), F.coalesce(coded, F.lit(False)).alias("coded")) for v, coded in _coded(raw).items()])).alias("x")).select("x.*")
    value = F.col("value")
    return rows.groupBy("variable").agg(
        F.count("*").alias("n_rows"),
        F.count("value").alias("n_nonnull"),
        F.count_if(F.col("coded")).alias("n_recognized_missing"),
        F.count_if(F.col("raw").isNotNull() & ~F.col("coded") & value.isNull()).alias("n_unparsed"),
        F.min(value).alias("min"),
        F.max(value).alias("max"),
        F.avg(value).alias("mean"),
        F.stddev_samp(value).alias("sd"),
    )


def _coded(raw: Mapping[str, Column]) -> dict[str, Column]:
    from ..functions.clean import NUMERIC_MISSING, SENTINELS

    return {v: F.regexp_replace(F.trim(c.cast("string")), r"\.0$", "").isin(*SENTINELS, *NUMERIC_MISSING) for v, c in raw.items()}


def pivot_first(df: DataFrame, keys: Sequence[str], pivot: str, levels: Sequence[str], values: Sequence[str], order: str) -> DataFrame:
    """For each key and level the first non-null value by ``order`` (a defined order, not arrival)."""
    cells = [F.min_by(v, F.when(F.col(v).isNotNull() & (F.col(pivot) == level), F.col(order))).alias(f"{v}_{level}") for level in levels for v in values]
    return df.groupBy(*keys).agg(*cells)


def nest(df: DataFrame, keys: Sequence[str], fields: Sequence[str], sets: Sequence[str] = ()) -> DataFrame:
    """Children of each key: count, ordered list of structs, ordered sets."""
    return df.groupBy(*keys).agg(F.count("*").alias("n_children"), F.array_sort(F.collect_list(F.struct(*fields))).alias("children"), *[F.array_sort(F.collect_set(s)).alias(f"{s}_set") for s in sets])


def release_summary(members: DataFrame, release: str, kind: str, size: tuple[str, str], who: str, eye: str) -> DataFrame:
    """Per release: members, bytes, expansion ratio, images, people, people seen with both eyes."""
    stored, raw = size
    first = members.groupBy(release).agg(F.count("*").alias("n_members"), F.sum(raw).alias("bytes"), F.sum(stored).alias("stored_bytes"), F.count_if(F.col(kind) == "fundus_image").alias("n_images"))
    pairs = members.filter(F.col(who).isNotNull()).groupBy(release, who).agg(F.count_distinct(eye).alias("eyes"))
    second = pairs.groupBy(release).agg(F.count("*").alias("n_people"), F.count_if(F.col("eyes") >= 2).alias("n_complete_pairs"))
    return first.join(second, release, "left").withColumn("expansion", F.col("bytes") / F.col("stored_bytes")).fillna(0, ["n_people", "n_complete_pairs"])


def pool_vectors(df: DataFrame, keys: Sequence[str], vector: str, *more: Column) -> DataFrame:
    """Elementwise mean vector and n per key; the state of a group is one vector, however many rows it has."""
    v = array_to_vector(F.col(vector).cast("array<double>"))
    pooled = df.groupBy(*keys).agg(Summarizer.mean(v).alias("_m"), F.count("*").alias("n_vectors"), *more)
    return pooled.withColumn(vector, vector_to_array("_m")).drop("_m")


def vector_parts(df: DataFrame, keys: Sequence[str], vector: str) -> DataFrame:
    """Mergeable partial pools: sum vector and count (of one batch)."""
    v = array_to_vector(F.col(vector).cast("array<double>"))
    return df.groupBy(*keys).agg(vector_to_array(Summarizer.sum(v)).alias("vector_sum"), F.count("*").alias("n_vectors"))


def merge_parts(parts: DataFrame, keys: Sequence[str], vector: str) -> DataFrame:
    """Mean vectors from partial pools of many batches."""
    total = parts.groupBy(*keys).agg(vector_to_array(Summarizer.sum(array_to_vector("vector_sum"))).alias("_s"), F.sum("n_vectors").alias("n_vectors"))
    return total.withColumn(vector, F.transform("_s", lambda x: x / F.col("n_vectors"))).drop("_s")


def pool_participants(df: DataFrame, keys: Sequence[str], age: str, prediction: str, modes: Sequence[str] = ()) -> DataFrame:
    """Median age, mean prediction, n, range of predictions and stable modes per key."""
    return df.groupBy(*keys).agg(
        F.percentile(age, F.lit(0.5)).alias("age"),
        F.avg(prediction).alias("prediction"),
        F.count("*").alias("n_rows"),
        (F.max(prediction) - F.min(prediction)).alias("prediction_range"),
        *[F.mode(m, True).alias(m) for m in modes],
    )


def rollup_predictions(df: DataFrame, keys: Sequence[str], prediction: str) -> DataFrame:
    p = F.col(prediction)
    return df.groupBy(*keys).agg(F.count("*").alias("n"), F.avg(p).alias("mean"), F.percentile(p, F.lit(0.5)).alias("median"), F.min(p).alias("min"), F.max(p).alias("max"), (F.max(p) - F.min(p)).alias("range"))


def stratified(df: DataFrame, value: str, stratifiers: Sequence[str]) -> DataFrame:
    """One row per stratifier and level: n, mean, sd, q1, median, q3, status.

    Each row is sent once per stratifier (grouping sets of single columns). A stratifier that is no column, or has no
    observed record, keeps one row with its status.
    """
    there = [s for s in stratifiers if s in df.columns]
    levels = F.explode(F.array(*[F.struct(F.lit(s).alias("stratifier"), F.col(s).cast("string").alias("level")) for s in there])) if there else None
    named = df.sparkSession.createDataFrame([(s, s in df.columns) for s in stratifiers], "stratifier string, here boolean")
    if levels is None:
        found = df.sparkSession.createDataFrame([], "stratifier string, level string, n long, mean double, sd double, q1 double, median double, q3 double")
    else:
        rows = df.filter(F.col(value).isNotNull()).select(F.col(value).cast("double").alias("_v"), levels.alias("x")).select("_v", "x.*").filter("level is not null")
        found = with_exact(rows, ["stratifier", "level"], [F.count("*").alias("n"), F.avg("_v").alias("mean"), F.stddev_samp("_v").alias("sd")], quartiles("_v"))
    joined = named.join(found, "stratifier", "left")
    status = F.when(~F.col("here"), "column_missing").when(F.col("n").isNull(), "no_observed_records").otherwise("ok")
    return joined.withColumn("status", status).withColumn("n", F.coalesce("n", F.lit(0))).drop("here")


def describe_groups(df: DataFrame, group: str, continuous: Sequence[str], categorical: Sequence[str]) -> DataFrame:
    """Long table (group, variable, level, n, fraction, mean, sd, median, q1, q3); fraction is of observed values."""
    rows = df.select(group, F.explode(F.array(*[F.struct(F.lit(c).alias("variable"), F.col(c).cast("double").alias("v")) for c in continuous])).alias("x")).select(group, "x.*").filter("v is not null")
    first = with_exact(rows, [group, "variable"], [F.count("*").alias("n"), F.avg("v").alias("mean"), F.stddev_samp("v").alias("sd")], quartiles("v")).withColumns({"level": F.lit(None).cast("string"), "fraction": F.lit(None).cast("double")})
    rows = df.select(group, F.explode(F.array(*[F.struct(F.lit(c).alias("variable"), F.col(c).cast("string").alias("level")) for c in categorical])).alias("x")).select(group, "x.*").filter("level is not null")
    counts = rows.groupBy(group, "variable", "level").agg(F.count("*").alias("n"))
    second = counts.withColumn("fraction", F.col("n") / F.sum("n").over(Window.partitionBy(group, "variable")))
    return first.unionByName(second, allowMissingColumns=True)


def missingness(df: DataFrame, group: str, variables: Sequence[str]) -> DataFrame:
    rows = df.select(group, F.explode(F.array(*[F.struct(F.lit(v).alias("variable"), F.col(v).isNull().alias("gone")) for v in variables])).alias("x")).select(group, "x.*")
    out = rows.groupBy(group, "variable").agg(F.count("*").alias("n"), F.count_if("gone").alias("n_missing"))
    return out.withColumn("fraction_missing", F.col("n_missing") / F.col("n"))


def contingency(df: DataFrame, a: str, b: str) -> DataFrame:
    return df.filter(F.col(a).isNotNull() & F.col(b).isNotNull()).groupBy(a, b).agg(F.count("*").alias("n"))


def cohort_flow(df: DataFrame, stages: Mapping[str, Column], who: str) -> DataFrame:
    """(stage_index, stage, n_rows, n_people) where each stage also holds all earlier ones; one pass."""
    held, cells, keep = F.lit(True), [], []
    for i, (name, condition) in enumerate(stages.items()):
        held = held & F.coalesce(condition, F.lit(False))
        cells += [F.count_if(held).alias(f"r{i}"), F.count_distinct(F.when(held, F.col(who))).alias(f"p{i}")]
        keep.append((i, name))
    row = df.agg(*cells)
    structs = [F.struct(F.lit(i).alias("stage_index"), F.lit(name).alias("stage"), F.col(f"r{i}").alias("n_rows"), F.col(f"p{i}").alias("n_people")) for i, name in keep]
    return row.select(F.explode(F.array(*structs)).alias("x")).select("x.*")


def suppress_small(counts: DataFrame, group: str, n: str, least: int) -> DataFrame:
    """Groups under ``least`` folded into ``suppressed``; a folded row is reportable if it is large enough itself."""
    folded = counts.withColumn(group, F.when(F.col(n) < least, "suppressed").otherwise(F.col(group).cast("string")))
    return folded.groupBy(group).agg(F.sum(n).alias(n), F.count("*").alias("n_groups")).withColumn("reportable", F.col(n) >= least)


def missing_code_map(categories: DataFrame, variable: str, code: str, label: str, missing: str) -> DataFrame:
    return categories.filter(F.trim(F.col(missing).cast("string")).isin("1", "1.0")).select(variable, code, label).distinct()


def vector_shift(df: DataFrame, domain: str, vector: str) -> DataFrame:
    """Feature-wise shift of two domains (0 and 1): median and p90 of |SMD|, counts past 0.1, 0.2 and 0.5, cosine of centroids."""
    v = array_to_vector(F.col(vector).cast("array<double>"))
    s = Summarizer.metrics("mean", "variance").summary(v)
    sides = df.groupBy(domain).agg(s.alias("s")).select(domain, vector_to_array("s.mean").alias("m"), vector_to_array("s.variance").alias("v"))
    pair = sides.filter(F.col(domain) == 0).select(F.col("m").alias("m0"), F.col("v").alias("v0")).crossJoin(sides.filter(F.col(domain) == 1).select(F.col("m").alias("m1"), F.col("v").alias("v1")))
    each = pair.select("m0", "m1", F.posexplode(F.arrays_zip("m0", "m1", "v0", "v1")).alias("k", "x"))
    smd = F.abs((F.col("x.m1") - F.col("x.m0")) / F.nullif(F.sqrt((F.col("x.v0") + F.col("x.v1")) / 2), F.lit(0.0)))
    dot = lambda a, b: F.aggregate(F.zip_with(a, b, lambda x, y: x * y), F.lit(0.0), lambda s, x: s + x)
    cosine = pair.select((dot("m0", "m1") / F.sqrt(dot("m0", "m0") * dot("m1", "m1"))).alias("centroid_cosine"))
    table = each.withColumn("smd", smd).agg(F.count("*").alias("n_features"), F.percentile("smd", F.lit(0.5)).alias("median_abs_smd"), F.percentile("smd", F.lit(0.9)).alias("p90_abs_smd"), *[F.count_if(F.col("smd") > t).alias(f"n_above_{str(t).replace('.', '_')}") for t in (0.1, 0.2, 0.5)])
    return table.crossJoin(cosine)  # one row each


def overlap(a: DataFrame, b: DataFrame, key: str) -> DataFrame:
    """Sizes, intersection, union and Jaccard index of two member sets."""
    joined = a.select(key).distinct().withColumn("a", F.lit(1)).join(b.select(key).distinct().withColumn("b", F.lit(1)), key, "full")
    out = joined.agg(F.count("a").alias("n_a"), F.count("b").alias("n_b"), F.count_if(F.col("a").isNotNull() & F.col("b").isNotNull()).alias("n_both"), F.count("*").alias("n_union"))
    return out.withColumn("jaccard", F.col("n_both") / F.col("n_union"))


def assignment_agreement(a: DataFrame, b: DataFrame, key: str, label: str) -> DataFrame:
    """Members of both with equal and different labels, and the share that agrees."""
    joined = a.select(key, F.col(label).alias("la")).join(b.select(key, F.col(label).alias("lb")), key)
    out = joined.agg(F.count("*").alias("n_both"), F.count_if(F.col("la").eqNullSafe(F.col("lb"))).alias("n_agree"))
    return out.withColumn("agreement", F.col("n_agree") / F.col("n_both"))
