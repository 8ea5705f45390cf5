"""Linear heads on vectors: folds, ridge, logistic, calibration, harmonization. Heads are small rows; data stays in Spark."""

from __future__ import annotations

from collections.abc import Sequence

import numpy as np
from pyspark.ml.classification import LogisticRegression
from pyspark.ml.feature import StandardScaler
from pyspark.ml.functions import array_to_vector, vector_to_array
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from ..sources.shared import written
from .checks import CheckFailed, assert_unique
from .quantiles import exact
from .stats import discrimination
from .windows import balanced_sample, hash_order, portable_hash, ranked

#: Levels that a categorical feature may have; more are an identifier.
MAX_LEVELS = 200

# folds


def folds(df: DataFrame, group: str, k: int, seed: object, stratum: str | None = None) -> DataFrame:
    """fold 0 .. k-1 per row: whole groups, dealt in hashed order within each stratum (a group's least label)."""
    units = df.groupBy(group).agg((F.min(stratum) if stratum else F.lit(0)).alias("_s"))
    h, bucket = hash_order(seed, F.col(group), rows=units.count())
    dealt = ranked(units, ["_s"], [h, F.col(group)], "_r", bucket).select(group, ((F.col("_r") - 1) % k).cast("int").alias("fold"))
    return df.join(dealt, group)


def assert_no_leak(df: DataFrame, group: str, fold: str = "fold") -> DataFrame:
    if df.groupBy(group).agg(F.count_distinct(fold).alias("n")).filter("n > 1").limit(1).count():
        raise CheckFailed(f"a {group} is in several folds")
    return df


# Gram matrices of vectors


def same_length(vector: str, dim: int) -> Column:
    """The vector as doubles; one of another length fails the job, null stays null."""
    v = F.transform(F.col(vector), lambda x: x.cast("double"))
    return F.when(F.size(vector) == dim, v).when(F.col(vector).isNotNull(), F.raise_error(F.concat(F.lit(f"{vector}: {dim} elements expected, there are "), F.size(vector).cast("string"))).cast("array<double>"))


def vector_gram(df: DataFrame, vector: str, target: str, by: Sequence[str], dim: int, block: int = 256) -> dict:
    """{key: (n, gram)} with gram over [vector, 1, target]; one pass, partial sums per task and key.

    Each task adds outer products of blocks of rows and sends one (d + 2) squared matrix per key; those are summed by Spark.
    """
    import pyarrow as pa

    size = dim + 2

    def partial(batches):
        sums: dict[tuple, list] = {}
        for batch in batches:
            v = batch.column("_v").flatten().to_numpy(zero_copy_only=False).reshape(-1, dim)
            y = batch.column("_t").to_numpy(zero_copy_only=False)
            keys = list(zip(*[batch.column(b).to_pylist() for b in by], strict=True)) if by else [()] * len(y)
            x = np.column_stack([v, np.ones(len(y)), y])
            for key in set(keys):
                own = x[[k == key for k in keys]]
                entry = sums.setdefault(key, [0, np.zeros((size, size))])
                entry[0] += len(own)
                entry[1] += own.T @ own
        for key, (n, g) in sums.items():
            yield pa.RecordBatch.from_arrays([*[pa.array([k]).cast(types[b]) for k, b in zip(key, by, strict=True)], pa.array([n], pa.int64()), pa.array([g.ravel().tolist()], pa.list_(pa.float64()))], names=[*by, "n", "g"])

    from pyspark.sql.pandas.types import to_arrow_type

    rows = df.select(*by, same_length(vector, dim).alias("_v"), F.col(target).cast("double").alias("_t")).filter(F.col("_t").isNotNull() & F.col("_v").isNotNull())
    types = {b: to_arrow_type(df.schema[b].dataType) for b in by}
    schema = ", ".join([*(f"{b} {df.schema[b].dataType.simpleString()}" for b in by), "n long, g array<double>"])
    parts = rows.mapInArrow(partial, schema)
    from pyspark.ml.stat import Summarizer

    total = parts.groupBy(*by).agg(F.sum("n").alias("n"), vector_to_array(Summarizer.sum(array_to_vector("g"))).alias("g"))
    return {tuple(r[b] for b in by): (r.n, np.array(r.g).reshape(size, size)) for r in total.collect()}  # one matrix per key


def _ridge(n: int, g: np.ndarray, alpha: float) -> tuple[np.ndarray, float]:
    """Coefficients and unpenalized intercept from a Gram matrix over [x, 1, y]."""
    d = len(g) - 2
    mean, my = g[:d, d] / n, g[d + 1, d] / n
    sxx = g[:d, :d] - n * np.outer(mean, mean)
    sxy = g[:d, d + 1] - n * mean * my
    beta = np.linalg.solve(sxx + alpha * np.eye(d), sxy)
    return beta, float(my - mean @ beta)


def heads_frame(spark, heads: list[tuple]) -> DataFrame:
    """(model, fold, coef, intercept)"""
    return spark.createDataFrame([(m, f, [float(x) for x in b], float(c)) for m, f, b, c in heads], "model string, fold int, coef array<double>, intercept double")


def dot(a: Column, b: Column) -> Column:
    return F.aggregate(F.zip_with(a, b, lambda x, y: x.cast("double") * y), F.lit(0.0), lambda s, x: s + x)


def apply_head(df: DataFrame, head: DataFrame, vector: str, name: str = "prediction") -> DataFrame:
    """Scores by a one-row head; a vector of another length is an error."""
    one = F.broadcast(head.select("coef", "intercept"))  # one row
    checked = F.when(F.size(vector) == F.size("coef"), dot(F.col(vector), F.col("coef")) + F.col("intercept")).otherwise(F.raise_error(F.lit("vector and head differ in length")).cast("double"))
    return df.crossJoin(one).withColumn(name, checked).drop("coef", "intercept")


def with_gap(df: DataFrame, age: str, prediction: str) -> DataFrame:
    return df.withColumns({"gap": F.col(prediction) - F.col(age), "absolute_error": F.abs(F.col(prediction) - F.col(age))})


def ridge_oof(df: DataFrame, vector: str, target: str, fold: str, dim: int, alpha: float = 10.0) -> tuple[DataFrame, DataFrame]:
    """(rows with out-of-fold prediction, heads: one per fold and the final one with fold -1); one pass for all folds."""
    grams = vector_gram(df, vector, target, [fold], dim)
    n, g = sum(x[0] for x in grams.values()), sum(x[1] for x in grams.values())
    heads = [("ridge", int(k[0]), *_ridge(n - m, g - h, alpha)) for k, (m, h) in sorted(grams.items())]
    heads.append(("ridge", -1, *_ridge(n, g, alpha)))
    table = heads_frame(df.sparkSession, heads)
    scored = df.join(F.broadcast(table.filter("fold >= 0").select(F.col("fold").alias(fold), "coef", "intercept")), fold)  # one row per fold
    return scored.withColumn("prediction", dot(F.col(vector), F.col("coef")) + F.col("intercept")).drop("coef", "intercept"), table


# calibration


def calibration(df: DataFrame, truth: str, prediction: str, group: Sequence[str] = (), shrink: float = 0.5, floor: float = 0.2) -> DataFrame:
    """mean_y, mean_prediction, slope and shrunk_slope (towards 1, kept off 0) per group."""
    rows = df.filter(F.col(truth).isNotNull() & F.col(prediction).isNotNull())
    out = rows.groupBy(*group).agg(F.count("*").alias("n"), F.avg(truth).alias("mean_y"), F.avg(prediction).alias("mean_prediction"), F.regr_slope(F.col(prediction), F.col(truth)).alias("slope"))
    s = (1 - shrink) * F.col("slope") + shrink
    sign = F.when(s < 0, -1.0).otherwise(1.0)
    return out.withColumn("shrunk_slope", F.when(s.isNull() | F.isnan(s), 1.0).when(F.abs(s) < floor, sign * floor).otherwise(s))


def calibrated(prediction: Column, mode: str) -> Column:
    """A prediction by the calibration columns beside it."""
    if mode == "none":
        return prediction
    if mode == "intercept":
        return prediction + (F.col("mean_y") - F.col("mean_prediction"))
    if mode == "shrunk_slope":
        return F.col("mean_y") + (prediction - F.col("mean_prediction")) / F.col("shrunk_slope")
    raise ValueError(mode)


def fold_in(head: DataFrame, fit: DataFrame, mode: str) -> DataFrame:
    """A head whose plain scores are the calibrated ones of the head before."""
    both = head.crossJoin(F.broadcast(fit))  # one row
    if mode == "shrunk_slope":
        both = both.withColumn("coef", F.transform("coef", lambda c: c / F.col("shrunk_slope")))
    return both.withColumn("intercept", calibrated(F.col("intercept"), mode)).select(*head.columns)


# logistic heads


def _fit_logistic(train: DataFrame, vector: str, label: str, c: float, balanced: bool):
    counts = {r[label]: r["count"] for r in train.groupBy(label).count().collect()}
    n = sum(counts.values())
    if len(counts) < 2:
        raise CheckFailed("a classifier needs both classes")
    weight = F.lit(1.0)
    if balanced:
        weight = F.when(F.col(label) == 1, n / (2 * counts[1])).otherwise(n / (2 * counts[0]))
    rows = train.select(array_to_vector(F.col(vector).cast("array<double>")).alias("x"), F.col(label).cast("double").alias("y"), weight.alias("w"))
    scaler = StandardScaler(withMean=True, withStd=True, inputCol="x", outputCol="z").fit(rows)
    model = LogisticRegression(featuresCol="z", labelCol="y", weightCol="w", regParam=1 / (c * n), elasticNetParam=0.0, standardization=False, maxIter=200, tol=1e-9).fit(scaler.transform(rows))
    sd = np.where(scaler.std.toArray() > 0, scaler.std.toArray(), 1.0)
    beta = model.coefficients.toArray() / sd
    return beta, float(model.intercept - beta @ scaler.mean.toArray())


def sigmoid(x: Column) -> Column:
    return 1 / (1 + F.exp(-x))


def logistic_oof(df: DataFrame, vector: str, label: str, fold: str, grid: Sequence[float] = (0.01, 0.1, 1.0), inner: int = 3, group: str | None = None, seed: object = 0, balanced: bool = True) -> tuple[DataFrame, DataFrame]:
    """Nested cross-validation: (rows with out-of-fold probability, heads with the C chosen per fold and a final head, fold -1, by vote).

    Inner folds choose C by AUROC, ties go to the smaller C; the loop is over folds and C values, never over rows.
    """
    who = group or fold
    rows = df.persist()
    try:
        labels = sorted(r[fold] for r in rows.select(fold).distinct().collect())
        heads, chosen = [], []
        for k in labels:
            train = rows.filter(F.col(fold) != k)
            best = grid[0]
            if len(grid) > 1:
                parts = folds(train.withColumnRenamed(fold, "_outer"), "_outer" if who == fold else who, inner, seed, label).withColumnRenamed("fold", "_inner")
                parts = parts.persist()
                scores = []
                for c in grid:
                    tested = None
                    for j in range(inner):
                        b, a = _fit_logistic(parts.filter(F.col("_inner") != j), vector, label, c, balanced)
                        part = apply_head(parts.filter(F.col("_inner") == j), heads_frame(df.sparkSession, [("x", j, b, a)]), vector, "_s").select(label, "_s")
                        tested = part if tested is None else tested.unionByName(part)
                    scores.append((-(discrimination(tested, label, "_s").first().auroc or 0.0), c))
                parts.unpersist()
                best = min((round(s, 12), c) for s, c in scores)[1]
            chosen.append(best)
            heads.append((f"logistic C={best:g}", int(k), *_fit_logistic(train, vector, label, best, balanced)))
        final = min(set(chosen), key=lambda c: (-chosen.count(c), c))  # most votes, then the smaller
        heads.append((f"logistic C={final:g}", -1, *_fit_logistic(rows, vector, label, final, balanced)))
    finally:
        rows.unpersist()
    table = heads_frame(df.sparkSession, heads)
    scored = df.join(F.broadcast(table.filter("fold >= 0").select(F.col("fold").alias(fold), "coef", "intercept")), fold)  # one row per fold
    return scored.withColumn("probability", sigmoid(dot(F.col(vector), F.col("coef")) + F.col("intercept"))).drop("coef", "intercept"), table


def domain_auc(df: DataFrame, vector: str, domain: str, group: str, k: int = 5, seed: object = 0, grid: Sequence[float] = (0.1,)) -> float:
    """How well a linear head tells two domains apart, whatever the direction."""
    dealt = folds(df, group, k, seed, domain)
    scored, _ = logistic_oof(dealt, vector, domain, "fold", grid, group=group, seed=seed)
    auc = discrimination(scored, domain, "probability").first().auroc
    return max(auc, 1 - auc)


def one_hot(df: DataFrame, columns: Sequence[str], numeric: Sequence[str], name: str = "features") -> DataFrame:
    """An array of dummies (levels in order, unknown a level) and median-filled numbers, for shortcut baselines."""
    facts = {}
    for c in columns:
        found = df.select(F.coalesce(F.col(c).cast("string"), F.lit("MISSING")).alias("level")).distinct().limit(MAX_LEVELS + 1).collect()
        if len(found) > MAX_LEVELS:
            raise CheckFailed(f"{c} has more than {MAX_LEVELS} levels: it is no feature")
        facts[c] = sorted(r.level for r in found)
    facts |= exact(df, [], {c: (c, 0.5) for c in numeric}).first().asDict() if numeric else {}
    cells = [(F.coalesce(F.col(c).cast("string"), F.lit("MISSING")) == level).cast("double") for c in columns for level in facts[c]]
    return df.withColumn(name, F.array(*cells, *[F.coalesce(F.col(c).cast("double"), F.lit(float(facts[c] or 0.0))) for c in numeric]))


def compare_models(df: DataFrame, label: str, features: dict[str, str], fold: str, group: str, c: float = 1.0) -> DataFrame:
    """Discrimination of several feature sets on the same folds: (model, n, auroc, ...)."""
    out = None
    for name, column in features.items():
        scored, _ = logistic_oof(df, column, label, fold, (c,), group=group)
        part = discrimination(scored, label, "probability").withColumn("model", F.lit(name))
        out = part if out is None else out.unionByName(part)
    return out


def shortcut_baselines(df: DataFrame, label: str, sets: dict[str, tuple[Sequence[str], Sequence[str]]], fold: str, group: str, c: float = 1.0) -> DataFrame:
    """What the classifier reaches from side information alone: discrimination for each set of (categorical, numeric) columns, on the same folds."""
    rows = df
    for name, (categorical, numeric) in sets.items():
        rows = one_hot(rows, categorical, numeric, f"_set_{name}")
    return compare_models(rows, label, {name: f"_set_{name}" for name in sets}, fold, group, c)


def principal_components(df: DataFrame, vector: str, k: int, name: str) -> DataFrame:
    """Projection on the k leading components of all rows, for description; ``compare_outcomes`` learns components from training folds alone."""
    from pyspark.ml.feature import PCA

    rows = df.withColumn("_x", array_to_vector(F.col(vector).cast("array<double>")))
    done = PCA(k=k, inputCol="_x", outputCol="_z").fit(rows).transform(rows)
    return done.withColumn(name, vector_to_array("_z")).drop("_x", "_z")


def fold_components(df: DataFrame, vector: str, fold: str, dim: int, k: int) -> dict[int, tuple[np.ndarray, np.ndarray]]:
    """For each fold the map (k x dim matrix, k offsets) to the leading components of the standardized vectors of all other folds.

    One pass over the vectors: Gram matrices by fold; what is not in a fold is the total minus its own.
    """
    grams = vector_gram(df.withColumn("_zero", F.lit(0.0)), vector, "_zero", [fold], dim)
    total_n, total = sum(n for n, _ in grams.values()), sum(g for _, g in grams.values())
    out = {}
    for (f,), (n, g) in sorted(grams.items()):
        m, rest = total_n - n, total - g
        if m < 2:
            raise CheckFailed(f"fold {f} leaves {m} vectors to learn from")
        mean = rest[:dim, dim] / m
        cov = rest[:dim, :dim] / m - np.outer(mean, mean)
        scale = np.sqrt(np.maximum(np.diag(cov), 0.0))
        scale[scale < 1e-12] = 1.0
        values, axes = np.linalg.eigh(cov / np.outer(scale, scale))
        lead = axes[:, np.argsort(values)[::-1][: min(k, dim, m - 1)]].T
        lead *= np.sign(lead[np.arange(len(lead)), np.abs(lead).argmax(axis=1)])[:, None]  # one sign, whatever the solver gives
        out[int(f)] = (lead / scale, -(lead / scale) @ mean)
    return out


def projected(df: DataFrame, vector: str, matrix: np.ndarray, offset: np.ndarray, name: str) -> DataFrame:
    """Rows with matrix @ vector + offset, a batch at a time; the matrix is shipped once (components x dimensions numbers)."""
    import pyarrow as pa

    shared = df.sparkSession.sparkContext.broadcast((matrix, offset))
    schema = ", ".join(f"`{f.name}` {f.dataType.simpleString()}" for f in df.schema.fields) + f", `{name}` array<double>"
    rows = df.withColumn("_vector", same_length(vector, matrix.shape[1]))

    def run(batches):
        weights, shift = shared.value
        for batch in batches:
            v = batch.column("_vector")
            there = np.asarray(v.is_valid())
            flat = v.flatten().to_numpy(zero_copy_only=False).reshape(-1, weights.shape[1])
            done = iter((flat @ weights.T + shift).tolist())
            out = pa.array([next(done) if ok else None for ok in there], pa.list_(pa.float64()))
            yield pa.RecordBatch.from_arrays([*batch.columns[:-1], out], names=[*batch.schema.names[:-1], name])

    return rows.mapInArrow(run, schema)


def fold_features(train: DataFrame, df: DataFrame, numeric: Sequence[str], categorical: Sequence[str], name: str) -> DataFrame:
    """``df`` with an array of numbers (unknown: the training rows' median) and dummies (unknown: their most frequent level; a level that they
    don't have: all zeros). Only ``train`` is learned from."""
    medians = exact(train, [], {c: (c, 0.5) for c in numeric}).first().asDict() if numeric else {}
    cells = [F.coalesce(F.col(c).cast("double"), F.lit(float(medians[c] or 0.0))) for c in numeric]
    for c in categorical:
        counts = train.filter(F.col(c).isNotNull()).groupBy(F.col(c).cast("string").alias("level")).count().orderBy(F.desc("count"), "level").limit(MAX_LEVELS + 1).collect()
        if len(counts) > MAX_LEVELS:
            raise CheckFailed(f"{c} has more than {MAX_LEVELS} levels: it is no feature")
        if counts:
            value = F.coalesce(F.col(c).cast("string"), F.lit(counts[0].level))
            cells += [(value == x).cast("double") for x in sorted(r.level for r in counts)]
    return df.withColumn(name, F.array(*cells) if cells else F.array().cast("array<double>"))


def outcome_availability(df: DataFrame, outcomes: Sequence[str], fold: str, least: tuple[int, int] = (50, 50)) -> DataFrame:
    """(outcome, n_positive, n_negative, n_unknown, status): which outcomes can be modelled on these folds.

    Values other than 0 and 1 are unknown. ok: ``least`` (positive, negative) rows, and both classes outside of each fold.
    """
    there = [o for o in outcomes if o in df.columns]
    value = {o: F.col(o).cast("double") for o in there}
    counts = df.groupBy(fold).agg(F.count("*").alias("n"), *[x for i, o in enumerate(there) for x in (F.count_if(value[o] == 1).alias(f"p{i}"), F.count_if(value[o] == 0).alias(f"z{i}"))]).collect()  # a row for each fold
    table = []
    for o in outcomes:
        if o not in there:
            table.append((o, 0, 0, 0, "column_missing"))
            continue
        i = there.index(o)
        p, z, n = (sum(r[x] for r in counts) for x in (f"p{i}", f"z{i}", "n"))
        apart = all(p > r[f"p{i}"] and z > r[f"z{i}"] for r in counts)
        table.append((o, p, z, n - p - z, "too_few_records" if p < least[0] or z < least[1] else "ok" if apart else "one_class_in_training"))
    return df.sparkSession.createDataFrame(table, "outcome string, n_positive long, n_negative long, n_unknown long, status string")


def compare_outcomes(df: DataFrame, outcomes: Sequence[str], vector: str, dim: int, fold: str, group: str, numeric: Sequence[str], categorical: Sequence[str], k: int = 64, least: tuple[int, int] = (50, 50), c: float = 1.0) -> tuple[DataFrame, DataFrame, DataFrame]:
    """Clinical, embedding and combined classifiers of several outcomes: (out-of-fold predictions, metrics by outcome and model, ``outcome_availability``).

    All that is learned (medians, levels, scales, components, heads) comes from the other folds alone. The loops are over folds, outcomes and models.
    """
    there = [o for o in outcomes if o in df.columns]
    df = written(df.select(*dict.fromkeys([group, fold, vector, *there, *numeric, *categorical])), "people")
    assert_no_leak(df, group, fold)
    availability = outcome_availability(df, outcomes, fold, least)
    eligible = [r.outcome for r in availability.filter("status = 'ok'").collect()]
    if not eligible:
        raise CheckFailed("no outcome has enough records")
    maps = fold_components(df, vector, fold, dim, k)
    features, widths = {}, {}
    for f, (matrix, offset) in maps.items():
        rows = projected(df, vector, matrix, offset, "embedding_part").filter(F.col("embedding_part").isNotNull())
        rows = fold_features(df.filter(F.col(fold) != f), rows, numeric, categorical, "clinical_part")
        known = [F.when(F.col(o).cast("double").isin(0.0, 1.0), F.col(o).cast("double")).alias(f"_y{i}") for i, o in enumerate(eligible)]
        rows = rows.select(F.col(group).alias("_who"), F.col(fold).alias("_fold"), F.lit(f).alias("_learner"), F.concat("clinical_part", "embedding_part").alias("_x"), F.size("clinical_part").alias("_w"), *known)
        features[f] = written(rows, "features")
        width, total = features[f].select("_w", F.size("_x")).first()
        widths[f] = {"clinical": (0, width), "embedding": (width, total), "combined": (0, total)}
    heads = _fit_together(features, widths, len(eligible), c)
    predictions = None
    for f, rows in features.items():
        cells = []
        for i, o in enumerate(eligible):
            for model, (a, b) in widths[f].items():
                beta, bias = heads[f, i, model]
                score = sigmoid(dot(F.slice("_x", a + 1, b - a), F.array(*[F.lit(float(v)) for v in beta]).cast("array<double>")) + float(bias))
                cells.append(F.struct(F.lit(o).alias("outcome"), F.lit(model).alias("model"), F.col(f"_y{i}").cast("int").alias("observed"), score.alias("probability")))
        part = rows.filter(F.col("_fold") == f).select(F.col("_who").alias(group), F.col("_fold").alias("fold"), F.inline(F.array(*cells))).filter("observed is not null")
        predictions = part if predictions is None else predictions.unionByName(part)
    predictions = written(predictions, "predictions")
    return predictions, discrimination(predictions, "observed", "probability", ["outcome", "model"]), availability


def _fit_together(features: dict[int, DataFrame], widths: dict[int, dict[str, tuple[int, int]]], n_outcomes: int, c: float, steps: int = 100) -> dict[tuple[int, int, str], tuple[np.ndarray, float]]:
    """{(fold left out, outcome, model): coefficients and intercept}: the balanced classifiers of ``_fit_logistic``, all at once.

    ``features``: for each fold its rows (_fold, _x, _y0, _y1, ...); a model sees a range of _x. Newton steps with halving: a pass over the rows adds loss, gradient
    and curvature of all models by task, and the driver gets one row of sums for each model.
    """
    import pyarrow as pa
    from pyspark.ml.stat import Summarizer

    spark = next(iter(features.values())).sparkSession

    def summed(models: dict, weigh) -> dict:
        """The sum over training rows of weigh(key, x, y), by key."""
        ask = {f: [key for key in models if key[0] == f] for f in features}
        tables = [df.filter(F.col("_fold") != f).select("_learner", "_x", *[f"_y{i}" for i in range(n_outcomes)]) for f, df in features.items() if ask[f]]
        shared = spark.sparkContext.broadcast(models)  # a few vectors for each model

        def partial(batches):
            sums = {}
            for batch in batches:
                if not batch.num_rows:
                    continue
                f = batch.column("_learner")[0].as_py()
                x = batch.column("_x").flatten().to_numpy(zero_copy_only=False).reshape(batch.num_rows, -1)
                for key in ask.get(f, []):
                    y = batch.column(f"_y{key[1]}").to_numpy(zero_copy_only=False)
                    use = ~np.isnan(y)
                    a, b = widths[f][key[2]]
                    found = weigh(shared.value[key], x[use, a:b], y[use])
                    sums[key] = sums[key] + found if key in sums else found
            for (f, i, model), found in sums.items():
                yield pa.RecordBatch.from_arrays([pa.array([f], pa.int32()), pa.array([i], pa.int32()), pa.array([model]), pa.array([found.tolist()], pa.list_(pa.float64()))], names=["f", "i", "model", "sums"])

        parts = None
        for t in tables:
            own = t.mapInArrow(partial, "f int, i int, model string, sums array<double>")
            parts = own if parts is None else parts.unionByName(own)
        total = parts.groupBy("f", "i", "model").agg(vector_to_array(Summarizer.sum(array_to_vector("sums"))).alias("sums"))
        out = {(r.f, r.i, r.model): np.array(r.sums) for r in total.collect()}  # one row for each model
        shared.unpersist()
        return out

    keys = [(f, i, model) for f in features for i in range(n_outcomes) for model in widths[f]]
    first = summed(dict.fromkeys(keys), lambda _, x, y: np.concatenate([[len(y), y.sum()], x.sum(0)]))
    for key in keys:
        if key not in first or not 0 < first[key][1] < first[key][0]:
            raise CheckFailed("a classifier needs both classes")
    means = {key: s[2:] / s[0] for key, s in first.items()}
    spread = summed(means, lambda mean, x, y: np.concatenate([[0.0], ((x - mean) ** 2).sum(0)]))
    fits = {}
    for key, s in first.items():
        n, p = s[0], s[1]
        sd = np.sqrt(spread[key][1:] / (n - 1))
        fits[key] = {"n": n, "mean": means[key], "sd": np.where(sd > 0, sd, np.inf), "w": (n / (2 * (n - p)), n / (2 * p)), "at": np.zeros(len(sd) + 1), "best": None, "done": False}

    def newton(fit, x, y):
        z = np.column_stack([(x - fit["mean"]) / fit["sd"], np.ones(len(y))])
        t = z @ fit["at"]
        w = np.where(y == 1, fit["w"][1], fit["w"][0])
        m = 1 / (1 + np.exp(-np.clip(t, -700, 700)))
        loss = (w * (np.logaddexp(0, t) - y * t)).sum()
        return np.concatenate([[loss], z.T @ (w * (m - y)), ((z * (w * m * (1 - m))[:, None]).T @ z).ravel()])

    for _ in range(steps):
        moving = {key: fit for key, fit in fits.items() if not fit["done"]}
        if not moving:
            break
        for key, s in summed({key: {k: fit[k] for k in ("mean", "sd", "w", "at")} for key, fit in moving.items()}, newton).items():
            fit, d = fits[key], len(fits[key]["at"])
            penalty = np.full(d, 1 / c)
            penalty[-1] = 0.0  # the intercept is free
            loss = s[0] + (penalty * fit["at"] ** 2).sum() / 2
            if fit["best"] is None or loss <= fit["best"][0] + 1e-12 * abs(loss):
                step = np.linalg.solve(s[1 + d :].reshape(d, d) + np.diag(penalty), s[1 : 1 + d] + penalty * fit["at"])
                fit["best"] = (loss, fit["at"], step)
            else:  # too far: half of the last step
                fit["best"] = (*fit["best"][:2], fit["best"][2] / 2)
            fit["at"] = fit["best"][1] - fit["best"][2]
            fit["done"] = bool(np.abs(fit["best"][2]).max() < 1e-9)
    if any(not fit["done"] for fit in fits.values()):
        raise CheckFailed("a classifier did not converge")
    out = {}
    for key, fit in fits.items():
        beta = fit["at"][:-1] / fit["sd"]
        out[key] = (beta, float(fit["at"][-1] - beta @ fit["mean"]))
    return out


def evaluate_across(df: DataFrame, vector: str, target: str, own: str, other_head: DataFrame) -> DataFrame:
    """Own out-of-fold errors beside another head's errors on the same rows."""
    both = apply_head(df, other_head, vector, "_other")
    gap = lambda c: F.col(c) - F.col(target)
    return both.agg(F.count("*").alias("n"), F.avg(F.abs(gap(own))).alias("own_mae"), F.avg(F.abs(gap("_other"))).alias("other_mae"), F.regr_slope(F.col(own), F.col(target)).alias("own_slope"), F.regr_slope(F.col("_other"), F.col(target)).alias("other_slope"))


def compare_heads(df: DataFrame, population: str, target: str, reference: str, who: str, truth: str, own: str, other: str, repetitions: int, seed: object) -> DataFrame:
    """One row: the target population's own head against the other head on the same people, and its calibration slope against the reference population's.

    Error: mean of |own - truth| - |other - truth| in the target population. Slope: that of own on truth, target minus reference; people of both populations are
    drawn apart. Each has bootstrap limits, a two-sided p (1 / repetitions at least) and the least effect seen with 80 % power.
    """
    from .resample import bootstrap_groups

    rows = df.filter(F.col(population).isin(target, reference) & F.col(truth).isNotNull() & F.col(own).isNotNull()).select(F.col(population).alias("population"), F.col(who).alias("who"), F.col(truth).cast("double").alias("truth"), F.col(own).cast("double").alias("own"), F.col(other).cast("double").alias("other"))
    rows = written(rows, "heads")
    assert_unique(rows, ["population", "who"], "people of two populations")
    error = F.when(F.col("population") == target, F.abs(F.col("own") - F.col("truth")) - F.abs(F.col("other") - F.col("truth")))
    slope = lambda p: F.regr_slope(F.when(F.col("population") == p, F.col("own")), F.when(F.col("population") == p, F.col("truth")))
    facts = [F.avg(error).alias("error_difference"), (slope(target) - slope(reference)).alias("slope_difference")]
    point = rows.agg(F.count_if(F.col("population") == target).alias("n_target"), F.count_if(F.col("population") == reference).alias("n_reference"), *facts, F.stddev_samp(error).alias("_sd"), F.count(error).alias("_n"))
    drawn = bootstrap_groups(rows, ["population"], "who", repetitions, seed).groupBy("rep").agg(*facts)
    z = 1.959963984540054 + 0.8416212335729143
    limits = []
    for name in ("error_difference", "slope_difference"):
        x, short = F.col(name), name.split("_")[0]
        p = 2 * F.least(F.avg((x <= 0).cast("double")), F.avg((x >= 0).cast("double")))
        limits += [F.percentile(x, F.lit(0.025)).alias(f"{short}_ci_low"), F.percentile(x, F.lit(0.975)).alias(f"{short}_ci_high"), F.least(F.lit(1.0), F.greatest(1 / F.count(x), p)).alias(f"{short}_p")]
    spread = drawn.agg(*limits, (z * F.stddev_samp("slope_difference")).alias("slope_mde"))  # repetitions numbers
    return point.crossJoin(spread).withColumn("error_mde", z * F.col("_sd") / F.sqrt("_n")).drop("_sd", "_n")  # one row each


# harmonization


def _times(factor: Column):
    return lambda v: v * factor


def harmonizer(df: DataFrame, vector: str, source: str, reference: str, age: str, sex: str, label: str, dim: int, alpha: float = 1.0, scale: bool = False) -> DataFrame:
    """(source, shift, ratio): additive source effects of each vector element, next to age, sex and label.

    Cells (source x label) weigh alike. One weighted Gram over [1, age, female, label, source dummies] and its products with the
    vector are aggregated; the ridge acts on the source terms. With ``scale``, ratio is the reference's residual spread over the source's.
    """
    rows = df.filter(F.col(source).isNotNull() & F.col(age).isNotNull() & F.col(label).isNotNull() & F.col(vector).isNotNull()).withColumn(vector, same_length(vector, dim))
    cells = rows.groupBy(source, label).count()
    sources = sorted(r[0] for r in cells.select(source).distinct().collect())
    if reference not in sources or len(sources) < 2:
        raise CheckFailed("a harmonizer needs the reference and another source")
    others = [s for s in sources if s != reference]
    facts = rows.agg(F.avg(age).alias("m"), F.stddev_pop(age).alias("s"), F.count(sex).alias("k"), F.count("*").alias("n"), F.count_distinct(sex).alias("levels")).first()
    weighted = rows.join(F.broadcast(cells.withColumnRenamed("count", "_c")), [source, label]).withColumn("_w", 1.0 / F.col("_c"))  # sources x labels rows
    use_sex = facts.levels > 1 and facts.k == facts.n
    terms = [F.lit(1.0), (F.col(age) - facts.m) / (facts.s or 1.0), *([(F.col(sex) == "F").cast("double")] if use_sex else []), F.col(label).cast("double"), *[(F.col(source) == s).cast("double") for s in others]]
    p = len(terms)
    weighted = weighted.withColumns({f"_x{i}": t for i, t in enumerate(terms)}).withColumn("_v", F.transform(vector, lambda x: x.cast("double")))
    from .stats import gram

    g = gram(weighted, [f"_x{i}" for i in range(p)], "_w")
    if np.linalg.matrix_rank(g) < p:
        raise CheckFailed("source, label, age and sex can't be told apart")
    from pyspark.ml.stat import Summarizer

    sums = weighted.agg(*[vector_to_array(Summarizer.sum(array_to_vector(F.transform("_v", _times(F.col("_w") * F.col(f"_x{i}")))))).alias(f"s{i}") for i in range(p)]).first()
    ridge = np.diag([0.0] * (p - len(others)) + [alpha * 1e-3] * len(others))
    beta = np.linalg.solve(g + ridge, np.array([sums[f"s{i}"] for i in range(p)]))
    shifts = {s: beta[p - len(others) + i] for i, s in enumerate(others)} | {reference: np.zeros(dim)}
    ratios = {s: np.ones(dim) for s in sources}
    if scale:
        fit = F.array(*[F.array(*[F.lit(float(x)) for x in b]) for b in beta])
        predicted = F.transform(F.sequence(F.lit(0), F.lit(dim - 1)), lambda k: sum([fit[i][k] * F.col(f"_x{i}") for i in range(1, p)], fit[0][k] * F.col("_x0")))
        spread = weighted.groupBy(source).agg(vector_to_array(Summarizer.variance(array_to_vector(F.zip_with("_v", predicted, lambda a, b: a - b)))).alias("v")).collect()
        sd = {r[0]: np.sqrt(np.maximum(r.v, 1e-12)) for r in spread}
        ratios = {s: sd[reference] / sd[s] for s in sources}
    table = [(s, [float(x) for x in shifts[s]], [float(x) for x in ratios[s]]) for s in sources]
    return df.sparkSession.createDataFrame(table, f"{source} string, shift array<double>, ratio array<double>")


def harmonize_vectors(df: DataFrame, effects: DataFrame, vector: str, source: str) -> DataFrame:
    """Vectors without their source's shift (and on the reference's scale); rows of an unknown source are dropped."""
    joined = df.join(F.broadcast(effects), source)  # one row per source
    shifted = F.zip_with(F.col(vector), F.col("shift"), lambda v, s: v - s)
    return joined.withColumn(vector, F.zip_with(shifted, F.col("ratio"), lambda v, r: v * r)).drop("shift", "ratio")


def harmonize_crossfit(df: DataFrame, fold: str, vector: str, source: str, reference: str, **how) -> DataFrame:
    """Each fold's vectors by effects learned on the other folds."""
    out = None
    for k in sorted(r[0] for r in df.select(fold).distinct().collect()):
        effects = harmonizer(df.filter(F.col(fold) != k), vector, source, reference, **how)
        part = harmonize_vectors(df.filter(F.col(fold) == k), effects, vector, source)
        out = part if out is None else out.unionByName(part)
    return out


def nested_domain_auc(df: DataFrame, vector: str, source: str, reference: str, other: str, age: str, sex: str, label: str, who: str, dim: int, k: int = 5, seed: object = 0, c: float = 0.1, most: int | None = None, **how) -> DataFrame:
    """(fold, auc, n_train, n_test): how well a linear head tells the sources apart on people that neither it nor the harmonizer has seen.

    Folds are dealt within source and label. In each, source effects and the head are learned on the other folds; both sides are rows with label 1, as many
    of each source (``most`` at most), in hashed order. AUC under a half is as much information as its mirror image: see ``domain_summary``.
    """
    rows = df.filter(F.col(source).isin(reference, other) & F.col(label).isNotNull()).withColumn("_cell", F.concat_ws("|", F.col(source), F.col(label).cast("string")))
    dealt = written(folds(rows, who, k, seed, "_cell").drop("_cell"), "dealt")
    cells = dealt.groupBy(source, label).agg(F.count_distinct("fold").alias("n")).collect()  # sources x labels
    if len(cells) < 4 or any(r.n < k for r in cells):
        raise CheckFailed("every cell of source and label needs rows in all folds")

    def sides(part: DataFrame, effects: DataFrame, name: str) -> DataFrame:
        moved = harmonize_vectors(part.filter(F.col(label) == 1), effects, vector, source).withColumn("_domain", (F.col(source) == other).cast("int"))
        if most is not None:
            order = portable_hash(f"{seed}|{name}", F.col(who))
            moved = ranked(moved, ["_domain"], [order, F.col(who)], "_place").filter(F.col("_place") <= most).drop("_place")
        return written(balanced_sample(moved, "_domain", who, f"{seed}|{name}").select(vector, "_domain"), name)

    out = []
    for f in range(k):
        train, test = dealt.filter(F.col("fold") != f), dealt.filter(F.col("fold") == f)
        effects = harmonizer(train, vector, source, reference, age, sex, label, dim, **how)
        learned, held = sides(train, effects, f"train{f}"), sides(test, effects, f"test{f}")
        beta, bias = _fit_logistic(learned, vector, "_domain", c, False)
        scored = apply_head(held, heads_frame(df.sparkSession, [("domain", f, beta, bias)]), vector, "_score")
        out.append((f, discrimination(scored, "_domain", "_score").first().auroc, learned.count(), held.count()))
    return df.sparkSession.createDataFrame(out, "fold int, auc double, n_train long, n_test long")


def domain_summary(by_fold: DataFrame) -> DataFrame:
    """Mean AUC with and without its direction, and the spread over folds."""
    mean = F.avg("auc")
    return by_fold.agg(F.greatest(mean, 1 - mean).alias("auc_mean"), mean.alias("auc_signed_mean"), F.stddev_samp("auc").alias("auc_sd"), F.sum("n_test").alias("n_test"))
