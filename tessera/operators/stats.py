"""Group statistics. Sums over rows are Spark aggregates; what reaches the driver is one row per group or a p x p matrix."""

from __future__ import annotations

import math
from collections.abc import Mapping, Sequence
from functools import reduce

import numpy as np
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from ..functions import tails
from ..sources.shared import written
from .checks import CheckFailed, assert_unique
from .quantiles import exact, with_exact
from .windows import average_rank, average_ranks, running, with_aggregates


def _safe(a: Column, b: Column) -> Column:
    return a / F.nullif(b.cast("double"), F.lit(0.0))


# predictions against truth


def prediction_summary(df: DataFrame, age: str, prediction: str, group: Sequence[str] = ()) -> DataFrame:
    gap = F.col(prediction) - F.col(age)
    rows = df.filter(F.col(age).isNotNull() & F.col(prediction).isNotNull())
    moments = [F.count("*").alias("n"), F.avg(age).alias("age_mean"), F.stddev_samp(age).alias("age_sd"), F.avg(gap).alias("gap_mean"), F.stddev_samp(gap).alias("gap_sd"), F.avg(F.abs(gap)).alias("mae")]
    return with_exact(rows, group, moments, {"gap_median": (gap, 0.5), "gap_q1": (gap, 0.25), "gap_q3": (gap, 0.75)})


def error_metrics(df: DataFrame, age: str, prediction: str, group: Sequence[str] = (), *more: Column) -> DataFrame:
    rows = df.filter(F.col(age).isNotNull() & F.col(prediction).isNotNull())
    return with_exact(rows, group, [*_moments(age, prediction), *more], {"median_gap": (F.col(prediction) - F.col(age), 0.5)})


def _moments(age: str, prediction: str) -> list[Column]:
    gap = F.col(prediction) - F.col(age)
    return [
        F.count("*").alias("n"),
        F.avg(F.abs(gap)).alias("mae"),
        F.sqrt(F.avg(gap * gap)).alias("rmse"),
        F.avg(gap).alias("mean_gap"),
        F.regr_slope(F.col(prediction), F.col(age)).alias("calibration_slope"),
        F.regr_intercept(F.col(prediction), F.col(age)).alias("calibration_intercept"),
        F.corr(prediction, age).alias("correlation"),
        F.avg((gap > 0).cast("double")).alias("overprediction_rate"),
    ]


def calibration_fit(df: DataFrame, truth: str, prediction: str, group: Sequence[str] = ()) -> DataFrame:
    """Slope, intercept and r squared of prediction on truth; null under 3 rows or without spread."""
    rows = df.filter(F.col(truth).isNotNull() & F.col(prediction).isNotNull())
    out = rows.groupBy(*group).agg(F.count("*").alias("n"), F.regr_slope(F.col(prediction), F.col(truth)).alias("slope"), F.regr_intercept(F.col(prediction), F.col(truth)).alias("intercept"), F.regr_r2(F.col(prediction), F.col(truth)).alias("r2"), F.stddev_pop(truth).alias("_s"))
    ok = (F.col("n") >= 3) & (F.col("_s") > 0)
    return out.withColumns({c: F.when(ok, F.col(c)) for c in ("slope", "intercept", "r2")}).drop("_s")


def fairness_table(df: DataFrame, group: str, who: str, age: str, prediction: str, repetitions: int = 0, seed: int = 0) -> DataFrame:
    """Error metrics per group and Overall, with percentile bootstrap limits of each metric if repetitions are asked for."""
    from .resample import replicate_aggregates

    rows = df.filter(F.col(group).isNotNull() & F.col(age).isNotNull() & F.col(prediction).isNotNull())
    assert_unique(rows, [who], "fairness table")
    both = rows.select(F.col(group).cast("string").alias("group"), F.col(who).alias("who"), F.col(age).cast("double").alias("age"), F.col(prediction).cast("double").alias("prediction"))
    both = both.unionByName(both.withColumn("group", F.lit("Overall")))
    table = error_metrics(both, "age", "prediction", ["group"], F.avg("age").alias("age_mean"), F.stddev_samp("age").alias("age_sd"))
    if not repetitions:
        return table
    names = ["mae", "rmse", "mean_gap", "median_gap", "calibration_slope", "calibration_intercept", "correlation", "overprediction_rate"]
    reps = replicate_aggregates(both, ["group"], "who", repetitions, seed, _moments("age", "prediction"), "median_gap", F.col("prediction") - F.col("age"), 0.5)
    limits = reps.groupBy("group").agg(*[x for n in names for x in (F.percentile(n, F.lit(0.025)).alias(f"{n}_ci_low"), F.percentile(n, F.lit(0.975)).alias(f"{n}_ci_high"))])
    return table.join(limits, "group", "left")


def wilson(df: DataFrame, group: Sequence[str], passed: Column, z: float = 1.959963984540054) -> DataFrame:
    """Pass rate per group with its Wilson interval."""
    out = df.groupBy(*group).agg(F.count("*").alias("n"), F.count_if(passed).alias("n_pass"))
    n, p = F.col("n").cast("double"), F.col("n_pass") / F.col("n")
    mid, half = (p + z * z / (2 * n)) / (1 + z * z / n), z * F.sqrt(p * (1 - p) / n + z * z / (4 * n * n)) / (1 + z * z / n)
    return out.withColumns({"rate": p, "ci_low": mid - half, "ci_high": mid + half})


def smd_columns(value: str, group: str, pooled: str = "average") -> list[Column]:
    """n, mean, sd of groups 1 and 0 and the standardized difference (average or df-weighted variance)."""
    a, b = F.when(F.col(group) == 1, F.col(value)), F.when(F.col(group) == 0, F.col(value))
    va, vb, na, nb = F.var_samp(a), F.var_samp(b), F.count(a), F.count(b)
    spread = (va + vb) / 2 if pooled == "average" else ((na - 1) * va + (nb - 1) * vb) / (na + nb - 2)
    return [na.alias("n_1"), nb.alias("n_0"), F.avg(a).alias("mean_1"), F.avg(b).alias("mean_0"), _safe(F.avg(a) - F.avg(b), F.sqrt(spread)).alias("smd")]


# regressions by Gram matrices


def gram(df: DataFrame, columns: Sequence[str], weight: str | None = None) -> np.ndarray:
    """Sum of w x x' over the rows, one aggregate of p (p + 1) / 2 sums."""
    w = F.col(weight) if weight else F.lit(1.0)
    cells = [F.sum(w * F.col(columns[i]) * F.col(columns[j])).alias(f"g_{i}_{j}") for i in range(len(columns)) for j in range(i, len(columns))]
    row = df.agg(*cells).first()
    out = np.zeros((len(columns), len(columns)))
    for i in range(len(columns)):
        for j in range(i, len(columns)):
            out[i, j] = out[j, i] = row[f"g_{i}_{j}"] or 0.0
    return out


def design(df: DataFrame, exposure: str, outcome: str, numeric: Sequence[str], categorical: Sequence[str]) -> tuple[DataFrame, list[str]]:
    """Rows with y, x_0 ... and further columns kept: intercept, exposure, numbers (median for unknown, standardized, unknown flags,
    age squared), and dummies against the first level in order. Medians, moments and levels are one row on the driver.
    """
    rows = df.withColumns({outcome: F.col(outcome).cast("double"), exposure: F.col(exposure).cast("double")}).filter(F.col(outcome).isNotNull() & F.col(exposure).isNotNull())
    numbers = [c for c in numeric if c in df.columns]
    classes = [c for c in categorical if c in df.columns]
    medians = exact(rows, [], {c: (c, 0.5) for c in numbers}).first().asDict() if numbers else {}
    filled = {c: F.coalesce(F.col(c).cast("double"), F.lit(float(medians[c] or 0.0))) for c in numbers}
    facts = rows.agg(
        F.count("*").alias("_n"),
        *[x for c in numbers for x in (F.avg(filled[c]).alias(f"m_{c}"), F.stddev_pop(filled[c]).alias(f"s_{c}"), F.count_if(F.col(c).isNull()).alias(f"u_{c}"))],
        *[F.array_sort(F.collect_set(F.col(c).cast("string"))).alias(f"l_{c}") for c in classes],
    ).first()
    names, cells = ["intercept", exposure], [F.lit(1.0), F.col(exposure)]
    for c in numbers:
        if not (facts[f"s_{c}"] or 0) > 1e-12:
            continue
        z = (filled[c] - facts[f"m_{c}"]) / facts[f"s_{c}"]
        names.append(c)
        cells.append(z)
        if c == "age":
            names.append("age_squared")
            cells.append(z * z)
        if facts[f"u_{c}"]:
            names.append(f"{c}_missing")
            cells.append(F.col(c).isNull().cast("double"))
    for c in classes:
        for level in (facts[f"l_{c}"] or [])[1:]:
            names.append(f"{c}={level}")
            cells.append(F.coalesce(F.col(c).cast("string") == level, F.lit(False)).cast("double"))
    return rows.select(*rows.columns, F.col(outcome).alias("_y"), *[x.alias(f"_x{i}") for i, x in enumerate(cells)]), names


def _fit(rows: DataFrame, p: int) -> tuple[np.ndarray, np.ndarray]:
    g = gram(rows, [*(f"_x{i}" for i in range(p)), "_y"])
    inverse = np.linalg.pinv(g[:p, :p])
    return inverse @ g[:p, p], inverse


def _with_residual(rows: DataFrame, beta: np.ndarray, inverse: np.ndarray) -> DataFrame:
    x = [F.col(f"_x{i}") for i in range(len(beta))]
    total = lambda cells: sum(cells[1:], cells[0])
    e = F.col("_y") - total([float(b) * v for b, v in zip(beta, x, strict=True)])
    h = total([float(inverse[i, j]) * x[i] * x[j] for i in range(len(beta)) for j in range(len(beta))])
    return rows.withColumns({"_e": e, "_h": h})


def adjusted_effect(df: DataFrame, outcome: str, exposure: str, numeric: Sequence[str] = ("age",), categorical: Sequence[str] = (), least: int = 20) -> dict:
    """Linear exposure effect with HC3 standard error, z test and 95 % limits."""
    rows, names = design(df, exposure, outcome, numeric, categorical)
    n = rows.agg(F.count("*").alias("n"), F.count_if(F.col(exposure) == 1).alias("a"), F.count_if(F.col(exposure) == 0).alias("b"), F.count_distinct(exposure).alias("k")).first()
    if n.n < least or n.k != 2:
        raise CheckFailed(f"an adjusted effect needs {least} rows and two groups, not {n.asDict()}")
    beta, inverse = _fit(rows, len(names))
    scored = _with_residual(rows, beta, inverse).withColumn("_w", (F.col("_e") / F.greatest(1 - F.col("_h"), F.lit(1e-8))) ** 2)
    covariance = inverse @ gram(scored, [f"_x{i}" for i in range(len(names))], "_w") @ inverse
    return _effect(n, beta[1], math.sqrt(max(covariance[1, 1], 0.0)), names)


def _effect(n, estimate: float, se: float, names: list[str]) -> dict:
    z = estimate / se if se > 0 else math.nan
    p = tails.normal_two_sided(z) if se > 0 else math.nan
    estimate = float(estimate)
    return {"n": n.n, "n_exposed": n.a, "n_reference": n.b, "estimate": estimate, "se": se, "ci_low": estimate - 1.96 * se, "ci_high": estimate + 1.96 * se, "p_value": p, "design": names}


def clustered_effect(df: DataFrame, outcome: str, exposure: str, cluster: str, numeric: Sequence[str] = ("age",), categorical: Sequence[str] = ()) -> dict:
    """Linear exposure effect with cluster-robust standard error: G/(G-1) (n-1)/(n-k) small-sample factor."""
    rows, names = design(df.filter(F.col(cluster).isNotNull()), exposure, outcome, numeric, categorical)
    beta, inverse = _fit(rows, len(names))
    p = len(names)
    scores = _with_residual(rows, beta, inverse).groupBy(cluster).agg(F.count("*").alias("_n"), *[F.sum(F.col(f"_x{i}") * F.col("_e")).alias(f"_x{i}") for i in range(p)])
    n = rows.agg(F.count("*").alias("n"), F.count_if(F.col(exposure) == 1).alias("a"), F.count_if(F.col(exposure) == 0).alias("b")).first()
    groups = scores.count()
    if groups < 2 or n.n <= p:
        raise CheckFailed("clustered errors need two clusters and more rows than terms")
    factor = groups / (groups - 1) * (n.n - 1) / (n.n - p)
    covariance = factor * inverse @ gram(scores, [f"_x{i}" for i in range(p)]) @ inverse
    return _effect(n, beta[1], math.sqrt(max(covariance[1, 1], 0.0)), names) | {"n_clusters": groups}


def logistic_effect(df: DataFrame, outcome: str, exposure: str, numeric: Sequence[str] = ("age",), categorical: Sequence[str] = (), cluster: str | None = None, steps: int = 25) -> dict:
    """Odds ratio of a binary outcome by Newton steps on aggregated Gram matrices; HC0-type or clustered sandwich."""
    rows, names = design(df if cluster is None else df.filter(F.col(cluster).isNotNull()), exposure, outcome, numeric, categorical)
    p, beta = len(names), np.zeros(len(names))
    rows = rows.persist()
    xs = [f"_x{i}" for i in range(p)]
    try:
        for _ in range(steps):
            eta = sum([float(b) * F.col(x) for b, x in zip(beta[1:], xs[1:], strict=True)], float(beta[0]) * F.col(xs[0]))
            mu = 1 / (1 + F.exp(-eta))
            scored = rows.withColumns({"_mu": mu}).withColumns({"_w": F.col("_mu") * (1 - F.col("_mu")), "_e": F.col("_y") - F.col("_mu")})
            information = gram(scored, xs, "_w")
            row = scored.agg(*[F.sum(F.col(x) * F.col("_e")).alias(x) for x in xs]).first()
            step = np.linalg.pinv(information) @ np.array([row[x] for x in xs])
            beta = beta + step
            if np.abs(step).max() < 1e-10:
                break
        inverse = np.linalg.pinv(information)
        n = rows.agg(F.count("*").alias("n"), F.count_if(F.col(exposure) == 1).alias("a"), F.count_if(F.col(exposure) == 0).alias("b")).first()
        if cluster is None:
            meat = gram(scored.withColumn("_w2", F.col("_e") ** 2), xs, "_w2")
        else:
            sums = scored.groupBy(cluster).agg(*[F.sum(F.col(x) * F.col("_e")).alias(x) for x in xs])
            g = sums.count()
            if g < 2 or n.n <= p:
                raise CheckFailed("clustered errors need two clusters and more rows than terms")
            meat = g / (g - 1) * (n.n - 1) / (n.n - p) * gram(sums, xs)
        se = math.sqrt(max((inverse @ meat @ inverse)[1, 1], 0.0))
    finally:
        rows.unpersist()
    out = _effect(n, float(beta[1]), se, names)
    return out | {"odds_ratio": math.exp(beta[1]), "or_low": math.exp(out["ci_low"]), "or_high": math.exp(out["ci_high"])}


def residualize(df: DataFrame, value: str, group: str, age: str, sex: str | None = None, name: str = "residual") -> DataFrame:
    """value minus its fit on age, age squared (and sex) within each group; coefficients come from one grouped aggregate."""
    rows = df.filter(F.col(value).isNotNull() & F.col(age).isNotNull() & F.col(group).isNotNull())
    center = rows.groupBy(group).agg(F.avg(age).alias("_c"))
    rows = rows.join(center, group).withColumns({"_x0": F.lit(1.0), "_x1": F.col(age) - F.col("_c")}).withColumn("_x2", F.col("_x1") ** 2)
    xs = ["_x0", "_x1", "_x2"]
    if sex:
        rows = rows.withColumn("_x3", (F.coalesce(F.col(sex), F.lit("MISSING")) == "F").cast("double"))
        xs.append("_x3")
    both = [*xs, value]
    cells = [F.sum(F.col(both[i]) * F.col(both[j])).alias(f"g_{i}_{j}") for i in range(len(both)) for j in range(i, len(both))]
    fits = []
    for r in rows.groupBy(group).agg(*cells).toLocalIterator():  # one row per cohort
        g = np.zeros((len(both), len(both)))
        for i in range(len(both)):
            for j in range(i, len(both)):
                g[i, j] = g[j, i] = r[f"g_{i}_{j}"]
        fits.append((r[group], [float(b) for b in np.linalg.pinv(g[:-1, :-1]) @ g[:-1, -1]]))
    kinds = df.schema[group].dataType.simpleString()
    table = df.sparkSession.createDataFrame(fits, f"{group} {kinds}, _b array<double>")
    fitted = sum([F.col("_b")[i] * F.col(x) for i, x in enumerate(xs[1:], 1)], F.col("_b")[0] * F.col("_x0"))
    return rows.join(table, group).withColumn(name, F.col(value) - fitted).drop("_c", "_b", *xs)


# two-group tests; each takes one aggregated row


def t_test(df: DataFrame, value: str, group: str, equal: bool = False) -> dict:
    """Welch (or pooled) t of groups 1 and 0 with the 95 % limits of the difference of means."""
    a, b = F.when(F.col(group) == 1, F.col(value)), F.when(F.col(group) == 0, F.col(value))
    r = df.agg(F.count(a).alias("na"), F.count(b).alias("nb"), F.avg(a).alias("ma"), F.avg(b).alias("mb"), F.var_samp(a).alias("va"), F.var_samp(b).alias("vb")).first()
    if min(r.na, r.nb) < 2:
        return {"n_1": r.na, "n_0": r.nb, "difference": None, "t": None, "df": None, "p_value": None}
    if equal:
        spread = ((r.na - 1) * r.va + (r.nb - 1) * r.vb) / (r.na + r.nb - 2)
        se, df_ = math.sqrt(spread * (1 / r.na + 1 / r.nb)), r.na + r.nb - 2
    else:
        x, y = r.va / r.na, r.vb / r.nb
        se, df_ = math.sqrt(x + y), (x + y) ** 2 / (x**2 / (r.na - 1) + y**2 / (r.nb - 1)) if x + y > 0 else 1.0
    d = r.ma - r.mb
    return {"n_1": r.na, "n_0": r.nb, "difference": d, "df": df_} | _t(d, se, df_)


def _t(d: float, se: float, df: float) -> dict:
    if not se > 0:
        return {"t": None, "p_value": None, "ci_low": d, "ci_high": d}
    q = tails.t_quantile(0.975, df)
    return {"t": d / se, "p_value": tails.t_two_sided(d / se, df), "ci_low": d - q * se, "ci_high": d + q * se}


def paired_t(df: DataFrame, a: str, b: str) -> dict:
    d = F.col(a) - F.col(b)
    r = df.agg(F.count(d).alias("n"), F.avg(d).alias("m"), F.stddev_samp(d).alias("s")).first()
    return {"n": r.n, "difference": r.m, "df": r.n - 1} | (_t(r.m, r.s / math.sqrt(r.n), r.n - 1) if r.n > 1 else {"t": None, "p_value": None})


def mann_whitney(df: DataFrame, value: str, group: str) -> dict:
    """U of group 1, rank-biserial correlation and the tie-corrected normal p value (with continuity correction)."""
    ranked = average_rank(df.filter(F.col(group).isin(0, 1)), value, "_r")
    r = ranked.agg(F.sum(F.when(F.col(group) == 1, F.col("_r"))).alias("s"), F.count_if(F.col(group) == 1).alias("a"), F.count_if(F.col(group) == 0).alias("b"), F.sum(F.col("n_tied") ** 2 - 1.0).alias("ties")).first()
    if not (r.a and r.b):
        return {"n_1": r.a, "n_0": r.b, "u": None, "rank_biserial": None, "p_value": None}
    u, n = r.s - r.a * (r.a + 1) / 2, r.a + r.b
    sd = math.sqrt(r.a * r.b / 12 * ((n + 1) - r.ties / (n * (n - 1)))) if n > 1 else 0
    z = (abs(u - r.a * r.b / 2) - 0.5) / sd if sd else 0.0
    return {"n_1": r.a, "n_0": r.b, "u": u, "rank_biserial": 2 * u / (r.a * r.b) - 1, "p_value": min(1.0, 2 * tails.normal_sf(z))}


def wilcoxon(df: DataFrame, a: str, b: str) -> dict:
    """Signed-rank sums of a - b without zeros, and the tie-corrected normal p value."""
    d = df.select((F.col(a) - F.col(b)).alias("_d")).filter("_d is not null and _d != 0").withColumn("_a", F.abs("_d"))
    r = average_rank(d, "_a", "_r").agg(F.count("*").alias("n"), F.coalesce(F.sum(F.when(F.col("_d") > 0, F.col("_r"))), F.lit(0.0)).alias("up"), F.coalesce(F.sum(F.when(F.col("_d") < 0, F.col("_r"))), F.lit(0.0)).alias("down"), F.sum(F.col("n_tied") ** 2 - 1.0).alias("ties")).first()
    if not r.n:
        return {"n": 0, "w": None, "p_value": None}
    variance = r.n * (r.n + 1) * (2 * r.n + 1) / 24 - r.ties / 48
    z = abs(r.up - r.n * (r.n + 1) / 4) / math.sqrt(variance) if variance > 0 else 0.0
    return {"n": r.n, "w": min(r.up, r.down), "p_value": tails.normal_two_sided(z)}


def chi_square(df: DataFrame, a: str, b: str) -> dict:
    """Omnibus chi-square of a contingency table with Cramer's V; Fisher's exact p for a 2 x 2 table.

    Cells and their margins stay in Spark, whatever the number of levels; the driver gets one row of sums, and four cells for Fisher's test.
    """
    cells = df.filter(F.col(a).isNotNull() & F.col(b).isNotNull()).groupBy(F.col(a).cast("string").alias("a"), F.col(b).cast("string").alias("b")).agg(F.count("*").alias("n"))
    cells = written(cells, "cells")
    placed = with_aggregates(with_aggregates(cells, ["a"], _row=F.sum("n")), ["b"], _col=F.sum("n"))
    r = placed.agg(F.sum("n").alias("n"), F.count_distinct("a").alias("rows"), F.count_distinct("b").alias("cols"), F.sum(F.col("n") * F.col("n") / (F.col("_row").cast("double") * F.col("_col"))).alias("s")).first()
    if not r.n or r.rows < 2 or r.cols < 2:
        return {"chi2": None, "df": None, "p_value": None, "cramers_v": None, "fisher_p": None}
    # the sum of (observed - expected)^2 / expected over all cells, empty ones too
    chi2, dof = max(0.0, r.n * (r.s - 1)), (r.rows - 1) * (r.cols - 1)
    fisher = None
    if r.rows == r.cols == 2:
        found = {(x.a, x.b): x.n for x in cells.collect()}
        x, y = (sorted({k[i] for k in found}) for i in (0, 1))
        fisher = tails.fisher_two_sided(*[found.get((i, j), 0) for i in x for j in y])
    return {"chi2": chi2, "df": dof, "p_value": tails.chi2_sf(chi2, dof), "cramers_v": math.sqrt(chi2 / r.n / min(r.rows - 1, r.cols - 1)), "fisher_p": fisher}


# agreement


def agreement(df: DataFrame, a: str, b: str, stratum: str | None = None) -> DataFrame:
    """Per stratum and all: n, Pearson, Spearman, Lin's concordance, mean absolute and root mean square difference, Bland-Altman limits."""
    rows = df.filter(F.col(a).isNotNull() & F.col(b).isNotNull())
    rows = rows.select((F.col(stratum).cast("string") if stratum else F.lit(None).cast("string")).alias("stratum"), F.col(a).cast("double").alias("a"), F.col(b).cast("double").alias("b"))
    both = rows.withColumn("stratum", F.lit("all"))
    if stratum:
        both = both.unionByName(rows.filter("stratum is not null"))
    ranked = average_ranks(both, {"a": "ra", "b": "rb"}, ["stratum"])
    d = F.col("a") - F.col("b")
    concordance = 2 * F.covar_pop("a", "b") / F.nullif(F.var_pop("a") + F.var_pop("b") + (F.avg("a") - F.avg("b")) ** 2, F.lit(0.0))
    return ranked.groupBy("stratum").agg(F.count("*").alias("n"), F.corr("a", "b").alias("pearson"), F.corr("ra", "rb").alias("spearman"), concordance.alias("concordance"), F.avg(F.abs(d)).alias("mean_abs_difference"), F.sqrt(F.avg(d * d)).alias("rms_difference"), F.avg(d).alias("bias"), (F.avg(d) - 1.96 * F.stddev_samp(d)).alias("limit_low"), (F.avg(d) + 1.96 * F.stddev_samp(d)).alias("limit_high"))


# multiple testing


def benjamini_hochberg(df: DataFrame, p: str, key: Sequence[str], family: Sequence[str] = (), name: str = "q_value") -> DataFrame:
    """Adjusted p values within each family; null and NaN stay null and don't count."""
    good = F.col(p).isNotNull() & ~F.isnan(p)
    tests = df.filter(good)
    # equal p values have one adjusted value, so distinct ones are enough
    distinct = tests.groupBy(*family, p).agg(F.count("*").alias("_t"))
    found = running(distinct, family, p, {"_rank": F.col("_t")})
    found = with_aggregates(found, family, _m=F.sum("_t"))
    found = running(found, family, p, least={"_q": F.col(p) * F.col("_m") / F.col("_rank")})
    values = found.select(*[F.col(f).alias(f"_family_{i}") for i, f in enumerate(family)], F.col(p).alias("_p"), F.least("_q", F.lit(1.0)).alias(name))
    same = reduce(lambda a, b: a & b, [F.col(p) == F.col("_p"), *[F.col(f).eqNullSafe(F.col(f"_family_{i}")) for i, f in enumerate(family)]])
    done = tests.join(values, same).drop("_p", *[f"_family_{i}" for i in range(len(family))])
    return done.unionByName(df.filter(~good | F.col(p).isNull()).withColumn(name, F.lit(None).cast("double")))


# discrimination


def discrimination(df: DataFrame, label: str, score: str, group: Sequence[str] = (), threshold: float = 0.5) -> DataFrame:
    """AUROC, average precision, Brier score and threshold metrics per group.

    Rows meet per distinct score; cumulative counts over distinct scores, and all else, come from these.
    """
    part = list(group)
    y, s = F.col(label), F.col("s")
    at = df.filter(y.isin(0, 1) & F.col(score).isNotNull()).groupBy(*part, F.col(score).alias("s")).agg(F.count_if(y == 1).alias("p"), F.count_if(y == 0).alias("n"))
    c = F.col
    total = lambda column, keep=True: F.coalesce(F.sum(F.when(F.lit(keep) if keep is True else keep, c(column))), F.lit(0))
    up = s >= threshold
    area, precision = (c("tp") - c("p") / 2.0) * c("n"), c("p") * c("tp") / (c("tp") + c("fp"))
    out = running(at, part, "s", {"tp": c("p"), "fp": c("n")}, descending=True).groupBy(*part).agg(
        _safe(F.sum(area), F.sum("p") * F.sum("n")).alias("auroc"), _safe(F.sum(precision), F.sum("p")).alias("average_precision"), (total("p") + total("n")).alias("n_rows"), total("p").alias("n_positive"),
        _safe(F.sum(c("p") * (s - 1) ** 2 + c("n") * s**2), F.sum(c("p") + c("n"))).alias("brier"), total("p", up).alias("tp"), total("n", up).alias("fp"), total("n", ~up).alias("tn"), total("p", ~up).alias("fn"),
    ).withColumnRenamed("n_rows", "n")
    out = out.withColumns({"sensitivity": _safe(c("tp"), c("tp") + c("fn")), "specificity": _safe(c("tn"), c("tn") + c("fp")), "ppv": _safe(c("tp"), c("tp") + c("fp")), "npv": _safe(c("tn"), c("tn") + c("fn"))})
    return out.withColumn("balanced_accuracy", (c("sensitivity") + c("specificity")) / 2)


def paired_auroc(df: DataFrame, who: str, label: str, a: str, b: str, repetitions: int, seed: int) -> DataFrame:
    """Difference of two scores' AUROC on identical people, with stratified bootstrap limits."""
    from .resample import bootstrap_groups

    rows = df.filter(F.col(a).isNotNull() & F.col(b).isNotNull() & F.col(label).isin(0, 1))
    assert_unique(rows, [who], "paired scores")
    point = discrimination(rows, label, a).select(F.col("auroc").alias("auroc_a")).crossJoin(discrimination(rows, label, b).select(F.col("auroc").alias("auroc_b")))
    drawn = bootstrap_groups(rows.select(who, label, a, b), [label], who, repetitions, seed)
    reps = discrimination(drawn, label, a, ["rep"]).select("rep", F.col("auroc").alias("x")).join(discrimination(drawn, label, b, ["rep"]).select("rep", F.col("auroc").alias("y")), "rep")
    limits = reps.agg(F.percentile(F.col("x") - F.col("y"), F.lit(0.025)).alias("ci_low"), F.percentile(F.col("x") - F.col("y"), F.lit(0.975)).alias("ci_high"))
    return point.crossJoin(limits).withColumn("difference", F.col("auroc_a") - F.col("auroc_b"))


# pairs and sets


def paired_effect(pairs: DataFrame, outcomes: DataFrame, who: str, outcome: str) -> DataFrame:
    """One row: n, mean and median of case minus control outcomes over matched pairs."""
    case = outcomes.select(F.col(who).cast("string").alias("case_id"), F.col(outcome).alias("yc"))
    control = outcomes.select(F.col(who).cast("string").alias("control_id"), F.col(outcome).alias("yr"))
    d = pairs.join(case, "case_id").join(control, "control_id").select((F.col("yc") - F.col("yr")).alias("d")).filter("d is not null")
    return with_exact(d, [], [F.count("*").alias("n_pairs"), F.avg("d").alias("mean_difference"), F.stddev_samp("d").alias("sd_difference")], {"median_difference": ("d", 0.5)})


def set_contrast(df: DataFrame, match_set: str, role: Column, outcome: str) -> DataFrame:
    """Per match set: target minus the mean of its references (``role`` true for the target)."""
    out = df.groupBy(match_set).agg(F.avg(F.when(role, F.col(outcome))).alias("target"), F.avg(F.when(~role, F.col(outcome))).alias("reference"), F.count_if(~role).alias("n_references"))
    return out.filter("target is not null and reference is not null").withColumn("contrast", F.col("target") - F.col("reference"))


def device_overlap(df: DataFrame, device: str, label: str) -> DataFrame:
    """Counts of both labels per device, whether devices with both exist, whether device and label are confounded perfectly."""
    per = df.groupBy(device).agg(F.count_if(F.col(label) == 1).alias("n_1"), F.count_if(F.col(label) == 0).alias("n_0")).withColumn("both", (F.col("n_1") > 0) & (F.col("n_0") > 0))
    whole = per.agg((~F.max("both")).alias("perfect_confounding"), F.count_if("both").alias("n_devices_with_both"))
    return per.crossJoin(whole)


def head_similarity(heads: DataFrame, model: str, position: str, coefficient: str, k: int) -> DataFrame:
    """For pairs of linear heads: cosine, Spearman, sign agreement, L2 distance, top-k Jaccard."""
    from .windows import top_k_jaccard

    ranked = average_rank(heads, coefficient, "_r", [model]).drop("n_tied")
    left = ranked.select(F.col(model).alias("model_a"), F.col(position).alias("_p"), F.col(coefficient).alias("x"), F.col("_r").alias("rx"))
    right = ranked.select(F.col(model).alias("model_b"), F.col(position).alias("_p"), F.col(coefficient).alias("y"), F.col("_r").alias("ry"))
    x, y = F.col("x"), F.col("y")
    out = left.join(right, "_p").filter("model_a < model_b").groupBy("model_a", "model_b").agg(_safe(F.sum(x * y), F.sqrt(F.sum(x * x) * F.sum(y * y))).alias("cosine"), F.corr("rx", "ry").alias("spearman"), F.avg((F.signum(x) == F.signum(y)).cast("double")).alias("sign_agreement"), F.sqrt(F.sum((x - y) ** 2)).alias("l2"))
    top = top_k_jaccard(heads, model, position, coefficient, k).select("model_a", "model_b", "jaccard")
    return out.join(top, ["model_a", "model_b"], "left").withColumn("top_k_jaccard", F.coalesce("jaccard", F.lit(0.0))).drop("jaccard")


def detectable_effect(df: DataFrame, value: str, group: str) -> DataFrame:
    """Least standardized and raw difference of two groups seen with 80 % power at 5 %."""
    out = df.filter(F.col(group).isin(0, 1)).agg(F.count_if(F.col(group) == 1).alias("n_1"), F.count_if(F.col(group) == 0).alias("n_0"), F.stddev_samp(value).alias("sd"))
    z = 1.959963984540054 + 0.8416212335729143
    return out.withColumn("mde_sd", z * F.sqrt(1 / F.col("n_1") + 1 / F.col("n_0"))).withColumn("mde", F.col("mde_sd") * F.col("sd"))


def gates(summary: DataFrame, rules: Mapping[str, Column]) -> DataFrame:
    """(gate, passed) rows from one summary row; an unknown value fails."""
    return summary.select(F.explode(F.array(*[F.struct(F.lit(n).alias("gate"), F.coalesce(ok, F.lit(False)).alias("passed")) for n, ok in rules.items()])).alias("x")).select("x.*")


def covariate_available(df: DataFrame, group: str, column: str, least: float = 0.8) -> bool:
    """Whether a covariate is observed for ``least`` of both groups with two shared levels."""
    rows = df.filter(F.col(group).isin(0, 1))
    parts = rows.groupBy(group).agg((F.count(column) / F.count("*")).alias("seen")).collect()
    levels = rows.filter(F.col(column).isNotNull()).groupBy(F.col(column).cast("string").alias("level")).agg(F.count_distinct(group).alias("groups"))
    return len(parts) == 2 and all(r.seen >= least for r in parts) and levels.filter("groups = 2").limit(2).count() == 2
