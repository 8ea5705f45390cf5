"""Answers of two groups compared, all variables at once.

A variable is ``binary`` (0 and 1), ``continuous`` or ``categorical``. Rows are turned into (variable, answer) once; every step is an aggregation keyed by
variable, so the number of jobs does not depend on how many variables there are, and the driver gets a few rows for each of them:

* missing answers per group, with Fisher's exact test;
* binary: prevalences and Fisher's test; continuous: moments, standardized difference, Welch's t and Mann-Whitney U from running counts of distinct answers;
  categorical: chi-square (Yates' correction for two levels) and Cramer's V from counts per level, which stay in Spark;
* binary and continuous: a regression on group and covariates over complete rows. Outer products of the design are summed by variable; logistic
  ones take Newton steps in which each variable moves on its own, in the same passes. Errors are clustered where there are ``MIN_CLUSTERS`` clusters, HC3
  (logistic: HC0) otherwise; p values and limits are normal;
* Benjamini-Hochberg within families over the primary p values: the adjusted one where there is one.

A design has a column for each level of the categorical covariates, ``MAX_LEVELS`` at most (else the call fails): dummies of identifiers are no covariates. For
each variable, columns that don't vary in its complete rows and the first level that occurs are left out.
"""

from __future__ import annotations

import math
from collections.abc import Mapping, Sequence

import numpy as np
import pyarrow as pa
from pyspark.ml.functions import array_to_vector, vector_to_array
from pyspark.ml.stat import Summarizer
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from ..functions import tails
from ..sources.shared import written
from .checks import CheckFailed, assert_unique, require_columns
from .quantiles import join_groups
from .stats import benjamini_hochberg
from .windows import running

KINDS = ("binary", "continuous", "categorical")
MAX_LEVELS = 200
MIN_CLUSTERS = 10
MIN_COMPLETE = 20
STEPS = 25
Z = 1.959963984540054

RESULT = {
    "variable": "string", "family": "string", "kind": "string", "status": "string", "n_1": "long", "n_0": "long", "mean_1": "double", "mean_0": "double", "difference": "double", "sd_1": "double", "sd_0": "double", "effect": "double",
    "n_levels": "long", "test": "string", "unadjusted_p": "double", "mann_whitney_p": "double", "adjusted_status": "string", "adjusted_n": "long", "adjusted_n_clusters": "long", "adjusted_covariance": "string", "adjusted_coefficient": "double",
    "adjusted_se": "double", "adjusted_ci_low": "double", "adjusted_ci_high": "double", "adjusted_p": "double", "odds_ratio": "double", "odds_ratio_ci_low": "double", "odds_ratio_ci_high": "double", "p_value": "double",
}


def _cells(names: Sequence[str], value) -> Column:
    return F.explode(F.array(*[F.struct(F.lit(n).alias("variable"), value(n).alias("x")) for n in names])).alias("c")


def _own(name: str) -> Column:
    """A column of the caller's, under the name that it has here."""
    return F.col(f"`_v_{name}`")


def _number(name: str) -> Column:
    return _own(name).try_cast("double")


def missing_table(rows: DataFrame, names: Sequence[str], families: Mapping[str, str]) -> DataFrame:
    """(variable, family, n and missing n of both groups, their shares, Fisher's p, q_value)."""
    side = lambda k: F.col("g") == k
    long = rows.select(F.col("_g").alias("g"), _cells(names, lambda n: _own(n).isNull())).select("g", "c.*")
    counts = long.groupBy("variable").agg(*[F.count_if(side(k)).alias(f"n_{k}") for k in (1, 0)], *[F.count_if(side(k) & F.col("x")).alias(f"missing_{k}") for k in (1, 0)])
    out = []
    for r in counts.collect():  # a row for each variable
        p = tails.fisher_two_sided(r.n_1 - r.missing_1, r.missing_1, r.n_0 - r.missing_0, r.missing_0) if r.n_1 + r.n_0 else None
        share = [m / n if n else None for m, n in ((r.missing_1, r.n_1), (r.missing_0, r.n_0))]
        out.append((r.variable, families[r.variable], r.n_1, r.n_0, r.missing_1, r.missing_0, *share, p))
    table = rows.sparkSession.createDataFrame(out, "variable string, family string, n_1 long, n_0 long, missing_1 long, missing_0 long, missing_share_1 double, missing_share_0 double, p_value double")
    return benjamini_hochberg(table, "p_value", ["variable"], ["family"])


def _numeric_tests(numbers: DataFrame, kinds: Mapping[str, str], least: int) -> dict[str, dict]:
    """Tests of binary and continuous variables without covariates; ``numbers``: variable, g, x (not null)."""
    g, x = F.col("g"), F.col("x")
    side = lambda k, f: f(F.when(g == k, x))
    facts = numbers.groupBy("variable").agg(
        *[f.alias(f"{n}_{k}") for k in (1, 0) for n, f in (("n", side(k, F.count)), ("mean", side(k, F.avg)), ("var", side(k, F.var_samp)), ("ones", F.count_if((g == k) & (x == 1))))], F.count_if(~x.isin(0.0, 1.0)).alias("other")
    )
    counts = numbers.groupBy("variable", "x").agg(F.count_if(g == 1).alias("a"), F.count("*").alias("t"))
    upto = running(counts, ["variable"], "x", {"upto": F.col("t")})
    t = F.col("t").cast("double")
    ranks = upto.groupBy("variable").agg(F.sum(F.col("a") * (F.col("upto") - (t - 1) / 2)).alias("ranks"), F.sum(t * t * t - t).alias("ties"))
    out = {}
    for r in join_groups(facts, ranks, ["variable"]).collect():  # a row for each variable
        a, b = r.n_1, r.n_0
        row = {"n_1": a, "n_0": b, "mean_1": r.mean_1, "mean_0": r.mean_0, "difference": r.mean_1 - r.mean_0 if a and b else None}
        out[r.variable] = row
        if min(a, b) < least:
            row["status"] = "insufficient_numeric_records"
        elif kinds[r.variable] == "binary" and r.other:
            row["status"] = "invalid_binary_codes"
        elif kinds[r.variable] == "binary":
            p = tails.fisher_two_sided(r.ones_1, a - r.ones_1, r.ones_0, b - r.ones_0)
            row |= {"status": "ok", "test": "fisher_exact", "unadjusted_p": p, "effect": row["difference"]}
        else:
            va, vb = r.var_1 / a, r.var_0 / b
            pooled = math.sqrt(((a - 1) * r.var_1 + (b - 1) * r.var_0) / (a + b - 2))
            row |= {"status": "ok", "test": "welch_t", "sd_1": math.sqrt(r.var_1), "sd_0": math.sqrt(r.var_0), "effect": row["difference"] / pooled if pooled > 0 else None}
            if va + vb > 0:
                row["unadjusted_p"] = tails.t_two_sided(row["difference"] / math.sqrt(va + vb), (va + vb) ** 2 / (va**2 / (a - 1) + vb**2 / (b - 1)))
            n, u = a + b, r.ranks - a * (a + 1) / 2
            sd = math.sqrt(max(a * b / 12 * ((n + 1) - r.ties / (n * (n - 1))), 0.0))
            row["mann_whitney_p"] = min(1.0, 2 * tails.normal_sf((abs(u - a * b / 2) - 0.5) / sd)) if sd else None
    return out


def _categorical_tests(levels: DataFrame, least: int, correction: bool) -> dict[str, dict]:
    """Chi-square tests; ``levels``: variable, g, x (text, not null). Levels stay in Spark."""
    cells = levels.groupBy("variable", "x").agg(F.count_if(F.col("g") == 1).alias("a"), F.count_if(F.col("g") == 0).alias("b"))
    c = F.col("a") + F.col("b")
    total = cells.groupBy("variable").agg(F.count("*").alias("k"), F.sum("a").alias("n_1"), F.sum("b").alias("n_0"), F.sum(F.col("a") ** 2 / c).alias("sa"), F.sum(F.col("b") ** 2 / c).alias("sb"), F.sum(1 / c).alias("inverse"))
    out = {}
    for r in total.collect():  # a row for each variable
        row = {"n_1": r.n_1, "n_0": r.n_0, "n_levels": r.k}
        out[r.variable] = row
        if min(r.n_1, r.n_0) < least:
            row["status"] = "insufficient_group_records"
        elif r.k < 2:
            row["status"] = "no_category_variation"
        else:
            n = r.n_1 + r.n_0
            chi2 = max(0.0, n * (r.sa / r.n_1 + r.sb / r.n_0 - 1))
            if r.k == 2 and correction:
                # all four cells of a 2 x 2 table are equally far from what is expected
                weight = n * (1 / r.n_1 + 1 / r.n_0) * r.inverse
                far = math.sqrt(chi2 / weight)
                chi2 = (far - min(0.5, far)) ** 2 * weight
            row |= {"status": "ok", "test": "chi_square", "unadjusted_p": tails.chi2_sf(chi2, r.k - 1), "effect": math.sqrt(chi2 / n), "adjusted_status": "not_fit_for_categorical"}
    return out


def _sum(column: Column) -> Column:
    return vector_to_array(Summarizer.sum(array_to_vector(column)))


def _summed(rows: DataFrame, p: int, weigh) -> dict[str, tuple[np.ndarray, np.ndarray]]:
    """{variable: (sum of w x x', sum of t x)} over rows (variable, x of length p, y), with (w, t) = weigh(variable, x, y): a task gives one row of sums for each variable."""

    def partial(batches):
        sums: dict[str, np.ndarray] = {}
        for name, x, y, _ in _designs(batches, p):
            w, t = weigh(name, x, y)
            found = np.concatenate([((x * w[:, None]).T @ x).ravel(), t @ x])
            sums[name] = sums[name] + found if name in sums else found
        if sums:
            yield pa.RecordBatch.from_arrays([pa.array(list(sums)), pa.array([s.tolist() for s in sums.values()], pa.list_(pa.float64()))], ["variable", "sums"])

    found = rows.mapInArrow(partial, "variable string, sums array<double>").groupBy("variable").agg(_sum(F.col("sums")).alias("sums")).collect()  # a row for each variable
    return {r.variable: (np.array(r.sums[: p * p]).reshape(p, p), np.array(r.sums[p * p :])) for r in found}


def _designs(batches, p: int):
    """(variable, design, answers, clusters) of each variable in each batch."""
    for batch in batches:
        names = batch.column("variable").dictionary_encode()
        x = batch.column("x").flatten().to_numpy(zero_copy_only=False).reshape(-1, p)
        y, at, clusters = batch.column("y").to_numpy(zero_copy_only=False), names.indices.to_numpy(), batch.column("cluster")
        for i, name in enumerate(names.dictionary.to_pylist()):
            own = np.flatnonzero(at == i)
            yield name, x[own], y[own], clusters.take(pa.array(own))


def _logistic(x: np.ndarray, beta: np.ndarray) -> np.ndarray:
    with np.errstate(over="ignore"):
        return 1 / (1 + np.exp(-(x @ beta)))


def _standardized(rows: DataFrame, numeric: Sequence[str], categorical: Sequence[str]) -> tuple[Column, int, list[tuple[int, int]]]:
    """(design of a row: intercept, group, numbers, one column for each level; its length; places of each covariate's levels)."""
    facts = rows.agg(F.count("*").alias("n"), *[f(_number(c)).alias(f"{k}_{i}") for i, c in enumerate(numeric) for k, f in (("m", F.avg), ("s", F.stddev_pop))]).first()
    cells = [F.lit(1.0), F.col("_g").cast("double"), *[(_number(c) - float(facts[f"m_{i}"] or 0.0)) / float(facts[f"s_{i}"] or 1.0) for i, c in enumerate(numeric)]]
    spans = []
    for c in categorical:
        levels = sorted(r[0] for r in rows.filter(_own(c).isNotNull()).select(_own(c).cast("string")).distinct().limit(MAX_LEVELS + 1).collect())
        if len(levels) > MAX_LEVELS:
            raise CheckFailed(f"{c} has more than {MAX_LEVELS} levels: it is no covariate")
        spans.append((len(cells), len(cells) + len(levels)))
        cells += [(_own(c).cast("string") == x).cast("double") for x in levels]
    return F.array(*cells), len(cells), spans


def _adjusted(long: DataFrame, kinds: Mapping[str, str], p: int, spans: Sequence[tuple[int, int]], clustered: bool) -> dict[str, dict]:
    """Regressions of all variables; ``long``: variable, y, x (design), cluster; complete rows, read once for each pass."""
    grams = _summed(long.withColumn("x", F.concat("x", F.array("y"))), p + 1, lambda name, x, y: (np.ones(len(y)), np.zeros(len(y))))
    facts = long.groupBy("variable").agg(F.count("*").alias("n"), F.min("y").alias("low"), F.max("y").alias("high"), vector_to_array(Summarizer.variance(array_to_vector("x"))).alias("spread"))
    clusters = long.select("variable", "cluster").distinct().groupBy("variable").agg(F.count("*").alias("clusters"))
    facts = facts.join(clusters, "variable").collect()  # a row for each variable
    fits, out = {}, {}
    for r in facts:
        gram = grams[r.variable][0]
        used = [0] + [j for j in range(1, p) if r.spread[j] > 1e-12]
        for a, b in spans:
            there = [j for j in range(a, b) if gram[j, j] > 0]
            used = [j for j in used if j != (there[0] if there else -1)]
        if r.n < MIN_COMPLETE or 1 not in used:
            out[r.variable] = {"adjusted_status": "insufficient_complete_records"}
        elif kinds[r.variable] == "binary" and not (r.low == 0 and r.high == 1):
            out[r.variable] = {"adjusted_status": "binary_outcome_lacks_both_levels"}
        else:
            fits[r.variable] = {"n": r.n, "used": used, "clusters": r.clusters, "gram": gram, "beta": np.zeros(p), "inverse": np.zeros((p, p)), "logistic": kinds[r.variable] == "binary"}
    if not fits:
        return out

    def full(small: np.ndarray, used: list[int]) -> np.ndarray:
        whole = np.zeros((p,) * small.ndim)
        whole[np.ix_(*[used] * small.ndim)] = small
        return whole

    for f in fits.values():
        if not f["logistic"]:
            u = f["used"]
            inverse = np.linalg.pinv(f["gram"][np.ix_(u, u)])
            f["beta"], f["inverse"] = full(inverse @ f["gram"][u, p], u), full(inverse, u)
    moving = [v for v, f in fits.items() if f["logistic"]]
    for _ in range(STEPS):
        if not moving:
            break
        betas = {v: fits[v]["beta"] for v in moving}

        def newton(name, x, y, betas=betas):
            m = _logistic(x, betas[name])
            return m * (1 - m), y - m

        still = []
        for v, (information, score) in _summed(long.filter(F.col("variable").isin(moving)), p, newton).items():
            f = fits[v]
            u = f["used"]
            inverse = np.linalg.pinv(information[np.ix_(u, u)])
            step = full(inverse @ score[u], u)
            f["beta"], f["inverse"] = f["beta"] + step, full(inverse, u)
            if np.abs(step).max() > 1e-10:
                still.append(v)
        moving = still
    for v in moving:
        out[v] = {"adjusted_status": "model_failed:no_convergence"}
        del fits[v]
    robust_of = {v: bool(clustered and f["clusters"] >= MIN_CLUSTERS) for v, f in fits.items()}
    models = {v: (f["logistic"], f["beta"], f["inverse"]) for v, f in fits.items()}

    def errors(name, x, y):
        logistic, beta, inverse = models[name]
        e = y - (_logistic(x, beta) if logistic else x @ beta)
        return e if logistic or robust_of[name] else e / np.maximum(1 - ((x @ inverse) * x).sum(1), 1e-12)

    def scores(batches):
        for name, x, y, cluster in _designs(batches, p):
            s = x * errors(name, x, y)[:, None]
            yield pa.RecordBatch.from_arrays([pa.array([name] * len(y)), cluster, *(pa.array(s[:, j]) for j in range(p))], ["variable", "cluster", *(f"s{j}" for j in range(p))])

    meats = {}
    if alone := [v for v, joint in robust_of.items() if not joint]:
        meats |= _summed(long.filter(F.col("variable").isin(alone)), p, lambda name, x, y: (errors(name, x, y) ** 2, np.zeros(len(y))))
    if joint := [v for v, joint in robust_of.items() if joint]:
        each = long.filter(F.col("variable").isin(joint)).mapInArrow(scores, "variable string, cluster string, " + ", ".join(f"s{j} double" for j in range(p)))
        each = each.groupBy("variable", "cluster").agg(*[F.sum(f"s{j}").alias(f"s{j}") for j in range(p)])
        each = each.select("variable", "cluster", F.array(*[f"s{j}" for j in range(p)]).alias("x"), F.lit(0.0).alias("y"))
        meats |= _summed(each, p, lambda name, x, y: (np.ones(len(y)), np.zeros(len(y))))
    for v, (meat, _) in meats.items():
        f = fits[v]
        n, k, g = f["n"], len(f["used"]), f["clusters"]
        robust = robust_of[v]
        factor = g / (g - 1) * (n - 1) / (n - k) if robust else 1.0
        se = math.sqrt(max(factor * (f["inverse"] @ meat @ f["inverse"])[1, 1], 0.0))
        b = float(f["beta"][1])
        row = {"adjusted_status": "ok", "adjusted_n": n, "adjusted_n_clusters": g if clustered else None, "adjusted_covariance": "cluster_robust" if robust else "HC0" if f["logistic"] else "HC3", "adjusted_coefficient": b, "adjusted_se": se}
        row |= {"adjusted_ci_low": b - Z * se, "adjusted_ci_high": b + Z * se, "adjusted_p": tails.normal_two_sided(b / se) if se > 0 else None}
        if f["logistic"]:
            with np.errstate(over="ignore"):
                row |= {n_: float(np.exp(z)) for n_, z in (("odds_ratio", b), ("odds_ratio_ci_low", b - Z * se), ("odds_ratio_ci_high", b + Z * se))}
        out[v] = row
    return out


def compare(df: DataFrame, who: str, group: str, variables: Mapping[str, tuple[str, str]], numeric: Sequence[str] = (), categorical: Sequence[str] = (), cluster: str | None = None, least: int = 10, correction: bool = True) -> tuple[DataFrame, DataFrame]:
    """(results, missingness) of ``variables`` ({name: (kind, family)}) between group 1 and group 0; one row for each person.

    Rows of other groups are left out. A variable that is no column has status column_missing. Covariates that are no columns are left out of the design.
    """
    require_columns(df, [who, group], "questionnaire")
    if unknown := {k for k, _ in variables.values()} - set(KINDS):
        raise ValueError(f"kinds of variables are {KINDS}, not {unknown}")
    there = [v for v in variables if v in df.columns]
    numeric, categorical = ([c for c in names if c in df.columns] for names in (numeric, categorical))
    cluster = cluster if cluster in df.columns else None
    keep = list(dict.fromkeys([*there, *numeric, *categorical, *([cluster] if cluster else [])]))
    assert_unique(df, [who], "questionnaire")
    rows = written(df.filter(F.col(group).isin(0, 1)).select(F.col(group).cast("int").alias("_g"), *[F.col(c).alias(f"_v_{c}") for c in keep]), "answers")
    kinds, families = {v: k for v, (k, _) in variables.items()}, {v: f for v, (_, f) in variables.items()}
    counted = [v for v in there if kinds[v] != "categorical"]
    named = [v for v in there if kinds[v] == "categorical"]
    found: dict[str, dict] = {v: {"status": "column_missing"} for v in variables if v not in there}
    if counted:
        numbers = rows.select(F.col("_g").alias("g"), _cells(counted, _number)).select("g", "c.*").filter("x is not null")
        found |= {v: {"status": "insufficient_numeric_records", "n_1": 0, "n_0": 0} for v in counted} | _numeric_tests(numbers, kinds, least)
    if named:
        levels = rows.select(F.col("_g").alias("g"), _cells(named, lambda n: _own(n).cast("string"))).select("g", "c.*").filter("x is not null")
        found |= {v: {"status": "insufficient_group_records", "n_1": 0, "n_0": 0} for v in named} | _categorical_tests(levels, least, correction)
    tested = [v for v in counted if found[v]["status"] == "ok"]
    if tested:
        design, p, spans = _standardized(rows, numeric, categorical)
        whole = [_number(c).isNotNull() for c in numeric] + [_own(c).isNotNull() for c in [*categorical, *([cluster] if cluster else [])]]
        complete = rows.filter(F.lit(True) if not whole else F.array_min(F.array(*whole)))
        long = complete.select(design.alias("x"), (_own(cluster) if cluster else F.lit("")).cast("string").alias("cluster"), F.explode(F.array(*[F.struct(F.lit(v).alias("variable"), _number(v).alias("y")) for v in tested])).alias("c"))
        long = written(long.select("c.variable", "c.y", "x", "cluster").filter("y is not null"), "complete")
        models = _adjusted(long, kinds, p, spans, cluster is not None)
        for v in tested:
            found[v] |= models.get(v, {"adjusted_status": "insufficient_complete_records"})
    for v, row in found.items():
        row |= {"variable": v, "family": families[v], "kind": kinds[v]}
        adjusted = row.get("adjusted_p")
        row["p_value"] = adjusted if adjusted is not None else row.get("unadjusted_p")
    schema = ", ".join(f"{n} {k}" for n, k in RESULT.items())
    table = df.sparkSession.createDataFrame([tuple(found[v].get(n) for n in RESULT) for v in variables], schema)
    gone = missing_table(rows, there, families)
    return benjamini_hochberg(table, "p_value", ["variable"], ["family"]), gone
