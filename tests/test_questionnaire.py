"""The batched comparison of answers against one variable at a time in NumPy and plain Python."""

import math
import random

import numpy as np
import pytest
from pyspark.sql import functions as F

from tessera.functions import tails
from tessera.operators import questionnaire
from tessera.operators.checks import CheckFailed

SCHEMA = "who int, g int, age double, sex string, visit string, set string, smoke int, iron double, odd int, colour string, flag string, text string, rare double"
KINDS = {"smoke": ("binary", "a"), "iron": ("continuous", "a"), "odd": ("binary", "b"), "colour": ("categorical", "b"), "flag": ("categorical", "b"), "text": ("continuous", "b"), "rare": ("continuous", "c"), "gone": ("binary", "c")}


def people(seed=5, n=260):
    r = random.Random(seed)
    rows = []
    for i in range(n):
        g, age = i % 2, r.uniform(45, 85)
        smoke = None if r.random() < 0.1 + 0.2 * g else int(r.random() < 1 / (1 + math.exp(-(0.7 * g + (age - 65) / 15 - 0.3))))
        iron = None if r.random() < 0.1 else round(2.0 * g + 0.1 * age + r.gauss(0, 2), 1)
        rows.append((i, g, age, r.choice(["F", "M", None]) if i % 9 == 0 else r.choice(["F", "M"]), r.choice(["BL", "F1", "F2"]), f"set{i // 6}", smoke, iron, r.choice([0, 1, 2]), r.choice(["red", "green", "blue", None]), r.choice(["yes", "no"]) if g else r.choice(["yes", "no", "no"]), r.choice(["1.5", "2", "x", None]), 1.0 if i < 12 else None))
    return rows


@pytest.fixture(scope="module")
def found(spark):
    df = spark.createDataFrame(people(), SCHEMA).repartition(3)
    return {c: [{x.variable: x for x in t.collect()} for t in questionnaire.compare(df, "who", "g", KINDS, ["age"], ["sex", "visit"], c)] for c in ("set", None)}


def model(rows, column, cluster, logistic):
    """(coefficient, its error) of the group by plain formulas."""
    use = [x for x in rows if x[column] is not None and x[3] is not None]
    y, g = np.array([x[column] for x in use], float), np.array([x[1] for x in use], float)
    x = np.column_stack([np.ones(len(y)), g, [r[2] for r in use], [r[3] == "M" for r in use], [r[4] == "F1" for r in use], [r[4] == "F2" for r in use]]).astype(float)
    if logistic:
        b = np.zeros(x.shape[1])
        for _ in range(50):
            m = 1 / (1 + np.exp(-x @ b))
            inverse = np.linalg.inv(x.T @ (x * (m * (1 - m))[:, None]))
            b = b + inverse @ x.T @ (y - m)
        e = y - 1 / (1 + np.exp(-x @ b))
    else:
        inverse = np.linalg.inv(x.T @ x)
        b = inverse @ x.T @ y
        e = y - x @ b
    if cluster:
        names = sorted({r[5] for r in use})
        s = np.array([(x * e[:, None])[[r[5] == c for r in use]].sum(0) for c in names])
        meat = s.T @ s * len(names) / (len(names) - 1) * (len(y) - 1) / (len(y) - x.shape[1])
    else:
        w = e if logistic else e / (1 - ((x @ inverse) * x).sum(1))
        meat = x.T @ (x * (w**2)[:, None])
    return len(y), b[1], math.sqrt((inverse @ meat @ inverse)[1, 1])


@pytest.mark.parametrize("cluster", ["set", None])
@pytest.mark.parametrize(("name", "column"), [("smoke", 6), ("iron", 7)])
def test_adjusted_models(found, cluster, name, column):
    got = found[cluster][0][name]
    n, b, se = model(people(), column, cluster, name == "smoke")
    assert (got.adjusted_status, got.adjusted_n) == ("ok", n)
    assert got.adjusted_coefficient == pytest.approx(b, rel=1e-7) and got.adjusted_se == pytest.approx(se, rel=1e-7)
    assert got.adjusted_p == pytest.approx(tails.normal_two_sided(b / se)) == got.p_value
    assert got.adjusted_ci_low == pytest.approx(b - 1.959963984540054 * se)
    assert got.adjusted_covariance == ("cluster_robust" if cluster else "HC0" if name == "smoke" else "HC3")
    assert got.odds_ratio == (pytest.approx(math.exp(b)) if name == "smoke" else None)
    assert got.adjusted_n_clusters == (44 if cluster else None)


def plain_fisher(a, b, c, d):
    p = {x: math.comb(a + c, x) * math.comb(b + d, a + b - x) for x in range(max(0, a - d), min(a + b, a + c) + 1)}
    return sum(v for v in p.values() if v <= p[a] * (1 + 1e-7)) / sum(p.values())


def test_plain_tests(found):
    rows, got = people(), found[None][0]
    smoke = [(x[1], x[6]) for x in rows if x[6] is not None]
    cells = [sum(x == (g, v) for x in smoke) for g in (1, 0) for v in (1, 0)]
    assert got["smoke"].unadjusted_p == pytest.approx(plain_fisher(*cells)) and got["smoke"].test == "fisher_exact"
    a, b = (np.array([x[7] for x in rows if x[1] == g and x[7] is not None]) for g in (1, 0))
    both = np.concatenate([a, b])
    ranks = np.array([(both < v).sum() + ((both == v).sum() + 1) / 2 for v in a])
    u, n = ranks.sum() - len(a) * (len(a) + 1) / 2, len(both)
    ties = sum((both == v).sum() ** 3 - (both == v).sum() for v in set(both.tolist()))
    sd = math.sqrt(len(a) * len(b) / 12 * (n + 1 - ties / (n * (n - 1))))
    assert got["iron"].mann_whitney_p == pytest.approx(2 * tails.normal_sf((abs(u - len(a) * len(b) / 2) - 0.5) / sd))
    va, vb = a.var(ddof=1) / len(a), b.var(ddof=1) / len(b)
    assert got["iron"].unadjusted_p == pytest.approx(tails.t_two_sided((a.mean() - b.mean()) / math.sqrt(va + vb), (va + vb) ** 2 / (va**2 / (len(a) - 1) + vb**2 / (len(b) - 1))))
    assert got["iron"].effect == pytest.approx((a.mean() - b.mean()) / math.sqrt(((len(a) - 1) * a.var(ddof=1) + (len(b) - 1) * b.var(ddof=1)) / (n - 2)))
    for name, column in (("colour", 9), ("flag", 10)):
        levels = sorted({x[column] for x in rows} - {None})
        m = np.array([[sum(x[1] == g and x[column] == v for x in rows) for v in levels] for g in (1, 0)], float)
        e = m.sum(1, keepdims=True) * m.sum(0) / m.sum()
        far = np.abs(m - e)
        chi2 = ((far - (np.minimum(0.5, far) if len(levels) == 2 else 0)) ** 2 / e).sum()
        assert got[name].unadjusted_p == pytest.approx(tails.chi2_sf(chi2, len(levels) - 1)) and got[name].effect == pytest.approx(math.sqrt(chi2 / m.sum()))
        assert (got[name].n_levels, got[name].adjusted_status) == (len(levels), "not_fit_for_categorical")
    assert got["odd"].status == "invalid_binary_codes" and got["gone"].status == "column_missing" and got["rare"].status == "insufficient_numeric_records"
    assert (got["text"].n_1 + got["text"].n_0) == sum(x[11] in ("1.5", "2") for x in rows)
    # families are adjusted apart; what has no p value has none afterwards
    ps = sorted(got[v].p_value for v in ("smoke", "iron"))
    assert sorted(got[v].q_value for v in ("smoke", "iron")) == [pytest.approx(min(2 * ps[0], ps[1])), pytest.approx(ps[1])]
    assert got["gone"].q_value is None


def test_missing_answers(found):
    rows, got = people(), found["set"][1]
    assert set(got) == set(KINDS) - {"gone"}
    n = [sum(x[1] == g for x in rows) for g in (1, 0)]
    gone = [sum(x[1] == g and x[6] is None for x in rows) for g in (1, 0)]
    r = got["smoke"]
    assert (r.n_1, r.n_0, r.missing_1, r.missing_0) == (*n, *gone)
    assert r.p_value == pytest.approx(plain_fisher(n[0] - gone[0], gone[0], n[1] - gone[1], gone[1])) and r.missing_share_1 == gone[0] / n[0]


def test_jobs_do_not_grow_with_variables(spark):
    base = spark.createDataFrame(people(), SCHEMA)
    jobs = []
    for many in (2, 9):
        df = base.withColumns({f"b{i}": F.col("smoke") for i in range(many)} | {f"c{i}": F.col("iron") + i for i in range(many)})
        group = f"answers-{many}"
        spark.sparkContext.setJobGroup(group, group)
        questionnaire.compare(df, "who", "g", {f"b{i}": ("binary", "") for i in range(many)} | {f"c{i}": ("continuous", "") for i in range(many)}, ["age"], ["sex"], "set")
        jobs.append(len(spark.sparkContext.statusTracker().getJobIdsForGroup(group)))
    spark.sparkContext.setLocalProperty("spark.jobGroup.id", None)
    assert abs(jobs[0] - jobs[1]) <= 3


def test_identifiers_are_no_covariates(spark, monkeypatch):
    monkeypatch.setattr(questionnaire, "MAX_LEVELS", 20)
    with pytest.raises(CheckFailed, match="covariate"):
        questionnaire.compare(spark.createDataFrame(people(), SCHEMA), "who", "g", {"iron": ("continuous", "a")}, [], ["set"])


@pytest.mark.parametrize("cells", [(3, 9, 8, 2), (0, 5, 7, 0), (10, 0, 0, 0), (1, 1, 1, 1), (40, 60, 55, 45), (2, 300, 9, 280), (0, 0, 0, 0)])
def test_fisher_is_the_sum_over_all_tables(cells):
    assert tails.fisher_two_sided(*cells) == pytest.approx(plain_fisher(*cells), rel=1e-9)


def test_fisher_of_large_tables_is_quick():
    p = tails.fisher_two_sided(500_000, 500_500, 499_000, 500_500)
    z = (500_000 / 1_000_500 - 499_000 / 999_500) / math.sqrt(0.25 * (1 / 1_000_500 + 1 / 999_500))
    assert p == pytest.approx(tails.normal_two_sided(z), rel=0.01)
