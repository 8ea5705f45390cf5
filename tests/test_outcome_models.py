"""Models of several outcomes without leaks, domain heads behind a harmonizer, two heads compared, logistic effects: against NumPy."""

import math
import random

import numpy as np
import pytest
from pyspark.sql import functions as F

from tessera.operators import models, stats
from tessera.operators.checks import CheckFailed


def table(n=240, dim=6, seed=4):
    r = np.random.default_rng(seed)
    y = r.integers(0, 2, n)
    v = r.normal(0, 1, (n, dim)) * np.array([6, 4, 1, 1, 1, 1]) + y[:, None] * np.array([0, 0, 1.2, 0, 0, 0])
    fold = np.arange(n) % 3
    v[fold == 2] += np.where(np.arange(dim) == 5, 25 * (2 * y[:, None] - 1)[fold == 2], 0)  # a direction that only one fold's rows have
    age = [None if i % 7 == 0 else float(60 + 5 * y[i] + r.normal(0, 6)) for i in range(n)]
    site = [None if i % 11 == 0 else "pqr"[i // 3 % 3] if fold[i] != 1 or i % 2 else "only1" for i in range(n)]
    return [(i, int(fold[i]), v[i].tolist(), int(y[i]), None if i % 10 == 0 else int(y[i] ^ (i % 13 == 0)), age[i], site[i]) for i in range(n)]


@pytest.fixture(scope="module")
def rows(spark):
    return spark.createDataFrame(table(), "who int, fold int, v array<double>, y int, z int, age double, site string").repartition(3)


def training_map(v, k):
    mean, scale = v.mean(0), v.std(0)
    values, axes = np.linalg.eigh(np.cov(((v - mean) / scale).T, bias=True))
    return lambda x: ((x - mean) / scale) @ axes[:, np.argsort(values)[::-1][:k]]


def test_components_come_from_the_other_folds(rows):
    data = table()
    v, fold = np.array([r[2] for r in data]), np.array([r[1] for r in data])
    for f, (matrix, offset) in models.fold_components(rows, "v", "fold", 6, 2).items():
        want = training_map(v[fold != f], 2)(v)
        got = np.array([r.pc for r in models.projected(rows, "v", matrix, offset, "pc").orderBy("who").select("pc").collect()])
        assert np.allclose(np.abs(got), np.abs(want), atol=1e-8)
        assert not np.allclose(np.abs(got), np.abs(training_map(v, 2)(v)), atol=0.05)


def test_features_come_from_the_training_rows(rows):
    data = [r for r in table() if r[1] != 1]
    got = {r.who: r.f for r in models.fold_features(rows.filter("fold != 1"), rows, ["age"], ["site"], "f").select("who", "f").collect()}
    median = float(np.median([r[5] for r in data if r[5] is not None]))
    sites = [r[6] for r in data if r[6] is not None]
    most = min(set(sites), key=lambda s: (-sites.count(s), s))
    for who, _, _, _, _, age, site in table():
        assert got[who] == [median if age is None else age, *[float((site or most) == s) for s in sorted(set(sites))]]
    assert sum(got[r[0]][1:] == [0.0] * len(set(sites)) for r in table()) == sum(r[6] == "only1" for r in table())


def test_no_leak_changes_the_result(spark, rows):
    predictions, metrics, availability = models.compare_outcomes(rows, ["y", "z", "none"], "v", 6, "fold", "who", ["age"], ["site"], k=2, least=(20, 20))
    found = {(r.outcome, r.model): r for r in metrics.collect()}
    assert set(found) == {(o, m) for o in "yz" for m in ("clinical", "embedding", "combined")}
    assert {r.outcome: (r.n_positive + r.n_negative, r.n_unknown, r.status) for r in availability.collect()} == {"y": (240, 0, "ok"), "z": (216, 24, "ok"), "none": (0, 0, "column_missing")}
    assert predictions.filter("outcome = 'y' and model = 'clinical'").count() == 240 and found["z", "combined"].n == 216
    # components of all rows see the direction that one fold alone has, and give another answer
    leaky = models.principal_components(rows, "v", 2, "pca")
    other = models.compare_models(leaky, "y", {"embedding": "pca"}, "fold", "who").first().auroc
    assert abs(found["y", "embedding"].auroc - other) > 0.02
    with pytest.raises(CheckFailed):
        models.compare_outcomes(rows, ["y"], "v", 6, "fold", "who", [], [], least=(500, 20))


def test_outcome_that_one_fold_has_alone(spark, rows):
    got = models.outcome_availability(rows.withColumn("w", (F.col("fold") == 0).cast("int")), ["w"], "fold", (10, 10)).first()
    assert got.status == "one_class_in_training"


def test_identifier_is_no_feature(rows, monkeypatch):
    monkeypatch.setattr(models, "MAX_LEVELS", 50)
    with pytest.raises(CheckFailed, match="levels"):
        models.fold_features(rows, rows, [], ["who"], "f")
    with pytest.raises(CheckFailed, match="levels"):
        models.one_hot(rows, ["who"], [])


def test_domain_head_behind_a_harmonizer(spark):
    r = np.random.default_rng(8)
    data = []
    for i in range(360):
        site, y = "ab"[i % 3 == 0], int(i % 4 > 0)
        v = r.normal(0, 1, 4) + np.array([1.5 * (site == "b"), 0.5 * y, 0, 0])
        data.append((i, site, y, float(60 + r.normal(0, 5)), "FM"[i % 2], v.tolist()))
    df = spark.createDataFrame(data, "who int, site string, y int, age double, sex string, v array<double>").repartition(3)
    fold = models.nested_domain_auc(df, "v", "site", "a", "b", "age", "sex", "y", "who", 4, 3, most=60)
    by = fold.collect()
    assert len(by) == 3 and all(x.n_train <= 120 and x.n_train % 2 == 0 and x.n_test > 30 for x in by)
    summary = models.domain_summary(fold).first()
    assert summary.auc_signed_mean == pytest.approx(np.mean([x.auc for x in by])) and summary.auc_mean >= 0.5
    assert summary.auc_mean < 0.68  # the planted shift is gone on people that nothing was learned from
    plain = models.domain_auc(df.filter("y = 1").withColumn("d", (F.col("site") == "b").cast("int")), "v", "d", "who", 3)
    assert plain > 0.8
    with pytest.raises(CheckFailed):
        models.nested_domain_auc(df.filter("site = 'a' or y = 1"), "v", "site", "a", "b", "age", "sex", "y", "who", 4, 3)


def test_two_heads(spark):
    r = random.Random(3)
    data = []
    for i in range(160):
        p, age = "tr"[i % 2], r.uniform(40, 80)
        data.append((p, i, age, 20 + age * (0.5 if p == "t" else 0.9) + r.gauss(0, 2), age + r.gauss(0, 2)))
    got = models.compare_heads(spark.createDataFrame(data, "p string, who int, age double, own double, other double").repartition(3), "p", "t", "r", "who", "age", "own", "other", 80, 5).first()
    side = {p: np.array([x[2:] for x in data if x[0] == p]) for p in "tr"}
    error = np.abs(side["t"][:, 1] - side["t"][:, 0]) - np.abs(side["t"][:, 2] - side["t"][:, 0])
    slope = [np.polyfit(side[p][:, 0], side[p][:, 1], 1)[0] for p in "tr"]
    assert got.error_difference == pytest.approx(error.mean()) and got.slope_difference == pytest.approx(slope[0] - slope[1])
    assert got.error_mde == pytest.approx(2.8015852181129683 * error.std(ddof=1) / math.sqrt(80))
    assert got.error_ci_low < got.error_difference < got.error_ci_high and got.slope_ci_low < got.slope_difference < got.slope_ci_high
    assert got.slope_p == pytest.approx(1 / 80) and (got.n_target, got.n_reference) == (80, 80)


@pytest.mark.parametrize("cluster", [None, "site"])
def test_logistic_effect(spark, cluster):
    r = random.Random(6)
    data = [(i, i % 2, float(r.uniform(40, 80)), f"s{r.randrange(12)}") for i in range(200)]
    data = [(*x, int(r.random() < 1 / (1 + math.exp(-(0.8 * x[1] + (x[2] - 60) / 20))))) for x in data]
    got = stats.logistic_effect(spark.createDataFrame(data, "who int, g int, age double, site string, y int"), "y", "g", ("age",), (), cluster)
    age = np.array([x[2] for x in data])
    z = (age - age.mean()) / age.std()
    x, y = np.column_stack([np.ones(200), [d[1] for d in data], z, z * z]), np.array([d[4] for d in data], float)
    b = np.zeros(4)
    for _ in range(40):
        m = 1 / (1 + np.exp(-x @ b))
        inverse = np.linalg.inv(x.T @ (x * (m * (1 - m))[:, None]))
        b = b + inverse @ x.T @ (y - m)
    e = x * (y - m)[:, None]
    if cluster:
        s = np.array([e[[d[3] == c for d in data]].sum(0) for c in sorted({d[3] for d in data})])
        meat = s.T @ s * len(s) / (len(s) - 1) * 199 / 196
    else:
        meat = e.T @ e
    assert got["odds_ratio"] == pytest.approx(math.exp(b[1]), rel=1e-6) and got["se"] == pytest.approx(math.sqrt((inverse @ meat @ inverse)[1, 1]), rel=1e-6)


def test_classifiers_fitted_together_equal_those_fitted_alone(spark, rows):
    wide = rows.withColumn("_x", F.concat(F.array(F.coalesce("age", F.lit(60.0)), F.lit(3.0)), "v")).withColumns({"_y0": F.col("y").cast("double"), "_y1": F.col("z").cast("double"), "_fold": F.col("fold")})
    features = {f: wide.withColumn("_learner", F.lit(f)) for f in range(3)}
    ranges = {"clinical": (0, 2), "embedding": (2, 8), "combined": (0, 8)}
    heads = models._fit_together(features, dict.fromkeys(range(3), ranges), 2, 1.0)
    assert len(heads) == 18
    for f, i, model in [(0, 0, "combined"), (2, 1, "embedding"), (1, 1, "clinical")]:
        a, b = ranges[model]
        train = wide.filter((F.col("fold") != f) & F.col(f"_y{i}").isNotNull()).withColumn("part", F.slice("_x", a + 1, b - a))
        beta, bias = models._fit_logistic(train, "part", f"_y{i}", 1.0, True)
        assert np.allclose(heads[f, i, model][0], beta, atol=2e-4) and heads[f, i, model][1] == pytest.approx(bias, abs=1e-2)
