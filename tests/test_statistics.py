"""Statistics, resampling, models and maps against NumPy on small fixtures."""

import math

import numpy as np
import pytest
from pyspark.sql import functions as F

from tessera.functions import clean, tails
from tessera.operators import aggregate, checks, link, maps, models, resample, stats, windows


def test_tails():
    assert tails.normal_two_sided(1.959963984540054) == pytest.approx(0.05, abs=1e-12)
    assert tails.t_two_sided(2.2281388519649385, 10) == pytest.approx(0.05, abs=1e-9)
    assert tails.chi2_sf(3.841458820694124, 1) == pytest.approx(0.05, abs=1e-9)
    assert tails.chi2_sf(18.307038053275146, 10) == pytest.approx(0.05, abs=1e-9)
    assert tails.fisher_two_sided(3, 1, 1, 3) == pytest.approx(0.4857142857142857)
    assert tails.t_quantile(0.975, 10) == pytest.approx(2.2281388519649385, abs=1e-6)


@pytest.fixture(scope="module")
def effects():
    r = np.random.default_rng(3)
    n = 300
    age, x, sex = r.uniform(40, 80, n), r.integers(0, 2, n), r.choice(["F", "M"], n)
    y = 4 * x + 0.1 * age + (sex == "M") + r.normal(0, 1, n)
    return [(f"p{i}", float(age[i]), int(x[i]), str(sex[i]), float(y[i]), int(i % 30)) for i in range(n)]


def _design(rows):
    age = np.array([r[1] for r in rows])
    z = (age - age.mean()) / age.std()
    return np.column_stack([np.ones(len(rows)), [r[2] for r in rows], z, z**2, [r[3] == "M" for r in rows]]).astype(float), np.array([r[4] for r in rows])


def test_hc3_and_clustered_errors(spark, effects):
    df = spark.createDataFrame(effects, "id string, age double, exposed int, sex string, y double, site int")
    x, y = _design(effects)
    inv = np.linalg.inv(x.T @ x)
    beta = inv @ x.T @ y
    e, h = y - x @ beta, np.einsum("ij,jk,ik->i", x, inv, x)
    hc3 = inv @ (x.T * (e / (1 - h)) ** 2) @ x @ inv
    got = stats.adjusted_effect(df, "y", "exposed", ["age"], ["sex"])
    assert got["estimate"] == pytest.approx(beta[1]) and got["se"] == pytest.approx(math.sqrt(hc3[1, 1]))
    assert got["ci_low"] > 3.5 and abs(got["estimate"] - 4) < 0.3
    site = np.array([r[5] for r in effects])
    s = np.array([(x[site == k] * e[site == k, None]).sum(0) for k in range(30)])
    v = 30 / 29 * 299 / 295 * inv @ s.T @ s @ inv
    assert stats.clustered_effect(df, "y", "exposed", "site", ["age"], ["sex"])["se"] == pytest.approx(math.sqrt(v[1, 1]))


def test_benjamini_hochberg(spark):
    df = spark.createDataFrame([(1, 0.01), (2, 0.04), (3, 0.03), (4, float("nan"))], "id int, p double")
    got = {r.id: r.q_value for r in stats.benjamini_hochberg(df, "p", ["id"]).collect()}
    assert [got[i] for i in (1, 2, 3)] == pytest.approx([0.03, 0.04, 0.04]) and got[4] is None


def test_auroc_and_average_precision(spark):
    r = np.random.default_rng(0)
    y, s = r.integers(0, 2, 200), np.round(r.uniform(0, 1, 200), 1)
    got = stats.discrimination(spark.createDataFrame(list(zip(y.tolist(), s.tolist())), "y int, s double"), "y", "s").first()
    pairs = s[y == 1][:, None] - s[y == 0][None]
    assert got.auroc == pytest.approx(((pairs > 0) + 0.5 * (pairs == 0)).mean())
    ap = sum(((s[y == 1] == t).sum() / (y == 1).sum()) * ((y == 1) & (s >= t)).sum() / (s >= t).sum() for t in np.unique(s))
    assert got.average_precision == pytest.approx(ap)


def test_concordance_of_a_shifted_copy(spark):
    df = spark.createDataFrame([(float(a), float(a - 2)) for a in range(30, 60)], "a double, b double")
    row = stats.agreement(df, "a", "b").first()
    assert row.mean_abs_difference == 2.0 and row.concordance > 0.95 and row.spearman == pytest.approx(1.0)


def test_within_set_difference(spark):
    rows = [("a", 0, 0.0), ("a", 1, 1.0), ("b", 0, 0.0), ("b", 1, 2.0), ("c", 0, 1.0), ("c", 1, 2.0), ("d", 0, 0.0), ("d", 1, 3.0)]
    df = spark.createDataFrame([(f"u{i}", *r) for i, r in enumerate(rows)], "u string, s string, g int, m double")
    row = resample.permutation_test(df, "u", "g", ["m"], 50, 1, ["s"]).first()
    assert row.difference == 1.75 and 0 < row.p_fwer <= 1
    assert resample.set_bootstrap(df, "s", "g", "m", 20, 1).first().difference == 1.75


def test_planted_patch_is_found(spark):
    r = np.random.default_rng(5)
    rows = [(i, int(i < 20), y, x, float(r.normal() + 4 * (i < 20 and (y, x) == (1, 2)))) for i in range(40) for y in range(4) for x in range(4)]
    df = spark.createDataFrame(rows, "u int, g int, row int, col int, v double")
    got = {(r.row, r.col): r.p_fwer for r in resample.patch_test(df, "u", "g", "row", "col", "v", 60, 3).collect()}
    assert got[(1, 2)] < 0.05 and sum(p < 0.05 for p in got.values()) <= 2


def test_sign_flip(spark):
    r = np.random.default_rng(1)
    df = spark.createDataFrame([(i, float(2 + r.normal() * 0.5), float(r.normal())) for i in range(16)], "pair int, a double, b double")
    got = {x.metric: x.p_fwer for x in resample.sign_flip_test(df, "pair", ["a", "b"], 99, 2).collect()}
    assert got["a"] < 0.05 < got["b"]


@pytest.fixture(scope="module")
def vectors(spark):
    r = np.random.default_rng(8)
    x = r.normal(size=(120, 8))
    y = x[:, 0] * 2 - x[:, 1] + r.normal(0, 0.3, 120)
    rows = [(f"p{i // 2}", [float(v) for v in x[i]], float(y[i]), int(y[i] > 0)) for i in range(120)]
    return x, y, spark.createDataFrame(rows, "who string, v array<double>, y double, label int")


def test_ridge_matches_closed_form(vectors):
    x, y, df = vectors
    _, heads = models.ridge_oof(models.assert_no_leak(models.folds(df, "who", 4, 1), "who"), "v", "y", "fold", 8, 10.0)
    final = heads.filter("fold = -1").first()
    xc, yc = x - x.mean(0), y - y.mean()
    assert final.coef == pytest.approx(np.linalg.solve(xc.T @ xc + 10 * np.eye(8), xc.T @ yc).tolist())


def test_logistic_out_of_fold(vectors):
    _, _, df = vectors
    scored, heads = models.logistic_oof(models.folds(df, "who", 3, 1, "label"), "v", "label", "fold", (0.1,), group="who")
    assert stats.discrimination(scored, "label", "probability").first().auroc > 0.9
    assert heads.count() == 4


def test_calibration_modes(spark):
    df = spark.createDataFrame([(50.0, 65.0, 55.0, 1.0), (60.0, 65.0, 55.0, 1.0)], "p double, mean_y double, mean_prediction double, shrunk_slope double")
    assert [r[0] for r in df.select(models.calibrated(F.col("p"), "intercept")).collect()] == [60.0, 70.0]


def test_harmonizer_takes_a_shift_out(spark):
    r = np.random.default_rng(2)
    rows = []
    for i in range(240):
        src, lab = ("a", "b")[i % 2], (i // 2) % 2
        v = r.normal(size=4) + 3 * (src == "b")
        rows.append((f"p{i}", float(r.uniform(50, 70)), "F" if i % 3 else "M", src, lab, [float(q) for q in v]))
    df = spark.createDataFrame(rows, "who string, age double, sex string, src string, y int, v array<double>")
    dom = lambda x: x.withColumn("d", (F.col("src") == "b").cast("int"))
    assert aggregate.vector_shift(dom(df), "d", "v").first().median_abs_smd > 2.5
    fit = models.harmonizer(df, "v", "src", "a", "age", "sex", "y", 4)
    done = models.harmonize_vectors(df, fit, "v", "src")
    assert aggregate.vector_shift(dom(done), "d", "v").first().median_abs_smd < 0.2
    same = done.filter("src = 'a'").select("who", "v").join(df.withColumnRenamed("v", "w"), "who").filter("v != w").count()
    assert same == 0


def test_patch_contributions_add_up(spark):
    r = np.random.default_rng(4)
    tokens = r.normal(size=(2, 6, 5))
    g, b, coef = r.normal(size=5), r.normal(size=5), r.normal(size=5)
    rows = [(i, p, [float(v) for v in tokens[i, p]]) for i in range(2) for p in range(6)]
    df = spark.createDataFrame(rows, "image int, patch int, token array<double>")
    heads = spark.createDataFrame([("h", [float(c) for c in coef], 0.5)], "model string, coef array<double>, intercept double")
    mean = tokens.mean(1)
    norm = (mean - mean.mean(1, keepdims=True)) / np.sqrt(mean.var(1, keepdims=True) + 1e-6)
    score = (norm * g + b) @ coef + 0.5
    parts = maps.patch_contributions(df, g.tolist(), b.tolist(), heads)
    scores = spark.createDataFrame([(i, "h", float(score[i])) for i in range(2)], "image int, model string, score double")
    row = maps.reconstruction_error(parts, scores).first()
    assert row.n == 2 and row.max_error < 1e-10


def test_region_enrichment(spark):
    rows = [(0, y, x, 5.0 if (y, x) == (2, 2) else 0.1) for y in range(6) for x in range(6)]
    grid = spark.createDataFrame(rows, "image int, row int, col int, value double")
    centers = spark.createDataFrame([(0, 2.0, 2.0)], "image int, cy double, cx double")
    masks = maps.circular_masks(centers, 6, 6, F.lit(1.0), F.lit(2.0))
    got = {r.region: r.enrichment for r in maps.region_metrics(grid, masks).collect()}
    assert got["disc"] > 1 > got["annulus"] and maps.localization(grid, masks).first().hit


def test_tails_are_disjoint(spark):
    df = spark.createDataFrame([(f"p{i:02d}", float(p)) for i, p in enumerate(np.linspace(0.01, 0.99, 20))], "who string, p double")
    got = windows.tails(df, "p", "who", 0.10).collect()
    low, high = [r.p for r in got if r.tail == "bottom"], [r.p for r in got if r.tail == "top"]
    assert len(low) == len(high) == 2 and max(low) < min(high)


def test_key_and_flag_checks(spark):
    df = spark.createDataFrame([("A", 1), ("A", 2)], "who string, x int")
    with pytest.raises(checks.CheckFailed):
        checks.assert_unique(df, ["who"])
    with pytest.raises(checks.CheckFailed):
        link.join_validated(df, df, ["who"])
    with pytest.raises(Exception, match="unknown flag"):
        df.select(clean.closed_flag(F.lit("maybe"))).collect()


def test_paths_and_archives(spark, tmp_path):
    import zipfile

    from tessera.sources import readers

    df = spark.createDataFrame([("2209017_BL/7732381/retinal_left.jpeg",), ("x.bgen.bgi",), ("file.csv.gz",)], "p string")
    who, eye = clean.path_identity(F.col("p"))
    assert [tuple(r) for r in df.select(who, eye, clean.extension(F.col("p"))).collect()] == [("7732381", "L", ".jpeg"), (None, None, ".bgen.bgi"), (None, None, ".csv.gz")]
    with zipfile.ZipFile(tmp_path / "r.zip", "w") as z:
        for n in ("1234567/retinal_left.jpg", "1234567/retinal_right.jpg", "7654321/retinal_left.jpg"):
            z.writestr(n, b"x" * 10)
    members = readers.archive_members(spark.createDataFrame([(str(tmp_path / "r.zip"),)], "path string")).withColumn("release", F.lit("r"))
    row = aggregate.release_summary(members, "release", "member_class", ("stored_bytes", "bytes"), "participant_id", "eye").first()
    assert (row.n_images, row.n_people, row.n_complete_pairs) == (3, 2, 1)


def test_readers_and_upsert(spark, tmp_path):
    from tessera.sources import readers

    (tmp_path / "a.csv").write_text('id,note\n1,"two\nlines"\n2,"x"\n')
    got = readers.read_auto(spark, str(tmp_path / "a.csv"))
    assert got.count() == 2 and dict(got.dtypes) == {"id": "string", "note": "string"}
    (tmp_path / "w.dat").write_text("FID  IID\n 1   a\n2 b\n")
    assert [tuple(r) for r in readers.read_whitespace(spark, str(tmp_path / "w.dat")).orderBy("FID").collect()] == [("1", "a"), ("2", "b")]
    profile = {r.path.rsplit("/", 1)[1]: (r.delimiter, r.n_columns) for r in readers.header_profile(spark, str(tmp_path / "*.csv")).collect()}
    assert profile == {"a.csv": (",", 2)}
    names = {r["name"]: r.extension for r in readers.file_inventory(spark, str(tmp_path)).collect()}
    assert names["a.csv"] == ".csv"
    path = f"file://{tmp_path}/t"
    first = spark.createDataFrame([(1, "a"), (2, "b")], "id int, v string")
    for _ in range(2):
        readers.upsert(spark, path, first, ["id"])
    readers.upsert(spark, path, spark.createDataFrame([(2, "c", 1.0), (3, "d", 2.0)], "id int, v string, w double"), ["id"])
    assert sorted(tuple(r) for r in readers.read_table(spark, path).collect()) == [(1, "a", None), (2, "c", 1.0), (3, "d", 2.0)]
    spark.createDataFrame([(1, 50)], "id int, age long").write.parquet(str(tmp_path / "b/one"))
    spark.createDataFrame([(2, 51.5)], "id int, age double").write.parquet(str(tmp_path / "b/two"))
    both = readers.read_batches(spark, str(tmp_path / "b/*/*.parquet"), "id int, age double, eye string", ["id"])
    assert sorted(tuple(r) for r in both.collect()) == [(1, 50.0, None), (2, 51.5, None)]


def test_band_join_is_the_brute_force(spark):
    r = np.random.default_rng(6)
    a, b = [(i, float(v)) for i, v in enumerate(r.uniform(-5, 5, 40))], [(i, float(v)) for i, v in enumerate(r.uniform(-5, 5, 50))]
    got = link.band_pairs(spark.createDataFrame(a, "i int, x double"), spark.createDataFrame(b, "j int, y double"), ("x", "y"), 0.4)
    assert {(r.i, r.j) for r in got.collect()} == {(i, j) for i, x in a for j, y in b if abs(x - y) <= 0.4}
