"""Forms that replace windows over whole groups, keyed tables by parts, and values of heads that SQL can't give."""

import hashlib
import math
import random

import numpy as np
import pytest
from pyspark.sql import functions as F

from tessera.operators import models, questionnaire, resample, stats, windows
from tessera.operators.checks import CheckFailed
from tessera.sources import readers
from tessera.streaming import handoff


def grouped(seed, n=120):
    r = random.Random(seed)
    return [(i, r.choice(["a", "b", None]), float(r.randint(0, 15)), r.uniform(-1, 1)) for i in range(n)]


@pytest.fixture(params=[7, 10**6])
def window_rows(request, monkeypatch):
    """Most rows of a window: few, so that many ranges are needed, or all."""
    monkeypatch.setattr(windows, "SCAN_ROWS", request.param)
    return request.param


def test_ranks_in_ranges(spark, window_rows):
    rows = grouped(1)
    df = spark.createDataFrame(rows, "id int, g string, v double, w double").repartition(5)
    got = {r.id: r.k for r in windows.ranked(df, ["g"], [F.col("v"), F.col("id")], "k").collect()}
    known = {r.id: r.k for r in windows.ranked(df, ["g"], [F.col("v"), F.col("id")], "k", F.floor(F.col("v") / 4)).collect()}
    for g in ("a", "b", None):
        own = sorted((r[2], r[0]) for r in rows if r[1] == g)
        assert [got[i] for _, i in own] == [known[i] for _, i in own] == list(range(1, len(own) + 1))
    whole = {r.id: r.k for r in windows.numbered(df, "id", "k").collect()}
    assert whole == {i: i + 1 for i in range(len(rows))}


def test_no_window_holds_more_than_a_range(spark, monkeypatch):
    monkeypatch.setattr(windows, "SCAN_ROWS", 50)
    df = spark.range(4000).selectExpr("id", "cast(1 as int) as tied")  # one value: ties are cut apart by the key
    sizes = [r["count"] for r in windows._ranges(df, [], [F.col("tied"), F.col("id")]).groupBy("_range").count().collect()]
    assert len(sizes) > 60 and max(sizes) <= 150
    found = windows.tails(df.withColumn("v", F.col("tied").cast("double")), "v", "id", 0.1).groupBy("tail").agg(F.min("id").alias("a"), F.max("id").alias("b"), F.count("*").alias("n")).collect()
    assert {(r.tail, r.a, r.b, r.n) for r in found} == {("bottom", 0, 399, 400), ("top", 3600, 3999, 400)}


@pytest.mark.parametrize("descending", [False, True])
def test_running_sums_and_minima(spark, descending, window_rows):
    rows = list({(r[1], r[2]): r for r in grouped(2)}.values())  # distinct values in each group
    df = spark.createDataFrame(rows, "id int, g string, v double, w double").repartition(3)
    got = {r.id: (r.total, r.low) for r in windows.running(df, ["g"], "v", {"total": F.col("id")}, {"low": F.col("w")}, descending).collect()}
    for i, g, v, _ in rows:
        before = [r for r in rows if r[1] == g and (r[2] >= v if descending else r[2] <= v)]
        after = [r for r in rows if r[1] == g and (r[2] <= v if descending else r[2] >= v)]
        assert got[i] == (sum(r[0] for r in before), min(r[3] for r in after))


def test_batches_and_spaced_ranks_in_ranges(spark, window_rows):
    rows = [(i, "ab"[i % 3 == 0]) for i in range(60)]
    df = spark.createDataFrame(rows, "id int, g string").repartition(4)
    batches = {r.id: r.batch_index for r in windows.fixed_batches(df, ["g"], ["id"], 7).collect()}
    spaced = {(r.g, r.id) for r in windows.evenly_spaced(df, ["g"], ["id"], 4).collect()}
    for g in "ab":
        own = [i for i, x in rows if x == g]
        assert [batches[i] for i in own] == [k // 7 for k in range(len(own))]
        assert {i for x, i in spaced if x == g} == {own[round(k * (len(own) - 1) / 3)] for k in range(4)}


def test_contiguous_intervals(spark):
    rows = [("whole", 0, 4), ("whole", 4, 9), ("whole", 9, 11), ("gap", 0, 4), ("gap", 5, 9), ("late", 2, 4), ("twice", 0, 4), ("twice", 4, 6), ("twice", 4, 8), ("over", 0, 5), ("over", 3, 5), ("over", 5, 8), (None, 0, 3)]
    got = {r.g: (r.n_intervals, r.contiguous, r.covered_to) for r in windows.contiguous(spark.createDataFrame(rows, "g string, a int, b int"), ["g"], "a", "b").collect()}
    assert got == {"whole": (3, True, 11), "gap": (2, False, 4), "late": (1, False, 0), "twice": (3, False, 4), "over": (3, False, 5), None: (1, True, 3)}


def test_group_aggregates_on_rows(spark):
    rows = grouped(3, 40)
    df = spark.createDataFrame(rows, "id int, g string, v double, w double")
    got = {r.id: (r.n, r.m) for r in windows.with_aggregates(df, ["g"], n=F.count("*"), m=F.avg("v")).collect()}
    for i, g, *_ in rows:
        own = [r[2] for r in rows if r[1] == g]
        assert got[i] == (len(own), pytest.approx(sum(own) / len(own)))
    assert windows.with_aggregates(df.limit(0), [], n=F.count("*")).count() == 0


def test_balanced_sample_takes_the_first_of_each_class(spark):
    rows = [(i, ["x", "x", "y"][i % 3]) for i in range(90)] + [(100, None)]
    df = spark.createDataFrame(rows, "id int, c string")
    got = windows.balanced_sample(df, "c", "id", 4).groupBy("c").count().collect()
    assert {r.c: r["count"] for r in got} == {"x": 30, "y": 30}


def test_adjusted_p_values(spark):
    r = random.Random(5)
    rows = [(i, r.choice(["f", "g", None]), r.choice([None, float("nan"), 0.04, 0.04, r.random()])) for i in range(80)]
    got = {x.id: x.q_value for x in stats.benjamini_hochberg(spark.createDataFrame(rows, "id int, fam string, p double"), "p", ["id"], ["fam"]).collect()}
    for fam in ("f", "g", None):
        own = sorted((p, i) for i, f, p in rows if f == fam and p is not None and not math.isnan(p))
        for p, i in own:
            best = min(x * len(own) / sum(y <= x for y, _ in own) for x, _ in own if x >= p)
            assert got[i] == pytest.approx(min(1.0, best))
    assert all(got[i] is None for i, _, p in rows if p is None or math.isnan(p)) and len(got) == len(rows)


def test_keyed_table_by_parts(spark, tmp_path, monkeypatch):
    monkeypatch.setattr(readers, "MAX_PARTS", 3)
    path, want = f"file://{tmp_path}/t", {}
    for k in range(9):
        batch = [(i, f"{k}", float(k)) for i in range(k, k + 3)]
        want |= {i: v for i, v, _ in batch}
        readers.upsert(spark, path, spark.createDataFrame(batch, "id int, v string, w double"), ["id"], part=k)
        if k == 4:  # a repeated micro-batch
            readers.upsert(spark, path, spark.createDataFrame(batch, "id int, v string, w double"), ["id"], part=k)
    assert {r.id: r.v for r in readers.read_table(spark, path).collect()} == want
    assert len(list(tmp_path.glob("t/part=*"))) <= 6 and len(list(tmp_path.glob("t/base=*"))) <= 2
    # the newest version wins inside a batch
    readers.upsert(spark, path, spark.createDataFrame([(1, "old", 1.0), (1, "new", 2.0)], "id int, v string, w double"), ["id"], "w")
    assert {r.id: r.v for r in readers.read_table(spark, path).collect()} == want | {1: "new"}
    assert readers.read_table(spark, f"file://{tmp_path}/none") is None


def test_levels_bound_what_upserts_write(spark, tmp_path, monkeypatch):
    monkeypatch.setattr(readers, "MAX_PARTS", 4)
    path, plan, want = f"file://{tmp_path}/t", [], {}
    write = readers._read

    def noted(session, where, names):
        out = write(session, where, names)
        plan.append(out.count())
        return out

    monkeypatch.setattr(readers, "_read", noted)
    many, size = 40, 5
    for k in range(many):
        batch = [(k * size + i, f"{k}") for i in range(size - 1)] + [(0, f"{k}")]  # new keys, and one that comes again and again
        want |= dict(batch)
        readers.upsert(spark, path, spark.createDataFrame(batch, "id int, v string").coalesce(1), ["id"])
    merges = list(plan)
    # each row is written again once for each level: log4(40) of them at most
    assert sum(merges) <= many * size * 3 and max(len(list(tmp_path.glob(f"t/{x}=*"))) for x in ("part", "run")) <= 12
    assert {r.id: r.v for r in readers.read_table(spark, path).collect()} == want
    # parts that runs hold are not written again
    readers.upsert(spark, path, spark.createDataFrame([(1, "again")], "id int, v string"), ["id"], part=3)
    assert {r.id: r.v for r in readers.read_table(spark, path).collect()} == want


def test_replayed_micro_batch_changes_nothing(spark, tmp_path):
    target = f"file://{tmp_path}/target"
    name = "batch_000000000_000000004"
    first = spark.createDataFrame([(0, "pass", name), (1, "fail", name), (2, "pass", name)], "id long, ok string, batch string")
    last = spark.createDataFrame([(3, "pass", name)], "id long, ok string, batch string")
    for number, df in ((0, first), (0, first), (1, last), (1, last)):
        handoff._settle(spark, df, number, target, "id", ["ok"], None)
    assert {r.id for r in readers.read_table(spark, f"{target}/rows").collect()} == {0, 2, 3}
    state = handoff.ledger(spark, target).collect()
    assert len(state) == 1 and state[0].complete and state[0].n_rows == 4
    assert spark.read.parquet(f"{target}/pending=000000001").count() == 0
    assert handoff.progress(handoff.ledger(spark, target), 4).first().finished


# heads


@pytest.fixture(scope="module")
def people(spark):
    r = np.random.default_rng(3)
    rows = []
    for i in range(120):
        y = i % 2
        v = r.normal(size=4) + (1.5 * y if i % 4 < 2 else 0)
        source = "b" if i % 3 == 0 else "a"
        rows.append((i, y, source, [float(x) + (5.0 if source == "b" else 0.0) for x in v], [float(x) for x in v], float(50 + i % 30), "F" if r.random() < 0.5 else "M", "yes" if y else "no"))
    return spark.createDataFrame(rows, "id int, y int, source string, moved array<double>, v array<double>, age double, sex string, answer string")


def test_shortcuts(people):
    dealt = models.folds(people.withColumn("nothing", F.lit("x")), "id", 3, 1, "y")
    got = {r.model: r for r in models.shortcut_baselines(dealt, "y", {"answer": (["answer"], []), "nothing": (["nothing"], [])}, "fold", "id").collect()}
    assert got["answer"].auroc == 1.0 and got["nothing"].auroc == pytest.approx(0.5, abs=0.2) and got["answer"].n == 120


def test_domain_is_seen_and_harmonized_away(people):
    marked = people.withColumn("d", (F.col("source") == "b").cast("int"))
    assert models.domain_auc(marked, "moved", "d", "id", 3) > 0.99
    dealt = models.folds(marked, "id", 3, 1, "source")
    done = models.harmonize_crossfit(dealt, "fold", "moved", "source", "a", age="age", sex="sex", label="y", dim=4)
    means = {r.source: np.array(r.m) for r in done.groupBy("source").agg(F.array(*[F.avg(F.col("moved")[k]) for k in range(4)]).alias("m")).collect()}
    assert np.abs(means["a"] - means["b"]).max() < 1.0
    with pytest.raises(Exception, match="elements expected"):
        models.harmonizer(marked, "moved", "source", "a", "age", "sex", "y", 5)


def test_components_and_cross_heads(people):
    x = np.array([r.v for r in people.orderBy("id").select("v").collect()])
    got = np.array([r.z for r in models.principal_components(people, "v", 2, "z").orderBy("id").select("z").collect()])
    _, s, vt = np.linalg.svd(x - x.mean(axis=0), full_matrices=False)
    assert np.allclose(np.abs(got), np.abs(x @ vt[:2].T))
    dealt = models.folds(people, "id", 3, 1)
    own, heads = models.ridge_oof(dealt, "v", "age", "fold", 4)
    row = models.evaluate_across(own, "v", "age", "prediction", heads.filter("fold = 0")).first()
    truth = {r.id: (r.age, r.prediction) for r in own.collect()}
    assert row.n == 120 and row.own_mae == pytest.approx(np.mean([abs(p - a) for a, p in truth.values()]))


def test_questionnaire_values(spark):
    rows = [(g, float(x), c) for g, x, c in [(1, 3, "u"), (1, 4, "u"), (1, 5, "v"), (1, 6, "u"), (1, 9, "u"), (1, 8, "v"), (0, 1, "v"), (0, 2, "v"), (0, 3, "v"), (0, 2, "u"), (0, 4, "v"), (0, 1, "v")]]
    df = spark.createDataFrame([(i, *r) for i, r in enumerate(rows)], "id int, g int, x double, c string")
    got = {r.variable: r for r in questionnaire.compare(df, "id", "g", {"x": ("continuous", "text"), "c": ("categorical", "other")}, least=5, correction=False)[0].collect()}
    a, b = np.array([r[1] for r in rows if r[0]]), np.array([r[1] for r in rows if not r[0]])
    assert got["x"].effect == pytest.approx((a.mean() - b.mean()) / math.sqrt((a.var(ddof=1) + b.var(ddof=1)) / 2))
    m = np.array([[sum(r[0] == g and r[2] == c for r in rows) for c in "uv"] for g in (1, 0)], float)
    e = m.sum(1, keepdims=True) * m.sum(0) / m.sum()
    chi2 = ((m - e) ** 2 / e).sum()
    assert got["c"].effect == pytest.approx(math.sqrt(chi2 / 12)) and got["c"].p_value == pytest.approx(math.erfc(math.sqrt(chi2 / 2)))
    assert (got["x"].n_1, got["x"].n_0, got["x"].status) == (6, 6, "ok")


def test_stacked_tables_have_the_same_columns(spark):
    from tessera.operators.link import stacked

    a = spark.range(2).withColumn("x", F.lit(1))
    assert stacked([a, a.select("x", "id")]).count() == 4
    with pytest.raises(CheckFailed):
        stacked([a, spark.range(1)])


def test_no_window_is_read_again_for_each_row(spark):
    from pyspark.sql import functions as F

    from tessera.operators import link, windows

    left = spark.createDataFrame([(1, "a", 1.0), (2, "a", 9.0), (3, None, 5.0), (4, "b", 5.0)], "i int, k string, x double")
    right = spark.createDataFrame([("a", 2.0), ("a", 7.5), (None, 5.0)], "k string, y double")
    near = [link.nearest_distance(left, right, ("x", "y"), ["k"]), link.nearest_distance(left, right, ("x", "y"), ["k"], 3.0)]
    ends = windows.running_min_from_end(left, [], "i", "x", "least")
    for df in [*near, ends]:
        assert "unboundedfollowing" not in df._jdf.queryExecution().toString().lower()
    for df in near:  # an unknown key has no partner
        assert {r.i: r.nearest_distance for r in df.collect()} == {1: 1.0, 2: 1.5, 3: None, 4: None}
    assert {r.i: r.least for r in ends.collect()} == {1: 1.0, 2: 5.0, 3: 5.0, 4: 5.0}


def test_micro_batch_has_tasks_by_its_size(spark, tmp_path):
    target = f"file://{tmp_path}/target"
    name = "batch_000000000_000000004"
    rows = spark.createDataFrame([(i, "pass", name) for i in range(4)], "id long, ok string, batch string")
    for setting, value in (("spark.sql.adaptive.enabled", "false"), ("spark.sql.shuffle.partitions", "40")):  # as inside a stream
        spark.conf.set(setting, value)
    try:
        spark.sparkContext.setJobGroup("settle", "")
        handoff._settle(spark, rows, 0, target, "id", ["ok"], None)
        status = spark.sparkContext.statusTracker()
        tasks = [status.getStageInfo(i).numTasks for j in status.getJobIdsForGroup("settle") for i in status.getJobInfo(j).stageIds if status.getStageInfo(i)]
        assert tasks and max(tasks) <= 4, tasks
    finally:
        spark.sparkContext.setJobGroup("other", "")
        spark.conf.set("spark.sql.adaptive.enabled", "true")
        spark.conf.set("spark.sql.shuffle.partitions", "4")
    assert handoff.ledger(spark, target).first().asDict() == {"batch": name, "start": 0, "stop": 4, "n_rows": 4, "complete": True, "batch_id": 0}


def exchanged(spark):
    """Bytes that all stages so far wrote for exchanges."""
    gateway = spark.sparkContext._gateway
    stages = spark.sparkContext._jsc.sc().statusStore().stageList(None, False, False, gateway.new_array(gateway.jvm.double, 0), gateway.jvm.java.util.ArrayList())
    return sum(stages.apply(i).shuffleWriteBytes() for i in range(stages.size()))


def test_hashed_numbers_are_those_of_spark(spark):
    numbers = [0, 9, 10, 99, 100, 12345, 10**9 - 1, 10**12 + 7]
    for seed, rep in ((3, 0), ("any seed", 17), ("s" * 60, 5)):
        wanted = spark.createDataFrame([(i,) for i in numbers], "i long").select("i", windows.portable_hash(seed, F.lit(rep), F.col("i"), bits=48)).collect()
        assert windows.hashed_numbers(seed, rep, np.array([r[0] for r in wanted])).tolist() == [r[1] for r in wanted]


@pytest.mark.parametrize("near", [None, ((1, 0.45),), ((1, 0.0),)])
def test_draws_and_quantiles_of_replicates(spark, monkeypatch, near):
    """Draws over several buckets and slices; quantiles with all values, with some, and with too few."""
    monkeypatch.setattr(resample, "SLICE", 3)
    monkeypatch.setattr(resample, "PACKED", 40)
    if near:
        monkeypatch.setattr(resample, "NEAR", near)
    rows = [(g, f"u{i}", float((i * 37) % 11) if i % 9 else None) for g, n in (("a", 25), ("b", 1), ("c", 8), (None, 4)) for i in range(n)]
    df = spark.createDataFrame(rows, "g string, u string, v double").repartition(3)
    wanted = {}
    for g in "abc":
        number = lambda *parts: int(hashlib.md5("|".join(map(str, parts)).encode()).hexdigest()[:12], 16)
        own = sorted((r for r in rows if r[0] == g), key=lambda r: (number(5, "unit", r[1]), r[1]))
        for rep in range(7):
            values = [own[number(5, rep, i) % len(own)][2] for i in range(len(own))]
            known = [v for v in values if v is not None]
            wanted[g, rep] = (len(values), sum(known), float(np.median(known)) if known else None)
    got = resample.replicate_aggregates(df, ["g"], "u", 7, 5, [F.count("*").alias("n"), F.coalesce(F.sum("v"), F.lit(0.0)).alias("s")], "m", F.col("v"), 0.5)
    assert {(r.g, r.rep): (r.n, r.s, r.m) for r in got.collect()} == wanted
    drawn = resample.bootstrap_groups(df, ["g"], "u", 7, 5).groupBy("g", "rep").agg(F.count("*").alias("n"))
    assert {(r.g, r.rep): r.n for r in drawn.collect()} == {k: v[0] for k, v in wanted.items()}


def test_draws_cross_buckets(spark):
    n = 70_000
    df = spark.range(n).withColumn("g", F.col("id") % 2)
    start = exchanged(spark)
    got = resample.bootstrap_groups(df, ["g"], "id", 10, 1).groupBy("g", "rep").agg(F.count("*").alias("n"), F.sum("id").alias("s")).collect()
    assert exchanged(spark) - start < 5 * 10 * n  # rows for each replicate take some dozen bytes a draw
    assert len(got) == 20 and all(r.n == n // 2 for r in got)
    assert all(abs(r.s / r.n - n / 2) < 6 * n / math.sqrt(12 * n / 2) for r in got)
    assert len({r.s for r in got}) == 20


def test_labels_are_dealt_where_the_block_is(spark, monkeypatch):
    rows = [(f"u{i}", i % 40 if i % 17 else None, i % 3 % 2, float((i * 7919) % 101), None if i % 5 == 0 else float(i % 13)) for i in range(4000)]
    df = spark.createDataFrame(rows, "u string, b int, g int, m double, k double").repartition(3).cache()
    df.count()
    start = exchanged(spark)
    near = resample.permutation_test(df, "u", "g", ["m", "k"], 25, 8, ["b"]).collect()
    assert exchanged(spark) - start < 500_000  # 25 replicates of 4000 rows are not dealt out one by one
    dealt = {(r.rep, r.u): r.g for r in resample._shuffled_blocks(df.select("b", "u", "g"), "u", "g", 25, 8, ["b"]).select("u", F.posexplode("_labels").alias("rep", "g")).collect()}
    assert dealt == {(r.rep, r.u): r.g for r in resample._shuffled(df.select("u", "g", "b"), "u", "g", 25, 8, ["b"]).collect()}
    monkeypatch.setattr(resample, "BLOCK_ROWS", 90)  # blocks are larger: the way across tasks
    wide = {r.metric: r for r in resample.permutation_test(df, "u", "g", ["m", "k"], 25, 8, ["b"]).collect()}
    assert {r.metric for r in near} == {"m", "k"}
    assert all(r.p_fwer == wide[r.metric].p_fwer and r.p_unadjusted == wide[r.metric].p_unadjusted and r.difference == pytest.approx(wide[r.metric].difference) for r in near)


def test_products_are_summed_by_task(spark):
    """A task gives one row of sums for each variable: no products of every row pass through Spark."""
    r = np.random.default_rng(2)
    x, y = r.normal(size=(600, 3)), r.normal(size=600)
    rows = [("ab"[i % 2], float(y[i]), x[i].tolist(), str(i % 30)) for i in range(600)]
    df = spark.createDataFrame(rows, "variable string, y double, x array<double>, cluster string").repartition(4)
    got = questionnaire._summed(df, 3, lambda name, x, y: (y**2, y - 1))
    for k, name in enumerate("ab"):
        u, v = x[k::2], y[k::2]
        assert np.allclose(got[name][0], (u * v[:, None] ** 2).T @ u) and np.allclose(got[name][1], (v - 1) @ u)


def test_band_pairs_are_dealt_by_pairs(spark, monkeypatch):
    from tessera.operators import link

    r = random.Random(5)
    special = [None, float("nan"), float("inf"), float("-inf")]
    a = [(i, r.choice("ab"), r.choice([r.uniform(0, 3), 1.0, *special])) for i in range(400)] + [(i, None, 1.0) for i in range(400, 403)]
    b = [(i, r.choice("ab"), r.choice([r.uniform(-2, 3), 1.5, *special])) for i in range(300)]
    monkeypatch.setattr(link, "TASK_PAIRS", 200, raising=False)
    got = link.band_pairs(spark.createDataFrame(a, "i int, g string, x double"), spark.createDataFrame(b, "j int, g string, y double"), ("x", "y"), 0.5, ["g"])
    assert got.columns == ["g", "i", "x", "j", "y"]
    want = sorted((i, j) for i, g, x in a for j, h, y in b if g == h and x is not None and y is not None and abs(x - y) <= 0.5)
    assert sorted((p.i, p.j) for p in got.collect()) == want and len(want) > 1000
    # the small input is not put together for one task again, and no task holds a whole bucket
    sizes = [n for n in got.rdd.glom().map(len).collect() if n]
    assert len(sizes) > 5 and max(sizes) < len(want) / 3, (sizes, len(want))
    empty = link.band_pairs(spark.createDataFrame([], "i int, x double"), spark.createDataFrame([(1, 1.0)], "j int, y double"), ("x", "y"), 0.5)
    assert empty.count() == 0
