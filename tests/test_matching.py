"""Matching against a sequential greedy, small exact fixtures, and invariance to partitioning."""

import random

import pytest

from tessera.operators import matching as m
from tessera.operators.checks import CheckFailed


def people(spark, rows):
    return spark.createDataFrame(rows, "who string, age double, k int, sex string")


def greedy(rows, ratio, caliper, exact, whole, by_value):
    cases = [r for r in rows if r[2] == 1]
    free = {r[0]: r for r in rows if r[2] == 0}

    def near(c):
        found = [(abs(f[1] - c[1]), f[0]) for f in free.values() if abs(f[1] - c[1]) <= caliper and (not exact or (c[3] is not None and f[3] == c[3]))]
        return sorted(found)

    turn = sorted((0 if by_value else len(near(c)), c[1], c[0], c) for c in cases)
    out = set()
    for *_, c in turn:
        best = near(c)
        if len(best) >= (ratio if whole else 1):
            for d, f in best[:ratio]:
                out.add((c[0], f))
                del free[f]
    return out


def random_rows(seed, n=70):
    r = random.Random(seed)
    return [(f"p{i:03d}", round(r.uniform(40, 60), 1), int(r.random() < 0.3), r.choice(["F", "M", None])) for i in range(n)]


@pytest.mark.parametrize(("seed", "ratio", "exact", "whole", "order"), [(1, 2, True, True, "difficulty"), (2, 1, False, True, "value"), (3, 3, True, False, "difficulty"), (4, 2, False, False, "difficulty")])
def test_partition_form_is_the_sequential_greedy(spark, seed, ratio, exact, whole, order):
    rows = random_rows(seed)
    rule = m.Rule(ratio=ratio, caliper=0.7, exact=("sex",) if exact else (), whole=whole, order=order)
    pairs, audit = m.match(people(spark, rows).repartition(3), "who", "age", "k", rule)
    found = {(r.case_id, r.control_id) for r in pairs.collect()}
    assert found == greedy(rows, ratio, 0.7, exact, whole, order == "value")
    assert audit.count() == sum(r[2] for r in rows)


@pytest.mark.parametrize("whole", [True, False])
def test_round_form_is_the_partition_form(spark, whole):
    rows = random_rows(9, 50)
    rule = m.Rule(ratio=2, caliper=0.6, exact=("sex",), whole=whole)
    found = {(r.case_id, r.control_id) for r in m.match_rounds(people(spark, rows), "who", "age", "k", rule).collect()}
    assert found == greedy(rows, 2, 0.6, True, whole, False)


def test_two_controls_each_with_exact_sex(spark):
    rows = [("a", 60.0, 1, "F"), ("b", 70.0, 1, "M"), ("c", 60.2, 0, "F"), ("d", 60.4, 0, "F"), ("e", 69.7, 0, "M"), ("f", 71.0, 0, "M")]
    pairs, audit = m.match(people(spark, rows), "who", "age", "k", m.Rule(ratio=2, caliper=2.0, exact=("sex",)))
    assert pairs.count() == 4 and pairs.select("control_id").distinct().count() == 4
    assert audit.filter("matched").count() == 2
    sets = m.membership(pairs)
    assert sets.count() == 6
    assert {r.n for r in sets.filter("match_role = 'case'").groupBy("match_set_id").count().withColumnRenamed("count", "n").collect()} == {1}


def test_visits_of_one_person_serve_once(spark):
    rows = [("z1", 70.0, 1, "BL"), ("c1", 70.0, 0, "BL"), ("c1", 70.1, 0, "F1"), ("c2", 70.2, 0, "BL")]
    df = spark.createDataFrame(rows, "who string, age double, k int, visit string")
    pairs, _ = m.match(df, "who", "age", "k", m.Rule(ratio=2, caliper=1.0, order="value"), tie="visit", unique=False)
    assert {r.control_id for r in pairs.collect()} == {"c1", "c2"}


def test_repeated_people_are_rejected(spark):
    with pytest.raises(CheckFailed):
        m.match(people(spark, [("a", 1.0, 1, "F"), ("a", 2.0, 0, "F")]), "who", "age", "k", m.Rule())


def test_gower_handles_unknowns():
    import pandas as pd

    pool = pd.DataFrame({"band": ["x", None, "y"], "n": [1.0, 3.0, None]})
    got = m.gower({"band": "x", "n": 1.0}, pool, ["band", "n"], ["n"])
    assert got.tolist() == [0.0, 1.0, 1.0]
    none = m.gower({"band": None, "n": 2.0}, pool, ["band", "n"], ["n"])
    assert none.tolist() == [0.75, 0.5, 1.0]


def test_feasibility_counts_disjoint_pairs(spark):
    rows = [("a", 1.0, 1, "F"), ("b", 1.1, 1, "F"), ("c", 1.05, 0, "F"), ("d", 5.0, 0, "F"), ("e", 9.0, 1, "F")]
    r = m.feasibility(people(spark, rows), "who", "age", "k", [0.2]).first()
    assert (r.n_cases, r.n_with_candidate, r.max_pairs) == (3, 2, 1)


def test_pairs_do_not_depend_on_partitions(spark):
    rows = random_rows(17)
    found = [{tuple(r) for r in m.match(people(spark, rows).repartition(n), "who", "age", "k", m.Rule(ratio=1, caliper=0.5))[0].select("case_id", "control_id", "match_rank", "priority").collect()} for n in (1, 5)]
    assert found[0] == found[1]


@pytest.mark.parametrize(("order", "whole", "ratio"), [("difficulty", True, 2), ("value", True, 1), ("difficulty", False, 3)])
def test_dense_component_in_small_blocks(spark, order, whole, ratio):
    """No gap anywhere: several hundred rows within some calipers, cut into blocks of a dozen rows or one cell."""
    r = random.Random(ratio)
    rows = [(f"p{i:03d}", float(r.randint(40, 60)) if ratio == 2 else round(r.uniform(40, 60), 2), int(r.random() < 0.35), "F") for i in range(400)]
    rule = m.Rule(ratio=ratio, caliper=1.0, whole=whole, order=order)
    pairs, audit = m.match(people(spark, rows).repartition(3), "who", "age", "k", rule, block_rows=12)
    assert {(x.case_id, x.control_id) for x in pairs.collect()} == greedy(rows, ratio, 1.0, False, whole, order == "value")
    one, its = m.match(people(spark, rows), "who", "age", "k", rule, block_rows=10**9)
    assert sorted(map(tuple, pairs.collect())) == sorted(map(tuple, one.collect()))
    assert sorted(map(str, audit.collect())) == sorted(map(str, its.collect()))
    assert m._in_blocks(m._frame(people(spark, rows), "who", "age", "k", rule, None), rule, 12).groupBy("block").count().count() > 5


def test_covariate_distance_and_visits_in_small_blocks(spark):
    r = random.Random(8)
    rows = [(f"p{i:03d}", round(r.uniform(40, 60), 1), int(r.random() < 0.3), r.choice(["F", "M", None]), r.choice(["x", "y", None]), r.choice([1.0, 2.0, 5.0, None])) for i in range(300)]
    df = spark.createDataFrame(rows, "who string, age double, k int, sex string, band string, n double")
    rule = m.Rule(ratio=2, caliper=0.8, exact=("sex",), whole=False, null_matches=True, distance=("band", "n"), numeric=("n",))
    small, whole = (m.match(df, "who", "age", "k", rule, block_rows=b)[0] for b in (20, 10**9))
    assert small.count() and sorted(map(tuple, small.collect())) == sorted(map(tuple, whole.collect()))
    # controls with a second visit anywhere else: one person in all blocks
    seen = [(w, a, k, "BL") for w, a, k, *_ in rows] + [(w, round(r.uniform(40, 60), 1), 0, "F1") for w, _, k, *_ in rows if not k]
    visits = spark.createDataFrame(seen, "who string, age double, k int, visit string")
    for order in ("value", "difficulty"):
        rule = m.Rule(ratio=1, caliper=0.8, order=order)
        small, whole = (m.match(visits, "who", "age", "k", rule, tie="visit", unique=False, block_rows=b)[0] for b in (20, 10**9))
        got = small.collect()
        assert sorted(map(tuple, got)) == sorted(map(tuple, whole.collect())) and len({x.control_id for x in got}) == len(got)


def test_most_pairs_over_many_blocks(spark):
    rows = random_rows(21, 200)
    a, b = sorted(x[1] for x in rows if x[2]), sorted(x[1] for x in rows if not x[2])
    pairs = i = 0
    for x in a:
        while i < len(b) and b[i] < x - 0.3 - 1e-9:
            i += 1
        if i < len(b) and b[i] <= x + 0.3 + 1e-9:
            pairs, i = pairs + 1, i + 1
    some = sum(any(abs(x - y) <= 0.3 + 1e-9 for y in b) for x in a)
    for dense in (10**6, 3):  # by blocks, and by proposals
        got = m.feasibility(people(spark, rows), "who", "age", "k", [0.3], block_rows=15, dense_rows=dense).first()
        assert (got.n_cases, got.n_with_candidate, got.max_pairs) == (len(a), some, pairs)


def extremes_by_turns(rows, caliper):
    """Turns by (age, id); a case that knows its sex looks among equal controls while any control that is left knows its own."""
    out = set()
    for cohort in {r[4] for r in rows}:
        own = sorted((r for r in rows if r[4] == cohort), key=lambda r: (r[2], r[0]))
        size = min(max(1, -(-len(own) // 5)), len(own) // 2)
        free = own[:size]
        for c in sorted(own[-size:], key=lambda r: (r[1], r[0])):
            near = free
            if c[3] is not None and any(f[3] is not None for f in free):
                near = [f for f in free if f[3] == c[3]]
            best = min(near, key=lambda f: (abs(f[1] - c[1]), f[0]), default=None)
            if best is not None and abs(best[1] - c[1]) <= caliper:
                out.add((cohort, c[0], best[0]))
                free = [f for f in free if f is not best]
    return out


@pytest.mark.parametrize("seed", range(6))
def test_extremes_with_unknown_sexes(spark, seed):
    r = random.Random(seed)
    sexes = [["F", "M", None], ["F", None, None, None], ["F", "M"], [None], ["F", "M", "M", None], [None, None, "M"]][seed]
    rows = [(f"p{i:03d}", round(r.uniform(40, 60), 1), r.random(), r.choice(sexes), "xyz"[i % 3]) for i in range(120)]
    df = spark.createDataFrame(rows, "who string, age double, gap double, sex string, cohort string").repartition(3)
    found = m.match_extremes(df, "who", "age", "gap", "cohort", "sex", 0.2, m.Rule(caliper=30.0 if seed % 2 else 2.0))
    assert {(x.cohort, x.case_id, x.control_id) for x in found.collect()} == extremes_by_turns(rows, 30.0 if seed % 2 else 2.0)


@pytest.mark.parametrize(("values", "share", "ratio", "order", "exact"), [("many", 0.3, 1, "value", False), ("few", 0.3, 1, "difficulty", True), ("many", 0.7, 1, "difficulty", False), ("few", 0.6, 2, "value", False), ("many", 0.4, 3, "difficulty", True), ("one", 0.5, 2, "difficulty", False)])
def test_rounds_of_proposals_are_the_sequential_greedy(spark, values, share, ratio, order, exact):
    """Blocks of 9 controls inside one or two calipers: far more rows than a block in what every case can reach."""
    r = random.Random(ratio)
    age = {"many": lambda: round(r.uniform(40, 44), 2), "few": lambda: float(r.randint(40, 43)), "one": lambda: 40.0}[values]
    rows = [(f"p{i:03d}", age(), int(r.random() < share), r.choice(["F", "M", None])) for i in range(260)]
    reach = 0.07 if (values, ratio) == ("many", 3) else 1.5  # blocks wider and narrower than a caliper
    rule = m.Rule(ratio=ratio, caliper=reach, whole=False, order=order, exact=("sex",) if exact else ())
    pairs, audit = m.match(people(spark, rows).repartition(3), "who", "age", "k", rule, block_rows=9, dense_rows=20 if reach > 1 else 2)
    plain, its = m.match(people(spark, rows), "who", "age", "k", rule)
    assert {(x.case_id, x.control_id) for x in pairs.collect()} == greedy(rows, ratio, reach, exact, False, order == "value")
    assert sorted(map(tuple, pairs.select(plain.columns).collect())) == sorted(map(tuple, plain.collect()))
    columns = ["case_id", "case_value", "matched", "n_controls", "reason"]
    assert sorted(map(str, audit.select(columns).collect())) == sorted(map(str, its.select(columns).collect()))
    assert audit.filter("eligible_at_turn is null").count() > 0


def test_blocks_are_bounded(spark):
    from tessera.operators import proposals

    rows = [("s", f"c{i:04d}", float(i % 3) if i % 2 else i / 7) for i in range(600)]
    placed, blocks = proposals.cut(spark.createDataFrame(rows, "stratum string, id string, value double"), 10)
    sizes = {x.block: x["count"] for x in placed.groupBy("block").count().collect()}
    assert max(sizes.values()) <= 20 and len(sizes) == len(blocks.low) and sum(sizes.values()) == 600
    # a search to either side meets all blocks once
    for follow, first in ((blocks.right, proposals.starts(blocks, "s", -1.0)[1]), (blocks.left, proposals.starts(blocks, "s", 1e9)[0])):
        seen = []
        while first != proposals.END:
            seen.append(first)
            first = int(follow[first])
        assert sorted(seen) == sorted(sizes)


@pytest.mark.parametrize("rule", [{"distance": ("band", "nation"), "numeric": ("nation",)}, {"agree": "sex"}, {"distance": ("band",), "agree": "sex", "lowest": True}])
def test_classes_of_equal_covariates_are_the_rows_one_by_one(monkeypatch, rule):
    import pandas as pd

    r, columns = random.Random(5), ["id", "value", "is_case", "unknown", "tie", "taken", "agree", "loose", "band", "nation", "turn"]
    rows = [(f"p{i}", round(r.uniform(0, 3), 2), i % 2 == 0, r.random() < 0.1, "", float(r.randrange(40)) if i % 7 == 1 else None, r.choice(["F", "M", None]), r.choice([-1.0, 90.0]), r.choice([None, 1.0, 2.0]), r.choice([0, 5, 10]), float(i)) for i in range(300)]
    calls, plain = [], m.gower
    monkeypatch.setattr(m, "gower", lambda case, pool, *a: calls.append(len(pool)) or plain(case, pool, *a))
    frame, rule = pd.DataFrame(rows, columns=columns), m.Rule(ratio=2, whole=False, caliper=0.5, **rule)
    by_class = m._solve(frame, rule)
    assert not calls or max(calls) <= 9 * (3 if rule.agree else 1)  # a distance for each class, not for each control in reach
    monkeypatch.setattr(m, "CLASSES", 0)
    assert by_class == m._solve(frame, rule)


def sequential(cases, controls, cohort, caliper):
    """Turns by (age, id) with sexes that agree while any control that is left knows its own."""
    out, free = set(), list(controls)
    for c in sorted(cases, key=lambda r: (r[1], r[0])):
        known = c[3] is not None and any(f[3] is not None for f in free)
        best = min((f for f in free if not known or f[3] == c[3]), key=lambda f: (abs(f[1] - c[1]), f[0]), default=None)
        if best is not None and abs(best[1] - c[1]) <= caliper:
            out.add((cohort, c[0], best[0]))
            free.remove(best)
    return out


def test_blocks_that_hang_together_are_solved_once(spark, monkeypatch):
    """Cells of two calipers, all of which share controls with the next one: each waits for the one below instead of being solved at every change there."""
    r = random.Random(3)
    rows = [(f"p{i:03d}", round(r.uniform(40, 60), 2), i % 2, r.choice(["F", "M", None])) for i in range(400)]
    plain, folders = m.new_folder, []
    monkeypatch.setattr(m, "new_folder", lambda session, name: folders.append((name, plain(session, name))) or folders[-1][1])
    rule = m.Rule(caliper=1.0, order="value", agree="sex")
    pairs, audit = m.match(people(spark, rows).repartition(3), "who", "age", "k", rule, block_rows=12)
    assert {("x", p.case_id, p.control_id) for p in pairs.collect()} == sequential([r for r in rows if r[2]], [r for r in rows if not r[2]], "x", 1.0)
    solved = spark.read.parquet(next(f for name, f in folders if name == "solved"))
    assert solved.select("block").distinct().count() > 8
    assert solved.filter("kind = 'audit'").count() == audit.count() == 200


@pytest.mark.parametrize(("visits", "reach"), [(False, 0.05), (True, 0.05), (True, 1.0)])
def test_wide_blocks_go_again_where_a_change_reaches_them(spark, visits, reach):
    r = random.Random(11)
    rows = [(f"p{i:03d}", round(r.uniform(40, 60), 2), int(r.random() < 0.5), "BL") for i in range(500)]
    rows += [(w, round(r.uniform(40, 60), 2), 0, "F1") for w, _, k, _ in rows if visits and not k]
    df = spark.createDataFrame(rows, "who string, age double, k int, visit string")
    for order in ("value", "difficulty"):
        rule = m.Rule(ratio=1, caliper=reach, order=order)
        small, whole = (m.match(df, "who", "age", "k", rule, tie="visit", unique=not visits, block_rows=b, dense_rows=10**9) for b in (60, 10**9))
        for a, b in zip(small, whole, strict=True):
            assert a.count() and sorted(map(str, a.collect())) == sorted(map(str, b.collect()))
