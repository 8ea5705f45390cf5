"""Derived fields: rules in any order, missing fields, kinds."""

import pytest

from tessera.functions import derive

KINDS = {"visual_acuity_left": "numeric", "visual_acuity_right": "numeric", "oa_hand": "binary", "oa_hip": "binary", "oa_knee": "binary", "social_club": "categorical", "social_other": "categorical", "marital_status": "categorical"}
ROWS = [
    (1, "0.1", "0.4", "1", "2", None, "2", "8", "2"),
    (2, "-88880", "0.5", "no", "no", "0", "5", "9", "9"),
    (3, "0.6", " 0.50", None, "-99999", None, "8", None, "3"),
    (4, None, None, None, None, "yes", "x", "1", "7"),
]


@pytest.fixture(scope="module")
def release(spark):
    return spark.createDataFrame(ROWS, "id int, visual_acuity_left string, visual_acuity_right string, oa_hand string, oa_hip string, oa_knee string, social_club string, social_other string, marital_status string")


def test_rules(release):
    got = {r.id: r for r in derive.derived(release, KINDS, derive.with_rules(derive.LOGMAR)).collect()}
    assert [got[i].visual_acuity_better_eye for i in (1, 2, 3, 4)] == [0.1, None, 0.5, None]
    assert [got[i].visual_impairment_acuity for i in (1, 2, 3, 4)] == [0, None, 1, None]
    assert [got[i].arthritis_any for i in (1, 2, 3, 4)] == [1, 0, None, 1]
    assert [got[i].social_club_at_least_weekly for i in (1, 2, 3, 4)] == [1, 0, None, None]
    assert [got[i].social_any_at_least_weekly for i in (1, 2, 3, 4)] == [1, 0, None, 1]
    assert [got[i].married_or_partnered for i in (1, 2, 3, 4)] == [1, None, 0, None]
    assert [got[i].multimorbidity_selected_count for i in (1, 2, 3, 4)] == [1, 0, None, 1]
    assert {r.asthma_or_copd for r in got.values()} == {r.depression_cesd10 for r in got.values()} == {None}


def test_one_eye_is_enough(release):
    rule = derive.Rule("visual_acuity_better_eye", "known_least", ("visual_acuity_left", "visual_acuity_right"))
    got = derive.derived(release, KINDS, derive.with_rules(rule)).orderBy("id").collect()
    assert [r.visual_acuity_better_eye for r in got] == [0.1, 0.5, 0.5, None] and {r.visual_impairment_acuity for r in got} == {None}


def test_bad_tables(release):
    with pytest.raises(ValueError, match="ring"):
        derive.derived(release, KINDS, (derive.Rule("a", "any", ("b",)), derive.Rule("b", "any", ("a",))))
    with pytest.raises(ValueError, match="unknown kind"):
        derive.derived(release, {"oa_hip": "odd"})
