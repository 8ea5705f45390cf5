"""Derived fields of a harmonized release: cleaning by the manifest's kinds, then a table of rules.

What a field holds comes from the variable manifest (standard_name, value_kind); how a derived field follows from others is a row of
``RULES``. A rule whose inputs the release lacks gives a typed null. Rules that build on other rules' outputs go to a later
projection, so a release is cleaned and derived in as many projections as rules stand on each other.
"""

from __future__ import annotations

from collections.abc import Mapping, Sequence
from dataclasses import dataclass
from functools import reduce

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from . import clean


@dataclass(frozen=True)
class Rule:
    """``output`` is ``kind`` of ``inputs``; an input that ends in ``*`` stands for all fields that begin like it.

    Kinds: levels (codes[0] are 1, codes[1] are 0), least (of all inputs, null if one is missing), known_least (of those known),
    from (1 from ``bound`` on), above (1 above it), any (1 if one is, 0 if one is known), count (of ones), unknown (always null).
    ``each`` makes one output per input field, named by ``output`` with ``{}`` for the field.
    """

    output: str
    kind: str
    inputs: tuple[str, ...]
    codes: tuple[tuple[int, ...], ...] = ()
    bound: float = 0.0
    each: bool = False


# fixed values: fields in which the codes 8 and 9 mean that there is no answer
UNANSWERED_8_9 = {"education_level_sap", "household_income_band", "marital_status", "self_rated_healthy_aging", "self_reported_vision"}
UNANSWERED_8_9_PREFIX = "social_"

# fixed values: definitions of the derived fields (codes, cut-offs, members)
RULES = (
    Rule("arthritis_any", "any", ("oa_*",)),
    Rule("asthma_or_copd", "any", ("asthma", "copd")),
    Rule("depression_cesd10", "from", ("cesd10_score",), bound=10),
    Rule("married_or_partnered", "levels", ("marital_status",), ((2,), (1, 3, 4, 5))),
    Rule("multimorbidity_selected_count", "count", ("arthritis_any", "asthma_or_copd", "cancer", "diabetes", "heart_disease", "hypertension", "low_back_pain", "osteoporosis", "stroke")),
    Rule("social_any_at_least_weekly", "any", ("social_*_at_least_weekly",)),
    Rule("{}_at_least_weekly", "levels", ("social_*",), ((1, 2), (3, 4, 5)), each=True),
    Rule("visual_acuity_better_eye", "least", ("visual_acuity_left", "visual_acuity_right")),
    Rule("visual_impairment_acuity", "unknown", ("visual_acuity_better_eye",)),
    Rule("visual_impairment_self_report", "levels", ("self_reported_vision",), ((4, 5), (1, 2, 3))),
)
#: Where the release states acuity on the logMAR scale.
LOGMAR = Rule("visual_impairment_acuity", "above", ("visual_acuity_better_eye",), bound=0.3)


def with_rules(*changed: Rule, rules: Sequence[Rule] = RULES) -> tuple[Rule, ...]:
    """The table with some outputs defined otherwise."""
    other = {r.output: r for r in changed}
    return tuple(other.get(r.output, r) for r in rules)


def cleaned(df: DataFrame, kinds: Mapping[str, str]) -> DataFrame:
    """Fields of the manifest cleaned by their kind (categorical, numeric, binary); fields that the release lacks stay away."""
    def of(name: str, kind: str) -> Column:
        value = F.col(f"`{name}`")
        if kind == "numeric":
            return clean.clean_numeric(value)
        if kind == "binary":
            return clean.yes_no(value)
        if kind != "categorical":
            raise ValueError(f"{name}: unknown kind {kind}")
        odd = name in UNANSWERED_8_9 or name.startswith(UNANSWERED_8_9_PREFIX)
        return clean.clean_code(value, clean.SURVEY_MISSING if odd else ())

    return df.withColumns({n: of(n, k) for n, k in kinds.items() if n in df.columns})


def _value(rule: Rule, inputs: Sequence[Column]) -> Column:
    number = [x.try_cast("double") for x in inputs]
    if not inputs or rule.kind == "unknown":
        return F.lit(None).cast("double" if rule.kind in ("least", "known_least") else "int")
    if rule.kind == "levels":
        return clean.level_flag(number[0], *(tuple(map(float, c)) for c in rule.codes))
    if rule.kind in ("from", "above"):
        return clean.threshold_flag(number[0], rule.bound, rule.kind == "above")
    if rule.kind == "any":
        return clean.any_positive(*inputs)
    if rule.kind == "count":
        return clean.selected_count(*inputs)
    if rule.kind in ("least", "known_least"):
        least = F.least(*number) if len(number) > 1 else number[0]
        return F.when(reduce(lambda a, b: a & b, [x.isNotNull() for x in number]), least) if rule.kind == "least" else least
    raise ValueError(f"{rule.output}: unknown kind {rule.kind}")


def _matching(pattern: str, names: Sequence[str]) -> list[str]:
    head, star, tail = pattern.partition("*")
    return [n for n in names if n == pattern or (star and len(n) >= len(head) + len(tail) and n.startswith(head) and n.endswith(tail))]


def derived(df: DataFrame, kinds: Mapping[str, str], rules: Sequence[Rule] = RULES) -> DataFrame:
    """``df`` cleaned by kind, with the outputs of all rules."""
    now, own = cleaned(df, kinds), [n for n in kinds if n in df.columns]
    # rules for each field of a pattern first become rules of their own
    todo = [Rule(r.output.format(n), r.kind, (n,), r.codes, r.bound) if r.each else r for r in rules for n in ([m for p in r.inputs for m in _matching(p, own)] if r.each else [""])]
    while todo:
        pending = [r.output for r in todo]
        ready = [r for r in todo if not any(set(_matching(p, pending)) - {r.output} for p in r.inputs)]
        if not ready:
            raise ValueError(f"rules stand on each other in a ring: {pending}")
        now = now.withColumns({r.output: _value(r, [F.col(n) for p in r.inputs for n in _matching(p, own)]) for r in ready})
        own += [r.output for r in ready]
        todo = [r for r in todo if r not in ready]
    return now
