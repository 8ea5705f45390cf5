"""Case-control matching inside calipers, without reuse of controls.

All forms are greedy and deterministic: cases take turns in a fixed priority, each takes its nearest controls that
are left. The sequential answer is reached without a task that holds a whole stratum:

* Rows of a stratum (equal exact columns) are cut into blocks, ranges of the matched value with about ``block_rows`` rows and at least two calipers
  wide. Controls within a caliper of a block's edge are seen by both sides.
* Each block lets its cases take turns. A control that a case of another block took at an earlier turn, as of the round before, is not there.
* Blocks whose controls were taken otherwise than before by other blocks with earlier turns go again, until nothing changes. What holds then is the
  sequential answer: in the order of turns, each case saw what all cases before it took.
* A block all of whose turns come after those of another one, and that shares an eighth of its controls with it, waits until that one is done: where blocks are
  a few calipers wide, every change below would run through it. By value, dense strata are so solved once, from the lowest block on, all strata at a time.

A change only runs on as far as matches depend on each other, so few blocks go again where controls are plenty; in the worst case (every case
hangs on the one before) rounds are as many as blocks. A control person with rows at several values is one person in all blocks.

A block can't be narrower than two calipers. Strata in which that alone is more than ``dense_rows`` rows are matched by rounds of proposals instead
(``proposals``), whose groups are bounded whatever the caliper holds; that form covers rules of the value distance alone (the nearest or the lowest) that take
one control, or up to ``ratio``. What it doesn't cover (all or none of several controls, covariate distances, several rows of a person, a column that has to
agree where it is known) goes through blocks at any density.
"""

from __future__ import annotations

from collections.abc import Sequence
from dataclasses import dataclass, field, replace
from functools import reduce

import numpy as np
import pandas as pd
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from ..sources.shared import checkpointed, new_folder, written
from .checks import CheckFailed, assert_unique, require_columns
from .proposals import Line, inside, reachable
from .proposals import pairs as proposed_pairs
from .windows import ranked, with_aggregates

BLOCK_ROWS = 50_000
CLASSES = 64  # of controls with equal covariates in a block that are searched one by one
LEVELS = 24  # blocks are 2**level cells wide
SLOTS = 64  # parts of the rows by hash of their block
WAITS = 8  # a block waits for one that goes before it if they share a part of this size of its controls
ROUNDS = 100_000  # a change reaches one more block with each; as many as there are cases would always do


@dataclass(frozen=True)
class Rule:
    """How cases take turns and what they take.

    order: "difficulty" (fewest candidates first) or "value". whole: a case takes ``ratio`` controls or none,
    else up to ``ratio``. null_matches: a null exact value matches null, else nothing.
    distance: columns of a Gower distance that goes before the value distance (numeric ones by range). lowest: a case takes the lowest
    values inside the caliper instead of the nearest. agree: a column in which a case that knows its own value takes only equal controls, as long as any
    control that is left in the stratum knows its value; a case that doesn't know it takes any.
    """

    ratio: int = 1
    caliper: float = 1.0
    exact: tuple[str, ...] = ()
    order: str = "difficulty"
    whole: bool = True
    null_matches: bool = False
    distance: tuple[str, ...] = ()
    numeric: tuple[str, ...] = field(default=())
    lowest: bool = False
    agree: str | None = None

    @property
    def by_value(self) -> bool:
        """Whether what a case takes depends on values and on what is left alone."""
        return not self.distance and not self.agree

    def __post_init__(self):
        if self.ratio < 1 or self.caliper < 0 or self.order not in ("difficulty", "value"):
            raise ValueError(f"not a rule: {self}")


PAIRS = "case_id string, control_id string, match_rank int, priority long, case_value double, control_value double, value_distance double, covariate_distance double"
AUDIT = "case_id string, case_value double, matched boolean, n_controls int, eligible_at_turn int, reason string"


def gower(case: dict, pool: pd.DataFrame, columns: Sequence[str], numeric: Sequence[str]) -> pd.Series:
    """Mean distance over informative columns: both unknown says nothing, one unknown is 1, numbers by the pool's range."""
    total, weight = pd.Series(0.0, pool.index), pd.Series(0.0, pool.index)
    for c in columns:
        mine, theirs = case[c], pool[c]
        here, there = pd.notna(mine), theirs.notna()
        if here and c in numeric:
            known = theirs[there].astype(float)
            spread = known.max() - known.min() if len(known) else 0.0
            d = ((theirs.astype(float) - float(mine)).abs() / (spread if spread > 0 else 1.0)).clip(upper=1.0)
        else:
            d = (theirs.astype(str) != str(mine)).astype(float)
        d = d.where(there, 1.0) if here else there.astype(float)
        total += d.fillna(0.0)
        weight += (there | here).astype(float)
    return total / weight.clip(lower=1.0)


def _nearby(values: np.ndarray, x: float, caliper: float) -> np.ndarray:
    """Places of ascending values within the caliper."""
    return np.arange(*inside(values, x, caliper))


def _audit(case: str, x: float, taken: int, eligible: int, rule: Rule) -> tuple:
    reason = None if taken == rule.ratio else "partial_ratio" if taken else "too_few_controls"
    return case, x, bool(taken), taken, eligible, reason


class Left:
    """Which places are left, counted up to any place in a few steps (a Fenwick tree of ones)."""

    def __init__(self, n: int):
        self.n, self.tree = n, np.bitwise_and(np.arange(n + 1), -np.arange(n + 1)).tolist()

    def kill(self, i: int) -> None:
        tree, i = self.tree, i + 1
        while i <= self.n:
            tree[i] -= 1
            i += i & -i

    def between(self, first: int, stop: int) -> int:
        tree, total = self.tree, 0
        while stop:
            total += tree[stop]
            stop -= stop & -stop
        while first:
            total -= tree[first]
            first -= first & -first
        return total


def _within(values: np.ndarray, x: np.ndarray, caliper: float) -> tuple[np.ndarray, np.ndarray]:
    """``inside`` of many values at once."""
    first, stop = np.searchsorted(values, x - caliper - 1e-9), np.searchsorted(values, x + caliper + 1e-9, "right")
    if len(values):
        while (far := (first < stop) & (np.abs(values[np.minimum(first, len(values) - 1)] - x) > caliper)).any():
            first = first + far
        while (far := (first < stop) & (np.abs(values[stop - 1] - x) > caliper)).any():
            stop = stop - far
    return first, stop


def _solve_line(frame: pd.DataFrame, rule: Rule) -> tuple[list, list]:
    """``_solve`` where controls are distinct people and only values count, among all controls or those that agree: n log n."""
    pool = frame[~frame.is_case].sort_values(["value", "id"])
    values, ids, n = pool.value.to_numpy(float), pool.id.tolist(), len(pool)
    cases = frame[frame.is_case].sort_values(["turn", "id"])
    xs, turns = cases.value.to_numpy(float), cases.turn.to_numpy()
    # lines: of all controls, and of those with each known value that has to agree
    members, which, kind, own = [np.arange(n)], np.zeros(len(cases), int), np.full(n, -1), np.zeros(n, int)
    if rule.agree:
        names = {v: k for k, v in enumerate(pool.agree.dropna().unique(), 1)}
        kind = pool.agree.map(names).fillna(-1).to_numpy(int)
        members += [np.flatnonzero(kind == k) for k in names.values()]
        for m in members[1:]:
            own[m] = np.arange(len(m))
        asked = cases.agree.notna().to_numpy() & ~(turns > cases.loose.to_numpy(float))
        which = np.where(asked, cases.agree.map(names).fillna(-1).to_numpy(int), 0)  # -1: nobody agrees
    lines = [Line(values[m], [ids[i] for i in m.tolist()]) for m in members]
    counts = [Left(len(m)) for m in members]
    places = [m.tolist() for m in members]
    begin = [np.searchsorted(x.values, x.values).tolist() for x in lines]  # the first one of equal values
    first, stop, at = (np.zeros(len(cases), int) for _ in range(3))
    for k, x in enumerate(lines):
        mine = np.flatnonzero((which == k) & (rule.null_matches | ~cases.unknown.to_numpy(bool)))
        first[mine], stop[mine] = _within(x.values, xs[mine], rule.caliper)
        at[mine] = np.searchsorted(x.values, xs[mine])
    kind, own = kind.tolist(), own.tolist()

    def kill(i: int) -> None:
        if lines[0].kill(i):
            counts[0].kill(i)
            if kind[i] > 0:
                lines[kind[i]].kill(own[i])
                counts[kind[i]].kill(own[i])

    late = pool.taken.fillna(np.inf).to_numpy(float)
    dying, dead = [i for i in np.argsort(late, kind="stable").tolist() if late[i] < np.inf], 0
    ends = late[dying].tolist()
    pairs, audit = [], []
    for case, x, turn, k, a, b, here in zip(cases.id.tolist(), xs.tolist(), turns.tolist(), which.tolist(), first.tolist(), stop.tolist(), at.tolist(), strict=True):
        while dead < len(dying) and ends[dead] <= turn:
            kill(dying[dead])
            dead += 1
        line = lines[k]
        eligible = counts[k].between(a, b) if a < b else 0
        take = min(rule.ratio, eligible) if eligible >= (rule.ratio if rule.whole else 1) else 0
        for rank in range(1, take + 1):
            if rule.lowest:
                i = line.next(a)
            else:
                low, high = line.last(here - 1), line.next(here)
                if low >= a:
                    low = line.next(begin[k][low])
                i = min((abs(line.sorted[j] - x), line.ids[j], j) for j in (low, high) if a <= j < b)[2]
            v = line.sorted[i]
            pairs.append((case, line.ids[i], rank, turn, x, v, abs(v - x), 0.0))
            kill(places[k][i])
        audit.append(_audit(case, x, take, eligible, rule))
    return pairs, audit


def _solve_classes(frame: pd.DataFrame, pool: pd.DataFrame, kind: np.ndarray, rule: Rule) -> tuple[list, list]:
    """``_solve`` where controls are distinct people of a few classes: inside of a class (``kind``) covariates and ``agree`` are the same, so values count alone."""
    values, ids = pool.value.to_numpy(float), pool.id.tolist()
    kinds = int(kind.max()) + 1
    members = [np.flatnonzero(kind == k) for k in range(kinds)]
    own = np.zeros(len(ids), int)
    for m in members:
        own[m] = np.arange(len(m))
    lines = [Line(values[m], [ids[i] for i in m.tolist()]) for m in members]
    counts, total = [Left(len(m)) for m in members], Left(len(ids))
    reps = pool.iloc[[m[0] for m in members]].reset_index(drop=True)
    agree = reps.agree.to_numpy(object)
    every, kind_of, own_of = list(range(kinds)), kind.tolist(), own.tolist()
    far_of: dict[tuple, dict[int, float]] = {}

    def kill(i: int) -> None:
        k = kind_of[i]
        if lines[k].kill(own_of[i]):
            counts[k].kill(own_of[i])
            total.kill(i)

    def best(k: int, x: float) -> tuple | None:
        """What comes first among those of a class that are left inside the caliper: (distance, id, place)."""
        line = lines[k]
        if rule.lowest:
            places = (line.next(inside(line.values, x, rule.caliper)[0]),)
        else:
            places = (line.below(x), line.above(x))
        found = [(v if rule.lowest else abs(v - x), line.ids[i], i) for i in places if 0 <= i < len(line.ids) for v in [float(line.values[i])] if abs(v - x) <= rule.caliper]
        return min(found) if found else None

    late = pool.taken.fillna(np.inf).to_numpy(float)
    dying, dead = [i for i in np.argsort(late, kind="stable").tolist() if late[i] < np.inf], 0
    pairs, audit = [], []
    for case in frame[frame.is_case].sort_values(["turn", "id"]).to_dict("records"):
        x, turn = case["value"], case["turn"]
        while dead < len(dying) and late[dying[dead]] <= turn:
            kill(dying[dead])
            dead += 1
        asked = every if rule.null_matches or not case["unknown"] else []
        if rule.agree and pd.notna(case["agree"]) and not turn > case["loose"]:
            asked = [k for k in asked if agree[k] == case["agree"]]
        if len(asked) == kinds:
            eligible = total.between(*inside(values, x, rule.caliper))
        else:
            eligible = sum(counts[k].between(*inside(lines[k].values, x, rule.caliper)) for k in asked)
        take = min(rule.ratio, eligible) if eligible >= (rule.ratio if rule.whole else 1) else 0
        first = {k: b for k in asked for b in [best(k, x)] if b} if take else {}
        far = dict.fromkeys(first, 0.0)
        if rule.distance and first:  # by the classes that are there, as numbers go by their range
            key = (tuple(first), *[None if pd.isna(case[c]) else case[c] for c in rule.distance])
            if key not in far_of:
                if len(far_of) > 100_000:
                    far_of.clear()
                far_of[key] = dict(zip(first, gower(case, reps.iloc[list(first)], rule.distance, rule.numeric).tolist(), strict=True))
            far = far_of[key]
        for rank in range(1, take + 1):
            g, (_, name, i), k = min((far[k], b, k) for k, b in first.items())
            v = float(lines[k].values[i])
            pairs.append((case["id"], name, rank, turn, x, v, abs(v - x), g))
            kill(int(members[k][i]))
            again = best(k, x)
            if again:
                first[k] = again
            else:
                del first[k]
        audit.append(_audit(case["id"], x, take, eligible, rule))
    return pairs, audit


def _classes(pool: pd.DataFrame, rule: Rule) -> np.ndarray | None:
    """The class of each control by its covariates and what it has to agree in; None where there are more than ``CLASSES``."""
    names = [*rule.distance, *(["agree"] if rule.agree else [])]
    kind = pool.groupby(names, dropna=False, sort=False).ngroup().to_numpy()
    return kind if kind.max() < CLASSES else None


def _solve(frame: pd.DataFrame, rule: Rule) -> tuple[list, list]:
    """Turns of the cases of one block: columns id, value, is_case, unknown, turn, tie, taken (turn at which others took a control), agree and
    loose (the turn after which it is not asked for), and the distance columns."""
    pool = frame[~frame.is_case].sort_values(["value", "id", "tie"]).reset_index(drop=True)
    if rule.by_value and pool.id.is_unique:
        return _solve_line(frame, rule)
    if len(pool) and pool.id.is_unique and (kind := _classes(pool, rule)) is not None:
        return _solve_classes(frame, pool, kind, rule) if rule.distance else _solve_line(frame, rule)
    cases = frame[frame.is_case].sort_values(["turn", "id"])
    values, names = pool.value.to_numpy(float), pool.id.to_numpy()
    person = np.unique(names.astype(str), return_inverse=True)[1] if len(pool) else np.zeros(0, int)
    tie = np.unique(pool.tie.astype(str), return_inverse=True)[1] if len(pool) else np.zeros(0, int)
    gone = np.full(person.max() + 1 if len(pool) else 0, np.inf)
    np.minimum.at(gone, person, pool.taken.fillna(np.inf).to_numpy(float))
    agree = pool.agree.to_numpy(object)
    pairs, audit = [], []
    for case in cases.to_dict("records"):
        x = case["value"]
        near = _nearby(values, x, rule.caliper) if rule.null_matches or not case["unknown"] else np.zeros(0, int)
        near = near[gone[person[near]] > case["turn"]]
        if rule.agree and pd.notna(case["agree"]) and not case["turn"] > case["loose"]:
            near = near[agree[near] == case["agree"]]
        d = np.abs(values[near] - x)
        g = gower(case, pool.iloc[near], rule.distance, rule.numeric).to_numpy() if rule.distance and len(near) else np.zeros(len(near))
        # the lowest value first or the nearest
        order = np.lexsort((tie[near], person[near], values[near] if rule.lowest else d, g))
        near, d, g = near[order], d[order], g[order]
        if len(near) > len(set(person[near].tolist())):  # a person's nearest row stands for it
            once = np.sort(np.unique(person[near], return_index=True)[1])
            near, d, g = near[once], d[once], g[once]
        enough = len(near) >= (rule.ratio if rule.whole else 1)
        take = rule.ratio if enough else 0
        for rank, (k, dk, gk) in enumerate(zip(near[:take].tolist(), d[:take].tolist(), g[:take].tolist(), strict=True), 1):
            pairs.append((case["id"], names[k], rank, case["turn"], x, float(values[k]), dk, gk))
        taken = min(take, len(near))
        gone[person[near[:take]]] = -1
        audit.append(_audit(case["id"], x, taken, len(near), rule))
    return pairs, audit


def _frame(df: DataFrame, who: str, value: str, case: str, rule: Rule, tie: str | None) -> DataFrame:
    """Usable rows: id, value, is_case, tie, exact key, distance columns."""
    require_columns(df, [who, value, case, *rule.exact, *rule.distance, *([rule.agree] if rule.agree else [])], "matching table")
    parts = [F.coalesce(F.concat(F.lit("="), F.col(c).cast("string")), F.lit("null")) for c in rule.exact]
    rows = df.select(
        F.col(who).cast("string").alias("id"),
        F.col(value).cast("double").alias("value"),
        (F.col(case) == 1).alias("is_case"),
        (F.col(tie).cast("string") if tie else F.lit("")).alias("tie"),
        F.concat_ws("\1", *parts).alias("stratum") if parts else F.lit("").alias("stratum"),
        *([F.exists(F.array(*[F.col(c).isNull() for c in rule.exact]), lambda x: x).alias("unknown")] if parts else [F.lit(False).alias("unknown")]),
        (F.upper(F.trim(F.col(rule.agree).cast("string"))) if rule.agree else F.lit(None).cast("string")).alias("agree"),
        *[F.col(c).alias(f"g_{i}") for i, c in enumerate(rule.distance)],
    )
    return rows.filter(F.col("id").isNotNull() & F.col("value").isNotNull() & F.col("is_case").isNotNull())


def _cell(value, rule: Rule):
    return F.floor(value / (2 * max(rule.caliper, 1e-6) + 1e-6)).cast("long")


def _in_blocks(rows: DataFrame, rule: Rule, block_rows: int) -> DataFrame:
    """Rows with their block: cases once, controls in every block with cases that can reach them.

    Cells are two calipers wide. A block is the largest aligned run of 2**level cells with ``block_rows`` rows at most, or one cell.
    """
    cells = rows.select("stratum", _cell(F.col("value"), rule).alias("cell"), F.col("is_case").cast("long").alias("c")).groupBy("stratum", "cell").agg(F.count("*").alias("n"), F.sum("c").alias("c"))
    wide = cells.withColumn("level", F.explode(F.sequence(F.lit(0), F.lit(LEVELS)))).withColumn("run", F.expr("shiftright(cell, level)"))
    total = wide.groupBy("stratum", "level", "run").agg(F.sum("n").alias("n"), F.sum("c").alias("c"))
    fits = wide.drop("n", "c").join(total, ["stratum", "level", "run"]).filter((F.col("n") <= block_rows) | (F.col("level") == 0))
    best = fits.groupBy("stratum", "cell").agg(F.max(F.struct("level", "run", "c")).alias("b"))
    blocks = checkpointed(best.filter("b.c > 0").select("stratum", "cell", F.concat_ws("\2", "stratum", "b.level", "b.run").alias("block")))
    v, reach = F.col("value"), rule.caliper + 1e-9
    seen = F.when(F.col("is_case"), F.array(_cell(v, rule))).otherwise(F.array_distinct(F.array(_cell(v - reach, rule), _cell(v, rule), _cell(v + reach, rule))))
    return rows.withColumn("cell", F.explode(seen)).join(blocks, ["stratum", "cell"]).drop("cell").dropDuplicates()


def _counted(placed: DataFrame, rule: Rule) -> DataFrame:
    """(id, candidates) of each case: control persons inside the caliper."""
    def count(frame: pd.DataFrame) -> pd.DataFrame:
        pool = frame[~frame.is_case].sort_values("value")
        values, person = pool.value.to_numpy(float), np.unique(pool.id.astype(str), return_inverse=True)[1] if len(pool) else np.zeros(0, int)
        cases = frame[frame.is_case]
        once = len(pool) == (person.max() + 1 if len(pool) else 0)
        found = [(lambda a, b: b - a)(*inside(values, x, rule.caliper)) if rule.null_matches or not odd else 0 for x, odd in zip(cases.value, cases.unknown, strict=True)] if once else [len(np.unique(person[_nearby(values, x, rule.caliper)])) if rule.null_matches or not odd else 0 for x, odd in zip(cases.value, cases.unknown, strict=True)]
        return pd.DataFrame({"id": cases.id.to_numpy(), "candidates": found})

    return placed.select("block", "id", "value", "is_case", "unknown").groupBy("block").applyInPandas(count, "id string, candidates long")


def match(df: DataFrame, who: str, value: str, case: str, rule: Rule, tie: str | None = None, unique: bool = True, block_rows: int = BLOCK_ROWS, dense_rows: int = BLOCK_ROWS) -> tuple[DataFrame, DataFrame]:
    """(pairs, audit); ``case`` is 1 for cases and 0 for controls.

    With ``unique`` each person has one row; else a control person may have several (visits, told apart by ``tie``) and serves once, at
    the nearest. ``priority`` in pairs is the turn over all cases, from 1. eligible_at_turn is null in strata that went through proposals.
    """
    if unique:
        assert_unique(df, [who], "matching table")
    rows = _frame(df, who, value, case, rule, tie)
    if not rule.null_matches:
        rows = rows.filter(F.col("is_case") | ~F.col("unknown"))
    dense = _dense(rows, rule, dense_rows) if unique and rule.by_value and (rule.ratio == 1 or not rule.whole) else []
    crowded = F.col("stratum").isin(dense) if dense else F.lit(False)
    light = rows.filter(~crowded)
    placed = _in_blocks(light, rule, block_rows)
    cases = placed.filter("is_case").select("id", "value")
    turns = cases.withColumn("candidates", F.lit(0).cast("long")) if rule.order == "value" else cases.join(_counted(placed, rule), "id")
    heavy = written(rows.filter(crowded).select("stratum", "id", "value", "is_case", "unknown"), "dense") if dense else None
    if heavy is not None:
        able = heavy.filter(~F.col("is_case") | ~F.col("unknown") | F.lit(rule.null_matches))
        more = heavy.filter("is_case").select("id", "value")
        counts = None if rule.order == "value" else reachable(able, rule.caliper, block_rows)
        turns = turns.unionByName(more.withColumn("candidates", F.lit(0).cast("long")) if counts is None else more.join(counts, "id", "left").select("id", "value", F.coalesce("candidates", F.lit(0)).cast("long").alias("candidates")))
    numbered = ranked(turns, [], [F.col("candidates"), F.col("value"), F.col("id")], "turn").select("id", "turn")
    if heavy is not None:
        numbered = written(numbered, "turns")
    found = _by_blocks(light, placed, numbered, rule)
    pairs = found.filter("kind = 'pair'").select(*[c.split()[0] for c in PAIRS.split(", ")])
    audit = found.filter("kind = 'audit'").select("case_id", "case_value", "matched", "n_controls", "eligible_at_turn", "reason")
    if heavy is not None:
        if rule.lowest:  # the lowest inside of the caliper is the first one from its lower end on, two calipers away at most
            low = able.withColumn("value", F.when(F.col("is_case"), F.col("value") - rule.caliper).otherwise(F.col("value")))
            more = proposed_pairs(low, numbered, rule.ratio, 2 * rule.caliper, block_rows, upward=True).withColumn("case_value", F.col("case_value") + rule.caliper)
            more = more.withColumn("value_distance", F.abs(F.col("control_value") - F.col("case_value")))
        else:
            more = proposed_pairs(able, numbered, rule.ratio, rule.caliper, block_rows)
        more = written(more.withColumn("covariate_distance", F.lit(0.0)), "pairs")
        taken = more.groupBy(F.col("case_id").alias("id")).agg(F.count("*").cast("int").alias("n"))
        judged = heavy.filter("is_case").join(taken, "id", "left").withColumn("n", F.coalesce("n", F.lit(0)))
        reason = F.when(F.col("n") == rule.ratio, F.lit(None)).when(F.col("n") > 0, "partial_ratio").otherwise("too_few_controls")
        pairs = pairs.unionByName(more)
        audit = audit.unionByName(judged.select(F.col("id").alias("case_id"), F.col("value").alias("case_value"), (F.col("n") > 0).alias("matched"), F.col("n").alias("n_controls"), F.lit(None).cast("int").alias("eligible_at_turn"), reason.alias("reason")))
    return pairs, audit


def _dense(rows: DataFrame, rule: Rule, dense_rows: int) -> list[str]:
    """Strata of which two calipers alone hold more than ``dense_rows`` rows; there is one for that many rows at most."""
    cells = rows.groupBy("stratum", _cell(F.col("value"), rule).alias("cell")).agg(F.count("*").alias("n"), F.count_if("is_case").alias("c"))
    return [r.stratum for r in cells.filter((F.col("n") > dense_rows) & (F.col("c") > 0)).select("stratum").distinct().collect()]


def _by_blocks(light: DataFrame, placed: DataFrame, numbered: DataFrame, rule: Rule) -> DataFrame:
    """Rows of kind pair and audit, after rounds of the blocks until no control changes hands between them."""
    placed = placed.join(numbered.withColumn("is_case", F.lit(True)), ["id", "is_case"], "left").withColumn("loose", F.lit(float("inf")))
    placed = checkpointed(placed)
    done = _settled(placed, rule)
    if not rule.agree:
        return done
    # where all controls that know the column are taken, cases after the last of these turns take any: the turns up to it stay as they are
    known = light.filter("not is_case and agree is not null").select("stratum", "id")
    taken = done.filter("kind = 'pair'").select(F.col("control_id").alias("id"), F.col("priority").alias("at"))
    over = known.join(taken, "id", "left").groupBy("stratum").agg(F.count_if(F.col("at").isNull()).alias("left"), F.max("at").cast("double").alias("last")).filter("left = 0")
    # without a control that knows it, it is never asked for
    strata = light.select("stratum").distinct().join(known.select("stratum").distinct(), "stratum", "left_anti").select("stratum", F.lit(-1.0).alias("last"))
    over = checkpointed(over.select("stratum", "last").unionByName(strata))
    if not over.limit(1).count():
        return done
    changed = checkpointed(placed.drop("loose").join(over, "stratum").withColumnRenamed("last", "loose").select(placed.columns))
    again = _settled(changed, rule)
    return done.join(changed.select("block").distinct(), "block", "left_anti").unionByName(again)


def _settled(placed: DataFrame, rule: Rule) -> DataFrame:
    """Rows of kind pair and audit with their block. A round solves the blocks that are due and wait for none; blocks that a changed pair reaches are due again."""
    names = {f"g_{i}": c for i, c in enumerate(rule.distance)}
    schema = f"block string, kind string, {PAIRS}, matched boolean, n_controls int, eligible_at_turn int, reason string"
    columns = [c.split()[0] for c in schema.split(", ")]
    spark = placed.sparkSession

    def solve(frame: pd.DataFrame, taken: pd.DataFrame | None = None) -> pd.DataFrame:
        at = {} if taken is None else taken.groupby("id")["at"].min().to_dict()
        # of a person that several blocks see: the turn at which others took it
        frame["taken"] = np.array([np.nan if case else at.get(x, np.nan) for case, x in zip(frame.is_case, frame.id, strict=True)], float)
        pairs, audit = _solve(frame.rename(columns=names), rule)
        block, several = frame.block.iloc[0], frame[frame.seen.notna()]
        seen = dict(zip(several.id, several.seen, strict=True))
        out = [(block, "pair", *p, None, None, None, None, seen.get(p[1])) for p in pairs] + [(block, "audit", a[0], None, None, None, a[1], None, None, None, *a[2:], None) for a in audit]
        return pd.DataFrame(out, columns=[*columns, "seen"])

    # controls that several blocks see: what other blocks take matters for these alone
    several = placed.filter("not is_case").groupBy("id").agg(F.collect_set("block").alias("seen")).filter(F.size("seen") > 1)
    slot = F.pmod(F.hash("block"), F.lit(SLOTS))
    rows = placed.join(several, "id", "left").withColumn("seen", F.when(~F.col("is_case"), F.col("seen"))).withColumn("slot", slot)
    folder = new_folder(spark, "placed")
    rows.repartition("block").write.partitionBy("slot").parquet(folder)
    rows = spark.read.schema(rows.schema).parquet(folder)  # a round reads the slots of its blocks
    of_block = written(rows.groupBy("block", "slot").agg(F.min("turn").alias("first"), F.max("turn").alias("last"), F.count_if(~F.col("is_case")).alias("n")), "blocks")
    met = rows.filter("seen is not null").select("block", F.explode("seen").alias("by")).filter("block != by").groupBy("block", "by").agg(F.count("*").alias("shared"))
    before = of_block.select(F.col("block").alias("by"), F.col("first").alias("by_first"), F.col("last").alias("by_last"))
    # later turns take nothing from earlier ones; a block waits for one that goes before it as a whole and meets it in much of its controls, as any change there would run through it
    reach = met.join(of_block, "block").join(before, "by").filter("by_first < last")
    reach = written(reach.select("block", "by", ((F.col("by_last") < F.col("first")) & (F.col("shared") * WAITS >= F.col("n"))).alias("waits")), "reach")

    def due(state: DataFrame) -> DataFrame:
        """``state`` (block, slot, round in which it was solved last, pending) with those that go now."""
        waiting = state.filter("pending")
        held = reach.filter("waits").join(waiting.select(F.col("block").alias("by")), "by", "left_semi").select("block").distinct().withColumn("held", F.lit(True))
        return written(state.join(held, "block", "left").select("block", "slot", "round", "pending", (F.col("pending") & F.col("held").isNull()).alias("go")), "state")

    parts = new_folder(spark, "solved")

    def solved(rounds: Sequence[int], state: DataFrame) -> DataFrame:
        """What stands of these rounds: rows of blocks that were not solved again."""
        files = spark.read.schema(f"{schema}, seen array<string>, round int").option("basePath", parts).parquet(*[f"{parts}/round={k}" for k in rounds])
        return files.join(state.filter("round >= 0").select("block", "round"), ["block", "round"], "left_semi")

    state = due(of_block.select("block", "slot", F.lit(-1).alias("round"), F.lit(True).alias("pending")))
    for k in range(ROUNDS):
        go = state.filter("go").select("block")
        slots = [r.slot for r in state.filter("go").select("slot").distinct().collect()]  # SLOTS rows at most
        if not slots:
            break
        # rounds in which these blocks, and those that reach them, were solved last
        own, others = (sorted(r["round"] for r in x.filter("round >= 0").select("round").distinct().collect()) for x in (state.filter("go"), state.join(reach.join(go, "block", "left_semi").select(F.col("by").alias("block")), "block", "left_semi")))
        here = rows.filter(F.col("slot").isin(slots)).join(go, "block", "left_semi").drop("slot")
        if others:
            taken = solved(others, state).filter("seen is not null").select(F.explode("seen").alias("block"), F.col("control_id").alias("id"), F.col("block").alias("by"), F.col("priority").alias("at"))
            taken = taken.join(reach, ["block", "by"], "left_semi").join(go, "block", "left_semi").select("block", "id", "at")
            found = here.groupBy("block").cogroup(taken.groupBy("block")).applyInPandas(lambda a, b: solve(a, b), f"{schema}, seen array<string>")
        else:
            found = here.groupBy("block").applyInPandas(lambda a: solve(a), f"{schema}, seen array<string>")
        found.write.parquet(f"{parts}/round={k}")
        pair = ["case_id", "control_id", "block", "priority", "seen"]
        after = spark.read.schema(found.schema).parquet(f"{parts}/round={k}").filter("seen is not null").select(*pair)
        if own:
            old = solved(own, state).filter("seen is not null").join(go, "block", "left_semi").select(*pair).withColumn("side", F.lit(1))
            both = old.unionByName(after.withColumn("side", F.lit(2)))
            after = both.groupBy("case_id", "control_id", "block").agg(F.sum("side").alias("side"), F.first("seen").alias("seen")).filter("side < 3")
        moved = after.select(F.explode("seen").alias("block"), F.col("block").alias("by")).distinct().join(reach, ["block", "by"], "left_semi").select("block").distinct().withColumn("moved", F.lit(True))
        state = due(state.join(moved, "block", "left").select("block", "slot", F.when(F.col("go"), F.lit(k)).otherwise(F.col("round")).alias("round"), ((F.col("pending") & ~F.col("go")) | F.col("moved").isNotNull()).alias("pending")))
    else:
        raise CheckFailed(f"no end after {ROUNDS} rounds")
    if not k:
        return spark.createDataFrame([], schema)
    last = sorted(r["round"] for r in state.select("round").distinct().collect())
    return solved(last, state).select(*columns)


def match_rounds(df: DataFrame, who: str, value: str, case: str, rule: Rule, block_rows: int = 500) -> DataFrame:
    """Pairs with small blocks, so that many rounds are gone through: case_id, control_id, match_rank, value_distance."""
    return match(df, who, value, case, rule, block_rows=block_rows)[0].select("case_id", "control_id", "match_rank", "value_distance")


def membership(pairs: DataFrame) -> DataFrame:
    """(match_set_id, participant_id, match_role, match_rank): one case and its controls per set."""
    named = pairs.withColumn("match_set_id", F.format_string("match_%08d", "priority"))
    cases = named.select("match_set_id", F.col("case_id").alias("participant_id"), F.lit("case").alias("match_role"), F.lit(0).alias("match_rank")).distinct()
    return cases.unionByName(named.select("match_set_id", F.col("control_id").alias("participant_id"), F.lit("control").alias("match_role"), "match_rank"))


def match_groups(df: DataFrame, who: str, value: str, group: str, targets: Sequence[str], reference: str, rule: Rule) -> DataFrame:
    """Pairs of each target group with one reference group; a reference may serve several target groups."""
    out = None
    for t in targets:
        part = df.filter(F.col(group).isin(t, reference)).withColumn("_case", (F.col(group) == t).cast("int"))
        pairs = match(part, who, value, "_case", rule)[0].withColumn("target_group", F.lit(t))
        out = pairs if out is None else out.unionByName(pairs)
    return out


def match_extremes(df: DataFrame, who: str, value: str, gap: str, cohort: str, sex: str, fraction: float, rule: Rule) -> DataFrame:
    """Pairs (with the cohort) of the highest with the lowest ``fraction`` of ``gap`` inside each cohort, in turns by value and id.

    A case that knows its sex takes a control of the same sex, as long as any control that is left in the cohort knows its own; other cases take anyone.
    All cohorts are matched at once. Ends are those of ``windows.tails`` in each cohort; cohorts of under 4 rows have none.
    """
    rows = df.filter(F.col(gap).isNotNull() & ~F.isnan(gap) & (F.abs(F.col(gap)) < float("inf")) & F.col(cohort).isNotNull())
    placed = with_aggregates(ranked(rows, [cohort], [F.col(gap), F.col(who)], "_rank"), [cohort], _n=F.count("*"))
    size = F.least(F.greatest(F.lit(1), F.ceil(F.col("_n") * fraction)), F.floor(F.col("_n") / 2))
    ends = placed.filter("_n >= 4").withColumn("_case", F.when(F.col("_rank") > F.col("_n") - size, 1).when(F.col("_rank") <= size, 0)).filter("_case is not null").drop("_rank", "_n")
    ends = written(ends, "ends")
    turns = replace(rule, order="value", exact=(*rule.exact, cohort), agree=sex)
    pairs = match(ends, who, value, "_case", turns)[0]
    return pairs.join(ends.filter("_case = 1").select(F.col(who).cast("string").alias("case_id"), cohort), "case_id")


def gower_column(pairs: dict[str, tuple[Column, Column]], spread: dict[str, Column]) -> Column:
    """Gower distance of two rows' columns as an expression: unknown on both sides says nothing, on one side it is 1, numbers differ by their ``spread``."""
    parts = []
    for name, (a, b) in pairs.items():
        differ = F.least(F.lit(1.0), F.abs(a - b) / F.when(spread[name] > 0, spread[name]).otherwise(1.0)) if name in spread else (a != b).cast("double")
        parts.append(F.when(a.isNull() & b.isNull(), None).when(a.isNull() | b.isNull(), 1.0).otherwise(differ))
    known = F.greatest(F.lit(1), reduce(lambda x, y: x + y, [p.isNotNull().cast("int") for p in parts]))
    return reduce(lambda x, y: x + y, [F.coalesce(p, F.lit(0.0)) for p in parts]) / known


def feasibility(df: DataFrame, who: str, value: str, case: str, calipers: Sequence[float], block_rows: int = BLOCK_ROWS, dense_rows: int = BLOCK_ROWS) -> DataFrame:
    """(caliper, n_cases, n_with_candidate, max_pairs): how many cases have a control, and the most disjoint pairs there can be.

    Distances that differ from the caliper by rounding alone (1e-9) are inside. On a line the most pairs are found by letting cases, ascending, take the lowest control that is left.
    """
    out = None
    for width in calipers:
        rule = Rule(caliper=width + 1e-9, order="value", lowest=True)
        rows = _frame(df, who, value, case, rule, None)
        n = rows.agg(F.count_if("is_case").alias("n_cases"))
        found = reachable(rows, rule.caliper, block_rows) if _dense(rows, rule, dense_rows) else _counted(_in_blocks(rows, rule, block_rows), rule)
        some = found.agg(F.count_if(F.col("candidates") > 0).alias("n_with_candidate"))
        pairs = match(df, who, value, case, rule, block_rows=block_rows, dense_rows=dense_rows)[0].agg(F.count("*").alias("max_pairs"))
        found = n.crossJoin(some).crossJoin(pairs).select(F.lit(float(width)).alias("caliper"), "*")
        out = found if out is None else out.unionByName(found)
    return out


def balance(df: DataFrame, group: str, continuous: Sequence[str], stage: str) -> DataFrame:
    """(stage, variable, n, mean and sd by group, smd) of a 0/1 group, one pass."""
    rows = df.filter(F.col(group).isNotNull()).select(F.col(group).alias("g"), F.explode(F.array(*[F.struct(F.lit(c).alias("variable"), F.col(c).cast("double").alias("v")) for c in continuous])).alias("x")).select("g", "x.*").filter("v is not null")
    side = lambda k, f: f(F.when(F.col("g") == k, F.col("v")))
    out = rows.groupBy("variable").agg(side(1, F.count).alias("n_case"), side(0, F.count).alias("n_control"), side(1, F.avg).alias("mean_case"), side(0, F.avg).alias("mean_control"), side(1, F.stddev_samp).alias("sd_case"), side(0, F.stddev_samp).alias("sd_control"))
    pooled = F.sqrt((F.col("sd_case") ** 2 + F.col("sd_control") ** 2) / 2)
    return out.select(F.lit(stage).alias("stage"), "*", ((F.col("mean_case") - F.col("mean_control")) / F.nullif(pooled, F.lit(0.0))).alias("smd"))


def categorical_smd(df: DataFrame, group: str, column: str) -> DataFrame:
    """Largest |SMD| over the levels of a categorical column between groups 0 and 1 (null is a level)."""
    rows = df.filter(F.col(group).isin(0, 1)).withColumn("_l", F.coalesce(F.col(column).cast("string"), F.lit("MISSING")))
    counts = rows.groupBy("_l").agg(F.count_if(F.col(group) == 1).alias("a"), F.count_if(F.col(group) == 0).alias("b"))
    total = counts.agg(F.sum("a").alias("na"), F.sum("b").alias("nb"))
    p = counts.crossJoin(total).select((F.col("a") / F.col("na")).alias("p"), (F.col("b") / F.col("nb")).alias("q"))
    sd = F.sqrt((F.col("p") * (1 - F.col("p")) + F.col("q") * (1 - F.col("q"))) / 2)
    return p.agg(F.coalesce(F.max(F.when(sd > 0, F.abs(F.col("p") - F.col("q")) / sd).otherwise(0.0)), F.lit(0.0)).alias("max_abs_smd")).select(F.lit(column).alias("variable"), "max_abs_smd")


def match_summary(audit: DataFrame) -> DataFrame:
    return audit.groupBy(F.coalesce("reason", F.lit("complete")).alias("reason")).agg(F.count("*").alias("n_cases"), F.count_if("matched").alias("n_matched")).withColumn("share", F.col("n_cases") / F.sum("n_cases").over(Window.partitionBy()))  # a row for each reason
