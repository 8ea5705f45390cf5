"""Greedy matching of dense strata in rounds of proposals, with bounded groups.

Cases take turns in a fixed order, so all controls rank cases alike, and the sequential greedy's answer is the one stable matching: each case proposes to its
nearest control that does not hold an earlier case; a control keeps the earliest case and sends the other one on. The order of proposals doesn't matter as long as
a case only passes over controls that refuse it, and a refusal is final, as holders only become earlier. A case that takes up to ``ratio`` controls
proposes for each in turn, as ``ratio`` cases of which the first has the earliest turn.

Controls of a stratum are cut into blocks of ascending values (about ``block_rows`` each; a value with more than that many controls is cut further, by id).
In a round, each block takes the cases that visit it, earliest turn first. A visitor looks for its nearest control on the left or on the right, if that
side's search has come to this block; it proposes if nothing on the other side can be nearer (a bound that it carries), and goes on to the block of
the other side, or to the next one that can have a free control, otherwise. So a task holds one block and its visitors, whatever is inside a caliper; what
the driver holds is three numbers for each block. Rounds end when no case is on its way.
"""

from __future__ import annotations

import heapq
from bisect import bisect_left
from collections.abc import Iterator
from dataclasses import dataclass

import numpy as np
import pandas as pd
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from ..sources.shared import written
from .checks import CheckFailed
from .windows import scan

FAR = float("inf")
FREE = 2**62  # holder of a control that nobody holds
END = -1  # a search that is over
SEEKER = "sub long, case_id string, value double, lblock long, ldist double, lid string, rblock long, rdist double, rid string"
SEEKER_COLUMNS = [c.split()[0] for c in SEEKER.split(", ")]
STEP = f"kind string, block long, control_id string, control_value double, {SEEKER}, latest long"
ROUNDS = 100_000


@dataclass(frozen=True)
class Blocks:
    """Of each block, by number: lowest and highest value, the next block for a search to the left and to the right (or END)."""

    low: np.ndarray
    high: np.ndarray
    left: np.ndarray
    right: np.ndarray
    first_of: dict[str, tuple[int, int]]  # numbers of a stratum's blocks: first, and one after the last


def cut(controls: DataFrame, block_rows: int) -> tuple[DataFrame, Blocks]:
    """Controls (stratum, id, value) with their block. Numbers ascend with stratum, value and, inside of one value, id.

    A block holds whole values, or a part of one value that alone has more rows than a block.
    """
    of_value = scan(controls.groupBy("stratum", "value").agg(F.count("*").alias("n")), ["stratum"], [F.col("value")], sums={"upto": F.col("n")})
    heavy = F.col("n") > block_rows
    of_value = written(of_value.withColumn("range", 2 * F.floor((F.col("upto") - F.col("n")) / block_rows) + heavy.cast("int")), "values")
    placed = controls.join(of_value.select("stratum", "value", "range", heavy.alias("heavy")), ["stratum", "value"])
    split = scan(placed.filter("heavy"), ["stratum", "value"], [F.col("id")], number="k").withColumn("part", F.floor((F.col("k") - 1) / block_rows)).drop("k")
    placed = written(placed.filter("not heavy").withColumn("part", F.lit(0).cast("long")).unionByName(split), "placed")
    table = placed.groupBy("stratum", "range", "part").agg(F.min("value").alias("low"), F.max("value").alias("high")).orderBy("stratum", "low", "part").toPandas()  # a row for block_rows rows
    k = len(table)
    low, high, stratum = table.low.to_numpy(float), table.high.to_numpy(float), table.stratum.to_numpy(object)
    right = np.arange(1, k + 1)
    right[np.append(stratum[1:] != stratum[:-1], True)[:k]] = END
    left = np.full(k, END)
    # to the left, parts of one value come in the order of ids too, before lower values
    order = np.lexsort((np.arange(k), -low, pd.factorize(stratum)[0])) if k else np.zeros(0, int)
    same = stratum[order][1:] == stratum[order][:-1]
    left[order[:-1][same]] = order[1:][same]
    names, at = np.unique(stratum.astype(str), return_index=True) if k else ([], [])
    ends = np.append(at[1:], k) if k else at
    numbers = controls.sparkSession.createDataFrame(table[["stratum", "range", "part"]].assign(block=np.arange(k)) if k else pd.DataFrame(columns=["stratum", "range", "part", "block"]), "stratum string, range long, part long, block long")
    return placed.join(F.broadcast(numbers), ["stratum", "range", "part"]).select("block", "id", "value"), Blocks(low, high, left, right, {str(n): (int(a), int(b)) for n, a, b in zip(names, at, ends, strict=True)})


def starts(blocks: Blocks, stratum: str, value: float) -> tuple[int, int]:
    """Where searches begin: the nearest block with lower values, and the first one with values from ``value`` on."""
    a, b = blocks.first_of.get(stratum, (0, 0))
    right = a + int(np.searchsorted(blocks.high[a:b], value, "left"))
    left = a + int(np.searchsorted(blocks.low[a:b], value, "left")) - 1
    if left >= a:  # the first part of that value
        left = a + int(np.searchsorted(blocks.low[a : left + 1], blocks.low[left], "left"))
    return left if left >= a else END, right if right < b else END


def _gap(blocks: Blocks, block: int, value: float, side: int) -> float:
    """What a search on this side can find in a block at the nearest."""
    return max(0.0, value - blocks.high[block] if side == 0 else blocks.low[block] - value)


class Line:
    """Controls on a line, sorted by value and id, of which some are left; each search takes a few steps however many are gone."""

    def __init__(self, values: np.ndarray, ids: list):
        self.values, self.ids, n = values, ids, len(ids)
        self.sorted = values.tolist()
        self.up, self.down = list(range(n + 1)), list(range(-1, n))  # down is shifted by one: place i is down[i + 1]

    def kill(self, i: int) -> bool:
        """Whether it was there."""
        if self.up[i] != i:
            return False
        self.up[i], self.down[i + 1] = i + 1, i - 1
        return True

    def next(self, i: int) -> int:
        """The first one left from place i on, or n."""
        up = self.up
        while up[i] != i:
            up[i] = up[up[i]]
            i = up[i]
        return i

    def last(self, i: int) -> int:
        """The last one left up to place i, or -1."""
        down = self.down
        while i >= 0 and down[i + 1] != i:
            j = down[i + 1]
            if j >= 0:
                down[i + 1] = down[j + 1]
            i = j
        return i

    def below(self, value: float) -> int:
        """The nearest one left with a lower value, the first of its ids, or -1."""
        i = self.last(bisect_left(self.sorted, value) - 1)
        return self.next(bisect_left(self.sorted, self.sorted[i])) if i >= 0 else -1

    def above(self, value: float) -> int:
        """The nearest one left from the value on, the first of its ids, or n."""
        return self.next(bisect_left(self.sorted, value))


def visit(controls: pd.DataFrame, cases: pd.DataFrame, blocks: Blocks, latest: np.ndarray, caliper: float) -> Iterator[tuple]:
    """One round of a block: rows of STEP, kind hold (a control and its case), seek (a case on its way to ``block``), or block (the latest holder there).

    ``cases`` has the visitors and, with a control_id, the holders.
    """
    controls = controls.sort_values(["value", "id"])
    block = int(controls.block.iloc[0])
    values, ids = controls.value.to_numpy(float), controls.id.tolist()
    n = len(ids)
    holder: list = [None] * n
    place = {x: i for i, x in enumerate(ids)}
    visitors = []
    for row in cases[[*SEEKER_COLUMNS, "control_id"]].itertuples(index=False, name=None):
        if row[-1] is None or row[-1] != row[-1]:
            visitors.append(list(row[:-1]))
        else:
            holder[place[row[-1]]] = list(row[:-1])
    heapq.heapify(visitors)
    dying = sorted((h[0], i) for i, h in enumerate(holder) if h is not None)
    alive, dead = Line(values, ids), 0

    def onward(seeker: list, side: int) -> None:
        """The search on this side goes to the next block that can have something for it."""
        at, follow = (3, blocks.left) if side == 0 else (6, blocks.right)
        to = int(follow[block])
        while to != END and _gap(blocks, to, seeker[2], side) <= caliper and latest[to] < seeker[0]:
            to = int(follow[to])
        if to != END and _gap(blocks, to, seeker[2], side) > caliper:
            to = END
        seeker[at : at + 3] = [to, _gap(blocks, to, seeker[2], side) if to != END else FAR, ""]

    while visitors:
        seeker = heapq.heappop(visitors)
        sub, value = seeker[0], seeker[2]
        while dead < len(dying) and dying[dead][0] < sub:
            alive.kill(dying[dead][1])
            dead += 1
        found = [None, None]
        if seeker[3] == block:
            i = alive.below(value)
            if i >= 0 and abs(values[i] - value) <= caliper:
                found[0] = i
                seeker[4:6] = [abs(values[i] - value), ids[i]]
            elif i >= 0:
                seeker[3:6] = [END, FAR, ""]
            else:
                onward(seeker, 0)
        if seeker[6] == block:
            i = alive.above(value)
            if i < n and abs(values[i] - value) <= caliper:
                found[1] = i
                seeker[7:9] = [abs(values[i] - value), ids[i]]
            elif i < n:
                seeker[6:9] = [END, FAR, ""]
            else:
                onward(seeker, 1)
        if seeker[3] == END and seeker[6] == END:
            continue  # no control for it
        side = 0 if seeker[6] == END or (seeker[3] != END and (seeker[4], seeker[5]) < (seeker[7], seeker[8])) else 1
        i = found[side]
        if i is None:
            yield ("seek", seeker[3] if side == 0 else seeker[6], None, None, *seeker, None)
            continue
        if holder[i] is not None:
            heapq.heappush(visitors, holder[i])
        holder[i] = seeker
        alive.kill(i)
    for i, h in enumerate(holder):
        if h is not None:
            yield ("hold", block, ids[i], float(values[i]), *h, None)
    yield ("block", block, None, None, *[None] * 9, FREE if any(h is None for h in holder) else max(h[0] for h in holder))


def pairs(rows: DataFrame, turns: DataFrame, ratio: int, caliper: float, block_rows: int, upward: bool = False) -> DataFrame:
    """(case_id, control_id, match_rank, priority, case_value, control_value, value_distance) of the sequential greedy.

    ``rows``: stratum, id, value, is_case, one row for each person; ``turns``: id and turn of the cases, over all strata. With ``upward`` cases take the lowest
    control from their own value on.
    """
    controls, blocks = cut(rows.filter("not is_case").select("stratum", "id", "value"), block_rows)
    controls = written(controls.repartition("block"), "controls")
    columns = [c.split()[0] for c in STEP.split(", ")]

    def begin(batches):
        for frame in batches:
            out = []
            for stratum, case, value, turn in frame.itertuples(index=False, name=None):
                left, right = starts(blocks, stratum, value)
                bound = [_gap(blocks, b, value, s) if b != END else FAR for s, b in enumerate((left, right))]
                if bound[0] > caliper or upward:
                    left, bound[0] = END, FAR
                if bound[1] > caliper:
                    right, bound[1] = END, FAR
                if left == right == END:
                    continue
                to = left if bound[0] < bound[1] else right
                out += [("seek", to, None, None, turn * ratio + k, case, value, left, bound[0], "", right, bound[1], "", None) for k in range(ratio)]
            yield pd.DataFrame(out, columns=columns)

    def step(latest: np.ndarray):
        def of_block(here: pd.DataFrame, there: pd.DataFrame) -> pd.DataFrame:
            return pd.DataFrame(list(visit(here, there, blocks, latest, caliper)), columns=columns)

        return of_block

    cases = rows.filter("is_case").join(turns, "id").select("stratum", "id", "value", "turn")
    state = written(cases.mapInPandas(begin, STEP), "round")
    latest = np.full(len(blocks.low), FREE)
    for _ in range(ROUNDS):
        visited = state.filter("kind = 'seek'").groupBy("block").count()
        if not visited.limit(1).count():
            break
        visited = written(visited, "visited")  # a row for each block at most
        here = controls.join(F.broadcast(visited), "block", "left_semi")
        moving = state.filter("kind != 'block'").join(F.broadcast(visited), "block", "left_semi")
        moved = here.groupBy("block").cogroup(moving.groupBy("block")).applyInPandas(step(latest.copy()), STEP)
        still = state.filter("kind = 'hold'").join(F.broadcast(visited), "block", "left_anti")
        state = written(still.unionByName(moved), "round")
        for r in state.filter("kind = 'block'").select("block", "latest").collect():  # a row for each block at most
            latest[r.block] = r.latest
    else:
        raise CheckFailed(f"no end after {ROUNDS} rounds")
    found = state.filter("kind = 'hold'").select("case_id", "control_id", F.floor(F.col("sub") / ratio).alias("priority"), "sub", F.col("value").alias("case_value"), "control_value", F.abs(F.col("control_value") - F.col("value")).alias("value_distance"))
    rank = F.row_number().over(Window.partitionBy("case_id").orderBy("sub"))  # ratio rows at most
    return found.withColumn("match_rank", rank).select("case_id", "control_id", "match_rank", "priority", "case_value", "control_value", "value_distance")


def inside(values: np.ndarray, x: float, caliper: float) -> tuple[int, int]:
    """First place of ascending values within the caliper, and the one after the last."""
    first, stop = int(np.searchsorted(values, x - caliper - 1e-9)), int(np.searchsorted(values, x + caliper + 1e-9, "right"))
    while first < stop and abs(values[first] - x) > caliper:
        first += 1
    while first < stop and abs(values[stop - 1] - x) > caliper:
        stop -= 1
    return first, stop


def reachable(rows: DataFrame, caliper: float, block_rows: int) -> DataFrame:
    """(id, candidates): controls inside the caliper of each case, from whole blocks and the two at the edges."""
    controls, blocks = cut(rows.filter("not is_case").select("stratum", "id", "value"), block_rows)
    sizes = {r.block: r["count"] for r in controls.groupBy("block").count().collect()}  # a row for block_rows rows
    before = np.concatenate(([0], np.cumsum([sizes[k] for k in range(len(blocks.low))]))).astype(np.int64)

    def edges(batches):
        for frame in batches:
            out = []
            for stratum, case, value in frame.itertuples(index=False, name=None):
                a, b = blocks.first_of.get(stratum, (0, 0))
                # blocks that are surely inside are counted whole; the others that may reach in are asked
                start, stop = a + int(np.searchsorted(blocks.high[a:b], value - caliper - 1e-9)), a + int(np.searchsorted(blocks.low[a:b], value + caliper + 1e-9, "right"))
                first, last = a + int(np.searchsorted(blocks.low[a:b], value - caliper + 1e-9)), a + int(np.searchsorted(blocks.high[a:b], value + caliper - 1e-9, "right"))
                first, last = (first, last) if first < last else (start, start)
                out.append((case, value, None, int(before[last] - before[first])))
                out += [(case, value, k, 0) for k in (*range(start, first), *range(last, stop))]
            yield pd.DataFrame(out, columns=["id", "value", "block", "sure"])

    asked = written(rows.filter("is_case").select("stratum", "id", "value").mapInPandas(edges, "id string, value double, block long, sure long"), "asked")

    def count(here: pd.DataFrame, there: pd.DataFrame) -> pd.DataFrame:
        values = np.sort(here.value.to_numpy(float))
        out = []
        for case, x in zip(there.id, there.value, strict=True):
            first, stop = inside(values, x, caliper)
            out.append((case, stop - first))
        return pd.DataFrame(out, columns=["id", "sure"])

    some = controls.groupBy("block").cogroup(asked.filter("block is not null").select("id", "value", "block").groupBy("block")).applyInPandas(count, "id string, sure long")
    return asked.filter("block is null").select("id", "sure").unionByName(some).groupBy("id").agg(F.sum("sure").alias("candidates"))
