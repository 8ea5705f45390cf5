"""Quantiles against NumPy: groups, nulls, ties, many ranges, merged sketches."""

import random

import numpy as np
import pytest
from pyspark.sql import functions as F

from tessera.operators import quantiles, windows


@pytest.mark.parametrize("window", [9, 10**6])
def test_exact_quantiles(spark, monkeypatch, window):
    monkeypatch.setattr(windows, "SCAN_ROWS", window)
    r = random.Random(window)
    rows = [(r.choice(["a", "b", None]), r.choice([None, float(r.randint(0, 9)), r.gauss(0, 1)]), r.choice([None, float(r.randint(0, 3))])) for _ in range(150)] + [("empty", None, 1.0), ("one", 2.5, None)]
    df = spark.createDataFrame(rows, "g string, v double, w double").repartition(4)
    wanted = {"q1": ("v", 0.25), "median": ("v", 0.5), "top": ("v", 1.0), "low": ("v", 0.0), "p90": ("w", 0.9), "sum": (F.col("v") + F.col("w"), 0.3)}
    got = {x.g: x for x in quantiles.exact(df, ["g"], wanted).collect()}
    assert set(got) == {"a", "b", None, "empty", "one"}
    for g in got:
        own = [x for x in rows if x[0] == g]
        sides = {"v": [x[1] for x in own if x[1] is not None], "w": [x[2] for x in own if x[2] is not None], "sum": [x[1] + x[2] for x in own if None not in x[1:]]}
        for name, (column, share) in wanted.items():
            values = sides[column if isinstance(column, str) else "sum"]
            want = None if not values else pytest.approx(float(np.quantile(values, share)), abs=1e-12)
            assert got[g][name] == want, (g, name)
    whole = quantiles.with_exact(df, [], [F.count("*").alias("n")], {"median": ("v", 0.5)}).first()
    assert (whole.n, whole.median) == (len(rows), pytest.approx(float(np.median([x[1] for x in rows if x[1] is not None]))))
    nothing = quantiles.exact(df.limit(0), [], {"median": ("v", 0.5)}).collect()
    assert [x.median for x in nothing] == [None]
    with pytest.raises(ValueError, match="share"):
        quantiles.exact(df, [], {"x": ("v", 1.5)})


def test_sketches_merge_within_their_bound(spark):
    df = spark.range(40_000).select((F.col("id") % 7).alias("batch"), F.when(F.col("id") % 3 == 0, "a").otherwise("b").alias("g"), F.pmod(F.xxhash64("id"), F.lit(10**6)).cast("double").alias("v"))
    shares = {"p01": 0.01, "p25": 0.25, "p50": 0.5, "p99": 0.99}
    parts = quantiles.sketch(df, ["g", "batch"], "v")
    assert parts.agg(F.max(F.octet_length("sketch"))).first()[0] < 20_000
    got = {x.g: x for x in quantiles.approximate(quantiles.merged(parts, ["g"]), ["g"], shares).collect()}
    values = {g: np.sort([x.v for x in df.filter(F.col("g") == g).select("v").collect()]) for g in "ab"}
    for g, v in values.items():
        assert got[g].n == len(v)
        for name, share in shares.items():
            assert abs(np.searchsorted(v, got[g][name]) / len(v) - share) < 0.015
    none = quantiles.approximate(quantiles.sketch(df.withColumn("v", F.lit(None).cast("double")), ["g"], "v"), ["g"], shares).collect()
    assert {(x.n, x.p50) for x in none} == {(0, None)}
