"""What each filter of a set removes, in every order in which the filters can be applied.

1. ``failures``: one pass over the texts gives a bit for every filter that a document fails.
2. ``cells``: documents are counted by part and bits (32 cells a part at most), with those that are labelled good or toxic.
3. ``audit``: a recursive CTE starts with the empty prefix for every cell and extends prefixes by each letter that is not in them, carrying
   the bits of the filters applied so far. Each level says, for the filter it adds and for each cell, whether it is removed there, was removed
   before, or stays. Counts are joined to these outcomes by cell, summed by part and prefix, and a whole order looks up its five
   prefixes. The recursion has 325 prefixes x 32 cells at most, whatever the documents are (far below the engine's limit of a million rows).

All of it is DataFrame functions and SQL. Filters (words are maximal runs of ``[^\\x20\\x09-\\x0D]``):

* A: under 100 words; B: 100 x distinct words < 80 x words; C: 100 x ``[A-Z]`` > 10 x code points; D: one of ``#$%&*|``;
* E: identical to the text of a smaller doc_id anywhere in the table. Texts are compared by SHA-256.

Null texts are empty, null parts an empty string. A null doc_id is larger than all others; rows with the same doc_id and text are no copies of
each other. Labels count for every row with their doc_id (a null one has none), and a doc_id with several labels is good or toxic if one of them
says so. An empty table gives no rows. Other columns are not read. A hot text is one row of (hash, doc_id) for each copy in a join with the least
doc_id of its hash, which adaptive execution splits.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from ._shared import stored

LETTERS = "ABCDE"
BIT = {x: 1 << i for i, x in enumerate(LETTERS)}
WORD = r"[^\x20\x09-\x0D]+"
METRICS = ("kept", "removed", "redundant", "unique_fails", "good_lost", "toxic_lost")

STEPS = """
WITH RECURSIVE walk (prefix, letter, step, before, applied, mask) AS (
  SELECT '', '', 0, 0, 0, mask FROM {masks}
  UNION ALL
  SELECT concat(prefix, f.letter), f.letter, step + 1, applied, applied | f.bit, mask
  FROM walk LATERAL VIEW explode(filter({letters}, x -> NOT contains(prefix, x.letter))) AS f
)
SELECT prefix, letter, step, mask,
       (mask & applied) = 0 AS stays,
       (mask & before) = 0 AND (mask & applied) <> 0 AS goes,
       (mask & before) <> 0 AND (mask & (applied - before)) <> 0 AS gone,
       mask = applied - before AS alone
FROM walk WHERE step > 0
"""


def failures(text: Column) -> Column:
    """The bits of filters A to D that a text fails."""
    words = F.regexp_extract_all(text, F.lit(WORD), F.lit(0))
    n, distinct = F.size(words), F.size(F.array_distinct(words))
    capitals = F.length(text) - F.length(F.regexp_replace(text, "[A-Z]", ""))
    fails = {"A": n < 100, "B": 100 * distinct.cast("long") < 80 * n.cast("long"), "C": 100 * capitals.cast("long") > 10 * F.length(text).cast("long"), "D": text.rlike("[#$%&*|]")}
    return sum((F.when(c, BIT[x]).otherwise(0) for x, c in fails.items()), F.lit(0))


def cells(docs: DataFrame, labels: DataFrame, part: str = "lang") -> DataFrame:
    """part, mask, n, good, toxic: documents by part and failed filters."""
    text = F.coalesce(F.col("text").cast("string"), F.lit(""))
    seen = docs.select(F.col("doc_id").cast("long").alias("doc_id"), F.coalesce(F.col(part).cast("string"), F.lit("")).alias("part"), F.unhex(F.sha2(text, 256)).alias("hash"), failures(text).alias("mask"))
    seen = stored(seen, "failures")
    least = seen.groupBy("hash").agg(F.min("doc_id").alias("least"), F.count("*").alias("copies")).filter("copies > 1").select("hash", "least")
    later = (F.col("doc_id") > F.col("least")) | (F.col("doc_id").isNull() & F.col("least").isNotNull())
    judged = seen.join(least, "hash", "left").select("doc_id", "part", (F.col("mask") + F.when(later, BIT["E"]).otherwise(0)).alias("mask"))
    marks = labels.groupBy(F.col("doc_id").cast("long").alias("doc_id")).agg(F.max((F.col("quality") == 1).cast("int")).alias("good"), F.max((F.col("toxic") == 1).cast("int")).alias("toxic"))
    return judged.join(marks, "doc_id", "left").groupBy("part", "mask").agg(F.count("*").alias("n"), F.coalesce(F.sum("good"), F.lit(0)).alias("good"), F.coalesce(F.sum("toxic"), F.lit(0)).alias("toxic"))


def audit(cells: DataFrame) -> DataFrame:
    """part, filter_order, step, filter, METRICS and shapley, zeros included, from a table of cells that is cheap to read."""
    spark = cells.sparkSession
    letters = "array(" + ", ".join(f"named_struct('letter', '{x}', 'bit', {b})" for x, b in BIT.items()) + ")"
    outcomes = spark.sql(STEPS.replace("{letters}", letters), masks=cells.select("mask").distinct())

    def total(flag: str, what: str = "n") -> Column:
        return F.sum(F.when(F.col(flag), F.col(what)).otherwise(0))

    counts = cells.join(outcomes, "mask").groupBy("part", "prefix", "letter", "step").agg(
        total("stays").alias("kept"), total("goes").alias("removed"), total("gone").alias("redundant"), total("alone").alias("unique_fails"), total("goes", "good").alias("good_lost"), total("goes", "toxic").alias("toxic_lost")
    )
    # a whole order shares its first letters with others: each prefix of k letters stands in (5 - k)! of them
    counts = stored(counts, "prefixes")
    orders = counts.filter(F.col("step") == len(LETTERS)).select("part", F.col("prefix").alias("filter_order"))
    steps = orders.select("part", "filter_order", F.explode(F.sequence(F.lit(1), F.lit(len(LETTERS)))).alias("step")).withColumn("prefix", F.expr("left(filter_order, step)"))
    orders_of = F.element_at(F.array(*map(F.lit, (24, 6, 2, 1, 1))), F.col("step"))
    shapley = counts.groupBy("part", "letter").agg(F.sum(F.col("removed") * orders_of).alias("shapley"))
    out = steps.join(counts, ["part", "prefix", "step"]).join(shapley, ["part", "letter"])
    return out.select("part", "filter_order", "step", F.col("letter").alias("filter"), *METRICS, "shapley")


def report(docs: DataFrame, labels: DataFrame, part: str = "lang") -> DataFrame:
    """``audit`` of the documents' ``cells``."""
    return audit(stored(cells(docs, labels, part), "cells"))
