"""Toxicity scores by gradient-boosted trees over dense features, with isotonic calibration.

Features of a document (whole text): densities of lexicon terms (count, weight, strongest), how near they stand to words of the second
person, and the rates of capitals, of punctuation, of exclamation and question marks and of obfuscated words (letters around digits or signs). The
lexicon holds words and word beginnings of 4 and 5 letters that labelled toxic documents have far more often.

Learning: labelled documents outside the held-out fold, ``MAX_LABELLED`` at most (a documented bound, chosen by a hash of
doc_id), in two folds: features of a labelled document come from the lexicon of the other fold, so terms never see their
own labels; the trees learn from 7 tenths of the rows and the calibration from the rest. The lexicon for scoring is that of all rows. A
document with several labels is toxic if any says so. Scoring covers every document.

Null and empty text score like a text without any term. Without labels of both classes on either side the score
is 0. Null doc_ids are scored. Repeated rows are kept. labels, lang, source and doc_id are no inputs of a
score. Extra columns pass through ``keep_clean``.
"""

from __future__ import annotations

import numpy as np
import pyarrow as pa
from pyspark.ml.classification import GBTClassifier
from pyspark.ml.functions import array_to_vector, vector_to_array
from pyspark.ml.regression import IsotonicRegression
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from ._chars import bounded_sample, chars, code_hash, fold, held_out, term_hashes
from ._shared import stored
from ._text import slices

MAX_LABELLED = 12_000
MIN_DOCS = 3  # toxic documents that have a term
MIN_LOG_ODDS = 2.0
THRESHOLD = 0.7
NEAR = 5  # words
# fixed values: second-person words of the languages served
SECOND = ["you", "your", "yours", "yourself", "u", "tu", "te", "toi", "ton", "ta", "tes", "vous", "votre", "vos", "du", "dich", "dir", "dein", "deine", "ihr", "euch", "usted", "ustedes", "tú", "ti", "tus", "vosotros"]
FEATURES = ["hits", "weight", "strongest", "beginnings", "near", "capitals", "punctuation", "marks", "obfuscated"]


def lexicon(part: DataFrame) -> list[tuple[str, float, bool]]:
    """(term, log odds, whether it is a beginning) from text and toxic: every term of ``MIN_DOCS`` toxic texts with ``MIN_LOG_ODDS``."""
    words = F.array_distinct(F.filter(F.split(F.lower("text"), r"[^\p{L}]+"), lambda w: w != ""))
    starts = F.array_union(*[F.transform(F.filter(words, lambda w: F.length(w) >= n), lambda w: F.concat(F.lit("^"), F.substring(w, 1, n))) for n in (4, 5)])
    counts = part.select("toxic", F.explode(F.array_union(words, starts)).alias("term")).groupBy("term").agg(F.sum("toxic").alias("t"), F.count("*").alias("n"))
    total = part.agg(F.coalesce(F.sum("toxic"), F.lit(0)).alias("t"), F.count("*").alias("n")).first()
    if not 0 < total["t"] < total["n"]:
        return []
    odds = F.log(((F.col("t") + 0.5) / (total["t"] + 1.0)) / ((F.col("n") - F.col("t") + 0.5) / (total["n"] - total["t"] + 1.0)))
    best = counts.filter(F.col("t") >= MIN_DOCS).withColumn("odds", odds).filter(F.col("odds") >= MIN_LOG_ODDS)
    return [(r.term.removeprefix("^"), r.odds, r.term.startswith("^")) for r in best.orderBy("term").collect()]


def _lookup(terms: list[tuple[str, float]]) -> tuple[np.ndarray, np.ndarray]:
    h = term_hashes([t for t, _ in terms])
    order = np.argsort(h)
    return h[order], np.array([w for _, w in terms], float)[order]


def _weights(table: tuple[np.ndarray, np.ndarray], hashes: np.ndarray) -> np.ndarray:
    if not len(table[0]):
        return np.zeros(len(hashes))
    at = np.minimum(np.searchsorted(table[0], hashes), len(table[0]) - 1)
    return np.where(table[0][at] == hashes, table[1][at], 0.0)


def _features(texts: list[str | None], words, starts: dict, second) -> np.ndarray:
    plain = chars(texts)
    c = chars([t.lower() if t else t for t in texts])
    n, size = len(c.start), c.end - c.start
    docs = np.repeat(np.arange(len(texts)), np.diff(c.first))
    h = code_hash(c.codes)
    whole = h(c.start, c.end)
    weight = _weights(words, whole)
    begin = np.zeros(n)
    for k, table in starts.items():
        fits = np.flatnonzero(size >= k)
        begin[fits] = np.maximum(begin[fits], _weights(table, h(c.start[fits], c.start[fits] + k)))
    both = np.maximum(weight, begin)
    # distance to the next second-person word on either side, in the same document
    you = _weights(second, whole) > 0
    far = np.full(n, 1e9)
    if you.any():
        at = np.flatnonzero(you)
        right = np.minimum(np.searchsorted(at, np.arange(n)), len(at) - 1)
        for near in (at[right], at[np.maximum(right - 1, 0)]):
            same = docs[near] == docs
            far = np.where(same, np.minimum(far, np.abs(near - np.arange(n))), far)
    count = np.maximum(np.diff(c.first), 1)

    def per_doc(values: np.ndarray, of: np.ndarray) -> np.ndarray:
        return np.bincount(of, values, len(texts))

    strongest = np.zeros(len(texts))
    np.maximum.at(strongest, docs, both)
    place = np.repeat(np.arange(len(texts)), np.diff(plain.offsets))
    length = np.maximum(np.diff(plain.offsets), 1)
    x = plain.codes
    upper = ((x >= 65) & (x <= 90)) | ((x >= 0xC0) & (x <= 0xDE) & (x != 0xD7))
    blank = (x == 32) | ((x >= 9) & (x <= 13))
    sign = ~plain.letter & ~blank
    hidden = np.zeros(len(x), bool)
    if len(x) > 2:
        hidden[1:-1] = sign[1:-1] & plain.letter[:-2] & plain.letter[2:] & (x[1:-1] != 39) & (x[1:-1] != 45) & (x[1:-1] != 0x2019)
        # not over the edges of texts
        edge = plain.offsets[1:-1]
        edge = edge[(edge > 0) & (edge < len(x))]
        hidden[edge] = hidden[edge - 1] = False
    return np.stack(
        [
            per_doc((both > 0).astype(float), docs) / count,
            per_doc(both, docs) / count,
            strongest,
            per_doc((begin > 0).astype(float), docs) / count,
            per_doc(((both > 0) & (far <= NEAR)).astype(float), docs) / count,
            per_doc(upper.astype(float), place) / np.maximum(per_doc(plain.letter.astype(float), place), 1),
            per_doc(sign.astype(float), place) / length,
            per_doc(((x == 33) | (x == 63)).astype(float), place) / length,
            per_doc(hidden.astype(float), place) / count,
        ],
        axis=1,
    )


def with_features(docs: DataFrame, terms: list[tuple[str, float, bool]], *columns: str) -> DataFrame:
    """The columns, and features array<double>, of each document."""
    shared = docs.sparkSession.sparkContext.broadcast(terms)
    rows = docs.select(*columns, "text")
    schema = ", ".join([*(f"{f.name} {f.dataType.simpleString()}" for f in rows.schema.fields if f.name != "text"), "features array<double>"])

    def run(batches):
        terms = shared.value
        words = _lookup([(t, w) for t, w, start in terms if not start])
        starts = {k: _lookup([(t, w) for t, w, start in terms if start and len(t) == k]) for k in (4, 5)}
        second = _lookup([(t, 1.0) for t in SECOND])
        for part in slices(batches, "text", 300_000):
            x = _features(part.column("text").to_pylist(), words, starts, second)
            out = pa.FixedSizeListArray.from_arrays(pa.array(x.ravel()), x.shape[1]).cast(pa.list_(pa.float64()))
            yield pa.RecordBatch.from_arrays([*(part.column(c) for c in columns), out], names=[*columns, "features"])

    return rows.mapInArrow(run, schema)


def learn(docs: DataFrame, labels: DataFrame, max_labelled: int = MAX_LABELLED) -> dict | None:
    """Lexicon, trees and calibration; None where a part has no labels of both classes."""
    rows = labels.filter(F.col("toxic").isNotNull() & (fold() != 1)).groupBy("doc_id").agg((F.max("toxic") > 0).cast("int").alias("toxic"))
    # bounded by max_labelled rows of two numbers, so it can be broadcast
    chosen = bounded_sample(rows, "doc_id", max_labelled).withColumns({"fold": F.pmod(F.xxhash64("doc_id", F.lit("fold")), F.lit(2)), "part": F.pmod(F.xxhash64("doc_id", F.lit("part")), F.lit(10))})
    sample = stored(docs.select("doc_id", "text").join(F.broadcast(chosen), "doc_id").filter("text is not null").select("toxic", "fold", "part", "text"), "labelled")
    sides = [with_features(sample.filter(F.col("fold") == k), lexicon(sample.filter(F.col("fold") != k)), "toxic", "part") for k in (0, 1)]
    terms = lexicon(sample)
    # features once; both learners read them many times
    data = stored(sides[0].unionByName(sides[1]), "features")
    balance = data.groupBy((F.col("part") < 7).alias("trees"), "toxic").count().collect()
    if not terms or len(balance) < 4:
        return None
    data = data.select(array_to_vector("features").alias("features"), F.col("toxic").cast("double").alias("toxic"), "part")
    trees = GBTClassifier(featuresCol="features", labelCol="toxic", maxIter=8, maxDepth=3, stepSize=0.3, seed=11).fit(data.filter("part < 7").coalesce(4))
    raw = trees.transform(data.filter("part >= 7")).select(vector_to_array("probability")[1].alias("raw"), "toxic")
    curve = IsotonicRegression(featuresCol="raw", labelCol="toxic", predictionCol="score").fit(raw)
    return {"terms": terms, "trees": trees, "curve": curve}


def score(docs: DataFrame, model: dict | None, *columns: str) -> DataFrame:
    """The columns (not text), score (0 to 1) and predicted (1 from ``THRESHOLD`` on) of each document."""
    if model is None:
        return docs.select(*columns).withColumns({"score": F.lit(0.0), "predicted": F.lit(0)})
    rows = with_features(docs, model["terms"], *columns).withColumn("features", array_to_vector("features"))
    raw = model["trees"].transform(rows).select(*columns, vector_to_array("probability")[1].alias("raw"))
    done = model["curve"].transform(raw).withColumn("score", F.least(F.greatest("score", F.lit(0.0)), F.lit(1.0)))
    return done.select(*columns, "score", (F.col("score") >= THRESHOLD).cast("int").alias("predicted"))


def classify(docs: DataFrame, labels: DataFrame) -> DataFrame:
    """doc_id, held_out, score, predicted of each document."""
    rows = docs.withColumn("held_out", held_out()).withColumn("doc_id", F.col("doc_id").cast("long"))
    return score(rows, learn(docs, labels), "doc_id", "held_out")


def keep_clean(docs: DataFrame, labels: DataFrame) -> DataFrame:
    """``docs`` without the documents predicted toxic; all columns."""
    model = learn(docs, labels)
    names = {c: f"_c{i}" for i, c in enumerate(docs.columns) if c != "text"}
    rows = docs.select("text", F.col("text").alias("_text"), *[F.col(f"`{c}`").alias(n) for c, n in names.items()])
    kept = score(rows, model, "_text", *names.values()).filter("predicted = 0")
    return kept.select(*[F.col("_text").alias(c) if c == "text" else F.col(names[c]).alias(c) for c in docs.columns])
