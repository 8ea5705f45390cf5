"""Language identification by words first, with backoff to character n-grams.

A word (run of letters, lower case) that is known scores by its log frequency in each language. An unseen word
falls back to character n-grams of its marked form (a boundary before and after it), the longest length first: the
first length of which any n-gram is known scores the word by the mean log frequency of those. A
document's language has the largest sum; score is its share of the softmax over languages.

Learning: ``MAX_DOCS`` labelled documents outside the held-out fold at most, chosen by a hash of doc_id (a documented
bound, which bounds the broadcast model too). Words and n-grams of their whole texts are counted by Spark; all that were seen ``MIN_WORD`` or
``MIN_GRAM`` times are kept. Whole texts are scored.

Null text, or text without a letter: ``und`` with score 0; so is all text where nothing could be learned. Ties go
to the language that sorts first. Null doc_ids are scored, never learned from. lang, source and doc_id
are no inputs of a score.
"""

from __future__ import annotations

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from ._chars import bounded_sample, chars, code_hash, fold, held_out, term_hashes
from ._shared import stored
from ._tokens import gather

MAX_DOCS = 6000
MIN_WORD = 3  # times a known word was seen
MIN_GRAM = 2
LONGEST = 4  # characters of an n-gram
EDGE = "\1"
RESULT = "doc_id long, held_out boolean, lang_pred string, score double"


def learn(docs: DataFrame, max_docs: int = MAX_DOCS) -> dict:
    """Tables of words and n-grams (by length): ascending hashes and a log frequency for each language."""
    rows = docs.filter(F.col("lang").isNotNull() & F.col("text").isNotNull() & (fold() != 1)).select("doc_id", "text", "lang")
    # read four times: by words and by n-grams, to choose and to count
    sample = stored(bounded_sample(rows, "doc_id", max_docs).select("text", "lang"), "sample")
    word = F.explode(F.split(F.lower("text"), r"[^\p{L}]+"))
    words = sample.select("lang", word.alias("term")).filter("term != ''").groupBy("lang", "term").count()
    marked = F.concat(F.lit(EDGE), F.col("term"), F.lit(EDGE))
    # n-grams of every place and length, counted once for each word form and weighted by its count
    place = F.explode(F.sequence(F.lit(1), F.length("term") + 2)).alias("i")
    grams = words.select("lang", marked.alias("m"), "count", place).select("lang", "count", "m", "i", F.explode(F.array(*[F.lit(n) for n in range(1, LONGEST + 1)])).alias("n"))
    grams = grams.filter(F.col("i") + F.col("n") <= F.length("m") + 1).groupBy("lang", F.substring(F.col("m"), F.col("i"), F.col("n")).alias("term")).agg(F.sum("count").alias("count"))
    grams = grams.filter(f"term != '{EDGE}'")

    def known(counts: DataFrame, least: int) -> list:
        by_term = counts.groupBy("term").agg(F.map_from_entries(F.collect_list(F.struct("lang", "count"))).alias("by"), F.sum("count").alias("total"))
        return by_term.filter(F.col("total") >= least).collect()

    found = {0: known(words, MIN_WORD)}
    all_grams = known(grams, MIN_GRAM)
    for n in range(1, LONGEST + 1):
        found[n] = [r for r in all_grams if len(r.term) == n]
    langs = sorted({x for rows in found.values() for r in rows for x in r.by})
    tables = {}
    for n, rows in found.items():
        counts = np.array([[r.by.get(x, 0) for x in langs] for r in rows], np.float64).reshape(len(rows), len(langs))
        logs = np.log((counts + 0.5) / (counts.sum(axis=0) + 0.5 * (len(rows) + 1)))
        hashes = term_hashes([r.term for r in rows])
        order = np.argsort(hashes)
        tables[n] = (hashes[order], logs[order])
    return {"langs": langs, "tables": tables}


def _score(texts: list[str | None], model: dict) -> np.ndarray:
    """Sums of log frequencies: one row for each text, one column for each language."""
    k = len(model["langs"])
    c = chars([t.lower() if t else t for t in texts])
    if not len(c.start):
        return np.zeros((len(texts), k))
    table, logs = model["tables"][0]
    size = c.end - c.start
    total = np.zeros((len(c.start), k))
    unseen = np.ones(len(c.start), bool)
    if len(table):
        h = code_hash(c.codes)(c.start, c.end)
        at = np.minimum(np.searchsorted(table, h), len(table) - 1)
        hit = table[at] == h
        total[hit] = logs[at[hit]]
        unseen = ~hit
    left = np.flatnonzero(unseen)
    if len(left):
        # unseen words side by side, each between two edges
        span = size[left] + 2
        ends = np.cumsum(span)
        marked = np.full(ends[-1], ord(EDGE), np.uint32)
        marked[gather(np.arange(len(marked)), ends - span + 1, size[left])] = gather(c.codes, c.start[left], size[left])
        hashes = code_hash(marked)
        todo = np.arange(len(left))
        for n in range(LONGEST, 0, -1):
            table, logs = model["tables"][n]
            fits = todo[span[todo] >= n]
            if not len(table) or not len(fits):
                continue
            count = span[fits] - n + 1
            start = gather(np.arange(len(marked)), (ends - span)[fits], count)
            h = hashes(start, start + n)
            at = np.minimum(np.searchsorted(table, h), len(table) - 1)
            hit = np.flatnonzero(table[at] == h)
            word = np.repeat(np.arange(len(fits)), count)[hit]
            seen = np.bincount(word, minlength=len(fits))
            for x in range(k):
                sums = np.bincount(word, logs[at[hit], x], len(fits))
                total[left[fits], x] += np.divide(sums, seen, out=np.zeros(len(fits)), where=seen > 0)
            done = np.zeros(len(left), bool)
            done[fits[seen > 0]] = True
            todo = todo[~done[todo]]
    sums = np.concatenate((np.zeros((1, k)), np.cumsum(total, axis=0)))
    return sums[c.first[1:]] - sums[c.first[:-1]]


def predict(docs: DataFrame, model: dict) -> DataFrame:
    """doc_id, held_out, lang_pred, score of each document."""
    shared = docs.sparkSession.sparkContext.broadcast(model)

    def run(batches):
        from ._text import slices

        model = shared.value
        for part in slices(batches, "text", 300_000):
            texts = part.column("text").to_pylist()
            has = np.array([any(map(str.isalpha, t)) if t else False for t in texts], bool)
            names, scores = np.full(len(texts), "und", object), np.zeros(len(texts))
            if model["langs"]:
                sums = _score(texts, model)
                best = sums.argmax(axis=1)
                share = 1 / np.exp(np.minimum(sums - sums.max(axis=1, keepdims=True), 0)).sum(axis=1)
                names[has] = np.array(model["langs"], object)[best[has]]
                scores[has] = share[has]
            yield pa.RecordBatch.from_arrays([part.column("doc_id"), part.column("held_out"), pa.array(names, pa.string()), pa.array(scores)], names=["doc_id", "held_out", "lang_pred", "score"])

    rows = docs.select(F.col("doc_id").cast("long").alias("doc_id"), held_out().alias("held_out"), "text")
    return rows.mapInArrow(run, RESULT)
