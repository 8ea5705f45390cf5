"""Line dedup, the filter audit and periodic runs against brute force, on awkward rows."""

import hashlib
import itertools
import random
import re
from collections import Counter

import corpus
import numpy as np
import pytest
from pyspark.sql import functions as F

from tessera.llm import _perfect, filter_audit, line_dedup, periodic_runs, queries

BLANKS = " \t\n\x0b\x0c\r"
UP = str.maketrans("ABCDEFGHIJKLMNOPQRSTUVWXYZ", "abcdefghijklmnopqrstuvwxyz")
WORD = re.compile(r"[^\x20\x09-\x0D]+")
key = lambda r: tuple((x is not None, x) for x in r)
sha = lambda t: hashlib.sha256(t.encode()).hexdigest()


def result(df):
    return sorted((tuple(r) for r in df.collect()), key=key)


# lines


def lined(seed=4, n=80):
    r = random.Random(seed)
    common = ["Accept all  cookies", " ", "Ünï", "x", " Menu\t| Home ", "日本語"]
    rows = []
    for i in range(n):
        lines = [r.choice(common) if r.random() < 0.4 else corpus.sentence(r, 3) for _ in range(r.randint(1, 9))]
        lines = [r.choice(["", " ", "\t"]) + (x.upper() if r.random() < 0.3 else x) + r.choice(["", "\r", "\x0b "]) for x in lines]
        rows.append((i, "\n".join(lines) + r.choice(["", "\n", "\n\n"]), "en", "s", 1))
    hundred = "\n".join(f"line {k % 50}" for k in range(20_000))  # long, and each line in one document only
    return rows + [(200, None, None, None, None), (201, "", "en", "s", 0), (202, "\n\n", "en", "s", 0), (203, hundred, "en", "s", 1), (None, common[0], "en", "s", 1), rows[3], rows[3]]


def brute_lines(rows, min_docs, min_chars):
    keyed = [[(x, x.strip(BLANKS).translate(UP)) for x in (t or "").split("\n")] for _, t, *_ in rows]
    seen = Counter(k for lines in keyed for k in {k for _, k in lines})
    out = []
    for (i, *_), lines in zip(rows, keyed, strict=True):
        kept = [x for x, k in lines if len(k) < min_chars or seen[k] < min_docs]
        out.append((i, len(lines), len(lines) - len(kept), sha("\n".join(kept)), "\n".join(kept)))
    return sorted(out, key=key)


@pytest.mark.parametrize(("min_docs", "min_chars"), [(10, 1), (2, 4), (3, 0)])
def test_lines_of_many_documents(spark, min_docs, min_chars):
    rows = lined()
    docs = corpus.with_clashes(corpus.frame(spark, rows)).withColumns({"shard": F.lit(1), "keys": F.lit(2)})
    want = brute_lines(rows, min_docs, max(min_chars, 1))
    assert result(line_dedup.digests(docs, min_docs, min_chars)) == [w[:4] for w in want]
    assert result(line_dedup.kept_text(docs, min_docs, min_chars)) == sorted([(w[0], w[4]) for w in want], key=key)


def test_lines_of_an_empty_table(spark):
    assert result(line_dedup.digests(corpus.empty(spark))) == []
    with pytest.raises(ValueError, match="min_docs"):
        line_dedup.digests(corpus.empty(spark), min_docs=0)


def test_hot_line_and_known_index(spark, monkeypatch):
    monkeypatch.setattr(line_dedup, "SHARD_LINES", 40)
    monkeypatch.setattr(line_dedup, "GATHERED", 7)
    rows = [(i, f"hot\nown {i}", "en", "s", 1) for i in range(300)]
    docs = corpus.frame(spark, rows)
    index = line_dedup.index(docs)
    assert index.shards == 15 and index.table.agg(F.sum("n")).first()[0] == 301
    assert {r.text for r in line_dedup.kept_text(docs, 10, known=index).collect()} == {f"own {i}" for i in range(300)}
    # documents that were not indexed
    other = corpus.frame(spark, [(1, "HOT\nown 5\nnew", "en", "s", 1), (2, "nothing\n\nhere", "en", "s", 1)])
    assert result(line_dedup.kept_text(other, 10, known=index)) == [(1, "own 5\nnew"), (2, "nothing\n\nhere")]


def test_perfect_hash_numbers_every_key_once():
    for n in (0, 1, 2, 63, 5000):
        keys = np.random.default_rng(n).integers(0, 2**63, (n, 2)).astype(np.uint64)
        keys[: n // 2, 0] = 7  # told apart by the second word alone
        words, sizes = _perfect.build(keys)
        assert sorted(_perfect.numbers(words, sizes, keys).tolist()) == list(range(n))
        assert n < 100 or 64 * len(words) < 4 * n
        other = _perfect.numbers(words, sizes, keys + np.uint64(1))
        assert ((other >= -1) & (other < max(n, 1))).all()
    with pytest.raises(ValueError, match="distinct"):
        _perfect.build(np.zeros((2, 2), np.uint64))


# filters


def brute_audit(rows, labels):
    texts = [t or "" for _, t, *_ in rows]
    known = [(i, t) for (i, *_), t in zip(rows, texts, strict=True) if i is not None]
    least = {}
    for i, t in known:
        least[t] = min(i, least.get(t, i))
    good, toxic = ({i for i, *v in labels if i is not None and v[k] == 1} for k in (0, 1))
    parts = {}
    for (i, _, lang, *_), t in zip(rows, texts, strict=True):
        w = WORD.findall(t)
        fails = {"A": len(w) < 100, "B": 100 * len(set(w)) < 80 * len(w), "C": 100 * len(re.findall("[A-Z]", t)) > 10 * len(t), "D": bool(re.search("[#$%&*|]", t)), "E": t in least and (i is None or i > least[t])}
        parts.setdefault(lang or "", []).append(({x for x in "ABCDE" if fails[x]}, i in good, i in toxic))
    out = {}
    for part, docs in parts.items():
        shapley = Counter()
        for order in map("".join, itertools.permutations("ABCDE")):
            left = docs
            for k, x in enumerate(order):
                stay = [d for d in left if x not in d[0]]
                gone = [d for d in left if x in d[0]]
                again = sum(x in d[0] for d in docs) - len(gone)
                out[part, order, k + 1] = [x, len(stay), len(gone), again, sum(d[0] == {x} for d in docs), sum(d[1] for d in gone), sum(d[2] for d in gone)]
                shapley[x] += len(gone)
                left = stay
        for (p, *_), v in out.items():
            if p == part:
                v.append(shapley[v[0]])
    return sorted((*k, *v) for k, v in out.items())


def test_filters_in_all_orders(spark):
    rows = corpus.rows() + [(300 + i, "AB CD $ " * (i % 3), ("en", None, "de")[i % 3], "s", 1) for i in range(12)]
    labels = [(i, i % 2, (i // 2) % 2) for i in range(0, 320, 3)] + [(300, 1, None), (300, 0, 1), (None, 1, 1), (9999, 1, 1)]
    docs = corpus.with_clashes(corpus.frame(spark, rows)).withColumns({"part": F.lit(1), "mask": F.lit(2), "hash": F.lit(3), "good": F.lit(4)})
    found = filter_audit.report(docs, spark.createDataFrame(labels, "doc_id long, quality int, toxic int").withColumn("lang", F.lit("x")))
    assert sorted(map(tuple, found.collect())) == brute_audit(rows, labels)


def test_filters_of_empty_tables(spark):
    labels = spark.createDataFrame([], "doc_id long, quality int, toxic int")
    assert filter_audit.report(corpus.empty(spark), labels).collect() == []
    found = filter_audit.report(corpus.frame(spark, [(1, None, None, None, None)]), labels).collect()
    assert len(found) == 600 and {r.part for r in found} == {""} and {r.removed for r in found if r["filter"] == "A"} == {1} and sum(r.toxic_lost for r in found) == 0


# periodic runs


def brute_runs(w, least=24):
    out = {}
    for q in range(1, len(w) // 3 + 1):
        i = 0
        while i + q < len(w):
            if w[i] != w[i + q]:
                i += 1
                continue
            s = i
            while i + q < len(w) and w[i] == w[i + q]:
                i += 1
            if i + q - s >= max(least, 3 * q):
                out.setdefault((s, i + q - s), q)
    return sorted((s, n, q) for (s, n), q in out.items())


def brute_digest(doc_id, text, remap=None):
    w = WORD.findall(text or "")
    if remap is not None and (places := remap(doc_id, len(w))) is not None:
        w = [w[i] for i in places]
    runs = brute_runs(w)
    best = min(runs, key=lambda r: (-r[1] / r[2], r[0], r[2]), default=None)
    gone = {i for s, n, q in runs for i in range(s + q, s + n)}
    head = (*best, 1000 * best[1] // best[2]) if best else (None,) * 4
    return (doc_id, len(runs), *head, sha("".join(f"{s},{n},{q}\n" for s, n, q in runs)), sha(" ".join(x for i, x in enumerate(w) if i not in gone))), [{"start": s, "length": n, "period": q} for s, n, q in runs]


def periodic(seed):
    r = random.Random(seed)
    for _ in range(r.randint(1, 5)):
        v = r.choice([1, 2, 3, 5, 40])
        w = [r.randrange(v) for _ in range(r.randint(0, 200))]
        if r.random() < 0.6:
            for _ in range(r.randint(1, 3)):
                p, at = [r.randrange(v) for _ in range(r.randint(1, 20))], r.randint(0, len(w))
                w[at:at] = (p * 60)[: r.randint(0, len(p) * 12)]
        yield w


@pytest.mark.parametrize("seed", range(150))
def test_runs_of_word_numbers(seed):
    docs = list(periodic(seed))
    first = np.concatenate(([0], np.cumsum([len(d) for d in docs])))
    found = periodic_runs.find_runs(np.array([x for d in docs for x in d], np.int64), np.repeat(np.arange(len(docs)), np.diff(first)))
    want = [(s + int(first[k]), n, q) for k, d in enumerate(docs) for s, n, q in brute_runs(d)]
    assert list(zip(found.start.tolist(), found.length.tolist(), found.period.tolist(), strict=True)) == want


def test_grammar_spells_the_documents():
    docs = [[1, 2, 1, 2, 1, 2, 3], [], [5], [4, 4, 4, 4, 4, 4, 4, 4], [1, 2, 9, 1, 2, 9]]
    ids, owner = np.array([x for d in docs for x in d]), np.repeat(np.arange(len(docs)), [len(d) for d in docs])
    nodes = periodic_runs.grammar(ids, owner)
    assert len(nodes.rule) == sum(max(len(d) - 1, 0) for d in docs)  # one place for each inner node of each tree
    spelled = {}
    for rule, a, m, b in zip(nodes.rule.tolist(), nodes.start.tolist(), nodes.middle.tolist(), nodes.end.tolist(), strict=True):
        assert a < m < b and owner[a] == owner[b - 1]
        assert spelled.setdefault(rule, (ids[a:b].tolist(), m - a)) == (ids[a:b].tolist(), m - a)
    assert len(spelled) < len(nodes.rule)


def test_collisions_are_noticed(monkeypatch):
    monkeypatch.setattr(periodic_runs.SpanHash, "__call__", lambda self, start, end: np.zeros(len(start), np.uint64))
    with pytest.raises(RuntimeError, match="collide"):
        periodic_runs.find_runs(np.arange(60), np.zeros(60, np.int64))


@pytest.mark.parametrize("remap", [None, queries.periodic_tail])
def test_runs_of_texts(spark, remap):
    r = random.Random(2)
    rows = corpus.rows() + [(400 + i, "  ".join(f"w{x}" for x in w) + r.choice(["", "\n"]), "en", "s", 1) for i, w in enumerate(w for k in range(20) for w in periodic(k))]
    rows += [(900, "a b\tc " * 9000, "en", "s", 1), (901, "a " * 23, "en", "s", 1), (902, "a " * 24, "en", "s", 1), (903, " ".join("xyz"[k % 3] for k in range(23)) + " x y z", "en", "s", 1)]
    docs = corpus.with_clashes(corpus.frame(spark, rows)).withColumns({"runs": F.lit(1), "length": F.lit(2), "period": F.lit(3)})
    both = [brute_digest(d[0], d[1], remap) if d[0] != 900 else None for d in rows]
    found = [x for x in periodic_runs.digests(docs, remap).collect() if x.doc_id != 900]
    assert sorted(map(tuple, found), key=key) == sorted((b[0] for b in both if b), key=key)
    listed = [(x.doc_id, [y.asDict() for y in x.runs]) for x in periodic_runs.find(docs, remap).collect() if x.doc_id not in (900, None)]
    assert sorted(listed, key=str) == sorted([(d[0], b[1]) for d, b in zip(rows, both, strict=True) if b and d[0] is not None], key=str)
    if remap is None:
        long = periodic_runs.find(docs).filter("doc_id = 900").first()
        assert [tuple(x) for x in long.runs] == [(0, 27000, 3)]
        assert periodic_runs.collapsed_text(docs).filter("doc_id = 900").first().text == "a b c"


def test_runs_of_an_empty_table(spark):
    assert result(periodic_runs.digests(corpus.empty(spark))) == []
    with pytest.raises(ValueError, match="too short"):
        periodic_runs.find_runs(np.zeros(60, np.int64), np.zeros(60, np.int64), 12)
