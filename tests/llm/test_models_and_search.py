"""URL rules, nearest neighbours, toxicity, language and the pipeline."""

import corpus
import duckdb
import numpy as np
import pytest
from pyspark.sql import functions as F

from tessera.llm import ann, language, queries, toxicity, url_rules

SF = "/root/testdata/sf0.01"


def test_url_rules(spark):
    rules = url_rules.rules_frame(spark, queries.URL_RULES)
    urls = [None, "", "no scheme.com/en/", "http://A.Example.COM/en/7x?y#z", "https://example.com/en/8", "ftp://badexample.com/en/7", "x://com/en/", "http://net", "http://net/de/1#/", "http://w.example.net/de/80", "http://a.org/es/q?r=http://b.com/en/", "http://a.org/ES/", "://com/en/" + "p" * 5000, "http://" + "a." * 300 + "com/en/x", "http://e.com\n/en/ü", "http://example.com/en/7"]
    pages = spark.createDataFrame([(i, u, 1) for i, u in enumerate([*urls, urls[3]])], "page_id long, url string, rule int")
    got = [(r.page_id, r.rule, r.verdict) for r in url_rules.apply_rules(pages, rules).orderBy("page_id").collect()]
    want = []
    import re

    for i, u in enumerate([*urls, urls[3]]):
        m = re.match(r"(?s).*?://([^/?#]*)([^?#]*)", u or "")
        host, path = (m[1].lower(), m[2]) if m else ("", "")
        fits = []
        for action, rule in queries.URL_RULES:
            h, _, p = rule.partition("/")
            if (host == h or host.endswith("." + h)) and path.startswith("/" + p):
                fits.append((len(rule), rule, action))
        best = max(fits, default=(0, None, "allow"))
        want.append((i, best[1], best[2]))
    assert got == want
    none = rules.limit(0)
    assert {r.verdict for r in url_rules.apply_rules(pages, none).collect()} == {"allow"}
    assert url_rules.apply_rules(pages.limit(0), rules).count() == 0


def test_nearest_neighbours(spark):
    r = np.random.default_rng(2)
    base = r.normal(size=(300, 20))
    base[50:90] = base[0]  # many copies
    base[7] = base[6] * 3
    rows = [(i, [float(np.float32(x)) for x in v], 0) for i, v in enumerate(base)]
    bad = [(900, None, 0), (901, [0.0] * 20, 0), (902, [float("nan")] + [1.0] * 19, 0), (903, [1.0, None] + [1.0] * 18, 0), (None, rows[3][1], 0), (904, [float("inf")] + [1.0] * 19, 0), (905, [1.0], 0), rows[4]]
    df = spark.createDataFrame(rows + bad, "vec_id long, embedding array<float>, rank int").repartition(4)
    got = {}
    for x in ann.search(df, df.filter("vec_id % 10 = 0"), 5).collect():
        got.setdefault(x.query_id, []).append((x["rank"], x.vec_id, x.score))
    v = np.array([x[1] for x in rows])
    unit = v / np.linalg.norm(v, axis=1)[:, None]
    hits = total = 0
    for q in range(0, 300, 10):
        s = unit @ unit[q]
        s[q] = -9
        order = np.lexsort((np.arange(300), -np.round(s, 12)))[:5]
        mine = sorted(got[q])
        assert [x[0] for x in mine] == [1, 2, 3, 4, 5]
        assert all(abs(x[2] - s[x[1]]) < 1e-12 for x in mine)
        hits += len({x[1] for x in mine} & set(order.tolist()))
        total += 5
    assert set(got) == set(range(0, 300, 10)) and hits / total >= 0.9
    few = spark.createDataFrame(rows[:3], "vec_id long, embedding array<float>, rank int")
    assert ann.search(few, few.filter("vec_id = 0"), 5).count() == 2
    assert ann.search(few.limit(0), few.limit(0), 5).count() == 0


def test_search_repeats_neither_side_through_the_driver(spark, monkeypatch):
    r = np.random.default_rng(3)
    df = spark.createDataFrame([(i, v.tolist()) for i, v in enumerate(r.normal(size=(900, 16)))], "vec_id long, embedding array<double>")
    asked = df.filter("vec_id % 10 = 0")
    found = ann.search(df, asked, 5)
    whole = sorted(tuple(x) for x in found.collect())
    assert "Broadcast" not in found._jdf.queryExecution().executedPlan().toString()
    # several blocks of queries in two groups, several parts of the entries
    monkeypatch.setattr(ann, "QUERY_BLOCK", 20)
    monkeypatch.setattr(ann, "QUERY_GROUP", 3 * 20 * 16 * 8)
    monkeypatch.setattr(ann, "ENTRY_PART", 300)
    found = ann.search(df, asked, 5)
    assert sorted(tuple(x) for x in found.collect()) == whole and len(whole) == 450
    assert "Broadcast" not in found._jdf.queryExecution().executedPlan().toString()


@pytest.mark.parametrize("dim", [20, 64, 130])
def test_estimates_from_packed_words(dim):
    r = np.random.default_rng(dim)
    turn = ann.rotation(dim)
    assert turn.shape[1] % 64 == 0 and np.allclose(turn @ turn.T, np.eye(dim))
    o, q = (ann._unit(r.normal(size=(n, dim))) for n in (400, 30))
    rotated = o @ turn
    codes = np.packbits(rotated > 0, axis=1).view(np.uint64)
    c = (np.abs(rotated).sum(axis=1) / np.sqrt(turn.shape[1])).astype(np.float32)
    near, error = ann.estimates(q @ turn, codes, c)
    off = np.abs(near - q @ o.T)
    assert near.shape == off.shape and (off <= error).mean() > 0.99
    # the product with the signs themselves, but for the rounding of the query
    plain = (q @ turn) @ (2.0 * (rotated > 0) - 1).T / (np.sqrt(turn.shape[1]) * c)
    assert np.abs(near - plain).max() < 0.15 and np.abs(near - plain).mean() < 0.03


@pytest.fixture(scope="module")
def tables(spark):
    return spark.read.parquet(f"{SF}/documents.parquet"), spark.read.parquet(f"{SF}/labels.parquet")


def test_language_on_held_out(tables):
    docs, _ = tables
    found = language.predict(docs, language.learn(docs)).join(docs.select("doc_id", "lang"), "doc_id")
    assert found.filter("held_out").agg(F.avg((F.col("lang") == F.col("lang_pred")).cast("double"))).first()[0] > 0.95


def test_language_edges(spark, tables):
    model = language.learn(tables[0])
    got = {r.doc_id: (r.lang_pred, r.score) for r in language.predict(corpus.with_clashes(corpus.frame(spark)), model).collect() if r.doc_id in (15, 17, 100, 20, 18)}
    assert got[15] == got[17] == got[100] == ("und", 0.0) and got[20][0] in model["langs"] and 0 <= got[18][1] <= 1
    assert language.predict(corpus.empty(spark), model).count() == 0
    nothing = language.learn(corpus.empty(spark))
    assert {r.lang_pred for r in language.predict(corpus.frame(spark), nothing).collect()} == {"und"}


def test_toxicity_on_held_out(tables):
    docs, labels = tables
    found = toxicity.classify(docs, labels)
    assert found.count() == docs.count()
    held = found.filter("held_out").join(labels.filter("toxic is not null"), "doc_id")
    rows = held.select("toxic", "score", "predicted").collect()
    pos, neg = [r.score for r in rows if r.toxic], [r.score for r in rows if not r.toxic]
    assert np.mean([(p > n) + 0.5 * (p == n) for p in pos for n in neg]) > 0.85
    assert np.mean([r.predicted for r in rows if not r.toxic]) < 0.05


def test_toxicity_edges(spark, tables):
    none = tables[1].limit(0)
    assert {(r.score, r.predicted) for r in toxicity.classify(corpus.frame(spark), none).collect()} == {(0.0, 0)}
    docs = corpus.with_clashes(corpus.frame(spark))
    kept = toxicity.keep_clean(docs, none)
    assert kept.columns == docs.columns and kept.count() == docs.count()
    assert toxicity.classify(corpus.empty(spark), none).count() == 0


def test_pipeline(spark, tmp_path):
    """Every stage on the table of the smallest size with planted cases: copies, near copies, passages of 51 words, benchmark passages."""
    import random

    import corpus_pipeline
    from pyspark.sql import Row

    r = random.Random(4)
    word = lambda: "".join(r.choice("abcdefghijklmnopqrstuvwxyz") for _ in range(r.randint(2, 7)))
    some = lambda n: " ".join(word() for _ in range(n))
    source = spark.read.parquet(f"{SF}/documents.parquet")
    bench = spark.read.parquet(f"{SF}/benchmark.parquet").filter("size(split(text, ' ')) > 14").select("text").first().text
    passage, base = some(51), some(200).split(" ")
    near = base[:100] + ["changed"] + base[101:]
    planted = {
        10**6: " ".join(base), 10**6 + 1: " ".join(base), 10**6 + 2: " ".join(near),
        10**6 + 3: f"{some(90)} {passage} {some(8)}", 10**6 + 4: f"{some(40)} {passage} {some(60)}", 10**6 + 5: f"{some(300)} {bench} {some(30)}",
        10**6 + 6: some(120), 10**6 + 7: None, 10**6 + 8: "",
    }
    rows = [Row(doc_id=i, text=t, lang="en", source="planted", n_chars=len(t) if t is not None else None) for i, t in planted.items()]
    docs = source.unionByName(spark.createDataFrame(rows, source.schema))
    docs.write.parquet(str(tmp_path / "documents.parquet"))
    for name in ("labels", "benchmark"):
        spark.read.parquet(f"{SF}/{name}.parquet").write.parquet(str(tmp_path / f"{name}.parquet"))
    sf = f"file://{tmp_path}"
    now, left = spark.read.parquet(f"{sf}/documents.parquet"), {}
    for name, stage in corpus_pipeline.STAGES:
        out = stage(spark, now, sf)
        out.write.parquet(str(tmp_path / name))
        now = spark.read.parquet(f"{sf}/{name}")
        if name != "packing":
            assert now.columns == docs.columns
            left[name] = {x.doc_id: x.text for x in now.collect()}
    # toxicity: what the classifier rejects goes, whatever else stays
    flagged = {x.doc_id for x in toxicity.classify(docs, spark.read.parquet(f"{sf}/labels.parquet")).filter("predicted = 1").collect()}
    assert flagged and set(left["toxicity"]) == {x.doc_id for x in docs.select("doc_id").collect()} - flagged
    # near copies: one of each group, judged on what toxicity left
    brute = corpus_groups([(i, t) for i, t in left["toxicity"].items()])
    assert sorted(left["simhash"]) == sorted(brute)
    assert 10**6 in left["simhash"] and not {10**6 + 1, 10**6 + 2} & set(left["simhash"])
    # passages: words and their order are those of the brute force
    from test_text_operators import first_copies

    cut = first_copies([(i, t or "") for i, t in left["simhash"].items()], 51)
    assert {i: (t or "").split() for i, t in left["suffix_dedup"].items()} == {i: t.split() for i, t in cut.items()}
    assert passage in left["suffix_dedup"][10**6 + 3] and passage not in left["suffix_dedup"][10**6 + 4]
    # decontamination: exactly the documents that share ten words with an item
    hit = contaminated(left["suffix_dedup"], [x.text for x in spark.read.parquet(f"{sf}/benchmark.parquet").select("text").collect()])
    assert set(left["decontaminate"]) == set(left["suffix_dedup"]) - hit and 10**6 + 5 in hit and 10**6 + 6 in left["decontaminate"]
    # packing: every id of every document once
    pieces, sequences = {}, {}
    for x in now.collect():
        pieces.setdefault(x.doc_id, []).append((x.start, x.length, x.doc_tokens))
        sequences[x.sequence_id] = sequences.get(x.sequence_id, 0) + x.length
    assert set(pieces) == set(left["decontaminate"]) and max(sequences.values()) <= 4096
    for parts in pieces.values():
        at = 0
        for begin, n, total in sorted(parts):
            assert begin == at
            at += n
        assert at == total
    assert corpus_pipeline.run(spark, sf).count() == now.count()


def corpus_groups(data):
    from test_text_operators import brute_groups

    return brute_groups(data)


def contaminated(texts, items):
    import re

    from test_text_operators import UP

    words = lambda t: re.findall(r"[^\x00-\x2F\x3A-\x60\x7B-\x7F]+", (t or "").translate(UP))
    windows = set()
    for w in map(words, items):
        windows |= {tuple(w[i : i + 10]) for i in range(max(1, len(w) - 9))} if w else set()
    sizes = {len(w) for w in windows}
    return {i for i, t in texts.items() if any(tuple(w[k : k + n]) in windows for w in [words(t)] for n in sizes for k in range(len(w) - n + 1))}


def test_url_sql_gives_the_same_rows(spark):
    c = duckdb.connect()
    c.execute(f"create view pages as select * from '{SF}/pages.parquet'")
    want = sorted(map(str, c.execute(queries.OP3_SQL).fetchall()))
    got = sorted(str(tuple(r)) for r in queries.op3_url_rules(spark, SF).select("page_id", "host", "path", "rule", "verdict").collect())
    assert got == want
