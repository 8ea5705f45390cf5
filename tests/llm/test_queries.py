"""The numbered queries themselves, over the smallest tables: against SQL where there is some, else against brute force."""

import zlib

import duckdb
import numpy as np
import public_tokenizers
import pytest
from pyspark.sql import functions as F
from test_text_operators import UP, encoded
from tokenizers import Tokenizer

from tessera.llm import language, queries, toxicity

SF = "/root/testdata/sf0.001"


@pytest.fixture(scope="module")
def docs(spark):
    return spark.read.parquet(f"{SF}/documents.parquet").orderBy("doc_id").collect()


@pytest.mark.parametrize("name", sorted(queries.oracle_sql()))
def test_same_rows_as_sql(spark, name):
    c = duckdb.connect()
    for t in ("documents", "pages", "benchmark"):
        c.execute(f"create view {t} as select * from '{SF}/{t}.parquet'")
    r = c.execute(queries.oracle_sql()[name])
    columns = [x[0] for x in r.description]
    got = queries.queries()[name](spark, SF)
    assert sorted(got.columns) == sorted(columns)
    assert sorted(str(tuple(x)) for x in got.select(*columns).collect()) == sorted(map(str, r.fetchall()))


def test_nearest_of_the_table(spark):
    rows = spark.read.parquet(f"{SF}/embeddings.parquet").select("vec_id", "embedding").orderBy("vec_id").collect()
    ids, v = np.array([r.vec_id for r in rows]), np.array([r.embedding for r in rows], float)
    unit = v / np.linalg.norm(v, axis=1)[:, None]
    got = {}
    for r in queries.op4_rotated_codes(spark, SF).collect():
        got.setdefault(r.query_id, []).append((r["rank"], r.vec_id, r.score))
    asked = [i for i in ids.tolist() if i % 50 == 0]
    assert sorted(got) == asked
    found = 0
    for q in asked:
        s = unit @ unit[np.flatnonzero(ids == q)[0]]
        s[ids == q] = -9
        best = ids[np.lexsort((ids, -np.round(s, 13)))[:5]].tolist()
        mine = sorted(got[q])
        assert [x[0] for x in mine] == [1, 2, 3, 4, 5] and all(abs(x[2] - s[ids == x[1]][0]) < 1e-12 for x in mine)
        found += len(set(best) & {x[1] for x in mine})
    assert found / (5 * len(asked)) >= 0.9


def test_token_table(spark, docs):
    ids, start, want = encoded("byte_bpe_50k.json", [d.text for d in docs]), 0, []
    for d, x in zip(docs, ids, strict=True):
        want.append((d.doc_id, start, len(x), zlib.crc32(x.tobytes())))
        start += len(x)
    assert sorted(tuple(r) for r in queries.op5_token_table(spark, SF).select("doc_id", "start", "n_tokens", "ids_crc32").collect()) == want


def test_packing(spark, docs):
    ids = {d.doc_id: x for d, x in zip(docs, encoded("word_bpe_49k.json", [d.text for d in docs]), strict=True)}
    pieces, sequences = {}, {}
    for r in queries.op8_packing(spark, SF).collect():
        assert r.ids_crc32 == zlib.crc32(ids[r.doc_id][r.start : r.start + r.length].tobytes()) and r.doc_tokens == len(ids[r.doc_id])
        pieces.setdefault(r.doc_id, []).append((r.start, r.length))
        sequences.setdefault(r.sequence_id, []).append((r.offset, r.length))
    for parts, most in [*((p, len(ids[i])) for i, p in pieces.items()), *((p, None) for p in sequences.values())]:
        at = 0
        for begin, n in sorted(parts):
            assert begin == at
            at += n
        assert at == most if most is not None else at <= 4096
    assert set(pieces) == set(ids)
    # padding is small: under a tenth even with a short last sequence in each of four ranges
    full = [sum(n for _, n in p) for p in sequences.values()]
    padded = sum(0 if n & (n - 1) == 0 else 4096 - n for n in full)
    assert padded < 0.1 * sum(full) + 4 * 4096


def test_fingerprints_and_components(spark, docs):
    import re

    import xxhash

    prints = {}
    for d in docs:
        w = re.findall(r"[^\x20\x09-\x0D]+", (d.text or "").translate(UP))
        h = [xxhash.xxh64_intdigest(" ".join(w[i : i + 4]).encode(), 42) for i in range(max(1, len(w) - 3))] if w else []
        prints[d.doc_id] = sum(1 << b for b in range(64) if 2 * sum(x >> b & 1 for x in h) > len(h))
    root = {i: i for i in prints}

    def find(x):
        while root[x] != x:
            x = root[x]
        return x

    names = sorted(prints)
    for i in names:
        for j in names:
            if j < i and (prints[i] ^ prints[j]).bit_count() <= 4:
                a, b = find(i), find(j)
                root[max(a, b)] = min(a, b)
    want = [(i, f"{prints[i]:016x}", find(i)) for i in names]
    assert sorted(tuple(r) for r in queries.op9_simhash(spark, SF).select("doc_id", "fingerprint", "component_id").collect()) == want


def test_language_scores_word_by_word(spark):
    """The score of a text, from the model's tables read as dictionaries."""
    model = {"langs": ["de", "en"], "tables": {}}
    logs = {0: {"the": (-9.0, -2.0), "und": (-2.0, -9.0)}, 1: {"z": (-3.0, -4.0)}, 2: {"qu": (-6.0, -5.5), "\1x": (-4.0, -4.5)}, 3: {"ing": (-8.0, -3.0)}, 4: {"isch": (-3.0, -8.0), "sche": (-3.5, -7.0)}}
    for n, table in logs.items():
        h = language.term_hashes(list(table))
        order = np.argsort(h)
        model["tables"][n] = (h[order], np.array([table[t] for t in table])[order])

    def word(w):
        if w in logs[0]:
            return np.array(logs[0][w])
        marked = f"\1{w}\1"
        for n in (4, 3, 2, 1):
            found = [logs[n][g] for g in (marked[i : i + n] for i in range(len(marked) - n + 1)) if g in logs[n]]
            if found:
                return np.mean(found, axis=0)
        return np.zeros(2)

    texts = ["The UND the", "deutsche singing", "xyz quz, z!", "  ", "o", None, "komische-Singing qu", "ß"]
    want = [sum((word(w) for w in language_words(t)), np.zeros(2)) for t in texts]
    assert np.allclose(language._score(texts, model), want)


def language_words(text):
    out, now = [], ""
    for x in (text or "").lower() + " ":
        if x.isalpha():
            now += x
        elif now:
            out.append(now)
            now = ""
    return out


def test_toxicity_features_one_by_one():
    """Nine features of each text, computed plainly."""
    terms = [("vile", 2.0, False), ("nast", 1.5, True), ("nasty", 2.5, True), ("rot", 3.0, False)]
    words = toxicity._lookup([(t, w) for t, w, start in terms if not start])
    starts = {k: toxicity._lookup([(t, w) for t, w, start in terms if start and len(t) == k]) for k in (4, 5)}
    second = toxicity._lookup([(t, 1.0) for t in toxicity.SECOND])
    texts = ["You are VILE, you n4sty nasty rot!", "Nastily said? Quite so. nothing here for anyone to see, rot", "", None, "a.b c'd e-f r0t!! ??", "x" * 400 + " vile " + "word " * 9 + "your"]

    def plain(text):
        text = text or ""
        w = language_words(text)
        whole = {t: x for t, x, start in terms if not start}
        begin = [max([x for t, x, start in terms if start and v.startswith(t)], default=0.0) for v in w]
        both = [max(whole.get(v, 0.0), b) for v, b in zip(w, begin, strict=True)]
        you = [i for i, v in enumerate(w) if v in toxicity.SECOND]
        near = [b > 0 and any(abs(i - j) <= toxicity.NEAR for j in you) for i, b in enumerate(both)]
        n, letters = max(1, len(w)), max(1, sum(map(str.isalpha, text)))
        sign = [not x.isalpha() and x not in " \t\n\v\f\r" for x in text]
        hidden = sum(sign[i] and text[i - 1].isalpha() and text[i + 1].isalpha() and text[i] not in "'-\u2019" for i in range(1, len(text) - 1))
        return [sum(b > 0 for b in both) / n, sum(both) / n, max(both, default=0.0), sum(b > 0 for b in begin) / n, sum(near) / n, sum(x.isupper() for x in text) / letters, sum(sign) / max(1, len(text)), sum(x in "!?" for x in text) / max(1, len(text)), hidden / n]

    got = toxicity._features(texts, words, starts, second)
    assert got.shape[1] == len(toxicity.FEATURES)
    for i, t in enumerate(texts):
        assert np.allclose(got[i], plain(t)), t


def test_scores_of_the_tables(spark):
    docs = spark.read.parquet(f"{SF}/documents.parquet")
    tox = queries.op1_toxicity(spark, SF)
    assert tox.count() == docs.count() and tox.filter("score < 0 or score > 1 or predicted != cast(score >= 0.7 as int)").count() == 0
    held = F.crc32(F.col("doc_id").cast("string").cast("binary")) % 3 == 1
    assert tox.filter(F.col("held_out") != held).count() == 0
    lang = queries.op10_language(spark, SF).join(docs.select("doc_id", "text", "lang"), "doc_id")
    assert lang.count() == docs.count() and lang.filter("score < 0 or score > 1").count() == 0
    known = {r.lang for r in docs.select("lang").distinct().collect()}
    assert {r.lang_pred for r in lang.select("lang_pred").distinct().collect()} <= known | {"und"}
    assert lang.filter("(text is null or not text rlike '\\\\p{L}') != (lang_pred = 'und')").count() == 0


def test_special_tokens_are_the_library_s(spark):
    path = str(public_tokenizers.path("word_bpe_49k.json"))
    assert Tokenizer.from_file(path).encode("a <|endoftext|> b", add_special_tokens=False).ids == [320, 49407, 321]
