"""What the language model and the toxicity lexicon learn, against plain counts."""

import math
import random
from collections import Counter, defaultdict

import numpy as np
import pytest
import regex

from tessera.llm import language, toxicity
from tessera.llm._chars import term_hashes

SYLLABLES = {"en": ["the", "ing", "ton", "er"], "de": ["sch", "ung", "ein", "ö"], "fr": ["eau", "é", "ille", "ou"]}


def texts(n=90):
    r = random.Random(12)
    out = []
    for i in range(n):
        lang = "ed"[i % 2] and ("en", "de", "fr")[i % 3]
        words = ["".join(r.choice(SYLLABLES[lang]) for _ in range(r.randint(1, 3))) for _ in range(r.randint(0, 40))]
        out.append((i, " ".join(w.upper() if r.random() < 0.1 else w for w in words) + r.choice(["", " 12 x_y", "!"]), lang))
    return out + [(500, None, "en"), (501, "the the", None), (None, "never never never", "en")]


def split(text):
    return [w for w in regex.split(r"[^\p{L}]+", text.lower()) if w]


def learned_from(i):
    import zlib

    return i is not None and zlib.crc32(str(i).encode()) % 3 != 1


def test_language_tables_are_plain_counts(spark):
    rows = texts()
    model = language.learn(spark.createDataFrame(rows, "doc_id long, text string, lang string").repartition(3))
    words, grams = defaultdict(Counter), defaultdict(Counter)
    for i, text, lang in rows:
        if learned_from(i) and text is not None and lang is not None:
            for w in split(text):
                words[w][lang] += 1
                marked = f"{language.EDGE}{w}{language.EDGE}"
                for n in range(1, language.LONGEST + 1):
                    for k in range(len(marked) - n + 1):
                        if marked[k : k + n] != language.EDGE:
                            grams[marked[k : k + n]][lang] += 1
    assert model["langs"] == ["de", "en", "fr"]
    kept = {0: [w for w, c in words.items() if sum(c.values()) >= language.MIN_WORD]}
    for n in range(1, language.LONGEST + 1):
        kept[n] = [g for g, c in grams.items() if len(g) == n and sum(c.values()) >= language.MIN_GRAM]
    for n, terms in kept.items():
        counts = np.array([[(words if n == 0 else grams)[t][x] for x in model["langs"]] for t in terms], float)
        logs = np.log((counts + 0.5) / (counts.sum(axis=0) + 0.5 * (len(terms) + 1)))
        hashes = term_hashes(terms)
        order = np.argsort(hashes)
        assert len(terms) and np.array_equal(model["tables"][n][0], hashes[order])
        assert np.allclose(model["tables"][n][1], logs[order])


def test_no_learned_word_is_dropped_for_its_number(spark):
    many = [(3 * k + 1, " ".join(f"{'abcdefghij'[k % 10]}{chr(97 + w // 676)}{chr(97 + w // 26 % 26)}{chr(97 + w % 26)}" for w in range(1000)) + " ", "en") for k in range(60)]
    rows = [(i + j, t, x) for i, t, x in many for j in range(3)]
    model = language.learn(spark.createDataFrame(rows, "doc_id long, text string, lang string"))
    known = Counter(w for i, t, _ in rows if learned_from(i) for w in split(t))
    assert len(model["tables"][0][0]) == sum(c >= language.MIN_WORD for c in known.values()) > 5000


@pytest.mark.parametrize("seed", [1, 2])
def test_lexicon_is_plain_log_odds(spark, seed):
    r = random.Random(seed)
    vocabulary = [f"{a}{b}{c}" for a in ("mild", "grim", "foul", "tame") for b in ("ly", "est", "er") for c in ("", "xx")]
    rows = []
    for i in range(200):
        toxic = int(i % 3 == 0)
        pool = [w for w in vocabulary if w.startswith("foul") or r.random() < 0.5] if toxic else [w for w in vocabulary if not w.startswith("foul") or r.random() < 0.03]
        rows.append((toxic, " ".join(r.choice(pool) for _ in range(r.randint(1, 12)))))
    found = {(t, start): o for t, o, start in toxicity.lexicon(spark.createDataFrame(rows, "toxic int, text string").repartition(3))}
    t, n = Counter(), Counter()
    for toxic, text in rows:
        own = set(split(text))
        terms = {(w, False) for w in own} | {(w[:k], True) for w in own for k in (4, 5) if len(w) >= k}
        for x in terms:
            n[x] += 1
            t[x] += toxic
    total = sum(x for x, _ in rows)
    want = {}
    for x in n:
        odds = math.log(((t[x] + 0.5) / (total + 1)) / ((n[x] - t[x] + 0.5) / (len(rows) - total + 1)))
        if t[x] >= toxicity.MIN_DOCS and odds >= toxicity.MIN_LOG_ODDS:
            want[x] = pytest.approx(odds)
    assert found == want and any(start for _, start in found)
    assert toxicity.lexicon(spark.createDataFrame([(1, "foul")], "toxic int, text string")) == []
