"""A small corpus with every awkward case: nulls, empty and blank texts, long texts, ties, repeated rows, copies, near copies."""

import random

SCHEMA = "doc_id long, text string, lang string, source string, n_chars long"


def sentence(r, n):
    return " ".join("".join(r.choice("abcdefghijklmnoprstuvwäéß") for _ in range(r.randint(2, 8))) for _ in range(n)).capitalize() + "."


def rows(seed=1, n=60):
    r = random.Random(seed)
    texts = [" ".join(sentence(r, r.randint(4, 15)) for _ in range(r.randint(1, 14))) for _ in range(n)]
    passage = sentence(r, 90)
    for i in (3, 7, 11, 30):
        texts[i] += " " + passage + " " + sentence(r, 9)
    texts[12] = texts[3]  # an exact copy
    words = texts[9].split(" ")
    words[2] = "zzz"
    texts[13] = " ".join(words)  # a near copy
    texts[14] = "abc " * 700  # repeats itself
    texts[15] = texts[16] = ""
    texts[17] = " \n\t "
    texts[18] = "One"
    texts[19] = "one two three"
    texts[20] = "x" * 3000
    texts[21] = "日本語 テスト\u3000é\u00a0ß — “quotes” \u0301 don't  stop\n\n\nnow " * 30
    texts[22] = " ".join(sentence(r, 12) for _ in range(700))  # long
    out = [(i, t, ("en", "de")[i % 2], f"s{i % 3}", len(t)) for i, t in enumerate(texts)]
    out += [(100, None, None, None, None), (101, None, "en", None, 3), out[5], out[5], (3, texts[40], "en", "s0", 1), (None, texts[41], "en", "s0", 1), (None, texts[12], None, "s0", 1), (-7, texts[7], "de", "s1", 5)]
    return out


def frame(spark, data=None):
    return spark.createDataFrame(rows() if data is None else data, SCHEMA).repartition(3)


def empty(spark):
    return spark.createDataFrame([], SCHEMA)


def with_clashes(df):
    """Extra columns named like results and helpers of the operators."""
    from pyspark.sql import functions as F

    names = ["chunk", "fp", "text_hash", "score", "predicted", "held_out", "host", "path", "rule", "verdict", "start", "root", "_key", "bucket", "features"]
    return df.withColumns({c: F.lit(1) for c in names})
