"""Operators on texts against brute force on a small corpus with awkward rows."""

import hashlib
import re
import zlib
from collections import Counter

import corpus
import numpy as np
import pyarrow as pa
import public_tokenizers
import pytest
import xxhash
from pyspark.sql import functions as F
from tokenizers import Tokenizer

from tessera.llm import decontaminate, packing, shared_windows, simhash, suffix_dedup, token_table

UP = str.maketrans("ABCDEFGHIJKLMNOPQRSTUVWXYZ", "abcdefghijklmnopqrstuvwxyz")
key = lambda r: tuple((x is not None, x) for x in r)


def result(df):
    return sorted((tuple(r) for r in df.collect()), key=key)


@pytest.fixture(scope="module")
def data():
    return corpus.rows()


@pytest.fixture(scope="module")
def docs(spark):
    return corpus.with_clashes(corpus.frame(spark))


# suffix arrays


def brute_bytes(data, length=400):
    texts = [(d[1] or "").encode() for d in data]
    seen = Counter(t[i : i + length] for t in texts for i in range(len(t) - length + 1))
    out = []
    for d, t in zip(data, texts, strict=True):
        gone = bytearray(len(t))
        for i in range(len(t) - length + 1):
            if seen[t[i : i + length]] > 1:
                gone[i : i + length] = b"\1" * length
        kept = bytes(x for x, g in zip(t, gone, strict=True) if not g)
        out.append((d[0], len(t), sum(gone), len(re.findall(b"\1+", bytes(gone))), hashlib.sha256(kept).hexdigest()))
    return sorted(out, key=key)


@pytest.mark.parametrize("hot", [700, 2])
def test_repeated_bytes(docs, data, hot):
    assert result(suffix_dedup.digests(docs, hot=hot)) == brute_bytes(data)


def shared_length(a, b):
    n = 0
    while n < min(len(a), len(b)) and a[n] == b[n]:
        n += 1
    return n


def strings():
    r = np.random.default_rng(11)
    yield b"banana bandana banana ban"
    yield b"a" * 70
    yield b"ab" * 40
    yield bytes(r.integers(97, 99, 300).astype(np.uint8))
    yield bytes(r.integers(97, 123, 200).astype(np.uint8)) * 2 + b"zz" + b"q" * 30
    thue = b"a"
    for _ in range(8):
        thue += thue.translate(bytes.maketrans(b"ab", b"ba"))
    yield thue


@pytest.mark.parametrize("kind", [np.uint8, np.uint64])
@pytest.mark.parametrize("length", [10, 13, 20])
def test_suffix_order_and_longest_previous_factors(kind, length):
    for raw in strings():
        text = np.frombuffer(raw, np.uint8).astype(kind)
        starts = np.setdiff1d(np.arange(len(text) - length + 1), [3, 4])
        at, shared = suffix_dedup.suffix_order(text, starts, length)
        cut = [raw[i : i + length] for i in at]
        assert [*zip(cut, at, strict=True)] == sorted(zip(cut, at, strict=True))
        assert shared.tolist() == [0, *(shared_length(x, y) for x, y in zip(cut, cut[1:], strict=False))]
        factor, source = suffix_dedup.longest_previous_factors(text, starts, length)
        for k, p in enumerate(starts.tolist()):
            before = [shared_length(raw[p : p + length], raw[q : q + length]) for q in starts[:k].tolist()]
            assert factor[k] == max(before, default=0)
            if factor[k]:
                assert source[k] in starts[:k] and shared_length(raw[p : p + length], raw[source[k] : source[k] + length]) == factor[k]
            else:
                assert source[k] == -1


def test_span_hashes_tell_structured_spans_apart():
    """Thue-Morse words collide under any polynomial modulo a power of two."""
    from tessera.llm._text import byte_hash, word_codes

    a = [0]
    for _ in range(11):
        a += [1 - x for x in a]
    x = np.array(a, np.uint8) + 97
    text = np.concatenate((x, 195 - x, x))
    h, n = byte_hash(text), len(x)
    one, two, three = (h(np.array([k * n]), np.array([k * n + n]))[0] for k in range(3))
    assert one == three != two and len(np.unique(h.rolling(400))) == len({bytes(text[i : i + 400]) for i in range(len(text) - 399)})
    assert byte_hash(text, True)(np.array([0]), np.array([n]))[0] != one
    a, b, c = word_codes(text, np.array([0, n, 2 * n]), np.array([n, 2 * n, 3 * n])).tolist()
    assert a == c != b
    # words of all lengths, equal ones at other places, with what follows them
    words = [bytes(text[:k]) for k in [*range(1, 40), 1023, 1024, 1025, 1026]] + [b"a\0", b"a\0\0", b"\0a"]
    joined = b"".join(w + e for w in words * 2 for e in (b" ", b"xyz "))
    starts = np.cumsum([0, *(len(w + e) for w in words * 2 for e in (b" ", b"xyz "))])[:-1:2]
    codes = word_codes(np.frombuffer(joined, np.uint8), starts, starts + np.array([len(w) for w in words * 2])).tolist()
    assert codes[: len(words)] == codes[len(words) :] and len(set(codes)) == len(words)


def brute_first(data, length):
    """Texts (distinct doc_ids, ASCII) without bytes under a window that occurs earlier."""
    seen, out = set(), {}
    for doc_id, text in sorted((d[0], d[1] or "") for d in data):
        gone = bytearray(len(text))
        for k in range(len(text) - length + 1):
            if text[k : k + length] in seen:
                gone[k : k + length] = b"\1" * length
            seen.add(text[k : k + length])
        out[doc_id] = "".join(c for c, g in zip(text, gone, strict=True) if not g)
    return out


@pytest.mark.parametrize("hot", [700, 2])
@pytest.mark.parametrize("length, gram", [(400, 100), (90, 30), (250, 60)])
def test_first_copies_stay_byte_for_byte(spark, hot, length, gram):
    r = np.random.default_rng(length)
    some = lambda n, k=26: bytes(r.integers(97, 97 + k, n).astype(np.uint8)).decode()
    shared = [some(n) for n in (95, 120, 260, 300, 420, 800)] + ["ab" * 300, "x" * 500]
    texts = ["".join(shared[int(i)] if int(i) < len(shared) else some(int(r.integers(1, 400))) for i in r.integers(0, len(shared) + 5, 6)) for _ in range(40)]
    texts += texts[:5] + ["", some(99)]
    data = [(i, t, "en", "s", 1) for i, t in enumerate(texts)]
    got = {x.doc_id: x.text for x in suffix_dedup.dedup(corpus.frame(spark, data), "first", length, hot, gram).collect()}
    assert got == brute_first(data, length)


def test_long_text_in_segments(spark):
    """A passage across the edge of two segments, and again in another document."""
    r = np.random.default_rng(3)
    some = lambda n: bytes(r.integers(97, 123, n).astype(np.uint8)).decode()
    passage = some(900)
    head, tail = some(suffix_dedup.SEGMENT - 300), some(2_000_000)
    data = [(1, head + passage + tail + passage[:399], "en", "s", 1), (2, some(50) + passage[100:], "en", "s", 1), (3, passage[:420], "en", "s", 1)]
    got = {x.doc_id: (x.n_bytes, x.n_removed, x.n_spans) for x in suffix_dedup.digests(corpus.frame(spark, data)).collect()}
    assert got == {1: (len(data[0][1]), 900, 1), 2: (850, 800, 1), 3: (420, 420, 1)}
    kept = {x.doc_id: x.text for x in suffix_dedup.dedup(corpus.frame(spark, data), "first").collect()}
    assert kept[1] == data[0][1] and kept[2] == data[1][1][:50] and kept[3] == ""


@pytest.mark.parametrize("hot", [700, 2])
def test_first_copy_stays(spark, hot):
    r = np.random.default_rng(5)
    passage = "".join(chr(97 + int(x)) for x in r.integers(0, 26, 700))
    data = [(1, f"aaa {passage} bbb", "en", "s", 1), (2, f"ccc {passage} ddd", "en", "s", 2), (3, f"e{passage}e{passage}e", "en", "s", 3), (4, "ü" * 10, "en", "s", 4), (5, None, None, None, None)]
    got = {r.doc_id: r.text for r in suffix_dedup.dedup(corpus.frame(spark, data), keep="first", hot=hot).collect()}
    assert got[1] == data[0][1] and got[4] == "ü" * 10 and got[5] == ""
    assert got[2] == "ccc  ddd" or passage not in got[2]
    assert passage[5:-5] not in got[3]


def test_dedup_keeps_columns_and_rows(spark, docs):
    done = suffix_dedup.dedup(docs)
    assert done.columns == docs.columns and done.count() == docs.count()
    assert suffix_dedup.dedup(corpus.empty(spark)).count() == 0 == suffix_dedup.digests(corpus.empty(spark)).count()


def first_copies(data, length):
    """Texts without words under a window of words that occurs earlier, by (doc_id, place)."""
    seen, out = set(), {}
    for doc_id, text in sorted((d[0], d[1]) for d in data):
        spans = [m.span() for m in re.finditer(r"[^\x20\x09-\x0D]+", text)]
        w, gone = [text[a:b] for a, b in spans], set()
        for k in range(len(w) - length + 1):
            if tuple(w[k : k + length]) in seen:
                gone |= set(range(k, k + length))
            seen.add(tuple(w[k : k + length]))
        drop = {x for k in gone for x in range(spans[k][0], spans[k + 1][0] if k + 1 in gone else spans[k][1])}
        out[doc_id] = "".join(c for x, c in enumerate(text) if x not in drop)
    return out


@pytest.mark.parametrize("hot", [700, 2])
def test_pipeline_cuts_passages_of_51_short_words(spark, hot, monkeypatch):
    import corpus_pipeline

    r = np.random.default_rng(8)
    word = lambda: "".join(chr(97 + int(x)) for x in r.integers(0, 26, 3))
    some = lambda n: " ".join(word() for _ in range(n))
    over, under = some(51), some(50)
    data = [(1, f"{some(60)} {over} {some(5)}"), (2, f"{some(4)} {over.replace(' ', '  ')}\n{some(70)}"), (3, f"{some(20)} {under} {some(9)}"), (4, f"{some(7)} {under} {some(30)}"), (5, f"é{some(3)} {over}"), (6, over), (7, ""), (8, "the " * 130), (9, f"{over} {some(2)} {over}")]
    docs = corpus.frame(spark, [(i, t, "en", "s", len(t)) for i, t in data])
    monkeypatch.setattr(suffix_dedup.covered, "__defaults__", tuple(hot if x == suffix_dedup.HOT else x for x in suffix_dedup.covered.__defaults__))
    monkeypatch.setattr(suffix_dedup.dedup, "__defaults__", tuple(hot if x == suffix_dedup.HOT else x for x in suffix_dedup.dedup.__defaults__))
    got = {r.doc_id: r.text for r in corpus_pipeline.cut_repeats(spark, docs, "").collect()}
    assert got == first_copies(data, 51)
    assert over in got[1] and got[6] == "" and got[3] == data[2][1] and got[4] == data[3][1] and len(got[2]) < len(data[1][1])


# difference cover


def test_shared_word_windows(docs, data, spark):
    words = lambda t: re.findall(r"[^\x20\x09-\x0D]+", t or "")
    big = 2**63 - 1
    least = {}
    for d in data:
        w = words(d[1])
        for i in range(len(w) - 12):
            least[tuple(w[i : i + 13])] = min(least.get(tuple(w[i : i + 13]), big), big if d[0] is None else d[0])
    out = []
    for d in data:
        w, me = words(d[1]), big if d[0] is None else d[0]
        gone = [False] * len(w)
        for i in range(len(w) - 12):
            if least[tuple(w[i : i + 13])] < me:
                gone[i : i + 13] = [True] * 13
        out.append((d[0], len(w), sum(gone), hashlib.sha256(" ".join(x for x, g in zip(w, gone, strict=True) if not g).encode()).hexdigest()))
    assert result(shared_windows.digests(docs)) == sorted(out, key=key)
    assert shared_windows.digests(corpus.empty(spark)).count() == 0


def test_cover_puts_both_starts_on_anchors():
    cover = set(shared_windows.COVER)
    for i in range(7):
        for j in range(7):
            assert any((i + k) % 7 in cover and (j + k) % 7 in cover for k in range(7))


# winnowing


def test_benchmark_hits(docs, data, spark):
    words = lambda t: re.findall(r"[^\x00-\x2F\x3A-\x60\x7B-\x7F]+", (t or "").translate(UP))
    texts = {d[0]: d[1] for d in data if d[1]}
    items = [(1, " ".join(texts[5].split(" ")[2:16])), (2, "ONE, two three"), (3, None), (4, "..."), (10, "one"), (11, texts[22][2000:2400]), (None, "abc abc abc abc abc abc abc abc abc abc abc"), (2, "one two three")]
    bench = spark.createDataFrame(items, "item_id long, text string")
    windows = {}
    for i, t in items:
        w = words(t)
        for k in range(len(w) - min(10, len(w)) + 1 if w else 0):
            windows.setdefault(tuple(w[k : k + min(10, len(w))]), set()).add(i)
    expected = []
    for d in data:
        w, hit, found = words(d[1]), set(), set()
        for x, ids in windows.items():
            for k in range(len(w) - len(x) + 1):
                if tuple(w[k : k + len(x)]) == x:
                    hit |= set(range(k, k + len(x)))
                    found |= ids
        expected.append((d[0], len(w), len(hit), tuple(sorted(found - {None}))))
    for bound in (decontaminate.SLICE_WORDS, 40):  # one pass, several passes
        decontaminate.SLICE_WORDS, before = bound, decontaminate.SLICE_WORDS
        try:
            rows = decontaminate.hits(docs, bench).collect()
        finally:
            decontaminate.SLICE_WORDS = before
        got = [(r.doc_id, r.n_words, sum(s["end"] - s["start"] for s in r.spans), tuple(sorted(r["items"]))) for r in rows]
        assert sorted(got, key=key) == sorted(expected, key=key)
    left = decontaminate.remove(docs, bench)
    assert left.columns == docs.columns
    assert left.count() == sum(not e[3] and not e[2] for e in expected) + sum(bool(e[2]) and not e[3] for e in expected)


def test_empty_benchmark_and_documents(docs, spark):
    none = spark.createDataFrame([], "item_id long, text string")
    assert decontaminate.hits(docs, none).filter("size(spans) > 0").count() == 0
    assert decontaminate.hits(corpus.empty(spark), none).count() == 0


def test_pipeline_drops_hits_of_items_without_id(spark, tmp_path):
    import corpus_pipeline

    passage = "one two three four five six seven eight nine ten eleven"
    spark.createDataFrame([(None, passage), (1, "nothing of this kind is in any of the documents of the test")], "item_id long, text string").write.parquet(f"{tmp_path}/benchmark.parquet")
    data = [(1, f"before {passage} after", "en", "s", 1), (2, "before after", "en", "s", 2), (None, f"{passage}", "en", "s", 3)]
    assert [r.doc_id for r in corpus_pipeline.drop_contaminated(spark, corpus.frame(spark, data), str(tmp_path)).collect()] == [2]


# simhash


def brute_prints(data):
    out = []
    for d in data:
        w = re.findall(r"[^\x20\x09-\x0D]+", (d[1] or "").translate(UP))
        grams = [" ".join(w[i : i + 4]) for i in range(len(w) - 3)] or ([" ".join(w)] if w else [])
        h = [xxhash.xxh64_intdigest(g.encode(), 42) for g in grams]
        out.append(sum(1 << b for b in range(64) if 2 * sum(x >> b & 1 for x in h) > len(h)))
    return out


def test_components(docs, data, spark):
    prints = brute_prints(data)
    root = list(range(len(data)))

    def find(x):
        while root[x] != x:
            x = root[x]
        return x

    for i in range(len(data)):
        for j in range(i):
            if (prints[i] ^ prints[j]).bit_count() <= 4:
                root[max(find(i), find(j))] = min(find(i), find(j))
    least = {}
    for i, d in enumerate(data):
        if d[0] is not None:
            least[find(i)] = min(least.get(find(i), d[0]), d[0])
    expected = sorted(((d[0], prints[i], least.get(find(i))) for i, d in enumerate(data)), key=key)
    got = sorted(((r.doc_id, r.fp % 2**64, r.component_id) for r in simhash.near_duplicates(docs).collect()), key=key)
    assert got == expected
    kept = simhash.keep_one(docs)
    assert kept.columns == docs.columns and kept.count() == len({find(i) for i in range(len(data))})
    assert simhash.near_duplicates(corpus.empty(spark)).count() == 0 == simhash.keep_one(corpus.empty(spark)).count()


def test_every_link_meets_at_an_anchor():
    r = np.random.default_rng(0)
    fp = r.integers(0, 2**63, 500, dtype=np.int64).astype(np.uint64)
    other = fp.copy()
    for i in range(500):
        for b in r.choice(64, 4, replace=False):
            other[i] ^= np.uint64(1 << int(b))
    i, k, home = simhash.anchors(fp)
    homes = {(x, y) for x, y, h in zip(i.tolist(), k.tolist(), home.tolist(), strict=True) if h}
    j, k2, _ = simhash.anchors(other)
    met = {x for x, y in zip(j.tolist(), k2.tolist(), strict=True) if (x, y) in homes}
    assert met == set(range(500))


def test_hot_anchors_are_cut(spark, monkeypatch):
    monkeypatch.setattr(simhash, "HOT_ROWS", 5)
    r = np.random.default_rng(1)
    fp = [int(np.int64(7 ^ sum(1 << int(b) for b in r.choice(20, 2, replace=False)))) for _ in range(60)]
    classes = spark.createDataFrame([(x,) for x in set(fp)], "fp long")
    from tessera.llm._components import components

    assert components(simhash.links(classes)).select("root").distinct().count() == 1


# near copies of the pipeline


@pytest.mark.parametrize("small, dense", [(256, 32), (2, 32), (256, 0), (2, 0)])
def test_pairs_of_an_anchor(monkeypatch, small, dense):
    from tessera.llm import near_copies

    monkeypatch.setattr(near_copies, "SMALL", small)
    monkeypatch.setattr(near_copies, "DENSE", dense)
    texts = [d[1] for d in near_copies_of(4, 12, 5)]
    node, n, prints = near_copies.sketch(near_copies.shingle_sets(pa.array(texts)))
    key = np.sort(np.arange(len(texts)) // 6 % 4)  # several groups in one anchor
    node, check = node.view(np.int64), np.ascontiguousarray(prints[:, : near_copies.CHECK].T)

    def pairs(part):
        return set(zip(*(x.tolist() for x in near_copies.group_pairs(key, node, n, check, part)), strict=True))

    near = set()
    for i in range(len(texts)):
        for j in range(len(texts)):
            bits = int(np.bitwise_count(prints[i, : near_copies.CHECK] ^ prints[j, : near_copies.CHECK]).sum())
            if key[i] == key[j] and node[i] != node[j] and bits <= near_copies.REACH and 5 * min(n[i], n[j]) >= 4 * max(n[i], n[j]):
                near.add((max(int(node[i]), int(node[j])), min(int(node[i]), int(node[j]))))
    loops = lambda found: {p[0] for p in found if p[0] == p[1]}
    links = lambda found: {p for p in found if p[0] != p[1]}
    # the first step holds the same groups together; what it does not propose is noted for the exact way
    first = pairs(None)
    assert near and links(first) <= near and joined(links(first)) == joined(near)
    assert all(x in loops(first) for p in near - first for x in p)
    assert first == near if dense else loops(first) == {x for p in near for x in p}
    # the second one proposes or notes all pairs of different parts, and none inside a part
    second = pairs(node)
    assert links(second) <= near and all(x in loops(second) for p in near - second for x in p)
    half = pairs(node % 2)
    across = {p for p in near if (p[0] - p[1]) % 2}
    assert links(half) <= across and all(x in loops(half) for p in across - half for x in p)


def test_prefixes_meet_for_every_similar_pair(spark):
    from tessera.llm import near_copies

    r = np.random.default_rng(6)
    sets = []
    for _ in range(40):
        base = r.integers(0, 10**6, int(r.integers(1, 60)))
        for _ in range(5):
            own = set(base.tolist()) - set(r.choice(base, min(len(base), int(r.integers(0, 2 + len(base) // 8)))).tolist())
            sets.append(own | set(r.integers(0, 10**6, int(r.integers(0, 2 + len(base) // 8))).tolist()) or {1})
    common = set(range(10**7, 10**7 + 50))  # a form that many fill in differently
    sets += [common | set(r.integers(0, 10**6, 30).tolist()) for _ in range(40)]
    roots = {i: i // 3 for i in range(len(sets))}
    rows = spark.createDataFrame([(i, np.array(sorted(x), np.int64).tobytes()) for i, x in enumerate(sets)], "node long, shingles binary")
    found = {(x.a, x.b) for x in near_copies.prefix_pairs(rows, spark.createDataFrame(list(roots.items()), "node long, root long")).collect()}
    want = {(i, j) for i in range(len(sets)) for j in range(i) if roots[i] != roots[j] and 5 * len(sets[i] & sets[j]) >= 4 * len(sets[i] | sets[j])}
    assert want and want <= found and all(roots[a] != roots[b] for a, b in found)
    assert not any(a >= 200 and b >= 200 for a, b in found) and len(found) < 2 * len(want)


def joined(pairs):
    """Components of two nodes or more."""
    root = {x: x for p in pairs for x in p}

    def find(x):
        while root[x] != x:
            x = root[x]
        return x

    for x, y in pairs:
        root[find(x)] = find(y)
    out = {}
    for x in root:
        out.setdefault(find(x), set()).add(x)
    return sorted(map(sorted, (c for c in out.values() if len(c) > 1)))


def brute_groups(data):
    sets = []
    for d in data:
        w = re.findall(r"[^\x20\x09-\x0D]+", (d[1] or "").translate(UP))
        sets.append({tuple(w[i : i + 5]) for i in range(len(w) - 4)} or ({tuple(w)} if w else set()))
    root = list(range(len(data)))

    def find(x):
        while root[x] != x:
            x = root[x]
        return x

    for i in range(len(data)):
        for j in range(i):
            if sets[i] == sets[j] or 5 * len(sets[i] & sets[j]) >= 4 * len(sets[i] | sets[j]):
                root[max(find(i), find(j))] = min(find(i), find(j))
    groups = {}
    for i, d in enumerate(data):
        groups.setdefault(find(i), []).append((d[0] is None, d[0] or 0, d[0]))
    return sorted((min(g)[2] for g in groups.values()), key=lambda x: (x is None, x))


def near_copies_of(seed, groups, copies):
    """Texts whose copies have some words replaced, at similarities around 0.8 and down to none."""
    r, out = np.random.default_rng(seed), []
    for _ in range(groups):
        w = [f"w{int(x)}" for x in r.integers(0, 10**6, int(r.integers(8, 300)))]
        out.append(w)
        for _ in range(copies):
            v = list(w)
            for k in r.choice(len(v), min(len(v), int(r.integers(0, 2 + len(v) // 25))), replace=False):
                v[k] = f"v{int(r.integers(0, 10**6))}"
            out.append(v)
    return [(i, " ".join(w), "en", "s", 1) for i, w in enumerate(out)]


@pytest.mark.parametrize("hot", [20_000, 3])
def test_pipeline_keeps_one_of_near_copies(spark, data, monkeypatch, hot):
    import corpus_pipeline

    monkeypatch.setattr(simhash, "HOT_ROWS", hot)
    texts = data + [(1000 + d[0], *d[1:]) for d in near_copies_of(2, 40, 4)]
    docs = corpus.with_clashes(corpus.frame(spark, texts))
    kept = corpus_pipeline.drop_near_copies(spark, docs, "")
    assert kept.columns == docs.columns
    assert sorted((r.doc_id for r in kept.select("doc_id").collect()), key=lambda x: (x is None, x)) == brute_groups(texts)
    assert corpus_pipeline.drop_near_copies(spark, corpus.empty(spark), "").count() == 0


def test_classes_of_one_hash_are_told_apart(spark):
    from tessera.llm import near_copies

    top = 2**63 - 1
    seen = [(1, 11, 5, 3, b"a"), (2, 12, 5, 3, b"b"), (3, 13, 5, 4, b"a"), (4, 14, 5, 3, b"b"), (5, 15, top, 9, b"x"), (6, 16, top, 9, b"y"), (7, 17, -top - 1, 9, b"x"), (8, 18, -top - 1, 9, b"y"), (None, 19, 0, 0, b""), (9, 20, 0, 0, b"")]
    got = near_copies.told_apart(spark.createDataFrame(seen, near_copies.SKETCH)).collect()
    assert len({r.node for r in got}) == len(got) == 8
    assert sorted((r.n, bytes(r.prints), r.best.doc_id) for r in got) == [(0, b"", 9), (3, b"a", 1), (3, b"b", 2), (4, b"a", 3), (9, b"x", 5), (9, b"x", 7), (9, b"y", 6), (9, b"y", 8)]


def test_columns_named_like_keys_pass_through(spark, data):
    from tessera.llm import near_copies

    named = corpus.frame(spark, data).withColumns({c: F.lit(7) for c in ("__simhash_key", "__SIMHASH_N", "__hit_doc", "__hit_text", "___hit_text")})
    bench = spark.createDataFrame([(1, data[3][1])], "item_id long, text string")
    for left in (simhash.keep_one(named), near_copies.keep_one(named), decontaminate.remove(named, bench)):
        assert left.columns == named.columns
        rows = left.collect()
        assert rows and all(tuple(r[5:]) == (7,) * 5 for r in rows)


# tokens


ODD = ["a  b", " x\n \n  y  ", "tab\t<|endoftext|> y's", "don't we'll 12.5 a.b,c;d…“q”. ", "ß ÿ×÷ Ünï.\n\nA\nb\r\n c", "日本語。テスト é. 漢", " ", "x" * 3000 + " y", "İstanbul ǅ. Ⅻ", "a\n", "\n\n", "end.\n\n", "a <|endoftext|> b", "x<|endoftext|>", "<|startoftext|><|endoftext|>y", "w<|startoftext|>w <|ENDOFTEXT|> <|", "\n<|endoftext|>\n\n<|endof text|>", " <|endoftext|>  <|startoftext|> . "]


def encoded(name, data, end=2):
    t = Tokenizer.from_file(str(public_tokenizers.path(name)))
    return [np.array([*t.encode(x or "", add_special_tokens=False).ids, end], "<u4") for x in data]


@pytest.mark.parametrize("name", ["byte_bpe_50k.json", "word_bpe_49k.json"])
def test_encoder_equals_the_library(name, data):
    import pyarrow as pa

    from tessera.llm._tokens import Encoder

    texts = [d[1] for d in data] + ODD
    for _ in range(2):
        e = Encoder(str(public_tokenizers.path(name)))
        ids, bounds = e.batch(pa.array(texts))
        for i, x in enumerate(encoded(name, texts)):
            assert ids[bounds[i] : bounds[i + 1]].tolist() == x[:-1].tolist(), texts[i]


def test_shards_grow_with_bytes(docs, spark, monkeypatch):
    partitions = int(spark.conf.get("spark.sql.shuffle.partitions"))
    assert token_table.shards_for(docs) == token_table.shards_for(corpus.empty(spark)) == partitions
    total = sum(len((r.text or "").encode()) for r in docs.select("text").collect())
    monkeypatch.setattr(token_table, "SHARD_BYTES", total // (3 * partitions))
    assert 3 * partitions <= token_table.shards_for(docs) <= 3 * partitions + 1


def test_token_table_round_trip(docs, data, spark, tmp_path):
    path = f"file://{tmp_path}/sst"
    shards = token_table.write_shards(docs, path, str(public_tokenizers.path("byte_bpe_50k.json")), 2, shards=3)
    hashed = lambda t: 42 if t is None else int(np.uint64(xxhash.xxh64_intdigest(t.encode(), 42)).astype(np.int64))
    order = sorted(data, key=lambda d: ((d[0] is not None, d[0] or 0), hashed(d[1])))
    start, expected = 0, []
    for d, ids in zip(order, encoded("byte_bpe_50k.json", [d[1] for d in order]), strict=True):
        expected.append((d[0], start, len(ids), zlib.crc32(ids.tobytes())))
        start += len(ids)
    assert result(token_table.read_shards(spark, shards)) == sorted(expected, key=key)
    assert [x.tolist() for x in token_table.lookup(shards, 8)] == [encoded("byte_bpe_50k.json", [data[8][1]])[0].tolist()]
    assert len(token_table.lookup(shards, None)) == 2 and token_table.lookup(shards, 12345) == []
    readers = [token_table.ShardReader(s["path"]) for s in shards]
    assert sum(r.entries for r in readers) == len(data)
    assert all(r.may_have(k) for r in readers for k, _ in r)  # a filter forgets no key
    assert sum(r.may_have(token_table.key_of(10**9 + i)) for r in readers for i in range(1000)) < 100 * len(readers)
    none = token_table.write_shards(corpus.empty(spark), f"file://{tmp_path}/none", str(public_tokenizers.path("byte_bpe_50k.json")), 2, shards=2)
    assert token_table.read_shards(spark, none).count() == 0


def test_packing_holds_every_id_once(docs, data, spark):
    path = str(public_tokenizers.path("word_bpe_49k.json"))
    rows = packing.pack(docs, path, 2, shards=2).collect()
    ids = {}
    for d, x in zip(data, encoded("word_bpe_49k.json", [d[1] for d in data]), strict=True):
        ids.setdefault(d[0], []).append(x)
    assert sum(r.length for r in rows) == sum(len(x) for v in ids.values() for x in v)
    for r in rows:
        assert any(zlib.crc32(x[r.start : r.start + r.length].tobytes()) == r.ids_crc32 and len(x) == r.doc_tokens for x in ids[r.doc_id])
    by = {}
    for r in rows:
        by.setdefault(r.sequence_id, []).append((r.offset, r.length))
    for v in by.values():
        at = 0
        for offset, n in sorted(v):
            assert offset == at
            at += n
        assert at <= 4096
    assert packing.pack(corpus.empty(spark), path, 2).count() == 0


def test_cuts_are_the_cheapest():
    r = np.random.default_rng(3)
    for _ in range(30):
        place = np.unique(r.integers(1, 60, 12))
        place = np.unique(np.concatenate([place, np.arange(10, place[-1], 10)]))
        penalty, length = r.integers(0, 6, len(place)).astype(float), 16
        at = [0, *place.tolist()]
        best = [0.0] + [float("inf")] * len(place)
        for i in range(1, len(at)):
            for j in range(i):
                n = at[i] - at[j]
                if n <= length:
                    best[i] = min(best[i], best[j] + (0 if n & (n - 1) == 0 else length - n) + penalty[i - 1])
        cuts = [0, *packing.best_cuts(place, penalty, length)]
        cost = sum((0 if (b - a) & (b - a - 1) == 0 else length - (b - a)) + penalty[at.index(b) - 1] for a, b in zip(cuts, cuts[1:], strict=False))
        assert cost == pytest.approx(best[-1])
