"""The numbered queries over the driver's tables, and their SQL where SQL can say them."""

from __future__ import annotations

import zlib

import numpy as np
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from . import ann, decontaminate, filter_audit, language, line_dedup, packing, periodic_runs, shared_windows, simhash, suffix_dedup, token_table, toxicity, url_rules
from ._shared import fresh_folder

URL_RULES = [("block", "com/en/"), ("allow", "example.com/en/7"), ("block", "net/de/"), ("block", "example.net/de/8"), ("block", "org/es/")]
END_ID = 2


def _table(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    return spark.read.parquet(f"{sf_dir}/{name}.parquet")


def tokenizer_path(name: str) -> str:
    import public_tokenizers

    return str(public_tokenizers.path(name))


def op1_toxicity(spark: SparkSession, sf_dir: str) -> DataFrame:
    return toxicity.classify(_table(spark, sf_dir, "documents"), _table(spark, sf_dir, "labels"))


def op2_suffix_array(spark: SparkSession, sf_dir: str) -> DataFrame:
    return suffix_dedup.digests(_table(spark, sf_dir, "documents"), keep="none")


def op3_url_rules(spark: SparkSession, sf_dir: str) -> DataFrame:
    pages = _table(spark, sf_dir, "pages").select("page_id", "url")
    return url_rules.apply_rules(pages, url_rules.rules_frame(spark, URL_RULES)).select("page_id", "host", "path", "rule", "verdict")


def op5_token_table(spark: SparkSession, sf_dir: str) -> DataFrame:
    shards = token_table.write_shards(_table(spark, sf_dir, "documents"), fresh_folder(spark, "token-table"), tokenizer_path("byte_bpe_50k.json"), END_ID)
    return token_table.read_shards(spark, shards)


def op6_difference_cover(spark: SparkSession, sf_dir: str) -> DataFrame:
    return shared_windows.digests(_table(spark, sf_dir, "documents"))


def op7_winnowing(spark: SparkSession, sf_dir: str) -> DataFrame:
    found = decontaminate.hits(_table(spark, sf_dir, "documents"), _table(spark, sf_dir, "benchmark"))
    n_hit = F.aggregate("spans", F.lit(0).cast("long"), lambda a, s: a + s["end"] - s["start"])
    listed = F.array_join(F.array_sort(F.transform("items", lambda i: i.cast("string"))), ",")
    return found.select("doc_id", "n_words", n_hit.alias("n_hit"), F.size("items").cast("long").alias("n_items"), F.sha2(listed, 256).alias("items_sha256"), (F.size("spans") > 0).alias("contaminated"))


def op8_packing(spark: SparkSession, sf_dir: str) -> DataFrame:
    return packing.pack(_table(spark, sf_dir, "documents"), tokenizer_path("word_bpe_49k.json"), END_ID)


def op4_rotated_codes(spark: SparkSession, sf_dir: str) -> DataFrame:
    vectors = _table(spark, sf_dir, "embeddings")
    return ann.search(vectors, vectors.filter(F.col("vec_id") % 50 == 0), 5)


def op9_simhash(spark: SparkSession, sf_dir: str) -> DataFrame:
    found = simhash.near_duplicates(_table(spark, sf_dir, "documents"))
    return found.select("doc_id", F.lower(F.lpad(F.hex("fp"), 16, "0")).alias("fingerprint"), "component_id")


def op10_language(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = _table(spark, sf_dir, "documents")
    return language.predict(docs, language.learn(docs))


def op11_line_hash(spark: SparkSession, sf_dir: str) -> DataFrame:
    return line_dedup.digests(_table(spark, sf_dir, "documents"), min_docs=10, min_chars=1)


def op12_filter_audit(spark: SparkSession, sf_dir: str) -> DataFrame:
    return filter_audit.report(_table(spark, sf_dir, "documents"), _table(spark, sf_dir, "labels"))


def periodic_tail(doc_id: int | None, n: int) -> np.ndarray | None:
    """For one identifier in ten the places that make the end of a document of n words periodic, as the query's contract asks."""
    h = zlib.crc32(str(doc_id).encode()) if doc_id is not None else 1
    if h % 10 or not n:
        return None
    g = h // 10
    a = g % n
    places = np.arange(n)
    places[a:] = a + (places[a:] - a) % (1 + (n - a) // (3 + g % 8))
    return places


def op13_periodic_runs(spark: SparkSession, sf_dir: str) -> DataFrame:
    return periodic_runs.digests(_table(spark, sf_dir, "documents"), remap=periodic_tail)


OP3_SQL = """
WITH u AS (
  SELECT page_id,
         translate(regexp_extract(coalesce(url, ''), '^(?s:.*?)://([^/?#]*)([^?#]*)', 1), 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz') AS host,
         regexp_extract(coalesce(url, ''), '^(?s:.*?)://([^/?#]*)([^?#]*)', 2) AS path
  FROM pages)
SELECT page_id, host, path,
       CASE WHEN (host = 'example.com' OR ends_with(host, '.example.com')) AND starts_with(path, '/en/7') THEN 'example.com/en/7'
            WHEN (host = 'example.net' OR ends_with(host, '.example.net')) AND starts_with(path, '/de/8') THEN 'example.net/de/8'
            WHEN (host = 'com' OR ends_with(host, '.com')) AND starts_with(path, '/en/') THEN 'com/en/'
            WHEN (host = 'net' OR ends_with(host, '.net')) AND starts_with(path, '/de/') THEN 'net/de/'
            WHEN (host = 'org' OR ends_with(host, '.org')) AND starts_with(path, '/es/') THEN 'org/es/' END AS rule,
       CASE WHEN (host = 'example.com' OR ends_with(host, '.example.com')) AND starts_with(path, '/en/7') THEN 'allow'
            WHEN (host = 'example.net' OR ends_with(host, '.example.net')) AND starts_with(path, '/de/8') THEN 'block'
            WHEN (host = 'com' OR ends_with(host, '.com')) AND starts_with(path, '/en/') THEN 'block'
            WHEN (host = 'net' OR ends_with(host, '.net')) AND starts_with(path, '/de/') THEN 'block'
            WHEN (host = 'org' OR ends_with(host, '.org')) AND starts_with(path, '/es/') THEN 'block'
            ELSE 'allow' END AS verdict
FROM u
"""


# windows of 400 bytes as 800 hex digits, cut from pieces of 1000 places
OP2_SQL = """
WITH d AS (SELECT doc_id, hex(encode(coalesce(text, ''))) AS h, octet_length(encode(coalesce(text, ''))) AS n FROM documents),
pieces AS (SELECT doc_id, n, k * 1000 AS base, substr(h, k * 2000 + 1, 2798) AS p FROM d, LATERAL (SELECT unnest(range(0, n // 1000 + 1)) AS k)),
w AS (SELECT doc_id, base + i AS place, md5(substr(p, i * 2 + 1, 800)) AS m FROM pieces, LATERAL (SELECT unnest(range(0, least(1000, n - base - 399))) AS i)),
hits AS (SELECT doc_id, place FROM w QUALIFY count(*) OVER (PARTITION BY m) > 1),
gaps AS (SELECT doc_id, place, CASE WHEN place <= lag(place) OVER (PARTITION BY doc_id ORDER BY place) + 400 THEN 0 ELSE 1 END AS fresh FROM hits),
runs AS (SELECT doc_id, min(place) AS a, max(place) + 400 AS b FROM (SELECT *, sum(fresh) OVER (PARTITION BY doc_id ORDER BY place) AS k FROM gaps) GROUP BY doc_id, k),
kept AS (SELECT doc_id, a, coalesce(lag(b) OVER (PARTITION BY doc_id ORDER BY a), 0) AS last FROM (SELECT * FROM runs UNION ALL SELECT doc_id, n, n FROM d)),
texts AS (SELECT doc_id, string_agg(substr(h, last * 2 + 1, (a - last) * 2), '' ORDER BY a) AS t FROM kept JOIN d USING (doc_id) GROUP BY doc_id),
sums AS (SELECT doc_id, sum(b - a)::BIGINT AS n_removed, count(*) AS n_spans FROM runs GROUP BY doc_id)
SELECT doc_id, n AS n_bytes, coalesce(n_removed, 0) AS n_removed, coalesce(n_spans, 0) AS n_spans, sha256(unhex(t)) AS kept_sha256
FROM d JOIN texts USING (doc_id) LEFT JOIN sums USING (doc_id)
"""
OP6_SQL = r"""
WITH d AS (SELECT doc_id, coalesce(regexp_extract_all(text, '[^\x20\x09-\x0D]+'), []) AS w FROM documents),
words AS (SELECT doc_id, unnest(w) AS word, unnest(range(1, len(w) + 1)) AS j FROM d),
windows AS (SELECT doc_id, j, array_to_string(w[j:j + 12], ' ') AS s FROM d, LATERAL (SELECT unnest(range(1, len(w) - 11)) AS j)),
hits AS (SELECT doc_id, j FROM windows QUALIFY min(doc_id) OVER (PARTITION BY s) < doc_id),
flags AS (SELECT doc_id, word, j, max(CASE WHEN hits.j IS NULL THEN 0 ELSE 1 END) OVER (PARTITION BY doc_id ORDER BY words.j ROWS BETWEEN 12 PRECEDING AND CURRENT ROW) AS gone FROM words LEFT JOIN hits USING (doc_id, j)),
sums AS (SELECT doc_id, count(*) FILTER (WHERE gone = 1) AS n_removed, string_agg(word, ' ' ORDER BY j) FILTER (WHERE gone = 0) AS kept FROM flags GROUP BY doc_id)
SELECT doc_id, len(w)::BIGINT AS n_words, coalesce(n_removed, 0) AS n_removed, sha256(coalesce(kept, '')) AS kept_sha256 FROM d LEFT JOIN sums USING (doc_id)
"""
_LOWER = "translate(text, 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz')"
OP7_SQL = rf"""
WITH d AS (SELECT doc_id, coalesce(regexp_extract_all({_LOWER}, '[^\x00-\x2F\x3A-\x60\x7B-\x7F]+'), []) AS w FROM documents),
b AS (SELECT item_id, coalesce(regexp_extract_all({_LOWER}, '[^\x00-\x2F\x3A-\x60\x7B-\x7F]+'), []) AS w FROM benchmark),
items AS (SELECT DISTINCT item_id, least(len(w), 10) AS n, array_to_string(w[j:j + least(len(w), 10) - 1], ' ') AS s FROM b, LATERAL (SELECT unnest(range(1, len(w) - least(len(w), 10) + 2)) AS j) WHERE len(w) > 0),
windows AS (SELECT doc_id, n, j, array_to_string(w[j:j + n - 1], ' ') AS s FROM d, (SELECT DISTINCT n FROM items), LATERAL (SELECT unnest(range(1, len(w) - n + 2)) AS j)),
hits AS (SELECT doc_id, n, j, item_id FROM windows JOIN items USING (n, s)),
places AS (SELECT doc_id, count(DISTINCT k) AS n_hit FROM (SELECT doc_id, unnest(range(j, j + n)) AS k FROM hits) GROUP BY doc_id),
named AS (SELECT doc_id, count(DISTINCT item_id) AS n_items, array_to_string(list_sort(list_distinct(list(item_id::VARCHAR) FILTER (WHERE item_id IS NOT NULL))), ',') AS ids FROM hits GROUP BY doc_id)
SELECT doc_id, len(w)::BIGINT AS n_words, coalesce(n_hit, 0) AS n_hit, coalesce(n_items, 0) AS n_items, sha256(coalesce(ids, '')) AS items_sha256, coalesce(n_hit, 0) > 0 AS contaminated FROM d LEFT JOIN places USING (doc_id) LEFT JOIN named USING (doc_id)
"""

OP11_SQL = r"""
WITH lines AS (SELECT doc_id, unnest(string_split(coalesce(text, ''), chr(10))) AS line, generate_subscripts(string_split(coalesce(text, ''), chr(10)), 1) AS i FROM documents),
keyed AS (SELECT doc_id, line, i, translate(regexp_replace(line, '^[\x20\x09-\x0D]+|[\x20\x09-\x0D]+$', '', 'g'), 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz') AS k FROM lines),
common AS (SELECT k FROM keyed WHERE length(k) >= 1 GROUP BY k HAVING count(DISTINCT doc_id) >= 10)
SELECT doc_id, count(*) AS n_lines, count(common.k) AS n_dropped, sha256(coalesce(string_agg(line, chr(10) ORDER BY i) FILTER (WHERE common.k IS NULL), '')) AS kept_sha256
FROM keyed LEFT JOIN common USING (k) GROUP BY doc_id
"""
OP12_SQL = r"""
WITH RECURSIVE d AS (SELECT doc_id, coalesce(text, '') AS t, coalesce(lang, '') AS part FROM documents),
w AS (SELECT *, regexp_extract_all(t, '[^\x20\x09-\x0D]+') AS w, doc_id > min(doc_id) OVER (PARTITION BY t) AS copy FROM d),
l AS (SELECT doc_id, bool_or(quality = 1) AS good, bool_or(toxic = 1) AS toxic FROM labels GROUP BY doc_id),
m AS (SELECT part, coalesce(good, false) AS good, coalesce(toxic, false) AS toxic,
  CASE WHEN len(w) < 100 THEN 'A' ELSE '' END || CASE WHEN 100 * len(list_distinct(w)) < 80 * len(w) THEN 'B' ELSE '' END
  || CASE WHEN 100 * (length(t) - length(regexp_replace(t, '[A-Z]', '', 'g'))) > 10 * length(t) THEN 'C' ELSE '' END || CASE WHEN regexp_matches(t, '[#$%&*|]') THEN 'D' ELSE '' END || CASE WHEN copy THEN 'E' ELSE '' END AS fails
  FROM w LEFT JOIN l USING (doc_id)),
p(o) AS (SELECT '' UNION ALL SELECT o || x FROM p, (SELECT unnest(['A', 'B', 'C', 'D', 'E']) AS x) WHERE NOT contains(o, x)),
s AS (SELECT o AS filter_order, k::INTEGER AS step, o[k] AS filter, o[1:k - 1] AS earlier FROM p, (SELECT unnest(range(1, 6)) AS k) WHERE length(o) = 5),
c AS (SELECT part, fails, count(*) AS n, count(*) FILTER (WHERE good) AS good, count(*) FILTER (WHERE toxic) AS toxic FROM m GROUP BY part, fails),
j AS (SELECT *, contains(fails, filter) AS hit, earlier <> '' AND regexp_matches(fails, '[' || earlier || '0]') AS gone FROM c, s),
r AS (SELECT part, filter_order, step, filter, sum(CASE WHEN hit OR gone THEN 0 ELSE n END)::BIGINT AS kept, sum(CASE WHEN hit AND NOT gone THEN n ELSE 0 END)::BIGINT AS removed, sum(CASE WHEN hit AND gone THEN n ELSE 0 END)::BIGINT AS redundant,
  sum(CASE WHEN fails = filter THEN n ELSE 0 END)::BIGINT AS unique_fails, sum(CASE WHEN hit AND NOT gone THEN good ELSE 0 END)::BIGINT AS good_lost, sum(CASE WHEN hit AND NOT gone THEN toxic ELSE 0 END)::BIGINT AS toxic_lost
  FROM j GROUP BY part, filter_order, step, filter)
SELECT *, (sum(removed) OVER (PARTITION BY part, filter))::BIGINT AS shapley FROM r
"""
# crc32 bit by bit; pairs of equal four words a period apart, and islands of such pairs, are runs
OP13_SQL = r"""
WITH d AS (SELECT doc_id, coalesce(regexp_extract_all(text, '[^\x20\x09-\x0D]+'), []) AS w FROM documents),
h AS (SELECT *, len(w) AS n, CASE WHEN doc_id IS NULL THEN 1 ELSE xor(list_reduce(list_prepend(4294967295::BIGINT, list_transform(string_split(doc_id::VARCHAR, ''), lambda c: ascii(c)::BIGINT)),
  lambda x, b: list_reduce(list_prepend(xor(x, b), [0::BIGINT, 0, 0, 0, 0, 0, 0, 0]), lambda y, z: CASE WHEN y & 1 = 1 THEN xor(y >> 1, 3988292384::BIGINT) ELSE y >> 1 END)), 4294967295::BIGINT) END AS h FROM d),
g AS (SELECT *, h // 10 AS g, CASE WHEN h % 10 = 0 AND n > 0 THEN (h // 10) % n END AS a FROM h),
p AS (SELECT *, 1 + (n - a) // (3 + g % 8) AS p FROM g),
words AS MATERIALIZED (SELECT doc_id, n, i, CASE WHEN i >= a THEN w[a + (i - a) % p + 1] ELSE w[i + 1] END AS word FROM p, LATERAL (SELECT unnest(range(n)) AS i)),
grams AS (SELECT doc_id, n, i, concat_ws(' ', word, lead(word) OVER o, lead(word, 2) OVER o, lead(word, 3) OVER o) AS s FROM words WINDOW o AS (PARTITION BY doc_id ORDER BY i) QUALIFY lead(word, 3) OVER o IS NOT NULL),
pairs AS (SELECT x.doc_id, x.i, y.i - x.i AS q FROM grams x JOIN grams y ON x.doc_id = y.doc_id AND x.s = y.s AND y.i > x.i AND 3 * (y.i - x.i) <= x.n),
islands AS (SELECT doc_id, q, i, i - row_number() OVER (PARTITION BY doc_id, q ORDER BY i) AS k FROM pairs),
stretches AS (SELECT doc_id, min(i) AS s, max(i) + 4 + q - min(i) AS l, q FROM islands GROUP BY doc_id, q, k HAVING max(i) + 4 + q - min(i) >= greatest(24, 3 * q)),
runs AS MATERIALIZED (SELECT doc_id, s, l, min(q) AS q FROM stretches GROUP BY doc_id, s, l),
best AS (SELECT * FROM runs QUALIFY row_number() OVER (PARTITION BY doc_id ORDER BY l::DOUBLE / q DESC, s, q) = 1),
listed AS (SELECT doc_id, count(*) AS n_runs, string_agg(s || ',' || l || ',' || q || chr(10), '' ORDER BY s, q) AS t FROM runs GROUP BY doc_id),
gone AS (SELECT DISTINCT doc_id, unnest(range(s + q, s + l)) AS i FROM runs),
kept AS (SELECT doc_id, string_agg(word, ' ' ORDER BY i) AS t FROM words ANTI JOIN gone USING (doc_id, i) GROUP BY doc_id)
SELECT d.doc_id, coalesce(n_runs, 0) AS n_runs, best.s AS start, best.l AS length, best.q AS period, 1000 * best.l // best.q AS exponent_milli, sha256(coalesce(listed.t, '')) AS runs_sha256, sha256(coalesce(kept.t, '')) AS collapsed_sha256
FROM d LEFT JOIN best USING (doc_id) LEFT JOIN listed USING (doc_id) LEFT JOIN kept USING (doc_id)
"""


def queries() -> dict:
    return {f.__name__: f for f in (op1_toxicity, op2_suffix_array, op3_url_rules, op4_rotated_codes, op5_token_table, op6_difference_cover, op7_winnowing, op8_packing, op9_simhash, op10_language, op11_line_hash, op12_filter_audit, op13_periodic_runs)}


def oracle_sql() -> dict[str, str]:
    return {"op2_suffix_array": OP2_SQL, "op3_url_rules": OP3_SQL, "op6_difference_cover": OP6_SQL, "op7_winnowing": OP7_SQL, "op11_line_hash": OP11_SQL, "op12_filter_audit": OP12_SQL, "op13_periodic_runs": OP13_SQL}
