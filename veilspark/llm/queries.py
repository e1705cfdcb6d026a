"""The operators applied to their whole tables, and their SQL where SQL can say the same."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession

from veilspark.llm import bpe, fingerprints, licenses, neardup, packing, passages, periodic, quality, secrets, suffixes, toxicity, trie, urls
from veilspark.llm.common import read

SQL: dict[str, str] = {}


def op1_license_scan(spark: SparkSession, sf_dir: str) -> DataFrame:
    return licenses.license_scan(read(spark, sf_dir, "documents"))


def op2_fingerprints(spark: SparkSession, sf_dir: str) -> DataFrame:
    return fingerprints.edited_fingerprints(read(spark, sf_dir, "documents"))


def op3_packing(spark: SparkSession, sf_dir: str) -> DataFrame:
    return packing.pack_documents(read(spark, sf_dir, "documents"))


def op4_substring_dedup(spark: SparkSession, sf_dir: str) -> DataFrame:
    return passages.passage_digests(read(spark, sf_dir, "documents"))


SQL["op4_substring_dedup"] = r"""
WITH d AS (SELECT doc_id, regexp_extract_all(coalesce(text, ''), '[^\x20\x09-\x0D]+') AS w FROM documents),
win AS (SELECT doc_id, i, md5(array_to_string(w[i:i + 34], ' ')) AS g FROM (SELECT doc_id, w, unnest(range(1, len(w) - 33)) AS i FROM d)),
rep AS (SELECT doc_id, i FROM (SELECT doc_id, i, count(*) OVER (PARTITION BY g) AS c FROM win) WHERE c > 1),
word AS (SELECT doc_id, p, w[p] AS word FROM (SELECT doc_id, w, unnest(range(1, len(w) + 1)) AS p FROM d)),
gone AS (SELECT word.doc_id, p, max(r.i) OVER (PARTITION BY word.doc_id ORDER BY p ROWS BETWEEN 34 PRECEDING AND CURRENT ROW) IS NOT NULL AS gone, word FROM word LEFT JOIN rep r ON r.doc_id = word.doc_id AND r.i = word.p)
SELECT d.doc_id, len(w) AS n_words, coalesce(n, 0) AS n_removed, sha256(coalesce(kept, '')) AS kept_sha256
FROM d LEFT JOIN (SELECT doc_id, count(*) FILTER (WHERE gone) AS n, string_agg(word, ' ' ORDER BY p) FILTER (WHERE NOT gone) AS kept FROM gone GROUP BY doc_id) g ON d.doc_id = g.doc_id"""


def op5_toxicity(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = read(spark, sf_dir, "documents")
    return toxicity.score_toxicity(docs, toxicity.learn(docs, read(spark, sf_dir, "labels")))


def op6_suffix_dedup(spark: SparkSession, sf_dir: str) -> DataFrame:
    return suffixes.suffix_digests(read(spark, sf_dir, "documents"))


SQL["op6_suffix_dedup"] = r"""
WITH d AS (SELECT doc_id, coalesce(text, '') AS t, hex(encode(coalesce(text, ''))) AS x, octet_length(encode(coalesce(text, ''))) AS n FROM documents),
piece AS (SELECT doc_id, n, b, substr(x, 2 * b + 1, 2198) AS s FROM (SELECT doc_id, x, n, unnest(range(0, n, 1000)) AS b FROM d)),
win AS (SELECT doc_id, b + j AS i, hash(substr(s, 2 * j - 1, 200)) AS g FROM (SELECT doc_id, b, s, unnest(range(1, least(1001, n - 98 - b))) AS j FROM piece)),
rep AS MATERIALIZED (SELECT doc_id, i FROM (SELECT doc_id, i, row_number() OVER (PARTITION BY g ORDER BY doc_id, i) AS c FROM win) WHERE c > 1),
byte AS (SELECT doc_id, b + j AS p, substr(s, 2 * j - 1, 2) AS b FROM (SELECT doc_id, b, s, unnest(range(1, least(1001, n - b + 1))) AS j FROM piece WHERE doc_id IN (SELECT doc_id FROM rep))),
gone AS (SELECT byte.doc_id, p, b, max(r.i) OVER (PARTITION BY byte.doc_id ORDER BY p ROWS BETWEEN 99 PRECEDING AND CURRENT ROW) IS NOT NULL AS gone FROM byte LEFT JOIN rep r ON r.doc_id = byte.doc_id AND r.i = byte.p),
edge AS (SELECT *, gone AND NOT coalesce(lag(gone) OVER (PARTITION BY doc_id ORDER BY p), false) AS first FROM gone),
cut AS (SELECT doc_id, count(*) FILTER (WHERE gone) AS m, count(*) FILTER (WHERE first) AS spans, coalesce(string_agg(b, '' ORDER BY p) FILTER (WHERE NOT gone), '') AS kept FROM edge GROUP BY doc_id)
SELECT d.doc_id, n AS n_bytes, coalesce(m, 0) AS n_removed, coalesce(spans, 0) AS n_spans, CASE WHEN kept IS NULL THEN sha256(t) ELSE sha256(unhex(kept)) END AS kept_sha256
FROM d LEFT JOIN cut ON cut.doc_id = d.doc_id"""


def op7_bpe(spark: SparkSession, sf_dir: str) -> DataFrame:
    return bpe.bpe_digests(read(spark, sf_dir, "documents"))


def op8_near_dedup(spark: SparkSession, sf_dir: str) -> DataFrame:
    return neardup.near_duplicates(read(spark, sf_dir, "documents")).drop("th")


SQL["op8_near_dedup"] = r"""
WITH RECURSIVE d AS (SELECT doc_id, regexp_extract_all(translate(coalesce(text, ''), 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz'), '[^\x20\x09-\x0D]+') AS w FROM documents),
s AS (SELECT doc_id, unnest(CASE WHEN len(w) = 0 THEN [] WHEN len(w) = 1 THEN w ELSE list_distinct(list_transform(range(1, len(w)), lambda i: w[i] || ' ' || w[i + 1])) END) AS g FROM d),
n AS (SELECT doc_id, count(*) AS n FROM s GROUP BY doc_id),
inter AS (SELECT a.doc_id AS x, b.doc_id AS y, count(*) AS c FROM s a JOIN s b USING (g) WHERE a.doc_id <> b.doc_id GROUP BY x, y),
link AS (SELECT x, y FROM inter JOIN n p ON p.doc_id = x JOIN n q ON q.doc_id = y WHERE 100 * c >= 80 * (p.n + q.n - c)),
reach(x, y) AS (SELECT doc_id, doc_id FROM d UNION SELECT reach.x, link.y FROM reach JOIN link ON link.x = reach.y)
SELECT d.doc_id, coalesce(n.n, 0) AS n_shingles, c.component_id, d.doc_id = c.component_id AS kept
FROM d LEFT JOIN n USING (doc_id) JOIN (SELECT x AS doc_id, min(y) AS component_id FROM reach GROUP BY x) c USING (doc_id)"""


def op9_quality_rules(spark: SparkSession, sf_dir: str) -> DataFrame:
    return quality.quality_rules(read(spark, sf_dir, "documents")).drop("th")


SQL["op9_quality_rules"] = r"""
WITH d AS (SELECT doc_id, coalesce(source, '') AS host, coalesce(text, '') AS t, regexp_extract_all(coalesce(text, ''), '[^\x20\x09-\x0D]+') AS w,
           list_filter(string_split(coalesce(text, ''), chr(10)), lambda x: regexp_matches(x, '[^\x20\x09-\x0D]')) AS l FROM documents),
win AS (SELECT doc_id, i, w[i] || ' ' || w[i + 1] || ' ' || w[i + 2] AS g FROM (SELECT doc_id, w, unnest(range(1, len(w) - 1)) AS i FROM d)),
rep AS (SELECT doc_id, unnest([i, i + 1, i + 2]) AS p FROM (SELECT doc_id, i, count(*) OVER (PARTITION BY doc_id, g) AS c FROM win) WHERE c > 1),
r AS (SELECT doc_id, count(DISTINCT p) AS n FROM rep GROUP BY doc_id),
dl AS (SELECT doc_id, host, unnest(list_distinct(list_transform(l, lambda x: regexp_replace(lower(trim(regexp_replace(x, '[\x20\x09-\x0D]+', ' ', 'g'))), '[0-9]+', '0', 'g')))) AS line FROM d),
ident AS (SELECT doc_id, string_agg(line, chr(10) ORDER BY line) AS ident, sum(length(line)) AS total FROM dl GROUP BY doc_id),
above AS (SELECT host, line FROM (SELECT host, line, count(DISTINCT ident) AS n FROM dl JOIN ident USING (doc_id) GROUP BY host, line) JOIN (SELECT host, count(DISTINCT ident) AS docs FROM (SELECT DISTINCT doc_id, host FROM dl) JOIN ident USING (doc_id) GROUP BY host) USING (host) WHERE n > 20 AND n > 0.02 * docs),
cut AS (SELECT doc_id, sum(length(line)) AS removed FROM dl JOIN above USING (host, line) GROUP BY doc_id),
base AS (SELECT doc_id, len(w) AS n_words, coalesce(list_sum(list_transform(w, lambda x: length(x))), 0)::BIGINT AS word_chars,
         len(regexp_extract_all(t, '[#*$%&|<>]')) AS n_symbols, len(l) - len(list_distinct(l)) AS n_dup_lines FROM d)
SELECT doc_id, n_words, word_chars, n_symbols, n_dup_lines, coalesce(n, 0) AS n_repeat_words,
       n_words < 50 OR 100 * coalesce(n, 0) > 50 * n_words AS base_failed, coalesce(removed, 0)::BIGINT AS removed_chars,
       NOT (n_words < 50 OR 100 * coalesce(n, 0) > 50 * n_words) AND NOT coalesce(total - removed < 0.3 * total, false) AS kept
FROM base LEFT JOIN r USING (doc_id) LEFT JOIN ident USING (doc_id) LEFT JOIN cut USING (doc_id)"""


def op10_url_filters(spark: SparkSession, sf_dir: str) -> DataFrame:
    return urls.url_filter(read(spark, sf_dir, "pages"), urls.rule_table(spark))


SQL["op10_url_filters"] = r"""
WITH u AS (SELECT page_id, CASE WHEN contains(coalesce(url, ''), '://') THEN substr(url, strpos(url, '://') + 3) ELSE '' END AS rest FROM pages),
s AS (SELECT page_id, translate(regexp_extract(rest, '^([^/?#]*)', 1), 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz') AS host, regexp_extract(rest, '^[^/?#]*([^?#]*)', 1) AS path FROM u),
rules(verdict, rh, rp) AS (VALUES ('allow', 'com', '/'), ('block', 'example.com', '/en/'), ('allow', 'www.example.com', '/en/'), ('block', 'net', '/es/'), ('block', 'net', '/fr/')),
fit AS (SELECT page_id, rh || rp AS rule, verdict, row_number() OVER (PARTITION BY page_id ORDER BY length(rh) DESC, length(rp) DESC) AS k FROM s JOIN rules ON (host = rh OR ends_with(host, '.' || rh)) AND starts_with(path, rp))
SELECT page_id, host, path, rule, coalesce(verdict, CASE WHEN host = '' THEN 'block' ELSE 'allow' END) AS verdict FROM s LEFT JOIN (SELECT * FROM fit WHERE k = 1) USING (page_id)"""

def op11_secret_scan(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = read(spark, sf_dir, "documents")
    return secrets.secret_scan(docs, secrets.learn(docs))


def _crc32(text: str) -> str:
    """CRC-32 of a short ASCII text, bit by bit."""
    byte = "list_reduce(range(0, 9), lambda c, k: CASE WHEN k = 0 THEN c WHEN c % 2 = 1 THEN xor(c // 2, 3988292384) ELSE c // 2 END, xor(crc, x)::BIGINT)"
    return f"xor(list_reduce(list_transform(string_split({text}, ''), lambda ch: ascii(ch)::BIGINT), lambda crc, x: {byte}, 4294967295::BIGINT), 4294967295)"


def op12_periodic_runs(spark: SparkSession, sf_dir: str) -> DataFrame:
    return periodic.run_digests(read(spark, sf_dir, "documents"))


SQL["op12_periodic_runs"] = rf"""
WITH d0 AS (SELECT doc_id, regexp_extract_all(coalesce(text, ''), '[^\x20\x09-\x0D]+') AS w, {_crc32("doc_id::VARCHAR")} AS h FROM documents),
d1 AS (SELECT doc_id, w, len(w) AS n, CASE WHEN h % 10 = 0 AND len(w) > 0 THEN (h // 10) % len(w) END AS a, h // 10 AS g FROM d0),
d AS (SELECT doc_id, n, CASE WHEN a IS NULL THEN w ELSE list_concat(w[1:a], list_transform(range(0, n - a), lambda i: w[a + 1 + i % (1 + (n - a) // (3 + g % 8))])) END AS w FROM d1),
word AS MATERIALIZED (SELECT doc_id, n, unnest(range(0, n)) AS i, unnest(w) AS x FROM d),
pair AS (SELECT a.doc_id, a.i, b.i - a.i AS q FROM word a JOIN word b ON a.doc_id = b.doc_id AND a.x = b.x AND b.i > a.i AND 4 * (b.i - a.i) <= a.n),
stretch AS (SELECT doc_id, q, min(i) AS s, count(*) + q AS l FROM (SELECT *, i - row_number() OVER (PARTITION BY doc_id, q ORDER BY i) AS island FROM pair) GROUP BY doc_id, q, island HAVING count(*) + q >= greatest(6, 4 * q)),
run AS MATERIALIZED (SELECT doc_id, s, l, min(q) AS q FROM stretch GROUP BY doc_id, s, l),
best AS (SELECT doc_id, count(*) AS n_runs, arg_min({{'s': s, 'l': l, 'q': q}}, (-l, s, q)) AS r, sha256(string_agg(s || ',' || l || ',' || q || chr(10), '' ORDER BY s, q)) AS runs FROM run GROUP BY doc_id),
gone AS (SELECT DISTINCT doc_id, unnest(range(s + q, s + l)) AS i FROM run),
kept AS (SELECT doc_id, string_agg(x, ' ' ORDER BY i) AS t FROM word ANTI JOIN gone USING (doc_id, i) GROUP BY doc_id)
SELECT d.doc_id, coalesce(n_runs, 0) AS n_runs, r.s AS start, r.l AS length, r.q AS period, 1000 * r.l // r.q AS exponent_milli, coalesce(runs, sha256('')) AS runs_sha256, sha256(coalesce(t, '')) AS collapsed_sha256
FROM d LEFT JOIN best USING (doc_id) LEFT JOIN kept USING (doc_id)"""


def op13_conversation_trie(spark: SparkSession, sf_dir: str) -> DataFrame:
    return trie.conversation_trie(read(spark, sf_dir, "conversations"))


SQL["op13_conversation_trie"] = rf"""
WITH t AS (SELECT conv_id AS c, coalesce(role, '') AS r, coalesce(text, '') AS x, row_number() OVER (PARTITION BY conv_id ORDER BY turn NULLS FIRST, md5(length(coalesce(role, '')) || ':' || coalesce(role, '') || coalesce(text, ''))) AS p FROM conversations WHERE conv_id IS NOT NULL),
size AS (SELECT c, count(*) AS n FROM t GROUP BY c),
conv AS (SELECT size.c, h, size.c - size.c % 5 AS base, least(h, coalesce(b.n, 0)) AS given FROM (SELECT c, {_crc32("c::VARCHAR")} % 9 AS h FROM size) size LEFT JOIN size b ON b.c = size.c - size.c % 5),
built AS (SELECT conv.c, p, r, x FROM conv JOIN t ON t.c = base AND p <= h UNION ALL SELECT conv.c, p - h + given, r, x FROM conv JOIN t ON t.c = conv.c AND p > h),
path AS (SELECT c, p AS d, x, string_agg(md5(length(r) || ':' || r || x), '') OVER (PARTITION BY c ORDER BY p) AS id FROM built UNION ALL SELECT c, 0, '', '' FROM conv),
len AS (SELECT c, max(d) AS n FROM path GROUP BY c),
node AS (SELECT id, d, min(path.c) AS c, count(*) AS n, any_value(octet_length(encode(x))) AS b, string_agg(path.c::VARCHAR, ',' ORDER BY path.c) FILTER (WHERE len.n = d) AS ends FROM path JOIN len USING (c) GROUP BY id, d),
kids AS (SELECT id[1:32 * (d - 1)] AS id, d - 1 AS d, count(*) AS n FROM node WHERE d > 0 GROUP BY ALL),
below AS (SELECT up.id, up.d, sum((node.n - 1) * node.b) AS saved, count(*) FILTER (WHERE kids.n IS NULL) AS leaves FROM node JOIN path up ON up.c = node.c AND up.d <= node.d LEFT JOIN kids ON kids.id = node.id AND kids.d = node.d GROUP BY up.id, up.d)
SELECT node.c AS conv_id, node.d AS depth, parent.c AS parent_conv_id, node.n::BIGINT AS n_convs, coalesce(kids.n, 0) AS n_children, leaves AS n_leaves, saved::BIGINT AS saved_tokens, sha256(coalesce(node.ends, '')) AS ends_sha256
FROM node JOIN below ON below.id = node.id AND below.d = node.d LEFT JOIN kids ON kids.id = node.id AND kids.d = node.d LEFT JOIN node parent ON node.d > 0 AND parent.d = node.d - 1 AND parent.id = node.id[1:32 * (node.d - 1)]"""


QUERIES = {name: f for name, f in globals().items() if name[:2] == "op" and name[2:3].isdigit()}
