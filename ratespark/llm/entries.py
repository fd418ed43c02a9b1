"""The named queries of the text operators, and their SQL where SQL can say the same."""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import DataFrame, SparkSession

import corpus_pipeline
from ratespark.llm import (
    conversation_trie, decontamination, filter_audit, license_scan, lm_scoring, mixing, near_duplicates, quality, secret_scan,
    sharding, token_counts, url_reputation, warc,
)
from ratespark.runtime import scratch_path

Query = Callable[[SparkSession, str], DataFrame]


def _table(spark: SparkSession, folder: str, name: str) -> DataFrame:
    return spark.read.parquet(f"{folder}/{name}.parquet")


def op1_quality_cascade(spark: SparkSession, folder: str) -> DataFrame:
    return quality.judge_quality(_table(spark, folder, "documents"))


def op2_warc_conversion(spark: SparkSession, folder: str) -> DataFrame:
    legacy, archive = scratch_path(spark, "arc"), scratch_path(spark, "warc")
    warc.write_arc(_table(spark, folder, "pages"), legacy)
    warc.convert_arc(spark, legacy, archive)
    return warc.resolved(warc.read_warc(spark, archive, payloads=False))


def op3_source_mixing(spark: SparkSession, folder: str) -> DataFrame:
    return mixing.mixture(_table(spark, folder, "documents"))


def op4_near_duplicates(spark: SparkSession, folder: str) -> DataFrame:
    return near_duplicates.near_duplicate_classes(_table(spark, folder, "documents"))


def op5_decontamination(spark: SparkSession, folder: str) -> DataFrame:
    return decontamination.judged(_table(spark, folder, "documents"), _table(spark, folder, "benchmark"))


def op6_secret_scan(spark: SparkSession, folder: str) -> DataFrame:
    return secret_scan.secrets(_table(spark, folder, "documents"))


def op7_license_scan(spark: SparkSession, folder: str) -> DataFrame:
    return license_scan.summarised(license_scan.license_findings(_table(spark, folder, "documents")))


def op8_url_reputation(spark: SparkSession, folder: str) -> DataFrame:
    return url_reputation.judged(_table(spark, folder, "pages"), _table(spark, folder, "labels"))


def op9_cross_entropy_difference(spark: SparkSession, folder: str) -> DataFrame:
    return lm_scoring.cross_entropy_difference(_table(spark, folder, "documents"), _table(spark, folder, "labels"))


def op10_hilbert_sharding(spark: SparkSession, folder: str) -> DataFrame:
    return sharding.sharded(_table(spark, folder, "documents"))


def op11_filter_interactions(spark: SparkSession, folder: str) -> DataFrame:
    return filter_audit.interactions(_table(spark, folder, "documents"), _table(spark, folder, "labels"))


def op12_conversation_trie(spark: SparkSession, folder: str) -> DataFrame:
    return conversation_trie.prefix_trie(_table(spark, folder, "conversations")).drop("ref_conv", "ref_pos")


def op13_token_counts(spark: SparkSession, folder: str) -> DataFrame:
    return token_counts.token_counts(_table(spark, folder, "documents"))


QUERIES: dict[str, Query] = {
    query.__name__: query
    for query in (
        op1_quality_cascade, op2_warc_conversion, op3_source_mixing, op4_near_duplicates, op5_decontamination, op6_secret_scan,
        op7_license_scan, op8_url_reputation, op9_cross_entropy_difference, op10_hilbert_sharding,
        op11_filter_interactions, op12_conversation_trie, op13_token_counts,
    )
} | {"pipeline": corpus_pipeline.run}

WORD = r"[^\x20\x09-\x0D]+"
PLAIN_WORD = r"[^\x00-\x2F\x3A-\x60\x7B-\x7F]+"
LOWERED = "translate(coalesce(text, ''), 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz')"

QUALITY_SQL = rf"""
WITH base AS (
  SELECT row_number() OVER () AS r, doc_id, coalesce(text, '') AS text,
         regexp_extract_all(coalesce(text, ''), '{WORD}') AS w,
         list_filter(string_split(coalesce(text, ''), chr(10)), lambda x: regexp_matches(x, '{WORD}')) AS lines
  FROM documents),
windows AS (
  SELECT r, i, w[i] AS a, w[i + 1] AS b, w[i + 2] AS c
  FROM (SELECT r, w, unnest(range(1, len(w) - 1)) AS i FROM base)),
marked AS (SELECT r, i FROM (SELECT r, i, count(*) OVER (PARTITION BY r, a, b, c) AS n FROM windows) WHERE n > 1),
repeats AS (SELECT r, count(DISTINCT p) AS n FROM (SELECT r, unnest([i, i + 1, i + 2]) AS p FROM marked) GROUP BY r),
counted AS (
  SELECT doc_id, text, w, lines, len(w) AS n_words, CAST(coalesce(list_sum(list_transform(w, lambda x: length(x))), 0) AS BIGINT) AS word_chars,
         length(text) - length(regexp_replace(text, '[#*$%&|<>]', '', 'g')) AS n_symbols,
         len(lines) - len(list_distinct(lines)) AS n_dup_lines, coalesce(repeats.n, 0) AS n_repeat_words
  FROM base LEFT JOIN repeats USING (r)),
judged AS (
  SELECT *, (n_words < 50 OR 100 * n_repeat_words > 50 * n_words) AS base_failed,
    10 * n_symbols > 3 * n_words OR word_chars NOT BETWEEN 2 * n_words AND 15 * n_words
    OR 2 * len(list_filter(w, lambda x: x >= 'A' AND x < '[' AND x = upper(x))) > n_words
    OR 2 * len(list_filter(w, lambda x: x >= '0' AND x < ':')) > n_words
    OR 2 * n_dup_lines > len(lines) OR len(list_filter(w, lambda x: length(x) > 1000)) > 0 AS rejected
  FROM counted)
SELECT doc_id, n_words, word_chars, n_symbols, n_dup_lines, n_repeat_words, base_failed, NOT base_failed AND NOT rejected AS kept
FROM judged
"""

WARC_SQL = """
WITH p AS (
  SELECT row_number() OVER () AS r, page_id, coalesce(html, '') AS body, sha1(coalesce(html, '')) AS h FROM pages),
firsts AS (SELECT body, min(page_id) AS first_id FROM p GROUP BY body)
SELECT page_id, CAST(strlen(body) AS BIGINT) AS payload_bytes,
  list_aggregate(list_transform(range(0, 8), lambda g: list_aggregate(list_transform([15, 10, 5, 0], lambda s:
    substr('ABCDEFGHIJKLMNOPQRSTUVWXYZ234567',
      CAST((CAST('0x' || substr(h, CAST(5 * g + 1 AS INT), 5) AS INT) >> CAST(s AS INT)) & 31 AS INT) + 1, 1)), 'string_agg', '')), 'string_agg', '') AS payload_digest,
  CASE WHEN page_id = first_id THEN 'response' ELSE 'revisit' END AS record_type,
  CASE WHEN page_id = first_id THEN NULL ELSE first_id END AS refers_to
FROM p JOIN firsts USING (body)
"""

MIXING_SQL = rf"""
WITH d AS (
  SELECT row_number() OVER () AS r, doc_id, source, len(regexp_extract_all(coalesce(text, ''), '{WORD}')) AS size,
    length(coalesce(text, '')) - length(regexp_replace(coalesce(text, ''), '[#*$%&|<>]', '', 'g')) AS symbols,
    (CAST('0x' || substr(md5('17:' || coalesce(CAST(doc_id AS VARCHAR), '-1')), 1, 13) AS BIGINT) + 0.5) / 4503599627370496.0 AS u
  FROM documents),
s AS (
  SELECT source, source_size, CAST(list_extract([5, 2, 1], CAST((row_number() OVER (ORDER BY source NULLS LAST) - 1) % 3 + 1 AS INT)) AS DOUBLE) AS weight
  FROM (SELECT source, CAST(sum(size) AS BIGINT) AS source_size FROM d GROUP BY source)),
l AS (
  SELECT *, (1.5 * sum(source_size) OVER () - coalesce(2 * sum(source_size) OVER b, 0)) / (sum(weight) OVER () - coalesce(sum(weight) OVER b, 0)) AS level
  FROM s WINDOW b AS (ORDER BY source_size / weight, source NULLS LAST ROWS BETWEEN UNBOUNDED PRECEDING AND 1 PRECEDING)),
f AS (
  SELECT *, first_value(CASE WHEN level * weight < 2 * source_size THEN level END IGNORE NULLS)
    OVER (ORDER BY source_size / weight, source NULLS LAST ROWS BETWEEN UNBOUNDED PRECEDING AND CURRENT ROW) AS final
  FROM l),
t AS (SELECT source, source_size, round(CASE WHEN final IS NULL THEN 2.0 * source_size ELSE final * weight END, 6) AS target FROM f),
k AS (
  SELECT d.*, t.source_size, t.target, CASE WHEN t.source_size > 0 THEN floor(t.target / t.source_size) ELSE 0 END AS epochs,
    greatest(0.1, 1 - symbols / greatest(size, 1)) AS weight
  FROM d JOIN t ON d.source IS NOT DISTINCT FROM t.source),
o AS (
  SELECT *, target - epochs * source_size AS rest,
    coalesce(sum(size) OVER (PARTITION BY source ORDER BY least(CAST(floor(65536 * (1 - pow(u, 1 / weight))) AS INT), 65535), -ln(u) / weight,
      doc_id NULLS LAST, size, r ROWS BETWEEN UNBOUNDED PRECEDING AND 1 PRECEDING), 0) AS before
  FROM k)
SELECT doc_id, size, source_size, target,
  CAST(size * (epochs + CASE WHEN rest > 0 AND before + size / 2 <= rest AND before <= rest THEN 1 ELSE 0 END) AS BIGINT) AS taken
FROM o
"""

DECONTAMINATION_SQL = rf"""
WITH i AS (
  SELECT CAST(item_id AS VARCHAR) AS item, regexp_extract_all({LOWERED}, '{PLAIN_WORD}') AS w FROM benchmark WHERE item_id IS NOT NULL),
iw AS (
  SELECT DISTINCT item, list_slice(w, p, p + least(10, len(w)) - 1) AS win
  FROM (SELECT item, w, unnest(range(1, len(w) - least(10, len(w)) + 2)) AS p FROM i WHERE len(w) > 0)),
d AS (SELECT row_number() OVER () AS r, doc_id, regexp_extract_all({LOWERED}, '{PLAIN_WORD}') AS w FROM documents),
sizes AS (SELECT DISTINCT len(win) AS n FROM iw),
dw AS (
  SELECT r, p, n, list_slice(w, p, p + n - 1) AS win
  FROM (SELECT r, w, n, unnest(range(1, len(w) - n + 2)) AS p FROM d, sizes WHERE len(w) >= n)),
hits AS (SELECT r, p, n, item FROM dw JOIN iw USING (win)),
spots AS (SELECT r, count(DISTINCT x) AS n_hit FROM (SELECT r, unnest(range(p, p + n)) AS x FROM (SELECT DISTINCT r, p, n FROM hits)) GROUP BY r),
found AS (SELECT r, count(DISTINCT item) AS n_items, string_agg(DISTINCT item, ',' ORDER BY item) AS items FROM hits GROUP BY r)
SELECT doc_id, len(w) AS n_words, coalesce(n_hit, 0) AS n_hit, coalesce(n_items, 0) AS n_items,
  sha256(coalesce(items, '')) AS items_sha256, coalesce(n_hit, 0) > 0 AS contaminated
FROM d LEFT JOIN spots USING (r) LEFT JOIN found USING (r)
"""


def _strength_sql(level: str) -> str:
    return f"""
  SELECT CASE WHEN rho > 0 THEN least(greatest(1 / rho - 1, 1.0), 1000.0) ELSE 1000.0 END AS strength FROM (
    SELECT CASE WHEN room > 0 THEN (scatter - n * rate * rate - (g - 1) * rate * (1 - rate)) / room ELSE 0 END AS rho FROM (
      SELECT *, rate * (1 - rate) * (n - squares / n - (g - 1)) AS room FROM (
        SELECT count(*) AS g, sum(n) AS n, sum(bad) / sum(n) AS rate, sum(n * n) AS squares, sum(bad * bad / n) AS scatter
        FROM (SELECT CAST(sum(n) AS DOUBLE) AS n, CAST(sum(bad) AS DOUBLE) AS bad FROM counts WHERE n > 0 GROUP BY {level}))))"""


_DOUBLE = ", ".join(f"'{s}'" for s in url_reputation.DOUBLE_SUFFIXES)
REPUTATION_SQL = rf"""
WITH u AS (
  SELECT page_id, CASE WHEN instr(url, '://') > 0 THEN substr(url, instr(url, '://') + 3) ELSE '' END AS tail FROM pages),
h AS (
  SELECT page_id, regexp_extract(tail, '^([^/?#]*)', 1) AS raw, tail FROM u),
p AS (
  SELECT page_id, translate(raw, 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz') AS host,
    regexp_extract(substr(tail, length(raw) + 1), '^([^?#]*)', 1) AS path FROM h),
m AS (
  SELECT doc_id, max(CASE WHEN coalesce(quality, 1) = 0 OR coalesce(toxic, 0) = 1 THEN 1 ELSE 0 END) AS bad
  FROM labels WHERE doc_id IS NOT NULL AND (quality IS NOT NULL OR toxic IS NOT NULL) GROUP BY doc_id),
counts AS (
  SELECT host, count(bad) AS n, coalesce(sum(bad), 0) AS bad, list_reverse(string_split(host, '.')) AS parts,
    CASE WHEN array_to_string(list_reverse(list_reverse(string_split(host, '.'))[1:2]), '.') IN ({_DOUBLE}) THEN 2 ELSE 1 END AS k,
    regexp_matches(host, '^[0-9.:\[\]]*$') AS numeric,
    CASE WHEN numeric THEN host ELSE array_to_string(list_reverse(parts[1 : k + 1]), '.') END AS domain,
    CASE WHEN numeric THEN '' ELSE array_to_string(list_reverse(parts[1 : k]), '.') END AS suffix
  FROM (SELECT DISTINCT page_id, host FROM p) q LEFT JOIN m ON q.page_id = m.doc_id GROUP BY host),
sh AS ({_strength_sql("host")}), sd AS ({_strength_sql("domain")}), ss AS ({_strength_sql("suffix")}),
overall AS (SELECT coalesce(sum(bad) / sum(n), 0) AS rate FROM counts),
rs AS (
  SELECT suffix, (sum(bad) + (SELECT strength FROM ss) * (SELECT rate FROM overall)) / (sum(n) + (SELECT strength FROM ss)) AS rate
  FROM counts GROUP BY suffix),
rd AS (
  SELECT domain, (sum(bad) + (SELECT strength FROM sd) * any_value(rs.rate)) / (sum(n) + (SELECT strength FROM sd)) AS rate
  FROM counts JOIN rs USING (suffix) GROUP BY domain),
rh AS (
  SELECT host, (bad + (SELECT strength FROM sh) * rd.rate) / (n + (SELECT strength FROM sh)) AS rate, n + (SELECT strength FROM sh) AS weight
  FROM counts JOIN rd USING (domain)),
r AS (
  SELECT page_id, p.host, path, rate - 1.645 * sqrt(rate * (1 - rate) / (weight + 1)) AS low,
    CASE WHEN (p.host = 'example.com' OR p.host LIKE '%.example.com') AND starts_with(path, '/de/') THEN 'example.com/de/'
         WHEN (p.host = 'example.net' OR p.host LIKE '%.example.net') AND starts_with(path, '/en/') THEN 'example.net/en/'
         WHEN (p.host = 'org' OR p.host LIKE '%.org') AND starts_with(path, '/fr/') THEN 'org/fr/'
         WHEN (p.host = 'net' OR p.host LIKE '%.net') AND starts_with(path, '/') THEN 'net/' END AS rule
  FROM p JOIN rh ON p.host = rh.host)
SELECT page_id, host, path, rule,
  CASE WHEN rule IN ('example.com/de/', 'net/') THEN 'block' WHEN rule IS NOT NULL THEN 'allow' WHEN low > 0.5 THEN 'block' ELSE 'allow' END AS verdict
FROM r
"""

FILTER_SQL = rf"""
WITH d AS (
  SELECT row_number() OVER () AS r, doc_id, coalesce(source, '') AS part, coalesce(text, '') AS text,
    regexp_extract_all(coalesce(text, ''), '{WORD}') AS w FROM documents),
f AS (
  SELECT part, doc_id, len(w) < 200 AS a, 100 * len(list_distinct(w)) < 50 * len(w) AS b,
    100 * (length(text) - length(regexp_replace(text, '[A-Z]', '', 'g'))) > 2 * length(text) AS c,
    regexp_matches(text, '[#$%&*|]') AS d, coalesce(doc_id > min(doc_id) OVER (PARTITION BY text), false) AS e,
    coalesce(doc_id IN (SELECT doc_id FROM labels WHERE quality = 1 AND doc_id IS NOT NULL), false) AS good,
    coalesce(doc_id IN (SELECT doc_id FROM labels WHERE toxic = 1 AND doc_id IS NOT NULL), false) AS toxic
  FROM d),
m AS (
  SELECT part, CAST(a AS INT) + 2 * CAST(b AS INT) + 4 * CAST(c AS INT) + 8 * CAST(d AS INT) + 16 * CAST(e AS INT) AS mask,
    count(*) AS n, count(*) FILTER (good) AS n_good, count(*) FILTER (toxic) AS n_toxic FROM f GROUP BY ALL),
l AS (SELECT chr(CAST(65 + i AS INT)) AS l, CAST(1 << i AS INT) AS bit FROM range(5) t(i)),
o AS (
  SELECT a.l || b.l || c.l || d.l || e.l AS filter_order, [a.bit, b.bit, c.bit, d.bit, e.bit] AS bits
  FROM l a, l b, l c, l d, l e WHERE a.bit + b.bit + c.bit + d.bit + e.bit = 31 AND a.bit | b.bit | c.bit | d.bit | e.bit = 31),
s AS (
  SELECT filter_order, CAST(k AS INT) AS step, bits[k] AS bit, CAST(coalesce(list_sum(bits[1:k - 1]), 0) AS INT) AS earlier
  FROM o, range(1, 6) t(k)),
x AS (
  SELECT part, filter_order, step, bit,
    CAST(coalesce(sum(n) FILTER (mask & (earlier | bit) = 0), 0) AS BIGINT) AS kept,
    CAST(coalesce(sum(n) FILTER (mask & bit > 0 AND mask & earlier = 0), 0) AS BIGINT) AS removed,
    CAST(coalesce(sum(n) FILTER (mask & bit > 0 AND mask & earlier > 0), 0) AS BIGINT) AS redundant,
    CAST(coalesce(sum(n) FILTER (mask = bit), 0) AS BIGINT) AS unique_fails,
    CAST(coalesce(sum(n_good) FILTER (mask & bit > 0 AND mask & earlier = 0), 0) AS BIGINT) AS good_lost,
    CAST(coalesce(sum(n_toxic) FILTER (mask & bit > 0 AND mask & earlier = 0), 0) AS BIGINT) AS toxic_lost
  FROM m, s GROUP BY part, filter_order, step, bit)
SELECT part, filter_order, step, kept, removed, redundant, unique_fails, good_lost, toxic_lost,
  CAST(sum(removed) OVER (PARTITION BY part, bit) AS BIGINT) AS shapley
FROM x
"""

TRIE_SQL = rf"""
WITH t AS (
  SELECT conv_id, list({{'role': coalesce(role, ''), 'text': coalesce(text, '')}}
    ORDER BY turn NULLS FIRST, coalesce(role, ''), md5(coalesce(text, ''))) AS turns,
    list_reduce(list_prepend(CAST(4294967295 AS BIGINT), list_transform(string_split(CAST(conv_id AS VARCHAR), ''), lambda x: CAST(ascii(x) AS BIGINT))),
      lambda crc, b: list_reduce(list_prepend(xor(crc, b), CAST([0, 0, 0, 0, 0, 0, 0, 0] AS BIGINT[])),
        lambda v, z: xor(v >> 1, 3988292384 * (v & 1)))) AS crc
  FROM conversations WHERE conv_id IS NOT NULL GROUP BY conv_id),
h AS (SELECT conv_id, turns, conv_id - conv_id % 20 AS base, xor(crc, CAST(4294967295 AS BIGINT)) % 4 AS head FROM t),
r AS (
  SELECT h.conv_id, list_concat(coalesce(b.turns[1:h.head], []), h.turns[h.head + 1:]) AS seq
  FROM h LEFT JOIN t b ON b.conv_id = h.base),
p AS (SELECT conv_id, seq, CAST(d AS BIGINT) AS depth, seq[1:d] AS key FROM (SELECT *, unnest(range(len(seq) + 1)) AS d FROM r)),
g AS (
  SELECT depth, key, min(conv_id) AS conv_id, count(*) AS n_convs, max(len(seq)) = depth AS leaf,
    sha256(coalesce(string_agg(CAST(conv_id AS VARCHAR), ',' ORDER BY conv_id) FILTER (len(seq) = depth), '')) AS ends_sha256,
    CASE WHEN depth = 0 THEN 0 ELSE len(regexp_extract_all(any_value(key)[depth].text, '{WORD}')) END AS words
  FROM p GROUP BY depth, key),
u AS (
  SELECT key[1:d] AS key, CAST(d AS BIGINT) AS depth, sum(CAST(leaf AS INT)) AS n_leaves, sum((n_convs - 1) * words) AS saved_tokens,
    count(*) FILTER (depth = d + 1) AS n_children
  FROM (SELECT *, unnest(range(depth + 1)) AS d FROM g) GROUP BY 1, 2)
SELECT g.conv_id, g.depth, q.conv_id AS parent_conv_id, g.n_convs, u.n_children, CAST(u.n_leaves AS BIGINT) AS n_leaves,
  CAST(u.saved_tokens AS BIGINT) AS saved_tokens, g.ends_sha256
FROM g JOIN u ON u.depth = g.depth AND u.key = g.key
LEFT JOIN g q ON q.depth = g.depth - 1 AND q.key = g.key[1:g.depth - 1]
"""

SQL: dict[str, str] = {
    "op1_quality_cascade": QUALITY_SQL,
    "op2_warc_conversion": WARC_SQL,
    "op3_source_mixing": MIXING_SQL,
    "op5_decontamination": DECONTAMINATION_SQL,
    "op8_url_reputation": REPUTATION_SQL,
    "op11_filter_interactions": FILTER_SQL,
    "op12_conversation_trie": TRIE_SQL,
}
