"""The registered queries of this subpackage and, where SQL can express them, their SQL."""

from __future__ import annotations

import public_tokenizers

from footgrid.llm import bpe, decontaminate, language, license_scan, near_dup, quality_classifier, quality_rules, token_records, url_filter, warc
from footgrid.tables import table

OP8_SQL = """
WITH p AS (
  SELECT page_id,
         coalesce(translate(regexp_extract(url, '://([^/?#]*)', 1), 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz'), '') AS host,
         coalesce(regexp_extract(url, '://[^/?#]*([^?#]*)', 1), '') AS path
  FROM pages),
r(rhost, rpath, rverdict) AS (VALUES ('org', '/', 'allow'), ('example.org', '/es/', 'block'), ('example.org', '/en/1', 'block'), ('com', '/fr/', 'allow'), ('com', '/de/', 'block')),
u AS (SELECT DISTINCT host, path FROM p),
best AS (
  SELECT host, path, arg_max(rhost || rpath, length(rhost) + length(rpath)) AS rule, arg_max(rverdict, length(rhost) + length(rpath)) AS verdict
  FROM u JOIN r ON (host = rhost OR ends_with(host, '.' || rhost)) AND starts_with(path, rpath)
  GROUP BY host, path)
SELECT page_id, p.host, p.path, best.rule AS rule, coalesce(best.verdict, 'allow') AS verdict
FROM p LEFT JOIN best ON p.host = best.host AND p.path = best.path
"""

OP2_SQL = """
WITH p AS (SELECT page_id, coalesce(html, '') AS body FROM pages),
g AS (SELECT body, max(page_id) AS resp FROM p GROUP BY body),
d AS (SELECT p.page_id, CAST(octet_length(encode(p.body)) AS BIGINT) AS n, sha1(p.body) AS h, g.resp
      FROM p JOIN g ON p.body = g.body)
SELECT page_id, n AS payload_bytes,
       array_to_string(list_transform(range(0, 32), lambda k:
         substr('ABCDEFGHIJKLMNOPQRSTUVWXYZ234567',
           1 + CAST((CAST('0x' || substr(h, CAST(1 + 10 * (k // 8) AS INTEGER), 10) AS UBIGINT) >> CAST(5 * (7 - k % 8) AS UBIGINT)) % 32 AS INTEGER), 1)), '') AS payload_digest,
       CASE WHEN page_id = resp THEN 'response' ELSE 'revisit' END AS record_type,
       CASE WHEN page_id = resp THEN NULL ELSE resp END AS refers_to
FROM d
"""


#: Windows by plain comparison: every document word window against every item window.
OP4_SQL = """
WITH dw AS (
  SELECT doc_id, coalesce(regexp_extract_all(translate(text, 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz'), '[^\\x00-\\x2F\\x3A-\\x60\\x7B-\\x7F]+'), []) AS w
  FROM documents),
bw AS (
  SELECT item_id, regexp_extract_all(translate(text, 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz'), '[^\\x00-\\x2F\\x3A-\\x60\\x7B-\\x7F]+') AS w
  FROM benchmark),
bi AS (SELECT item_id, w, least(len(w), 10) AS m, unnest(range(0, len(w) - least(len(w), 10) + 1)) AS s FROM bw WHERE len(w) > 0),
bwin AS (SELECT DISTINCT item_id, m, array_to_string(w[s + 1 : s + m], ' ') AS g FROM bi),
lens AS (SELECT DISTINCT m FROM bwin),
di AS (SELECT doc_id, w, m, unnest(range(0, len(w) - m + 1)) AS s FROM dw, lens WHERE len(w) >= m),
dwin AS (SELECT doc_id, m, s, array_to_string(w[s + 1 : s + m], ' ') AS g FROM di),
hit AS (SELECT DISTINCT doc_id, dwin.m AS m, s, item_id FROM dwin JOIN bwin ON dwin.g = bwin.g AND dwin.m = bwin.m),
pos AS (SELECT doc_id, count(DISTINCT p) AS n_hit FROM (SELECT doc_id, unnest(range(s, s + m)) AS p FROM hit) GROUP BY doc_id),
its AS (SELECT doc_id, count(*) AS n_items, string_agg(i, ',' ORDER BY i) AS ids FROM (SELECT DISTINCT doc_id, CAST(item_id AS VARCHAR) AS i FROM hit) GROUP BY doc_id)
SELECT dw.doc_id, CAST(len(w) AS BIGINT) AS n_words, CAST(coalesce(n_hit, 0) AS BIGINT) AS n_hit, CAST(coalesce(n_items, 0) AS BIGINT) AS n_items,
       sha256(coalesce(ids, '')) AS items_sha256, coalesce(n_hit, 0) > 0 AS contaminated
FROM dw LEFT JOIN pos USING (doc_id) LEFT JOIN its USING (doc_id)
"""


def op1_quality_rules(spark, sf_dir):
    return quality_rules.apply(table(spark, sf_dir, "documents"), table(spark, sf_dir, "labels"))


def op2_warc_archive(spark, sf_dir):
    return warc.round_trip(table(spark, sf_dir, "pages"))


def op3_byte_bpe(spark, sf_dir):
    path = public_tokenizers.path("byte_bpe_multi_50k.tiktoken")
    return bpe.digests(table(spark, sf_dir, "documents"), path, public_tokenizers.PATTERN)


def op4_decontaminate(spark, sf_dir):
    found = decontaminate.apply(table(spark, sf_dir, "documents"), table(spark, sf_dir, "benchmark"))
    return found.select("doc_id", "n_words", "n_hit", "n_items", "items_sha256", "contaminated")


def op5_token_records(spark, sf_dir):
    config = token_records.TokenRecords(public_tokenizers.path("word_bpe_49k.json"))
    return token_records.round_trip(table(spark, sf_dir, "documents"), config)


def op6_near_dup(spark, sf_dir):
    return near_dup.apply(table(spark, sf_dir, "documents"), near_dup.NearDup(shingle=2))


def op7_language(spark, sf_dir):
    return language.apply(table(spark, sf_dir, "documents"))


def op8_url_filter(spark, sf_dir):
    return url_filter.judge(table(spark, sf_dir, "pages"), url_filter.rule_table(spark))


def op9_license_scan(spark, sf_dir):
    return license_scan.apply(table(spark, sf_dir, "documents"))


def op10_quality_classifier(spark, sf_dir):
    return quality_classifier.apply(table(spark, sf_dir, "documents"), table(spark, sf_dir, "labels"))


def queries():
    return {k: v for k, v in globals().items() if k.startswith("op") and callable(v)}


def oracle_sql():
    return {"op2_warc_archive": OP2_SQL, "op4_decontaminate": OP4_SQL, "op8_url_filter": OP8_SQL}
