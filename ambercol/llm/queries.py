"""Queries of the training-data operators, over whole tables, and their SQL where SQL can express them."""

from __future__ import annotations

from collections.abc import Callable

import public_tokenizers
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from . import decontaminate, html_extract, license_scan, line_dedup, near_dedup, packing, quality_model, quality_rules, records, secret_scan
from .common import table

TOKENIZER = public_tokenizers.path("byte_bpe_50k.json")


def op1_secret_scan(spark: SparkSession, sf_dir: str) -> DataFrame:
    return secret_scan.secret_digests(table(spark, sf_dir, "documents"))


def op2_html_extract(spark: SparkSession, sf_dir: str) -> DataFrame:
    return html_extract.extract_pages(table(spark, sf_dir, "pages"))


def op3_packing(spark: SparkSession, sf_dir: str) -> DataFrame:
    pieces = packing.pack(table(spark, sf_dir, "documents"), TOKENIZER)
    return pieces.select("doc_id", "start", "length", F.crc32("ids").alias("ids_crc32"), "doc_tokens", "sequence_id", "offset")


def op4_decontamination(spark: SparkSession, sf_dir: str) -> DataFrame:
    return decontaminate.contamination_digests(table(spark, sf_dir, "documents"), table(spark, sf_dir, "benchmark"))


def op5_license_scan(spark: SparkSession, sf_dir: str) -> DataFrame:
    return license_scan.license_digests(table(spark, sf_dir, "documents"))


def op6_quality_rules(spark: SparkSession, sf_dir: str) -> DataFrame:
    return quality_rules.quality(table(spark, sf_dir, "documents")).select("doc_id", "n_words", "word_chars", "n_symbols", "n_dup_lines", "n_repeat_words", "base_failed", "kept", "n_removed")


def op7_quality_model(spark: SparkSession, sf_dir: str) -> DataFrame:
    return quality_model.classify(table(spark, sf_dir, "documents"), table(spark, sf_dir, "labels"))


def op8_token_records(spark: SparkSession, sf_dir: str) -> DataFrame:
    return records.record_digests(table(spark, sf_dir, "documents"), TOKENIZER)


def op9_line_dedup(spark: SparkSession, sf_dir: str) -> DataFrame:
    return line_dedup.line_digests(table(spark, sf_dir, "documents"))


def op10_near_dedup(spark: SparkSession, sf_dir: str) -> DataFrame:
    return near_dedup.near_digests(table(spark, sf_dir, "documents"))


QUERIES: dict[str, Callable[[SparkSession, str], DataFrame]] = {f.__name__: f for f in (op1_secret_scan, op2_html_extract, op3_packing, op4_decontamination, op5_license_scan, op6_quality_rules, op7_quality_model, op8_token_records, op9_line_dedup, op10_near_dedup)}

_LOWER = "translate(coalesce(text, ''), 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz')"
_SPACE = r"[\x20\x09-\x0D]+"

SQL: dict[str, str] = {
    "op4_decontamination": rf"""
WITH d AS (SELECT doc_id, list_filter(regexp_split_to_array({_LOWER}, '[\x00-\x2F\x3A-\x60\x7B-\x7F]+'), lambda x: x <> '') AS w FROM documents),
i AS (SELECT item_id, list_filter(regexp_split_to_array({_LOWER}, '[\x00-\x2F\x3A-\x60\x7B-\x7F]+'), lambda x: x <> '') AS w FROM benchmark),
g AS (SELECT DISTINCT item_id, least(len(w), 10) AS n, array_to_string(w[p:p + least(len(w), 10) - 1], ' ') AS g
      FROM i, unnest(range(1, greatest(len(w) - 10, 0) + 2)) t(p) WHERE len(w) > 0),
m AS (SELECT DISTINCT n FROM g),
v AS (SELECT doc_id, p, n, array_to_string(w[p:p + n - 1], ' ') AS g FROM d, m, unnest(range(1, greatest(len(w) - n + 2, 1))) t(p)),
h AS (SELECT v.doc_id, v.p, v.n, g.item_id FROM v JOIN g ON v.g = g.g AND v.n = g.n),
c AS (SELECT doc_id, count(DISTINCT p + k) AS n_hit FROM h, unnest(range(0, n)) t(k) GROUP BY doc_id),
s AS (SELECT doc_id, count(*) AS n_items, sha256(string_agg(x, ',' ORDER BY x)) AS items_sha256 FROM (SELECT DISTINCT doc_id, CAST(item_id AS VARCHAR) AS x FROM h) GROUP BY doc_id)
SELECT d.doc_id, CAST(len(d.w) AS BIGINT) AS n_words, coalesce(c.n_hit, 0) AS n_hit, coalesce(s.n_items, 0) AS n_items,
       coalesce(s.items_sha256, sha256('')) AS items_sha256, coalesce(c.n_hit, 0) > 0 AS contaminated
FROM d LEFT JOIN c USING (doc_id) LEFT JOIN s USING (doc_id)""",
    "op6_quality_rules": rf"""
WITH d AS (SELECT doc_id, source, coalesce(text, '') AS t, list_filter(regexp_split_to_array(coalesce(text, ''), '{_SPACE}'), lambda x: x <> '') AS w,
           list_filter(string_split(coalesce(text, ''), chr(10)), lambda x: regexp_matches(x, '[^\x20\x09-\x0D]')) AS l FROM documents),
v AS (SELECT doc_id, p, array_to_string(w[p:p + 7], ' ') AS g FROM d, unnest(range(1, greatest(len(w) - 6, 1))) t(p)),
r AS (SELECT doc_id, count(DISTINCT p + k) AS n FROM (SELECT doc_id, p FROM v QUALIFY count(*) OVER (PARTITION BY doc_id, g) > 1), unnest(range(0, 8)) t(k) GROUP BY doc_id),
x AS (SELECT doc_id, source, t, trim(regexp_replace(lower(line), '{_SPACE}', ' ', 'g')) AS line,
      len(list_filter(regexp_split_to_array(line, '{_SPACE}'), lambda y: y <> '')) AS n FROM (SELECT doc_id, source, t, unnest(l) AS line FROM d)),
f AS (SELECT source, line, count(DISTINCT t) AS n FROM x GROUP BY source, line HAVING count(DISTINCT t) >= 20),
h AS (SELECT source, count(DISTINCT t) AS n FROM d GROUP BY source),
b AS (SELECT f.source, f.line FROM f JOIN h USING (source) WHERE f.n > 0.03 * h.n),
z AS (SELECT doc_id, sum(x.n) AS n FROM x JOIN b USING (source, line) GROUP BY doc_id),
o AS (SELECT d.doc_id, CAST(len(w) AS BIGINT) AS n_words, CAST(length(array_to_string(w, '')) AS BIGINT) AS word_chars,
      CAST(len(regexp_extract_all(t, '[#*$%&|<>]')) AS BIGINT) AS n_symbols, CAST(len(l) - len(list_distinct(l)) AS BIGINT) AS n_dup_lines,
      CAST(coalesce(r.n, 0) AS BIGINT) AS n_repeat_words, CAST(coalesce(z.n, 0) AS BIGINT) AS n_removed FROM d LEFT JOIN r USING (doc_id) LEFT JOIN z USING (doc_id))
SELECT *, n_words < 20 OR 100 * n_repeat_words > 30 * n_words AS base_failed,
       NOT (n_words < 20 OR 100 * n_repeat_words > 30 * n_words) AND n_words - n_removed >= 0.2 * n_words AS kept FROM o""",
    "op9_line_dedup": rf"""
WITH d AS (SELECT doc_id, text, string_split(text, chr(10)) AS l FROM documents),
x AS (SELECT doc_id, text, p, l[p] AS raw, trim(regexp_replace(lower(l[p]), '{_SPACE}', ' ', 'g')) AS line FROM d, unnest(range(1, len(l) + 1)) t(p)),
s AS (SELECT text, arg_min(source, md5(source || text)) AS site FROM documents GROUP BY text),
b AS (SELECT line FROM x JOIN s USING (text) WHERE line <> '' GROUP BY line HAVING count(DISTINCT site) >= 10),
r AS (SELECT doc_id, count(*) AS n_removed FROM x WHERE line IN (SELECT line FROM b) GROUP BY doc_id),
t AS (SELECT doc_id, coalesce(string_agg(raw, chr(10) ORDER BY p) FILTER (line NOT IN (SELECT line FROM b)), '') AS text, count(*) FILTER (line <> '') AS n_lines FROM x GROUP BY doc_id)
SELECT d.doc_id, coalesce(n_lines, 0) AS n_lines, coalesce(n_removed, 0) AS n_removed, sha256(coalesce(t.text, '')) AS text_sha256
FROM documents d LEFT JOIN t USING (doc_id) LEFT JOIN r USING (doc_id)""",
}
