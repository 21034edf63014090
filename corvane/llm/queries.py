"""The registered queries of the training-data operators, and their SQL."""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from corvane.llm import decontaminate, html_extract, language, licenses, mixing, quality, rules, simhash, toxicity, warc
from corvane.llm.common import UPPER, table

LOW = f"translate(coalesce(text, ''), '{UPPER}', '{UPPER.lower()}')"


def op1_html_extraction(spark: SparkSession, sf_dir: str) -> DataFrame:
    return html_extract.extract_pages(table(spark, sf_dir, "pages"))


def op2_license_scan(spark: SparkSession, sf_dir: str) -> DataFrame:
    return licenses.scan_documents(table(spark, sf_dir, "documents")).drop("detections")


def op3_toxicity(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = table(spark, sf_dir, "documents")
    return toxicity.classify(docs, toxicity.fit(docs, table(spark, sf_dir, "labels")))


def op4_warc_archives(spark: SparkSession, sf_dir: str) -> DataFrame:
    found = warc.round_trip(table(spark, sf_dir, "pages"))
    return found.select("page_id", "payload_bytes", "payload_digest", "record_type", "refers_to")


OP4_SQL = """
WITH p AS (SELECT page_id, CAST(strlen(coalesce(html, '')) AS BIGINT) AS payload_bytes, sha1(coalesce(html, '')) AS payload_digest FROM pages),
w AS (SELECT payload_digest, max(page_id) AS winner FROM p WHERE payload_bytes >= 1000 GROUP BY payload_digest HAVING count(*) > 1)
SELECT page_id, payload_bytes, payload_digest,
       CASE WHEN winner IS NULL OR page_id = winner THEN 'response' ELSE 'revisit' END AS record_type,
       CASE WHEN page_id <> winner THEN winner END AS refers_to
FROM p LEFT JOIN w USING (payload_digest)
"""


def op8_quality_rules(spark: SparkSession, sf_dir: str) -> DataFrame:
    rows = rules.ledger(table(spark, sf_dir, "documents"))
    measures = ("n_words", "word_chars", "n_symbols", "n_dup_lines", "n_repeat_words")
    base_failed = rules.fails("base")
    return rows.select("doc_id", *measures, base_failed.alias("base_failed"), (~base_failed & ~rules.fails(rules.CURRENT)).alias("kept"), "failed_bits")


_BITS = " + ".join(f"CASE WHEN {c} THEN {1 << i} ELSE 0 END" for i, c in enumerate(rules.RULES.values()))
OP8_SQL = rf"""
WITH d AS (SELECT row_number() OVER () AS rid, doc_id, coalesce(text, '') AS t, regexp_extract_all(coalesce(text, ''), '[^\x20\x09-\x0D]+') AS w FROM documents),
grams AS (SELECT rid, p, array_to_string(list_slice(w, p, p + 4), ' ') AS g FROM (SELECT rid, w, unnest(range(1, len(w) - 3)) AS p FROM d)),
twice AS (SELECT rid, p FROM (SELECT rid, p, count(*) OVER (PARTITION BY rid, g) AS n FROM grams) WHERE n > 1),
rep AS (SELECT rid, count(DISTINCT q) AS n_repeat_words FROM (SELECT rid, unnest(range(p, p + 5)) AS q FROM twice) GROUP BY rid),
lines AS (SELECT rid, count(*) AS n_lines, count(*) - count(DISTINCT line) AS n_dup_lines FROM (SELECT rid, unnest(string_split(t, chr(10))) AS line FROM d) WHERE regexp_matches(line, '[^\x20\x09-\x0D]') GROUP BY rid),
m AS (SELECT doc_id, CAST(len(w) AS BIGINT) AS n_words, CAST(length(array_to_string(w, '')) AS BIGINT) AS word_chars,
      CAST(length(regexp_replace(t, '[^#*$%&|<>]', '', 'g')) AS BIGINT) AS n_symbols, CAST(coalesce(n_dup_lines, 0) AS BIGINT) AS n_dup_lines,
      CAST(coalesce(n_repeat_words, 0) AS BIGINT) AS n_repeat_words, coalesce(n_lines, 0) AS n_lines,
      length(regexp_replace(t, '[^A-Z]', '', 'g')) AS n_upper, length(regexp_replace(t, '[^!]', '', 'g')) AS n_bangs
      FROM d LEFT JOIN rep USING (rid) LEFT JOIN lines USING (rid)),
b AS (SELECT *, CAST({_BITS} AS BIGINT) AS failed_bits FROM m)
SELECT doc_id, n_words, word_chars, n_symbols, n_dup_lines, n_repeat_words, (failed_bits & {rules.mask("base")}) <> 0 AS base_failed,
       (failed_bits & {rules.mask("base") | rules.mask(rules.CURRENT)}) = 0 AS kept, failed_bits
FROM b
"""


def op5_language_id(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = table(spark, sf_dir, "documents")
    return language.identify(docs, language.train(docs))


def op7_quality_classifier(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = table(spark, sf_dir, "documents")
    return quality.classify(docs, quality.fit(docs, table(spark, sf_dir, "labels")))


def op6_simhash_near_dedup(spark: SparkSession, sf_dir: str) -> DataFrame:
    found = simhash.near_duplicates(table(spark, sf_dir, "documents"))
    return found.select("doc_id", F.lower(F.lpad(F.hex("fp"), 16, "0")).alias("fingerprint"), "component_id")


def op9_benchmark_decontamination(spark: SparkSession, sf_dir: str) -> DataFrame:
    return decontaminate.report(table(spark, sf_dir, "documents"), table(spark, sf_dir, "benchmark"))


OP9_SQL = rf"""
WITH d AS (SELECT row_number() OVER () AS rid, doc_id, regexp_extract_all({LOW}, '{decontaminate.WORD}') AS w FROM documents),
b AS (SELECT item_id, regexp_extract_all({LOW}, '{decontaminate.WORD}') AS w FROM benchmark),
win AS (SELECT DISTINCT CAST(item_id AS VARCHAR) AS item, n, array_to_string(list_slice(w, p, p + n - 1), ' ') AS gram
        FROM (SELECT item_id, w, least(len(w), 10) AS n, unnest(range(1, greatest(len(w) - 9, 1) + 1)) AS p FROM b WHERE len(w) > 0)),
lens AS (SELECT DISTINCT n FROM win),
pos AS (SELECT rid, w, n, unnest(range(1, len(w) - n + 2)) AS p FROM d JOIN lens ON len(w) >= n),
grams AS (SELECT rid, p, n, array_to_string(list_slice(w, p, p + n - 1), ' ') AS gram FROM pos),
hit AS (SELECT rid, p, grams.n, item FROM grams JOIN win USING (gram)),
cover AS (SELECT rid, count(DISTINCT q) AS n_hit FROM (SELECT rid, unnest(range(p, p + n)) AS q FROM hit) GROUP BY rid),
items AS (SELECT rid, count(*) AS n_items, string_agg(item, ',' ORDER BY item) AS names FROM (SELECT DISTINCT rid, item FROM hit) GROUP BY rid)
SELECT doc_id, CAST(len(w) AS BIGINT) AS n_words, CAST(coalesce(n_hit, 0) AS BIGINT) AS n_hit, CAST(coalesce(n_items, 0) AS BIGINT) AS n_items,
       sha256(coalesce(names, '')) AS items_sha256, coalesce(n_hit, 0) > 0 AS contaminated
FROM d LEFT JOIN cover USING (rid) LEFT JOIN items USING (rid)
"""


def op10_source_mixing(spark: SparkSession, sf_dir: str) -> DataFrame:
    return mixing.mix(table(spark, sf_dir, "documents")).select("doc_id", "size", "source_size", "target", "taken")


def _mix_round(k: int) -> str:
    """One pass over the ranked documents: the longest prefix of those that still fit, equal rows together."""
    left = "goal" if k == 0 else f"n{k - 1} JOIN (SELECT sk, sum(CASE WHEN extra AND NOT was THEN size ELSE 0 END) AS used FROM r{k - 1} GROUP BY sk) USING (sk)"
    rows = "ranked" if k == 0 else f"(SELECT * EXCLUDE (need, was, may) FROM r{k - 1})"
    return f"""
n{k} AS (SELECT sk, need{"" if k == 0 else " - used"} AS need FROM {left}),
m{k} AS (SELECT rid, sk, doc_id, size, q, {"FALSE" if k == 0 else "extra"} AS was, need, {"TRUE" if k == 0 else "NOT extra"} AND size <= need AND need > 0 AS may FROM {rows} JOIN n{k} USING (sk)),
r{k} AS (SELECT *, was OR (may AND sum(CASE WHEN may THEN size ELSE 0 END) OVER (PARTITION BY sk ORDER BY q, doc_id NULLS FIRST, size RANGE UNBOUNDED PRECEDING) <= need) AS extra FROM m{k})"""


OP10_SQL = rf"""
WITH d AS (SELECT row_number() OVER () AS rid, doc_id, source, coalesce('=' || source, '') AS sk,
    CAST(len(regexp_extract_all(coalesce(text, ''), '[^\x20\x09-\x0D]+')) AS BIGINT) AS size,
    (CAST(CAST('0x' || substr(md5('mix|' || coalesce(CAST(doc_id AS VARCHAR), '') || '|' || coalesce(text, '')), 1, 13) AS BIGINT) AS DOUBLE) + CAST(0.5 AS DOUBLE)) / CAST(4503599627370496 AS DOUBLE) AS u
    FROM documents),
src AS (SELECT sk, source, CAST(sum(size) AS BIGINT) AS source_size FROM d GROUP BY sk, source),
rnk AS (SELECT *, row_number() OVER (ORDER BY source ASC NULLS LAST) AS rank FROM src),
wgt AS (SELECT *, CAST(CASE (rank - 1) % 3 WHEN 0 THEN 3 WHEN 1 THEN 1 ELSE 2 END AS DOUBLE) AS weight, CAST(source_size AS DOUBLE) AS s FROM rnk),
lvl AS (SELECT *, CAST(1.5 AS DOUBLE) * sum(s) OVER () AS budget,
    row_number() OVER o AS k,
    coalesce(sum(CAST(2 AS DOUBLE) * s) OVER (o ROWS BETWEEN UNBOUNDED PRECEDING AND 1 PRECEDING), 0) AS filled,
    sum(weight) OVER (o ROWS BETWEEN CURRENT ROW AND UNBOUNDED FOLLOWING) AS unfilled
    FROM wgt WINDOW o AS (ORDER BY (CAST(2 AS DOUBLE) * s) / weight, rank)),
lv2 AS (SELECT *, (budget - filled) / unfilled AS level FROM lvl),
lv3 AS (SELECT arg_min(level, k) AS found FROM lv2 WHERE level <= CAST(2 AS DOUBLE) * s / weight),
tgt AS (SELECT sk, source_size, s, least(CAST(2 AS DOUBLE) * s, coalesce(found, CAST('inf' AS DOUBLE)) * weight) AS target FROM lv2, lv3),
gl0 AS (SELECT *, CASE WHEN s > 0 THEN floor(target / s) ELSE 0 END AS whole FROM tgt),
gl1 AS (SELECT *, target - whole * s AS need FROM gl0),
cls AS (SELECT sk, CAST(length(bin(size)) AS BIGINT) AS digits, CAST(sum(size) AS BIGINT) AS words FROM d GROUP BY ALL),
inc AS (SELECT sk, digits, (need - coalesce(CAST(sum(words) OVER (PARTITION BY sk ORDER BY digits DESC ROWS BETWEEN UNBOUNDED PRECEDING AND 1 PRECEDING) AS DOUBLE), 0))
    / CAST(sum(digits * words) OVER (PARTITION BY sk ORDER BY digits DESC ROWS BETWEEN CURRENT ROW AND UNBOUNDED FOLLOWING) AS DOUBLE) AS scale FROM cls JOIN gl1 USING (sk) WHERE words > 0),
goal AS (SELECT gl1.*, coalesce(i.scale, 1) AS scale FROM gl1 LEFT JOIN (SELECT sk, arg_max(scale, digits) AS scale FROM inc WHERE scale * digits < 1 GROUP BY sk) i USING (sk)),
odd AS (SELECT rid, sk, doc_id, size, u, need, scale * CAST(length(bin(size)) AS DOUBLE) AS p FROM d JOIN goal USING (sk)),
ranked AS (SELECT rid, sk, doc_id, size, CASE WHEN need > 0 THEN (u / (1 - u)) / (CASE WHEN p < 1 THEN p / (1 - p) ELSE CAST('inf' AS DOUBLE) END) ELSE CAST('inf' AS DOUBLE) END AS q FROM odd),
{",".join(_mix_round(k) for k in range(mixing.ROUNDS))}
SELECT r.doc_id, r.size, g.source_size, g.target, CAST((g.whole + CASE WHEN r.extra THEN 1 ELSE 0 END) * r.size AS BIGINT) AS taken
FROM r{mixing.ROUNDS - 1} r JOIN goal g USING (sk)
"""


QUERIES: dict[str, Callable[[SparkSession, str], DataFrame]] = {
    "op1_html_extraction": op1_html_extraction,
    "op2_license_scan": op2_license_scan,
    "op3_toxicity": op3_toxicity,
    "op4_warc_archives": op4_warc_archives,
    "op5_language_id": op5_language_id,
    "op6_simhash_near_dedup": op6_simhash_near_dedup,
    "op7_quality_classifier": op7_quality_classifier,
    "op8_quality_rules": op8_quality_rules,
    "op9_benchmark_decontamination": op9_benchmark_decontamination,
    "op10_source_mixing": op10_source_mixing,
}

ORACLE_SQL: dict[str, str] = {
    "op4_warc_archives": OP4_SQL,
    "op8_quality_rules": OP8_SQL,
    "op9_benchmark_decontamination": OP9_SQL,
    "op10_source_mixing": OP10_SQL,
}
