"""Every registered query of the text-segmentation engine with its SQL twin.

A query reads whole tables of a directory. The twins are written for DuckDB
from the semantics, as chains of common table expressions.
"""

from __future__ import annotations

import functools
from collections.abc import Callable

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from corvane.functions import stub
from corvane.functions import text as fx
from corvane.operators import cleaning, decisions, gaps, keywords, metrics, parsing, ranges, refine, tokens
from corvane.plans import pipelines, rounds, sessions
from corvane.tables import materialise, scratch

Query = Callable[[SparkSession, str], DataFrame]
QUERIES: dict[str, Query] = {}
ORACLE_SQL: dict[str, str] = {}

W = fx.WS
CLOSERS = r'"\x27”’)\]»'
START = r'\p{Lu}\p{Lt}\p{Lo}\p{So}\p{Nd}\p{Nl}"\x27(\[{<“‘«'


#: Tables that the query at hand has written, by name.
_SHARED: dict[str, DataFrame] = {}


def shared(name: str, build: Callable[[], DataFrame]) -> DataFrame:
    """A table that several steps of a query read: written once for each query, so that no step segments a text again."""
    if name not in _SHARED:
        _SHARED[name] = materialise(build(), name)
    return _SHARED[name]


def query(sql: str | None = None) -> Callable[[Query], Query]:
    def add(f: Query) -> Query:
        @functools.wraps(f)
        def run(spark: SparkSession, sf_dir: str) -> DataFrame:
            global _SHARED
            outer, _SHARED = _SHARED, {}
            try:
                return f(spark, sf_dir)
            finally:
                _SHARED = outer

        QUERIES[f.__name__] = run
        if sql is not None:
            ORACLE_SQL[f.__name__] = sql
        return f

    return add


def docs_of(spark: SparkSession, sf_dir: str) -> DataFrame:
    return spark.read.parquet(f"{sf_dir}/documents.parquet").select("doc_id", "text")


def pages_of(spark: SparkSession, sf_dir: str) -> DataFrame:
    return spark.read.parquet(f"{sf_dir}/pages.parquet").select(F.col("page_id").alias("doc_id"), F.col("html").alias("text"))


def with_sql(ctes: list[str], final: str) -> str:
    return "WITH " + ",\n".join(ctes) + "\n" + final


# --- shared parts in SQL -------------------------------------------------------

SENTENCES = [
    rf"t1 AS (SELECT doc_id, unnest(l) AS tok, generate_subscripts(l, 1) - 1 AS pos FROM (SELECT doc_id, regexp_extract_all(text, '[{W}]+|[^{W}]+') AS l FROM documents))",
    rf"t2 AS (SELECT *, sum(length(tok)) OVER (PARTITION BY doc_id ORDER BY pos) - length(tok) AS s, length(tok) AS k, regexp_matches(tok, '^[{W}]') AS isws FROM t1)",
    "t3 AS (SELECT *, lag(tok) OVER w AS prv, lead(tok) OVER w AS nxt FROM t2 WINDOW w AS (PARTITION BY doc_id ORDER BY pos))",
    "t4 AS (SELECT *, CASE WHEN tok IN ('·', '•', '|') AND prv IS NOT NULL AND nxt IS NOT NULL THEN 1 ELSE 0 END AS issep FROM t3)",
    "t5 AS (SELECT *, CASE WHEN issep = 1 AND coalesce(lag(issep, 2) OVER (PARTITION BY doc_id ORDER BY pos), 0) = 1 THEN 0 ELSE 1 END AS brk FROM t4)",
    "t6 AS (SELECT *, sum(CASE WHEN isws THEN 0 ELSE brk END) OVER (PARTITION BY doc_id ORDER BY pos) AS run FROM t5)",
    "t7 AS (SELECT *, CASE WHEN issep = 1 AND (row_number() OVER (PARTITION BY doc_id, run, isws ORDER BY pos) - 1) % 2 = 0 THEN 1 ELSE 0 END AS sep FROM t6)",
    "t8 AS (SELECT *, lag(sep) OVER w AS psep, lead(sep) OVER w AS nsep FROM t7 WINDOW w AS (PARTITION BY doc_id ORDER BY pos))",
    rf"""t9 AS (SELECT *, CASE WHEN isws AND prv IS NOT NULL AND nxt IS NOT NULL AND (psep = 1 OR nsep = 1
        OR (regexp_matches(prv, '[.!?…][{CLOSERS}]*$') AND regexp_matches(nxt, '^[{START}]')
            AND NOT (regexp_replace(prv, '[{CLOSERS}]*$', '') IN ('Mr.', 'Mrs.', 'Ms.', 'Dr.', 'Prof.', 'Gen.', 'Gov.', 'Sgt.', 'Col.', 'Capt.')))
        OR regexp_matches(tok, '\n[{W}]*\n')) THEN 1 ELSE 0 END AS b FROM t8)""",
    "t10 AS (SELECT *, sum(b) OVER (PARTITION BY doc_id ORDER BY pos) AS sid FROM t9)",
    "sp AS (SELECT doc_id, min(s) AS a, max(s + k) AS z FROM t10 WHERE NOT isws AND sep = 0 GROUP BY doc_id, sid)",
    "sent AS (SELECT doc_id, CAST(row_number() OVER (PARTITION BY doc_id ORDER BY a) - 1 AS INTEGER) AS idx, CAST(a AS INTEGER) AS start_, CAST(z AS INTEGER) AS end_, substr(text, CAST(a + 1 AS BIGINT), CAST(z - a AS BIGINT)) AS text FROM sp JOIN documents USING (doc_id))",
]
COUNTS = [*SENTENCES, "cnt AS (SELECT doc_id, CAST(count(s.idx) AS BIGINT) AS n FROM documents d LEFT JOIN sent s USING (doc_id) GROUP BY doc_id)"]
RESPONSES = [
    *COUNTS,
    """resp AS (SELECT doc_id, n, coalesce((SELECT string_agg(['Science>Climate', 'Technology>AI: Models', 'technology > A I > models', 'Business>M-and-A'][(doc_id + k) % 4 + 1] || ': '
        || CASE WHEN k % 4 = 2 THEN 'x, ' ELSE '' END
        || CASE WHEN k % 5 = 3 THEN (k * 5 + 4 + CASE WHEN k % 7 = 6 THEN 1000 ELSE 0 END) || '-' || (k * 5) ELSE (k * 5) || '-' || (k * 5 + 4 + CASE WHEN k % 7 = 6 THEN 1000 ELSE 0 END) END, chr(10) ORDER BY k)
        FROM (SELECT unnest(range(0, (cnt.n - 1) // 5 + 1)) AS k) WHERE k % 6 <> 5), '') AS response FROM cnt)""",
]
LINES = [
    *RESPONSES,
    rf"ln0 AS (SELECT doc_id, n, unnest(l) AS raw0, generate_subscripts(l, 1) AS line FROM (SELECT doc_id, n, string_split(response, chr(10)) AS l FROM resp))",
    rf"ln1 AS (SELECT doc_id, n, line, regexp_replace(raw0, '^[{W}]+|[{W}]+$', '', 'g') AS raw FROM ln0)",
    rf"ln2 AS (SELECT *, regexp_extract(raw, '{parsing._LINE}', 1) AS m1, regexp_extract(raw, '{parsing._LINE}', 2) AS m2 FROM ln1 WHERE raw LIKE '%:%')",
    "ln AS (SELECT doc_id, n, line, CASE WHEN m1 <> '' THEN m1 ELSE substr(raw, 1, strpos(raw, ':') - 1) END AS name, CASE WHEN m1 <> '' THEN m2 ELSE substr(raw, strpos(raw, ':') + 1) END AS spans FROM ln2)",
]


def _parsed(name: str, key: str, shown: str) -> list[str]:
    return [
        f"pk AS (SELECT doc_id, n, line, spans, {shown} AS {name} FROM ln)",
        f"pk2 AS (SELECT *, {key} AS key FROM pk WHERE length({name if name == 'name' else f'array_to_string({name}, chr(62))'}) > 0)",
        f"pp AS (SELECT doc_id, n, line, key, {name}, trim(unnest(string_split(spans, ','))) AS part FROM pk2)",
        "pr AS (SELECT *, regexp_extract(part, '^([0-9]+)\\s*-\\s*([0-9]+)', 1) AS a1, regexp_extract(part, '^([0-9]+)\\s*-\\s*([0-9]+)', 2) AS b1, regexp_extract(part, '^([0-9]+)', 1) AS c1 FROM pp)",
        "pv AS (SELECT *, TRY_CAST(CASE WHEN a1 <> '' THEN a1 ELSE c1 END AS BIGINT) AS s0, TRY_CAST(CASE WHEN a1 <> '' THEN b1 ELSE c1 END AS BIGINT) AS e0 FROM pr)",
        "pc AS (SELECT *, least(least(greatest(s0, 0), n - 1), least(greatest(e0, 0), n - 1)) AS s, greatest(least(greatest(s0, 0), n - 1), least(greatest(e0, 0), n - 1)) AS e FROM pv WHERE s0 IS NOT NULL AND e0 IS NOT NULL AND n > 0)",
        f"ph AS (SELECT doc_id, key, min(line) AS l0, arg_min({name}, line) AS {name} FROM pc GROUP BY doc_id, key)",
        "pg AS (SELECT *, CAST(row_number() OVER (PARTITION BY doc_id ORDER BY l0) - 1 AS INTEGER) AS gi FROM ph)",
        "pi1 AS (SELECT doc_id, key, s, e, max(e) OVER (PARTITION BY doc_id, key ORDER BY s, e ROWS BETWEEN UNBOUNDED PRECEDING AND 1 PRECEDING) AS reach FROM pc)",
        "pi2 AS (SELECT *, sum(CASE WHEN s <= reach + 1 THEN 0 ELSE 1 END) OVER (PARTITION BY doc_id, key ORDER BY s, e ROWS UNBOUNDED PRECEDING) AS isl FROM pi1)",
        "pi3 AS (SELECT doc_id, key, CAST(isl - 1 AS INTEGER) AS ri, min(s) AS s, max(e) AS e FROM pi2 GROUP BY doc_id, key, isl)",
        f"grp AS (SELECT doc_id, gi, ri, {name}, s, e FROM pi3 JOIN pg USING (doc_id, key))",
    ]


def _squeezed(c: str) -> str:
    return rf"regexp_replace(regexp_replace({c}, '[{W}]+', ' ', 'g'), '^ | $', '', 'g')"


LABEL = f"list_filter(list_transform(flatten(list_transform(string_split(name, '>'), lambda x: string_split(x, ':'))), lambda x: {_squeezed('x')}), lambda x: x <> '')"
KEY = "list_transform({}, lambda x: regexp_replace(lower(x), '[^a-z0-9]', '', 'g'))"
GROUPS = [*LINES, *_parsed("label", KEY.format("label"), LABEL)]
INSIGHTS = [*LINES, *_parsed("name", "lower(name)", _squeezed("name"))]
TRIMMED = [
    *GROUPS,
    "tr1 AS (SELECT *, coalesce(max(e) OVER (PARTITION BY doc_id ORDER BY s, e, gi, ri ROWS BETWEEN UNBOUNDED PRECEDING AND 1 PRECEDING), -1) + 1 AS expected FROM grp)",
    "tr AS (SELECT doc_id, gi, ri, label, greatest(s, expected) AS s, e, expected FROM tr1 WHERE e >= expected)",
]
REPAIRED = [
    *TRIMMED,
    """rp AS (SELECT doc_id, gi, ri, label, CAST(CASE WHEN row_number() OVER w = 1 THEN 0 ELSE s END AS BIGINT) AS s, CAST(coalesce(lead(s) OVER w - 1, greatest(e, n - 1)) AS BIGINT) AS e
        FROM tr JOIN cnt USING (doc_id) WINDOW w AS (PARTITION BY doc_id ORDER BY s, e, gi, ri))""",
]
OWNERS = [*REPAIRED, "own AS (SELECT doc_id, gi, unnest(range(s, e + 1)) AS idx FROM rp)"]
HOLES = [
    *TRIMMED,
    "hi AS (SELECT doc_id, expected AS s, s - 1 AS e, lag(gi) OVER w AS prev_gi, gi AS next_gi, s > expected AS hole FROM tr WINDOW w AS (PARTITION BY doc_id ORDER BY s, e, gi, ri))",
    "hl AS (SELECT doc_id, max(e) AS last, arg_max(gi, e) AS g FROM tr GROUP BY doc_id)",
    "holes AS (SELECT doc_id, s, e, prev_gi, next_gi FROM hi WHERE hole UNION ALL SELECT doc_id, last + 1, n - 1, g, NULL FROM hl JOIN cnt USING (doc_id) WHERE last < n - 1)",
    "each_ AS (SELECT doc_id, unnest(range(s, e + 1)) AS idx, prev_gi, next_gi FROM holes)",
    r"res AS (SELECT e.doc_id, e.idx, prev_gi, next_gi, CASE WHEN prev_gi IS NULL THEN next_gi WHEN next_gi IS NULL OR prev_gi = next_gi OR regexp_matches(text, '^[\p{Cc}\p{Cf}\p{M}\p{Z}]*$') THEN prev_gi END AS owner FROM each_ e JOIN sent USING (doc_id, idx))",
    "oo AS (SELECT doc_id, gi, unnest(range(s, e + 1)) AS idx FROM tr)",
]


def runs_sql(source: str, keys: str) -> str:
    return f"SELECT {keys}, CAST(row_number() OVER (PARTITION BY {keys} ORDER BY min(idx)) - 1 AS INTEGER) AS ri, CAST(min(idx) AS BIGINT) AS s, CAST(max(idx) AS BIGINT) AS e FROM (SELECT *, idx - row_number() OVER (PARTITION BY {keys} ORDER BY idx) AS isl FROM {source}) GROUP BY {keys}, isl"


# --- shared parts in Spark -----------------------------------------------------


def sentences_of(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Sentences, split once. A query that needs them asks before it asks for counts, which are then taken from them."""
    return shared("sentences", lambda: tokens.hard_sentences(docs_of(spark, sf_dir)))


def counts_of(spark: SparkSession, sf_dir: str) -> DataFrame:
    def build() -> DataFrame:
        docs = docs_of(spark, sf_dir)
        return tokens.counts_of_sentences(docs, _SHARED["sentences"]) if "sentences" in _SHARED else tokens.sentence_counts(docs)

    return shared("counts", build)


def groups_of(spark: SparkSession, sf_dir: str) -> DataFrame:
    return shared("groups", lambda: parsing.parse_topics(stub.with_topic_response(counts_of(spark, sf_dir)), decode=False))


def repaired_of(spark: SparkSession, sf_dir: str) -> DataFrame:
    return shared("repaired", lambda: gaps.repair(groups_of(spark, sf_dir), counts_of(spark, sf_dir)))


def flat(groups: DataFrame) -> DataFrame:
    return groups.withColumn("label", F.array_join("label", ">"))


# --- scalars -------------------------------------------------------------------


@query("SELECT doc_id, translate('​' || text || '﻿', '​‌‍‎‏⁠⁡⁢⁣⁤﻿', '') AS clean FROM documents")
def zero_width_strip(spark, sf_dir):
    return docs_of(spark, sf_dir).select("doc_id", fx.strip_zero_width(F.concat(F.lit("​"), F.col("text"), F.lit("﻿"))).alias("clean"))


@query(rf"SELECT page_id AS doc_id, regexp_replace(regexp_replace(replace(html, '<', '  <' || chr(10) || chr(10) || chr(10) || chr(10)), '[{fx.LINE_SPACE}]+', ' ', 'g'), '\n{{3,}}', chr(10) || chr(10), 'g') AS clean FROM pages")
def collapse_whitespace(spark, sf_dir):
    return pages_of(spark, sf_dir).select("doc_id", fx.collapse_whitespace(F.replace("text", F.lit("<"), F.lit("  <\n\n\n\n"))).alias("clean"))


@query(r"SELECT doc_id, NOT regexp_matches(text, '[\p{L}\p{N}]') AS content_free, NOT regexp_matches(regexp_replace(text, '[\p{L}\p{N}]', '', 'g'), '[\p{L}\p{N}]') AS emptied FROM documents")
def content_free(spark, sf_dir):
    """Whole texts, and whole texts without their letters and digits, so that there are some without content."""
    emptied = F.regexp_replace("text", r"[\p{L}\p{N}]", "")
    return docs_of(spark, sf_dir).select("doc_id", fx.content_free(F.col("text")).alias("content_free"), fx.content_free(emptied).alias("emptied"))


@query("SELECT doc_id, CASE WHEN length(text) <= 120 THEN text ELSE substr(text, 1, 60) || '…' || right(text, 59) END AS fitted FROM documents")
def fit_text(spark, sf_dir):
    return docs_of(spark, sf_dir).select("doc_id", fx.fit_text(F.col("text"), 120).alias("fitted"))


@query("SELECT doc_id, CAST(ceil(greatest(length(text) / 2, strlen(text) / 3) * CAST(1.1 AS DOUBLE)) AS BIGINT) AS n_tokens FROM documents")
def estimate_tokens(spark, sf_dir):
    return docs_of(spark, sf_dir).select("doc_id", fx.estimate_tokens(F.col("text")).alias("n_tokens"))


_REPETITIVE = [
    "wl AS (SELECT doc_id, regexp_extract_all(lower(text), '[a-z0-9#.+-]+') AS w FROM documents)",
    "sh AS (SELECT doc_id, max(k) AS k FROM (SELECT doc_id, g, count(*) AS k FROM (SELECT doc_id, unnest(list_transform(range(1, len(w) - 6), lambda i: array_to_string(list_slice(w, i, i + 7), ' '))) AS g FROM wl) GROUP BY doc_id, g) GROUP BY doc_id)",
    "rep AS (SELECT doc_id, len(w) >= 120 AND (len(list_distinct(w)) / len(w) < 0.18 OR coalesce(k, 0) >= 12) AS repetitive FROM wl LEFT JOIN sh USING (doc_id))",
]


@query(with_sql(_REPETITIVE, "SELECT doc_id, repetitive FROM rep"))
def looks_repetitive(spark, sf_dir):
    return docs_of(spark, sf_dir).select("doc_id", fx.looks_repetitive(F.col("text")).alias("repetitive"))


@query(with_sql(_REPETITIVE, "SELECT doc_id, CASE WHEN length(text) > 10000 THEN 'response too long' WHEN repetitive THEN 'repetitive response' END AS error FROM documents JOIN rep USING (doc_id)"))
def validate_response(spark, sf_dir):
    return docs_of(spark, sf_dir).select("doc_id", fx.response_error(F.col("text"), 10_000).alias("error"))


@query(rf"SELECT conv_id, turn, regexp_replace(regexp_replace('<think a=1>' || text || chr(10) || '</THINK>' || text, '(?is)<think\b[^>]*>.*?</think>', '', 'g'), '^[{W}]+|[{W}]+$', '', 'g') AS answer FROM conversations")
def strip_reasoning(spark, sf_dir):
    c = spark.read.parquet(f"{sf_dir}/conversations.parquet")
    return c.select("conv_id", "turn", fx.strip_reasoning(F.concat(F.lit("<think a=1>"), F.col("text"), F.lit("\n</THINK>"), F.col("text"))).alias("answer"))


@query(with_sql(LINES, f"SELECT doc_id, line - 1 AS line, array_to_string({LABEL}, '>') AS label, array_to_string({KEY.format(LABEL)}, '>') AS key FROM ln"))
def label_normalize(spark, sf_dir):
    rows = parsing._labelled_lines(stub.with_topic_response(counts_of(spark, sf_dir)))
    label = fx.label_parts(F.col("name"))
    return rows.select("doc_id", F.col("line").cast("long").alias("line"), F.array_join(label, ">").alias("label"), F.array_join(fx.label_key(label), ">").alias("key"))


@query(rf"SELECT conv_id, turn, lower({_squeezed('text')}) AS key FROM conversations")
def insight_name_key(spark, sf_dir):
    return spark.read.parquet(f"{sf_dir}/conversations.parquet").select("conv_id", "turn", fx.name_key(F.col("text")).alias("key"))


# --- tokens, marking -----------------------------------------------------------


@query(with_sql(SENTENCES[:2], "SELECT doc_id, CAST(row_number() OVER (PARTITION BY doc_id ORDER BY pos) - 1 AS INTEGER) AS idx, CAST(s AS INTEGER) AS start, CAST(s + k AS INTEGER) AS \"end\", tok AS text FROM t2 WHERE NOT isws"))
def word_tokens(spark, sf_dir):
    return tokens.word_tokens(docs_of(spark, sf_dir))


@query(with_sql(SENTENCES, 'SELECT doc_id, idx, start_ AS start, end_ AS "end", text FROM sent'))
def hard_sentences(spark, sf_dir):
    return tokens.hard_sentences(docs_of(spark, sf_dir))


@query(with_sql(SENTENCES, "SELECT d.doc_id, coalesce(string_agg('{' || idx || '} ' || s.text, chr(10) ORDER BY idx), '{0} ' || any_value(d.text)) AS tagged_text, CAST(greatest(count(idx), 1) AS BIGINT) AS n_items FROM documents d LEFT JOIN sent s USING (doc_id) GROUP BY d.doc_id"))
def mark_sentences(spark, sf_dir):
    return tokens.mark_sentences(docs_of(spark, sf_dir), tokens.hard_sentences(docs_of(spark, sf_dir)))


_MARKED_WORDS = rf"mw AS (SELECT doc_id, l, coalesce(array_to_string(list_transform(l, lambda x, i: '{{' || (i - 1) || '}} ' || x), ' '), '') AS tagged_text FROM (SELECT doc_id, regexp_extract_all(text, '[^{W}]+') AS l FROM documents))"


@query(with_sql([_MARKED_WORDS], "SELECT doc_id, tagged_text, CAST(len(l) AS BIGINT) AS n_items FROM mw"))
def mark_words(spark, sf_dir):
    return tokens.mark_words(docs_of(spark, sf_dir))


@query(with_sql([_MARKED_WORDS], r"SELECT doc_id, TRY_CAST(regexp_extract_all(tagged_text, '\{(\d+)\}', 1)[1] AS INTEGER) AS marker_start, TRY_CAST(regexp_extract_all(tagged_text, '\{(\d+)\}', 1)[-1] AS INTEGER) AS marker_end FROM mw"))
def chunk_markers(spark, sf_dir):
    return tokens.with_markers(tokens.mark_words(docs_of(spark, sf_dir))).select("doc_id", "marker_start", "marker_end")


@query(with_sql(SENTENCES, rf"""SELECT doc_id, idx, CASE WHEN regexp_full_match(t, '(\d{{1,3}}|[a-zA-Z]|[ivxIVX]{{1,5}})[.)]') THEN 'list_marker' WHEN regexp_full_match(t, '[^\p{{L}}\p{{N}}_{W}.!?…]{{1,5}}') THEN 'bridge' WHEN regexp_matches(t, '[\p{{L}}\p{{N}}]') THEN 'content' ELSE 'blank' END AS kind
FROM (SELECT doc_id, idx, regexp_replace(regexp_replace(regexp_replace(text, '[\p{{C}}\p{{Zl}}\p{{Zp}}]', '', 'g'), '[{fx.LINE_SPACE}]+', ' ', 'g'), '^[{W}]+|[{W}]+$', '', 'g') AS t FROM sent)"""))
def sentence_signal_kind(spark, sf_dir):
    return tokens.hard_sentences(docs_of(spark, sf_dir)).select("doc_id", "idx", fx.signal_kind(F.col("text")).alias("kind"))


def _violations(spark: SparkSession, sf_dir: str, rows: DataFrame) -> DataFrame:
    """Documents, and how many of their characters (but white space and separator glyphs) no span of ``rows`` has, or more than one."""
    n = F.length(F.regexp_replace("text", f"[{W}·•|]", ""))
    per = rows.groupBy("doc_id").agg(F.sum(n).alias("k"))
    whole = docs_of(spark, sf_dir).select("doc_id", n.alias("w"))
    return whole.join(per, "doc_id", "left").select("doc_id", (F.coalesce("k", F.lit(0)) - F.col("w")).cast("long").alias("violations"))


_NONE = "SELECT doc_id, CAST(0 AS BIGINT) AS violations FROM documents"


@query(_NONE)
def sparse_sentence_invariants(spark, sf_dir):
    return _violations(spark, sf_dir, tokens.sparse_sentences(docs_of(spark, sf_dir), 12, 24, 4))


@query(_NONE)
def normalized_sentence_invariants(spark, sf_dir):
    return _violations(spark, sf_dir, tokens.normalised_sentences(docs_of(spark, sf_dir)))


@query(_NONE)
def chunk_invariants(spark, sf_dir):
    """Chunks over the limit, and lines that no chunk has."""
    docs = docs_of(spark, sf_dir)
    marked = tokens.mark_words(docs)
    cut = tokens.chunks(marked, 4000, 20, by_words=True)
    own = F.regexp_extract_all("tagged_text", F.lit(r"\{(\d+)\} "), F.lit(1))
    seen = cut.groupBy("doc_id").agg(F.sum((F.length("tagged_text") > 4000).cast("long")).alias("over"), F.size(F.array_distinct(F.flatten(F.collect_list(own)))).alias("k"))
    return marked.join(seen, "doc_id", "left").select("doc_id", (F.coalesce("over", F.lit(0)) + F.abs(F.coalesce("k", F.lit(0)) - F.col("n_items"))).cast("long").alias("violations"))


# --- parsers -------------------------------------------------------------------


@query(with_sql(GROUPS, "SELECT doc_id, gi, ri, array_to_string(label, '>') AS label, s, e FROM grp"))
def topic_parse(spark, sf_dir):
    return flat(groups_of(spark, sf_dir))


@query(with_sql(INSIGHTS, "SELECT doc_id, gi, ri, name, s, e FROM grp"))
def insight_parse(spark, sf_dir):
    return parsing.parse_insights(stub.with_topic_response(counts_of(spark, sf_dir)))


_KEYWORDS = [
    rf"kn AS (SELECT doc_id, CAST(len(regexp_extract_all(text, '[^{W}]+')) AS BIGINT) AS n FROM documents)",
    "kr AS (SELECT doc_id, n, '0, ' || (n // 2) || '-' || (n // 2 + 2) || ', ' || (n + 5) AS response FROM kn)",
    r"ke AS (SELECT doc_id, n, string_split(unnest(regexp_extract_all(response, '([0-9]+\s*-\s*[0-9]+|[0-9]+)')), '-') AS p FROM kr)",
    "kx AS (SELECT DISTINCT doc_id, least(CAST(trim(p[1]) AS BIGINT), CAST(trim(p[-1]) AS BIGINT)) AS s, greatest(CAST(trim(p[1]) AS BIGINT), CAST(trim(p[-1]) AS BIGINT)) AS e FROM ke WHERE greatest(CAST(trim(p[1]) AS BIGINT), CAST(trim(p[-1]) AS BIGINT)) < n)",
]


def keyword_ranges_of(spark: SparkSession, sf_dir: str) -> DataFrame:
    n = F.size(F.regexp_extract_all("text", F.lit(rf"[^{W}]+"), F.lit(0))).cast("long")
    return parsing.parse_keywords(docs_of(spark, sf_dir).select("doc_id", n.alias("n")).withColumn("response", stub.keyword_response(F.col("n"))))


@query(with_sql(_KEYWORDS, "SELECT doc_id, s, e FROM kx"))
def keyword_index_parse(spark, sf_dir):
    return keyword_ranges_of(spark, sf_dir)


_ANSWER = "['PREVIOUS', ' next, since it fits', 'NEW: Misc > T>', 'I cannot decide', 'maybe previous', 'New', 'neither NEXT nor PREVIOUS'][CAST(doc_id % 7 AS INTEGER) + 1]"
_ANSWERS = ("PREVIOUS", " next, since it fits", "NEW: Misc > T>", "I cannot decide", "maybe previous", "New", "neither NEXT nor PREVIOUS")


@query(f"""WITH a AS (SELECT doc_id, trim({_ANSWER}) AS r FROM documents)
SELECT doc_id, CASE WHEN upper(r) LIKE 'PREVIOUS%' THEN 'previous' WHEN upper(r) LIKE 'NEXT%' THEN 'next' WHEN upper(r) LIKE 'NEW%' THEN 'new'
  WHEN contains(upper(r), 'PREVIOUS') AND NOT contains(upper(r), 'NEXT') THEN 'previous' WHEN contains(upper(r), 'NEXT') AND NOT contains(upper(r), 'PREVIOUS') THEN 'next' ELSE 'unknown' END AS decision,
  CASE WHEN upper(r) LIKE 'NEW%' THEN CASE WHEN strpos(r, ':') > 0 THEN 'Misc>T' ELSE 'Uncategorized' END END AS topic FROM a""")
def gap_answer_parse(spark, sf_dir):
    a = F.element_at(F.array(*map(F.lit, _ANSWERS)), (F.col("doc_id") % 7 + 1).cast("int"))
    d = parsing.gap_decision(a)
    return docs_of(spark, sf_dir).select("doc_id", d.alias("decision"), F.when(d == "new", F.array_join(parsing.new_topic(a), ">")).alias("topic"))


@query(f"SELECT doc_id, CASE WHEN contains(upper({_ANSWER}), 'PREVIOUS') AND NOT contains(upper({_ANSWER}), 'NEXT') THEN 'previous' WHEN contains(upper({_ANSWER}), 'NEXT') AND NOT contains(upper({_ANSWER}), 'PREVIOUS') THEN 'next' END AS decision FROM documents")
def reassign_parse(spark, sf_dir):
    a = F.element_at(F.array(*map(F.lit, _ANSWERS)), (F.col("doc_id") % 7 + 1).cast("int"))
    return docs_of(spark, sf_dir).select("doc_id", parsing.reassignment(a).alias("decision"))


@query("SELECT doc_id, CASE doc_id % 5 WHEN 0 THEN 0 WHEN 1 THEN 1 WHEN 2 THEN -2 WHEN 3 THEN 0 ELSE 2 END AS shift FROM documents")
def boundary_parse(spark, sf_dir):
    a = F.element_at(F.array(*map(F.lit, ("CORRECT", "SHIFT_LEFT 1", "shift_right 9", "SHIFT_LEFT", " SHIFT_LEFT 10"))), (F.col("doc_id") % 5 + 1).cast("int"))
    return docs_of(spark, sf_dir).select("doc_id", parsing.boundary_shift(a, 2).alias("shift"))


@query("""SELECT doc_id, 'b' || k AS qid, ((doc_id * 31 + k * 17) % 100) / 100 AS probability, (doc_id + k) % 5 <> 0 AS valid FROM documents, (SELECT unnest([2, 3, 4]) AS k)""")
def decision_parse(spark, sf_dir):
    rows = docs_of(spark, sf_dir).select("doc_id", F.explode(F.array(F.lit(2), F.lit(3), F.lit(4))).alias("k"))
    p = stub.split_probability(F.col("doc_id"), F.col("k"))
    rest = F.when((F.col("doc_id") + F.col("k")) % 5 == 0, 1.5).otherwise(1.0) - p
    a = F.struct(F.when(p >= 0.5, "split").otherwise("continue").alias("choice"), F.create_map(F.lit("split"), p, F.lit("continue"), rest).alias("probabilities"))
    one = rows.groupBy("doc_id").agg(F.map_from_entries(F.collect_list(F.struct(F.concat(F.lit("b"), F.col("k").cast("string")), a))).alias("answers"))
    return parsing.split_probabilities(one.select("doc_id", F.to_json(F.struct("answers")).alias("response")))


@query("SELECT doc_id, k AS section, CASE k WHEN 1 THEN 'Tech>Apple Phone' WHEN 3 THEN 'Business>Fed' END AS label FROM documents, (SELECT unnest([1, 3]) AS k) WHERE k <= doc_id % 4")
def label_lines_parse(spark, sf_dir):
    text = "1: Tech>Apple: Phone\n**[3]** - Business>Fed\nnoise\n3) Other\n9: Out"
    rows = docs_of(spark, sf_dir).select("doc_id", (F.col("doc_id") % 4).alias("n"), F.lit(text).alias("response"))
    return parsing.parse_labels(rows).select("doc_id", "section", F.array_join("label", ">").alias("label"))


# --- ranges and gaps -----------------------------------------------------------

_RAW = "raw AS (SELECT doc_id, k, (doc_id * 7 + k * 13) % 40 - 3 AS s, (doc_id * 5 + k * 3) % 40 - 3 AS e FROM documents, (SELECT unnest(range(0, 6)) AS k))"


def _raw_ranges(spark: SparkSession, sf_dir: str) -> DataFrame:
    rows = docs_of(spark, sf_dir).select("doc_id", F.explode(F.sequence(F.lit(0), F.lit(5))).alias("k"))
    return rows.select("doc_id", "k", ((F.col("doc_id") * 7 + F.col("k") * 13) % 40 - 3).alias("s"), ((F.col("doc_id") * 5 + F.col("k") * 3) % 40 - 3).alias("e"))


_CLAMPED = [_RAW, "cl AS (SELECT doc_id, k, least(least(greatest(s, 0), 29), least(greatest(e, 0), 29)) AS s, greatest(least(greatest(s, 0), 29), least(greatest(e, 0), 29)) AS e FROM raw)"]


@query(with_sql(_CLAMPED, "SELECT doc_id, CAST(k AS INTEGER) AS k, s, e FROM cl"))
def range_clamp(spark, sf_dir):
    return ranges.clamp(_raw_ranges(spark, sf_dir), F.lit(29).cast("long"))


_COALESCED = [
    *_CLAMPED,
    "c1 AS (SELECT *, max(e) OVER (PARTITION BY doc_id ORDER BY s, e ROWS BETWEEN UNBOUNDED PRECEDING AND 1 PRECEDING) AS reach FROM cl)",
    "c2 AS (SELECT *, sum(CASE WHEN s <= reach + 1 THEN 0 ELSE 1 END) OVER (PARTITION BY doc_id ORDER BY s, e ROWS UNBOUNDED PRECEDING) AS isl FROM c1)",
    "co AS (SELECT doc_id, CAST(isl - 1 AS INTEGER) AS ri, min(s) AS s, max(e) AS e FROM c2 GROUP BY doc_id, isl)",
]


@query(with_sql(_COALESCED, "SELECT doc_id, ri, s, e FROM co"))
def range_coalesce(spark, sf_dir):
    return ranges.coalesce(range_clamp(spark, sf_dir), "doc_id")


@query(with_sql([*_COALESCED, "ix AS (SELECT doc_id, unnest(range(s, e + 1)) AS idx FROM co)", "odd AS (SELECT * FROM ix WHERE idx % 7 <> 3)"], runs_sql("odd", "doc_id")))
def indices_to_ranges(spark, sf_dir):
    rows = ranges.to_indices(range_coalesce(spark, sf_dir)).where("idx % 7 <> 3").select("doc_id", "idx")
    return ranges.from_indices(rows, "doc_id")


_SECTIONS = [
    *COUNTS,
    "fl AS (SELECT doc_id, idx, idx > 0 AND ((doc_id * 31 + idx * 17) % 100) / 100 >= 0.5 AS st FROM (SELECT doc_id, unnest(range(0, n)) AS idx FROM cnt))",
    "fr AS (SELECT doc_id, idx, sum(CASE WHEN st THEN 1 ELSE 0 END) OVER (PARTITION BY doc_id ORDER BY idx) AS run FROM fl)",
    "sec AS (SELECT doc_id, CAST(run AS INTEGER) AS ri, CAST(min(idx) AS INTEGER) AS s, CAST(max(idx) AS INTEGER) AS e FROM fr GROUP BY doc_id, run)",
]


def sections_of(spark: SparkSession, sf_dir: str) -> DataFrame:
    counts = counts_of(spark, sf_dir)
    gaps_ = counts.where("n > 1").select("doc_id", F.explode(F.sequence(F.lit(1), F.col("n").cast("int") - 1)).alias("idx"))
    return shared("sections", lambda: decisions.sections(gaps_.withColumn("probability", stub.split_probability(F.col("doc_id"), F.col("idx"))), counts))


@query(with_sql(_SECTIONS, "SELECT * FROM sec"))
def decision_ranges(spark, sf_dir):
    return sections_of(spark, sf_dir)


@query(with_sql([*COUNTS, "fl AS (SELECT doc_id, idx, (doc_id + idx) % 3 = 0 AND idx > 0 AS st FROM (SELECT doc_id, unnest(range(0, n)) AS idx FROM cnt))", "fr AS (SELECT doc_id, idx, sum(CASE WHEN st THEN 1 ELSE 0 END) OVER (PARTITION BY doc_id ORDER BY idx) AS run FROM fl)"], "SELECT doc_id, CAST(run AS INTEGER) AS ri, CAST(min(idx) AS INTEGER) AS s, CAST(max(idx) AS INTEGER) AS e FROM fr GROUP BY doc_id, run"))
def split_flags_to_ranges(spark, sf_dir):
    rows = sentences_of(spark, sf_dir).select("doc_id", "idx", ((F.col("doc_id") + F.col("idx")) % 3 == 0).alias("starts"))
    return ranges.from_flags(rows, "doc_id")


@query(with_sql([*TRIMMED, "h AS (SELECT doc_id, min(expected) AS a FROM tr WHERE s > expected GROUP BY doc_id)", "hs AS (SELECT tr.doc_id, a, min(s) AS s FROM tr JOIN h ON tr.doc_id = h.doc_id AND expected = a GROUP BY tr.doc_id, a)", "l AS (SELECT doc_id, max(e) AS last FROM tr GROUP BY doc_id)"], """SELECT doc_id, CASE WHEN last IS NULL THEN 'no groups' WHEN a IS NOT NULL THEN 'sentences ' || a || '-' || (s - 1) || ' are in no group' WHEN last < n - 1 THEN 'sentences ' || (last + 1) || '-' || (n - 1) || ' are in no group' END AS error FROM cnt LEFT JOIN l USING (doc_id) LEFT JOIN hs USING (doc_id)"""))
def gap_strict_errors(spark, sf_dir):
    return gaps.strict_errors(groups_of(spark, sf_dir), counts_of(spark, sf_dir))


@query(with_sql(REPAIRED, "SELECT doc_id, gi, ri, array_to_string(label, '>') AS label, s, e FROM rp"))
def gap_repair(spark, sf_dir):
    return flat(repaired_of(spark, sf_dir))


@query(with_sql(HOLES, "SELECT doc_id, s, e, prev_gi, next_gi FROM holes"))
def gap_holes(spark, sf_dir):
    return gaps.holes(groups_of(spark, sf_dir), counts_of(spark, sf_dir))


@query(with_sql(HOLES, "SELECT doc_id, idx, gi FROM oo"))
def gap_ownership(spark, sf_dir):
    return gaps.ownership(groups_of(spark, sf_dir))


def resolved_of(spark: SparkSession, sf_dir: str) -> DataFrame:
    sentences = sentences_of(spark, sf_dir)
    return shared("resolved", lambda: gaps.resolve(groups_of(spark, sf_dir), counts_of(spark, sf_dir), sentences))


@query(with_sql(HOLES, "SELECT doc_id, idx, prev_gi, next_gi, owner FROM res"))
def gap_fastpath(spark, sf_dir):
    return resolved_of(spark, sf_dir)


_CONTEXT = [
    *HOLES,
    "pend AS (SELECT doc_id, idx, -1 AS side, prev_gi AS g FROM res WHERE owner IS NULL UNION ALL SELECT doc_id, idx, 1, next_gi FROM res WHERE owner IS NULL)",
    r"ot AS (SELECT oo.doc_id, oo.gi, oo.idx AS at_, text, oo.idx - row_number() OVER (PARTITION BY oo.doc_id, oo.gi ORDER BY oo.idx) AS run, regexp_matches(text, '^[\p{Cc}\p{Cf}\p{M}\p{Z}]*$') AS trash FROM oo JOIN sent USING (doc_id, idx))",
    "nr AS (SELECT p.doc_id, p.idx, p.side, at_, text, run, row_number() OVER w AS rank, first_value(run) OVER w AS first FROM pend p JOIN ot ON p.doc_id = ot.doc_id AND p.g = ot.gi AND (at_ - p.idx) * side > 0 AND NOT trash WINDOW w AS (PARTITION BY p.doc_id, p.idx, p.side ORDER BY abs(at_ - p.idx)))",
]


@query(with_sql(_CONTEXT, "SELECT doc_id, idx, side, string_agg(text, chr(10) ORDER BY at_) AS context FROM nr WHERE run = first AND rank <= 3 GROUP BY doc_id, idx, side"))
def gap_context(spark, sf_dir):
    sentences = sentences_of(spark, sf_dir)
    pending = resolved_of(spark, sf_dir).where("owner is null")
    return gaps.context(pending, gaps.ownership(groups_of(spark, sf_dir)), sentences)


_LLM_REPAIR = [
    *HOLES,
    "dec AS (SELECT *, CASE WHEN owner IS NULL THEN ['previous', 'next', 'new', 'unknown'][(doc_id + idx) % 4 + 1] END AS d FROM res)",
    "gc AS (SELECT doc_id, max(gi) + 1 AS k FROM grp GROUP BY doc_id)",
    "nw AS (SELECT doc_id, idx, CAST(k + row_number() OVER (PARTITION BY doc_id ORDER BY idx) - 1 AS INTEGER) AS gi FROM dec JOIN gc USING (doc_id) WHERE d = 'new')",
    "al AS (SELECT doc_id, idx, gi FROM oo UNION ALL SELECT doc_id, idx, gi FROM nw UNION ALL SELECT doc_id, idx, coalesce(owner, CASE WHEN d = 'next' THEN next_gi ELSE prev_gi END) FROM dec WHERE d IS NULL OR d <> 'new')",
    f"rr AS ({runs_sql('al', 'doc_id, gi')})",
    "lb AS (SELECT DISTINCT doc_id, gi, array_to_string(label, '>') AS label FROM grp UNION ALL SELECT doc_id, gi, 'Misc>T' FROM nw)",
]


@query(with_sql(_LLM_REPAIR, "SELECT doc_id, gi, ri, label, s, e FROM rr JOIN lb USING (doc_id, gi)"))
def gap_llm_repair(spark, sf_dir):
    sentences_of(spark, sf_dir)  # the counts come from these
    resolved = resolved_of(spark, sf_dir)
    answers = resolved.where("owner is null").select("doc_id", "idx", stub.gap_answer(F.col("doc_id"), F.col("idx")).alias("answer"))
    return flat(gaps.apply_answers(groups_of(spark, sf_dir), resolved, answers))


# --- refinement ----------------------------------------------------------------

_BOUNDARIES = [*OWNERS, "bd AS (SELECT * FROM (SELECT doc_id, idx, gi AS left_gi, lead(gi) OVER (PARTITION BY doc_id ORDER BY idx) AS right_gi FROM own) WHERE left_gi <> right_gi)"]


@query(with_sql(_BOUNDARIES, "SELECT doc_id, idx, left_gi, right_gi FROM bd"))
def boundary_candidates(spark, sf_dir):
    return refine.boundaries(refine.owners(repaired_of(spark, sf_dir)))


_SHORT = [
    *_BOUNDARIES,
    "sd AS (SELECT doc_id, idx, left_gi AS from_gi, right_gi AS to_gi, idx * 2 AS seq FROM bd UNION ALL SELECT doc_id, idx + 1, right_gi, left_gi, idx * 2 + 1 FROM bd)",
    "sc AS (SELECT sd.* FROM sd JOIN sent USING (doc_id, idx) WHERE length(text) < 40)",
]


@query(with_sql(_SHORT, "SELECT doc_id, idx, from_gi, to_gi, seq FROM sc"))
def short_sentence_candidates(spark, sf_dir):
    sentences = sentences_of(spark, sf_dir)
    return refine.short_candidates(refine.owners(repaired_of(spark, sf_dir)), sentences)


@query(with_sql([*_SHORT,
    "rd AS (SELECT sc.*, coalesce(b.gi = sc.to_gi, FALSE) AS tp, ['previous', 'next', NULL][CAST((sc.doc_id + seq) % 3 AS INTEGER) + 1] AS d FROM sc LEFT JOIN own b ON b.doc_id = sc.doc_id AND b.idx = sc.idx - 1)",
    "mv AS (SELECT doc_id, idx, arg_min(to_gi, seq) AS to_gi FROM rd WHERE (tp AND d = 'previous') OR (NOT tp AND d = 'next') GROUP BY doc_id, idx)",
    "no AS (SELECT doc_id, idx, coalesce(to_gi, gi) AS gi FROM own LEFT JOIN mv USING (doc_id, idx))",
    f"rr AS ({runs_sql('no', 'doc_id, gi')})",
    "lb AS (SELECT DISTINCT doc_id, gi, array_to_string(label, '>') AS label FROM rp)"], "SELECT doc_id, gi, ri, label, s, e FROM rr JOIN lb USING (doc_id, gi)"))
def short_sentence_reassign(spark, sf_dir):
    sentences = sentences_of(spark, sf_dir)
    groups = repaired_of(spark, sf_dir)
    asked = refine.short_candidates(refine.owners(groups), sentences)
    answer = F.element_at(F.array(F.lit("PREVIOUS"), F.lit("NEXT"), F.lit("?")), ((F.col("doc_id") + F.col("seq")) % 3 + 1).cast("int"))
    return flat(refine.apply_reassignments(groups, asked, asked.select("doc_id", "seq", answer.alias("answer"))))


@query(with_sql([*_BOUNDARIES,
    "rn AS (SELECT doc_id, gi, idx, text, idx - row_number() OVER (PARTITION BY doc_id, gi ORDER BY idx) AS run FROM own JOIN sent USING (doc_id, idx))",
    "lx AS (SELECT *, row_number() OVER (PARTITION BY doc_id, gi, run ORDER BY idx DESC) AS back, row_number() OVER (PARTITION BY doc_id, gi, run ORDER BY idx) AS fwd, max(idx) OVER (PARTITION BY doc_id, gi, run) AS hi, min(idx) OVER (PARTITION BY doc_id, gi, run) AS lo FROM rn)",
    "lt AS (SELECT doc_id, hi AS idx, string_agg(text, chr(10) ORDER BY lx.idx) AS left_text FROM lx WHERE back <= 3 GROUP BY doc_id, hi)",
    "rt AS (SELECT doc_id, lo - 1 AS idx, string_agg(text, chr(10) ORDER BY lx.idx) AS right_text FROM lx WHERE fwd <= 3 GROUP BY doc_id, lo)"], "SELECT doc_id, bd.idx, left_text, right_text FROM bd JOIN lt USING (doc_id, idx) JOIN rt USING (doc_id, idx)"))
def boundary_context(spark, sf_dir):
    sentences = sentences_of(spark, sf_dir)
    return refine.boundary_context(refine.owners(repaired_of(spark, sf_dir)), sentences)


@query()
def boundary_shifts(spark, sf_dir):
    groups = repaired_of(spark, sf_dir)
    asked = refine.boundaries(refine.owners(groups))
    return flat(refine.apply_shifts(groups, asked.select("doc_id", "idx", stub.shift_answer(F.col("doc_id"), F.col("idx")).alias("answer"))))


@query(with_sql([*REPAIRED,
    "rl AS (SELECT doc_id, gi * 1000 + ri AS gi, label[1:1] AS label, s, e FROM rp)",
    "en AS (SELECT doc_id, gi, any_value(label) AS label, min(s) AS lo, max(e) AS hi FROM rl GROUP BY doc_id, gi)",
    "e1 AS (SELECT *, CASE WHEN lag(label) OVER (PARTITION BY doc_id ORDER BY gi) = label THEN 0 ELSE 1 END AS nw FROM en)",
    "e2 AS (SELECT *, sum(nw) OVER (PARTITION BY doc_id ORDER BY gi) AS st FROM e1)",
    "e3 AS (SELECT *, CASE WHEN lo <= max(hi) OVER (PARTITION BY doc_id, st ORDER BY gi ROWS BETWEEN UNBOUNDED PRECEDING AND 1 PRECEDING) + 1 THEN 0 ELSE 1 END AS fresh FROM e2)",
    "e4 AS (SELECT doc_id, gi, label, CAST(sum(fresh) OVER (PARTITION BY doc_id ORDER BY gi) - 1 AS INTEGER) AS tg FROM e3)",
    "j1 AS (SELECT rl.doc_id, tg, e4.label, s, e, max(e) OVER (PARTITION BY rl.doc_id, tg ORDER BY s, e ROWS BETWEEN UNBOUNDED PRECEDING AND 1 PRECEDING) AS reach FROM rl JOIN e4 USING (doc_id, gi))",
    "j2 AS (SELECT *, sum(CASE WHEN s <= reach + 1 THEN 0 ELSE 1 END) OVER (PARTITION BY doc_id, tg ORDER BY s, e ROWS UNBOUNDED PRECEDING) AS isl FROM j1)"],
    "SELECT doc_id, tg AS gi, CAST(isl - 1 AS INTEGER) AS ri, array_to_string(any_value(label), '>') AS label, min(s) AS s, max(e) AS e FROM j2 GROUP BY doc_id, tg, isl"))
def adjacent_join(spark, sf_dir):
    """Every range as a group of its own, named by the first level of its label, so that there is something to join."""
    rows = repaired_of(spark, sf_dir).select("doc_id", (F.col("gi") * 1000 + F.col("ri")).alias("gi"), F.lit(0).alias("ri"), F.slice("label", 1, 1).alias("label"), "s", "e")
    return flat(refine.join_adjacent(rows))


@query(with_sql([*REPAIRED, "ps AS (SELECT rp.doc_id, gi, rp.s, rp.e, idx, start_, end_, text FROM (SELECT doc_id, gi, s, e, unnest(range(s, e + 1)) AS idx FROM rp) rp JOIN sent USING (doc_id, idx))", "pj AS (SELECT doc_id, gi, s, e, min(start_) AS a, max(end_) AS z, trim(string_agg(text, ' ' ORDER BY idx)) AS text FROM ps GROUP BY doc_id, gi, s, e)"], 'SELECT doc_id, CAST(row_number() OVER (PARTITION BY doc_id ORDER BY gi, s, e) - 1 AS INTEGER) AS idx, gi, a AS start, z AS "end", text FROM pj'))
def sentence_join(spark, sf_dir):
    sentences = sentences_of(spark, sf_dir)
    return refine.join_sentences(repaired_of(spark, sf_dir), sentences)


@query(with_sql([*LINES,
    f"ml AS (SELECT doc_id, CAST(line - 1 AS INTEGER) AS gi, {LABEL} AS label, (line - 1) * 3 AS s, (line - 1) * 3 + line % 4 AS e FROM ln)",
    f"mk AS (SELECT *, {KEY.format('label')} AS key FROM ml)",
    "mn AS (SELECT doc_id, key, arg_min(label, gi) AS label, min(s) AS first, min(gi) AS old FROM mk GROUP BY doc_id, key)",
    "mg AS (SELECT *, CAST(row_number() OVER (PARTITION BY doc_id ORDER BY first, old) - 1 AS INTEGER) AS gi FROM mn)",
    "m1 AS (SELECT doc_id, key, s, e, max(e) OVER (PARTITION BY doc_id, key ORDER BY s, e ROWS BETWEEN UNBOUNDED PRECEDING AND 1 PRECEDING) AS reach FROM mk)",
    "m2 AS (SELECT *, sum(CASE WHEN s <= reach + 1 THEN 0 ELSE 1 END) OVER (PARTITION BY doc_id, key ORDER BY s, e ROWS UNBOUNDED PRECEDING) AS isl FROM m1)",
    "m3 AS (SELECT doc_id, key, CAST(isl - 1 AS INTEGER) AS ri, min(s) AS s, max(e) AS e FROM m2 GROUP BY doc_id, key, isl)"],
    "SELECT doc_id, gi, ri, array_to_string(label, '>') AS label, s, e FROM m3 JOIN mg USING (doc_id, key)"))
def similar_topic_merge(spark, sf_dir):
    """Every answer line as a group of its own: labels that differ only by spelling come together."""
    rows = parsing._labelled_lines(stub.with_topic_response(counts_of(spark, sf_dir)))
    line = F.col("line").cast("long")
    return flat(refine.merge_similar(rows.select("doc_id", F.col("line").cast("int").alias("gi"), F.lit(0).alias("ri"), fx.label_parts(F.col("name")).alias("label"), (line * 3).alias("s"), (line * 3 + (line + 1) % 4).alias("e"))))


# --- cleaning ------------------------------------------------------------------

_HTML = [
    r"""h1 AS (SELECT doc_id, unnest(l) AS tok, generate_subscripts(l, 1) AS pos FROM (SELECT page_id AS doc_id, regexp_extract_all(html, '(?is)<script\b[^>]*>.*?</script\s*>|<style\b[^>]*>.*?</style\s*>|<(?:[^>"'']|"[^"]*"|''[^'']*'')*>|[^<]+|<') AS l FROM pages))""",
    r"h2 AS (SELECT *, sum(length(tok)) OVER (PARTITION BY doc_id ORDER BY pos) - length(tok) AS a, NOT (tok LIKE '<%' AND length(tok) > 1) AS keep FROM h1)",
    "h3 AS (SELECT *, sum(CASE WHEN keep IS DISTINCT FROM prv THEN 1 ELSE 0 END) OVER (PARTITION BY doc_id ORDER BY pos) AS isl FROM (SELECT *, lag(keep) OVER (PARTITION BY doc_id ORDER BY pos) AS prv FROM h2))",
    "h4 AS (SELECT doc_id, min(a) AS a, max(a + length(tok)) AS b, string_agg(tok, '' ORDER BY pos) AS txt FROM h3 WHERE keep GROUP BY doc_id, isl)",
    rf"h5 AS (SELECT *, CASE WHEN lag(txt) OVER w IS NOT NULL AND NOT regexp_matches(lag(txt) OVER w, '[{W}]$') AND NOT regexp_matches(txt, '^[{W}]') THEN 1 ELSE 0 END AS sep, lag(b) OVER w AS pb FROM h4 WINDOW w AS (PARTITION BY doc_id ORDER BY a))",
    "h6 AS (SELECT *, sum(b - a + sep) OVER (PARTITION BY doc_id ORDER BY a) - (b - a) AS c FROM h5)",
    "seg AS (SELECT doc_id, CAST(c AS INTEGER) AS clean_offset, CAST(a AS INTEGER) AS original_offset, CAST(b - a AS INTEGER) AS length FROM h6 UNION ALL SELECT doc_id, CAST(c - 1 AS INTEGER), CAST(pb AS INTEGER), 1 FROM h6 WHERE sep = 1)",
    "cl AS (SELECT doc_id, string_agg(CASE WHEN sep = 1 THEN ' ' ELSE '' END || txt, '' ORDER BY a) AS text FROM h6 GROUP BY doc_id)",
]


@query(with_sql(_HTML, "SELECT page_id AS doc_id, coalesce(text, '') AS text, CAST(length(html) AS INTEGER) AS original_length, CAST(length(coalesce(text, '')) AS INTEGER) AS clean_length FROM pages LEFT JOIN cl ON cl.doc_id = page_id"))
def html_strip_regex(spark, sf_dir):
    return cleaning.clean_table(pages_of(spark, sf_dir)).drop("segments")


@query(with_sql(_HTML, "SELECT doc_id, clean_offset, original_offset, length FROM seg"))
def html_segments(spark, sf_dir):
    return cleaning.clean_table(pages_of(spark, sf_dir)).select("doc_id", F.explode("segments").alias("g")).select("doc_id", "g.*")


@query(with_sql([*_HTML, "qs AS (SELECT doc_id, unnest(range(0, length(text) + 1)) AS pos FROM cl)", "k AS (SELECT page_id AS doc_id, length(html) AS ol FROM pages)"], """SELECT q.doc_id, CAST(q.pos AS INTEGER) AS clean, CAST(CASE WHEN q.pos = length(cl.text) THEN ol ELSE q.pos + original_offset - clean_offset END AS INTEGER) AS original
FROM qs q ASOF JOIN seg ON q.doc_id = seg.doc_id AND q.pos >= seg.clean_offset JOIN cl ON cl.doc_id = q.doc_id JOIN k ON k.doc_id = q.doc_id"""))
def offset_restore(spark, sf_dir):
    cleaned = shared("cleaned", lambda: cleaning.clean_table(pages_of(spark, sf_dir)))
    n = F.col("clean_length")
    spots = cleaned.where("size(segments) > 0").select("doc_id", F.explode(F.sequence(F.lit(0), n)).alias("clean")).withColumn("original", F.col("clean"))
    return cleaning.restore(spots, cleaned, "original")


@query()
def html_strip_parser(spark, sf_dir):
    return cleaning.clean_table(pages_of(spark, sf_dir), parser=True).drop("segments")


# --- keywords ------------------------------------------------------------------

def _offset(upto: str) -> str:
    """Code points before a word, from the tokens (words and white space by turns) before it."""
    return f"CAST(coalesce(list_sum(list_transform(l[1:{upto}], lambda x: length(x))), 0) AS INTEGER)"


_SPANS = [
    *_KEYWORDS,
    rf"kt AS (SELECT doc_id, l, CASE WHEN regexp_matches(l[1], '^[{W}]') THEN 1 ELSE 0 END AS ws FROM (SELECT doc_id, regexp_extract_all(text, '[{W}]+|[^{W}]+') AS l FROM documents))",
    f"ks AS (SELECT doc_id, s, e, {_offset('2 * s + ws')} AS a, {_offset('2 * e + ws + 1')} AS z FROM kx JOIN kt USING (doc_id))",
]


def keyword_spans_of(spark: SparkSession, sf_dir: str) -> DataFrame:
    return shared("spans", lambda: keywords.build(keyword_ranges_of(spark, sf_dir), docs_of(spark, sf_dir)))


@query(with_sql(_SPANS, 'SELECT doc_id, a AS start, z AS "end", substr(text, a + 1, z - a) AS text FROM ks JOIN documents USING (doc_id)'))
def keyword_spans(spark, sf_dir):
    return keyword_spans_of(spark, sf_dir)


_FREE = [*_SPANS, "fw AS (SELECT w.doc_id, w.idx FROM (SELECT doc_id, unnest(range(0, n)) AS idx FROM kn) w LEFT JOIN kx USING (doc_id) GROUP BY w.doc_id, w.idx HAVING NOT coalesce(bool_or(w.idx BETWEEN s AND e), FALSE))"]


@query(with_sql([*_FREE, f"fr AS ({runs_sql('fw', 'doc_id')})"], "SELECT doc_id, ri, CAST(s AS INTEGER) AS s, CAST(e AS INTEGER) AS e FROM fr WHERE e - s + 1 >= 20"))
def keyword_gaps(spark, sf_dir):
    return keywords.gaps(docs_of(spark, sf_dir), keyword_spans_of(spark, sf_dir), 20).select("doc_id", "ri", "s", "e")


@query(with_sql([*_FREE, f"fr AS ({runs_sql('fw', 'doc_id')})", f"nk AS (SELECT doc_id, {_offset('2 * s + ws')} AS a, {_offset('2 * s + ws + 1')} AS z FROM fr JOIN kt USING (doc_id) WHERE e - s + 1 >= 20)", "al AS (SELECT doc_id, a, z FROM ks UNION ALL SELECT doc_id, a, z FROM nk)"], 'SELECT doc_id, a AS start, z AS "end", substr(text, a + 1, z - a) AS text FROM al JOIN documents USING (doc_id)'))
def keyword_merge(spark, sf_dir):
    """The first word of every long gap becomes a keyword."""
    old = keyword_spans_of(spark, sf_dir)
    return keywords.merge(old, keywords.first_words(keywords.gaps(docs_of(spark, sf_dir), old, 20)))


_ESC = "replace(replace(replace(replace(replace({}, '&', '&amp;'), '<', '&lt;'), '>', '&gt;'), '\"', '&quot;'), '''', '&#x27;')"


@query(with_sql([*_SPANS,
    "g1 AS (SELECT *, max(z) OVER (PARTITION BY doc_id ORDER BY a, z ROWS BETWEEN UNBOUNDED PRECEDING AND 1 PRECEDING) AS reach FROM ks)",
    "g2 AS (SELECT *, sum(CASE WHEN a < reach THEN 0 ELSE 1 END) OVER (PARTITION BY doc_id ORDER BY a, z ROWS UNBOUNDED PRECEDING) AS run FROM g1)",
    "g3 AS (SELECT doc_id, min(a) AS a, max(z) AS z FROM g2 GROUP BY doc_id, run)",
    "g4 AS (SELECT *, coalesce(lag(z) OVER (PARTITION BY doc_id ORDER BY a), 0) AS b FROM g3)",
    f"g5 AS (SELECT doc_id, max(z) AS last, string_agg({_ESC.format('substr(text, b + 1, a - b)')} || '<mark>' || {_ESC.format('substr(text, a + 1, z - a)')} || '</mark>', '' ORDER BY a) AS h FROM g4 JOIN documents USING (doc_id) GROUP BY doc_id)"],
    f"SELECT doc_id, coalesce(h, '') || {_ESC.format('substr(text, coalesce(last, 0) + 1)')} AS html FROM documents LEFT JOIN g5 USING (doc_id)"))
def keyword_highlight(spark, sf_dir):
    return keywords.highlight(docs_of(spark, sf_dir), keyword_spans_of(spark, sf_dir))


# --- decisions -----------------------------------------------------------------


@query(with_sql(SENTENCES, r"""SELECT s.doc_id, idx + 1 AS id, CASE WHEN length(s.text) <= 2000 THEN s.text ELSE substr(s.text, 1, 1000) || '…' || right(s.text, 999) END AS text,
coalesce(regexp_matches(substr(d.text, lag(end_) OVER w + 1, start_ - lag(end_) OVER w), '\n\s*\n'), FALSE) AS paragraph_break_before FROM sent s JOIN documents d USING (doc_id) WINDOW w AS (PARTITION BY s.doc_id ORDER BY idx)"""))
def decision_content(spark, sf_dir):
    return decisions.content(docs_of(spark, sf_dir), sentences_of(spark, sf_dir))


@query(with_sql([*COUNTS, "bt AS (SELECT doc_id, n, unnest(range(0, (n - 2) // 8 + 1)) AS batch FROM cnt WHERE n > 1)"], """SELECT doc_id, CAST(batch AS INTEGER) AS batch, batch * 8 + 2 AS first_gap, least(batch * 8 + 9, n) AS last_gap, greatest(batch * 8 - 1, 1) AS first_id, least(least(batch * 8 + 9, n) + 2, n) AS last_id FROM bt"""))
def decision_batches(spark, sf_dir):
    return decisions.batches(counts_of(spark, sf_dir))


_BODIES = [*_SECTIONS, rf"bo AS (SELECT doc_id, ri, {_squeezed('string_agg(text, chr(32) ORDER BY idx)')} AS t FROM (SELECT doc_id, ri, unnest(range(s, e + 1)) AS idx FROM sec) JOIN sent USING (doc_id, idx) GROUP BY doc_id, ri)",
    "bf AS (SELECT doc_id, ri, CASE WHEN length(t) <= 1500 THEN t ELSE substr(t, 1, 750) || '…' || right(t, 749) END AS body FROM bo)"]


@query(with_sql(_BODIES, "SELECT doc_id, ri, body FROM bf"))
def section_bodies(spark, sf_dir):
    sentences = sentences_of(spark, sf_dir)
    return decisions.bodies(sections_of(spark, sf_dir), sentences)


@query(with_sql([*_BODIES,
    "lc AS (SELECT doc_id, ri, length(body) + 8 AS k FROM bf)",
    "lp AS (WITH RECURSIVE go AS (SELECT doc_id, ri, 0 AS batch, 1 AS number, k AS chars FROM lc WHERE ri = 0 UNION ALL SELECT c.doc_id, c.ri, CASE WHEN number >= 60 OR chars + c.k > 9000 THEN batch + 1 ELSE batch END, CASE WHEN number >= 60 OR chars + c.k > 9000 THEN 1 ELSE number + 1 END, CASE WHEN number >= 60 OR chars + c.k > 9000 THEN c.k ELSE chars + c.k END FROM go JOIN lc c ON c.doc_id = go.doc_id AND c.ri = go.ri + 1) SELECT * FROM go)"],
    "SELECT doc_id, ri, CAST(batch AS INTEGER) AS batch, CAST(number AS INTEGER) AS number FROM lp"))
def label_batches(spark, sf_dir):
    """Whole bodies packed into requests of 9000 characters and 60 sections at most; both limits are reached."""
    sentences = sentences_of(spark, sf_dir)
    return decisions.label_batches(decisions.bodies(sections_of(spark, sf_dir), sentences), 9000)


@query(with_sql(_SECTIONS, "SELECT doc_id, string_agg('Topic>Section ' || (ri % 3) || ': ' || s || '-' || e, chr(10) ORDER BY ri) AS response FROM sec GROUP BY doc_id"))
def decision_topic_lines(spark, sf_dir):
    parts = sections_of(spark, sf_dir)
    label = F.array(F.lit("Topic"), F.concat(F.lit("Section "), (F.col("ri") % 3).cast("string")))
    return decisions.topic_lines(parts, parts.select("doc_id", "ri", label.alias("label")))


# --- metrics -------------------------------------------------------------------

_POS = [*GROUPS, "ps AS (SELECT DISTINCT doc_id, array_to_string(label, '>') AS topic, unnest(range(s, e + 1)) AS idx FROM grp)"]


@query(with_sql(GROUPS, "SELECT doc_id, gi, ri, s >= 0 AND s <= e AND e < n AS valid, CAST(CASE WHEN s >= 0 AND s <= e AND e < n THEN e - s + 1 ELSE 0 END AS BIGINT) AS size FROM grp JOIN cnt USING (doc_id)"))
def metrics_ranges(spark, sf_dir):
    return metrics.range_sizes(groups_of(spark, sf_dir), counts_of(spark, sf_dir))


@query(with_sql([*_POS, "sz AS (SELECT doc_id, topic, count(*) AS k, sum(length(text)) AS c FROM ps JOIN sent USING (doc_id, idx) GROUP BY doc_id, topic)", "rg AS (SELECT doc_id, array_to_string(label, '>') AS topic, count(*) AS r FROM grp GROUP BY ALL)"], "SELECT doc_id, topic, CAST(k AS BIGINT) AS n_sentences, CAST(r AS BIGINT) AS n_ranges, CAST(c AS BIGINT) AS clean_chars FROM rg JOIN sz USING (doc_id, topic)"))
def metrics_topics(spark, sf_dir):
    sentences = sentences_of(spark, sf_dir)
    return metrics.topics(groups_of(spark, sf_dir), counts_of(spark, sf_dir), sentences)


@query(with_sql([*_POS, "cv AS (SELECT doc_id, count(*) AS c, sum(CASE WHEN k > 1 THEN 1 ELSE 0 END) AS m FROM (SELECT doc_id, idx, count(*) AS k FROM ps GROUP BY doc_id, idx) GROUP BY doc_id)"], "SELECT doc_id, n, CAST(coalesce(c, 0) AS BIGINT) AS n_covered, CAST(n - coalesce(c, 0) AS BIGINT) AS n_uncovered, CAST(coalesce(m, 0) AS BIGINT) AS n_multiple, CASE WHEN n > 0 THEN coalesce(c, 0) / n ELSE 0 END AS coverage FROM cnt LEFT JOIN cv USING (doc_id)"))
def metrics_coverage(spark, sf_dir):
    return metrics.coverage(groups_of(spark, sf_dir), counts_of(spark, sf_dir))


@query(with_sql([*GROUPS, "lb AS (SELECT DISTINCT doc_id, label FROM grp)", "st AS (SELECT doc_id, label, unnest(range(0, len(label) + 1)) AS k FROM lb)"], "SELECT doc_id, coalesce(array_to_string(list_slice(label, 1, k), '>'), '') AS path, count(DISTINCT label[k + 1]) AS n_children FROM st GROUP BY ALL"))
def metrics_hierarchy(spark, sf_dir):
    return metrics.hierarchy(groups_of(spark, sf_dir))


@query(with_sql([*GROUPS, "tn AS (SELECT doc_id, n, unnest(range(0, 10)) AS bin FROM cnt)"], "SELECT t.doc_id, CAST(bin AS INTEGER) AS bin, count(DISTINCT array_to_string(label, '>')) AS n_topics FROM tn t LEFT JOIN grp g ON g.doc_id = t.doc_id AND g.s < (bin + 1) * n // 10 AND g.e >= bin * n // 10 GROUP BY t.doc_id, bin"))
def metrics_bins(spark, sf_dir):
    return metrics.bins(groups_of(spark, sf_dir), counts_of(spark, sf_dir))


@query(with_sql([*_POS, "sz AS (SELECT doc_id, topic, count(*) AS k FROM ps GROUP BY doc_id, topic)"], "SELECT doc_id, count(k) AS n, min(k) AS min, max(k) AS max, avg(k) AS mean, median(k) AS median FROM sz GROUP BY doc_id"))
def metrics_summary(spark, sf_dir):
    sizes = metrics.positions(groups_of(spark, sf_dir), counts_of(spark, sf_dir)).groupBy("doc_id", "topic").agg(F.count("*").alias("k"))
    return metrics.summary(sizes, "k", "doc_id")


@query(with_sql([*_POS, "sz AS (SELECT doc_id, avg(CASE WHEN k = 1 THEN 1.0::DOUBLE ELSE 0 END) AS t FROM (SELECT doc_id, topic, count(*) AS k FROM ps GROUP BY doc_id, topic) GROUP BY doc_id)", "rg AS (SELECT doc_id, avg(CASE WHEN e = s THEN 1.0::DOUBLE ELSE 0 END) AS r FROM grp GROUP BY doc_id)"], "SELECT doc_id, coalesce(t, 0) AS singleton_topics, coalesce(r, 0) AS singleton_ranges FROM cnt LEFT JOIN sz USING (doc_id) LEFT JOIN rg USING (doc_id)"))
def metrics_singletons(spark, sf_dir):
    return metrics.singletons(groups_of(spark, sf_dir), counts_of(spark, sf_dir))


# --- runs and calls --------------------------------------------------------------

_RUNS = "rn AS (SELECT event_type AS label, user_id % 50 AS document_id, CASE WHEN event_id % 11 = 0 THEN 'error' ELSE 'ok' END AS status, value AS elapsed_seconds, event_id % 1000 + 100 AS input_chars FROM events)"


def runs_of(spark: SparkSession, sf_dir: str) -> DataFrame:
    e = spark.read.parquet(f"{sf_dir}/events.parquet")
    return e.select(
        F.col("event_type").alias("label"), (F.col("user_id") % 50).alias("document_id"), F.when(F.col("event_id") % 11 == 0, "error").otherwise("ok").alias("status"),
        F.col("value").alias("elapsed_seconds"), (F.col("event_id") % 1000 + 100).alias("input_chars"),
    )


@query(with_sql([_RUNS], """SELECT label, count(*) AS n_runs, CAST(sum(CASE WHEN status = 'ok' THEN 0 ELSE 1 END) AS BIGINT) AS n_failed, sum(CASE WHEN status = 'ok' THEN 0 ELSE 1 END) / count(*) AS failure_rate,
quantile_cont(elapsed_seconds, 0.5) FILTER (status = 'ok') AS p50, round(quantile_cont(elapsed_seconds, 0.95) FILTER (status = 'ok'), 6) AS p95, round(stddev_pop(elapsed_seconds) FILTER (status = 'ok'), 6) AS pstdev FROM rn GROUP BY label"""))
def latency_stats(spark, sf_dir):
    return metrics.latency(runs_of(spark, sf_dir), "label").withColumns({"pstdev": F.round("pstdev", 6), "p95": F.round("p95", 6)})


@query(with_sql([_RUNS], "SELECT document_id, quantile_cont(input_chars / elapsed_seconds, 0.5) AS chars_per_second FROM rn WHERE status = 'ok' AND elapsed_seconds > 0 GROUP BY document_id"))
def throughput(spark, sf_dir):
    return metrics.throughput(runs_of(spark, sf_dir), "document_id")


@query(with_sql([_RUNS], "SELECT label AS namespace, count(*) AS n_calls, round(sum(elapsed_seconds), 4) AS elapsed_seconds, CAST(sum(CASE WHEN status = 'ok' THEN 0 ELSE 1 END) AS BIGINT) AS n_failures FROM rn GROUP BY ROLLUP (label)"))
def namespace_rollup(spark, sf_dir):
    return metrics.namespace_totals(runs_of(spark, sf_dir).withColumnRenamed("label", "namespace")).withColumn("elapsed_seconds", F.round("elapsed_seconds", 4))


@query("""WITH a AS (SELECT doc_id AS id, sha256(text) AS sha256 FROM documents), b AS (SELECT doc_id AS id, sha256(CASE WHEN doc_id % 10 = 3 THEN text || '!' ELSE text END) AS sha256 FROM documents WHERE doc_id % 17 <> 0)
SELECT *, 'left' AS side FROM (SELECT * FROM a EXCEPT ALL SELECT * FROM b) UNION ALL SELECT *, 'right' FROM (SELECT * FROM b EXCEPT ALL SELECT * FROM a)""")
def corpus_mismatch(spark, sf_dir):
    d = docs_of(spark, sf_dir).withColumnRenamed("doc_id", "id")
    changed = F.when(F.col("id") % 10 == 3, F.concat("text", F.lit("!"))).otherwise(F.col("text"))
    return metrics.corpus_mismatch(d.select("id", F.sha2("text", 256).alias("sha256")), d.where("id % 17 <> 0").select("id", F.sha2(changed, 256).alias("sha256")))


@query(with_sql([_RUNS, "fs AS (SELECT document_id, min(rowid_) AS seen FROM (SELECT user_id % 50 AS document_id, event_id AS rowid_ FROM events) GROUP BY document_id)"], """SELECT r.document_id, CAST(row_number() OVER (ORDER BY any_value(seen)) - 1 AS INTEGER) AS place, map_from_entries(list((label, m) ORDER BY label)) AS medians FROM (SELECT document_id, label, round(quantile_cont(elapsed_seconds, 0.5), 6) AS m FROM rn WHERE status = 'ok' GROUP BY document_id, label) r JOIN fs USING (document_id) GROUP BY r.document_id""").replace("map_from_entries(list((label, m) ORDER BY label))", "string_agg(label || '=' || CAST(m AS DECIMAL(18, 6)), ',' ORDER BY label)"))
def compare_runs(spark, sf_dir):
    """Every run label's median for each document, documents in the order in which they are first seen."""
    e = spark.read.parquet(f"{sf_dir}/events.parquet").select((F.col("user_id") % 50).alias("document_id"), F.col("event_id").alias("seen"))
    out = metrics.compare(runs_of(spark, sf_dir), e)
    shown = F.transform("medians", lambda x: F.concat(x["label"], F.lit("="), F.round(x["median"], 6).cast("decimal(18,6)").cast("string")))
    return out.select("document_id", "place", F.array_join(shown, ",").alias("medians"))


# --- pipelines and cache ---------------------------------------------------------


def _merged(source: str) -> list[str]:
    return [
        f"mk AS (SELECT *, {KEY.format('label')} AS key FROM {source})",
        "mn AS (SELECT doc_id, key, arg_min(label, gi) AS label, min(s) AS first, min(gi) AS old FROM mk GROUP BY doc_id, key)",
        "mg AS (SELECT *, CAST(row_number() OVER (PARTITION BY doc_id ORDER BY first, old) - 1 AS INTEGER) AS gi FROM mn)",
        "m1 AS (SELECT doc_id, key, s, e, max(e) OVER (PARTITION BY doc_id, key ORDER BY s, e ROWS BETWEEN UNBOUNDED PRECEDING AND 1 PRECEDING) AS reach FROM mk)",
        "m2 AS (SELECT *, sum(CASE WHEN s <= reach + 1 THEN 0 ELSE 1 END) OVER (PARTITION BY doc_id, key ORDER BY s, e ROWS UNBOUNDED PRECEDING) AS isl FROM m1)",
        "m3 AS (SELECT doc_id, key, CAST(isl - 1 AS INTEGER) AS ri, min(s) AS s, max(e) AS e FROM m2 GROUP BY doc_id, key, isl)",
    ]


@query(with_sql([*REPAIRED, *_merged("rp")], "SELECT doc_id, gi, ri, array_to_string(label, '>') AS label, s, e FROM m3 JOIN mg USING (doc_id, key)"))
def topic_pipeline(spark, sf_dir):
    return flat(pipelines.topic_pipeline(docs_of(spark, sf_dir)))


@query(with_sql(INSIGHTS, "SELECT doc_id, gi, ri, name, s, e FROM grp"))
def insight_pipeline(spark, sf_dir):
    return pipelines.insight_pipeline(docs_of(spark, sf_dir))


@query(with_sql(_SECTIONS, "SELECT doc_id, CAST(ri % 3 AS INTEGER) AS gi, CAST(row_number() OVER (PARTITION BY doc_id, ri % 3 ORDER BY ri) - 1 AS INTEGER) AS ri, 'Topic>Section ' || (ri % 3) AS label, CAST(s AS BIGINT) AS s, CAST(e AS BIGINT) AS e FROM sec"))
def decision_pipeline(spark, sf_dir):
    return flat(pipelines.decision_pipeline(docs_of(spark, sf_dir)))


@query(ORACLE_SQL["keyword_merge"])
def keyword_pipeline(spark, sf_dir):
    return pipelines.keyword_pipeline(docs_of(spark, sf_dir), keyword_ranges_of(spark, sf_dir))


_KEYED = """ck AS (SELECT conv_id, turn, sha256('{"model_id":"m","namespace":' || to_json(role) || ',"prompt":' || coalesce(to_json(text), 'null') || ',"prompt_version":null,"temperature":0.0,"version":1}') AS key FROM conversations)"""


@query(with_sql([_KEYED], "SELECT conv_id, turn, key FROM ck"))
def cache_keys(spark, sf_dir):
    return _keyed(spark, sf_dir).select("conv_id", "turn", "key")


def _keyed(spark: SparkSession, sf_dir: str) -> DataFrame:
    c = spark.read.parquet(f"{sf_dir}/conversations.parquet")
    return c.withColumn("key", rounds.cache_key(F.col("role"), F.lit("m"), F.lit(None).cast("string"), F.col("text"), F.lit(0.0)))


@query(with_sql([_KEYED], "SELECT DISTINCT key FROM ck WHERE key NOT IN (SELECT key FROM ck WHERE conv_id % 3 = 0)"))
def cache_lookup(spark, sf_dir):
    """Requests that a cache filled by a third of the conversations doesn't answer."""
    rows = _keyed(spark, sf_dir)
    cache = rows.where("conv_id % 3 = 0").select("key", F.col("text").alias("response"), F.lit(None).cast("string").alias("error"), F.col("turn").cast("double").alias("created_at"))
    return rounds.lookup(rows, cache)[1].select("key")


@query(with_sql([_KEYED], "SELECT key, max(conv_id * 1000 + turn) AS created_at FROM ck GROUP BY key"))
def cache_upsert(spark, sf_dir):
    rows = _keyed(spark, sf_dir).select("key", F.col("text").alias("response"), (F.col("conv_id") * 1000 + F.col("turn")).alias("created_at"))
    return rounds.upserted(rows).select("key", "created_at")


# --- sessions ------------------------------------------------------------------


def _stubbed(counts: DataFrame) -> Callable[[DataFrame], DataFrame]:
    """Answers of the stand-in to every kind of request."""

    def answer(requests: DataFrame) -> DataFrame:
        rows = requests.join(counts, "doc_id")
        topic = F.when(F.col("seq") == 0, stub.topic_response(F.col("doc_id"), F.col("n")))
        pick = F.element_at(F.array(F.lit("PREVIOUS"), F.lit("NEXT"), F.lit("?")), ((F.col("doc_id") + F.col("seq")) % 3 + 1).cast("int"))
        answers = {"topic-range": topic, "insight": topic, "gap": stub.gap_answer(F.col("doc_id"), F.col("seq")), "reassign": pick, "boundary": stub.shift_answer(F.col("doc_id"), F.col("seq"))}
        content = F.coalesce(*[F.when(F.col("namespace") == k, v) for k, v in answers.items()])
        return rows.select("doc_id", "seq", content.alias("content"))

    return answer


@query(with_sql([*_LLM_REPAIR, "gl AS (SELECT doc_id, gi, ri, string_split(label, '>') AS label, s, e FROM rr JOIN lb USING (doc_id, gi))", *_merged("gl")], "SELECT doc_id, gi, ri, array_to_string(label, '>') AS label, s, e FROM m3 JOIN mg USING (doc_id, key)"))
def segment_session(spark, sf_dir):
    """Topics by a session of two rounds: ranges, then the owners of what they leave out."""
    docs = docs_of(spark, sf_dir)
    counts = shared("counts", lambda: tokens.sentence_counts(docs))
    return flat(sessions.drive(sessions.segmented(docs, gap="ask", most=1 << 30, decode=False), _stubbed(counts)).groups)


@query(ORACLE_SQL["gap_repair"])
def prepare_finalize(spark, sf_dir):
    """Requests prepared and answered apart from the rest."""
    docs, path = docs_of(spark, sf_dir), scratch(spark, "prepared")
    requests = sessions.prepare(docs, path, most=1 << 30)
    return flat(sessions.finalize(spark, path, _stubbed(spark.read.parquet(f"{path}/counts"))(requests), decode=False).groups)


@query(INSIGHTS and ORACLE_SQL["insight_pipeline"])
def insight_session(spark, sf_dir):
    docs = docs_of(spark, sf_dir)
    counts = shared("counts", lambda: tokens.sentence_counts(docs))
    return sessions.drive(sessions.insights(docs, most=1 << 30), _stubbed(counts)).groups


@query(ORACLE_SQL["keyword_merge"])
def keyword_session(spark, sf_dir):
    """Keywords by two rounds; the second asks about long gaps, of which the stand-in names the first word."""
    docs = docs_of(spark, sf_dir)
    n = shared("n", lambda: tokens.mark_words(docs).select("doc_id", F.col("n_items").alias("n")))
    rounds_seen = []

    def answer(requests: DataFrame) -> DataFrame:
        rounds_seen.append(1)
        content = stub.keyword_response(F.col("n")) if len(rounds_seen) == 1 else F.lit("0")
        return requests.join(n, "doc_id").select("doc_id", "seq", content.alias("content"))

    return sessions.drive(sessions.keyworded(docs, most=1 << 30), answer).groups


@query(with_sql(_SECTIONS, "SELECT doc_id, ri, 'Topic>Section ' || (number - 1) % 3 AS label FROM (SELECT doc_id, ri, row_number() OVER (PARTITION BY doc_id ORDER BY ri) AS number FROM sec) WHERE number % 4 <> 0 UNION ALL SELECT doc_id, ri, 'Topic>Section ' || (again - 1) % 3 FROM (SELECT doc_id, ri, row_number() OVER (PARTITION BY doc_id ORDER BY ri) AS again FROM (SELECT doc_id, ri, row_number() OVER (PARTITION BY doc_id ORDER BY ri) AS number FROM sec) WHERE number % 4 = 0) WHERE again % 4 <> 0"))
def label_session(spark, sf_dir):
    """Labels in two rounds: the stand-in leaves out every fourth section of a request, and the second round asks about those."""
    sentences = sentences_of(spark, sf_dir)
    bodies = decisions.bodies(sections_of(spark, sf_dir), sentences, 100)

    def answer(requests: DataFrame) -> DataFrame:
        numbers = F.regexp_extract_all("prompt", F.lit(r"(?m)^\[([0-9]+)\] "), F.lit(1))
        line = lambda k: F.concat(k, F.lit(": Topic>Section "), ((k.cast("int") - 1) % 3).cast("string"))
        return requests.select("doc_id", "seq", F.array_join(F.transform(F.filter(numbers, lambda k: k.cast("int") % 4 != 0), line), "\n").alias("content"))

    return flat(sessions.drive(sessions.labelled(bodies, 1, 1 << 30, 1 << 30), answer).groups)
