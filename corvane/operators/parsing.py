"""Parsers of model answers: strings to rows, all in built-in expressions."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from corvane.functions.text import LINE_BREAK, WS, decode_entities, label_key, label_parts, name_key, squeeze, strip
from corvane.operators.ranges import clamp, coalesce, shuffled

_LINE = rf"^(.+):[{WS}]*([0-9][0-9{WS},\-]*)[{WS}]*$"
UNCATEGORISED = "Uncategorized"


def lines(responses: DataFrame) -> DataFrame:
    """Non-blank stripped lines of ``response``, numbered."""
    out = responses.withColumns({"__lines": F.split("response", LINE_BREAK)}).select("*", F.posexplode("__lines").alias("line", "raw")).drop("__lines")
    return out.withColumn("raw", strip(F.col("raw"))).where("raw <> ''")


def range_parts(text: Column) -> Column:
    """Array of struct<s, e>: a-b or a leading integer of every comma-separated part; other parts are left out."""

    def one(part: Column) -> Column:
        p = strip(part)
        a, b = F.regexp_extract(p, rf"^([0-9]+)[{WS}]*-[{WS}]*([0-9]+)", 1), F.regexp_extract(p, rf"^([0-9]+)[{WS}]*-[{WS}]*([0-9]+)", 2)
        single = F.regexp_extract(p, r"^([0-9]+)", 1)
        s = F.when(a != "", a).otherwise(single).try_cast("long")
        e = F.when(a != "", b).otherwise(single).try_cast("long")
        return F.struct(s.alias("s"), e.alias("e"))

    return F.filter(F.transform(F.split(text, ","), one), lambda x: x["s"].isNotNull() & x["e"].isNotNull())


def _labelled_lines(responses: DataFrame) -> DataFrame:
    """doc_id, n, line, name, ranges of the lines with a colon."""
    rows = lines(responses.select("doc_id", "n", "response")).where(F.col("raw").contains(":"))
    name, spans = F.regexp_extract("raw", _LINE, 1), F.regexp_extract("raw", _LINE, 2)
    first = F.expr("instr(raw, ':')")
    return rows.select(
        "doc_id", "n", "line", F.when(name != "", name).otherwise(F.expr("substring(raw, 1, instr(raw, ':') - 1)")).alias("name"),
        F.when(name != "", spans).otherwise(F.col("raw").substr(first + 1, F.length("raw"))).alias("spans"),
    )


def _grouped(rows: DataFrame, key: Column, shown: Column, shown_name: str) -> DataFrame:
    """Clamped ranges by first-seen key: doc_id, gi, ri, shown, s, e."""
    parts = rows.withColumns({"__key": key, shown_name: shown}).select("doc_id", "n", "line", "__key", shown_name, F.explode(range_parts(F.col("spans"))).alias("r"))
    parts = clamp(parts.select("doc_id", "n", "line", "__key", shown_name, "r.s", "r.e"), F.col("n") - 1)
    heads = parts.groupBy("doc_id", "__key").agg(F.min("line").alias("__line"), F.min_by(shown_name, "line").alias(shown_name))
    heads = heads.withColumn("gi", (F.row_number().over(Window.partitionBy("doc_id").orderBy("__line")) - 1).cast("int"))
    joined = coalesce(parts.select("doc_id", "__key", "s", "e"), "doc_id", "__key")
    return shuffled(joined).join(heads, ["doc_id", "__key"]).select("doc_id", "gi", "ri", shown_name, "s", "e")


def parse_topics(responses: DataFrame, decode: bool = True) -> DataFrame:
    """doc_id, gi, ri, label (array), s, e from (doc_id, response, n).

    Equal labels (by their key) are one group, named as first seen. A document
    whose answer gives no group has no rows; ``topic_errors`` lists it.
    """
    rows = _labelled_lines(responses)
    name = decode_entities(F.col("name"), 1) if decode else F.col("name")
    rows = rows.withColumn("label", label_parts(name)).where(F.size("label") > 0)
    return _grouped(rows, label_key(F.col("label")), F.col("label"), "label")


def parse_insights(responses: DataFrame) -> DataFrame:
    """doc_id, gi, ri, name, s, e; names differ by more than case and white space."""
    rows = _labelled_lines(responses).withColumn("name", squeeze(F.col("name"))).where("name <> ''")
    return _grouped(rows, name_key(F.col("name")), F.col("name"), "name")


def topic_errors(responses: DataFrame, groups: DataFrame) -> DataFrame:
    """doc_id, error: why an answer can't be used."""
    bad = responses.select("doc_id", "n").join(groups.select("doc_id").distinct(), "doc_id", "left_anti")
    return bad.select("doc_id", F.when(F.col("n") <= 0, "sentence count must be positive").otherwise("no topic ranges in response").alias("error"))


def parse_topics_json(responses: DataFrame) -> DataFrame:
    """As ``parse_topics`` for answers in JSON: {"topics": [{"label": [...], "ranges": [{"start", "end"}]}]}."""
    schema = "topics array<struct<label: array<string>, ranges: array<struct<start: bigint, end: bigint>>>>"
    rows = responses.select("doc_id", "n", F.posexplode(F.from_json("response", schema)["topics"]).alias("line", "t"))
    rows = rows.withColumn("label", label_parts(F.array_join("t.label", ">"))).where(F.size("label") > 0)
    spans = F.array_join(F.transform("t.ranges", lambda r: F.concat_ws("-", r["start"].cast("string"), r["end"].cast("string"))), ",")
    return _grouped(rows.withColumn("spans", spans), label_key(F.col("label")), F.col("label"), "label")


def parse_keywords(responses: DataFrame) -> DataFrame:
    """doc_id, s, e: distinct index ranges; those that end beyond the words are left out."""
    found = F.regexp_extract_all("response", F.lit(r"([0-9]+\s*-\s*[0-9]+|[0-9]+)"), F.lit(0))
    rows = responses.select("doc_id", "n", F.explode(found).alias("part")).withColumn("ends", F.split("part", "-"))
    a, b = strip(F.col("ends")[0]).try_cast("long"), strip(F.element_at("ends", -1)).try_cast("long")
    return rows.select("doc_id", "n", F.least(a, b).alias("s"), F.greatest(a, b).alias("e")).where("e < n").select("doc_id", "s", "e").distinct()


def gap_decision(answer: Column) -> Column:
    """previous, next, new or unknown."""
    up = F.upper(strip(answer))
    has_prev, has_next = up.contains("PREVIOUS"), up.contains("NEXT")
    return (
        F.when(up.startswith("PREVIOUS"), "previous").when(up.startswith("NEXT"), "next").when(up.startswith("NEW"), "new")
        .when(has_prev & ~has_next, "previous").when(has_next & ~has_prev, "next").otherwise("unknown")
    )


def new_topic(answer: Column) -> Column:
    """Label of a NEW answer."""
    clean = strip(answer)
    at = F.instr(clean, ":")
    parts = F.filter(F.transform(F.split(F.when(at > 0, clean.substr(at + 1, F.length(clean))).otherwise(""), ">"), strip), lambda x: x != "")
    return F.when(F.size(parts) > 0, parts).otherwise(F.array(F.lit(UNCATEGORISED)))


def reassignment(answer: Column) -> Column:
    up = F.upper(answer)
    a, b = up.contains("PREVIOUS"), up.contains("NEXT")
    return F.when(a & ~b, "previous").when(b & ~a, "next")


def boundary_shift(answer: Column, most: int = 2) -> Column:
    """Sentences to move over a boundary: positive for SHIFT_LEFT, negative for SHIFT_RIGHT, 0 for none."""
    up = F.upper(strip(answer))
    left, right = F.regexp_extract(up, r"^SHIFT_LEFT\s+([0-9]+)", 1), F.regexp_extract(up, r"^SHIFT_RIGHT\s+([0-9]+)", 1)
    return F.when(left != "", F.least(left.try_cast("int"), F.lit(most))).when(right != "", -F.least(right.try_cast("int"), F.lit(most))).otherwise(0)


def split_probabilities(answers: DataFrame) -> DataFrame:
    """doc_id, qid, probability, valid from (doc_id, response) with a JSON object ``answers``."""
    kind = "answers map<string, struct<choice: string, probabilities: map<string, double>>>"
    rows = answers.select("doc_id", F.explode(F.from_json("response", kind)["answers"]).alias("qid", "a"))
    p, q = F.col("a.probabilities")["split"], F.col("a.probabilities")["continue"]
    unit = p.between(0, 1) & q.between(0, 1)
    valid = unit & F.col("a.choice").isin("split", "continue") & (F.abs(p + q - 1) <= 0.001)
    return rows.select("doc_id", "qid", p.alias("probability"), F.coalesce(valid, F.lit(False)).alias("valid"))


def parse_labels(responses: DataFrame) -> DataFrame:
    """doc_id, section, label (array) from numbered lines; the first answer for a section counts, others and those out of range are left out."""
    rows = lines(responses.select("doc_id", "n", "response"))
    pattern = rf"^[^\p{{L}}\p{{N}}_]*\[?([0-9]+)\]?[{WS}]*[:.)\]\-][{WS}]*(.+)$"
    number, rest = F.regexp_extract("raw", pattern, 1).try_cast("int"), F.regexp_extract("raw", pattern, 2)
    text = F.regexp_replace(rest, rf"^[{WS}:.)\]\-*`]+|[{WS}*`]+$", "")
    label = F.filter(F.transform(F.split(F.regexp_replace(text, ":", " "), ">"), squeeze), lambda x: x != "")
    rows = rows.select("doc_id", "n", "line", number.alias("section"), label.alias("label")).where("section between 1 and n and size(label) > 0")
    return rows.groupBy("doc_id", "section").agg(F.min_by("label", "line").alias("label"))
