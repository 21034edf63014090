"""Keyword spans over numbered words.

Words are found in the document's own row and looked up there, so only ranges
and spans are grouped by document; no table of words is ever shuffled.
"""

from __future__ import annotations

from bisect import bisect_right
from collections.abc import Callable, Iterator

import pyarrow as pa
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from corvane.functions.segment import Span, words

_SPAN = "doc_id {}, start int, end int, text string"


def _in_rows(docs: DataFrame, listed: DataFrame, each: Callable[[str, list], Iterator[tuple]], schema: str) -> DataFrame:
    """Rows that ``each(text, list)`` gives for every document with its list (column ``l`` of ``listed``, by doc_id; none: empty)."""
    kind = docs.schema["doc_id"].dataType.simpleString()
    fields = [f.split()[0] for f in schema.split(", ")]
    kinds = [{"int": pa.int32(), "string": pa.string()}.get(f.split()[1]) for f in schema.split(", ")]

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            at, rows = [], []
            for i, (text, found) in enumerate(zip(batch.column(1).to_pylist(), batch.column(2).to_pylist(), strict=True)):
                new = list(each(text or "", found or []))
                at += [i] * len(new)
                rows += new
            cols = list(zip(*rows, strict=True)) or [()] * (len(fields) - 1)
            yield pa.RecordBatch.from_arrays([batch.column(0).take(pa.array(at, pa.int64())), *(pa.array(c, k) for c, k in zip(cols, kinds[1:], strict=True))], fields)

    return docs.select("doc_id", "text").join(listed, "doc_id", "left").select("doc_id", "text", "l").mapInArrow(run, schema.format(kind))


def build(ranges: DataFrame, docs: DataFrame) -> DataFrame:
    """doc_id, start, end, text of index ranges (s, e); those outside the words are left out."""

    def each(text: str, found: list) -> Iterator[tuple]:
        own = words(text) if found else []
        for r in found:
            if 0 <= r["s"] <= r["e"] < len(own):
                start, end = own[r["s"]][0], own[r["e"]][1]
                yield start, end, text[start:end]

    return _in_rows(docs, ranges.groupBy("doc_id").agg(F.collect_list(F.struct("s", "e")).alias("l")), each, _SPAN)


def open_runs(own: list[Span], taken: list[Span]) -> Iterator[tuple[int, int]]:
    """Runs (first and last word) of words that no span overlaps: one pass, the spans' reach looked up by bisection."""
    taken = sorted(taken)
    starts, reach, end = [s for s, _ in taken], [], -1
    for _, e in taken:
        end = max(end, e)
        reach.append(end)
    begin = None
    for i, (s, e) in enumerate(own):
        k = bisect_right(starts, e - 1)
        if k and reach[k - 1] > s:
            if begin is not None:
                yield begin, i - 1
            begin = None
        elif begin is None:
            begin = i
    if begin is not None:
        yield begin, len(own) - 1


def gaps(docs: DataFrame, keywords: DataFrame, least: int = 1) -> DataFrame:
    """doc_id, ri, s, e, start, end, text: runs of at least ``least`` words that no keyword overlaps, with their first word's span and their text."""

    def each(text: str, found: list) -> Iterator[tuple]:
        own = words(text)
        for ri, (s, e) in enumerate((s, e) for s, e in open_runs(own, [(k["start"], k["end"]) for k in found]) if e - s + 1 >= least):
            yield ri, s, e, *own[s], text[own[s][0] : own[e][1]]

    listed = keywords.groupBy("doc_id").agg(F.collect_list(F.struct("start", "end")).alias("l"))
    return _in_rows(docs, listed, each, "doc_id {}, ri int, s int, e int, start int, end int, text string")


def first_words(runs: DataFrame) -> DataFrame:
    """doc_id, seq, start, end, text: the first word of every run."""
    return runs.select("doc_id", F.col("s").cast("long").alias("seq"), "start", "end", F.col("text").substr(F.lit(1), F.col("end") - F.col("start")).alias("text"))


def merge(old: DataFrame, new: DataFrame) -> DataFrame:
    """``old`` and those of ``new`` (in order of their column seq) that overlap nothing accepted before.

    The order makes it a fold over one document's keywords; what is accepted is kept sorted and looked up by bisection.
    """
    tagged = old.select("doc_id", "start", "end", "text", F.lit(None).cast("long").alias("seq")).unionByName(new.select("doc_id", "start", "end", "text", F.col("seq").cast("long").alias("seq")))
    listed = tagged.groupBy("doc_id").agg(F.array_sort(F.collect_list(F.struct("seq", "start", "end", "text"))).alias("l"))
    kind = old.schema["doc_id"].dataType.simpleString()

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            at, rows = [], []
            for i, found in enumerate(batch.column(1).to_pylist()):
                for k in accepted(found):
                    at.append(i)
                    rows.append((k["start"], k["end"], k["text"]))
            cols = list(zip(*rows, strict=True)) or [()] * 3
            yield pa.RecordBatch.from_arrays([batch.column(0).take(pa.array(at, pa.int64())), *(pa.array(c, t) for c, t in zip(cols, (pa.int32(), pa.int32(), pa.string()), strict=True))], ["doc_id", "start", "end", "text"])

    return listed.select("doc_id", "l").mapInArrow(run, _SPAN.format(kind))


def accepted(found: list[dict]) -> list[dict]:
    """Spans without seq, whatever they overlap, and those with one, in order, that overlap nothing accepted."""
    old = [k for k in found if k["seq"] is None]
    out, starts, ends = list(old), [], []
    for s, e in sorted((k["start"], k["end"]) for k in old):
        if ends and s <= ends[-1]:
            ends[-1] = max(ends[-1], e)
        else:
            starts.append(s)
            ends.append(e)
    for k in sorted((k for k in found if k["seq"] is not None), key=lambda k: (k["seq"], k["start"], k["end"])):
        i = bisect_right(starts, k["end"] - 1)
        if not (i and ends[i - 1] > k["start"]):
            starts.insert(i, k["start"])
            ends.insert(i, k["end"])
            out.append(k)
    return out


def highlight(docs: DataFrame, keywords: DataFrame) -> DataFrame:
    """doc_id, html: escaped text with overlapping keyword spans joined (touching ones aren't) and wrapped in <mark>."""
    order = Window.partitionBy("doc_id").orderBy("start", "end")
    reach = F.max("end").over(order.rowsBetween(Window.unboundedPreceding, -1))
    runs = keywords.withColumn("fresh", F.when(F.col("start") < reach, 0).otherwise(1)).withColumn("run", F.sum("fresh").over(order.rowsBetween(Window.unboundedPreceding, 0)))
    spans = runs.groupBy("doc_id", "run").agg(F.min("start").alias("a"), F.max("end").alias("b"))
    pieces = spans.withColumn("before", F.coalesce(F.lag("b").over(Window.partitionBy("doc_id").orderBy("a")), F.lit(0)))

    def escaped(c):
        for raw, safe in (("&", "&amp;"), ("<", "&lt;"), (">", "&gt;"), ('"', "&quot;"), ("'", "&#x27;")):
            c = F.replace(c, F.lit(raw), F.lit(safe))
        return c

    listed = pieces.groupBy("doc_id").agg(F.array_sort(F.collect_list(F.struct("a", "b", "before"))).alias("l"))
    rows = docs.select("doc_id", F.coalesce("text", F.lit("")).alias("text")).join(listed, "doc_id", "left")

    def piece(x):
        t = F.col("text")
        return F.concat(escaped(t.substr(x["before"] + 1, x["a"] - x["before"])), F.lit("<mark>"), escaped(t.substr(x["a"] + 1, x["b"] - x["a"])), F.lit("</mark>"))

    last = F.coalesce(F.element_at("l", -1)["b"], F.lit(0))
    tail = escaped(F.col("text").substr(last + 1, F.length("text")))
    return rows.select("doc_id", F.concat(F.coalesce(F.array_join(F.transform("l", piece), ""), F.lit("")), tail).alias("html"))
