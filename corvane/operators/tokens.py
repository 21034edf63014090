"""Generators: texts to words, sentences and chunks, without a shuffle.

A text is segmented inside its own row by an Arrow batch function and exploded;
offsets come from the match itself, so no window over tokens is needed.
"""

from __future__ import annotations

import math
import re
from bisect import bisect_left, bisect_right
from collections.abc import Callable, Iterator
from itertools import accumulate

import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from corvane.functions import segment
from corvane.functions.text import normalise, strip

Spans = Callable[[str], list[segment.Span]]
_PART = re.compile(r"\{(\d+)\}\s")


def explode_spans(docs: DataFrame, spans: Spans) -> DataFrame:
    """doc_id, idx, start, end, text: one row for every span of ``spans(text)``. Null texts have none."""
    kind = docs.schema["doc_id"].dataType.simpleString()

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            ids, rows, size = [], [], 0
            for at, text in enumerate(batch.column(1).to_pylist()):
                for k, (s, e) in enumerate(spans(text)) if text else ():
                    ids.append(at)
                    rows.append((k, s, e, text[s:e]))
                    size += e - s
                if size > 1 << 22:
                    yield _rows(batch, ids, rows)
                    ids, rows, size = [], [], 0
            yield _rows(batch, ids, rows)

    return docs.select("doc_id", "text").mapInArrow(run, f"doc_id {kind}, idx int, start int, end int, text string")


def _rows(batch: pa.RecordBatch, ids: list[int], rows: list[tuple]) -> pa.RecordBatch:
    cols = list(zip(*rows, strict=True)) or [()] * 4
    kinds = (pa.int32(), pa.int32(), pa.int32(), pa.string())
    return pa.RecordBatch.from_arrays([batch.column(0).take(pa.array(ids, pa.int64())), *(pa.array(c, k) for c, k in zip(cols, kinds, strict=True))], ["doc_id", "idx", "start", "end", "text"])


def word_tokens(docs: DataFrame) -> DataFrame:
    return explode_spans(docs, segment.words)


def hard_sentences(docs: DataFrame, tags: bool = False, quotes: bool = False) -> DataFrame:
    return explode_spans(docs, lambda t: segment.hard_spans(segment.Layout(t, tags, quotes)))


def sparse_sentences(docs: DataFrame, target: int = 16, most: int = 32, least: int = 4, tags: bool = False, quotes: bool = False) -> DataFrame:
    segment.sparse_sentences("", target, most, least)  # checks the parameters here, not in a task
    return explode_spans(docs, lambda t: segment.sparse_sentences(t, target, most, least, tags, quotes))


def normalised_sentences(docs: DataFrame, shortest: int = 40, longest: int = 300, **splitter: int) -> DataFrame:
    segment.normalised_lengths("", [], shortest, longest)
    return explode_spans(docs, lambda t: segment.normalised_lengths(t, segment.sparse_sentences(t, **splitter), shortest, longest))


def sentence_counts(docs: DataFrame) -> DataFrame:
    """doc_id, n: hard sentences of each document, documents without any included."""
    kind = docs.schema["doc_id"].dataType.simpleString()

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            n = [len(segment.hard_spans(segment.Layout(t))) if t else 0 for t in batch.column(1).to_pylist()]
            yield pa.RecordBatch.from_arrays([batch.column(0), pa.array(n, pa.int64())], ["doc_id", "n"])

    return docs.select("doc_id", "text").mapInArrow(run, f"doc_id {kind}, n long")


def counts_of_sentences(docs: DataFrame, sentences: DataFrame) -> DataFrame:
    """As ``sentence_counts``, from sentences that are there already; no text is read."""
    n = sentences.groupBy("doc_id").agg(F.count("*").alias("n"))
    return docs.select("doc_id").join(n, "doc_id", "left").select("doc_id", F.coalesce("n", F.lit(0)).cast("long").alias("n"))


def mark_sentences(docs: DataFrame, sentences: DataFrame, optimise: bool = False) -> DataFrame:
    """doc_id, tagged_text, n_items: one numbered line for each sentence; a text without sentences is line 0 unless blank."""
    text = normalise(F.col("text")) if optimise else F.col("text")
    lines = sentences.withColumn("line", F.concat(F.lit("{"), F.col("idx").cast("string"), F.lit("} "), text))
    marked = lines.groupBy("doc_id").agg(F.array_sort(F.collect_list(F.struct("idx", "line"))).alias("l"))
    joined = docs.select("doc_id", "text").join(marked, "doc_id", "left")
    alone = F.when(strip(F.coalesce("text", F.lit(""))) != "", F.concat(F.lit("{0} "), F.col("text"))).otherwise("")
    return joined.select(
        "doc_id", F.coalesce(F.array_join(F.col("l.line"), "\n"), alone).alias("tagged_text"),
        F.coalesce(F.size("l"), (alone != "").cast("int")).cast("long").alias("n_items"),
    )


def mark_words(docs: DataFrame) -> DataFrame:
    """doc_id, tagged_text, n_items: numbered words with single spaces between, all inside the row."""
    words = F.regexp_extract_all("text", F.lit(r"(?U)[^\s\x1c-\x1f]+"), F.lit(0))
    tagged = F.transform(words, lambda w, i: F.concat(F.lit("{"), i.cast("string"), F.lit("} "), w))
    return docs.select("doc_id", F.array_join(tagged, " ").alias("tagged_text"), F.size(words).cast("long").alias("n_items"))


# --- chunks ------------------------------------------------------------------


def _fitting_lines(tagged: str, most: int) -> list[str]:
    """Lines of at most ``most`` characters: longer ones in parts, each with the number of its line."""
    out, number = [], ""
    for line in tagged.split("\n"):
        found = _PART.match(line)
        number = found[0] if found else number
        if len(line) > most:
            width, body = most - len(number), line[len(number) :] if found else line
            if width <= 0:
                raise ValueError(f"a chunk of {most} characters can't hold a numbered line")
            out += [number + body[i : i + width] for i in range(0, len(body), width)]
        else:
            out.append(line)
    return out


def balanced_chunks(tagged: str, most: int = 12_000, overlap: int = 500) -> list[list[str]]:
    """Lines of chunks of about equal size, each starting with the last lines of the one before.

    A chunk is a slice of the lines, and its size a difference of running sums,
    so where it ends and where the next one begins are found by bisection.
    """
    if len(tagged) <= most:
        return [tagged.split("\n")]
    lines = _fitting_lines(tagged, most)
    upto = list(accumulate((len(x) + 1 for x in lines), initial=0))  # characters before each line, line ends included
    numbered = [i for i, x in enumerate(lines) if _PART.match(x)]
    total = upto[-1] - 1
    count = 1 + math.ceil((total - most) / max(most - overlap, 1))
    goal = (total + (count - 1) * overlap) / count
    out: list[list[str]] = []
    first = end = 0
    while end < len(lines):
        begin = end
        while first < begin and upto[begin + 1] - upto[first] - 1 > most:  # the overlap leaves no room for a new line
            k = bisect_right(numbered, first)
            first = min(numbered[k] if k < len(numbered) else begin, begin)
        end = max(begin + 1, bisect_right(upto, upto[first] + most + 1) - 1)
        if len(out) + 1 < count:
            end = min(end, max(begin + 1, bisect_left(upto, upto[first] + goal + 1)))
        out.append(lines[first:end])
        first = end
        if overlap:
            first = max(begin, min(end - 1, bisect_right(upto, upto[end] - 1 - overlap) - 1))
            k = bisect_right(numbered, first)
            first = max(begin, numbered[k - 1] if k else begin)
    return out


def word_chunks(tagged: str, most: int = 12_000, overlap: int = 20) -> list[list[str]]:
    """Numbered words of greedy chunks, each starting with the last new words of the one before."""
    marks = [m.start() for m in re.finditer(r"\{\d+\}", tagged)]
    tokens = [t for t in (tagged[a:b].strip() for a, b in zip(marks, [*marks[1:], len(tagged)], strict=True)) if t]
    if len(tagged) <= most or not tokens:
        return [tokens or [tagged]]
    out: list[list[str]] = []
    at, carried = 0, []
    while at < len(tokens):
        begin, size = at, sum(map(len, carried)) + max(len(carried) - 1, 0)
        while at < len(tokens):
            more = len(tokens[at]) + bool(carried or at > begin)
            if (carried or at > begin) and size + more > most:
                break
            size, at = size + more, at + 1
        at = max(at, begin + 1)
        out.append(carried + tokens[begin:at])
        carried = tokens[begin:at][-overlap:] if overlap else []
    return out


def chunks(marked: DataFrame, most: int = 12_000, overlap: int = 500, by_words: bool = False) -> DataFrame:
    """doc_id, chunk_id, tagged_text, n_lines, marker_start, marker_end.

    A chunk's first and last marker are those found anywhere in it, null if none.
    """
    if most <= 0 or overlap < 0 or (not by_words and overlap >= most):
        raise ValueError("the overlap must not be negative, and shorter than a chunk")
    kind = marked.schema["doc_id"].dataType.simpleString()
    cut, glue = (word_chunks, " ") if by_words else (balanced_chunks, "\n")

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            rows = [(at, k, glue.join(c), len(c)) for at, t in enumerate(batch.column(1).to_pylist()) for k, c in enumerate(cut(t or "", most, overlap))]
            ids, number, text, n = list(zip(*rows, strict=True)) or [()] * 4
            yield pa.RecordBatch.from_arrays([batch.column(0).take(pa.array(ids, pa.int64())), pa.array(number, pa.int32()), pa.array(text, pa.string()), pa.array(n, pa.int64())], ["doc_id", "chunk_id", "tagged_text", "n_lines"])

    out = marked.select("doc_id", "tagged_text").mapInArrow(run, f"doc_id {kind}, chunk_id int, tagged_text string, n_lines long")
    return with_markers(out)


def with_markers(chunked: DataFrame) -> DataFrame:
    marks = F.regexp_extract_all("tagged_text", F.lit(r"\{(\d+)\}"), F.lit(1))
    return chunked.withColumns({"marker_start": F.get(marks, F.lit(0)).cast("int"), "marker_end": F.get(marks, F.size(marks) - 1).cast("int")})
