"""HTML to clean text with a map of offsets back to the source."""

from __future__ import annotations

import re
from bisect import bisect_right
from collections.abc import Callable, Iterator
from html.parser import HTMLParser

import pyarrow as pa
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from corvane.functions.segment import TAG, Span

Segment = tuple[int, int, int]
STRIPPED = ("style", "script")


def tag_spans(text: str, strip: tuple[str, ...] = STRIPPED) -> list[Span]:
    """Every tag by its pattern, and the whole of each stripped element."""
    out = [m.span() for m in TAG.finditer(text)]
    if strip:
        names = "|".join(map(re.escape, strip))
        out += [m.span() for m in re.finditer(rf"(?is)<({names})\b[^>]*>.*?</\1\s*>", text)]
    return out


class _Events(HTMLParser):
    """Spans of what isn't text, as a tokenizer sees it."""

    def __init__(self, text: str, strip: tuple[str, ...]) -> None:
        super().__init__(convert_charrefs=False)
        self.lines = [0] + [m.end() for m in re.finditer("\n", text)]
        self.strip, self.size = set(strip), len(text)
        self.marks: list[tuple[int, str]] = []

    def _mark(self, kind: str) -> None:
        line, column = self.getpos()
        self.marks.append((self.lines[line - 1] + column, kind))

    def handle_starttag(self, tag: str, attrs: list) -> None:
        self._mark("+" + tag)

    def handle_startendtag(self, tag: str, attrs: list) -> None:
        self._mark("/")

    def handle_endtag(self, tag: str) -> None:
        self._mark("-" + tag)

    def handle_data(self, data: str) -> None:
        self._mark("")

    def handle_entityref(self, name: str) -> None:
        self._mark("")

    def handle_charref(self, name: str) -> None:
        self._mark("")

    def handle_comment(self, data: str) -> None:
        self._mark("/")

    def handle_decl(self, decl: str) -> None:
        self._mark("/")

    def handle_pi(self, data: str) -> None:
        self._mark("/")

    def unknown_decl(self, data: str) -> None:
        self._mark("/")

    def spans(self) -> list[Span]:
        out, within = [], None
        for (at, kind), (end, _) in zip(self.marks, [*self.marks[1:], (self.size, "")], strict=True):
            if within is not None:
                out.append((at, end))
                within = None if kind == "-" + within else within
            elif kind:
                out.append((at, end))
                within = kind[1:] if kind[0] == "+" and kind[1:] in self.strip else None
        return out


def parser_spans(text: str, strip: tuple[str, ...] = STRIPPED) -> list[Span]:
    """As ``tag_spans``, by an HTML tokenizer: comments and declarations count, and a comparison sign doesn't."""
    events = _Events(text, strip)
    events.feed(text)
    events.close()
    return events.spans()


def merged(spans: list[Span]) -> list[Span]:
    out: list[Span] = []
    for s, e in sorted(spans):
        if out and s <= out[-1][1]:
            out[-1] = (out[-1][0], max(out[-1][1], e))
        elif s < e:
            out.append((s, e))
    return out


def clean(text: str, spans: Callable[[str], list[Span]] = tag_spans) -> tuple[str, list[Segment]]:
    """Text without the spans, and segments (clean offset, original offset, length).

    Where a removed span parts two characters that aren't white space, one
    space stands for it; that space maps to where the span began.
    """
    parts: list[str] = []
    segments: list[Segment] = []
    size = at = 0
    gap = None
    for s, e in [*merged(spans(text)), (len(text), len(text))]:
        run = text[at:s]
        if run:
            if parts and not parts[-1][-1].isspace() and not run[0].isspace():
                parts.append(" ")
                segments.append((size, gap, 1))
                size += 1
            parts.append(run)
            segments.append((size, at, len(run)))
            size += len(run)
            gap = s
        at = e
    return "".join(parts), segments


def clean_table(docs: DataFrame, strip: tuple[str, ...] = STRIPPED, parser: bool = False) -> DataFrame:
    """doc_id, text (clean), segments, original_length, clean_length. A null text is empty."""
    kind = docs.schema["doc_id"].dataType.simpleString()
    find = parser_spans if parser else tag_spans
    seg = pa.list_(pa.struct([("clean_offset", pa.int32()), ("original_offset", pa.int32()), ("length", pa.int32())]))

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            texts = [t or "" for t in batch.column(1).to_pylist()]
            done = [clean(t, lambda x: find(x, strip)) for t in texts]
            segments = [[{"clean_offset": c, "original_offset": o, "length": n} for c, o, n in s] for _, s in done]
            yield pa.RecordBatch.from_arrays(
                [batch.column(0), pa.array([t for t, _ in done], pa.string()), pa.array(segments, seg), pa.array(map(len, texts), pa.int32()), pa.array([len(t) for t, _ in done], pa.int32())],
                ["doc_id", "text", "segments", "original_length", "clean_length"],
            )

    schema = f"doc_id {kind}, text string, segments array<struct<clean_offset: int, original_offset: int, length: int>>, original_length int, clean_length int"
    return docs.select("doc_id", "text").mapInArrow(run, schema)


def restore(rows: DataFrame, cleaned: DataFrame, *columns: str) -> DataFrame:
    """``rows`` with the offsets in ``columns`` mapped to the source: an as-of join by a window over segments and offsets.

    The end of the clean text is the end of the source; an offset outside the
    clean text, or in a text without segments, is null.
    """
    ends = cleaned.select("doc_id", F.size("segments").alias("__k"), "original_length", "clean_length")
    segments = cleaned.select("doc_id", F.explode("segments").alias("g")).select("doc_id", F.col("g.clean_offset").alias("__pos"), (F.col("g.original_offset") - F.col("g.clean_offset")).alias("__shift"))
    names = rows.columns
    order = Window.partitionBy("doc_id").orderBy("__pos", "__kind").rowsBetween(Window.unboundedPreceding, 0)
    for c in columns:
        both = rows.withColumns({"__pos": F.col(c), "__kind": F.lit(1)}).unionByName(segments.withColumn("__kind", F.lit(0)), allowMissingColumns=True)
        found = both.withColumn("__shift", F.last("__shift", ignorenulls=True).over(order)).where("__kind = 1").join(ends, "doc_id", "left")
        inside = (F.col(c) >= 0) & (F.col(c) < F.col("clean_length")) & (F.col("__k") > 0)
        moved = F.when(inside, F.col(c) + F.col("__shift")).when((F.col("__k") > 0) & (F.col(c) == F.col("clean_length")), F.col("original_length"))
        rows = found.withColumn(c, moved.cast("int")).select(*names)
    return rows


def restore_spans(rows: DataFrame, cleaned: DataFrame) -> DataFrame:
    """Sentences, words or keywords (start, end, text) of clean texts with both offsets in the source.

    Both are looked up in the document's own row, by bisection over its
    segments; the text stays the clean one.
    """
    maps = cleaned.select("doc_id", "segments", "original_length", "clean_length")

    @F.arrow_udf("array<struct<start: int, end: int>>")
    def moved(spans: pa.Array, segments: pa.Array, source: pa.Array, clean: pa.Array) -> pa.Array:
        out = []
        for ss, gs, n, k in zip(spans.to_pylist(), segments.to_pylist(), source.to_pylist(), clean.to_pylist(), strict=True):
            starts = [g["clean_offset"] for g in gs or []]

            def at(i: int, starts: list[int] = starts, gs: list = gs, n: int = n, k: int = k) -> int | None:
                if not starts or not 0 <= i <= k:
                    return None
                g = gs[bisect_right(starts, i) - 1]
                return n if i == k else g["original_offset"] + i - g["clean_offset"]

            out.append([{"start": at(s["start"]), "end": at(s["end"])} for s in ss])
        return pa.array(out, pa.list_(pa.struct([("start", pa.int32()), ("end", pa.int32())])))

    held = F.array_sort(F.collect_list(F.struct("start", "end", F.struct(*[F.col(c) for c in rows.columns]).alias("row")))).alias("l")
    lists = rows.groupBy("doc_id").agg(held).join(maps, "doc_id")
    lists = lists.withColumn("to", moved(F.transform("l", lambda x: F.struct(x["start"].alias("start"), x["end"].alias("end"))), "segments", "original_length", "clean_length"))
    each = lists.select(F.explode(F.arrays_zip("l", "to")).alias("x"))
    return each.select(*[(F.col(f"x.to.{c}") if c in ("start", "end") else F.col(f"x.l.row.{c}")).alias(c) for c in rows.columns])
