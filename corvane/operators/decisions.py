"""Segmentation by a split probability for every gap between sentences."""

from __future__ import annotations

import json
import math
from collections.abc import Iterator

import pyarrow as pa
import pyarrow.compute as pc
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from corvane.functions.text import estimate_tokens, fit_text, squeeze
from corvane.operators.ranges import shuffled, to_indices

# How requests are sized.
THRESHOLD, BATCH, CONTEXT, SENTENCE_CHARS = 0.5, 8, 2, 2000
SECTION_CHARS, SECTIONS, LABEL_CHARS = 1500, 60, 84_000
RESERVED_TOKENS, TOKENS_PER_QUESTION = 256, 128

CRITERIA = {
    "continue": "The next sentence stays with the subject at hand: an example, a detail, a reference back, or what a heading announced.",
    "split": "The next sentence opens another subject: a new story, product, event or lasting aspect, a heading, or a return to an earlier one.",
}


def content(docs: DataFrame, sentences: DataFrame) -> DataFrame:
    """doc_id, id (from 1), text (fitted), paragraph_break_before."""
    rows = sentences.withColumn("__end", F.lag("end").over(Window.partitionBy("doc_id").orderBy("idx")))
    rows = rows.join(docs.select("doc_id", F.col("text").alias("__text")), "doc_id")
    gap = F.col("__text").substr(F.col("__end") + 1, F.col("start") - F.col("__end"))
    return rows.select("doc_id", (F.col("idx") + 1).alias("id"), fit_text(F.col("text"), SENTENCE_CHARS).alias("text"), F.coalesce(gap.rlike(r"\n\s*\n"), F.lit(False)).alias("paragraph_break_before"))


def batches(counts: DataFrame, size: int = BATCH, around: int = CONTEXT) -> DataFrame:
    """doc_id, batch, first_gap, last_gap, first_id, last_id: gaps asked together (named by the sentence after, from 2) and the sentences shown with them."""
    rows = counts.where("n > 1").select("doc_id", "n", F.explode(F.sequence(F.lit(0), F.floor((F.col("n") - 2) / size).cast("int"))).alias("batch"))
    first, last = F.col("batch") * size + 2, F.least(F.col("batch") * size + size + 1, F.col("n"))
    return rows.select(
        "doc_id", "batch", first.cast("long").alias("first_gap"), last.cast("long").alias("last_gap"),
        F.greatest(first - 1 - around, F.lit(1)).cast("long").alias("first_id"), F.least(last + around, F.col("n")).cast("long").alias("last_id"),
    )


def requests(shown: DataFrame, asked: DataFrame) -> DataFrame:
    """doc_id, batch, prompt (JSON: state and questions), tokens, of each batch."""
    rows = asked.join(shown, "doc_id").where("id between first_id and last_id")
    state = F.array_sort(F.collect_list(F.struct("id", "paragraph_break_before", "text")))
    rows = rows.groupBy("doc_id", "batch", "first_gap", "last_gap").agg(state.alias("sentences"))
    choices = F.create_map(*[F.lit(x) for kv in CRITERIA.items() for x in kv])
    one = lambda k: F.struct(F.concat(F.lit("b"), k.cast("string")).alias("id"), F.lit("choice").alias("type"), F.concat(F.lit("Does sentence "), k.cast("string"), F.lit(" open a new section?")).alias("instructions"), choices.alias("criteria"))
    questions = F.transform(F.sequence("first_gap", "last_gap"), one)
    prompt = F.to_json(F.struct(F.struct("sentences").alias("state"), questions.alias("questions")))
    size = estimate_tokens(prompt) + RESERVED_TOKENS + TOKENS_PER_QUESTION * (F.col("last_gap") - F.col("first_gap") + 1)
    return rows.select("doc_id", "batch", prompt.alias("prompt"), size.alias("tokens"))


def sections(probabilities: DataFrame, counts: DataFrame, threshold: float = THRESHOLD) -> DataFrame:
    """doc_id, ri, s, e from (doc_id, idx, probability) of the gap before each sentence but the first.

    Only first sentences of sections are rows, collected by document beside its
    count; the sentences between need none, and nothing is joined.
    """
    firsts = counts.where("n > 0").select("doc_id", F.lit(0).alias("idx"), F.col("n").cast("int").alias("n"))
    starts = probabilities.where((F.col("probability") >= threshold) & (F.col("idx") > 0)).select("doc_id", F.col("idx").cast("int").alias("idx"), F.lit(None).cast("int").alias("n"))
    per = firsts.unionByName(starts).groupBy("doc_id").agg(F.max("n").alias("n"), F.array_sort(F.collect_set("idx")).alias("at")).where("n is not null")
    per = per.select("doc_id", "n", F.filter("at", lambda i: i < F.col("n")).alias("at"))
    ends = F.transform("at", lambda s, k: F.struct(s.alias("s"), (F.coalesce(F.get("at", k + 1), F.col("n")) - 1).alias("e")))
    return per.select("doc_id", F.posexplode(ends).alias("ri", "x")).select("doc_id", "ri", "x.s", "x.e")


def bodies(parts: DataFrame, sentences: DataFrame, most: int = SECTION_CHARS) -> DataFrame:
    """doc_id, ri, body: a section's sentences in one line, fitted."""
    rows = shuffled(to_indices(parts)).join(sentences.select("doc_id", "idx", "text"), ["doc_id", "idx"])
    text = F.array_join(F.transform(F.array_sort(F.collect_list(F.struct("idx", "text"))), lambda x: x["text"]), " ")
    return rows.groupBy("doc_id", "ri").agg(fit_text(squeeze(text), most).alias("body"))


def label_batches(sized: DataFrame, most: int = LABEL_CHARS, count: int = SECTIONS) -> DataFrame:
    """doc_id, ri, batch, number: sections packed in order, ``count`` and ``most`` characters at most in each batch, numbered from 1.

    Packing goes once through one document's sections, in a batch function: a
    fold of expressions would copy what it has packed at every section.
    """
    lists = sized.groupBy("doc_id").agg(F.array_sort(F.collect_list(F.struct("ri", F.coalesce(F.length("body"), F.lit(0)).alias("k")))).alias("l"))
    kind = sized.schema["doc_id"].dataType.simpleString()

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for whole in batches:
            for lo in range(0, whole.num_rows, 256):
                part = whole.slice(lo, 256)
                flat = part.column(1).flatten()
                ri, size = flat.field(0), flat.field(1).to_pylist()
                at, batches_, numbers, k = [], [], [], 0
                for i, n in enumerate(pc.list_value_length(part.column(1)).to_pylist()):
                    batch = number = chars = 0
                    for more in size[k : k + n]:
                        if number and (number >= count or chars + more + 8 > most):
                            batch, number, chars = batch + 1, 0, 0
                        number, chars = number + 1, chars + more + 8
                        batches_.append(batch)
                        numbers.append(number)
                    at += [i] * n
                    k += n
                yield pa.RecordBatch.from_arrays([part.column(0).take(pa.array(at, pa.int64())), ri, pa.array(batches_, pa.int32()), pa.array(numbers, pa.int32())], ["doc_id", "ri", "batch", "number"])

    return lists.mapInArrow(run, f"doc_id {kind}, ri int, batch int, number int")


def topic_lines(parts: DataFrame, labels: DataFrame) -> DataFrame:
    """doc_id, response: lines 'A>B: s-e' in order, as the topic parser reads them."""
    rows = shuffled(parts).join(labels.select("doc_id", "ri", "label"), ["doc_id", "ri"])
    line = F.concat(F.array_join("label", ">"), F.lit(": "), F.col("s").cast("string"), F.lit("-"), F.col("e").cast("string"))
    return rows.groupBy("doc_id").agg(F.array_join(F.transform(F.array_sort(F.collect_list(F.struct("ri", line.alias("line")))), lambda x: x["line"]), "\n").alias("response"))


# --- requests that fit ---------------------------------------------------------


def tokens_of(prompt: str, questions: int) -> int:
    """Estimated tokens of a request with its answers."""
    return math.ceil(max(len(prompt) / 2, len(prompt.encode()) / 3) * 1.1) + RESERVED_TOKENS + TOKENS_PER_QUESTION * questions


def fitted(text: str, most: int) -> str:
    """Head and tail of a text around an ellipsis, as ``fit_text``."""
    if len(text) <= most:
        return text
    return text[:most] if most <= 1 else text[: most // 2] + "…" + (text[-(most - 1 - most // 2) :] if most - 1 - most // 2 else "")


def request_json(sentences: list[dict], first: int, last: int, around: int, most: int) -> str:
    """The prompt about the gaps before sentences ``first`` to ``last`` (ids from 1)."""
    shown = sentences[max(first - 2 - around, 0) : last + around]
    state = [{"id": s["id"], "paragraph_break_before": s["paragraph_break_before"], "text": fitted(s["text"], most)} for s in shown]
    ask = [{"id": f"b{k}", "type": "choice", "instructions": f"Does sentence {k} open a new section?", "criteria": CRITERIA} for k in range(first, last + 1)]
    return json.dumps({"state": {"sentences": state}, "questions": ask}, ensure_ascii=False, separators=(",", ":"))


def fit(sentences: list[dict], window: int | None, size: int = BATCH, around: int = CONTEXT) -> Iterator[tuple[int, int, str]]:
    """(first gap, last gap, prompt) of requests that all fit a window of tokens (none or zero: any size fits).

    A batch too large is halved; a single gap loses its context, then its texts
    are cut to half and half again. What fits in no way is an error.
    """
    todo = [(a, min(a + size - 1, len(sentences))) for a in range(2, len(sentences) + 1, size)][::-1]
    while todo:
        first, last = todo.pop()
        prompt = request_json(sentences, first, last, around, SENTENCE_CHARS)
        if window and tokens_of(prompt, last - first + 1) > window:
            if first < last:
                half = (first + last) // 2
                todo += [(half + 1, last), (first, half)]
                continue
            most = SENTENCE_CHARS
            prompt = request_json(sentences, first, last, 0, most)
            while tokens_of(prompt, 1) > window and most > 1:
                most //= 2
                prompt = request_json(sentences, first, last, 0, most)
            if tokens_of(prompt, 1) > window:
                raise ValueError(f"the question about sentence {first} does not fit {window} tokens")
        yield first, last, prompt


def fitting_requests(shown: DataFrame, window: int | None, size: int = BATCH, around: int = CONTEXT) -> DataFrame:
    """doc_id, seq, first_gap, last_gap, prompt, error: requests over ``shown`` (see ``content``) that fit the window.

    A document of which a question can't fit has one row, with the error.
    """
    listed = shown.groupBy("doc_id").agg(F.array_sort(F.collect_list(F.struct("id", "paragraph_break_before", "text"))).alias("l"))
    kind = shown.schema["doc_id"].dataType.simpleString()

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            at, rows = [], []
            for i, sentences in enumerate(batch.column(1).to_pylist()):
                try:
                    new = [(k, *r, None) for k, r in enumerate(fit(sentences, window, size, around))]
                except ValueError as e:
                    new = [(0, None, None, None, str(e))]
                at += [i] * len(new)
                rows += new
            cols = list(zip(*rows, strict=True)) or [()] * 5
            kinds = (pa.int64(), pa.int64(), pa.int64(), pa.string(), pa.string())
            yield pa.RecordBatch.from_arrays([batch.column(0).take(pa.array(at, pa.int64())), *(pa.array(c, t) for c, t in zip(cols, kinds, strict=True))], ["doc_id", "seq", "first_gap", "last_gap", "prompt", "error"])

    return listed.mapInArrow(run, f"doc_id {kind}, seq long, first_gap long, last_gap long, prompt string, error string")
