"""A deterministic stand-in for language models: answers computed from ids and counts alone."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

LABELS = ("Science>Climate", "Technology>AI: Models", "technology > A I > models", "Business>M-and-A")
GAP_ANSWERS = ("PREVIOUS", "NEXT", "NEW: Misc>T", "dunno")
SHIFT_ANSWERS = ("CORRECT", "SHIFT_LEFT 1", "SHIFT_RIGHT 9", "no idea")
BLOCK = 5


def _pick(options: tuple[str, ...], i: Column) -> Column:
    return F.element_at(F.array(*map(F.lit, options)), (F.pmod(i, F.lit(len(options))) + 1).cast("int"))


def topic_response(doc_id: Column, n: Column) -> Column:
    """Topic lines for blocks of five sentences, with holes, reversed and overlong ranges and junk among them."""
    blocks = F.filter(F.sequence(F.lit(0), F.floor((n - 1) / BLOCK).cast("int")), lambda k: k % 6 != 5)

    def line(k: Column) -> Column:
        a = k * BLOCK
        b = a + BLOCK - 1 + F.when(k % 7 == 6, 1000).otherwise(0)
        span = F.when(k % 5 == 3, F.concat_ws("-", b.cast("string"), a.cast("string"))).otherwise(F.concat_ws("-", a.cast("string"), b.cast("string")))
        return F.concat(_pick(LABELS, doc_id + k), F.lit(": "), F.when(k % 4 == 2, "x, ").otherwise(""), span)

    return F.when(n > 0, F.array_join(F.transform(blocks, line), "\n")).otherwise("")


def gap_answer(doc_id: Column, idx: Column) -> Column:
    return _pick(GAP_ANSWERS, doc_id + idx)


def shift_answer(doc_id: Column, idx: Column) -> Column:
    return _pick(SHIFT_ANSWERS, doc_id + idx)


def split_probability(doc_id: Column, idx: Column) -> Column:
    return F.pmod(doc_id * 31 + idx * 17, F.lit(100)) / 100.0


def keyword_response(n: Column) -> Column:
    half = F.floor(n / 2).cast("long").cast("string")
    return F.concat(F.lit("0, "), half, F.lit("-"), (F.floor(n / 2) + 2).cast("long").cast("string"), F.lit(", "), (n + 5).cast("string"))


def with_topic_response(counts: DataFrame) -> DataFrame:
    return counts.withColumn("response", topic_response(F.col("doc_id"), F.col("n")))
