"""Quality rules as a bitmask ledger.

Every rule is evaluated once for each document. The ledger keeps the
measurements and one failure bit for each rule; what to do with them is decided
afterwards by versioned policies, which are masks over the bits. Ablations (how
many documents a rule removes alone, or would give back if it were left out)
come from one aggregation over the bits, without reading a text again.
"""

from __future__ import annotations

from collections import Counter
from collections.abc import Iterator

import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

SPACE = " \t\n\x0b\x0c\r"
SYMBOLS = "[#*$%&|<>]"[1:-1]
WINDOW = 5
MEASURES = ("n_words", "word_chars", "n_symbols", "n_dup_lines", "n_repeat_words", "n_lines", "n_upper", "n_bangs")

#: name -> failure condition over the measurements, in integers. The place in the table is the bit.
RULES: dict[str, str] = {
    "few_words": "n_words < 10",
    "repeated_windows": "100 * n_repeat_words > 20 * n_words",
    "symbols": "2 * n_symbols > n_words",
    "duplicate_lines": "n_lines >= 4 AND 10 * n_dup_lines > 3 * n_lines",
    "word_length": "word_chars < 2 * n_words OR word_chars > 15 * n_words",
    "shouting": "2 * n_upper > word_chars",
    "exclamations": "2 * n_bangs > n_words",
}

#: version -> the rules that it applies.
POLICIES: dict[str, tuple[str, ...]] = {
    "base": ("few_words", "repeated_windows"),
    "v1": ("few_words", "repeated_windows", "symbols", "duplicate_lines", "word_length"),
    "v2": tuple(RULES),
}
CURRENT = "v2"


def mask(policy: str) -> int:
    names = list(RULES)
    return sum(1 << names.index(r) for r in POLICIES[policy])


def measure(text: str | None) -> tuple[int, ...]:
    """The measurements of a whole text, in the order of ``MEASURES``; zeros for null."""
    text = text or ""
    raw = text.encode()
    words = raw.split()
    n = len(words)
    repeated = 0
    if n > WINDOW:
        grams = list(zip(*(words[k:] for k in range(WINDOW)), strict=False))
        seen = Counter(grams)
        if len(seen) < len(grams):
            end = 0
            for i, g in enumerate(grams):
                if seen[g] > 1:
                    repeated += i + WINDOW - max(i, end)
                    end = i + WINDOW
    lines = [x for x in text.split("\n") if x.strip(SPACE)] if n else []
    return (
        n, len(text) - sum(map(text.count, SPACE)), sum(map(text.count, SYMBOLS)), len(lines) - len(set(lines)),
        repeated, len(lines), len(raw) - len(raw.translate(None, b"ABCDEFGHIJKLMNOPQRSTUVWXYZ")), text.count("!"),
    )


def failed_bits() -> Column:
    out = F.lit(0).cast("long")
    for bit, condition in enumerate(RULES.values()):
        out = out.bitwiseOR(F.when(F.expr(condition), F.lit(1 << bit)).otherwise(F.lit(0)).cast("long"))
    return out


def ledger(docs: DataFrame) -> DataFrame:
    """doc_id, the measurements, failed_bits: one row for every row of ``docs``.

    A null text has no words. Empty tables give no rows, repeated rows each
    give one, other columns are not read.
    """

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            cols = list(zip(*map(measure, batch.column(1).to_pylist()), strict=True)) or [()] * len(MEASURES)
            yield pa.RecordBatch.from_arrays([batch.column(0), *(pa.array(c, pa.int64()) for c in cols)], ["doc_id", *MEASURES])

    kind = docs.schema["doc_id"].dataType.simpleString()
    out = docs.select("doc_id", "text").mapInArrow(run, f"doc_id {kind}, " + ", ".join(f"{m} long" for m in MEASURES))
    return out.withColumn("failed_bits", failed_bits())


def fails(policy: str) -> Column:
    """Whether a row of the ledger fails a policy."""
    return F.col("failed_bits").bitwiseAND(F.lit(mask(policy))) != 0


def ablations(rows: DataFrame, policy: str = CURRENT) -> DataFrame:
    """rule, n_failed, n_only: documents that fail each rule, and that fail no other rule of the policy.

    Documents with equal bits are counted together first, so what is compared
    is at most one row for each set of rules.
    """
    chosen = F.lit(mask(policy))
    sets = rows.groupBy(F.col("failed_bits").bitwiseAND(chosen).alias("bits")).agg(F.count("*").alias("n"))
    names = list(RULES)
    each = F.explode(F.array(*(F.struct(F.lit(r).alias("rule"), F.lit(1 << names.index(r)).cast("long").alias("bit")) for r in POLICIES[policy])))
    flat = sets.select("bits", "n", each.alias("r")).select("bits", "n", "r.*")
    return flat.groupBy("rule").agg(
        F.sum(F.when(F.col("bits").bitwiseAND(F.col("bit")) != 0, F.col("n")).otherwise(0)).alias("n_failed"),
        F.sum(F.when(F.col("bits") == F.col("bit"), F.col("n")).otherwise(0)).alias("n_only"),
    )
