"""Benchmark decontamination by a broadcast hash set of n-grams, in DataFrame functions only.

A benchmark item gives one window for every ``n`` consecutive words, or one
window if it has fewer. A document's words are hashed once; its positions are
exploded, and the 64-bit key of the window at each position is looked up in the
broadcast hash set. Explode, key, lookup and the check that follows it are one
generated loop over the document's arrays: no window is ever built as text,
but for those whose key is in the set, which are compared word for word. Only
hits, and one row per document, are shuffled.

The hash set is broadcast only after its size has been measured (``max_windows``
rows and ``max_bytes`` of text). Beyond that the same lookup runs as a shuffled
join, for those windows only whose key is in a bitmap of 2**30 bits (at most
128 MB, broadcast).
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from corvane.llm.common import ascii_lower, materialise, small_or_shuffled

WORD = r"[^\x00-\x2F\x3A-\x60\x7B-\x7F]+"
GAP = r"\x00-\x2F\x3A-\x40\x5B-\x60\x7B-\x7F"
BITS = 30


def words(text: Column) -> Column:
    return F.array_remove(F.split(ascii_lower(F.coalesce(text, F.lit(""))), f"[{GAP}]+"), "")


def hashes(array: Column) -> Column:
    return F.transform(array, lambda w: F.xxhash64(w))


def window_key(hashed: Column, pos: Column, n: Column, most: int) -> Column:
    """Key of the ``n`` (``most`` at most) words from ``pos``: a hash of their hashes."""
    return F.xxhash64(*[F.when(n > k, F.get(hashed, pos + k)) for k in range(most)])


def window_text(array: Column, pos: Column, n: Column) -> Column:
    return F.array_join(F.slice(array, F.greatest(pos, F.lit(0)) + 1, n), " ")


def benchmark_windows(bench: DataFrame, n: int = 10) -> DataFrame:
    """(key, gram, n_gram, items): each different window once, with the sorted ids of its items."""
    w = bench.select(F.col("item_id").cast("string").alias("item"), words(F.col("text")).alias("w")).where(F.size("w") > 0)
    length = F.least(F.size("w"), F.lit(n))
    rows = w.select("item", "w", hashes(F.col("w")).alias("h"), length.alias("n_gram"), F.explode(F.sequence(F.lit(0), F.size("w") - length)).alias("pos"))
    rows = rows.select("item", "n_gram", window_key(F.col("h"), F.col("pos"), F.col("n_gram"), n).alias("key"), window_text(F.col("w"), F.col("pos"), F.col("n_gram")).alias("gram"))
    return rows.groupBy("key", "gram", "n_gram").agg(F.array_sort(F.collect_set("item")).alias("items"))


def _mark() -> Column:
    """Tells rows with the same id and different texts apart."""
    return F.xxhash64("text", F.col("text").isNull())


def hits(docs: DataFrame, bench: DataFrame, n: int = 10, max_windows: int = 1_000_000, max_bytes: int = 128 << 20) -> DataFrame:
    """One row per (doc_id, text) of ``docs`` with its number of equal rows, its words and its hits.

    Columns: doc_id, mark (hash of the text), copies, n_words, places (array of
    struct<pos, n>, words counted from 0), items (sorted distinct item ids).
    """
    grams = materialise(benchmark_windows(bench, n), "windows")
    size = grams.agg(F.count("*").alias("rows"), F.coalesce(F.sum(F.octet_length("gram") + 32 + 16 * F.size("items")), F.lit(0)).alias("bytes"), F.collect_set("n_gram").alias("lengths")).first()
    fits = size["rows"] <= max_windows and size["bytes"] <= max_bytes
    lengths = sorted(size["lengths"]) or [n]
    most = lengths[-1]
    base = docs.select("doc_id", _mark().alias("mark"), words(F.col("text")).alias("w"))
    base = base.select("doc_id", "mark", "w", hashes(F.col("w")).alias("h"), F.size("w").alias("n_words"))
    # Place -1 stands for the document itself, so that each has a row.
    rows = base.select("*", F.explode(F.sequence(F.lit(-1), F.greatest(F.col("n_words") - lengths[0], F.lit(-1)))).alias("pos"))
    rows = rows.select("*", F.lit(most).alias("n")) if len(lengths) == 1 else rows.select("*", F.explode(F.array(*map(F.lit, lengths))).alias("n"))
    own = (F.col("pos") < 0) & (F.col("n") == most)
    rows = rows.where(own | ((F.col("pos") >= 0) & (F.col("pos") + F.col("n") <= F.col("n_words"))))
    rows = rows.withColumn("key", F.when(F.col("pos") >= 0, window_key(F.col("h"), F.col("pos"), F.col("n"), most)))
    text = window_text(F.col("w"), F.col("pos"), F.col("n"))
    side = grams.select(F.col("key").alias("b_key"), F.col("gram").alias("b_gram"), "items")
    if fits:
        # Two inequalities, because an equality would become a second join key, and the text would be built for every window.
        same = (text <= F.col("b_gram")) & (text >= F.col("b_gram"))
        joined = rows.join(F.broadcast(side), F.col("key") == F.col("b_key"), "left").where((F.col("pos") < 0) | (F.col("items").isNotNull() & same))
    else:
        bit = F.shiftrightunsigned("b_key", 64 - BITS)
        bitmap = side.groupBy(F.bitmap_bucket_number(bit).alias("bucket")).agg(F.bitmap_construct_agg(F.bitmap_bit_position(bit)).alias("bitmap"))
        at = F.shiftrightunsigned("key", 64 - BITS)
        place = F.bitmap_bit_position(at)
        byte = F.conv(F.hex(F.substring(F.col("bitmap"), F.floor(place / 8).cast("int") + 1, F.lit(1))), 16, 10).cast("int")
        rows = rows.join(F.broadcast(bitmap), F.bitmap_bucket_number(at) == F.col("bucket"), "left")
        rows = rows.where((F.col("pos") < 0) | (F.getbit(byte, (place % 8).cast("int")) == 1))
        # Rows that stand for documents get keys that spread them.
        rows = rows.select("doc_id", "mark", "n_words", "pos", "n", F.coalesce("key", F.xxhash64("doc_id", "mark")).alias("key"), F.when(F.col("pos") >= 0, text).alias("gram"))
        joined = rows.join(side.hint("merge"), (F.col("key") == F.col("b_key")) & (F.col("gram") == F.col("b_gram")), "left")
    found = joined.where("pos < 0 or items is not null")
    return found.groupBy("doc_id", "mark").agg(
        F.sum((F.col("pos") < 0).cast("long")).alias("copies"),
        F.max("n_words").cast("long").alias("n_words"),
        F.collect_set(F.when(F.col("pos") >= 0, F.struct("pos", "n"))).alias("places"),
        F.array_sort(F.array_distinct(F.flatten(F.collect_set("items")))).alias("items"),
    )


def hit_words(places: Column) -> Column:
    """Sorted distinct word positions inside any place."""
    spread = F.flatten(F.transform(places, lambda x: F.sequence(x["pos"], x["pos"] + x["n"] - 1)))
    return F.array_sort(F.array_distinct(spread))


def report(docs: DataFrame, bench: DataFrame, n: int = 10, **limits: int) -> DataFrame:
    """doc_id, n_words, n_hit, n_items, items_sha256, contaminated for every row of ``docs``.

    A null or empty text has no words and no hits; repeated rows each give a
    row; an empty benchmark leaves every document clean; a null item id counts
    as no item but its windows still hit; null item texts have no windows.
    Other columns of either table are not read.
    """
    found = hits(docs, bench, n, **limits)
    n_hit = F.size(hit_words(F.col("places"))).cast("long")
    out = found.select(
        "doc_id", "n_words", n_hit.alias("n_hit"), F.size("items").cast("long").alias("n_items"),
        F.sha2(F.array_join("items", ","), 256).alias("items_sha256"), "copies",
    )
    out = out.withColumn("contaminated", F.col("n_hit") > 0).withColumn("copy", F.explode(F.sequence(F.lit(1), F.col("copies"))))
    return out.drop("copies", "copy")


def clean(docs: DataFrame, bench: DataFrame, n: int = 10, mode: str = "documents", **limits: int) -> DataFrame:
    """``docs`` without its contaminated documents, or (``mode="spans"``) without the hit words.

    Columns and order of columns stay, whatever their names. A row is known by
    its id (null like any other) and text; repeated rows go or stay together. A
    null or empty text stays as it is. In span mode a hit word goes together
    with the separators that follow it; ``n_chars``, where there is one, is
    counted anew for the texts that changed.
    """
    mark, row = "__mark", "__row"
    bad = hits(docs, bench, n, **limits).where(F.size("places") > 0)
    bad = bad.select(F.col("doc_id").alias("__id"), F.col("mark").alias("__bad"), *([F.col("places").alias("__places")] if mode != "documents" else []))
    bad = materialise(bad, "contaminated")
    held = docs.select(F.struct(*[F.col(c) for c in docs.columns]).alias(row), F.col("doc_id").alias("__doc"), _mark().alias(mark))
    on = F.col("__doc").eqNullSafe(F.col("__id")) & (F.col(mark) == F.col("__bad"))
    if mode == "documents":
        return held.join(small_or_shuffled(bad), on, "left_anti").select(f"{row}.*")
    joined = held.join(small_or_shuffled(bad), on, "left")
    text = F.col(row)["text"]
    parts = F.regexp_extract_all(text, F.lit(f"[^{GAP}]+[{GAP}]*"), F.lit(0))
    head = F.regexp_extract(text, f"^[{GAP}]*", 0)
    joined = joined.withColumn("__gone", hit_words(F.col("__places")))
    left = F.array_except(F.when(F.size(parts) > 0, F.sequence(F.lit(0), F.size(parts) - 1)).otherwise(F.array().cast("array<int>")), F.col("__gone"))
    kept = F.transform(left, lambda i: F.get(parts, i))
    new = F.when(F.col("__places").isNull(), text).otherwise(F.concat(head, F.array_join(kept, "")))
    changed = {"text": new}
    if "n_chars" in docs.columns:
        changed["n_chars"] = F.when(F.col("__places").isNull(), F.col(row)["n_chars"]).otherwise(F.length(new)).cast(docs.schema["n_chars"].dataType)
    return joined.select(*[changed.get(c, F.col(row)[c]).alias(c) for c in docs.columns])
