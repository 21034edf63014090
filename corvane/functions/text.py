"""Scalar text functions as Spark columns.

White space is spelled out as a character class, because regular-expression
engines disagree about ``\\s``; the class equals that of Python strings.
"""

from __future__ import annotations

import html
from collections.abc import Callable

import pyarrow as pa
from pyspark.sql import Column
from pyspark.sql import functions as F

#: Inside of a character class.
WS = r"\t-\r\x1c-\x20\x{85}\x{a0}\x{1680}\x{2000}-\x{200a}\x{2028}\x{2029}\x{202f}\x{205f}\x{3000}"
LINE_SPACE = r"\t \x{a0}\x{2000}-\x{200a}\x{202f}\x{205f}\x{3000}"
LINE_BREAK = r"\r\n|[\n\x0b\x0c\r\x1c-\x1e\x{85}\x{2028}\x{2029}]"
# Characters without width; limits of model answers.
ZERO_WIDTH = "​‌‍‎‏⁠⁡⁢⁣⁤﻿"
MAX_RESPONSE_CHARS = 50_000
REPETITION_WORDS, REPETITION_SHARE, SHINGLE, SHINGLE_REPEATS = 120, 0.18, 8, 12


def strip(c: Column) -> Column:
    return F.regexp_replace(c, f"^[{WS}]+|[{WS}]+$", "")


def squeeze(c: Column) -> Column:
    """Every run of white space as one space, none at the ends."""
    return strip(F.regexp_replace(c, f"[{WS}]+", " "))


def decode_entities(c: Column, passes: int = 2) -> Column:
    """Character references decoded, so many times over. Spark has no such function: an Arrow batch function."""

    @F.arrow_udf("string")
    def decode(texts: pa.Array) -> pa.Array:
        out = texts.to_pylist()
        for _ in range(passes):
            out = [t if t is None or "&" not in t else html.unescape(t) for t in out]
        return pa.array(out, pa.string())

    return decode(c)


def strip_zero_width(c: Column) -> Column:
    return F.translate(c, ZERO_WIDTH, "")


def collapse_whitespace(c: Column) -> Column:
    return F.regexp_replace(F.regexp_replace(c, f"[{LINE_SPACE}]+", " "), r"\n{3,}", "\n\n")


def normalise_plain(c: Column) -> Column:
    """What a model gets to read, of a text without character references."""
    return strip(collapse_whitespace(strip_zero_width(c)))


def normalise(c: Column) -> Column:
    return normalise_plain(decode_entities(c, 2))


def content_free(normalised: Column) -> Column:
    return ~normalised.rlike(r"[\p{L}\p{N}]")


def is_trash(decoded: Column) -> Column:
    """No character but marks, controls and separators."""
    return strip(decoded).rlike(r"^[\p{Cc}\p{Cf}\p{M}\p{Z}]*$")


def signal_kind(decoded: Column) -> Column:
    """blank, list_marker, bridge or content, of a text without character references."""
    seen = strip(collapse_whitespace(F.regexp_replace(decoded, r"[\p{C}\p{Zl}\p{Zp}]", "")))
    marker, bridge = r"^(\d{1,3}|[a-zA-Z]|[ivxIVX]{1,5})[.)]$", rf"^[^\p{{L}}\p{{N}}_{WS}.!?…]{{1,5}}$"
    return F.when(seen.rlike(marker), "list_marker").when(seen.rlike(bridge), "bridge").when(seen.rlike(r"[\p{L}\p{N}]"), "content").otherwise("blank")


def label_parts(raw: Column) -> Column:
    """A label path: levels at > and :, white space squeezed, empty levels left out."""
    levels = F.flatten(F.transform(F.split(raw, ">"), lambda x: F.split(x, ":")))
    return F.filter(F.transform(levels, squeeze), lambda x: x != "")


def label_key(label: Column) -> Column:
    """Levels reduced to lower-case letters a-z and digits, for comparing labels."""
    return F.transform(label, lambda x: F.regexp_replace(F.lower(x), "[^a-z0-9]", ""))


def name_key(name: Column) -> Column:
    return F.lower(squeeze(name))


def fit_text(c: Column, most: int) -> Column:
    """Head and tail around an ellipsis, if the text is too long."""
    if most <= 1:
        return F.substring(c, 1, most)
    head = (most - 1 + 1) // 2
    tail = most - 1 - head
    short = F.concat(F.substring(c, 1, head), F.lit("…"), F.right(c, F.lit(tail)) if tail else F.lit(""))
    return F.when(F.length(c) <= most, c).otherwise(short)


def estimate_tokens(c: Column) -> Column:
    return F.ceil(F.greatest(F.length(c) / 2, F.octet_length(c) / 3) * 1.1).cast("long")


def bound(value: Column, use: Callable[[Column], Column]) -> Column:
    """``use(value)`` with ``value`` computed once, also where a lambda inside uses it again and again."""
    return F.get(F.transform(F.array(value), use), F.lit(0))


def looks_repetitive(c: Column) -> Column:
    """Few different words among many, or a shingle that comes again and again."""

    def of_shingles(sorted_shingles: Column) -> Column:
        # In sorted order a shingle that occurs often enough equals the one so many places on.
        last = F.size(sorted_shingles) - SHINGLE_REPEATS
        places = F.when(last >= 0, F.sequence(F.lit(0), last)).otherwise(F.array().cast("array<int>"))
        return F.exists(places, lambda i: F.get(sorted_shingles, i) == F.get(sorted_shingles, i + SHINGLE_REPEATS - 1))

    def of_words(words: Column) -> Column:
        n = F.size(words)
        starts = F.sequence(F.lit(1), n - SHINGLE + 1)
        shingles = F.array_sort(F.transform(starts, lambda i: F.array_join(F.slice(words, i, SHINGLE), " ")))
        few = F.size(F.array_distinct(words)) / n < REPETITION_SHARE
        return F.when(n < REPETITION_WORDS, False).when(few, True).otherwise(bound(shingles, of_shingles))

    return bound(F.regexp_extract_all(F.lower(c), F.lit(r"[a-z0-9#.+-]+"), F.lit(0)), of_words)


def response_error(c: Column, most: int = MAX_RESPONSE_CHARS) -> Column:
    """Why a model's answer is rejected; null if it isn't."""
    clean = strip(F.coalesce(c, F.lit("")))
    return F.when(clean == "", "empty response").when(F.length(clean) > most, "response too long").when(looks_repetitive(clean), "repetitive response")


def strip_reasoning(c: Column) -> Column:
    return strip(F.regexp_replace(c, r"(?is)<think\b[^>]*>.*?</think>", ""))


def reasoning(c: Column) -> Column:
    return F.transform(F.regexp_extract_all(c, F.lit(r"(?is)<think\b[^>]*>(.*?)</think>"), F.lit(1)), strip)
