"""Language identification with hyperdimensional profiles.

Every letter has a random vector of +1 and -1. An n-gram is bound from its
letters: the vectors are permuted (rolled by the letter's place) and multiplied.
A document bundles its n-grams, each as often as it occurs; a language's
prototype bundles its documents. The prediction is the language whose
prototype, with what all prototypes share taken out, has the greatest cosine
with the document.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from corvane.llm.common import unused
from corvane.llm.learn import bounded_sample, held_out

DIM = 512
N = 3
MOD, REST = 4, 2
UNKNOWN = "und"
TRAIN_ROWS = 20_000
SHARPNESS = 40.0
GROUP = 1 << 18
_BITS = 21


def letter_vectors(codes: np.ndarray) -> np.ndarray:
    """+1/-1 vectors of code points, computed from the code point alone (splitmix64), so all workers agree."""
    with np.errstate(over="ignore"):
        x = (codes.astype(np.uint64)[:, None] + np.uint64(1)) * np.uint64(0x9E3779B97F4A7C15) + np.arange(DIM // 64, dtype=np.uint64)[None, :] * np.uint64(0xD1B54A32D192ED03)
        x = (x ^ (x >> np.uint64(30))) * np.uint64(0xBF58476D1CE4E5B9)
        x = (x ^ (x >> np.uint64(27))) * np.uint64(0x94D049BB133111EB)
        x ^= x >> np.uint64(31)
    bits = np.unpackbits(x.view(np.uint8), axis=1, bitorder="little")
    return (bits.astype(np.int8) << 1) - 1


def gram_vectors(grams: np.ndarray) -> np.ndarray:
    """Bound vectors of packed n-grams."""
    out = None
    for place in range(N):
        codes, at = np.unique((grams >> np.int64(_BITS * (N - 1 - place))) & np.int64((1 << _BITS) - 1), return_inverse=True)
        rolled = np.roll(letter_vectors(codes), N - 1 - place, axis=1)[at]
        out = rolled if out is None else out * rolled
    return out


def letters(text: str) -> str:
    """Lower-case letters in words, with one space between and around them; empty if there is no letter."""
    kept = "".join(c if c.isalpha() else " " for c in text.lower()) if not text.isascii() else text.lower().translate(_ASCII)
    return f" {' '.join(words)} " if (words := kept.split()) else ""


_ASCII = {c: " " for c in range(128) if not chr(c).isalpha()}


def _groups(texts: list[str | None]) -> Iterator[tuple[list[int], np.ndarray, np.ndarray]]:
    """Documents in groups of bounded length: their places, all n-grams packed, and whose they are.

    A text beyond the bound comes in several pieces (its place is repeated), so
    that memory doesn't follow the longest text.
    """
    places: list[int] = []
    grams: list[np.ndarray] = []
    size = 0
    for i, t in enumerate(texts):
        s = letters(t or "")
        if not s:
            continue
        codes = np.frombuffer(s.encode("utf-32-le"), dtype=np.uint32).astype(np.int64)
        packed = codes[:-2] << np.int64(2 * _BITS) | codes[1:-1] << np.int64(_BITS) | codes[2:]
        for lo in range(0, len(packed), GROUP):
            part = packed[lo : lo + GROUP]
            places.append(i)
            grams.append(part)
            size += len(part)
            if size >= GROUP or len(places) >= 256:
                yield places, np.concatenate(grams), np.repeat(np.arange(len(places)), [len(g) for g in grams])
                places, grams, size = [], [], 0
    if places:
        yield places, np.concatenate(grams), np.repeat(np.arange(len(places)), [len(g) for g in grams])


def bundles(texts: list[str | None]) -> np.ndarray:
    """One bundled vector for each text; zeros where there is no letter."""
    out = np.zeros((len(texts), DIM), dtype=np.float32)
    for places, grams, owner in _groups(texts):
        kinds, at = np.unique(grams, return_inverse=True)
        for lo in range(0, len(kinds), 8192):  # of n-grams at a time
            inside = (at >= lo) & (at < lo + 8192) if len(kinds) > 8192 else slice(None)
            width = min(8192, len(kinds) - lo)
            counts = np.bincount(owner[inside] * width + at[inside] - lo, minlength=len(places) * width).reshape(len(places), width).astype(np.float32)
            np.add.at(out, places, counts @ gram_vectors(kinds[lo : lo + width]).astype(np.float32))
    return out


def train(docs: DataFrame, train_rows: int = TRAIN_ROWS) -> tuple[list[str], np.ndarray]:
    """Language names in order, and their prototypes: unit vectors without the shared part.

    Learns from at most about ``train_rows`` documents (a documented bound,
    chosen by a hash) that have a text and a language and aren't held out. The
    documents' vectors, each scaled to unit length, are summed on the
    executors; the driver gets one vector for each language. An empty table
    gives a model without languages. Repeated rows count each time.
    """
    usable = docs.where(F.col("lang").isNotNull() & F.col("doc_id").isNotNull() & ~held_out(MOD, REST))
    ids = bounded_sample(usable.select("doc_id", "lang", "text"), train_rows)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        sums: dict[str, np.ndarray] = {}
        for batch in batches:
            vectors = bundles(batch.column(1).to_pylist())
            norms = np.linalg.norm(vectors, axis=1, keepdims=True)
            vectors = np.rint(vectors / np.maximum(norms, 1e-9) * 10000).astype(np.int64)  # whole numbers: sums don't depend on the order
            for lang, v in zip(batch.column(0).to_pylist(), vectors, strict=True):
                sums[lang] = sums[lang] + v if lang in sums else v
        yield pa.RecordBatch.from_arrays([pa.array(list(sums), pa.string()), pa.array([v.tolist() for v in sums.values()], pa.list_(pa.int64()))], ["lang", "v"])

    parts = ids.select(F.col("lang").cast("string"), "text").mapInArrow(run, "lang string, v array<bigint>")
    summed = parts.select("lang", F.posexplode("v")).groupBy("lang", "pos").agg(F.sum("col").alias("x")).collect()
    names = sorted({r.lang for r in summed})
    protos = np.zeros((len(names), DIM))
    for r in summed:
        protos[names.index(r.lang), r.pos] = r.x
    protos /= np.maximum(np.linalg.norm(protos, axis=1, keepdims=True), 1e-9)
    if len(names) > 1:
        protos -= protos.mean(axis=0)
        protos /= np.maximum(np.linalg.norm(protos, axis=1, keepdims=True), 1e-9)
    return names, protos.astype(np.float32)


def predict(texts: list[str | None], names: list[str], protos: np.ndarray) -> tuple[list[str], list[float]]:
    """The language of each text and a confidence from 0 to 1 (a softmax over the cosines)."""
    vectors = bundles(texts)
    norms = np.linalg.norm(vectors, axis=1)
    if not names:
        return [UNKNOWN] * len(texts), [0.0] * len(texts)
    cosine = (vectors @ protos.T) / np.maximum(norms, 1e-9)[:, None]
    e = np.exp(SHARPNESS * (cosine - cosine.max(axis=1, keepdims=True)))
    best = cosine.argmax(axis=1)
    score = e[np.arange(len(texts)), best] / e.sum(axis=1)
    some = norms > 0
    return [names[b] if s else UNKNOWN for b, s in zip(best, some, strict=True)], [float(x) if s else 0.0 for x, s in zip(score, some, strict=True)]


def of_text(model: tuple[list[str], np.ndarray], text: Column) -> Column:
    """struct<lang, score>: the predicted language of a text.

    ``und`` with score 0 for a text that is null or has no letter, and for all
    texts if nothing could be learned. Ties go to the language first in order.
    """
    names, protos = model

    @F.arrow_udf("struct<lang: string, score: double>")
    def of(texts: pa.Array) -> pa.Array:
        lang, value = predict(texts.to_pylist(), names, protos)
        return pa.StructArray.from_arrays([pa.array(lang, pa.string()), pa.array(value, pa.float64())], ["lang", "score"])

    return of(text)


def confident(docs: DataFrame, model: tuple[list[str], np.ndarray], least: float) -> DataFrame:
    """The rows of ``docs`` whose language is told with a score of at least ``least``; their columns stay as they are, whatever their names."""
    held = unused("__language", docs)
    found = docs.withColumn(held, of_text(model, F.col("text")))
    return found.where((F.col(held)["lang"] != UNKNOWN) & (F.col(held)["score"] >= least)).drop(held)


def identify(docs: DataFrame, model: tuple[list[str], np.ndarray]) -> DataFrame:
    """doc_id, held_out, lang_pred, score for every row of ``docs``.

    Only doc_id (null: not held out) and text are read; doc_id decides held_out
    and nothing else. Repeated rows each give a row; an empty table gives none;
    a text of any length is read whole.
    """
    found = docs.select("doc_id", of_text(model, F.col("text")).alias("found"))
    return found.select("doc_id", held_out(MOD, REST).alias("held_out"), F.col("found.lang").alias("lang_pred"), F.col("found.score").alias("score"))
