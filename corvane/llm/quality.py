"""Quality classifier as a sparse rule ensemble.

Small boosted trees are grown over text statistics. Every path from a root to a
node is a rule, a conjunction of thresholds. A logistic model with a lasso
penalty picks few of the rules and weighs them. The chosen rules are compiled
into one Spark column expression over the statistics, so scoring a table is a
projection.
"""

from __future__ import annotations

from collections import Counter
from typing import NamedTuple

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from corvane.llm.common import unused
from corvane.llm.learn import held_out, labelled_ids
from corvane.llm.rules import SPACE, WINDOW

MOD, REST = 5, 0
TRAIN_ROWS = 20_000
THRESHOLD = 0.3
SYMBOLS = "#*$%&|<>"
STATISTICS = (
    "n_words", "word_length", "symbols", "capitals", "bangs", "bars", "same_words", "stutter",
    "same_lines", "commas", "stops", "digits", "repeats", "line_words", "top_word",
)

Rule = tuple[tuple[str, str, float], ...]


class Model(NamedTuple):
    """Intercept, and the rules with their weights."""

    intercept: float
    rules: tuple[tuple[Rule, float], ...]


def statistics(text: str | None) -> tuple[float, ...]:
    """Statistics of a whole text, in the order of ``STATISTICS``; zeros for a text without words."""
    text = text or ""
    raw = text.encode()
    words = raw.split()
    n = len(words)
    if not n:
        return (0.0,) * len(STATISTICS)
    chars = len(text) - sum(map(text.count, SPACE))
    counts = Counter(words)
    lines = [x for x in text.split("\n") if x.strip(SPACE)]
    repeated = 0
    if n > WINDOW:
        grams = list(zip(*(words[k:] for k in range(WINDOW)), strict=False))
        repeated = len(grams) - len(set(grams))
    capitals = len(raw) - len(raw.translate(None, b"ABCDEFGHIJKLMNOPQRSTUVWXYZ"))
    digits = len(raw) - len(raw.translate(None, b"0123456789"))
    return (
        float(n), chars / n, sum(map(text.count, SYMBOLS)) / n, capitals / chars, text.count("!") / n, text.count("|") / n, 1 - len(counts) / n,
        sum(a == b for a, b in zip(words, words[1:], strict=False)) / n, 1 - len(set(lines)) / len(lines), text.count(",") / n, text.count(".") / n,
        digits / chars, repeated / n, n / len(lines), max(counts.values()) / n,
    )


def of_text(text: Column) -> Column:
    """A struct of the statistics of a text."""

    @F.arrow_udf("struct<" + ", ".join(f"{s}: double" for s in STATISTICS) + ">")
    def of(texts: pa.Array) -> pa.Array:
        cols = list(zip(*map(statistics, texts.to_pylist()), strict=True)) or [()] * len(STATISTICS)
        return pa.StructArray.from_arrays([pa.array(c, pa.float64()) for c in cols], list(STATISTICS))

    return of(text)


def _sigmoid(z: np.ndarray) -> np.ndarray:
    return 1 / (1 + np.exp(-np.clip(z, -35, 35)))


def tree_rules(x: np.ndarray, y: np.ndarray, trees: int = 24, depth: int = 3, bins: int = 32, rate: float = 0.3) -> list[Rule]:
    """Rules on the paths of gradient-boosted trees, each once, in the order in which they are met."""
    edges = [np.unique(np.quantile(c, np.linspace(0, 1, bins + 1)[1:-1])) for c in x.T]
    codes = np.stack([np.searchsorted(e, c, side="left") for e, c in zip(edges, x.T, strict=True)], axis=1)  # code k: above edge k-1, not above edge k
    margin, out = np.full(len(y), np.log((y.mean() + 1e-3) / (1 - y.mean() + 1e-3))), {}
    least = max(5, len(y) // 500)
    for _ in range(trees):
        p = _sigmoid(margin)
        grad, hess = y - p, p * (1 - p)
        nodes: list[tuple[Rule, np.ndarray]] = [((), np.arange(len(y)))]
        for level in range(depth + 1):
            nxt = []
            for path, rows in nodes:
                g, h = grad[rows].sum(), hess[rows].sum()
                best = (1e-3, None)
                if level < depth:
                    for f, e in enumerate(edges):
                        c = codes[rows, f]
                        gl, hl, nl = (np.bincount(c, weights=w, minlength=len(e) + 1)[:-1].cumsum() for w in (grad[rows], hess[rows], np.ones(len(rows))))
                        gain = gl**2 / (hl + 1) + (g - gl) ** 2 / (h - hl + 1) - g**2 / (h + 1)
                        gain[(nl < least) | (len(rows) - nl < least)] = 0
                        if len(gain) and gain.max() > best[0]:
                            best = (gain.max(), (f, int(gain.argmax())))
                if best[1] is None:
                    margin[rows] += rate * g / (h + 1)
                    continue
                f, k = best[1]
                low = codes[rows, f] <= k
                for side, op in ((low, "<="), (~low, ">")):
                    rule = (*path, (STATISTICS[f], op, float(edges[f][k])))
                    out.setdefault(tuple(sorted(rule)), rule)
                    nxt.append((rule, rows[side]))
            nodes = nxt
    return list(out)


def rule_matrix(rules: list[Rule], x: np.ndarray) -> np.ndarray:
    out = np.ones((len(x), len(rules)))
    for j, rule in enumerate(rules):
        for name, op, value in rule:
            c = x[:, STATISTICS.index(name)]
            out[:, j] *= c <= value if op == "<=" else c > value
    return out


def lasso(r: np.ndarray, y: np.ndarray, penalty: float = 2e-3, steps: int = 400) -> tuple[float, np.ndarray]:
    """Intercept and weights of a logistic model with an L1 penalty, by accelerated proximal gradient steps."""
    n = len(y)
    mean = r.mean(axis=0)
    c = r - mean
    step = 4 * n / (np.linalg.norm(c, 2) ** 2 + n)
    w, b = np.zeros(r.shape[1]), float(np.log((y.mean() + 1e-3) / (1 - y.mean() + 1e-3)))
    v, vb, t = w, b, 1.0
    for _ in range(steps):
        err = _sigmoid(c @ v + vb) - y
        nw = v - step * (c.T @ err) / n
        nw = np.sign(nw) * np.maximum(np.abs(nw) - step * penalty, 0)
        nb = vb - step * err.mean()
        nt = (1 + np.sqrt(1 + 4 * t * t)) / 2
        v, vb = nw + (t - 1) / nt * (nw - w), nb + (t - 1) / nt * (nb - b)
        w, b, t = nw, nb, nt
    return float(b - mean @ w), w


def fit(docs: DataFrame, labels: DataFrame, train_rows: int = TRAIN_ROWS) -> Model:
    """Learn from at most about ``train_rows`` labelled rows that aren't held out.

    The driver gets their statistics, never a text. With no labelled rows, or
    labels of one kind, the model is a constant. An id with several labels has
    the greatest; of ties between thresholds the first is taken.
    """
    ids = labelled_ids(labels, "quality", MOD, REST, train_rows)
    bounded = docs.select("doc_id", "text").join(F.broadcast(ids), "doc_id", "left_semi")  # at most about train_rows ids
    rows = bounded.select("doc_id", of_text(F.col("text")).alias("found")).join(F.broadcast(ids), "doc_id").select("doc_id", "y", "found.*").collect()
    data = np.array(sorted(tuple(r) for r in rows), dtype=float).reshape(len(rows), 2 + len(STATISTICS))
    y, x = (data[:, 1] > 0).astype(float), data[:, 2:]
    if not len(y):
        return Model(0.0, ())
    if y.min() == y.max():
        return Model(4.0 if y[0] else -4.0, ())
    rules = tree_rules(x, y)
    intercept, weights = lasso(rule_matrix(rules, x), y)
    return Model(intercept, tuple((r, float(w)) for r, w in zip(rules, weights, strict=True) if abs(w) > 1e-6))


def score(model: Model, found: Column) -> Column:
    """The model as a Spark column over a struct of statistics."""
    z = F.lit(model.intercept)
    for rule, weight in model.rules:
        holds = F.lit(True)
        for name, op, value in rule:
            holds &= found[name] <= value if op == "<=" else found[name] > value
        z += F.when(holds, F.lit(weight)).otherwise(F.lit(0.0))
    return F.lit(1.0) / (F.lit(1.0) + F.exp(-z))


def good(docs: DataFrame, model: Model) -> DataFrame:
    """The rows of ``docs`` that score THRESHOLD at least; their columns stay as they are, whatever their names."""
    held = unused("__statistics", docs)
    return docs.withColumn(held, of_text(F.col("text"))).where(score(model, F.col(held)) >= THRESHOLD).drop(held)


def classify(docs: DataFrame, model: Model) -> DataFrame:
    """doc_id, held_out, score, predicted for every row of ``docs``.

    Only doc_id (null: not held out) and text are read; doc_id decides held_out
    and nothing else. A null or empty text has all statistics zero and is scored
    like any other; texts of any length are read whole; repeated rows each give
    a row, with equal scores; an empty table gives none.
    """
    scored = docs.select("doc_id", of_text(F.col("text")).alias("found")).select("doc_id", score(model, F.col("found")).alias("score"))
    return scored.select("doc_id", held_out(MOD, REST).alias("held_out"), "score", (F.col("score") >= THRESHOLD).cast("int").alias("predicted"))
