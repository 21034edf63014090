"""Toxicity: a subsequence string-kernel SVM over short strings, with Nyström landmarks.

The strings are a document's words, cut free of punctuation inside them, with
runs of single letters put together ("i d i o t"). The kernel counts common
subsequences of three characters, each weighed by the length that it spans, so
insults with inserted or missing characters stay close to the plain ones. A
word starts with a boundary character that takes part in subsequences.

Training reads labelled texts as bags of strings: a clean text says that none of
its strings is toxic, a toxic one that some string is. The SVM is fitted in
turns: the strings of toxic bags that look toxic so far (at first those with
great odds of standing in toxic texts) are learned against the strings of clean
bags, and the bags' strings are judged anew, until none changes sides.
The Nyström map over landmark strings makes the kernel coordinates in which the
SVM is linear. A document is scored by a logistic model over the best string's
margin and how many strings are on the toxic side.

Only strings that share enough of a toxic landmark's character pairs (gaps of
one allowed) can be near it; a table lookup over all characters of a batch finds
those, and the kernel is computed for them alone. Every string learned as toxic
passes the lookup: one that doesn't becomes a landmark.

Fitting counts strings on the executors, over whole texts. The driver gets
counts of strings, a few numbers for each labelled text and the toxic bags'
candidate strings, never a text.
"""

from __future__ import annotations

import math
from collections import Counter
from collections.abc import Iterator
from typing import NamedTuple

import numpy as np
import pyarrow as pa
import xxhash
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from corvane.llm.common import discard, materialise
from corvane.llm.learn import held_out, labelled_ids

MOD, REST = 4, 2
THRESHOLD = 0.3
TRAIN_ROWS = 8_000
ORDER, DECAY = 3, 0.5
#: Strings that are learned from, and landmarks of clean strings.
TOXIC_STRINGS, CLEAN_STRINGS, HARD_STRINGS, CLEAN_LANDMARKS = 300, 900, 2500, 40
TURNS = 6
ALIKE = 0.4
PIECE, STRIDE = 32, 16
SHARE = 0.7
CHUNK = 1 << 20
FLOOR = -3.0
CACHE = 200_000

SPACE, DROP, KINDS = 0, 255, 64


def _classes() -> np.ndarray:
    """Character classes of the first plane: 0 white space, 255 dropped, 1-26 a-z (and digits that stand for them), 27-36 other digits, 37-63 other letters by code."""
    out = np.full(0x10000, DROP, dtype=np.uint8)
    for c in range(0x10000):
        ch = chr(c)
        if ch.isspace():
            out[c] = SPACE
        elif "a" <= ch <= "z":
            out[c] = c - 96
        elif "0" <= ch <= "9":
            out[c] = 27 + c - 48
        elif ch.isalnum():
            out[c] = 37 + c % 27
    for digit, letter in zip("013457", "oieast", strict=True):
        out[ord(digit)] = ord(letter) - 96
    return out


_CLASS = _classes()


def strings(texts: list[str | None]) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """All strings of some texts: their characters (each string after a 0), where each begins, and whose it is."""
    parts = [np.frombuffer((t or "").lower().encode("utf-32-le", "surrogatepass"), dtype=np.uint32) for t in texts]
    owner = np.repeat(np.arange(len(texts)), [len(p) + 1 for p in parts])
    codes = np.concatenate([np.r_[np.uint32(32), p] for p in parts]) if parts else np.zeros(0, np.uint32)
    kind = np.where(codes < 0x10000, _CLASS[np.minimum(codes, 0xFFFF)], 37 + codes % 27).astype(np.uint8)
    keep = kind != DROP
    kind, owner = kind[keep], owner[keep]
    new_text = np.r_[True, owner[1:] != owner[:-1]] if len(owner) else np.zeros(0, bool)
    # A space goes if it follows another one, or stands between two single letters of the same text.
    space = kind == SPACE
    keep = ~(space & np.r_[False, space[:-1]]) | new_text
    kind, owner, new_text = kind[keep], owner[keep], new_text[keep]
    at = np.flatnonzero(kind == SPACE)
    length = np.diff(np.r_[at, len(kind)]) - 1
    single = length == 1
    joined = np.zeros(len(kind), bool)
    joined[at[single & np.r_[False, single[:-1]] & ~new_text[at]]] = True
    kind, owner = kind[~joined], owner[~joined]
    at = np.flatnonzero(kind == SPACE)
    return kind, at, owner[at]


def cuts(starts: np.ndarray, ends: np.ndarray) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """Where pieces begin and end, and the number of each piece's string: strings longer than PIECE in overlapping pieces."""
    long = ends - starts > PIECE
    count = np.where(long, np.maximum(1, -((starts + STRIDE - ends) // STRIDE)), 1)
    of = np.repeat(np.arange(len(starts)), count)
    nth = np.arange(len(of)) - np.repeat(count.cumsum() - count, count)
    lo = starts[of] + nth * STRIDE
    return lo, np.where(long[of], np.minimum(lo + PIECE, ends[of]), ends[of]), of


def pieces(kind: np.ndarray, starts: np.ndarray, ends: np.ndarray) -> tuple[list[bytes], np.ndarray]:
    """Strings as bytes (with the leading 0); longer ones than PIECE in overlapping pieces. Also the number of each piece's string."""
    raw = kind.tobytes()
    lo, hi, of = cuts(starts, ends)
    return [raw[x:y] for x, y in zip(lo.tolist(), hi.tolist(), strict=True)], of


def items_of(text: str | None) -> set[bytes]:
    """The different strings (pieces) of a text that are long enough to be learned from."""
    kind, starts, _ = strings([text])
    return {x for x in pieces(kind, starts, np.r_[starts[1:], len(kind)])[0] if len(x) >= 4}


def _padded(items: list[bytes], fill: int) -> np.ndarray:
    width = max(map(len, items), default=1)
    return np.frombuffer(b"".join(x.ljust(width, bytes([fill])) for x in items), dtype=np.uint8).reshape(len(items), width)


def kernel(left: list[bytes], right: list[bytes]) -> np.ndarray:
    """Gap-weighted subsequence kernel of order ORDER between all of ``left`` and all of ``right`` (not normalised)."""
    out = []
    t = _padded(right, 254)
    q = t.shape[1]
    run = np.tril(DECAY ** np.clip(np.subtract.outer(np.arange(q), np.arange(q)), 0, None)).T.astype(np.float32)
    for lo in range(0, len(left), 256):
        s = _padded(left[lo : lo + 256], 255)
        match = [(s[:, i, None, None] == t[None, :, :]).astype(np.float32) * np.float32(DECAY**2) for i in range(s.shape[1])]
        before = [np.ones((len(s), len(t), q), np.float32)] * (len(match) + 1)  # of prefixes s[:i], t[:j+1]
        for level in range(ORDER):
            acc, after = np.zeros((len(s), len(t), q), np.float32), []
            total = np.zeros((len(s), len(t)), np.float32)
            for i, m in enumerate(match):
                after.append(acc)
                shifted = np.concatenate([before[i][:, :, :1] * (level == 0), before[i][:, :, :-1]], axis=2)
                here = m * shifted
                if level == ORDER - 1:
                    total += here.sum(axis=2)
                else:
                    acc = DECAY * acc + here @ run
            before = [*after, acc]
        out.append(total)
    return np.concatenate(out) if out else np.zeros((0, len(right)), np.float32)


def self_kernel(items: list[bytes]) -> np.ndarray:
    return np.array([kernel([x], [x])[0, 0] for x in items], dtype=np.float32)


class Model(NamedTuple):
    toxic: tuple[bytes, ...]
    landmarks: tuple[bytes, ...]
    norms: np.ndarray
    weights: np.ndarray  # over normalised kernel values: the Nyström map and the SVM in one
    bias: float
    tables: np.ndarray
    need: np.ndarray
    calibration: tuple[float, ...]


def lookup_tables(toxic: tuple[bytes, ...]) -> tuple[np.ndarray, np.ndarray]:
    """For every pair of character classes the landmarks that have it, as eight one-byte counters in a word; and how many pairs a string must share."""
    lanes = math.ceil(len(toxic) / 8) * 8
    table, need = np.zeros((KINDS * KINDS, lanes), np.uint8), np.full(lanes, 255, np.int64)
    for k, word in enumerate(toxic):
        pairs = {a * KINDS + b for a, b in zip(word, word[1:], strict=False)}
        table[list(pairs), k] = 1
        need[k] = math.ceil(SHARE * len(pairs))
    return np.ascontiguousarray(table).view(np.uint64).T.copy(), need


def candidates(kind: np.ndarray, starts: np.ndarray, tables: np.ndarray, need: np.ndarray) -> np.ndarray:
    """Which strings have a piece that shares enough pairs with a toxic landmark, directly or over a gap of one character.

    A piece of at most PIECE characters counts at most twice as many pairs, so
    its one-byte counters can't overflow, however long the string is.
    """
    if not len(starts) or not len(tables):
        return np.zeros(len(starts), bool)
    k = np.append(kind, [SPACE, SPACE]).astype(np.int64)
    a, b, c = k[:-2] * KINDS, k[1:-1], k[2:]
    one = np.where(b != SPACE, a + b, 0)  # pair (0, 0) is in no landmark
    two = np.where((b != SPACE) & (c != SPACE), a + c, 0)
    lo, hi, of = cuts(starts, np.r_[starts[1:], len(kind)])
    bounds = np.stack([lo, hi], axis=1).ravel()
    lanes = []
    for t in tables:
        hits = np.append(t[one] + t[two], np.uint64(0))  # so that the end of the last piece is a place
        lanes.append(np.add.reduceat(hits, bounds)[::2])
    counts = np.stack(lanes, axis=1).view(np.uint8)
    out = np.zeros(len(starts), bool)
    out[of[(counts >= need).any(axis=1)]] = True
    return out


def passing(items: list[bytes], tables: np.ndarray, need: np.ndarray) -> np.ndarray:
    """Which of some pieces pass the lookup."""
    kind = np.frombuffer(b"".join(items), dtype=np.uint8)
    return candidates(kind, np.cumsum([0, *map(len, items[:-1])]), tables, need) if items else np.zeros(0, bool)


def margins(items: list[bytes], model: Model, cache: dict[bytes, float]) -> np.ndarray:
    """SVM margins of pieces."""
    new = list({x for x in items if x not in cache})
    if new:
        if len(cache) > CACHE:
            cache.clear()
            new = list(set(items))
        own = np.maximum(np.concatenate([_own(new[lo : lo + 4096]) for lo in range(0, len(new), 4096)]), 1e-12)
        values = (kernel(new, list(model.landmarks)) / np.sqrt(own)[:, None] / np.sqrt(model.norms)[None, :]) @ model.weights + model.bias
        cache.update(zip(new, values.tolist(), strict=True))
    return np.array([cache[x] for x in items], dtype=np.float64)


def _own(items: list[bytes]) -> np.ndarray:
    """Kernel of every string with itself, all at once."""
    s = _padded(items, 255)
    n, q = s.shape
    run = np.tril(DECAY ** np.clip(np.subtract.outer(np.arange(q), np.arange(q)), 0, None)).T.astype(np.float32)
    before = [np.ones((n, q), np.float32)] * (q + 1)
    total = np.zeros(n, np.float32)
    real = s != 255
    for level in range(ORDER):
        acc, after = np.zeros((n, q), np.float32), []
        for i in range(q):
            after.append(acc)
            m = ((s[:, i, None] == s) & real & real[:, i, None]) * np.float32(DECAY**2)
            here = m * np.concatenate([before[i][:, :1] * (level == 0), before[i][:, :-1]], axis=1)
            if level == ORDER - 1:
                total += here.sum(axis=1)
            else:
                acc = DECAY * acc + here @ run
        before = [*after, acc]
    return total


def features(texts: list[str | None], model: Model, cache: dict[bytes, float]) -> np.ndarray:
    """For each text: the best margin (FLOOR at least), the logarithms of the number of strings on the toxic side and of their summed excess margin, and their share."""
    out = np.zeros((len(texts), 4))
    out[:, 0] = FLOOR
    lo = 0
    while lo < len(texts):
        hi, size = lo, 0
        while hi < len(texts) and (hi == lo or size + len(texts[hi] or "") <= CHUNK):
            size += len(texts[hi] or "")
            hi += 1
        kind, starts, owner = strings(texts[lo:hi])
        chosen = np.flatnonzero(candidates(kind, starts, model.tables, model.need))
        if len(chosen):
            ends = np.r_[starts[1:], len(kind)][chosen]
            items, of = pieces(kind, starts[chosen], ends)
            value = np.full(len(chosen), FLOOR)
            np.maximum.at(value, of, margins(items, model, cache))
            who = owner[chosen] + lo
            np.maximum.at(out[:, 0], who, value)
            np.add.at(out[:, 1], who, value > 0)
            np.add.at(out[:, 3], who, np.maximum(value - 0.5, 0))
            words = np.bincount(owner, minlength=hi - lo)
            out[lo:hi, 2] = out[lo:hi, 1] / np.maximum(words, 1)
        lo = hi
    out[:, [1, 3]] = np.log1p(out[:, [1, 3]])
    return out


def _minima(text: str | None) -> list[int]:
    """Six minima of hashes over five-word shingles; near copies share some."""
    words = (text or "").encode().split()
    grams = np.array([xxhash.xxh64_intdigest(b" ".join(g)) for g in zip(*(words[k:] for k in range(5)), strict=False)] or [xxhash.xxh64_intdigest(b" ".join(words))], dtype=np.uint64)
    out = np.full(6, 2**64 - 1, np.uint64)
    for lo in range(0, len(grams), 1 << 16):
        with np.errstate(over="ignore"):
            mixed = (grams[lo : lo + (1 << 16), None] ^ (grams[lo : lo + (1 << 16), None] >> np.uint64(29))) * _MULT[None, :]
            mixed ^= mixed >> np.uint64(32)
            out = np.minimum(out, (mixed * _MULT[None, ::-1]).min(axis=0))
    return out.view(np.int64).tolist()


_MULT = np.random.default_rng(11).integers(1, 2**63, 6, dtype=np.uint64) | np.uint64(1)


def different(rows: list[list[int]]) -> list[int]:
    """Places of the rows of minima that share none with a row before."""
    seen: set[tuple[int, int]] = set()
    out = []
    for i, minima in enumerate(rows):
        keys = set(enumerate(minima))
        if not keys & seen:
            out.append(i)
        seen |= keys
    return out


def _svm(x: np.ndarray, y: np.ndarray, weight: np.ndarray, cost: float = 3000.0, steps: int = 60) -> tuple[np.ndarray, float]:
    """Linear SVM with squared hinge by Newton steps; each class has half of the weight."""
    weight = np.where(y > 0, weight / (2 * weight[y > 0].sum()), weight / (2 * weight[y < 0].sum()))
    z, keep = np.c_[x, np.ones(len(x))], np.r_[np.ones(x.shape[1]), 1e-6]

    def loss(w: np.ndarray) -> float:
        return float(0.5 * (keep * w * w).sum() + cost * (weight * np.maximum(1 - y * (z @ w), 0) ** 2).sum())

    w = np.zeros(z.shape[1])
    for _ in range(steps):
        slack = np.maximum(1 - y * (z @ w), 0)
        grad = keep * w - 2 * cost * z.T @ (weight * y * slack)
        active = z[slack > 0] * np.sqrt(2 * cost * weight[slack > 0])[:, None]
        move, size = np.linalg.solve(active.T @ active + np.diag(keep), grad), 1.0
        while size > 1e-4 and loss(w - size * move) > loss(w):
            size /= 2
        if np.abs(size * move).max() < 1e-8:
            break
        w = w - size * move
    return w[:-1], float(w[-1])


def _logistic(x: np.ndarray, y: np.ndarray, ridge: float = 1e-3, steps: int = 50) -> tuple[float, ...]:
    z, w = np.c_[np.ones(len(x)), x], np.zeros(x.shape[1] + 1)
    for _ in range(steps):
        p = 1 / (1 + np.exp(-np.clip(z @ w, -30, 30)))
        grad = z.T @ (p - y) / len(y) + ridge * w
        w -= np.linalg.solve((z * (p * (1 - p))[:, None]).T @ z / len(y) + ridge * np.eye(len(w)), grad)
    return tuple(map(float, w))


def gate(toxic: list[bytes]) -> tuple[tuple[bytes, ...], np.ndarray, np.ndarray]:
    """Toxic landmarks and their lookup: strings not much alike by the normalised kernel, and every other one that the lookup would miss."""
    own = np.maximum(_own(toxic), 1e-12)
    gram = kernel(toxic, toxic) / np.sqrt(np.outer(own, own))
    chosen: list[int] = []
    for i in range(len(toxic)):
        if all(gram[i, j] <= ALIKE for j in chosen):
            chosen.append(i)
    for i in range(len(toxic)):
        if i not in chosen and not passing([toxic[i]], *lookup_tables(tuple(toxic[j] for j in chosen)))[0]:
            chosen.append(i)
    marks = tuple(toxic[i] for i in chosen)
    return marks, *lookup_tables(marks)


def learn(marks: tuple[bytes, ...], tables: np.ndarray, need: np.ndarray, odds: dict[bytes, float], clean: list[bytes], hard: dict[bytes, int], bags: list[list[bytes]]) -> Model:
    """The SVM (not yet calibrated) from toxic bags and the strings of clean ones.

    ``odds`` are those of strings that stand in toxic texts much more often than
    in clean ones, ``clean`` frequent strings of clean texts, ``hard`` clean
    strings that pass the lookup with the number of texts that have them.
    """
    names = list(hard)
    landmarks = marks + tuple(clean[: CLEAN_LANDMARKS // 4] + names[: CLEAN_LANDMARKS // 4] + names[CLEAN_LANDMARKS :: max(1, len(names) // (CLEAN_LANDMARKS // 2))][: CLEAN_LANDMARKS // 2])
    landmarks = tuple(dict.fromkeys(landmarks))
    norms = np.maximum(_own(list(landmarks)), 1e-12)
    gram = kernel(list(landmarks), list(landmarks)) / np.sqrt(np.outer(norms, norms))
    values, vectors = np.linalg.eigh(gram.astype(float))
    good = values > 1e-4
    nystroem = vectors[:, good] / np.sqrt(values[good])

    def coordinates(items: list[bytes]) -> np.ndarray:
        own = np.maximum(_own(items), 1e-12)
        return kernel(items, list(landmarks)) / np.sqrt(own)[:, None] / np.sqrt(norms)[None, :] @ nystroem

    everything = sorted({x for bag in bags for x in bag})
    place = {x: i for i, x in enumerate(everything)}
    inside = coordinates(everything)
    negative = [x for x in dict.fromkeys(clean + names) if x not in odds]
    outside, heavy = coordinates(negative), np.array([1.0 + math.log1p(hard.get(x, 0)) for x in negative])
    margin = np.array([math.log(odds[x]) if x in odds else -1.0 for x in everything])
    within = Counter(place[x] for bag in bags for x in bag)
    taken: list[int] = []
    w, bias = np.zeros(nystroem.shape[1]), 0.0
    for _ in range(TURNS):
        toxic = sorted(i for i in within if margin[i] > 0)
        if toxic == taken or not toxic:
            break
        taken = toxic
        x = np.concatenate([inside[taken], outside])
        target = np.r_[np.ones(len(taken)), -np.ones(len(outside))]
        w, bias = _svm(x, target, np.r_[[float(within[i]) for i in taken], heavy])
        margin = inside @ w + bias
    return Model(marks, landmarks, norms, nystroem @ w, bias, tables, need, ())


def fit(docs: DataFrame, labels: DataFrame, train_rows: int = TRAIN_ROWS) -> Model:
    """Learn from at most about ``train_rows`` labelled rows that aren't held out, over their whole texts.

    The model depends on the rows alone, not on their order or partitions. Null
    and empty texts are bags without strings; near copies count once; an id with
    several labels has the greatest. With no labelled rows, labels of one kind,
    or no string that tells them apart, all scores are equal.
    """
    ids = labelled_ids(labels, "toxic", MOD, REST, train_rows)
    kind = docs.schema["doc_id"].dataType.simpleString()
    texts = docs.select("doc_id", "text").join(F.broadcast(ids), "doc_id").select("doc_id", F.xxhash64("text").alias("hash"), (F.col("y") > 0).cast("int").alias("y"), "text")

    def bag(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            whole = batch.column(3).to_pylist()
            columns = [*batch.columns[:3], pa.array(map(_minima, whole), pa.list_(pa.int64())), pa.array([sorted(items_of(t)) for t in whole], pa.list_(pa.binary()))]
            yield pa.RecordBatch.from_arrays(columns, ["doc_id", "hash", "y", "minima", "items"])

    bags = materialise(texts.mapInArrow(bag, f"doc_id {kind}, hash long, y int, minima array<long>, items array<binary>"), "bags")
    rows = sorted((r.doc_id, r.hash, r.y, r.minima) for r in bags.select("doc_id", "hash", "y", "minima").collect())
    kept = [rows[i] for i in different([r[3] for r in rows])]
    n = Counter(y for _, _, y, _ in kept)
    share = (n[1] + 0.5) / (n[0] + n[1] + 1)
    constant = Model((), (), np.zeros(0), np.zeros(0), 0.0, np.zeros((0, 0), np.uint64), np.zeros(0), (math.log(share / (1 - share)), 0.0, 0.0, 0.0, 0.0))
    if not n[0] or not n[1]:
        return constant
    spark = docs.sparkSession
    once = F.broadcast(spark.createDataFrame([r[:2] for r in kept], f"doc_id {kind}, hash long"))  # at most about train_rows
    bags_once = bags.join(once, ["doc_id", "hash"]).dropDuplicates(["doc_id", "hash"])
    counted = bags_once.select("y", F.explode("items").alias("item")).groupBy("item").agg(F.sum("y").alias("n1"), F.sum(1 - F.col("y")).alias("n0"))
    odds = F.col("n1") / n[1] / ((F.col("n0") + 0.3) / n[0])
    counted = materialise(counted.withColumn("odds", odds), "strings")
    least = max(4, math.ceil(0.015 * n[1]))
    strong = counted.where((F.col("n1") >= least) & (F.col("odds") >= 10)).orderBy(F.desc("n1"), "item").limit(TOXIC_STRINGS).collect()
    if not strong:
        return constant
    marks, tables, need = gate([bytes(r.item) for r in strong])
    # Frequent clean strings, and a sample by hash of the others.
    plain = counted.where((F.col("n0") > 0) & (F.col("odds") < 1.5))
    often = plain.orderBy(F.desc("n0"), "item").limit(CLEAN_STRINGS // 3).collect()
    others = plain.orderBy(F.xxhash64("item"), "item").limit(CLEAN_STRINGS - CLEAN_STRINGS // 3).collect()
    clean = list(dict.fromkeys(bytes(r.item) for r in often + others))

    @F.arrow_udf("boolean")
    def near(items: pa.Array) -> pa.Array:
        return pa.array(passing(items.to_pylist(), tables, need))

    hard_rows = counted.where("n0 > 0 and odds < 10").where(near("item")).orderBy(F.desc("n0"), "item").limit(HARD_STRINGS).collect()
    hard = {bytes(r.item): r.n0 for r in hard_rows}

    @F.arrow_udf("array<binary>")
    def nearby(items: pa.Array) -> pa.Array:
        lists = items.to_pylist()
        flat = [x for xs in lists for x in xs]
        good = iter(passing(flat, tables, need).tolist())
        return pa.array([[x for x in xs if next(good)] for xs in lists], pa.list_(pa.binary()))

    named = bags_once.where("y = 1").select("doc_id", "hash", nearby("items").alias("items")).where(F.size("items") > 0).collect()
    toxic_bags = [[bytes(x) for x in r["items"]] for r in sorted(named, key=lambda r: (r.doc_id, r.hash))]
    model = learn(marks, tables, need, {bytes(r.item): r.odds for r in strong}, clean, hard, toxic_bags)

    def measured(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        cache: dict[bytes, float] = {}
        for batch in batches:
            values = features(batch.column(1).to_pylist(), model, cache)
            yield pa.RecordBatch.from_arrays([batch.column(0), *(pa.array(c) for c in values.T)], ["y", "f0", "f1", "f2", "f3"])

    seen = texts.join(once, ["doc_id", "hash"]).dropDuplicates(["doc_id", "hash"]).select("y", "text").mapInArrow(measured, "y int, f0 double, f1 double, f2 double, f3 double").collect()
    table = np.array(sorted(tuple(r) for r in seen), dtype=float)
    discard(bags, counted)
    return model._replace(calibration=_logistic(table[:, 1:], table[:, 0]))


def scores(texts: list[str | None], model: Model, cache: dict[bytes, float]) -> np.ndarray:
    z = np.c_[np.ones(len(texts)), features(texts, model, cache)] @ np.array(model.calibration)
    return 1 / (1 + np.exp(-np.clip(z, -30, 30)))


def classify(docs: DataFrame, model: Model) -> DataFrame:
    """doc_id, held_out, score, predicted for every row of ``docs``.

    A null or empty text has no strings and gets the score of that; a text of
    any length is scored whole; repeated rows each give a row, with equal
    scores; an empty table gives none. With no labels to learn from all scores
    are equal. Only doc_id (null: not held out) and text are read, whatever
    other columns there are; doc_id decides held_out and nothing else.
    """
    kind = docs.schema["doc_id"].dataType.simpleString()

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        cache: dict[bytes, float] = {}
        for batch in batches:
            yield pa.RecordBatch.from_arrays([batch.column(0), pa.array(scores(batch.column(1).to_pylist(), model, cache), pa.float64())], ["doc_id", "score"])

    scored = docs.select("doc_id", "text").mapInArrow(run, f"doc_id {kind}, score double")
    return scored.select("doc_id", held_out(MOD, REST).alias("held_out"), "score", (F.col("score") >= THRESHOLD).cast("int").alias("predicted"))
