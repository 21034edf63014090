"""SimHash near-duplicates with pigeonring candidate filtering.

A document's fingerprint has 64 bits. Two fingerprints link when at most four
bits differ. The 64 bits are cut into a ring of five segments. If the whole
distance is at most 4, the pigeonring principle gives a start segment from
which every chain of l consecutive segments differs in at most floor(l * 4/5)
bits: 0, 1, 2, 3, 4. Of the first two links of that chain (segment i exact,
segment i+1 with one bit masked out) the shuffle takes a part as its key:
segment i and one half of segment i+1, since one bit leaves one of the halves
as it is. That is ten rows for each fingerprint instead of one for each of the
64 masks. The masks divide a long run where it is searched; the longer chains
prune what is left before the full Hamming check.

Skew: exact copies collapse to one fingerprint before anything is paired.
Within a key the links are found as a spanning forest (each fingerprint leaves
the search once it is reached), so no group emits its pairs. A key that more
than ``max_run`` different fingerprints share is not searched at all: those
fingerprints go through an exact way whose cost is linear in their number,
the 2081 midpoints at distance 2 or less (two words are at most 4 apart if and
only if they share one).
"""

from __future__ import annotations

from collections.abc import Iterable, Iterator

import numpy as np
import pyarrow as pa
import xxhash
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from corvane.llm.common import discard, materialise, small_or_shuffled

SEGMENTS = (13, 13, 13, 13, 12)
STARTS = (0, 13, 26, 39, 52)
TAU = 4
SEED = 42
BLOCK = 1 << 16


def shingle_hashes(text: str | None, shingle: int = 4) -> Iterator[np.ndarray]:
    """XXH64 of every shingle of a whole text, repeats included, in blocks; a shorter text is one shingle, one without words has none."""
    words = (text or "").encode().lower().split()
    n = max(1, len(words) - shingle + 1) if words else 0
    for lo in range(0, n, BLOCK):
        part = words[lo : min(lo + BLOCK, n) + shingle - 1]
        columns = [part[k:] for k in range(shingle)]
        grams = list(map(b" ".join, zip(*columns, strict=False))) or [b" ".join(part)]
        yield np.array([xxhash.xxh64_intdigest(g, SEED) for g in grams], dtype="<u8")


def majority(blocks: Iterable[np.ndarray]) -> int:
    """Signed 64-bit word of the bits that more than half of the hashes have; 0 without hashes."""
    set_bits, n = np.zeros(64, dtype=np.int64), 0
    for hashes in blocks:
        bits = np.unpackbits(hashes.view(np.uint8).reshape(-1, 8), axis=1, bitorder="little")
        set_bits += bits.sum(axis=0, dtype=np.int64)
        n += len(hashes)
    return int(np.packbits((set_bits * 2 > n).astype(np.uint8), bitorder="little").view("<i8")[0])


def fingerprint(text: str | None, shingle: int = 4) -> int:
    """Signed 64-bit SimHash of a whole text; 0 for a text without words."""
    return majority(shingle_hashes(text, shingle))


def fingerprints(docs: DataFrame, shingle: int = 4) -> DataFrame:
    """(doc_id, fp): one row for every row of ``docs``; a null text counts as empty."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            fps = [fingerprint(t, shingle) for t in batch.column(1).to_pylist()]
            yield pa.RecordBatch.from_arrays([batch.column(0), pa.array(fps, pa.int64())], ["doc_id", "fp"])

    return docs.select("doc_id", "text").mapInArrow(run, f"doc_id {docs.schema['doc_id'].dataType.simpleString()}, fp long")


def _segments(fps: np.ndarray) -> list[np.ndarray]:
    return [(fps >> np.uint64(s)) & np.uint64((1 << n) - 1) for s, n in zip(STARTS, SEGMENTS, strict=True)]


def ring_keys(fps: np.ndarray) -> np.ndarray:
    """n x 10 keys: for each start segment i and each half h of the next one, (i, h, segment i, half h of segment i+1)."""
    seg, keys = _segments(fps), []
    for i in range(5):
        for h, half in enumerate(_halves(seg[(i + 1) % 5])):
            keys.append(np.uint64(i << 21 | h << 20) | seg[i] << np.uint64(7) | half)
    return np.stack(keys, axis=1).astype(np.int64)


def _halves(segment: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    return segment & np.uint64(0x3F), segment >> np.uint64(6)


def masked_keys(keys: np.ndarray, fps: np.ndarray) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """Start segments, keys and fingerprints, seven for one and sorted by key: the ring key, and its other half without bit j."""
    start, rows = keys >> 21, np.arange(len(keys))
    low, high = _halves(np.stack(_segments(fps))[(start + 1) % 5, rows])
    other = np.where(keys >> 20 & 1 == 0, high, low).astype(np.int64)
    masked = np.concatenate([keys << 10 | j << 7 | other & ~(1 << j) for j in range(7)])
    order = np.argsort(masked, kind="stable")
    return np.tile(start, 7)[order], masked[order], np.tile(fps, 7)[order]


def chain_links(start: np.ndarray, diff: np.ndarray) -> np.ndarray:
    """Which XOR words pass every chain from their start segment, the last chain being the whole ring."""
    counts = np.stack([np.bitwise_count(s) for s in _segments(diff)], axis=1).astype(np.int64)
    order = (start[:, None] + np.arange(5)) % 5
    sums = np.take_along_axis(counts, order, axis=1).cumsum(axis=1)
    return (sums * 5 <= np.arange(1, 6) * TAU).all(axis=1)


def forest(fps: np.ndarray) -> list[tuple[int, int]]:
    """Spanning forest of the links among different fingerprints, without listing all pairs."""
    left, out = fps.copy(), []
    while len(left):
        stack, left = [left[0]], left[1:]
        while stack and len(left):
            x = stack.pop()
            near = np.bitwise_count(left ^ x) <= TAU
            found = left[near]
            out += [(int(x), int(y)) for y in found]
            stack += list(found)
            left = left[~near]
    return out


class _Union:
    """Union-find over the nodes that one task has linked lately.

    It only keeps links from being repeated, so it may forget: beyond LIMIT
    nodes it starts anew, which bounds its memory whatever the task reads.
    """

    LIMIT = 1 << 20

    def __init__(self) -> None:
        self.up: dict[int, int] = {}

    def root(self, x: int) -> int:
        while (p := self.up.get(x, x)) != x:
            self.up[x] = self.up.get(p, p)
            x = p
        return x

    def join(self, x: int, y: int) -> bool:
        x, y = self.root(x), self.root(y)
        if x == y:
            return False
        if len(self.up) >= self.LIMIT:
            self.up.clear()
        self.up[max(x, y)] = min(x, y)
        return True


def _linked(max_run: int):
    """Search sorted (key, fp) rows run by run. Emits links (a, b), or (a, null) for members of a run over ``max_run``."""
    small = 32

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        known = _Union()

        def rows(pairs: list[tuple[int, int]], over: np.ndarray | None = None) -> pa.RecordBatch:
            new = [(x, y) for x, y in pairs if known.join(x, y)]
            a = [x for x, _ in new] + ([] if over is None else over.view(np.int64).tolist())
            b = [y for _, y in new] + [None] * (0 if over is None else len(over))
            return pa.RecordBatch.from_arrays([pa.array(a, pa.int64()), pa.array(b, pa.int64())], ["a", "b"])

        def search(start: np.ndarray, keys: np.ndarray, fps: np.ndarray, whole: bool = True) -> list[tuple[int, int]]:
            edge = np.flatnonzero(np.diff(keys)) + 1
            lo, hi = np.concatenate([[0], edge]), np.concatenate([edge, [len(keys)]])
            length = np.repeat(hi - lo, hi - lo)
            pairs: list[tuple[int, int]] = []
            few = (length > 1) & (length <= small)
            first, k, v = start[few], keys[few], fps[few]
            for step in range(1, small):
                same = np.flatnonzero(k[step:] == k[:-step])
                if not len(same):
                    break
                diff = v[same] ^ v[same + step]
                good = same[chain_links(first[same], diff)]
                pairs += zip(v[good].view(np.int64).tolist(), v[good + step].view(np.int64).tolist(), strict=True)
            many = length > small
            if whole and many.any():
                return pairs + search(*masked_keys(keys[many], fps[many]), whole=False)
            for s, e in zip(lo[hi - lo > small], hi[hi - lo > small], strict=True):
                found = np.array(forest(fps[s:e]), dtype=np.uint64).reshape(-1, 2).view(np.int64)
                pairs += map(tuple, found.tolist())
            return pairs

        keys, fps, spilled = np.zeros(0, np.int64), np.zeros(0, np.uint64), None
        for batch in batches:
            k = batch.column(0).to_numpy(zero_copy_only=False)
            v = batch.column(1).to_numpy(zero_copy_only=False).view(np.uint64)
            if spilled is not None:  # still in a run that is too long
                cut = int(np.searchsorted(k, spilled, side="right"))
                if cut:
                    yield rows([], v[:cut])
                k, v = k[cut:], v[cut:]
                if not len(k):
                    continue
                spilled = None
            keys, fps = np.concatenate([keys, k]), np.concatenate([fps, v])
            if not len(keys):
                continue
            cut = int(np.searchsorted(keys, keys[-1], side="left"))
            if cut:
                edge = np.flatnonzero(np.diff(keys[:cut])) + 1
                lo, hi = np.concatenate([[0], edge]), np.concatenate([edge, [cut]])
                long_run = np.repeat(hi - lo > max_run, hi - lo)
                if long_run.any():
                    yield rows([], fps[:cut][long_run])
                if not long_run.all():
                    k, v = keys[:cut][~long_run], fps[:cut][~long_run]
                    yield rows(search(k >> 21, k, v))
            keys, fps = keys[cut:], fps[cut:]
            if len(keys) > max_run:
                yield rows([], fps)
                spilled, keys, fps = keys[-1], keys[:0], fps[:0]
        if len(keys):
            yield rows(search(keys >> 21, keys, fps))

    return run


def _midpoints() -> np.ndarray:
    one = [1 << i for i in range(64)]
    return np.array([0, *one, *(x | y for i, x in enumerate(one) for y in one[:i])], dtype=np.uint64)


def links(distinct: DataFrame, max_run: int = 16384) -> DataFrame:
    """(a, b) pairs of different fingerprints that connect exactly what the threshold connects.

    ``distinct`` has each fingerprint once, in column ``fp``.
    """

    def emit(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            fps = batch.column(0).to_numpy(zero_copy_only=False).view(np.uint64)
            keys = ring_keys(fps)
            yield pa.RecordBatch.from_arrays([pa.array(keys.ravel()), pa.array(np.repeat(fps.view(np.int64), keys.shape[1]))], ["key", "fp"])

    keyed = distinct.select("fp").mapInArrow(emit, "key long, fp long").repartition("key").sortWithinPartitions("key")
    found = materialise(keyed.mapInArrow(_linked(max_run), "a long, b long"), "links")
    pairs = found.where("b is not null")
    crowded = found.where("b is null").select(F.col("a").alias("fp")).distinct()
    if crowded.isEmpty():
        return pairs

    def midpoints(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        masks = _midpoints()
        for batch in batches:
            fps = batch.column(0).to_numpy(zero_copy_only=False).view(np.uint64)
            for lo in range(0, len(fps), 64):
                part = fps[lo : lo + 64]
                mids = (part[:, None] ^ masks[None, :]).view(np.int64).ravel()
                yield pa.RecordBatch.from_arrays([pa.array(mids), pa.array(np.repeat(part.view(np.int64), len(masks)))], ["mid", "fp"])

    def stars(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        known, mid, hub = _Union(), None, 0
        for batch in batches:
            out = []
            for m, fp in zip(batch.column(0).to_pylist(), batch.column(1).to_pylist(), strict=True):
                if m != mid:
                    mid, hub = m, fp
                elif known.join(hub, fp):
                    out.append((hub, fp))
            yield pa.RecordBatch.from_arrays([pa.array([x for x, _ in out], pa.int64()), pa.array([y for _, y in out], pa.int64())], ["a", "b"])

    met = crowded.mapInArrow(midpoints, "mid long, fp long").repartition("mid").sortWithinPartitions("mid")
    return pairs.unionByName(met.mapInArrow(stars, "a long, b long"))


def components(edges: DataFrame) -> DataFrame:
    """(node, root): the smallest node reachable, by alternating large-star and small-star rounds.

    An edge is a row (x, y) with x > y. The large step moves y to the least
    neighbour of y, the small step hangs x and its neighbours on the least of
    them. Both look up one narrow row for each node, found by a minimum that is
    combined before its shuffle; edges themselves are not dealt by node while
    that table can be broadcast (its size is checked), so a hub with any number
    of neighbours is spread like all other rows. Beyond that size the join's
    skewed partitions are split at run time. Edges never become more, and each
    round is written to the shared folder, so lineage stays one round deep.
    Several tasks may find the same edge, and many edges move to the same two
    nodes: each is kept once, or every round would read the repeats again.
    """
    now = edges.select(F.greatest("a", "b").alias("x"), F.least("a", "b").alias("y")).where("x <> y").distinct()
    now = materialise(now, "cc")
    while True:
        near = materialise(now.groupBy(F.col("x").alias("y")).agg(F.min("y").alias("m")), "least")
        jumped = now.select("x", "y").join(small_or_shuffled(near), "y", "left").select("x", F.coalesce("m", "y").alias("y"), F.col("m").isNotNull().alias("changed"))
        least = materialise(jumped.groupBy("x").agg(F.min("y").alias("m"), F.max("changed").alias("changed")), "least")
        moved = jumped.select("x", "y").join(small_or_shuffled(least.select("x", "m")), "x").where("y <> m").select(F.col("y").alias("x"), F.col("m").alias("y")).distinct()
        new = materialise(least.select("x", F.col("m").alias("y"), "changed").unionByName(moved.withColumn("changed", F.lit(True))), "cc")
        discard(now, near, least)
        now = new
        if not now.agg(F.max("changed")).first()[0]:
            return now.select(F.col("x").alias("node"), F.col("y").alias("root"))


def near_duplicates(docs: DataFrame, shingle: int = 4, max_run: int = 16384) -> DataFrame:
    """(doc_id, fp, component_id) for every row of ``docs``.

    ``component_id`` is the smallest doc_id reachable over fingerprints that
    differ in at most four bits. Null or empty texts have fingerprint zero and
    link like any other; repeated rows each give a row; a row without doc_id
    still links, and its component is null only if no linked row has an id.
    An empty table gives no rows. Other columns of ``docs`` are not read.
    """
    fps = materialise(fingerprints(docs, shingle), "fps")
    distinct = materialise(fps.groupBy("fp").agg(F.min("doc_id").alias("least_id")), "distinct")
    found = links(distinct, max_run)
    roots = components(found)
    linked = distinct.join(roots.withColumnRenamed("node", "fp"), "fp", "left")
    linked = materialise(linked.select("fp", "least_id", F.coalesce("root", "fp").alias("root")), "roots")
    discard(distinct)
    ids = linked.groupBy("root").agg(F.min("least_id").alias("component_id"))
    named = linked.join(ids, "root").select("fp", "component_id")
    return fps.join(named, "fp").select("doc_id", "fp", "component_id")
