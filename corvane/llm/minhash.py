"""Near copies by exact similarity: documents whose 5-word shingle sets have a Jaccard similarity of at least 0.8.

Candidates come from op6's operator first: SimHash fingerprints of the same
shingles, linked at four differing bits by its ring of segments. That finds
the closest copies, but a pair of similarity 0.8 differs in ten bits on
average. So MinHash adds the rest: 160 minima in 32 bands of five. A pair of
similarity 0.8 misses all bands with probability (1 - 0.8**5)**32 = 3e-6. Within
a band's bucket, a 64-bit sketch of the minima (one bit each) leaves out pairs
far below that similarity. Candidates only tell which documents to compare:
every link is decided on the whole shingle sets.

Equal sets collapse to one before anything is paired. A bucket or a candidate
group is searched as a spanning forest, so no group emits its pairs. A group
of more than ``SPLIT_SHINGLES`` is no matter of one task: it is compared with
one of its sets first, wherever its rows are; the sets that aren't linked to
that one are then taken, as query sets, against all sets of the group in eight
blocks, or in more if a block would be over ``max_shingles``. That is exact,
and no task holds more than two blocks.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
import xxhash
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from corvane.llm import simhash
from corvane.llm.common import discard, materialise, small_or_shuffled, unused
from corvane.llm.simhash import SEED, _Union, components, majority, shingle_hashes

SHINGLE = 5
BANDS, ROWS = 32, 5
#: Sketches of a pair of similarity 0.8 differ in 6.4 bits on average, and in more than 20 with probability 1e-6.
SKETCH_BITS = 20
BLOCK = 1 << 12
#: Shingles (8 bytes each) of the blocks of a candidate group.
MAX_SHINGLES = 1 << 23
#: A candidate group with more shingles is dealt to several tasks, in so many blocks at least.
SPLIT_SHINGLES, LEAST_BLOCKS = 1 << 16, 8

_RNG = np.random.default_rng(SEED)
_FLIP = _RNG.integers(0, 1 << 32, BANDS * ROWS, dtype=np.uint32)[:, None]
_TIMES = (_RNG.integers(0, 1 << 32, BANDS * ROWS, dtype=np.uint32) | np.uint32(1))[:, None]
_PRIME = np.uint64(0x9E3779B97F4A7C15)


def distinct_hashes(blocks: list[np.ndarray]) -> np.ndarray:
    return np.unique(np.concatenate([np.zeros(0, np.uint64), *blocks]))


def shingles(text: str | None, shingle: int = SHINGLE) -> np.ndarray:
    """Sorted 64-bit hashes of the different shingles of a whole text; a shorter text is one shingle, one without words has none."""
    return distinct_hashes(list(shingle_hashes(text, shingle)))


def set_id(found: np.ndarray) -> int:
    """Signed 64-bit name of a shingle set."""
    h = xxhash.xxh64_intdigest(found.tobytes(), SEED)
    return h - (1 << 64) if h >> 63 else h


def minima(found: np.ndarray) -> np.ndarray:
    """The 160 least hash values of a set that is not empty."""
    high, out = (found >> np.uint64(32)).astype(np.uint32), np.full(BANDS * ROWS, 0xFFFFFFFF, np.uint32)
    for lo in range(0, len(high), BLOCK):
        np.minimum(out, ((high[lo : lo + BLOCK] ^ _FLIP) * _TIMES).min(axis=1), out=out)
    return out


def band_keys(least: np.ndarray) -> np.ndarray:
    """n x 32 bucket keys of n x 160 minima."""
    bands = least.reshape(-1, BANDS, ROWS).astype(np.uint64)
    key = np.broadcast_to(np.arange(1, BANDS + 1, dtype=np.uint64), bands.shape[:2]) * _PRIME
    for r in range(ROWS):
        key = (key ^ bands[:, :, r]) * _PRIME
        key ^= key >> np.uint64(29)
    return key.view(np.int64)


def sketches(least: np.ndarray) -> np.ndarray:
    """One bit of each of the first 64 minima."""
    bits = ((least[:, :64] * np.uint32(0x9E3779B1)) >> np.uint32(31)).astype(np.uint8)
    return np.packbits(bits, axis=1, bitorder="little").view("<i8").ravel()


def shingle_sets(docs: DataFrame) -> DataFrame:
    """(doc_id, text_hash, set_id, fp, bands, sketch, n): one row for every row of ``docs``; a text without words has no bands.

    ``fp`` is the SimHash of the shingles, repeats included, so texts of one set may have several.
    """

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            names, prints, sizes, least = [], [], [], np.zeros((batch.num_rows, BANDS * ROWS), np.uint32)
            some = np.zeros(batch.num_rows, bool)
            for i, text in enumerate(batch.column(1)):
                blocks = list(shingle_hashes(text.as_py(), SHINGLE))
                found = distinct_hashes(blocks)
                names.append(set_id(found))
                prints.append(majority(blocks))
                sizes.append(len(found))
                if len(found):
                    some[i], least[i] = True, minima(found)
            keys = [k.tobytes() if s else None for k, s in zip(band_keys(least), some, strict=True)]
            yield pa.RecordBatch.from_arrays([batch.column(0), batch.column(2), pa.array(names, pa.int64()), pa.array(prints, pa.int64()), pa.array(keys, pa.binary()), pa.array(sketches(least), pa.int64()), pa.array(sizes, pa.int64())], ["doc_id", "text_hash", "set_id", "fp", "bands", "sketch", "n"])

    return docs.select("doc_id", "text", F.xxhash64("text")).mapInArrow(run, f"doc_id {docs.schema['doc_id'].dataType.simpleString()}, text_hash long, set_id long, fp long, bands binary, sketch long, n long")


def _simhash_links(rows: DataFrame, max_run: int) -> DataFrame:
    """(a, b) set ids that join what op6's operator links, from (set_id, fp, bands): sets of one fingerprint, and of two that differ in few bits."""
    prints = materialise(rows.where("bands is not null").select("fp", "set_id").distinct(), "prints")
    hubs = materialise(prints.groupBy("fp").agg(F.min("set_id").alias("hub")), "hubs")
    of = hubs.hint("merge")  # as many rows as fingerprints, for few links
    alike = prints.join(of, "fp").where("set_id <> hub").select(F.col("hub").alias("a"), F.col("set_id").alias("b"))
    pairs = simhash.links(hubs.select("fp"), max_run)
    pairs = pairs.join(of.select(F.col("fp").alias("a"), F.col("hub").alias("x")), "a").join(of.select(F.col("fp").alias("b"), F.col("hub").alias("y")), "b")
    return alike.unionByName(pairs.where("x <> y").select(F.col("x").alias("a"), F.col("y").alias("b")))


def _bucketed(max_run: int):
    """Search (key, set_id, sketch) rows, sorted by key and set_id, bucket by bucket; emits (a, b) that join candidates into groups.

    Each search starts from the least set, so buckets of the same sets give the same pairs, whichever tasks they are in.
    A bucket over ``max_run`` is joined whole: that only leaves more to compare.
    """

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        known = _Union()

        def search(ids: np.ndarray, marks: np.ndarray) -> Iterator[tuple[int, int]]:
            while len(ids) > 1:
                stack, ids, marks = [(ids[0], marks[0])], ids[1:], marks[1:]
                while stack and len(ids):
                    x, mark = stack.pop()
                    near = np.bitwise_count((marks ^ mark).view(np.uint64)) <= SKETCH_BITS
                    stack += zip(ids[near], marks[near], strict=True)
                    yield from ((int(x), int(y)) for y in ids[near])
                    ids, marks = ids[~near], marks[~near]

        key, parts, size, hub = None, [], 0, None
        for batch in batches:
            out: list[tuple[int, int]] = []
            k, ids, marks = (c.to_numpy(zero_copy_only=False) for c in batch.columns)
            edge = np.flatnonzero(np.diff(k)) + 1
            for lo, hi in zip(np.r_[0, edge], np.r_[edge, len(k)], strict=True):
                if lo == hi:
                    continue
                if k[lo] != key:
                    if size > 1 and hub is None:
                        out += search(*(np.concatenate(c) for c in zip(*parts, strict=True)))
                    key, parts, size, hub = k[lo], [], 0, None
                size += hi - lo
                parts.append((ids[lo:hi], marks[lo:hi]))
                if size > max_run:
                    hub = int(parts[0][0][0]) if hub is None else hub
                    out += ((hub, int(y)) for part in parts for y in part[0])
                    parts = []
            new = [(x, y) for x, y in out if known.join(x, y)]
            yield pa.RecordBatch.from_arrays([pa.array([x for x, _ in new], pa.int64()), pa.array([y for _, y in new], pa.int64())], ["a", "b"])
        if size > 1 and hub is None:
            new = [(x, y) for x, y in search(*(np.concatenate(c) for c in zip(*parts, strict=True))) if known.join(x, y)]
            yield pa.RecordBatch.from_arrays([pa.array([x for x, _ in new], pa.int64()), pa.array([y for _, y in new], pa.int64())], ["a", "b"])

    return run


def forest(sets: list[np.ndarray]) -> list[tuple[int, int]]:
    """Spanning forest (by list index) of the pairs with a Jaccard similarity of at least 0.8."""
    sizes = np.array([len(s) for s in sets])
    if len(sets) < 2:
        return []
    terms, flat = np.unique(np.concatenate(sets), return_inverse=True)
    flat = flat.astype(np.int32)
    ends = sizes.cumsum()
    own = [flat[e - n : e] for e, n in zip(ends, sizes, strict=True)]
    seen, out = np.zeros(len(terms), bool), []
    left, held = np.arange(len(sets)), np.arange(len(sets))  # held: whose terms flat has now
    starts = ends - sizes
    while len(left) > 1:
        stack, left = [left[0]], left[1:]
        while stack and len(left):
            x = stack.pop()
            if len(left) * 2 < len(held):
                held, flat = left, np.concatenate([own[i] for i in left])
                starts = sizes[held].cumsum() - sizes[held]
            seen[own[x]] = True
            both = np.zeros(len(sets), np.int64)
            both[held] = np.add.reduceat(seen[flat], starts, dtype=np.int64)
            seen[own[x]] = False
            near = 9 * both[left] >= 4 * (sizes[left] + sizes[x])
            out += [(int(x), int(y)) for y in left[near]]
            stack += list(left[near])
            left = left[~near]
    return out


def _verified(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """(a, b) links among the whole sets of each candidate group, from rows (root, set_id, hashes) sorted by root and set_id."""
    group, ids, sets = None, [], []

    def links() -> pa.RecordBatch:
        pairs = forest(sets)
        return pa.RecordBatch.from_arrays([pa.array([ids[x] for x, _ in pairs], pa.int64()), pa.array([ids[y] for _, y in pairs], pa.int64())], ["a", "b"])

    for batch in batches:
        for root, name, hashes in zip(batch.column(0).to_pylist(), batch.column(1).to_pylist(), batch.column(2), strict=True):
            if root != group:
                yield links()
                group, ids, sets = root, [], []
            if not ids or ids[-1] != name:
                ids.append(name)
                sets.append(np.frombuffer(hashes.as_py(), np.uint64))
    yield links()


def _beside(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """Rows (root, set_id, hashes, hub, hub_hashes) with whether the set is linked to the hub's."""
    hub, theirs = None, np.zeros(0, np.uint64)
    for batch in batches:
        near = []
        for own, name, other in zip(batch.column(2), batch.column(3).to_pylist(), batch.column(4), strict=True):
            if name != hub:
                hub, theirs = name, np.frombuffer(other.as_py(), np.uint64)
            mine = np.frombuffer(own.as_py(), np.uint64)
            at = np.minimum(np.searchsorted(theirs, mine), len(theirs) - 1)
            near.append(9 * int((theirs[at] == mine).sum()) >= 4 * (len(mine) + len(theirs)))
        yield pa.RecordBatch.from_arrays([*batch.columns[:4], pa.array(near, pa.bool_())], ["root", "set_id", "hashes", "hub", "near"])


def _large_links(sets: DataFrame, sizes: DataFrame, max_shingles: int) -> DataFrame:
    """(a, b) links within groups that are no matter of one task, from (root, set_id, hashes) and (root, shingles)."""
    sets = materialise(sets.join(small_or_shuffled(sizes.select("root")), "root").select("root", "set_id", "hashes"), "large")
    hubs = materialise(sets.groupBy("root").agg(F.min("set_id").alias("hub"), F.min_by("hashes", "set_id").alias("hub_hashes")), "hubs")
    weight = hubs.agg(F.coalesce(F.sum(F.octet_length("hub_hashes")), F.lit(0))).first()[0]
    beside = sets.join(F.broadcast(hubs) if weight <= 128 << 20 else hubs.hint("merge"), "root").select("root", "set_id", "hashes", "hub", "hub_hashes")
    beside = materialise(beside.mapInArrow(_beside, "root long, set_id long, hashes binary, hub long, near boolean"), "beside")
    left = beside.where("not near")
    parts = left.groupBy("root").agg(F.sum(F.octet_length("hashes") / 8).alias("left")).join(sizes, "root")
    parts = parts.withColumn("blocks", F.greatest(F.lit(LEAST_BLOCKS), F.ceil(F.col("shingles") / max_shingles)))
    parts = parts.select("root", F.col("blocks").cast("int").alias("blocks"), F.ceil(F.col("left") * F.col("blocks") / F.col("shingles")).cast("int").alias("chunks"))
    parts = small_or_shuffled(materialise(parts, "parts"))

    def dealt(rows: DataFrame, block, chunk) -> DataFrame:
        keyed = rows.select("root", "set_id", "hashes").join(parts, "root").withColumn("block", block).withColumn("chunk", chunk)
        return keyed.select(F.xxhash64("root", "block", "chunk").alias("root"), "set_id", "hashes")

    every = lambda n: F.explode(F.sequence(F.lit(0), F.col(n) - 1))
    members = dealt(beside, F.pmod(F.xxhash64("set_id"), "blocks").cast("int"), every("chunks"))
    queries = dealt(left, every("blocks"), F.pmod(F.xxhash64("set_id", F.lit(1)), "chunks").cast("int"))
    cross = members.unionByName(queries).repartition("root").sortWithinPartitions("root", "set_id").mapInArrow(_verified, "a long, b long")
    return beside.where("near and set_id <> hub").select(F.col("hub").alias("a"), F.col("set_id").alias("b")).unionByName(cross)


def near_copies(docs: DataFrame, max_run: int = 16384, max_shingles: int = MAX_SHINGLES) -> DataFrame:
    """(doc_id, text_hash, component, component_id) for every row of ``docs``.

    ``component`` names the group of linked rows, ``text_hash`` is xxhash64 of
    the text. ``component_id`` is the smallest doc_id reachable over pairs of similarity
    0.8. Texts without words are copies of each other. A row without doc_id
    still links, and its component is null only if no linked row has an id.
    """
    rows = materialise(shingle_sets(docs), "sets")
    distinct = materialise(rows.groupBy("set_id").agg(F.min("doc_id").alias("least_id"), F.first("bands").alias("bands"), F.first("sketch").alias("sketch"), F.first("n").alias("n")), "distinct")

    def emit(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            keys = np.frombuffer(b"".join(batch.column(1).to_pylist()), np.int64)
            columns = [pa.array(keys), *(pa.array(np.repeat(c.to_numpy(zero_copy_only=False), BANDS)) for c in (batch.column(0), batch.column(2)))]
            yield pa.RecordBatch.from_arrays(columns, ["key", "set_id", "sketch"])

    keyed = distinct.where("bands is not null").select("set_id", "bands", "sketch").mapInArrow(emit, "key long, set_id long, sketch long")
    buckets = keyed.repartition("key").sortWithinPartitions("key", "set_id").mapInArrow(_bucketed(max_run), "a long, b long")
    near = materialise(_simhash_links(rows, max_run).unionByName(buckets), "candidates")
    groups = components(near)
    members = groups.unionByName(groups.select(F.col("root").alias("node"), "root").distinct()).withColumnRenamed("node", "set_id")
    groups = materialise(distinct.join(members, "set_id").select("set_id", "root", "least_id", "n"), "groups")
    discard(near)

    # Only texts of candidate groups are read again and shuffled.
    def whole(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for lo in range(0, batch.num_rows, 256):
                found = [shingles(t) for t in batch.column(0)[lo : lo + 256].to_pylist()]
                yield pa.RecordBatch.from_arrays([pa.array([set_id(s) for s in found], pa.int64()), pa.array([s.tobytes() for s in found], pa.binary())], ["set_id", "hashes"])

    wanted = small_or_shuffled(groups.select(F.col("least_id").alias("__id")))
    texts = docs.select("doc_id", "text").join(wanted, F.col("doc_id").eqNullSafe(F.col("__id")), "left_semi").select("text")
    sizes = materialise(groups.groupBy("root").agg(F.sum("n").alias("shingles")).where(F.col("shingles") > min(max_shingles, SPLIT_SHINGLES)), "sizes")
    sets = texts.mapInArrow(whole, "set_id long, hashes binary")
    held = groups if sizes.isEmpty() else groups.join(small_or_shuffled(sizes), "root", "left_anti")
    small = sets.join(small_or_shuffled(held.select("set_id", "root")), "set_id")
    found = small.select("root", "set_id", "hashes").repartition("root").sortWithinPartitions("root", "set_id").mapInArrow(_verified, "a long, b long")
    if not sizes.isEmpty():
        large = sets.join(small_or_shuffled(groups.join(small_or_shuffled(sizes), "root", "left_semi").select("set_id", "root")), "set_id").dropDuplicates(["set_id"])
        found = found.unionByName(_large_links(large, sizes, max_shingles))
    roots = components(materialise(found, "links"))
    linked = distinct.join(roots.withColumnRenamed("node", "set_id"), "set_id", "left")
    linked = materialise(linked.select("set_id", "least_id", F.coalesce("root", "set_id").alias("root")), "roots")
    ids = linked.groupBy("root").agg(F.min("least_id").alias("component_id"))
    named = linked.join(ids, "root").select("set_id", F.col("root").alias("component"), "component_id")
    return rows.select("doc_id", "text_hash", "set_id").join(named, "set_id").select("doc_id", "text_hash", "component", "component_id")


def representatives(docs: DataFrame, max_run: int = 16384) -> DataFrame:
    """One row of ``docs`` for each component: that with the smallest doc_id, all columns as they were.

    Of several rows with that id the smallest by all columns stays. Rows are
    told apart by id and text, so an id may stand on texts of several
    components. Rows without an id can't be named by a component and all stay.
    """
    found = materialise(near_copies(docs, max_run), "found")
    held, own = unused("__id", docs), unused("__hash", docs)
    docs_keyed = docs.withColumns({held: F.col("doc_id"), own: F.xxhash64("text")})
    names = F.col("doc_id").alias("k_id"), F.col("text_hash").alias("k_hash")

    def same(keys: DataFrame):
        return (docs_keyed[held] == keys["k_id"]) & (docs_keyed[own] == keys["k_hash"])

    gone = materialise(found.where("doc_id <> component_id").select(*names).distinct(), "gone")
    kept = docs_keyed.join(small_or_shuffled(gone), same(gone), "left_anti")
    # Only ids and hashes are shuffled, unless some component has several rows of its least id; then just those rows are compared.
    least = found.where("doc_id = component_id")
    several = least.groupBy("component").count().where("count > 1").select("component")
    twice = materialise(least.join(several, "component").select(*names, F.col("component").alias("k_component")).distinct(), "twice")
    if twice.isEmpty():
        return kept.drop(held, own)
    single = kept.join(small_or_shuffled(twice), same(twice), "left_anti").drop(held, own)
    row = F.struct(*[docs_keyed[c] for c in docs.columns]).alias("k_row")
    one = kept.join(small_or_shuffled(twice), same(twice)).select(twice["k_component"], row).groupBy("k_component").agg(F.min("k_row").alias("k_row"))
    return single.unionByName(one.select("k_row.*"))
