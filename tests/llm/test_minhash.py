import random

import pytest

import corpus_pipeline
from corvane.llm import minhash, simhash


def brute(texts):
    """Component (as the smallest index) of every text, by comparing all pairs of shingle sets."""
    sets, comp = [], list(range(len(texts)))
    for t in texts:
        words = (t or "").encode().lower().split()
        sets.append({tuple(words[i : i + 5]) for i in range(max(1, len(words) - 4))} if words else set())

    def root(x):
        while comp[x] != x:
            x = comp[x]
        return x

    for i, a in enumerate(sets):
        for j, b in enumerate(sets[:i]):
            if a == b or 5 * len(a & b) >= 4 * len(a | b):
                x, y = root(i), root(j)
                comp[max(x, y)] = min(x, y)
    return [root(i) for i in range(len(texts))]


def copies(seed=3):
    """Groups of near copies on both sides of similarity 0.8, with short texts, exact copies and texts without words."""
    rng, out = random.Random(seed), []
    for _ in range(25):
        base = [f"w{rng.randrange(10**6)}" for _ in range(rng.choice([1, 3, 6, 60, 200, 600]))]
        for _ in range(12):
            words = list(base)
            for _ in range(rng.randrange(0, 2 + len(words) // 25)):
                words[rng.randrange(len(words))] = f"x{rng.randrange(10**6)}"
            out.append(" ".join(words))
    out += [None, "", " ", out[0].upper()]
    rng.shuffle(out)
    return out


@pytest.mark.parametrize(("max_run", "max_shingles", "split"), [(16384, minhash.MAX_SHINGLES, 1 << 16), (3, minhash.MAX_SHINGLES, 1 << 16), (16384, 300, 1 << 16), (16384, minhash.MAX_SHINGLES, 300)])
def test_stage_equals_brute_force(spark, max_run, max_shingles, split, monkeypatch):
    """Groups in one task, in crowded buckets, in many blocks, and in the fewest blocks that a split group has."""
    monkeypatch.setattr(minhash, "SPLIT_SHINGLES", split)
    texts = copies()
    want = brute(texts)
    df = spark.createDataFrame(list(enumerate(texts)), "doc_id long, text string")
    found = {r.doc_id: r.component_id for r in minhash.near_copies(df, max_run, max_shingles).collect()}
    assert [found[i] for i in range(len(texts))] == want and len(set(want)) < len(texts)
    if max_run > 3 and max_shingles > 300 and split > 300:
        kept = corpus_pipeline.remove_near_duplicates(spark, df, "").collect()
        assert sorted(r.doc_id for r in kept) == sorted(set(want))


def test_recall_on_documents(spark):
    df = spark.read.parquet("/root/testdata/sf0.001/documents.parquet")
    rows = sorted(df.select("doc_id", "text").collect())
    want = brute([r.text for r in rows])
    kept = corpus_pipeline.remove_near_duplicates(spark, df, "").select("doc_id").collect()
    assert sorted(r.doc_id for r in kept) == sorted(rows[i].doc_id for i in set(want))


def test_ids_that_are_missing_or_shared(spark):
    base = [f"w{i}" for i in range(100)]
    rows = [(None, " ".join(base)), (4, " ".join(base[:-1])), (2, " ".join(base[1:])), (2, "other words"), (None, None)]
    df = spark.createDataFrame(rows, "doc_id long, text string")
    found = sorted((r.doc_id or 0, r.component_id or 0) for r in minhash.near_copies(df).collect())
    assert found == [(0, 0), (0, 2), (2, 2), (2, 2), (4, 2)]
    assert minhash.near_copies(df.limit(0)).count() == 0


def test_each_component_keeps_one_row_whatever_its_ids(spark):
    a, b, c = "first text of all", "second text of all", " ".join(f"w{i}" for i in range(100))
    rows = [(1, a, "x"), (5, a, "x"), (5, b, "x"), (9, b, "x"), (5, c, "y"), (5, c, "x"), (5, c + " end", "z"), (None, a, "x")]
    df = spark.createDataFrame(rows, "doc_id long, text string, source string")
    kept = sorted(tuple(r) for r in minhash.representatives(df).where("doc_id is not null").collect())
    assert kept == sorted([(1, a, "x"), (5, b, "x"), (5, c, "x")])
    assert minhash.representatives(df).where("doc_id is null").count() == 1


def test_stage_goes_through_the_simhash_operator(spark, monkeypatch):
    """Without MinHash candidates the operator's links are found all the same, and each is decided on the whole sets."""

    def nothing(max_run):
        def run(batches):
            for batch in batches:
                yield batch.slice(0, 0).select(["set_id", "sketch"]).rename_columns(["a", "b"])

        return run

    monkeypatch.setattr(minhash, "_bucketed", nothing)
    base = [f"w{i}" for i in range(400)]
    texts = [" ".join(base), "other words", " ".join(base[:-1]), " ".join(base[1:]), "w " * 9, "w " * 8, "W " * 9, None, ""]
    df = spark.createDataFrame(list(enumerate(texts)), "doc_id long, text string")
    for a in (2, 3):  # 0 bits and 1 bit apart
        assert ((simhash.fingerprint(texts[0], minhash.SHINGLE) ^ simhash.fingerprint(texts[a], minhash.SHINGLE)) & (2**64 - 1)).bit_count() <= simhash.TAU
    kept = corpus_pipeline.remove_near_duplicates(spark, df, "").collect()
    assert sorted(r.doc_id for r in kept) == sorted(set(brute(texts))) == [0, 1, 4, 7]


def test_copies_in_many_tasks_give_few_edges(spark, monkeypatch):
    """Each band's bucket of a group may be in a task of its own; all start from the least set, so most find the same pairs."""
    sizes, write = [], simhash.materialise

    def counted(df, label):
        out = write(df, label)
        if label == "cc":
            sizes.append(out.count())
        return out

    monkeypatch.setattr(simhash, "materialise", counted)
    base = [f"w{i}" for i in range(600)]
    texts = [" ".join([*base[: 5 * i], f"x{i}", *base[5 * i + 1 :]]) for i in range(100)]
    conf = {"spark.sql.shuffle.partitions": "64", "spark.sql.adaptive.coalescePartitions.enabled": "false"}
    before = {k: spark.conf.get(k) for k in conf}
    try:
        for k, v in conf.items():
            spark.conf.set(k, v)
        found = minhash.near_copies(spark.createDataFrame(list(enumerate(texts)), "doc_id long, text string")).collect()
    finally:
        for k, v in before.items():
            spark.conf.set(k, v)
    assert {r.component_id for r in found} == {0} and sorted(r.doc_id for r in found) == list(range(100))
    assert sum(sizes) < 12 * len(texts), sizes
