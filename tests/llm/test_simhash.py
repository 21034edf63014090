import numpy as np
import pytest
import xxhash

from corvane.llm import simhash


def brute(fps):
    """Component (as the smallest index) of every fingerprint, by comparing all pairs."""
    comp = list(range(len(fps)))

    def root(x):
        while comp[x] != x:
            x = comp[x]
        return x

    for i in range(len(fps)):
        for j in range(i):
            if bin((fps[i] ^ fps[j]) & (2**64 - 1)).count("1") <= 4:
                a, b = root(i), root(j)
                comp[max(a, b)] = min(a, b)
    return [root(i) for i in range(len(fps))]


def slow_fingerprint(text):
    words = (text or "").encode().lower().split()
    if not words:
        return 0
    grams = [b" ".join(words[i : i + 4]) for i in range(max(1, len(words) - 3))]
    hs = [xxhash.xxh64_intdigest(g, 42) for g in grams]
    return sum(1 << b for b in range(64) if 2 * sum(h >> b & 1 for h in hs) > len(hs))


@pytest.mark.parametrize("text", [None, "", " \t\n", "One", "a b c", "a b c d", "A b C d e É é f", "x y " * 40])
def test_fingerprint_matches_definition(text):
    assert simhash.fingerprint(text) & (2**64 - 1) == slow_fingerprint(text)


def test_blocks_join_up(monkeypatch):
    text = " ".join(f"w{i * i % 97}" for i in range(300))
    whole = simhash.fingerprint(text)
    monkeypatch.setattr(simhash, "BLOCK", 16)
    assert simhash.fingerprint(text) == whole == simhash.fingerprint(text)


def cluster(seed, n=400):
    rng = np.random.default_rng(seed)
    centres = rng.integers(0, 2**63, 12, dtype=np.uint64)
    fps = []
    for _ in range(n):
        x = int(centres[rng.integers(0, 12)])
        for b in rng.integers(0, 64, rng.integers(0, 7)):
            x ^= 1 << int(b)
        fps.append(x)
    fps = sorted(set(fps))
    return [x - 2**64 if x >= 2**63 else x for x in fps]


@pytest.mark.parametrize("max_run", [16384, 40, 3])
def test_components_equal_brute_force(spark, max_run):
    fps = cluster(5)
    df = spark.createDataFrame([(x,) for x in fps], "fp long")
    roots = {r.node: r.root for r in simhash.components(simhash.links(df, max_run)).collect()}
    want = brute(fps)
    groups = {}
    for fp, c in zip(fps, want, strict=True):
        groups.setdefault(c, set()).add(roots.get(fp, fp))
    assert all(len(g) == 1 for g in groups.values())
    assert len({next(iter(g)) for g in groups.values()}) == len(groups)


def test_documents(spark):
    base = " ".join(f"word{i}" for i in range(400))
    rows = [(5, base), (3, base), (3, base), (9, base + " tail"), (7, "something else entirely"), (8, None), (2, ""), (None, "lonely words"), (4, "Ü " * 3)]
    df = spark.createDataFrame([(*r, "x", 1) for r in rows], "doc_id long, text string, fp string, key int")
    out = {(r.doc_id, r.component_id) for r in simhash.near_duplicates(df).collect()}
    assert {(5, 3), (3, 3), (7, 7), (8, 2), (2, 2), (None, None), (4, 4)} <= out
    assert simhash.near_duplicates(df).count() == len(rows)
    assert simhash.near_duplicates(df.limit(0)).count() == 0


def test_ring_keys_are_few_and_meet_every_link():
    rng = np.random.default_rng(1)
    a = rng.integers(0, 2**63, 20_000, dtype=np.uint64)
    b = a.copy()
    for _ in range(4):
        b ^= np.uint64(1) << rng.integers(0, 64, len(b), dtype=np.uint64)
    one, other = simhash.ring_keys(a), simhash.ring_keys(b)
    assert one.shape == (len(a), 10) and len(np.unique(one[:, 0] >> 20)) == 1
    met = np.zeros(len(a), bool)
    for c in range(10):
        met |= (one[:, c] == other[:, c]) & simhash.chain_links(one[:, c] >> 21, a ^ b)
    assert met.all()


@pytest.mark.parametrize("max_run", [16384, 300])
def test_runs_divided_by_masks_equal_brute_force(spark, max_run):
    """Fingerprints that share a ring key by hundreds, near ones among them and far ones."""
    rng = np.random.default_rng(2)
    fps = [int(x) for x in rng.integers(0, 2**45, 500, dtype=np.uint64) << np.uint64(19)]
    fps += [fps[i] ^ 1 << int(rng.integers(0, 64)) ^ 1 << int(rng.integers(19, 64)) for i in range(250)]
    fps = [x - 2**64 if x >= 2**63 else x for x in sorted(set(fps))]
    roots = {r.node: r.root for r in simhash.components(simhash.links(spark.createDataFrame([(x,) for x in fps], "fp long"), max_run)).collect()}
    groups = {}
    for fp, c in zip(fps, brute(fps), strict=True):
        groups.setdefault(c, set()).add(roots.get(fp, fp))
    assert all(len(g) == 1 for g in groups.values()) and len({next(iter(g)) for g in groups.values()}) == len(groups) < len(fps)


def test_rounds_keep_each_edge_once(spark, monkeypatch):
    """A group that many tasks find, by repeated edges and by many hubs, is read as about one edge for each node in every round."""
    sizes, write = [], simhash.materialise

    def counted(df, label):
        out = write(df, label)
        if label == "cc":
            sizes.append(out.count())
        return out

    monkeypatch.setattr(simhash, "materialise", counted)
    same = [(i, 0) for i in range(1, 41)] * 32
    met = [(100 + h, 200 + i) for h in range(20) for i in range(40)]
    for edges, nodes, first in ((same, {*range(41)}, 40), (met, {*range(100, 120), *range(200, 240)}, 800)):
        sizes.clear()
        roots = {r.node: r.root for r in simhash.components(spark.createDataFrame(edges, "a long, b long")).collect()}
        assert roots == {x: min(nodes) for x in nodes if x != min(nodes)}
        assert sizes[0] == first and max(sizes[1:]) < 2 * len(nodes)
