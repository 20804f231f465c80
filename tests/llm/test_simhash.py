import random
from collections import Counter

import numpy as np
import pytest
from xxhash import xxh64_intdigest

from sieveline.llm import simhash
from sieveline.llm.components import components

from . import edge


def brute_fingerprint(text, k=3):
    ws = [w.lower() if w.isascii() else "".join(c.lower() if c.isascii() else c for c in w) for w in (text or "").replace("\t", " ").replace("\n", " ").replace("\x0b", " ").replace("\x0c", " ").replace("\r", " ").split(" ") if w]
    if not ws:
        return 0
    shingles = [" ".join(ws[i : i + k]) for i in range(len(ws) - k + 1)] or [" ".join(ws)]
    hs = [xxh64_intdigest(s.encode(), 42) for s in shingles]
    return sum(1 << b for b in range(64) if 2 * sum(h >> b & 1 for h in hs) > len(hs))


def groups(fps, radius=3):
    root = list(range(len(fps)))

    def find(i):
        while root[i] != i:
            i = root[i]
        return i

    for i in range(len(fps)):
        for j in range(i):
            if (fps[i] ^ fps[j]).bit_count() <= radius:
                a, b = find(i), find(j)
                root[max(a, b)] = min(a, b)
    return [find(i) for i in range(len(fps))]


def test_fingerprints(spark):
    got = {r["doc_id"]: r["fp"] & (2**64 - 1) for r in simhash.fingerprints(edge.docs(spark)).collect()}
    for doc_id, text, *_ in edge.rows():
        assert got[doc_id] == brute_fingerprint(text) == simhash.fingerprint(text)
    assert simhash.fingerprint("One two") == simhash.fingerprint("one TWO") != simhash.fingerprint("one twö")


def near(rng, fp, n):
    for b in rng.sample(range(64), n):
        fp ^= 1 << b
    return fp


@pytest.mark.parametrize("block", [2048, 5])
def test_links_lose_nothing(spark, block):
    rng = random.Random(3)
    fps = [rng.getrandbits(64) for _ in range(150)]
    fps += [near(rng, f, rng.choice([1, 2, 3, 3, 4])) for f in fps for _ in range(2)]
    fps += [near(rng, 0, rng.choice([0, 1, 2, 3])) for _ in range(60)]  # a crowded list
    fps = sorted(set(fps))
    signed = np.array(fps, dtype=np.uint64).view(np.int64).tolist()
    df = spark.createDataFrame([(f,) for f in signed], "fp long")
    got = {r["node"]: r["root"] for r in components(simhash.links(df, block=block)).collect()}
    want = groups(fps)
    assert Counter(want.count(w) for w in want)[1] < len(fps)
    mine = [got.get(s, s) for s in signed]
    pair = lambda labels: {frozenset(i for i, x in enumerate(labels) if x == y) for y in set(labels)}
    assert pair(mine) == pair(want)


def test_components_of_edge_cases(spark):
    got = simhash.near_copies(edge.docs(spark)).collect()
    rows = edge.rows()
    fps = [brute_fingerprint(r[1]) for r in rows]
    want = groups(fps)
    least = {w: min((rows[i][0] for i in range(len(rows)) if want[i] == w and rows[i][0] is not None), default=None) for w in set(want)}
    assert Counter((r["doc_id"], r["component_id"]) for r in got) == Counter((rows[i][0], least[want[i]]) for i in range(len(rows)))
    assert simhash.near_copies(edge.empty(spark)).count() == 0


def test_chains_and_stars(spark):
    chain = [(i, i + 1) for i in range(40)]
    star = [(100, 100 + i) for i in range(1, 30)]
    df = spark.createDataFrame([*chain, *star, (200, 200)], "a long, b long")
    got = {r["node"]: r["root"] for r in components(df).collect()}
    assert got == {i: 0 for i in range(41)} | {100 + i: 100 for i in range(30)}
    assert components(df.limit(0)).count() == 0


def test_tables_discard_without_loss():
    """Of unrelated fingerprints that share half their bits, nearly all pairs are discarded before verification; no pair
    within the radius is."""
    rng = np.random.default_rng(3)
    refs = simhash.references()
    assert len(refs) >= 64
    n = 20_000
    x = rng.integers(0, 1 << 64, n, dtype=np.uint64)
    y = (x & np.uint64(0xFFFFFFFF)) | (rng.integers(0, 1 << 32, n, dtype=np.uint64) << np.uint64(32))
    left = (np.abs(simhash.distance_table(x, refs) - simhash.distance_table(y, refs)) <= simhash.RADIUS).all(axis=1)
    assert left.mean() < 0.005
    flips = np.array([sum(1 << int(b) for b in rng.choice(64, int(k), replace=False)) for k in rng.integers(0, 4, 2000)], dtype=np.uint64)
    near = x[:2000] ^ flips
    assert (np.abs(simhash.distance_table(x[:2000], refs) - simhash.distance_table(near, refs)) <= simhash.RADIUS).all()
