import hashlib
import math

import numpy as np
import pytest

from sieveline.llm import clusters

SCHEMA = "vec_id long, embedding array<float>, cluster int, v string, distance long"


def brute(rows, c):
    """Plain Lloyd rounds over Python's whole numbers; rows of (vec_id, components)."""
    kept = [(i, [math.floor(c.scale * float(x)) for x in v]) for i, v in rows if v is not None and len(v) == c.dim and all(x is not None and math.isfinite(x) for x in v)]
    named = sorted((hashlib.sha256(f"{c.seed}:{'' if i is None else i}".encode()).hexdigest(), v) for i, v in kept)
    centroids = [v for _, v in named[: c.k]]
    square = lambda v, w: sum((a - b) ** 2 for a, b in zip(v, w, strict=True))
    near = lambda v: min((square(v, w), n) for n, w in enumerate(centroids))
    for _ in range(c.rounds):
        of = [near(v)[1] for _, v in kept]
        for n in range(len(centroids)):
            if own := [v for (_, v), m in zip(kept, of, strict=True) if m == n]:
                centroids[n] = [sum(x) // len(own) for x in zip(*own, strict=True)]
    told = [(i, *reversed(near(v))) for i, v in kept]
    inertia = [sum(d for _, m, d in told if m == n) for n in range(len(centroids))]
    return sorted((str(i), n, d, tuple(centroids[n]), inertia[n], sum(inertia)) for i, n, d in told)


def asked(spark, rows, c):
    df = spark.createDataFrame([(i, v, 1, "x", 2) for i, v in rows], SCHEMA)
    out = clusters.clustered(df, c)
    return sorted((str(r["vec_id"]), r["cluster"], r["distance"], tuple(r["centroid"]), r["cluster_inertia"], r["inertia"]) for r in out.collect())


def f32(rows):
    return [(i, None if v is None else [None if x is None else float(np.float32(x)) for x in v]) for i, v in rows]


@pytest.mark.parametrize("seed", [1, 2])
def test_against_brute_force(spark, seed):
    rng = np.random.default_rng(seed)
    centres = rng.normal(size=(6, 8)) * np.array([[0.2], [1], [1], [2], [2], [5]])
    rows = [(i, (centres[i % 6] + rng.normal(size=8) * 0.4).tolist()) for i in range(300)]
    rows += [(400 + i, rows[0][1]) for i in range(60)]  # copies
    rows += [(500, None), (501, []), (502, [1.0] * 7), (503, [None] + [0.0] * 7), (504, [math.nan] + [0.0] * 7), (505, [math.inf] + [0.0] * 7), (None, [0.0] * 8), (7, [0.1] * 8), (7, [0.1] * 8)]
    c = clusters.Clustering(k=7, rounds=6, dim=8)
    assert asked(spark, f32(rows), c) == brute(f32(rows), c)


def test_ties_and_few_vectors(spark):
    """Vectors half-way between centroids, equal centroids, empty clusters, fewer vectors than centroids, none at all."""
    square = [(1, [0.0, 0.0]), (2, [0.0, 2.0]), (3, [2.0, 0.0]), (4, [2.0, 2.0]), (5, [1.0, 1.0]), (6, [-1.0, -1.0]), (7, [1.0, 0.0])]
    for k, rounds in ((4, 0), (4, 3), (3, 5), (50, 4)):
        c = clusters.Clustering(k=k, rounds=rounds, dim=2, scale=1)
        assert asked(spark, square, c) == brute(square, c), (k, rounds)
    same = [(1, [3.0, 4.0])] * 5
    c = clusters.Clustering(k=3, rounds=4, dim=2)
    assert asked(spark, same, c) == brute(same, c) and {r[1] for r in asked(spark, same, c)} == {0}
    assert asked(spark, [], c) == []
    assert asked(spark, [(1, [1e30, 0.0])], c) == [], "too far out for a distance of 64 bits"


def test_the_annulus_leaves_centroids_out():
    rng = np.random.default_rng(4)
    centroids = rng.integers(-50, 50, (40, 6)) * np.arange(1, 41)[:, None] ** 2
    v = (centroids[rng.integers(0, 40, 3000)] + rng.integers(-40, 40, (3000, 6))).astype(np.int64)
    number, distance, compared = clusters.Annulus(centroids.astype(np.int64)).near(v)
    d = ((v[:, None, :] - centroids[None]) ** 2).sum(axis=2)
    assert (number == d.argmin(axis=1)).all() and (distance == d.min(axis=1)).all()
    assert compared < 0.25 * d.size


def test_boundary_of_the_annulus():
    """The nearest centroid's norm differs by exactly the bound: it lies on the same ray, at the same distance as the first."""
    centroids = np.array([[5, 0], [1, 0], [9, 0]], dtype=np.int64)
    number, distance, _ = clusters.Annulus(centroids).near(np.array([[3, 0], [7, 0], [5, 4]], dtype=np.int64))
    assert number.tolist() == [0, 0, 0] and distance.tolist() == [4, 4, 16]
