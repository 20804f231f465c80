import math

import numpy as np
import pytest

from sieveline.llm import embeddings

SCHEMA = "vec_id long, embedding array<float>, label int, cid int, n string"


def brute(rows, threshold=0.9):
    ok = {}
    for i, v, *_ in rows:
        if v and all(x is not None and math.isfinite(x) for x in v) and any(x != 0 for x in v):
            ok[i] = np.array(v, dtype=np.float32).astype(np.float64)
    ids = sorted(ok)
    links = {i: set() for i, *_ in rows}
    for a in ids:
        for b in ids:
            if a < b and len(ok[a]) == len(ok[b]) and ok[a] @ ok[b] / np.linalg.norm(ok[a]) / np.linalg.norm(ok[b]) >= threshold:
                links[a].add(b)
                links[b].add(a)
    root = {}
    for i in sorted(links):
        todo = [i]
        while todo:
            j = todo.pop()
            if j not in root:
                root[j] = i
                todo += links[j]
    return {i: (len(links[i]), root[i], root[i] == i) for i in links}


def vectors(seed=5, n=250, dim=24):
    rng = np.random.default_rng(seed)
    centres = rng.normal(size=(n, dim))
    rows = [c.tolist() for c in centres]
    for k in range(60):  # pairs and chains of near copies
        base = centres[k] / np.linalg.norm(centres[k])
        rows.append((base + rng.normal(size=dim) * 0.05).tolist())
        rows.append((base * 3 + rng.normal(size=dim) * 0.2).tolist())
    dense = centres[0]
    rows += [(dense + rng.normal(size=dim) * 0.08).tolist() for _ in range(70)]
    rows += [rows[1]] * 40  # copies
    rows = [[float(np.float32(x)) for x in r] for r in rows]
    rows += [None, [], [0.0] * dim, [float("nan")] * dim, [1.0, None, 2.0], [float("inf")] + [0.0] * (dim - 1), [1.0, 2.0], [2.0, 4.0]]
    return [(i, r, 0, 0, "x") for i, r in enumerate(rows)]


@pytest.mark.parametrize("block", [1024, 16])
def test_against_brute_force(spark, block):
    rows = vectors()
    df = spark.createDataFrame(rows, SCHEMA)
    got = {r["vec_id"]: (r["n_links"], r["component_id"], r["kept"]) for r in embeddings.near_copies(df, embeddings.Index(block=block, pivots=(24, 1024))).collect()}
    want = brute(rows)
    assert set(got) == set(want)
    pairs, found = sum(w[0] for w in want.values()), sum(g[0] for g in got.values())
    assert found >= 0.97 * pairs and all(got[i][0] <= want[i][0] for i in want)
    for i in list(want)[-8:-2]:
        assert got[i] == (0, i, True)
    assert got[len(rows) - 1] == (1, len(rows) - 2, False)  # vectors of length two link with each other only


def test_empty_and_repeated(spark):
    assert embeddings.near_copies(spark.createDataFrame([], SCHEMA)).count() == 0
    same = spark.createDataFrame([(7, [1.0, 0.0], 0, 0, "x")] * 3, SCHEMA)
    assert [tuple(r) for r in embeddings.near_copies(same).collect()] == [(7, 2, 7, True)] * 3


def test_repeated_and_missing_ids(spark):
    rows = [(5, [1.0, 1.0]), (5, [-1.0, 0.0]), (6, [-1.0, 0.001]), (None, [0.0, 1.0]), (None, [0.0, 2.0]), (None, [1.0, -3.0]), (9, [1.0, -3.0])]
    df = spark.createDataFrame([(i, v, 0, 0, "x") for i, v in rows], SCHEMA)
    for block in (1024, 2):
        got = sorted((str(r[0]), r[1], str(r[2]), r[3]) for r in embeddings.near_copies(df, embeddings.Index(block=block, few=block)).collect())
        want = [("5", 0, "5", True), ("5", 1, "5", True), ("6", 1, "5", False), ("9", 1, "9", True), ("None", 1, "9", False), ("None", 1, "None", True), ("None", 1, "None", True)]
        assert got == want, block


def cone(n, dim, mean, seed=6):
    """Unit vectors with a mean cosine of ``mean``, and to every fifth of them a near copy of another."""
    rng = np.random.default_rng(seed)
    unit = lambda x: x / np.linalg.norm(x, axis=-1, keepdims=True)
    v = unit(unit(rng.normal(size=dim)) * np.sqrt(mean) + unit(rng.normal(size=(n, dim))) * np.sqrt(1 - mean))
    for i in range(0, n, 5):
        v[i] = unit(v[(i * 7 + 3) % n] + unit(rng.normal(size=dim)) * rng.uniform(0.05, 0.4))
    return v.astype(np.float32)


@pytest.mark.parametrize(("mean", "n"), [(0.0, 5000), (0.6, 5000), (0.8, 5000), (0.8, 400)])
def test_recall_on_cones(spark, mean, n):
    """Pivots do not collapse where all vectors are close to one another; the index is used at every size."""
    v = cone(n, 64, mean)
    df = spark.createDataFrame([(i, x.tolist(), 0, 0, "x") for i, x in enumerate(v)], SCHEMA)
    index = embeddings.Index(block=256)
    classes = df.selectExpr("xxhash64(embedding) AS cid", "embedding AS v")
    pivots, fitted = embeddings.fit(classes, n, 64, index)
    asked = embeddings.asked_pivots(n, index)
    assert len(pivots) >= min(asked, 24) and (mean > 0.7 or len(pivots) == asked), (len(pivots), asked)
    got = {r["vec_id"]: r["n_links"] for r in embeddings.near_copies(df, index).collect()}
    units = v.astype(np.float64) / np.linalg.norm(v.astype(np.float64), axis=1, keepdims=True)
    asked = np.arange(0, n, 5 if n < 1000 else 50)
    want = (units[asked] @ units.T >= 0.9).sum(axis=1) - 1
    found = np.array([got[i] for i in asked.tolist()])
    assert want.sum() > 40 and (found <= want).all() and found.sum() >= 0.9 * want.sum(), (found.sum(), want.sum(), fitted)


def test_query_on_a_planted_table(spark, tmp_path):
    """The registered query, with its own parameters, on copies, chains and a cone of vectors."""
    rows = [(i, x.tolist(), 0) for i, x in enumerate(np.concatenate([cone(900, 64, 0.8), cone(900, 64, 0.0, 9)]))]
    rows += [(5000 + k, rows[7][1], 1) for k in range(30)] + [(6000, None, 0), (6001, [0.0] * 64, 0)]
    spark.createDataFrame(rows, "vec_id long, embedding array<float>, label int").write.parquet(str(tmp_path / "embeddings.parquet"))
    got = {r["vec_id"]: (r["n_links"], r["component_id"], r["kept"]) for r in embeddings.op9_pivot_permutations(spark, str(tmp_path)).collect()}
    want = brute(rows)
    assert set(got) == set(want) and all(got[i][0] <= want[i][0] and got[i][2] == (got[i][1] == i) for i in want)
    assert sum(g[0] for g in got.values()) >= 0.9 * sum(w[0] for w in want.values())
    assert got[6000] == (0, 6000, True) and got[6001] == (0, 6001, True) and len({got[5000 + k][1] for k in range(30)} | {got[7][1]}) == 1


def test_recall_of_every_fiftieth(spark):
    """The vectors whose id is divisible by 50, against all rows."""
    rng = np.random.default_rng(8)
    n, dim = 6000, 64
    centres = rng.normal(size=(40, dim))
    v = centres[rng.integers(0, 40, n)] * 0.5 + rng.normal(size=(n, dim))
    for i in range(0, n, 5):  # near copies at cosines about 0.9 to 0.99
        v[i] = v[(i * 7 + 3) % n] + rng.normal(size=dim) * rng.uniform(0.1, 0.5) * np.linalg.norm(v[(i * 7 + 3) % n]) / 8
    v = v.astype(np.float32)
    df = spark.createDataFrame([(i, x.tolist(), 0, 0, "x") for i, x in enumerate(v)], SCHEMA)
    got = {r["vec_id"]: r["n_links"] for r in embeddings.near_copies(df, embeddings.Index(block=256)).collect()}
    units = v.astype(np.float64) / np.linalg.norm(v.astype(np.float64), axis=1, keepdims=True)
    asked = np.arange(0, n, 50)
    want = (units[asked] @ units.T >= 0.9).sum(axis=1) - 1
    found = np.array([got[i] for i in asked.tolist()])
    assert want.sum() > 60 and (found <= want).all() and found.sum() >= 0.95 * want.sum()
