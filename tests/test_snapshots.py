"""Merkle trees of manifests, results by run, and the fit of isotonic maps in parts."""

from __future__ import annotations

import random

import pytest

from sieveline.operators import calibration
from sieveline.plans import snapshots
from sieveline.sources import files, sinks


def manifest(spark, rows):
    return spark.createDataFrame(rows, "source_id string, content_hash string")


def test_changes_of_two_snapshots(spark, tmp_path):
    rng = random.Random(4)
    before = {f"id-{k}": f"h{rng.randrange(10)}" for k in range(700)}
    after = {k: v for k, v in before.items() if rng.random() > 0.01} | {f"new-{k}": "h" for k in range(5)}
    for k in rng.sample(sorted(after), 6):
        after[k] = None
    a, b = manifest(spark, list(before.items())), manifest(spark, list(after.items()))
    want = {(k, "removed" if k not in after else "added" if k not in before else "changed", before.get(k), after.get(k)) for k in before.keys() | after.keys() if k not in after or k not in before or before[k] != after[k]}
    assert {tuple(r) for r in snapshots.changes(a, b).collect()} == want and len(want) > 10
    levels = snapshots.levels_for(700)
    trees = tuple(snapshots.save_tree(spark, snapshots.tree(m, levels), str(tmp_path / n)) for n, m in (("a", a), ("b", b)))
    assert levels == 1 and {tuple(r) for r in snapshots.changes(a, b, trees).collect()} == want
    assert snapshots.changes(a, a).count() == 0 and snapshots.changes(a, manifest(spark, [])).count() == 700


def test_tree_tells_manifests_apart(spark):
    root = lambda rows, levels=2: snapshots.tree(manifest(spark, rows), levels).where("level = 0").first()["digest"]
    rows = [(f"i{k}", "h") for k in range(40)]
    assert root(rows) == root(rows[::-1]) and root(rows) != root(rows[1:]) and root([("a", None)]) != root([("a", "null")]) and root([]) == root([], 0)
    nodes = snapshots.tree(manifest(spark, rows), 2).collect()
    assert sum(r["entries"] for r in nodes if r["level"] == 2) == 40 and sum(r["level"] == 0 for r in nodes) == 1
    assert [snapshots.levels_for(n) for n in (0, 256, 257, 4096, 4097, 10**9)] == [0, 0, 1, 1, 2, 6]


def test_only_leaves_that_differ_are_compared(spark):
    rows = [(f"i{k}", "h") for k in range(2000)]
    a, b = (snapshots.tree(manifest(spark, r), 2) for r in (rows, [*rows[:-1], ("i1999", "other")]))
    assert snapshots.differing_leaves(a, b, 2).count() == 1 and snapshots.differing_leaves(a, a, 2).count() == 0


def test_results_by_run(spark, tmp_path, capsys):
    table, rows = str(tmp_path / "t"), lambda *ids: spark.createDataFrame([(i, 1) for i in ids], "source_id string, n long")
    sinks.keep(rows("a", "b"), table, "0012")
    sinks.keep(rows("c"), table, "run-2")
    untouched = sorted((p.name, p.stat().st_mtime_ns) for p in (tmp_path / "t" / "run_id=0012").iterdir())
    sinks.keep(rows("d", "e", "f"), table, "run-2")
    assert sorted((p.name, p.stat().st_mtime_ns) for p in (tmp_path / "t" / "run_id=0012").iterdir()) == untouched
    ids = lambda df: sorted(r["source_id"] for r in df.collect())
    assert ids(files.kept(spark, table, "0012")) == ["a", "b"] and ids(files.kept(spark, table, "run-2")) == ["d", "e", "f"] and files.kept(spark, table).count() == 5
    one = files.kept(spark, table, "0012")
    one.explain("formatted")
    plan = capsys.readouterr().out
    assert "PartitionFilters: [isnotnull(run_id" in plan, "the plan lists one partition"
    with pytest.raises(ValueError):
        sinks.keep(rows("x").withColumnRenamed("source_id", "text"), table, "r")


def plain(rows):
    """Pooled adjacent violators of (score, n, pos): (first score, last score, n, pos) of each pool."""
    out = []
    for s, n, pos in sorted(rows):
        out.append([s, s, n, pos])
        while len(out) > 1 and out[-2][3] * out[-1][2] >= out[-1][3] * out[-2][2]:
            *_, last, n2, p2 = out.pop()
            out[-1] = [out[-1][0], last, out[-1][2] + n2, out[-1][3] + p2]
    return [tuple(x) for x in out]


@pytest.mark.parametrize("size", [2, 7, 64, 10_000])
def test_isotonic_fit_in_parts(spark, size):
    rng = random.Random(size)
    kinds = {
        "noisy": [(float(k), n := rng.randrange(1, 5), sum(rng.random() < k / 300 for _ in range(n))) for k in range(300)],
        "falling": [(float(k), 10, 10 - k // 12) for k in range(120)], "rising": [(float(k), 200, k) for k in range(150)], "flat": [(float(k), 2, 1) for k in range(90)], "one": [(1.0, 3, 2)],
        "saw": [(float(k), 5, (k * 7) % 6) for k in range(100)],
    }
    if size == 2:  # runs of two blocks: many rounds
        kinds = {c: rows[:24] for c, rows in kinds.items()}
    df = spark.createDataFrame([(c, *r) for c, rows in kinds.items() for r in rows], "category string, score double, n long, pos long")
    got = {}
    for r in calibration.isotonic_blocks(df, size).orderBy("category", "score").collect():
        got.setdefault(r["category"], []).append((r["score"], r["last"], r["n"], r["pos"]))
    assert got == {c: plain(rows) for c, rows in kinds.items()}
    assert calibration.isotonic_blocks(df.where("false"), size).count() == 0


def test_isotonic_fit_of_many_scores(spark):
    """A million distinct scores of one category, in runs of 50,000."""
    df = spark.range(1_000_000).selectExpr("'c' AS category", "cast(id AS double) AS score", "1L AS n", "cast(pmod(xxhash64(id), 1000000) < id AS long) AS pos")
    blocks = [(r["n"], r["pos"]) for r in calibration.isotonic_blocks(df, 50_000).orderBy("score").collect()]
    rows = [(1, r["pos"]) for r in df.orderBy("score").toLocalIterator()]
    assert blocks == [(n, p) for _, n, p in calibration.pooled([n for n, _ in rows], [p for _, p in rows])]


def test_isotonic_error_of_many_labels(spark):
    """A category of 400,000 labels: its held-out ones meet the knots score by score, not each with all 16,384 of them."""
    import bisect
    import time

    # scores in steps of 1/256 within 8 to 72, so that some lie beyond the knots
    score = "(pmod(xxhash64(id), 16384) / 256.0D + 8)"
    rows = spark.range(400_000).selectExpr("'c' AS category", "if(id % 2 = 0, 'dev', 'holdout') AS split", f"if(id % 2 = 0, 10 + {score} * 0.75D, {score}) AS score", f"cast(pmod(xxhash64(id, 3), 80) < {score} AS int) AS label")
    labels = rows.unionAll(spark.createDataFrame([("d", "dev", 5.0, 0), ("d", "holdout", 5.0, 1), ("e", "holdout", 25.0, 0)], rows.schema))
    begun = time.time()
    got = {r["category"]: r for r in calibration.fit(labels, "isotonic").collect()}
    spent = time.time() - begun
    assert (got["d"]["error"], got["e"]["error"]) == (pytest.approx(95.0), pytest.approx(25.0)) and got["d"]["method"] == "identity"
    x, y, bins = got["c"]["x"], got["c"]["y"], {}
    for r in rows.where("split = 'holdout'").groupBy("score").agg({"*": "count", "label": "sum"}).collect():
        s = r["score"] / 100
        k = bisect.bisect_right(x, s)
        p = y[0] if k == 0 else y[-1] if k == len(x) else y[k - 1] + (y[k] - y[k - 1]) * (s - x[k - 1]) / (x[k] - x[k - 1])
        own = bins.setdefault(min(9, int(p * 10)), [0, 0.0, 0])
        own[0], own[1], own[2] = own[0] + r["count(1)"], own[1] + p * r["count(1)"], own[2] + r["sum(label)"]
    assert len(x) > 10_000 and got["c"]["error"] == pytest.approx(sum(abs(p - q) for _, p, q in bins.values()) / 200_000 * 100, rel=1e-9)
    assert spent < 60
