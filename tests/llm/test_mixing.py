import re

from sieveline.llm import mixing

from . import edge


def targets(sizes: dict, weights=(5, 2, 1), cap=3) -> dict:
    """Water-filling by repeated sharing."""
    order = sorted((k for k in sizes if k is not None)) + ([None] if None in sizes else [])
    w = {k: weights[i % 3] for i, k in enumerate(order)}
    out, open_, left = {}, set(sizes), float(sum(sizes.values()))
    while open_:
        total = sum(w[k] for k in open_)
        over = {k for k in open_ if left * w[k] / total > cap * sizes[k]}
        if not over:
            out |= {k: left * w[k] / total for k in open_}
            break
        for k in over:
            out[k] = cap * sizes[k]
            left -= out[k]
        open_ -= over
    return out


def corpus(spark, n=3000):
    rows = [(i, " ".join(["w"] * (1 + (i * 37) % 200)), "en", "hot" if i % 3 else f"s{i % 12:02d}", 0) for i in range(n)]
    return rows, spark.createDataFrame(rows, "doc_id long, text string, lang string, source string, n_chars long")


def test_targets_and_taken(spark):
    rows, df = corpus(spark)
    got = mixing.mix_report(df).collect()
    sizes: dict = {}
    for r in rows:
        sizes[r[3]] = sizes.get(r[3], 0) + len(r[1].split())
    want, source, taken = targets(sizes), {r[0]: r[3] for r in rows}, {}
    for r in got:
        k = source[r["doc_id"]]
        assert abs(r["target"] - want[k]) < 1e-6 and r["source_size"] == sizes[k]
        assert r["taken"] % r["size"] == 0 and r["taken"] <= 3 * r["size"]
        taken[k] = taken.get(k, 0) + r["taken"]
    assert all(abs(taken[k] - want[k]) <= 200 for k in sizes)
    again = mixing.mix_report(df.repartition(7)).collect()
    assert {tuple(r) for r in again} == {tuple(r) for r in got}


def test_mixed_repeats_documents(spark):
    _, df = corpus(spark, 600)
    want = {r["doc_id"]: r["taken"] // r["size"] for r in mixing.mix_report(df).collect() if r["taken"]}
    out = mixing.mixed(df)
    assert out.columns == df.columns
    got: dict = {}
    for r in out.collect():
        got[r["doc_id"]] = got.get(r["doc_id"], 0) + 1
    assert got == want


def test_edge_cases(spark):
    got = mixing.mix_report(edge.docs(spark)).collect()
    assert len(got) == len(edge.rows())
    assert {r["doc_id"]: r["size"] for r in got if r["doc_id"]} == {r[0]: len(re.findall(r"[^\x20\x09-\x0D]+", r[1] or "")) for r in edge.rows() if r[0]}
    assert mixing.mix_report(edge.empty(spark)).count() == 0
    blank = spark.createDataFrame([(1, "", "a"), (2, None, None)], "doc_id long, text string, source string")
    assert {(r["target"], r["taken"]) for r in mixing.mix_report(blank).collect()} == {(0.0, 0)}
    assert mixing.mixed(edge.docs(spark)).columns == edge.docs(spark).columns


def test_mixed_keeps_clashing_columns(spark):
    rows = [(i, "word " * (20 + i % 7), f"s{i % 3}", i, "c", 0.5) for i in range(40)] + [(99, None, None, 1, "n", 0.0)]
    df = spark.createDataFrame(rows, "doc_id long, text string, source string, _doc long, _copy string, q double")
    out = mixing.mixed(df)
    assert out.columns == df.columns
    taken = {r["doc_id"]: r["taken"] // max(r["size"], 1) for r in mixing.mix_report(df).collect()}
    got = [r for r in out.collect()]
    assert {i: sum(r["doc_id"] == i for r in got) for i in taken} == taken and all(r["_doc"] == r["doc_id"] for r in got)
