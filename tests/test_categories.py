from sieveline.plans import queries


def test_every_label_is_a_category(spark, tmp_path):
    rows = [(i, [float(i % 7), 1.0, float(i)], i % 20 - 1) for i in range(100)] + [(100, [1.0, 1.0, 1.0], None)]
    spark.createDataFrame(rows, "vec_id long, embedding array<float>, label int").write.parquet(str(tmp_path / "embeddings.parquet"))
    out = queries.cosine_best(spark, str(tmp_path))
    assert {r["category"] for r in out.select("category").distinct().collect()} == {f"label-{k}" for k in range(-1, 19)}
    assert out.count() == 101 * 20
