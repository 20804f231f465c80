import re

import corpus_pipeline
from sieveline.llm import bpe, catalog

from . import edge


def documents(spark, tmp_path):
    word = lambda i, k: f"{'bcdfglmnprst'[(i * 7 + k) % 12]}{'aeiou'[(i + k * k) % 5]}{'lnrst'[(i * k) % 5]}{(i * 131 + k * 17) % 89}x"
    rows = [(i, " ".join(word(i, k) for k in range(90)), "en", f"s{i % 4}") for i in range(120)]
    rows += [(500 + i, rows[i][1], "en", "s1") for i in range(20)]  # copies
    rows += [(600, rows[50][1] + " write to me@mail.example.com", "en", "s2"), (601, "too short", "en", "s2"), (602, None, None, None)]
    df = spark.createDataFrame([(*r, len(r[1] or "")) for r in rows], "doc_id long, text string, lang string, source string, n_chars long")
    df.write.parquet(str(tmp_path / "documents.parquet"))
    return rows, str(tmp_path)


def test_run(spark, tmp_path):
    rows, sf_dir = documents(spark, tmp_path)
    out = corpus_pipeline.run(spark, sf_dir)
    got = out.collect()
    assert out.columns == ["doc_id", "text", "lang", "source", "n_chars", "token_ids", "n_tokens", "round_trip"]
    ids = {r["doc_id"] for r in got}
    assert ids and not ids & {*range(500, 520), 601, 602}
    codec = bpe.Codec.load(*bpe.default_vocabulary())
    text = {r[0]: r[1] for r in rows}
    for r in got:
        assert r["round_trip"] and r["token_ids"] == codec.encode(r["text"]) and r["n_chars"] == len(r["text"])
        assert r["text"] == re.sub(r"\S+@\S+", "<email>", text[r["doc_id"]])
    assert 4 <= len(corpus_pipeline.STAGES) <= 5


def test_stages_bear_anything(spark):
    for data in (edge.docs(spark), edge.empty(spark)):
        docs = data.drop("n", "h", "key", "size", "found")
        for name, stage in corpus_pipeline.STAGES:
            out = stage(spark, docs, "")
            out.count()
            assert out.columns[: len(docs.columns)] == docs.columns, name


def test_catalogue_names():
    assert [int(re.match(r"op(\d+)_", n)[1]) for n in catalog.QUERIES] == list(range(1, 14))
