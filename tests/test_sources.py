"""Sources, sinks, engines with fakes, and the stream."""

from __future__ import annotations

import io
import json
import zipfile

import pytest
from pyspark.sql import functions as F

from sieveline import config
from sieveline.operators import engines
from sieveline.sources import files, items, sinks
from sieveline.streaming import ingest


def test_manifest_and_contents(spark, tmp_path):
    entry = lambda i, p, h: {"source_id": i, "content_type": "text/plain", "content_hash": h, "path": p}
    (tmp_path / "m.json").write_text(json.dumps([entry("a", "x/1.txt", "old"), entry("b", "2.txt", "h"), entry("a", "x/1.txt", "new")]))
    (tmp_path / "root" / "x").mkdir(parents=True)
    (tmp_path / "root" / "x" / "1.txt").write_bytes("é".encode())
    (tmp_path / "root" / "x" / "1.txt.ocr.txt").write_text("side")
    source = files.reader("sample")(spark, str(tmp_path / "root"), str(tmp_path / "m.json"))
    assert {r["source_id"]: r["content_hash"] for r in source.entries().collect()} == {"a": "new", "b": "h"}
    got = {r["source_id"]: r for r in source.read(source.entries()).collect()}
    assert bytes(got["a"]["content"]).decode() == "é" and got["a"]["ocr_text"] == "side" and got["b"]["content"] is None
    asked = source.select(["b", "a", "b"]).orderBy("ordinal").collect()
    assert [r["source_id"] for r in asked] == ["b", "a", "b"]
    with pytest.raises(files.UnknownIds, match="zz"):
        source.select(["a", "zz"])
    with pytest.raises(ValueError):
        files.reader("other")


class Logged(items.ItemSource):
    """Notes each file that is opened."""

    @classmethod
    def name(cls):
        return "logged_items"

    def reader(self, schema):
        class Reader(items.ItemReader):
            def open(self, fs, path):
                with open(f"{self.root}/../opened", "a") as f:
                    f.write(path.rpartition("/")[2] + "\n")
                return super().open(fs, path)

        self.reader_type = Reader
        return super().reader(schema)


def folder_of(tmp_path, n=12):
    entries = []
    (tmp_path / "root").mkdir()
    for i in range(n):
        (tmp_path / "root" / f"{i}.txt").write_bytes(bytes([97 + i]) * (1000 * i))
        entries.append({"source_id": f"s{i:02d}", "content_type": "text/plain", "content_hash": "h", "path": f"{i}.txt", "author": None})
    (tmp_path / "root" / "3.txt.ocr.txt").write_text("beside")
    (tmp_path / "m.json").write_text(json.dumps([*entries, {"source_id": "gone", "content_type": "text/plain", "content_hash": "h", "path": "no.txt"}]))
    return str(tmp_path / "root"), str(tmp_path / "m.json")


def test_reads_open_only_what_is_asked(spark, tmp_path, capsys):
    source = files.FolderSource(spark, *folder_of(tmp_path))
    source.opener = Logged
    rows = source.read(source.select(["s03", "gone"]).drop("ordinal"))
    got = {r["source_id"]: r for r in rows.collect()}
    assert len(got["s03"]["content"]) == 3000 and got["s03"]["ocr_text"] == "beside" and got["gone"]["content"] is None
    assert sorted((tmp_path / "opened").read_text().split()) == ["3.txt", "3.txt.ocr.txt"]
    rows.explain()
    plan = capsys.readouterr().out
    assert "Exchange" not in plan and "Join" not in plan, "contents are neither shuffled nor joined"
    everything = source.read(source.entries(), side=False)
    assert everything.count() == 13 and everything.where("ocr_text is not null").count() == 0


def test_plan_by_bytes_and_pieces(spark, tmp_path):
    source = files.FolderSource(spark, *folder_of(tmp_path))
    spark.conf.set("spark.sql.files.maxPartitionBytes", "8000")
    try:
        rows = source.read(source.entries())
        assert 5 <= rows.rdd.getNumPartitions() <= 9, "66,000 bytes in parts of about 8,000, some of which get no item"
        assert sum(len(r["content"] or b"") for r in rows.collect()) == 66_000
    finally:
        spark.conf.unset("spark.sql.files.maxPartitionBytes")
    pieces = source.pieces(source.entries(), 1024).collect()
    whole = {}
    for r in sorted(pieces, key=lambda r: (r["source_id"], r["ordinal"])):
        assert r["at"] == len(whole.setdefault(r["source_id"], b"")) and len(r["chunk"]) <= 1024
        whole[r["source_id"]] += r["chunk"]
    assert {k: len(v) for k, v in whole.items()} == {f"s{i:02d}": 1000 * i for i in range(1, 12)}
    none = source.entries().where("false")
    assert source.read(none).count() == 0 and source.pieces(none).count() == 0
    assert source.read(source.entries().where("source_id = 's05'")).first()["content"] == bytearray(b"f" * 5000)


def test_manifests_of_other_forms(spark, tmp_path):
    source = files.FolderSource(spark, *folder_of(tmp_path))
    source.entries().write.parquet(str(tmp_path / "m.parquet"))
    source.entries().coalesce(1).write.json(str(tmp_path / "m.jsonl"))
    for name in ("m.parquet", "m.jsonl"):
        assert files.manifest(spark, str(tmp_path / name)).exceptAll(source.entries()).count() == 0


def test_items_written_by_tasks(spark, tmp_path):
    rows = spark.createDataFrame([("x/a.txt", bytearray(b"one"), None), ("b.png", None, "side"), ("x/y/c", bytearray(b""), "s")], "path string, content binary, ocr_text string")
    assert sinks.write_items(rows.repartition(3), str(tmp_path / "o")) == 3
    got = {str(p.relative_to(tmp_path / "o")): p.read_bytes() for p in (tmp_path / "o").rglob("*") if p.is_file()}
    assert got == {"x/a.txt": b"one", "b.png.ocr.txt": b"side", "x/y/c": b"", "x/y/c.ocr.txt": b"s"}


def test_labels_and_artefact(spark, tmp_path):
    (tmp_path / "l.json").write_text(json.dumps({"a": {"dev": [[80, 1], [20.5, 0]], "holdout": []}}))
    assert sorted(tuple(r) for r in files.labels(spark, str(tmp_path / "l.json")).collect()) == [("a", "dev", 20.5, 0), ("a", "dev", 80.0, 1)]
    (tmp_path / "c.json").write_text(json.dumps({"version": "1", "categories": {"a": {"status": "calibrated"}}}))
    r = files.calibration(spark, str(tmp_path / "c.json")).first()
    assert (r["method"], r["a"], r["x"]) == ("identity", 0.0, [])
    assert files.earlier(spark, str(tmp_path / "none"), "source_id string").count() == 0


def test_sinks(spark, tmp_path):
    df = spark.createDataFrame([("b", None), ("a", 1)], "source_id string, n int")
    sinks.write(df, str(tmp_path / "o"))
    lines = [json.loads(x) for p in sorted((tmp_path / "o").glob("part-*")) for x in p.read_text().splitlines()]
    assert lines == [{"source_id": "a", "n": 1}, {"source_id": "b", "n": None}]
    with pytest.raises(ValueError):
        sinks.write(df, str(tmp_path / "p"), "csv")
    with pytest.raises(ValueError):
        sinks.write(df.withColumn("text", F.lit("x")), str(tmp_path / "q"))


def zipped(parts: dict[str, str]) -> bytes:
    out = io.BytesIO()
    with zipfile.ZipFile(out, "w") as z:
        for name, value in parts.items():
            z.writestr(name, value)
    return out.getvalue()


def docx() -> bytes:
    w = 'xmlns:w="http://schemas.openxmlformats.org/wordprocessingml/2006/main"'
    p = lambda t: f"<w:p><w:r><w:t>{t}</w:t></w:r></w:p>"
    wide = f'<w:tc><w:tcPr><w:gridSpan w:val="2"/></w:tcPr>{p(" wide ")}</w:tc>'
    rows = f"<w:tr><w:tc>{p('cell')}</w:tc><w:tc>{p('')}</w:tc></w:tr><w:tr>{wide}</w:tr>"
    body = p(" one ") + p("  ") + p("two") + f"<w:tbl>{rows}</w:tbl>"
    return zipped({"word/document.xml": f"<w:document {w}><w:body>{body}</w:body></w:document>"})


def xlsx() -> bytes:
    m = 'xmlns="http://schemas.openxmlformats.org/spreadsheetml/2006/main"'
    r = 'xmlns:r="http://schemas.openxmlformats.org/officeDocument/2006/relationships"'
    cells = (
        '<c r="A1" t="s"><v>0</v></c><c r="B1"><v>3</v></c><c r="C1"><v>0.50</v></c><c r="D1" t="b"><v>1</v></c><c r="E1" t="e"><v>#DIV/0!</v></c>'
        '<c r="F1" s="1"><v>46037</v></c><c r="G1" s="2"><v>0.5</v></c><c r="H1" t="inlineStr"><is><t> in </t></is></c><c r="I1"/>'
    )
    return zipped({
        "xl/workbook.xml": f'<workbook {m} {r}><sheets><sheet name="Data" sheetId="1" r:id="x1"/></sheets></workbook>',
        "xl/_rels/workbook.xml.rels": '<Relationships xmlns="http://schemas.openxmlformats.org/package/2006/relationships"><Relationship Id="x1" Target="worksheets/sheet1.xml"/></Relationships>',
        "xl/sharedStrings.xml": f"<sst {m}><si><t> shared </t></si></sst>",
        "xl/styles.xml": f'<styleSheet {m}><numFmts><numFmt numFmtId="170" formatCode="hh:mm"/></numFmts><cellXfs><xf numFmtId="0"/><xf numFmtId="14"/><xf numFmtId="170"/></cellXfs></styleSheet>',
        "xl/worksheets/sheet1.xml": f"<worksheet {m}><sheetData><row>{cells}</row></sheetData></worksheet>",
    })


DOCX = "application/vnd.openxmlformats-officedocument.wordprocessingml.document"
XLSX = "application/vnd.openxmlformats-officedocument.spreadsheetml.sheet"


def extracted(spark, start, rows):
    df = spark.createDataFrame([(*r, f"{r[0]}.bin") for r in rows], "source_id string, content_type string, content binary, path string")
    out = df.select("source_id", engines.extracted(start, F.col("content"), F.col("content_type"), F.col("path")).alias("x"))
    return {r["source_id"]: r["x"] for r in out.collect()}


def test_native_documents(spark):
    rows = [
        ("d", DOCX, bytearray(docx())), ("bad", DOCX, bytearray(b"no zip")), ("t", "text/plain", bytearray("é\n\nb".encode())), ("x", "text/plain", bytearray(b"\xff")),
        ("s", XLSX, bytearray(xlsx())), ("i", "image/png", bytearray(b"text")), ("n", "text/plain", None),
    ]
    got = extracted(spark, lambda: engines.native, rows)
    place = lambda r: [(s["location"]["char_start"], s["location"]["sheet"], s["location"]["cell"], s["text"]) for s in r["spans"]]
    assert got["d"]["text"] == "one\ntwo\ncell\nwide\nwide" and got["d"]["complete"]
    assert place(got["d"]) == [(0, None, None, "one"), (4, None, None, "two"), (None, "table0", "r0c0", "cell"), (None, "table0", "r1c0", "wide"), (None, "table0", "r1c1", "wide")]
    assert [(c, t) for _, _, c, t in place(got["s"])] == [
        ("A1", "shared"), ("B1", "3"), ("C1", "0.5"), ("D1", "True"), ("E1", "#DIV/0!"), ("F1", "2026-01-15 00:00:00"), ("G1", "12:00:00"), ("H1", "in"),
    ]
    assert got["bad"]["code"] == "extraction_error" and got["t"]["text"] == "é\n\nb" and [s["location"]["char_start"] for s in got["t"]["spans"]] == [0, 3]
    assert got["x"]["text"] is None and got["x"]["code"] is None and got["i"]["text"] is None and got["n"]["text"] is None


class Fake:
    def __init__(self, answer):
        self.answer, self.asked = answer, []

    def post(self, url, body, headers=None):
        if isinstance(self.answer, Exception):
            raise self.answer
        return self.answer(url, body) if callable(self.answer) else self.answer

    def send(self, url, data, method="POST", headers=None):
        return self.answer


def test_extraction_services(spark):
    data = [("a", "image/png", bytearray(b"x"))]
    of = lambda answer, engine=engines.docling: extracted(spark, engine("http://h/", make=lambda: Fake(answer)), data)["a"]
    assert of({"status": "failure"})["code"] == "extraction_error" and of(engines.EngineError("down"))["code"] == "extraction_error"
    part = of({"status": "partial", "document": {"md_content": " one\ntwo "}})
    assert (part["text"], part["complete"], [s["location"]["char_start"] for s in part["spans"]]) == ("one\ntwo", False, [0, 4])
    whole = of({"status": "success", "document": {"text_content": "t"}})
    assert whole["complete"] and of({"status": "success"})["text"] is None and of({"status": "success"})["code"] is None
    named = of(lambda url, body: {"status": "success", "document": {"text_content": url + " " + body["sources"][0]["filename"]}})
    assert named["text"] == "http://h/v1/convert/source a.bin"
    text = of(b" plain \n", engines.tika)
    assert (text["text"], text["complete"], len(text["spans"])) == ("plain", True, 1) and of(b"  ", engines.tika)["text"] is None


def test_ocr_and_analyser_services(spark):
    data = spark.createDataFrame([("a", bytearray(b"x"), "a.png")], "source_id string, content binary, path string")
    ocr = lambda answer: data.select(engines.recognised(engines.docling_ocr("http://h", make=lambda: Fake(answer)))(F.col("content"), F.col("path")).alias("t")).first()["t"]
    assert ocr({"status": "success", "document": {"text_content": " seen "}}) == "seen"
    assert ocr({"status": "failure"}) is None and ocr({"status": "success", "document": {"text_content": " "}}) is None and ocr(engines.EngineError("down")) is None
    texts = spark.createDataFrame([("a", "hello")], "source_id string, text string")
    found = lambda answer: texts.select(engines.entities(engines.presidio_http("http://h", make=lambda: Fake(answer)), F.col("text")).alias("n")).first()["n"]
    assert found([{"entity_type": "X", "start": 0, "end": 2, "score": 1}])["results"][0]["end"] == 2
    assert found(engines.EngineError("down"))["code"] == "detection_error" and found([{"start": 1}])["code"] == "internal_error"


BASE = {"source": {"backend": "sample", "root": "r", "manifest": "m"}}


def test_model_service(spark, monkeypatch):
    seen = []

    def answer(url, body):
        seen.append(body)
        return {"choices": [{"message": {"content": '{"score": 140}'}}]}

    local = config.from_mapping({**BASE, "inference": {"provider": "openweight", "base_url": "http://localhost:1"}})
    one = engines.open_weight(local, make=lambda: Fake(answer))()
    assert one("call someone@mail.example.com", ["a", "b"]) == ([("a", 100.0), ("b", 100.0)], 29)
    shape = seen[0]["response_format"]["json_schema"]["schema"]["properties"]["score"]
    assert shape == {"type": "integer", "minimum": 0, "maximum": 100} and "someone@" in seen[0]["messages"][1]["content"]
    df = spark.createDataFrame([("t", ["x"]), (None, ["x"])], "s string, c array<string>")
    got = df.select(engines.scores(engines.open_weight(local, make=lambda: Fake(answer)), F.col("s"), F.col("c")).alias("m")).collect()
    assert got[0]["m"]["scores"][0]["score"] == 100.0 and got[1]["m"]["scores"] is None
    down = df.select(engines.scores(engines.open_weight(local, make=lambda: Fake(engines.EngineError("down"))), F.col("s"), F.col("c"))["code"].alias("c")).first()
    assert down["c"] == "internal_error"
    remote = {"provider": "openweight", "base_url": "http://far.example", "is_local": False}
    with pytest.raises(PermissionError):
        engines.open_weight(config.from_mapping({**BASE, "inference": remote}))
    allowed = config.from_mapping({**BASE, "inference": {**remote, "approval_written": True, "hash_key_env": "SIEVELINE_TEST_KEY"}})
    one = engines.open_weight(allowed, make=lambda: Fake(answer))()
    with pytest.raises(RuntimeError):
        one("text", ["a"])
    monkeypatch.setenv("SIEVELINE_TEST_KEY", "k")
    one("mail someone@mail.example.com or +1 (212) 555-0187, https://www.linkedin.com/in/some-one?x=1", ["a"])
    sent = seen[-1]["messages"][1]["content"]
    assert "someone" not in sent and "555" not in sent and "some-one" not in sent and all(f"<{k}:" in sent for k in ("email", "phone", "linkedin"))


def test_factories():
    of = lambda **parts: config.from_mapping({**BASE, **parts})
    plain = of()
    assert all(f(plain) is None for f in (engines.extraction_engine, engines.ocr_engine, engines.detector, engines.provider, engines.embedder))
    for f, parts in (
        (engines.extraction_engine, {"extract": {"engine": "docling"}}), (engines.extraction_engine, {"extract": {"engine": "tika"}}), (engines.extraction_engine, {"extract": {"engine": "no"}}),
        (engines.ocr_engine, {"ocr": {"provider": "docling"}}), (engines.ocr_engine, {"ocr": {"provider": "no"}}), (engines.detector, {"detect": {"engine": "presidio_http"}}),
        (engines.detector, {"detect": {"engine": "no"}}), (engines.provider, {"inference": {"provider": "openweight"}}), (engines.provider, {"inference": {"provider": "no"}}),
    ):
        with pytest.raises(ValueError):
            f(of(**parts))
    assert engines.extraction_engine(of(extract={"engine": "native"}))() is engines.native
    assert callable(engines.ocr_engine(of(ocr={"provider": "docling", "url": "http://h"}))) and callable(engines.embedder(of(semantic={"enabled": True})))


def test_event_frames(spark, tmp_path):
    rows = spark.createDataFrame([(0, "a", "extract", "decode", None)], "ordinal long, source_id string, stage string, outcome string, exception_code string")
    rows.write.json(str(tmp_path / "events"))
    ingest.live_events(spark, str(tmp_path / "events"), str(tmp_path / "out"), str(tmp_path / "check")).awaitTermination()
    got = "".join(p.read_text() for p in sorted((tmp_path / "out").glob("part-*")))
    assert json.loads(got.strip().removeprefix("data: ")) == {"event": "stage", "source_id": "a", "stage": "extract", "outcome": "decode", "exception_code": None}


def test_stream_twice_adds_nothing(spark, tmp_path):
    docs = spark.createDataFrame([(i, f"mail u{i}@x.example.com" if i % 2 else "nothing") for i in range(20)], "doc_id long, text string")
    docs.repartition(3).write.parquet(str(tmp_path / "documents.parquet"))
    got = ingest.run_available_now(spark, str(tmp_path / "documents.parquet"), runs=2).collect()
    assert len(got) == 20 and sum(r["n_findings"] for r in got) == 10
