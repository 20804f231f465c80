"""The item pipeline on a rebuilt five-item corpus, the decision table and its boundaries."""

from __future__ import annotations

import hashlib
import random
import time

import pytest
from pyspark.sql import functions as F

from sieveline import config
from sieveline.functions import identifiers, numbers, text
from sieveline.operators import calibration, items
from sieveline.plans import jobs, queries

RULES = (config.Recogniser("FIN-001", "financial", r"ACCT-\d{6}"), config.Recogniser("GOV-001", "government_id", r"GOVID-[A-Z]{2}\d{6}"))
HINTS = {"financial": "ledger", "government_id": "govid", "health": "diagnosis"}


def corpus(spark):
    def row(i, kind, data, ocr=None, wrong=False):
        return (i, kind, hashlib.sha256(data + (b"#" if wrong else b"")).hexdigest(), bytearray(data), ocr, None, None, None, None)

    rows = [
        row("note_001", "text/plain", b"First line of a note\nPlease settle ACCT-123456 and ACCT-654321\nThanks"),
        row("note_002", "text/plain", b"Nothing here\nof any note\nat all"),
        row("doc_born_001", "application/pdf", b"The quarterly ledger was closed\nwith no remarks"),
        row("scan_001", "image/png", b"\x89PNG\r\n\x1a\n\xff\xfe", "Card of the bearer reads GOVID-AB123456 in print"),
        row("unreadable_001", "application/octet-stream", b"\x00\x01"),
        row("changed_001", "text/plain", b"other bytes", wrong=True),
        row("scan_002", "image/png", b"\x89PNG"),
        row("blank_001", "text/plain", b"   \n "),
        row("scan_003", "image/png", b"\x89PNG2", "  "),
    ]
    ddl = "source_id string, content_type string, content_hash string, content binary, ocr_text string, author string, datetime string, linked_executive string, linked_project string"
    return spark.createDataFrame(rows, ddl)


def analysed(spark):
    rows = items.ocr_gate(items.extract(items.ingest(corpus(spark))))
    scoring = config.Scoring()
    found = F.concat(items.rule_findings(RULES), items.apply_calibration(items.model_findings(tuple(HINTS), HINTS, scoring), scoring))
    return rows.withColumn("findings", F.when(F.col("exception_code").isNull(), found).otherwise(items.no_findings()))


def test_golden_items(spark):
    got = {r["source_id"]: r for r in items.summarise(analysed(spark)).collect()}
    assert len(got) == 9
    status = {k: (r["flag_status"], r["processing_status"], r["exception_code"]) for k, r in got.items()}
    assert status == {
        "note_001": ("flagged", "complete", None), "note_002": ("not_flagged", "complete", None), "doc_born_001": ("flagged", "complete", None),
        "scan_001": ("flagged", "complete", None), "unreadable_001": ("unable_to_process", "partial", "unsupported_type"),
        "changed_001": ("unable_to_process", "partial", "hash_mismatch"), "scan_002": ("unable_to_process", "partial", "ocr_failure"),
        "blank_001": ("unable_to_process", "partial", "ocr_failure"), "scan_003": ("not_flagged", "partial", None),
    }
    assert got["note_001"]["reason_summary"] == "financial:FIN-001; financial:FIN-001"
    assert got["scan_001"]["reason_summary"] == "government_id:GOV-001; government_id:model_score(90)"
    assert (got["scan_001"]["strongest_score_type"], got["scan_001"]["strongest_score"]) == ("deterministic_match", None)
    assert (got["doc_born_001"]["strongest_band"], got["doc_born_001"]["strongest_score"], got["doc_born_001"]["calibration_status"]) == ("high", 90.0, "not_calibrated")
    assert got["unreadable_001"]["reason_summary"] == "unable to process (unsupported_type)" and got["note_002"]["reason_summary"] == "no finding above threshold"


def test_findings_hold_no_text(spark):
    rows = items.findings_rows(analysed(spark))
    assert not {"text", "content", "ocr_text"} & set(rows.columns)
    got = {(r["source_id"], r["finding_id"]): r["location"] for r in rows.collect()}
    assert set(got) == {("note_001", "FIN-001-0"), ("note_001", "FIN-001-1"), ("doc_born_001", "model-financial"), ("scan_001", "GOV-001-0"), ("scan_001", "model-government_id")}
    assert (got["note_001", "FIN-001-0"]["char_start"], got["note_001", "FIN-001-0"]["char_end"]) == (35, 46)


def test_reconcile_and_events(spark):
    rows = items.summarise(analysed(spark))
    r = jobs.reconcile(rows, corpus(spark)).first()
    assert (r["input_count"], r["flagged"], r["not_flagged"], r["unable_to_process"], r["one_row_per_input"], r["reconciled"]) == (9, 3, 2, 4, True, True)
    doubled = jobs.reconcile(rows.unionByName(rows.limit(1)), corpus(spark)).first()
    assert not doubled["one_row_per_input"]
    events: dict = {}
    for e in items.events(analysed(spark)).orderBy("source_id", "ordinal").collect():
        events.setdefault(e["source_id"], []).append((e["stage"], e["outcome"]))
    assert events["scan_002"] == [("extract", "decode"), ("pipeline", "failed")]
    assert events["scan_001"] == [("extract", "decode"), ("ocr_gate", "ocr")]
    assert events["unreadable_001"] == [("pipeline", "failed")]


def test_partitioning_does_not_matter(spark):
    a = {tuple(map(str, r)) for r in items.summarise(analysed(spark)).collect()}
    b = {tuple(map(str, r)) for r in items.summarise(analysed(spark).repartition(7)).collect()}
    assert a == b


@pytest.mark.parametrize("score, band", [(80.0, "high"), (79.9, "medium"), (60.0, "medium"), (59.9, "low"), (40.0, "low")])
def test_bands(spark, score, band):
    assert spark.range(1).select(numbers.band(F.lit(score)).alias("b")).first()["b"] == band


def test_cosine_and_maps(spark):
    vec = lambda *v: F.array(*[F.lit(float(x)) for x in v])
    one = lambda c: spark.range(1).select(c.alias("x")).first()["x"]
    assert one(numbers.cosine(vec(1, 2), vec(2, 4))) == pytest.approx(1) and one(numbers.cosine(vec(1, 0), vec(0, 1))) == 0 and one(numbers.cosine(vec(0, 0), vec(1, 1))) == 0
    with pytest.raises(Exception, match="different lengths"):
        one(numbers.cosine(vec(1), vec(1, 2)))
    x, y = vec(0.1, 0.4, 0.9), vec(0.0, 0.5, 1.0)
    knots = [one(numbers.interpolate(F.lit(s), x, y)) for s in (0.0, 0.1, 0.25, 0.4, 0.9, 1.0)]
    assert knots == pytest.approx([0, 0, 0.25, 0.5, 1, 1])


def test_lines_and_places(spark):
    df = spark.createDataFrame([("a\r\n\nbc\x0bd é\n",), ("",), ("x",)], "t string")
    got = [[(s["char_start"], s["char_end"], s["text"]) for s in r["s"]] for r in df.select(text.line_spans(F.col("t")).alias("s")).collect()]
    want = []
    for t in ("a\r\n\nbc\x0bd é\n", "", "x"):
        at, spans = 0, []
        for line in t.splitlines(keepends=True):
            body = line.removesuffix("\n")
            if body:
                spans.append((at, at + len(body), body))
            at += len(line)
        want.append(spans)
    assert got == want
    loc = spark.range(1).select(text.evidence(text.char_location(F.lit(3), F.lit(9))).alias("e")).first()["e"]
    assert loc == "chars 3–9"


def test_masks(spark):
    value = "write to ann.b@mail.example.com or +1 212 555 0187 via https://www.linkedin.com/in/ann?x=1"
    masked = identifiers.mask_text(value, b"k")
    assert "@" not in masked and "555" not in masked and "<linkedin:" in masked and "<phone:" in masked and masked.count("<") == 3
    native = spark.createDataFrame([(value,), ("none",)], "t string").select(identifiers.mask_emails(F.col("t"), "k").alias("m")).collect()
    assert native[0]["m"] == value.replace("ann.b@mail.example.com", f"<email:{identifiers.digest16('ann.b@mail.example.com', b'k')}>") and native[1]["m"] == "none"


def test_calibration_status(spark):
    rows = [("a", "dev", 80.0, 1)] * 120 + [("a", "dev", 20.0, 0)] * 20 + [("a", "holdout", 80.0, 1)] * 10 + [("b", "dev", 10.0, 0)] * 3 + [("c", "dev", 50.0, 1)] * 5
    labels = spark.createDataFrame(rows, "category string, split string, score double, label int")
    got = {r["category"]: r["status"] for r in calibration.fit(labels, "sigmoid", max_error=100.0).collect()}
    assert got == {"a": "calibrated", "b": "not_calibrated", "c": "provisional"}
    grouped = spark.createDataFrame([("a", 30.0, 1, 0), ("a", 10.0, 1, 0), ("a", 20.0, 1, 1), ("a", 40.0, 1, 1)], "category string, score double, n long, pos long")
    assert [tuple(r) for r in calibration.fit_isotonic(grouped).collect()] == [("a", [0.1, 0.2, 0.3, 0.4], [0.0, 0.5, 0.5, 1.0])]
    with pytest.raises(ValueError):
        calibration.fit(labels, "spline")


def test_ner_mapping(spark):
    detect = config.Detect(category_map={"CARD": "financial", "PERSON": "contact"}, deterministic_entities=("CARD",))
    ddl = "r array<struct<entity_type:string,start:int,end:int,score:double>>"
    df = spark.createDataFrame([([("URL", 0, 3, 0.9), ("CARD", 4, 9, 0.95), ("PERSON", 10, 12, 0.8)],)], ddl)
    got = df.select(F.explode(items.ner_findings(F.col("r"), detect)).alias("f")).select("f.*").collect()
    assert [(r["finding_id"], r["score_type"], r["score"]) for r in got] == [("CARD-1", "deterministic_match", None), ("PERSON-2", "classifier_score", 80.0)]


def test_config():
    good = {"source": {"backend": "sample", "root": "r", "manifest": "m"}, "scoring": {"flag_threshold": 50}, "detect": {"recognisers": [{"rule_id": "a", "category": "b", "pattern": "c"}]}}
    cfg = config.from_mapping(good)
    assert cfg.scoring.flag_threshold == 50.0 and cfg.detect.recognisers[0].rule_id == "a" and cfg.ocr_gate.min_text_density == 0.15
    for bad in ({}, [], {**good, "other": 1}, {**good, "inference": {"is_local": True, "base_url": "http://far.example/v1"}}):
        with pytest.raises(ValueError):
            config.from_mapping(bad)
    with pytest.raises(PermissionError):
        config.ensure_egress_allowed(True, False)


def test_registry(spark):
    ddl = "job_id string, status string, flagged long, not_flagged long, unable long, progress long, created_at string"
    rows = [("a", "completed", 2, 0, 0, 2, "1"), ("b", "cancelled", 1, 0, 1, 2, "2"), ("c", "failed", 0, 0, 1, 1, "3"), ("d", "queued", 0, 0, 0, 1, "4")]
    df = spark.createDataFrame(rows, ddl)
    r = jobs.migration_summary(df, 10).first()
    assert (r["processed"], r["flagged"], r["unable"], r["in_progress"], r["remaining"], r["percent"]) == (5, 3, 2, 1, 4, 50.0)
    over = jobs.migration_summary(df, 3).first()
    assert (over["percent"], over["remaining"]) == (100.0, 0)
    assert jobs.queue_head(df).first()["job_id"] == "d" and [x["job_id"] for x in jobs.newest(df, 2).collect()] == ["d", "c"]
    events = spark.createDataFrame([("a", 1, "queued"), ("a", 3, "completed"), ("a", 2, "running")], "job_id string, seq long, status string")
    assert jobs.latest(events).first()["status"] == "completed"


def test_run_id_and_resume(spark):
    m = spark.createDataFrame([("b", "2"), ("a", "1")], "source_id string, content_hash string")
    assert jobs.run_id(m, "v", 7).first()["run_id"] == hashlib.sha256(b"a1b2v7").hexdigest()[:12]
    assert len(jobs.large_run_id(m, "v", 7).first()["run_id"]) == 12
    done = m.limit(1)
    assert jobs.remaining(m, done).count() == 1 and jobs.unknown_ids(spark.createDataFrame([("z",), ("a",)], "source_id string"), m).first()["source_id"] == "z"


def test_catalogue():
    from sieveline.plans import oracles

    assert set(oracles.SQL) <= set(queries.QUERIES) and len(queries.QUERIES) >= 40


def test_ledgers_and_pages(spark):
    events = lambda *rows: spark.createDataFrame(list(rows), "source_id string, stage string")
    final = lambda *rows: spark.createDataFrame(list(rows), "source_id string, flag_status string")
    merged = jobs.merge_ledgers((events(("a", "extract")), final(("a", "flagged"), ("b", "flagged"))), (events(("b", "extract"), ("b", "ocr_gate")), final(("b", "not_flagged"))))
    assert merged[0].count() == 3 and {tuple(r) for r in merged[1].collect()} == {("a", "flagged"), ("b", "not_flagged")}
    assert [jobs.next_offset(o, 2, 5) for o in (0, 2, 4)] == [2, 4, None]
    rows = final(("c", "x"), ("a", "x"), ("b", "x"))
    assert [r["source_id"] for r in jobs.page(rows, 1, 2).collect()] == ["b", "c"]


def test_locations_between_spans(spark):
    """A line feed that joins two spans belongs to neither; a span without an anchor gives offsets."""
    place = "struct<page:int,sheet:string,cell:string,char_start:int,char_end:int>"
    spans = [((1, None, None, None, None), "ab"), ((None, "S", "B2", None, None), "cd"), ((None, None, None, 6, 8), "ef")]
    df = spark.createDataFrame([(spans,)], f"s array<struct<location:{place},text:string>>")
    at = lambda k: text.resolve_location(F.col("s"), F.lit(k), F.lit(k + 1))
    r = df.select(*[text.evidence(at(k)).alias(f"e{k}") for k in (0, 1, 2, 3, 5, 6, 9)]).first()
    assert list(r) == ["p1", "p1", "chars 2–3", "sheet S, cell B2", "chars 5–6", "chars 6–7", "chars 9–10"]


def test_merge_of_offsets_and_spans(spark):
    """Against a plain search: equal and empty spans, offsets in any order, before the first span and in gaps."""
    rng = random.Random(3)
    rows = []
    for k in range(60):
        lows = sorted(rng.sample(range(600), rng.choice([0, 1, 2, 40, 300])))
        rows.append((k, lows, [rng.randrange(-5, 620) for _ in range(rng.choice([0, 1, 3, 500]))]))
    df = spark.createDataFrame(rows, "k int, lows array<int>, points array<int>")
    got = {r["k"]: (r["o"], r["m"]) for r in df.select("k", text.owners(F.col("lows"), F.col("points")).alias("o"), text.latest(F.col("points")).alias("m")).collect()}
    for k, lows, points in rows:
        assert got[k][0] == [sum(x <= p for x in lows) - 1 for p in points]
        assert got[k][1] == [max(points[: i + 1]) for i in range(len(points))]


def test_many_anchored_matches_in_one_text(spark, tmp_path):
    """64,000 matches in 64,000 cells, one text: seconds, and four times as many do not take sixteen times as long."""
    rule = (config.Recogniser("A-1", "a", r"x\d", "r"),)

    def took(n):
        cells = F.transform(F.sequence(F.lit(0), F.lit(n - 1)), lambda i: F.struct(text.char_location(F.lit(0), F.lit(0)).withField("sheet", F.lit("s")).withField("cell", F.concat(F.lit("c"), i.cast("string"))).alias("location"), F.concat(F.lit("ab x"), (i % 10).cast("string")).alias("text")))
        df = spark.range(1).select(cells.alias("spans")).withColumn("text", F.array_join(F.transform("spans", lambda s: s["text"]), "\n"))
        df.write.parquet(str(tmp_path / str(n)))
        df = spark.read.parquet(str(tmp_path / str(n)))
        found = df.select(items.rule_findings(rule, spans="spans").alias("f"))
        start = time.perf_counter()
        r = found.select(F.size("f").alias("n"), F.get("f", F.lit(n - 1))["location"]["cell"].alias("last"), F.array_distinct(F.transform("f", lambda f: f["location"]["cell"])).alias("cells")).first()
        assert (r["n"], r["last"], len(r["cells"])) == (n, f"c{n - 1}", n)
        return time.perf_counter() - start

    took(100)
    small, large = took(16_000), took(64_000)
    assert large < 10 and large < 12 * small, (small, large)
