"""Runs over a small sample, jobs, the registry and the command line."""

from __future__ import annotations

import hashlib
import json
import os

import pytest
from pyspark.sql import functions as F

from sieveline import __main__ as cli
from sieveline import config
from sieveline.operators import engines
from sieveline.plans import registry as reg
from sieveline.plans import runner, service
from sieveline.sources import files

ITEMS = (
    ("doc_born_001", "application/pdf", "doc_born_001.pdf", b"The annual salary review is attached."),
    ("note_001", "text/plain", "note_001.txt", b"Refer to ACCT-123456 and ACCT-654321."),
    ("note_002", "text/plain", "note_002.txt", b"Lunch is at noon."),
    ("scan_001", "image/png", "scan_001.png", b"\x89PNG"),
    ("unreadable_001", "application/octet-stream", "unreadable_001.dat", b"\x00\x01"),
)
RULES = [
    {"rule_id": "FIN-001", "category": "financial", "pattern": r"ACCT-\d{6}", "reason_code": "financial_account_ref"},
    {"rule_id": "GOV-001", "category": "government_id", "pattern": r"GOVID-[A-Z]{2}\d{6}", "reason_code": "government_id_ref"},
]


def sample(folder, **parts):
    """Writes the sample and answers with a configuration of it."""
    (folder / "root").mkdir()
    entries = []
    for i, kind, path, data in ITEMS:
        (folder / "root" / path).write_bytes(data)
        entries.append({"source_id": i, "content_type": kind, "content_hash": hashlib.sha256(data).hexdigest(), "path": path, "author": "a"})
    (folder / "root" / "scan_001.png.ocr.txt").write_text("Holder GOVID-AB123456 passport")
    (folder / "frozen.json").write_text(json.dumps(entries))
    return sample_of(folder, **parts)


def sample_of(folder, **parts):
    return {
        "config_version": "t-1", "seed": 7, "source": {"backend": "sample", "root": str(folder / "root"), "manifest": str(folder / "frozen.json")},
        "inference": {"provider": "mock", "mock_hints": {"financial": "salary", "government_id": "passport"}},
        "taxonomy": {"version": "x", "categories": ["financial", "government_id"]}, "detect": {"recognisers": RULES}, "output": {"result_dir": str(folder / "out")}, **parts,
    }


def run_of(spark, value, **own):
    ctx = runner.build(spark, config.from_mapping(value), **own)
    return ctx, runner.run(ctx)


def test_full_run(spark, tmp_path):
    ctx, result = run_of(spark, sample(tmp_path))
    assert result.reconcile == {"input_count": 5, "flagged": 3, "not_flagged": 1, "unable_to_process": 1, "one_row_per_input": True, "reconciled": True}
    rows = result.rows(spark)
    got = {r["source_id"]: r for r in rows["item_summary"].collect()}
    assert got["doc_born_001"]["strongest_score_type"] == "model_score" and got["doc_born_001"]["sensitivity_categories"] == ["financial"]
    assert got["note_001"]["strongest_band"] == "deterministic" and got["scan_001"]["sensitivity_categories"] == ["government_id"]
    assert got["unreadable_001"]["exception_code"] == "unsupported_type" and got["note_002"]["flag_status"] == "not_flagged"
    assert {(r["snapshot_id"], r["run_id"], r["config_version"]) for r in got.values()} == {("sample:frozen", result.run_id, "t-1")}
    found = [(r["source_id"], r["finding_id"], r["reason_code"], r["reason"]) for r in rows["findings"].orderBy("source_id", "finding_id").collect()]
    assert ("note_001", "FIN-001-1", "financial_account_ref", "rule FIN-001 matched") in found
    assert ("doc_born_001", "model-financial", "model_flag", "model score 90 >= flag threshold") in found
    stages = [(r["source_id"], r["stage"], r["outcome"]) for r in rows["stage_events"].orderBy("source_id", "ordinal").collect()]
    assert stages[-1] == ("unreadable_001", "pipeline", "failed") and ("scan_001", "ocr_gate", "ocr") in stages and len(stages) == 9
    again = runner.run(ctx)
    assert again.run_id == result.run_id
    past = files.kept(spark, runner.history(ctx.cfg), result.run_id).collect()
    assert len(past) == 5 and {r["source_id"]: r["flag_status"] for r in past} == {k: r["flag_status"] for k, r in got.items()}
    written = "".join(p.read_text() for p in (tmp_path / "out").rglob("*.json"))
    assert "ACCT-" not in written and "salary review" not in written, "results hold no contents"


def test_engines_in_a_run(spark, tmp_path):
    """An extractor with pages, an analyser, an OCR engine, a screen and a provider, all fakes; and calibration maps."""
    def extract(data, content_type, path):
        if path == "note_002.txt":
            raise engines.EngineError("corrupt")
        if path.endswith(".png"):
            return None, [], False
        lines = data.decode().split(" ")
        return "\n".join(lines), [(engines.location(page=n), t) for n, t in enumerate(lines, 1)], True

    analyse = lambda text: [{"entity_type": "ACC", "start": text.index("ACCT"), "end": text.index("ACCT") + 4, "score": 0.7}] if "ACCT" in text else []
    embed = lambda texts: [[1.0, 0.0] if "salary" in t else [0.0, 1.0] for t in texts]

    def score(span, categories):
        if "passport" in span:
            raise ValueError("odd answer")
        return [(c, 81.0) for c in categories], len(span)

    (tmp_path / "cal.json").write_text(json.dumps({"version": "1", "categories": {"financial": {"status": "provisional", "method": "isotonic", "x": [0.0, 1.0], "y": [0.0, 0.5]}}}))
    value = sample(
        tmp_path, semantic={"enabled": True, "route_threshold": 0.5, "examples": {"financial": ["salary"], "government_id": ["passport"]}},
        detect={"engine": "presidio", "category_map": {"ACC": "financial"}, "detector_version": "d-1"}, scoring={"calibration": {"artefact": str(tmp_path / "cal.json")}},
    )
    own = {"extract": lambda: extract, "detect": lambda: analyse, "ocr": lambda: lambda data, path: "a passport", "embed": lambda: embed, "score": lambda: score}
    ctx, result = run_of(spark, value, **own)
    rows = result.rows(spark)
    got = {r["source_id"]: r for r in rows["item_summary"].collect()}
    assert got["note_002"]["exception_code"] == "extraction_error" and got["scan_001"]["exception_code"] == "internal_error"
    found = {(r["source_id"], r["finding_id"]): r for r in rows["findings"].collect()}
    entity = found["note_001", "ACC-0"]
    assert (entity["location"]["page"], entity["score_type"], entity["detector"], entity["rule_id"]) == (3, "classifier_score", "d-1", "ACC")
    assert (round(entity["score"], 6), entity["calibration_status"], entity["band"]) == (35.0, "provisional", "low")
    model = found["doc_born_001", "model-financial"]
    assert (model["score"], model["band"]) == (40.5, "low") and ("doc_born_001", "model-government_id") not in found, "only routed categories are asked about"
    screen = found["doc_born_001", "semantic-financial"]
    assert (screen["score_type"], screen["reason"], screen["reason_code"], screen["calibration_status"]) == ("similarity", "cosine 1.00 >= route threshold", "semantic_route", "not_applicable")
    # note_001 is routed to government_id alone, whose score of 81 stays raw
    assert got["note_001"]["strongest_score"] == 81.0 and got["note_001"]["reason_summary"] == "financial:classifier_score(35); government_id:model_score(81)"
    assert [r["stage"] for r in rows["stage_events"].where("source_id = 'note_002'").collect()] == ["pipeline"]


def test_similarity_alone_flags_nothing(spark, tmp_path):
    value = sample(tmp_path, semantic={"enabled": True, "examples": {"financial": ["x"]}}, detect={}, inference={})
    _, result = run_of(spark, value, embed=lambda: lambda texts: [[1.0] for _ in texts])
    rows = result.rows(spark)
    assert rows["findings"].where("score_type = 'similarity'").count() == 4 and result.reconcile["flagged"] == 0


def test_batches_resume_and_cancel(spark, tmp_path):
    ctx = runner.build(spark, config.from_mapping(sample(tmp_path)))
    assert runner.run_batch(ctx, "other").exception == "config_version mismatch: request=other config=t-1"
    assert "zz" in runner.run_batch(ctx, "t-1", ["note_001", "zz"]).exception
    asked = []
    stop = lambda: len(asked) > 0
    first = runner.run_batch(ctx, "t-1", batch_size=2, on_progress=asked.append, should_cancel=stop)
    assert first.status == "cancelled" and 0 < first.reconcile["input_count"] < 5 and first.reconcile["reconciled"]
    rest = []
    second = runner.run_batch(ctx, "t-1", batch_size=2, resume=True, on_progress=rest.append)
    assert second.status == "completed" and second.run_id == first.run_id and sum(rest) == 5 - first.reconcile["input_count"] and second.reconcile["input_count"] == 5
    assert second.reconcile == runner.run_batch(ctx, "t-1").reconcile
    third = []
    assert runner.run_batch(ctx, "t-1", resume=True, on_progress=third.append).reconcile["flagged"] == 3 and not third
    single = runner.run_single(ctx, "t-1", ["note_001"], third.append)
    assert single.folder != second.folder and [e["stage"] for e in third] == ["extract", "ocr_gate"]
    assert runner.run_single(ctx, "t-1", []).status == "failed" and runner.run_single(ctx, "t-1", ["zz"]).status == "failed"


def test_lost_rows_do_not_reconcile(spark, tmp_path, monkeypatch, capsys):
    """Full and single runs count against what was asked for: a row that is lost on the way shows."""
    ctx = runner.build(spark, config.from_mapping(sample(tmp_path)))
    whole = ctx.source.read
    monkeypatch.setattr(ctx.source, "read", lambda entries, side=True: whole(entries, side).where("source_id <> 'note_002'"))
    full = runner.run(ctx).reconcile
    assert full == {"input_count": 5, "flagged": 3, "not_flagged": 0, "unable_to_process": 1, "one_row_per_input": False, "reconciled": False}
    single = runner.run_single(ctx, "t-1", ["note_001", "note_002"]).reconcile
    assert (single["input_count"], single["flagged"], single["reconciled"]) == (2, 1, False)
    monkeypatch.setattr(files.FolderSource, "read", lambda self, entries, side=True: whole(entries, side).where("source_id <> 'note_002'"))
    yaml = pytest.importorskip("yaml")
    (tmp_path / "c.yaml").write_text(yaml.safe_dump(sample_of(tmp_path)))
    common = ["run", "--config", str(tmp_path / "c.yaml"), "--registry", str(tmp_path / "r"), "--source-id", "note_002"]
    assert cli.main(common, spark) == 1 and "reconciled=False" in capsys.readouterr().out


def job(i, status="queued", **more):
    return {"job_id": i, "status": status, "job_type": "batch", "config_version": "t-1", "payload": "{}", **more}


def test_registry(spark, tmp_path, monkeypatch):
    ticks = iter(range(1000))
    r = reg.Registry(spark, str(tmp_path / "r"), clock=lambda: f"2026-01-01T00:{next(ticks):04d}")
    monkeypatch.setattr(reg, "EVERY", 4)
    assert r.claim_next() is None and r.get("a") is None and r.state().count() == 0
    a = r.create(job("a", progress_total=3))
    with pytest.raises(reg.Exists):
        r.create(job("a"))
    with pytest.raises(ValueError):
        r.create(job("x", "unknown"))
    r.create(job("b"))
    assert r.request_cancel("none") is False and r.update(job("none")) is None
    assert r.claim_next()["job_id"] == "a" and r.get("a")["status"] == "running"
    r.add_progress("a")
    assert r.request_cancel("a") is True
    r.add_progress("a", 2)
    got = r.get("a")
    assert (got["progress_done"], got["cancel_requested"], got["created_at"], got["status"]) == (3, True, a["created_at"], "running")
    done = r.update({**got, "status": "completed", "flagged": 2, "not_flagged": 1, "unable": 0})
    assert done["status"] == "completed" and done["created_at"] == a["created_at"] and done["updated_at"] > a["updated_at"] and r.request_cancel("a") is False
    again = r.upsert(job("a", "running"))
    assert (again["status"], again["progress_done"], again["cancel_requested"], again["created_at"]) == ("running", 0, False, a["created_at"])
    r.update({**again, "status": "cancelled", "flagged": 2, "not_flagged": 1, "unable": 1})
    assert [x["job_id"] for x in r.newest(1).collect()] == ["b"] and [x["job_id"] for x in r.newest(status="cancelled").collect()] == ["a"]
    assert {x["status"]: x["jobs"] for x in r.by_status().collect()} == {"cancelled": 1, "queued": 1}
    m = r.migration_summary(10).first()
    assert (m["processed"], m["remaining"], m["percent"]) == (4, 6, 40.0)
    assert any((tmp_path / "r" / "folded").iterdir())


def test_two_writers_do_not_overwrite(spark, tmp_path):
    """A writer whose reading is out of date reads again: both claims are made, of different jobs."""
    one, two = (reg.Registry(spark, str(tmp_path / "r")) for _ in range(2))
    one.create(job("a"))
    one.create(job("b"))
    claimed, inner = [], one._events

    def late(last, folded):  # between one's reading and its writing, two claims
        events = inner(last, folded)
        one._events = inner
        claimed.append(two.claim_next()["job_id"])
        return events

    one._events = late
    claimed.append(one.claim_next()["job_id"])
    assert sorted(claimed) == ["a", "b"] and one.claim_next() is None


def test_service_and_worker(spark, tmp_path):
    cfg = config.from_mapping(sample(tmp_path))
    s = service.JobService(spark, cfg, reg.Registry(spark, str(tmp_path / "r")))
    assert s.submit(service.Request("batch", "other"))["status"] == "failed" and s.submit(service.Request("batch", "t-1", ("zz",)))["status"] == "failed"
    queued = s.submit(service.Request("batch", "t-1", None, 3))
    assert (queued["status"], queued["progress_total"]) == ("queued", 5)
    worker = service.Worker(s)
    assert worker.step() and not worker.step()
    done = s.registry.get(queued["job_id"])
    assert (done["status"], done["progress_done"], done["flagged"], done["unable"]) == ("completed", 5, 3, 1)
    retry = s.retry_failed(queued["job_id"])
    assert service.Request.of(retry["payload"]).source_ids == ("unreadable_001",) and s.retry_failed("none") is None
    assert s.cancel(retry["job_id"]) and worker.step() and s.registry.get(retry["job_id"])["status"] == "cancelled"
    broken = service.JobService(spark, cfg, s.registry, context=lambda *_: 1 / 0)
    bad = broken.submit(service.Request("batch", "t-1"))
    assert service.Worker(broken).step() and broken.registry.get(bad["job_id"])["exception"] == "worker execution error"
    events = list(s.run_interactive(service.Request("single", "t-1", ("note_001",))))
    assert [e["event"] for e in events] == ["stage", "stage", "item", "done"] and service.frame(events[0]).startswith("data: {") and events[-1]["result"]["reconcile"]["flagged"] == 1
    list(s.run_interactive(service.Request("single", "t-1", ("note_001",))))
    assert s.registry.state().where(F.col("job_id") == events[-1]["result"]["job_id"]).count() == 1
    assert [e["event"] for e in s.run_interactive(service.Request("single", "t-1", ("zz",)))] == ["error"]


def test_a_large_retry_is_a_table(spark, tmp_path, monkeypatch):
    monkeypatch.setattr(service, "INLINE", 0)
    s = service.JobService(spark, config.from_mapping(sample(tmp_path)), reg.Registry(spark, str(tmp_path / "r")))
    first = s.run_now(service.Request("batch", "t-1", None, 10))
    retry = s.retry_failed(first["job_id"])
    asked = service.Request.of(retry["payload"])
    assert asked.source_ids is None and [r["source_id"] for r in asked.ids(spark).collect()] == ["unreadable_001"] and retry["progress_total"] == 1
    assert service.Worker(s).step() and s.registry.get(retry["job_id"])["unable"] == 1
    assert [e["event"] for e in s.run_interactive(service.Request("single", "t-1"))].count("item") == 5, "all of the manifest"
    ids = spark.createDataFrame([("note_001",), ("note_001",), ("zz",)], "source_id string")
    assert "zz" in runner.run_batch(s.context(), "t-1", ids).exception and runner.run_batch(s.context(), "t-1", ids.where("source_id <> 'zz'")).reconcile["input_count"] == 1


def test_command_line(spark, tmp_path, capsys):
    yaml = pytest.importorskip("yaml")
    (tmp_path / "c.yaml").write_text(yaml.safe_dump(sample(tmp_path)))
    common = ["run", "--config", str(tmp_path / "c.yaml"), "--registry", str(tmp_path / "r")]
    assert cli.main(common, spark) == 0
    out = capsys.readouterr().out
    assert "reconcile: input=5 flagged=3 not_flagged=1 unable_to_process=1 reconciled=True" in out and "note_001 |" not in out
    assert cli.main([*common, "--source-id", "note_001"], spark) == 0 and "note_001 | flagged | cats=['financial']" in capsys.readouterr().out
    assert cli.main([*common, "--source-id", "zz"], spark) == 1
    (tmp_path / "l.json").write_text(json.dumps({"a": {"dev": [[90, 1], [10, 0]] * 120, "holdout": [[100, 1], [0, 0]] * 10}}))
    assert cli.main(["calibrate", "--labels", str(tmp_path / "l.json"), "--out", str(tmp_path / "cal.json")], spark) == 0
    assert files.calibration(spark, str(tmp_path / "cal.json")).first()["status"] == "calibrated"


def test_summary_rows_are_made_once(spark, tmp_path, monkeypatch):
    """Results, history, counts and ledger read the rows that one job has written, and these go afterwards."""
    from sieveline.plans import jobs

    read, status = [], jobs.final_status
    monkeypatch.setattr(jobs, "final_status", lambda rows: read.extend(rows.inputFiles()) or status(rows))
    _, result = run_of(spark, sample(tmp_path))
    assert read and all("/summary-" in f for f in read) and not any(os.path.exists(f.removeprefix("file://")) for f in read)
    assert result.reconcile["reconciled"] and result.rows(spark)["final_status"].count() == len(ITEMS)
