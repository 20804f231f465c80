"""Streams that go with runs: live events, cancellation inside a slice, progress of jobs, the admin's summary."""

from __future__ import annotations

import datetime
import time

from tests.test_runs import ITEMS, sample

from sieveline import config
from sieveline.plans import jobs, runner, service
from sieveline.plans import registry as reg
from sieveline.streaming import live, progress


def slow(seconds, folder):
    """An extractor that takes its time, and notes when each item ends."""
    def extract(data, content_type, path):
        time.sleep(seconds)
        with open(f"{folder}/ended", "a") as f:
            f.write(f"{time.time()}\n")
        return (None, [], False) if path.endswith(".png") else (data.decode(), [], True)

    return lambda: extract


def test_events_come_while_a_run_goes_on(spark, tmp_path):
    ctx = runner.build(spark, config.from_mapping(sample(tmp_path)), extract=slow(1.0, str(tmp_path)))
    told = []
    result = runner.run_single(ctx, "t-1", [i for i, *_ in ITEMS], lambda e: told.append((time.time(), e)))
    ended = sorted(float(x) for x in (tmp_path / "ended").read_text().split())
    assert result.reconcile["reconciled"] and told[0][0] < ended[-1], "the first event comes before the last item ends"
    rows = result.rows(spark)["stage_events"].orderBy("source_id", "ordinal").collect()
    key = lambda e: (e["source_id"], e["stage"], e["outcome"], e["exception_code"])
    assert sorted(map(key, rows), key=str) == sorted((key(e) for _, e in told), key=str)
    by = [e["source_id"] for _, e in told]
    assert all(by[by.index(i) : by.index(i) + by.count(i)] == [i] * by.count(i) for i in set(by)), "the events of an item stand together"


def test_service_hands_events_on_as_they_come(spark, tmp_path):
    cfg = config.from_mapping(sample(tmp_path))
    s = service.JobService(spark, cfg, reg.Registry(spark, str(tmp_path / "r")), context=lambda spark, cfg: runner.build(spark, cfg, extract=slow(0.7, str(tmp_path))))
    told = [(time.time(), e["event"]) for e in s.run_interactive(service.Request("single", "t-1", ("note_001", "note_002", "doc_born_001")))]
    ended = sorted(float(x) for x in (tmp_path / "ended").read_text().split())
    assert told[0][0] < ended[-1] and [e for _, e in told] == ["stage"] * 6 + ["item"] * 3 + ["done"]
    broken = service.JobService(spark, cfg, s.registry, context=lambda spark, cfg: runner.build(spark, cfg, extract=lambda: 1 / 0))
    assert [e["event"] for e in broken.run_interactive(service.Request("single", "t-1", ("note_001",)))][-1] in ("error", "done")


def test_counts_by_batch(spark, tmp_path):
    counts, told = [], []
    schema = "source_id string, exception_code string, ocr_used boolean, printable_ratio double, image_coverage double"
    with live.events(spark, str(tmp_path / "items"), spark.createDataFrame([], schema).schema, "decode", told.append, lambda n, bad: counts.append((n, bad))) as query:
        spark.createDataFrame([("a", None, False, 1.0, 0.0), ("b", "unreadable", False, 1.0, 0.0)], schema).write.parquet(str(tmp_path / "items" / "slice-0"))
        query.processAllAvailable()
        for _ in range(100):  # listeners are told a little later
            if counts:
                break
            time.sleep(0.1)
        assert counts == [(2, 1)]
        spark.createDataFrame([("c", None, True, 1.0, 0.0)], schema).write.parquet(str(tmp_path / "items" / "slice-1"))
    assert not query.isActive and [(e["source_id"], e["stage"]) for e in told] == [("a", "extract"), ("a", "ocr_gate"), ("b", "pipeline"), ("c", "extract"), ("c", "ocr_gate")]


def test_cancel_inside_a_slice(spark, tmp_path):
    """One slice holds all; it would take minutes, ends within seconds of the request, and leaves nothing half done."""
    value = sample(tmp_path)
    ctx = runner.build(spark, config.from_mapping(value), extract=slow(60.0, str(tmp_path)))
    begun = time.time()
    stopped = runner.run_batch(ctx, "t-1", batch_size=100, should_cancel=lambda: time.time() - begun > 8)
    assert stopped.status == "cancelled" and stopped.reconcile["input_count"] == 0 and time.time() - begun < 45
    quick = runner.build(spark, config.from_mapping(value))
    done = runner.run_batch(quick, "t-1", batch_size=100, resume=True, should_cancel=lambda: False)
    assert done.status == "completed" and done.run_id == stopped.run_id and done.reconcile["input_count"] == 5 and done.reconcile["reconciled"]


T = lambda minute: datetime.datetime(2024, 1, 1, minute // 60, minute % 60)


def test_progress_counts_each_slice_once(spark, tmp_path):
    before = spark.conf.get(progress.STORE[0])
    spark.conf.set(*progress.STORE)

    def go(*rows):
        spark.createDataFrame(list(rows), progress.COMMIT).write.mode("append").parquet(str(tmp_path / "in"))
        stream = progress.progress(spark.readStream.schema(progress.COMMIT).parquet(str(tmp_path / "in")), 10 * 60_000)
        stream.writeStream.format("parquet").option("path", str(tmp_path / "out")).option("checkpointLocation", str(tmp_path / "c")).trigger(availableNow=True).start().awaitTermination()
        return {(r["job_id"], r["kind"], r["at"], r["slices"], r["items"]) for r in spark.read.parquet(str(tmp_path / "out")).collect()}

    try:
        one = go((1, 0, 5, T(0)), (1, 1, 5, T(1)), (2, 0, 3, T(0)))
        assert one == {(1, "progress", T(1), 2, 10), (2, "progress", T(0), 1, 3)}
        two = go((1, 0, 5, T(2)), (1, 2, 1, T(3)))
        assert two - one == {(1, "progress", T(3), 3, 11)}
        assert go((1, 2, 1, T(3)), (1, 1, 5, T(3)), (1, 0, 5, T(3))) == two, "commits that are handed on again add nothing"
        three = go((3, 0, 1, T(40)))
        assert three - two == {(3, "progress", T(40), 1, 1), (1, "stalled", T(13), 3, 11), (2, "stalled", T(10), 1, 3)}
    finally:
        spark.conf.set(progress.STORE[0], before)


def test_progress_of_many_commits(spark, tmp_path):
    """600,000 commits, most of them repeats, of 1,000 jobs and of one without an id: no call of its own for a commit."""
    before = spark.conf.get(progress.STORE[0])
    spark.conf.set(*progress.STORE)
    commits = spark.range(600_000).selectExpr("if(id % 1001 = 1000, null, id % 1001) AS job_id", "pmod(xxhash64(id), 30) AS slice", "pmod(xxhash64(id), 30) + 1 AS items", "timestamp_seconds(1700000000 + id DIV 10000) AS ts")
    commits.write.parquet(str(tmp_path / "in"))
    begun = time.time()
    try:
        stream = progress.progress(spark.readStream.schema(progress.COMMIT).parquet(str(tmp_path / "in")), 10 * 60_000)
        stream.writeStream.format("parquet").option("path", str(tmp_path / "out")).option("checkpointLocation", str(tmp_path / "c")).trigger(availableNow=True).start().awaitTermination()
    finally:
        spark.conf.set(progress.STORE[0], before)
    assert time.time() - begun < 60
    want = commits.select("job_id", "slice", "items").distinct().groupBy("job_id").agg({"*": "count", "items": "sum"})
    got = spark.read.parquet(str(tmp_path / "out"))
    assert {(r["job_id"], r["kind"], r["slices"], r["items"]) for r in got.collect()} == {(r["job_id"], "progress", r["count(1)"], r["sum(items)"]) for r in want.collect()} and got.count() == 1001


def test_admin_summary_after_each_batch(spark, tmp_path):
    rows = [(j, 10 * n + j, ("queued", "running", "completed", "failed")[(n + j) % 4], n, j, 1, n + j) for n in range(5) for j in range(4)]
    schema = "job_id long, seq long, status string, flagged long, not_flagged long, unable long, progress long"
    for n in range(5):
        spark.createDataFrame(rows[4 * n : 4 * n + 4], schema).write.mode("append").parquet(str(tmp_path / "in"))
        for _ in range(2):  # the second run finds nothing new
            progress.admin_summary(spark.readStream.schema(schema).parquet(str(tmp_path / "in")), 100, str(tmp_path / "out"), str(tmp_path / "c")).awaitTermination()
    got = {r["batch"]: r.asDict() for r in progress.summaries(spark, str(tmp_path / "out")).collect()}
    assert sorted(got) == [0, 1, 2, 3, 4]
    for n in range(5):
        want = jobs.migration_summary(jobs.latest(spark.createDataFrame(rows[: 4 * n + 4], schema)), 100).first().asDict()
        assert got[n] == {**want, "batch": n}
