"""The one entry of command line and services: validates requests, runs them, and records every job in the registry."""

from __future__ import annotations

import dataclasses
import json
import queue
import threading
import uuid
from collections.abc import Callable, Iterator
from dataclasses import dataclass

from pyspark.sql import SparkSession

from ..config import Config
from ..sources import files
from ..sources.shared import new_path
from . import jobs, runner
from .registry import Registry


#: Ids that a retry's request names itself; more are a table.
INLINE = 1000


@dataclass(frozen=True)
class Request:
    """What to process: ids of the manifest, a Parquet table of ids (``ids_at``), or all of it. batch_size and resume are a
    batch's."""

    job_type: str
    config_version: str
    source_ids: tuple[str, ...] | None = None
    batch_size: int = 500
    resume: bool = False
    ids_at: str | None = None

    def ids(self, spark: SparkSession) -> runner.Ids:
        if self.ids_at is not None:
            return spark.read.schema("source_id string").parquet(self.ids_at)
        return None if self.source_ids is None else list(self.source_ids)

    @classmethod
    def of(cls, payload: str) -> Request:
        value = json.loads(payload)["request"]
        return cls(**{**value, "source_ids": None if value["source_ids"] is None else tuple(value["source_ids"])})


class JobService:
    """``context`` builds a run's context from the configuration; tests give one with fakes."""

    def __init__(self, spark: SparkSession, cfg: Config, registry: Registry, context: Callable[..., runner.Context] = runner.build):
        self.spark, self.cfg, self.registry, self._context = spark, cfg, registry, context

    def context(self) -> runner.Context:
        return self._context(self.spark, self.cfg)

    # ---- requests

    def _resolve(self, request: Request) -> tuple[int, str | None]:
        """(number of selected items, error)."""
        if wrong := runner._guard(self.cfg, request.config_version):
            return 0, wrong
        source = files.reader(self.cfg.source.backend)(self.spark, self.cfg.source.root, self.cfg.source.manifest)
        ids = request.ids(self.spark)
        if ids is None:
            return source.entries().count(), None
        try:
            return source.select(ids).count(), None
        except files.UnknownIds as e:
            return 0, str(e)

    def _job(self, request: Request, status: str, job_id: str | None = None) -> dict:
        total, wrong = self._resolve(request)
        return {
            "job_id": job_id or f"job-{uuid.uuid4().hex[:12]}", "job_type": request.job_type, "status": "failed" if wrong else status, "config_version": request.config_version,
            "progress_total": total, "progress_done": 0, "flagged": 0, "not_flagged": 0, "unable": 0, "cancel_requested": False, "run_id": "", "exception": wrong,
            "payload": json.dumps({"request": dataclasses.asdict(request)}),
        }

    @staticmethod
    def apply_result(job: dict, result: runner.Result) -> dict:
        """The job's row after its run: status, identity, counts, error; the payload holds where the results lie."""
        r = result.reconcile
        return {
            **job, "status": result.status, "run_id": result.run_id, "progress_done": r["input_count"], "flagged": r["flagged"], "not_flagged": r["not_flagged"],
            "unable": r["unable_to_process"], "exception": result.exception, "payload": json.dumps({**json.loads(job["payload"]), "result": dataclasses.asdict(result)}),
        }

    # ---- runs

    def submit(self, request: Request) -> dict:
        """Validates and queues; an invalid request is recorded as failed."""
        return self.registry.create(self._job(request, "queued"))

    def execute(self, job: dict) -> dict:
        """Runs a claimed job; progress and cancellation go through the registry."""
        request, job_id = Request.of(job["payload"]), job["job_id"]
        ids = request.ids(self.spark)
        cancelled = lambda: bool((self.registry.get(job_id) or {}).get("cancel_requested"))
        result = runner.run_batch(self.context(), request.config_version, ids, request.batch_size, request.resume, lambda n: self.registry.add_progress(job_id, n), cancelled)
        return self.registry.update(self.apply_result(self.registry.get(job_id) or job, result))

    def run_now(self, request: Request) -> dict:
        """Runs at once and records it; returns the job."""
        job = self.registry.create(self._job(request, "running"))
        if job["status"] == "failed":
            return job
        ids = request.ids(self.spark)
        if request.job_type == "batch":
            result = runner.run_batch(self.context(), request.config_version, ids, request.batch_size, request.resume)
        else:
            result = runner.run_single(self.context(), request.config_version, ids)
        return self.registry.update(self.apply_result(job, result))

    def cancel(self, job_id: str) -> bool:
        return self.registry.request_cancel(job_id)

    def result(self, job: dict | None) -> runner.Result | None:
        """The result of a job that has run."""
        value = json.loads(job["payload"]).get("result") if job else None
        return runner.Result(**value) if value else None

    def retry_failed(self, job_id: str) -> dict | None:
        """Queues the items that a finished job could not process; None where there are none."""
        result = self.result(self.registry.get(job_id))
        if result is None or result.folder is None:
            return None
        ids = jobs.retry(result.rows(self.spark)["final_status"])
        few = sorted(r["source_id"] for r in ids.limit(INLINE + 1).collect())
        if not few:
            return None
        if len(few) <= INLINE:
            return self.submit(Request("batch", result.config_version, tuple(few)))
        path = new_path(self.spark, "retry")  # ids of a large retry stay a table
        ids.write.parquet(path)
        return self.submit(Request("batch", result.config_version, None, ids_at=path))

    def run_interactive(self, request: Request) -> Iterator[dict]:
        """Runs a small selection and yields its stage events as they come, then its rows and its result; a job of the same
        selection and configuration is replaced, so that its id stays."""
        total, wrong = self._resolve(request)
        if wrong or not total:
            yield {"event": "error", "message": wrong or "no source_ids selected"}
            return
        ctx = self.context()
        ids = request.ids(self.spark)
        ids = ctx.source.entries().select("source_id") if ids is None else ids
        job_id = f"single-{runner._identity(ctx, runner._selected(ctx, ids))}"
        job = self.registry.upsert({**self._job(request, "running", job_id), "progress_total": total})
        told: queue.Queue = queue.Queue()
        held: dict = {}

        def work() -> None:
            try:
                held["result"] = runner.run_single(ctx, request.config_version, ids, told.put)
            except Exception as e:
                held["error"] = str(e)[:500]
            finally:
                told.put(None)  # the end, whatever happened

        threading.Thread(target=work, daemon=True).start()
        while (event := told.get()) is not None:
            yield {"event": "stage", **event}
        if "error" in held:
            self.registry.update({**job, "status": "failed", "exception": held["error"]})
            yield {"event": "error", "message": held["error"]}
            return
        result = held["result"]
        for r in result.rows(self.spark)["item_summary"].orderBy("source_id").toLocalIterator():
            yield {"event": "item", "row": r.asDict()}
        self.registry.update(self.apply_result(job, result))
        yield {"event": "done", "result": dataclasses.asdict(result)}


def frame(event: dict) -> str:
    """An event as a server-sent frame."""
    return f"data: {json.dumps(event)}\n\n"


class Worker(threading.Thread):
    """Drains the queue. An error marks its job as failed and the worker goes on."""

    def __init__(self, service: JobService, poll_seconds: float = 0.25):
        super().__init__(daemon=True)
        self.service, self.poll, self._over = service, poll_seconds, threading.Event()

    def step(self) -> bool:
        """One job, if there is one."""
        job = self.service.registry.claim_next()
        if job is None:
            return False
        try:
            self.service.execute(job)
        except Exception:
            self.service.registry.update({**(self.service.registry.get(job["job_id"]) or job), "status": "failed", "exception": "worker execution error"})
        return True

    def run(self) -> None:
        while not self._over.is_set():
            try:
                worked = self.step()
            except Exception:  # a reading that failed must not end the worker
                worked = False
            if not worked:
                self._over.wait(self.poll)

    def stop(self) -> None:
        self._over.set()
