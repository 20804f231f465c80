"""The job registry: a log of events, one small file a version, folded to a row a job.

A version's file is created exclusively, so a writer whose reading is out of date fails and reads again: claims, progress
and cancellations of several drivers never overwrite one another. Progress and cancellation are events of their own, which
add up whatever their order. Rows hold metadata only, never contents.
"""

from __future__ import annotations

import json
import time
from datetime import UTC, datetime

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from ..schema import JOB_EVENT, JOB_STATE, JOB_STATUS, struct
from ..sources.shared import names, write_new
from . import jobs

STATE = tuple(column.split()[0] for column in JOB_STATE.split(", "))

#: Versions after which the folded state is written, so that a reading starts there.
EVERY = 100


def fold(events: DataFrame) -> DataFrame:
    """Events (schema.JOB_EVENT) -> a row a job: the last row that was put, with the progress added since, cancelled if
    asked for since, and in the last status that a claim gave it. created_at is that of the first event."""
    put = F.col("kind") == "put"
    base = events.groupBy("job_id").agg(
        F.max(F.when(put, F.col("seq"))).alias("_base"), F.max_by(F.when(put, F.struct(*STATE)), F.when(put, F.col("seq"))).alias("s"),
        F.min_by("created_at", F.when(put, F.col("seq"))).alias("created_at"), F.max_by("ts", "seq").alias("updated_at"),
    )
    since = events.join(base.select("job_id", "_base"), "job_id").where(F.col("seq") > F.col("_base")).groupBy("job_id").agg(
        F.sum(F.when(F.col("kind") == "progress", F.col("delta"))).alias("_done"), F.bool_or(F.col("kind") == "cancel").alias("_cancel"),
        F.max_by(F.when(F.col("kind") == "claim", F.col("status")), F.when(F.col("kind") == "claim", F.col("seq"))).alias("_status"),
    )
    rows = base.where("_base is not null").join(since, "job_id", "left")
    own = {c: F.col(f"s.{c}") for c in STATE}
    own["status"] = F.coalesce("_status", own["status"])
    own["progress_done"] = F.coalesce(own["progress_done"], F.lit(0)) + F.coalesce("_done", F.lit(0))
    own["cancel_requested"] = F.coalesce(own["cancel_requested"], F.lit(False)) | F.coalesce("_cancel", F.lit(False))
    return rows.select("job_id", "created_at", "updated_at", *[v.alias(k) for k, v in own.items()])


class Exists(ValueError):
    """A job of this id is registered already."""


class Registry:
    """Writes go through one compare-and-set; reads are DataFrames. ``clock`` gives ISO times."""

    def __init__(self, spark: SparkSession, root: str, clock=lambda: datetime.now(UTC).isoformat()):
        self.spark, self.root, self.clock = spark, root.rstrip("/"), clock

    # ---- the log

    def _versions(self) -> tuple[int, int]:
        """(last version, version of the last folded state; 0: none)."""
        log, folded = names(self.spark, f"{self.root}/log"), [n for n in names(self.spark, f"{self.root}/folded") if n.endswith(".json")]
        last = max((int(n[:-5]) for n in log if n.endswith(".json") and not n.startswith(".")), default=0)
        return last, max((int(n[:-5]) for n in folded), default=0)

    def _events(self, last: int, folded: int) -> DataFrame:
        kind = struct(JOB_EVENT)
        files = [f"{self.root}/log/{k:020d}.json" for k in range(folded + 1, last + 1)]
        if folded:
            files.append(f"{self.root}/folded/{folded:020d}.json")
        return self.spark.read.schema(kind).json(files) if files else self.spark.createDataFrame([], kind)

    def events(self) -> DataFrame:
        return self._events(*self._versions())

    def state(self) -> DataFrame:
        """A row a job."""
        return fold(self.events())

    def _commit(self, change) -> dict | None:
        """``change(state) -> event or None``, applied to the newest state and written as the next version."""
        while True:
            last, folded = self._versions()
            events = self._events(last, folded)
            if last and events.agg(F.max("seq")).first()[0] != last:  # a version that is just being written
                time.sleep(0.05)
                continue
            event = change(fold(events))
            if event is None:
                return None
            event = {"seq": last + 1, "ts": self.clock(), **event}
            if write_new(self.spark, f"{self.root}/log/{last + 1:020d}.json", json.dumps(event) + "\n"):
                if (last + 1) % EVERY == 0:
                    self.compact()
                return event

    def compact(self) -> None:
        """Writes the folded state of the newest version; whoever writes it writes the same."""
        last, folded = self._versions()
        if last > folded:
            state = fold(self._events(last, folded))
            at = state.select(F.lit(last).cast("long").alias("seq"), "job_id", F.lit("put").alias("kind"), F.col("updated_at").alias("ts"), "created_at", F.lit(None).cast("long").alias("delta"), *STATE)
            write_new(self.spark, f"{self.root}/folded/{last:020d}.json", "".join(line + "\n" for line in at.orderBy("job_id").toJSON().toLocalIterator()))

    # ---- writes

    def _put(self, job: dict) -> dict:
        if job["status"] not in JOB_STATUS:
            raise ValueError(f"unknown job status {job['status']!r}")
        return {"kind": "put", "job_id": job["job_id"], "created_at": job.get("created_at") or self.clock(), **{c: job.get(c) for c in STATE}}

    def create(self, job: dict) -> dict:
        def change(state: DataFrame) -> dict:
            if state.where(F.col("job_id") == job["job_id"]).limit(1).count():
                raise Exists(job["job_id"])
            return self._put(job)

        self._commit(change)
        return self.get(job["job_id"])

    def upsert(self, job: dict) -> dict:
        """Inserts the job or replaces all but its created_at."""
        self._commit(lambda state: self._put(job))
        return self.get(job["job_id"])

    def update(self, job: dict) -> dict | None:
        """Replaces a job's columns; a job that is not registered is left alone."""
        self._commit(lambda state: self._put(job) if state.where(F.col("job_id") == job["job_id"]).limit(1).count() else None)
        return self.get(job["job_id"])

    def claim_next(self) -> dict | None:
        """Moves the oldest queued job to running and returns it; of several workers one gets it."""
        def change(state: DataFrame) -> dict | None:
            head = jobs.queue_head(state).first()
            return {"kind": "claim", "job_id": head["job_id"], "status": "running"} if head else None

        event = self._commit(change)
        return self.get(event["job_id"]) if event else None

    def request_cancel(self, job_id: str) -> bool:
        """Only queued and running jobs can be cancelled."""
        on = F.col("status").isin("queued", "running") & (F.col("job_id") == job_id)
        return self._commit(lambda state: {"kind": "cancel", "job_id": job_id} if state.where(on).limit(1).count() else None) is not None

    def add_progress(self, job_id: str, delta: int = 1) -> None:
        self._commit(lambda state: {"kind": "progress", "job_id": job_id, "delta": delta} if state.where(F.col("job_id") == job_id).limit(1).count() else None)

    # ---- reads

    def get(self, job_id: str) -> dict | None:
        row = self.state().where(F.col("job_id") == job_id).first()
        return row.asDict() if row else None

    def newest(self, limit: int = 100, status: str | None = None) -> DataFrame:
        return jobs.newest(self.state(), limit, status)

    def migration_summary(self, authorised: int) -> DataFrame:
        return jobs.migration_summary(self.state().withColumnRenamed("progress_done", "progress"), authorised)

    def by_status(self) -> DataFrame:
        return jobs.jobs_by_status(self.state())
