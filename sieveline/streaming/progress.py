"""Progress of jobs from their commits, and the admin's summary, as stateful streams.

Commits (a job's slice, and how many items it has done) come as rows of a stream. A slice counts once however often its
commit is handed on: state holds the slices of each job that have counted, so that replayed batches add nothing. A job that
is silent for longer than a limit of event time is reported as stalled, by a timer that each new commit sets anew.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pandas as pd
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql.streaming.state import GroupState, GroupStateTimeout

from ..plans import jobs
from ..sources.shared import names

COMMIT = "job_id long, slice long, items long, ts timestamp"
PROGRESS = "job_id long, kind string, at timestamp, slices long, items long"

#: State is kept in RocksDB, which holds more jobs than memory does.
STORE = ("spark.sql.streaming.stateStore.providerClass", "org.apache.spark.sql.execution.streaming.state.RocksDBStateStoreProvider")


#: Groups to which jobs are dealt by a hash of their id. As the number of state partitions, it stays while a checkpoint does.
GROUPS = 512

#: State of a group, arrays of numbers as bytes: its jobs in order, each with its items, its newest commit and whether its
#: silence has been told; and the slices that have counted, in order of (job, slice).
STATE = "jobs binary, items binary, last binary, told binary, of binary, slices binary"


def _progress(limit_ms: int):
    """Rows of PROGRESS: ``progress`` with a job's totals after a batch that added to them, ``stalled`` at the time when
    a job has been silent for ``limit_ms``. All jobs of a group are looked at at once, so that a commit costs no call."""

    def run(key, batches: Iterator[pd.DataFrame], state: GroupState) -> Iterator[pd.DataFrame]:
        none = np.empty(0, np.int64)
        jobs_, items, last, told, of, slices = (np.frombuffer(x, np.int64) for x in state.get) if state.exists else (none,) * 6
        grew = none
        if not state.hasTimedOut:
            job, slice_, n, ms = (np.concatenate(x) for x in zip(*map(_numbers, batches), strict=True))
            every_of, every_slice = np.r_[of, job], np.r_[slices, slice_]
            order = np.lexsort((every_slice, every_of))  # stable: of equals, the one that has counted is first
            first = order[np.r_[True, (np.diff(every_of[order]) != 0) | (np.diff(every_slice[order]) != 0)]]
            fresh = first[first >= len(of)] - len(of)
            of, slices = every_of[first], every_slice[first]
            known, jobs_ = jobs_, np.union1d(jobs_, job)
            at = np.searchsorted(jobs_, known)
            before, more, newest, heard = last, np.zeros(len(jobs_), np.int64), np.full(len(jobs_), np.iinfo(np.int64).min), np.zeros(len(jobs_), np.int64)
            more[at], newest[at], heard[at] = items, before, told
            np.add.at(more, np.searchsorted(jobs_, job[fresh]), n[fresh])
            np.maximum.at(newest, np.searchsorted(jobs_, job), ms)
            heard[at[newest[at] > before]] = 0
            items, last, told, grew = more, newest, heard, np.searchsorted(jobs_, np.unique(job[fresh]))
        due = np.flatnonzero((told == 0) & (last + limit_ms <= state.getCurrentWatermarkMs()))
        told = told.copy()
        told[due] = 1
        state.update(tuple(x.tobytes() for x in (jobs_, items, last, told, of, slices)))
        if len(silent := last[told == 0]):
            # a time-out comes when the watermark has passed its time, a stall when the watermark has reached it
            state.setTimeoutTimestamp(int(silent.min()) + limit_ms - 1)
        counts = np.searchsorted(of, jobs_, side="right") - np.searchsorted(of, jobs_)
        for kind, which, after in (("progress", grew, 0), ("stalled", due, limit_ms)):
            if len(which):
                at_ms = (last[which] + after).astype("datetime64[ms]").astype("datetime64[ns]")
                ids = pd.Series(jobs_[which], dtype="Int64").mask(np.full(len(which), bool(key[1])))
                yield pd.DataFrame({"job_id": ids, "kind": kind, "at": at_ms, "slices": counts[which], "items": items[which]})

    return run


def _numbers(batch: pd.DataFrame) -> tuple:
    """(job, slice, items, milliseconds)."""
    return (*[batch[c].to_numpy(np.int64) for c in ("job", "slice", "items")], batch["ts"].to_numpy("datetime64[ms]").astype(np.int64))


def progress(commits: DataFrame, limit_ms: int, late: str = "0 seconds", groups: int = GROUPS) -> DataFrame:
    """A stream of COMMIT rows -> a stream of PROGRESS rows. ``late``: how far the watermark stays behind the newest commit.
    A null id is a job of its own."""
    job = F.col("job_id")
    rows = commits.withWatermark("ts", late).select(F.pmod(F.xxhash64(job), F.lit(groups)).alias("g"), job.isNull().alias("none"), F.coalesce(job, F.lit(0)).alias("job"), "slice", "items", "ts")
    return rows.groupBy("g", "none").applyInPandasWithState(_progress(limit_ms), PROGRESS, STATE, "append", GroupStateTimeout.EventTimeTimeout)


def admin_summary(events: DataFrame, authorised: int, out: str, checkpoint: str):
    """A stream of job events (job_id, seq and a job's columns) -> after each batch the summary of all jobs in their latest
    state, at ``out/batch=<n>``; a batch that is repeated replaces its own. One run to the end of what has come."""
    def write(state: DataFrame, number: int) -> None:
        jobs.migration_summary(state, authorised).write.mode("overwrite").parquet(f"{out}/batch={number}")

    stream = jobs.latest(events).writeStream.outputMode("complete").foreachBatch(write)
    return stream.option("checkpointLocation", checkpoint).trigger(availableNow=True).start()


def summaries(spark: SparkSession, out: str) -> DataFrame:
    """What :func:`admin_summary` wrote, with the number of the batch."""
    return spark.read.option("basePath", out).parquet(*[f"{out}/{n}" for n in names(spark, out) if n.startswith("batch=")]).withColumn("batch", F.col("batch").cast("long"))
