"""Runs over a manifest: identity of a run, reconciliation, resume, retry; and the job registry as relations."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from ..functions import text
from ..schema import ACTIVE, TERMINAL


def run_id(manifest: DataFrame, config_version: str, seed: int) -> DataFrame:
    """One row, run_id: a digest of the ordered (id, hash) pairs, the configuration's version and the seed, 12 digits.

    The definition folds the whole ordered list, so the list meets in one row: fine for manifests of tens of millions.
    For larger ones use :func:`large_run_id`."""
    pairs = F.array_sort(F.collect_list(F.struct("source_id", "content_hash")))
    joined = F.array_join(F.transform(pairs, lambda p: F.concat(p["source_id"], p["content_hash"])), "")
    whole = F.concat(joined, F.lit(config_version), F.lit(str(seed)))
    return manifest.agg(F.substring(F.sha2(whole.cast("binary"), 256), 1, 12).alias("run_id"))


def large_run_id(manifest: DataFrame, config_version: str, seed: int, parts: int = 4096) -> DataFrame:
    """As :func:`run_id`, but a digest of digests by parts of the ids, which are sorted by many tasks (another value)."""
    part = F.pmod(F.xxhash64("source_id"), F.lit(parts))
    pairs = F.array_sort(F.collect_list(F.struct("source_id", "content_hash")))
    folded = F.sha2(F.array_join(F.transform(pairs, lambda p: F.concat(p["source_id"], p["content_hash"])), "").cast("binary"), 256)
    return run_id(manifest.groupBy(part.alias("source_id")).agg(folded.alias("content_hash")).withColumn("source_id", F.lpad(F.col("source_id").cast("string"), 8, "0")), config_version, seed)


def reconcile(rows: DataFrame, expected: DataFrame | None = None) -> DataFrame:
    """Counts by status, whether each input has one row, and whether all are accounted for. ``expected``: the selection of
    a full run; None: a batch counts what was processed."""
    one = rows.groupBy("source_id").agg(F.count("*").alias("n"), F.first("flag_status").alias("flag_status"))
    is_ = lambda s: F.count_if(F.col("flag_status") == s)
    sums = one.agg(
        is_("flagged").alias("flagged"), is_("not_flagged").alias("not_flagged"), is_("unable_to_process").alias("unable_to_process"),
        F.coalesce(F.max("n") <= 1, F.lit(True)).alias("_single"), F.count("*").alias("_ids"),
    )
    if expected is None:
        out = sums.withColumn("input_count", F.col("_ids"))
    else:
        out = sums.join(F.broadcast(expected.agg(F.count("*").alias("input_count"))))  # one row each
    total = F.col("flagged") + F.col("not_flagged") + F.col("unable_to_process")
    return out.select(
        "input_count", "flagged", "not_flagged", "unable_to_process", (F.col("_single") & (F.col("_ids") == F.col("input_count"))).alias("one_row_per_input"),
        (total == F.col("input_count")).alias("reconciled"),
    )


def final_status(rows: DataFrame) -> DataFrame:
    """Statuses by id; a sink puts them in order."""
    return rows.select("source_id", "flag_status")


def unknown_ids(ids: DataFrame, manifest: DataFrame) -> DataFrame:
    return ids.join(manifest, "source_id", "left_anti").select("source_id").distinct()


def done(earlier: DataFrame, selection: DataFrame) -> DataFrame:
    """Rows of an earlier run that are part of the selection."""
    return earlier.join(selection.select("source_id"), "source_id", "left_semi")


def remaining(selection: DataFrame, earlier: DataFrame) -> DataFrame:
    return selection.join(earlier.select("source_id"), "source_id", "left_anti")


def merge(resumed: DataFrame, fresh: DataFrame) -> DataFrame:
    return resumed.unionByName(fresh, allowMissingColumns=True)


def retry(rows: DataFrame) -> DataFrame:
    return rows.where("flag_status = 'unable_to_process'").select("source_id")


def merge_ledgers(resumed: tuple[DataFrame, DataFrame], fresh: tuple[DataFrame, DataFrame]) -> tuple[DataFrame, DataFrame]:
    """(events, final statuses) of two ledgers as one: all events, and of an id's statuses the later ledger's."""
    events = resumed[0].unionByName(fresh[0], allowMissingColumns=True)
    kept = resumed[1].join(fresh[1].select("source_id"), "source_id", "left_anti")
    return events, kept.unionByName(fresh[1])


def shown_findings(findings: Column) -> Column:
    """An item's findings as a workbook shows them, in the order of their ids; they are in the row, so nothing is joined."""
    shown = F.transform(findings, lambda f: F.struct(f["finding_id"].alias("finding_id"), f["category"].alias("category"), f["score_type"].alias("score_type"), (f["score_type"] == "similarity").alias("routing_only"), text.evidence(f["location"]).alias("evidence")))
    return F.sort_array(shown)


def page(rows: DataFrame, offset: int = 0, size: int = 100, order: str = "source_id") -> DataFrame:
    return rows.orderBy(order).offset(offset).limit(size)


def next_offset(offset: int, size: int, total: int) -> int | None:
    """Where the next page starts; None after the last one."""
    return offset + size if offset + size < total else None


# ---- registry -------------------------------------------------------------------------------------------------------


def latest(job_events: DataFrame, key: str = "job_id", order: tuple[str, ...] = ("seq",)) -> DataFrame:
    """The state of each job: the last of its events. max_by keeps one row a key before the shuffle."""
    others = [c for c in job_events.columns if c != key]
    last = F.max_by(F.struct(*others), F.struct(*order))
    return job_events.groupBy(key).agg(last.alias("s")).select(key, "s.*")


def migration_summary(jobs: DataFrame, authorised: int) -> DataFrame:
    """Totals over finished jobs, progress of active ones, and shares of the authorised items (at most 100 %)."""
    over, on = F.col("status").isin(*TERMINAL), F.col("status").isin(*ACTIVE)
    add = lambda c, when: F.coalesce(F.sum(F.when(when, F.col(c))), F.lit(0)).cast("long")
    sums = jobs.agg(
        add("flagged", over).alias("flagged"), add("not_flagged", over).alias("not_flagged"), add("unable", over).alias("unable"),
        add("progress", on).alias("in_progress"), F.count("*").alias("jobs_total"),
    )
    processed = F.col("flagged") + F.col("not_flagged") + F.col("unable")
    pct = F.least(F.lit(100.0), F.bround(processed * 100.0 / F.lit(float(max(authorised, 1))), 1)) if authorised else F.lit(0.0)
    return sums.select(
        F.lit(authorised).cast("long").alias("authorised"), processed.alias("processed"), "flagged", "not_flagged", "unable", "in_progress",
        F.greatest(F.lit(0), F.lit(authorised) - processed - F.col("in_progress")).cast("long").alias("remaining"), pct.alias("percent"), "jobs_total",
    )


def jobs_by_status(jobs: DataFrame) -> DataFrame:
    return jobs.groupBy("status").agg(F.count("*").alias("jobs"))


def queue_head(jobs: DataFrame) -> DataFrame:
    return jobs.where("status = 'queued'").orderBy("created_at", "job_id").limit(1)


def newest(jobs: DataFrame, limit: int = 100, status: str | None = None) -> DataFrame:
    chosen = jobs.where(F.col("status") == status) if status else jobs
    return chosen.orderBy(F.col("created_at").desc(), F.col("job_id")).limit(limit)


def numbered(rows: DataFrame, key: str, order: str) -> DataFrame:
    """Ordinals from 0 within a key, for relations that are rows already."""
    return rows.withColumn("ordinal", F.row_number().over(Window.partitionBy(key).orderBy(order)) - 1)
