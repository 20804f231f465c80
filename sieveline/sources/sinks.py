"""Sinks: results as JSON lines (nulls kept) or Parquet, one folder a run."""

from __future__ import annotations

import json
from collections.abc import Iterator

import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

FORMATS = ("jsonl", "parquet")


def write(df: DataFrame, path: str, form: str = "jsonl", order: tuple[str, ...] = ("source_id",)) -> None:
    """Overwrites a folder with rows in order. A column named text may not be written: texts are never persisted."""
    if form not in FORMATS:
        raise ValueError(f"unsupported output format {form!r}")
    if {"text", "content", "ocr_text"} & set(df.columns):
        raise ValueError("results hold no texts")
    out = df.sort(*order).write.mode("overwrite")
    out.option("ignoreNullFields", False).json(path) if form == "jsonl" else out.parquet(path)


def run_folder(result_dir: str, job_type: str, run_id: str) -> str:
    return f"{result_dir.rstrip('/')}/{job_type}-{run_id}"


def keep(df: DataFrame, table: str, run_id: str) -> None:
    """Puts a run's rows into a table that holds all runs, as the partition ``run_id``. A repeat of the run replaces its own
    partition alone; partitions of other runs are neither read nor written."""
    if {"text", "content", "ocr_text"} & set(df.columns):
        raise ValueError("results hold no texts")
    rows = df.drop("run_id").withColumn("run_id", F.lit(run_id))
    rows.write.mode("overwrite").option("partitionOverwriteMode", "dynamic").partitionBy("run_id").parquet(table)


def write_ledger(run_id: str, config_version: str, engines: dict[str, str], reconcile: DataFrame, events: DataFrame, statuses: DataFrame, path: str) -> None:
    """The run's ledger as relations: ``run`` (one row: identity, engines, counts), ``stage_events`` and ``final_status`` in
    the order of ids. No row gathers a run."""
    named = F.from_json(F.lit(json.dumps(engines, sort_keys=True)), "map<string,string>")
    head = reconcile.select(F.lit(run_id).alias("run_id"), F.lit(config_version).alias("config_version"), named.alias("engines"), F.struct("*").alias("reconcile"))
    write(head, f"{path}/run", order=("run_id",))
    write(events, f"{path}/stage_events", order=("source_id", "ordinal"))
    write(statuses, f"{path}/final_status")


def write_items(rows: DataFrame, root: str) -> int:
    """Writes a folder of items from (path, content, ocr_text): a file a row, and beside it the side text. Null contents and
    side texts give no file. Tasks write, so a file that is written again is replaced; answers with the number of rows."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        from pyarrow import fs as files

        from .items import SIDE

        fs, base = files.FileSystem.from_uri(root)
        made = set()
        for batch in batches:
            for path, content, side in zip(*(batch.column(c).to_pylist() for c in range(3)), strict=True):
                at = f"{base.rstrip('/')}/{path}"
                folder = at.rpartition("/")[0]
                if folder not in made:
                    fs.create_dir(folder, recursive=True)
                    made.add(folder)
                for name, data in ((at, content), (at + SIDE, None if side is None else side.encode())):
                    if data is not None:
                        with fs.open_output_stream(name) as stream:
                            stream.write(data)
            yield pa.RecordBatch.from_arrays([pa.array([batch.num_rows], pa.int64())], names=["n"])

    return rows.select("path", F.col("content").cast("binary"), "ocr_text").mapInArrow(run, "n long").agg(F.coalesce(F.sum("n"), F.lit(0))).first()[0]
