"""Ingestion of a growing corpus: what is new since the last run is analysed once and appended; a second run adds nothing.

The checkpoint holds which files were read; each micro-batch is written with its number, so that a batch that is repeated
after a failure replaces its own rows.
"""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from ..operators import items as ops
from ..plans.profile import RULES
from ..schema import EVENT
from ..sources.shared import is_folder, new_path

RESULT = "source_id string, n_findings long, categories string"


def analyse(docs: DataFrame) -> DataFrame:
    """Pattern rules over documents: one row each, without text."""
    rows = docs.select(F.format_string("doc_%06d", F.col("doc_id")).alias("source_id"), ops.rule_findings(RULES).alias("f"))
    categories = F.array_join(F.sort_array(F.array_distinct(F.transform("f", lambda x: x["category"]))), ",")
    return rows.select("source_id", F.size("f").cast("long").alias("n_findings"), categories.alias("categories"))


def start(spark: SparkSession, source: str, schema, out: str, checkpoint: str, files_per_trigger: int = 64, available_now: bool = True):
    """A query over Parquet files that arrive in ``source``; results go to ``out/batch=<n>``."""
    reader = spark.readStream.schema(schema).option("maxFilesPerTrigger", files_per_trigger)
    if not is_folder(spark, source):  # a stream reads folders; a single file is picked by its name
        source, _, name = source.rpartition("/")
        reader = reader.option("pathGlobFilter", name)
    stream = reader.parquet(source)

    def write(batch: DataFrame, number: int) -> None:
        batch.write.mode("overwrite").parquet(f"{out}/batch={number}")

    writer = analyse(stream).writeStream.foreachBatch(write).option("checkpointLocation", checkpoint)
    return (writer.trigger(availableNow=True) if available_now else writer.trigger(processingTime="250 milliseconds")).start()


def frames(events: DataFrame) -> DataFrame:
    """Event frames of a live view, content-free: a column ``frame`` with the row as JSON after ``data: `` and an empty line."""
    shown = F.struct(F.lit("stage").alias("event"), "source_id", "stage", "outcome", "exception_code")
    return events.select(F.concat(F.lit("data: "), F.to_json(shown, {"ignoreNullFields": "false"}), F.lit("\n\n")).alias("frame"))


def live_events(spark: SparkSession, source: str, out: str, checkpoint: str):
    """Stage events of a run as a stream of frames: rows appended under ``source`` are handed on batch by batch."""
    stream = spark.readStream.schema(f"ordinal long, {EVENT}").json(source)
    return frames(stream).writeStream.format("text").option("path", out).option("checkpointLocation", checkpoint).trigger(availableNow=True).start()


def run_available_now(spark: SparkSession, source: str, runs: int = 2) -> DataFrame:
    """Runs the stream to its end, ``runs`` times over one checkpoint, and reads what was written: a row a document."""
    base = new_path(spark, "stream")
    schema = spark.read.parquet(source).schema
    for _ in range(runs):
        start(spark, source, schema, f"{base}/out", f"{base}/checkpoint").awaitTermination()
    return spark.read.schema(RESULT).parquet(f"{base}/out").select("source_id", "n_findings", "categories")
