"""Scans: manifest, contents, OCR side texts, labels, calibration artefacts, earlier runs. Nothing here writes."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from ..schema import CALIBRATION, EVENT, FINDING_COLUMNS, LABELS, MANIFEST, struct
from . import items
from .shared import exists


def manifest(spark: SparkSession, path: str) -> DataFrame:
    """A JSON array of entries, of which the last counts where several have one id; one task reads it. Large manifests come
    as Parquet (``.parquet``) or JSON lines (``.jsonl``), which many tasks read; there ids are unique."""
    kind = path.rstrip("/").rpartition(".")[2]
    if kind in ("parquet", "jsonl"):
        given = spark.read.schema(struct(MANIFEST))
        return given.parquet(path) if kind == "parquet" else given.json(path)
    rows = spark.read.schema(struct(MANIFEST)).option("multiLine", True).json(path)
    ranked = rows.withColumn("_at", F.monotonically_increasing_id())
    last = Window.partitionBy("source_id").orderBy(F.col("_at").desc())
    return ranked.withColumn("_n", F.row_number().over(last)).where("_n = 1").drop("_at", "_n")


def labels(spark: SparkSession, path: str) -> DataFrame:
    """``category -> {dev, holdout} -> [[score, label]]`` as rows."""
    shape = "map<string,map<string,array<array<double>>>>"
    text = spark.read.text(path, wholetext=True).select(F.from_json("value", shape).alias("m"))
    splits = text.select(F.explode("m").alias("category", "splits")).select("category", F.explode("splits").alias("split", "pairs"))
    pairs = splits.select("category", "split", F.explode("pairs").alias("p"))
    return pairs.select("category", "split", F.get("p", F.lit(0)).alias("score"), F.get("p", F.lit(1)).cast("int").alias("label")).to(struct(LABELS))


def calibration(spark: SparkSession, path: str) -> DataFrame:
    """An artefact ``{version, categories: {category: {...}}}``; the method defaults to identity, knots to none."""
    shape = "version string, categories map<string,struct<status:string,method:string,a:double,b:double,x:array<double>,y:array<double>>>"
    rows = spark.read.text(path, wholetext=True).select(F.from_json("value", shape).alias("j")).select(F.explode("j.categories").alias("category", "c"))
    none = F.array().cast("array<double>")
    return rows.select(
        "category", F.col("c.status").alias("status"), F.coalesce("c.method", F.lit("identity")).alias("method"),
        F.coalesce("c.a", F.lit(0.0)).alias("a"), F.coalesce("c.b", F.lit(0.0)).alias("b"), F.coalesce("c.x", none).alias("x"), F.coalesce("c.y", none).alias("y"),
    ).to(struct(CALIBRATION))


SUMMARY = (
    "source_id string, snapshot_id string, content_type string, flag_status string, sensitivity_categories array<string>, reason_summary string, "
    "processing_status string, calibration_status string, content_hash string, run_id string, config_version string, author string, datetime string, "
    "linked_executive string, linked_project string, strongest_band string, strongest_score_type string, strongest_score double, exception_code string, n_findings long"
)
FINDINGS_ROW = f"source_id string, {FINDING_COLUMNS}"
STATUS = "source_id string, flag_status string"


def earlier(spark: SparkSession, path: str, ddl: str) -> DataFrame:
    """The rows of an earlier run, or none where there was no run."""
    if not exists(spark, path):
        return spark.createDataFrame([], struct(ddl))
    return spark.read.schema(struct(ddl)).json(path)


def results(spark: SparkSession, folder: str) -> dict[str, DataFrame]:
    """What a run wrote as JSON lines: item_summary, findings, stage_events, final_status. Missing parts are empty."""
    parts = {"item_summary": SUMMARY, "findings": FINDINGS_ROW, "ledger/stage_events": f"ordinal long, {EVENT}", "ledger/final_status": STATUS}
    return {name.rpartition("/")[2]: earlier(spark, f"{folder}/{name}", ddl) for name, ddl in parts.items()}


def kept(spark: SparkSession, table: str, run_id: str | None = None) -> DataFrame:
    """The rows that :func:`sinks.keep` put into a table, of all runs or of one, whose partition alone is then listed."""
    found = spark.read.parquet(table).drop("run_id").schema  # a run's name may look like a number, whose zeros would be lost
    rows = spark.read.schema(struct(f"{', '.join(f'`{f.name}` {f.dataType.simpleString()}' for f in found)}, run_id string")).parquet(table)
    return rows if run_id is None else rows.where(F.col("run_id") == run_id)


#: Unknown ids that an error names at most.
SHOWN = 20


class UnknownIds(LookupError):
    """Ids of a request that the manifest does not hold."""


class FolderSource:
    """The read-only port of a source: list, and read by id, whole or in pieces. It has no method that writes."""

    opener = items.ItemSource

    def __init__(self, spark: SparkSession, root: str, manifest_path: str):
        self.spark, self.root, self.manifest_path = spark, root, manifest_path

    def entries(self) -> DataFrame:
        return manifest(self.spark, self.manifest_path)

    def select(self, ids: list[str] | DataFrame) -> DataFrame:
        """Entries of the ids, a list (whose order is ``ordinal``, repeats kept) or a table (source_id; each counts once, the
        ordinal is null); an unknown id is an error, which names some of them."""
        if isinstance(ids, DataFrame):
            asked = ids.select(F.lit(None).cast("long").alias("ordinal"), F.col("source_id")).distinct()
        else:
            asked = self.spark.createDataFrame(list(enumerate(ids)), "ordinal long, source_id string")
        found = asked.join(self.entries(), "source_id", "left")
        if missing := sorted({r["source_id"] for r in found.where("path is null").select("source_id").limit(SHOWN).collect()}):
            raise UnknownIds(f"not in the manifest: {missing}")
        return found

    def read(self, entries: DataFrame, side: bool = True) -> DataFrame:
        """Entries with content (null where there is none) and, with ``side``, the text that lies beside the file. Only the
        entries' files are opened; contents are neither joined nor shuffled."""
        return items.load(self.spark, entries, self.root, side, source=self.opener)

    def pieces(self, entries: DataFrame, chunk: int = items.CHUNK) -> DataFrame:
        """(source_id, ordinal, at, chunk): contents in pieces of ``chunk`` bytes, for items that are too large for a row.
        Entries without a file have none, empty files neither."""
        return items.load(self.spark, entries, self.root, pieces=True, chunk=chunk, source=self.opener)


READERS = {"sample": FolderSource}


def reader(backend: str):
    if backend not in READERS:
        raise ValueError(f"unknown source backend {backend!r}")
    return READERS[backend]
