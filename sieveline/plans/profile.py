"""The bench profile: the corpus tables mapped onto the manifest, with every error branch in it."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from ..config import Config, Detect, Inference, OcrGate, Recogniser, Scoring, Source, Taxonomy
from ..functions.text import once
from ..operators import items as ops

RULES = (
    Recogniser("CARD-001", "financial", r"\b\d{16}\b", "financial_ref"),
    Recogniser("MAIL-001", "contact", r"[A-Za-z0-9._%+-]+@[A-Za-z0-9.-]+\.[A-Za-z]{2,}", "contact_ref", literal="@"),
    Recogniser("TEL-001", "contact", r"\+1 \(\d{3}\) \d{3}-\d{4}", "contact_ref", literal="+1 ("),
    Recogniser("IP-001", "network", r"\b\d{1,3}\.\d{1,3}\.\d{1,3}\.\d{1,3}\b", "network_ref"),
    Recogniser("TOK-001", "credential", r'token = "[0-9a-f]{40}"', "credential_ref", literal='token = "'),
    Recogniser("LIC-001", "licence", r"[Ll]icensed? under", "licence_ref", literal="icense"),
)
TAXONOMY = Taxonomy("bench-0", ("contact", "credential", "financial", "licence", "network"))
HINTS = {"financial": "thanedble", "contact": "ention", "credential": "worthless"}
INFERENCE = Inference(mock_hints=HINTS)
SCORING = Scoring()
CONFIG_VERSION, SEED = "bench-0", 42

#: The same as a configuration, whose manifest is the documents table.
CONFIG = Config(
    source=Source("sample", "documents", "documents.parquet"), config_version=CONFIG_VERSION, seed=SEED, inference=INFERENCE, detect=Detect(recognisers=RULES), taxonomy=TAXONOMY, scoring=SCORING,
)

#: Side texts are keyed by a number below this, so the side that is broadcast has no more rows.
SIDE_KEYS = 64


def table(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    return spark.read.parquet(f"{sf_dir}/{name}.parquet")


def entries(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The manifest with content (null where it is missing) and side text, a row a document; only the side is joined."""
    d = table(spark, sf_dir, "documents")
    m = F.col("doc_id") % 50
    kind = (
        F.when(m == 0, "application/octet-stream").when(m == 1, "image/png").when(m == 2, "image/jpeg")
        .when(m == 3, "application/pdf").when(m == 4, "text/markdown").otherwise("text/plain")
    )
    body = F.col("text").cast("binary")
    rows = d.select(
        "doc_id", F.format_string("doc_%06d", F.col("doc_id")).alias("source_id"), kind.alias("content_type"),
        F.when(m == 7, F.sha2(F.concat("text", F.lit("#")).cast("binary"), 256)).otherwise(F.sha2(body, 256)).alias("content_hash"),
        F.concat(F.lit("docs/"), F.col("doc_id").cast("string"), F.lit(".txt")).alias("path"),
        F.concat(F.lit("analyst-"), (F.col("doc_id") % 5).cast("string")).alias("author"), F.lit("2026-01-01T00:00:00Z").alias("datetime"),
        F.col("lang").alias("linked_executive"), F.col("source").alias("linked_project"),
        F.when(m != 9, body).alias("content"), F.when(m.isin(1, 2), F.col("doc_id") % SIDE_KEYS).alias("_side"),
    )
    side = table(spark, sf_dir, "benchmark").where(F.col("item_id").between(0, SIDE_KEYS - 1)).groupBy(F.col("item_id").alias("_side")).agg(F.min("text").alias("ocr_text"))
    return rows.join(F.broadcast(side), "_side", "left").drop("_side")


def gated(spark: SparkSession, sf_dir: str, gate: OcrGate = OcrGate()) -> DataFrame:
    return ops.ocr_gate(ops.extract(ops.ingest(entries(spark, sf_dir))), gate)


def analysed(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Items with their findings; the text is gone, nothing was shuffled."""
    rows = gated(spark, sf_dir)
    made = F.concat(ops.rule_findings(RULES), ops.apply_calibration(ops.model_findings(TAXONOMY.categories, HINTS, SCORING), SCORING))
    found = F.when(F.col("exception_code").isNull(), made).otherwise(ops.no_findings())
    return rows.withColumn("findings", once(found)).drop("text", "content", "ocr_text")


def summary(spark: SparkSession, sf_dir: str) -> DataFrame:
    return ops.summarise(analysed(spark, sf_dir))
