"""Schemas of the relations and the closed sets of values, as DDL and tuples."""

from __future__ import annotations

from pyspark.sql import types as T

FLAG_STATUS = ("flagged", "not_flagged", "unable_to_process")
PROCESSING_STATUS = ("complete", "partial")
SCORE_TYPE = ("deterministic_match", "similarity", "model_score", "classifier_score")
BAND = ("deterministic", "high", "medium", "low")
CALIBRATION_STATUS = ("calibrated", "provisional", "not_calibrated", "not_applicable")
EXCEPTION_CODE = (
    "not_in_manifest", "hash_mismatch", "unsupported_type", "unreadable", "extraction_error", "ocr_failure", "detection_error", "internal_error",
)
JOB_TYPE = ("single", "batch")
JOB_STATUS = ("pending", "queued", "running", "retrying", "completed", "failed", "cancelled")
TERMINAL = ("completed", "failed", "cancelled")
ACTIVE = ("queued", "running", "retrying")

TEXT_TYPES = (
    "text/plain", "text/markdown", "application/pdf",
    "application/vnd.openxmlformats-officedocument.wordprocessingml.document",
    "application/vnd.openxmlformats-officedocument.spreadsheetml.sheet",
)
IMAGE_TYPES = ("image/png", "image/jpeg", "image/tiff")

MANIFEST = "source_id string, content_type string, content_hash string, path string, author string, datetime string, linked_executive string, linked_project string"
LOCATION = "struct<page:int,sheet:string,cell:string,char_start:int,char_end:int>"
SPANS = f"array<struct<location:{LOCATION},text:string>>"
FINDING_COLUMNS = (
    "finding_id string, category string, reason_code string, score_type string, band string, rule_id string, score double, calibration_status string, "
    f"threshold_version string, detector string, reason string, label string, location {LOCATION}"
)
FINDING = f"struct<{FINDING_COLUMNS}>"
FINDINGS = f"array<{FINDING}>"
RULES = "rule_id string, category string, pattern string, reason_code string"
LABELS = "category string, split string, score double, label int"
CALIBRATION = "category string, status string, method string, a double, b double, x array<double>, y array<double>"
EVENT = "source_id string, stage string, outcome string, exception_code string, detail map<string,double>"
JOB_STATE = (
    "status string, job_type string, run_id string, config_version string, progress_done long, progress_total long, flagged long, not_flagged long, "
    "unable long, cancel_requested boolean, exception string, payload string"
)
JOB_EVENT = f"seq long, job_id string, kind string, ts string, created_at string, delta long, {JOB_STATE}"
NER_RESULT = "array<struct<entity_type:string,start:int,end:int,score:double>>"


def struct(ddl: str) -> T.StructType:
    return T.StructType.fromDDL(ddl)
