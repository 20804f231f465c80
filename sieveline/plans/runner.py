"""Runs: from a configuration to written results. One plan analyses items, whatever their number; a batch is a sequence of
slices of its selection, each of them appended to the run's folder, so that an interrupted run goes on where it stopped."""

from __future__ import annotations

import threading
import uuid
from collections.abc import Callable
from contextlib import nullcontext
from dataclasses import dataclass, field
from datetime import UTC, datetime

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from ..config import Config
from ..functions import text
from ..operators import calibration, engines
from ..operators import items as ops
from ..schema import FINDINGS, MANIFEST, NER_RESULT, SPANS, struct
from ..sources import files, sinks
from ..sources.shared import exists, names, new_path, remove
from ..streaming import live
from . import jobs

#: What a run keeps of an item: no text, no content.
KEPT = (
    "source_id", "content_type", "content_hash", "author", "datetime", "linked_executive", "linked_project", "exception_code", "failed_in_extract", "coverage_complete",
    "ocr_used", "printable_ratio", "image_coverage", "findings",
)
ITEMS = (
    "source_id string, content_type string, content_hash string, author string, datetime string, linked_executive string, linked_project string, exception_code string, "
    f"failed_in_extract boolean, coverage_complete boolean, ocr_used boolean, printable_ratio double, image_coverage double, findings {FINDINGS}"
)


@dataclass
class Context:
    """A configuration with what it names, built once a run. Engines are factories: workers start them, once a task. What
    is None is the built-in form. ``examples``: vectors of the semantic screen's phrases by category."""

    spark: SparkSession
    cfg: Config
    source: files.FolderSource
    extract: Callable | None = None
    ocr: Callable | None = None
    detect: Callable | None = None
    score: Callable | None = None
    embed: Callable | None = None
    examples: dict[str, list[list[float]]] = field(default_factory=dict)
    maps: DataFrame | None = None


def build(spark: SparkSession, cfg: Config, **own) -> Context:
    """``own`` replaces engines, for instance by fakes. A remote provider without an approval is refused here already."""
    made = {
        "extract": engines.extraction_engine, "ocr": engines.ocr_engine, "detect": engines.detector, "score": engines.provider, "embed": engines.embedder,
    }
    parts = {k: own[k] if k in own else make(cfg) for k, make in made.items()}
    examples: dict[str, list[list[float]]] = {}
    if parts["embed"] is not None:
        embed = parts["embed"]()  # a few phrases of the configuration, on the driver
        examples = {c: embed(list(phrases)) for c, phrases in cfg.semantic.examples.items() if phrases}
    artefact = cfg.scoring.calibration.artefact
    maps = files.calibration(spark, artefact) if artefact else None
    return Context(spark, cfg, files.reader(cfg.source.backend)(spark, cfg.source.root, cfg.source.manifest), examples=examples, maps=maps, **parts)


# ---- the plan -------------------------------------------------------------------------------------------------------


def _extract(ctx: Context, rows: DataFrame) -> DataFrame:
    none = F.array().cast(SPANS)
    if ctx.extract is None:
        return ops.extract(rows).withColumns({"spans": none, "failed_in_extract": F.lit(False)})
    alive = F.col("exception_code").isNull()
    rows = rows.withColumn("_x", engines.extracted(ctx.extract, F.when(alive, F.col("content")), F.col("content_type"), F.col("path")))
    code = F.coalesce("exception_code", "_x.code")
    rows = rows.withColumns({"text": F.col("_x.text"), "spans": F.coalesce("_x.spans", none), "failed_in_extract": F.col("_x.code").isNotNull(), "_complete": F.col("_x.complete"), "exception_code": code}).drop("_x")
    has = F.coalesce(~text.is_blank(F.col("text")), F.lit(False))
    return rows.withColumns({
        "has_text_layer": has, "printable_ratio": F.when(has, text.printable_ratio(F.col("text"))).otherwise(F.lit(0.0)),
        "image_coverage": F.when(has, F.lit(0.0)).otherwise(F.lit(1.0)), "coverage_complete": F.coalesce("_complete", F.lit(False)) & has, "ocr_used": F.lit(False),
    }).drop("_complete")


def _detect(ctx: Context, rows: DataFrame) -> DataFrame:
    """Adds _det (findings) and detection's failures."""
    d, alive = ctx.cfg.detect, F.col("exception_code").isNull()
    if ctx.detect is None:
        return rows.withColumn("_det", ops.rule_findings(d.recognisers, spans="spans"))
    rows = rows.withColumn("_n", engines.entities(ctx.detect, F.when(alive, F.coalesce("text", F.lit("")))))
    found = ops.ner_findings(F.coalesce("_n.results", F.array().cast(NER_RESULT)), d, F.col("spans"))
    return rows.withColumns({"_det": found, "exception_code": F.coalesce("exception_code", "_n.code")}).drop("_n")


def _screen(ctx: Context, rows: DataFrame) -> DataFrame:
    """Adds _sim (similarity findings) and _routed (the categories that a model is asked about)."""
    s, alive = ctx.cfg.semantic, F.col("exception_code").isNull()
    if ctx.embed is None:
        return rows.withColumns({"_sim": ops.no_findings(), "_routed": F.array(*[F.lit(c) for c in ctx.cfg.taxonomy.categories]).cast("array<string>")})
    body = F.when(alive & ~F.coalesce(text.is_blank(F.col("text")), F.lit(True)), F.col("text")) if ctx.examples else F.lit(None).cast("string")
    rows = rows.withColumn("_v", engines.vectors(ctx.embed, body))
    rows = rows.withColumns({"_sim": text.once(ops.screened(F.col("_v.v"), ctx.examples, s, F.length("text"))), "exception_code": F.coalesce("exception_code", "_v.code")}).drop("_v")
    return rows.withColumn("_routed", F.transform("_sim", lambda f: f["category"]))


def _assess(ctx: Context, rows: DataFrame) -> DataFrame:
    """Adds _model (findings) and the provider's failures."""
    scoring, inf = ctx.cfg.scoring, ctx.cfg.inference
    if ctx.score is None:
        categories = tuple(sorted(ctx.examples)) if ctx.embed is not None else ctx.cfg.taxonomy.categories
        return rows.withColumn("_model", ops.model_findings(categories, inf.mock_hints, scoring, F.col("_routed") if ctx.embed is not None else None, version=inf.model_version))
    span = F.when(F.col("exception_code").isNull() & (F.size("_routed") > 0), ops.model_span())
    rows = rows.withColumn("_m", engines.scores(ctx.score, span, F.col("_routed")))
    found = ops.scored_findings(F.coalesce("_m.scores", F.array().cast("array<struct<category:string,score:double>>")), F.col("_m.shown"), scoring, inf.model_version)
    return rows.withColumns({"_model": found, "exception_code": F.coalesce("exception_code", "_m.code")}).drop("_m")


def analyse(ctx: Context, entries: DataFrame) -> DataFrame:
    """The per-item plan: entries with content (and ocr_text, where texts lie beside items) -> a row each of KEPT. Narrow:
    nothing is shuffled, and the text is gone at its end. A failure is a code in the row and empties the findings."""
    rows = _extract(ctx, ops.ingest(entries))
    rows = ops.ocr_gate(rows, ctx.cfg.ocr_gate, engines.recognised(ctx.ocr) if ctx.ocr is not None else None)
    # texts that OCR made have no anchors
    rows = rows.withColumn("spans", F.when(F.col("ocr_used"), F.array().cast(SPANS)).otherwise(F.col("spans")))
    rows = _assess(ctx, _screen(ctx, _detect(ctx, rows)))
    maps = calibration.as_map(ctx.maps) if ctx.maps is not None else None
    made = F.concat(ops.apply_calibration(F.concat("_det", "_model"), ctx.cfg.scoring, maps), "_sim")
    return rows.withColumn("findings", text.once(F.when(F.col("exception_code").isNull(), made).otherwise(ops.no_findings()))).select(*KEPT)


# ---- results --------------------------------------------------------------------------------------------------------


def snapshot_id(cfg: Config) -> str:
    """What a summary row says of the manifest that was frozen."""
    return f"sample:{cfg.source.manifest.rstrip('/').rpartition('/')[2].rpartition('.')[0]}"


def summary(ctx: Context, items: DataFrame, run_id: str) -> DataFrame:
    named = items.withColumns({"snapshot_id": F.lit(snapshot_id(ctx.cfg)), "run_id": F.lit(run_id), "config_version": F.lit(ctx.cfg.config_version)})
    return ops.summarise(named, "snapshot_id", "content_hash", "run_id", "config_version")


def engine_names(cfg: Config) -> dict[str, str]:
    return {
        "extract": cfg.extract.engine, "detect": cfg.detect.engine, "detector_version": cfg.detect.detector_version, "ocr": cfg.ocr.provider,
        "inference_provider": cfg.inference.provider, "model_version": cfg.inference.model_version,
    }


@dataclass
class Result:
    """What a run answers. Rows stay where they were written; ``rows`` reads them."""

    job_id: str
    job_type: str
    status: str
    run_id: str = ""
    config_version: str = ""
    reconcile: dict = field(default_factory=dict)
    folder: str | None = None
    started_at: str = ""
    finished_at: str = ""
    exception: str | None = None

    def rows(self, spark: SparkSession) -> dict[str, DataFrame]:
        return files.results(spark, self.folder)


EMPTY = {"input_count": 0, "flagged": 0, "not_flagged": 0, "unable_to_process": 0, "one_row_per_input": False, "reconciled": False}


def _now() -> str:
    return datetime.now(UTC).isoformat()


def failed(job_type: str, config_version: str, message: str, started: str) -> Result:
    """A run that could not start."""
    return Result(f"{job_type}-invalid", job_type, "failed", "", config_version, dict(EMPTY), None, started, _now(), message)


def history(cfg: Config) -> str:
    """The table that holds the summary rows of all runs, a partition a run (:func:`files.kept` reads it)."""
    return f"{cfg.output.result_dir.rstrip('/')}/history"


def _write(ctx: Context, items: DataFrame, run_id: str, folder: str, expected: DataFrame | None = None) -> dict:
    """Results and ledger of the items (a saved table), and their counts: against the selection that was ``expected``, or,
    where a batch may have been cancelled, of what was processed."""
    form, made, path = ctx.cfg.output.format, summary(ctx, items, run_id), new_path(ctx.spark, "summary")
    made.write.parquet(path)  # once, for all that is told of it below
    rows = ctx.spark.read.schema(made.schema).parquet(path)
    sinks.write(rows, f"{folder}/item_summary", form)
    sinks.keep(rows, history(ctx.cfg), run_id)
    sinks.write(ops.findings_rows(items), f"{folder}/findings", form, ("source_id", "finding_id"))
    counts = jobs.reconcile(rows, expected)
    sinks.write_ledger(run_id, ctx.cfg.config_version, engine_names(ctx.cfg), counts, ops.events(items, ctx.cfg.extract.engine), jobs.final_status(rows), f"{folder}/ledger")
    told = counts.first().asDict()
    remove(ctx.spark, path)
    return told


def _items(spark: SparkSession, folder: str) -> DataFrame:
    """The slices that a run has written; each is whole or absent, as Spark commits it."""
    done = [f"{folder}/items/{n}" for n in names(spark, f"{folder}/items") if exists(spark, f"{folder}/items/{n}/_SUCCESS")]
    return spark.read.schema(struct(ITEMS)).parquet(*done) if done else spark.createDataFrame([], struct(ITEMS))


#: What a request selects: ids, a table of ids, or all of the manifest.
Ids = list[str] | DataFrame | None


def _selected(ctx: Context, source_ids: Ids) -> DataFrame:
    if source_ids is None:
        return ctx.source.entries()
    ids = source_ids if isinstance(source_ids, DataFrame) else list(dict.fromkeys(source_ids))
    return ctx.source.select(ids).drop("ordinal").select(*[f.name for f in struct(MANIFEST)])


def _identity(ctx: Context, selected: DataFrame) -> str:
    return jobs.large_run_id(selected, ctx.cfg.config_version, ctx.cfg.seed).first()["run_id"]


def _guard(cfg: Config, config_version: str) -> str | None:
    return None if config_version == cfg.config_version else f"config_version mismatch: request={config_version} config={cfg.config_version}"


def run(ctx: Context) -> Result:
    """All of the manifest, results directly in the result folder."""
    started, selected = _now(), ctx.source.entries()
    run_id, folder = _identity(ctx, selected), ctx.cfg.output.result_dir.rstrip("/")
    remove(ctx.spark, f"{folder}/items")
    analyse(ctx, ctx.source.read(selected, ctx.ocr is None)).write.parquet(f"{folder}/items/all")
    counts = _write(ctx, _items(ctx.spark, folder), run_id, folder, selected)
    return Result(f"run-{run_id}", "batch", "completed", run_id, ctx.cfg.config_version, counts, folder, started, _now())


#: Slices of a single run whose events are followed.
LIVE_SLICES = 8


def run_single(ctx: Context, config_version: str, source_ids: Ids, on_event: Callable[[dict], None] | None = None) -> Result:
    """A small explicit selection, in a folder of its own. ``on_event`` gets the stage events while the run goes on: the
    selection is analysed in up to LIVE_SLICES slices, and a stream over what they have written hands the events on."""
    started = _now()
    if wrong := _guard(ctx.cfg, config_version):
        return failed("single", config_version, wrong, started)
    if source_ids is None or not isinstance(source_ids, DataFrame) and not source_ids:
        return failed("single", config_version, "single job requires at least one source_id", started)
    try:
        selected = _selected(ctx, source_ids)
    except files.UnknownIds as e:
        return failed("single", config_version, str(e), started)
    run_id = _identity(ctx, selected)
    folder = sinks.run_folder(ctx.cfg.output.result_dir, "single", run_id)
    remove(ctx.spark, f"{folder}/items")
    slices = 1 if on_event is None else max(min(LIVE_SLICES, selected.count()), 1)
    with live.events(ctx.spark, f"{folder}/items", struct(ITEMS), ctx.cfg.extract.engine, on_event) if on_event is not None else nullcontext():
        for k in range(slices):
            analyse(ctx, ctx.source.read(_sliced(selected, k, slices), ctx.ocr is None)).write.parquet(f"{folder}/items/slice-{k:08d}")
    counts = _write(ctx, _items(ctx.spark, folder), run_id, folder, selected)
    return Result(f"single-{run_id}", "single", "completed", run_id, ctx.cfg.config_version, counts, folder, started, _now())


#: Seconds between two looks at whether a run is to be cancelled.
POLL = 0.5


def unless_cancelled(spark: SparkSession, action: Callable[[], None], should_cancel: Callable[[], bool] | None, poll: float = POLL) -> bool:
    """Runs an action whose Spark jobs carry a tag of its own. While they run, another thread asks ``should_cancel``; once it
    says so, the jobs of the tag are cancelled, so that a slice ends within seconds, however large. False: cancelled."""
    if should_cancel is None:
        action()
        return True
    context, tag, over, asked = spark.sparkContext, f"sieveline-{uuid.uuid4().hex}", threading.Event(), threading.Event()

    def watch() -> None:
        while not over.wait(poll):
            if asked.is_set() or should_cancel():
                asked.set()
                context.cancelJobsWithTag(tag)  # again, as the action may have started a further job

    watcher = threading.Thread(target=watch, daemon=True)
    context.addJobTag(tag)
    watcher.start()
    try:
        action()
        return True
    except Exception:
        if not asked.is_set():
            raise
        return False
    finally:
        over.set()
        watcher.join()
        context.removeJobTag(tag)


def _sliced(rows: DataFrame, k: int, slices: int) -> DataFrame:
    return rows.where(F.pmod(F.xxhash64("source_id"), F.lit(slices)) == k)


def run_batch(
    ctx: Context, config_version: str, source_ids: Ids = None, batch_size: int = 500, resume: bool = False,
    on_progress: Callable[[int], None] | None = None, should_cancel: Callable[[], bool] | None = None,
) -> Result:
    """A selection in slices of about ``batch_size`` items, dealt by a hash of the id. Each slice is one Spark job over all
    executors and, once written, a checkpoint; give large slices on a cluster. ``should_cancel`` is asked between
    slices and while one runs, which then ends and leaves nothing; a cancelled run reconciles over what it has processed. ``resume`` keeps the items that an earlier run of the
    same selection and configuration has written."""
    started = _now()
    if wrong := _guard(ctx.cfg, config_version):
        return failed("batch", config_version, wrong, started)
    try:
        selected = _selected(ctx, source_ids)
    except files.UnknownIds as e:
        return failed("batch", config_version, str(e), started)
    run_id = _identity(ctx, selected)
    folder = sinks.run_folder(ctx.cfg.output.result_dir, "batch", run_id)
    if not resume:
        remove(ctx.spark, f"{folder}/items")
    todo = jobs.remaining(selected, _items(ctx.spark, folder))
    slices, cancelled = -(-todo.count() // max(batch_size, 1)), False
    start = len(names(ctx.spark, f"{folder}/items"))
    ids = todo.select("source_id")
    ids.write.mode("overwrite").parquet(f"{folder}/todo")  # what is left is fixed before the first slice ends
    fixed = selected.join(ctx.spark.read.schema("source_id string").parquet(f"{folder}/todo"), "source_id", "left_semi")
    for k in range(slices):
        if should_cancel is not None and should_cancel():
            cancelled = True
            break
        part, path = _sliced(fixed, k, slices), f"{folder}/items/slice-{start + k:08d}"
        write = lambda part=part, path=path: analyse(ctx, ctx.source.read(part, ctx.ocr is None)).write.mode("overwrite").parquet(path)
        if not unless_cancelled(ctx.spark, write, should_cancel):
            remove(ctx.spark, path)  # a slice is whole or absent
            cancelled = True
            break
        if on_progress is not None:
            on_progress(ctx.spark.read.schema(struct(ITEMS)).parquet(path).count())
    remove(ctx.spark, f"{folder}/todo")
    counts = _write(ctx, _items(ctx.spark, folder), run_id, folder)
    return Result(f"batch-{run_id}", "batch", "cancelled" if cancelled else "completed", run_id, ctx.cfg.config_version, counts, folder, started, _now())


__all__ = ["Context", "Result", "analyse", "build", "engine_names", "failed", "run", "run_batch", "run_single", "snapshot_id", "summary"]
