"""The query catalogue: (spark, sf_dir) -> DataFrame, one a family of operators."""

from __future__ import annotations

from dataclasses import replace

from pyspark.sql import Column, DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from ..config import Config, Detect, OcrGate, Output, Recogniser, Semantic, Source
from ..functions import identifiers, numbers, text
from ..operators import calibration as cal
from ..operators import items as ops
from ..operators.linkage import Linkage, linked, patterns
from ..schema import JOB_EVENT, MANIFEST, struct
from ..sources import files, sinks
from ..sources.shared import new_path
from . import jobs, profile, registry, runner, snapshots

#: The OCR gate of the query that exercises the density branch.
DENSE = OcrGate(min_text_density=0.83)

PUBLIC_KEY = "public-test-key"

SEMANTIC = Semantic(enabled=True, route_threshold=0.2, threshold_version="sem-0")


#: Rules of the query that locates matches in pages.
ANCHORED = (Recogniser("TAG-001", "markup", r"<[a-z]+", "tag"), Recogniser("NUM-001", "number", r"[0-9]+", "number"))


def _six(c: str) -> Column:
    return F.round(F.col(c), 6).alias(c)


def manifest_scan(spark: SparkSession, sf_dir: str) -> DataFrame:
    return profile.entries(spark, sf_dir).select("source_id", "content_type", "author", "datetime", "linked_executive", "linked_project")


def ingest_status(spark: SparkSession, sf_dir: str) -> DataFrame:
    rows = ops.ingest(profile.entries(spark, sf_dir))
    return rows.select("source_id", "content_type", F.sha2("content", 256).alias("actual_hash"), "exception_code")


def extract_decode(spark: SparkSession, sf_dir: str) -> DataFrame:
    rows = ops.extract(ops.ingest(profile.entries(spark, sf_dir))).where("exception_code is null")
    dens = text.density(F.coalesce(F.col("text"), F.lit("")))
    return rows.select("source_id", "has_text_layer", F.length("text").cast("long").alias("n_chars"), _six("printable_ratio"), F.round(dens, 6).alias("density"), "image_coverage", "coverage_complete")


def line_spans(spark: SparkSession, sf_dir: str) -> DataFrame:
    rows = profile.table(spark, sf_dir, "documents").select("doc_id", text.once(text.line_spans(F.col("text"))).alias("spans")).select("doc_id", F.posexplode("spans").alias("span", "s"))
    return rows.select("doc_id", F.col("span").cast("long").alias("span"), F.col("s.char_start").cast("long").alias("char_start"), F.col("s.char_end").cast("long").alias("char_end"), F.sha2(F.col("s.text").cast("binary"), 256).alias("span_sha256"))


def ocr_gate(spark: SparkSession, sf_dir: str) -> DataFrame:
    rows = profile.gated(spark, sf_dir, DENSE)
    return rows.select("source_id", "needs_ocr", "ocr_used", "exception_code", "coverage_complete", F.length("text").cast("long").alias("n_chars"))


def _rule_hits(spark: SparkSession, sf_dir: str) -> DataFrame:
    rows = profile.table(spark, sf_dir, "documents").select(F.format_string("doc_%06d", F.col("doc_id")).alias("source_id"), text.once(ops.rule_findings(profile.RULES)).alias("findings"))
    return rows.select("source_id", F.explode("findings").alias("f")).select("source_id", "f.*")


def regex_hits(spark: SparkSession, sf_dir: str) -> DataFrame:
    return _rule_hits(spark, sf_dir).select(
        "source_id", "finding_id", "category", "rule_id", "reason", F.col("location.char_start").cast("long").alias("char_start"), F.col("location.char_end").cast("long").alias("char_end")
    )


def regex_hits_by_rule(spark: SparkSession, sf_dir: str) -> DataFrame:
    return _rule_hits(spark, sf_dir).groupBy("rule_id").agg(F.count("*").alias("hits"), F.countDistinct("source_id").alias("documents"))


def mock_model_scores(spark: SparkSession, sf_dir: str) -> DataFrame:
    made = ops.model_findings(profile.TAXONOMY.categories, profile.HINTS, profile.SCORING)
    rows = profile.table(spark, sf_dir, "documents").select("doc_id", text.once(made).alias("found")).select("doc_id", F.explode("found").alias("f"))
    return rows.select("doc_id", F.col("f.finding_id").alias("finding_id"), F.col("f.category").alias("category"), F.col("f.score").alias("score"), F.col("f.reason").alias("reason"), F.col("f.location.char_end").cast("long").alias("char_end"))


def _labelled(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Labels of the bench: category = language, raw score = n_chars / 50 up to 100, truth = quality, split by parity."""
    d, l = profile.table(spark, sf_dir, "documents").select("doc_id", "lang", "n_chars"), profile.table(spark, sf_dir, "labels").select("doc_id", "quality")
    split = F.when(F.col("doc_id") % 2 == 0, "dev").otherwise("holdout")
    return d.join(l, "doc_id").select("doc_id", F.col("lang").alias("category"), split.alias("split"), F.least(F.lit(100.0), F.col("n_chars") / 50.0).alias("score"), F.col("quality").cast("int").alias("label"))


def banding(spark: SparkSession, sf_dir: str) -> DataFrame:
    rows = _labelled(spark, sf_dir)
    return rows.select("doc_id", F.round("score", 6).alias("score"), numbers.band(F.col("score")).alias("band"))


def calibration_apply(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Fixed maps: en sigmoid, fr isotonic, de identity but calibrated, others without a row."""
    knots = lambda *v: F.array(*[F.lit(x) for x in v])
    c = F.col("category")
    method = F.when(c == "en", "sigmoid").when(c == "fr", "isotonic").when(c == "de", "identity")
    value = numbers.calibrated(F.col("score"), method, F.lit(-4.0), F.lit(1.5), knots(0.1, 0.4, 0.4, 0.9), knots(0.05, 0.3, 0.5, 0.8))
    status = F.when(c == "en", "calibrated").when(c == "fr", "provisional").when(c == "de", "calibrated").otherwise("not_calibrated")
    out = F.when(status.isin("calibrated", "provisional"), value).otherwise(F.col("score"))
    return _labelled(spark, sf_dir).select("doc_id", "category", status.alias("calibration_status"), F.round(out, 6).alias("score"), numbers.band(F.round(out, 6)).alias("band"))


def calibration_ece(spark: SparkSession, sf_dir: str) -> DataFrame:
    rows = _labelled(spark, sf_dir)
    errors = cal.calibration_error(rows.where("split = 'holdout'").select("category", (F.col("score") / 100.0).alias("p"), "label"))
    positives = rows.groupBy("category").agg(F.count_if((F.col("split") == "dev") & (F.col("label") == 1)).alias("positives"))
    out = positives.join(errors, "category", "left").withColumn("error", F.coalesce("error", F.lit(100.0)))
    status = F.when(F.col("positives") == 0, "not_calibrated").when((F.col("positives") >= 100) & (F.col("error") <= 5.0), "calibrated").otherwise("provisional")
    return out.select("category", "positives", F.round("error", 6).alias("error"), status.alias("status"))


def _fitted(spark: SparkSession, sf_dir: str, method: str) -> DataFrame:
    """Knots as pairs of whole numbers of millionths, so that they compare as text."""
    rows = cal.fit(_labelled(spark, sf_dir).select("category", "split", "score", "label"), method)
    millionths = lambda v: F.round(v * 1e6).cast("long").cast("string")
    knots = F.array_join(F.transform(F.arrays_zip("x", "y"), lambda k: F.concat(millionths(k["x"]), F.lit(":"), millionths(k["y"]))), ",")
    return rows.select("category", "status", "method", F.round("a", 5).alias("a"), F.round("b", 5).alias("b"), knots.alias("knots"), "positives", F.round("error", 5).alias("error"))


def calibration_fit_sigmoid(spark: SparkSession, sf_dir: str) -> DataFrame:
    return _fitted(spark, sf_dir, "sigmoid")


def calibration_fit_isotonic(spark: SparkSession, sf_dir: str) -> DataFrame:
    return _fitted(spark, sf_dir, "isotonic")


#: Examples of a category, and categories whose examples a task holds at once.
EXAMPLES, CATEGORY_BLOCK = 3, 1_000


def _against(names: list[str], matrix, starts):
    """mapInArrow: (source_id, v) -> (source_id, category, cosine), the greatest cosine with each category's examples. The
    rows of ``matrix`` are unit vectors, or zero; a category's rows begin at its start."""
    import numpy as np
    import pyarrow as pa

    def run(batches):
        for whole in batches:
            for at in range(0, whole.num_rows, 4096):
                batch = whole.slice(at, 4096)
                n = batch.num_rows
                v = batch.column(1).flatten().to_numpy(zero_copy_only=False).reshape(n, matrix.shape[1])
                norms = np.linalg.norm(v, axis=1, keepdims=True)
                best = np.maximum.reduceat((v / np.where(norms > 0, norms, 1)) @ matrix.T, starts, axis=1)
                ids = np.repeat(batch.column(0).to_numpy(), len(names))
                yield pa.RecordBatch.from_arrays([pa.array(ids), pa.array(names * n), pa.array(best.ravel())], names=["source_id", "category", "cosine"])

    return run


def _cosines(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Greatest cosine of each item with a category's examples: the three lowest ids of each label. The examples go to the
    tasks as matrices, of CATEGORY_BLOCK categories each; every block is one pass over the items. Items without a vector
    have no rows; vectors of another length are an error."""
    import numpy as np

    e = profile.table(spark, sf_dir, "embeddings").where("embedding is not null").select("vec_id", F.col("embedding").cast("array<double>").alias("v"), "label")
    chosen = e.where("label is not null").withColumn("n", F.row_number().over(Window.partitionBy("label").orderBy("vec_id"))).where(F.col("n") <= EXAMPLES)
    found, held = None, []

    def block(rows: list) -> DataFrame:
        m = np.array([r["v"] for r in rows], dtype=np.float64)
        norms = np.linalg.norm(m, axis=1, keepdims=True)
        labels = [r["label"] for r in rows]
        starts = [k for k, x in enumerate(labels) if not k or x != labels[k - 1]]
        run = _against([f"label-{labels[k]}" for k in starts], m / np.where(norms > 0, norms, 1), starts)
        return e.select(F.col("vec_id").alias("source_id"), "v").mapInArrow(run, "source_id long, category string, cosine double")

    for r in chosen.select("label", "v").orderBy("label").toLocalIterator():
        if len(held) >= CATEGORY_BLOCK * EXAMPLES and r["label"] != held[-1]["label"]:
            part, held = block(held), []
            found = part if found is None else found.unionAll(part)
        held.append(r)
    if held:
        found = block(held) if found is None else found.unionAll(block(held))
    return found if found is not None else spark.createDataFrame([], "source_id long, category string, cosine double")


def cosine_best(spark: SparkSession, sf_dir: str) -> DataFrame:
    return _cosines(spark, sf_dir).select("source_id", "category", F.round("cosine", 6).alias("cosine"))


def semantic_route(spark: SparkSession, sf_dir: str) -> DataFrame:
    found = ops.semantic_findings(_cosines(spark, sf_dir).withColumn("cosine", F.round("cosine", 6)), SEMANTIC)
    return found.groupBy("source_id").agg(F.array_join(F.sort_array(F.collect_set("category")), ",").alias("routed"), F.count("*").alias("n_findings"), F.max("score").alias("best"))


def similarity_findings(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The findings that routing leaves, all fields that they have."""
    found = ops.semantic_findings(_cosines(spark, sf_dir).withColumn("cosine", F.round("cosine", 6)), SEMANTIC)
    return found.select(
        "source_id", "finding_id", "category", "reason_code", "score_type", "band", "score", "calibration_status", "threshold_version", "detector", "reason", text.evidence(F.col("location")).alias("evidence"),
    )


def routed_model_calls(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Calls that routing leaves: items and categories that reach the threshold; others get no call."""
    routed = ops.semantic_findings(_cosines(spark, sf_dir).withColumn("cosine", F.round("cosine", 6)), SEMANTIC)
    return routed.groupBy("category").agg(F.count("*").alias("calls"))


def findings_union(spark: SparkSession, sf_dir: str) -> DataFrame:
    rows = ops.findings_rows(profile.analysed(spark, sf_dir))
    return rows.select("source_id", "finding_id", "category", "score_type", "band", "score", "calibration_status", text.evidence(F.col("location")).alias("evidence"))


def strongest_finding(spark: SparkSession, sf_dir: str) -> DataFrame:
    return profile.summary(spark, sf_dir).where("flag_status = 'flagged'").select("source_id", "strongest_band", "strongest_score_type", "strongest_score", "calibration_status")


def reason_summary(spark: SparkSession, sf_dir: str) -> DataFrame:
    return profile.summary(spark, sf_dir).select("source_id", "reason_summary")


def item_summary(spark: SparkSession, sf_dir: str) -> DataFrame:
    rows = profile.summary(spark, sf_dir)
    return rows.withColumn("sensitivity_categories", F.array_join("sensitivity_categories", ","))


def reconcile(spark: SparkSession, sf_dir: str) -> DataFrame:
    return jobs.reconcile(profile.summary(spark, sf_dir), profile.table(spark, sf_dir, "documents"))


def stage_events(spark: SparkSession, sf_dir: str) -> DataFrame:
    return ops.events(profile.gated(spark, sf_dir)).select("source_id", F.col("ordinal").cast("long").alias("ordinal"), "stage", "outcome", "exception_code")


def run_id(spark: SparkSession, sf_dir: str) -> DataFrame:
    return jobs.run_id(profile.entries(spark, sf_dir), profile.CONFIG_VERSION, profile.SEED)


def final_status(spark: SparkSession, sf_dir: str) -> DataFrame:
    return jobs.final_status(profile.summary(spark, sf_dir))


def _earlier(spark: SparkSession, sf_dir: str) -> DataFrame:
    """What an interrupted run left: every third document."""
    d = profile.table(spark, sf_dir, "documents")
    return d.where("doc_id % 3 = 0").select(F.format_string("doc_%06d", F.col("doc_id")).alias("source_id"), F.lit("resumed").alias("origin"))


def _selection(spark: SparkSession, sf_dir: str) -> DataFrame:
    return profile.table(spark, sf_dir, "documents").select(F.format_string("doc_%06d", F.col("doc_id")).alias("source_id"))


def resume_remaining(spark: SparkSession, sf_dir: str) -> DataFrame:
    return jobs.remaining(_selection(spark, sf_dir), _earlier(spark, sf_dir))


def resume_merge(spark: SparkSession, sf_dir: str) -> DataFrame:
    earlier, selection = _earlier(spark, sf_dir), _selection(spark, sf_dir)
    fresh = jobs.remaining(selection, earlier).withColumn("origin", F.lit("fresh"))
    return jobs.merge(jobs.done(earlier, selection), fresh)


def retry_selection(spark: SparkSession, sf_dir: str) -> DataFrame:
    return jobs.retry(profile.summary(spark, sf_dir))


def _jobs(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Orders as jobs: F completed, O queued, P running; counts from the lines of an order."""
    o = profile.table(spark, sf_dir, "orders")
    lines = profile.table(spark, sf_dir, "lineitem").groupBy("l_orderkey").agg(
        F.count_if(F.col("l_returnflag") == "R").alias("flagged"), F.count_if(F.col("l_returnflag") == "N").alias("not_flagged"), F.count_if(F.col("l_returnflag") == "A").alias("unable")
    )
    status = F.when(F.col("o_orderstatus") == "F", "completed").when(F.col("o_orderstatus") == "O", "queued").otherwise("running")
    zero = lambda c: F.coalesce(c, F.lit(0))
    return o.join(lines, o["o_orderkey"] == lines["l_orderkey"], "left").select(
        F.col("o_orderkey").alias("job_id"), status.alias("status"), F.col("o_orderdate").alias("created_at"),
        zero(F.col("flagged")).alias("flagged"), zero(F.col("not_flagged")).alias("not_flagged"), zero(F.col("unable")).alias("unable"),
        (zero(F.col("flagged")) + zero(F.col("unable"))).alias("progress"),
    )


def migration_summary(spark: SparkSession, sf_dir: str) -> DataFrame:
    return jobs.migration_summary(_jobs(spark, sf_dir), 1_000_000)


def jobs_by_status(spark: SparkSession, sf_dir: str) -> DataFrame:
    return jobs.jobs_by_status(_jobs(spark, sf_dir))


def job_latest_state(spark: SparkSession, sf_dir: str) -> DataFrame:
    e = profile.table(spark, sf_dir, "events").select(F.col("user_id").alias("job_id"), "ts", "event_id", F.col("event_type").alias("status"), "value")
    return jobs.latest(e, "job_id", ("ts", "event_id")).select("job_id", "event_id", "status", F.round("value", 6).alias("value"))


def queue_head(spark: SparkSession, sf_dir: str) -> DataFrame:
    return jobs.queue_head(_jobs(spark, sf_dir)).select("job_id", "status")


def job_list_page(spark: SparkSession, sf_dir: str) -> DataFrame:
    return jobs.newest(_jobs(spark, sf_dir), 50).select("job_id", "status")


def results_workbook(spark: SparkSession, sf_dir: str) -> DataFrame:
    rows = profile.analysed(spark, sf_dir).withColumn("shown", jobs.shown_findings(F.col("findings")))
    one = lambda f: F.concat_ws("|", f["finding_id"], f["category"], f["score_type"], f["routing_only"].cast("string"), f["evidence"])
    book = ops.summarise(rows, "shown")
    return book.select("source_id", "flag_status", F.array_join(F.transform("shown", one), "; ").alias("findings"))


def run_documents(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The runner's plan over the documents, by a configuration: summary rows with the run's identity."""
    ctx = runner.build(spark, profile.CONFIG)
    rows = runner.summary(ctx, runner.analyse(ctx, profile.entries(spark, sf_dir)), "bench")
    return rows.withColumn("sensitivity_categories", F.array_join("sensitivity_categories", ","))


def run_findings(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The runner's findings, all fields."""
    ctx = runner.build(spark, profile.CONFIG)
    rows = ops.findings_rows(runner.analyse(ctx, profile.entries(spark, sf_dir)))
    return rows.select(
        "source_id", "finding_id", "category", "reason_code", "score_type", "band", "rule_id", "score", "calibration_status", "threshold_version", "detector", "reason", text.evidence(F.col("location")).alias("evidence"),
    )


def _folder(spark: SparkSession, sf_dir: str) -> tuple[str, Config]:
    """The documents as a folder of files with a frozen manifest, and a configuration that names them."""
    base, rows = new_path(spark, "folder"), profile.entries(spark, sf_dir)
    sinks.write_items(rows, f"{base}/root")
    rows.select(*[f.name for f in struct(MANIFEST)]).write.parquet(f"{base}/documents.parquet")
    return base, replace(profile.CONFIG, source=Source("sample", f"{base}/root", f"{base}/documents.parquet"), output=Output(f"{base}/out"))


def run_folder(spark: SparkSession, sf_dir: str) -> DataFrame:
    """A full run from files and a manifest to written results, which are read back."""
    _, cfg = _folder(spark, sf_dir)
    result = runner.run(runner.build(spark, cfg))
    rows = result.rows(spark)["item_summary"]
    return rows.select(*[c for c in rows.columns if c != "run_id"], F.lit(result.reconcile["reconciled"]).alias("reconciled")).withColumn("sensitivity_categories", F.array_join("sensitivity_categories", ","))


#: Bytes of a piece in the query below.
PIECE = 1000


def item_pieces(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Contents of all items, read in pieces from files."""
    _, cfg = _folder(spark, sf_dir)
    source = files.FolderSource(spark, cfg.source.root, cfg.source.manifest)
    pieces = source.pieces(source.entries(), PIECE)
    return pieces.select("source_id", "ordinal", "at", F.length("chunk").cast("long").alias("n_bytes"), F.sha2("chunk", 256).alias("chunk_sha256"))


def registry_fold(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Events as a registry's log: a job a user; rows that are put, progress, claims and cancellations fold to its state."""
    e, k = profile.table(spark, sf_dir, "events"), F.col("event_id") % 5
    kind = F.when(k == 0, "put").when(k == 2, "claim").when((k == 3) & (F.col("event_id") % 35 == 3), "cancel").otherwise("progress")
    null = {f.name: F.lit(None).cast(f.dataType) for f in struct(JOB_EVENT)}
    known = {
        "seq": F.col("event_id") + 1, "job_id": F.col("user_id").cast("string"), "kind": kind, "ts": F.col("event_id").cast("string"), "created_at": F.col("event_id").cast("string"),
        "delta": F.when(kind == "progress", F.col("event_id") % 4), "status": F.when(kind == "put", "queued").when(kind == "claim", "running"), "progress_done": F.when(kind == "put", F.col("event_id") % 3),
    }
    state = registry.fold(e.select(*[known.get(c, v).alias(c) for c, v in null.items()]))
    return state.select("job_id", "created_at", "updated_at", "status", "progress_done", "cancel_requested")


def status_filter(spark: SparkSession, sf_dir: str) -> DataFrame:
    return profile.summary(spark, sf_dir).where("flag_status = 'flagged'").select("source_id", "flag_status", "processing_status")


def manifest_page(spark: SparkSession, sf_dir: str) -> DataFrame:
    return jobs.page(manifest_scan(spark, sf_dir), offset=100, size=100)


def mask_identifiers(spark: SparkSession, sf_dir: str) -> DataFrame:
    masked = identifiers.mask_emails(F.col("text"), PUBLIC_KEY)
    return profile.table(spark, sf_dir, "documents").select("doc_id", F.sha2(masked.cast("binary"), 256).alias("masked_sha256"), F.length(masked).cast("long").alias("n_chars"))


def mask_identifiers_udf(spark: SparkSession, sf_dir: str) -> DataFrame:
    import pandas as pd

    def run(texts: pd.Series) -> pd.Series:
        return texts.map(lambda t: None if t is None else identifiers.mask_text(t, PUBLIC_KEY.encode()))

    run.__annotations__ = {"texts": pd.Series, "return": pd.Series}
    masked = F.pandas_udf(run, "string")(F.col("text"))
    return profile.table(spark, sf_dir, "documents").select("doc_id", masked.alias("m")).select("doc_id", F.sha2(F.col("m").cast("binary"), 256).alias("masked_sha256"))


def redact(spark: SparkSession, sf_dir: str) -> DataFrame:
    item = F.format_string("doc_%06d", F.col("doc_id"))
    return profile.table(spark, sf_dir, "documents").select("doc_id", text.redact(F.col("text")).alias("redacted"), text.log_line(item, F.lit("extract"), F.lit("decode")).alias("line"))


NER = Detect(engine="presidio", detector_version="ner-0", category_map={"WORD": "contact", "NUMBER": "financial"}, deterministic_entities=("NUMBER",))


def ner_mapping(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Results of a stand-in analyser (long words, numbers, capitalised words) mapped to findings."""
    from ..operators.engines import entities_of

    rows = profile.table(spark, sf_dir, "conversations").select("conv_id", "turn", entities_of(F.col("text")).alias("results"))
    out = rows.select("conv_id", "turn", F.explode(ops.ner_findings(F.col("results"), NER)).alias("f"))
    return out.select("conv_id", "turn", "f.finding_id", "f.category", "f.score_type", F.round("f.score", 6).alias("score"), F.col("f.location.char_start").cast("long").alias("char_start"))


def location_resolution(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Page anchors of offsets: spans are the html's lines, as pages 1, 2, ...; the offset is the middle of the text."""
    lines = F.split(F.col("html"), "\n", -1)
    spans = F.transform(lines, lambda t, i: F.struct(F.struct((i + 1).alias("page"), F.lit(None).cast("string").alias("sheet"), F.lit(None).cast("string").alias("cell"), F.lit(None).cast("int").alias("char_start"), F.lit(None).cast("int").alias("char_end")).alias("location"), t.alias("text")))
    middle = F.floor(F.length("html") / 2).cast("int")
    place = text.resolve_location(spans, middle, middle + 1)
    return profile.table(spark, sf_dir, "pages").select("page_id", middle.cast("long").alias("char_start"), place["page"].cast("long").alias("page"), text.evidence(place).alias("evidence"))


def anchored_matches(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Rule matches in pages, located by the line (as a page from 1) that holds their start: spans and matches are merged."""
    lines = F.split(F.col("html"), "\n", -1)
    null = F.lit(None).cast("string")
    spans = F.transform(lines, lambda t, i: F.struct(F.struct((i + 1).alias("page"), null.alias("sheet"), null.alias("cell"), F.lit(None).cast("int").alias("char_start"), F.lit(None).cast("int").alias("char_end")).alias("location"), t.alias("text")))
    rows = profile.table(spark, sf_dir, "pages").select("page_id", F.col("html").alias("text"), spans.alias("spans"))
    found = rows.select("page_id", text.once(ops.rule_findings(ANCHORED, spans="spans")).alias("f")).select("page_id", F.explode("f").alias("f"))
    return found.select("page_id", "f.finding_id", "f.rule_id", F.col("f.location.page").cast("long").alias("page"), text.evidence(F.col("f.location")).alias("evidence"))


def category_band_rollup(spark: SparkSession, sf_dir: str) -> DataFrame:
    """An extension: counts of findings by category and band, with totals."""
    return ops.findings_rows(profile.analysed(spark, sf_dir)).rollup("category", "band").agg(F.count("*").alias("findings"))


def stream_available_now(spark: SparkSession, sf_dir: str) -> DataFrame:
    from ..streaming import ingest

    return ingest.run_available_now(spark, f"{sf_dir}/documents.parquet")


def _fed(spark: SparkSession, pieces: list[DataFrame], folder: str, start) -> None:
    """Appends pieces to a folder, one after another; after each, a stream runs to the end of what has come."""
    for piece in pieces:
        piece.write.mode("append").parquet(folder)
        start().awaitTermination()


#: Days of the month at which the commits below are cut, silence after which a job is stalled, and its slices.
CUTS, SILENCE_HOURS, SLICES = (11, 21), 12, 20


def job_progress_stream(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Progress of jobs by a stateful stream in three runs over one checkpoint: an event is a commit of one of its user's 20
    slices; repeats of a slice, of which there are many, add nothing; silent jobs are stalled."""
    from ..streaming import progress

    e = profile.table(spark, sf_dir, "events")
    commits = e.select(F.col("user_id").alias("job_id"), (F.col("event_id") % SLICES).alias("slice"), (F.col("event_id") % SLICES % 4 + 1).alias("items"), "ts")
    day = F.dayofmonth("ts")
    pieces = [commits.where(day < CUTS[0]), commits.where((day >= CUTS[0]) & (day < CUTS[1])), commits.where(day >= CUTS[1])]
    base = new_path(spark, "progress")
    before = spark.conf.get(progress.STORE[0])
    spark.conf.set(*progress.STORE)
    try:
        def start():
            stream = progress.progress(spark.readStream.schema(progress.COMMIT).parquet(f"{base}/in"), SILENCE_HOURS * 3_600_000)
            return stream.writeStream.format("parquet").option("path", f"{base}/out").option("checkpointLocation", f"{base}/checkpoint").trigger(availableNow=True).start()

        _fed(spark, pieces, f"{base}/in", start)
    finally:
        spark.conf.set(progress.STORE[0], before)
    rows = spark.read.schema(progress.PROGRESS).parquet(f"{base}/out")
    return rows.select("job_id", "kind", F.unix_millis("at").alias("at_ms"), "slices", "items")


#: Parts in which job events come below.
PARTS = 4


def admin_summary_stream(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The admin's summary after each of four batches of job events: an event puts its user's job in a state."""
    from ..streaming import progress

    e, k = profile.table(spark, sf_dir, "events"), F.col("event_id")
    status = F.element_at(F.array(*[F.lit(x) for x in ("queued", "running", "completed", "failed", "cancelled")]), (k % 5 + 1).cast("int"))
    counts = {"flagged": k % 3, "not_flagged": k % 7, "unable": k % 2, "progress": k % 11}
    rows = e.select(F.col("user_id").alias("job_id"), k.alias("seq"), status.alias("status"), *[v.alias(c) for c, v in counts.items()])
    base, last = new_path(spark, "admin"), e.agg(F.max("event_id")).first()[0] or 0
    pieces = [rows.where(F.floor(F.col("seq") * PARTS / (last + 1)) == n) for n in range(PARTS)]

    def start():
        return progress.admin_summary(spark.readStream.schema(rows.schema).parquet(f"{base}/in"), 10_000, f"{base}/out", f"{base}/checkpoint")

    _fed(spark, pieces, f"{base}/in", start)
    return progress.summaries(spark, f"{base}/out")


def _hashes(spark: SparkSession, sf_dir: str) -> DataFrame:
    return profile.entries(spark, sf_dir).select("source_id", "content_hash", (F.col("doc_id") % 97).alias("k"))


def manifest_tree(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The Merkle tree of the manifest, two levels deep."""
    return snapshots.tree(_hashes(spark, sf_dir), 2).select("level", "prefix", F.col("entries").cast("long").alias("entries"), "digest")


def manifest_changes(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Ids that were added, removed or changed between two snapshots, by their saved trees."""
    rows, base = _hashes(spark, sf_dir), new_path(spark, "snapshots")
    before = rows.where("k <> 11").select("source_id", "content_hash")
    after = rows.where("k <> 5").select("source_id", F.when(F.col("k") == 23, F.sha2(F.col("content_hash").cast("binary"), 256)).otherwise(F.col("content_hash")).alias("content_hash"))
    levels = snapshots.levels_for(max(before.count(), after.count()))
    trees = [snapshots.save_tree(spark, snapshots.tree(m, levels), f"{base}/{n}") for n, m in (("before", before), ("after", after))]
    return snapshots.changes(before, after, tuple(trees))


def results_by_run(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Results of two runs in one table, a partition a run; the second is written twice, as after a repeat, and read back."""
    rows, base = profile.summary(spark, sf_dir), new_path(spark, "history")
    for run, kept in (("run-1", rows), ("run-2", rows.where("flag_status <> 'unable_to_process'")), ("run-2", rows.where("flag_status = 'flagged'"))):
        sinks.keep(kept, base, run)
    return files.kept(spark, base, "run-2").select("run_id", "source_id", "flag_status", "strongest_band", "n_findings", F.array_join("sensitivity_categories", ",").alias("sensitivity_categories"))


def settings_in_force(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Each event with the setting that is in force for its user: the number in the properties of the last purchase."""
    from ..operators.asof import in_force

    e = profile.table(spark, sf_dir, "events").select("event_id", "user_id", "ts", "event_type", F.get_json_object("props", "$.k").cast("long").alias("k"))
    rows = in_force(e, F.col("event_type") == "purchase", "user_id", "ts", "k", "event_id")
    return rows.select("event_id", "user_id", "event_type", "in_force")


#: Silence that ends a session below, and how late events may be, in hours.
GAP_HOURS, LATE_HOURS = 4, 1


def sessions_stream(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Sessions of users by a stream in three runs, whose pieces overlap by an hour: what comes again counts once. Sessions
    that are over by the last event are told."""
    from ..streaming import sessions

    e = profile.table(spark, sf_dir, "events").select("event_id", F.col("user_id").cast("string").alias("user"), "ts", F.floor(F.col("value") * 100).cast("double").alias("cents"))
    day, base = F.dayofmonth("ts"), new_path(spark, "sessions")
    again = lambda cut: (day == cut - 1) & (F.hour("ts") == 23)
    pieces = [e.where(day < CUTS[0]), e.where((day >= CUTS[0]) & (day < CUTS[1]) | again(CUTS[0])), e.where((day >= CUTS[1]) | again(CUTS[1]))]

    def start():
        stream = sessions.sessions(spark.readStream.schema("event_id long, user string, ts timestamp, cents double").parquet(f"{base}/in"), "user", "ts", "event_id", "cents", f"{GAP_HOURS} hours", f"{LATE_HOURS} hours")
        return stream.writeStream.format("parquet").option("path", f"{base}/out").option("checkpointLocation", f"{base}/checkpoint").trigger(availableNow=True).start()

    _fed(spark, pieces, f"{base}/in", start)
    rows = spark.read.schema(sessions.SESSION).parquet(f"{base}/out")
    return rows.select(F.col("key").cast("long").alias("user_id"), F.unix_micros("began").alias("began"), F.unix_micros("ended").alias("ended"), "rows", F.col("value").cast("long").alias("cents"))


def run_batch_resumed(spark: SparkSession, sf_dir: str) -> DataFrame:
    """A batch over all items that is cancelled after its first slice and resumed; statuses from the ledger that it wrote."""
    _, cfg = _folder(spark, sf_dir)
    ctx, done = runner.build(spark, cfg), []
    size = profile.table(spark, sf_dir, "documents").count() // 3 + 1
    first = runner.run_batch(ctx, cfg.config_version, batch_size=size, on_progress=done.append, should_cancel=lambda: len(done) > 0)
    rest = runner.run_batch(ctx, cfg.config_version, batch_size=size, resume=True, on_progress=done.append)
    rows = rest.rows(spark)
    stages = rows["stage_events"].groupBy("source_id").agg(F.array_join(F.transform(F.array_sort(F.collect_list(F.struct("ordinal", "stage", "outcome"))), lambda e: F.concat(e["stage"], F.lit(":"), e["outcome"])), ",").alias("stages"))
    out = rows["final_status"].join(stages, "source_id", "left")
    return out.select("source_id", "flag_status", "stages", F.lit(first.status).alias("first"), F.lit(rest.status).alias("second"), F.lit(rest.reconcile["reconciled"] and sum(done) == rest.reconcile["input_count"]).alias("whole"))


def _entered_twice(spark: SparkSession, sf_dir: str) -> tuple[DataFrame, DataFrame]:
    """All customers, and all of them entered once more with mistakes: a digit of the name lost, balances missing or a
    cent off, segments missing, another nation."""
    c = profile.table(spark, sf_dir, "customer").select(F.col("c_custkey").alias("id"), F.split_part("c_name", F.lit("#"), F.lit(2)).alias("name"), F.round(F.col("c_acctbal") * 100).cast("long").alias("cents"), F.col("c_nationkey").alias("nation"), F.col("c_mktsegment").alias("segment"))
    k = F.col("id")
    wrong = {
        "name": F.when(k % 4 == 1, F.expr("left(name, length(name) - 1)")).otherwise(F.col("name")),
        "cents": F.when(k % 5 == 2, F.lit(None)).when(k % 5 == 3, F.col("cents") + 1).otherwise(F.col("cents")),
        "nation": F.when(k % 7 == 5, (F.col("nation") + 1) % 25).otherwise(F.col("nation")),
        "segment": F.when(k % 6 != 4, F.col("segment")),
    }
    return c, c.withColumns(wrong)


#: How records of customers are compared and which meet.
CUSTOMERS = Linkage(
    fields={"name": ("l.name = r.name", "levenshtein(l.name, r.name) <= 1"), "cents": ("l.cents = r.cents", "abs(l.cents - r.cents) <= 100"), "nation": ("l.nation = r.nation",), "segment": ("l.segment = r.segment",)},
    rules=(("left(name, 8)", "name"), ("cents",), ("nation", "segment", "floor(cents / 10000)")),
)


def linkage_patterns(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Counts of agreement patterns, by the rules by which the pairs meet, of customers and their second entries."""
    return patterns(*_entered_twice(spark, sf_dir), "id", "id", CUSTOMERS).groupBy("pattern", "rules").agg(F.count("*").alias("pairs"))


def customer_links(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Each customer's second entry, found by linkage, with its rating. The model is fitted, so that SQL has no form."""
    return linked(*_entered_twice(spark, sf_dir), "id", "id", CUSTOMERS)


NAMES = (
    "manifest_scan", "ingest_status", "extract_decode", "line_spans", "ocr_gate", "regex_hits", "regex_hits_by_rule", "mock_model_scores", "banding",
    "calibration_apply", "calibration_ece", "calibration_fit_sigmoid", "calibration_fit_isotonic", "cosine_best", "semantic_route", "routed_model_calls", "similarity_findings", "anchored_matches",
    "findings_union", "strongest_finding", "reason_summary", "item_summary", "reconcile", "stage_events", "run_id", "final_status", "resume_remaining",
    "resume_merge", "retry_selection", "migration_summary", "jobs_by_status", "job_latest_state", "queue_head", "job_list_page", "results_workbook",
    "status_filter", "manifest_page", "mask_identifiers", "mask_identifiers_udf", "redact", "ner_mapping", "location_resolution", "category_band_rollup",
    "stream_available_now", "job_progress_stream", "admin_summary_stream", "settings_in_force", "linkage_patterns", "customer_links", "sessions_stream", "run_batch_resumed", "manifest_tree", "manifest_changes", "results_by_run", "run_documents", "run_findings", "run_folder", "item_pieces", "registry_fold",
)

QUERIES = {name: globals()[name] for name in NAMES}
