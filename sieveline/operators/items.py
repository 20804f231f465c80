"""The stages of the item pipeline as narrow transformations of one row an item: ingest checks, extraction, OCR gate,
recognisers, model assessment, calibration, summary.

A row carries its text only up to the detectors; what is shuffled or written later holds no text. A failure is a value
of ``exception_code``, never an exception, and it empties the item's findings.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from ..config import Detect, OcrGate, Recogniser, Scoring, Semantic
from ..functions import numbers, text
from ..schema import FINDING, FINDINGS, IMAGE_TYPES, SPANS, TEXT_TYPES


def supported(content_type: Column) -> Column:
    return content_type.isin(*TEXT_TYPES, *IMAGE_TYPES)


def is_image(content_type: Column) -> Column:
    return content_type.isin(*IMAGE_TYPES)


def ingest(items: DataFrame) -> DataFrame:
    """Adds exception_code. Needs content_type, content_hash, content (null: none), and optionally read_error.

    Order: an unsupported type, then no content, then an unreadable one, then a hash that differs."""
    failed = F.col("read_error") if "read_error" in items.columns else F.lit(False)
    code = (
        F.when(~supported(F.col("content_type")), "unsupported_type")
        .when(F.col("content").isNull() & ~failed, "not_in_manifest")
        .when(failed, "unreadable")
        .when(F.sha2(F.col("content"), 256) != F.col("content_hash"), "hash_mismatch")
    )
    return items.withColumn("exception_code", text.once(code))


def extract(items: DataFrame) -> DataFrame:
    """Decoding extraction: adds text, has_text_layer, printable_ratio, image_coverage, coverage_complete, ocr_used.

    Images and bytes that are no UTF-8 have no text layer (coverage by images 1); blank texts have none either."""
    decoded = F.when(F.col("exception_code").isNull() & ~is_image(F.col("content_type")), text.decode(F.col("content")))
    rows = items.withColumn("text", text.once(decoded))
    has = F.coalesce(~text.is_blank(F.col("text")), F.lit(False))
    return rows.withColumns({
        "has_text_layer": has,
        "printable_ratio": F.when(F.col("text").isNull(), F.lit(0.0)).otherwise(text.printable_ratio(F.col("text"))),
        "image_coverage": F.when(F.col("text").isNull(), F.lit(1.0)).otherwise(F.lit(0.0)),
        "coverage_complete": F.col("text").isNotNull() & has,
        "ocr_used": F.lit(False),
    })


def needs_ocr(gate: OcrGate) -> Column:
    return (
        ~F.col("has_text_layer")
        | (F.col("printable_ratio") < gate.min_printable_ratio)
        | (F.col("image_coverage") > gate.max_image_coverage)
        | (text.density(F.coalesce(F.col("text"), F.lit(""))) < gate.min_text_density)
    )


def ocr_gate(items: DataFrame, gate: OcrGate = OcrGate(), recognise=None) -> DataFrame:
    """Replaces the text of items that need it by ocr_text; where there is none the item fails. A blank one is accepted.
    ``recognise`` (contents, path -> text, a column) makes the texts of items that need it; without it the rows hold them."""
    alive = F.col("exception_code").isNull()
    rows = items.withColumn("needs_ocr", text.once(alive & needs_ocr(gate)))
    if recognise is not None:
        rows = rows.withColumn("ocr_text", recognise(F.when(F.col("needs_ocr"), F.col("content")), F.col("path")))
    rows = rows.withColumn("exception_code", F.when(F.col("needs_ocr") & F.col("ocr_text").isNull(), "ocr_failure").otherwise(F.col("exception_code")))
    used = F.col("needs_ocr") & F.col("exception_code").isNull()
    blank = text.is_blank(F.col("ocr_text"))
    return rows.withColumns({
        "text": text.once(F.when(used, F.col("ocr_text")).otherwise(F.col("text"))),
        "has_text_layer": F.when(used, ~blank).otherwise(F.col("has_text_layer")),
        "printable_ratio": F.when(used, text.printable_ratio(F.col("ocr_text"))).otherwise(F.col("printable_ratio")),
        "image_coverage": F.when(used, F.lit(0.0)).otherwise(F.col("image_coverage")),
        "coverage_complete": F.when(used, ~blank).otherwise(F.col("coverage_complete")),
        "ocr_used": used,
    })


def finding(**given: Column) -> Column:
    """A finding with the named fields; the others are null."""
    null = F.lit(None)
    fields = ("finding_id", "category", "reason_code", "score_type", "band", "rule_id", "score", "calibration_status", "threshold_version", "detector", "reason", "label", "location")
    return F.struct(*[given.get(k, null).alias(k) for k in fields]).cast(FINDING)


def no_findings() -> Column:
    return F.array().cast(FINDINGS)


# Versions and reason codes that findings carry.
RULES_VERSION, SCREEN_VERSION = "detect-regex-0.1", "semantic-0.1"
MODEL_REASON, SCREEN_REASON, NER_FIXED_REASON, NER_SCORED_REASON = "model_flag", "semantic_route", "presidio_deterministic", "presidio_classifier"


def rule_findings(rules: tuple[Recogniser, ...], detector: str = RULES_VERSION, body: str = "text", spans: str | None = None) -> Column:
    """Deterministic findings of pattern rules, an array: per rule and match, numbered from 0 in the order of the text.
    ``spans`` names a column of anchored spans, whose pages and cells locate the matches; null: offsets do."""
    if not rules:
        return no_findings()
    if spans is not None:
        bounds = text.span_bounds(F.coalesce(F.col(spans), F.array().cast(SPANS)))
        return text.let(bounds, lambda b: _rule_findings(rules, detector, body, lambda begins, ends: text.locations(b, begins, ends)))
    return _rule_findings(rules, detector, body, _offsets)


def _offsets(begins: Column, ends: Column) -> Column:
    return F.transform(F.arrays_zip(begins.alias("s"), ends.alias("e")), lambda p: text.char_location(p["s"], p["e"]))


def _rule_findings(rules: tuple[Recogniser, ...], detector: str, body: str, places) -> Column:
    """``places``: arrays of begins and ends -> an array of locations."""
    def of(rule: Recogniser) -> Column:
        hits = text.matches(F.col(body), rule.pattern)
        if rule.literal:
            hits = F.when(F.col(body).contains(rule.literal), hits).otherwise(F.expr("cast(array() as array<struct<s:int,e:int,m:string>>)"))
        found = lambda at, i: finding(
            finding_id=F.concat(F.lit(rule.rule_id + "-"), i.cast("string")), category=F.lit(rule.category), reason_code=F.lit(rule.reason_code), score_type=F.lit("deterministic_match"),
            band=F.lit("deterministic"), rule_id=F.lit(rule.rule_id), calibration_status=F.lit("not_applicable"), detector=F.lit(detector),
            reason=F.lit(f"rule {rule.rule_id} matched"), label=F.lit(f"{rule.category}:{rule.rule_id}"), location=at,
        )
        return text.let(hits, lambda h: F.transform(places(F.transform(h, lambda m: m["s"]), F.transform(h, lambda m: m["e"])), found))

    return F.flatten(F.array(*[of(r) for r in rules]))


def mock_score(span: Column, hint: str) -> Column:
    return F.when(F.lower(span).contains(hint.lower()), F.lit(90.0)).otherwise(F.lit(5.0))


#: Characters of a text that a model is shown.
SPAN_CHARS = 512


def model_span(body: str = "text") -> Column:
    """What a model is shown of a text; null if it is blank and nothing is sent."""
    return F.when(~F.coalesce(text.is_blank(F.col(body)), F.lit(True)), F.substring(F.col(body), 1, SPAN_CHARS))


def scored_findings(scores: Column, shown: Column, scoring: Scoring, version: str) -> Column:
    """Findings of a model's scores (array of category, score) that reach the threshold; ``shown``: the length of the span."""
    return F.transform(
        F.filter(scores, lambda x: x["score"] >= scoring.flag_threshold),
        lambda x: finding(
            finding_id=F.concat(F.lit("model-"), x["category"]), category=x["category"], reason_code=F.lit(MODEL_REASON), score_type=F.lit("model_score"), score=x["score"],
            calibration_status=F.lit("not_calibrated"), detector=F.lit(version),
            reason=F.concat(F.lit("model score "), text.whole(x["score"]), F.lit(" >= flag threshold")), location=text.char_location(F.lit(0), shown),
        ),
    )


def model_findings(categories: tuple[str, ...], hints: dict[str, str], scoring: Scoring, routed: Column | None = None, body: str = "text", version: str = "mock-0") -> Column:
    """Findings of the built-in mock provider on the first 512 characters; a blank text is not sent. ``routed`` (an array
    of categories) limits the calls, and names those beyond ``categories``."""
    span = model_span(body)
    every = tuple(dict.fromkeys((*categories, *hints))) if routed is not None else categories
    if not every:
        return no_findings()
    scored = F.array(*[F.struct(F.lit(c).alias("category"), (mock_score(span, hints[c]) if c in hints else F.lit(5.0)).alias("score")) for c in every])
    if routed is not None:
        scored = F.filter(scored, lambda x: F.array_contains(routed, x["category"]))
    return F.when(span.isNull(), no_findings()).otherwise(scored_findings(scored, F.length(span), scoring, version))


def apply_calibration(findings: Column, scoring: Scoring, maps: Column | None = None) -> Column:
    """Calibrates scored findings, then bands them; other findings pass through. ``maps``: map from category to a struct
    (status, method, a, b, x, y); a category without one, or not calibrated, keeps its raw score."""
    def finish(f: Column) -> Column:
        if maps is None:
            score, status = f["score"], F.lit("not_calibrated")
        else:
            m = F.try_element_at(maps, f["category"])
            on = F.coalesce(m["status"].isin("calibrated", "provisional"), F.lit(False))
            score = F.when(on, numbers.calibrated(f["score"], m["method"], m["a"], m["b"], m["x"], m["y"])).otherwise(f["score"])
            status = F.coalesce(m["status"], F.lit("not_calibrated"))
        label = F.concat(f["category"], F.lit(":"), f["score_type"], F.lit("("), text.whole(score), F.lit(")"))
        done = f.withField("score", score).withField("calibration_status", status).withField("band", numbers.band(score, scoring.band_medium, scoring.band_high)).withField("label", label)
        return F.when(f["score_type"].isin("model_score", "classifier_score"), done).otherwise(f)

    return F.transform(findings, finish)


SUMMARY = (
    "source_id", "content_type", "flag_status", "processing_status", "sensitivity_categories", "strongest_band", "strongest_score_type", "strongest_score",
    "calibration_status", "n_findings", "reason_summary", "exception_code", "author", "datetime", "linked_executive", "linked_project",
)


def summarise(items: DataFrame, *also: str) -> DataFrame:
    """Exactly one row an item, from the array ``findings``; without a shuffle. ``also``: further columns to keep."""
    failed = F.col("exception_code").isNotNull()
    drive = F.filter("findings", lambda f: f["score_type"] != "similarity")
    rows = items.withColumn("_drive", text.once(F.when(failed, no_findings()).otherwise(drive)))
    d = F.col("_drive")
    any_ = F.size(d) > 0
    fixed = F.exists(d, lambda f: f["score_type"] == "deterministic_match")
    ordered = F.array_sort(F.transform(d, lambda f: F.struct(f["category"].alias("c"), f["finding_id"].alias("i"), f["label"].alias("l"))))
    reasons = F.array_join(F.transform(ordered, lambda x: x["l"]), "; ")
    # strongest: greatest score (none counts as 0), then category, then id
    ranked = F.array_sort(F.transform(d, lambda f: F.struct((-F.coalesce(f["score"], F.lit(0.0))).alias("s"), f["category"].alias("c"), f["finding_id"].alias("i"), f.alias("f"))))
    top = F.try_element_at(ranked, F.lit(1))["f"]
    return rows.withColumns({
        "flag_status": F.when(any_, "flagged").when(failed, "unable_to_process").otherwise("not_flagged"),
        "processing_status": F.when(~failed & F.col("coverage_complete"), "complete").otherwise("partial"),
        "sensitivity_categories": F.sort_array(F.array_distinct(F.transform(d, lambda f: f["category"]))),
        "strongest_band": F.when(fixed, "deterministic").otherwise(top["band"]),
        "strongest_score_type": F.when(fixed, "deterministic_match").otherwise(top["score_type"]),
        "strongest_score": F.when(fixed, F.lit(None)).otherwise(top["score"]),
        "calibration_status": F.when(fixed | ~any_, "not_applicable").otherwise(top["calibration_status"]),
        "n_findings": F.when(failed, F.lit(0)).otherwise(F.size("findings")).cast("long"),
        "reason_summary": F.when(any_, reasons).when(failed, F.concat(F.lit("unable to process ("), F.col("exception_code"), F.lit(")"))).otherwise("no finding above threshold"),
    }).select(*SUMMARY, *also)


def findings_rows(items: DataFrame) -> DataFrame:
    """The findings as rows, with their evidence location; items that failed have none."""
    return items.where("exception_code is null").select("source_id", F.explode("findings").alias("f")).select("source_id", "f.*")


def events(items: DataFrame, engine: str = "decode") -> DataFrame:
    """The event log, derived: extract, ocr_gate (not where it failed), pipeline(failed). Items that failed at ingest or
    extraction have only the last. ``failed_in_extract`` marks extraction's unexpected failures, where rows have it."""
    none = F.lit(None)
    early = F.col("exception_code").isin("unsupported_type", "not_in_manifest", "unreadable", "hash_mismatch", "extraction_error")
    if "failed_in_extract" in items.columns:
        early = early | F.col("failed_in_extract")
    reached = F.coalesce(~early, F.lit(True))
    extract_ = F.when(reached, F.struct(F.lit("extract").alias("stage"), F.lit(engine).alias("outcome"), none.cast("string").alias("exception_code"), none.cast("map<string,double>").alias("detail")))
    detail = F.create_map(F.lit("printable_ratio"), F.col("printable_ratio"), F.lit("image_coverage"), F.col("image_coverage"))
    gate = F.when(
        reached & F.coalesce(F.col("exception_code") != "ocr_failure", F.lit(True)),
        F.struct(F.lit("ocr_gate").alias("stage"), F.when(F.col("ocr_used"), "ocr").otherwise("skipped").alias("outcome"), none.cast("string").alias("exception_code"), detail.alias("detail")),
    )
    failed = F.when(
        F.col("exception_code").isNotNull(),
        F.struct(F.lit("pipeline").alias("stage"), F.lit("failed").alias("outcome"), F.col("exception_code").alias("exception_code"), none.cast("map<string,double>").alias("detail")),
    )
    rows = items.select("source_id", F.posexplode(F.array(extract_, gate, failed)).alias("ordinal", "e")).where("e is not null")
    return rows.select("source_id", "ordinal", "e.*")


def semantic_findings(scores: DataFrame, semantic: Semantic) -> DataFrame:
    """(source_id, category, cosine, optionally n_chars) -> similarity findings of the pairs that reach the threshold."""
    hit = scores.where(F.col("cosine") >= semantic.route_threshold)
    shown = F.col("n_chars") if "n_chars" in scores.columns else F.lit(None)
    return hit.select("source_id", similarity_finding(F.col("category"), F.col("cosine"), shown, semantic).alias("f")).select("source_id", "f.*")


def similarity_finding(category: Column, cosine: Column, n_chars: Column, semantic: Semantic) -> Column:
    """A routing signal: no band, not calibrated by definition; its evidence is the whole text."""
    return finding(
        finding_id=F.concat(F.lit("semantic-"), category), category=category, reason_code=F.lit(SCREEN_REASON), score_type=F.lit("similarity"), score=cosine,
        calibration_status=F.lit("not_applicable"), threshold_version=F.lit(semantic.threshold_version), detector=F.lit(SCREEN_VERSION),
        reason=F.concat(F.lit("cosine "), F.format_number(F.bround(cosine, 2), 2), F.lit(" >= route threshold")), location=text.char_location(F.lit(0), n_chars),
    )


def screened(vector: Column, examples: dict[str, list[list[float]]], semantic: Semantic, n_chars: Column) -> Column:
    """Similarity findings of a text's vector (null: none), an array in the order of categories: the greatest cosine with
    a category's examples counts. The examples are configuration, so they are literals."""
    null = F.array().cast(FINDINGS)
    if not examples:
        return null
    unit = lambda w: F.array(*[F.lit(float(x)) for x in w])
    best = F.array(*[F.struct(F.lit(c).alias("c"), F.greatest(*[numbers.cosine(vector, unit(w)) for w in ws], F.lit(-1.0)).alias("s")) for c, ws in sorted(examples.items()) if ws])
    hits = F.filter(best, lambda x: x["s"] >= semantic.route_threshold)
    return F.coalesce(F.when(vector.isNotNull(), F.transform(hits, lambda x: similarity_finding(x["c"], x["s"], n_chars, semantic))), null)


def ner_findings(results: Column, detect: Detect, spans: Column | None = None) -> Column:
    """Findings of an analyser's results (array of entity_type, start, end, score). Entities without a category are
    dropped but count for the numbering; deterministic ones have no score, others their confidence times 100."""
    categories = F.create_map(*[F.lit(x) for kv in sorted(detect.category_map.items()) for x in kv]) if detect.category_map else F.create_map().cast("map<string,string>")
    fixed = lambda r: r["entity_type"].isin(*detect.deterministic_entities) if detect.deterministic_entities else F.lit(False)

    def one(r: Column, i: Column, at: Column) -> Column:
        det, category = fixed(r), F.try_element_at(categories, r["entity_type"])
        return finding(
            finding_id=F.concat(r["entity_type"], F.lit("-"), i.cast("string")), category=category, reason_code=F.when(det, NER_FIXED_REASON).otherwise(NER_SCORED_REASON),
            score_type=F.when(det, "deterministic_match").otherwise("classifier_score"), band=F.when(det, "deterministic"),
            rule_id=r["entity_type"], score=F.when(~det, r["score"] * 100), calibration_status=F.when(det, "not_applicable").otherwise("not_calibrated"),
            detector=F.lit(detect.detector_version),
            reason=F.when(det, F.concat(F.lit("validated entity "), r["entity_type"])).otherwise(F.concat(F.lit("recogniser "), r["entity_type"], F.lit(" matched"))),
            label=F.concat(category, F.lit(":"), r["entity_type"]), location=at,
        )

    def of(places) -> Column:
        def located(rs: Column) -> Column:
            at = places(F.transform(rs, lambda r: r["start"]), F.transform(rs, lambda r: r["end"]))
            return F.filter(F.transform(F.arrays_zip(rs.alias("r"), at.alias("at")), lambda z, i: one(z["r"], i, z["at"])), lambda f: f["category"].isNotNull())

        return text.let(results, located)

    if spans is None:
        return of(_offsets)
    return text.let(text.span_bounds(spans), lambda b: of(lambda begins, ends: text.locations(b, begins, ends)))
