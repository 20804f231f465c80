"""The catalogue's queries as DuckDB SQL over the same tables."""

from __future__ import annotations

from .profile import CONFIG_VERSION, HINTS, RULES, SEED, TAXONOMY
from .queries import ANCHORED, CUTS, DENSE, EXAMPLES, GAP_HOURS, LATE_HOURS, PARTS, PIECE, PUBLIC_KEY, SEMANTIC, SILENCE_HOURS, SLICES

SPACE = r"[\s\x0b\x1c-\x1f\x85\p{Z}]"


def _q(s: str) -> str:
    return "'" + s.replace("'", "''") + "'"


def _gate(min_density: float) -> str:
    return f"""
items AS (
  SELECT doc_id, printf('doc_%06d', doc_id) AS source_id, doc_id % 50 AS m,
    CASE doc_id % 50 WHEN 0 THEN 'application/octet-stream' WHEN 1 THEN 'image/png' WHEN 2 THEN 'image/jpeg' WHEN 3 THEN 'application/pdf' WHEN 4 THEN 'text/markdown' ELSE 'text/plain' END AS content_type,
    CASE WHEN doc_id % 50 = 7 THEN sha256(text || '#') ELSE sha256(text) END AS content_hash,
    'analyst-' || (doc_id % 5) AS author, '2026-01-01T00:00:00Z' AS datetime, lang AS linked_executive, source AS linked_project,
    CASE WHEN doc_id % 50 <> 9 THEN text END AS content, s.ocr_text
  FROM documents LEFT JOIN (SELECT item_id, min(text) AS ocr_text FROM benchmark WHERE item_id BETWEEN 0 AND 63 GROUP BY item_id) s ON s.item_id = doc_id % 64 AND doc_id % 50 IN (1, 2)),
ing AS (SELECT *, CASE WHEN m = 0 THEN 'unsupported_type' WHEN content IS NULL THEN 'not_in_manifest' WHEN sha256(content) <> content_hash THEN 'hash_mismatch' END AS code0 FROM items),
ext AS (SELECT *, CASE WHEN code0 IS NULL AND m NOT IN (1, 2) THEN content END AS t0 FROM ing),
ex2 AS (SELECT *, coalesce(length(regexp_replace(t0, '{SPACE}', '', 'g')) > 0, false) AS has0,
  CASE WHEN coalesce(length(t0), 0) = 0 THEN 0.0::DOUBLE ELSE (length(t0) - length(regexp_replace(t0, '[^\\p{{C}}\\p{{Z}}]|[ \\n\\t]', '', 'g')))::DOUBLE / length(t0) END AS ratio0,
  CASE WHEN coalesce(length(t0), 0) = 0 THEN 0.0::DOUBLE ELSE length(regexp_replace(t0, '{SPACE}', '', 'g'))::DOUBLE / length(t0) END AS dens0,
  CASE WHEN t0 IS NULL THEN 1.0::DOUBLE ELSE 0.0::DOUBLE END AS cov0 FROM ext),
gat AS (SELECT *, code0 IS NULL AND (NOT has0 OR ratio0 < 0.85 OR cov0 > 0.5 OR dens0 < {min_density}) AS needs FROM ex2),
fin AS (SELECT *, CASE WHEN needs AND ocr_text IS NULL THEN 'ocr_failure' ELSE code0 END AS code FROM gat),
itm AS (SELECT *, needs AND code IS NULL AS used, CASE WHEN needs AND code IS NULL THEN ocr_text ELSE t0 END AS body,
  CASE WHEN needs AND code IS NULL THEN length(regexp_replace(ocr_text, '{SPACE}', '', 'g')) > 0 ELSE t0 IS NOT NULL AND has0 END AS complete FROM fin)"""


def _hits(source: str, key: str, body: str) -> str:
    one = []
    for r in RULES:
        p = _q(r.pattern)
        one.append(f"SELECT {key} AS k, {_q(r.rule_id)} AS rule_id, {_q(r.category)} AS category, regexp_extract_all({body}, {p}) AS hits, string_split_regex({body}, {p}) AS gaps FROM {source}")
    return f"""
raw AS ({" UNION ALL ".join(one)}),
pos AS (SELECT k, rule_id, category, unnest(range(len(hits))) AS i, hits, gaps FROM raw WHERE len(hits) > 0),
hit AS (SELECT k, rule_id, category, i, rule_id || '-' || i AS finding_id,
  (list_sum(list_transform(gaps[1:i + 1], lambda x: length(x))) + coalesce(list_sum(list_transform(hits[1:i], lambda x: length(x))), 0))::BIGINT AS char_start, length(hits[i + 1]) AS n FROM pos)"""


def _model(source: str, key: str, body: str) -> str:
    cats = ", ".join(f"({_q(c)}, {_q(HINTS[c])})" for c in TAXONOMY.categories if c in HINTS)
    return f"""
mod AS (SELECT {key} AS k, category, 'model-' || category AS finding_id, least(length({body}), 512)::BIGINT AS char_end
  FROM {source}, (VALUES {cats}) AS h(category, hint) WHERE contains(lower(substr({body}, 1, 512)), hint) AND length(regexp_replace({body}, '{SPACE}', '', 'g')) > 0)"""


ITEMS = "WITH" + _gate(0.15)
LIVE = "(SELECT * FROM itm WHERE code IS NULL)"
FOUND = ITEMS + "," + _hits(LIVE, "source_id", "body") + "," + _model(LIVE, "source_id", "body") + """,
fnd AS (
  SELECT k AS source_id, finding_id, category, 'deterministic_match' AS score_type, 'deterministic' AS band, NULL::DOUBLE AS score, 'not_applicable' AS cal, category || ':' || rule_id AS label, char_start, char_start + n AS char_end FROM hit
  UNION ALL SELECT k, finding_id, category, 'model_score', 'high', 90.0::DOUBLE, 'not_calibrated', category || ':model_score(90)', 0, char_end FROM mod),
agg AS (SELECT source_id, count(*) AS n, bool_or(score_type = 'deterministic_match') AS det, string_agg(label, '; ' ORDER BY category, finding_id) AS reasons, array_to_string(list_sort(list_distinct(list(category))), ',') AS cats FROM fnd GROUP BY source_id),
sm AS (SELECT itm.source_id, content_type, CASE WHEN n > 0 THEN 'flagged' WHEN code IS NOT NULL THEN 'unable_to_process' ELSE 'not_flagged' END AS flag_status,
  CASE WHEN code IS NULL AND complete THEN 'complete' ELSE 'partial' END AS processing_status, coalesce(cats, '') AS sensitivity_categories,
  CASE WHEN det THEN 'deterministic' WHEN n > 0 THEN 'high' END AS strongest_band, CASE WHEN det THEN 'deterministic_match' WHEN n > 0 THEN 'model_score' END AS strongest_score_type,
  CASE WHEN n > 0 AND NOT det THEN 90.0::DOUBLE END AS strongest_score, CASE WHEN n > 0 AND NOT det THEN 'not_calibrated' ELSE 'not_applicable' END AS calibration_status,
  coalesce(n, 0)::BIGINT AS n_findings, CASE WHEN n > 0 THEN reasons WHEN code IS NOT NULL THEN 'unable to process (' || code || ')' ELSE 'no finding above threshold' END AS reason_summary,
  code AS exception_code, author, datetime, linked_executive, linked_project FROM itm LEFT JOIN agg USING (source_id))
"""
EVIDENCE = "'chars ' || char_start || '–' || char_end"

LABELLED = "WITH lab AS (SELECT d.doc_id, lang AS category, CASE WHEN d.doc_id % 2 = 0 THEN 'dev' ELSE 'holdout' END AS split, least(100.0::DOUBLE, n_chars / 50.0::DOUBLE) AS score, quality AS label FROM documents d JOIN labels USING (doc_id))"
BAND = "CASE WHEN {0} >= 80 THEN 'high' WHEN {0} >= 60 THEN 'medium' ELSE 'low' END"

COSINES = f"""WITH e AS (SELECT vec_id, embedding::DOUBLE[] AS v, label, sqrt(list_dot_product(embedding::DOUBLE[], embedding::DOUBLE[])) AS norm FROM embeddings),
x AS (SELECT * FROM e WHERE label IS NOT NULL QUALIFY row_number() OVER (PARTITION BY label ORDER BY vec_id) <= {EXAMPLES}),
c AS (SELECT e.vec_id AS source_id, 'label-' || x.label AS category, round(max(CASE WHEN e.norm * x.norm = 0 THEN 0 ELSE list_dot_product(e.v, x.v) / (e.norm * x.norm) END), 6) AS cosine FROM e, x GROUP BY ALL)"""

JOBS = """WITH ln AS (SELECT l_orderkey, count(*) FILTER (l_returnflag = 'R') AS flagged, count(*) FILTER (l_returnflag = 'N') AS not_flagged, count(*) FILTER (l_returnflag = 'A') AS unable FROM lineitem GROUP BY l_orderkey),
jobs AS (SELECT o_orderkey AS job_id, CASE o_orderstatus WHEN 'F' THEN 'completed' WHEN 'O' THEN 'queued' ELSE 'running' END AS status, o_orderdate AS created_at, coalesce(flagged, 0) AS flagged, coalesce(not_flagged, 0) AS not_flagged, coalesce(unable, 0) AS unable FROM orders LEFT JOIN ln ON l_orderkey = o_orderkey)"""

_key = PUBLIC_KEY.encode().ljust(64, b"\0")
_INNER, _OUTER = bytes(b ^ 0x36 for b in _key).hex(), bytes(b ^ 0x5C for b in _key).hex()
MAIL = _q(RULES[1].pattern)

#: Linear between knots kx, ky at x.
_INTERPOLATED = """CASE WHEN kx IS NULL THEN x WHEN x <= kx[1] THEN ky[1] WHEN x >= kx[-1] THEN ky[-1]
  ELSE ky[lf] + (ky[lf + 1] - ky[lf]) * (x - kx[lf]) / (kx[lf + 1] - kx[lf]) END"""


def _status(mapped: str, shown: str) -> str:
    """Fits f with their holdout error by ten bins, and the status."""
    left = "len(list_filter(kx, lambda v: v <= x))" if "lf" in mapped else "0"
    return f"""h AS (SELECT *, {left} AS lf FROM (SELECT f.*, greatest(0.0, least(1.0, score / 100.0::DOUBLE)) AS x, label FROM lab JOIN f ON f.category = lab.category WHERE split = 'holdout')),
hp AS (SELECT category, label, {mapped} AS p FROM h),
hb AS (SELECT category, count(*) AS n, avg(p) AS p, avg(label::DOUBLE) AS y FROM hp GROUP BY category, least(9, floor(p * 10))),
he AS (SELECT category, sum(n * abs(p - y)) / sum(n) * 100 AS error FROM hb GROUP BY category)
SELECT f.category, CASE WHEN positives = 0 THEN 'not_calibrated' WHEN positives >= 100 AND coalesce(error, 100.0) <= 5.0 THEN 'calibrated' ELSE 'provisional' END AS status, method, {shown}, positives, round(coalesce(error, 100.0), 5) AS error
FROM f LEFT JOIN he ON he.category = f.category"""


SQL: dict[str, str] = {
    "manifest_scan": ITEMS + "SELECT source_id, content_type, author, datetime, linked_executive, linked_project FROM items",
    "manifest_page": ITEMS + "SELECT source_id, content_type, author, datetime, linked_executive, linked_project FROM items ORDER BY source_id LIMIT 100 OFFSET 100",
    "ingest_status": ITEMS + "SELECT source_id, content_type, sha256(content) AS actual_hash, code0 AS exception_code FROM ing",
    "extract_decode": ITEMS + "SELECT source_id, has0 AS has_text_layer, length(t0)::BIGINT AS n_chars, round(ratio0, 6) AS printable_ratio, round(dens0, 6) AS density, cov0 AS image_coverage, t0 IS NOT NULL AND has0 AS coverage_complete FROM ex2 WHERE code0 IS NULL",
    "line_spans": r"""
WITH p AS (SELECT doc_id, unnest(string_split_regex(text, '\r\n|[\n\r\x0b\x0c\x1c-\x1e\x{85}\x{2028}\x{2029}]')) AS part, unnest(list_append(regexp_extract_all(text, '\r\n|[\n\r\x0b\x0c\x1c-\x1e\x{85}\x{2028}\x{2029}]'), '')) AS sep,
  generate_subscripts(string_split_regex(text, '\r\n|[\n\r\x0b\x0c\x1c-\x1e\x{85}\x{2028}\x{2029}]'), 1) AS i FROM documents),
s AS (SELECT *, part || regexp_replace(sep, '\n$', '') AS line, coalesce(sum(length(part) + length(sep)) OVER (PARTITION BY doc_id ORDER BY i ROWS BETWEEN UNBOUNDED PRECEDING AND 1 PRECEDING), 0) AS off FROM p)
SELECT doc_id, (row_number() OVER (PARTITION BY doc_id ORDER BY i) - 1)::BIGINT AS span, off::BIGINT AS char_start, (off + length(line))::BIGINT AS char_end, sha256(line) AS span_sha256 FROM s WHERE length(line) > 0""",
    "ocr_gate": "WITH" + _gate(DENSE.min_text_density) + "SELECT source_id, needs AS needs_ocr, used AS ocr_used, code AS exception_code, complete AS coverage_complete, length(body)::BIGINT AS n_chars FROM itm",
    "regex_hits": "WITH" + _hits("documents", "printf('doc_%06d', doc_id)", "text") + "SELECT k AS source_id, finding_id, category, rule_id, 'rule ' || rule_id || ' matched' AS reason, char_start, (char_start + n)::BIGINT AS char_end FROM hit",
    "regex_hits_by_rule": "WITH" + _hits("documents", "doc_id", "text") + "SELECT rule_id, count(*) AS hits, count(DISTINCT k) AS documents FROM hit GROUP BY rule_id",
    "mock_model_scores": "WITH" + _model("documents", "doc_id", "text") + "SELECT k AS doc_id, finding_id, category, 90.0::DOUBLE AS score, 'model score 90 >= flag threshold' AS reason, char_end FROM mod",
    "banding": LABELLED + f"SELECT doc_id, round(score, 6) AS score, {BAND.format('score')} AS band FROM lab",
    "calibration_apply": LABELLED + f""", s AS (SELECT *, greatest(0.0, least(1.0, score / 100.0::DOUBLE))::DOUBLE AS s FROM lab),
o AS (SELECT doc_id, category, CASE category WHEN 'en' THEN 'calibrated' WHEN 'de' THEN 'calibrated' WHEN 'fr' THEN 'provisional' ELSE 'not_calibrated' END AS calibration_status,
  round(CASE category WHEN 'en' THEN 100.0::DOUBLE / (1.0::DOUBLE + exp(-4.0::DOUBLE * s + 1.5::DOUBLE)) WHEN 'de' THEN s * 100.0::DOUBLE
    WHEN 'fr' THEN 100.0::DOUBLE * CASE WHEN s < 0.1 THEN 0.05::DOUBLE WHEN s < 0.4 THEN 0.05::DOUBLE + 0.25::DOUBLE * (s - 0.1::DOUBLE) / 0.3::DOUBLE WHEN s < 0.9 THEN 0.5::DOUBLE + 0.3::DOUBLE * (s - 0.4::DOUBLE) / 0.5::DOUBLE ELSE 0.8::DOUBLE END
    ELSE score END, 6) AS score FROM s)
SELECT *, {BAND.format('score')} AS band FROM o""",
    "calibration_ece": LABELLED + """, b AS (SELECT category, least(9, floor(score / 100.0::DOUBLE * 10)) AS bin, count(*) AS n, avg(score / 100.0::DOUBLE) AS p, avg(label::DOUBLE) AS y FROM lab WHERE split = 'holdout' GROUP BY ALL),
e AS (SELECT category, sum(n * abs(p - y)) / sum(n) * 100 AS error FROM b GROUP BY category),
c AS (SELECT category, count(*) FILTER (split = 'dev' AND label = 1) AS positives FROM lab GROUP BY category)
SELECT c.category, positives, round(coalesce(error, 100.0), 6) AS error, CASE WHEN positives = 0 THEN 'not_calibrated' WHEN positives >= 100 AND coalesce(error, 100.0) <= 5.0 THEN 'calibrated' ELSE 'provisional' END AS status FROM c LEFT JOIN e USING (category)""",
    "cosine_best": COSINES + "SELECT * FROM c",
    "semantic_route": COSINES + f"SELECT source_id, string_agg(category, ',' ORDER BY category) AS routed, count(*) AS n_findings, max(cosine) AS best FROM c WHERE cosine >= {SEMANTIC.route_threshold} GROUP BY source_id",
    "similarity_findings": COSINES + f"""SELECT source_id, 'semantic-' || category AS finding_id, category, 'semantic_route' AS reason_code, 'similarity' AS score_type, NULL::VARCHAR AS band, cosine AS score, 'not_applicable' AS calibration_status,
  'sem-0' AS threshold_version, 'semantic-0.1' AS detector, 'cosine ' || printf('%.2f', round_even(cosine, 2)) || ' >= route threshold' AS reason, '—' AS evidence FROM c WHERE cosine >= {SEMANTIC.route_threshold}""",
    "anchored_matches": "WITH p AS (" + " UNION ALL ".join(f"SELECT page_id, '{r.rule_id}' AS rule_id, regexp_extract_all(html, {_q(r.pattern)}) AS hits, string_split_regex(html, {_q(r.pattern)}) AS gaps FROM pages" for r in ANCHORED) + """),
h AS (SELECT page_id, rule_id, unnest(range(len(hits))) AS i, gaps FROM p),
l AS (SELECT page_id, rule_id, i, array_to_string(gaps[1:i + 1], '') AS before FROM h)
SELECT page_id, rule_id || '-' || i AS finding_id, rule_id, (1 + length(before) - length(replace(before, chr(10), '')))::BIGINT AS page, 'p' || (1 + length(before) - length(replace(before, chr(10), ''))) AS evidence FROM l""",
    "routed_model_calls": COSINES + f"SELECT category, count(*) AS calls FROM c WHERE cosine >= {SEMANTIC.route_threshold} GROUP BY category",
    "findings_union": FOUND + f"SELECT source_id, finding_id, category, score_type, band, score, cal AS calibration_status, {EVIDENCE} AS evidence FROM fnd",
    "strongest_finding": FOUND + "SELECT source_id, strongest_band, strongest_score_type, strongest_score, calibration_status FROM sm WHERE flag_status = 'flagged'",
    "reason_summary": FOUND + "SELECT source_id, reason_summary FROM sm",
    "item_summary": FOUND + "SELECT * FROM sm",
    "reconcile": FOUND + "SELECT count(*) AS input_count, count(*) FILTER (flag_status = 'flagged') AS flagged, count(*) FILTER (flag_status = 'not_flagged') AS not_flagged, count(*) FILTER (flag_status = 'unable_to_process') AS unable_to_process, count(*) = count(DISTINCT source_id) AS one_row_per_input, count(*) = count(flag_status) AS reconciled FROM sm",
    "stage_events": ITEMS + """SELECT source_id, 0::BIGINT AS ordinal, 'extract' AS stage, 'decode' AS outcome, NULL AS exception_code FROM itm WHERE code0 IS NULL
UNION ALL SELECT source_id, 1, 'ocr_gate', CASE WHEN used THEN 'ocr' ELSE 'skipped' END, NULL FROM itm WHERE code0 IS NULL AND code IS DISTINCT FROM 'ocr_failure'
UNION ALL SELECT source_id, 2, 'pipeline', 'failed', code FROM itm WHERE code IS NOT NULL""",
    "run_id": ITEMS + f"SELECT substr(sha256(string_agg(source_id || content_hash, '' ORDER BY source_id, content_hash) || '{CONFIG_VERSION}{SEED}'), 1, 12) AS run_id FROM items",
    "final_status": FOUND + "SELECT source_id, flag_status FROM sm",
    "resume_remaining": "SELECT printf('doc_%06d', doc_id) AS source_id FROM documents WHERE doc_id % 3 <> 0",
    "resume_merge": "SELECT printf('doc_%06d', doc_id) AS source_id, CASE WHEN doc_id % 3 = 0 THEN 'resumed' ELSE 'fresh' END AS origin FROM documents",
    "retry_selection": FOUND + "SELECT source_id FROM sm WHERE flag_status = 'unable_to_process'",
    "migration_summary": JOBS + """, s AS (SELECT coalesce(sum(flagged) FILTER (status = 'completed'), 0) AS flagged, coalesce(sum(not_flagged) FILTER (status = 'completed'), 0) AS not_flagged, coalesce(sum(unable) FILTER (status = 'completed'), 0) AS unable, coalesce(sum(flagged + unable) FILTER (status <> 'completed'), 0) AS in_progress, count(*) AS jobs_total FROM jobs)
SELECT 1000000::BIGINT AS authorised, (flagged + not_flagged + unable)::BIGINT AS processed, flagged::BIGINT AS flagged, not_flagged::BIGINT AS not_flagged, unable::BIGINT AS unable, in_progress::BIGINT AS in_progress, greatest(0, 1000000 - (flagged + not_flagged + unable) - in_progress)::BIGINT AS remaining, least(100.0::DOUBLE, round_even((flagged + not_flagged + unable) * 100.0::DOUBLE / 1000000.0::DOUBLE, 1)) AS percent, jobs_total FROM s""",
    "jobs_by_status": JOBS + "SELECT status, count(*) AS jobs FROM jobs GROUP BY status",
    "job_latest_state": "SELECT user_id AS job_id, event_id, event_type AS status, round(value, 6) AS value FROM events QUALIFY row_number() OVER (PARTITION BY user_id ORDER BY ts DESC, event_id DESC) = 1",
    "queue_head": JOBS + "SELECT job_id, status FROM jobs WHERE status = 'queued' ORDER BY created_at, job_id LIMIT 1",
    "job_list_page": JOBS + "SELECT job_id, status FROM jobs ORDER BY created_at DESC, job_id LIMIT 50",
    "results_workbook": FOUND + f", w AS (SELECT source_id, string_agg(finding_id || '|' || category || '|' || score_type || '|false|' || {EVIDENCE}, '; ' ORDER BY finding_id, category) AS findings FROM fnd GROUP BY source_id) SELECT source_id, flag_status, coalesce(findings, '') AS findings FROM sm LEFT JOIN w USING (source_id)",
    "status_filter": FOUND + "SELECT source_id, flag_status, processing_status FROM sm WHERE flag_status = 'flagged'",
    "mask_identifiers": f"""
WITH p AS (SELECT doc_id, text, string_split_regex(text, {MAIL}) AS gaps, regexp_extract_all(text, {MAIL}) AS hits FROM documents),
g AS (SELECT doc_id, generate_subscripts(gaps, 1) AS i, unnest(gaps) AS gap, unnest(list_append(hits, NULL)) AS hit FROM p),
h AS (SELECT *, CASE WHEN hit IS NULL THEN '' ELSE '<email:' || substr(sha256(unhex('{_OUTER}') || unhex(sha256(unhex('{_INNER}') || encode(hit)))), 1, 16) || '>' END AS mark FROM g),
o AS (SELECT doc_id, string_agg(gap || mark, '' ORDER BY i) AS masked FROM h GROUP BY doc_id)
SELECT doc_id, sha256(masked) AS masked_sha256, length(masked)::BIGINT AS n_chars FROM o""",
    "redact": "SELECT doc_id, '<redacted:' || length(text) || ' chars>' AS redacted, 'item=' || printf('doc_%06d', doc_id) || ' stage=extract outcome=decode' AS line FROM documents",
    "location_resolution": """
WITH p AS (SELECT page_id, length(html) // 2 AS mid, unnest(string_split(html, chr(10))) AS line, generate_subscripts(string_split(html, chr(10)), 1) AS page FROM pages),
b AS (SELECT *, coalesce(sum(length(line) + 1) OVER (PARTITION BY page_id ORDER BY page ROWS BETWEEN UNBOUNDED PRECEDING AND 1 PRECEDING), 0) AS lo FROM p)
SELECT page_id, mid::BIGINT AS char_start, CASE WHEN mid < lo + length(line) THEN page END::BIGINT AS page, CASE WHEN mid < lo + length(line) THEN 'p' || page ELSE 'chars ' || mid || '–' || (mid + 1) END AS evidence FROM b WHERE lo <= mid AND mid < lo + length(line) + 1""",
    "run_documents": FOUND + "SELECT sm.*, 'sample:documents' AS snapshot_id, itm.content_hash, 'bench' AS run_id, 'bench-0' AS config_version FROM sm JOIN itm USING (source_id)",
    "run_findings": FOUND + f"""SELECT source_id, finding_id, category, CASE score_type WHEN 'model_score' THEN 'model_flag' ELSE category || '_ref' END AS reason_code, score_type, band, CASE score_type WHEN 'model_score' THEN NULL ELSE split_part(label, ':', 2) END AS rule_id,
  score, cal AS calibration_status, NULL::VARCHAR AS threshold_version, CASE score_type WHEN 'model_score' THEN 'mock-0' ELSE 'detect-regex-0.1' END AS detector,
  CASE score_type WHEN 'model_score' THEN 'model score 90 >= flag threshold' ELSE 'rule ' || split_part(label, ':', 2) || ' matched' END AS reason, {EVIDENCE} AS evidence FROM fnd""",
    "job_progress_stream": f"""
WITH c AS (SELECT user_id AS j, event_id % {SLICES} AS s, event_id % {SLICES} % 4 + 1 AS n, epoch_us(ts) // 1000 AS ms, CASE WHEN day(ts) < {CUTS[0]} THEN 0 WHEN day(ts) < {CUTS[1]} THEN 1 ELSE 2 END AS p FROM events),
f AS (SELECT j, s, n, min(p) AS p FROM c GROUP BY j, s, n),
g AS (SELECT j, p, max(ms) AS ms FROM c GROUP BY j, p),
t AS (SELECT g.j, g.p, g.ms, count(f.s) AS slices, coalesce(sum(f.n), 0) AS items, count(f.s) FILTER (f.p = g.p) AS fresh, lead(g.p, 1, 3) OVER (PARTITION BY g.j ORDER BY g.p) AS nxt FROM g LEFT JOIN f ON f.j = g.j AND f.p <= g.p GROUP BY g.j, g.p, g.ms),
w AS (SELECT p, max(ms) OVER (ORDER BY p) AS mark FROM (SELECT p, max(ms) AS ms FROM c GROUP BY p))
SELECT j AS job_id, 'progress' AS kind, ms AS at_ms, slices::BIGINT AS slices, items::BIGINT AS items FROM t WHERE fresh > 0
UNION ALL SELECT j, 'stalled', ms + {SILENCE_HOURS * 3_600_000}, slices::BIGINT, items::BIGINT FROM t JOIN w ON w.p = t.nxt - 1 WHERE ms + {SILENCE_HOURS * 3_600_000} <= mark""",
    "admin_summary_stream": f"""
WITH e AS (SELECT user_id AS j, event_id AS k, floor(event_id * {PARTS} / (max(event_id) OVER () + 1))::BIGINT AS part FROM events),
l AS (SELECT b.b, j, max(k) AS k FROM e JOIN range({PARTS}) AS b(b) ON part <= b.b GROUP BY b.b, j),
s AS (SELECT b, coalesce(sum(k % 3) FILTER (k % 5 >= 2), 0) AS flagged, coalesce(sum(k % 7) FILTER (k % 5 >= 2), 0) AS not_flagged, coalesce(sum(k % 2) FILTER (k % 5 >= 2), 0) AS unable, coalesce(sum(k % 11) FILTER (k % 5 < 2), 0) AS in_progress, count(*) AS jobs_total FROM l GROUP BY b)
SELECT b AS batch, 10000::BIGINT AS authorised, (flagged + not_flagged + unable)::BIGINT AS processed, flagged::BIGINT AS flagged, not_flagged::BIGINT AS not_flagged, unable::BIGINT AS unable, in_progress::BIGINT AS in_progress,
  greatest(0, 10000 - flagged - not_flagged - unable - in_progress)::BIGINT AS remaining, least(100.0::DOUBLE, round_even((flagged + not_flagged + unable) * 100.0::DOUBLE / 10000, 1)) AS percent, jobs_total FROM s""",
    "manifest_tree": ITEMS + """,
e AS (SELECT sha256(source_id) AS k, sha256(sha256(source_id) || coalesce('=' || content_hash, 'null')) AS d FROM items),
n2 AS (SELECT k[1:2] AS prefix, count(*) AS entries, sha256(string_agg(d, '' ORDER BY d)) AS digest FROM e GROUP BY 1),
n1 AS (SELECT prefix[1:1] AS prefix, sum(entries) AS entries, sha256(string_agg(prefix || ':' || digest, '' ORDER BY prefix)) AS digest FROM n2 GROUP BY prefix[1:1]),
n0 AS (SELECT '' AS prefix, sum(entries) AS entries, sha256(string_agg(prefix || ':' || digest, '' ORDER BY prefix)) AS digest FROM n1)
SELECT 2::INTEGER AS level, prefix, entries::BIGINT AS entries, digest FROM n2 UNION ALL SELECT 1, prefix, entries::BIGINT, digest FROM n1 UNION ALL SELECT 0, prefix, entries::BIGINT, digest FROM n0""",
    "manifest_changes": ITEMS + """,
b AS (SELECT source_id, content_hash AS before_hash FROM items WHERE doc_id % 97 <> 11),
a AS (SELECT source_id, CASE WHEN doc_id % 97 = 23 THEN sha256(content_hash) ELSE content_hash END AS after_hash FROM items WHERE doc_id % 97 <> 5)
SELECT source_id, CASE WHEN before_hash IS NULL THEN 'added' WHEN after_hash IS NULL THEN 'removed' ELSE 'changed' END AS change, before_hash, after_hash
FROM b FULL JOIN a USING (source_id) WHERE before_hash IS DISTINCT FROM after_hash""",
    "results_by_run": FOUND + "SELECT 'run-2' AS run_id, source_id, flag_status, strongest_band, n_findings, sensitivity_categories FROM sm WHERE flag_status = 'flagged'",
    "settings_in_force": """
WITH e AS (SELECT event_id, user_id, ts, event_type, (props->>'$.k')::BIGINT AS k FROM events),
r AS (SELECT user_id, ts, arg_max(k, event_id) AS in_force FROM e WHERE event_type = 'purchase' GROUP BY user_id, ts)
SELECT e.event_id, e.user_id, e.event_type, r.in_force FROM e ASOF LEFT JOIN r ON e.user_id = r.user_id AND e.ts >= r.ts""",
    "sessions_stream": f"""
WITH e AS (SELECT user_id, epoch_us(ts) AS us, floor(value * 100) AS cents, max(epoch_us(ts)) OVER () // 1000 * 1000 AS newest FROM events),
s AS (SELECT *, CASE WHEN us - lag(us) OVER (PARTITION BY user_id ORDER BY us) <= {GAP_HOURS * 3_600_000_000} THEN 0 ELSE 1 END AS fresh FROM e),
n AS (SELECT *, sum(fresh) OVER (PARTITION BY user_id ORDER BY us ROWS UNBOUNDED PRECEDING) AS k FROM s)
SELECT user_id, min(us)::BIGINT AS began, (max(us) + {GAP_HOURS * 3_600_000_000})::BIGINT AS ended, count(*) AS rows, sum(cents)::BIGINT AS cents
FROM n GROUP BY user_id, k, newest HAVING max(us) + {GAP_HOURS * 3_600_000_000} <= newest - {LATE_HOURS * 3_600_000_000}""",
    "run_batch_resumed": FOUND + """, st AS (SELECT source_id, concat_ws(',',
  CASE WHEN code0 IS NULL THEN 'extract:decode' END, CASE WHEN code0 IS NULL AND code IS NULL THEN 'ocr_gate:' || CASE WHEN used THEN 'ocr' ELSE 'skipped' END END, CASE WHEN code IS NOT NULL THEN 'pipeline:failed' END) AS stages FROM itm)
SELECT source_id, flag_status, stages, 'cancelled' AS first, 'completed' AS second, true AS whole FROM sm JOIN st USING (source_id)""",
    "run_folder": FOUND + "SELECT sm.*, 'sample:documents' AS snapshot_id, itm.content_hash, 'bench-0' AS config_version, true AS reconciled FROM sm JOIN itm USING (source_id)",
    "item_pieces": ITEMS + f""", b AS (SELECT source_id, hex(content) AS h FROM items WHERE content IS NOT NULL),
p AS (SELECT source_id, h, unnest(range((length(h) // 2 + {PIECE - 1}) // {PIECE})) AS ordinal FROM b)
SELECT source_id, ordinal::BIGINT AS ordinal, (ordinal * {PIECE})::BIGINT AS at, (length(substr(h, ordinal * {2 * PIECE} + 1, {2 * PIECE})) // 2)::BIGINT AS n_bytes, sha256(unhex(substr(h, ordinal * {2 * PIECE} + 1, {2 * PIECE}))) AS chunk_sha256 FROM p""",
    "registry_fold": """WITH e AS (SELECT event_id AS seq, user_id::VARCHAR AS job_id, CASE WHEN event_id % 5 = 0 THEN 'put' WHEN event_id % 5 = 2 THEN 'claim' WHEN event_id % 35 = 3 THEN 'cancel' ELSE 'progress' END AS kind FROM events),
b AS (SELECT job_id, max(seq) FILTER (kind = 'put') AS base, min(seq) FILTER (kind = 'put')::VARCHAR AS created_at, max(seq)::VARCHAR AS updated_at FROM e GROUP BY job_id HAVING max(seq) FILTER (kind = 'put') IS NOT NULL)
SELECT job_id, any_value(created_at) AS created_at, any_value(updated_at) AS updated_at, CASE WHEN coalesce(bool_or(kind = 'claim' AND seq > base), false) THEN 'running' ELSE 'queued' END AS status,
  (any_value(base) % 3 + coalesce(sum(seq % 4) FILTER (kind = 'progress' AND seq > base), 0))::BIGINT AS progress_done, coalesce(bool_or(kind = 'cancel' AND seq > base), false) AS cancel_requested FROM e JOIN b USING (job_id) GROUP BY job_id""",
    "stream_available_now": "WITH" + _hits("documents", "printf('doc_%06d', doc_id)", "text") + """, n AS (SELECT k, count(*) AS n, array_to_string(list_sort(list_distinct(list(category))), ',') AS c FROM hit GROUP BY k)
SELECT printf('doc_%06d', doc_id) AS source_id, coalesce(n, 0)::BIGINT AS n_findings, coalesce(c, '') AS categories FROM documents LEFT JOIN n ON k = printf('doc_%06d', doc_id)""",
    "ner_mapping": """WITH h AS (SELECT conv_id, turn, row_number() OVER () AS rid, regexp_extract_all(text, '[0-9]{2,}|[A-Z][A-Za-z0-9_]{9,}|[a-z]{12,}') AS hits, string_split_regex(text, '[0-9]{2,}|[A-Z][A-Za-z0-9_]{9,}|[a-z]{12,}') AS gaps FROM conversations),
u AS (SELECT *, unnest(range(len(hits))) AS i FROM h),
m AS (SELECT conv_id, turn, i, hits[i + 1] AS hit, list_sum(list_transform(gaps[1:i + 1], lambda x: length(x))) + coalesce(list_sum(list_transform(hits[1:i], lambda x: length(x))), 0) AS begins FROM u)
SELECT conv_id, turn, CASE WHEN regexp_matches(hit, '^[0-9]') THEN 'NUMBER-' ELSE 'WORD-' END || i AS finding_id, CASE WHEN regexp_matches(hit, '^[0-9]') THEN 'financial' ELSE 'contact' END AS category,
  CASE WHEN regexp_matches(hit, '^[0-9]') THEN 'deterministic_match' ELSE 'classifier_score' END AS score_type, CASE WHEN regexp_matches(hit, '^[0-9]') THEN NULL ELSE round((0.5::DOUBLE + least(length(hit), 40) / 100.0::DOUBLE) * 100, 6) END AS score, begins::BIGINT AS char_start
FROM m WHERE NOT regexp_matches(hit, '^[A-Z]')""",
    "calibration_fit_sigmoid": LABELLED.replace("WITH lab", "WITH RECURSIVE lab") + f""",
g AS (SELECT category, score / 100.0::DOUBLE AS x, count(*) AS n, count(*) FILTER (label = 1) AS pos FROM lab WHERE split = 'dev' GROUP BY ALL),
c AS (SELECT category, count(*) FILTER (split = 'dev' AND label = 1) AS positives FROM lab GROUP BY category),
nt(it, category, w0, w1) AS (SELECT 0, category, 0.0::DOUBLE, 0.0::DOUBLE FROM c WHERE positives > 0 UNION ALL
  SELECT it + 1, category, w0 + (h11 * (g0 - w0) - h01 * g1) / ((h00 + 1) * h11 - h01 * h01), w1 + ((h00 + 1) * g1 - h01 * (g0 - w0)) / ((h00 + 1) * h11 - h01 * h01)
  FROM (SELECT it, category, w0, w1, sum(x * (pos - n * p)) AS g0, sum(pos - n * p) AS g1, sum(n * x * x * p * (1 - p)) AS h00, sum(n * x * p * (1 - p)) AS h01, sum(n * p * (1 - p)) AS h11
    FROM (SELECT it, nt.category, w0, w1, x, n, pos, 1.0::DOUBLE / (1.0::DOUBLE + exp(-(w0 * x + w1))) AS p FROM nt JOIN g ON g.category = nt.category WHERE it < 30) GROUP BY it, category, w0, w1)),
f AS (SELECT c.category, positives, CASE WHEN positives > 0 THEN 'sigmoid' ELSE 'identity' END AS method, coalesce(-w0, 0.0) AS a, coalesce(-w1, 0.0) AS b FROM c LEFT JOIN (SELECT * FROM nt WHERE it = 30) w ON w.category = c.category),
{_status('CASE WHEN method = \'sigmoid\' THEN 1.0::DOUBLE / (1.0::DOUBLE + exp(a * x + b)) ELSE x END', "round(a, 5) AS a, round(b, 5) AS b, '' AS knots")}""",
    "calibration_fit_isotonic": LABELLED + f""",
g AS (SELECT category, score / 100.0::DOUBLE AS x, count(*) AS n, count(*) FILTER (label = 1) AS pos, row_number() OVER (PARTITION BY category ORDER BY score) AS k FROM lab WHERE split = 'dev' GROUP BY category, score),
c AS (SELECT category, count(*) FILTER (split = 'dev' AND label = 1) AS positives FROM lab GROUP BY category),
av AS (SELECT a.category, a.k AS a, b.k AS b, sum(b.pos) OVER w * 1.0::DOUBLE / sum(b.n) OVER w AS m FROM g a JOIN g b ON a.category = b.category AND b.k >= a.k WINDOW w AS (PARTITION BY a.category, a.k ORDER BY b.k)),
lo AS (SELECT category, a, b, min(m) OVER (PARTITION BY category, a ORDER BY b DESC) AS m FROM av),
kn AS (SELECT g.category, g.k, x, max(m) AS y FROM g JOIN lo ON lo.category = g.category AND lo.b = g.k GROUP BY ALL),
f AS (SELECT c.category, positives, CASE WHEN positives > 0 THEN 'isotonic' ELSE 'identity' END AS method, kx, ky, ks FROM c LEFT JOIN (SELECT category, list(x ORDER BY k) AS kx, list(y ORDER BY k) AS ky,
  string_agg(round(x * 1000000)::BIGINT || ':' || round(y * 1000000)::BIGINT, ',' ORDER BY k) AS ks FROM kn GROUP BY category) t ON t.category = c.category AND positives > 0),
{_status(_INTERPOLATED, "0.0::DOUBLE AS a, 0.0::DOUBLE AS b, coalesce(ks, '') AS knots")}""",
    "category_band_rollup": FOUND + "SELECT category, band, count(*) AS findings FROM fnd GROUP BY ROLLUP (category, band)",
    "linkage_patterns": """
WITH c AS (SELECT c_custkey AS id, split_part(c_name, '#', 2) AS name, round(c_acctbal * 100)::BIGINT AS cents, c_nationkey AS nation, c_mktsegment AS segment FROM customer),
b AS (SELECT id, CASE WHEN id % 4 = 1 THEN left(name, length(name) - 1) ELSE name END AS name, CASE id % 5 WHEN 2 THEN NULL WHEN 3 THEN cents + 1 ELSE cents END AS cents,
  CASE WHEN id % 7 = 5 THEN (nation + 1) % 25 ELSE nation END AS nation, CASE WHEN id % 6 <> 4 THEN segment END AS segment FROM c),
u AS (SELECT 0 AS side, min(id) AS id, name, cents, nation, segment FROM c GROUP BY ALL UNION ALL SELECT 1, min(id), name, cents, nation, segment FROM b GROUP BY ALL),
n AS (SELECT *, floor(cents / 10000) AS bin, count(*) OVER (PARTITION BY left(name, 8)) AS n_start, count(*) OVER (PARTITION BY name) AS n_name, count(*) OVER (PARTITION BY cents) AS n_cents, count(*) OVER (PARTITION BY nation) AS n_nation,
  count(*) OVER (PARTITION BY nation, segment) AS n_segment, count(*) OVER (PARTITION BY nation, segment, floor(cents / 10000)) AS n_bin FROM u),
k AS (SELECT *, [0, CASE WHEN n_start <= 64 THEN 0 WHEN n_name <= 64 THEN 1 ELSE 9 END] AS how, CASE WHEN n_start <= 64 THEN left(name, 8) ELSE name END AS key FROM n WHERE name IS NOT NULL
  UNION ALL SELECT *, [1, CASE WHEN n_cents <= 64 THEN 0 ELSE 9 END], cents::VARCHAR FROM n WHERE cents IS NOT NULL
  UNION ALL SELECT *, [2, CASE WHEN n_nation <= 64 THEN 0 WHEN n_segment <= 64 THEN 1 WHEN n_bin <= 64 THEN 2 ELSE 9 END],
    CASE WHEN n_nation <= 64 THEN nation::VARCHAR WHEN n_segment <= 64 THEN concat(nation, '|', coalesce(segment, '-')) ELSE concat(nation, '|', coalesce(segment, '-'), '|', coalesce(bin::VARCHAR, '-')) END FROM n WHERE nation IS NOT NULL),
f AS (SELECT *, CASE WHEN how[2] = 9 THEN concat_ws('|', coalesce(name, '-'), coalesce(cents::VARCHAR, '-'), coalesce(nation::VARCHAR, '-'), coalesce(segment, '-')) ELSE key END AS block FROM k),
p AS (SELECT l.id AS l_id, r.id AS r_id, sum(DISTINCT 1 << l.how[1])::INT AS rules, any_value(concat_ws(',',
    CASE WHEN l.name IS NULL OR r.name IS NULL THEN -1 WHEN l.name = r.name THEN 0 WHEN levenshtein(l.name, r.name) <= 1 THEN 1 ELSE 2 END,
    CASE WHEN l.cents IS NULL OR r.cents IS NULL THEN -1 WHEN l.cents = r.cents THEN 0 WHEN abs(l.cents - r.cents) <= 100 THEN 1 ELSE 2 END,
    CASE WHEN l.nation IS NULL OR r.nation IS NULL THEN -1 WHEN l.nation = r.nation THEN 0 ELSE 1 END,
    CASE WHEN l.segment IS NULL OR r.segment IS NULL THEN -1 WHEN l.segment = r.segment THEN 0 ELSE 1 END)) AS pattern
  FROM f l JOIN f r ON l.side = 0 AND r.side = 1 AND l.how = r.how AND l.block = r.block GROUP BY ALL)
SELECT pattern, rules, count(*) AS pairs FROM p GROUP BY ALL""",
}
