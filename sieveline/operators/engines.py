"""Ports for engines that need Python or a service: extraction, OCR, entity recognition, embedding, model scoring.

A port is a factory, called once a task, of a function of one row's values; :func:`each` makes a column of it, evaluated
in Arrow batches within the row, so that nothing is joined or shuffled. Rows whose first value is null are not sent.
Clients are made by a picklable callable, so tests pass fakes. Errors become typed codes in the row.
"""

from __future__ import annotations

import base64
import datetime
import io
import json
import os
import re
import typing
import urllib.error
import urllib.request
import zipfile
from collections.abc import Callable
from xml.etree import ElementTree

from pyspark.sql import Column
from pyspark.sql import functions as F
from pyspark.sql import types as T

from ..config import Config, ensure_egress_allowed
from ..functions import identifiers
from ..schema import IMAGE_TYPES, NER_RESULT, SPANS

W = "{http://schemas.openxmlformats.org/wordprocessingml/2006/main}"
S = "{http://schemas.openxmlformats.org/spreadsheetml/2006/main}"
R = "{http://schemas.openxmlformats.org/officeDocument/2006/relationships}"


class EngineError(Exception):
    """A failure of an engine; the stage gives it the stage's code."""


def location(page=None, sheet=None, cell=None, char_start=None, char_end=None) -> dict:
    return {"page": page, "sheet": sheet, "cell": cell, "char_start": char_start, "char_end": char_end}


def line_spans(text: str) -> list[tuple[dict, str]]:
    """As functions.text.line_spans, of a text at hand."""
    spans, at = [], 0
    for line in text.splitlines(keepends=True):
        if value := line.strip("\n"):
            spans.append((location(char_start=at, char_end=at + len(value)), value))
        at += len(line)
    return spans


# ---- native documents -----------------------------------------------------------------------------------------------


def _paragraph(el) -> str:
    """The text of a paragraph's runs: tabs and breaks are characters; deleted text is not."""
    out = []
    for x in el.iter():
        if x.tag == f"{W}t":
            out.append(x.text or "")
        elif x.tag == f"{W}tab" and x.get(f"{W}val") is None:  # a tab stop of the paragraph's style has a value
            out.append("\t")
        elif x.tag in (f"{W}br", f"{W}cr"):
            out.append("\n")
        elif x.tag == f"{W}noBreakHyphen":
            out.append("-")
    return "".join(out)


def _grid(row, above: list[str]) -> list[str]:
    """The cell texts of a table's row by column of its grid: a cell over several columns stands in each, one that goes on
    from the row above has that one's text."""
    out: list[str] = []
    for cell in row.findall(f"{W}tc"):
        value = "\n".join(_paragraph(p) for p in cell.findall(f"{W}p"))
        span, merge = cell.find(f"{W}tcPr/{W}gridSpan"), cell.find(f"{W}tcPr/{W}vMerge")
        if merge is not None and merge.get(f"{W}val", "continue") == "continue" and len(out) < len(above):
            value = above[len(out)]
        out += [value] * (int(span.get(f"{W}val")) if span is not None else 1)
    return out


def docx_spans(data: bytes) -> list[tuple[dict, str]]:
    """Paragraphs without white space around them, with offsets (each that is not blank counts its length and one); then
    table cells, numbered from 0 by table, row and column."""
    body, spans, at = ElementTree.fromstring(zipfile.ZipFile(io.BytesIO(data)).read("word/document.xml")).find(f"{W}body"), [], 0
    for p in body.findall(f"{W}p"):
        if line := _paragraph(p).strip():
            spans.append((location(char_start=at, char_end=at + len(line)), line))
            at += len(line) + 1
    for n, tbl in enumerate(body.findall(f"{W}tbl")):
        above: list[str] = []
        for r, row in enumerate(tbl.findall(f"{W}tr")):
            above = _grid(row, above)
            spans += [(location(sheet=f"table{n}", cell=f"r{r}c{c}"), value.strip()) for c, value in enumerate(above) if value.strip()]
    return spans


#: Number formats of spreadsheets that are dates or times.
_DATE_FORMATS = {*range(14, 23), *range(27, 37), *range(45, 48), *range(50, 59)}


def _date_styles(z: zipfile.ZipFile) -> set[int]:
    """The cell styles whose numbers are dates."""
    if "xl/styles.xml" not in z.namelist():
        return set()
    root = ElementTree.fromstring(z.read("xl/styles.xml"))
    own = {int(f.get("numFmtId")): f.get("formatCode", "") for f in root.iter(f"{S}numFmt")}
    plain = lambda code: re.sub(r'"[^"]*"|\\.|\[(?![hms]+\])[^\]]*\]', "", code.split(";")[0], flags=re.IGNORECASE)
    dates = _DATE_FORMATS | {k for k, code in own.items() if re.search("[dmhys]", plain(code), re.IGNORECASE)}
    styles = root.find(f"{S}cellXfs")
    return {n for n, xf in enumerate(styles if styles is not None else ()) if int(xf.get("numFmtId", 0)) in dates}


def _moment(value: float, from_1904: bool) -> str:
    """A spreadsheet's day number as text: a time of day below one, else a date with its time."""
    if 0 <= value < 1:
        return str((datetime.datetime.min + datetime.timedelta(seconds=round(value * 86_400_000_000) / 1e6)).time())
    start = datetime.datetime(1904, 1, 1) if from_1904 else datetime.datetime(1899, 12, 31 if value < 60 else 30)
    return str(start + datetime.timedelta(days=int(value), milliseconds=round(value % 1 * 86_400_000)))


def _cell(kind: str | None, raw: str | None, is_date: bool, from_1904: bool) -> str | None:
    """A cell's value as text: truth values, whole and decimal numbers, dates; errors and texts as they stand."""
    if raw is None or kind in ("str", "e", "d"):
        return raw
    if kind == "b":
        return str(bool(int(raw)))
    number = float(raw) if set(raw) & set(".eE") else int(raw)
    return _moment(float(number), from_1904) if is_date else str(number)


def xlsx_spans(data: bytes) -> list[tuple[dict, str]]:
    """Non-empty cells with sheet name and coordinate; formulas have their saved values."""
    z = zipfile.ZipFile(io.BytesIO(data))
    shared: list[str] = []
    if "xl/sharedStrings.xml" in z.namelist():
        shared = ["".join(t.text or "" for t in si.iter(f"{S}t")) for si in ElementTree.fromstring(z.read("xl/sharedStrings.xml")).findall(f"{S}si")]
    rel = {r.get("Id"): r.get("Target") for r in ElementTree.fromstring(z.read("xl/_rels/workbook.xml.rels"))}
    book, dates, spans = ElementTree.fromstring(z.read("xl/workbook.xml")), _date_styles(z), []
    pr = book.find(f"{S}workbookPr")
    from_1904 = pr is not None and pr.get("date1904") in ("1", "true")
    for sheet in book.iter(f"{S}sheet"):
        target = rel[sheet.get(f"{R}id")].lstrip("/")
        for c in ElementTree.fromstring(z.read(target if target.startswith("xl/") else f"xl/{target}")).iter(f"{S}c"):
            kind, v = c.get("t"), c.find(f"{S}v")
            if kind == "inlineStr":
                value = "".join(t.text or "" for t in c.iter(f"{S}t"))
            elif kind == "s":
                value = shared[int(v.text)] if v is not None else None
            else:
                value = _cell(kind, v.text if v is not None else None, int(c.get("s", 0)) in dates, from_1904)
            if value is not None and value.strip():
                spans.append((location(sheet=sheet.get("name"), cell=c.get("r")), value.strip()))
    return spans


def pdf_spans(data: bytes) -> list[tuple[dict, str]]:
    """Non-blank pages, numbered from 1. Needs the optional library pypdf."""
    try:
        from pypdf import PdfReader
    except ImportError as e:
        raise EngineError("pypdf is not installed") from e
    pages = [(n, (p.extract_text() or "").strip()) for n, p in enumerate(PdfReader(io.BytesIO(data)).pages, 1)]
    return [(location(page=n), t) for n, t in pages if t]


PARSERS = {
    "application/pdf": pdf_spans,
    "application/vnd.openxmlformats-officedocument.wordprocessingml.document": docx_spans,
    "application/vnd.openxmlformats-officedocument.spreadsheetml.sheet": xlsx_spans,
}

#: (text or null, spans, whether all of it was read)
Extracted = tuple[str | None, list[tuple[dict, str]], bool]


def native(data: bytes, content_type: str, path: str) -> Extracted:
    """A document's spans, joined by line feeds. Images wait for the OCR gate; other types are decoded as UTF-8."""
    if content_type in IMAGE_TYPES:
        return None, [], False
    parser = PARSERS.get(content_type)
    if parser is None:
        try:
            value = data.decode("utf-8")
        except UnicodeDecodeError:
            return None, [], False
        return value, line_spans(value), bool(value.strip())
    try:
        spans = parser(data)
    except EngineError:
        raise
    except Exception as e:
        raise EngineError(f"corrupt document: {type(e).__name__}") from e
    return ("\n".join(t for _, t in spans) or None), spans, bool(spans)


# ---- services -------------------------------------------------------------------------------------------------------


class HttpJson:
    """A minimal client: posts JSON or puts bytes; transport failures are EngineErrors."""

    def __init__(self, timeout: float):
        self.timeout = timeout

    def send(self, url: str, data: bytes, method: str = "POST", headers: dict[str, str] | None = None) -> bytes:
        request = urllib.request.Request(url, data=data, method=method, headers=headers or {})
        try:
            with urllib.request.urlopen(request, timeout=self.timeout) as answer:
                return answer.read()
        except (urllib.error.URLError, OSError, ValueError) as e:
            raise EngineError(f"transport: {type(e).__name__}") from e

    def post(self, url: str, body: dict, headers: dict[str, str] | None = None) -> dict | list:
        return json.loads(self.send(url, json.dumps(body).encode(), headers={"Content-Type": "application/json", **(headers or {})}))


def _convert(client, url: str, data: bytes, path: str) -> dict:
    body = {"sources": [{"kind": "file", "base64_string": base64.b64encode(data).decode("ascii"), "filename": path}], "options": {"to_formats": ["text"]}}
    try:
        return client.post(f"{url.rstrip('/')}/v1/convert/source", body)
    except EngineError:
        raise
    except Exception as e:
        raise EngineError(f"convert service: {type(e).__name__}") from e


def docling(url: str, make: Callable[[], object] = lambda: HttpJson(120)) -> Callable:
    """Converts through a service that takes base64 sources; an empty text is no text layer; complete only on success."""
    def start() -> Callable:
        client = make()

        def one(data: bytes, content_type: str, path: str) -> Extracted:
            answer = _convert(client, url, data, path)
            if answer.get("status") == "failure":
                raise EngineError("conversion failed")
            doc = answer.get("document") or {}
            value = (doc.get("text_content") or doc.get("md_content") or "").strip()
            return (value, line_spans(value), answer.get("status") == "success") if value else (None, [], False)

        return one

    return start


def docling_ocr(url: str, make: Callable[[], object] = lambda: HttpJson(120)) -> Callable:
    """Recognises a text through the convert service; no text is a failure."""
    def start() -> Callable:
        client = make()

        def one(data: bytes, path: str) -> str:
            answer = _convert(client, url, data, path)
            value = ((answer.get("document") or {}).get("text_content") or "").strip()
            if answer.get("status") == "failure" or not value:
                raise EngineError("no text was recognised")
            return value

        return one

    return start


def tika(url: str, make: Callable[[], object] = lambda: HttpJson(60)) -> Callable:
    """Takes the text that a service returns for the bytes; an empty one is no text layer."""
    def start() -> Callable:
        client = make()

        def one(data: bytes, content_type: str, path: str) -> Extracted:
            try:
                value = client.send(f"{url.rstrip('/')}/tika", data, "PUT", {"Accept": "text/plain"}).decode("utf-8", "replace").strip()
            except EngineError:
                raise
            except Exception as e:
                raise EngineError(f"text service: {type(e).__name__}") from e
            return (value, line_spans(value), True) if value else (None, [], False)

        return one

    return start


def presidio_http(url: str, language: str = "en", threshold: float = 0.35, make: Callable[[], object] = lambda: HttpJson(30)) -> Callable:
    def start() -> Callable:
        client = make()

        def one(value: str) -> list[dict]:
            try:
                return client.post(f"{url.rstrip('/')}/analyze", {"text": value, "language": language, "score_threshold": threshold})
            except EngineError:
                raise
            except Exception as e:
                raise EngineError(f"analyser: {type(e).__name__}") from e

        return one

    return start


def presidio(language: str, threshold: float) -> Callable:
    """The analyser in the worker; needs its optional library."""
    def start() -> Callable:
        from presidio_analyzer import AnalyzerEngine

        engine = AnalyzerEngine()
        return lambda value: [{"entity_type": r.entity_type, "start": r.start, "end": r.end, "score": r.score} for r in engine.analyze(text=value, language=language, score_threshold=threshold)]

    return start


def sentence_vectors(model: str) -> Callable:
    """An embedder of batches of texts, unit vectors; needs its optional library."""
    def start() -> Callable:
        from sentence_transformers import SentenceTransformer

        encoder = SentenceTransformer(model)
        return lambda texts: [[float(x) for x in v] for v in encoder.encode(texts, normalize_embeddings=True)]

    return start


def open_weight(cfg: Config, make: Callable[[], object] = lambda: HttpJson(30)) -> Callable:
    """A scorer ``(span, categories) -> [(category, score)], shown`` through a chat-completions service at temperature 0.
    A remote service gets the span with its identifiers masked; without the key or an approval nothing is sent."""
    inf = cfg.inference
    ensure_egress_allowed(not inf.is_local, inf.approval_written)

    def start() -> Callable:
        client = make()
        ensure_egress_allowed(not inf.is_local, inf.approval_written)
        key = os.environ.get(inf.api_key_env) if inf.api_key_env else None
        headers = {"Authorization": f"Bearer {key}"} if key else None

        def one(span: str, categories) -> tuple[list[tuple[str, float]], int]:
            if not inf.is_local:
                secret = os.environ.get(inf.hash_key_env or "")
                if not secret:
                    raise RuntimeError("no masking key: nothing is sent")
                span = identifiers.mask_text(span, secret.encode())
            return [(c, score(c, span)) for c in categories], len(span)

        def score(category: str, span: str) -> float:
            shape = {"type": "object", "properties": {"score": {"type": "integer", "minimum": 0, "maximum": 100}}, "required": ["score"]}
            body = {
                "model": inf.model_version, "temperature": 0,
                "messages": [{"role": "system", "content": 'Say how strongly the span belongs to the category. Answer with JSON only: {"score": 0-100}.'}, {"role": "user", "content": f"category: {category}\nspan: {span}"}],
                "response_format": {"type": "json_schema", "json_schema": {"schema": shape}},
            }
            answer = client.post(f"{inf.base_url.rstrip('/')}/v1/chat/completions", body, headers)
            return max(0.0, min(100.0, float(json.loads(answer["choices"][0]["message"]["content"])["score"])))

        return one

    return start


# ---- factories: what a configuration names --------------------------------------------------------------------------


def _needed(value: str | None, what: str) -> str:
    if not value:
        raise ValueError(f"{what} is not set")
    return value


def extraction_engine(cfg: Config) -> Callable | None:
    """A factory of ``(bytes, content type, path) -> (text, spans, complete)``; None: the built-in decoding expressions."""
    e = cfg.extract
    if e.engine == "decode":
        return None
    if e.engine == "native":
        return lambda: native
    if e.engine == "docling":
        return docling(_needed(e.docling_url, "extract.docling_url"))
    if e.engine == "tika":
        return tika(_needed(e.tika_url, "extract.tika_url"))
    raise ValueError(f"unknown extraction engine {e.engine!r}")


def ocr_engine(cfg: Config) -> Callable | None:
    """A factory of ``(bytes, path) -> text``; None: texts that lie beside the items."""
    if cfg.ocr.provider == "stub":
        return None
    if cfg.ocr.provider == "docling":
        return docling_ocr(_needed(cfg.ocr.url, "ocr.url"))
    raise ValueError(f"unknown OCR provider {cfg.ocr.provider!r}")


def detector(cfg: Config) -> Callable | None:
    """A factory of analysers ``text -> entities``; None: the built-in pattern rules."""
    d = cfg.detect
    if d.engine == "regex":
        return None
    if d.engine == "presidio_http":
        return presidio_http(_needed(d.presidio_url, "detect.presidio_url"), d.presidio_language, d.presidio_score_threshold)
    if d.engine == "presidio":
        return presidio(d.presidio_language, d.presidio_score_threshold)
    raise ValueError(f"unknown detection engine {d.engine!r}")


def provider(cfg: Config) -> Callable | None:
    """A factory of scorers; None: the built-in mock provider."""
    if cfg.inference.provider == "mock":
        return None
    if cfg.inference.provider == "openweight":
        _needed(cfg.inference.base_url, "inference.base_url")
        return open_weight(cfg)
    raise ValueError(f"unknown inference provider {cfg.inference.provider!r}")


def embedder(cfg: Config) -> Callable | None:
    """A factory of embedders; None: no semantic screen."""
    return sentence_vectors(cfg.semantic.model) if cfg.semantic.enabled else None


# ---- columns --------------------------------------------------------------------------------------------------------


def _column(run: Callable, kind: T.DataType, inputs: tuple[Column, ...]) -> Column:
    import pandas as pd

    run.__annotations__ = {"batches": typing.Iterator[typing.Tuple[pd.Series, ...]], "return": typing.Iterator[pd.DataFrame]}  # noqa: UP006, UP035
    return F.pandas_udf(run, kind).asNondeterministic()(*inputs)  # so that a service is asked once


def each(start: Callable, ddl: str, code: str, shaped: Callable, *inputs: Column) -> Column:
    """A struct column: the fields of ``ddl`` and ``code``. ``start`` makes the engine, once a task; ``shaped`` turns its
    answer into the fields. An EngineError gives ``code``, another error internal_error. A null first input is not sent."""
    kind = T.StructType.fromDDL(f"{ddl}, code string")
    empty = (None,) * len(kind.names)

    def run(batches):
        import pandas as pd

        one = start()
        for columns in batches:
            rows = []
            for values in zip(*(columns if isinstance(columns, tuple) else (columns,)), strict=True):
                if values[0] is None:
                    rows.append(empty)
                    continue
                try:
                    rows.append((*shaped(one(*values)), None))
                except EngineError:
                    rows.append((*empty[:-1], code))
                except Exception:
                    rows.append((*empty[:-1], "internal_error"))
            yield pd.DataFrame(rows, columns=kind.names).astype(object)

    return _column(run, kind, inputs)


def extracted(start: Callable, content: Column, content_type: Column, path: Column) -> Column:
    """A struct (text, spans, complete, code) of an extraction engine."""
    shaped = lambda x: (x[0], [{"location": p, "text": t} for p, t in x[1]], x[2])
    return each(start, f"text string, spans {SPANS}, complete boolean", "extraction_error", shaped, content, content_type, path)


def recognised(start: Callable):
    """What items.ocr_gate asks of an OCR engine: ``(contents, path) -> text``."""
    return lambda content, path: each(start, "text string", "ocr_failure", lambda x: (x,), content, path)["text"]


def entities(start: Callable, text: Column) -> Column:
    """A struct (results, code) of an entity analyser: transport failures are detection errors, malformed results internal."""
    shaped = lambda found: ([{"entity_type": str(x["entity_type"]), "start": int(x["start"]), "end": int(x["end"]), "score": float(x["score"])} for x in found],)
    return each(start, f"results {NER_RESULT}", "detection_error", shaped, text)


def scores(start: Callable, span: Column, categories: Column) -> Column:
    """A struct (scores, shown, code) of a model provider: every failure is an internal error."""
    shaped = lambda x: ([{"category": c, "score": s} for c, s in x[0]], x[1])
    return each(start, "scores array<struct<category:string,score:double>>, shown int", "internal_error", shaped, span, categories)


def vectors(start: Callable, text: Column) -> Column:
    """A struct (v, code): vectors of texts, a batch at a time; a null text is not sent."""
    kind = T.StructType.fromDDL("v array<double>, code string")

    def run(batches):
        import pandas as pd

        embed = start()
        for texts in batches:
            texts = texts[0] if isinstance(texts, tuple) else texts
            sent = [t for t in texts if t is not None]
            try:
                made = iter(embed(sent) if sent else [])
                rows = [(None, None) if t is None else ([float(x) for x in next(made)], None) for t in texts]
            except Exception:
                rows = [(None, None if t is None else "internal_error") for t in texts]
            yield pd.DataFrame(rows, columns=kind.names).astype(object)

    return _column(run, kind, (text,))


#: What the stand-in analyser finds.
STAND_IN = "(?P<NUMBER>[0-9]{2,})|(?P<NAME>[A-Z][A-Za-z0-9_]{9,})|(?P<WORD>[a-z]{12,})"


def entities_of(text: Column) -> Column:
    """A stand-in analyser for tests and benches: numbers (certain), long words and capitalised words (kept or dropped by
    the category map), in the order of the text."""
    import pandas as pd

    pattern = re.compile(STAND_IN)

    def run(texts: pd.Series) -> pd.Series:
        return texts.map(lambda t: [{"entity_type": m.lastgroup, "start": m.start(), "end": m.end(), "score": 0.5 + min(m.end() - m.start(), 40) / 100} for m in pattern.finditer(t or "")])

    run.__annotations__ = {"texts": pd.Series, "return": pd.Series}
    return F.pandas_udf(run, NER_RESULT)(text)
