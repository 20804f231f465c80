"""Operator 7, WARC archives with revisit resolution.

Headers (no payloads) are shuffled by payload digest; each digest of a payload of at least ``least`` bytes names its
original, the record with the greatest id; the others join it and become revisit records that refer to it. Records are
written with fresh headers and record ids by Spark's own text writer (so to any file system that Spark writes) and are
read back by their Content-Length. An archive file has a bounded number of records and, but for a single larger record,
at most FILE_BYTES of payload, as a reader holds a file at once.
"""

from __future__ import annotations

import hashlib
from collections.abc import Iterator

import pyarrow as pa
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from .common import join_small, new_path, save, table

#: Payloads under this many bytes are always written whole.
LEAST = 1000

#: Records and payload bytes of an archive file.
RECORDS, FILE_BYTES = 500, 32 << 20

#: Verdicts (two numbers and the original's id, about 64 MB as a table in memory) are broadcast up to so many rows.
VERDICTS = 1_000_000

HTTP = "HTTP/1.1 200 OK\r\nContent-Type: text/html; charset=utf-8\r\n\r\n"
PROFILE = "http://netpreserve.org/warc/1.1/revisit/identical-payload-digest"


def resolve(pages: DataFrame, least: int = LEAST) -> DataFrame:
    """Headers with record_type and refers_to: page_id, url, html, payload_bytes, payload_digest, record_type, refers_to.

    Null urls and html are empty; an empty table gives no rows; of repeated rows each has a verdict. Only headers of
    digests that occur twice are shuffled. Their verdicts are counted, and broadcast up to VERDICTS rows, so that
    payloads stay in the scan's rows until they are written; beyond that bound the join shuffles the rows, payloads too."""
    payload = F.coalesce(F.col("html"), F.lit("")).cast("binary")
    rows = pages.select(
        F.col("page_id").cast("long").alias("page_id"), F.col("url").cast("string").alias("url"), F.coalesce(F.col("html"), F.lit("")).alias("html"),
        F.octet_length(payload).cast("long").alias("payload_bytes"), F.sha1(payload).alias("payload_digest"),
    )
    headers = rows.where(F.col("payload_bytes") >= least).select("page_id", "payload_digest")
    originals = headers.groupBy("payload_digest").agg(F.count("*").alias("n"), F.max("page_id").alias("original")).where("n > 1").drop("n")
    joined = headers.join(originals, "payload_digest").where(~F.col("page_id").eqNullSafe(F.col("original")))
    key = [F.coalesce("page_id", F.lit(0)).alias("_id"), F.col("page_id").isNull().alias("_none"), F.xxhash64("payload_digest").alias("_digest")]
    revisits = save(joined.select(*key, "original", F.lit(True).alias("_revisit")).distinct(), "warc-revisits")
    out = join_small(rows.select("*", *key), revisits, ["_id", "_none", "_digest"], "left", VERDICTS)
    return out.select(
        "page_id", "url", "html", "payload_bytes", "payload_digest",
        F.when(F.col("_revisit").isNull(), "response").otherwise("revisit").alias("record_type"), F.col("original").alias("refers_to"),
    )


def _named(page_id: Column, digest: Column) -> Column:
    """The record id of a response that revisits may refer to: a UUID by name (version 5 in form) of page and payload."""
    h = F.sha1(F.concat_ws("|", F.lit("response"), page_id.cast("string"), digest).cast("binary"))
    return F.concat_ws("-", F.substring(h, 1, 8), F.substring(h, 9, 4), F.concat(F.lit("5"), F.substring(h, 14, 3)), F.concat(F.lit("8"), F.substring(h, 18, 3)), F.substring(h, 21, 12))


def _uri(uuid: Column) -> Column:
    return F.concat(F.lit("<urn:uuid:"), uuid, F.lit(">"))


def record(date: Column) -> Column:
    """The text of a record of :func:`resolve`'s rows, without the last line end, which the writer adds. Revisits, and
    responses without a page id, to which nothing refers, have random record ids."""
    line = lambda name, value: F.concat(F.lit(f"{name}: "), value, F.lit("\r\n"))
    revisit = F.col("record_type") == "revisit"
    body = F.concat(F.lit(HTTP), F.when(revisit, F.lit("")).otherwise(F.col("html")))
    url = F.regexp_replace(F.coalesce(F.col("url"), F.lit("")), "[\\r\\n]", "")
    return F.concat(
        F.lit("WARC/1.1\r\n"),
        line("WARC-Type", F.col("record_type")),
        line("WARC-Record-ID", _uri(F.when(revisit | F.col("page_id").isNull(), F.uuid()).otherwise(_named(F.col("page_id"), F.col("payload_digest"))))),
        line("WARC-Date", date),
        line("WARC-Target-URI", url),
        line("WARC-Payload-Digest", F.concat(F.lit("sha1:"), F.col("payload_digest"))),
        F.when(F.col("page_id").isNull(), F.lit("")).otherwise(line("X-Page-ID", F.col("page_id").cast("string"))),
        line("X-Payload-Length", F.col("payload_bytes").cast("string")),
        F.when(revisit, F.concat(
            line("WARC-Profile", F.lit(PROFILE)), line("WARC-Refers-To", _uri(_named(F.col("refers_to"), F.col("payload_digest")))), line("X-Refers-To-Page-ID", F.col("refers_to").cast("string"))
        )).otherwise(F.lit("")),
        line("Content-Type", F.lit("application/http; msgtype=response")),
        line("Content-Length", F.octet_length(body).cast("string")),
        F.lit("\r\n"), body, F.lit("\r\n"),
    )


def write(pages: DataFrame, path: str, least: int = LEAST, records: int = RECORDS, date: Column | None = None) -> None:
    """Writes archives to a new folder; of an empty table, a folder without records. A null html is an empty payload;
    page_ids should be unique: equal pages of one id are all responses if the id is the greatest of its digest, else all
    revisits, and equal responses of one id are one record to those that refer to it."""
    date = F.date_format(F.current_timestamp(), "yyyy-MM-dd'T'HH:mm:ss'Z'") if date is None else date
    rows, usual = resolve(pages, least), FILE_BYTES // records
    largest = pages.agg(F.max(F.octet_length("html"))).first()[0] or 0
    size = F.col("payload_bytes")

    def written(part: DataFrame, most: int, mode: str) -> None:
        part.select(record(date).alias("value")).write.mode(mode).option("lineSep", "\r\n").option("maxRecordsPerFile", most).text(path)

    written(rows.where(size <= usual) if largest > usual else rows, records, "errorifexists")
    while largest > usual:  # larger payloads by powers of eight, fewer to a file
        written(rows.where((size > usual) & (size <= 8 * usual)), max(1, FILE_BYTES // (8 * usual)), "append")
        usual *= 8


def parse(data: bytes) -> Iterator[tuple[dict[str, str], bytes]]:
    """The records of an archive: headers, and the content of Content-Length bytes."""
    at = 0
    while at < len(data):
        end = data.index(b"\r\n\r\n", at)
        first, *lines = data[at:end].decode("utf-8").split("\r\n")
        if not first.startswith("WARC/"):
            raise ValueError(f"no record at {at}")
        headers = dict(x.split(": ", 1) for x in lines)
        start = end + 4
        stop = start + int(headers["Content-Length"])
        yield headers, data[start:stop]
        if data[stop : stop + 4] != b"\r\n\r\n":
            raise ValueError(f"the record at {at} does not end as its length says")
        at = stop + 4


READ = "page_id long, url string, html string, payload_bytes long, payload_digest string, record_type string, refers_to long"


def read(spark: SparkSession, path: str) -> DataFrame:
    """A row a record of all archives in a folder; html is null in revisit records. Digests and lengths are verified."""

    def number(value: str | None) -> int | None:
        return None if value is None else int(value)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for data in batch.column(0):
                rows = []
                for h, content in parse(data.as_buffer().to_pybytes()):
                    payload = content[content.index(b"\r\n\r\n") + 4 :]
                    digest, size = h["WARC-Payload-Digest"].removeprefix("sha1:"), int(h["X-Payload-Length"])
                    if h["WARC-Type"] == "response" and (hashlib.sha1(payload).hexdigest() != digest or len(payload) != size):
                        raise ValueError(f"{h['WARC-Record-ID']}: the payload is not what its headers say")
                    rows.append((number(h.get("X-Page-ID")), h["WARC-Target-URI"], payload if h["WARC-Type"] == "response" else None, size, digest, h["WARC-Type"], number(h.get("X-Refers-To-Page-ID"))))
                if rows:
                    a, b, c, d, e, f, g = zip(*rows, strict=True)
                    html = pa.array(c, pa.binary()).cast(pa.string())
                    yield pa.RecordBatch.from_arrays(
                        [pa.array(a, pa.int64()), pa.array(b, pa.string()), html, pa.array(d, pa.int64()), pa.array(e, pa.string()), pa.array(f, pa.string()), pa.array(g, pa.int64())],
                        names=["page_id", "url", "html", "payload_bytes", "payload_digest", "record_type", "refers_to"],
                    )

    files = spark.read.format("binaryFile").load(path).select("content")
    return files.mapInArrow(run, READ)


def op7_warc_revisits(spark: SparkSession, sf_dir: str) -> DataFrame:
    path = new_path(spark, "warc")
    write(table(spark, sf_dir, "pages").select("page_id", "url", "html"), path)
    return read(spark, path).select("page_id", "payload_bytes", "payload_digest", "record_type", "refers_to")


SQL = """
WITH p AS (SELECT page_id, coalesce(html, '') AS h FROM pages),
d AS (SELECT page_id, octet_length(encode(h)) AS n, sha1(h) AS s FROM p),
o AS (SELECT s, max(page_id) AS m FROM d WHERE n >= 1000 GROUP BY s)
SELECT d.page_id, n::BIGINT AS payload_bytes, d.s AS payload_digest,
  CASE WHEN n >= 1000 AND page_id IS DISTINCT FROM m THEN 'revisit' ELSE 'response' END AS record_type,
  CASE WHEN n >= 1000 AND page_id IS DISTINCT FROM m THEN m END AS refers_to
FROM d LEFT JOIN o USING (s)
"""
