"""Reads of chosen items: a Spark data source whose partitions are planned from a manifest by the items' sizes.

Entries go to the tasks, not contents to the entries: nothing is joined, no exchange carries a content, and no file is
opened but those of the chosen entries. Files are opened read-only through Arrow's file systems, by the scheme of the root
(local, object stores, HDFS).
"""

from __future__ import annotations

from collections.abc import Iterator

import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql.datasource import DataSource, DataSourceReader, InputPartition

from ..schema import MANIFEST
from .shared import names, new_path

SIDE = ".ocr.txt"

#: Bytes that are read at once, bytes of content that a batch holds, and the largest content that a row can hold.
CHUNK, BATCH, LARGEST = 1 << 20, 32 << 20, 1 << 30

COLUMNS = [c.split(" ")[0] for c in MANIFEST.split(", ")]
ITEM = f"{MANIFEST}, content binary, ocr_text string"
PIECE = "source_id string, ordinal long, at long, chunk binary"


def _at(uri: str):
    """(file system, path) of a folder."""
    from pyarrow import fs

    return fs.FileSystem.from_uri(uri)


def _places(root: str, path: str) -> str:
    return f"{root.rstrip('/')}/{path.lstrip('/')}"


def _sized(root: str):
    """mapInArrow: entries -> entries with size (null where there is no file) and whether a text lies beside the file."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        fs, base = _at(root)
        for batch in batches:
            paths = [p or "" for p in batch.column("path").to_pylist()]
            info = fs.get_file_info([_places(base, p) for p in paths] + [_places(base, p + SIDE) for p in paths])
            there = [i.size if i.is_file and p else None for i, p in zip(info, paths, strict=False)]
            beside = [bool(p) and i.is_file for i, p in zip(info[len(paths) :], paths, strict=True)]
            yield pa.RecordBatch.from_arrays([*batch.columns, pa.array(there, pa.int64()), pa.array(beside)], names=[*batch.schema.names, "size", "side"])

    return run


def plan(spark: SparkSession, entries: DataFrame, root: str) -> str:
    """Writes the entries, without contents, as one folder a partition of about ``spark.sql.files.maxPartitionBytes`` of
    items (or as many as the session has cores, if the items are small); answers with the folder of the plan."""
    sized = entries.select(*COLUMNS).mapInArrow(_sized(root), f"{MANIFEST}, size long, side boolean")
    first, out = new_path(spark, "sizes"), new_path(spark, "plan")
    sized.write.parquet(first)
    sized = spark.read.schema(f"{MANIFEST}, size long, side boolean").parquet(first)
    total, n = sized.agg(F.coalesce(F.sum("size"), F.lit(0)), F.count("*")).first()
    most = int(spark._jsparkSession.sessionState().conf().filesMaxPartitionBytes())
    parts = max(-(-total // most), min(n, spark.sparkContext.defaultParallelism), 1)
    dealt = sized.withColumn("part", F.pmod(F.xxhash64("source_id", "path"), F.lit(parts)).cast("int"))
    dealt.repartition(parts, "part").write.partitionBy("part").parquet(out)
    return out


class Part(InputPartition):
    def __init__(self, folder: str):
        self.folder = folder


class ItemReader(DataSourceReader):
    def __init__(self, root: str, folders: list[str], side: bool, pieces: bool, chunk: int):
        self.root, self.folders, self.side, self.pieces, self.chunk = root, folders, side, pieces, chunk

    def partitions(self) -> list[Part]:
        return [Part(f) for f in self.folders] or [Part("")]

    def open(self, fs, path: str):
        """The one place where an item's file is opened."""
        return fs.open_input_stream(path)

    def chunks(self, fs, path: str) -> Iterator[bytes]:
        with self.open(fs, path) as stream:
            while data := stream.read(self.chunk):
                yield data

    def _content(self, fs, path: str, size: int | None) -> bytes | None:
        """All of an item; None where there is none, where it cannot be read, or where it is too large for a row."""
        if size is None or size > LARGEST:
            return None
        try:
            return b"".join(self.chunks(fs, path))
        except OSError:
            return None

    def _entries(self, folder: str) -> Iterator[dict]:
        from pyarrow import dataset

        fs, at = _at(folder)
        for batch in dataset.dataset(at, filesystem=fs, format="parquet").to_batches(batch_size=1024):
            yield from batch.to_pylist()

    def read(self, part: Part) -> Iterator[pa.RecordBatch]:
        if not part.folder:
            return
        fs, base = _at(self.root)
        yield from self._pieces(part, fs, base) if self.pieces else self._items(part, fs, base)

    def _items(self, part: Part, fs, base: str) -> Iterator[pa.RecordBatch]:
        shape = pa.schema([(c, pa.string()) for c in COLUMNS] + [("content", pa.binary()), ("ocr_text", pa.string())])
        held, size = [], 0
        for e in self._entries(part.folder):
            path = _places(base, e["path"] or "")
            content = self._content(fs, path, e["size"])
            beside = self._content(fs, path + SIDE, 0) if self.side and e["side"] else None
            held.append({**e, "content": content, "ocr_text": _decoded(beside)})
            size += len(content or b"") + len(beside or b"")
            if size >= BATCH or len(held) >= 1024:
                yield pa.RecordBatch.from_pylist(held, schema=shape)
                held, size = [], 0
        if held:
            yield pa.RecordBatch.from_pylist(held, schema=shape)

    def _pieces(self, part: Part, fs, base: str) -> Iterator[pa.RecordBatch]:
        shape = pa.schema([("source_id", pa.string()), ("ordinal", pa.int64()), ("at", pa.int64()), ("chunk", pa.binary())])
        for e in self._entries(part.folder):
            if e["size"] is None:
                continue
            at = 0
            for k, data in enumerate(self.chunks(fs, _places(base, e["path"]))):
                yield pa.RecordBatch.from_pylist([{"source_id": e["source_id"], "ordinal": k, "at": at, "chunk": data}], schema=shape)
                at += len(data)


def _decoded(data: bytes | None) -> str | None:
    try:
        return None if data is None else data.decode()
    except UnicodeDecodeError:
        return None


class ItemSource(DataSource):
    """``spark.read.format("sieveline_items")``. Options: root; folders (JSON: the plan's parts); side: whether texts beside
    items are read; pieces: rows are chunks of ``chunk`` bytes instead of items."""

    reader_type = ItemReader

    @classmethod
    def name(cls) -> str:
        return "sieveline_items"

    def schema(self) -> str:
        return PIECE if self.options.get("pieces") == "true" else ITEM

    def reader(self, schema) -> ItemReader:
        import json

        o = self.options
        return self.reader_type(o["root"], json.loads(o["folders"]), o.get("side") == "true", o.get("pieces") == "true", int(o.get("chunk", CHUNK)))


def load(spark: SparkSession, entries: DataFrame, root: str, side: bool = False, pieces: bool = False, chunk: int = CHUNK, source: type[ItemSource] = ItemSource) -> DataFrame:
    """The entries with content and ocr_text, or their pieces. The plan is made now, the files are read when rows are."""
    import json

    spark.dataSource.register(source)
    folder = plan(spark, entries, root)
    folders = [f"{folder}/{n}" for n in names(spark, folder) if n.startswith("part=")]
    options = {"root": root, "folders": json.dumps(folders), "side": str(side).lower(), "pieces": str(pieces).lower(), "chunk": str(chunk)}
    return spark.read.format(source.name()).options(**options).load()
