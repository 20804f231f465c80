"""Helpers that the operators share: tables, shared storage, word expressions, checked broadcasts."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from ..functions.text import let, once
from ..sources.shared import new_path, remove, shared_dir

__all__ = ["BLANKS", "BROADCAST_ROWS", "Scratch", "UPPER", "discard", "give_back", "join_small", "let", "lower_ascii", "n_words", "new_path", "once", "remove", "save", "shared_dir", "source_key", "table", "words"]

#: White space of the word definition ``[^\x20\x09-\x0D]+``.
BLANKS = " \t\n\x0b\x0c\r"
UPPER = "ABCDEFGHIJKLMNOPQRSTUVWXYZ"

#: A side of a join is broadcast only if it has no more rows than this; otherwise it is shuffled.
BROADCAST_ROWS = 20_000


def table(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    return spark.read.parquet(f"{sf_dir}/{name}.parquet")


def save(df: DataFrame, label: str) -> DataFrame:
    """Cuts the lineage: writes the rows as Parquet to the shared folder and reads them back.

    Lost executors then cost a re-read. The files stay until the folder is cleaned, as those of checkpoint() do."""
    spark = df.sparkSession
    path = new_path(spark, label)
    df.write.parquet(path)
    out = spark.read.schema(df.schema).parquet(path)
    out._sieveline_path = path
    return out


def discard(df: DataFrame) -> None:
    """Deletes what :func:`save` wrote for this frame."""
    if path := getattr(df, "_sieveline_path", None):
        remove(df.sparkSession, path)


class Scratch:
    """Saved tables of one call, removed together when what follows no longer reads them."""

    def __init__(self) -> None:
        self.frames: list[DataFrame] = []

    def save(self, df: DataFrame, label: str) -> DataFrame:
        self.frames.append(save(df, label))
        return self.frames[-1]

    def clear(self, *still_read: DataFrame) -> None:
        for df in self.frames:
            if not any(df is x for x in still_read):
                discard(df)
        self.frames = list(still_read)


def join_small(df: DataFrame, small: DataFrame, on: list[str], how: str = "inner", rows: int = BROADCAST_ROWS) -> DataFrame:
    """Joins a table that is usually small. Its rows are counted first: up to ``rows`` it is broadcast, above it the
    join is left to the planner, whose adaptive skew handling splits hot keys. Call it with a saved ``small``."""
    if small.limit(rows + 1).count() <= rows:
        small = F.broadcast(small)
    return df.join(small, on, how)


def give_back() -> None:
    """Returns memory that a Python worker has freed to the system: a reused worker then does not hold a former task's peak."""
    import ctypes

    import pyarrow as pa

    pa.default_memory_pool().release_unused()
    try:
        ctypes.CDLL(None).malloc_trim(0)
    except (AttributeError, OSError):  # another C library
        pass


def words(text: Column) -> Column:
    """The words ``[^\\x20\\x09-\\x0D]+`` of a text as an array; null text: none."""
    spaced = F.translate(F.coalesce(text, F.lit("")), BLANKS[1:], " " * 5)
    return F.array_remove(F.split(spaced, " "), "")


def lower_ascii(text: Column) -> Column:
    return F.translate(text, UPPER, UPPER.lower())


def n_words(text: Column) -> Column:
    return F.size(words(text)).cast("long")


def source_key(source: Column) -> Column:
    """A join key for a source: null is a source of its own."""
    return F.coalesce(F.concat(F.lit("="), source), F.lit("null"))
