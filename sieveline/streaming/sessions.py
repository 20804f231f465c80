"""Sessions of a stream by event time: repeats are dropped, late rows are left out, a session is told once it is over."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

SESSION = "key string, began timestamp, ended timestamp, rows long, value double"


def sessions(events: DataFrame, key: str, time: str, ident: str, value: str, gap: str, late: str) -> DataFrame:
    """(key, began, ended, rows, value): runs of a key's rows, each up to ``gap`` after the one before; ``ended`` is the
    last row's time plus the gap.

    A row that comes again (by ``ident``) within ``late`` counts once. Rows that come later than ``late`` behind the newest
    time are left out. In a stream a session is told when the newest time is ``late`` past its end, and its state goes
    then: state is bounded by the keys that are active within gap and lateness. The same over a table tells all."""
    rows = events.withWatermark(time, late)
    rows = rows.dropDuplicatesWithinWatermark([ident]) if events.isStreaming else rows.dropDuplicates([ident])
    window = F.session_window(time, gap)
    out = rows.groupBy(F.col(key).alias("key"), window.alias("w")).agg(F.count(F.lit(1)).alias("rows"), F.sum(value).alias("value"))
    return out.select("key", F.col("w.start").alias("began"), F.col("w.end").alias("ended"), "rows", "value")
