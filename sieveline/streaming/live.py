"""Stage events of a run while it goes on: a stream over the items that its slices have written, and its metrics."""

from __future__ import annotations

from collections.abc import Callable, Iterator
from contextlib import contextmanager

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql import types as T
from pyspark.sql.streaming import StreamingQuery, StreamingQueryListener

from ..operators import items as ops
from ..sources.shared import make_folder, new_path, remove

#: Name of the metrics that a run's stream observes.
METRICS = "sieveline_items"


def counted(items: DataFrame) -> DataFrame:
    """The items, with counts that a listener gets once a batch: how many there were, and how many failed."""
    return items.observe(METRICS, F.count(F.lit(1)).alias("items"), F.count_if(F.col("exception_code").isNotNull()).alias("failed"))


class Counts(StreamingQueryListener):
    """Hands on the counts of each batch of one query: ``on_counts(items, failed)``."""

    def __init__(self, on_counts: Callable[[int, int], None], query: Callable[[], str | None]):
        self.on_counts, self.query = on_counts, query

    def onQueryStarted(self, event) -> None:
        pass

    def onQueryProgress(self, event) -> None:
        row = event.progress.observedMetrics.get(METRICS)
        if row is not None and row["items"] and str(event.progress.id) == self.query():
            self.on_counts(row["items"], row["failed"])

    def onQueryIdle(self, event) -> None:
        pass

    def onQueryTerminated(self, event) -> None:
        pass


@contextmanager
def events(
    spark: SparkSession, folder: str, schema: T.StructType, engine: str, on_event: Callable[[dict], None], on_counts: Callable[[int, int], None] | None = None, every: str = "100 milliseconds",
) -> Iterator[StreamingQuery]:
    """While the block runs, ``on_event`` gets the stage events of what is written below ``folder``, a batch at a time, in
    the order of ids and stages. What was written last is handed on before the block is left; then the stream ends. A run
    whose events are followed is small, so the driver may read them one by one. ``on_counts``: also counts by batch."""
    checkpoint = new_path(spark, "live")
    make_folder(spark, folder)

    def hand_on(batch: DataFrame, number: int) -> None:
        # one job and no sampling for a sort: what is observed counts each time that rows are computed
        for r in ops.events(batch, engine).coalesce(1).sortWithinPartitions("source_id", "ordinal").collect():
            on_event({"source_id": r["source_id"], "stage": r["stage"], "outcome": r["outcome"], "exception_code": r["exception_code"]})

    started: list[str] = []
    listener = Counts(on_counts, lambda: started[0] if started else None) if on_counts is not None else None
    if listener is not None:
        spark.streams.addListener(listener)
    stream = counted(spark.readStream.schema(schema).option("recursiveFileLookup", True).parquet(folder))
    query = stream.writeStream.foreachBatch(hand_on).option("checkpointLocation", checkpoint).trigger(processingTime=every).start()
    started.append(str(query.id))
    try:
        yield query
        query.processAllAvailable()
    finally:
        query.stop()
        if listener is not None:
            spark.streams.removeListener(listener)
        remove(spark, checkpoint)
