"""As-of joins: to each row the latest row of the same key that is not later, by a union and a last value over time."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F


def as_of(left: DataFrame, right: DataFrame, key: str, time: str, values: list[str], tie: str, bucket: str = "day") -> DataFrame:
    """The rows of ``left`` with the ``values`` of the right row in force: of those with its key and no later time the last,
    of several at one time that with the greatest ``tie``. Null where there is none; a null key or time has none.

    No range is joined. Rows of both sides meet in windows of a key and a span of time (``bucket``), so that a key that has
    a third of all rows is spread over its spans; what was in force when a span began comes from the last row of the key's
    earlier spans, one row a key and span that has any."""
    if clash := {*values, "_row", "_v", "_at", "_span", "_left"} & set(left.columns):
        raise ValueError(f"columns that the result would hold twice: {sorted(clash)}")
    at = lambda c: F.col(c)
    last = right.where(F.col(key).isNotNull() & F.col(time).isNotNull()).groupBy(at(key).alias("_key"), at(time).alias("_at")).agg(F.max_by(F.struct(*values), tie).alias("_v"))
    shape = last.schema["_v"].dataType
    last = last.withColumn("_span", F.date_trunc(bucket, "_at"))
    rows = left.select(F.struct("*").alias("_row"), at(key).alias("_key"), at(time).alias("_at"), F.date_trunc(bucket, time).alias("_span"))
    # right rows stand before left rows of one time
    both = rows.select("_row", "_key", "_at", "_span", F.lit(None).cast(shape).alias("_v"), F.lit(1).alias("_left")).unionByName(
        last.select(F.lit(None).cast(rows.schema["_row"].dataType).alias("_row"), "_key", "_at", "_span", "_v", F.lit(0).alias("_left"))
    )
    within = Window.partitionBy("_key", "_span").orderBy("_at", "_left").rowsBetween(Window.unboundedPreceding, Window.currentRow)
    held = both.withColumn("_v", F.last("_v", ignorenulls=True).over(within)).where("_left = 1")
    # at most one row a key and span: what was in force at the end of the key's spans before this one
    ends = last.groupBy("_key", "_span").agg(F.max_by("_v", "_at").alias("_end"))
    spans = rows.select("_key", "_span").where("_key is not null and _span is not null").distinct().join(ends, ["_key", "_span"], "full")
    earlier = Window.partitionBy("_key").orderBy("_span").rowsBetween(Window.unboundedPreceding, -1)
    begins = spans.withColumn("_begin", F.last("_end", ignorenulls=True).over(earlier)).where("_begin is not null").select("_key", "_span", "_begin")
    out = held.join(begins, ["_key", "_span"], "left").withColumn("_v", F.when(F.col("_key").isNotNull() & F.col("_at").isNotNull(), F.coalesce("_v", "_begin")))
    return out.select("_row.*", *[F.col("_v")[v].alias(v) for v in values])


def in_force(rows: DataFrame, is_setting: Column, key: str, time: str, value: str, tie: str) -> DataFrame:
    """The rows of one event table, each with the ``value`` of the setting that is in force for its key."""
    return as_of(rows, rows.where(is_setting).select(key, time, tie, F.col(value).alias("in_force")), key, time, ["in_force"], tie)
