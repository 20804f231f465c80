"""Connected components of a graph given as edges, by alternating large-star and small-star rounds (Kiveris et al., 2014).

Every round is a join and an aggregation; nothing is gathered on the driver but whether a round changed anything.
"""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .common import discard, save


def _large_star(edges: DataFrame) -> DataFrame:
    """Each node hangs its greater neighbours on its least neighbour (or itself)."""
    both = edges.unionAll(edges.select(F.col("b").alias("a"), F.col("a").alias("b")))
    least = both.groupBy("a").agg(F.min("b").alias("m")).select("a", F.least("a", "m").alias("m"))
    return both.where("b > a").join(least, "a").where("b <> m").select(F.col("b").alias("a"), F.col("m").alias("b"))


def _small_star(edges: DataFrame) -> DataFrame:
    """Each node hangs its lesser neighbours, and itself, on the least of them. Edges come as (a, b) with a > b."""
    least = edges.groupBy("a").agg(F.min("b").alias("m"))
    return edges.join(least, "a").where("b <> m").select(F.col("b").alias("a"), F.col("m").alias("b")).unionAll(least.select("a", F.col("m").alias("b")))


def components(edges: DataFrame, rounds: int = 60) -> DataFrame:
    """``(a, b)`` links -> ``(node, root)`` with the least node that links reach; nodes without links are not returned.

    Node ids are of any orderable type. Self-links and repeated links do no harm; an empty table gives no rows."""
    now = save(edges.where("a <> b").select(F.greatest("a", "b").alias("a"), F.least("a", "b").alias("b")).distinct(), "edges")
    for _ in range(rounds):
        large = _large_star(now).distinct()
        after = save(_small_star(large).distinct(), "edges")
        # done when every node hangs on one root and no root hangs on another
        ends = after.select(F.col("a").alias("v"), F.lit(1).alias("up"), F.lit(0).alias("down")).unionAll(after.select("b", F.lit(0), F.lit(1)))
        seen = ends.groupBy("v").agg(F.sum("up").alias("up"), F.max("down").alias("down"))
        open_ = seen.agg(F.coalesce(F.bool_or((F.col("up") > 1) | ((F.col("up") > 0) & (F.col("down") > 0))), F.lit(False))).first()[0]
        discard(now)
        now = after
        if not open_:
            return now.select(F.col("a").alias("node"), F.col("b").alias("root")).unionAll(now.select(F.col("b").alias("node"), F.col("b").alias("root")).distinct())
    raise RuntimeError(f"components did not settle in {rounds} rounds")
