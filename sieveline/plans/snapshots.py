"""Manifests as Merkle trees: a digest of each subtree of ids, and the ids in which two snapshots differ.

An entry belongs to the leaf that the first hexadecimal digits of its id's digest name. There are so many leaves that one
holds a few hundred entries, whatever the size of the manifest; a node above has up to sixteen children. Two trees are
compared from the root downwards: only subtrees whose digests differ are looked into, and only the entries of leaves that
differ are compared one by one.
"""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from ..sources.shared import new_path

#: Entries of a leaf, on average at most.
LEAF = 256

NODE = "level int, prefix string, entries long, digest string"


def levels_for(entries: int) -> int:
    """Digits that name a leaf."""
    levels = 0
    while entries > LEAF * 16**levels:
        levels += 1
    return levels


def _leaf(levels: int):
    return F.substring(F.sha2(F.col("source_id").cast("binary"), 256), 1, levels)


def _folded(parts):
    return F.sha2(F.array_join(parts, "").cast("binary"), 256)


def tree(manifest: DataFrame, levels: int) -> DataFrame:
    """(source_id, content_hash) -> the nodes (NODE) of all levels; level 0 is the root, which an empty manifest has too.

    A leaf's digest is that of its entries' digests in order, a node's that of its children's prefixes and digests in
    order. Null hashes differ from all others; of rows that repeat an id each counts."""
    spark = manifest.sparkSession
    hash_ = F.coalesce(F.concat(F.lit("="), F.col("content_hash")), F.lit("null"))
    entry = F.sha2(F.concat(F.sha2(F.col("source_id").cast("binary"), 256), hash_).cast("binary"), 256)
    leaves = manifest.groupBy(_leaf(levels).alias("prefix")).agg(F.count("*").alias("entries"), _folded(F.array_sort(F.collect_list(entry))).alias("digest"))
    path = new_path(spark, "leaves")
    leaves.select(F.lit(levels).alias("level"), "prefix", "entries", "digest").write.parquet(path)
    now = spark.read.schema(NODE).parquet(path)
    out = now
    for level in range(levels - 1, -1, -1):
        child = F.struct("prefix", "digest")
        up = now.groupBy(F.substring("prefix", 1, level).alias("above")).agg(F.sum("entries").alias("entries"), F.array_sort(F.collect_list(child)).alias("c"))
        now = up.select(F.lit(level).alias("level"), F.col("above").alias("prefix"), "entries", _folded(F.transform("c", lambda x: F.concat(x["prefix"], F.lit(":"), x["digest"]))).alias("digest"))
        out = out.unionAll(now)
    if not out.limit(1).count():
        out = spark.createDataFrame([(0, "", 0, None)], NODE).withColumn("digest", F.sha2(F.lit("").cast("binary"), 256))
    return out


def save_tree(spark: SparkSession, nodes: DataFrame, path: str) -> DataFrame:
    """Writes a tree, a folder a level, so that a comparison reads the levels that it needs."""
    nodes.write.mode("overwrite").partitionBy("level").parquet(path)
    return spark.read.schema(NODE).parquet(path)


def differing_leaves(before: DataFrame, after: DataFrame, levels: int) -> DataFrame:
    """(prefix) of the leaves in which two trees of equal depth differ, found from the root downwards."""
    spark = before.sparkSession
    open_ = spark.createDataFrame([("",)], "above string")
    for level in range(levels + 1):
        of = lambda t: t.where(F.col("level") == level).withColumn("above", F.substring("prefix", 1, max(level - 1, 0))).join(open_, "above", "left_semi").select("prefix", "digest")  # noqa: B023, E731
        both = of(before).join(of(after).withColumnRenamed("digest", "other"), "prefix", "full")
        unlike = both.where(~F.col("digest").eqNullSafe(F.col("other"))).select("prefix")
        path = new_path(spark, "unlike")
        unlike.write.parquet(path)
        unlike = spark.read.schema("prefix string").parquet(path)
        open_ = unlike.select(F.col("prefix").alias("above"))
    return unlike


def changes(before: DataFrame, after: DataFrame, trees: tuple[DataFrame, DataFrame] | None = None) -> DataFrame:
    """(source_id, change, before_hash, after_hash) of two manifests (source_id, content_hash) with unique ids: added, removed
    and changed entries. ``trees``: those of the manifests, of one depth, where they are kept; else they are made."""
    if trees is None:
        levels = levels_for(max(before.count(), after.count()))
        trees = tree(before, levels), tree(after, levels)
    else:
        levels = trees[0].agg(F.max("level")).first()[0]
    leaves = differing_leaves(*trees, levels)
    of = lambda m, name: m.select("source_id", F.col("content_hash").alias(name), _leaf(levels).alias("prefix"), F.lit(True).alias(f"in_{name}")).join(leaves, "prefix", "left_semi").drop("prefix")
    both = of(before, "before_hash").join(of(after, "after_hash"), "source_id", "full")
    change = F.when(F.col("in_before_hash").isNull(), "added").when(F.col("in_after_hash").isNull(), "removed").when(~F.col("before_hash").eqNullSafe(F.col("after_hash")), "changed")
    return both.withColumn("change", change).where("change is not null").select("source_id", "change", "before_hash", "after_hash")
