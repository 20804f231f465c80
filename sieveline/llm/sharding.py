"""Operator 1, sharding: jump consistent hashing of stable keys (Lamping and Veach, 2014), in native expressions.

A key's shard follows from the key and the number of shards alone; with one more shard only the rows that the new
shard takes move. There is no ring table, and no state.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from .common import join_small, save, table

#: The multiplier of the generator in the published algorithm.
MULTIPLIER = 2862933555777941757

#: More jumps than this have a probability under 1e-20 for up to a million shards; such a row would raise an error.
MAX_JUMPS = 64

N_SHARDS = 24


def _step(hi: Column, lo: Column) -> tuple[Column, Column]:
    """key * MULTIPLIER + 1 modulo 2^64, in halves of 32 bits, so that no product overflows under ANSI rules."""
    m32, m16 = F.lit((1 << 32) - 1), F.lit((1 << 16) - 1)
    c_hi, c_lo = MULTIPLIER >> 32, MULTIPLIER & ((1 << 32) - 1)
    c0, c1 = F.lit(c_lo & 0xFFFF).cast("long"), F.lit(c_lo >> 16).cast("long")
    high = lo * c1
    low = lo * c0 + F.lit(1).cast("long") + F.shiftleft(high.bitwiseAND(m16), 16)
    top = (
        F.shiftright(low, 32)
        + F.shiftright(high, 16)
        + (lo * F.lit(c_hi).cast("long")).bitwiseAND(m32)
        + (hi * c0).bitwiseAND(m32)
        + F.shiftleft((hi * c1).bitwiseAND(m16), 16)
    )
    return top.bitwiseAND(m32), low.bitwiseAND(m32)


def jump_hash(key: Column, n: int) -> Column:
    """The shard (0 to n - 1) of a 64-bit key."""
    start = F.struct(
        F.shiftrightunsigned(key, 32).alias("hi"),
        key.bitwiseAND(F.lit((1 << 32) - 1)).alias("lo"),
        F.lit(-1).cast("long").alias("b"),
        F.lit(0).cast("long").alias("j"),
    )

    def jump(s: Column, _: Column) -> Column:
        hi, lo = _step(s["hi"], s["lo"])
        moved = F.transform(
            F.array(F.struct(hi.alias("hi"), lo.alias("lo"))),
            lambda k: F.struct(
                k["hi"].alias("hi"),
                k["lo"].alias("lo"),
                s["j"].alias("b"),
                F.floor((s["j"] + F.lit(1).cast("long")).cast("double") * (F.lit(2147483648.0) / (F.shiftright(k["hi"], 1) + F.lit(1).cast("long")).cast("double"))).alias("j"),
            ),
        )[0]
        return F.when(s["j"] < F.lit(n), moved).otherwise(s)

    def close(s: Column) -> Column:
        return F.when(s["j"] < F.lit(n), F.raise_error(F.lit("jump hash: too many jumps")).cast("int")).otherwise(s["b"].cast("int"))

    return F.aggregate(F.sequence(F.lit(1), F.lit(min(n, MAX_JUMPS))), start, jump, close)


def shard(docs: DataFrame, key: str = "doc_id", text: str = "text", n_shards: int = N_SHARDS, digits: int = 2) -> DataFrame:
    """A row per document: key, size, text_crc32, law, shard, slot, grown_shard.

    ``slot`` numbers the rows of a shard from 0 without gaps. It is counted in 16**digits even parts of each shard, by a
    digest of the key, so no shard is sorted in one task; the parts' offsets (n_shards * 16**digits rows) are joined back.
    A null key counts as the key 0 and keeps its null; a null text has no bytes (size 8, crc32 of nothing, 0). Repeated
    rows get a slot each. An empty table gives no rows; other columns are not read.
    """
    number = F.coalesce(F.col(key).cast("long"), F.lit(0).cast("long"))
    content = F.coalesce(F.col(text), F.lit("")).cast("binary")
    rows = docs.select(
        F.col(key).cast("long").alias("doc_id"),
        (F.octet_length(content) + 8).cast("long").alias("size"),
        F.crc32(content).alias("text_crc32"),
        jump_hash(number, n_shards).alias("shard"),
        jump_hash(number, n_shards + 1).alias("grown_shard"),
        F.substring(F.md5(number.cast("string").cast("binary")), 1, digits).alias("part"),
    )
    rows = save(rows, "shards")
    parts = rows.groupBy("shard", "part").agg(F.count("*").alias("n"))
    before = Window.partitionBy("shard").orderBy("part").rowsBetween(Window.unboundedPreceding, -1)
    parts = save(parts.select("shard", "part", F.coalesce(F.sum("n").over(before), F.lit(0)).alias("offset")), "shard-parts")
    ranked = rows.withColumn("rank", F.row_number().over(Window.partitionBy("shard", "part").orderBy("doc_id", "size", "text_crc32")))
    return join_small(ranked, parts, ["shard", "part"]).select(
        "doc_id", "size", "text_crc32", F.lit("key").alias("law"), "shard", (F.col("offset") + F.col("rank") - 1).cast("long").alias("slot"), "grown_shard"
    )


def op1_jump_sharding(spark: SparkSession, sf_dir: str) -> DataFrame:
    return shard(table(spark, sf_dir, "documents").select("doc_id", "text"))


SQL = f"""
WITH RECURSIVE ids AS (SELECT DISTINCT coalesce(doc_id, 0) AS id FROM documents),
walk AS (
  SELECT id, n, CASE WHEN id < 0 THEN id::HUGEINT + 18446744073709551616::HUGEINT ELSE id::HUGEINT END AS k, -1::BIGINT AS b, 0::BIGINT AS j
  FROM ids, (VALUES ({N_SHARDS}), ({N_SHARDS + 1})) AS s(n)
  UNION ALL
  SELECT id, n, k2, j, floor((j + 1)::DOUBLE * (2147483648.0::DOUBLE / ((k2 // 8589934592::HUGEINT) + 1)::DOUBLE))::BIGINT
  FROM (SELECT id, n, j, (k * {MULTIPLIER}::HUGEINT + 1) % 18446744073709551616::HUGEINT AS k2 FROM walk WHERE j < n)
),
jumped AS (SELECT id, max(b) FILTER (n = {N_SHARDS}) AS shard, max(b) FILTER (n = {N_SHARDS + 1}) AS grown FROM walk WHERE j >= n GROUP BY id),
crc_table AS (
  SELECT list(c ORDER BY i) AS t FROM (
    SELECT i, list_reduce(list_prepend(i, range(8)), lambda c, x: CASE WHEN c % 2 = 1 THEN xor(c // 2, 3988292384) ELSE c // 2 END) AS c FROM range(256) AS r(i))
),
hexed AS (SELECT doc_id, coalesce(text, '') AS text, hex(encode(coalesce(text, ''))) AS h FROM documents),
sums AS (
  SELECT doc_id, text, length(h) // 2 + 8 AS size,
    xor(list_reduce(list_prepend(4294967295::BIGINT, list_transform(range(length(h) // 2), lambda i: ('0x' || substr(h, (2 * i + 1)::BIGINT, 2))::BIGINT)),
      lambda c, b: xor(c // 256, t[xor(c % 256, b) + 1])), 4294967295::BIGINT) AS crc
  FROM hexed, crc_table
)
SELECT doc_id, size::BIGINT AS size, crc::BIGINT AS text_crc32, 'key' AS law, shard::INTEGER AS shard,
  (row_number() OVER (PARTITION BY shard ORDER BY substr(md5(coalesce(doc_id, 0)::VARCHAR), 1, 2), doc_id NULLS FIRST, size, crc) - 1)::BIGINT AS slot,
  grown::INTEGER AS grown_shard
FROM sums JOIN jumped ON jumped.id = coalesce(doc_id, 0)
"""
