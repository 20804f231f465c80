import zlib
from collections import Counter

from pyspark.sql import functions as F

from sieveline.llm import sharding

from . import edge


def jump(key: int, n: int) -> int:
    """The algorithm on Python's unbounded numbers."""
    key &= (1 << 64) - 1
    b, j = -1, 0
    while j < n:
        b = j
        key = (key * sharding.MULTIPLIER + 1) & ((1 << 64) - 1)
        j = int((b + 1) * (2147483648.0 / ((key >> 33) + 1)))
    return b


def test_jump_hash_matches_brute_force(spark):
    keys = [0, 1, -1, 2**62, -(2**63), 2**63 - 1, *range(500), *[k * 7919**3 for k in range(200)]]
    df = spark.createDataFrame([(k,) for k in keys], "k long")
    for n in (1, 2, 24, 25, 1000):
        got = {r["k"]: r["s"] for r in df.select("k", sharding.jump_hash(F.col("k"), n).alias("s")).collect()}
        assert got == {k: jump(k, n) for k in keys}


def test_rows_of_edge_cases(spark):
    got = sharding.shard(edge.docs(spark)).collect()
    want = edge.rows()
    assert len(got) == len(want)
    assert Counter((r["doc_id"], r["size"], r["text_crc32"]) for r in got) == Counter((r[0], len((r[1] or "").encode()) + 8, zlib.crc32((r[1] or "").encode())) for r in want)
    for s in {r["shard"] for r in got}:
        assert sorted(r["slot"] for r in got if r["shard"] == s) == list(range(sum(r["shard"] == s for r in got)))
    assert all(r["grown_shard"] in (r["shard"], 24) for r in got)
    assert sharding.shard(edge.empty(spark)).count() == 0
