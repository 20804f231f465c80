"""As-of joins and sessions of events."""

from __future__ import annotations

import datetime
import random

import pytest

from sieveline.operators.asof import as_of
from sieveline.streaming.sessions import SESSION, sessions

T0 = datetime.datetime(2024, 1, 1)
at = lambda minutes: None if minutes is None else T0 + datetime.timedelta(minutes=minutes)


def test_as_of_against_a_plain_search(spark):
    """Ties in time, null keys and times, keys without settings, a key with most rows over many days."""
    rng = random.Random(6)
    key = lambda: rng.choice(["hot"] * 6 + ["a", "b", None, "only left"])
    time = lambda: rng.choice([None, *range(0, 60_000, 37)])
    left = [(i, key(), time()) for i in range(900)]
    right = [(i, k if (k := key()) != "only left" else "a", time(), rng.choice(["x", "y", None])) for i in range(300)] + [(1000 + i, "hot", 37 * i % 700, "tie") for i in range(40)]
    l = spark.createDataFrame([(i, k, at(m), i, "s") for i, k, m in left], "id long, key string, at timestamp, n long, _s string")
    r = spark.createDataFrame([(i, k, at(m), v) for i, k, m, v in right], "seq long, key string, at timestamp, v string")

    def want(k, m):
        found = [(m2, i, v) for i, k2, m2, v in right if k is not None and m is not None and k2 == k and m2 is not None and m2 <= m]
        return max(found)[1:][::-1] if found else (None, None)

    for bucket in ("day", "year"):
        out = as_of(l, r, "key", "at", ["v", "seq"], "seq", bucket)
        assert out.columns == ["id", "key", "at", "n", "_s", "v", "seq"]
        got = {x["id"]: (x["v"], x["seq"]) for x in out.collect()}
        assert got == {i: want(k, m) for i, k, m in left}
    assert as_of(l.where("false"), r, "key", "at", ["v"], "seq").count() == 0 and as_of(l, r.where("false"), "key", "at", ["v"], "seq").where("v is not null").count() == 0
    with pytest.raises(ValueError):
        as_of(l.withColumn("v", l["n"]), r, "key", "at", ["v"], "seq")


def test_sessions_with_repeats_and_late_rows(spark, tmp_path):
    schema = "id long, user string, at timestamp, value double"

    def go(*rows):
        spark.createDataFrame([(i, u, at(m), v) for i, u, m, v in rows], schema).write.mode("append").parquet(str(tmp_path / "in"))
        stream = sessions(spark.readStream.schema(schema).parquet(str(tmp_path / "in")), "user", "at", "id", "value", "10 minutes", "30 minutes")
        stream.writeStream.format("parquet").option("path", str(tmp_path / "out")).option("checkpointLocation", str(tmp_path / "c")).trigger(availableNow=True).start().awaitTermination()
        return {(r["key"], r["began"], r["ended"], r["rows"], r["value"]) for r in spark.read.schema(SESSION).parquet(str(tmp_path / "out")).collect()}

    assert go((1, "a", 0, 1.0), (2, "a", 9, 2.0), (3, "a", 20, 4.0), (4, "b", 1, 1.0)) == set(), "none is over yet"
    one = go((2, "a", 9, 2.0), (5, "b", 12, 8.0), (6, "c", 60, 1.0))
    assert one == {("a", at(0), at(19), 2, 3.0), ("a", at(20), at(30), 1, 4.0), ("b", at(1), at(11), 1, 1.0), ("b", at(12), at(22), 1, 8.0)}, "a gap of more than ten minutes ends a session; row 2 counts once"
    late = go((7, "a", 5, 100.0), (8, "c", 70, 1.0))
    assert late == one, "a row that is more than half an hour late is left out"
    assert go((9, "d", 200, 1.0)) - one == {("c", at(60), at(80), 2, 2.0)}
    table = sessions(spark.createDataFrame([(1, "a", at(0), 1.0), (1, "a", at(0), 1.0), (2, "a", at(9), 2.0)], schema), "user", "at", "id", "value", "10 minutes", "30 minutes").collect()
    assert [tuple(r) for r in table] == [("a", at(0), at(19), 2, 3.0)]
