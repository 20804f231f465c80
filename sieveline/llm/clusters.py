"""Operator 11, centroid clustering (Lloyd's rounds over whole numbers) with annulus search.

Vectors are turned into whole numbers once and saved; every distance, sum and mean after that is exact. A round is one pass
over the saved vectors. Centroids are sorted by their norm. A vector's distance to the centroid whose norm is nearest to its
own (a binary search) is an upper bound u of its least distance; by the triangle inequality no centroid whose norm differs
by more than u can be nearer. The centroids of that annulus, its boundary included, are found by two more binary searches
and compared exactly; ties go to the smaller number. A task adds up the vectors of each cluster before anything is
shuffled: a row a cluster and component. The driver holds the centroids alone.
"""

from __future__ import annotations

from collections.abc import Iterator
from dataclasses import dataclass

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from .common import Scratch, table

#: Whole numbers of a component lie within this bound (below 2**27), so that squared distances of up to 2**7 components fit
#: 63 bits; other vectors are too far out for a distance of 64 bits.
BOUND = 1 << 27

#: Vectors that are compared at once.
SLICE = 4096


@dataclass(frozen=True)
class Clustering:
    """k: centroids at the start (bounded: tasks and the driver hold them); rounds: of assignment and replacement; dim:
    components of a vector, up to 128; scale: a component x becomes floor(scale * x); seed: of the choice of the first
    centroids."""

    k: int = 8
    rounds: int = 10
    dim: int = 64
    scale: int = 1024
    seed: int = 3

    def __post_init__(self) -> None:
        if not (self.k > 0 and self.rounds >= 0 and 0 < self.dim <= 128):
            raise ValueError("k from 1, rounds from 0, dim from 1 to 128")


def whole_numbers(vectors: DataFrame, c: Clustering) -> DataFrame:
    """(vec_id, v array<int>) of the vectors that take part."""
    x = F.col("embedding").cast("array<double>")
    limit = float(BOUND)
    fine = F.forall(x, lambda y: F.coalesce(~F.isnan(y) & (F.abs(y) < F.lit(float("inf"))), F.lit(False)) & (F.abs(F.floor(y * F.lit(float(c.scale))).cast("double")) < F.lit(limit)))
    kept = vectors.where(F.coalesce(F.size(F.col("embedding")) == c.dim, F.lit(False)) & F.coalesce(fine, F.lit(False)))
    return kept.select(F.col("vec_id").cast("long").alias("vec_id"), F.transform(x, lambda y: F.floor(y * F.lit(float(c.scale))).cast("int")).alias("v"))


def first_centroids(rows: DataFrame, c: Clustering) -> np.ndarray:
    """The k vectors with the least hashes of seed and id, in that order; equal hashes go by the vectors themselves."""
    name = F.concat(F.lit(f"{c.seed}:"), F.coalesce(F.col("vec_id").cast("string"), F.lit("")))
    chosen = rows.select(F.sha2(name.cast("binary"), 256).alias("h"), "v").orderBy("h", "v").limit(c.k).collect()
    return np.array([r["v"] for r in chosen], dtype=np.int64).reshape(-1, c.dim)


class Annulus:
    """Centroids sorted by norm, for the exact nearest one of many vectors."""

    def __init__(self, centroids: np.ndarray):
        norms = np.sqrt((centroids.astype(np.float64) ** 2).sum(axis=1))
        self.order = np.argsort(norms, kind="stable")
        self.norms, self.sorted = norms[self.order], centroids[self.order]

    def near(self, v: np.ndarray) -> tuple[np.ndarray, np.ndarray, int]:
        """(cluster, squared distance, comparisons) of whole-number vectors."""
        norm = np.sqrt((v.astype(np.float64) ** 2).sum(axis=1))
        at = np.searchsorted(self.norms, norm)
        left, right = np.maximum(at - 1, 0), np.minimum(at, len(self.norms) - 1)
        start = np.where(np.abs(self.norms[left] - norm) <= np.abs(self.norms[right] - norm), left, right)
        best = self._squared(v, self.sorted[start])
        number = self.order[start].copy()
        # floating point may move a norm by a few units of its last place: the annulus is that much wider
        upper = np.sqrt(best.astype(np.float64))
        slack = (norm + upper + self.norms[-1]) * 1e-12
        low = np.searchsorted(self.norms, norm - upper - slack, side="left")
        high = np.searchsorted(self.norms, norm + upper + slack, side="right")
        compared = len(v)
        for j in range(int(low.min()), int(high.max())) if len(v) else ():
            rows = np.flatnonzero((low <= j) & (j < high) & (start != j))
            if not len(rows):
                continue
            compared += len(rows)
            d = self._squared(v[rows], self.sorted[j])
            better = (d < best[rows]) | ((d == best[rows]) & (self.order[j] < number[rows]))
            best[rows[better]], number[rows[better]] = d[better], self.order[j]
        return number, best, compared

    @staticmethod
    def _squared(v: np.ndarray, c: np.ndarray) -> np.ndarray:
        d = v - c
        return np.einsum("ij,ij->i", d, d)


def _vectors(column: pa.Array, dim: int) -> Iterator[tuple[int, np.ndarray]]:
    flat = column.flatten().to_numpy(zero_copy_only=False).reshape(-1, dim)
    for at in range(0, len(flat), SLICE):
        yield at, flat[at : at + SLICE].astype(np.int64)


def _sums(centroids, dim: int):
    """mapInArrow: (v) -> (cluster, i, n, s): of each cluster that the task has met the sums of its vectors' components."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        search, k = Annulus(centroids.value), len(centroids.value)
        n, sums = np.zeros(k, np.int64), np.zeros((k, dim), np.int64)
        for batch in batches:
            for _, v in _vectors(batch.column(0), dim):
                number, _, _ = search.near(v)
                n += np.bincount(number, minlength=k)
                by = np.argsort(number, kind="stable")
                first = np.flatnonzero(np.r_[True, np.diff(number[by]) > 0])
                sums[number[by][first]] += np.add.reduceat(v[by], first, axis=0)
        met = np.flatnonzero(n)
        at = pa.array(np.repeat(met, dim).astype(np.int32)), pa.array(np.tile(np.arange(dim, dtype=np.int32), len(met)))
        yield pa.RecordBatch.from_arrays([*at, pa.array(np.repeat(n[met], dim)), pa.array(sums[met].ravel())], names=["cluster", "i", "n", "s"])

    return run


def _assigned(centroids, dim: int):
    """mapInArrow: (vec_id, v) -> (vec_id, cluster, distance)."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        search = Annulus(centroids.value)
        for batch in batches:
            for at, v in _vectors(batch.column(1), dim):
                number, distance, _ = search.near(v)
                yield pa.RecordBatch.from_arrays([batch.column(0).slice(at, len(v)), pa.array(number.astype(np.int32)), pa.array(distance)], names=["vec_id", "cluster", "distance"])

    return run


def _replaced(rows: DataFrame, centroids: np.ndarray, c: Clustering) -> np.ndarray:
    """The centroids after a round: means rounded down, exactly; empty clusters keep theirs."""
    sent = rows.sparkSession.sparkContext.broadcast(centroids)
    parts = rows.select("v").mapInArrow(_sums(sent, c.dim), "cluster int, i int, n long, s long")
    out = centroids.copy()
    for r in parts.groupBy("cluster", "i").agg(F.sum("n").alias("n"), F.sum(F.col("s").cast("decimal(20,0)")).alias("s")).collect():  # k times dim rows
        out[r["cluster"], r["i"]] = int(r["s"]) // r["n"]
    sent.destroy()
    return out


def centroids_of(rows: DataFrame, c: Clustering) -> np.ndarray:
    """The centroids after all rounds of the saved vectors (vec_id, v); a round that changes nothing is the last."""
    now = first_centroids(rows, c)
    for _ in range(c.rounds if len(now) else 0):
        after = _replaced(rows, now, c)
        if (after == now).all():
            break
        now = after
    return now


def clustered(vectors: DataFrame, c: Clustering = Clustering()) -> DataFrame:
    """A row per vector that takes part: vec_id, cluster, distance (squared), centroid (array), cluster_inertia, inertia.

    Left out are vectors that are null, of another length than ``dim``, with a null or non-finite component, or with a
    component beyond ``BOUND`` after scaling. Repeated rows and ids count as often as they come; rows without an id hash as
    an empty id. With fewer than k vectors each is a centroid; an empty table gives no rows. Other columns are not read."""
    spark, scratch = vectors.sparkSession, Scratch()
    rows = scratch.save(whole_numbers(vectors, c), "cluster-vectors")
    centroids = centroids_of(rows, c)
    schema = "vec_id long, cluster int, distance long"
    if not len(centroids):
        none = spark.createDataFrame([], f"{schema}, centroid array<long>, cluster_inertia long, inertia long")
        scratch.clear()
        return none
    sent = spark.sparkContext.broadcast(centroids)
    told = scratch.save(rows.mapInArrow(_assigned(sent, c.dim), schema), "cluster-assigned")
    sent.destroy()
    sums = {r["cluster"]: int(r["d"]) for r in told.groupBy("cluster").agg(F.sum(F.col("distance").cast("decimal(20,0)")).alias("d")).collect()}
    scratch.clear(told)
    facts = [(n, centroids[n].tolist(), d, sum(sums.values())) for n, d in sums.items()]  # k rows
    small = spark.createDataFrame(facts, "cluster int, centroid array<long>, cluster_inertia long, inertia long")
    return told.join(F.broadcast(small), "cluster").select("vec_id", "cluster", "distance", "centroid", "cluster_inertia", "inertia")


def _digest(centroid: Column) -> Column:
    return F.sha2(F.array_join(centroid.cast("array<string>"), ",").cast("binary"), 256)


def op11_annulus_clusters(spark: SparkSession, sf_dir: str) -> DataFrame:
    rows = clustered(table(spark, sf_dir, "embeddings").select("vec_id", "embedding"))
    return rows.select("vec_id", "cluster", "distance", "cluster_inertia", "inertia", _digest(F.col("centroid")).alias("centroid_sha256"))


def _sql(c: Clustering) -> str:
    """Every round as three steps: components by vector and centroid, the nearest, the means."""
    kept = (
        f"v0 AS (SELECT vec_id, embedding::DOUBLE[] AS x FROM embeddings WHERE len(embedding) = {c.dim}), "
        f"v AS MATERIALIZED (SELECT row_number() OVER () AS rid, vec_id, list_transform(x, lambda y: floor(y * {c.scale})::BIGINT) AS v FROM v0 WHERE len(list_filter(x, lambda y: y IS NULL OR NOT isfinite(y))) = 0), "
        f"c0 AS MATERIALIZED (SELECT row_number() OVER (ORDER BY sha256('{c.seed}:' || coalesce(vec_id::VARCHAR, '')), v) - 1 AS k, v AS c FROM v QUALIFY k < {c.k}), "
    )
    near = lambda n: (
        f"a{n} AS MATERIALIZED (SELECT rid, arg_min(k, (d, k)) AS k, min(d) AS d FROM (SELECT rid, k, list_sum(list_transform(list_zip(v, c), lambda z: ((z[1] - z[2]) * (z[1] - z[2]))::HUGEINT)) AS d FROM v, c{n}) GROUP BY rid), "
    )
    mean = lambda n: (
        f"m{n} AS (SELECT k, i, sum(x) AS s, count(*) AS n FROM (SELECT k, unnest(v) AS x, generate_subscripts(v, 1) AS i FROM v JOIN a{n} USING (rid)) GROUP BY k, i), "
        f"n{n} AS (SELECT k, list(((s - ((s % n + n) % n)) / n)::BIGINT ORDER BY i) AS c FROM m{n} GROUP BY k), "
        f"c{n + 1} AS MATERIALIZED (SELECT k, coalesce(n{n}.c, c{n}.c) AS c FROM c{n} LEFT JOIN n{n} USING (k)), "
    )
    last = c.rounds
    return (
        "WITH " + kept + "".join(near(n) + mean(n) for n in range(last)) + near(last).rstrip(", ") + " "
        f"SELECT vec_id, k::INTEGER AS cluster, d::BIGINT AS distance, sum(d) OVER (PARTITION BY k)::BIGINT AS cluster_inertia, sum(d) OVER ()::BIGINT AS inertia, "
        f"sha256(array_to_string(c, ',')) AS centroid_sha256 FROM a{last} JOIN v USING (rid) JOIN c{last} USING (k)"
    )


SQL = _sql(Clustering())
