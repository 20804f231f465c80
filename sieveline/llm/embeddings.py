"""Operator 9, embedding near-dedup with a pivot-permutation index.

Reference points (pivots) are drawn from the vectors, far apart from one another whatever the vectors' spread. How long
descriptions must be, and in how many lists vectors must stand, is found on pairs made at the threshold. Each vector is described by the ordered list of its nearest pivots.
A vector stands in the inverted lists of its first ``listed`` pivots. Two vectors of a list are candidates if their
descriptions share at least two pivots; candidates are verified by cosine in double precision. A pair that meets in
several lists counts only in that of its least shared pivot. A list of more than ``block`` vectors is replaced by finer
ones, one for each second pivot of a description, which loses no candidate, as candidates share two; what is still longer
is compared in pairs of blocks by many tasks.

Equal vectors are one class with a multiplicity, never expanded into pairs; only one row of each class goes to the lists.
Tasks give each class's number of links and edges that join the parts, not the pairs.
"""

from __future__ import annotations

from collections.abc import Iterator
from dataclasses import dataclass, replace

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from .common import Scratch, join_small, table
from .components import components


@dataclass(frozen=True)
class Index:
    """threshold: least cosine of a link; settings: (pivots in a description, lists that a vector stands in), tried in this
    order until ``recall`` of made pairs at the threshold are candidates; pivots: least and greatest number of pivots: at
    least the root of the number of vectors, and so many that a list has half a block on average (the greatest bounds what
    a task holds; lists then grow, and split by second pivots); sample, sample_bytes: vectors among which pivots are
    chosen, for each pivot, and the most that they may take on the driver; block: vectors that are compared at once; few:
    so many vectors are compared without an index."""

    threshold: float = 0.9
    settings: tuple[tuple[int, int], ...] = ((6, 3), (8, 4), (10, 5), (12, 6), (16, 8))
    recall: float = 0.93
    pivots: tuple[int, int] = (48, 8192)
    sample: int = 4
    sample_bytes: int = 64 << 20
    block: int = 1024
    few: int = 48

    @property
    def nearest(self) -> int:
        return self.settings[0][0]

    @property
    def listed(self) -> int:
        return self.settings[0][1]


def _usable(v: Column) -> Column:
    """Whether a vector has a direction: not null, without null or non-finite components, not zero."""
    fine = F.forall(v, lambda x: x.isNotNull() & ~F.isnan(x) & (F.abs(x) < F.lit(float("inf"))))
    return F.coalesce(fine, F.lit(False)) & F.exists(v, lambda x: x != 0)


def _unit(rows: np.ndarray) -> np.ndarray:
    rows = rows / np.abs(rows).max(axis=1, keepdims=True)  # so that squares of tiny or huge components stay finite
    return rows / np.linalg.norm(rows, axis=1, keepdims=True)


def _choose(units: np.ndarray, n: int) -> np.ndarray:
    """The places of up to n pivots, each the vector that is farthest from those before it. So a dense cluster has one
    before the others come that near, in data of any spread, and n are found unless there are fewer directions."""
    units = units.astype(np.float32)
    chosen, near = [0], units @ units[0]
    while len(chosen) < min(n, len(units)):
        k = int(np.argmin(near))
        if near[k] > 1 - 1e-6:
            break
        chosen.append(k)
        np.maximum(near, units @ units[k], out=near)
    return np.array(chosen)


def _recall(units: np.ndarray, pivots: np.ndarray, nearest: int, listed: int, threshold: float) -> float:
    """The part of pairs at the threshold that are candidates: each of half the units with a vector in the direction of
    one of the other half."""
    half = min(len(units) // 2, 1000)
    x, z = units[:half], units[half : 2 * half]
    away = z - (z * x).sum(axis=1, keepdims=True) * x
    size = np.linalg.norm(away, axis=1, keepdims=True)
    x, away = x[size[:, 0] > 1e-9], (away / np.maximum(size, 1e-9))[size[:, 0] > 1e-9]
    y = threshold * x + np.sqrt(max(1 - threshold**2, 0.0)) * away
    a, b = _described(x, pivots, nearest), _described(y, pivots, nearest)
    both = (a[:, :, None] == b[:, None, :]).sum(axis=(1, 2)) >= 2
    meet = (a[:, :listed, None] == b[:, None, :listed]).any(axis=(1, 2))
    return float((both & meet).mean()) if len(x) else 1.0


def asked_pivots(total: int, index: Index) -> int:
    return max(min(max(int(total**0.5), 2 * total * index.listed // index.block, index.pivots[0]), index.pivots[1], total // 2), 1)


def fit(classes: DataFrame, total: int, dim: int, index: Index) -> tuple[np.ndarray, Index]:
    """Pivots, and the index with the first setting that reaches its recall on them. If none does, there are half as many
    pivots, as descriptions then agree more often, and so on. Fitted on a bounded sample: the vectors with the least
    hashes, ``sample`` for a pivot and no more than ``sample_bytes``."""
    n = asked_pivots(total, index)
    size = max(min(n * index.sample, index.sample_bytes // (8 * dim)), 2)
    rows = classes.orderBy(F.xxhash64("cid"), "cid").limit(size).select("v").collect()
    units = _unit(np.array([r["v"] for r in rows], dtype=np.float64))
    mixed = units[np.random.default_rng(7).permutation(len(units))]
    order = _choose(units, n)
    while True:
        pivots = units[order]
        for k, setting in enumerate(index.settings):
            if _recall(mixed, pivots, *setting, index.threshold) >= index.recall:
                return pivots, replace(index, settings=index.settings[k:])
        if len(order) <= 2 * index.settings[-1][0]:
            return pivots, replace(index, settings=index.settings[-1:])
        order = order[: len(order) // 2]


def _rows(column: pa.Array, dim: int) -> np.ndarray:
    return column.flatten().to_numpy(zero_copy_only=False).astype(np.float64).reshape(-1, dim)


def _described(units: np.ndarray, pivots: np.ndarray, nearest: int) -> np.ndarray:
    """The nearest pivots of each vector, in order; a single pivot is joined by a made-up second one, which all share."""
    if len(pivots) < 2:
        return np.tile(np.array([0, 1], np.int32), (len(units), 1))
    near, k = -(units @ pivots.T), min(nearest, len(pivots))
    first = np.argpartition(near, k - 1, axis=1)[:, :k]
    order = np.lexsort((first, np.take_along_axis(near, first, axis=1)), axis=1)
    return np.take_along_axis(first, order, axis=1).astype(np.int32)


def _heads(pivots, dim: int, index: Index):
    """mapInArrow: (v) -> the pivots in whose lists the vectors stand, with how many of the batch's vectors do."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            if batch.num_rows:
                near = _described(_unit(_rows(batch.column(0), dim)), pivots.value, index.nearest)[:, : index.listed]
                p, n = np.unique(near, return_counts=True)
                yield pa.RecordBatch.from_arrays([pa.array(p.astype(np.int32)), pa.array(n.astype(np.int64))], names=["p", "n"])

    return run


def _listed(pivots, long_lists, dim: int, index: Index):
    """mapInArrow: (cid, n, v) -> a row for each list that the vector stands in. A key is the list's pivot and, for a list
    that is split, the second pivot plus one. The vector goes along as it is, in single precision if it came so."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        split = np.array(sorted(long_lists.value), np.int32)
        for whole in batches:
            for start in range(0, whole.num_rows, 1024):  # few vectors at once: each is repeated for its lists
                batch = whole.slice(start, 1024)
                cid, n, v = batch.column(0).to_numpy(), batch.column(1).to_numpy(), batch.column(2).flatten().to_numpy(zero_copy_only=False).reshape(-1, dim)
                near = _described(_unit(v.astype(np.float64)), pivots.value, index.nearest)
                row, keys = [], []
                for c in range(min(index.listed, near.shape[1])):
                    p = near[:, c].astype(np.int64)
                    long_ = np.isin(near[:, c], split)
                    row.append(np.flatnonzero(~long_))
                    keys.append(p[~long_] << 32)
                    for o in range(near.shape[1]):
                        if o != c:
                            row.append(np.flatnonzero(long_))
                            keys.append((p[long_] << 32) | (near[long_, o].astype(np.int64) + 1))
                at, k = np.concatenate(row), near.shape[1]
                ends = lambda width: pa.array(np.arange(0, (len(at) + 1) * width, width, dtype=np.int32))
                yield pa.RecordBatch.from_arrays(
                    [pa.array(np.concatenate(keys)), pa.array(cid[at]), pa.array(n[at]), pa.ListArray.from_arrays(ends(k), pa.array(near[at].ravel())), pa.ListArray.from_arrays(ends(dim), pa.array(v[at].ravel()))],
                    names=["key", "cid", "n", "near", "v"],
                )

    return run


def _hot(near: np.ndarray, ids: np.ndarray) -> np.ndarray:
    """One-hot rows of which of ``ids`` (sorted) stand in each list."""
    out = np.zeros((len(near), len(ids)), dtype=np.float32)
    if len(ids):
        at = np.searchsorted(ids, near)
        ok = (at < len(ids)) & (ids[np.minimum(at, len(ids) - 1)] == near)
        rows = np.repeat(np.arange(len(near)), near.shape[1]).reshape(near.shape)
        out[rows[ok], at[ok]] = 1
    return out


def _shared(x: np.ndarray, y: np.ndarray, below: int | None = None, other: int = -1) -> np.ndarray:
    """How many pivots (lesser than ``below``, other than ``other``) the descriptions share, for all pairs."""
    ids = np.intersect1d(x, y)
    ids = ids[ids != other] if below is None else ids[(ids < below) & (ids != other)]
    return _hot(x, ids) @ _hot(y, ids).T


def _linked(key: int, near_x, unit_x, near_y, unit_y, index: Index) -> np.ndarray:
    """Which pairs link and count in the list ``key``: those that share two pivots, and no lesser list."""
    p, q = key >> 32, (key & 0xFFFFFFFF) - 1
    hit = unit_x @ unit_y.T >= index.threshold
    if hit.any():
        hit &= _shared(near_x, near_y) >= 2
    if hit.any():
        hit &= _shared(near_x[:, : index.listed], near_y[:, : index.listed], p) == 0
    if hit.any() and q >= 0:
        hit &= _shared(near_x, near_y, q, p) == 0
    return hit


def _parts(hit: np.ndarray, cid: np.ndarray) -> np.ndarray:
    """The least id that each row of a symmetric link matrix reaches within it."""
    low = cid.copy()
    for _ in range(len(cid)):
        new = np.minimum(low, np.where(hit, low[None, :], np.iinfo(np.int64).max).min(axis=1))
        if (new == low).all():
            break
        low = new
    return low


FOUND = "cid long, links long, root long"


def _lists(dim: int, index: Index):
    """mapInArrow over listed rows sorted by key: links within lists. A list has up to ``block`` vectors."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        held: list[pa.RecordBatch] = []  # of one list, which goes on

        def of(batch: pa.RecordBatch) -> list[tuple]:
            key, cid, n = (batch.column(c).to_numpy() for c in range(3))
            near = batch.column(3).flatten().to_numpy().reshape(len(key), -1)
            unit = _unit(_rows(batch.column(4), dim))
            starts = np.flatnonzero(np.r_[True, key[1:] != key[:-1]])
            found = []
            for a, b in zip(starts.tolist(), [*starts[1:].tolist(), len(key)], strict=True):
                if b - a < 2:
                    continue
                s = slice(a, b)
                hit = _linked(int(key[a]), near[s], unit[s], near[s], unit[s], index)
                np.fill_diagonal(hit, False)
                rows = np.flatnonzero(hit.any(axis=1))
                if len(rows):
                    hit, ids = hit[np.ix_(rows, rows)], cid[s][rows]
                    found.append((ids, (hit * n[s][rows][None, :]).sum(axis=1), _parts(hit, ids)))
            return found

        def out(found: list[tuple]) -> pa.RecordBatch:
            return pa.RecordBatch.from_arrays([pa.array(np.concatenate(x).astype(np.int64)) for x in zip(*found, strict=True)], names=["cid", "links", "root"])

        for batch in batches:
            if not batch.num_rows:
                continue
            keys = batch.column(0)
            cut = int(np.searchsorted(keys.to_numpy(), keys[-1].as_py(), side="left"))
            if cut or (held and held[0].column(0)[0] != keys[0]):
                ready = [*held, batch.slice(0, cut)] if cut else held
                if found := of(pa.Table.from_batches(ready).combine_chunks().to_batches()[0]):
                    yield out(found)
                held = []
            held.append(batch.slice(cut))
        if held and (found := of(pa.Table.from_batches(held).combine_chunks().to_batches()[0])):
            yield out(found)

    return run


def _blocks(dim: int, index: Index):
    """applyInArrow over two blocks (key, i, j) of a long list."""

    def run(rows: pa.Table) -> pa.Table:
        rows = rows.combine_chunks()
        key, i, j = (rows.column(c)[0].as_py() for c in ("key", "i", "j"))
        cid, n, blk = (rows.column(c).to_numpy() for c in ("cid", "n", "blk"))
        near = pa.concat_arrays(rows.column("near").chunks).flatten().to_numpy().reshape(len(cid), -1)
        unit = _unit(_rows(pa.concat_arrays(rows.column("v").chunks), dim))
        a, b = np.flatnonzero(blk == i), np.flatnonzero(blk == j)
        hit = np.zeros((len(cid), len(cid)), bool)
        if len(a) and len(b):
            hit[np.ix_(a, b)] = _linked(key, near[a], unit[a], near[b], unit[b], index)
            np.fill_diagonal(hit, False)
            hit |= hit.T
        use = np.flatnonzero(hit.any(axis=1))
        hit, ids = hit[np.ix_(use, use)], cid[use]
        return pa.table({"cid": pa.array(ids), "links": pa.array((hit * n[use][None, :]).sum(axis=1).astype(np.int64)), "root": pa.array(_parts(hit, ids))})

    return run


def _whole(index: Index):
    """applyInArrow over all vectors (cid, n, v) of one length, where these are only a few."""

    def run(rows: pa.Table) -> pa.Table:
        rows = rows.combine_chunks()
        cid, n = rows.column("cid").to_numpy(), rows.column("n").to_numpy()
        unit = _unit(np.array(rows.column("v").to_pylist(), dtype=np.float64))
        hit = unit @ unit.T >= index.threshold
        np.fill_diagonal(hit, False)
        return pa.table({"cid": pa.array(cid), "links": pa.array((hit * n[None, :]).sum(axis=1).astype(np.int64)), "root": pa.array(_parts(hit, cid))}).filter(pa.array(hit.any(axis=1)))

    return run


def _links(classes: DataFrame, total: int, dim: int, index: Index, scratch: Scratch, sent: list) -> DataFrame:
    """(cid, links, root) of the classes (cid, n, v), all of one length, that have a link to another class. What tasks are
    sent is added to ``sent``."""
    context = classes.sparkSession.sparkContext
    chosen, index = fit(classes, total, dim, index)
    pivots = context.broadcast(chosen)
    sizes = classes.select("v").mapInArrow(_heads(pivots, dim, index), "p int, n long").groupBy("p").agg(F.sum("n").alias("n"))
    long_lists = context.broadcast([r["p"] for r in sizes.where(F.col("n") > index.block).select("p").collect()])  # pivots at most
    sent += [pivots, long_lists]
    listed = classes.select("cid", "n", "v").mapInArrow(_listed(pivots, long_lists, dim, index), f"key long, cid long, n long, near array<int>, v {classes.schema['v'].dataType.simpleString()}")
    short, found = listed, None
    if long_lists.value:
        fine = listed.where(F.col("key").bitwiseAND(F.lit(0xFFFFFFFF)) > 0).groupBy("key").agg(F.count("*").alias("size")).where(F.col("size") > index.block)
        fine = scratch.save(fine.select("key", F.ceil(F.col("size") / F.lit(index.block)).cast("int").alias("blocks")), "embedding-long-lists")
        if fine.limit(1).count():
            short = join_small(listed, fine.select("key"), ["key"], "left_anti")
            dealt = join_small(listed, fine, ["key"]).withColumn("blk", F.pmod(F.xxhash64("cid"), F.col("blocks")).cast("int"))
            dealt = dealt.withColumn("o", F.explode(F.sequence(F.lit(0), F.col("blocks") - 1)))
            dealt = dealt.select("key", "cid", "n", "near", "v", "blk", F.least("blk", "o").alias("i"), F.greatest("blk", "o").alias("j"))
            found = dealt.groupBy("key", "i", "j").applyInArrow(_blocks(dim, index), FOUND)
    runs = short.repartition("key").sortWithinPartitions("key").mapInArrow(_lists(dim, index), FOUND)
    return runs if found is None else runs.unionAll(found)


def _representatives(fine: DataFrame, classes: DataFrame, scratch: Scratch) -> DataFrame:
    """(cid, n, v): one row of each class, taken from the rows (vec_id, cid, v)."""
    several = scratch.save(classes.where("n > 1").select("cid", "n", "least", "again"), "embedding-several")
    rows = join_small(fine, several, ["cid"], "left").where(F.col("n").isNull() | F.col("vec_id").eqNullSafe(F.col("least")))
    one = rows.where(F.coalesce("again", F.lit(1)) == 1).select("cid", F.coalesce("n", F.lit(1)).alias("n"), "v")
    if several.where("again > 1").limit(1).count():  # rows that are equal in id and vector
        one = one.unionAll(rows.where("again > 1").select("cid", "n", "v").dropDuplicates(["cid"]))
    return one


def near_copies(vectors: DataFrame, index: Index = Index()) -> DataFrame:
    """A row per vector: vec_id, n_links, component_id, kept.

    Vectors that are null, empty or zero, or hold null or non-finite components, link with nothing: no links, a component
    of their own. Vectors of different lengths do not link. Equal vectors link, also ones without an id. Rows that repeat
    an id are judged by their vectors. A component is named by the least id in it; one without any id has the name null,
    and its rows count as kept, as do other rows without an id only if their component has none. An empty table gives no
    rows; other columns are not read. Vectors are told apart by 64 bits of XXH64.
    """
    scratch = Scratch()
    kind = vectors.schema["embedding"].dataType.simpleString()
    own = F.col("embedding") if kind == "array<float>" else F.col("embedding").cast("array<double>")
    rows = vectors.select(F.col("vec_id").cast("long").alias("vec_id"), F.when(_usable(F.col("embedding").cast("array<double>")), own).alias("v"))
    rows = rows.select("vec_id", "v", F.when(F.col("v").isNotNull(), F.xxhash64("v")).alias("cid"))
    fine = rows.where("v is not null")
    named = fine.groupBy("cid", "vec_id", F.size("v").alias("dim")).agg(F.count("*").alias("c"))
    least = F.min(F.struct(F.col("vec_id").isNull().alias("none"), F.col("vec_id").alias("id"), F.col("c").alias("again")))
    classes = named.groupBy("cid", "dim").agg(F.sum("c").alias("n"), least.alias("first")).select("cid", "dim", "n", F.col("first.id").alias("least"), F.col("first.again").alias("again"))
    classes = scratch.save(classes, "embedding-classes")
    one = _representatives(fine, classes, scratch)
    lengths = scratch.save(classes.groupBy("dim").agg(F.count("*").alias("size")), "embedding-lengths")
    rare, sent = lengths.where(F.col("size") <= index.few).select("dim"), []
    found = join_small(one.withColumn("dim", F.size("v")), rare, ["dim"], "left_semi").groupBy("dim").applyInArrow(_whole(index), FOUND)
    for r in lengths.where(F.col("size") > index.few).collect():  # usually there is one length
        found = found.unionAll(_links(one.where(F.size("v") == r["dim"]), r["size"], r["dim"], index, scratch, sent))
    found = scratch.save(found, "embedding-found")
    for x in sent:
        x.destroy()
    links = found.groupBy("cid").agg(F.sum("links").alias("links"))
    roots = components(found.select(F.col("cid").alias("a"), F.col("root").alias("b")))
    told = classes.join(links, "cid", "left").join(roots.withColumnRenamed("node", "cid"), "cid", "left")
    told = scratch.save(told.select("cid", "least", (F.coalesce("links", F.lit(0)) + F.col("n") - 1).alias("n_links"), F.coalesce("root", "cid").alias("root")), "embedding-told")
    scratch.clear(told)
    names = told.groupBy("root").agg(F.min("least").alias("component_id"))
    told = told.join(names, "root").select("cid", "n_links", "component_id")
    slim = rows.select("vec_id", "cid")
    linked = slim.where("cid is not null").join(told, "cid").select("vec_id", "n_links", "component_id")
    alone = slim.where("cid is null").select("vec_id", F.lit(0).cast("long").alias("n_links"), F.col("vec_id").alias("component_id"))
    return linked.unionAll(alone).withColumn("kept", F.col("vec_id").eqNullSafe(F.col("component_id")))


def op9_pivot_permutations(spark: SparkSession, sf_dir: str) -> DataFrame:
    return near_copies(table(spark, sf_dir, "embeddings").select("vec_id", "embedding"))

SQL = """
WITH RECURSIVE d AS (SELECT vec_id, embedding::DOUBLE[] AS v FROM embeddings),
f AS (SELECT vec_id, v, sqrt(list_dot_product(v, v)) AS norm FROM d WHERE v IS NOT NULL AND len(list_filter(v, lambda x: x IS NULL OR NOT isfinite(x))) = 0 AND len(list_filter(v, lambda x: x <> 0)) > 0),
l AS (SELECT a.vec_id AS a, b.vec_id AS b FROM f a JOIN f b ON a.vec_id <> b.vec_id AND len(a.v) = len(b.v) WHERE list_dot_product(a.v, b.v) / (a.norm * b.norm) >= 0.9),
r AS (SELECT vec_id AS node, vec_id AS root FROM d UNION SELECT l.b, r.root FROM r JOIN l ON l.a = r.node),
c AS (SELECT node, min(root) AS component_id FROM r GROUP BY node),
n AS (SELECT a, count(*) AS k FROM l GROUP BY a)
SELECT vec_id, coalesce(k, 0)::BIGINT AS n_links, component_id, vec_id = component_id AS kept FROM d JOIN c ON c.node = vec_id LEFT JOIN n ON n.a = vec_id
"""
