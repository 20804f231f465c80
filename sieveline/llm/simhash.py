"""Operator 10, SimHash near-dedup with pivot distance tables.

Fingerprints are 64 majority bits of the XXH64 hashes of a text's word shingles. Texts link at ``radius`` or fewer
differing bits; the search works on distinct fingerprints, so copies are never expanded into pairs.

Distance tables: every fingerprint gets its Hamming distances to reference fingerprints. If two fingerprints differ in r
bits, no coordinate differs by more than r, so pairs with a greater coordinate difference are discarded, and survivors
are verified on the fingerprints. The references are drawn at random. A table alone would compare all pairs, and random
distances lie so close together that no cell of them is small; which pairs meet at all is therefore settled by an exact
index. The 64 bits form six groups; at three or fewer differing bits at least three groups are equal, so fingerprints
stand in the lists of each choice of three groups (20 lists for each), which loses no pair. The tables then discard
within a list: of unrelated pairs there, about one in a thousand is left to be verified.

Lists are read as sorted runs, in vectors over all runs of a task at once. A run longer than ``block`` is put off and
compared in pairs of blocks of bounded size by many tasks. Only edges that join parts of a block are written, not pairs.
"""

from __future__ import annotations

from collections.abc import Iterator
from itertools import combinations

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from .common import save, table
from .components import components

#: Bits of the six groups of coordinates.
GROUPS = ((0, 11), (11, 11), (22, 11), (33, 11), (44, 10), (54, 10))

RADIUS = 3

#: Random references, drawn from this seed.
N_REFERENCES, REFERENCE_SEED = 64, 20101

#: Members of a list that one task compares with one another at once.
BLOCK = 2048

_SPREAD: np.ndarray | None = None


def _spread() -> np.ndarray:
    """For each byte, its bits as the eight byte lanes of a number, so that additions count bits in parallel."""
    global _SPREAD
    if _SPREAD is None:
        bits = np.unpackbits(np.arange(256, dtype=np.uint8).reshape(-1, 1), axis=1, bitorder="little")
        _SPREAD = np.ascontiguousarray(bits).view(np.uint64).ravel()
    return _SPREAD


def majority(hashes: np.ndarray) -> int:
    """A bit is 1 if it is set in over half of the 64-bit hashes; of none: 0."""
    n = len(hashes)
    if n == 0:
        return 0
    lanes, spread = hashes.view(np.uint8).reshape(-1, 8), _spread()
    starts = np.arange(0, n, 255)
    out = 0
    for j in range(8):
        sums = np.add.reduceat(spread[lanes[:, j]], starts)  # at most 255 a lane
        counts = sums.view(np.uint8).reshape(-1, 8).sum(axis=0, dtype=np.int64)
        out |= int(np.packbits(2 * counts > n, bitorder="little")[0]) << (8 * j)
    return out


def fingerprint(text: str | None, shingle: int = 3) -> int:
    """The fingerprint of a text: A-Z in lower case, words ``[^\\x20\\x09-\\x0D]+``, shingles of words joined by spaces."""
    from xxhash import xxh64_intdigest

    words = (text or "").encode("utf-8", "surrogatepass").lower().split()
    n = len(words)
    if n == 0:
        return 0
    joined = b" ".join(words)
    if n <= shingle:
        hashes = [xxh64_intdigest(joined, 42)]
    else:
        ends = np.cumsum(np.fromiter(map(len, words), np.int64, n) + 1)
        begins = (ends - np.fromiter(map(len, words), np.int64, n) - 1)[: n - shingle + 1].tolist()
        hashes = [xxh64_intdigest(joined[a:b], 42) for a, b in zip(begins, (ends - 1)[shingle - 1 :].tolist(), strict=True)]
    return majority(np.array(hashes, dtype=np.uint64))


def fingerprints(docs: DataFrame, shingle: int = 3) -> DataFrame:
    """(doc_id, fp) with fp as a signed 64-bit number."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            fps = np.array([fingerprint(t.as_py(), shingle) for t in batch.column(1)], dtype=np.uint64)
            yield pa.RecordBatch.from_arrays([batch.column(0), pa.array(fps.view(np.int64))], names=["doc_id", "fp"])

    return docs.select(F.col("doc_id").cast("long").alias("doc_id"), F.col("text").cast("string").alias("text")).mapInArrow(run, "doc_id long, fp long")


def references() -> np.ndarray:
    return np.random.default_rng(REFERENCE_SEED).integers(0, 1 << 64, N_REFERENCES, dtype=np.uint64)


def distance_table(fps: np.ndarray, refs: np.ndarray) -> np.ndarray:
    """Hamming distances, a row a fingerprint and a column a reference."""
    return np.bitwise_count(fps[:, None] ^ refs[None, :]).astype(np.int8)


def linked(x: np.ndarray, y: np.ndarray, dx: np.ndarray, dy: np.ndarray, radius: int) -> np.ndarray:
    """Indices of pairs (x[k], y[k]) within the radius: coordinates discard, survivors are verified."""
    left = np.flatnonzero(np.abs(dx[:, 0] - dy[:, 0]) <= radius)
    for c in range(1, dx.shape[1]):
        if not len(left):
            return left
        left = left[np.abs(dx[left, c] - dy[left, c]) <= radius]
    return left[np.bitwise_count((x[left] ^ y[left]).view(np.uint64)) <= radius]  # of signed numbers it would take the absolute value


class Forest:
    """Union-find over the fingerprints of a block; gives the edges that join its parts."""

    def __init__(self) -> None:
        self.up: dict[int, int] = {}

    def root(self, v: int) -> int:
        up = self.up
        while (p := up.get(v, v)) != v:
            up[v] = up.get(p, p)
            v = p
        return v

    def add(self, a: np.ndarray, b: np.ndarray) -> list[tuple[int, int]]:
        edges = []
        for x, y in zip(a.tolist(), b.tolist(), strict=True):
            r, s = self.root(x), self.root(y)
            if r != s:
                self.up[max(r, s)] = min(r, s)
                edges.append((x, y))
        return edges


EDGES = "a long, b long, put_off long"


def _edges_of(key: np.ndarray, fp: np.ndarray, refs: np.ndarray, radius: int) -> list[tuple[int, int]]:
    """Edges within runs of equal keys (sorted). Compares each row with the one d further, for d = 1, 2, ..."""
    forest, edges = Forest(), []
    coords = distance_table(fp.view(np.uint64), refs)
    alive = np.flatnonzero(key[:-1] == key[1:])
    d = 1
    while len(alive):
        hit = linked(fp[alive], fp[alive + d], coords[alive], coords[alive + d], radius)
        edges += forest.add(fp[alive[hit]], fp[alive[hit] + d])
        d += 1
        alive = alive[alive + d < len(key)]
        alive = alive[key[alive] == key[alive + d]]
    return edges


def _runs(radius: int, block: int):
    """mapInArrow over rows (key, fp) sorted by key: edges of runs up to ``block``; longer runs' keys are put off."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        refs = references()
        key, fp = np.empty(0, np.int64), np.empty(0, np.int64)
        long_key: int | None = None

        def out(k: np.ndarray, f: np.ndarray) -> pa.RecordBatch:
            starts = np.flatnonzero(np.r_[True, k[1:] != k[:-1]]) if len(k) else np.empty(0, np.int64)
            sizes = np.diff(np.r_[starts, len(k)])
            off = k[starts[sizes > block]].tolist()
            keep = np.repeat((sizes <= block) & (sizes > 1), sizes)
            edges = _edges_of(k[keep], f[keep], refs, radius)
            a, b = zip(*edges, strict=True) if edges else ((), ())
            nulls = [None] * len(edges)
            return pa.RecordBatch.from_arrays(
                [pa.array([*a, *([None] * len(off))], pa.int64()), pa.array([*b, *([None] * len(off))], pa.int64()), pa.array([*nulls, *off], pa.int64())], names=["a", "b", "put_off"]
            )

        for batch in batches:
            k, f = batch.column(0).to_numpy(), batch.column(1).to_numpy()
            if long_key is not None:  # the rest of a run that is put off already
                rest = np.searchsorted(k, long_key, side="right") if len(k) and k[0] == long_key else 0
                k, f = k[rest:], f[rest:]
                if not len(k):
                    continue
                long_key = None
            key, fp = np.r_[key, k], np.r_[fp, f]
            if not len(key):
                continue
            cut = int(np.searchsorted(key, key[-1], side="left"))  # the last run may go on in the next batch
            if len(key) - cut > block:
                long_key = int(key[-1])
                cut = len(key)
            if cut:
                yield out(key[:cut], fp[:cut])
                key, fp = key[cut:], fp[cut:]
        if len(key):
            yield out(key, fp)

    return run


def _blocks(radius: int):
    """applyInPandas over a pair of blocks (key, i, j) of a long run."""

    def run(pdf):
        import pandas as pd

        refs, forest, edges = references(), Forest(), []
        fp, blk = pdf["fp"].to_numpy(), pdf["blk"].to_numpy()
        i, j = int(pdf["i"].iloc[0]), int(pdf["j"].iloc[0])
        x, y = fp[blk == i], fp[blk == j]
        dx, dy = distance_table(x.view(np.uint64), refs), distance_table(y.view(np.uint64), refs)
        for k in range(len(x)):
            start = k + 1 if i == j else 0
            if start >= len(y):
                break
            ys, n = y[start:], len(y) - start
            hit = linked(np.broadcast_to(x[k], n), ys, np.broadcast_to(dx[k], (n, dx.shape[1])), dy[start:], radius)
            if len(hit):
                edges += forest.add(np.full(len(hit), x[k]), ys[hit])
        return pd.DataFrame(edges, columns=["a", "b"]).astype("int64")

    return run


def links(distinct: DataFrame, radius: int = RADIUS, block: int = BLOCK) -> DataFrame:
    """Edges (a, b) between distinct fingerprints ``fp`` that connect all that lie within ``radius`` bits (at most 3)."""
    if not 0 <= radius <= 3:
        raise ValueError("six groups of coordinates find pairs of up to three differing bits")
    keys = []
    for n, chosen in enumerate(combinations(range(len(GROUPS)), 3)):
        mask = 0
        for g in chosen:
            mask |= ((1 << GROUPS[g][1]) - 1) << GROUPS[g][0]
        mask -= (1 << 64) if mask >> 63 else 0
        keys.append(F.xxhash64(F.lit(n), F.col("fp").bitwiseAND(F.lit(mask))))
    # a chance collision of two keys only adds candidates
    listed = distinct.select("fp", F.explode(F.array(*keys)).alias("key")).select("key", "fp")
    runs = listed.repartition("key").sortWithinPartitions("key", "fp")
    found = save(runs.mapInArrow(_runs(radius, block), EDGES), "simhash-edges")
    off = found.where("put_off is not null").select(F.col("put_off").alias("key")).distinct()
    edges = found.where("put_off is null").select("a", "b")
    sizes = listed.join(off, "key", "left_semi").groupBy("key").agg(F.count("*").alias("n"))
    sizes = save(sizes.select("key", F.ceil(F.col("n") / F.lit(block)).cast("int").alias("blocks")), "simhash-long-lists")
    if sizes.limit(1).count():
        dealt = listed.join(sizes, "key").withColumn("blk", F.pmod(F.xxhash64("fp", F.lit(1)), F.col("blocks")).cast("int"))
        dealt = dealt.withColumn("o", F.explode(F.sequence(F.lit(0), F.col("blocks") - 1)))
        dealt = dealt.select("key", "fp", "blk", F.least("blk", "o").alias("i"), F.greatest("blk", "o").alias("j"))
        edges = edges.unionAll(dealt.groupBy("key", "i", "j").applyInPandas(_blocks(radius), "a long, b long"))
    return edges


def near_copies(docs: DataFrame, shingle: int = 3, radius: int = RADIUS) -> DataFrame:
    """A row per document: doc_id, fp (signed), component_id (the least doc_id that links reach, itself included).

    A null text counts as empty; texts without words have the fingerprint 0 and link with one another like any others.
    Equal texts share a fingerprint and thus a component. A null doc_id is ignored in the choice of the least id (a
    component of such rows only gets null). Repeated rows give equal rows, an empty table none; other columns are not
    read.
    """
    rows = save(fingerprints(docs, shingle), "simhash-rows")
    classes = save(rows.groupBy("fp").agg(F.min("doc_id").alias("least")), "simhash-classes")
    roots = components(links(classes.select("fp"), radius))
    rooted = classes.join(roots.withColumnRenamed("node", "fp"), "fp", "left").select("fp", "least", F.coalesce("root", "fp").alias("root"))
    rooted = save(rooted, "simhash-roots")
    least = rooted.groupBy("root").agg(F.min("least").alias("component_id"))
    named = save(rooted.join(least, "root").select("fp", "component_id"), "simhash-components")
    return rows.join(named, "fp").select("doc_id", "fp", "component_id")


def op10_simhash_pivots(spark: SparkSession, sf_dir: str) -> DataFrame:
    found = near_copies(table(spark, sf_dir, "documents").select("doc_id", "text"))
    return found.select("doc_id", F.lower(F.lpad(F.hex("fp"), 16, "0")).alias("fingerprint"), "component_id")


SQL = None
