"""Record linkage of two tables: blocks of bounded size, agreement patterns, Fellegi-Sunter weights by EM, ratings.

Equal records of a side are one record first. Each blocking rule lists expressions from coarse to fine: records meet that
agree in the first; a block with more than ``most`` records is divided by the next one, at last by all fields, so that no
key, however common, makes a block of unbounded size, and pairs grow with the records. A null in a rule's first expression
makes no block. Pairs are compared within blocks, once whatever the number of their rules; only their ids and agreement
levels are shuffled. The model is fitted on counts of patterns, whose number the fields' levels bound, not the data: chance agreement on about
as many pairs as there are records, drawn by hash; agreement of matches by EM within the pairs of each rule, over the
fields that the rule does not look at, as its pairs are chosen by the others.
"""

from __future__ import annotations

import re
from dataclasses import dataclass
from math import log2, prod

import numpy as np
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from ..sources.shared import new_path

#: The level of a pair in a field that one of them lacks: it says nothing.
MISSING = -1


@dataclass(frozen=True)
class Linkage:
    """fields: by field, the conditions over ``l`` and ``r`` from the strongest level to the weakest (beyond: disagreement);
    rules: blocking rules, SQL expressions over fields; most: records of a block; accept, review: least posteriors."""

    fields: dict[str, tuple[str, ...]]
    rules: tuple[tuple[str, ...], ...]
    most: int = 64
    accept: float = 0.95
    review: float = 0.5


def _distinct(df: DataFrame, key: str, spec: Linkage) -> DataFrame:
    return df.groupBy(*spec.fields).agg(F.min(key).alias("_id"), F.count("*").alias("_n"))


def blocked(rows: DataFrame, spec: Linkage) -> DataFrame:
    """``rows`` (with _side) once a rule with the key of their block: the coarsest that has at most ``most`` records, or
    else that of all fields, where equal records of both sides meet."""
    depth = max(map(len, spec.rules)) + 1

    def keys(i: int, rule: tuple[str, ...]) -> Column:
        level = lambda j: F.xxhash64(F.lit(i), F.lit(j), *[F.coalesce(F.expr(f"string({e})"), F.lit("\0")) for e in rule[:j]])
        every = F.xxhash64(F.lit(i), F.lit(-1), *[F.coalesce(F.col(c).cast("string"), F.lit("\0")) for c in spec.fields])
        made = [level(j) for j in range(1, len(rule) + 1)]
        return F.when(F.expr(rule[0]).isNotNull(), F.array(*made, *[every] * (depth - len(made))))

    out = rows.select("*", F.posexplode(F.array(*[keys(i, r) for i, r in enumerate(spec.rules)])).alias("_rule", "_keys")).where(F.col("_keys").isNotNull())
    sized = out.select(F.explode(F.array_distinct("_keys")).alias("_key")).groupBy("_key").count()
    large = sized.where(F.col("count") > spec.most).select("_key", F.lit(True).alias("_large"))
    for j in range(depth - 1):
        out = out.withColumn("_key", F.col("_keys")[j]).join(large.withColumnRenamed("_large", f"_large{j}"), "_key", "left").drop("_key")
    fine = F.coalesce(*[F.when(F.col(f"_large{j}").isNull(), F.col("_keys")[j]) for j in range(depth - 1)], F.col("_keys")[depth - 1])
    return out.withColumn("_block", fine).drop("_keys", *[f"_large{j}" for j in range(depth - 1)])


def _pattern(spec: Linkage) -> Column:
    """The agreement level by field of a pair of records ``l`` and ``r``, joined by commas."""

    def level(field: str, conditions: tuple[str, ...]) -> Column:
        out = F.when(F.col("l")[field].isNull() | F.col("r")[field].isNull(), MISSING)
        for i, c in enumerate(conditions):
            out = out.when(F.expr(c), i)
        return out.otherwise(len(conditions)).cast("string")

    return F.concat_ws(",", *[level(*x) for x in spec.fields.items()]).alias("pattern")


def patterns(left: DataFrame, right: DataFrame, left_id: str, right_id: str, spec: Linkage) -> DataFrame:
    """A row per pair that meets in a block: l_id, r_id, the least ids of the two records; ``pattern``, the agreement level
    by field (0: strongest; MISSING: a null), joined by commas; rules, the sum of 2 ** number of the rules by which they
    meet. Empty tables give no rows."""
    side = lambda df, key, s: _distinct(df, key, spec).drop("_n").withColumn("_side", F.lit(s))
    rows = blocked(side(left, left_id, 0).unionByName(side(right, right_id, 1)), spec)
    record = F.struct(*spec.fields)
    a = rows.where("_side = 0").select("_block", "_rule", F.col("_id").alias("l_id"), record.alias("l"))
    b = rows.where("_side = 1").select("_block", F.col("_id").alias("r_id"), record.alias("r"))
    found = a.join(b, "_block").select("l_id", "r_id", _pattern(spec), F.call_function("shiftleft", F.lit(1), F.col("_rule")).alias("rule"))
    return found.groupBy("l_id", "r_id").agg(F.first("pattern").alias("pattern"), F.bit_or("rule").alias("rules"))


def by_chance(left: DataFrame, right: DataFrame, left_id: str, right_id: str, spec: Linkage, least: int = 20_000) -> tuple[dict[str, int], int]:
    """Counts of the patterns of pairs drawn by hash, about as many as the smaller side has records and ``least`` at least
    (or all), and the number of all pairs. Distinct records of both sides are dealt into so many parts and meet within."""
    ours, theirs = _distinct(left, left_id, spec), _distinct(right, right_id, spec)
    n, m = ours.count(), theirs.count()
    parts = max(1, n * m // max(min(n, m), least))
    dealt = lambda df, side, name: df.select(F.pmod(F.xxhash64(F.lit(side), F.col("_id")), F.lit(parts)).alias("_part"), F.struct(*spec.fields).alias(name))
    drawn = dealt(ours, "left", "l").join(dealt(theirs, "right", "r"), "_part").select(_pattern(spec))
    return {r["pattern"]: r["count"] for r in drawn.groupBy("pattern").count().collect()}, n * m


@dataclass(frozen=True)
class Model:
    """share of matches among all pairs; match, chance: by field, the probabilities of its levels."""

    share: float
    match: list[np.ndarray]
    chance: list[np.ndarray]

    def weight(self, levels: list[int]) -> float:
        return sum(log2(m[v] / u[v]) for m, u, v in zip(self.match, self.chance, levels, strict=True) if v != MISSING)

    def posterior(self, levels: list[int]) -> float:
        odds = self.share / (1 - self.share) * 2.0 ** self.weight(levels)
        return float(odds / (1 + odds))


def _levels(pats: np.ndarray, weights: np.ndarray, f: int, size: int) -> np.ndarray:
    """Probabilities of a field's levels; those never seen keep half a pair."""
    tally = np.array([weights[pats[:, f] == v].sum() for v in range(size)]) + 0.5
    return tally / tally.sum()


def fit(counts: dict[tuple[str, int], int], chance_counts: dict[str, int], pairs: int, spec: Linkage, rounds: int = 1000) -> Model:
    """The model from counts by (pattern, rules), counts of chance patterns and the number of all pairs.

    Fields agree independently among matches and among the others. A field's match levels are those of all rules that do
    not name it, by the matches each finds; a field that all rules name keeps the start (mostly the strongest level). One
    field alone does not tell matches from chance, so a rule that leaves one is used only where no other teaches it. The
    share of matches is that of the rule that finds most."""
    sizes = [len(c) + 1 for c in spec.fields.values()]
    start = [np.array([0.8] + [0.2 / (s - 1)] * (s - 1)) for s in sizes]
    split = lambda keys: np.array([[int(v) for v in k.split(",")] for k in keys]).reshape(-1, len(sizes))
    drawn, total = split(chance_counts), np.array(list(chance_counts.values()), dtype=float)
    chance = [_levels(drawn, total, f, s) for f, s in enumerate(sizes)]
    learnt: list[list[tuple[float, np.ndarray]]] = [[] for _ in sizes]
    most = 0.0
    named = lambda name, rule: any(re.search(rf"\b{re.escape(name)}\b", e) for e in rule)
    open_fields = [(i, [f for f, name in enumerate(spec.fields) if not named(name, rule)]) for i, rule in enumerate(spec.rules)]
    for i, free in sorted(open_fields, key=lambda x: -len(x[1])):
        found = sorted((p, n) for (p, mask), n in counts.items() if mask >> i & 1)
        if not found or not free or len(free) < 2 and learnt[free[0]]:
            continue
        pats, n = split([p for p, _ in found]), np.array([x for _, x in found], dtype=float)
        match, share = list(start), 0.5
        like = lambda probs: prod((np.where(pats[:, f] == MISSING, 1.0, probs[f][pats[:, f]]) for f in free), start=np.ones(len(pats)))  # noqa: B023, E731
        for _ in range(rounds):
            a, b = share * like(match), (1 - share) * like(chance)
            g = a / (a + b)
            before, share = share, float(np.clip((g * n).sum() / n.sum(), 1e-9, 1 - 1e-9))
            for f in free:
                match[f] = _levels(pats, g * n, f, sizes[f])
            if abs(share - before) < 1e-12:
                break
        matches = share * n.sum()
        most = max(most, matches)
        for f in free:
            learnt[f].append((matches, match[f]))
    match = [sum(w * p for w, p in x) / sum(w for w, _ in x) if x else start[f] for f, x in enumerate(learnt)]
    return Model(min(max(most / max(pairs, 1), 1e-15), 0.5), match, chance)


def linked(left: DataFrame, right: DataFrame, left_id: str, right_id: str, spec: Linkage) -> DataFrame:
    """A row per left row: its id, link_id (the right record with the greatest posterior of at least ``review``; ties: the
    least id; null: none), rating (match, review or none) and conflict: whether several right rows are accepted for it, or
    its accepted one for several left records.

    Equal rows have one verdict; null fields say nothing about a pair, and a row without any meets none; an empty table on
    the right gives no links; other columns are not read."""
    spark, path = left.sparkSession, new_path(left.sparkSession, "linkage")
    patterns(left, right, left_id, right_id, spec).write.parquet(path)
    pairs = spark.read.parquet(path)
    counts = {(r["pattern"], r["rules"]): r["count"] for r in pairs.groupBy("pattern", "rules").count().collect()}  # bounded by the fields' levels
    model = fit(counts, *by_chance(left, right, left_id, right_id, spec), spec)
    scored = [(p, model.posterior([int(v) for v in p.split(",")])) for p in sorted({p for p, _ in counts})]
    kept = [x for x in scored if x[1] >= spec.review]
    near = pairs.join(F.broadcast(spark.createDataFrame(kept, "pattern string, posterior double")), "pattern")
    sure = near.where(F.col("posterior") >= spec.accept)
    ours, theirs = _distinct(left, left_id, spec), _distinct(right, right_id, spec)
    shared = sure.groupBy("r_id").agg(F.count("*").alias("_lefts")).join(theirs.select(F.col("_id").alias("r_id"), "_n"), "r_id")
    odd = sure.join(shared, "r_id").groupBy("l_id").agg(((F.sum("_n") > 1) | (F.max("_lefts") > 1)).alias("_conflict"))
    best = near.groupBy("l_id").agg(F.min(F.struct((-F.col("posterior")).alias("p"), "r_id")).alias("_best"))
    verdict = best.join(odd, "l_id", "left").select(
        F.col("l_id").alias("_id"), F.col("_best.r_id").alias("link_id"), F.when(-F.col("_best.p") >= spec.accept, "match").otherwise("review").alias("rating"), F.coalesce("_conflict", F.lit(False)).alias("conflict")
    )
    record = ours.join(verdict, "_id", "left").select(F.struct(*spec.fields).alias("_record"), "link_id", "rating", "conflict")
    rows = left.select(F.col(left_id), F.struct(*spec.fields).alias("_mine"))
    return rows.join(record, F.col("_mine").eqNullSafe(F.col("_record")), "left").select(
        left_id, "link_id", F.coalesce("rating", F.lit("none")).alias("rating"), F.coalesce("conflict", F.lit(False)).alias("conflict")
    )
