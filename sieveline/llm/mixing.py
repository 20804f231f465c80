"""Operator 4, mixing sources to target weights: Pareto order sampling (Rosen, 1997) after certain whole copies.

Each source has a target of words. A document's expected copies are ``min(3, c * weight)`` with one c a source, so that
the source's expected words are its target. The whole part is certain; of the fractions (inclusion odds pi), a sample of
fixed size is drawn by Pareto order: documents are ranked by (u / (1 - u)) / (pi / (1 - pi)) with a uniform u from a digest
of the id, and the first are taken until their words are nearest to what the whole copies left.

No source is ever sorted in one task: ranks are binned, the words of the bins are summed, and only the bin in which the
target falls is ordered exactly. What is joined back is one row a source.
"""

from __future__ import annotations

from dataclasses import dataclass

from pyspark.sql import Column, DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from .common import join_small, n_words, once, save, source_key, table


@dataclass(frozen=True)
class Mix:
    """weights repeat over the sources in code point order; max_copies bounds a document's copies; budget is the mix's
    size as a share of all words; bins is the number of rank bins; seed changes the draw."""

    weights: tuple[int, ...] = (5, 2, 1)
    max_copies: int = 3
    budget: float = 1.0
    bins: int = 4096
    seed: str = "mix"


def _uniform(doc_id: Column, seed: str) -> Column:
    digest = F.md5(F.concat(F.coalesce(doc_id.cast("string"), F.lit("")), F.lit("|" + seed)).cast("binary"))
    return (F.conv(F.substring(digest, 1, 13), 16, 10).cast("long").cast("double") + 0.5) / F.lit(float(1 << 52))


def _grade(size: Column) -> Column:
    """Unequal inclusion weights: 32 less the binary logarithm of the size, so that long texts are repeated a bit less."""
    return F.lit(32) - F.length(F.bin(F.greatest(size, F.lit(1))))


def features(docs: DataFrame, mix: Mix, *kept: Column) -> DataFrame:
    return docs.select(
        *kept,
        F.col("doc_id").cast("long").alias("doc_id"),
        source_key(F.col("source")).alias("skey"),
        F.col("source").alias("source"),
        once(n_words(F.col("text"))).alias("size"),
        F.crc32(F.coalesce(F.col("text"), F.lit("")).cast("binary")).alias("crc"),
    ).withColumns({"u": _uniform(F.col("doc_id"), mix.seed), "grade": _grade(F.col("size"))})


def _targets(rows: DataFrame, mix: Mix) -> DataFrame:
    """A row a source: skey, source_size, target. Windows without a partition run over the sources, not over documents."""
    k = len(mix.weights)
    sums = rows.groupBy("skey").agg(F.first("source").alias("source"), F.sum("size").alias("source_size"))
    turn = (F.row_number().over(Window.orderBy(F.col("source").asc_nulls_last())) - 1) % k
    weighed = sums.withColumn("w", F.element_at(F.array(*[F.lit(float(w)) for w in mix.weights]), turn + 1))
    up = Window.orderBy(F.col("source_size") / F.col("w"), F.col("source").asc_nulls_last())
    before, everything = up.rowsBetween(Window.unboundedPreceding, -1), Window.partitionBy()
    size = F.col("source_size").cast("double")
    cap = size * float(mix.max_copies)
    level = (F.sum(size).over(everything) * float(mix.budget) - F.coalesce(F.sum(cap).over(before), F.lit(0.0))) / (
        F.sum("w").over(everything) - F.coalesce(F.sum("w").over(before), F.lit(0.0))
    )
    filled = weighed.withColumns({"level": level, "cap": cap}).withColumn("open", F.col("level") * F.col("w") <= F.col("cap"))
    first = F.first(F.when(F.col("open"), F.col("level")), ignorenulls=True).over(up.rowsBetween(Window.unboundedPreceding, Window.unboundedFollowing))
    return filled.select("skey", "source_size", F.least("cap", F.coalesce(first * F.col("w"), F.col("cap"))).alias("target"))


def _scales(rows: DataFrame, targets: DataFrame, mix: Mix) -> DataFrame:
    """A row a source: the targets, and c such that the expected copies min(max, c * grade) make the target."""
    most = float(mix.max_copies)
    grades = rows.groupBy("skey", "grade").agg(F.sum("size").cast("double").alias("words"))
    grades = grades.join(targets, "skey")
    down = Window.partitionBy("skey").orderBy(F.col("grade").desc())
    before, rest = down.rowsBetween(Window.unboundedPreceding, -1), down.rowsBetween(0, Window.unboundedFollowing)
    graded = F.col("words") * F.col("grade")
    c = (F.col("target") - most * F.coalesce(F.sum("words").over(before), F.lit(0.0))) / F.nullif(F.sum(graded).over(rest), F.lit(0.0))
    tried = grades.withColumns({"c": c, "last": F.lead("grade").over(down).isNull()})
    fits = tried.where(((F.col("c") * F.col("grade") <= most) | F.col("last")) & F.col("c").isNotNull())
    first = fits.groupBy("skey").agg(F.max_by("c", "grade").alias("c"))
    return targets.join(first, "skey", "left").select("skey", "source_size", "target", F.coalesce("c", F.lit(0.0)).alias("c"))


def _ranked(rows: DataFrame, mix: Mix) -> DataFrame:
    """Adds whole (certain copies), pi (the fraction's odds of inclusion), q (the Pareto rank) and its bin."""
    copies = F.least(F.lit(float(mix.max_copies)), F.col("c") * F.col("grade"))
    rows = rows.withColumn("copies", copies).withColumn("whole", F.floor("copies")).withColumn("pi", F.col("copies") - F.col("whole"))
    q = F.when(F.col("pi") > 0, (F.col("u") / (1.0 - F.col("u"))) / (F.col("pi") / (1.0 - F.col("pi"))))
    # least() skips nulls, and documents without a fraction must not be in a bin
    binned = F.least(F.floor(F.col("q") / (1.0 + F.col("q")) * F.lit(float(mix.bins))), F.lit(mix.bins - 1))
    return rows.withColumn("q", q).withColumn("bin", F.when(F.col("q").isNotNull(), binned))


def _key(*names: str) -> Column:
    return F.struct(*[F.col(n) for n in names])


def plan(rows: DataFrame, mix: Mix) -> DataFrame:
    """A row a source: skey, source_size, target, c, last_bin, and last: the rank of the last document that is drawn."""
    scales = save(_scales(rows, save(_targets(rows, mix), "mix-targets"), mix), "mix-scales")
    ranked = _ranked(join_small(rows, scales, ["skey"]), mix)
    bins = ranked.groupBy("skey", "bin").agg(
        F.sum(F.col("size") * F.col("whole")).cast("double").alias("certain"), F.sum(F.when(F.col("q").isNotNull(), F.col("size")).otherwise(0)).cast("double").alias("words"), F.first("target").alias("target")
    )
    by, order = Window.partitionBy("skey"), Window.partitionBy("skey").orderBy(F.col("bin").asc_nulls_last())
    left = F.col("target") - F.sum("certain").over(by)
    bins = bins.select("skey", "bin", left.alias("left"), F.coalesce(F.sum("words").over(order.rowsBetween(Window.unboundedPreceding, -1)), F.lit(0.0)).alias("before"))
    edge = bins.where(F.col("bin").isNotNull() & (F.col("before") <= F.col("left"))).groupBy("skey").agg(F.max(_key("bin", "before", "left")).alias("e"))
    edge = save(edge.select("skey", F.col("e.bin").alias("last_bin"), F.col("e.before").alias("before"), F.col("e.left").alias("left")), "mix-edges")
    at_edge = join_small(ranked, edge, ["skey"]).where(F.col("bin") == F.col("last_bin"))
    running = Window.partitionBy("skey").orderBy("q", "doc_id", "crc").rowsBetween(Window.unboundedPreceding, -1)
    at_edge = at_edge.withColumn("ahead", F.col("before") + F.coalesce(F.sum("size").over(running), F.lit(0)))
    last = at_edge.where(F.col("ahead") + F.col("size") / 2.0 <= F.col("left")).groupBy("skey").agg(F.max(_key("q", "doc_id", "crc")).alias("last"))
    return save(scales.join(edge.select("skey", "last_bin"), "skey", "left").join(last, "skey", "left"), "mix-plan")


def copies(rows: DataFrame, planned: DataFrame, mix: Mix) -> DataFrame:
    """Adds to rows of features the columns of the plan and ``n_copies``."""
    ranked = _ranked(join_small(rows, planned, ["skey"]), mix)
    drawn = F.coalesce((F.col("bin") < F.col("last_bin")) | ((F.col("bin") == F.col("last_bin")) & (_key("q", "doc_id", "crc") <= F.col("last"))), F.lit(False))
    return ranked.withColumn("n_copies", (F.col("whole") + drawn.cast("long")).cast("long"))


def mix_report(docs: DataFrame, mix: Mix = Mix()) -> DataFrame:
    """A row per document: doc_id, size, source_size, target, taken.

    A null text has no words; a document without words takes none. A null source is a source of its own, the last. A
    source without words has the target 0. Rows that are equal in id and text are drawn together. An empty table gives
    no rows; columns other than doc_id, source and text are not read. Reruns agree: nothing depends on partitioning.
    """
    rows = save(features(docs, mix), "mix-rows")
    out = copies(rows, plan(rows, mix), mix)
    return out.select("doc_id", "size", F.col("source_size").cast("long").alias("source_size"), "target", (F.col("size") * F.col("n_copies")).alias("taken"))


def mixed(docs: DataFrame, mix: Mix = Mix()) -> DataFrame:
    """The documents of the mix, with all their columns, each as often as it is taken.

    A document without words (a null or empty text) is not taken; a null source is a source of its own; repeated rows are
    drawn together; an empty table gives no rows; columns stay whatever their names. The first pass saves small rows of
    features; the second repeats them beside the text, so that no text is shuffled."""
    planned = plan(save(features(docs, mix), "mix-rows"), mix)
    whole = F.struct(*[F.col(f"`{c}`") for c in docs.columns]).alias("_doc")
    out = copies(features(docs, mix, whole), planned, mix).where(F.col("n_copies") > 0)
    return out.select("_doc", F.explode(F.sequence(F.lit(1), F.col("n_copies").cast("int"))).alias("_copy")).select("_doc.*")


def op4_pareto_mix(spark: SparkSession, sf_dir: str) -> DataFrame:
    return mix_report(table(spark, sf_dir, "documents").select("doc_id", "source", "text"))


SQL = r"""
WITH f AS (
  SELECT doc_id, coalesce('=' || source, 'null') AS skey, source, len(regexp_extract_all(coalesce(text, ''), '[^\x20\x09-\x0D]+'))::BIGINT AS size, coalesce(text, '') AS body,
    (('0x' || substr(md5(coalesce(doc_id::VARCHAR, '') || '|mix'), 1, 13))::BIGINT::DOUBLE + 0.5) / 4503599627370496.0::DOUBLE AS u
  FROM documents),
g AS (SELECT *, 32 - length(bin(greatest(size, 1))) AS grade FROM f),
s AS (SELECT skey, any_value(source) AS source, sum(size)::DOUBLE AS ss FROM g GROUP BY skey),
w AS (SELECT *, [5.0::DOUBLE, 2.0::DOUBLE, 1.0::DOUBLE][((row_number() OVER (ORDER BY source NULLS LAST) - 1) % 3 + 1)::BIGINT] AS w FROM s),
l AS (SELECT *, 3.0::DOUBLE * ss AS cap, (sum(ss) OVER () - coalesce(sum(3.0::DOUBLE * ss) OVER up, 0)) / (sum(w) OVER () - coalesce(sum(w) OVER up, 0)) AS level,
    row_number() OVER (ORDER BY ss / w, source NULLS LAST) AS r
  FROM w WINDOW up AS (ORDER BY ss / w, source NULLS LAST ROWS BETWEEN UNBOUNDED PRECEDING AND 1 PRECEDING)),
o AS (SELECT arg_min(level, r) AS level FROM l WHERE level * w <= cap),
t AS (SELECT skey, ss, least(cap, coalesce(o.level * w, cap)) AS target FROM l LEFT JOIN o ON true),
gr AS (SELECT skey, grade, sum(size)::DOUBLE AS words FROM g GROUP BY skey, grade),
c0 AS (SELECT skey, grade, ss, target, (target - 3.0::DOUBLE * coalesce(sum(words) OVER (d ROWS BETWEEN UNBOUNDED PRECEDING AND 1 PRECEDING), 0)) / nullif(sum(words * grade) OVER (d ROWS BETWEEN CURRENT ROW AND UNBOUNDED FOLLOWING), 0) AS c,
    lead(grade) OVER d IS NULL AS last
  FROM gr JOIN t USING (skey) WINDOW d AS (PARTITION BY skey ORDER BY grade DESC)),
c1 AS (SELECT skey, arg_max(c, grade) AS c FROM c0 WHERE c IS NOT NULL AND (c * grade <= 3.0::DOUBLE OR last) GROUP BY skey),
e AS (SELECT g.*, t.ss, t.target, least(3.0::DOUBLE, coalesce(c1.c, 0) * grade) AS copies FROM g JOIN t USING (skey) LEFT JOIN c1 USING (skey)),
p AS (SELECT *, floor(copies) AS whole, copies - floor(copies) AS pi FROM e),
q AS (SELECT *, CASE WHEN pi > 0 THEN (u / (1.0::DOUBLE - u)) / (pi / (1.0::DOUBLE - pi)) END AS q FROM p),
r AS (SELECT *, target - sum(size * whole) OVER (PARTITION BY skey) AS rest,
    coalesce(sum(CASE WHEN q IS NOT NULL THEN size ELSE 0 END) OVER (PARTITION BY skey ORDER BY q NULLS LAST, doc_id NULLS FIRST, body ROWS BETWEEN UNBOUNDED PRECEDING AND 1 PRECEDING), 0) AS ahead
  FROM q)
SELECT doc_id, size, ss::BIGINT AS source_size, target, (size * (whole + CASE WHEN q IS NOT NULL AND ahead + size / 2.0::DOUBLE <= rest THEN 1 ELSE 0 END))::BIGINT AS taken FROM r
"""
