"""Calibration: fits per category, expected calibration error, status rule, artefact."""

from __future__ import annotations

import json

from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from ..functions import numbers
from ..sources.shared import new_path

METHODS = ("identity", "sigmoid", "isotonic")


def calibration_error(rows: DataFrame) -> DataFrame:
    """(category, p in 0..1, label) -> (category, error): |mean p - mean label| over ten equal bins, weighted, in points."""
    return grouped_error(rows.select("category", "p", F.lit(1).alias("n"), F.col("label").isNotNull().cast("int").alias("known"), F.col("label").alias("pos")))


def grouped_error(groups: DataFrame) -> DataFrame:
    """The same of rows that stand for ``n`` rows of one p: ``known`` of them have a label, whose sum is ``pos``."""
    bins = groups.withColumn("bin", F.least(F.lit(9), F.floor(F.col("p") * 10)))
    p = F.sum(F.col("n") * F.col("p")) / F.sum(F.when(F.col("p").isNotNull(), F.col("n")))
    means = bins.groupBy("category", "bin").agg(p.alias("p"), (F.sum("pos").cast("double") / F.sum("known")).alias("y"), F.sum("n").alias("n"))
    return means.groupBy("category").agg((F.sum(F.col("n") * F.abs(F.col("p") - F.col("y"))) / F.sum("n") * 100).alias("error"))


#: Newton steps at most, and the step at which they end.
STEPS, SMALL = 100, 1e-12


def fit_sigmoid(grouped: DataFrame) -> DataFrame:
    """(category, score, n, pos) -> (category, a, b): Platt's map 1 / (1 + exp(a s + b)) of s = score / 100, with an L2
    penalty on a (C = 1), by Newton's method for all categories at once. A step is one aggregation; what comes to the
    driver is a row of six sums a category."""
    spark, x = grouped.sparkSession, F.col("score") / 100.0
    w = {r["category"]: (0.0, 0.0) for r in grouped.select("category").distinct().collect()}
    schema = "category string, w0 double, w1 double"
    for _ in range(STEPS):
        p = F.lit(1.0) / (F.lit(1.0) + F.exp(-(F.col("w0") * x + F.col("w1"))))
        v, left = F.col("n") * p * (F.lit(1.0) - p), F.col("pos") - F.col("n") * p
        now = F.broadcast(spark.createDataFrame([(c, *k) for c, k in w.items()], schema))  # a row a category
        total = {"g0": x * left, "g1": left, "h00": x * x * v, "h01": x * v, "h11": v}
        moved = 0.0
        for r in grouped.join(now, "category").groupBy("category").agg(*[F.sum(e).alias(k) for k, e in total.items()]).collect():
            w0, w1 = w[r["category"]]
            g0, h00, h11 = r["g0"] - w0, r["h00"] + 1.0 + SMALL, r["h11"] + SMALL
            det = h00 * h11 - r["h01"] * r["h01"]
            d0, d1 = (h11 * g0 - r["h01"] * r["g1"]) / det, (h00 * r["g1"] - r["h01"] * g0) / det
            w[r["category"]], moved = (w0 + d0, w1 + d1), max(moved, abs(d0), abs(d1))
        if moved < SMALL:
            break
    return spark.createDataFrame([(c, -w0, -w1) for c, (w0, w1) in w.items()], "category string, a double, b double")


def pooled(n: list[int], pos: list[int]) -> list[tuple[int, int, int]]:
    """Pooled adjacent violators of blocks in the order of scores, each with its number of labels and of positive ones:
    (blocks pooled, labels, positives) of what is left. In whole numbers, so that pooling in parts gives the same."""
    out: list[tuple[int, int, int]] = []
    for size, ones in zip(n, pos, strict=True):
        k = 1
        while out and out[-1][2] * size >= ones * out[-1][1]:
            more, before, positive = out.pop()
            k, size, ones = k + more, size + before, ones + positive
        out.append((k, size, ones))
    return out


#: Blocks that a task pools at once.
BLOCKS = 10_000

BLOCK = "category string, score double, last double, knots long, n long, pos long"


def _ranked(rows: DataFrame) -> DataFrame:
    """Blocks with ``at``, their place in the order of categories and scores: by ranges, whose sizes alone come to the driver."""
    spark, path = rows.sparkSession, new_path(rows.sparkSession, "blocks")
    rows.repartitionByRange("category", "score").sortWithinPartitions("category", "score").withColumns({"part": F.spark_partition_id(), "i": F.monotonically_increasing_id().bitwiseAND(F.lit((1 << 33) - 1))}).write.parquet(path)
    rows = spark.read.schema(f"{BLOCK}, part int, i long").parquet(path)
    sizes = {r["part"]: r["n"] for r in rows.groupBy("part").agg(F.count("*").alias("n")).collect()}
    first, before = {}, 0
    for part in sorted(sizes):
        first[part], before = before, before + sizes[part]
    starts = F.broadcast(spark.createDataFrame(list(first.items()) or [(0, 0)], "part int, first long"))  # a row a range
    return rows.join(starts, "part").select(*[c.split(" ")[0] for c in BLOCK.split(", ")], (F.col("first") + F.col("i")).alias("at"))


def _pool(pdf):
    import pandas as pd

    pdf, out = pdf.sort_values("at"), []
    for category, own in pdf.groupby("category", sort=False, dropna=False):
        score, last, knots, at = own["score"].tolist(), own["last"].tolist(), own["knots"].tolist(), 0
        for k, n, pos in pooled(own["n"].tolist(), own["pos"].tolist()):
            out.append((category, score[at], last[at + k - 1], sum(knots[at : at + k]), n, pos))
            at += k
    return pd.DataFrame(out, columns=["category", "score", "last", "knots", "n", "pos"])


def isotonic_blocks(grouped: DataFrame, size: int = BLOCKS) -> DataFrame:
    """(category, score, n, pos) -> BLOCK rows: the pools of scores that share a value, pos / n, in each category.

    Runs of up to ``size`` blocks are pooled by many tasks; pooled blocks are blocks again, so a run's result stands for it.
    While neighbouring runs violate the order, runs are cut anew, half a run further on; every such round pools at least
    one pair. No task holds more than a run, however many scores a category has."""
    rows = _ranked(grouped.select("category", "score", F.col("score").alias("last"), F.lit(1).cast("long").alias("knots"), "n", "pos"))
    shift = 0
    while True:
        run = F.floor((F.col("at") + shift) / F.lit(size))
        rows = _ranked(rows.groupBy(run.alias("run")).applyInPandas(_pool, BLOCK))
        other = rows.select((F.col("at") - 1).alias("at"), F.col("category").alias("c"), F.col("n").alias("m"), F.col("pos").alias("q"))
        wrong = rows.join(other, "at").where((F.col("category") == F.col("c")) & (F.col("pos") * F.col("m") >= F.col("q") * F.col("n")))
        if not wrong.limit(1).count():
            return rows.drop("at")
        shift = 0 if shift else size // 2


def isotonic_knots(grouped: DataFrame) -> DataFrame:
    """(category, score, n, pos) -> (category, x, y), a row a distinct score."""
    starts = isotonic_blocks(grouped).select("category", "score", (F.col("pos") / F.col("n")).alias("y"))
    so_far = Window.partitionBy("category").orderBy("score").rowsBetween(Window.unboundedPreceding, Window.currentRow)
    knots = grouped.select("category", "score").join(starts, ["category", "score"], "left").withColumn("y", F.last("y", ignorenulls=True).over(so_far))
    return knots.select("category", (F.col("score") / 100.0).alias("x"), "y")


def _gathered(knots: DataFrame) -> DataFrame:
    rows = knots.groupBy("category").agg(F.array_sort(F.collect_list(F.struct("x", "y"))).alias("k"))
    return rows.select("category", F.transform("k", lambda k: k["x"]).alias("x"), F.transform("k", lambda k: k["y"]).alias("y"))


def fit_isotonic(grouped: DataFrame) -> DataFrame:
    """(category, score, n, pos) -> (category, x, y): the knots are the distinct scores, as an artefact holds them, in one
    row a category; :func:`isotonic_blocks` is the same without that row."""
    return _gathered(isotonic_knots(grouped))


def _interpolated(groups: DataFrame, knots: DataFrame) -> DataFrame:
    """Groups (category, score, n, known, pos) with ``p``, as numbers.calibrated gives it for these knots, a row each: both
    lists in the order of scores meet in one pass, whatever their lengths."""
    s = F.greatest(F.lit(0.0), F.least(F.lit(1.0), F.col("score") / 100.0))
    none = F.lit(None)
    asked = groups.select("category", s.alias("x"), F.lit(1).alias("asked"), none.cast("struct<x:double,y:double>").alias("k"), "n", "known", "pos")
    given = knots.select("category", "x", F.lit(0).alias("asked"), F.struct("x", "y").alias("k"), *[none.cast("long").alias(c) for c in ("n", "known", "pos")])
    order = Window.partitionBy("category").orderBy("x", "asked", "k.y")
    back = Window.partitionBy("category").orderBy(F.col("x").desc(), F.col("asked").desc(), F.col("k.y").desc())
    met = asked.unionByName(given).withColumns({"lo": F.last("k", ignorenulls=True).over(order.rowsBetween(Window.unboundedPreceding, Window.currentRow))})
    met = met.withColumns({"hi": F.last("k", ignorenulls=True).over(back.rowsBetween(Window.unboundedPreceding, Window.currentRow))}).where("asked = 1")
    (x0, y0), (x1, y1) = [(F.col(f"{c}.x"), F.col(f"{c}.y")) for c in ("lo", "hi")]
    inside = y0 + (y1 - y0) * (F.col("x") - x0) / F.nullif(x1 - x0, F.lit(0.0))
    value = F.when(F.col("lo").isNull() & F.col("hi").isNull(), F.col("x")).when(F.col("lo").isNull(), y1).when(F.col("hi").isNull(), y0).otherwise(inside)
    return met.select("category", (F.greatest(F.lit(0.0), F.least(F.lit(100.0), value * 100.0)) / 100.0).alias("p"), "n", "known", "pos")


def fit(labels: DataFrame, method: str = "sigmoid", min_positives: int = 100, max_error: float = 5.0) -> DataFrame:
    """labels (category, split, score, label) -> calibration rows with positives and error.

    Fits read a row a category and distinct score. Status: no positives on dev: not_calibrated, by identity; enough of
    them and a small holdout error: calibrated; else provisional. No holdout counts as an error of 100 points."""
    if method not in METHODS:
        raise ValueError(f"unknown calibration method {method!r}")
    one = (F.col("label") == 1).cast("long")
    grouped = labels.where("split = 'dev'").groupBy("category", "score").agg(F.count("*").alias("n"), F.sum(one).alias("pos"))
    path = new_path(labels.sparkSession, "calibration")
    grouped.write.parquet(path)
    grouped = labels.sparkSession.read.schema(grouped.schema).parquet(path)
    positives = grouped.groupBy("category").agg(F.sum("pos").alias("positives"))
    fitted = grouped.join(positives.where("positives > 0"), "category", "left_semi")
    none, zero = F.array().cast("array<double>"), F.lit(0.0)
    empty = {"method": F.lit("identity"), "a": zero, "b": zero, "x": none, "y": none}
    if method == "identity":
        maps = positives.select("category", "positives", *[v.alias(k) for k, v in empty.items()])
    else:
        if method == "isotonic":
            path = new_path(labels.sparkSession, "knots")
            isotonic_knots(fitted).write.parquet(path)
            knots = labels.sparkSession.read.schema("category string, x double, y double").parquet(path)
        own = fit_sigmoid(fitted) if method == "sigmoid" else _gathered(knots)
        joined = positives.join(own.withColumn("method", F.lit(method)), "category", "left")
        maps = joined.select("category", "positives", *[(F.coalesce(F.col(k), v) if k in joined.columns else v).alias(k) for k, v in empty.items()])
    # every category that has labels has a row, on whichever split they are
    maps = labels.select("category").distinct().join(maps, "category", "left").select("category", F.coalesce("positives", F.lit(0)).cast("long").alias("positives"), *[F.coalesce(F.col(k), v).alias(k) for k, v in empty.items()])
    # a row a distinct score: no label meets a category's row of knots
    held = labels.where("split = 'holdout'").groupBy("category", "score").agg(F.count("*").alias("n"), F.count("label").alias("known"), F.sum("label").cast("long").alias("pos"))
    if method == "isotonic":
        errors = grouped_error(_interpolated(held, knots))
    else:
        held = held.join(maps.select("category", "method", "a", "b"), "category")
        p = numbers.calibrated(F.col("score"), F.col("method"), F.col("a"), F.col("b"), none, none) / 100.0
        errors = grouped_error(held.select("category", p.alias("p"), "n", "known", "pos"))
    out = maps.join(errors, "category", "left").withColumn("error", F.coalesce("error", F.lit(100.0)))
    status = F.when(F.col("positives") == 0, "not_calibrated").when((F.col("positives") >= min_positives) & (F.col("error") <= max_error), "calibrated").otherwise("provisional")
    return out.select("category", status.alias("status"), "method", "a", "b", "x", "y", "positives", "error")


def artefact(rows: DataFrame, version: str) -> str:
    """The artefact's JSON: sorted, without empty fields. A row a category comes to the driver."""
    cats = {}
    for r in rows.orderBy("category").collect():
        kept = {"status": r["status"], "method": r["method"], "a": r["a"], "b": r["b"], "x": list(r["x"] or []), "y": list(r["y"] or [])}
        cats[r["category"]] = {k: v for k, v in kept.items() if v not in (None, [])}
    return json.dumps({"version": version, "categories": cats}, sort_keys=True, indent=2)


def as_map(rows: DataFrame):
    """Calibration rows as a literal map column for :func:`items.apply_calibration`: one entry a category."""
    entries = []
    for r in rows.collect():
        arr = lambda v: F.array(*[F.lit(float(x)) for x in v or []]).cast("array<double>")
        entries += [F.lit(r["category"]), F.struct(F.lit(r["status"]).alias("status"), F.lit(r["method"]).alias("method"), F.lit(float(r["a"] or 0)).alias("a"), F.lit(float(r["b"] or 0)).alias("b"), arr(r["x"]).alias("x"), arr(r["y"]).alias("y"))]
    return F.create_map(*entries) if entries else None
