"""Operator 2, quality rules: thresholds from mergeable quantile sketches per language and source, native expressions only.

Each measure of a text is a whole number, a rate by 10,000 words. A sketch of a group is a histogram of log-linear bins
(the leading BITS binary digits of the value; 0 has its own), which merges by adding counts: it does not depend on order
or partitioning, and its quantiles are off by under 2**-BITS of the value. Sketches are kept per (language, source) and
merged up to the language and to the corpus.

A group's upper fence is found by going up its quantiles: from the median to those that leave a quarter, an eighth and so
on of the rows above, down to 2**-LEVELS. A population's tail grows by at most a measure's ``tail`` factor whenever its
share halves; where a quantile is further than that from the one before, another population begins. The fence stands one
factor beyond the last quantile of the first one. So it follows what the group's texts hold: it is wide in a source where
many texts hold symbols, near 0 where they hold none, and junk does not move it, whatever its share below a half. Rates under
that of one unit in the shortest text that passes the base rules say nothing and count as that. The lower fence of the word length is found
in the same way downward. A group's fences are its own, pulled toward the language's, and those toward the corpus's, as if
``prior_rows`` rows of the wider group were its own (a weighted geometric mean): every group has fences of its own, a small
one nearly the wider group's. Documents outside a fence are rejected. The fences (one row a group) are joined to the
documents.
"""

from __future__ import annotations

from dataclasses import dataclass

from pyspark.sql import Column, DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from .common import join_small, let, once, save, table, words

#: Binary digits that a bin keeps.
BITS = 7

SYMBOLS = "#*$%&|<>"


#: The last quantile that is looked at leaves this power of a half of the rows beyond it.
LEVELS = 10


@dataclass(frozen=True)
class Rules:
    """prior_rows: weight of the wider group; tail: by measure, what a tail's quantile may grow by when its share halves
    (4: heavier than any tail with a mean); unit: by measure, the least that a text can hold of it, in words or symbols
    (a repeated window: two of three words); two_sided: measures with a lower fence."""

    prior_rows: int = 200
    min_words: int = 50
    max_repeat_percent: int = 50
    tail: tuple[tuple[str, float], ...] = (("symbols", 4.0), ("dup_lines", 4.0), ("repeats", 4.0), ("word_len", 1.25))
    unit: tuple[tuple[str, int], ...] = (("symbols", 1), ("dup_lines", 1), ("repeats", 6))
    two_sided: tuple[str, ...] = ("word_len",)


def _repeat_words(ws: Column, n: Column) -> Column:
    """Words in 3-word windows that are found twice or more in the text.

    Windows are compared by 64-bit hashes; sorted pairs (hash, position) bring equal ones together."""
    def covered(starts: Column) -> Column:
        # sorted starts of repeated windows; each adds what the next one leaves uncovered
        return F.aggregate(
            F.transform(starts, lambda s, i: F.least(F.lit(3), F.coalesce(F.get(starts, i + 1) - s, F.lit(3)))), F.lit(0), lambda a, x: a + x
        )

    def repeated(pairs: Column) -> Column:
        same = lambda p, i: (p["h"] == F.get(pairs, i - 1)["h"]) | (p["h"] == F.get(pairs, i + 1)["h"])
        flagged = F.filter(pairs, lambda p, i: F.coalesce(same(p, i), F.lit(False)))
        return let(F.sort_array(F.transform(flagged, lambda p: p["i"])), covered)

    def hashed(hashes: Column) -> Column:
        # most texts repeat no window, which the number of distinct hashes tells at once
        none = F.size(F.array_distinct(hashes)) == F.size(hashes)
        pairs = F.sort_array(F.transform(hashes, lambda h, i: F.struct(h.alias("h"), i.alias("i"))))
        return F.when(none, F.lit(0)).otherwise(let(pairs, repeated))

    hashes = F.transform(F.sequence(F.lit(0), n - 3), lambda i: F.xxhash64(F.get(ws, i), F.get(ws, i + 1), F.get(ws, i + 2)))
    return F.when(n < 3, F.lit(0)).otherwise(let(hashes, hashed))


def measures(text: Column) -> Column:
    """A struct of n_words, word_chars, n_symbols, n_dup_lines, n_repeat_words (null text: all 0)."""
    text = F.coalesce(text, F.lit(""))
    blanks = " \t\n\x0b\x0c\r"
    lines = F.filter(F.split(text, "\n"), lambda x: F.length(F.translate(x, blanks, "")) > 0)
    dup = let(lines, lambda ls: F.size(ls) - F.size(F.array_distinct(ls)))
    counted = let(words(text), lambda ws: F.struct(F.size(ws).alias("n"), let(F.size(ws), lambda n: _repeat_words(ws, n)).alias("r")))
    return let(
        counted,
        lambda c: F.struct(
            c["n"].cast("long").alias("n_words"),
            F.length(F.translate(text, blanks, "")).cast("long").alias("word_chars"),
            (F.length(text) - F.length(F.translate(text, SYMBOLS, ""))).cast("long").alias("n_symbols"),
            dup.cast("long").alias("n_dup_lines"),
            c["r"].cast("long").alias("n_repeat_words"),
        ),
    )


def _rates(m: Column) -> dict[str, Column]:
    """The measures that have fences: whole numbers by 10,000 words, rounded up (word_len: thousandths of a character)."""
    n = F.greatest(m["n_words"], F.lit(1))
    per = lambda x: F.floor((x * F.lit(10_000) + n - 1) / n).cast("long")
    return {
        "symbols": per(m["n_symbols"]), "dup_lines": per(m["n_dup_lines"]), "repeats": per(m["n_repeat_words"]),
        "word_len": F.floor(m["word_chars"] * F.lit(1_000) / n).cast("long"),
    }


def _group(docs: DataFrame) -> list[Column]:
    return [F.coalesce(F.concat(F.lit("="), F.col(c)), F.lit("null")).alias(k) for c, k in (("lang", "g_lang"), ("source", "g_source"))]


def _floor_bin(v: Column) -> Column:
    """The lower edge of the value's bin: the value with all but its leading BITS binary digits cleared."""
    drop = F.greatest(F.length(F.bin(v)) - F.lit(BITS), F.lit(0))
    return F.call_function("shiftleft", F.call_function("shiftright", v, drop), drop)


def _walk(quantiles: list[Column], tail: Column, floor: Column) -> Column:
    """The fence above quantiles that leave ever fewer rows: once one is out of reach, so are all that follow."""
    first, *rest = quantiles
    step = lambda x, q: F.when(q > x * tail, x).otherwise(F.greatest(x, q))
    return F.aggregate(F.array(*rest), F.greatest(first, floor), step) * tail


def _walk_down(quantiles: list[Column], tail: Column) -> Column:
    first, *rest = quantiles
    return F.aggregate(F.array(*rest), first, lambda x, q: F.when(q * tail < x, x).otherwise(F.least(x, q))) / tail


def fences(rows: DataFrame, rules: Rules) -> DataFrame:
    """A row per (g_lang, g_source): a map from measure to its fences (lo, hi; null: none).

    ``rows`` holds g_lang, g_source, base_failed and the rates; rows that fail a base rule are left out of the sketches."""
    tails, units = dict(rules.tail), dict(rules.unit)
    # the window below reads a sketch in order of its bins, of which a measure has at most 64 * 2**BITS
    long = rows.where(~F.col("base_failed")).select(
        "g_lang", "g_source", F.explode(F.array(*[F.struct(F.lit(k).alias("measure"), _floor_bin(F.col(k)).alias("bin")) for k in tails])).alias("x")
    )
    fine = save(long.groupBy("g_lang", "g_source", "x.measure", "x.bin").agg(F.count("*").alias("n")), "quality-sketches")
    merged = fine.select(
        "measure", "bin", "n",
        F.explode(F.array(
            F.struct(F.lit(2).alias("level"), F.col("g_lang").alias("l"), F.col("g_source").alias("s")),
            F.struct(F.lit(1).alias("level"), F.col("g_lang").alias("l"), F.lit("").alias("s")),
            F.struct(F.lit(0).alias("level"), F.lit("").alias("l"), F.lit("").alias("s")),
        )).alias("g"),
    ).groupBy("g", "measure", "bin").agg(F.sum("n").alias("n"))
    by = Window.partitionBy("g", "measure")
    seen = F.sum("n").over(by.orderBy("bin").rowsBetween(Window.unboundedPreceding, Window.currentRow))
    ranked = merged.withColumns({"seen": seen, "rows": F.sum("n").over(by)})
    at = lambda q: F.min(F.when(F.col("seen") >= F.ceil(F.col("rows") * F.lit(q)), F.col("bin"))).cast("double")
    shares = [0.5**k for k in range(1, LEVELS + 1)]
    cut = ranked.groupBy("g", "measure").agg(
        F.first("rows").alias("rows"), F.struct(*[at(1 - x).alias(f"q{i}") for i, x in enumerate(shares)]).alias("up"),
        F.struct(*[at(x).alias(f"q{i}") for i, x in enumerate(shares)]).alias("down"),
    )
    pick = lambda d: F.coalesce(*[F.when(F.col("measure") == k, F.lit(float(v))) for k, v in d.items()], F.lit(0.0))
    of = lambda c: [F.col(c)[f"q{i}"] for i in range(LEVELS)]
    least = {k: -(-v * 10_000 // max(rules.min_words, 1)) for k, v in units.items()}
    low = F.when(F.col("measure").isin(*rules.two_sided), _walk_down(of("down"), pick(tails)))
    made = save(cut.select("g.*", "measure", "rows", low.alias("lo"), _walk(of("up"), pick(tails), pick(least)).alias("hi")), "quality-fences")

    def pulled(own: str, wide: str) -> list[Column]:
        # rounded to thousandths: a mean of equal fences is that fence
        share = F.col(f"rows{own}") / (F.col(f"rows{own}") + F.lit(rules.prior_rows))
        mean = lambda c: F.floor(F.exp(share * F.ln(F.greatest(f"{c}{own}", F.lit(1.0))) + (1 - share) * F.ln(F.greatest(f"{c}{wide}", F.lit(1.0)))) * 1000 + 0.5) / 1000
        return [F.when(F.col(f"{c}{own}").isNotNull(), mean(c)).alias(f"{c}{own}") for c in ("lo", "hi")]

    def level(k: int) -> DataFrame:
        return made.where(F.col("level") == k).select(F.col("l").alias("g_lang"), F.col("s").alias("g_source"), "measure", *[F.col(c).alias(f"{c}{k}") for c in ("rows", "lo", "hi")])

    langs = level(1).drop("g_source").join(level(0).drop("g_lang", "g_source"), "measure").select("g_lang", "measure", *pulled("1", "0"))
    owns = level(2).join(langs, ["g_lang", "measure"]).select("g_lang", "g_source", "measure", *pulled("2", "1"))
    fence = F.map_from_entries(F.collect_list(F.struct("measure", F.struct(F.col("lo2").alias("lo"), F.col("hi2").alias("hi")))))
    return save(owns.groupBy("g_lang", "g_source").agg(fence.alias("fence")), "quality-groups")


def _inside(rules: Rules) -> Column:
    """Whether all rates lie within the fences; a group without fences (all its rows fail a base rule) has no limits."""
    out = F.lit(True)
    for k, _ in rules.tail:
        out = out & F.coalesce(F.col(k) <= F.col("fence")[k]["hi"], F.lit(True))
    for k in rules.two_sided:
        out = out & F.coalesce(F.col(k) >= F.col("fence")[k]["lo"], F.lit(True))
    return out


def _measured(docs: DataFrame, rules: Rules, *kept: Column) -> DataFrame:
    rows = docs.select(*kept, *_group(docs), once(measures(F.col("text"))).alias("m"))
    m = F.col("m")
    failed = (m["n_words"] < rules.min_words) | (m["n_repeat_words"] * 100 > m["n_words"] * rules.max_repeat_percent)
    return rows.withColumns({"base_failed": failed} | _rates(m))


def judge(docs: DataFrame, rules: Rules = Rules()) -> DataFrame:
    """A row per document: doc_id, the base measures, base_failed and kept.

    A null or empty text has no words and fails the base rules; null languages and sources are groups of their own.
    Repeated rows are judged alike; an empty table gives no rows; other columns are not read. Each text is read once:
    its small row of measures is saved, the sketches and the verdicts come from that.
    """
    rows = save(_measured(docs, rules, F.col("doc_id").cast("long").alias("doc_id")), "quality-rows")
    out = join_small(rows, fences(rows, rules), ["g_lang", "g_source"], "left")
    return out.select("doc_id", "m.*", "base_failed", (~F.col("base_failed") & _inside(rules)).alias("kept"))


def filtered(docs: DataFrame, rules: Rules = Rules()) -> DataFrame:
    """The documents that are kept, with their columns, whatever their names. Null and empty texts go, as they have no
    words; repeated rows are judged alike; an empty table gives no rows. Texts are measured once: those that pass the base
    rules are saved beside their rates, never shuffled; sketches and verdicts read the rates."""
    whole = F.struct(*[F.col(f"`{c}`") for c in docs.columns]).alias("_doc")
    rows = save(_measured(docs, rules, whole).where(~F.col("base_failed")).drop("m"), "quality-rows")
    out = join_small(rows, fences(rows.drop("_doc"), rules), ["g_lang", "g_source"], "left")
    return out.where(_inside(rules)).select("_doc.*")


def op2_quality_sketches(spark: SparkSession, sf_dir: str) -> DataFrame:
    return judge(table(spark, sf_dir, "documents").select("doc_id", "text", "lang", "source"))


SQL = r"""
WITH d AS (SELECT row_number() OVER () AS rid, doc_id, coalesce('=' || lang, 'null') AS gl, coalesce('=' || source, 'null') AS gs, coalesce(text, '') AS t FROM documents),
w AS (SELECT *, regexp_extract_all(t, '[^\x20\x09-\x0D]+') AS ws FROM d),
win AS (SELECT rid, i, ws[i] || ' ' || ws[i + 1] || ' ' || ws[i + 2] AS g FROM (SELECT rid, ws, unnest(range(1, len(ws) - 1)) AS i FROM w WHERE len(ws) >= 3)),
rep AS (SELECT rid, i FROM (SELECT rid, i, count(*) OVER (PARTITION BY rid, g) AS c FROM win) WHERE c > 1),
cov AS (SELECT rid, count(*) AS r FROM (SELECT DISTINCT rid, i + o AS p FROM rep, (VALUES (0), (1), (2)) AS v(o)) GROUP BY rid),
ln AS (SELECT rid, count(*) - count(DISTINCT x) AS dl FROM (SELECT rid, unnest(string_split(t, chr(10))) AS x FROM d) WHERE regexp_matches(x, '[^\x20\x09-\x0D]') GROUP BY rid),
m AS (SELECT w.rid, doc_id, gl, gs, len(ws)::BIGINT AS n_words, length(regexp_replace(t, '[\x20\x09-\x0D]', '', 'g'))::BIGINT AS word_chars,
  (length(t) - length(regexp_replace(t, '[#*$%&|<>]', '', 'g')))::BIGINT AS n_symbols, coalesce(dl, 0)::BIGINT AS n_dup_lines, coalesce(r, 0)::BIGINT AS n_repeat_words
  FROM w LEFT JOIN cov USING (rid) LEFT JOIN ln USING (rid)),
b AS (SELECT *, n_words < 50 OR 100 * n_repeat_words > 50 * n_words AS base_failed, greatest(n_words, 1) AS n FROM m),
rt AS (SELECT *, (n_symbols * 10000 + n - 1) // n AS symbols, (n_dup_lines * 10000 + n - 1) // n AS dup_lines, (n_repeat_words * 10000 + n - 1) // n AS repeats, word_chars * 1000 // n AS word_len FROM b),
lg AS (UNPIVOT (SELECT gl, gs, symbols, dup_lines, repeats, word_len FROM rt WHERE NOT base_failed) ON symbols, dup_lines, repeats, word_len INTO NAME measure VALUE v),
bn AS (SELECT *, (v >> greatest(length(bin(v)) - 7, 0)::BIGINT) << greatest(length(bin(v)) - 7, 0)::BIGINT AS bin FROM lg),
gg AS (SELECT 2 AS level, gl, gs, measure, bin FROM bn UNION ALL SELECT 1, gl, '', measure, bin FROM bn UNION ALL SELECT 0, '', '', measure, bin FROM bn),
q AS (SELECT level, gl, gs, measure, count(*) AS rows, list(bin ORDER BY bin) AS bs FROM gg GROUP BY ALL),
p AS (SELECT *, CASE WHEN measure = 'word_len' THEN 1.25::DOUBLE ELSE 4::DOUBLE END AS tail, CASE measure WHEN 'word_len' THEN 0::DOUBLE WHEN 'repeats' THEN 1200::DOUBLE ELSE 200::DOUBLE END AS least,
  list_transform(range(1, 11), lambda k: bs[ceil(rows * (1 - 0.5::DOUBLE ** k))::BIGINT]::DOUBLE) AS up, list_transform(range(1, 11), lambda k: bs[ceil(rows * 0.5::DOUBLE ** k)::BIGINT]::DOUBLE) AS down FROM q),
fe AS (SELECT level, gl, gs, measure, rows, tail * list_reduce(list_prepend(greatest(up[1], least), up[2:]), lambda x, y: CASE WHEN y > x * tail THEN x ELSE greatest(x, y) END) AS hi,
  CASE WHEN measure = 'word_len' THEN list_reduce(down, lambda x, y: CASE WHEN y * tail < x THEN x ELSE least(x, y) END) / tail END AS lo FROM p),
f1 AS (SELECT a.gl, measure, floor(exp(a.rows / (a.rows + 200) * ln(greatest(a.hi, 1)) + (1 - a.rows / (a.rows + 200)) * ln(greatest(w.hi, 1))) * 1000 + 0.5) / 1000 AS hi,
  floor(exp(a.rows / (a.rows + 200) * ln(greatest(a.lo, 1)) + (1 - a.rows / (a.rows + 200)) * ln(greatest(w.lo, 1))) * 1000 + 0.5) / 1000 AS lo
  FROM (FROM fe WHERE level = 1) a JOIN (FROM fe WHERE level = 0) w USING (measure)),
f2 AS (SELECT a.gl, a.gs, measure, floor(exp(a.rows / (a.rows + 200) * ln(greatest(a.hi, 1)) + (1 - a.rows / (a.rows + 200)) * ln(greatest(w.hi, 1))) * 1000 + 0.5) / 1000 AS hi,
  CASE WHEN measure = 'word_len' THEN floor(exp(a.rows / (a.rows + 200) * ln(greatest(a.lo, 1)) + (1 - a.rows / (a.rows + 200)) * ln(greatest(w.lo, 1))) * 1000 + 0.5) / 1000 END AS lo
  FROM (FROM fe WHERE level = 2) a JOIN f1 w USING (gl, measure)),
bad AS (SELECT DISTINCT rid FROM (
  SELECT rid, CASE measure WHEN 'symbols' THEN symbols WHEN 'dup_lines' THEN dup_lines WHEN 'repeats' THEN repeats ELSE word_len END AS v, hi, lo FROM rt JOIN f2 USING (gl, gs))
  WHERE v > hi OR v < lo)
SELECT doc_id, n_words, word_chars, n_symbols, n_dup_lines, n_repeat_words, base_failed, NOT base_failed AND bad.rid IS NULL AS kept FROM rt LEFT JOIN bad USING (rid)
"""
