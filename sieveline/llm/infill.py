"""Operator 12, fill-in-middle transformation by escaped marker injection, string functions only.

A text is escaped so that a delimiter cannot stand in it; ``regexp_replace`` appends the delimiter after each unit; their
number is the number of units; ``substring_index`` extracts the units up to a rank, or from one on. Two ranks, drawn from a
hash of the id, cut the text into prefix, middle and suffix, which are unescaped and assembled behind markers. Nothing is
shuffled, and the work grows with the length of the texts.
"""

from __future__ import annotations

from dataclasses import dataclass

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from .common import table

#: The delimiter, the escape character, and what stands for each of them behind it.
DELIMITER, ESCAPE = "\x01", "\x02"
STANDS = {ESCAPE: ESCAPE + "e", DELIMITER: ESCAPE + "d"}


@dataclass(frozen=True)
class Infill:
    """unit: pattern whose matches, left to right, are all of a text (possessive: no backtracking); none may match a
    delimiter or escape in part. rate, spm_rate: percentages of texts that are transformed, and of those whose suffix comes
    first; seed: of the draws; markers: before prefix, suffix and middle. No marker may hold another one's first character
    but at its start, so that none arises where parts meet."""

    unit: str = r"[^\n]*+\n|[^\n]++"
    rate: int = 100
    spm_rate: int = 50
    seed: int = 7
    markers: tuple[str, str, str] = ("<P>", "<S>", "<M>")

    def __post_init__(self) -> None:
        if len({m[:1] for m in self.markers} - {""}) != 1 or any(self.markers[0][0] in m[1:] for m in self.markers) or len(set(self.markers)) != 3:
            raise ValueError("markers begin with one character that does not come again in them")


def escaped(text: Column) -> Column:
    for c, to in STANDS.items():  # the escape character first
        text = F.replace(text, F.lit(c), F.lit(to))
    return text


def unescaped(text: Column) -> Column:
    for c, to in reversed(STANDS.items()):
        text = F.replace(text, F.lit(to), F.lit(c))
    return text


def injected(text: Column, unit: str = Infill.unit) -> Column:
    """The escaped text with a delimiter after each unit."""
    return F.regexp_replace(escaped(text), unit, "$0" + DELIMITER)


def count_units(marked: Column) -> Column:
    return (F.length(marked) - F.length(F.replace(marked, F.lit(DELIMITER), F.lit("")))).cast("long")


def units(marked: Column, first: Column, last: Column, n: Column) -> Column:
    """The text of the units from ``first`` on (from 0) and before ``last``."""
    head = F.call_function("substring_index", marked, F.lit(DELIMITER), last.cast("int"))
    # of what ends with unit ``last`` - 1 the delimiter behind it is gone; a count of none gives nothing
    cut = F.when(last >= n, F.call_function("substring_index", marked, F.lit(DELIMITER), -(n - first + 1).cast("int"))).otherwise(F.call_function("substring_index", head, F.lit(DELIMITER), -(last - first).cast("int")))
    return unescaped(F.replace(cut, F.lit(DELIMITER), F.lit("")))


def _draw(digest: Column, k: int) -> Column:
    """The k-th group of eight hex digits as an unsigned number."""
    return F.conv(F.substring(digest, 1 + 8 * k, 8), 16, 10).cast("long")


def fill_in_middle(docs: DataFrame, to: Infill = Infill(), name: str = "fim") -> DataFrame:
    """The rows of ``docs`` with a struct column ``name``: n (units), form (plain, psm or spm), prefix, middle, suffix (null
    if plain) and output.

    A null or empty text has no units, the form plain and the output of an empty text; so is every text that holds a marker
    (then the output is the text). A row without an id draws as an empty id; repeated rows draw alike. An empty table gives
    no rows; other columns stay, but for one named like the result, which is an error."""
    if name in docs.columns:
        raise ValueError(f"the table has a column named {name}")
    p, s, m = (F.lit(x) for x in to.markers)
    row = F.struct("*").alias("_row")  # so that no column of the table clashes with a step's
    text = F.coalesce(F.col("text"), F.lit(""))
    h = F.sha2(F.concat(F.lit(f"{to.seed}:"), F.coalesce(F.col("doc_id").cast("string"), F.lit(""))).cast("binary"), 256)
    held = F.contains(text, p) | F.contains(text, s) | F.contains(text, m)
    steps = docs.select(row, text.alias("t"), h.alias("h"), held.alias("held"))
    steps = steps.withColumn("marked", injected(F.col("t"), to.unit)).withColumn("n", count_units(F.col("marked")))
    plain = (F.col("t") == "") | F.col("held") | (_draw(F.col("h"), 2) % 100 >= to.rate)
    form = F.when(plain, "plain").when(_draw(F.col("h"), 3) % 100 < to.spm_rate, "spm").otherwise("psm")
    one, two = _draw(F.col("h"), 0) % (F.col("n") + 1), _draw(F.col("h"), 1) % (F.col("n") + 1)
    steps = steps.withColumns({"form": form, "a": F.least(one, two), "b": F.greatest(one, two)})
    part = lambda first, last: F.when(F.col("form") != "plain", units(F.col("marked"), first, last, F.col("n")))
    steps = steps.withColumns({"prefix": part(F.lit(0), F.col("a")), "middle": part(F.col("a"), F.col("b")), "suffix": part(F.col("b"), F.col("n"))})
    pre, mid, suf = F.col("prefix"), F.col("middle"), F.col("suffix")
    output = F.when(F.col("form") == "psm", F.concat(p, pre, s, suf, m, mid)).when(F.col("form") == "spm", F.concat(s, suf, p, pre, m, mid)).otherwise(F.col("t"))
    made = F.struct("n", "form", "prefix", "middle", "suffix", output.alias("output"))
    return steps.select("_row.*", made.alias(name))


def restored(output: Column, form: Column, to: Infill = Infill()) -> Column:
    """The exact text, from output and form alone: parts hold no marker, so each marker stands once."""
    first, second = (F.when(form == "psm", F.lit(x)).otherwise(F.lit(y)) for x, y in ((to.markers[0], to.markers[1]), (to.markers[1], to.markers[0])))
    between = lambda a, b: F.call_function("substring_index", F.call_function("substring_index", output, a, F.lit(-1)), b, F.lit(1))
    head, tail, mid = between(first, second), between(second, F.lit(to.markers[2])), F.call_function("substring_index", output, F.lit(to.markers[2]), F.lit(-1))
    return F.when(form == "plain", output).when(form == "psm", F.concat(head, mid, tail)).otherwise(F.concat(tail, mid, head))


def op12_fill_in_middle(spark: SparkSession, sf_dir: str) -> DataFrame:
    made = fill_in_middle(table(spark, sf_dir, "documents").select("doc_id", "text"))
    digest = lambda c: F.sha2(c.cast("binary"), 256)
    return made.select(
        F.col("doc_id").cast("long").alias("doc_id"), F.col("fim.n").alias("n"), F.col("fim.form").alias("form"), F.length("fim.prefix").cast("long").alias("prefix_chars"),
        F.length("fim.middle").cast("long").alias("middle_chars"), digest(F.col("fim.output")).alias("output_sha256"), digest(restored(F.col("fim.output"), F.col("fim.form"))).alias("restored_sha256"),
    )


SQL = r"""
WITH t AS (SELECT doc_id, coalesce(text, '') AS t, sha256('7:' || coalesce(doc_id::VARCHAR, '')) AS h FROM documents),
u AS (SELECT doc_id, t, regexp_extract_all(t, '[^\n]*\n|[^\n]+') AS u, ('0x' || h[1:8])::BIGINT AS h1, ('0x' || h[9:16])::BIGINT AS h2, ('0x' || h[17:24])::BIGINT AS h3, ('0x' || h[25:32])::BIGINT AS h4 FROM t),
r AS (SELECT doc_id, t, u, len(u) AS n, least(h1 % (len(u) + 1), h2 % (len(u) + 1)) AS a, greatest(h1 % (len(u) + 1), h2 % (len(u) + 1)) AS b,
  CASE WHEN t = '' OR contains(t, '<P>') OR contains(t, '<S>') OR contains(t, '<M>') OR h3 % 100 >= 100 THEN 'plain' WHEN h4 % 100 < 50 THEN 'spm' ELSE 'psm' END AS form FROM u),
p AS (SELECT doc_id, t, n, form, array_to_string(u[1:a], '') AS pre, array_to_string(u[a + 1:b], '') AS mid, array_to_string(u[b + 1:n], '') AS suf FROM r)
SELECT doc_id, n::BIGINT AS n, form, CASE WHEN form <> 'plain' THEN length(pre) END::BIGINT AS prefix_chars, CASE WHEN form <> 'plain' THEN length(mid) END::BIGINT AS middle_chars,
  sha256(CASE form WHEN 'plain' THEN t WHEN 'psm' THEN '<P>' || pre || '<S>' || suf || '<M>' || mid ELSE '<S>' || suf || '<P>' || pre || '<M>' || mid END) AS output_sha256,
  sha256(t) AS restored_sha256 FROM p
"""
