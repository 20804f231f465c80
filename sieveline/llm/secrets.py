"""Operator 8, secret scans: a randomness test battery with length-aware false-discovery control, native expressions only.

Beside the patterns (assign, access, hex), every run of at least MIN_LENGTH characters of the base64 alphabets is a
candidate. Its encoding is inferred (hex, base32, base36, base64), and three tests ask whether it is too random for the
corpus's words of that encoding: the chi-squared statistic of uniformity over the encoding's alphabet, the number of runs
of character classes, and the serial correlation of neighbouring characters. Under the null hypothesis the rates are
those of the corpus's own long words (letters only, no capital inside) that have the same encoding. The p-values are
combined by Fisher's method. Candidates of each encoding and length class (binary logarithm) form a family; the
Benjamini-Hochberg step-up rule, on a histogram of -10 log10 p over the whole corpus, gives each family its threshold.
What passes must also agree with uniformity: its chi-squared statistic against the alphabet, with the degrees of freedom
of that alphabet, may not lie in the upper tail. The thresholds (a bounded table: encodings times length classes) go into
the second pass as literals.
"""

from __future__ import annotations

from dataclasses import dataclass

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from ..functions.text import latest, matches, owners
from .common import let, save, table

MIN_LENGTH = 16

TOKEN = f"(?<![A-Za-z0-9+/_=-])[A-Za-z0-9+/_-]{{{MIN_LENGTH},}}+={{0,2}}"

#: Patterns of the base kinds, in the order of the kinds.
ASSIGN = r"""(?i:password|passwd|secret|token|api_?key)["']?\x20*[:=]\x20*["']?([A-Za-z0-9+/_.=-]+)"""
ACCESS = r"AKIA[A-Z0-9]{12,}"
HEX = r"[0-9a-f]{32,}"
KINDS = ("assign", "access", "hex", "random")

ENCODINGS = ("hex", "base32", "base36", "base64")

#: Characters of their alphabets.
ALPHABETS = (16, 32, 36, 64)


@dataclass(frozen=True)
class Battery:
    """q: false-discovery rate of each family; least_evidence: -10 log10 p that an accepted token has at least; uniform:
    greatest normal score of an accepted token's chi-squared statistic; the null rates hold where the corpus has no long
    words; least_transitions is a floor for the words' rate of class changes; least_words: words that an encoding needs
    for rates of its own, else those of all words hold."""

    q: float = 0.001
    least_evidence: int = 50
    uniform: float = 4.0
    least_words: int = 100
    coincidence: float = 0.08
    transitions: float = 0.02
    least_transitions: float = 0.02
    serial: float = 0.0


def _none() -> Column:
    return F.expr("cast(array() as array<struct<s:int,k:int,e:int>>)")


def base_spans(text: Column) -> Column:
    """The pattern kinds' spans (s, k, e), unsorted; cheap substring tests keep most texts from the patterns."""
    of = lambda pattern, k, ok: F.transform(F.filter(matches(text, pattern), ok), lambda h: F.struct(h["s"].alias("s"), F.lit(k).alias("k"), h["e"].alias("e")))
    low = F.lower(text)
    keyword = F.lit(False)
    for word in ("passw", "secret", "token", "apikey", "api_key"):
        keyword = keyword | F.contains(low, F.lit(word))
    value = lambda h: F.length(F.regexp_extract(h["m"], ASSIGN, 1)) >= 8
    whole = lambda h: F.length(h["m"]) >= 16
    return F.concat(
        F.when(keyword, of(ASSIGN, 0, value)).otherwise(_none()),
        F.when(F.contains(text, F.lit("AKIA")), of(ACCESS, 1, whole)).otherwise(_none()),
        of(HEX, 2, whole),
    )


def _tail(z: Column) -> Column:
    """P(Z <= z) of a normal variable, by an approximation that keeps its relative precision in the lower tail."""
    low = lambda t: F.exp(-t * t / 2.0) / (F.lit(2.506628274631) * t + 2.0)
    return F.greatest(F.when(z < 0, low(-z)).otherwise(F.lit(1.0) - low(z)), F.lit(1e-300))


def statistics(token: Column) -> Column:
    """A struct of a token's statistics: n, enc, word, pairs (that coincide), changes (of character class), serial."""
    def of(t: Column) -> Column:
        def chars(cs: Column) -> Column:
            n = F.size(cs)
            counts = F.transform(F.array_distinct(cs), lambda c: (F.length(t) - F.length(F.replace(t, c, F.lit("")))).cast("double"))
            pairs = F.aggregate(counts, F.lit(0.0), lambda a, c: a + c * (c - 1.0) / 2.0)
            classes = F.regexp_replace(F.regexp_replace(F.regexp_replace(t, "[a-z]+", "a"), "[A-Z]+", "b"), "[0-9]+", "c")
            changes = F.length(classes) - 1  # symbols stand for themselves

            def serial(codes: Column) -> Column:
                mean = F.aggregate(codes, F.lit(0.0), lambda a, c: a + c) / n
                var = F.aggregate(codes, F.lit(0.0), lambda a, c: a + c * c) - mean * mean * n
                cross = F.aggregate(F.zip_with(F.slice(codes, 1, n - 1), F.slice(codes, 2, n - 1), lambda x, y: (x - mean) * (y - mean)), F.lit(0.0), lambda a, c: a + c)
                return F.when(var > 0, cross / var).otherwise(F.lit(0.0))

            enc = (
                F.when(t.rlike("^([0-9a-f]+|[0-9A-F]+)$"), 0).when(t.rlike("^[A-Z2-7]+=*$"), 1).when(t.rlike("^([0-9a-z]+|[0-9A-Z]+)$"), 2).otherwise(3)
            )
            return F.struct(
                n.alias("n"), enc.alias("enc"), t.rlike("^[A-Za-z][a-z]+$").alias("word"), t.rlike("[A-Za-z]").alias("letters"), pairs.alias("pairs"), changes.cast("double").alias("changes"),
                let(F.transform(cs, lambda c: F.ascii(c).cast("double")), serial).alias("serial"),
            )

        return let(F.split(t, ""), lambda parts: let(F.array_remove(parts, ""), chars))

    return let(token, of)


def chi_squared(s: Column) -> Column:
    """The statistic of uniformity over the alphabet of a token's encoding, from the coinciding pairs of its characters."""
    n, size = s["n"].cast("double"), _by_encoding(s, ALPHABETS)
    return size * (s["pairs"] * 2.0 + n) / n - n


def _by_encoding(s: Column, values) -> Column:
    return F.get(F.array(*[F.lit(float(v)) for v in values]), s["enc"])


def _uniform(s: Column, limit: float) -> Column:
    """Whether the chi-squared statistic's normal score (Wilson and Hilferty) is at most ``limit``."""
    df = _by_encoding(s, ALPHABETS) - 1.0
    c = F.lit(2.0) / (F.lit(9.0) * df)
    return F.cbrt(chi_squared(s) / df) <= F.lit(1.0) - c + F.lit(limit) * F.sqrt(c)


def _evidence(s: Column, nulls: tuple[dict[str, float], ...]) -> Column:
    """-10 log10 of the combined p-value of a token's statistics, as a whole number up to 3000. ``nulls``: the words' rates
    by encoding. Under them the chi-squared statistic has the mean size * (1 + (n - 1) k) - n."""
    n = s["n"].cast("double")
    k, t, r = (_by_encoding(s, [x[c] for x in nulls]) for c in ("coincidence", "transitions", "serial"))
    size = _by_encoding(s, ALPHABETS)
    mean, sd = size * (F.lit(1.0) + (n - 1.0) * k) - n, F.lit(2.0) * size / n * F.sqrt(n * (n - 1.0) / 2.0 * k * (1.0 + 2.0 * n * k))
    uniform = _tail((chi_squared(s) + size / n - mean) / sd)
    runs = _tail(-(s["changes"] - 0.5 - (n - 1.0) * t) / F.sqrt((n - 1.0) * t * (1.0 - t)))
    serial = _tail(-(s["serial"] - r) * F.when(r > 0, -1.0).otherwise(1.0) * F.sqrt(n))
    y = -(F.log(uniform) + F.log(runs) + F.log(serial))
    combined = y - F.log(F.lit(1.0) + y + y * y / 2.0)  # -ln of the chi-squared tail with six degrees of freedom
    return F.least(F.floor(combined * 4.342944819), F.lit(3000)).cast("int")


def _family(s: Column) -> Column:
    """Encoding and length class as one number."""
    return s["enc"] * 100 + F.length(F.bin(s["n"]))


def calibrate(docs: DataFrame, battery: Battery = Battery()) -> tuple[tuple[dict[str, float], ...], dict[int, int]]:
    """The null rates by encoding and the families' thresholds of evidence, from all candidates of all texts.

    What comes to the driver is a row of rates an encoding and a row a family: at most len(ENCODINGS) * 32."""
    found = docs.select(F.explode(F.regexp_extract_all(F.col("text"), F.lit(TOKEN), F.lit(0))).alias("t"))
    rows = save(found.select(statistics(F.col("t")).alias("s")).select("s.*"), "secret-statistics")
    sums = rows.where("word").groupBy("enc").agg(
        F.sum("pairs").alias("p"), F.sum(F.col("n") * (F.col("n") - 1) / 2.0).alias("pn"), F.sum("changes").alias("c"), F.sum(F.col("n") - 1).alias("cn"),
        F.sum("serial").alias("s"), F.count("*").alias("words"),
    ).collect()
    by = {r["enc"]: r for r in sums}
    whole = {c: sum(r[c] for r in sums) for c in ("p", "pn", "c", "cn", "s", "words")}

    def rates(r) -> dict[str, float]:
        if not r["pn"]:
            return {"coincidence": battery.coincidence, "transitions": battery.transitions, "serial": battery.serial}
        return {"coincidence": max(r["p"] / r["pn"], 0.01), "transitions": min(max(r["c"] / r["cn"], battery.least_transitions), 0.5), "serial": r["s"] / r["words"]}

    null = tuple(rates(by[e] if e in by and by[e]["words"] >= battery.least_words else whole) for e in range(len(ENCODINGS)))
    s = F.struct(*[F.col(c) for c in rows.columns])
    bins = rows.where("letters").groupBy(_family(s).alias("family"), _evidence(s, null).alias("bin")).agg(F.count("*").alias("n"))
    from pyspark.sql import Window

    down = Window.partitionBy("family").orderBy(F.col("bin").desc()).rowsBetween(Window.unboundedPreceding, Window.currentRow)
    ranked = bins.withColumns({"above": F.sum("n").over(down), "m": F.sum("n").over(Window.partitionBy("family"))})
    passed = ranked.where(F.pow(F.lit(10.0), -F.col("bin") / 10.0) <= F.lit(battery.q) * F.col("above") / F.col("m"))
    limits = passed.groupBy("family").agg(F.min("bin").alias("bin")).collect()
    return null, {r["family"]: max(r["bin"], battery.least_evidence) for r in limits}


def _random_spans(text: Column, base: Column, null: tuple[dict[str, float], ...], limits: dict[int, int], uniform: float) -> Column:
    if not limits:
        return _none()
    limit = F.create_map(*[F.lit(x) for kv in sorted(limits.items()) for x in kv])

    def random(h: Column) -> Column:
        return let(statistics(h["m"]), lambda s: F.coalesce(s["letters"] & _uniform(s, uniform) & (_evidence(s, null) >= F.try_element_at(limit, _family(s))), F.lit(False)))

    def free(hits: Column) -> Column:
        """Hits that overlap no base span: of the base spans that begin before a hit ends, none ends behind its start. The
        last such span is found by a merge of both sorted lists, the greatest end up to it is a running maximum."""
        ends = latest(F.transform(base, lambda b: b["e"]))
        last = owners(F.transform(base, lambda b: b["s"]), F.transform(hits, lambda h: h["e"] - 1))
        both = let(ends, lambda ends: let(last, lambda last: F.filter(hits, lambda h, i: F.coalesce(F.get(ends, F.get(last, i)) <= h["s"], F.lit(True)))))
        return F.when(F.size(base) == 0, hits).otherwise(both)

    found = let(matches(text, TOKEN), lambda hits: F.filter(free(hits), random))
    return F.transform(found, lambda h: F.struct(h["s"].alias("s"), F.lit(3).alias("k"), h["e"].alias("e")))


def found_spans(text: Column, null: tuple[dict[str, float], ...], limits: dict[int, int], uniform: float = Battery().uniform) -> Column:
    """A struct of arrays (s, k, e) in order: base, and all (base spans stay; tests add those that overlap none)."""
    text = F.coalesce(text, F.lit(""))
    return let(F.sort_array(base_spans(text)), lambda b: F.struct(b.alias("base"), F.sort_array(F.concat(b, _random_spans(text, b, null, limits, uniform))).alias("all")))


def _joined(spans: Column) -> Column:
    kinds = F.array(*[F.lit(k) for k in KINDS])
    return F.array_join(F.transform(spans, lambda x: F.concat(F.get(kinds, x["k"]), F.lit(":"), x["s"].cast("string"), F.lit(":"), x["e"].cast("string"))), ",")


def scan(docs: DataFrame, battery: Battery = Battery()) -> DataFrame:
    """A row per document: doc_id, found (base and all spans as arrays of (s, k, e)), and the other columns of ``docs``.

    A null or empty text has no spans. Repeated rows give equal rows and count as often in the calibration; an empty
    table gives no rows. Nothing is shuffled but the histogram of the calibration."""
    if "found" in docs.columns:
        raise ValueError("the table has a column named found")
    null, limits = calibrate(docs.select("text"), battery)
    return docs.withColumn("found", found_spans(F.col("text"), null, limits, battery.uniform))


def op8_secret_battery(spark: SparkSession, sf_dir: str) -> DataFrame:
    found = scan(table(spark, sf_dir, "documents").select("doc_id", "text"))
    count = lambda k: F.size(F.filter(F.col("found.base"), lambda x: x["k"] == k)).cast("long")
    return found.select(
        F.col("doc_id").cast("long").alias("doc_id"), count(0).alias("n_assign"), count(1).alias("n_access"), count(2).alias("n_hex"),
        F.sha2(_joined(F.col("found.base")).cast("binary"), 256).alias("base_sha256"), _joined(F.col("found.all")).alias("spans"),
    )


SQL = None
