"""Text functions as Column expressions. Offsets and lengths are code points, 0-based and half-open."""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F

#: White space as a string's strip() has it: the Unicode property, and four separators it does not hold.
SPACE = r"(?U)[\s\x1c-\x1f]"

#: A line ends at any of these.
LINE_END = r"\r\n|[\n\r\x0b\x0c\x1c-\x1e\x85\u2028\u2029]"

LOCATION = "struct<page:int,sheet:string,cell:string,char_start:int,char_end:int>"


def let(value: Column, body) -> Column:
    """``body(value)``, the value computed once a row."""
    return F.transform(F.array(value), body)[0]


def once(value: Column) -> Column:
    """The value, computed once a row however often later steps name it: it is marked as non-deterministic (its condition
    always holds), so that the optimizer neither inlines it into its uses nor pushes filters over it below it."""
    return F.when(F.monotonically_increasing_id() >= 0, value)


#: Numbers that are summed one after another; an array that grows by one costs its length each time.
RUN = 128


def starts(lengths: Column) -> Column:
    """array<int>: the sum of all lengths before each one. In runs of RUN, so that the work grows with the number of
    lengths and not with its square."""
    none = F.expr("cast(array() as array<int>)")

    def running(xs: Column, at: Column) -> Column:
        first = F.struct(at.cast("int").alias("at"), none.alias("out"))
        return F.aggregate(xs, first, lambda a, x: F.struct((a["at"] + x).cast("int").alias("at"), F.concat(a["out"], F.array(a["at"])).alias("out")), lambda a: a["out"])

    def of(xs: Column) -> Column:
        runs = F.transform(F.sequence(F.lit(0), F.floor((F.size(xs) - 1) / RUN).cast("int")), lambda k: F.slice(xs, k * RUN + 1, F.lit(RUN)))
        sums = F.transform(runs, lambda run: F.aggregate(run, F.lit(0), lambda a, x: (a + x).cast("int")))
        each = F.transform(F.arrays_zip(runs.alias("xs"), running(sums, F.lit(0)).alias("at")), lambda z: running(z["xs"], z["at"]))
        return F.when(F.size(xs) == 0, none).otherwise(F.flatten(each))

    return let(F.transform(lengths, lambda x: x.cast("int")), of)


def latest(values: Column) -> Column:
    """array<int>: the greatest value up to and with each place. In runs, as :func:`starts`."""
    none = F.expr("cast(array() as array<int>)")

    def running(xs: Column, top: Column) -> Column:
        first = F.struct(top.alias("top"), none.alias("out"))
        step = lambda a, x: F.struct(F.greatest(a["top"], x).alias("top"), F.concat(a["out"], F.array(F.greatest(a["top"], x))).alias("out"))
        return F.aggregate(xs, first, step, lambda a: a["out"])

    def of(xs: Column) -> Column:
        runs = F.transform(F.sequence(F.lit(0), F.floor((F.size(xs) - 1) / RUN).cast("int")), lambda k: F.slice(xs, k * RUN + 1, F.lit(RUN)))
        least = F.lit(-(1 << 31)).cast("int")
        tops = let(running(F.transform(runs, lambda run: F.array_max(run)), least), lambda t: F.concat(F.array(least), F.slice(t, 1, F.size(t) - 1)))
        return F.when(F.size(xs) == 0, none).otherwise(F.flatten(F.transform(F.arrays_zip(runs.alias("xs"), tops.alias("top")), lambda z: running(z["xs"], z["top"]))))

    return let(F.transform(values, lambda x: x.cast("int")), of)


def owners(lows: Column, points: Column) -> Column:
    """array<int>: for each point, in their order, the place of the last of the ascending ``lows`` that is at most the
    point; -1 where there is none. Both lists are merged in one pass, so that the work grows with their lengths (and the
    logarithm of sorting them), not with their product."""
    none = F.expr("cast(array() as array<int>)")
    both = F.sort_array(F.concat(
        F.transform(lows, lambda x, i: F.struct(x.cast("int").alias("at"), F.lit(0).alias("kind"), i.alias("no"))),
        F.transform(points, lambda x, i: F.struct(x.cast("int").alias("at"), F.lit(1).alias("kind"), i.alias("no"))),
    ))

    def of(events: Column) -> Column:
        last = latest(F.transform(events, lambda e: F.when(e["kind"] == 0, e["no"]).otherwise(F.lit(-1))))
        told = F.filter(F.arrays_zip(events.alias("e"), last.alias("low")), lambda z: z["e"]["kind"] == 1)
        ordered = F.sort_array(F.transform(told, lambda z: F.struct(z["e"]["no"].alias("no"), z["low"].alias("low"))))
        return F.transform(ordered, lambda z: z["low"])

    return F.when(F.size(points) == 0, none).when(F.size(lows) == 0, F.transform(points, lambda x: F.lit(-1))).otherwise(let(both, of))


def decode(content: Column) -> Column:
    """Strict UTF-8: null where the bytes are not valid."""
    return F.try_validate_utf8(content.cast("string"))


def strip(text: Column) -> Column:
    return F.regexp_replace(F.regexp_replace(text, f"^{SPACE}+", ""), f"{SPACE}+$", "")


def is_blank(text: Column) -> Column:
    return ~text.rlike(r"(?U)[^\s\x1c-\x1f]")


def printable_ratio(text: Column) -> Column:
    """Share of characters outside the categories Other and Separator; space, line feed and tab count. Empty: 0."""
    rest = F.regexp_count(text, F.lit(r"[\p{C}\p{Z}&&[^ \n\t]]"))
    return F.when(F.length(text) == 0, F.lit(0.0)).otherwise((F.length(text) - rest) / F.length(text))


def density(text: Column) -> Column:
    """Share of characters that are no white space. Empty: 0."""
    return F.when(F.length(text) == 0, F.lit(0.0)).otherwise(F.length(F.regexp_replace(text, SPACE + "+", "")) / F.length(text))


def line_spans(text: Column) -> Column:
    """array<struct<char_start,char_end,text>>: the lines of a text without their line feed; empty ones give no span but
    count for the offsets. A carriage return stays in the span's text."""
    def build(parts: Column) -> Column:
        def placed(seps: Column) -> Column:
            at = starts(F.transform(parts, lambda x, i: F.length(x) + F.length(F.coalesce(F.get(seps, i), F.lit("")))))

            def spans(at: Column) -> Column:
                line = lambda x, i: F.concat(x, F.regexp_replace(F.coalesce(F.get(seps, i), F.lit("")), r"\n$", ""))
                lines = F.transform(parts, lambda x, i: F.struct(F.get(at, i).alias("at"), line(x, i).alias("text")))
                spans = F.transform(lines, lambda x: F.struct(x["at"].alias("char_start"), (x["at"] + F.length(x["text"])).alias("char_end"), x["text"].alias("text")))
                return F.filter(spans, lambda x: x["char_end"] > x["char_start"])

            return let(at, spans)

        return let(F.regexp_extract_all(text, F.lit(LINE_END), F.lit(0)), placed)

    return let(F.split(text, LINE_END, -1), build)


def matches(text: Column, pattern: str) -> Column:
    """array<struct<s,e,m>>: the non-overlapping matches of a pattern, with their offsets."""
    none = F.expr("cast(array() as array<struct<s:int,e:int,m:string>>)")

    def place(hits: Column) -> Column:
        def located(gaps: Column) -> Column:
            at = starts(F.transform(hits, lambda h, i: F.length(F.get(gaps, i)) + F.length(h)))

            def spans(at: Column) -> Column:
                begun = F.transform(hits, lambda h, i: F.struct((F.get(at, i) + F.length(F.get(gaps, i))).alias("s"), h.alias("m")))
                return F.transform(begun, lambda x: F.struct(x["s"].alias("s"), (x["s"] + F.length(x["m"])).alias("e"), x["m"].alias("m")))

            return let(at, spans)

        return F.when(F.size(hits) == 0, none).otherwise(let(F.split(text, pattern, -1), located))

    return let(F.regexp_extract_all(text, F.lit(pattern), F.lit(0)), place)


def find_all(text: Column, pattern: str) -> Column:
    """array<struct<char_start,char_end>>: the non-overlapping matches of a pattern."""
    return F.transform(matches(text, pattern), lambda m: F.struct(m["s"].alias("char_start"), m["e"].alias("char_end")))


def char_location(start: Column, end: Column) -> Column:
    return F.struct(
        F.lit(None).cast("int").alias("page"), F.lit(None).cast("string").alias("sheet"), F.lit(None).cast("string").alias("cell"),
        start.cast("int").alias("char_start"), end.cast("int").alias("char_end"),
    )


def span_bounds(spans: Column) -> Column:
    """array<struct<lo,hi,location>>: where the spans (array<struct<location,text>>) lie in the text that joins them by one
    line feed each."""
    at = starts(F.transform(spans, lambda s: F.length(s["text"]) + 1))
    return let(at, lambda at: F.transform(spans, lambda s, i: F.struct(F.get(at, i).alias("lo"), (F.get(at, i) + F.length(s["text"])).alias("hi"), s["location"].alias("location"))))


def _anchored(location: Column) -> Column:
    return F.coalesce(location["page"].isNotNull() | location["sheet"].isNotNull(), F.lit(False))


def locations(bounds: Column, begins: Column, ends: Column) -> Column:
    """array<LOCATION>: of each pair of offsets by :func:`span_bounds`: the page or sheet of the span that owns the first
    offset, or the offsets themselves where there is no such anchor (a line feed between spans belongs to none). By a merge
    of spans and offsets; texts without anchored spans need none."""
    pairs = F.arrays_zip(begins.alias("s"), ends.alias("e"))
    plain = F.transform(pairs, lambda p: char_location(p["s"], p["e"]))

    def merged(of: Column) -> Column:
        def place(p: Column, i: Column) -> Column:
            b = F.get(bounds, F.get(of, i))
            own = F.coalesce((b["hi"] > p["s"]) & _anchored(b["location"]), F.lit(False))
            return F.when(own, b["location"]).otherwise(char_location(p["s"], p["e"]))

        return F.transform(pairs, place)

    return F.when(F.exists(bounds, lambda b: _anchored(b["location"])), let(owners(F.transform(bounds, lambda b: b["lo"]), begins), merged)).otherwise(plain)


def resolve_location(spans: Column, start: Column, end: Column) -> Column:
    """The location of one pair of offsets, as :func:`locations`, by the spans themselves."""
    return let(span_bounds(spans), lambda b: locations(b, F.array(start), F.array(end))[0])


def evidence(location: Column) -> Column:
    """A location in words: ``p7, sheet X, cell B2, chars 3–9``, or a dash."""
    shown = F.concat_ws(
        ", ",
        F.when(location["page"].isNotNull(), F.concat(F.lit("p"), location["page"].cast("string"))),
        F.when(location["sheet"].isNotNull(), F.concat(F.lit("sheet "), location["sheet"])),
        F.when(location["cell"].isNotNull(), F.concat(F.lit("cell "), location["cell"])),
        F.when(location["char_start"].isNotNull(), F.concat(F.lit("chars "), location["char_start"].cast("string"), F.lit("–"), location["char_end"].cast("string"))),
    )
    return F.coalesce(F.nullif(shown, F.lit("")), F.lit("—"))


def redact(text: Column) -> Column:
    return F.concat(F.lit("<redacted:"), F.length(text).cast("string"), F.lit(" chars>"))


def log_line(item: Column, stage: Column, outcome: Column) -> Column:
    return F.concat(F.lit("item="), item, F.lit(" stage="), stage, F.lit(" outcome="), outcome)


def whole(score: Column) -> Column:
    """A score as text without decimals, halves to even."""
    return F.bround(score, 0).cast("long").cast("string")
