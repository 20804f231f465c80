"""Operator 13, license scans with a positional rare-token index, native expressions only.

Templates are licence notices and texts. The corpus gives each of their words a document frequency; a template's words of
the highest inverse frequency are indexed, each with its positions in the template. A file looks up those of its own words
that the index holds, which are its highest-IDF licence words; every place of such a word votes for the offset between
file and template, so that postings intersect by relative position. Offsets are binned, by two binnings half a bin apart,
so that small insertions do no harm. Where enough different words of a template agree on an offset, the words there must
hold the template's mandatory key phrases. Two passes over the texts: frequencies (a row a licence word, which the
templates bound), and the look-up, all within the row; nothing but the frequencies is shuffled.
"""

from __future__ import annotations

import json
import re
from dataclasses import dataclass

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from .common import let, lower_ascii, table

#: What stands between words; texts are lower-cased before.
BETWEEN = r"[\x00-\x2F\x3A-\x60\x7B-\x7F]+"


@dataclass(frozen=True)
class Template:
    """label; text: a notice or licence text; phrases: all of them must stand where the text was found."""

    label: str
    text: str
    phrases: tuple[str, ...]


# fixed values: wording of public licences and of the notices that they ask for
_AS_IS = (
    "THE SOFTWARE IS PROVIDED \"AS IS\", WITHOUT WARRANTY OF ANY KIND, EXPRESS OR IMPLIED, INCLUDING BUT NOT LIMITED TO THE WARRANTIES OF MERCHANTABILITY, "
    "FITNESS FOR A PARTICULAR PURPOSE AND NONINFRINGEMENT."
)
_BSD = (
    "Redistribution and use in source and binary forms, with or without modification, are permitted provided that the following conditions are met: "
    "Redistributions of source code must retain the above copyright notice, this list of conditions and the following disclaimer. "
    "Redistributions in binary form must reproduce the above copyright notice, this list of conditions and the following disclaimer in the documentation and/or other materials provided with the distribution."
)
_GNU = (
    "This program is free software: you can redistribute it and/or modify it under the terms of the GNU {name} General Public License as published by the Free Software Foundation, "
    "either version {version} of the License, or (at your option) any later version."
)
TEMPLATES = (
    Template("apache-2.0", "Licensed under the Apache License, Version 2.0", ("apache license version 2 0",)),
    Template(
        "apache-2.0",
        "you may not use this file except in compliance with the License. You may obtain a copy of the License at. Unless required by applicable law or agreed to in writing, software distributed "
        "under the License is distributed on an \"AS IS\" BASIS, WITHOUT WARRANTIES OR CONDITIONS OF ANY KIND, either express or implied.",
        ("except in compliance with the license", "warranties or conditions of any kind"),
    ),
    Template(
        "mit",
        "Permission is hereby granted, free of charge, to any person obtaining a copy of this software and associated documentation files (the \"Software\"), to deal in the Software without restriction, "
        "including without limitation the rights to use, copy, modify, merge, publish, distribute, sublicense, and/or sell copies of the Software, and to permit persons to whom the Software is furnished to do so",
        ("deal in the software without restriction", "merge publish distribute sublicense"),
    ),
    Template("mit", "This software is released under the MIT License", ("mit license",)),
    Template("mit", "Licensed under the MIT License", ("mit license",)),
    Template(
        "isc", "Permission to use, copy, modify, and/or distribute this software for any purpose with or without fee is hereby granted, provided that the above copyright notice and this permission notice appear in all copies.",
        ("for any purpose with or without fee",),
    ),
    Template("bsd", _BSD, ("source and binary forms", "must reproduce the above copyright notice")),
    Template(
        "bsd-3-clause",
        "Neither the name of the copyright holder nor the names of its contributors may be used to endorse or promote products derived from this software without specific prior written permission.",
        ("endorse or promote products derived from this software",),
    ),
    Template("gpl", _GNU.format(name="", version="3"), ("gnu general public license as published",)),
    Template("gpl-3.0", "licensed under the GNU General Public License, version 3", ("gnu general public license version 3",)),
    Template("gpl-2.0", "licensed under the GNU General Public License, version 2", ("gnu general public license version 2",)),
    Template("lgpl", _GNU.format(name="Lesser", version="2.1"), ("gnu lesser general public license",)),
    Template("agpl", _GNU.format(name="Affero", version="3"), ("gnu affero general public license",)),
    Template(
        "mpl-2.0", "This Source Code Form is subject to the terms of the Mozilla Public License, v. 2.0. If a copy of the MPL was not distributed with this file, You can obtain one at",
        ("mozilla public license v 2 0",),
    ),
    Template(
        "zlib",
        "This software is provided 'as-is', without any express or implied warranty. In no event will the authors be held liable for any damages arising from the use of this software. Permission is granted to anyone "
        "to use this software for any purpose, including commercial applications, and to alter it and redistribute it freely",
        ("alter it and redistribute it freely",),
    ),
    Template("bsl-1.0", "Distributed under the Boost Software License, Version 1.0", ("boost software license version 1 0",)),
    Template(
        "unlicense",
        "This is free and unencumbered software released into the public domain. Anyone is free to copy, modify, publish, use, compile, sell, or distribute this software, either in source code form or as a compiled binary, "
        "for any purpose, commercial or non-commercial, and by any means.",
        ("free and unencumbered software released into the public domain",),
    ),
    Template("epl-2.0", "This program and the accompanying materials are made available under the terms of the Eclipse Public License 2.0", ("eclipse public license",)),
    Template("no-warranty", _AS_IS, ("without warranty of any kind", "fitness for a particular purpose")),
    Template("cc0-1.0", "To the extent possible under law, the author has dedicated all copyright and related and neighboring rights to this work to the public domain worldwide", ("related and neighboring rights",)),
    Template("cc-by-4.0", "Licensed under CC BY 4.0", ("cc by 4 0",)),
    Template("cc-by-4.0", "This work is licensed under a Creative Commons Attribution 4.0 International License", ("creative commons attribution 4 0",)),
    Template("cc-by-sa-4.0", "Licensed under CC BY-SA 4.0", ("cc by sa 4 0",)),
    Template("cc-by-sa-4.0", "This work is licensed under a Creative Commons Attribution-ShareAlike 4.0 International License", ("creative commons attribution sharealike 4 0",)),
    Template("cc-by-nc-4.0", "Licensed under CC BY-NC 4.0", ("cc by nc 4 0",)),
    Template("cc-by-nc-4.0", "This work is licensed under a Creative Commons Attribution-NonCommercial 4.0 International License", ("creative commons attribution noncommercial 4 0",)),
    Template("cc-by-nd-4.0", "Licensed under CC BY-ND 4.0", ("cc by nd 4 0",)),
)

#: Phrases that give a label wherever their words stand consecutively.
BASE = (("cc by", "cc-by"), ("general public license", "gpl"), ("all rights reserved", "reserved"))


@dataclass(frozen=True)
class Scan:
    """templates and base phrases; rare: words of a template that are indexed; share: part of them that must agree on an
    offset, rounded up. A bin of offsets is 4 words wide and one more pair of words for each eight of the template."""

    templates: tuple[Template, ...] = TEMPLATES
    base: tuple[tuple[str, str], ...] = BASE
    rare: int = 16
    share: float = 0.6

    def __post_init__(self) -> None:
        if not (0 < self.rare <= 1000 and 0 < self.share <= 1):
            raise ValueError("rare from 1 to 1000, share above 0 and up to 1")

    @property
    def words(self) -> list[list[str]]:
        return [words_of(t.text) for t in self.templates]

    @property
    def vocabulary(self) -> list[str]:
        return sorted({w for ws in self.words for w in ws})


def words_of(text: str) -> list[str]:
    """The words of a template, on the driver."""
    lower = "".join(chr(ord(c) + 32) if "A" <= c <= "Z" else c for c in text)
    return re.findall(r"[^\x00-\x2F\x3A-\x60\x7B-\x7F]+", lower)


def bin_width(length: int) -> int:
    return 4 + 2 * (length // 8)


def spaced(text: Column) -> Column:
    """The words of a text with a space between; A-Z in lower case, other letters as they are."""
    ascii_ = F.octet_length(text) == F.length(text)
    return F.trim(F.regexp_replace(F.when(ascii_, F.lower(text)).otherwise(lower_ascii(text)), BETWEEN, " "))


def _literal(values: list, kind: str) -> Column:
    """A constant: the optimizer evaluates it once; as one expression it is planned in no time, however long."""
    return F.from_json(F.lit(json.dumps(values)), kind)


def frequencies(docs: DataFrame, words: list[str]) -> dict[str, int]:
    """In how many rows of (text) each of the words stands; the words bound what comes to the driver."""
    own = F.array_intersect(F.split(spaced(F.col("text")), " "), _literal(words, "array<string>"))
    rows = docs.where("text is not null").select(F.explode(own).alias("w")).groupBy("w").agg(F.count("*").alias("n")).collect()
    return {r["w"]: r["n"] for r in rows}


@dataclass(frozen=True)
class Index:
    """postings: word -> (template, number of the word among its indexed ones, position); rare: indexed words by template."""

    postings: dict[str, list[tuple[int, int, int]]]
    rare: list[int]
    need: list[int]


def index_of(scan: Scan, df: dict[str, int]) -> Index:
    """Each template's words of the least document frequency, ties in the order of the words."""
    postings: dict[str, list[tuple[int, int, int]]] = {}
    rare, need = [], []
    for t, ws in enumerate(scan.words):
        chosen = sorted(set(ws), key=lambda w: (df.get(w, 0), w))[: scan.rare]
        for k, w in enumerate(chosen):
            postings.setdefault(w, []).extend((t, k, p) for p, x in enumerate(ws) if x == w)
        rare.append(len(chosen))
        need.append(-int(-len(chosen) * scan.share // 1))
    return Index(postings, rare, need)


#: A vote as one number: template, which of two binnings, bin of the offset, word. The last ten bits are the word.
_T, _HALF, _BIN, _ZERO = 1 << 44, 1 << 43, 1 << 10, 1 << 32


def _votes(words: Column, own: Column, scan: Scan, index: Index) -> Column:
    """array<long>: the distinct votes of a file, in order."""
    names = sorted(index.postings)
    kind = "array<array<struct<t:bigint,k:int,p:int,w:int>>>"
    posts = _literal([[{"t": t, "k": k, "p": p, "w": bin_width(len(scan.words[t]))} for t, k, p in index.postings[n]] for n in names], kind)
    places = _literal(names, "array<string>")

    def of(mine: Column) -> Column:  # the postings of the file's own words, in the order of ``own``
        at = F.filter(F.transform(words, lambda w, i: F.struct(F.array_position(own, w).cast("int").alias("o"), i.alias("i"))), lambda x: x["o"] > 0)
        code = lambda x, p, half: p["t"] * _T + half * _HALF + (F.floor((x["i"] - p["p"] + half * p["w"] / 2) / p["w"]) + _ZERO) * _BIN + p["k"]
        each = F.transform(at, lambda x: F.flatten(F.transform(F.get(mine, x["o"] - 1), lambda p: F.array(code(x, p, F.lit(0)), code(x, p, F.lit(1))))))
        return F.sort_array(F.array_distinct(F.flatten(each).cast("array<long>")))

    return let(F.transform(own, lambda w: F.get(posts, F.array_position(places, w).cast("int") - 1)), of)


def _aligned(votes: Column, scan: Scan, index: Index) -> Column:
    """array<struct<t,n,low>>: where enough words of a template agree: n of them, offsets from ``low`` on."""
    need, width = _literal(index.need, "array<int>"), _literal([bin_width(len(ws)) for ws in scan.words], "array<int>")
    key = lambda c: F.shiftright(c, 10)
    begins = lambda x: F.coalesce(key(F.get(votes, x["j"] - 1)) != key(x["c"]), F.lit(True))
    holds = lambda x: F.coalesce(key(F.get(votes, x["j"] + F.get(need, x["t"]) - 1)) == key(x["c"]), F.lit(False))
    runs = F.filter(F.transform(votes, lambda c, j: F.struct(c.alias("c"), j.alias("j"), F.floor(c / _T).cast("int").alias("t"))), lambda x: begins(x) & holds(x))

    def told(x: Column) -> Column:
        half = F.shiftright(x["c"], 43).bitwiseAND(F.lit(1).cast("long"))
        w = F.get(width, x["t"])
        low = (key(x["c"]).bitwiseAND(F.lit((1 << 33) - 1)) - _ZERO) * w - half * F.floor(w / 2)
        return F.struct(x["t"].alias("t"), F.size(F.filter(F.slice(votes, x["j"] + 1, F.lit(scan.rare)), lambda c: key(c) == key(x["c"]))).alias("n"), low.cast("int").alias("low"))

    return F.transform(runs, told)


def _verified(words: Column, aligned: Column, scan: Scan, index: Index) -> Column:
    """array<struct<label,word,share>>: alignments whose words hold all key phrases of the template."""
    lengths = _literal([len(ws) + bin_width(len(ws)) for ws in scan.words], "array<int>")
    rare, labels = _literal(index.rare, "array<double>"), _literal([t.label for t in scan.templates], "array<string>")
    phrases = _literal([[f" {p} " for p in t.phrases] for t in scan.templates], "array<array<string>>")

    def holds(a: Column) -> Column:
        low = F.greatest(a["low"], F.lit(0))
        there = F.slice(words, low + 1, F.greatest(a["low"] + F.get(lengths, a["t"]) - low, F.lit(0)))
        return let(F.concat(F.lit(" "), F.array_join(there, " "), F.lit(" ")), lambda s: F.forall(F.get(phrases, a["t"]), lambda p: F.contains(s, p)))

    return F.transform(F.filter(aligned, holds), lambda a: F.struct(F.get(labels, a["t"]).alias("label"), F.greatest(a["low"], F.lit(0)).alias("word"), (a["n"] / F.get(rare, a["t"])).alias("share")))


def phrase_pattern(phrase: str) -> str:
    """Matches the first word of a phrase whose other words follow, in spaced words; so matches may overlap."""
    first, *rest = re.escape(phrase).replace("\\ ", " ").split(" ")
    return f"(?<![^ ]){first}(?={''.join(' ' + w for w in rest)}(?![^ ]))"


def _base(spaced_: Column, n_words: Column, scan: Scan) -> Column:
    """array<struct<label,n,first,last>> of the base phrases that the words hold."""
    def of(phrase: str, label: str) -> Column:
        blanks = lambda s: F.length(s) - F.length(F.replace(s, F.lit(" "), F.lit("")))
        told = let(F.split(spaced_, phrase_pattern(phrase), -1), lambda gaps: F.struct(
            F.lit(label).alias("label"), (F.size(gaps) - 1).cast("long").alias("n"), blanks(gaps[0]).cast("long").alias("first"), (n_words - 1 - blanks(F.element_at(gaps, -1))).cast("long").alias("last"),
        ))
        return F.when(F.contains(spaced_, F.lit(phrase)), told)

    return F.filter(F.array(*[of(p, l) for p, l in scan.base]), lambda b: b["n"] > 0)


def scanned(docs: DataFrame, scan: Scan = Scan(), name: str = "licence") -> DataFrame:
    """The rows of ``docs`` with a struct column ``name``: n_words; base (array of label, n, first, last: places where a
    base phrase stands, first and last word); found (array of label, word, share: verified alignments of templates, the
    first word that may belong to it, the share of its indexed words that agree).

    A null or empty text has no words and nothing found. Repeated rows get the same and count each in the frequencies; an
    empty table gives no rows; other columns stay, but for one named like the result, which is an error. Ties of equally
    rare words go by the words."""
    if name in docs.columns:
        raise ValueError(f"the table has a column named {name}")
    index = index_of(scan, frequencies(docs.select("text"), scan.vocabulary))
    steps = docs.select(F.struct("*").alias("_row"), spaced(F.coalesce(F.col("text"), F.lit(""))).alias("s"))
    steps = steps.withColumn("w", F.split("s", " ")).withColumn("n", F.when(F.col("s") == "", 0).otherwise(F.size("w")).cast("long"))
    steps = steps.withColumn("own", F.array_intersect("w", _literal(sorted(index.postings), "array<string>")))
    votes = _votes(F.col("w"), F.col("own"), scan, index)
    found = let(votes, lambda v: let(_aligned(v, scan, index), lambda a: _verified(F.col("w"), a, scan, index)))
    none = F.expr("cast(array() as array<struct<label:string,word:int,share:double>>)")
    # no template can be found with fewer of its words
    found = F.when(F.size("own") >= min(index.need, default=1), found).otherwise(none) if scan.templates else none
    made = F.struct(F.col("n").alias("n_words"), _base(F.col("s"), F.col("n"), scan).alias("base"), found.alias("found"))
    return steps.select("_row", made.alias("_made")).select("_row.*", F.col("_made").alias(name))


def op13_rare_token_licenses(spark: SparkSession, sf_dir: str) -> DataFrame:
    rows = scanned(table(spark, sf_dir, "documents").select("doc_id", "text"))
    base, found = F.col("licence.base"), F.col("licence.found")
    named = lambda *arrays: F.array_join(F.sort_array(F.array_distinct(F.concat(*[F.transform(a, lambda x: x["label"]) for a in arrays]))), ",")
    return rows.select(
        F.col("doc_id").cast("long").alias("doc_id"), F.col("licence.n_words").alias("n_words"), F.aggregate(base, F.lit(0).cast("long"), lambda a, b: a + b["n"]).alias("n_base"),
        F.array_min(F.transform(base, lambda b: b["first"])).alias("first_word"), F.array_max(F.transform(base, lambda b: b["last"])).alias("last_word"),
        named(base).alias("base_labels"), named(base, found).alias("labels"), F.round(F.coalesce(F.array_max(F.transform(found, lambda f: f["share"])), F.lit(0.0)), 6).alias("score"),
    )


def _sql(scan: Scan) -> str:
    """The same as joins of exploded words."""
    q = lambda s: "'" + s.replace("'", "''") + "'"
    templates = ", ".join(
        f"({t}, {q(x.label)}, {len(ws)}, {bin_width(len(ws))}, [{', '.join(map(q, ws))}], [{', '.join(q(f' {p} ') for p in x.phrases)}])" for t, (x, ws) in enumerate(zip(scan.templates, scan.words, strict=True))
    )
    base = ", ".join(f"([{', '.join(map(q, p.split(' ')))}], {q(l)})" for p, l in scan.base)
    return rf"""
WITH d AS MATERIALIZED (SELECT row_number() OVER () AS rid, doc_id, regexp_extract_all(translate(coalesce(text, ''), 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz'), '[^\x00-\x2F\x3A-\x60\x7B-\x7F]+') AS w FROM documents),
x AS MATERIALIZED (SELECT rid, unnest(w) AS word, generate_subscripts(w, 1) - 1 AS i FROM d),
t(t, label, len, width, ws, phrases) AS (VALUES {templates}),
p AS (SELECT t, unnest(ws) AS word, generate_subscripts(ws, 1) - 1 AS pos FROM t),
f AS (SELECT word, count(DISTINCT rid) AS df FROM x WHERE word IN (SELECT word FROM p) GROUP BY word),
r AS (SELECT t, word, row_number() OVER (PARTITION BY t ORDER BY coalesce(df, 0), word) AS k FROM (SELECT DISTINCT t, word FROM p) LEFT JOIN f USING (word) QUALIFY k <= {scan.rare}),
n AS (SELECT t, count(*) AS rare FROM r GROUP BY t),
v AS (SELECT x.rid, t.t, h.half, floor((x.i - p.pos + h.half * t.width / 2) / t.width)::BIGINT AS bin, x.word FROM x JOIN p USING (word) JOIN r ON r.t = p.t AND r.word = p.word JOIN t ON t.t = p.t, (VALUES (0), (1)) AS h(half)),
a AS (SELECT rid, v.t, half, bin, count(DISTINCT word) AS agree FROM v JOIN n USING (t) GROUP BY rid, v.t, half, bin, rare HAVING count(DISTINCT word) >= ceil(rare * {scan.share})),
l AS (SELECT a.*, t.label, t.phrases, n.rare, bin * width - half * (width // 2) AS low, len + width AS span FROM a JOIN t USING (t) JOIN n USING (t)),
s AS (SELECT l.*, ' ' || array_to_string(d.w[greatest(low, 0) + 1:low + span], ' ') || ' ' AS seg FROM l JOIN d USING (rid)),
g AS (SELECT rid, label, agree / rare AS share FROM s WHERE len(list_filter(phrases, lambda y: NOT contains(seg, y))) = 0),
b(ws, label) AS (VALUES {base}),
o AS (SELECT x.rid, x.i, b.label FROM x JOIN b ON x.word = b.ws[1] JOIN d USING (rid) WHERE d.w[x.i + 1:x.i + len(b.ws)] = b.ws),
ob AS (SELECT rid, count(*) AS n, min(i) AS lo, max(i) AS hi, string_agg(DISTINCT label, ',' ORDER BY label) AS labels FROM o GROUP BY rid),
al AS (SELECT rid, string_agg(DISTINCT label, ',' ORDER BY label) AS labels FROM (SELECT rid, label FROM o UNION ALL SELECT rid, label FROM g) GROUP BY rid),
sc AS (SELECT rid, max(share) AS share FROM g GROUP BY rid)
SELECT doc_id, len(w)::BIGINT AS n_words, coalesce(ob.n, 0)::BIGINT AS n_base, lo::BIGINT AS first_word, hi::BIGINT AS last_word, coalesce(ob.labels, '') AS base_labels, coalesce(al.labels, '') AS labels,
  round(coalesce(share, 0)::DOUBLE, 6) AS score
FROM d LEFT JOIN ob USING (rid) LEFT JOIN al USING (rid) LEFT JOIN sc USING (rid)
"""


SQL = _sql(Scan())
