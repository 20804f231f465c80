import re
from collections import Counter

import pytest

from sieveline.llm import licenses
from sieveline.llm.licenses import Scan, Template

from . import edge

WORD = re.compile(r"[^\x00-\x2F\x3A-\x60\x7B-\x7F]+")


def words(text):
    return WORD.findall("".join(c.lower() if c.isascii() else c for c in text or ""))


def brute(texts, scan):
    """(n_words, base, found) of each text, by plain loops."""
    df = Counter(w for t in texts for w in set(words(t)))
    out = []
    for text in texts:
        ws = words(text)
        base = []
        for phrase, label in scan.base:
            p = phrase.split(" ")
            at = [i for i in range(len(ws)) if ws[i : i + len(p)] == p]
            if at:
                base.append((label, len(at), at[0], at[-1]))
        found = set()
        for t in scan.templates:
            tw = licenses.words_of(t.text)
            rare = sorted(set(tw), key=lambda w: (df[w], w))[: scan.rare]
            width = licenses.bin_width(len(tw))
            agree = {}
            for w in rare:
                for i in (i for i, x in enumerate(ws) if x == w):
                    for p in (p for p, x in enumerate(tw) if x == w):
                        for half in (0, width // 2):
                            agree.setdefault((half, (i - p + half) // width), set()).add(w)
            for (half, b), who in agree.items():
                low = b * width - half
                there = " " + " ".join(ws[max(low, 0) : max(low + len(tw) + width, 0)]) + " "
                if len(who) >= scan.share * len(rare) and all(f" {p} " in there for p in t.phrases):
                    found.add((t.label, max(low, 0), len(who) / len(rare)))
        out.append((len(ws), base, sorted(found)))
    return out


def asked(spark, texts, scan):
    rows = [(i, t, "en", "a", 0, 0, 0, "x", 0, "y") for i, t in enumerate(texts)]
    df = licenses.scanned(edge.docs(spark, rows), scan)
    assert df.columns == [*edge.docs(spark).columns, "licence"]
    got = {r["doc_id"]: r["licence"] for r in df.collect()}
    shape = lambda x: (x["n_words"], [tuple(b) for b in x["base"]], sorted({(f["label"], f["word"], f["share"]) for f in x["found"]}))
    return [shape(got[i]) for i in range(len(texts))]


FILLER = "lorem ipsum dolor sit amet the software of this license is under version and copy use " * 6
MIT = next(t for t in licenses.TEMPLATES if t.label == "mit").text


def corpus():
    notices = [t.text for t in licenses.TEMPLATES]
    odd = MIT.replace("free of charge", "at no charge whatsoever").replace(" to deal", " at all to deal").upper()
    return [
        *notices, *[FILLER + n + " " + FILLER for n in notices], FILLER, odd, "x " * 3 + odd, MIT.replace("merge", "join"), " ".join(reversed(MIT.split())), MIT + " " + notices[0] + " " + MIT,
        "Licensed under CC BY-NC 4.0.", "This work is licensed under the GNU General Public License, version 3.", "All rights reserved.", "Licensed under the Apache License, Version 2.0.",
        "cc by cc by-sa CC-BY cc", "general public license general public license", "all all rights reserved reserved", "ccby cc bye all-rights-reserved", "KK İcc by", "écc by cc byé",
        None, "", " \n.,-", "licensed under the licensed under the licensed under the mit mit license " * 40, *[r[1] for r in edge.rows()],
    ]


@pytest.mark.parametrize("scan", [
    Scan(), Scan(rare=6, share=1.0), Scan(rare=40, share=0.3), Scan(templates=()),
    Scan(templates=(Template("a", "one two three two one", ("two three",)), Template("b", "one", ("one",))), base=(("one two one", "x"), ("a+b", "y")), rare=3, share=0.5),
])
def test_against_brute_force(spark, scan):
    texts = [*corpus(), "one two one two one", "one two three two one two three two one", "three two one"]
    want = brute(texts, scan)
    for text, g, w in zip(texts, asked(spark, texts, scan), want, strict=True):
        assert g == w, text


def test_notices_are_found_and_plain_texts_left_alone(spark):
    got = asked(spark, corpus(), Scan())
    n = len(licenses.TEMPLATES)
    for k, t in enumerate(licenses.TEMPLATES):
        assert t.label in {f[0] for f in got[k][2]} and t.label in {f[0] for f in got[n + k][2]}, t.label
    assert not got[2 * n][2] and {f[0] for f in got[2 * n + 1][2]} == {"mit"} and not got[2 * n + 4][2], "filler; edited in four places; reversed"


def test_empty_and_clash(spark):
    assert licenses.scanned(edge.empty(spark)).count() == 0
    with pytest.raises(ValueError):
        licenses.scanned(edge.docs(spark), name="found")


def test_long_text_of_notices(spark):
    """Many alignments in one text: work grows with the text."""
    text = "licensed under the apache license version 2 0 and more of this sort " * 4000
    (n, base, found), = asked(spark, [text], Scan())
    assert n == 13 * 4000 and not base and len(found) == len({f[1] for f in found}) >= 4000 and {f[0] for f in found} == {"apache-2.0"}


def test_nothing_but_frequencies_is_shuffled(spark, capsys):
    licenses.scanned(edge.docs(spark)).explain()
    plan = capsys.readouterr().out
    assert "Exchange" not in plan and "Python" not in plan
