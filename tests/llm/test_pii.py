import hashlib
import random
import re

import numpy as np
from hypothesis import example, given, settings
from hypothesis import strategies as st

from sieveline.llm import pii

from . import edge

BASE = (
    re.compile(r"[A-Za-z0-9._%+-]+@[A-Za-z0-9-]+(\.[A-Za-z0-9-]+)+"), re.compile(r"[0-9]+(\.[0-9]+)(\.[0-9]+)(\.[0-9]+)"),
    re.compile(r"[0-9]([\x20-]?[0-9])+"), re.compile(r"\+[0-9][\x20().0-9-]+[0-9]"),
)


def luhn(d):
    return sum(int(c) if k % 2 == 0 else sum(divmod(2 * int(c), 10)) for k, c in enumerate(reversed(d))) % 10 == 0


def brute(text):
    digits = lambda s: re.sub(r"[^0-9]", "", s)
    tests = (
        lambda s: True, lambda s: all(int(p) <= 255 for p in s.split(".")),
        lambda s: 16 <= len(digits(s)) <= 19 and luhn(digits(s)), lambda s: 8 <= len(digits(s)) <= 15,
    )
    return [[m.span() for m in p.finditer(text) if ok(m.group())] for p, ok in zip(BASE, tests, strict=True)]


@settings(max_examples=500, deadline=None)
@given(st.text(alphabet="ab@.-%1234567890 +()é\n", max_size=80))
@example("a@b.c@d.e x@y a@b.c%d@e.f @a.b")
@example("1.2.3.4.5.6.7.8 256.1.1.1 0001.02.3.255 1.2.3")
@example("4111 1111-1111 1111 41111111111111111 4111  1111")
@example("+1 (212) 555-0187+44 20 7946 0958")
def test_base_spans(text):
    assert pii.base_spans(text) == brute(text)


def test_linear_on_long_runs():
    for text in ("a" * 300_000, "a." * 150_000, "1" * 300_000, "+1" * 100_000, "a@" * 100_000, "1." * 100_000):
        pii.base_spans(text)


def test_expectation_maximisation_finds_reliable_labelers():
    rng = np.random.default_rng(1)
    truth = rng.random(4000) < 0.4
    right = np.array([0.95, 0.9, 0.8, 0.55])
    votes = np.where(rng.random((4000, 4)) < right, np.where(truth, 1, -1)[:, None], np.where(truth, -1, 1)[:, None])
    p, told = pii.expectation_maximisation(votes, np.ones(4000))
    assert ((p > 0.5) == truth).mean() > 0.95
    learned = [(told[k, 0, 0] + told[k, 1, 2]) / 2 for k in range(4)]
    assert np.abs(np.array(learned) - right).max() < 0.06


def corpus(spark):
    rows = []
    for i in range(200):
        rows.append((i, f"please call +1 (212) 555-0{100 + i} or phone (212) 555-0{300 + i} soon, contact name{i}@mail.example.com"))
        rows.append((1000 + i, f"part 1234-{1000 + i}-{5000 + i}-77 x{i} 11 22 33 44 55 serial 000-000-0000"))
    return rows, spark.createDataFrame(rows, "doc_id long, text string")


def test_method_adds_and_keeps_base(spark):
    rows, df = corpus(spark)
    got = {r["doc_id"]: r for r in pii.detect(df).collect()}
    added = 0
    for i, text in rows:
        base = [f"{pii.KINDS[k]}:{s}:{e}" for k, spans in enumerate(brute(text)) for s, e in spans]
        assert got[i]["base_sha256"] == hashlib.sha256(",".join(base).encode()).hexdigest()
        spans = got[i]["spans"].split(",") if got[i]["spans"] else []
        assert set(base) <= set(spans) and spans == sorted(spans, key=lambda x: (pii.KINDS.index(x.split(":")[0]), int(x.split(":")[1])))
        added += i < 1000 and len(spans) > len(base)
    assert added > 150


def test_edge_cases_and_masks(spark):
    docs = edge.docs(spark)
    got = pii.detect(docs).collect()
    assert len(got) == len(edge.rows())
    by = {r["doc_id"]: r for r in got}
    assert (by[8]["n_email"], by[8]["n_phone"], by[10]["n_ip"], by[4]["n_card"]) == (1, 1, 1, 1)
    assert by[1]["spans"] == "" and pii.detect(edge.empty(spark)).count() == 0
    out = pii.masked(docs)
    assert out.columns == docs.columns
    texts = {r["doc_id"]: r for r in out.collect()}
    assert texts[8]["text"] == "mail me at <email> or call <phone> now" and texts[8]["n_chars"] == len(texts[8]["text"]) and texts[1]["text"] is None
    assert pii.masked_text("abcdef", [(0, 1, 3), (1, 2, 5)]) == "a<email>f"


def test_added_spans_overlap_nothing():
    """Against a comparison with every base span; also where many base spans lie before a candidate."""
    rng = random.Random(6)
    parts = ["1.2.3.4", "a@b.example", "4111 1111 1111 1111", "+1 212 555 0187", "212-555-0187", "(030) 123 4567", "1.2.3.4-1.2.3.4", "@a-212.555-123-4567.com", "x [at] y [dot] org", "2001:db8::1", "-", " ", "call "]
    texts = ["call " + "1.2.3.4-" * 7 + "1.2.3.4@a-212.555-123-4567.com"] + ["".join(rng.choice(parts) for _ in range(rng.randrange(1, 30))) for _ in range(400)]
    found = 0
    for text in texts:
        base = pii.base_spans(text)
        flat = [x for spans in base for x in spans]
        wide = sorted(((k, m.start(), m.end()) for k, p in pii._WIDE for m in p.finditer(text) if k != 1 or pii._is_ipv6(m.group())), key=lambda x: (x[1], -x[2], x[0]))
        if "(at" not in text and "[at" not in text and "AT" not in text:
            wide = [w for w in wide if w[0]]
        want, end = [], 0
        for k, s, e in wide:
            if s >= end and not any(a < e and s < b for a, b in flat):
                want.append((k, s, e))
                end = e
        assert pii.candidates(text, base) == want, text
        found += len(want)
    assert found > 300


def test_compressed_ipv6():
    for address, is_one in (("2001:db8::1", True), ("fe80::1", True), ("::1", True), ("2001:0db8:85a3:0000:0000:8a2e:0370:7334", True), ("1:2:3", False), ("12:30:45", False), ("a::b::c", False)):
        text = f"host {address} answers"
        assert [(1, 5, 5 + len(address))] * is_one == [c for c in pii.candidates(text, pii.base_spans(text)) if c[0] == 1], address
