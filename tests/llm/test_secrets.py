import hashlib
import math
import random
import re

import pytest
from pyspark.sql import functions as F

from sieveline.llm import secrets

from . import edge

BASE = (
    re.compile(r"""(password|passwd|secret|token|api_?key)["']?\x20*[:=]\x20*["']?([A-Za-z0-9+/_.=-]+)""", re.IGNORECASE | re.ASCII),
    re.compile(r"AKIA[A-Z0-9]+"), re.compile(r"[0-9a-f]+"),
)
LEAST = (lambda m: len(m.group(2)) >= 8, lambda m: len(m.group()) >= 16, lambda m: len(m.group()) >= 32)


def brute(text):
    found = [(m.start(), k, m.end()) for k, p in enumerate(BASE) for m in p.finditer(text or "") if LEAST[k](m)]
    return sorted(found)


def texts():
    rng = random.Random(9)
    hexed = lambda n: "".join(rng.choice("0123456789abcdef") for _ in range(n))
    key = lambda n: "".join(rng.choice("ABCDEFGHIJKLMNOPQRSTUVWXYZabcdefghijklmnopqrstuvwxyz0123456789+/") for _ in range(n))
    words = "unquestionably incomprehensible straightforwardness telecommunication misunderstanding disproportionately"
    out = [f"é {words} tOkEn = \"{hexed(40)}\" {words}", f"api_key:'short' apikey= {key(12)} secret = token: {key(20)}", f"AKIA{'A1' * 8} AKIAX", f"{hexed(31)} {hexed(32)} {hexed(64)}z", words * 3]
    out += [f"{words} see {key(40)} there" for _ in range(30)] + [f"{words} {rng.choice(words.split())}" for _ in range(300)]
    return out


def test_base_and_random_spans(spark):
    data = texts()
    df = spark.createDataFrame(list(enumerate(data)), "doc_id long, text string")
    kinds = {k: i for i, k in enumerate(secrets.KINDS)}
    hits = 0
    for r in secrets.scan(df).collect():
        text = data[r["doc_id"]]
        base = [(x["s"], x["k"], x["e"]) for x in r["found"]["base"]]
        every = [(x["s"], x["k"], x["e"]) for x in r["found"]["all"]]
        assert base == brute(text) and set(base) <= set(every) and every == sorted(every)
        extra = [text[s:e] for s, k, e in every if k == kinds["random"]]
        assert all(len(x) in (40, 20, 31, 12) or not x.isalpha() for x in extra)
        hits += 5 <= r["doc_id"] < 35 and any(len(x) == 40 for x in extra)
        assert r["doc_id"] < 35 or not extra
    assert hits >= 27


def test_edge_cases(spark):
    docs = edge.docs(spark).drop("found")
    got = {r["doc_id"]: r for r in secrets.scan(docs).collect()}
    for row in edge.rows():
        assert [(x["s"], x["k"], x["e"]) for x in got[row[0]]["found"]["base"]] == brute(row[1])
    assert secrets.scan(edge.empty(spark).drop("found")).count() == 0
    with pytest.raises(ValueError):
        secrets.scan(edge.docs(spark))


def test_digest_columns(spark, tmp_path):
    data = texts()[:5]
    spark.createDataFrame(list(enumerate(data)), "doc_id long, text string").write.parquet(str(tmp_path / "documents.parquet"))
    for r in secrets.op8_secret_battery(spark, str(tmp_path)).collect():
        base = brute(data[r["doc_id"]])
        assert [r["n_assign"], r["n_access"], r["n_hex"]] == [sum(k == n for _, k, _ in base) for n in range(3)]
        assert r["base_sha256"] == hashlib.sha256(",".join(f"{secrets.KINDS[k]}:{s}:{e}" for s, k, e in base).encode()).hexdigest()


def test_tail_and_statistics(spark):
    z = [-12.0, -5.0, -2.0, -0.5, 0.0, 1.0, 3.0]
    got = [r["t"] for r in spark.createDataFrame([(x,) for x in z], "z double").select(secrets._tail(F.col("z")).alias("t")).collect()]
    for x, t in zip(z, got, strict=True):
        assert abs(math.log10(t) - math.log10(0.5 * math.erfc(-x / math.sqrt(2)))) < 0.15
    s = spark.createDataFrame([("aAbb11+a",)], "t string").select(secrets.statistics(F.col("t")).alias("s")).first()["s"]
    assert (s["n"], s["pairs"], s["changes"], s["enc"]) == (8, 3.0, 5.0, 3)


def test_added_spans_are_those_of_the_tests(spark):
    """The whole method again, token by token: rates of words by encoding, p-values, step-up rule, uniformity, overlaps."""
    data = texts() + [f"see {'deadbeefcafebabe' * 2}zz and some-long-slug-of-words-and-more-words here"]
    battery = secrets.Battery()
    token = re.compile(secrets.TOKEN)
    stats = []
    for t in (m.group() for text in data for m in token.finditer(text)):
        n = len(t)
        enc = 0 if re.fullmatch("[0-9a-f]+|[0-9A-F]+", t) else 1 if re.fullmatch("[A-Z2-7]+=*", t) else 2 if re.fullmatch("[0-9a-z]+|[0-9A-Z]+", t) else 3
        pairs = sum(t.count(c) * (t.count(c) - 1) / 2 for c in set(t))
        kind = lambda c: "a" if "a" <= c <= "z" else "b" if "A" <= c <= "Z" else "c" if "0" <= c <= "9" else None
        changes = sum(kind(a) is None or kind(a) != kind(b) for a, b in zip(t, t[1:], strict=False))
        codes = [ord(c) for c in t]
        mean = sum(codes) / n
        var = sum(c * c for c in codes) - mean * mean * n
        serial = sum((a - mean) * (b - mean) for a, b in zip(codes, codes[1:], strict=False)) / var if var > 0 else 0.0
        stats.append((t, n, enc, pairs, float(changes), serial, bool(re.fullmatch("[A-Za-z][a-z]+", t))))

    def rates(own):
        pn, cn = sum(s[1] * (s[1] - 1) / 2 for s in own), sum(s[1] - 1 for s in own)
        return max(sum(s[3] for s in own) / pn, 0.01), min(max(sum(s[4] for s in own) / cn, battery.least_transitions), 0.5), sum(s[5] for s in own) / len(own)

    words = [s for s in stats if s[6]]
    null = [rates(own if len(own := [s for s in words if s[2] == e]) >= battery.least_words else words) for e in range(4)]

    def tail(z):
        low = lambda t: math.exp(-t * t / 2) / (2.506628274631 * t + 2)
        return max(low(-z) if z < 0 else 1 - low(z), 1e-300)

    def evidence(s):
        _, n, e, pairs, changes, serial, _ = s
        (k, t, r), size = null[e], secrets.ALPHABETS[e]
        chi = size * (2 * pairs + n) / n - n
        sd = 2 * size / n * math.sqrt(n * (n - 1) / 2 * k * (1 + 2 * n * k))
        ps = [tail((chi + size / n - (size * (1 + (n - 1) * k) - n)) / sd), tail(-(changes - 0.5 - (n - 1) * t) / math.sqrt((n - 1) * t * (1 - t))), tail(-(serial - r) * (-1 if r > 0 else 1) * math.sqrt(n))]
        y = -sum(map(math.log, ps))
        return min(math.floor((y - math.log(1 + y + y * y / 2)) * 4.342944819), 3000)

    def uniform(s):
        df = secrets.ALPHABETS[s[2]] - 1
        chi, c = secrets.ALPHABETS[s[2]] * (2 * s[3] + s[1]) / s[1] - s[1], 2 / (9 * df)
        return math.copysign(abs(chi / df) ** (1 / 3), chi) <= 1 - c + battery.uniform * math.sqrt(c)

    letters = [s for s in stats if re.search("[A-Za-z]", s[0])]
    family = lambda s: (s[2], s[1].bit_length())
    limits = {}
    for f in {family(s) for s in letters}:
        bins = sorted((evidence(s) for s in letters if family(s) == f), reverse=True)
        passed = [b for b in bins if 10 ** (-b / 10) <= battery.q * sum(x >= b for x in bins) / len(bins)]
        if passed:
            limits[f] = max(min(passed), battery.least_evidence)
    by_token = {s[0]: s for s in stats}
    df = spark.createDataFrame(list(enumerate(data)), "doc_id long, text string")
    extra = 0
    for r in secrets.scan(df).collect():
        base = brute(data[r["doc_id"]])
        want = []
        for m in token.finditer(data[r["doc_id"]]):
            s = by_token[m.group()]
            if any(a < m.end() and m.start() < b for a, _, b in base) or not re.search("[A-Za-z]", s[0]) or family(s) not in limits:
                continue
            if evidence(s) >= limits[family(s)] and uniform(s):
                want.append((m.start(), 3, m.end()))
        got = [(x["s"], x["k"], x["e"]) for x in r["found"]["all"] if x["k"] == 3]
        assert got == want, data[r["doc_id"]]
        extra += len(want)
    assert extra >= 27


def test_very_long_text(spark):
    import time

    text = " ".join(f"{k:07d}abcdefgh{k}" for k in range(64_000))
    df = spark.createDataFrame([(1, text + " token: Zx81Zx81Zx81")], "doc_id long, text string")
    start = time.perf_counter()
    found = secrets.scan(df).first()["found"]
    assert [(x["s"], x["k"]) for x in found["base"] if x["k"] == 0] == [(len(text) + 1, 0)] and time.perf_counter() - start < 60


def test_many_base_spans_in_one_text(spark):
    """64,000 hexadecimal strings, a base span each, and other tokens between them: both lists are merged."""
    import time

    body = " ".join(f"{k:032x}" if k % 2 else f"Zk{k:07d}qXv{k % 977:03d}Lw" for k in range(128_000))
    df = spark.createDataFrame([(1, body), (2, "deadbeef" * 5)], "doc_id long, text string")
    start = time.perf_counter()
    got = {r["doc_id"]: r["found"] for r in secrets.scan(df).collect()}
    assert len(got[1]["base"]) == 64_000 and all(x["k"] == 2 for x in got[1]["base"]) and len(got[2]["all"]) == 1
    assert time.perf_counter() - start < 60
    spans = sorted((x["s"], x["e"]) for x in got[1]["all"])
    assert all(a[1] <= b[0] for a, b in zip(spans, spans[1:], strict=False)), "added spans overlap no base span"
