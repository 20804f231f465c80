"""Record linkage: blocks, patterns and links against all pairs."""

import random
from collections import Counter
from dataclasses import replace

from sieveline.operators import linkage

SPEC = linkage.Linkage(
    fields={"name": ("l.name = r.name", "levenshtein(l.name, r.name) <= 1"), "town": ("l.town = r.town",), "born": ("l.born = r.born", "abs(l.born - r.born) <= 1")},
    rules=(("name",), ("town", "born")), most=16,
)
SCHEMA = "id long, name string, town string, born int"


def people(n, seed, towns=40):
    rng = random.Random(seed)
    return [(i, "".join(rng.choice("abcdefgh") for _ in range(7)), f"t{rng.randrange(towns)}", rng.randrange(1900, 2000)) for i in range(n)]


def entered_again(rows, seed):
    """Each record once more with an id of its own, a field of every second one wrong or missing."""
    rng, out = random.Random(seed), []
    for i, name, town, born in rows:
        kind = rng.randrange(8)
        if kind == 0:
            name = name[:-1]
        if kind == 1:
            town = None
        if kind == 2:
            born += 1
        if kind == 3:
            name = name[:3] + "x" + name[4:]
        out.append((10_000 + i, name, town, born))
    return out


def level(a, b):
    def edit(x, y):
        row = list(range(len(y) + 1))
        for i, c in enumerate(x, 1):
            row, above = [i], row
            for j, d in enumerate(y, 1):
                row.append(min(row[-1] + 1, above[j] + 1, above[j - 1] + (c != d)))
        return row[-1]

    name = 0 if a[1] == b[1] else 1 if edit(a[1], b[1]) <= 1 else 2
    town = -1 if None in (a[2], b[2]) else int(a[2] != b[2])
    return f"{name},{town},{min(abs(a[3] - b[3]), 2)}"


def test_pairs_of_blocks_have_their_pattern_once(spark):
    a = people(200, 1, towns=5)
    b = entered_again(a, 2)
    got = linkage.patterns(spark.createDataFrame(a, SCHEMA), spark.createDataFrame(b, SCHEMA), "id", "id", SPEC).collect()
    left, right = {r[0]: r for r in a}, {r[0]: r for r in b}
    assert len({(r["l_id"], r["r_id"]) for r in got}) == len(got)
    assert all(r["pattern"] == level(left[r["l_id"]], right[r["r_id"]]) for r in got)
    # towns hold 80 records, more than a block: they are divided by year
    names = {(x[0], y[0]) for x in a for y in b if x[1] == y[1]}
    years = {(x[0], y[0]) for x in a for y in b if x[2] == y[2] is not None and x[3] == y[3]}
    assert {(r["l_id"], r["r_id"]) for r in got} == names | years


def test_links_against_all_pairs(spark):
    a = people(1500, 3)
    b = entered_again(a, 4) + [(50_000 + r[0], *r[1:]) for r in people(500, 5)]
    got = linkage.linked(spark.createDataFrame(a, SCHEMA), spark.createDataFrame(b, SCHEMA), "id", "id", SPEC).collect()
    assert len(got) == 1500 and not any(r["conflict"] for r in got if r["rating"] == "none")
    found = {r["id"]: r["link_id"] for r in got if r["rating"] == "match"}
    right = sum(v == 10_000 + k for k, v in found.items())
    assert right >= 0.9 * 1500 and right >= 0.99 * len(found), (right, len(found))


def test_a_common_key_makes_no_large_block(spark):
    """A third of all rows hold one town and year, many of them are equal: blocks stay bounded and equal rows share a verdict."""
    a = people(600, 6) + [(1000 + i, f"same{i % 150:03}", "hub", 1950) for i in range(300)]
    b = [(10_000 + r[0], *r[1:]) for r in a]
    la, lb = spark.createDataFrame(a, SCHEMA), spark.createDataFrame(b, SCHEMA)
    rows = linkage.blocked(la.dropDuplicates(["name", "town", "born"]).withColumnRenamed("id", "_id"), SPEC)
    assert max(r["count"] for r in rows.groupBy("_block").count().collect()) <= SPEC.most
    got = {r["id"]: r for r in linkage.linked(la, lb, "id", "id", SPEC).collect()}
    assert len(got) == 900
    for i in range(300):
        r = got[1000 + i]
        assert (r["link_id"], r["rating"], r["conflict"]) == (11_000 + i % 150, "match", True), "two equal right rows"


def test_edges(spark):
    a = spark.createDataFrame([(1, None, None, None), (2, "ann", "x", 1), (2, "ann", "x", 1)], SCHEMA)
    none = spark.createDataFrame([], SCHEMA)
    got = Counter((r["id"], r["link_id"], r["rating"], r["conflict"]) for r in linkage.linked(a, none, "id", "id", SPEC).collect())
    assert got == {(1, None, "none", False): 1, (2, None, "none", False): 2}
    assert linkage.linked(none, a, "id", "id", SPEC).count() == 0


def test_fit_recovers_what_made_the_patterns():
    rng, spec = random.Random(7), replace(SPEC, fields=SPEC.fields | {"trade": ("l.trade = r.trade",)})
    match, chance = [(0.9, 0.08, 0.02), (0.95, 0.05), (0.9, 0.08, 0.02), (0.85, 0.15)], [(0.001, 0.01, 0.989), (0.1, 0.9), (0.01, 0.02, 0.97), (0.2, 0.8)]
    draw = lambda p: rng.choices(range(len(p)), p)[0]
    drawn = Counter(",".join(str(draw(p)) for p in chance) for _ in range(50_000))
    counts = Counter()
    for rule, fields in ((1, (0,)), (2, (1, 2))):  # a rule's pairs agree in its fields
        for _ in range(30_000):
            of = match if rng.random() < 0.4 else chance
            counts[",".join("0" if f in fields else str(draw(p)) for f, p in enumerate(of)), rule] += 1
    model = linkage.fit(counts, drawn, 10**9, spec)
    assert abs(model.share - 12e-6) < 0.5e-6
    assert all(abs(x - y) < 0.03 for got, want in ((model.match, match), (model.chance, chance)) for p, q in zip(got, want, strict=True) for x, y in zip(p, q, strict=True))


def test_second_entries_of_customers(spark):
    from sieveline.plans import queries

    got = queries.customer_links(spark, "/root/testdata/sf0.001").collect()
    sure = [r["link_id"] == r["id"] for r in got if r["rating"] == "match"]
    # a name with a digit lost and no balance fits several customers: such links are for review
    assert sum(sure) >= 0.99 * len(sure) and sum(r["link_id"] == r["id"] for r in got) >= 0.9 * len(got)
