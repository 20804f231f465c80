import hashlib

from sieveline.llm import warc

SCHEMA = "page_id long, url string, html string, record_type string"


def pages(spark):
    big, other = "<p>" + "x" * 2000, "é" * 600 + "\r\n\r\nWARC/1.1\r\nWARC-Type: response\r\n\r\n"
    rows = [(i, f"http://a.example/{i}", big) for i in range(10)] + [(20, None, None), (21, "u", ""), (22, "u", "small"), (23, "u\r\nX: y", "small"), (24, "u", other), (25, "u", other), (None, "u", "no id" * 300)]
    return [(*r, "clash") for r in rows], spark.createDataFrame([(*r, "clash") for r in rows], SCHEMA)


def test_round_trip(spark, tmp_path):
    rows, df = pages(spark)
    path = str(tmp_path / "warc")
    warc.write(df, path, records=3)
    got = {r["page_id"]: r for r in warc.read(spark, path).collect()}
    assert len(got) == len(rows)
    last: dict = {}
    for i, _, html, _ in rows:
        data = (html or "").encode()
        if len(data) >= 1000 and i is not None:
            last[data] = max(last.get(data, i), i)
    for i, _, html, _ in rows:
        data, r = (html or "").encode(), got[i]
        revisit = data in last and last[data] != i and i is not None
        assert (r["payload_bytes"], r["payload_digest"]) == (len(data), hashlib.sha1(data).hexdigest())
        assert (r["record_type"], r["refers_to"]) == (("revisit", last[data]) if revisit else ("response", None))
        assert r["html"] == (None if revisit else (html or ""))


def test_repeated_rows_and_empty(spark, tmp_path):
    same = spark.createDataFrame([(1, "u", "y" * 1500, "c")] * 3, SCHEMA)
    warc.write(same, str(tmp_path / "a"))
    assert [r["record_type"] for r in warc.read(spark, str(tmp_path / "a")).collect()] == ["response"] * 3
    warc.write(spark.createDataFrame([], SCHEMA), str(tmp_path / "b"))
    assert warc.read(spark, str(tmp_path / "b")).count() == 0


def test_files_are_bounded_by_bytes(spark, tmp_path, monkeypatch):
    """Large payloads lie few to a file, whatever the number of records that small ones have."""
    monkeypatch.setattr(warc, "FILE_BYTES", 64_000)
    rows = [(i, "u", f"{i}" + "s" * 100, "c") for i in range(300)] + [(1000 + i, "u", f"{i}" + "b" * 20_000, "c") for i in range(12)] + [(2000, "u", "h" * 200_000, "c")]
    path = str(tmp_path / "w")
    warc.write(spark.createDataFrame(rows, SCHEMA).coalesce(1), path, records=100)
    sizes = [p.stat().st_size for p in (tmp_path / "w").glob("part-*")]
    assert sum(s > 150_000 for s in sizes) == 1 and all(s <= 150_000 for s in sorted(sizes)[:-1])
    got = {r["page_id"]: r["html"] for r in warc.read(spark, path).collect()}
    assert got == {r[0]: r[2] for r in rows}


def test_verdicts_beyond_the_broadcast(spark, tmp_path, monkeypatch):
    rows, df = pages(spark)
    key = lambda r: (str(r["page_id"]), r["record_type"], r["refers_to"])
    few = sorted(map(key, warc.resolve(df).collect()))
    monkeypatch.setattr(warc, "VERDICTS", 0)
    assert sorted(map(key, warc.resolve(df).collect())) == few


def test_record_ids(spark, tmp_path):
    big = "z" * 1500
    rows = [(1, "u", big, "c"), (2, "u", big, "c"), (3, "u", big, "c"), (None, "u", big, "c"), (None, "u", "x", "c"), (None, "u", "x", "c"), (4, "u", "x", "c")]
    warc.write(spark.createDataFrame(rows, SCHEMA), str(tmp_path / "w"))
    records = [h for p in sorted((tmp_path / "w").glob("part-*")) for h, _ in warc.parse(p.read_bytes())]
    ids = [h["WARC-Record-ID"] for h in records]
    assert len(set(ids)) == len(rows) and all(len(x) == len("<urn:uuid:>") + 36 for x in ids)
    original = next(h for h in records if h.get("X-Page-ID") == "3")
    revisits = [h for h in records if h["WARC-Type"] == "revisit"]
    assert len(revisits) == 3 and {h["WARC-Refers-To"] for h in revisits} == {original["WARC-Record-ID"]}
