import hashlib
import re

import pytest

from sieveline.llm import infill

from . import edge


def brute(doc_id, text, to, unit):
    text = text or ""
    u = re.findall(unit, text)
    assert "".join(u) == text
    h = hashlib.sha256(f"{to.seed}:{'' if doc_id is None else doc_id}".encode()).hexdigest()
    h1, h2, h3, h4 = (int(h[8 * k : 8 * k + 8], 16) for k in range(4))
    a, b = sorted((h1 % (len(u) + 1), h2 % (len(u) + 1)))
    if not text or any(m in text for m in to.markers) or h3 % 100 >= to.rate:
        return len(u), "plain", None, None, None, text
    pre, mid, suf = "".join(u[:a]), "".join(u[a:b]), "".join(u[b:])
    p, s, m = to.markers
    form = "spm" if h4 % 100 < to.spm_rate else "psm"
    return len(u), form, pre, mid, suf, s + suf + p + pre + m + mid if form == "spm" else p + pre + s + suf + m + mid


ODD = [
    "\n", "\n\n\n", "one", "one\n", "\none", "a\nb\nc\nd\ne", "\r\n\r\nx\r", "a\x01b\x02c\n\x02d\x02e\x01\n\x01e\n\x02", "$0\\1\n$\n\\", "<P", "<\n<S", "P>\n<", "x<P>y", "<S>", "no <M> here\nb", "é\n日本\n😀😀\n", " \n \n", " \n\x85\n",
]
LINES = r"[^\n]*\n|[^\n]+"


@pytest.mark.parametrize(("to", "unit"), [
    (infill.Infill(), LINES), (infill.Infill(rate=50, spm_rate=20, seed=11), LINES), (infill.Infill(unit=r"[^ \n]*+[ \n]++|[^ \n]++"), r"[^ \n]*[ \n]+|[^ \n]+"),
    (infill.Infill(unit=r"(?s)\x02[de]|.", markers=("[pre]", "[suf]", "[mid]")), r"(?s)."),
])
def test_against_brute_force(spark, to, unit):
    rows = [(100 * k + j, t, "en", "a", 0, 0, 0, "x", 0, "y") for j, t in enumerate(ODD) for k in range(1, 8)]
    rows += [r for r in edge.rows() if unit == LINES or len(r[1] or "") < 9000]
    df = infill.fill_in_middle(edge.docs(spark, rows), to)
    assert df.columns[:-1] == edge.docs(spark).columns
    got = [(r["doc_id"], r["text"], tuple(r["fim"]), r["back"]) for r in df.withColumn("back", infill.restored(df["fim.output"], df["fim.form"], to)).collect()]
    assert len(got) == len(rows)
    for doc_id, text, made, back in got:
        assert made == brute(doc_id, text, to, unit), (doc_id, text)
        assert back == (text or "")
    assert {g[2][1] for g in got} == {"plain", "psm", "spm"}


def test_empty_clash_and_markers(spark):
    assert infill.fill_in_middle(edge.empty(spark)).count() == 0
    with pytest.raises(ValueError):
        infill.fill_in_middle(edge.docs(spark), name="found")
    for markers in (("<P>", "<P>", "<M>"), ("P", "S", "M"), ("<P<", "<S", "<M")):
        with pytest.raises(ValueError):
            infill.Infill(markers=markers)


def test_nothing_is_shuffled(spark, capsys):
    infill.fill_in_middle(edge.docs(spark)).explain()
    plan = capsys.readouterr().out
    assert "Exchange" not in plan and "Python" not in plan
