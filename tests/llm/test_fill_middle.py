import hashlib
import random
import re

import pytest
import regex

from ledgerlight.llm import fill_middle as f

ODD = ["a", "é", "日", "🙂", " ", "\n", "é", "<P", "P>", "<", ">", "$1", "\\", "\x00"]


def brute(doc_id, text, units):
    """The cut by a list of all units."""
    h = hashlib.sha256(f"1:{doc_id}".encode()).hexdigest()
    h1, h2, h3, h4 = (int(h[i : i + 8], 16) for i in range(0, 32, 8))
    n = len(units)
    if not text or any(m in text for m in ("<P>", "<S>", "<M>")) or h3 % 100 >= 90:
        return n, "plain", None, None, text
    ends = [0]
    for m in units:
        ends.append(m.end())
    a, b = sorted((ends[h1 % (n + 1)], ends[h2 % (n + 1)]))
    p, m, s = text[:a], text[a:b], text[b:]
    form = "spm" if h4 % 100 < 20 else "psm"
    return n, form, a, b - a, f"<S>{s}<P>{p}<M>{m}" if form == "spm" else f"<P>{p}<S>{s}<M>{m}"


@pytest.mark.parametrize("unit", [None, r"\w+|[^\w\s]", r"\X"])
@pytest.mark.parametrize("every", [1, 3, 64])
def test_cuts_are_those_of_a_list_of_units(unit, every):
    rng = random.Random(every)
    for _ in range(150):
        text = "".join(rng.choice(ODD) for _ in range(rng.randrange(40)))
        index = f.Checkpoints(text.encode(), every, f.compiled(unit))
        ends = [0] + [m.end() for m in (regex.finditer(unit, text) if unit else re.finditer("(?s).", text))]
        assert index.n == len(ends) - 1 and [index.cut(u) for u in range(len(ends))] == [(len(text[:e].encode()), e) for e in ends]
        assert len(index.units) <= 1 + index.n // every


def test_chunks_that_begin_inside_a_character(monkeypatch):
    monkeypatch.setattr(f, "CHUNK", 5)
    text = "aé日🙂" * 50
    index = f.Checkpoints(text.encode(), 7)
    assert index.n == 200 and [index.cut(u) for u in range(201)] == [(len(text[:u].encode()), u) for u in range(201)]


def test_rows(spark):
    rng = random.Random(1)
    texts = ["".join(rng.choice(ODD) for _ in range(rng.randrange(60))) for _ in range(300)] + ["", None, "a<P>b", "x", "é" * 300_000 + "🙂" * 200_000, "same", "same"]
    rows = [(i, t, "x", 1) for i, t in enumerate(texts)] + [(5, texts[5], "y", 2), (None, "no id at all", None, None)]
    df = spark.createDataFrame(rows, "doc_id bigint, text string, output string, n int")
    for unit in (None, r"\S+"):
        made = f.fill_in_middle(df, unit=unit)
        got = made.withColumn("back", f.restored(made.output, made.form)).collect()
        assert len(got) == len(rows)
        want = sorted(((str(i), *map(str, brute("" if i is None else i, t or "", list(re.finditer(unit or "(?s).", t or "")))), t or "") for i, t, *_ in rows))
        assert sorted((str(r.doc_id), str(r.n), r.form, str(r.prefix_chars), str(r.middle_chars), r.output, r.back) for r in got) == want
        assert {r.form for r in got} == {"plain", "psm", "spm"}
    assert f.digest(f.fill_in_middle(df.limit(0))).count() == 0
    assert f.fill_in_middle(df, cut_percent=0).where("form <> 'plain'").count() == 0
    named = f.fill_in_middle(df.selectExpr("cast(doc_id as string) as key", "text as body"), id_col="key", text_col="body")
    assert named.columns[0] == "key" and named.count() == len(rows)
