import random
import re
from collections import Counter

from ledgerlight.llm import quality_rules as q

SCHEMA = "doc_id bigint, text string, lang string, source string, low string, n bigint, measure string, over string"


def brute(text):
    text = text or ""
    words = re.findall(r"[^\x20\x09-\x0D]+", text)
    seen, dup = set(), 0
    for line in text.split("\n"):
        if re.search(r"[^\x20\x09-\x0D]", line):
            dup += line in seen
            seen.add(line)
    windows = Counter(zip(words, words[1:], words[2:]))
    inside = {i + k for i in range(len(words) - 2) if windows[tuple(words[i : i + 3])] > 1 for k in range(3)}
    return len(words), sum(map(len, words)), sum(c in "#*$%&|<>" for c in text), dup, len(inside)


def test_measures_and_verdicts(spark):
    rng = random.Random(1)
    word = lambda: "".join(rng.choice("abcdefghij") for _ in range(rng.randrange(2, 9)))
    rows = []
    for i in range(600):
        text = " ".join(word() for _ in range(80)) + "\n"
        if i % 20 == 0:
            text = text.replace(" ", "*** ")
        if i % 20 == 1:
            text = text.upper()
        if i % 20 == 2:
            text += "same line here\n" * 30
        rows.append((i, text, "en" if i % 3 else None, f"s{i % 4}"))
    rows += [(600, None, "en", "s1"), (601, "", None, None), (602, "a\x0b\x1cb \n\n a", "xx", "rare"), (603, "ab " * 40_000, "en", "s0"), (5, *rows[5][1:]), (None, "x y z", "en", "s1")]
    df = spark.createDataFrame([(*r, "l", 1, "m", "o") for r in rows], SCHEMA)
    got = q.judged(df, least=50).collect()
    assert len(got) == len(rows)
    want = {}
    for d, t, *_ in rows:
        want[d] = brute(t)
    for r in got:
        b = want[r.doc_id]
        assert (r.n_words, r.word_chars, r.n_symbols, r.n_dup_lines, r.n_repeat_words) == b, r
        assert r.base_failed == (b[0] < 50 or 100 * b[4] > 50 * b[0])
    kept = {r.doc_id: r.kept for r in got}
    assert not any(kept[i] for i in range(600) if i % 20 < 3)
    assert sum(kept[i] for i in range(600) if i % 20 >= 3) >= 0.99 * 510
    assert q.judged(df.limit(0)).count() == 0


def test_sketch_quantiles_are_close_and_merge(spark):
    rng = random.Random(2)
    values = [rng.randrange(1, 100_000) for _ in range(5000)]
    df = spark.createDataFrame([(None, f"s{v % 3}", v) for v in values], "lang string, source string, symbol_rate bigint")
    got = q.merged_quantiles(q.sketches(df, ("symbol_rate",)), {"q": 0.75}).where("level = 2").first()
    exact = sorted(values)[int(0.75 * len(values))]
    assert got.total == 5000 and abs(got.q - exact) <= exact / 32 + 1


def test_many_groups_take_the_salted_join(spark, monkeypatch):
    df = spark.createDataFrame([(i, "word " * 60, "en", f"s{i % 5}") for i in range(40)], "doc_id bigint, text string, lang string, source string")
    plain = sorted(q.judged(df).collect())
    monkeypatch.setattr(q, "GROUPS", 2)
    assert sorted(q.judged(df).collect()) == plain
