import random

import numpy as np

from ledgerlight.llm import passage_dedup as p


def brute_chain(places):
    """Best local chain score by trying all predecessors."""
    places = sorted(set(places))
    best = []
    for i, (x, h) in enumerate(places):
        best.append(p.SEED + max([0.0, *(best[j] - p.GAP * (x - q + h - g) for j, (q, g) in enumerate(places[:i]) if q < x and g < h)]))
    return max(best)


def chain_score(chain):
    return p.SEED * len(chain) - sum(p.GAP * (x - q + h - g) for (q, g), (x, h) in zip(chain, chain[1:]))


def test_chains_have_the_best_score():
    rng = random.Random(1)
    for _ in range(300):
        places = [(rng.randrange(80), rng.randrange(80)) for _ in range(rng.randrange(2, 25))]
        found = p.chains(places)
        if found:
            assert abs(max(map(chain_score, found)) - brute_chain(places)) < 1e-6
        used = [x for c in found for x in c]
        assert len(used) == len(set(used)) and set(used) <= set(places)


def test_alignment_grows_over_edits():
    a = np.arange(100, dtype=np.uint64)
    b = np.concatenate([a[:30], [np.uint64(900)], a[31:60], a[62:]])
    start, end, there, _, n = p.aligned(a, b, [(35, 35), (45, 45), (70, 68)], 5)
    assert (start, end, there, n) == (0, 100, 0, 97)


def test_planted_passages_are_found_and_clean_documents_left_alone(spark):
    rng = random.Random(2)
    word = lambda: "".join(rng.choice("abcdefghijk") for _ in range(4))
    text = lambda n: [word() for _ in range(n)]
    passages = [text(n) for n in (52, 60, 90, 200)]
    rows, planted = [], {}
    for i in range(240):
        w = text(rng.randrange(5, 150))
        if i % 3 == 0:
            q = list(passages[i // 3 % 4])
            if i % 2:
                for _ in range(2):
                    q[rng.randrange(10, len(q) - 10)] = word()
            at = rng.randrange(len(w))
            planted[i] = (at, at + len(q))
            w = w[:at] + q + w[at:]
        if i % 3 == 1:
            w = w[:3] + passages[0][:30] + w[3:]  # too short to count
        rows.append((i, " ".join(w) if i % 5 else "\n".join(w).upper()))
    base = " ".join(text(70))
    rows += [(1000 + i, base) for i in range(50)] + [(2000, None), (2001, ""), (None, base), (1000, base), (1001, "other text on a known id"), (2002, base.split()[0])]
    df = spark.createDataFrame([(*r, "x", 1, 2) for r in rows], "doc_id bigint, text string, seed string, pos int, th int")
    got = {}
    out = p.repeated_passages(df).collect()
    assert len(out) == len(rows)
    for r in out:
        got.setdefault(r.doc_id, []).append(r)
    first = {min(i for i in planted if i // 3 % 4 == k) for k in range(4)}
    for i in range(240):
        spans = [tuple(map(int, x.split(":")[:2])) for x in got[i][0].passages.split(",") if x]
        if i in planted and i not in first:
            covered = set().union(*(range(*s) for s in spans))
            want = set(range(*planted[i]))
            assert len(covered & want) >= 0.9 * len(want) and len(covered - want) <= 6, (i, spans, planted[i])
        elif i not in planted or i in first:
            assert not spans, (i, spans)
    assert all(got[1000 + i][0].dup_words == 70 for i in range(2, 50)) and not got[None][0].n_passages
    assert [r.n_passages for r in got[2000] + got[2001] + got[2002]] == [0, 0, 0]
    cut = {r.doc_id: r.text for r in p.without_passages(df).where("doc_id < 1000").collect()}
    for i in planted:
        words = rows[i][1].split()
        if i not in first:
            kept = cut[i].split()
            assert len(kept) <= len(words) - 0.9 * (planted[i][1] - planted[i][0])
    assert p.repeated_passages(df.limit(0)).count() == 0
    assert p.without_passages(df).columns == df.columns


def test_texts_that_repeat_themselves(spark):
    loop = "ab cd ef " * 40
    rows = [(1, "one short loop " + "ab cd ef " * 3), (2, f"x y z {loop}"), (3, f"{loop} other words follow"), (4, "no loop here at all")]
    got = {r.doc_id: r.dup_words for r in p.repeated_passages(spark.createDataFrame(rows, "doc_id bigint, text string")).collect()}
    assert got[1] == got[2] == got[4] == 0 and 115 <= got[3] <= 122


def test_chains_below_the_identity_are_split(spark):
    rng = random.Random(4)
    text = lambda n: ["".join(rng.choice("abcdefghijk") for _ in range(6)) for _ in range(n)]
    head, foot, stray = text(60), text(60), text(16)
    rows = [(1, head + text(100) + foot), (2, text(7) + head + text(100) + foot + text(9)), (3, head + text(40) + stray), (4, head[:40] + text(12) + head[40:] + text(45) + stray)]
    rows += [(5, text(30) + stray), (6, text(300) + stray + text(35) + stray[::-1]), (7, text(20) + stray + text(35) + stray[::-1])]
    got = {r.doc_id: [tuple(map(int, x.split(":"))) for x in r.passages.split(",") if x] for r in p.repeated_passages(spark.createDataFrame([(d, " ".join(w)) for d, w in rows], "doc_id bigint, text string")).collect()}
    assert got == {1: [], 2: [(7, 67, 1), (167, 227, 1)], 3: [(0, 60, 1)], 4: [(0, 72, 1)], 5: [], 6: [], 7: []}


def test_parts_are_the_longest_with_the_identity():
    a, b = np.arange(1000, dtype=np.uint64), np.arange(1000, dtype=np.uint64)
    seeds = [(x, x) for x in (0, 20, 40, 52, 75, 95, 300, 305, 340, 600)]
    b[57:69] += np.uint64(5000)  # 12 words between stretches of 57 and 100
    b[110:297] += np.uint64(5000)
    b[350:] += np.uint64(5000)
    b[600:605] -= np.uint64(5000)
    assert sorted(p.parts(a, b, seeds, 5, 50, 0.8)) == [(0, 110, 0, 110, 98), (297, 350, 297, 350, 53)]


def test_copies_beyond_those_of_the_first_document_are_found(spark):
    rng = random.Random(5)
    text = lambda n: ["".join(rng.choice("abcdefghijk") for _ in range(6)) for _ in range(n)]
    passage = text(60)
    rows = [(1, text(10) + passage + text(10)), (2, text(20) + passage + text(150) + passage + text(5)), (3, passage + text(200) + passage + text(170) + passage), (4, text(9) + passage), (5, text(20) + (twice := text(60)) + text(90) + twice)]
    got = {r.doc_id: {tuple(map(int, x.split(":")[:2])) for x in r.passages.split(",") if x} for r in p.repeated_passages(spark.createDataFrame([(d, " ".join(w)) for d, w in rows], "doc_id bigint, text string")).collect()}
    assert got == {1: set(), 2: {(20, 80), (230, 290)}, 3: {(0, 60), (260, 320), (490, 550)}, 4: {(9, 69)}, 5: set()}


def covered(rows):
    return {(r.id, r.th): set().union(*(range(s.start, s.end) for s in r.spans)) for r in rows}


def test_exact_repeats_are_covered_word_by_word(spark):
    """Against the definition: words of runs of 50 or more that stand in an earlier document, and no others."""
    rng = random.Random(9)
    fresh = iter(range(10**9))
    unique = lambda n: [f"u{next(fresh)}" for _ in range(n)]
    shared = [unique(rng.randrange(52, 90)) for _ in range(6)]
    docs = []
    for i in range(40):
        words = unique(rng.randrange(5, 40))
        for k in rng.sample(range(6), rng.randrange(3)):
            words += shared[k] + unique(rng.randrange(5, 40))
        docs.append((i, words))
    grams = lambda w: {tuple(w[a : a + 50]): a for a in range(len(w) - 49)}
    seen, want = set(), {}
    for i, words in docs:
        own = grams(words)
        hit = set().union(*(range(a, a + 50) for g, a in own.items() if g in seen))
        if hit:
            want[i] = hit
        seen |= set(own)
    df = spark.createDataFrame([(i, " ".join(w)) for i, w in docs], "doc_id int, text string")
    assert {i: x for (i, _), x in covered(p.passages(df).collect()).items()} == want and len(want) > 10


def test_rows_that_share_an_id_or_have_none_are_compared(spark):
    rng = random.Random(10)
    text = lambda n: " ".join("".join(rng.choices("abcdefghijklm", k=6)) for _ in range(n))
    passage = text(80)
    for ids, kind in (((7, 7, None, None, 9), "bigint"), (("b", "b", None, None, "c"), "string")):
        rows = [(d, f"{text(30)} {passage} {text(20)}") for d in ids]
        got = p.repeated_passages(spark.createDataFrame(rows, f"doc_id {kind}, text string")).collect()
        # all but one: the first is one of those without id
        assert sorted(r.n_passages for r in got) == [0, 1, 1, 1, 1] and [r.n_passages for r in got if r.doc_id is None].count(0) == 1
        assert all(r.passages.endswith(":null") for r in got if r.n_passages)
        cut = p.without_passages(spark.createDataFrame(rows, f"doc_id {kind}, text string")).collect()
        assert sum(passage in r.text for r in cut) == 1 and len(cut) == 5


def test_fuzzy_passages_are_found(spark):
    rng = random.Random(11)
    vocabulary = ["".join(rng.choices("abcdefghijklmnop", k=rng.randrange(2, 9))) for _ in range(3000)]
    text = lambda n: rng.choices(vocabulary, k=n)
    rows, want = [], {}
    for i in range(0, 240, 2):
        passage = text(rng.choice([60, 100, 200]))
        copy = []
        for w in passage:  # one word in twenty changed, left out or added to
            copy += {0: [rng.choice(vocabulary)], 1: [], 2: [w, rng.choice(vocabulary)]}.get(rng.randrange(60), [w])
        before = text(60)
        rows += [(i, " ".join(text(60) + passage + text(60))), (i + 1, " ".join(before + copy + text(60)))]
        want[i + 1] = set(range(60, 60 + len(copy)))
    got = {i: x for (i, _), x in covered(p.passages(spark.createDataFrame(rows, "doc_id int, text string")).collect()).items()}
    found = [len(got.get(d, set()) & x) >= 0.8 * len(x) for d, x in want.items()]
    assert sum(found) >= 0.95 * len(found) and set(got) <= set(want)
    assert sum(len(got[d] - want[d]) for d in got) <= 0.02 * sum(map(len, want.values()))
