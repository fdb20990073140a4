import math
import random
import zlib

from ledgerlight.llm import toxicity as t


def brute(scores):
    """Maximal segments by their definition: the best segment first, then left and right of it."""
    best = None
    for i in range(len(scores)):
        for j in range(i + 1, len(scores) + 1):
            s = sum(scores[i:j])
            if s > 1e-9 and (best is None or s > best[2] + 1e-9 or abs(s - best[2]) <= 1e-9 and j - i < best[1] - best[0]):
                best = (i, j, s)
    if best is None:
        return []
    i, j, s = best
    right = [(a + j, b + j, x) for a, b, x in brute(scores[j:])]
    return [*brute(scores[:i]), (i, j, s), *right]


def test_segments_are_all_maximal_ones():
    rng = random.Random(1)
    for _ in range(300):
        scores = [rng.choice([-3.0, -1.1, -0.5, 0.7, 2.3]) + rng.random() / 100 for _ in range(rng.randrange(12))]
        got = t.segments(scores)
        assert [(a, b) for a, b, _ in got] == [(a, b) for a, b, _ in brute(scores)], scores


def test_held_out_accuracy_and_edges(spark):
    rng = random.Random(2)
    word = lambda: "".join(rng.choice("abcdefgh") for _ in range(rng.randrange(2, 7)))
    docs, labels = [], []
    for i in range(1500):
        w = [word() for _ in range(rng.randrange(20, 200))]
        bad = i % 6 == 0
        if bad:
            for _ in range(rng.randrange(2, 6)):
                w.insert(rng.randrange(len(w)), rng.choice(["zorkface", "Zorkhead!", "grumble"]))
        docs.append((i, " ".join(w), "x"))
        labels.append((i, int(bad), "x"))
    docs += [(5000, None, "x"), (5001, "", "x"), (None, "zorkface zorkface", "x"), (5002, "quiet words " * 9000, "x"), (0, docs[0][1], "x")]
    df = spark.createDataFrame(docs, "doc_id bigint, text string, score string")
    lab = spark.createDataFrame([*labels, (None, 1, "x"), (7777, None, "x")], "doc_id bigint, toxic int, text string")
    model = t.train(df, lab)
    got = t.scored(df, model).collect()
    assert len(got) == len(docs)
    truth = {d: y for d, y, _ in labels}
    held = [r for r in got if r.held_out and r.doc_id in truth]
    assert all(r.held_out == (zlib.crc32(str(r.doc_id).encode()) % 5 == 0) for r in got if r.doc_id is not None)
    assert sum(r.predicted == truth[r.doc_id] for r in held) >= 0.98 * len(held)
    rest = {r.doc_id: r for r in got}
    assert rest[5000].score == rest[5001].score < 0.5 and rest[5002].predicted == 0
    assert rest[None].predicted == 1
    assert t.scored(df.limit(0), model).count() == 0
    assert t.train(df, lab.limit(0)).weight == 0


def test_odds_follow_their_formula(spark):
    rng = random.Random(3)
    vocabulary = [f"w{chr(97 + i // 26)}{chr(97 + i % 26)}" for i in range(60)] + ["vile"]
    docs = [(i, " ".join(rng.choices(vocabulary[:60], k=12) + (["Vile,"] if i % 4 == 0 and rng.random() < 0.9 else []))) for i in range(400)]
    lab = [(i, int(i % 4 == 0)) for i in range(400)]
    model = t.train(spark.createDataFrame(docs, "doc_id int, text string"), spark.createDataFrame(lab, "doc_id int, toxic int"))
    n = {0: {}, 1: {}}
    for (i, text), (_, y) in zip(docs, lab):
        if zlib.crc32(str(i).encode()) % 5:
            for w in {t.bare(x) for x in text.split()}:
                n[y][w] = n[y].get(w, 0) + 1
    total = {y: sum(n[y].values()) for y in n}
    mass = 0.1 * (total[0] + total[1])
    want = {}
    for w in {*n[0], *n[1]}:
        a = {y: n[y].get(w, 0) + 0.1 * (n[0].get(w, 0) + n[1].get(w, 0)) for y in n}
        d = math.log(a[1] / (total[1] + mass - a[1])) - math.log(a[0] / (total[0] + mass - a[0]))
        want[w] = d, d / math.sqrt(1 / a[1] + 1 / a[0])
    stands = {w: d for w, (d, z) in want.items() if z >= 4 and d >= 2}
    assert set(stands) == {"vile"} == {w for w in model.odds if "~" not in w}
    assert all(abs(model.odds[w] - d) < 1e-9 for w, d in stands.items())
    assert set(model.others) == {w for w in want if n[0].get(w, 0) + n[1].get(w, 0) >= 5} - set(stands)
    assert all(abs(model.others[w] - want[w][0]) < 1e-9 for w in model.others)
    assert model.word("Vile!") == model.odds["vile"] and model.word("unseen") == model.step
    w = max(model.others, key=lambda x: abs(want[x][0]))
    assert model.word(w.upper()) == model.step + max(-2.0, min(0.1, want[w][0]))


def test_chance_segments_are_as_many_as_expected(spark):
    rng = random.Random(4)
    odds = {f"a{i}": x for i, x in enumerate((2.0, 2.5, 3.0, 4.0))}
    text = lambda n: " ".join(rng.choice(list(odds)) if rng.random() < 0.08 else "plain" for _ in range(n))
    rows = spark.createDataFrame([(text(400), 0) for _ in range(400)], "text string, y int")
    model = t.calibrated(t.Model(dict(odds)), rows, spark)
    n = 300
    segs = [e for _ in range(n) for *_, e in model.passages([model.word(w) for w in text(400).split()])]
    for least in (2.0, 0.5, 0.1):
        found = sum(e <= least for e in segs) / n
        assert least / 2.5 < found < least * 2.5, (least, found)
