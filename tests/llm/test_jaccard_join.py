import random
import re

from ledgerlight.llm import jaccard_join as j


def brute(rows, num=90, k=3):
    sets = []
    for _, t in rows:
        w = re.findall(r"[^\x20\x09-\x0D]+", t or "")
        w = [re.sub("[A-Z]", lambda m: m[0].lower(), x) for x in w]
        sets.append({tuple(w[i : i + k]) for i in range(len(w) - k + 1)} if len(w) >= k else {tuple(w)} if w else set())
    parent = list(range(len(rows)))

    def top(i):
        while parent[i] != i:
            i = parent[i]
        return i

    for a in range(len(rows)):
        for b in range(a):
            if sets[a] and sets[b] and 100 * len(sets[a] & sets[b]) >= num * len(sets[a] | sets[b]):
                parent[top(a)] = top(b)
    low = {}
    for i, (d, _) in enumerate(rows):
        if d is not None:
            low[top(i)] = min(low.get(top(i), d), d)
    return sorted((str(d), len(sets[i]), str(low.get(top(i)) if sets[i] else d)) for i, (d, _) in enumerate(rows))


def corpus(seed):
    rng = random.Random(seed)
    word = lambda: "".join(rng.choice("abcdefgh") for _ in range(3))
    rows, shared = [], [word() for _ in range(12)]
    for _ in range(60):
        base = [word() for _ in range(rng.choice([1, 2, 3, 4, 9, 12, 13, 25, 60, 120]))]
        if rng.random() < 0.5:
            base = shared + base
        for _ in range(rng.randrange(1, 5)):
            w = list(base)
            for _ in range(rng.randrange(3)):
                w[rng.randrange(len(w))] = word()
            if rng.random() < 0.3:
                w = [x.upper() for x in w]
            if rng.random() < 0.3:
                w.append(word())
            rows.append(" ".join(w))
    base = [word() for _ in range(110)]
    for _ in range(80):  # a large group of near-copies, some of which link with few others
        w = list(base)
        for _ in range(rng.randrange(5)):
            w[rng.randrange(len(w))] = word()
        rows.append(" ".join(w))
    rows += [rows[0]] * 30 + [None, "", " \n", "É é", "é É"]
    rng.shuffle(rows)
    return [(i * 3, t) for i, t in enumerate(rows)] + [(None, rows[0]), (0, rows[1]), (7, "lonely words stand here alone")]


def test_components_are_those_of_all_pairs(spark):
    for seed, options in ((1, {}), (2, {"block": 16}), (3, {"scan_cost": 1e9})):
        rows = corpus(seed)
        df = spark.createDataFrame([(d, t, "x", b"k", 5) for d, t in rows], "doc_id bigint, text string, token string, key binary, n int")
        got = sorted((str(r.doc_id), r.n_shingles, str(r.component_id)) for r in j.near_copies(df, **options).collect())
        assert got == brute(rows)
    assert j.near_copies(df.limit(0)).count() == 0


def test_boundary_follows_cost():
    sizes = {n: 10 for n in range(1, 41)}
    assert j.boundary_of(sizes, 90, 0.01) <= j.boundary_of(sizes, 90, 10) <= j.boundary_of(sizes, 90, 1e6)
    assert j.required(10, 10, 90) == 10 and j.prefix_length(10, 90) == 2


def test_ids_as_text_and_many_rows_without_one(spark):
    rows = [(None if d is None else f"d{d:05}", t) for d, t in corpus(4)]
    rows += [(None, rows[5][1])] * 40 + [(None, rows[8][1] + " more")] * 40 + [("d00001", rows[9][1])] * 5
    got = j.near_copies(spark.createDataFrame(rows, "doc_id string, text string")).collect()
    assert sorted((str(r.doc_id), r.n_shingles, str(r.component_id)) for r in got) == brute(rows)


def test_counters_grow_with_the_corpus():
    assert [j.buckets_for(n) for n in (0, 10**6, 15 * 10**6, 10**12)] == [1 << 20, 1 << 20, 1 << 22, 1 << 24]
