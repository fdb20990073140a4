import random

import numpy as np

from ledgerlight.llm import vector_dedup as v


def brute(rows, threshold=0.98):
    """Links by every pair, with counts and components."""
    ok = [i for i, (_, x, y) in enumerate(rows) if y is not None and x and None not in x and np.isfinite(x).all() and any(x)]
    parent, n = list(range(len(rows))), [0] * len(rows)

    def top(i):
        while parent[i] != i:
            i = parent[i]
        return i

    for k, i in enumerate(ok):
        for j in ok[k + 1 :]:
            (_, a, y), (_, b, z) = rows[i], rows[j]
            if y == z and len(a) == len(b):
                a, b = np.array(a), np.array(b)
                if a @ b / (np.sqrt(a @ a) * np.sqrt(b @ b)) >= threshold:
                    n[i] += 1
                    n[j] += 1
                    parent[top(i)] = top(j)
    ids = {}
    for i, (d, *_) in enumerate(rows):
        ids.setdefault(top(i), []).append(d)
    low = [min([d for d in ids[top(i)] if d is not None], default=None) for i in range(len(rows))]
    return sorted((str(d), n[i], str(low[i]), d == low[i]) for i, (d, *_) in enumerate(rows))


def test_links_counts_and_components_are_those_of_all_pairs(spark):
    rng = np.random.default_rng(1)
    rows = []
    for _ in range(60):
        base = rng.standard_normal(16)
        for _ in range(random.Random(len(rows)).randrange(1, 5)):
            rows.append((len(rows), (base + rng.standard_normal(16) * 0.06).tolist(), len(rows) % 3))
    base = rng.standard_normal(16)
    rows += [(1000 + i, base.tolist(), 1) for i in range(40)] + [(1100 + i, (base + rng.standard_normal(16) * 0.05).tolist(), 1) for i in range(60)]
    rows += [(2000, None, 1), (2001, [0.0] * 16, 1), (2002, [float("nan")] * 16, 1), (2003, [1.0, None], 1), (2004, base.tolist(), None), (None, base.tolist(), 1), (2005, base[:8].tolist(), 1), (2006, (base * 3).tolist(), 1), (2005, base[:8].tolist(), 1)]
    df = spark.createDataFrame([(*r, "x", "y", 1) for r in rows], "vec_id bigint, embedding array<double>, label int, node string, sigs string, n_links int")
    for block in (16, 512):
        got = v.near_vectors(df, block=block, miss=1e-6).collect()
        assert sorted((str(r.vec_id), r.n_links, str(r.component_id), r.kept) for r in got) == brute(rows)
    assert v.near_vectors(df.limit(0)).count() == 0


def test_ids_as_text_and_lengths_beyond_doubles(spark):
    rng = np.random.default_rng(2)
    base = rng.standard_normal(8)
    rows = [(f"v{i:02}", ((base + rng.standard_normal(8) * 0.02) * s).tolist(), "x") for i, s in enumerate((1.0, 1e200, 1e-200, 3e300 / np.abs(base).max()))] + [("w", rng.standard_normal(8).tolist(), "x")]
    got = {r.vec_id: (r.n_links, r.component_id) for r in v.near_vectors(spark.createDataFrame(rows, "vec_id string, embedding array<double>, label string"), miss=1e-6).collect()}
    assert got == {f"v{i:02}": (3, "v00") for i in range(4)} | {"w": (0, "w")}
