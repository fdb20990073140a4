from fractions import Fraction

import numpy as np
import pytest

from ledgerlight.llm import whitening as w


def brute(vectors, most=32):
    """Exact sums and deviations, and components of the exact covariance, rounded once."""
    x = [[int(np.floor(float(c) * 64)) + 1_000_000 for c in v] for v in vectors]
    n, s = len(x), [sum(c) for c in zip(*x, strict=True)]
    d = [[n * a - b for a, b in zip(row, s, strict=True)] for row in x]
    cov = np.array([[float(Fraction(sum(row[i] * row[j] for row in d), n**3)) for j in range(len(s))] for i in range(len(s))])
    values, vecs = np.linalg.eigh(cov)
    values, vecs = values[::-1][:most], vecs[:, ::-1][:, :most]
    return n, [sum(v * v for v in row) for row in d], np.array(d, float) / n @ vecs / np.sqrt(values), values / np.trace(cov)


def test_against_exact_sums(spark):
    rng = np.random.default_rng(3)
    base = rng.standard_normal((300, 12)) @ rng.standard_normal((12, 12))
    base[7] = base[8]
    rows = [(i, v.tolist(), "x", 1) for i, v in enumerate(base)]
    bad = [(900, None, "x", 1), (901, [1.0] * 11 + [None], "x", 1), (902, [float("nan")] * 12, "x", 1), (903, [float("inf")] + [0.0] * 11, "x", 1), (904, [], "x", 1), (905, [1e300] * 12, "x", 1)]
    df = spark.createDataFrame(rows + bad, "vec_id bigint, embedding array<double>, whitened string, n int").repartition(5)
    n, deviation, whitened, explained = brute(base)
    found = w.whiten(df)
    got = {r.vec_id: r for r in found.collect()}
    assert set(got) == set(range(300)) and {r.n for r in got.values()} == {300}
    assert [got[i].deviation for i in range(300)] == deviation
    ours = np.array([got[i].whitened for i in range(300)])
    signs = np.sign((ours * whitened).sum(0))
    assert np.allclose(ours, whitened * signs, atol=1e-9) and np.allclose(got[0].explained, explained, rtol=1e-9)
    assert {r.identity_error for r in got.values()} == {got[0].identity_error} and got[0].identity_error < 1e-9
    flat = w.by_component(found)
    assert flat.columns == ["vec_id", "n", "deviation", "identity_error", "component", "whitened", "explained"] and flat.count() == 300 * 12
    assert {r.component: r.whitened for r in flat.where("vec_id = 4").collect()} == {k + 1: v for k, v in enumerate(got[4].whitened)}


def test_no_more_components_than_asked_for(spark):
    rng = np.random.default_rng(4)
    df = spark.createDataFrame([(i, rng.standard_normal(40).tolist()) for i in range(200)], "vec_id int, embedding array<float>")
    rows = w.whiten(df).collect()
    assert {len(r.whitened) for r in rows} == {32} and rows[0].explained == sorted(rows[0].explained, reverse=True) and rows[0].identity_error < 1e-9


def test_directions_without_variance_and_other_lengths(spark):
    rng = np.random.default_rng(5)
    rows = [(str(i), [*(v := rng.standard_normal(3) * 5).tolist(), float(np.floor(v[0] * 64)) / 64, 2.0]) for i in range(50)]
    rows += [("a", [1.0, 2.0]), ("b", [1.0, 2.0]), (None, [1.0, 2.0]), ("one", [3.0])]
    got = w.whiten(spark.createDataFrame(rows, "vec_id string, embedding array<double>")).collect()
    flat = [r for r in got if len(r.whitened) == 5]
    assert len(flat) == 50 and all(r.whitened[3:] == [None, None] and None not in r.whitened[:3] and r.identity_error < 1e-9 for r in flat)
    same = [r for r in got if len(r.whitened) == 2]
    assert len(same) == 3 and all(r.n == 3 and r.deviation == 0 and r.whitened == [None, None] and r.explained == [0.0, 0.0] and r.identity_error == 0 for r in same)
    assert [(r.n, r.whitened) for r in got if len(r.whitened) == 1] == [(1, [None])]


def test_empty(spark):
    assert w.by_component(w.whiten(spark.createDataFrame([], "vec_id bigint, embedding array<float>, n int"))).count() == 0
    assert w.by_component(w.whiten(spark.createDataFrame([(1, None)], "vec_id bigint, embedding array<float>"))).count() == 0


@pytest.mark.parametrize("far", [2.0**40, 2.0**44])
def test_products_beyond_64_bits(far):
    x = np.array([[0, 5], [int(far) * 64, 7], [3, 2**50]])
    c = w.Centre(3, [int(v) for v in x.sum(0)])
    d = c.deviations(x)
    want = [[3 * int(a) - int(s) for a, s in zip(row, x.sum(0))] for row in x]
    assert d.tolist() == want
    squares = [sum(v * v for v in row) for row in want]
    assert c.squares(d) == [v if v <= w.LONG else None for v in squares]
    big = w.Centre(2**20, [0, 0])
    assert big.deviations(x).tolist() == [[int(v) * 2**20 for v in row] for row in x]
