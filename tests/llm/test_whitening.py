from collections import Counter

import numpy as np
import pytest

from symloom.llm import whitening as w

SCHEMA = "vec_id long, embedding array<float>, x string, n string, component string"


def vectors_table(spark, rows):
    return spark.createDataFrame([(i, None if v is None else [None if a is None else float(a) for a in v], "x", "n", "c") for i, v in rows], SCHEMA).repartition(3)


def brute(vectors):
    """{position: (n, deviation, whitened up to signs, explained)} by an eigenvalue routine."""
    x = np.array([[int(np.floor(64 * float(np.float32(a)))) + 1_000_000 for a in v] for v in vectors], dtype=object)
    fit = np.array(sorted(set(map(tuple, x.tolist()))), dtype=object)
    n, s = len(fit), fit.sum(axis=0)
    mean = np.array([float(a) / n for a in s])
    c = fit.astype(float) - mean
    e, v = np.linalg.eigh(c.T @ c / n)
    e, v = e[::-1], v[:, ::-1]
    keep = min(w.COMPONENTS, int((e > 1e-9 * e[0]).sum()))
    y = (x.astype(float) - mean) @ (v[:, :keep] / np.sqrt(e[:keep]))
    return n, [sum(d * d for d in n * row - s) for row in x], y, e[:keep] / e.sum()


def check(got, rows):
    n, deviation, y, explained = brute([v for _, v in rows])
    found: dict = {}
    for r in got:
        found.setdefault(r["vec_id"], []).append(r)
    signs = None
    for k, (i, _) in enumerate(rows):
        own = sorted(found[i], key=lambda r: r["component"])
        assert [r["component"] for r in own] == list(range(1, len(explained) + 1))
        assert {(r["n"], r["deviation"]) for r in own} == {(n, deviation[k])}
        mine = np.array([r["whitened"] for r in own])
        if signs is None:
            signs = np.sign(mine * y[k])
        assert np.allclose(mine, signs * y[k], rtol=1e-6, atol=1e-6)
        assert np.allclose([r["explained"] for r in own], explained, rtol=1e-6) and own[0]["identity_error"] <= 1e-9


def test_equals_an_eigenvalue_routine(spark):
    rng = np.random.default_rng(5)
    mixing = rng.standard_normal((20, 20)) * np.geomspace(1, 30, 20)
    rows = [(i, (rng.standard_normal(20) @ mixing).astype(np.float32)) for i in range(300)]
    rows += [(1000 + i, v) for i, v in rows[:40]]  # copies count once
    table = vectors_table(spark, rows)
    got = w.whitened(table, w.fit(table)).collect()
    assert len(got) == 340 * 16
    check(got, rows)


def test_fewer_dimensions_than_rank(spark):
    rng = np.random.default_rng(6)
    base = rng.standard_normal((200, 3)) * 9
    rows = [(i, [*np.round(v * 64) / 64, 5.0, np.round(v[0] * 64) / 64]) for i, v in enumerate(base)]
    table = vectors_table(spark, rows)
    got = w.whitened(table, w.fit(table)).collect()
    assert max(r["component"] for r in got) == 3
    check(got, rows)


def test_odd_rows(spark):
    rows = [(1, None), (2, [1.0, None]), (3, [float("nan"), 1.0]), (4, [float("inf"), 0.0]), (5, []), (6, [0.0, 0.0]), (6, [0.0, 0.0]), (None, [3.0, -1.0]), (8, [1.0, 7.0]), (9, [1.0, 2.0, 3.0])]
    table = vectors_table(spark, rows)
    got = Counter((r["vec_id"], r["component"], r["n"]) for r in w.whitened(table, w.fit(table)).collect())
    assert got == {(6, 1, 3): 2, (6, 2, 3): 2, (None, 1, 3): 1, (None, 2, 3): 1, (8, 1, 3): 1, (8, 2, 3): 1}
    assert w.whitened(table.limit(0), w.fit(table.limit(0))).count() == 0


def test_huge_entries(spark):
    big = spark.createDataFrame([(1, [1e300, 1.0]), (2, [-1e300, 2.0]), (3, [0.5, -1.0])], "vec_id long, embedding array<double>")
    got = {r["vec_id"]: r for r in w.whitened(big, w.fit(big)).collect()}
    assert got[1]["deviation"] is None and got[2]["deviation"] is None and all(np.isfinite(r["whitened"]) for r in got.values())


@pytest.mark.parametrize("d", [1, 2, 5, 33, 64])
def test_factors(d):
    rng = np.random.default_rng(d)
    m = rng.standard_normal((2 * d, d)) * np.geomspace(1e-4, 1e4, d)
    a = m.T @ m
    g = w.pivoted_cholesky(a)
    assert np.allclose(g @ g.T, a, rtol=1e-12, atol=1e-12 * a.max())
    o = w.orthogonal_columns(g)
    inner = o.T @ o
    norms = np.sqrt(inner.diagonal())
    assert np.abs(inner / np.outer(norms, norms) - np.eye(len(norms))).max() < 1e-12
    assert np.allclose(np.sort(inner.diagonal()), np.sort(np.linalg.svd(g, compute_uv=False) ** 2), rtol=1e-8)


def test_exact_deviations():
    model = w.Whitening(3, [10**13, 7], np.zeros(0), np.zeros((2, 0)), 1.0)
    x = np.array([[10**12, 5], [3, 4]])
    assert model.deviations(x) == [v if (v := (3 * a - 10**13) ** 2 + (3 * b - 7) ** 2) < 2**63 else None for a, b in x.tolist()]
