import math

import numpy as np

from symloom.llm import neighbours
from symloom.llm.neighbours import distances, nearest, radius_of, step_of

SCHEMA = "vec_id long, embedding array<float>, label int, score double, rank string"


def table(spark, rows):
    return spark.createDataFrame([(i, v, 0, 0.5, "r") for i, v in rows], SCHEMA)


def brute(rows, queries, k):
    ok = {i: np.array(v, np.float32).astype(float) for i, v in rows if i is not None and v is not None and None not in v and np.isfinite(v).all() and any(v)}
    out = {}
    for q in queries:
        if q in ok:
            d = sorted((float(np.sqrt(((x - ok[q]) ** 2).sum())), i) for i, x in ok.items() if i != q and len(x) == len(ok[q]))
            out[q] = d[:k]
    return out


def test_recall_and_exact_scores(spark):
    rng = np.random.default_rng(5)
    centres = rng.standard_normal((20, 32))
    rows = [(i, (centres[i % 20] + 0.6 * rng.standard_normal(32)).tolist()) for i in range(3000)]
    vectors = table(spark, rows)
    got = nearest(vectors, vectors.filter("vec_id % 100 = 0")).collect()
    want = brute(rows, range(0, 3000, 100), 10)
    assert len(got) == 300
    exact = {(q, i): d for q, found in ((q, brute(rows, [q], 3000)[q]) for q in want) for d, i in found}
    assert all(abs(r["score"] - exact[r["query_id"], r["vec_id"]]) < 1e-12 for r in got)
    hits = sum((r["vec_id"] in {i for _, i in want[r["query_id"]]}) for r in got)
    assert hits >= 0.9 * 300


def test_odd_vectors(spark):
    rows = [(0, [1.0, 0.0]), (1, [1.0, 0.0]), (2, [0.0, 0.0]), (3, None), (4, [1.0, None]), (5, [float("nan"), 1.0]), (6, [float("inf"), 1.0]), (7, []), (8, [3.0, 4.0]), (8, [3.0, 4.0]), (None, [1.0, 1.0]), (9, [1.0, 0.0]), (100, [2.0, 0.0])]
    vectors = table(spark, rows)
    got = {(r["query_id"], r["rank"]): (r["vec_id"], r["score"]) for r in nearest(vectors, vectors.filter("vec_id in (0, 2, 3, 100)"), k=10).collect()}
    assert [got[0, k][0] for k in range(1, 5)] == [1, 9, 100, 8]
    assert {q for q, _ in got} == {0, 100} and len(got) == 8
    assert nearest(vectors.limit(0), vectors).count() == 0 and nearest(vectors, vectors.limit(0)).count() == 0


def test_huge_and_tiny_vectors(spark):
    """Finite components take part, whatever their size, and every search ends."""
    rng = np.random.default_rng(8)
    rows = [(i, rng.standard_normal(8).tolist()) for i in range(300)]
    rows += [(1000 + i, (s * rng.standard_normal(8)).tolist()) for i, s in enumerate((1e154, 1e154, 1e200, 1e200, 1e307, 1e307, 1e-200, 1e-200))]
    rows += [(2000, [1e308] * 8), (2001, [-1e308] * 8), (2002, [1e308] * 7 + [0.9e308])]
    schema = "vec_id long, embedding array<double>"
    vectors = spark.createDataFrame(rows, schema)
    got = {}
    for r in nearest(vectors, vectors.filter("vec_id >= 1000 or vec_id % 100 = 0"), k=5).collect():
        got.setdefault(r["query_id"], []).append((r["vec_id"], r["score"]))
    assert len(got) == 3 + 8 + 3 and all(len(v) == 5 for v in got.values())
    for q, found in got.items():
        own = dict(rows)[q]
        best = min(math.dist(own, v) for i, v in rows if i != q)
        assert all(np.isclose(s, math.dist(own, dict(rows)[i]), rtol=1e-12) for i, s in found if s < np.inf) and found[0][1] <= best * (1 + 1e-12)
    assert got[2000][0][0] == 2002 and abs(got[2000][0][1] / 1e307 - 1) < 1e-9
    assert got[1006][0][0] == 1007 and 0 < got[1006][0][1] < 1e-198
    x = np.array([[3e200, 4e200], [3.0, 4.0], [3e-200, 4e-200]])
    assert np.allclose(distances(x, np.zeros(2)) / [1e200, 1, 1e-200], 5)


def test_blocks_do_not_change_the_result(spark, monkeypatch):
    rng = np.random.default_rng(9)
    rows = [(i, rng.standard_normal(12).tolist()) for i in range(1500)] + [(2000 + i, [1.0] * 12) for i in range(500)]
    vectors = table(spark, rows)
    asked = vectors.filter("vec_id % 50 = 0")
    one = sorted(map(tuple, nearest(vectors, asked).collect()))
    monkeypatch.setattr(neighbours, "VECTOR_BLOCK", 130)
    monkeypatch.setattr(neighbours, "QUERY_BLOCK", 7)
    assert sorted(map(tuple, nearest(vectors, asked).collect())) == one and len(one) == 400


def test_one_key_with_two_vectors(spark):
    rows = [(1, [1.0, 0.0]), (1, [0.0, 1.0]), (2, [1.0, 0.1]), (3, [0.1, 1.0])]
    vectors = table(spark, rows)
    got = sorted((r["rank"], r["vec_id"]) for r in nearest(vectors, vectors.filter("vec_id = 1"), k=1).collect())
    assert got == [(1, 2), (1, 3)]


def test_ladder():
    assert all(radius_of(int(step_of(x))) >= x * (1 - 1e-9) and radius_of(int(step_of(x)) - 1) < x for x in (1e-300, 0.3, 1.0, 7.7, 1e300))


def test_recall_of_a_large_table(spark):
    """At 16,000 rows without any structure, the recall of 10 is 0.9 or more."""
    rng = np.random.default_rng(6)
    x = rng.standard_normal((16_000, 64))
    x = (x / np.linalg.norm(x, axis=1, keepdims=True)).astype(np.float32)
    vectors = spark.createDataFrame([(i, v.tolist()) for i, v in enumerate(x)], "vec_id long, embedding array<float>")
    got = nearest(vectors, vectors.filter("vec_id % 100 = 0")).collect()
    x, hits = x.astype(float), 0
    found = {}
    for r in got:
        found.setdefault(r["query_id"], set()).add(r["vec_id"])
    for q in range(0, 16_000, 100):
        d = ((x - x[q]) ** 2).sum(axis=1)
        d[q] = np.inf
        hits += len(found[q] & set(np.argpartition(d, 10)[:10].tolist()))
    assert hits >= 0.9 * 1600
