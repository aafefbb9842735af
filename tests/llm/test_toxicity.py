import random
from collections import Counter

import numpy as np
import pytest

from symloom.llm import toxicity as x

from .helpers import ODD, docs_table


def random_examples(rng, n, terms):
    """An index over random counts of terms, and its vectors; every third has another one's."""
    model = x.Examples({str(i): i for i in range(terms)}, rng.random(terms) * 4)
    vectors = []
    for i in range(n):
        held = rng.choice(terms, int(rng.integers(0, 12)), replace=False)
        vectors.append(vectors[i // 2] if i % 3 == 2 else model.vector({int(t): int(rng.integers(1, 5)) for t in held}))
    labels = rng.integers(0, 2, n).astype(float)
    return model, model.index(vectors, list(range(n)), labels, np.ones(n))


@pytest.mark.parametrize("n, terms, block, k", [(1, 5, 32, 3), (400, 40, 32, 15), (400, 300, 4, 5), (90, 12, 1, 1)])
def test_nearest_equal_brute_force(monkeypatch, n, terms, block, k):
    monkeypatch.setattr(x, "BLOCK", block)
    model, vectors = random_examples(np.random.default_rng(n + terms), n, terms)
    dense = np.zeros((n, terms))
    for i, (at, w) in enumerate(vectors):
        dense[i, at] = w
    for i in range(0, n, 3):
        cosines = dense @ dense[i]
        want = [j for j in np.lexsort((np.arange(n), -cosines.round(9))) if cosines[j] > 1e-12 and j != i]
        numbers, got = model.nearest(*vectors[i], k, i)
        assert np.allclose(got, cosines[numbers]) and len(numbers) == len(set(numbers.tolist())) == min(k, len(want))
        assert np.allclose(got, cosines[want[:k]])


def test_blocks_are_skipped(monkeypatch):
    """Of examples with terms of their own, blocks that share none with a text, or too little,
    aren't opened."""
    monkeypatch.setattr(x, "BLOCK", 8)
    model = x.Examples({str(i): i for i in range(101)}, np.array([*[3.0] * 100, 0.1]))
    vectors = [model.vector({i // 8: 1, 100: 1}) for i in range(800)]
    model.index(vectors, list(range(800)), np.zeros(800), np.ones(800))
    opened = []

    class Seen(np.ndarray):
        def __getitem__(self, at):
            opened.append(np.size(at))
            return np.asarray(self)[at]

    model.of = model.of.view(Seen)
    numbers, cosines = model.nearest(*vectors[40], 5)
    assert len(numbers) == 5 and np.allclose(cosines, 1) and sum(opened) < 100


def test_terms_are_found_alike(monkeypatch):
    """Terms counted one by one, and found all at once, in pieces of any size."""
    text = "Über-älle don't x_y 3.14 LoserS loser\nlosers, İx an an an\n" * 50 + "w" * 999
    want = Counter(t for w in x.WORD.findall(text.lower()) for t in x.terms_of(w))
    assert x.counted(text) == want and want["loser*"] == 150 and want["loser"] == 50 and want["an"] == 150
    terms = {t: i for i, t in enumerate([*want, "none", "anan*"])}
    finder = x.Finder(terms)
    for size in (1 << 20, 7):
        monkeypatch.setattr(x, "PIECE", size)
        assert x.counted(text) == want
        assert finder.counts(text) == {terms[t]: n for t, n in want.items()}
    assert x.counted(None) == Counter() and finder.counts(None) == Counter() and x.Finder({}).counts("a") == Counter()
    assert x.terms_of("loser") == ["loser", "lose*", "loser*"] and x.terms_of("an") == ["an"]


def test_ratio(spark):
    n1, n0 = 40, 160
    rows = [(0, 7), (12, 3), (40, 160), (40, 0), (10, 40)]
    got = spark.createDataFrame(rows, "a long, b long").select(x.unlikelihood(x.F.col("a"), x.F.col("b"), n1, n0).alias("g")).collect()
    for (a, b), r in zip(rows, got, strict=True):
        table = np.array([[a, b], [n1 - a, n0 - b]], float)
        expected = np.outer(table.sum(axis=1), table.sum(axis=0)) / 200
        with np.errstate(divide="ignore", invalid="ignore"):
            want = 2 * np.nansum(np.where(table > 0, table * np.log(table / expected), 0))
        assert abs(r["g"] - want) < 1e-9


def test_curve_is_finite_and_rising():
    votes = np.concatenate([np.full(50, 0.05), np.full(50, 0.95)])
    a, b = x.logistic(x.logit(votes), np.repeat([0.0, 1.0], 50), np.ones(100))
    p = 1 / (1 + np.exp(-(a * x.logit(votes) + b)))
    assert a > 0 and p[0] < 0.1 and p[-1] > 0.9
    assert x.logistic(x.logit(votes), np.repeat([1.0, 0.0], 50), np.ones(100))[0] == 0


def corpus(n=600, seed=4):
    """Clean texts, and toxic ones with few toxic words, a third of them with endings of their
    own; all toxic words are rare beside the rest."""
    rng = random.Random(seed)
    part = lambda k: "".join(rng.choice(["ta", "ne", "ro", "li", "su", "mo"]) for _ in range(k))
    bad = ["vexgrub", "zubnak", "drokfel", "quimzak"]
    rows, labels = [], []
    for i in range(n):
        body = [part(rng.randrange(1, 4)) for _ in range(rng.randrange(20, 200))]
        if toxic := i % 4 == 0:
            for _ in range(rng.randrange(2, 6)):
                body.insert(rng.randrange(len(body)), rng.choice(bad).title() + (part(1) if i % 3 == 0 else ""))
        rows.append((i, " ".join(body) + ".", "s"))
        labels.append((i, int(toxic)))
    return rows, labels


def test_held_out_accuracy_and_evidence(spark):
    rows, labels = corpus()
    docs = docs_table(spark, rows)
    table = spark.createDataFrame([*labels, (None, 1), (9999, 0), (3, None), (5, 7)], "doc_id long, toxic int")
    model = x.fit(docs, table.filter("doc_id % 5 > 0 or doc_id is null"))
    got = {r["doc_id"]: r["p"] for r in x.scored(docs, model, to="p").collect()}
    held = [(got[i]["score"] >= 0.5) == bool(y) for i, y in labels if i % 5 == 0]
    assert len(held) == 120 and np.mean(held) >= 0.98
    known = dict(labels)
    for i, p in got.items():
        assert 0 <= p["score"] <= 1 and len(p["evidence"]) <= x.NEAREST
        assert all(e["id"] % 5 and known[e["id"]] == e["label"] and 0 < e["cosine"] < 1 + 1e-9 for e in p["evidence"])
        assert [e["cosine"] for e in p["evidence"]] == sorted((e["cosine"] for e in p["evidence"]), reverse=True)
    # Nearly all toxic ones have toxic neighbours first.
    assert np.mean([got[i]["evidence"][0]["label"] == 1 for i, y in labels if y and got[i]["evidence"]]) > 0.95
    # Half of the examples of each class: still as right.
    few = x.fit(docs, table.filter("doc_id % 5 > 0"), most=150)
    assert len(few.ids) < 350 and few.stands.max() > 1.5
    again = {r["doc_id"]: r["p"]["score"] for r in x.scored(docs, few, to="p").collect()}
    assert np.mean([(again[i] >= 0.5) == bool(y) for i, y in labels if i % 5 == 0]) >= 0.95


def test_odd_rows(spark):
    rows, labels = corpus(120)
    model = x.fit(docs_table(spark, rows), spark.createDataFrame(labels, "doc_id long, toxic int"))
    odd = [*ODD, (70, "q" * 1_000_000, "s"), (71, "Vexgrub zubnak " * 60_000, "s")]
    got = x.scored(docs_table(spark, odd), model).collect()
    assert len(got) == len(odd) and all(0 <= r["toxicity"]["score"] <= 1 for r in got)
    score = {r["doc_id"]: r["toxicity"]["score"] for r in got}
    assert score[71] > 0.5 and max(score[i] for i in (1, 2, 3, 5, 70)) < 0.5
    assert x.scored(docs_table(spark, rows).limit(0), model).count() == 0


def test_one_class_only(spark):
    docs = docs_table(spark, [(1, "a b", "s"), (2, "c", "s")])
    for labels, low, high in (([(1, 1), (2, 1)], 0.5, 1), ([(1, 0)], 0, 0.5), ([], 0.4, 0.6)):
        model = x.fit(docs, spark.createDataFrame(labels, "doc_id long, toxic int"))
        scores = {r["toxicity"]["score"] for r in x.scored(docs, model).collect()}
        assert len(scores) == 1 and low <= scores.pop() <= high
