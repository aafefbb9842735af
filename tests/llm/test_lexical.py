import math
import random
import re
from collections import Counter

import numpy as np
import pytest

from symloom.llm import lexical as x

from .helpers import ODD, docs_table

TERM = re.compile("[^\x00-\x2f\x3a-\x40\x5b-\x60\x7b-\x7f]+")


def terms(text):
    return TERM.findall("".join(chr(ord(c) + 32) if "A" <= c <= "Z" else c for c in text or ""))


def brute(docs, items, k=50):
    """docs: (doc_id, text); the contract by loops."""
    held = [(i, Counter(terms(t))) for i, t in docs]
    held = [(i, c) for i, c in held if c]
    n, length = len(held), sum(c.total() for _, c in held)
    df = Counter(t for _, c in held for t in c)
    out = []
    for item, text in sorted(set(items), key=str):
        scored = []
        for i, c in held:
            m = 100 - 50 + (50 * c.total() * n) // length
            s = sum(math.floor(1000 * math.log((2 * n + 2) / (2 * df[t] + 1))) * ((10**9 * c[t]) // (1000 * c[t] + 20 * m)) for t in set(terms(text)) if c[t])
            if s > 0:
                scored.append((-s, i is None, i))
        out += [(item, r, i, -s) for r, (s, _, i) in enumerate(sorted(scored, key=lambda v: (v[0], v[1], v[2] or 0))[:k], 1)]
    return sorted(out, key=str)


def corpus(seed=3, n=700):
    rng = random.Random(seed)
    words = ["".join(rng.choice("aeioul") for _ in range(rng.randrange(1, 6))) for _ in range(400)]
    pick = lambda k: " ".join(rng.choice(words[: rng.choice([5, 40, 400])]).title() for _ in range(k))
    docs = [(10 * i, pick(rng.randrange(1, 120))) for i in range(n)]
    docs += docs[:30] + [(10 * i + 1, docs[i][1]) for i in range(60)]
    return docs, [(i, pick(rng.randrange(1, 40))) for i in range(20)]


def found(spark, docs, items, k=50):
    table = docs_table(spark, [(*d, "s") for d in docs]).repartition(3)
    asked = spark.createDataFrame(items, "item_id long, text string").withColumn("score", x.F.lit("x"))
    return sorted((tuple(r) for r in x.ranked(table, asked, k).select("item_id", "rank", "doc_id", "score").collect()), key=str)


@pytest.mark.parametrize("window, documents, short, k", [(2_048, 65_536, 64, 50), (16, 150, 8, 5), (8, 10_000, 3, 1)])
def test_equals_brute_force(spark, monkeypatch, window, documents, short, k):
    for name, v in (("WINDOW", window), ("DOCUMENTS", documents), ("SHORT", short)):
        monkeypatch.setattr(x, name, v)
    docs, items = corpus()
    assert found(spark, docs, items, k) == brute(docs, items, k)


def test_walk_equals_sums_and_skips(monkeypatch):
    """The lists of a block against plain sums, whatever is short; with high bounds early, most
    windows are never opened."""
    monkeypatch.setattr(x, "WINDOW", 32)
    rng = np.random.default_rng(9)
    n = 4_000
    for short in (0.1, 8, 64, 1e9):
        monkeypatch.setattr(x, "SHORT", short)
        lists = [np.sort(rng.choice(n, size, replace=False)) for size in (3, 30, 60, 200, 1500, 3900)]
        adds = [rng.integers(0, 40, len(p)) * (40 if len(p) < 100 else 1) for p in lists]
        made = x.Lists(np.repeat(np.arange(6), list(map(len, lists))), np.concatenate(lists), np.concatenate(adds), n)
        total = np.zeros(n, np.int64)
        for p, a in zip(lists, adds, strict=True):
            total[p] += a
        want = [i for i in np.lexsort((np.arange(n), -total)) if total[i] > 0][:10]
        places, scores = made.best(list(range(6)), 10)
        assert places.tolist() == want and scores.tolist() == total[want].tolist()
    opened = []

    class Seen(np.ndarray):
        def __getitem__(self, at):
            if isinstance(at, slice):
                opened.append(at.start)
            return np.asarray(self)[at]

    places = np.arange(n)
    adds = np.where(places < 64, 100, 1)
    x.walk([(places, adds.view(Seen), *x.bounds(places, adds, -(-n // 32)))], -(-n // 32), 5)
    assert len(opened) == 1


def test_pieces_cut_between_terms(monkeypatch):
    monkeypatch.setattr(x, "PIECE", 7)
    text = "Élan ÜBER-9 don't x_y é\x1c\x85z " * 20 + "w" * 100
    assert x.counted(text) == Counter(t.encode() for t in terms(text))


def test_odd_rows(spark):
    docs = [d[:2] for d in ODD] + [(9, "q" * 1_000_000), (8, "two " * 50), (None, "two three four")]
    items = [(1, "two three"), (1, "same TEXT"), (1, "two three"), (None, "élan"), (4, None), (5, " .,"), (6, "absent"), (7, "q" * 1_000_000)]
    assert found(spark, docs, items) == brute(docs, [i for i in items if i[1]])
    assert found(spark, docs[:0], items) == [] and found(spark, docs, items[:0]) == []


def test_items_in_parts(spark, monkeypatch):
    monkeypatch.setattr(x, "ITEMS", 6)
    docs, items = corpus(n=200)
    assert found(spark, docs, items, 10) == brute(docs, items, 10)
