import numpy as np
import pytest

from symloom.llm import pseudo_lm as lm

from .helpers import ODD, docs_table


@pytest.fixture(scope="module")
def model(spark):
    rng = np.random.default_rng(1)
    rows = [(i, " ".join(x for _ in range(60) for x in [("the cat sat on mats".split(), "a dog ran to parks".split())[int(rng.integers(2))]][0]), "s") for i in range(60)]
    docs = docs_table(spark, [*rows, *ODD])
    return docs, lm.learn(docs), rows


def test_probabilities_sum_to_one(model):
    _, m, _ = model
    v = m.vocabulary
    n = len(v.ids)
    around = lm.windows([np.array([0, 1, 2])], len(m.network.embed) - 1)
    e, _ = m.network.exponentials(m.network.hidden(m.network.near(around)), np.zeros(3, int))
    classes = e / e.sum(axis=1, keepdims=True)
    known = classes[:, v.class_of[:n]] * np.exp(v.log_share[:n])
    other = classes[:, -1]  # shared by all other words, by their counts
    empty = [c for c in range(lm.CLASSES) if c not in set(v.class_of)]
    assert np.allclose(known.sum(axis=1) + other + classes[:, empty].sum(axis=1), 1, atol=1e-4)


def test_training_helps_and_order_matters(model):
    _, m, rows = model
    v = m.vocabulary
    start = lm.Network.start(len(m.network.embed), np.bincount(v.class_of, minlength=lm.CLASSES) / len(v.class_of))
    ids = [v.encode(t) for _, t, _ in rows]
    assert sum(m.scores(ids)) > sum(lm.Model(v, start).scores(ids)) + 1
    a, b = m.scores([v.encode("the cat sat on mats " * 5), v.encode("mats on the sat cat " * 5)])
    assert a > b


def test_scores_match_brute_force_and_odd_tables(spark, model):
    docs, m, _ = model
    got = lm.scored(docs, m).collect()
    assert len(got) == docs.count() and got[0]["score"] == "z"
    v, net = m.vocabulary, m.network
    for r in got[:3] + got[-8:]:
        ids = v.encode(r["text"])
        total = 0.0
        pad = len(net.embed) - 1
        line = [pad] * lm.SIDE + ids.tolist() + [pad] * lm.SIDE
        for t, w in enumerate(ids[:500]):
            h = np.tanh(sum(net.embed[line[t + lm.SIDE + k]].astype(float) @ net.place[j] for j, k in enumerate(lm.PLACES)))
            x = h @ net.out[:-1] + net.out[-1]
            total += x[v.class_of[w]] - np.log(np.exp(x).sum()) + v.log_share[w]
        assert r["lm"]["n_words"] == len(ids)
        if len(ids) <= 500:
            assert abs(r["lm"]["log_prob"] - total) < 1e-2 * max(1, abs(total))
        assert (r["lm"]["per_word"] is None) == (len(ids) == 0)
    assert lm.scored(docs.limit(0), m).count() == 0


def test_other_words_have_their_counted_shares(spark, monkeypatch):
    monkeypatch.setattr(lm, "VOCABULARY", 3)
    rows = [(1, "a a a a b b b c c c d d e f", "s"), (2, "g d", "s")]
    docs = docs_table(spark, rows)
    m = lm.learn(docs)
    v = m.vocabulary
    assert set(v.ids) == {"a", "b", "c"} and np.isclose(v.log_share[-1], -np.log(6))
    found = ["a", "d", "e", "never", "d"]
    assert np.isclose(v.rare_share(found, v.ids_of(found)), 2 * np.log(3), atol=1e-3)
    got = {r["doc_id"]: r["lm"]["log_prob"] for r in lm.scored(docs, m).collect()}
    base = dict(zip((1, 2), m.scores([v.encode(t) for _, t, _ in rows]), strict=True))
    assert np.isclose(got[1], base[1] + 2 * np.log(3), atol=1e-2) and np.isclose(got[2], base[2] + np.log(3), atol=1e-2)


def test_copies_follow_words_not_tasks(spark, monkeypatch):
    monkeypatch.setattr(lm, "COPY", 400)
    monkeypatch.setattr(lm, "BATCH", 100)
    docs = docs_table(spark, [(i, "one two three four five " * 20, "s") for i in range(30)])
    a, b = (lm.learn(docs.repartition(n)).network for n in (1, 3))
    assert np.allclose(a.embed, b.embed, atol=0.2) and not np.allclose(a.embed, lm.Network.start(len(a.embed), np.ones(lm.CLASSES) / lm.CLASSES).embed)


def test_empty_corpus(spark):
    m = lm.learn(docs_table(spark, ODD[:3]))
    assert m.scores([np.zeros(0, int)]) == [0.0]


def test_counts_cover_all_texts(spark):
    counts = {r["word"]: r["n"] for r in lm.word_counts(docs_table(spark, [(1, "A b a", "s"), (2, None, "s"), (3, "b", "s")]).select("text")).collect()}
    assert counts == {"a": 2, "b": 2}
