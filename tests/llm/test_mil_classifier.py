import numpy as np

from symloom.llm import mil_classifier as c

from .helpers import ODD, docs_table


def test_gradients_match_differences():
    rng = np.random.default_rng(0)
    bags = [rng.random((n, c.WIDTH)).astype(np.float32) for n in (3, 1, 5)]
    net = c.train(bags, np.array([0.0, 1.0, 0.0]))
    x, starts = np.concatenate([net.standard(b) for b in bags]), np.array([0, 3, 4])
    y, w = np.array([0.0, 1.0, 1.0]), np.array([1.0, 2.0, 0.5])

    def loss():
        s = net.forward(x, starts)[0]
        return -(w * (y * np.log(s) + (1 - y) * np.log(1 - s))).mean()

    g = c.gradients(net, x, starts, y, w)
    for name in net.weights:
        flat = net.weights[name].reshape(-1) if net.weights[name].ndim else net.weights[name].reshape(1)
        k = int(rng.integers(len(flat)))
        old, eps = float(flat[k]), 1e-5
        flat[k] = old + eps
        up = loss()
        flat[k] = old - eps
        down = loss()
        flat[k] = old
        assert abs((up - down) / (2 * eps) - g[name].reshape(-1)[k]) < 1e-4


def test_passages():
    assert c.passages(None).shape == (1, c.WIDTH) and not c.passages(" \n").any()
    assert len(c.passages("w " * 65)) == 2 and len(c.passages("  x")) == 1


def test_long_documents_keep_every_word(monkeypatch):
    """More words than a bag has passages for make longer passages; pieces change nothing."""
    rng = np.random.default_rng(8)
    text = "  " + " ".join("".join(rng.choice(list("aB3%é"), rng.integers(1, 9))) for _ in range(3_000))
    whole = c.passages(text)
    assert len(whole) == 47
    monkeypatch.setattr(c, "PIECE", 700)
    assert np.array_equal(c.passages(text), whole)
    monkeypatch.setattr(c, "BAG", 10)
    few = c.passages(text)
    assert len(few) == 10
    # Shares of classes by their passages' bytes are those of the text as a whole.
    raw = text.encode()
    letters = np.bincount(c.CLASS_OF[np.frombuffer(raw, np.uint8)], minlength=c.CLASSES)
    starts = [i for i, x in enumerate(raw) if x != 32 and raw[i - 1] == 32][:: 64 * 5]
    size = np.diff([0, *starts[1:], len(raw)])
    assert np.allclose((few[:, : c.CLASSES] * size[:, None]).sum(axis=0), letters, atol=1e-2)


def test_long_labelled_documents_count(spark, monkeypatch):
    """Where only long documents tell the classes apart, they are told apart."""
    monkeypatch.setattr(c, "BAG", 4)
    rows = [(i, ("plain words " if i % 2 else "## %% odd ") * 400, "s") for i in range(40)]
    docs = docs_table(spark, rows)
    net = c.fit(docs, spark.createDataFrame([(i, i % 2) for i in range(40)], "doc_id long, quality int"))
    scores = {r["doc_id"]: r["p"] for r in c.scored(docs, net, to="p").collect()}
    assert min(scores[i] for i in range(1, 40, 2)) > 0.8 and max(scores[i] for i in range(0, 40, 2)) < 0.2


def test_one_long_word_spoils_nothing(spark):
    rows = [(i, ("plain words in a line, " if i % 2 else "## %% odd ") * 40, "s") for i in range(40)] + [(40, "QUJD" * 500_000, "s"), (41, "x " + "QUJD" * 500_000, "s")]
    docs = docs_table(spark, rows)
    net = c.fit(docs, spark.createDataFrame([(i, i % 2) for i in range(41)], "doc_id long, quality int"))
    scores = {r["doc_id"]: r["p"] for r in c.scored(docs, net, to="p").collect()}
    assert len(scores) == 42 and all(0 <= p <= 1 for p in scores.values())
    assert min(scores[i] for i in range(1, 40, 2)) > 0.8 and max(scores[i] for i in range(0, 40, 2)) < 0.2


def test_held_out_accuracy(spark):
    rng = np.random.default_rng(2)
    word = lambda: "".join(rng.choice(list("aeionrst"), rng.integers(2, 8)))
    rows, labels = [], []
    for i in range(500):
        good = i % 3 > 0
        body = [word() + ("" if good or k < 60 else "%%%") for k in range(int(rng.integers(70, 200)))]
        rows.append((i, " ".join(body), "s"))
        labels.append((i, int(good)))
    docs = docs_table(spark, rows)
    table = spark.createDataFrame([*labels, (None, 1), (9999, 0), (3, None)], "doc_id long, quality int")
    net = c.fit(docs, table.filter("doc_id % 4 > 0 or doc_id is null"))
    got = {r["doc_id"]: r["p"] for r in c.scored(docs, net, to="p").collect()}
    right = [(got[i] >= 0.3) == bool(y) for i, y in labels if i % 4 == 0]
    assert np.mean(right) >= 0.95
    odd = c.scored(docs_table(spark, ODD), net).collect()
    assert len(odd) == len(ODD) and all(0 <= r["score"] <= 1 for r in odd)
    assert c.scored(docs.limit(0), net).count() == 0


def test_one_class_only(spark):
    docs = docs_table(spark, [(1, "a b", "s"), (2, "c", "s")])
    net = c.fit(docs, spark.createDataFrame([(1, 1), (2, 1)], "doc_id long, quality int"))
    assert min(net.score([c.passages("x")])) > 0.9
    assert 0.4 < c.fit(docs, spark.createDataFrame([], "doc_id long, quality int")).score([c.passages("x")])[0] < 0.6
