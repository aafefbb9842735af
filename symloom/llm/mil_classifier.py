"""Quality classifier: attention-based multiple-instance learning over passages.

A document is a bag of passages of a fixed number of words (in very long documents a multiple of
it, so that a bag is bounded and yet holds every word); only the document has a label.
Every passage is encoded (shares of byte classes, word shape, hashed words, then one learned
layer), a gated attention weighs the passages, and a logistic unit scores their weighted sum.
The whole text counts. The network is trained in numpy on a bounded sample of labelled
documents; scoring runs in Arrow batches on the executors.
"""

from __future__ import annotations

from collections.abc import Iterator
from dataclasses import dataclass

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

#: Words of a passage, and passages of a bag: with more words the passages of a document are
#: longer, by a whole factor.
PASSAGE, BAG = 64, 1_000
#: Labelled documents that the network learns from, about, at most (taken by a hash of the id).
LEARN_DOCS = 4_000
#: Bytes of a text that are looked at together, about (a passage is whole).
PIECE = 4 << 20
HASHED = 64
HIDDEN, GATE, EPOCHS, BATCH, RATE, DECAY = 24, 12, 25, 64, 0.01, 1e-4

#: Byte classes: each ASCII mark for itself, then these.
MARKS = bytes(b for b in range(33, 127) if not chr(b).isalnum())
LOWER, UPPER, DIGIT, BLANK, BREAK, HIGH, OTHER = range(len(MARKS), len(MARKS) + 7)
CLASSES = OTHER + 1
CLASS_OF = np.full(256, OTHER, np.int64)
CLASS_OF[list(MARKS)] = np.arange(len(MARKS))
CLASS_OF[97:123], CLASS_OF[65:91], CLASS_OF[48:58], CLASS_OF[[32, 9]], CLASS_OF[[10, 11, 12, 13]], CLASS_OF[128:] = LOWER, UPPER, DIGIT, BLANK, BREAK, HIGH
SPACE = np.zeros(256, bool)
SPACE[[32, 9, 10, 11, 12, 13]] = True
WORD_TABLE = np.random.default_rng(17).integers(0, 2**63, (16, 256), dtype=np.uint64)
WIDTH = CLASSES + 5 + HASHED


def passages(text: str | None) -> np.ndarray:
    """(passages, WIDTH) raw features of a whole text; a text without words is one passage of
    zeros."""
    raw = np.frombuffer((text or "").encode("utf-8", "replace"), np.uint8)
    inside = ~SPACE[raw]
    starts = np.flatnonzero(inside & ~np.concatenate([[False], inside[:-1]])) if len(raw) else np.zeros(0, np.int64)
    if not len(starts):
        return np.zeros((1, WIDTH), np.float32)
    words = PASSAGE * -(-len(starts) // (PASSAGE * BAG))
    # A passage ends where the next begins; the first has what is before its first word.
    cuts = np.concatenate([[0], starts[words::words], [len(raw)]])
    out, at = [], 0
    while at < len(cuts) - 1:
        to = max(at + 1, int(np.searchsorted(cuts, cuts[at] + PIECE, side="right")) - 1)
        a, b = cuts[at], cuts[to]
        out.append(features(raw[a:b], inside[a:b], starts[at * words : to * words] - a, words))
        at = to
    return np.concatenate(out)


def features(raw: np.ndarray, inside: np.ndarray, starts: np.ndarray, words: int) -> np.ndarray:
    """Of consecutive passages of so many words, whose words begin at starts."""
    n = -(-len(starts) // words)
    word = np.cumsum(np.bincount(starts, minlength=len(raw))) - 1
    word[word < 0] = 0
    part = word // words
    size = np.bincount(part, minlength=n)
    classes = np.bincount(part * CLASSES + CLASS_OF[raw], minlength=n * CLASSES).reshape(n, CLASSES) / size[:, None]
    place = (np.arange(len(raw)) - starts[word]) & 15
    with np.errstate(over="ignore"):
        hashes = np.add.reduceat(np.where(inside, WORD_TABLE[place, raw], np.uint64(0)), starts)
    length = np.add.reduceat(inside.astype(np.int64), starts)
    of = np.arange(len(starts)) // words
    held = np.bincount(of, minlength=n)
    order = np.lexsort((hashes, of))
    again = (hashes[order][1:] == hashes[order][:-1]) & (of[order][1:] == of[order][:-1])
    repeats = np.bincount(of[order][1:][again], minlength=n) / held
    ends = np.minimum(starts + length - 1, len(raw) - 1)
    mark_end = np.bincount(of, CLASS_OF[raw[ends]] < len(MARKS), n) / held
    capital = np.bincount(of, CLASS_OF[raw[starts]] == UPPER, n) / held
    # The length as a logarithm: one very long word must not set the scale for all others.
    shape = np.stack([np.log1p(np.bincount(of, length, n) / held), repeats, mark_end, capital, held / words], axis=1)
    bag = np.bincount(of * HASHED + (hashes >> np.uint64(20)).astype(np.int64) % HASHED, minlength=n * HASHED).reshape(n, HASHED) / held[:, None]
    return np.concatenate([classes, shape, bag], axis=1).astype(np.float32)


def sigmoid(x: np.ndarray) -> np.ndarray:
    return 1 / (1 + np.exp(-np.clip(x, -30, 30)))


@dataclass
class AttentionNet:
    """Standardising constants and weights. Parts: encoder (W, c), attention (V, U, w), unit
    (b, b0)."""

    mean: np.ndarray
    scale: np.ndarray
    weights: dict[str, np.ndarray]

    def forward(self, x: np.ndarray, starts: np.ndarray) -> tuple:
        """Of standardised passages x of bags that begin at starts."""
        p = self.weights
        code = np.tanh(x @ p["W"] + p["c"])
        t, s = np.tanh(code @ p["V"]), sigmoid(code @ p["U"])
        e = (t * s) @ p["w"]
        n = np.diff([*starts, len(x)])
        e = np.exp(e - np.repeat(np.maximum.reduceat(e, starts), n))
        a = e / np.repeat(np.add.reduceat(e, starts), n)
        z = np.add.reduceat(a[:, None] * code, starts, axis=0)
        return sigmoid(z @ p["b"] + p["b0"]), z, a, code, t, s, n

    def standard(self, x: np.ndarray) -> np.ndarray:
        return np.clip((x - self.mean) / self.scale, -8, 8)

    def score(self, bags: list[np.ndarray]) -> np.ndarray:
        """0 to 1 for each bag of raw passages."""
        starts = np.cumsum([0, *map(len, bags[:-1])])
        return self.forward(self.standard(np.concatenate(bags)), starts)[0]


def gradients(net: AttentionNet, x: np.ndarray, starts: np.ndarray, y: np.ndarray, weight: np.ndarray) -> dict[str, np.ndarray]:
    """Of the weighted mean cross-entropy."""
    p = net.weights
    score, z, a, code, t, s, n = net.forward(x, starts)
    d = (score - y) * weight / len(y)
    dz = np.repeat(d[:, None] * p["b"], n, axis=0)
    da = (dz * code).sum(axis=1)
    de = a * (da - np.repeat(np.add.reduceat(a * da, starts), n))
    dts = de[:, None] * p["w"]
    dt, ds = dts * s * (1 - t * t), dts * t * s * (1 - s)
    dcode = a[:, None] * dz + dt @ p["V"].T + ds @ p["U"].T
    dx = dcode * (1 - code * code)
    return {"b": z.T @ d, "b0": d.sum(keepdims=True), "w": (t * s).T @ de, "V": code.T @ dt, "U": code.T @ ds, "W": x.T @ dx, "c": dx.sum(axis=0)}


def train(bags: list[np.ndarray], labels: np.ndarray, seed: int = 1) -> AttentionNet:
    """Adam over mini-batches of bags; each class has half of the weight."""
    rng = np.random.default_rng(seed)
    everything = np.concatenate(bags) if bags else np.zeros((1, WIDTH), np.float32)
    mean, scale = everything.mean(axis=0), np.maximum(everything.std(axis=0), 1e-3)
    start = lambda *shape: (rng.standard_normal(shape) / np.sqrt(shape[0]))
    net = AttentionNet(mean, scale, {"W": start(WIDTH, HIDDEN), "c": np.zeros(HIDDEN), "V": start(HIDDEN, GATE), "U": start(HIDDEN, GATE), "w": start(GATE), "b": start(HIDDEN), "b0": np.zeros(1)})
    good = labels.mean() if len(labels) else 0.5
    if not bags or not 0 < good < 1:  # nothing to tell apart: a constant score
        net.weights["b"][:] = 0
        net.weights["b0"][:] = np.log((good + 0.01) / (1.01 - good))
        return net
    standard = [net.standard(b) for b in bags]
    weight = np.where(labels == 1, 0.5 / good, 0.5 / (1 - good))
    m = {k: np.zeros_like(v) for k, v in net.weights.items()}
    v = {k: np.zeros_like(x) for k, x in net.weights.items()}
    step = 0
    for _ in range(EPOCHS):
        order = rng.permutation(len(bags))
        for lo in range(0, len(order), BATCH):
            some = order[lo : lo + BATCH]
            x = [standard[i] for i in some]
            g = gradients(net, np.concatenate(x), np.cumsum([0, *map(len, x[:-1])]), labels[some], weight[some])
            step += 1
            for k in net.weights:
                grad = g[k] + DECAY * net.weights[k]
                m[k] = 0.9 * m[k] + 0.1 * grad
                v[k] = 0.999 * v[k] + 0.001 * grad * grad
                net.weights[k] = net.weights[k] - RATE * m[k] / (1 - 0.9**step) / (np.sqrt(v[k] / (1 - 0.999**step)) + 1e-8)
    return net


def fit(docs: DataFrame, labels: DataFrame, doc_id: str = "doc_id", text: str = "text", label: str = "quality", most: int = LEARN_DOCS) -> AttentionNet:
    """Learns from about `most` labelled documents. labels must hold only rows to learn from;
    null ids, labels other than 0 and 1, and labels without a document take no part."""
    labels = labels.select(F.col(doc_id).alias("label_key"), F.col(label).alias("label")).filter("label in (0, 1) and label_key is not null")
    n = labels.count()
    if n > most:
        labels = labels.filter(F.pmod(F.xxhash64(F.lit(23), "label_key"), F.lit(1_000_000)) < int(1_000_000 * most / n))
    own = docs.select(F.col(f"`{doc_id}`").alias("own_key"), F.col(f"`{text}`").cast("string").alias("own_text"))
    picked = own.join(F.broadcast(labels), F.col("own_key") == F.col("label_key")).select("label_key", "label", "own_text")  # about `most` rows of two numbers

    def encode(parts: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for part in parts:
            for lo in range(0, part.num_rows, 200):
                some = part.slice(lo, 200)
                bags = [passages(t.as_py()).tobytes() for t in some.column("own_text")]
                yield pa.RecordBatch.from_arrays([some.column("label_key"), some.column("label"), pa.array(bags, pa.binary())], names=["id", "label", "bag"])

    kinds = dict(picked.dtypes)
    rows = picked.mapInArrow(encode, f"id {kinds['label_key']}, label {kinds['label']}, bag binary").collect()  # bounded by LEARN_DOCS and BAG
    rows.sort(key=lambda r: (r["id"], r["label"], r["bag"]))
    bags = [np.frombuffer(r["bag"], np.float32).reshape(-1, WIDTH) for r in rows]
    return train(bags, np.array([r["label"] for r in rows], float))


def scored(docs: DataFrame, net: AttentionNet, text: str = "text", to: str = "score") -> DataFrame:
    """docs with the double `to`, between 0 and 1; higher means that label 1 is likelier.

    Null and empty texts are one passage of zeros, and have its score. Other columns stay; one
    named `to` is replaced. An empty table stays empty."""
    model = docs.sparkSession.sparkContext.broadcast(net)  # a fixed size: that of the network

    @F.arrow_udf("double")
    def score(parts: Iterator[pa.Array]) -> Iterator[pa.Array]:
        for texts in parts:
            out: list[np.ndarray] = []
            for lo in range(0, len(texts), 100):
                out.append(model.value.score([passages(t.as_py()) for t in texts.slice(lo, 100)]))
            yield pa.array(np.concatenate(out) if out else [], pa.float64())

    return docs.withColumn(to, score(docs[text].cast("string")))


def held_out(doc_id: Column) -> Column:
    """Documents that are never learned from: crc32 of the id as text is divisible by 5."""
    return F.coalesce(F.crc32(doc_id.cast("string").cast("binary")) % 5 == 0, F.lit(False))
