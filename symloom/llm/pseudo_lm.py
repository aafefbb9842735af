"""Masked pseudo-likelihood scores by a bidirectional window network.

The network predicts every word from the words on both sides of it: embeddings of the window,
one matrix per place, a tanh layer, and a softmax over word classes; within its class a word
has its share of the corpus counts. The network's vocabulary has a limit (VOCABULARY); all other
words are its last class, in which each has its own counted share too. A document's score is the
sum of the log probabilities of all its words.

Counts cover the whole corpus, by one shuffle. Counts of words outside the network's vocabulary
are kept in two hashed rows of buckets (the smaller of a word's two counts, so a count is too
high where both buckets are shared), in the shared folder, where scoring tasks read them.

Every document is trained on, once, in one of ROUNDS rounds that a hash of its text picks. In a
round, copies of the network run Adagrad in numpy over COPY words each, from a common start, and
are then averaged row by row, weighted by how often each copy used a row; the next round starts
from that. So the number of copies follows the corpus, not how it is cut into tasks, while the
network, which is what is broadcast, has a fixed size.
"""

from __future__ import annotations

from collections import Counter
from collections.abc import Iterator
from dataclasses import dataclass
from functools import lru_cache
from itertools import repeat

import numpy as np
import pyarrow as pa
import pyarrow.fs
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .shared import file_at, saved, shared_dir

VOCABULARY, CLASSES, DIM, SIDE, BATCH, RATE = 8_192, 128, 16, 2, 4_096, 0.1
PLACES = [k for k in range(-SIDE, SIDE + 1) if k]
#: Sums over classes are products with this.
ONES = np.ones(CLASSES, np.float32)
#: Distinct words that a task counts before it hands the counts on.
COUNTED = 300_000
#: Rounds of averaging, and words that a copy of the network learns from.
ROUNDS, COPY = 3, 1_000_000
#: Buckets of a row of counts of words outside the network's vocabulary: 2 to this power.
RARE_BITS = 23


def words(text: str | None) -> list[str]:
    return (text or "").lower().split()


@dataclass
class Vocabulary:
    """Word -> id, most frequent first; id len(ids) is any other word, the next one padding. The
    share of another word is that of one that occurs once; `rare` is where counts are."""

    ids: dict[str, int]
    class_of: np.ndarray
    log_share: np.ndarray
    rare: str | None = None

    @classmethod
    def of(cls, counts: list[tuple[str, int]], other: int) -> Vocabulary:
        """counts: in order, most frequent first; other: occurrences of all other words."""
        n = np.array([c for _, c in counts] + [max(other, 1)], float)
        upto = np.cumsum(n) - n / 2
        class_of = np.minimum((upto / n.sum() * (CLASSES - 1)).astype(np.int64), CLASSES - 2)
        class_of[-1] = CLASSES - 1
        share = n / np.bincount(class_of, n, CLASSES)[class_of]
        share[-1] = 1 / max(other, 1)
        return cls({w: i for i, (w, _) in enumerate(counts)}, class_of, np.log(share))

    def encode(self, text: str | None) -> np.ndarray:
        return self.ids_of(words(text))

    def ids_of(self, found: list[str]) -> np.ndarray:
        return np.fromiter(map(self.ids.get, found, repeat(len(self.ids))), np.int64, len(found))

    def rare_share(self, found: list[str], ids: np.ndarray) -> float:
        """Sum of the logarithms of the counts of those words that are outside the vocabulary."""
        at = np.flatnonzero(ids == len(self.ids)) if self.rare else ()
        if not len(at):
            return 0.0
        import xxhash

        h = np.fromiter(map(xxhash.xxh64_intdigest, map(found.__getitem__, at.tolist()), repeat(42)), np.uint64, len(at))
        logs = rare_logs(self.rare)
        return float(np.minimum(logs[0, h >> np.uint64(64 - RARE_BITS)], logs[1, h & np.uint64(2**RARE_BITS - 1)]).sum(dtype=float))


@lru_cache(maxsize=1)
def rare_logs(uri: str) -> np.ndarray:
    """(2, buckets): logarithms of the counts in each bucket of either row, read once a worker; an
    empty bucket is as one word that occurs once."""
    import pyarrow.parquet as pq

    fs, path = file_at(uri)
    out = np.zeros(2 << RARE_BITS, np.float16)
    for file in fs.get_file_info(pa.fs.FileSelector(path)):
        if file.path.endswith(".parquet"):
            for part in pq.ParquetFile(fs.open_input_file(file.path)).iter_batches(1 << 18, columns=["bucket", "n"]):
                out[part.column("bucket").to_numpy()] = np.log(part.column("n").to_numpy())
    return out.reshape(2, -1)


def rare_counts(counts: DataFrame, top: DataFrame) -> str:
    """Where the counts of all words but those of top (bounded) are written, by bucket: the first
    bits of a word's hash in the first row, and its last bits in the second."""
    h = F.xxhash64("word")
    both = F.array(F.shiftrightunsigned(h, 64 - RARE_BITS), h.bitwiseAND(2**RARE_BITS - 1) + 2**RARE_BITS)
    rows = counts.join(F.broadcast(top.select("word")), "word", "left_anti").select("n", F.explode(both).alias("bucket"))
    path = shared_dir(counts.sparkSession, "rare-counts")
    rows.groupBy("bucket").agg(F.sum("n").alias("n")).write.parquet(path)
    return path


@dataclass
class Network:
    embed: np.ndarray  # (words + other + padding, DIM)
    place: np.ndarray  # (2 SIDE, DIM, DIM)
    out: np.ndarray  # (DIM + 1, CLASSES); the last row is the bias

    @classmethod
    def start(cls, n: int, class_share: np.ndarray) -> Network:
        rng = np.random.default_rng(29)
        bias = np.log(np.maximum(class_share, 1e-6))[None]
        small = lambda *s: rng.standard_normal(s).astype(np.float32)
        return cls(small(n, DIM) * 0.3, small(len(PLACES), DIM, DIM) / DIM**0.5 / len(PLACES) ** 0.5, np.concatenate([small(DIM, CLASSES) * 0.1, bias]).astype(np.float32))

    def hidden(self, near: list[np.ndarray]) -> np.ndarray:
        """near: the embeddings at each place of the window."""
        return np.tanh(sum(x @ w for x, w in zip(near, self.place, strict=True)))

    def near(self, around: np.ndarray) -> list[np.ndarray]:
        """around: (positions, places) of ids."""
        return [self.embed[around[:, k]] for k in range(len(PLACES))]

    def exponentials(self, h: np.ndarray, target: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
        """exp of the class activations (less their maximum, if they may be large), and the
        activation of target."""
        x = h @ self.out[:-1]
        x += self.out[-1]
        if np.abs(self.out).sum(axis=0).max() > 60:  # h lies between -1 and 1
            x -= x.max(axis=1, keepdims=True)
        own = x[np.arange(len(x)), target]
        return np.exp(x, out=x), own


def windows(docs: list[np.ndarray], pad: int) -> np.ndarray:
    """(positions, places): the neighbours of every word of every document, padded."""
    gap = np.full(SIDE, pad)
    line = np.concatenate([x for d in docs for x in (gap, d)] + [gap])
    own = np.concatenate([np.arange(len(d)) + off for d, off in zip(docs, np.cumsum([SIDE, *(len(d) + SIDE for d in docs)]), strict=False)])
    return line[own[:, None] + np.array(PLACES)]


def batches(docs: Iterator[np.ndarray], pad: int) -> Iterator[tuple[np.ndarray, np.ndarray]]:
    """(targets, neighbours), about BATCH positions at a time; a longer document is cut."""
    held: list[np.ndarray] = []
    size = 0

    def flush():
        around, target = windows(held, pad), np.concatenate(held)
        for lo in range(0, len(target), BATCH):
            yield target[lo : lo + BATCH], around[lo : lo + BATCH]

    for d in docs:
        if len(d):
            held.append(d)
            size += len(d)
        if size >= BATCH:
            yield from flush()
            held, size = [], 0
    if held:
        yield from flush()


def trained(net: Network, parts: Iterator[tuple[np.ndarray, np.ndarray]], class_of: np.ndarray, most: int) -> tuple[Network, np.ndarray, int]:
    """The network after Adagrad over the next parts (batches), up to `most` words, the uses of
    each embedding, and the number of words."""
    net = Network(net.embed.copy(), net.place.copy(), net.out.copy())
    seen_embed, seen_place, seen_out = np.full(len(net.embed), 1e-2, np.float32), np.full_like(net.place, 1e-2), np.full_like(net.out, 1e-2)
    uses, total = np.zeros(len(net.embed)), 0
    for target, around in parts:
        n = len(target)
        total += n
        near = net.near(around)
        h = net.hidden(near)
        d, _ = net.exponentials(h, class_of[target])
        d *= (1 / (n * (d @ ONES)))[:, None]
        d[np.arange(n), class_of[target]] -= np.float32(1 / n)
        g_out = np.concatenate([h.T @ d, d.sum(axis=0)[None]])
        dh = (d @ net.out[:-1].T) * (1 - h * h)
        g_place = np.stack([x.T @ dh for x in near])
        flat = around.T.ravel().astype(np.uint16)
        g_rows = np.concatenate([dh @ w.T for w in net.place])
        order = np.argsort(flat, kind="stable")
        ordered = flat[order]
        first = np.flatnonzero(np.concatenate([[True], ordered[1:] != ordered[:-1]]))
        rows, count = ordered[first], np.diff([*first, len(ordered)])
        g = np.add.reduceat(g_rows[order], first, axis=0)
        uses[rows] += count
        for x, seen, grad in ((net.out, seen_out, g_out), (net.place, seen_place, g_place)):
            seen += grad * grad
            x -= RATE * grad / np.sqrt(seen)
        seen_embed[rows] += (g * g).mean(axis=1)
        net.embed[rows] -= RATE * g / np.sqrt(seen_embed[rows])[:, None]
        if total >= most:
            break
    return net, uses, total


@dataclass
class Model:
    vocabulary: Vocabulary
    network: Network

    def scores(self, docs: list[np.ndarray]) -> list[float]:
        """For each document the sum of the log probabilities of its words, each word outside the
        vocabulary as one that occurs once."""
        v, found = self.vocabulary, []
        for target, around in batches(iter(docs), len(self.network.embed) - 1):
            e, own = self.network.exponentials(self.network.hidden(self.network.near(around)), v.class_of[target])
            found.append(own - np.log(e @ ONES) + v.log_share[target])
        if not found:
            return [0.0] * len(docs)
        upto = np.concatenate([[0.0], np.cumsum(np.concatenate(found), dtype=float)])
        ends = np.cumsum([0, *map(len, docs)])
        return (upto[ends[1:]] - upto[ends[:-1]]).tolist()


def word_counts(texts: DataFrame) -> DataFrame:
    """(word, n) over all texts (one column, text)."""

    def count(parts: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        held: Counter = Counter()

        def out() -> pa.RecordBatch:
            return pa.RecordBatch.from_arrays([pa.array(list(held), pa.string()), pa.array(list(held.values()), pa.int64())], names=["word", "n"])

        for part in parts:
            for t in part.column("text"):
                held.update(words(t.as_py()))
                if len(held) > COUNTED:
                    yield out()
                    held.clear()
        yield out()

    return texts.mapInArrow(count, "word string, n long").groupBy("word").agg(F.sum("n").alias("n"))


def learn(docs: DataFrame, text: str = "text") -> Model:
    """Vocabulary and network from all texts. Null and empty texts add nothing."""
    spark = docs.sparkSession
    texts = docs.select(F.col(f"`{text}`").cast("string").alias("text"))
    counts = saved(word_counts(texts), "word-counts")
    total = counts.agg(F.coalesce(F.sum("n"), F.lit(0))).first()[0]
    first = counts.orderBy(F.desc("n"), "word").limit(VOCABULARY)
    top = [(r["word"], r["n"]) for r in first.collect()]  # at most VOCABULARY rows
    other = total - sum(n for _, n in top)
    v = Vocabulary.of(top, other)
    if other:
        v.rare = rare_counts(counts, first)
    n = np.array([c for _, c in top] + [max(other, 1)], float)
    net = Network.start(len(top) + 2, np.bincount(v.class_of, n, CLASSES) / n.sum())
    for k in range(ROUNDS):
        some = texts.filter(F.pmod(F.xxhash64("text"), F.lit(ROUNDS)) == k)
        net = averaged(some, v, net)
    return Model(v, net)


def averaged(texts: DataFrame, v: Vocabulary, start: Network) -> Network:
    """The mean of the copies of a network that learn from texts, or itself without any."""
    given = texts.sparkSession.sparkContext.broadcast((v, start))  # a fixed size: that of the network
    rows = len(start.embed) + len(PLACES) * DIM + (DIM + 1) * CLASSES // DIM

    def fit(parts: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        v, start = given.value
        own = batches((v.encode(t.as_py()) for part in parts for t in part.column("text")), len(start.embed) - 1)
        while True:
            net, uses, total = trained(start, own, v.class_of, COPY)
            if not total:
                return
            flat = np.concatenate([net.embed, net.place.reshape(-1, DIM), net.out.reshape(-1, DIM)])
            weight = np.concatenate([uses, np.full(rows - len(uses), float(total))])
            used = np.flatnonzero(weight)
            yield pa.RecordBatch.from_arrays([pa.array(used, pa.int64()), pa.array(weight[used]), *(pa.array(flat[used, k]) for k in range(DIM))], names=["row", "weight", *(f"x{k}" for k in range(DIM))])

    parts = texts.mapInArrow(fit, "row long, weight double, " + ", ".join(f"x{k} float" for k in range(DIM)))
    means = parts.groupBy("row").agg(*[(F.sum(F.col("weight") * F.col(f"x{k}")) / F.sum("weight")).alias(f"x{k}") for k in range(DIM)]).collect()  # a row for each of the network's rows
    flat = np.concatenate([start.embed, start.place.reshape(-1, DIM), start.out.reshape(-1, DIM)])
    for r in means:
        flat[r["row"]] = r[1:]
    a, b = len(start.embed), len(start.embed) + len(PLACES) * DIM
    given.unpersist()
    return Network(flat[:a], flat[a:b].reshape(start.place.shape), flat[b:].reshape(start.out.shape))


def scored(docs: DataFrame, model: Model, text: str = "text") -> DataFrame:
    """docs with the struct `lm`: n_words, log_prob (sum over the whole text, natural logarithm)
    and per_word (null without words). Null and empty texts have 0 words and log_prob 0.
    Other columns stay; one named lm is replaced."""
    given = docs.sparkSession.sparkContext.broadcast(model)

    @F.arrow_udf("n_words long, log_prob double, per_word double")
    def score(parts: Iterator[pa.Array]) -> Iterator[pa.Array]:
        m = given.value
        for texts in parts:
            n, logs = [], []
            for lo in range(0, len(texts), 50):
                found = [words(t.as_py()) for t in texts.slice(lo, 50)]
                ids = [m.vocabulary.ids_of(w) for w in found]
                n += map(len, ids)
                logs += [x + m.vocabulary.rare_share(w, i) for x, w, i in zip(m.scores(ids), found, ids, strict=True)]
            per = [x / k if k else None for x, k in zip(logs, n, strict=True)]
            yield pa.StructArray.from_arrays([pa.array(n, pa.int64()), pa.array(logs, pa.float64()), pa.array(per, pa.float64())], ["n_words", "log_prob", "per_word"])

    return docs.withColumn("lm", score(docs[text].cast("string")))
