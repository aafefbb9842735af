"""Toxicity: votes of the nearest labelled examples by exact TF-IDF cosine.

A text's terms are its lower-cased words and what words begin with (4 to 6 letters, which stands
for the stem where endings vary). Of all terms of the labelled examples those stay that are several
times as frequent in toxic ones, which chance must make very unlikely; others say little about
the label, and rare ones among them would outweigh those that do in the cosine. The examples are held in an inverted index, in which the postings of
a term are cut into blocks of examples and each block keeps its greatest weight. A text is
compared to blocks in falling order of what their greatest weights allow, and no block is opened
that can't hold one of the k nearest, so the k nearest are exact.

Each of them votes for its label, the nearer the more, and a logistic curve fitted to the votes
that examples get from the other examples makes the votes a probability. The neighbours are
returned as evidence.
"""

from __future__ import annotations

import re
from collections import Counter
from collections.abc import Iterator
from dataclasses import dataclass, field

import ahocorasick
import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from .shared import saved

#: Labelled documents of each class that are examples, about, at most (taken by a hash of the id).
LEARN_DOCS = 4_000
#: Terms that are kept, at most; how unlikely by chance their frequencies must be (the
#: log-likelihood ratio; 30 has a chance of 1 in 20 million, and there are millions of terms);
#: and how many times as frequent in toxic examples.
TERMS, UNLIKELY, TIMES = 16_384, 30.0, 8.0
PREFIXES = (4, 5, 6)
#: Letters of a word that is a term as a whole; of longer ones the beginnings are.
WORD_LETTERS = 40
NEAREST = 15
#: Examples of an index block.
BLOCK = 32
#: Added to a distance, and the weight of the vote that nothing speaks for or against.
NEAR, UNKNOWN = 0.1, 0.5
WORD, BLANK, GAP = re.compile(r"\w+"), re.compile(r"\W"), re.compile(r"\W+")
#: Characters of a text that are looked at together.
PIECE = 1 << 20


def pieces(text: str | None) -> Iterator[str]:
    """A text in lower case, in parts of bounded size in which words are whole."""
    text, at = text or "", 0
    while at < len(text):
        cut = BLANK.search(text, at + PIECE)
        end = cut.start() if cut else len(text)
        yield text[at:end].lower()
        at = end


def terms_of(word: str) -> list[str]:
    """A word, and its beginnings."""
    return [word] * (len(word) <= WORD_LETTERS) + [word[:n] + "*" for n in PREFIXES if len(word) >= n]


def counted(text: str | None) -> Counter:
    """How often a text holds each term."""
    words: Counter = Counter()
    for piece in pieces(text):
        words.update(WORD.findall(piece))
    held: Counter = Counter()
    for word, times in words.items():
        for t in terms_of(word):
            held[t] += times
    return held


class Finder:
    """Finds given terms ({term: number}) in texts, all at once."""

    def __init__(self, numbers: dict[str, int]):
        self._found = ahocorasick.Automaton()
        for term, i in numbers.items():
            self._found.add_word(" " + (term[:-1] if term[-1] == "*" else term + " "), i)
        self._found.make_automaton()
        self._any = bool(numbers)

    def counts(self, text: str | None) -> Counter:
        held: Counter = Counter()
        for piece in pieces(text) if self._any else ():
            held.update(i for _, i in self._found.iter(f" {GAP.sub(' ', piece)} "))
        return held


@dataclass
class Examples:
    """The index over labelled examples: unit vectors over the terms, in blocks."""

    numbers: dict[str, int]
    idf: np.ndarray
    ids: list = field(default_factory=list)
    labels: np.ndarray = field(default_factory=lambda: np.zeros(0))
    #: What an example stands for: one over the share of its class that was taken.
    stands: np.ndarray = field(default_factory=lambda: np.zeros(0))
    #: The vote without evidence, what an example stands for on average, and the curve.
    rate: float = 0.0
    usual: float = 1.0
    curve: tuple[float, float] = (1.0, 0.0)

    def vector(self, counts: dict[int, int]) -> tuple[np.ndarray, np.ndarray]:
        """(term numbers, unit weights) of how often a text holds the terms."""
        at = np.array(sorted(counts), np.int64)
        w = (1 + np.log([counts[t] for t in at.tolist()])) * self.idf[at] if len(at) else np.zeros(0)
        keep = w > 0
        at, w = at[keep], w[keep]
        return at, w / np.sqrt((w * w).sum()) if len(w) else w

    def index(self, vectors: list[tuple[np.ndarray, np.ndarray]], ids: list, labels: np.ndarray, stands: np.ndarray) -> list[tuple[np.ndarray, np.ndarray]]:
        """Takes the examples in; returns their vectors in the order of their numbers. Examples of
        the same heaviest terms are neighbours in number, so that blocks differ."""
        heavy = [tuple(at[np.argsort(-w, kind="stable")[:3]].tolist()) for at, w in vectors]
        order = sorted(range(len(vectors)), key=lambda i: (heavy[i], i))
        self.ids, self.labels, self.stands = [ids[i] for i in order], labels[order], stands[order]
        vectors = [vectors[i] for i in order]
        terms = np.concatenate([np.zeros(0, np.int64), *[at for at, _ in vectors]])
        of = np.repeat(np.arange(len(vectors)), [len(at) for at, _ in vectors])
        weights = np.concatenate([np.zeros(0), *[w for _, w in vectors]])
        by_term = np.lexsort((of, terms))
        terms, self.of, self.weights = terms[by_term], of[by_term], weights[by_term]
        blocks = -(-max(len(vectors), 1) // BLOCK)
        cell = terms * blocks + self.of // BLOCK
        self.starts = np.searchsorted(cell, np.arange(len(self.numbers) * blocks + 1))
        self.most = np.zeros(len(self.numbers) * blocks, np.float64)
        np.maximum.at(self.most, cell, self.weights)
        self.most = self.most.reshape(len(self.numbers), blocks)
        self.blocks = blocks
        return vectors

    def nearest(self, at: np.ndarray, w: np.ndarray, k: int, skip: int = -1) -> tuple[np.ndarray, np.ndarray]:
        """(numbers, cosines) of the k nearest examples with a cosine above 0, equal ones by
        number; the example `skip` takes no part."""
        best, cosines = np.zeros(0, np.int64), np.zeros(0)
        if not len(at) or not len(self.ids):
            return best, cosines
        allowed = w @ self.most[at]
        order = np.argsort(-allowed, kind="stable")
        cells = at[:, None] * self.blocks
        lo, step = 0, 2
        while lo < len(order) and allowed[order[lo]] > 0:
            if len(cosines) == k and allowed[order[lo]] + 1e-9 < cosines[-1]:  # the sums differ by rounding
                break
            some = order[lo : lo + step]
            lo, step = lo + step, min(2 * step, 16)
            a = self.starts[cells + some].reshape(-1)
            each = self.starts[cells + some + 1].reshape(-1) - a
            before = np.cumsum(each) - each
            places = np.repeat(a - before, each) + np.arange(before[-1] + each[-1])
            # Examples of the opened blocks, numbered within these.
            shift = np.tile((np.arange(len(some)) - some) * BLOCK, len(at))
            sums = np.bincount(self.of[places] + np.repeat(shift, each), self.weights[places] * np.repeat(np.repeat(w, len(some)), each), len(some) * BLOCK)
            row = np.flatnonzero(sums > (cosines[-1] - 1e-9 if len(cosines) == k else 0))
            found = some[row // BLOCK] * BLOCK + row % BLOCK
            if skip >= 0:
                row, found = row[found != skip], found[found != skip]
            best, cosines = np.concatenate([best, found]), np.concatenate([cosines, sums[row]])
            top = np.lexsort((best, -cosines))[:k]
            best, cosines = best[top], cosines[top]
        return best, cosines

    def vote(self, numbers: np.ndarray, cosines: np.ndarray) -> float:
        """The share of toxic among the neighbours, weighed by distance and by what they stand
        for; the rate without evidence counts a little."""
        own = UNKNOWN * self.usual
        if not len(numbers):
            return self.rate
        weight = self.stands[numbers] / (NEAR + 1 - np.minimum(cosines, 1))
        return float((weight @ self.labels[numbers] + own * self.rate) / (weight.sum() + own))

    def calibrate(self, vectors: list[tuple[np.ndarray, np.ndarray]]) -> None:
        """The rate of toxic among examples without a term, and the curve by the votes that each
        example gets from the others. vectors are in the order of the examples' numbers."""
        n = len(vectors)
        total = self.stands.sum()
        self.usual = float(self.stands.mean()) if n else 1.0
        overall = (self.stands @ self.labels + 0.5 * total / max(n, 1)) / (total * (1 + 1 / n)) if n else 0.5
        bare = np.array([not len(at) for at, _ in vectors], bool)
        mass = self.stands[bare].sum()
        self.rate = float((self.stands[bare] @ self.labels[bare] + overall) / (mass + 1)) if bare.any() else float(overall)
        if n and 0 < self.labels.mean() < 1:
            votes = np.array([self.vote(*self.nearest(at, w, NEAREST, i)) for i, (at, w) in enumerate(vectors)])
            self.curve = logistic(logit(votes), self.labels, self.stands)

    def score(self, at: np.ndarray, w: np.ndarray) -> tuple[float, np.ndarray, np.ndarray]:
        numbers, cosines = self.nearest(at, w, NEAREST)
        a, b = self.curve
        return float(1 / (1 + np.exp(-(a * logit(self.vote(numbers, cosines)) + b)))), numbers, cosines


def logit(p):
    p = np.clip(p, 1e-6, 1 - 1e-6)
    return np.log(p / (1 - p))


def logistic(x: np.ndarray, y: np.ndarray, weight: np.ndarray) -> tuple[float, float]:
    """(a, b) of 1 / (1 + exp(-(a x + b))) by Newton steps, towards labels that are a little less
    sure than given, so that it is finite where votes tell them apart wholly. a isn't negative."""
    sure = {c: (weight[y == c].sum() / weight.mean() + 1) / (weight[y == c].sum() / weight.mean() + 2) for c in (0, 1)}
    goal = np.where(y == 1, sure[1], 1 - sure[0])
    z = np.stack([x, np.ones_like(x)], axis=1)
    theta, weight = np.array([1.0, 0.0]), weight / weight.mean()

    def loss(t):
        s = np.clip(z @ t, -500, 500)
        return float((weight * (np.logaddexp(0, s) - goal * s)).sum() + 1e-3 * t @ t)

    for _ in range(50):
        p = 1 / (1 + np.exp(-np.clip(z @ theta, -500, 500)))
        slope = z.T @ (weight * (p - goal)) + 2e-3 * theta
        curve = (z * (weight * p * (1 - p))[:, None]).T @ z + 2e-3 * np.eye(2)
        step, size, now = np.linalg.solve(curve, slope), 1.0, loss(theta)
        while size > 1e-4 and loss(theta - size * step) > now:
            size /= 2
        theta = theta - size * step
        if np.abs(size * step).max() < 1e-9:
            break
    return max(float(theta[0]), 0.0), float(theta[1])


def unlikelihood(with1: Column, with0: Column, n1: int, n0: int) -> Column:
    """The log-likelihood ratio of a term that with1 of n1 and with0 of n0 documents hold."""
    seen = lambda o, e: F.when(o > 0, o * F.log(o / e)).otherwise(0.0)
    both, n = with1 + with0, n1 + n0
    return 2 * (seen(with1, both * n1 / n) + seen(with0, both * n0 / n) + seen(n1 - with1, (n - both) * n1 / n) + seen(n0 - with0, (n - both) * n0 / n))


def fit(docs: DataFrame, labels: DataFrame, doc_id: str = "doc_id", text: str = "text", label: str = "toxic", most: int = LEARN_DOCS) -> Examples:
    """Learns from about `most` labelled documents of each class. labels must hold only rows to
    learn from; null ids, labels other than 0 and 1, and labels without a document take no part."""
    labels = labels.select(F.col(doc_id).alias("label_key"), F.col(label).cast("int").alias("label")).filter("label in (0, 1) and label_key is not null")
    n = {r["label"]: r["count"] for r in labels.groupBy("label").count().collect()}
    share = {c: min(1.0, most / n[c]) for c in n}
    part = F.pmod(F.xxhash64(F.lit(29), "label_key"), F.lit(1_000_000)) / 1_000_000
    for c, s in share.items():
        labels = labels.filter((F.col("label") != c) | (part < s))
    own = docs.select(F.col(f"`{doc_id}`").alias("own_key"), F.col(f"`{text}`").cast("string").alias("own_text"))
    picked = own.join(F.broadcast(labels), F.col("own_key") == F.col("label_key")).select("label_key", "label", "own_text")  # about 2 `most` rows of two numbers
    kind = dict(picked.dtypes)["label_key"]

    def terms(parts: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for part in parts:
            for row in part.to_pylist():
                held = counted(row["own_text"])
                yield pa.RecordBatch.from_pydict({"id": pa.array([row["label_key"]], part.schema.field("label_key").type), "label": pa.array([row["label"]], pa.int32()), "term": pa.array([list(held)], pa.list_(pa.string())), "times": pa.array([list(held.values())], pa.list_(pa.int64()))})

    held = saved(picked.mapInArrow(terms, f"id {kind}, label int, term array<string>, times array<bigint>"), "examples")
    taken = {r["label"]: r["count"] for r in held.groupBy("label").count().collect()}
    n1, n0 = taken.get(1, 0), taken.get(0, 0)
    counts = held.select("label", F.explode("term").alias("term")).groupBy("term").agg(F.sum("label").alias("with1"), F.sum(1 - F.col("label")).alias("with0"))
    telling = counts.withColumn("g", unlikelihood(F.col("with1"), F.col("with0"), n1, n0) if n1 and n0 else F.lit(0.0)).filter((F.col("g") >= UNLIKELY) & ((F.col("with1") + 0.5) / (n1 + 1) >= TIMES * (F.col("with0") + 0.5) / (n0 + 1)))
    kept = telling.orderBy(F.desc("g"), "term").limit(TERMS).collect()  # at most TERMS
    kept.sort(key=lambda r: r["term"])
    numbers = {r["term"]: i for i, r in enumerate(kept)}
    idf = np.log((1 + n1 + n0) / (1 + np.array([r["with1"] + r["with0"] for r in kept], float)))
    model = Examples(numbers, idf)
    names = held.sparkSession.sparkContext.broadcast(numbers)  # at most TERMS

    def among(parts: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        wanted = names.value
        for part in parts:
            rows = [[(wanted[t], c) for t, c in zip(r["term"], r["times"], strict=True) if t in wanted] for r in part.select(["term", "times"]).to_pylist()]
            yield pa.RecordBatch.from_arrays([part.column("id"), part.column("label"), pa.array([[t for t, _ in r] for r in rows], pa.list_(pa.int32())), pa.array([[c for _, c in r] for r in rows], pa.list_(pa.int64()))], names=["id", "label", "at", "times"])

    rows = held.mapInArrow(among, f"id {kind}, label int, at array<int>, times array<bigint>").collect()  # about 2 `most` rows of terms that were kept
    rows.sort(key=lambda r: (r["id"], r["label"], r["at"], r["times"]))
    vectors = [model.vector(dict(zip(r["at"], r["times"], strict=True))) for r in rows]
    given = np.array([r["label"] for r in rows], float)
    model.calibrate(model.index(vectors, [r["id"] for r in rows], given, np.array([1 / share[r["label"]] for r in rows])))
    return model


def scored(docs: DataFrame, model: Examples, text: str = "text", to: str = "toxicity") -> DataFrame:
    """docs with the struct `to`: score (0 to 1; higher means that label 1 is likelier) and
    evidence, the nearest examples: id, cosine, label.

    Null and empty texts, and texts without any term that was kept, have no evidence and the
    score of such examples. Other columns stay; one named `to` is replaced. An empty table stays
    empty. Where labels are of one class only, or none, all scores are alike."""
    shared = docs.sparkSession.sparkContext.broadcast(model)  # bounded by LEARN_DOCS and TERMS
    key = "long" if all(isinstance(i, int) for i in model.ids) else "string"
    kind = pa.int64() if key == "long" else pa.string()
    neighbour = pa.struct([("id", kind), ("cosine", pa.float64()), ("label", pa.int32())])

    @F.arrow_udf(f"score double, evidence array<struct<id: {key}, cosine: double, label: int>>")
    def score(parts: Iterator[pa.Array]) -> Iterator[pa.Array]:
        own = shared.value
        finder = Finder(own.numbers)
        ids, labels = pa.array([i if key == "long" else str(i) for i in own.ids], kind), own.labels.astype(np.int32)
        for texts in parts:
            scores, numbers, cosines, ends = np.zeros(len(texts)), [], [], [0]
            for nth, t in enumerate(texts):
                scores[nth], near, far = own.score(*own.vector(finder.counts(t.as_py())))
                numbers.append(near)
                cosines.append(far)
                ends.append(ends[-1] + len(near))
            at = np.concatenate([np.zeros(0, np.int64), *numbers])
            near = pa.StructArray.from_arrays([ids.take(pa.array(at)), pa.array(np.concatenate([np.zeros(0), *cosines])), pa.array(labels[at])], fields=list(neighbour))
            yield pa.StructArray.from_arrays([pa.array(scores), pa.ListArray.from_arrays(pa.array(ends, pa.int32()), near)], ["score", "evidence"])

    return docs.withColumn(to, score(docs[text].cast("string")))
