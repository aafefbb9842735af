"""Ranked lexical search: term-at-a-time for short lists, document-at-a-time over long ones.

Documents are read once: of each, its number of terms and how often it holds the terms that are
asked for. Counts over all documents give every term's weight. Then blocks of documents, spread
over tasks, are inverted: a term's list holds places of documents in rising order, each with
what the term adds to a score, and for every window of places the most that it adds there.

For an item the short lists of a block are summed term at a time: their accumulators, sorted by
place, are one more list, with its own bounds. That list and the long ones are then walked
together in document order. A window in which the bounds of all lists sum to no more than the
k-th best score so far is skipped. In others the lists with the lowest bounds are left out of
the choice of candidates as long as they can't lift a document into the best on their own; they
are looked up for candidates only, and a candidate goes once the bounds of what is left can't
lift it. So no document is lost, and each block's best are exact. The best of all blocks meet by
item, first in groups.
"""

from __future__ import annotations

import math
from collections import Counter
from collections.abc import Iterator
from dataclasses import dataclass

import numpy as np
import pandas as pd
import pyarrow as pa
import pyarrow.compute as pc
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from .shared import saved

#: Bytes that are no part of a term become blanks, A-Z become a-z. Bytes of other characters are
#: all 128 or more, so that this is the same as by characters.
FOLD = bytes(b + 32 if 65 <= b <= 90 else b if b >= 128 or chr(b).isalnum() else 32 for b in range(256))
#: Bytes of a text that are split at once.
PIECE = 1 << 20
#: Items that are asked in one pass over the documents.
ITEMS = 5_000
#: Documents, and postings, of a block; places of a window; a list is short with no more than
#: one posting for so many documents of its block.
DOCUMENTS, POSTINGS = 65_536, 6_000_000
WINDOW = 2_048
SHORT = 64
#: Groups in which the best of blocks meet first.
GROUPS = 64


def pieces(text: str) -> Iterator[list[bytes]]:
    """The terms of a text, in parts of bounded size (a term is whole)."""
    raw = text.encode("utf-8", "surrogatepass").translate(FOLD)
    at = 0
    while at < len(raw):
        end = raw.find(b" ", at + PIECE)
        end = len(raw) if end < 0 else end
        yield raw[at:end].split()
        at = end


def counted(text: str | None) -> Counter:
    counts: Counter = Counter()
    for terms in pieces(text or ""):
        counts.update(terms)
    return counts


@dataclass
class Statistics:
    """N, L and the weight of each term that is asked for, by its number."""

    documents: int
    length: int
    weights: np.ndarray

    def norms(self, n: list[int]) -> list[int]:
        """m of documents of n terms, in whole numbers of any size."""
        return [50 + (50 * x * self.documents) // self.length for x in n]


def weight(documents: int, holding: int) -> int:
    return math.floor(1000 * math.log((2 * documents + 2) / (2 * holding + 1)))


class Lists:
    """The inverted lists of a block of documents, in ascending order of document."""

    def __init__(self, terms: np.ndarray, places: np.ndarray, adds: np.ndarray, documents: int):
        keep = adds > 0  # what adds nothing can't give a rank
        terms, places, adds = terms[keep], places[keep], adds[keep]
        order = np.lexsort((places, terms))
        terms, self.places, self.adds = terms[order], places[order], adds[order]
        self.documents, self.windows = documents, -(-documents // WINDOW)
        names, starts = np.unique(terms, return_index=True)
        ends = np.append(starts[1:], len(terms))
        self.ranges = dict(zip(names.tolist(), zip(starts.tolist(), ends.tolist(), strict=True), strict=True))
        self.bounds = {t: bounds(self.places[a:b], self.adds[a:b], self.windows) for t, (a, b) in self.ranges.items() if self.long(b - a)}

    def long(self, n: int) -> bool:
        return n * SHORT > self.documents

    def best(self, terms: list[int], k: int) -> tuple[np.ndarray, np.ndarray]:
        """(places, scores) of the k highest scores above 0, equal ones by place."""
        found = [(t, *self.ranges[t]) for t in terms if t in self.ranges]
        short = [(a, b) for _, a, b in found if not self.long(b - a)]
        lists = [(self.places[a:b], self.adds[a:b], *self.bounds[t]) for t, a, b in found if self.long(b - a)]
        if short:
            places, at = np.unique(np.concatenate([self.places[a:b] for a, b in short]), return_inverse=True)
            # Sums of longs in doubles would lose digits beyond 2^53, so they are added as longs.
            sums = np.zeros(len(places), np.int64)
            np.add.at(sums, at, np.concatenate([self.adds[a:b] for a, b in short]))
            lists.append((places, sums, *bounds(places, sums, self.windows)))
        return walk(lists, self.windows, k)


def bounds(places: np.ndarray, adds: np.ndarray, windows: int) -> tuple[np.ndarray, np.ndarray]:
    """(where each window's postings begin, the most that one of them adds)."""
    starts = np.searchsorted(places, np.arange(windows + 1) * WINDOW)
    most = np.zeros(windows, np.int64)
    some = starts[:-1] < starts[1:]
    if some.any():
        most[some] = np.maximum.reduceat(adds, starts[:-1][some])
    return starts, most


def walk(lists: list[tuple], windows: int, k: int) -> tuple[np.ndarray, np.ndarray]:
    """The k best of lists (places, adds, starts, most) in document order."""
    top_places, top_scores, least = np.zeros(0, np.int64), np.zeros(0, np.int64), 0
    if not lists:
        return top_places, top_scores
    limit = np.stack([most for *_, most in lists])
    together = limit.sum(axis=0)
    scores = np.zeros(WINDOW, np.int64)
    for w in range(windows):
        if together[w] <= least:
            continue
        order = np.argsort(limit[:, w], kind="stable")
        upto = np.cumsum(limit[order, w])  # of the lists up to each, lowest bounds first
        optional = int(np.searchsorted(upto, least, side="right"))
        scores[:] = 0
        for i in order[optional:]:
            places, adds, starts, _ = lists[i]
            a, b = starts[w], starts[w + 1]
            scores[places[a:b] - w * WINDOW] += adds[a:b]  # a list holds a place once
        alive = np.flatnonzero(scores)
        for j in range(optional - 1, -1, -1):
            alive = alive[scores[alive] + upto[j] > least]
            if not len(alive):
                break
            places, adds, starts, _ = lists[order[j]]
            a, b = starts[w], starts[w + 1]
            if a < b:
                at = np.minimum(a + np.searchsorted(places[a:b], alive + w * WINDOW), b - 1)
                scores[alive] += np.where(places[at] == alive + w * WINDOW, adds[at], 0)
        alive = alive[scores[alive] > least]
        if len(alive):
            top_places, top_scores = np.concatenate([top_places, alive + w * WINDOW]), np.concatenate([top_scores, scores[alive]])
            if len(top_scores) > k:
                kept = np.lexsort((top_places, -top_scores))[:k]
                top_places, top_scores = top_places[kept], top_scores[kept]
            if len(top_scores) == k:
                least = int(top_scores.min())
    order = np.lexsort((top_places, -top_scores))
    return top_places[order], top_scores[order]


def asked(items: DataFrame, item_id: str, text: str, part: int, parts: int) -> tuple[list, dict[bytes, int]]:
    """([(id, numbers of its terms)], {term: number}) of one part of the distinct items."""
    rows = items.select(F.col(f"`{item_id}`").alias("id"), F.col(f"`{text}`").cast("string").alias("t")).distinct()
    rows = rows.filter(F.pmod(F.xxhash64("id", "t"), F.lit(parts)) == part).collect()  # about ITEMS
    numbers: dict[bytes, int] = {}
    out = [(r["id"], [numbers.setdefault(t, len(numbers)) for t in counted(r["t"])]) for r in rows]
    return [x for x in out if x[1]], numbers


def forward(documents: DataFrame, numbers: dict[bytes, int], doc_id: str, text: str) -> DataFrame:
    """A row for each document with a term: key, n (its terms), terms (those asked for, by
    number) and times (how often it holds each)."""
    shared = documents.sparkSession.sparkContext.broadcast(numbers)  # terms of about ITEMS items
    own = documents.select(F.col(f"`{doc_id}`").alias("key"), F.col(f"`{text}`").cast("string").alias("t"))
    kind = dict(own.dtypes)["key"]

    def scan(parts: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        wanted = shared.value
        names = wanted.keys()
        for part in parts:
            for lo in range(0, part.num_rows, 1_000):
                some = part.slice(lo, 1_000)
                n, terms, times = [], [], []
                for t in some.column("t"):
                    counts = counted(t.as_py())
                    held = sorted((wanted[x], counts[x]) for x in names & counts.keys())
                    n.append(counts.total())
                    terms.append([a for a, _ in held])
                    times.append([b for _, b in held])
                made = pa.RecordBatch.from_arrays([some.column("key"), pa.array(n, pa.int64()), pa.array(terms, pa.list_(pa.int32())), pa.array(times, pa.list_(pa.int64()))], names=["key", "n", "terms", "times"])
                yield made.filter(pa.array([x > 0 for x in n]))

    return own.mapInArrow(scan, f"key {kind}, n long, terms array<int>, times array<bigint>")


def statistics(rows: DataFrame, terms: int) -> Statistics:
    total = rows.agg(F.count("*").alias("n"), F.sum("n").alias("l")).first()
    holding = rows.select(F.explode("terms").alias("term")).groupBy("term").count().collect()  # terms of about ITEMS items
    weights = np.zeros(terms, np.int64)
    for r in holding:
        weights[r["term"]] = weight(total["n"], r["count"])
    return Statistics(total["n"], total["l"] or 0, weights)


def inverted(tables: list[pa.Table], stats: Statistics) -> tuple[pa.Array, Lists]:
    """(keys, lists) of one block: places are those of its keys in ascending order, null last."""
    rows = pa.concat_tables(tables).combine_chunks()
    rows = rows.take(pc.sort_indices(rows, sort_keys=[("key", "ascending")], null_placement="at_end"))
    lengths = pc.list_value_length(rows.column("terms")).to_numpy()
    flat = lambda c: rows.column(c).combine_chunks().flatten().to_numpy()
    places, terms, times = np.repeat(np.arange(len(lengths)), lengths), flat("terms"), flat("times")
    norm = np.repeat(np.array(stats.norms(rows.column("n").to_pylist()), np.int64), lengths)
    adds = stats.weights[terms] * ((1_000_000_000 * times) // (1_000 * times + 20 * norm))
    return rows.column("key").combine_chunks(), Lists(terms, places, adds, len(lengths))


def ranked(documents: DataFrame, items: DataFrame, k: int = 50, doc_id: str = "doc_id", item_id: str = "item_id", text: str = "text") -> DataFrame:
    """Each item's k best documents: item_id, rank (from 1), doc_id, score; fewer where fewer have
    a score above 0.

    Null and empty texts have no terms: such documents count nowhere, such items have no ranks.
    Repeated rows of documents are documents of their own; equal scores rank by doc_id, null
    last. Equal items count once; different texts of one item_id have ranks of their own. Items
    are asked in parts of about ITEMS, each of which reads the documents again. Other columns are
    ignored; without documents or items there are no rows."""
    parts = max(1, -(-items.count() // ITEMS))
    out = None
    for part in range(parts):
        found = _ranked(documents, *asked(items, item_id, text, part, parts), k, doc_id, text, items, item_id)
        out = found if out is None else out.unionAll(found)
    return out


def _ranked(documents: DataFrame, wanted: list, numbers: dict[bytes, int], k: int, doc_id: str, text: str, items: DataFrame, item_id: str) -> DataFrame:
    spark = documents.sparkSession
    rows = saved(forward(documents, numbers, doc_id, text), "forward")
    stats = statistics(rows, len(numbers))
    shared = spark.sparkContext.broadcast((wanted, stats))  # terms of about ITEMS items
    key, of = dict(rows.dtypes)["key"], dict(items.dtypes)[item_id]

    def search(tables: list[pa.Table]) -> Iterator[pa.RecordBatch]:
        asked_for, known = shared.value
        keys, lists = inverted(tables, known)
        for nth, (_, terms) in enumerate(asked_for):
            places, scores = lists.best(terms, k)
            if len(places):
                yield pa.RecordBatch.from_arrays([pa.array(np.full(len(places), nth)), keys.take(pa.array(places)), pa.array(scores)], names=["nth", "key", "score"])

    def blocks(parts: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        held: list[pa.Table] = []
        size = postings = 0
        for part in parts:
            for lo in range(0, part.num_rows, 4_096):
                some = part.slice(lo, 4_096)
                held.append(pa.Table.from_batches([some]))
                size, postings = size + some.num_rows, postings + len(some.column("terms").flatten())
                if size >= DOCUMENTS or postings >= POSTINGS:
                    yield from search(held)
                    held, size, postings = [], 0, 0
        if held:
            yield from search(held)

    best = rows.mapInArrow(blocks, f"nth long, key {key}, score long").withColumn("grp", F.pmod(F.spark_partition_id(), F.lit(GROUPS)))
    order = [F.desc("score"), F.asc_nulls_last("key")]
    for by in (["nth", "grp"], ["nth"]):
        best = best.withColumn("rank", F.row_number().over(Window.partitionBy(*by).orderBy(*order))).filter(F.col("rank") <= k)
    names = spark.createDataFrame(pd.DataFrame({"nth": range(len(wanted)), "id": pd.Series([i for i, _ in wanted], dtype=object)}), f"nth long, id {of}")
    return best.join(F.broadcast(names), "nth").select(F.col("id").alias(item_id), "rank", F.col("key").alias(doc_id), "score")  # ids of about ITEMS items
