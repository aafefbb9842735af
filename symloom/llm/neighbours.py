"""Approximate nearest neighbours by collision counting.

Each vector has one number per random projection. In a block of vectors every projection is a
sorted array. A query opens a window around its own number in each array, and virtual
rehashing widens all windows step by step, along one ladder of radii for all blocks; a vector
that lies in the windows of enough projections (the collision threshold) is verified by its
exact distance. A query is done at the step at which k verified distances are no more than the
radius that the windows stand for: nearer vectors would have collided by then, with the
probability that the threshold sets. There is no limit on how many vectors are verified.

Blocks of vectors are spread over tasks, and each meets the queries in blocks of bounded size.
A block goes on until it has k such distances of its own, which is never before the step at
which all blocks together have them; the merge then takes what had collided up to that step. So
blocks and their number don't change the result.
"""

from __future__ import annotations

import math
from bisect import insort

import numpy as np
import pandas as pd
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

#: Projections, window width at radius 1, growth of the radius, and the share of projections
#: in which a vector must collide. At a distance equal to the radius a projection collides
#: with probability 2 * Phi(width / 2) - 1 = 0.80; the threshold of 0.62 is missed by a
#: vector at that distance with a probability of about 1.5 %.
PROJECTIONS = 32
WIDTH = 2.56
GROWTH = 1.2
THRESHOLD = 0.62
#: Queries, and vectors, that meet in one task.
QUERY_BLOCK = 8_192
VECTOR_BLOCK = 16_384
#: Vectors from whose distances the first radius is taken (a later start is more verification).
FIRST = 512
#: Projections are of vectors times this, so that none overflows; a power of two changes no digits.
SCALE = 2.0**-12


def usable(vectors: DataFrame, key: str, vector: str) -> DataFrame:
    """(id, vec): without null keys and without vectors that are null, all zero, or hold null
    or non-finite components."""
    v = F.col(f"`{vector}`").cast("array<double>")
    bad = F.exists(v, lambda x: x.isNull() | F.isnan(x) | (F.abs(x) == float("inf")))
    ok = v.isNotNull() & ~F.coalesce(bad, F.lit(True)) & F.exists(v, lambda x: x != 0)
    return vectors.filter(ok & F.col(f"`{key}`").isNotNull()).select(F.col(f"`{key}`").cast("long").alias("id"), v.alias("vec"))


def largest(vectors: np.ndarray) -> np.ndarray:
    """The largest component of each vector, without its sign."""
    return np.maximum(vectors.max(axis=1, initial=0), -vectors.min(axis=1, initial=0))


def distances(vectors: np.ndarray, x: np.ndarray, most: np.ndarray | None = None) -> np.ndarray:
    """Euclidean distances of each of vectors (with their largest components) to x. Squares that
    would overflow or vanish are taken of rows times a power of two."""
    most = np.maximum(largest(vectors) if most is None else most, np.abs(x).max(initial=0))
    odd = (most > 1e140) | (most < 1e-140)
    with np.errstate(over="ignore", under="ignore"):
        found = np.sqrt(((vectors - x) ** 2).sum(axis=1))
        for i in np.flatnonzero(odd):
            shift = int(np.frexp(most[i])[1]) + 1
            d = np.ldexp(vectors[i], -shift) - np.ldexp(x, -shift)
            found[i] = np.ldexp(np.sqrt((d * d).sum()), shift)
    return found


def step_of(radius: np.ndarray | float) -> np.ndarray:
    """The first step of the ladder whose radius is no less (long; a zero is at the lowest step)."""
    with np.errstate(divide="ignore", over="ignore"):
        at = np.ceil(np.log(radius) / math.log(GROWTH) - 1e-9)
    return np.clip(at, -4_100, 4_100).astype(np.int64)


def radius_of(step: int) -> float:
    with np.errstate(over="ignore"):
        return float(np.exp(np.float64(step) * math.log(GROWTH)))


class Block:
    """The sorted arrays of a block's projections."""

    def __init__(self, ids: np.ndarray, vectors: np.ndarray, seed: int):
        self.ids, self.vectors, self.largest = ids, vectors, largest(vectors)
        self.directions = np.random.default_rng(seed).standard_normal((vectors.shape[1], PROJECTIONS))
        places = (vectors * SCALE) @ self.directions
        order = np.argsort(places, axis=0, kind="stable")
        self.sorted = np.take_along_axis(places, order, axis=0).T.copy()
        self.order = order.T.astype(np.int32)

    def search(self, query_id: int, query: np.ndarray, k: int, first: int) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
        """(ids, distances, steps) of those verified that can be among the k nearest at some
        step; the windows begin at the step `first`."""
        n = len(self.ids)
        at = (query * SCALE) @ self.directions
        need = math.ceil(THRESHOLD * PROJECTIONS)
        count = np.zeros(n, np.int64)
        own = self.ids == query_id
        lo = np.array([np.searchsorted(s, x) for s, x in zip(self.sorted, at, strict=True)])
        hi = lo.copy()
        checked = own.copy()
        found: list[np.ndarray] = []
        far: list[np.ndarray] = []
        steps: list[np.ndarray] = []
        left, step, within = n - int(own.sum()), first, 0
        counts_at: list[np.ndarray] = []
        while left:
            half = WIDTH * radius_of(step) / 2 * SCALE
            rings = []
            for j in range(PROJECTIONS):
                a = np.searchsorted(self.sorted[j, : lo[j]], at[j] - half)
                b = hi[j] + np.searchsorted(self.sorted[j, hi[j] :], at[j] + half, side="right")
                rings += [ring for ring in (self.order[j, a : lo[j]], self.order[j, hi[j] : b]) if len(ring)]
                lo[j], hi[j] = a, b
            if rings:
                touched = np.concatenate(rings)
                if len(touched) < n:  # the work follows what the rings hold, or the block: whichever is less
                    np.add.at(count, touched, 1)
                    new = np.unique(touched[(count[touched] >= need) & ~checked[touched]])
                else:
                    count += np.bincount(touched, minlength=n)
                    new = np.flatnonzero((count >= need) & ~checked)
                checked[new] = True
                left -= len(new)
                d = distances(self.vectors[new], query, self.largest[new])
                found.append(new)
                far.append(d)
                steps.append(np.full(len(new), step))
                counts_at.append(np.maximum(step_of(d), step))
            within = sum(int((c <= step).sum()) for c in counts_at)
            if within >= k:
                break
            # The next step at which a window gets another vector, or a verified one is within.
            gaps = [g for j in range(PROJECTIONS) for g in ((at[j] - self.sorted[j, lo[j] - 1] if lo[j] else np.inf), (self.sorted[j, hi[j]] - at[j] if hi[j] < n else np.inf))]
            waiting = min((int(c[c > step].min()) for c in counts_at if (c > step).any()), default=5_000)
            step = max(step + 1, min(waiting, int(step_of(2 * min(gaps) / WIDTH / SCALE)) if np.isfinite(min(gaps)) else 5_000))
        if not found:
            return np.zeros(0, np.int64), np.zeros(0), np.zeros(0, np.int64)
        rows, d, at_step = np.concatenate(found), np.concatenate(far), np.concatenate(steps)
        order = np.lexsort((self.ids[rows], d))
        rows, d, at_step = rows[order], d[order], at_step[order]
        # One is of use if fewer than k nearer ones have collided by its own step.
        keep, sooner, soonest = [], [], int(at_step.min())
        for i, s in enumerate(at_step.tolist()):
            if len(sooner) >= k and sooner[k - 1] == soonest:
                break
            if len(sooner) < k or s < sooner[k - 1]:
                keep.append(i)
                insort(sooner, s)
        return self.ids[rows[keep]], d[keep], at_step[keep]


def first_step(sample: np.ndarray, k: int) -> int:
    """A step that few queries are done before: of the distances to the k-th neighbour within a
    sample, a low quantile. All blocks begin there."""
    if len(sample) < 2:
        return 0
    near = np.array([np.partition(distances(sample, x), min(k, len(sample) - 1))[min(k, len(sample) - 1)] for x in sample[::8]])
    near = near[(near > 0) & np.isfinite(near)]
    return int(step_of(float(np.quantile(near, 0.1)) / 2)) if len(near) else 0


def nearest(vectors: DataFrame, queries: DataFrame, k: int = 10, key: str = "vec_id", vector: str = "embedding", seed: int = 3) -> DataFrame:
    """Each query's k nearest found among vectors, its own key excepted: query_id, rank (from
    1), vec_id, score (Euclidean distance in double precision). Fewer vectors: all of them.

    Vectors and queries that are null, all zero or hold null or non-finite components take no
    part, nor do null keys. Vectors only meet queries of their own length. Of equal distances
    the smaller key is nearer. Rows with the same key and vector count once; queries with the
    same key and different vectors each have their ranks. A distance beyond the largest double
    is infinite. Other columns are ignored; without queries or vectors there are no rows."""
    base, asked = usable(vectors, key, vector).dropDuplicates(), usable(queries, key, vector).dropDuplicates()
    counts = [x.groupBy(F.size("vec").alias("dim")).count().agg(F.max("count")).first()[0] or 0 for x in (base, asked)]
    n_blocks, n_query_blocks = (max(1, -(-c // size)) for c, size in zip(counts, (VECTOR_BLOCK, QUERY_BLOCK), strict=True))
    sample = base.orderBy(F.xxhash64(F.lit(seed), "id", "vec")).limit(FIRST).collect()  # at most FIRST vectors
    alike = [r["vec"] for r in sample if len(r["vec"]) == len(sample[0]["vec"])]
    first = first_step(np.array(alike), k) if alike else 0
    part = lambda n: F.pmod(F.xxhash64("id"), F.lit(n)).cast("int")
    base = base.select("id", "vec", F.size("vec").alias("dim"), part(n_blocks).alias("block"), F.explode(F.sequence(F.lit(0), F.lit(n_query_blocks - 1))).alias("query_block"))
    asked = asked.select("id", "vec", F.xxhash64("vec").alias("of"), F.size("vec").alias("dim"), part(n_query_blocks).alias("query_block"), F.explode(F.sequence(F.lit(0), F.lit(n_blocks - 1))).alias("block"))
    both = ["dim", "block", "query_block"]

    def search(left: pd.DataFrame, right: pd.DataFrame) -> pd.DataFrame:
        out = []
        if len(left) and len(right):
            block = Block(left["id"].to_numpy(), np.stack(left["vec"].to_numpy()), seed)
            for i, of, v in zip(right["id"], right["of"], right["vec"], strict=True):
                ids, d, steps = block.search(i, v, k, first)
                out.append(pd.DataFrame({"query_id": i, "of": of, "vec_id": ids, "score": d, "step": steps, "counts": np.maximum(steps, step_of(d))}))
        return pd.concat(out) if out else pd.DataFrame({c: [] for c in ("query_id", "of", "vec_id", "score", "step", "counts")})

    found = base.groupBy(*both).cogroup(asked.groupBy(*both)).applyInPandas(search, "query_id long, of long, vec_id long, score double, step long, counts long")
    query = Window.partitionBy("query_id", "of")
    nth = found.withColumn("nth", F.row_number().over(query.orderBy("counts", "score", "vec_id")))
    done = nth.withColumn("done", F.min(F.when(F.col("nth") == k, F.col("counts"))).over(query)).filter("done is null or step <= done")
    return done.withColumn("rank", F.row_number().over(query.orderBy("score", "vec_id"))).filter(F.col("rank") <= k).select("query_id", "rank", "vec_id", "score")
