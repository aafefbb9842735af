"""Embedding whitening by a pivoted Cholesky factor and one-sided Jacobi rotations.

Entries become whole numbers, x = floor(64 c) + 1,000,000, and every distinct x vector counts
once (the fit list). Tasks add up the products of centred vectors; their sums meet in two rounds,
a row of the matrix at a time. On the driver, which only ever holds such a matrix, the scatter is
factored as G G' with diagonal pivots, and rotations of pairs of columns make the columns of G
orthogonal. Their squared norms are then the eigenvalues, and the normalised columns the
components. The product G'G is never formed anew, so small eigenvalues keep their digits.
"""

from __future__ import annotations

from collections.abc import Iterator
from dataclasses import dataclass
from decimal import Decimal

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
from pyspark import TaskContext
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .shared import saved

#: Components that are returned.
COMPONENTS = 16
#: x stays within these bounds, so that it is a long whatever the entry.
BOUND = 2.0**61
STEP, SHIFT = 64.0, 1_000_000
#: Vectors that are multiplied at once, and groups in which the matrices of tasks are first added.
BATCH, GROUPS = 8_192, 64
SWEEPS = 60


def usable(vectors: DataFrame, vector: str) -> DataFrame:
    """Rows whose vector isn't null and has entries, none of which is null or not finite."""
    v = F.col(f"`{vector}`").cast("array<double>")
    bad = F.exists(v, lambda x: x.isNull() | F.isnan(x) | (F.abs(x) == float("inf")))
    return vectors.filter(v.isNotNull() & (F.size(v) > 0) & ~F.coalesce(bad, F.lit(True)))


def whole(values: np.ndarray) -> np.ndarray:
    """x of double entries."""
    with np.errstate(over="ignore"):
        return np.clip(np.floor(STEP * values), -BOUND, BOUND).astype(np.int64) + SHIFT


def pivoted_cholesky(a: np.ndarray) -> np.ndarray:
    """G (d x rank) with G G' = a, the largest remaining diagonal entry first. It ends where that
    is no more than rounding of the first."""
    d = len(a)
    left, g, first = a.diagonal().copy(), np.zeros((d, d)), float(a.diagonal().max(initial=0))
    for k in range(d):
        p = int(left.argmax())
        if left[p] <= d * np.finfo(float).eps * first or left[p] <= 0:
            return g[:, :k]
        column = (a[:, p] - g[:, :k] @ g[p, :k]) / np.sqrt(left[p])
        column[left < 0] = 0  # rows that were pivots before
        column[p] = np.sqrt(left[p])
        g[:, k] = column
        left -= column * column
        left[p] = -np.inf
    return g


def orthogonal_columns(g: np.ndarray) -> np.ndarray:
    """g times rotations of pairs of columns, until all columns are orthogonal. Pairs without a
    common column are rotated at once, in the order of a round-robin."""
    g = np.array(g, dtype=float)
    if g.shape[1] < 2:
        return g
    if odd := g.shape[1] % 2:
        g = np.hstack([g, np.zeros((len(g), 1))])
    m = g.shape[1]
    ring, tiny = np.arange(m), 2 * np.sqrt(len(g)) * np.finfo(float).eps
    for _ in range(SWEEPS):
        turned = False
        for _ in range(m - 1):
            i, j = ring[: m // 2], ring[: m // 2 - 1 : -1]
            p, q = g[:, i], g[:, j]
            a, b, c = (p * p).sum(axis=0), (q * q).sum(axis=0), (p * q).sum(axis=0)
            turn = np.abs(c) > tiny * np.sqrt(a * b)
            if turn.any():
                turned = True
                i, j, p, q = i[turn], j[turn], p[:, turn], q[:, turn]
                zeta = (b[turn] - a[turn]) / (2 * c[turn])
                t = np.where(zeta < 0, -1.0, 1.0) / (np.abs(zeta) + np.hypot(1, zeta))
                cos = 1 / np.sqrt(1 + t * t)
                g[:, i], g[:, j] = cos * p - cos * t * q, cos * t * p + cos * q
            ring = np.concatenate([ring[:1], ring[-1:], ring[1:-1]])
        if not turned:
            break
    return g[:, np.sort(np.argsort(-(g * g).sum(axis=0), kind="stable")[: m - odd])] if odd else g


@dataclass
class Whitening:
    """Of vectors of one length: n and exact sums of the fit list, eigenvalues from the largest,
    unit components as columns (the entry of largest size is positive) and the trace of the
    covariance."""

    n: int
    sums: list[int]
    values: np.ndarray
    components: np.ndarray
    trace: float
    identity_error: float = 0.0

    @staticmethod
    def of(n: int, sums: list[int], scatter: np.ndarray) -> Whitening:
        g = orthogonal_columns(pivoted_cholesky(scatter))
        norms = (g * g).sum(axis=0)
        order = np.argsort(-norms, kind="stable")
        order = order[norms[order] > 0]
        unit = g[:, order] / np.sqrt(norms[order])
        unit = unit * np.sign(unit[np.abs(unit).argmax(axis=0), np.arange(len(order))]) if len(order) else unit
        return Whitening(n, sums, norms[order] / n, unit, float(np.trace(scatter)) / n)

    def centred(self, x: np.ndarray) -> np.ndarray:
        """x - S / n. The whole part of the mean is taken off before the numbers become doubles."""
        mean = [divmod(s, self.n) for s in self.sums]
        return (x - np.array([m for m, _ in mean])).astype(float) - np.array([r / self.n for _, r in mean])

    def whitened(self, x: np.ndarray, most: int) -> np.ndarray:
        return self.centred(x) @ (self.components[:, :most] / np.sqrt(self.values[:most]))

    def deviations(self, x: np.ndarray) -> list[int | None]:
        """Sum of (n x - S)^2, exactly; null where that is no long."""
        sums = np.array(self.sums, dtype=object)
        reach = max([abs(int(x.max(initial=0))), abs(int(x.min(initial=0)))]) * self.n + max(map(abs, self.sums))
        if reach * reach * len(self.sums) < 2**63:
            off = self.n * x - sums.astype(np.int64)
            return (off * off).sum(axis=1).tolist()
        exact = [sum(v * v for v in row) for row in self.n * x.astype(object) - sums]
        return [v if v < 2**63 else None for v in exact]


def matrix_of(column: pa.Array) -> np.ndarray:
    """A list column whose lists all have one length, as a matrix."""
    flat = column.flatten().to_numpy(zero_copy_only=False)
    return flat.reshape(len(column), -1) if len(column) else flat.reshape(0, 0)


def by_length(batch: pa.RecordBatch, column: str) -> Iterator[tuple[int, pa.RecordBatch]]:
    """(length, rows) of a batch, apart by the length of a list column."""
    lengths = pc.list_value_length(batch.column(column)).to_numpy(zero_copy_only=False)
    for d in np.unique(lengths).tolist():
        yield d, batch if (lengths == d).all() else batch.filter(pa.array(lengths == d))


def summed(rows: DataFrame, models: dict[int, Whitening], measure, width) -> dict[int, np.ndarray]:
    """For each length the sum over rows (x) of a matrix: measure(model, x) has as many rows as
    the result. Tasks add up what they hold; the sums of tasks meet by rows of the matrix, first
    within groups of tasks."""
    shared = rows.sparkSession.sparkContext.broadcast(models)  # a mean or a model for each length of vectors

    def partial(parts: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        total: dict[int, np.ndarray] = {}
        for part in parts:
            for d, own in by_length(part, "x"):
                for lo in range(0, own.num_rows, BATCH):
                    made = measure(shared.value[d], matrix_of(own.column("x").slice(lo, BATCH)))
                    total[d] = total[d] + made if d in total else made
        for d, m in total.items():
            group = TaskContext.get().partitionId() % GROUPS
            yield pa.RecordBatch.from_arrays([pa.array([d] * len(m), pa.int32()), pa.array([group] * len(m), pa.int32()), pa.array(range(len(m)), pa.int32()), pa.array(list(m), pa.list_(pa.float64()))], names=["d", "grp", "i", "v"])

    def add(table: pa.Table) -> pa.Table:
        v = matrix_of(table.column("v").combine_chunks()).sum(axis=0)
        return pa.table({"d": table.column("d")[:1], "grp": pa.array([0], pa.int32()), "i": table.column("i")[:1], "v": pa.array([v], pa.list_(pa.float64()))})

    schema = "d int, grp int, i int, v array<double>"
    parts = rows.mapInArrow(partial, schema)
    parts = parts.groupBy("d", "grp", "i").applyInArrow(add, schema).groupBy("d", "i").applyInArrow(add, schema)
    out = {d: np.zeros((width(m), width(m))) for d, m in models.items()}
    for r in parts.toLocalIterator():  # a row of a matrix at a time
        out[r["d"]][r["i"]] = r["v"]
    return out


def fit_list(vectors: DataFrame, vector: str) -> DataFrame:
    """(x), each distinct x vector once, written to the shared folder."""

    @F.arrow_udf("array<bigint>")
    def to_whole(parts: Iterator[pa.Array]) -> Iterator[pa.Array]:
        for part in parts:
            flat = part.flatten().to_numpy(zero_copy_only=False)
            yield pa.ListArray.from_arrays(part.offsets if part.offset == 0 else pa.array(np.asarray(part.offsets) - part.offsets[0].as_py(), pa.int32()), pa.array(whole(flat)))

    v = F.col(f"`{vector}`").cast("array<double>")
    return saved(usable(vectors, vector).select(to_whole(v).alias("x")).distinct(), "fit-list")


def totals(rows: DataFrame) -> DataFrame:
    """(d, i, n, s): of the vectors x of length d their number, and the exact sum of entry i."""

    def partial(parts: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        n: dict[int, int] = {}
        upper: dict[int, np.ndarray] = {}
        lower: dict[int, np.ndarray] = {}
        for part in parts:
            for d, own in by_length(part, "x"):
                x = matrix_of(own.column("x"))
                n[d] = n.get(d, 0) + len(x)
                # Halves of 32 bits, whose sums within a task stay longs.
                upper[d] = upper.get(d, 0) + (x >> 32).sum(axis=0)
                lower[d] = lower.get(d, 0) + (x & 0xFFFFFFFF).sum(axis=0)
        for d in n:
            s = [Decimal((u << 32) + v) for u, v in zip(upper[d].tolist(), lower[d].tolist(), strict=True)]
            yield pa.RecordBatch.from_arrays([pa.array([d] * d, pa.int32()), pa.array(range(d), pa.int32()), pa.array([n[d]] * d, pa.int64()), pa.array(s, pa.decimal128(38, 0))], names=["d", "i", "n", "s"])

    return rows.mapInArrow(partial, "d int, i int, n long, s decimal(38,0)").groupBy("d", "i").agg(F.sum("n").alias("n"), F.sum("s").alias("s"))


def fit(vectors: DataFrame, vector: str = "embedding", most: int = COMPONENTS) -> dict[int, Whitening]:
    """A whitening for each length of vectors.

    The fit list is read three times: for n and the sums, for the products of centred vectors,
    and for the covariance of what is whitened, from which identity_error comes."""
    rows = fit_list(vectors, vector)
    counts: dict[int, int] = {}
    sums: dict[int, list[int]] = {}
    for r in totals(rows).toLocalIterator():  # d sums for each length
        counts[r["d"]] = int(r["n"])
        sums.setdefault(r["d"], [0] * r["d"])[r["i"]] = int(r["s"])
    means = {d: Whitening(n, sums[d], np.zeros(0), np.zeros((d, 0)), 0.0) for d, n in counts.items()}

    def products(model: Whitening, x: np.ndarray) -> np.ndarray:
        c = model.centred(x)
        return c.T @ c

    def covariance(model: Whitening, x: np.ndarray) -> np.ndarray:
        y = model.whitened(x, most)
        return y.T @ y / model.n

    scatter = summed(rows, means, products, lambda m: len(m.sums))
    models = {d: Whitening.of(counts[d], sums[d], scatter[d]) for d in counts}
    used = {d: m for d, m in models.items() if len(m.values)}
    check = summed(rows.filter(F.size("x").isin(*used)), used, covariance, lambda m: min(most, len(m.values))) if used else {}
    for d, c in check.items():
        models[d].identity_error = float(np.abs(c - np.eye(len(c))).max())
    return models


def whitened(vectors: DataFrame, models: dict[int, Whitening], key: str = "vec_id", vector: str = "embedding", most: int = COMPONENTS) -> DataFrame:
    """A row for each usable vector and component (from 1, by falling eigenvalue): key, component,
    n, deviation, whitened, explained, identity_error.

    Vectors that are null, empty or hold null or non-finite entries have no rows; repeated rows
    and null keys each have theirs. Vectors of each length are whitened apart. There are as many
    components as the fit list has dimensions in which it differs, at most `most`; a single
    vector has none, so no rows. Entries beyond 2^55 stand for that bound; a deviation that is
    no long is null. Equal eigenvalues leave their components free within their span. Other
    columns are ignored; an empty table gives no rows."""
    shared = vectors.sparkSession.sparkContext.broadcast(models)  # a model for each length of vectors
    rows = usable(vectors, vector).select(F.col(f"`{key}`").alias("key"), F.col(f"`{vector}`").cast("array<double>").alias("v"))
    kind = dict(rows.dtypes)["key"]

    def project(parts: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for part in parts:
            for d, own in by_length(part, "v"):
                model = shared.value.get(d)
                if model is None or not len(model.values):
                    continue
                for lo in range(0, own.num_rows, BATCH):
                    some = own.slice(lo, BATCH)
                    x = whole(matrix_of(some.column("v")))
                    y = model.whitened(x, most)
                    r, m = y.shape
                    share = (model.values[:m] / model.trace) if model.trace else np.zeros(m)
                    each = pa.array(np.repeat(np.arange(r), m))
                    yield pa.RecordBatch.from_arrays([some.column("key").take(each), pa.array(np.tile(np.arange(1, m + 1), r), pa.int32()), pa.array(np.full(r * m, model.n), pa.int64()), pa.array(model.deviations(x), pa.int64()).take(each), pa.array(y.reshape(-1)), pa.array(np.tile(share, r)), pa.array(np.full(r * m, model.identity_error))], names=["key", "component", "n", "deviation", "whitened", "explained", "identity_error"])

    out = rows.mapInArrow(project, f"key {kind}, component int, n long, deviation long, whitened double, explained double, identity_error double")
    return out.withColumnRenamed("key", key)
