"""Calls put together as they come, where those of a pair of symbols lie together."""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc

PAIR, RANGE = ["target_symbol", "symbol_id"], ["file_id", "begin", "size"]
#: Rows that are put together at once, about.
ROWS = 1 << 16


def changes(column: pa.Array) -> np.ndarray:
    """Whether each value differs from the one before; the first does."""
    whole = pa.types.is_integer(column.type) and not column.null_count
    codes = column.to_numpy() if whole else column.dictionary_encode(null_encoding="encode").indices.to_numpy()
    return np.append(True, codes[1:] != codes[:-1])[: len(column)]


def calls_together(parts: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """Rows (target_symbol, symbol_id, file_id, begin, size, key) by key, first the places of
    targets, which have no symbol_id, then calls, whose pair of symbols has one key, as (symbol_id,
    target_symbol, place, ranges, calls). The last key of a part waits for the next one."""
    places: list[pa.RecordBatch] = []
    known, waiting, n = None, [], 0
    for part in parts:
        calls = part
        if part.column("symbol_id").null_count:
            calls = part.filter(pc.is_valid(part.column("symbol_id")))
            places.append(part.filter(pc.is_null(part.column("symbol_id"))))
        if not calls.num_rows:
            continue
        known = known or (joined(places) if places else part.slice(0, 0))
        waiting.append(calls)
        n += calls.num_rows
        if n >= ROWS:
            rows = joined(waiting)
            last = int(np.flatnonzero(changes(rows.column("key")))[-1])
            if last:
                yield put_together(rows.slice(0, last), known)
            # Where all are of one key, as many again are waited for.
            waiting, n = [rows.slice(last)], 0 if last else -rows.num_rows
    if waiting:
        yield put_together(joined(waiting), known)


def joined(parts: list[pa.RecordBatch]) -> pa.RecordBatch:
    return pa.Table.from_batches(parts).combine_chunks().to_batches()[0]


def in_order(rows: pa.RecordBatch) -> np.ndarray:
    """The order of rows, which lie by key, by pair and range. Nearly all are of one pair a key and
    differ in file or begin: two sorts of whole numbers then, the second of small ones."""
    key, file, begin = (rows.column(c) for c in ("key", "file_id", "begin"))
    new_key = changes(key)
    plain = all(pa.types.is_integer(c.type) and not c.null_count for c in (file, begin)) and not any(np.any(changes(rows.column(c)) & ~new_key) for c in PAIR)
    if plain and len(new_key):
        run, file, begin = np.cumsum(new_key) - 1, file.to_numpy().astype(np.int64), begin.to_numpy().astype(np.int64)
        if run[-1] < 1 << 16 and min(file.min(), begin.min()) >= 0 and file.max() < 1 << 31 and begin.max() < 1 << 32:
            at = file << 32 | begin
            order = np.argsort(at)
            order = order[np.argsort(run[order].astype(np.uint16), kind="stable")]
            if not np.any((at[order][1:] == at[order][:-1]) & (run[order][1:] == run[order][:-1])):
                return order
    return pc.sort_indices(rows, sort_keys=[(c, "ascending") for c in ("key", *PAIR, *RANGE)], null_placement="at_start").to_numpy()


def put_together(rows: pa.RecordBatch, places: pa.RecordBatch) -> pa.RecordBatch:
    rows = rows.take(pa.array(in_order(rows)))
    new_call = np.logical_or.reduce([changes(rows.column(c)) for c in PAIR])
    stay = np.flatnonzero(np.logical_or.reduce([new_call, *[changes(rows.column(c)) for c in RANGE]]))
    first = np.flatnonzero(new_call[stay])
    each = np.diff(first, append=len(stay))
    at = pc.index_in(rows.column("target_symbol").take(pa.array(stay[first])), value_set=places.column("target_symbol"))
    there = at.is_valid().to_numpy(zero_copy_only=False)
    heads, own, at, each = pa.array(stay[first[there]]), pa.array(stay[np.repeat(there, each)]), at.drop_null(), each[there]
    spans = lambda of: [of.column("file_id"), of.column("begin"), pc.add(of.column("begin"), of.column("size"))]
    ranges = pa.StructArray.from_arrays([c.take(own) for c in spans(rows)], names=["file_id", "begin", "end"])
    columns = {c: rows.column(c).take(heads) for c in ("symbol_id", "target_symbol")} | dict(zip(("file_id", "begin", "end"), [c.take(at) for c in spans(places)], strict=True))
    ends = np.append(0, np.cumsum(each)).astype(np.int32)
    return pa.RecordBatch.from_pydict(columns | {"ranges": pa.ListArray.from_arrays(pa.array(ends), ranges), "calls": pa.array(each.astype(np.int64))})
