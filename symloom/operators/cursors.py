"""Cursors in texts: the words under them, and how many places these have. Cursors are dealt out
with the texts, by file, and words are made where both lie. A file has one text; of several the
last counts, as for lines."""

from __future__ import annotations

from collections.abc import Callable, Iterator
from functools import partial

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from symloom.operators import occurrences as o
from symloom.operators.occurrences import heads_of, words_of

#: Rows of a file: its text, its marks and its cursors, in this order.
TEXT, MARK, CURSOR = 0, 1, 2
#: Words that are put together by symbol at once, about.
TOGETHER = 1 << 22


def word_at(cursors: DataFrame, texts: DataFrame) -> DataFrame:
    """cursors (file_id, offset, or a list of them) with begin, end and symbol_id of the word of
    texts (file_id, tu, content) that holds the offset or ends there; each cursor once."""
    kind = cursors.schema["file_id"].dataType.simpleString()
    return dealt(cursors, texts).mapInArrow(words_held, f"file_id {kind}, offset long, begin long, end long, symbol_id long")


def place_counts_of(cursors: DataFrame, texts: DataFrame, firsts: DataFrame, kinds: Callable[[np.ndarray, np.ndarray, np.ndarray], np.ndarray], definitions_first: bool) -> DataFrame:
    """search.place_counts of cursors (as in word_at) where the words of texts are occurrences and
    relations both. kinds (symbol_id, begin, and whether it is among the places of firsts:
    file_id, begin_off) says what a word is: 2 a definition, 1 a declaration, 0 neither.

    Sums of places and lists of cursors go by symbol, once, from files to where they meet; sums of
    a symbol come before its cursors, so that nothing of a symbol is held."""
    kind = cursors.schema["file_id"].dataType.simpleString()
    schema = f"symbol_id long, asked boolean, sums array<long>, cursor_file array<{kind}>, code array<long>"
    rows = dealt(cursors, texts, firsts).mapInArrow(partial(by_symbol, kinds=kinds), schema)
    met = rows.repartition("symbol_id").sortWithinPartitions("symbol_id", "asked")
    return met.mapInArrow(partial(counted, definitions_first=definitions_first), f"cursor_file {kind}, offset long, n long, s long")


def dealt(cursors: DataFrame, texts: DataFrame, marks: DataFrame | None = None) -> DataFrame:
    """(file_id, what, content, offset): texts, marks (file_id, begin_off) and cursors by file."""
    kind = cursors.schema["file_id"].dataType
    none, no_text = F.lit(None).cast("array<long>"), F.lit(None).cast("string")
    own = lambda df, what, content, offset: df.select(F.col("file_id").cast(kind).alias("file_id"), F.lit(what).alias("what"), content.alias("content"), offset.alias("offset"))
    listed = F.col("offset") if dict(cursors.dtypes)["offset"].startswith("array<") else F.array("offset")
    rows = own(texts, TEXT, F.col("content").cast("string"), none).union(own(cursors.filter("file_id is not null"), CURSOR, no_text, listed.cast("array<long>")))
    if marks is not None:
        rows = rows.union(own(marks.filter("file_id is not null"), MARK, no_text, F.array(F.col("begin_off").cast("long"))))
    return rows.repartition("file_id").sortWithinPartitions("file_id", "what")


def files_of(rows: pa.RecordBatch) -> np.ndarray:
    """Where files begin. Texts without a file are one each: no cursor is in them, but their words count."""
    file = rows.column("file_id")
    return np.union1d(heads_of(file), np.flatnonzero(file.is_null())) if file.null_count else heads_of(file)


def whole_files(parts: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """Rows of dealt in groups of whole files, of SLICE bytes about."""
    rest = None
    for part in parts:
        if not part.num_rows:
            continue
        if rest is not None:
            part = pa.Table.from_batches([rest, part]).combine_chunks().to_batches()[0]
        sizes = pc.add(pc.fill_null(pc.binary_length(part.column("content")), 0), pc.multiply(pc.fill_null(pc.list_value_length(part.column("offset")), 0), 8))
        heads = files_of(part)
        before = np.cumsum(sizes.to_numpy(zero_copy_only=False).astype(np.int64))[heads]
        ends = [*heads[np.flatnonzero(np.diff(before // o.SLICE, prepend=-1))], heads[-1]]
        for a, b in zip(ends, ends[1:], strict=False):
            if b > a:
                yield part.slice(a, b - a)
        rest = part.slice(heads[-1])
    if rest is not None:
        yield rest


class Found:
    """The words of a few files (keys: their file's number and where they begin), whether each is
    marked, and the cursors that are on one, each once, with their word."""

    def __init__(self, rows: pa.RecordBatch):
        heads = files_of(rows)
        number = np.repeat(np.arange(len(heads)), np.diff(heads, append=rows.num_rows))
        what = rows.column("what").to_numpy(zero_copy_only=False)
        self.files = rows.column("file_id").take(pa.array(heads))
        last = np.full(len(heads), -1)
        last[number[what == TEXT]] = np.flatnonzero(what == TEXT)
        last = last[last >= 0]
        content = rows.column("content").take(pa.array(last))
        words = words_of(pa.RecordBatch.from_pydict({"file_id": pa.array(number[last]), "content": pc.fill_null(content, "")}), ["file_id", "begin_off", "len", "symbol_id"])
        self.of, self.begin, size, self.symbol = (c.to_numpy(zero_copy_only=False) for c in words.columns)
        # A text has fewer than 2^32 code points.
        self.keys = (self.of << 32) + self.begin
        self.end = self.begin + size
        marks = self._asked(rows, number, what == MARK)
        self.marked = np.zeros(len(self.keys), bool)
        if len(self.keys):
            at = np.minimum(np.searchsorted(self.keys, marks), len(self.keys) - 1)
            self.marked[at[self.keys[at] == marks]] = True
        cursors = self._asked(rows, number, what == CURSOR)
        if len(cursors) and not np.all(np.diff(cursors) > 0):
            cursors = np.unique(cursors)
        word = np.searchsorted(self.keys, cursors, side="right") - 1
        cursors, word = cursors[word >= 0], word[word >= 0]
        self.offset = cursors & ((1 << 32) - 1)
        on = (self.of[word] == cursors >> 32) & (self.offset <= self.end[word])
        self.offset, self.word = self.offset[on], word[on]

    @staticmethod
    def _asked(rows: pa.RecordBatch, number: np.ndarray, which: np.ndarray) -> np.ndarray:
        lists = rows.column("offset").filter(pa.array(which))
        of = np.repeat(number[which], pc.fill_null(pc.list_value_length(lists), 0).to_numpy(zero_copy_only=False))
        offset = pc.fill_null(lists.flatten(), -1).to_numpy(zero_copy_only=False)
        ok = (offset >= 0) & (offset < 1 << 32)
        return (of[ok].astype(np.int64) << 32) + offset[ok]


def words_held(parts: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    for rows in whole_files(parts):
        f = Found(rows)
        columns = {"offset": f.offset, "begin": f.begin[f.word], "end": f.end[f.word], "symbol_id": f.symbol[f.word]}
        yield pa.RecordBatch.from_pydict({"file_id": f.files.take(pa.array(f.of[f.word]))} | {c: pa.array(v) for c, v in columns.items()})


def by_symbol(parts: Iterator[pa.RecordBatch], kinds: Callable[[np.ndarray, np.ndarray, np.ndarray], np.ndarray]) -> Iterator[pa.RecordBatch]:
    """Of some files a row for each symbol with sums (the number of its places, the sum of where
    they begin, and both of its definitions), and rows with lists of its cursors: file and code."""
    places, cursors, n = [], [], 0
    for rows in whole_files(parts):
        f = Found(rows)
        kind = np.asarray(kinds(f.symbol, f.begin, f.marked))
        own = kind > 0
        places.append((f.symbol[own], f.begin[own], kind[own] == 2))
        # How far a cursor is behind where its place begins, from 1; 0 if it is on none.
        back = np.where(own[f.word], f.offset - f.begin[f.word] + 1, 0)
        if len(back) and back.max() >= 1 << 29:
            raise ValueError("a word of 2^29 code points or more")
        cursors.append((f.symbol[f.word], f.files.take(pa.array(f.of[f.word])), f.offset << 30 | back << 1 | (kind[f.word] == 2)))
        n += len(f.keys)
        if n >= TOGETHER:
            yield from together(places, cursors)
            places, cursors, n = [], [], 0
    if places:
        yield from together(places, cursors)


def together(places: list[tuple], cursors: list[tuple]) -> Iterator[pa.RecordBatch]:
    symbol, begin, main = (np.concatenate(x) for x in zip(*places, strict=True))
    order, heads = grouped(symbol)
    symbol, begin, main = symbol[order], begin[order], main[order]
    sums = np.stack([np.add.reduceat(x.astype(np.int64), heads) if len(heads) else heads for x in (np.ones(len(symbol)), begin, main, begin * main)], axis=1)
    n, file_type = len(heads), cursors[0][1].type
    fours = pa.ListArray.from_arrays(pa.array(np.arange(0, 4 * n + 1, 4, dtype=np.int32)), pa.array(sums.reshape(-1)))
    names = ["symbol_id", "asked", "sums", "cursor_file", "code"]
    yield pa.RecordBatch.from_arrays([pa.array(symbol[heads]), pa.array(np.zeros(n, bool)), fours, pa.nulls(n, pa.list_(file_type)), pa.nulls(n, pa.list_(pa.int64()))], names=names)
    symbol, file, code = np.concatenate([x[0] for x in cursors]), pa.concat_arrays([x[1] for x in cursors]), np.concatenate([x[2] for x in cursors])
    order, heads = grouped(symbol)
    inside = np.arange(len(symbol)) - np.repeat(heads, np.diff(heads, append=len(symbol)))
    heads = np.flatnonzero(inside % o.LIST == 0)
    ends, n = pa.array(np.append(heads, len(symbol)).astype(np.int32)), len(heads)
    yield pa.RecordBatch.from_arrays([pa.array(symbol[order[heads]]), pa.array(np.ones(n, bool)), pa.nulls(n, pa.list_(pa.int64())), pa.ListArray.from_arrays(ends, file.take(pa.array(order))), pa.ListArray.from_arrays(ends, pa.array(code[order]))], names=names)


def grouped(symbol: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """The order by symbol, and where symbols begin in it."""
    order = np.argsort(symbol, kind="stable")
    own = symbol[order]
    return order, np.flatnonzero(np.append(True, own[1:] != own[:-1])) if len(own) else order


def counted(parts: Iterator[pa.RecordBatch], definitions_first: bool) -> Iterator[pa.RecordBatch]:
    """Rows of by_symbol, by symbol and sums first, as (cursor_file, offset, n, s)."""
    last, before = None, None
    for whole in parts:
        sizes = pc.fill_null(pc.list_value_length(whole.column("code")), 0).to_numpy(zero_copy_only=False).astype(np.int64)
        groups = np.flatnonzero(np.diff(np.cumsum(sizes) // o.AT_ONCE, prepend=-1))
        for a, b in zip(groups, [*groups[1:], whole.num_rows], strict=True):
            part, each = whole.slice(a, b - a), sizes[a:b]
            symbol = part.column("symbol_id").to_numpy()
            heads = np.flatnonzero(np.append(True, symbol[1:] != symbol[:-1]))
            own = np.zeros((len(symbol), 4), np.int64)
            own[~part.column("asked").to_numpy(zero_copy_only=False)] = part.column("sums").flatten().to_numpy().reshape(-1, 4)
            sums = np.add.reduceat(own, heads)
            if last == symbol[0]:
                sums[0] += before
            last, before = symbol[-1], sums[-1]
            number = np.repeat(np.arange(len(heads)), np.diff(heads, append=len(symbol)))
            n, s, n_main, s_main = sums[np.repeat(number, each)].T
            code = part.column("code").flatten().to_numpy()
            offset, back = code >> 30, code >> 1 & ((1 << 29) - 1)
            more = (n_main == 0) | (code & 1 == 1) if definitions_first else np.ones(len(n), bool)
            off = more & (n > 1) & (back > 0)
            n, s = np.where(more, n - off, n_main), np.where(more, s - off * (offset - back + 1), s_main)
            some = pa.array(np.flatnonzero(n > 0))
            yield pa.RecordBatch.from_pydict({"cursor_file": part.column("cursor_file").flatten().take(some), "offset": pa.array(offset).take(some), "n": pa.array(n).take(some), "s": pa.array(s).take(some)})
