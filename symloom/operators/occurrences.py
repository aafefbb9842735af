"""Words of texts as occurrences of symbols, where the texts lie: a text becomes its rows within a
task, so nothing is shuffled or written for them; and the lines that hold places asked for. Places
are in code points."""

from __future__ import annotations

from collections.abc import Iterator
from functools import partial
from hashlib import md5

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

#: Bytes of text that are cut into words at once, about.
SLICE = 1 << 22
COLUMNS = {"file_id": "long", "tu": "string", "line": "long", "tok": "long", "symbol_id": "long", "name": "string", "begin_off": "long", "len": "long", "nxt": "long"}
FIRST = ["symbol_id", "name", "file_id", "begin_off", "len"]
#: Symbols of which a task keeps the smallest place so far, at most.
KNOWN = 1 << 21
#: Places in a list, at most, and in what is worked on at once, about.
LIST, AT_ONCE = 1 << 12, 1 << 17


def occurrences(texts: DataFrame, *only: str, lists: bool = False) -> DataFrame:
    """texts (file_id, tu, content) as (file_id, tu, line, tok, symbol_id, name, begin_off, len,
    nxt): the pieces between spaces of each line that aren't empty, numbered with those that are.
    A symbol is a lower-cased word; nxt is the symbol that comes next in the line. A null text has
    none.

    With a fourth column of texts, firsts (an array of begin_off, or null), there is one more
    of the rows: first, whether the row's place is among them. With names of columns only these
    are made. If lists, a row has the words of a file, or some of them, with a list for each column
    but file_id, so that where rows must travel there are few."""
    marked = "firsts" in texts.columns
    own = texts.select("file_id", "tu", "content", *(["firsts"] if marked else []))
    columns = COLUMNS | ({"first": "boolean"} if marked else {})
    names = list(only or columns)
    if lists:
        return own.mapInArrow(lambda parts: runs(words(parts, names)), ", ".join(f"{c} {columns[c]}" if c == "file_id" else f"{c} array<{columns[c]}>" for c in names))
    return own.mapInArrow(partial(words, only=names), ", ".join(f"{c} {columns[c]}" for c in names))


def firsts(texts: DataFrame) -> DataFrame:
    """(symbol_id, name, file_id, begin_off, len): where each symbol of occurrences of texts comes
    first. A task has cut its rows down already, so they are dealt out as they are: a partial
    minimum of structs would sort them first."""
    rows = texts.select("file_id", "tu", "content").mapInArrow(early_words, ", ".join(f"{c} {COLUMNS[c]}" for c in FIRST))
    at = F.struct("file_id", "begin_off", "len", "name")
    return rows.repartition("symbol_id").groupBy("symbol_id").agg(F.min(at).alias("x")).select("symbol_id", "x.name", "x.file_id", "x.begin_off", "x.len")


def early_words(parts: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """The rows of first_words whose place isn't after one of their symbol that the task has seen
    before. It keeps one place each of KNOWN symbols at most, and begins anew beyond that, so that
    rows are left over at worst."""
    none = np.zeros(0, np.int64)
    known, files, begins = none, none, none
    for rows in first_words(parts):
        if rows.num_rows and not rows.column("file_id").null_count:
            symbol, file, begin = (rows.column(c).to_numpy(zero_copy_only=False) for c in ("symbol_id", "file_id", "begin_off"))
            at = np.searchsorted(known, symbol)
            there = at < len(known)
            there[there] = known[at[there]] == symbol[there]
            old = at[there]
            later = (file[there] > files[old]) | ((file[there] == files[old]) & (begin[there] > begins[old]))
            early = np.ones(len(symbol), bool)
            early[there] = ~later
            # Rows of one symbol share their place here and lie together.
            files[old[~later]], begins[old[~later]] = file[there][~later], begin[there][~later]
            new = np.flatnonzero(~there & (np.diff(symbol, prepend=symbol[0] - 1) != 0))
            known, files, begins = (np.insert(a, at[new], b[new]) for a, b in ((known, symbol), (files, file), (begins, begin)))
            if len(known) > KNOWN:
                known, files, begins = none, none, none
            rows = rows.filter(pa.array(early))
        yield rows


def first_words(parts: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """The rows of words that firsts needs: of each few texts a symbol's first place only, with all
    rows that share it. What Spark then sorts are fewer rows."""
    for rows in words(parts, FIRST):
        if rows.num_rows and not rows.column("file_id").null_count:
            symbol, file, begin = (rows.column(c).to_numpy(zero_copy_only=False) for c in ("symbol_id", "file_id", "begin_off"))
            order = np.lexsort((begin, file, symbol))
            symbol, file, begin = symbol[order], file[order], begin[order]
            heads = np.flatnonzero(np.diff(symbol, prepend=symbol[0] - 1))
            head = np.repeat(heads, np.diff(heads, append=len(symbol)))
            rows = rows.take(pa.array(order[(file == file[head]) & (begin == begin[head])]))
        yield pa.RecordBatch.from_arrays([rows.column(c) for c in FIRST], names=FIRST)


def words(parts: Iterator[pa.RecordBatch], only: list[str] | None = None) -> Iterator[pa.RecordBatch]:
    for part in parts:
        part = part.filter(pc.is_valid(part.column("content")))
        if not part.num_rows:
            continue
        sizes = pc.binary_length(part.column("content")).to_numpy(zero_copy_only=False).astype(np.int64)
        groups = np.flatnonzero(np.diff(np.cumsum(sizes) // SLICE, prepend=-1))
        for a, b in zip(groups, [*groups[1:], part.num_rows], strict=True):
            yield words_of(part.slice(a, b - a), only)


def words_of(part: pa.RecordBatch, only: list[str] | None = None) -> pa.RecordBatch:
    """The rows of a few texts, by arithmetic on their bytes; with only these columns, if given."""
    texts = pa.concat_arrays([part.column("content")]).cast(pa.large_string())
    _, offsets, data = texts.buffers()
    at = np.frombuffer(offsets, np.int64, len(texts) + 1, texts.offset * 8)
    raw = np.frombuffer(data, np.uint8)[at[0] : at[-1]] if data else np.zeros(0, np.uint8)
    at = at - at[0]
    sep = (raw == 32) | (raw == 10)
    places = np.flatnonzero(sep)
    # Pieces begin with texts and after separators, and end with separators and texts.
    merged = lambda a, b: np.sort(np.concatenate([a, b]), kind="stable")
    begins, ends = merged(at[:-1], places + 1), merged(places, at[1:])
    so_far = lambda x: np.concatenate([[0], np.cumsum(x, dtype=np.int64)])
    breaks, chars = so_far(raw == 10), so_far((raw & 0xC0) != 0x80)
    of = np.repeat(np.arange(len(texts)), np.searchsorted(places, at[1:]) - np.searchsorted(places, at[:-1]) + 1)
    line = breaks[begins] - breaks[at[of]]
    index = np.arange(len(begins))
    heads = np.ones(len(begins), bool)
    heads[1:] = (of[1:] != of[:-1]) | (line[1:] != line[:-1])
    tok = index - np.maximum.accumulate(np.where(heads, index, 0)) if len(index) else index
    some = ends > begins
    begins, ends, of, line, tok = begins[some], ends[some], of[some], line[some], tok[some]
    spelled = pa.LargeStringArray.from_buffers(len(begins), pa.py_buffer(so_far(ends - begins).tobytes()), pa.py_buffer(raw[~sep].tobytes()))
    # Places alone need no spelling.
    coded = spelled.dictionary_encode() if only is None or {"symbol_id", "name", "nxt"} & set(only) else spelled[:0].dictionary_encode()
    low = pc.utf8_lower(coded.dictionary)
    ids = np.array([int(md5(w.encode()).hexdigest()[:15], 16) for w in low.to_pylist()], np.int64)
    codes = coded.indices.to_numpy()
    symbol = ids[codes] if len(codes) else np.zeros(0, np.int64)
    ahead = np.zeros(len(of), bool)
    ahead[:-1] = (of[1:] == of[:-1]) & (line[1:] == line[:-1])
    begin = chars[begins] - chars[at[of]]
    columns = {
        "file_id": lambda: part.column("file_id").take(pa.array(of)), "tu": lambda: part.column("tu").take(pa.array(of)), "line": lambda: pa.array(line), "tok": lambda: pa.array(tok), "symbol_id": lambda: pa.array(symbol),
        "name": lambda: low.cast(pa.string()).take(coded.indices), "begin_off": lambda: pa.array(begin), "len": lambda: pa.array(chars[ends] - chars[begins]), "nxt": lambda: pa.array(np.roll(symbol, -1), mask=~ahead),
    }
    if "firsts" in part.schema.names:
        known = part.column("firsts")
        whose = np.repeat(np.arange(len(known)), pc.fill_null(pc.list_value_length(known), 0).to_numpy(zero_copy_only=False))
        # A text's places and its number as one key; a text has fewer than 2^32 code points.
        keys = (whose << 32) + known.flatten().to_numpy(zero_copy_only=False).astype(np.int64)
        columns["first"] = lambda: pa.array(np.isin((of << 32) + begin, keys))
    return pa.RecordBatch.from_pydict({c: columns[c]() for c in only or columns})


class Lines:
    """The lines of a few texts: their text's number, their number, and where they begin and end, in
    code points and in bytes."""

    def __init__(self, texts: pa.Array):
        texts = texts.cast(pa.large_string())
        _, offsets, data = texts.buffers()
        at = np.frombuffer(offsets, np.int64, len(texts) + 1, texts.offset * 8)
        raw = np.frombuffer(data, np.uint8)[at[0] : at[-1]] if data else np.zeros(0, np.uint8)
        at = at - at[0]
        places = np.flatnonzero(raw == 10)
        merged = lambda a, b: np.sort(np.concatenate([a, b]), kind="stable")
        begins, ends = merged(at[:-1], places + 1), merged(places, at[1:])
        chars = np.concatenate([[0], np.cumsum((raw & 0xC0) != 0x80, dtype=np.int64)])
        each = np.searchsorted(places, at[1:]) - np.searchsorted(places, at[:-1]) + 1
        of = np.repeat(np.arange(len(texts)), each)
        self.raw, self.begins, self.ends, self.of = raw, begins, ends, of
        self.line = np.arange(len(of)) - (np.cumsum(each) - each)[of]
        self.start = chars[begins] - chars[at[of]]
        self.length = chars[ends] - chars[begins]
        # A text has fewer than 2^32 code points.
        self.keys = (of << 32) + self.start
        # A null text has no line.
        self.there = pc.is_valid(texts).to_numpy(zero_copy_only=False)

    def last(self) -> Lines:
        """The lines of the last text alone, as text 0."""
        own = object.__new__(Lines)
        a = np.searchsorted(self.of, len(self.there) - 1)
        lo = self.begins[a]
        own.raw, own.begins, own.ends, own.of = self.raw[lo:].copy(), self.begins[a:] - lo, self.ends[a:] - lo, np.zeros(len(self.of) - a, np.int64)
        own.line, own.start, own.length, own.keys, own.there = self.line[a:].copy(), self.start[a:].copy(), self.length[a:].copy(), self.start[a:].copy(), self.there[-1:].copy()
        return own

    def holding(self, text: np.ndarray, offset: np.ndarray) -> np.ndarray:
        """The line that holds each offset of a text (by its number), or -1."""
        ok = (offset >= 0) & (offset < 1 << 32) & self.there[text]
        at = np.searchsorted(self.keys, (text << 32) + np.where(ok, offset, 0), side="right") - 1
        return np.where(ok & (offset <= self.start[at] + self.length[at]), at, -1)

    def spelled(self, at: np.ndarray) -> pa.Array:
        sizes = self.ends[at] - self.begins[at]
        offsets = np.concatenate([[0], np.cumsum(sizes)])
        inside = np.repeat(self.begins[at] - offsets[:-1], sizes) + np.arange(offsets[-1])
        return pa.LargeStringArray.from_buffers(len(at), pa.py_buffer(offsets.tobytes()), pa.py_buffer(self.raw[inside].tobytes())).cast(pa.string())


def heads_of(keys: pa.Array) -> np.ndarray:
    """Where runs of equal values begin; nulls are equal."""
    return np.flatnonzero(np.diff(keys.dictionary_encode(null_encoding="encode").indices.to_numpy(), prepend=-1))


def runs(parts: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """Rows (file_id, ...) with a row for each run of a file, or LIST of it, and a list for each other
    column."""
    for part in parts:
        if part.num_rows:
            heads = heads_of(part.column("file_id"))
            inside = np.arange(part.num_rows) - np.repeat(heads, np.diff(heads, append=part.num_rows))
            heads = np.flatnonzero(inside % LIST == 0)
            offsets = pa.array(np.append(heads, part.num_rows).astype(np.int32))
            yield pa.RecordBatch.from_pydict({c: part.column(c).take(pa.array(heads)) if c == "file_id" else pa.ListArray.from_arrays(offsets, part.column(c)) for c in part.schema.names})


def smaller(parts: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """Rows of lists (from the fourth column on) in groups of AT_ONCE places, about."""
    for part in parts:
        sizes = pc.fill_null(pc.list_value_length(part.column(3)), 0).to_numpy(zero_copy_only=False).astype(np.int64)
        groups = np.flatnonzero(np.diff(np.cumsum(sizes) // AT_ONCE, prepend=-1))
        for a, b in zip(groups, [*groups[1:], part.num_rows], strict=True):
            yield part.slice(a, b - a)


def unpacked(parts: Iterator[pa.RecordBatch], once: bool = False) -> Iterator[pa.RecordBatch]:
    """Rows (file_id, asked, content and lists) as lines_held takes them, with a row for each place in
    the lists. If once, what a file is asked the same way again goes; files lie together."""
    last, seen = pa.nulls(0), None
    for part in smaller(parts):
        names = part.schema.names[3:]
        sizes = pc.fill_null(pc.list_value_length(part.column(names[0])), 0).to_numpy(zero_copy_only=False)
        asked = part.column("asked").to_numpy(zero_copy_only=False)
        each = np.where(asked, sizes, 1)
        # Texts have no lists, so what lists hold goes to the rows that are asked, in order.
        fill = np.repeat(asked, each)
        of = pa.array(np.repeat(np.arange(part.num_rows), each))
        pick = pa.array(np.cumsum(fill) - 1, mask=~fill)
        row = pa.StructArray.from_arrays([part.column(c).flatten().take(pick) for c in names], names=names)
        own = pa.RecordBatch.from_arrays([part.column("file_id").take(of), part.column("asked").take(of), part.column("content").take(of), row], names=["file_id", "asked", "content", "row"])
        if once and own.num_rows:
            file, row = own.column("file_id"), row
            begun = len(seen) if seen is not None and file.slice(0, 1).equals(last) else 0
            if begun:
                file, row = pa.concat_arrays([pa.concat_arrays([last] * begun), file]), pa.concat_arrays([seen, row])
            asked = np.append(np.ones(begun, bool), fill)
            at = np.flatnonzero(asked)
            codes = np.repeat(np.arange(len(heads := heads_of(file))), np.diff(heads, append=len(file)))
            rows = row.take(pa.array(at))
            kept = pa.table({"file": codes[at], "at": at} | {f"c{k}": rows.field(k) for k in range(len(names))})
            first = kept.group_by(["file", *[f"c{k}" for k in range(len(names))]], use_threads=False).aggregate([("at", "min")]).column("at_min").to_numpy()
            stay = ~asked
            stay[first] = True
            # What is known of the last file, for what comes of it in the next part.
            ends = np.flatnonzero(stay & asked & (np.arange(len(file)) >= heads[-1]))
            last, seen = file.slice(len(file) - 1), row.take(pa.array(ends))
            own = own.filter(pa.array(stay[begun:]))
        yield own


def lines_held(parts: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """Rows (file_id, asked, content, row), by file and each text before what is asked of it, as
    (file_id, line, text, rows): a row for each line that holds an offset (of row) with all that
    it holds, and one without line and text for each offset that none holds."""
    file, lines = pa.nulls(0), None
    for part in parts:
        sizes = pc.fill_null(pc.binary_length(part.column("content")), 0).to_numpy(zero_copy_only=False).astype(np.int64)
        groups = np.flatnonzero(np.diff(np.cumsum(sizes) // SLICE, prepend=-1))
        for a, b in zip(groups, [*groups[1:], part.num_rows], strict=True):
            own = part.slice(a, b - a)
            asked = own.column("asked").to_numpy(zero_copy_only=False)
            heads = np.flatnonzero(~asked)
            first = heads[0] if len(heads) else len(asked)
            # What comes before the first text belongs to the one before.
            if first:
                yield held(own.slice(0, first), lines, file, np.zeros(first, np.int64))
            if len(heads):
                lines, file = Lines(own.column("content").take(pa.array(heads))), own.column("file_id").take(pa.array(heads))
                rest = np.flatnonzero(asked[first:]) + first
                if len(rest):
                    yield held(own.take(pa.array(rest)), lines, file, np.searchsorted(heads, rest) - 1)
                lines, file = lines.last(), file.slice(len(file) - 1)


def held(rows: pa.RecordBatch, lines: Lines | None, files: pa.Array, text: np.ndarray) -> pa.RecordBatch:
    """What lines_held gives for rows that are asked of texts with these numbers, files and lines."""
    row, own = rows.column("row"), rows.column("file_id")
    at = np.full(len(text), -1)
    if lines is not None:
        offset = pc.fill_null(row.field("offset").cast(pa.int64()), -1).to_numpy(zero_copy_only=False)
        same = pc.fill_null(pc.equal(own, files.take(pa.array(text))), False).to_numpy(zero_copy_only=False)
        at = np.where(same, lines.holding(text, offset), -1)
    order = np.argsort(at, kind="stable")
    at = at[order]
    new = np.flatnonzero(np.diff(at, prepend=-2) | (at < 0))
    found = at[new] >= 0
    some = at[new][found]
    fill = np.cumsum(found) - 1
    pick = pa.array(fill, mask=~found)
    line = pa.array(lines.line[some]).take(pick) if len(some) else pa.nulls(len(new), pa.int64())
    spelled = lines.spelled(some).take(pick) if len(some) else pa.nulls(len(new), pa.string())
    listed = pa.ListArray.from_arrays(pa.array(np.append(new, len(at)).astype(np.int32)), row.take(pa.array(order)))
    return pa.RecordBatch.from_pydict({"file_id": own.take(pa.array(order[new])), "line": line, "text": spelled, "rows": listed})
