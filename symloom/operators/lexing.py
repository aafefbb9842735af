"""What strings and comments do to the lines of a source: one step of a lexer for each state in
which a piece of a file may begin. Ranges are in code points."""

from __future__ import annotations

import re
from collections.abc import Iterator

import pyarrow as pa
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

#: Characters of a piece, about; it ends with a line.
PIECE = 1 << 18
#: States: code, a line comment, block comment, string or character literal that goes on, and
#: RAW with its delimiter for a raw string.
CODE, LINE, BLOCK, STRING, CHAR, RAW = "", "/", "*", '"', "'", "R"
#: The rest of a line comment and of literals, over backslashes at line ends.
REST = {LINE: re.compile(r"(?:[^\n\\]++|\\\r?\n|\\)*+"), STRING: re.compile(r'(?:[^"\\\n]++|\\\r?\n|\\.)*+'), CHAR: re.compile(r"(?:[^'\\\n]++|\\\r?\n|\\.)*+")}
#: Where something other than plain code begins: a header name, a raw string, a number with
#: quotes, a comment or a literal.
BEGIN = re.compile(r"""(?m)(?P<header>^[ \t]*\#[ \t]*(?:include|include_next|import|embed)[ \t]*<[^>\n]*>)|(?<!\w)(?:u8|[uUL])?R"(?P<raw>[^\s()\\"]{0,16})\(|(?P<number>(?<![\w.])\.?[0-9](?:'?[\w.])*)|(?P<mark>//|/\*|"|')""")
#: What is looked for first: without a mark there is no comment and no literal. A header name may
#: hold one.
MARK = re.compile(r"""//|/\*|["']""")
HEADER = re.compile(r"[ \t]*\#[ \t]*(?:include|include_next|import|embed)[ \t]*<[^>\n]*>")
#: What can end a raw string.
CLOSING = re.compile(r"""\)([^\s()\\"]{0,16})\"""")
ESCAPED_END = re.compile(r"\\\r?\n\Z")


def lexed(text: str, state: str, at: int = 0) -> tuple[str, list[tuple[int, int, str]]]:
    """(state at the end, comments) of a piece that begins in a state. A comment that began
    before has begin -1, one that goes on has end -1; a piece within one has none."""
    found: list[tuple[int, int, str]] = []
    begin = -1  # of the comment that is open
    while True:
        if state in REST:
            end = REST[state].match(text, at).end()
            goes_on = end == len(text) and end > at and ESCAPED_END.search(text, max(at, end - 3)) is not None or at == len(text)
            if state == LINE and not (goes_on and begin < 0):
                found.append((begin, -1 if goes_on else end, "line"))
            if goes_on:
                return state, found
            at = end + (state != LINE and text[end : end + 1] == state)
        elif state == BLOCK:
            end = text.find("*/", at)
            if end < 0:
                return state, found + [(begin, -1, "block")] * (begin >= 0)
            at = end + 2
            found.append((begin, at, "block"))
        elif state[:1] == RAW:
            end = text.find(f'){state[1:]}"', at)
            if end < 0:
                return state, found
            at = end + len(state) + 1
        state = CODE
        m = MARK.search(text, at)
        if not m:
            return state, found
        p = m.start()
        line = text.rfind("\n", at, p) + 1 or (at if at == 0 or text[at - 1] == "\n" else p)
        if (header := HEADER.match(text, line)) and header.end() > p:
            at = header.end()
            continue
        mark = m[0]
        if mark == "'" or (mark == '"' and p > at and text[p - 1] == "R"):
            # It may belong to a number or a raw string; these have no blanks before their marks.
            m = BEGIN.search(text, max(at, line if line < p else at, text.rfind(" ", at, p) + 1))
            mark = m["mark"]
        at = m.end()
        if mark:
            begin = m.start()
            state = {"//": LINE, "/*": BLOCK}.get(mark, mark)
        elif (raw := m["raw"]) is not None:
            state = RAW + raw


def ends_of(text: str) -> dict[str, str]:
    """The state at the end of a piece for each in which it may begin. A raw string whose end
    isn't in the piece goes on, and is left out."""
    out = {state: lexed(text, state)[0] for state in (CODE, LINE, BLOCK, STRING, CHAR)}
    for m in CLOSING.finditer(text):
        if RAW + m[1] not in out:
            out[RAW + m[1]] = lexed(text, CODE, m.end())[0]
    return out


def pieces(sources: DataFrame) -> DataFrame:
    """sources (file_id, content) as (file_id, piece, n_pieces, start, text)."""
    own = sources.filter("content is not null").select("file_id", F.col("content").cast("string").alias("content"))
    return own.mapInArrow(pieces_of, f"file_id {dict(own.dtypes)['file_id']}, piece int, n_pieces int, start long, text string")


def pieces_of(parts: Iterator[pa.RecordBatch], size: int = PIECE) -> Iterator[pa.RecordBatch]:
    for part in parts:
        for k in range(part.num_rows):
            text = part.column("content")[k].as_py()
            cuts = [0]
            while len(text) - cuts[-1] > size and (end := text.find("\n", cuts[-1] + size - 1)) >= 0 and end + 1 < len(text):
                cuts.append(end + 1)
            n = len(cuts)
            yield pa.RecordBatch.from_arrays([part.column("file_id").take(pa.array([k] * n)), pa.array(range(n), pa.int32()), pa.array([n] * n, pa.int32()), pa.array(cuts, pa.int64()), pa.array([text[a:b] for a, b in zip(cuts, [*cuts[1:], len(text)], strict=True)])], names=["file_id", "piece", "n_pieces", "start", "text"])


def pieces_of_lines(rows: DataFrame, size: int = PIECE) -> DataFrame:
    """pieces of files that are rows already (file_id, line, start, text): lines whose starts share
    a stretch are gathered, and never a file."""
    own = rows.withColumn("at", F.floor(F.col("start") / size))
    per = Window.partitionBy("file_id")
    numbers = own.select("file_id", "at").distinct().select("file_id", "at", (F.row_number().over(per.orderBy("at")) - 1).alias("piece"), F.count("*").over(per).cast("int").alias("n_pieces"))
    texts = F.array_join(F.transform(F.array_sort(F.collect_list(F.struct("line", "text"))), lambda x: x["text"]), "\n")
    made = own.groupBy("file_id", "at").agg(F.min("start").alias("start"), texts.alias("text")).join(numbers, ["file_id", "at"])
    return made.select("file_id", "piece", "n_pieces", "start", F.when(F.col("piece") < F.col("n_pieces") - 1, F.concat("text", F.lit("\n"))).otherwise(F.col("text")).alias("text"))


def whole_comments(parts: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """(file_id, begin, end, kind) of files (file_id, content) of a piece at most; none of others."""
    for part in parts:
        of, begins, ends, kinds = [], [], [], []
        for k, text in enumerate(part.column("content").to_pylist()):
            if text is None or len(text) > PIECE:
                continue
            state, found = lexed(text, CODE)
            of += [k] * len(found)
            begins += [begin for begin, _, _ in found]
            ends += [len(text) if end < 0 else end for _, end, _ in found]
            kinds += [kind for _, _, kind in found]
        yield pa.RecordBatch.from_arrays([part.column("file_id").take(pa.array(of, pa.int64())), pa.array(begins, pa.int64()), pa.array(ends, pa.int64()), pa.array(kinds, pa.string())], names=["file_id", "begin", "end", "kind"])


def transitions(parts: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """(file_id, piece, n_pieces, ends) of pieces."""
    for part in parts:
        ends = [list(ends_of(t.as_py()).items()) for t in part.column("text")]
        yield pa.RecordBatch.from_arrays([part.column("file_id"), part.column("piece"), part.column("n_pieces"), pa.array(ends, pa.map_(pa.string(), pa.string()))], names=["file_id", "piece", "n_pieces", "ends"])


def comment_parts(parts: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """(file_id, begin, end, kind) of the comments of pieces whose state at the beginning is
    known; begin or end is null where it lies in another piece."""
    for part in parts:
        of, begins, ends, kinds = [], [], [], []
        for k, row in enumerate(part.select(["piece", "n_pieces", "start", "text", "state"]).to_pylist()):
            last = row["piece"] == row["n_pieces"] - 1
            state, found = lexed(row["text"], row["state"])
            if last and state in (LINE, BLOCK) and not (found and found[-1][1] < 0):
                found.append((-1, -1, "line" if state == LINE else "block"))
            for begin, end, kind in found:
                end = len(row["text"]) if last and end < 0 else end
                if begin < 0 and end < 0:
                    continue
                of.append(k)
                begins.append(None if begin < 0 else row["start"] + begin)
                ends.append(None if end < 0 else row["start"] + end)
                kinds.append(kind)
        yield pa.RecordBatch.from_arrays([part.column("file_id").take(pa.array(of, pa.int64())), pa.array(begins, pa.int64()), pa.array(ends, pa.int64()), pa.array(kinds, pa.string())], names=["file_id", "begin", "end", "kind"])
