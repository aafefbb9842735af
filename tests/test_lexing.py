"""Comments among strings, and files that are cut over tasks."""

import random

import pytest
from pyspark.sql import functions as F

from symloom.operators import lexing as x
from symloom.operators import scan as s

CASES = {
    'const char* s = "// not a comment";': [],
    "// line comment\nint x = 1; /* block\ncomment */ int y = 2;\n": ["// line comment", "/* block\ncomment */"],
    "#include <vector> // trailing\n/* leading */ #define X 1\n": ["// trailing", "/* leading */"],
    "#include <a//b.h>\n# include <a/*b.h> // c": ["// c"],
    "// up \\\n down\nint a;// \\\r\n more": ["// up \\\n down", "// \\\r\n more"],
    '"a \\" // b" /* " */ \'"\' // \'': ['/* " */', "// '"],
    'R"(a )" // in" )" // out': ['// in" )" // out'],
    'R"x(a )" // in\n)x" /* b */ u8R"(//)" L"//" xR"(// c': ["/* b */"],
    "int n = 1'000'000; // c\nx = 0x1'f'; // not closed\n": ["// c"],
    "\"not closed // c\nint y; // d\n'also // e\n/* f": ["// d", "/* f"],
    "a / b * c /= /**/ d //": ["/**/", "//"],
    "s = \"x\\\n// still\"; // y": ["// y"],
    "\\// z\\": ["// z\\"],
    "": [],
}


def comments(text):
    state, found = x.lexed(text, x.CODE)
    return [text[a : len(text) if b < 0 else b] for a, b, _ in found]


@pytest.mark.parametrize("text", CASES)
def test_comments_of_a_piece(text):
    assert comments(text) == CASES[text]


def mixed(rng, n):
    bits = ["// a", "/* b", "*/", '"', "'", "\\", "\n", "\n", 'R"(', ')"', 'R"zz(', ')zz"', "x", " ", "1'0", "\\\n", "#include <q//r>\n"]
    return "".join(rng.choice(bits) for _ in range(n))


def test_maps_of_pieces_compose():
    """Lexing pieces in turn, by their maps, is lexing the whole."""
    rng = random.Random(7)
    for _ in range(300):
        text = mixed(rng, 60)
        cut = text.find("\n", len(text) // 2) + 1
        a, b = text[:cut], text[cut:]
        for state in (x.CODE, x.LINE, x.BLOCK, x.STRING, x.CHAR, "Rzz", "R", "Rnone"):
            between = x.ends_of(a).get(state, state)
            assert x.ends_of(b).get(between, between) == x.lexed(text, state)[0]
            assert between == x.lexed(a, state)[0]


def test_a_file_over_many_tasks_gives_the_rows_of_the_uncut_one(spark, monkeypatch):
    rng = random.Random(3)
    texts = [(k, mixed(rng, 400)) for k in range(40)] + [(100, None), (101, ""), (102, "/* " + "long\n" * 500), (103, "// " + "\\\n" * 300 + "end\nx // y")]
    table = spark.createDataFrame(texts, "file_id long, content string").repartition(3)
    want = []
    for k, t in texts:
        for a, b, kind in x.lexed(t, x.CODE)[1] if t else []:
            want.append((k, a, len(t) if b < 0 else b, kind))
    assert sorted(map(tuple, s.scan_comments(table).collect())) == sorted(want)
    share = {r["file_id"]: r for r in s.comment_share(table, s.scan_comments(table)).collect()}
    assert share[102]["share"] == 1000 and share[101]["share"] is None and share[100]["comments"] == 0
    assert sum(k == 102 for k, *_ in want) == 1
    # The same rows where pieces have a few lines.
    own = table.filter("content is not null")

    def small(parts, of=x.pieces_of):
        return of(parts, 30)

    cut = own.mapInArrow(small, "file_id long, piece int, n_pieces int, start long, text string")
    assert cut.filter("n_pieces > 5").count() > 50
    monkeypatch.setattr(s, "pieces", lambda sources: cut)
    assert sorted(map(tuple, s.scan_comments(table).collect())) == sorted(want)


def fold(rows):
    """(depth, before) of rows of one file by a plain loop."""
    depth = 0
    for line, step in rows:
        before, depth = depth, max(0, depth + step)
        yield line, (depth, before)


@pytest.mark.parametrize("stretch", [1, 3, 64, 4096])
def test_depth_over_stretches(spark, monkeypatch, stretch):
    monkeypatch.setattr(s, "STRETCH", stretch)
    rng = random.Random(stretch)
    files = {f: [(line, rng.choice([1, -1, -1, 0])) for line in sorted(rng.sample(range(900), 120))] for f in range(5)}
    table = spark.createDataFrame([(f, *r) for f, rows in files.items() for r in rows], "file_id int, line int, step int")
    got = {(r["file_id"], r["line"]): (r["depth"], r["before"]) for r in s.saturating_depth(table, "step", ["file_id"], "line").collect()}
    assert got == {(f, line): v for f, rows in files.items() for line, v in fold(rows)}
    counts = {(r["file_id"], r["line"]): r["n"] for r in s.counted_so_far(table, F.col("step") == 1, ["file_id"], "line", "n").collect()}
    assert counts == {(f, line): sum(v == 1 for _, v in rows[: i + 1]) for f, rows in files.items() for i, (line, _) in enumerate(rows)}


def stack_regions(rows):
    open_, out = [], []
    for line, kind in rows:
        if kind == "region":
            open_.append(line)
        elif open_:
            out.append((open_.pop(), line))
    return out


def test_regions_and_branches_over_stretches(spark, monkeypatch):
    monkeypatch.setattr(s, "STRETCH", 5)
    rng = random.Random(1)
    rows = [(f, line, rng.choice(["region", "endregion"])) for f in range(4) for line in range(100)]
    got = s.pragma_regions(spark.createDataFrame(rows, "file_id int, line int, directive string")).collect()
    want = [(f, *p) for f in range(4) for p in stack_regions([(line, k) for g, line, k in rows if g == f])]
    assert sorted(map(tuple, got)) == sorted(want)
    cond = [(1, 3, "if", False), (1, 20, "if", True), (1, 22, "endif", None), (1, 30, "elif", True), (1, 41, "else", None), (1, 60, "endif", None), (1, 61, "endif", None), (1, 70, "if", False)]
    table = spark.createDataFrame(cond, "file_id int, line int, directive string, taken boolean")
    ends = spark.createDataFrame([(1, 90)], "file_id int, last int")
    assert sorted(map(tuple, s.inactive_regions(table, ends).collect())) == [(1, 4, 30), (1, 42, 60), (1, 71, 91)]
    assert sorted(map(tuple, s.condition_folds(table).collect())) == [(1, 30, 41)]


def test_marks_within_numbers_headers_and_raw_strings():
    # What is looked for first is a mark; what it belongs to may begin before it.
    for text, want in [
        ("#include <a//b> // c", [(16, 20, "line")]), ("x\n # import <'> /* c */", [(16, 23, "block")]), ("y #include <a//b>", [(13, 17, "line")]),
        ("1'0'0 // c", [(6, 10, "line")]), ("8'/*' // c", [(6, 10, "line")]), ('u8R"x(" // )x" // c', [(15, 19, "line")]),
        ('1.R"( // " // c', [(11, 15, "line")]), ('xR"( // " // c', [(10, 14, "line")]), ("a / b * c", []),
    ]:
        assert x.lexed(text, "")[1] == want, text


def test_comments_of_files_that_are_lines(spark):
    text = {1: "a // b \\\n c\nd /* e\nf\n*/ g\n\"h // i\"\nx // last", 2: "", 3: "/* never\nclosed", 4: "one // two"}
    rows = []
    for k, content in text.items():
        start = 0
        for n, line in enumerate(content.split("\n")):
            rows.append((k, n, start, line))
            start += len(line) + 1
    table = spark.createDataFrame(rows, "file_id long, line long, start long, text string")
    want = sorted((k, b, len(c) if e < 0 else e, kind) for k, c in text.items() for b, e, kind in x.lexed(c, "")[1])
    assert len(want) == 5
    for size in (1, 7, 12, 1000):
        parts = x.pieces_of_lines(table, size)
        assert sorted(map(tuple, s.comments_of_pieces(parts).collect())) == want, size
    assert parts.count() == 4 and x.pieces_of_lines(table, 12).filter("file_id = 1").count() > 2


def test_a_users_events_are_one_file(spark):
    import os

    import pytest

    from symloom.plans import ORACLES, QUERIES

    at = "/root/testdata/sf0.001"
    if not os.path.isdir(at):
        pytest.skip("no test tables")
    users = spark.read.parquet(f"{at}/events.parquet").select("user_id").distinct().count()
    assert QUERIES["C3_scan_comments"](spark, at).count() == users
    assert all("1024" not in ORACLES[n] for n in ("C1_scan_includes", "C2_scan_modules", "C3_scan_comments"))
