"""Words of texts as rows, made where the texts lie, and what is written and moved for them."""

import os

import pytest
from pyspark.sql import functions as F

from symloom.operators import occurrences as o
from symloom.operators import scan
from symloom.plans import QUERIES, derived

SF = "/root/testdata/sf0.001"


def test_places_of_words(spark):
    texts = [(1, "a", " Ab  é\n\nab x \n y"), (2, "a", None), (3, "b", ""), (4, "b", " \n"), (5, "b", "x")]
    rows = o.occurrences(spark.createDataFrame(texts, "file_id long, tu string, content string")).collect()
    got = [(r["file_id"], r["line"], r["tok"], r["name"], r["begin_off"], r["len"]) for r in rows]
    assert sorted(got) == [(1, 0, 1, "ab", 1, 2), (1, 0, 3, "é", 5, 1), (1, 2, 0, "ab", 8, 2), (1, 2, 1, "x", 11, 1), (1, 3, 1, "y", 15, 1), (5, 0, 0, "x", 0, 1)]
    ids = {r["name"]: r["symbol_id"] for r in rows}
    assert {r["begin_off"]: r["nxt"] for r in rows if r["file_id"] == 1} == {1: ids["é"], 5: None, 8: ids["x"], 11: None, 15: None}
    marked = o.occurrences(spark.createDataFrame([(*t, f) for t, f in zip(texts, ([5, 8], [1], None, [], [0]), strict=True)], "file_id long, tu string, content string, firsts array<long>"))
    assert sorted((r["file_id"], r["begin_off"]) for r in marked.filter("first").collect()) == [(1, 5), (1, 8), (5, 0)]


def test_slices_give_the_same_rows(spark, monkeypatch):
    import pyarrow as pa

    part = pa.RecordBatch.from_pydict({"file_id": list(range(50)), "tu": ["t"] * 50, "content": [f"w{k % 7} ü x{k}\n" * (k % 5) for k in range(50)]})
    whole = pa.Table.from_batches(list(o.words([part]))).to_pylist()
    monkeypatch.setattr(o, "SLICE", 40)
    assert pa.Table.from_batches(list(o.words([part.slice(0, 20), part.slice(20)]))).to_pylist() == whole and len(whole) == 300


@pytest.mark.skipif(not os.path.isdir(SF), reason="no test tables")
def test_words_and_relations_are_not_written(spark):
    # What is written is the texts and a row a symbol; relations are made without a shuffle of words.
    n = QUERIES["F26_kind_histogram"](spark, SF).agg(F.sum("n")).first()[0]
    kept = {name: spark.read.parquet(path) for (_, at, name), path in derived._written.items() if at == SF}
    assert sorted(kept) == ["firsts", "x4"] and kept["x4"].count() == spark.read.parquet(f"{SF}/documents.parquet").count()
    assert kept["firsts"].count() == derived.table(spark, SF, "x4").select("symbol_id").distinct().count()
    assert n == derived.table(spark, SF, "x14k").count()
    calls = derived.table(spark, SF, "x14k").filter("kind = 'Callee'")._jdf.queryExecution().executedPlan().toString()
    assert calls.count("MapInArrow") == 1 and "Exchange" not in calls and "Window" not in calls


def test_first_places_of_symbols(spark, monkeypatch):
    monkeypatch.setattr(o, "SLICE", 60)
    texts = [(k % 9 - 4, "t", " ".join(f"W{(k * j) % 13}" for j in range(k % 5)) + f" w{k % 3}\nz") for k in range(60)] + [(3, "t", None), (None, "t", "n z"), (-5, "t", "")]
    own = spark.createDataFrame(texts, "file_id long, tu string, content string").coalesce(3)
    at = F.min(F.struct("file_id", "begin_off", "len", "name")).alias("x")
    want = o.occurrences(own).groupBy("symbol_id").agg(at).select("symbol_id", "x.name", "x.file_id", "x.begin_off", "x.len")
    assert sorted(map(tuple, o.firsts(own).collect()), key=str) == sorted(map(tuple, want.collect()), key=str)
    batch = own.filter("file_id is not null").toArrow().combine_chunks().to_batches()[0]
    rows = [len(part) for part in o.first_words(iter([batch]))], [len(set(part.column("symbol_id").to_pylist())) for part in o.words(iter([batch]))]
    assert sum(rows[1]) <= sum(rows[0]) < sum(len(part) for part in o.words(iter([batch])))


@pytest.mark.skipif(not os.path.isdir(SF), reason="no test tables")
def test_texts_stay_where_kinds_are_not_asked_for(spark):
    for name in ("F23_index_stats", "F25_shares", "F4_reference_files", "F2_mirror_relations"):
        plan = QUERIES[name](spark, SF)._jdf.queryExecution().optimizedPlan().toString()
        assert "content" in plan and "firsts" not in plan, name
    shares = QUERIES["F25_shares"](spark, SF)._jdf.queryExecution().optimizedPlan().toString()
    assert "Window" not in shares
    rows = lambda name: derived.table(spark, SF, name).drop("kind")
    assert rows("x14n").exceptAll(rows("x14")).isEmpty() and rows("x14").exceptAll(rows("x14n")).isEmpty()


def test_lines_that_hold_places(spark):
    texts = [(1, "a\u00e9\nb c\n\n"), (2, None), (3, ""), (5, "\U0001f600x"), (6, "unasked\n")]
    asked = [(1, 0, "p"), (1, 2, "q"), (1, 3, "r"), (1, 3, "r"), (1, 6, "s"), (1, 7, "t"), (1, 8, "u"), (1, 9, "v"), (1, -1, "w"), (1, None, "x"), (2, 0, "y"), (3, 0, "z"), (3, 1, "z"), (4, 0, "A"), (5, 2, "B"), (5, 3, "C"), (None, 0, "D")]
    got = scan.line_context(spark.createDataFrame(asked, "file_id long, offset long, tag string"), spark.createDataFrame(texts, "file_id long, content string"))
    plan = got._jdf.queryExecution().executedPlan().toString()
    assert plan.count("Exchange") == 1 and "Join" not in plan
    assert got.columns == ["file_id", "offset", "tag", "line", "text"]
    a, b = (0, "a\u00e9"), (1, "b c")
    want = [a, a, b, b, b, (2, ""), (3, ""), *[(None, None)] * 4, (0, ""), *[(None, None)] * 2, (0, "\U0001f600x"), *[(None, None)] * 2]
    order = lambda rows: sorted(rows, key=str)
    assert order(map(tuple, got.collect())) == order((*x, *y) for x, y in zip(asked, want, strict=True))


def test_lines_of_texts_over_many_batches(monkeypatch):
    import pyarrow as pa

    texts = [f"l{k}\n\u00fc{k} x\n" * (k % 4) for k in range(12)]
    rows = [r for k, text in enumerate(texts) for r in [(k, False, text, None), *[(k, True, None, {"offset": o}) for o in range(len(text) + 2)]]]
    types = pa.schema([("file_id", pa.int64()), ("asked", pa.bool_()), ("content", pa.string()), ("row", pa.struct([("offset", pa.int64())]))])
    batch = lambda part: pa.RecordBatch.from_pylist([dict(zip(types.names, r, strict=True)) for r in part], types)
    spread = lambda out: sorted(((r["file_id"], x["offset"], r["line"], r["text"]) for part in out for r in part.to_pylist() for x in r["rows"]), key=str)
    want = sorted(((k, o, *((text[:o].count("\n"), text.split("\n")[text[:o].count("\n")]) if o <= len(text) else (None, None))) for k, text in enumerate(texts) for o in range(len(text) + 2)), key=str)
    assert spread(o.lines_held(iter([batch(rows)]))) == want
    monkeypatch.setattr(o, "SLICE", 20)
    assert spread(o.lines_held(batch(rows[k : k + 7]) for k in range(0, len(rows), 7))) == want


def test_lists_of_places_as_rows(spark, monkeypatch):
    import pyarrow as pa

    texts = [(1, "t", "a b a\nb c"), (2, "t", None), (3, "t", "c"), (4, "t", " a")]
    df = spark.createDataFrame(texts, "file_id long, tu string, content string")
    listed = o.occurrences(df, "symbol_id", "file_id", "begin_off", lists=True)
    flat = lambda rows: sorted((r["file_id"], b, s) for r in rows for b, s in zip(r["begin_off"], r["symbol_id"], strict=True))
    assert flat(listed.collect()) == sorted((r["file_id"], r["begin_off"], r["symbol_id"]) for r in o.occurrences(df).collect())
    asked = listed.select("file_id", F.col("begin_off").alias("offset"), "symbol_id")
    # One deal, no join and nothing made distinct besides; places that come twice come once.
    got = scan.line_context(asked.union(asked), df.select("file_id", "content"))
    plan = got._jdf.queryExecution().executedPlan().toString()
    assert plan.count("Exchange") == 1 and "Join" not in plan and "Aggregate" not in plan
    want = [(1, 0, 0, "a b a"), (1, 2, 0, "a b a"), (1, 4, 0, "a b a"), (1, 6, 1, "b c"), (1, 8, 1, "b c"), (3, 0, 0, "c"), (4, 1, 0, " a")]
    assert sorted((r["file_id"], r["offset"], r["line"], r["text"]) for r in got.collect()) == want
    # However the rows lie in batches, and however short lists are.
    types = pa.schema([("file_id", pa.int64()), ("asked", pa.bool_()), ("content", pa.string()), ("offset", pa.list_(pa.int64())), ("tag", pa.list_(pa.string()))])
    rows = [r for f in range(5) for r in [(f, False, f"x{f}\ny", None, None), *[(f, True, None, [k, 3, k + 1], ["p", None, "p"]) for k in range(3)], (f, True, None, [], [])]]
    batch = lambda part: pa.RecordBatch.from_pylist([dict(zip(types.names, r, strict=True)) for r in part], types)
    once = sorted(((f, k, t) for f in range(5) for k, t in [(0, "p"), (1, "p"), (2, "p"), (3, "p"), (3, None)]), key=str)
    for size, limit in ((99, 1 << 20), (2, 1 << 20), (99, 2)):
        monkeypatch.setattr(o, "AT_ONCE", limit)
        out = [r for part in o.unpacked((batch(rows[k : k + size]) for k in range(0, len(rows), size)), once=True) for r in part.to_pylist()]
        assert sorted(((r["file_id"], r["row"]["offset"], r["row"]["tag"]) for r in out if r["asked"]), key=str) == once
        assert [r["content"] for r in out if not r["asked"]] == [f"x{f}\ny" for f in range(5)]
    monkeypatch.setattr(o, "LIST", 2)
    words = pa.RecordBatch.from_pydict({"file_id": [1, 1, 1, 2, 3, 3], "k": [0, 1, 2, 3, 4, 5]})
    assert [tuple(r.values()) for r in next(o.runs([words])).to_pylist()] == [(1, [0, 1]), (1, [2]), (2, [3]), (3, [4, 5])]


def test_references_of_every_symbol_are_dealt_out_once(spark):
    # Before: by symbol, by all columns, and by file, with the texts moved to their first places.
    plan = QUERIES["G10_references_with_context"](spark, SF)._jdf.queryExecution().executedPlan().toString()
    assert plan.count("Exchange") == 1 and "Join" not in plan and "firsts" not in plan
