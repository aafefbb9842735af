"""Pins, masks of variants, ingest of new row sets and look-ups, on literal rows."""

import pytest
from pyspark.sql import functions as F

from symloom.operators import ingest as i
from symloom.operators import search as s


def test_only_pinned_generations_are_read(spark, tmp_path):
    at = f"file://{tmp_path}"
    one, two = spark.range(3), spark.range(5)
    with pytest.raises(ValueError):
        i.read_index(spark, at, "t")
    i.write_index({"t": one, "u": one}, at, 1)
    # A writer that fails before its pin: its tables are there, and no reader sees them.
    two.write.parquet(f"{at}/t/generation=2")
    (tmp_path / "pins" / ".aside").write_text("torn")
    assert i.pinned(spark, at) == [1] and i.read_index(spark, at, "t").count() == 3
    with pytest.raises(ValueError):
        i.read_index(spark, at, "t", 2)
    i.write_index({"t": two, "u": two}, at, 2)
    assert i.read_index(spark, at, "t").count() == 5 and i.read_index(spark, at, "t", 1).count() == 3
    with pytest.raises(ValueError):
        i.write_index({"t": one}, at, 2)
    two.write.parquet(f"{at}/t/generation=7")
    i.write_index({"t": one, "u": one}, at, 3)
    assert i.collect_index(spark, at, keep=2) == [2, 3]
    assert sorted(p.name for p in (tmp_path / "t").iterdir()) == ["generation=2", "generation=3"]
    assert i.read_index(spark, at, "u", 2).count() == 5


def test_masks_beyond_64_variants(spark):
    variants = [f"v{k:03}" for k in range(150)]
    none = spark.createDataFrame([], "file_id long, variant string, number long")
    seen = spark.createDataFrame([(1, v) for v in variants], "file_id long, variant string")
    known = i.number_variants(none, seen)
    # New variants get the next numbers; those given stay.
    later = i.number_variants(known, spark.createDataFrame([(1, "a"), (1, "v007"), (2, "b")], "file_id long, variant string"))
    numbers = {(r["file_id"], r["variant"]): r["number"] for r in later.collect()}
    assert numbers[1, "v000"] == 0 and numbers[1, "v149"] == 149 and numbers[1, "a"] == 150 and numbers[2, "b"] == 0
    rows = spark.createDataFrame([(1, r, v) for k, v in enumerate(variants) for r in (0, k % 7, 1000 + k)], "file_id long, row long, variant string")
    columns = ["file_id", "row"]
    old = i.bits(rows.filter("variant < 'v100'"), known, columns)
    live = seen.filter("variant >= 'v063'")
    got = i.merge_masks(old, i.live_masks(live, known), rows.filter("variant >= 'v100'"), known, columns)
    back = {}
    for r in got.collect():
        back.setdefault(r["row"], set()).update(r["word"] * 64 + b for b in range(64) if r["mask"] >> b & 1)
    want = {}
    for k in range(63, 150):
        for r in (0, k % 7, 1000 + k):
            want.setdefault(r, set()).add(k)
    assert back == want
    few = i.live_masks(seen.filter("variant in ('v063', 'v127', 'v149')"), known)
    assert sorted(r["row"] for r in i.live_masked(got, few, columns).collect()) == sorted({0, 63 % 7, 127 % 7, 149 % 7, 1063, 1127, 1149})


def test_only_new_row_sets_travel(spark):
    rows = spark.createDataFrame([(tu, p, r) for tu, p, rs in [("a", "x", (1, 2)), ("b", "x", (2, 1)), ("c", "x", (1,)), ("a", "y", (1, 2)), ("b", "y", (3,))] for r in rs], "tu string, path string, r long")
    none = spark.createDataFrame([], "path string, hash string")
    contributions, fresh = i.new_sets(rows, none, ["r"])
    hashes = {(r["tu"], r["path"]): r["hash"] for r in contributions.collect()}
    assert hashes["a", "x"] == hashes["b", "x"] != hashes["c", "x"]
    assert sorted((r["path"], r["r"]) for r in fresh.collect()) == [("x", 1), ("x", 1), ("x", 2), ("y", 1), ("y", 2), ("y", 3)]
    again, nothing = i.new_sets(rows, contributions, ["r"])
    assert again.count() == 5 and nothing.count() == 0
    # Where all is stored, the rows aren't even read.
    assert "Scan" not in nothing._jdf.queryExecution().optimizedPlan().toString() and "LocalRelation" in nothing._jdf.queryExecution().optimizedPlan().toString()
    more = rows.union(spark.createDataFrame([("d", "y", 9)], "tu string, path string, r long"))
    assert [tuple(r) for r in i.new_sets(more, contributions, ["r"])[1].select("path", "r").collect()] == [("y", 9)]


def test_symbols_by_id_and_line(spark):
    symbols = spark.createDataFrame([(1, "f", "Function"), (2, "g", "Function"), (3, None, "Class")], "symbol_id long, name string, kind string")
    relations = spark.createDataFrame([(10, 1, "Definition", 0, 3), (10, 2, "Definition", 4, 6), (10, 3, "Definition", 7, 9), (11, 2, "Reference", 0, 1)], "file_id long, symbol_id long, kind string, begin long, end long")
    sources = spark.createDataFrame([(10, "abc\nde fg\n"), (11, "x")], "file_id long, content string")
    places = relations.filter("kind = 'Definition'").select("symbol_id", F.lit("/p").alias("path"))
    ids = spark.createDataFrame([("a", 1), ("b", 3), ("c", 9), ("d", 0), ("e", None), ("a", 1)], "locator string, symbol_id long")
    assert [tuple(r) for r in s.locate_by_id(ids, symbols, places).collect()] == [("a", 1)]
    lines = s.definition_lines(relations, sources)
    assert sorted(tuple(r) for r in lines.collect()) == [(10, 1, 0, 1), (10, 2, 4, 2), (10, 2, 7, 3)]
    files = spark.createDataFrame([(10, "/a.cpp"), (11, "/b.cpp")], "file_id long, path string")
    asked = spark.createDataFrame([("one", "/a.cpp", 1), ("two", "/a.cpp", 2), ("three", "/a.cpp", 3), ("none", "/none", 1), ("ref", "/b.cpp", 1)], "locator string, path string, line int")
    assert sorted(tuple(r) for r in s.locate_by_line(asked, files, lines).collect()) == [("one", 1), ("two", 2)]
    assert s.locate_by_line(asked, files, lines, files.filter("file_id = 10")).count() == 0
    text = {r["symbol_id"]: (r["text"], r["start_line"], r["end_line"]) for r in s.definition_text(symbols, spark.createDataFrame([(10, 1, "Definition", 1, 6), (10, 2, "Definition", 4, 6)], "file_id long, symbol_id long, kind string, begin long, end long"), sources).collect()}
    assert text == {1: ("bc\nde", 1, 2), 2: ("de", 2, 2)}


def test_long_fuzzy_queries(spark):
    name = "aBc" * 40
    got = s.fuzzy_rank(spark.createDataFrame([(name,), ("ab",)], "query string"), spark.createDataFrame([(name,), ("aBc" * 25,), ("b",)], "name string")).collect()
    odd = s.fuzzy_rank(spark.createDataFrame([("]^",), ("-\\",), ("é",)], "query string"), spark.createDataFrame([("a]^",), ("-x\\",), ("É-é",)], "name string")).collect()
    assert {(r["query"], r["name"]) for r in odd} <= {("]^", "a]^"), ("-\\", "-x\\"), ("é", "É-é")}
    assert {(r["query"], r["name"]) for r in got} == {(name, name), (name, "aBc" * 25), ("ab", name), ("ab", "aBc" * 25)}


def test_fresh_masks_are_added_up_once(spark):
    columns, none = ["file_id", "symbol_id"], spark.createDataFrame([], "file_id long, variant string, number long")
    rows = spark.createDataFrame([(1, s, f"v{k}") for s in (7, 8) for k in range(3)] + [(1, 7, "v0")], "file_id long, symbol_id long, variant string")
    known = i.number_variants(none, rows)
    keep = i.live_masks(rows.filter("variant = 'v0'").select("file_id", "variant"), known)
    got = i.merge_masks(i.bits(rows.filter("symbol_id = 7"), known, columns), keep, rows.filter("symbol_id = 8"), known, columns)
    plan = got._jdf.queryExecution().executedPlan().toString()
    assert plan.count("bit_or(") == 6 and "Window" not in plan
    assert sorted(map(tuple, got.collect())) == [(1, 7, 0, 1), (1, 8, 0, 7)]


def test_old_rows_stay_where_few_variants_are_kept(spark):
    # What is kept is read back, so that its size is known: the old rows meet it without a shuffle.
    rows = spark.range(2000).selectExpr("id % 7 AS file_id", "id % 50 AS begin", "id % 3 AS symbol_id", "concat('v', id % 4) AS variant")
    keep = rows.filter("variant <> 'v1'").select("file_id", "variant")
    df = i.merge_variants(rows, keep, rows.filter("begin = 0"), ["file_id", "begin", "symbol_id"])
    assert df._jdf.queryExecution().sparkPlan().toString().count("BroadcastHashJoin") == 1
    want = {}
    for r in rows.collect():
        if r["variant"] != "v1" or r["begin"] == 0:
            want.setdefault((r["file_id"], r["begin"], r["symbol_id"]), set()).add(r["variant"])
    assert {tuple(r)[:3]: r["variants"] for r in df.collect()} == {k: sorted(v) for k, v in want.items()}
