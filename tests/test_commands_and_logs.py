"""Literal cases of commands, logs and statistics."""

import json

import pytest
from pyspark.sql import functions as F

from symloom.operators import commands as c
from symloom.operators import perf as p
from symloom.sources import logs


def test_read_cdb(spark, tmp_path):
    rows = [{"directory": "/b", "file": "a.cpp", "arguments": ["clang++", "-c", "a.cpp"]}, {"directory": "/b", "file": "/x/b.cc", "command": "cc -DX='a b' -I inc b.cc"}, {"file": "c.cpp", "command": "cc"}, {"directory": "/b", "file": "d.py", "command": "x"}, {"directory": "/b", "file": "e.c"}]
    (tmp_path / "cdb.json").write_text(json.dumps(rows, indent=1))
    got = {r["file"]: r["args"] for r in c.read_cdb(spark, str(tmp_path / "cdb.json")).collect()}
    assert got == {"/b/a.cpp": ["clang++", "-c", "a.cpp"], "/x/b.cc": ["cc", "-DX=a b", "-I", "inc", "b.cc"]}


def test_commands_with_very_long_words(spark, tmp_path):
    long = "x" * 100_000
    rows = [{"directory": "/b", "file": f"{k}.cpp", "command": t} for k, t in enumerate([f"cc -D{long}=1 '{long} y'{long} a", f'cc "{long}', "'a'b\"c d\"e " * 30_000])]
    (tmp_path / "cdb.json").write_text(json.dumps(rows))
    got = {r["file"]: r["args"] for r in c.read_cdb(spark, str(tmp_path / "cdb.json")).collect()}
    assert got["/b/0.cpp"] == ["cc", f"-D{long}=1", f"{long} y{long}", "a"] and got["/b/1.cpp"] == ["cc", long] and got["/b/2.cpp"] == ["abc de"] * 30_000


def test_perf_values_of_any_length(spark):
    value = "a\U0001f600" * 20_000
    out = logs.perf_events(spark.createDataFrame([(f"[perf:x] path={value} b=1 c=d e", "f")], "value string, file string")).first()
    assert out["values"] == {"path": value, "b": "1", "c": "d e"}


def test_flags_and_diff(spark):
    def snapshot(*args):
        e = spark.createDataFrame([("/a.cpp", "/b", ["cc", *args])], "file string, directory string, args array<string>")
        e = c.classify_flags(e)
        return c.command_hash_snapshot(e.select("file", c.command_hash(F.concat("canonical", "patch"), F.col("directory")).alias("hash")))

    base = snapshot("-DFOO=1", "-O2")
    assert c.cdb_diff(base, snapshot("-DFOO=1", "-O2", "-g")).count() == 0
    assert [tuple(r) for r in c.cdb_diff(base, snapshot("-DFOO=2", "-O2")).collect()] == [("/a.cpp", "changed")]
    assert c.cdb_diff(base, snapshot("-DFOO=1", "-O3")).count() == 1
    e = spark.createDataFrame([("/a.cpp", "/b", ["cc", "-I", "inc", "-Xclang", "-include-pch", "-Xclang", "x.pch", "-o", "out", "-isystem/s", "-Wall"])], "file string, directory string, args array<string>")
    row = c.classify_flags(e).first()
    assert row["patch"] == ["-I/b/inc", "-isystem/s"] and row["canonical"] == ["cc", "-Wall"]


def test_the_driver_is_part_of_a_context(spark):
    rows = [("/a.cpp", "/b", [d, "-O2", "a.cpp"]) for d in ("clang++", "g++")] + [("/b.cpp", "/b", ["C:\\\\bin\\\\clang-cl.exe", "/Fox.obj", "-showIncludes:user", "/YuPch.h", "/W4", "-I", "/Fonts/inc"]), ("/c.cpp", "/b", ["g++", "-I", "-c", "/Fox"])]
    e = c.classify_flags(spark.createDataFrame(rows, "file string, directory string, args array<string>"))
    got = {(r["file"], r["canonical"][0]): r for r in e.collect()}
    assert [got["/a.cpp", d]["canonical"] for d in ("clang++", "g++")] == [["clang++", "-O2", "a.cpp"], ["g++", "-O2", "a.cpp"]]
    cl = got["/b.cpp", "C:\\\\bin\\\\clang-cl.exe"]
    assert cl["canonical"][1:] == ["/W4"] and cl["patch"] == ["-I/Fonts/inc"]
    assert got["/c.cpp", "g++"]["canonical"] == ["g++", "/Fox"] and got["/c.cpp", "g++"]["patch"] == ["-I/b/-c"]
    assert c.unique_configs(e.filter("file = '/a.cpp'")).count() == 2


def test_rules(spark):
    files = spark.createDataFrame([("/p/a.cpp",), ("/p/sub/b.h",)], "path string")
    rules = spark.createDataFrame([(0, "**/*.cpp", "-DA", None), (1, "/p/*", "-DB", "-DA"), (2, "", "-DX", None), (3, "**/?.h", "-DH", None)], "rule_ord int, pattern string, append string, remove string")
    got = {r["path"]: r["a"] for r in c.match_rules(files, rules).select("path", c.appended(F.col("rules")).alias("a")).collect()}
    assert got == {"/p/a.cpp": ["-DB"], "/p/sub/b.h": ["-DH"]}


def test_perf_lines(spark):
    text = ["[2026-08-14 12:34:56.789] [info] [thread 7] [f.cpp:1] [perf:index] op=build path=/a b/c elapsed_ms=12.5", "noise", "[perf:x] k= n=3"]
    out = logs.perf_events(spark.createDataFrame([(t, "f") for t in text], "value string, file string")).orderBy("topic").collect()
    assert [(r["topic"], r["tid"], r["values"]) for r in out] == [("index", 7, {"op": "build", "path": "/a b/c", "elapsed_ms": "12.5"}), ("x", 1, {"k": "", "n": "3"})]
    assert out[1]["ts"] is None and out[0]["ts"].microsecond == 789000


def test_floor_percentiles(spark):
    rows = spark.createDataFrame([("s", float(v)) for v in (2, 0, 1)], "name string, value double")
    r = p.compute_stats(rows, ["name"]).first()
    assert (r["count"], r["p50"], r["p90"], r["max"], r["mean"]) == (3, 1.0, 1.0, 2.0, 1.0)


def test_anomalies(spark):
    rows = spark.createDataFrame([("e [anomaly:lost-file] gone",), ("w [guidance] try this",), ("x",)], "value string")
    assert sorted((r["kind"], r["id"], r["message"]) for r in logs.anomalies(rows).collect()) == [("anomaly", "lost-file", "gone"), ("guidance", None, "try this")]


def test_equal_counts_keep_the_order_of_the_trace(spark, tmp_path):
    lines = [{"ts": t, "msg": {"method": m}} for t, m in ((5, "b"), (1, "a"), (2, "b"), (3, "a"), (4, "c"))]
    (tmp_path / "s.jsonl").write_text("\n".join(map(json.dumps, lines)))
    trace = logs.read_session_trace(spark, str(tmp_path / "s.jsonl"))
    assert [r["method"] for r in logs.trace_summary(trace).collect()] == ["b", "a", "c"]
    assert [r["method"] for r in logs.trace_summary(trace.drop("pos")).collect()] == ["a", "b", "c"]


def test_rules_are_few(spark, monkeypatch):
    from symloom.functions import bounded

    monkeypatch.setattr(bounded, "FEW", 2)
    files = spark.createDataFrame([("/p/a.cpp",)], "path string")
    rules = spark.createDataFrame([(k, "*", "-DA", None) for k in range(3)], "rule_ord int, pattern string, append string, remove string")
    with pytest.raises(ValueError):
        c.match_rules(files, rules)


def test_search_dirs_move_nothing(spark):
    args = ["-iwithprefixbefore", "p", "-Ia", "-iprefix", "/x/", "-iquote", "q", "-isystem", "a", "-iwithprefixbefore", "b", "-iquoteq", "-I", "-Ia", "-iprefix", "-Iy", "-iwithprefixbefore", "c", "-idirafter/x/b", "-Ia", "-isystems"]
    got = c.search_dirs(spark.createDataFrame([(1, args), (2, []), (3, None), (4, ["-I", "a", None])], "config_id long, args array<string>"))
    want = [("quoted", "q"), ("quoted", "q"), ("angled", "p"), ("angled", "a"), ("angled", "/x/b"), ("angled", "-Ia"), ("angled", "-Iyc"), ("system", "s")]
    assert sorted(map(tuple, got.collect())) == [(1, k, *x) for k, x in enumerate(want)] + [(4, 0, "angled", "a")]
    plan = got._jdf.queryExecution().executedPlan().toString()
    assert "Exchange" not in plan and "Window" not in plan
