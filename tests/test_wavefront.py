"""Literal cases of include resolution with state, and of tables that a loop adds to."""

from pyspark.sql import functions as F

from symloom.functions.columns import without_dots
from symloom.functions.lineage import Grown
from symloom.operators import graph as g
from symloom.operators import scan as s

DIRS = [(0, 0, "quoted", "/q"), (0, 1, "angled", "/a"), (0, 2, "angled", "/b"), (0, 3, "system", "/c"), (1, 0, "angled", "/c"), (1, 1, "angled", "/a")]


def tables(spark, files, includes, seeds):
    search = spark.createDataFrame(DIRS, "config_id int, idx long, grp string, dir string")
    listing = s.dir_listing(spark.createDataFrame([(f,) for f in files], "path string"))
    said = spark.createDataFrame(includes, "src string, ord int, name string, angled boolean, next boolean, conditional boolean")
    return spark.createDataFrame(seeds, "path string, config_id int"), said, search, listing


def test_a_header_in_three_directories_is_followed_by_include_next(spark):
    files = ["/src/m.cpp", "/a/x.h", "/b/x.h", "/c/x.h"]
    includes = [("/src/m.cpp", 0, "x.h", True, False, False)] + [(f"/{d}/x.h", 0, "x.h", False, True, False) for d in "abc"]
    waves, edges = g.wavefront_from_sources(*tables(spark, files, includes, [("/src/m.cpp", 0)]))
    assert sorted(map(tuple, waves.select("wave", "path", "found_idx").collect())) == [(0, "/src/m.cpp", 0), (1, "/a/x.h", 1), (2, "/b/x.h", 2), (3, "/c/x.h", 3)]
    got = {r["src"]: (r["idx"], r["dst"]) for r in edges.collect()}
    assert got == {"/src/m.cpp": (1, "/a/x.h"), "/a/x.h": (2, "/b/x.h"), "/b/x.h": (3, "/c/x.h"), "/c/x.h": (None, None)}


def test_the_first_discoverer_sticks(spark):
    """/c/x.h is met by m.cpp under configuration 1 (index 0) in the wave in which n.cpp would
    find it at index 3; the smaller source hands on its configuration and index. A file found
    beside its includer has index 0."""
    files = ["/src/m.cpp", "/src/n.cpp", "/c/x.h", "/a/y.h", "/b/y.h", "/a/z.h", "/b/z.h"]
    includes = [("/src/m.cpp", 0, "x.h", True, False, False), ("/src/n.cpp", 0, "x.h", True, False, True), ("/c/x.h", 0, "y.h", True, True, False), ("/src/n.cpp", 1, "y.h", True, False, False), ("/a/y.h", 0, "z.h", False, False, False), ("/a/z.h", 0, "z.h", False, True, False)]
    waves, edges = g.wavefront_from_sources(*tables(spark, files, includes, [("/src/m.cpp", 1), ("/src/n.cpp", 0)]))
    met = {r["path"]: (r["config_id"], r["found_idx"], r["wave"]) for r in waves.collect()}
    assert met["/c/x.h"] == (1, 0, 1) and met["/a/y.h"] == (0, 1, 1) and met["/a/z.h"] == (0, 0, 2)
    got = {(r["src"], r["config_id"], r["ord"]): (r["idx"], r["dst"], r["conditional"]) for r in edges.collect()}
    assert got["/c/x.h", 1, 0] == (1, "/a/y.h", False) and got["/src/n.cpp", 0, 0] == (3, "/c/x.h", True)
    # From index 0 of the includer's own directory, the next is 1: /a again, which it lies in.
    assert got["/a/y.h", 0, 0] == (-1, "/a/z.h", False) and got["/a/z.h", 0, 0] == (1, "/a/z.h", False)


def test_nested_dotted_and_absolute_names(spark):
    files = ["/src/m.cpp", "/a/sub/x.h", "/b/y.h", "/r.h"]
    names = ["sub/x.h", "sub/../sub/./x.h", "none/../y.h", "../b/y.h", "/b/./y.h", "/none.h", "sub", "/r.h", "../r.h"]
    includes = [("/src/m.cpp", k, n, False, False, False) for k, n in enumerate(names)] + [("/src/m.cpp", 20, None, False, None, None), (None, 0, "y.h", True, False, False)]
    waves, edges = g.wavefront_from_sources(*tables(spark, files, includes, [("/src/m.cpp", 0), ("/src/m.cpp", 0)]))
    got = {r["ord"]: r["dst"] for r in edges.collect()}
    assert got == {0: "/a/sub/x.h", 1: "/a/sub/x.h", 2: None, 3: "/b/y.h", 4: "/b/y.h", 5: None, 6: "/a/sub", 7: "/r.h", 8: "/r.h"}
    assert waves.filter("wave = 1").count() == 4
    empty = tables(spark, files, includes, [("/src/m.cpp", 0)])
    waves, edges = g.wavefront_from_sources(empty[0].limit(0), *empty[1:])
    assert waves.count() == 0 and edges.count() == 0


def test_dots(spark):
    cases = {"/a/./b/../c": "/a/c", "a/b/../../c": "c", "../a/..": "..", "/..": "/", "/../a": "/a", "a//b": "a/b", "/a/b.c/..d": "/a/b.c/..d", "x" * 9: "x" * 9, "../../a": "../../a"}
    rows = spark.createDataFrame([(k,) for k in cases], "p string")
    assert {r["p"]: r["w"] for r in rows.withColumn("w", without_dots(F.col("p"))).collect()} == cases


def test_a_grown_table_is_one_scan(spark):
    grown = Grown(spark, "test")
    for k in range(5):
        step = grown.add(spark.range(k, k + 2))
        assert step.count() == 2
    assert sorted(map(tuple, grown.all().collect())) == sorted((k + i, k) for k in range(5) for i in range(2))
    assert str(grown.all()._jdf.queryExecution().executedPlan()).count("FileScan") == 1
    grown.drop()
