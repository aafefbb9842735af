"""Literal cases of the include graph."""

from symloom.operators import graph as g

EDGES = "src long, config_id int, dst long, conditional boolean, ord int"


def edges(spark, pairs):
    return spark.createDataFrame([(a, 0, b, False, k) for k, (a, b) in enumerate(pairs)], EDGES)


def test_diamond_and_cycle(spark):
    e = edges(spark, [(1, 2), (1, 3), (2, 4), (3, 4), (4, 2)])
    files = spark.createDataFrame([(2,), (4,)], "file_id long")
    assert sorted(map(tuple, g.host_sources(files, e).collect())) == [(2, 1), (4, 1)]
    chain = g.include_chain(spark.createDataFrame([(1, 4), (3, 3), (4, 1)], "host long, target long"), e)
    assert sorted(map(tuple, chain.collect())) == [(1, 4, 0, 1), (1, 4, 1, 2), (1, 4, 2, 4), (3, 3, 0, 3)]
    levels = dict(map(tuple, g.build_levels(e).collect()))
    assert levels == {1: None, 2: None, 3: None, 4: None}
    reach = g.reaches(spark.createDataFrame([(1, 4), (4, 1)], "host long, target long"), e)
    assert sorted(map(tuple, reach.collect())) == [(1, 4, True), (4, 1, False)]


def test_levels_without_cycles(spark):
    levels = dict(map(tuple, g.build_levels(edges(spark, [(1, 2), (2, 3), (1, 3)])).collect()))
    assert levels == {3: 0, 2: 1, 1: 2}


def test_unconditional_wins(spark):
    e = spark.createDataFrame([(1, 0, 2, True, 1), (1, 1, 2, False, 3)], EDGES)
    assert [tuple(r) for r in g.all_includes(e).collect()] == [(1, 2, False, 1)]


def test_host_ranking(spark):
    pairs = [("/proj/src/utils.h", h) for h in ("/proj/src/main.cpp", "/other/utils.cpp", "/proj/src/zzz.cpp", "/proj/lib/aaa.cpp")]
    out = g.rank_hosts(spark.createDataFrame(pairs, "header string, host string")).orderBy("rank").collect()
    assert [r["host"] for r in out] == ["/other/utils.cpp", "/proj/src/main.cpp", "/proj/src/zzz.cpp", "/proj/lib/aaa.cpp"]


def test_lists_are_replaced(spark):
    e = edges(spark, [(1, 2), (3, 4)])
    owners = spark.createDataFrame([(1, 0)], "src long, config_id int")
    assert {(r["src"], r["dst"]) for r in g.set_includes(e, e.filter("false"), owners).collect()} == {(3, 4)}


def test_dependents_go_down_in_words(spark, monkeypatch):
    # A file that many neighbours need: from it each dependent's word is one row, not one for each.
    seen, inner = [], g.reached_words
    monkeypatch.setattr(g, "reached_words", lambda *a: seen.append(inner(*a)) or seen[-1])
    e = edges(spark, [(k, 64 + k % 2) for k in range(128, 192)] + [(64, 1), (65, 1), (1, 64), (200, 201)])
    units = spark.createDataFrame([(1,), (201,), (7,), (7,)], "file_id long")
    got = sorted(map(tuple, g.dependents_closure(units, e.select("src", "dst")).collect()))
    assert got == [(1, k) for k in (1, 64, 65, *range(128, 192))] + [(7, 7), (201, 200), (201, 201)]
    assert seen[0].filter("node = 1 and depth = 2").count() == 1


def test_headers_of_chains_are_not_made_distinct(spark):
    e = edges(spark, [(1, 2), (1, 3), (2, 4), (3, 4), (4, 2), (4, None)])
    ids = lambda *xs: spark.createDataFrame([(x,) for x in xs], "file_id long")
    got = g.chain_dependents(ids(1, 2, 2, None), e, ids(4, 4, 1, 9))
    assert sorted(map(tuple, got.collect())) == [(1, 1), (4, 1), (4, 2)]
    assert "HashAggregate" not in got._jdf.queryExecution().executedPlan().toString()
