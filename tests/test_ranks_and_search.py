"""Running sums against plain Python, counts of places against their rows, scores against all placements."""

import random
from itertools import combinations

import pytest

from symloom.functions.ranks import numbered, running
from symloom.operators import graph as g
from symloom.operators import search as s


def test_running_sums(spark):
    rng = random.Random(2)
    rows = [(rng.choice(["hot", "hot", "hot", "b", None]), rng.randrange(50), k, rng.randrange(-5, 9)) for k in range(700)]
    df = spark.createDataFrame(rows, "by string, at long, id long, n long")
    got = {r["id"]: r["before"] for r in running(df, ["by"], ["at"], "n", "before").collect()}
    assert got == {i: sum(n for b, a, _, n in rows if b == by and a < at) for by, at, i, _ in rows}
    got = [r["no"] for r in numbered(df, ["at", "id"], "no").orderBy("at", "id").collect()]
    assert got == list(range(1, 701))
    assert running(df.limit(0), ["by"], ["at"], "n", "before").count() == 0


def test_one_frontier(spark):
    pairs = [(1, 2), (2, 3), (3, 1), (4, 5), (6, 6)] + [(k, k + 1) for k in range(10, 40)]
    arcs = spark.createDataFrame(pairs, "src long, dst long")
    reach = lambda *ids: {r[0] for r in g.reached_from(spark.createDataFrame([(i,) for i in ids], "file_id long"), arcs).collect()}
    assert reach(1) == {1, 2, 3} and reach(4, 5) == {5} and reach(6) == {6} and reach(10) == set(range(11, 41)) and reach(5) == set()


def test_one_step_of_a_hierarchy_writes_nothing(spark, monkeypatch):
    rng = random.Random(8)
    rows = [(f, rng.randrange(12), rng.choice(["Caller", "Callee", "Reference"]), f, f + 1, rng.choice([None, *range(12)])) for f in range(300)]
    rel = spark.createDataFrame(rows, "file_id long, symbol_id long, kind string, begin long, end long, target_symbol long")
    wanted = spark.createDataFrame([(k,) for k in (0, 1, 2, 3, 3, 99, None)], "symbol_id long")
    far = {tuple(r) for r in s.hierarchy(wanted, rel, "Caller", "Callee", 2).filter("depth = 1").collect()}
    monkeypatch.setattr(g, "cut", None)
    got = [tuple(r) for r in s.hierarchy(wanted, rel, "Caller", "Callee").collect()]
    assert len(got) == len(set(got)) and set(got) == far == {(y, k, t, 1) for _, y, k, _, _, t in rows if y < 4 and k != "Reference" and t not in (None, y)}


def test_places_are_cut_down_before_they_meet_the_wanted(spark):
    rng = random.Random(9)
    rows = [(rng.randrange(9), rng.randrange(20), rng.choice(["Reference", "Definition"]), k, k + 2, rng.randrange(3)) for k in range(400)]
    rel = spark.createDataFrame(rows, "file_id long, symbol_id long, kind string, begin long, end long, priority int")
    wanted = spark.createDataFrame([(k,) for k in (1, 2, 2, 7, 99, None)], "symbol_id long")
    df = s.relation_location(wanted.hint("shuffle_hash"), rel, "Reference")
    plan = df._jdf.queryExecution().optimizedPlan().toString()
    assert plan.index("LeftSemi") < plan.index("Aggregate [symbol_id") < plan.index("Reference")
    want = {y: min((p, f, b, e) for f, z, k, b, e, p in rows if z == y and k == "Reference")[1:] for y in (1, 2, 7)}
    assert {r[0]: tuple(r)[1:] for r in df.collect()} == want


def test_counts_of_places_equal_their_rows(spark):
    rng = random.Random(3)
    occ = [(f, 10 * k, 10 * k + 6, rng.randrange(8)) for f in range(4) for k in range(30)]
    rel = sorted({(f, y, rng.choice(["Definition", "Declaration", "Declaration", "Reference"]) if y % 3 else "Declaration", b, e, None) for f, b, e, y in occ for _ in range(2)}, key=str)
    occurrences = spark.createDataFrame(occ, "file_id long, begin long, end long, symbol_id long")
    relations = spark.createDataFrame(rel, "file_id long, symbol_id long, kind string, begin long, end long, target_symbol long")
    cursors = spark.createDataFrame([(f, b + 2) for f, b, _, _ in occ], "file_id long, offset long")
    for first, rows in ((True, s.definition), (False, s.declaration)):
        want = {}
        for r in rows(cursors, occurrences, relations).collect():
            n, total = want.get((r["cursor_file"], r["offset"]), (0, 0))
            want[r["cursor_file"], r["offset"]] = (n + 1, total + r["begin"])
        assert {(r["cursor_file"], r["offset"]): (r["n"], r["s"]) for r in s.place_counts(cursors, occurrences, relations, first).collect()} == want


def every_placement(query, name):
    """The best score over all ways to place query's letters, each added up on its own."""
    role, kinds = s.segments(name)
    own, own_kinds = s.segments(query)
    best = None
    for at in combinations(range(len(name)), len(query)):
        if any(name[i].lower() != c.lower() for i, c in zip(at, query, strict=True)):
            continue
        total, before, fine = 0, -1, True
        for k, i in enumerate(at):
            for j in range(before + 1, i):
                total -= 3 if j == 0 else role[j] == "head"
            gap = k == 0 or i != before + 1
            if gap and role[i] == "tail" and (name[i].islower() or not name[i].isalpha() or "lower" not in kinds):
                fine = False
            total += 1 + (2 if i == 0 or not gap else 0)
            total += query[k] == name[i] or (role[i] == "head" and (own_kinds in ({"lower"}, {"upper"}) or own[k] == "head"))
            total -= (3 if role[i] == "tail" and gap and k else 0) + (own[k] == "head" and role[i] == "tail") + (4 if k == 0 and role[i] == "tail" else 0)
            before = i
        if fine and (best is None or total > best):
            best = total
    if best is None:
        return None
    return min(4 * len(query), max(0, best)) / (4 * len(query)) * (2 if len(query) == len(name) else 1)


def test_fuzzy_scores():
    assert s.fuzzy_score("foo", "barefoot") is None and s.fuzzy_score("foo", "foo") == 2 and s.fuzzy_score("foo", "fooBar") == 1
    assert s.fuzzy_score("", "x") == 1 and s.fuzzy_score("xyz", "xy") is None and s.fuzzy_score("up", "unique_ptr") == 0.75
    assert s.segments("HTTPServer_2x")[0] == ["head", "tail", "tail", "tail", "head", *["tail"] * 5, "-", "head", "tail"]
    rng = random.Random(4)
    for _ in range(400):
        name = "".join(rng.choice("aabbAB_1") for _ in range(rng.randrange(1, 9)))
        query = "".join(rng.choice("abAB_") for _ in range(rng.randrange(1, 4)))
        assert s.fuzzy_score(query, name) == pytest.approx(every_placement(query, name)), (query, name)


def test_fuzzy_rank(spark):
    names = spark.createDataFrame([(n,) for n in ("unique_ptr", "up", "group", "Upper", "cup", "unique_ptr")], "name string")
    got = [(r["rank"], r["name"]) for r in s.fuzzy_rank(spark.createDataFrame([("up",)], "query string"), names).orderBy("rank").collect()]
    assert got == [(1, "up"), (2, "Upper"), (3, "unique_ptr")]
