"""Calls by target, against plain Python."""

import random

import pyarrow as pa

from symloom.operators import calls as c
from symloom.operators import search as s
from symloom.plans import QUERIES

SF = "/root/testdata/sf0.001"


def brute(rows, kind, wanted=None):
    place, out = {}, {}
    for f, y, k, b, e, _, p in rows:
        if k in ("Definition", "Declaration"):
            place[y] = min(place.get(y, (2,)), (k != "Definition", p, f, b, e))
    for f, y, k, b, e, t, _ in rows:
        if k == kind and None not in (y, t) and t in place and (wanted is None or y in wanted):
            out.setdefault((y, t, *place[t][2:]), set()).add((f, b, e))
    return {key: sorted(v) for key, v in out.items()}


def test_calls_are_put_together(spark):
    rng = random.Random(11)
    rows = [(rng.randrange(6), rng.choice([*range(9), None]), rng.choice(["Callee", "Callee", "Caller", "Definition", "Declaration", "Reference"]), (b := rng.randrange(8)), b + rng.randrange(3), rng.choice([*range(12), None]), rng.randrange(2)) for _ in range(900)]
    rows = [r for r in rows if not (r[2] in ("Definition", "Declaration") and r[1] in (3, None)) and not (r[2] == "Definition" and r[1] == 4)]
    rel = spark.createDataFrame(rows, "file_id long, symbol_id long, kind string, begin int, end int, target_symbol long, priority int")
    some = spark.createDataFrame([(1,), (1,), (4,), (77,), (None,)], "symbol_id long")
    for f, kind, wanted, ids in ((s.incoming_calls, "Caller", None, None), (s.outgoing_calls, "Callee", None, None), (s.outgoing_calls, "Callee", some, {1, 4})):
        got = f(wanted, rel)
        assert got.columns == ["symbol_id", "target_symbol", "file_id", "begin", "end", "ranges", "calls"]
        found = got.collect()
        assert {tuple(r)[:5]: [tuple(x) for x in r["ranges"]] for r in found} == (want := brute(rows, kind, ids)) and len(found) == len(want) > 5
        assert all(r["calls"] == len(r["ranges"]) for r in found)


def test_calls_over_many_batches(monkeypatch):
    rng = random.Random(12)
    names = ["target_symbol", "symbol_id", "file_id", "begin", "size", "key"]
    # Pairs of one number, in any order, and a pair with as many calls as the others together.
    calls = [(t, y, rng.randrange(3), rng.randrange(2), 5, (t * 3 + y) // 2) for t in (0, 2, 3, 4, 5) for y in range(3) for _ in range(20)] + [(3, 2, k, 0, 1, 5) for k in range(300)] + [(7, 1, 1, 1, 1, 11)]
    rng.shuffle(calls)
    rows = [(t, None, 50 + t, 1, 2, -9) for t in (0, 1, 3, 4, 6)] + sorted(calls, key=lambda r: r[5])
    whole = pa.Table.from_pylist([dict(zip(names, r, strict=True)) for r in rows], pa.schema([(n, pa.int64()) for n in names]))
    want = {}
    for t, y, f, b, n, _ in calls:
        if t in (0, 3, 4):
            want.setdefault((y, t, 50 + t, 1, 3), set()).add((f, b, b + n))
    for size in (1, 2, 3, 7, 50, 999):
        for at_once in (1, 10, 1 << 18):
            monkeypatch.setattr(c, "ROWS", at_once)
            found = [r for p in c.calls_together(iter(whole.to_batches(max_chunksize=size))) for r in p.to_pylist()]
            assert {tuple(r.values())[:5]: [tuple(x.values()) for x in r["ranges"]] for r in found} == {k: sorted(v) for k, v in want.items()} and len(found) == len(want)
    assert not [r for p in c.calls_together(iter(whole.slice(5).to_batches(max_chunksize=9))) for r in p.to_pylist()]
    assert list(c.calls_together(iter(whole.slice(0, 5).to_batches()))) == []


def test_calls_of_every_symbol_are_dealt_out_once(spark):
    # Before: by symbol, as lists by target, and twice for their places.
    for name in ("G14_incoming_calls", "G15_outgoing_calls"):
        plan = QUERIES[name](spark, SF)._jdf.queryExecution().executedPlan().toString()
        assert plan.count("Exchange") == 2 and "Join" not in plan and "collect_list" not in plan
