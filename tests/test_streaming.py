"""Folds: literal histories, and the same outputs from a stream as from a batch."""

import time
from itertools import islice

import pyarrow as pa
import pytest

from symloom.operators.change import debounce, rate_limit
from symloom.streaming import folds


def history(fold, events):
    state, out = fold.start(), []
    for seq, e in enumerate(events):
        out += fold.step(state, {"doc": 1, "seq": seq, **e})
    return out


def test_two_crashes_block_until_an_edit_and_a_success():
    out = history(folds.QUARANTINE, [{"kind": "crash", "death": "a"}, {"kind": "crash", "death": "a"}, {"kind": "crash", "death": "b"}, {"kind": "edit", "changed": False}, {"kind": "edit", "changed": True}, {"kind": "dispatch"}, {"kind": "land"}])
    assert [r["blocked"] for r in out] == [False, False, True, True, False, True, False]
    assert [r["announce"] for r in out] == [False, False, True, False, False, False, False]
    assert [r["crashes"] for r in out] == [1, 1, 2, 2, 2, 2, 0]


def test_a_success_clears_only_inherited_evidence():
    out = history(folds.QUARANTINE, [{"kind": "crash"}, {"kind": "dispatch"}, {"kind": "crash"}, {"kind": "land"}])
    assert [r["crashes"] for r in out] == [1, 1, 2, 1]
    out = history(folds.QUARANTINE, [{"kind": "crash", "query": "tokens"}, {"kind": "land", "query": "hover"}, {"kind": "crash", "query": "tokens"}, {"kind": "land"}, {"kind": "land", "query": "tokens"}])
    assert [r["crashes"] for r in out] == [1, 1, 2, 2, 0]


def test_a_death_without_a_name_always_counts_and_hides_no_other():
    out = history(folds.QUARANTINE, [{"kind": "crash", "death": "d1"}, {"kind": "crash", "death": ""}, {"kind": "crash", "death": "d1"}])
    assert [r["crashes"] for r in out] == [1, 2, 2]


def test_crash_budget_cools_down():
    out = history(folds.CRASH_BUDGET, [{"kind": "crash", "at": 0}, {"kind": "crash", "at": 10}, {"kind": "ask", "at": 300}, {"kind": "ask", "at": 311}])
    assert [r["blocked"] for r in out] == [False, True, True, False]
    out = history(folds.CRASH_BUDGET, [{"kind": "crash", "at": 0}, {"kind": "crash", "at": 1}, {"kind": "ask", "at": 400}, {"kind": "crash", "at": 401}, {"kind": "crash", "at": 402}, {"kind": "land", "at": 403}])
    assert [r["blocked"] for r in out] == [False, True, False, False, True, False]


def test_pending_ledger():
    add = lambda reason: {"kind": "enqueue", "reason": reason}
    out = history(folds.PENDING, [add("DepsOnly"), add("ContentChanged"), {"kind": "done", "ticket": 0}, add("DepsOnly"), {"kind": "done", "ticket": 1}, {"kind": "done", "ticket": 3}, {"kind": "take"}])
    assert [r["outcome"] for r in out] == ["queued", "merged", "discarded", "merged", "kept", "cleared", "idle"]
    # Within a slot changed content stays; a slot after it has its own reason.
    state = folds.PENDING.start()
    for seq, e in enumerate([add("ContentChanged"), add("DepsOnly")]):
        folds.PENDING.step(state, {"doc": 1, "seq": seq, **e})
    assert state["reason"] == "ContentChanged"
    for seq, e in enumerate([{"kind": "take"}, add("DepsOnly")], 2):
        folds.PENDING.step(state, {"doc": 1, "seq": seq, **e})
    assert state["reason"] == "DepsOnly"


def test_requeue_verdicts():
    add, take, crash, preempt = {"kind": "enqueue", "reason": "ContentChanged"}, {"kind": "take"}, {"kind": "crash"}, {"kind": "preempt"}
    verdicts = lambda *events: [r["verdict"] for r in history(folds.REQUEUE, events)]
    assert verdicts(crash, add, take, crash, take, crash, take, crash, take, crash, crash) == ["dropped", "requeued", "requeued", "requeued", "gave up", "dropped"]
    # Preemptions are free, even when the budget is spent.
    assert verdicts(add, take, crash, take, crash, take, crash, take, preempt, take, crash) == ["requeued"] * 4 + ["gave up"]
    # What failed has been replaced, and the new content has a fresh budget.
    assert verdicts(add, take, crash, take, crash, take, crash, take, add, crash, take, crash) == ["requeued"] * 3 + ["superseded", "requeued"]
    # Dependencies that changed meanwhile don't give a fresh budget.
    deps = {"kind": "enqueue", "reason": "DepsOnly"}
    assert verdicts(add, take, crash, take, crash, take, crash, deps, take, crash) == ["requeued"] * 3 + ["gave up"]
    assert verdicts(add, take, {"kind": "drop"}, crash) == ["dropped"]


def test_forced_ticks_and_failed_reloads():
    tick = lambda stamp, **more: {"path": 1, "tick": 0, "stamp": stamp, "there": stamp is not None, **more}
    applied = lambda *ticks: [k for k, t in enumerate(ticks) for _ in folds.DEBOUNCE.step(state, t)]
    state = folds.DEBOUNCE.start()
    assert applied(tick("a"), tick("a"), tick("a"), tick("b", force=True), tick("b"), tick("b"), tick("b", force=True)) == [1, 3, 6]
    state = folds.DEBOUNCE.start()
    assert applied(tick("a"), tick("a", readable=False), tick("a"), tick("a"), tick(None), tick("a"), tick("a")) == [3, 6]


def test_idle_states_are_forgotten(spark, tmp_path):
    assert folds.CRASH_BUDGET.idle({"crashes": 2}) == 300 and folds.CRASH_BUDGET.idle({"crashes": 1}) is None and folds.CRASH_BUDGET.idle({"crashes": 0}) == 0
    rows = [(k % 3, k, "crash" if k % 4 else "land", float(k)) for k in range(40)]
    schema = "doc long, seq long, kind string, at double"
    want = sorted(map(tuple, folds.run_batch(spark.createDataFrame(rows, schema), "doc", "seq", folds.CRASH_BUDGET).collect()), key=str)
    assert streamed(spark, tmp_path, rows, schema, "doc", "seq", folds.CRASH_BUDGET, len(want)) == want


def test_edits_are_clamped():
    out = history(folds.EDITS, [{"kind": "open", "text": "abc"}, {"kind": "change", "start": 1, "end": 99, "text": "X"}, {"kind": "change", "start": None, "end": None, "text": "aX"}, {"kind": "close"}, {"kind": "open", "text": None}])
    assert [(r["version"], r["generation"], r["length"], r["noop"]) for r in out] == [(0, 1, 3, False), (1, 1, 2, False), (2, 1, 2, True), (2, 1, 2, False), (0, 2, 0, False)]


def test_tracker():
    out = history(folds.TRACK, [{"path": "p", "hash": h} for h in ("a", "a", "b", None, "b")])
    assert [(r["seq"], r["event"]) for r in out] == [(2, "changed"), (3, "removed"), (4, "changed")]


def streamed(spark, tmp_path, rows, schema, key, seq, fold, expected):
    half = len(rows) // 2
    for k, part in enumerate((rows[:half], rows[half:])):
        spark.createDataFrame(part, schema).coalesce(1).write.mode("append").parquet(str(tmp_path / f"in/b{k}"))
    stream = spark.readStream.schema(schema).option("maxFilesPerTrigger", 1).option("recursiveFileLookup", True).parquet(str(tmp_path / "in"))
    name = f"out_{fold.schema.split()[0]}_{len(rows)}"
    q = folds.run_stream(stream, key, seq, fold).writeStream.format("memory").queryName(name).outputMode("append").option("checkpointLocation", str(tmp_path / "cp")).start()
    # A query with timers goes on without data, so it is stopped once the rows are there.
    until = time.time() + 60
    while spark.table(name).count() < expected and time.time() < until:
        time.sleep(0.5)
    q.stop()
    return sorted(map(tuple, spark.table(name).collect()), key=str)


@pytest.mark.parametrize("case", ["limit", "debounce"])
def test_stream_equals_batch(spark, tmp_path, case):
    if case == "limit":
        rows, schema, args = [(k, f"t{k % 3}") for k in range(60)], "seq long, id string", ("id", "seq", folds.RATE_LIMIT)
        batch = rate_limit(spark.createDataFrame(rows, schema)).select("seq", "id", "action")
    else:
        rows, schema, args = [(k % 2, k, "ab"[(k // 5) % 2], k % 17 != 0) for k in range(80)], "path long, tick long, stamp string, there boolean", ("path", "tick", folds.DEBOUNCE)
        batch = debounce(spark.createDataFrame(rows, schema)).select("path", "tick", "stamp")
    want = sorted(map(tuple, batch.collect()), key=str)
    assert streamed(spark, tmp_path, rows, schema, *args, len(want)) == want
    assert sorted(map(tuple, folds.run_batch(spark.createDataFrame(rows, schema), *args).collect()), key=str) == want


def test_outputs_come_before_a_key_ends():
    def endless():
        seq = 0
        while True:
            yield pa.RecordBatch.from_pydict({"id": ["hot"] * 5, "seq": list(range(seq, seq + 5))})
            seq += 5

    schema = pa.schema([("seq", pa.int64()), ("id", pa.string()), ("action", pa.string())])
    got = [r["action"] for part in islice(folds.folded(endless(), "id", folds.RATE_LIMIT, schema), 3) for r in part.to_pylist()]
    assert got == ["pass"] * 8 + ["suppressed"]


def test_a_hot_key_is_no_group(spark):
    rows = [(1 if k % 3 else k, k, "crash" if k % 5 else "land", float(k)) for k in range(5000)] + [(None, k, "crash", 0.0) for k in range(3)]
    table = spark.createDataFrame(rows, "doc long, seq long, kind string, at double").repartition(7)
    out = folds.run_batch(table, "doc", "seq", folds.CRASH_BUDGET)
    assert "FlatMapGroups" not in out._jdf.queryExecution().executedPlan().toString()
    want = []
    for doc in {r[0] for r in rows}:
        state = folds.CRASH_BUDGET.start()
        for r in sorted(r for r in rows if r[0] == doc):
            want += folds.CRASH_BUDGET.step(state, dict(zip(("doc", "seq", "kind", "at"), r, strict=True)))
    key = lambda r: (-1 if r[0] is None else r[0], r[1])
    assert sorted(map(tuple, out.collect()), key=key) == sorted((tuple(r.values()) for r in want), key=key)


def test_windowed_rates(spark, tmp_path):
    from datetime import datetime

    rows = [(datetime(2026, 1, 1, h, m), "n", e) for h, m, e in ((0, 1, "hit"), (0, 2, "miss"), (0, 59, "hit"), (1, 5, "evict"), (3, 0, "hit"))]
    schema = "ts timestamp, namespace string, event string"
    spark.createDataFrame(rows, schema).coalesce(1).write.parquet(str(tmp_path / "in"))
    q = folds.cache_rates_stream(spark.readStream.schema(schema).parquet(str(tmp_path / "in"))).writeStream.format("memory").queryName("rates").outputMode("append").start()
    q.processAllAvailable()
    q.stop()
    got = sorted((r["start"].hour, r["hits"], r["misses"], r["evictions"]) for r in spark.table("rates").collect())
    assert got == [(0, 2, 1, 0), (1, 0, 0, 1)]
