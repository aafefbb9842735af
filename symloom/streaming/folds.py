"""Ordered state per key, as one pure step that a batch and a stream share.

A Fold has an initial state (a dict that JSON can hold) and a step (state, row) -> outputs that
changes the state. In batch, a key's rows are folded in order of a sequence column; in a
stream, in order of arrival within each micro-batch, with the state kept between batches."""

from __future__ import annotations

import json
from collections.abc import Callable, Iterator
from dataclasses import dataclass

import pandas as pd
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql.pandas.types import to_arrow_schema
from pyspark.sql.streaming.state import GroupState, GroupStateTimeout
from pyspark.sql.types import StructType

#: Rows that a batch fold holds at a time.
ROWS = 1000


@dataclass(frozen=True)
class Fold:
    """idle: of a state, the seconds without events after which a stream forgets it (0: at once;
    None: never)."""

    schema: str
    start: Callable[[], dict]
    step: Callable[[dict, dict], list[dict]]
    idle: Callable[[dict], float | None] | None = None


def folded(parts: Iterator[pa.RecordBatch], key: str, fold: Fold, schema: pa.Schema) -> Iterator[pa.RecordBatch]:
    """The outputs over rows in order of key and sequence, in batches, with the state of one key
    at a time; a key may go on over any number of batches. As in pandas, a null number is NaN."""
    now, state = object(), {}
    for part in parts:
        for lo in range(0, part.num_rows, ROWS):
            some, out = part.slice(lo, ROWS), []
            keys = some.column(key).to_pylist()
            numeric = [f.name for f in some.schema if pa.types.is_integer(f.type) or pa.types.is_floating(f.type)]
            for k, row in zip(keys, some.to_pylist(), strict=True):
                row.update({c: float("nan") for c in numeric if row[c] is None})
                if k != now and not (k != k and now != now):
                    now, state = k, fold.start()
                out += fold.step(state, row)
            columns = [[None if r[c] != r[c] else r[c] for r in out] for c in schema.names]
            yield pa.RecordBatch.from_arrays([pa.array(c, t) for c, t in zip(columns, schema.types, strict=True)], schema=schema)


def run_batch(rows: DataFrame, key: str, seq: str, fold: Fold) -> DataFrame:
    """The outputs over a table. A key's events are folded in order of seq as they come from a
    sorted partition, so that a hot key needs no more memory than others."""
    schema = to_arrow_schema(StructType.fromDDL(fold.schema))
    ordered = rows.repartition(key).sortWithinPartitions(key, F.col(seq).asc_nulls_last())
    return ordered.mapInArrow(lambda parts: folded(parts, key, fold, schema), fold.schema)


def run_stream(rows: DataFrame, key: str, seq: str, fold: Fold) -> DataFrame:
    """The outputs of a stream, appended; the state of a key is one JSON text, with a timer where
    the fold says when an idle one is to be forgotten."""
    names = [x.split()[0] for x in fold.schema.split(", ")]

    def apply(_: tuple, parts: Iterator[pd.DataFrame], state: GroupState) -> Iterator[pd.DataFrame]:
        if state.hasTimedOut:
            state.remove()
            return
        own = json.loads(state.get[0]) if state.exists else fold.start()
        out = []
        for row in pd.concat(list(parts)).sort_values(seq, kind="stable").to_dict("records"):
            out += fold.step(own, row)
        idle = fold.idle(own) if fold.idle else None
        if idle == 0:
            if state.exists:
                state.remove()
        else:
            state.update((json.dumps(own),))
            if idle is not None:
                state.setTimeoutDuration(int(idle * 1000))
        yield pd.DataFrame(out, columns=names)

    return rows.groupBy(key).applyInPandasWithState(apply, fold.schema, "state string", "append", GroupStateTimeout.ProcessingTimeTimeout if fold.idle else GroupStateTimeout.NoTimeout)


NO_DEBT = {"reason": None, "ticket": -1, "content": -1, "crashes": 0, "queued": False}


def _owe(state: dict, reason: str, ticket: int) -> str:
    """Books that a unit must be indexed. Until its slot is taken, changed content outlasts changes
    of dependencies; a slot after that has its own reason. New content forgets crashes."""
    new, fresh = state["reason"] is None, not state["queued"]
    if new or fresh or reason == "ContentChanged":
        state["reason"] = reason
    if new or reason == "ContentChanged":
        state.update(content=ticket if reason == "ContentChanged" else -1, crashes=0)
    state.update(ticket=ticket, queued=True)
    return "queued" if fresh else "merged"


def _ledger(state: dict, e: dict, most: int = 3) -> list[dict]:
    """Events of a unit: enqueue (reason ContentChanged or DepsOnly; seq is its ticket), take (its
    slot begins to be worked on), then done, crash or preempt of what was taken (or of an explicit
    ticket), and drop. Results and failures of content that has been replaced don't count; only a
    result of the last ticket clears the debt; a unit is queued again after `most` crashes, and
    given up at the next; preemptions are free."""
    given = e.get("ticket")
    ticket = state["flight"] if given is None or given != given else int(given)
    owed, kind = state["reason"] is not None, e["kind"]
    if kind == "enqueue":
        outcome = _owe(state, e["reason"], int(e["seq"]))
    elif kind == "take":
        outcome = "taken" if owed and state["queued"] else "idle"
        if outcome == "taken":
            state.update(queued=False, flight=state["ticket"])
    elif kind == "drop" or not owed:
        outcome = "kept" if kind == "done" else "dropped"
        if kind == "drop":
            state.update(NO_DEBT)
    elif ticket < state["content"]:
        outcome = "discarded" if kind == "done" else "superseded"
    elif kind == "done":
        outcome = "cleared" if ticket == state["ticket"] else "kept"
        if outcome == "cleared":
            state.update(NO_DEBT)
    elif kind == "crash" and state["crashes"] >= most:
        outcome = "gave up"
        state.update(NO_DEBT)
    else:
        outcome, crashes = "requeued", state["crashes"] + (kind == "crash")
        _owe(state, "ContentChanged" if ticket == state["content"] else state["reason"], int(e["seq"]))
        state["crashes"] = crashes
    return [{"doc": e["doc"], "seq": e["seq"], "outcome": outcome}]


def _verdict(state: dict, e: dict) -> list[dict]:
    """The ledger's outcomes of failures only."""
    return [{"doc": r["doc"], "seq": r["seq"], "verdict": r["outcome"]} for r in _ledger(state, e) if e["kind"] in ("crash", "preempt")]


PENDING = Fold("doc long, seq long, outcome string", lambda: NO_DEBT | {"flight": -1}, _ledger)
REQUEUE = Fold("doc long, seq long, verdict string", lambda: NO_DEBT | {"flight": -1}, _verdict)


def _quarantine(state: dict, e: dict, most: int = 2) -> list[dict]:
    """Events dispatch, crash and land (of a query kind, or of the compile without one), edit
    and reset of a document. Crashes pool into one budget; a compile's success clears only what
    it inherited at its dispatch, a query's success its own kind; an edit that changes
    something arms one probe, which the next dispatch spends; a death counts once, and one
    without a name always."""
    crashes = lambda: state["streak"] + sum(state["kinds"].values())
    kind = e.get("query") or ""
    if e["kind"] == "reset":
        state.update(_fresh())
    elif e["kind"] == "edit" and e.get("changed") and crashes() >= most:
        state["probe"] = True
    elif e["kind"] == "dispatch":
        if crashes() >= most and (not kind and state["streak"] or kind in state["kinds"]):
            state["probe"] = False
        if not kind:
            state["inherited"] = state["streak"]
    elif e["kind"] == "crash":
        death = e.get("death") or ""
        if death and death == state["death"]:
            pass  # counted
        elif kind:
            state["kinds"][kind] = state["kinds"].get(kind, 0) + 1
        else:
            state["streak"] += 1
        state["death"] = death or state["death"]
    elif e["kind"] == "land":
        if kind:
            state["kinds"].pop(kind, None)
        else:
            state["streak"] -= min(state["inherited"], state["streak"])
            state["inherited"] = 0
        if crashes() < most:
            state.update(probe=False, told=False)
    active = crashes() >= most
    tell = active and not state["told"]
    state["told"] = state["told"] or tell
    return [{"doc": e["doc"], "seq": e["seq"], "crashes": crashes(), "blocked": active and not state["probe"], "announce": tell}]


def _fresh() -> dict:
    return {"streak": 0, "kinds": {}, "inherited": 0, "probe": False, "told": False, "death": ""}


QUARANTINE = Fold("doc long, seq long, crashes long, blocked boolean, announce boolean", _fresh, _quarantine)


def _budget(state: dict, e: dict, most: int = 2, cooldown: float = 300.0) -> list[dict]:
    """Events crash, land and ask (any other), with seconds `at`: blocked from the second crash on
    until the cooldown since the last has passed, and then with a fresh budget; a success clears."""
    if e["kind"] == "crash":
        state.update(crashes=state["crashes"] + 1, last=float(e["at"]))
    elif e["kind"] == "land" or (state["crashes"] >= most and e["at"] - state["last"] >= cooldown):
        state.update(crashes=0)
    return [{"doc": e["doc"], "seq": e["seq"], "blocked": state["crashes"] >= most}]


def _cooling(state: dict, most: int = 2, cooldown: float = 300.0) -> float | None:
    """Strikes below the budget stay; a spent budget is forgotten after the cooldown, none at once."""
    return 0.0 if not state["crashes"] else cooldown if state["crashes"] >= most else None


CRASH_BUDGET = Fold("doc long, seq long, blocked boolean", lambda: {"crashes": 0, "last": 0.0}, _budget, _cooling)


def _limit(state: dict, e: dict, most: int = 8) -> list[dict]:
    state["n"] += 1
    if state["n"] > most + 1:
        return []
    return [{"seq": e["seq"], "id": e["id"], "action": "pass" if state["n"] <= most else "suppressed"}]


RATE_LIMIT = Fold("seq long, id string, action string", lambda: {"n": 0}, _limit)


def _edits(state: dict, e: dict) -> list[dict]:
    """Events open, change (whole text, or a replacement of [start, end) clamped to the text)
    and close. generation counts openings; an edit that changes nothing is a no-op."""
    if e["kind"] == "open":
        state.update(text=e["text"] or "", version=0, generation=state["generation"] + 1, open=True)
        noop = False
    elif e["kind"] == "close":
        noop = not state["open"]
        state.update(open=False)
    else:
        old = state["text"]
        start, end = e.get("start"), e.get("end")
        if start is None or start != start:
            new = e["text"] or ""
        else:
            a = min(max(int(start), 0), len(old))
            b = min(max(int(end), a), len(old))
            new = old[:a] + (e["text"] or "") + old[b:]
        noop = new == old
        state.update(text=new, version=state["version"] + 1)
    return [{"doc": e["doc"], "seq": e["seq"], "version": state["version"], "generation": state["generation"], "length": len(state["text"]), "noop": noop}]


EDITS = Fold("doc long, seq long, version long, generation long, length long, noop boolean", lambda: {"text": "", "version": 0, "generation": 0, "open": False}, _edits)


def _track(state: dict, e: dict) -> list[dict]:
    """Sights of a file (hash, null: missing): what changed since the last one."""
    seen, old, new = state["seen"], state["hash"], e["hash"] if e["hash"] == e["hash"] else None
    state.update(seen=True, hash=new)
    if not seen or old == new:
        return []
    return [{"path": e["path"], "seq": e["seq"], "event": "removed" if new is None else "changed"}]


TRACK = Fold("path string, seq long, event string", lambda: {"seen": False, "hash": None}, _track)


def _settle(state: dict, e: dict) -> list[dict]:
    """Ticks of a file (stamp, there; force and readable where the table has them): a stamp is
    applied at its second tick in a row, or at a forced tick whatever it is. A missing file is
    forgotten. One that can't be read just then isn't applied, and is tried again when its stamp
    has settled again."""
    if not e["there"]:
        state.update(before=None, applied=None)
        return []
    before, stamp, forced = state["before"], e["stamp"], e.get("force") is True
    state["before"] = stamp
    if not forced and (before != stamp or state["applied"] == stamp):
        return []
    state["before"] = None if forced else stamp
    if e.get("readable") is False:
        state["before"] = None
        return []
    state["applied"] = stamp
    return [{"path": e["path"], "tick": e["tick"], "stamp": stamp}]


DEBOUNCE = Fold("path long, tick long, stamp string", lambda: {"before": None, "applied": None}, _settle)


def cache_rates_stream(events: DataFrame, ts: str = "ts", window: str = "1 hour", late: str = "10 minutes") -> DataFrame:
    """Hits, misses and evictions by namespace and window; late rows are dropped beyond the
    watermark."""
    n = lambda e: F.count_if(F.col("event") == e)
    grouped = events.withWatermark(ts, late).groupBy(F.window(ts, window).alias("w"), "namespace")
    return grouped.agg(n("hit").alias("hits"), n("miss").alias("misses"), n("evict").alias("evictions")).select("w.start", "namespace", "hits", "misses", "evictions")
