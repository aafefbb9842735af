"""Literal cases of what file events lead to, and of relations with their mirrors."""

from symloom.operators import change as c
from symloom.operators import commands
from symloom.operators import graph as g
from symloom.operators import ingest as i

ARCS = "src long, dst long"


def effects(spark, events, edges=(), fresh=None, deps=(), units=(), chains=(), contexts=(), opened=(), disk=()):
    of = lambda rows, schema: spark.createDataFrame(list(rows), schema)
    out = c.file_event_effects(
        of(events, "seq long, kind string, file_id long"), of(edges, ARCS), of(edges if fresh is None else fresh, ARCS), of(deps, ARCS), of([(u,) for u in units], "file_id long"),
        of(chains, "header long, node long"), of(contexts, "header long, host long"), of(opened, "file_id long, same boolean"), of(disk, "file_id long, current boolean"),
    )
    rows = [tuple(r) for r in out.collect()]
    assert len(rows) == len(set(rows))
    return {r for r in rows if r[1] is not None}


def test_changed_content_cascades(spark):
    # 10 and 11 include 1 by way of 2; 10 is open. 3 was reached through 1, 4 is a module behind 1.
    got = effects(spark, [(1, "changed", 1)], edges=[(10, 2), (11, 2), (2, 1)], deps=[(4, 1)], units=[1, 4], chains=[(3, 1)], opened=[(10, True)])
    assert got == {("reset_header_mode", 1), ("reset_trial", 1), ("reindex_content", 1), ("recompile", 10), ("reindex_dependent", 11), ("reindex_dependent", 4), ("force_revalidate", 3), ("reset_header_mode", 3), ("reindex_dependent", 3)}


def test_invalidate_follows_hosts_and_modules_but_not_chains(spark):
    of = lambda rows, schema: spark.createDataFrame(rows, schema)
    # 10 includes 2, which includes 1; the chain of 3 holds 1 (twice), that of 5 only holds 3.
    edges, chains = of([(10, 2), (2, 1)], ARCS), of([(3, 1), (3, 1), (5, 3), (6, None)], "header long, node long")
    out = c.invalidate(of([("changed", 1), ("opened", 7), ("changed", None)], "kind string, file_id long"), edges, chains, of([(4, 1)], ARCS), of([(10,)], "file_id long"))
    got = sorted(tuple(r) for r in out.filter("file_id is not null").collect())
    assert got == [("drop_context", 3), ("rebuild_module", 1), ("rebuild_module", 4), ("recompile", 10), ("reindex", 1), ("start_session", 7)]


def test_open_file_is_its_buffer(spark):
    edges = [(10, 1)]
    assert effects(spark, [(1, "changed", 1)], edges, opened=[(1, True)]) == {("recompile", 1), ("reindex_content", 1)}
    saved = effects(spark, [(1, "saved", 1)], edges, opened=[(1, True)])
    assert ("recompile", 1) not in saved and ("reindex_content", 1) in saved and ("reindex_dependent", 10) in saved
    assert ("recompile", 1) in effects(spark, [(1, "saved", 1)], edges, opened=[(1, None)])


def test_later_event_decides(spark):
    assert effects(spark, [(1, "changed", 1), (2, "removed", 1)]) == {("reset_header_mode", 1), ("reset_trial", 1), ("clear_reindex", 1)}
    back = effects(spark, [(1, "removed", 1), (2, "changed", 1)])
    assert ("reindex_content", 1) in back and ("clear_reindex", 1) not in back
    # A removal takes back the drop of an entry that changed before; its own module cascade doesn't queue it.
    assert effects(spark, [(1, "command_changed", 1), (2, "removed", 1)], units=[1]) == {("clear_reindex", 1)}
    assert effects(spark, [(1, "removed", 1), (2, "command_added", 1)]) == {("drop_index", 1), ("reindex_content", 1)}
    # A host that is queued by a later change of what it includes isn't gone.
    got = effects(spark, [(1, "removed", 5), (2, "changed", 1)], edges=[(5, 1)])
    assert ("reindex_dependent", 5) in got and ("clear_reindex", 5) not in got


def test_closed_files(spark):
    got = effects(spark, [(1, "closed", 1), (2, "closed", 2), (3, "closed", 3)], disk=[(1, True), (2, False)])
    assert got == {("reindex_dependent", 1), ("reindex_content", 2), ("clear_reindex", 3)}


def test_commands_and_contexts(spark):
    got = effects(spark, [(1, "command_changed", 1), (2, "command_removed", 2)], contexts=[(7, 1), (8, 2), (2, 9)], opened=[(8, True)])
    assert got == {("drop_index", 1), ("reindex_content", 1), ("drop_context", 7), ("drop_index", 7), ("reindex_content", 7), ("drop_context", 8), ("drop_index", 8), ("recompile", 8), ("drop_context", 2)}


def test_hosts_of_both_graphs_and_nothing(spark):
    got = effects(spark, [(1, "saved", 1)], edges=[(10, 1)], fresh=[(11, 1)])
    assert {("reindex_dependent", 10), ("reindex_dependent", 11)} <= got
    assert effects(spark, [(1, "opened", 1), (2, "edited", 1), (3, "unheard of", 2), (4, "saved", None), (None, "saved", 3)], edges=[(10, 1)]) == set()
    assert effects(spark, []) == set()
    assert effects(spark, [(1, "crashed", 1), (2, "evicted", 2)]) == {("lost", 1), ("lost", 2)}


def test_latest_on_cycles(spark):
    arcs = spark.createDataFrame([(1, 2), (2, 3), (3, 1), (9, 2)], ARCS)
    got = g.latest_reaching(spark.createDataFrame([(1, 5), (9, 7), (4, 8)], "file_id long, seq long"), arcs)
    assert sorted(map(tuple, got.collect())) == [(1, 7), (2, 7), (3, 7)]


def test_mirrors(spark):
    rows = [(1, 10, "Destructor", 0, 1, 11), (1, 10, "TypeDefinition", 2, 3, 12), (1, 10, "Definition", 4, 5, None), (1, 10, "Callee", 6, 7, None)]
    got = {(r["symbol_id"], r["kind"], r["target_symbol"]) for r in i.mirror_relations(spark.createDataFrame(rows, "file_id long, symbol_id long, kind string, begin long, end long, target_symbol long")).collect()}
    assert got == {(10, "Destructor", 11), (11, "TypeDefinition", 10), (10, "TypeDefinition", 12), (10, "Definition", None), (10, "Callee", None)}


def test_roots_far_apart_share_no_word(spark):
    seeds = spark.createDataFrame([(-(1 << 40), 1), (63, 1), (64, 2), (None, 1), (-1, 2)], "root long, node long")
    got = g.closure(seeds, spark.createDataFrame([(1, 2), (2, 3), (3, 1), (3, None)], ARCS))
    want = {(r, n, (n - s) % 3) for r, s in ((-(1 << 40), 1), (63, 1), (64, 2), (-1, 2)) for n in (1, 2, 3)}
    assert {tuple(r) for r in got.filter("node is not null").collect()} == want


def test_owed_rows(spark):
    files = lambda *names: spark.createDataFrame([(n,) for n in names], "file string")
    recorded = spark.createDataFrame([("a", []), ("b", None), ("b", []), ("c", ["h"]), ("entry", []), ("kept", []), ("queued", []), ("gone", []), (None, [])], "file string, hashes array<string>")
    got = commands.owed_rows(recorded, files("entry", None), files("kept"), files("queued"), files("a", "b", "c", "entry", "kept", "queued", "b"))
    assert sorted(r[0] for r in got.collect()) == ["a", "b"]
    assert commands.owed_rows(recorded.filter("false"), files(), files(), files(), files()).count() == 0
