"""Change detection and invalidation over snapshots and event tables."""

from __future__ import annotations

from functools import reduce

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from symloom.functions.lineage import cut
from symloom.functions.ranks import running

from .graph import latest_reaching, reached_from, reversed_, roots


def sweep_diff(baseline: DataFrame, now: DataFrame, open_files: DataFrame) -> DataFrame:
    """(path, event): changed or removed. baseline and now: path, size, mtime_ns, hash, readable.

    A first sight says nothing; equal hashes under a new stamp say nothing; a file that was
    missing and is back is changed; open files are left out; unreadable ones keep their state."""
    a = baseline.select("path", F.col("hash").alias("h0"), F.lit(True).alias("known"))
    b = now.select("path", F.col("hash").alias("h1"), F.col("readable"), F.lit(True).alias("seen"))
    both = a.join(b, "path", "full_outer").join(open_files.select("path"), "path", "left_anti")
    event = F.when(F.col("known").isNull(), None).when(F.col("seen").isNull(), F.when(F.col("h0").isNotNull(), "removed")).when(F.col("readable") & ~F.col("h0").eqNullSafe(F.col("h1")), "changed")
    return both.select("path", event.alias("event")).filter("event is not null")


def debounce(ticks: DataFrame) -> DataFrame:
    """ticks (path, tick, stamp, there) -> (path, tick, stamp): a stamp is applied at its second
    tick in a row, if it isn't the one applied last; a missing file forgets all before."""
    order = Window.partitionBy("path").orderBy("tick")
    spell = F.sum((~F.col("there")).cast("int")).over(order.rowsBetween(Window.unboundedPreceding, Window.currentRow))
    rows = ticks.withColumn("spell", spell).filter("there")
    within = Window.partitionBy("path", "spell").orderBy("tick")
    settled = rows.withColumn("before", F.lag("stamp").over(within)).filter("stamp = before")
    return settled.withColumn("applied", F.lag("stamp").over(within)).filter("applied is null or applied <> stamp").select("path", "tick", "stamp")


def verdict(dep: str = "", disk: str = "now_") -> Column:
    """Whether a dependency (size, mtime_ns, hash, missing) differs from what is on disk."""
    c = lambda n: F.col(dep + n)
    d = lambda n: F.col(disk + n)
    gone = d("hash").isNull()
    return F.when(c("missing") != gone, True).when(gone, False).when((c("size") == d("size")) & (c("mtime_ns") == d("mtime_ns")), False).when(c("hash").isNull(), True).otherwise(c("hash") != d("hash"))


def _on_disk(deps: DataFrame, disk: DataFrame) -> DataFrame:
    return deps.join(disk.select("path", *[F.col(c).alias(f"now_{c}") for c in ("size", "mtime_ns", "hash")]), "path", "left")


def deps_changed(deps: DataFrame, disk: DataFrame) -> DataFrame:
    """(artifact, changed): deps (artifact, path, size, mtime_ns, hash, missing) against disk
    (path, size, mtime_ns, hash)."""
    return _on_disk(deps, disk).withColumn("v", verdict()).groupBy("artifact").agg(F.bool_or("v").alias("changed"))


def repair_fast_path(deps: DataFrame, disk: DataFrame) -> DataFrame:
    """deps with the size and mtime of disk where the hash is the same."""
    same = F.col("hash") == F.col("now_hash")
    return _on_disk(deps, disk).select("artifact", "path", F.when(same, F.col("now_size")).otherwise(F.col("size")).alias("size"), F.when(same, F.col("now_mtime_ns")).otherwise(F.col("mtime_ns")).alias("mtime_ns"), "hash", "missing")


def capture_deps(files: DataFrame, disk: DataFrame, build_at: int) -> DataFrame:
    """files (artifact, path) with what is on disk; a stamp later than the build is not kept."""
    joined = _on_disk(files, disk)
    fresh = F.col("now_mtime_ns") <= build_at
    return joined.select("artifact", "path", F.col("now_size").alias("size"), F.when(fresh, F.col("now_mtime_ns")).alias("mtime_ns"), F.col("now_hash").alias("hash"), F.col("now_hash").isNull().alias("missing"))


def stale_tus(units: DataFrame, manifests: DataFrame, disk: DataFrame) -> DataFrame:
    """units (tu) without a manifest, or with a version that changed. Each version (path and
    stamps) is judged once. manifests: tu, path, size, mtime_ns, hash, missing."""
    versions = manifests.select("path", "size", "mtime_ns", "hash", "missing").distinct()
    bad = _on_disk(versions, disk).filter(verdict()).select("path", "size", "mtime_ns", "hash", "missing")
    touched = manifests.join(bad, ["path", "size", "mtime_ns", "hash", "missing"], "left_semi").select("tu")
    none = units.select("tu").join(manifests.select("tu"), "tu", "left_anti")
    return touched.union(none).distinct().join(units.select("tu").distinct(), "tu", "left_semi")


def invalidate(events: DataFrame, edges: DataFrame, chains: DataFrame, deps: DataFrame, open_files: DataFrame) -> DataFrame:
    """events (kind, file_id) -> (effect, file_id), each once.

    opened: start_session. closed: end_session, reindex. saved and changed: the file itself is
    reindexed (open ones on save only), hosts are recompiled if open and reindexed if not,
    headers with it in their chain lose their context, modules that depend on it are rebuilt.
    removed: drop_index and the same cascade. created: rescan. config: reload_config.
    rules: reresolve. cdb: resync_commands. scan: rescan."""
    fixed = {"opened": ["start_session"], "closed": ["end_session", "reindex"], "created": ["rescan"], "config": ["reload_config"], "rules": ["reresolve"], "cdb": ["resync_commands"], "scan": ["rescan"], "removed": ["drop_index"], "saved": ["reindex"], "changed": []}
    table = F.create_map(*[x for k, v in fixed.items() for x in (F.lit(k), F.array(*map(F.lit, v)).cast("array<string>"))])
    own = events.select(F.explode(F.try_element_at(table, F.col("kind"))).alias("effect"), "file_id")
    moved = events.filter("kind in ('saved', 'changed', 'removed')").select("file_id").distinct()
    is_open = open_files.select("file_id", F.lit(True).alias("open")).distinct()
    selves = events.filter("kind = 'changed'").select("file_id").distinct().join(is_open, "file_id", "left_anti").select(F.lit("reindex").alias("effect"), "file_id")
    hosts = reached_from(moved, reversed_(edges)).join(roots(edges), "file_id", "left_semi").join(is_open, "file_id", "left").select(F.when(F.col("open"), "recompile").otherwise("reindex").alias("effect"), "file_id")
    context = chains.select("header", F.col("node").alias("file_id")).join(moved, "file_id", "left_semi").select(F.lit("drop_context").alias("effect"), F.col("header").alias("file_id"))
    rebuilt = moved.union(reached_from(moved, reversed_(deps))).select(F.lit("rebuild_module").alias("effect"), "file_id")
    return own.union(selves).union(hosts).union(context).union(rebuilt).distinct()


def file_event_effects(events: DataFrame, edges: DataFrame, fresh_edges: DataFrame, deps: DataFrame, units: DataFrame, chains: DataFrame, contexts: DataFrame, open_files: DataFrame, disk: DataFrame) -> DataFrame:
    """events (seq, kind, file_id) of a batch -> (effect, file_id), each once.

    edges and fresh_edges (src, dst) are the include graph before and after the batch, deps (src
    needs dst) and units (file_id) the module units, chains (header, node) what headers were
    reached through, contexts (header, host) whose commands they borrow, open_files (file_id,
    same: the buffer is what lies on disk) and disk (file_id, current: the index is of this
    content) the files that can be read. A file that occurs twice in open_files or disk is taken
    as the one of false; a null there is false.

    opened, edited: nothing beyond the session. saved: the cascade; an open file is indexed anew,
    and recompiled if the disk isn't its buffer. changed: an open file is recompiled and indexed
    anew, a closed one cascades and is indexed anew. closed: a file that can't be read has no
    index to wait for, one that is indexed as it is waits as a dependent, others as changed.
    removed: hosts and modules behind it, and nothing is left to index. command_added and
    command_changed: the index goes and is built anew, open files are recompiled, modules behind
    it and contexts that borrow from it go; command_removed: likewise, but the index stays.
    crashed, evicted: what was built is lost. Other kinds and null files have no effect.

    The cascade of changed content: the file's own verdicts go; its hosts and the modules behind
    it are recompiled if open and else indexed as dependents; headers reached through it are
    checked anew, and closed ones indexed as dependents.

    Of what is queued for a file the later event decides: a removal takes back what earlier ones
    queued or dropped, later ones take back the removal, and changed content outdoes dependents.
    So every effect carries the seq of its last event, and closures carry only the last."""
    known = events.filter("file_id is not null and seq is not null")
    flag = lambda rows, c: rows.groupBy("file_id").agg(F.bool_and(F.coalesce(c, F.lit(False))).alias(c), F.lit(True).alias(f"in_{c}"))
    last = known.groupBy("kind", "file_id").agg(F.max("seq").alias("seq"))
    last = last.join(flag(open_files, "same"), "file_id", "left").join(flag(disk, "current"), "file_id", "left")
    last = cut(last.select("kind", "file_id", "seq", F.coalesce("in_same", F.lit(False)).alias("is_open"), F.coalesce("same", F.lit(False)).alias("same"), F.coalesce("in_current", F.lit(False)).alias("readable"), F.coalesce("current", F.lit(False)).alias("current")))
    kind, is_open = F.col("kind"), F.col("is_open")
    commands = kind.isin("command_added", "command_changed", "command_removed")
    rebuilt = kind.isin("command_added", "command_changed")
    cascade = (kind == "saved") | ((kind == "changed") & ~is_open)
    when = lambda c, *names: F.when(c, F.array(*map(F.lit, names)))
    own = F.array_distinct(F.flatten(F.array_compact(F.array(
        when(cascade, "reset_header_mode", "reset_trial"),
        when((kind == "saved") & is_open, "content"),
        when((kind == "saved") & is_open & ~F.col("same"), "recompile"),
        when(kind == "changed", "content"),
        when((kind == "changed") & is_open, "recompile"),
        when((kind == "closed") & ~F.col("readable"), "clear"),
        when((kind == "closed") & F.col("readable") & F.col("current"), "dependent"),
        when((kind == "closed") & F.col("readable") & ~F.col("current"), "content"),
        when(kind == "removed", "clear"),
        when(commands & is_open, "recompile"),
        when(rebuilt, "drop_index", "content"),
        when(kind.isin("crashed", "evicted"), "lost"),
    ))))
    on_own = last.select(F.explode(own).alias("effect"), "file_id", "seq")

    at = lambda c: last.filter(c).groupBy("file_id").agg(F.max("seq").alias("seq"))
    content = at(cascade)
    moved = content.union(at(kind == "removed"))
    hosts = [latest_reaching(moved, reversed_(e)).join(roots(e), "file_id", "left_semi") for e in (edges, fresh_edges)]
    begun = moved.union(at(commands)).join(units.select("file_id").distinct(), "file_id", "left_semi")
    behind = begun.union(latest_reaching(begun, reversed_(deps)))
    opened = open_files.select("file_id", F.lit(True).alias("opened")).distinct()
    recompiled = lambda rows, closed: rows.join(opened, "file_id", "left").select(F.when(F.col("opened"), "recompile").otherwise(closed).alias("effect"), "file_id", "seq")
    through = cut(chains.select("header", F.col("node").alias("file_id")).join(content, "file_id").groupBy(F.col("header").alias("file_id")).agg(F.max("seq").alias("seq")))
    checked = through.select(F.explode(F.array(F.lit("force_revalidate"), F.lit("reset_header_mode"))).alias("effect"), "file_id", "seq")
    waiting = through.join(opened, "file_id", "left_anti").select(F.lit("dependent").alias("effect"), "file_id", "seq")
    given = at(commands)
    borrowers = contexts.select("header", F.col("host").alias("file_id")).join(given, "file_id").groupBy(F.col("header").alias("file_id")).agg(F.max("seq").alias("seq"))
    dropped = borrowers.select(F.explode(F.array(F.lit("drop_context"), F.lit("drop_index"))).alias("effect"), "file_id", "seq")
    own_context = given.join(contexts.select(F.col("header").alias("file_id")).distinct(), "file_id", "left_semi").select(F.lit("drop_context").alias("effect"), "file_id", "seq")
    parts = [on_own, recompiled(hosts[0].union(hosts[1]).union(behind), "dependent"), checked, waiting, dropped, own_context, recompiled(borrowers, "content")]
    per_file = _last_word(reduce(DataFrame.union, parts))
    after = last.agg(F.bool_or(cascade | commands | (kind == "removed")).alias("a"), F.bool_or(cascade | commands | kind.isin("removed", "closed")).alias("b"))
    whole = after.select(F.explode(F.array_compact(F.array(F.when(F.col("a"), "recheck_contexts"), F.when(F.col("b"), "reschedule_indexing")))).alias("effect"), F.lit(None).cast("long").alias("file_id"))
    return per_file.union(whole)


def _last_word(effects: DataFrame) -> DataFrame:
    """effects (effect, file_id, seq) -> (effect, file_id): those of the queue (content,
    dependent, drop_index, clear) as the later event leaves them; a removal comes after what its
    own event queued."""
    seq = lambda e: F.max(F.when(F.col("effect") == e, F.col("seq")))
    queued = ("content", "dependent", "drop_index", "clear")
    per = effects.groupBy("file_id").agg(*[seq(e).alias(e) for e in queued], F.collect_set(F.when(~F.col("effect").isin(*queued), F.col("effect"))).alias("rest"))  # a handful of names
    stays = lambda e: F.col(e).isNotNull() & (F.col("clear").isNull() | (F.col(e) > F.col("clear")))
    index = F.when(stays("content"), "reindex_content").when(stays("dependent"), "reindex_dependent").when(F.col("clear").isNotNull(), "clear_reindex")
    return per.select(F.explode(F.array_union(F.array_compact(F.array(index, F.when(stays("drop_index"), "drop_index"))), F.col("rest"))).alias("effect"), "file_id")


def reduce_reindex_effects(effects: DataFrame) -> DataFrame:
    """effects (seq, file_id, effect: enqueue, clear or drop) -> (file_id, effect): the later of
    enqueue and clear; a drop unless a clear comes after it."""
    last = lambda e: F.max(F.when(F.col("effect") == e, F.col("seq")))
    per = effects.groupBy("file_id").agg(last("enqueue").alias("e"), last("clear").alias("c"), last("drop").alias("d"))
    main = F.when(F.coalesce("e", F.lit(-1)) > F.coalesce("c", F.lit(-1)), "enqueue").when(F.col("c").isNotNull(), "clear")
    drop = F.when(F.col("d") > F.coalesce("c", F.lit(-1)), "drop")
    return per.select("file_id", F.explode(F.array_compact(F.array(main, drop))).alias("effect"))


def mass_removal(edges: DataFrame, removed: DataFrame) -> DataFrame:
    """edges without those that leave removed files."""
    return edges.join(removed.select(F.col("file_id").alias("src")).distinct(), "src", "left_anti").select(edges.columns)


def rate_limit(anomalies: DataFrame, most: int = 8) -> DataFrame:
    """anomalies (seq, id) -> (seq, id, action): the first `most` of an id pass, the next is
    replaced by a notice, the rest are dropped."""
    n = F.row_number().over(Window.partitionBy("id").orderBy("seq"))
    return anomalies.withColumn("n", n).filter(F.col("n") <= most + 1).select("seq", "id", F.when(F.col("n") <= most, "pass").otherwise("suppressed").alias("action"))


def evict_lru(entries: DataFrame, budget: int, keep: DataFrame) -> DataFrame:
    """entries (namespace, key, size, atime) to evict: the least recently used first, until a
    namespace is within the budget; kept keys stay, and rows of a key count together."""
    per = entries.groupBy("namespace", "key").agg(F.sum("size").alias("size"), F.max("atime").alias("atime"))
    total = per.groupBy("namespace").agg(F.sum("size").alias("total"))
    free = per.join(keep.select("namespace", "key").distinct(), ["namespace", "key"], "left_anti")
    return running(free, ["namespace"], ["atime", "key"], "size", "before").join(total, "namespace").filter(F.col("total") - F.col("before") > budget).select("namespace", "key", "size")


def attach_notes(diagnostics: DataFrame) -> DataFrame:
    """diagnostics (file_id, seq, severity, ...) without notes, each with the number of notes and
    remarks that follow it; ignored rows are skipped, and notes before the first are dropped."""
    rows = diagnostics.filter("severity <> 'ignored'")
    main = ~F.col("severity").isin("note", "remark")
    grp = F.sum(main.cast("int")).over(Window.partitionBy("file_id").orderBy("seq").rowsBetween(Window.unboundedPreceding, Window.currentRow))
    grouped = rows.withColumn("grp", grp).filter("grp > 0").groupBy("file_id", "grp")
    return grouped.agg(F.min("seq").alias("seq"), F.min_by("severity", "seq").alias("severity"), F.min_by("code", "seq").alias("code"), (F.count("*") - 1).alias("notes")).drop("grp")


def hoist_header_diagnostics(diagnostics: DataFrame, tree: DataFrame) -> DataFrame:
    """diagnostics (tu, node, ...) with the line of the unit's own include that leads to the
    node. tree: tu, node, parent (null: the unit itself), line."""
    from symloom.functions.lineage import cut

    state = cut(tree.select("tu", "node", F.coalesce("parent", "node").alias("up"), F.col("line")))
    while True:
        over = state.select("tu", F.col("node").alias("up"), F.col("up").alias("further"))
        moved = cut(state.join(over, ["tu", "up"]).select("tu", "node", F.col("further").alias("up"), "line", (F.col("further") != F.col("up")).alias("moved")))
        if moved.filter("moved").isEmpty():
            break
        state = moved.drop("moved")
    top = tree.filter("parent is null").select("tu", F.col("node").alias("up"), F.col("line").alias("main_line"))
    return diagnostics.join(moved.select("tu", "node", "up"), ["tu", "node"]).join(top, ["tu", "up"]).drop("up")


#: Codes of deprecated and of unused code.
DEPRECATED = """
warn_access_decl_deprecated warn_atl_uuid_deprecated warn_deprecated warn_deprecated_altivec_src_compat
warn_deprecated_comma_subscript warn_deprecated_copy warn_deprecated_copy_with_dtor
warn_deprecated_copy_with_user_provided_copy warn_deprecated_copy_with_user_provided_dtor warn_deprecated_def
warn_deprecated_increment_decrement_volatile warn_deprecated_message
warn_deprecated_redundant_constexpr_static_def warn_deprecated_register warn_deprecated_simple_assign_volatile
warn_deprecated_string_literal_conversion warn_deprecated_this_capture warn_deprecated_volatile_param
warn_deprecated_volatile_return warn_deprecated_volatile_structured_binding warn_opencl_attr_deprecated_ignored
warn_property_method_deprecated warn_vector_mode_deprecated
""".split()
UNUSED = """
warn_opencl_attr_deprecated_ignored warn_pragma_attribute_unused warn_unused_but_set_parameter
warn_unused_but_set_variable warn_unused_comparison warn_unused_const_variable warn_unused_exception_param
warn_unused_function warn_unused_label warn_unused_lambda_capture warn_unused_local_typedef
warn_unused_member_function warn_unused_parameter warn_unused_private_field
warn_unused_property_backing_ivar warn_unused_template warn_unused_variable
""".split()


def tag_diagnostics(diagnostics: DataFrame, deprecated=DEPRECATED, unused=UNUSED) -> DataFrame:
    """diagnostics with tag: deprecated or unused by code, else null; both: deprecated."""
    tag = F.when(F.col("code").isin(*deprecated), "deprecated").when(F.col("code").isin(*unused), "unused")
    return diagnostics.withColumn("tag", tag)
