"""Queries of change detection, invalidation and keyed state."""

from __future__ import annotations

from pyspark.sql import functions as F

from symloom.operators import change as c
from symloom.streaming import folds

from .registry import query


def deps(t):
    return t.x9a.withColumn("missing", F.lit(False))


@query("H1_sweep_diff", "SELECT path, CASE WHEN b.hash IS NULL THEN 'removed' ELSE 'changed' END AS event FROM {x9a} a FULL JOIN {x9b} b USING (path) WHERE a.hash IS NOT NULL AND (b.hash IS NULL OR a.hash <> b.hash) AND CAST(substr(path, 4) AS BIGINT) % 13 <> 0")
def _(t):
    now = t.x9b.withColumn("readable", F.lit(True))
    return c.sweep_diff(t.x9a, now, t.x9a.filter("mtime_ns % 13 = 0"))


@query("H2_debounce", "WITH s AS (SELECT *, sum(CASE WHEN there THEN 0 ELSE 1 END) OVER (PARTITION BY path ORDER BY tick) AS g FROM {ticks}), b AS (SELECT *, lag(stamp) OVER (PARTITION BY path, g ORDER BY tick) AS before FROM s WHERE there), d AS (SELECT *, lag(stamp) OVER (PARTITION BY path, g ORDER BY tick) AS applied FROM b WHERE stamp = before) SELECT path, tick, stamp FROM d WHERE applied IS NULL OR applied <> stamp")
def _(t):
    return c.debounce(t.ticks)


@query("H2_debounce_fold", "WITH s AS (SELECT *, sum(CASE WHEN there THEN 0 ELSE 1 END) OVER (PARTITION BY path ORDER BY tick) AS g FROM {ticks}), b AS (SELECT *, lag(stamp) OVER (PARTITION BY path, g ORDER BY tick) AS before FROM s WHERE there), d AS (SELECT *, lag(stamp) OVER (PARTITION BY path, g ORDER BY tick) AS applied FROM b WHERE stamp = before) SELECT path, tick, stamp FROM d WHERE applied IS NULL OR applied <> stamp")
def _(t):
    return folds.run_batch(t.ticks, "path", "tick", folds.DEBOUNCE)


V = "v AS (SELECT a.*, b.size AS s1, b.mtime_ns AS m1, b.hash AS h1, CASE WHEN b.hash IS NULL THEN TRUE WHEN a.size = b.size AND a.mtime_ns = b.mtime_ns THEN FALSE ELSE a.hash <> b.hash END AS changed FROM {x9a} a LEFT JOIN {x9b} b USING (path))"


@query("H3_deps_changed", f"WITH {V} SELECT artifact, bool_or(changed) AS changed FROM v GROUP BY artifact")
def _(t):
    return c.deps_changed(deps(t), t.x9b)


@query("H4_repair_fast_path", f"WITH {V} SELECT artifact, path, CASE WHEN hash = h1 THEN s1 ELSE size END AS size, CASE WHEN hash = h1 THEN m1 ELSE mtime_ns END AS mtime_ns, hash, FALSE AS missing FROM v")
def _(t):
    return c.repair_fast_path(deps(t), t.x9b)


@query("H5_capture_deps", f"WITH {V} SELECT artifact, path, s1 AS size, CASE WHEN m1 <= 100 THEN m1 END AS mtime_ns, h1 AS hash, h1 IS NULL AS missing FROM v")
def _(t):
    return c.capture_deps(t.x9a.select("artifact", "path"), t.x9b, 100)


@query("H6_stale_tus", f"WITH {V} SELECT DISTINCT artifact AS tu FROM v WHERE changed UNION SELECT source FROM {{documents}} WHERE source NOT IN (SELECT artifact FROM {{x9a}})")
def _(t):
    return c.stale_tus(t.documents.select(F.col("source").alias("tu")), deps(t).withColumnRenamed("artifact", "tu"), t.x9b)


# Other names of queries over every dependency.


EVENTS = "n AS (SELECT count(*) AS parts FROM {part}), ev AS (SELECT CASE event_type WHEN 'click' THEN 'changed' WHEN 'view' THEN 'saved' WHEN 'error' THEN 'removed' WHEN 'signup' THEN 'opened' ELSE 'closed' END AS kind, 1 + event_id % parts AS file_id FROM {events}, n), moved AS (SELECT DISTINCT file_id FROM ev WHERE kind IN ('changed', 'saved', 'removed')), opened AS (SELECT p_partkey AS f FROM {part} WHERE p_partkey % 4 = 0)"


@query("H7_invalidate", f"""WITH RECURSIVE {EVENTS}, up(root, node) AS (SELECT file_id, file_id FROM moved UNION SELECT root, src FROM up JOIN {{x2}} ON dst = node), top AS (SELECT DISTINCT src FROM {{x2}} WHERE src NOT IN (SELECT dst FROM {{x2}}))
SELECT 'start_session' AS effect, file_id FROM ev WHERE kind = 'opened' UNION SELECT 'end_session', file_id FROM ev WHERE kind = 'closed' UNION SELECT 'reindex', file_id FROM ev WHERE kind IN ('closed', 'saved') UNION SELECT 'drop_index', file_id FROM ev WHERE kind = 'removed'
UNION SELECT 'reindex', file_id FROM ev WHERE kind = 'changed' AND file_id NOT IN (SELECT f FROM opened)
UNION SELECT CASE WHEN node IN (SELECT f FROM opened) THEN 'recompile' ELSE 'reindex' END, node FROM up WHERE node <> root AND node IN (SELECT src FROM top)
UNION SELECT 'drop_context', src FROM {{x2}} WHERE dst IN (SELECT file_id FROM moved) UNION SELECT 'rebuild_module', node FROM up""")
def _(t):
    # All events, spread over all of part.
    return invalidated(t, t.events.crossJoin(F.broadcast(t.part.agg(F.count("*").alias("parts")))), F.col("parts"))


def invalidated(t, events, files):
    kind = F.when(F.col("event_type") == "click", "changed").when(F.col("event_type") == "view", "saved").when(F.col("event_type") == "error", "removed").when(F.col("event_type") == "signup", "opened").otherwise("closed")
    events = events.select(kind.alias("kind"), (1 + F.col("event_id") % files).alias("file_id"))
    chains = t.x2.select(F.col("src").alias("header"), F.col("dst").alias("node"))
    return c.invalidate(events, t.x2, chains, t.x2, t.part.filter("p_partkey % 4 = 0").select(F.col("p_partkey").alias("file_id")))


# Events of every kind over all files; every file has its buffer, disk and context by its number.
KINDS = ["opened", "edited", "saved", "closed", "changed", "removed", "command_added", "command_changed", "command_removed", "crashed", "evicted"]


@query("H7_file_event_effects", f"""WITH RECURSIVE n AS (SELECT count(*) AS parts FROM {{part}}), ev AS (SELECT event_id AS seq, event_id % parts AS f, {KINDS}[1 + event_id % 11] AS kind FROM {{events}}, n),
la AS (SELECT kind, f, max(seq) AS seq, f % 4 = 0 AS o FROM ev GROUP BY kind, f), casc AS (SELECT f, max(seq) AS seq FROM la WHERE kind = 'saved' OR (kind = 'changed' AND NOT o) GROUP BY f),
moved AS (SELECT f, max(seq) AS seq FROM (SELECT * FROM casc UNION ALL SELECT f, seq FROM la WHERE kind = 'removed') z GROUP BY f), given AS (SELECT f, max(seq) AS seq FROM la WHERE kind LIKE 'command%' GROUP BY f),
fe AS (SELECT src, dst FROM {{x2}} WHERE src % 11 <> 0), ctx AS (SELECT src AS header, dst AS host FROM {{x2}} WHERE config_id = 1 AND ord = 1 AND src % 3 = 1),
up(node, seq, own) AS (SELECT f, seq, TRUE FROM moved UNION SELECT src, seq, FALSE FROM up JOIN {{x2}} ON dst = node), uf(node, seq, own) AS (SELECT f, seq, TRUE FROM moved UNION SELECT src, seq, FALSE FROM uf JOIN fe ON dst = node),
md(node, seq) AS (SELECT f, seq FROM (SELECT * FROM moved UNION ALL SELECT * FROM given) z WHERE f % 3 <> 1 UNION SELECT src, seq FROM md JOIN {{x2}} ON dst = node WHERE src % 3 <> 1),
cascaded AS (SELECT node AS f, seq FROM up WHERE NOT own AND node NOT IN (SELECT dst FROM {{x2}}) UNION ALL SELECT node, seq FROM uf WHERE NOT own AND node NOT IN (SELECT dst FROM fe) UNION ALL SELECT node, seq FROM md),
through AS (SELECT src AS f, seq FROM casc JOIN {{x2}} ON dst = f), bor AS (SELECT header AS f, seq FROM given JOIN ctx ON host = f),
ef AS (SELECT 'reset_header_mode' AS effect, f, seq FROM casc UNION ALL SELECT 'reset_trial', f, seq FROM casc UNION ALL SELECT 'content', f, seq FROM la WHERE (kind = 'saved' AND o) OR kind = 'changed' OR kind IN ('command_added', 'command_changed') OR (kind = 'closed' AND f % 10 <> 0 AND f % 7 <> 0)
UNION ALL SELECT 'recompile', f, seq FROM la WHERE o AND ((kind = 'saved' AND f % 8 <> 0) OR kind = 'changed' OR kind LIKE 'command%') UNION ALL SELECT 'clear', f, seq FROM la WHERE kind = 'removed' OR (kind = 'closed' AND f % 10 = 0)
UNION ALL SELECT 'dependent', f, seq FROM la WHERE kind = 'closed' AND f % 10 <> 0 AND f % 7 = 0 UNION ALL SELECT 'drop_index', f, seq FROM la WHERE kind IN ('command_added', 'command_changed') UNION ALL SELECT 'lost', f, seq FROM la WHERE kind IN ('crashed', 'evicted')
UNION ALL SELECT CASE WHEN f % 4 = 0 THEN 'recompile' ELSE 'dependent' END, f, seq FROM cascaded UNION ALL SELECT 'force_revalidate', f, seq FROM through UNION ALL SELECT 'reset_header_mode', f, seq FROM through UNION ALL SELECT 'dependent', f, seq FROM through WHERE f % 4 <> 0
UNION ALL SELECT 'drop_context', f, seq FROM bor UNION ALL SELECT 'drop_index', f, seq FROM bor UNION ALL SELECT CASE WHEN f % 4 = 0 THEN 'recompile' ELSE 'content' END, f, seq FROM bor UNION ALL SELECT 'drop_context', f, seq FROM given WHERE f IN (SELECT header FROM ctx)),
la2 AS (SELECT effect, f, max(seq) AS seq FROM ef GROUP BY effect, f), cl AS (SELECT f AS g, seq AS c FROM la2 WHERE effect = 'clear'), st AS (SELECT effect, f FROM la2 LEFT JOIN cl ON g = f WHERE effect NOT IN ('content', 'dependent', 'drop_index') OR c IS NULL OR seq > c)
SELECT effect, f AS file_id FROM st WHERE effect NOT IN ('content', 'dependent', 'clear') UNION ALL SELECT 'reindex_content', f FROM st WHERE effect = 'content' UNION ALL SELECT 'reindex_dependent', f FROM st WHERE effect = 'dependent' AND f NOT IN (SELECT f FROM st WHERE effect = 'content')
UNION ALL SELECT 'clear_reindex', f FROM st WHERE effect = 'clear' AND f NOT IN (SELECT f FROM st WHERE effect IN ('content', 'dependent')) UNION ALL SELECT unnest(['recheck_contexts', 'reschedule_indexing']), NULL""")
def _(t):
    events = t.events.crossJoin(F.broadcast(t.part.agg(F.count("*").alias("parts"))))  # one row
    kind = F.element_at(F.array(*map(F.lit, KINDS)), (1 + F.col("event_id") % 11).cast("int"))
    events = events.select(F.col("event_id").alias("seq"), kind.alias("kind"), (F.col("event_id") % F.col("parts")).alias("file_id"))
    of = lambda condition, *columns: t.x1.filter(condition).select("file_id", *columns)
    chains, contexts = t.x2.select(F.col("src").alias("header"), F.col("dst").alias("node")), t.x2.filter("config_id = 1 and ord = 1 and src % 3 = 1").select(F.col("src").alias("header"), F.col("dst").alias("host"))
    opened, disk = of("file_id % 4 = 0", (F.col("file_id") % 8 == 0).alias("same")), of("file_id % 10 <> 0", (F.col("file_id") % 7 == 0).alias("current"))
    return c.file_event_effects(events, t.x2, t.x2.filter("src % 11 <> 0"), t.x2.filter("src % 3 <> 1 and dst % 3 <> 1"), of("file_id % 3 <> 1"), chains, contexts, opened, disk)


@query("H8_reduce_reindex_effects", "WITH e AS (SELECT user_id AS file_id, event_id AS seq, CASE event_type WHEN 'click' THEN 'enqueue' WHEN 'view' THEN 'clear' ELSE 'drop' END AS effect FROM {events} WHERE event_type IN ('click', 'view', 'error')), p AS (SELECT file_id, max(seq) FILTER (effect = 'enqueue') AS e, max(seq) FILTER (effect = 'clear') AS c, max(seq) FILTER (effect = 'drop') AS d FROM e GROUP BY file_id) SELECT file_id, CASE WHEN coalesce(e, -1) > coalesce(c, -1) THEN 'enqueue' ELSE 'clear' END AS effect FROM p WHERE e IS NOT NULL OR c IS NOT NULL UNION ALL SELECT file_id, 'drop' FROM p WHERE d > coalesce(c, -1)")
def _(t):
    effect = F.when(F.col("event_type") == "click", "enqueue").when(F.col("event_type") == "view", "clear").otherwise("drop")
    return c.reduce_reindex_effects(t.events.filter("event_type in ('click', 'view', 'error')").select(F.col("user_id").alias("file_id"), F.col("event_id").alias("seq"), effect.alias("effect")))


@query("H9_mass_removal", "SELECT src, config_id, dst FROM {x2} WHERE src NOT IN (SELECT l_partkey FROM {lineitem} WHERE l_quantity > 48)")
def _(t):
    return c.mass_removal(t.x2, t.lineitem.filter("l_quantity > 48").select(F.col("l_partkey").alias("file_id"))).select("src", "config_id", "dst")


def stepwise(events: str, start: dict[str, str], steps: list[dict[str, str]], out: str) -> str:
    """SQL of a fold: events (doc, seq, ...) are numbered by seq in each doc, and a recursive query
    carries the state columns from one to the next. start has their first values; each of steps
    replaces some of them from those before it; out are the columns of each event's row."""
    names, inner = list(start), "SELECT e.*, {} FROM {}"
    first = inner.format(", ".join(f"{v} AS {k}" for k, v in start.items()), "e WHERE rn = 1")
    more = inner.format(", ".join(f"s.{k}" for k in names), "s JOIN e ON e.doc = s.doc AND e.rn = s.rn + 1")
    for step in steps:
        kept = ", ".join(f"({step[k]}) AS {k}" if k in step else k for k in names)
        first, more = (f"SELECT doc, seq, rn, {{own}}, {kept} FROM ({q})" for q in (first, more))
    return f"WITH RECURSIVE ev AS ({events}), e AS (SELECT *, row_number() OVER (PARTITION BY doc ORDER BY seq) AS rn FROM ev), s AS ({first} UNION ALL {more}) SELECT {out}"


# Each event that works on a unit is two: the slot is taken, and what comes of it.
WORK = """SELECT user_id AS doc, 2 * event_id AS seq, CASE WHEN event_type IN ('click', 'view') THEN 'enqueue' WHEN event_type = 'signup' AND event_id % 7 = 0 THEN 'drop' ELSE 'take' END AS kind,
  CASE WHEN event_type = 'click' AND event_id % 4 = 0 THEN 'ContentChanged' ELSE 'DepsOnly' END AS reason FROM {events}
UNION ALL SELECT user_id, 2 * event_id + 1, CASE WHEN event_type = 'error' THEN 'crash' WHEN event_type = 'signup' THEN 'preempt' WHEN event_id % 3 = 0 THEN 'done' ELSE 'crash' END, NULL FROM {events} WHERE event_type NOT IN ('click', 'view')"""
OWED, FAILED = "reason0 IS NOT NULL", "kind IN ('crash', 'preempt')"
OUTCOME = f"""CASE WHEN kind = 'enqueue' THEN CASE WHEN queued THEN 'merged' ELSE 'queued' END WHEN kind = 'take' THEN CASE WHEN {OWED} AND queued THEN 'taken' ELSE 'idle' END
  WHEN kind = 'drop' THEN 'dropped' WHEN reason0 IS NULL THEN CASE WHEN kind = 'done' THEN 'kept' ELSE 'dropped' END
  WHEN flight < content THEN CASE WHEN kind = 'done' THEN 'discarded' ELSE 'superseded' END WHEN kind = 'done' THEN CASE WHEN flight = ticket THEN 'cleared' ELSE 'kept' END
  WHEN kind = 'crash' AND crashes >= 3 THEN 'gave up' ELSE 'requeued' END"""
GONE = "outcome IN ('cleared', 'gave up') OR kind = 'drop'"
LEDGER_STEPS = [
    {"outcome": OUTCOME},
    # The reason with which it is owed again.
    {"owe": "CASE WHEN kind = 'enqueue' THEN reason WHEN outcome = 'requeued' THEN CASE WHEN flight = content THEN 'ContentChanged' ELSE reason0 END END"},
    {
        "content": f"CASE WHEN {GONE} THEN -1 WHEN owe = 'ContentChanged' THEN seq WHEN owe IS NOT NULL AND reason0 IS NULL THEN -1 ELSE content END",
        "crashes": f"CASE WHEN {GONE} THEN 0 WHEN outcome = 'requeued' THEN crashes + CASE WHEN kind = 'crash' THEN 1 ELSE 0 END WHEN owe = 'ContentChanged' OR reason0 IS NULL THEN 0 ELSE crashes END",
        "flight": "CASE WHEN outcome = 'taken' THEN ticket ELSE flight END",
        "ticket": f"CASE WHEN {GONE} THEN -1 WHEN owe IS NOT NULL THEN seq ELSE ticket END",
        "reason0": f"CASE WHEN {GONE} THEN NULL WHEN owe IS NULL THEN reason0 WHEN reason0 IS NULL OR NOT queued OR owe = 'ContentChanged' THEN owe ELSE reason0 END",
        "queued": f"CASE WHEN {GONE} OR outcome = 'taken' THEN FALSE WHEN owe IS NOT NULL THEN TRUE ELSE queued END",
    },
]
LEDGER_START = {"reason0": "CAST(NULL AS VARCHAR)", "ticket": "CAST(-1 AS BIGINT)", "content": "CAST(-1 AS BIGINT)", "crashes": "0", "queued": "FALSE", "flight": "CAST(-1 AS BIGINT)", "outcome": "CAST(NULL AS VARCHAR)", "owe": "CAST(NULL AS VARCHAR)"}
LEDGER = stepwise(WORK, LEDGER_START, LEDGER_STEPS, "{}").replace("{own}", "kind, reason")


def work(t):
    kind, id_ = F.col("event_type"), F.col("event_id")
    first = F.struct((2 * id_).alias("seq"), F.when(kind.isin("click", "view"), "enqueue").when((kind == "signup") & (id_ % 7 == 0), "drop").otherwise("take").alias("kind"))
    after = F.when(kind == "error", "crash").when(kind == "signup", "preempt").when(id_ % 3 == 0, "done").otherwise("crash")
    second = F.struct((2 * id_ + 1).alias("seq"), after.alias("kind"))
    rows = t.events.select(F.col("user_id").alias("doc"), F.when((kind == "click") & (id_ % 4 == 0), "ContentChanged").otherwise("DepsOnly").alias("reason"), F.explode(F.when(kind.isin("click", "view"), F.array(first)).otherwise(F.array(first, second))).alias("e"))
    return rows.select("doc", "e.seq", "e.kind", "reason")


@query("H10_pending_ledger", LEDGER.replace("SELECT {}", "SELECT doc, seq, outcome FROM s"))
def _(t):
    return folds.run_batch(work(t), "doc", "seq", folds.PENDING)


@query("H11_requeue_verdict", LEDGER.replace("SELECT {}", f"SELECT doc, seq, outcome AS verdict FROM s WHERE {FAILED}"))
def _(t):
    return folds.run_batch(work(t), "doc", "seq", folds.REQUEUE)


CRASHED = "SELECT doc, seq, kind, changed, seq % 3 = 0 AS asked, CASE WHEN seq % 4 = 0 THEN '' ELSE concat('w', CAST(floor(seq / 200) AS BIGINT)) END AS death FROM {x8}"
COUNTS = "kind = 'crash' AND (death = '' OR death <> last)"
QUARANTINE = stepwise(
    CRASHED, {"streak": "0", "strikes": "0", "inherited": "0", "probe": "FALSE", "told": "FALSE", "last": "''", "announce": "FALSE"},
    [
        {"probe": "CASE WHEN kind = 'reset' THEN FALSE WHEN kind = 'edit' AND changed AND streak + strikes >= 2 THEN TRUE WHEN kind = 'dispatch' AND streak + strikes >= 2 AND CASE WHEN asked THEN strikes > 0 ELSE streak > 0 END THEN FALSE ELSE probe END"},
        {
            "streak": f"CASE WHEN kind = 'reset' THEN 0 WHEN asked THEN streak WHEN {COUNTS} THEN streak + 1 WHEN kind = 'land' THEN streak - least(inherited, streak) ELSE streak END",
            "strikes": f"CASE WHEN kind = 'reset' THEN 0 WHEN NOT asked THEN strikes WHEN {COUNTS} THEN strikes + 1 WHEN kind = 'land' THEN 0 ELSE strikes END",
            "inherited": "CASE WHEN kind = 'reset' THEN 0 WHEN asked THEN inherited WHEN kind = 'dispatch' THEN streak WHEN kind = 'land' THEN 0 ELSE inherited END",
            "last": "CASE WHEN kind = 'reset' THEN '' WHEN kind = 'crash' AND death <> '' THEN death ELSE last END",
        },
        {"probe": "probe AND NOT (kind = 'land' AND streak + strikes < 2)", "told": "told AND NOT (kind = 'reset' OR kind = 'land' AND streak + strikes < 2)"},
        {"announce": "streak + strikes >= 2 AND NOT told", "told": "told OR streak + strikes >= 2"},
    ],
    "doc, seq, streak + strikes AS crashes, streak + strikes >= 2 AND NOT probe AS blocked, announce FROM s",
).replace("{own}", "kind, changed, asked, death")


@query("H12_quarantine", QUARANTINE)
def _(t):
    death = F.when(F.col("seq") % 4 == 0, "").otherwise(F.concat(F.lit("w"), F.floor(F.col("seq") / 200).cast("string")))
    return folds.run_batch(t.x8.withColumns({"query": F.when(F.col("seq") % 3 == 0, F.lit("hover")), "death": death}), "doc", "seq", folds.QUARANTINE)


BUDGET = stepwise(
    "SELECT doc, seq, kind, CAST(seq AS DOUBLE) AS secs FROM {x8}", {"crashes": "0", "last": "CAST(0 AS DOUBLE)"},
    [{"crashes": "CASE WHEN kind = 'crash' THEN crashes + 1 WHEN kind = 'land' OR crashes >= 2 AND secs - last >= 300 THEN 0 ELSE crashes END", "last": "CASE WHEN kind = 'crash' THEN secs ELSE last END"}],
    "doc, seq, crashes >= 2 AS blocked FROM s",
).replace("{own}", "kind, secs")


@query("H13_crash_budget", BUDGET)
def _(t):
    return folds.run_batch(t.x8.withColumn("at", F.col("seq").cast("double")), "doc", "seq", folds.CRASH_BUDGET)


LIMITED = "SELECT seq, topic AS id, CASE WHEN n <= 8 THEN 'pass' ELSE 'suppressed' END AS action FROM (SELECT seq, topic, row_number() OVER (PARTITION BY topic ORDER BY seq) AS n FROM {x7}) z WHERE n <= 9"


@query("H14_rate_limit", LIMITED)
def _(t):
    return c.rate_limit(t.x7.select("seq", F.col("topic").alias("id")))


@query("H15_fold_edits", "SELECT doc, seq, CAST(seq AS BIGINT) AS version, 1 AS generation, length(text) AS length, seq > 0 AND text = lag(text) OVER (PARTITION BY doc ORDER BY seq) AS noop FROM {x10}")
def _(t):
    return folds.run_batch(t.x10, "doc", "seq", folds.EDITS)


@query("H16_evict_lru", "WITH p AS (SELECT o_orderpriority AS namespace, o_custkey AS key, CAST(sum(o_totalprice) AS BIGINT) AS size, max(o_orderkey) AS atime FROM (SELECT *, CAST(floor(o_totalprice) AS BIGINT) AS o_totalprice FROM (SELECT o_orderpriority, o_custkey, o_orderkey, o_totalprice FROM {orders}) y) z GROUP BY 1, 2), t AS (SELECT namespace, sum(size) AS total FROM p GROUP BY 1), f AS (SELECT *, coalesce(sum(size) OVER (PARTITION BY namespace ORDER BY atime, key ROWS BETWEEN UNBOUNDED PRECEDING AND 1 PRECEDING), 0) AS b FROM p WHERE key % 10 <> 0) SELECT f.namespace, key, size FROM f JOIN t USING (namespace) WHERE total - b > 3000000".replace("SELECT *, CAST(floor(o_totalprice) AS BIGINT) AS o_totalprice FROM (SELECT o_orderpriority, o_custkey, o_orderkey, o_totalprice FROM {orders}) y", "SELECT o_orderpriority, o_custkey, o_orderkey, CAST(floor(o_totalprice) AS BIGINT) AS o_totalprice FROM {orders}"))
def _(t):
    entries = t.orders.select(F.col("o_orderpriority").alias("namespace"), F.col("o_custkey").alias("key"), F.floor("o_totalprice").alias("size"), F.col("o_orderkey").alias("atime"))
    return c.evict_lru(entries, 3_000_000, entries.filter("key % 10 = 0"))


@query("H18_attach_notes", "WITH g AS (SELECT *, sum(CASE WHEN severity <> 'note' THEN 1 ELSE 0 END) OVER (PARTITION BY file_id ORDER BY seq) AS grp FROM {diagnostics} WHERE severity <> 'ignored') SELECT file_id, min(seq) AS seq, min_by(severity, seq) AS severity, min_by(code, seq) AS code, count(*) - 1 AS notes FROM g WHERE grp > 0 GROUP BY file_id, grp")
def _(t):
    return c.attach_notes(t.diagnostics)


TREE = "tree AS (SELECT o_orderkey AS tu, n AS node, CASE WHEN n > 1 THEN n // 2 END AS parent, o_custkey + n AS line FROM {orders}, range(0, 8) r(n))"


@query("H19_hoist_header_diagnostics", f"WITH {TREE} SELECT d.file_id AS tu, seq, d.node, top.line AS main_line FROM {{diagnostics}} d JOIN tree top ON top.tu = d.file_id AND top.node = (CASE WHEN d.node = 0 THEN 0 ELSE 1 END)")
def _(t):
    n = F.col("node")
    tree = t.orders.withColumn("node", F.explode(F.sequence(F.lit(0).cast("long"), F.lit(7).cast("long")))).select(F.col("o_orderkey").alias("tu"), "node", F.when(n > 1, F.floor(n / 2)).alias("parent"), (F.col("o_custkey") + n).alias("line"))
    return c.hoist_header_diagnostics(t.diagnostics.select(F.col("file_id").alias("tu"), "seq", "node"), tree).select("tu", "seq", "node", "main_line")


@query("H20_tag_diagnostics", "SELECT file_id, seq, code, CASE WHEN code = 'code1' THEN 'deprecated' WHEN code IN ('code2', 'code3') THEN 'unused' END AS tag FROM {diagnostics}")
def _(t):
    return c.tag_diagnostics(t.diagnostics, ["code1"], ["code2", "code3"]).select("file_id", "seq", "code", "tag")
