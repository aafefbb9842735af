"""Queries of symloom.operators.commands over derived compile commands."""

from __future__ import annotations

from pyspark.sql import functions as F

from symloom.functions.lineage import shared_folder
from symloom.operators import commands as c
from symloom.operators import graph as g

from .registry import query

CANON = "concat('clang++ -O', p_size % 3, ' -Wall')"
PATCH = "concat('-I/build', p_size % 3, '/inc', p_size % 4, ' -I/abs -DA=', p_size % 2, ' -DALGERIA')"
CFG = f"cfg AS (SELECT concat('/src/', lower(replace(p_brand,'#','')), '/f', p_partkey, '.cpp') AS file, concat('/build', p_size % 3) AS directory, {CANON} AS canonical, {PATCH} AS patch FROM {{part}})"


def entries(t):
    return c.cdb_entries(t.commands.withColumn("arguments", F.lit(None).cast("array<string>")))


def classified(t):
    return c.classify_flags(entries(t))


@query("A1_read_cdb", "SELECT file, directory, command AS args FROM {commands}")
def _(t):
    path = shared_folder(t.spark, "cdb")
    t.commands.write.json(path)
    rows = t.spark.read.schema(c.CDB_SCHEMA).json(path)
    return c.cdb_entries(rows).select("file", "directory", F.array_join("args", " ").alias("args"))


@query("B1_classify_flags", f"WITH {CFG} SELECT * FROM cfg")
def _(t):
    return classified(t).select("file", "directory", F.array_join("canonical", " ").alias("canonical"), F.array_join("patch", " ").alias("patch"))


@query("B2_unique_configs", f"WITH {CFG} SELECT directory, canonical, patch, count(DISTINCT file) AS files, min(file) AS example FROM cfg GROUP BY ALL")
def _(t):
    return c.unique_configs(classified(t)).select("directory", F.array_join("canonical", " ").alias("canonical"), F.array_join("patch", " ").alias("patch"), "files", "example")


@query("B3_config_dedup_stats", f"WITH {CFG} SELECT count(*) AS entries, count(DISTINCT (directory, canonical, patch)) AS contexts, count(DISTINCT canonical) AS canonicals, count(DISTINCT (directory, canonical, patch)) / count(*) AS ratio FROM cfg")
def _(t):
    return c.config_dedup_stats(classified(t))


@query("B3_top_canonicals", f"WITH {CFG} SELECT canonical, count(*) AS count FROM cfg GROUP BY 1 ORDER BY 2 DESC, 1 LIMIT 5")
def _(t):
    return c.top_canonicals(classified(t))


@query("B4_command_hash", f"WITH {CFG} SELECT file, md5(concat(replace(canonical, ' ', chr(0)), chr(0), directory)) AS hash FROM cfg")
def _(t):
    return classified(t).select("file", c.command_hash(F.col("canonical"), F.col("directory")).alias("hash"))


SNAP = "s AS (SELECT file, side, string_agg(md5(cmd), ' ' ORDER BY md5(cmd)) AS hashes FROM {x6} GROUP BY file, side)"


def snapshot(t, side):
    return c.command_hash_snapshot(t.x6.filter(F.col("side") == side).select("file", F.md5("cmd").alias("hash")))


@query("B5_command_hash_snapshot", f"WITH {SNAP} SELECT file, hashes FROM s WHERE side = 'before'")
def _(t):
    return snapshot(t, "before").select("file", F.array_join("hashes", " ").alias("hashes"))


DIFF = "d AS (SELECT file, CASE WHEN a.hashes IS NULL THEN 'added' WHEN b.hashes IS NULL THEN 'removed' WHEN a.hashes <> b.hashes THEN 'changed' END AS change FROM (SELECT * FROM s WHERE side = 'before') a FULL JOIN (SELECT * FROM s WHERE side = 'after') b USING (file))"


@query("B6_cdb_diff", f"WITH {SNAP}, {DIFF} SELECT * FROM d WHERE change IS NOT NULL")
def _(t):
    return c.cdb_diff(snapshot(t, "before"), snapshot(t, "after"))


REGEX = r"concat('^', replace(replace(replace(replace(replace(pattern, '.', '\.'), '**/', chr(1)), '*', '[^/]*'), '?', '[^/]'), chr(1), '(?:.*/)?'), '$')"
HITS = rf"hits AS (SELECT path, rule_ord, append, remove FROM {{x1}}, {{rules}} WHERE regexp_matches(path, {REGEX}))"


@query("B7_match_rules", f"""WITH {HITS} SELECT path, string_agg(append, ' ' ORDER BY rule_ord) FILTER (later = 0) AS appended, string_agg(remove, ' ' ORDER BY rule_ord) AS removed FROM (SELECT a.*, (SELECT count(*) FROM hits h WHERE h.path = a.path AND h.rule_ord > a.rule_ord AND h.remove = a.append) AS later FROM hits a) z GROUP BY path""")
def _(t):
    m = c.match_rules(t.x1, t.rules)
    return m.select("path", F.nullif(F.array_join(c.appended(F.col("rules")), " "), F.lit("")).alias("appended"), F.array_join(c.removed(F.col("rules")), " ").alias("removed"))


@query("B8_rules_hash", f"WITH {HITS} SELECT path, CASE WHEN h IS NULL THEN '' ELSE md5(h) END AS hash FROM {{x1}} LEFT JOIN (SELECT path, string_agg(concat(append, chr(0), remove), chr(1) ORDER BY rule_ord) AS h FROM hits GROUP BY path) z USING (path)")
def _(t):
    return t.x1.join(c.match_rules(t.x1, t.rules), "path", "left").select("path", c.rules_hash(F.col("rules")).alias("hash"))


@query("B9_effective_command", f"""WITH {HITS}, m AS (SELECT path, list(remove) AS gone, string_agg(append, ' ' ORDER BY rule_ord) FILTER (later = 0) AS more FROM (SELECT a.*, (SELECT count(*) FROM hits h WHERE h.path = a.path AND h.rule_ord > a.rule_ord AND h.remove = a.append) AS later FROM hits a) z GROUP BY path)
SELECT path, concat_ws(' ', array_to_string(list_filter(CASE WHEN command IS NULL AND (path LIKE '%.cpp' OR path LIKE '%.hpp' OR path LIKE '%.cc') THEN ['clang++', '-std=c++20'] WHEN command IS NULL THEN ['clang'] ELSE str_split(command, ' ') END, lambda x: NOT list_contains(coalesce(gone, []), x)), ' '), more) AS args FROM {{x1}} LEFT JOIN {{commands}} ON file = path LEFT JOIN m USING (path)""")
def _(t):
    return c.effective_command(t.x1, entries(t), c.match_rules(t.x1, t.rules)).select("path", F.array_join("args", " ").alias("args"))


@query("B10_search_dirs", """WITH d AS (SELECT o_orderkey AS config_id, 0 AS g, 'quoted' AS grp, 0 AS k, concat('q', o_custkey % 3) AS dir FROM {orders} UNION ALL SELECT o_orderkey, 0, 'quoted', 3, concat('q', o_custkey % 3) FROM {orders}
UNION ALL SELECT o_orderkey, 1, 'angled', 1, concat('a', o_custkey % 5) FROM {orders} UNION ALL SELECT o_orderkey, 1, 'angled', 2, concat('a', o_orderkey % 5) FROM {orders} UNION ALL SELECT o_orderkey, 2, 'system', 0, concat('a', o_orderkey % 7) FROM {orders}),
n AS (SELECT *, row_number() OVER (PARTITION BY config_id, dir, g > 0 ORDER BY g, k) AS n FROM d) SELECT config_id, row_number() OVER (PARTITION BY config_id ORDER BY g, k) - 1 AS idx, grp, dir FROM n WHERE g = 0 OR n = 1""")
def _(t):
    s = lambda p, e: F.concat(F.lit(p), e.cast("string"))
    cust, order = F.col("o_custkey"), F.col("o_orderkey")
    args = F.array(F.lit("-iquote"), s("q", cust % 3), F.concat(F.lit("-isystem"), s("a", order % 7)), F.lit("-I"), s("a", cust % 5), F.concat(F.lit("-I"), s("a", order % 5)), F.concat(F.lit("-iquote"), s("q", cust % 3)))
    return c.search_dirs(t.orders.select(order.alias("config_id"), args.alias("args")))


@query("B11_has_entry", "SELECT path, path IN (SELECT file FROM {commands}) AS has_entry FROM {x1}")
def _(t):
    return c.has_entry(t.x1, entries(t))


@query("B11_lookup", "SELECT file, directory FROM {x1} JOIN {commands} ON file = path")
def _(t):
    return c.lookup(t.x1, entries(t)).select("file", "directory")


@query("B12_resolve_command", r"""WITH p AS (SELECT DISTINCT a.path AS header, b.path AS host FROM {x2} JOIN {x1} a ON a.file_id = dst JOIN {x1} b ON b.file_id = src),
q AS (SELECT *, regexp_extract(header, '([^/]*)\.[^.]*$', 1) <> regexp_extract(host, '([^/]*)\.[^.]*$', 1) AS s, regexp_extract(header, '^(.*)/', 1) <> regexp_extract(host, '^(.*)/', 1) AS d, least(length(header), length(host)) AS n FROM p WHERE host IN (SELECT file FROM {commands})),
r AS (SELECT *, n - coalesce((SELECT min(i) - 1 FROM range(1, n + 1) z(i) WHERE substr(header, i, 1) <> substr(host, i, 1)), n) AS rest FROM q),
best AS (SELECT header, min_by(host, (s, d, rest, host)) AS host FROM r GROUP BY header)
SELECT path, CASE WHEN path IN (SELECT file FROM {commands}) THEN 'exact' WHEN host IS NOT NULL THEN 'host' ELSE 'fallback' END AS tier, CASE WHEN path IN (SELECT file FROM {commands}) THEN path ELSE host END AS host FROM {x1} LEFT JOIN best ON header = path""")
def _(t):
    a, b = t.x1.select(F.col("file_id").alias("dst"), F.col("path").alias("header")), t.x1.select(F.col("file_id").alias("src"), F.col("path").alias("host"))
    ranked = g.rank_hosts(t.x2.join(a, "dst").join(b, "src").select("header", "host").distinct())
    none = t.x1.select("path", F.col("path").alias("host")).filter("false")
    return c.resolve_command(t.x1, none, entries(t), ranked)


@query("B14_reconcile_snapshot", f"""WITH {SNAP}, {DIFF}, e AS (SELECT file, change AS verdict FROM d WHERE change IS NOT NULL),
h AS (SELECT s_suppkey AS host, -s_suppkey AS file, s_suppkey % 4 = 0 AS r0, s_suppkey % 8 = 0 AS r1, s_suppkey % 5 <> 0 AS reaches FROM {{supplier}})
SELECT file, verdict FROM e UNION SELECT file, 'changed' FROM h WHERE r0 <> r1 OR NOT reaches OR host IN (SELECT file FROM e WHERE verdict <> 'added') OR host NOT IN (SELECT file FROM s WHERE side = 'after')""")
def _(t):
    old, new = (snapshot(t, x).withColumn("rules", F.lit("")) for x in ("before", "after"))
    k = F.col("s_suppkey")
    headers = t.supplier.select(k.alias("host"), (-k).alias("file"), (k % 4 == 0).alias("rules"), (k % 8 == 0).alias("new_rules"), (k % 5 != 0).alias("reaches"))
    return c.reconcile_snapshot(old, new, headers)


@query("B14_owed_rows", "SELECT c_custkey AS file FROM {customer} WHERE (c_custkey % 3 = 0 OR c_mktsegment = 'BUILDING') AND c_custkey NOT IN (SELECT o_custkey FROM {orders} WHERE o_orderstatus = 'P') AND c_custkey NOT IN (SELECT o_custkey FROM {orders} WHERE o_orderpriority LIKE '1%' AND o_orderkey % 4 = 0) AND c_nationkey <> 7 AND c_acctbal >= 0")
def _(t):
    hashes = F.when(F.col("c_custkey") % 3 == 0, F.array().cast("array<string>")).when(F.col("c_mktsegment") != "BUILDING", F.array("c_name"))
    of = lambda rows, key, condition: rows.filter(condition).select(F.col(key).alias("file"))
    entries, manifests = of(t.orders, "o_custkey", "o_orderstatus = 'P'"), of(t.orders, "o_custkey", "o_orderpriority like '1%' and o_orderkey % 4 = 0")
    return c.owed_rows(t.customer.select(F.col("c_custkey").alias("file"), hashes.alias("hashes")), entries, manifests, of(t.customer, "c_custkey", "c_nationkey = 7"), of(t.customer, "c_custkey", "c_acctbal >= 0"))
