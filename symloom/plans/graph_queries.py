"""Queries of symloom.operators.graph over the derived include graph."""

from __future__ import annotations

from pyspark.sql import functions as F

from symloom.operators import graph as g
from symloom.operators.scan import dir_listing, resolve_includes, scan_includes

from .registry import query

TOPS = "tops AS (SELECT DISTINCT src AS file_id FROM {x2} WHERE src NOT IN (SELECT dst FROM {x2}))"
UP = "up(root, node) AS (SELECT DISTINCT file_id, file_id FROM {x1} UNION SELECT root, src FROM up JOIN {x2} ON dst = node)"
CYCLE = "deps AS (SELECT src, dst FROM {x2} UNION ALL SELECT 4, max(p_partkey) FROM {part})"


@query("E1_modules_of", "SELECT DISTINCT name, file_id FROM {x3}")
def _(t):
    return g.modules_of(t.x3)


@query("E1_lookup_module", "SELECT DISTINCT name, file_id FROM {x3} WHERE name LIKE 'm.standard%'")
def _(t):
    return g.lookup_module(t.x3, t.x3.filter(F.col("name").startswith("m.standard")))


@query("E2_set_includes", """SELECT src, config_id, dst, conditional, ord FROM {x2} WHERE NOT (config_id = 1 AND src % 6 = 0)
UNION ALL SELECT src, config_id, CAST(1 AS BIGINT), TRUE, 1 FROM {x2} WHERE config_id = 1 AND src % 12 = 0""")
def _(t):
    owned = t.x2.filter("config_id = 1 and src % 6 = 0")
    fresh = owned.filter("src % 12 = 0").select("src", "config_id", F.lit(1).cast("long").alias("dst"), F.lit(True).alias("conditional"), F.lit(1).alias("ord"))
    return g.set_includes(t.x2, fresh, owned)


@query("E3_all_includes", "SELECT src, dst, bool_and(conditional) AS conditional, min(ord) AS ord FROM {x2} GROUP BY src, dst")
def _(t):
    return g.all_includes(t.x2)


@query("E4_includers", "SELECT DISTINCT dst AS file_id, src AS includer FROM {x2}")
def _(t):
    return g.includers(t.x2)


@query("E5_all_files", "SELECT src AS file_id FROM {x2} UNION SELECT dst FROM {x2}")
def _(t):
    return g.all_files(t.x2)


@query("E6_graph_counts", "SELECT (SELECT count(DISTINCT src) FROM {x2}) AS files, (SELECT count(*) FROM {x2}) AS edges, (SELECT count(DISTINCT name) FROM {x3}) AS modules")
def _(t):
    return g.graph_counts(t.x2, t.x3)


@query("E7_host_sources", f"WITH RECURSIVE {UP}, {TOPS} SELECT root AS file_id, node AS host FROM up JOIN tops ON node = file_id WHERE node <> root")
def _(t):
    return g.host_sources(t.x1, t.x2)


@query("E8_include_chain", f"""WITH RECURSIVE {TOPS}, lv(root, node, depth) AS (SELECT file_id, file_id, 0 FROM tops UNION SELECT root, dst, depth + 1 FROM lv JOIN {{x2}} ON src = node),
best AS (SELECT root, node, min(depth) AS depth FROM lv GROUP BY root, node),
prev AS (SELECT b.root, b.node, b.depth, min(a.node) AS up FROM best b JOIN {{x2}} ON dst = b.node JOIN best a ON a.root = b.root AND a.node = src AND a.depth = b.depth - 1 GROUP BY b.root, b.node, b.depth),
walk(host, target, step, node) AS (SELECT root, node, depth, node FROM best WHERE node = 1 UNION ALL SELECT host, target, step - 1, up FROM walk JOIN prev ON prev.root = host AND prev.node = walk.node AND prev.depth = step)
SELECT host, target, step, node FROM walk""")
def _(t):
    return g.include_chain(g.roots(t.x2).select(F.col("file_id").alias("host"), F.lit(1).cast("long").alias("target")), t.x2)


@query("E9_reaches", f"WITH RECURSIVE {TOPS}, down(root, node) AS (SELECT file_id, file_id FROM tops UNION SELECT root, dst FROM down JOIN {{x2}} ON src = node) SELECT file_id AS host, CAST(5 AS BIGINT) AS target, EXISTS (SELECT 1 FROM down WHERE root = file_id AND node = 5) AS reaches FROM tops")
def _(t):
    return g.reaches(g.roots(t.x2).select(F.col("file_id").alias("host"), F.lit(5).cast("long").alias("target")), t.x2)


@query("E10_file_deps", """WITH RECURSIVE d(root, node, depth) AS (SELECT file_id, file_id, 0 FROM {x1} UNION SELECT root, dst, depth + 1 FROM d JOIN {x2} ON src = node WHERE depth < 2),
u(root, node, depth) AS (SELECT file_id, file_id, 0 FROM {x1} UNION SELECT root, src, depth + 1 FROM u JOIN {x2} ON dst = node WHERE depth < 2)
SELECT root AS file_id, 'includes' AS side, node AS other, min(depth) AS depth FROM d GROUP BY root, node HAVING min(depth) > 0 UNION ALL SELECT root, 'includers', node, min(depth) FROM u GROUP BY root, node HAVING min(depth) > 0""")
def _(t):
    return g.file_deps(t.x1, t.x2, depth=2)


@query("E11_impact_analysis", f"""WITH RECURSIVE {UP}, {TOPS}, hosts AS (SELECT root AS f, node AS host FROM up JOIN tops ON node = file_id WHERE node <> root), direct AS (SELECT DISTINCT dst AS f, src AS i FROM {{x2}} JOIN {{x1}} ON file_id = dst)
SELECT f AS file_id, 'direct' AS effect, CAST(i AS VARCHAR) AS value FROM direct
UNION ALL SELECT f, 'transitive', CAST(host AS VARCHAR) FROM hosts WHERE NOT EXISTS (SELECT 1 FROM direct d WHERE d.f = hosts.f AND d.i = hosts.host)
UNION ALL SELECT f, 'module', name FROM (SELECT f, host AS o FROM hosts UNION ALL SELECT file_id, file_id FROM {{x1}}) z JOIN {{x3}} m ON m.file_id = o""")
def _(t):
    return g.impact_analysis(t.x1, t.x2, t.x3)


LISTED = """ls AS (SELECT path, CASE WHEN m.name IS NOT NULL THEN 'module' WHEN path LIKE '%.h' THEN 'header' ELSE 'source' END AS kind, m.name AS module FROM {x1} f LEFT JOIN (SELECT file_id, max(name) AS name FROM {x3} GROUP BY file_id) m ON m.file_id = f.file_id WHERE f.file_id % 4 <> 0
UNION SELECT path, 'header', NULL FROM {x1} WHERE file_id % 4 = 0 AND path LIKE '%.h')"""


@query("E12_project_files", f"WITH {LISTED} SELECT * FROM ls")
def _(t):
    return g.project_files(t.x1.filter("file_id % 4 <> 0"), t.x1, t.x3)


@query("E12_project_headers", f"WITH {LISTED} SELECT path, module FROM ls WHERE kind = 'header'")
def _(t):
    return g.project_files(t.x1.filter("file_id % 4 <> 0"), t.x1, t.x3, "header").select("path", "module")


@query("E12_project_totals", f"WITH {LISTED} SELECT kind, count(*) AS total FROM ls GROUP BY kind UNION ALL SELECT 'all', count(*) FROM ls")
def _(t):
    return g.project_totals(g.project_files(t.x1.filter("file_id % 4 <> 0"), t.x1, t.x3))


@query("E13_module_map", "SELECT file_id, max(name) AS name FROM {x3} GROUP BY file_id")
def _(t):
    return g.module_map(t.x3)


@query("E14_rank_hosts", r"""WITH p AS (SELECT DISTINCT a.path AS header, b.path AS host FROM {x2} JOIN {x1} a ON a.file_id = dst JOIN {x1} b ON b.file_id = src WHERE a.path LIKE '%.h'),
q AS (SELECT *, regexp_extract(header, '([^/]*)\.[^.]*$', 1) <> regexp_extract(host, '([^/]*)\.[^.]*$', 1) AS s, regexp_extract(header, '^(.*)/', 1) <> regexp_extract(host, '^(.*)/', 1) AS d, least(length(header), length(host)) AS n FROM p),
r AS (SELECT *, n - coalesce((SELECT min(i) - 1 FROM range(1, n + 1) z(i) WHERE substr(header, i, 1) <> substr(host, i, 1)), n) AS rest FROM q)
SELECT header, host, row_number() OVER (PARTITION BY header ORDER BY s, d, rest, host) AS rank FROM r""")
def _(t):
    a, b = t.x1.select(F.col("file_id").alias("dst"), F.col("path").alias("header")), t.x1.select(F.col("file_id").alias("src"), F.col("path").alias("host"))
    return g.rank_hosts(t.x2.join(a, "dst").join(b, "src").filter("header like '%.h'").select("header", "host").distinct())


@query("E16_dependents_closure", "WITH RECURSIVE up(unit, dependent) AS (SELECT file_id, file_id FROM {x1} UNION SELECT unit, src FROM up JOIN {x2} ON dst = dependent) SELECT unit, dependent FROM up")
def _(t):
    return g.dependents_closure(t.x1, t.x2)


@query("E17_build_levels", f"""WITH RECURSIVE {CYCLE}, nodes AS (SELECT src AS n FROM deps UNION SELECT dst FROM deps),
top AS (SELECT max(p_partkey) AS m FROM {{part}}), bad(n) AS (SELECT DISTINCT d.src FROM deps d, top WHERE d.src = 4 AND d.dst = m AND EXISTS (WITH RECURSIVE w(x) AS (SELECT m FROM top UNION SELECT dst FROM w JOIN deps ON src = x) SELECT 1 FROM w WHERE x = 4) UNION SELECT src FROM bad JOIN deps ON dst = n),
lv(n, level) AS (SELECT n, 0 FROM nodes UNION SELECT src, level + 1 FROM lv JOIN deps ON dst = n WHERE src NOT IN (SELECT n FROM bad))
SELECT n AS unit, CASE WHEN n IN (SELECT n FROM bad) THEN NULL ELSE max(level) END AS level FROM lv GROUP BY n""")
def _(t):
    cycle = t.part.agg(F.max("p_partkey").alias("dst")).select(F.lit(4).cast("long").alias("src"), "dst")
    return g.build_levels(t.x2.select("src", "dst").union(cycle))


@query("E18_chain_dependents", """WITH RECURSIVE up(header, node) AS (SELECT file_id, file_id FROM {x1} UNION SELECT header, dst FROM up JOIN {x2} ON src = node) SELECT DISTINCT node AS file_id, header FROM up""")
def _(t):
    return g.chain_dependents(t.x1, t.x2, t.x1)


@query("E19_orphaned_choices", """WITH RECURSIVE c AS (SELECT dst AS file_id, src AS host, ord AS occurrence, src % 5 AS hash FROM {x2}),
kept AS (SELECT src, dst FROM {x2} WHERE src % 3 <> 0), down(root, node) AS (SELECT host, host FROM c UNION SELECT root, dst FROM down JOIN kept ON src = node),
n AS (SELECT src AS host, dst AS file_id, count(*) AS n FROM {x2} GROUP BY src, dst),
j AS (SELECT c.*, n, EXISTS (SELECT 1 FROM down d WHERE d.root = c.host AND d.node = c.file_id) AS r FROM c LEFT JOIN n USING (host, file_id)),
o AS (SELECT file_id, host, occurrence, CASE WHEN NOT r THEN 'unreachable' WHEN coalesce(n, 0) > 0 AND occurrence >= n THEN 'occurrence' WHEN hash IS NOT NULL AND hash = 4 THEN 'hash' END AS reason FROM j)
SELECT * FROM o WHERE reason IS NOT NULL""")
def _(t):
    choices = t.x2.select(F.col("dst").alias("file_id"), F.col("src").alias("host"), F.col("ord").alias("occurrence"), (F.col("src") % 5).alias("hash"))
    pairs = choices.select("host", F.col("file_id").alias("target")).distinct()
    counts = t.x2.groupBy(F.col("src").alias("host"), F.col("dst").alias("file_id")).agg(F.count("*").alias("n"))
    hashes = choices.select("host", "hash").filter("hash <> 4")
    return g.orphaned_choices(choices, g.reaches(pairs, t.x2.filter("src % 3 <> 0")), counts, hashes)


@query("E20_header_mode", "SELECT file_id, bool_or(severity = 'error' AND code IN ('code1','code2')) AS needs_context FROM {diagnostics} GROUP BY file_id")
def _(t):
    return g.header_mode(t.diagnostics, ("code1", "code2"))


@query("D4_wavefront_scan", """WITH RECURSIVE s AS (SELECT DISTINCT src AS f, 0 AS c FROM {x2} WHERE src NOT IN (SELECT dst FROM {x2})),
reach(f, c) AS (SELECT f, c FROM s UNION SELECT dst, c FROM reach JOIN {x2} ON src = f AND config_id = c),
lv(f, w) AS (SELECT f, 0 FROM s UNION SELECT dst, w + 1 FROM lv JOIN {x2} ON src = f AND config_id = 0)
SELECT f AS file_id, 0 AS config_id, min(w) AS wave FROM lv GROUP BY f""")
def _(t):
    return g.wavefront_scan(g.roots(t.x2).withColumn("config_id", F.lit(0)), t.x2)


@query("D5_scan_report", """WITH RECURSIVE lv(f, w) AS (SELECT DISTINCT src, 0 FROM {x2} WHERE src NOT IN (SELECT dst FROM {x2}) UNION SELECT dst, w + 1 FROM lv JOIN {x2} ON src = f AND config_id = 0),
wv AS (SELECT f, min(w) AS w FROM lv GROUP BY f), inc AS (SELECT name IN (SELECT entry FROM {x12l}) AS ok FROM {x12i}),
m AS (SELECT 'files' AS metric FROM {x1} UNION ALL SELECT CASE WHEN path LIKE '%.cpp' THEN 'source_files' ELSE 'header_files' END FROM {x1}
UNION ALL SELECT 'edges' FROM {x2} UNION ALL SELECT CASE WHEN conditional THEN 'conditional_edges' ELSE 'unconditional_edges' END FROM {x2}
UNION ALL SELECT 'includes_found' FROM inc UNION ALL SELECT CASE WHEN ok THEN 'includes_resolved' ELSE 'includes_unresolved' END FROM inc
UNION ALL SELECT 'modules' FROM (SELECT DISTINCT name FROM {x3}) z UNION ALL SELECT 'waves' FROM (SELECT DISTINCT w FROM wv) z UNION ALL SELECT concat('wave_', w) FROM wv)
SELECT metric, count(*) AS value FROM m GROUP BY metric UNION ALL SELECT 'accuracy', CAST(floor(1000 * count(*) FILTER (ok) / count(*)) AS BIGINT) FROM inc""")
def _(t):
    waves = g.wavefront_scan(g.roots(t.x2).withColumn("config_id", F.lit(0)), t.x2)
    entries = t.x12l.select(F.col("entry").alias("name"), F.lit(True).alias("known")).distinct()
    found = t.x12i.join(entries, "name", "left").select("name", F.coalesce("known", F.lit(False)).alias("resolved"))
    return g.scan_report(waves, t.x1, t.x2, found, t.x3)


# One include under a configuration and the index of its includer: the first hit. Names of the
# shape ../2/./x lie in /inc/2, seen from any of the directories; `none` is no directory.
WHERE = "CASE WHEN name LIKE '../2/./%' THEN concat('/inc/2/', substr(name, 8)) ELSE concat(dir, '/', name) END"


def hits(front: str) -> str:
    return f"""c AS (SELECT f.path AS src, f.config_id, i.ord, i.name, i.angled, i.conditional, d.idx, {WHERE} AS dst FROM {front} f JOIN {{wincl}} i ON i.src = f.path JOIN {{wdirs}} d ON d.config_id = f.config_id
WHERE name NOT LIKE '/%' AND name NOT LIKE 'none%' AND (name NOT LIKE '../%' OR dir LIKE '/inc/%') AND d.idx >= CASE WHEN next THEN f.found_idx + 1 WHEN angled THEN (SELECT min(idx) FROM {{wdirs}} s WHERE s.config_id = f.config_id AND grp <> 'quoted') ELSE 0 END
UNION ALL SELECT f.path, f.config_id, i.ord, i.name, i.angled, i.conditional, -1, {WHERE} FROM (SELECT *, regexp_extract(path, '^(.*)/', 1) AS dir FROM {front}) f JOIN {{wincl}} i ON i.src = f.path WHERE NOT angled AND NOT next AND (name NOT LIKE '../%' OR dir LIKE '/inc/%')
UNION ALL SELECT f.path, f.config_id, i.ord, i.name, i.angled, i.conditional, NULL, name FROM {front} f JOIN {{wincl}} i ON i.src = f.path WHERE name LIKE '/%'),
h AS (SELECT src, config_id, ord, any_value(name) AS name, any_value(angled) AS angled, any_value(conditional) AS conditional, min((idx, dst)) AS h FROM c WHERE dst IN (SELECT path FROM {{wfile}}) GROUP BY src, config_id, ord),
r AS (SELECT src, config_id, ord, name, angled, conditional, struct_extract_at(h, 1) AS idx, struct_extract_at(h, 2) AS dst FROM h)"""


WAVES = f"""WITH RECURSIVE w(it, path, config_id, found_idx, wave) AS (SELECT 0, path, config_id, CAST(0 AS BIGINT), 0 FROM (SELECT DISTINCT * FROM {{wseeds}}) z UNION ALL (WITH front AS (SELECT * FROM w WHERE wave = it), {hits("front")},
new AS (SELECT dst AS path, min((src, ord, config_id, CAST(greatest(coalesce(idx, 0), 0) AS BIGINT))) AS b FROM r WHERE dst NOT IN (SELECT path FROM w) GROUP BY dst)
SELECT it + 1, path, config_id, found_idx, wave FROM w WHERE EXISTS (SELECT 1 FROM new) UNION ALL SELECT (SELECT max(it) FROM w) + 1, path, struct_extract_at(b, 3), struct_extract_at(b, 4), (SELECT max(it) FROM w) + 1 FROM new)),
waves AS (SELECT path, config_id, found_idx, wave FROM w WHERE it = (SELECT max(it) FROM w))"""


def scanned(t):
    """The files' texts, as their includes' lines; scanned again."""
    line = F.concat(F.when(F.col("conditional"), "#ifdef X\n").otherwise(""), F.lit("#"), F.when(F.col("next"), "include_next").otherwise("include"), F.when(F.col("angled"), F.concat(F.lit(" <"), "name", F.lit(">"))).otherwise(F.concat(F.lit(' "'), "name", F.lit('"'))), F.when(F.col("conditional"), "\n#endif").otherwise(""))
    # Six lines a file at most.
    texts = t.wincl.groupBy(F.col("src").alias("file_id")).agg(F.array_join(F.transform(F.array_sort(F.collect_list(F.struct("ord", line.alias("text")))), lambda x: x["text"]), "\n").alias("content"))
    return scan_includes(texts).select(F.col("file_id").alias("src"), F.col("line").alias("ord"), "name", "angled", "next", (F.col("depth") > 0).alias("conditional"))


def from_sources(t):
    return g.wavefront_from_sources(t.wseeds, scanned(t), t.wdirs, dir_listing(t.wfile))


@query("D4_wavefront_from_sources", f"{WAVES} SELECT path, config_id, found_idx, wave FROM waves")
def _(t):
    return from_sources(t)[0].select("path", "config_id", "found_idx", "wave")


@query("D4_wavefront_edges", f"{WAVES}, {hits('waves')} SELECT src, config_id, name, angled, conditional, CAST(idx AS BIGINT) AS idx, dst FROM r UNION ALL SELECT f.path, f.config_id, i.name, i.angled, i.conditional, NULL, NULL FROM waves f JOIN {{wincl}} i ON i.src = f.path WHERE NOT EXISTS (SELECT 1 FROM r WHERE r.src = f.path AND r.config_id = f.config_id AND r.ord = i.ord)")
def _(t):
    return from_sources(t)[1].select("src", "config_id", "name", "angled", "conditional", "idx", "dst")


# Every include under both configurations, as of a file found at the index of its own directory.
@query("D1_include_next", f"WITH front AS (SELECT w.path, c.config_id, CAST(w.p % 4 AS BIGINT) AS found_idx FROM {{wfile}} w, (SELECT DISTINCT config_id FROM {{wdirs}}) c), {hits('front')} SELECT f.path AS src, f.config_id, i.ord, i.name, i.next, CAST(r.idx AS BIGINT) AS idx, r.dst AS path FROM front f JOIN {{wincl}} i ON i.src = f.path LEFT JOIN r ON r.src = f.path AND r.config_id = f.config_id AND r.ord = i.ord")
def _(t):
    found = t.wfile.select(F.col("path").alias("src"), (F.col("p") % 4).alias("found_idx"))
    asked = t.wincl.join(found, "src").crossJoin(F.broadcast(t.wdirs.select("config_id").distinct()))  # a row for each configuration
    own = t.wfile.select(F.col("path").alias("src"), F.regexp_extract("path", "^(.*)/", 1).alias("dir"))
    return resolve_includes(asked, t.wdirs, dir_listing(t.wfile), own).select("src", "config_id", "ord", "name", "next", "idx", "path")
