"""Queries of symloom.operators.ingest."""

from __future__ import annotations

from pyspark.sql import functions as F

from symloom.functions.lineage import shared_folder
from symloom.operators import ingest as i
from symloom.operators import perf

from .registry import query

KEY = "CAST('0x'||substr(md5({}),1,15) AS BIGINT)"


def occ(t):
    return t.x4.select("file_id", "tu", F.col("begin_off").alias("begin"), (F.col("begin_off") + F.col("len")).alias("end"), "symbol_id", "name")


def rel(t):
    return t.x14n.select("file_id", "symbol_id", F.col("begin_off").alias("begin"), F.col("end_off").alias("end"), "target_symbol")


@query("F1_canonical_rows", "SELECT tu, count(*) AS n, CAST(sum(begin_off) AS BIGINT) AS s FROM (SELECT DISTINCT tu, file_id, begin_off, len, symbol_id FROM {x4}) z GROUP BY tu")
def _(t):
    # All rows twice, made in tasks that can hold theirs and dealt out by file, in order: a partial
    # aggregate of rows that don't repeat within a task would hold and sort them in vain.
    rows = t.words("tu", "file_id", "begin_off", "len", "symbol_id", small=True).select("tu", "file_id", F.col("begin_off").alias("begin"), (F.col("begin_off") + F.col("len")).alias("end"), "symbol_id").repartition("file_id")
    return i.canonical_rows(rows.union(rows), rows.columns).groupBy("tu").agg(F.count("*").alias("n"), F.sum("begin").alias("s"))


# Every relation of the index as a fact of one of seven kinds.
FACT = "CASE begin % 7 WHEN 0 THEN 'Callee' WHEN 1 THEN 'Base' WHEN 2 THEN 'Interface' WHEN 3 THEN 'Constructor' WHEN 4 THEN 'Destructor' WHEN 5 THEN 'TypeDefinition' ELSE 'Reference' END"


@query("F2_mirror_relations", f"""WITH f AS (SELECT file_id, symbol_id, begin_off AS begin, end_off AS e, target_symbol, {FACT.replace("begin", "begin_off")} AS kind FROM {{x14}}), m AS (SELECT * FROM f UNION ALL SELECT file_id, target_symbol, begin, e, symbol_id, CASE kind WHEN 'Callee' THEN 'Caller' WHEN 'Base' THEN 'Derived' WHEN 'Interface' THEN 'Implementation' ELSE 'TypeDefinition' END FROM f WHERE target_symbol IS NOT NULL AND kind NOT IN ('TypeDefinition', 'Reference'))
SELECT kind, symbol_id, count(*) AS n, count(target_symbol) AS targets, CAST(sum(begin + e) AS BIGINT) AS places FROM m GROUP BY kind, symbol_id""")
def _(t):
    rows = i.mirror_relations(rel(t).withColumn("kind", F.expr(FACT)))
    return rows.groupBy("kind", "symbol_id").agg(F.count("*").alias("n"), F.count("target_symbol").alias("targets"), F.sum(F.col("begin") + F.col("end")).alias("places"))


SCOPE = "CASE symbol_id % 4 WHEN 0 THEN 'FileLocal' WHEN 1 THEN 'TULocal' ELSE 'External' END"


def linkage():
    return F.when(F.col("symbol_id") % 4 == 0, "none").when(F.col("symbol_id") % 4 == 1, "internal").otherwise("external")



@query("F3_classify_scope", f"SELECT DISTINCT symbol_id, {SCOPE} AS scope FROM {{x4}}")
def _(t):
    return t.x4.select("symbol_id", i.classify_scope(linkage()).alias("scope")).distinct()


@query("F4_reference_files", "SELECT symbol_id, count(DISTINCT file_id) AS files FROM {x14} GROUP BY symbol_id")
def _(t):
    return i.reference_files(t.x14n).groupBy("symbol_id").agg(F.count("*").alias("files"))


@query("F5_module_rows", f"SELECT file_id, {KEY.format(chr(39) + '@module@' + chr(39) + ' || name')} AS symbol_id, name, CASE WHEN file_id % 2 = 0 THEN 'Definition' ELSE 'Reference' END AS kind FROM {{x3}}")
def _(t):
    return i.module_rows(t.x3.withColumn("interface", F.col("file_id") % 2 == 0))


@query("F6_rows_hash", "WITH r AS (SELECT source, lang, md5(text) AS h FROM {documents}), s AS (SELECT source, string_agg(DISTINCT h, ',' ORDER BY h) AS x FROM (SELECT lang AS source, h FROM r UNION ALL SELECT source, h FROM r) z GROUP BY source) SELECT count(*) AS groups, count(DISTINCT x) AS shapes FROM s")
def _(t):
    rows = t.x5.select(F.col("path").alias("grp"), "rows_hash").union(t.x5.select("tu", "rows_hash"))
    return i.rows_hash(rows, ["grp"], ["rows_hash"]).agg(F.count("*").alias("groups"), F.countDistinct("hash").alias("shapes"))


@query("F7_merge_variants", "SELECT file_id, begin_off AS begin, symbol_id, string_agg(DISTINCT tu, ' ' ORDER BY tu) AS variants FROM (SELECT line AS file_id, tok AS begin_off, symbol_id, tu FROM {x4} WHERE (tu <> 'src1' AND file_id % 2 = 0) OR file_id % 2 = 1) z GROUP BY 1, 2, 3")
def _(t):
    rows = t.x4.select(F.col("line").alias("file_id"), F.col("tok").alias("begin"), "symbol_id", F.col("tu").alias("variant"), F.col("file_id").alias("f"))
    keep = rows.filter("variant <> 'src1'").select("file_id", "variant").distinct()
    return i.merge_variants(rows.filter("f % 2 = 0"), keep, rows.filter("f % 2 = 1"), ["file_id", "begin", "symbol_id"]).withColumn("variants", F.array_join("variants", " "))


# Variants of a line number's rows: one for each source and last digit of the text's id, over
# several masks a file.
VARIANT = "concat(tu, '/', file_id % 10)"
MASK = "CASE WHEN n % 64 = 63 THEN CAST(-9223372036854775808 AS BIGINT) ELSE CAST(1 AS BIGINT) << CAST(n % 64 AS BIGINT) END"
NUMBERED = f"rw AS (SELECT line AS file_id, tok AS begin, symbol_id, {VARIANT} AS variant, file_id % 3 AS part FROM {{x4}}), nu AS (SELECT file_id, variant, dense_rank() OVER (PARTITION BY file_id ORDER BY variant) - 1 AS n FROM (SELECT DISTINCT file_id, variant FROM rw) z)"


def masked_rows(t):
    return t.x4.select(F.col("line").alias("file_id"), F.col("tok").alias("begin"), "symbol_id", F.expr(VARIANT).alias("variant"), (F.col("file_id") % 3).alias("part"))


def numbers(t):
    none = t.spark.createDataFrame([], "file_id long, variant string, number long")
    return i.number_variants(none, masked_rows(t))


ROW = ["file_id", "begin", "symbol_id"]


@query("F7_merge_masks", f"WITH {NUMBERED}, m AS (SELECT rw.file_id, begin, symbol_id, n // 64 AS word, {MASK} AS bit FROM rw JOIN nu USING (file_id, variant) WHERE part > 0 OR (variant NOT LIKE 'src1%' AND part = 0)) SELECT file_id, begin, symbol_id, CAST(word AS BIGINT) AS word, bit_or(bit) AS mask FROM m GROUP BY file_id, begin, symbol_id, word")
def _(t):
    rows, known = masked_rows(t), numbers(t)
    keep = i.live_masks(rows.filter("variant not like 'src1%'").select("file_id", "variant").distinct(), known)
    old = i.bits(rows.filter("part = 0"), known, ROW)
    return i.merge_masks(old, keep, rows.filter("part > 0"), known, ROW)


@query("F14_live_masked", f"WITH {NUMBERED} SELECT DISTINCT file_id, begin, symbol_id FROM rw WHERE variant LIKE 'src2%' OR variant LIKE '%/7'")
def _(t):
    rows, known = masked_rows(t), numbers(t)
    live = i.live_masks(rows.filter("variant like 'src2%' or variant like '%/7'").select("file_id", "variant").distinct(), known)
    return i.live_masked(i.bits(rows, known, ROW), live, ROW)


# Row sets of (source, language), of which those of some sources are stored already.
@query("F6_new_sets", "WITH r AS (SELECT DISTINCT source AS tu, lang AS path, md5(text) AS h FROM {documents}), e AS (SELECT tu, path, string_agg(h, ',' ORDER BY h) AS shape FROM r GROUP BY tu, path), n AS (SELECT path, shape, min(tu) AS tu FROM e WHERE (path, shape) NOT IN (SELECT (path, shape) FROM e WHERE tu < 'src15') GROUP BY path, shape) SELECT path, r.h AS row_id, count(*) AS sets FROM n JOIN r USING (tu, path) GROUP BY path, r.h")
def _(t):
    rows = t.x5.select("tu", "path", F.col("rows_hash").alias("row_id"))
    stored = i.rows_hash(rows.filter("tu < 'src15'"), ["tu", "path"], ["row_id"])
    return i.new_sets(rows, stored, ["row_id"])[1].groupBy("path", "row_id").agg(F.count("*").alias("sets"))


@query("F8_local_names", f"SELECT DISTINCT file_id, symbol_id, name FROM {{x4}} WHERE {SCOPE} <> 'External'")
def _(t):
    names = t.words("symbol_id", "tu", "name").withColumn("scope", i.classify_scope(linkage()))
    return i.local_names(names, t.words("file_id", "symbol_id"))


@query("F9_merge_symbols", f"WITH s AS (SELECT tu, symbol_id, name, concat('k', symbol_id % 3) AS kind, {SCOPE} AS scope, file_id FROM {{x4}}), bad AS (SELECT DISTINCT tu FROM s WHERE file_id % 97 = 0) SELECT symbol_id, name, kind, count(DISTINCT file_id) AS files FROM s WHERE tu NOT IN (SELECT tu FROM bad) AND scope = 'External' GROUP BY symbol_id, name, kind")
def _(t):
    s = t.words("tu", "symbol_id", "name", "file_id").withColumns({"kind": F.concat(F.lit("k"), (F.col("symbol_id") % 3).cast("string")), "scope": i.classify_scope(linkage())})
    return i.merge_symbols(s, t.documents.select(F.col("doc_id").alias("file_id")).filter("file_id % 97 <> 0"), t.words("tu", "file_id"))


@query("F10_intern_file_versions", "WITH k AS (SELECT row_number() OVER (ORDER BY path, rows_hash) AS fv_id, path, rows_hash FROM (SELECT DISTINCT path, rows_hash FROM {x5} WHERE tu = 'src1') z), n AS (SELECT DISTINCT path, rows_hash FROM {x5} WHERE (path, rows_hash) NOT IN (SELECT (path, rows_hash) FROM k)) SELECT fv_id, path AS file_id, rows_hash AS content_hash FROM k UNION ALL SELECT (SELECT max(fv_id) FROM k) + row_number() OVER (ORDER BY path, rows_hash), path, rows_hash FROM n")
def _(t):
    seen = t.x5.select(F.col("path").alias("file_id"), F.col("rows_hash").alias("content_hash"), "tu")
    none = t.spark.createDataFrame([], "fv_id long, file_id string, content_hash string")
    known = i.intern_file_versions(none, seen.filter("tu = 'src1'"))
    return i.intern_file_versions(known, seen)


def fresh(t):
    return t.x5.filter("tu in ('src1', 'src2')").select("tu", F.lit("en").alias("path"), F.sha1("rows_hash").alias("rows_hash"))


@query("F11_apply_manifest", "SELECT * FROM {x5} WHERE tu NOT IN ('src1', 'src2') UNION ALL SELECT tu, 'en', sha1(rows_hash) FROM {x5} WHERE tu IN ('src1', 'src2')")
def _(t):
    return i.apply_manifest(t.x5, fresh(t))


@query("F11_affected_files", "SELECT path FROM {x5} WHERE tu IN ('src1', 'src2') UNION SELECT 'en'")
def _(t):
    return i.affected_files(t.x5, fresh(t))


@query("F12_remove_manifest", "SELECT tu, path, rows_hash FROM {x5} WHERE tu <> 'src3'")
def _(t):
    return i.remove_manifest(t.x5, t.x5.filter("tu = 'src3'")).select("tu", "path", "rows_hash")


@query("F13_live_variants", "SELECT DISTINCT path, rows_hash AS variant FROM {x5}")
def _(t):
    return i.live_variants(t.x5)


@query("F14_live_rows", "SELECT tu, path, rows_hash AS variant FROM {x5} WHERE (path, rows_hash) IN (SELECT (path, rows_hash) FROM {x5} WHERE tu < 'src2')")
def _(t):
    rows = t.x5.select("tu", "path", F.col("rows_hash").alias("variant"))
    return i.live_rows(rows, i.live_variants(t.x5.filter("tu < 'src2'"))).select("tu", "path", "variant")


@query("F15_compact", "WITH s AS (SELECT DISTINCT tu AS path, rows_hash AS variant FROM {x5}), l AS (SELECT DISTINCT tu, rows_hash FROM {x5} WHERE path = 'en' AND tu <> 'src4'), m AS (SELECT s.path, count(*) AS n, count(l.tu) AS a FROM s LEFT JOIN l ON l.tu = s.path AND l.rows_hash = s.variant GROUP BY s.path) SELECT path, CASE WHEN a = 0 THEN 'retired' WHEN a < n THEN 'rewritten' ELSE 'kept' END AS verdict FROM m")
def _(t):
    stored = t.x5.select(F.col("tu").alias("path"), F.col("rows_hash").alias("variant"))
    live = t.x5.filter("path = 'en' and tu <> 'src4'").select(F.col("tu").alias("path"), F.col("rows_hash").alias("variant")).distinct()
    return i.compact(stored, live)


@query("F15_retired_owners", "WITH l AS (SELECT DISTINCT tu, rows_hash FROM {x5} WHERE path = 'en' AND tu <> 'src4'), gone AS (SELECT DISTINCT tu AS path FROM {x5} s WHERE NOT EXISTS (SELECT 1 FROM l WHERE l.tu = s.tu AND l.rows_hash IN (SELECT rows_hash FROM {x5} y WHERE y.tu = s.tu))) SELECT DISTINCT path AS tu, tu AS path FROM {x5} WHERE tu IN (SELECT path FROM gone)")
def _(t):
    stored = t.x5.select(F.col("tu").alias("path"), F.col("rows_hash").alias("variant"))
    live = t.x5.filter("path = 'en' and tu <> 'src4'").select(F.col("tu").alias("path"), F.col("rows_hash").alias("variant")).distinct()
    owned = t.x5.select(F.col("path").alias("tu"), F.col("tu").alias("path"))
    return i.owners_of(owned, i.compact(stored, live).filter("verdict = 'retired'")).select("tu", "path")


SECTIONS = "sec AS (SELECT source AS tu, lang AS path, md5(text) AS rows_hash, CAST(n_chars % 50 AS BIGINT) AS content_hash FROM {documents}), sto AS (SELECT DISTINCT lang AS path, md5(CASE WHEN doc_id % 5 = 0 THEN text ELSE concat(text, '!') END) AS variant, CAST(n_chars % 40 AS BIGINT) AS content_hash, doc_id % 3 AS generation FROM {documents})"


def sections(t):
    return t.documents.select(F.col("source").alias("tu"), F.col("lang").alias("path"), F.md5("text").alias("rows_hash"), (F.col("n_chars") % 50).alias("content_hash"))


def stored(t):
    return t.documents.select(F.col("lang").alias("path"), F.md5(F.expr("CASE WHEN doc_id % 5 = 0 THEN text ELSE concat(text, '!') END")).alias("variant"), (F.col("n_chars") % 40).alias("content_hash"), (F.col("doc_id") % 3).alias("generation")).distinct()


@query("F16_merge_plan", f"WITH {SECTIONS} SELECT tu, path, rows_hash, CASE WHEN (path, rows_hash) IN (SELECT (path, variant) FROM sto) THEN 'hit' WHEN (path, content_hash) IN (SELECT (path, content_hash) FROM sto) THEN 'appended' ELSE 'rebuilt' END AS outcome FROM sec")
def _(t):
    return i.merge_plan(sections(t), stored(t))


@query("F17_reject_inconsistent", f"WITH {SECTIONS}, gr AS (SELECT tu, path, min(content_hash) AS g FROM sec WHERE tu > 'src15' GROUP BY tu, path) SELECT DISTINCT sec.tu FROM sec JOIN gr USING (tu, path) WHERE content_hash <> g")
def _(t):
    s = sections(t)
    graph = s.filter("tu > 'src15'").groupBy("tu", "path").agg(F.min("content_hash").alias("graph_hash"))
    return i.reject_inconsistent(s, graph)


@query("F18_requeue_after_rebuild", f"WITH {SECTIONS} SELECT DISTINCT tu FROM {{x5}} WHERE path IN ('de', 'fr') AND (path, rows_hash) NOT IN (SELECT (path, variant) FROM sto)")
def _(t):
    return i.requeue_after_rebuild(t.x5, stored(t), t.x5.filter("path in ('de', 'fr')"))


@query("F19_gc_file_versions", "SELECT p_partkey AS fv_id FROM {part} WHERE p_partkey IN (SELECT l_partkey FROM {lineitem} WHERE l_quantity > 45) OR p_partkey IN (SELECT ps FROM (SELECT o_custkey AS ps FROM {orders} WHERE o_orderstatus = 'P') z)")
def _(t):
    versions = t.part.select(F.col("p_partkey").alias("fv_id"))
    return i.gc_file_versions(versions, t.lineitem.filter("l_quantity > 45").select(F.col("l_partkey").alias("fv_id")), t.orders.filter("o_orderstatus = 'P'").select(F.col("o_custkey").alias("fv_id")))


@query("F20_adopt_manifests", "WITH m AS (SELECT l_orderkey AS tu, l_orderkey % 3 AS generation, l_partkey AS fv_id FROM {lineitem}), p AS (SELECT o_orderkey AS tu, CASE WHEN o_orderstatus = 'F' THEN o_orderkey % 3 ELSE 7 END AS pin FROM {orders}), o AS (SELECT tu, any_value(generation) AS generation, bool_or(fv_id % 50 = 0) AS lost FROM m GROUP BY tu) SELECT coalesce(o.tu, p.tu) AS tu, CASE WHEN generation IS NULL THEN 'missing' WHEN generation = pin AND NOT lost THEN 'adopted' ELSE 'dead' END AS verdict FROM o FULL JOIN p ON o.tu = p.tu")
def _(t):
    m = t.lineitem.select(F.col("l_orderkey").alias("tu"), (F.col("l_orderkey") % 3).alias("generation"), F.col("l_partkey").alias("fv_id"))
    pins = t.orders.select(F.col("o_orderkey").alias("tu"), F.when(F.col("o_orderstatus") == "F", F.col("o_orderkey") % 3).otherwise(7).alias("generation"))
    return i.adopt_manifests(m, pins, t.part.filter("p_partkey % 50 <> 0").select(F.col("p_partkey").alias("fv_id")))


@query("F21_unservable_files", f"WITH {SECTIONS}, c AS (SELECT DISTINCT tu || path AS path, rows_hash AS variant FROM {{x5}}), st AS (SELECT DISTINCT source || replace(lang, 'es', 'no') AS path, md5(CASE WHEN doc_id % 3 = 0 AND lang = 'fr' THEN concat(text, '!') ELSE text END) AS variant, CASE WHEN lang = 'de' THEN doc_id % 2 ELSE 0 END AS generation FROM {{documents}}), g AS (SELECT path, count(DISTINCT generation) AS n FROM st GROUP BY path), p AS (SELECT c.path, bool_or(st.path IS NULL) AS lacks FROM c LEFT JOIN (SELECT DISTINCT path, variant FROM st) st ON st.path = c.path AND st.variant = c.variant GROUP BY c.path), r AS (SELECT p.path, CASE WHEN n IS NULL THEN 'missing' WHEN n > 1 THEN 'conflict' WHEN lacks THEN 'variant' END AS reason FROM p LEFT JOIN g ON g.path = p.path) SELECT * FROM r WHERE reason IS NOT NULL")
def _(t):
    c = t.x5.select("tu", F.concat("tu", "path").alias("path"), "rows_hash")
    st = t.documents.selectExpr("source || replace(lang, 'es', 'no') AS path", "md5(CASE WHEN doc_id % 3 = 0 AND lang = 'fr' THEN concat(text, '!') ELSE text END) AS variant", "CASE WHEN lang = 'de' THEN doc_id % 2 ELSE 0 END AS generation")
    return i.unservable_files(c, st)


@query("F21_unservable_owners", f"WITH {SECTIONS}, c AS (SELECT DISTINCT tu || path AS path, rows_hash AS variant FROM {{x5}}), st AS (SELECT DISTINCT source || replace(lang, 'es', 'no') AS path, md5(CASE WHEN doc_id % 3 = 0 AND lang = 'fr' THEN concat(text, '!') ELSE text END) AS variant, CASE WHEN lang = 'de' THEN doc_id % 2 ELSE 0 END AS generation FROM {{documents}}), g AS (SELECT path, count(DISTINCT generation) AS n FROM st GROUP BY path), p AS (SELECT c.path, bool_or(st.path IS NULL) AS lacks FROM c LEFT JOIN (SELECT DISTINCT path, variant FROM st) st ON st.path = c.path AND st.variant = c.variant GROUP BY c.path), r AS (SELECT p.path, CASE WHEN n IS NULL THEN 'missing' WHEN n > 1 THEN 'conflict' WHEN lacks THEN 'variant' END AS reason FROM p LEFT JOIN g ON g.path = p.path) SELECT DISTINCT tu, tu || path AS path FROM {{x5}} WHERE tu || path IN (SELECT path FROM r WHERE reason IS NOT NULL)")
def _(t):
    c = t.x5.select("tu", F.concat("tu", "path").alias("path"), "rows_hash")
    st = t.documents.selectExpr("source || replace(lang, 'es', 'no') AS path", "md5(CASE WHEN doc_id % 3 = 0 AND lang = 'fr' THEN concat(text, '!') ELSE text END) AS variant", "CASE WHEN lang = 'de' THEN doc_id % 2 ELSE 0 END AS generation")
    return i.owners_of(c, i.unservable_files(c, st)).select("tu", "path")


@query("F22_orphan_shards", "SELECT DISTINCT tu || '/' || path AS path FROM {x5} WHERE tu || '/' || path NOT IN (SELECT tu || '/' || path FROM {x5} WHERE path <> 'de' AND tu <> 'src3')")
def _(t):
    stored = t.x5.select("tu", F.col("path").alias("lang"), F.concat_ws("/", "tu", "path").alias("path"))
    return i.orphan_shards(stored.select("path"), stored.filter("lang <> 'de' and tu <> 'src3'").select("path"))


@query("F23_index_stats", "SELECT 'occurrences' AS metric, count(*) AS value FROM {x4} UNION ALL SELECT 'symbols', count(DISTINCT symbol_id) FROM {x4} UNION ALL SELECT 'files', count(DISTINCT file_id) FROM {x4} UNION ALL SELECT 'relations', count(*) FROM {x14} UNION ALL SELECT 'units', count(DISTINCT tu) FROM {x5} UNION ALL SELECT 'variants', count(DISTINCT (path, rows_hash)) FROM {x5}")
def _(t):
    return i.index_stats(t.x4, t.x14n, t.x5)


@query("F23_largest_files", "SELECT file_id, count(*) AS rows FROM {x4} GROUP BY 1 ORDER BY 2 DESC, 1 LIMIT 10")
def _(t):
    return i.largest_files(t.x4)


@query("F9_symbol_files", f"WITH s AS (SELECT tu, symbol_id, {SCOPE} AS scope, file_id FROM {{x4}}), bad AS (SELECT DISTINCT tu FROM s WHERE file_id % 97 = 0) SELECT DISTINCT symbol_id, file_id FROM s WHERE tu NOT IN (SELECT tu FROM bad) AND scope = 'External'")
def _(t):
    s = t.x4.select("tu", "symbol_id", i.classify_scope(linkage()).alias("scope"), "file_id")
    return i.symbol_files(s, t.documents.select(F.col("doc_id").alias("file_id")).filter("file_id % 97 <> 0"))


@query("F23_storage_stats", "WITH p AS (SELECT concat(source, lang) AS path, sum(octet_length(encode(text))) AS b FROM {documents} GROUP BY 1), v AS (SELECT concat(source, lang) AS f, count(DISTINCT md5(text)) AS n FROM {documents} WHERE text IS NOT NULL GROUP BY 1) SELECT 'shards' AS metric, count(*) AS value FROM p UNION ALL SELECT 'bytes', CAST(sum(b) AS BIGINT) FROM p UNION ALL SELECT 'largest', CAST(max(b) AS BIGINT) FROM p UNION ALL SELECT 'mean', CAST(sum(b) // count(*) AS BIGINT) FROM p UNION ALL SELECT 'versions', CAST(sum(n) AS BIGINT) FROM v UNION ALL SELECT 'files_with_several', count(*) FILTER (n > 1) FROM v")
def _(t):
    path = F.concat("source", "lang")
    versions = t.documents.filter("text is not null").select(path.alias("file_id"), F.md5("text").alias("content_hash"))
    return i.storage_stats(t.documents.select(path.alias("path"), F.octet_length("text").alias("bytes")), versions)


@query("F25_shares", "WITH v AS (SELECT 'rows' AS measure, count(*) AS v FROM {x4} GROUP BY file_id UNION ALL SELECT 'relations', count(*) FROM {x14} GROUP BY file_id), a AS (SELECT measure, count(*) AS n FROM v GROUP BY 1), t AS (SELECT unnest([10, 100, 1000]) AS threshold) SELECT v.measure, CAST(threshold AS BIGINT) AS threshold, count(*) FILTER (v > threshold) AS n, count(*) FILTER (v > threshold) / any_value(a.n) AS share FROM v JOIN a USING (measure), t GROUP BY 1, 2")
def _(t):
    rows = i.rows_per_file(t.x4)
    relations = t.x14n.select(F.col("file_id").alias("path"), F.lit("v").alias("variant"))
    return i.shares_over(rows.union(i.relations_per_variant(relations)), [10, 100, 1000])


@query("F24_variant_stats", "WITH p AS (SELECT path, count(DISTINCT rows_hash) AS m, count(*) AS n FROM (SELECT tu || path AS path, rows_hash FROM {x5}) z GROUP BY path) SELECT CASE WHEN m = 1 THEN '1' WHEN m <= 8 THEN '2-8' WHEN m <= 16 THEN '9-16' WHEN m <= 32 THEN '17-32' WHEN m <= 64 THEN '33-64' ELSE '>64' END AS bucket, count(*) AS files, CAST(sum(m) AS BIGINT) AS variants, CAST(sum(n) AS BIGINT) AS contributions, 1 - sum(m) / sum(n) AS hit_rate FROM p GROUP BY 1")
def _(t):
    return i.variant_stats(t.x5.select("tu", F.concat("tu", "path").alias("path"), "rows_hash"))


@query("F25_row_distributions", """WITH v AS (SELECT 'rows' AS measure, count(*) AS v FROM {x4} GROUP BY file_id UNION ALL SELECT 'symbols', count(DISTINCT symbol_id) FROM {x4} GROUP BY file_id UNION ALL SELECT 'last_end', max(begin_off + len) FROM {x4} GROUP BY file_id UNION ALL SELECT 'length', len FROM {x4}
UNION ALL SELECT 'gap', begin_off - lag(begin_off) OVER (PARTITION BY file_id ORDER BY begin_off) FROM {x4}) SELECT measure, list_sort(list(v))[CAST(floor(0.5 * (count(v) - 1)) AS BIGINT) + 1] AS p50, list_sort(list(v))[CAST(floor(0.9 * (count(v) - 1)) AS BIGINT) + 1] AS p90 FROM v WHERE v IS NOT NULL GROUP BY measure""")
def _(t):
    return perf.percentile_rows(i.row_distributions(occ(t).select("file_id", "begin", "end", "symbol_id")), ["measure"], "value", {"p50": 0.5, "p90": 0.9})


@query("F26_kind_histogram", "SELECT kind, count(*) AS n, count(DISTINCT symbol_id) AS symbols FROM {x14} GROUP BY kind")
def _(t):
    return i.kind_histogram(t.x14)


@query("F26_scope_split", f"WITH s AS (SELECT tu, symbol_id, {SCOPE} AS scope FROM {{x4}}) SELECT scope, count(*) AS rows, count(DISTINCT symbol_id) AS symbols FROM s GROUP BY scope")
def _(t):
    return i.scope_split(t.x4.select("tu", "symbol_id", i.classify_scope(linkage()).alias("scope")))


@query("F27_directive_sharing", "WITH s AS (SELECT dst AS path, config_id AS tu, string_agg(DISTINCT concat(ord, '-', src % 2), ',' ORDER BY concat(ord, '-', src % 2)) AS h FROM {x2} GROUP BY 1, 2), p AS (SELECT path, count(*) AS units, count(DISTINCT h) AS k FROM s GROUP BY path) SELECT units, count(*) AS files, count(*) FILTER (k = 1) AS one_shape FROM p GROUP BY units")
def _(t):
    return i.directive_sharing(t.x2.select(F.col("dst").alias("path"), F.col("config_id").alias("tu"), F.col("ord").alias("line"), (F.col("src") % 2).alias("target")))


@query("F28_size_model", "WITH p AS (SELECT line, count(DISTINCT tu) AS m, count(DISTINCT symbol_id) AS s, count(DISTINCT (tok, symbol_id)) AS r, count(DISTINCT (tu, tok, symbol_id)) AS a FROM {x4} GROUP BY line) SELECT CAST(sum(a * 12 + m * s * 8) AS BIGINT) AS apart, CAST(sum(r * (12 + CASE WHEN m = 1 THEN 0 WHEN m <= 32 THEN 4 WHEN m <= 64 THEN 8 ELSE ceil(m / 8) END) + s * 8) AS BIGINT) AS merged FROM p")
def _(t):
    per = i.variant_sizes(t.x4, "line", "tu", "symbol_id", ["tok", "symbol_id"])
    return i.size_model(per)


@query("A9_write_read_index", "SELECT kind, count(*) AS n FROM {x14} GROUP BY kind")
def _(t):
    path = shared_folder(t.spark, "index")
    i.write_index({"relations": t.x14.filter("false"), "edges": t.x2}, path, 1)
    i.write_index({"relations": t.x14}, path, 2)
    return i.kind_histogram(i.read_index(t.spark, path, "relations")).select("kind", "n")


@query("A10_export_graph_json", "SELECT src, (SELECT min(name) FROM {x3} m WHERE m.file_id = src) AS module, string_agg(dst, ' ' ORDER BY ord, dst) AS includes FROM {x2} GROUP BY src")
def _(t):
    path = shared_folder(t.spark, "graph")
    i.graph_rows(t.x2, t.x3).write.json(path)
    return t.spark.read.schema("src long, module string, includes array<long>").json(path).select("src", "module", F.array_join(F.transform("includes", lambda x: x.cast("string")), " ").alias("includes"))


@query("A12_stats_report", "SELECT 'kinds' AS report, kind AS name, count(*) AS n FROM {x14} GROUP BY kind UNION ALL SELECT 'edges', concat('c', config_id), count(*) FROM {x2} GROUP BY config_id")
def _(t):
    path = shared_folder(t.spark, "report")
    kinds = i.kind_histogram(t.x14).select(F.col("kind").alias("name"), "n")
    edges = t.x2.groupBy(F.concat(F.lit("c"), "config_id").alias("name")).agg(F.count("*").alias("n"))
    i.stats_report({"kinds": kinds, "edges": edges}, path)
    return t.spark.read.schema("name string, n long, report string").json(path).select("report", "name", "n")
