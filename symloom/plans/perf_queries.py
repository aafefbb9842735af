"""Queries of logs and statistics."""

from __future__ import annotations

from pyspark.sql import functions as F

from symloom.functions.lineage import shared_folder
from symloom.operators import perf as p
from symloom.sources import logs

from .registry import query

AT = "list_sort(list(v))[CAST(floor({p} * (count(v) - 1)) AS BIGINT) + 1]"
STATS = "count(v) AS count, min(v) AS min, max(v) AS max, avg(v) AS mean, sum(v) AS sum, " + ", ".join(f"{AT.replace('{p}', str(x))} AS p{n}" for n, x in ((50, 0.5), (90, 0.9), (99, 0.99)))
LINE = "concat('[2026-08-14 12:34:56.', substr(CAST(1000 + event_id % 1000 AS STRING), 2), '] [info] [thread ', user_id % 4, '] [perf:', event_type, '] kind=k', user_id % 3, ' path=/a b/', event_id, ' elapsed_ms=', CAST(event_id % 977 AS STRING))"


def lines(t):
    """Events written as log text and read again."""
    path = shared_folder(t.spark, "log")
    t.events.select(F.expr(LINE).alias("value")).write.text(path)
    return t.spark.read.text(path).withColumn("file", F.lit("a.log"))


@query("A4_read_perf_log", "SELECT event_type AS topic, CAST(1000 * 56 + event_id % 1000 AS BIGINT) AS ms, CAST(user_id % 4 AS BIGINT) AS tid, concat('k', user_id % 3) AS kind, concat('/a b/', event_id) AS path, CAST(event_id % 977 AS VARCHAR) AS elapsed FROM {events}")
def _(t):
    v = F.col("values")
    ms = (F.unix_millis(F.col("ts").cast("timestamp")) % 60000).cast("long")
    return logs.perf_events(lines(t)).select("topic", ms.alias("ms"), "tid", v["kind"].alias("kind"), v["path"].alias("path"), v["elapsed_ms"].alias("elapsed"))


@query("A5_read_anomaly_log", "SELECT CASE WHEN user_id % 2 = 0 THEN 'anomaly' ELSE 'guidance' END AS kind, CASE WHEN user_id % 2 = 0 THEN event_type END AS id, concat('m ', event_id) AS message FROM {events} WHERE user_id % 3 <> 0")
def _(t):
    path = shared_folder(t.spark, "log")
    t.events.select(F.expr("concat('[x] ', CASE WHEN user_id % 3 = 0 THEN 'plain ' WHEN user_id % 2 = 0 THEN concat('[anomaly:', event_type, '] ') ELSE '[guidance] ' END, 'm ', event_id)").alias("value")).write.text(path)
    return logs.read_anomaly_log(t.spark, path)


def trace(t):
    path = shared_folder(t.spark, "trace")
    msg = F.struct(F.concat(F.lit("m/"), "role").alias("method"), F.col("conv_id").cast("string").alias("id"), F.struct("turn").alias("params"))
    t.conversations.select(F.to_json(F.struct((F.col("conv_id") * 10 + F.col("turn")).alias("ts"), msg.alias("msg"))).alias("value")).write.text(path)
    return logs.read_session_trace(t.spark, path)


@query("A6_read_session_trace", "SELECT CAST(conv_id * 10 + turn AS DOUBLE) AS ts, concat('m/', role) AS method, CAST(conv_id AS VARCHAR) AS id, concat('{\"turn\":', turn, '}') AS params FROM {conversations}")
def _(t):
    return trace(t).drop("pos")


@query("A7_trace_summary", "SELECT method, n, messages, duration FROM (SELECT concat('m/', role) AS method, count(*) AS n, min(conv_id * 10 + turn) AS f FROM {conversations} GROUP BY role) a, (SELECT count(*) AS messages, CAST(max(conv_id * 10 + turn) - min(conv_id * 10 + turn) AS DOUBLE) AS duration FROM {conversations}) b ORDER BY n DESC, f LIMIT 8")
def _(t):
    return logs.trace_summary(trace(t).drop("pos"))


@query("A11_export_chrome_trace", "SELECT concat(event_type, '.k', user_id % 3) AS name, (ms - (SELECT min(event_id % 1000) FROM {events}) - event_id % 977) * 1000 AS ts, CAST((event_id % 977) * 1000 AS BIGINT) AS dur, CAST(user_id % 4 AS BIGINT) AS tid FROM (SELECT *, CAST(event_id % 1000 AS BIGINT) AS ms FROM {events}) z")
def _(t):
    path = shared_folder(t.spark, "chrome")
    logs.export_chrome_trace(logs.perf_events(lines(t)), path)
    got = lambda k: F.get_json_object("value", f"$.{k}")
    return t.spark.read.text(path).filter(got("ph") == "X").select(got("name").alias("name"), got("ts").cast("long").alias("ts"), got("dur").cast("long").alias("dur"), got("tid").cast("long").alias("tid"))


def perf(t):
    return t.x7.select("topic", F.create_map(F.lit("kind"), "kind", F.lit("elapsed_ms"), F.col("elapsed_ms").cast("string"), F.lit("note"), F.lit("x_ms")).alias("values"), "elapsed_ms", "seq")


@query("I1_event_name", "SELECT seq, concat(topic, '.', kind) AS name FROM {x7}")
def _(t):
    return perf(t).select("seq", logs.event_name(F.col("topic"), F.col("values")).alias("name"))


@query("I2_series", "SELECT concat(topic, '.', kind, '.elapsed_ms') AS name, elapsed_ms AS value FROM {x7}")
def _(t):
    return p.series(perf(t))


@query("I3_compute_stats", f"SELECT topic, {STATS} FROM (SELECT topic, CAST(floor(elapsed_ms * 4) AS BIGINT) AS v FROM {{x7}}) z GROUP BY topic")
def _(t):
    return p.compute_stats(t.x7.select("topic", F.floor(F.col("elapsed_ms") * 4).alias("value")), ["topic"])


@query("I4_percentile_floor", f"SELECT topic, kind, {AT.replace('{p}', '0.5')} AS p50, {AT.replace('{p}', '0.9')} AS p90 FROM (SELECT topic, kind, elapsed_ms AS v FROM {{x7}}) z GROUP BY topic, kind")
def _(t):
    return p.percentile_rows(t.x7, ["topic", "kind"], "elapsed_ms", {"p50": 0.5, "p90": 0.9})


@query("I5_perf_report", f"SELECT name, count, min, p50, p99, max FROM (SELECT name, {STATS} FROM (SELECT concat(topic, '.', kind, '.elapsed_ms') AS name, elapsed_ms AS v FROM {{x7}}) z GROUP BY name) y")
def _(t):
    return p.perf_report(perf(t)).select("name", "count", "min", "p50", "p99", "max")


HIST = "h AS (SELECT topic, CAST(least(floor(elapsed_ms), 39) AS BIGINT) AS bucket, count(*) AS n FROM {x7} GROUP BY 1, 2)"


@query("I6_capped_histogram", f"WITH {HIST} SELECT topic, bucket, n, (SELECT count(*) FROM {{x7}} x WHERE x.topic = h.topic AND elapsed_ms >= 40) AS \"over\", (SELECT max(elapsed_ms) FROM {{x7}} x WHERE x.topic = h.topic) AS most FROM h")
def _(t):
    return p.capped_histogram(t.x7, ["topic"], "elapsed_ms", 40)


@query("I6_histogram_percentile", f"WITH {HIST}, r AS (SELECT *, sum(n) OVER (PARTITION BY topic ORDER BY bucket) AS u, sum(n) OVER (PARTITION BY topic) AS a FROM h) SELECT r.topic, min(bucket) FILTER (u > floor(0.9 * (a - 1))) AS p, CAST(sum(CASE WHEN bucket >= 10 THEN n ELSE 0 END) AS BIGINT) AS n FROM r GROUP BY r.topic")
def _(t):
    h = p.capped_histogram(t.x7, ["topic"], "elapsed_ms", 40)
    return p.histogram_percentile(h, ["topic"], 0.9).join(p.count_at_least(h, ["topic"], 10), "topic")


@query("I6_count_at_least", f"WITH {HIST} SELECT topic, CAST(sum(CASE WHEN bucket >= 25 THEN n ELSE 0 END) AS BIGINT) AS n FROM h GROUP BY topic")
def _(t):
    return p.count_at_least(p.capped_histogram(t.x7, ["topic"], "elapsed_ms", 40), ["topic"], 25)


RUNS = "SELECT l_orderkey * 10 + l_linenumber AS file, CASE WHEN l_linenumber % 3 <> 0 THEN l_quantity END AS parse, CASE WHEN l_tax > 0.02 THEN l_extendedprice END AS build FROM {lineitem}"


def runs(t):
    return t.lineitem.select((F.col("l_orderkey") * 10 + F.col("l_linenumber")).alias("file"), F.when(F.col("l_linenumber") % 3 != 0, F.col("l_quantity")).alias("parse"), F.when(F.col("l_tax") > 0.02, F.col("l_extendedprice")).alias("build"))


@query("I7_stage_summary", f"WITH r AS ({RUNS}), l AS (SELECT 'parse' AS stage, parse AS v FROM r UNION ALL SELECT 'build', build FROM r) SELECT stage, count(v) AS files, {AT.replace('{p}', '0.5')} AS p50, {AT.replace('{p}', '0.9')} AS p90, {AT.replace('{p}', '0.99')} AS p99, max(v) AS max FROM l WHERE v IS NOT NULL GROUP BY stage")
def _(t):
    return p.stage_summary(runs(t), ["parse", "build"])


@query("I7_failures", f"WITH r AS ({RUNS}) SELECT 'parse' AS stage, count(*) FILTER (parse IS NULL) AS failed FROM r UNION ALL SELECT 'build', count(*) FILTER (parse IS NOT NULL AND build IS NULL) FROM r")
def _(t):
    return p.failures(runs(t), ["parse", "build"])


@query("I7_slowest", f"WITH r AS ({RUNS}) SELECT file, build AS ms FROM r WHERE build IS NOT NULL ORDER BY build DESC, file LIMIT 10")
def _(t):
    return p.slowest(runs(t), F.col("build"))


@query("I8_largest_n", "SELECT path, min_by(size, ord) AS size FROM (SELECT concat('/f/', l_partkey) AS path, l_extendedprice AS size, l_orderkey * 10 + l_linenumber AS ord FROM {lineitem}) z WHERE path LIKE '%7%' GROUP BY path ORDER BY size DESC, path LIMIT 20")
def _(t):
    files = t.lineitem.select(F.concat(F.lit("/f/"), "l_partkey").alias("path"), F.col("l_extendedprice").alias("size"), (F.col("l_orderkey") * 10 + F.col("l_linenumber")).alias("ord"))
    return p.largest_n(files, "7", 20)


@query("I9_scenario_compare", "WITH s AS (SELECT topic AS name, seq % 2 AS side, CAST(floor(elapsed_ms * 4) AS BIGINT) AS v FROM {x7}), g AS (SELECT name, side, count(v) AS c, " + AT.replace("{p}", "0.5") + " AS p, avg(v) AS m FROM s GROUP BY name, side) SELECT name, a.c AS count_a, a.p AS p50_a, a.m AS mean_a, b.c AS count_b, b.p AS p50_b, b.m AS mean_b FROM (SELECT * FROM g WHERE side = 0) a FULL JOIN (SELECT * FROM g WHERE side = 1) b USING (name)")
def _(t):
    s = t.x7.select(F.col("topic").alias("name"), F.floor(F.col("elapsed_ms") * 4).alias("value"), "seq")
    return p.scenario_compare(s.filter("seq % 2 = 0"), s.filter("seq % 2 = 1"))


@query("H17_cache_rates", "SELECT kind AS namespace, count(*) FILTER (topic = 'view') AS hits, count(*) FILTER (topic = 'click') AS misses, count(*) FILTER (topic = 'error') AS evictions, count(*) FILTER (topic = 'view') / nullif(count(*) FILTER (topic IN ('view', 'click')), 0) AS hit_rate FROM {x7} GROUP BY kind")
def _(t):
    event = F.when(F.col("topic") == "view", "hit").when(F.col("topic") == "click", "miss").when(F.col("topic") == "error", "evict")
    return p.cache_rates(t.x7.select(F.col("kind").alias("namespace"), event.alias("event")))


@query("H17_miss_reasons", "WITH m AS (SELECT kind AS namespace, CASE seq % 4 WHEN 0 THEN 'absent' WHEN 1 THEN 'stale' WHEN 2 THEN 'evicted' ELSE 'unknown' END AS reason FROM {x7} WHERE topic = 'click'), n AS (SELECT namespace, reason, count(*) AS misses FROM m GROUP BY namespace, reason) SELECT namespace, reason, misses, misses / sum(misses) OVER (PARTITION BY namespace) AS share FROM n")
def _(t):
    reason = F.when(F.col("seq") % 4 == 0, "absent").when(F.col("seq") % 4 == 1, "stale").when(F.col("seq") % 4 == 2, "evicted")
    return p.miss_reasons(t.x7.select(F.col("kind").alias("namespace"), F.when(F.col("topic") == "click", "miss").otherwise("hit").alias("event"), reason.alias("reason")))
