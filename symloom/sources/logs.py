"""Logs as tables: perf lines, anomaly lines, session traces."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from symloom.functions.columns import basename
from symloom.functions.ranks import numbered

#: Fixed value: `[stamp] ... [perf:topic] key=value key=value`; a value runs to the next key.
PERF_LINE = r"^(?:\[(\d{4}-\d{2}-\d{2} \d{2}:\d{2}:\d{2}\.\d{3})\] )?.*?\[perf:([\w-]+)\] (.*)$"
PAIRS = r"(\w+)=(.*?)(?=\s\w+=|[\n\r\u0085\u2028\u2029]|\z)"


def perf_events(lines: DataFrame, line: str = "value", file: str = "file") -> DataFrame:
    """topic, ts (no zone; null without a stamp), pid (one per file, from 1), tid, values.

    Lines of other kinds are dropped. Of a repeated key the last value counts."""
    part = lambda i: F.regexp_extract(line, PERF_LINE, i)
    found = lines.filter(F.col(line).rlike(PERF_LINE)).select(F.col(file).alias("file"), F.to_timestamp_ntz(F.nullif(part(1), F.lit("")), F.lit("yyyy-MM-dd HH:mm:ss.SSS")).alias("ts"), part(2).alias("topic"), part(3).alias("rest"), F.regexp_extract(line, r"\[thread (\d+)\]", 1).alias("thread"))
    keys = F.regexp_extract_all("rest", F.lit(PAIRS), F.lit(1))
    values = F.regexp_extract_all("rest", F.lit(PAIRS), F.lit(2))
    last = F.filter(F.arrays_zip(keys.alias("k"), values.alias("v")), lambda x, i: ~F.array_contains(F.slice(keys, i + 2, F.size(keys)), x["k"]))
    lanes = numbered(found.select("file").distinct(), ["file"], "pid").withColumn("pid", F.col("pid").cast("int"))
    return found.join(lanes, "file").select("file", "topic", "ts", "pid", F.when(F.col("thread") == "", 1).otherwise(F.col("thread").cast("long")).alias("tid"), F.map_from_entries(last).alias("values"))


def read_perf_log(spark: SparkSession, path: str) -> DataFrame:
    """perf_events of text files."""
    return perf_events(spark.read.text(path).withColumn("file", F.input_file_name()))


def anomalies(lines: DataFrame, line: str = "value") -> DataFrame:
    """kind (anomaly or guidance), id (null for guidance), message."""
    pattern = r"\[(?:anomaly:([\w-]+)|guidance)\] (.*)$"
    id_ = F.nullif(F.regexp_extract(line, pattern, 1), F.lit(""))
    return lines.filter(F.col(line).rlike(pattern)).select(F.when(id_.isNotNull(), "anomaly").otherwise("guidance").alias("kind"), id_.alias("id"), F.regexp_extract(line, pattern, 2).alias("message"))


def read_anomaly_log(spark: SparkSession, path: str) -> DataFrame:
    return anomalies(spark.read.text(path))


def session_messages(rows: DataFrame) -> DataFrame:
    """rows (ts, msg: JSON text) with method, id and params of the message."""
    get = lambda p: F.get_json_object("msg", p)
    place = ["pos"] if "pos" in rows.columns else []
    return rows.select("ts", *place, get("$.method").alias("method"), get("$.id").alias("id"), get("$.params").alias("params"))


def read_session_trace(spark: SparkSession, path: str) -> DataFrame:
    """A session's JSON lines {ts, msg}, msg being an object or its text. pos is the place of a
    line: that of its part of the file, and then within it."""
    raw = spark.read.text(path).withColumn("pos", F.struct(F.col("_metadata.file_path").alias("file"), F.col("_metadata.file_block_start").alias("block"), F.monotonically_increasing_id().alias("line")))
    rows = raw.select(F.get_json_object("value", "$.ts").cast("double").alias("ts"), F.get_json_object("value", "$.msg").alias("msg"), "pos")
    return session_messages(rows)


def trace_summary(trace: DataFrame, top: int = 8) -> DataFrame:
    """The most frequent methods; of equals the one that comes first: by pos, the place in the
    trace, where the table has it, and else by ts. Each row also has the number of messages and
    the duration of the whole trace."""
    at = "pos" if "pos" in trace.columns else "ts"
    whole = trace.agg(F.count("*").alias("messages"), (F.max("ts") - F.min("ts")).alias("duration"))
    counts = trace.filter("method is not null").groupBy("method").agg(F.count("*").alias("n"), F.min(at).alias("first")).orderBy(F.desc("n"), "first", "method").limit(top)
    return counts.crossJoin(F.broadcast(whole)).select("method", "n", "messages", "duration")


def event_name(topic: Column, values: Column) -> Column:
    """topic[.kind or phase or op][.scope or rel]."""
    get = lambda k: F.try_element_at(values, F.lit(k))
    return F.concat_ws(".", topic, F.coalesce(get("kind"), get("phase"), get("op")), F.coalesce(get("scope"), get("rel")))


def number(text: Column) -> Column:
    """A finite number, or null."""
    n = text.try_cast("double")
    return F.when(~F.isnan(n) & (F.abs(n) != float("inf")), n)


def chrome_trace(perf: DataFrame) -> DataFrame:
    """Trace events, one JSON object a row: spans [ts - dur, ts] in microseconds since the
    first stamp of all files, and for each process lane a name, its file's base name. Lines without a stamp or a
    numeric total_ms or elapsed_ms have no span."""
    ms = F.unix_micros(F.col("ts").cast("timestamp")) / 1000
    base = perf.agg(F.min(ms).alias("base"))
    dur = number(F.coalesce(F.try_element_at("values", F.lit("total_ms")), F.try_element_at("values", F.lit("elapsed_ms"))))
    spans = perf.filter("ts is not null").withColumn("d", dur).filter("d is not null").crossJoin(F.broadcast(base))
    out = spans.select(F.to_json(F.struct(event_name(F.col("topic"), F.col("values")).alias("name"), F.col("topic").alias("cat"), F.lit("X").alias("ph"), ((ms - F.col("base") - F.col("d")) * 1000).cast("long").alias("ts"), (F.col("d") * 1000).cast("long").alias("dur"), "pid", "tid", F.col("values").alias("args"))).alias("value"))
    names = perf.select("pid", "file").distinct().select(F.to_json(F.struct(F.lit("process_name").alias("name"), F.lit("M").alias("ph"), "pid", F.struct(basename(F.col("file")).alias("name")).alias("args"))).alias("value"))
    return names.union(out)


def export_chrome_trace(perf: DataFrame, path: str) -> None:
    chrome_trace(perf).write.text(path)
