"""Latency and size statistics."""

from __future__ import annotations

from functools import reduce

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from symloom.functions.lineage import cut
from symloom.functions.ranks import running
from symloom.sources.logs import event_name, number


def series(perf: DataFrame) -> DataFrame:
    """(name, value): every numeric value whose key ends with _ms, named by event and key."""
    pairs = perf.select(event_name(F.col("topic"), F.col("values")).alias("event"), F.explode("values").alias("key", "text"))
    return pairs.filter(F.col("key").endswith("_ms")).select(F.concat_ws(".", "event", "key").alias("name"), number(F.col("text")).alias("value")).filter("value is not null")


def percentile_rows(values: DataFrame, by: list[str], value: str, ps: dict[str, float]) -> DataFrame:
    """A column for each p of ps: the element at floor(p * (n - 1)) of a group's sorted values.

    Ranks come from a count of each distinct value, so a group's equal values are one row. The
    counts are cut, as they are read twice and values may be costly."""
    counts = cut(values.filter(F.col(value).isNotNull()).groupBy(*by, value).agg(F.count("*").alias("n_")))
    totals = counts.groupBy(*by).agg(F.sum("n_").alias("all_")).select(*[F.col(c).alias(f"{c}_of") for c in by], "all_")
    same = reduce(Column.__and__, [F.col(c).eqNullSafe(F.col(f"{c}_of")) for c in by], F.lit(True))
    ranked = running(counts, by, [value], "n_", "before_").join(totals, same).withColumn("upto_", F.col("before_") + F.col("n_"))
    at = lambda p: F.floor(F.lit(p) * (F.col("all_") - 1))
    hit = lambda p: (at(p) < F.col("upto_")) & (at(p) >= F.col("upto_") - F.col("n_"))
    return ranked.groupBy(*by).agg(*[F.max(F.when(hit(p), F.col(value))).alias(name) for name, p in ps.items()])


def compute_stats(values: DataFrame, by: list[str], value: str = "value") -> DataFrame:
    """count, min, p50, p90, p99, max, mean and sum of each group."""
    simple = values.filter(F.col(value).isNotNull()).groupBy(*by).agg(F.count("*").alias("count"), F.min(value).alias("min"), F.max(value).alias("max"), F.avg(value).alias("mean"), F.sum(value).alias("sum"))
    return simple.join(percentile_rows(values, by, value, {"p50": 0.5, "p90": 0.9, "p99": 0.99}), by)


def perf_report(perf: DataFrame) -> DataFrame:
    """Statistics of every series, largest sum first."""
    return compute_stats(series(perf), ["name"]).orderBy(F.desc("sum"), "name")


def capped_histogram(values: DataFrame, by: list[str], value: str, cap: int) -> DataFrame:
    """(by, bucket, n, over, most): counts by whole value, those of cap - 1 and above in the
    last bucket; over counts values of at least cap, most is the exact maximum."""
    b = F.least(F.floor(value), F.lit(cap - 1)).cast("long")
    out = values.withColumn("bucket", b).groupBy(*by, "bucket").agg(F.count("*").alias("n"), F.count_if(F.col(value) >= cap).alias("over"), F.max(value).alias("most"))
    every = Window.partitionBy(*by)
    return out.withColumns({"over": F.sum("over").over(every), "most": F.max("most").over(every)})


def histogram_percentile(histogram: DataFrame, by: list[str], p: float) -> DataFrame:
    """(by, p): the bucket that holds the element at floor(p * (n - 1))."""
    order = Window.partitionBy(*by).orderBy("bucket")
    ranked = histogram.withColumns({"upto": F.sum("n").over(order), "all": F.sum("n").over(Window.partitionBy(*by))})
    return ranked.filter(F.col("upto") > F.floor(F.lit(p) * (F.col("all") - 1))).groupBy(*by).agg(F.min("bucket").alias("p"))


def count_at_least(histogram: DataFrame, by: list[str], t: int) -> DataFrame:
    return histogram.groupBy(*by).agg(F.coalesce(F.sum(F.when(F.col("bucket") >= t, F.col("n"))), F.lit(0)).alias("n"))


def stage_summary(runs: DataFrame, stages: list[str]) -> DataFrame:
    """runs (file, one column of milliseconds a stage, null if skipped) -> stage, files and
    percentiles."""
    long = runs.unpivot(["file"], stages, "stage", "ms").filter("ms is not null")
    return compute_stats(long, ["stage"], "ms").select("stage", F.col("count").alias("files"), "p50", "p90", "p99", "max")


def failures(runs: DataFrame, stages: list[str]) -> DataFrame:
    """(stage, failed): for each stage the files that came to it and have no time, while a stage
    before it has one; stages are in the order in which they run."""
    came = [F.col(a).isNotNull() & F.col(b).isNull() for a, b in zip(stages, stages[1:], strict=False)]
    counts = runs.agg(F.count_if(F.col(stages[0]).isNull()).alias(stages[0]), *[F.count_if(c).alias(b) for c, b in zip(came, stages[1:], strict=False)])
    return counts.unpivot([], stages, "stage", "failed")


def slowest(runs: DataFrame, total: Column, n: int = 10) -> DataFrame:
    return runs.select("file", total.alias("ms")).orderBy(F.desc("ms"), "file").limit(n)


def largest_n(files: DataFrame, contains: str, n: int) -> DataFrame:
    """files (path, size, ord): the first entry of each path that holds a text, largest first."""
    first = files.filter(F.col("path").contains(contains)).groupBy("path").agg(F.min_by("size", "ord").alias("size"))
    return first.orderBy(F.desc("size"), "path").limit(n)


def scenario_compare(a: DataFrame, b: DataFrame) -> DataFrame:
    """(name, value) of two runs: count, p50 and mean side by side."""
    side = lambda x, s: compute_stats(x, ["name"]).select("name", *[F.col(c).alias(f"{c}_{s}") for c in ("count", "p50", "mean")])
    return side(a, "a").join(side(b, "b"), "name", "full_outer")


def cache_rates(events: DataFrame) -> DataFrame:
    """events (namespace, event): hits, misses, evictions and the share of hits."""
    n = lambda e: F.count_if(F.col("event") == e)
    return events.groupBy("namespace").agg(n("hit").alias("hits"), n("miss").alias("misses"), n("evict").alias("evictions"), (n("hit") / F.nullif(n("hit") + n("miss"), F.lit(0))).alias("hit_rate"))


def miss_reasons(events: DataFrame) -> DataFrame:
    """(namespace, reason, misses, share): the misses of each namespace by reason (a null one is
    'unknown'), and each reason's share of them."""
    per = events.filter("event = 'miss'").groupBy("namespace", F.coalesce("reason", F.lit("unknown")).alias("reason")).agg(F.count("*").alias("misses"))
    return per.withColumn("share", F.col("misses") / F.sum("misses").over(Window.partitionBy("namespace")))  # a row for each reason
