"""Mixing sources to target weights by weighted fair queueing.

Each source is a flow of its documents in shuffled order, all of them once and then all of them
again, in packets of at most PACKET words. A packet's virtual finish time is the source's words
up to its end divided by the source's target. All packets are range-sorted by finish time, over
all sources, and the order is truncated where its running total of words would exceed the total
budget. What a document has before the cut is taken; `copies` rounds it to whole documents.

The running sums are distributed. A document's place in the shuffle is a hash, its leading bits
name a bucket, and only sums of buckets are carried from bucket to bucket, so that a source with
a third of all rows is spread over as many tasks as it has buckets. In the same way only sums of
ranges of finish times are carried, and the range that the cut falls into is looked at alone.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from .shared import WORD, saved

WEIGHTS = (5.0, 2.0, 1.0)
#: Rows of a source that share a bucket, about, beyond the least number of buckets.
BUCKET_ROWS = 20_000
LEAST_BUCKETS = 256
#: Words of a packet, and ranges of one unit of virtual time, at least.
PACKET = 128
LEAST_RANGES = 4096


def n_words(text: Column) -> Column:
    """Words of a text (long); null: 0."""
    return F.coalesce(F.regexp_count(text, F.lit(WORD)), F.lit(0)).cast("long")


def targets(totals: DataFrame, weights=WEIGHTS, share: float = 1.5, most: float = 2.0) -> DataFrame:
    """totals (key, source_size: one row a source) with `target`.

    Sources in order of key weigh as `weights`, repeating. They share `share` times all sizes
    by weight; a target stops at `most` times its source's size and what is above is shared
    again by weight. That is a water level: target = least(cap, level * weight), and sorted by
    cap / weight the capped sources come first, so the level is found from running sums."""
    ranked = totals.withColumn("rank", F.row_number().over(Window.orderBy("key")) - 1)
    w = F.element_at(F.array(*[F.lit(float(x)) for x in weights]), (F.col("rank") % len(weights) + 1).cast("int"))
    flow = ranked.withColumn("weight", w).withColumn("cap", most * F.col("source_size"))
    order = Window.orderBy(F.col("cap") / F.col("weight"), "key")
    before, everything = order.rowsBetween(Window.unboundedPreceding, -1), Window.partitionBy()
    left = share * F.sum("source_size").over(everything) - F.coalesce(F.sum("cap").over(before), F.lit(0.0))
    weighing = F.sum("weight").over(order.rowsBetween(Window.currentRow, Window.unboundedFollowing))
    level = flow.withColumn("level", left / weighing)
    first_open = F.min(F.when(F.col("cap") > F.col("level") * F.col("weight"), F.struct(F.col("cap") / F.col("weight"), "key", "level"))).over(everything)
    return level.select("key", "source_size", F.coalesce(F.least("cap", first_open["level"] * F.col("weight")), "cap").alias("target"))


def cut_time(packets: DataFrame, budget: float, ranges: int) -> float:
    """The finish time of the packet with which the words of packets (finish, words), in order of
    finish time, exceed the budget; infinite if they don't. Packets of one time count together."""
    part = F.least(F.floor(F.col("finish") * ranges), F.lit(2 * ranges))
    upto = lambda c: F.sum("words").over(Window.orderBy(c))
    ranged = packets.withColumn("range", part)
    sums = ranged.groupBy("range").agg(F.sum("words").alias("words")).withColumn("upto", upto("range"))
    crossed = sums.filter(F.col("upto") > budget).orderBy("range").first()  # a row, of a row for each range
    if crossed is None:
        return float("inf")
    left = budget - (crossed["upto"] - crossed["words"])
    times = ranged.filter(F.col("range") == crossed["range"]).groupBy("finish").agg(F.sum("words").alias("words"))
    return times.withColumn("upto", upto("finish")).filter(F.col("upto") > left).agg(F.min("finish")).first()[0]


def mix(docs: DataFrame, size: str = "size", source: str = "source", key: str = "doc_id", weights=WEIGHTS, share: float = 1.5, most: float = 2.0, seed: int = 7) -> DataFrame:
    """One row per row of docs: `row` (struct of all its columns, whatever their names), size,
    source_size, target, taken (words, repeats counted; at most twice the size), copies (0, 1
    or 2 whole documents) and finish (virtual time at which its first copy is served).

    docs must have the words of each document in the column `size`. Null sizes count as 0;
    null sources are one source, the last; a null key is a key like others. Rows that agree in
    all columns are served one after another. A row of size 0 is never taken. An empty table
    gives an empty table. The order depends on key, size and seed only, so reruns agree."""
    columns = [
        F.coalesce(F.concat(F.lit("0"), F.col(source).cast("string")), F.lit("1")).alias("key"),
        F.xxhash64(F.lit(seed), F.col(key)).alias("place"),
        F.coalesce(F.col(size), F.lit(0)).cast("long").alias("size"),
    ]
    slim = saved(docs.select(*columns), "mix-sizes")
    counts = slim.groupBy("key").agg(F.count("*").alias("n"), F.sum("size").alias("size")).agg(F.max("n").alias("n"), F.sum("size").alias("size")).first()
    bits = max(LEAST_BUCKETS, (counts["n"] or 0) // BUCKET_ROWS).bit_length()
    bucket = F.shiftrightunsigned("place", 64 - bits)
    buckets = slim.groupBy("key", bucket.alias("bucket")).agg(F.sum("size").alias("n"))
    upto = Window.partitionBy("key").orderBy("bucket").rowsBetween(Window.unboundedPreceding, -1)
    offsets = buckets.select("key", "bucket", F.coalesce(F.sum("n").over(upto), F.lit(0)).alias("offset"))
    goal = targets(buckets.groupBy("key").agg(F.sum("n").alias("source_size")), weights, share, most)
    flows = saved(offsets.join(goal, "key"), "mix-buckets")
    within = Window.partitionBy("key", "bucket").orderBy("place", "size").rowsBetween(Window.unboundedPreceding, -1)
    ends = lambda end: end / F.nullif("target", F.lit(0.0))

    def served(flow: DataFrame) -> DataFrame:
        before = flow.withColumn("bucket", bucket).withColumn("before", F.coalesce(F.sum("size").over(within), F.lit(0)))
        return before.join(flows, ["key", "bucket"]).withColumn("start", F.col("offset") + F.col("before"))

    copies = F.array(F.lit(0).cast("long"), F.col("source_size"))
    parts = F.transform(F.sequence(F.lit(0).cast("long"), F.floor((F.col("size") - 1) / PACKET)), lambda k: k * PACKET)
    packets = served(slim).filter("size > 0").withColumn("start", F.explode(F.transform(copies, lambda c: c + F.col("start")))).withColumn("part", F.explode(parts))
    words = F.least(F.lit(PACKET), F.col("size") - F.col("part"))
    packets = packets.select(ends(F.col("start") + F.col("part") + words).alias("finish"), words.alias("words"))
    total = counts["size"] or 0
    cut = cut_time(packets, share * total, max(LEAST_RANGES, 2 * total // PACKET // BUCKET_ROWS))

    def before_cut(start: Column) -> Column:
        """The words of a document's packets that finish before the cut."""
        whole = ends(start + F.col("size")) < cut
        done = F.size(F.filter(parts, lambda p: ends(start + F.least(p + PACKET, "size")) < cut)) * PACKET
        return F.when(F.col("size") == 0, 0).when(whole, F.col("size")).when(ends(start) >= cut, 0).otherwise(F.least(done, "size")).cast("long")

    out = served(docs.select(F.struct(*[F.col(f"`{c}`") for c in docs.columns]).alias("row"), *columns))
    out = out.withColumns({"once": before_cut(F.col("start")), "again": before_cut(F.col("source_size") + F.col("start"))})
    rounded = lambda part: F.when((F.col(part) > 0) & (2 * F.col(part) >= F.col("size")), 1).otherwise(0)
    return out.select("row", "size", "source_size", "target", (F.col("once") + F.col("again")).alias("taken"), (rounded("once") + rounded("again")).alias("copies"), ends(F.col("start") + F.col("size")).alias("finish"))


def served_order(mixed: DataFrame) -> DataFrame:
    """The rows in the order in which they are served, by one range sort."""
    return mixed.orderBy(F.col("finish").asc_nulls_last(), "size")
