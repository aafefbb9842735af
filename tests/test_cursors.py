"""Cursors in texts, against the same cursors over occurrences and relations as rows."""

import random

import numpy as np
import pyarrow as pa
from pyspark.sql import functions as F

from symloom.operators import cursors as k
from symloom.operators import occurrences as o
from symloom.operators import search as s
from symloom.plans import QUERIES

SF = "/root/testdata/sf0.001"


def kinds(symbol, begin, first):
    return np.where(first, 2, np.where(begin % 3 == 0, 1, 0))


def given(spark):
    rng = random.Random(5)
    texts = [(f, "t", "".join(rng.choice(["a", "b", "éé", "Ab", " ", " ", "\n"]) for _ in range(60))) for f in range(12)] + [(20, "t", None), (21, "t", ""), (22, "t", "x"), (None, "t", "a b"), (None, "t", "ab\na")]
    asked = [(f, at) for f in [*range(10), 20, 21, 22, 99, None] for at in [*range(-1, 80), 3, 3, None]]
    return spark.createDataFrame(texts, "file_id long, tu string, content string"), spark.createDataFrame(asked, "file_id long, offset long")


def test_word_at_as_symbol_at(spark):
    texts, cursors = given(spark)
    rows = o.occurrences(texts).select("file_id", F.col("begin_off").alias("begin"), (F.col("begin_off") + F.col("len")).alias("end"), "symbol_id")
    want = sorted(map(tuple, s.symbol_at(cursors, rows).collect()))
    got = k.word_at(cursors, texts)
    assert sorted(map(tuple, got.collect())) == want and len(want) > 200
    lists = cursors.groupBy("file_id", F.col("offset") % 3).agg(F.collect_list("offset").alias("offset")).select("file_id", "offset")
    assert sorted(map(tuple, k.word_at(lists.union(lists), texts).collect())) == want


def test_place_counts_of_as_place_counts(spark):
    texts, cursors = given(spark)
    words = o.occurrences(texts).withColumn("end", F.col("begin_off") + F.col("len")).withColumnRenamed("begin_off", "begin")
    firsts = o.firsts(texts.filter("file_id is not null"))
    first = firsts.select("file_id", F.col("begin_off").alias("begin"), F.lit(True).alias("first"))
    kind = F.when(F.col("first"), "Definition").when(F.col("begin") % 3 == 0, "Declaration").otherwise("Reference")
    relations = words.join(first, ["file_id", "begin"], "left").select("file_id", "symbol_id", kind.alias("kind"), "begin", "end")
    for which in (True, False):
        want = sorted(map(tuple, s.place_counts(cursors, words.select("file_id", "begin", "end", "symbol_id"), relations, which).select("cursor_file", "offset", "n", "s").collect()))
        assert sorted(map(tuple, k.place_counts_of(cursors, texts, firsts, kinds, which).collect())) == want and len(want) > 200


def test_files_and_symbols_over_many_batches(monkeypatch):
    types = pa.schema([("file_id", pa.int64()), ("what", pa.int32()), ("content", pa.string()), ("offset", pa.list_(pa.int64()))])
    rows = [r for f in range(9) for r in [(f, 0, "ab c ab d " * (f % 4), None), (f, 1, None, [0]), (f, 2, None, [0, 5, 4]), (f, 2, None, [5, 8]), (f, 2, None, [])]]
    batches = lambda size: (pa.RecordBatch.from_pylist([dict(zip(types.names, r, strict=True)) for r in rows[a : a + size]], types) for a in range(0, len(rows), size))
    flat = lambda parts: sorted(tuple(r.values()) for p in parts for r in p.to_pylist())

    def all_of(size):
        found = flat(k.words_held(batches(size)))
        parts = [r for p in k.by_symbol(batches(size), kinds) for r in p.to_pylist()]
        met = pa.Table.from_pylist(sorted(parts, key=lambda r: (r["symbol_id"], r["asked"])), pa.schema([("symbol_id", pa.int64()), ("asked", pa.bool_()), ("sums", pa.list_(pa.int64())), ("cursor_file", pa.list_(pa.int64())), ("code", pa.list_(pa.int64()))]))
        return found, [flat(k.counted(iter(met.to_batches(max_chunksize=size)), which)) for which in (True, False)]

    want = all_of(99)
    assert [r[:4] for r in want[0] if r[0] == 1] == [(1, 0, 0, 2), (1, 4, 3, 4), (1, 5, 5, 7), (1, 8, 8, 9)]
    for size, limits in ((3, {}), (99, {"SLICE": 12, "LIST": 2, "AT_ONCE": 3}), (2, {"SLICE": 12, "LIST": 1, "AT_ONCE": 1})):
        with monkeypatch.context() as m:
            for name, limit in limits.items():
                m.setattr(o, name, limit)
            m.setattr(k, "TOGETHER", 6)
            assert all_of(size) == want


def test_cursors_meet_texts_once(spark):
    # Before: occurrences as rows of their own, and a sort, a join and an aggregation for each.
    plan = lambda name: QUERIES[name](spark, SF)._jdf.queryExecution().executedPlan().toString()
    assert plan("G1_symbol_at").count("Exchange") == 1 and "Join" not in plan("G1_symbol_at")
    for name in ("G5_definition", "G6_declaration"):
        assert plan(name).count("Exchange") == 2 and "Join" not in plan(name)
