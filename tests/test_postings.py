"""Search by postings of names, against the search that looks at every name."""

import random

from pyspark.sql import functions as F

from symloom.operators import search as s

SYMBOLS, RELATIONS = "symbol_id long, name string, kind string", "symbol_id long, kind string"


def test_same_as_looking_at_every_name(spark):
    rng = random.Random(5)
    names = ["".join(rng.choice("abcAB_:é") for _ in range(rng.randrange(0, 9))) for _ in range(400)] + [None, "", "a", "ab" * 3000]
    symbols = spark.createDataFrame([(k, n, rng.choice(["Class", "Macro", "Header"])) for k, n in enumerate(names)], SYMBOLS)
    defined = spark.createDataFrame([(k, rng.choice(["Definition", "Reference"])) for k in range(len(names)) for _ in (0, 1)], RELATIONS)
    asked = ["", "a", "B", "ab", "abc", "ABCA", "a_", "é", "Éa", "zz", "abz", "a:b", "%", "ab" * 50, None]
    queries = spark.createDataFrame([(q,) for q in asked * 2], "query string")
    got = s.search_by_postings(queries, symbols, s.name_postings(symbols), defined, most=30)
    want = s.search_symbols(queries, symbols, defined, most=30)
    assert sorted(map(tuple, got.collect())) == sorted(map(tuple, want.collect()))
    assert got.filter("query = 'abca'").count() == 0 and got.filter("query = 'ABCA'").count() > 0


def test_few_names_are_candidates(spark):
    rng = random.Random(6)
    symbols = spark.createDataFrame([(k, "".join(rng.choice("abcdefghij") for _ in range(12)), "Class") for k in range(4000)], SYMBOLS)
    queries = symbols.filter("symbol_id % 10 = 0").select(F.substring("name", 3, 6).alias("query"))
    met = s.candidates(queries, s.name_postings(symbols))
    assert met.count() < 0.05 * 4000 * queries.count()
    assert s.search_by_postings(queries, symbols, s.name_postings(symbols), symbols.select("symbol_id", F.lit("Definition").alias("kind"))).select("query").distinct().count() == queries.distinct().count()


def test_nothing_asked_or_nothing_there(spark):
    symbols, none = spark.createDataFrame([(1, "x", "Class")], SYMBOLS), spark.createDataFrame([], SYMBOLS)
    defined, queries = spark.createDataFrame([(1, "Definition")], RELATIONS), spark.createDataFrame([("x",)], "query string")
    assert s.search_by_postings(queries.filter("false"), symbols, s.name_postings(symbols), defined).count() == 0
    assert s.search_by_postings(queries, none, s.name_postings(none), defined).count() == 0
