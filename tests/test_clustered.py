"""Plans and rows of tables that lie by symbol."""

from pyspark.sql import functions as F

from symloom.functions.lineage import shared_folder
from symloom.operators import clustered as c
from symloom.operators import search as s


def plan(df):
    df.collect()
    return df._jdf.queryExecution().executedPlan().toString()


def test_joins_by_symbol_move_only_what_is_asked(spark):
    rows = spark.range(20_000).select((F.col("id") % 997).alias("symbol_id"), F.when(F.col("id") % 3 == 0, "Caller").otherwise("Reference").alias("kind"), F.col("id").alias("begin"))
    path = shared_folder(spark, "relations")
    c.write_clustered(rows, path, partitions=["kind"], buckets=8)
    table = c.read_clustered(spark, path)
    old = spark.conf.get("spark.sql.autoBroadcastJoinThreshold")
    spark.conf.set("spark.sql.autoBroadcastJoinThreshold", -1)
    try:
        wanted = spark.range(0, 997, 2).withColumnRenamed("id", "symbol_id")
        found = s.relations_of(wanted, table, "Reference")
        text = plan(found)
        assert found.count() == rows.filter("symbol_id % 2 = 0 and kind = 'Reference'").count()
        # Both exchanges, of the aggregation over what is asked and of the join, are on its side.
        scan = text[text.index("FileScan") :]
        assert "Bucketed: true" in scan and "PartitionFilters: [isnotnull(kind" in scan
        before = text[: text.index("FileScan")].rsplit("Join", 1)[1]
        assert "Exchange" not in before
        per = table.groupBy("symbol_id").agg(F.count("*").alias("n"))
        assert "Exchange" not in plan(per)
    finally:
        spark.conf.set("spark.sql.autoBroadcastJoinThreshold", old)
    few = c.rows_of_few(wanted.limit(1), table)
    assert few.count() == rows.filter("symbol_id = 0").count()
    # One file for each kind, of the bucket; the other fourteen aren't opened.
    read = few.select("begin")
    assert "EqualTo(symbol_id,0)" in plan(read)
    scan = read._jdf.queryExecution().executedPlan().collectLeaves().head()
    rows_read = scan.metrics().apply("numOutputRows").value()
    assert 0 < rows_read <= rows.count() / 4
    assert c.rows_of_few(wanted.limit(0), table).count() == 0
