"""Index tables that lie by symbol, so that queries by symbol don't move them.

A clustered table's files are cut into buckets of a column's hash and sorted by it. A join or an
aggregation by that column reads each bucket in one task, without an exchange; only the other
side, the symbols asked for, is shuffled. Where the symbols are a short list, only their buckets
are read, and of these the row groups that can hold them."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from symloom.functions.bounded import FEW

#: Buckets of a clustered table; for large ones it is a parameter, so that a bucket fits a task.
BUCKETS = 16


def name_of(path: str) -> str:
    """The catalogue's name for a folder; the last part of it is unique (shared_folder)."""
    return "clustered_" + "".join(c if c.isalnum() else "_" for c in path.rstrip("/").rsplit("/", 1)[1].lower())


def write_clustered(df: DataFrame, path: str, by: str = "symbol_id", partitions: list[str] | None = None, buckets: int = BUCKETS) -> None:
    """df as a table in the folder path, in buckets of `by`, below partitions if any. Rows are
    brought to their buckets first, so that there is one file for each bucket and partition."""
    writer = df.repartition(buckets, by).write.format("parquet").option("path", path).bucketBy(buckets, by).sortBy(by)
    (writer.partitionBy(*partitions) if partitions else writer).saveAsTable(name_of(path))


def read_clustered(spark: SparkSession, path: str) -> DataFrame:
    return spark.table(name_of(path))


def rows_of_few(wanted: DataFrame, clustered: DataFrame, by: str = "symbol_id") -> DataFrame:
    """The rows of a clustered table of a short, stated list of symbols (wanted: by), which is
    looked at first and refused beyond FEW: of the table only their buckets are read."""
    ids = [r[0] for r in wanted.select(by).distinct().limit(FEW + 1).collect()]
    if len(ids) > FEW:
        raise ValueError(f"more than {FEW} rows in a stated list; join instead")
    return clustered.filter(F.col(by).isin([i for i in ids if i is not None])) if ids else clustered.limit(0)
