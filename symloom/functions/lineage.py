"""Cuts of the lineage in iterative jobs, in the folder that all executors share."""

from __future__ import annotations

import re
import tempfile
import uuid

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql.types import IntegerType, StructField, StructType


def shared_folder(spark: SparkSession, name: str) -> str:
    """A new folder below spark.checkpoint.dir; where that is unset and the session runs on a
    single machine, as in tests, a new temporary folder, which becomes the checkpoint folder."""
    root = spark.conf.get("spark.checkpoint.dir", None)
    if not root:
        context = spark.sparkContext
        if context.getCheckpointDir() is None:
            if not re.match(r"local(\[|$)", context.master):
                raise ValueError("spark.checkpoint.dir must name a folder that the driver and all executors share")
            context.setCheckpointDir("file://" + tempfile.mkdtemp(prefix="spark-"))
        root = context.getCheckpointDir()
    return f"{root.rstrip('/')}/{name}-{uuid.uuid4().hex}"


def cut(df: DataFrame) -> DataFrame:
    """df, written and read back, so that a loop's plan doesn't grow."""
    path = shared_folder(df.sparkSession, "cut")
    df.write.parquet(path)
    return df.sparkSession.read.schema(df.schema).parquet(path)


def delete(spark: SparkSession, path: str) -> None:
    at = spark.sparkContext._jvm.org.apache.hadoop.fs.Path(path)
    at.getFileSystem(spark.sparkContext._jsc.hadoopConfiguration()).delete(at, True)


class Grown:
    """A table that a loop adds to: a folder for each step, so that a step is read on its own and
    all steps are one scan, however many there are. all() has the step as column `at_step`."""

    def __init__(self, spark: SparkSession, name: str):
        self._spark, self._folder, self._steps, self._schema = spark, shared_folder(spark, name), 0, None

    def add(self, df: DataFrame) -> DataFrame:
        path = f"{self._folder}/at_step={self._steps}"
        df.write.parquet(path)
        self._schema, self._steps = df.schema, self._steps + 1
        return self._spark.read.schema(df.schema).parquet(path)

    def all(self) -> DataFrame:
        schema = StructType([*self._schema.fields, StructField("at_step", IntegerType())])
        return self._spark.read.schema(schema).parquet(self._folder)

    def drop(self) -> None:
        """Deletes what was added, once nothing reads it any more."""
        delete(self._spark, self._folder)
