"""What several operators share: the word pattern, the shared folder, files that tasks reach."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession

from symloom.functions.lineage import shared_folder as shared_dir

#: A word, everywhere in this subpackage: a run without ASCII white space.
WORD = r"[^\x20\x09-\x0D]+"
#: The same characters for Java's regular expressions, as a separator.
SPACES = r"[\x20\x09-\x0D]+"


def saved(df: DataFrame, name: str) -> DataFrame:
    """df, written once as Parquet to the shared folder and read back: a cut of the lineage
    that a lost executor doesn't undo."""
    path = shared_dir(df.sparkSession, name)
    df.write.parquet(path)
    return df.sparkSession.read.schema(df.schema).parquet(path)


class Scratch:
    """Intermediate tables of one computation: saved as `saved` does, and deleted as soon as
    they have been read for the last time, so that they don't stay on disk until its end."""

    def __init__(self, spark: SparkSession, name: str):
        self._spark, self._folder, self._held = spark, shared_dir(spark, name), {}

    def save(self, df: DataFrame, name: str, by: str | None = None) -> DataFrame:
        """With by, a folder for each value of that column, of which some can be dropped."""
        path = f"{self._folder}/{len(self._held)}-{name}"
        (df.write.partitionBy(by) if by else df.write).parquet(path)
        out = self._spark.read.schema(df.schema).parquet(path)
        self._held[path] = out
        return out

    def drop(self, *tables: DataFrame | None, part: str = "") -> None:
        """Deletes the files of saved tables, or of a part (column=value) of them; others, and
        None, are left alone. Shuffle files go when the driver's JVM notices that no plan needs
        them, so it is asked to look."""
        jvm, conf = self._spark.sparkContext._jvm, self._spark.sparkContext._jsc.hadoopConfiguration()
        for path in [p for p, held in self._held.items() if any(held is t for t in tables)]:
            if not part:
                self._held[path] = None
            at = jvm.org.apache.hadoop.fs.Path(f"{path}/{part}" if part else path)
            at.getFileSystem(conf).delete(at, True)
        jvm.System.gc()


def file_at(uri: str):
    """(file system, path) of a URI, for tasks that write or read raw files."""
    from pyarrow import fs

    if "://" not in uri and not uri.startswith("file:"):
        return fs.LocalFileSystem(), uri
    if uri.startswith("file:"):
        return fs.LocalFileSystem(), "/" + uri[5:].lstrip("/")
    return fs.FileSystem.from_uri(uri)


def free_name(df: DataFrame, name: str) -> str:
    """name, or name with underscores, so that it is no column of df yet."""
    taken = {c.lower() for c in df.columns}
    while name.lower() in taken:
        name += "_"
    return name
