"""Registered queries: name -> function, and name -> SQL for DuckDB."""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import DataFrame, SparkSession

from .derived import firsts, oracle, table, texts, words

QUERIES: dict[str, Callable[[SparkSession, str], DataFrame]] = {}
ORACLES: dict[str, str] = {}


class Inputs:
    """The tables of a scale factor, by attribute: driver tables and derived ones."""

    def __init__(self, spark: SparkSession, sf_dir: str):
        self.spark, self.sf_dir = spark, sf_dir

    @property
    def symbols(self) -> DataFrame:
        """Each symbol of x4 once: symbol_id, name, and the file_id, begin_off and len of its first place."""
        return firsts(self.spark, self.sf_dir)

    @property
    def texts(self) -> DataFrame:
        """The texts whose words are x4: file_id, tu, content."""
        return texts(self.spark, self.sf_dir)

    def words(self, *only: str, small: bool = False, lists: bool = False) -> DataFrame:
        """x4 with these columns only; others aren't made. If small, in tasks that can hold their
        rows; if lists, with lists for a file."""
        return words(self.spark, self.sf_dir, *only, small=small, lists=lists)

    def __getattr__(self, name: str) -> DataFrame:
        return table(self.spark, self.sf_dir, name)


def query(name: str, sql: str | None = None):
    """Registers a function of Inputs under a name, with its SQL where there is one."""

    def add(f: Callable[[Inputs], DataFrame]):
        QUERIES[name] = lambda spark, sf_dir: f(Inputs(spark, sf_dir))
        if sql:
            ORACLES[name] = oracle(sql)
        return f

    return add
