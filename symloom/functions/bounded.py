"""Stated lists that may be broadcast, because their size has been looked at."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

#: Rows of a stated list that meet every row of a table, at most.
FEW = 10_000


def few(asked: DataFrame) -> DataFrame:
    """A stated list of queries, locators or rules, to be broadcast: each of its rows is held
    against every row of a table, so a list that isn't short is refused."""
    n = asked.limit(FEW + 1).count()
    if n > FEW:
        raise ValueError(f"more than {FEW} rows in a stated list; ask in parts")
    return F.broadcast(asked)
