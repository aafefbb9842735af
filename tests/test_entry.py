"""The driver's entry points, with and without the training-data subpackage."""

import os
import subprocess
import sys

import pytest

import __spark_entry__ as e

ROOT = os.path.dirname(os.path.abspath(e.__file__))

#: Makes modules of the names given look as if they weren't there.
ABSENT = """
import sys
from importlib.abc import MetaPathFinder
class Gone(MetaPathFinder):
    def find_spec(self, name, path, target=None):
        if name.split(".")[:2] == ["symloom", "llm"] or name == "corpus_pipeline":
            raise ModuleNotFoundError(f"No module named {name!r}", name=name)
sys.meta_path.insert(0, Gone())
import __spark_entry__ as e
print(len(e.queries()), len(e.oracle_sql()), any(n.startswith("op") or n == "pipeline" for n in e.queries()))
"""


def test_names():
    queries, sql = e.queries(), e.oracle_sql()
    assert set(sql) <= set(queries) and all(callable(q) for q in queries.values())


def test_without_the_training_data_subpackage():
    out = subprocess.run([sys.executable, "-c", ABSENT], cwd=ROOT, capture_output=True, text=True, check=True).stdout.split()
    own = [n for n in e.queries() if not n.startswith("op") and n != "pipeline"]
    assert out == [str(len(own)), str(len([n for n in e.oracle_sql() if not n.startswith("op")])), "False"]


def test_entry(spark):
    if not os.path.isdir("/root/testdata/sf0.001"):
        pytest.skip("no test tables")
    out = e.entry(spark)
    assert "symbol_id" in out.columns and out.count() > 0


def test_only_the_fuzzy_ranks_have_no_sql():
    sql, own = e.oracle_sql(), [n for n in e.queries() if not n.startswith("op") and n != "pipeline"]
    assert [n for n in own if n not in sql] == ["G26_fuzzy_rank"]


def test_written_tables_are_made_again(spark):
    import shutil

    from symloom.plans import derived

    if not os.path.isdir("/root/testdata/sf0.001"):
        pytest.skip("no test tables")
    n = derived.table(spark, "/root/testdata/sf0.001", "x4").count()
    path = derived._written[spark.sparkContext.applicationId, "/root/testdata/sf0.001", "x4"]
    shutil.rmtree(path.removeprefix("file:").replace("//", "/"))
    assert derived.table(spark, "/root/testdata/sf0.001", "x4").count() == n > 0
