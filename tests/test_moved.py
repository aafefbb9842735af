"""What is written and moved of words: no more than a query needs."""

import os
import re

import pyarrow as pa
import pytest
from pyspark.sql import functions as F

from symloom.operators import ingest, scan
from symloom.operators import occurrences as o
from symloom.plans import QUERIES, derived

SF = "/root/testdata/sf0.001"
tables = pytest.mark.skipif(not os.path.isdir(SF), reason="no test tables")


def plan_of(df, kind="executedPlan"):
    return getattr(df._jdf.queryExecution(), kind)().toString()


def made(plan):
    """The columns that each scan of texts makes."""
    return [sorted(re.findall(r"(\w+)#", x)) for x in re.findall(r"MapInArrow \w+\(.*?\)[^,]*, \[(.*?)\]", plan)]


def batches(n=7):
    texts = [[f"W{(k * j) % 13} w{k % 3}\nz" * (k % 4) for j in range(5)] for k in range(n)]
    return [pa.RecordBatch.from_pydict({"file_id": [5 * ((k * 3) % n) + j for j in range(5)], "tu": ["t"] * 5, "content": t}) for k, t in enumerate(texts)]


@pytest.mark.parametrize("known", [1 << 21, 3])
def test_a_task_passes_on_early_places_only(monkeypatch, known):
    monkeypatch.setattr(o, "KNOWN", known)
    rows = lambda f: [r for part in f(iter(batches())) for r in part.to_pylist()]
    every, early = rows(o.first_words), rows(o.early_words)
    first = lambda x: {s: min((r["file_id"], r["begin_off"]) for r in x if r["symbol_id"] == s) for s in {r["symbol_id"] for r in x}}
    assert first(every) == first(early) == first(rows(o.words))
    assert len(early) < len(every) or known < 4
    assert all(r in every for r in early)
    # The same place twice is kept twice, and texts without a number are left alone.
    twice = batches()[1:2] * 2
    assert sum(len(x) for x in o.early_words(iter(twice))) == sum(len(x) for x in o.first_words(iter(twice)))
    none = pa.RecordBatch.from_pydict({"file_id": pa.array([None, 1], pa.int64()), "tu": ["t"] * 2, "content": ["a a", "a"]})
    assert sum(len(x) for x in o.early_words(iter([none]))) == 3


def test_columns_that_are_not_asked_for_are_not_made(spark):
    own = spark.createDataFrame([(1, "a", " Ab  é\n\nab x \n y"), (2, "a", None), (3, "b", "")], "file_id long, tu string, content string")
    for only in (["begin_off", "file_id"], ["tu", "line", "tok", "len"], ["name"], ["nxt", "symbol_id"]):
        got = o.occurrences(own, *only)
        assert got.columns == only and sorted(map(str, got.collect())) == sorted(map(str, o.occurrences(own).select(*only).collect()))


def test_files_that_are_work_for_all_cores():
    mb = 1 << 20
    assert derived.dealt_out([13 * mb] * 8, 12) and derived.dealt_out([30 * mb] * 32, 12) and derived.dealt_out([300 * mb] * 20, 12)
    assert not derived.dealt_out([15 * mb], 8) and not derived.dealt_out([13 * mb] * 5, 12) and not derived.dealt_out([900 * mb, *[mb] * 20], 12)


@tables
def test_texts_in_many_files_are_not_written(spark, tmp_path):
    spark.read.parquet(f"{SF}/documents.parquet").repartition(8).write.parquet(f"{tmp_path}/documents.parquet")
    for name in ("F26_kind_histogram", "G18_search_symbols", "G19_symbol_search", "G20_locate_by_id"):
        for x in ("nation", "region"):
            if not (tmp_path / f"{x}.parquet").exists():
                os.symlink(f"{SF}/{x}.parquet", tmp_path / f"{x}.parquet")
        got, want = (sorted(map(str, QUERIES[name](spark, at).collect())) for at in (str(tmp_path), SF))
        assert got == want, name
    assert [name for (_, at, name) in derived._written if at == str(tmp_path)] == ["firsts"]


@tables
def test_words_of_totals_stay_unmarked(spark):
    plan = plan_of(QUERIES["G10_reference_totals"](spark, SF))
    assert made(plan) == [["begin_off", "file_id", "symbol_id"]] and "collect_list" not in plan


@tables
def test_fuzzy_names_are_made_alone(spark):
    assert made(plan_of(QUERIES["G26_fuzzy_rank"](spark, SF))) == [["name"]]


@tables
def test_offsets_need_no_words(spark):
    assert ["begin_off", "file_id"] in made(plan_of(QUERIES["C5_to_position"](spark, SF)))


def test_a_line_is_carried_as_one(spark):
    lines = spark.createDataFrame([(1, 0, 0, 3), (1, 1, 4, 0)], "file_id long, line long, start long, len long")
    got = scan.to_position(spark.createDataFrame([(1, 0), (1, 3), (1, 4), (1, 5), (2, 0)], "file_id long, offset long"), lines)
    assert plan_of(got, "optimizedPlan").count("last(") == 1
    assert sorted(map(tuple, got.collect()), key=str) == [(1, 0, 0, 0), (1, 3, 0, 3), (1, 4, 1, 0), (1, 5, None, None), (2, 0, None, None)]


@tables
def test_local_names_are_made_of_what_they_need(spark):
    assert sorted(made(plan_of(QUERIES["F8_local_names"](spark, SF)))) == [["file_id", "symbol_id"], ["name", "symbol_id", "tu"]]


@tables
def test_rows_are_dealt_out_in_small_tasks(spark):
    plan = plan_of(QUERIES["F1_canonical_rows"](spark, SF))
    # Texts by number, rows by file, and sums by unit; no partial aggregate of what doesn't repeat.
    assert plan.count("Exchange") == 3 and plan.count("REPARTITION_BY_NUM") == plan.count("REPARTITION_BY_COL") == 1


def test_symbols_of_rejected_units_are_not_moved(spark):
    symbols = spark.createDataFrame([("t", 1, "a", "k", "External", 1), ("u", 1, "b", "k", "External", 2), ("u", 2, "c", "k", "FileLocal", 9), ("v", 1, "c", "k", "External", 1)], "tu string, symbol_id long, name string, kind string, scope string, file_id long")
    files = spark.createDataFrame([(1,), (2,)], "file_id long")
    for used in (None, symbols.select("tu", "file_id")):
        got = ingest.merge_symbols(symbols, files, used)
        assert re.search(r"BroadcastHashJoin \[tu#\d+\], \[tu#\d+\], LeftAnti", plan_of(got))
        assert [tuple(r) for r in got.collect()] == [(1, "a", "k", 1)]
    assert ingest.symbol_files(symbols, files).agg(F.count("*")).first()[0] == 1
