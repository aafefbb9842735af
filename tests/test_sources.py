"""Texts as files of their own, written by tasks and read back."""

from pyspark.sql import functions as F

from symloom.operators import ingest as i
from symloom.operators import perf
from symloom.operators import scan as s


def test_each_text_is_a_file(spark, tmp_path):
    texts = [(k, f"é {k}\n" * (k % 4)) for k in range(40)] + [(7, "the same id"), (50, None)]
    table = spark.createDataFrame(texts, "file_id long, content string")
    for folder in (f"file://{tmp_path}/a", f"{tmp_path}/b"):
        assert s.write_sources(table, folder) == 41
        # Again, as a task that is run anew does: no file is there twice.
        assert s.write_sources(table, folder) == 41
        back = s.read_sources(spark, folder)
        assert sorted(r["content"] for r in back.collect()) == sorted(x + "\n" for _, x in texts if x is not None)
        assert back.agg(F.sum("size")).first()[0] == sum(len(x.encode()) + 1 for _, x in texts if x is not None)
    assert len([d for d in (tmp_path / "a").iterdir() if d.is_dir()]) <= s.FOLDERS


def test_sizes_of_variants_step_by_step(spark):
    rows = [(k % 3, f"t{k % 4}", k % 5, k % 7) for k in range(60)] * 2
    table = spark.createDataFrame(rows, "line long, tu string, tok long, symbol_id long")
    got = {r["line"]: (r["m"], r["s"], r["rows"], r["all_rows"]) for r in i.variant_sizes(table, "line", "tu", "symbol_id", ["tok", "symbol_id"]).collect()}
    of = lambda line, pick: len({pick(r) for r in rows if r[0] == line})
    assert got == {n: (of(n, lambda r: r[1]), of(n, lambda r: r[3]), of(n, lambda r: r[2:]), of(n, lambda r: r)) for n in range(3)}
    plan = i.variant_sizes(table, "line", "tu", "symbol_id", ["tok", "symbol_id"])._jdf.queryExecution().executedPlan().toString()
    assert "Expand" not in plan


def test_percentiles_read_their_values_once(spark):
    values = spark.createDataFrame([("a", k) for k in range(11)] + [("b", 3)], "name string, value long")
    plan = perf.percentile_rows(values, ["name"], "value", {"p50": 0.5})
    assert {tuple(r) for r in plan.collect()} == {("a", 5), ("b", 3)}
    assert "ExistingRDD" not in plan._jdf.queryExecution().executedPlan().toString()
