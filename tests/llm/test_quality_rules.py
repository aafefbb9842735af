import re

from pyspark.sql import functions as F

from symloom.llm.quality_rules import Condition, DecisionList, apply_rules, labelled, learn, measured

from .helpers import ODD, docs_table

WORD = re.compile(r"[^\x20\x09-\x0D]+")


def brute(text):
    t = text or ""
    words = WORD.findall(t)
    at = {}
    for i in range(len(words) - 2):
        at.setdefault(tuple(words[i : i + 3]), []).append(i)
    covered = {i + k for v in at.values() if len(v) > 1 for i in v for k in range(3)}
    lines = [x for x in t.split("\n") if WORD.search(x)]
    return len(words), sum(map(len, words)), sum(c in "#*$%&|<>" for c in t), len(lines) - len(set(lines)), len(covered)


def test_measures_match_brute_force(spark):
    rows = [*ODD, (8, "a b c a b c a b c", "s"), (9, "x\ny\nx\n\n\nx", "s"), (10, "a a a a a # b", "s"), (11, "p q r s p q r t q r s", "s")]
    docs = docs_table(spark, [(k, t, s) for k, (_, t, s) in enumerate(rows)])
    got = {r["doc_id"]: r["m"] for r in measured(docs, to="m").collect()}
    names = ("n_words", "word_chars", "n_symbols", "n_dup_lines", "n_repeat_words")
    for k, (_, t, _s) in enumerate(rows):
        assert tuple(got[k][n] for n in names) == brute(t)
    assert measured(docs.limit(0)).count() == 0


def test_rules_are_learned_and_applied_in_order(spark):
    good = [(i, " ".join(f"word{(i * 7 + k * k) % 991}" for k in range(80)), "s") for i in range(200)]
    bad = [(i, " ".join(f"word{(i * 7 + k * k) % 991}%%%" for k in range(80)), "s") for i in range(200, 300)]
    docs = docs_table(spark, [*good, *bad, *[(k, t, s) for k, (_, t, s) in enumerate(ODD, 900)]])
    labels = spark.createDataFrame([(i, int(i < 200), 0) for i in range(300)] + [(None, 1, 0), (4, None, 0)], "doc_id long, quality int, toxic int")
    rules = learn(labelled(docs, labels, "text", "doc_id", "quality"))
    assert rules.rules
    out = apply_rules(docs, rules)
    assert out.columns.count("measures") == 1 and "size" in out.columns
    kept = {r["doc_id"] for r in out.filter("kept").collect()}
    assert kept & set(range(300)) == set(range(200))
    assert not any(i in kept for i in range(900, 906))  # too short


def test_without_bad_examples_there_are_no_rules(spark):
    docs = docs_table(spark, [(1, "a " * 60, "s")])
    labels = spark.createDataFrame([], "doc_id long, quality int, toxic int")
    assert learn(labelled(docs, labels, "text", "doc_id", "quality")).rules == []


def test_verdict_is_one_expression_without_python(spark):
    rules = DecisionList([[Condition("symbol_share", True, 0.1)], [Condition("n_words", False, 60.0), Condition("mean_word", True, 9.0)]])
    plan = apply_rules(docs_table(spark, ODD), rules)._jdf.queryExecution().executedPlan().toString()
    assert "Python" not in plan and "Exchange" not in plan
    assert rules.rule(F.col("measures")) is not None
