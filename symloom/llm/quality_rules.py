"""Quality rules: a base rule, and decision lists learned by sequential covering.

Everything is DataFrame expressions. A rule is a conjunction of thresholds on measures of a
text. Rules are grown one condition at a time by information gain on two thirds of the
labelled rows, pruned on the other third, kept if precise there, and the rows they cover are
set aside before the next one is grown. The statistics of a step come from one aggregation
(feature, bin, label counts); the result is an ordered CASE expression.
"""

from __future__ import annotations

from dataclasses import dataclass, field
from math import log2

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from .shared import SPACES, WORD, free_name, saved

#: Characters that count as symbols.
SYMBOLS = r"[#*$%&|<>]"
#: The measures that rules may test.
FEATURES = ("n_words", "mean_word", "symbol_share", "dup_line_share", "repeat_share", "upper_share", "mark_share", "distinct_share", "line_words")
#: Labelled rows that rules are learned from, about, at most (taken by a hash of the id).
LEARN_ROWS = 20_000


def measured(docs: DataFrame, text: str = "text", to: str = "measures") -> DataFrame:
    """docs with the struct `to`: word_chars, n_words, n_symbols, n_dup_lines, n_repeat_words
    (long) and the doubles of FEATURES.

    Null and empty texts measure 0 everywhere. Other columns stay; one named `to` is
    replaced. All of a text is used, and all work is within its row: no shuffle."""
    kept = F.struct(*[F.col(f"`{c}`") for c in docs.columns if c.lower() != to.lower()])
    t = F.coalesce(F.col(f"`{text}`").cast("string"), F.lit(""))
    a = docs.select(kept.alias("row"), t.alias("t"), F.regexp_extract_all(t, F.lit(WORD), F.lit(0)).alias("words"), F.filter(F.split(t, "\n"), lambda x: x.rlike(WORD)).alias("lines"))
    grams = F.transform(F.slice("words", 1, F.greatest(F.size("words") - 2, F.lit(0))), lambda w, i: F.xxhash64(w, F.get("words", i + 1), F.get("words", i + 2)))
    b = a.select("row", F.size("words").alias("n_words"), F.length(F.array_join("words", "")).alias("chars"), F.size("lines").alias("n_lines"), (F.size("lines") - F.size(F.array_distinct("lines"))).alias("dup"), F.size(F.array_distinct("words")).alias("distinct"), grams.alias("grams"),
                 F.regexp_count("t", F.lit(SYMBOLS)).alias("symbols"), (F.length("t") - F.length(F.regexp_replace("t", r"\p{Lu}+", ""))).alias("upper"), (F.length("t") - F.length(F.regexp_replace("t", r"[\p{P}]+", ""))).alias("marks"))
    c = b.withColumn("placed", F.when(F.size(F.array_distinct("grams")) < F.size("grams"), F.sort_array(F.transform("grams", lambda g, i: F.struct(g.alias("g"), i.alias("i"))))))
    same = lambda x, i: F.coalesce(F.get("placed", i)["g"] == x["g"], F.lit(False))
    twice = F.filter("placed", lambda x, i: same(x, i - 1) | same(x, i + 1))
    at = F.sort_array(F.transform(twice, lambda x: x["i"]))
    covered = F.aggregate(at, F.struct(F.lit(0).alias("end"), F.lit(0).alias("n")), lambda acc, x: F.struct((x + 3).alias("end"), (acc["n"] + x + 3 - F.greatest(acc["end"], x)).alias("n")), lambda acc: acc["n"])
    d = c.withColumn("repeat", F.coalesce(covered, F.lit(0)))
    share = lambda x, of: F.coalesce(F.col(x) / F.nullif(F.col(of), F.lit(0)), F.lit(0.0))
    whole = {"word_chars": "chars", "n_symbols": "symbols", "n_dup_lines": "dup", "n_repeat_words": "repeat", "n_words": "n_words"}
    shares = {"mean_word": ("chars", "n_words"), "symbol_share": ("symbols", "chars"), "dup_line_share": ("dup", "n_lines"), "repeat_share": ("repeat", "n_words"), "upper_share": ("upper", "chars"), "mark_share": ("marks", "chars"), "distinct_share": ("distinct", "n_words"), "line_words": ("n_words", "n_lines")}
    found = F.struct(*[F.col(v).cast("long").alias(k) for k, v in whole.items()], *[share(*v).alias(k) for k, v in shares.items()])
    # explode() of one element: else a filter on a measure would be moved below all of this,
    # with every step above it written out again wherever it is used.
    return d.select("row", F.explode(F.array(found)).alias("m")).select("row.*", F.col("m").alias(to))


def base_failed(m: Column) -> Column:
    """Under 50 words, or over half of them in repeated windows of three."""
    return (m["n_words"] < 50) | (100 * m["n_repeat_words"] > 50 * m["n_words"])


@dataclass(frozen=True)
class Condition:
    feature: str
    above: bool
    threshold: float

    def on(self, m: Column) -> Column:
        return m[self.feature] > self.threshold if self.above else m[self.feature] <= self.threshold


@dataclass
class DecisionList:
    """Rules in order; a text that one of them covers is rejected, others are kept."""

    rules: list[list[Condition]] = field(default_factory=list)

    def covered(self, m: Column) -> list[Column]:
        out = []
        for rule in self.rules:
            test = rule[0].on(m)
            for c in rule[1:]:
                test = test & c.on(m)
            out.append(test)
        return out

    def kept(self, m: Column) -> Column:
        """CASE WHEN rule 1 THEN false ... ELSE true, behind the base rule."""
        verdict = F.when(base_failed(m), False)
        for test in self.covered(m):
            verdict = verdict.when(test, False)
        return verdict.otherwise(True)

    def rule(self, m: Column) -> Column:
        """Which decided: 0 the base rule, k the k-th rule, null none."""
        out = F.when(base_failed(m), 0)
        for k, test in enumerate(self.covered(m), 1):
            out = out.when(test, k)
        return out


def labelled(docs: DataFrame, labels: DataFrame, text: str, key: str, label: str, rows: int = LEARN_ROWS) -> DataFrame:
    """`measures` and bad (label 0) of labelled documents that pass the base rule; about
    `rows` of them at most. Labels and keys that are null take no part."""
    labels = labels.select(F.col(key).alias("label_key"), F.col(label).alias("label")).dropna()
    n = labels.count()
    if n > rows:
        labels = labels.filter(F.pmod(F.xxhash64(F.lit(11), "label_key"), F.lit(1_000_000)) < int(1_000_000 * rows / n))
    picked = F.broadcast(labels)  # at most about `rows` rows of two numbers
    own = docs.select(F.col(f"`{key}`").alias("own_key"), F.col(f"`{text}`").alias("own_text"))
    found = own.join(picked, F.col("own_key") == F.col("label_key")).select(F.col("own_key").alias("id"), (F.col("label") == 0).alias("bad"), "own_text")
    return measured(found, "own_text").filter(~base_failed(F.col("measures"))).select("id", "bad", "measures")


def learn(examples: DataFrame, bins: int = 24, most_rules: int = 8, most_conditions: int = 3, precision: float = 0.95, support: int = 5) -> DecisionList:
    """A decision list from examples (id, bad, measures). Without bad examples: no rules."""
    examples = saved(examples, "rule-examples")
    m = F.col("measures")
    cuts = examples.select(*[m[f].cast("double").alias(f) for f in FEATURES]).approxQuantile(list(FEATURES), [i / bins for i in range(1, bins)], 0.002)
    cuts = [sorted(set(x)) for x in cuts]
    if not any(cuts):
        return DecisionList()
    binned = [sum(((m[f] > F.lit(float(t))).cast("int") for t in x), F.lit(0)) for f, x in zip(FEATURES, cuts, strict=True)]
    left = saved(examples.select("bad", (F.pmod(F.xxhash64(F.lit(5), "id"), F.lit(3)) < 2).alias("grow"), "measures", F.array(*binned).alias("bins")), "rule-bins").cache()
    found = DecisionList()
    try:
        while len(found.rules) < most_rules:
            rule = grown(left, cuts, most_conditions)
            rule = rule and pruned(left, rule, precision, support)
            if not rule:
                break
            found.rules.append(rule)
            left = left.filter(~DecisionList([rule]).covered(m)[0])
    finally:
        left.unpersist()
    return found


def grown(left: DataFrame, cuts: list[list[float]], most: int) -> list[Condition]:
    """Adds the condition of most gain until no good example is covered or none gains."""
    rule: list[Condition] = []
    m = F.col("measures")
    rows = left.filter("grow")
    while len(rule) < most:
        stats = rows.select("bad", F.posexplode("bins").alias("f", "bin")).groupBy("f", "bin").agg(F.count_if("bad").alias("p"), F.count_if(~F.col("bad")).alias("n")).collect()  # features x bins rows
        counts = {(r["f"], r["bin"]): (r["p"], r["n"]) for r in stats}
        p0, n0 = (sum(v[i] for (f, _), v in counts.items() if f == 0) for i in (0, 1))
        if not p0 or not n0:
            break
        best = (1e-9, None)
        for f, cut in enumerate(cuts):
            p = n = 0
            for b, t in enumerate(cut):
                x = counts.get((f, b), (0, 0))
                p, n = p + x[0], n + x[1]
                for above, (p1, n1) in ((False, (p, n)), (True, (p0 - p, n0 - n))):
                    if p1 and (p1, n1) != (p0, n0):
                        gain = p1 * (log2(p1 / (p1 + n1)) - log2(p0 / (p0 + n0)))
                        if gain > best[0]:
                            best = (gain, Condition(FEATURES[f], above, float(t)))
        if best[1] is None:
            break
        rule.append(best[1])
        rows = rows.filter(best[1].on(m))
    return rule


def pruned(left: DataFrame, rule: list[Condition], precision: float, support: int) -> list[Condition] | None:
    """The prefix of the rule with the best (p - n) / (p + n) on the rows kept for pruning, if
    it is precise and supported; the shortest of equals."""
    prefixes = [DecisionList([rule[: k + 1]]).covered(F.col("measures"))[0] for k in range(len(rule))]
    counts = left.filter(~F.col("grow")).agg(*[F.count_if(t & (F.col("bad") == want)).alias(f"c{k}_{int(want)}") for k, t in enumerate(prefixes) for want in (True, False)]).first()
    scored = [((p - n) / (p + n), -k, p, n) for k in range(len(rule)) if (p := counts[f"c{k}_1"]) + (n := counts[f"c{k}_0"])]
    if not scored:
        return None
    _, k, p, n = max(scored)
    return rule[: 1 - k] if p >= support and p >= precision * (p + n) else None


def apply_rules(docs: DataFrame, rules: DecisionList, text: str = "text") -> DataFrame:
    """docs with `measures`, `base_failed` and `kept`. Columns of those names are replaced."""
    m = free_name(docs, "measures")
    out = measured(docs, text, m)
    names = [c for c in docs.columns if c.lower() not in ("measures", "base_failed", "kept")]
    return out.select(*[F.col(f"`{c}`") for c in names], F.col(m).alias("measures"), base_failed(F.col(m)).alias("base_failed"), rules.kept(F.col(m)).alias("kept"))
