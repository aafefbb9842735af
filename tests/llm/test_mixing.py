import random
from collections import defaultdict

from pyspark.sql import functions as F

from symloom.llm.mixing import PACKET, mix, n_words, served_order

from .helpers import ODD, docs_table


def goals(sizes):
    """Targets by sharing again and again what is above a cap."""
    order = sorted(sizes, key=lambda s: (s is None, (s or "").encode()))
    weight = {s: (5, 2, 1)[i % 3] for i, s in enumerate(order)}
    goal, left, open_ = dict.fromkeys(order, 0.0), 1.5 * sum(sizes.values()), set(order)
    while left > 1e-9 and open_:
        total = sum(weight[s] for s in open_)
        share = {s: left * weight[s] / total for s in open_}
        left = 0.0
        for s in list(open_):
            goal[s] += share[s]
            if goal[s] >= 2 * sizes[s]:
                left += goal[s] - 2 * sizes[s]
                goal[s] = 2 * sizes[s]
                open_.discard(s)
    return goal


def prefix(rows, goal):
    """Words of each row in the order of finish times of all packets, up to the budget."""
    packets, at = [], defaultdict(int)
    for k in range(2):
        for i in sorted(range(len(rows)), key=lambda i: (rows[i]["finish"] or 0)):
            r = rows[i]
            for lo in range(0, r["size"], PACKET):
                n = min(PACKET, r["size"] - lo)
                at[r["source"]] += n
                packets.append((at[r["source"]] / r["target"], i, n))
    times, left, out = defaultdict(list), 1.5 * sum(r["size"] for r in rows), [0] * len(rows)
    for f, i, n in packets:
        times[f].append((i, n))
    for f in sorted(times):
        left -= sum(n for _, n in times[f])
        if left < 0:
            break
        for i, n in times[f]:
            out[i] += n
    return out


def check(rows):
    sizes, taken = defaultdict(int), defaultdict(int)
    for r in rows:
        sizes[r["source"]] += r["size"]
        taken[r["source"]] += r["taken"]
        assert 0 <= r["taken"] <= 2 * r["size"] and r["copies"] <= 2
    goal = goals(sizes)
    for r in rows:
        assert abs(r["target"] - goal[r["source"]]) < 1e-6 * max(1, goal[r["source"]]) and r["source_size"] == sizes[r["source"]]
    # A source ends within a packet of its target, and the rest of the budget goes on.
    assert all(abs(taken[s] - goal[s]) <= PACKET + 1 for s in sizes) and sum(taken.values()) <= 1.5 * sum(sizes.values())
    assert [r["taken"] for r in rows] == prefix(rows, goal)


def mixed(docs):
    return mix(docs.withColumn("size", n_words(F.col("text")))).select(F.col("row.doc_id").alias("doc_id"), F.col("row.source").alias("source"), "size", "source_size", "target", "taken", "copies", "finish")


def test_targets_and_taken_words(spark):
    rng = random.Random(3)
    rows = [(i, "w " * rng.randrange(0, 300), rng.choice(["hot", "hot", "b", "ä", "Z", None])) for i in range(400)]
    out = mixed(docs_table(spark, rows))
    first = sorted(out.collect(), key=str)
    check(first)
    assert first == sorted(mixed(docs_table(spark, rows[::-1]).repartition(7)).collect(), key=str)


def test_odd_tables(spark):
    docs = docs_table(spark, ODD)
    rows = mixed(docs).collect()
    check(rows)
    assert len(rows) == len(ODD)
    assert mixed(docs.limit(0)).count() == 0
    assert {r["taken"] for r in mixed(docs_table(spark, [(1, None, None), (2, "", "a")])).collect()} == {0}


def test_service_order(spark):
    out = served_order(mixed(docs_table(spark, [(i, "w " * (i + 1), "ab"[i % 2]) for i in range(50)]))).collect()
    finish = [r["finish"] for r in out]
    assert finish == sorted(finish)
