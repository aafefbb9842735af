import random
from collections import Counter, defaultdict

import pytest

from symloom.llm.ngram_join import components, prefix_lengths, shingle_set

from .helpers import ODD, docs_table


def brute(rows, percent=80):
    sets = []
    for _, t in rows:
        w = (t or "").encode().lower().split()
        sets.append({tuple(w[k : k + 5]) for k in range(max(1, len(w) - 4))} if w else set())
    up = list(range(len(rows)))

    def find(x):
        while up[x] != x:
            x = up[x]
        return x

    at = defaultdict(list)
    for i, s in enumerate(sets):
        for j, n in Counter(j for g in s for j in at[g]).items():
            if 100 * n >= percent * (len(s) + len(sets[j]) - n):
                a, b = find(i), find(j)
                up[max(a, b)] = min(a, b)
        for g in s:
            at[g].append(i)
    least = defaultdict(list)
    for i, (k, _) in enumerate(rows):
        least[find(i)].append(k)
    name = lambda i: min((k for k in least[find(i)] if k is not None), default=None)
    return sorted(((k, len(sets[i]), name(i)) for i, (k, _) in enumerate(rows)), key=str)


def edited(rng, words, n):
    out = list(words)
    for _ in range(n):
        out[rng.randrange(len(out))] = f"new{rng.randrange(10**6)}"
    return " ".join(out)


@pytest.mark.parametrize("rounds", [0, 3])
def test_components_match_brute_force(spark, rounds):
    rng = random.Random(rounds)
    passage = [f"p{i}" for i in range(60)]
    texts = []
    for g in range(6):
        base = [f"g{g}w{rng.randrange(400)}" for _ in range(rng.randrange(20, 200))]
        texts += [edited(rng, base, rng.randrange(0, 1 + len(base) // 12)) for _ in range(12)] + [" ".join(base).upper()] * 3
    texts += [" ".join([f"u{rng.randrange(10**6)}" for _ in range(30)] + passage) for _ in range(40)]
    rows = [(i, t) for i, t in enumerate(texts)] + [(k, t) for k, t, _ in ODD]
    rng.shuffle(rows)
    docs = docs_table(spark, [(k, t, "s") for k, t in rows])
    got = sorted(((r["doc_id"], r["n_shingles"], r["component_id"]) for r in components(docs, rounds=rounds).collect()), key=str)
    assert got == brute(rows)


@pytest.mark.parametrize("rounds", [1, 3])
def test_pairs_of_unequal_sizes(spark, rounds):
    """A text and itself with up to a fifth of its words cut off or put in, at either end or inside."""
    rng, rows = random.Random(5), []
    for n in [*range(5, 41), *range(45, 501, 35)]:
        for change in sorted({1, max(1, n // 12), n // 5}):
            for where in ("cut", "in", "head", "off"):
                base = [f"{len(rows)}w{k}" for k in range(n)]
                at = {"cut": n, "off": 0, "head": 0}.get(where, rng.randrange(n))
                more = [f"{len(rows)}x{k}" for k in range(change)]
                other = base[: n - change] if where == "cut" else base[change:] if where == "off" else base[:at] + more + base[at:]
                rows += [(len(rows), " ".join(base)), (len(rows) + 1, " ".join(other))]
    got = sorted(((r["doc_id"], r["n_shingles"], r["component_id"]) for r in components(docs_table(spark, [(k, t, "s") for k, t in rows]), rounds=rounds).collect()), key=str)
    assert got == brute(rows)


def test_empty_table(spark):
    assert components(docs_table(spark, ODD).limit(0)).count() == 0


def test_small_sets():
    assert len(shingle_set(None, 5)) == len(shingle_set(" \n", 5)) == 0
    assert len(shingle_set("a b", 5)) == 1 and shingle_set("A b", 5).tolist() == shingle_set("a\tB", 5).tolist()
    assert prefix_lengths(1, 80) == (1, 1)
    assert all(1 <= prefix_lengths(n, 80)[1] <= prefix_lengths(n, 80)[0] <= n for n in range(1, 500))
