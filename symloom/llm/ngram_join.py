"""Exact Jaccard self join of word n-gram sets, with set relations to skip work.

Texts with equal sets are one class, and only classes are compared. A class is indexed by the
first tokens of its set in a global order (prefix filter): first by hash, to find which tokens
are shared at all, then, of the shared ones, rarest first. Sets that link share a certain number
of their hash-first tokens, so a class with too few shared ones is out.

Index lists are skipped in blocks by position. An entry knows how many of its class's tokens
come from its position on, and so up to which size of a partner it may be the first common
token: from a late position on, the block of larger sets is skipped as a whole, and within a
block the pairs whose positions leave too few common tokens.

Lists may be long (a group of near copies), so not all pairs are formed. In each round a
list's first class, its leader, is compared with the others. Answers of a class are derived
from those that its leader has already computed: where two classes share an earlier leader,
their overlaps with it bound theirs from below (a link without another look) and from above
(no link); only what lies between is computed from the sets. Members of one component need not
be compared again. A leader has met all its list and leaves it. Lists that still hold several
components after some rounds are joined in full. No link between different sets is lost.

Tokens are counted by partial sums that are joined back, and a list's leader is found in the
same way, so that a token in very many documents isn't gathered in one task.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark import TaskContext
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from .shared import Scratch

#: Rounds in which lists have leaders, before what is left is joined in full.
ROUNDS = 3
FACTORS = [0x9E3779B97F4A7C15, 0xC2B2AE3D27D4EB4F, 0x165667B19E3779F9, 0xD6E8FEB86659FD93, 0xA0761D6478BD642F]


def shingle_set(text: str | None, words: int) -> np.ndarray:
    """Sorted distinct 64-bit hashes of a text's word n-grams: A-Z in lower case, words
    between ASCII white space; a shorter text is one n-gram; without words: empty."""
    import xxhash

    tokens = (text or "").encode().lower().split()
    if not tokens:
        return np.zeros(0, np.int64)
    h = np.array(list(map(xxhash.xxh3_64_intdigest, tokens)), np.uint64)
    n = max(1, len(h) - words + 1)
    with np.errstate(over="ignore"):
        out = np.full(n, len(h) if len(h) < words else words, np.uint64)
        for k in range(min(words, len(h))):
            out = (out ^ h[k : k + n]) * np.uint64(FACTORS[k % len(FACTORS)] + 2 * (k // len(FACTORS)))
            out ^= out >> np.uint64(29)
    return np.unique(out.view(np.int64))


def shared_at_least(n: int, percent: int) -> int:
    """Hash-first tokens that two linked sets have in common, if the smaller has n tokens."""
    return min(-(-percent * n // 100), 1 + n // 10)


def prefix_lengths(n: int, percent: int) -> tuple[int, int]:
    """(tokens of the hash-first prefix, tokens of it that a partner shares at least)."""
    missing = (100 - percent) * n // 100
    return min(n, missing + 1 + n // 10), shared_at_least(-(-percent * n // 100), percent)


def shared_column(n: Column, percent: int) -> Column:
    return F.least(F.ceil(percent * n / 100), 1 + F.floor(n / 10))


def rows_of(docs: DataFrame, doc_id: str, text: str, words: int, percent: int) -> DataFrame:
    """A row per document: uid (of the row), doc_id, h1 and h2 (of the row's content), n, sig
    (of the set), prefix, last (the largest hash up to which the prefix is the set)."""
    rows = docs.select(F.col(f"`{doc_id}`").cast("long").alias("doc_id"), F.col(f"`{text}`").cast("string").alias("text"))
    rows = rows.withColumns({"h1": F.xxhash64("doc_id", "text"), "h2": F.hash("text", "doc_id")})

    def sets(parts: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        import xxhash

        uid = TaskContext.get().partitionId() << 40
        for part in parts:
            n, sig, prefixes, last = [], [], [], []
            for t in part.column("text"):
                s = shingle_set(t.as_py(), words)
                k = prefix_lengths(len(s), percent)[0]
                n.append(len(s))
                sig.append(xxhash.xxh3_128_digest(s.tobytes()) if len(s) else None)
                prefixes.append(s[:k])
                last.append(int(s[k - 1]) if k < len(s) else 2**63 - 1)
            offsets = np.cumsum([0, *map(len, prefixes)])
            flat = np.concatenate(prefixes) if prefixes else np.zeros(0, np.int64)
            ids = np.arange(uid, uid + len(n))
            uid += len(n)
            yield pa.RecordBatch.from_arrays([pa.array(ids, pa.int64()), part.column("doc_id"), part.column("h1"), part.column("h2"), pa.array(n, pa.int64()), pa.array(sig, pa.binary()), pa.ListArray.from_arrays(pa.array(offsets, pa.int32()), pa.array(flat)), pa.array(last, pa.int64())], names=["uid", "doc_id", "h1", "h2", "n", "sig", "prefix", "last"])

    return rows.mapInArrow(sets, "uid long, doc_id long, h1 long, h2 int, n long, sig binary, prefix array<long>, last long")


def at_any_size(df: DataFrame) -> DataFrame:
    """For joins with what grows with the corpus: a merge join on small tables too, so that they
    are worked on as large ones are, and nothing is broadcast by its size."""
    return df.hint("merge")


def full_sets(docs: DataFrame, wanted: DataFrame, doc_id: str, text: str, words: int, scratch: Scratch) -> DataFrame:
    """(uid, set) of wanted rows (uid, h1, h2)."""
    rows = docs.select(F.xxhash64(F.col(f"`{doc_id}`").cast("long"), F.col(f"`{text}`").cast("string")).alias("h1"), F.hash(F.col(f"`{text}`").cast("string"), F.col(f"`{doc_id}`").cast("long")).alias("h2"), F.col(f"`{text}`").cast("string").alias("text"))
    # A row that repeats is dropped where the join has put it.
    found = rows.join(at_any_size(wanted), ["h1", "h2"]).dropDuplicates(["h1", "h2"]).select("uid", "text")

    def sets(parts: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for part in parts:
            for lo in range(0, part.num_rows, 200):
                some = part.slice(lo, 200)
                found = [shingle_set(t.as_py(), words) for t in some.column("text")]
                yield pa.RecordBatch.from_arrays([some.column("uid"), pa.ListArray.from_arrays(pa.array(np.cumsum([0, *map(len, found)]), pa.int32()), pa.array(np.concatenate(found)))], names=["uid", "set"])

    return scratch.save(found.mapInArrow(sets, "uid long, set array<long>"), "sets")


def index_rows(classes: DataFrame, sizes: DataFrame, percent: int, scratch: Scratch) -> DataFrame:
    """(tok, block, uid, n, alone, last, place, ahead): the leading shared tokens of each class
    that can have a partner. classes (saved; deleted here) have uid and prefix, sizes (uid, n, k,
    last) the prefixes' lengths and ends. No other prefix holds `alone` of a class's tokens;
    `ahead` shared tokens come from this one on."""
    least = shared_column(F.ceil(percent * F.col("n") / 100), percent)
    tokens, shared, n_able = classes.select("uid", F.explode("prefix").alias("tok")), classes, None
    while True:
        # Without a class that is out, its tokens may be no longer shared, and so on.
        df = tokens.groupBy("tok").agg(F.count("*").alias("df")).filter("df > 1")
        known, shared = shared, scratch.save(tokens.join(df.hint("shuffle_hash"), "tok").select("uid", "tok", F.col("df").cast("int")), "shared")
        able = scratch.save(shared.groupBy("uid").agg(F.count("*").alias("s"), F.sum(F.log2("df")).alias("w")).join(sizes, "uid").filter(F.col("s") >= least), "able")
        scratch.drop(known)
        before, n_able = n_able, able.count()
        if n_able == 0 or (before is not None and n_able > 0.9 * before):
            break
        tokens = shared.drop("df").join(at_any_size(able.select("uid")), "uid", "left_semi")
    # The place in a list: first comes whose tokens are shared most, the centre of its copies.
    able = able.select("uid", "n", "s", (F.col("k") - F.col("s")).alias("alone"), "last", (F.col("s") - least + 1).alias("lead"), (-F.col("w") / F.col("k")).alias("place"))
    order = Window.partitionBy("uid").orderBy("df", "tok")
    leading = shared.join(at_any_size(able), "uid").withColumn("rank", F.row_number().over(order)).filter("rank <= lead")
    leading = leading.withColumn("ahead", (F.col("s") - F.col("rank") + 1).cast("int"))
    # Sizes in a ratio of `percent` or more lie in one block or in neighbouring ones. Two sets
    # of the higher block, or of one and the other, meet in the higher; a position that leaves
    # too few tokens for a partner as large as the set itself skips it.
    block = F.floor(F.log(F.col("n").cast("double")) / F.log(F.lit(100.0 / percent)) - F.lit(1e-9)).cast("int")
    blocks = F.when(F.col("ahead") >= shared_column(F.col("n"), percent), F.array(block, block + 1)).otherwise(F.array(block))
    index = scratch.save(leading.select("tok", F.explode(blocks).alias("block"), "uid", "n", "alone", "last", "place", "ahead"), "index")
    scratch.drop(shared)
    return index


def merged(labels: DataFrame, links: DataFrame, scratch: Scratch) -> DataFrame:
    """labels (uid, c) after the components that links (a, b) connect have become one, named
    by its smallest uid. Every step hooks components to their smallest neighbours and then
    follows hooks once more; the number of steps follows the logarithm of the paths' length."""
    a, b = labels.select(F.col("uid").alias("a"), F.col("c").alias("ca")), labels.select(F.col("uid").alias("b"), F.col("c").alias("cb"))
    edges = scratch.save(links.join(a, "a").join(b, "b").filter("ca <> cb").select("ca", "cb").distinct(), "edges")
    while not edges.isEmpty():
        both = edges.union(edges.select("cb", "ca"))
        hook = both.groupBy("ca").agg(F.min("cb").alias("to")).filter("`to` < ca")
        further = hook.select(F.col("ca").alias("to"), F.col("to").alias("to2"))
        hook = scratch.save(hook.join(further, "to", "left").select(F.col("ca").alias("c"), F.coalesce("to2", "to").alias("to")), "hooks")
        old, labels = labels, scratch.save(labels.join(hook, "c", "left").select("uid", F.coalesce("to", "c").alias("c")), "labels")
        x, y = hook.select(F.col("c").alias("ca"), F.col("to").alias("ta")), hook.select(F.col("c").alias("cb"), F.col("to").alias("tb"))
        moved = edges.join(x, "ca", "left").join(y, "cb", "left").select(F.coalesce("ta", "ca").alias("ca"), F.coalesce("tb", "cb").alias("cb"))
        done, edges = edges, scratch.save(moved.filter("ca <> cb").distinct(), "edges")
        scratch.drop(done, old, hook)
    scratch.drop(edges)
    return labels


def overlaps(pairs: DataFrame, sets: DataFrame, percent: int) -> DataFrame:
    """pairs (a, b) with the size of the intersection, and whether the sets link: 100 *
    intersection >= percent * union."""
    a, b = sets.select(F.col("uid").alias("a"), F.col("set").alias("sa")), sets.select(F.col("uid").alias("b"), F.col("set").alias("sb"))
    both = at_any_size(at_any_size(pairs).join(b, "b")).join(a, "a").withColumn("both", F.size(F.array_intersect("sa", "sb")))
    return both.select("a", "b", "both", (100 * F.col("both") >= percent * (F.size("sa") + F.size("sb") - F.col("both"))).alias("link"))


def may_link(n: Column, a: Column, m: Column, b: Column, percent: int) -> Column:
    """Whether sets of n and m tokens may link if a and b of them are not in the other: those
    are in no intersection and in every union."""
    return 100 * F.least(n - a, m - b) >= percent * F.greatest(n + b, m + a)


def may_link_leader(percent: int) -> Column:
    """Whether a list's first may link with a member, as far as counts and positions tell. A
    token that no other prefix holds may lie in the partner beyond the partner's prefix, if that
    ends at a smaller hash; so only what is alone in the prefix that ends first counts. If the
    list's token is the first that two sets share, all they share come from its positions on."""
    first, own = ([F.col(i + x) for x in ("n", "alone", "last", "ahead")] for i in ("first.", ""))
    (n, a, x, p), (m, b, y, q) = first, own
    enough = F.least(p, q) >= shared_column(F.least(n, m), percent)
    return enough & may_link(n, F.when(x <= y, a).otherwise(0), m, F.when(y <= x, b).otherwise(0), percent)


def derived(percent: int) -> tuple[Column, Column]:
    """(surely a link, surely none) of a list's first and a member, from their overlaps with the
    leader before: both hold what exceeds its size, and share no more than the smaller overlap
    and what either has beyond it. Null where one of the overlaps isn't known."""
    n, o, m, q, size = F.col("first.n"), F.col("first.known"), F.col("n"), F.col("known"), F.col("lead_n")
    low, high = o + q - size, F.least(o, q) + F.least(n - o, m - q)
    return (100 + percent) * low >= percent * (n + m), (100 + percent) * high < percent * (n + m)


def rest_pairs(left: DataFrame, sets: DataFrame, percent: int, scratch: Scratch) -> DataFrame:
    """Pairs (a, b) of the classes left (uid, c) that may link, of different components.

    Tokens that no other class left has are counted (alone). They are in no intersection and
    in every union, which bounds a pair's similarity; the rarest of the others are the index."""
    missing = F.floor((100 - percent) * F.col("n") / 100)
    rows = at_any_size(left).join(sets, "uid").select("uid", "c", F.size("set").cast("long").alias("n"), F.explode("set").alias("tok"))
    n_left, held = None, None
    while True:
        # A class that loses its partners' tokens may lose its last possible partner, and so on.
        df = rows.groupBy("tok").agg(F.count("*").cast("int").alias("df"))
        known, held = held, scratch.save(rows.join(df.hint("shuffle_hash"), "tok"), "rest")
        rows = held
        alone = scratch.save(rows.groupBy("uid").agg(F.count_if(F.col("df") == 1).alias("alone"), F.first("n").alias("n")).filter(F.col("alone") <= missing).select("uid", "alone"), "alone")
        scratch.drop(known)
        before, n_left = n_left, alone.count()
        if n_left == 0 or (before is not None and n_left > 0.9 * before):
            break
        rows = rows.drop("df").join(at_any_size(alone.select("uid")), "uid", "left_semi")
    order = Window.partitionBy("uid").orderBy("df", "tok")
    index = rows.filter("df > 1").join(at_any_size(alone), "uid").withColumn("rank", F.row_number().over(order)).filter(F.col("rank") <= missing + 1 - F.col("alone"))
    index = scratch.save(index.select("tok", "uid", "c", "n", "alone", "rank"), "rest-index")
    scratch.drop(held)
    x, y = (index.select("tok", *[F.col(k).alias(k + i) for k in ("uid", "c", "n", "alone", "rank")]) for i in "xy")
    # From this list's token on, no more tokens can be common than either set has left.
    ahead = F.least(F.col("nx") - F.col("alonex") - F.col("rankx"), F.col("ny") - F.col("aloney") - F.col("ranky")) + 1
    # A common token lies among the first of the smaller set that a set as large must share.
    short = lambda i: (100 + percent) * (F.col("rank" + i) + F.col("alone" + i) - 1) <= (100 - percent) * F.col("n" + i)
    early = ((F.col("nx") <= F.col("ny")) & short("x")) | ((F.col("ny") <= F.col("nx")) & short("y"))
    fit = early & may_link(F.col("nx"), F.col("alonex"), F.col("ny"), F.col("aloney"), percent) & ((100 + percent) * ahead >= percent * (F.col("nx") + F.col("ny")))
    return x.join(y, "tok").filter((F.col("uidx") < F.col("uidy")) & (F.col("cx") != F.col("cy")) & fit).select(F.col("uidx").alias("a"), F.col("uidy").alias("b")).distinct()


def components(docs: DataFrame, doc_id: str = "doc_id", text: str = "text", words: int = 5, percent: int = 80, rounds: int = ROUNDS) -> DataFrame:
    """One row per row of docs: doc_id, n_shingles (size of its set) and component_id, the
    smallest doc_id that links reach, its own included.

    Sets that are equal, or whose intersection is `percent` of the union or more, are linked.
    A null text and one without words have an empty set and no links. Null doc_ids don't
    count for the smallest; a component without others has component_id null. Repeated rows
    stay, in one component. Other columns are ignored; an empty table gives no rows."""
    scratch = Scratch(docs.sparkSession, "ngrams")
    every = scratch.save(rows_of(docs, doc_id, text, words, percent), "rows")
    rows = scratch.save(every.drop("prefix", "last"), "rows")
    # Equal sets have equal prefixes. Partial aggregates put the copies of a task together.
    classes = every.filter("n > 0").groupBy("sig").agg(F.min("uid").alias("uid"), F.min("doc_id").alias("least"), *[F.first(c).alias(c) for c in ("n", "last", "prefix")])
    classes = scratch.save(classes, "classes")
    scratch.drop(every)
    reps = scratch.save(classes.select("sig", "uid", "least", "n", F.size("prefix").alias("k"), "last"), "classes")
    index = index_rows(classes, reps.select("uid", "n", "k", "last"), percent, scratch)
    able = index.select("uid").distinct()
    sets = full_sets(docs, rows.select("uid", "h1", "h2").join(able, "uid", "left_semi"), doc_id, text, words, scratch)
    labels = scratch.save(able.withColumn("c", F.col("uid")), "labels")
    lists = ["tok", "block"]
    nothing = F.lit(None).cast("long")
    held, answers, found = index, None, None
    index = index.withColumns({"lead": nothing, "lead_n": nothing})
    for _ in range(rounds):
        # What each list's leader before had in common with its members.
        known = index.withColumn("known", F.lit(None).cast("int")) if answers is None else index.join(answers, "uid", "left").withColumn("known", F.element_at("overlap", F.col("lead"))).drop("overlap")
        open_ = known.join(at_any_size(labels), "uid")
        first = F.min(F.struct("place", "uid", "n", "alone", "last", "ahead", "known", "c")).alias("first")
        firsts = open_.groupBy(*lists).agg(F.min("c").alias("lo"), F.max("c").alias("hi"), first).filter("lo <> hi").drop("lo", "hi")
        sure, none = derived(percent)
        asked = (F.col("first.c") != F.col("c")) & may_link_leader(percent) & ~F.coalesce(none, F.lit(False))
        led = open_.join(firsts.hint("shuffle_hash"), lists).withColumns({"asked": asked, "sure": F.coalesce(sure, F.lit(False)), "by": F.col("first.uid"), "by_n": F.col("first.n")})
        led = scratch.save(led.select("tok", "block", "uid", "n", "alone", "last", "place", "ahead", "asked", "sure", F.col("by").alias("lead"), F.col("by_n").alias("lead_n")), "led")
        scratch.drop(held, found)
        held = led
        if led.isEmpty():
            index = None
            break
        pairs = led.filter("asked").groupBy(F.col("lead").alias("a"), F.col("uid").alias("b")).agg(F.max("sure").alias("sure"))
        pairs = scratch.save(pairs, "pairs")
        found = scratch.save(overlaps(pairs.filter("not sure").select("a", "b"), sets, percent), "links")
        labels = merged(labels, found.filter("link").select("a", "b").union(pairs.filter("sure").select("a", "b")), scratch)
        # Leaders that a class was compared with are no more than its own entries.
        answers = found.groupBy(F.col("b").alias("uid")).agg(F.map_from_entries(F.collect_list(F.struct("a", "both"))).alias("overlap"))
        scratch.drop(pairs)
        index = led.filter("lead <> uid").drop("asked", "sure")
    if index is not None:
        ends = index.join(labels, "uid").groupBy(*lists).agg(F.min("c").alias("lo"), F.max("c").alias("hi")).filter("lo <> hi").select(*lists)
        left = scratch.save(index.join(ends, lists, "left_semi").select("uid").distinct().join(labels, "uid"), "left")
        pairs = scratch.save(rest_pairs(left, sets, percent, scratch), "rest-pairs")
        labels = merged(labels, overlaps(pairs, sets, percent).filter("link").select("a", "b"), scratch)
    scratch.drop(sets)
    named = reps.join(labels, "uid", "left").withColumn("c", F.coalesce("c", "uid"))
    least = named.groupBy("c").agg(F.min("least").alias("component_id"))
    of_sig = named.join(least, "c").select("sig", "component_id", F.lit(True).alias("known"))
    out = rows.select("doc_id", "n", "sig").join(of_sig, "sig", "left")
    return out.select("doc_id", F.col("n").alias("n_shingles"), F.when(F.col("known"), F.col("component_id")).otherwise(F.col("doc_id")).alias("component_id"))
