"""Chat formatting by quotation linking.

A line that starts with quote marks has a level, the number of marks. Consecutive lines of one
level are a passage. A passage is normalised (marks off, white space collapsed, lower case) and
hashed in windows of WINDOW words, so that a quote whose lines were wrapped anew, or of which a
part was quoted, is found; a shorter one is hashed as a whole. What a message quotes at level n
is joined to the latest earlier message of its conversation that has the same words at level
n - 1, so that a quote within a quote leads to the message that quoted it. A message replies to
the one that most of its quoted windows lead to (the later, if two are equal).

A message without quotes replies to the message before it if that has another role, and starts a
thread if the same role goes on; so does the first message of a conversation, and one whose
quotes come from elsewhere. Threads are trees of replies, and their messages are put in order
depth first, replies to one message by turn, without their quotes.

Nothing of a conversation is gathered: neighbours are found within stretches of turns between
which only one value is carried, and places in a thread are counted along the walk around its
tree, of which each step follows a stretch twice as long.
"""

from __future__ import annotations

from functools import reduce

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from .shared import Scratch

#: One class of characters, so that any number of marks is matched in a loop.
MARKS = r"^[ \t>]*>"
#: Words that are hashed together.
WINDOW = 8
#: Turns of a conversation that share a task.
STRETCH = 1024


def passages(text: Column) -> Column:
    """Array of (level, words, lines) of a text's passages that have words: its runs of lines of
    one level, the normalised words of each, and the words of each line."""
    lines = F.split(text, "\r?\n")
    level = F.transform(lines, lambda x: F.regexp_count(F.regexp_extract(x, MARKS, 0), F.lit(">")))
    words = lambda x: F.filter(F.split(F.lower(x), r"\s+"), lambda w: w != "")
    bodies = F.transform(lines, lambda x: words(F.regexp_replace(x, MARKS, "")))
    both = F.struct(level.alias("level"), bodies.alias("bodies"))

    def cut(x: Column) -> Column:
        n = F.size(x["level"])
        starts = F.filter(F.sequence(F.lit(1), n), lambda i: (i == 1) | (F.get(x["level"], i - 1) != F.get(x["level"], i - 2)))
        ends = F.transform(starts, lambda s, k: F.coalesce(F.get(starts, k + 1), n + 1))
        run = lambda s, e: F.slice(x["bodies"], s, e - s)
        found = F.zip_with(starts, ends, lambda s, e: F.struct(F.get(x["level"], s - 1).alias("level"), F.flatten(run(s, e)).alias("words"), run(s, e).alias("lines")))
        return F.filter(found, lambda p: F.size(p["words"]) > 0)

    # An array of one, so that what the cuts use is computed once.
    return F.flatten(F.transform(F.array(both), cut))


def windows(words: Column, starts: Column) -> Column:
    return F.transform(starts, lambda i: F.xxhash64(F.slice(words, i, F.lit(WINDOW))))


def held(p: Column) -> Column:
    """The hashes under which a passage's words can be found: every window of it, itself and its
    lines, if they are short."""
    n = F.size(p["words"])
    short = F.filter(F.concat(F.array(p["words"]), p["lines"]), lambda x: (F.size(x) > 0) & (F.size(x) < WINDOW))
    every = F.when(n >= WINDOW, windows(p["words"], F.sequence(F.lit(1), F.greatest(n - WINDOW + 1, F.lit(1))))).otherwise(F.array().cast("array<bigint>"))
    return F.array_distinct(F.concat(F.transform(short, lambda x: F.xxhash64(x)), every))


def asked(p: Column) -> Column:
    """The hashes by which a quoted passage is looked for: windows that cover it, or itself."""
    n = F.size(p["words"])
    cover = F.array_union(F.sequence(F.lit(1), F.greatest(n - WINDOW + 1, F.lit(1)), F.lit(WINDOW)), F.array(F.greatest(n - WINDOW + 1, F.lit(1))))
    return F.when(n >= WINDOW, windows(p["words"], cover)).otherwise(F.array(F.xxhash64(p["words"])))


def latest_before(rows: DataFrame, keys: list[str], order: str, value: str, to: str) -> DataFrame:
    """rows with `to`, the greatest value among those of the same keys and a lower order (a long);
    null without any. Keys and order aren't null. Rows of a key are cut into stretches of order,
    and of a stretch only its greatest value is carried on."""
    part = rows.withColumn("stretch", F.floor(F.col(order) / STRETCH))
    tops = part.groupBy(*keys, "stretch").agg(F.max(value).alias("top"))
    carried = F.max("top").over(Window.partitionBy(*keys).orderBy("stretch").rowsBetween(Window.unboundedPreceding, -1))
    own = F.max(value).over(Window.partitionBy(*keys, "stretch").orderBy(order).rangeBetween(Window.unboundedPreceding, -1))
    both = part.withColumn("own", own).join(tops.select(*keys, "stretch", carried.alias("carried")), [*keys, "stretch"])
    return both.withColumn(to, F.greatest("own", "carried")).drop("stretch", "own", "carried")


def quotes(messages: DataFrame) -> DataFrame:
    """Of messages (conv_id, turn, text) that quote: conv_id, turn, origin (the turn that most
    quoted windows lead to, null if none leads anywhere), n_quoted (passages) and n_linked (those
    of which something was found)."""
    quoting = messages.filter(F.col("text").rlike("(?m)" + MARKS)).select("conv_id").distinct()
    found = messages.join(quoting, "conv_id", "left_semi").select("conv_id", "turn", F.posexplode(passages(F.col("text"))).alias("nth", "p"))
    level = F.col("p.level").cast("int")
    key = ["conv_id", "level", "hash"]
    wanted = found.filter(level > 0).select("conv_id", "turn", F.struct("turn", F.xxhash64("p"), "nth").alias("passage"), (level - 1).alias("level"), F.explode(asked(F.col("p"))).alias("hash"))
    holding = found.select("conv_id", "turn", level.alias("level"), F.explode(held(F.col("p"))).alias("hash"))
    # Only what is quoted somewhere in the conversation is ordered.
    holding = holding.join(wanted.select(*key).distinct(), key, "left_semi").distinct()
    nothing = lambda kind: F.lit(None).cast(kind)
    both = holding.select(*key, "turn", F.col("turn").alias("at"), nothing("struct<turn: bigint, hash: bigint, nth: int>").alias("passage")).unionAll(wanted.select(*key, "turn", nothing("bigint"), "passage"))
    linked = latest_before(both, key, "turn", "at", "origin").filter("passage is not null")
    # A passage counts once, whatever the number of its windows; a window votes.
    one = linked.groupBy("conv_id", "turn", "passage").agg(F.count("origin").alias("n"))
    counts = one.groupBy("conv_id", "turn").agg(F.count("*").alias("n_quoted"), F.count_if(F.col("n") > 0).alias("n_linked"))
    votes = linked.filter("origin is not null").groupBy("conv_id", "turn", "origin").count()
    best = votes.groupBy("conv_id", "turn").agg(F.max(F.struct("count", "origin"))["origin"].alias("origin"))
    return counts.join(best, ["conv_id", "turn"], "left")


def replies(messages: DataFrame) -> DataFrame:
    """messages (conv_id, turn, role, text; neither of the first two null) -> a row per conv_id
    and turn: reply_to (a lower turn, or null where a thread starts), n (messages of that turn),
    n_quoted and n_linked."""
    turns = messages.groupBy("conv_id", "turn").agg(F.count("*").alias("n"), F.min("role").alias("role"))
    before = latest_before(turns, ["conv_id"], "turn", "turn", "previous")
    other = before.select("conv_id", F.col("turn").alias("previous"), F.col("role").alias("other"))
    both = before.join(other, ["conv_id", "previous"], "left").join(quotes(messages), ["conv_id", "turn"], "left")
    goes_on = F.when(F.col("n_quoted").isNull() & ~F.col("role").eqNullSafe(F.col("other")), F.col("previous"))
    zero = lambda c: F.coalesce(c, F.lit(0)).alias(c)
    return both.select("conv_id", "turn", F.coalesce("origin", goes_on).alias("reply_to"), "n", zero("n_quoted"), zero("n_linked"))


def placed(links: DataFrame, scratch: Scratch) -> DataFrame:
    """links (conv_id, turn, reply_to, n) with `thread`, the turn at the root of its tree, and
    `position`, the place of its first message depth first, from 1.

    The walk around a tree enters a turn, walks around its replies and leaves it. Every step of
    the walk points to the next and counts the messages that it enters; pointers are followed by
    doubling until each points to the root's leaving."""
    kids = links.filter("reply_to is not null").select("conv_id", "reply_to", "turn", (-F.col("turn")).alias("back"))
    beside = latest_before(kids, ["conv_id", "reply_to"], "back", "back", "next").select("conv_id", "turn", (-F.col("next")).alias("beside"))
    first = kids.groupBy("conv_id", "reply_to").agg(F.min("turn").alias("first")).withColumnRenamed("reply_to", "turn")
    around = links.join(beside, ["conv_id", "turn"], "left").join(first, ["conv_id", "turn"], "left")
    enter = F.struct(F.lit(False).alias("left"), F.coalesce("first", "turn").alias("next"), F.col("first").isNull().alias("next_left"), F.col("n").alias("count"))
    leave = F.struct(F.lit(True).alias("left"), F.coalesce("beside", "reply_to").alias("next"), F.col("beside").isNull().alias("next_left"), F.lit(0).cast("long").alias("count"))
    held = active = scratch.save(around.select("conv_id", "turn", F.explode(F.array(enter, leave)).alias("s")).select("conv_id", "turn", "s.*", F.lit(False).alias("done")), "steps")
    # Those that point to their root's leaving are done, and only looked up by others; they don't
    # meet in that one step again.
    done = []
    while True:
        steps = reduce(DataFrame.unionAll, [active, *done])
        over = steps.select("conv_id", F.col("turn").alias("next"), F.col("left").alias("next_left"), F.col("next").alias("further"), F.col("next_left").alias("further_left"), F.col("count").alias("more"), F.col("done").alias("over_done"))
        moved = F.col("further").isNotNull()
        ahead = active.join(over, ["conv_id", "next", "next_left"], "left").select(
            "conv_id", "turn", "left", F.coalesce("further", "next").alias("next"), F.when(moved, F.col("further_left")).otherwise(F.col("next_left")).alias("next_left"),
            (F.col("count") + F.when(moved, F.col("more")).otherwise(0)).alias("count"), (~moved | F.col("over_done")).alias("done"),
        )
        last, held = held, scratch.save(ahead, "steps", "done")
        scratch.drop(last, part="done=false" if done else "")
        done.append(held.filter("done"))
        active = held.filter("not done")
        if active.isEmpty():
            break
    steps = reduce(DataFrame.unionAll, done)
    entered = steps.filter(~F.col("left")).select("conv_id", "turn", F.col("next").alias("thread"), "count")
    sizes = entered.filter("turn = thread").select("conv_id", "thread", F.col("count").alias("size"))
    return links.join(entered.join(sizes, ["conv_id", "thread"]), ["conv_id", "turn"]).withColumn("position", F.col("size") - F.col("count") + 1).drop("size", "count")


def formatted(messages: DataFrame, conv_id: str = "conv_id", turn: str = "turn", role: str = "role", text: str = "text") -> DataFrame:
    """One row per message: conv_id, thread (the turn that it starts with), position, turn, role,
    content (without quoted lines), reply_to, n_quoted and n_linked (quoted passages, and those
    that were found). Order by conv_id, thread, position.

    position counts the thread's messages from 1, depth first. Equal turns of a conversation are
    one message sent more than once: they have the same links, and follow one another in order of
    role and content. A null text has content null; a text of quotes only has content ''. Messages
    with a null conv_id or turn stay, without links, thread or position. A null role is a role
    like others. Other columns are ignored; an empty table gives no rows."""
    scratch = Scratch(messages.sparkSession, "chat")
    rows = messages.select(*[F.col(f"`{c}`").alias(n) for c, n in ((conv_id, "conv_id"), (turn, "turn"), (role, "role"), (text, "text"))])
    rows = rows.withColumns({"conv_id": F.col("conv_id").cast("long"), "turn": F.col("turn").cast("long"), "text": F.col("text").cast("string")})
    links = scratch.save(replies(rows.filter("conv_id is not null and turn is not null")), "links")
    places = placed(links, scratch)
    own = F.array_join(F.filter(F.split("text", "\r?\n"), lambda x: ~x.rlike(MARKS)), "\n")
    content = F.when(F.col("text").rlike("(?m)" + MARKS), F.regexp_replace(own, r"^\s+|\s+$", "")).otherwise(F.col("text"))
    # Copies of a message are counted, not gathered.
    same = rows.groupBy("conv_id", "turn", "role", content.alias("content")).count()
    upto = F.sum("count").over(Window.partitionBy("conv_id", "turn").orderBy("role", "content").rowsBetween(Window.unboundedPreceding, -1))
    placeless = same.filter("conv_id is null or turn is null").withColumn("before", F.lit(0).cast("long"))
    each = same.filter("conv_id is not null and turn is not null").withColumn("before", F.coalesce(upto, F.lit(0))).unionByName(placeless)
    each = each.withColumn("copy", F.explode(F.sequence(F.lit(0).cast("long"), F.col("count") - 1)))
    out = each.join(places.drop("n"), ["conv_id", "turn"], "left")
    return out.select("conv_id", "thread", (F.col("position") + F.col("before") + F.col("copy")).cast("long").alias("position"), "turn", "role", "content", "reply_to", "n_quoted", "n_linked")
