import random
import re
from collections import Counter

from symloom.llm.chat import STRETCH, WINDOW, formatted

SCHEMA = "conv_id long, turn long, role string, text string, thread string, position string"
MARKS = re.compile(r"(?:[ \t]*>)+")


def table(spark, rows):
    return spark.createDataFrame([(*r, "t", "p") for r in rows], SCHEMA)


def runs(text):
    """(level, words, lines) of each run of lines of one level."""
    out = []
    for line in (text or "").split("\n") if text is not None else []:
        m = MARKS.match(line)
        level = m.group().count(">") if m else 0
        words = (line[m.end() :] if m else line).lower().split()
        if out and out[-1][0] == level:
            out[-1][1].extend(words)
            out[-1][2].append(words)
        else:
            out.append((level, list(words), [words]))
    return [r for r in out if r[1]]


def parts(words):
    return [tuple(words[i : i + WINDOW]) for i in range(len(words) - WINDOW + 1)]


def brute(rows):
    """{(conv, turn): (thread, position of the first message, reply_to, n_quoted, n_linked)}."""
    out = {}
    for conv in {r[0] for r in rows if r[0] is not None}:
        turns = {}
        for _, turn, role, text in (r for r in rows if r[0] == conv and r[1] is not None):
            turns.setdefault(turn, []).append((role, text))
        held, info, kids, before = {}, {}, {}, None
        for turn in sorted(turns):
            votes, quoted, linked = Counter(), 0, 0
            for level, words, _ in {(lv, tuple(w), i): (lv, w, ls) for _, t in turns[turn] for i, (lv, w, ls) in enumerate(runs(t))}.values():
                if level == 0:
                    continue
                n = len(words) - WINDOW
                asked = {tuple(words[i : i + WINDOW]) for i in sorted({*range(0, n + 1, WINDOW), n})} if n >= 0 else {tuple(words)}
                hits = [held[level - 1, a] for a in asked if (level - 1, a) in held]
                votes.update(hits)
                quoted, linked = quoted + 1, linked + bool(hits)
            role = min((r for r, _ in turns[turn] if r is not None), default=None)
            up = max(votes, key=lambda t: (votes[t], t)) if votes else before[0] if before and not quoted and role != before[1] else None
            info[turn] = (up, quoted, linked)
            kids.setdefault(up, []).append(turn)
            before = (turn, role)
            for _, text in turns[turn]:
                for level, words, lines in runs(text):
                    for x in [*parts(words), *(tuple(x) for x in (words, *lines) if 0 < len(x) < WINDOW)]:
                        held[level, x] = turn
        for root in kids.get(None, []):
            at, stack = 1, [root]
            while stack:
                t = stack.pop()
                out[conv, t] = (root, at, *info[t])
                at += len(turns[t])
                stack += kids.get(t, [])[::-1]
    return out


def results(spark, rows):
    got = formatted(table(spark, rows)).collect()
    assert len(got) == len(rows)
    first = {}
    for r in got:
        if r["conv_id"] is not None and r["turn"] is not None:
            first.setdefault((r["conv_id"], r["turn"]), []).append(r)
    for same in first.values():
        at = sorted(r["position"] for r in same)
        assert at == list(range(at[0], at[0] + len(at)))
    return {k: (v[0]["thread"], min(r["position"] for r in v), v[0]["reply_to"], v[0]["n_quoted"], v[0]["n_linked"]) for k, v in first.items()}, got


def test_quotes_are_linked_and_removed(spark):
    rows = [
        (1, 0, "a", "How do I sort?\nAnd filter?"), (1, 1, "b", "> How do I sort?\nUse order by."), (1, 2, "c", ">> How do I  SORT?\n> use order by.\nThanks"),
        (1, 3, "d", "> And filter?\n\nUse where."), (1, 4, "e", "no quote"), (1, 5, "f", "> never said\nhm"), (1, 6, "f", "same role"),
    ]
    found, got = results(spark, rows)
    out = {r["turn"]: r for r in got}
    assert [out[k]["reply_to"] for k in range(7)] == [None, 0, 1, 0, 3, None, None]
    assert [out[k]["content"] for k in (1, 2, 3, 5)] == ["Use order by.", "Thanks", "Use where.", "hm"]
    assert [(out[k]["n_quoted"], out[k]["n_linked"]) for k in (1, 2, 5)] == [(1, 1), (2, 2), (1, 0)]
    assert [(out[k]["thread"], out[k]["position"]) for k in range(7)] == [(0, 1), (0, 2), (0, 3), (0, 4), (0, 5), (5, 1), (6, 1)]
    assert found == brute(rows)


def test_depth_first_order_is_not_turn_order(spark):
    """A nested quote leads to the message that quoted, and late replies go to their branch."""
    rows = [
        (7, 1, "a", "Which of these two tools reads the old archive files best?"), (7, 2, "b", "> Which of these two tools reads the old archive\n> files best?\nThe first one."),
        (7, 3, "c", "> Which of these two tools\n> reads the old archive files best?\nNeither, I fear."), (7, 4, "d", ">> Which of these two tools reads the old archive files best?\nLate, but for the first."),
        (7, 5, "e", "> Neither, I fear.\nWhy?"), (7, 6, "f", "> The first one.\nGood."),
    ]
    found, got = results(spark, rows)
    order = [r["turn"] for r in sorted(got, key=lambda r: (r["thread"], r["position"]))]
    # Turn 4 quotes at level two what turns 2 and 3 quote at level one: the later is its parent.
    assert order == [1, 2, 6, 3, 4, 5] and {r["turn"]: r["reply_to"] for r in got} == {1: None, 2: 1, 3: 1, 4: 3, 5: 3, 6: 2}
    assert found == brute(rows)


def test_random_conversations_match_brute_force(spark):
    rng, rows = random.Random(11), []
    for conv in range(12):
        said = []
        for turn in sorted(rng.sample(range(-5, 4000), rng.randrange(1, 40))):
            own = [f"w{rng.randrange(60)}" for _ in range(rng.choice([2, 5, 9, 30]))]
            lines = []
            for src in rng.sample(said, min(len(said), rng.choice([0, 0, 1, 1, 2]))):
                some = src[rng.randrange(len(src)) :] if rng.random() < 0.3 else src
                lines += ["> " + x if not x.startswith(">") else ">" + x for x in some]
            cut = rng.choice([4, 7, 100])
            body = [" ".join(own[i : i + cut]) for i in range(0, len(own), cut)]
            said.append(lines + body)
            copies = 1 + (rng.random() < 0.1)
            rows += [(conv, turn, rng.choice("ab"), "\n".join(lines + body))] * copies
    found, got = results(spark, rows)
    want = brute(rows)
    assert found == want
    assert any(r["position"] != k + 1 for conv in range(12) for k, r in enumerate(sorted((r for r in got if r["conv_id"] == conv), key=lambda r: r["turn"])))


def test_long_conversations_and_odd_rows(spark):
    n = 2 * STRETCH + 10
    rows = [(1, 2 * k, "ab"[k % 2], f"m {k}") for k in range(n)] + [(6, k, "a", "> opening line\nme too" if k else "Opening  line") for k in range(n)]
    rows += [(None, 1, "a", "x"), (2, None, "a", "> y"), (3, 1, None, None), (3, 2, None, ">"), (4, 1, "a", ""), (5, 1, "a", "d"), (5, 1, "a", "d")]
    found, got = results(spark, rows)
    assert found == brute(rows)
    assert [found[1, 2 * k][:3] for k in range(n)] == [(0, k + 1, 2 * k - 2 if k else None) for k in range(n)]
    assert {found[6, k][2] for k in range(1, n)} == {0}
    odd = {(r["conv_id"], r["turn"]): r for r in got if r["conv_id"] not in (1, 6)}
    assert odd[None, 1]["thread"] is None and odd[2, None]["position"] is None and odd[2, None]["content"] == "" and odd[3, 1]["content"] is None and odd[4, 1]["content"] == ""
    assert sorted(r["position"] for r in got if r["conv_id"] == 5) == [1, 2]
    assert formatted(table(spark, rows).limit(0)).count() == 0


def test_any_number_of_marks_and_very_long_lines(spark):
    rows = [(1, 1, "a", "What is this?"), (1, 2, "b", ">" * 100_000 + " x\nno"), (1, 3, "c", "> " * 100_000 + "\n> What is this?\nA thing"), (1, 4, "d", "w" * 1_000_000), (1, 5, "e", "> " + "w" * 1_000_000)]
    found, got = results(spark, rows)
    assert found == brute(rows) and found[1, 3][2] == 1 and found[1, 5][2] == 4
    assert {r["turn"]: r["content"] for r in got if r["turn"] in (2, 3, 5)} == {2: "no", 3: "A thing", 5: ""}
