"""Every registered query and the pipeline, over a literal folder of tables, against brute force."""

import hashlib
import random
import zlib
from collections import Counter

import numpy as np
import pytest

import corpus_pipeline
from symloom.llm import mil_classifier
from symloom.llm.queries import ORACLES, QUERIES

from . import test_chat, test_lexical, test_mixing, test_neighbours, test_ngram_join, test_quality_rules, test_warc, test_whitening
from .helpers import LONG

public = pytest.importorskip("public_tokenizers")
tiktoken = pytest.importorskip("tiktoken")
library = pytest.importorskip("tokenizers")

# A column that the contract doesn't name, with a name that operators use inside.
DOCS = "doc_id long, text string, lang string, source string, n_chars long, size string, score string, row string"
EMPTY = [(None, None, None), (40, None, "a"), (41, "", None), (42, " \n\t ", "b"), (43, "one two three", "b"), (44, "élan Ünder <|endoftext|> 'S it's ſ İ x́\x1c\x85 3.14", "c")]


def documents():
    rng = random.Random(12)
    word = lambda: "".join(rng.choice("aeioulnrst") for _ in range(rng.randrange(2, 9)))
    texts = [" ".join(word() for _ in range(rng.randrange(60, 160))) + "." for _ in range(60)]
    texts += [t.upper() for t in texts[:5]] + [test_ngram_join.edited(rng, t.split(), 3) for t in texts[:20]] + texts[5:8]
    texts += [" ".join("%% ## $$".split()[rng.randrange(3)] + word() for _ in range(90)) for _ in range(40)]
    rows = [(100 + k, t, rng.choice(["hot", "hot", "b", None])) for k, t in enumerate(texts)]
    rows += [*EMPTY, (45, LONG, "hot"), (100, texts[0], "hot"), (46, "\n".join(["same line of text here"] * 30), "c")]
    rng.shuffle(rows)
    return rows


@pytest.fixture(scope="module")
def sf(spark, tmp_path_factory):
    at = tmp_path_factory.mktemp("tables")
    rows = documents()
    put = lambda name, data, schema: spark.createDataFrame(data, schema).repartition(3).write.parquet(f"{at}/{name}.parquet")
    put("documents", [(i, t, "en", s, len(t or ""), "9", "x", "y") for i, t, s in rows], DOCS)
    labels = {i: int("%%" not in t) for i, t, _ in rows if i and i >= 100}
    put("labels", [*((i, q, int(not q)) for i, q in labels.items()), (None, 1, 0), (7, 0, 0), (101, None, None)], "doc_id long, quality int, toxic int")
    common = " ".join({w for _, t, _ in rows[::5] for w in (t or "").split()[:40]})
    items = [(5, common), (1, " ".join(rows[3][1].split()[:20]) if rows[3][1] else "x"), (2, "w1 W2, w976 w1"), (3, None), (4, "one two three"), (4, "one two three")]
    put("benchmark", items, "item_id long, text string")
    rng = np.random.default_rng(4)
    vectors = [(i, rng.standard_normal(8).tolist(), 0) for i in range(400)] + [(500, None, 0), (600, [0.0] * 8, 0), (700, [float("nan")] * 8, 0), (800, [1e200] * 8, 0), (900, [1.0, None, *[0.0] * 6], 0)]
    put("embeddings", vectors, "vec_id long, embedding array<double>, label int")
    pages = [(1, "u", "<p>x</p>"), (2, None, None), (3, "u", ""), (4, "u", "<p>x</p>"), (5, "v", "é" * 5000)]
    put("pages", pages, "page_id long, url string, html string")
    talk = [(1, 0, "a", "Who reads the old archive files these days, and why?"), (1, 1, "b", "> Who reads the old archive files\n> these days, and why?\nI do."), (1, 2, "a", "> I do.\nThanks"), (1, 3, "c", "> Who reads the old archive files these days, and why?\nNobody."), (2, None, "a", "x"), (None, 1, None, None), (3, 1, "a", "")]
    put("conversations", talk, "conv_id long, turn long, role string, text string")
    return {"at": str(at), "docs": rows, "labels": labels, "items": items, "vectors": vectors, "pages": pages, "talk": talk}


@pytest.fixture(scope="module")
def empty(spark, sf, tmp_path_factory):
    at = tmp_path_factory.mktemp("empty")
    for t in ("documents", "labels", "benchmark", "embeddings", "pages", "conversations"):
        spark.read.parquet(f"{sf['at']}/{t}.parquet").limit(0).write.parquet(f"{at}/{t}.parquet")
    return str(at)


def rows(spark, sf, name, *columns):
    got = QUERIES[name](spark, sf["at"])
    assert set(columns) <= set(got.columns)
    return sorted((tuple(r[c] for c in columns) for r in got.collect()), key=str)


def test_op1(spark, sf):
    got = rows(spark, sf, "op1_quality_rules", "doc_id", "n_words", "word_chars", "n_symbols", "n_dup_lines", "n_repeat_words", "base_failed")
    want = [(i, *(m := test_quality_rules.brute(t)), m[0] < 50 or 100 * m[4] > 50 * m[0]) for i, t, _ in sf["docs"]]
    assert got == sorted(want, key=str)
    kept = rows(spark, sf, "op1_quality_rules", "doc_id", "base_failed", "kept")
    assert not any(failed and keep for _, failed, keep in kept)
    good = {i for i, t, _ in sf["docs"] if i and i >= 100 and "%%" not in t}
    assert {i for i, failed, keep in kept if keep and not failed and i != 45} <= good | {46}


def test_op2(spark, sf):
    assert rows(spark, sf, "op2_ngram_join", "doc_id", "n_shingles", "component_id") == test_ngram_join.brute([(i, t) for i, t, _ in sf["docs"]])


@pytest.fixture(scope="module")
def bpe():
    import base64

    ranks = {base64.b64decode(a): int(b) for a, b in map(bytes.split, open(public.path("byte_bpe_multi_50k.tiktoken"), "rb"))}
    return tiktoken.Encoding("own", pat_str=public.PATTERN, mergeable_ranks=ranks, special_tokens={})


def test_op3(spark, sf, bpe):
    want = []
    for i, t, _ in sf["docs"]:
        ids = bpe.encode_ordinary(t or "")
        want.append((i, len(ids), hashlib.sha256(",".join(map(str, ids)).encode()).hexdigest(), hashlib.sha256((t or "").encode()).hexdigest()))
    assert rows(spark, sf, "op3_byte_bpe", "doc_id", "n_tokens", "ids_sha256", "decoded_sha256") == sorted(want, key=str)


def test_op4(spark, sf):
    columns = ("doc_id", "size", "source_size", "target", "taken")
    got = QUERIES["op4_mixing"](spark, sf["at"]).collect()
    source = {i: s for i, _, s in sf["docs"]}
    test_mixing.check([{c: r[c] for c in (*columns, "copies", "finish")} | {"source": source[r["doc_id"]]} for r in got])
    assert Counter((r["doc_id"], r["size"]) for r in got) == Counter((i, test_quality_rules.brute(t)[0]) for i, t, _ in sf["docs"])
    assert sorted(tuple(r) for r in got if r["doc_id"]) == sorted(tuple(r) for r in QUERIES["op4_mixing"](spark, sf["at"]).collect() if r["doc_id"])


def test_op5(spark, sf):
    got = rows(spark, sf, "op5_neighbours", "query_id", "rank", "vec_id", "score")
    vectors = [(i, v) for i, v, _ in sf["vectors"] if v is not None and None not in v and np.isfinite(v).all() and any(v)]
    # 1e200 is too far for squares; all others are equally far from it in doubles.
    want = test_neighbours.brute([x for x in vectors if x[0] != 800], range(0, 400, 100), 10)
    assert {q for q, *_ in got} == {0, 100, 200, 300, 800}
    hits = sum(i in {j for _, j in want[q]} for q, _, i, _ in got if q != 800)
    assert hits >= 0.9 * 40 and Counter(q for q, *_ in got) == Counter({q: 10 for q in (0, 100, 200, 300, 800)})
    assert all(np.isclose(s, np.linalg.norm(np.array(dict(vectors)[q]) - dict(vectors)[i]), rtol=1e-12) for q, _, i, s in got if q != 800)


def test_op6(spark, sf):
    got = rows(spark, sf, "op6_quality_classifier", "doc_id", "held_out", "score", "predicted")
    assert Counter(r[0] for r in got) == Counter(i for i, *_ in sf["docs"])
    assert all(h == (i is not None and zlib.crc32(str(i).encode()) % 5 == 0) and 0 <= s <= 1 and p == (s >= 0.3) for i, h, s, p in got)
    good = {i: "%%" not in t for i, t, _ in sf["docs"] if i and i >= 100}
    held = [(p == 1) == good[i] for i, h, _, p in got if h and i in good]
    assert len(held) > 10 and np.mean(held) > 0.9


def test_op7(spark, sf):
    got = rows(spark, sf, "op7_pseudo_lm", "doc_id", "n_words", "log_prob")
    assert Counter(x[:2] for x in got) == Counter((i, len((t or "").lower().split())) for i, t, _ in sf["docs"])
    assert all(p < 0 if n else p == 0 for _, n, p in got)


def test_op8(spark, sf):
    got = {(c, t): r for c, t, *r in rows(spark, sf, "op8_chat", "conv_id", "turn", "thread", "position", "reply_to", "n_quoted", "n_linked")}
    want = test_chat.brute(sf["talk"])
    assert {k: tuple(v) for k, v in got.items() if None not in k} == want and len(got) == len(sf["talk"])
    assert got[1, 3][:3] == [0, 4, 0] and got[1, 2][:3] == [0, 3, 1]


def test_op9(spark, sf):
    whole = library.Tokenizer.from_file(public.path("word_bpe_49k.json"))
    ids = sorted(((i, whole.encode(t or "", add_special_tokens=False).ids + [1]) for i, t, _ in sf["docs"]), key=lambda x: (x[0] is not None, x[0] or 0))
    start, want = 0, []
    for i, x in ids:
        want.append((i, start, len(x), zlib.crc32(np.array(x, "<u4").tobytes())))
        start += len(x)
    assert rows(spark, sf, "op9_token_files", "doc_id", "start", "n_tokens", "ids_crc32") == sorted(want, key=str)


def test_op10(spark, sf):
    got = rows(spark, sf, "op10_warc", "page_id", "payload_bytes", "payload_digest", "record_type", "refers_to")
    want = []
    for i, _, html in sf["pages"]:
        top = max(j for j, _, h in sf["pages"] if (h or "") == (html or ""))
        want.append((i, len((html or "").encode()), test_warc.digest(html), "response" if i == top else "revisit", None if i == top else top))
    assert got == sorted(want, key=str) and "op10_warc" in ORACLES


def test_op11(spark, sf):
    want = test_lexical.brute([(i, t) for i, t, _ in sf["docs"]], [i for i in sf["items"] if i[1]])
    assert rows(spark, sf, "op11_lexical", "item_id", "rank", "doc_id", "score") == want and len(want) > 50


def test_op12(spark, sf):
    """Against an eigenvalue routine; one entry of 1e200 would leave a single component, so that
    row is left out here."""
    usable = [(i, v) for i, v, _ in sf["vectors"] if v is not None and None not in v and np.isfinite(v).all()]
    got = QUERIES["op12_whitening"](spark, sf["at"]).collect()
    assert Counter(r["vec_id"] for r in got).keys() == {i for i, _ in usable}
    assert {r["n"] for r in got} == {len(usable)} and max(r["identity_error"] for r in got) <= 1e-4
    without = spark.read.parquet(f"{sf['at']}/embeddings.parquet").filter("vec_id <> 800 or vec_id is null")
    from symloom.llm import whitening

    usable = [(i, np.float32(v)) for i, v in usable if i != 800]
    without = without.withColumn("embedding", whitening.F.col("embedding").cast("array<float>"))
    test_whitening.check(whitening.whitened(without, whitening.fit(without)).collect(), usable)


def test_op13(spark, sf):
    got = rows(spark, sf, "op13_toxicity", "doc_id", "held_out", "score", "predicted")
    assert Counter(r[0] for r in got) == Counter(i for i, *_ in sf["docs"])
    assert all(h == (i is not None and zlib.crc32(str(i).encode()) % 5 == 0) and 0 <= s <= 1 and p == (s >= 0.5) for i, h, s, p in got)


@pytest.mark.parametrize("name", sorted(QUERIES))
def test_empty_tables(spark, empty, name):
    assert QUERIES[name](spark, empty).count() == 0


def test_pipeline(spark, sf, bpe):
    """Each stage against what brute force makes of its predecessor's rows."""
    docs = spark.read.parquet(f"{sf['at']}/documents.parquet")
    key = lambda df: sorted(((r["doc_id"], r["text"], r["source"]) for r in df.collect()), key=str)
    out = {}
    for name, stage in corpus_pipeline.STAGES:
        before, done = docs, stage(spark, docs, sf["at"])
        if name != corpus_pipeline.STAGES[-1][0]:
            assert done.columns == before.columns
            done.write.parquet(at := f"{sf['at']}/stage-{len(out)}.parquet")
            docs = spark.read.parquet(at)
            out[name] = key(docs)
    rules, classifier, distinct, mixed = out.values()
    kept = QUERIES["op1_quality_rules"](spark, sf["at"]).filter("kept").select("doc_id").collect()
    assert Counter(r[0] for r in kept) == Counter(i for i, *_ in rules)
    again = spark.createDataFrame([(i, t) for i, t, _ in rules], "doc_id long, text string")
    labels = spark.read.parquet(f"{sf['at']}/labels.parquet")
    from pyspark.sql import functions as F

    net = mil_classifier.fit(again, labels.filter(~mil_classifier.held_out(F.col("doc_id"))))
    good = [r for r in rules if net.score([mil_classifier.passages(r[1])])[0] >= 0.3]
    assert classifier == sorted(good, key=str) and 20 < len(classifier) <= len(rules)
    groups = test_ngram_join.brute([(i, t) for i, t, _ in classifier])
    stay = {i for i, _, c in groups if i == c}
    assert distinct == sorted({r for r in classifier if r[0] in stay}, key=str) and len(distinct) < len(classifier)
    sizes = Counter()
    for _, t, s in distinct:
        sizes[s] += test_quality_rules.brute(t)[0]
    goal, taken = test_mixing.goals(sizes), Counter()
    for r in mixed:
        taken[r[2]] += test_quality_rules.brute(r[1])[0]
    longest = max(test_quality_rules.brute(t)[0] for _, t, _ in distinct)
    assert all(abs(taken[s] - goal[s]) <= longest for s in sizes) and max(Counter(mixed).values()) <= 2 and set(mixed) <= set(distinct)
    last = [(r["doc_id"], r["source"], r["n_tokens"], list(r["ids"]), r["decoded_ok"]) for r in corpus_pipeline.run(spark, sf["at"]).collect()]
    assert sorted(last, key=str) == sorted(((i, s, len(x := bpe.encode_ordinary(t)), x, True) for i, t, s in mixed), key=str)


def test_pipeline_of_nothing(spark, empty):
    assert corpus_pipeline.run(spark, empty).count() == 0
