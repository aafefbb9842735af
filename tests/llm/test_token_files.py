import random
import zlib

import numpy as np
import pytest

from symloom.llm import token_files
from symloom.llm.token_files import Encoder, PerfectHash, Shard, fingerprints, by_chunks, write_shard, write_tokens

from .helpers import ODD, docs_table

public = pytest.importorskip("public_tokenizers")
library = pytest.importorskip("tokenizers")
PATH = public.path("word_bpe_49k.json")


def test_perfect_hash():
    for n in (0, 1, 2, 1000):
        keys = np.unique(np.random.default_rng(n).integers(-(2**62), 2**62, n)).view(np.uint64)
        h = PerfectHash.of(keys)
        assert sorted(h.slots(keys).tolist()) == list(range(len(keys))) and h.size == len(keys)
    assert len(set(fingerprints(keys).tolist())) > 990


def test_same_ids_as_the_library():
    with open(PATH, encoding="utf-8") as f:
        own = Encoder(f.read())
    whole, rng = library.Tokenizer.from_file(PATH), random.Random(4)
    pool = ["It's", "don't", "Ünï", "ÀÉß", "naïve", "x́y", "3.14", "a-b", "...", "<|endoftext|>", "a<|startoftext|>b", "Σίσυφος", "ΟΔΟΣ", "中文", "　", "\t", "  ", "\n", "'S", "$%&!", "İ", "ﬁ", "\x1c", "\x85", "é", "🙂"]
    texts = [rng.choice(["", " "]).join(rng.choice(pool) + rng.choice(["", ".", "!!", "'"]) for _ in range(rng.randrange(30))) for _ in range(1500)] + [None]
    for text, raw in zip(texts, own.encode_all(iter(texts)), strict=True):
        assert np.frombuffer(raw, own.dtype).tolist() == whole.encode(text or "", add_special_tokens=False).ids


def test_shard_lookups(tmp_path):
    dtype = np.dtype("<u2")
    rows = [(None, [1]), (None, [2, 3]), (-5, []), (7, [4]), (7, [5, 6]), (10**15, [7])]
    write_shard(str(tmp_path), "s", ((k, np.array(x, dtype).tobytes()) for k, x in rows), dtype)
    shard = Shard(f"{tmp_path}/s")
    first, n = shard.rows_of([None, -5, 7, 10**15, 8])
    assert (first.tolist(), n.tolist()) == ([0, 2, 3, 5, 0], [2, 1, 2, 1, 0])
    assert [shard.ids(k).tolist() for k in range(6)] == [x for _, x in rows]


@pytest.mark.parametrize("shards", [1, 3])
def test_files_hold_every_document_in_order(spark, shards):
    docs = docs_table(spark, [*ODD, *[(k, f"text {k} here", "s") for k in range(100, 160)]])
    whole = library.Tokenizer.from_file(PATH)
    files = write_tokens(docs, PATH, shards=shards)
    got = files.read().collect()
    assert len(got) == docs.count()
    want = sorted(((r["doc_id"], whole.encode(r["text"] or "", add_special_tokens=False).ids + [1]) for r in docs.collect()), key=str)
    assert sorted(((r["key"], np.frombuffer(bytes(r["ids"]), "<u4").tolist()) for r in got), key=str) == want
    ordered = sorted(got, key=lambda r: (r["shard"], r["start"]))
    keys = [r["key"] for r in ordered]
    assert keys == sorted(keys, key=lambda k: (k is not None, k or 0))
    assert zlib.crc32(bytes(ordered[0]["ids"])) >= 0
    assert write_tokens(docs.limit(0), PATH).read().count() == 0


def test_another_tokenizer_file(spark):
    """By rules other than those that allow chunks, texts are encoded as a whole."""
    path = public.path("byte_bpe_50k.json")
    whole = library.Tokenizer.from_file(path)
    docs = docs_table(spark, [*ODD, (9, "Mixed CASE,  two  spaces\nand lines", "s")])
    got = write_tokens(docs, path, end_id=None).read().collect()
    want = sorted(((r["doc_id"], whole.encode(r["text"] or "", add_special_tokens=False).ids) for r in docs.collect()), key=str)
    assert sorted(((r["key"], np.frombuffer(bytes(r["ids"]), "<u4").tolist()) for r in got), key=str) == want


def test_an_added_word_forbids_chunks():
    import json

    with open(PATH, encoding="utf-8") as f:
        spec = json.load(f)
    assert by_chunks(spec)
    for content in ("word", "two words", "a."):
        assert not by_chunks(spec | {"added_tokens": [*spec["added_tokens"], {"content": content}]})
    assert not by_chunks(spec | {"normalizer": None})


def test_words_are_forgotten_without_loss(monkeypatch):
    monkeypatch.setattr(token_files, "REMEMBERED", 3)
    monkeypatch.setattr(token_files, "AT_ONCE", 10)
    with open(PATH, encoding="utf-8") as f:
        own = Encoder(f.read())
    whole = library.Tokenizer.from_file(PATH)
    texts = [f"some words {k % 4}, more words: {k % 3} Word{'s' * (k % 5)}!" for k in range(40)]
    assert [np.frombuffer(x, own.dtype).tolist() for x in own.encode_all(iter(texts))] == [whole.encode(t, add_special_tokens=False).ids for t in texts]


def test_a_task_begins_new_shards():
    rows = [(k, b"x" * 10) for k in range(7)]
    it = iter(rows)
    assert len(list(token_files._some(next(it), it))) == 7


def test_small_shards(monkeypatch):
    monkeypatch.setattr(token_files, "SHARD_ROWS", 3)
    it, found = iter([(k, b"") for k in range(7)]), []
    while (first := next(it, None)) is not None:
        found.append([k for k, _ in token_files._some(first, it)])
    assert found == [[0, 1, 2], [3, 4, 5], [6]]
