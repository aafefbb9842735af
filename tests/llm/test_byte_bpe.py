import random

import pytest

from symloom.llm.byte_bpe import ByteBpe, Codec, piece_model, read_ranks

from .helpers import ODD, docs_table

tokenizers = pytest.importorskip("public_tokenizers")
tiktoken = pytest.importorskip("tiktoken")


@pytest.fixture(scope="module")
def ranks():
    return read_ranks(tokenizers.path("byte_bpe_multi_50k.tiktoken"))


@pytest.fixture(scope="module")
def wanted(ranks):
    return tiktoken.Encoding("own", pat_str=tokenizers.PATTERN, mergeable_ranks=ranks, special_tokens={})


def test_same_ids_as_the_rank_library(ranks, wanted):
    import numpy as np

    codec, rng = Codec(piece_model(ranks), tokenizers.PATTERN), random.Random(1)
    texts = ["".join(chr(rng.choice([rng.randrange(0, 128), rng.randrange(128, 0xD800), rng.randrange(0xE000, 0x20000), 32, 10])) for _ in range(rng.randrange(60))) for _ in range(2000)] + ["a" * 5000, " " * 300]
    for text, raw in zip(texts, codec.encode(texts), strict=True):
        ids = (np.frombuffer(raw, np.int32) - 1).tolist()
        assert ids == wanted.encode_ordinary(text)
        assert codec.decode(ids) == text.encode()


def test_round_trip_of_odd_tables(spark, wanted):
    bpe = ByteBpe(tokenizers.path("byte_bpe_multi_50k.tiktoken"), tokenizers.PATTERN)
    docs = docs_table(spark, ODD)
    rows = bpe.decode(bpe.encode(docs)).collect()
    assert len(rows) == len(ODD) and rows[0]["score"] == "z"
    for r in rows:
        assert r["ids"] == wanted.encode_ordinary(r["text"] or "") and bytes(r["decoded"]) == (r["text"] or "").encode()
    again = bpe.round_trip(docs.drop("ids")).select("text", "round_trip.*").collect()
    assert sorted((r["text"] or "", r["ids"], bytes(r["decoded"])) for r in again) == sorted((r["text"] or "", r["ids"], bytes(r["decoded"])) for r in rows)
    assert bpe.encode(docs.limit(0)).count() == 0


def test_ranks_must_be_whole(ranks):
    with pytest.raises(ValueError):
        piece_model({b"a": 0})
    with pytest.raises(ValueError):
        piece_model({b"a": 0, b"b": 2})
