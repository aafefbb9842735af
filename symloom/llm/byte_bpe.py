"""Byte-level BPE, encoding and decoding, by a sentencepiece model made from the rank file.

A rank file lists byte strings with ranks. Each byte is written as one printable character,
so that a sentencepiece model can hold the byte strings as pieces: model type BPE, score
minus the rank, identity normalisation, no dummy prefix. Two neighbours merge if their
concatenation is a piece, best score (lowest rank) first, leftmost first among equals, which
is the merge rule of the rank file. Texts are cut into pre-tokens first, each encoded alone.
"""

from __future__ import annotations

import base64
import re
from array import array
from collections.abc import Iterator
from contextlib import suppress
from dataclasses import dataclass
from functools import lru_cache

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

#: Pre-tokens whose ids a worker remembers; beyond that it forgets all and starts again.
REMEMBERED = 250_000
#: Characters of texts that are cut into pre-tokens at a time (a longer text alone).
AT_ONCE = 1_000_000

#: Letters and numbers of Unicode versions after 16 (first to last), which the
#: rank file's library doesn't know as such.
NEWER = """
558-558 58b-58c 88f-88f c5c-c5c cdc-cdc 208f-208f 209d-209f a7ce-a7cf a7d2-a7d2 a7d4-a7d4 a7dd-a7dd a7e2-a7e2 a7f1-a7f1
ab6c-ab6d 107bb-107bf 10940-10959 10ec5-10ec7 10ed9-10eee 11b0a-11b0a 11db0-11ddb 11de0-11de9 11df1-11df1 1246f-1246f
12475-1247f 12550-12686 16ea0-16eb8 16ebb-16ed3 16ff2-16ff6 187f8-187ff 18cd6-18cda 18d09-18d20 18d80-18df2 18e00-19191
191a0-191d2 1b123-1b128 1b168-1b168 1d6a6-1d6a6 1df1f-1df24 1df2b-1df81 1df90-1df96 1dfcd-1dfff 1e6c0-1e6de 1e6e0-1e6e2
1e6e4-1e6e5 1e6e7-1e6ed 1e6f0-1e6f4 1e6fe-1e6ff 2b73a-2b73f 2b81e-2b81e 2cea2-2cead 323b0-33479 3d000-3fc3f
""".split()


def alphabet() -> dict[int, str]:
    """Byte -> character: visible Latin-1 characters stand for themselves, others for 256 on."""
    visible = {b for b in range(256) if 33 <= b <= 126 or (b >= 161 and b != 173)}
    others = iter(range(256, 512))
    return {b: chr(b if b in visible else next(others)) for b in range(256)}


def read_ranks(path: str) -> dict[bytes, int]:
    """Lines 'base64 rank'."""
    with open(path, "rb") as f:
        return {base64.b64decode(a): int(b) for a, b in map(bytes.split, f)}


def piece_model(ranks: dict[bytes, int]) -> bytes:
    """The serialised sentencepiece model. Piece 0 is <unk>; rank r is piece r + 1.

    ranks must be 0..n-1 and hold all 256 single bytes, so that <unk> never occurs."""
    from sentencepiece import sentencepiece_model_pb2 as pb

    ordered = sorted(ranks, key=ranks.get)
    if [ranks[x] for x in ordered] != list(range(len(ordered))):
        raise ValueError("ranks must be 0..n-1")
    if missing := [b for b in range(256) if bytes([b]) not in ranks]:
        raise ValueError(f"no rank for the bytes {missing}")
    chars = alphabet()
    model = pb.ModelProto()
    model.pieces.add(piece="<unk>", score=0.0, type=pb.ModelProto.SentencePiece.UNKNOWN)
    for rank, token in enumerate(ordered):
        model.pieces.add(piece="".join(chars[b] for b in token), score=float(-rank))
    model.trainer_spec.model_type = pb.TrainerSpec.BPE
    model.trainer_spec.vocab_size = len(model.pieces)
    for name in ("bos_id", "eos_id", "pad_id"):
        setattr(model.trainer_spec, name, -1)
    model.normalizer_spec.name = "identity"
    model.normalizer_spec.precompiled_charsmap = b""
    for name in ("add_dummy_prefix", "remove_extra_whitespaces", "escape_whitespaces"):
        setattr(model.normalizer_spec, name, False)
    return model.SerializeToString()


class Codec:
    """Encodes texts to ids and back, in one process."""

    def __init__(self, model: bytes, pattern: str):
        import regex
        import sentencepiece

        self._pieces = sentencepiece.SentencePieceProcessor(model_proto=model)
        newer = "".join("-".join(f"\\U{int(x, 16):08x}" for x in r.split("-")) for r in NEWER)
        spaces = pattern.replace(r"[^\s\p{L}\p{N}]", r"[^\p{White_Space}\p{L}\p{N}]").replace(r"\s", r"\p{White_Space}").replace(r"\S", r"\P{White_Space}")
        older = spaces.replace(r"\p{L}", rf"[\p{{L}}--[{newer}]]").replace(r"\p{N}", rf"[\p{{N}}--[{newer}]]")
        self._has_newer = re.compile(f"[{newer}]").search
        self._plain, self._older = regex.compile(spaces).findall, regex.compile("(?V1)" + older).findall
        self._char_of = {b: c for b, c in alphabet().items()}
        byte_of = {ord(c): b for b, c in self._char_of.items()}
        self.tokens = [bytes(byte_of[ord(c)] for c in self._pieces.id_to_piece(i)) for i in range(1, self._pieces.get_piece_size())]
        self._whole = {}
        for i, t in enumerate(self.tokens):
            with suppress(UnicodeDecodeError):
                self._whole[t.decode()] = array("i", [i + 1]).tobytes()
        self._ids_of: dict[str, bytes] = {}

    def _split(self, text: str) -> list[str]:
        return (self._older if self._has_newer(text) else self._plain)(text)

    def _learn(self, pretokens: list[str]) -> None:
        """The model's ids (one above the rank) of new pre-tokens, as bytes of int32."""
        hard = []
        for p in pretokens:
            whole = self._whole.get(p)
            if whole is None:
                hard.append(p)
            else:
                self._ids_of[p] = whole
        mapped = [p.encode().decode("latin-1").translate(self._char_of) for p in hard]
        for p, ids in zip(hard, self._pieces.encode(mapped, out_type=int, num_threads=1), strict=True):
            self._ids_of[p] = array("i", ids).tobytes()

    def encode(self, texts: list[str]) -> list[bytes]:
        """The model's ids of each whole text, as bytes of int32; each is one above the rank."""
        pretokens = list(map(self._split, texts))
        distinct = set().union(*pretokens)
        if len(self._ids_of) + len(distinct) > REMEMBERED:
            self._ids_of.clear()
        self._learn([p for p in distinct if p not in self._ids_of])
        return [b"".join(map(self._ids_of.__getitem__, x)) for x in pretokens]

    def decode(self, ids: list[int]) -> bytes:
        return b"".join(map(self.tokens.__getitem__, ids))


@lru_cache(maxsize=2)
def codec(model: bytes, pattern: str) -> Codec:
    """One codec a worker process."""
    return Codec(model, pattern)


def texts_to_ids(own: Codec, texts: pa.Array) -> pa.Array:
    """list<int32> for an array of strings; null: no ids."""
    found: list[bytes] = []
    held: list[str] = []
    size = 0
    for text in texts.to_pylist():
        held.append(text or "")
        size += len(held[-1])
        if size > AT_ONCE:
            found += own.encode(held)
            held, size = [], 0
    found += own.encode(held)
    offsets = np.zeros(len(found) + 1, np.int32)
    np.cumsum([len(x) // 4 for x in found], out=offsets[1:])
    values = np.frombuffer(b"".join(found), np.int32) - np.int32(1)
    return pa.ListArray.from_arrays(pa.array(offsets), pa.array(values))


def id_lists(ids: pa.Array) -> Iterator[list[int]]:
    """The ids of each row, a row at a time; null: none."""
    values, offsets = ids.values.to_numpy(), ids.offsets.to_numpy()
    for start, end, null in zip(offsets, offsets[1:], ids.is_null().to_pylist(), strict=False):
        yield [] if null else values[start:end].tolist()


@dataclass(frozen=True)
class ByteBpe:
    """A tokenizer, by rank file and pre-token pattern. Its model (a fixed size: that of the
    vocabulary) goes to the workers by broadcast; the file is read on the driver only."""

    ranks_path: str
    pattern: str

    def handle(self, df: DataFrame):
        return df.sparkSession.sparkContext.broadcast(piece_model(read_ranks(self.ranks_path)))

    def encode(self, df: DataFrame, text: str = "text", to: str = "ids") -> DataFrame:
        """df with the column `to`: array<int>, the ids of each whole text.

        Null and empty texts have no ids (an empty array). Other columns stay; a column
        named as `to` is replaced. An empty table gives an empty table."""
        return df.withColumn(to, self.encoder(df)(df[text]))

    def decode(self, df: DataFrame, ids: str = "ids", to: str = "decoded") -> DataFrame:
        """df with the column `to`: binary, the bytes that the ids stand for. Null: empty."""
        return df.withColumn(to, self.decoder(df)(df[ids]))

    def round_trip(self, df: DataFrame, text: str = "text", to: str = "round_trip") -> DataFrame:
        """df with the struct `to`: ids, as encode() gives them, and decoded, what decode() makes
        of them. One worker does both, where two columns would need two."""
        model, pattern = self.handle(df), self.pattern

        @F.arrow_udf("ids array<int>, decoded binary")
        def both(parts: Iterator[pa.Array]) -> Iterator[pa.Array]:
            own = codec(model.value, pattern)
            for texts in parts:
                ids = texts_to_ids(own, texts)
                yield pa.StructArray.from_arrays([ids, pa.array(map(own.decode, id_lists(ids)), pa.binary())], ["ids", "decoded"])

        return df.withColumn(to, both(df[text]))

    def encoder(self, df: DataFrame):
        model, pattern = self.handle(df), self.pattern

        @F.arrow_udf("array<int>")
        def encode(parts: Iterator[pa.Array]) -> Iterator[pa.Array]:
            own = codec(model.value, pattern)
            for texts in parts:
                yield texts_to_ids(own, texts)

        return encode

    def decoder(self, df: DataFrame):
        model, pattern = self.handle(df), self.pattern

        @F.arrow_udf("binary")
        def decode(parts: Iterator[pa.Array]) -> Iterator[pa.Array]:
            own = codec(model.value, pattern)
            for ids in parts:
                yield pa.array(map(own.decode, id_lists(ids)), pa.binary())

        return decode
