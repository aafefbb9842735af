"""Token ids in binary shard files, with a minimal perfect hash index for keyed access.

Shard k is two files in a shared folder: `<name>.ids`, the raw ids of its documents in
ascending order of key, one after another (little-endian uint16, or uint32 if the vocabulary
needs it), and `<name>.mph`, a numpy archive:

    bits_0, bits_1, ...  bit arrays of the levels of the minimal perfect hash
    print                a 32-bit fingerprint of the key at each slot
    row, rows            the key's first row and number of rows, by slot
    at                   offset of each row's first id (rows + 1 numbers)

A key is hashed at level 0; if its bit is set there, its slot is the number of set bits before
it; else level 1 is tried, and so on. So a lookup is a few probes, whatever the size of the
shard, and a key that isn't there is recognised by its fingerprint.
"""

from __future__ import annotations

import io
import json
import os
import re
from collections.abc import Iterator
from dataclasses import dataclass
from functools import lru_cache
from itertools import islice

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
from pyspark import TaskContext
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from .byte_bpe import alphabet
from .shared import file_at, saved, shared_dir

#: Words whose ids a worker remembers; beyond that it keeps those of the texts in hand.
REMEMBERED = 150_000
#: Characters of texts that are encoded at a time (a longer text alone).
AT_ONCE = 2_000_000
#: Rows, and bytes of ids, after which a task begins another shard.
SHARD_ROWS, SHARD_BYTES = 500_000, 1 << 29
#: Bits per key at each level of the hash.
LOAD = 2
MANIFEST = "key long, shard long, file string, nth int"


def mixed(keys: np.ndarray, seed: int) -> np.ndarray:
    """64-bit hashes of 64-bit keys."""
    with np.errstate(over="ignore"):
        x = keys.astype(np.uint64) + np.uint64((seed * 0x9E3779B97F4A7C15) & 0xFFFFFFFFFFFFFFFF)
        for shift, factor in ((30, 0xBF58476D1CE4E5B9), (27, 0x94D049BB133111EB)):
            x = (x ^ (x >> np.uint64(shift))) * np.uint64(factor)
        return x ^ (x >> np.uint64(31))


class PerfectHash:
    """A minimal perfect hash of distinct 64-bit keys."""

    def __init__(self, levels: list[np.ndarray]):
        self.levels = levels
        counts = [np.concatenate([[0], np.cumsum(x)]) for x in levels]
        starts = np.cumsum([0, *(int(c[-1]) for c in counts)])
        self._before = [c + s for c, s in zip(counts, starts, strict=False)]
        self.size = int(starts[-1])

    @classmethod
    def of(cls, keys: np.ndarray) -> PerfectHash:
        levels, left = [], keys
        while len(left):
            at = mixed(left, len(levels)) % np.uint64(LOAD * len(left))
            alone = np.bincount(at.astype(np.int64), minlength=LOAD * len(left)) == 1
            levels.append(alone)
            left = left[~alone[at.astype(np.int64)]]
        return cls(levels)

    def slots(self, keys: np.ndarray) -> np.ndarray:
        """The slot of each key, -1 where no level has its bit."""
        out = np.full(len(keys), -1, np.int64)
        open_ = np.arange(len(keys))
        for level, (bits, before) in enumerate(zip(self.levels, self._before, strict=True)):
            at = (mixed(keys[open_], level) % np.uint64(len(bits))).astype(np.int64)
            hit = bits[at]
            out[open_[hit]] = before[at[hit]]
            open_ = open_[~hit]
        return out


def fingerprints(keys: np.ndarray) -> np.ndarray:
    return (mixed(keys, 1009) & np.uint64(0xFFFFFFFF)).astype(np.uint32)


#: A chunk of letters and then marks whose letters make one pre-token and whose marks make
#: another, and which normalisation only puts in lower case.
SIMPLE = r"^(?P<letters>[A-Za-zÀ-ÖØ-öø-ÿ]*)(?P<marks>[!-&(-/:-@\[-`{-~]*)$"
#: The rules of a tokenizers file under which chunks between spaces can be encoded
#: alone, and simple chunks by the merges of their letters and marks.
BY_CHUNKS = {
    "normalizer": {"type": "Sequence", "normalizers": [{"type": "NFC"}, {"type": "Replace", "pattern": {"Regex": r"\s+"}, "content": " "}, {"type": "Lowercase"}]},
    "pre_tokenizer": {"type": "Sequence", "pretokenizers": [
        {"type": "Split", "pattern": {"Regex": r"'s|'t|'re|'ve|'m|'ll|'d|[\p{L}]+|[\p{N}]|[^\s\p{L}\p{N}]+"}, "behavior": "Removed", "invert": True},
        {"type": "ByteLevel", "add_prefix_space": False, "trim_offsets": True, "use_regex": False},
    ]},
}


def by_chunks(spec: dict) -> bool:
    """Whether BY_CHUNKS are the rules of a tokenizers file, and no added token lies in a simple
    chunk or across chunks. (What is added and isn't simple lies in no simple chunk.)"""
    added = [t["content"] for t in spec.get("added_tokens") or []]
    apart = all(t and not re.search(r"[ \n]", t) and not re.match(SIMPLE, t) for t in added)
    return spec["model"].get("type") == "BPE" and apart and all(spec.get(k) == v for k, v in BY_CHUNKS.items())


class Encoder:
    """Ids of whole texts by a tokenizers file.

    Where its rules are BY_CHUNKS, white space separates pre-tokens and is dropped, so a text's
    ids are those of its chunks between spaces and line feeds. Each distinct chunk of the texts
    in hand is looked up once, and ids of its words are remembered. By other rules each text is
    encoded as a whole."""

    def __init__(self, spec: str):
        os.environ["TOKENIZERS_PARALLELISM"] = "false"
        from tokenizers import Tokenizer

        self._tokenizer = Tokenizer.from_str(spec)
        self._by_chunks = by_chunks(json.loads(spec))
        vocabulary = self._tokenizer.get_vocab(True)
        self.dtype = np.dtype("<u2" if max(vocabulary.values()) < 2**16 else "<u4")
        self._spelling = alphabet()
        self._words: dict[str, bytes] = {}

    def _encode(self, text: str) -> bytes:
        return np.array(self._tokenizer.encode(text, add_special_tokens=False).ids, self.dtype).tobytes()

    def _word(self, word: str) -> bytes:
        """A word is one pre-token in its final form, so the merges alone are run."""
        spelled = word if word.isascii() else word.encode().decode("latin-1").translate(self._spelling)
        return b"".join([t.id.to_bytes(self.dtype.itemsize, "little") for t in self._tokenizer.model.tokenize(spelled)])

    def _lists(self, ids: list[bytes]) -> pa.ListArray:
        width = self.dtype.itemsize
        ends = np.cumsum([0, *(len(x) // width for x in ids)])
        return pa.ListArray.from_arrays(pa.array(ends, pa.int32()), pa.array(np.frombuffer(b"".join(ids), self.dtype)))

    def _chunk_ids(self, chunks: pa.StringArray) -> pa.ListArray:
        """The ids of each of distinct chunks: those of its letters, then those of its marks."""
        simple = pc.extract_regex(chunks, SIMPLE)
        odd = pc.is_null(simple)
        letters, marks = (pc.fill_null(pc.struct_field(simple, k), "") for k in ("letters", "marks"))
        words = pa.concat_arrays([pc.utf8_lower(letters), marks]).dictionary_encode()
        known = self._words
        found = {w: known.get(w) for w in words.dictionary.to_pylist()}
        new = [w for w, ids in found.items() if ids is None]
        found.update({w: self._word(w) for w in new})
        if len(known) + len(new) > REMEMBERED:
            known.clear()
            new = found
        known.update({w: found[w] for w in new})
        others = [self._encode(c) for c in chunks.filter(odd).to_pylist()]
        table = self._lists([*found.values(), *others])
        at = words.indices.to_numpy().reshape(2, -1).copy()
        at[0, odd.to_numpy(zero_copy_only=False)] = len(found) + np.arange(len(others))
        both = table.take(pa.array(at.T.ravel()))
        return pa.ListArray.from_arrays(both.offsets.take(pa.array(np.arange(0, len(both) + 1, 2))), both.values)

    def encode(self, texts: list[str]) -> list[bytes]:
        if not self._by_chunks:
            return [self._encode(t) for t in texts]
        chunks = pc.split_pattern(pc.replace_substring(pa.array(texts, pa.string()), "\n", " "), " ")
        coded = chunks.flatten().dictionary_encode()
        ids = self._chunk_ids(coded.dictionary).take(coded.indices)
        cuts = ids.offsets.to_numpy()[chunks.offsets.to_numpy()].tolist()
        values = ids.values.to_numpy()
        return [values[a:b].tobytes() for a, b in zip(cuts, cuts[1:], strict=False)]

    def encode_all(self, texts: Iterator[str | None]) -> Iterator[bytes]:
        """In order, a part of the texts at a time."""
        held: list[str] = []
        size = 0
        for t in texts:
            held.append(t or "")
            size += len(held[-1])
            if size > AT_ONCE:
                yield from self.encode(held)
                held, size = [], 0
        yield from self.encode(held)


@lru_cache(maxsize=2)
def encoder(spec: str) -> Encoder:
    """One encoder a worker process."""
    return Encoder(spec)


def write_shard(folder: str, name: str, rows: Iterator[tuple[int | None, bytes]], dtype: np.dtype) -> list[int | None]:
    """Writes a shard; returns its keys in order. Rows must ascend by key, null keys first."""
    fs, path = file_at(folder)
    fs.create_dir(path, recursive=True)
    keys, at = [], [0]
    with fs.open_output_stream(f"{path}/{name}.ids") as out:
        for key, ids in rows:
            out.write(ids)
            keys.append(key)
            at.append(at[-1] + len(ids) // dtype.itemsize)
    nulls = sum(k is None for k in keys)
    distinct, first, count = np.unique(np.array(keys[nulls:], np.int64), return_index=True, return_counts=True)
    distinct = distinct.view(np.uint64)
    hash_ = PerfectHash.of(distinct)
    slots = hash_.slots(distinct)
    by_slot = np.argsort(slots)
    index = {"print": fingerprints(distinct)[by_slot], "row": (first + nulls)[by_slot], "rows": count[by_slot], "at": np.array(at, np.int64), "nulls": np.array(nulls), "width": np.array(dtype.itemsize)}
    held = io.BytesIO()
    np.savez(held, **index, **{f"bits_{i}": np.packbits(x) for i, x in enumerate(hash_.levels)}, sizes=np.array([len(x) for x in hash_.levels], np.int64))
    with fs.open_output_stream(f"{path}/{name}.mph") as out:
        out.write(held.getvalue())
    return keys


class Shard:
    """Keyed access to a shard's files."""

    def __init__(self, file: str):
        fs, path = file_at(file)
        with fs.open_input_stream(f"{path}.mph") as f:
            x = np.load(io.BytesIO(f.read()))
        self._ids = fs.open_input_file(f"{path}.ids")
        self.dtype = np.dtype(f"<u{int(x['width'])}")
        self._hash = PerfectHash([np.unpackbits(x[f"bits_{i}"], count=int(n)).astype(bool) for i, n in enumerate(x["sizes"])])
        self._print, self._row, self._rows, self.at, self._nulls = x["print"], x["row"], x["rows"], x["at"], int(x["nulls"])

    def rows_of(self, keys: list[int | None]) -> tuple[np.ndarray, np.ndarray]:
        """First row and number of rows of each key; no rows where the key isn't held."""
        null = np.array([k is None for k in keys], bool)
        wanted = np.array([0 if k is None else k for k in keys], np.int64).view(np.uint64)
        slots = self._hash.slots(wanted)
        found = (slots >= 0) & ~null
        found[found] = self._print[slots[found]] == fingerprints(wanted[found])
        row, rows = np.zeros(len(keys), np.int64), np.zeros(len(keys), np.int64)
        row[found], rows[found] = self._row[slots[found]], self._rows[slots[found]]
        rows[null] = self._nulls
        return row, rows

    def ids(self, row: int) -> np.ndarray:
        """The ids of one row."""
        start, end = int(self.at[row]), int(self.at[row + 1])
        raw = self._ids.read_at((end - start) * self.dtype.itemsize, start * self.dtype.itemsize)
        return np.frombuffer(raw, self.dtype)

    def close(self) -> None:
        self._ids.close()


@dataclass(frozen=True)
class TokenFiles:
    """Written shards: their folder, and a table (key, shard, file, nth) with a row for each
    document; nth counts rows of the same key within a shard."""

    folder: str
    manifest: DataFrame

    def read(self) -> DataFrame:
        """The files read back: key, shard, start (within the shard), n_tokens, ids (binary,
        little-endian uint32), by looking up each document's key in its shard's index."""

        def look_up(parts: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
            file, shard = None, None
            for part in parts:
                rows = part.to_pydict()
                names = np.array(rows["file"], object)
                cuts = [0, *(np.flatnonzero(names[1:] != names[:-1]) + 1).tolist(), len(names)] if len(names) else [0]
                for a, b in zip(cuts, cuts[1:], strict=False):
                    if rows["file"][a] != file:
                        if shard:
                            shard.close()
                        file = rows["file"][a]
                        shard = Shard(file)
                    first, n = shard.rows_of(rows["key"][a:b])
                    nth = np.array(rows["nth"][a:b])
                    if (nth >= n).any():
                        raise ValueError(f"{file}: keys that the index lacks")
                    for lo in range(0, b - a, 500):
                        got = [shard.ids(int(r)) for r in (first + nth)[lo : lo + 500]]
                        k = slice(a + lo, a + lo + len(got))
                        yield pa.RecordBatch.from_arrays([
                            pa.array(rows["key"][k], pa.int64()), pa.array(rows["shard"][k], pa.int64()),
                            pa.array(shard.at[(first + nth)[lo : lo + 500]], pa.int64()), pa.array([len(x) for x in got], pa.int64()),
                            pa.array([x.astype("<u4").tobytes() for x in got], pa.binary()),
                        ], names=["key", "shard", "start", "n_tokens", "ids"])
            if shard:
                shard.close()

        return self.manifest.mapInArrow(look_up, "key long, shard long, start long, n_tokens long, ids binary")


def write_tokens(docs: DataFrame, tokenizer_path: str, key: str = "doc_id", text: str = "text", end_id: int | None = 1, shards: int | None = None) -> TokenFiles:
    """Encodes each whole text (null: empty), appends end_id, writes shards in ascending order
    of key and returns them. Only key and text are read; other columns are ignored.

    Null keys come first and are found as key null. Rows with equal keys stay together, in the
    order of a hash of their texts, each with its own ids; one key with very many rows is
    spread over shards. A task begins another shard after SHARD_ROWS rows or SHARD_BYTES bytes,
    so that it holds no more keys, however large the table is. An empty table has no shards. A task that runs again writes files of
    a new name, and only those of the attempt that counted are in the manifest."""
    spark: SparkSession = docs.sparkSession
    folder = shared_dir(spark, "token-files")
    with open(tokenizer_path, encoding="utf-8") as f:
        spec = spark.sparkContext.broadcast(f.read())  # a fixed size: that of the vocabulary
    n = shards or int(spark.conf.get("spark.sql.shuffle.partitions"))
    rows = docs.select(F.col(key).cast("long").alias("key"), F.col(text).cast("string").alias("text"))
    order = rows.withColumn("tie", F.xxhash64("text")).repartitionByRange(n, "key", "tie").sortWithinPartitions("key", "tie")

    def write(parts: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        context = TaskContext.get()
        own = encoder(spec.value)
        end = b"" if end_id is None else np.array([end_id], own.dtype).tobytes()

        def encoded() -> Iterator[tuple[int | None, bytes]]:
            for part in parts:
                keys = part.column("key").to_pylist()
                for k, ids in zip(keys, own.encode_all(x.as_py() for x in part.column("text")), strict=True):
                    yield k, ids + end

        rows, nth = encoded(), 0
        while (first := next(rows, None)) is not None:
            shard, name = (context.partitionId() << 24) + nth, f"{context.partitionId():06d}-{nth:06d}-{context.taskAttemptId()}"
            nth += 1
            keys = write_shard(folder, name, _some(first, rows), own.dtype)
            places = []
            for i, k in enumerate(keys):
                places.append(places[-1] + 1 if i and k == keys[i - 1] else 0)
            for lo in range(0, len(keys), 10_000):
                k = keys[lo : lo + 10_000]
                yield pa.RecordBatch.from_arrays([pa.array(k, pa.int64()), pa.array([shard] * len(k), pa.int64()), pa.array([f"{folder}/{name}"] * len(k)), pa.array(places[lo : lo + len(k)], pa.int32())], names=["key", "shard", "file", "nth"])

    return TokenFiles(folder, saved(order.drop("tie").mapInArrow(write, MANIFEST), "token-manifest"))


def _some(first: tuple[int | None, bytes], rest: Iterator[tuple[int | None, bytes]]) -> Iterator[tuple[int | None, bytes]]:
    """The rows of one shard."""
    yield first
    size = len(first[1])
    for row in islice(rest, SHARD_ROWS - 1):
        yield row
        size += len(row[1])
        if size >= SHARD_BYTES:
            return
