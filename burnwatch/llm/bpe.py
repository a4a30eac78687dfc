"""Byte-level BPE encoding and decoding by a two-tier lookup.

Tier one is a minimal perfect hash over the vocabulary: a pre-token that is a vocabulary entry is resolved by one probe.
Tier two merges the bytes of a miss on a linked list, taking the lowest rank from a heap, the leftmost on ties; what two neighbours become is
looked up by their ids.
A vocabulary is a constant of the model (tens of thousands of entries), so it is read on the driver and broadcast.
"""

from __future__ import annotations

import base64
import heapq
import re
import struct
import uuid
from collections.abc import Iterator
from dataclasses import dataclass, field

import numpy as np
import pyarrow as pa
import regex
import xxhash
from pyspark.sql import DataFrame
from pyspark.sql import types as T

from burnwatch.llm.worker_memory import kept

# Texts of these characters alone split alike under `re`, which is faster: there no number is other than a decimal
# digit, and white space is the same for both libraries.
PLAIN = re.compile(r"[\x00-\x1b\x20-\xa0\xa1-\xb1\xb4-\xb8\xba\xbb\xbf-ɏ]*\Z")
PLAIN_PATTERN = re.compile(r"'s|'t|'re|'ve|'m|'ll|'d| ?[^\W\d_]+| ?\d+| ?(?:[^\s\w]|_)+|\s+(?!\S)|\s+")
# Fixed value: the pre-token pattern for which PLAIN_PATTERN is an equal form on plain texts.
FAST_FOR = r"'s|'t|'re|'ve|'m|'ll|'d| ?\p{L}+| ?\p{N}+| ?[^\s\p{L}\p{N}]+|\s+(?!\S)|\s+"
#: Pre-tokens remembered in a task before the older half goes.
MEMO = 400_000
#: Bytes of ids gathered before a batch is handed on.
FLUSH = 1_000_000


@dataclass
class PerfectHash:
    """Minimal perfect hash: a first hash picks a bucket, the bucket's displacement sends its keys to free slots."""

    displacements: list[int]
    slots: list[int]

    @staticmethod
    def build(keys: list[bytes]) -> PerfectHash:
        n = len(keys)
        buckets: list[list[int]] = [[] for _ in range(max(1, n // 3))]
        hashes = [xxhash.xxh3_64_intdigest(key) for key in keys]
        for i, h in enumerate(hashes):
            buckets[h % len(buckets)].append(i)
        displacements, slots = [0] * len(buckets), [-1] * n
        for b in sorted(range(len(buckets)), key=lambda b: -len(buckets[b])):
            if not buckets[b]:
                break
            d = 0
            while True:
                places = [PerfectHash.place(hashes[i], d, n) for i in buckets[b]]
                if len(set(places)) == len(places) and all(slots[p] < 0 for p in places):
                    break
                d += 1
            displacements[b] = d
            for i, p in zip(buckets[b], places, strict=True):
                slots[p] = i
        return PerfectHash(displacements, slots)

    @staticmethod
    def place(h: int, d: int, n: int) -> int:
        mixed = ((h ^ (d * 0x9E3779B97F4A7C15)) * 0xD6E8FEB86659FD93) & 0xFFFFFFFFFFFFFFFF
        return (mixed ^ (mixed >> 32)) % n

    def __call__(self, key: bytes) -> int:
        """The only entry that can equal the key; the caller compares."""
        h = xxhash.xxh3_64_intdigest(key)
        d = self.displacements[h % len(self.displacements)]
        return self.slots[self.place(h, d, len(self.slots))]


@dataclass
class Vocabulary:
    """Tokens with their ids, found through the perfect hash."""

    tokens: list[bytes]
    ids: list[int]
    pattern: str
    find: PerfectHash
    by_id: dict[int, bytes] = field(default_factory=dict)
    bytes_: list[int] = field(default_factory=list)
    pairs: dict[int, int] = field(default_factory=dict)

    @staticmethod
    def read(path: str, pattern: str) -> Vocabulary:
        """From a file of lines `base64 rank`."""
        with open(path, "rb") as lines:
            pairs = [(base64.b64decode(token), int(rank)) for token, rank in (x.split() for x in lines if x.strip())]
        tokens, ids = [p[0] for p in pairs], [p[1] for p in pairs]
        if any(not 0 <= n < 2**20 for n in ids):
            raise ValueError(f"{path}: ids of 2^20 and more do not fit the table of pairs")
        out = Vocabulary(tokens, ids, pattern, PerfectHash.build(tokens), dict(zip(ids, tokens, strict=True)))
        out.bytes_ = [out.rank(bytes([b])) for b in range(256)]
        if None in out.bytes_:
            raise ValueError(f"{path} has no entry for some single byte")
        out.pairs = out.joined()
        return out

    def rank(self, piece: bytes) -> int | None:
        i = self.find(piece)
        return self.ids[i] if self.tokens[i] == piece else None

    def joined(self) -> dict[int, int]:
        """The id that two adjacent ids become, for all pairs of tokens whose bytes together are a token."""
        numbers = dict(zip(self.tokens, self.ids, strict=True))
        out = {}
        for token, number in numbers.items():
            for cut in range(1, len(token)):
                left, right = numbers.get(token[:cut]), numbers.get(token[cut:])
                if left is not None and right is not None:
                    out[left << 20 | right] = number
        return out

    def merge(self, piece: bytes) -> list[int]:
        """Ids of a piece that is no entry itself: pairs of the lowest rank join first, the leftmost on ties."""
        n, join, pop, push = len(piece), self.pairs.get, heapq.heappop, heapq.heappush
        ids = [self.bytes_[b] for b in piece]  # -1 once joined to what stands before
        after, before = list(range(1, n + 1)), list(range(-1, n - 1))
        # An entry of the heap is rank * n + place of the left part.
        found = map(join, [x << 20 | y for x, y in zip(ids, ids[1:], strict=False)])
        heap = [rank * n + i for i, rank in enumerate(found) if rank is not None]
        heapq.heapify(heap)
        while heap:
            rank, i = divmod(pop(heap), n)
            j, left = after[i], ids[i]
            if left < 0 or j >= n or join(left << 20 | ids[j]) != rank:
                continue  # one of the two has changed since
            ids[i], ids[j] = rank, -1
            k = after[i] = after[j]
            if k < n:
                before[k] = i
                next_rank = join(rank << 20 | ids[k])
                if next_rank is not None:
                    push(heap, next_rank * n + i)
            k = before[i]
            if k >= 0:
                next_rank = join(ids[k] << 20 | rank)
                if next_rank is not None:
                    push(heap, next_rank * n + k)
        return [x for x in ids if x >= 0]

    def encode(self, piece: str) -> list[int]:
        """Ids of a pre-token; a lone surrogate counts as U+FFFD."""
        raw = piece.encode("utf-8", "replace")
        whole = self.rank(raw)
        return [whole] if whole is not None else self.merge(raw)


class Memo(dict):
    """Ids by pre-token as packed 32-bit numbers, of bounded size: when full, what was not asked for since it was last full goes.

    Packed ids take a third of the room of lists, and those of a whole text are joined in one step.
    """

    def __init__(self, vocabulary: Vocabulary) -> None:
        super().__init__()
        self.vocabulary = vocabulary
        self.older: dict[str, bytes] = {}

    def __missing__(self, piece: str) -> bytes:
        ids = self.older.get(piece)
        if ids is None:
            found = self.vocabulary.encode(piece)
            ids = struct.pack(f"={len(found)}i", *found)
            if len(piece) > 64:
                return ids
        if len(self) >= MEMO // 2:
            self.older = dict(self)
            self.clear()
        self[piece] = ids
        return ids


def _rows(batch: pa.RecordBatch, column: pa.Array, name: str, start: int, stop: int) -> pa.RecordBatch:
    """The rows from start to stop with the column appended, in place of one of the same name."""
    kept = [i for i, n in enumerate(batch.schema.names) if n != name]
    return pa.RecordBatch.from_arrays(
        [*(batch.column(i).slice(start, stop - start) for i in kept), column],
        names=[*(batch.schema.names[i] for i in kept), name],
    )


def _schema(df: DataFrame, name: str, dtype: T.DataType) -> T.StructType:
    return T.StructType([*(f for f in df.schema.fields if f.name != name), T.StructField(name, dtype)])


class _Encoder:
    """Packed ids of whole texts."""

    def __init__(self, number: int, vocabulary: Vocabulary) -> None:
        self.memo, self.slow = kept(("bpe", number), lambda: Memo(vocabulary)), regex.compile(vocabulary.pattern)
        self.plain = vocabulary.pattern == FAST_FOR

    def __call__(self, text: str) -> bytes:
        split = PLAIN_PATTERN if self.plain and PLAIN.match(text) else self.slow
        return b"".join(map(self.memo.__getitem__, split.findall(text)))


def _id_lists(packed: list[bytes]) -> pa.Array:
    """Arrow lists over packed ids, without a Python object for each."""
    ends = np.cumsum([0, *(len(x) // 4 for x in packed)])
    return pa.ListArray.from_arrays(pa.array(ends, pa.int32()), pa.array(np.frombuffer(b"".join(packed), np.int32)))


def encode(df: DataFrame, vocabulary: Vocabulary, text: str = "text", ids: str = "ids") -> DataFrame:
    """The frame with an array of token ids of each whole text.

    Null and empty texts have an empty array; repeated rows stay; a column named like `ids` is replaced; texts may be
    of any length (the ids of one text are in memory at a time, and batches are handed on by size).
    """
    shared = df.sparkSession.sparkContext.broadcast(vocabulary)
    number = uuid.uuid4().int

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        encoder = _Encoder(number, shared.value)
        for batch in batches:
            column = batch.column(batch.schema.names.index(text))
            start, size, out = 0, 0, []
            for i in range(len(column)):
                out.append(encoder(column[i].as_py() or ""))
                size += len(out[-1])
                if size >= FLUSH or i + 1 == len(column):
                    yield _rows(batch, _id_lists(out), ids, start, i + 1)
                    start, size, out = i + 1, 0, []

    return df.mapInArrow(run, _schema(df, ids, T.ArrayType(T.IntegerType(), False)))


def round_trip(df: DataFrame, vocabulary: Vocabulary, text: str = "text", ids: str = "ids", decoded: str = "decoded") -> DataFrame:
    """The frame without its texts, with the token ids of each and the bytes that those ids decode to.

    What `encode` and then `decode` give, by one Python worker a core and one way of the rows instead of two. The bytes are made from the ids alone. Null and empty texts
    have no ids and empty bytes; columns named like `ids` or `decoded` are replaced; other columns stay.
    """
    shared = df.sparkSession.sparkContext.broadcast(vocabulary)
    number = uuid.uuid4().int
    kept = [f for f in df.schema.fields if f.name not in (text, ids, decoded)]

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        vocab = shared.value
        encoder, token = _Encoder(number, vocab), vocab.by_id.__getitem__
        names = [f.name for f in kept]
        for batch in batches:
            column = batch.column(batch.schema.names.index(text))
            others = [batch.column(batch.schema.names.index(n)) for n in names]
            start, size, packed, out = 0, 0, [], []
            for i in range(len(column)):
                packed.append(encoder(column[i].as_py() or ""))
                out.append(b"".join(map(token, memoryview(packed[-1]).cast("i"))))
                size += len(packed[-1])
                if size >= FLUSH or i + 1 == len(column):
                    arrays = [*(c.slice(start, i + 1 - start) for c in others), _id_lists(packed), pa.array(out, pa.binary())]
                    yield pa.RecordBatch.from_arrays(arrays, names=[*names, ids, decoded])
                    start, size, packed, out = i + 1, 0, [], []

    fields = [*kept, T.StructField(ids, T.ArrayType(T.IntegerType(), False)), T.StructField(decoded, T.BinaryType())]
    return df.mapInArrow(run, T.StructType(fields))


def decode(df: DataFrame, vocabulary: Vocabulary, ids: str = "ids", decoded: str = "decoded") -> DataFrame:
    """The frame with the bytes that each array of ids stands for.

    A null array gives empty bytes; an id outside the vocabulary fails, naming the id; a column named like `decoded` is replaced.
    """
    shared = df.sparkSession.sparkContext.broadcast(vocabulary)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        by_id = shared.value.by_id
        for batch in batches:
            column = batch.column(batch.schema.names.index(ids))
            start, size, out = 0, 0, []
            for i in range(len(column)):
                found = column[i]
                numbers = found.values.to_numpy(zero_copy_only=False).tolist() if found.is_valid else []
                out.append(b"".join(map(by_id.__getitem__, numbers)))
                size += len(out[-1])
                if size >= 2 * FLUSH or i + 1 == len(column):
                    yield _rows(batch, pa.array(out, pa.binary()), decoded, start, i + 1)
                    start, size, out = i + 1, 0, []

    return df.mapInArrow(run, _schema(df, decoded, T.BinaryType()))
