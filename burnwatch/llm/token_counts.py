"""Token counts of a byte-level BPE by rank-synchronous array merging.

The pre-tokens of a batch that were not counted before lie end to end in one array of symbols. In each round every sequence finds the lowest rank
among its neighbouring pairs and joins all places of that pair at once; sequences without such a pair leave. What is left of a sequence is its
count. This equals joining one pair at a time, because a symbol is made by one merge only and stands in later merges only; `Merges` refuses a
file for which that does not hold.

The merges are a constant of the model (tens of thousands), read on the driver and sent to each worker once.
"""

from __future__ import annotations

import heapq
import json
import unicodedata
import uuid
from collections.abc import Iterable, Iterator
from dataclasses import dataclass
from itertools import batched

import numpy as np
import pyarrow as pa
import regex
from pyspark.sql import DataFrame
from pyspark.sql import types as T

from burnwatch.llm.bpe import PLAIN, PLAIN_PATTERN

#: Stands for "these two do not join"; larger than any symbol.
NONE = np.int64(2**62)
#: Bytes from which a sequence is merged by itself, by lists of places.
LONG = 2048
#: Bytes merged in one set of arrays, pre-tokens taken from a text at a time, and pre-tokens remembered.
TOGETHER, AT_A_TIME, MEMO = 1 << 20, 1 << 20, 400_000


def byte_letters() -> dict[str, int]:
    """The letter that stands for each byte in the file: itself where printable, else the next free one from U+0100."""
    own = [b for b in range(256) if 0x21 <= b <= 0x7E or 0xA1 <= b <= 0xAC or 0xAE <= b]
    others = (b for b in range(256) if b not in own)
    return {chr(b): b for b in own} | {chr(256 + i): b for i, b in enumerate(others)}


def letters_and_numbers() -> tuple[str, str]:
    r"""`\p{L}` and `\p{N}` without code points that this Python's Unicode tables do not assign: the library does not know them either."""
    unassigned = "".join(c for c in map(chr, range(0x110000)) if unicodedata.category(c) == "Cn")
    newer = [ord(c) for c in regex.findall(r"[\p{L}\p{N}]", unassigned)]
    if not newer:
        return r"\p{L}", r"\p{N}"
    cuts = [0, *(i for i in range(1, len(newer)) if newer[i] != newer[i - 1] + 1), len(newer)]
    ranges = "".join(f"\\U{newer[a]:08x}-\\U{newer[b - 1]:08x}" for a, b in zip(cuts, cuts[1:], strict=False))
    return rf"[\p{{L}}--[{ranges}]]", rf"[\p{{N}}--[{ranges}]]"


@dataclass
class Merges:
    """Symbols are the 256 bytes, then one for each merge, in order of rank."""

    pairs: np.ndarray  # left * base + right, sorted
    makes: np.ndarray  # what each becomes
    parts: np.ndarray  # left and right of each merge
    base: int
    pattern: str
    specials: list[str]

    @staticmethod
    def read(path: str) -> Merges:
        """From a tokenizer file whose model is a byte-level BPE without a normaliser; other kinds raise."""
        with open(path, encoding="utf-8") as f:
            whole = json.load(f)
        model, before = whole["model"], whole["pre_tokenizer"] or {}
        plain = (
            model["type"] == "BPE" and not whole["normalizer"] and before.get("type") == "ByteLevel" and before.get("use_regex", True)
            and not before.get("add_prefix_space") and not any(model.get(k) for k in ("dropout", "continuing_subword_prefix", "end_of_word_suffix", "ignore_merges"))
            and not any(t[k] for t in whole["added_tokens"] for k in ("single_word", "lstrip", "rstrip"))
        )
        if not plain:
            raise ValueError(f"{path} is not a plain byte-level BPE")
        number = dict(byte_letters())
        if any(letter not in model["vocab"] for letter in number):
            raise ValueError(f"{path} has no entry for some byte")
        parts = []
        for merge in model["merges"]:
            left, right = merge if isinstance(merge, list) else merge.split(" ")
            if left not in number or right not in number or left + right in number:
                raise ValueError(f"{path}: {left!r} and {right!r} join before their parts are made, or make what another merge makes")
            parts.append((number[left], number[right]))
            number[left + right] = 256 + len(parts) - 1
        table = np.array(parts, np.int64).reshape(-1, 2)
        base = 256 + len(parts)
        pairs = table[:, 0] * base + table[:, 1]
        order = np.argsort(pairs)
        letter, digit = letters_and_numbers()
        pattern = rf"'s|'t|'re|'ve|'m|'ll|'d| ?{letter}+| ?{digit}+| ?[^\s{letter}{digit}]+|\s+(?!\S)|\s+"
        specials = sorted((t["content"] for t in whole["added_tokens"]), key=len, reverse=True)
        return Merges(pairs[order], order + 256, table, base, pattern, specials)

    def joined(self, left: np.ndarray, right: np.ndarray) -> np.ndarray:
        """What each pair becomes, or NONE."""
        if not len(self.pairs):
            return np.full(len(left), NONE)
        wanted = left * self.base + right
        at = np.minimum(np.searchsorted(self.pairs, wanted), len(self.pairs) - 1)
        return np.where(self.pairs[at] == wanted, self.makes[at], NONE)

    def left_of(self, sequences: list[bytes]) -> np.ndarray:
        """How many symbols are left of each sequence; none may be empty."""
        left = np.fromiter(map(len, sequences), np.int64, len(sequences))
        owner = np.repeat(np.arange(len(sequences)), left)
        symbols = np.frombuffer(b"".join(sequences), np.uint8).astype(np.int64)
        makes = np.full(len(symbols), NONE)
        inside = np.flatnonzero(owner[:-1] == owner[1:])
        makes[inside] = self.joined(symbols[inside], symbols[inside + 1])
        while len(symbols):
            starts = np.flatnonzero(np.diff(owner, prepend=-1))
            lengths = np.diff(starts, append=len(owner))
            lowest = np.repeat(np.minimum.reduceat(makes, starts), lengths)
            going = lowest < NONE
            if not going.all():
                symbols, owner, makes, lowest = symbols[going], owner[going], makes[going], lowest[going]
                if not len(symbols):
                    break
            at = _every_second(np.flatnonzero(makes == lowest))
            left -= np.bincount(owner[at], minlength=len(left))
            symbols[at] = lowest[at]
            stays = np.ones(len(symbols), bool)
            stays[at + 1] = False
            place = at - np.arange(len(at))
            symbols, owner, makes = symbols[stays], owner[stays], makes[stays]
            changed = np.concatenate([place, place[place > 0] - 1])
            last = (changed + 1 >= len(owner)) | (owner[changed] != owner[np.minimum(changed + 1, len(owner) - 1)])
            makes[changed[last]] = NONE
            changed = changed[~last]
            makes[changed] = self.joined(symbols[changed], symbols[changed + 1])
        return left

    def left_of_long(self, sequence: bytes) -> int:
        """The same for one long sequence: the places of each rank wait in lists, so that a round costs what it joins, not the sequence."""
        n = len(sequence)
        symbols = np.frombuffer(sequence, np.uint8).astype(np.int64)
        after, before, left = np.arange(1, n + 1), np.arange(-1, n - 1), n
        waiting: dict[int, list[np.ndarray]] = {}
        ranks: list[int] = []

        def offer(at: np.ndarray) -> None:
            at = at[(at >= 0) & (after[at] < n)]
            makes = self.joined(symbols[at], symbols[after[at]])
            found = makes < NONE
            at, makes = at[found], makes[found]
            order = np.argsort(makes, kind="stable")
            at, makes = at[order], makes[order]
            starts = np.flatnonzero(np.diff(makes, prepend=-1))
            for start, stop in zip(starts.tolist(), [*starts[1:].tolist(), len(at)], strict=False):
                made = int(makes[start])
                if made not in waiting:
                    heapq.heappush(ranks, made)
                waiting.setdefault(made, []).append(at[start:stop])

        offer(np.arange(n - 1))
        while ranks:
            makes = heapq.heappop(ranks)
            a, b = self.parts[makes - 256]
            at = np.unique(np.concatenate(waiting.pop(makes)))
            at = at[(symbols[at] == a) & (after[at] < n)]
            at = at[symbols[after[at]] == b]
            if a == b and len(at):
                # A run is a chain of neighbours; places that were joined away hold no symbol.
                index = np.searchsorted(at, after[at])
                chained = np.zeros(len(at) + 1, bool)
                chained[1:] = (index < len(at)) & (at[np.minimum(index, len(at) - 1)] == after[at])
                opens = ~chained[:-1]
                first = np.maximum.accumulate(np.where(opens, np.arange(len(at)), 0))
                at = at[(np.arange(len(at)) - first) % 2 == 0]
            if not len(at):
                continue
            gone = after[at]
            symbols[at], symbols[gone] = makes, -1
            after[at] = after[gone]
            inner = after[at] < n
            before[after[at][inner]] = at[inner]
            left -= len(at)
            offer(np.unique(np.concatenate([at, before[at]])))
        return left

    def counts(self, pieces: Iterable[str]) -> dict[str, int]:
        """Symbols left of each distinct pre-token."""
        out: dict[str, int] = {}
        names: list[str] = []
        sequences: list[bytes] = []
        size = 0

        def merged() -> None:
            out.update(zip(names, self.left_of(sequences).tolist(), strict=True))
            names.clear()
            sequences.clear()

        for piece in pieces:
            raw = piece.encode("utf-8", "replace")
            if len(raw) >= LONG:
                out[piece] = self.left_of_long(raw)
                continue
            names.append(piece)
            sequences.append(raw)
            size += len(raw)
            if size >= TOGETHER:
                merged()
                size = 0
        if names:
            merged()
        return out


def _every_second(at: np.ndarray) -> np.ndarray:
    """Of each run of places one after another the first, third, fifth and so on."""
    opens = np.diff(at, prepend=-2) > 1
    first = at[opens][np.cumsum(opens) - 1]
    return at[(at - first) % 2 == 0]


class Counter:
    """Counts texts, remembering the counts of short pre-tokens."""

    def __init__(self, merges: Merges) -> None:
        self.merges, self.memo = merges, {}
        self.slow = regex.compile(merges.pattern, regex.V1)
        self.special = regex.compile("|".join(map(regex.escape, merges.specials))) if merges.specials else None

    def pieces(self, text: str) -> Iterator[list[str]]:
        """The pre-tokens, a bounded list at a time."""
        split = PLAIN_PATTERN if PLAIN.match(text) else self.slow
        if len(text) <= AT_A_TIME:
            yield split.findall(text)
        else:
            for found in batched(split.finditer(text), AT_A_TIME // 4):
                yield [x.group() for x in found]

    def count(self, texts: list[str]) -> list[int]:
        """Tokens of each text. A special string is one token, as the library takes it by default; what stands around it is split apart."""
        totals = [0] * len(texts)
        waiting: list[tuple[int, list[str]]] = []
        size = 0
        for row, text in enumerate(texts):
            parts = [text]
            if self.special and any(s in text for s in self.merges.specials):
                parts = self.special.split(text)
                totals[row] += len(parts) - 1
            for part in parts:
                for found in self.pieces(part) if part else ():
                    waiting.append((row, found))
                    size += len(found)
                    if size >= AT_A_TIME:
                        self._settle(waiting, totals)
                        size = 0
        self._settle(waiting, totals)
        return totals

    def _settle(self, waiting: list[tuple[int, list[str]]], totals: list[int]) -> None:
        memo = self.memo
        new = set().union(*(found for _, found in waiting)) - memo.keys()
        if len(memo) + len(new) > MEMO:
            memo.clear()
            new = set().union(*(found for _, found in waiting))
        counts = self.merges.counts(new)
        memo.update(counts)
        for row, found in waiting:
            totals[row] += sum(map(memo.__getitem__, found))
        for piece in [x for x in counts if len(x) > 64]:
            del memo[piece]
        waiting.clear()


#: The counter of this worker process, by the broadcast it belongs to; tasks that follow each other share it.
_counters: dict[int, Counter] = {}


def count_tokens(df: DataFrame, merges: Merges, text: str = "text", counts: str = "n_tokens") -> DataFrame:
    """The frame with the number of tokens of each whole text, and without the texts, which need not travel back.

    Null and empty texts have 0; repeated rows stay; a column named like `counts` is replaced; other columns stay as they are. Texts may be of any
    length: a bounded number of pre-tokens is in memory besides the text itself. Strings of special tokens count as one each.
    """
    shared = df.sparkSession.sparkContext.broadcast(merges)
    number = uuid.uuid4().int

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        if number not in _counters:
            _counters.clear()
            _counters[number] = Counter(shared.value)
        counter = _counters[number]
        for batch in batches:
            names = batch.schema.names
            found = counter.count([x or "" for x in batch.column(names.index(text)).to_pylist()])
            kept = [i for i, n in enumerate(names) if n not in (text, counts)]
            yield pa.RecordBatch.from_arrays(
                [*(batch.column(i) for i in kept), pa.array(found, pa.int64())], names=[*(names[i] for i in kept), counts]
            )

    fields = [f for f in df.schema.fields if f.name not in (text, counts)]
    return df.mapInArrow(run, T.StructType([*fields, T.StructField(counts, T.LongType())]))
