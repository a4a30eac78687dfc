"""Ranked lexical search by norm buckets.

Every document is a vector of integer impacts over the terms that the items ask for, every item a vector of integer weights, and a score their
inner product. Vectors are ordered by length and cut into buckets. An item skips a bucket whose longest vector, times the item's own length, stays under the
item's k-th score so far (Cauchy-Schwarz). Inside a bucket the item's heaviest coordinates are multiplied exactly and the rest is bounded by the lengths
that are left; what may still reach the k-th score is scored again in integers.

A first search over one document in `SHARE` gives each item a score that its k-th result reaches at least; the search over all documents starts from it. Items are taken in
blocks of a bounded number of terms, each against all documents, so that what is sent to the workers is bounded whatever the number of items.
"""

from __future__ import annotations

import math
from collections import Counter
from collections.abc import Iterator
from dataclasses import dataclass
from functools import reduce

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F
from pyspark.sql import types as T

from burnwatch.llm.staging import drop_staged, staged

#: Terms of the items of a block, about; an item with more has a block of its own size.
BLOCK_TERMS = 500_000
#: Documents of a bucket, and the share of all that is searched first.
BUCKET, SHARE = 1024, 16
#: Part of an item's squared length that its heaviest coordinates hold.
FOCUS = 0.8
#: Covers the rounding of bounds in doubles.
SLACK = 1 + 1e-9

#: Bytes to themselves where they belong to a term, A-Z to a-z, others to a space; bytes from 0x80 are parts of characters beyond ASCII.
_TERM_BYTES = bytes(
    b + 32 if 0x41 <= b <= 0x5A else b if 0x30 <= b <= 0x39 or 0x61 <= b <= 0x7A or b >= 0x80 else 0x20 for b in range(256)
)


def terms(text: str | None) -> list[bytes]:
    """ASCII letters and digits and all characters beyond ASCII form terms; only A-Z are lower-cased."""
    return (text or "").encode("utf-8", "replace").translate(_TERM_BYTES).split()


def _lists(values: np.ndarray, sizes: np.ndarray) -> pa.Array:
    return pa.ListArray.from_arrays(pa.array(np.concatenate([[0], np.cumsum(sizes)]), pa.int32()), pa.array(values))


@dataclass
class Items:
    """Items of a block: entries lie item by item, the heaviest weight first."""

    ids: list
    starts: np.ndarray
    term: np.ndarray
    weight: np.ndarray
    length: np.ndarray
    focus: np.ndarray  # entries of the item that are multiplied exactly
    rest: np.ndarray  # length of the others

    @staticmethod
    def of(ids: list, counts: list[dict[int, int]], weights: np.ndarray) -> Items:
        starts, term, weight, focus, rest, length = [0], [], [], [], [], []
        for held in counts:
            t = np.fromiter(held.keys(), np.int64, len(held))
            w = weights[t] * np.fromiter(held.values(), np.int64, len(held))
            order = np.lexsort((t, -w))
            t, w = t[order], w[order]
            left = np.concatenate([np.cumsum((w.astype(float) ** 2)[::-1])[::-1], [0.0]])
            n = int(np.argmax(left <= (1 - FOCUS) * left[0]))
            term.append(t)
            weight.append(w)
            starts.append(starts[-1] + len(t))
            focus.append(n)
            rest.append(math.sqrt(left[n]))
            length.append(math.sqrt(left[0]))
        flat = [np.concatenate(x) if x else np.empty(0, np.int64) for x in (term, weight)]
        return Items(ids, np.array(starts), *flat, np.array(length), np.array(focus, int), np.array(rest))


class Best:
    """The k best documents of each item so far, and the score that a further one must reach."""

    def __init__(self, items: Items, floor: np.ndarray, k: int) -> None:
        self.items, self.k = items, k
        self.floor = np.maximum(floor, 1)
        self.found: dict[int, tuple[np.ndarray, np.ndarray]] = {}

    def search(self, ids: np.ndarray, starts: np.ndarray, term: np.ndarray, impact: np.ndarray, norm: np.ndarray) -> None:
        """A bucket: rows of (term, impact) with the length of each."""
        items, n = self.items, len(ids)
        active = np.flatnonzero(items.length * (norm.max(initial=0.0) * SLACK) >= self.floor)
        if not len(active) or not len(term):
            return
        doc = np.repeat(np.arange(n), np.diff(starts))
        by_term = np.argsort(term, kind="stable")
        held, first = np.unique(term[by_term], return_index=True)
        last = np.append(first[1:], len(term))
        wide = np.zeros(int(max(held[-1], items.term.max(initial=0))) + 1, np.int64)
        place = np.full(len(wide), -1)
        place[held] = np.arange(len(held))
        values = impact.astype(float)
        for i in active.tolist():
            at, stop = items.starts[i], items.starts[i + 1]
            focus = slice(at, at + items.focus[i])
            found = place[items.term[focus]]
            product, square = np.zeros(n), np.zeros(n)
            for p, w in zip(found.tolist(), items.weight[focus].tolist(), strict=True):
                if p >= 0:
                    rows = by_term[first[p] : last[p]]
                    v, d = values[rows], doc[rows]  # a document holds a term once
                    product[d] += w * v
                    square[d] += v * v
            bound = product + items.rest[i] * np.sqrt(np.maximum(norm * norm * SLACK - square, 0))
            alive = np.flatnonzero(bound * SLACK >= self.floor[i])
            if not len(alive):
                continue
            sizes = starts[alive + 1] - starts[alive]
            ends = np.cumsum(sizes)
            entries = np.repeat(starts[alive] - (ends - sizes), sizes) + np.arange(ends[-1])
            wide[items.term[at:stop]] = items.weight[at:stop]
            sums = np.concatenate([[0], np.cumsum(wide[term[entries]] * impact[entries])])
            wide[items.term[at:stop]] = 0
            score = sums[ends] - sums[ends - sizes]
            enough = score >= self.floor[i]
            if enough.any():
                self._take(i, ids[alive[enough]], score[enough])

    def _take(self, i: int, ids: np.ndarray, score: np.ndarray) -> None:
        if i in self.found:
            ids, score = np.concatenate([self.found[i][0], ids]), np.concatenate([self.found[i][1], score])
        order = np.lexsort((ids, -score))[: self.k]
        self.found[i] = ids[order], score[order]
        if len(order) == self.k:
            self.floor[i] = max(self.floor[i], score[order[-1]])

    def rows(self, schema: T.StructType) -> Iterator[pa.RecordBatch]:
        if self.found:
            sizes = [len(ids) for ids, _ in self.found.values()]
            items = [self.items.ids[i] for i, size in zip(self.found, sizes, strict=True) for _ in range(size)]
            ids, score = (np.concatenate(x) for x in zip(*self.found.values(), strict=True))
            yield pa.RecordBatch.from_arrays([pa.array(items), pa.array(ids), pa.array(score)], names=schema.names)


def _counted(docs: DataFrame, vocabulary: dict[bytes, int]) -> DataFrame:
    """Of each document with a term: n, and the terms of the vocabulary with their numbers of occurrences."""
    shared = docs.sparkSession.sparkContext.broadcast(vocabulary)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        number = shared.value.get
        for batch in batches:
            keep, lengths, sizes, term, tf = [], [], [], [], []
            for row, text in enumerate(batch.column(1)):
                words = terms(text.as_py())
                if words:
                    held = Counter(map(number, words))
                    held.pop(None, None)
                    keep.append(row)
                    lengths.append(len(words))
                    sizes.append(len(held))
                    term += held.keys()
                    tf += held.values()
            yield pa.RecordBatch.from_arrays(
                [
                    batch.column(0).take(pa.array(keep, pa.int64())),
                    pa.array(lengths, pa.int64()),
                    _lists(np.array(term, np.int32), np.array(sizes, int)),
                    _lists(np.array(tf, np.int32), np.array(sizes, int)),
                ],
                names=["doc_id", "n", "term", "tf"],
            )

    return docs.select("doc_id", "text").mapInArrow(run, "doc_id long, n long, term array<int>, tf array<int>")


def _impacts(counted: DataFrame, n_docs: int, n_terms: int) -> DataFrame:
    """The impact of each term of each document, and the length of the vector."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            ids, n, term, tf = (batch.column(c) for c in ("doc_id", "n", "term", "tf"))
            sizes = tf.value_lengths().to_numpy()
            count = tf.flatten().to_numpy().astype(np.int64)
            m = 100 - 25 + (25 * n.to_numpy() * n_docs) // n_terms
            impact = (1_000_000_000 * count) // (1000 * count + 12 * np.repeat(m, sizes))
            squares = np.concatenate([[0.0], np.cumsum(impact.astype(float) ** 2)])
            ends = np.cumsum(sizes)
            # The running sum rounds; its error is covered from above.
            norm = np.sqrt(squares[ends] - squares[ends - sizes] + squares[-1] * 1e-12)
            yield pa.RecordBatch.from_arrays(
                [ids, term, _lists(impact.astype(np.int32), sizes), pa.array(norm)], names=["doc_id", "term", "impact", "norm"]
            )

    return counted.mapInArrow(run, "doc_id long, term array<int>, impact array<int>, norm double")


def _searched(vectors: DataFrame, items: Items, floor: np.ndarray, k: int, item_type: T.DataType) -> DataFrame:
    """The k best rows of each item in each task, those under the item's floor left out."""
    shared = vectors.sparkSession.sparkContext.broadcast((items, floor))
    schema = T.StructType([T.StructField("item_id", item_type), T.StructField("doc_id", T.LongType()), T.StructField("score", T.LongType())])

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        best = Best(*shared.value, k)
        for batch in batches:
            for start in range(0, batch.num_rows, BUCKET):
                part = batch.slice(start, BUCKET)
                sizes = part.column("term").value_lengths().to_numpy()
                best.search(
                    part.column("doc_id").to_numpy(),
                    np.concatenate([[0], np.cumsum(sizes)]),
                    part.column("term").flatten().to_numpy().astype(np.int64),
                    part.column("impact").flatten().to_numpy().astype(np.int64),
                    part.column("norm").to_numpy(),
                )
        yield from best.rows(schema)

    found = vectors.select("doc_id", "term", "impact", "norm").mapInArrow(run, schema)
    rank = F.row_number().over(Window.partitionBy("item_id").orderBy(F.desc("score"), "doc_id"))
    return found.withColumn("rank", rank).where(F.col("rank") <= k).select("item_id", "rank", "doc_id", "score")


def _asked(items: DataFrame) -> DataFrame:
    """Terms of each item with their numbers of occurrences; of several rows of one id the least text asks."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            held = [Counter(terms(x)) for x in batch.column("text").to_pylist()]
            sizes = [len(x) for x in held]
            words = pa.array([t for x in held for t in x], pa.binary())
            times = [n for x in held for n in x.values()]
            offsets = pa.array(np.concatenate([[0], np.cumsum(sizes)]), pa.int32())
            lists = [pa.ListArray.from_arrays(offsets, words), pa.ListArray.from_arrays(offsets, pa.array(times, pa.int64()))]
            yield pa.RecordBatch.from_arrays([batch.column("item_id"), *lists], names=["item_id", "term", "times"])

    fields = [items.schema["item_id"], T.StructField("term", T.ArrayType(T.BinaryType())), T.StructField("times", T.ArrayType(T.LongType()))]
    return items.groupBy("item_id").agg(F.min("text").alias("text")).mapInArrow(run, T.StructType(fields)).where("size(term) > 0")


def rank(docs: DataFrame, items: DataFrame, k: int = 20) -> DataFrame:
    """Of each row of items (item_id, text) its k best documents (doc_id, text) with a score above 0: item_id, rank from 1, doc_id, score.

    A score sums, over the item's terms with repeats, w * ((10^9 tf) div (1000 tf + 12 m)); w is floor(1000 ln((2N+2)/(2df+1))), and m grows with the length
    of the document from 75. Equal scores go to the smaller doc_id. Null, empty and blank texts have no terms: such documents are not counted in N,
    such items have no rows. Documents without a doc_id count in the statistics and are not ranked; repeated rows count and rank each. Texts may be of any
    length; one text and its terms are in memory at a time. Other columns are ignored.
    """
    docs = docs.select(F.col("doc_id").cast("long").alias("doc_id"), "text")
    asked = staged(_asked(items.select("item_id", "text")))
    total = asked.agg(F.sum(F.size("term"))).first()[0] or 0
    n_blocks = max(1, math.ceil(total / BLOCK_TERMS))
    block = F.pmod(F.xxhash64("item_id"), F.lit(n_blocks))
    found = [_ranked(docs, asked.where(block == i), k) for i in range(n_blocks)]
    return reduce(DataFrame.unionByName, found)


def _ranked(docs: DataFrame, asked: DataFrame, k: int) -> DataFrame:
    """The same for one block of items."""
    rows = asked.collect()  # a block of bounded size
    vocabulary: dict[bytes, int] = {}
    counts = [{vocabulary.setdefault(bytes(t), len(vocabulary)): n for t, n in zip(r["term"], r["times"], strict=True)} for r in rows]
    counted = staged(_counted(docs, vocabulary))
    n_docs, n_terms = counted.agg(F.count("*"), F.coalesce(F.sum("n"), F.lit(0))).first()
    df = np.zeros(len(vocabulary), np.int64)
    for term, held in counted.select(F.explode("term").alias("term")).groupBy("term").count().collect():
        df[term] = held
    weights = np.array([math.floor(1000 * math.log((2 * n_docs + 2) / (2 * x + 1))) for x in df.tolist()], np.int64)
    block = Items.of([r["item_id"] for r in rows], counts, weights)

    vectors = _impacts(counted.where("doc_id IS NOT NULL AND size(term) > 0"), n_docs, n_terms)
    # Equal lengths, as copies have, are dealt out by id.
    by_length = staged(vectors.repartitionByRange(F.desc("norm"), F.xxhash64("doc_id")).sortWithinPartitions(F.desc("norm")))
    drop_staged(counted)
    item_type = asked.schema["item_id"].dataType
    floor = np.zeros(len(rows), np.int64)
    sample = by_length.where(F.pmod(F.xxhash64("doc_id", F.lit("first")), F.lit(SHARE)) == 0)
    place = {r["item_id"]: i for i, r in enumerate(rows)}
    for item, score in _searched(sample, block, floor, k, item_type).where(F.col("rank") == k).select("item_id", "score").collect():
        floor[place[item]] = score
    return _searched(by_length, block, floor, k, item_type)
