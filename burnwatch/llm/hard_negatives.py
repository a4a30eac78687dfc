"""Hard negatives by bounds along a spanning tree of anchors.

Anchors of a block are joined to a tree of short edges. Where the score of a candidate at a parent is known, or known to lie in an interval, its score at
the child lies in that interval widened by the edge's length times the candidate's. A candidate is scored exactly only where its interval meets the
window that the anchor still looks into; from there its interval starts anew.

The first pass finds each anchor's positives, the second the negatives in the windows under them. Anchors are sent to the candidates in blocks of
bounded size; candidates are read where they lie and never copied or shuffled.
"""

from __future__ import annotations

import math
from collections.abc import Callable, Iterator
from dataclasses import dataclass
from functools import reduce

import numpy as np
import pandas as pd
import pyarrow as pa
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from burnwatch.llm.staging import staged
from burnwatch.llm.vectors import usable

#: Anchors of a block, and candidates that are scored together.
ANCHORS, CANDIDATES = 2048, 4096
RESULT = "anchor_id long, positive_id long, rank int, negative_id long, positive_score long, negative_score long"


def scaled(embedding: Column, scale: int) -> Column:
    """floor(scale * x) of each component; beyond 62 bits it raises."""
    whole = lambda x: F.floor(x.cast("double") * F.lit(float(scale)))
    fits = lambda x: F.abs(x.cast("double") * F.lit(float(scale))) < F.lit(float(2**62))
    return F.transform(
        embedding, lambda x: F.when(fits(x), whole(x)).otherwise(F.raise_error(F.lit("a vector's component is too large"))).cast("long")
    )


def _matrix(rows: pa.ListArray | pd.Series, width: int, wide: bool) -> np.ndarray:
    """Rows filled up with zeros; as Python's integers where doubles would not hold the products."""
    out = np.zeros((len(rows), width), object if wide else float)
    lists = rows.to_pylist() if isinstance(rows, pa.Array) and wide else None
    if lists is None and isinstance(rows, pa.Array):
        flat, sizes = rows.flatten().to_numpy(), rows.value_lengths().to_numpy()
        row = np.repeat(np.arange(len(rows)), sizes)
        out[row, np.arange(len(flat)) - np.repeat(np.cumsum(sizes) - sizes, sizes)] = flat
        return out
    for i, values in enumerate(lists if lists is not None else rows):
        out[i, : len(values)] = [int(v) for v in values] if wide else values
    return out


def spanning_tree(points: np.ndarray) -> tuple[list[int], list[int], list[float]]:
    """Points in an order in which parents come first, the place of each one's parent in it (-1 at the root), and the length of the edge.

    Edges are those of a minimal spanning tree. The largest branch of a point comes last, so few points wait for their branches at a time.
    """
    n = len(points)
    near, parent = np.full(n, np.inf), np.full(n, -1)
    out = np.ones(n, bool)
    taken, at = [], 0
    for _ in range(n):
        out[at] = False
        taken.append(at)
        gap = np.sqrt(((points - points[at]) ** 2).sum(axis=1))
        closer = out & (gap < near)
        near[closer], parent[closer] = gap[closer], at
        if out.any():
            at = int(np.argmin(np.where(out, near, np.inf)))
    branches: list[list[int]] = [[] for _ in range(n)]
    size = [1] * n
    for i in reversed(taken[1:]):
        branches[parent[i]].append(i)
        size[parent[i]] += size[i]
    order, stack = [], taken[:1]
    while stack:
        i = stack.pop()
        order.append(i)
        stack += sorted(branches[i], key=lambda b: -size[b])
    place = {i: p for p, i in enumerate(order)}
    return order, [place.get(int(parent[i]), -1) for i in order], [float(near[i]) if parent[i] >= 0 else 0.0 for i in order]


def _trees(anchors: DataFrame, width: int) -> DataFrame:
    """Anchors of each block in the order of its tree."""

    def build(block: pd.DataFrame) -> pd.DataFrame:
        block = block.sort_values("id", ignore_index=True)
        order, parent, edge = spanning_tree(_matrix(block["v"], width, False))
        return block.iloc[order].assign(at=range(len(order)), parent=parent, edge=edge)

    return anchors.groupBy("block").applyInPandas(build, "block int, id long, label long, v array<long>, at int, parent int, edge double")


@dataclass
class Tree:
    ids: np.ndarray
    labels: np.ndarray
    points: np.ndarray
    parents: list[int]
    edges: list[float]

    def sweep(self, rows: np.ndarray, wanted: Callable[[int, np.ndarray, np.ndarray], np.ndarray], found: Callable[[int, np.ndarray, np.ndarray], None]) -> None:
        """Takes the rows past all anchors. `wanted(anchor, low, high)` tells which rows may matter; `found(anchor, rows, scores)` gets them."""
        last = {p: i for i, p in enumerate(self.parents)}
        if self.points.dtype == object:
            for i in range(len(self.ids)):
                score = rows @ self.points[i]
                at = np.flatnonzero(wanted(i, score, score))
                found(i, at, score[at])
            return
        length = np.sqrt((rows**2).sum(axis=1))
        # Covers the rounding of the ends of intervals.
        trifle = 2.0**-49 * length.max(initial=0.0) * float(np.sqrt((self.points**2).sum(axis=1)).max(initial=0.0))
        held: dict[int, tuple[np.ndarray, np.ndarray]] = {}
        for i, (parent, edge) in enumerate(zip(self.parents, self.edges, strict=True)):
            if parent < 0:
                low = rows @ self.points[i]
                high = low.copy()
            else:
                low, high = held.pop(parent) if last[parent] == i else held[parent]
                if edge > 0:
                    reach = length * (edge * (1 + 1e-12)) + trifle
                    low, high = low - reach, high + reach
                else:
                    low, high = low.copy(), high.copy()
            at = np.flatnonzero(wanted(i, low, high))
            open_ = at[low[at] < high[at]]
            if 2 * len(open_) > len(rows):
                low = rows @ self.points[i]
                high = low.copy()
                at = at[wanted(i, low, high)[at]]
            elif len(open_):
                low[open_] = high[open_] = rows[open_] @ self.points[i]
            found(i, at, low[at])
            if i in last:
                held[i] = low, high


def _best(ids: np.ndarray, scores: np.ndarray, more_ids: np.ndarray, more: np.ndarray, k: int) -> tuple[np.ndarray, np.ndarray]:
    ids, scores = np.concatenate([ids, more_ids]), np.concatenate([scores, more])
    order = np.lexsort((ids, -scores))[:k]
    return ids[order], scores[order]


def _swept(candidates: DataFrame, tree: Tree, width: int, state: Callable[[Tree], object], schema: str) -> DataFrame:
    """Rows of every task's state after its candidates were swept."""
    shared = candidates.sparkSession.sparkContext.broadcast(tree)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        tree = shared.value
        kept = state(tree)
        for batch in batches:
            for start in range(0, batch.num_rows, CANDIDATES):
                part = batch.slice(start, CANDIDATES)
                kept.ids, kept.labels = part.column("id").to_numpy(), part.column("label").to_numpy()
                tree.sweep(_matrix(part.column("v"), width, tree.points.dtype == object), kept.wanted, kept.found)
        columns = kept.rows()
        names = [x.split()[0] for x in schema.split(", ")]
        yield pa.RecordBatch.from_arrays([pa.array(c, pa.int64()) for c in columns], names=names)

    return candidates.select("id", "label", "v").mapInArrow(run, schema)


class Positives:
    """The k best other rows of each anchor's label."""

    def __init__(self, tree: Tree, k: int) -> None:
        self.tree, self.k = tree, k
        self.best: dict[int, tuple[np.ndarray, np.ndarray]] = {}
        self.floor: dict[int, float] = {}

    def wanted(self, i: int, low: np.ndarray, high: np.ndarray) -> np.ndarray:
        return (self.labels == self.tree.labels[i]) & (self.ids != self.tree.ids[i]) & (high >= self.floor.get(i, -math.inf))

    def found(self, i: int, at: np.ndarray, scores: np.ndarray) -> None:
        if not len(at):
            return
        empty = np.empty(0, np.int64), np.empty(0, scores.dtype)
        self.best[i] = ids, scores = _best(*self.best.get(i, empty), self.ids[at], scores, self.k)
        if len(ids) == self.k:
            self.floor[i] = scores[-1]

    def rows(self) -> list[list[int]]:
        each = [(int(self.tree.ids[i]), int(v), int(s)) for i, (ids, scores) in self.best.items() for v, s in zip(ids, scores, strict=True)]
        return list(zip(*each, strict=True)) or [[], [], []]


class Negatives:
    """Of each anchor and each score of a positive the k best rows of other labels within the window under that score."""

    def __init__(self, tree: Tree, tops: dict[int, list[int]], low: int, high: int, k: int) -> None:
        self.tree, self.k = tree, k
        # low * top <= 100 * score <= high * top, in integers.
        self.windows = {i: [[t, -(-low * t // 100), high * t // 100, *(np.empty(0, np.int64),) * 2] for t in tops_] for i, tops_ in tops.items()}

    def wanted(self, i: int, low: np.ndarray, high: np.ndarray) -> np.ndarray:
        windows = [w for w in self.windows.get(i, ()) if w[1] <= w[2]]
        if not windows:
            return np.zeros(len(low), bool)
        lowest, highest = min(w[1] for w in windows), max(w[2] for w in windows)
        return (self.labels != self.tree.labels[i]) & (high >= lowest) & (low <= highest)

    def found(self, i: int, at: np.ndarray, scores: np.ndarray) -> None:
        for w in self.windows.get(i, ()) if len(at) else ():
            inside = (scores >= w[1]) & (scores <= w[2])
            if inside.any():
                w[3], w[4] = _best(w[3], w[4], self.ids[at[inside]], scores[inside], self.k)
                if len(w[3]) == self.k:
                    w[1] = max(w[1], int(w[4][-1]))

    def rows(self) -> list[list[int]]:
        each = [
            (int(self.tree.ids[i]), top, int(v), int(s))
            for i, windows in self.windows.items()
            for top, _, _, ids, scores in windows
            for v, s in zip(ids, scores, strict=True)
        ]
        return list(zip(*each, strict=True)) or [[], [], [], []]


def mine(
    vectors: DataFrame, is_anchor: Column, positives: int = 5, negatives: int = 5, low: int = 80, high: int = 100, scale: int = 256,
    key: str = "vec_id", embedding: str = "embedding", label: str = "label",
) -> DataFrame:
    """For each anchor row and each of its positives the best negatives: anchor_id, positive_id, rank from 1, negative_id, positive_score, negative_score.

    A score is the inner product of floor(scale * x). Positives are the anchor's best rows of its own label, other than those of its id; negatives of a
    positive are the best rows of other labels with low * positive_score <= 100 * score <= high * positive_score. Ties go to the smaller id. Fewer are
    returned where there are fewer, none for a positive without negatives.

    Rows without id, label or vector, or with null or non-finite components, take no part. Vectors of different lengths meet as if filled up with zeros.
    Repeated rows count each as positives and negatives; of several anchor rows of one id the least (label, vector) is the anchor. A component beyond 62 bits after scaling and
    a score beyond 64 bits raise an error. Other columns are ignored.
    """
    rows = vectors.select(
        F.col(key).cast("long").alias("id"), F.col(label).cast("long").alias("label"), F.col(embedding).alias("x"), is_anchor.alias("anchor")
    ).where(usable(F.col("x")) & F.col("id").isNotNull() & F.col("label").isNotNull())
    exact = staged(rows.select("id", "label", scaled(F.col("x"), scale).alias("v"), "anchor"))
    largest = F.greatest(F.max(F.array_max("v")), -F.min(F.array_min("v")))
    facts = exact.agg(F.max(F.size("v")), largest, F.count_distinct(F.when(F.col("anchor"), F.col("id")))).first()
    width, most, n_anchors = facts[0] or 0, facts[1] or 0, facts[2]
    wide = most * most * max(1, width) >= 2**53

    n_blocks = max(1, math.ceil(n_anchors / ANCHORS))
    least = F.min(F.struct("label", "v"))
    anchors = exact.where("anchor").groupBy("id").agg(least.alias("x")).select("id", "x.label", "x.v")
    trees = staged(_trees(anchors.withColumn("block", F.pmod(F.xxhash64("id"), F.lit(n_blocks)).cast("int")), width))

    found = []
    for block in range(n_blocks):
        tree = _collected(trees.where(F.col("block") == block), width, wide)
        if not len(tree.ids):
            continue
        best = _swept(exact, tree, width, lambda t: Positives(t, positives), "anchor_id long, positive_id long, positive_score long")
        of_anchor = Window.partitionBy("anchor_id").orderBy(F.desc("positive_score"), "positive_id")
        chosen = staged(best.withColumn("n", F.row_number().over(of_anchor)).where(F.col("n") <= positives))
        place = {int(x): i for i, x in enumerate(tree.ids)}
        tops: dict[int, list[int]] = {}
        for anchor, score in chosen.select("anchor_id", "positive_score").distinct().collect():  # at most `positives` an anchor of the block
            tops.setdefault(place[anchor], []).append(score)
        held = _swept(
            exact, tree, width, lambda t, tops=tops: Negatives(t, tops, low, high, negatives),
            "anchor_id long, positive_score long, negative_id long, negative_score long",
        )
        of_window = Window.partitionBy("anchor_id", "positive_score").orderBy(F.desc("negative_score"), "negative_id")
        ranked = held.withColumn("rank", F.row_number().over(of_window)).where(F.col("rank") <= negatives)
        found.append(chosen.join(ranked, ["anchor_id", "positive_score"]))
    if not found:
        return vectors.sparkSession.createDataFrame([], RESULT)
    columns = ("anchor_id", "positive_id", "rank", "negative_id", "positive_score", "negative_score")
    return reduce(DataFrame.unionByName, found).select(*columns)


def _collected(tree: DataFrame, width: int, wide: bool) -> Tree:
    """The anchors of one block, a bounded number."""
    rows = sorted(tree.collect(), key=lambda r: r["at"])
    points = _matrix(pd.Series([r["v"] for r in rows], dtype=object), width, wide)
    ids, labels = (np.array([r[c] for r in rows], np.int64) for c in ("id", "label"))
    return Tree(ids, labels, points, [r["parent"] for r in rows], [r["edge"] for r in rows])
