"""Exact top-k search by a vector-approximation file.

Components are integers. The approximation of a vector holds the cell of each component; cells are equally wide, so an inner product lies within
a radius of the product with the cells' centres, and the radius depends on the query only. The first pass reads approximations alone and finds a
score that the k-th result of each query reaches at least. The second takes exact vectors, by falling upper bound, of those candidates
that may still reach it, until the k-th result is certain.

Queries are sent to the candidates in blocks of bounded size; candidates are read where they lie and never copied or shuffled, and a task hands on at most k rows a query.
"""

from __future__ import annotations

import math
from collections.abc import Iterator
from functools import reduce

import numpy as np
import pandas as pd
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from burnwatch.llm.staging import staged

#: Candidates that are scored together, and queries of a block.
CANDIDATES, QUERIES = 4096, 1024
#: Bits of a cell's number.
BITS = 6
#: Components of this size and more raise an error.
LARGEST = float(2**62)


def quantised(embedding: Column, scale: int) -> Column:
    """floor(scale * x) of each component; beyond 62 bits it raises."""
    scaled = lambda x: x.cast("double") * F.lit(float(scale))
    too_large = F.raise_error(F.lit("a vector's component is too large")).cast("long")
    return F.transform(embedding, lambda x: F.when(F.abs(scaled(x)) < F.lit(LARGEST), F.floor(scaled(x)).cast("long")).otherwise(too_large))


def usable(embedding: Column) -> Column:
    """Not null, without null or non-finite components."""
    return embedding.isNotNull() & F.forall(
        embedding, lambda x: x.isNotNull() & ~F.isnan(x) & (F.abs(x.cast("double")) < F.lit(float("inf")))
    )


def matrix(rows: pd.Series, width: int) -> np.ndarray:
    """Integer rows as float64, filled up with zeros to the width."""
    out = np.zeros((len(rows), width))
    for i, row in enumerate(rows):
        out[i, : len(row)] = row
    return out


def products(queries: pd.Series, rows: pd.Series) -> np.ndarray:
    """Exact inner products; in Python's integers where doubles could not hold them. Beyond 64 bits they raise."""
    width = max(max(map(len, queries), default=0), max(map(len, rows), default=0))
    a, b = matrix(queries, width), matrix(rows, width)
    if not a.size or not b.size or np.abs(a).max() * np.abs(b).max() * width < 2**53:
        return (a @ b.T).astype(np.int64)
    return np.array([[sum(int(x) * int(y) for x, y in zip(q, r, strict=False)) for r in rows] for q in queries], np.int64)


class Cells:
    """Equal cells between the least and the largest component of the table."""

    def __init__(self, least: int, largest: int, bits: int) -> None:
        self.least = least
        self.wide = max(1, -(-(largest - least + 1) // 2**bits))

    def of(self, vector: Column) -> Column:
        # In doubles, as the difference of two long integers may not be one; what that rounds is covered by the bounds.
        last = F.lit(2**BITS - 1)
        cell = lambda x: F.floor((x.cast("double") - F.lit(float(self.least))) / F.lit(float(self.wide)))
        return F.transform(vector, lambda x: F.greatest(F.lit(0), F.least(last, cell(x))).cast("byte"))

    def bounds(self, queries: pd.Series, cells: pd.Series) -> tuple[np.ndarray, np.ndarray]:
        """Products with the cells' centres, and each query's radius around them."""
        width = max(max(map(len, queries), default=0), max(map(len, cells), default=0))
        q, centres = matrix(queries, width), np.zeros((len(cells), width))
        for i, row in enumerate(cells):
            centres[i, : len(row)] = self.least + np.asarray(row, np.float64) * self.wide + (self.wide - 1) / 2
        near = q @ centres.T
        radius = np.abs(q).sum(axis=1) * (self.wide - 1) / 2
        # Rounding of the sums is covered too.
        return near, radius + np.abs(q).sum(axis=1) * max(1.0, np.abs(centres).max(initial=0)) * width * 2.0**-50


def search(vectors: DataFrame, is_query: Column, k: int = 20, scale: int = 64, key: str = "vec_id", embedding: str = "embedding") -> DataFrame:
    """Of each query row its k best rows by the inner product of floor(scale * x): query_id, rank (from 1), vec_id, score.

    Candidates are all rows but those of the query's own id; ties go to the smaller id; with fewer candidates all are returned. Vectors that are null
    or hold null or non-finite components, and rows without an id, take no part; vectors of different lengths meet as if filled up with zeros. Repeated
    candidate rows count each; of several query rows of one id the least vector asks. Components beyond 62 bits after scaling and scores beyond 64 raise an error.
    Other columns are ignored.
    """
    rows = vectors.select(F.col(key).cast("long").alias("id"), F.col(embedding).alias("x"), is_query.alias("asks")).where(
        usable(F.col("x")) & F.col("id").isNotNull()
    )
    exact = staged(rows.select("id", "asks", quantised(F.col("x"), scale).alias("v")))
    facts = exact.agg(
        F.count_distinct(F.when(F.col("asks"), F.col("id"))).alias("asks"), F.min(F.array_min("v")).alias("least"), F.max(F.array_max("v")).alias("largest")
    ).first()
    cells = Cells(facts["least"] or 0, facts["largest"] or 0, BITS)
    table = staged(exact.select("id", cells.of(F.col("v")).alias("cells"), "v"))
    n_blocks = max(1, math.ceil(facts["asks"] / QUERIES))
    queries = staged(exact.where("asks").groupBy("id").agg(F.min("v").alias("q")).withColumn("block", F.pmod(F.xxhash64("id"), F.lit(n_blocks))))
    found = []
    for block in range(n_blocks):
        asked = queries.where(F.col("block") == block).select("id", "q").toPandas().sort_values("id", ignore_index=True)  # a block of bounded size
        if not len(asked):
            continue
        reached = _reached(table, asked, cells, k).groupBy("ask").agg(F.max("reach").alias("reach")).collect()
        reach = np.full(len(asked), -np.inf)
        for ask, value in reached:
            reach[ask] = value
        found.append(_best(table, asked, reach, cells, k))
    if not found:
        return vectors.sparkSession.createDataFrame([], "query_id long, rank int, vec_id long, score long")
    best = reduce(DataFrame.unionByName, found)
    rank = F.row_number().over(Window.partitionBy("query_id").orderBy(F.desc("score"), "vec_id"))
    return best.withColumn("rank", rank).where(F.col("rank") <= k).select("query_id", "rank", "vec_id", "score")


def _reached(table: DataFrame, asked: pd.DataFrame, cells: Cells, k: int) -> DataFrame:
    """(ask, reach): a score that the k-th result of a query reaches at least, by the approximations of each task's candidates."""
    shared = table.sparkSession.sparkContext.broadcast(asked)

    def run(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        ids, queries = shared.value["id"].to_numpy(), shared.value["q"]
        best = np.full((len(ids), 0), -np.inf)
        for batch in batches:
            for start in range(0, len(batch), CANDIDATES):
                part = batch.iloc[start : start + CANDIDATES]
                near, radius = cells.bounds(queries, part["cells"])
                near -= radius[:, None]
                near[ids[:, None] == part["id"].to_numpy()[None, :]] = -np.inf
                best = np.concatenate([best, near], axis=1)
                if best.shape[1] > k:
                    best = -np.partition(-best, k - 1, axis=1)[:, :k]
        if best.shape[1] >= k:
            least = best.min(axis=1)
            yield pd.DataFrame({"ask": np.flatnonzero(np.isfinite(least)), "reach": least[np.isfinite(least)]})

    return table.select("id", "cells").mapInPandas(run, "ask int, reach double")


def _best(table: DataFrame, asked: pd.DataFrame, reach: np.ndarray, cells: Cells, k: int) -> DataFrame:
    """(query_id, vec_id, score): the k best of each task's candidates, those left out that cannot be among the k best of all."""
    shared = table.sparkSession.sparkContext.broadcast((asked, reach))

    def run(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        asked, reach = shared.value
        queries, floor = asked["q"], reach.copy()
        held = {}
        for batch in batches:
            for start in range(0, len(batch), CANDIDATES):
                part = batch.iloc[start : start + CANDIDATES]
                near, radius = cells.bounds(queries, part["cells"])
                ids = part["id"].to_numpy()
                for i, (own, q) in enumerate(zip(asked["id"], queries, strict=True)):
                    highest = near[i] + radius[i]
                    alive = np.flatnonzero((highest >= floor[i]) & (ids != own))
                    alive = alive[np.argsort(-highest[alive], kind="stable")]
                    at, step = 0, 2 * k
                    best_ids, best = held.get(i, (np.empty(0, np.int64), np.empty(0, np.int64)))
                    while at < len(alive) and (len(best) < k or highest[alive[at]] >= best[-1]):
                        take = alive[at : at + step]
                        at, step = at + step, step * 2
                        scores = products(pd.Series([q]), part["v"].iloc[take])[0]
                        best_ids, best = np.concatenate([best_ids, ids[take]]), np.concatenate([best, scores])
                        order = np.lexsort((best_ids, -best))[:k]
                        best_ids, best = best_ids[order], best[order]
                    held[i] = best_ids, best
                    if len(best) == k:
                        floor[i] = max(floor[i], float(best[-1]) * (1 - 2.0**-50) if best[-1] > 0 else float(best[-1]) * (1 + 2.0**-50))
        for i, (best_ids, best) in held.items():
            yield pd.DataFrame({"query_id": asked["id"].iloc[i], "vec_id": best_ids, "score": best})

    return table.select("id", "cells", "v").mapInPandas(run, "query_id long, vec_id long, score long")
