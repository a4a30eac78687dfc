"""Toxicity by the nearest labelled examples: exact TF-IDF cosine over a block-max inverted index.

The examples are a bounded sample of the labelled rows and the terms a bounded choice among theirs, so the index has a fixed largest size and
is broadcast. How many documents hold a term is counted over the whole corpus. For a text, each block of examples has an upper bound from the
terms' largest weights in it; blocks are scored by falling bound until none can hold a nearer example than the k found.
"""

from __future__ import annotations

import math
import re
from collections import Counter
from collections.abc import Iterable, Iterator
from dataclasses import dataclass

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T

from burnwatch.llm.staging import staged
from burnwatch.llm.worker_memory import release

WORD = re.compile(r"\w+")
#: Lengths of word beginnings that are terms beside the word: compounds and inflections share them.
BEGINNINGS = (5, 6, 7, 8)
BLOCK = 64
#: Similar examples count by this power of their cosine.
POWER = 4
#: Vote weight of the base rate, against neighbours that are hardly alike.
PRIOR = 0.02
#: Words whose terms are remembered in a task.
MEMO = 200_000


def terms_of(word: str) -> list[str]:
    return [word, *(word[:n] + "*" for n in BEGINNINGS if len(word) > n)]


def term_counts(text: str | None) -> Counter:
    counts: Counter = Counter()
    for word, n in Counter(WORD.findall((text or "").lower())).items():
        for term in terms_of(word):
            counts[term] += n
    return counts


class Known(dict):
    """Numbers of a word's terms in the vocabulary; emptied when full."""

    def __init__(self, numbers: dict[str, int]) -> None:
        super().__init__()
        self.numbers = numbers
        self.starts = {term[: BEGINNINGS[0]] for term in numbers}

    def __missing__(self, word: str) -> list[int]:
        if word[: BEGINNINGS[0]] not in self.starts:
            return []
        if len(self) >= MEMO:
            self.clear()
        self[word] = found = [self.numbers[t] for t in terms_of(word) if t in self.numbers]
        return found

    def counts(self, text: str | None) -> dict[int, int]:
        out: dict[int, int] = {}
        starts, at = self.starts, BEGINNINGS[0]
        for word in WORD.findall((text or "").lower()):
            if word[:at] in starts:
                for i in self[word]:
                    out[i] = out.get(i, 0) + 1
        return out


def vector(counts: dict[int, int], idf: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """Terms and weights of unit length; empty where no term of the vocabulary occurs."""
    terms = np.fromiter(counts.keys(), np.int64, len(counts))
    weights = (1 + np.log(np.fromiter(counts.values(), np.float64, len(counts)))) * idf[terms]
    norm = math.sqrt(float(weights @ weights))
    return (terms, weights / norm) if norm > 0 else (terms[:0], weights[:0])


@dataclass
class Index:
    """Weights by term and example, and their maxima by term and block of examples."""

    weights: np.ndarray  # blocks x terms x examples of a block
    maxima: np.ndarray  # terms x blocks
    ids: np.ndarray
    toxic: np.ndarray

    @staticmethod
    def build(vectors: list[tuple[np.ndarray, np.ndarray]], ids: np.ndarray, toxic: np.ndarray, n_terms: int) -> Index:
        # Examples whose heaviest terms are equal stand together, which makes the maxima of their block tight. The order, which decides between equal cosines,
        # follows from terms, weights and labels; an id has no part in it.
        by_term = [(t[o], w[o]) for t, w in vectors for o in [np.argsort(t)]]
        heaviest = [tuple(t[np.argsort(-w, kind="stable")[:3]]) for t, w in by_term]
        order = sorted(range(len(vectors)), key=lambda i: (heaviest[i], by_term[i][0].tolist(), by_term[i][1].tolist(), toxic[i]))
        weights = np.zeros((-(-max(1, len(order)) // BLOCK), n_terms, BLOCK), np.float32)
        for column, i in enumerate(order):
            weights[column // BLOCK, vectors[i][0], column % BLOCK] = vectors[i][1]
        return Index(weights, np.ascontiguousarray(weights.max(axis=2).T), ids[order], toxic[order])

    def column(self, i: int) -> tuple[np.ndarray, np.ndarray]:
        """Terms and weights of an example."""
        weights = self.weights[i // BLOCK, :, i % BLOCK]
        terms = np.flatnonzero(weights)
        return terms, weights[terms].astype(np.float64)

    def nearest(self, terms: np.ndarray, weights: np.ndarray, k: int, without: int = -1) -> tuple[np.ndarray, np.ndarray]:
        """Columns and cosines of the k nearest examples that share a term, by cosine, then place in the index."""
        query = weights.astype(np.float32)
        bounds = query @ self.maxima[terms]
        order = np.argsort(-bounds, kind="stable")
        order = order[: np.count_nonzero(bounds > 0)]
        columns, cosines, kth, at, step = np.empty(0, np.int64), np.empty(0), 0.0, 0, 4
        while at < len(order) and bounds[order[at]] >= kth - 1e-5:
            blocks = order[at : at + step]
            at, step = at + step, step * 2
            scores = (query @ self.weights[blocks[:, None], terms]).ravel()
            keep = np.flatnonzero((scores > 0) & (scores >= kth - 1e-5))
            found = blocks[keep // BLOCK] * BLOCK + keep % BLOCK
            real = (found < len(self.ids)) & (found != without)
            columns = np.concatenate([columns, found[real]])
            cosines = np.concatenate([cosines, np.round(scores[keep[real]].astype(np.float64), 6)])
            if len(columns) > k:
                best = np.lexsort((columns, -cosines))[:k]
                columns, cosines, kth = columns[best], cosines[best], cosines[best[-1]]
            elif len(columns) == k:
                kth = cosines.min()
        best = np.lexsort((columns, -cosines))
        return columns[best], cosines[best]


@dataclass
class Model:
    terms: list[str]
    idf: np.ndarray
    index: Index
    k: int
    base: float  # share of toxic rows among the examples
    blank: float  # score of texts without a known term
    slope: float
    shift: float

    def vote(self, columns: np.ndarray, cosines: np.ndarray) -> float:
        weights = cosines**POWER
        return float((weights @ self.index.toxic[columns] + PRIOR * self.base) / (weights.sum() + PRIOR))

    def score(self, vote: float) -> float:
        vote = min(max(vote, 1e-6), 1 - 1e-6)
        return 1 / (1 + math.exp(-(self.slope * math.log(vote / (1 - vote)) + self.shift)))


def calibration(votes: np.ndarray, toxic: np.ndarray, weights: np.ndarray) -> tuple[float, float]:
    """Slope and shift of a logistic curve through votes that each left its own example out."""
    x = np.log(np.clip(votes, 1e-6, 1 - 1e-6) / (1 - np.clip(votes, 1e-6, 1 - 1e-6)))
    beta = np.array([1.0, 0.0])
    design = np.stack([x, np.ones_like(x)], axis=1)
    ridge = np.diag([1e-2, 1e-2])
    for _ in range(50):
        p = 1 / (1 + np.exp(-np.clip(design @ beta, -30, 30)))
        gradient = design.T @ (weights * (toxic - p)) - ridge @ (beta - [1.0, 0.0])
        step = np.linalg.solve(design.T @ (design * (weights * p * (1 - p))[:, None]) + ridge, gradient)
        beta += np.clip(step, -2, 2)
        if np.abs(step).max() < 1e-9:
            break
    return float(max(beta[0], 0.05)), float(beta[1])


def held_out(doc_id: Column) -> Column:
    return F.pmod(F.crc32(doc_id.cast("string").cast("binary")), F.lit(5)) == 0


def example_ids(labels: DataFrame, most_toxic: int, most_clean: int) -> tuple[DataFrame, dict[int, int]]:
    """Labelled doc_ids to learn from, and how many rows each label has in all; a doc_id with both labels is toxic."""
    known = (
        labels.where("doc_id IS NOT NULL AND toxic IN (0, 1)")
        .where(~held_out(F.col("doc_id")))
        .groupBy("doc_id")
        .agg(F.max("toxic").cast("int").alias("toxic"))
    )
    totals = {row["toxic"]: row["n"] for row in known.groupBy("toxic").agg(F.count("*").alias("n")).collect()}
    chosen = [
        known.where(F.col("toxic") == label).orderBy(F.xxhash64("doc_id"), "doc_id").limit(most)
        for label, most in ((1, most_toxic), (0, most_clean))
    ]
    return chosen[0].unionByName(chosen[1]), totals


def _counted(examples: DataFrame) -> DataFrame:
    """(doc_id, toxic, term, n) of texts."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for i, text in enumerate(batch.column("text").to_pylist()):
                counts = term_counts(text)
                row = batch.slice(i, 1)
                yield pa.RecordBatch.from_pydict(
                    {
                        "doc_id": row.column("doc_id"),
                        "toxic": row.column("toxic"),
                        "terms": pa.array([list(counts)], pa.list_(pa.string())),
                        "counts": pa.array([list(counts.values())], pa.list_(pa.int32())),
                    }
                )

    return examples.select("doc_id", "toxic", "text").mapInArrow(
        run, "doc_id long, toxic int, terms array<string>, counts array<int>"
    )


def document_counts(docs: DataFrame, terms: list[str]) -> tuple[int, np.ndarray]:
    """Number of documents, and of those that hold each term."""
    numbers = {t: i for i, t in enumerate(terms)}

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        release()
        known, held, n = Known(numbers), np.zeros(len(numbers) + 1, np.int64), 0
        for batch in batches:
            for text in batch.column(0).to_pylist():
                held[list(known.counts(text))] += 1
                n += 1
        held[-1] = n
        used = np.flatnonzero(held)
        yield pa.RecordBatch.from_arrays([pa.array(used), pa.array(held[used])], names=["term", "n"])

    rows = docs.select("text").mapInArrow(run, "term long, n long").groupBy("term").agg(F.sum("n").alias("n")).collect()
    held = np.zeros(len(terms) + 1, np.int64)
    for row in rows:
        held[row["term"]] = row["n"]
    return int(held[-1]), held[:-1]


def fit(
    docs: DataFrame,
    labels: DataFrame,
    most_toxic: int = 1500,
    most_clean: int = 3000,
    most_terms: int = 1000,
    k: int = 15,
) -> Model | None:
    """A model from at most `most_toxic` and `most_clean` labelled rows of `docs`, and statistics of all of `docs`.

    Examples are the labelled ids outside the held-out fold that come first by a hash. Terms are the `most_terms` words and beginnings of
    words by the chi-square of their occurrence against the label, among those in three examples or more. None without examples of both labels.
    """
    ids, totals = example_ids(labels, most_toxic, most_clean)
    examples = staged(_counted(docs.select("doc_id", "text").join(F.broadcast(ids), "doc_id")))
    sizes = {row["toxic"]: row["n"] for row in examples.groupBy("toxic").agg(F.count("*").alias("n")).collect()}
    if len(sizes) < 2:
        return None
    n1, n0 = float(sizes[1]), float(sizes[0])
    a, b = F.sum("toxic").cast("double"), F.sum(1 - F.col("toxic")).cast("double")
    chi = (n1 + n0) * F.pow(a * (n0 - b) - b * (n1 - a), F.lit(2)) / ((a + b) * (n1 + n0 - a - b + 1e-9) * n1 * n0)
    best = (
        examples.select("toxic", F.explode("terms").alias("term"))
        .groupBy("term")
        .agg(chi.alias("chi"), F.count("*").alias("n"))
        .where("n >= 3")
        .orderBy(F.desc("chi"), "term")
        .limit(most_terms)
    )
    terms = [row["term"] for row in best.collect()]
    n, held = document_counts(docs, terms)
    idf = np.log((1 + n) / (1 + np.minimum(held, n))) + 1e-3

    numbers = {t: i for i, t in enumerate(terms)}
    rows = sorted(_known_only(examples, numbers).collect(), key=lambda r: (r["doc_id"], r["terms"]))
    vectors = [vector(dict(zip(r["terms"], r["counts"], strict=True)), idf) for r in rows]
    ids_, toxic = np.array([r["doc_id"] for r in rows]), np.array([r["toxic"] for r in rows], np.float64)
    index = Index.build(vectors, ids_, toxic, len(terms))
    weight = {1: totals[1] / n1, 0: totals[0] / n0}
    model = Model(terms, idf, index, k, n1 / (n1 + n0), 0.0, 1.0, 0.0)

    votes, seen, w = np.zeros(len(rows)), np.zeros(len(rows), bool), np.array([weight[int(t)] for t in index.toxic])
    for column in range(len(rows)):
        t, weights = index.column(column)
        if len(t):
            seen[column] = True
            votes[column] = model.vote(*index.nearest(t, weights, k, without=column))
    if seen.any():
        model.slope, model.shift = calibration(votes[seen], index.toxic[seen], w[seen])
    share = totals[1] / (totals[1] + totals[0])
    model.blank = float((w[~seen] @ index.toxic[~seen] + share) / (w[~seen].sum() + 1))
    return model


def _known_only(examples: DataFrame, numbers: dict[str, int]) -> DataFrame:
    """(doc_id, toxic, terms, counts) with the numbers of the vocabulary's terms."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            terms, counts = [], []
            for ts, ns in zip(batch.column("terms").to_pylist(), batch.column("counts").to_pylist(), strict=True):
                found = [(numbers[t], n) for t, n in zip(ts, ns, strict=True) if t in numbers]
                terms.append([x for x, _ in found])
                counts.append([x for _, x in found])
            yield pa.RecordBatch.from_arrays(
                [batch.column("doc_id"), batch.column("toxic"), pa.array(terms, pa.list_(pa.int32())), pa.array(counts, pa.list_(pa.int32()))],
                names=["doc_id", "toxic", "terms", "counts"],
            )

    return examples.mapInArrow(run, "doc_id long, toxic int, terms array<int>, counts array<int>")


def score_texts(texts: Iterable[str | None], model: Model, known: Known) -> Iterator[tuple[float, list[tuple[int, float, int]]]]:
    """Score and evidence, (example id, cosine, label) of the nearest, of each text."""
    for text in texts:
        terms, weights = vector(known.counts(text), model.idf)
        if not len(terms):
            yield model.blank, []
            continue
        columns, cosines = model.index.nearest(terms, weights, model.k)
        evidence = list(
            zip(model.index.ids[columns].tolist(), cosines.tolist(), model.index.toxic[columns].astype(int).tolist(), strict=True)
        )
        yield model.score(model.vote(columns, cosines)), evidence


EVIDENCE = "array<struct<doc_id:long,cosine:double,toxic:int>>"


def score(docs: DataFrame, model: Model | None, evidence: bool = True) -> DataFrame:
    """`docs` with `score` (0 to 1), `predicted` (1 from 0.5 on) and, if wanted, `evidence`; these replace columns of the same names.

    Null and empty texts, and texts without a known term, have the score of such examples; without a model every score is 0. Equal texts have
    equal scores; repeated rows stay; whole texts are read.
    """
    added = {"score": "double", "predicted": "int"} | ({"evidence": EVIDENCE} if evidence else {})
    rest = docs.drop(*added)
    if model is None:
        empty = {"score": F.lit(0.0), "predicted": F.lit(0), "evidence": F.array().cast(EVIDENCE)}
        return rest.withColumns({name: empty[name] for name in added})
    shared = docs.sparkSession.sparkContext.broadcast(model)
    schema = T.StructType([*rest.schema.fields, *(T.StructField(n, T.DataType.fromDDL(t)) for n, t in added.items())])
    item = pa.struct([("doc_id", pa.int64()), ("cosine", pa.float64()), ("toxic", pa.int32())])

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        release()
        model = shared.value
        known = Known({t: i for i, t in enumerate(model.terms)})
        for batch in batches:
            found = list(score_texts(batch.column(batch.schema.names.index("text")).to_pylist(), model, known))
            scores = [s for s, _ in found]
            columns = [pa.array(scores, pa.float64()), pa.array([int(s >= 0.5) for s in scores], pa.int32())]
            if evidence:
                columns.append(
                    pa.array([[{"doc_id": d, "cosine": c, "toxic": t} for d, c, t in e] for _, e in found], pa.list_(item))
                )
            yield pa.RecordBatch.from_arrays([*batch.columns, *columns], names=[*batch.schema.names, *added])

    return rest.mapInArrow(run, schema)
