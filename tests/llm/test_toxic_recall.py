"""Toxic rows that are held out are found: a model that calls everything clean does not pass."""

from __future__ import annotations

import numpy as np
import pyarrow.parquet as pq
import pytest

import corpus_pipeline
from burnwatch.llm import toxicity

SF_DIR = "/root/testdata/sf0.1"


@pytest.fixture(scope="module")
def held(spark):
    """The labelled documents of the held-out fold as a frame, and their labels."""
    docs = spark.read.parquet(f"{SF_DIR}/documents.parquet")
    labels = spark.read.parquet(f"{SF_DIR}/labels.parquet")
    wanted = docs.join(labels.where(toxicity.held_out(labels["doc_id"])).select("doc_id"), "doc_id", "left_semi")
    given = {x["doc_id"]: x["toxic"] for x in pq.read_table(f"{SF_DIR}/labels.parquet").to_pylist()}
    return docs, wanted, given


def test_toxic_rows_are_found_and_dropped(spark, held, monkeypatch):
    docs, wanted, given = held
    # The model learns from all documents; only the held-out ones are scored.
    model = toxicity.fit(docs, spark.read.parquet(f"{SF_DIR}/labels.parquet"))
    monkeypatch.setattr(toxicity, "fit", lambda *_: model)
    ids = {r.doc_id for r in wanted.select("doc_id").collect()}
    kept = {r.doc_id for r in corpus_pipeline.drop_toxic(spark, wanted, SF_DIR).select("doc_id").collect()}
    toxic, clean = ({i for i in ids if given[i] == label} for label in (1, 0))
    assert len(toxic) >= 90 and len(clean) >= 700
    assert len(toxic - kept) >= 0.85 * len(toxic)
    assert len(clean & kept) >= 0.98 * len(clean)


def test_ids_have_no_part_in_a_score():
    """Examples of equal cosine are taken in the same order whatever their ids are."""
    rng = np.random.default_rng(4)
    vectors, toxic = [], []
    for i in range(150):
        terms = np.sort(rng.choice(12, 3, replace=False)).astype(np.int64)
        vectors.append((terms, np.full(3, 1 / np.sqrt(3))))
        toxic.append(float(i % 3 == 0))
    toxic = np.array(toxic)
    query = (np.array([1, 5, 7]), np.full(3, 1 / np.sqrt(3)))
    found = []
    for ids in (np.arange(150), np.arange(150)[::-1].copy(), rng.permutation(150)):
        order = rng.permutation(150)
        index = toxicity.Index.build([vectors[i] for i in order], ids, toxic[order], 12)
        columns, cosines = index.nearest(*query, 15)
        found.append((cosines.tolist(), index.toxic[columns].tolist()))
    assert found[0] == found[1] == found[2]


def test_nearest_are_those_of_all_examples():
    """Block maxima leave out no example: against the cosine with every example."""
    rng = np.random.default_rng(5)
    vectors = []
    for _ in range(700):
        terms = np.sort(rng.choice(80, rng.integers(1, 9), replace=False)).astype(np.int64)
        weights = rng.random(len(terms)) + 0.1
        vectors.append((terms, weights / np.sqrt(weights @ weights)))
    index = toxicity.Index.build(vectors, np.arange(700), np.zeros(700), 80)
    dense = np.zeros((700, 80))
    for i, (t, w) in enumerate(vectors):
        dense[i, t] = w
    for t, w in vectors[:60]:
        columns, cosines = index.nearest(t, w, 15)
        want = np.sort(dense[:, t] @ w)[::-1][:15]
        np.testing.assert_allclose(cosines, want[want > 0], atol=2e-6)
