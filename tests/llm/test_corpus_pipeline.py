"""The pipeline's stages and their effects."""

from __future__ import annotations

import pyarrow.parquet as pq

import corpus_pipeline

SF_DIR = "/root/testdata/sf0.001"


def test_stages(spark):
    given = spark.read.parquet(f"{SF_DIR}/documents.parquet")
    before = {r.doc_id: r.text for r in given.collect()}
    frames, docs = {}, given
    for name, stage in corpus_pipeline.STAGES:
        docs = corpus_pipeline.staged(stage(spark, docs, SF_DIR))
        frames[name] = docs
    for name in list(frames)[:-1]:
        assert frames[name].columns == given.columns, name
    kept = {r.doc_id for r in frames["toxicity"].collect()}
    labels = {x["doc_id"]: x["toxic"] for x in pq.read_table(f"{SF_DIR}/labels.parquet").to_pylist()}
    clean = [i for i in before if labels.get(i) == 0]
    assert len(set(clean) & kept) >= 0.98 * len(clean)
    unique = [r.text for r in frames["n-gram Jaccard join"].collect()]
    assert len(set(unique)) == len(unique)
    cut = frames["suffix-array dedup"].collect()
    assert {r.doc_id for r in cut} == {r.doc_id for r in frames["n-gram Jaccard join"].collect()}
    assert all(r.n_chars == len(r.text) for r in cut)
    mixed = frames["source mixing"].collect()
    assert {r.doc_id for r in mixed} == {r.doc_id for r in cut} and len(mixed) >= len(cut)
    last = frames["byte-level BPE"].collect()
    assert len(last) == len(mixed) and all(r.round_trip and r.n_tokens == len(r.ids) for r in last)


def test_odd_rows_pass_every_stage(spark, documents, tmp_path):
    labels = spark.read.parquet(f"{SF_DIR}/labels.parquet")
    labels.write.parquet(str(tmp_path / "labels.parquet"))
    rows = documents((1, None), (2, ""), (3, "a b c d e f"), (3, "a b c d e f"), (None, "lone words here"))
    rows = rows.withColumn("score", rows["n_chars"]).withColumn("source", rows["lang"].substr(5, 1))
    for docs, n in ((rows, 4), (rows.limit(0), 0)):
        for _, stage in corpus_pipeline.STAGES:
            docs = corpus_pipeline.staged(stage(spark, docs, str(tmp_path)))
        assert docs.count() == n


def test_columns_named_like_those_of_the_operators_stay(spark, documents, tmp_path):
    spark.read.parquet(f"{SF_DIR}/labels.parquet").write.parquet(str(tmp_path / "labels.parquet"))
    names = ("bytes", "kept", "spans", "_key", "_check", "epoch", "turn", "score", "component_id", "key", "start", "tokens")
    docs = documents(*[(i, f"some words of text number {i} " * 3) for i in range(6)])
    for i, name in enumerate(names):
        docs = docs.withColumn(name, docs["doc_id"] * 100 + i)
    for _, stage in corpus_pipeline.STAGES[:-1]:
        columns = docs.columns
        docs = corpus_pipeline.staged(stage(spark, docs, str(tmp_path)))
        assert docs.columns == columns
    assert docs.count() > 0
    for row in docs.collect():
        assert [row[n] for n in names] == [row.doc_id * 100 + i for i in range(len(names))]
