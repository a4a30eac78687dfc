"""Each stage of the pipeline against a plain form on a small fixture."""

from __future__ import annotations

import random

import pytest

import corpus_pipeline
from burnwatch.llm import toxicity
from burnwatch.llm.queries import bpe_vocabulary

SF_DIR = "/root/testdata/sf0.001"


@pytest.fixture(scope="module")
def fixture():
    rng = random.Random(12)
    docs = []
    for g in range(8):
        base = [f"g{g}w{i}" for i in range(rng.randint(8, 70))]
        for _ in range(rng.randint(1, 9)):
            words = list(base)
            for _ in range(rng.randint(0, 4)):
                words[rng.randrange(len(words))] = f"e{rng.randrange(9)}"
            docs.append(" ".join(words))
    passage = " ".join(f"shared{i}" for i in range(60))
    docs += [f"{a} {passage} {b}" for a, b in (("one two", "three"), ("four", "five six"), ("seven " * 9, "eight"))]
    docs += ["", None, "a", "a", "x y", "X  y"]
    rng.shuffle(docs)
    return [(i * 3 + 1, text, "en", "abc"[i % 7 % 3], len(text or "")) for i, text in enumerate(docs)]


@pytest.fixture
def frame(spark, fixture):
    return spark.createDataFrame(fixture, "doc_id long, text string, lang string, source string, n_chars long").repartition(3)


def test_near_copies(spark, frame, fixture):
    """Of what links of five words at 80 percent connect, the smallest id stays."""
    sets = {}
    for i, text, *_ in fixture:
        words = (text or "").lower().split()
        sets[i] = {tuple(words[j : j + 5]) for j in range(max(1, len(words) - 4))} if words else set()
    component = {i: i for i in sets}
    for i in sets:
        for j in sets:
            if sets[i] and sets[j] and component[i] != component[j] and 100 * len(sets[i] & sets[j]) >= 80 * len(sets[i] | sets[j]):
                low, high = sorted((component[i], component[j]))
                component = {k: low if c == high else c for k, c in component.items()}
    kept = corpus_pipeline.keep_one_of_near_copies(spark, frame, SF_DIR).collect()
    wanted = [row for row in fixture if component[row[0]] == row[0]]
    assert sorted(map(tuple, kept)) == sorted(wanted) and len(wanted) < len(fixture)


def test_repeated_strings(spark, frame, fixture):
    """Bytes of strings of 200 bytes that start twice go; other columns stay."""
    raws = {i: (text or "").encode() for i, text, *_ in fixture}
    places: dict = {}
    for i, raw in raws.items():
        for at in range(len(raw) - 199):
            places.setdefault(raw[at : at + 200], []).append((i, at))
    gone = {i: bytearray(len(raw)) for i, raw in raws.items()}
    for found in places.values():
        for i, at in found if len(found) > 1 else ():
            gone[i][at : at + 200] = b"\1" * 200
    wanted = {i: bytes(b for b, x in zip(raw, gone[i], strict=True) if not x).decode("utf-8", "ignore") for i, raw in raws.items()}
    assert any(len(wanted[i]) < len(raw) for i, raw in raws.items())
    for row in corpus_pipeline.cut_repeats(spark, frame, SF_DIR).collect():
        assert row.text == wanted[row.doc_id] and row.n_chars == len(row.text)
    assert corpus_pipeline.cut_repeats(spark, frame, SF_DIR).count() == len(fixture)


def test_mixed_sources(spark, frame, fixture):
    """Every row once at least, small sources up to twice, whole passes apart by no more than one."""
    rows = [r.doc_id for r in corpus_pipeline.mix_sources(spark, frame, SF_DIR).collect()]
    counts = {i: rows.count(i) for i in {r[0] for r in fixture}}
    assert set(counts.values()) <= {1, 2} and set(rows) == set(counts)
    tokens: dict = {}
    for _, text, _, source, _ in fixture:
        tokens[source] = tokens.get(source, 0) + max(1, len((text or "").split()))
    largest = max(tokens, key=tokens.get)
    assert all(counts[r[0]] == 1 for r in fixture if r[3] == largest)
    least = min(tokens, key=tokens.get)
    again = sum(max(1, len((r[1] or "").split())) for r in fixture if r[3] == least and counts[r[0]] == 2)
    assert again <= tokens[least] + 1 and (again >= 0.5 * tokens[least] or tokens[least] * 2 > tokens[largest])


def test_toxic_ones_go(spark):
    """The stage keeps what the model, scored row by row, does not call toxic."""
    docs = spark.read.parquet(f"{SF_DIR}/documents.parquet")
    model = toxicity.fit(docs, spark.read.parquet(f"{SF_DIR}/labels.parquet"))
    known = toxicity.Known({t: i for i, t in enumerate(model.terms)})
    rows = docs.collect()
    scores = [s for s, _ in toxicity.score_texts([r.text for r in rows], model, known)]
    wanted = sorted(r.doc_id for r, s in zip(rows, scores, strict=True) if s < 0.5)
    assert sorted(r.doc_id for r in corpus_pipeline.drop_toxic(spark, docs, SF_DIR).collect()) == wanted
    assert len(wanted) < len(rows)


def test_tokens(spark, frame, fixture):
    vocabulary = bpe_vocabulary()
    texts = {i: text or "" for i, text, *_ in fixture}
    for row in corpus_pipeline.to_tokens(spark, frame, SF_DIR).collect():
        assert b"".join(vocabulary.by_id[x] for x in row.ids).decode() == texts[row.doc_id]
        assert row.round_trip and row.n_tokens == len(row.ids)
