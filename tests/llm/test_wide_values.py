"""Values at the edges of their types, and bytes that meet weak hashes."""

from __future__ import annotations

import math
import random

import numpy as np
import pytest
from pyspark.sql import functions as F

from burnwatch.llm import mixing, suffix_dedup, vectors


def searched(spark, rows, k=3):
    table = spark.createDataFrame(rows, "vec_id long, embedding array<double>").repartition(2)
    return sorted(tuple(r) for r in vectors.search(table, F.col("vec_id") == 0, k=k, scale=1).collect())


def test_large_components_of_both_signs_are_exact(spark):
    rng = random.Random(3)
    rows = [(i, [float(rng.randrange(-(2**30), 2**30)), float(rng.randrange(-(2**30), 2**30))]) for i in range(40)]
    rows += [(50, [2.0**61, 0.0]), (51, [-(2.0**61), 1.0])]
    rows[0] = (0, [1.0, 3.0])
    whole = {i: [int(x) for x in v] for i, v in rows}
    want = sorted((-(whole[0][0] * v[0] + whole[0][1] * v[1]), i) for i, v in whole.items() if i)[:3]
    assert [r[1:] for r in searched(spark, rows)] == [(n, i, -s) for n, (s, i) in enumerate(want, 1)]


def test_what_64_bits_do_not_hold_raises(spark):
    with pytest.raises(Exception, match="too large"):
        searched(spark, [(0, [1e30]), (1, [-1e30])])
    with pytest.raises(Exception, match="(?i)overflow|too large|too big"):
        searched(spark, [(0, [2.0**40]), (1, [2.0**40])])


def test_fewer_candidates_than_asked_for_in_every_task(spark, monkeypatch):
    monkeypatch.setattr(vectors, "QUERIES", 2)
    rows = [(i, [float(i)]) for i in range(12)]
    table = spark.createDataFrame(rows, "vec_id long, embedding array<double>").repartition(6)
    found = sorted(map(tuple, vectors.search(table, F.col("vec_id") % 2 == 0, k=20, scale=1).collect()))
    assert len(found) == 6 * 11
    assert [r[2] for r in found if r[0] == 2] == [11, 10, 9, 8, 7, 6, 5, 4, 3, 1, 0]


def thue_morse(turns):
    text = "a"
    for _ in range(turns):
        text += text.translate(str.maketrans("ab", "ba"))
    return text


def test_strings_that_meet_under_polynomial_hashes_stay(documents):
    """Equal sums modulo a power of two are no repeat; every byte kept or removed is as by counting windows."""
    one = thue_morse(11)
    other = one.translate(str.maketrans("ab", "ba"))
    rng = random.Random(2)
    edge = ["".join(rng.choices("klmnop", k=400)) for _ in range(4)]
    texts = {1: edge[0] + one[:2048] + edge[1], 2: edge[2] + other[:2048] + edge[3]}
    windows: dict = {}
    for i, text in texts.items():
        for at in range(len(text) - 199):
            windows.setdefault(text[at : at + 200], []).append((i, at))
    removed = {1: np.zeros(len(texts[1]), bool), 2: np.zeros(len(texts[2]), bool)}
    for places in windows.values():
        for i, at in places if len(places) > 1 else ():
            removed[i][at : at + 200] = True
    found = {r.doc_id: bytes(r.kept).decode() for r in suffix_dedup.remove_repeats(documents(*texts.items()), window=200).collect()}
    assert found == {i: "".join(c for c, gone in zip(t, removed[i], strict=True) if not gone) for i, t in texts.items()}


def entropy(counts):
    total = sum(counts)
    return -sum(n / total * math.log(n / total) for n in counts if n)


@pytest.mark.parametrize("target", [0.05, 0.2, 0.4, 0.6])
def test_an_entropy_under_the_natural_one_is_met(spark, target):
    rows = [(i, "one two three four", "x" if i < 1400 else "y") for i in range(2000)]
    docs = spark.createDataFrame(rows, "doc_id long, text string, source string")
    found = mixing.mix(docs, target_entropy=target, repetition_limit=None, sharpest=64.0, budget=16_000).groupBy("source").count().collect()
    assert entropy([r["count"] for r in found]) == pytest.approx(target, abs=0.01)
    assert sum(r["count"] for r in found) == pytest.approx(4000, abs=2)


def test_a_sharp_mixture_without_a_budget_has_the_size_of_the_corpus(spark):
    rows = [(i, "one two", "x" if i < 900 else "y" if i < 999 else "z") for i in range(1000)]
    docs = spark.createDataFrame(rows, "doc_id long, text string, source string")
    found = {r.source: r["count"] for r in mixing.mix(docs, target_entropy=0.01, repetition_limit=None, sharpest=500.0).groupBy("source").count().collect()}
    assert sum(found.values()) == pytest.approx(1000, abs=3) and found["x"] > 990


@pytest.mark.parametrize("limit", [1.0, 2.0, 5.0])
def test_weights_follow_the_repetition_limit(spark, limit):
    """The registered form against its definition: passes are as even as the limit allows, and the least is one."""
    sizes = {"a": 1500, "b": 400, "c": 60, "d": 9}
    docs = [(f"{s}{i}", "w " * 3, s) for s, n in sizes.items() for i in range(n)]
    frame = spark.createDataFrame(docs, "doc_id string, text string, source string")
    counts = {r.source: r["count"] for r in mixing.mix(frame, repetition_limit=limit).groupBy("source").count().collect()}
    passes = {s: counts[s] / n for s, n in sizes.items()}
    assert min(passes.values()) == pytest.approx(1.0, abs=0.01) and max(passes.values()) <= limit + 0.12
    share = {s: n / sum(sizes.values()) for s, n in sizes.items()}
    a = 1 - math.log(limit) / math.log(share["a"] / share["d"])
    for s, n in sizes.items():
        assert counts[s] == pytest.approx(n * (share["a"] / share[s]) ** (1 - a), abs=1.5)
