"""Hard negatives against a plain form of their definition."""

from __future__ import annotations

import math
import random

import numpy as np
import pytest
from pyspark.sql import functions as F

from burnwatch.llm import hard_negatives

SCHEMA = "vec_id long, embedding array<float>, label int"


def usable(x):
    return x is not None and all(v is not None and math.isfinite(v) for v in x)


def plain(rows, is_anchor, positives=5, negatives=5, low=80, high=100, scale=256):
    rows = [(i, label, [math.floor(scale * float(np.float32(v))) for v in x]) for i, x, label in rows if i is not None and label is not None and usable(x)]
    anchors = {}
    for i, label, x in rows:
        if is_anchor(i):
            anchors[i] = min(anchors.get(i, (label, x)), (label, x))
    out = []
    for a, (label, x) in anchors.items():
        score = lambda y, x=x: sum(p * q for p, q in zip(x, y, strict=False))
        best = sorted((-score(y), i) for i, other, y in rows if other == label and i != a)[:positives]
        for s, p in best:
            window = sorted((-score(y), i) for i, other, y in rows if other != label and low * -s <= 100 * score(y) <= -high * s)
            out += [(a, p, r, i, -s, -t) for r, (t, i) in enumerate(window[:negatives], 1)]
    return sorted(out)


def mined(spark, rows, every=7, **options):
    vectors = spark.createDataFrame(rows, SCHEMA).repartition(3)
    return sorted(map(tuple, hard_negatives.mine(vectors, F.col("vec_id") % every == 0, **options).collect()))


def made(rng, n, spread, width=8, labels=3):
    centres = [[rng.gauss(0, 1) for _ in range(width)] for _ in range(6)]
    return [(i, [c + rng.gauss(0, spread) for c in rng.choice(centres)], rng.randint(0, labels - 1)) for i in range(n)]


@pytest.mark.parametrize("spread", [0.02, 0.3, 3.0])
def test_equal_to_every_pair(spark, monkeypatch, spread):
    monkeypatch.setattr(hard_negatives, "CANDIDATES", 50)
    rows = made(random.Random(2), 400, spread)
    assert mined(spark, rows) == plain(rows, lambda i: i % 7 == 0)


def test_anchors_in_several_blocks_give_the_same(spark, monkeypatch):
    monkeypatch.setattr(hard_negatives, "ANCHORS", 9)
    rows = made(random.Random(4), 200, 0.2)
    assert mined(spark, rows) == plain(rows, lambda i: i % 7 == 0)


def test_nulls_ties_repeats_and_lengths(spark):
    rng = random.Random(6)
    rows = made(rng, 60, 0.1, width=3, labels=2)
    rows += [(100 + i, rows[7][1], i % 2) for i in range(20)] + rows[:12]
    rows += [(7, [9.0, 9.0, 9.0], 1), (7, [0.5], 0)]
    rows += [(200, None, 1), (201, [1.0, None], 1), (202, [float("nan")], 0), (203, [float("inf")], 0), (None, [1.0], 1), (204, [1.0], None)]
    rows += [(205, [], 0), (206, [1.0, 1.0, 1.0, 1.0, 5.0], 1), (210, [1.0], 0), (217, [-1.0, -1.0], 1)]
    assert mined(spark, rows) == plain(rows, lambda i: i % 7 == 0)


def test_scores_that_doubles_do_not_hold_are_exact(spark):
    rng = random.Random(8)
    rows = [(i, [rng.gauss(0, 1) * 4e5 for _ in range(4)], i % 2) for i in range(40)]
    assert mined(spark, rows) == plain(rows, lambda i: i % 7 == 0)


def test_what_64_bits_do_not_hold_raises(spark):
    with pytest.raises(Exception, match="too large"):
        mined(spark, [(0, [1e30], 1), (1, [1.0], 1)])
    with pytest.raises(Exception, match="(?i)overflow|too large|int too big"):
        mined(spark, [(0, [3e15], 1), (1, [3e15], 1), (2, [3e15], 0)])


@pytest.mark.parametrize("rows", [[], [(1, [1.0], 1)], [(7, [1.0], 1)], [(7, [1.0], 1), (8, [1.0], 2)], [(7, None, 1)], [(7, [], 1), (14, [], 1), (1, [], 2)]])
def test_small_tables(spark, rows):
    assert mined(spark, rows) == plain(rows, lambda i: i % 7 == 0)


def test_names_of_other_columns_do_not_matter(spark):
    rows = [(i, [float(i % 5), 1.0], i % 2, i, i, "x") for i in range(30)]
    vectors = spark.createDataFrame(rows, SCHEMA + ", id long, anchor long, v string")
    got = sorted(map(tuple, hard_negatives.mine(vectors, F.col("vec_id") % 7 == 0).collect()))
    assert got == plain([r[:3] for r in rows], lambda i: i % 7 == 0)


def test_a_tree_has_parents_first_and_short_edges():
    rng = np.random.default_rng(3)
    points = rng.normal(size=(80, 5))
    order, parent, edge = hard_negatives.spanning_tree(points)
    assert sorted(order) == list(range(80)) and parent[0] == -1 and all(0 <= p < i for i, p in enumerate(parent) if i)
    gaps = np.sqrt(((points[:, None] - points[None]) ** 2).sum(axis=2))
    np.testing.assert_allclose(edge[1:], [gaps[order[i], order[parent[i]]] for i in range(1, 80)])
    joined, total = {0}, 0.0
    while len(joined) < 80:
        out = [i for i in range(80) if i not in joined]
        part = gaps[np.ix_(sorted(joined), out)]
        total += part.min()
        joined.add(out[int(part.min(axis=0).argmin())])
    assert math.isclose(sum(edge), total)


def test_only_rows_near_a_window_are_scored(monkeypatch):
    """On tight clusters most rows are settled by the bounds that come down the tree."""
    rng = np.random.default_rng(1)
    centres = rng.normal(size=(8, 32)) * 300
    rows = np.floor(np.repeat(centres, 100, axis=0) + rng.normal(size=(800, 32)) * 3)
    order, parent, edge = hard_negatives.spanning_tree(rows[::10])
    tree = hard_negatives.Tree(np.arange(80), np.zeros(80, int), rows[::10][order], parent, edge)
    exact = 0
    floors = np.sort(rows[::10][order] @ rows.T, axis=1)[:, -20]

    def wanted(i, low, high):
        return high >= floors[i]

    def found(i, at, scores):
        nonlocal exact
        exact += len(at)
        np.testing.assert_array_equal(scores, rows[at] @ tree.points[i])

    tree.sweep(rows, wanted, found)
    assert 80 * 20 <= exact < 0.4 * 80 * 800
